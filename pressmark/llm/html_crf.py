"""HTML extraction: a linear-chain CRF over DOM leaf blocks, decoded by Viterbi.

A page is read as leaf blocks. A block is described by the elements it lies in (tags,
and families of words in their class, id and role) and by its own text; the step
weights carry a verdict to its neighbours. The field is trained on labelled pages:
``labelled_pages`` lays out pages of random words in many templates and knows which
blocks are the article. Its size is a parameter and does not grow with the input.

Defined cases: a null or empty page has the empty text; broken markup is read as far as
it goes; repeated rows give equal results; other columns are never read.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pressmark.llm import chain_crf
from pressmark.llm.html_blocks import Block, blocks

TRAIN_PAGES = 500

#: Families of words in class, id, role and label that say what an element is for.
FAMILIES = {
    "advert": r"ads?|adverts?|advertise\w*|sponsor\w*|promo\w*|banner|adsense|adslot|dfp",
    "menu": r"nav\w*|menus?|breadcrumbs?|toc|pagination|pager|tabs?|skip\w*|navigation",
    "foot": r"foot\w*|copyright|legal|colophon|contentinfo",
    "head": r"header|masthead|topbar|logo|site-?title|brand|tagline",
    "side": r"side\w*|aside|related|widget\w*|share|sharing|social|recommend\w*|trending|popular|complementary|more|tags",
    "reader": r"comments?|comment-\w+|reply|replies|respond|disqus|discussion|reviews?|commentlist|responses?|feedback",
    "notice": r"cookies?|consent|gdpr|notices?|alert\w*|popup|modal|overlay|dialog|paywall|disclaimer|warning|toast|announcement",
    "form": r"form\w*|newsletter|subscri\w*|signup|sign-up|login|search\w*|register",
    "content": r"content|article\w*|post|entry|body|main|story|text|prose|page-content|single|blog",
    "byline": r"meta|byline|author|date|timestamp|caption|credit",
}
_FAMILY = [re.compile(rf"(?:^|[\s_-])(?:{p})(?:$|[\s_-])") for p in FAMILIES.values()]
_HIDDEN = len(FAMILIES)
TAGS = ("article", "main", "nav", "header", "footer", "aside", "form", "ul", "ol", "li", "table", "figure", "section", "blockquote", "dialog", "details", "fieldset", "dl", "menu", "address")
_TAG_BIT = {t: 1 << (_HIDDEN + 1 + k) for k, t in enumerate(TAGS)}
_BITS = _HIDDEN + 1 + len(TAGS)
_OWN = ("p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "div", "td", "th", "pre", "blockquote", "body", "span", "figcaption", "dd", "dt", "label", "legend", "#")
_STOCK = re.compile(r"©|\(c\) |copyright|all rights reserved|cookies?\b|subscribe|sign up|log in|advert|privacy|terms of|newsletter|share this|read more|related|leave a|repl(?:y|ies)\b|comments?\b", re.I)
_seen: dict[tuple, int] = {}


def kind_of(tag: str, marks: dict[str, str]) -> int:
    """The bits of one element."""
    key = (tag, *sorted(marks.items()))
    if key in _seen:
        return _seen[key]
    bits = _TAG_BIT.get(tag, 0)
    words = " ".join(marks.get(k, "") for k in ("class", "id", "role", "aria-label"))
    if words.strip():
        for k, p in enumerate(_FAMILY):
            if p.search(words):
                bits |= 1 << k
    if "hidden" in marks or marks.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", marks.get("style", "")):
        bits |= 1 << _HIDDEN
    if len(_seen) < 20_000:
        _seen[key] = bits
    return bits


def block_features(pages: list[list[Block]]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all blocks of the pages, and blocks per page."""
    n = np.array([len(p) for p in pages], np.int64)
    every = [b for p in pages for b in p]
    if not every:
        return np.zeros((0, _BITS + len(_OWN) + 16)), n
    kinds = np.array([b.kinds for b in every], np.int64)
    bits = (kinds[:, None] >> np.arange(_BITS)) & 1
    own_at = {t: k for k, t in enumerate(_OWN)}
    own = np.zeros((len(every), len(_OWN)))
    for i, b in enumerate(every):
        own[i, own_at.get(b.tag, -1)] = 1
    size = np.array([len(b.text) for b in every], float)
    words = np.array([b.text.count(" ") + 1 for b in every], float)
    link = np.array([b.linked for b in every], float) / size
    stop = np.array([not b.text[-1].isalnum() for b in every], float)
    stock = np.array([len(b.text) < 300 and _STOCK.search(b.text) is not None for b in every], float)
    depth = np.array([b.depth for b in every], float)
    first = np.repeat(np.cumsum(n) - n, n)
    where = (np.arange(len(every)) - first) / np.repeat(np.maximum(n, 1), n)
    in_content = bits[:, list(FAMILIES).index("content")] | bits[:, _HIDDEN + 1] | bits[:, _HIDDEN + 2]
    has_content = np.maximum.reduceat(in_content, (np.cumsum(n) - n)[n > 0]).repeat(n[n > 0])
    bad = bits[:, [list(FAMILIES).index(f) for f in ("advert", "menu", "foot", "side", "reader", "notice", "form")]].any(1)
    x = np.stack(
        [
            np.log1p(size) / 5, words < 4, (words >= 4) & (words < 12), words > 30, link, link > 0.5, stop, stop * (words > 8), stock, np.minimum(depth, 12) / 12,
            where, (where - 0.5) ** 2, in_content * (1 - bad), (1 - in_content) * has_content, (1 - has_content) * (words > 12), np.ones(len(every)),
        ],
        1,
    )
    return np.concatenate([bits, own, x], 1).astype(float), n


# -- labelled pages


def labelled_pages(count: int = TRAIN_PAGES, seed: int = 7) -> list[tuple[str, list[str]]]:
    """Pages of random words in many templates, each with the text blocks of its article in order."""
    r = random.Random(seed)
    syllable = lambda: r.choice("bcdfghjklmnprstvwz") + r.choice("aeiouy" if r.random() < 0.9 else "äåëìôúøč")
    word = lambda: "".join(syllable() for _ in range(r.choice([1, 1, 2, 2, 3, 4]))) + r.choice(["", "", "n", "s", "l"])
    noise = lambda: "".join(r.choice("!#$%*+-=@^_~|/\\") for _ in range(r.randint(1, 3)))

    def words(a: int, b: int, end: str = "") -> str:
        return " ".join(word() for _ in range(r.randint(a, b))).capitalize() + end

    def pick(*options):
        return r.choice(options)()

    def sentence_block() -> str:
        return " ".join(words(1, 22, r.choice([".", ".", ".", "!", "?", "", ":", ";", noise()])) for _ in range(r.choice([1, 1, 1, 2, 3, 6])))

    def inline(text: str) -> str:
        """Text whose beginning may stand in an element of a line, closed or left open, or with a break after it."""
        if r.random() < 0.75:
            return text
        tag, cut = r.choice(["b", "i", "em", "strong", "span", "a", "u", "font"]), r.randint(0, len(text))
        cut = text.rfind(" ", 0, cut) if " " in text[:cut] else len(text)
        return f"<{tag}>{text[:cut]}" + r.choice([f"</{tag}>", f"</{tag}>", ""]) + text[cut:] + r.choice(["", "", "<br>", "<br/>"])

    def links(a: int, b: int, tag: str = "li") -> str:
        return "".join(f'<{tag}><a href="/{word()}">{words(1, 3)}</a></{tag}>' for _ in range(r.randint(a, b)))

    def cls(*names: str) -> str:
        n = r.choice(names)
        return r.choice([f' class="{n}"', f' id="{n}"', f' class="{word()} {n}"', f' class="{n}-{word()}"'])

    def menu() -> str:
        return pick(lambda: f"<nav><ul>{links(3, 9)}</ul></nav>", lambda: f"<div{cls('menu', 'nav', 'navbar', 'breadcrumbs', 'pagination')}><ul>{links(3, 9)}</ul></div>", lambda: f"<nav>{links(2, 6, 'div')}</nav>", lambda: f"<div{cls('topnav', 'navigation', 'menu')}>{links(3, 7, 'span')}</div>")

    def head() -> str:
        return pick(lambda: f"<header><h1>{words(1, 4)}</h1><p>{words(2, 7)}</p></header>", lambda: f"<div{cls('header', 'masthead', 'topbar')}><div>{words(1, 4)}</div>{words(2, 5)}</div>", lambda: f"<header><a href='/'>{words(1, 3)}</a>{menu()}</header>")

    def advert() -> str:
        return f"<{(t := r.choice(['div', 'aside', 'section', 'p']))}{cls('ad', 'ads', 'advert', 'sponsored', 'promo', 'banner', 'advertisement')}>{sentence_block()}</{t}>"

    def side() -> str:
        return pick(lambda: f"<aside><h3>{words(1, 3)}</h3><ul>{links(2, 6)}</ul></aside>", lambda: f"<div{cls('sidebar', 'related', 'widget', 'social', 'share', 'side')}><h4>{words(1, 3)}</h4><p>{sentence_block()}</p>{links(1, 4, 'p')}</div>", lambda: f"<aside><p>{sentence_block()}</p><p>{sentence_block()}</p></aside>", lambda: f"<section{cls('related', 'recommended', 'trending')}><h2>{words(1, 3)}</h2>{links(2, 5, 'p')}</section>")

    def notice() -> str:
        return f"<div{cls('cookie', 'cookie-notice', 'notice', 'alert', 'consent', 'popup', 'modal', 'paywall')}><p>{r.choice(['', 'We use cookies. '])}{sentence_block()}</p><button>{word()}</button></div>"

    def form() -> str:
        return f"<form{r.choice(['', cls('search', 'newsletter', 'signup')])}><label>{words(1, 4)}</label><input name=q><p>{sentence_block()}</p><select><option>{word()}</option></select><button>{word()}</button></form>"

    def reader() -> str:
        one = lambda: pick(lambda: f"<div{cls('comment', 'reply')}><p><b>{words(1, 2)}</b></p><p>{sentence_block()}</p></div>", lambda: f"<li><p>{sentence_block()}</p></li>", lambda: f"<article{cls('comment')}><p>{sentence_block()}</p></article>")
        many = "".join(one() for _ in range(r.randint(1, 4)))
        return f"<{(t := r.choice(['div', 'section', 'aside', 'ol']))}{cls('comments', 'comment-list', 'discussion', 'responses', 'disqus', 'reviews')}><h3>{words(1, 3)}</h3>{many}</{t}>"

    def foot() -> str:
        return pick(lambda: f"<footer>{r.choice(['&copy;', '(c)', 'Copyright', '&#169;'])} {r.randint(1995, 2030)} {words(1, 3)}. {sentence_block()}</footer>", lambda: f"<footer>{words(1, 3)} &ndash; {sentence_block()}</footer>", lambda: f"<div{cls('footer', 'copyright', 'legal')}><p>{sentence_block()}</p><ul>{links(1, 4)}</ul></div>", lambda: f"<footer><p>{sentence_block()}</p>{menu()}</footer>")

    def hidden() -> str:
        return f"<div style='display:none'><p>{sentence_block()}</p></div>"

    out = []
    for _ in range(count):
        gold: list[str] = []

        def say(text: str) -> str:
            gold.append(text)
            return text

        def block() -> str:
            open_end = r.random() < 0.2
            return pick(
                *[lambda: f"<p>{inline(say(sentence_block()))}" + ("" if open_end else "</p>")] * 9,
                lambda: f"<h{(k := r.randint(2, 4))}>{say(words(1, 9))}</h{k}>",
                lambda: "<ul>" + "".join(f"<li>{say(words(1, 14))}</li>" for _ in range(r.randint(1, 5))) + "</ul>",
                lambda: "<ol>" + "".join(f"<li><p>{say(sentence_block())}</p></li>" for _ in range(r.randint(1, 4))) + "</ol>",
                lambda: f"<blockquote><p>{say(sentence_block())}</p></blockquote>",
                lambda: f"<pre>{say(words(3, 15))}</pre>",
                lambda: f"<div>{say(sentence_block())}</div>",
                lambda: "<table>" + "".join(f"<tr><td>{say(words(1, 4))}</td><td>{say(words(1, 4))}</td></tr>" for _ in range(r.randint(1, 3))) + "</table>",
            )

        def story() -> str:
            parts = [f"<h1>{say(words(1, 10, r.choice(['', '.'])))}</h1>"] if r.random() < 0.8 else []
            for _ in range(r.choice([1, 1, 2, 4, 8, 16, 30])):
                parts.append(block())
                if r.random() < 0.06:
                    parts.append(r.choice([advert, side, form, hidden, notice])())
            return "".join(parts)

        body = []
        for make, p in ((notice, 0.3), (head, 0.45), (menu, 0.8), (advert, 0.4), (form, 0.2), (side, 0.25)):
            if r.random() < p:
                body.append(make())
        inner = story()
        body.append(pick(*[lambda: f"<article>{inner}</article>"] * 3, lambda: f"<main>{inner}</main>", lambda: f"<main><article>{inner}</article></main>", lambda: f"<div{cls('content', 'post', 'entry', 'article', 'main', 'story')}>{inner}</div>", lambda: f"<div>{inner}</div>", lambda: f"<section><article>{inner}</article></section>", lambda: inner))
        for make, p in ((advert, 0.3), (reader, 0.45), (side, 0.4), (form, 0.25), (menu, 0.15), (hidden, 0.1), (foot, 0.85), (notice, 0.1)):
            if r.random() < p:
                body.append(make())
        page = f"<!DOCTYPE html><html><head><meta charset=utf-8><title>{words(1, 6)}</title><style>.{word()}{{color:#333}}</style></head><body>{''.join(body)}<script>window.{word()}=1;</script></body></html>"
        out.append((page, gold))
    return out


def fit(pages: list[tuple[str, list[str]]] | None = None) -> chain_crf.ChainCRF:
    """Trains on (html, texts of the article's blocks in order)."""
    pages = labelled_pages() if pages is None else pages
    read = [blocks(p, kind_of) for p, _ in pages]
    y: list[int] = []
    for found, (_, gold) in zip(read, pages):
        want = iter([" ".join(g.split()) for g in gold])
        nxt = next(want, None)
        for b in found:
            hit = nxt is not None and b.text == nxt
            y.append(int(hit))
            if hit:
                nxt = next(want, None)
        if nxt is not None:
            raise ValueError("a labelled block is not among the page's blocks")
    x, n = block_features(read)
    return chain_crf.fit(x, np.array(y), n, l2=1.0, rounds=120)


def main_texts(model: chain_crf.ChainCRF, pages: list[str | None]) -> list[str]:
    """The main text of each page."""
    read = [blocks(p or "", kind_of) for p in pages]
    x, n = block_features(read)
    path = model.decode(x, n)
    out, at = [], 0
    for found in read:
        out.append("\n\n".join(b.text for b, good in zip(found, path[at : at + len(found)]) if good))
        at += len(found)
    return out


def extract(pages: DataFrame, model: chain_crf.ChainCRF, chunk: int = 100) -> DataFrame:
    """page_id, url, text of every row of pages."""
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, chunk):
                b = batch.slice(i, chunk)
                yield pa.record_batch([b.column("page_id"), b.column("url"), pa.array(main_texts(model, b.column("html").to_pylist()), pa.string())], ["page_id", "url", "text"])

    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, url string, text string")


def op2_html_extraction(spark, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    rows = extract(spark.read.parquet(f"{sf_dir}/pages.parquet"), fit())
    return rows.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
