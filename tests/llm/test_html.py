import pytest

from pressmark.llm import html_crf as H
from pressmark.llm.html_blocks import blocks


@pytest.fixture(scope="module")
def model():
    return H.fit(H.labelled_pages(250))


def texts(page):
    return [b.text for b in blocks(page, H.kind_of)]


def test_blocks_read_broken_markup():
    assert texts("<p>a<p>b <b>c</b>d<br>e</p>tail") == ["a", "b cd e", "tail"]
    assert texts("<ul><li>x<li>y</ul><table><tr><td>1<td>2<tr><td>3</table>") == ["x", "y", "1", "2", "3"]
    assert texts("<script>var t='</p>';</script><style>p{}</style><p>1 < 2 &amp;&lt;&#233;&nbsp;z</p><!-- no <p>x --> end") == ["1 < 2 &<é z", "end"]
    assert texts("<head><title>t</title></head><body>b") == ["b"]
    assert texts("") == [] and texts("<") == ["<"] and texts("<p") == ["<p"] and texts("<script>never closed <p>x") == []
    assert texts("&amp;lt; &AMP; &copy;") == ["&lt; & ©"]


def test_held_out_pages(model):
    pages = H.labelled_pages(150, seed=12345)
    got = H.main_texts(model, [p for p, _ in pages])
    assert sum(g == "\n\n".join(" ".join(x.split()) for x in gold) for g, (_, gold) in zip(got, pages)) >= 140


def test_written_page(model):
    page = """<html><head><title>T</title></head><body><nav><a href=/>Home</a> <a href=/x>News</a></nav><div class="ad">Buy now.</div>
    <article><h1>The   heading</h1><p>First paragraph, with   <i>some</i> emphasis and words enough to be prose.</p><p>Er.</p><ul><li>one item</li><li>two items</li></ul></article>
    <section id="comments"><p>I liked this very much, thank you for writing it.</p></section><footer>&copy; 2020 x</footer></body></html>"""
    assert H.main_texts(model, [page]) == ["The heading\n\nFirst paragraph, with some emphasis and words enough to be prose.\n\nEr.\n\none item\n\ntwo items"]


def test_op2(spark, tmp_path):
    rows = [(1, "u", None), (2, None, ""), (3, "v", "<article><p>Some words of an article that is long enough.</p></article><footer>&copy; x</footer>"), (None, "w", "<nav><a>x</a></nav>"), (3, "v", "<article><p>" + "word " * 20000 + "</p></article>")]
    spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, text string").write.parquet(f"{tmp_path}/pages.parquet")
    got = H.op2_html_extraction(spark, str(tmp_path)).collect()
    assert sorted((r.page_id or 0, r.n_chars, len(r.text)) for r in got) == [(0, 0, 0), (1, 0, 0), (2, 0, 0), (3, 45, 45), (3, 99999, 99999)]
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/e/pages.parquet")
    assert H.op2_html_extraction(spark, f"{tmp_path}/e").count() == 0


def article_of(html):
    """What stands in the one article of a page of the test tables, by its tags."""
    import html as entities
    import re

    plain = re.sub(r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>", "", html)
    inside = re.search(r"(?is)<article\b[^>]*>(.*)</article>", plain)[1]
    parts = re.split(r"(?i)</?(?:p|h[1-6]|ul|ol|li|div|table|tr|td|th|blockquote|section|pre)\b[^>]*>", inside)
    texts = (" ".join(entities.unescape(re.sub(r"<[^>]+>", "", re.sub(r"(?i)<br[^>]*>", " ", p))).split()) for p in parts)
    return "\n\n".join(x for x in texts if x)


def test_op2_against_the_articles(spark):
    folder = "/root/testdata/sf0.001"
    pages = {r.page_id: r for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    rows = H.op2_html_extraction(spark, folder).collect()
    assert len(rows) == len(pages) > 20
    for r in rows:
        want = article_of(pages[r.page_id].html)
        assert (r.url, r.text, r.n_chars) == (pages[r.page_id].url, want, len(want))


#: Layouts of kinds that the training pages do not have, written by hand: (page, the article's blocks).
LONG = "The committee met in the spring and heard from eleven witnesses, most of whom asked for more time to prepare."
OTHER = [
    (f"<body><table width=100%><tr><td class=leftnav><a href=/>Home</a><br><a href=/a>About us</a></td><td><h2>Minutes of March</h2><p>{LONG}</p><p>{LONG} It rose at noon.</p></td></tr></table><p class=copyright>Copyright 2001 the county.</p></body>", ["Minutes of March", LONG, LONG + " It rose at noon."]),
    (f"<body><div id=page><div id=masthead><h1>Daily Bulletin</h1><ul class=menu><li><a href=/>Front</a></li><li><a href=/s>Sport</a></li></ul></div><div id=content><div class=post><h2>Rain in the valley</h2><p>{LONG}</p><blockquote>{LONG}</blockquote><p>{LONG}</p></div></div><div id=sidebar><h3>Recent</h3><ul><li><a href=/1>Older news</a></li></ul></div><div id=footer>Powered by a press.</div></div></body>", ["Rain in the valley", LONG, LONG, LONG]),
    (f"<body><a class=skip-link href=#m>Skip to content</a><header role=banner><span>Site</span></header><main id=m><article><header><h1>On wells</h1></header><p>{LONG}</p><dl><dt>Depth</dt><dd>Forty feet at most.</dd></dl><p>{LONG}</p></article></main><section id=comments><h2>2 replies</h2><ol class=commentlist><li><p>Thanks for this, very useful to me.</p></li></ol></section><footer><p>All rights reserved.</p></footer></body>", ["On wells", LONG, "Depth", "Forty feet at most.", LONG]),
    (f"<body><div class=cookie-banner><p>This site keeps cookies.</p><button>Fine</button></div><section><h1>Notes</h1><p>{LONG}</p><ul><li>First of the notes made that day.</li><li>Second of the notes made that day.</li></ul></section><form class=newsletter><p>Get our letter every week.</p><input><button>Go</button></form></body>", ["Notes", LONG, "First of the notes made that day.", "Second of the notes made that day."]),
    (f"<body>{LONG}<p>{LONG}<p>{LONG}</body>", [LONG, LONG, LONG]),
]


def test_layouts_of_other_kinds(model):
    got = H.main_texts(model, [p for p, _ in OTHER])
    found = [(set(g.split("\n\n")), set(want)) for g, (_, want) in zip(got, OTHER)]
    hit, said, there = sum(len(g & w) for g, w in found), sum(len(g) for g, _ in found), sum(len(w) for _, w in found)
    assert hit / said >= 0.9 and hit / there >= 0.9, [(g - w, w - g) for g, w in found]
