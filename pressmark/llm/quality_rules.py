"""Quality rules: boosted trees over document statistics, after two fixed base rules.

The statistics are counts over the whole text. Some are known to speak against a
document however much there is of them (symbols, repeated lines and windows, capital
words, bars): the trees are constrained to never raise the verdict with them.

Defined cases: a null text has no words and fails the base rules; an empty text too;
repeated rows get equal results; other columns are passed over.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pressmark.llm import flat, gbdt
from pressmark.llm.quality_crf import TRAIN_DOCS, fitted, labelled

WINDOW = 8
LEAST_WORDS = 20
MOST_REPEATED = 30  # per cent of the words

#: Statistics the trees see, and whether the verdict may only fall (-1) or rise (+1) with them.
FEATURES = {
    "log_words": 0, "word_length": 0, "symbol_share": -1, "dup_line_share": -1, "repeat_share": -1, "capital_share": -1, "bar_share": -1, "bang_share": -1,
    "digit_share": 0, "point_share": 0, "high_share": 0, "line_words": 0, "distinct_share": +1, "twin_share": -1, "marked_share": -1,
}

_SYMBOL, _CAPITAL, _BAR, _BANG, _DIGIT, _POINT, _HIGH = (np.zeros(256, bool) for _ in range(7))
_SYMBOL[list(b"#*$%&|<>")] = True
_CAPITAL[0x41:0x5B] = True
_BAR[list(b"|")] = True
_BANG[list(b"!")] = True
_DIGIT[0x30:0x3A] = True
_POINT[list(b".,;:?")] = True
_HIGH[0x80:] = True


def _repeated(keys: np.ndarray) -> np.ndarray:
    """True where a key is there twice or more."""
    s = np.sort(keys)
    twice = s[1:][s[1:] == s[:-1]]
    if not len(twice):
        return np.zeros(len(keys), bool)
    at = np.searchsorted(twice, keys)
    return twice[np.minimum(at, len(twice) - 1)] == keys


def statistics(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per text: the counts n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words; and the FEATURES."""
    n = len(offs) - 1
    text = np.arange(n, dtype=np.uint64)
    salt = flat.mixed(text + np.uint64(1))
    ws, we, n_words = flat.words(data, offs)
    ends = np.cumsum(n_words)
    begins = ends - n_words
    word_text = np.repeat(np.arange(n), n_words)
    chars = flat.totals(flat.code_points(data), ws, we)
    h = flat.span_hashes(data, ws, we)
    per_text = lambda kind: flat.totals(kind[data], offs[:-1], offs[1:])
    n_symbols = per_text(_SYMBOL)
    with np.errstate(over="ignore"):
        windows = np.zeros(max(0, len(h) - WINDOW + 1), np.uint64)
        for k in range(WINDOW):
            windows += h[k : k + len(windows)] * flat.powers(WINDOW)[k]
    whole = np.arange(len(windows)) + WINDOW <= ends[word_text[: len(windows)]]
    at = np.flatnonzero(whole)
    at = at[_repeated(flat.mixed(windows[at]) ^ salt[word_text[at]])]
    covered = np.zeros(len(h) + 1, np.int64)
    covered[at] += 1
    covered[at + WINDOW] -= 1
    in_repeat = np.cumsum(covered)[:-1] > 0
    n_repeat = flat.totals(in_repeat, begins, ends)
    ls, le, n_lines = flat.lines(data, offs)
    line_ends = np.cumsum(n_lines)
    has_word = np.searchsorted(ws, le) > np.searchsorted(ws, ls)
    key = flat.span_hashes(data, ls, le) ^ salt[np.repeat(np.arange(n), n_lines)]
    dup = np.zeros(len(ls), bool)
    some = np.flatnonzero(has_word)
    some = some[_repeated(key[some])]
    order = some[np.argsort(key[some], kind="stable")]
    dup[order[1:][key[order[1:]] == key[order[:-1]]]] = True
    n_dup = flat.totals(dup, line_ends - n_lines, line_ends)
    word_chars = flat.totals(chars, begins, ends)

    wide, size = np.maximum(n_words, 1), np.maximum(offs[1:] - offs[:-1], 1)
    twin = np.zeros(len(h), bool)
    twin[1:] = (h[1:] == h[:-1]) & (word_text[1:] == word_text[:-1])
    salted = np.sort(h ^ salt[word_text])
    fresh = np.ones(len(h), bool)
    fresh[1:] = salted[1:] != salted[:-1]
    # a word's first sight in the sorted order counts once for its text
    distinct = np.bincount(word_text[np.argsort(h ^ salt[word_text], kind="stable")][fresh], minlength=n) if len(h) else np.zeros(n)
    full_lines = np.maximum(flat.totals(has_word, line_ends - n_lines, line_ends), 1)
    share = lambda kind, per=size: per_text(kind) / per
    words_with = lambda flags: flat.totals(flags, begins, ends) / wide if len(h) else np.zeros(n)
    x = np.stack(
        [
            np.log1p(n_words), word_chars / wide, n_symbols / np.maximum(word_chars, 1), n_dup / full_lines, n_repeat / wide, words_with(_CAPITAL[data[ws]] & _CAPITAL[data[np.minimum(ws + 1, we - 1)]]),
            share(_BAR), share(_BANG), share(_DIGIT), share(_POINT), share(_HIGH), n_words / full_lines, distinct / np.sqrt(wide), words_with(twin), words_with((_SYMBOL | _BANG)[data[we - 1]]),
        ],
        1,
    )
    return np.stack([n_words, word_chars, n_symbols, n_dup, n_repeat], 1), x


def base_failed(counts: np.ndarray) -> np.ndarray:
    return (counts[:, 0] < LEAST_WORDS) | (100 * counts[:, 4] > MOST_REPEATED * counts[:, 0])


def fit(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_DOCS) -> gbdt.Forest:
    """Fits the trees on at most ``limit`` labelled documents; without any, every document passes."""

    def features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = statistics(data, offs)[1]
        return x, np.ones(len(x), np.int64)

    def train(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> gbdt.Forest:
        return gbdt.fit(x.reshape(-1, len(FEATURES)), y.astype(float), np.array(list(FEATURES.values())))

    return fitted(labelled(docs, labels, limit), features, train)


def verdicts(model: gbdt.Forest, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts, base_failed and the probability that a document is good, for every text of an Arrow column."""
    counts, score = np.zeros((len(column), 5), np.int64), np.zeros(len(column))
    for i, j, data, offs in flat.slices(column):
        counts[i:j], x = statistics(data, offs)
        score[i:j] = model.probability(x)
    return counts, base_failed(counts), score


def judge(docs: DataFrame, model: gbdt.Forest, least: float = 0.5) -> DataFrame:
    """doc_id, the counts, base_failed, kept and the trees' score for every row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, failed, score = verdicts(model, batch.column("text"))
            yield pa.record_batch(
                [batch.column("doc_id"), *(pa.array(counts[:, k]) for k in range(5)), pa.array(failed), pa.array(~failed & (score >= least)), pa.array(score)],
                ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, score double")


def keep(docs: DataFrame, model: gbdt.Forest, least: float = 0.5) -> DataFrame:
    """The rows of docs, all columns, that pass the base rules and the trees."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, failed, score = verdicts(model, batch.column("text"))
            yield batch.filter(pa.array(~failed & (score >= least)))

    return docs.mapInArrow(run, docs.schema)


def op1_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return judge(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
