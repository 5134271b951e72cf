"""Quality classifier: a linear-chain CRF labels every line good or bad.

A line is described by its own shape (letters, digits, symbols, repeats, lengths)
and by that of its two neighbours. Training gives every line its document's label,
so the step weights learn how far a verdict carries from line to line. The score of
a document is the mean of the forward-backward probability "good" over its lines,
weighted by their code points.

Defined cases: a null text is empty; an empty text is one empty line and is scored
like any other; repeated rows are scored alike; a row without an id is scored and not
held out; columns other than the id and the text are never read.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressmark.llm import chain_crf, flat

TRAIN_DOCS = 6000  # at most so many labelled documents fit the model
TRAIN_BYTES = 1 << 16  # longer documents are not learned from
TRAIN_LINES = 100_000  # nor lines beyond so many
FOLDS, HELD_OUT = 3, 1

_UPPER, _LOWER, _DIGIT, _SYMBOL, _POINT, _HIGH, _BANG, _BAR = (np.zeros(256, bool) for _ in range(8))
_UPPER[0x41:0x5B] = True
_LOWER[0x61:0x7B] = True
_DIGIT[0x30:0x3A] = True
_SYMBOL[list(b"#*$%&|<>@^~=+_\\/{}[]")] = True
_POINT[list(b".,;:?!'\"()-")] = True
_BANG[list(b"!?")] = True
_BAR[list(b"|")] = True
_HIGH[0x80:] = True


def line_features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of every line with those of its neighbours, lines per text, code points per line."""
    starts, ends, n = flat.lines(data, offs)
    if not len(starts):
        return np.zeros((0, 1)), n, np.zeros(0, np.int64)
    chars = flat.totals(flat.code_points(data), starts, ends)
    size = np.maximum(chars, 1)
    ws, we, _ = flat.words(data, offs)
    lo, hi = np.searchsorted(ws, starts), np.searchsorted(ws, ends)
    n_words = hi - lo
    wide = np.maximum(n_words, 1)
    wchars = flat.totals(flat.code_points(data), ws, we) if len(ws) else np.zeros(0, np.int64)
    at = np.arange(len(ws))
    h = flat.span_hashes(data, ws, we) if len(ws) else np.zeros(0, np.uint64)
    again = np.zeros(len(ws), bool)
    again[1:] = h[1:] == h[:-1]
    opens = np.searchsorted(ws, offs[:-1])
    again[opens[opens < len(ws)]] = False  # a text's first word follows none
    share = lambda kind: flat.totals(kind[data], starts, ends) / size
    line_h = flat.span_hashes(data, starts, ends)
    text_of = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((line_h, text_of))
    same = np.zeros(len(starts), bool)
    if len(order) > 1:
        eq = (line_h[order[1:]] == line_h[order[:-1]]) & (text_of[order[1:]] == text_of[order[:-1]])
        same[order[1:]] |= eq
        same[order[:-1]] |= eq
    same &= n_words > 0
    marked = flat.totals(_SYMBOL[data[we - 1]] | _BANG[data[we - 1]], lo, hi) / wide if len(ws) else np.zeros(len(starts))
    capital = flat.totals(_UPPER[data[ws]], lo, hi) / wide if len(ws) else np.zeros(len(starts))
    mean_word = flat.totals(wchars, lo, hi) / wide if len(ws) else np.zeros(len(starts))
    repeats = flat.totals(again[at], lo, hi) / wide if len(ws) else np.zeros(len(starts))
    upper, symbol, bar = share(_UPPER), share(_SYMBOL), share(_BAR)
    own = np.stack(
        [
            upper, upper > 0.3, share(_LOWER), share(_DIGIT), symbol, symbol > 0.02, share(_POINT), share(_HIGH), share(_BANG), share(_BANG) > 0.05,
            bar, bar > 0.01, marked, marked > 0.3, capital, repeats, repeats > 0.2, same, np.minimum(mean_word, 20) / 10, mean_word > 10, mean_word < 2.5,
            np.log1p(n_words) / 4, n_words == 0, n_words < 4, np.log1p(chars) / 6,
        ],
        1,
    ).astype(np.float64)
    first = np.zeros(len(starts), bool)
    first[np.cumsum(n) - n] = True
    last = np.zeros(len(starts), bool)
    last[np.cumsum(n) - 1] = True
    prev, after = np.zeros_like(own), np.zeros_like(own)
    prev[1:], after[:-1] = own[:-1], own[1:]
    prev[first], after[last] = 0, 0
    x = np.concatenate([own, prev, after, np.stack([first, last, np.ones(len(first))], 1)], 1)
    return x, n, chars


def labelled(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_DOCS, longest: int = TRAIN_BYTES) -> DataFrame:
    """(place, text, quality) of at most ``limit`` labelled documents outside the held-out fold, of at most ``longest`` bytes each.

    They are chosen by a hash of the id, and place is their order by it; of rows that share an id that with the least text counts.
    """
    ids = labels.filter(F.col("quality").isin(0, 1) & (F.crc32(F.col("doc_id").cast("string")) % FOLDS != HELD_OUT)).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).filter(F.octet_length("text") <= longest).join(F.broadcast(ids), "doc_id")  # limit bounds the broadcast
    return rows.groupBy("doc_id", "quality").agg(F.min("text").alias("text")).select(F.struct(F.xxhash64("doc_id"), F.col("doc_id").cast("string")).alias("place"), "text", "quality")


def fitted(rows: DataFrame, features: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], train: Callable[[np.ndarray, np.ndarray, np.ndarray], object], most: int = TRAIN_LINES) -> object:
    """train(x, y, n) run in one task over the rows of ``labelled``, in their order, whose count is bounded.

    features(bytes, offsets) gives the feature rows of some texts and how many each has; the
    first texts with at most ``most`` feature rows together are used. The driver receives the
    model alone.
    """

    def nothing() -> object:
        return train(features(np.zeros(0, np.uint8), np.zeros(1, np.int64))[0], np.zeros(0, np.int64), np.zeros(0, np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        xs, ys, ns, left = [], [], [], most
        for batch in batches:
            for i, j, data, offs in flat.slices(batch.column("text")):
                x, n = features(data, offs)
                fits = int(np.searchsorted(np.cumsum(n), left, "right")) if left else 0
                rows = int(n[:fits].sum())
                left = left - rows if fits == j - i else 0
                xs.append(x[:rows])
                ys.append(batch.column("quality").slice(i, fits).to_numpy().astype(np.int64))
                ns.append(n[:fits])
        model = train(np.concatenate(xs), np.concatenate(ys), np.concatenate(ns)) if xs else nothing()
        yield pa.record_batch([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    one = rows.repartition(1).sortWithinPartitions("place").select("text", "quality").mapInArrow(run, "model binary")
    found = one.first()
    return pickle.loads(found["model"]) if found else nothing()


def fit(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_DOCS, l2: float = 4.0) -> chain_crf.ChainCRF:
    """Fits the field on at most ``limit`` labelled documents and ``TRAIN_LINES`` lines; without any, every score is 0.5."""

    def features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return line_features(data, offs)[:2]

    def train(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> chain_crf.ChainCRF:
        if not len(n):
            width = line_features(np.zeros(0, np.uint8), np.zeros(2, np.int64))[0].shape[1]
            return chain_crf.ChainCRF(np.zeros((width, 2)), np.zeros((2, 2)))
        return chain_crf.fit(x, np.repeat(y, n), n, l2=l2)

    return fitted(labelled(docs, labels, limit), features, train)


def scores(model: chain_crf.ChainCRF, column: pa.Array) -> np.ndarray:
    """The quality of every text of an Arrow column."""
    out = np.zeros(len(column))
    for i, j, data, offs in flat.slices(column):
        x, n, chars = line_features(data, offs)
        good = model.marginals(x, n)[:, 1]
        weight = np.maximum(chars, 1)
        prefix = np.concatenate([[0.0], np.cumsum(good * weight)])
        mass = np.concatenate([[0], np.cumsum(weight)])
        ends = np.cumsum(n)
        out[i:j] = (prefix[ends] - prefix[ends - n]) / (mass[ends] - mass[ends - n])
    return np.clip(out, 0.0, 1.0)


def score(docs: DataFrame, model: chain_crf.ChainCRF) -> DataFrame:
    """doc_id, score of every row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column("doc_id"), pa.array(scores(model, batch.column("text")), pa.float64())], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def keep(docs: DataFrame, model: chain_crf.ChainCRF, least: float = 0.5) -> DataFrame:
    """The rows of docs, all columns, whose score is ``least`` or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(scores(model, batch.column("text")) >= least))

    return docs.mapInArrow(run, docs.schema)


def op7_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select(
        "doc_id",
        F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == HELD_OUT, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
