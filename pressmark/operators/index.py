"""A kept index with positions: exact top k by BM25 with block-max pruning, phrases, all-of and prefix searches.

Documents are taken apart once, in segments that a task fills one after another. Within a segment a term's
documents, in order of their key, are cut into blocks of ``BLOCK``; a block is a row: keys and positions as
differences, term frequencies, document lengths, and its competitive pairs (tf, length), from which the largest
weight in the block follows for any size of the collection. Rows are dealt by term and segment over files that are sorted
by term, with small row groups, so a question reads its terms' row groups alone. What has to be known of the whole collection is in a
pointer that is written last.

A question's blocks meet by segment. Where no sum of its blocks' largest weights reaches the k-th best score known so far,
none of the documents there is looked at, and blocks with no other are not decoded. The result is exact.

Defined cases: keys are integers and unique; rows without a key are left out; a null text has no tokens and counts as a
document of length zero; a phrase or list of terms without a token finds nothing; ties go by key.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from pressmark.functions import text
from pressmark.operators.retrieval import K1, B
from pressmark.session import setting
from pressmark.sources.sinks import Store

BLOCK = 128
SEGMENT_TOKENS = 1 << 20  # a worker holds one segment, some 150 bytes a token while it is cut into blocks
BATCH = 1000  # documents that come to a worker at a time
ROW_GROUP = 4 << 20
POINTER = "index.json"
MANY = 32
_DDL = "term string, segment long, block int, n int, first long, last long, keys array<bigint>, tfs array<int>, dls array<int>, best_tf array<int>, best_dl array<int>, least_tf int, most_dl int, positions array<int>"


def _runs(codes: np.ndarray) -> np.ndarray:
    """Where runs of equal values start."""
    return np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.zeros(0, np.int64)


def _lists(values: np.ndarray, starts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(starts, len(values)), pa.int32()), pa.array(values, kind))


def _differences(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Each run's first value as it is, then the steps."""
    out = np.diff(values, prepend=0)
    out[starts] = values[starts]
    return out


def _restored(steps: np.ndarray, starts: np.ndarray) -> np.ndarray:
    total = np.cumsum(steps)
    before = np.where(starts > 0, total[starts - 1], 0)
    return total - np.repeat(before, np.diff(np.append(starts, len(steps))))


def _competitive(tfs: np.ndarray, dls: np.ndarray) -> tuple[list[int], list[int]]:
    """The pairs that no other beats by both a larger frequency and a smaller length."""
    order = np.lexsort((dls, -tfs))
    least = np.minimum.accumulate(dls[order])
    kept = order[np.concatenate([[True], dls[order][1:] < least[:-1]])]
    return tfs[kept].tolist(), dls[kept].tolist()


def _segment(number: int, keys: np.ndarray, tokens: list[pa.Array], block: int) -> pa.RecordBatch:
    """All blocks of a segment. The documents themselves are the postings of the empty term, which no token is."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    dls = np.array([len(tokens[i]) for i in order], np.int64)
    words = pa.concat_arrays([tokens[i] for i in order]).dictionary_encode()
    names = words.dictionary.to_pylist()
    rank = np.empty(len(names), np.int64)
    by_name = sorted(range(len(names)), key=names.__getitem__)
    rank[by_name] = np.arange(len(names))
    code = rank[words.indices.to_numpy()] if len(names) else np.zeros(0, np.int64)
    doc = np.repeat(np.arange(len(keys)), dls)
    place = np.arange(len(code)) - np.repeat(np.cumsum(dls) - dls, dls)
    sort = np.argsort(code, kind="stable")  # by term, then document, then place
    code, doc, place = code[sort], doc[sort], place[sort]
    post = _runs(code * len(keys) + doc)  # one a term and document
    tf = np.diff(np.append(post, len(code)))
    term, owner = code[post], doc[post]
    # the empty term first, with every document
    term, owner, tf = np.concatenate([np.full(len(keys), -1), term]), np.concatenate([np.arange(len(keys)), owner]), np.concatenate([np.zeros(len(keys), np.int64), tf])
    within = np.arange(len(term)) - np.repeat(_runs(term), np.diff(np.append(_runs(term), len(term))))
    starts = np.flatnonzero(within % block == 0)
    n = np.diff(np.append(starts, len(term)))
    place_starts = np.concatenate([[0], np.cumsum(tf)])
    steps = _differences(place, post)
    best = [_competitive(tf[a : a + m], dls[owner[a : a + m]]) if m > 1 else ([int(tf[a])], [int(dls[owner[a]])]) for a, m in zip(starts, n)]
    column = lambda values, kind: pa.array(values, kind)
    return pa.record_batch(
        [
            column([names[by_name[t]] if t >= 0 else "" for t in term[starts]], pa.string()), column(np.full(len(starts), number), pa.int64()), column(within[starts] // block, pa.int32()), column(n, pa.int32()),
            column(keys[owner[starts]], pa.int64()), column(keys[owner[starts + n - 1]], pa.int64()),
            _lists(_differences(keys[owner], starts), starts, pa.int64()), _lists(tf, starts, pa.int32()), _lists(dls[owner], starts, pa.int32()),
            column([b[0] for b in best], pa.list_(pa.int32())), column([b[1] for b in best], pa.list_(pa.int32())), column(np.minimum.reduceat(tf, starts), pa.int32()), column(np.maximum.reduceat(dls[owner], starts), pa.int32()),
            _lists(steps, place_starts[starts], pa.int32()),
        ],
        ["term", "segment", "block", "n", "first", "last", "keys", "tfs", "dls", "best_tf", "best_dl", "least_tf", "most_dl", "positions"],
    )


def _segments(batches: Iterator[pa.RecordBatch], part: int, block: int, most: int) -> Iterator[pa.RecordBatch]:
    """The segments of a task; each ends with the document that fills it, and nothing of it is held on to."""
    made, keys, tokens, size = 0, [], [], 0
    for b in batches:
        for k, ts in zip(b.column("k").to_pylist(), b.column("ts")):
            keys.append(k)
            tokens.append(ts.values)
            size += len(ts.values) + 1
            if size >= most:
                yield _segment((part << 32) + made, np.array(keys), tokens, block)
                made, keys, tokens, size = made + 1, [], [], 0
    if keys:
        yield _segment((part << 32) + made, np.array(keys), tokens, block)


def build(docs: DataFrame, key: str, column: str, root: str, parts: int = 16, block: int = BLOCK, segment_tokens: int = SEGMENT_TOKENS) -> dict:
    """Writes an index below a folder and points to it; gives the pointer. An older index stays readable until then."""
    if not isinstance(docs.schema[key].dataType, IntegralType):
        raise TypeError(f"{key} must be an integer")
    spark = docs.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _segments(batches, TaskContext.get().partitionId(), block, segment_tokens)

    folder = uuid.uuid4().hex
    taken = docs.filter(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("k"), text.tokens(column).alias("ts"))
    rows = taken.mapInArrow(run, _DDL)
    # by hash, for ranges would be found by taking all texts apart once more; a common term's segments go to all files
    with setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH)):
        rows.repartition(parts, "term", "segment").sortWithinPartitions("term", "segment", "block").write.option("parquet.block.size", ROW_GROUP).parquet(f"{root}/{folder}")
    held = spark.read.parquet(f"{root}/{folder}").filter("term = ''").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.aggregate("dls", F.lit(0).cast("long"), lambda s, x: s + x)), F.lit(0)).alias("tokens")).first()
    pointer = {"folder": folder, "n": held["n"], "tokens": held["tokens"]}
    Store(spark, root).put(POINTER, json.dumps(pointer).encode())
    return pointer


class Index:
    """A kept index below a folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        self.pointer = json.loads(Store(spark, root).read(POINTER))

    def rows(self, terms: list[str], *columns: str) -> DataFrame:
        """Blocks of these terms; each is a comparison that reaches the scan, so only row groups that may hold it are read (of over MANY terms, their range)."""
        named = list(dict.fromkeys(terms))
        wanted = F.lit(False) if len(named) <= MANY else F.col("term").isin(named)
        for t in named if len(named) <= MANY else []:
            wanted = wanted | (F.col("term") == t)
        return self.spark.read.parquet(f"{self.root}/{self.pointer['folder']}").filter(wanted).select(*columns)

    def _by_segment(self, rows: DataFrame) -> DataFrame:
        return rows.repartition("segment").sortWithinPartitions("segment", "term", "block")

    def top(self, terms: list[str], k: int, digits: int = 9, told: bool = False) -> DataFrame:
        """key, score of the k best documents; scores are rounded to so many digits before they are ordered. told: also blocks held and decoded by the segment."""
        n, tokens = self.pointer["n"], self.pointer["tokens"]
        average = tokens / n if tokens else 1.0
        weight = lambda tf, dl: tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / average))
        stats = self.rows(terms, "term", "n", "least_tf", "most_dl").groupBy("term").agg(
            F.sum("n").alias("df"), F.max(F.when(F.col("n") >= k, weight(F.col("least_tf").cast("double"), F.col("most_dl")))).alias("sure")
        )
        found = stats.collect()  # one row a term of the question
        idf = {r["term"]: float(np.log1p((n - r["df"] + 0.5) / (r["df"] + 0.5))) for r in found}
        # a block of k documents or more, each of at least this score
        sure = max((idf[r["term"]] * r["sure"] for r in found if r["sure"] is not None), default=0.0)
        rows = self._by_segment(self.rows(list(idf), "segment", "term", "block", "first", "last", "keys", "tfs", "dls", "best_tf", "best_dl"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for segment in _by(batches, "segment"):
                keys, scores, decoded = _best(segment, idf, weight, k, sure, digits)
                yield pa.record_batch([pa.array(keys, pa.int64()), pa.array(scores, pa.float64()), pa.array([segment.num_rows] * len(keys), pa.int64()), pa.array([decoded] * len(keys), pa.int64())], ["key", "score", "held", "decoded"])

        best = rows.mapInArrow(run, "key long, score double, held long, decoded long")
        return (best if told else best.select("key", "score").orderBy(F.desc("score"), "key").limit(k)) if idf else best.select(*best.columns if told else ("key", "score")).limit(0)

    def all_of(self, terms: list[str]) -> DataFrame:
        """key of the documents that have every term."""
        wanted = list(dict.fromkeys(terms))
        rows = self._by_segment(self.rows(wanted, "segment", "term", "block", "keys"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for s in _by(batches, "segment"):
                by = {t: _keys(own) for t, own in _terms(s)}
                if len(by) == len(wanted):
                    keys = sorted(by.values(), key=len)
                    for other in keys[1:]:
                        keys[0] = np.intersect1d(keys[0], other, assume_unique=True)
                    yield pa.record_batch([pa.array(keys[0])], ["key"])

        return rows.mapInArrow(run, "key long")

    def phrase(self, terms: list[str]) -> DataFrame:
        """key, hits: documents in which the terms stand one after another, and how often."""
        return self.phrases([(0, terms)]).select("key", "hits")

    def phrases(self, asked: list[tuple[int, list[str]]]) -> DataFrame:
        """q, key, hits of a batch of numbered phrases in one pass. Positions of blocks without a phrase's rarest term are not decoded."""
        rows = self._by_segment(self.rows([t for _, ts in asked for t in ts], "segment", "term", "block", "first", "last", "keys", "tfs", "positions"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for s in _by(batches, "segment"):
                by = dict(_terms(s))
                for q, terms in asked:
                    if terms and all(t in by for t in terms):
                        keys, hits = _phrase(by, terms)
                        if len(keys):
                            yield pa.record_batch([pa.array([q] * len(keys), pa.int64()), pa.array(keys), pa.array(hits)], ["q", "key", "hits"])

        return rows.mapInArrow(run, "q long, key long, hits long")

    def prefix(self, start: str) -> DataFrame:
        """key of the documents that have a term with this beginning."""
        rows = self.spark.read.parquet(f"{self.root}/{self.pointer['folder']}").filter(F.col("term").startswith(start) & (F.col("term") != "")).select("segment", "term", "block", "keys")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for s in _by(batches, "segment"):
                yield pa.record_batch([pa.array(np.unique(_keys(s)))], ["key"])

        return self._by_segment(rows).mapInArrow(run, "key long")


_LOW = (1 << 32) - 1


def _by(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """The rows of each value of a column that they are sorted by."""
    held: list[pa.RecordBatch] = []
    now = None
    for b in batches:
        if not b.num_rows:
            continue
        values = b.column(column).to_numpy(zero_copy_only=False)
        starts = _runs(values)
        for a, e in zip(starts, np.append(starts[1:], len(values))):
            if held and values[a] != now:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = []
            now = values[a]
            held.append(b.slice(a, e - a))
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _terms(segment: pa.RecordBatch) -> Iterator[tuple[str, pa.RecordBatch]]:
    names = segment.column("term").to_pylist()
    starts = [i for i in range(len(names)) if i == 0 or names[i] != names[i - 1]]
    for a, e in zip(starts, [*starts[1:], len(names)]):
        yield names[a], segment.slice(a, e - a)


def _flat(b: pa.RecordBatch, column: str) -> tuple[np.ndarray, np.ndarray]:
    """All values of a list column, and where each row's begin."""
    lists = b.column(column)
    sizes = pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    return lists.flatten().to_numpy(zero_copy_only=False), np.cumsum(sizes) - sizes


def _keys(b: pa.RecordBatch) -> np.ndarray:
    values, starts = _flat(b, "keys")
    return _restored(values, starts) if len(values) else values.astype(np.int64)


def _places(b: pa.RecordBatch, owners: np.ndarray) -> np.ndarray:
    """The document's number among owners and the place of every token, as one sorted integer."""
    if not b.num_rows:
        return np.zeros(0, np.int64)
    tf = _flat(b, "tfs")[0].astype(np.int64)
    steps = _flat(b, "positions")[0].astype(np.int64)
    at = _restored(steps, np.cumsum(tf) - tf)
    return (np.repeat(np.searchsorted(owners, _keys(b)), tf) << 32) + at


def _overlaps(b: pa.RecordBatch, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Which blocks share a span of keys with any of these, sorted and disjoint."""
    i = np.searchsorted(last, b.column("first").to_numpy(), side="left")
    return (i < len(first)) & (first[np.minimum(i, len(first) - 1)] <= b.column("last").to_numpy())


def _phrase(by: dict[str, pa.RecordBatch], terms: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of a segment's documents that have the phrase, and how often."""
    rare = min((by[t] for t in set(terms)), key=lambda b: pa.compute.sum(pa.compute.list_value_length(b.column("keys"))).as_py())
    first, last = (rare.column(c).to_numpy() for c in ("first", "last"))
    kept = {t: by[t].filter(pa.array(_overlaps(by[t], first, last))) for t in set(terms)}
    owners = np.unique(np.concatenate([_keys(b) for b in kept.values()]))
    at = None
    for i, t in enumerate(terms):
        here = _places(kept[t], owners)
        here = here[(here & _LOW) >= i] - i
        at = here if at is None else np.intersect1d(at, here, assume_unique=True)
        if not len(at):
            break
    owner = at >> 32
    starts = _runs(owner)
    return owners[owner[starts]], np.diff(np.append(starts, len(owner)))


FEW = 1024  # documents of a term in a segment that are decoded first


def _best(segment: pa.RecordBatch, idf: dict[str, float], weight, k: int, sure: float, digits: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The k best of a segment that reach ``sure``, and how many blocks were decoded for them.

    A term of few documents is decoded at once, for its blocks span most keys: each of its documents is a span of its own.
    """
    scale = np.array([idf[t] for t in segment.column("term").to_pylist()])
    decoded: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def opened(i: int) -> tuple[np.ndarray, np.ndarray]:
        """Keys and weights of a block."""
        if i not in decoded:
            one = segment.slice(i, 1)
            decoded[i] = (_keys(one), scale[i] * weight(_flat(one, "tfs")[0].astype(np.float64), _flat(one, "dls")[0]))
        return decoded[i]

    n = pa.compute.list_value_length(segment.column("keys")).to_numpy(zero_copy_only=False)
    blocks = _runs(np.array(segment.column("term").dictionary_encode().indices))
    few = np.repeat(np.add.reduceat(n, blocks) <= FEW, np.diff(np.append(blocks, len(n))))
    pairs, starts = _flat(segment, "best_tf")
    bound = scale * np.maximum.reduceat(weight(pairs.astype(np.float64), _flat(segment, "best_dl")[0]), starts)
    known = [opened(i) for i in np.flatnonzero(few)]
    single, singles = (np.concatenate([np.zeros(0, t), *(d[j] for d in known)]) for j, t in ((0, np.int64), (1, np.float64)))
    many = np.flatnonzero(~few)
    first, last = (np.concatenate([segment.column(c).to_numpy()[many], single]) for c in ("first", "last"))
    bound = np.concatenate([bound[many], singles])
    borders = np.unique(np.concatenate([first, last + 1]))
    a, e = np.searchsorted(borders, first), np.searchsorted(borders, last + 1)
    reach = np.zeros(len(borders) + 1)
    np.add.at(reach, a, bound)
    np.add.at(reach, e, -bound)
    reach = np.cumsum(reach)[: len(borders)]  # of the keys from each border up to the next
    order = np.argsort(-reach, kind="stable")
    slack = 1e-9 + 0.6 * 10.0**-digits  # sums of weights and rounded scores may differ by so much
    keys, scores = np.zeros(0, np.int64), np.zeros(0)
    at, step = 0, 8
    while at < len(order) and reach[order[at]] >= sure - slack and reach[order[at]] > slack:
        spans = order[at : at + step]
        looked = np.zeros(len(borders), bool)
        looked[spans[reach[spans] >= sure - slack]] = True
        at, step = at + step, step * 2
        total = np.concatenate([[0], np.cumsum(looked)])
        hit = np.flatnonzero(total[e] > total[a])
        alone = hit[hit >= len(many)] - len(many)
        own, weights = [single[alone]], [singles[alone]]
        for i in many[hit[hit < len(many)]]:
            ks, ws = opened(i)
            inside = looked[np.searchsorted(borders, ks, side="right") - 1]
            own.append(ks[inside])
            weights.append(ws[inside])
        found, code = np.unique(np.concatenate(own), return_inverse=True)
        keys, scores = np.concatenate([keys, found]), np.concatenate([scores, np.bincount(code, np.concatenate(weights), len(found))])
        kept = np.lexsort((keys, -np.round(scores, digits)))[:k]
        keys, scores = keys[kept], scores[kept]
        if len(keys) == k:
            sure = max(sure, float(np.round(scores[-1], digits)))
    return keys, np.round(scores, digits), len(decoded)
