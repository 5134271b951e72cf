"""SimHash near-duplicates by covering locality-sensitive hashing.

A text's fingerprint has a bit set where more than half of its shingles' hashes have it.
Every bit position i gets a vector m(i) of radius + 1 bits, not all zero. For each non-zero
vector v the mask of table v holds the positions whose m(i) has an odd product with v. The
m(i) of at most ``radius`` positions leave some v orthogonal to all of them, whose mask
touches none of these positions: so two fingerprints that differ in at most ``radius`` bits
agree under that mask and meet in table v. No pair is missed; each one found is compared.

A bucket of more than ``LIMIT`` fingerprints is covered once more, by the same masks over
the positions that its own mask leaves out. Of 64 positions the two masks fix all but 15 or
16, so no bucket of the second round holds more than 65,536 fingerprints, whatever the
input. Buckets give stars of linked fingerprints, never all their pairs.

Defined cases: a null text is empty; a text without a word has the fingerprint zero and is
linked like any other; one with fewer words than a shingle is one shingle; rows with the same
or no id are rows of their own; a component's id is its smallest id that is not null, null if
there is none; an empty table gives no rows; other columns are passed over.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressmark.llm.components import _roots, connected
from pressmark.llm.shared import checkpointed, looked_up

BITS = 64
RADIUS = 4
WORDS = 4
SEED = 42
LIMIT = 2048  # fingerprints of a bucket that are compared without a second round
_CHUNK = 1 << 16  # hashes that are spread into bits at a time
_BLOCK = 64  # rows of a bucket compared with all others at a time


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """The SimHash of a UTF-8 text; bytes split and lower() know ASCII's white space and letters alone."""
    found = text.lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    if len(found) <= words:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        starts = [0, *accumulate(len(w) + 1 for w in found)]
        hashes = [xxhash.xxh64_intdigest(joined[a : b - 1], SEED) for a, b in zip(starts, starts[words:])]
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), _CHUNK):
        part = np.array(hashes[i : i + _CHUNK], "<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def masks(radius: int, positions: list[int]) -> list[int]:
    """The masks of the 2 ** (radius + 1) - 1 tables over these bit positions, as signed 64-bit integers."""
    tables = 2 ** (radius + 1) - 1
    out = []
    for v in range(1, tables + 1):
        m = sum(1 << p for i, p in enumerate(positions) if ((i % tables + 1) & v).bit_count() % 2)
        out.append(m - (1 << 64) if m >> 63 else m)
    return out


def _second(radius: int) -> list[list[int]]:
    """For each table of the first round, the masks of its second: its own mask and a covering of what that leaves out."""
    return [[m | s for s in masks(radius, [p for p in range(BITS) if not m >> p & 1])] for m in masks(radius, list(range(BITS)))]


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The number of bits in which signed 64-bit integers differ (bitwise_count takes the magnitude of a negative one)."""
    return np.bitwise_count(np.bitwise_xor(a, b).view(np.uint64))


def _linked(values: np.ndarray, radius: int) -> np.ndarray:
    """For distinct fingerprints, sorted, the place of the least one of each one's component under links within the radius."""
    n = len(values)
    root = np.arange(n)
    for i in range(0, n, _BLOCK):
        a, b = np.nonzero(_apart(values[i : i + _BLOCK, None], values[None, i:]) <= radius)
        if len(a) > min(n - i, _BLOCK):  # more than each with itself
            root = _roots(np.concatenate([a + i, np.arange(n)]), np.concatenate([b + i, root]), n)
    return root


def _meet(radius: int, limit: int | None):
    """Over rows (t, key, x) sorted by (t, key): stars (a, b) of each bucket, t null; members (x, x) of a bucket over the limit, with its t."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size, over, last = 0, False, None

        def out(a: np.ndarray, b: np.ndarray, t: int | None) -> pa.RecordBatch:
            return pa.record_batch([pa.array(a), pa.array(b), pa.array([t] * len(a), pa.int32())], ["a", "b", "t"])

        def closed() -> Iterator[pa.RecordBatch]:
            if over or size < 2:
                return
            values = np.sort(np.concatenate(held))
            root = _linked(values, radius)
            moved = np.flatnonzero(root != np.arange(len(root)))
            if len(moved):
                yield out(values[moved], values[root[moved]], None)

        for batch in batches:
            if not batch.num_rows:
                continue
            t, key, x = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("t", "key", "x"))
            starts = np.flatnonzero(np.concatenate([[True], (t[1:] != t[:-1]) | (key[1:] != key[:-1])]))
            ends = np.append(starts[1:], len(t))
            # buckets of two that lie whole within the batch, at once
            inner = (ends - starts == 2) & (starts > 0) & (ends < len(t))
            two = starts[inner]
            two = two[_apart(x[two], x[two + 1]) <= radius]
            if len(two):
                yield out(np.maximum(x[two], x[two + 1]), np.minimum(x[two], x[two + 1]), None)
            alone = (ends - starts == 1) & (starts > 0) & (ends < len(t))
            for s, e in zip(starts[~(inner | alone)], ends[~(inner | alone)]):
                here = (t[s], key[s])
                if here != last:
                    yield from closed()
                    held, size, over, last = [], 0, False, here
                held.append(x[s:e])
                size += e - s
                if limit is not None and size > limit:
                    over = True
                if over:
                    members = np.concatenate(held)
                    yield out(members, members, int(here[0]))
                    held = []
        yield from closed()

    return run


def links(values: DataFrame, radius: int = RADIUS, limit: int = LIMIT) -> DataFrame:
    """Edges (a, b) that join every two of the distinct fingerprints x within the radius, directly or by others so linked."""
    first = values.select("x", F.posexplode(F.array(*[F.lit(m) for m in masks(radius, list(range(BITS)))])).alias("t", "m"))

    def met(dealt: DataFrame, most: int | None) -> DataFrame:
        keyed = dealt.select("t", F.col("x").bitwiseAND(F.col("m")).alias("key"), "x")
        return checkpointed(keyed.repartition("t", "key").sortWithinPartitions("t", "key").mapInArrow(_meet(radius, most), "a long, b long, t int"))

    found = met(first, limit)
    edges = found.filter("t is null").select("a", "b")
    large = found.filter("t is not null")
    if large.isEmpty():
        return edges
    wider = F.array(*[F.array(*[F.lit(m) for m in row]) for row in _second(radius)])
    second = large.select(F.col("a").alias("x"), F.col("t").alias("t1"), F.posexplode(F.element_at(wider, F.col("t") + 1)).alias("t2", "m"))
    tables = 2 ** (radius + 1) - 1
    return edges.union(met(second.select("x", "m", (F.col("t1") * tables + F.col("t2")).alias("t")), None).select("a", "b"))


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id and its text's fingerprint x as a signed 64-bit integer, one row per row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = np.fromiter((fingerprint(t.as_py() or b"", words) for t in b.column("text")), np.uint64, b.num_rows)
            yield pa.record_batch([b.column("doc_id"), pa.array(made.view(np.int64))], ["doc_id", "x"])

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, f"doc_id {kind}, x long")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, words: int = WORDS, limit: int = LIMIT) -> DataFrame:
    """Per row of docs: doc_id, fingerprint as 16 hex digits, and component_id, the smallest id of its component."""
    rows = checkpointed(fingerprints(docs, words))
    classes = checkpointed(rows.groupBy("x").agg(F.min("doc_id").alias("least")))
    stars = connected(links(classes.select("x"), radius, limit))
    rooted = classes.join(stars.withColumnRenamed("v", "x"), "x", "left").withColumn("root", F.coalesce("root", "x"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    components = looked_up(rooted.select("x", "root"), named, "root").select("x", "component_id")
    return looked_up(rows, components, "x").select("doc_id", F.lower(F.lpad(F.hex("x"), 16, "0")).alias("fingerprint"), "component_id")


def op12_covering_simhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
