"""Connected components by alternating large and small stars.

Rounds of stars over shuffles go on until no edge changes; as soon as at most ``SMALL``
edges are left, one task ends the work in place of further rounds. Both give the same rows.

Defined cases: no edges, no rows; loops (v, v) and edges with a null end are left out;
repeated edges count once; vertices may be of any kind that Spark orders.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressmark.llm.shared import checkpointed

SMALL = 1 << 20  # edges that one task takes: two vertices of some 20 bytes each


def _roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least vertex of each component of 0..n-1, by hooking roots and halving paths over all edges at once."""
    root = np.arange(n)
    while True:
        x, y = root[a], root[b]
        open_ = x != y
        if not open_.any():
            return root
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(v, root) for every vertex but the roots of the edges of a partition."""
    own = [b for b in batches if b.num_rows]
    if not own:
        return
    table = pa.Table.from_batches(own)
    ends = pa.chunked_array(table.column("v").chunks + table.column("root").chunks).combine_chunks()
    if isinstance(ends, pa.ChunkedArray):
        ends = pa.concat_arrays(ends.chunks)
    values = pc.unique(ends)
    values = values.take(pc.sort_indices(values))
    code = pc.index_in(ends, values).to_numpy(zero_copy_only=False).astype(np.int64)
    root = _roots(code[: table.num_rows], code[table.num_rows :], len(values))
    moved = np.flatnonzero(root != np.arange(len(root)))
    for i in range(0, len(moved), 1 << 16):
        at = moved[i : i + (1 << 16)]
        yield pa.record_batch([values.take(pa.array(at)), values.take(pa.array(root[at]))], ["v", "root"])


def connected(edges: DataFrame, small: int = SMALL) -> DataFrame:
    """v, root (the least vertex of its component) for every vertex of edges (a, b) but the roots.

    A large star hangs each vertex's larger neighbours on its least one, a small star its
    smaller ones; the number of rounds grows with the logarithm of a component's width.
    Every join is of all edges with one row for each vertex, so a vertex with very many
    edges can be split.
    """
    ends = edges.filter("a != b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("root"))
    kind = f"v {ends.schema['v'].dataType.simpleString()}, root {ends.schema['root'].dataType.simpleString()}"
    pairs, before = checkpointed(ends.distinct()), None
    while True:
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("v", "root").cast("decimal(38,0)"))).first()
        if now[0] <= small:
            stars = pairs.coalesce(1).mapInArrow(_stars, kind)
            break
        if now == before:
            stars = pairs.filter("v != root")
            break
        before = now
        both = pairs.union(pairs.select(F.col("root").alias("v"), F.col("v").alias("root")))
        # grouped by a struct, so that the joins deal both sides anew and may split a vertex
        least = both.groupBy(F.struct("v").alias("k")).agg(F.min("root").alias("m")).select("k.v", F.least("k.v", "m").alias("m"))
        large = both.filter(F.col("root") > F.col("v")).join(least, "v").select(F.col("root").alias("v"), F.col("m").alias("root")).distinct()
        low = large.groupBy(F.struct("v").alias("k")).agg(F.min("root").alias("m")).select("k.v", "m")
        joined = large.join(low, "v")
        step = joined.filter(F.col("root") != F.col("m")).select(F.col("root").alias("v"), F.col("m").alias("root")).union(low.select("v", F.col("m").alias("root")))
        pairs = checkpointed(step.distinct())
    return checkpointed(stars)
