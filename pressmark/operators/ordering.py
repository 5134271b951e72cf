"""Work in a global order without a task that holds it all: sorted ranges, places, digests of sorted lists, bins filled one after another.

Rows are sorted over ranges once and written to the shared folder, so that a range's number and its order stay
the same in every later pass. What the driver learns is a few numbers for each range.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pressmark.session import checkpointed

_WITHIN = (1 << 33) - 1  # the low bits of monotonically_increasing_id: a row's place in its partition


def sorted_ranges(rows: DataFrame, order: list[Column | str]) -> DataFrame:
    """Rows in order within partitions, and partitions in order."""
    return checkpointed(rows.repartitionByRange(*order).sortWithinPartitions(*order))


def numbered(rows: DataFrame, order: list[Column | str], name: str = "place", by: str | None = None) -> DataFrame:
    """Rows with their place from 0 in a total order; with ``by``, the first of the order's columns, from 0 within each of its values."""
    parts = sorted_ranges(rows, order)
    at = F.monotonically_increasing_id()
    part, within = F.shiftright(at, 33).cast("int"), at.bitwiseAND(F.lit(_WITHIN))
    placed = parts.select("*", part.alias("_part"), within.alias("_within"))
    sizes = {r["_part"]: r["n"] for r in placed.groupBy("_part").agg(F.count("*").alias("n")).collect()}  # one row a range
    before, total = [], 0
    for k in range(max(sizes, default=-1) + 1):
        before.append(total)
        total += sizes.get(k, 0)
    global_ = F.get(F.array(*map(F.lit, before or [0])), F.col("_part")) + F.col("_within")
    out = placed.withColumn(name, global_).drop("_part", "_within")
    if by is None:
        return out
    firsts = out.groupBy(F.struct(by).alias("_k")).agg(F.min(name).alias("_first"))  # a struct, so that a null meets a null
    return out.withColumn("_k", F.struct(by)).join(firsts, "_k").withColumn(name, F.col(name) - F.col("_first")).drop("_k", "_first")


def list_digests(rows: DataFrame, by: str, value: str, separator: str = ",", piece: int = 4096) -> DataFrame:
    """by, n, digest: the SHA-256 of each group's values, sorted and joined.

    A hash of a list is a chain, so a group's bytes pass one task; they come in pieces of ``piece`` values that were
    sorted and joined over all ranges, and only one piece is held at a time.
    """
    kind = rows.schema[by].dataType.simpleString()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k, key, held = TaskContext.get().partitionId(), 0, None, []

        def out() -> pa.RecordBatch:
            return pa.record_batch([pa.array([key], keys), pa.array([part]), pa.array([k]), pa.array([len(held)]), pa.array([separator.join(held)])], [by, "part", "k", "n", "text"])

        for b in batches:
            keys = b.column(by).type
            for here, v in zip(b.column(by).to_pylist(), b.column(value).to_pylist()):
                if held and (here != key or len(held) == piece):
                    yield out()
                    held, k = [], k + 1
                key = here
                held.append(v)
        if held:
            yield out()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, n, chain = None, 0, None
        for b in batches:
            done = []
            keys = b.column(by).type
            for here, more, text in zip(b.column(by).to_pylist(), b.column("n").to_pylist(), b.column("text").to_pylist()):
                if chain is None or here != key:
                    if chain is not None:
                        done.append((key, n, chain.hexdigest()))
                    key, n, chain = here, 0, hashlib.sha256()
                else:
                    chain.update(separator.encode())
                chain.update(text.encode())
                n += more
            if done:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*done), (keys, pa.int64(), pa.string()))], [by, "n", "digest"])
        if chain is not None:
            yield pa.record_batch([pa.array([key], keys), pa.array([n]), pa.array([chain.hexdigest()])], [by, "n", "digest"])

    kept = rows.select(by, F.col(value).cast("string").alias(value)).filter(F.col(value).isNotNull())
    made = sorted_ranges(kept, [by, value]).mapInArrow(pieces, f"{by} {kind}, part long, k long, n long, text string")
    return made.repartition(by).sortWithinPartitions(by, "part", "k").mapInArrow(hashed, f"{by} {kind}, n long, digest string")


# -- bins filled one after another

MILLION = 1_000_000


@dataclass(frozen=True)
class _Borders:
    """What the ranges have to know of each other: a few numbers for each."""

    before: dict[int, int]  # range -> total of its first segment in earlier ranges, where that began earlier
    later: dict[int, int]  # range -> its place in ``parts``, where its last segment goes on in the next of these
    parts: list[int]
    ends: list[int]  # the segment's total at the end of each of ``parts``
    until: list[int]  # the place after the last range of the segment

    def following(self, part: int, asked: np.ndarray, least: np.ndarray) -> list[int | None]:
        """The range in which the total asked for is passed, none if the segment ends before; the next range where ``least`` says so."""
        i = self.later[part]
        ends = np.array(self.ends[i + 1 : self.until[i]], np.int64)
        at = np.where(least, 0, np.searchsorted(ends, asked, side="right"))
        return [self.parts[i + 1 + k] if k < len(ends) else None for k in at.tolist()]


def _borders(told: list[tuple]) -> _Borders:
    """From (range, 0 or the number of its last segment, segment, total) of every range's first and last segment."""
    before, later = {}, {}
    parts, ends, chains = [], [], []
    previous: tuple | None = None  # (range, its place, segment, total so far)
    for part, k, name, total in sorted(told, key=lambda r: r[:2]):
        if k == 0 and previous is not None and previous[2] == name:
            before[part] = previous[3]
            later[previous[0]] = previous[1]
            total += previous[3]
            chain = chains[-1]
        else:
            chain = len(parts)
        parts.append(part)
        ends.append(total)
        chains.append(chain)
        previous = (part, len(parts) - 1, name, total)
    last = {c: i + 1 for i, c in enumerate(chains)}
    return _Borders(before, later, parts, ends, [last[c] for c in chains])


def bins(rows: DataFrame, segment: str, order: list[Column | str], size: str, target: float) -> DataFrame:
    """Rows with ``bin``, ascending in the order over all segments: each segment's rows, in order, fill bins of ``target``.

    A bin is closed where the next row would take it over the target; it takes one row at least. Sizes count in
    millionths; null and negative ones count as zero. The order within a segment must be total.

    The bin after the one that starts at row i starts at the first row j > i whose running total is over the total before
    i and the target: a pointer, found by search in prefix sums. Each range follows the pointers from every row at which
    a bin of an earlier range may come in (those of its first ``target``) to the one that leads out. What is left is a
    list of such entries over all ranges, far shorter than the rows; doubling its pointers over shuffles marks
    those that are reached from a segment's head. Then every range knows its one entry and names its bins.
    """
    most = round(target * MILLION)
    micro = F.greatest(F.round(F.coalesce(F.col(size), F.lit(0)) * MILLION).cast("long"), F.lit(0).cast("long"))
    parts = sorted_ranges(rows.select("*", F.col(segment).alias("_segment"), micro.alias("_size")), ["_segment", *order])
    sized = parts.select("_segment", "_size")

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _segments(batches)
        if found:
            edge = sorted({0, len(found) - 1})
            names = [None if found[k][0] is None else str(found[k][0]) for k in edge]
            yield pa.record_batch([pa.array([TaskContext.get().partitionId()] * len(edge)), pa.array(edge), pa.array(names, pa.string()), pa.array([int(found[k][1].sum()) for k in edge])], ["part", "k", "segment", "total"])

    borders = _borders([tuple(r) for r in sized.mapInArrow(told, "part long, k long, segment string, total long").collect()])  # two rows a range

    def pointers(sizes: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Running totals before and with each row, and where the bin after one that starts there starts (their number: not here)."""
        sums = start + np.cumsum(sizes)
        prior = sums - sizes
        return prior, sums, np.maximum(np.searchsorted(sums, prior + most, side="right"), np.arange(1, len(sizes) + 1))

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """id (null: the head of a segment), part and its total ``high`` of every row at which a bin may come in; ``to`` and ``asked``: the range and total it leads to."""
        part = TaskContext.get().partitionId()
        found = _segments(batches)
        for k, (_, sizes) in enumerate(found):
            comes, goes = k == 0 and part in borders.before, k == len(found) - 1 and part in borders.later
            if not comes and not goes:
                continue
            prior, sums, after = pointers(sizes, borders.before[part] if comes else 0)
            at = np.union1d([0], np.flatnonzero((prior <= prior[0] + most) & (sums > prior))) if comes else np.zeros(1, np.int64)
            high, ids = sums[at], (part << 33) + at
            while (inside := after[at] < len(sizes)).any():
                at = np.where(inside, after[at], at)
            asked = prior[at] + most
            to = borders.following(part, asked, asked < sums[-1]) if goes else [None] * len(at)
            n = len(at)
            yield pa.record_batch(
                [pa.array(ids if comes else [None] * n, pa.int64()), pa.array([part] * n, pa.int32()), pa.array(high), pa.array(to, pa.int32()), pa.array(asked)],
                ["id", "part", "high", "to", "asked"],
            )

    marks = {r["id"] >> 33: r["id"] & _WITHIN for r in _reached(sized.mapInArrow(entries, "id long, part int, high long, to int, asked long")).collect()}  # one row a range at most

    def starts(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        """Which rows of the range start a bin."""
        part, out = TaskContext.get().partitionId(), [np.zeros(0, bool)]
        for k, (_, sizes) in enumerate(_segments(batches)):
            first = np.zeros(len(sizes), bool)
            comes = k == 0 and part in borders.before
            at = marks.get(part, len(sizes)) if comes else 0
            after = pointers(sizes, borders.before[part] if comes else 0)[2]
            while at < len(sizes):
                first[at] = True
                at = int(after[at])
            out.append(first)
        return np.concatenate(out)

    def last_start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = np.flatnonzero(starts(batches))
        if len(at):
            yield pa.record_batch([pa.array([(TaskContext.get().partitionId() << 33) + int(at[-1])])], ["id"])

    opened = sorted(r["id"] for r in sized.mapInArrow(last_start, "id long").collect())  # one row a range at most
    names = rows.columns

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        base = TaskContext.get().partitionId() << 33
        first = starts(iter(held))
        latest = np.maximum.accumulate(np.where(first, base + np.arange(len(first)), -1))
        k = bisect_left(opened, base)
        number = np.where(latest < 0, opened[k - 1] if k else -1, latest)
        at = 0
        for b in held:
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], pa.array(number[at : at + b.num_rows])], [*names, "bin"])
            at += b.num_rows

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return parts.mapInArrow(named, f"{ddl}, bin long")


def _segments(batches: Iterator[pa.RecordBatch]) -> list[tuple[object, np.ndarray]]:
    """(segment, sizes) of a range's segments in order."""
    out: list[tuple[object, list[np.ndarray]]] = []
    for b in batches:
        if not b.num_rows:
            continue
        names, sizes = b.column("_segment").to_pylist(), b.column("_size").to_numpy(zero_copy_only=False)
        borders = [0, *(i for i in range(1, len(names)) if names[i] != names[i - 1]), len(names)]
        for a, e in zip(borders, borders[1:]):
            if not out or out[-1][0] != names[a]:
                out.append((names[a], []))
            out[-1][1].append(sizes[a:e])
    return [(name, np.concatenate(v)) for name, v in out]


def _reached(entries: DataFrame) -> DataFrame:
    """id of every entry that the list from a segment's head reaches: its pointers are doubled until nothing new is marked.

    An entry leads to the first one of range ``to`` whose total is over ``asked``.
    """
    all_ = checkpointed(entries)
    asked = all_.filter("to is not null").select(F.col("to").alias("part"), F.col("asked").alias("v"), F.lit(None).cast("long").alias("met")).distinct()
    offered = all_.filter("id is not null").select("part", F.col("high").alias("v"), F.col("id").alias("met"))
    w = Window.partitionBy("part").orderBy(F.desc("v"), F.col("met").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = asked.unionByName(offered).withColumn("next", F.last("met", ignorenulls=True).over(w)).filter("met is null").select(F.col("part").alias("to"), F.col("v").alias("asked"), "next")
    linked = checkpointed(all_.join(found, ["to", "asked"]).select("id", "next"))
    marked, jumps, n = checkpointed(linked.filter("id is null").select(F.col("next").alias("id")).distinct()), linked.filter("id is not null"), -1
    while (now := marked.count()) != n:
        n = now
        marked = checkpointed(marked.union(marked.join(jumps, "id").select(F.col("next").alias("id"))).distinct())
        onward = jumps.select(F.col("id").alias("next"), F.col("next").alias("after"))
        jumps = checkpointed(jumps.join(onward, "next").select("id", F.col("after").alias("next")))
    return marked
