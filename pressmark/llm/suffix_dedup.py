"""Suffix-array dedup: removes every byte covered by a string of ``WINDOW`` bytes that starts twice or more in the corpus.

1. Anchors. Every window of a text has one anchor: the place in it where a gram of
   ``GRAM`` bytes has the least hash (the first of equals). Equal windows have equal
   anchors at the same place, so windows need comparing only where their anchors' grams
   are equal. The stretch of windows with one anchor is a context.
2. Only grams that occur twice or more in the corpus matter. Their contexts are counted
   (equal ones become one row with its count, on the map side first) and one of each is
   cut from its text.
3. Contexts go to shards by gram, so all windows that could be equal meet in one task.
   A gram with very many different contexts is dealt finer, by how far a window lies from
   its anchor and by all bytes that such windows share. Equal pieces of such a gram are one row
   with its uses before they are shuffled, and one piece in a shard.
4. A shard holds about ``SHARD`` bytes. Its suffix array is built by Larsson-Sadakane
   refinement; Kasai's common prefixes show which windows are equal. Where the contexts
   of one gram reach over several shards, the windows of one are found in the suffix
   arrays of the others by binary search.
5. The repeated windows become runs of bytes of each text, and the rest is kept.

Texts are known by a 128-bit digest, so a group of copies is handled once; what is
counted are its rows.

Defined cases: a null text is empty; texts shorter than a window lose nothing; repeated
rows count as copies of each other (both lose what they share); cutting may part a
multi-byte character, so what is kept is bytes, and ``cleaned`` drops the broken ends.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressmark.llm import flat
from pressmark.llm.shared import checkpointed, unused
from pressmark.llm.suffix_array import PART, common_prefixes, search, spread, suffix_array, words8

WINDOW = 200
GRAM = 64
SLICE = 1 << 18
SHARD = 1 << 18
BLOCK = 1 << 20  # bytes of contexts that a task sorts at a time
HEAVY = 1000
HOT = 2048  # different contexts of a gram from which it is dealt finer
ROWS = 500  # texts cut at a time
FINE = 8  # window starts of one finer class
HELD = 1 << 23  # bytes of merged pieces and their uses that a task holds before it passes them on

_COUNT = WINDOW - GRAM + 1  # grams of a window


def anchors(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, ...]:
    """Per context: text number, gram hash, context hash, first window's start and anchor's place (within the text), number of windows."""
    n = len(data)
    none = (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    if n < WINDOW:
        return none
    with np.errstate(over="ignore"):
        prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(flat._MIX[data] * flat.powers(n), out=prefix[1:])
        inverse = flat.powers(n + 1, flat._INVERSE)
        grams = flat.mixed((prefix[GRAM:] - prefix[:-GRAM]) * inverse[: n - GRAM + 1])
        bits = np.uint64(max(20, int(n).bit_length()))
        low = (np.uint64(1) << bits) - np.uint64(1)
        least = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
        width = 1
        while 2 * width <= _COUNT:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < _COUNT:
            least = np.minimum(least[: len(least) - (_COUNT - width)], least[_COUNT - width :])
        at = (least & low).astype(np.int64)  # the anchor of the window that starts here
        text = np.repeat(np.arange(len(offs) - 1), np.diff(offs))[: len(at)]
        valid = np.flatnonzero(np.arange(len(at)) + WINDOW <= offs[1:][text])
        if not len(valid):
            return none
        p = at[valid]
        fresh = np.ones(len(valid), bool)
        fresh[1:] = (p[1:] != p[:-1]) | (valid[1:] != valid[:-1] + 1)
        first = np.flatnonzero(fresh)
        start, count = valid[first], np.diff(np.append(first, len(valid)))
        p = p[first]
        end = start + count - 1 + WINDOW
        context = (prefix[end] - prefix[start]) * inverse[start] + (p - start).astype(np.uint64) * np.uint64(0xA0761D6478BD642F) + count.astype(np.uint64) * np.uint64(0xE7037ED1A0B428DB)
        own = text[start]
        return own, grams[p], flat.mixed(context), start - offs[own], p - offs[own], count


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, _, data, offs in flat.slices(batch.column("text"), SLICE):
            grams, n = np.unique(anchors(data, offs)[1], return_counts=True)
            yield pa.record_batch([pa.array(grams.view(np.int64)), pa.array(n, pa.int64())], ["gram", "n"])


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, _, data, offs in flat.slices(batch.column("text"), SLICE):
            own, gram, context, start, anchor, count = anchors(data, offs)
            yield pa.record_batch(
                [batch.column("digest").take(pa.array(own + i)), pa.array(gram.view(np.int64)), pa.array(context.view(np.int64)), pa.array(start), pa.array(anchor - start), pa.array(count)],
                ["digest", "gram", "context", "start", "lead", "count"],
            )


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of each wanted context; those of a hot gram in finer classes.

    A common passage gives the same piece from every text: within a task equal pieces of a hot gram become one row, with the
    contexts that hold it, before anything is shuffled.
    """
    merged: dict[tuple[int, bytes], tuple[int, list[tuple]]] = {}
    held = 0
    for batch in batches:
        rows: list[tuple] = []
        size = 0
        for text, wanted in zip(batch.column("text"), batch.column("wanted")):
            raw = (text.as_py() or "").encode()
            for w in wanted.as_py():
                start, lead, count = w["start"], w["lead"], w["count"]
                if not w["hot"]:
                    rows.append((w["gram"], count, raw[start : start + count - 1 + WINDOW], [(w["gram"], w["context"], 0, w["n"])]))
                    size += count + WINDOW
                    continue
                # a window that starts k bytes before the anchor is in class k // FINE; its class shares WINDOW - FINE + 1 bytes or more
                a = 0
                while a < count:
                    k = (lead - a) // FINE
                    b = min(count, lead - k * FINE + 1)
                    share = raw[start + lead - k * FINE : start + lead - k * FINE + WINDOW - FINE + 1]
                    route = int(flat.span_hashes(np.frombuffer(share, np.uint8), np.array([0]), np.array([len(share)]))[0] ^ flat.mixed(np.array([k + 1], np.uint64))[0])
                    piece = raw[start + a : start + b - 1 + WINDOW]
                    key = (route - (1 << 64) if route >= 1 << 63 else route, piece)
                    if key not in merged:
                        merged[key] = (b - a, [])
                        held += len(piece)
                    merged[key][1].append((w["gram"], w["context"], a, w["n"]))
                    held += 32
                    a = b
            if size > SHARD:
                yield _cut_batch(rows)
                rows, size = [], 0
        if rows:
            yield _cut_batch(rows)
        if held > HELD:
            yield from _flushed(merged)
            merged, held = {}, 0
    yield from _flushed(merged)


def _flushed(merged: dict[tuple[int, bytes], tuple[int, list[tuple]]]) -> Iterator[pa.RecordBatch]:
    rows, size = [], 0
    for (route, piece), (count, uses) in merged.items():
        rows.append((route, count, piece, uses))
        size += len(piece) + 32 * len(uses)
        if size > SHARD:
            yield _cut_batch(rows)
            rows, size = [], 0
    if rows:
        yield _cut_batch(rows)


_USE = ("gram", "context", "first", "n")  # a context that holds a piece, from which of its windows on, and how often it occurs
_CUT = "route long, count long, bytes binary, uses array<struct<gram:bigint,context:bigint,first:bigint,n:bigint>>"


def _cut_batch(rows: list[tuple]) -> pa.RecordBatch:
    route, count, piece, uses = zip(*rows)
    every = np.array([u for us in uses for u in us], np.int64)
    offsets = np.cumsum([0, *map(len, uses)])
    structs = pa.StructArray.from_arrays([pa.array(every[:, k]) for k in range(4)], list(_USE))
    return pa.record_batch([pa.array(route, pa.int64()), pa.array(count, pa.int64()), pa.array(piece, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), structs)], ["route", "count", "bytes", "uses"])


def repeated_windows(pieces: list[bytes], counts: np.ndarray, times: np.ndarray, routes: np.ndarray, shard: int = SHARD) -> list[np.ndarray]:
    """For each piece, which of its first ``count`` windows start twice or more.

    pieces: different contexts in the order of their routes, each window of the corpus being one of
    exactly one of them; times: how often a piece occurs. Windows of different routes never match.
    """
    size = np.array([len(p) for p in pieces], np.int64)
    found: list[np.ndarray] = [np.zeros(c, bool) for c in counts]
    # a shard ends where a route ends, or in the middle of one that would double it
    parts: list[list[int]] = [[]]
    filled = 0
    for i, n in enumerate(size.tolist()):
        if filled >= 2 * shard or filled >= shard and routes[i] != routes[i - 1]:
            parts.append([])
            filled = 0
        parts[-1].append(i)
        filled += n
    built: list[tuple] = []
    for own in map(np.array, parts if len(pieces) else []):
        text = np.frombuffer(bytes([PART]).join([pieces[i] for i in own] + [b""]), np.uint8)
        base = np.concatenate([[0], np.cumsum(size[own] + 1)[:-1]])
        sa = suffix_array(text, WINDOW)
        lcp = common_prefixes(text, sa)
        weight = np.zeros(len(text), np.int64)
        who = np.repeat(own, counts[own])
        where = np.arange(len(who)) - np.repeat(np.cumsum(counts[own]) - counts[own], counts[own])
        weight[np.repeat(base, counts[own]) + where] = times[who]
        group = np.cumsum(lcp < WINDOW)
        heavy = np.bincount(group, weight[sa])
        twice = np.zeros(len(text), bool)
        twice[sa] = heavy[group] >= 2
        for i, b in zip(own, base):
            found[i] |= twice[b : b + counts[i]]
        # kept for the search only where a route goes on in another shard
        open_ = [routes[k] for k in (own[0], own[-1]) if k - 1 >= 0 and k == own[0] and routes[k - 1] == routes[k] or k + 1 < len(pieces) and k == own[-1] and routes[k + 1] == routes[k]]
        if open_:
            words = np.concatenate([words8(text), np.full(WINDOW, 0xFFFFFFFFFFFFFFFF, np.uint64)])
            built.append((set(open_), words, sa, own, base, np.concatenate([[0], np.cumsum(weight[sa])])))
    for x, (shared, words, _, own, base, _) in enumerate(built):
        for y, (others, theirs, sa, _, _, mass) in enumerate(built):
            both = shared & others
            if x == y or not both:
                continue
            ask = [(i, b, np.flatnonzero(~found[i])) for i, b in zip(own, base) if routes[i] in both and not found[i].all()]
            if ask:
                low, high = search(theirs, sa, spread(words, np.concatenate([b + k for _, b, k in ask]), WINDOW), WINDOW)
                seen, at = mass[high] > mass[low], 0
                for i, _, k in ask:
                    found[i][k] |= seen[at : at + len(k)]
                    at += len(k)
    return found


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def _sorted_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by route and bytes; equal pieces are one, and blocks of whole routes become shards. Yields the runs of repeated window starts."""
    rows: list[tuple[int, int, bytes]] = []
    uses: list[list[np.ndarray]] = []
    size = 0

    def solve() -> Iterator[pa.RecordBatch]:
        nonlocal rows, uses, size
        own = [u[0] if len(u) == 1 == len(u[0]) else np.unique(np.concatenate(u), axis=0) for u in uses]  # the same use twice is one
        flags = repeated_windows([r[2] for r in rows], np.array([r[1] for r in rows], np.int64), np.array([u[:, 3].sum() for u in own], np.int64), np.array([r[0] for r in rows], np.int64))
        rows, uses, size = [], [], 0
        told: list[np.ndarray] = []
        for u, f in zip(own, flags):
            if runs := _runs(f):
                of = np.repeat(u[:, :3], len(runs), axis=0)
                of = np.column_stack([of, of[:, 2]])
                of[:, 2:] += np.tile(np.array(runs, np.int64), (len(u), 1))
                told.append(of)
        if told:
            yield pa.record_batch([pa.array(c) for c in np.concatenate(told).T.copy()], ["gram", "context", "low", "high"])

    for batch in batches:
        lists = batch.column("uses")
        ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
        every = np.column_stack([lists.flatten().field(k).to_numpy(zero_copy_only=False) for k in range(4)]) if batch.num_rows else None
        for i, (route, count, piece) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("route", "count", "bytes")))):
            mine = every[ends[i - 1] if i else 0 : ends[i]]
            if rows and rows[-1][0] == route and rows[-1][2] == piece:
                uses[-1].append(mine)
                continue
            if size >= BLOCK and route != rows[-1][0]:
                yield from solve()
            rows.append((route, count, piece))
            uses.append([mine])
            size += len(piece)
    if rows:
        yield from solve()


def with_digest(docs: DataFrame) -> DataFrame:
    return docs.withColumn("digest", F.coalesce(F.unhex(F.md5(F.coalesce("text", F.lit("")))), F.lit(b"")))  # never null


def spans(docs: DataFrame) -> DataFrame:
    """digest, runs: the maximal spans [a, b) of bytes to remove of every different text that has any."""
    every = with_digest(docs.select("doc_id", "text"))
    own = every.filter(F.octet_length("text") >= WINDOW)
    twice = checkpointed(own.select("text").mapInArrow(_gram_counts, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).filter("n > 1"))
    # a gram with over a thousandth of all is dealt to as many tasks as thousandths: at most HEAVY grams, so they may be broadcast
    total = twice.agg(F.sum("n").alias("total"))
    heavy = F.broadcast(twice.crossJoin(F.broadcast(total)).filter(F.col("n") * HEAVY > F.col("total")).select("gram", F.ceil(F.col("n") * HEAVY / F.col("total")).cast("int").alias("salts")))
    salts = F.coalesce("salts", F.lit(1))
    wanted = twice.join(heavy, "gram", "left").select("gram", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    found = own.select("digest", "text").mapInArrow(_contexts, "digest binary, gram long, context long, start long, lead long, count long")
    found = found.join(heavy, "gram", "left").withColumn("salt", F.pmod(F.xxhash64("digest", "start", F.spark_partition_id()), salts).cast("int"))
    # one row for each context of a different text (and salt), with the rows that have it
    contexts = found.join(wanted, ["gram", "salt"], "left_semi").groupBy("digest", "gram", "salt", "context", "start", "lead", "count").agg(F.count("*").alias("n"))
    contexts = checkpointed(contexts.drop("salt"))
    kinds = contexts.groupBy("gram", "context", "lead", "count").agg(F.sum("n").alias("n"), F.min(F.struct("digest", "start")).alias("at"))
    hot = kinds.groupBy("gram").agg(F.count("*").alias("kinds")).filter(F.col("kinds") > HOT).select("gram", F.lit(True).alias("hot"))
    kinds = kinds.join(hot, "gram", "left")
    one_of = F.struct("gram", "context", F.col("at.start").alias("start"), "lead", "count", "n", F.coalesce("hot", F.lit(False)).alias("hot"))
    wanted = kinds.groupBy(F.col("at.digest").alias("digest")).agg(F.collect_list(one_of).alias("wanted"))  # of one text
    holders = own.groupBy("digest").agg(F.min("doc_id").alias("holder"))  # one of a group of copies
    # dealt by digest like the join that cuts the texts in the end, so that the texts are shuffled once
    one = F.coalesce(~(F.col("doc_id") < F.col("holder")) & ~(F.col("doc_id") > F.col("holder")), F.lit(True))
    cut = every.join(wanted.join(holders, "digest"), "digest").filter(one).select("text", "wanted").mapInArrow(_cut, _CUT)
    runs = cut.repartition("route").sortWithinPartitions("route", "bytes").mapInArrow(_sorted_shards, "gram long, context long, low long, high long")
    runs = runs.groupBy(F.struct("gram", "context").alias("k")).agg(F.collect_list(F.struct("low", "high")).alias("w")).select("k.*", "w")  # of one context
    spread = contexts.join(runs, ["gram", "context"]).select("digest", "start", F.explode("w").alias("r"))
    spans_of = F.struct((F.col("start") + F.col("r.low")).alias("a"), (F.col("start") + F.col("r.high") - 1 + WINDOW).alias("b"))
    return spread.groupBy("digest").agg(F.collect_list(spans_of).alias("r")).mapInArrow(_merged, "digest binary, runs array<struct<a:bigint,b:bigint>>")  # of one text


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Overlapping and touching spans of each text made one."""
    for batch in batches:
        own = batch.column("r")
        n = own.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        flat_spans = own.flatten()
        a, b = (flat_spans.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("a", "b"))
        row = np.repeat(np.arange(len(n)), n)
        far = (int(b.max()) + 2 if len(b) else 1) * row  # texts one after another, never touching
        order = np.argsort(a + far, kind="stable")
        a, b, far, row = a[order] + far[order], b[order] + far[order], far[order], row[order]
        reach = np.maximum.accumulate(b) if len(b) else b
        fresh = np.ones(len(a), bool)
        fresh[1:] = a[1:] > reach[:-1]
        first = np.flatnonzero(fresh)
        last = np.append(first[1:], len(a)) - 1
        runs = pa.StructArray.from_arrays([pa.array(a[first] - far[first]), pa.array(reach[last] - far[first])], ["a", "b"])
        offsets = np.concatenate([[0], np.cumsum(np.bincount(row[first], minlength=len(n)))]).astype(np.int32)
        yield pa.record_batch([batch.column("digest"), pa.ListArray.from_arrays(pa.array(offsets), runs)], ["digest", "runs"])


def _without(raw: bytes, runs: list[dict] | None) -> bytes:
    if not runs:
        return raw
    kept, at = [], 0
    for r in runs:
        kept.append(raw[at : r["a"]])
        at = r["b"]
    return b"".join([*kept, raw[at:]])


def removed(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, runs (spans of bytes removed) and kept (the bytes that stay) of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    joined = with_digest(docs.select("doc_id", "text")).join(spans(docs), "digest", "left").select("doc_id", "text", "runs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, ROWS) for b in batches for i in range(0, b.num_rows, ROWS)):
            raws = [(t.as_py() or "").encode() for t in batch.column("text")]
            runs = batch.column("runs").to_pylist()
            yield pa.record_batch(
                [batch.column("doc_id"), pa.array([len(r) for r in raws], pa.int64()), pa.array([r or [] for r in runs], pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))), pa.array([_without(r, s) for r, s in zip(raws, runs)], pa.binary())],
                ["doc_id", "n_bytes", "runs", "kept"],
            )

    return joined.mapInArrow(run, f"doc_id {kind}, n_bytes long, runs array<struct<a:bigint,b:bigint>>, kept binary")


def cleaned(docs: DataFrame) -> DataFrame:
    """docs, all columns, with the repeated bytes cut from the text; n_chars, where there is one, counts what is left."""
    names, digest, spans_at = docs.columns, unused(docs, "text_digest"), unused(docs, "spans_cut")
    keyed = docs.withColumn(digest, F.coalesce(F.unhex(F.md5(F.coalesce("text", F.lit("")))), F.lit(b"")))
    joined = keyed.join(spans(docs).select(F.col("digest").alias(digest), F.col("runs").alias(spans_at)), digest, "left").select(*names, spans_at)
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, ROWS) for b in batches for i in range(0, b.num_rows, ROWS)):
            runs = batch.column(spans_at).to_pylist()
            texts = [t if not r else _without(t.encode(), r).decode("utf-8", "ignore") for t, r in zip(batch.column("text").to_pylist(), runs)]
            columns = [batch.column(k) for k in range(len(names))]
            columns[at] = pa.array(texts, pa.string())
            yield pa.record_batch(columns, names)

    out = joined.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.char_length(F.coalesce("text", F.lit(""))).cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out


def op10_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    rows = removed(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    length = F.aggregate("runs", F.lit(0).cast("long"), lambda s, r: s + r["b"] - r["a"])
    return rows.select("doc_id", "n_bytes", length.alias("n_removed"), F.size("runs").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
