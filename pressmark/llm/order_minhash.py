"""Near duplicates by Order MinHash, verified by banded alignment.

A text is the sequence of its shingles of ``K`` words (a shorter text is one shingle).
Its shingles are labelled with their occurrence, so a repeated one counts each time.
For each of ``SKETCHES`` hash functions the ``KEPT`` shingles of least hash are sampled
and retained in text order; texts that agree in a sketch share a bucket. Two texts with
similarity s agree in one sketch with a chance of about s ** KEPT if their order agrees,
so at 0.8 all twenty miss with less than one in a million.

Similarity is that of the alignment: with m shingles matched in order and n in both
texts together, m / (n - m); 0.8 or more is a link. The alignment is a longest common
subsequence inside the band of offsets that a link can have, bit-parallel.

Buckets are never paired out. Every bucket compares its leader, the member that shares
most buckets with others, with its other members, and links join classes. Where a leader's
members are still of several classes, the outsiders, those outside its largest class, are
compared with all its members in blocks: a product of their shingle tables gives how many
every two have in common, which rules out all that cannot be links, and the rest are
aligned unless they have become one class meanwhile. Members of the largest class do not
meet each other, so a group of near copies costs in proportion to its size; only the
outsiders of a leader grow with their square, divided by the block. Only links leave a
block, fewer than it has members. Copies of one text are one row throughout.

Defined cases: null and empty texts and those without a word are classes by themselves;
equal texts with words are one class; repeated rows likewise; a class's id is its least
doc_id; columns other than doc_id and text are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressmark.llm import flat
from pressmark.llm.components import connected
from pressmark.llm.shared import checkpointed, unused

K = 5
SKETCHES = 20
KEPT = 3
BLOCK = 256  # members of a leader compared at a time, on either side
SALT = 256  # members of a bucket, or pairs of a leader, from which they are dealt to several tasks
BLOCK_CHARS = 1 << 20
HEAVY = 1000
WIDE = 4096
SIMILARITY = (4, 5)  # a ratio: 4 / 5

_rng = np.random.Generator(np.random.PCG64(5))
_FLIP = _rng.integers(0, 2**64, SKETCHES, dtype=np.uint64)
_TIMES = _rng.integers(0, 2**64, SKETCHES, dtype=np.uint64) | np.uint64(1)
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingles(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles in text order, and shingles per text."""
    ws, we, n = flat.words(data, offs)
    h = flat.span_hashes(data, ws, we)
    ends = np.cumsum(n)
    with np.errstate(over="ignore"):
        wide = np.zeros(max(0, len(h) - K + 1), np.uint64)
        for k in range(K):
            wide += h[k : k + len(wide)] * flat.powers(K)[k]
        text = np.repeat(np.arange(len(n)), n)
        whole = np.flatnonzero(np.arange(len(wide)) + K <= ends[text[: len(wide)]])
        few = np.flatnonzero((n > 0) & (n < K))
        short = np.zeros(len(few), np.uint64)
        for k in range(K - 1):
            some = n[few] > k
            at = ends[few] - n[few] + k
            short[some] += h[at[some]] * flat.powers(K)[k]
        short += n[few].astype(np.uint64)
    own = np.concatenate([text[whole], few])
    out = flat.mixed(np.concatenate([wide[whole], short]))
    order = np.argsort(own, kind="stable")
    return out[order], np.where(n >= K, n - K + 1, np.minimum(n, 1))


def _labelled(h: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Shingles with their occurrence within the text mixed in."""
    key = h ^ flat.mixed(text.astype(np.uint64) + np.uint64(1))
    order = np.argsort(key, kind="stable")
    s = key[order]
    fresh = np.ones(len(s), bool)
    fresh[1:] = s[1:] != s[:-1]
    if fresh.all():
        return h
    first = np.flatnonzero(fresh)
    times = np.empty(len(h), np.uint64)
    times[order] = (np.arange(len(s)) - np.repeat(first, np.diff(np.append(first, len(s))))).astype(np.uint64)
    again = np.flatnonzero(times)
    out = h.copy()
    with np.errstate(over="ignore"):
        out[again] = flat.mixed(h[again] + times[again] * np.uint64(0x9E3779B97F4A7C15))
    return out


def sketches(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of every text, texts x SKETCHES (meaningless without a shingle), and shingles per text."""
    plain, n = shingles(data, offs)
    texts = len(n)
    text = np.repeat(np.arange(texts), n)
    h = _labelled(plain, text)
    out = np.zeros((texts, SKETCHES), np.uint64)
    ends = np.cumsum(n)
    # few hashes lie below a bound that KEPT of a text's shingles will most likely stay under
    share = np.minimum(1.0, 4.0 * KEPT / np.maximum(n, 1))
    bound = np.where(share >= 1, _NONE, (share * 2.0**63).astype(np.uint64) * np.uint64(2))
    bound_of = np.repeat(bound, n)
    want = np.minimum(n, KEPT)
    with np.errstate(over="ignore"):
        for r in range(SKETCHES):
            g = (h ^ _FLIP[r]) * _TIMES[r]
            at = np.flatnonzero(g <= bound_of)
            got = np.diff(np.searchsorted(at, np.concatenate([[0], ends])))
            if (short := np.flatnonzero(got < want)).size:
                more = np.concatenate([np.arange(ends[t] - n[t], ends[t]) for t in short])
                at = np.union1d(at, more)
                got = np.diff(np.searchsorted(at, np.concatenate([[0], ends])))
            order = np.lexsort((at, g[at], text[at]))
            begin = np.cumsum(got) - got
            picked = np.full((texts, KEPT), len(h), np.int64)
            for k in range(KEPT):
                has = want > k
                picked[has, k] = at[order[begin[has] + k]]
            picked.sort(axis=1)
            ext = np.append(h, np.uint64(0))
            code = np.full(texts, np.uint64(r + 1))
            for k in range(KEPT):
                code = flat.mixed(code * np.uint64(0x9E3779B97F4A7C15) + ext[picked[:, k]])
            out[:, r] = code
    return out, n


# -- alignment


def band(n: int) -> int:
    """The largest alignment distance (shingles without a match) that n shingles in both texts may have in a link."""
    p, q = SIMILARITY  # m / (n - m) >= p / q  <=>  m >= p n / (p + q)
    return n - 2 * -(-p * n // (p + q))


def common_subsequence(a: list, b: list, width: int) -> int:
    """The length of a longest common subsequence if the distance is within the band; else at most that."""
    rows = max(64, width)
    total = low = high = v = 0
    for i in range(0, len(a), rows):
        start = min(max(low, i - width), high)
        drop = start - low
        total += drop - (v & ((1 << drop) - 1)).bit_count()
        v >>= drop
        low = start
        stop = min(len(b), i + rows + width)
        if stop > high:
            v |= ((1 << (stop - high)) - 1) << (high - low)
            high = stop
        where: dict = {}
        for j in range(low, high):
            where[b[j]] = where.get(b[j], 0) | (1 << (j - low))
        full = (1 << (high - low)) - 1
        for x in a[i : i + rows]:
            if u := v & where.get(x, 0):
                v = ((v + u) | (v - u)) & full
    return total + (high - low) - v.bit_count()


def distance(a: np.ndarray, b: np.ndarray) -> tuple[int, int | None]:
    """Bounds (least, most) of the alignment distance; both are the distance itself where it is within the band, most is None beyond."""
    n = len(a) + len(b)
    limit = band(n)
    if abs(len(a) - len(b)) > limit:
        return abs(len(a) - len(b)), None
    m = min(len(a), len(b))
    differs = np.flatnonzero(a[:m] != b[:m])
    head = int(differs[0]) if len(differs) else m
    differs = np.flatnonzero(a[head:][::-1][: m - head] != b[head:][::-1][: m - head])
    tail = int(differs[0]) if len(differs) else m - head
    a, b = a[head : len(a) - tail], b[head : len(b) - tail]
    if not len(a) or not len(b):
        d = len(a) + len(b)
        return d, d if d <= limit else None
    x, nx = np.unique(a, return_counts=True)
    y, ny = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    least = len(a) + len(b) - 2 * int(np.minimum(nx[i], ny[j]).sum())  # of the sets, so at most that of the sequences
    if least > limit:
        return least, None
    d = len(a) + len(b) - 2 * common_subsequence(a.tolist(), b.tolist(), limit)
    return (d, d) if d <= limit else (max(least, limit + 1), None)


def _shingles_of(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode(), np.uint8)
    return shingles(raw, np.array([0, len(raw)]))[0]


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last: tuple[str, np.ndarray] | None = None
    for batch in batches:
        linked = []
        for ta, tb in zip(batch.column("ta"), batch.column("tb")):
            ta, tb = ta.as_py(), tb.as_py()
            if last is None or last[0] != ta:
                last = (ta, _shingles_of(ta))
            linked.append(distance(last[1], _shingles_of(tb))[1] is not None)
        names = ["a", "salts", "salt", "b", "n"]
        yield pa.record_batch([*map(batch.column, names), pa.array(linked, pa.bool_())], [*names, "linked"])


def common(sets: list[np.ndarray]) -> np.ndarray:
    """How many labelled shingles every two texts have in common."""
    n = np.array([len(x) for x in sets])
    every = np.concatenate(sets)
    own = np.repeat(np.arange(len(sets)), n)
    order = np.argsort(every, kind="stable")
    every, own = every[order], own[order]
    fresh = np.ones(len(every), bool)
    fresh[1:] = every[1:] != every[:-1]
    column = np.cumsum(fresh) - 1
    shared = np.bincount(column)[column] > 1  # others count for nobody else
    column, own = column[shared], own[shared]
    out = np.zeros((len(sets), len(sets)), np.float32)
    if len(column):
        column = np.cumsum(np.concatenate([[0], np.diff(column) > 0]))
        cut = np.searchsorted(column, np.arange(0, column[-1] + 1 + WIDE, WIDE))
        for k, (i, j) in enumerate(zip(cut, cut[1:])):
            table = np.zeros((len(sets), WIDE), np.float32)
            table[own[i:j], column[i:j] - k * WIDE] = 1
            out += table @ table.T
    return out


def links_of(plain: list[np.ndarray], sets: list[np.ndarray], roots: list, sides: np.ndarray | None) -> list[tuple[int, int]]:
    """Links that join classes. sides: block numbers where only pairs across two blocks are wanted."""
    parent = {r: r for r in roots}

    def find(r):
        while parent[r] != r:
            parent[r] = parent[parent[r]]
            r = parent[r]
        return r

    n = np.array([len(x) for x in plain])
    number = {r: k for k, r in enumerate(parent)}
    root = np.array([number[r] for r in roots])
    p, q = SIMILARITY
    likely = np.triu(((p + q) * common(sets) >= p * (n[:, None] + n[None, :])) & (root[:, None] != root[None, :]), 1)
    if sides is not None:
        likely &= sides[:, None] != sides[None, :]
    found = []
    for i, j in zip(*map(np.ndarray.tolist, np.nonzero(likely))):
        x, y = find(roots[i]), find(roots[j])
        if x != y and distance(plain[i], plain[j])[1] is not None:
            parent[x] = y
            found.append((i, j))
    return found


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (a, x, y): the members of block x and y of leader a."""
    rows: list[tuple] = []
    zero = np.zeros(1, np.int64)

    def solve() -> Iterator[pa.RecordBatch]:
        nonlocal rows
        own, rows = rows, []
        if len(own) < 2:
            return
        plain = [_shingles_of(r[4]) for r in own]
        sides = np.array([r[3] for r in own]) if own[0][0][1] != own[0][0][2] else None
        found = links_of(plain, [_labelled(h, np.repeat(zero, len(h))) for h in plain], [r[2] for r in own], sides)
        if found:  # as links of their classes
            yield pa.record_batch([pa.array([own[k][2] for k in side], pa.binary()) for side in zip(*found)], ["a", "b"])

    for batch in batches:
        for a, x, y, b, root, side, text in zip(*(batch.column(c) for c in ("a", "x", "y", "b", "root", "side", "text"))):
            key = (a.as_py(), x.as_py(), y.as_py())
            if rows and rows[0][0] != key:
                yield from solve()
            rows.append((key, b.as_py(), root.as_py(), side.as_py(), text.as_py()))
    yield from solve()


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, data, offs in flat.slices(batch.column("text")):
            buckets, n = sketches(data, offs)
            some = np.flatnonzero(n)
            rows = pa.array(np.repeat(some, SKETCHES) + i)
            yield pa.record_batch(
                [pa.array(buckets[some].ravel().view(np.int64)), batch.column("digest").take(rows)],
                ["bucket", "digest"],
            )


def stars_of(members: DataFrame) -> DataFrame:
    """(a, b, n): every member b of a bucket with the bucket's leader a, and the size n of their largest bucket.

    members: bucket, digest, n (members of the bucket). The leader shares most buckets with
    others. A bucket of over ``SALT`` members is dealt to several tasks.
    """
    shares = members.groupBy("digest").agg(F.sum("n").alias("shares"))
    leaders = members.join(shares, "digest").groupBy("bucket").agg(F.max(F.struct("shares", "digest")).alias("m"), F.max("n").alias("n"))
    salts = F.ceil(F.col("n") / SALT).cast("int")
    leaders = leaders.select("bucket", F.col("m.digest").alias("a"), F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    salted = members.withColumn("salt", F.pmod(F.xxhash64("digest"), salts).cast("int"))
    return salted.join(leaders, ["bucket", "salt"]).filter(F.col("digest") != F.col("a")).groupBy("a", F.col("digest").alias("b")).agg(F.max("n").alias("n"))


def salted_by_leader(pairs: DataFrame) -> DataFrame:
    """pairs (a, b, n) with a salt: the pairs of a leader with large buckets are dealt to several tasks."""
    salts = F.ceil(F.col("n") / SALT).cast("int")
    return pairs.select("a", "b", salts.alias("salts"), F.pmod(F.xxhash64("b"), salts).cast("int").alias("salt"))


def dealt(known: DataFrame) -> DataFrame:
    """(a, x, y, b, root, side): the members of every leader that has members of several classes, by tasks.

    known: a, salts, salt, b, root, n (code points). The members of the leader's largest
    class need no comparing with each other: they meet only the outsiders, the members of
    other classes, who also meet each other. Outsiders fill the blocks 0.. and the largest
    class those after them; task (x, y) compares block x with block y. So rows grow with
    the largest class times the outsiders' blocks, and with the outsiders times all blocks.
    """
    per_class = known.groupBy("a", "root").agg(F.count("*").alias("k"), F.sum("n").alias("chars"))
    per_leader = per_class.groupBy("a").agg(F.max(F.struct("k", "root", "chars")).alias("m"), F.sum("k").alias("k"), F.sum("chars").alias("chars")).filter(F.col("k") > F.col("m.k"))
    blocks = lambda k, chars: F.ceil(F.greatest(k / BLOCK, chars / BLOCK_CHARS)).cast("int")
    plan = per_leader.select("a", F.col("m.root").alias("main"), blocks(F.col("m.k"), F.col("m.chars")).alias("inner"), blocks(F.col("k") - F.col("m.k"), F.col("chars") - F.col("m.chars")).alias("outer"))
    plan = known.select("a", "salts", "salt").distinct().join(plan, "a")
    outside = F.col("root") != F.col("main")
    side = F.when(outside, F.pmod(F.xxhash64("b"), "outer")).otherwise(F.col("outer") + F.pmod(F.xxhash64("b"), "inner")).cast("int")
    others = F.sequence(F.lit(0), F.when(outside, F.col("outer") + F.col("inner")).otherwise(F.col("outer")) - 1)
    rows = known.join(plan, ["a", "salts", "salt"]).select("a", "b", "root", side.alias("side"), F.explode(others).alias("other"))
    return rows.select("a", F.least("side", "other").alias("x"), F.greatest("side", "other").alias("y"), "b", "root", "side")


def by_root(rows: DataFrame, per_root: DataFrame, how: str) -> DataFrame:
    """rows (digest, root, ...) joined with one row of each root; a class with over a thousandth of all rows is dealt to as many tasks as thousandths.

    Fewer than ``HEAVY`` classes are that large, so they may be broadcast.
    """
    total = rows.agg(F.count("*").alias("total"))
    sizes = rows.groupBy("root").agg(F.count("*").alias("k")).crossJoin(F.broadcast(total))  # one row
    heavy = F.broadcast(sizes.select("root", F.ceil(F.col("k") * HEAVY / F.col("total")).cast("int").alias("salts")).filter("salts > 1"))
    salts = F.coalesce("salts", F.lit(1))
    salted = rows.join(heavy, "root", "left").withColumn("salt", F.pmod(F.xxhash64("digest"), salts).cast("int")).drop("salts")
    dealt_out = per_root.join(heavy, "root", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("salts")
    return salted.join(dealt_out, ["root", "salt"], how).drop("salt")


def classes(docs: DataFrame) -> DataFrame:
    """digest, root: the class (its least digest) of every text that is linked to another text."""
    text = F.coalesce("text", F.lit(""))
    own = docs.select("doc_id", "text").withColumn("digest", F.unhex(F.md5(text)))
    found = own.select("digest", "text").mapInArrow(_sketched, "bucket long, digest binary").distinct()
    several = found.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    members = checkpointed(found.join(several, "bucket"))

    # one row of each text, the one with the least id; met by the id's hash too, so that copies of a text are dealt out
    held = F.xxhash64("doc_id").alias("held")
    holders = own.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).join(members.select("digest").distinct(), "digest", "left_semi").select("digest", held)
    texts = own.select("digest", "text", held).join(holders, ["digest", "held"]).dropDuplicates(["digest", "held"])
    texts = checkpointed(texts.select("digest", "text", F.char_length("text").alias("chars")))

    # a leader's text goes once to every task that has pairs of it
    stars = checkpointed(salted_by_leader(stars_of(members)))
    led = stars.select("a", "salts", "salt").distinct().join(texts.select(F.col("digest").alias("a"), F.col("text").alias("ta")), "a")
    paired = stars.join(texts.select(F.col("digest").alias("b"), F.col("text").alias("tb"), F.col("chars").alias("n")), "b").join(led, ["a", "salts", "salt"])
    tested = checkpointed(paired.select("a", "salts", "salt", "b", "n", "ta", "tb").mapInArrow(_aligned, "a binary, salts int, salt int, b binary, n int, linked boolean"))
    roots = connected(tested.filter("linked").select("a", "b"))

    known = tested.join(roots.withColumnRenamed("v", "b"), "b", "left").withColumn("root", F.coalesce("root", "b"))
    blocks = dealt(known).join(texts.select(F.col("digest").alias("b"), "text"), "b").repartition("a", "x", "y").sortWithinPartitions("a", "x", "y", "b")
    more = blocks.select("a", "x", "y", "b", "root", "side", "text").mapInArrow(_blocks, "a binary, b binary")
    # links between classes: their components join the classes
    joined = connected(more).toDF("root", "above")
    every = roots.withColumnRenamed("v", "digest").unionByName(joined.select(F.col("root").alias("digest"), "root"))
    return by_root(every, joined, "left").select("digest", F.coalesce("above", "root").alias("root"))


def _words(docs: DataFrame) -> DataFrame:
    """doc_id, digest, and whether there is a word in it, of every row."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.unhex(F.md5(text)).alias("digest"), F.regexp_like(text, F.lit(r"[^\x20\x09-\x0D]")).alias("some"))


def _rooted(docs: DataFrame) -> DataFrame:
    """digest, least (doc_id), copies, root of every text with a word."""
    per_text = _words(docs).filter("some").groupBy("digest").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"))
    return per_text.join(classes(docs), "digest", "left").withColumn("root", F.coalesce("root", "digest"))


def _first(per_text: DataFrame) -> DataFrame:
    """root, m (least, digest): the text of each class that has the least id."""
    return per_text.groupBy("root").agg(F.min(F.struct("least", "digest")).alias("m"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id and class_id (the least doc_id of its class) of every row of docs."""
    per_text = checkpointed(_rooted(docs))
    of_text = by_root(per_text, _first(per_text), "inner").select("digest", "copies", F.col("m.least").alias("class_id"))
    # a text with over a thousandth of all rows is dealt to as many tasks as thousandths: at most HEAVY texts, so they may be broadcast
    total = per_text.agg(F.sum("copies").alias("total"))
    salts = F.ceil(F.col("copies") * HEAVY / F.col("total")).cast("int")
    of_text = of_text.crossJoin(F.broadcast(total)).withColumn("salts", salts)
    heavy = F.broadcast(of_text.filter("salts > 1").select("digest", "salts"))
    rows = _words(docs).join(heavy, "digest", "left").withColumn("salt", F.pmod(F.xxhash64("doc_id", F.spark_partition_id()), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")
    of_text = of_text.select("digest", "class_id", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    return rows.join(of_text, ["digest", "salt"], "left").select("doc_id", F.when(F.col("some"), F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"))


def keep(docs: DataFrame) -> DataFrame:
    """One row of docs, all columns, for each class: the one with the least doc_id (of equal rows any one)."""
    text = F.coalesce("text", F.lit(""))
    digest, holder = unused(docs, "text_digest"), unused(docs, "held_by")
    stays = _first(_rooted(docs)).select(F.col("m.least").alias(holder), F.col("m.digest").alias(digest))
    keyed = docs.withColumn(digest, F.unhex(F.md5(text)))
    some = F.regexp_like(text, F.lit(r"[^\x20\x09-\x0D]"))
    chosen = keyed.filter(some).alias("d").join(stays.alias("s"), (F.col(f"d.{digest}") == F.col(f"s.{digest}")) & F.col("d.doc_id").eqNullSafe(F.col(f"s.{holder}"))).select("d.*").dropDuplicates([digest, "doc_id"])
    return chosen.select(*docs.columns).unionByName(docs.filter(~some))


def op8_order_minhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "class_id")
