"""A prefix trie of rebuilt conversations by an LCP-aware external mergesort.

A turn is a digest of its role and text with its number of words, so a conversation is a
row of 24 bytes a turn. Conversations are dealt by ranges of (digests, id), so that no first
turn, nor the copies of one conversation, has to lie in one task. Within a range:

* runs of ``RUN_BYTES`` are sorted, and written as blocks in which each conversation carries
  the number of turns it shares with the one before (its LCP) and only the turns after that;
* Spark sorts the blocks by their first conversation, on disk where they are large;
* a loser tree merges the blocks that are open, at most one of each run and one more: of two
  conversations the one with the longer LCP to the last one written comes first, and only
  equal LCPs are compared, from there on;
* the merged stream keeps a stack of the open path; a node is finished when it is left.

Nodes on the paths of a range's first and last conversation may go on in other ranges. Their
parts, some two paths for each range, are joined by the same kind of stack in one task.

Defined cases: a null role or text is empty; turns of one number (null first) go by their
digests; rows without a conversation id belong to no conversation and are left out; ids may be
of any integral kind, and c % 20 has the sign of c, as in SQL; a conversation without turns is
a member of the root alone; an empty table gives no nodes; other columns are passed over.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressmark.llm.shared import checkpointed

FAMILY = 20  # conversations that share the first turns of the first of them
MOST_SHARED = 4
RUN_BYTES = 8 << 20
BLOCK_BYTES = 64 << 10
DIGEST, COUNT = 16, 8  # bytes of a turn
_IDS = 4096  # ids in one piece of a list that goes on in another range


def rebuilt(rows: DataFrame) -> DataFrame:
    """conv_id, turns (digests, concatenated), words (64-bit counts, concatenated): one row per conversation, rebuilt."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = rows.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        F.substring(F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)), 1, DIGEST).alias("digest"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"),
    )
    based = turns.withColumn("base", F.col("conv_id") - F.col("conv_id") % FAMILY)
    order = ["base", F.col("conv_id") != F.col("base"), "conv_id", F.col("turn").asc_nulls_first(), "digest"]
    return based.repartition("base").sortWithinPartitions(*order).select("base", "conv_id", "digest", "words").mapInArrow(_rebuild, "conv_id long, turns binary, words binary")


def _rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each base conversation comes before the others of its family; of it only the first turns are kept."""
    key, family, first = None, None, ([], [])
    turns: list[bytes] = []
    words: list[bytes] = []
    done: list[tuple[int, bytes, bytes]] = []
    size = 0

    def close() -> None:
        nonlocal first, size
        base, conv = key
        if base != family:
            first = ([], [])
        if conv == base:
            first = (turns[: MOST_SHARED - 1], words[: MOST_SHARED - 1])
        h = zlib.crc32(str(conv).encode()) % MOST_SHARED
        done.append((conv, b"".join(first[0][:h] + turns[h:]), b"".join(first[1][:h] + words[h:])))
        size += len(done[-1][1]) + 32

    def batch() -> pa.RecordBatch:
        nonlocal done, size
        out = pa.record_batch([pa.array(c, k) for c, k in zip(zip(*done), (pa.int64(), pa.binary(), pa.binary()))], ["conv_id", "turns", "words"])
        done, size = [], 0
        return out

    for b in batches:
        for here, digest, n in zip(zip(b.column("base").to_pylist(), b.column("conv_id").to_pylist()), b.column("digest").to_pylist(), b.column("words").to_pylist()):
            if here != key:
                if key is not None:
                    close()
                    family = key[0]
                    if size > BLOCK_BYTES:
                        yield batch()
                key, turns, words = here, [], []
            turns.append(digest)
            words.append(n.to_bytes(COUNT, "little"))
    if key is not None:
        close()
        yield batch()


def shared_turns(x: bytes, y: bytes, h: int = 0) -> int:
    """How many turns two conversations share from the first on, given that they share h."""
    n = min(len(x), len(y)) // DIGEST
    if x[h * DIGEST : n * DIGEST] == y[h * DIGEST : n * DIGEST]:
        return n
    step = 1
    while True:  # the step doubles while all of it is equal
        if x[h * DIGEST : (h + step) * DIGEST] == y[h * DIGEST : (h + step) * DIGEST]:
            h, step = h + step, step * 2
        elif step == 1:
            return h
        else:
            step = 1


_BLOCK = pa.schema([("first", pa.binary()), ("least", pa.int64()), ("ids", pa.list_(pa.int64())), ("lcps", pa.list_(pa.int32())), ("depths", pa.list_(pa.int32())), ("turns", pa.binary()), ("words", pa.binary())])


def _runs(run_bytes: int, block_bytes: int):
    """Sorted runs of the rows of a range, as blocks."""

    def blocks(run: list[tuple[bytes, int, bytes]]) -> Iterator[pa.RecordBatch]:
        run.sort()
        i = 0
        while i < len(run):
            start, before, size = i, b"", 0
            ids, lcps, depths, turns, words = [], [], [], [], []
            while i < len(run) and (i == start or size < block_bytes):
                seq, conv, counts = run[i]
                h = shared_turns(before, seq)
                ids.append(conv)
                lcps.append(h)
                depths.append(len(seq) // DIGEST)
                turns.append(seq[h * DIGEST :])
                words.append(counts[h * COUNT :])
                size += len(turns[-1]) + len(words[-1]) + 16
                before, i = seq, i + 1
            yield pa.RecordBatch.from_pylist([{"first": run[start][0], "least": ids[0], "ids": ids, "lcps": lcps, "depths": depths, "turns": b"".join(turns), "words": b"".join(words)}], _BLOCK)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, size = [], 0
        for b in batches:
            for conv, seq, counts in zip(b.column("conv_id").to_pylist(), b.column("turns").to_pylist(), b.column("words").to_pylist()):
                run.append((seq, conv, counts))
                size += len(seq) + len(counts) + 64
                if size >= run_bytes:
                    yield from blocks(run)
                    run, size = [], 0
        yield from blocks(run)

    return work


class Block:
    """An open block: its current conversation, and how many turns that shares with the last one written."""

    def __init__(self, ids: list[int], lcps: list[int], depths: list[int], turns: bytes, words: bytes):
        self._ids, self._lcps, self._depths, self._turns, self._words = ids, lcps, depths, turns, words
        self._at, self._read = -1, 0
        self.seq, self.counts, self.lcp, self.conv = b"", b"", 0, 0
        self.advance()

    def advance(self) -> bool:
        self._at += 1
        if self._at == len(self._ids):
            return False
        h, d = self._lcps[self._at], self._depths[self._at]
        end = self._read + d - h
        self.seq = self.seq[: h * DIGEST] + self._turns[self._read * DIGEST : end * DIGEST]
        self.counts = self.counts[: h * COUNT] + self._words[self._read * COUNT : end * COUNT]
        self._read, self.lcp, self.conv = end, h, self._ids[self._at]
        return True


class LoserTree:
    """A tournament of blocks; each loser keeps its LCP with the one that beat it."""

    def __init__(self, players: list[Block | None]):
        n = len(players)
        self._n = n
        self._losers: list[Block | None] = [None] * n
        won = [None] * n + list(players)
        for i in range(n - 1, 0, -1):
            won[i], self._losers[i] = self._play(won[2 * i], won[2 * i + 1])
        self._leaf = {id(p): n + i for i, p in enumerate(players)}
        self.winner = won[1] if n > 1 else won[n]

    @staticmethod
    def _play(a: Block | None, b: Block | None) -> tuple[Block | None, Block | None]:
        """(winner, loser). Both LCPs are with the same conversation, which comes before both."""
        if a is None or b is None:
            return (b, a) if a is None else (a, b)
        if a.lcp != b.lcp:
            return (a, b) if a.lcp > b.lcp else (b, a)
        h = shared_turns(a.seq, b.seq, a.lcp)
        x, y = a.seq[h * DIGEST : (h + 1) * DIGEST], b.seq[h * DIGEST : (h + 1) * DIGEST]
        if x < y or (x == y and a.conv < b.conv):
            b.lcp = h
            return a, b
        a.lcp = h
        return b, a

    def replay(self, gone: bool) -> None:
        """After the winner moved on, or came to its end: the games on its way up."""
        i = self._leaf[id(self.winner)] // 2
        c = None if gone else self.winner
        while i:
            c, self._losers[i] = self._play(c, self._losers[i])
            i //= 2
        self.winner = c


def merged(blocks: Iterator[Block]) -> Iterator[tuple[int, bytes, int, bytes]]:
    """(turns shared with the one before, digests, id, counts) of all conversations in order; blocks come by their first.

    The block read last is always one whose first conversation is not yet written, so no block that is still
    unread can hold anything that comes before what is written next.
    """
    players: list[Block] = []
    fresh, before, more = None, b"", True
    tree = None
    while True:
        if fresh is None and more:
            fresh = next(blocks, None)
            if fresh is None:
                more = False
            else:
                players.append(fresh)
                for p in players:
                    p.lcp = shared_turns(p.seq, before)
                tree = LoserTree(players)
        if tree is None or tree.winner is None:
            return
        top = tree.winner
        yield top.lcp, top.seq, top.conv, top.counts
        before = top.seq
        if top is fresh:
            fresh = None
        goes_on = top.advance()
        if not goes_on:
            players = [p for p in players if p is not top]
        tree.replay(not goes_on)


class Node:
    """An open node: what ended in it or in finished children."""

    __slots__ = ("digest", "words", "no", "up", "n", "least", "children", "leaves", "saved", "ends")

    def __init__(self, digest: bytes, words: int, no: int, up: int | None):
        self.digest, self.words, self.no, self.up = digest, words, no, up
        self.n, self.least, self.children, self.leaves, self.saved = 0, None, 0, 0, 0
        self.ends: list[str] | str | None = None

    def finish(self) -> None:
        if not self.children:
            self.leaves = 1
        self.saved += (self.n - 1) * self.words

    def take(self, n: int, least: int | None, leaves: int, saved: int) -> None:
        self.n += n
        if least is not None and (self.least is None or least < self.least):
            self.least = least
        self.leaves += leaves
        self.saved += saved


_NODE = pa.schema([
    ("part", pa.int32()), ("phase", pa.int32()), ("depth", pa.int64()), ("piece", pa.int64()), ("no", pa.int64()), ("up", pa.int64()), ("digest", pa.binary()), ("words", pa.int64()),
    ("n", pa.int64()), ("least", pa.int64()), ("children", pa.int64()), ("leaves", pa.int64()), ("saved", pa.int64()), ("ends", pa.string()),
])
_NODE_DDL = "part int, phase int, depth long, piece long, no long, up long, digest binary, words long, n long, least long, children long, leaves long, saved long, ends string"
_NONE = hashlib.sha256(b"").hexdigest()
#: phase of a row: finished; a part of a node on the way to the first conversation; on the way to the last
_DONE, _FIRST, _LAST = None, 0, 1


def _out(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), _NODE)], schema=_NODE)


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Finished nodes of a range, and the parts of those on its borders."""
    part = TaskContext.get().partitionId()

    def opened() -> Iterator[Block]:
        for b in batches:
            for r in b.to_pylist():
                yield Block(r["ids"], r["lcps"], r["depths"], r["turns"], r["words"])

    rows: list[tuple] = []
    stack: list[Node] = []
    left = 0  # so many turns of the first conversation are still open
    made = 0
    first = True  # whether only copies of the first conversation came so far

    def row(x: Node, depth: int, phase: int | None, ends: str | None) -> tuple:
        return (part, phase, depth, 0, x.no, x.up, x.digest, x.words, x.n, x.least, x.children, x.leaves, x.saved, ends)

    def pieces(x: Node, depth: int, phase: int) -> None:
        """A part of a node: its row, then the ids that end in it where their list may go on elsewhere."""
        listed = x.ends if isinstance(x.ends, list) else []
        rows.append(row(x, depth, phase, x.ends if isinstance(x.ends, str) else None))
        for k in range(0, len(listed), _IDS):
            rows.append((part, phase, depth, 1 + k // _IDS, x.no, *[None] * 8, ",".join(listed[k : k + _IDS])))

    def settle(x: Node) -> None:
        """No other conversation of this range ends in the node: the list of its ids is only kept where it is the range's first."""
        if isinstance(x.ends, list) and not first:
            x.ends = hashlib.sha256(",".join(x.ends).encode()).hexdigest()

    for lcp, seq, conv, counts in merged(opened()):
        depth = len(seq) // DIGEST
        if not stack:
            stack.append(Node(b"", 0, 0, None))
            made, left = 1, depth
        elif not (lcp == depth == len(stack) - 1):
            settle(stack[-1])
            first = False
        while len(stack) - 1 > lcp:
            d, x = len(stack) - 1, stack.pop()
            if d <= left:
                pieces(x, d, _FIRST)
                left = d - 1
                continue
            x.finish()
            rows.append(row(x, d, _DONE, x.ends or _NONE))
            stack[-1].take(x.n, x.least, x.leaves, x.saved)
        while len(stack) - 1 < depth:
            d = len(stack)
            up = stack[-1]
            if d > left:
                up.children += 1
            stack.append(Node(seq[(d - 1) * DIGEST : d * DIGEST], int.from_bytes(counts[(d - 1) * COUNT : d * COUNT], "little"), made, up.no))
            made += 1
        top = stack[-1]
        top.take(1, conv, 0, 0)
        if top.ends is None:
            top.ends = []
        top.ends.append(str(conv))
        if len(rows) >= 4096:
            yield _out(rows)
            rows = []
    for d, x in enumerate(stack):
        if d + 1 < len(stack) and d + 1 > left:
            x.children -= 1  # the child goes on, and is counted where parts are joined
        pieces(x, d, _FIRST if d <= left else _LAST)
    if rows:
        yield _out(rows)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Border nodes from their parts, in the order of the ranges: finished nodes as part -1, and for each part (part, no) the node's number in n."""
    stack: list[Node] = []
    rows: list[tuple] = []
    made = 0
    part, following = None, False

    def close(down_to: int) -> None:
        while len(stack) > down_to:
            d, x = len(stack) - 1, stack.pop()
            x.finish()
            ends = _NONE if x.ends is None else x.ends if isinstance(x.ends, str) else x.ends.hexdigest()
            rows.append((-1, _DONE, d, 0, x.no, x.up, None, x.words, x.n, x.least, x.children, x.leaves, x.saved, ends))
            if stack:
                stack[-1].take(x.n, x.least, x.leaves, x.saved)

    for b in batches:
        for r in b.to_pylist():
            if r["piece"]:
                top = stack[-1]
                if top.ends is None:
                    top.ends = hashlib.sha256(r["ends"].encode())
                else:
                    top.ends.update(b"," + r["ends"].encode())
                continue
            if r["part"] != part:
                part, following = r["part"], True
            d = r["depth"]
            following = following and r["phase"] == _FIRST and d < len(stack) and stack[d].digest == (r["digest"] or b"")
            if not following:
                close(d)
                stack.append(Node(r["digest"] or b"", r["words"], made, stack[-1].no if stack else None))
                made += 1
                if d:
                    stack[d - 1].children += 1
            x = stack[d]
            x.take(r["n"], r["least"], r["leaves"], r["saved"])
            x.children += r["children"]
            if r["ends"] is not None:
                x.ends = r["ends"]
            rows.append((part, _DONE, None, 0, r["no"], None, None, None, x.no, None, None, None, None, None))
        if rows:
            yield _out(rows)
            rows = []
    close(0)
    if rows:
        yield _out(rows)


def nodes(sequences: DataFrame, run_bytes: int = RUN_BYTES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The trie of rebuilt() conversations, one row per node."""
    dealt = sequences.repartitionByRange("turns", "conv_id")
    ddl = "first binary, least long, ids array<bigint>, lcps array<int>, depths array<int>, turns binary, words binary"
    blocks = dealt.mapInArrow(_runs(run_bytes, block_bytes), ddl).sortWithinPartitions("first", "least")
    found = checkpointed(blocks.mapInArrow(_nodes, _NODE_DDL))
    done = found.filter("phase is null")
    border = checkpointed(found.filter("phase is not null").coalesce(1).sortWithinPartitions("part", "phase", "depth", "piece").mapInArrow(_joined, _NODE_DDL))
    whole = done.unionByName(border.filter("depth is not null"))
    aliases = border.filter("depth is null").select("part", "no", F.col("n").alias("_node"))
    named = whole.select("part", "no", "least").unionByName(
        aliases.join(border.filter("depth is not null").select(F.col("no").alias("_node"), "least"), "_node").select("part", "no", "least")
    )
    parents = named.select(F.col("part"), F.col("no").alias("up"), F.col("least").alias("parent_conv_id"))
    return whole.join(parents, ["part", "up"], "left").select(
        F.col("least").alias("conv_id"), "depth", "parent_conv_id", F.col("n").alias("n_convs"), F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"), F.col("ends").alias("ends_sha256"),
    )


def op13_conversation_trie(spark, sf_dir: str) -> DataFrame:
    return nodes(rebuilt(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


#: CRC-32 goes bit by bit: a digit is xored in, then eight times (256) the polynomial where the last bit is set.
SQL = {
    "op13_conversation_trie": r"""WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS x,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT c, c - c % 20 AS b, xor(list_reduce([4294967295::BIGINT] || flatten(list_transform(string_split(c::VARCHAR, ''), lambda s: [ascii(s)::BIGINT, 256, 256, 256, 256, 256, 256, 256, 256])),
  lambda a, e: CASE WHEN e = 256 THEN xor(a >> 1, 3988292384 * (a & 1)) ELSE xor(a, e) END), 4294967295) % 4 AS h FROM (SELECT DISTINCT c FROM t)),
own AS (SELECT c.c, t.k, t.r, t.x FROM c JOIN t ON t.c = c.b AND t.k <= c.h UNION ALL SELECT c.c, t.k, t.r, t.x FROM c JOIN t ON t.c = c.c AND t.k > c.h),
s AS (SELECT c.c, coalesce(list({'r': r, 'x': x} ORDER BY k) FILTER (k IS NOT NULL), []) AS q FROM c LEFT JOIN own ON own.c = c.c GROUP BY c.c),
n AS (SELECT q[1:d] AS p, d, count(*) AS n, min(c) AS m, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (len(q) = d), '')) AS e
  FROM (SELECT c, q, unnest(range(len(q) + 1)) AS d FROM s) GROUP BY 1, 2),
k AS (SELECT p[1:d - 1] AS p, count(*) AS n FROM n WHERE d > 0 GROUP BY 1),
w AS (SELECT n.*, coalesce(k.n, 0) AS kids, CASE WHEN d = 0 THEN 0 ELSE (n.n - 1) * len(regexp_extract_all(n.p[d].x, '[^\x20\x09-\x0D]+')) END AS own FROM n LEFT JOIN k ON k.p = n.p),
u AS (SELECT p[1:j] AS p, sum((kids = 0)::INT) AS leaves, sum(own) AS saved FROM (SELECT p, kids, own, unnest(range(d + 1)) AS j FROM w) GROUP BY 1)
SELECT w.m AS conv_id, w.d AS depth, a.m AS parent_conv_id, w.n AS n_convs, w.kids AS n_children, u.leaves::BIGINT AS n_leaves, u.saved::BIGINT AS saved_tokens, w.e AS ends_sha256
FROM w JOIN u ON u.p = w.p LEFT JOIN n a ON w.d > 0 AND a.d = w.d - 1 AND a.p = w.p[1:w.d - 1]""",
}
