"""Packing by Karmarkar-Karp multiway differencing.

Every task packs the documents of its own input split, so nothing is shuffled. A
document's ids (and the id that ends it) are cut at every full window; a full window
is a sequence by itself. What is left over gathers, cut into pieces of at most
``PIECE`` ids, until it would fill ``BLOCK`` windows. Differencing then deals the
pieces of the block to the least number of windows: every piece starts as a partition
of its own with all windows but one empty, and the two partitions with the largest
imbalance are merged, the fullest window of one with the emptiest of the other, until
one is left. Its windows are nearly equal. If one exceeds the capacity, the number of
windows rises and the block is dealt again.

A sequence's id is its input split's number and a count within, both the same when a
lost task runs again.

Defined cases: a null or empty text is the one id that ends a document; repeated rows
are packed each; other columns are never read; no rows give no sequences.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressmark.llm import bpe_tree

CAPACITY = 1024
PIECE = 512
BLOCK = 128
END = 0


def difference(sizes: np.ndarray, windows: int) -> list[list[int]]:
    """Item numbers of each window after multiway differencing; ties go by item number."""
    order = np.argsort(-sizes, kind="stable")
    left: list[int] = [-1] * len(sizes)  # merged bins are binary trees over the items
    right: list[int] = [-1] * len(sizes)
    heap: list[tuple[int, int, np.ndarray, np.ndarray]] = []
    for rank, item in enumerate(order):
        sums, bins = np.zeros(windows, np.int64), np.full(windows, -1)
        sums[0], bins[0] = sizes[item], item
        heap.append((-int(sizes[item]), rank, sums, bins))  # sums fall from the first window on
    heapq.heapify(heap)
    serial = len(order)
    while len(heap) > 1:
        _, _, sums_a, bins_a = heapq.heappop(heap)
        _, _, sums_b, bins_b = heapq.heappop(heap)
        sums, other = sums_a + sums_b[::-1], bins_b[::-1]
        bins = np.where(bins_a < 0, other, bins_a)
        both = np.flatnonzero((bins_a >= 0) & (other >= 0))
        if len(both):
            left += bins_a[both].tolist()
            right += other[both].tolist()
            bins[both] = np.arange(len(left) - len(both), len(left))
        at = np.argsort(-sums, kind="stable")
        sums, bins = sums[at], bins[at]
        sums -= sums[-1]
        heapq.heappush(heap, (-int(sums[0]), serial, sums, bins))
        serial += 1
    out: list[list[int]] = [[] for _ in range(windows)]
    for w, b in enumerate(heap[0][3].tolist() if heap else []):
        todo = [b] if b >= 0 else []
        while todo:
            k = todo.pop()
            if left[k] < 0:
                out[w].append(k)
            else:
                todo += [left[k], right[k]]
    return out


def deal(sizes: np.ndarray, capacity: int = CAPACITY) -> list[list[int]]:
    """Windows of at most ``capacity``, as few as differencing fills: their number rises until none exceeds it."""
    windows = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        dealt = difference(sizes, windows)
        if max((int(sizes[w].sum()) for w in dealt), default=0) <= capacity:
            return [sorted(w) for w in dealt if w]
        windows += 1


class Packer:
    """Takes documents' ids in order; gives rows (document, start, ids, document's length, sequence, offset)."""

    def __init__(self, first: int = 0, capacity: int = CAPACITY, piece: int = PIECE, block: int = BLOCK):
        self.next, self.capacity, self.piece, self.block = first, capacity, piece, block
        self.waiting: list[tuple[object, int, np.ndarray, int]] = []
        self.size = 0

    def add(self, doc: object, ids: np.ndarray) -> Iterator[tuple]:
        whole = len(ids) // self.capacity * self.capacity
        for a in range(0, whole, self.capacity):
            yield doc, a, ids[a : a + self.capacity], len(ids), self.next, 0
            self.next += 1
        for a in range(whole, len(ids), self.piece):
            p = ids[a : a + self.piece]
            if self.size + len(p) > self.capacity * self.block:
                yield from self.flush()
            self.waiting.append((doc, a, p, len(ids)))
            self.size += len(p)

    def flush(self) -> Iterator[tuple]:
        for window in deal(np.array([len(p[2]) for p in self.waiting], np.int64), self.capacity):
            at = 0
            for k in window:
                doc, a, p, n = self.waiting[k]
                yield doc, a, p, n, self.next, at
                at += len(p)
            self.next += 1
        self.waiting, self.size = [], 0


def pack(docs: DataFrame, file: bytes, end: int = END) -> DataFrame:
    """Pieces of all documents: doc_id, start, ids (little-endian unsigned 32-bit integers), doc_tokens, sequence_id, offset."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def batch_of(rows: list[tuple], arrow: pa.DataType) -> pa.RecordBatch:
        doc, start, ids, n, seq, at = zip(*rows)
        return pa.record_batch(
            [pa.array(doc, arrow), pa.array(start, pa.int64()), pa.array([i.astype("<u4", copy=False).tobytes() for i in ids], pa.binary()), pa.array(n, pa.int64()), pa.array(seq, pa.int64()), pa.array(at, pa.int64())],
            ["doc_id", "start", "ids", "doc_tokens", "sequence_id", "offset"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, last = bpe_tree.TreeEncoder.load(file), np.uint32(end)
        packer = Packer(TaskContext.get().partitionId() << 40)
        for batch in batches:
            keys = batch.column("doc_id").to_pylist()
            at = 0
            for group in bpe_tree.encode_column(encoder, batch.column("text")):
                rows = []
                for doc, ids in zip(keys[at : at + len(group)], group):
                    rows += packer.add(doc, np.append(ids, last))
                at += len(group)
                if rows:
                    yield batch_of(rows, batch.schema.field("doc_id").type)
        if rows := list(packer.flush()):
            yield batch_of(rows, batch.schema.field("doc_id").type)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, start long, ids binary, doc_tokens long, sequence_id long, offset long")


def pieces(docs: DataFrame, file: bytes) -> DataFrame:
    """The digest of pack(): one row per piece."""
    return pack(docs, file).select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("length"), F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op3_packing(spark, sf_dir: str) -> DataFrame:
    return pieces(spark.read.parquet(f"{sf_dir}/documents.parquet"), bpe_tree.tokenizer_file())
