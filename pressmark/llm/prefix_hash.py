"""Document fingerprints from prefix polynomial hashes.

A text of n code points gets two modular prefix arrays, from which the hash of any of
its spans comes in a few operations. So any two spans of any texts are compared
without reading them, and the longest common extension of two positions is found by
binary search. The fingerprint is the whole text's length and hash with the ``KEEP``
smallest hashes of its spans of ``SPAN`` code points; likeness is the share of the
smallest hashes of two fingerprints together that both have.

An edited text's fingerprint is read off the arrays of the texts it is made of; only
the spans across the seam are hashed anew.

Defined cases: a null text is empty; a text shorter than a span is one span; an empty
text has no spans, is wholly like another empty text and unlike any other; documents
with the same id follow each other by text; the only document follows itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressmark.llm.flat import mixed
from pressmark.llm.ranges import with_successors

PRIME = 2**31 - 1
BASES = (1_000_003_019 % PRIME, 1_234_567_891 % PRIME)
SPAN = 24
KEEP = 32
_tables: dict[tuple[int, bool], np.ndarray] = {}


def _reduced(x: np.ndarray) -> np.ndarray:
    """x modulo the Mersenne prime, for 0 <= x < 2 ** 62."""
    x = (x & PRIME) + (x >> 31)
    x = (x & PRIME) + (x >> 31)
    return np.where(x >= PRIME, x - PRIME, x)


def _powers(n: int, base: int, inverse: bool = False) -> np.ndarray:
    have = _tables.get((base, inverse))
    if have is None or len(have) < n:
        step = pow(base, -1, PRIME) if inverse else base
        have = np.ones(1, np.int64)
        while len(have) < max(n, 1 << 14):
            have = np.concatenate([have, _reduced(have * pow(step, len(have), PRIME))])
        _tables[base, inverse] = have
    return have[:n]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.int64) + 1


class PrefixHash:
    """Prefix arrays of one sequence of positive integers under 2 ** 31."""

    def __init__(self, points: np.ndarray):
        self.n = len(points)
        self.prefix = []
        for base in BASES:
            sums = np.zeros(self.n + 1, np.int64)
            np.cumsum(_reduced(points * _powers(self.n, base)), out=sums[1:])
            self.prefix.append(_reduced(sums))

    def spans(self, starts: np.ndarray, length: int) -> np.ndarray:
        """62-bit hashes of the spans [starts, starts + length)."""
        out = []
        for base, p in zip(BASES, self.prefix):
            d = p[starts + length] - p[starts]
            d += PRIME * (d < 0)
            out.append(_reduced(d * _powers(self.n + 1, base, True)[starts]))
        return (out[0].astype(np.uint64) << np.uint64(31)) | out[1].astype(np.uint64)

    def span(self, start: int, length: int) -> int:
        both = 0
        for base, p in zip(BASES, self.prefix):
            both = both << 31 | (int(p[start + length]) - int(p[start])) * int(_powers(self.n + 1, base, True)[start]) % PRIME
        return both

    def all_spans(self, length: int = SPAN) -> np.ndarray:
        """The mixed hashes of all spans of that length, by start; of the whole sequence if it is shorter."""
        if not self.n:
            return np.zeros(0, np.uint64)
        length = min(length, self.n)
        out = []
        for base, p in zip(BASES, self.prefix):
            d = p[length:] - p[:-length]
            d += PRIME * (d < 0)
            out.append(_reduced(d * _powers(self.n + 1 - length, base, True)))
        return mixed((out[0].astype(np.uint64) << np.uint64(31)) | out[1].astype(np.uint64))

    def equal(self, start: int, other: "PrefixHash", other_start: int, length: int) -> bool:
        """Whether two spans are equal."""
        return self.span(start, length) == other.span(other_start, length)

    def common_extension(self, start: int, other: "PrefixHash", other_start: int, most: int | None = None) -> int:
        """The length of the longest span that starts at both places, by binary search."""
        low, high = 0, min(self.n - start, other.n - other_start)
        if most is not None:
            high = min(high, most)
        while low < high:
            mid = (low + high + 1) // 2
            if self.equal(start, other, other_start, mid):
                low = mid
            else:
                high = mid - 1
        return low


def smallest(hashes: np.ndarray, keep: int = KEEP) -> np.ndarray:
    """The ``keep`` smallest distinct hashes, sorted."""
    few = 4 * keep
    if len(hashes) > few:
        found = np.unique(np.partition(hashes, few)[:few])
        if len(found) >= keep:
            return found[:keep]
    return np.unique(hashes)[:keep]


def fingerprint(n: int, whole: int, kept: np.ndarray) -> str:
    return f"{n:x}.{whole:016x}." + "".join(f"{int(k) >> 32:08x}" for k in kept)


def of_text(h: PrefixHash) -> tuple[str, np.ndarray]:
    kept = smallest(h.all_spans())
    return fingerprint(h.n, h.span(0, h.n), kept), kept


def likeness(a: str, b: str, keep: int = KEEP) -> float:
    """From 0 to 1; equal fingerprints are 1."""
    if a == b:
        return 1.0
    x, y = (np.frombuffer(bytes.fromhex(f.rsplit(".", 1)[1]), ">u4") for f in (a, b))
    if not len(x) or not len(y):
        return 0.0
    union = np.union1d(x, y)[:keep]
    return float((np.isin(union, x) & np.isin(union, y)).sum() / len(union))


class Document:
    """A text with its prefix arrays and span hashes."""

    def __init__(self, key: object, text: str | None):
        self.key, self.text = key, text or ""
        self.points = code_points(self.text)
        self.hash = PrefixHash(self.points)
        self.spans = self.hash.all_spans()
        self.print = fingerprint(self.hash.n, self.hash.span(0, self.hash.n), smallest(self.spans))

    def edited(self, other: "Document") -> tuple[str, str, int]:
        """The text whose last quarter is replaced by as many code points of the other; its fingerprint; where it first differs."""
        n = self.hash.n
        q = n // 4
        head, m = n - q, min(q, other.hash.n)
        text = self.text[:head] + other.text[:m]
        same = min(n, head + self.hash.common_extension(head, other.hash, 0, m))
        if head < SPAN or m < SPAN:
            return text, of_text(PrefixHash(np.concatenate([self.points[:head], other.points[:m]])))[0], same
        seam = PrefixHash(np.concatenate([self.points[head - SPAN + 1 : head], other.points[: SPAN - 1]])).all_spans()
        kept = smallest(np.concatenate([smallest(self.spans[: head - SPAN + 1]), smallest(other.spans[: m - SPAN + 1]), seam]))
        whole = 0
        for base, p, o in zip(BASES, self.hash.prefix, other.hash.prefix):
            whole = whole << 31 | (int(p[head]) + int(o[m]) * pow(base, head, PRIME)) % PRIME
        return text, fingerprint(head + m, whole, kept), same


def fingerprints(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """Per document: its text's and its edited text's fingerprints, likenesses to the edited text and to the next document, and where the edit shows."""
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = with_successors(docs.select("doc_id", "text"), "doc_id", ["text"], parts or int(spark.conf.get("spark.sql.shuffle.partitions")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "edit_at"]
        kinds = [None, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()]
        last: Document | None = None
        over = False
        for batch in batches:
            kinds[0] = batch.schema.field("doc_id").type
            out: list[tuple] = []
            for key, text, follows in zip(batch.column("doc_id"), batch.column("text"), batch.column("_follows")):
                if over:
                    break
                doc = Document(key.as_py(), text.as_py())
                if last is not None:
                    edited, edited_print, at = last.edited(doc)
                    out.append((last.key, last.hash.n, hashlib.sha256(edited.encode()).hexdigest(), last.print, edited_print, likeness(last.print, edited_print), likeness(last.print, doc.print), at))
                over = follows.as_py()
                last = doc
            if out:
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    return rows.mapInArrow(run, f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, edit_at long")


def op5_fingerprints(spark, sf_dir: str) -> DataFrame:
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
