"""BPE encoding by tree concatenation, and decoding.

A text longer than a leaf is halved again and again without looking for a good place
to cut; all leaves of a batch are encoded in parallel and joined pairwise upwards.
A join re-encodes only what the cut can have changed:

* The pre-tokenizer's pattern has no look-behind and a piece's end is settled by at most
  two code points after it, so every piece of the left half that ends three or more
  before the cut is a piece of the whole text. Pieces are matched anew from the last
  one on until one ends where a piece of the right half ends as well; from there on
  both agree.
* Where one piece spans the cut, a window of tokens around it is encoded as plain
  BPE and grown until its first token is the left side's and its last token the right
  side's. A sequence of tokens is the BPE encoding of its bytes if every two
  neighbours are that of theirs, so the two sides and the window then make up the
  exact encoding, however long the piece is.

Added tokens split the text before anything else, as in the tokenizer file.

Defined cases: a null text is empty and has no ids; repeated rows get equal results;
other columns are never read. No text is too long: cost is near-linear in its length.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame

LEAF = 8192  # code points
LOOK = 3  # code points before a cut within which a piece may still change
WINDOW = 4  # tokens on either side of a join, at first

#: The byte-level pre-tokenizer's pattern: a fixed value of the tokenizer format.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same pieces, matched without going back into a run.
QUICK = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"

#: A space between two other characters begins a piece, wherever the match came from.
_PARTING = regex.compile(r"(?<=\S) (?=\S)")

_loaded: dict[str, "TreeEncoder"] = {}


def byte_letters() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, others for code points from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


def tokenizer_file(path: str | None = None) -> bytes:
    """The bytes of a tokenizer file, read on the driver; a fixed size, sent to the executors with the task."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, "rb") as f:
        return f.read()


class TreeEncoder:
    def __init__(self, file: bytes, leaf: int = LEAF, threads: int = 2):
        spec = json.loads(file)
        letters = byte_letters()
        model = spec["model"]
        if model["type"] != "BPE" or spec["normalizer"] or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError("a byte-level BPE without normalizer and prefix space is needed")
        self.specials = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        as_bytes = lambda s: bytes(letters[c] for c in s)
        ranks = {as_bytes(s): i for s, i in model["vocab"].items() if s not in self.specials}
        joined = [ranks[as_bytes("".join(m if isinstance(m, list) else m.split(" ")))] for m in model["merges"]]
        if any(a >= b for a, b in zip(joined, joined[1:])):
            raise ValueError("merge order must be id order")
        self.core = tiktoken.Encoding("file", pat_str=QUICK, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(PATTERN)
        self.split = regex.compile("|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True)))) if self.specials else None
        self.leaf, self.threads, self.workers = leaf, threads, ThreadPoolExecutor(threads)
        size = max([*ranks.values(), *self.specials.values()]) + 1
        self.bytes_of: list[bytes] = [b""] * size
        for b, i in ranks.items():
            self.bytes_of[i] = b
        for s, i in self.specials.items():
            self.bytes_of[i] = as_bytes(s) if all(c in letters for c in s) else s.encode()

    @classmethod
    def load(cls, file: bytes, **kw) -> "TreeEncoder":
        key = hashlib.sha256(file).hexdigest() + repr(kw)
        if key not in _loaded:
            _loaded[key] = cls(file, **kw)
        return _loaded[key]

    # -- encoding

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of every text."""
        parts: list[list[str | int]] = []
        leaves: list[str] = []
        for text in texts:
            parts.append(own := [])
            at = 0
            if self.split is not None:
                for m in self.split.finditer(text):
                    own += [text[at : m.start()], self.specials[m.group()]]
                    at = m.end()
            own.append(text[at:])
            for p in own:
                if isinstance(p, str):
                    leaves += self._leaves(p)
        share = -(-len(leaves) // self.threads) or 1
        done = chain.from_iterable(self.workers.map(self._leaves_of, (leaves[k : k + share] for k in range(0, len(leaves), share))))
        out = []
        for own in parts:
            ids = [np.array([p], np.uint32) if isinstance(p, int) else self._tree(p, 0, len(p), done) for p in own]
            out.append(ids[0] if len(ids) == 1 else np.concatenate(ids))
        return out

    def encode(self, text: str) -> list[int]:
        return self.encode_batch([text])[0].tolist()

    def _leaves_of(self, leaves: list[str]) -> list[np.ndarray]:
        encode, none = self.core._core_bpe.encode_to_tiktoken_buffer, set()
        return [np.frombuffer(encode(x, none), np.uint32) for x in leaves]

    def _leaves(self, text: str) -> list[str]:
        out, todo = [], [(0, len(text))]
        while todo:
            a, b = todo.pop()
            if b - a <= self.leaf:
                out.append(text[a:b])
            else:
                todo += [((a + b) // 2, b), (a, (a + b) // 2)]
        return out

    def _tree(self, text: str, a: int, b: int, done: Iterator[np.ndarray]) -> np.ndarray:
        if b - a <= self.leaf:
            return next(done)
        c = (a + b) // 2
        left = self._tree(text, a, c, done)
        return self._join(text, a, c, b, left, self._tree(text, c, b, done))

    def _last_piece(self, text: str, a: int, c: int) -> tuple[int, int]:
        """Where the last piece of text[a:c] that is surely one of the whole text's starts, and how many of its pieces follow.

        Looks back ever further for a place where pieces part wherever the match came from.
        """
        back = 64
        while True:
            u = max(a, c - back)
            if u > a:
                m = _PARTING.search(text, u, c)
                if m is None:
                    back *= 4
                    continue
                u = m.start()
            last, n = u, 0
            for m in self.pattern.finditer(text, u, c):
                n += 1
                if m.start() <= c - LOOK:
                    last, n = m.start(), 1
            return last, n

    def _join(self, text: str, a: int, c: int, b: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        u, n_left = self._last_piece(text, a, c)
        # pieces of the whole from u on, and of the right half from c on, until they end together
        whole, half = self.pattern.finditer(text, u, b), self.pattern.finditer(text, c, b)
        spans: list[tuple[int, int]] = []
        own_end, n_half, end = c, 0, -1
        while end != own_end:
            if end < own_end:
                m = next(whole)
                end = m.end()
                spans.append(m.span())
            else:
                own_end = next(half).end()
                n_half += 1
        if len(spans) == 1 and n_left <= 1 and n_half <= 1:
            return self._join_piece(text[u:c].encode(), text[c:end].encode(), left, right)
        drop_left = self._tokens(left, len(text[u:c].encode()), from_end=True)
        drop_right = self._tokens(right, len(text[c:end].encode()), from_end=False)
        middle: list[int] = []
        for x, y in spans:
            middle += self._piece(text[x:y].encode())
        return np.concatenate([left[: len(left) - drop_left], np.array(middle, np.uint32), right[drop_right:]])

    def _tokens(self, ids: np.ndarray, size: int, from_end: bool) -> int:
        """How many ids at one end make up so many bytes."""
        n = 0
        while size > 0:
            size -= len(self.bytes_of[ids[-1 - n] if from_end else ids[n]])
            n += 1
        return n

    def _piece(self, raw: bytes) -> list[int]:
        """Plain BPE of one piece; a long one by halves."""
        if len(raw) <= 4 * self.leaf:
            return self.core._encode_single_piece(raw)
        c = len(raw) // 2
        left, right = (np.array(self._piece(half), np.uint32) for half in (raw[:c], raw[c:]))
        return self._join_piece(raw[:c], raw[c:], left, right).tolist()

    def _join_piece(self, a: bytes, b: bytes, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """One piece's two parts, at the end of left and at the start of right: windows grow until both sides agree."""
        k = WINDOW
        most_left, most_right = None, None
        while True:
            i, j = self._take(left, len(a), k, True), self._take(right, len(b), k, False)
            most_left, most_right = i[1], j[1]
            window = self.core._encode_single_piece(a[len(a) - i[2] :] + b[: j[2]]) if i[2] + j[2] else []
            left_ok = most_left or (window and window[0] == left[len(left) - i[0]])
            right_ok = most_right or (window and window[-1] == right[j[0] - 1])
            if left_ok and right_ok:
                return np.concatenate([left[: len(left) - i[0]], np.array(window, np.uint32), right[j[0] :]])
            k *= 2

    def _take(self, ids: np.ndarray, size: int, k: int, from_end: bool) -> tuple[int, bool, int]:
        """Up to k ids within the piece's bytes at one end: their number, whether that is all, their bytes."""
        n = got = 0
        while n < k and got < size:
            got += len(self.bytes_of[ids[-1 - n] if from_end else ids[n]])
            n += 1
        return n, got >= size, got

    # -- decoding

    def decode(self, ids: list[int]) -> str:
        table = self.bytes_of
        return b"".join([table[i] for i in ids]).decode("utf-8", "replace")


def encode_column(encoder: TreeEncoder, column: pa.Array, batch_chars: int = 1 << 20) -> Iterator[list[np.ndarray]]:
    """Ids of successive rows, about ``batch_chars`` code points at a time."""
    group: list[str] = []
    size = 0
    for text in column:
        t = text.as_py() or ""
        if group and size + len(t) > batch_chars:
            yield encoder.encode_batch(group)
            group, size = [], 0
        group.append(t)
        size += len(t)
    if group:
        yield encoder.encode_batch(group)


def encode_decode(docs: DataFrame, file: bytes) -> DataFrame:
    """Every row's doc_id, its ids as little-endian unsigned 32-bit integers, and the text they decode to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = TreeEncoder.load(file)
        for batch in batches:
            at = 0
            for ids in encode_column(encoder, batch.column("text")):
                yield pa.record_batch(
                    [batch.column("doc_id").slice(at, len(ids)), pa.array([i.astype("<u4", copy=False).tobytes() for i in ids], pa.binary()), pa.array([encoder.decode(i.tolist()) for i in ids], pa.string())],
                    ["doc_id", "ids", "decoded"],
                )
                at += len(ids)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids binary, decoded string")


def op9_bpe_roundtrip(spark, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    rows = encode_decode(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_file())
    return rows.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
