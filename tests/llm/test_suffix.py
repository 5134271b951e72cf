import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from pressmark.llm import suffix_array as S
from pressmark.llm import suffix_dedup as D
from tests.llm.fixtures import ODD_TEXTS, docs, prose, write

W = D.WINDOW


def test_suffix_array_prefixes_and_search():
    r = np.random.default_rng(0)
    for t in range(150):
        n = int(r.integers(0, 300))
        x = (r.integers(0, int(r.integers(1, 4)), n) + 97).astype(np.uint8)
        if t % 2 and n > 50:
            x[30:50] = x[0:20]
        b = x.tobytes()
        sa = S.suffix_array(x, 1 << 12)
        lcp = S.common_prefixes(x, sa)
        assert sorted(sa.tolist()) == list(range(n))
        for k in range(1, n):
            i, j, m = sa[k - 1], sa[k], 0
            while i + m < n and j + m < n and b[i + m] == b[j + m]:
                m += 1
            assert lcp[k] == m and b[i:] + b"\xff" * 400 <= b[j:] + b"\xff" * 400
        if n > 12:
            for length in (7, 8, 11):
                at = r.integers(0, n - 11, 10)
                words = np.concatenate([S.words8(x), np.full(16, 2**64 - 1, np.uint64)])
                for a, low, high in zip(at, *S.search(words, sa, S.spread(words, at, length), length)):
                    assert sorted(sa[low:high].tolist()) == [i for i in range(n - length + 1) if b[i : i + length] == b[a : a + length]]


def brute(texts):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + W] for r in raws for i in range(len(r) - W + 1))
    out = []
    for r in raws:
        hit = np.zeros(len(r) + 1, bool)
        for i in range(len(r) - W + 1):
            if seen[r[i : i + W]] > 1:
                hit[i : i + W] = True
        kept = bytes(c for c, h in zip(r, hit) if not h)
        out.append((len(r), int(hit.sum()), int((np.diff(np.concatenate([[0], hit.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def mixed_texts(seed):
    r = random.Random(seed)
    passages = [prose(r.randint(20, 90), 1000 + k) for k in range(6)]
    texts = []
    for k in range(60):
        parts = [prose(r.randint(1, 60), seed * 100 + k)]
        for _ in range(r.randint(0, 2)):
            parts.insert(r.randint(0, len(parts)), r.choice(passages)[r.randint(0, 40) :])
        texts.append(" ".join(parts))
    return [*texts, texts[0], texts[0], texts[3] + "é" * 150, "é" * 150 + texts[4], "ab" * 400, "x" * 199, "x" * 201, *ODD_TEXTS]


def check(spark, path, texts):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in D.op10_suffix_dedup(spark, write(spark, path, texts)).collect()}
    want = dict(enumerate(brute(texts)))
    assert {k: (v, want[k]) for k, v in got.items() if v != want[k]} == {} and len(got) == len(want)


@pytest.mark.parametrize("seed", [1, 2])
def test_op10(spark, tmp_path, seed):
    check(spark, tmp_path, mixed_texts(seed))


def test_small_shards_and_hot_grams(spark, tmp_path, monkeypatch):
    texts = mixed_texts(5) + [prose(10, 9000 + k) + passage for k, passage in enumerate([prose(60, 77)] * 40)]
    flags = {}
    for shard in (300, 5000, 1 << 20):
        pieces = [t.encode()[:400] for t in texts if t and len(t.encode()) > 400]
        pieces = sorted(set(pieces))
        n = np.array([len(p) - W + 1 for p in pieces])
        flags[shard] = [f.tolist() for f in D.repeated_windows(pieces, n, np.ones(len(pieces), np.int64), np.zeros(len(pieces), np.int64), shard)]
    assert flags[300] == flags[5000] == flags[1 << 20] and any(any(f) for f in flags[300])
    seen = Counter(p[i : i + W] for p in pieces for i in range(len(p) - W + 1))
    assert flags[300] == [[seen[p[i : i + W]] > 1 for i in range(len(p) - W + 1)] for p in pieces]
    # every gram dealt finer
    cut = D._cut
    import pyarrow as pa

    raw = texts[-1].encode()
    row = {"gram": 1, "context": 2, "start": 3, "lead": 133, "count": 130, "n": 1, "hot": True}
    kind = pa.list_(pa.struct([("gram", pa.int64()), ("context", pa.int64()), ("start", pa.int64()), ("lead", pa.int64()), ("count", pa.int64()), ("n", pa.int64()), ("hot", pa.bool_())]))
    batch = pa.record_batch([pa.array([texts[-1]]), pa.array([[row]], kind)], ["text", "wanted"])
    out = next(cut(iter([batch]))).to_pylist()
    assert sum(o["count"] for o in out) == 130 and all(o["bytes"] == raw[3 + o["uses"][0]["first"] : 3 + o["uses"][0]["first"] + o["count"] - 1 + W] for o in out)
    monkeypatch.setattr(D, "HOT", 1)
    check(spark, tmp_path, texts)


def test_cleaned_keeps_columns(spark, tmp_path):
    texts = [prose(80, 1), prose(80, 1), "short", None, prose(90, 2)]
    rows = {r.doc_id: r for r in D.cleaned(docs(spark, texts)).collect()}
    assert rows[0].text == "" and rows[0].n_chars == 0 and rows[2].text == "short" and rows[3].text is None and rows[4].text == texts[4] and rows[4].score == "clash"
    assert D.op10_suffix_dedup(spark, write(spark, tmp_path, [])).count() == 0


def test_a_common_passage_is_one_piece_of_a_route(spark):
    """Twice as many texts with one passage leave the rows of a route as they are: equal pieces are merged before the shuffle."""
    import pyarrow as pa

    rng = random.Random(8)
    passage = bytes(rng.choice(b"abcdefgh ") for _ in range(600))

    def rows(n):
        """The cut of n texts, all windows wanted and hot, dealt to two tasks."""
        out = []
        for task in range(2):
            texts = [(bytes(rng.choice(b"ijklmnop ") for _ in range(300)) + passage + bytes(rng.choice(b"ijklmnop ") for _ in range(300))).decode() for _ in range(n // 2)]
            wanted = []
            for t in texts:
                own, gram, context, start, anchor, count = D.anchors(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]))
                wanted.append([{"gram": g, "context": c, "start": a, "lead": p - a, "count": k, "n": 1, "hot": True} for g, c, a, p, k in zip(gram.view(np.int64).tolist(), context.view(np.int64).tolist(), start.tolist(), anchor.tolist(), count.tolist())])
            out += [r for b in D._cut(iter([pa.record_batch([pa.array(texts), pa.array(wanted)], ["text", "wanted"])])) for r in b.to_pylist()]
        return out

    few, many = (max(Counter((r["route"], r["bytes"]) for r in rows(n)).values()) for n in (200, 400))
    assert few == many == 2  # one of each task
