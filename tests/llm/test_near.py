import random
from collections import Counter

import numpy as np
import pytest

from pressmark.llm import order_minhash as N
from pressmark.llm.components import connected
from tests.llm.fixtures import ODD_TEXTS, docs, prose, write


def seq(text):
    w = (text or "").split()
    return [tuple(w[i : i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)] if w else []


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        left = 0
        for j, y in enumerate(b):
            keep = row[j + 1]
            row[j + 1] = left + 1 if x == y else max(row[j + 1], row[j])
            left = keep
    return row[-1]


def test_banded_subsequence():
    r = random.Random(0)
    for k in range(400):
        a = [r.randrange(r.choice([2, 5, 40])) for _ in range(r.randint(1, 300))]
        b = [x for x in a if r.random() > 0.03]
        for _ in range(r.randint(0, 6)):
            b.insert(r.randint(0, len(b)), r.randrange(5))
        if k % 5 == 0:
            b = [r.randrange(5) for _ in range(r.randint(1, 300))]
        true = len(a) + len(b) - 2 * lcs(a, b)
        least, most = N.distance(np.array(a), np.array(b))
        limit = N.band(len(a) + len(b))
        assert least <= true and (most == true if true <= limit else most is None)
        m, n = lcs(a, b), len(a) + len(b)
        assert (true <= limit) == (5 * m >= 4 * (n - m))


def test_shingles_and_order():
    import pyarrow as pa

    from pressmark.llm import flat

    texts = ["a b c d e f g", "a b c", None, "", "a b c d e", "a b c d e f g a b c d e"]
    data, offs = flat.text_buffers(pa.array(texts, pa.string()))
    h, n = N.shingles(data, offs)
    assert n.tolist() == [len(seq(t)) for t in texts]
    flatseq = [s for t in texts for s in seq(t)]
    assert len(set(zip(h.tolist(), flatseq))) == len(set(flatseq)) == len(set(h.tolist()))
    # the same shingles in another order agree in fewer sketches than a light edit
    w = prose(400, 3).split()
    moved, edited = w[200:] + w[:200], w[:100] + ["new"] + w[101:]
    s, _ = N.sketches(*flat.text_buffers(pa.array([" ".join(x) for x in (w, moved, edited)])))
    assert (s[0] == s[2]).sum() > (s[0] == s[1]).sum() and (s[0] == s[2]).sum() >= 15


def brute(texts):
    seqs = [seq(t) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if texts[i] == texts[j] and seqs[i] or seqs[i] and seqs[j] and min(len(seqs[i]), len(seqs[j])) >= 0.8 * max(len(seqs[i]), len(seqs[j])) and sum((Counter(seqs[i]) & Counter(seqs[j])).values()) > 0:
                m = lcs(seqs[i], seqs[j])
                if 5 * m >= 4 * (len(seqs[i]) + len(seqs[j]) - m):
                    a, b = sorted((find(i), find(j)))
                    root[b] = a
    return {i: find(i) for i in range(len(texts))}


def edited(text, edits, r):
    w = text.split(" ")
    for _ in range(edits):
        k = r.randrange(len(w))
        w[k : k + 1] = r.choice([["changed"], [], [w[k], "added"]])
    return " ".join(w)


@pytest.mark.parametrize("seed", [1, 2])
def test_op8(spark, tmp_path, monkeypatch, seed):
    if seed == 2:
        monkeypatch.setattr(N, "BLOCK", 3)  # several blocks for a leader
    r = random.Random(seed)
    base = [prose(r.randint(30, 150), seed * 50 + k) for k in range(25)]
    texts = base + [edited(t, e, r) for t in base for e in (1, 3, 8)] + base[:3] + ODD_TEXTS
    chain = prose(120, 999)
    for _ in range(12):
        texts.append(chain)
        chain = edited(chain, 1, r)
    r.shuffle(texts)
    got = {x.doc_id: x.class_id for x in N.op8_order_minhash(spark, write(spark, tmp_path, texts)).collect()}
    assert got == brute(texts)
    kept = N.keep(docs(spark, texts)).collect()
    assert sorted(x.doc_id for x in kept) == sorted(set(got.values())) and all(x.score == "clash" for x in kept)


def test_empty_repeated_and_components(spark, tmp_path):
    assert N.op8_order_minhash(spark, write(spark, tmp_path, [])).count() == 0
    rows = N.near_duplicates(docs(spark, ["same words", "same words", "same words", None, None], [4, 4, None, 7, 8])).collect()
    assert sorted((x.doc_id or -1, x.class_id) for x in rows) == [(-1, 4), (4, 4), (4, 4), (7, 7), (8, 8)]
    assert N.keep(docs(spark, ["same words", "same words", "same words", None], [4, 4, None, 7])).count() == 2
    chain = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 102), (102, 100), (7, 7)], "a int, b int")
    assert {(x.v, x.root) for x in connected(chain).collect()} == {(i, 0) for i in range(1, 61)} | {(101, 100), (102, 100)}


def dealt_rows(spark, inside, outside):
    rows = [("lead", 1, 0, f"m{i}", "core", 10) for i in range(inside)] + [("lead", 1, 0, f"o{i}", f"o{i}", 10) for i in range(outside)]
    rows += [("calm", 1, 0, f"c{i}", "one", 10) for i in range(50)]
    return N.dealt(spark.createDataFrame(rows, "a string, salts int, salt int, b string, root string, n int")).collect()


def test_dealing_is_linear_in_the_largest_class(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 16)
    counts = [len(dealt_rows(spark, n, 3)) for n in (100, 200, 400)]
    assert counts[1] <= 2 * counts[0] and counts[2] <= 2 * counts[1] and counts[0] < 130
    rows = dealt_rows(spark, 40, 40)
    assert {r.a for r in rows} == {"lead"}
    met = set()
    tasks = {}
    for r in rows:
        tasks.setdefault((r.x, r.y), []).append(r)
    for (x, y), own in tasks.items():
        assert len(own) <= 4 * 16
        for p in own:
            for q in own:
                if p.b < q.b and (x == y or p.side != q.side):
                    assert (p.b, q.b) not in met
                    met.add((p.b, q.b))
    core, out = [f"m{i}" for i in range(40)], [f"o{i}" for i in range(40)]
    assert met == {tuple(sorted((p, q))) for p in out for q in core + out if p != q}


def test_components_over_shuffles_are_those_of_one_task(spark):
    r = random.Random(9)
    edges = [(f"v{r.randrange(300):03d}", f"v{r.randrange(300):03d}") for _ in range(220)] + [(f"hub{i % 3}", f"leaf{i}") for i in range(60)] + [(None, "v001")]
    df = spark.createDataFrame(edges, "a string, b string")
    one, many = ({(x.v, x.root) for x in connected(df, small).collect()} for small in (1 << 20, 0))
    assert one == many and len(one) > 100
    assert connected(df.limit(0), 0).count() == 0 and connected(df.limit(0)).count() == 0


def test_columns_of_the_same_names_stay(spark):
    from pyspark.sql import functions as F

    from pressmark.llm import suffix_dedup

    own = docs(spark, [prose(80, 1), prose(80, 1), prose(80, 2), None]).withColumns({c: F.lit("mine") for c in ("_digest", "_runs", "digest", "runs", "_id", "text_digest", "held_by", "spans_cut")})
    for f, n in ((N.keep, 3), (suffix_dedup.cleaned, 4)):
        out = f(own)
        assert out.columns == own.columns
        rows = out.collect()
        assert len(rows) == n and all(x[c] == "mine" for x in rows for c in ("_digest", "_runs", "digest", "text_digest", "held_by", "spans_cut"))


def test_a_large_class_is_dealt_out(spark):
    """A join by root whose large class is dealt out gives the rows of the plain join."""
    from pressmark.llm.order_minhash import by_root

    rows = spark.range(5000).selectExpr("id AS digest", "IF(id < 3000, 1L, id) AS root")
    roots = spark.range(4000).selectExpr("id AS root", "-id AS above")
    for how in ("left", "inner"):
        got = by_root(rows, roots, how)
        assert sorted(map(str, got.select("digest", "root", "above").collect())) == sorted(map(str, rows.join(roots, "root", how).select("digest", "root", "above").collect()))
    assert by_root(rows.limit(0), roots, "left").count() == 0 and by_root(rows, roots.limit(0), "left").count() == 5000
