"""Links of every fiftieth document of the test tables with all others, by similarity, against all pairs."""

import os

import numpy as np
import pytest

from pressmark.llm import order_minhash as N

FOLDER = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_recall_by_similarity(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}
    classes = {r.doc_id: r.class_id for r in N.near_duplicates(docs).collect()}
    assert len(classes) == len(texts)
    seqs = {i: N._shingles_of(t) for i, t in texts.items()}
    # ask with every fiftieth, and with a lightly and a more edited form of each, put among the texts by their sketches
    linked = 0
    for i in (i for i in seqs if i % 50 == 0 and len(seqs[i])):
        for j in seqs:
            if i != j and len(seqs[j]) and N.distance(seqs[i], seqs[j])[1] is not None:
                linked += 1
                assert classes[i] == classes[j], (i, j)
    # no two classes' first members are linked with each other, as far as every fiftieth shows
    firsts = sorted(set(classes.values()))
    for a in firsts[::50]:
        for b in firsts:
            assert a == b or not len(seqs[a]) or not len(seqs[b]) or N.distance(seqs[a], seqs[b])[1] is None, (a, b)


def test_sketches_meet_by_similarity():
    """Of pairs in each step of similarity from 0.8, at least 999 of 1000 share a bucket."""
    import random

    import pyarrow as pa

    from pressmark.llm import flat

    r = random.Random(3)
    met: dict = {}
    for _ in range(400):
        w = [f"w{r.randrange(5000)}" for _ in range(r.randint(80, 400))]
        v = list(w)
        for _ in range(r.randint(1, max(1, len(w) // 40))):
            k = r.randrange(len(v))
            v[k : k + 1] = r.choice([["changed"], [], [v[k], "added"]])
        a, b = (N._shingles_of(" ".join(x)) for x in (w, v))
        d = N.distance(a, b)[1]
        if d is None:
            continue
        n = len(a) + len(b)
        m = (n - d) // 2
        s, _ = N.sketches(*flat.text_buffers(pa.array([" ".join(w), " ".join(v)])))
        met.setdefault(int(20 * m / (n - m)), []).append(bool((s[0] == s[1]).any()))
    assert sum(map(len, met.values())) > 150 and min(met) == 16
    assert all(np.mean(x) >= 0.999 for x in met.values())


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_no_link_of_whole_sets_is_lost(spark):
    """Every two texts whose sets of five-word shingles have a Jaccard of 0.8 or more are in one class, over all pairs."""
    import re
    from collections import Counter, defaultdict

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    sets = {}
    for r in docs.select("doc_id", "text").collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        sets[r.doc_id] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    df = Counter(x for s in sets.values() for x in s)
    rare, links = defaultdict(list), []
    for i, s in sets.items():  # two such sets have one of the rarest fifth in common
        first = sorted(s, key=lambda x: (df[x], x))[: len(s) // 5 + 1]
        for j in {j for x in first for j in rare[x]}:
            if 5 * len(s & sets[j]) >= 4 * len(s | sets[j]):
                links.append((i, j))
        for x in first:
            rare[x].append(i)
    classes = {r.doc_id: r.class_id for r in N.near_duplicates(docs).collect()}
    assert len(links) > 50
    assert [p for p in links if classes[p[0]] != classes[p[1]]] == []
