"""Covering SimHash against all pairs of fingerprints computed one bit at a time."""

import random
import re

import pytest
import xxhash

from pressmark.llm import covering_simhash as c
from tests.llm.fixtures import ODD_TEXTS, docs, prose, write


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints, ids, radius=4):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [least.get(find(i)) for i in range(len(prints))]


def test_every_difference_within_the_radius_is_covered():
    from itertools import combinations

    tables = c.masks(4, list(range(64)))
    assert len(tables) == 31
    cover = [sum(1 << t for t, m in enumerate(tables) if not m >> p & 1) for p in range(64)]
    for four in combinations(cover, 4):
        assert four[0] & four[1] & four[2] & four[3]


def test_second_round_covers_and_bounds_its_buckets():
    rng = random.Random(3)
    first, second = c.masks(4, list(range(64))), c._second(4)
    for t, m in enumerate(first):
        rest = [p for p in range(64) if not m >> p & 1]
        assert all(sum(not s >> p & 1 for p in range(64)) <= 16 for s in second[t])
        for _ in range(50):
            four = rng.sample(rest, 4)
            assert any(not any(s >> p & 1 for p in four) for s in second[t])


def edited(text, rng, n):
    words = text.split(" ")
    for _ in range(n):
        words[rng.randrange(len(words))] = rng.choice(["lake", "moon", "tree"])
    return " ".join(words)


@pytest.mark.parametrize("limit", [2048, 2])
def test_whole_against_all_pairs(spark, limit):
    rng = random.Random(7)
    bases = [prose(200, k) for k in range(12)]
    texts = ODD_TEXTS + bases + [edited(b, rng, k % 4) for b in bases for k in range(5)] + [bases[0].upper(), "one", "ONE", "the long " * 20000]
    ids = [rng.choice([None, k, k, k, 5]) for k in range(len(texts))]
    rows = c.near_duplicates(docs(spark, texts, ids), limit=limit).collect()
    prints = [plain(t) for t in texts]
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in rows) == sorted((str(d), f"{p:016x}", str(k)) for d, p, k in zip(ids, prints, components(prints, ids)))


def test_dense_buckets_go_through_the_second_round(spark):
    rng = random.Random(1)
    base = rng.getrandbits(64)
    values = sorted({base ^ sum(1 << p for p in rng.sample(range(64), rng.randrange(9))) for _ in range(600)} | {rng.getrandbits(64) for _ in range(200)})
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    made = spark.createDataFrame([(s,) for s in signed], "x long")
    want = components(values, signed)
    for limit in (4, 100000):
        found = {r.v: r.root for r in c.connected(c.links(made, limit=limit)).collect()}
        assert [found.get(s, s) for s in signed] == want


def test_query_and_empty_table(spark, tmp_path):
    path = write(spark, tmp_path, [prose(50, 1), prose(50, 1), None])
    rows = c.op12_covering_simhash(spark, path).collect()
    assert sorted((r.doc_id, r.component_id) for r in rows) == [(0, 0), (1, 0), (2, 2)]
    assert c.near_duplicates(docs(spark, [])).collect() == []


def test_other_kinds_of_ids(spark):
    from pyspark.sql import functions as F

    own = docs(spark, [prose(50, 1), prose(50, 1)]).withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")))
    assert sorted((r.doc_id, r.component_id) for r in c.near_duplicates(own).collect()) == [("d0", "d0"), ("d1", "d0")]
