import hashlib
import json
from collections import Counter, defaultdict

import __spark_entry__ as entry
from tests.whole import whole


def test_jaccard_of_all_sources(spark, tmp_path):
    rows = [("en", "a"), ("en", "b"), ("fr", "b"), ("fr", "c"), ("es", "a"), ("es", "a"), ("fr", "a")]
    spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {tuple(r) for r in entry.queries()["mx40_pairwise_jaccard"](spark, str(tmp_path)).select("a", "b", "jaccard").collect()}
    assert got == {("en", "fr", round(2 / 3, 6)), ("en", "es", 0.5), ("es", "fr", round(1 / 3, 6))}


def test_jaccard_against_sql(spark):
    got, want = whole(spark, "mx40_pairwise_jaccard", " WHERE doc_id % 5 = 0")
    assert got == want


def test_citations_of_all_rows(spark):
    got, want = whole(spark, "mx109_citation", "l_orderkey % 10 = 0 AND ")
    assert got == want and any(r[0] % 10 for r in got)


def brute(rows):
    sha = lambda xs: hashlib.sha256(",".join(sorted(xs)).encode()).hexdigest()
    level = defaultdict(list)
    for (k, s), n in Counter(rows).items():
        level[None if k is None else k // 1000].append(json.dumps({a: v for a, v in (("o_orderkey", k), ("o_orderstatus", s), ("n", n)) if v is not None}, separators=(",", ":")))
    for _ in range(2):
        above = defaultdict(list)
        for c, xs in level.items():
            above[None if c is None else c // 1000].append(sha(xs) if c is None else f"{c} {sha(xs)}")
        level = above
    return sha(x for xs in level.values() for x in xs)


def test_register_digest_sees_every_row(spark, tmp_path):
    rows = [(k, "FOP"[k % 3]) for k in (1, 299, 300, 999, 1000, 5000, 1_500_000, 1_500_001, 7_000_000_000)] + [(5000, "P"), (5000, "P"), (4, None), (None, "F")]

    def digest(name, x):
        spark.createDataFrame(x, "o_orderkey long, o_orderstatus string").write.parquet(f"{tmp_path}/{name}/orders.parquet")
        return entry.queries()["mx12_register_digest"](spark, f"{tmp_path}/{name}").first().digest

    first = digest("a", rows)
    assert first == brute(rows) == digest("b", rows[::-1])
    for i, name in ((2, "c"), (8, "d"), (10, "e")):  # a changed row at or above 300, and one repeat less
        changed = rows[:i] + ([(rows[i][0], "X")] if i != 10 else []) + rows[i + 1 :]
        assert digest(name, changed) != first
