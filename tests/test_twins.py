"""Queries without SQL against plain Python, row by row."""

import math
import re
from collections import Counter

import xxhash
from pyspark.sql import functions as F

import __spark_entry__ as entry
from pressmark.operators.care import highlighted

FOLDER = "/root/testdata/sf0.001"


def table(spark, name):
    return spark.read.parquet(f"{FOLDER}/{name}.parquet").collect()


def tokens(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def test_stub_embedding(spark):
    """A bag of tokens over 16 places by XXH64 (seed 42, signed), at length one."""
    want = {}
    for r in table(spark, "benchmark"):
        v = [0.0] * 16
        for t in tokens(r.text):
            h = xxhash.xxh64(t.encode(), seed=42).intdigest()
            v[(h - (1 << 64) if h >> 63 else h) % 16] += 1.0
        n = math.sqrt(sum(x * x for x in v))
        want[r.item_id] = [round(x / n if n else x, 12) for x in v]
    got = {r.item_id: [round(x, 12) for x in r.v] for r in entry.queries()["rt29_stub_embedding"](spark, FOLDER).collect()}
    assert got == want


def test_highlight(spark):
    """Every word in order; a hit is a term, its plural or singular, or begins with the five first letters of a term that has as many."""

    def stem(w):
        return w[:-1] if len(w) > 3 and w.endswith("s") else w

    def hit(word, terms):
        bare = re.sub(r"[\W_]", "", word).lower()
        return any(stem(bare) == stem(t) or len(stem(t)) >= 5 and bare.startswith(stem(t)[:5]) for t in terms)

    rows = table(spark, "benchmark")
    got = {r.item_id: [tuple(w) for w in r.words] for r in entry.queries()["rt30_highlight"](spark, FOLDER).collect()}
    assert got == {r.item_id: [(w, hit(w, ("eaten", "theas"))) for w in (r.text or "").split()] for r in rows}
    common = Counter(t for r in rows for t in tokens(r.text) if len(t) > 4).most_common(3)
    terms = [common[0][0], common[1][0] + "s", common[2][0][:5] + "zzz"]
    some = spark.read.parquet(f"{FOLDER}/benchmark.parquet").select("item_id", highlighted(F.col("text"), F.array(*map(F.lit, terms))).alias("words")).collect()
    assert {r.item_id: [tuple(w) for w in r.words] for r in some} == {r.item_id: [(w, hit(w, terms)) for w in (r.text or "").split()] for r in rows}
    assert sum(w.hit for r in some for w in r.words) > 3
