"""Retrieval: postings, BM25, exact dense search, fusion, soft weights, routing and merging.

A batch of questions is a table (q, term); only postings of those terms are read. Every
ranking ends in the passage's id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pressmark.functions import periods, text
from pressmark.session import checkpointed

K1, B, RRF_K = 1.2, 0.75, 60
SALT = 8  # files that hold a term's postings
QUALITY_WEIGHTS = {"high": 1.0, "medium": 0.9, "low": 0.75}
SECTION_WEIGHTS = {"front": 0.5, "body": 1.0, "back": 0.5}


@dataclass(frozen=True)
class RetrieveConfig:
    """Every switch of a retrieval and its default."""

    candidates: int = 200
    top_k: int = 10
    per_item: int = 3
    rrf_k: int = RRF_K
    dense_weight: float = 1.0
    drop_stopwords: bool = True


def repeated(docs: DataFrame, key: str) -> bool:
    """Whether any key is held by several rows; reads the keys alone."""
    return not docs.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1").isEmpty()


def counted_tokens(ts: Column) -> Column:
    """array<struct(term, tf)>: the different tokens of a list and how often each is in it, by its sorted order."""
    starts = lambda s: F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
    run = lambda s, at: F.transform(at, lambda i, n: F.struct(F.get(s, i).alias("term"), (F.coalesce(F.get(at, n + 1), F.size(s)) - i).cast("long").alias("tf")))
    counted = lambda s: F.transform(F.array(starts(s)), lambda at: run(s, at))[0]
    return F.get(F.transform(F.filter(F.array(F.sort_array(ts)), lambda s: F.size(s) > 0), counted), 0)  # null without tokens


def postings(docs: DataFrame, key: str, column: str, only: list[str] | None = None) -> DataFrame:
    """term, key, tf, dl: one row for each different token of a document, or each that is among ``only`` (the terms of a question).

    A document's tokens are counted where its text is, without a shuffle; where rows share a key, which a pass over the keys tells, they count together.
    """
    t = docs.select(key, text.tokens(column).alias("ts"))
    if only is None and not repeated(docs, key):
        return t.select(key, F.size("ts").alias("dl"), F.explode(counted_tokens(F.col("ts"))).alias("p")).select("p.term", key, "p.tf", "dl")
    rows = t.select(key, F.size("ts").alias("dl"), F.explode("ts" if only is None else F.filter("ts", lambda w: w.isin(only))).alias("term"))
    return rows.groupBy("term", key).agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))


def frequencies_by(docs: DataFrame, key: str, column: str, group: str) -> DataFrame:
    """group, term, df: in how many documents of each group a term is. A task adds up its own documents before anything is shuffled."""
    if repeated(docs, key):
        rows = postings(docs, key, column).join(docs.select(key, group), key)
    else:
        rows = docs.filter(F.col(key).isNotNull()).select(group, F.explode(F.array_distinct(text.tokens(column))).alias("term"))
    return rows.groupBy(group, "term").agg(F.count("*").alias("df"))


def collection(docs: DataFrame, column: str) -> DataFrame:
    """One row: documents and tokens."""
    return docs.agg(F.count("*").alias("n"), F.sum(F.size(text.tokens(column))).alias("tokens"))


def frequencies(post: DataFrame) -> DataFrame:
    return post.groupBy("term").agg(F.count("*").alias("df"))


def idf(n: Column, df: Column) -> Column:
    return F.log1p((n - df + 0.5) / (df + 0.5))


def bm25_weight(tf: Column, dl: Column, n: Column, tokens: Column, df: Column) -> Column:
    return idf(n, df) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / (tokens / n)))


def bm25(post: DataFrame, stats: DataFrame, questions: DataFrame, key: str) -> DataFrame:
    """q, key, score of every document with a term of the question. questions: (q, term); a batch of any size, broadcast only where its size is known to be small."""
    wanted = post.join(questions.select("term").distinct(), "term", "left_semi")
    scored = wanted.join(frequencies(wanted), "term").crossJoin(F.broadcast(stats))  # one row
    weight = bm25_weight(F.col("tf"), F.col("dl"), F.col("n"), F.col("tokens"), F.col("df"))
    return scored.select("term", key, weight.alias("w")).join(questions, "term").groupBy("q", key).agg(F.sum("w").alias("score"))


def bm25_once(docs: DataFrame, key: str, column: str, terms: list[str]) -> DataFrame:
    """key, score of every document with a term of one question: texts are taken apart once, and nothing is shuffled.

    What is kept of a document is its length and its tokens that the question asks for; the collection's
    size and the terms' frequencies are one row, which meets every document that holds a term.
    """
    if not terms:
        return docs.select(key, F.lit(None).cast("double").alias("score")).limit(0)
    t = docs.select(key, text.tokens(column).alias("ts"))
    kept = checkpointed(t.select(key, F.size("ts").alias("dl"), F.filter("ts", lambda w: w.isin(terms)).alias("hits")))
    df = {w: F.count_if(F.array_contains("hits", w)).alias(f"df_{i}") for i, w in enumerate(terms)}
    one = kept.agg(F.count("*").alias("n"), F.sum("dl").alias("tokens"), *df.values())
    score = F.lit(0.0)
    for i, w in enumerate(terms):
        tf = F.size(F.filter("hits", _is(w)))
        score = score + F.when(tf > 0, bm25_weight(tf, F.col("dl"), F.col("n"), F.col("tokens"), F.col(f"df_{i}"))).otherwise(0.0)
    return kept.filter(F.size("hits") > 0).crossJoin(F.broadcast(one)).select(key, score.alias("score"))  # one row


def _is(word: str):
    return lambda x: x == word


def write_index(docs: DataFrame, key: str, column: str, path: str, parts: int = 64) -> None:
    """Keeps postings in order of term in ``parts`` files (a common term's are dealt to several), their frequencies, and the collection's size.

    By hash, for ranges would be found by taking all texts apart once more.
    """
    post = postings(docs, key, column)
    post.repartition(parts, "term", F.pmod(F.xxhash64(key), F.lit(SALT))).sortWithinPartitions("term", key).write.mode("overwrite").parquet(f"{path}/postings")
    frequencies(docs.sparkSession.read.parquet(f"{path}/postings")).sort("term").write.mode("overwrite").parquet(f"{path}/frequencies")
    collection(docs, column).write.mode("overwrite").parquet(f"{path}/collection")


def indexed_bm25(spark, path: str, questions: DataFrame, terms: list[str], key: str) -> DataFrame:
    """q, key, score from a kept index: only the row groups that hold one of the questions' terms are read."""
    read = lambda name: spark.read.parquet(f"{path}/{name}")
    found = read("postings").filter(F.col("term").isin(terms)).join(read("frequencies").filter(F.col("term").isin(terms)), "term").crossJoin(F.broadcast(read("collection")))
    weight = bm25_weight(F.col("tf"), F.col("dl"), F.col("n"), F.col("tokens"), F.col("df"))
    return found.select("term", key, weight.alias("w")).join(questions, "term").groupBy("q", key).agg(F.sum("w").alias("score"))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def normalised(v: Column) -> Column:
    """The vector at length one; a zero vector stays."""
    n = norm(v)
    return F.transform(v, lambda x: F.when(n > 0, x / n).otherwise(0.0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def doubles(c: str) -> Column:
    return F.col(c).cast("array<double>")


def dense_top(vectors: DataFrame, key: str, column: str, query: DataFrame, k: int) -> DataFrame:
    """The k nearest by cosine to the one vector of query (column ``v``): a scan, no index."""
    asked = F.broadcast(query.select(F.col("v").alias("_asked")))  # one row
    scored = vectors.select(key, doubles(column).alias("_vector")).crossJoin(asked).select(key, F.round(cosine(F.col("_vector"), F.col("_asked")), 9).alias("score"))
    return scored.orderBy(F.desc("score"), key).limit(k)


def _first(score: np.ndarray, k: int) -> np.ndarray:
    """The places of the k largest of each row, falling; columns come by key, so a stable order of those that reach the k-th breaks ties by key."""
    if score.shape[1] <= k:
        return np.argsort(-score, axis=1, kind="stable")
    least = np.partition(score, -k, axis=1)[:, -k]
    out = np.empty((len(score), k), np.int64)
    for i, row in enumerate(score):
        reach = np.flatnonzero(row >= least[i])
        out[i] = reach[np.argsort(-row[reach], kind="stable")[:k]]
    return out


BLOCK = 2048  # vectors, and queries, that are multiplied at a time


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _cosines(asks: np.ndarray, has: np.ndarray) -> np.ndarray:
    unit = []
    for m in (asks, has):
        size = np.sqrt((m * m).sum(1, keepdims=True))
        unit.append(np.divide(m, size, out=np.zeros_like(m), where=size > 0))
    return np.round(unit[0] @ unit[1].T, 9)


def _dots(asks: np.ndarray, has: np.ndarray) -> np.ndarray:
    return np.round(asks @ has.T, 9)


def _agreements(asks: np.ndarray, has: np.ndarray) -> np.ndarray:
    out = np.zeros((len(asks), len(has)))
    for w in range(asks.shape[1]):
        out -= np.bitwise_count(asks[:, w, None] ^ has[None, :, w])
    return out


#: How a batch likens vectors: the type of their elements, and scores of queries against vectors (for packed signs less the bits that differ).
MEASURES = {"cosine": ("double", _cosines), "dot": ("double", _dots), "hamming": ("bigint", _agreements)}


def dense_batch(vectors: DataFrame, key: str, column: str, queries: DataFrame, query_key: str, k: int, measure: str = "cosine", group: str | None = None) -> DataFrame:
    """query_key, key, score: the k best of every query by a measure, ties by key, in blocks of queries against blocks of vectors.

    With ``group`` (a text column of vectors) the k best of each group, and the group's name. Every vector goes to
    one task for each block of queries, never to one for each query, and only k rows a query and group leave a
    task. A vector without length is like nothing (0); rows without a vector are left out on either side.
    """
    element, likeness = MEASURES[measure]
    vectors, queries = vectors.filter(F.col(column).isNotNull()), queries.filter(F.col(column).isNotNull())
    blocks_of = lambda n: max(1, -(-n // BLOCK))
    v_blocks, q_blocks = blocks_of(vectors.count()), blocks_of(queries.count())
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    v, none = F.col(column).cast(f"array<{element}>").alias("v"), F.lit(None)
    named = (F.col(group) if group else none).cast("string").alias("g")
    rows = vectors.select(none.cast(queries.schema[query_key].dataType).alias("q"), F.col(key).alias("key"), named, v, block(key, v_blocks).alias("x"), every(q_blocks).alias("y"))
    rows = rows.unionByName(queries.select(F.col(query_key).alias("q"), none.cast(vectors.schema[key].dataType).alias("key"), none.cast("string").alias("g"), v, every(v_blocks).alias("x"), block(query_key, q_blocks).alias("y")))
    dealt = rows.repartition("x", "y").sortWithinPartitions(F.col("x"), F.col("y"), F.col("key").asc_nulls_first(), F.col("q"))

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def solve(table: pa.Table) -> Iterator[pa.RecordBatch]:
            asks = table.filter(pc.is_null(table.column("key")))
            has = table.filter(pc.is_valid(table.column("key")))
            if not asks.num_rows or not has.num_rows:
                return
            score = likeness(_matrix(asks.column("v")), _matrix(has.column("v")))
            groups = pc.fill_null(has.column("g").combine_chunks().dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
            for g in np.unique(groups):
                own = np.flatnonzero(groups == g)
                best = own[_first(score[:, own], k)]
                row, at = np.repeat(np.arange(asks.num_rows), best.shape[1]), best.ravel()
                taken = [asks.column("q").take(pa.array(row)), has.column("key").take(pa.array(at)), has.column("g").take(pa.array(at))]
                yield pa.record_batch([*[c.combine_chunks() for c in taken], pa.array(score[row, at])], ["q", "key", "g", "score"])

        for batch in batches:
            at = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("x", "y")])
            cuts = np.flatnonzero((at[:, 1:] != at[:, :-1]).any(0)) + 1
            for i, j in zip([0, *cuts], [*cuts, batch.num_rows]):
                part = batch.slice(i, j - i)
                if held and (held[0].column("x")[0], held[0].column("y")[0]) != (part.column("x")[0], part.column("y")[0]):
                    yield from solve(pa.Table.from_batches(held))
                    held = []
                held.append(part)
        if held:
            yield from solve(pa.Table.from_batches(held))

    kinds = f"q {queries.schema[query_key].dataType.simpleString()}, key {vectors.schema[key].dataType.simpleString()}, g string, score double"
    found = dealt.mapInArrow(nearest, kinds)
    best = found.withColumn("r", F.row_number().over(Window.partitionBy("q", "g").orderBy(F.desc("score"), "key"))).filter(F.col("r") <= k)
    return best.select(F.col("q").alias(query_key), *([F.col("g").alias(group)] if group else []), F.col("key").alias(key), "score")


def with_rank(scored: DataFrame, key: str, by: list[str], name: str, order: str = "score") -> DataFrame:
    return scored.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(order), key)))


def rrf(arms: list[tuple[DataFrame, float]], key: str, by: list[str], k: int = RRF_K) -> DataFrame:
    """Weighted reciprocal rank fusion of rankings (by, key, rank); an arm of weight 0 is left out of the plan."""
    union = None
    for rows, weight in arms:
        if weight == 0:
            continue
        one = rows.select(*by, key, (F.lit(float(weight)) / (k + F.col("rank"))).alias("s"))
        union = one if union is None else union.unionByName(one)
    return union.groupBy(*by, key).agg(F.sum("s").alias("score"))


def chosen(value: Column, weights: dict[str, float], default: float) -> Column:
    out = F.lit(default)
    for name, w in weights.items():
        out = F.when(value == name, w).otherwise(out)
    return out


def quality_weighted(score: Column, quality: Column) -> Column:
    return score * chosen(periods.quality_bucket(quality), QUALITY_WEIGHTS, 1.0)


def section_weighted(score: Column, section: Column) -> Column:
    return score * chosen(F.coalesce(section, F.lit("body")), SECTION_WEIGHTS, 1.0)


def route(shards: DataFrame, frequencies: DataFrame, terms: list[str], engines: int) -> DataFrame:
    """Which shards to wake for a question and why not the others.

    shards: shard, passages, tokens, eligible, reason; frequencies: shard, term, df.
    """
    wanted = frequencies.filter(F.col("term").isin(terms))
    total = shards.agg(F.sum("passages").alias("n"))
    overall = wanted.groupBy("term").agg(F.sum("df").alias("all_df")).crossJoin(F.broadcast(total))
    held = wanted.join(overall, "term").groupBy("shard").agg(F.sum(F.col("df") * idf(F.col("n"), F.col("all_df"))).alias("s"))
    scored = shards.join(held, "shard", "left").withColumn("score", F.when(F.col("eligible"), F.coalesce("s", F.lit(0.0)) / F.sqrt(F.greatest("passages", F.lit(1)))).otherwise(0.0))
    ranked = scored.withColumn("_r", F.row_number().over(Window.orderBy(F.desc("score"), "shard")))  # one row for each shard
    woken = (F.col("score") > 0) & (F.col("_r") <= engines)
    why = F.when(~F.col("eligible"), F.col("reason")).when(F.col("score") <= 0, "none of the words").when(woken, "holds the words").otherwise("ranked below")
    return ranked.select("shard", F.round("score", 6).alias("score"), woken.alias("woken"), why.alias("why"))


def merged(lexical: DataFrame, dense: DataFrame, key: str, k: int) -> DataFrame:
    """Hits of all shards fused: (key, shard, bm25) and (key, shard, dense) to the k best with both ranks."""
    a = with_rank(lexical.filter("bm25 > 0"), key, [], "bm25_rank", "bm25")
    b = with_rank(dense.filter("dense is not null"), key, [], "dense_rank", "dense")
    both = a.join(b.select(key, F.col("shard").alias("_shard"), "dense", "dense_rank"), key, "full")
    part = lambda c: F.coalesce(1 / (RRF_K + F.col(c)), F.lit(0.0))
    score = part("bm25_rank") + part("dense_rank")
    return both.select(key, F.coalesce("shard", "_shard").alias("shard"), "bm25_rank", "dense_rank", F.round(score, 6).alias("rrf"), score.alias("_o")).orderBy(F.desc("_o"), key).limit(k).drop("_o")


def int8_scales(vectors: DataFrame, column: str) -> DataFrame:
    """One row: the largest absolute value of every dimension over 127."""
    per = vectors.select(F.posexplode(doubles(column)).alias("d", "x")).groupBy("d").agg((F.max(F.abs("x")) / 127).alias("s"))
    return per.agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "s"))), lambda p: p["s"]).alias("scales"))  # one element a dimension


def int8_codes(v: Column, scales: Column) -> Column:
    return F.zip_with(v, scales, lambda x, s: F.when(s > 0, F.round(x / s)).otherwise(0.0).cast("int"))


def sign_words(v: Column) -> Column:
    """Signs packed into words of 32 bits."""
    bits = F.transform(v, lambda x: F.when(x > 0, 1).otherwise(0).cast("long"))
    starts = F.sequence(F.lit(1), F.size(v), F.lit(32))
    return F.transform(starts, lambda i: F.aggregate(F.slice(bits, i, 32), F.lit(0).cast("long"), lambda a, b: a * 2 + b))


def hamming(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def stub_embedding(tokens: Column, dim: int) -> Column:
    """A hashed bag of tokens at length one; for tests of plans, not of meaning."""
    slots = F.transform(tokens, lambda t: F.pmod(F.xxhash64(t), F.lit(dim)).cast("int"))
    counts = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda d: F.size(F.filter(slots, lambda s: s == d)).cast("double"))
    return normalised(counts)
