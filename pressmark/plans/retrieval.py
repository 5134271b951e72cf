"""Queries on retrieval, routing, vectors."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pressmark.functions import text as T
from pressmark.operators import index
from pressmark.operators import ranking as R
from pressmark.operators import retrieval as S
from pressmark.plans.registry import kept, part, query, scratch
from pressmark.sources import sinks

QUESTION = "What did the report conclude about onheed nteres worthless edha and thinor in 1998?"
CANDIDATES = S.RetrieveConfig().candidates
STOP = "(" + ", ".join(f"'{w}'" for w in T.STOPWORDS) + ")"
TOKENS = "regexp_extract_all(lower(coalesce({0}, '')), '[\\p{{L}}\\p{{N}}]+')"

part("toks", f"toks AS (SELECT doc_id, {TOKENS.format('text')} AS ts FROM documents)")
part("postings", "postings AS (SELECT doc_id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT doc_id, len(ts) AS dl, unnest(ts) AS term FROM @toks) GROUP BY doc_id, term)")
part("qterms", f"qterms AS (SELECT DISTINCT w AS term FROM (SELECT unnest({TOKENS.format(chr(39) + QUESTION + chr(39))}) AS w) WHERE w NOT IN {STOP})")
part("stats", "stats AS (SELECT count(*) AS n, sum(len(ts)) AS tokens FROM @toks)")
part("dfs", "dfs AS (SELECT term, count(*) AS df FROM @postings GROUP BY term)")
part("lexical", "lexical AS (SELECT doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / (tokens / n)))) AS score FROM @postings JOIN @dfs USING (term) JOIN @qterms USING (term), @stats GROUP BY doc_id)")
part("vq", "vq AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 0)")
part("vqs", "vqs AS (SELECT vec_id AS q, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 50 = 0)")
part("densepairs", "densepairs AS (SELECT q, vec_id, label, round(list_cosine_similarity(embedding::DOUBLE[], v), 9) AS score FROM embeddings, @vqs)")
part("signpairs", "signpairs AS (SELECT q, vec_id, embedding, v, list_sum(list_transform(list_zip(embedding::DOUBLE[], v), lambda z: ((z[1] > 0) <> (z[2] > 0))::INT))::INT AS distance FROM embeddings, @vqs)")
part("densearm", "densearm AS (SELECT vec_id AS doc_id, round(list_cosine_similarity(embedding::DOUBLE[], v), 9) AS score FROM embeddings, @vq)")
part("bmrank", "bmrank AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM (SELECT doc_id, round(score, 9) AS score FROM @lexical))")
part("dnrank", "dnrank AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM @densearm)")


def question_terms(t, text: str = QUESTION, q: str = "q1"):
    """(q, term) of one question."""
    one = t.spark.createDataFrame([(q, text)], "q string, text string")
    return one.select("q", F.explode(T.query_terms("text")).alias("term"))


def asked(t, text: str = QUESTION) -> list[str]:
    """The terms of one question, on the driver."""
    return [r["term"] for r in question_terms(t, text).select("term").distinct().collect()]


def document_index(t) -> index.Index:
    """The index of documents: built by the first query that asks, then read by all others of the application."""
    root = kept(t.spark, t.folder, "documents", "documents-index")
    if sinks.Store(t.spark, root).head(index.POINTER) is None:
        index.build(t.documents, "doc_id", "text", root)
    return index.Index(t.spark, root)


def _lexical(t, k: int | None = None):
    """q, doc_id, score by BM25 of all documents that have a term of the question, from their texts; of the k best alone, from the kept index."""
    if k is None:
        return S.bm25_once(t.documents, "doc_id", "text", asked(t)).select(F.lit("q1").alias("q"), "doc_id", F.round("score", 9).alias("score"))
    return document_index(t).top(asked(t), k).select(F.lit("q1").alias("q"), F.col("key").alias("doc_id"), "score")


def asking(t):
    """(q, embedding): the vectors that ask, every id divisible by 50."""
    return t.embeddings.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("q"), "embedding")


def _dense(t):
    q = t.embeddings.filter("vec_id = 0").select(S.doubles("embedding").alias("v"))
    return t.embeddings.crossJoin(F.broadcast(q)).select(F.lit("q1").alias("q"), F.col("vec_id").alias("doc_id"), F.round(S.cosine(S.doubles("embedding"), F.col("v")), 9).alias("score"))


def flagship(t):
    """The ten best documents for the question by BM25, with their place and opening."""
    best = _lexical(t, 10)
    found = t.documents.join(F.broadcast(best), "doc_id")  # ten rows
    return found.select("doc_id", F.round("score", 6).alias("score"), "lang", "source", T.snippet("text", 80).alias("opening"))


@query("rt1_query_terms", f"SELECT item_id, list_sort(list_distinct(list_filter({TOKENS.format('text')}, lambda w: w NOT IN {STOP}))) AS terms FROM benchmark")
def rt1(t):
    return t.benchmark.select("item_id", F.array_sort(T.query_terms("text")).alias("terms"))


@query("rt2_bm25_top", """SELECT doc_id, round(score, 6) AS score, lang, source, substr(trim(regexp_replace(text, '\\s+', ' ', 'g')), 1, 80) AS opening FROM (SELECT doc_id, round(score, 9) AS score FROM @lexical ORDER BY score DESC, doc_id LIMIT 10) JOIN documents USING (doc_id)""")
def rt2(t):
    return flagship(t)


@query("rt3_indexed_bm25", "SELECT doc_id, round(score, 6) AS score FROM (SELECT doc_id, round(score, 9) AS score FROM @lexical ORDER BY score DESC, doc_id LIMIT 25)")
def rt3(t):
    path = scratch(t.spark, "index")
    S.write_index(t.documents, "doc_id", "text", path)
    scored = S.indexed_bm25(t.spark, path, question_terms(t), asked(t), "doc_id").withColumn("score", F.round("score", 9))
    return scored.orderBy(F.desc("score"), "doc_id").limit(25).select("doc_id", F.round("score", 6).alias("score"))


@query("rt4_idf", "SELECT term, df, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) AS idf FROM @dfs, @stats WHERE df >= 5")
def rt4(t):
    f = S.frequencies(S.postings(t.documents, "doc_id", "text")).filter("df >= 5")
    return f.crossJoin(F.broadcast(S.collection(t.documents, "text"))).select("term", "df", F.round(S.idf(F.col("n"), F.col("df")), 6).alias("idf"))


@query("rt5_dense_top", "SELECT q, vec_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id) AS r FROM @densepairs) WHERE r <= 20")
def rt5(t):
    return S.dense_batch(t.embeddings, "vec_id", "embedding", asking(t), "q", 20).select("q", "vec_id", F.round("score", 6).alias("score"))


@query("rt6_normalised_rows", "SELECT vec_id, round(list_sum(list_transform(embedding::DOUBLE[], lambda x: abs(x) / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])))), 5) AS l1 FROM embeddings")
def rt6(t):
    v = S.normalised(S.doubles("embedding"))
    return t.embeddings.select("vec_id", F.round(F.aggregate(v, F.lit(0.0), lambda s, x: s + F.abs(x)), 5).alias("l1"))


@query("rt7_rrf", "SELECT doc_id, round(sum(1.0 / (60 + rank)), 6) AS score FROM (SELECT doc_id, rank FROM @bmrank WHERE rank <= 50 UNION ALL SELECT doc_id, rank FROM @dnrank WHERE rank <= 50) GROUP BY doc_id")
def rt7(t):
    a = S.with_rank(_lexical(t, 50), "doc_id", ["q"], "rank")
    b = S.with_rank(_dense(t), "doc_id", ["q"], "rank").filter("rank <= 50")
    return S.rrf([(a, 1.0), (b, 1.0)], "doc_id", ["q"]).select("doc_id", F.round("score", 6).alias("score"))


@query("rt8_weighted_fusion", "SELECT doc_id, round(sum(w / (60 + rank)), 6) AS score FROM (SELECT doc_id, rank, 1.0 AS w FROM @bmrank WHERE rank <= 50 UNION ALL SELECT doc_id, rank, 0.4 FROM @dnrank WHERE rank <= 50) GROUP BY doc_id")
def rt8(t):
    a = S.with_rank(_lexical(t, 50), "doc_id", ["q"], "rank")
    b = S.with_rank(_dense(t), "doc_id", ["q"], "rank").filter("rank <= 50")
    return S.rrf([(a, 1.0), (b, 0.4)], "doc_id", ["q"]).select("doc_id", F.round("score", 6).alias("score"))


@query("rt9_rt10_soft_weights", """SELECT item_id, round(amount * CASE WHEN ocr_quality >= 0.66 THEN 1.0 WHEN ocr_quality >= 0.33 THEN 0.9 ELSE 0.75 END * CASE doc_type WHEN '1-URGENT' THEN 0.5 WHEN '5-LOW' THEN 0.5 ELSE 1.0 END, 6) AS score FROM @items""")
def rt9(t):
    section = F.when(F.col("doc_type") == "1-URGENT", "front").when(F.col("doc_type") == "5-LOW", "back")
    return t.items.select("item_id", F.round(S.section_weighted(S.quality_weighted(F.col("amount"), F.col("ocr_quality")), section), 6).alias("score"))


@query("rt11_later_years", """SELECT event_id, list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(x, '\\b(1[89]\\d\\d|20\\d\\d)\\b', 1), lambda y: y::INT), lambda y: y > 1990 + 1))) AS later
 FROM (SELECT event_id, (1985 + event_id % 40)::VARCHAR || ' and ' || (1980 + event_id % 31)::VARCHAR || ', not 3' || (1990 + event_id % 9)::VARCHAR AS x FROM events)""")
def rt11(t):
    y = lambda a, m: (F.lit(a) + F.col("event_id") % m).cast("string")
    x = F.concat(y(1985, 40), F.lit(" and "), y(1980, 31), F.lit(", not 3"), y(1990, 9))
    return t.events.select("event_id", T.later_years(x, F.lit(1990)).alias("later"))


@query("rt13_metadata_bonus", """SELECT item_id, position FROM (SELECT item_id, row_number() OVER (ORDER BY s DESC, r) AS position FROM (SELECT item_id, r, amount * (1 + CASE WHEN year BETWEEN 1996 AND 1998 THEN 0.3 ELSE 0 END + CASE WHEN jurisdiction IN ('NATION_1', 'NATION_2') THEN 0.2 ELSE 0 END
 + CASE WHEN year <= 2000 THEN 0.1 * greatest(0, 1 - (2000 - year) / 20.0) ELSE 0 END) AS s FROM (SELECT *, row_number() OVER (ORDER BY amount DESC, item_id) AS r FROM @items) WHERE r <= 60)) WHERE position <= 20""")
def rt13(t):
    from pressmark.operators.metadata import Constraints, bonus

    head = R.top(t.items, [F.desc("amount"), F.col("item_id")], 60)
    head = head.withColumn("r", F.row_number().over(Window.orderBy(F.desc("amount"), "item_id")))  # 60 rows
    c = Constraints(years=((1996, 1998),), as_of=2000, places=("NATION_1", "NATION_2"))
    s = F.col("amount") * (1 + bonus(c, {"year": 0.3, "place": 0.2, "recency": 0.1}))
    return head.withColumn("position", F.row_number().over(Window.orderBy(s.desc(), "r"))).filter("position <= 20").select("item_id", "position")


@query("rt16_cross_shard_merge", """SELECT doc_id, coalesce(a.shard, b.shard) AS shard, a.r AS bm25_rank, b.r AS dense_rank, round(coalesce(1.0 / (60 + a.r), 0) + coalesce(1.0 / (60 + b.r), 0), 6) AS rrf
 FROM (SELECT doc_id, lang AS shard, row_number() OVER (ORDER BY s DESC, doc_id) AS r FROM (SELECT doc_id, round(score, 9) AS s FROM @lexical JOIN documents USING (doc_id) ORDER BY s DESC, doc_id LIMIT 200) JOIN documents USING (doc_id)) a
 FULL JOIN (SELECT doc_id, lang AS shard, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM (SELECT doc_id, score FROM @densearm JOIN documents USING (doc_id) ORDER BY score DESC, doc_id LIMIT 200) JOIN documents USING (doc_id)) b USING (doc_id)
 ORDER BY coalesce(1.0 / (60 + a.r), 0) + coalesce(1.0 / (60 + b.r), 0) DESC, doc_id LIMIT 15""")
def rt16(t):
    shard = t.documents.select("doc_id", F.col("lang").alias("shard"))
    best = lambda arm, name: R.top(arm.join(shard, "doc_id").select("doc_id", "shard", F.col("score").alias(name)), [F.desc(name), F.col("doc_id")], CANDIDATES)
    return S.merged(best(_lexical(t, CANDIDATES), "bm25"), best(_dense(t), "dense"), "doc_id", 15)


part("sharddf", "sharddf AS (SELECT lang AS shard, term, count(*) AS df FROM @postings JOIN documents USING (doc_id) GROUP BY 1, 2)")
part("shards", "shards AS (SELECT lang AS shard, count(*) AS passages, sum(len(ts)) AS tokens FROM @toks JOIN documents USING (doc_id) GROUP BY 1)")


@query("tk6_route", """SELECT shard, score, woken, CASE WHEN shard = 'es' THEN 'no documents in the period' WHEN score <= 0 THEN 'none of the words' WHEN woken THEN 'holds the words' ELSE 'ranked below' END AS why FROM (
 SELECT shard, round(s, 6) AS score, s > 0 AND row_number() OVER (ORDER BY s DESC, shard) <= 2 AS woken FROM (
 SELECT h.shard, CASE WHEN h.shard = 'es' THEN 0.0 ELSE coalesce(x.s, 0.0) / sqrt(greatest(passages, 1)) END AS s FROM @shards h LEFT JOIN (
 SELECT shard, sum(df * ln(1 + (n - g + 0.5) / (g + 0.5))) AS s FROM @sharddf JOIN @qterms USING (term) JOIN (SELECT term, sum(df) AS g FROM @sharddf GROUP BY term) USING (term), (SELECT sum(passages) AS n FROM @shards) GROUP BY shard) x ON x.shard = h.shard))""")
def tk6(t):
    shards = t.documents.groupBy(F.col("lang").alias("shard")).agg(F.count("*").alias("passages"), F.sum(F.size(T.tokens("text"))).alias("tokens"))
    shards = shards.withColumn("eligible", F.col("shard") != "es").withColumn("reason", F.lit("no documents in the period"))
    terms = ["onheed", "nteres", "worthless", "edha", "thinor", "1998"]
    post = S.postings(t.documents, "doc_id", "text", terms).join(t.documents.select("doc_id", F.col("lang").alias("shard")), "doc_id")
    return S.route(shards, post.groupBy("shard", "term").agg(F.count("*").alias("df")), terms, 2)


@query("ag2_coverage_query", """SELECT lang AS lane, count(DISTINCT d.doc_id) AS items, count(DISTINCT d.doc_id) FILTER (WHERE a.doc_id IS NOT NULL) AS onheed, count(DISTINCT d.doc_id) FILTER (WHERE b.doc_id IS NOT NULL) AS worthless, count(DISTINCT d.doc_id) FILTER (WHERE a.doc_id IS NOT NULL OR b.doc_id IS NOT NULL) AS any_term
 FROM documents d LEFT JOIN (SELECT doc_id FROM @postings WHERE term = 'onheed') a ON a.doc_id = d.doc_id LEFT JOIN (SELECT doc_id FROM @postings WHERE term = 'worthless') b ON b.doc_id = d.doc_id GROUP BY lang""")
def ag2(t):
    words = T.tokens("text")
    flags = t.documents.select("doc_id", F.col("lang").alias("lane"), F.array_contains(words, "onheed").alias("a"), F.array_contains(words, "worthless").alias("b"))
    distinct = lambda c: F.countDistinct(F.when(c, F.col("doc_id")))
    return flags.groupBy("lane").agg(F.countDistinct("doc_id").alias("items"), distinct(F.col("a")).alias("onheed"), distinct(F.col("b")).alias("worthless"), distinct(F.col("a") | F.col("b")).alias("any_term"))


@query("ag15_shard_statistics", "SELECT shard, term, df FROM @sharddf WHERE df >= 8")
def ag15(t):
    return S.frequencies_by(t.documents.withColumnRenamed("lang", "shard"), "doc_id", "text", "shard").filter("df >= 8")


@query("ag16_global_statistics", "SELECT term, sum(df)::BIGINT AS df FROM @sharddf GROUP BY term HAVING sum(df) >= 10")
def ag16(t):
    return S.frequencies(S.postings(t.documents, "doc_id", "text")).filter("df >= 10")


@query("rt17_tf_maps", "SELECT doc_id, dl, list_sort(list(term || ':' || tf::VARCHAR)) AS tf FROM @postings JOIN @qterms USING (term) GROUP BY doc_id, dl")
def rt17(t):
    post = S.postings(t.documents, "doc_id", "text", asked(t))
    return post.groupBy("doc_id", "dl").agg(F.sort_array(F.collect_list(F.concat("term", F.lit(":"), F.col("tf").cast("string")))).alias("tf"))  # terms of one question


@query("rt20_fnv1a", "SELECT p_partkey, list_reduce(list_concat([2166136261::HUGEINT], list_transform(range(0, length(hx) // 2), lambda i: ('0x' || substr(hx, (2 * i + 1)::BIGINT, 2))::HUGEINT)), lambda h, b: xor(h, b) * 16777619 % 4294967296)::BIGINT AS h FROM (SELECT p_partkey, hex(p_name) AS hx FROM part)")
def rt20(t):
    return t.part.select("p_partkey", T.fnv1a("p_name").alias("h"))


@query("rt21_and_count", "SELECT count(*) AS n FROM (SELECT doc_id FROM @postings WHERE term IN ('onheed', 'the', 'of') GROUP BY doc_id HAVING count(*) = 3)")
def rt21(t):
    post = S.postings(t.documents, "doc_id", "text", ["onheed", "the", "of"])
    return post.groupBy("doc_id").agg(F.count("*").alias("k")).filter("k = 3").agg(F.count("*").alias("n"))


@query("rt22_phrase", f"SELECT doc_id FROM documents WHERE contains(' ' || array_to_string({TOKENS.format('text')}, ' ') || ' ', ' of the ')")
def rt22(t):
    return t.documents.filter(T.on_page(F.lit("of the"), "text")).select("doc_id")


@query("rt23_prefix", "SELECT DISTINCT doc_id FROM @postings WHERE term LIKE 'onhee%'")
def rt23(t):
    return S.postings(t.documents, "doc_id", "text").filter(F.col("term").startswith("onhee")).select("doc_id").distinct()


@query("rt2_index_top", "SELECT doc_id, round(score, 6) AS score FROM (SELECT doc_id, round(score, 9) AS score FROM @lexical ORDER BY score DESC, doc_id LIMIT 100)")
def rt2_index(t):
    return _lexical(t, 100).select("doc_id", F.round("score", 6).alias("score"))


@query("rt21_index_all_of", "SELECT doc_id FROM @postings WHERE term IN ('the', 'of', 'in') GROUP BY doc_id HAVING count(*) = 3")
def rt21_index(t):
    return document_index(t).all_of(["the", "of", "in"]).select(F.col("key").alias("doc_id"))


_PADDED = f"(SELECT doc_id, ' ' || array_to_string({TOKENS.format('text')}, '  ') || ' ' AS x FROM documents)"


@query("rt22_index_phrase", f"SELECT doc_id, (length(x) - length(replace(x, ' of  the ', ''))) // 9 AS hits FROM {_PADDED} WHERE contains(x, ' of  the ')")
def rt22_index(t):
    return document_index(t).phrase(["of", "the"]).select(F.col("key").alias("doc_id"), "hits")


@query("rt23_index_prefix", "SELECT DISTINCT doc_id FROM @postings WHERE term LIKE 'onhee%'")
def rt23_index(t):
    return document_index(t).prefix("onhee").select(F.col("key").alias("doc_id"))


@query("sc46_index_quotes", f"SELECT item_id, doc_id FROM (SELECT item_id, ' ' || array_to_string({TOKENS.format('text')}[1:6], '  ') || ' ' AS q FROM benchmark) JOIN {_PADDED} ON contains(x, q)")
def sc46_index(t):
    quotes = t.benchmark.select("item_id", F.slice(T.tokens("text"), 1, 6).alias("q")).collect()  # the quotes asked for
    return document_index(t).phrases([(r["item_id"], r["q"]) for r in quotes]).select(F.col("q").alias("item_id"), F.col("key").alias("doc_id"))


@query("rt25_int8_scores", """WITH sc AS (SELECT d, max(abs(x)) / 127 AS s FROM (SELECT unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS d FROM embeddings) GROUP BY d), m AS (SELECT list(s ORDER BY d) AS s FROM sc),
 p AS (SELECT q, vec_id, round(list_sum(list_transform(list_zip(embedding::DOUBLE[], m.s, v), lambda z: CASE WHEN z[2] > 0 THEN round(z[1] / z[2]) * z[2] ELSE 0 END * z[3])), 9) AS score FROM embeddings, m, @vqs)
 SELECT q, vec_id, round(score, 5) AS score FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id) AS r FROM p) WHERE r <= 20""")
def rt25(t):
    coded = t.embeddings.crossJoin(F.broadcast(S.int8_scales(t.embeddings, "embedding")))  # one row
    approx = F.zip_with(S.int8_codes(S.doubles("embedding"), F.col("scales")), F.col("scales"), lambda c, s: c * s)
    return S.dense_batch(coded.select("vec_id", approx.alias("embedding")), "vec_id", "embedding", asking(t), "q", 20, "dot").select("q", "vec_id", F.round("score", 5).alias("score"))


@query("rt26_hamming", "SELECT q, vec_id, distance FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY distance, vec_id) AS r FROM @signpairs) WHERE r <= 20")
def rt26(t):
    return _by_signs(t, 20).select("q", "vec_id", (-F.col("score")).cast("int").alias("distance"))


def _by_signs(t, k: int):
    """The k vectors of every asking one whose packed signs differ in the fewest bits."""
    words = S.sign_words(S.doubles("embedding")).alias("words")
    return S.dense_batch(t.embeddings.select("vec_id", words), "vec_id", "words", asking(t).select("q", words), "q", k, "hamming")


@query("rt27_binary_rescore", """SELECT q, vec_id, round(score, 6) AS score FROM (SELECT q, vec_id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id) AS r FROM (
 SELECT q, vec_id, round(list_cosine_similarity(embedding::DOUBLE[], v), 9) AS score FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY distance, vec_id) AS s FROM @signpairs) WHERE s <= 50)) WHERE r <= 10""")
def rt27(t):
    short = _by_signs(t, 50).select("q", "vec_id").join(t.embeddings.select("vec_id", S.doubles("embedding").alias("e")), "vec_id").join(asking(t).select("q", S.doubles("embedding").alias("v")), "q")
    scored = short.select("q", "vec_id", F.round(S.cosine(F.col("e"), F.col("v")), 9).alias("score"))
    return S.with_rank(scored, "vec_id", ["q"], "rank").filter("rank <= 10").select("q", "vec_id", F.round("score", 6).alias("score"))


@query("rt29_stub_embedding", None)
def rt29(t):
    return t.benchmark.select("item_id", S.stub_embedding(T.tokens("text"), 16).alias("v"))


@query("wn13_max_sim", "SELECT q, label, round(max(score), 6) AS best FROM @densepairs GROUP BY q, label")
def wn13(t):
    named = t.embeddings.withColumn("owner", F.col("label").cast("string"))
    best = S.dense_batch(named, "vec_id", "embedding", asking(t), "q", 1, group="owner")
    return best.select("q", F.col("owner").cast(t.embeddings.schema["label"].dataType).alias("label"), F.round("score", 6).alias("best"))


@query("rt12_question_constraints", "SELECT * FROM (VALUES ('Between 1974 and 1980, what changed?', [[1974, 1980]], NULL::INT, []::VARCHAR[]), ('as of 1999 in the 1960s', [[1960, 1969]], 1999, []), ('1974-1979 then 1985', [[1974, 1979], [1985, 1985]], NULL, [])) v(q, years, as_of, places)")
def rt12(t):
    from pressmark.operators.metadata import constraints_of

    rows = t.spark.createDataFrame([("Between 1974 and 1980, what changed?",), ("as of 1999 in the 1960s",), ("1974-1979 then 1985",)], "q string")
    return constraints_of(rows, "q", ())
