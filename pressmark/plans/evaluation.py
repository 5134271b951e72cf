"""Queries on evaluation. Rankings: documents of a question by length; judgements: labels."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pressmark.operators import evaluation as E
from pressmark.plans.registry import part, query

part("ranking", "ranking AS (SELECT lang AS q, doc_id AS doc, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS rank FROM documents)")
part("judged", "judged AS (SELECT lang AS q, doc_id AS doc, CASE WHEN toxic = 1 THEN 2 WHEN quality = 0 THEN 1 ELSE 0 END AS relevance FROM labels JOIN documents USING (doc_id))")
part("wz", "wz AS (SELECT 1.959963984540054::DOUBLE AS z)")
part("votes", """votes AS (SELECT doc_id AS item, 'a' AS judge, quality::VARCHAR AS vote FROM labels UNION ALL SELECT doc_id, 'b', (CASE WHEN doc_id % 7 = 0 THEN 1 - quality ELSE quality END)::VARCHAR FROM labels WHERE doc_id % 5 <> 0
 UNION ALL SELECT doc_id, 'c', toxic::VARCHAR FROM labels WHERE doc_id % 3 = 0)""")
WILSON = """round(CASE WHEN n > 0 THEN greatest(0.0, ((k / n) + z*z/(2.0*n) - z * sqrt((k / n) * (1 - (k / n)) / n + z*z/(4.0*n*n))) / (1 + z*z/n)) END, 4) AS low,
 round(CASE WHEN n > 0 THEN least(1.0, ((k / n) + z*z/(2.0*n) + z * sqrt((k / n) * (1 - (k / n)) / n + z*z/(4.0*n*n))) / (1 + z*z/n)) END, 4) AS high"""


def _ranking(t):
    r = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n_chars"), "doc_id"))
    return t.documents.select(F.col("lang").alias("q"), F.col("doc_id").alias("doc"), r.alias("rank"))


def _judged(t):
    rel = F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 0, 1).otherwise(0)
    return t.labels.join(t.documents, "doc_id").select(F.col("lang").alias("q"), F.col("doc_id").alias("doc"), rel.alias("relevance"))


def _votes(t):
    l = t.labels  # noqa: E741
    one = lambda rows, judge, vote: rows.select(F.col("doc_id").alias("item"), F.lit(judge).alias("judge"), vote.cast("string").alias("vote"))
    b = F.when(F.col("doc_id") % 7 == 0, 1 - F.col("quality")).otherwise(F.col("quality"))
    return one(l, "a", F.col("quality")).union(one(l.filter("doc_id % 5 <> 0"), "b", b)).union(one(l.filter("doc_id % 3 = 0"), "c", F.col("toxic")))


@query("ev1_recall_at_k", "SELECT q, round(CASE WHEN n > 0 THEN h / n END, 6) AS recall FROM (SELECT r.q, count(DISTINCT r.doc) FILTER (WHERE rank <= 40 AND relevance > 0) AS h, (SELECT count(*) FROM @judged g WHERE g.q = r.q AND relevance > 0) AS n FROM @ranking r LEFT JOIN @judged j ON j.q = r.q AND j.doc = r.doc GROUP BY r.q)")
def ev1(t):
    return E.recall(_ranking(t), _judged(t).filter("relevance > 0").select("q", "doc"), 40).select("q", F.round("recall", 6).alias("recall"))


@query("ev2_ndcg_at_k", """WITH i AS (SELECT q, sum(relevance / log2(r + 1)) AS ideal FROM (SELECT q, relevance, row_number() OVER (PARTITION BY q ORDER BY relevance DESC, doc) AS r FROM @judged WHERE relevance > 0) WHERE r <= 20 GROUP BY q),
 d AS (SELECT r.q, sum(relevance / log2(rank + 1)) AS dcg FROM @ranking r JOIN @judged j ON j.q = r.q AND j.doc = r.doc WHERE rank <= 20 GROUP BY r.q) SELECT q, round(CASE WHEN ideal > 0 THEN coalesce(dcg, 0) / ideal END, 6) AS ndcg FROM (SELECT DISTINCT q FROM @ranking) LEFT JOIN i USING (q) LEFT JOIN d USING (q)""")
def ev2(t):
    return E.ndcg(_ranking(t), _judged(t), 20).select("q", F.round("ndcg", 6).alias("ndcg"))


@query("ev3_unjudged_at_k", "SELECT r.q, round(count(*) FILTER (WHERE j.doc IS NULL) / count(*), 6) AS unjudged FROM @ranking r LEFT JOIN @judged j ON j.q = r.q AND j.doc = r.doc WHERE rank <= 20 GROUP BY r.q")
def ev3(t):
    return E.unjudged(_ranking(t), _judged(t), 20).select("q", F.round("unjudged", 6).alias("unjudged"))


@query("ev4_evidence", "SELECT r.q, count(*) FILTER (WHERE relevance > 0) >= 3 AS has_evidence, (count(*) FILTER (WHERE relevance > 0) >= 3) = (r.q <> 'es') AS abstention_correct FROM @ranking r LEFT JOIN @judged j ON j.q = r.q AND j.doc = r.doc WHERE rank <= 40 GROUP BY r.q")
def ev4(t):
    found = _ranking(t).filter("rank <= 40").join(_judged(t), ["q", "doc"], "left").groupBy("q").agg((F.count_if(F.col("relevance") > 0) >= 3).alias("has_evidence"))
    return found.withColumn("abstention_correct", F.col("has_evidence") == (F.col("q") != "es"))


@query("ev5_wilson", f"SELECT lang, k, n, {WILSON} FROM (SELECT lang, sum(quality)::DOUBLE AS k, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY lang UNION ALL SELECT 'none', 0, 0), @wz")
def ev5(t):
    rows = t.labels.join(t.documents, "doc_id").groupBy("lang").agg(F.sum("quality").cast("double").alias("k"), F.count("*").alias("n")).union(t.spark.createDataFrame([("none", 0.0, 0)], "lang string, k double, n long"))
    low, high = E.wilson(F.col("k"), F.col("n"))
    return rows.select("lang", "k", "n", F.round(low, 4).alias("low"), F.round(high, 4).alias("high"))


@query("ev6_rate_with_interval", f"SELECT source, k AS num, n AS den, round(k / n, 4) AS rate, {WILSON} FROM (SELECT source, sum(toxic)::BIGINT AS k, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY source), @wz")
def ev6(t):
    rows = t.labels.join(t.documents, "doc_id").groupBy("source").agg(F.sum("toxic").alias("k"), F.count("*").alias("n"))
    return rows.select("source", *E.rate(F.col("k"), F.col("n")))


@query("mx79_wilson_all", f"SELECT lang, coalesce(low, 0.0) AS low, coalesce(high, 1.0) AS high FROM (SELECT lang, {WILSON} FROM (SELECT lang, sum(toxic)::DOUBLE AS k, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY lang UNION ALL SELECT 'none', 0, 0), @wz)")
def mx79(t):
    rows = t.labels.join(t.documents, "doc_id").groupBy("lang").agg(F.sum("toxic").cast("double").alias("k"), F.count("*").alias("n")).union(t.spark.createDataFrame([("none", 0.0, 0)], "lang string, k double, n long"))
    low, high = E.wilson_or_all(F.col("k"), F.col("n"))
    return rows.select("lang", F.round(low, 4).alias("low"), F.round(high, 4).alias("high"))


@query("mx96_rate_text", """SELECT printf('%.1f%% (%d/%d, 95%% CI %.1f-%.1f%%)', 100.0 * k / n, k, n, 100 * (p + z * z / (2 * n) - m) / (1 + z * z / n), 100 * (p + z * z / (2 * n) + m) / (1 + z * z / n)) AS said FROM (SELECT *, z * sqrt(p * (1 - p) / n + z * z / (4.0 * n * n)) AS m FROM (SELECT sum(quality)::BIGINT AS k, count(*) AS n, sum(quality) / count(*)::DOUBLE AS p, 1.959963984540054::DOUBLE AS z FROM labels))""")
def mx96(t):
    rows = t.labels.agg(F.sum("quality").alias("k"), F.count("*").alias("n"))
    return rows.select(E.rate_text(F.col("k"), F.col("n")).alias("said"))


@query("ev7_macro_means", "SELECT round(avg(recall), 6) AS recall, round(avg(unjudged), 6) AS unjudged FROM (SELECT r.q, CASE WHEN (SELECT count(*) FROM @judged g WHERE g.q = r.q AND relevance > 0) > 0 THEN count(*) FILTER (WHERE relevance > 0) / (SELECT count(*) FROM @judged g WHERE g.q = r.q AND relevance > 0) END AS recall, count(*) FILTER (WHERE j.doc IS NULL) / count(*) AS unjudged FROM @ranking r LEFT JOIN @judged j ON j.q = r.q AND j.doc = r.doc WHERE rank <= 20 GROUP BY r.q)")
def ev7(t):
    a = E.recall(_ranking(t), _judged(t).filter("relevance > 0").select("q", "doc"), 20)
    b = E.unjudged(_ranking(t), _judged(t), 20)
    return a.join(b, "q", "left").agg(F.round(F.avg("recall"), 6).alias("recall"), F.round(F.avg("unjudged"), 6).alias("unjudged"))


part("drawn", """drawn AS (SELECT r, ('0x' || substr(sha256('bs' || r::VARCHAR || ':' || p::VARCHAR), 1, 12))::BIGINT % n AS i FROM (SELECT unnest(generate_series(0, 199)) AS r), (SELECT count(*) AS n FROM @units), (SELECT unnest(generate_series(0, (SELECT count(*) - 1 FROM @units))) AS p))""")
part("units", "units AS (SELECT o_orderpriority || o_orderstatus AS u, sum(CASE WHEN o_totalprice > 100000 THEN 1 ELSE 0 END)::BIGINT AS num, count(*) AS den, row_number() OVER (ORDER BY o_orderpriority || o_orderstatus) - 1 AS i FROM orders GROUP BY 1)")


@query("ev12_ratio_bootstrap", """SELECT round(sum(num) / sum(den), 6) AS value, (SELECT round(quantile_cont(v, 0.025), 6) FROM (SELECT sum(num) / sum(den) AS v FROM @drawn JOIN @units USING (i) GROUP BY r)) AS low, (SELECT round(quantile_cont(v, 0.975), 6) FROM (SELECT sum(num) / sum(den) AS v FROM @drawn JOIN @units USING (i) GROUP BY r)) AS high FROM @units""")
def ev12(t):
    units = t.orders.groupBy(F.concat("o_orderpriority", "o_orderstatus").alias("u")).agg(F.sum((F.col("o_totalprice") > 100000).cast("int")).alias("num"), F.count("*").alias("den"))
    return E.bootstrap(units, "u", "num", "den", 200, "bs")


@query("ev17_calibration_bars", "SELECT a AS agreement, list_filter([CASE WHEN a < 0.99 THEN 'agreement' END, CASE WHEN k < 0.5 THEN 'kappa' END], lambda x: x IS NOT NULL) AS reasons, a >= 0.99 AND k >= 0.5 AS passed FROM (SELECT 0.9 AS a, 0.6 AS k)")
def ev17(t):
    row = t.spark.createDataFrame([(0.9, 0.6)], "agreement double, kappa double")
    return E.failed_bars(row, {"agreement": ("agreement", 0.99), "kappa": ("kappa", 0.5)}).select("agreement", "reasons", "passed")


@query("ev18_panel", """SELECT item, CASE WHEN a IS NULL OR b IS NULL THEN 'human' WHEN a = b THEN 'agree' ELSE 'escalated' END AS way, CASE WHEN a = b THEN a END AS final FROM (SELECT item, max(vote) FILTER (WHERE judge = 'a') AS a, max(vote) FILTER (WHERE judge = 'b') AS b FROM @votes GROUP BY item)""")
def ev18(t):
    return E.panel(_votes(t), "a", "b")


@query("ev19_silver", "SELECT item, CASE WHEN count(*) = 2 AND count(DISTINCT vote) = 1 THEN min(vote) END AS label FROM @votes WHERE judge IN ('a', 'b') GROUP BY item")
def ev19(t):
    return E.silver(_votes(t).filter("judge in ('a', 'b')"), 2)


@query("mx83_majority", "SELECT item, CASE WHEN n >= 2 THEN vote END AS final FROM (SELECT item, vote, n, row_number() OVER (PARTITION BY item ORDER BY n DESC, vote DESC) AS r FROM (SELECT item, vote, count(*) AS n FROM @votes GROUP BY 1, 2)) WHERE r = 1")
def mx83(t):
    return E.majority(_votes(t))


part("vpairs", "vpairs AS (SELECT item, max(vote) FILTER (WHERE judge = 'a') AS a, max(vote) FILTER (WHERE judge = 'b') AS b FROM @votes GROUP BY item)")


@query("ag26_kappa", """WITH p AS (SELECT * FROM @vpairs WHERE a IS NOT NULL AND b IS NOT NULL), m AS (SELECT sum(x * y)::DOUBLE AS xy FROM (SELECT v, (SELECT count(*) FROM p WHERE a = v) AS x, (SELECT count(*) FROM p WHERE b = v) AS y FROM (SELECT DISTINCT a AS v FROM p UNION SELECT DISTINCT b FROM p)))
 SELECT n, round(s / n, 6) AS agreement, round(xy / (n * n), 6) AS chance, round((s / n - xy / (n * n)) / (1 - xy / (n * n)), 6) AS kappa FROM (SELECT count(*) AS n, count(*) FILTER (WHERE a = b) AS s FROM p), m""")
def ag26(t):
    pairs = _votes(t).groupBy("item").pivot("judge", ["a", "b"]).agg(F.first("vote"))
    return E.kappa(pairs, "a", "b")


@query("ag25_confusion", "SELECT a AS truth, count(*) FILTER (WHERE b = '0') AS \"0\", count(*) FILTER (WHERE b = '1') AS \"1\" FROM @vpairs GROUP BY a")
def ag25(t):
    pairs = _votes(t).groupBy("item").pivot("judge", ["a", "b"]).agg(F.first("vote"))
    return E.confusion(pairs, "a", "b", ["0", "1"])


@query("ag24_ratio_of_sums", "SELECT o_orderpriority AS category, round(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) / count(*), 6) AS accuracy, round(quantile_cont(o_totalprice, 0.5), 6) AS p50, round(quantile_cont(o_totalprice, 0.95), 6) AS p95 FROM orders GROUP BY 1")
def ag24(t):
    good = F.count_if(F.col("o_orderstatus") == "F")
    return t.orders.groupBy(F.col("o_orderpriority").alias("category")).agg(F.round(good / F.count("*"), 6).alias("accuracy"), F.round(F.percentile("o_totalprice", 0.5), 6).alias("p50"), F.round(F.percentile("o_totalprice", 0.95), 6).alias("p95"))


@query("ag29_ledger", """SELECT round(sum(value) FILTER (WHERE event_type = 'purchase'), 4) AS spent, (SELECT round(sum(value), 4) FROM (SELECT user_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events WHERE event_type IN ('signup', 'error')) WHERE r = 1 AND event_type = 'signup') AS reserved FROM events""")
def ag29(t):
    last = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    open_ = t.events.filter("event_type in ('signup', 'error')").withColumn("r", F.row_number().over(last)).filter("r = 1 and event_type = 'signup'").agg(F.round(F.sum("value"), 4).alias("reserved"))
    return t.events.agg(F.round(F.sum(F.when(F.col("event_type") == "purchase", F.col("value"))), 4).alias("spent")).crossJoin(open_)


@query("ag30_grouping_by_method", """SELECT coalesce(l_returnflag, '*') AS method, coalesce(l_linestatus, '*') AS confidence, count(*) AS n, round(avg(CASE WHEN l_discount <= 0.05 THEN 1 ELSE 0 END), 6) AS within FROM lineitem GROUP BY GROUPING SETS ((), (l_returnflag), (l_linestatus))""")
def ag30(t):
    g = t.lineitem.groupingSets([[], [F.col("l_returnflag")], [F.col("l_linestatus")]], "l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.avg((F.col("l_discount") <= 0.05).cast("int")), 6).alias("within"))
    return g.select(F.coalesce("l_returnflag", F.lit("*")).alias("method"), F.coalesce("l_linestatus", F.lit("*")).alias("confidence"), "n", "within")


@query("ag23_distinct_citations", "SELECT sum(n)::BIGINT AS citations FROM (SELECT l_orderkey, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY 1)")
def ag23(t):
    return t.lineitem.groupBy("l_orderkey").agg(F.countDistinct("l_suppkey").alias("n")).agg(F.sum("n").alias("citations"))


@query("ag28_silver_error", "SELECT count(*) AS items, sum(wrong)::BIGINT AS wrong_items FROM (SELECT item, max((vote <> final)::INT) AS wrong FROM @votes JOIN (SELECT doc_id AS item, quality::VARCHAR AS final FROM labels) USING (item) GROUP BY item)")
def ag28(t):
    truth = t.labels.select(F.col("doc_id").alias("item"), F.col("quality").cast("string").alias("final"))
    per = _votes(t).join(truth, "item").groupBy("item").agg(F.max((F.col("vote") != F.col("final")).cast("int")).alias("wrong"))
    return per.agg(F.count("*").alias("items"), F.sum("wrong").alias("wrong_items"))


@query("ev21_index_sizes", "SELECT count(*) * 64 * 4 AS float32, count(*) * 64 AS int8, count(*) * 8 AS bits FROM embeddings")
def ev21(t):
    return t.embeddings.agg((F.count("*") * 64 * 4).alias("float32"), (F.count("*") * 64).alias("int8"), (F.count("*") * 8).alias("bits"))


@query("mx34_escalation", "SELECT item, a IS DISTINCT FROM b OR a IS NULL AS escalate FROM @vpairs")
def mx34(t):
    pairs = _votes(t).groupBy("item").pivot("judge", ["a", "b"]).agg(F.first("vote"))
    return pairs.select("item", (~F.col("a").eqNullSafe(F.col("b")) | F.col("a").isNull()).alias("escalate"))


@query("mx37_fill_gaps", "SELECT item, coalesce(c, a) AS final FROM (SELECT item, max(vote) FILTER (WHERE judge = 'a') AS a, max(vote) FILTER (WHERE judge = 'c') AS c FROM @votes GROUP BY item)")
def mx37(t):
    pairs = _votes(t).groupBy("item").pivot("judge", ["a", "c"]).agg(F.first("vote"))
    return pairs.select("item", F.coalesce("c", "a").alias("final"))


@query("mx40_pairwise_jaccard", """SELECT a.lang AS a, b.lang AS b, round(len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s))), 6) AS jaccard FROM (SELECT lang, list(DISTINCT source) AS s FROM documents GROUP BY lang) a JOIN (SELECT lang, list(DISTINCT source) AS s FROM documents GROUP BY lang) b ON a.lang < b.lang""")
def mx40(t):
    sets = t.documents.groupBy("lang").agg(F.collect_set("source").alias("s"))
    x, y = sets.select(F.col("lang").alias("a"), F.col("s").alias("sa")), sets.select(F.col("lang").alias("b"), F.col("s").alias("sb"))
    return x.join(y, F.col("a") < F.col("b")).select("a", "b", F.round(F.size(F.array_intersect("sa", "sb")) / F.size(F.array_union("sa", "sb")), 6).alias("jaccard"))  # one row a language


@query("mx43_linear_fit", "SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept FROM lineitem")
def mx43(t):
    return t.lineitem.agg(F.round(F.regr_slope("l_extendedprice", "l_quantity"), 4).alias("slope"), F.round(F.regr_intercept("l_extendedprice", "l_quantity"), 4).alias("intercept"))


@query("mx46_paired_differences", "SELECT a, b, round(avg(d), 6) AS mean_difference, count(*) AS n FROM (SELECT a.l_returnflag AS a, b.l_returnflag AS b, a.q - b.q AS d FROM (SELECT l_orderkey, l_returnflag, avg(l_quantity) AS q FROM lineitem GROUP BY 1, 2) a JOIN (SELECT l_orderkey, l_returnflag, avg(l_quantity) AS q FROM lineitem GROUP BY 1, 2) b ON a.l_orderkey = b.l_orderkey AND a.l_returnflag < b.l_returnflag) GROUP BY a, b")
def mx46(t):
    per = t.lineitem.groupBy("l_orderkey", "l_returnflag").agg(F.avg("l_quantity").alias("q"))
    x, y = per.select("l_orderkey", F.col("l_returnflag").alias("a"), F.col("q").alias("qa")), per.select("l_orderkey", F.col("l_returnflag").alias("b"), F.col("q").alias("qb"))
    return x.join(y, "l_orderkey").filter("a < b").groupBy("a", "b").agg(F.round(F.avg(F.col("qa") - F.col("qb")), 6).alias("mean_difference"), F.count("*").alias("n"))
