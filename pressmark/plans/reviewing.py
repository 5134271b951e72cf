"""Queries on intervals, review of pages, rounds and labels, registers and caches."""

from __future__ import annotations

from pyspark.sql import functions as F

from pressmark.functions import text as T
from pressmark.operators import answers as A
from pressmark.operators import evaluation as E
from pressmark.operators import retrieval as S
from pressmark.operators import reviewing as V
from pressmark.plans.registry import part, query, scratch
from pressmark.plans.retrieval import TOKENS, asked, asking, question_terms
from pressmark.tables import dealt

BASE = "https://example.org/details"


def _boot(name: str, units: str, seed: str) -> str:
    """Registers the parts of a bootstrap of 200 resamples over units (s, u, num, den); gives the SELECT of value, low, high."""
    part(f"{name}_u", f"{name}_u AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY u) - 1 AS i, count(*) OVER (PARTITION BY s) AS n FROM ({units}))")
    part(f"{name}_d", f"{name}_d AS (SELECT r, s, ('0x' || substr(sha256('{seed}' || s || r::VARCHAR || ':' || i::VARCHAR), 1, 12))::BIGINT % n AS i FROM @{name}_u, (SELECT unnest(generate_series(0, 199)) AS r))")
    part(f"{name}_v", f"{name}_v AS (SELECT r, sum(num) / sum(den) AS v FROM @{name}_d JOIN @{name}_u USING (s, i) GROUP BY r)")
    return f"(SELECT round(sum(num) / sum(den), 6) FROM @{name}_u) AS value, (SELECT round(quantile_cont(v, 0.025), 6) FROM @{name}_v) AS low, (SELECT round(quantile_cont(v, 0.975), 6) FROM @{name}_v) AS high"


@query("ev11_paired_bootstrap", "SELECT " + _boot("pb", "SELECT '' AS s, p_partkey AS u, (p_size - length(p_name))::BIGINT AS num, 1 AS den FROM part", "pb"))
def ev11(t):
    rows = t.part.select("p_partkey", F.col("p_size").cast("long").alias("a"), F.char_length("p_name").cast("long").alias("b"))
    return E.paired_bootstrap(rows, "p_partkey", "a", "b", 200, "pb")


@query("ev13_cluster_bootstrap", "SELECT " + _boot("cl", "SELECT '' AS s, source AS u, sum(quality)::BIGINT AS num, count(*) AS den FROM labels JOIN documents USING (doc_id) GROUP BY source", "cl"))
def ev13(t):
    clusters = t.labels.join(t.documents, "doc_id").groupBy("source").agg(F.sum("quality").alias("num"), F.count("*").alias("den"))
    return E.bootstrap(clusters, "source", "num", "den", 200, "cl")


@query("ev14_population_total", "SELECT round(value, 2) AS per_item, round(value * 5000)::BIGINT AS total, round(low * 5000)::BIGINT AS total_low, round(high * 5000)::BIGINT AS total_high FROM (SELECT " + _boot("pt", "SELECT '' AS s, n_nationkey AS u, length(n_name)::BIGINT AS num, 1 AS den FROM nation", "pt") + ")")
def ev14(t):
    return E.bootstrap_total(t.nation.select("n_nationkey", F.char_length("n_name").cast("long").alias("v")), "n_nationkey", "v", 5000, 200, "pt")


@query("ev15_stratified_bootstrap", "SELECT " + _boot("st", "SELECT r_name AS s, n_nationkey AS u, length(n_name)::BIGINT AS num, 1 AS den FROM nation JOIN region ON r_regionkey = n_regionkey", "st"))
def ev15(t):
    rows = t.nation.join(t.region, F.col("r_regionkey") == F.col("n_regionkey")).select("r_name", "n_nationkey", F.char_length("n_name").cast("long").alias("num"), F.lit(1).alias("den"))
    return E.bootstrap(rows, "n_nationkey", "num", "den", 200, "st", strata="r_name")


@query("ev16_guardrail", "SELECT value, low, high, low > 0.2 AS holds FROM (SELECT " + _boot("gr", "SELECT '' AS s, o_orderpriority AS u, sum((o_orderstatus = 'F')::INT)::BIGINT AS num, count(*) AS den FROM orders GROUP BY 2", "gr") + ")")
def ev16(t):
    units = t.orders.groupBy("o_orderpriority").agg(F.sum((F.col("o_orderstatus") == "F").cast("int")).alias("num"), F.count("*").alias("den"))
    return E.bootstrap(units, "o_orderpriority", "num", "den", 200, "gr").select("*", (F.col("low") > 0.2).alias("holds"))


def _poisson(name: str, units: str, seed: str, scaled: bool = False) -> str:
    """As _boot, with Poisson weights of 200 resamples over units (s, u, num, den)."""
    weight = " + ".join(f"(x >= {step})::INT" for step in E.poisson_steps())
    part(f"{name}_u", f"{name}_u AS ({units})")
    part(f"{name}_x", f"{name}_x AS (SELECT r, s, num, den, ('0x' || substr(sha256('{seed}' || s || ':' || u || ':' || (r // 16)::VARCHAR), 1 + 4 * (r % 16), 4))::INT AS x FROM @{name}_u, (SELECT unnest(generate_series(0, 199)) AS r))")
    part(f"{name}_s", f"{name}_s AS (SELECT r, s, sum(w * num) AS a, sum(w * den) AS b, {'count(*)::DOUBLE / sum(w)' if scaled else '1.0'} AS f FROM (SELECT *, {weight} AS w FROM @{name}_x) GROUP BY r, s)")
    part(f"{name}_v", f"{name}_v AS (SELECT r, sum(a * f) / sum(b * f) AS v FROM @{name}_s GROUP BY r)")
    return f"(SELECT round(sum(num) / sum(den), 6) FROM @{name}_u) AS value, (SELECT round(quantile_cont(v, 0.025), 6) FROM @{name}_v) AS low, (SELECT round(quantile_cont(v, 0.975), 6) FROM @{name}_v) AS high"


@query("ev11_poisson_paired", "SELECT " + _poisson("pp", "SELECT '' AS s, doc_id::VARCHAR AS u, (quality - toxic)::DOUBLE AS num, 1.0 AS den FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL", "pp"))
def ev11_poisson(t):
    pairs = t.labels.select("doc_id", (F.col("quality") - F.col("toxic")).alias("num"), F.lit(1).alias("den"))
    return E.poisson_bootstrap(pairs, "doc_id", "num", "den", 200, "pp")


@query("ev12_poisson_ratio", "SELECT " + _poisson("pr", "SELECT '' AS s, o_orderkey::VARCHAR AS u, o_totalprice AS num, n AS den FROM orders JOIN (SELECT l_orderkey, count(*)::DOUBLE AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey", "pr"))
def ev12_poisson(t):
    leaves = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    return E.poisson_bootstrap(t.orders.join(leaves, "o_orderkey"), "o_orderkey", "o_totalprice", "n", 200, "pr")


@query("ev15_poisson_strata", "SELECT " + _poisson("ps", "SELECT o_orderpriority AS s, o_orderkey::VARCHAR AS u, o_totalprice AS num, 1.0 AS den FROM orders", "ps", True))
def ev15_poisson(t):
    return E.poisson_bootstrap(t.orders.withColumn("one", F.lit(1)), "o_orderkey", "o_totalprice", "one", 200, "ps", strata="o_orderpriority")


_Z = "1.959963984540054"
_W = f"(p + {_Z} * {_Z} / (2 * n) {{0}} {_Z} * sqrt(p * (1 - p) / n + {_Z} * {_Z} / (4 * n * n))) / (1 + {_Z} * {_Z} / n)"


@query("mx41_design_effect", f"SELECT value, low, high, round(a, 6) AS wilson_low, round(b, 6) AS wilson_high, round(((high - low) / (b - a)) ** 2, 2) AS design_effect FROM (SELECT {_boot('de', chr(83) + 'ELECT ' + chr(39) + chr(39) + ' AS s, c_nationkey AS u, sum((c_acctbal > 5000)::INT)::BIGINT AS num, count(*) AS den FROM customer GROUP BY 2', 'de')}), (SELECT {_W.format('-')} AS a, {_W.format('+')} AS b FROM (SELECT sum((c_acctbal > 5000)::INT) / count(*)::DOUBLE AS p, count(*)::DOUBLE AS n FROM customer))")
def mx41(t):
    clusters = t.customer.groupBy("c_nationkey").agg(F.sum((F.col("c_acctbal") > 5000).cast("int")).alias("num"), F.count("*").alias("den"))
    return E.design_effect(clusters, "c_nationkey", "num", "den", 200, "de")


part("asked", f"asked AS (SELECT item_id AS q, list_distinct(list_filter({TOKENS.format('text')}, lambda w: length(w) >= 7)) AS terms FROM benchmark WHERE item_id % 50 = 0)")
part("askedrank", """askedrank AS (SELECT q, doc_id, row_number() OVER (PARTITION BY q ORDER BY s DESC, doc_id) AS rank FROM (SELECT q, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / (tokens / n)))), 9) AS s FROM @postings JOIN @dfs USING (term) JOIN (SELECT q, unnest(terms) AS term FROM @asked) USING (term), @stats GROUP BY q, doc_id))""")


def _asked(t):
    """Every benchmark item whose id is divisible by 50 asks with its long words."""
    return t.benchmark.filter("item_id % 50 = 0").select(F.col("item_id").alias("q"), F.array_distinct(F.filter(T.tokens("text"), lambda w: F.char_length(w) >= 7)).alias("terms"))


@query("ev9_abstention_sweep", """SELECT a.q, CASE WHEN quality IS NOT NULL THEN CASE WHEN quality = 1 THEN 'answerable' ELSE 'abstain' END END AS gold, (len(terms) - coalesce(c, 0))::BIGINT AS uncovered, coalesce(k, 0) <= 1 AS single_source, coalesce(m, 0) < 3 OR len(terms) > coalesce(c, 0) AS would_abstain FROM @asked a
 LEFT JOIN (SELECT q, count(*) AS m, count(DISTINCT source) AS k FROM @askedrank JOIN documents USING (doc_id) WHERE rank <= 5 GROUP BY q) h ON h.q = a.q LEFT JOIN (SELECT doc_id, quality FROM labels) l ON l.doc_id = a.q
 LEFT JOIN (SELECT x.q, count(DISTINCT term) AS c FROM (SELECT q, unnest(terms) AS term FROM @asked) x JOIN @askedrank r ON r.q = x.q AND rank <= 5 JOIN @postings p USING (doc_id, term) GROUP BY x.q) v ON v.q = a.q""")
def ev9(t):
    questions = _asked(t)
    terms = [r["term"] for r in questions.select(F.explode("terms").alias("term")).distinct().collect()]  # of a bounded batch
    scored = S.bm25(S.postings(t.documents, "doc_id", "text", terms), S.collection(t.documents, "text"), questions.select("q", F.explode("terms").alias("term")), "doc_id")
    best = S.with_rank(scored.withColumn("score", F.round("score", 9)), "doc_id", ["q"], "rank").filter("rank <= 5")
    hits = t.documents.join(F.broadcast(best), "doc_id").select("q", F.col("source").alias("item"), T.tokens("text").alias("tokens"))  # five rows a question
    return E.abstention(questions, hits, t.labels.select(F.col("doc_id").alias("q"), F.col("quality").alias("answerable")), 3)


@query("rt28_result_memo", "SELECT doc_id, round(score, 6) AS score, true AS kept FROM (SELECT doc_id, round(score, 9) AS score FROM @lexical ORDER BY score DESC, doc_id LIMIT 25)")
def rt28(t):
    memo = A.Memo(t.spark, scratch(t.spark, "memo"))

    def run():
        scored = S.bm25(S.postings(t.documents, "doc_id", "text", asked(t)), S.collection(t.documents, "text"), question_terms(t), "doc_id")
        return scored.select("doc_id", F.round("score", 9).alias("score")).orderBy(F.desc("score"), "doc_id").limit(25)

    memo.get(("lexical", 25), run)
    again = memo.get(("lexical", 25), run)
    return again.select("doc_id", F.round("score", 6).alias("score"), F.lit((memo.hits, memo.misses) == (1, 1)).alias("kept"))


@query("tk1_exact_top", """SELECT q, vec_id, round(score, 6) AS score FROM (SELECT a.vec_id AS q, b.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS score, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) DESC, b.vec_id) AS r FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0) WHERE r <= 5""")
def tk1(t):
    return S.dense_batch(t.embeddings, "vec_id", "embedding", asking(t), "q", 5).select("q", "vec_id", F.round("score", 6).alias("score"))


@query("jn7_allowed_dense", """SELECT q, vec_id, round(score, 6) AS score FROM (SELECT a.vec_id AS q, b.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS score, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) DESC, b.vec_id) AS r FROM embeddings a, (SELECT * FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents WHERE lang = 'en')) b WHERE a.vec_id % 50 = 0) WHERE r <= 5""")
def jn7(t):
    allowed = t.embeddings.join(t.documents.filter("lang = 'en'").select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi")
    return S.dense_batch(allowed, "vec_id", "embedding", asking(t), "q", 5).select("q", "vec_id", F.round("score", 6).alias("score"))


@query("ag38_approximate_distinct", "SELECT lang, count(DISTINCT text) AS texts, true AS near FROM documents GROUP BY lang")
def ag38(t):
    n, guess = F.countDistinct("text"), F.approx_count_distinct("text", 0.02)
    return t.documents.groupBy("lang").agg(n.alias("texts"), (F.abs(guess - n) <= F.greatest(F.lit(2.0), 0.1 * n)).alias("near"))


@query("rt19_tie_by_shard", "SELECT n_name AS shard, row_number() OVER (ORDER BY n_regionkey DESC, n_name) AS place FROM nation")
def rt19(t):
    from pyspark.sql import Window

    return t.nation.select(F.col("n_name").alias("shard"), F.row_number().over(Window.orderBy(F.desc("n_regionkey"), "n_name")).cast("long").alias("place"))  # a row a shard


@query("mx16_local_candidates", "SELECT lang AS shard, doc_id, dl::INT AS dl, list_sort(list(term || '=' || tf::VARCHAR)) AS tf FROM @postings JOIN documents USING (doc_id) JOIN @qterms USING (term) GROUP BY lang, doc_id, dl")
def mx16(t):
    post = S.postings(t.documents, "doc_id", "text", asked(t)).join(t.documents.select("doc_id", F.col("lang").alias("shard")), "doc_id")
    return post.groupBy("shard", "doc_id", "dl").agg(F.sort_array(F.collect_list(F.concat_ws("=", "term", F.col("tf").cast("string")))).alias("tf"))  # terms of one question


@query("mx112_retrieval_settings", "SELECT 200 AS candidates, 10 AS top_k, 3 AS per_item, 60 AS rrf_k, 1.0::DOUBLE AS dense_weight, true AS drop_stopwords")
def mx112(t):
    from dataclasses import asdict

    c = asdict(S.RetrieveConfig())
    return t.spark.range(1).select(*[F.lit(v).alias(k) for k, v in c.items()])


@query("flt5_canonical_filters", "SELECT r_name, trim(r_name) AS place, round(r_regionkey / 7.0, 4)::DOUBLE AS min_ocr, [lower(r_name), 'report'] AS doc_types FROM region")
def flt5(t):
    from pressmark.operators.filters import Filters

    rows = t.region.collect()  # a few rows
    made = [Filters(jurisdiction=f"  {r['r_name']} ", doc_types=(" report", r["r_name"].lower(), "report"), min_ocr=r["r_regionkey"] / 7).canonical() for r in rows]
    return t.spark.createDataFrame([(r["r_name"], f.jurisdiction, f.min_ocr, list(f.doc_types)) for r, f in zip(rows, made)], "r_name string, place string, min_ocr double, doc_types array<string>")


@query("sc2_stop_words", f"SELECT item_id, len(list_filter({TOKENS.format('text')}, lambda w: w IN ({', '.join(repr(w) for w in T.STOPWORDS)}))) AS stopped FROM benchmark")
def sc2(t):
    return t.benchmark.select("item_id", F.size(F.filter(T.tokens("text"), lambda w: w.isin(T.STOPWORDS))).cast("long").alias("stopped"))


@query("sc26_folded", "SELECT item_id, trim(regexp_replace(lower(strip_accents(text)), '[^a-z0-9]+', ' ', 'g')) AS folded FROM benchmark")
def sc26(t):
    return t.benchmark.select("item_id", T.folded("text").alias("folded"))


@query("sc43_normalised_questions", "SELECT item_id, trim(regexp_replace(nfc_normalize('  ' || chr(7) || text || chr(10) || ' e' || chr(769)), '[\\x00-\\x20\\x7F]+', ' ', 'g')) AS question FROM benchmark")
def sc43(t):
    raw = F.concat(F.lit("  \x07"), "text", F.lit("\n é"))
    return t.benchmark.select("item_id", T.normalised_question(raw).alias("question"))


@query("mx107_year_spans", "SELECT event_id, [3, 7, 16, 20] AS spans FROM events")
def mx107(t):
    y = lambda a, m: (F.lit(a) + F.col("event_id") % m).cast("string")
    x = F.concat(F.lit("in "), y(1950, 50), F.lit(" or 19x, "), F.substring(y(2000, 90), 1, 4), F.lit("."))
    return t.events.select("event_id", F.flatten(F.transform(T.year_spans(x), lambda s: F.array(s["start"], s["end"]))).alias("spans"))


# -- pages


part("dated_text", "dated_text AS (SELECT doc_id, y, substr(coalesce(text, ''), 1, 90) || ' in ' || y || ' ' || coalesce(text, '') AS x FROM (SELECT doc_id, text, (1901 + doc_id % 90)::VARCHAR AS y FROM documents))")


@query("sc47_year_line", r"""SELECT doc_id, CASE WHEN y IS NOT NULL THEN trim(regexp_replace(CASE WHEN fin < length(x) AND NOT regexp_matches(x[fin + 1], '^\s$') THEN regexp_replace(p, '\S+$', '') ELSE p END, '\s+', ' ', 'g')) END AS line FROM (
 SELECT *, CASE WHEN start > 0 AND NOT regexp_matches(x[greatest(start, 1)], '^\s$') THEN regexp_replace(substr(x, start + 1, fin - start), '^\S+', '') ELSE substr(x, start + 1, fin - start) END AS p FROM (
 SELECT doc_id, y, x, greatest(0, strpos(x, ' in ' || y || ' ') + 3 - 60) AS start, least(length(x), strpos(x, ' in ' || y || ' ') + 7 + 60) AS fin FROM @dated_text))""")
def sc47(t):
    y = (F.col("doc_id") % 90 + 1901).cast("string")
    x = F.concat(F.substring(F.coalesce("text", F.lit("")), 1, 90), F.lit(" in "), y, F.lit(" "), F.coalesce("text", F.lit("")))
    return t.documents.select("doc_id", V.year_line(x, y).alias("line"))


@query("mx24_cut_texts", r"""SELECT doc_id, md5(CASE WHEN length(x) <= 400 THEN x ELSE substr(x, length(h) - length(string_split(h, chr(10))[-1]) + 1, fin + length(string_split(substr(x, fin + 1), chr(10))[1]) - (length(h) - length(string_split(h, chr(10))[-1]))) END) AS shown FROM (
 SELECT *, substr(x, 1, start + 1) AS h FROM (SELECT *, greatest(0, fin - 400) AS start FROM (SELECT doc_id, x, least(length(x), greatest(0, place - 133) + 400)::INT AS fin FROM (SELECT doc_id, x, greatest(0, strpos(lower(x), lower(k)) - 1) AS place FROM (SELECT doc_id, coalesce(text, '') AS x, substr(coalesce(text, ''), length(coalesce(text, '')) // 2, 12) AS k FROM documents)))))""")
def mx24(t):
    x = F.coalesce("text", F.lit(""))
    keep = F.expr("substring(coalesce(text, ''), cast(char_length(coalesce(text, '')) div 2 as int), 12)")
    return t.documents.select("doc_id", F.md5(V.cut_around(x, keep, 400)).alias("shown"))


def _pages(t):
    return t.lineitem.groupBy(F.col("l_orderkey").alias("item_id"), F.col("l_linenumber").alias("leaf")).agg(F.concat(F.lit("shipped "), F.min(F.year("l_shipdate")).cast("string")).alias("text"))


@query("mx25_page_records", """SELECT a.l_orderkey::VARCHAR || '#' || a.l_linenumber::VARCHAR AS ref, o_orderstatus AS title, year(o_orderdate)::INT AS year, CASE WHEN p IS NULL THEN 'not_found' WHEN p = l_linenumber THEN 'read_from_page' ELSE 'read_from_front_matter' END AS read_method, p IS NOT NULL AND o_orderstatus <> 'P' AS date_verified, sha256('shipped ' || y::VARCHAR) AS text_sha256
 FROM (SELECT a.*, (SELECT arg_min(b.l_linenumber, ROW((b.l_linenumber <> a.l_linenumber)::INT, b.l_linenumber)) FROM sp b WHERE b.l_orderkey = a.l_orderkey AND (b.l_linenumber = a.l_linenumber OR b.l_linenumber < 6) AND b.y = year(a.o_orderdate)) AS p FROM (SELECT * FROM sp JOIN orders ON o_orderkey = l_orderkey) a) a""".replace("FROM sp", "FROM (SELECT l_orderkey, l_linenumber, min(year(l_shipdate))::INT AS y FROM lineitem GROUP BY 1, 2)"))
def mx25(t):
    pages = _pages(t)
    items = t.orders.select(F.col("o_orderkey").alias("item_id"), F.col("o_orderstatus").alias("title"), F.year("o_orderdate").alias("year"), F.when(F.col("o_orderstatus") != "P", "exact").otherwise("unknown").alias("date_method"))
    dates = A.page_dated(pages.join(items, "item_id").select("item_id", "leaf", "year"), pages)
    return V.page_records(pages, items, dates, BASE).select("ref", "title", "year", "read_method", "date_verified", "text_sha256")


@query("mx27_question_pool", "SELECT ref, decade, rank, year FROM (SELECT *, row_number() OVER (PARTITION BY decade ORDER BY rank, ref) AS k FROM (SELECT p_name AS ref, min(ROW(p_size // 10, p_partkey, p_size)) AS m, m[1] AS decade, m[2] AS rank, m[3] AS year FROM part WHERE p_size % 3 <> 0 AND p_brand <> 'Brand#2' AND p_size % 7 <> 0 GROUP BY p_name)) WHERE k <= 3".replace("m[1]", "min(ROW(p_size // 10, p_partkey, p_size))[1]").replace("m[2]", "min(ROW(p_size // 10, p_partkey, p_size))[2]").replace("m[3]", "min(ROW(p_size // 10, p_partkey, p_size))[3]").replace("min(ROW(p_size // 10, p_partkey, p_size)) AS m, ", ""))
def mx27(t):
    size = F.col("p_size")
    hits = t.part.select(F.col("p_name").alias("ref"), F.floor(size / 10).alias("decade"), F.col("p_partkey").alias("rank"), F.when(size % 7 != 0, size).alias("year"), (size % 3 != 0).alias("verified"), (F.col("p_brand") == "Brand#2").alias("care"))
    return V.question_pool(hits, 3)


# -- rounds: a part is a round of one page with one quote


def _rounds(t):
    k = F.col("p_partkey")
    item = F.concat(F.lit("p"), k.cast("string"))
    year = (F.col("p_size") + 1950).cast("int")
    full = F.concat_ws(" ", "p_name", F.lit("of"), "p_type", F.lit("issued"), year.cast("string"))
    shown = F.when(k % 5 == 0, F.concat(full, F.lit(" more"))).otherwise(full)
    base = t.part.select(k.alias("round"), F.concat(item, F.lit("#0")).alias("ref"), item.alias("item_id"), F.lit(0).alias("leaf"), shown.alias("text"), F.sha2(T.squash(full), 256).alias("text_sha256"), year.alias("cat_year"), F.when(k % 3 == 0, year + 1).otherwise(year).alias("read_year"), F.concat(F.lit("issued "), year.cast("string")).alias("read_line"), full.alias("full"), "p_brand")
    rounds = t.part.select(k.alias("round"), F.when(k % 2 == 0, "when_was_this").otherwise("same_or_not").alias("mode"), F.when(k % 4 == 0, year + 5).otherwise(year).alias("play_year"), F.when(k % 6 == 0, "draft").otherwise("reviewed").alias("status"))
    quotes = t.part.select(k.alias("round"), k.alias("quote"), F.concat(item, F.lit("#0")).alias("ref"), F.when(k % 8 == 0, "no such words").otherwise(F.col("p_name")).alias("text"))
    return base, rounds, quotes


@query("mx29_round_reasons", """SELECT p_partkey AS round, list_sort(list_filter([CASE WHEN p_partkey % 7 = 0 THEN 'page_unresolved:' || r END, CASE WHEN p_partkey % 7 <> 0 AND p_partkey % 5 = 0 THEN 'page_text_changed:' || r END, CASE WHEN p_partkey % 7 <> 0 AND p_partkey % 3 = 0 THEN 'date_unverified:' || r END,
 CASE WHEN p_partkey % 7 <> 0 AND p_partkey % 8 = 0 THEN 'quote_not_on_page:' || p_partkey::VARCHAR END, CASE WHEN p_partkey % 4 = 0 THEN 'answer_year_unverified' END], lambda x: x IS NOT NULL)) AS reasons FROM (SELECT p_partkey, 'p' || p_partkey::VARCHAR || '#0' AS r FROM part)""")
def mx29(t):
    base, rounds, quotes = _rounds(t)
    corpus = base.filter("round % 7 <> 0").select("item_id", "leaf", F.col("full").alias("text"))
    items = base.select("item_id", F.col("cat_year").alias("year"), F.lit("exact").alias("date_method"))
    return V.round_reasons(rounds, base.drop("full", "p_brand"), quotes, corpus, items)


@query("mx108_release_problems", """SELECT round, problem FROM (SELECT p_partkey AS round, unnest([CASE WHEN p_partkey % 6 = 0 THEN 'status draft is not publishable' END, CASE WHEN p_partkey % 9 = 0 THEN r || ': no link to its own page' END, CASE WHEN p_partkey % 3 = 0 THEN r || ': date is not verified' END, CASE WHEN p_partkey % 8 = 0 THEN 'quote ' || p_partkey::VARCHAR || ' is not in the page text' END]) AS problem FROM (SELECT p_partkey, 'p' || p_partkey::VARCHAR || '#0' AS r FROM part)) WHERE problem IS NOT NULL""")
def mx108(t):
    from pressmark.functions.ingest import page_link

    base, rounds, quotes = _rounds(t)
    pages = base.withColumn("details_url", F.when(F.col("round") % 9 == 0, F.lit("https://example.org/other")).otherwise(page_link(BASE, F.col("item_id"), F.col("leaf"))))
    return V.release_problems(rounds, pages, quotes, BASE, ("reviewed",))


@query("mx30_round_fingerprint", "SELECT round, sha256('{\"mode\":\"' || mode || '\",\"play_year\":' || y::VARCHAR || ',\"round\":' || round::VARCHAR || '}') AS print FROM (SELECT p_partkey AS round, CASE WHEN p_partkey % 2 = 0 THEN 'when_was_this' ELSE 'same_or_not' END AS mode, CASE WHEN p_partkey % 4 = 0 THEN p_size + 1955 ELSE p_size + 1950 END AS y FROM part)")
def mx30(t):
    rounds = _rounds(t)[1]
    return rounds.select("round", V.fingerprint(rounds, "status").alias("print"))


@query("mx97_story_problems", """SELECT story, problem FROM (SELECT p_partkey AS story, unnest([CASE WHEN p_size % 3 <> 0 AND p_size % 2 = 0 THEN 'caption says replaced' END, CASE WHEN p_size % 5 = 0 AND p_brand <> 'Brand#1' THEN 'answers a different question with no note on that answer' END, CASE WHEN p_size % 5 = 0 AND p_partkey % 4 <> 0 THEN 'question was replaced with no note on the story' END]) AS problem FROM part) WHERE problem IS NOT NULL""")
def mx97(t):
    size, k = F.col("p_size"), F.col("p_partkey")
    stories = t.part.select(k.alias("story"), F.when(size % 2 == 0, "It replaced the old.").otherwise("It was not replaced.").alias("caption"), F.concat(F.lit("What of "), "p_brand", F.lit("?")).alias("question"), F.when(size % 3 == 0, "comparable").otherwise("unlike").alias("outcome"), F.when(size % 5 == 0, F.concat(F.lit("Which "), "p_brand", F.lit("?"))).alias("answer_question"))
    notes = t.spark.createDataFrame([("Which Brand#1?", None)], "question string, story long").unionByName(t.part.filter("p_partkey % 4 = 0").select(F.lit(None).cast("string").alias("question"), k.alias("story")))
    return V.story_problems(stories, notes, ("comparable",))


# -- drafted items, votes, labels


@query("mx31_audit_items", "SELECT 'sentence' AS kind, conv_id::VARCHAR || ':' || turn::VARCHAR AS item, md5(coalesce(text, '')) AS text_md5, md5(a) AS answer_md5 FROM conversations JOIN (SELECT conv_id, string_agg(coalesce(text, ''), ' ' ORDER BY turn) AS a FROM conversations GROUP BY 1) USING (conv_id) UNION ALL SELECT 'answer', conv_id::VARCHAR || ':answer', NULL, md5(string_agg(coalesce(text, ''), ' ' ORDER BY turn)) FROM conversations GROUP BY conv_id")
def mx31(t):
    items = V.audit_items(t.conversations.select(F.col("conv_id").alias("q"), F.col("turn").alias("sentence_no"), "text"))
    return items.select("kind", "item", F.md5("text").alias("text_md5"), F.md5("answer_text").alias("answer_md5"))


@query("mx35_review_share", "SELECT n_name FROM (SELECT n_name, row_number() OVER (ORDER BY sha256('review:run1:' || n_name), n_name) AS r FROM nation) WHERE r <= ceil(0.3 * (SELECT count(*) FROM nation) - 1e-9)")
def mx35(t):
    return V.review_share(t.nation, "n_name", 0.3, "run1")


@query("mx80_binary_labels", "SELECT CASE WHEN l_returnflag = 'N' THEN NULL WHEN l_returnflag = 'A' THEN 'pass' ELSE 'not_pass' END AS label, count(*) AS n FROM lineitem GROUP BY 1")
def mx80(t):
    label = F.when(F.col("l_returnflag") == "A", "pass").when(F.col("l_returnflag") == "R", "fail")
    return t.lineitem.groupBy(V.binary(label).alias("label")).agg(F.count("*").alias("n"))


@query("mx81_flagged_items", "SELECT c_custkey, c_nationkey % 3 = 0 OR c_nationkey % 5 = 0 OR c_nationkey % 7 = 0 AS flagged FROM customer")
def mx81(t):
    k = F.col("c_nationkey")
    silver = F.when(k % 2 == 0, F.array(F.lit("pass"), F.lit("pass"))).when(k % 3 != 0, F.array(F.lit("pass")))
    silver = F.when(k % 3 == 0, F.array(F.lit("pass"), F.lit(None).cast("string"))).otherwise(silver)
    return t.customer.select("c_custkey", V.flagged(silver, F.when(k % 5 == 0, True), F.array(F.lit(None).cast("string"), F.when(k % 7 == 0, "fail").otherwise("pass"))).alias("flagged"))


@query("mx84_pair_finals", "SELECT p_partkey, CASE WHEN a = b THEN a WHEN e = a OR e = b THEN e END AS final, coalesce(a <> b, true) AS escalated FROM (SELECT p_partkey, CASE WHEN p_size % 5 > 0 THEN p_size % 2 END AS a, p_partkey % 2 AS b, p_size % 3 AS e FROM part)")
def mx84(t):
    size = F.col("p_size")
    final, escalated = V.pair_finals(F.when(size % 5 > 0, (size % 2).cast("long")), (F.col("p_partkey") % 2).cast("long"), (size % 3).cast("long"))
    return t.part.select("p_partkey", final.alias("final"), escalated.alias("escalated"))


@query("mx39_contributions", "SELECT sum((o AND NOT s AND f)::INT)::BIGINT AS found, sum((o AND NOT s)::INT)::BIGINT AS asked, sum((o AND s AND r)::INT)::BIGINT AS refused, sum((o AND s)::INT)::BIGINT AS to_refuse, sum((o AND e)::INT)::BIGINT AS right_state, sum(o::INT)::BIGINT AS stated FROM (SELECT p_size % 7 <> 0 AS o, p_size % 4 = 0 AS s, p_size % 3 = 0 AS r, p_size % 5 < 2 AS f, p_partkey % 2 = 0 AS e FROM part)")
def mx39(t):
    size = F.col("p_size")
    c = V.contributions(size % 7 != 0, size % 3 == 0, size % 4 == 0, F.array(F.lit("a#1"), F.lit("a#2")), F.when(size % 5 < 2, F.array(F.lit("x#1"), F.lit("a#2"))).otherwise(F.array(F.lit("x#1"))), F.lit("SUPPORTED"), F.when(F.col("p_partkey") % 2 == 0, "SUPPORTED").otherwise("OTHER"))
    total = lambda metric, side: F.sum(F.col(f"c.{metric}.{side}"))
    pairs = (("recall_at_10", "found", "asked"), ("refusal_rate", "refused", "to_refuse"), ("state_accuracy", "right_state", "stated"))
    return t.part.select(c.alias("c")).agg(*[total(m, side).alias(name) for m, a, b in pairs for side, name in (("num", a), ("den", b))])


@query("op_u9_applied_labels", "SELECT l_orderkey AS q, l_linenumber AS passage_id, (l_linenumber = 1 AND l_orderkey % 2 = 0)::INT AS relevance, (l_orderkey % 2 = 0)::INT AS answerable FROM (SELECT *, count(*) OVER (PARTITION BY l_orderkey) AS n FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)) WHERE n = 3 AND l_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 1)")
def op_u9(t):
    lines = t.lineitem.select(F.col("l_orderkey").alias("q"), F.col("l_linenumber").alias("rank")).distinct()
    three = lines.groupBy("q").agg(F.count("*").alias("n"), F.min("rank").alias("low")).filter("n = 3 and low = 1").select("q")
    sheet = lines.join(three, "q").withColumn("passage_id", F.col("rank"))
    decisions = three.select("q", F.when(F.col("q") % 2 == 0, "a").otherwise("x").alias("verdict"), F.when(F.col("q") % 2 == 0, F.array(F.lit(1))).otherwise(F.array().cast("array<int>")).cast(f"array<{lines.schema['rank'].dataType.simpleString()}>").alias("relevant"))
    return V.applied_labels(decisions, sheet, 3)


@query("mx93_scope_hints", "SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 'asked' WHEN contains(lower(p_type), 'tin') THEN 'tin' WHEN contains(lower(p_type), 'brass') THEN 'brass' END AS place, CASE WHEN 1900 + p_size * 3 > 2010 THEN 'period after the window' WHEN 1900 + p_size * 3 < 1930 THEN 'very early period' END AS problem FROM part")
def mx93(t):
    text = F.concat("p_type", F.lit(" in "), (F.col("p_size") * 3 + 1900).cast("string"))
    place, problem = V.scope_hints(text, F.when(F.col("p_size") % 4 == 0, "asked"), {"tin": "tin", "brass": "brass"}, 2010)
    return t.part.select("p_partkey", place.alias("place"), problem.alias("problem"))


@query("mx94_label_worksheet", """SELECT kind, q, rank, proposed FROM (SELECT 'candidate' AS kind, l_orderkey AS q, l_linenumber AS rank, (l_linenumber % 2 = 0)::INT AS proposed FROM w UNION ALL SELECT 'summary', l_orderkey, NULL, max((l_linenumber % 2 = 0)::INT) FROM w GROUP BY l_orderkey)""".replace("FROM w", "FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)"))
def mx94(t):
    [lines] = dealt((t.lineitem, "l_orderkey"))
    hits = lines.select(F.col("l_orderkey").alias("q"), F.col("l_linenumber").alias("rank")).distinct()
    hits = hits.select("q", "rank", F.concat_ws("-", "q", "rank").alias("passage_id"), F.when(F.col("rank") % 2 == 0, "steel and copper rings").otherwise("steel only").alias("text"))
    questions = hits.select("q").distinct().withColumn("text", F.lit("Were steel rings or copper bolts made?"))
    return V.worksheet(questions, hits).select("kind", "q", "rank", "proposed")


@query("mx95_upserted_questions", "SELECT n_nationkey AS q, CASE WHEN n_nationkey % 3 = 0 THEN 'new ' || n_name ELSE n_name END AS text, CASE WHEN n_nationkey % 3 = 0 THEN 'fact' END AS qtype FROM nation")
def mx95(t):
    have = t.nation.select(F.col("n_nationkey").alias("q"), F.col("n_name").alias("text"), F.lit(None).cast("string").alias("qtype")).filter("q % 6 <> 0")
    records = t.nation.filter("n_nationkey % 3 = 0").select(F.col("n_nationkey").alias("q"), F.concat(F.lit("new "), "n_name").alias("text"), F.lit("fact").alias("qtype"))
    return V.upserted_questions(have, records, ("fact", "change"), True)


_PICKED = "('0x' || substr(sha256('trap' || p_partkey::VARCHAR), 1, 12))::BIGINT"


@query("mx36_trap_questions", f"""SELECT p_partkey, 'What did ' || place || ' government publications from the ' || decade || ' report about ' || p_name || '?' AS question, true AS sound FROM (
 SELECT p_partkey, p_name, (ds[{_PICKED} % len(ds) + 1])::VARCHAR || 's' AS decade, ps[{_PICKED} % len(ps) + 1] AS place FROM (SELECT p_partkey, p_name, list_filter([1960, 1970, 1980, 1990, 2000], lambda d: abs(d - (1960 + p_size) // 10 * 10) >= 30) AS ds, list_filter(['north', 'south', 'east'], lambda p: p <> CASE p_size % 3 WHEN 0 THEN 'north' WHEN 1 THEN 'south' ELSE 'east' END) AS ps FROM part) WHERE len(ds) > 0)""")
def mx36(t):
    size, k = F.col("p_size"), F.col("p_partkey")
    decade = V.other_decade(size + 1960, k, 1960, 2009, "trap")
    place = V.other_place(F.when(size % 3 == 0, "north").when(size % 3 == 1, "south").otherwise("east"), k, ("north", "south", "east"), "trap")
    q = V.trap_question("wrong_period", F.concat("p_name", F.lit(" .")), place, decade)
    return t.part.select("p_partkey", q.alias("question"), V.question_sound(q).alias("sound")).filter("question is not null")


@query("mx55_number_dense", "SELECT o_orderkey FROM (SELECT o_orderkey, len(list_distinct([(10 + o_orderkey % 97)::VARCHAR, (10 + o_orderkey % 89)::VARCHAR, (10 + o_orderkey % 7)::VARCHAR, (10 + o_orderkey % 5)::VARCHAR, (10 + o_orderkey % 3)::VARCHAR, (1000 + o_orderkey % 2)::VARCHAR])) AS n FROM orders) WHERE n >= 5")
def mx55(t):
    k = F.col("o_orderkey")
    text = F.concat_ws(" and ", *[(k % m + 10).cast("string") for m in (97, 89, 7, 5, 3)], F.concat(F.lit("1,"), F.lpad((k % 2).cast("string"), 3, "0"), F.lit(" 7")))
    return t.orders.filter(F.size(T.numbers(text)) >= 5).select("o_orderkey")


# -- citations


def _cited(t):
    k = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    return t.lineitem.select(k.alias("id"), F.col("l_orderkey").cast("string").alias("item_id"), F.col("l_linenumber").cast("int").alias("leaf")).distinct()


@query("mx77_corpus_citations", "SELECT id AS cite, id % 7 <> 0 AS exists, id % 7 <> 0 AND id % 5 <> 0 AS item_matches, id % 7 <> 0 AND id % 4 <> 0 AS leaf_matches, CASE WHEN id % 7 = 0 THEN 'missing' WHEN id % 3 = 0 THEN 'ascii_folded' ELSE 'exact' END AS text_class, id % 7 <> 0 AND id % 2 = 0 AS link_ok FROM (SELECT DISTINCT l_orderkey * 10 + l_linenumber AS id FROM lineitem)")
def mx77(t):
    from pressmark.functions.ingest import page_link

    i = F.col("id")
    passages = _cited(t).filter(i % 7 != 0).select(i.alias("passage_id"), "item_id", "leaf", F.lit("Café au lait").alias("text"))
    cites = _cited(t).select(i.alias("cite"), i.alias("passage_id"), F.when(i % 5 == 0, "other").otherwise(F.col("item_id")).alias("item_id"), F.when(i % 4 == 0, 99).otherwise(F.col("leaf")).alias("leaf"), F.when(i % 3 == 0, "cafe, au lait").otherwise("café AU lait").alias("text"), F.when(i % 2 == 0, page_link(BASE, F.col("item_id"), F.col("leaf"))).alias("link"), F.lit(None).cast("boolean").alias("retrieved"))
    return V.corpus_citations(cites, passages, BASE).drop("retrieved")


@query("mx78_gate_bundle", "SELECT verdict, count(*) AS n FROM (SELECT CASE WHEN id % 7 = 0 OR id % 5 = 0 OR id % 4 = 0 OR id % 2 = 1 THEN 'fail' WHEN id % 3 = 0 THEN 'unrecorded' ELSE 'pass' END AS verdict FROM (SELECT DISTINCT l_orderkey * 10 + l_linenumber AS id FROM lineitem)) GROUP BY verdict")
def mx78(t):
    from pressmark.functions.ingest import page_link, verdict

    i = F.col("id")
    passages = _cited(t).filter(i % 7 != 0).select(i.alias("passage_id"), "item_id", "leaf", F.lit("words").alias("text"))
    cites = _cited(t).select(i.alias("cite"), i.alias("passage_id"), F.when(i % 5 == 0, "other").otherwise(F.col("item_id")).alias("item_id"), F.when(i % 4 == 0, 99).otherwise(F.col("leaf")).alias("leaf"), F.lit("words").alias("text"), F.when(i % 2 == 0, page_link(BASE, F.col("item_id"), F.col("leaf"))).alias("link"), F.when(i % 3 != 0, True).alias("retrieved"))
    said = V.corpus_citations(cites, passages, BASE).withColumn("matches", F.col("item_matches") & F.col("leaf_matches") & (F.col("text_class") != "differs"))
    each = said.groupBy("cite").agg(verdict(F.col("exists"), F.col("matches"), F.col("link_ok"), F.col("retrieved")).alias("verdict"))
    return each.groupBy("verdict").agg(F.count("*").alias("n"))


@query("mx19_supplied_citations", "SELECT c_custkey AS passage_id, c_custkey % 3 <> 0 AS exists, c_custkey % 2 = 0 AS in_evidence, c_custkey % 3 <> 0 AND c_custkey % 5 <> 0 AS resolves FROM customer")
def mx19(t):
    k = F.col("c_custkey")
    rows = t.customer.filter(k % 3 != 0).select((k % 10).alias("answer"), k.alias("passage_id"), F.col("c_name").alias("item_id"), F.when(k % 5 != 0, 1).alias("leaf"))
    cites = t.customer.select((k % 10).alias("answer"), k.alias("passage_id"), (k % 2 == 0).alias("in_evidence"))
    return V.supplied_citations(cites, rows, BASE).select("passage_id", "exists", "in_evidence", "resolves")


@query("mx21_date_methods", "SELECT l_orderkey, l_linenumber, CASE o_orderstatus WHEN 'F' THEN 'exact' WHEN 'O' THEN 'title_extracted' ELSE 'unknown' END AS date_method FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey AND o_orderkey % 9 <> 0".replace("ELSE 'unknown' END", "WHEN 'P' THEN 'unknown' END"))
def mx21(t):
    method = F.when(F.col("o_orderstatus") == "F", "exact").when(F.col("o_orderstatus") == "O", "title_extracted").otherwise("unknown")
    known = t.orders.filter("o_orderkey % 9 <> 0").select(F.col("o_orderkey").alias("l_orderkey"), method.alias("date_method"))
    return t.lineitem.select("l_orderkey", "l_linenumber").join(known, "l_orderkey", "left")


# -- registers and caches


@query("mx10_rights_applied", "SELECT status, count(*) AS n, sum(topic::INT)::BIGINT AS with_topics FROM (SELECT CASE WHEN o_orderpriority <> '5-LOW' AND o_orderstatus = 'F' THEN CASE WHEN year(o_orderdate) <= 2046 - 51 THEN 'PD_CA_CROWN' ELSE 'CROWN_IN_COPYRIGHT' END ELSE 'UNKNOWN' END AS status, contains(lower(c_mktsegment), 'house') AS topic FROM orders JOIN customer ON c_custkey = o_custkey) GROUP BY status")
def mx10(t):
    from pressmark.functions.ingest import rights
    from pressmark.operators.care import topics

    docs = t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey"))
    status = rights(F.when(F.col("o_orderpriority") != "5-LOW", "federal").otherwise("private"), F.year("o_orderdate"), F.col("o_orderstatus") == "F", 2046)
    rows = docs.select(status.alias("status"), (F.size(topics(F.col("c_mktsegment"), {"home": ["(?i)house"]})) > 0).alias("topic"))
    return rows.groupBy("status").agg(F.count("*").alias("n"), F.sum(F.col("topic").cast("int")).alias("with_topics"))


@query("mx102_care_blocks", "SELECT c_custkey, CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN ['home'] WHEN c_mktsegment = 'MACHINERY' THEN ['work'] ELSE [] END::VARCHAR[] AS topics FROM customer")
def mx102(t):
    from pressmark.operators.care import topics

    whole = F.concat_ws(" ", "c_name", F.lit(None).cast("string"), "c_mktsegment")
    return t.customer.select("c_custkey", topics(whole, {"home": [r"(?i)\bhousehold\b"], "work": [r"(?i)\bmachinery\b"]}).alias("topics"))


@query("mx11_policy_problems", "SELECT policy_id, list_filter([CASE WHEN policy_id IS NULL THEN 'no_id' END, CASE WHEN s % 4 = 0 THEN 'unknown_use' END, CASE WHEN policy_id IS NOT NULL AND count(*) OVER (PARTITION BY policy_id) > 1 THEN 'duplicate' END, CASE WHEN s % 3 = 0 THEN 'fixture' END], lambda x: x IS NOT NULL) AS problems FROM (SELECT CASE WHEN p_partkey % 10 <> 0 THEN p_name END AS policy_id, p_size AS s FROM part)")
def mx11(t):
    size = F.col("p_size")
    rows = t.part.select(F.when(F.col("p_partkey") % 10 != 0, F.col("p_name")).alias("policy_id"), F.when(size % 4 == 0, F.array(F.lit("retrieve"), F.lit("burn"))).otherwise(F.array(F.lit("export"))).alias("restrict"), (size % 3 == 0).alias("fixture"))
    return V.policy_problems(rows, False, ("retrieve", "generate", "export"))


@query("op_u7_append_only_trail", "SELECT true AS kept, count(*) AS added FROM orders WHERE o_orderstatus = 'F'")
def op_u7(t):
    path = scratch(t.spark, "trail")
    rows = t.orders.select("o_orderkey", "o_orderstatus")
    V.appended(path, rows.filter("o_orderstatus <> 'F'"))
    before = rows.filter("o_orderstatus <> 'F'")
    V.appended(path, rows.filter("o_orderstatus = 'F'"))
    return V.unaltered(before, t.spark.read.parquet(path))


@query("mx57_capped_rows", "SELECT c_custkey, TIMESTAMP '2024-01-01 00:00:00' + INTERVAL (least(CASE WHEN c_nationkey % 5 = 0 THEN 90 ELSE c_nationkey * 10 END, 90)) DAYS AS expires, list_filter([CASE WHEN c_nationkey % 3 = 0 THEN 'key_is_no_digest' END, CASE WHEN c_nationkey % 2 = 1 THEN 'question_kept' END], lambda x: x IS NOT NULL) AS problems FROM customer")
def mx57(t):
    k = F.col("c_nationkey")
    asked_for = F.when(k % 5 == 0, "not a date").otherwise(F.date_format(F.date_add(F.lit("2024-01-01"), (k * 10).cast("int")), "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    expires = V.capped_expiry(F.lit("2024-01-01T00:00:00Z"), asked_for, 90, F.lit("2030-01-01").cast("timestamp"))
    problems = V.row_problems(F.when(k % 3 == 0, "x").otherwise(F.sha2("c_name", 256)), F.lit(False), F.when(k % 2 == 1, F.col("c_name")), F.lit("2024"))
    return t.customer.select("c_custkey", expires.cast("timestamp_ntz").alias("expires"), problems.alias("problems"))


@query("mx58_awake_hours", "SELECT c_nationkey, round(least(24.0, count(*) * 0.75), 6) AS hours FROM customer GROUP BY 1")
def mx58(t):
    visits = t.customer.groupBy("c_nationkey").agg(F.count("*").alias("n"))
    return visits.select("c_nationkey", F.round(F.least(F.lit(24.0), F.col("n") * 0.75), 6).alias("hours"))


@query("mx99_context_key", "SELECT r_name, sha256('{\"data\":{\"db\":\"' || sha256(r_name) || '\",\"index\":\"' || sha256('i' || r_name) || '\"},\"settings\":{\"model\":\"m\",\"scope\":\"' || r_name || '\",\"top_k\":10}}') AS k FROM region")
def mx99(t):
    data = {"index": F.upper(F.sha2(F.concat(F.lit("i"), "r_name"), 256)), "db": F.sha2("r_name", 256)}
    return t.region.select("r_name", V.context_key(data, {"top_k": F.lit(10), "scope": F.col("r_name"), "model": F.lit("m")}).alias("k"))


@query("mx17_router_filters", "SELECT p_partkey, p_brand AS place, (CASE WHEN p_size % 2 = 0 THEN 1900 + p_size WHEN p_size % 3 = 0 THEN 1970 END)::INT AS first_year, (CASE WHEN p_size % 5 = 0 THEN 2000 WHEN p_size % 7 = 0 THEN 1999 WHEN p_size % 3 = 0 THEN 1979 END)::INT AS last_year FROM part")
def mx17(t):
    size = F.col("p_size")
    f = V.router_filters(F.col("p_brand"), F.when(size % 3 == 0, "1970s").otherwise("undated"), F.when(size % 2 == 0, (size + 1900).cast("string")), F.when(size % 5 == 0, "2000"), F.when(size % 7 == 0, "1999"))
    return t.part.select("p_partkey", f["place"].alias("place"), f["first_year"].alias("first_year"), f["last_year"].alias("last_year"))


@query("mx49_read_latency", "SELECT event_type, count(*) AS n, arg_min(value, event_id) AS first, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, max(value) AS most FROM events GROUP BY event_type")
def mx49(t):
    disc = lambda q: F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY value)")
    return t.events.groupBy("event_type").agg(F.count("*").alias("n"), F.min_by("value", "event_id").alias("first"), disc(0.5).alias("p50"), disc(0.95).alias("p95"), F.max("value").alias("most"))


@query("sql_functions", "SELECT p_partkey, round(ln(1 + (1000 - p_size + 0.5) / (p_size + 0.5)) * 3 * 2.2 / (3 + 1.2 * (0.25 + 0.75 * 40 / (50000 / 1000.0))), 6) AS bm25, round(1.0 / (60 + p_size), 6) AS rrf, CASE WHEN p_size < 10 THEN 'low' WHEN p_size < 40 THEN 'medium' ELSE 'high' END AS bucket, len(regexp_extract_all(lower(p_name), '[\\p{L}\\p{N}]+')) AS words FROM part")
def sql_functions(t):
    from pressmark.functions.sql import register

    register(t.spark)
    t.part.createOrReplaceTempView("pressmark_part")
    return t.spark.sql("SELECT p_partkey, round(bm25(3, 40, 1000, 50000, p_size), 6) AS bm25, round(rrf(p_size), 6) AS rrf, CASE WHEN p_size < 10 THEN quality_bucket(0.1) WHEN p_size < 40 THEN quality_bucket(0.4) ELSE quality_bucket(0.7) END AS bucket, cast(size(text_tokens(p_name)) as bigint) AS words FROM pressmark_part")
