"""Queries on registers, care, caches, samples and the rest of the inventory."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pressmark.functions import ingest as I
from pressmark.functions import periods as P
from pressmark.functions import text as T
from pressmark.operators import care as C
from pressmark.operators import evaluation as E
from pressmark.operators import ranking as R
from pressmark.operators import retrieval as S
from pressmark.operators.ordering import list_digests, numbered
from pressmark.plans.registry import part, query
from pressmark.plans.retrieval import TOKENS, _lexical, asking
from pressmark.tables import dealt

part("bmrank_docs", "bmrank_docs AS (SELECT doc_id AS doc, rank FROM @bmrank WHERE rank <= 50)")
SIGNALS = {"scorn": [r"\bidiot\b", r"\bscum\b"], "worth": [r"\bworthless\b"], "the": [r"\bthe the\b"]}


@query("flt8_period_case", "SELECT CASE WHEN dated = 0 OR year IS NULL THEN 'undated' WHEN year < 1960 THEN 'pre-1960' WHEN year > 2009 THEN 'post-2009' ELSE (year // 10 * 10)::VARCHAR || 's' END AS period, count(*) AS n FROM @items GROUP BY 1")
def flt8(t):
    return t.items.groupBy(P.period_of(F.col("year"), F.col("dated")).alias("period")).agg(F.count("*").alias("n"))


@query("flt13_evidence_rows", "SELECT doc_id AS passage_id, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE 1990 + doc_id % 9 END AS year, substr(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')), 1, 300) AS snippet, doc_id % 5 = 0 AS cited FROM documents")
def flt13(t):
    hits = t.documents.select(F.col("doc_id").alias("passage_id"), F.when(F.col("doc_id") % 3 != 0, F.col("doc_id") % 9 + 1990).alias("year"), "text", (F.col("doc_id") % 5 == 0).alias("cited"))
    return C.ascending_evidence(hits, T.snippet("text")).select("passage_id", "year", "snippet", "cited")


@query("flt14_sample_eligibility", "SELECT item_id, leaf FROM (SELECT item_id, leaf, row_number() OVER (PARTITION BY item_id ORDER BY sha256('el' || item_id || leaf::VARCHAR), leaf) AS r FROM (SELECT DISTINCT item_id, leaf FROM @leaves WHERE quality >= 0.5 AND tokens >= 10)) WHERE r = 1")
def flt14(t):
    rows = t.leaves.filter("quality >= 0.5 and tokens >= 10").select("item_id", "leaf").distinct().withColumn("k", F.concat("item_id", F.col("leaf").cast("string")))
    return R.capped(rows, ["item_id"], [R.hash_order("el", "k"), F.col("leaf")], 1).select("item_id", "leaf")


@query("jn2_filtered_dense", "SELECT q, vec_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id) AS r FROM @densepairs JOIN documents ON doc_id = vec_id WHERE lang = 'en') WHERE r <= 15")
def jn2(t):
    allowed = t.documents.filter("lang = 'en'").select(F.col("doc_id").alias("vec_id"))
    return S.dense_batch(t.embeddings.join(allowed, "vec_id", "left_semi"), "vec_id", "embedding", asking(t), "q", 15).select("q", "vec_id", F.round("score", 6).alias("score"))


@query("jn9_unjudged_hits", "SELECT doc, rank FROM @bmrank_docs WHERE doc NOT IN (SELECT doc_id FROM labels)")
def jn9(t):
    ranked = S.with_rank(_lexical(t, 50), "doc_id", [], "rank").select(F.col("doc_id").alias("doc"), "rank")
    return ranked.join(t.labels.select(F.col("doc_id").alias("doc")), "doc", "left_anti")



@query("jn20_ag20_shelf_manifest", """SELECT grouping(n_name, o_orderpriority)::BIGINT AS level, n_name, o_orderpriority, count(*) AS documents, count(*) FILTER (WHERE o_orderstatus = 'F') AS exported, round(sum(o_totalprice), 2) AS tokens FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1 GROUP BY GROUPING SETS ((n_name), (o_orderpriority), ())""")
def jn20(t):
    rows = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation.filter("n_regionkey = 1"), F.col("c_nationkey") == F.col("n_nationkey"))
    sets = [[F.col("n_name")], [F.col("o_orderpriority")], []]
    return rows.groupingSets(sets, "n_name", "o_orderpriority").agg(F.grouping_id().alias("level"), F.count("*").alias("documents"), F.count_if(F.col("o_orderstatus") == "F").alias("exported"), F.round(F.sum("o_totalprice"), 2).alias("tokens"))


@query("ag8_period_distribution", "SELECT period, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM @period GROUP BY period")
def ag8(t):
    from pressmark.operators.cubes import shares

    return shares(t.items.select(P.period_of(F.col("year"), F.col("dated"), 1996, 1999).alias("period")), "period")


@query("ag11_harvest_summary", "SELECT count(*) AS records, count(*) FILTER (WHERE dated = 1) AS dated, count(DISTINCT jurisdiction) AS places, count(*) FILTER (WHERE ocr_quality = 0) AS without_text FROM @items")
def ag11(t):
    return t.items.agg(F.count("*").alias("records"), F.count_if(F.col("dated") == 1).alias("dated"), F.countDistinct("jurisdiction").alias("places"), F.count_if(F.col("ocr_quality") == 0).alias("without_text"))


@query("ag12_integrity", "SELECT o_orderpriority AS format, count(*) AS expected, count(l.k) AS present, count(*) - count(l.k) AS missing, count(*) FILTER (WHERE l.q < 30) AS thin, coalesce(sum(l.q), 0) AS quantity FROM orders LEFT JOIN (SELECT l_orderkey AS k, sum(l_quantity) AS q FROM lineitem GROUP BY 1) l ON l.k = o_orderkey GROUP BY 1")
def ag12(t):
    own = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_quantity").alias("q"))
    joined = t.orders.join(own, "o_orderkey", "left")
    return joined.groupBy(F.col("o_orderpriority").alias("format")).agg(F.count("*").alias("expected"), F.count("q").alias("present"), (F.count("*") - F.count("q")).alias("missing"), F.count_if(F.col("q") < 30).alias("thin"), F.coalesce(F.sum("q"), F.lit(0.0)).alias("quantity"))


@query("ag14_spot_check", "SELECT round(100.0 * count(*) FILTER (WHERE n_chars >= 1000) / count(*), 4) AS pct_long, round(100.0 * count(*) FILTER (WHERE contains(text, chr(10))) / count(*), 4) AS pct_lines FROM documents")
def ag14(t):
    pct = lambda c: F.round(100.0 * F.count_if(c) / F.count("*"), 4)
    return t.documents.agg(pct(F.col("n_chars") >= 1000).alias("pct_long"), pct(F.col("text").contains("\n")).alias("pct_lines"))


@query("ag19_catalogue_summary", "SELECT p_brand AS value, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, value LIMIT 10")
def ag19(t):
    return R.top(t.part.groupBy(F.col("p_brand").alias("value")).agg(F.count("*").alias("n")), [F.desc("n"), F.col("value")], 10)


@query("ag22_headline_rates", "SELECT source, sum(quality)::BIGINT AS strict, count(*) FILTER (WHERE quality = 1 OR toxic = 0) AS lenient, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY source")
def ag22(t):
    return t.labels.join(t.documents, "doc_id").groupBy("source").agg(F.sum("quality").alias("strict"), F.count_if((F.col("quality") == 1) | (F.col("toxic") == 0)).alias("lenient"), F.count("*").alias("n"))


@query("ag27_leniency", "SELECT count(*) AS agreed, count(*) FILTER (WHERE l.quality = 0) AS lenient FROM @vpairs JOIN labels l ON l.doc_id = item WHERE a = b AND a = '1'")
def ag27(t):
    from pressmark.plans.evaluation import _votes

    way = E.panel(_votes(t), "a", "b").filter("way = 'agree' and final = '1'")
    return way.join(t.labels, F.col("item") == F.col("doc_id")).agg(F.count("*").alias("agreed"), F.count_if(F.col("quality") == 0).alias("lenient"))


@query("ag33_length_histogram", f"SELECT CASE WHEN n <= 64 THEN 64 WHEN n <= 128 THEN 128 WHEN n <= 256 THEN 256 WHEN n <= 512 THEN 512 ELSE 100000 END AS up_to, count(*) AS docs FROM (SELECT len(ts) AS n FROM @toks) GROUP BY 1")
def ag33(t):
    n = F.size(T.tokens("text"))
    return t.documents.groupBy(F.when(n <= 64, 64).when(n <= 128, 128).when(n <= 256, 256).when(n <= 512, 512).otherwise(100000).alias("up_to")).agg(F.count("*").alias("docs"))


@query("wn3_first_hit_per_item", "SELECT item_id, leaf FROM (SELECT item_id, leaf, row_number() OVER (PARTITION BY item_id ORDER BY quality DESC, leaf, tokens) AS r FROM @leaves) WHERE r = 1")
def wn3(t):
    return R.capped(t.leaves, ["item_id"], [F.desc("quality"), F.col("leaf"), F.col("tokens")], 1).select("item_id", "leaf")


@query("wn12_sub_windows", "SELECT doc_id, s AS start, least(s + 100, n) AS stop FROM (SELECT doc_id, n, unnest(generate_series(0, greatest(0, ceil((n - 100) / 80.0))::INT * 80, 80)) AS s FROM (SELECT doc_id, len(ts) AS n FROM @toks) WHERE n > 0)")
def wn12(t):
    n = t.documents.select("doc_id", F.size(T.tokens("text")).alias("n"))
    return n.withColumn("start", F.explode(T.windows(F.col("n"), 100, 20))).select("doc_id", F.col("start").cast("long").alias("start"), F.least(F.col("start") + 100, F.col("n")).cast("long").alias("stop"))


@query("tk3_cosine_rank", "SELECT q, vec_id, rank FROM (SELECT q, vec_id, row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id) AS rank FROM @densepairs JOIN labels ON doc_id = vec_id WHERE toxic = 1) WHERE rank <= 25")
def tk3(t):
    pool = t.embeddings.join(t.labels.filter("toxic = 1").select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi")  # the judged pool
    return S.with_rank(S.dense_batch(pool, "vec_id", "embedding", asking(t), "q", 25), "vec_id", ["q"], "rank").select("q", "vec_id", "rank")


@query("sm2_stratified_interleave", """SELECT c_custkey, row_number() OVER (ORDER BY r, c_mktsegment) AS position FROM (SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY sha256('st' || c_custkey::VARCHAR), c_custkey) AS r, count(*) OVER (PARTITION BY c_mktsegment) AS n, count(*) OVER () AS total FROM customer) WHERE r <= ceil(30.0 * n / total)""")
def sm2(t):
    w = Window.partitionBy("c_mktsegment")
    total = t.customer.agg(F.count("*").alias("total"))
    ranked = R.ranked(t.customer, ["c_mktsegment"], [R.hash_order("st", "c_custkey"), F.col("c_custkey")], "r").withColumn("n", F.count("*").over(w)).crossJoin(F.broadcast(total))
    some = ranked.filter(F.col("r") <= F.ceil(30.0 * F.col("n") / F.col("total")))
    return some.withColumn("position", F.row_number().over(Window.orderBy("r", "c_mktsegment"))).select("c_custkey", "position")  # a sample's rows


@query("sm4_one_per_item", "SELECT item_id, leaf FROM (SELECT item_id, leaf, row_number() OVER (PARTITION BY item_id ORDER BY sha256('one' || item_id || leaf::VARCHAR), leaf) AS r FROM (SELECT DISTINCT item_id, leaf FROM @leaves)) WHERE r = 1 ORDER BY sha256('one' || item_id), item_id LIMIT 40")
def sm4(t):
    rows = t.leaves.select("item_id", "leaf").distinct().withColumn("k", F.concat("item_id", F.col("leaf").cast("string")))
    one = R.capped(rows, ["item_id"], [R.hash_order("one", "k"), F.col("leaf")], 1)
    return R.top(one, [R.hash_order("one", "item_id"), F.col("item_id")], 40).select("item_id", "leaf")


@query("sm6_sub_corpus", """SELECT doc_id, min(why) AS why FROM (SELECT doc AS doc_id, 'a hit' AS why FROM @bmrank_docs UNION ALL SELECT doc_id, 'b source' FROM labels WHERE toxic = 1 UNION ALL (SELECT doc_id, 'c distractor' FROM documents WHERE doc_id NOT IN (SELECT doc FROM @bmrank_docs) AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) ORDER BY sha256('d' || doc_id::VARCHAR), doc_id LIMIT 25)) GROUP BY doc_id""")
def sm6(t):
    hits = S.with_rank(_lexical(t, 50), "doc_id", [], "rank").select("doc_id", F.lit("a hit").alias("why"))
    sources = t.labels.filter("toxic = 1").select("doc_id", F.lit("b source").alias("why"))
    both = hits.union(sources)
    others = R.top(t.documents.select("doc_id").join(both, "doc_id", "left_anti"), [R.hash_order("d", "doc_id"), F.col("doc_id")], 25).select("doc_id", F.lit("c distractor").alias("why"))
    return both.union(others).groupBy("doc_id").agg(F.min("why").alias("why"))


@query("rt14_issuer_words", "SELECT p_partkey FROM part WHERE len(list_filter(regexp_extract_all(lower(p_type), '[\\p{L}\\p{N}]+'), lambda w: w NOT IN ('small', 'plated', 'tin', 'brass', 'steel'))) = 0")
def rt14(t):
    words = T.tokens("p_type")
    known = F.array(*map(F.lit, ("small", "plated", "tin", "brass", "steel")))
    return t.part.filter((F.size(words) > 0) & (F.size(F.array_except(words, known)) == 0)).select("p_partkey")


@query("rt15_head_rerank", "SELECT doc_id, row_number() OVER (ORDER BY CASE WHEN rank <= 10 THEN 0 ELSE 1 END, CASE WHEN rank <= 10 THEN -n_chars ELSE rank END, doc_id) AS position FROM @bmrank JOIN documents USING (doc_id) WHERE rank <= 40")
def rt15(t):
    head = S.with_rank(_lexical(t, 40), "doc_id", [], "rank").join(t.documents.select("doc_id", "n_chars"), "doc_id")
    scored = F.when(F.col("rank") <= 10, -F.col("n_chars")).otherwise(F.col("rank"))  # a stub in place of a cross-encoder
    return head.withColumn("position", F.row_number().over(Window.orderBy((F.col("rank") > 10).cast("int"), scored, "doc_id"))).select("doc_id", "position")


@query("rt18_shard_eligibility", "SELECT jurisdiction, bool_or(dated = 1 AND year BETWEEN 1996 AND 1997 AND collection = 'ASIA') AS eligible FROM @items GROUP BY 1")
def rt18(t):
    fits = (F.col("dated") == 1) & F.col("year").between(1996, 1997) & (F.col("collection") == "ASIA")
    return t.items.groupBy("jurisdiction").agg(F.bool_or(F.coalesce(fits, F.lit(False))).alias("eligible"))


@query("rt24_restricted_reach", "SELECT count(DISTINCT doc_id) AS reached FROM (SELECT doc_id FROM @postings WHERE term = 'onheed') JOIN labels USING (doc_id) WHERE toxic = 1")
def rt24(t):
    held = t.labels.filter("toxic = 1").select("doc_id")
    return t.documents.filter(F.array_contains(T.tokens("text"), "onheed")).join(held, "doc_id", "left_semi").agg(F.countDistinct("doc_id").alias("reached"))


@query("rt30_highlight", None)
def rt30(t):
    return t.benchmark.select("item_id", C.highlighted(F.col("text"), F.array(F.lit("eaten"), F.lit("theas"))).alias("words"))


@query("sc6_thinness", "SELECT lang, count(*) < 40 OR bool_or(n_chars < 20) AS thin FROM documents GROUP BY lang")
def sc6(t):
    return t.documents.groupBy("lang").agg(((F.count("*") < 40) | F.bool_or(F.col("n_chars") < 20)).alias("thin"))


@query("sc7_fact_leak", "SELECT event_id, len(list_filter(list_transform(regexp_extract_all(x, '\\b(1[89]\\d\\d|20\\d\\d)\\b', 1), lambda y: y::INT), lambda y: y NOT IN (1990, 1995, 2001))) > 0 AS leaks FROM (SELECT event_id, 'In ' || (1985 + event_id % 20)::VARCHAR || ', not ' || (1990 + event_id % 2 * 5)::VARCHAR AS x FROM events)")
def sc7(t):
    x = F.concat(F.lit("In "), (F.col("event_id") % 20 + 1985).cast("string"), F.lit(", not "), (F.col("event_id") % 2 * 5 + 1990).cast("string"))
    return t.events.select("event_id", F.exists(T.years(x), lambda y: ~y.isin(1990, 1995, 2001)).alias("leaks"))


@query("sc22_anaphora", "SELECT p_partkey, regexp_full_match(trim(CASE p_partkey % 3 WHEN 0 THEN 'The Department' WHEN 1 THEN 'the author.' ELSE p_name END), '(?i)(the|le|la|l'')\\s*(department|ministry|commission|board|committee|author|institute|council|service|auteur|ministere)\\.?') AS points_back FROM part")
def sc22(t):
    s = F.when(F.col("p_partkey") % 3 == 0, "The Department").when(F.col("p_partkey") % 3 == 1, "the author.").otherwise(F.col("p_name"))
    return t.part.select("p_partkey", I.anaphoric(s).alias("points_back"))


@query("sc25_accent_folding", "SELECT doc_id, sha256(lower(strip_accents(text))) AS folded FROM documents WHERE lang IN ('fr', 'es') AND NOT contains(text, 'ß')")
def sc25(t):
    rows = t.documents.filter("lang in ('fr', 'es')").filter(~F.col("text").contains("ß"))
    return rows.select("doc_id", F.sha2(F.lower(C.without_accents(F.col("text"))), 256).alias("folded"))


@query("sc29_year_check", "SELECT l_orderkey, year(l_shipdate)::INT AS year, bool_or(year(o_orderdate) = year(l_shipdate)) AS on_page FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2")
def sc29(t):
    lines, orders = dealt((t.lineitem, "l_orderkey"), (t.orders, "o_orderkey"))
    rows = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.groupBy("l_orderkey", F.year("l_shipdate").alias("year")).agg(F.bool_or(F.year("o_orderdate") == F.year("l_shipdate")).alias("on_page"))


@query("sc34_near_words")
def sc34(t):
    from pressmark.operators.matching import near_words

    words = lambda rows: rows.select(F.explode(T.tokens("text")).alias("w")).distinct()
    return near_words(words(t.benchmark).filter(F.char_length("w") >= 4), words(t.benchmark))


@query("sc37_care_topics", "SELECT doc_id, list_filter([" + ", ".join(f"CASE WHEN regexp_matches(strip_accents(coalesce(text, '')), '(?i){'|'.join(p)}') THEN '{k}' END" for k, p in SIGNALS.items()) + "], lambda x: x IS NOT NULL) AS topics FROM documents")
def sc37(t):
    return t.documents.select("doc_id", C.topics(F.col("text"), SIGNALS).alias("topics"))


@query("sc38_care_detection", None)
def sc38(t):
    rows = t.documents.select("text", (F.col("doc_id") % 2 == 0).alias("cited"))
    return C.detected(rows, "text", "cited", SIGNALS, ("worth",), F.lit("an idiot asks"), {"scorn": (r"\bthe\b", "scorn-upgraded")}, {"scorn": ("the",)})


@query("sc39_crisis_resources", "SELECT resource, pos, ord FROM (SELECT resource, pos, ord, row_number() OVER (PARTITION BY resource ORDER BY pos, ord) AS r FROM (VALUES (0, 'b'), (1, 'a')) t(pos, topic) JOIN (VALUES ('a', 0, 'line'), ('a', 1, 'page'), ('b', 0, 'page'), ('b', 1, 'talk')) m(topic, ord, resource) USING (topic)) WHERE r = 1")
def sc39(t):
    asked = t.spark.createDataFrame([(0, "b"), (1, "a")], "pos int, topic string")
    mapping = t.spark.createDataFrame([("a", 0, "line"), ("a", 1, "page"), ("b", 0, "page"), ("b", 1, "talk")], "topic string, ord int, resource string")
    return C.resources(asked, mapping)


@query("sc40_term_flags", "SELECT doc_id FROM documents WHERE regexp_matches(lower(strip_accents(coalesce(text, ''))), '(^|[^\\p{L}\\p{N}_])of[\\s-]+the($|[^\\p{L}\\p{N}_])')")
def sc40(t):
    return t.documents.filter(F.size(C.term_flags(F.col("text"), ["of the"])) > 0).select("doc_id")


@query("sc44_content_key", "SELECT o_orderkey, sha256('{\"o_custkey\":' || o_custkey::VARCHAR || ',\"o_orderstatus\":\"' || o_orderstatus || '\"}') AS k FROM orders")
def sc44(t):
    return t.orders.select("o_orderkey", I.content_key("o_custkey", "o_orderstatus").alias("k"))


@query("sc55_coverage_state", "SELECT p_partkey, CASE WHEN 1960 + p_size // 10 * 10 > 1989 OR p_brand NOT IN ('Brand#1', 'Brand#2', 'Brand#3') THEN 'not_indexed' ELSE 'absent_from_examined_holdings' END AS state FROM part")
def sc55(t):
    period = F.concat((F.floor(F.col("p_size") / 10) * 10 + 1960).cast("string"), F.lit("s"))
    return t.part.select("p_partkey", C.coverage_state(period, F.col("p_brand"), 1960, 1989, ["Brand#1", "Brand#2", "Brand#3"]).alias("state"))


@query("sc57_withhold_restore", "SELECT p_partkey, [0, 2] AS places, [p_brand, p_type] AS restored FROM part WHERE p_brand <> p_name AND p_type <> p_brand AND p_name <> p_type")
def sc57(t):
    salient = F.array("p_brand", "p_name", "p_type")
    kept = C.withheld(salient, F.array(F.col("p_brand"), F.lit("unknown"), F.col("p_type")))
    rows = t.part.filter("p_brand <> p_name and p_type <> p_brand and p_name <> p_type")
    return rows.select("p_partkey", kept["places"].alias("places"), C.restored(kept, salient).alias("restored"))


@query("sc58_keep_warm", "SELECT event_id, (dayofweek(ts) IN (1, 2, 3) AND hour(ts) * 60 + minute(ts) BETWEEN 540 AND 1019) OR (dayofweek(ts) = 6 AND hour(ts) * 60 + minute(ts) BETWEEN 0 AND 59) AS warm FROM events")
def sc58(t):
    return t.events.select("event_id", C.warm(F.col("ts"), [((1, 2, 3), 540, 1020), ((6,), 0, 60)]).alias("warm"))


@query("ev10_source_recall", """SELECT count(DISTINCT b.item_id) AS questions, count(DISTINCT b.item_id) FILTER (WHERE d.doc_id IS NOT NULL) AS found FROM benchmark b LEFT JOIN documents d ON contains(d.text, b.text)""")
def ev10(t):
    from pressmark.operators.matching import containing

    hits = containing(t.benchmark.select("item_id", "text"), t.documents.select("doc_id", F.col("text").alias("body")), "item_id", "text", "doc_id", "body")
    return t.benchmark.join(hits.select("item_id", F.lit(1).alias("hit")).distinct(), "item_id", "left").agg(F.countDistinct("item_id").alias("questions"), F.countDistinct(F.when(F.col("hit") == 1, F.col("item_id"))).alias("found"))


@query("ev20_audit_status", "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'AGREEMENT-WITH-REFERENCE-ONLY' WHEN quality = 1 AND doc_id % 3 = 0 THEN 'AI-AUDITED' ELSE 'NOT-AI-AUDITED' END AS status FROM labels")
def ev20(t):
    return t.labels.select("doc_id", C.audit_status(F.col("quality") == 1, F.col("doc_id") % 5 != 0, F.col("doc_id") % 3 == 0).alias("status"))


@query("ev22_candidate_proposal", """SELECT doc_id, CASE WHEN lang IS NULL OR lang = 'en' THEN (a AND b)::INT ELSE 0 END AS relevance, CASE WHEN lang <> 'en' THEN 'other place' WHEN a AND b THEN 'mentions onheed, the' ELSE 'not clear' END AS why
 FROM (SELECT doc_id, lang, contains(lower(coalesce(text, '')), 'the') AS a, contains(lower(coalesce(text, '')), 'onheed') AS b FROM documents)""")
def ev22(t):
    p = C.proposed(F.lit(0.9), F.col("text"), F.array(F.lit("the"), F.lit("onheed")), F.lit("en"), F.col("lang"))
    return t.documents.select("doc_id", p["relevance"].alias("relevance"), p["why"].alias("why"))


@query("mx2_demultiplex_counts", "SELECT 'item' AS kind, count(*) AS n FROM orders UNION ALL SELECT 'leaf', count(*) FROM lineitem")
def mx2(t):
    tagged = t.orders.select(F.lit("item").alias("kind")).union(t.lineitem.select(F.lit("leaf").alias("kind")))
    return tagged.groupBy("kind").agg(F.count("*").alias("n"))


@query("mx5_build_order", "SELECT c_custkey, row_number() OVER (ORDER BY n DESC, c_acctbal DESC, c_custkey) AS place FROM customer JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'")
def mx5(t):
    n = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    rows = t.customer.filter("c_mktsegment = 'BUILDING'").join(n, "c_custkey")
    return numbered(rows.select("c_custkey", "n", "c_acctbal"), [F.desc("n"), F.desc("c_acctbal"), "c_custkey"]).select("c_custkey", (F.col("place") + 1).alias("place"))


@query("mx8_split_by_contract", "SELECT c_acctbal >= 0 AS kept, count(*) AS n FROM customer GROUP BY 1")
def mx8(t):
    from pressmark.operators.packing import problems

    broken = problems({"negative": F.col("c_acctbal") < 0})
    return t.customer.groupBy((F.size(broken) == 0).alias("kept")).agg(F.count("*").alias("n"))


@query("mx13_plan_summary", "SELECT jurisdiction, count(*) AS documents, round(sum(amount) / 1e6, 4) AS size, sha256(string_agg(item_id, ',' ORDER BY item_id)) AS members FROM @items GROUP BY 1")
def mx13(t):
    items = t.items.select("jurisdiction", "item_id", "amount")
    sizes = items.groupBy("jurisdiction").agg(F.count("*").alias("documents"), F.round(F.sum("amount") / 1e6, 4).alias("size"))
    return sizes.join(list_digests(items, "jurisdiction", "item_id"), "jurisdiction").select("jurisdiction", "documents", "size", F.col("digest").alias("members"))


@query("mx18_bucket_parse", "SELECT p_partkey, string_split(e, ':')[1] AS shard, string_split(e, ':')[2]::BIGINT AS df FROM (SELECT p_partkey, unnest(string_split('s1:' || p_size::VARCHAR || ' s2:' || p_partkey::VARCHAR, ' ')) AS e FROM part)")
def mx18(t):
    line = F.concat(F.lit("s1:"), F.col("p_size").cast("string"), F.lit(" s2:"), F.col("p_partkey").cast("string"))
    return t.part.select("p_partkey", F.explode(F.str_to_map(line, F.lit(" "), F.lit(":"))).alias("shard", "df")).select("p_partkey", "shard", F.col("df").cast("long").alias("df"))


@query("mx20_coverage_window", "SELECT jurisdiction, greatest(min(year), 1996) AS first, least(max(year), 1999) AS last FROM @items GROUP BY 1")
def mx20(t):
    return t.items.groupBy("jurisdiction").agg(F.greatest(F.min("year"), F.lit(1996)).alias("first"), F.least(F.max("year"), F.lit(1999)).alias("last"))


@query("mx26_spread_candidates", "SELECT item_id FROM (SELECT item_id, year // 10 AS d, jurisdiction, row_number() OVER (PARTITION BY year // 10, jurisdiction ORDER BY ocr_quality DESC, item_id) AS r FROM @items WHERE dated = 1) ORDER BY r, d, jurisdiction LIMIT 40")
def mx26(t):
    rows = t.items.filter("dated = 1").withColumn("d", F.floor(F.col("year") / 10))
    return R.top(R.ranked(rows, ["d", "jurisdiction"], [F.desc("ocr_quality"), F.col("item_id")], "r"), [F.col("r"), F.col("d"), F.col("jurisdiction")], 40).select("item_id")


@query("mx28_step_years", "SELECT DISTINCT year FROM @items WHERE dated = 1 AND ocr_quality > 0.95")
def mx28(t):
    return t.items.filter("dated = 1 and ocr_quality > 0.95").select("year").distinct()


@query("mx32_label_classes", "SELECT doc_id, CASE quality * 10 + toxic WHEN 10 THEN 'supported' WHEN 11 THEN 'partial' WHEN 0 THEN 'off_target' ELSE 'unsupported' END AS class FROM labels")
def mx32(t):
    names = F.create_map(*[x for k, v in ((10, "supported"), (11, "partial"), (0, "off_target"), (1, "unsupported")) for x in (F.lit(k), F.lit(v))])
    return t.labels.select("doc_id", F.element_at(names, F.col("quality") * 10 + F.col("toxic")).alias("class"))


@query("mx33_even_quota", "SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY sha256('qa' || o_orderkey::VARCHAR), o_orderkey) AS r FROM orders) WHERE r <= 6")
def mx33(t):
    return R.sampled(t.orders, ["o_orderpriority"], "o_orderkey", "qa", 6).select("o_orderkey")


@query("mx38_numerators", "SELECT o_custkey AS q, count(*) FILTER (WHERE o_orderstatus = 'F') AS num, count(*) AS den FROM orders GROUP BY 1")
def mx38(t):
    return t.orders.groupBy(F.col("o_custkey").alias("q")).agg(F.count_if(F.col("o_orderstatus") == "F").alias("num"), F.count("*").alias("den"))


@query("mx42_cost_scenarios", "SELECT questions, least(24.0, questions * 0.2) AS awake, round(least(24.0, questions * 0.2) * 0.05 * 30 + questions * 30 * 0.002, 4) AS monthly FROM (VALUES (10), (100), (1000)) v(questions)")
def mx42(t):
    rows = t.spark.createDataFrame([(10,), (100,), (1000,)], "questions int")
    awake = F.least(F.lit(24.0), F.col("questions") * 0.2)
    return rows.select("questions", awake.alias("awake"), F.round(awake * 0.05 * 30 + F.col("questions") * 30 * 0.002, 4).alias("monthly"))


@query("mx44_capacity", "SELECT c_custkey, least(floor(c_acctbal / 10), 900, c_custkey * 3)::BIGINT AS capacity FROM customer WHERE c_acctbal > 0")
def mx44(t):
    return t.customer.filter("c_acctbal > 0").select("c_custkey", F.least(F.floor(F.col("c_acctbal") / 10), F.lit(900), F.col("c_custkey") * 3).cast("long").alias("capacity"))


@query("mx48_text_measures", "SELECT doc_id, len(string_split(coalesce(text, ''), chr(10))) AS pages, len(regexp_extract_all(coalesce(text, ''), '\\S+')) AS words, strlen(coalesce(text, '')) AS bytes FROM documents")
def mx48(t):
    text = F.coalesce("text", F.lit(""))
    return t.documents.select("doc_id", F.size(F.split(text, "\n", -1)).alias("pages"), F.regexp_count(text, F.lit(r"\S+")).alias("words"), F.octet_length(text).alias("bytes"))


@query("mx50_budget_caps", "SELECT d AS day, used, used + 5 <= 60 AS fits FROM (SELECT ts::DATE AS d, count(*) FILTER (WHERE event_type = 'purchase') AS used FROM events GROUP BY 1)")
def mx50(t):
    per = t.events.groupBy(F.to_date("ts").alias("day")).agg(F.count_if(F.col("event_type") == "purchase").alias("used"))
    return per.withColumn("fits", F.col("used") + 5 <= 60)


@query("mx56_verdict_validation", "SELECT event_id, CASE WHEN (event_id % 4) = 0 THEN NULL WHEN (event_id % 4) IN (1, 2) THEN (ARRAY['pass', 'fail'])[event_id % 4] END AS verdict FROM events")
def mx56(t):
    k = F.col("event_id") % 4
    said = F.when(k == 1, '{"verdict": "pass"}').when(k == 2, '{"verdict": "fail"}').when(k == 3, '{"verdict": "maybe"}').otherwise("not json")
    v = F.from_json(said, "verdict string")["verdict"]
    return t.events.select("event_id", F.when(v.isin("pass", "fail"), v).alias("verdict"))


@query("mx68_page_count", "SELECT p_partkey, 2 AS pages FROM part")
def mx68(t):
    return t.part.select("p_partkey", F.size(I.pages(F.concat("p_name", F.lit("\f"), "p_type"))).alias("pages"))


@query("mx70_page_rows", "SELECT l_orderkey || '#' || (l_linenumber - 1) AS page_id, l_linenumber - 1 AS leaf, CASE WHEN l_linenumber % 2 = 0 THEN l_linenumber::VARCHAR END AS printed FROM lineitem")
def mx70(t):
    leaf = F.col("l_linenumber") - 1
    return t.lineitem.select(F.concat(F.col("l_orderkey").cast("string"), F.lit("#"), leaf.cast("string")).alias("page_id"), leaf.alias("leaf"), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_linenumber").cast("string")).alias("printed"))


@query("mx82_silver_pivot", "SELECT item, max(vote) FILTER (WHERE judge = 'a') AS a, max(vote) FILTER (WHERE judge = 'b') AS b, max(vote) FILTER (WHERE judge = 'c') AS c FROM @votes GROUP BY item")
def mx82(t):
    from pressmark.plans.evaluation import _votes

    return _votes(t).groupBy("item").pivot("judge", ["a", "b", "c"]).agg(F.first("vote"))


@query("mx85_mean_cost", "SELECT o_orderpriority, round(sum(coalesce(nullif(o_totalprice, 0), 0)) / count(*), 4) AS cost FROM orders GROUP BY 1")
def mx85(t):
    return t.orders.groupBy("o_orderpriority").agg(F.round(F.sum(F.coalesce("o_totalprice", F.lit(0.0))) / F.count("*"), 4).alias("cost"))


@query("mx86_judge_pairs", "SELECT x.judge AS a, y.judge AS b, count(*) AS n, count(*) FILTER (WHERE x.vote = y.vote) AS same FROM @votes x JOIN @votes y ON x.item = y.item AND x.judge < y.judge GROUP BY 1, 2")
def mx86(t):
    from pressmark.plans.evaluation import _votes

    v = _votes(t)
    x, y = v.select("item", F.col("judge").alias("a"), F.col("vote").alias("va")), v.select("item", F.col("judge").alias("b"), F.col("vote").alias("vb"))
    return x.join(y, "item").filter("a < b").groupBy("a", "b").agg(F.count("*").alias("n"), F.count_if(F.col("va") == F.col("vb")).alias("same"))


@query("mx88_false_number_gate", "SELECT event_id, len(list_intersect(list_filter([a, b], lambda x: x NOT IN (c, d)), [c, e])) = 0 AS passes FROM (SELECT event_id, event_id % 7 AS a, event_id % 5 AS b, event_id % 3 AS c, event_id % 11 AS d, event_id % 13 AS e FROM events)")
def mx88(t):
    m = lambda k: (F.col("event_id") % k)
    claimed = F.array_except(F.array(m(7), m(5)), F.array(m(3), m(11)))
    return t.events.select("event_id", (F.size(F.array_intersect(claimed, F.array(m(3), m(13)))) == 0).alias("passes"))


@query("mx89_conflict_gate", "SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING max(l_partkey) <> min(l_partkey) AND max(l_quantity) - min(l_quantity) > 10")
def mx89(t):
    return t.lineitem.groupBy("l_orderkey").agg(F.max("l_partkey").alias("a"), F.min("l_partkey").alias("b"), (F.max("l_quantity") - F.min("l_quantity")).alias("d")).filter("a <> b and d > 10").select("l_orderkey")


@query("mx92_assist_terms", f"SELECT item_id, list_sort(list_distinct(list_filter({TOKENS.format('text')}, lambda w: length(w) >= 4 AND NOT regexp_matches(w, '[0-9]') AND w NOT IN ('onheed', 'with')))) AS terms FROM benchmark")
def mx92(t):
    return t.benchmark.select("item_id", F.array_sort(T.assist_terms("text", ["onheed", "with"])).alias("terms"))


@query("mx98_notes", "SELECT o_orderkey, o_orderdate FROM orders JOIN (VALUES (5), (7), (11)) v(k) ON k = o_custkey WHERE o_orderstatus = 'F'")
def mx98(t):
    asked = t.spark.createDataFrame([(5,), (7,), (11,)], "o_custkey long")
    return t.orders.filter("o_orderstatus = 'F'").join(F.broadcast(asked), "o_custkey").orderBy("o_orderdate").select("o_orderkey", "o_orderdate")


@query("mx100_cache_record", "SELECT event_id, CASE WHEN event_type = 'signup' THEN props END AS question, CASE WHEN event_type <> 'signup' THEN ts + INTERVAL 90 DAY END AS expires_at FROM events")
def mx100(t):
    curated = F.col("event_type") == "signup"
    return t.events.select("event_id", F.when(curated, F.col("props")).alias("question"), F.when(~curated, F.col("ts") + F.expr("interval 90 days")).alias("expires_at"))


@query("mx103_export_list", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def mx103(t):
    held = t.customer.filter("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return t.orders.filter("o_orderstatus = 'F'").join(held, "o_custkey", "left_anti").orderBy("o_orderkey").select("o_orderkey")


@query("mx109_citation", "SELECT l_orderkey, l_linenumber, o_orderstatus FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus IS NOT NULL")
def mx109(t):
    rows = t.lineitem.join(t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus"), "l_orderkey", "left")
    return rows.filter("o_orderstatus is not null").select("l_orderkey", "l_linenumber", "o_orderstatus")


@query("mx110_plan_totals", "SELECT count(*) AS shards, sum(n)::BIGINT AS documents, max(n) AS largest FROM (SELECT jurisdiction, count(*) AS n FROM @items GROUP BY 1)")
def mx110(t):
    per = t.items.groupBy("jurisdiction").agg(F.count("*").alias("n"))
    return per.agg(F.count("*").alias("shards"), F.sum("n").alias("documents"), F.max("n").alias("largest"))


@query("mx111_probe_outcomes", "SELECT role, CASE WHEN length(coalesce(text, '')) = 0 THEN 'empty' WHEN contains(text, '?') THEN 'asks' ELSE 'states' END AS outcome, count(*) AS n FROM conversations GROUP BY 1, 2")
def mx111(t):
    text = F.coalesce("text", F.lit(""))
    outcome = F.when(text == "", "empty").when(text.contains("?"), "asks").otherwise("states")
    return t.conversations.groupBy("role", outcome.alias("outcome")).agg(F.count("*").alias("n"))
