"""Queries on joins, windows, samples, sets and upserts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pressmark.functions import periods as P
from pressmark.functions import text as T
from pressmark.operators import automaton
from pressmark.operators import matching as M
from pressmark.operators import ranking as R
from pressmark.operators import upserts as U
from pressmark.plans.registry import part, query, scratch
from pressmark.sources.snapshots import Snapshots

part("hits", "hits AS (SELECT p_brand AS phrase, 'i' || p_partkey::VARCHAR AS item_id, p_type AS issuer, 1960 + p_size AS year FROM part)")
part("pagenums", """pagenums AS (SELECT 'o' || o_orderkey::VARCHAR AS page_id, 'c' || o_custkey::VARCHAR AS item_id, o_orderpriority AS jurisdiction, year(o_orderdate)::INT AS year,
 list_distinct([(o_orderkey * 7 % 97)::VARCHAR, (o_orderkey * 11 % 89)::VARCHAR, (o_orderkey * 13 % 83)::VARCHAR, (o_orderkey * 17 % 79)::VARCHAR]) AS numbers FROM orders)""")


def _hits(t):
    return t.part.select(F.col("p_brand").alias("phrase"), F.concat(F.lit("i"), F.col("p_partkey").cast("string")).alias("item_id"), F.col("p_type").alias("issuer"), (F.col("p_size") + 1960).alias("year"))


@query("jn1_postings_items", "SELECT item_id, leaf, jurisdiction FROM @leaves JOIN @items USING (item_id) WHERE quality >= 0.9 AND year = 1998 ORDER BY item_id, leaf LIMIT 50")
def jn1(t):
    return R.top(t.leaves.filter("quality >= 0.9").join(t.items.filter("year = 1998"), "item_id").select("item_id", "leaf", "jurisdiction"), [F.col("item_id"), F.col("leaf")], 50)


@query("jn3_provenance", "SELECT l_orderkey, l_linenumber, o_orderpriority FROM lineitem JOIN orders ON o_orderkey = l_orderkey")
def jn3(t):
    parents = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority")
    return M.resolved(t.lineitem.select("l_orderkey", "l_linenumber"), parents, "l_orderkey", "o_orderpriority")


@query("jn4_lookup_in_order", "SELECT pos, p_partkey, p_name FROM (VALUES (0, 17), (1, 3), (2, 99), (3, -1)) v(pos, p_partkey) JOIN part USING (p_partkey)")
def jn4(t):
    ids = t.spark.createDataFrame([(0, 17), (1, 3), (2, 99), (3, -1)], "pos int, p_partkey long")
    return M.by_position(ids, t.part.select("p_partkey", "p_name"), "p_partkey", "pos").select("pos", "p_partkey", "p_name")


@query("jn5_class_counts", "SELECT coalesce(c_mktsegment, 'none') AS segment, count(*) AS n FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 5000) ON c_custkey = o_custkey GROUP BY 1")
def jn5(t):
    some = t.customer.filter("c_acctbal > 5000")
    return t.orders.join(some, F.col("o_custkey") == F.col("c_custkey"), "left").groupBy(F.coalesce("c_mktsegment", F.lit("none")).alias("segment")).agg(F.count("*").alias("n"))


@query("jn6_semi_restriction", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def jn6(t):
    return t.orders.join(t.customer.filter("c_mktsegment = 'BUILDING'"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey")


@query("jn8_resume_anti", "SELECT count(*) AS n FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 1)")
def jn8(t):
    done = t.lineitem.filter("l_linenumber = 1").select(F.col("l_orderkey").alias("o_orderkey"))
    return t.orders.join(done, "o_orderkey", "left_anti").agg(F.count("*").alias("n"))


@query("jn10_orphans", "SELECT c_custkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey WHERE o_custkey IS NULL")
def jn10(t):
    return M.orphans(t.customer.select("c_custkey"), t.orders.select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("jn11_as_of_both_ways", """WITH pts AS (SELECT user_id AS key, event_id, ts FROM events WHERE event_type = 'purchase'), hist AS (SELECT key, ts, digest || status::VARCHAR AS state FROM @captures WHERE digest <> 'purchase')
 SELECT p.event_id, b.state AS before, a.state AS after, coalesce(a.state = b.state, false) AS in_effect FROM pts p
 ASOF LEFT JOIN hist b ON b.key = p.key AND b.ts <= p.ts ASOF LEFT JOIN hist a ON a.key = p.key AND a.ts >= p.ts""")
def jn11(t):
    points = t.captures.filter("digest = 'purchase'").select("key", "event_id", F.col("ts").alias("at"))
    history = t.captures.filter("digest <> 'purchase'").select("key", F.col("ts").alias("when"), F.concat("digest", F.col("status").cast("string")).alias("s"))
    return M.as_of(points, history, "key", "at", "when", F.col("s")).select("event_id", "before", "after", "in_effect")


@query("jn12_phrase_pairs", """SELECT 'change' AS kind, a.phrase, a.item_id AS item_id_a, b.item_id AS item_id_b, a.year AS year_a, b.year AS year_b FROM @hits a JOIN @hits b ON a.phrase = b.phrase AND a.item_id < b.item_id AND a.issuer = b.issuer AND abs(a.year - b.year) >= 20
 UNION ALL SELECT 'compare', a.phrase, a.item_id, b.item_id, a.year, b.year FROM @hits a JOIN @hits b ON a.phrase = b.phrase AND a.item_id < b.item_id AND a.issuer <> b.issuer AND abs(a.year - b.year) <= 2""")
def jn12(t):
    return M.phrase_pairs(_hits(t), 20, 2)


@query("jn13_partner_page", """SELECT page_id, page_id_b, shared FROM (SELECT a.page_id, b.page_id AS page_id_b, len(list_intersect(a.numbers, b.numbers)) AS shared, row_number() OVER (PARTITION BY a.page_id ORDER BY len(list_intersect(a.numbers, b.numbers)) DESC, b.page_id) AS r
 FROM @pagenums a JOIN @pagenums b ON a.jurisdiction = b.jurisdiction AND a.item_id <> b.item_id AND abs(a.year - b.year) <= 3 WHERE len(list_intersect(a.numbers, b.numbers)) >= 2) WHERE r = 1""")
def jn13(t):
    k = F.col("o_orderkey")
    nums = F.array_distinct(F.array(*[(k * a % b).cast("string") for a, b in ((7, 97), (11, 89), (13, 83), (17, 79))]))
    pages = t.orders.select(
        F.concat(F.lit("o"), k.cast("string")).alias("page_id"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("item_id"), F.col("o_orderpriority").alias("jurisdiction"), F.year("o_orderdate").alias("year"), nums.alias("numbers")
    )
    return M.partners(pages, 3, 2)


RULES = [("anodized", "metal"), ("brass", "metal"), ("tin", "metal"), ("small", "size"), ("large", "size"), ("promo", "sale")]


@query("jn14_first_rule", "SELECT p_partkey, CASE " + " ".join(f"WHEN contains(lower(p_type), '{p}') THEN '{v}'" for p, v in RULES) + " END AS value FROM part")
def jn14(t):
    return t.part.select("p_partkey", M.first_rule(F.col("p_type"), RULES).alias("value"))


@query("jn15_longest_alias", "SELECT c_custkey, CASE WHEN contains(lower(c_mktsegment), 'furniture') THEN 'FURNITURE dept' WHEN contains(lower(c_mktsegment), 'furn') THEN 'furn' WHEN contains(lower(c_mktsegment), 'in') THEN 'in' END AS value FROM customer")
def jn15(t):
    aliases = M.longest_first([("in", "in"), ("furn", "furn"), ("furniture", "FURNITURE dept")])
    return t.customer.select("c_custkey", M.first_rule(F.col("c_mktsegment"), aliases).alias("value"))


@query("jn16_agreeing_rules", "SELECT p_partkey, CASE WHEN len(v) = 1 THEN v[1] END AS value FROM (SELECT p_partkey, list_distinct(list_filter([" + ", ".join(f"CASE WHEN contains(lower(p_type), '{p}') THEN '{v}' END" for p, v in RULES) + "], lambda x: x IS NOT NULL)) AS v FROM part)")
def jn16(t):
    return t.part.select("p_partkey", M.only_value(F.col("p_type"), RULES).alias("value"))


#: Every two words of the benchmark's items that follow each other as a rule for the first item that has them; the longest first.
part("pairrules", """pairrules AS (SELECT pattern, 'item-' || min(item_id)::VARCHAR AS value, row_number() OVER (ORDER BY length(pattern) DESC, pattern) AS n FROM (SELECT item_id, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) AS pattern
 FROM (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+') AS ws FROM benchmark)) GROUP BY pattern)""")
part("pairhits", "pairhits AS (SELECT doc_id, arg_min(value, n) AS value, arg_min(pattern, n) AS pattern, count(*) AS hits, count(DISTINCT value) AS vs FROM documents JOIN @pairrules ON contains(lower(coalesce(text, '')), pattern) GROUP BY doc_id)")


def _pair_rules(t):
    ws = T.tokens("text")
    pairs = F.transform(F.slice(ws, 1, F.greatest(F.size(ws) - 1, F.lit(0))), lambda w, i: F.concat(w, F.lit(" "), F.get(ws, i + 1)))
    rules = t.benchmark.select("item_id", F.explode(pairs).alias("pattern")).groupBy("pattern").agg(F.min("item_id").alias("i"))
    return [(r["pattern"], f"item-{r['i']}") for r in rules.orderBy(F.desc(F.char_length("pattern")), "pattern").collect()]  # a rule table


@query("jn14_rule_automaton", "SELECT doc_id, value, pattern FROM documents LEFT JOIN @pairhits USING (doc_id)")
def jn14_automaton(t):
    return t.documents.select("doc_id", automaton.first(F.col("text"), _pair_rules(t)).alias("r")).select("doc_id", "r.value", "r.pattern")


@query("jn16_rule_automaton", "SELECT doc_id, CASE WHEN vs = 1 THEN value END AS value, CASE WHEN vs > 1 THEN 'ambiguous' ELSE pattern END AS pattern FROM documents LEFT JOIN @pairhits USING (doc_id)")
def jn16_automaton(t):
    return t.documents.select("doc_id", automaton.agreeing(F.col("text"), _pair_rules(t)).alias("r")).select("doc_id", "r.value", "r.pattern")


@query("sc40_term_automaton", """SELECT doc_id, list(pattern ORDER BY n) AS terms FROM (SELECT doc_id, ' ' || regexp_replace(regexp_replace(lower(strip_accents(coalesce(text, ''))), '[\\s-]+', ' ', 'g'), '([^\\p{L}\\p{N}_ ])', ' \\1 ', 'g') || ' ' AS x FROM documents)
 JOIN @pairrules ON contains(x, ' ' || strip_accents(pattern) || ' ') GROUP BY doc_id""")
def sc40_automaton(t):
    return t.documents.select("doc_id", automaton.terms(F.col("text"), [p for p, _ in _pair_rules(t)]).alias("terms")).filter(F.size("terms") > 0)


@query("jn17_bridge", "SELECT p_partkey, w AS collection FROM (SELECT p_partkey, unnest(list_distinct(regexp_extract_all(lower(p_type), '[\\p{L}\\p{N}]+'))) AS w FROM part) WHERE w IN ('small', 'large', 'promo')")
def jn17(t):
    wanted = t.spark.createDataFrame([("small",), ("large",), ("promo",)], "collection string")
    return t.part.select("p_partkey", F.explode(F.array_distinct(T.tokens("p_type"))).alias("collection")).join(F.broadcast(wanted), "collection")


@query("jn18_multi_map", """SELECT c_custkey, coalesce(o.n, 0) AS orders, o.last AS last_order, list_sort(coalesce(k.statuses, [])) AS statuses FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, max(o_orderdate) AS last FROM orders GROUP BY 1) o ON o.o_custkey = c_custkey
 LEFT JOIN (SELECT o_custkey, list(DISTINCT o_orderstatus) AS statuses FROM orders GROUP BY 1) k ON k.o_custkey = c_custkey""")
def jn18(t):
    o = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.max("o_orderdate").alias("last_order"), F.collect_set("o_orderstatus").alias("s"))
    return t.customer.select("c_custkey").join(o, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("orders"), "last_order", F.sort_array(F.coalesce("s", F.array().cast("array<string>"))).alias("statuses"))


@query("jn19_grid", """SELECT jurisdiction, decade, coalesce(c.n, 0) AS catalogue, coalesce(i.n, 0) AS indexed FROM (SELECT DISTINCT n_name AS jurisdiction FROM nation) CROSS JOIN (VALUES ('1990s'), ('2000s'), ('2010s')) d(decade)
 LEFT JOIN (SELECT jurisdiction, (year // 10 * 10)::VARCHAR || 's' AS decade, count(*) AS n FROM @items WHERE dated = 1 GROUP BY 1, 2) c USING (jurisdiction, decade)
 LEFT JOIN (SELECT jurisdiction, (year // 10 * 10)::VARCHAR || 's' AS decade, count(*) AS n FROM @items WHERE dated = 1 AND ocr_quality > 0.5 GROUP BY 1, 2) i USING (jurisdiction, decade)""")
def jn19(t):
    dated = t.items.filter("dated = 1").withColumn("decade", P.decade(F.col("year")))
    count = lambda d, name: d.groupBy("jurisdiction", "decade").agg(F.count("*").alias(name))
    decades = t.spark.createDataFrame([("1990s",), ("2000s",), ("2010s",)], "decade string")
    return M.grid(t.nation.select(F.col("n_name").alias("jurisdiction")), decades, (count(dated, "catalogue"), "catalogue"), (count(dated.filter("ocr_quality > 0.5"), "indexed"), "indexed"))


@query("jn21_paired_runs", "SELECT a.l_orderkey, a.q AS q_a, b.q AS q_b FROM (SELECT l_orderkey, sum(l_quantity) AS q FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) a JOIN (SELECT l_orderkey, sum(l_quantity) AS q FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1) b USING (l_orderkey)")
def jn21(t):
    run = lambda flag, name: t.lineitem.filter(F.col("l_returnflag") == flag).groupBy("l_orderkey").agg(F.sum("l_quantity").alias(name))
    return run("R", "q_a").join(run("A", "q_b"), "l_orderkey")


@query("jn22_correlated_counts", "SELECT o_orderkey, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS leaves, (SELECT coalesce(sum(l_quantity), 0) FROM lineitem WHERE l_orderkey = o_orderkey) AS quantity FROM orders")
def jn22(t):
    own = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"), F.sum("l_quantity").alias("q"))
    return t.orders.select("o_orderkey").join(own, "o_orderkey", "left").select("o_orderkey", F.coalesce("n", F.lit(0)).alias("leaves"), F.coalesce("q", F.lit(0.0)).alias("quantity"))


@query("jn23_preferred_kind", "SELECT user_id, coalesce(max(value) FILTER (WHERE event_type = 'purchase'), max(value) FILTER (WHERE event_type = 'signup')) AS value FROM events GROUP BY user_id")
def jn23(t):
    best = lambda kind: F.max(F.when(F.col("event_type") == kind, F.col("value")))
    return t.events.groupBy("user_id").agg(F.coalesce(best("purchase"), best("signup")).alias("value"))


@query("jn24_interval_membership", "SELECT o_orderkey FROM orders WHERE year(o_orderdate) BETWEEN 1995 AND 1996 OR year(o_orderdate) BETWEEN 2000 AND 2001")
def jn24(t):
    ranges = F.array(*[F.struct(F.lit(a).alias("lo"), F.lit(b).alias("hi")) for a, b in ((1995, 1996), (2000, 2001))])
    return t.orders.filter(F.exists(ranges, lambda r: F.year("o_orderdate").between(r["lo"], r["hi"]))).select("o_orderkey")


# -- windows


@query("wn1_per_item_cap", "SELECT l_orderkey, l_linenumber, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber, l_partkey) AS r FROM lineitem) WHERE r <= 2")
def wn1(t):
    return R.capped(t.lineitem, ["l_orderkey"], [F.desc("l_quantity"), F.col("l_linenumber"), F.col("l_partkey")], 2).select("l_orderkey", "l_linenumber", "l_quantity")


@query("wn2_rank_in_arm", "SELECT jurisdiction, item_id, row_number() OVER (PARTITION BY jurisdiction ORDER BY amount DESC, item_id) AS rank FROM @items")
def wn2(t):
    return R.ranked(t.items, ["jurisdiction"], [F.desc("amount"), F.col("item_id")]).select("jurisdiction", "item_id", "rank")


@query("wn4_middle_page", "SELECT item_id, leaf FROM (SELECT item_id, leaf, row_number() OVER (PARTITION BY item_id ORDER BY leaf, quality, tokens) AS r, count(*) OVER (PARTITION BY item_id) AS n FROM @leaves) WHERE r = n // 2 + 1")
def wn4(t):
    return R.middle(t.leaves, ["item_id"], [F.col("leaf"), F.col("quality"), F.col("tokens")]).select("item_id", "leaf")


@query("wn6_step_pages", "SELECT decade, item_id FROM (SELECT (year // 10 * 10)::VARCHAR || 's' AS decade, item_id, row_number() OVER (PARTITION BY year // 10 ORDER BY ocr_quality DESC, year DESC, item_id) AS r FROM @items WHERE dated = 1) WHERE r <= 3")
def wn6(t):
    rows = t.items.filter("dated = 1").withColumn("decade", P.decade(F.col("year")))
    return R.capped(rows, ["decade"], [F.desc("ocr_quality"), F.desc("year"), F.col("item_id")], 3).select("decade", "item_id")


@query("wn7_top_per_period", "SELECT p AS period, k.item_id FROM (VALUES ('1990s'), ('2000s'), ('1980s')) v(p) LEFT JOIN (SELECT (year // 10 * 10)::VARCHAR || 's' AS period, arg_min(item_id, ROW(-amount, item_id)) AS item_id FROM @items WHERE dated = 1 GROUP BY 1) k ON k.period = p")
def wn7(t):
    best = t.items.filter("dated = 1").groupBy(P.decade(F.col("year")).alias("period")).agg(F.min(F.struct((-F.col("amount")).alias("a"), "item_id")).alias("m")).select("period", "m.item_id")
    return t.spark.createDataFrame([("1990s",), ("2000s",), ("1980s",)], "period string").join(best, "period", "left")


@query("wn8_contiguous_axis", "SELECT y AS decade, count(item_id) AS n FROM (SELECT unnest(generate_series(1980, 2010, 10))::INT AS y) LEFT JOIN @items ON year // 10 * 10 = y AND dated = 1 GROUP BY y")
def wn8(t):
    axis = t.spark.range(1).select(F.explode(F.sequence(F.lit(1980), F.lit(2010), F.lit(10))).alias("decade"))
    n = t.items.filter("dated = 1").groupBy((F.floor(F.col("year") / 10) * 10).cast("int").alias("decade")).agg(F.count("*").alias("n"))
    return axis.join(n, "decade", "left").select("decade", F.coalesce("n", F.lit(0)).alias("n"))


@query("wn10_name_suffix", "SELECT o_orderkey, o_orderpriority || CASE WHEN r > 1 THEN '-' || r::VARCHAR ELSE '' END AS name FROM (SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS r FROM orders)")
def wn10(t):
    r = F.row_number().over(Window.partitionBy("o_orderpriority").orderBy("o_orderkey"))
    return t.orders.withColumn("r", r).select("o_orderkey", F.concat("o_orderpriority", F.when(F.col("r") > 1, F.concat(F.lit("-"), F.col("r").cast("string"))).otherwise("")).alias("name"))


@query("wn11_token_windows", """SELECT doc_id, s AS start, least(n - s, 300) AS token_count FROM (SELECT doc_id, n, unnest(generate_series(0, greatest(0, ceil((n - 300) / 260.0))::INT * 260, 260)) AS s FROM (SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[\\p{L}\\p{N}]+')) AS n FROM documents) WHERE n > 0)""")
def wn11(t):
    n = t.documents.select("doc_id", F.size(T.tokens("text")).alias("n"))
    return n.withColumn("start", F.explode(T.windows(F.col("n")))).select("doc_id", F.col("start").cast("long").alias("start"), F.least(F.col("n") - F.col("start"), F.lit(300)).cast("long").alias("token_count"))


@query("wn15_last_per_key", "SELECT user_id, arg_max(event_type, ROW(ts, event_id)) AS last_type, max(ts) AS ts FROM events GROUP BY user_id")
def wn15(t):
    return t.events.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("last_type"), F.max("ts").alias("ts"))


# -- top-k, samples


@query("tk2_top_k_ties", "SELECT p_partkey, p_size FROM part ORDER BY p_size DESC, p_partkey LIMIT 20")
def tk2(t):
    return R.top(t.part.select("p_partkey", "p_size"), [F.desc("p_size"), F.col("p_partkey")], 20)


@query("tk4_pool_and_prefix", "SELECT item_id, r <= 5 AS in_prompt FROM (SELECT item_id, row_number() OVER (ORDER BY amount DESC, item_id) AS r FROM @items) WHERE r <= 20")
def tk4(t):
    pool = R.top(t.items.select("item_id", "amount"), [F.desc("amount"), F.col("item_id")], 20)
    return pool.withColumn("r", F.row_number().over(Window.orderBy(F.desc("amount"), "item_id"))).select("item_id", (F.col("r") <= 5).alias("in_prompt"))  # over 20 rows


@query("tk5_most_common", "SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1 ORDER BY n DESC, c_mktsegment LIMIT 3")
def tk5(t):
    return R.top(t.customer.groupBy("c_mktsegment").agg(F.count("*").alias("n")), [F.desc("n"), F.col("c_mktsegment")], 3)


@query("tk7_undated_last", "SELECT item_id, year FROM @items ORDER BY year NULLS LAST, item_id LIMIT 100")
def tk7(t):
    return R.top(t.items.select("item_id", "year"), [F.asc_nulls_last("year"), F.col("item_id")], 100)


@query("sm1_reservoir_per_class", "SELECT p_brand, p_partkey FROM (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY sha256('s1' || p_partkey::VARCHAR), p_partkey) AS r FROM part) WHERE r <= 4")
def sm1(t):
    return R.sampled(t.part, ["p_brand"], "p_partkey", "s1", 4).select("p_brand", "p_partkey")


@query("sm3_spot_check", "SELECT o_orderkey FROM orders ORDER BY sha256('spot' || o_orderkey::VARCHAR), o_orderkey LIMIT 25")
def sm3(t):
    return R.top(t.orders.select("o_orderkey"), [R.hash_order("spot", "o_orderkey"), F.col("o_orderkey")], 25)


@query("sm5_split_sets", """SELECT c_custkey, CASE WHEN r <= round(n * 0.6) THEN 'train' WHEN r <= round(n * 0.8) THEN 'val' ELSE 'test' END AS part FROM (SELECT c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY sha256('sp' || c_custkey::VARCHAR), c_custkey) AS r, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer)""")
def sm5(t):
    return R.split_sets(t.customer, ["c_mktsegment"], "c_custkey", "sp", {"train": 0.6, "val": 0.2, "test": 0.2}).select("c_custkey", "part")


@query("sm7_common_sample", "SELECT o_custkey FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'O') ORDER BY sha256('ab' || o_custkey::VARCHAR), o_custkey LIMIT 20")
def sm7(t):
    side = lambda s: t.orders.filter(F.col("o_orderstatus") == s).select("o_custkey")
    return R.top(side("F").intersect(side("O")), [R.hash_order("ab", "o_custkey"), F.col("o_custkey")], 20)


@query("sm8_review_queue", """SELECT o_orderkey, kind, position FROM (SELECT *, row_number() OVER (ORDER BY kind, h, o_orderkey) AS position FROM (SELECT o_orderkey, 0 AS kind, '' AS h FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'P'
 UNION ALL (SELECT o_orderkey, 1, sha256('rq' || o_orderkey::VARCHAR) AS h FROM orders WHERE o_orderpriority <> '1-URGENT' ORDER BY h, o_orderkey LIMIT 10))) WHERE position <= 40""")
def sm8(t):
    first = t.orders.filter("o_orderpriority = '1-URGENT' and o_orderstatus = 'P'").select("o_orderkey", F.lit(0).alias("kind"), F.lit("").alias("h"))
    rest = R.top(t.orders.filter("o_orderpriority <> '1-URGENT'").select("o_orderkey", F.lit(1).alias("kind"), R.hash_order("rq", "o_orderkey").alias("h")), [F.col("h"), F.col("o_orderkey")], 10)
    queue = R.top(first.union(rest), [F.col("kind"), F.col("h"), F.col("o_orderkey")], 40)
    return queue.withColumn("position", F.row_number().over(Window.orderBy("kind", "h", "o_orderkey"))).select("o_orderkey", "kind", "position")  # over 40 rows


# -- sets


@query("st1_union", "SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' UNION SELECT c_custkey FROM customer WHERE c_acctbal < 0")
def st1(t):
    return t.orders.filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k")).union(t.customer.filter("c_acctbal < 0").select("c_custkey")).distinct()


@query("st2_intersection", "SELECT c_custkey AS k FROM customer WHERE c_acctbal > 5000 INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def st2(t):
    return t.customer.filter("c_acctbal > 5000").select(F.col("c_custkey").alias("k")).intersect(t.orders.filter("o_orderstatus = 'P'").select("o_custkey"))


@query("st3_difference", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def st3(t):
    return t.customer.select(F.col("c_custkey").alias("k")).subtract(t.orders.filter("o_orderstatus = 'P'").select("o_custkey"))


@query("st4_overlap_at_k", "WITH a AS (SELECT item_id FROM @items ORDER BY amount DESC, item_id LIMIT 50), b AS (SELECT item_id FROM @items ORDER BY ocr_quality DESC, amount DESC, item_id LIMIT 50) SELECT round((SELECT count(*) FROM a JOIN b USING (item_id)) / 50.0, 6) AS overlap")
def st4(t):
    x = R.top(t.items, [F.desc("amount"), F.col("item_id")], 50).select("item_id")
    y = R.top(t.items, [F.desc("ocr_quality"), F.desc("amount"), F.col("item_id")], 50).select("item_id")
    return x.join(y, "item_id").agg(F.round(F.count("*") / 50.0, 6).alias("overlap"))


@query("st5_symmetric_compare", """SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' WHEN a.v IS NOT DISTINCT FROM b.v THEN 'same' ELSE 'changed' END AS state
 FROM (SELECT o_orderkey AS k, o_orderstatus AS v FROM orders WHERE o_orderkey % 2 = 0) a FULL JOIN (SELECT l_orderkey AS k, min(l_linestatus) AS v FROM lineitem WHERE l_orderkey % 3 = 0 GROUP BY 1) b ON a.k = b.k""")
def st5(t):
    a = t.orders.filter("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("v"))
    b = t.lineitem.filter("l_orderkey % 3 = 0").groupBy(F.col("l_orderkey").alias("k")).agg(F.min("l_linestatus").alias("v"))
    return U.compared(a, b, "k", "v")


@query("st6_recompute_guard", "SELECT metric, computed, published FROM (SELECT event_type AS metric, avg(value) AS computed, round(avg(value), 3) + CASE WHEN event_type = 'click' THEN 1 ELSE 0 END AS published FROM events GROUP BY 1) WHERE abs(computed - published) > 5e-4 OR (computed IS NULL) <> (published IS NULL)")
def st6(t):
    got = t.events.groupBy(F.col("event_type").alias("metric")).agg(F.avg("value").alias("computed"))
    said = got.select("metric", (F.round("computed", 3) + F.when(F.col("metric") == "click", 1).otherwise(0)).alias("published"))
    return U.guard(got, said, "metric")


# -- upserts


@query("op_u1_replace_by_key", "SELECT user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def op_u1(t):
    return U.latest(t.events, ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_type", "value")


@query("op_u2_insert_or_ignore", "SELECT c_custkey AS k, 'old' AS source FROM customer WHERE c_custkey < 50 UNION ALL SELECT DISTINCT o_custkey, 'new' FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey < 50)")
def op_u2(t):
    old = t.customer.filter("c_custkey < 50").select(F.col("c_custkey").alias("k"), F.lit("old").alias("source"))
    return U.insert_missing(old, t.orders.select(F.col("o_custkey").alias("k"), F.lit("new").alias("source")), ["k"])


@query("op_u3_keep_first_seen", """SELECT coalesce(a.k, b.k) AS k, coalesce(a.seen, b.seen) AS first_seen, coalesce(b.v, a.v) AS v FROM (SELECT user_id AS k, min(ts) AS seen, min(value) AS v FROM events WHERE event_type = 'signup' GROUP BY 1) a
 FULL JOIN (SELECT user_id AS k, max(ts) AS seen, max(value) AS v FROM events WHERE event_type = 'click' GROUP BY 1) b ON a.k = b.k""")
def op_u3(t):
    old = t.events.filter("event_type = 'signup'").groupBy(F.col("user_id").alias("k")).agg(F.min("ts").alias("first_seen"), F.min("value").alias("v"))
    new = t.events.filter("event_type = 'click'").groupBy(F.col("user_id").alias("k")).agg(F.max("ts").alias("first_seen"), F.max("value").alias("v"))
    return U.merge_keep(old, new, "k", keep=["first_seen"])


def _kept(t, rows, key, **more):
    """A table of versions with rows as its first."""
    table = Snapshots.create(t.spark, scratch(t.spark, "log"), rows.schema, key, 16, **more)
    table.append(rows)
    return table


_FIRST = "SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events WHERE event_id % 2 = {0}"


@query("op_u1_log_replace", f"""SELECT user_id, event_type, coalesce(b.value, a.value) AS value, coalesce(b.event_id, a.event_id) AS event_id FROM (SELECT * FROM ({_FIRST.format(0)}) WHERE r = 1) a FULL JOIN (SELECT * FROM ({_FIRST.format(1)}) WHERE r = 1) b USING (user_id, event_type)""")
def op_u1_log(t):
    rows = t.events.select("user_id", "event_type", "value", "event_id", "ts")
    order = [F.desc("ts"), F.desc("event_id")]
    table = _kept(t, U.latest(rows.filter("event_id % 2 = 0"), ["user_id", "event_type"], order), ["user_id", "event_type"])
    table.upsert(rows.filter("event_id % 2 = 1"), order)
    return table.read().select("user_id", "event_type", "value", "event_id")


@query("op_u2_log_ignore", "SELECT c_custkey AS k, 'old' AS source FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT DISTINCT o_custkey, 'new' FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0)")
def op_u2_log(t):
    table = _kept(t, t.customer.filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k"), F.lit("old").alias("source")), ["k"])
    for _ in range(2):
        table.insert_missing(t.orders.select(F.col("o_custkey").alias("k"), F.lit("new").alias("source")))
    return table.read()


@query("op_u3_log_first_seen", """SELECT coalesce(a.k, b.k) AS k, coalesce(a.seen, b.seen) AS first_seen, coalesce(b.v, a.v) AS v FROM (SELECT user_id AS k, min(ts) AS seen, min(value) AS v FROM events WHERE event_type = 'signup' GROUP BY 1) a
 FULL JOIN (SELECT user_id AS k, max(ts) AS seen, max(value) AS v FROM events WHERE event_type = 'click' GROUP BY 1) b ON a.k = b.k""")
def op_u3_log(t):
    of = lambda kind, how: t.events.filter(F.col("event_type") == kind).groupBy(F.col("user_id").alias("k")).agg(how("ts").alias("first_seen"), how("value").alias("v"))
    table = _kept(t, of("signup", F.min), ["k"])
    table.merge_keep(of("click", F.max), ["first_seen"])
    return table.read()


@query("op_u7_log_append_only", "SELECT event_id, CASE WHEN event_type = 'click' THEN 2 ELSE 1 END AS appended FROM events")
def op_u7_log(t):
    rows = t.events.select("event_id", F.when(F.col("event_type") == "click", 2).otherwise(1).alias("appended"))
    trail = _kept(t, rows.filter("appended = 1"), ["event_id"], append_only=True)
    for change in (trail.delete, trail.replace):
        try:
            change(rows)
        except PermissionError:
            continue
        raise AssertionError("a trail was changed")
    trail.append(rows.filter("appended = 2"))
    return trail.read()


@query("op_u4_daily_budget", "SELECT d AS day, used, used <= 200 AS within FROM (SELECT ts::DATE AS d, count(*) AS used FROM events GROUP BY 1)")
def op_u4(t):
    return U.daily_budget(t.events, "ts", 200)


@query("op_u5_ttl_purge", "SELECT event_id FROM events, (SELECT max(ts) AS now FROM events) WHERE event_type = 'signup' OR ts + INTERVAL 3 DAY >= now")
def op_u5(t):
    rows = t.events.withColumn("expires_at", F.when(F.col("event_type") != "signup", F.col("ts") + F.expr("interval 3 days")))
    return U.unexpired(rows, rows.agg(F.max("ts").alias("now"))).select("event_id")


@query("op_u6_capped_retention", "SELECT event_id, least(ts + to_days(floor(value)::INT), ts + INTERVAL 90 DAY) AS expires FROM events")
def op_u6(t):
    asked = F.col("ts") + F.make_dt_interval(F.floor("value").cast("int"))
    return t.events.select("event_id", F.least(asked, F.col("ts") + F.expr("interval 90 days")).alias("expires"))


@query("op_u8_remap_report", """SELECT before, after, count(*) AS n FROM (SELECT c_mktsegment AS before, CASE WHEN contains(lower(c_mktsegment), 'furn') THEN 'HOME' WHEN contains(lower(c_mktsegment), 'house') THEN 'HOME' ELSE c_mktsegment END AS after FROM customer) GROUP BY 1, 2""")
def op_u8(t):
    after = F.coalesce(M.first_rule(F.col("c_mktsegment"), [("furn", "HOME"), ("house", "HOME")]), "c_mktsegment")
    return t.customer.groupBy(F.col("c_mktsegment").alias("before"), after.alias("after")).agg(F.count("*").alias("n"))


@query("op_u10_extension_clash", "SELECT doc_id FROM labels WHERE doc_id IN (SELECT doc_id FROM documents WHERE doc_id % 4 = 0)")
def op_u10(t):
    return U.clashes(t.labels, t.documents.filter("doc_id % 4 = 0"), ["doc_id"]).select("doc_id")
