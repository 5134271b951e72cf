"""Queries on answers and sweeps: conversations stand in for drafted answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from pressmark.operators import answers as A
from pressmark.operators import retrieval as S
from pressmark.plans.registry import part, query
from pressmark.plans.retrieval import _dense, _lexical
from pressmark.tables import dealt, tasks

part("drafts", "drafts AS (SELECT conv_id AS answer, turn AS pos, 'In ' || (1990 + conv_id % 7)::VARCHAR || ' x' AS text, turn % 3 <> 0 AS cites, CASE WHEN turn % 5 = 4 THEN -1 ELSE conv_id END AS passage FROM conversations)")
part("judged_drafts", """judged_drafts AS (SELECT answer, pos, text, passage, CASE WHEN NOT cites THEN 'no citation' WHEN passage = -1 THEN 'citation failed' WHEN answer % 7 NOT IN (0, 1, 2, 3) THEN 'names a year that is not cited' END AS reason FROM @drafts)""")


def _drafts(t):
    c = t.conversations.select(F.col("conv_id").alias("answer"), F.col("turn").alias("pos"))
    sentences = c.select("answer", "pos", F.concat(F.lit("In "), (F.col("answer") % 7 + 1990).cast("string"), F.lit(" x")).alias("text"))
    cites = c.filter("pos % 3 <> 0").select("answer", "pos", F.when(F.col("pos") % 5 == 4, -1).otherwise(F.col("answer")).alias("passage_id"))
    evidence = c.select("answer").distinct().select("answer", F.col("answer").alias("passage_id"), F.concat(F.lit("i"), F.col("answer").cast("string")).alias("item_id"), F.lit(1990).alias("year"), F.lit("1991 to 1993; 1992").alias("text"))
    return A.judged(sentences, cites, evidence)


@query("mx91_judged_sentences", "SELECT answer, pos, reason FROM @judged_drafts")
def mx91(t):
    return _drafts(t).select("answer", "pos", "reason")


@query("sc56_composed_answers", """SELECT answer, CASE WHEN k > 0 THEN txt END AS text, CASE WHEN k = 0 THEN 'INSUFFICIENT_EVIDENCE' WHEN answer % 2 = 0 THEN 'PARTIALLY_SUPPORTED' WHEN d > 0 THEN 'PARTIALLY_SUPPORTED' ELSE 'SUPPORTED' END AS state, CASE WHEN k = 0 THEN CASE WHEN r THEN 'unverified' ELSE 'uncited' END END AS abstains
 FROM (SELECT answer, count(*) FILTER (WHERE reason IS NULL) AS k, count(*) FILTER (WHERE reason IS NOT NULL) AS d, string_agg(text, ' ' ORDER BY pos) FILTER (WHERE reason IS NULL) AS txt, bool_or(coalesce(reason <> 'no citation', true)) AS r FROM @judged_drafts GROUP BY answer)""")
def sc56(t):
    rows = _drafts(t)
    proposals = rows.select("answer").distinct().withColumn("proposed", F.when(F.col("answer") % 2 == 0, "CONFLICTING").otherwise("SUPPORTED"))
    return A.composed(rows, proposals)


@query("sc48_page_dated", """SELECT item_id, leaf, CASE WHEN p IS NOT NULL THEN year END AS year, CASE WHEN p IS NULL THEN 'not_found' WHEN p = leaf THEN 'read_from_page' ELSE 'read_from_front_matter' END AS method, p AS page_leaf FROM (SELECT a.item_id, a.leaf, a.year, (SELECT arg_min(b.leaf, ROW((b.leaf <> a.leaf)::INT, b.leaf)) FROM pg b WHERE b.item_id = a.item_id AND (b.leaf = a.leaf OR b.leaf < 6) AND b.y = a.year) AS p FROM wanted a)""".replace("FROM pg b", "FROM (SELECT l_orderkey AS item_id, l_linenumber AS leaf, min(year(l_shipdate))::INT AS y FROM lineitem GROUP BY 1, 2) b").replace("FROM wanted a", "FROM (SELECT l_orderkey AS item_id, l_linenumber AS leaf, max(year(o_orderdate))::INT AS year FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2) a"))
def sc48(t):
    lines, orders = dealt((t.lineitem, "l_orderkey"), (t.orders, "o_orderkey"))
    pages = lines.groupBy(F.col("l_orderkey").alias("item_id"), F.col("l_linenumber").alias("leaf")).agg(F.concat(F.lit("shipped "), F.min(F.year("l_shipdate")).cast("string")).alias("text"))
    wanted = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("l_orderkey").alias("item_id"), F.col("l_linenumber").alias("leaf")).agg(F.max(F.year("o_orderdate")).alias("year"))
    return A.page_dated(wanted, pages, tasks=tasks(t.lineitem))


@query("ev8_switch_sweep", "SELECT config, doc_id FROM (SELECT 'lexical' AS config, doc_id, row_number() OVER (ORDER BY s DESC, doc_id) AS r FROM (SELECT doc_id, sum(1.0 / (60 + rank)) AS s FROM @bmrank WHERE rank <= 50 GROUP BY 1) UNION ALL SELECT 'both', doc_id, row_number() OVER (ORDER BY round(s, 12) DESC, doc_id) FROM (SELECT doc_id, sum(1.0 / (60 + rank)) AS s FROM (SELECT * FROM @bmrank WHERE rank <= 50 UNION ALL SELECT * FROM @dnrank WHERE rank <= 50) GROUP BY 1)) WHERE r <= 10")
def ev8(t):
    def run(dense_weight):
        a = S.with_rank(_lexical(t, 50), "doc_id", ["q"], "rank")
        b = S.with_rank(_dense(t), "doc_id", ["q"], "rank").filter("rank <= 50")
        fused = S.rrf([(a, 1.0), (b, dense_weight)], "doc_id", ["q"]).withColumn("s", F.round("score", 12))
        return fused.orderBy(F.desc("s"), "doc_id").limit(10).select("doc_id")

    return A.swept({"lexical": 0.0, "both": 1.0}, run)
