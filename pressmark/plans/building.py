"""Queries on building a corpus: orders stand in for items, their lines for leaves, documents for pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from pressmark.functions.sections import authors
from pressmark.operators import building as B
from pressmark.operators import harvest as H
from pressmark.plans.registry import part, query

part("pieces", r"pieces AS (SELECT doc_id, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '[\x09-\x0D\x20]*[^\x09-\x0D\x20]+') AS ps FROM documents)")
part("passages", r"""passages AS (SELECT doc_id, j, s, least(s + 300, len(ps)) AS e, b + length(ps[s + 1]) - length(regexp_replace(ps[s + 1], '^[\x09-\x0D\x20]+', '')) AS char_start, length(array_to_string(ps[1:least(s + 300, len(ps))], '')) AS char_end, x FROM
 (SELECT *, length(array_to_string(ps[1:s], '')) AS b FROM (SELECT doc_id, x, ps, unnest(range(0, greatest(0, ceil((len(ps) - 300) / 260.0)::INT) + 1)) AS j FROM @pieces WHERE len(ps) > 0), LATERAL (SELECT j * 260 AS s)))""")


@query("mx71_passage_rows", "SELECT doc_id::VARCHAR || ':' || j::VARCHAR AS passage_id, char_start::INT AS char_start, char_end::INT AS char_end, (e - s)::INT AS token_count, md5(substr(x, char_start + 1, char_end - char_start)) AS text_md5 FROM @passages")
def mx71(t):
    return B.passages(t.documents, "doc_id", "text").select("passage_id", "char_start", "char_end", "token_count", F.md5("text").alias("text_md5"))


def _leaves(t):
    """Orders with offsets of every scanned leaf in a text, and which leaves are shown: every line but the third; some orders lack offsets."""
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey")
    per = t.lineitem.groupBy("l_orderkey").agg(F.count("*").cast("int").alias("n"), F.array_sort(F.collect_list(line)).alias("ls"))  # an order's lines
    text = F.array_join(F.transform("ls", lambda x: F.rpad(F.concat(F.lit("page "), x["l_partkey"].cast("string")), 12, ".")), "")
    cut = F.when(F.col("l_orderkey") % 6 == 0, F.col("n") - 1).otherwise(F.col("n"))
    pairs = F.transform(F.filter(F.sequence(F.lit(0), F.lit(19)), lambda i: i < cut), lambda i: F.array((i * 12).cast("int"), (i * 12 + 12).cast("int")))
    shown = F.filter(F.filter(F.sequence(F.lit(0), F.lit(19)), lambda i: i < F.col("n")), lambda i: i != 2)
    return per.select("l_orderkey", text.alias("content"), pairs.alias("offsets"), F.when(F.col("l_orderkey") % 10 != 0, shown).alias("shown"))


@query("mx1_compiled_items", """SELECT kind, count(*) AS n, count(DISTINCT identifier) AS items, sum(chars)::BIGINT AS chars FROM (
 SELECT 'item' AS kind, l_orderkey AS identifier, NULL AS chars FROM o UNION ALL
 SELECT 'skipped', l_orderkey, NULL FROM o WHERE l_orderkey % 10 = 0 OR l_orderkey % 6 = 0 AND n <> 3 UNION ALL
 SELECT 'page', l_orderkey, 12 FROM o, LATERAL (SELECT unnest(range(n)) AS i) WHERE i <> 2 AND l_orderkey % 10 <> 0 AND (l_orderkey % 6 <> 0 OR n = 3) UNION ALL
 SELECT 'passage', l_orderkey, 12 FROM o, LATERAL (SELECT unnest(range(n)) AS i) WHERE i <> 2 AND l_orderkey % 10 <> 0 AND (l_orderkey % 6 <> 0 OR n = 3)) GROUP BY kind""".replace("FROM o", "FROM (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) o"))
def mx1(t):
    rows = B.compiled(_leaves(t), "l_orderkey", "content", "offsets", "shown")
    return rows.groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("identifier").alias("items"), F.sum("chars").alias("chars"))


@query("mx3_shown_leaves", "SELECT l_orderkey, i::INT AS scanned, (CASE WHEN i > 2 THEN i - 1 ELSE i END)::INT AS leaf FROM (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1), LATERAL (SELECT unnest(range(n)) AS i) WHERE i <> 2 AND l_orderkey % 10 <> 0")
def mx3(t):
    return B.shown_leaves(_leaves(t), "l_orderkey", "shown")


def _parsed(t):
    whole = F.concat_ws("\f", "p_name", "p_type", F.when(F.col("p_size") % 3 == 0, F.col("p_brand")))
    return t.part.select("p_partkey", F.lit("DjVuTXT").alias("form"), whole.alias("content"), F.when(F.col("p_size") % 5 != 0, (F.col("p_size") % 2 + 2).cast("int")).alias("expected"))


@query("mx72_parsed_items", "SELECT p_partkey, n AS parsed, coalesce(n <> e, false) AS mismatch, CASE WHEN n <> e THEN 'parsed ' || n::VARCHAR || ' pages but the page map has ' || e::VARCHAR END AS reason FROM (SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 3 ELSE 2 END AS n, CASE WHEN p_size % 5 <> 0 THEN p_size % 2 + 2 END AS e FROM part)")
def mx72(t):
    return B.parsed_items(_parsed(t), "p_partkey", "form", "content", "expected").select("p_partkey", "parsed", "mismatch", "reason")


@query("mx73_build_counters", """SELECT count(*) FILTER (WHERE new) AS items_parsed, count(*) FILTER (WHERE done) AS items_skipped_done, count(*) FILTER (WHERE NOT done AND pending) AS items_pending_download, count(*) FILTER (WHERE new AND p_size % 4 = 0) AS items_no_page_numbers,
 sum(n) FILTER (WHERE new)::BIGINT AS total_pages, count(*) FILTER (WHERE new AND n <> e) AS alignment_risk, count(*) FILTER (WHERE new AND p_size % 13 = 0) AS zero_usable_text_items
 FROM (SELECT *, NOT done AND NOT pending AS new, CASE WHEN p_size % 4 <> 0 THEN 3 WHEN p_size % 8 = 0 THEN p_size END AS e FROM (SELECT p_size, p_partkey % 10 = 0 AS done, p_size % 7 = 0 AS pending, CASE WHEN p_size % 13 = 0 THEN 1 ELSE p_size % 3 + 1 END AS n FROM part))""")
def mx73(t):
    size = F.col("p_size").cast("int")
    text = F.when(size % 13 == 0, F.lit("  ")).otherwise(F.array_join(F.slice(F.array("p_name", "p_type", "p_brand"), 1, size % 3 + 1), "\f"))
    items = t.part.select(F.col("p_partkey").alias("item_id"), F.lit("djvutxt").alias("source"), F.when(size % 7 != 0, text).alias("text"), F.when(size % 4 != 0, F.array(F.lit("1"), F.lit("2"), F.lit("3"))).alias("labels"), F.when(size % 8 == 0, size).alias("page_count"))
    return B.build_counters(items, t.part.filter("p_partkey % 10 = 0").select(F.col("p_partkey").alias("item_id")))


@query("mx74_normalised_items", """SELECT count(*) AS items, count(*) FILTER (WHERE NOT d) AS undated_before_items, coalesce(sum(n) FILTER (WHERE NOT d), 0)::BIGINT AS undated_before_passages, count(*) FILTER (WHERE NOT d AND r) AS recovered_items, coalesce(sum(n) FILTER (WHERE NOT d AND r), 0)::BIGINT AS recovered_passages,
 count(*) FILTER (WHERE NOT d AND NOT r) AS undated_after_items, coalesce(sum(n) FILTER (WHERE NOT d AND NOT r), 0)::BIGINT AS undated_after_passages FROM (SELECT o_orderstatus <> 'P' AS d, o_orderkey % 2 = 0 AS r, n FROM orders JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey)""")
def mx74(t):
    n = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("passages"))
    title = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("Report for the year ending "), F.year("o_orderdate").cast("string"))).otherwise("Report")
    items = t.orders.join(n, "o_orderkey").select(F.col("o_orderkey").alias("item_id"), title.alias("title"), F.when(F.col("o_orderstatus") != "P", F.year("o_orderdate").cast("string")).otherwise("n.d.").alias("date_raw"), "passages")
    return B.dating_counters(B.dated(items))


PLACES = {"Brand#1": "north", "Brand#2": "south", "Brand#3": "north"}
_LIST = "[p_brand, 'Brand#' || (p_size % 5 + 1)::VARCHAR]"
_PLACE = "CASE {0} WHEN 'Brand#1' THEN 'north' WHEN 'Brand#2' THEN 'south' WHEN 'Brand#3' THEN 'north' END"
_ONLY = f"CASE WHEN len(list_distinct([x FOR x IN [{_PLACE.format('p_brand')}, {_PLACE.format(chr(40) + chr(39) + 'Brand#' + chr(39) + ' || (p_size % 5 + 1)::VARCHAR' + chr(41))}] IF x IS NOT NULL])) = 1 THEN coalesce({_PLACE.format('p_brand')}, {_PLACE.format(chr(40) + chr(39) + 'Brand#' + chr(39) + ' || (p_size % 5 + 1)::VARCHAR' + chr(41))}) END"


def _collections():
    return F.array("p_brand", F.concat(F.lit("Brand#"), (F.col("p_size") % 5 + 1).cast("string")))


@query("mx75_only_place", f"SELECT p_partkey, {_ONLY} AS place FROM part")
def mx75(t):
    return t.part.select("p_partkey", B.only_place(_collections(), PLACES).alias("place"))


@query("mx76_issuer_place", f"""SELECT p_partkey, CASE WHEN c <> p THEN 'unknown' ELSE coalesce(c, p, o, 'unknown') END AS place, CASE WHEN c <> p THEN 'conflict' WHEN c IS NOT NULL THEN 'creator' WHEN p IS NOT NULL THEN 'publisher' WHEN o IS NOT NULL THEN 'collection' ELSE 'none' END AS method
 FROM (SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'north' END AS c, CASE WHEN p_size % 4 = 0 THEN 'north' WHEN p_size % 4 = 1 THEN 'south' END AS p, {_ONLY} AS o FROM part)""")
def mx76(t):
    size = F.col("p_size")
    read = B.issuer_place(F.when(size % 3 == 0, "north"), F.when(size % 4 == 0, "north").when(size % 4 == 1, "south"), B.only_place(_collections(), PLACES))
    return t.part.select("p_partkey", read["place"].alias("place"), read["method"].alias("method"))


@query("mx60_place_at_harvest", """SELECT p_partkey, CASE WHEN contains(x, 'anodized') OR contains(x, 'brass') THEN 'Metal' WHEN contains(x, 'promo') THEN 'Sale' WHEN contains(x, 'economy') THEN 'Federal' WHEN p_brand = 'Brand#2' THEN 'south' ELSE 'Unknown' END AS place FROM (SELECT *, lower(coalesce(p_type, '') || ' ' || p_name) AS x FROM part)""")
def mx60(t):
    place = H.place_at_harvest(F.col("p_type"), F.lit(None).cast("string"), F.col("p_name"), F.array("p_brand"), [("Metal", ("anodized", "brass")), ("Sale", ("promo",))], ("economy",), {"Brand#2": "south"})
    return t.part.select("p_partkey", place.alias("place"))


@query("mx61_type_at_harvest", "SELECT p_partkey, CASE WHEN contains(x, ' ring ') THEN 'Ring' WHEN contains(x, 'small') OR contains(x, 'large') THEN 'Sized' ELSE 'Other/Unknown' END AS doc_type FROM (SELECT p_partkey, ' ' || lower(p_name) || ' ' AS x FROM part)")
def mx61(t):
    return t.part.select("p_partkey", H.type_at_harvest(F.col("p_name"), [("Ring", (" ring ",)), ("Sized", ("small", "large"))]).alias("doc_type"))


BANDS = {"topic_early": (1992, 1994), "topic_late": (1995, 1998)}
_SIZES = "SELECT jurisdiction, count(*) AS texts_items, count(*) FILTER (WHERE t) AS topic_items, count(*) FILTER (WHERE t AND year BETWEEN 1992 AND 1994) AS topic_early, count(*) FILTER (WHERE t AND year BETWEEN 1995 AND 1998) AS topic_late FROM (SELECT *, issuer IN ('BUILDING', 'HOUSEHOLD') AS t FROM @items) GROUP BY 1"


def _sizes(t):
    return H.scope_sizes(t.items, "jurisdiction", F.col("issuer").isin("BUILDING", "HOUSEHOLD"), BANDS)


@query("mx65_scope_sizes", _SIZES)
def mx65(t):
    return _sizes(t)


@query("mx64_collection_sizes", "SELECT collection, count(*) AS total_items, count(*) FILTER (WHERE doc_type <> '5-LOW') AS texts_items FROM @items GROUP BY 1")
def mx64(t):
    return t.items.groupBy("collection").agg(F.count("*").alias("total_items"), F.count_if(F.col("doc_type") != "5-LOW").alias("texts_items"))


@query("mx66_scope_recommendation", f"SELECT jurisdiction AS best_scope, topic_late AS in_window, round(topic_late * 0.75)::BIGINT AS usable, round(topic_late * 0.75) >= 20 AS clears_floor FROM ({_SIZES}) ORDER BY topic_late DESC, jurisdiction DESC LIMIT 1")
def mx66(t):
    return H.recommended(_sizes(t), "jurisdiction", "topic_late", 0.75, 20)


@query("mx6_registered_corpus", """SELECT 'documents' AS kind, count(*) AS n, sum(('0x' || sha256('{"c_custkey":' || c_custkey::VARCHAR || ',"c_name":"' || c_name || '","item_id":' || c_custkey::VARCHAR || '}')[1:12])::HUGEINT)::VARCHAR AS digest FROM customer WHERE c_custkey % 3 <> 0
 UNION ALL SELECT 'passages', count(*), sum(('0x' || sha256(coalesce(text, ''))[1:12])::HUGEINT)::VARCHAR FROM documents""")
def mx6(t):
    items = t.customer.select(F.col("c_custkey").alias("item_id"), "c_custkey", "c_name")
    known = t.customer.filter("c_custkey % 3 = 0").select(F.concat(F.lit("ia:"), F.col("c_custkey").cast("string")).alias("doc_id"))
    passages = t.documents.select(F.col("doc_id").alias("passage_id"), F.col("doc_id").alias("item_id"), "text")
    made = B.registered(known, items, passages)
    total = lambda c: F.sum(F.conv(F.substring(c, 1, 12), 16, 10).cast("decimal(38,0)")).cast("string").alias("digest")
    return made["documents"].agg(F.lit("documents").alias("kind"), F.count("*").alias("n"), total("record_sha256")).unionByName(made["passages"].agg(F.lit("passages").alias("kind"), F.count("*").alias("n"), total("text_sha256")))


@query("mx7_text_versions", "SELECT state, count(*) AS n FROM (SELECT doc_id, sha256(coalesce(text, '')) AS h, 'old' AS state FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, sha256(x), CASE WHEN trim(x) = '' THEN 'empty' ELSE 'fetched' END FROM (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN coalesce(text, '') ELSE coalesce(text, '') || '!' END AS x FROM documents) WHERE doc_id % 4 <> 0) GROUP BY state")
def mx7(t):
    have = t.documents.filter("doc_id % 2 = 0").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"), F.lit("old").alias("state"))
    fetched = t.documents.select("doc_id", F.when(F.col("doc_id") % 4 == 0, F.coalesce("text", F.lit(""))).otherwise(F.concat(F.coalesce("text", F.lit("")), F.lit("!"))).alias("text"))
    return B.text_versions(have, fetched).groupBy("state").agg(F.count("*").alias("n"))


@query("mx23_first_pages", "SELECT item, leaf, string_agg(x, ' ' ORDER BY pos, x) AS text FROM (SELECT l_orderkey AS item, l_linenumber - 1 AS leaf, l_suppkey AS pos, 'p' || l_partkey::VARCHAR AS x FROM lineitem) WHERE leaf < 3 GROUP BY item, leaf")
def mx23(t):
    rows = t.lineitem.select(F.col("l_orderkey").alias("item"), (F.col("l_linenumber") - 1).alias("leaf"), F.col("l_suppkey").alias("pos"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("x"))
    return B.first_pages(rows, "item", "leaf", "pos", "x", 3)


@query("wn5_leaf_counts", "SELECT item_id, leaf, max(leaf) OVER (PARTITION BY item_id) + 1 AS n_leaves FROM @leaves")
def wn5(t):
    from pressmark.operators.cubes import with_leaf_count

    return with_leaf_count(t.leaves.select("item_id", "leaf"))


@query("sc11_author_entries", None)
def sc11(t):
    return t.documents.select("doc_id", authors(F.col("text")).alias("authors"))
