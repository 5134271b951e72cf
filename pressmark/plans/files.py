"""Queries on sources and sinks: what the tables hold is written to the shared folder, read back and compared."""

from __future__ import annotations

import json
from urllib.parse import parse_qs, urlsplit

import pyarrow as pa
from pyspark.sql import functions as F

from pressmark.functions import text as T
from pressmark.operators import harvest as H
from pressmark.operators import packing as K
from pressmark.plans.registry import query, scratch
from pressmark.plans.retrieval import TOKENS
from pressmark.sources import readers, search, sinks, web
from pressmark.sources.snapshots import Snapshots
from pressmark.streaming import flows

LINE = "doc_id long, lang string, text string, kind string"
_KEPT = "doc_id, lang, md5(text) AS text_md5"


def _lines(t):
    return t.documents.select(F.to_json(F.struct("doc_id", "lang", "text", F.when(F.col("doc_id") % 5 == 0, "error").otherwise("hocr").alias("kind")), {"ignoreNullFields": "false"}).alias("value"))


def _read(rows):
    return rows.select("doc_id", "lang", F.md5("text").alias("text_md5"))


@query("src1_json_lines", f"SELECT {_KEPT} FROM documents")
def src1(t):
    path = scratch(t.spark, "lines")
    _lines(t).unionByName(t.nation.select(F.lit("  ").alias("value"))).write.text(path)
    return _read(readers.json_lines(t.spark, path, LINE))


@query("src2_commented_lines", f"SELECT {_KEPT} FROM documents")
def src2(t):
    path = scratch(t.spark, "seed")
    _lines(t).unionByName(t.nation.select(F.concat(F.lit(" # "), "n_name").alias("value"))).write.text(path)
    return _read(readers.json_lines(t.spark, path, LINE, comments=True))


@query("src3_tolerant_lines", "SELECT doc_id FROM documents WHERE doc_id % 7 <> 0 AND doc_id % 5 <> 0")
def src3(t):
    path = scratch(t.spark, "log")
    torn = F.get_json_object("value", "$.doc_id").cast("long") % 7 == 0
    _lines(t).select(F.when(torn, F.substring("value", 1, 20)).otherwise(F.col("value")).alias("value")).write.text(path)
    return readers.done(readers.json_lines(t.spark, path, LINE, tolerant=True), "doc_id")


@query("src4_compressed_lines", f"SELECT {_KEPT} FROM documents")
def src4(t):
    path = scratch(t.spark, "catalogue")
    _lines(t).write.option("compression", "gzip").text(path)
    return _read(readers.json_lines(t.spark, f"{path}/*.gz", LINE))


@query("src5_rule_table", "SELECT (row_number() OVER (ORDER BY n_nationkey % 3 DESC, n_nationkey) - 1)::INT AS pos, lower(n_name) AS pattern, r_name AS value FROM nation JOIN region ON n_regionkey = r_regionkey")
def src5(t):
    path = scratch(t.spark, "rules")
    named = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    one = named.agg(F.array_sort(F.collect_list(F.struct("n_nationkey", F.concat_ws(",", F.lit("text"), F.concat(F.lit(" "), "n_name"), "r_name", (F.col("n_nationkey") % 3).cast("string")).alias("line")))).alias("x"))  # a rule table
    one.select(F.concat(F.lit("kind,pattern,jurisdiction,specificity\n# a note\n\n"), F.array_join(F.transform("x", lambda x: x["line"]), "\n")).alias("value")).coalesce(1).write.text(path)
    found = readers.rules(t.spark, path)
    return t.spark.createDataFrame([(k, p, v) for k, (p, v) in enumerate(found)], "pos int, pattern string, value string")


@query("src6_raw_items", "SELECT c_custkey::VARCHAR AS identifier, 'new ' || c_name AS title, '[\"' || c_mktsegment || '\",\"x\"]' AS collection_raw, (c_custkey % 2 = 0)::INT AS has_word_coords, c_nationkey::INT AS page_count FROM customer")
def src6(t):
    path = scratch(t.spark, "items")
    for part, title in ((1, "old "), (2, "new ")):
        record = F.struct(F.col("c_custkey").cast("string").alias("identifier"), F.concat(F.lit(title), "c_name").alias("title"), F.array("c_mktsegment", F.lit("x")).alias("collection_raw"), (F.col("c_custkey") % 2 == 0).alias("has_word_coords"), F.col("c_nationkey").alias("page_count"), F.lit(1900).alias("year"))
        t.customer.select(F.to_json(record).alias("value")).write.text(f"{path}/part{part}")
    return readers.raw_items(t.spark, f"{path}/*").select("identifier", "title", "collection_raw", "has_word_coords", "page_count")


#: Bytes of texts that become one page file in XML; no reader splits one.
XML_TEXTS = 32 << 20


def _xml(t):
    path = scratch(t.spark, "xml")
    size = t.documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    files = max(t.spark.sparkContext.defaultParallelism, -(-size // XML_TEXTS))
    words = F.array_join(F.transform(T.tokens("text"), lambda w: F.concat(F.lit("<WORD> "), w, F.lit("</WORD>"))), "")

    def document(batches):  # each partition becomes one file with one root
        yield pa.record_batch([pa.array(["<DOCUMENT>"])], ["value"])
        yield from (pa.record_batch([b.column(0)], ["value"]) for b in batches)
        yield pa.record_batch([pa.array(["</DOCUMENT>"])], ["value"])

    rows = t.documents.repartition(files, "doc_id").select(F.concat(F.lit("<OBJECT><PARAGRAPH><LINE>"), words, F.lit("</LINE></PARAGRAPH></OBJECT>")).alias("value"))
    rows.mapInArrow(document, "value string").write.text(path)
    return readers.xml_pages(t.spark, path)


@query("src8_xml_pages", f"SELECT array_to_string({TOKENS.format('text')}, ' ') AS text FROM documents")
def src8(t):
    return _xml(t).select("text")


@query("src9_xml_stream", f"SELECT count(*) AS pages, sum(len({TOKENS.format('text')}))::BIGINT AS words FROM documents")
def src9(t):
    words = F.when(F.col("text") == "", 0).otherwise(F.size(F.split("text", " ")))
    return _xml(t).agg(F.count("*").alias("pages"), F.sum(words).alias("words"))


_FLAT = "trim(regexp_replace({0}, '[\\s\\x0B\\xA0]+', ' ', 'g'))"


@query("src10_hocr_pages", f"SELECT doc_id, (i - 1)::INT AS leaf, {_FLAT.format('x')} AS text FROM (SELECT doc_id, unnest(xs) AS x, generate_subscripts(xs, 1) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS xs FROM documents))")
def src10(t):
    safe = lambda x: F.replace(F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    page = lambda x: F.concat(F.lit("<div id=p class='ocr_page'><span>"), safe(x), F.lit("</span></div>"))
    files = t.documents.select("doc_id", F.concat(F.lit("<html>"), F.array_join(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), page), ""), F.lit("</html>")).alias("html"))
    return readers.hocr_pages(files, "doc_id", "html")


@query("src13_robots_rules", "SELECT c_custkey, c_nationkey % 4 NOT IN (1, 3) AS allowed FROM customer")
def src13(t):
    k = (F.col("c_nationkey") % 4).cast("int")
    robots = "User-agent: other\nDisallow: /\n\n# ours\nUser-agent: Reader # name\nUSER-AGENT: second\nDisallow: /closed\nAllow: /closed/open\nDisallow: /*.pdf$\nCrawl-delay: 3\n\nUser-agent: *\nDisallow: /"
    path = F.element_at(F.array(*map(F.lit, ("/free", "/closed/x", "/closed/open/y", "/a/b.pdf"))), k + 1)
    return web.allowed(t.customer.select("c_custkey", F.lit(robots).alias("robots"), path.alias("path")), "c_custkey", "robots", "path", "reader")


@query("src14_page_labels", "SELECT l_orderkey, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1)::INT AS leaf, CASE WHEN l_linenumber % 3 <> 0 THEN l_linenumber::VARCHAR END AS label FROM lineitem")
def src14(t):
    page = F.struct("l_linenumber", "l_partkey", "l_suppkey", F.struct((F.col("l_linenumber") + 4).alias("leafNum"), F.when(F.col("l_linenumber") % 3 != 0, F.col("l_linenumber").cast("string")).otherwise(" ").alias("pageNumber")).alias("p"))
    maps = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(page)).alias("ps")).select("l_orderkey", F.to_json(F.struct(F.transform("ps", lambda p: p["p"]).alias("pages"))).alias("j"))
    return readers.page_labels(maps, "l_orderkey", "j")


@query("src15_offset_pages", "SELECT doc_id, (i - 1)::INT AS leaf, md5(substr(x, CASE i WHEN 1 THEN 2 * n + 1 ELSE 1 END, n)) AS text_md5 FROM (SELECT doc_id, coalesce(text, '') AS x, length(coalesce(text, '')) // 3 AS n FROM documents), (VALUES (1), (2)) v(i)")
def src15(t):
    n = F.floor(F.char_length(F.coalesce("text", F.lit(""))) / 3).cast("int")
    pair = lambda a, b: F.array((n * a).cast("int"), (n * b).cast("int"))
    items = t.documents.select("doc_id", F.coalesce("text", F.lit("")).alias("x"), F.array(pair(0, 1), pair(1, 2), pair(2, 3)).alias("offsets"), F.array(F.lit(2), F.lit(0)).alias("shown"))
    return readers.offset_pages(items, "doc_id", "x", "offsets", "shown").select("doc_id", "leaf", F.md5("text").alias("text_md5"))


def _files(k):
    """The files of an item, by its number: some have a text, some an XML, some an hOCR file, some a page map, others none."""
    name = lambda when, end: F.when(when, F.struct(F.concat(k.cast("string"), F.lit(end)).alias("name"), F.md5(F.concat(k.cast("string"), F.lit(end))).alias("md5")))
    return F.array_compact(F.array(name(k % 2 == 0, "_hocr.html"), name(k % 3 == 0, "_djvu.xml"), name(k % 4 == 0, "_djvu.txt"), name(k % 5 == 0, "_page_numbers.json"), name(k % 7 == 0, ".pdf")))


@query("src17_segmentation", """SELECT o_orderkey, CASE WHEN ff > 1 AND (leaves IS NULL OR abs(ff - leaves) <= 2) THEN 'djvutxt' WHEN ff IS NULL THEN 'kept' WHEN o_orderkey % 3 = 0 THEN 'djvuxml' WHEN o_orderkey % 2 = 0 THEN 'hocr' END AS source
 FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 6 <> 0 THEN o_orderkey % 11 END AS ff, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey % 13 END AS leaves FROM orders)""")
def src17(t):
    k = F.col("o_orderkey")
    cut = H.segmentation(_files(k), F.when(k % 6 != 0, k % 11), F.when(k % 5 != 0, k % 13), F.lit("kept"), 2)
    return t.orders.select("o_orderkey", cut["source"].alias("source"))


@query("src18_harvest_records", """SELECT o_orderkey::VARCHAR AS identifier, year, year IS NOT NULL AS dated, f AS ocr_format, 'ocr/' || md5(nm)[1:2] || '/' || md5(nm) || '__' || nm AS ocr_file_ref, o_orderkey % 3 = 0 OR o_orderkey % 2 = 0 AS has_word_coords, o_orderkey % 5 = 0 AS has_printed_page_map
 FROM (SELECT *, o_orderkey::VARCHAR || CASE f WHEN 'DjVuTXT' THEN '_djvu.txt' WHEN 'DjVuXML' THEN '_djvu.xml' ELSE '_hocr.html' END AS nm FROM (SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN year(o_orderdate)::INT END AS year, CASE WHEN o_orderkey % 4 = 0 THEN 'DjVuTXT' WHEN o_orderkey % 3 = 0 THEN 'DjVuXML' WHEN o_orderkey % 2 = 0 THEN 'hOCR' END AS f FROM orders)) WHERE f IS NOT NULL""")
def src18(t):
    return H.records(_items(t), "https://example.org/details").select("identifier", "year", "dated", "ocr_format", "ocr_file_ref", "has_word_coords", "has_printed_page_map")


def _items(t):
    k = F.col("o_orderkey")
    return t.orders.select(k.cast("string").alias("identifier"), F.col("o_orderpriority").alias("title"), F.col("o_custkey").cast("string").alias("creator"), F.lit(None).cast("string").alias("publisher"), F.when(F.col("o_orderstatus") != "P", F.year("o_orderdate")).alias("year"), _files(k).alias("files"), (k % 50).cast("string").alias("page_count"))


@query("mx54_resumable_enrich", "SELECT CASE WHEN o_orderkey % 4 = 0 OR o_orderkey % 3 = 0 OR o_orderkey % 2 = 0 THEN 'record' ELSE 'skipped' END AS kind, count(*) AS n FROM orders WHERE o_orderkey % 10 NOT IN (2, 5) GROUP BY 1")
def mx54(t):
    items = _items(t)
    last = F.col("identifier").cast("long") % 10
    new, skipped = H.enriched(items, items.filter(last == 2), items.filter(last == 5), "https://example.org/details")
    rows = new.select(F.lit("record").alias("kind")).union(skipped.select(F.lit("skipped").alias("kind")))
    return rows.groupBy("kind").agg(F.count("*").alias("n"))


@query("mx63_format_flags", "SELECT o_orderkey, o_orderkey % 4 = 0 AS text, o_orderkey % 3 = 0 AS xml, o_orderkey % 2 = 0 AS hocr, o_orderkey % 4 = 0 OR o_orderkey % 3 = 0 AS usable, o_orderkey % 3 = 0 OR o_orderkey % 2 = 0 AS any_ocr FROM orders")
def mx63(t):
    flags = H.format_flags(_files(F.col("o_orderkey")))
    return t.orders.select("o_orderkey", flags["DjVuTXT"].alias("text"), flags["DjVuXML"].alias("xml"), flags["hOCR"].alias("hocr"), flags["has_usable_text"].alias("usable"), flags["has_any_ocr"].alias("any_ocr"))


@query("mx67_leaf_count", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN n WHEN o_orderkey % 5 < 3 THEN o_orderkey % 50 END::INT AS leaves FROM orders JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
def mx67(t):
    k = F.col("o_orderkey")
    maps = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list("l_linenumber").alias("ls"))  # an order's lines
    said = F.when(k % 5 < 3, (k % 50).cast("string")).otherwise("unknown")
    return t.orders.join(maps, "o_orderkey").select("o_orderkey", H.leaf_count(F.when(k % 5 == 0, F.col("ls")), said).alias("leaves"))


@query("mx69_integrity_pass", "SELECT o_orderkey::VARCHAR AS identifier, CASE WHEN o_orderkey % 9 = 0 THEN 'missing' ELSE 'empty' END AS fault FROM orders WHERE o_orderkey % 9 = 0 OR o_orderkey % 16 = 4 AND o_orderkey % 3 <> 0")
def mx69(t):
    k = F.col("o_orderkey")
    wanted = t.orders.select(k.cast("string").alias("identifier"), F.concat(F.lit("f"), k.cast("string")).alias("file"))
    found = t.orders.filter(k % 3 != 0).select(F.concat(F.lit("f"), k.cast("string")).alias("file"), F.when(k % 8 == 4, 0).otherwise(k + 1).alias("bytes"))
    again = t.orders.filter(k % 9 != 0).select(F.concat(F.lit("f"), k.cast("string")).alias("file"), F.when((k % 16 == 4) & (k % 3 != 0), 0).otherwise(9).alias("bytes"))
    return H.checked_twice(wanted, found, again).select("identifier", "fault")


@query("mx105_fetched_kind", "SELECT CASE WHEN o_orderkey % 2 = 0 AND o_orderkey % 3 = 0 THEN 'hocr' WHEN o_orderkey % 2 = 0 THEN 'searchtext_only' WHEN o_orderkey % 5 = 0 THEN 'djvu_txt' ELSE 'no_text' END AS kind, count(*) AS n FROM orders GROUP BY 1")
def mx105(t):
    k = F.col("o_orderkey")
    return t.orders.groupBy(H.fetched_kind(k % 2 == 0, k % 3 == 0, k % 5 == 0).alias("kind")).agg(F.count("*").alias("n"))


# -- a search service that answers from the table of nations: what a connector asks for is cut from it


def _service(t, fails: int = 0):
    names = sorted(r["n_name"] for r in t.nation.select("n_name").collect())  # a few rows
    state = {"calls": 0, "slept": []}

    def get(url):
        state["calls"] += 1
        if state["calls"] <= fails:
            return 503, {"retry-after": "7"} if state["calls"] == 1 else {}, ""
        q = {k: v[0] for k, v in parse_qs(urlsplit(url).query).items()}
        if "rows" in q:
            rows, page = int(q["rows"]), int(q.get("page", 1))
            return 200, {}, json.dumps({"response": {"numFound": len(names), "docs": [{"identifier": n} for n in names[(page - 1) * rows : page * rows]]}})
        at, size = int(q.get("cursor", 0)), int(q["count"])
        return 200, {}, json.dumps({"items": [{"identifier": n} for n in names[at : at + size]]} | ({"cursor": str(at + size)} if at + size < len(names) else {}))

    return (lambda url: search.fetch(get, url, state["slept"].append)), state


def _found(t, rows):
    return t.spark.createDataFrame([(r["identifier"],) for r in rows], "identifier string")


@query("src19_cursor_scan", "SELECT n_name AS identifier FROM nation")
def src19(t):
    return _found(t, search.by_cursor(_service(t)[0], "https://example.org/scan", "x", 7))


@query("src20_page_scan", "SELECT n_name AS identifier FROM nation")
def src20(t):
    return _found(t, search.by_number(_service(t)[0], "https://example.org/search", "x", 6))


@query("src21_retries", "SELECT count(*) AS found, 3 AS calls, true AS waited FROM nation")
def src21(t):
    ask, state = _service(t, 2)
    n = search.count(ask, "https://example.org/search", "x")
    return t.spark.createDataFrame([(n, state["calls"], 7 <= state["slept"][0] <= 9 and 4 <= state["slept"][1] <= 6)], "found long, calls int, waited boolean")


@query("src22_count_only", "SELECT count(*) AS found FROM nation")
def src22(t):
    return t.spark.createDataFrame([(search.count(_service(t)[0], "https://example.org/search", "x"),)], "found long")


@query("src23_healthy_baseline", "SELECT count(*) AS baseline FROM nation")
def src23(t):
    n = search.count(_service(t)[0], "https://example.org/search", "x")
    return t.spark.createDataFrame([(search.healthy(0, 1, n, 1, 10_000),)], "baseline long")


@query("src24_complete_scan", "SELECT o_orderkey FROM orders")
def src24(t):
    return search.complete(t.orders.select("o_orderkey"), t.orders.count())


@query("src25_content_paths", "SELECT p_partkey, 'ocr/' || md5(p_name)[1:2] || '/' || md5(p_name) || '__' || p_partkey::VARCHAR || '.txt' AS path FROM part")
def src25(t):
    return t.part.select("p_partkey", H.content_path(F.md5("p_name"), F.concat(F.col("p_partkey").cast("string"), F.lit(".txt"))).alias("path"))


@query("mx53_download_tasks", """SELECT min(p_partkey)::VARCHAR AS identifier, dest FROM (SELECT p_partkey, 'ocr/' || md5(p_name)[1:2] || '/' || md5(p_name) || '__' || p_brand AS dest, p_brand FROM part) WHERE p_brand <> 'Brand#1' GROUP BY dest""")
def mx53(t):
    key = F.lpad(F.col("p_partkey").cast("string"), 12, "0")
    items = t.part.select(key.alias("identifier"), F.array(F.struct(F.col("p_brand").alias("name"), F.md5("p_name").alias("md5"))).alias("files"))
    cached = t.part.filter("p_brand = 'Brand#1'").select(H.content_path(F.md5("p_name"), F.col("p_brand")).alias("dest")).distinct()
    tasks = search.download_tasks(items, cached, 1 << 30)
    return tasks.select(F.col("identifier").cast("long").cast("string").alias("identifier"), "dest")


@query("mx62_query_composition", "SELECT r_name AS place, 'mediatype:texts AND (collection:' || lower(r_name) || ' OR collection:all) AND (health)' AS q FROM region")
def mx62(t):
    names = [r["r_name"] for r in t.region.select("r_name").collect()]  # a few rows
    return t.spark.createDataFrame([(n, search.query_of("texts", [n.lower(), "all"], "health")) for n in names], "place string, q string")


# -- sinks


@query("snk1_replaced_partitions", "SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderstatus = 'F' THEN 2 ELSE 1 END AS version FROM orders")
def snk1(t):
    rows = t.orders.select("o_orderkey", "o_orderstatus", F.lit(1).alias("version"))
    corpus = _corpus(t, rows, ["o_orderkey"])
    for _ in range(2):
        corpus.replace(rows.filter("o_orderstatus = 'F'").withColumn("version", F.lit(2)))
    return corpus.read()


def _corpus(t, rows, key, **more):
    """A table of versions that holds rows as version 1."""
    table = Snapshots.create(t.spark, scratch(t.spark, "corpus"), rows.schema, key, 16, **more)
    table.append(rows)
    return table


@query("snk1_item_versions", """SELECT 1 AS version, count(*) AS leaves, count(DISTINCT l_orderkey) AS items, sum(l_quantity)::BIGINT AS quantity FROM lineitem
 UNION ALL SELECT 2, count(*), count(DISTINCT k), sum(q)::BIGINT FROM (SELECT l_orderkey AS k, l_quantity AS q FROM lineitem WHERE l_orderkey % 10 <> 0 UNION ALL SELECT o_orderkey, 1 FROM orders WHERE o_orderkey % 10 = 0)
 UNION ALL SELECT 3, count(*), count(DISTINCT k), sum(q)::BIGINT FROM (SELECT l_orderkey AS k, l_quantity AS q FROM lineitem WHERE l_orderkey % 10 NOT IN (0, 3) UNION ALL SELECT o_orderkey, 1 FROM orders WHERE o_orderkey % 10 = 0)""")
def snk1_versions(t):
    leaves = t.lineitem.select("l_orderkey", F.col("l_quantity").cast("double").alias("quantity"))
    corpus = _corpus(t, leaves, ["l_orderkey"])
    corpus.replace(t.orders.filter("o_orderkey % 10 = 0").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(1.0).alias("quantity")))
    corpus.delete(t.orders.filter("o_orderkey % 10 = 3").select(F.col("o_orderkey").alias("l_orderkey")))
    counted = lambda v: corpus.read(v).agg(F.lit(v).alias("version"), F.count("*").alias("leaves"), F.countDistinct("l_orderkey").alias("items"), F.sum("quantity").cast("long").alias("quantity"))
    return counted(1).unionByName(counted(2)).unionByName(counted(3))


@query("snk1_resumed_items", "SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F'")
def snk1_resumed(t):
    rows = t.orders.select("o_orderkey", "o_orderstatus")
    return _corpus(t, rows.filter("o_orderstatus = 'F'"), ["o_orderkey"]).missing(rows).select("o_orderkey")


@query("snk2_decade_exports", "SELECT decade, count(*) AS n, sum(('0x' || sha256(item_id)[1:14])::HUGEINT)::VARCHAR AS digest FROM (SELECT item_id, coalesce((year // 10 * 10)::VARCHAR || 's', 'undated') AS decade FROM @items) GROUP BY decade")
def snk2(t):
    rows = t.items.select("item_id", F.coalesce(F.concat((F.floor(F.col("year") / 10) * 10).cast("string"), F.lit("s")), F.lit("undated")).alias("decade"))
    path = scratch(t.spark, "export")
    told = sinks.by_decade(rows, path)
    kept = t.spark.read.json(path).groupBy("decade").agg(F.count("*").alias("kept"))
    return told.join(kept, "decade").filter("n = kept").select("decade", "n", F.col("digest").cast("string").alias("digest"))


@query("snk3_count_reports", "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1")
def snk3(t):
    path = scratch(t.spark, "report")
    sinks.report(t.orders, "o_orderpriority", path)
    return t.spark.read.option("header", True).csv(path).select("o_orderpriority", F.col("n").cast("long").alias("n"))


def _sharded(t):
    """term, shard, df and shard, passages, tokens of documents by language."""
    from pressmark.operators.retrieval import frequencies_by

    held = t.documents.groupBy(F.col("lang").alias("shard")).agg(F.count("*").alias("passages"), F.sum(F.size(T.tokens("text"))).alias("tokens"))
    return frequencies_by(t.documents.withColumnRenamed("lang", "shard"), "doc_id", "text", "shard").select("term", "shard", "df"), held


@query("snk4_bucketed_index", "SELECT term, shard, df FROM @sharddf")
def snk4(t):
    path = scratch(t.spark, "buckets")
    df, held = _sharded(t)
    sinks.bucketed_index(df.filter("shard = 'en'"), 16, path, held.filter("shard = 'en'"))
    sinks.bucketed_index(df, 16, path, held)  # the pointer now names this one
    return sinks.read_index(t.spark, path)


@query("snk4_index_pointer", "SELECT count(*) AS terms, sum(('0x' || sha256(line)[1:14])::HUGEINT)::VARCHAR AS digest, any_value(n) AS passages, any_value(k)::BIGINT AS tokens FROM (SELECT term || chr(9) || string_agg(shard || ':' || df::VARCHAR, ',' ORDER BY shard) AS line FROM @sharddf GROUP BY term), (SELECT sum(passages) AS n, sum(tokens) AS k FROM @shards)")
def snk4_pointer(t):
    df, held = _sharded(t)
    said = sinks.bucketed_index(df, 16, scratch(t.spark, "buckets"), held)
    return t.spark.createDataFrame([(said["terms"], said["digest"], said["N"], said["tokens"])], "terms long, digest string, passages long, tokens long")


@query("snk5_vector_artifact", """SELECT count(*) AS rows, any_value(len(embedding))::INT AS dim, sum(('0x' || sha256(vec_id::VARCHAR || ':' || array_to_string(list_transform(embedding::DOUBLE[], lambda x: round(x * 1000000)::BIGINT::VARCHAR), ','))[1:14])::HUGEINT)::VARCHAR AS digest FROM embeddings""")
def snk5(t):
    return sinks.vectors(t.embeddings, "vec_id", "embedding", scratch(t.spark, "vectors"))


@query("snk6_object_store", "SELECT 'regions/' || r_regionkey::VARCHAR || '.txt' AS key, length(r_name)::BIGINT AS size, r_name AS body FROM region")
def snk6(t):
    store = sinks.Store(t.spark, scratch(t.spark, "store"))
    for r in t.region.collect():  # a few rows
        store.put(f"regions/{r['r_regionkey']}.txt", r["r_name"].encode())
    listed = store.list("regions").select("key")
    return store.get("regions/*.txt").join(listed, "key").select("key", "size", F.decode("content", "UTF-8").alias("body"))


@query("snk7_unit_share", "SELECT o_orderkey, place FROM (SELECT o_orderkey, o_orderstatus, row_number() OVER (ORDER BY o_orderkey) - 1 AS place FROM orders) WHERE place % 5 = 2 AND o_orderstatus <> 'F'")
def snk7(t):
    return flows.unit_share(t.orders, t.orders.filter("o_orderstatus = 'F'"), "o_orderkey", 2, 5).select("o_orderkey", F.col("place").cast("long").alias("place"))


def _manifest(t):
    path = scratch(t.spark, "sums")
    named = t.part.select(F.concat(F.lit("part/"), F.col("p_partkey").cast("string")).alias("name"), F.sha2("p_name", 256).alias("digest"))
    sinks.checksum_lines(named, "name", "digest").unionByName(t.region.select(F.concat(F.lit("# "), "r_name").alias("value"))).write.text(path)
    return sinks.read_checksums(t.spark.read.text(path))


@query("mx47_checksum_manifest", "SELECT 'part/' || p_partkey::VARCHAR AS name, sha256(p_name) AS digest FROM part")
def mx47(t):
    return _manifest(t)


@query("snk8_manifest_verified", "SELECT 'part/' || p_partkey::VARCHAR AS name, CASE WHEN p_partkey % 5 = 0 THEN 'missing' WHEN p_partkey % 7 = 0 THEN 'changed' ELSE 'done' END AS state FROM part")
def snk8(t):
    k = F.col("p_partkey")
    found = t.part.filter(k % 5 != 0).select(F.concat(F.lit("part/"), k.cast("string")).alias("name"), F.sha2(F.when(k % 7 == 0, F.concat("p_name", F.lit("!"))).otherwise(F.col("p_name")), 256).alias("actual"))
    return K.manifest(_manifest(t), found, "name", "digest", "actual")
