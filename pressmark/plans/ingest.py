"""Queries on reading, normalising, checking and registering."""

from __future__ import annotations

from pyspark.sql import functions as F

from pressmark.functions import ingest as I
from pressmark.functions import periods as P
from pressmark.functions import text as T
from pressmark.operators import packing as K
from pressmark.operators.ordering import numbered
from pressmark.plans.registry import part, query
from pressmark.plans.retrieval import STOP

TOK = "regexp_extract_all(lower(coalesce({0}, '')), '[\\p{{L}}\\p{{N}}]+')"
part("said", """said AS (SELECT o_orderkey AS k, CASE o_orderkey % 9 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN '197-' WHEN 3 THEN 'c' || (1900 + o_orderkey % 120)::VARCHAR WHEN 4 THEN (1950 + o_orderkey % 50)::VARCHAR || '-' || (1951 + o_orderkey % 50)::VARCHAR
 WHEN 5 THEN '3050' WHEN 6 THEN 'undated' WHEN 7 THEN (1990 + o_orderkey % 30)::VARCHAR || '-01-01T00:00:00Z' ELSE '19--' END AS raw FROM orders)""")


def _said(t):
    k = F.col("o_orderkey")
    y = lambda a, m: (F.lit(a) + k % m).cast("string")
    raw = F.when(k % 9 == 1, "").when(k % 9 == 2, "197-").when(k % 9 == 3, F.concat(F.lit("c"), y(1900, 120))).when(k % 9 == 4, F.concat(y(1950, 50), F.lit("-"), y(1951, 50)))
    raw = raw.when(k % 9 == 5, "3050").when(k % 9 == 6, "undated").when(k % 9 == 7, F.concat(y(1990, 30), F.lit("-01-01T00:00:00Z"))).when(k % 9 == 8, "19--")
    return t.orders.select(k.alias("k"), raw.alias("raw"))


@query("sc12_parse_date", """SELECT k, CASE WHEN y BETWEEN 1850 AND 2025 THEN y END AS year, CASE WHEN s = '' THEN 'unknown' WHEN regexp_full_match(s, '\\d{1,3}[-?]{1,3}') THEN 'partial' WHEN y BETWEEN 1850 AND 2025 AND ranged THEN 'range' WHEN y BETWEEN 1850 AND 2025 THEN 'exact' ELSE 'unknown' END AS method FROM (
 SELECT k, s, ranged, CASE WHEN regexp_full_match(s, '\\d{1,3}[-?]{1,3}') THEN NULL WHEN ranged THEN list_min(f) ELSE f[1] END AS y FROM (SELECT k, trim(coalesce(raw, '')) AS s, regexp_matches(coalesce(raw, ''), '\\d{4}\\s*[-/]\\s*\\d{4}') AS ranged, list_transform(regexp_extract_all(coalesce(raw, ''), '\\d{4}'), lambda x: x::INT) AS f FROM @said))""")
def sc12(t):
    d = P.parse_date(F.col("raw"))
    return _said(t).select("k", d["year"].alias("year"), d["method"].alias("method"))


@query("sc17_decade_label", "SELECT item_id, (year // 10 * 10)::VARCHAR || 's' AS decade FROM @items")
def sc17(t):
    return t.items.select("item_id", P.decade(F.col("year")).alias("decade"))


@query("sc13_title_year", """SELECT event_id, coalesce(CASE WHEN f BETWEEN 1850 AND 2025 THEN f END, CASE WHEN e BETWEEN 1850 AND 2025 THEN e END, CASE WHEN len(d) = 1 THEN d[1] END) AS year FROM (SELECT event_id, nullif(regexp_extract(x, '\\b(1[89]\\d\\d|20[0-2]\\d)-\\d\\d\\b', 1), '')::INT AS f,
 nullif(regexp_extract(x, '(?i)year end\\w*[^0-9]{0,40}(1[89]\\d\\d|20[0-2]\\d)', 1), '')::INT AS e, list_distinct(list_filter(list_transform(regexp_extract_all(x, '\\b(1[89]\\d\\d|20[0-2]\\d)\\b', 1), lambda v: v::INT), lambda v: v BETWEEN 1850 AND 2025)) AS d FROM (
 SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'Report 19' || (60 + event_id % 30)::VARCHAR || '-61' WHEN 1 THEN 'for the Year ended March 31, ' || (1950 + event_id % 60)::VARCHAR WHEN 2 THEN 'In ' || (1800 + event_id % 100)::VARCHAR || ' and 1999' WHEN 3 THEN 'Volume ' || (1900 + event_id % 90)::VARCHAR ELSE 'none' END AS x FROM events))""")
def sc13(t):
    e = F.col("event_id")
    y = lambda a, m: (F.lit(a) + e % m).cast("string")
    x = F.when(e % 5 == 0, F.concat(F.lit("Report 19"), y(60, 30), F.lit("-61"))).when(e % 5 == 1, F.concat(F.lit("for the Year ended March 31, "), y(1950, 60)))
    x = x.when(e % 5 == 2, F.concat(F.lit("In "), y(1800, 100), F.lit(" and 1999"))).when(e % 5 == 3, F.concat(F.lit("Volume "), y(1900, 90))).otherwise("none")
    return t.events.select("event_id", P.title_year(x).alias("year"))


@query("sc15_fiscal_close", "SELECT s, e, CASE WHEN c - s BETWEEN 1 AND 1 THEN c END AS close FROM (SELECT s, e, CASE WHEN e >= 100 THEN e WHEN s // 100 * 100 + e < s THEN s // 100 * 100 + e + 100 ELSE s // 100 * 100 + e END AS c FROM (SELECT DISTINCT 1950 + p_size AS s, CASE WHEN p_partkey % 2 = 0 THEN (51 + p_size) % 100 ELSE 1951 + p_size END AS e FROM part))")
def sc15(t):
    s, e = F.col("p_size") + 1950, F.when(F.col("p_partkey") % 2 == 0, (F.col("p_size") + 51) % 100).otherwise(F.col("p_size") + 1951)
    rows = t.part.select(s.alias("s"), e.alias("e")).distinct()
    return rows.select("s", "e", P.fiscal_close(F.col("s"), F.col("e")).alias("close"))


@query("sc16_year_mode", "SELECT jurisdiction, year FROM (SELECT jurisdiction, year, row_number() OVER (PARTITION BY jurisdiction ORDER BY count(*) DESC, year DESC) AS r FROM @items WHERE dated = 1 GROUP BY 1, 2) WHERE r = 1")
def sc16(t):
    n = t.items.filter("dated = 1").groupBy("jurisdiction", "year").agg(F.count("*").alias("n"))
    return n.groupBy("jurisdiction").agg(F.max(F.struct("n", "year")).alias("m")).select("jurisdiction", "m.year")


@query("sc1_terms", f"SELECT item_id, list_filter({TOK.format('text')}, lambda w: w NOT IN {STOP}) AS terms FROM benchmark")
def sc1(t):
    return t.benchmark.select("item_id", T.terms("text").alias("terms"))


@query("sc3_salient_terms", f"SELECT item_id, list_sort(list_distinct(list_filter({TOK.format('text')}, lambda w: w NOT IN {STOP} AND (length(w) >= 3 OR regexp_full_match(w, '[0-9]{{4}}'))))) AS terms FROM benchmark")
def sc3(t):
    return t.benchmark.select("item_id", F.array_sort(T.salient_terms("text")).alias("terms"))


@query("sc4_stem", f"SELECT DISTINCT w, CASE WHEN length(w) > 3 AND ends_with(w, 's') THEN left(w, length(w) - 1) ELSE w END AS stem FROM (SELECT unnest({TOK.format('text')}) AS w FROM benchmark)")
def sc4(t):
    return t.benchmark.select(F.explode(T.tokens("text")).alias("w")).distinct().select("w", T.stem(F.col("w")).alias("stem"))


@query("sc5_uncovered_terms", f"""WITH d AS (SELECT DISTINCT CASE WHEN length(w) > 3 AND ends_with(w, 's') THEN left(w, length(w) - 1) ELSE w END AS s FROM (SELECT unnest({TOK.format('text')}) AS w FROM documents WHERE lang = 'en')),
 q AS (SELECT DISTINCT item_id, w, CASE WHEN length(w) > 3 AND ends_with(w, 's') THEN left(w, length(w) - 1) ELSE w END AS s FROM (SELECT item_id, unnest({TOK.format('text')}) AS w FROM benchmark) WHERE w NOT IN {STOP} AND length(w) >= 3)
 SELECT item_id, w AS term FROM q WHERE s NOT IN (SELECT s FROM d) AND NOT (length(s) >= 5 AND left(s, 5) IN (SELECT left(s, 5) FROM d WHERE length(s) >= 5))""")
def sc5(t):
    stems = t.documents.filter("lang = 'en'").select(F.explode(F.array_distinct(T.tokens("text"))).alias("w")).select(T.stem(F.col("w")).alias("s")).distinct()
    q = t.benchmark.select("item_id", F.explode(T.salient_terms("text")).alias("term")).filter(F.char_length("term") >= 3).withColumn("s", T.stem(F.col("term"))).withColumn("p", F.when(F.char_length("s") >= 5, F.substring("s", 1, 5)))
    prefixes = stems.filter(F.char_length("s") >= 5).select(F.substring("s", 1, 5).alias("p")).distinct()
    return q.join(stems, "s", "left_anti").join(prefixes, "p", "left_anti").select("item_id", "term")


@query("sc27_squash", f"SELECT item_id, array_to_string({TOK.format('text')}, ' ') AS words FROM benchmark")
def sc27(t):
    return t.benchmark.select("item_id", T.squash("text").alias("words"))


@query("sc36_french_like", f"SELECT doc_id FROM documents WHERE regexp_matches(coalesce(text, ''), '[éèêàçùôîâ]') AND len(list_filter({TOK.format('text')}, lambda w: w IN ('le', 'la', 'les', 'des', 'du', 'et', 'est', 'dans', 'pour', 'une', 'que', 'qui', 'sur', 'avec'))) >= 2")
def sc36(t):
    return t.documents.filter(T.french_like("text")).select("doc_id")


@query("sc49_key_terms", f"SELECT item_id, list_transform(list_sort(list_transform(list_distinct(list_filter({TOK.format('text')}, lambda w: w NOT IN {STOP})), lambda w: struct_pack(n := -length(w), w := w))), lambda s: s.w)[1:3] AS terms FROM benchmark")
def sc49(t):
    return t.benchmark.select("item_id", T.key_terms("text", 3).alias("terms"))


@query("sc21_smart_title", """SELECT p_partkey, array_to_string(list_transform(string_split(p_type || ' OF THE ' || p_name, ' '), lambda w, i: CASE WHEN i > 1 AND lower(w) IN ('of', 'the', 'and', 'for', 'in', 'on', 'de', 'du', 'des', 'et', 'la', 'le') THEN lower(w) ELSE upper(left(w, 1)) || lower(substr(w, 2)) END), ' ') AS title FROM part""")
def sc21(t):
    return t.part.select("p_partkey", T.smart_title(F.concat("p_type", F.lit(" OF THE "), "p_name")).alias("title"))


@query("sc18_decode_list", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_brand || '; ' || p_type ELSE p_name END AS value FROM part")
def sc18(t):
    raw = F.when(F.col("p_partkey") % 2 == 0, F.to_json(F.array("p_brand", "p_type"))).otherwise(F.col("p_name"))
    return t.part.select("p_partkey", I.decoded(raw).alias("value"))


@query("sc19_jurisdiction", """SELECT p_partkey, CASE WHEN c <> p THEN 'unknown' ELSE coalesce(c, p, k, 'unknown') END AS value, CASE WHEN c <> p THEN 'unknown' WHEN c IS NOT NULL THEN 'creator' WHEN p IS NOT NULL THEN 'publisher' WHEN k IS NOT NULL THEN 'collection' ELSE 'unknown' END AS method
 FROM (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'federal' END AS c, CASE WHEN p_partkey % 4 = 0 THEN 'ontario' WHEN p_partkey % 5 = 0 THEN 'federal' END AS p, CASE WHEN p_partkey % 7 = 0 THEN 'alberta' END AS k FROM part)""")
def sc19(t):
    k = F.col("p_partkey")
    j = I.jurisdiction(F.when(k % 3 == 0, "federal"), F.when(k % 4 == 0, "ontario").when(k % 5 == 0, "federal"), F.when(k % 7 == 0, "alberta"), F.lit(None).cast("string"))
    return t.part.select("p_partkey", j["value"].alias("value"), j["method"].alias("method"))


@query("sc24_doc_type", "SELECT p_partkey, CASE WHEN contains(lower(p_type), 'promo') THEN 'sale' WHEN contains(lower(p_name), 'part') THEN 'part' ELSE 'other' END AS value, CASE WHEN contains(lower(p_type), 'promo') THEN 'title' WHEN contains(lower(p_name), 'part') THEN 'creator' ELSE 'default' END AS method FROM part")
def sc24(t):
    d = I.doc_type(F.col("p_type"), F.col("p_name"), [("promo", "sale"), ("part", "part")])
    return t.part.select("p_partkey", d["value"].alias("value"), d["method"].alias("method"))


@query("sc20_clean_issuer", r"SELECT p_partkey, upper(name[1]) || lower(name[2:]) AS issuer FROM (SELECT p_partkey, regexp_extract(raw, ': \[([^\]]+)\]', 1) AS name FROM (SELECT p_partkey, 'Ottawa : [' || upper(p_brand) || '] issuing body. = Other; more' AS raw FROM part))")
def sc20(t):
    raw = F.concat(F.lit("Ottawa : ["), F.upper("p_brand"), F.lit("] issuing body. = Other; more"))
    return t.part.select("p_partkey", I.clean_issuer(raw).alias("issuer"))


@query("sc23_normal_issuer", "SELECT p_partkey, CASE WHEN contains(lower(p_brand), 'brand#1') THEN 'Brand One' WHEN contains(lower(p_brand), 'brand') THEN 'Brands' ELSE p_brand END AS value, CASE WHEN contains(lower(p_brand), 'brand') THEN 'alias' ELSE 'unmapped' END AS method FROM part")
def sc23(t):
    n = I.normal_issuer(F.lit("The Department"), F.col("p_brand"), [("brand#1", "Brand One"), ("brand", "Brands")])
    return t.part.select("p_partkey", n["value"].alias("value"), n["method"].alias("method"))


@query("sc14_derived_year", "SELECT item_id, 1987 AS year, 'copyright' AS method FROM benchmark")
def sc14(t):
    d = I.derived_year(F.concat("text", F.lit(" (c) 1987. Ottawa, March 3, 1990")), F.lit("Report"))
    return t.benchmark.select("item_id", d["year"].alias("year"), d["method"].alias("method"))


@query("sc8_ocr_quality", """SELECT doc_id, CASE WHEN solid = 0 THEN 0.0 ELSE round(least(1.0, greatest(0.0, 0.15 * letters / solid + 0.25 * nw / nt + 0.40 * least(1.0, 3.0 * CASE WHEN nw > 0 THEN nc / nw ELSE 0 END) + 0.10 * (1 - noisy / nl) + 0.10 * CASE WHEN solid / nt BETWEEN 2.5 AND 12.0 THEN 1.0 ELSE greatest(0.0, 1 - abs(solid / nt - 6) / 10) END)), 4) END AS quality FROM (
 SELECT doc_id, length(regexp_replace(text, '\\s+', '', 'g'))::DOUBLE AS solid, length(regexp_replace(text, '[^\\p{L}\\p{N}]+', '', 'g'))::DOUBLE AS letters, len(regexp_extract_all(text, '[A-Za-zÀ-ſ][A-Za-zÀ-ſ''\\-]{1,}'))::DOUBLE AS nw, len(regexp_extract_all(text, '\\S+'))::DOUBLE AS nt,
 len(list_filter(regexp_extract_all(text, '[A-Za-zÀ-ſ][A-Za-zÀ-ſ''\\-]{1,}'), lambda w: lower(w) IN (""" + ", ".join(f"'{w}'" for w in I.COMMON_WORDS) + """)))::DOUBLE AS nc, len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> ''))::DOUBLE AS nl,
 len(list_filter(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> ''), lambda x: length(regexp_replace(x, '[^\\p{L}\\p{N}]+', '', 'g')) < 0.5 * length(regexp_replace(x, '\\s+', '', 'g'))))::DOUBLE AS noisy FROM documents WHERE text IS NOT NULL) UNION ALL SELECT doc_id, 0.0 FROM documents WHERE text IS NULL""")
def sc8(t):
    return t.documents.select("doc_id", I.ocr_quality("text").alias("quality"))


@query("sc9_sc10_sections", None)
def sc10(t):
    # leaves of a source in order of their id; texts are scanned where they lie
    docs = t.documents
    leaves = numbered(docs.select("source", "doc_id"), ["source", "doc_id"], "leaf", by="source")
    sizes = docs.groupBy("source").agg(F.count("*").alias("n"))
    places = leaves.join(sizes, leaves["source"].eqNullSafe(sizes["source"])).select("doc_id", "leaf", "n")
    s = I.section(F.col("leaf"), F.col("n"), F.col("s"))
    return docs.select("doc_id", I.signals("text").alias("s")).join(places, "doc_id").select("doc_id", s["section"].alias("section"), s["rule"].alias("rule"))


@query("src7_form_feed_pages", "SELECT k, i - 1 AS leaf, p AS text, length(p) AS char_count, trim(p) <> '' AS has_text FROM (SELECT k, unnest(ps) AS p, generate_subscripts(ps, 1) AS i FROM (SELECT p_partkey AS k, string_split(p_name || chr(12) || p_type || chr(12), chr(12)) AS ps FROM part))")
def src7(t):
    whole = F.concat("p_name", F.lit("\f"), "p_type", F.lit("\f"))
    return t.part.select(F.col("p_partkey").alias("k"), F.posexplode(I.pages(whole)).alias("leaf", "text")).select("k", "leaf", "text", F.char_length("text").alias("char_count"), (F.trim("text") != "").alias("has_text"))


@query("src16_source_waterfall", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey::VARCHAR || '_djvu.txt' WHEN o_orderkey % 3 = 0 THEN o_orderkey::VARCHAR || '_djvu.xml' WHEN o_orderkey % 2 = 0 THEN o_orderkey::VARCHAR || '_hocr.html' END AS source FROM orders")
def src16(t):
    from pressmark.sources.readers import chosen_source

    k = F.col("o_orderkey")
    ends = ((k % 2 == 0, "_hocr.html"), (k % 3 == 0, "_djvu.xml"), (k % 5 == 0, ".pdf"), (k % 4 == 0, "_djvu.txt"))
    files = F.array_compact(F.array(*[F.when(has, F.struct(F.concat(k.cast("string"), F.lit(end)).alias("name"))) for has, end in ends]))
    return t.orders.select("o_orderkey", chosen_source(files)["name"].alias("source"))


@query("sc28_quote_check", f"SELECT item_id, substr(text, 1, 30) AS quote, true AS on_page FROM benchmark WHERE len({TOK.format('substr(text, 1, 30)')}) >= 3")
def sc28(t):
    sentence = F.concat(F.lit('It says "'), F.substring("text", 1, 30), F.lit('" and "two words" here.'))
    return t.benchmark.select("item_id", F.explode(I.quotes_on_page(sentence, "text")).alias("q")).select("item_id", F.col("q.text").alias("quote"), F.col("q.on_page").alias("on_page"))


@query("sc30_sc31_citation_verdict", """SELECT l_orderkey, CASE WHEN NOT bool_and(o_orderkey IS NOT NULL AND l_quantity > 2) THEN 'fail' WHEN bool_or(r = false) THEN 'fail' WHEN bool_or(r IS NULL) THEN 'unrecorded' ELSE 'pass' END AS verdict FROM (SELECT l_orderkey, l_quantity, o_orderkey, CASE WHEN l_linenumber = 1 THEN NULL ELSE l_discount < 0.09 END AS r FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey) GROUP BY l_orderkey""")
def sc31(t):
    rows = t.lineitem.join(t.orders.select("o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"), "left")
    retrieved = F.when(F.col("l_linenumber") != 1, F.col("l_discount") < 0.09)
    return rows.groupBy("l_orderkey").agg(I.verdict(F.col("o_orderkey").isNotNull(), F.col("l_quantity") > 2, F.lit(True), retrieved).alias("verdict"))


@query("sc32_page_link", "SELECT item_id, leaf, 'https://library.example/' || item_id || '/page/n' || leaf::VARCHAR AS link FROM @leaves")
def sc32(t):
    return t.leaves.select("item_id", "leaf", I.page_link("https://library.example", F.col("item_id"), F.col("leaf")).alias("link"))


@query("sc33_levenshtein", "SELECT p_partkey, levenshtein(p_name, p_type) AS distance, round(levenshtein(p_name, p_type) / greatest(length(p_type), 1), 6) AS cer FROM part")
def sc33(t):
    d = F.levenshtein("p_name", "p_type")
    return t.part.select("p_partkey", d.alias("distance"), F.round(d / F.greatest(F.char_length("p_type"), F.lit(1)), 6).alias("cer"))


@query("sc35_lexicon_rate", f"""WITH lex AS (SELECT w FROM (SELECT unnest({TOK.format('text')}) AS w FROM benchmark) GROUP BY w HAVING count(*) >= 3) SELECT doc_id, round(avg(CASE WHEN lex.w IS NOT NULL THEN 1 ELSE 0 END), 6) AS rate FROM (SELECT doc_id, unnest({TOK.format('text')}) AS w FROM documents) d LEFT JOIN lex USING (w) GROUP BY doc_id""")
def sc35(t):
    lexicon = t.benchmark.select(F.explode(T.tokens("text")).alias("w")).groupBy("w").agg(F.count("*").alias("n")).filter("n >= 3").select("w", F.lit(1).alias("hit"))
    # words meet the lexicon where they lie, and a task adds up those of its own documents
    words = t.documents.select("doc_id", F.explode(T.tokens("text")).alias("w"))
    return words.join(lexicon, "w", "left").groupBy("doc_id").agg(F.round(F.count("hit") / F.count("*"), 6).alias("rate"))


@query("sc41_rights_status", "SELECT item_id, CASE WHEN collection <> 'ASIA' OR year IS NULL THEN 'UNKNOWN' WHEN year <= 2048 - 51 THEN 'PD_CA_CROWN' ELSE 'CROWN_IN_COPYRIGHT' END AS status FROM @items")
def sc41(t):
    kind = F.when(F.col("collection") == "ASIA", "federal").otherwise("other")
    return t.items.select("item_id", I.rights(kind, F.col("year"), F.lit(True), 2048).alias("status"))


@query("sc42_overclaims", "SELECT item_id, ['changed', 'led to'] AS claims FROM benchmark")
def sc42(t):
    return t.benchmark.select("item_id", I.overclaims(F.concat("text", F.lit(" It changed. It never changed. That led to growth."))).alias("claims"))


@query("sc45_fingerprint", f"SELECT item_id, sha256(array_to_string({TOK.format('text')}, ' ')) AS fingerprint FROM benchmark")
def sc45(t):
    return t.benchmark.select("item_id", F.sha2(T.squash("text"), 256).alias("fingerprint"))


@query("sc46_on_page", f"SELECT doc_id FROM documents WHERE contains(' ' || array_to_string({TOK.format('text')}, ' ') || ' ', ' is in ')")
def sc46(t):
    return t.documents.filter(T.on_page(F.lit("Is, in!"), "text")).select("doc_id")


@query("sc52_cell_state", "SELECT p_partkey, CASE WHEN p_size > 40 THEN 'recorded' WHEN p_size % 3 = 0 THEN 'unknown' WHEN p_size % 3 = 1 THEN 'not_indexed' ELSE 'quiet_examined' END AS state FROM part")
def sc52(t):
    s = F.col("p_size")
    return t.part.select("p_partkey", I.cell_state(F.when(s % 3 == 1, 5).when(s % 3 == 2, 0), F.when(s > 40, 1).otherwise(0)).alias("state"))


@query("sc53_dial_states", "SELECT y AS year, CASE WHEN y NOT BETWEEN 1996 AND 2000 THEN 'not_indexed' WHEN n > 0 THEN 'recorded' ELSE 'quiet' END AS state, CASE WHEN y BETWEEN 1996 AND 2000 THEN n END AS items FROM (SELECT y, count(item_id) AS n FROM (SELECT unnest(generate_series(1994, 2003))::INT AS y) LEFT JOIN @items ON year = y AND issuer = 'BUILDING' GROUP BY y)")
def sc53(t):
    from pressmark.operators.cubes import year_counts

    n = year_counts(t.items.filter("issuer = 'BUILDING'"), 1994, 2003)
    state = I.dial_state(F.col("year"), F.col("n"), 1996, 2000)
    return n.select("year", state.alias("state"), F.when(F.col("year").between(1996, 2000), F.col("n")).alias("items"))


@query("sc54_token_cost", "SELECT o_orderkey, round(o_totalprice / 1e6 * p + o_orderkey / 1e6 * q, 6) AS cost FROM orders JOIN (VALUES ('F', 3.0, 15.0), ('O', 0.5, 2.5)) v(s, p, q) ON s = o_orderstatus")
def sc54(t):
    prices = t.spark.createDataFrame([("F", 3.0, 15.0), ("O", 0.5, 2.5)], "o_orderstatus string, p double, q double")
    return t.orders.join(F.broadcast(prices), "o_orderstatus").select("o_orderkey", F.round(F.col("o_totalprice") / 1e6 * F.col("p") + F.col("o_orderkey") / 1e6 * F.col("q"), 6).alias("cost"))


@query("mx87_numbers", "SELECT event_id, list_sort(list_distinct(list_transform(regexp_extract_all(x, '\\d[\\d,]*\\d'), lambda n: replace(n, ',', '')))) AS numbers FROM (SELECT event_id, props || ' of 1,' || (100 + event_id % 900)::VARCHAR || ' and 7' AS x FROM events)")
def mx87(t):
    x = F.concat("props", F.lit(" of 1,"), (F.col("event_id") % 900 + 100).cast("string"), F.lit(" and 7"))
    return t.events.select("event_id", F.array_sort(T.numbers(x)).alias("numbers"))


@query("mx101_clean_question", "SELECT item_id, substr(trim(regexp_replace(text, '[\\x00-\\x20\\x7F]+', ' ', 'g')), 1, 60) AS question FROM benchmark")
def mx101(t):
    return t.benchmark.select("item_id", T.clean_question("text", 60).alias("question"))


@query("mx12_register_digest", """WITH lines AS (SELECT o_orderkey // 1000 AS chunk, '{"o_orderkey":' || o_orderkey::VARCHAR || ',"o_orderstatus":"' || o_orderstatus || '","n":' || count(*)::VARCHAR || '}' AS x FROM orders GROUP BY o_orderkey, o_orderstatus),
 low AS (SELECT chunk // 1000 AS chunk, chunk::VARCHAR || ' ' || sha256(string_agg(x, ',' ORDER BY x)) AS x FROM lines GROUP BY lines.chunk),
 high AS (SELECT chunk::VARCHAR || ' ' || sha256(string_agg(x, ',' ORDER BY x)) AS x FROM low GROUP BY low.chunk)
 SELECT sha256(string_agg(x, ',' ORDER BY x)) AS digest FROM high""")
def mx12(t):
    # equal rows are one row with its count, then a thousand keys are one row, and a thousand of those: no task holds the register
    rows = t.orders.groupBy("o_orderkey", "o_orderstatus").agg(F.count("*").alias("n"))
    joined = lambda x: F.sha2(F.array_join(F.sort_array(F.collect_list(x)), ","), 256).alias("x")
    lines = rows.select(F.floor(F.col("o_orderkey") / 1000).alias("chunk"), F.to_json(F.struct("o_orderkey", "o_orderstatus", "n")).alias("x"))
    for _ in range(2):
        lines = lines.groupBy("chunk").agg(joined("x")).select(F.floor(F.col("chunk") / 1000).alias("chunk"), F.concat_ws(" ", F.col("chunk").cast("string"), "x").alias("x"))
    return lines.agg(joined("x").alias("digest"))


@query("mx14_membership", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 1")
def mx14(t):
    return t.orders.groupBy("o_custkey").agg(F.count("*").alias("n")).filter("n > 1")


@query("mx15_small_place_pooling", "SELECT CASE WHEN sum(total) OVER (PARTITION BY jurisdiction) < 5000000 THEN 'other' ELSE jurisdiction END AS place, jurisdiction FROM (SELECT jurisdiction, sum(amount) AS total FROM @items GROUP BY 1)")
def mx15(t):
    totals = t.items.groupBy("jurisdiction").agg(F.sum("amount").alias("total"))
    return totals.select(F.when(F.col("total") < 5000000, "other").otherwise(F.col("jurisdiction")).alias("place"), "jurisdiction")


@query("mx22_page_reassembly", "SELECT l_orderkey, string_agg(l_linenumber::VARCHAR || l_returnflag, ' ' ORDER BY l_linenumber, l_returnflag, l_partkey) AS text FROM lineitem GROUP BY 1")
def mx22(t):
    parts = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_returnflag", "l_partkey")))
    return t.lineitem.groupBy("l_orderkey").agg(F.array_join(F.transform(parts, lambda p: F.concat(p["l_linenumber"].cast("string"), p["l_returnflag"])), " ").alias("text"))


@query("mx45_page_proof", f"""SELECT a.doc_id, round(len(list_intersect(list_distinct(a.ts), list_distinct(b.ts))) / greatest(1, len(list_distinct(list_concat(a.ts, b.ts)))), 6) AS jaccard FROM (SELECT doc_id, {TOK.format('text')} AS ts FROM documents) a JOIN (SELECT doc_id - 1 AS doc_id, {TOK.format('text')} AS ts FROM documents) b USING (doc_id)""")
def mx45(t):
    a, b = t.documents.select("doc_id", T.tokens("text").alias("x")), t.documents.select((F.col("doc_id") - 1).alias("doc_id"), T.tokens("text").alias("y"))
    j = F.size(F.array_intersect("x", "y")) / F.greatest(F.lit(1), F.size(F.array_union("x", "y")))
    return a.join(b, "doc_id").select("doc_id", F.round(j, 6).alias("jaccard"))


@query("mx51_overlap_removal", """SELECT k, sum(greatest(0, e - greatest(s, coalesce(c, 0))))::BIGINT AS covered FROM (SELECT o_custkey AS k, o_orderkey % 50 AS s, o_orderkey % 50 + 20 AS e, max(o_orderkey % 50 + 20) OVER (PARTITION BY o_custkey ORDER BY o_orderkey % 50, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS c FROM orders) GROUP BY k""")
def mx51(t):
    spans = t.orders.select(F.col("o_custkey").alias("k"), (F.col("o_orderkey") % 50).alias("s"), (F.col("o_orderkey") % 50 + 20).alias("e"), "o_orderkey")
    return K.uncovered(spans, "k", "s", "e", "o_orderkey").groupBy("k").agg(F.sum("fresh").alias("covered"))


@query("mx52_first_record", "SELECT c_mktsegment, c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_custkey) AS r FROM customer) WHERE r = 1")
def mx52(t):
    from pressmark.operators.upserts import latest

    return latest(t.customer, ["c_mktsegment"], [F.col("c_acctbal"), F.col("c_custkey")]).select("c_mktsegment", "c_custkey")


@query("mx4_release_gates", """SELECT gate, failing FROM (SELECT 'orphan_lines' AS gate, (SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)) AS failing UNION ALL SELECT 'negative_price', (SELECT count(*) FROM orders WHERE o_totalprice < 0) UNION ALL SELECT 'repeated_key', (SELECT count(*) FROM (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) > 1)))""")
def mx4(t):
    gates = {
        "orphan_lines": t.lineitem.join(t.orders.select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_anti"),
        "negative_price": t.orders.filter("o_totalprice < 0"),
        "repeated_key": t.orders.groupBy("o_orderkey").agg(F.count("*").alias("n")).filter("n > 1"),
    }
    return K.gates(gates)


@query("mx9_record_problems", "SELECT c_custkey, list_filter([CASE WHEN c_acctbal < 0 THEN 'negative balance' END, CASE WHEN c_nationkey > 20 THEN 'far place' END], lambda x: x IS NOT NULL) AS problems FROM customer")
def mx9(t):
    return t.customer.select("c_custkey", K.problems({"negative balance": F.col("c_acctbal") < 0, "far place": F.col("c_nationkey") > 20}).alias("problems"))


@query("mx106_unit_manifest", "SELECT o_orderkey, CASE WHEN l IS NULL THEN 'missing' WHEN l <> o_orderkey % 7 THEN 'changed' ELSE 'done' END AS state FROM orders LEFT JOIN (SELECT l_orderkey, min(l_linenumber) AS l FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
def mx106(t):
    wanted = t.orders.select(F.col("o_orderkey"), (F.col("o_orderkey") % 7).alias("sum"))
    found = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_linenumber").alias("found"))
    return K.manifest(wanted, found, "o_orderkey", "sum", "found")


@query("wn9_sequential_packing", """SELECT item_id, shard, shard_id, split_year FROM (WITH RECURSIVE pooled AS (SELECT item_id, CASE WHEN sum(amount / 1000) OVER (PARTITION BY jurisdiction) < 5000 THEN 'other' ELSE jurisdiction END AS place, year, round(amount / 1000 * 1000000)::BIGINT AS size FROM @items),
 d AS (SELECT *, row_number() OVER (PARTITION BY place, year IS NULL ORDER BY year, item_id) AS n FROM pooled),
 f AS (SELECT place, year IS NULL AS undated, n, size AS filled, 1 AS bin FROM d WHERE n = 1
  UNION ALL SELECT d.place, f.undated, d.n, CASE WHEN f.filled + d.size > 2000000000 THEN d.size ELSE f.filled + d.size END, f.bin + (f.filled + d.size > 2000000000)::INT FROM f JOIN d ON d.place = f.place AND (d.year IS NULL) = f.undated AND d.n = f.n + 1),
 b AS (SELECT place, undated, bin, min(year) AS y1, max(year) AS y2 FROM f JOIN d USING (place, n) WHERE (d.year IS NULL) = undated GROUP BY ALL),
 c AS (SELECT *, place || '-' || coalesce(y1::VARCHAR, 'undated') AS base, place || '-' || coalesce(y1::VARCHAR || '-' || y2::VARCHAR, 'undated') AS base_id, coalesce(y1 = lag(y2) OVER w, false) OR coalesce(y2 = lead(y1) OVER w, false) AS split_year FROM b WINDOW w AS (PARTITION BY place, undated ORDER BY bin)),
 e AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY undated, bin) AS k, row_number() OVER (PARTITION BY base_id ORDER BY undated, bin) AS k_id FROM c)
 SELECT item_id, base || CASE WHEN k > 1 THEN '-' || k::VARCHAR ELSE '' END AS shard, base_id || CASE WHEN k_id > 1 THEN '-' || k_id::VARCHAR ELSE '' END AS shard_id, split_year
 FROM f JOIN d ON d.place = f.place AND d.n = f.n AND (d.year IS NULL) = f.undated JOIN e ON e.place = f.place AND e.undated = f.undated AND e.bin = f.bin)""")
def wn9(t):
    docs = t.items.select("item_id", F.col("jurisdiction").alias("place"), "year", (F.col("amount") / 1000).alias("size"))
    return K.plan_shards(docs, 2000.0, 5000.0).select("item_id", "shard", "shard_id", "split_year")


@query("mx90_allowed_years", "SELECT jurisdiction, list_sort(list(DISTINCT year)) AS years FROM @items WHERE year IS NOT NULL GROUP BY 1")
def mx90(t):
    return t.items.groupBy("jurisdiction").agg(F.sort_array(F.collect_set("year")).alias("years"))


@query("mx59_item_year", "SELECT k, coalesce(TRY_CAST(CASE WHEN regexp_matches(coalesce(raw, ''), '^\\d{4}') THEN left(raw, 4) END AS INT), NULL) AS year FROM @said")
def mx59(t):
    return _said(t).select("k", F.when(F.coalesce("raw", F.lit("")).rlike(r"^\d{4}"), F.substring("raw", 1, 4)).try_cast("int").alias("year"))


@query("mx104_capture_date", "SELECT event_id, strptime(left(s, 8), '%Y%m%d')::DATE AS day FROM (SELECT event_id, strftime(ts, '%Y%m%d%H%M%S') AS s FROM events)")
def mx104(t):
    stamp = F.date_format("ts", "yyyyMMddHHmmss")
    return t.events.select("event_id", F.to_date(F.substring(stamp, 1, 8), "yyyyMMdd").alias("day"))
