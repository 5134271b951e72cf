"""Building a corpus: leaves and pages, passages, item checks, normalising, registering.

Defined cases: a null text is one empty page and has no passages; an item without a page map
keeps its pages without labels; a page count that differs from what was expected is flagged,
never repaired; ids are taken over as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressmark.functions import ingest, periods, text

#: A token with the white space before it.
_PIECE = r"[\x09-\x0D\x20]*[^\x09-\x0D\x20]+"


def shown_leaves(numbers: DataFrame, key: str, leaves: str) -> DataFrame:
    """key, scanned, leaf: the viewer's leaf of each scanned one, its place in the list. leaves: array<int>."""
    return numbers.select(key, F.posexplode(leaves).alias("leaf", "scanned")).select(key, "scanned", "leaf")


def passages(pages: DataFrame, key: str, column: str, width: int = 300, overlap: int = 40) -> DataFrame:
    """Windows of ``width`` tokens with an overlap: passage_id (key:j), key, char_start, char_end, text, token_count."""
    cut = pages.select(key, F.coalesce(column, F.lit("")).alias("t")).select(key, "t", F.regexp_extract_all("t", F.lit(_PIECE), F.lit(0)).alias("pieces"))
    spread = cut.withColumn("n", F.size("pieces")).select(key, "t", "pieces", "n", F.posexplode(text.windows(F.col("n"), width, overlap)).alias("j", "s"))
    length = lambda a, b: F.char_length(F.array_join(F.slice("pieces", a, b), ""))
    end = F.least(F.col("n"), F.col("s") + width)
    first = F.get("pieces", F.col("s"))
    placed = spread.withColumn("e", end).withColumn("before", length(F.lit(1), F.col("s")))
    placed = placed.withColumn("char_start", F.col("before") + F.char_length(first) - F.char_length(F.regexp_replace(first, r"^[\x09-\x0D\x20]+", ""))).withColumn("char_end", F.col("before") + length(F.col("s") + 1, F.col("e") - F.col("s")))
    return placed.select(F.concat(F.col(key).cast("string"), F.lit(":"), F.col("j").cast("string")).alias("passage_id"), key, "char_start", "char_end", F.expr("substring(t, char_start + 1, char_end - char_start)").alias("text"), (F.col("e") - F.col("s")).alias("token_count"))


def compiled(items: DataFrame, key: str, content: str, offsets: str, shown: str, width: int = 300, overlap: int = 40) -> DataFrame:
    """Tagged rows of each item: kind item, page, passage, or skipped with a reason.

    offsets: array of [start, end) of every scanned leaf; shown: array<int>, the scanned leaf of each shown
    one. An item whose shown leaves are not all covered, or that shows none, is skipped.
    """
    none = lambda kind: F.lit(None).cast(kind)
    n_shown, covered = F.size(F.coalesce(shown, F.array().cast("array<int>"))), F.size(F.filter(F.coalesce(shown, F.array().cast("array<int>")), lambda s: s < F.size(offsets)))
    reason = F.when(n_shown == 0, "no page numbers").when(covered != n_shown, F.concat(F.lit("page index covers "), covered.cast("string"), F.lit(" of "), n_shown.cast("string"), F.lit(" shown leaves")))
    rows = items.select(F.col(key).alias("identifier"), content, offsets, shown, reason.alias("reason"))
    row = lambda df, kind, **c: df.select(F.lit(kind).alias("kind"), "identifier", *[c.get(x, none(k)).alias(x) for x, k in (("id", "string"), ("leaf", "int"), ("chars", "int"), ("tokens", "int"), ("reason", "string"))])
    leaves = rows.filter("reason is null").select("identifier", content, offsets, F.posexplode(shown).alias("leaf", "scanned"))
    pair = F.get(F.col(offsets), F.col("scanned"))
    pages = leaves.select("identifier", F.concat(F.col("identifier").cast("string"), F.lit("#"), F.col("leaf").cast("string")).alias("page_id"), "leaf", F.substring(F.col(content), pair[0] + 1, pair[1] - pair[0]).alias("text"))
    parts = passages(pages, "page_id", "text", width, overlap).withColumn("identifier", F.substring_index("page_id", "#", 1))
    out = row(rows, "item", id=F.col("identifier").cast("string")).unionByName(row(rows.filter("reason is not null"), "skipped", reason=F.col("reason")))
    out = out.unionByName(row(pages, "page", id=F.col("page_id"), leaf=F.col("leaf"), chars=F.char_length("text")))
    return out.unionByName(row(parts.withColumn("identifier", F.col("identifier").cast(items.schema[key].dataType)), "passage", id=F.col("passage_id"), chars=F.char_length("text"), tokens=F.col("token_count")))


def parsed_items(items: DataFrame, key: str, form: str, content: str, expected: str) -> DataFrame:
    """key, pages (array), parsed, mismatch, reason. form: the format of each; only texts with form feeds are cut here, hOCR is an error."""
    refused = F.when(F.col(form) == "hOCR", F.raise_error(F.lit("hOCR is no corpus source"))).otherwise(F.coalesce(content, F.lit("")))
    rows = items.withColumn("pages", ingest.pages(refused)).withColumn("parsed", F.size("pages"))
    differs = F.coalesce(F.col("parsed") != F.col(expected), F.lit(False))
    reason = F.when(differs, F.concat(F.lit("parsed "), F.col("parsed").cast("string"), F.lit(" pages but the page map has "), F.col(expected).cast("string")))
    return rows.select(key, "pages", "parsed", differs.alias("mismatch"), reason.alias("reason"))


def build_counters(items: DataFrame, done: DataFrame) -> DataFrame:
    """What a build would do, in one row.

    items: item_id, source, text (null: not downloaded), labels (array or null), page_count; done: item_id.
    A page map that disagrees with the pages is dropped and counted as a risk.
    """
    rows = items.join(done.select("item_id", F.lit(True).alias("is_done")), "item_id", "left")
    is_done, pending = F.coalesce("is_done", F.lit(False)), F.col("text").isNull()
    pages = F.size(F.split("text", "\f", -1))
    expected = F.coalesce(F.when(F.col("labels").isNotNull(), F.size("labels")), F.col("page_count"))
    filled = F.exists(F.split("text", "\f", -1), lambda p: F.trim(p) != "")
    new = ~is_done & ~pending
    return rows.agg(
        F.count_if(new).alias("items_parsed"), F.count_if(is_done).alias("items_skipped_done"), F.count_if(~is_done & pending).alias("items_pending_download"), F.count_if(new & F.col("labels").isNull()).alias("items_no_page_numbers"),
        F.coalesce(F.sum(F.when(new, pages)), F.lit(0)).alias("total_pages"), F.count_if(new & (pages != expected)).alias("alignment_risk"), F.count_if(new & ~filled).alias("zero_usable_text_items"),
    )


def dated(items: DataFrame) -> DataFrame:
    """items (item_id, title, date_raw, passages) with year, method and whether the title had to give it."""
    parsed = periods.parse_date(F.col("date_raw"))
    rows = items.withColumn("p", parsed).withColumn("by_title", F.when(F.col("p.dated") == 0, periods.title_year(F.col("title"))))
    method = F.when(F.col("p.dated") == 1, F.col("p.method")).when(F.col("by_title").isNotNull(), "title_extracted").otherwise(F.col("p.method"))
    return rows.select("item_id", "passages", F.coalesce("p.year", "by_title").alias("year"), method.alias("method"), (F.col("p.dated") == 1).alias("dated_before"))


def dating_counters(rows: DataFrame) -> DataFrame:
    """Items and passages undated before, recovered and undated after, in one row. rows: as dated() gives them."""
    n = lambda c: F.count_if(c)
    p = lambda c: F.coalesce(F.sum(F.when(c, F.col("passages"))), F.lit(0))
    before, after = ~F.col("dated_before"), F.col("year").isNull()
    return rows.agg(
        F.count("*").alias("items"), n(before).alias("undated_before_items"), p(before).alias("undated_before_passages"), n(before & ~after).alias("recovered_items"), p(before & ~after).alias("recovered_passages"),
        n(after).alias("undated_after_items"), p(after).alias("undated_after_passages"),
    )


def only_place(collections: Column, of_collection: dict[str, str]) -> Column:
    """The place that a list of collections stands for, if it is exactly one."""
    table = F.create_map(*[F.lit(x) for pair in of_collection.items() for x in pair])
    found = F.array_distinct(F.filter(F.transform(collections, lambda c: F.try_element_at(table, c)), lambda v: v.isNotNull()))
    return F.when(F.size(found) == 1, found[0])


def issuer_place(creator: Column, publisher: Column, by_collection: Column) -> Column:
    """struct(place, method) from places read in issuer fields alone: agreeing ones, a conflict, a single collection, or none."""
    value = lambda place, method: F.struct(place.alias("place"), F.lit(method).alias("method"))
    clash = creator.isNotNull() & publisher.isNotNull() & (creator != publisher)
    return (
        F.when(clash, value(F.lit("unknown"), "conflict")).when(creator.isNotNull(), value(creator, "creator")).when(publisher.isNotNull(), value(publisher, "publisher"))
        .when(by_collection.isNotNull(), value(by_collection, "collection")).otherwise(value(F.lit("unknown"), "none"))
    )


def registered(known: DataFrame, items: DataFrame, passages: DataFrame) -> dict[str, DataFrame]:
    """What an indexed corpus adds to a register: documents not known yet (with a digest), and every passage with its text's.

    known: doc_id; items: item_id and catalogue columns; passages: passage_id, item_id, text.
    """
    rows = items.withColumn("doc_id", F.concat(F.lit("ia:"), F.col("item_id").cast("string")))
    new = rows.join(known.select("doc_id"), "doc_id", "left_anti")
    digest = F.sha2(F.to_json(F.struct(*sorted(items.columns)), {"ignoreNullFields": "false"}), 256)
    return {
        "documents": new.withColumn("record_sha256", digest),
        "passages": passages.select("passage_id", F.concat(F.lit("ia:"), F.col("item_id").cast("string")).alias("doc_id"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256")),
    }


def text_versions(have: DataFrame, fetched: DataFrame) -> DataFrame:
    """Versions of texts: those known stay, a fetched text that differs from all of its document's becomes a new one.

    have: doc_id, text_sha256, state; fetched: doc_id, text.
    """
    new = fetched.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"), F.when(F.trim(F.coalesce("text", F.lit(""))) == "", "empty").otherwise("fetched").alias("state"))
    return have.select("doc_id", "text_sha256", "state").unionByName(new.dropDuplicates(["doc_id", "text_sha256"]).join(have, ["doc_id", "text_sha256"], "left_anti"))


def first_pages(passages: DataFrame, item: str, leaf: str, start: str, column: str, leaves: int = 6) -> DataFrame:
    """item, leaf, text of the first leaves, their passages in order joined by spaces."""
    parts = passages.filter(F.col(leaf) < leaves).groupBy(item, leaf).agg(F.array_sort(F.collect_list(F.struct(F.col(start).alias("s"), F.coalesce(column, F.lit("")).alias("t")))).alias("p"))  # of one page
    return parts.select(item, leaf, F.array_join(F.transform("p", lambda p: p["t"]), " ").alias("text"))
