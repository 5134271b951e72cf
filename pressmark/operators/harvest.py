"""Harvested items: files and formats, segmentation, records, places and types, scopes, downloads and their checks.

Defined cases: an item without files has no source; unknown counts are null; a text that is null
holds no pattern; rule tables are parameters, read in their order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressmark.sources.readers import chosen_source

#: Endings of a source's file and the format it stands for.
FORMATS = (("_djvu.txt", "DjVuTXT"), ("_djvu.xml", "DjVuXML"), ("_hocr.html", "hOCR"))


def has_file(files: Column, ending: str) -> Column:
    return F.coalesce(F.exists(files, lambda f: f["name"].endswith(ending)), F.lit(False))


def format_flags(files: Column) -> Column:
    """struct: whether an item has each format, any that is usable as text, and any at all. files: array<struct<name>>."""
    own = {name: has_file(files, end) for end, name in FORMATS}
    usable = own["DjVuTXT"] | own["DjVuXML"]
    return F.struct(*[c.alias(n) for n, c in own.items()], usable.alias("has_usable_text"), (usable | own["hOCR"]).alias("has_any_ocr"))


def format_of(source: Column) -> Column:
    """The format of a chosen file by its name's ending."""
    out = F.lit(None).cast("string")
    for end, name in reversed(FORMATS):
        out = F.when(source["name"].endswith(end), name).otherwise(out)
    return out


def leaf_count(labels: Column, page_count: Column) -> Column:
    """What the page map holds, else what the catalogue says, else null. labels: array or null."""
    return F.coalesce(F.when(labels.isNotNull(), F.size(labels)), page_count.try_cast("int"))


def segmentation(files: Column, form_feeds: Column, leaves: Column, selected: Column, tolerance: int) -> Column:
    """struct(source, reason): how an item is cut into pages.

    By form feeds where there are several pages and they agree with the leaves within a
    tolerance; as selected before where the text is not at hand; else by XML, hOCR or not at all.
    """
    fits = (form_feeds > 1) & (leaves.isNull() | (F.abs(form_feeds - leaves) <= tolerance))
    way = lambda source, reason: F.struct(source.alias("source"), F.lit(reason).alias("reason"))
    return (
        F.when(F.coalesce(fits, F.lit(False)), way(F.lit("djvutxt"), "form feeds agree with leaves"))
        .when(form_feeds.isNull(), way(selected, "text not at hand"))
        .when(has_file(files, "_djvu.xml"), way(F.lit("djvuxml"), "no valid form feeds"))
        .when(has_file(files, "_hocr.html"), way(F.lit("hocr"), "neither form feeds nor XML"))
        .otherwise(way(F.lit(None).cast("string"), "no usable derivative"))
    )


def content_path(md5: Column, name: Column) -> Column:
    """Where a file is kept by its content: ocr/<two digits>/<md5>__<name>; null without both."""
    return F.concat(F.lit("ocr/"), F.substring(md5, 1, 2), F.lit("/"), md5, F.lit("__"), name)


def records(items: DataFrame, base: str) -> DataFrame:
    """Harvest records of the items that have a readable file: the catalogue's fields and what the files say.

    items: identifier, title, creator, publisher, year (int), files (array<struct<name,md5>>), page_count.
    """
    source = chosen_source(F.col("files"))
    rows = items.withColumn("chosen", source).filter(F.col("chosen").isNotNull())
    return rows.select(
        "identifier", "title", F.col("creator").alias("creator_raw"), F.col("publisher").alias("publisher_raw"), F.concat(F.lit(f"{base}/"), "identifier").alias("details_url"),
        "year", F.col("year").isNotNull().alias("dated"), format_of(F.col("chosen")).alias("ocr_format"), (has_file(F.col("files"), "_djvu.xml") | has_file(F.col("files"), "_hocr.html")).alias("has_word_coords"),
        has_file(F.col("files"), "_page_numbers.json").alias("has_printed_page_map"), F.col("page_count").cast("int").alias("page_count"), content_path(F.col("chosen.md5"), F.col("chosen.name")).alias("ocr_file_ref"),
    )


def enriched(items: DataFrame, done: DataFrame, skipped: DataFrame, base: str) -> tuple[DataFrame, DataFrame]:
    """(new records, identifiers without a readable file) of the items that are neither done nor skipped before."""
    new = items.join(done.select("identifier").union(skipped.select("identifier")).distinct(), "identifier", "left_anti")
    return records(new, base), new.filter(chosen_source(F.col("files")).isNull()).select("identifier")


def first_holding(text: Column, rules: list[tuple[str, tuple[str, ...]]]) -> Column:
    """The label of the first rule one of whose patterns the text holds; null without one."""
    out = F.lit(None).cast("string")
    for label, patterns in reversed(rules):
        held = F.lit(False)
        for p in patterns:
            held = held | text.contains(p)
        out = F.when(held, label).otherwise(out)
    return out


def place_at_harvest(publisher: Column, creator: Column, title: Column, collections: Column, provinces: list[tuple[str, tuple[str, ...]]], federal: tuple[str, ...], of_collection: dict[str, str]) -> Column:
    """Provinces in any of the three texts first, then the federation, then a collection's place, else Unknown."""
    text = F.lower(F.concat_ws(" ", publisher, creator, title))
    by_collection = F.lit(None).cast("string")
    if of_collection:
        table = F.create_map(*[F.lit(x) for pair in of_collection.items() for x in pair])
        by_collection = F.get(F.filter(F.transform(collections, lambda c: F.try_element_at(table, c)), lambda v: v.isNotNull()), 0)
    return F.coalesce(first_holding(text, provinces), first_holding(text, [("Federal", federal)]), by_collection, F.lit("Unknown"))


def type_at_harvest(title: Column, rules: list[tuple[str, tuple[str, ...]]]) -> Column:
    """The first type whose words the title holds; the title is padded, so that " act " finds a whole word at its ends."""
    return F.coalesce(first_holding(F.concat(F.lit(" "), F.lower(F.coalesce(title, F.lit(""))), F.lit(" ")), rules), F.lit("Other/Unknown"))


def scope_sizes(items: DataFrame, scope: str, topic: Column, bands: dict[str, tuple[int, int]]) -> DataFrame:
    """For each scope: its texts, those on the topic, and these by band of years."""
    on = F.coalesce(topic, F.lit(False))
    return items.groupBy(scope).agg(F.count("*").alias("texts_items"), F.count_if(on).alias("topic_items"), *[F.count_if(on & F.col("year").between(a, b)).alias(name) for name, (a, b) in bands.items()])


def recommended(sizes: DataFrame, scope: str, in_window: str, usable_share: float, floor: int) -> DataFrame:
    """The scope with most in the window, what of it is usable, and whether that clears the floor. sizes: one row a scope."""
    best = sizes.agg(F.max(F.struct(F.col(in_window).alias("n"), F.col(scope).alias("scope"))).alias("m"))
    usable = F.round(F.col("m.n") * F.lit(usable_share)).cast("long")
    return best.select(F.col("m.scope").alias("best_scope"), F.col("m.n").alias("in_window"), usable.alias("usable"), (usable >= floor).alias("clears_floor"))


def failing_files(wanted: DataFrame, found: DataFrame) -> DataFrame:
    """identifier, file, fault (missing or empty). wanted: identifier, file; found: file, bytes."""
    fault = F.when(F.col("bytes").isNull(), "missing").when(F.col("bytes") == 0, "empty")
    return wanted.join(found, "file", "left").select("identifier", "file", fault.alias("fault")).filter(F.col("fault").isNotNull())


def checked_twice(wanted: DataFrame, found: DataFrame, fetched: DataFrame) -> DataFrame:
    """What still fails after the files that failed were fetched once more. fetched: file, bytes as they are after that."""
    bad = failing_files(wanted, found).select("identifier", "file")
    return failing_files(bad, fetched)


def fetched_kind(has_text: Column, has_index: Column, has_plain: Column) -> Column:
    """What an item could be fetched as: hocr with an index, searchtext_only without, djvu_txt, or no_text."""
    return F.when(has_text & has_index, "hocr").when(has_text, "searchtext_only").when(has_plain, "djvu_txt").otherwise("no_text")
