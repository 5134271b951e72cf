"""Readers: JSON lines with comments or torn ends, rule tables, page files in text, XML and hOCR, page labels, offsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pressmark.functions.text import decoded_references

#: Items as a harvest writes them; names that it may hold twice are read as text.
HARVEST = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("identifier", "title", "creator_raw", "publisher_raw", "date_raw", "collection_raw", "language", "mediatype", "details_url", "license", "ocr_format", "ocr_engine", "ocr_file_ref")]
    + [T.StructField("has_word_coords", T.BooleanType()), T.StructField("has_printed_page_map", T.BooleanType()), T.StructField("page_count", T.IntegerType())]
)
MOST_RULES = 100_000
LABELS = "struct<pages:array<struct<leafNum:int,pageNumber:string>>>"


def json_lines(spark: SparkSession, path: str, schema: T.StructType | str, comments: bool = False, tolerant: bool = False) -> DataFrame:
    """One object a line; blank lines are passed over, with ``comments`` lines that begin with #.

    A line that is no object is an error, or with ``tolerant`` (torn ends of logs) is passed over.
    """
    lines = spark.read.text(path).filter(F.trim("value") != "")
    if comments:
        lines = lines.filter(~F.ltrim("value").startswith("#"))
    mode = "PERMISSIVE" if tolerant else "FAILFAST"
    kind = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
    marked = T.StructType([*kind.fields, T.StructField("_torn", T.StringType())]) if tolerant else kind
    rows = lines.select(F.from_json("value", marked, {"mode": mode, "columnNameOfCorruptRecord": "_torn"}).alias("r")).select("r.*")
    return rows.filter(F.col("_torn").isNull()).drop("_torn") if tolerant else rows


def harvest(spark: SparkSession, path: str) -> DataFrame:
    """Raw items, the last record of each identifier; nothing derived is taken over."""
    return json_lines(spark, path, HARVEST).filter("identifier is not null")


def raw_items(spark: SparkSession, path: str) -> DataFrame:
    """Raw items as a table keeps them, the last record of each identifier in order of file and place: lists stay as JSON text, truth values are 0 or 1."""
    lines = spark.read.text(path).select("value", F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id()).alias("at")).filter(F.trim("value") != "")
    rows = lines.select(F.from_json("value", HARVEST, {"mode": "FAILFAST"}).alias("r"), "at").filter("r.identifier is not null")
    last = rows.groupBy("r.identifier").agg(F.max_by("r", "at").alias("r")).select("r.*")
    return last.select(*[F.col(f.name).cast("int").alias(f.name) if isinstance(f.dataType, T.BooleanType) else f.name for f in HARVEST.fields])


def done(manifest: DataFrame, key: str) -> DataFrame:
    """Keys that a log records as done: any record that is no error."""
    return manifest.filter(F.coalesce("kind", F.lit("")) != "error").select(key).distinct()


def rules(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """(pattern, value) of a rule table, the most specific first, then in the file's order; a table of at most some thousand lines."""
    rows = spark.read.option("header", True).option("comment", "#").csv(path)
    value = next(c for c in ("jurisdiction", "canonical", "doc_type") if c in rows.columns)
    specific = F.coalesce(F.col("specificity").cast("int"), F.lit(1)) if "specificity" in rows.columns else F.char_length("pattern")
    ordered = rows.select(F.lower(F.trim("pattern")).alias("p"), F.trim(value).alias("v"), specific.alias("s"), F.monotonically_increasing_id().alias("i")).filter("p <> ''").orderBy(F.desc("s"), "i")
    found = ordered.limit(MOST_RULES + 1).collect()
    if len(found) > MOST_RULES:
        raise ValueError(f"{path}: more than {MOST_RULES} rules are no rule table")
    return [(r["p"], r["v"]) for r in found]


def page_texts(files: DataFrame, key: str, content: str) -> DataFrame:
    """key, leaf, text of form-feed separated files; without a form feed a file is one page."""
    return files.select(key, F.posexplode(F.split(F.coalesce(content, F.lit("")), "\f", -1)).alias("leaf", "text"))


def xml_pages(spark: SparkSession, path: str) -> DataFrame:
    """leaf, text of page files in XML: one row an OBJECT, its words in order, read element by element."""
    words = "struct<PARAGRAPH:array<struct<LINE:array<struct<WORD:array<string>>>>>>"
    schema = T._parse_datatype_string(f"HIDDENTEXT struct<PAGECOLUMN:struct<REGION:{words}>>, PARAGRAPH array<struct<LINE:array<struct<WORD:array<string>>>>>")
    rows = spark.read.format("xml").option("rowTag", "OBJECT").schema(schema).load(path)
    flat = F.flatten(F.flatten(F.transform(F.coalesce("HIDDENTEXT.PAGECOLUMN.REGION.PARAGRAPH", "PARAGRAPH"), lambda p: F.transform(p["LINE"], lambda line: line["WORD"]))))
    return rows.select(F.monotonically_increasing_id().alias("leaf"), F.coalesce(F.array_join(F.transform(flat, lambda w: F.trim(w)), " "), F.lit("")).alias("text"))


def hocr_pages(files: DataFrame, key: str, content: str) -> DataFrame:
    """key, leaf, text of hOCR files: one row for each element of class ocr_page."""
    parts = F.split(F.coalesce(content, F.lit("")), r"<div[^>]*class=[\"']ocr_page[\"'][^>]*>")
    spread = files.select(key, F.posexplode(F.slice(parts, 2, F.size(parts))).alias("leaf", "part"))
    words = decoded_references(F.regexp_replace("part", r"<[^>]*>", " "))
    return spread.select(key, "leaf", words.alias("text")).withColumn("text", F.trim(F.regexp_replace("text", r"[\s\xA0]+", " ")))


def page_labels(files: DataFrame, key: str, content: str) -> DataFrame:
    """key, leaf, label: printed page numbers by position; blanks are null."""
    parsed = F.from_json(content, LABELS)["pages"]
    return files.select(key, F.posexplode(parsed).alias("leaf", "p")).select(key, "leaf", F.nullif(F.trim("p.pageNumber"), F.lit("")).alias("label"))


def offset_pages(items: DataFrame, key: str, text: str, offsets: str, shown: str) -> DataFrame:
    """key, leaf, text cut by offsets [start, end) of the scanned leaves that are shown; counts that differ are an error.

    offsets: array<array<int>>, one pair a scanned leaf; shown: array<int>, the scanned leaf of each shown one.
    """
    checked = items.withColumn("_shown", F.when(F.array_max(shown) < F.size(offsets), F.col(shown)).otherwise(F.raise_error(F.concat(F.lit("leaves without offsets: "), F.col(key).cast("string")))))
    spread = checked.select(key, text, offsets, F.posexplode("_shown").alias("leaf", "scanned"))
    pair = F.get(F.col(offsets), F.col("scanned"))
    return spread.select(key, "leaf", F.substring(F.col(text), pair[0] + 1, pair[1] - pair[0]).alias("text"))


def chosen_source(files: Column) -> Column:
    """The best readable file of an item: text, then XML, then hOCR; null where there is none. files: array<struct<name,...>>."""

    def first(ending: str) -> Column:
        return F.get(F.filter(files, lambda f: f["name"].endswith(ending)), 0)

    return F.coalesce(*map(first, ("_djvu.txt", "_djvu.xml", "_hocr.html")))
