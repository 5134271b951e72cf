"""The tables of a folder, and the stand-ins for a library's tables that the queries run on.

items      orders with their customer's place: item_id, year, dated, jurisdiction, issuer, doc_type, collection, ocr_quality, amount
leaves     lineitems as an item's leaves: item_id, leaf, quality, tokens
captures   events as captures of a user's page: key, ts, digest, status
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Tables of texts of these sizes in bytes are dealt out by their key: they may lie in one row group, which one task reads.
SMALL_TEXTS = (1 << 20, 1 << 28)
TEXTS = {"documents": "doc_id", "pages": "page_id"}


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table. A table of texts that is small, but not tiny, is dealt over all cores before they are taken apart; larger ones have splits enough."""
    rows = spark.read.parquet(f"{folder}/{name}.parquet")
    key = TEXTS.get(name)
    if key in rows.columns and SMALL_TEXTS[0] < int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < SMALL_TEXTS[1]:
        return rows.repartition(spark.sparkContext.defaultParallelism, key)
    return rows


#: Rows of a table that one task sorts or groups where rows are dealt by a number of tasks.
TASK_ROWS = 1 << 19


def tasks(*tables: DataFrame) -> int:
    """How many tasks the largest of these tables needs, so that the memory of one does not grow with the input."""
    return max(tables[0].sparkSession.sparkContext.defaultParallelism, -(-max(rows.count() for rows in tables) // TASK_ROWS))


def dealt(*tables: tuple[DataFrame, str]) -> list[DataFrame]:
    """Tables, each with its key, over so many tasks: they meet by key where they lie."""
    n = tasks(*(rows for rows, _ in tables))
    return [rows.repartition(n, key) for rows, key in tables]


class Tables:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return read(self.spark, self.folder, name)

    @property
    def items(self) -> DataFrame:
        undated = F.col("o_orderstatus") == "P"
        places = self.nation.join(self.region, F.col("n_regionkey") == F.col("r_regionkey"))
        return (
            self.orders.join(self.customer, F.col("o_custkey") == F.col("c_custkey"))
            .join(places, F.col("c_nationkey") == F.col("n_nationkey"))
            .select(
                F.concat(F.lit("it-"), F.col("o_orderkey").cast("string")).alias("item_id"),
                F.when(~undated, F.year("o_orderdate")).alias("year"),
                (~undated).cast("int").alias("dated"),
                F.col("n_name").alias("jurisdiction"),
                F.col("c_mktsegment").alias("issuer"),
                F.col("o_orderpriority").alias("doc_type"),
                F.col("r_name").alias("collection"),
                ((F.col("o_orderkey") % 101) / 100).alias("ocr_quality"),
                F.col("o_totalprice").alias("amount"),
            )
        )

    @property
    def leaves(self) -> DataFrame:
        return self._leaves()

    @property
    def placed_leaves(self) -> DataFrame:
        """Leaves with their file and place in it."""
        return self._leaves(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))

    def _leaves(self, *more: Column) -> DataFrame:
        return self.lineitem.select(
            F.concat(F.lit("it-"), F.col("l_orderkey").cast("string")).alias("item_id"),
            (F.col("l_linenumber") - 1).alias("leaf"),
            ((F.col("l_partkey") * 7 + F.col("l_suppkey")) % 101 / 100).alias("quality"),
            F.col("l_quantity").cast("int").alias("tokens"),
            *more,
        )

    @property
    def captures(self) -> DataFrame:
        return self.events.select(
            F.col("user_id").alias("key"),
            "ts",
            F.col("event_id"),
            F.col("event_type").alias("digest"),
            F.when(F.col("value") > 50, 200).otherwise(404).alias("status"),
        )


#: The same stand-ins for DuckDB.
SQL = {
    "items": """items AS (SELECT 'it-' || o_orderkey::VARCHAR AS item_id, CASE WHEN o_orderstatus <> 'P' THEN year(o_orderdate)::INT END AS year,
 (o_orderstatus <> 'P')::INT AS dated, n_name AS jurisdiction, c_mktsegment AS issuer, o_orderpriority AS doc_type, r_name AS collection,
 (o_orderkey % 101)::DOUBLE / 100 AS ocr_quality, o_totalprice AS amount
 FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)""",
    "leaves": """leaves AS (SELECT 'it-' || l_orderkey::VARCHAR AS item_id, l_linenumber - 1 AS leaf, ((l_partkey * 7 + l_suppkey) % 101)::DOUBLE / 100 AS quality,
 l_quantity::INT AS tokens FROM lineitem)""",
    "captures": """captures AS (SELECT user_id AS key, ts, event_id, event_type AS digest, CASE WHEN value > 50 THEN 200 ELSE 404 END AS status FROM events)""",
}
