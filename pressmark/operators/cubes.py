"""Aggregates: coverage cells, tabulations, distributions, rates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def with_leaf_count(leaves: DataFrame) -> DataFrame:
    """Every leaf with the number of its item's leaves, its largest leaf plus one."""
    return leaves.withColumn("n_leaves", F.max("leaf").over(Window.partitionBy("item_id")) + 1)


def cells(items: DataFrame, keys: list[str], leaves: str) -> DataFrame:
    """One numbered row for each combination of the keys: items, leaves, undated."""
    grouped = items.groupBy(*keys).agg(F.count("*").alias("items"), F.sum(F.coalesce(leaves, F.lit(0))).alias("leaves"), F.sum(1 - F.col("dated")).alias("undated"))
    return grouped.withColumn("cell", F.row_number().over(Window.orderBy(*keys)).cast("long"))  # over cells, not items


def facts(items: DataFrame, first: int, last: int) -> DataFrame:
    """Counts of a corpus in one pass."""
    return items.agg(
        F.count("*").alias("items"),
        F.sum(1 - F.col("dated")).alias("undated"),
        F.round(F.sum(1 - F.col("dated")) / F.count("*"), 6).alias("undated_share"),
        F.count_if((F.col("year") < first) | (F.col("year") > last)).alias("out_of_window"),
        F.min("year").alias("first_year"),
        F.max("year").alias("last_year"),
    )


def composition(items: DataFrame, axes: list[str]) -> DataFrame:
    """Counts on every axis in one pass: axis, value, n."""
    pairs = F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).cast("string").alias("value")) for a in axes]))
    return items.select(pairs.alias("p")).groupBy("p.axis", "p.value").agg(F.count("*").alias("n")).select("axis", "value", "n")


def over_domain(rows: DataFrame, key: str, domain: list) -> DataFrame:
    """Counts for every value of a domain, also of those that do not occur."""
    values = rows.sparkSession.createDataFrame([(v,) for v in domain], rows.select(key).schema)
    return values.join(rows.groupBy(key).agg(F.count("*").alias("n")), key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n"))


def shares(rows: DataFrame, key: str) -> DataFrame:
    counts = rows.groupBy(key).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))  # over one row for each value


def tabulate(items: DataFrame, keys: list[str]) -> DataFrame:
    """The full table, its margins and the total, by grouping sets in one pass."""
    sets = [[F.col(k) for k in keys], *[[F.col(k)] for k in keys], []]
    return items.groupingSets(sets, *keys).agg(F.grouping_id().alias("level"), F.count("*").alias("n"), F.count_if(F.col("dated") == 1).alias("dated_items"))


def list_counts(rows: DataFrame, column: str, name: str) -> DataFrame:
    """How often each element of a list column occurs."""
    return rows.select(F.explode(column).alias(name)).groupBy(name).agg(F.count("*").alias("n"))


def year_counts(items: DataFrame, first: int, last: int) -> DataFrame:
    """Distinct items for every year from first to last, zero where there are none."""
    axis = items.sparkSession.range(1).select(F.explode(F.sequence(F.lit(first), F.lit(last))).alias("year"))
    return axis.join(items.groupBy("year").agg(F.countDistinct("item_id").alias("n")), "year", "left").select("year", F.coalesce("n", F.lit(0)).alias("n"))


def hit_coverage(hits: DataFrame) -> DataFrame:
    """What a set of hits covers."""
    return hits.agg(
        F.countDistinct("item_id").alias("items"),
        F.count("*").alias("passages"),
        F.countDistinct(F.when(F.col("dated") == 0, F.col("item_id"))).alias("undated"),
        F.countDistinct("period").alias("periods"),
        F.countDistinct("jurisdiction").alias("jurisdictions"),
        (F.countDistinct("item_id") <= 1).alias("single_source"),
    )


def latency(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Median and nearest-rank 95th percentile of each group: the value at rank ceil(0.95 n)."""
    return rows.groupBy(key).agg(F.round(F.percentile(value, 0.5), 6).alias("median"), F.expr(f"percentile_disc(0.95) WITHIN GROUP (ORDER BY {value})").alias("p95"))


def rate_status(rows: DataFrame, ts: str) -> DataFrame:
    """How many rows in the last hour and day before the latest one."""
    ref = rows.agg(F.max(ts).alias("ref"))
    return rows.crossJoin(F.broadcast(ref)).agg(  # one row
        F.count_if(F.col(ts) > F.col("ref") - F.expr("interval 1 hour")).alias("last_hour"), F.count_if(F.col(ts) > F.col("ref") - F.expr("interval 1 day")).alias("last_day"), F.count("*").alias("done")
    )
