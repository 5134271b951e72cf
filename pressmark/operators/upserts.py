"""Changes by key as pure functions of the old rows and the new ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in order: what replacing by key leaves."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def insert_missing(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows, and one row of new for each key that is not there yet."""
    return old.unionByName(new.join(old.select(*keys), keys, "left_anti").dropDuplicates(keys))


def merge_keep(old: DataFrame, new: DataFrame, key: str, keep: list[str]) -> DataFrame:
    """New values over old ones, but for the columns to keep, where an old value stays."""
    joined = old.alias("o").join(new.alias("n"), F.col(f"o.{key}") == F.col(f"n.{key}"), "full")
    pick = lambda c, a, b: F.coalesce(F.col(f"{a}.{c}"), F.col(f"{b}.{c}")).alias(c)
    return joined.select(*[pick(c, "o", "n") if c in keep or c == key else pick(c, "n", "o") for c in old.columns])


def compared(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """added, removed, same or changed for every key of either side."""
    joined = a.select(key, F.col(value).alias("_a"), F.lit(True).alias("_in_a")).join(b.select(key, F.col(value).alias("_b"), F.lit(True).alias("_in_b")), key, "full")
    state = F.when(F.col("_in_a").isNull(), "added").when(F.col("_in_b").isNull(), "removed").when(F.col("_a").eqNullSafe(F.col("_b")), "same").otherwise("changed")
    return joined.select(key, state.alias("state"))


def guard(computed: DataFrame, published: DataFrame, key: str, within: float = 5e-4) -> DataFrame:
    """Published numbers that a recomputation does not give."""
    both = computed.join(published, key)
    off = F.abs(F.col("computed") - F.col("published")) > within
    return both.filter(off | (F.col("computed").isNull() != F.col("published").isNull())).select(key, "computed", "published")


def daily_budget(rows: DataFrame, ts: str, limit: int) -> DataFrame:
    return rows.groupBy(F.to_date(ts).alias("day")).agg(F.count("*").alias("used")).withColumn("within", F.col("used") <= limit)


def unexpired(rows: DataFrame, now: DataFrame) -> DataFrame:
    """Rows that never expire or have not by now (one row)."""
    return rows.crossJoin(F.broadcast(now)).filter(F.col("expires_at").isNull() | (F.col("expires_at") >= F.col("now"))).drop("now")


def clashes(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows whose key the new ones have too; an extension that only adds has none."""
    return old.join(new.select(*keys), keys, "left_semi")
