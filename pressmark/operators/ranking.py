"""Ranks, caps, top-k and deterministic samples. Every order ends in a key, so ties have one result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked(rows: DataFrame, by: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def capped(rows: DataFrame, by: list[str], order: list[Column], most: int) -> DataFrame:
    """At most so many rows of each group, in order."""
    return ranked(rows, by, order, "_r").filter(F.col("_r") <= most).drop("_r")


def middle(rows: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The row at position n // 2 (from 0) of each group."""
    w = Window.partitionBy(*by)
    return ranked(rows, by, order, "_r").withColumn("_n", F.count("*").over(w)).filter(F.col("_r") == F.floor(F.col("_n") / 2) + 1).drop("_r", "_n")


def hash_order(seed: str, key: str) -> Column:
    """A reproducible random order of keys."""
    return F.sha2(F.concat(F.lit(seed), F.col(key).cast("string")), 256)


def sampled(rows: DataFrame, by: list[str], key: str, seed: str, most: int) -> DataFrame:
    """A reproducible sample of at most so many rows of each group."""
    return capped(rows, by, [hash_order(seed, key), F.col(key)], most)


def split_sets(rows: DataFrame, by: list[str], key: str, seed: str, shares: dict[str, float]) -> DataFrame:
    """Every group's rows in hash order cut at the shares: column ``part``."""
    w = Window.partitionBy(*by)
    out = ranked(rows, by, [hash_order(seed, key), F.col(key)], "_r").withColumn("_n", F.count("*").over(w))
    at, part = 0.0, None
    for name, share in shares.items():
        at += share
        bound = F.col("_r") <= F.round(F.col("_n") * at)
        part = F.when(bound, name) if part is None else part.when(bound, name)
    return out.withColumn("part", part.otherwise(list(shares)[-1])).drop("_r", "_n")


def top(rows: DataFrame, order: list[Column], k: int) -> DataFrame:
    return rows.orderBy(*order).limit(k)
