"""Cutting lineage through the folder that all executors share, and column names that clash with none."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressmark.session import shared_folder


def checkpointed(df: DataFrame) -> DataFrame:
    """df.checkpoint() in the shared folder."""
    sc = df.sparkSession.sparkContext
    folder = shared_folder(df.sparkSession)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def unused(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that df has not, whatever the case."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def looked_up(rows: DataFrame, table: DataFrame, key: str, share: int = 1000) -> DataFrame:
    """Inner join of rows with a table that has one row for each key; ``key`` must not be null.

    Keys that hold more than a ``share``-th of all rows are met by a broadcast of at most ``share`` rows
    of the table, so no task gets all rows of such a key; the others meet over a shuffle.
    """
    counts = rows.groupBy(key).agg(F.count("*").alias("_n"))
    total = counts.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]  # one number
    hot = checkpointed(counts.filter(F.col("_n") * share > total).select(key).join(table, key))  # fewer than share rows
    few = hot.select(key)
    often = rows.join(F.broadcast(hot), key)
    return often.unionByName(rows.join(F.broadcast(few), key, "left_anti").join(table, key))
