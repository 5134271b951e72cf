"""Structured Streaming: resumable ingest, event-time windows, late data, keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def folder_stream(spark: SparkSession, path: str, schema, files_at_once: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(path)


def ingest_available(rows: DataFrame, out: str, checkpoint: str) -> None:
    """Everything new since the last call, appended once each, whatever was interrupted."""
    q = rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def event_windows(rows: DataFrame, ts: str, late: str, length: str, slide: str | None, *by: str) -> DataFrame:
    """Counts and sums of value by event-time window; rows later than the watermark are passed over."""
    w = F.window(ts, length, slide) if slide else F.window(ts, length)
    return rows.withWatermark(ts, late).groupBy(w, *by).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *by, "n", "total")


def sessions(rows: DataFrame, ts: str, late: str, gap: str, key: str) -> DataFrame:
    """Sessions of a key: events with less than ``gap`` between them."""
    return rows.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("s"), key).agg(F.count("*").alias("n")).select(key, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def first_seen(rows: DataFrame, ts: str, late: str, *keys: str) -> DataFrame:
    """Each key once within the watermark."""
    return rows.withWatermark(ts, late).dropDuplicatesWithinWatermark(list(keys))


def limited(rows: DataFrame, key: str, ts: str, rate: float, burst: float) -> DataFrame:
    """A token bucket for each key: key, event_id, allowed. State is two numbers a key."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tokens, last = state.get if state.exists else (burst, 0.0)
        for b in batches:
            b = b.sort_values([ts, "event_id"])
            out = []
            for at, event in zip(b[ts], b["event_id"]):
                now = at.timestamp()
                tokens = min(burst, tokens + max(0.0, now - last) * rate) if last else burst
                last = max(last, now)
                ok = tokens >= 1
                tokens -= ok
                out.append((k[0], event, ok))
            yield pd.DataFrame(out, columns=[key, "event_id", "allowed"])
        state.update((tokens, last))

    return rows.groupBy(key).applyInPandasWithState(step, f"{key} long, event_id long, allowed boolean", "tokens double, last double", "append", GroupStateTimeout.NoTimeout)


def unit_share(units: DataFrame, done: DataFrame, key: str, worker: int, workers: int) -> DataFrame:
    """The units that one of several workers still has to do: every workers-th of all in order of the key, without those done.

    Places in the order come from counts of ranges and places within each, so no task holds all units.
    """
    from pyspark.sql import Window

    ranged = units.select(key).repartitionByRange(key).withColumn("range_of", F.spark_partition_id())
    numbered = ranged.withColumn("within", F.row_number().over(Window.partitionBy("range_of").orderBy(key)))
    sizes = numbered.groupBy("range_of").agg(F.max("within").alias("n"))
    before = sizes.withColumn("before", F.sum("n").over(Window.orderBy("range_of")) - F.col("n")).drop("n")  # one row a range
    placed = numbered.join(F.broadcast(before), "range_of").withColumn("place", F.col("before") + F.col("within") - 1)
    return placed.filter(F.col("place") % workers == worker).join(done.select(key), key, "left_anti").select(key, "place")
