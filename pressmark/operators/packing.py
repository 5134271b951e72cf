"""Planning and checking: shards by running size, spans not seen yet, gates, manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pressmark.operators.ordering import bins, numbered


def plan_shards(docs: DataFrame, target: float, pool_below: float) -> DataFrame:
    """item_id, shard, shard_id, first_year, last_year, split_year: documents of a place in order of year filled into shards of ``target``.

    docs: item_id, place (null: unknown), year, size. Places smaller than ``pool_below`` together are "other". Dated documents come
    first, by year and id, then the undated in shards of their own. ``shard`` names a shard by its first year, ``shard_id`` by
    its years; both number those that would have the same name. A year is split where one shard ends and the next begins
    with it. Places are filled by ``ordering.bins``: no task holds one.
    """
    known = docs.select("item_id", F.coalesce("place", F.lit("unknown")).alias("place"), F.col("year").cast("int").alias("year"), "size")
    totals = known.groupBy("place").agg(F.sum("size").alias("_t"))
    pooled = known.join(totals, "place").withColumn("place", F.when(F.col("_t") < pool_below, "other").otherwise(F.col("place"))).drop("_t")
    segment = F.concat("place", F.lit("\n"), F.when(F.col("year").isNull(), "1").otherwise("0"))
    filled = bins(pooled.withColumn("segment", segment), "segment", ["year", "item_id"], "size", target)
    shards = filled.groupBy("bin").agg(F.min("segment").alias("segment"), F.min("place").alias("place"), F.min("year").alias("first_year"), F.max("year").alias("last_year"))
    undated = F.col("first_year").isNull()
    named = shards.withColumn("base", F.concat("place", F.lit("-"), F.when(undated, "undated").otherwise(F.col("first_year").cast("string"))))
    named = named.withColumn("base_id", F.when(undated, F.col("base")).otherwise(F.concat("base", F.lit("-"), F.col("last_year").cast("string"))))
    for base, name in (("base", "shard"), ("base_id", "shard_id")):  # shards of one name: a year of a place
        k = F.row_number().over(Window.partitionBy(base).orderBy("bin"))
        named = named.withColumn(name, F.when(k == 1, F.col(base)).otherwise(F.concat(base, F.lit("-"), k.cast("string"))))
    placed = numbered(named, ["bin"], "k")
    beside = lambda step, year: placed.select((F.col("k") + step).alias("k"), F.col("segment").alias("s"), F.col(year).alias("y"))
    split = lambda step, theirs, own: placed.join(beside(step, theirs), "k").filter((F.col("s") == F.col("segment")) & (F.col("y") == F.col(own))).select("bin")
    both = split(1, "last_year", "first_year").union(split(-1, "first_year", "last_year")).distinct().withColumn("split_year", F.lit(True))
    told = placed.join(both, "bin", "left").select("bin", "shard", "shard_id", "first_year", "last_year", F.coalesce("split_year", F.lit(False)).alias("split_year"))
    return filled.select("item_id", "bin").join(told, "bin").drop("bin")


def uncovered(spans: DataFrame, key: str, start: str, end: str, tie: str) -> DataFrame:
    """Spans with ``fresh``: how much of each no earlier span of its key has covered."""
    w = Window.partitionBy(key).orderBy(start, tie).rowsBetween(Window.unboundedPreceding, -1)
    seen = F.coalesce(F.max(end).over(w), F.lit(0))
    return spans.withColumn("fresh", F.greatest(F.lit(0), F.col(end) - F.greatest(F.col(start), seen)))


def gates(failing: dict[str, DataFrame]) -> DataFrame:
    """gate, failing: how many rows fail each; a release has zero everywhere."""
    out = None
    for name, rows in failing.items():
        one = rows.agg(F.lit(name).alias("gate"), F.count("*").alias("failing"))
        out = one if out is None else out.unionByName(one)
    return out


def problems(rules: dict[str, Column]) -> Column:
    """The names of the rules that a record breaks."""
    return F.array_compact(F.array(*[F.when(broken, name) for name, broken in rules.items()]))


def manifest(wanted: DataFrame, found: DataFrame, key: str, checksum: str, actual: str) -> DataFrame:
    """done, missing or changed for every unit of a manifest."""
    state = F.when(F.col(actual).isNull(), "missing").when(F.col(actual) != F.col(checksum), "changed").otherwise("done")
    return wanted.join(found, key, "left").select(key, state.alias("state"))
