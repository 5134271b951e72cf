"""Sorting by a key into numbered ranges, with every range also seeing what follows it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType


def _bucket(key: Column, bounds: list[float]) -> Column:
    """How many of the sorted bounds are at most the key: a search in two steps of about sqrt(n) comparisons."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    groups = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    heads = F.array(*[F.lit(g[0]) for g in groups])
    rest = F.array(*[F.array(*[F.lit(b) for b in g]) for g in groups])
    k = key.cast("double")
    group = F.size(F.filter(heads, lambda b: b <= k))
    within = F.size(F.filter(F.element_at(rest, F.greatest(group, F.lit(1))), lambda b: b <= k))
    return F.when(group == 0, 0).otherwise((group - 1) * step + within)


def with_successors(rows: DataFrame, key: str, ties: list[str], parts: int) -> DataFrame:
    """Rows in ascending order of key (nulls first), then ties, over ``parts`` partitions by ranges of the key.

    Adds a boolean column ``_follows``: after a partition's own rows come copies, marked
    true, of the rows with the smallest key of the next range that has any; after the
    last range those of the first. Only these few rows are sent twice. What is broadcast
    is one row for each range. The key must be a number; other kinds are an error.
    """
    if not isinstance(rows.schema[key].dataType, NumericType):
        raise TypeError(f"{key} must be a number to be dealt by ranges")
    bounds = sorted(set(rows.approxQuantile(key, [k / parts for k in range(1, parts)], 1 / (8 * parts)))) if parts > 1 else []
    placed = rows.withColumn("_range", F.coalesce(_bucket(F.col(key), bounds), F.lit(0)))
    firsts = placed.groupBy("_range").agg(F.min(F.struct(F.col(key).isNotNull().alias("a"), F.col(key).alias("b"))).alias("m")).select("_range", "m.b").orderBy("_range").collect()  # one row per range
    before = [(r["_range"], r["b"], firsts[k - 1]["_range"]) for k, r in enumerate(firsts)]
    kind = rows.schema[key].dataType.simpleString()
    small = rows.sparkSession.createDataFrame(before, f"_at int, _first {kind}, _back int")
    joined = placed.join(F.broadcast(small), (F.col("_range") == F.col("_at")) & F.col(key).eqNullSafe(F.col("_first")), "left")
    places = F.when(F.col("_at").isNull(), F.array(F.struct(F.col("_range").alias("to"), F.lit(False).alias("f")))).otherwise(
        F.array(F.struct(F.col("_range").alias("to"), F.lit(False).alias("f")), F.struct(F.col("_back").alias("to"), F.lit(True).alias("f")))
    )
    dealt = joined.withColumn("_place", F.explode(places)).select(*rows.columns, F.col("_place.to").alias("_to"), F.col("_place.f").alias("_follows"))
    return dealt.repartitionById(max(1, parts), F.col("_to")).sortWithinPartitions("_follows", F.col(key).asc_nulls_first(), *ties).drop("_to")
