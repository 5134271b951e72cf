"""Cubes of cells whose distinct counts and quantiles can be added up: stored once, rolled up and brought up to date without the rows.

A cell holds a theta sketch for each distinct count (exact up to ``2 ** precision`` values, then within about
``2 / sqrt(2 ** precision)`` in 19 of 20 cases), a KLL sketch for each column of numbers (quantiles within a rank error of about 1.65 per cent at
``k`` of 200; least and largest value exact) and its number of rows. Cells are a few kilobytes, whatever they count.

Defined cases: nulls are not counted by a sketch; a cell without values has a distinct count of 0 and null quantiles; keys that are
null are cells of their own.

``ExactCube`` counts the different values of an integer column exactly at any size, by bitmaps in place of a sketch.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PRECISION = 12
K = 200
BUCKET = "bucket"


@dataclass(frozen=True)
class Cube:
    """What cells are kept by, and what they hold: distinct and numbers name the columns of rows."""

    keys: tuple[str, ...]
    distinct: tuple[str, ...] = ()
    numbers: tuple[str, ...] = ()
    precision: int = PRECISION
    k: int = K

    def cells(self, rows: DataFrame) -> DataFrame:
        """keys, n, and a sketch ``d_<column>`` or ``q_<column>`` of each column, from rows in one pass."""
        return rows.groupBy(*self.keys).agg(
            F.count("*").alias("n"),
            *(F.theta_sketch_agg(c, self.precision).alias(f"d_{c}") for c in self.distinct),
            *(F.kll_sketch_agg_double(F.col(c).cast("double"), self.k).alias(f"q_{c}") for c in self.numbers),
        )

    def rolled(self, cells: DataFrame, keys: list[str]) -> DataFrame:
        """Cells by fewer keys, or those of several cubes by the same ones, from cells alone."""
        return cells.groupBy(*keys).agg(
            F.sum("n").alias("n"),
            *(F.theta_union_agg(f"d_{c}", self.precision).alias(f"d_{c}") for c in self.distinct),
            *(F.kll_merge_agg_double(f"q_{c}", self.k).alias(f"q_{c}") for c in self.numbers),
        )

    def tabulated(self, cells: DataFrame, sets: list[list[str]]) -> DataFrame:
        """Cells of every set of keys, null where a key is summed over; ``level`` is the set's place."""
        out = None
        for i, keys in enumerate(sets):
            one = self.rolled(cells, keys).select(F.lit(i).alias("level"), *[F.col(k) if k in keys else F.lit(None).cast(cells.schema[k].dataType).alias(k) for k in self.keys], "n", *[f"d_{c}" for c in self.distinct], *[f"q_{c}" for c in self.numbers])
            out = one if out is None else out.unionByName(one)
        return out

    def updated(self, stored: DataFrame, rows: DataFrame) -> DataFrame:
        """The cells that new rows touch, with what is stored of them: only these have to be written again."""
        new = self.cells(rows)
        match = F.lit(True)
        for k in self.keys:
            match = match & F.col(f"s.{k}").eqNullSafe(F.col(f"n.{k}"))
        touched = stored.alias("s").join(new.select(*self.keys).alias("n"), match, "left_semi")
        return self.rolled(touched.unionByName(new), list(self.keys))


@dataclass(frozen=True)
class ExactCube:
    """Cells that add up and count the different values of an integer column exactly, however many there are.

    A cell is a row for each ``BUCKET`` of 32,768 numbers that it has values in, with their bitmap (4 KB), so no row grows and cells
    of many values are dealt over many tasks. Nulls count as rows, in a bucket of their own, and not as values.
    """

    keys: tuple[str, ...]
    column: str

    def cells(self, rows: DataFrame) -> DataFrame:
        """keys, bucket, n, bits from rows in one pass."""
        return rows.groupBy(*self.keys, F.bitmap_bucket_number(self.column).alias(BUCKET)).agg(F.count("*").alias("n"), F.bitmap_construct_agg(F.bitmap_bit_position(self.column)).alias("bits"))

    def rolled(self, cells: DataFrame, keys: list[str]) -> DataFrame:
        """Cells by fewer keys, or those of several cubes by the same ones, from cells alone."""
        return cells.groupBy(*keys, BUCKET).agg(F.sum("n").alias("n"), F.bitmap_or_agg("bits").alias("bits"))

    def updated(self, stored: DataFrame, rows: DataFrame) -> DataFrame:
        """The rows of cells that new rows touch, with what is stored of them: only these have to be written again."""
        new = self.cells(rows)
        match = F.lit(True)
        for k in (*self.keys, BUCKET):
            match = match & F.col(f"s.{k}").eqNullSafe(F.col(f"n.{k}"))
        touched = stored.alias("s").join(new.select(*self.keys, BUCKET).alias("n"), match, "left_semi")
        return self.rolled(touched.unionByName(new), list(self.keys))

    def counted(self, cells: DataFrame, keys: list[str], name: str) -> DataFrame:
        """keys, n and how many different values."""
        return self.rolled(cells, keys).groupBy(*keys).agg(F.sum("n").alias("n"), F.sum(F.bitmap_count("bits")).alias(name))


def distinct(sketch: str) -> Column:
    """The number of different values, rounded."""
    return F.coalesce(F.theta_sketch_estimate(sketch), F.lit(0)).cast("long")


def quantile(sketch: str, rank: float) -> Column:
    """The value at a rank from 0 to 1; null in a cell without values."""
    held = F.kll_sketch_get_n_double(sketch) > 0
    return F.when(held, F.kll_sketch_get_quantile_double(F.when(held, F.col(sketch)), F.lit(rank)))


def share_up_to(sketch: str, value: float) -> Column:
    """The share of values that are at most this one; null in a cell without values."""
    held = F.kll_sketch_get_n_double(sketch) > 0
    return F.when(held, F.kll_sketch_get_rank_double(F.when(held, F.col(sketch)), F.lit(value)))


def in_both(a: str, b: str) -> Column:
    """How many values two sketches have in common."""
    return distinct_of(F.theta_intersection(a, b))


def only_first(a: str, b: str) -> Column:
    return distinct_of(F.theta_difference(a, b))


def distinct_of(sketch: Column) -> Column:
    return F.theta_sketch_estimate(sketch).cast("long")
