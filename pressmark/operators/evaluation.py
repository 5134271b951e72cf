"""Metrics, agreement, intervals, resampling, panels. A measure without a basis is null, not zero."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pressmark.operators.ordering import numbered

Z95 = 1.959963984540054  # two-sided 95 per cent


def recall(ranking: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """q, recall: the share of a question's gold among its first k; null without gold. ranking: q, doc, rank; gold: q, doc."""
    hits = ranking.filter(F.col("rank") <= k).join(gold, ["q", "doc"], "left_semi").groupBy("q").agg(F.countDistinct("doc").alias("h"))
    n = gold.groupBy("q").agg(F.countDistinct("doc").alias("n"))
    return ranking.select("q").distinct().join(n, "q", "left").join(hits, "q", "left").select("q", (F.when(F.col("n") > 0, F.coalesce("h", F.lit(0)) / F.col("n"))).alias("recall"))


def gain(relevance: Column, rank: Column) -> Column:
    return relevance / F.log2(rank + 1)


def ndcg(ranking: DataFrame, judged: DataFrame, k: int) -> DataFrame:
    """q, ndcg at k; null where nothing relevant is judged. judged: q, doc, relevance."""
    best = judged.filter("relevance > 0").withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("relevance"), "doc"))).filter(F.col("r") <= k)
    ideal = best.groupBy("q").agg(F.sum(gain(F.col("relevance"), F.col("r"))).alias("ideal"))
    own = ranking.filter(F.col("rank") <= k).join(judged, ["q", "doc"]).groupBy("q").agg(F.sum(gain(F.greatest("relevance", F.lit(0)), F.col("rank"))).alias("dcg"))
    return ranking.select("q").distinct().join(ideal, "q", "left").join(own, "q", "left").select("q", F.when(F.col("ideal") > 0, F.coalesce("dcg", F.lit(0.0)) / F.col("ideal")).alias("ndcg"))


def unjudged(ranking: DataFrame, judged: DataFrame, k: int) -> DataFrame:
    """q, unjudged: the share of the first k that nobody has judged."""
    known = judged.select("q", "doc", F.lit(1).alias("j")).distinct()
    return ranking.filter(F.col("rank") <= k).join(known, ["q", "doc"], "left").groupBy("q").agg((F.count_if(F.col("j").isNull()) / F.count("*")).alias("unjudged"))


def wilson(successes: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """The Wilson interval within 0 and 1; nulls where n is 0."""
    n = n.cast("double")
    p, z2 = successes / F.nullif(n, F.lit(0.0)), z * z
    center, margin = p + z2 / (2 * n), z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))
    bound = lambda x: F.when(n > 0, x / (1 + z2 / n))
    return F.greatest(bound(center - margin), F.when(n > 0, 0.0)), F.least(bound(center + margin), F.when(n > 0, 1.0))


def wilson_or_all(successes: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """As wilson, but all of 0 to 1 where n is 0."""
    low, high = wilson(successes, n, z)
    return F.coalesce(low, F.lit(0.0)), F.coalesce(high, F.lit(1.0))


def rate(successes: Column, n: Column) -> list[Column]:
    low, high = wilson(successes, n)
    return [successes.alias("num"), n.alias("den"), F.round(successes / F.nullif(n, F.lit(0)), 4).alias("rate"), F.round(low, 4).alias("low"), F.round(high, 4).alias("high")]


def rate_text(successes: Column, n: Column) -> Column:
    low, high = wilson(successes, n)
    said = F.format_string("%.1f%% (%d/%d, 95%% CI %.1f-%.1f%%)", 100.0 * successes / F.nullif(n, F.lit(0)), successes, n, 100 * low, 100 * high)
    return F.when(n > 0, said).otherwise("n/a")


def kappa(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """One row: n, agreement, chance and Cohen's kappa; null without pairs or where chance agrees always."""
    rows = pairs.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    marks = rows.select(F.explode(F.array(F.struct(F.col(a).cast("string").alias("v"), F.lit(1).alias("x"), F.lit(0).alias("y")), F.struct(F.col(b).cast("string").alias("v"), F.lit(0).alias("x"), F.lit(1).alias("y")))).alias("m"))
    per = marks.groupBy("m.v").agg(F.sum("m.x").alias("x"), F.sum("m.y").alias("y")).agg(F.sum(F.col("x") * F.col("y")).alias("xy"))
    total = rows.agg(F.count("*").alias("n"), F.count_if(F.col(a).cast("string") == F.col(b).cast("string")).alias("same"))
    po, pe = F.col("same") / F.nullif("n", F.lit(0)), F.col("xy") / F.nullif(F.col("n") * F.col("n"), F.lit(0))
    return total.crossJoin(per).select("n", F.round(po, 6).alias("agreement"), F.round(pe, 6).alias("chance"), F.round(F.when(pe < 1, (po - pe) / (1 - pe)), 6).alias("kappa"))


def confusion(pairs: DataFrame, a: str, b: str, values: list) -> DataFrame:
    return pairs.groupBy(F.col(a).alias("truth")).pivot(b, values).count().na.fill(0)


def bootstrap(rows: DataFrame, key: str, num: str, den: str, resamples: int, seed: str, strata: str | None = None) -> DataFrame:
    """One row: the ratio of sums with the 2.5 and 97.5 percentiles over resamples of the rows (clusters, or paired differences).

    rows: one row for each unit. With ``strata`` units are drawn again within each stratum. Every resample draws as many units as there
    are, so this makes resamples x units rows: for the questions, answers or clusters of an evaluation. ``poisson_bootstrap``
    does with one pass over any number of units.
    """
    by = F.col(strata).cast("string") if strata else F.lit("")
    units = numbered(rows.select(by.alias("stratum"), F.col(key).alias("_key"), num, den), ["stratum", "_key"], "i", "stratum")
    sizes = units.groupBy("stratum").agg(F.count("*").alias("n"))
    # unit i makes the i-th draw of every resample, so they are dealt like units; Spark takes draws for as few as units, so they must not be broadcast
    dealt = units.select("stratum", F.col("i").alias("p")).repartition(rows.sparkSession.sparkContext.defaultParallelism, "p")
    draws = dealt.join(F.broadcast(sizes), "stratum").withColumn("r", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(resamples - 1).cast("long"))))
    h = F.sha2(F.concat(F.lit(seed), F.col("stratum"), F.col("r").cast("string"), F.lit(":"), F.col("p").cast("string")), 256)
    picked = draws.select("r", "stratum", F.pmod(F.conv(F.substring(h, 1, 12), 16, 10).cast("long"), F.col("n")).alias("i")).join(units.select("stratum", "i", num, den).hint("shuffle_hash"), ["stratum", "i"])
    values = picked.groupBy("r").agg((F.sum(num) / F.sum(den)).alias("v"))
    return _interval(rows.agg((F.sum(num) / F.sum(den)).alias("value")), values)


def _interval(point: DataFrame, values: DataFrame) -> DataFrame:
    """value, low, high from one row and the values of the resamples."""
    spread = values.agg(F.percentile("v", 0.025).alias("low"), F.percentile("v", 0.975).alias("high"))
    return point.crossJoin(spread).select(*[F.round(c, 6).alias(c) for c in ("value", "low", "high")])  # one row each


def poisson_steps(bits: int = 16) -> list[int]:
    """From which of 2 ** bits equally likely numbers on a draw from Poisson(1) is over 0, 1, 2 ..."""
    out, term, total = [], math.exp(-1.0), 0.0
    for k in range(1, 64):
        total += term
        term /= k
        if out and math.floor(total * 2**bits) == out[-1]:
            break
        out.append(math.floor(total * 2**bits))
    return out


def poisson_bootstrap(rows: DataFrame, key: str, num: str, den: str, resamples: int, seed: str, strata: str | None = None) -> DataFrame:
    """One row: value, low, high as by ``bootstrap``, in one pass over any number of units.

    In place of drawing n of n units, each unit counts in each resample as often as a draw from Poisson(1) says. The draws are
    16 bits of SHA-256 of seed, stratum, key and the resample's number, so they need no other unit: a task adds up its
    units' weighted sums for all resamples, and only these sums are shuffled. With ``strata`` each stratum's weighted sums are
    scaled to its size, as if as many units were drawn from it as it has. Units without ``num`` or ``den`` are left out; units
    of one stratum with the same key draw alike, so keys should be unique.
    """
    by = F.col(strata).cast("string") if strata else F.lit("")
    a_digest = 16  # draws of 16 bits
    said = F.concat(F.lit(seed), F.coalesce(by, F.lit("")), F.lit(":"), F.col(key).cast("string"), F.lit(":"))
    drawn = F.concat(*[F.unhex(F.sha2(F.concat(said, F.lit(str(j))), 256)) for j in range(-(-resamples // a_digest))])
    units = rows.filter(F.col(num).isNotNull() & F.col(den).isNotNull()).select(by.alias("stratum"), F.col(num).cast("double").alias("a"), F.col(den).cast("double").alias("b"), drawn.alias("d"))
    steps = np.array(poisson_steps())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str | None, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            bits = np.frombuffer(b"".join(batch.column("d").to_pylist()), ">u2").reshape(batch.num_rows, -1)[:, :resamples]
            weights = np.searchsorted(steps, bits, side="right").astype(np.float64)
            unit = np.column_stack([*(batch.column(c).to_numpy(zero_copy_only=False) for c in "ab"), np.ones(batch.num_rows)])
            codes = batch.column("stratum").dictionary_encode()
            number = codes.indices.fill_null(len(codes.dictionary)).to_numpy(zero_copy_only=False)
            order = np.argsort(number, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(number[order])) + 1):
                s = codes[int(own[0])].as_py()
                part = np.column_stack([weights[own].T @ unit[own], np.full(resamples, float(len(own)))])
                sums[s] = sums[s] + part if s in sums else part
        for s, part in sums.items():
            yield pa.record_batch([pa.array([s] * resamples, pa.string()), pa.array(range(resamples), pa.int32()), *map(pa.array, part.T)], ["stratum", "r", "a", "b", "w", "n"])

    added = units.mapInArrow(run, "stratum string, r int, a double, b double, w double, n double").groupBy("stratum", "r").agg(*(F.sum(c).alias(c) for c in "abwn"))
    scale = F.col("n") / F.nullif("w", F.lit(0.0)) if strata else F.lit(1.0)
    values = added.groupBy("r").agg((F.sum(F.col("a") * scale) / F.nullif(F.sum(F.col("b") * scale), F.lit(0.0))).alias("v"))
    kept = rows.filter(F.col(num).isNotNull() & F.col(den).isNotNull())
    return _interval(kept.agg((F.sum(num) / F.nullif(F.sum(den), F.lit(0))).alias("value")), values)


def paired_bootstrap(rows: DataFrame, key: str, a: str, b: str, resamples: int, seed: str) -> DataFrame:
    """The mean of a - b over units with its interval: the same draws for both. Units without either are left out."""
    pairs = rows.select(key, (F.col(a) - F.col(b)).alias("num"), F.lit(1).alias("den")).filter("num is not null")
    return bootstrap(pairs, key, "num", "den", resamples, seed)


def bootstrap_total(rows: DataFrame, key: str, value: str, population: int, resamples: int, seed: str) -> DataFrame:
    """A population's total from a sample: its mean times the population, and the interval of that."""
    mean = bootstrap(rows.select(key, F.col(value).alias("num"), F.lit(1).alias("den")), key, "num", "den", resamples, seed)
    return mean.select(F.round("value", 2).alias("per_item"), *[F.round(F.col(c) * population).cast("long").alias(t) for c, t in (("value", "total"), ("low", "total_low"), ("high", "total_high"))])


def design_effect(clusters: DataFrame, key: str, num: str, den: str, resamples: int, seed: str) -> DataFrame:
    """How much wider the interval over clusters is than Wilson's over single marks, squared; with both intervals."""
    sums = clusters.agg(F.sum(num).alias("s"), F.sum(den).alias("n"))
    low, high = wilson_or_all(F.col("s"), F.col("n"))
    both = bootstrap(clusters, key, num, den, resamples, seed).crossJoin(sums.select(low.alias("wilson_low"), high.alias("wilson_high")))  # one row each
    effect = F.pow((F.col("high") - F.col("low")) / F.nullif(F.col("wilson_high") - F.col("wilson_low"), F.lit(0.0)), 2)
    return both.select("value", "low", "high", F.round("wilson_low", 6).alias("wilson_low"), F.round("wilson_high", 6).alias("wilson_high"), F.round(effect, 2).alias("design_effect"))


def abstention(questions: DataFrame, hits: DataFrame, gold: DataFrame, least: int) -> DataFrame:
    """q, gold, uncovered, single_source, would_abstain for every question, without asking a model.

    questions: q, terms (array); hits: q, item, tokens (array), the passages it would be answered from; gold: q, answerable.
    """
    seen = hits.groupBy("q").agg(F.count("*").alias("n"), F.countDistinct("item").alias("items"))
    covered = hits.select("q", F.explode("tokens").alias("term")).join(questions.select("q", F.explode("terms").alias("term")), ["q", "term"]).distinct().groupBy("q").agg(F.count("*").alias("covered"))
    rows = questions.join(seen, "q", "left").join(covered, "q", "left").join(gold, "q", "left")
    open_ = F.size("terms") - F.coalesce("covered", F.lit(0))
    said = F.when(F.col("answerable").isNotNull(), F.when(F.col("answerable") == 1, "answerable").otherwise("abstain"))
    return rows.select("q", said.alias("gold"), open_.cast("long").alias("uncovered"), (F.coalesce("items", F.lit(0)) <= 1).alias("single_source"), ((F.coalesce("n", F.lit(0)) < least) | (open_ > 0)).alias("would_abstain"))


def panel(votes: DataFrame, first: str, second: str) -> DataFrame:
    """How a pair of judges settles an item: agree, escalated where they differ, human where one is silent. votes: item, judge, vote."""
    by = votes.groupBy("item").pivot("judge", [first, second]).agg(F.first("vote"))
    a, b = F.col(first), F.col(second)
    way = F.when(a.isNull() | b.isNull(), "human").when(a == b, "agree").otherwise("escalated")
    return by.select("item", way.alias("way"), F.when(way == "agree", a).alias("final"))


def majority(votes: DataFrame) -> DataFrame:
    """item, final: the vote that at least two have cast; null where none has."""
    counts = votes.groupBy("item", "vote").agg(F.count("*").alias("n"))
    best = counts.groupBy("item").agg(F.max(F.struct("n", "vote")).alias("m"))
    return best.select("item", F.when(F.col("m.n") >= 2, F.col("m.vote")).alias("final"))


def silver(votes: DataFrame, judges: int) -> DataFrame:
    """item, label where all references have voted alike."""
    per = votes.groupBy("item").agg(F.count("*").alias("n"), F.countDistinct("vote").alias("k"), F.min("vote").alias("v"))
    return per.select("item", F.when((F.col("n") == judges) & (F.col("k") == 1), F.col("v")).alias("label"))


def failed_bars(row: DataFrame, bars: dict[str, tuple[str, float]]) -> DataFrame:
    """The names of the bars that a row of measures misses. bars: name -> (measure, least)."""
    reasons = F.array_compact(F.array(*[F.when(F.col(m).isNull() | (F.col(m) < least), name) for name, (m, least) in bars.items()]))
    return row.select("*", reasons.alias("reasons"), (F.size(reasons) == 0).alias("passed"))
