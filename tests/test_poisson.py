"""The one-pass bootstrap against its own definition in plain Python, and against the exact draws."""

import hashlib
import random
import statistics

import numpy as np
from pyspark.sql import functions as F

from pressmark.operators import evaluation as E


def plain(units, resamples, seed, scaled):
    steps = E.poisson_steps()
    values = []
    for r in range(resamples):
        by = {}
        for s, u, a, b in units:
            x = int(hashlib.sha256(f"{seed}{s}:{u}:{r // 16}".encode()).hexdigest()[4 * (r % 16) :][:4], 16)
            w = sum(x >= t for t in steps)
            n, k, p, q = by.get(s, (0, 0, 0, 0))
            by[s] = (n + 1, k + w, p + w * a, q + w * b)
        f = {s: n / k if scaled else 1 for s, (n, k, *_) in by.items() if k}
        values.append(sum(by[s][2] * f[s] for s in f) / sum(by[s][3] * f[s] for s in f))
    low, high = np.percentile(values, [2.5, 97.5])
    return round(sum(u[2] for u in units) / sum(u[3] for u in units), 6), round(float(low), 6), round(float(high), 6)


def test_as_defined(spark):
    rng = random.Random(1)
    units = [(rng.choice("ab"), f"u{k}", rng.random(), rng.randrange(1, 5)) for k in range(150)]
    df = spark.createDataFrame([(s, u, float(a), b) for s, u, a, b in units] + [("a", "none", None, 1)], "s string, u string, a double, b int").repartition(4)
    assert tuple(E.poisson_bootstrap(df, "u", "a", "b", 50, "x", strata="s").first()) == plain(units, 50, "x", True)
    assert tuple(E.poisson_bootstrap(df, "u", "a", "b", 50, "x").first()) == plain([("", *u[1:]) for u in units], 50, "x", False)
    assert tuple(E.poisson_bootstrap(df.limit(0), "u", "a", "b", 50, "x").first()) == (None, None, None)


def test_draws_are_poisson():
    steps = E.poisson_steps()
    draws = [sum(x >= t for t in steps) for x in range(1 << 16)]
    assert abs(statistics.mean(draws) - 1) < 1e-3 and abs(statistics.pvariance(draws) - 1) < 2e-3


def test_as_wide_as_the_exact_draws_and_without_a_join(spark):
    df = spark.range(400).select("id", F.pow(F.rand(3), 2).alias("a"), F.lit(1).alias("b"))
    exact, one_pass = E.bootstrap(df, "id", "a", "b", 300, "e").first(), E.poisson_bootstrap(df, "id", "a", "b", 300, "e").first()
    assert exact.value == one_pass.value and abs((one_pass.high - one_pass.low) / (exact.high - exact.low) - 1) < 0.2
    plan = E.poisson_bootstrap(df, "id", "a", "b", 300, "e")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1  # of two rows at the end
