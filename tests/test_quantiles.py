"""Percentiles with outliers, and the bootstrap's two ways."""

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from spanfinder.operators import quantiles as q


def test_only_small_bins_are_sorted_whatever_the_outliers(spark):
    rng = random.Random(3)
    groups = {
        "outlier": [rng.random() for _ in range(3000)] + [1e12],
        "both": [rng.gauss(0, 1) for _ in range(1000)] + [1e308, -1e308, math.inf, -math.inf, math.nan],
        "steps": [10.0**i for i in range(-300, 300)],
        "same": [7.0] * 2000,
        None: [float(i % 10) for i in range(500)],
    }
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g string, v double").repartition(4)
    p = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    got = {r["g"]: r for r in q.nearest_rank(df, ["g"], "v", p, None, rows=20).collect()}
    for g, vs in groups.items():
        ranked = sorted(vs, key=lambda x: (math.isnan(x), x))
        for name, share in p.items():
            want = ranked[min(len(ranked) - 1, int(len(ranked) * share))]
            assert got[g][name] == want or math.isnan(want) and math.isnan(got[g][name]), (g, name)
        assert got[g]["n"] == len(vs)
    counted = df.groupBy("g", F.col("v").alias("_v")).agg(F.count("*").alias("_c"))
    assert q.wanted_bins(counted, ["g"], p, 20).agg(F.max("_m")).first()[0] <= 20
    assert q.nearest_rank(df.limit(0), ["g"], "v", p).count() == 0


def bootstrap(deltas, n, seed):
    order = [d for _, d in sorted(deltas.items(), key=lambda kv: (hashlib.md5(str(kv[0]).encode()).hexdigest(), kv[0]))]
    m = len(order)
    means = sorted(sum(order[int(hashlib.md5(f"{seed}:{r}:{i}".encode()).hexdigest()[:8], 16) % m] for i in range(m)) / m for r in range(n))
    return m, sum(order) / m, means[int(0.025 * (n - 1))], means[int(0.975 * (n - 1))]


@pytest.mark.parametrize("most", [1 << 20, 5])
def test_bootstrap_with_and_without_a_join(spark, monkeypatch, most):
    monkeypatch.setattr(q, "MOST_DELTAS", most)
    rng = random.Random(5)
    groups = {g: {k: rng.gauss(0.1, 0.3) for k in range(size)} for g, size in (("a", 30), ("b", 7), (None, 4), ("one", 1))}
    df = spark.createDataFrame([(g, k, d) for g, ds in groups.items() for k, d in ds.items()] + [("a", 99, None)], "g string, k long, delta double")
    got = {r["g"]: r for r in q.paired_bootstrap(df, ["g"], "k", n=40, seed=3).collect()}
    for g, ds in groups.items():
        want = bootstrap(ds, 40, 3)
        assert got[g]["m"] == want[0] and all(abs(x - y) < 1e-12 for x, y in zip((got[g]["mean"], got[g]["lo"], got[g]["hi"]), want[1:], strict=True))
        assert got[g]["significant"] == (want[2] > 0 or want[3] < 0)
    alone = q.paired_bootstrap(df.where("g = 'a'"), [], "k", n=40, seed=3).first()
    assert abs(alone["lo"] - bootstrap(groups["a"], 40, 3)[2]) < 1e-12
