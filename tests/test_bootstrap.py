"""Bootstrap intervals drawn in Spark, against plain draws from the same numbers."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataforge.operators import metrics


def plain(cells, seed, draws):
    """Each draw by the binomial's distribution function, summed from whole-number binomials."""
    by_draw = []
    for draw in range(1, draws + 1):
        by = {}
        for (t, c), (n, ok) in cells.items():
            u = int(hashlib.md5(f"{seed}:{draw}:{t}:{c}".encode()).hexdigest()[:13], 16) / 2**52
            p, total, k = ok / n, 0.0, -1
            while k < n and (k < 0 or total < u):
                k += 1
                total += math.comb(n, k) * p**k * (1 - p) ** (n - k)
            by.setdefault(t, []).append(k / n)
        by_draw.append(np.mean([np.mean(v) for v in by.values()]))
    value = {}
    for (t, _), (n, ok) in cells.items():
        value.setdefault(t, []).append(ok / n)
    return (np.mean([np.mean(v) for v in value.values()]), *np.percentile(by_draw, [2.5, 97.5]))


def answers(spark, cells):
    rows = [(t, c, i < ok) for (t, c), (n, ok) in cells.items() for i in range(n)]
    return spark.createDataFrame(rows, "t string, c int, ok boolean")


def test_bootstrap_is_the_plain_one(spark):
    cells = {("a", 1): (40, 31), ("a", 2): (7, 2), ("b", 1): (25, 25), ("b", 3): (3, 0), ("b", 4): (1, 1), ("c", 9): (120, 60)}
    got = metrics.bootstrap(answers(spark, cells), "t", "c", F.col("ok"), 5, 200).collect()
    assert len(got) == 1
    assert tuple(got[0]) == pytest.approx(plain(cells, 5, 200), abs=1e-12)
    again = metrics.bootstrap(answers(spark, cells).repartition(7), "t", "c", F.col("ok"), 5, 200).first()
    assert tuple(again) == pytest.approx(tuple(got[0]), abs=1e-12)


def test_bootstrap_table_of_a_large_cell(spark):
    n, ok = 2_000_000_000, 600_000_000
    table = metrics.binomial_table(spark.createDataFrame([(1, n, ok)], "cell int, n bigint, ok bigint"), ["cell"]).toPandas().sort_values("k")
    sd = math.sqrt(ok * (1 - ok / n))
    assert len(table) < 25 * sd + 30
    for z, want in ((-1.959964, 0.025), (0.0, 0.5), (1.959964, 0.975)):
        assert table["below"].to_numpy()[np.searchsorted(table["k"].to_numpy(), ok + z * sd)] == pytest.approx(want, abs=1e-4)
    assert table["below"].is_monotonic_increasing and table["below"].iloc[-1] == 1.0


def test_bootstrap_nulls_and_nothing(spark):
    rows = spark.createDataFrame([("a", 1, True), ("a", 1, None), (None, 1, True), ("a", None, True)], "t string, c int, ok boolean")
    assert metrics.bootstrap(rows, "t", "c", F.col("ok"), 0, 50).first()["value"] == 0.5
    assert tuple(metrics.bootstrap(rows.limit(0), "t", "c", F.col("ok"), 0, 50).first()) == (None, None, None)
