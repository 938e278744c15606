import numpy as np
import pytest
from pyspark.sql import functions as F

from tablesmith.operators import quantiles
from tablesmith.operators.quantiles import exact_quantiles, grouped_median, order_statistics

PROBS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]


def _columns(n=20_000):
    rng = np.random.default_rng(7)
    hot = np.where(rng.random(n) < 0.4, 5.0, rng.normal(0, 100, n))
    return {
        "plain": rng.normal(0, 1, n),
        "hot": hot,
        "heavy": np.exp(rng.normal(0, 8, n)),
        "few": rng.integers(0, 3, n).astype(float),
        "constant": np.full(n, 2.5),
    }


@pytest.mark.parametrize("direct", [10**9, 0])
def test_matches_linear_interpolation(spark, direct, monkeypatch):
    monkeypatch.setattr(quantiles.order_statistics, "__defaults__", (500,))
    data = _columns()
    df = spark.createDataFrame(list(zip(*[v.tolist() for v in data.values()])), list(data))
    got = exact_quantiles(df, list(data), PROBS, direct_cells=direct)
    for name, values in data.items():
        assert got[name] == pytest.approx(np.quantile(values, PROBS).tolist(), rel=1e-12), name


def test_small_and_empty_columns(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, None), (3.0, None), (10.0, None), (None, None)], "v double, e double")
    for direct in (10**9, 0):
        got = exact_quantiles(df, ["v", "e"], [0.25, 0.75], direct_cells=direct)
        assert got == {"v": [1.75, 4.75], "e": [None, None]}
    assert exact_quantiles(df.limit(0), ["v"], [0.5]) == {"v": [None]}


def test_ranks_of_skewed_groups(spark):
    rng = np.random.default_rng(3)
    values = {"big": rng.normal(0, 1, 9_000), "same": np.full(4_000, 1.0), "one": np.array([4.0])}
    rows = [(k, float(x)) for k, v in values.items() for x in v]
    df = spark.createDataFrame(rows, "g string, x double")
    ranks = spark.createDataFrame(
        [(k, r, len(v)) for k, v in values.items() for r in {0, len(v) // 3, len(v) - 1}], "key string, rank bigint, size bigint"
    )
    got = {(r.key, r.rank): r.answer for r in order_statistics(df, "g", "x", ranks, gather_rows=200).collect()}
    for k, v in values.items():
        for r in {0, len(v) // 3, len(v) - 1}:
            assert got[k, r] == np.sort(v)[r]


@pytest.mark.parametrize("direct", [10**9, 0])
def test_grouped_median(spark, direct):
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), (F.col("id") * 1.5).alias("x"))
    got = {r.g: r.value for r in grouped_median(df, "g", "x", direct_rows=direct).collect()}
    for g in range(3):
        assert got[g] == np.median([i * 1.5 for i in range(1000) if i % 3 == g])
