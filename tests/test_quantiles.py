"""Exact quantiles: the search against numpy, with its limits lowered so that it has to work."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import quantiles

PROBS = [0, 0.01, 0.25, 0.5, 0.75, 0.99, 1]


def values(kind):
    rng = random.Random(5)
    if kind == "skewed":  # a tie of a third of the rows inside a heavy tail
        return [rng.lognormvariate(0, 3) for _ in range(4000)] + [2.5] * 2000
    if kind == "equal":
        return [7.0] * 500
    if kind == "two":
        return [1.0] * 999 + [2.0]
    if kind == "small":
        return [3.0, 1.0, 2.0]
    return [float(rng.randrange(-10**6, 10**6)) for _ in range(5000)]


@pytest.mark.parametrize("kind", ["skewed", "equal", "two", "small", "spread"])
@pytest.mark.parametrize("few, small", [(10**6, 10**5), (0, 50), (0, 10**5)])
def test_against_numpy(spark, monkeypatch, kind, few, small):
    monkeypatch.setattr(quantiles, "FEW_DISTINCT", few)
    monkeypatch.setattr(quantiles, "SMALL", small)
    data = values(kind)
    df = spark.createDataFrame([(v,) for v in data], "v DOUBLE").repartition(4)
    found = quantiles.exact_quantiles(df, {"v": F.col("v")}, PROBS)["v"]
    assert found == pytest.approx(list(np.quantile(data, PROBS)), rel=1e-12, abs=1e-12)


def test_missing_values_and_many_columns(spark):
    df = spark.createDataFrame([(1, None, 5.0), (3, None, None), (2, None, 7.0)], "a BIGINT, b DOUBLE, c DOUBLE")
    found = quantiles.exact_quantiles(df, {n: F.col(n) for n in "abc"}, [0.5])
    assert found == {"a": [2.0], "b": [None], "c": [6.0]}
    assert quantiles.exact_quantiles(df, {}, [0.5]) == {}


def test_a_sketch_that_misses_is_noticed():
    """Ranks outside the interval reopen it instead of giving a wrong answer."""
    search = quantiles._Search(F.lit(1.0), [500], 1000, low=10.0, high=20.0)
    assert search.narrow(below=600, at_low=1, inner=50, at_high=1, grid=None) is None
    assert (search.low, search.high, search.found) == (None, None, {})
    assert search.margin == 8
