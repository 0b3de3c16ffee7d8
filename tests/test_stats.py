import math
import random

import numpy as np
import pytest

from strandloom.operators import stats
from table_rows import rows

Q = (0.0, 0.001, 0.25, 0.5, 0.9, 1.0)


@pytest.mark.parametrize("held", [0, 1 << 18])
def test_quantiles_are_exact(spark, held):
    seed = random.Random(7)
    groups = {"many": [seed.gauss(0, 1) for _ in range(3000)], "ties": [float(seed.randrange(4)) for _ in range(500)] + [9.5], "hot": [1.0] * 400 + [0.5, 2.5], "one": [3.25], None: [1.0, 2.0]}
    df = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in [*vs, None]] + [("none", None)], "k string, v double")
    got = {(r.k, r.level): r.value for r in stats.quantiles(df, "v", Q, ["k"], held).collect()}
    assert set(got) == {(k, q) for k in groups for q in Q}
    for (k, q), v in got.items():
        assert math.isclose(v, float(np.quantile(groups[k], q)), rel_tol=1e-12, abs_tol=1e-12)
    whole = [v for vs in groups.values() for v in vs]
    for r in stats.quantiles(df, "v", Q, held=held).collect():
        assert math.isclose(r.value, float(np.quantile(whole, r.level)), rel_tol=1e-12, abs_tol=1e-12)
    assert stats.quantiles(df.limit(0), "v", Q, held=held).count() == 0


def test_describe(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 2.0), ("a", 4.0), ("b", None)], "k string, v double")
    assert rows(stats.describe(df, "v", ["k"]), "k", "count", "min", "q25", "q50", "q75", "max") == [("a", 1, 4.0, 4.0, 4.0, 4.0, 4.0), ("b", 0, None, None, None, None, None), (None, 2, 1.0, 1.25, 1.5, 1.75, 2.0)]
    assert rows(stats.describe(df, "v"), "count", "q50", "max") == [(3, 2.0, 4.0)]
    assert rows(stats.describe(df.limit(0), "v"), "count", "q50") == [(0, None)]


def test_thresholds(spark):
    df = spark.createDataFrame([(0.1, 0.2, 0.0), (0.3, 0.4, 0.5), (math.nan, 0.6, 0.5)], "p_excess double, p_depletion double, p double")
    got = {(r.direction, r.calibration): (r.threshold, r.recommended) for r in stats.thresholds(df, (0.5,)).collect()}
    assert got == {("excess", "all"): (0.2, True), ("excess", "positive"): (0.3, False), ("depletion", "all"): (0.4, False), ("depletion", "positive"): (0.5, True)}
