import random

import numpy as np
import pytest

from folioscope.operators.quantile import percentile


@pytest.mark.parametrize("share,bins", [(0.78, 1024), (0.5, 4), (0.0, 3), (1.0, 3)])
def test_percentiles_are_exact(spark, share, bins):
    rng = random.Random(7)
    groups = {"a": [rng.gauss(0, 1) for _ in range(300)], "ties": [1.0] * 50 + [2.0] * 50, "one": [3.5], "two": [-1.0, 5.0], "same": [0.25] * 40, None: [float(i) for i in range(11)], "far": [1e-9, 1.0, 1e12, -1e12, 2.0]}
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("a", None), ("a", float("nan")), ("a", float("inf")), ("none", None)]
    got = {r["g"]: (r["percentile"], r["n"]) for r in percentile(spark.createDataFrame(rows, "g string, v double").repartition(3), "g", "v", share, bins).collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        assert got[g][0] == pytest.approx(np.percentile(vs, 100 * share), rel=1e-9, abs=1e-12) and got[g][1] == len(vs)


def test_no_values(spark):
    assert percentile(spark.createDataFrame([], "g string, v double"), "g", "v", 0.5).collect() == []
