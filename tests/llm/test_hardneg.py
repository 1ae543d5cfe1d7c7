"""Hard negatives against brute force over all anchors and rows."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.llm import hardneg
from folioscope.llm.hardneg import HardNegativeSpec

SCHEMA = "vec_id long, embedding array<float>, label int, rank string"
SMALL = HardNegativeSpec(rows=32, anchors=4, dims=8, chunks=3, reach=2, groups=8)


def brute(rows, spec=HardNegativeSpec(), is_anchor=lambda i: i % 100 == 0):
    one = {}
    for i, v, label, _ in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        q = [math.floor(spec.scale * float(np.float32(x))) for x in v]
        one[i] = min(one.get(i, (label, q)), (label, q))
    out = []
    for a, (label, q) in one.items():
        if not is_anchor(a):
            continue
        scored = sorted((-sum(x * y for x, y in zip(q, v)), i, other) for i, (other, v) in one.items() if i != a)
        for s, i, _ in [x for x in scored if x[2] == label][:spec.positives]:
            fit = [(n, -t) for t, n, other in scored if other != label and spec.low * -s <= 100 * -t <= spec.high * -s][:spec.negatives]
            out += [(a, i, k + 1, n, -s, t) for k, (n, t) in enumerate(fit)]
    return sorted(out)


def made(n, dim, seed):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(4, dim))
    label = np.where(rng.random(n) < 0.4, 7, rng.integers(0, 9, n))  # one label has much of the rows
    v = np.round((centre[rng.integers(0, 4, n)] + rng.normal(size=(n, dim)) * 0.4) / 4, 1)  # coarse: many ties
    return [(i * 5, [float(x) for x in v[i]], int(label[i]), "own") for i in range(n)]


def test_blocks_chunks_and_windows_against_brute_force(spark):
    rows = made(700, 30, 1)
    rows += [(200, None, 1, None), (10_003, [float("nan")] * 30, 1, None), (10_100, [float("inf")] * 30, 1, None), (10_200, [None, 0.5], 1, None), (10_300, [0.5], None, None),
             (None, [0.5], 3, None), (10_400, [0.9, 0.1], 3, None), (10_500, [], 3, None), rows[20], (0, [0.1], 9, None), (100, [0.1], 0, None)]
    random.Random(1).shuffle(rows)
    got = hardneg.hard_negatives(spark.createDataFrame(rows, SCHEMA).repartition(5), F.col("vec_id") % 100 == 0, SMALL)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = brute(rows)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 200
    more = HardNegativeSpec(positives=3, negatives=2, low=50, high=90, scale=16)
    got = hardneg.hard_negatives(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 50 == 0, more)
    assert sorted(map(tuple, got.collect())) == brute(rows, more, lambda i: i % 50 == 0)


def test_nothing_and_no_partner(spark):
    for rows in ([], [(0, [1.0], 1, None)], [(0, [1.0], 1, None), (1, [1.0], 1, None)], [(0, [1.0], 1, None), (1, [1.0], 2, None)], [(5, [1.0], 1, None), (6, [1.0], 1, None)]):
        assert hardneg.hard_negatives(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 100 == 0).collect() == []


def test_partial_tiles_add_up_exactly():
    import pandas as pd

    rng = np.random.default_rng(2)
    for most in (100, 2**30 - 1):  # by doubles, and beyond their exact range
        a, b = (rng.integers(-most, most, size=(n, 4)) for n in (3, 5))
        parts = []
        for c in range(2):
            row = lambda m, block: [block, c, list(range(len(m))) if c == 0 else None, [0] * len(m) if c == 0 else None, 2, "<i8", np.ascontiguousarray(m[:, 2 * c:2 * c + 2]).tobytes(), None, None, None]  # noqa: E731, B023
            parts.append(hardneg._multiplied((), pd.DataFrame([row(a, 0)], columns=hardneg._names(hardneg.BLOCK)), pd.DataFrame([row(b, 1)], columns=hardneg._names(hardneg.BLOCK))))
        tile, _ = hardneg._summed(pd.concat(parts[::-1], ignore_index=True))
        assert tile.tolist() == [[sum(int(x) * int(y) for x, y in zip(p, q)) for q in b] for p in a]
    huge = pd.DataFrame([[0, 0, [0], [0], 1, "<i8", np.array([2**40]).tobytes(), None, None, None]], columns=hardneg._names(hardneg.BLOCK))
    with pytest.raises(ValueError):
        hardneg._multiplied((), huge, huge)
