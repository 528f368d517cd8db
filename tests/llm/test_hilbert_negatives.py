import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from feltmill.llm import hilbert_negatives, queries

COLUMNS = "vec_id long, embedding array<float>, label int, __id string, __block int, __label string, rank int"


def brute_force(rows):
    """The query's rows for (vec_id, embedding, label) by scoring all pairs."""
    fit = []
    for i, v, y in rows:
        if i is not None and y is not None and v and all(x is not None and math.isfinite(x) for x in v):
            reach = hilbert_negatives.REACH
            fit.append((i, [math.floor(256 * min(max(float(np.float32(x)), -reach), reach)) for x in v], (y + 1) % 10 if i % 7 == 0 else y))
    out = []
    for i, own, y in fit:
        if i % 100:
            continue
        others = [(-sum(a * b for a, b in zip(own, v, strict=True)), j, z) for j, v, z in fit if j != i and len(v) == len(own)]
        for score, j, _ in sorted(o for o in others if o[2] == y)[:5]:
            p = -score
            window = sorted((s, k) for s, k, z in others if z != y and 80 * p <= -100 * s <= 100 * p)[:5]
            out += [(i, j, r, k, p, -s) for r, (s, k) in enumerate(window, 1)]
    return sorted(out)


def mined(spark, rows, **sizes):
    frame = spark.createDataFrame([(i, v, y, "x", 1, "y", 2) for i, v, y in rows], COLUMNS).repartition(3)
    found = hilbert_negatives.hard_negatives(queries.anchor_rows(frame), F.col("__id") % 100 == 0, **sizes)
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in found.select(names).collect())


@pytest.fixture(scope="module")
def rows():
    """Groups of near copies across labels, exact copies, and vectors without structure."""
    rng = np.random.default_rng(4)
    centres, out = rng.standard_normal((12, 8)) / 3, []
    for i in range(1200):
        kind = rng.integers(4)
        vector = rng.standard_normal(8) / 3 if kind == 0 else centres[rng.integers(12)] + (0.02 * rng.standard_normal(8) if kind < 3 else 0)
        out.append((i, vector.astype(np.float32).tolist(), int(rng.integers(10))))
    return out


@pytest.mark.parametrize("sizes", [{}, {"block": 16, "pack": 3}])
def test_negatives_are_those_of_all_pairs(spark, rows, sizes):
    assert mined(spark, rows, **sizes) == brute_force(rows)


def test_zone_maps_rule_blocks_out(spark):
    """Where vectors lie in groups, bounds hold and rule most blocks out."""
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((20, 8)) / 3
    rows = [(i, (centres[rng.integers(20)] + 0.005 * rng.standard_normal(8)).astype(np.float32).tolist(), 1) for i in range(2000)]
    units = hilbert_negatives.whole_numbers(F.col("embedding"))
    frame = spark.createDataFrame([(i, v, y) for i, v, y in rows], "__id long, embedding array<float>, __label int").select("__id", units.alias("__vector"), "__label")
    blocks = hilbert_negatives.packed(frame, 16, "test-blocks").collect()
    assert sum(len(b["__ids"]) for b in blocks) == len(rows)
    least, most, met = [], [], 0
    for b in blocks:
        matrix = np.array(b["__matrix"]).reshape(len(b["__ids"]), -1)
        assert matrix.min(axis=0).tolist() == b["__low"] and matrix.max(axis=0).tolist() == b["__high"]
        own = np.array(blocks[0]["__matrix"]).reshape(len(blocks[0]["__ids"]), -1).astype(np.int64)
        low, high = hilbert_negatives.bounds(own, matrix.min(axis=0)[None], matrix.max(axis=0)[None])
        scores = own @ matrix.T
        assert (low[:, 0] <= scores.min(axis=1)).all() and (high[:, 0] >= scores.max(axis=1)).all()
        least, most, met = [*least, low[0, 0]], [*most, high[0, 0]], met + len(matrix)
    wanted = sorted(least)[-3]
    assert sum(h >= wanted for h in most) < len(blocks) / 2


def test_edge_rows(spark):
    one, nan, inf = [0.5, -0.25, 1.0], float("nan"), float("inf")
    rows = [(i, one, i % 2) for i in range(1, 60)] + [
        (100, one, 1), (100, one, 1), (200, [-0.5, 0.25, -1.0], 0), (300, None, 1), (400, one, None), (500, [], 1), (600, [nan, 0.0, 1.0], 1),
        (800, [1.0, None, 1.0], 1), (None, one, 1), (900, [1.0, 1.0], 3), (901, [1.0, 1.0], 3), (902, [1.0, 0.9], 4), (1000, [0.0, 0.0, 0.0], 1),
        (1100, [inf, 1.0, 1.0], 0), (1200, [3e38, 0.0, 0.0], 5), (1201, [3e38, 0.0, 0.0], 5), (1203, [2e38, 0.0, 0.0], 6),
    ]
    assert mined(spark, rows) == brute_force(rows)


def test_an_empty_table(spark):
    assert mined(spark, []) == []


@pytest.mark.parametrize(("width", "levels"), [(2, 1), (2, 4), (3, 3), (4, 2), (1, 4)])
def test_neighbours_on_the_curve_are_neighbours(width, levels):
    points = np.array(list(itertools.product(range(1 << levels), repeat=width)))
    keys = [k.tobytes() for k in hilbert_negatives.hilbert_keys(points, levels)]
    assert len(set(keys)) == len(points)
    path = points[sorted(range(len(points)), key=keys.__getitem__)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()
