import math

import numpy as np
import pytest

from feltmill.llm import sign_hash_links

COLUMNS = "vec_id long, embedding array<float>, label int, __class string, n_links string, __row int, component_id string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, y, "c", "n", 1, "x") for i, v, y in rows], COLUMNS).repartition(3)


def brute_force(rows, threshold=sign_hash_links.THRESHOLD):
    """Sorted (vec_id, n_links, component_id, kept) by comparing all pairs."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0]))
    fit = [y is not None and v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v, y in rows]
    units = [sign_hash_links.unit_rows(np.array([v], np.float32).astype(np.float64))[0] if ok else None for (_, v, _), ok in zip(rows, fit, strict=True)]
    near = [[] for _ in rows]
    for a in range(len(rows)):
        for b in range(a):
            if fit[a] and fit[b] and rows[a][2] == rows[b][2] and len(units[a]) == len(units[b]) and units[a] @ units[b] >= threshold:
                near[a].append(b)
                near[b].append(a)
    out, seen = [None] * len(rows), set()
    for start in range(len(rows)):
        if start in seen:
            continue
        group, todo = {start}, [start]
        while todo:
            for k in near[todo.pop()]:
                if k not in group:
                    group.add(k)
                    todo.append(k)
        seen |= group
        least = min((rows[k][0] for k in group if rows[k][0] is not None), default=None)
        for k in group:
            out[k] = (rows[k][0], len(near[k]), least, rows[k][0] is not None and rows[k][0] == least)
    return sorted(out, key=str)


def found(spark, rows, **kwargs):
    got = sign_hash_links.link_vectors(frame(spark, rows), **kwargs).select("__row.vec_id", "n_links", "component_id", "kept")
    return sorted((tuple(r) for r in got.collect()), key=str)


@pytest.mark.parametrize("tile", [512, 7])
def test_links_and_components_are_those_of_all_pairs(spark, tile):
    rng = np.random.default_rng(3)
    centres, rows = rng.standard_normal((30, 16)), []
    for i in range(400):
        spread = rng.choice([0.0, 0.05, 0.2, 0.25])
        rows.append((i, (centres[rng.integers(30)] + spread * rng.standard_normal(16)).astype(np.float32).tolist(), int(rng.integers(2))))
    # pairs this close to the threshold would hang on the last bit
    want = brute_force(rows)
    assert sum(r[1] for r in want) > 1000
    assert found(spark, rows, recall=0.999999, tile=tile) == want


def test_edge_rows_and_a_hot_vector(spark):
    one, nan, inf = [1.0, 0.0, 0.5], float("nan"), float("inf")
    rows = [(i, one, 1) for i in range(100, 160)] + [
        (1, None, 1), (2, [], 1), (3, [0.0, 0.0, 0.0], 1), (4, [1.0, None, 0.5], 1), (5, [nan, 0.0, 1.0], 1), (6, [inf, 0.0, 1.0], 1),
        (7, one, None), (8, one, 2), (8, one, 2), (9, [3e38, 0.0, 1.5e38], 2), (10, [1e-30, 0.0, 5e-31], 2), (None, one, 2), (None, [0.0, 1.0, 0.0], 3),
        (11, [1.0, 0.0, 0.5, 0.0], 2), (12, [-1.0, 0.0, -0.5], 2),
    ]
    assert found(spark, rows) == brute_force(rows)


def test_an_empty_table(spark):
    assert found(spark, []) == []


def test_tables_follow_the_size_of_the_largest_label():
    small, large = sign_hash_links.table_plan(1_000), sign_hash_links.table_plan(1_000_000)
    assert small[0] < large[0] and small[1] + 9 <= large[1] <= small[1] + 10
    for tables, signs in (small, large):
        meet = (1 - math.acos(0.93) / math.pi) ** signs
        assert 1 - (1 - meet) ** tables >= 0.999
    assert sign_hash_links.table_plan(0)[1] == 4
