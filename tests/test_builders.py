"""Builders that the registered queries don't show whole."""

import bisect
import random

import pytest

from linkscape.operators import builders as L


def test_land_cover_of_any_number_and_width_of_classes(spark):
    r = random.Random(3)
    edges = sorted({round(r.uniform(-50, 50), 3) for _ in range(600)} | {r.uniform(0, 1e-6) for _ in range(100)} | {float(2**k) for k in range(7, 40, 3)})
    classes = [(a, a if k % 7 == 0 else a + (b - a) / 2, k) for k, (a, b) in enumerate(zip(edges, edges[1:]))]
    classes += [(float("-inf"), -60.0, -1), (float(2**50), float("inf"), -2), (5.5e5, 5.4e5, -3), (None, 1.0, -4)]
    values = [r.choice(edges) for _ in range(200)] + [r.uniform(-70, 70) for _ in range(300)] + [r.uniform(0, 1e-6) for _ in range(100)] + [-1e300, 1e300, 3e10, None, 0.0, -0.0]
    cells = spark.createDataFrame(list(enumerate(values)), "id long, value double")
    found = L.land_cover(cells, spark.createDataFrame(classes, "low double, high double, class long"))
    assert found.columns == ["id", "value", "class"] and "NestedLoop" not in found._jdf.queryExecution().toString()
    want = {(i, k) for i, v in enumerate(values) if v is not None for low, high, k in classes if low is not None and low <= v <= high}
    assert {(x["id"], x["class"]) for x in found.collect()} == want and len(want) > 300 and found.count() == len(want)


def test_hundred_thousand_classes(spark):
    classes = spark.range(100_000).selectExpr("id * 10 as low", "id * 10 + id % 10 as high", "concat('c', id) as class")
    cells = spark.range(50_000).selectExpr("id", "(id * 7919) % 1000000 as value")
    found = L.land_cover(cells, classes)
    assert "NestedLoop" not in found._jdf.queryExecution().toString()
    lows = list(range(0, 1_000_000, 10))
    want = set()
    for i in range(50_000):
        v = i * 7919 % 1_000_000
        k = bisect.bisect_right(lows, v) - 1
        if v <= lows[k] + k % 10:
            want.add((i, f"c{k}"))
    assert {(x["id"], x["class"]) for x in found.select("id", "class").collect()} == want


def test_no_classes(spark):
    assert L.land_cover(spark.range(3).selectExpr("id", "id as value"), spark.createDataFrame([], "low long, high long, class string")).collect() == []


@pytest.mark.parametrize("split", ["full", "sqrt"])
def test_split_cells(spark, split):
    vertices, arcs = L.split_cells(spark.createDataFrame([("a", 2.0, 0.25)], "id string, quality double, probability double"), split)
    assert sorted(map(tuple, vertices.collect())) == [("a", 2.0, 2.0), ("a_in", 0.0, 0.0), ("a_out", 0.0, 0.0)]
    p = 0.25 if split == "full" else 0.5
    assert sorted(map(tuple, arcs.collect())) == [("a>a_out", "a", "a_out", p), ("a_in>a", "a_in", "a", p)]
    with pytest.raises(ValueError):
        L.split_cells(vertices, "half")
