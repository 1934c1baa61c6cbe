"""Components and reach, against brute force and on graphs of great length, with jobs counted."""

import random

import pytest
from pyspark.sql import functions as F

from linkscape.operators import simplify as M
from tests.test_landscape import landscape

ARCS = "case_id string, src string, dst string"
VERTICES = "case_id string, vertex_id string"


def reached(arcs, start):
    """Vertices at the end of a path from those of ``start``, themselves included."""
    seen, todo = set(start), list(start)
    while todo:
        x = todo.pop()
        for a, b in arcs:
            if a == x and b not in seen:
                seen.add(b)
                todo.append(b)
    return seen


@pytest.fixture(scope="module")
def graphs():
    """Cases of random graphs, from nearly empty ones to dense ones, with chains, rings and loops."""
    r, graphs = random.Random(5), {}
    for k in range(24):
        names = [f"v{i:02}" for i in r.sample(range(100), 14)]
        arcs = {(r.choice(names), r.choice(names)) for _ in range(r.choice([8, 14, 20, 30]))}
        if k % 2:
            line = r.sample(names, 9)
            arcs |= set(zip(line, line[1:], strict=False))
        if k % 3 == 0:
            ring = r.sample(names, 5)
            arcs |= set(zip(ring, ring[1:] + ring[:1], strict=True))
        graphs[f"g{k:02}"] = (names, sorted(arcs))
    return graphs


def test_components_equal_brute_force(spark, graphs, monkeypatch):
    vertices = spark.createDataFrame([(c, v) for c, (names, _) in graphs.items() for v in names], VERTICES)
    arcs = spark.createDataFrame([(c, a, b) for c, (_, pairs) in graphs.items() for a, b in pairs * 2], ARCS)
    want = set()
    for c, (names, pairs) in graphs.items():
        ahead = {v: reached(pairs, [v]) for v in names}
        want |= {(c, v, min(w for w in names if w in ahead[v] and v in ahead[w])) for v in names}
    for trims in (M.TRIMS, 1):
        monkeypatch.setattr(M, "TRIMS", trims)
        got = M.strong_components(vertices, arcs).collect()
        assert len(got) == len(want) and {(r.case_id, r.vertex_id, r.component) for r in got} == want
    assert M.strong_components(vertices.limit(0), arcs.limit(0)).collect() == []
    assert {r.component for r in M.strong_components(vertices.where("case_id = 'g00'"), arcs.limit(0)).collect()} == set(graphs["g00"][0])


def test_labels_equal_brute_force(spark, graphs):
    r = random.Random(6)
    labels = {(c, v): r.randrange(40) for c, (names, _) in graphs.items() for v in names}
    frame = spark.createDataFrame([(c, v, x) for (c, v), x in labels.items()], "case_id string, vertex_id string, label int")
    arcs = spark.createDataFrame([(c, a, b) for c, (_, pairs) in graphs.items() for a, b in pairs if a != b], "c string, src string, dst string")
    want = {(c, v): min(labels[c, u] for u in names if v in reached(pairs, [u])) for c, (names, pairs) in graphs.items() for v in names}
    got = M._spread(frame, arcs).collect()
    assert len(got) == len(want) and {(r.case_id, r.vertex_id): r.label for r in got} == want


def test_unfed_parts_go(spark, graphs):
    vertices = [(c, v, float(i < 2), 1.0) for c, (names, _) in graphs.items() for i, v in enumerate(names)]
    arcs = [(c, f"{a}{b}", a, b, 0.0 if (int(a[1:]) + int(b[1:])) % 5 == 0 else 0.5) for c, (_, pairs) in graphs.items() for a, b in pairs]
    land = M.drop_unfed(landscape(spark, [("o", 0, 1.0)], vertices, arcs, (), ()))
    want = {(c, v) for c, (names, _) in graphs.items() for v in reached([(a, b) for k, _, a, b, p in arcs if k == c and p > 0], names[:2])}
    assert {(r.case_id, r.vertex_id) for r in land.vertices.collect()} == want
    assert {(r.case_id, r.arc_id) for r in land.arcs.collect()} == {(k, i) for k, i, a, b, _ in arcs if (k, a) in want and (k, b) in want}


def counted(monkeypatch):
    """Counts the frames that are written, which bound the rounds."""
    seen = []
    real = M.cut
    monkeypatch.setattr(M, "cut", lambda df: seen.append(1) or real(df))
    real_counted = M.cut_counted
    monkeypatch.setattr(M, "cut_counted", lambda *a: seen.append(1) or real_counted(*a))
    return seen


N = 5_000


def long_graph(spark):
    """A path of N vertices in an order that is not that of their names, and a ring of N."""
    ids = spark.range(N)
    name = lambda kind, x: F.concat(F.lit(kind), F.lpad((x * 7919 % N).cast("string"), 5, "0"))
    path = ids.where(F.col("id") < N - 1).select(F.lit("k").alias("case_id"), name("p", F.col("id")).alias("src"), name("p", F.col("id") + 1).alias("dst"))
    ring = ids.select(F.lit("k").alias("case_id"), name("r", F.col("id")).alias("src"), name("r", (F.col("id") + 1) % N).alias("dst"))
    vertices = ids.select(F.lit("k").alias("case_id"), F.explode(F.array(name("p", F.col("id")), name("r", F.col("id")))).alias("vertex_id"))
    return vertices, path.unionByName(ring)


def test_long_paths_and_rings_take_few_rounds(spark, monkeypatch):
    vertices, arcs = long_graph(spark)
    seen = counted(monkeypatch)
    found = M.strong_components(vertices, arcs)
    assert len(seen) <= 40
    assert found.where("vertex_id like 'p%' and component <> vertex_id").isEmpty() and found.count() == 2 * N
    assert [r.component for r in found.where("vertex_id like 'r%'").select("component").distinct().collect()] == ["r00000"]


def test_long_ways_are_reached_in_few_rounds(spark, monkeypatch):
    vertices, arcs = long_graph(spark)
    labels = vertices.withColumn("label", F.when(F.col("vertex_id").isin("p00000", "r00017"), 0).otherwise(1))
    seen = counted(monkeypatch)
    found = M._spread(labels, arcs.withColumnRenamed("case_id", "c"))
    assert len(seen) <= 40
    assert found.where("label = 0").count() == 2 * N
