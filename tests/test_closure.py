"""The fixpoint of best paths against plain Python, and what a hop exchanges."""

import random

import pytest
from pyspark.sql import functions as F

from linkscape.operators import closure as G
from linkscape.storage import Buckets, cut
from tests.test_landscape import landscape


def brute(vertices, arcs, sources):
    best = {(c, s, s): 1.0 for c, s in sources}
    for _ in vertices:
        for (c, s, t), p in list(best.items()):
            for k, _, a, b, q in arcs:
                if k == c and a == t and q > 0 and p * q > best.get((c, s, b), 0.0):
                    best[c, s, b] = p * q
    return best


@pytest.fixture(scope="module")
def graph(spark):
    r = random.Random(21)
    vertices = [(c, f"v{k}", float(r.randint(0, 2)), 1.0) for c in "xy" for k in range(12)]
    arcs = [(c, f"a{k}", f"v{r.randint(0, 11)}", f"v{r.randint(0, 11)}", r.choice([0.0, 0.25, 0.5, 1.0])) for c in "xy" for k in range(24)]
    return landscape(spark, [], vertices, arcs), vertices, arcs


@pytest.mark.parametrize("turns", [2, 3, 32])
def test_closure_is_brute_force_however_often_it_is_compacted(graph, monkeypatch, turns):
    monkeypatch.setattr(G, "TURNS", turns)
    land, vertices, arcs = graph
    want = brute(vertices, arcs, [(c, v) for c, v, a, _ in vertices if a > 0])
    found = G.closure(land).collect()
    assert len(found) == len(want) and {(x.case_id, x.s, x.t): x.p for x in found} == want


def test_blocks_add_up_to_the_whole(graph):
    land = graph[0]
    whole = {(x.case_id, x.t): x.inflow for x in G.inflow(land).collect()}
    parts = {(x.case_id, x.t): x.inflow for x in G.inflow_in_blocks(land, 4).collect()}
    assert parts == pytest.approx(whole, rel=1e-12) and len(whole) > 20


@pytest.mark.parametrize("arcs_a_bucket, alone", [(5, 0), (300, 0)])
def test_vectors_over_buckets_are_brute_force(spark, monkeypatch, arcs_a_bucket, alone):
    monkeypatch.setattr(G, "ALONE", alone)
    r = random.Random(arcs_a_bucket)
    vertices = [(c, f"v{k}", r.choice([0.0, 0.0, 1.5, 2.0]), 1.0) for c in "xyz" for k in range(20)]
    arcs = [(c, f"a{k}", f"v{r.randint(0, 19)}", f"v{r.randint(0, 19)}", r.choice([0.0, 0.25, 0.3, 1.0])) for c in "xy" for k in range(35)]
    quality = {(c, v): a for c, v, a, _ in vertices}
    want: dict[tuple[str, str], float] = {}
    for (c, s, t), p in brute(vertices, arcs, [(c, v) for c, v, a, _ in vertices if a > 0]).items():
        want[c, t] = want.get((c, t), 0.0) + quality[c, s] * p
    found = G.inflow_in_blocks(landscape(spark, [], vertices, arcs), 4, arcs_a_bucket=arcs_a_bucket, values_a_block=64).collect()
    assert len(found) == len(want) and {(x.case_id, x.t): x.inflow for x in found} == pytest.approx(want, rel=1e-12)


def test_blocks_without_arcs_or_sources(spark):
    land = landscape(spark, [], [("k", "a", 2.0, 1.0), ("k", "b", 0.0, 1.0)], [])
    assert [tuple(x) for x in G.inflow_in_blocks(land).collect()] == [("k", "a", 2.0)]
    assert G.inflow_in_blocks(land.with_(vertices=land.vertices.withColumn("source_quality", F.lit(0.0)))).collect() == []


def test_nothing_known_is_exchanged(spark, graph):
    paths, keys = cut(G.closure(graph[0])), ["case_id", "s", "t"]
    known = Buckets(spark, keys)
    assert known.append(paths) == paths.count() and known.append(paths.limit(3)) == 3 and known.last().count() == 3
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        joined = paths.groupBy(*keys).agg(F.max("p").alias("p")).join(known.best(old=F.max("p")), keys, "left")
        plan = joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange") == 1 and "Bucketed: true" in plan
    assert known.rows().count() == paths.count() + 3
    known.close()
    assert not spark.catalog.tableExists(known.name)


def test_no_sources_and_no_arcs(spark):
    land = landscape(spark, [], [("k", "a", 0.0, 1.0)], [])
    assert G.closure(land).collect() == []
    assert [tuple(x) for x in G.closure(land.with_(vertices=land.vertices.withColumn("source_quality", F.lit(1.0)))).collect()] == [("k", "a", "a", 1.0)]
