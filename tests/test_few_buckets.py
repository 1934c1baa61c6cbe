"""What a small landscape costs does not follow the session's shuffle partitions, and line items are shuffled once."""

import re

import pytest

from linkscape import storage
from linkscape.operators import closure as G
from linkscape.operators import simplify as M
from linkscape.plans import nations
from tests.test_landscape import landscape


@pytest.fixture
def made(spark, monkeypatch):
    """The buckets made meanwhile, in a session that shuffles to many partitions."""
    found, real = [], storage.Buckets.__init__
    monkeypatch.setattr(storage.Buckets, "__init__", lambda self, *a, **k: (real(self, *a, **k), found.append(self))[0])
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    yield found
    spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.fixture(scope="module")
def ring(spark):
    """Two rings of five, each with a chord, as cases."""
    vertices = [(c, f"v{k}", 1.0, 1.0) for c in "xy" for k in range(5)]
    arcs = [(c, f"a{k}", f"v{k}", f"v{(k + 1) % 5}", 0.5) for c in "xy" for k in range(5)] + [(c, "b", "v0", "v3", 0.25) for c in "xy"]
    return landscape(spark, [("o", 0, 1.0)], vertices, arcs)


def test_few_pairs_lie_in_one_bucket(made, ring, monkeypatch):
    few = {tuple(r) for r in G.closure(ring).collect()}
    assert [b.n for b in made] == [1] and len(few) == 50
    assert made[0].most == 60  # at most: each of ten sources itself and the five heads of its case
    monkeypatch.setattr(storage, "FEW", 59)
    assert {tuple(r) for r in G.closure(ring).collect()} == few and made[1].n == 16


def test_compacted_buckets_stay_few(made, ring, monkeypatch):
    monkeypatch.setattr(G, "TURNS", 2)
    assert G.closure(ring).count() == 50
    assert len(made) > 1 and {b.n for b in made} == {1}


def test_races_of_both_kinds_share_their_rounds(made, ring, monkeypatch):
    few = {tuple(r) for r in M.arc_criticality(ring).collect()}
    assert [b.n for b in made] == [1] and {k for *_, k in few} == {"strong", "useless"}
    held = made[0].spark.read.parquet(made[0].path)
    assert held.count() <= made[0].most
    monkeypatch.setattr(storage, "FEW", 0)
    assert {tuple(r) for r in M.arc_criticality(ring).collect()} == few and made[1].n == 16


def test_line_items_are_shuffled_once(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(nations, "cut", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or df)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        nations.nation_landscape(spark, "/root/testdata/sf0.001")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    keys = re.findall(r"Exchange hashpartitioning\((\w+)#", plans[0])
    assert keys.count("l_orderkey") == 1 and "l_suppkey" not in keys
    lines = plans[0].splitlines()
    depth = lambda x: len(x) - len(x.lstrip(" :+-*()0123456789"))
    at = next(i for i, x in enumerate(lines) if "FileScan" in x and "l_orderkey" in x)
    above, level = [], depth(lines[at])
    for x in reversed(lines[:at]):
        if depth(x) < level:
            level = depth(x)
            above.append(x)
    assert sum("Exchange" in x for x in above) == 3  # to orders, to the sums of pairs of nations, to the ranks


def test_landscape_is_the_same_if_suppliers_are_not_sent(spark, monkeypatch):
    arcs = lambda: sorted(map(tuple, nations.nation_landscape(spark, "/root/testdata/sf0.001", True).arcs.collect()))
    sent = arcs()
    monkeypatch.setattr(nations, "SENT", 0)
    assert sent and arcs() == sent
