"""Small landscapes with known values, and what must hold between operators."""

import json

import pytest
from pyspark.sql import functions as F

from linkscape.functions import criterion as C
from linkscape.landscape import SCHEMAS, Landscape
from linkscape.operators import closure as G
from linkscape.operators import relational as R
from linkscape.operators import scenarios as X
from linkscape.operators import selection as B
from linkscape.operators import simplify as M
from linkscape.operators import validation as V
from linkscape.sources import files as S


def landscape(spark, options, vertices, arcs, gains=(), raised=(), criterion=None):
    made = {}
    for name, rows in (("options", options), ("vertices", vertices), ("arcs", arcs), ("vertex_improvements", gains), ("arc_improvements", raised)):
        made[name] = spark.createDataFrame(list(rows), SCHEMAS[name])
    return Landscape(**made, criterion=criterion)


@pytest.fixture(scope="module")
def small(spark):
    """A chain a -> b -> c with a detour, two options."""
    return landscape(
        spark,
        [("x", 0, 1.0), ("y", 1, 1.0)],
        [("k", "a", 1.0, 1.0), ("k", "b", 0.0, 2.0), ("k", "c", 1.0, 1.0), ("k", "d", 0.0, 0.0)],
        [("k", "ab", "a", "b", 0.5), ("k", "bc", "b", "c", 0.5), ("k", "ac", "a", "c", 0.125), ("k", "cd", "c", "d", 1.0), ("k", "ab2", "a", "b", 0.25)],
        [("k", "b", "x", 1.0, 0.0)],
        [("k", "bc", "y", 1.0), ("k", "ac", "x", 0.1)],
    )


def test_paths_and_scores(small):
    paths = {(r.s, r.t): r.p for r in G.closure(small).collect()}
    assert paths == {("a", "a"): 1, ("a", "b"): 0.5, ("a", "c"): 0.25, ("a", "d"): 0.25, ("c", "c"): 1, ("c", "d"): 1}
    assert G.pc(small).first().pc == 1 + 1.0 + 0.25 + 1
    weak = {(r.s, r.t) for r in G.closure(small, min_probability=0.3).collect()}
    assert weak == {("a", "a"), ("a", "b"), ("c", "c"), ("c", "d")}


def test_batches_equal_one_by_one(spark, small):
    for ids in ((), ("x",), ("y",), ("x", "y")):
        chosen = spark.createDataFrame([(i, 1) for i in ids] + [("z", 0)], "option_id string, value int")
        want = G.pc(R.with_selection(small, chosen)).first().pc
        got = X.scenario_pc(small, spark.createDataFrame([("s", i) for i in (*ids, "")], "scenario_id string, option_id string")).first().pc
        assert got == pytest.approx(want, rel=1e-12)


def test_smaller_landscapes_keep_scores(small):
    assert G.pc(M.contract_lossless(small)).first().pc == pytest.approx(G.pc(small).first().pc)
    names = {r.vertex_id for r in M.contract_lossless(small.with_(arcs=small.arcs.unionByName(small.arcs.where("arc_id = 'cd'").select("case_id", F.lit("dc").alias("arc_id"), F.lit("d").alias("src"), F.lit("c").alias("dst"), "probability")))).vertices.collect()}
    assert names == {"a", "b", "c+d"}
    assert {r.vertex_id for r in M.drop_unfed(small).vertices.collect()} == {"a", "b", "c", "d"}
    whole = {r.t: r.inflow for r in G.inflow(small).collect()}
    bound = {r.t: r.bound for r in G.budgeted_inflow(small, 1.0).collect()}
    assert all(bound[t] >= whole[t] for t in whole)


def test_methods(small):
    assert B.static_incr(small, 1.0) == B.greedy_incr(small, 1.0) == ["x"]
    for name, method in B.METHODS.items():
        chosen = method(small, 2.0)
        assert len(chosen) == len(set(chosen)) <= 2, name


def test_checks(spark, small):
    assert V.violations(small).isEmpty()
    bad = landscape(spark, [("x", 0, -1.0), ("x", 1, 1.0)], [("k", "a", 1.0, None)], [("k", "e", "a", "q", 1.5)], [("k", "zz", "x", 0.0, 0.0)], [("k", "none", "nobody", 0.5)], C.Case("other"))
    found = {(r["table"], r.rule) for r in V.violations(bad).collect()}
    assert found == {
        ("options", "cost >= 0"), ("options", "duplicate"), ("vertices", "target_quality >= 0"), ("arcs", "probability between 0 and 1"), ("arcs", "unknown vertex"),
        ("vertex_improvements", "unknown vertex"), ("arc_improvements", "unknown arc"), ("arc_improvements", "unknown option"), ("criterion", "unknown case"),
    }
    with pytest.raises(ValueError, match="cost"):
        V.checked(bad)


def test_formulas(spark):
    rows = spark.createDataFrame([("s", "a", 2.0), ("s", "b", 3.0)], "scenario_id string, case_id string, pc double")
    value = lambda f: C.score(rows, f).first().score
    assert value(C.parse({"sum": [1, "a", [2, "b"]]})) == 9
    assert value(C.parse({"min": ["a", {"product": ["a", "b"]}]})) == 2
    assert value(C.parse({"product": []})) == 1 and value(C.parse({"sum": []})) == 0 and value(C.parse({"min": []})) == C.LARGEST
    assert value(None) == 5 and C.score(rows, F.col("a") - F.col("b"), cases=["a", "b"]).first().score == -1
    with pytest.raises(ValueError):
        C.parse({"max": ["a"]})


def test_files_round_trip(spark, small, tmp_path):
    again = S.read_landscape(spark, S.write_landscape(small, f"file://{tmp_path}/l"))
    for name in ("vertices", "arcs", "vertex_improvements", "arc_improvements"):
        own = getattr(small, name)
        assert sorted(map(tuple, getattr(again, name).select(own.columns).collect())) == sorted(map(tuple, own.collect())), name
    chosen = spark.createDataFrame([("x", 1)], "option_id string, value int")
    S.report(small, chosen, B.evaluation(small, chosen), algorithm="m", budget=1, seconds=0).coalesce(1).write.json(f"file://{tmp_path}/r")
    assert sorted(map(tuple, S.read_selection(spark, f"file://{tmp_path}/r").collect())) == [("x", 1), ("y", 0)]
    names = [f"o{(7 * k) % 50}" for k in range(50)]
    (tmp_path / "ordered").mkdir()
    for part in (0, 1):  # two files of one table, in the order of their names
        (tmp_path / "ordered" / f"part-{part}.csv").write_text("id,cost\n" + "".join(f"{n},1\n" for n in names[25 * part : 25 * part + 25]))
    ordered = S.read_table(spark, "options", {"csv_file": f"file://{tmp_path}/ordered"}, "")
    assert [r.option_id for r in ordered.orderBy("option_ord").collect()] == names
    (tmp_path / "m.json").write_text(json.dumps({"options": [{"id": "o", "cost": 2}], "cases": {"k": {"vertices": [{"id": "v", "source_quality": 1, "target_quality": 1}], "arcs": []}}, "criterion": [2, "k"]}))
    inline = S.read_landscape(spark, f"file://{tmp_path}/m.json")
    assert C.score(G.pc(inline).withColumn("scenario_id", F.lit("s")), inline.criterion).first().score == 2
