"""A manifest of CSV files with known best scores under all five methods."""

import json

import pytest

from linkscape.operators import selection as B
from linkscape.sources import files as S
from tests.test_landscape import landscape

#: Four options of cost 1, of which 0 and 1 make vertex 0 a target and a source; 2 and 3 do nothing.
OPTIONS = "id,cost\n0,1\n1,1\n2,1\n3,1\n"
VERTICES = "id,source_quality,target_quality\n0,1,1\n1,0,0\n2,0,1\n3,1,1\n"
ARCS = "id,from,to,probability\n0_1,0,1,0.5\n1_0,1,0,0.5\n1_2,1,2,0.5\n"
GAINS = "vertex_id,option_id,source_quality_gain,target_quality_gain\n0,0,0,1\n0,1,1,0\n"
#: What each method takes and scores with budgets of 1 and 2; nothing taken scores 2.25, everything 5.5.
BEST = {1: ({"1"}, 3.5), 2: ({"0", "1"}, 5.5)}
WORST = {1: ({"3"}, 2.25), 2: ({"2", "3"}, 2.25)}


@pytest.fixture(scope="module")
def land(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("fixture")
    case = {}
    for table, text in {"vertices": VERTICES, "arcs": ARCS, "vertices_improvements": GAINS, "arcs_improvements": "arc_id,option_id,improved_probability\n"}.items():
        (folder / f"{table}.csv").write_text(text)
        case[table] = {"csv_file": f"{table}.csv"}
    (folder / "options.csv").write_text(OPTIONS)
    (folder / "m.json").write_text(json.dumps({"options": {"csv_file": "options.csv"}, "cases": {"test": case}, "criterion": "test"}))
    return S.read_landscape(spark, f"file://{folder}/m.json")


def scored(land, ids):
    return B.evaluation(land, B.selection_of(land, ids)).first().score


def test_bounds_of_the_score(land):
    assert scored(land, []) == 2.25 and scored(land, ["0", "1", "2", "3"]) == 5.5


@pytest.mark.parametrize(("method", "budget"), [*((m, 1) for m in B.METHODS.values()), (B.static_incr, 2), (B.worst_greedy_decr, 2)])
def test_methods_take_what_is_known(land, method, budget):
    ids, score = (WORST if method is B.worst_greedy_decr else BEST)[budget]
    taken = method(land, budget)
    assert set(taken) == ids and scored(land, taken) == score


#: Pairs joined by an option each, which makes both of its arcs certain; vertices 0 to 4 have quality 1, 5 to 10 a tenth, 11 to 13 none.
PAIRS = ["0_11", "11_1", "0_12", "12_2", "0_13", "13_3", "0_5", "5_6", "6_7", "7_8", "8_9", "9_10", "10_4"]
#: Scores with a budget of 4; nothing taken scores 5.06, everything 31.36.
SCORES = {B.static_incr: 5.92, B.greedy_incr: 5.98, B.static_decr: 5.98}


@pytest.fixture(scope="module")
def star(spark):
    quality = lambda k: 1.0 if k < 5 else 0.1 if k < 11 else 0.0
    ends = [tuple(p.split("_")) for p in PAIRS]
    arcs = [("k", f"{a}_{b}", a, b, 0.0) for x, y in ends for a, b in ((x, y), (y, x))]
    raised = [("k", arc, o, 1.0) for o, (x, y) in zip(PAIRS, ends, strict=True) for arc in (f"{x}_{y}", f"{y}_{x}")]
    return landscape(spark, [(o, i, 1.0) for i, o in enumerate(PAIRS)], [("k", str(k), quality(k), quality(k)) for k in range(14)], arcs, (), raised)


@pytest.mark.parametrize("method", SCORES)
def test_ways_that_pay_only_together(star, method):
    taken = method(star, 4)
    assert len(taken) == 4 and scored(star, taken) == pytest.approx(SCORES[method], abs=1e-9)


def test_all_ways_together(star):
    assert scored(star, []) == pytest.approx(5.06, abs=1e-9) and scored(star, PAIRS) == pytest.approx(31.36, abs=1e-9)
