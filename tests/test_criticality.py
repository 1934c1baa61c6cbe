"""Arc criticality on small random graphs, against a race kept in a heap and against all selections."""

import heapq
import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from linkscape.operators import simplify as M
from tests.test_landscape import landscape

STEP = math.log1p(M.GRAIN)
BUDGET = 2.0


def length(p):
    return math.floor(-math.log(max(p, M.GRAIN)) / STEP)


@pytest.fixture(scope="module")
def graphs(spark):
    """Graphs of five vertices as cases of one landscape, with ties, probabilities of 1 and cycles of them."""
    r = random.Random(11)
    options = [(f"o{k}", k, c) for k, c in enumerate((1.0, 1.0, 2.0, 0.0))]
    vertices, arcs, raised = [], [], []
    for case in "ABCDEF":
        vertices += [(case, f"v{k}", 1.0, 1.0 if k else 0.0) for k in range(5)]
        pairs = r.sample([(a, b) for a in range(5) for b in range(5) if a != b], 9)
        for a, b in pairs:
            arcs.append((case, f"a{a}{b}", f"v{a}", f"v{b}", r.choice([1.0, 0.5, 0.5, 0.25, 0.125])))
            if r.random() < 0.5:
                raised.append((case, f"a{a}{b}", r.choice(options)[0], r.choice([1.0, 0.5, 0.75])))
    return options, vertices, arcs, raised, landscape(spark, options, vertices, arcs, (), raised)


def race(arcs, best, uv, strong):
    """Vertices that wave 1 gets first, lengths first, then wave 0."""
    _, _, u, v, p = uv
    first = [(length(p), 1, v), (0, 0, u)] if strong else [(0, 1, u), (best[uv[1]], 0, v)]
    heap, owner = sorted(first), {}
    while heap:
        d, wave, x = heapq.heappop(heap)
        if x in owner:
            continue
        owner[x] = wave
        for a in arcs:
            if a[2] == x and a[1] != uv[1]:
                heapq.heappush(heap, (d + (length(a[4]) if wave else best[a[1]]), wave, a[3]))
    return {x for x, wave in owner.items() if wave}


def test_unbudgeted_equals_a_race_in_order(graphs):
    _, _, arcs, raised, land = graphs
    want = set()
    for case in "ABCDEF":
        own = [a for a in arcs if a[0] == case]
        best = {a[1]: min([length(a[4])] + [length(q) for c, i, _, q in raised if c == case and i == a[1]]) for a in own}
        for uv in own:
            for kind in ("strong", "useless"):
                want |= {(case, uv[1], t, kind) for t in race(own, best, uv, kind == "strong") if t != "v0"}
    got = M.arc_criticality(land).collect()
    assert len(got) == len(set(map(tuple, got))) and set(map(tuple, got)) == want


def paths(arcs, s):
    """Best probability to each vertex."""
    best = {s: 1.0}
    for _ in range(6):
        for _, _, a, b, p in arcs:
            if best.get(a, 0) * p > best.get(b, 0):
                best[b] = best[a] * p
    return best


def test_budgeted_holds_under_every_affordable_selection(graphs):
    options, _, arcs, raised, land = graphs
    got = set(map(tuple, M.arc_criticality(land, BUDGET).collect()))
    assert set(map(tuple, M.arc_criticality(land).collect())) <= got and any(k == "useless" for *_, k in got)
    for chosen in itertools.product((0, 1), repeat=len(options)):
        taken = {o for (o, _, _), x in zip(options, chosen) if x}
        if sum(c for o, _, c in options if o in taken) > BUDGET:
            continue
        now = [(c, i, a, b, max([p] + [q for c2, j, o, q in raised if (c2, j) == (c, i) and o in taken])) for c, i, a, b, p in arcs]
        for case in "ABCDEF":
            own = [a for a in now if a[0] == case]
            for uv in own:
                around, after = paths([a for a in own if a is not uv], uv[2]), paths([a for a in own if a is not uv], uv[3])
                for t in {f"v{k}" for k in range(1, 5)}:
                    through, other = uv[4] * after.get(t, 0.0), around.get(t, 0.0)
                    if (case, uv[1], t, "strong") in got:
                        assert through >= other * (1 - 1e-6), (case, uv, t, taken)
                    if (case, uv[1], t, "useless") in got:
                        assert other >= through * (1 - 1e-6), (case, uv, t, taken)


def carried(arcs, penalties, improvements, uv, strong):
    """Vertices that wave 1 wins under penalties in rising order, with what is won kept as its sources and out of reach."""
    _, _, u, v, p = uv
    won = {}
    for mu in sorted(penalties):
        late = math.floor(mu * BUDGET)
        best = {a[1]: min([length(a[4])] + [n + math.floor(mu * share) for i, share, n in improvements if i == a[1]]) for a in arcs}
        heap = [(length(p) + late, 1, v), (0, 0, u)] if strong else [(late, 1, u), (best[uv[1]], 0, v)]
        heap = sorted(heap + [(d + late, 1, w) for w, d in won.items()])
        owner, held = {}, set(won)
        while heap:
            d, wave, x = heapq.heappop(heap)
            if x in owner:
                continue
            owner[x] = wave
            if wave and x not in won:
                won[x] = d - late
            for a in arcs:
                if a[2] == x and a[1] != uv[1] and a[3] not in held:
                    heapq.heappush(heap, (d + (length(a[4]) if wave else best[a[1]]), wave, a[3]))
    return set(won)


def test_budgeted_equals_penalties_one_after_another(graphs):
    _, _, arcs, _, land = graphs
    raised = M._raised(land)
    improvements, penalties = raised.collect(), M._penalties(land, raised, 10).collect()
    want = set()
    for case in "ABCDEF":
        own, mus = [a for a in arcs if a[0] == case], [r["mu"] for r in penalties if r["case_id"] == case]
        each = [(r["arc_id"], r["share"], r["improved"]) for r in improvements if r["case_id"] == case]
        for uv in own:
            for kind in ("strong", "useless"):
                want |= {(case, uv[1], t, kind) for t in carried(own, mus, each, uv, kind == "strong") if t != "v0"}
    got = M.arc_criticality(land, BUDGET).collect()
    assert len(got) == len(set(map(tuple, got))) and set(map(tuple, got)) == want


def test_a_race_moves_each_vertex_on_once(graphs, monkeypatch):
    _, _, _, _, land = graphs
    closed, real = [], M.Buckets.append
    monkeypatch.setattr(M.Buckets, "append", lambda self, df: closed.append((self, real(self, df))) or closed[-1][1])
    got = M.arc_criticality(land).count()
    assert got and all(n for _, n in closed)  # every round closes something
    for state in {id(b): b for b, _ in closed}.values():
        files = state.spark.read.parquet(state.path)
        assert files.count() == files.select(*state.keys).distinct().count()


def test_cycles_of_length_zero_end(spark):
    ring = [("k", f"a{i}", f"v{i}", f"v{(i + 1) % 6}", 1.0) for i in range(6)] + [("k", f"b{i}", f"v{(i + 1) % 6}", f"v{i}", 1.0) for i in range(6)]
    land = landscape(spark, [("o", 0, 1.0)], [("k", f"v{i}", 1.0, 1.0) for i in range(6)], ring, (), ())
    assert M.arc_criticality(land).where("kind = 'strong'").isEmpty()  # the way round is as good, and ties go against the arc


def test_components_of_a_lossless_path_and_a_ring(spark):
    n = 24
    vertices = spark.createDataFrame([("k", f"p{i:02}") for i in range(n)] + [("k", f"r{i}") for i in range(4)], "case_id string, vertex_id string")
    arcs = [("k", f"p{i + 1:02}", f"p{i:02}") for i in range(n - 1)] + [("k", f"r{i}", f"r{(i + 1) % 4}") for i in range(4)] + [("k", "p00", "r3")]
    found = M.strong_components(vertices, spark.createDataFrame(arcs, "case_id string, src string, dst string"))
    assert {(r.vertex_id, r.component) for r in found.collect()} == {(f"p{i:02}", f"p{i:02}") for i in range(n)} | {(f"r{i}", "r0") for i in range(4)}
    assert M.strong_components(vertices.limit(0), arcs and spark.createDataFrame(arcs, "case_id string, src string, dst string").where(F.lit(False))).collect() == []
