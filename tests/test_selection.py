"""Selection methods against brute force on a small graph, and their values on the nation landscape."""

import itertools
import random

import pytest

from linkscape.operators import relational as R
from linkscape.operators import selection as B
from linkscape.operators import witnesses as W
from linkscape.plans import nations
from linkscape.storage import local_frame
from tests.test_landscape import landscape

OPTIONS = [("x", 0, 1.0), ("y", 1, 2.0), ("z", 2, 1.0), ("w", 3, 1.5), ("free", 4, 0.0), ("dear", 5, 9.0)]
BUDGET = 3.0


@pytest.fixture(scope="module")
def tables():
    r = random.Random(5)
    vertices = [("k", f"v{k}", float(r.randint(0, 3)), float(r.randint(0, 3))) for k in range(6)]
    arcs = [("k", f"a{a}{b}", f"v{a}", f"v{b}", r.choice([0.5, 0.25, 0.1])) for a in range(6) for b in range(6) if a != b and r.random() < 0.4]
    gains = [("k", f"v{r.randrange(6)}", o, float(r.randint(0, 2)), float(r.randint(0, 2))) for o, _, _ in OPTIONS for _ in range(2)]
    raised = [("k", r.choice(arcs)[1], o, r.choice([0.6, 0.9, 1.0])) for o, _, _ in OPTIONS for _ in range(3)]
    return vertices, arcs, gains, raised


class Brute:
    """Scores and methods, one selection at a time."""

    def __init__(self, tables):
        self.vertices, self.arcs, self.gains, self.raised = tables
        self.cost = {o: c for o, _, c in OPTIONS if c <= BUDGET}
        self.place = {o: k for o, k, _ in OPTIONS}
        self.free = [o for o, c in self.cost.items() if not c]
        self.paid = [o for o, c in self.cost.items() if c]

    def score(self, taken):
        a = {v: x + sum(g[3] for g in self.gains if g[1] == v and g[2] in taken) for _, v, x, _ in self.vertices}
        b = {v: y + sum(g[4] for g in self.gains if g[1] == v and g[2] in taken) for _, v, _, y in self.vertices}
        p = {(v, v): 1.0 for v in a}
        for _, i, s, t, q in self.arcs:
            p[s, t] = max(p.get((s, t), 0), q, *[x for _, j, o, x in self.raised if j == i and o in taken], 0)
        for m in a:
            for s in a:
                for t in a:
                    p[s, t] = max(p.get((s, t), 0), p.get((s, m), 0) * p.get((m, t), 0))
        return sum(a[s] * b[t] * q for (s, t), q in p.items())

    def spent(self, ids):
        return sum(self.cost[o] for o in ids)

    def up(self, taken, o):
        return round((self.score(set(taken) | {o}) - self.score(taken)) / self.cost[o], 12)

    def down(self, taken, o):
        return round((self.score(taken) - self.score(set(taken) - {o})) / self.cost[o], 12)

    def static_fill(self, taken, pool):
        out, order = list(taken), sorted(pool, key=lambda o: (-self.up(taken, o), self.place[o]))
        for o in order:
            if self.spent(out) + self.cost[o] <= BUDGET:
                out.append(o)
        return out

    def greedy_fill(self, taken, pool, sign=-1):
        out = list(taken)
        while pool := [o for o in pool if o not in out and self.spent(out) + self.cost[o] <= BUDGET]:
            out.append(min(pool, key=lambda o: (sign * self.up(out, o), self.place[o])))
        return out

    def cut(self, sign=1):
        taken, gone = self.free + self.paid, []
        while self.spent(taken) > BUDGET:
            o = min([o for o in taken if self.cost[o]], key=lambda o: (sign * self.down(taken, o), self.place[o]))
            taken.remove(o)
            gone.append(o)
        return taken, gone

    def static_decr(self):
        everything = self.free + self.paid
        kept, gone = list(everything), []
        for o in sorted(self.paid, key=lambda o: (self.down(everything, o), self.place[o])):
            if gone and self.spent(kept) <= BUDGET:
                break
            kept.remove(o)
            gone.append(o)
        return self.static_fill(kept, gone)


def test_methods_against_brute_force(spark, tables):
    vertices, arcs, gains, raised = tables
    land, brute = landscape(spark, OPTIONS, vertices, arcs, gains, raised), Brute(tables)
    assert B.static_incr(land, BUDGET) == brute.static_fill(brute.free, brute.paid)
    assert B.greedy_incr(land, BUDGET) == brute.greedy_fill(brute.free, brute.paid)
    assert set(B.static_decr(land, BUDGET)) == set(brute.static_decr())
    assert set(B.greedy_decr(land, BUDGET)) == set(brute.greedy_fill(*brute.cut()))
    assert set(B.greedy_decr(land, BUDGET, only_dec=True)) == set(brute.cut()[0])
    assert set(B.worst_greedy_decr(land, BUDGET)) == set(brute.greedy_fill(*brute.cut(-1), sign=1))


def test_tolerance(spark):
    land = landscape(spark, [("a", 0, 0.1), ("b", 1, 0.2)], [("k", "v", 1.0, 1.0)], [], [("k", "v", "a", 1.0, 0.0), ("k", "v", "b", 1.0, 0.0)])
    assert set(B.greedy_incr(land, 0.3)) == set(B.static_incr(land, 0.3)) == {"a", "b"}  # 0.1 + 0.2 > 0.3 in doubles
    assert len(B.static_incr(land, 0.3, feasibility_tol=0.0)) == 1


def test_greedy_on_nations(spark):
    land = nations.nation_landscape(spark, "/root/testdata/sf0.01")
    assert B.greedy_incr(land, nations.BUDGET) == ["n23", "n3", "n2", "n19", "n7", "n24", "n10", "n20"]


def test_certificate_holds_for_every_affordable_selection(spark, tables):
    vertices, arcs, gains, raised = tables
    land, brute = landscape(spark, OPTIONS, vertices, arcs, gains, raised), Brute(tables)
    row = B.certificate(land, BUDGET).first()
    assert abs(row["base_score"] - brute.score(())) < 1e-9
    fit = [x for n in range(len(OPTIONS)) for x in itertools.combinations(brute.cost, n) if brute.spent(x) <= BUDGET]
    assert len(fit) > 10 and all(brute.score(x) <= row["bound"] + 1e-9 for x in fit)
    assert B.certificate(land, 0.0).first()["bound"] >= brute.score(["free"]) - 1e-9


def test_removals_repair_only_what_rested_on_them(spark, tables):
    vertices, arcs, gains, raised = tables
    land, brute = landscape(spark, OPTIONS, vertices, arcs, gains, raised), Brute(tables)
    taken = [o for o, _, c in OPTIONS if c <= BUDGET]
    frame = lambda ids: local_frame(spark, {"option_id": ids}, "option_id string")
    state = W.Taken.of(R.affordable(land, BUDGET), frame(taken))
    for out in ("y", "free", "x"):
        state = state.without(out)
        taken.remove(out)
        got = {r["option_id"]: r["pc"] for r in state.scores_without(frame([*taken, ""])).collect()}
        assert set(got) == {*taken, ""}
        for o in got:
            assert abs(got[o] - brute.score([x for x in taken if x != o])) < 1e-9
        rows = state.rows.collect()
        rested = {(r.case_id, r.s, r.t): set(r.w) for r in rows if r.option_id == ""}
        assert {(r.option_id, r.case_id, r.s, r.t) for r in rows if r.option_id} == {(o, *k) for k, w in rested.items() for o in w}
        assert all(out not in r.w for r in rows) and all(r.option_id not in r.w for r in rows)
