"""Inflow over whole components within tasks: the arithmetic by itself, its parts against brute force, and what is written for it."""

import os
import random
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pytest

import __spark_entry__ as entry
from linkscape.operators import closure as G
from linkscape.operators import vectors as V
from tests.test_closure import brute
from tests.test_landscape import landscape


def random_arcs(r, n, m):
    return tuple(np.array(c) for c in zip(*[(r.randrange(n), r.randrange(n), r.choice([0.25, 0.3, 0.5, 1.0])) for _ in range(m)], strict=True))


@pytest.mark.parametrize("piece, near, first", [(64, 1 << 15, (8, 32)), (2, 3, (1, 2))])
def test_settled_is_brute_force(monkeypatch, piece, near, first):
    monkeypatch.setattr(V, "PIECE", piece)
    monkeypatch.setattr(V, "NEAR", near)
    monkeypatch.setattr(V, "FIRST", first)
    r = random.Random(piece)
    for n, m in ((2, 3), (12, 30), (40, 60), (15, 200)):
        x, y, q = random_arcs(r, n, m)
        order = np.lexsort((-q, y))
        x, y, q = x[order], y[order], q[order]
        source = np.array(sorted(r.sample(range(n), min(n, 7))))
        want = np.zeros((n, len(source)))
        at = {int(s): k for k, s in enumerate(source)}
        arcs = [("k", "", int(a), int(b), c) for a, b, c in zip(x, y, q, strict=True)]
        for (_, s, t), p in brute(range(n), arcs, [("k", int(s)) for s in source]).items():
            want[t, at[s]] = p
        assert np.array_equal(V.settled(n, x, y, q, source), want)


def test_components_and_pieces():
    r = random.Random(4)
    n = 5_000
    x, y, q = np.arange(n - 1), np.arange(1, n), np.full(n - 1, 0.5)  # a path whose vertices are shuffled
    new = np.array(r.sample(range(n), n))
    assert not V.components(n, new[x], new[y]).any()
    assert V.components(5, np.array([3, 1]), np.array([4, 2])).tolist() == [0, 1, 1, 3, 3]
    x, y = np.concatenate((x, np.full(70_000, 7))), np.concatenate((y, np.arange(70_000)))  # counts and places that need four bytes
    q = np.concatenate((q, np.array([r.random() for _ in range(70_000)])))
    rows = V._pieces("bucket", x % 3, x, y, q)
    assert rows.column("bucket").to_pylist() == [0, 1, 2]
    back = [np.concatenate(c) for c in zip(*V._arcs_of(pa.Table.from_batches([rows])), strict=True)]
    assert sorted(zip(*[c.tolist() for c in back], strict=True)) == sorted(zip(x.tolist(), y.tolist(), q.tolist(), strict=True))


@pytest.mark.parametrize("arcs_a_bucket", [4, 8, 1_000])
@pytest.mark.parametrize("both_ways", [False, True])
def test_components_of_all_sizes_are_brute_force(spark, monkeypatch, arcs_a_bucket, both_ways):
    monkeypatch.setattr(G, "ALONE", 0)
    r = random.Random(arcs_a_bucket)
    vertices, arcs = [], []
    for k, (n, m) in enumerate([(12, 40), (8, 10), (6, 8), (2, 1), (2, 2), (1, 0), (2, 1)]):
        vertices += [("k", f"{k}.{v}", r.choice([0.0, 1.0, 1.5]), 1.0) for v in range(n)]
        arcs += [("k", f"a{k}.{i}", f"{k}.{r.randrange(n)}", f"{k}.{r.randrange(n)}", r.choice([0.0, 0.25, 0.3, 1.0])) for i in range(m)]
    arcs += [("k", f"again{i}", a, b, 0.4) for i, (_, _, a, b, _) in enumerate(arcs[:9])]  # parallel ones
    land = landscape(spark, [], vertices, arcs)
    ways = [*arcs, *[(c, i, b, a, q) for c, i, a, b, q in arcs]] if both_ways else arcs
    quality, want = {v: a for _, v, a, _ in vertices}, {}
    for (_, s, t), p in brute(vertices, ways, [("k", v) for v, a in quality.items() if a > 0]).items():
        want[t] = want.get(t, 0.0) + quality[s] * p
    found = G.inflow_in_blocks(land, 4, arcs_a_bucket=arcs_a_bucket, values_a_block=64, both_ways=both_ways).collect()
    assert len(found) == len(want) and {x.t: x.inflow for x in found} == pytest.approx(want, rel=1e-12)


def written(spark):
    return sum(p.stat().st_size for p in Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://")).rglob("*") if p.is_file())


def test_ps_inflow_writes_less_than_it_reads(spark):
    sf_dir = "/root/testdata/sf0.01"
    before = written(spark)
    found = {tuple(x) for x in entry.queries()["ps_inflow"](spark, sf_dir).collect()}
    assert written(spark) - before < os.path.getsize(f"{sf_dir}/lineitem.parquet")
    c = duckdb.connect()
    c.execute(f"create view lineitem as select * from '{sf_dir}/lineitem.parquet'")
    assert found == set(c.execute(entry.oracle_sql()["ps_inflow"]).fetchall())


def test_components_that_fit_a_task_send_no_vectors(spark, monkeypatch):
    monkeypatch.setattr(G, "ALONE", 0)

    def never(width):
        raise AssertionError("vectors of sources are exchanged")

    monkeypatch.setattr(V, "carried", never)
    vertices = [("k", f"{k}.{v}", 1.0, 1.0) for k in range(40) for v in range(3)]
    arcs = [("k", f"a{k}.{v}.{w}", f"{k}.{v}", f"{k}.{w}", 0.5) for k in range(40) for v, w in ((0, 1), (1, 0), (1, 2), (2, 1))]
    found = {x.t: x.inflow for x in G.inflow_in_blocks(landscape(spark, [], vertices, arcs)).collect()}
    assert found == {f"{k}.{v}": (1.75, 2.0, 1.75)[v] for k in range(40) for v in range(3)}
