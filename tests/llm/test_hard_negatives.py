import itertools
import math

import numpy as np
import pytest

from linkscape.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<float>, label int, rank string"


def brute(rows, every=50):
    kept = set()
    for i, v, label, _ in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        kept.add((i, (label + 1) % 10 if i % 7 == 0 else label, tuple(math.floor(256 * float(np.float32(x))) for x in v)))
    out = []
    for a in sorted(kept):
        if a[0] % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(a[2], b[2])), b[0], b[1]) for b in kept if b != a)
        for s, p, label in [x for x in scored if x[2] == a[1]][:5]:
            fit = [x for x in scored if x[2] != a[1] and -50 * s <= -100 * x[0] <= -95 * s]
            out += [(a[0], p, k, n, -s, -t) for k, (t, n, _) in enumerate(fit[:3], 1)]
    return sorted(out)


def got(spark, rows, **options):
    return sorted(tuple(r) for r in H.hard_negatives(spark.createDataFrame(rows, SCHEMA), **options).collect())


def some(seed, n, dims, labels=3, copies=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(labels, dims))
    rows = [(i, [float(x) for x in rng.normal(size=dims) * 0.4 + centres[i % labels] * 0.5], int(i % labels), "x") for i in range(n)]
    return rows + [(n + i, rows[50][1], rows[50][2] if i % 2 else (rows[50][2] + 1) % labels, "x") for i in range(copies)]


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(H, "TOGETHER", 2)
    rows = some(seed, 400, 5, copies=120)
    assert got(spark, rows, block=16, chunk=3, page=4) == brute(rows)


def test_edges(spark):
    rows = some(7, 120, 4)
    rows += [(None, [1.0], 1, None), (200, None, 1, None), (250, [0.5, None], 1, None), (300, [float("nan")] * 4, 1, None), (350, [float("inf")] * 4, 2, None), (400, [0.1] * 4, None, None)]
    rows += [rows[50], rows[50], (450, [0.3, 0.2], 1, "short"), (500, [], 2, "none"), (550, [0.3, 0.2, 0.1, 0.4, 0.5, 0.6], 9, "long"), (50, [0.9, 0.9, 0.9, 0.9], 2, "same id")]
    assert got(spark, rows) == brute(rows)
    assert got(spark, rows[:0]) == [] and got(spark, [(1, [1.0], 1, None)]) == [] and got(spark, [(50, [1.0], 1, None)]) == []
    big = [(50 * i, [float((-1) ** i * i * 100_000), 3.0], i % 2, None) for i in range(1, 9)]
    assert got(spark, big) == brute(big)


def test_bounds_hold_and_products_are_exact():
    rng = np.random.default_rng(1)
    a, b = rng.integers(-300, 300, (6, 5)), rng.integers(-300, 300, (40, 5))
    least, most = H.bounds(a, b.min(axis=0)[None], b.max(axis=0)[None])
    exact = a @ b.T
    assert (least[:, 0] <= exact.min(axis=1)).all() and (most[:, 0] >= exact.max(axis=1)).all()
    big = np.array([[2**28, -(2**28), 1]], np.int32)
    assert H.product(big, big)[0, 0] == 2**57 + 1


def test_hilbert_curve_steps_one_cell_at_a_time():
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        cells = np.array(list(itertools.product(range(2**bits), repeat=dims)))
        order = sorted(zip(H.hilbert_keys(cells, bits), cells.tolist()))
        assert len({k for k, _ in order}) == len(cells)
        assert all(sum(abs(x - y) for x, y in zip(p, q)) == 1 for (_, p), (_, q) in itertools.pairwise(order))


def test_blocks_of_one_label_and_fewer_reads(spark):
    rows = H.quantised(spark.createDataFrame(some(1, 600, 2), SCHEMA))
    index = H.Index(rows, block=16, chunk=4, page=8)
    zones = [(r.label, r.n) for r in index.blocks.collect()]
    assert sum(n for _, n in zones) == rows.count() and max(n for _, n in zones) == 16 and {label for label, _ in zones} == {0, 1, 2, 3}
    whole = index.anchors().selectExpr("chunk", "place", "0 as k", f"{H.LEAST} as low", f"{H.MOST} as high")
    asking = index._asking(whole.withColumns({"reach": H.F.lit(H.LEAST), "reach_id": H.F.lit(H.MOST)}))
    everything = index._over_pages(asking, True, False).count()
    first = index._over_blocks(asking, index._over_pages(asking, True, True), 5).where("rank = 5").selectExpr("chunk", "place", "k", "score as reach", "id as reach_id")
    reached = index._asking(whole.join(first, ["chunk", "place", "k"]))
    assert index._over_pages(reached, True, False).count() < everything  # zone maps rule blocks out
