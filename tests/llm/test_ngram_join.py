import random
import re

import numpy as np
import pytest

from linkscape.llm import ngram_join as N
from linkscape.llm.shingles import shingle_sets

SCHEMA = "doc_id long, text string, lang string, component_id string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = WORD.findall(lowered)
    return {tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set()


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in sets if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if i is not None and j is not None and a and b and 100 * len(a & b) >= 85 * len(a | b):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return sorted(((i, len(s), None if i is None else root(i)) for i, s in sets), key=str)


def run(spark, rows, **options):
    df = spark.createDataFrame([(i, t, "en", "x") for i, t in rows], SCHEMA)
    return sorted((tuple(r) for r in N.ngram_jaccard_join(df, **options).select("doc_id", "n_shingles", "component_id").collect()), key=str)


def corpus(seed):
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(300)]
    rows = []
    for g in range(12):
        base = r.choices(vocabulary, k=r.choice([3, 5, 8, 14, 40, 120, 400]))
        for _ in range(r.randint(1, 9)):
            words = list(base)
            for _ in range(r.randint(0, max(1, len(base) // 25))):
                kind, at = r.random(), r.randrange(len(words))
                if kind < 0.4:
                    words[at] = r.choice(vocabulary)
                elif kind < 0.7:
                    words.insert(at, r.choice(vocabulary))
                elif len(words) > 2:
                    del words[at]
            text = " ".join(words)
            rows.append((len(rows) * 3 % 101 + 1000 * g, text.upper() if r.random() < 0.2 else text))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_pairs(spark, seed):
    rows = corpus(seed)
    assert run(spark, rows) == brute(rows)


def test_blocks_of_a_shard(spark):
    rows = corpus(3)
    assert run(spark, rows, shard_shingles=150) == brute(rows)


def test_segments_are_exchanged_once(spark):
    rows = [(k, 10 + k, s) for k in range(6) for s in (k % 2, 7, 100 + k)]
    segments = spark.createDataFrame(rows, "rep long, n_shingles long, signature long")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        met = N._meetings(segments)
        plan = met._jdf.queryExecution().executedPlan().toString()
        found = {tuple(x) for x in met.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert found == {(k, 10 + k, hub) for k in range(6) for hub in (0, k % 2)}
    assert plan.count("Exchange hashpartitioning(signature") == 1


def test_texts_are_packed_before_a_join():
    import pyarrow as pa

    texts = ["the same words again " * 200, None, "é"]
    [out] = list(N._packed([pa.RecordBatch.from_pydict({"rep": [1, 2, 3], "text": texts})]))
    assert out.schema.names == ["rep", "packed"] and out.column("rep").to_pylist() == [1, 2, 3]
    assert len(out.column("packed")[0].as_py()) * 10 < len(texts[0])
    assert [len(u) for u in N._unpacked(out.column("packed").to_pylist(), 4)] == [4, 0, 1]


def test_edge_cases(spark):
    rows = [(5, None), (4, ""), (3, " \t\n"), (9, "a b"), (2, "A\tB"), (7, "a b c"), (8, "é É é é"), (1, "é É é é"), (None, "a b"), (8, "é É é é"), (6, "x y z"), (10, "x y z"), (11, "q " * 50_000)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []


def test_shingle_hashes_split_like_the_words():
    texts = ["", "a", "a b c d", "A B  C\x0bD e", "é" * 10 + " b c d", "x" * 3_000_000 + " y z w"]
    assert [len(s) for s in shingle_sets([t.encode() for t in texts], 4)] == [len(shingles(t)) for t in texts]


def test_linked_sets_share_a_signature():
    r = np.random.default_rng(1)
    for _ in range(4000):
        n = int(r.integers(1, 80))
        a = np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
        drop = int(r.integers(0, len(a) // 6 + 1))
        b = np.unique(np.concatenate((r.permutation(a)[drop:], r.integers(0, 1 << 63, int(r.integers(0, len(a) // 6 + 1)), dtype=np.uint64))))
        common = len(np.intersect1d(a, b))
        if len(b) and 100 * common >= 85 * (len(a) + len(b) - common):
            assert set(N.signatures(a, 85).tolist()) & set(N.signatures(b, 85).tolist())
