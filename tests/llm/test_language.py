import itertools
import math
import zlib

import numpy as np

from linkscape.llm import language as L


def test_forward_sums_all_segmentations():
    table = {p: np.array([0.01 * (k + 1), 0.3 / (k + 1)]) for k, p in enumerate(["a", "b", "ab", "ba", "aba"])}
    model = L.Model(["x", "y"], table)
    for word in ["abab", "ba", "abaab", "acb"]:
        total = np.zeros(2)
        for cut in itertools.product([0, 1], repeat=len(word) - 1):
            edges = [0, *[i + 1 for i, c in enumerate(cut) if c], len(word)]
            product = np.ones(2)
            for i, j in zip(edges, edges[1:]):
                p = word[i:j]
                product = product * (table.get(p, 0.0) + (L.FLOOR if j - i == 1 else 0.0))
            total += product
        scorer = L.Scorer(model)
        scorer.learn([word, "a"])
        assert np.allclose(np.exp(scorer.total([word])), total, rtol=1e-12)


def test_held_out_accuracy_and_edges(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    more = spark.createDataFrame([(-1, None), (-2, ""), (-3, "123 !!"), (-4, "der und die " * 30_000), (None, "the and of"), (-5, "x" * 100_000)], "doc_id long, text string")
    model = L.train(docs, sample_chars=200_000)
    got = {r.doc_id: r for r in L.predict(more, model).collect()}
    assert [got[i].lang_pred for i in (-1, -2, -3)] == ["und"] * 3 and got[-4].lang_pred == "de" and got[None].lang_pred == "en"
    assert all(0 <= r.score <= 1 for r in got.values())
    rows = docs.join(L.predict(docs, model), "doc_id").select("doc_id", "lang", "lang_pred", L.held_out().alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    kept = [r for r in rows if r.h and r.lang]
    assert sum(r.lang == r.lang_pred for r in kept) / len(kept) > 0.97


def test_nothing_learned(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    model = L.fit(empty, ["a"])
    assert L.predict(empty, model).collect() == []
    one = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert [tuple(r) for r in L.predict(one, L.fit(one, ["a"])).collect()] == [(1, "und", 0.0)]
    assert math.isfinite(L.FLOOR)


def test_long_runs_outside_all_languages(spark):
    french, english = "le chat est dans la maison et il dort ", "the cat is in the house and it sleeps "
    run = "".join(chr(0x4E00 + 7 * k) for k in range(150))
    rows = [(1, french * 20, "fr"), (2, english * 20, "en"), (3, french + run, "fr"), (4, english + run, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    vocabulary = sorted({w for t in (french, english) for w in t.split()} | set(french + english) - {" "})
    model = L.fit(docs, vocabulary)  # divided by zero before
    assert all(math.isfinite(x) and x > 0 for row in model.table.values() for x in row)
    asked = spark.createDataFrame([(1, french + run + " " + french), (2, run + english), (3, run)], "doc_id long, text string")
    got = {r.doc_id: r for r in L.predict(asked, model).collect()}
    assert got[1].lang_pred == "fr" and got[2].lang_pred == "en" and got[1].score > 0.99 and got[2].score > 0.99
    assert all(0 <= r.score <= 1 for r in got.values())


TABLE = {p: (0.01 * (k + 1), 0.3 / (k + 1)) for k, p in enumerate(["a", "b", "ab", "ba", "aba"])}


def test_scaled_sums_and_logs_agree_with_plain_sums(monkeypatch):
    model, word = L.Model(["x", "y"], TABLE), "abaabcababbaacccccccccccabaabcab"
    plain = L.Scorer(model).forward([word])[0], [L._shares(model.cuts(word), TABLE, k) for k in range(2)]
    monkeypatch.setattr(L, "STRIDE", 3)
    assert np.allclose(L.Scorer(model).forward_long(word), plain[0], rtol=1e-12)
    monkeypatch.setattr(L, "PLAIN", 0)
    for k in range(2):
        logs = L._shares(model.cuts(word), TABLE, k)
        assert [p for p, _ in logs] == [p for p, _ in plain[1][k]] and np.allclose([x for _, x in logs], [x for _, x in plain[1][k]], rtol=1e-9)


def test_very_long_words_are_one_word():
    model = L.Model(["x", "y"], TABLE)
    scorer = L.Scorer(model)
    for word in ("\u12c8" * 100_000, "ab" * 50_000):
        scorer.learn([word])
        assert np.isfinite(scorer.total([word])).all() and not scorer.rows
    # a word without any piece has one segmentation
    assert np.allclose(scorer.total(["\u12c8" * 100_000]), 100_000 * math.log(L.FLOOR))
    assert np.isfinite(sum(x for _, x in L._shares(model.cuts("ab" * 5_000), TABLE, 0)))


def segmentations(word, table, k):
    """All ways to cut ``word``, as (pieces, probability); a character that is no piece's use has FLOOR."""
    if not word:
        yield [], 1.0
    for j in range(1, len(word) + 1):
        for head, weight in ([(word[:j], table[word[:j]][k])] if word[:j] in table else []) + ([(None, L.FLOOR)] if j == 1 else []):
            for rest, p in segmentations(word[j:], table, k):
                yield [head, *rest], weight * p


def test_training_and_prediction_against_enumeration(spark):
    vocabulary = ["a", "b", "c", "ab", "bc", "abc", "cab"]
    rows = [(1, "abc cab abab", "x"), (2, "cc abc bbb", "x"), (3, "ba ba cb d", "y"), (4, "bcbc \u12c8a", "y"), (5, None, "x"), (6, "abc", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = L.fit(docs, vocabulary, rounds=2)
    languages = ["x", "y"]
    table = {p: (1 / len(vocabulary),) * 2 for p in vocabulary}
    for _ in range(2):
        weight = {p: [L.SMOOTH * 0.01] * 2 for p in vocabulary}
        for _, text, lang in rows:
            for word in (text or "").split() if lang else []:
                k = languages.index(lang)
                ways = list(segmentations(word, table, k))
                total = sum(p for _, p in ways)
                for found, p in ways:
                    for piece in filter(None, found):
                        weight[piece][k] += p / total
        totals = [sum(w[k] for w in weight.values()) for k in range(2)]
        table = {p: tuple(x / t for x, t in zip(w, totals)) for p, w in weight.items()}
    assert model.languages == languages and all(np.allclose(model.table[p], table[p], rtol=1e-6) for p in vocabulary)
    asked = [(1, "abc ba"), (2, "bcb"), (3, "cab c d")]
    got = {r.doc_id: r for r in L.predict(spark.createDataFrame(asked, "doc_id long, text string"), model).collect()}
    for i, text in asked:
        logs = [sum(math.log(sum(p for _, p in segmentations(w, table, k))) for w in text.split()) for k in range(2)]
        assert got[i].lang_pred == languages[int(np.argmax(logs))]
        assert math.isclose(got[i].score, 1 / sum(math.exp(x - max(logs)) for x in logs), rel_tol=1e-6)
