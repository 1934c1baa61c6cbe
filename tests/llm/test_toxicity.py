import itertools
import math
import re
import zlib

import numpy as np

from linkscape.llm import toxicity as X


def by_hand(symbols):
    """Classes of the clauses of a string of symbols, without any machine."""
    found, verb, quoted = [], False, False
    clause, under = "", False
    for x in symbols + ".":
        if x in ",.":
            matches = [k for k, ok in (("aimed", "I" in clause and "Y" in clause), ("bare", "I" in clause and "Y" not in clause), ("threat", "H" in clause and "Y" in clause)) if ok]
            negated = re.match(r"[^IH]*N", clause) is not None
            found += [(k, "reported" if under else "negated" if negated else "plain") for k in matches]
            clause, under = "", False
            verb = verb and x == ","
        elif x == "Q":
            quoted = not quoted
        else:
            under |= x in "IH" and (verb or quoted)
            verb |= x == "R"
            clause += x
    return sorted(found)


def by_machine(symbols):
    state, found = 0, []
    for x in symbols + ".":
        found += [X.CLASSES[k] for k in X.SAYS[state].get(x, ())]
        state = X.STEP[state][x]
    return sorted(found)


def test_composed_machine_against_reading_by_hand():
    for n in range(6):
        for symbols in itertools.product("IHYNRQ,.", repeat=n):
            symbols = "".join(symbols)
            assert by_machine(symbols) == by_hand(symbols), symbols


def test_clauses_not_words():
    lexicon = X.Lexicon({"idiot$": 3.0})
    at = {c: k for k, c in enumerate(X.CLASSES)}
    one = math.log1p(3.0)
    for text, kind in {
        "You idiot!": ("aimed", "plain"), "An idiot.": ("bare", "plain"), "You are not an idiot.": ("aimed", "negated"), "He wrote: you idiot": ("aimed", "reported"),
        'It was "you idiot" again': ("aimed", "reported"), "You do not listen, idiot": ("bare", "plain"), "IDIOT": ("bare", "plain"),
    }.items():
        got = lexicon.features(text)
        assert got[at[kind]] == one and sum(x > 0 for x in got[:-1]) == 1, text
    assert lexicon.features("I will kill you")[at["threat", "plain"]] == math.log1p(1.0)
    assert not any(lexicon.features("We kill time, and the idiotic is no unit here"))
    assert lexicon.features("You idiot, " * 50_000)[at["aimed", "plain"]] == math.log1p(150_000)


def corpus():
    rng = np.random.default_rng(3)
    plain = ["".join(rng.choice(list("abdegilmnoprstu"), 4)) for _ in range(300)]
    docs, labels = [], []
    for i in range(800):
        words = list(rng.choice(plain, 30))
        toxic = int(i % 8 == 0)
        for _ in range(3 * toxic):
            words.insert(int(rng.integers(30)), "zwux" + str(rng.choice(["a", "en", "ig", "ter"])))
        docs.append((i, " ".join(words), "x"))
        labels.append((i, toxic, 1))
    copy = " ".join(rng.choice(plain, 30)) + " onlyhere"
    docs += [(1000 + i, copy, "x") for i in range(200)]  # copies of one toxic text teach nothing about its words
    labels += [(1000 + i, 1, 1) for i in range(200)]
    return docs, labels


def test_learned_beginnings_held_out_rows_and_copies(spark):
    docs, labels = corpus()
    d, m = spark.createDataFrame(docs, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, toxic int, predicted int")
    model = X.train(d, m)
    assert any(u.startswith("zwux") for u in model.lexicon.units) and "onlyhere$" not in model.lexicon.units
    got = {r.doc_id: r for r in X.toxicity(d, model).collect()}
    rows = [(i, t) for i, t, _ in labels if i < 1000 and zlib.crc32(str(i).encode()) % 4 == 2]
    assert rows and all(got[i].predicted == t for i, t in rows)
    # labels of held-out rows are never read
    flipped = [(i, 1 - t if zlib.crc32(str(i).encode()) % 4 == 2 else t, q) for i, t, q in labels]
    again = X.train(d, spark.createDataFrame(flipped, "doc_id long, toxic int, predicted int"))
    assert again.lexicon.units == model.lexicon.units and np.allclose(again.weights, model.weights)


def test_a_word_that_only_toxic_texts_hold_in_thousands_of_places(spark):
    rng = np.random.default_rng(5)
    plain = ["".join(rng.choice(list("abdegilmnoprstu"), 4)) for _ in range(300)]
    rows = [(" ".join(x for w in rng.choice(plain, 25) for x in ((w, "zwuxigkeiten") if i % 8 == 0 else (w,))), int(i % 8 == 0)) for i in range(1200)]
    units = X.learn_lexicon(spark.createDataFrame(rows, "text string, toxic int")).units
    assert [units[u] for u in X.units_of("zwuxigkeiten")] == [8.0] * 7 and all(0 <= x <= 8 for x in units.values())


def test_edges(spark):
    schema = "doc_id long, text string, score double"
    rows = [(1, None, 0.0), (2, "", 0.0), (2, "", 0.0), (None, "you idiot", 0.0), (3, "x" * 300_000, 0.0), (4, "1234 !!", 0.0)]
    docs = spark.createDataFrame(rows, schema)
    none = X.train(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert np.allclose(none.weights, X.fit_weights([]))
    some = X.train(docs, spark.createDataFrame([(None, 1), (1, 1), (2, None), (4, 0), (4, 1), (9, 5)], "doc_id long, toxic int"))
    for model in (none, some):
        got = X.toxicity(docs, model).collect()
        assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
        assert {r.score for r in got if r.doc_id is not None} == {model.score("")} and model.score("you idiot") > model.score("")
    assert X.toxicity(docs.limit(0), none).collect() == []


def test_on_given_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{x}.parquet") for x in ("documents", "labels"))
    found = X.toxicity(docs, X.train(docs, labels)).join(labels, "doc_id").where(X.held_out()).groupBy("toxic", "predicted").count().collect()
    n = {(r.toxic, r.predicted): r["count"] for r in found}
    assert n.get((1, 1), 0) >= 0.95 * (n.get((1, 1), 0) + n.get((1, 0), 0)) and n.get((0, 1), 0) <= 0.02 * n[0, 0]
