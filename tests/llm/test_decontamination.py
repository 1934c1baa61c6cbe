import random
import re

from linkscape.llm import decontamination as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, window=10):
    out = []
    for doc_id, text in docs:
        w, hit, met = words(text), set(), set()
        for item_id, item in items:
            v = words(item)
            n = min(window, len(v))
            grams = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if n else set()
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in grams:
                    hit |= set(range(i, i + n))
                    met.add(str(item_id))
        out.append((doc_id, len(w), len(hit), len(met), sorted(met), bool(hit)))
    return sorted(out, key=str)


def run(spark, docs, items, **options):
    d = spark.createDataFrame([(i, t, "z") for i, t in docs], "doc_id long, text string, item_id string")
    b = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id long")
    return sorted((tuple(r) for r in D.contamination(d, b, **options).drop("text_key").collect()), key=str)


def test_against_brute_force(spark):
    r = random.Random(4)
    vocabulary = ["ab", "É", "é", "ça", "x1", "日本", "the", "K", "zz"] + [f"w{k}" for k in range(30)]
    items = [(k, ", ".join(r.choices(vocabulary, k=r.choice([1, 3, 8, 9, 10, 11, 25, 40])))) for k in range(30)]
    docs = []
    for k in range(60):
        text = r.choices(vocabulary, k=r.randint(0, 80))
        for _ in range(r.randint(0, 3)):
            v = items[r.randrange(len(items))][1].split(", ")
            a = r.randrange(len(v))
            part = v[a : a + r.randint(1, 30)]
            at = r.randint(0, len(text))
            text[at:at] = [x.upper() if r.random() < 0.3 and x.isascii() else x for x in part]
        docs.append((k, "-".join(text)))
    docs += [(None, docs[3][1]), (7, docs[7][1]), (8, docs[9][1]), (100, None), (101, ""), (102, "--"), (103, "w1 " * 20_000)]
    items += [(90, None), (91, "!!"), (3, items[5][1])]
    assert run(spark, docs, items) == brute(docs, items)
    assert run(spark, docs, items, prints_a_pass=400) == brute(docs, items)  # a benchmark of several passes


def test_empty_tables(spark):
    assert run(spark, [], [(1, "a b")]) == []
    assert run(spark, [(1, "a b c")], []) == [(1, 3, 0, 0, [], False)]


def test_no_python_in_the_plan(spark):
    d = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    plan = D.contamination(d, b)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
