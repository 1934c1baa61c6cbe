import random

import pytest

import corpus_pipeline
from tests.llm.test_decontamination import brute as contaminated
from tests.llm.test_line_dedup import brute as without_runs
from tests.llm.test_ngram_join import brute as groups

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = {"en": "the house stands near river where people often walk after work and think about their day".split(), "de": "das haus steht nahe fluss wo leute oft nach arbeit gehen und über ihren tag denken".split()}


def corpus():
    r = random.Random(8)
    passage = "\n".join(" ".join(r.choices(WORDS["en"], k=20)) for _ in range(3))  # 60 words
    item = " ".join(r.choices(WORDS["de"], k=14))
    rows = []
    for k in range(1, 41):
        lang = "en" if k % 2 else "de"
        text = "\n".join(" ".join(r.choices(WORDS[lang], k=30)) for _ in range(4))
        if k in (5, 11):
            text += "\n" + passage
        if k in (8, 14):
            text += " " + item.upper()
        if k in (21, 23, 40):
            text = rows[r.choice([2, 3])][1]
        rows.append((k, text, lang, "s", len(text)))
    rows += [(50, None, "en", None, None), (51, "12 + 34", None, "s", 7), (52, "", "de", "s", 0)]
    return rows, [("q1", item), ("q2", None)]


def write(spark, folder, rows, items):
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id string, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


@pytest.mark.parametrize("empty", [False, True])
def test_against_brute_force(spark, tmp_path, empty):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    rows, items = ([], []) if empty else corpus()
    found = corpus_pipeline.run(spark, write(spark, tmp_path, rows, items))
    assert found.columns == ["doc_id", "n_tokens", "ids"]
    kept = [(i, t) for i, t, *_ in rows if i < 50]  # the others have no letter
    kept = [(i, t) for i, _, gone, t in without_runs(kept, 50) if gone == 0 or t.strip()]
    first = {i for i, _, root in groups(kept) if root == i}
    kept = [(i, t) for i, t in kept if i in first]
    bad = {r[0] for r in contaminated(kept, items) if r[-1]}
    codec = Tokenizer.from_file(path("word_bpe_49k.json"))
    ids = {i: codec.encode(t, add_special_tokens=False).ids for i, t in kept if i not in bad}
    assert {r["doc_id"]: list(r["ids"]) for r in found.collect()} == ids
    if not empty:
        assert bad == {8, 14} and not {21, 23, 40} & first


def test_null_and_shared_ids_are_judged_by_row(spark, tmp_path):
    r = random.Random(9)

    def text(lang="en", n=60):
        return " ".join(r.choices(WORDS[lang], k=n))

    item, one, two, three, four, five, six = text("de", 14), text(), text("de"), text(), text("de"), text(), text()
    bad = text("de") + " " + item
    labelled = [(k, text("en" if k % 2 else "de"), "en" if k % 2 else "de") for k in range(20, 40)]
    rows = [(None, one, "en"), (None, one, "en"), (None, None, "en"), (None, bad, "de"), (None, two, "de"), (7, three, "en"), (7, three, "en"), (7, "12 + 34", "de"), (7, bad + " haus", "de"), (7, four, "de"), (8, five, "en"), (None, five, "en"), (9, six, "en"), (9, six + " day", "en")]
    folder = write(spark, tmp_path, [(i, t, lang, "s", None) for i, t, lang in rows + labelled], [("q1", item)])
    docs = corpus_pipeline.table(spark, folder, "documents")
    stages = dict(corpus_pipeline.STAGES)

    def after(name, given):
        return sorted(((x.doc_id, x.text) for x in stages[name](spark, given, folder).collect()), key=str)

    def expected(dropped):
        return sorted(((i, t) for i, t, _ in rows + labelled if t not in dropped), key=str)

    assert after("language_id", docs) == expected({None, "12 + 34"})
    assert after("benchmark_decontamination", docs) == expected({bad, bad + " haus"})
    clean = docs.where("text is not null and text <> '12 + 34'")
    got = after("ngram_jaccard_join", clean)
    assert got.count((None, one)) == 1 and got.count((7, three)) == 1 and (7, four) in got and (None, two) in got
    assert (8, five) in got and (None, five) not in got  # a null id comes after all others
    assert sum(i == 9 for i, _ in got) == 1  # near copies under one id
    assert {(i, t) for i, t, _ in labelled} <= set(got)
    assert corpus_pipeline.run(spark, folder).count() > 0


def test_clashing_names_pass_through(spark, tmp_path):
    names = ["n_lines", "n_removed", "gone_id", "gone_key", "row_id", "row_key", "row_number", "component_id", "text_key"]
    r = random.Random(3)
    texts = [" ".join(r.choices(WORDS["en"], k=60)) for _ in range(3)]
    rows = [(k, t, "en", None, None, *range(9)) for k, t in enumerate([texts[0], texts[0], texts[1], texts[2] + "\n" + texts[1]])] * 2
    docs = spark.createDataFrame(rows, SCHEMA + ", " + ", ".join(f"{n} int" for n in names))
    folder = write(spark, tmp_path, [], [("q1", "ab")])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, folder)
        assert got.columns == docs.columns and all(tuple(x)[5:] == tuple(range(9)) for x in got.collect()), name


def test_languages_are_predicted_before_the_texts_are_shuffled(spark, tmp_path):
    rows, items = corpus()
    folder = write(spark, tmp_path, rows, items)
    kept = corpus_pipeline.known_language(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder)
    assert "MapInArrow" not in kept._jdf.queryExecution().executedPlan().toString()
    assert {r.doc_id for r in kept.collect()} == set(range(1, 41))
