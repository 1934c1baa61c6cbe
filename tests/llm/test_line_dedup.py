import random

from linkscape.llm import line_dedup as D


def brute(rows, min_words):
    """``rows`` in document order; every repeated run of at least ``min_words`` words, by all pairs of starts."""
    seqs = [[(k, x) for k, x in enumerate((t or "").split("\n")) if t is not None and x.strip(" \t\r\x0b\x0c")] for _, t in rows]
    seen, gone = set(), [set() for _ in rows]
    places = [(d, a) for d, s in enumerate(seqs) for a in range(len(s))]
    for d, a in places:
        s, words = seqs[d], 0
        for z in range(a, len(s)):
            words += len(s[z][1].split())
            run = tuple(x for _, x in s[a : z + 1])
            if words >= min_words:
                if run in seen:
                    gone[d].update(k for k, _ in s[a : z + 1])
                seen.add(run)
    out = []
    for (i, t), g in zip(rows, gone):
        lines = (t or "").split("\n")
        out.append((i, 0 if t is None else len(lines), len(g), None if t is None else "\n".join(x for k, x in enumerate(lines) if k not in g)))
    return out


def run(spark, rows, min_words):
    df = spark.createDataFrame([(i, t, 7, "q") for i, t in rows], "doc_id long, text string, n_lines int, line_no string")
    found = D.line_dedup(df, min_words=min_words)
    assert found.columns == ["doc_id", "text", "line_no", "n_lines", "n_removed"]
    return sorted((tuple(r) for r in found.select("doc_id", "n_lines", "n_removed", "text").collect()), key=str)


def test_against_brute_force(spark):
    r = random.Random(6)
    pool = [" ".join(r.choices("abcdefgh", k=r.randint(1, 4))) for _ in range(9)] + ["", "  ", "\t"]
    rows = []
    for k in range(40):
        lines = [r.choice(pool) if r.random() < 0.7 else f"only {k} {n}" for n in range(r.randint(0, 14))]
        if rows and r.random() < 0.5:
            other = (r.choice(rows)[1] or "").split("\n")
            a = r.randrange(len(other))
            lines[r.randint(0, len(lines)) :][:0] = []
            lines += other[a : a + r.randint(1, 9)]
        rows.append((k, "\n".join(lines)))
    rows[5:5] = []
    rows += [(100, None), (101, ""), (102, "a b c d e f g h\n" * 40)]
    for min_words in (1, 6):
        assert run(spark, rows, min_words) == sorted(brute(rows, min_words), key=str)


def test_edge_cases(spark):
    line = " ".join("abcdefghij")
    assert run(spark, [], 5) == []
    assert run(spark, [(None, line), (1, line), (1, line), (2, "x\n" + line)], 5) == sorted([(None, 1, 0, line), (1, 1, 1, ""), (1, 1, 1, ""), (2, 2, 1, "x")], key=str)


def test_clashing_names(spark):
    line = " ".join("abcdefghij")
    names = ["line_nos", "_key", "key", "_lines", "LINES", "text_key", "gone_id", "seq", "rank_0"]
    df = spark.createDataFrame([(1, line, *range(9)), (2, "y\n" + line, *range(10, 19))], "doc_id long, text string, " + ", ".join(f"{n} int" for n in names))
    got = D.line_dedup(df, min_words=5)
    assert got.columns == [*df.columns, "n_lines", "n_removed"]
    assert sorted(map(tuple, got.collect())) == [(1, line, *range(9), 1, 0), (2, "y", *range(10, 19), 2, 1)]
