import math
import random
import re
from collections import Counter

from linkscape.llm import secrets as S

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)


def entropy(s):
    return -sum(c / len(s) * math.log2(c / len(s)) for c in Counter(s).values())


def brute(text):
    text = text or ""
    out = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    for m in re.finditer("[A-Za-z0-9+/_=-]+", text):
        s, w = m[0], S.ENTROPY_WINDOW
        if len(s) < w or not re.search("[0-9]", s) or not re.search("[A-Za-z]", s) or any(re.search(p, s) for p in S.ALLOW):
            continue
        bits = S.ENTROPY_BITS["hex" if re.fullmatch("[0-9A-Fa-f]+", s) else "base64"]
        over = [i for i in range(len(s) - w + 1) if entropy(s[i : i + w]) >= bits - 1e-9]
        if over:
            out.append((m.start() + over[0], 3, "entropy", m.start() + over[-1] + w))
    return sorted(out)


def run(spark, rows):
    df = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, spans string")
    return sorted(((r.doc_id, [tuple(x) for x in r.spans]) for r in S.secret_scan(df).collect()), key=str)


def test_against_brute_force(spark):
    r = random.Random(5)
    alphabet = "ABCDEFabcdef0123456789+/_=-ghijXYZ"
    parts = ["password", "PassWd", "api_key", "APIKEY", "token", "secret", "=", ":", " = ", '"', "'", ": ", "AKIA", "AKIAABCDEFGHIJKL", "é", "😀", " ", "\n", "abc", "short", "123e4567-e89b-12d3-a456-426614174000", "example", "0123456789abcdef"]
    rows = []
    for k in range(150):
        text = ""
        for _ in range(r.randint(0, 25)):
            text += r.choice(parts) if r.random() < 0.75 else "".join(r.choices(alphabet if r.random() < 0.5 else "0123456789abcdef", k=r.randint(1, 50)))
        rows.append((k, text))
    rows += [(None, "token=abcdefgh"), (3, rows[3][1]), (3, "token=abcdefgh12"), (900, None), (901, ""), (902, "token=secret: abcdefghij"), (903, "ſecret=abcdefgh toKen=abcdefgh")]
    expected = sorted(((i, brute(t)) for i, t in rows), key=str)
    assert run(spark, rows) == expected
    assert sum(len(s) for _, s in expected) > 100


def test_long_texts(spark):
    rows = [(1, "a" * 300_000), (2, "x7" * 20_000), (3, "token " * 30_000 + "token=abcdefgh1"), (4, "AKIA" * 20_000)]
    assert run(spark, rows) == sorted(((i, brute(t)) for i, t in rows), key=str)
    assert run(spark, []) == []


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    plan = S.secret_scan(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
