import random
import re

import public_tokenizers

from linkscape.llm import licenses as L
from linkscape.llm import token_counts as C

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


def test_histogram_answers_every_limit(spark):
    r = random.Random(3)
    texts = [" ".join(r.choices(["a", "été", "longish", "\n"], k=r.choice([1, 5, 5, 30, 3000]))) for _ in range(40)] + [None, "", "z" * 200_000]
    df = spark.createDataFrame([(k if k else None, t, k) for k, t in enumerate(texts)], "doc_id long, text string, n_tokens int")
    n = sorted(len(C._encoding(PATH).encode_ordinary(t or "")) for t in texts)
    lengths = C.token_lengths(df, PATH).cache()
    assert sorted(x.n_tokens for x in lengths.collect()) == n
    hist = C.length_histogram(lengths).cache()
    for row in hist.collect():
        x = row.n_tokens
        assert tuple(row) == (x, n.count(x), sum(y >= x for y in n), sum(y for y in n if y >= x), sum(y <= x for y in n), sum(min(x, y) for y in n))
    for limit in (0, 1, 17, 2048, 10**9):
        assert C.truncated_total(hist, limit) == sum(min(y, limit) for y in n)
    assert C.quantile(hist, 0.5) == n[(len(n) + 1) // 2 - 1]
    empty = C.length_histogram(C.token_lengths(df.limit(0), PATH))
    assert empty.collect() == [] and C.truncated_total(empty, 5) == 0


def plain(text):
    return re.findall(r"[a-z0-9\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))


def brute(text, notices):
    """Every stretch of every notice, compared word for word; the best is taken, again and again."""
    w, out = plain(text), []
    for name, notice in notices.items():
        t = plain(notice)
        if len(t) < 9:
            out += [(name, a, a + len(t), 1.0) for a in range(len(w) - len(t) + 1) if w[a : a + len(t)] == t]
            continue
        grams = {tuple(t[k : k + 5]) for k in range(len(t) - 4)}
        own = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        todo = [(0, len(own))]
        while todo:
            low, high = todo.pop()
            best = None
            for a in range(low, high):
                if own[a] not in grams:
                    continue
                seen = set()
                for z in range(a, min(high, a + int(1.25 * (len(t) - 4)))):
                    if own[z] in grams and own[z] not in seen:
                        seen.add(own[z])
                        if 100 * len(seen) >= 80 * len(grams):
                            best = min(filter(None, (best, (-len(seen), z - a, a, z))))
            if best:
                out.append((name, best[2], best[3] + 5, -best[0] / len(grams)))
                todo += [(low, best[2] - 4), (best[3] + 5, high)]
    return sorted(out)


def test_finds_are_those_of_brute_force(spark):
    r = random.Random(8)
    names, rows = list(L.TEMPLATES), []
    for k in range(80):
        text = [f"w{r.randint(0, 200)}" for _ in range(r.randint(0, 300))]
        for name in r.sample(names, r.randint(0, 3)):
            own = L.TEMPLATES[name].upper().split()
            for _ in range(r.choice([1, 1, 2])):  # copies side by side or apart, whole or edited
                copy = [f"w{r.randint(0, 9)}" if r.random() < r.choice([0, 0.03]) else x for x in own]
                if r.random() < 0.3:  # a stray part before it
                    copy = own[: r.randint(0, len(own))] + ["and"] * r.randint(0, 6) + copy
                at = r.randint(0, len(text))
                text[at:at] = copy
        rows.append((k, " ".join(text), "x"))
    mit, bsd = L.TEMPLATES["MIT"], L.TEMPLATES["BSD-3-Clause"]
    rows += [(100, None, "x"), (101, "", "x"), (None, "Licensed under CC BY-NC 4.0", "x"), (102, "the GNU General Public", "x"), (103, f"{mit} x {mit} {mit}", "x"), (104, f"{mit} " * 30, "x")]
    rows += [(105, " ".join(bsd.split()[3:12]) + " one two three four five six " + bsd, "x"), (106, mit[:60], "x"), (107, mit[60:], "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, found string")
    got = {x.doc_id: [(f.license, f.first_word, f.end_word, f.containment) for f in x.found] for x in L.license_scan(df.coalesce(1)).collect()}
    n = 0
    for i, t, _ in rows:
        want = brute(t or "", L.TEMPLATES)
        assert got[i] == want, i
        n += len(want)
    assert n > 150 and sum(f[0] == "MIT" for f in got[104]) == 30
    assert [f[1:3] for f in got[105] if f[0] == "BSD-3-Clause"] == [(15, 15 + len(plain(bsd)))]
    assert L.license_scan(df.limit(0)).collect() == []


def test_windows_across_the_parts_that_are_hashed_at_once(monkeypatch):
    monkeypatch.setattr(L, "SPAN", 64)
    r, templates = random.Random(4), L.Templates(L.TEMPLATES)
    assert all(t.bands > 1 and (1 - (t.need / (t.step * t.blocks + len(t.set) - t.need)) ** L.ROWS) ** t.bands <= L.MISS for t in templates.long)
    for _ in range(6):
        texts = []
        for _ in range(5):
            text = [f"w{r.randint(0, 200)}" for _ in range(r.randint(0, 150))]
            for name in r.sample(list(L.TEMPLATES), 2):
                at = r.randint(0, len(text))
                text[at:at] = L.TEMPLATES[name].split()
            texts.append(" ".join(text))
        h, first = L.words([t.encode() for t in texts], L.PUNCTUATION)
        assert templates.scan(h, first) == [brute(t, L.TEMPLATES) for t in texts]


def test_short_and_further_notices(spark):
    filler = " ".join(f"w{k}" for k in range(100))
    rows = {1: ("Released under the MIT License.", "MIT-release"), 2: ("All rights reserved.", "all-rights-reserved"), 3: (L.TEMPLATES["Unlicense"], "Unlicense"), 4: (L.TEMPLATES["LGPL-3.0"], "LGPL-3.0"), 5: (L.TEMPLATES["no-reproduction"], "no-reproduction")}
    df = spark.createDataFrame([(k, t) for k, (t, _) in rows.items()] + [(k + 10, f"{filler} {t} {filler}") for k, (t, _) in rows.items()] + [(30, "all rights are reserved")], "doc_id long, text string")
    got = {x.doc_id: [(f.license, f.first_word, f.end_word, f.containment) for f in x.found] for x in L.license_scan(df).collect()}
    for k, (_, name) in rows.items():
        assert name in {f[0] for f in got[k]} and name in {f[0] for f in got[k + 10]}
    assert got[2] == [("all-rights-reserved", 0, 3, 1.0)] and got[12] == [("all-rights-reserved", 100, 103, 1.0)] and got[30] == []
    own = {x.doc_id: x.found for x in L.license_scan(df, {"one": "Reserved"}).collect()}
    assert [(f.first_word, f.end_word) for f in own[12]] == [(102, 103)] and own[11] == []
