import random
import re
import time

import duckdb
import numpy as np

from linkscape.llm import chat as C
from linkscape.llm import media as M


def test_quotes_are_linked_and_dropped(spark):
    rows = [
        (1, 0, "User", "Hello  there\nsecond line"), (1, 1, "assistant", "an answer"), (1, 2, "user", "On Monday X wrote:\n> hello there\n> > older\nmy reply\n"),
        (1, 3, None, ">AN ANSWER\n> unknown\nyes"), (1, 4, "user", "no quote"), (2, 5, "user", "> an answer\nother conversation"), (None, 1, "user", "> x"), (3, None, "user", None), (4, 7, "user", ""), (1, 4, "user", "no quote"),
    ]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, parent_turn int")
    got = sorted(((r.conv_id, r.turn, r.role, r.parent_turn, r.n_quoted, r.n_linked, r.deepest, r.text) for r in C.chat_format(df).collect()), key=str)
    assert got == sorted([
        (1, 0, "user", None, 0, 0, 0, "Hello  there\nsecond line"), (1, 1, "assistant", 0, 0, 0, 0, "an answer"), (1, 2, "user", 0, 2, 1, 2, "> > older\nmy reply"),
        (1, 3, "user", 1, 2, 1, 1, "yes"), (1, 4, "user", 3, 0, 0, 0, "no quote"), (1, 4, "user", 3, 0, 0, 0, "no quote"), (2, 5, "user", None, 1, 0, 1, "> an answer\nother conversation"),
        (None, 1, "user", None, 1, 0, 1, "> x"), (3, None, "user", None, 0, 0, 0, ""), (4, 7, "user", None, 0, 0, 0, ""),
    ], key=str)
    assert C.chat_format(df.limit(0)).collect() == []
    plan = C.chat_format(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def brute_chat(rows):
    """Parents, threads and linked passages by comparing every passage with every earlier message."""

    def level(line):
        return re.match(r"(?:[ \t]*>)*", line)[0].count(">")

    def keys(lines):
        words = [w for x in lines for w in x]
        return {tuple(words[i : i + 4]) for i in range(len(words) - 3)} | {("line", *x) for x in lines if 0 < len(x) < 4}

    def split(line):
        return re.sub(r"^(?:[ \t]*>)+", "", line).lower().split()

    out, texts, cleaned = {}, {(c, t, x) for c, t, x in rows}, {}
    own: dict = {}
    for c, t, x in texts:
        own.setdefault((c, t), set()).update(keys([split(y) for y in x.split("\n") if not level(y) and not re.match(C.ANNOUNCES, y)]))
    for c, t in {(c, t) for c, t, _ in texts}:
        by_level: dict = {}
        n_linked = 0
        for x in [x for c2, t2, x in texts if (c2, t2) == (c, t)]:
            runs: list = []
            for y in x.split("\n"):
                if not runs or runs[-1][0] != level(y):
                    runs.append((level(y), []))
                runs[-1][1].append(split(y))
            gone: list = []
            for lv, lines in runs:
                gone += [False] * len(lines)
                votes: dict = {}
                for k in keys(lines) if lv else ():
                    earlier = [t2 for (c2, t2), ks in own.items() if c2 == c and t2 < t and k in ks]
                    if earlier:
                        votes[max(earlier)] = votes.get(max(earlier), 0) + 1
                if votes:
                    v, o = max((v, o) for o, v in votes.items())
                    if 2 * v >= len(keys(lines)):
                        n_linked += 1
                        gone[-len(lines) :] = [True] * len(lines)
                        by_level.setdefault(lv, {}).setdefault(o, 0)
                        by_level[lv][o] += v
            every = x.split("\n")
            follows = [next((gone[j] for j in range(i + 1, len(every)) if every[j].strip()), False) for i in range(len(every))]
            cleaned[c, t, x] = "\n".join(y for i, y in enumerate(every) if not gone[i] and not (follows[i] and not level(y) and re.match(C.ANNOUNCES, y))).rstrip()
        before = [t2 for c2, t2, _ in texts if c2 == c and t2 < t]
        parent = max((v, o) for o, v in by_level[min(by_level)].items())[1] if by_level else max(before, default=None)
        out[c, t] = (parent, n_linked)
    done = {}
    for (c, t), (parent, n) in out.items():
        top, depth = t, 0
        while out[c, top][0] is not None:
            top, depth = out[c, top][0], depth + 1
        done[c, t] = (parent, n, top, depth)
    return done, cleaned


def talks(seed):
    """Conversations whose messages quote earlier ones: whole, in part, wrapped anew, in other case, nested."""
    r = random.Random(seed)
    words = [f"w{k}" for k in range(25)] + ["Yes", "No"]
    rows = []
    for conv in range(6):
        said: list = []
        for turn in range(12):
            lines = [" ".join(r.choices(words, k=r.choice([1, 2, 3, 6, 9]))) for _ in range(r.randint(0, 3))]
            for _ in range(r.choice([0, 1, 1, 2]) if said else 0):
                source = r.choice(said).split("\n")
                a = r.randrange(len(source))
                part = " ".join(source[a : a + r.randint(1, 3)]) if r.random() < 0.5 else source[a]
                flat = part.replace(">", " ").split()
                flat = flat[r.randint(0, len(flat) // 3) :]
                width, mark = r.choice([3, 5, 50]), r.choice(["> ", ">> ", " > > ", ">"])
                lines += (["On Monday X wrote:"] if r.random() < 0.4 else []) + [mark + " ".join(w.upper() if r.random() < 0.1 else w for w in flat[i : i + width]) for i in range(0, len(flat), width)]
                lines += [r.choice(words) + " end"] if r.random() < 0.5 else []
            said.append("\n".join(lines))
            rows.append((conv, turn, said[-1]))
    return rows + rows[5:8] + [(0, 3, "> w1 w2\n>> Yes"), (0, 40, "")]


def test_links_against_brute_force_and_sql(spark):
    rows = talks(3)
    df = spark.createDataFrame([(c, t, "User", x) for c, t, x in rows], "conv_id long, turn long, role string, text string")
    found = C.chat_format(df)
    got = found.collect()
    want, cleaned = brute_chat(rows)
    assert len(got) == len(rows) and {(x.conv_id, x.turn): (x.parent_turn, x.n_linked, x.thread_turn, x.depth) for x in got} == want
    assert sum(n > 0 for _, n, *_ in want.values()) > 15 and len({x.level for x in C.passage_links(df).collect()}) > 1
    assert sorted((x.conv_id, x.turn, x.text) for x in got) == sorted((c, t, cleaned[c, t, x]) for c, t, x in rows)
    conversations = df.toPandas()  # noqa: F841
    assert sorted(map(repr, duckdb.sql(C.OP4_SQL).select(*found.columns).fetchall())) == sorted(repr(tuple(x)) for x in got)


def test_marks_and_spaces_without_end_and_prompts(spark):
    code = "Try this:\n>>> print(1)\n1\n>>> x = 2"
    rows = [(1, 0, "words that are quoted later " + " " * 1_000_000 + "end"), (1, 1, ">" * 200_000), (1, 2, "> " * 100_000 + "words that are quoted later"), (1, 3, code), (1, 4, " " * 300_000), (1, 5, "a" + "\t \n" * 100_000), (1, 6, "on " + "wrote " * 100_000 + ":")]
    df = spark.createDataFrame([(c, t, "user", x) for c, t, x in rows], "conv_id long, turn long, role string, text string")
    start = time.time()
    got = {r.turn: r for r in C.chat_format(df).collect()}
    assert time.time() - start < 60
    assert got[1].deepest == 200_000 and got[1].text == ">" * 200_000 and got[1].n_linked == 0
    assert got[2].deepest == 100_000 and got[2].parent_turn == 0 and got[2].text == ""
    assert got[3].text == code and got[3].n_quoted == 2 and got[4].text == "" and got[5].text == "a" and got[6].text == rows[6][2].rstrip()


def tune(notes):
    t = np.arange(1000) / M.RATE
    return (np.concatenate([np.sin(2 * np.pi * 220 * 2 ** (n / 12) * t) for n in notes]) * 9000).astype("<i2")


def test_integral_image_equals_plain_sums():
    image = M.chroma(tune([0, 4, 7, 12, 3, 9, 2, 5, 11, 1]))
    assert image.shape[1] == 12 and len(M.fingerprint(image)) == len(image) - M.WIDE + 1
    wrapped = np.concatenate((image, image[:, :6]), axis=1)
    kind, p, high, wide = M.FILTERS[1]
    value = wrapped[:wide, p : p + high].sum() - wrapped[:wide, p + high : p + 2 * high].sum()
    scale = M.LOW * wide * high
    assert M.fingerprint(image)[0] >> 28 & 3 == (2 if value > scale else 3 if value > 0 else 1 if value > -scale else 0)


def test_alignment_finds_shifted_and_copied_recordings(spark):
    r = np.random.default_rng(2)
    notes = r.integers(0, 24, 60).tolist()
    wave = tune(notes)
    shift = 20 * M.HOP
    rows = [(1, wave.tobytes()), (2, wave[shift:].tobytes()), (3, wave.tobytes()), (4, tune(r.integers(0, 24, 60).tolist()).tobytes()), (5, None), (6, b"abc"), (None, wave.tobytes())]
    df = spark.createDataFrame([(i, bytearray(a) if a is not None else None, "x") for i, a in rows], "rec_id long, audio binary, copies string")
    prints = M.fingerprints(df)
    got = M.align(prints, spark.createDataFrame([(2,), (5,)], "rec_id long")).collect()
    assert [(x.query_id, x.rec_id, x.copies, x.offset) for x in got] == [(2, 1, 2, 20)] and got[0].bit_error == 0
    assert M.align(prints.limit(0), df.select("rec_id")).collect() == []


def test_repeated_passages_match_at_every_offset(spark):
    r = np.random.default_rng(5)
    a, b, c = (r.integers(0, 1 << 32, n).tolist() for n in (40, 30, 15))
    rows = [(1, a + b + a + c), (2, a + c), (3, a), (4, [7] * 30 + b), (5, r.integers(0, 1 << 32, 90).tolist())]
    got = {(x.query_id, x.rec_id): x for x in M.align(spark.createDataFrame(rows, "rec_id long, prints array<long>"), spark.createDataFrame([(2,), (3,)], "rec_id long")).collect()}
    assert set(got) == {(2, 1), (2, 3), (3, 1), (3, 2)}
    assert got[2, 1].offset == 70 and got[2, 1].bit_error == 0 and got[2, 1].votes == 55
    assert [(x.offset, x.votes, x.frames, x.bit_error) for x in got[3, 1].offsets] == [(0, 40, 40, 0.0), (70, 40, 40, 0.0)] and got[3, 1].offset == 0


def test_query_lists_all_matches(spark, tmp_path):
    r = np.random.default_rng(6)
    vectors = [(100, r.random(64).tolist())]
    vectors += [(1, vectors[0][1][10:] + r.random(10).tolist()), (2, vectors[0][1][20:] + r.random(20).tolist()), (3, None)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {x.rec_id: x for x in M.op7_media_fingerprints(spark, str(tmp_path)).collect()}
    # queries stand for their class; the two others match it
    assert got[100].n_matches == 2 == len(got[100].matches) and [x.rec_id for x in got[100].matches] == [1, 2]
    assert all(x.offsets for x in got[100].matches) and got[1].matches is None


def test_all_components_are_played(spark):
    r = np.random.default_rng(4)
    first = r.random(32).tolist()
    df = spark.createDataFrame([(1, first + r.random(32).tolist()), (2, first + r.random(32).tolist()), (3, None), (4, [])], "vec_id long, embedding array<double>")
    apart = {x.rec_id: x.prints for x in M.fingerprints(M.recordings_of(df)).collect()}
    assert {i: len(p) for i, p in apart.items()} == {1: 115, 2: 115, 3: 0, 4: 0} and apart[1] != apart[2]
    assert {x.rec_id: x.prints for x in M.fingerprints_of_vectors(df).collect()} == apart


def test_alignment_against_all_pairs_and_offsets(spark):
    r = np.random.default_rng(8)
    base = [r.integers(0, 1 << 32, 12).tolist() for _ in range(3)]
    lists = {0: base[0] * 2 + [5] * 9, 1: [5] * 20, 2: [5] * 7 + base[1] + [5] * 3, 3: base[2], 4: [5] * 4, 5: [6], 6: base[0] * 2 + [5] * 9}
    for i in range(10, 24):
        x = list(base[i % 3] + base[(i + 1) % 3])[int(r.integers(6)) :]
        lists[i] = [v ^ (1 << int(r.integers(32))) if r.random() < 0.6 else v for v in x]
    df = spark.createDataFrame([(i, x) for i, x in lists.items()] + [(None, [5]), (30, None), (3, base[2])], "rec_id long, prints array<long>")
    want = set()
    reps = {tuple(x): min(j for j, y in lists.items() if y == x) for x in lists.values()}
    for q in (0, 2, 11, 12, 1, 30):
        for x, rep in reps.items():
            y = lists.get(q)
            if y is None or (mine := reps[tuple(y)]) == rep:
                continue
            for offset in range(-len(y), len(x) + 1):
                pairs = [(x[offset + k], y[k]) for k in range(len(y)) if 0 <= offset + k < len(x)]
                errors = sum((a ^ b).bit_count() for a, b in pairs)
                votes = sum(a == b for a, b in pairs)
                if votes and len(pairs) >= 8 and errors <= 0.25 * 32 * len(pairs):
                    want.add((mine, rep, offset, votes, len(pairs), round(errors / (32 * len(pairs)), 9)))
    got = M.align(df, spark.createDataFrame([(q,) for q in (0, 2, 11, 12, 1, 30)], "rec_id long")).collect()
    assert {(x.query_id, x.rec_id, y.offset, y.votes, y.frames, round(y.bit_error, 9)) for x in got for y in x.offsets} == want and len(want) > 20
    assert all(x.copies == (2 if x.rec_id == 0 else 1) for x in got)


def test_recall_of_noisy_excerpts_off_the_frame_grid():
    r = np.random.default_rng(9)
    found = 0
    for _ in range(40):
        wave = tune(r.integers(0, 24, 64).tolist()).astype(float)
        at = int(r.integers(10 * M.HOP, 30 * M.HOP))
        part = wave[at : at + 60 * M.HOP]
        part = part + r.normal(size=len(part)) * np.sqrt((part**2).mean() / 100)
        whole, excerpt = M.fingerprint(M.chroma(wave.astype("<i2"))), M.fingerprint(M.chroma(part.astype("<i2")))
        packs = [M._Pack([k], np.array([len(x)], np.int64).tobytes(), x.astype(np.uint32).tobytes()) for k, x in enumerate((whole, excerpt))]
        found += any(abs(x[2] - at / M.HOP) <= 1 for x in M.matches(*packs, 0.25, 8))
    assert found >= 38


def test_values_that_are_no_numbers_are_played(spark):
    df = spark.createDataFrame([(1, [float("nan"), 0.5] * 8), (2, [float("inf"), 0.5] * 8), (3, [0.0, 0.5] * 8), (4, [None, 0.5] * 8)], "vec_id long, embedding array<double>")
    assert len({tuple(x.prints) for x in M.fingerprints_of_vectors(df).collect()}) == 1
