import hashlib
import itertools
from bisect import bisect_right
from collections import Counter, defaultdict

import public_tokenizers as P

from linkscape.llm import alignment as A

RANKS, MODEL = P.path("byte_bpe_50k.tiktoken"), P.path("piece_bpe_32k.model")


def decoded_vocabulary():
    """Bytes of each id of the JSON file, whose entries are byte-level encoded."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    back = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
    return t, {i: bytes(back[c] for c in w) for w, i in t.get_vocab().items() if all(c in back for c in w)}


def brute(rows):
    """Every step as stated, over whole texts, pairs listed one by one."""
    import sentencepiece

    t, a_bytes = decoded_vocabulary()
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)

    def b_bytes(i):
        return bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode()

    docs, held = [], Counter()
    for i, text in rows:
        whole = (" " + (text or "")).encode()
        a, b = (t.encode(" " + text, add_special_tokens=False).ids, sp.encode(text)) if text else ([], [])
        x, y = [a_bytes[k] for k in a], [b_bytes(k) for k in b]
        if not text or b"".join(x) != whole or b"".join(y) != whole:
            docs.append((i, [], [], []))
            continue
        ends_a, ends_b = list(itertools.accumulate(map(len, x))), list(itertools.accumulate(map(len, y)))
        groups, before = [], 0
        for end in sorted(set(ends_a) & set(ends_b)):
            groups.append(tuple(ids[bisect_right(ends, before) : bisect_right(ends, end)] for ids, ends in ((a, ends_a), (b, ends_b))))
            before = end
        links = [pair for ga, gb in groups for pair in itertools.product(ga, gb)]
        held.update(set(links))
        docs.append((i, a, b, groups, links))
    most = defaultdict(int)
    for (x, _), n in held.items():
        most[x] = max(most[x], n)
    out = []
    for i, a, b, groups, *rest in docs:
        links = rest[0] if rest else []
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((i, len(a), len(b), len(groups), len(links), sum(held[p] == most[p[0]] for p in links), sum(held[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if text else ""))
    return sorted(out, key=str), held


ODD = [
    None, "", " ", "  ", "a", " lead", "trail ", "two  spaces", "\n\nlines\n and\ttabs \n", "<|endoftext|> and <s> </s> <unk> <0x41>", "▁piece mark", "日本語のテキスト and 中文", "é combined ​   spaces", "naïve café 😀👩‍👩‍👧",
    "a" * 5000, "xyzq" * 800, " " * 700, "I'll won't we've it's", "12345 3.14 1e-9", "\x00 nul \x1c sep\x1fend", "a\x85b  c", "ﬁ ligature ½ ²", "word " * 3000,
]


def test_against_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rows += [(-k, x) for k, x in enumerate(ODD, 1)] + [(7, "repeated id"), (None, "no id at all"), (None, "no id at all")]
    docs = spark.createDataFrame([(i, x, 1) for i, x in rows], "doc_id long, text string, n_best int")
    expected, held = brute(rows)
    for chars in (A.PART_CHARS, 50_000):
        assert sorted((tuple(r) for r in A.alignment(docs.repartition(3), RANKS, MODEL, part_chars=chars).collect()), key=str) == expected
    got = A.pair_counts(A.read_parts(docs, RANKS, MODEL), RANKS, MODEL).collect()
    assert len(got) == len(held) and {(r.a, r.b): r.n for r in got} == held


def test_small_parts_in_one_worker():
    aligner = A.Aligner.of(RANKS, MODEL)
    texts = ["alignment of tokens", "alignment again", None]
    part = A.Part(aligner, 1)
    rows = part.add(texts)
    assert [r[0] for r in rows] == [len(aligner.a.encode_ordinary(" " + t)) if t else 0 for t in texts]
    assert part.counts.sum() > 0 and aligner.separable


def test_every_character_as_the_json_file_has_it():
    t, a_bytes = decoded_vocabulary()
    aligner = A.Aligner.of(RANKS, MODEL)
    assert all(aligner.a_bytes[i] == x for i, x in a_bytes.items() if i < len(aligner.a_bytes))
    chars = [chr(c) for c in range(0x30000) if not 0xD800 <= c < 0xE000]
    texts = [f" {x}a {x}1{x} .{x}" for x in chars]
    odd = [x for x, e, text in zip(chars, t.encode_batch(texts, add_special_tokens=False), texts) if e.ids != aligner.a.encode_ordinary(text)]
    assert not odd, [hex(ord(x)) for x in odd[:20]]


def test_empty(spark):
    assert A.alignment(spark.createDataFrame([], "doc_id long, text string"), RANKS, MODEL).collect() == []
