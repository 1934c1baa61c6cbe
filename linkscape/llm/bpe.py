"""BPE encoding and decoding of whole texts, with tree concatenation for long ones.

Words between white space are encoded on their own and remembered: no match of the
tokenizer's pre-splitting holds white space, so this equals encoding the text at once.

A text over ``2 * leaf_chars`` is cut in halves, and these again, down to leaves.  Leaves
are rows of their own and are encoded in parallel tasks, wherever the cuts fall (also inside a word without any space).
A leaf's inner words are done there; only the stretch between the spaces around a cut stays open.  The leaves of one text then meet, and neighbours are concatenated pairwise, level by level, up
to the root: a window around the join is encoded again and doubled until it has a token in common with the
left side (same id, same place) and one with the right side.  A sequence of BPE tokens is the encoding of its text
if every two neighbours are the encoding of theirs, so left tokens up to the first common one, window tokens
in between and right tokens from the last common one are exactly the tokens of the whole.
"""

from __future__ import annotations

import re
import unicodedata
from array import array

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkscape.llm.common import table

#: Unicode white space, as the tokenizer's normaliser sees it.
SPACES = re.compile("[\t-\r \x85\xa0  -     　]+")
#: What ``str.split`` takes for white space and the normaliser doesn't.
SEPARATORS = tuple(map(chr, range(0x1C, 0x20)))
#: Words remembered in a worker, at about 200 bytes each: half of them the latest, half those before them that may be used again.
MEMO_WORDS = 800_000
_loaded: dict[str, "Codec"] = {}


class Codec:
    """One tokenizer file in one worker."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        named = {i: t for t, i in self.tokenizer.get_vocab(with_added_tokens=True).items()}
        self.tokens = [named.get(i, "") for i in range(max(named, default=-1) + 1)]
        self.added = [str(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    @staticmethod
    def of(path: str) -> "Codec":
        if path not in _loaded:
            import os

            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            _loaded[path] = Codec(path)
        return _loaded[path]

    def _learn(self, words: list[str]) -> None:
        if len(self.memo) > MEMO_WORDS // 2:  # what isn't asked for again until this half is full is forgotten
            self.memo, self.older = {}, self.memo
        new = {w for w in words if w not in self.memo}
        self.memo.update({w: self.older[w] for w in new if w in self.older})
        new = [w for w in new if w not in self.older]
        for w, e in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False), strict=True):
            self.memo[w] = array("i", e.ids).tobytes()

    def words(self, text: str) -> list[str]:
        """The runs without white space; of plain ASCII lower case at once, as the normaliser makes it, unless an added token could come from that."""
        if any(x in text for x in SEPARATORS):
            return [w for w in SPACES.split(text) if w]
        return (text.lower() if text.isascii() and "<|" not in text else text).split()

    def encode_words(self, text: str) -> bytes:
        """Token ids as 32-bit integers."""
        words, memo = self.words(text), self.memo
        try:
            return b"".join([memo[w] for w in words])
        except KeyError:
            self._learn(words)
            memo = self.memo
            return b"".join([memo[w] for w in words])

    def decoded(self, ids: np.ndarray) -> str:
        tokens = self.tokens
        return " ".join([tokens[i] for i in ids.tolist()])

    def encode_places(self, text: str, base: int) -> list[tuple[int, int, int, int]]:
        """Tokens as ``(start, number among those that start there, id, end)``, places counted from ``base``."""
        e, out, last, again = self.tokenizer.encode(text, add_special_tokens=False), [], -1, 0
        for i, (a, z) in zip(e.ids, e.offsets, strict=True):
            again = again + 1 if a == last else 0
            last = a
            out.append((base + a, again, i, base + z))
        return out

    def safe_cut(self, text: str, at: int) -> int:
        """The first place from ``at`` where a cut splits no added token and no characters that normalisation joins."""
        while 0 < at < len(text):
            around = max(0, at - 64)
            inside = any(around + m.start() < at < around + m.end() for t in self.added for m in re.finditer(re.escape(t), text[around : at + 64]))
            x, y = text[at - 1], text[at]
            if not inside and not unicodedata.combining(y) and unicodedata.normalize("NFC", x + y) == unicodedata.normalize("NFC", x) + unicodedata.normalize("NFC", y):
                break
            at += 1
        return at

    def join(self, text: str, start: int, left: list, cut: int, right: list, end: int) -> list:
        """Tokens of ``text[start:end]`` from those of ``text[start:cut]`` and ``text[cut:end]``."""
        in_left, in_right, reach = {t: k for k, t in enumerate(left)}, {t: k for k, t in enumerate(right)}, 64
        while True:
            lo = self.safe_cut(text, cut - reach) if cut - reach > start else start
            hi = self.safe_cut(text, cut + reach) if cut + reach < end else end
            lo, hi = (start if lo >= cut else lo), min(hi, end)
            window = self.encode_places(text[lo:hi], lo)
            first = next((k for k, t in enumerate(window) if 0 < k and t in in_left), None) if lo > start else -1
            last = next((k for k in range(len(window) - 2, -1, -1) if window[k] in in_right), None) if hi < end else len(window)
            if first is not None and last is not None and first < last:
                head = left[: in_left[window[first]]] if lo > start else []
                tail = right[in_right[window[last]] :] if hi < end else []
                return head + window[max(first, 0) : last] + tail
            if lo == start and hi == end:
                return window
            reach *= 2


def tree_cuts(codec: Codec, text: str, leaf_chars: int) -> list[int]:
    """Places at which the text is cut: halves of halves, until none is over ``2 * leaf_chars``."""
    edges = [0, len(text)]
    while True:
        more = {codec.safe_cut(text, (a + z) // 2) for a, z in zip(edges, edges[1:], strict=False) if z - a > 2 * leaf_chars}
        more = sorted(more.union(edges))
        if len(more) == len(edges):
            return edges[1:-1]
        edges = more


_OUT = "ids array<int>, decoded string"


def _short(path: str):
    def run(batches):
        codec = Codec.of(path)
        for batch in batches:
            ids, decoded = [], []
            for x in batch.column("text"):
                ids.append(np.frombuffer(codec.encode_words(x.as_py() or ""), np.int32))
                decoded.append(codec.decoded(ids[-1]))
            offsets = np.concatenate(([0], np.cumsum([len(i) for i in ids]))).astype(np.int32)
            values = pa.array(np.concatenate(ids) if ids else np.empty(0, np.int32), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets), values), pa.array(decoded, pa.string())], names=["doc_id", "ids", "decoded"])

    return run


_LEAF = "row_key string, at long, head string, head_tokens binary, middle binary, tail string, tail_tokens binary"


def _leaves(path: str, leaf_chars: int):
    def run(batches):
        codec = Codec.of(path)
        for batch in batches:
            for i, k, x in zip(batch.column("doc_id"), batch.column("row_key"), batch.column("text"), strict=True):
                text = x.as_py()
                edges = [0, *tree_cuts(codec, text, leaf_chars), len(text)]
                for a, z in zip(edges, edges[1:], strict=False):
                    yield pa.RecordBatch.from_arrays([pa.array([i.as_py()], batch.column("doc_id").type), pa.array([k.as_py()], pa.string()), pa.array([a], pa.int64()), pa.array([text[a:z]], pa.string())], names=["doc_id", "row_key", "at", "leaf"])

    return run


def _packed(tokens: list) -> bytes:
    return np.array(tokens, np.int32).reshape(-1).tobytes()


def _unpacked(raw: bytes) -> list:
    return list(map(tuple, np.frombuffer(raw, np.int32).reshape(-1, 4).tolist()))


def encode_leaf(codec: Codec, leaf: str) -> tuple[str, list, bytes | None, str, list]:
    """``head, head tokens, middle ids, tail, tail tokens``: what touches the leaf's ends, with places from its own start, and the words between, which no cut can change.

    A leaf without a space is all head, and its middle is None.
    """
    first, last = SPACES.search(leaf), None
    if first is None:
        return leaf, codec.encode_places(leaf, 0), None, "", []
    for last in SPACES.finditer(leaf, max(first.start(), len(leaf) - 256)):
        pass
    if last is None:
        for last in SPACES.finditer(leaf):
            pass
    head, tail = leaf[: first.start()], leaf[last.end() :]
    return head, codec.encode_places(head, 0), codec.encode_words(leaf[first.end() : last.start()]), tail, codec.encode_places(tail, 0)


def concatenate(codec: Codec, a: tuple, b: tuple) -> tuple:
    """One part from two neighbours, each as ``encode_leaf`` gives them: only the run of characters that the cut splits is worked on."""
    solid_a = a[2] is None
    run, tokens = (a[0], a[1]) if solid_a else (a[3], a[4])
    n = len(run)
    right = [(s + n, k, i, e + n) for s, k, i, e in b[1]]
    whole = run + b[0]
    joined = codec.join(whole, 0, tokens, n, right, len(whole)) if run and b[0] else tokens + right
    if solid_a:
        return (whole, joined, *b[2:])
    if b[2] is None:
        return a[0], a[1], a[2], whole, joined
    return a[0], a[1], a[2] + np.array([t[2] for t in joined], np.int32).tobytes() + b[2], b[3], b[4]


def part_ids(part: tuple) -> np.ndarray:
    ends = [np.array([t[2] for t in part[k]], np.int32) for k in (1, 4)]
    return np.concatenate((ends[0], np.frombuffer(part[2] or b"", np.int32), ends[1]))


def tree(codec: Codec, parts: list[tuple]) -> tuple:
    """Neighbours joined pairwise, level by level, up to the root."""
    while len(parts) > 1:
        joined = [concatenate(codec, a, b) for a, b in zip(parts[::2], parts[1::2], strict=False)]
        parts = joined + (parts[-1:] if len(parts) % 2 else [])
    return parts[0]


def _encode_leaves(path: str):
    def run(batches):
        codec = Codec.of(path)
        for batch in batches:
            done = [encode_leaf(codec, x.as_py()) for x in batch.column("leaf")]
            columns = [pa.array([d[0] for d in done], pa.string()), pa.array([_packed(d[1]) for d in done], pa.binary()), pa.array([d[2] for d in done], pa.binary()), pa.array([d[3] for d in done], pa.string()), pa.array([_packed(d[4]) for d in done], pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *columns], names=["doc_id", "row_key", "at", "head", "head_tokens", "middle", "tail", "tail_tokens"])

    return run


def _concatenate(path: str):
    def run(leaves: pa.Table) -> pa.Table:
        codec = Codec.of(path)
        rows = sorted(leaves.select(["at", "head", "head_tokens", "middle", "tail", "tail_tokens"]).to_pylist(), key=lambda r: r["at"])
        ids = part_ids(tree(codec, [(r["head"], _unpacked(r["head_tokens"]), r["middle"], r["tail"], _unpacked(r["tail_tokens"])) for r in rows]))
        return pa.table({"doc_id": leaves.column("doc_id").slice(0, 1), "row_key": leaves.column("row_key").slice(0, 1), "ids": pa.array([ids], pa.list_(pa.int32())), "decoded": pa.array([codec.decoded(ids)], pa.string())})

    return run


def bpe_encode_decode(docs: DataFrame, tokenizer: str, *, leaf_chars: int = 16_384) -> DataFrame:
    """Every text encoded and decoded again: ``doc_id, ids array<int>, decoded string``, one row for each input row.

    Equal to ``encode(text, add_special_tokens=False)`` and ``decode(ids, skip_special_tokens=False)`` of the
    tokenizers library on the whole text, for a tokenizer file without decoder whose pre-splitting drops white space.  Null texts count as empty
    (no ids, empty decoded text); repeated rows and null ids come back as they are; further columns are ignored.
    A text's leaves meet in one task: it is one row there as it was before.
    """
    kind = docs.schema["doc_id"].dataType
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"))
    out = T.StructType([T.StructField("doc_id", kind), *T.StructType.fromDDL(_OUT).fields])
    long_text = F.length("text") > 2 * leaf_chars
    short = rows.where(~long_text).mapInArrow(_short(tokenizer), out)
    # repeated rows of one id and text share a key; each of their leaves is kept once and the count restores the rows
    long_rows = rows.where(long_text).groupBy("doc_id", "text").agg(F.count("*").alias("copies")).withColumn("row_key", F.sha2("text", 256))
    leaf_schema = T.StructType([T.StructField("doc_id", kind), *T.StructType.fromDDL("row_key string, at long, leaf string").fields])
    leaves = long_rows.select("doc_id", "row_key", "text").mapInArrow(_leaves(tokenizer, leaf_chars), leaf_schema)
    leaves = leaves.repartition("row_key", "at").mapInArrow(_encode_leaves(tokenizer), T.StructType([T.StructField("doc_id", kind), *T.StructType.fromDDL(_LEAF).fields]))
    keyed = T.StructType([T.StructField("doc_id", kind), *T.StructType.fromDDL(f"row_key string, {_OUT}").fields])
    whole = leaves.groupBy("doc_id", "row_key").applyInArrow(_concatenate(tokenizer), keyed)
    again = long_rows.where("copies > 1").select(F.col("doc_id").alias("again_id"), F.col("row_key").alias("again_key"), "copies")
    whole = whole.join(again, whole["doc_id"].eqNullSafe(again["again_id"]) & (whole["row_key"] == again["again_key"]), "left")
    whole = whole.select("doc_id", "ids", "decoded", F.explode(F.array_repeat(F.lit(0), F.coalesce("copies", F.lit(1)).cast("int"))).alias("copy")).drop("copy")
    return short.unionByName(whole)


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole ``documents`` with the word-level BPE file; digests of ids and of the decoded text."""
    found = bpe_encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
