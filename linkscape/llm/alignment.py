"""Alignment of two tokenizers' ids over a corpus.

Both tokenizers read the same bytes: A a space and the text, B the text, before which it puts a space itself.  Where a token of A and one of B end
at the same byte they cut the text into groups; ids that share a group are linked, and a pair's count is the number of documents that link it.

Most groups are one token of each, and then the two have the same bytes: an array over A's vocabulary gives B's id for A's.  Such
groups are counted in vectors of the vocabulary's length, one a part; only what isn't of that kind becomes pairs that are
shuffled.  Texts are read in parts of PART_CHARS characters.  A part keeps each distinct group once, documents are
lists of group numbers, and the part sends each of its distinct pairs once, with its number of documents; the corpus's counts come back to the parts, which sum them over their groups.

Neither tokenizer has a token that holds a space after anything but white space (which is checked), so what stands between single spaces is encoded on its own and remembered.
"""

from __future__ import annotations

import hashlib
import itertools
import re

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkscape.llm.common import cut, table

#: Characters after which a part ends, and texts turned into Python strings at once.
PART_CHARS, SLICE = 8_000_000, 256
#: Pieces longer than this are not remembered.
MEMO_CHARS = 48
SPLIT = re.compile(r"(?<=\S) (?=\S)")
DOC, PAIR, SAME, GROUPS = range(4)
_loaded: dict[tuple[str, str], "Aligner"] = {}


class Aligner:
    """Two tokenizer files in one worker: A byte-level ranks, B a sentencepiece model."""

    def __init__(self, a_ranks: str, b_model: str):
        import base64

        import sentencepiece
        import tiktoken

        with open(a_ranks, "rb") as f:
            ranks = {base64.b64decode(x): int(i) for x, i in map(bytes.split, f)}
        self.a = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_model)
        self.a_bytes = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.a_bytes[i] = token
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(x[3:5], 16)]) if self.b.is_byte(i) else x.replace("▁", " ").encode() for i, x in enumerate(names)]
        of_bytes: dict[bytes, int] = {}
        for i in sorted(range(len(names)), key=lambda i: (self.b.is_byte(i), i)):  # a piece before the byte of the same value
            if not (self.b.is_control(i) or self.b.is_unknown(i)):
                of_bytes.setdefault(self.b_bytes[i], i)
        #: B's id of the same bytes for each id of A, or -1.
        self.same = [of_bytes.get(x, -1) for x in self.a_bytes]
        self.a_len, self.b_len, self.same_array = np.array(list(map(len, self.a_bytes))), np.array(list(map(len, self.b_bytes))), np.array(self.same)
        self.separable = not any(re.search(r"\S ", x.decode(errors="replace")) for x in [*self.a_bytes, *self.b_bytes])

    @staticmethod
    def of(a_ranks: str, b_model: str) -> "Aligner":
        if (a_ranks, b_model) not in _loaded:
            _loaded[a_ranks, b_model] = Aligner(a_ranks, b_model)
        return _loaded[a_ranks, b_model]

    def pieces(self, text: str) -> list[str]:
        return SPLIT.split(text) if self.separable else [text]

    def encode(self, pieces: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        return [self.a.encode_ordinary(" " + x) for x in pieces], self.b.encode(pieces, num_threads=1)

    def exact(self, piece: str, a: list[int], b: list[int]) -> bool:
        """Whether both have the bytes of a space and the piece."""
        return b"".join([self.a_bytes[i] for i in a]) == b"".join([self.b_bytes[i] for i in b]) == b" " + piece.encode()


class Part:
    """What some documents have in common: remembered pieces, distinct groups and distinct pairs.

    A group of one token each with the same bytes has A's id as its number, and so has the pair in it; all others have numbers from the vocabulary's size on.
    """

    def __init__(self, aligner: Aligner, number: int):
        self.own, self.number, self.size = aligner, number, len(aligner.a_bytes)
        self.memo: dict[str, bytes | None] = {}
        self.codes: dict[tuple, int] = {}
        self.names = [f"{x}|{y}" for x, y in enumerate(aligner.same)]
        self.sizes: list[tuple[int, int, int]] = []  # tokens of A and of B, and links, of each further group
        self.ones = np.ones((self.size, 3), np.int64)
        self.slots: dict[tuple[int, int], int] = {}
        self.links: list[tuple[np.ndarray, np.ndarray]] = []  # for each further group its pairs, and how often each is linked in it
        self.counts = np.zeros(self.size + 1024, np.int64)
        self.chars = 0

    def _code(self, a: tuple[int, ...], b: tuple[int, ...]) -> int:
        code = self.codes.get((a, b))
        if code is None:
            code = self.codes[a, b] = self.size + len(self.links)
            (ids_a, n_a), (ids_b, n_b) = np.unique(a, return_counts=True), np.unique(b, return_counts=True)
            slots, same = self.slots, self.own.same
            found = [x if same[x] == y else slots.setdefault((x, y), self.size + len(slots)) for x in ids_a.tolist() for y in ids_b.tolist()]
            self.links.append((np.array(found, np.int32), np.outer(n_a, n_b).ravel().astype(np.int32)))
            self.names.append(",".join(map(str, a)) + "|" + ",".join(map(str, b)))
            self.sizes.append((len(a), len(b), len(a) * len(b)))
        return code

    def _grouped(self, pieces: list[str]) -> dict[str, bytes | None]:
        """Group numbers of each piece, as 32-bit integers; None where a tokenizer doesn't give its bytes."""
        own = self.own
        lists_a, lists_b = own.encode(pieces)
        whole = "".join([" " + p for p in pieces]).encode()
        if b"".join([own.a_bytes[i] for x in lists_a for i in x]) != whole or b"".join([own.b_bytes[i] for x in lists_b for i in x]) != whole or not pieces:
            good = [own.exact(*x) for x in zip(pieces, lists_a, lists_b, strict=True)]
            bad = dict.fromkeys([p for p, ok in zip(pieces, good, strict=True) if not ok])
            return {**bad, **(self._grouped([p for p, ok in zip(pieces, good, strict=True) if ok]) if any(good) else {})}
        a, b = list(itertools.chain.from_iterable(lists_a)), list(itertools.chain.from_iterable(lists_b))
        of_a, of_b = np.array(a), np.array(b)
        ends_a, ends_b = own.a_len[of_a].cumsum(), own.b_len[of_b].cumsum()
        ends = np.intersect1d(ends_a, ends_b, assume_unique=True)
        to_a, to_b = ends_a.searchsorted(ends) + 1, ends_b.searchsorted(ends) + 1
        from_a, from_b = np.concatenate(([0], to_a[:-1])), np.concatenate(([0], to_b[:-1]))
        one = (to_a - from_a == 1) & (to_b - from_b == 1) & (own.same_array[of_a[from_a]] == of_b[from_b])
        codes = of_a[from_a].astype(np.int32)
        rest = np.flatnonzero(~one)
        codes[rest] = [self._code(tuple(a[i:j]), tuple(b[k:m])) for i, j, k, m in zip(from_a[rest].tolist(), to_a[rest].tolist(), from_b[rest].tolist(), to_b[rest].tolist(), strict=True)]
        last = (ends.searchsorted(ends_a[np.cumsum([len(x) for x in lists_a]) - 1]) + 1) * 4
        flat = codes.tobytes()
        return {p: flat[i:j] for p, i, j in zip(pieces, [0, *last[:-1].tolist()], last.tolist(), strict=True)}

    def add(self, texts: list[str | None]) -> list[tuple]:
        """``n_a, n_b, n_groups, n_links, sha256, codes`` of each text, which are counted."""
        split = [self.own.pieces(x) if x else [] for x in texts]
        memo, passing = self.memo, {}
        new = list(dict.fromkeys([p for pieces in split for p in pieces if p not in memo]))
        for p, codes in self._grouped(new).items():
            (memo if len(p) <= MEMO_CHARS else passing)[p] = codes
        if len(self.counts) < self.size + len(self.slots):
            self.counts = np.concatenate([self.counts, np.zeros(self.size + 2 * len(self.slots) - len(self.counts), np.int64)])
        sizes, names, links, rows = np.concatenate([self.ones, np.array(self.sizes, np.int64).reshape(-1, 3)]), self.names, self.links, []
        for pieces in split:
            found = [memo[p] if p in memo else passing[p] for p in pieces]
            self.chars += sum(map(len, pieces)) + len(pieces)
            if not found or None in found:
                rows.append((0, 0, 0, 0, "", b""))
                continue
            flat = b"".join(found)
            codes = np.frombuffer(flat, np.int32)
            distinct = np.unique(codes)
            own = distinct[: distinct.searchsorted(self.size)]
            linked = np.unique(np.concatenate([own, *[links[k][0] for k in (distinct[len(own) :] - self.size).tolist()]]))
            self.counts[linked] += 1
            n_a, n_b, n_links = sizes[codes].sum(axis=0).tolist()
            text = ";".join([names[k] for k in codes.tolist()])
            rows.append((n_a, n_b, len(codes), n_links, hashlib.sha256(text.encode()).hexdigest(), flat))
        return rows


def _columns(schema: pa.Schema, n: int, /, **given) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([given[f.name].cast(f.type) if isinstance(given.get(f.name), pa.Array) else pa.array(given[f.name], f.type) if f.name in given else pa.nulls(n, f.type) for f in schema], schema=schema)


def _schema(id_type: pa.DataType) -> pa.Schema:
    numbers = [(x, pa.int64()) for x in ("n_a", "n_b", "n_groups", "n_links")]
    return pa.schema([("kind", pa.int32()), ("part", pa.int64()), ("doc_id", id_type), *numbers, ("groups_sha256", pa.string()), ("codes", pa.binary()), ("pairs", pa.binary()), ("times", pa.binary()), ("slot", pa.int32()), ("a", pa.int32()), ("b", pa.int32()), ("n", pa.int64())])


def _closing(part: Part, schema: pa.Schema):
    """The rows of a part beside its documents: its groups, its pairs and its vector."""
    seen = [p for p, _ in part.links]
    ends = np.cumsum([len(p) for p in seen], dtype=np.int64).tobytes()
    join = lambda xs: np.concatenate(xs).tobytes() if xs else b""
    yield _columns(schema, 1, kind=[GROUPS], part=[part.number], codes=[ends], pairs=[join(seen)], times=[join([t for _, t in part.links])])
    pairs = list(part.slots)
    for k in range(0, len(pairs), 50_000):
        some = np.array(pairs[k : k + 50_000], np.int32)
        slots = np.arange(part.size + k, part.size + k + len(some), dtype=np.int32)
        yield _columns(schema, len(some), kind=np.full(len(some), PAIR, np.int32), part=np.full(len(some), part.number), slot=slots, a=some[:, 0].copy(), b=some[:, 1].copy(), n=part.counts[slots])
    own = np.flatnonzero(part.counts[: part.size]).astype(np.int32)
    yield _columns(schema, len(own), kind=np.full(len(own), SAME, np.int32), part=np.full(len(own), part.number), a=own, n=part.counts[own])


def _read(a_ranks: str, b_model: str, part_chars: int):
    def run(batches):
        aligner, part, made = Aligner.of(a_ranks, b_model), None, 0
        for batch in batches:
            schema = _schema(batch.schema.field("doc_id").type)
            for k in range(0, len(batch), SLICE):
                some = batch.slice(k, SLICE)
                if part is None:
                    part, made = Part(aligner, (TaskContext.get().partitionId() << 24) + made), made + 1
                rows = part.add(some.column("text").to_pylist())
                names = ("n_a", "n_b", "n_groups", "n_links", "groups_sha256", "codes")
                yield _columns(schema, len(some), kind=[DOC] * len(some), part=[part.number] * len(some), doc_id=some.column("doc_id"), **{n: [r[i] for r in rows] for i, n in enumerate(names)})
                if part.chars >= part_chars:
                    yield from _closing(part, schema)
                    part = None
        if part is not None:
            yield from _closing(part, schema)

    return run


def _summed(size: int, counts: np.ndarray, most: np.ndarray):
    """Documents of one part with the sums over their links; ``counts`` of pairs with the same bytes and ``most`` of any pair, by A's id."""

    def run(own: pa.Table, back: pa.Table) -> pa.Table:
        slots, a, n = (back.column(x).to_numpy() for x in ("slot", "a", "n"))
        value, best = np.zeros(size + len(slots), np.int64), np.zeros(size + len(slots), np.int64)
        value[:size], best[:size] = counts, counts == most
        value[slots], best[slots] = n, n == most[a]
        kinds = own.column("kind").to_numpy()
        groups = own.filter(pa.array(kinds == GROUPS))
        if len(groups):
            ends, pairs, times = (np.frombuffer(groups.column(x)[0].as_py(), kind) for x, kind in (("codes", np.int64), ("pairs", np.int32), ("times", np.int32)))
            starts = np.concatenate(([0], ends[:-1])) if len(ends) else ends
            over = lambda x: np.add.reduceat(x[pairs] * times, starts) if len(ends) else np.zeros(0, np.int64)
            value, best = np.concatenate([value[:size], over(value)]), np.concatenate([best[:size], over(best)])
        docs = own.filter(pa.array(kinds == DOC))
        n_best, count_sum = np.zeros(len(docs), np.int64), np.zeros(len(docs), np.int64)
        for k, codes in enumerate(docs.column("codes")):
            found = np.frombuffer(codes.as_py(), np.int32)
            n_best[k], count_sum[k] = best[found].sum(), value[found].sum()
        names = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]
        return pa.table([*[docs.column(x) for x in names], pa.array(n_best), pa.array(count_sum), docs.column("groups_sha256")], names=[*names, "n_best", "count_sum", "groups_sha256"])

    return run


def read_parts(docs: DataFrame, a_ranks: str, b_model: str, *, part_chars: int = PART_CHARS) -> DataFrame:
    """The written rows of all parts: documents, pairs (``part, slot, a, b, n``), vectors (``part, a, n``) and groups."""
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    numbers = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, codes binary, pairs binary, times binary, slot int, a int, b int, n long"
    schema = T.StructType([*T._parse_datatype_string("kind int, part long").fields, rows.schema["doc_id"], *T._parse_datatype_string(numbers).fields])
    return cut(rows.mapInArrow(_read(a_ranks, b_model, part_chars), schema))


def pair_counts(parts: DataFrame, a_ranks: str, b_model: str) -> DataFrame:
    """``a, b, n`` of every linked pair of ids, from the rows of ``read_parts``: in how many documents it is linked."""
    same = parts.where(F.col("kind") == SAME).groupBy("a").agg(F.sum("n").alias("n"))
    of_a = F.udf(lambda i, a=a_ranks, b=b_model: Aligner.of(a, b).same[i], "int")  # a row for each id of the vocabulary at most
    return _irregular(parts).unionByName(same.select("a", of_a("a").alias("b"), "n"))


def _irregular(parts: DataFrame) -> DataFrame:
    return parts.where(F.col("kind") == PAIR).groupBy("a", "b").agg(F.sum("n").alias("n"))


def alignment(docs: DataFrame, a_ranks: str, b_model: str, *, part_chars: int = PART_CHARS) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` for each row of ``docs`` (``doc_id, text``).

    ``n_best`` counts links whose pair has the highest count of all pairs with that id of A, ``count_sum`` adds up the counts of
    all links, ``groups_sha256`` is the digest of the groups' ids.  Null and empty texts, and those whose bytes a tokenizer
    changes, have zeros and an empty digest; rows that repeat, also under one id, are documents each; an empty table
    gives an empty result; further columns are ignored.
    """
    own = Aligner.of(a_ranks, b_model)
    size = len(own.a_bytes)
    parts = read_parts(docs, a_ranks, b_model, part_chars=part_chars)
    counts, most = np.zeros(size, np.int64), np.zeros(size, np.int64)
    for r in parts.where(F.col("kind") == SAME).groupBy("a").agg(F.sum("n").alias("n")).collect():  # vocabulary-length, as is the next
        counts[r["a"]] = r["n"]
    pairs = cut(_irregular(parts))
    for r in pairs.groupBy("a").agg(F.max("n").alias("n")).collect():
        most[r["a"]] = r["n"]
    most = np.maximum(most, counts)
    back = parts.where(F.col("kind") == PAIR).select("part", "slot", "a", "b").join(pairs, ["a", "b"]).select(F.col("part").alias("of_part"), "slot", "a", "n")
    own_rows = parts.where(F.col("kind").isin(DOC, GROUPS)).select("part", "kind", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "codes", "pairs", "times")
    schema = T.StructType([parts.schema["doc_id"], *T._parse_datatype_string("n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string").fields])
    return own_rows.groupBy("part").cogroup(back.groupBy("of_part")).applyInArrow(_summed(size, counts, most), schema)


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole ``documents``: byte-level BPE of 50,257 ids against a piece model of 32,000."""
    return alignment(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("piece_bpe_32k.model"))
