"""N-gram Jaccard join: exact similarity links between the n-gram sets of whole documents, and their groups.

The method is a prefix-tree join.  Every set is kept in one global order (ascending
64-bit shingle hash).  Candidate shards come from ordered segments of the sets, and in
each shard the sets, in one order of their own (frequent shingles first, so that paths are shared), are stored in a trie and every set walks it: a node's overlap is
computed once for all sets below it, and a subtree is left as soon as the overlap so far
plus the longest possible rest cannot reach the threshold.

1. Sets that are equal are one class, its representative the smallest ``doc_id``; copies
   are merged by a partial aggregation before anything else is shuffled.
2. The hash range is cut into ``2**(level-1)`` segments, where ``level`` is the bit length of
   the set's size less one.  Two linked sets differ in at most D elements, so in at most
   D segments; a set therefore emits its first D + 1 non-empty segments in segment order, and
   linked sets share one (if x's run ends first, one of its D + 1 segments is
   unchanged in y, and y emits it too).  A set with fewer non-empty segments emits all
   of them, which finds every partner that has enough; for two such sets, both
   also emit the first elements of the ordered set (classic prefix filter).  Sets
   whose partners may lie one size level lower emit that level too.  Segments hold two to
   four shingles, so that common lines alone rarely make candidates.
3. Members of a segment meet at its smallest member, the hub.  Only (member, hub) pairs
   go on, never all pairs.  Members of a hub form a shard; a shard over ``shard_shingles``
   is split into blocks and worked off by pairs of blocks, so that no task holds more.
4. The trie join reports links that join two parts of a shard (a spanning forest), at most one
   fewer than its sets; components of these links are the answer.

Hash equality stands for shingle equality (64 bits; 128 bits for whole sets).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkscape.llm.common import components, cut, table
from linkscape.llm.shingles import mix, shingle_sets

#: Texts are shingled in steps of so many bytes.
TEXT_STEP = 1 << 20


def _levels(n: int, percent: int) -> list[int]:
    own = n.bit_length() - 1
    lower = own > 0 and -(-percent * n // 100) < 1 << own
    return [own, own - 1] if lower else [own]


def _most_differing(n: int, level: int, percent: int) -> int:
    """Most elements in which a set of ``n`` and a partner differ that it meets at ``level``: at its own one any partner, at a lower one those of that level."""
    other = n * 100 // percent
    if n >> (level + 1):
        other = min(other, (2 << level) - 1)
    return (n + other) * (100 - percent) // (100 + percent)


def signatures(u: np.ndarray, percent: int) -> np.ndarray:
    """Segment signatures of one ordered set (module docstring, 2)."""
    n = len(u)
    if not n:
        return u
    scrambled, out = mix(u), []
    for level in _levels(n, percent):
        d = _most_differing(n, level, percent)
        bits = max(level - 1, 0)
        segment = u >> np.uint64(64 - bits) if bits else np.zeros(n, np.uint64)
        start = np.flatnonzero(np.concatenate(([True], segment[1:] != segment[:-1])))
        whole = np.add.reduceat(scrambled, start)[: d + 1]
        out.append(mix(whole + segment[start][: d + 1] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(level + 1)))
        if len(start) <= d:  # too few non-empty segments
            out.append(mix(scrambled[: d + 1] + np.uint64(1000 + level)))
    return np.unique(np.concatenate(out))


def _steps(texts: pa.Array) -> Iterator[tuple[int, list[bytes | None]]]:
    """Slices of about TEXT_STEP bytes: the first row's place and the texts."""
    start, size, part = 0, 0, []
    for k, x in enumerate(texts.cast(pa.binary())):
        v = x.as_py()
        part.append(v)
        size += len(v or b"")
        if size >= TEXT_STEP:
            yield start, part
            start, size, part = k + 1, 0, []
    if part:
        yield start, part


def _lists(arrays: list[np.ndarray], kind: pa.DataType, dtype: type) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(a) for a in arrays]))).astype(np.int32)
    values = np.concatenate(arrays).view(dtype) if arrays else np.empty(0, dtype)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def _describe(n: int, percent: int, with_signatures: bool):
    def run(batches):
        for batch in batches:
            for at, texts in _steps(batch.column("text")):
                sets = shingle_sets(texts, n)
                keys = [hashlib.blake2b(u.tobytes(), digest_size=16).digest() for u in sets]
                columns = [batch.column("doc_id").slice(at, len(texts)), pa.array([len(u) for u in sets], pa.int64()), pa.array(keys, pa.binary())]
                if with_signatures:
                    columns.append(_lists([signatures(u, percent) for u in sets], pa.int64(), np.int64))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "set_key", "signatures"][: len(columns)])

    return run


class Trie:
    """Path-compressed prefix tree over ordered integer sets, in breadth-first arrays.

    ``segment`` elements of node k lie in ``flat[cut[k]:cut[k + 1]]``; its children are nodes
    ``first[k]:first[k + 1]``; ``rest`` is the most elements on a path below it; ``least`` and ``most`` are the
    smallest and largest set sizes at or below it; ``leaf[k]`` is the set that ends there, or -1.
    """

    def __init__(self, sets: list[np.ndarray]):
        """``sets``: distinct, each in the global order."""
        order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u4").tobytes())
        lcp = [self._shared(sets[a], sets[b]) for a, b in zip(order, order[1:], strict=False)]
        flat, sizes, leaf, first, bounds = [], [], [], [], []
        level, made = [(0, len(order), 0)] if sets else [], 0
        while level:
            below = []
            for lo, hi, at in level:
                shared = min(lcp[lo : hi - 1], default=len(sets[order[lo]]))
                flat.append(sets[order[lo]][at:shared])
                sizes.append(shared - at)
                ends = len(sets[order[lo]]) == shared
                leaf.append(order[lo] if ends else -1)
                lengths = [len(sets[i]) for i in order[lo:hi]]
                bounds.append((min(lengths), max(lengths), max(lengths) - shared))
                first.append((made + len(level) + len(below),))
                if not (ends and hi - lo == 1):
                    start = lo + ends
                    for k in range(start, hi):
                        if k == hi - 1 or lcp[k] == shared:
                            below.append((start, k + 1, shared))
                            start = k + 1
                first[-1] += (made + len(level) + len(below),)
            made += len(level)
            level = below
        self.flat = np.concatenate(flat) if flat else np.empty(0, np.int64)
        self.size = np.array(sizes, np.int64)
        self.cut = np.concatenate(([0], np.cumsum(self.size)))
        self.leaf = np.array(leaf, np.int64)
        self.first = np.array(first, np.int64).reshape(-1, 2)
        self.least, self.most, self.rest = np.array(bounds, np.int64).reshape(-1, 3).T
        self.length = np.array([len(s) for s in sets], np.int64)

    @staticmethod
    def _shared(a: np.ndarray, b: np.ndarray) -> int:
        m = min(len(a), len(b))
        differ = np.flatnonzero(a[:m] != b[:m])
        return int(differ[0]) if len(differ) else m

    @staticmethod
    def _spans(start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """All indexes of the given ranges, one range after another."""
        total = int(size.sum())
        ends = np.cumsum(size)
        return np.arange(total) - np.repeat(ends - size - start, size)

    def linked(self, x: np.ndarray, has: np.ndarray, percent: int) -> np.ndarray:
        """Sets of the trie with 100 * intersection >= percent * union to ``x``; ``has``: a false mask over the elements, left as it was."""
        has[x] = True
        n, found = len(x), []
        node = np.array([0], np.int64) if len(self.leaf) else np.empty(0, np.int64)
        overlap = np.zeros(len(node), np.int64)
        while len(node):
            size = self.size[node]
            hits = np.concatenate(([0], np.cumsum(has[self.flat[self._spans(self.cut[node], size)]])))
            ends = np.cumsum(size)
            overlap = overlap + hits[ends] - hits[ends - size]
            # needed: (100 + percent) * intersection >= percent * (n + size of the other set)
            best = np.minimum(overlap + self.rest[node], np.minimum(n, self.most[node]))
            alive = ((100 + percent) * best >= percent * (n + np.maximum(self.least[node], best))) & (100 * self.most[node] >= percent * n) & (100 * n >= percent * self.least[node])
            node, overlap = node[alive], overlap[alive]
            end = self.leaf[node] >= 0
            if end.any():
                own = self.leaf[node][end]
                path = self.length[own]
                found.append(own[(100 + percent) * overlap[end] >= percent * (n + path)])
            width = self.first[node, 1] - self.first[node, 0]
            overlap = np.repeat(overlap, width)
            node = self._spans(self.first[node, 0], width)
        has[x] = False
        return np.concatenate(found) if found else np.empty(0, np.int64)


def _forest(left: list[np.ndarray], right: list[np.ndarray] | None, percent: int) -> list[tuple[int, int]]:
    """Links that join parts: among ``left``, or (indexes of ``right`` counted on after ``left``) between ``left`` and ``right``."""
    everything = left + (right or [])
    joined = np.concatenate(everything)
    _, ids, counts = np.unique(joined, return_inverse=True, return_counts=True)
    order = np.empty(len(counts), np.int64)
    order[np.argsort(-counts, kind="stable")] = np.arange(len(counts))  # one order for the shard: shared elements first, so that paths are shared
    ids, edges = order[ids], np.cumsum([len(s) for s in everything])[:-1]
    sets = [np.sort(s) for s in np.split(ids, edges)]
    stored = sets if right is None else sets[len(left) :]
    base = 0 if right is None else len(left)
    trie = Trie(stored)
    parent = list(range(len(sets)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    has, links = np.zeros(len(counts), bool), []
    for i in range(len(left)):
        for j in (trie.linked(sets[i], has, percent) + base).tolist():
            a, b = root(i), root(j)
            if a != b:
                parent[a] = b
                links.append((i, j))
    return links


def _packed(batches):
    """Texts travel to their shards compressed: they are shorter than their hashes."""
    squeeze = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        for at, texts in _steps(batch.column("text")):
            part = batch.slice(at, len(texts))
            yield pa.RecordBatch.from_arrays([part.column("rep"), pa.array([squeeze(t or b"") for t in texts], pa.binary())], names=["rep", "packed"])


def _unpacked(packed: list[bytes], n: int) -> list[np.ndarray]:
    expand, sets = zstandard.ZstdDecompressor().decompress, []
    texts, size = [], 0
    for k, x in enumerate(packed):
        texts.append(expand(x))
        size += len(texts[-1])
        if size >= TEXT_STEP or k == len(packed) - 1:
            sets += shingle_sets(texts, n)
            texts, size = [], 0
    return sets


def _join_shard(n: int, percent: int):
    def run(shard: pa.Table) -> pa.Table:
        i, j = shard.column("block_a")[0].as_py(), shard.column("block_b")[0].as_py()
        reps, links = shard.column("rep").to_pylist(), []
        sides: dict[int, dict[bytes, int]] = {i: {}, j: {}}
        for k, (block, u) in enumerate(zip(shard.column("block").to_pylist(), _unpacked(shard.column("packed").to_pylist(), n), strict=True)):
            at = sides[block].setdefault(u.tobytes(), k)
            if at != k:  # equal sets come only from a repeated doc_id
                links.append((reps[at], reps[k]))
        left = sides[i]
        right = {} if i == j else sides[j]
        rows = [*left.values(), *right.values()]
        if left and (i == j or right):
            found = _forest([np.frombuffer(s, np.uint64) for s in left], None if i == j else [np.frombuffer(s, np.uint64) for s in right], percent)
            links += [(reps[rows[x]], reps[rows[y]]) for x, y in found]
        kind = shard.schema.field("rep").type
        return pa.table({"a": pa.array([x for x, _ in links], kind), "b": pa.array([y for _, y in links], kind)})

    return run


def _meetings(segments: DataFrame) -> DataFrame:
    """``rep, n_shingles, hub``: members of signatures that have more than one, with the smallest of them. Segments are most of what this operator shuffles: they are exchanged once."""
    of = W.partitionBy("signature")
    met = segments.select("rep", "n_shingles", F.min("rep").over(of).alias("hub"), F.count("*").over(of).alias("n"))
    return met.where("n > 1").select("rep", "n_shingles", "hub").distinct()


def ngram_jaccard_join(docs: DataFrame, *, words: int = 4, percent: int = 85, shard_shingles: int = 2_000_000) -> DataFrame:
    """Groups of documents linked by word n-gram sets: ``doc_id, n_shingles, component_id``.

    Words are runs without space or tab to carriage return, A-Z lowered.  Two documents link
    when ``100 * |A & B| >= percent * |A | B|``; ``component_id`` is the smallest ``doc_id``
    reachable, itself included.  One row comes back for each input row.

    * null, empty or blank text: ``n_shingles`` 0, linked with nothing, its own component;
    * fewer than ``words`` words: the whole sequence is the one shingle;
    * null ``doc_id``: ``n_shingles`` is given, ``component_id`` is null, and the row links nothing;
    * repeated rows: one class, each row comes back; texts that share a ``doc_id`` are one
      document; an empty table gives an empty result;
    * further columns are ignored.
    """
    kind = docs.schema["doc_id"].dataType
    base = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("n_shingles", T.LongType()), T.StructField("set_key", T.BinaryType()), T.StructField("signatures", T.ArrayType(T.LongType()))])
    described = base.mapInArrow(_describe(words, percent, True), schema)
    per_doc = base.mapInArrow(_describe(words, percent, False), T.StructType(schema.fields[:3]))

    # 1. classes of equal sets
    classes = cut(described.where("n_shingles > 0 and doc_id is not null").groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.min("n_shingles").alias("n_shingles"), F.first("signatures").alias("signatures")))
    # 2. and 3. segments, and the pairs of members and hubs
    pairs = cut(_meetings(classes.select("rep", "n_shingles", F.explode("signatures").alias("signature"))))
    # 4. shards with their texts
    blocks = pairs.groupBy("hub").agg(F.sum("n_shingles").alias("size"), F.count("*").alias("members")).where("members > 1").select("hub", F.ceil(F.col("size") / shard_shingles).cast("int").alias("n_blocks"))
    placed = pairs.join(blocks, "hub").select("rep", "hub", "n_blocks", F.pmod(F.xxhash64("rep"), F.col("n_blocks")).cast("int").alias("block"))
    placed = cut(placed.groupBy("rep").agg(F.collect_list(F.struct("hub", "n_blocks", "block")).alias("shards")))
    # texts are packed before they meet their places, as the join shuffles them; by a merge at every size, so that small tables show what large ones cost
    texts = base.where("doc_id is not null").withColumnRenamed("doc_id", "rep").mapInArrow(_packed, T.StructType([T.StructField("rep", kind), T.StructField("packed", T.BinaryType())]))
    packed = texts.join(placed.hint("merge"), "rep")
    spread = packed.select("rep", "packed", F.explode("shards").alias("s")).select("rep", "packed", "s.hub", "s.n_blocks", "s.block")
    spread = spread.select(
        "rep", "packed", "hub", "block", F.explode(F.transform(F.sequence(F.lit(0), F.col("n_blocks") - 1), lambda o: F.struct(F.least("block", o).alias("block_a"), F.greatest("block", o).alias("block_b")))).alias("p")
    ).select("rep", "packed", "hub", "block", "p.block_a", "p.block_b")
    links = spread.groupBy("hub", "block_a", "block_b").applyInArrow(_join_shard(words, percent), T.StructType([T.StructField("a", kind), T.StructField("b", kind)]))
    groups = components(links)
    # back to documents
    label = classes.select("set_key", "rep").join(groups.withColumnRenamed("node", "rep"), "rep", "left").select("set_key", F.coalesce("component", "rep").alias("label"))
    return per_doc.join(label, "set_key", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("label", "doc_id")).alias("component_id"))


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole ``documents`` table, four words, 85 percent."""
    return ngram_jaccard_join(table(spark, sf_dir, "documents"), words=4, percent=85)


OP8_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
g AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 3), ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM g x JOIN g y USING (g) WHERE x.doc_id <> y.doc_id GROUP BY 1, 2),
k AS (SELECT a, b FROM shared JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * common >= 85 * (na.n + nb.n - common)),
r AS (SELECT a, b FROM k UNION SELECT r.a, k.b FROM r JOIN k ON r.b = k.a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(c, doc_id)) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS c FROM r GROUP BY 1) USING (doc_id)
"""
