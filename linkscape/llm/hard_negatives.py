"""Hard negatives by inner products of integers, over Hilbert-ordered blocks with zone maps.

Rows are sorted by label and by their place on a Hilbert curve through the vectors' space, and written as Parquet blocks of up to
BLOCK rows of one label.  A block's zone map has the least and the greatest value of each dimension, so interval arithmetic gives
bounds of the inner product of an anchor and any row of the block without reading it.

A search is a window for each anchor: which labels, between which scores, how many rows.  It takes two turns.  Each window
first reads the one block whose middle promises most, which gives it a score that the rest must reach; then it reads every block
whose bounds can hold a row that is in the window and reaches it.  Nothing that could count is left out, so results are exact.  Anchors travel in chunks of up to CHUNK rows of
one label, zone maps in pages; a block that very many chunks need is one row of a join, whose other side can be split.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from linkscape.llm.common import cut, rows_at_once, table

#: Rows of a block, anchors of a chunk, blocks of a page, pages that are searched together.
BLOCK, CHUNK, PAGE, TOGETHER = 256, 32, 256, 4
#: Bits of a dimension on the Hilbert curve.
BITS = 4
#: Components reach from -LIMIT to LIMIT after scaling, so that scores of up to 128 dimensions fit 64 bits.
LIMIT = 2**28
LEAST, MOST = -(2**63), 2**63 - 1
WINDOW = ("place", "k", "low", "high", "reach", "reach_id")


def hilbert_keys(x: np.ndarray, bits: int = BITS) -> list[bytes]:
    """Places on the Hilbert curve of rows of integers from 0 to 2**bits - 1, as bytes that sort like them (transposed form, by exchanging and inverting low bits)."""
    x = x.astype(np.int64).T.copy()
    n = len(x)
    for q in (1 << k for k in range(bits - 1, 0, -1)):
        for i in range(n):
            up = (x[i] & q) > 0
            swap = np.where(up, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] ^= np.where(up, q - 1, swap)
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros(x.shape[1:], np.int64)
    for q in (1 << k for k in range(bits - 1, 0, -1)):
        t ^= np.where(x[n - 1] & q > 0, q - 1, 0) if n else t
    x ^= t
    planes = (x[None] >> np.arange(bits - 1, -1, -1)[:, None, None]) & 1  # bit planes from the highest, dimensions within
    packed = np.packbits(planes.reshape(bits * n, -1).astype(np.uint8), axis=0).T
    return [r.tobytes() for r in np.ascontiguousarray(packed)]


def quantised(embeddings: DataFrame) -> DataFrame:
    """``vec_id, label, q`` of the rows that take part: each component as ``floor(256 * x)``."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) <= LIMIT / 256))
    rows = embeddings.where("vec_id is not null and label is not null and embedding is not null").where(F.coalesce(fine, F.lit(False)))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), F.transform(x, lambda v: F.floor(v * 256).cast("int")).alias("q"))


def _padded(rows: list[np.ndarray]) -> np.ndarray:
    """One matrix of rows, shorter ones filled up with zeros, which add nothing to an inner product."""
    width = max(map(len, rows), default=0)
    if all(len(r) == width for r in rows):
        return np.array(rows, np.int32).reshape(len(rows), width)
    return np.array([np.pad(r, (0, width - len(r))) for r in rows], np.int32)


def _lists(column: pa.Array) -> list[np.ndarray]:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return [values[i:j] for i, j in zip(offsets[:-1], offsets[1:], strict=True)]


def _placed(least: int, most: int, dims: int):
    def run(batches):
        for batch in batches:
            q = _padded([*_lists(batch.column("q")), np.zeros(dims, np.int32)])[:-1].astype(np.int64)
            x = (q - least) * (2**BITS - 1) // max(most - least, 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hilbert_keys(np.clip(x, 0, 2**BITS - 1)), pa.binary())], names=[*batch.schema.names, "key"])

    return run


def _number(made: int) -> int:
    return (TaskContext.get().partitionId() << 32) + made


def _blocks(size: int):
    """Blocks of sorted rows; a row that repeats the one before it is dropped."""

    def run(batches):
        names = ["block", "label", "n", "least_id", "dims", "ids", "q", "low", "high"]
        held, made, last = [], 0, None

        def closed():
            ids, q = np.array([r[0] for r in held], np.int64), _padded([r[2] for r in held])
            empty = q.shape[1] == 0
            row = (_number(made), held[0][1], len(held), int(ids.min()), q.shape[1], ids.tobytes(), q.tobytes(), b"" if empty else q.min(axis=0).tobytes(), b"" if empty else q.max(axis=0).tobytes())
            kinds = [pa.int64()] * 4 + [pa.int32()] + [pa.binary()] * 4
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names=names)

        for batch in batches:
            for i, label, q in zip(batch.column("vec_id").to_pylist(), batch.column("label").to_pylist(), _lists(batch.column("q")), strict=True):
                if last is not None and last[0] == i and last[1] == label and np.array_equal(last[2], q):
                    continue
                if held and (held[0][1] != label or len(held) == size):
                    yield closed()
                    held, made = [], made + 1
                last = (i, label, q)
                held.append(last)
        if held:
            yield closed()

    return run


BLOCKS = "block long, label long, n long, least_id long, dims int, ids binary, q binary, low binary, high binary"


def blocks_of(rows: DataFrame, size: int = BLOCK) -> DataFrame:
    """Blocks of ``vec_id, label, q``, written in the order of label and Hilbert curve."""
    ends = rows.agg(F.min(F.array_min("q")).alias("least"), F.max(F.array_max("q")).alias("most"), F.max(F.size("q")).alias("dims")).first()
    placed = cut(rows.mapInArrow(_placed(ends["least"] or 0, ends["most"] or 0, ends["dims"] or 0), "vec_id long, label long, q array<int>, key binary"))
    order = ["label", "key", "vec_id", "q"]
    spread = placed.repartitionByRange(*order).sortWithinPartitions(*order)
    return cut(spread.select("vec_id", "label", "q").mapInArrow(_blocks(size), BLOCKS))


def _matrix(raw: bytes, dims: int) -> np.ndarray:
    return np.frombuffer(raw, np.int32).reshape(-1, dims) if dims else np.zeros((0, 0), np.int32)


def _chunks(every: int, size: int):
    """Anchors of the blocks of a task, in their order, as chunks of one label."""

    def run(batches):
        names, kinds = ["chunk", "label", "dims", "ids", "homes", "spots", "q"], [pa.int64(), pa.int64(), pa.int32(), *[pa.binary()] * 4]
        held, made = [], 0

        def closed():
            q = _padded([r[3] for r in held])
            row = (_number(made), held[0][4], q.shape[1], *[np.array([r[k] for r in held], np.int64).tobytes() for k in range(3)], q.tobytes())
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names=names)

        for batch in batches:
            for b in batch.to_pylist():
                ids = np.frombuffer(b["ids"], np.int64)
                q = _matrix(b["q"], b["dims"]) if b["dims"] else np.zeros((len(ids), 0), np.int32)
                for k in np.flatnonzero(ids % every == 0).tolist():
                    if held and (held[0][4] != b["label"] or len(held) == size):
                        yield closed()
                        held, made = [], made + 1
                    held.append((int(ids[k]), b["block"], k, q[k], b["label"]))
        if held:
            yield closed()

    return run


CHUNKS = "chunk long, label long, dims int, ids binary, homes binary, spots binary, q binary"


def _pages(size: int):
    """Zone maps of the blocks of a task, ``size`` at a time."""

    def run(batches):
        held, made = [], 0
        names = ["page", "dims", "blocks", "labels", "least_ids", "low", "high"]

        def closed():
            low, high = _padded([r[3] for r in held]), _padded([r[4] for r in held])
            row = (_number(made), low.shape[1], *[np.array([r[k] for r in held], np.int64).tobytes() for k in range(3)], low.tobytes(), high.tobytes())
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, [pa.int64(), pa.int32(), *[pa.binary()] * 5], strict=True)], names=names)

        for batch in batches:
            for b in batch.to_pylist():
                held.append((b["block"], b["label"], b["least_id"], np.frombuffer(b["low"], np.int32), np.frombuffer(b["high"], np.int32)))
                if len(held) == size:
                    yield closed()
                    held, made = [], made + 1
        if held:
            yield closed()

    return run


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a @ b.T`` of integers, exact: in doubles where all sums stay below 2**53."""
    if a.shape[1] != b.shape[1]:
        width = max(a.shape[1], b.shape[1])
        a, b = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (a, b))
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    if float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < 2.0**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def bounds(a: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product of each row of ``a`` with anything between ``low`` and ``high``, a column a block."""
    up, down = np.maximum(a, 0), np.minimum(a, 0)
    return product(up, low) + product(down, high), product(up, high) + product(down, low)


class _Asking:
    """A chunk's anchors and windows, from a row."""

    def __init__(self, batch: pa.RecordBatch, k: int):
        get = lambda c: batch.column(c)[k].as_py()
        self.chunk, self.label = get("chunk"), get("label")
        self.ids = np.frombuffer(get("ids"), np.int64)
        self.q = _matrix(get("q"), get("a_dims")) if get("a_dims") else np.zeros((len(self.ids), 0), np.int32)
        self.homes, self.spots = np.frombuffer(get("homes"), np.int64), np.frombuffer(get("spots"), np.int64)
        self.place, self.k, self.low, self.high, self.reach, self.reach_id = (np.asarray(batch.column(c)[k].values.to_numpy(), np.int64) for c in WINDOW)


def _chosen(same: bool, first: bool):
    """``chunk, page, place, k, block, worth``: for each window the block whose middle promises most (``first``), or all that can hold what it seeks (then a block of a chunk once)."""

    def run(batches):
        for batch in batches:
            out: list[tuple] = []
            for r in range(len(batch)):
                asking = _Asking(batch, r)
                get = lambda c: batch.column(c)[r].as_py()  # noqa: B023, E731
                blocks, labels, least_ids = (np.frombuffer(get(c), np.int64) for c in ("blocks", "labels", "least_ids"))
                fit = np.flatnonzero((labels == asking.label) == same)
                if not len(fit):
                    continue
                dims = get("p_dims")
                zones = [(_matrix(get(c), dims) if dims else np.zeros((len(blocks), 0), np.int32))[fit] for c in ("zone_low", "zone_high")]
                least, most = (x[asking.place] for x in bounds(asking.q, *zones))
                low, high, reach = asking.low[:, None], asking.high[:, None], asking.reach[:, None]
                top = np.minimum(most, high)
                usable = (most >= low) & (least <= high) & ((top > reach) | ((top == reach) & (least_ids[fit][None] <= asking.reach_id[:, None])))
                if first:
                    middle = least.astype(np.float64) / 2 + most.astype(np.float64) / 2
                    worth = np.where(usable, -np.abs(middle - np.minimum(high.astype(np.float64), 2.0**62)), -np.inf)
                    best = worth.argmax(axis=1)
                    out += [(asking.chunk, int(asking.place[w]), int(asking.k[w]), int(blocks[fit[b]]), float(worth[w, b])) for w, b in enumerate(best.tolist()) if np.isfinite(worth[w, b])]
                else:
                    out += [(asking.chunk, 0, 0, int(b), 0.0) for b in blocks[fit[usable.any(axis=0)]].tolist()]
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)], names=["chunk", "place", "k", "block", "worth"])

    return run


def _read(want: int):
    """``chunk, place, k, score, id``: the first ``want`` rows of a block in each window."""

    def run(batches):
        for batch in batches:
            found: list[list[np.ndarray]] = [[] for _ in range(5)]
            for r in range(len(batch)):
                asking = _Asking(batch, r)
                ids, dims = np.frombuffer(batch.column("b_ids")[r].as_py(), np.int64), batch.column("b_dims")[r].as_py()
                q = _matrix(batch.column("b_q")[r].as_py(), dims) if dims else np.zeros((len(ids), 0), np.int32)
                each = product(asking.q, q)
                scores = each[asking.place]
                own = np.zeros(each.shape, bool)
                at = np.flatnonzero(asking.homes == batch.column("block")[r].as_py())
                own[at, asking.spots[at]] = True
                reach = asking.reach[:, None]
                valid = (scores >= asking.low[:, None]) & (scores <= asking.high[:, None]) & ~own[asking.place] & ((scores > reach) | ((scores == reach) & (ids[None] <= asking.reach_id[:, None])))
                if scores.shape[1] > want:
                    valid &= scores >= np.partition(np.where(valid, scores, LEAST), -want, axis=1)[:, -want][:, None]
                w, c = np.nonzero(valid)
                order = np.lexsort((ids[c], -scores[w, c], w))
                w, c = w[order], c[order]
                nth = np.arange(len(w)) - np.searchsorted(w, w)
                w, c = w[nth < want], c[nth < want]
                for column, x in zip(found, (np.full(len(w), asking.chunk), asking.place[w], asking.k[w], scores[w, c], ids[c]), strict=True):
                    column.append(x)
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else [], k) for x, k in zip(found, kinds, strict=True)], names=["chunk", "place", "k", "score", "id"])

    return run


class Index:
    """Blocks, zone maps and anchors of ``vec_id, label, q`` (as of ``quantised``), written; anchors are the rows whose ``vec_id`` is divisible by ``every``."""

    def __init__(self, rows: DataFrame, *, every: int = 50, block: int = BLOCK, chunk: int = CHUNK, page: int = PAGE):
        self.spark = rows.sparkSession
        self.blocks = blocks_of(rows, block)
        with rows_at_once(self.spark, 64):
            self.chunks = cut(self.blocks.select("block", "label", "dims", "ids", "q").mapInArrow(_chunks(every, chunk), CHUNKS))
        pages = self.blocks.select("block", "label", "least_id", "low", "high").mapInArrow(_pages(page), "page long, p_dims int, blocks binary, labels binary, least_ids binary, zone_low binary, zone_high binary")
        pages = cut(pages)
        self.groups = max(1, pages.count() // TOGETHER)
        self.pages = pages.withColumn("together", F.pmod(F.xxhash64("page"), F.lit(self.groups)))

    def anchors(self) -> DataFrame:
        """``chunk, place, anchor_id, label`` of every anchor."""
        names = self.chunks.select("chunk", "label", "ids").mapInArrow(_unpacked, "chunk long, label long, place int, anchor_id long")
        return names.select("chunk", "place", "anchor_id", "label")

    def _asking(self, windows: DataFrame) -> DataFrame:
        """Chunks with their windows (``chunk, place, k, low, high, reach, reach_id``), at most five for each of CHUNK anchors."""
        listed = windows.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct(*WINDOW))).alias("w"))
        return cut(self.chunks.join(listed, "chunk").select("chunk", "label", F.col("dims").alias("a_dims"), "ids", "homes", "spots", "q", *[F.col(f"w.{c}").cast("array<long>").alias(c) for c in WINDOW]))

    def _over_pages(self, asking: DataFrame, same: bool, first: bool) -> DataFrame:
        """Each chunk meets each page of zone maps: the stated anchors against all blocks."""
        sent = asking.withColumn("together", F.explode(F.sequence(F.lit(0), F.lit(self.groups - 1))))
        met = sent.join(self.pages, "together").drop("together", "page")
        found = met.mapInArrow(_chosen(same, first), "chunk long, place int, k int, block long, worth double")
        with rows_at_once(self.spark, 64):
            if first:
                return cut(found.groupBy("chunk", "place", "k").agg(F.max_by("block", F.struct("worth", "block")).alias("block")).select("chunk", "block").distinct())
            return cut(found.select("chunk", "block"))

    def _over_blocks(self, asking: DataFrame, pairs: DataFrame, want: int) -> DataFrame:
        """``chunk, place, k, score, id, rank``: of the rows in the paired blocks, the first of each window."""
        sent = pairs.join(asking, "chunk")
        blocks = self.blocks.select("block", F.col("dims").alias("b_dims"), F.col("ids").alias("b_ids"), F.col("q").alias("b_q"))
        with rows_at_once(self.spark, 64):
            rows = cut(sent.join(blocks, "block").mapInArrow(_read(want), "chunk long, place int, k int, score long, id long"))
        order = W.partitionBy("chunk", "place", "k").orderBy(F.desc("score"), "id")
        return cut(rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= want))

    def search(self, windows: DataFrame, want: int, *, same: bool) -> DataFrame:
        """``chunk, place, k, score, id, rank``: for each window (``chunk, place, k, low, high``) the first ``want`` rows of the anchor's label, or of all others, by score and then by id; the anchor's own row takes no part."""
        windows = cut(windows.select("chunk", "place", "k", "low", "high"))
        keys = ["chunk", "place", "k"]
        asking = self._asking(windows.withColumns({"reach": F.lit(LEAST), "reach_id": F.lit(MOST)}))
        seen = self._over_blocks(asking, self._over_pages(asking, same, True), want).where(F.col("rank") == want)
        reach = windows.join(seen.select(*keys, F.col("score").alias("reach"), F.col("id").alias("reach_id")), keys, "left")
        asking = self._asking(reach.select(*keys, "low", "high", F.coalesce("reach", F.lit(LEAST)).alias("reach"), F.coalesce("reach_id", F.lit(MOST)).alias("reach_id")))
        return self._over_blocks(asking, self._over_pages(asking, same, False), want)


def _unpacked(batches):
    for batch in batches:
        for c, label, ids in zip(batch.column("chunk").to_pylist(), batch.column("label").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            ids = np.frombuffer(ids, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), c)), pa.array(np.full(len(ids), label)), pa.array(np.arange(len(ids), dtype=np.int32)), pa.array(ids)], names=["chunk", "label", "place", "anchor_id"])


def hard_negatives(embeddings: DataFrame, *, every: int = 50, positives: int = 5, negatives: int = 3, low_percent: int = 50, high_percent: int = 95, block: int = BLOCK, chunk: int = CHUNK, page: int = PAGE) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` from ``vec_id, label, embedding``.

    An anchor's first ``positives`` other rows of its label are its positives; for each, the first ``negatives`` rows of other labels whose score is
    from ``low_percent`` to ``high_percent`` of the positive's, so none where that is negative.

    * null ids, labels, vectors or components, and components that are not finite or that scale beyond 2**28, take no part;
    * repeated rows are one; other rows under one id are each a row; ties go to the smaller id;
    * vectors of different lengths: what a shorter one lacks counts as zero; an empty table gives no rows; further columns are ignored.
    """
    index = Index(quantised(embeddings), every=every, block=block, chunk=chunk, page=page)
    anchors = cut(index.anchors())
    whole = anchors.select("chunk", "place", F.lit(0).alias("k"), F.lit(LEAST).alias("low"), F.lit(MOST).alias("high"))
    found = index.search(whole, positives, same=True)
    keys = ["chunk", "place", "k"]
    chosen = cut(found.select("chunk", "place", F.col("rank").alias("k"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")))
    # bounds in whole numbers: at least the share rounded up, at most the share rounded down
    low, high = F.expr(f"(positive_score * {low_percent} + 99) div 100"), F.expr(f"(positive_score * {high_percent}) div 100")
    windows = chosen.where("positive_score >= 0").select(*keys, low.alias("low"), high.alias("high")).where("low <= high")
    negative = index.search(windows, negatives, same=False).select(*keys, "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = negative.join(chosen, keys).join(anchors.select("chunk", "place", "anchor_id"), ["chunk", "place"])
    return named.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole ``embeddings``; anchors are the ids divisible by 50."""
    return hard_negatives(table(spark, sf_dir, "embeddings"))


OP12_SQL = """
WITH r AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label = r.label AS same, r.vec_id AS id, CAST(list_dot_product(a.q, r.q) AS BIGINT) AS score FROM r a JOIN r ON a.vec_id <> r.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.id)
QUALIFY row_number() OVER w <= 3
"""
