"""Media columns: chroma fingerprints of recordings, and their alignment.

A recording is a binary column of 16-bit mono PCM.  Its spectrum is folded into twelve pitch classes a frame; an
integral image over (frame, pitch class) gives any rectangle's sum with four look-ups, and sixteen
difference filters of such rectangles, two bits each, pack every frame into one 32-bit integer.  Equal integers of two recordings
vote for the offset at which they meet; at every offset with a vote the share of differing bits over all frames that then overlap decides.  Integers that are held
vote as runs, a range of offsets for two of them.  Recordings meet queries in packs, and votes are counted and checked where they arise, so that only matches leave a task.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkscape.llm.common import cut, rows_at_once, table

RATE, FRAME, HOP, WIDE = 8000, 2048, 512, 8
#: (kind, first pitch class, pitch classes, frames) of the filters, by rule: six ways to halve a rectangle, spread over classes and widths.
FILTERS = [(k % 4, (5 * k) % 12, 1 + k % 3, 2 + 2 * (k % 4)) for k in range(16)]
LOW = 0.02
#: Frames whose spectra are held at once, and recordings that leave a task in one batch.
BLOCK, PART = 256, 64
#: Lists of integers that are matched together, and frames that are compared at once.
PACK, CHECKED = 256, 2_000_000


def chroma(pcm: np.ndarray) -> np.ndarray:
    """Pitch class energies, a row for each frame, each row of length one; none for less than a frame."""
    if len(pcm) < FRAME:
        return np.empty((0, 12))
    frames = np.lib.stride_tricks.sliding_window_view(pcm, FRAME)[::HOP]
    hz, fade = np.fft.rfftfreq(FRAME, 1 / RATE), np.hanning(FRAME)
    use = (hz >= 55) & (hz <= 3520)
    pitch = np.round(12 * np.log2(hz[use] / 440)).astype(int) % 12
    folds = (pitch[:, None] == np.arange(12)).astype(float)
    image = np.zeros((len(frames), 12))
    for k in range(0, len(frames), BLOCK):  # spectra of a block at a time: a long recording needs no more memory
        spectrum = np.fft.rfft(frames[k : k + BLOCK] * fade, axis=1)[:, use]
        image[k : k + BLOCK] = (spectrum.real**2 + spectrum.imag**2) @ folds
    return image / np.maximum(np.linalg.norm(image, axis=1, keepdims=True), 1e-9)


def fingerprint(image: np.ndarray) -> np.ndarray:
    """A 32-bit integer for every frame from which WIDE frames remain."""
    n = len(image) - WIDE + 1
    if n <= 0:
        return np.empty(0, np.int64)
    wrapped = np.concatenate((image, image[:, :6]), axis=1)  # pitch classes go round
    total = np.zeros((len(image) + 1, 19))
    total[1:, 1:] = wrapped.cumsum(0).cumsum(1)
    t = np.arange(n)

    def box(t0: int, t1: int, p0: int, p1: int) -> np.ndarray:
        return total[t + t1, p1] - total[t + t0, p1] - total[t + t1, p0] + total[t + t0, p0]

    out = np.zeros(n, np.int64)
    for kind, p, high, wide in FILTERS:
        a, b = p, p + 2 * high
        half, middle = wide // 2, p + high
        if kind == 0:
            value = box(0, half, a, b) - box(half, wide, a, b)
        elif kind == 1:
            value = box(0, wide, a, middle) - box(0, wide, middle, b)
        elif kind == 2:
            value = box(0, half, a, middle) + box(half, wide, middle, b) - box(0, half, middle, b) - box(half, wide, a, middle)
        else:
            value = box(0, wide, a, b) - (box(0, WIDE, 0, 12) * wide * 2 * high / (WIDE * 12))
        scale = LOW * wide * high
        bits = np.where(value > scale, 2, np.where(value > 0, 3, np.where(value > -scale, 1, 0)))  # neighbours differ in one bit
        out = out << 2 | bits
    return out


def _prints(batches):
    for batch in (b.slice(k, PART) for b in batches for k in range(0, len(b), PART)):
        got = []
        for x in batch.column("audio"):
            raw = x.as_py() or b""
            got.append(fingerprint(chroma(np.frombuffer(raw[: len(raw) // 2 * 2], "<i2"))))
        offsets = np.concatenate(([0], np.cumsum([len(g) for g in got]))).astype(np.int32)
        values = pa.array(np.concatenate(got) if got else np.empty(0, np.int64), pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("rec_id"), pa.ListArray.from_arrays(pa.array(offsets), values)], names=["rec_id", "prints"])


def fingerprints(recordings: DataFrame) -> DataFrame:
    """``rec_id, prints`` from ``rec_id, audio``; null, odd or too short audio gives no integers."""
    schema = T.StructType([recordings.schema["rec_id"], T.StructField("prints", T.ArrayType(T.LongType()))])
    return recordings.select("rec_id", "audio").mapInArrow(_prints, schema)


def _packed(batches):
    """``pack, reps, sizes, values`` of up to PACK lists of integers at a time."""
    held, made = [], 0

    def closed():
        columns = [pa.array([(TaskContext.get().partitionId() << 32) + made], pa.int64()), pa.array([[r for r, _ in held]], pa.list_(kind)), pa.array([np.array([len(x) for _, x in held], np.int64).tobytes()], pa.binary())]
        return pa.RecordBatch.from_arrays([*columns, pa.array([np.concatenate([x for _, x in held]).astype(np.uint32).tobytes()], pa.binary())], names=["pack", "reps", "sizes", "values"])

    for batch in batches:
        kind = batch.schema.field("rep").type
        for rep, prints in zip(batch.column("rep").to_pylist(), batch.column("prints"), strict=True):
            held.append((rep, prints.values.to_numpy()))
            if len(held) == PACK:
                yield closed()
                held, made = [], made + 1
    if held:
        yield closed()


class _Pack:
    """Lists of integers one after another, and their runs of equal integers."""

    def __init__(self, reps: list, sizes: bytes, values: bytes):
        self.reps, self.sizes, self.values = reps, np.frombuffer(sizes, np.int64), np.frombuffer(values, np.uint32)
        self.starts = np.cumsum(self.sizes) - self.sizes
        owner = np.repeat(np.arange(len(reps)), self.sizes)
        first = np.ones(len(self.values), bool)
        first[1:] = (self.values[1:] != self.values[:-1]) | (owner[1:] != owner[:-1])
        at = np.flatnonzero(first)
        self.owner, self.value = owner[at], self.values[at]
        self.begin, self.length = at - self.starts[self.owner], np.diff(np.append(at, len(self.values)))


def _spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of ``counts`` its place, that many times, and the numbers from 0."""
    of = np.repeat(np.arange(len(counts)), counts)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)


def _offsets(r: _Pack, q: _Pack):
    """Slices of distinct (recording, query, offset) at which at least one integer is equal: two runs of one integer meet at each offset from last on first to first on last."""
    order = np.argsort(q.value, kind="stable")
    values = q.value[order]
    low, high = np.searchsorted(values, r.value), np.searchsorted(values, r.value, side="right")
    span = int(r.sizes.max() + q.sizes.max() + 1)
    bounds = np.flatnonzero(np.diff(r.owner, prepend=-1))  # the runs of one recording after another
    for a, b in zip(bounds, [*bounds[1:], len(r.value)], strict=True):
        of, k = _spread(high[a:b] - low[a:b])
        mine, other = a + of, order[low[a:b][of] + k]
        many, k = _spread(r.length[mine] + q.length[other] - 1)
        offset = (r.begin[mine] - q.begin[other] - q.length[other] + 1)[many] + k
        found = np.unique(q.owner[other][many] * (2 * span) + offset + span)
        if len(found):
            yield int(r.owner[a]), found // (2 * span), found % (2 * span) - span


def matches(r: _Pack, q: _Pack, most_errors: float, least_frames: int) -> list[tuple]:
    """``rep, query, offset, votes, frames, errors`` of all offsets of two packs that pass."""
    out = []
    for mine, others, offsets in _offsets(r, q):
        skip, start = np.maximum(-offsets, 0), np.maximum(offsets, 0)
        frames = np.minimum(r.sizes[mine] - start, q.sizes[others] - skip)
        keep = np.flatnonzero(frames >= least_frames)
        for part in np.array_split(keep, max(1, int(frames[keep].sum()) // CHECKED)):
            if not len(part):
                continue
            of, k = _spread(frames[part])
            x = r.values[(r.starts[mine] + start[part])[of] + k] ^ q.values[(q.starts[others[part]] + skip[part])[of] + k]
            begins = np.cumsum(frames[part]) - frames[part]
            errors, votes = np.add.reduceat(np.bitwise_count(x).astype(np.int64), begins), np.add.reduceat((x == 0).astype(np.int64), begins)
            for i in np.flatnonzero(errors <= most_errors * 32 * frames[part]).tolist():
                j = part[i]
                out.append((r.reps[mine], q.reps[others[j]], int(offsets[j]), int(votes[i]), int(frames[j]), int(errors[i])))
    return out


def _matched(most_errors: float, least_frames: int):
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                found = [x for x in matches(_Pack(row["reps"], row["sizes"], row["values"]), _Pack(row["q_reps"], row["q_sizes"], row["q_values"]), most_errors, least_frames) if x[0] != x[1]]
                kind = batch.schema.field("reps").type.value_type
                columns = [pa.array([x[i] for x in found], k) for i, k in enumerate([kind, kind, *[pa.int64()] * 4])]
                yield pa.RecordBatch.from_arrays(columns, names=["rep", "query", "offset", "votes", "frames", "errors"])

    return run


def align(prints: DataFrame, queries: DataFrame, *, most_errors: float = 0.25, least_frames: int = 8) -> DataFrame:
    """``query_id, rec_id, copies, offset, votes, frames, bit_error, offsets``: recordings that match a query, itself and rows of null id left out.

    Recordings with the same integers are one class under the smallest id, and so are queries: pairs are between representatives,
    ``copies`` says how many recordings the matched class has.  An offset is where the query starts in the recording.  Each one at which at least one
    integer is equal is tried: at least ``least_frames`` frames must overlap, with at most ``most_errors`` of their
    bits different; ``votes`` counts the equal integers there.  ``offsets`` lists all that pass, in order, as ``struct(offset, votes, frames, bit_error)``;
    the four columns before it are those of the one with most votes, the smallest in a tie.

    Null and empty lists match nothing; of several lists under one ``rec_id`` each counts; repeated rows are one; an empty table gives no rows; further columns are ignored.
    """
    usable = prints.where("rec_id is not null and size(prints) > 0").withColumn("key", F.sha2(F.array_join(F.col("prints").cast("array<string>"), ","), 256))
    asked = usable.join(queries.select(F.col("rec_id")).distinct(), "rec_id", "left_semi").select("key").distinct().withColumn("asked", F.lit(True))
    classes = usable.groupBy("key").agg(F.min("rec_id").alias("rep"), F.count_distinct("rec_id").alias("copies"), F.first("prints").alias("prints"))
    classes = cut(classes.join(asked, "key", "left").select("rep", "copies", "prints", F.coalesce("asked", F.lit(False)).alias("asked")))
    kind = classes.schema["rep"].dataType
    schema = T.StructType([T.StructField("pack", T.LongType()), T.StructField("reps", T.ArrayType(kind)), T.StructField("sizes", T.BinaryType()), T.StructField("values", T.BinaryType())])
    packs = classes.select("rep", "prints").mapInArrow(_packed, schema)
    sought = cut(classes.where("asked").select("rep", "prints").repartition(1 + classes.where("asked").count() // PACK).mapInArrow(_packed, schema))
    groups = max(1, sought.count())
    sought = sought.select(F.pmod(F.xxhash64("pack"), F.lit(groups)).alias("together"), *[F.col(c).alias(f"q_{c}") for c in ("reps", "sizes", "values")])
    met = packs.withColumn("together", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).join(sought, "together")  # the stated queries against all, in blocks
    numbers = T._parse_datatype_string("offset long, votes long, frames long, errors long").fields
    with rows_at_once(prints.sparkSession, 8):
        passed = cut(met.drop("together", "pack").mapInArrow(_matched(most_errors, least_frames), T.StructType([T.StructField("rep", kind), T.StructField("query", kind), *numbers])))
    passed = passed.join(classes.select("rep", "copies").groupBy("rep").agg(F.max("copies").alias("copies")), "rep")
    passed = passed.withColumn("bit_error", F.col("errors") / (F.col("frames") * 32))
    best = F.max_by(F.struct("offset", "votes", "frames", "bit_error"), F.struct("votes", (-F.col("offset")).alias("back")))
    found = passed.groupBy("query", "rep").agg(F.first("copies").alias("copies"), best.alias("best"), F.array_sort(F.collect_list(F.struct("offset", "votes", "frames", "bit_error"))).alias("offsets"))
    return found.select(F.col("query").alias("query_id"), F.col("rep").alias("rec_id"), "copies", "best.*", "offsets")


def _synthesise(batches):
    time = np.arange(1000) / RATE
    fade = np.minimum(1, np.minimum(np.arange(1000), np.arange(1000)[::-1]) / 50)
    waves = np.array([(0.5 * np.sin(2 * np.pi * 220 * 2 ** (n / 12) * time) * fade * 32000).astype("<i2") for n in range(24)])
    for batch in (b.slice(k, PART) for b in batches for k in range(0, len(b), PART)):
        audio = []
        for x in batch.column("embedding"):
            notes = [int(abs(v) * 997) % 24 if v is not None and math.isfinite(v) else 0 for v in x.as_py() or []]
            audio.append(waves[notes].tobytes() if notes else None)
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(audio, pa.binary())], names=["rec_id", "audio"])


def recordings_of(embeddings: DataFrame) -> DataFrame:
    """Tables here hold no sound, so each vector is played: all its components as notes of an eighth of a second, 16-bit PCM in ``audio``; null and not finite ones as the note of 0."""
    schema = T.StructType([T.StructField("rec_id", embeddings.schema["vec_id"].dataType), T.StructField("audio", T.BinaryType())])
    return embeddings.select("vec_id", "embedding").mapInArrow(_synthesise, schema)


def _play_and_print(batches):
    """``_prints`` over ``_synthesise`` in one task, so that no more than PART recordings are held at once."""
    return _prints(_synthesise(batches))


def fingerprints_of_vectors(embeddings: DataFrame) -> DataFrame:
    """``fingerprints(recordings_of(embeddings))`` without the sound leaving the task."""
    schema = T.StructType([T.StructField("rec_id", embeddings.schema["vec_id"].dataType), T.StructField("prints", T.ArrayType(T.LongType()))])
    return embeddings.select("vec_id", "embedding").mapInArrow(_play_and_print, schema)


def op7_media_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each recording made from ``embeddings``: digest and number of its integers, and for queries (id divisible by 100) how many classes match their class, and each of them with its copies and all matching offsets."""
    prints = cut(fingerprints_of_vectors(table(spark, sf_dir, "embeddings")))
    queries = prints.where("rec_id % 100 = 0").select("rec_id")
    keyed = prints.select("rec_id", F.size("prints").cast("long").alias("n_prints"), F.sha2(F.array_join(F.col("prints").cast("array<string>"), ","), 256).alias("prints_sha256"))
    found = align(prints, queries).groupBy("query_id").agg(F.count("*").alias("n_matches"), F.sum("copies").alias("n_recordings"), F.min(F.struct(F.array_min("offsets.bit_error").alias("bit_error"), "rec_id")).alias("best"), F.array_sort(F.collect_list(F.struct("rec_id", "copies", "offsets"))).alias("matches"))
    rep = keyed.where("n_prints > 0").groupBy("prints_sha256").agg(F.min("rec_id").alias("class_id"))
    joined = keyed.join(rep, "prints_sha256", "left").join(found, F.col("class_id") == F.col("query_id"), "left")
    asked = F.col("rec_id") % 100 == 0
    return joined.select(
        "rec_id", "n_prints", "prints_sha256", "class_id", F.when(asked, F.coalesce("n_matches", F.lit(0))).cast("long").alias("n_matches"),
        F.when(asked, F.coalesce("n_recordings", F.lit(0))).cast("long").alias("n_recordings"), F.when(asked, F.col("best.rec_id")).alias("best_id"), F.when(asked, F.round("best.bit_error", 9)).alias("best_error"),
        F.when(asked, F.coalesce("matches", F.array().cast(found.schema["matches"].dataType))).alias("matches"),
    )
