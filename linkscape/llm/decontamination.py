"""Benchmark decontamination by winnowing, in DataFrame operations alone.

A window of ``window`` consecutive words holds ``w = window - k + 1`` consecutive k-grams.  Winnowing keeps the smallest
k-gram hash of every ``w`` consecutive ones, each place once, so a window shared by a document and an item leaves the same
fingerprint at the same place of both: every shared span of ``window`` words is met, whatever surrounds it.
Fingerprints of documents are looked up among those of the benchmark.  A hit is extended to the windows around it, and
those that stand word for word in an item count, so hash collisions cannot report anything.

Documents are read once, with no shuffle of their texts or words: the benchmark's fingerprints are broadcast, at most
PRINTS of them at a time (a larger benchmark is several passes), and a hit leaves the scan with the words
one window reaches to both sides, never with its text.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkscape.llm.common import cut, table

#: Most benchmark fingerprints that one pass broadcasts (about 40 bytes each).
PRINTS = 1_000_000
#: Low bits of a fingerprint's number hold its place in the text (a text has fewer words than that), the rest its hash.
PLACE_BITS = 30


def word_list(text: Column) -> Column:
    """Words of the contract: A-Z lowered, runs of digits, a-z and everything beyond ASCII.

    The text's UTF-8 bytes are read as Latin-1 first, so that ``lower`` leaves letters beyond ASCII apart: it only
    maps lead bytes C3.. onto E3.., and the number of bytes that follow still tells them from each other.
    """
    return F.regexp_extract_all(F.lower(F.decode(text.cast("binary"), "ISO-8859-1")), F.lit(r"([0-9a-z\x80-\xff]+)"), F.lit(1))


def gram_size(window: int) -> int:
    """Words of a k-gram: half a window, but three where the window has them, as single words are met everywhere."""
    return max((window + 1) // 2, min(window, 3))


# Lists are worked out once by exploding a list of one, in the outer form: a plain column would be inlined into
# each use, and an inner explode adds a filter that works the list out a second time.
def _with(df: DataFrame, name: str, value: Column) -> DataFrame:
    return df.select("*", F.explode_outer(F.array(value)).alias(name))


def _gram(k: int) -> Callable[[Column], Column]:
    # elements are taken one by one: slice() would copy the whole list each time
    return lambda i: F.shiftleft(F.xxhash64(*[F.get("words", i + j) for j in range(k)]), PLACE_BITS).bitwiseOR(i.cast("long"))


def _least(grams: str, w: int) -> Callable[[Column], Column]:
    return lambda i: F.least(*[F.get(grams, i + j) for j in range(w)]) if w > 1 else F.get(grams, i)


def _winnowed(df: DataFrame, windows: list[int]) -> DataFrame:
    """``df`` (with ``words``) and ``prints``: the fingerprints of all the given window sizes, as hash and place in one number."""
    none = F.array().cast("array<bigint>")
    size = F.coalesce(F.size("words"), F.lit(0))
    kept = []
    for k in sorted({gram_size(n) for n in windows}):
        df = _with(df, f"grams_{k}", F.when(size >= k, F.transform(F.sequence(F.lit(0), size - k), _gram(k))).otherwise(none))
        for w in sorted({n - k + 1 for n in windows if gram_size(n) == k}):
            name = f"grams_{k}"
            kept.append(F.when(F.size(name) >= w, F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(name) - w), _least(name, w)))).otherwise(none))
    return _with(df, "prints", kept[0] if len(kept) == 1 else F.array_distinct(F.concat(*kept)) if kept else none)


def _place(number: Column) -> Column:
    return number.bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).cast("int")


def _windows(hits: DataFrame, reach: int, keep: list[str]) -> DataFrame:
    """``keep, first_word, size, content``: the windows of each of ``sizes`` words around the hits (``place``, and ``around``: ``reach`` words before it, itself, and the words after)."""
    rows = hits.select(*keep, "n_words", "place", "around", F.explode("sizes").alias("size"))
    back = F.col("size") - F.greatest(F.floor((F.col("size") + 1) / 2), F.least("size", F.lit(3))).cast("int")
    starts = F.filter(F.sequence(F.col("place") - back, F.col("place")), lambda i: (i >= 0) & (i + F.col("size") <= F.col("n_words")))
    rows = rows.select(*keep, "place", "around", "size", F.explode(starts).alias("first_word"))
    return rows.select(*keep, "first_word", "size", F.array_join(F.slice("around", F.col("first_word") - F.col("place") + reach + 1, F.col("size")), " ").alias("content"))


def _around(window: int) -> tuple[int, Column]:
    reach = window - gram_size(window)
    reach = max([reach, *[n - gram_size(n) for n in range(1, window)]])
    return reach, F.array(*[F.get("words", F.col("place") + o) for o in range(-reach, window)])


def benchmark_windows(benchmark: DataFrame, *, window: int = 10) -> DataFrame:
    """``size, content, item_ids``: every window of the benchmark, its words joined by a space, with the items (as sorted strings) that hold it; an item of fewer words is one window."""
    items = _with(benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")), "words", word_list(F.col("text"))).where(F.size("words") > 0)
    items = items.select("item_id", "words", F.least(F.size("words"), F.lit(window)).alias("size"))
    placed = items.select("item_id", "words", "size", F.explode(F.sequence(F.lit(0), F.size("words") - F.col("size"))).alias("at"))
    rows = placed.select("item_id", "size", F.array_join(F.transform(F.sequence(F.lit(0), F.col("size") - 1), lambda j: F.get("words", F.col("at") + j)), " ").alias("content"))
    return rows.groupBy("size", "content").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"))


def scan(docs: DataFrame, benchmark: DataFrame, *, window: int = 10, prints_a_pass: int = PRINTS) -> tuple[DataFrame, DataFrame]:
    """Two written tables: ``doc_id, text_key, n_words`` for each row of ``docs``, and ``doc_id, text_key, first_word, last_word, item_ids``, the windows of documents that stand in items.

    ``text_key`` tells rows of one ``doc_id`` with different texts apart.
    """
    known = cut(benchmark_windows(benchmark, window=window))
    sizes = sorted(r[0] for r in known.select("size").distinct().collect())  # at most ``window`` values
    each = [_winnowed(known.where(F.col("size") == n).select("size", F.split("content", " ").alias("words")), [n]) for n in sizes or [window]]
    own = reduce(DataFrame.unionByName, [x.select("size", F.explode("prints").alias("number")) for x in each]).select(F.shiftright("number", PLACE_BITS).alias("print"), "size")
    prints = cut(own.groupBy("print").agg(F.collect_set("size").alias("sizes")))
    passes = max(1, -(-prints.count() // prints_a_pass))
    reach, around = _around(window)
    rows = docs.select("doc_id", F.xxhash64(F.col("text").cast("string")).alias("text_key"), F.col("text").cast("string").alias("text"))
    rows = _with(rows, "words", word_list(F.col("text"))).drop("text")
    rows = _winnowed(rows.withColumn("n_words", F.greatest(F.coalesce(F.size("words"), F.lit(0)), F.lit(0))), sizes or [window])
    numbers = rows.select("doc_id", "text_key", "n_words", "words", F.posexplode_outer("prints").alias("nth", "number"))
    numbers = numbers.select("doc_id", "text_key", "n_words", "words", (F.coalesce("nth", F.lit(0)) == 0).alias("head"), F.shiftright("number", PLACE_BITS).alias("print"), _place(F.col("number")).alias("place"))
    seen = None
    for k in range(passes):
        part = prints if passes == 1 else prints.where(F.pmod("print", F.lit(passes)) == k)
        met = numbers.join(F.broadcast(part), "print", "left").where(F.col("sizes").isNotNull() | (F.col("head") & F.lit(k == 0)))
        met = cut(met.select("doc_id", "text_key", "n_words", (F.col("head") & F.lit(k == 0)).alias("head"), "sizes", "place", F.when(F.col("sizes").isNotNull(), around).alias("around")))
        seen = met if seen is None else seen.unionByName(met)
    base = seen.where("head").select("doc_id", "text_key", F.col("n_words").cast("long").alias("n_words"))
    near = _windows(seen.where("sizes is not null"), reach, ["doc_id", "text_key"]).distinct()
    found = near.join(known, ["size", "content"]).select("doc_id", "text_key", "first_word", (F.col("first_word") + F.col("size") - 1).alias("last_word"), "item_ids")
    return base, cut(found)


def contamination(docs: DataFrame, benchmark: DataFrame, *, window: int = 10, prints_a_pass: int = PRINTS) -> DataFrame:
    """One row for each input row: ``doc_id, text_key, n_words, n_hit, n_items, item_ids, contaminated``.

    ``n_hit`` counts words inside any shared window, overlaps once; ``item_ids`` are the items met, as sorted strings.

    * null or empty texts and items have no words and meet nothing; an item of fewer than ``window`` words counts with all of them;
    * a null ``doc_id`` is a value like any other; a null ``item_id`` adds hits but no name;
    * repeated rows come back each, with the same result; empty tables give an empty result or one without hits; further columns are ignored.
    """
    base, found = scan(docs, benchmark, window=window, prints_a_pass=prints_a_pass)
    # overlapping windows count once: walk them in order of their start
    covered = F.aggregate(
        F.array_sort(F.collect_set(F.struct("first_word", "last_word"))),
        F.struct(F.lit(-1).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda acc, x: F.struct(F.greatest(acc["last"], x["last_word"]).alias("last"), (acc["n"] + F.greatest(F.lit(0), x["last_word"] - F.greatest(acc["last"], x["first_word"] - 1))).alias("n")),
        lambda acc: acc["n"],
    )
    hit = found.groupBy("doc_id", "text_key").agg(covered.alias("n_hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("item_ids")))).alias("item_ids"))
    hit = hit.select(F.col("doc_id").alias("hit_id"), F.col("text_key").alias("hit_key"), "n_hit", "item_ids")
    joined = base.join(hit, base["doc_id"].eqNullSafe(hit["hit_id"]) & (base["text_key"] == hit["hit_key"]), "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    item_ids = F.coalesce("item_ids", F.array().cast("array<string>"))
    return joined.select("doc_id", "text_key", "n_words", n_hit.alias("n_hit"), F.size(item_ids).cast("long").alias("n_items"), item_ids.alias("item_ids"), (n_hit > 0).alias("contaminated"))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` against ``benchmark``, windows of ten words."""
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS l, array_to_string(list_slice(w, i, i + least(10, len(w)) - 1), ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (
  SELECT doc_id, i, l, array_to_string(list_slice(w, i, i + l - 1), ' ') AS g
  FROM (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM d, (SELECT DISTINCT l FROM bw) WHERE len(w) >= l)),
hit AS (SELECT doc_id, item_id, i, l FROM dw JOIN bw USING (l, g)),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + l)) AS p FROM hit) GROUP BY doc_id),
it AS (
  SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN it USING (doc_id)
"""
