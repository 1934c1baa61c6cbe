"""Line dedup: repeated runs of lines, found by ranking suffixes of line sequences, later copies deleted.

Documents are sequences of line ids (blank lines left out).  Suffixes are ranked by distributed prefix doubling:
``rank_k`` orders them by their first ``2**k`` lines, and ``rank_(k+1)`` comes from sorting the distinct pairs
``(rank_k(p), rank_k(p + 2**k))``, so that a very frequent line or run is one row in the sort.  A suffix whose prefix occurs
once leaves at that level: it lies in no repeated run of that length.

A run counts from ``min_words`` words on.  For each suffix, its shortest prefix of that many words has some T lines (at
most ``min_words``, which bounds the levels); its LCP interval of depth T, the suffixes that share these T lines, is
named by two ranks, of the first and of the last ``2**K`` of them (``K = floor(log2 T)``).  All but the interval's first suffix in document order are later copies.
The same is done for the shortest stretch that ends at each line, which covers the tails of runs.  Together the deleted
lines are exactly those of maximal repeated runs of ``min_words`` words or more that occur earlier in the corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from linkscape.llm.common import apart, cut, table

DOC = ["doc_id", "text_key"]


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.withColumn("text_key", F.xxhash64(text)).withColumn("lines", F.split(text, "\n", -1))


def _match(a: DataFrame, b: DataFrame, more: Column | None = None) -> Column:
    on = a["doc_id"].eqNullSafe(b["doc_id"]) & (a["text_key"] == b["text_key"])
    return on if more is None else on & more


def _ranked(pairs: DataFrame, keys: list[str], name: str) -> DataFrame:
    """The distinct ``keys`` that occur more than once, with ranks in their order (increasing, with gaps)."""
    repeated = pairs.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").select(*keys)
    return cut(repeated.orderBy(*keys).withColumn(name, F.monotonically_increasing_id()))


def _shortest(words: Column, min_words: int) -> Column:
    """How many leading elements sum up to ``min_words``; null if all do not."""
    found = F.aggregate(
        words, F.struct(F.lit(0).alias("sum"), F.lit(0).alias("n")),
        lambda a, x: F.when(a["sum"] >= min_words, a).otherwise(F.struct((a["sum"] + x).alias("sum"), (a["n"] + 1).alias("n"))),
    )
    return F.when(found["sum"] >= min_words, found["n"])


def repeated_lines(docs: DataFrame, *, min_words: int = 50) -> DataFrame:
    """Lines to delete: ``doc_id, text_key, line_nos`` (sorted 0-based numbers of lines split at LF), for documents that have any."""
    numbered = F.filter(F.transform("lines", lambda x, i: F.struct(i.alias("line_no"), x.alias("line"))), lambda s: s["line"].rlike(r"\S"))
    rows = _keyed(docs.select("doc_id", "text"))
    lines = rows.select(*DOC, F.posexplode_outer(numbered).alias("seq", "s")).where("seq is not null")
    lines = lines.select(*DOC, "seq", F.col("s.line_no").alias("line_no"), F.md5(F.col("s.line").cast("binary")).alias("line_id"), F.least(F.regexp_count("s.line", F.lit(r"\S+")), F.lit(min_words)).alias("words"))
    # level 0: lines that occur again; repeated rows of one document are one
    once = lines.dropDuplicates([*DOC, "seq"])
    ids = _ranked(once, ["line_id"], "rank_0")
    active = once.join(ids, "line_id").drop("line_id")
    run = W.partitionBy(*DOC).orderBy("seq")
    active = cut(active.withColumn("run", F.col("seq") - F.row_number().over(run)))
    within = W.partitionBy(*DOC, "run").orderBy("seq")
    ahead = F.collect_list("words").over(within.rowsBetween(0, min_words - 1))
    behind = F.reverse(F.collect_list("words").over(within.rowsBetween(-(min_words - 1), 0)))
    sized = active.select(*DOC, "seq", ahead.alias("ahead"), behind.alias("behind"))
    sized = sized.select(*DOC, "seq", F.explode_outer(F.array(F.struct(F.lit(1).alias("way"), F.col("ahead").alias("w")), F.struct(F.lit(-1).alias("way"), F.col("behind").alias("w")))).alias("g"))
    sized = sized.select(*DOC, "seq", "g.way", F.explode_outer(F.array(_shortest(F.col("g.w"), min_words))).alias("n")).where("n is not null")
    grams = cut(sized.select(*DOC, F.when(F.col("way") == 1, F.col("seq")).otherwise(F.col("seq") - F.col("n") + 1).alias("start"), "n").distinct())
    longest = grams.agg(F.max("n")).first()[0] or 1
    levels = 1
    while 1 << levels <= longest:  # at most log2(min_words) rounds
        k, half = levels, 1 << (levels - 1)
        pairs = active.withColumn("a", F.col(f"rank_{k - 1}")).withColumn("b", F.lead(f"rank_{k - 1}", half).over(within))
        full = pairs.where("a is not null and b is not null")
        active = cut(pairs.join(_ranked(full, ["a", "b"], f"rank_{k}"), ["a", "b"], "left").drop("a", "b"))
        levels += 1
    ranks = active.select(*DOC, "seq", F.array(*[f"rank_{k}" for k in range(levels)]).alias("ranks"))
    level = F.floor(F.log2(F.col("n") + 0.5)).cast("int")
    sought = grams.withColumn("level", level).withColumn("last", F.col("start") + F.col("n") - F.pow(F.lit(2), F.col("level")).cast("int"))
    ends = sought.select(*DOC, "start", "n", "level", F.explode(F.array(F.struct(F.lit(0).alias("end"), F.col("start").alias("at")), F.struct(F.lit(1).alias("end"), F.col("last").alias("at")))).alias("e"))
    ends = ends.select(*DOC, "start", "n", "level", "e.end", "e.at").alias("x")
    named = ends.join(ranks.alias("r"), _match(ends, ranks, F.col("x.at") == F.col("r.seq"))).select("x.*", F.get("r.ranks", F.col("x.level")).alias("rank")).where("rank is not null")
    named = named.groupBy(*DOC, "start", "n").agg(F.max(F.when(F.col("end") == 0, F.col("rank"))).alias("a"), F.max(F.when(F.col("end") == 1, F.col("rank"))).alias("b")).where("a is not null and b is not null")
    named = cut(named.withColumn("place", F.struct(*DOC, "start")))
    first = named.groupBy("n", "a", "b").agg(F.min("place").alias("first"), F.count("*").alias("members")).where("members > 1")
    later = named.join(first, ["n", "a", "b"]).where("place > first")
    gone = later.select(*DOC, F.explode(F.expr("sequence(start, start + n - 1)")).alias("seq")).distinct().alias("g")
    gone = gone.join(active.alias("l"), _match(gone, active, F.col("g.seq") == F.col("l.seq"))).select("g.doc_id", "g.text_key", "l.line_no")
    return gone.groupBy(*DOC).agg(F.array_sort(F.collect_set("line_no")).alias("line_nos"))


def line_dedup(docs: DataFrame, *, min_words: int = 50, counts: tuple[str, str] = ("n_lines", "n_removed")) -> DataFrame:
    """All columns of ``docs`` with ``text`` freed of later copies, and the two named by ``counts``: lines before and lines removed (columns of these names are replaced).

    A line goes if it lies in a run of lines, blank ones aside, of ``min_words`` words or more whose exact lines stand earlier:
    in a document of smaller ``doc_id`` (null first; then the smaller hash of the text), or further up in the same one.
    Order and the other lines stay; lines are what LF separates.

    * null text: stays null, no lines; empty text: one blank line, nothing removed;
    * repeated rows (same id and text) are one document, and each comes back with the same result;
    * an empty table gives an empty result; further columns come back as they are, whatever their names.
    """
    rows = docs.drop(*counts)
    n_lines, n_removed = counts
    gone_id, gone_key, numbers, key, lines = apart(rows, "gone_id", "gone_key", "line_nos", "key", "lines")
    gone = repeated_lines(docs, min_words=min_words).select(F.col("doc_id").alias(gone_id), F.col("text_key").alias(gone_key), F.col("line_nos").alias(numbers))
    text = F.col("text").cast("string")
    rows = rows.withColumn(key, F.xxhash64(text))
    joined = rows.join(gone, rows["doc_id"].eqNullSafe(gone[gone_id]) & (rows[key] == gone[gone_key]), "left")
    joined = joined.withColumn(lines, F.split(text, "\n", -1))
    joined = joined.withColumn(n_lines, F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long")).withColumn(n_removed, F.coalesce(F.size(numbers), F.lit(0)).cast("long"))
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(numbers))
    shorter = F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n")
    return joined.withColumn("text", F.when(F.col(numbers).isNull(), F.col("text")).otherwise(shorter)).drop(gone_id, gone_key, key, lines, numbers)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole ``documents``, runs from 50 words on."""
    found = line_dedup(table(spark, sf_dir, "documents"), min_words=50)
    return found.select("doc_id", "n_lines", "n_removed", "text")


OP2_SQL = r"""
WITH l0 AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
l1 AS (SELECT doc_id, unnest(range(0, len(ls))) AS line_no, unnest(ls) AS line FROM l0),
l2 AS (SELECT doc_id, line_no, line, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS seq,
              len(regexp_extract_all(line, '[^ \t\n\x0B\f\r]+')) AS w
       FROM l1 WHERE regexp_matches(line, '[^ \t\n\x0B\f\r]')),
l3 AS (SELECT *, sum(w) OVER (PARTITION BY doc_id ORDER BY seq) AS c FROM l2),
runs AS (
  SELECT p.doc_id, p.seq AS a, q.seq AS z
  FROM l3 p JOIN l3 q ON p.doc_id = q.doc_id AND q.seq >= p.seq AND q.seq < p.seq + 50
  WHERE q.c - p.c + p.w >= 50 AND (q.c - q.w - p.c + p.w < 50 OR q.c - p.c < 50)),
grams AS (
  SELECT r.doc_id, r.a, r.z, md5(string_agg(l.line, chr(10) ORDER BY l.seq)) AS g
  FROM runs r JOIN l3 l ON l.doc_id = r.doc_id AND l.seq BETWEEN r.a AND r.z GROUP BY 1, 2, 3),
firsts AS (SELECT g, z - a AS n, min(struct_pack(doc_id := doc_id, a := a)) AS f FROM grams GROUP BY 1, 2),
late AS (SELECT doc_id, a, z FROM grams JOIN firsts ON grams.g = firsts.g AND z - a = n WHERE struct_pack(doc_id := doc_id, a := a) > f),
gone AS (SELECT DISTINCT l3.doc_id, l3.line_no FROM late JOIN l3 ON l3.doc_id = late.doc_id AND l3.seq BETWEEN late.a AND late.z),
kept AS (
  SELECT l1.doc_id, count(*) AS n_lines, count(gone.line_no) AS n_removed,
         coalesce(string_agg(CASE WHEN gone.line_no IS NULL THEN line END, chr(10) ORDER BY l1.line_no), '') AS text
  FROM l1 LEFT JOIN gone ON gone.doc_id = l1.doc_id AND gone.line_no = l1.line_no GROUP BY 1)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, CASE WHEN d.text IS NOT NULL THEN kept.text END AS text
FROM documents d LEFT JOIN kept ON kept.doc_id = d.doc_id
"""
