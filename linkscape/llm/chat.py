"""Chat formatting by quotation linking, in DataFrame operations alone.

A line's quote level is the number of ``>`` before its text, and a passage is a run of lines of one level.  A passage is normalised (lower
case, words alone, so that wrapping doesn't matter) and hashed: every SHINGLE consecutive words, and each line of fewer words, are a key.
A key leads to the latest earlier message of the conversation that has it in its own words (level 0), and a passage links to the message that most of
its keys lead to, the later one in a tie, if these are at least half of them.  All levels are linked, each to its own origin.
What a message answers is where most keys of its shallowest linked level lead; one without a linked passage answers the turn before it.
Linked passages and the lines that announce them are dropped from the text; what quotes something else (a prompt ``>>>``, a quotation from outside) stays.  A conversation becomes a tree of answers: each message has
the first message of its thread and its depth below it, found by pointer doubling.

Patterns don't backtrack and need no stack: a line is read once however many marks or spaces it holds.

Keys are led to their origins by one ordered pass over (conversation, key) rather than by pairing quotes with messages, so that a common
passage in a long conversation costs its own rows only; conversations without a quote have no keys made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from linkscape.llm.common import cut, table

MARKS, QUOTED = r"^[ \t>]*+", r"^[ \t]*+>"
ANNOUNCES = r"(?i)^\s*(on\b.*\bwrote|.*\bschrieb|.*a écrit|.*escribió)\s*:\s*$"
SHINGLE = 4
#: A line that announces a quote has at most so many characters.
ANNOUNCEMENT = 300
WHITE = " \t\n\r\f\v"


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _level(line: Column) -> Column:
    marks = F.regexp_extract(line, MARKS, 0)
    return F.length(marks) - F.length(F.replace(marks, F.lit(">"), F.lit("")))


def _quoted(line: Column) -> Column:
    return line.rlike(QUOTED)


def _announces(line: Column) -> Column:
    return (F.length(line) <= ANNOUNCEMENT) & line.rlike(ANNOUNCES)


def _words(line: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.substr(line, F.length(F.regexp_extract(line, MARKS, 0)) + 1)), F.lit(r"(\S+)"), F.lit(1))


def _keyed(df: DataFrame, *keep: str) -> DataFrame:
    """``keep`` and one row for each distinct key ``h1, h2`` of ``lines`` (a list of lists of words), with their number ``n_keys``; rows without words go."""
    words = df.select(*keep, "lines", F.explode_outer(F.array(F.flatten("lines"))).alias("words"))
    pair = lambda *x: F.struct(F.xxhash64(*x, F.lit(1)).alias("h1"), F.xxhash64(*x, F.lit(2)).alias("h2"))
    size = F.size("words")
    starts = F.when(size >= SHINGLE, F.sequence(F.lit(0), size - SHINGLE)).otherwise(F.array().cast("array<int>"))
    shingles = F.transform(starts, lambda i: pair(*[F.get("words", i + j) for j in range(SHINGLE)]))
    short = F.transform(F.filter("lines", lambda x: (F.size(x) > 0) & (F.size(x) < SHINGLE)), lambda x: pair(F.array_join(x, " "), F.lit("line")))
    keys = words.select(*keep, F.explode_outer(F.array(F.array_distinct(F.concat(shingles, short)))).alias("keys"))
    return keys.select(*keep, F.size("keys").alias("n_keys"), F.explode_outer("keys").alias("k")).where("k is not null").select(*keep, "n_keys", "k.h1", "k.h2")


def _lined(quoting: DataFrame) -> DataFrame:
    """``conv_id, turn, text_key, no, line, level, run``: the lines of messages ``conv_id, turn, text``; runs are of one level."""
    rows = quoting.withColumn("text_key", F.xxhash64("text")).select("conv_id", "turn", "text_key", F.posexplode_outer(_lines(F.col("text"))).alias("no", "line"))
    rows = rows.withColumn("level", _level(F.col("line")))
    message = W.partitionBy("conv_id", "turn", "text_key").orderBy("no")
    rows = rows.withColumn("starts", (F.col("level") != F.coalesce(F.lag("level").over(message), F.lit(-1))).cast("int"))
    return rows.withColumn("run", F.sum("starts").over(message)).drop("starts")


def _passages(quoting: DataFrame) -> DataFrame:
    """``conv_id, turn, passage, level, lines`` of messages ``conv_id, turn, text``; ``passage`` numbers those of one turn."""
    rows = _lined(quoting).where("level > 0").select("conv_id", "turn", "text_key", "no", "level", "run", _words(F.col("line")).alias("words"))
    found = rows.groupBy("conv_id", "turn", "text_key", "run", "level").agg(F.array_sort(F.collect_list(F.struct("no", "words"))).alias("x"))
    return found.select("conv_id", "turn", F.struct("text_key", "run").alias("passage"), "level", F.col("x.words").alias("lines"))


def _stated(messages: DataFrame) -> DataFrame:
    """Distinct messages that have all of conversation, turn and text."""
    return messages.where("conv_id is not null and turn is not null and text is not null").select("conv_id", "turn", F.col("text").cast("string").alias("text")).distinct()


def _quoting(messages: DataFrame) -> DataFrame:
    return messages.where(F.exists(_lines(F.col("text")), _quoted))


def own_texts(messages: DataFrame, links: DataFrame) -> DataFrame:
    """``conv_id, turn, text_key, own``: the texts of messages with linked passages without these and without the announcement before one (blank lines may be between)."""
    linked = links.select("conv_id", "turn", "passage.text_key", "passage.run").distinct().withColumn("linked", F.lit(True))
    rows = _lined(_stated(messages).withColumn("text_key", F.xxhash64("text")).join(linked.select("conv_id", "turn", "text_key").distinct(), ["conv_id", "turn", "text_key"], "left_semi"))
    rows = rows.join(linked, ["conv_id", "turn", "text_key", "run"], "left").withColumn("linked", F.coalesce("linked", F.lit(False)))
    after = W.partitionBy("conv_id", "turn", "text_key").orderBy(F.desc("no")).rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("next", F.last(F.when(F.length(F.trim(F.col("line"), F.lit(WHITE))) > 0, F.col("linked")), ignorenulls=True).over(after))
    kept = ~F.col("linked") & ~(F.coalesce("next", F.lit(False)) & (F.col("level") == 0) & _announces(F.col("line")))
    lines = F.array_sort(F.collect_list(F.when(kept, F.struct("no", "line"))))  # nulls are left out
    return rows.groupBy("conv_id", "turn", "text_key").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("own"))


def passage_links(messages: DataFrame) -> DataFrame:
    """``conv_id, turn, passage, level, origin, votes`` of the passages that link to an earlier message of their conversation."""
    rows = _stated(messages)
    quoting = cut(_quoting(rows))
    talks = rows.join(quoting.select("conv_id").distinct(), "conv_id", "left_semi")
    own_lines = F.filter(_lines(F.col("text")), lambda x: ~_quoted(x) & ~_announces(x))
    own = _keyed(talks.select("conv_id", "turn", F.transform(own_lines, _words).alias("lines")), "conv_id", "turn")
    quoted = _keyed(_passages(quoting), "conv_id", "turn", "passage", "level")
    nobody = F.lit(None).cast("struct<passage: struct<text_key: long, run: long>, level: int, n_keys: int>")
    events = own.select("conv_id", "turn", "h1", "h2", F.lit(True).alias("own"), nobody.alias("by")).unionByName(quoted.select("conv_id", "turn", "h1", "h2", F.lit(False).alias("own"), F.struct("passage", "level", "n_keys").alias("by")))
    events = events.groupBy("conv_id", "h1", "h2", "turn").agg(F.max(F.when(F.col("own"), F.col("turn"))).alias("own"), F.collect_list("by").alias("by"))
    before = W.partitionBy("conv_id", "h1", "h2").orderBy("turn").rowsBetween(W.unboundedPreceding, -1)
    led = events.withColumn("origin", F.max("own").over(before)).where("origin is not null and size(by) > 0")
    votes = led.select("conv_id", "turn", "origin", F.explode("by").alias("by")).groupBy("conv_id", "turn", "by", "origin").agg(F.count("*").alias("votes"))
    best = votes.groupBy("conv_id", "turn", "by").agg(F.max(F.struct("votes", "origin")).alias("best"))
    return best.where("best.votes * 2 >= by.n_keys").select("conv_id", "turn", "by.passage", "by.level", "best.origin", "best.votes")


def reply_links(links: DataFrame) -> DataFrame:
    """``conv_id, turn, parent_turn, n_linked`` for messages with a linked passage, from ``passage_links``."""
    votes = links.groupBy("conv_id", "turn", "level", "origin").agg(F.sum("votes").alias("votes"), F.count("*").alias("n"))
    best = F.max(F.struct((-F.col("level")).alias("shallow"), "votes", "origin"))
    return votes.groupBy("conv_id", "turn").agg(best.alias("best"), F.sum("n").alias("n_linked")).select("conv_id", "turn", F.col("best.origin").alias("parent_turn"), "n_linked")


def threads(answers: DataFrame) -> DataFrame:
    """``conv_id, turn, parent_turn, n_linked, thread_turn, depth`` from ``conv_id, turn, previous, parent_turn, n_linked``: the turn without a parent above each, and how many answers lie between.

    A run of turns that each answer the one before is counted by one ordered pass.  Only the heads of runs that answer something else have pointers,
    and each round doubles how far these reach, so that n of them take log2(n) rounds.
    """
    turns = W.partitionBy("conv_id").orderBy("turn")
    sofar = turns.rowsBetween(W.unboundedPreceding, 0)
    rows = answers.withColumn("heads", F.col("parent_turn").isNull() | ~F.col("parent_turn").eqNullSafe(F.col("previous"))).withColumn("nth", F.row_number().over(turns))
    rows = rows.withColumn("head", F.max(F.when(F.col("heads"), F.col("turn"))).over(sofar)).withColumn("offset", F.col("nth") - F.max(F.when(F.col("heads"), F.col("nth"))).over(sofar))
    rows = cut(rows.select("conv_id", "turn", "parent_turn", "n_linked", "heads", "head", "offset"))
    pointing = rows.where("heads and parent_turn is not null").select("conv_id", F.col("turn").alias("from"), F.col("parent_turn").alias("turn"))
    now = cut(pointing.join(rows.select("conv_id", "turn", F.col("head").alias("top"), F.col("offset").alias("steps")), ["conv_id", "turn"]).select("conv_id", "from", "top", (F.col("steps") + 1).cast("long").alias("steps")))
    moved = not now.isEmpty()
    while moved:
        above = now.select("conv_id", F.col("from").alias("top"), F.col("top").alias("next"), F.col("steps").alias("more"))
        now = cut(now.join(above, ["conv_id", "top"], "left").select("conv_id", "from", F.coalesce("next", "top").alias("top"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), F.col("next").isNotNull().alias("moved")))
        moved = not now.where("moved").isEmpty()
        now = now.drop("moved")
    joined = rows.join(now.withColumnRenamed("from", "head"), ["conv_id", "head"], "left")
    return joined.select("conv_id", "turn", "parent_turn", "n_linked", F.coalesce("top", "head").alias("thread_turn"), (F.col("offset") + F.coalesce("steps", F.lit(0))).cast("long").alias("depth"))


def chat_format(messages: DataFrame) -> DataFrame:
    """One row for each input row: ``conv_id, turn, role, parent_turn, thread_turn, depth, n_quoted, n_linked, deepest, text, formatted``.

    Ordered by ``conv_id, thread_turn, depth, parent_turn, turn`` every message follows the one it answers, answers to one message
    stand together, and threads follow each other.  ``n_quoted`` counts quoted lines, ``n_linked`` linked passages.
    ``text`` lacks linked passages and their announcements, and trailing white space; passages without an origin stay. ``formatted`` puts the role before it.

    * null text: treated as empty; null role: ``user``; other roles stay as they are, lower case;
    * null ``conv_id`` or ``turn``: formatted, but answers nothing and is answered by nothing (null thread and depth);
    * repeated rows come back each and count once; several messages of one turn share what they answer, and cannot answer each other;
    * an empty table gives an empty result; further columns are ignored.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = messages.select("conv_id", "turn", F.lower(F.coalesce(F.col("role").cast("string"), F.lit("user"))).alias("role"), text.alias("text"))
    turns = messages.where("conv_id is not null and turn is not null").select("conv_id", "turn").distinct()
    turns = turns.withColumn("previous", F.lag("turn").over(W.partitionBy("conv_id").orderBy("turn")))
    links = cut(passage_links(messages))
    answers = turns.join(reply_links(links), ["conv_id", "turn"], "left").select("conv_id", "turn", "previous", F.coalesce("parent_turn", "previous").alias("parent_turn"), F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"))
    answers = threads(answers).withColumnsRenamed({"conv_id": "a_conv", "turn": "a_turn"})
    joined = rows.join(answers, (rows["conv_id"] == answers["a_conv"]) & (rows["turn"] == answers["a_turn"]), "left")
    own = own_texts(messages, links).withColumnsRenamed({"conv_id": "o_conv", "turn": "o_turn"})
    joined = joined.join(own, (rows["conv_id"] == own["o_conv"]) & (rows["turn"] == own["o_turn"]) & (F.xxhash64(rows["text"]) == own["text_key"]), "left")
    lines = _lines(F.col("text"))
    clean = F.rtrim(F.coalesce("own", "text"), F.lit(WHITE))
    return joined.select(
        "conv_id", "turn", "role", "parent_turn", "thread_turn", "depth",
        F.size(F.filter(lines, _quoted)).cast("long").alias("n_quoted"), F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
        F.array_max(F.transform(lines, _level)).cast("long").alias("deepest"), clean.alias("text"),
    ).withColumn("formatted", F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n"), F.col("text"), F.lit("\n")))


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole ``conversations``."""
    return chat_format(table(spark, sf_dir, "conversations"))


OP4_SQL = r"""
WITH RECURSIVE m AS (SELECT conv_id, turn, lower(coalesce(role, 'user')) AS role, coalesce(text, '') AS text FROM conversations),
l AS (SELECT conv_id, turn, text, unnest(range(len(string_split(text, chr(10))))) AS no, unnest(string_split(text, chr(10))) AS line FROM (SELECT DISTINCT conv_id, turn, text FROM m)),
n AS (
  SELECT conv_id, turn, text, no, line, len(regexp_replace(regexp_extract(line, '^[ \t>]*'), '[^>]', '', 'g')) AS level,
         regexp_extract_all(lower(regexp_replace(line, '^[ \t>]*', '')), '\S+') AS w,
         len(line) <= 300 AND regexp_matches(line, '(?i)^\s*(on\b.*\bwrote|.*\bschrieb|.*a écrit|.*escribió)\s*:\s*$') AS announces
  FROM l),
u AS (
  SELECT conv_id, turn, text, level, run, list(w ORDER BY no) AS ls
  FROM (SELECT *, CASE WHEN level > 0 THEN no - row_number() OVER (PARTITION BY conv_id, turn, text, level ORDER BY no) ELSE 0 END AS run FROM n WHERE level > 0 OR NOT announces)
  GROUP BY ALL),
f AS (SELECT *, flatten(ls) AS w FROM u),
g AS (
  SELECT *, list_distinct(list_concat(
      list_transform(range(1, greatest(len(w) - 2, 1)), lambda i: array_to_string(w[i:i + 3], ' ')),
      list_transform(list_filter(ls, lambda x: len(x) > 0 AND len(x) < 4), lambda x: '> ' || array_to_string(x, ' ')))) AS ks
  FROM f),
k AS (SELECT conv_id, turn, text, level, run, len(ks) AS n_keys, unnest(ks) AS k FROM g),
own AS (SELECT DISTINCT conv_id, turn, k FROM k WHERE level = 0),
led AS (
  SELECT q.conv_id, q.turn, q.text, q.run, q.level, q.n_keys, q.k, max(own.turn) AS origin
  FROM k q JOIN own ON own.conv_id = q.conv_id AND own.k = q.k AND own.turn < q.turn WHERE q.level > 0 GROUP BY ALL),
votes AS (SELECT conv_id, turn, text, run, level, n_keys, origin, count(*) AS votes FROM led GROUP BY ALL),
linked AS (SELECT * FROM votes QUALIFY row_number() OVER (PARTITION BY conv_id, turn, text, run, level ORDER BY votes DESC, origin DESC) = 1 AND 2 * votes >= n_keys),
per AS (SELECT conv_id, turn, level, origin, sum(votes) AS votes, count(*) AS n FROM linked GROUP BY ALL),
links AS (SELECT conv_id, turn, origin AS parent_turn, sum(n) OVER (PARTITION BY conv_id, turn) AS n_linked FROM per QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY level, votes DESC, origin DESC) = 1),
turns AS (SELECT conv_id, turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS previous FROM (SELECT DISTINCT conv_id, turn FROM m WHERE conv_id IS NOT NULL AND turn IS NOT NULL)),
a AS (SELECT t.conv_id, t.turn, coalesce(links.parent_turn, t.previous) AS parent_turn, coalesce(links.n_linked, 0) AS n_linked FROM turns t LEFT JOIN links USING (conv_id, turn)),
tree AS (
  SELECT conv_id, turn, parent_turn, n_linked, turn AS thread_turn, CAST(0 AS BIGINT) AS depth FROM a WHERE parent_turn IS NULL
  UNION ALL SELECT a.conv_id, a.turn, a.parent_turn, a.n_linked, tree.thread_turn, tree.depth + 1 FROM tree JOIN a ON a.conv_id = tree.conv_id AND a.parent_turn = tree.turn),
d AS (
  SELECT conv_id, turn, role, ls, len(list_filter(ls, lambda x: regexp_matches(x, '^[ \t]*>'))) AS n_quoted,
         list_max(list_transform(ls, lambda x: len(regexp_replace(regexp_extract(x, '^[ \t>]*'), '[^>]', '', 'g')))) AS deepest, text
  FROM (SELECT m.*, string_split(m.text, chr(10)) AS ls FROM m)),
h AS (
  SELECT n.conv_id, n.turn, n.text, n.no, n.line, n.level, n.announces, linked.run IS NOT NULL AS linked
  FROM (SELECT *, CASE WHEN level > 0 THEN no - row_number() OVER (PARTITION BY conv_id, turn, text, level ORDER BY no) END AS run FROM n) n
  LEFT JOIN linked ON linked.conv_id = n.conv_id AND linked.turn = n.turn AND linked.text = n.text AND linked.level = n.level AND linked.run = n.run),
x AS (SELECT *, first_value(CASE WHEN regexp_matches(line, '\S') THEN linked END IGNORE NULLS) OVER (PARTITION BY conv_id, turn, text ORDER BY no ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next FROM h),
y AS (SELECT conv_id, turn, text, coalesce(string_agg(line, chr(10) ORDER BY no) FILTER (NOT linked AND NOT (coalesce(next, false) AND level = 0 AND announces)), '') AS kept FROM x GROUP BY ALL),
c AS (SELECT d.*, rtrim(coalesce(y.kept, d.text), ' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11)) AS own FROM d LEFT JOIN y ON y.conv_id = d.conv_id AND y.turn = d.turn AND y.text = d.text)
SELECT c.conv_id, c.turn, c.role, tree.parent_turn, tree.thread_turn, tree.depth, c.n_quoted, CAST(coalesce(tree.n_linked, 0) AS BIGINT) AS n_linked, c.deepest, c.own AS text, '<|' || c.role || '|>' || chr(10) || c.own || chr(10) AS formatted
FROM c LEFT JOIN tree ON tree.conv_id = c.conv_id AND tree.turn = c.turn
"""
