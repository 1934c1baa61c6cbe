"""Secret scans in DataFrame operations alone: fixed patterns, and sliding-window entropy of candidate strings.

Places come from splitting: the pieces between matches and the matches themselves, taken in
order, give every start as a running sum of lengths (code points), worked out by a window
over the few rows of texts that have a match.

Entropy is Shannon's over windows of ``ENTROPY_WINDOW`` characters.  It is kept incrementally: when a window
moves on, only the counts of the leaving and of the entering character change, so with S the
sum of c * log2(c) over the counts, S changes by two differences and the entropy is log2(W) - S / W.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkscape.llm.common import table

# Fixed values of the contract: kinds, patterns, the group that is measured, its least length.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"  # as AKIA[A-Z0-9]+ of 16 or more: a shorter run holds no longer match
HEX = r"[0-9a-f]{32,}"  # as [0-9a-f]+ of 32 or more: runs are maximal
#: Maximal runs with a digit; possessive, so that a long run is walked once.
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z+/_=-]*+[0-9][A-Za-z0-9+/_=-]*+"
KINDS = ("assign", "access", "hex", "entropy")
#: Window and least bits a character for the two character classes.
ENTROPY_WINDOW = 20
ENTROPY_BITS = {"hex": 3.0, "base64": 3.9}
#: Candidates that match one of these are no secrets: UUIDs, placeholders, counted-off alphabets, lower-case paths, numbers with dashes.
ALLOW = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"(?i)example|sample|placeholder|changeme|dummy|xxxx",
    r"(?i)0123456789|abcdefgh|qwerty",
    r"^[a-z0-9_-]*/[a-z0-9_/-]*$",
    r"^[0-9_=+/-]+$",
)


def _log_term(c: Column) -> Column:
    return F.when(c > 1, c * F.log2(c.cast("double"))).otherwise(F.lit(0.0))


def entropy_extent(chars: Column, bits: Column, window: int = ENTROPY_WINDOW) -> Column:
    """``struct(first, last, peak)`` over all windows of the list ``chars``: 1-based start of the first and end of the last window with at least ``bits`` bits a character (first 0 if none), and the highest entropy.

    Characters are those of candidates, ``+`` to ``z``.  Their counts are kept from one window to the next, five bits each, twelve to a number (``window`` is at most 31).
    """
    slots = ord("z") - ord("+") + 1
    one = F.lit(1).cast("long")

    def code(i: Column) -> Column:
        return F.ascii(F.element_at(chars, i)) - ord("+")

    def place(k: Column) -> Column:
        return F.floor(k / 12).cast("int")

    def unit(k: Column) -> Column:
        return F.call_function("shiftleft", one, k % 12 * 5)

    def held(counts: Column, k: Column) -> Column:
        return F.call_function("shiftright", F.get(counts, place(k)), k % 12 * 5).bitwiseAND(F.lit(31)).cast("int")

    def step(acc: Column, i: Column) -> Column:
        into, full = code(i), i > window
        gone = F.when(full, code(F.greatest(i - window, F.lit(1)))).otherwise(F.lit(-1))
        same = gone == into  # what leaves is what enters: counts stay
        less = F.when(full, held(acc["counts"], F.greatest(gone, F.lit(0)))).otherwise(F.lit(0))
        more = held(acc["counts"], into)
        moved = F.when(full, _log_term(less - 1) - _log_term(less)).otherwise(F.lit(0.0)) + _log_term(more + 1) - _log_term(more)
        total = acc["total"] + F.when(same, F.lit(0.0)).otherwise(moved)
        counts = F.transform(acc["counts"], lambda x, j: x + F.when(j == place(into), unit(into)).otherwise(F.lit(0)) - F.when(full & (j == place(gone)), unit(gone)).otherwise(F.lit(0)))
        here = F.when(i >= window, F.lit(math.log2(window)) - total / window).otherwise(F.lit(-1.0))
        over = here >= bits - 1e-9
        return F.struct(
            F.when(same, acc["counts"]).otherwise(counts).alias("counts"),
            total.alias("total"),
            F.when(over & (acc["first"] == 0), i - (window - 1)).otherwise(acc["first"]).alias("first"),
            F.when(over, i).otherwise(acc["last"]).alias("last"),
            F.greatest(acc["peak"], here).alias("peak"),
        )

    none = F.array_repeat(F.lit(0).cast("long"), -(-slots // 12))
    zero = F.struct(none.alias("counts"), F.lit(0.0).alias("total"), F.lit(0).alias("first"), F.lit(0).alias("last"), F.lit(-1.0).alias("peak"))
    return F.aggregate(F.sequence(F.lit(1), F.size(chars)), zero, step)


def secret_spans(docs: DataFrame, *, allow: tuple[str, ...] = ALLOW) -> DataFrame:
    """Spans of likely secrets: ``doc_id, text_key, kind_no, kind, start, end, found`` (code points, end exclusive).

    ``assign``, ``access`` and ``hex`` are the contract's patterns, leftmost and non-overlapping within a kind, never suppressed.
    ``entropy`` spans run from the first to the last window over the bits of its class in a run of 20 or more
    of ``[A-Za-z0-9+/_=-]`` with a letter and a digit that no ``allow`` pattern matches; they may lie over other kinds.
    Null and empty texts have none; repeated rows give theirs once (``text_key`` tells texts under one ``doc_id`` apart); further columns are ignored.
    """
    text = F.col("text")

    def located(pattern: str, gate: Column) -> Column:
        some = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"))
        return F.when(gate, some)

    has_long_run = text.rlike("[0-9]") & text.rlike("[A-Za-z0-9+/_=-]{20}")
    per_kind = F.array(
        located(ASSIGN, text.rlike(ASSIGN)),
        located(ACCESS, text.contains("AKIA")),
        located(HEX, text.rlike("[0-9a-f]{32}")),
        located(CANDIDATE, has_long_run),
    )
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).where(text.isNotNull())
    kinds = texts.select("doc_id", F.xxhash64("text").alias("text_key"), F.posexplode_outer(per_kind).alias("kind_no", "m")).where("size(m.found) > 0")
    pieces = kinds.select("doc_id", "text_key", "kind_no", F.posexplode_outer(F.arrays_zip(F.col("m.gaps").alias("gap"), F.col("m.found").alias("found"))).alias("piece", "p"))
    pieces = pieces.select("doc_id", "text_key", "kind_no", "piece", F.length("p.gap").alias("gap"), F.col("p.found").alias("found")).where("found is not null")
    pieces = pieces.dropDuplicates(["doc_id", "text_key", "kind_no", "piece"]).withColumn("size", F.length("found"))
    placed = pieces.withColumn("end", F.expr("sum(gap + size) over (partition by doc_id, text_key, kind_no order by piece)")).withColumn("start", F.col("end") - F.col("size"))
    # what is too short was matched, and is dropped now
    base = placed.where(F.when(F.col("kind_no") == 0, F.length(F.regexp_extract("found", ASSIGN, 2)) >= 8).otherwise(F.col("kind_no") < 3))
    candidates = placed.where((F.col("kind_no") == 3) & (F.col("size") >= ENTROPY_WINDOW) & F.col("found").rlike("[A-Za-z]"))
    for pattern in allow:
        candidates = candidates.where(~F.col("found").rlike(pattern))
    bits = F.when(F.col("found").rlike("^[0-9A-Fa-f]+$"), F.lit(ENTROPY_BITS["hex"])).otherwise(F.lit(ENTROPY_BITS["base64"]))
    measured = candidates.withColumn("bits", bits).withColumn("chars", F.regexp_extract_all("found", F.lit("(.)"), F.lit(1)))
    # one element exploded: a filter on a plain column would be worked out below it a second time
    measured = measured.select("doc_id", "text_key", "kind_no", "start", "found", F.explode_outer(F.array(entropy_extent(F.col("chars"), F.col("bits")))).alias("extent")).where("extent.first > 0")
    added = measured.select(
        "doc_id", "text_key", "kind_no", (F.col("start") + F.col("extent.first") - 1).alias("start"), (F.col("start") + F.col("extent.last")).alias("end"),
        F.substring("found", F.col("extent.first"), F.col("extent.last") - F.col("extent.first") + 1).alias("found"),
    )
    spans = base.select("doc_id", "text_key", "kind_no", "start", "end", "found").unionByName(added)
    return spans.select("doc_id", "text_key", "kind_no", F.element_at(F.array(*map(F.lit, KINDS)), F.col("kind_no") + 1).alias("kind"), "start", "end", "found")


def secret_scan(docs: DataFrame, *, allow: tuple[str, ...] = ALLOW) -> DataFrame:
    """One row for each input row: ``doc_id, spans`` as a list of ``struct(start, kind_no, kind, end)`` by start, then kind; empty where there is none."""
    found = secret_spans(docs, allow=allow).groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_list(F.struct("start", "kind_no", "kind", "end"))).alias("spans"))
    found = found.select(F.col("doc_id").alias("found_id"), F.col("text_key").alias("found_key"), "spans")
    rows = docs.select("doc_id", F.xxhash64(F.col("text").cast("string")).alias("text_key"))
    joined = rows.join(found, rows["doc_id"].eqNullSafe(found["found_id"]) & (rows["text_key"] == found["found_key"]), "left")
    return joined.select("doc_id", F.coalesce("spans", F.array().cast(found.schema["spans"].dataType)).alias("spans"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole ``documents`` table; counts, digest of the fixed kinds, and all spans."""
    found = secret_scan(table(spark, sf_dir, "documents"))

    def listed(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def number(k: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind_no"] == k)).cast("long")

    return found.select(
        "doc_id", number(0).alias("n_assign"), number(1).alias("n_access"), number(2).alias("n_hex"),
        F.sha2(listed(F.filter("spans", lambda s: s["kind_no"] < 3)), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), number(3).alias("n_entropy"),
    )


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


def _oracle() -> str:
    """The same in DuckDB: every window's characters counted anew.  Its patterns know no look-behind, so runs without a digit are placed, too, and then left."""
    names = "|".join(map(_either_case, ("password", "passwd", "secret", "token", "api_?key")))
    assign = re.sub(r"\(\?i:[^)]*\)", lambda _: names, ASSIGN, count=1).replace("'", "''")
    patterns = (assign, ACCESS, HEX, "[A-Za-z0-9+/_=-]+")
    split = " UNION ALL ".join(f"SELECT doc_id, {k} AS kind_no, unnest(str_split_regex(text, '{p}')) AS gap, unnest(regexp_extract_all(text, '{p}')) AS found, unnest(range(1, len(regexp_extract_all(text, '{p}')) + 2)) AS piece FROM d" for k, p in enumerate(patterns))
    allowed = " OR ".join(f"regexp_matches(found, '{p}')" for p in ALLOW)
    kinds = "[" + ", ".join(f"'{k}'" for k in KINDS) + "]"
    w = ENTROPY_WINDOW
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
pieces AS (SELECT * FROM ({split}) WHERE found IS NOT NULL),
placed AS (SELECT *, stop - length(found) AS start FROM (SELECT *, sum(length(gap) + length(found)) OVER (PARTITION BY doc_id, kind_no ORDER BY piece) AS stop FROM pieces)),
candidates AS (
  SELECT *, row_number() OVER () AS id, CASE WHEN regexp_full_match(found, '[0-9A-Fa-f]+') THEN {ENTROPY_BITS["hex"]} ELSE {ENTROPY_BITS["base64"]} END AS bits
  FROM placed WHERE kind_no = 3 AND length(found) >= {w} AND regexp_matches(found, '[0-9]') AND regexp_matches(found, '[A-Za-z]') AND NOT ({allowed})),
windows AS (SELECT id, i, unnest(string_split(substr(found, i, {w}), '')) AS c FROM (SELECT id, found, unnest(range(1, length(found) - {w} + 2)) AS i FROM candidates)),
measured AS (SELECT id, i, log2({w}) - sum(n * log2(n)) / {w} AS h FROM (SELECT id, i, c, count(*) AS n FROM windows GROUP BY ALL) GROUP BY ALL),
spans AS (
  SELECT doc_id, kind_no, start, stop FROM placed
  WHERE CASE WHEN kind_no = 0 THEN length(regexp_extract(found, '{assign}', 2)) >= 8 ELSE kind_no < 3 END
  UNION ALL
  SELECT doc_id, 3, start + min(i) - 1, start + max(i) + {w} - 1 FROM candidates JOIN measured USING (id) WHERE h >= bits - 1e-9 GROUP BY id, doc_id, start),
named AS (SELECT *, {kinds}[kind_no + 1] || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT) AS span FROM spans),
found AS (
  SELECT doc_id, count(*) FILTER (kind_no = 0) AS n_assign, count(*) FILTER (kind_no = 1) AS n_access, count(*) FILTER (kind_no = 2) AS n_hex, count(*) FILTER (kind_no = 3) AS n_entropy,
    string_agg(span, ',' ORDER BY start, kind_no) FILTER (kind_no < 3) AS base, string_agg(span, ',' ORDER BY start, kind_no) AS spans
  FROM named GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_entropy, 0) AS n_entropy
FROM d LEFT JOIN found USING (doc_id)
"""


OP6_SQL = _oracle()
