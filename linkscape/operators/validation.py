"""Checks and profiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkscape.landscape import Landscape
from linkscape.storage import local_frame


#: Where a row was read, in tables that say so: ``struct(file, block, id)``, rising from row to row of a file; null where it is no file.
PLACE = "_place"


def _place(df: DataFrame) -> list[str]:
    return [PLACE] if PLACE in df.columns else []


def _violations(df: DataFrame, table: str, key: str, rule: str) -> DataFrame:
    return df.select(F.lit(table).alias("table"), F.col(key).cast("string").alias("key"), F.lit(rule).alias("rule"), *_place(df))


def _all(found: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), found)


def domain_violations(land: Landscape) -> DataFrame:
    """``table, key, rule`` for each value out of its range; a null counts as out of range."""
    checks = [
        ("options", "option_id", "cost >= 0"),
        ("vertices", "vertex_id", "source_quality >= 0"),
        ("vertices", "vertex_id", "target_quality >= 0"),
        ("arcs", "arc_id", "probability between 0 and 1"),
        ("vertex_improvements", "vertex_id", "source_gain >= 0"),
        ("vertex_improvements", "vertex_id", "target_gain >= 0"),
        ("arc_improvements", "arc_id", "improved_probability between 0 and 1"),
    ]
    found = []
    for table in dict.fromkeys(t for t, _, _ in checks):
        own = [(k, r) for t, k, r in checks if t == table]
        rules = F.array(*[F.when(~F.coalesce(F.expr(r), F.lit(False)), F.lit(r)) for _, r in own])
        df = getattr(land, table)
        found.append(df.select(F.lit(table).alias("table"), F.col(own[0][0]).cast("string").alias("key"), F.explode(F.array_compact(rules)).alias("rule"), *_place(df)))
    return _all(found)


def reference_violations(land: Landscape) -> DataFrame:
    """Names that no row defines: of vertices, arcs and options, and of cases in the criterion."""
    vertices, arcs, options = land.vertices.select("case_id", "vertex_id"), land.arcs.select("case_id", "arc_id"), land.options.select("option_id")
    found = [
        _violations(land.vertex_improvements.join(vertices, ["case_id", "vertex_id"], "left_anti"), "vertex_improvements", "vertex_id", "unknown vertex"),
        _violations(land.arc_improvements.join(arcs, ["case_id", "arc_id"], "left_anti"), "arc_improvements", "arc_id", "unknown arc"),
        _violations(land.vertex_improvements.join(options, "option_id", "left_anti"), "vertex_improvements", "option_id", "unknown option"),
        _violations(land.arc_improvements.join(options, "option_id", "left_anti"), "arc_improvements", "option_id", "unknown option"),
    ]
    for end in ("src", "dst"):
        lost = land.arcs.join(vertices.withColumnRenamed("vertex_id", end), ["case_id", end], "left_anti")
        found.append(_violations(lost, "arcs", end, "unknown vertex"))
    if land.criterion is not None and land.criterion.cases():
        named = local_frame(land.vertices.sparkSession, {"case_id": sorted(land.criterion.cases())}, "case_id string")
        found.append(_violations(named.join(land.vertices, "case_id", "left_anti"), "criterion", "case_id", "unknown case"))
    return _all(found)


def duplicate_keys(land: Landscape) -> DataFrame:
    """Ids that occur more than once."""
    found = []
    for table, keys in (("options", ["option_id"]), ("vertices", ["case_id", "vertex_id"]), ("arcs", ["case_id", "arc_id"])):
        df = getattr(land, table)
        twice = df.groupBy(*keys).agg(F.count("*").alias("n"), *[F.max(c).alias(c) for c in _place(df)]).where("n > 1")
        found.append(_violations(twice, table, keys[-1], "duplicate"))
    return _all(found)


def violations(land: Landscape) -> DataFrame:
    """All of the above; with ``PLACE`` where the tables have it, of repeated ids the last row's."""
    return _all([domain_violations(land), reference_violations(land), duplicate_keys(land)])


def checked(land: Landscape) -> Landscape:
    """``land``, or an error that names some of what is wrong, with file and row where the tables say where they were read."""
    wrong = violations(land).limit(20).collect()
    if wrong:
        raise ValueError("; ".join(f"{r['table']} {r['key']}: {r['rule']}{_where(land, r)}" for r in wrong))
    names = ("options", "vertices", "arcs", "vertex_improvements", "arc_improvements")
    return land.with_(**{n: getattr(land, n).drop(PLACE) for n in names})


def _where(land: Landscape, wrong) -> str:
    """The file of a violation and its row there, the one below the head being the first: one count of the rows before it."""
    place = wrong[PLACE] if PLACE in wrong else None
    if place is None:
        return ""
    own = F.col(PLACE)
    before = getattr(land, wrong["table"]).select(PLACE).distinct().where((own["file"] == place["file"]) & ((own["block"] < place["block"]) | ((own["block"] == place["block"]) & (own["id"] < place["id"])))).count()
    return f" ({place['file']}, row {before + 1})"


def profile(land: Landscape) -> DataFrame:
    """A row for each case: numbers of vertices, improvable vertices, habitat vertices, arcs, improvable arcs; and of options and cases."""
    v = land.vertices.groupBy("case_id").agg(F.count("*").alias("n_vertices"), F.count_if((F.col("source_quality") > 0) | (F.col("target_quality") > 0)).alias("n_habitat"))
    parts = [
        land.vertex_improvements.groupBy("case_id").agg(F.count_distinct("vertex_id").alias("n_improvable_vertices")),
        land.arcs.groupBy("case_id").agg(F.count("*").alias("n_arcs")),
        land.arc_improvements.groupBy("case_id").agg(F.count_distinct("arc_id").alias("n_improvable_arcs")),
    ]
    joined = reduce(lambda a, b: a.join(b, "case_id", "left"), parts, v)
    totals = land.options.agg(F.count("*").alias("n_options")).crossJoin(land.vertices.agg(F.count_distinct("case_id").alias("n_cases")))  # one row by one row
    return joined.join(F.broadcast(totals)).na.fill(0).select("case_id", "n_vertices", "n_improvable_vertices", "n_habitat", "n_arcs", "n_improvable_arcs", "n_options", "n_cases")


def budget_share(land: Landscape, budget: float) -> DataFrame:
    """The budget in percent of what all options cost; null if that is 0."""
    return land.options.agg(F.try_divide(F.lit(float(budget)) * 100, F.sum("cost")).alias("percent"))
