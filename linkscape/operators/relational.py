"""Filters, joins and unions on landscapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkscape.landscape import Landscape


def affordable(land: Landscape, budget: float) -> Landscape:
    """Options that cost no more than the budget, and their improvements."""
    options = land.options.where(F.col("cost") <= budget)
    return land.with_(
        options=options,
        vertex_improvements=land.vertex_improvements.join(options, "option_id", "left_semi").select(land.vertex_improvements.columns),
        arc_improvements=land.arc_improvements.join(options, "option_id", "left_semi").select(land.arc_improvements.columns),
    )


def sources(vertices: DataFrame) -> DataFrame:
    """Vertices from which paths count."""
    return vertices.where("source_quality > 0")


def vertices_by_option(land: Landscape) -> DataFrame:
    """Vertex improvements summed for each case, option and vertex."""
    return land.vertex_improvements.groupBy("case_id", "option_id", "vertex_id").agg(F.sum("source_gain").alias("source_gain"), F.sum("target_gain").alias("target_gain"))


def arcs_by_option(land: Landscape) -> DataFrame:
    """Arc improvements, the best for each case, option and arc, with the arc's ends and own probability."""
    best = land.arc_improvements.groupBy("case_id", "option_id", "arc_id").agg(F.max("improved_probability").alias("improved_probability"))
    return best.join(land.arcs, ["case_id", "arc_id"]).select("case_id", "option_id", "arc_id", "src", "dst", "probability", "improved_probability")


def chosen(selection: DataFrame) -> DataFrame:
    """Options with a value other than 0; ``scenario_id`` is kept if there is one."""
    keep = ["scenario_id"] if "scenario_id" in selection.columns else []
    return selection.where("value <> 0").select(*keep, "option_id").distinct()


def improved_vertices(land: Landscape, selection: DataFrame) -> DataFrame:
    """Qualities plus all gains of the chosen options."""
    gains = land.vertex_improvements.join(chosen(selection), "option_id").groupBy("case_id", "vertex_id").agg(F.sum("source_gain").alias("a"), F.sum("target_gain").alias("b"))
    joined = land.vertices.join(gains, ["case_id", "vertex_id"], "left")
    return joined.select("case_id", "vertex_id", (F.col("source_quality") + F.coalesce("a", F.lit(0.0))).alias("source_quality"), (F.col("target_quality") + F.coalesce("b", F.lit(0.0))).alias("target_quality"))


def _raised(arcs: DataFrame, improvements: DataFrame) -> DataFrame:
    best = improvements.groupBy("case_id", "arc_id").agg(F.max("improved_probability").alias("q"))
    return arcs.join(best, ["case_id", "arc_id"], "left").select("case_id", "arc_id", "src", "dst", F.greatest("probability", F.coalesce("q", "probability")).alias("probability"))


def improved_arcs(land: Landscape, selection: DataFrame) -> DataFrame:
    """The larger of an arc's own probability and those that chosen options give it."""
    return _raised(land.arcs, land.arc_improvements.join(chosen(selection), "option_id"))


def with_selection(land: Landscape, selection: DataFrame) -> Landscape:
    return land.with_(vertices=improved_vertices(land, selection), arcs=improved_arcs(land, selection))


def parallel_arcs(land: Landscape) -> DataFrame:
    """Base arcs (``option_id`` null) and one more arc for each improvement."""
    more = land.arc_improvements.join(land.arcs.drop("probability"), ["case_id", "arc_id"])
    base = land.arcs.withColumn("option_id", F.lit(None).cast("string"))
    columns = ["case_id", "arc_id", "src", "dst", "option_id", "probability"]
    return base.select(columns).unionByName(more.withColumnRenamed("improved_probability", "probability").select(columns))


def fully_improved_arcs(land: Landscape, only: Column | None = None) -> DataFrame:
    """Arcs as if all options (those that meet ``only``) were taken."""
    improvements = land.arc_improvements
    if only is not None:
        improvements = improvements.join(land.options.where(only).select("option_id"), "option_id", "left_semi")
    return _raised(land.arcs, improvements)


def fully_improved_vertices(land: Landscape) -> DataFrame:
    """Qualities as if all options were taken."""
    return improved_vertices(land, land.options.select("option_id", F.lit(1).alias("value")))


def reversed_arcs(arcs: DataFrame) -> DataFrame:
    return arcs.select("case_id", "arc_id", F.col("dst").alias("src"), F.col("src").alias("dst"), "probability")


def selection_cost(land: Landscape, selection: DataFrame) -> DataFrame:
    """One row ``cost``; with ``scenario_id`` in the selection, a row for each."""
    by = ["scenario_id"] if "scenario_id" in selection.columns else []
    joined = selection.join(land.options, "option_id")
    return joined.groupBy(*by).agg(F.coalesce(F.sum(F.col("value") * F.col("cost")), F.lit(0.0)).alias("cost"))
