"""Many selections scored in one batch.

Paths of a selection are base paths joined by improved arcs.  The base closure is worked out once, between
terminals; each scenario then composes its own improved arcs with it, all scenarios together, and keeps only the
pairs that became better.  A landscape that already has options taken is a base like any other, so a method that takes
them one by one composes only a candidate's own arcs.  Quality gains need no path work: they are products with the closure.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkscape.landscape import Landscape
from linkscape.operators import relational as R
from linkscape.operators.closure import PIECES, best_path_closure, merged
from linkscape.operators.witnesses import Taken
from linkscape.storage import cut, cut_counted


def terminal_closure(land: Landscape) -> DataFrame:
    """Base paths from vertices with (possible) source quality and from heads of improvable arcs."""
    gains = land.vertex_improvements.where("source_gain > 0").select("case_id", "vertex_id")
    heads = land.arcs.join(land.arc_improvements, ["case_id", "arc_id"], "left_semi").select("case_id", F.col("dst").alias("vertex_id"))
    starts = R.sources(land.vertices).select("case_id", "vertex_id").unionByName(gains).unionByName(heads).distinct()
    return best_path_closure(land.arcs, starts)


def composed(paths: DataFrame, raised: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """``scenario_id, case_id, s, t, p, old`` for pairs of ``paths`` that better arcs improve (``old`` null where there was no path).

    ``raised``: ``scenario_id, case_id, src, dst, q``.  A step is one of these arcs and the base path after it.
    """
    keys = ["scenario_id", "case_id", "s", "t"]
    arcs = raised.groupBy("scenario_id", "case_id", "src", "dst").agg(F.max("q").alias("q"))
    onward = paths.select("case_id", F.col("s").alias("dst"), F.col("t").alias("to"), F.col("p").alias("rest"))
    steps = cut(arcs.join(onward, ["case_id", "dst"]).groupBy("scenario_id", "case_id", F.col("src").alias("at"), "to").agg(F.max(F.col("q") * F.col("rest")).alias("q")))
    old = paths.withColumnRenamed("p", "old")
    frontier = paths.withColumnRenamed("t", "at").join(steps, ["case_id", "at"])
    pieces: list[DataFrame] = []
    for _ in range(max_rounds):
        reach = frontier.groupBy("scenario_id", "case_id", "s", F.col("to").alias("t")).agg(F.max(F.col("p") * F.col("q")).alias("p")).where("s <> t")
        reach = reach.join(old, ["case_id", "s", "t"], "left").where("old is null or p > old")
        if pieces:
            reach = reach.join(merged([x.drop("old") for x in pieces], keys).withColumnRenamed("p", "seen"), keys, "left").where("seen is null or p > seen").drop("seen")
        better, n = cut_counted(reach.select(*keys, "p", "old"))
        if not n and pieces:
            if len(pieces) == 1:
                return pieces[0]
            return cut(reduce(DataFrame.unionByName, pieces).groupBy(*keys).agg(F.max("p").alias("p"), F.max("old").alias("old")))
        pieces.append(better)
        if not n:
            return better
        if len(pieces) == PIECES:
            pieces = [cut(reduce(DataFrame.unionByName, pieces).groupBy(*keys).agg(F.max("p").alias("p"), F.max("old").alias("old")))]
        frontier = better.withColumnRenamed("t", "at").join(steps, ["scenario_id", "case_id", "at"])
    raise RuntimeError(f"no end after {max_rounds} rounds")


def better_paths(land: Landscape, selections: DataFrame, paths: DataFrame) -> DataFrame:
    """``composed`` over the arcs that each scenario's options raise above what ``land`` has."""
    arcs = R.arcs_by_option(land).where("improved_probability > probability").join(selections.select("scenario_id", "option_id").distinct(), "option_id")
    return composed(paths, arcs.select("scenario_id", "case_id", "src", "dst", F.col("improved_probability").alias("q")))


def scenario_pc(land: Landscape, selections: DataFrame, paths: DataFrame | None = None, better: DataFrame | None = None) -> DataFrame:
    """``scenario_id, case_id, pc`` of the landscape under each scenario's chosen options (``scenario_id, option_id``).

    Scenarios without a row are not listed.  ``paths``: the base closure between terminals, and ``better`` what ``better_paths`` makes of it, if they are at hand.
    """
    paths = terminal_closure(land) if paths is None else paths
    taken = selections.select("scenario_id", "option_id").distinct()
    gain = land.vertex_improvements.join(taken, "option_id").groupBy("scenario_id", "case_id", "vertex_id").agg(F.sum("source_gain").alias("da"), F.sum("target_gain").alias("db"))
    gain = cut(gain)
    a = land.vertices.select("case_id", F.col("vertex_id").alias("s"), F.col("source_quality").alias("a"))
    b = land.vertices.select("case_id", F.col("vertex_id").alias("t"), F.col("target_quality").alias("b"))
    da = gain.select("scenario_id", "case_id", F.col("vertex_id").alias("s"), "da")
    db = gain.select("scenario_id", "case_id", F.col("vertex_id").alias("t"), "db")
    pairs = paths.join(a, ["case_id", "s"]).join(b, ["case_id", "t"])
    base = pairs.groupBy("case_id").agg(F.sum(F.col("a") * F.col("b") * F.col("p")).alias("part"))
    scenarios = taken.select("scenario_id").distinct()
    cases = land.vertices.select("case_id").distinct()  # Spark broadcasts the smaller side if it is small enough
    parts = scenarios.crossJoin(cases).select("scenario_id", "case_id").join(base, "case_id", "left").select("scenario_id", "case_id", F.coalesce("part", F.lit(0.0)).alias("part"))  # a row for each result row
    outward = pairs.groupBy("case_id", "s").agg(F.sum(F.col("b") * F.col("p")).alias("out"))
    inward = pairs.groupBy("case_id", "t").agg(F.sum(F.col("a") * F.col("p")).alias("in"))
    parts = parts.unionByName(da.join(outward, ["case_id", "s"]).select("scenario_id", "case_id", (F.col("da") * F.col("out")).alias("part")))
    parts = parts.unionByName(db.join(inward, ["case_id", "t"]).select("scenario_id", "case_id", (F.col("db") * F.col("in")).alias("part")))
    both = paths.join(da.where("da <> 0"), ["case_id", "s"]).join(db.where("db <> 0"), ["scenario_id", "case_id", "t"])
    parts = parts.unionByName(both.select("scenario_id", "case_id", (F.col("da") * F.col("db") * F.col("p")).alias("part")))
    better = better_paths(land, taken, paths) if better is None else better
    new = better.join(a, ["case_id", "s"]).join(b, ["case_id", "t"])
    new = new.join(da, ["scenario_id", "case_id", "s"], "left").join(db, ["scenario_id", "case_id", "t"], "left")
    worth = (F.col("a") + F.coalesce("da", F.lit(0.0))) * (F.col("b") + F.coalesce("db", F.lit(0.0)))
    parts = parts.unionByName(new.select("scenario_id", "case_id", ((F.col("p") - F.coalesce("old", F.lit(0.0))) * worth).alias("part")))
    return parts.groupBy("scenario_id", "case_id").agg(F.sum("part").alias("pc"))


def marginals(land: Landscape, taken: DataFrame, candidates: DataFrame, *, add: bool, paths: DataFrame | None = None) -> DataFrame:
    """``option_id, case_id, pc``: the scores with each candidate added to, or taken out of, the options ``taken`` (``option_id``).

    ``paths`` (added candidates only): the base closure between terminals, if it is at hand.
    """
    if not add:
        return Taken.of(land, taken).scores_without(candidates)
    now = R.with_selection(land, taken.select("option_id").distinct().withColumn("value", F.lit(1)))
    now = land.with_(vertices=cut(now.vertices), arcs=cut(now.arcs))
    if paths is not None:  # moved on by what the taken options better, so that a candidate brings its own arcs only
        better = better_paths(land, taken.select(F.lit("taken").alias("scenario_id"), "option_id"), paths)
        paths = cut(merged([paths, better.select("case_id", "s", "t", "p")], ["case_id", "s", "t"]))
    fresh = candidates.select("option_id").distinct().join(taken.select("option_id").distinct(), "option_id", "left_anti")
    held = candidates.select("option_id").distinct().join(taken.select("option_id").distinct(), "option_id", "left_semi")
    each = fresh.select(F.col("option_id").alias("scenario_id"), "option_id").unionByName(held.select(F.col("option_id").alias("scenario_id"), F.lit("").alias("option_id")))
    return scenario_pc(now, each, paths).withColumnRenamed("scenario_id", "option_id")
