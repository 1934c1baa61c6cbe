"""Best paths that know which options they rest on, for taking options out one by one.

Every arc names the option that makes it as good as it is (the first of the best ones; none if it is so by itself) and its next best
value without that option.  Every best path carries its witnesses, the options named by its arcs.  Taking out an option that a path
doesn't rest on leaves the path as it is, so only the pairs that have it as a witness are worked out again: from their in-arcs,
whose tails either don't rest on the option and are known, or are among these pairs and are relaxed with them.

The best paths without each witness are kept beside the best ones.  Taking an option out then promotes its rows; of the others only
those are repaired that rested on it, or that belong to pairs whose best path changed.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from linkscape.landscape import Landscape
from linkscape.operators import relational as R
from linkscape.operators.closure import MAX_ROUNDS, PIECES
from linkscape.storage import cut, cut_counted

PAIR = ["case_id", "s", "t"]
KEYS = ["option_id", *PAIR]
#: Stands for no option: rows of the best paths, and arcs that need none.
NONE = ""


def _better(p: Column, w: Column) -> Column:
    """Compares paths by probability, then by the fewest witnesses."""
    return F.max(F.struct(p.alias("p"), (-F.size(w)).alias("few"), w.alias("w"))).alias("x")


def _joined(w: Column, by: Column) -> Column:
    return F.when((by == NONE) | F.array_contains(w, by), w).otherwise(F.array_sort(F.array_append(w, by)))


def _offered(land: Landscape, taken: DataFrame) -> DataFrame:
    """Arcs with the values that the taken options offer above their own, best first: ``case_id, src, dst, own, offers``."""
    ranked = R.arcs_by_option(land).where("improved_probability > probability").join(taken.select("option_id").distinct(), "option_id").join(land.options.select("option_id", "option_ord"), "option_id")
    offer = F.struct(F.col("improved_probability").alias("q"), (-F.col("option_ord")).alias("early"), F.col("option_id").alias("by"))
    offers = ranked.groupBy("case_id", "arc_id").agg(F.sort_array(F.collect_list(offer), asc=False).alias("offers"))  # an arc's options
    arcs = land.arcs.where("src <> dst").select("case_id", "arc_id", "src", "dst", F.col("probability").alias("own")).join(offers, ["case_id", "arc_id"], "left")
    return cut(arcs.where("own > 0 or offers is not null").drop("arc_id"))


def _arcs(offered: DataFrame, gone: list[str]) -> DataFrame:
    """``case_id, src, dst, q, by, next_q, next_by`` without the options that are gone."""
    lost = F.array(*map(F.lit, gone)).cast("array<string>")
    live = offered.withColumn("live", F.filter("offers", lambda x: ~F.array_contains(lost, x["by"])))
    at = lambda k: F.get("live", F.lit(k))
    value = lambda k: [F.coalesce(at(k)["q"], "own"), F.coalesce(at(k)["by"], F.lit(NONE))]
    return live.select("case_id", "src", "dst", *[c.alias(n) for c, n in zip([*value(0), *value(1)], ["q", "by", "next_q", "next_by"], strict=True)])


def witnessed_closure(arcs: DataFrame, sources: DataFrame) -> DataFrame:
    """``case_id, s, t, p, w``: the best path from each source (``case_id, vertex_id``) to everything it reaches, with its witnesses in order."""
    start = cut(sources.select("case_id", F.col("vertex_id").alias("s"), F.col("vertex_id").alias("t"), F.lit(1.0).alias("p"), F.array().cast("array<string>").alias("w")).distinct())
    steps = cut(arcs.where("q > 0").select("case_id", F.col("src").alias("t"), F.col("dst").alias("to"), "q", "by"))
    pieces, frontier = [start], start
    merged = lambda xs: xs[0] if len(xs) == 1 else reduce(DataFrame.unionByName, xs).groupBy(*PAIR).agg(_better(F.col("p"), F.col("w"))).select(*PAIR, "x.p", "x.w")
    for _ in range(MAX_ROUNDS):
        reach = frontier.join(steps, ["case_id", "t"]).groupBy("case_id", "s", F.col("to").alias("t")).agg(_better(F.col("p") * F.col("q"), _joined(F.col("w"), F.col("by"))))
        old = merged(pieces).select(*PAIR, F.col("p").alias("old"))
        frontier, n = cut_counted(reach.select(*PAIR, "x.p", "x.w").join(old, PAIR, "left").where("old is null or p > old").drop("old"))
        if not n:
            return merged(pieces)
        pieces.append(frontier)
        if len(pieces) == PIECES:
            pieces = [cut(merged(pieces))]
    raise RuntimeError(f"no end after {MAX_ROUNDS} rounds")


def _repaired(todo: DataFrame, arcs: DataFrame, best: DataFrame, known: DataFrame) -> DataFrame:
    """``todo`` (``option_id, case_id, s, t``) with ``p, w``: the best path without the option, or 0 where there is none.

    ``known``: rows of the same kind that stand.
    """
    own = F.col("by") == F.col("option_id")
    into = todo.join(arcs.withColumnRenamed("dst", "t"), ["case_id", "t"]).select(*KEYS, F.col("src").alias("u"), F.when(own, F.col("next_q")).otherwise(F.col("q")).alias("q"), F.when(own, F.col("next_by")).otherwise(F.col("by")).alias("by"))
    tails = best.select("case_id", "s", F.col("t").alias("u"), F.col("p").alias("best_p"), F.col("w").alias("best_w"))
    without = known.select("option_id", "case_id", "s", F.col("t").alias("u"), F.col("p").alias("known_p"), F.col("w").alias("known_w"))
    edges = into.where("q > 0").join(tails, ["case_id", "s", "u"]).join(without, ["option_id", "case_id", "s", "u"], "left")
    rests = F.array_contains("best_w", F.col("option_id"))
    edges = edges.withColumn("p", F.when(rests, F.col("known_p")).otherwise(F.col("best_p"))).withColumn("w", F.when(rests, F.col("known_w")).otherwise(F.col("best_w")))
    seen = Observation()
    edges = cut(edges.select(*KEYS, "u", "q", "by", "p", "w").observe(seen, F.count_if(F.col("p").isNull()).alias("inner")))
    reached = lambda rows: rows.groupBy(*KEYS).agg(_better(F.col("p") * F.col("q"), _joined(F.col("w"), F.col("by")))).select(*KEYS, "x.p", "x.w")
    found = reached(edges.where("p > 0"))
    inner = edges.where("p is null").drop("p", "w")  # tails that are to be worked out themselves
    if seen.get["inner"]:
        pieces, frontier = [found], found
        for _ in range(MAX_ROUNDS):
            came = reached(inner.join(frontier.withColumnRenamed("t", "u"), ["option_id", "case_id", "s", "u"]))
            old = reduce(DataFrame.unionByName, pieces).groupBy(*KEYS).agg(F.max("p").alias("old"))
            frontier, more = cut_counted(came.join(old, KEYS, "left").where("old is null or p > old").drop("old"))
            if not more:
                break
            pieces.append(frontier)
            if len(pieces) == PIECES:
                pieces = [cut(reduce(DataFrame.unionByName, pieces).groupBy(*KEYS).agg(_better(F.col("p"), F.col("w"))).select(*KEYS, "x.p", "x.w"))]
        found = reduce(DataFrame.unionByName, pieces).groupBy(*KEYS).agg(_better(F.col("p"), F.col("w"))).select(*KEYS, "x.p", "x.w")
    return todo.join(found, KEYS, "left").select(*KEYS, F.coalesce("p", F.lit(0.0)).alias("p"), F.coalesce("w", F.array().cast("array<string>")).alias("w"))


def _rested(best: DataFrame) -> DataFrame:
    """A row for each pair and each of its witnesses."""
    return best.select(F.explode("w").alias("option_id"), *PAIR)


@dataclass(frozen=True)
class Taken:
    """A landscape with options taken, to take them out again.

    ``rows``: ``option_id, case_id, s, t, p, w``, best paths (no option) and best paths without each of their witnesses; ``vertices`` and ``gains`` are those before
    the options in ``gone`` were taken out.
    """

    land: Landscape
    offered: DataFrame
    gone: tuple[str, ...]
    vertices: DataFrame
    gains: DataFrame
    rows: DataFrame

    @staticmethod
    def of(land: Landscape, taken: DataFrame) -> "Taken":
        """``land`` after all of ``taken`` (``option_id``)."""
        offered = _offered(land, taken)
        arcs = _arcs(offered, [])
        chosen = taken.select("option_id").distinct()
        vertices = cut(R.improved_vertices(land, chosen.withColumn("value", F.lit(1))))
        gains = cut(R.vertices_by_option(land).join(chosen, "option_id", "left_semi"))
        best = cut(witnessed_closure(arcs, R.sources(vertices).select("case_id", "vertex_id")))
        todo = _rested(best)
        return Taken(land, offered, (), vertices, gains, cut(_with_none(best).unionByName(_repaired(todo, arcs, best, _with_none(best).limit(0)))))

    def best(self) -> DataFrame:
        return self.rows.where(F.col("option_id") == NONE).drop("option_id")

    def without(self, option_id: str) -> "Taken":
        """The same with one more option taken out."""
        out = F.lit(option_id)
        best, rests = self.best(), F.array_contains("w", out)
        changed = best.where(rests).select(*PAIR)
        promoted = self.rows.where((F.col("option_id") == out) & (F.col("p") > 0)).drop("option_id")
        best = best.where(~rests).unionByName(promoted)
        others = self.rows.where(~F.col("option_id").isin(NONE, option_id))
        same, moved = others.join(changed, PAIR, "left_anti"), others.join(changed, PAIR, "left_semi")
        wanted = _rested(promoted)
        stands = moved.where(~rests).join(wanted, KEYS, "left_semi")
        known = same.where(~rests).unionByName(stands)
        todo = wanted.join(stands, KEYS, "left_anti").unionByName(same.where(rests).select(*KEYS))
        arcs = _arcs(self.offered, [*self.gone, option_id])
        rows = cut(_with_none(best).unionByName(known).unionByName(_repaired(todo, arcs, best, known)))
        return Taken(self.land, self.offered, (*self.gone, option_id), self.vertices, self.gains, rows)

    def _vertices(self) -> DataFrame:
        """Vertices with the qualities that the options still taken give them."""
        if not self.gone:
            return self.vertices
        lost = self.gains.where(F.col("option_id").isin(*self.gone)).groupBy("case_id", "vertex_id").agg(F.sum("source_gain").alias("source_gain"), F.sum("target_gain").alias("target_gain"))
        vertices = self.vertices.join(lost, ["case_id", "vertex_id"], "left")
        return vertices.select("case_id", "vertex_id", *[(F.col(f"{x}_quality") - F.coalesce(f"{x}_gain", F.lit(0.0))).alias(f"{x}_quality") for x in ("source", "target")])

    def scores_without(self, candidates: DataFrame) -> DataFrame:
        """``option_id, case_id, pc``: the score of each case if one candidate (``option_id``, of those still taken) is left out; the sum over all pairs is corrected for what the candidate gives."""
        vertices = self._vertices()
        a = vertices.select("case_id", F.col("vertex_id").alias("s"), F.col("source_quality").alias("a"))
        b = vertices.select("case_id", F.col("vertex_id").alias("t"), F.col("target_quality").alias("b"))
        gains = self.gains.join(candidates.select("option_id").distinct(), "option_id", "left_semi")
        da = gains.where("source_gain <> 0").select("option_id", "case_id", F.col("vertex_id").alias("s"), F.col("source_gain").alias("da"))
        db = gains.where("target_gain <> 0").select("option_id", "case_id", F.col("vertex_id").alias("t"), F.col("target_gain").alias("db"))
        pairs = self.best().drop("w").join(a, ["case_id", "s"]).join(b, ["case_id", "t"])
        base = pairs.groupBy("case_id").agg(F.sum(F.col("a") * F.col("b") * F.col("p")).alias("part"))
        cases = vertices.select("case_id").distinct().join(base, "case_id", "left").select("case_id", F.coalesce("part", F.lit(0.0)).alias("part"))
        every = candidates.select("option_id").distinct().withColumn("one", F.lit(1)).join(cases.withColumn("one", F.lit(1)), "one").drop("one")  # a row for each result row
        outward = pairs.groupBy("case_id", "s").agg(F.sum(F.col("b") * F.col("p")).alias("out"))
        inward = pairs.groupBy("case_id", "t").agg(F.sum(F.col("a") * F.col("p")).alias("in"))
        part = lambda rows, x: rows.select("option_id", "case_id", x.alias("part"))
        parts = every.unionByName(part(da.join(outward, ["case_id", "s"]), -F.col("da") * F.col("out"))).unionByName(part(db.join(inward, ["case_id", "t"]), -F.col("db") * F.col("in")))
        both = self.best().join(da, ["case_id", "s"]).join(db, ["option_id", "case_id", "t"])
        parts = parts.unionByName(part(both, F.col("da") * F.col("db") * F.col("p")))
        worse = self.rows.where(F.col("option_id") != NONE).join(candidates.select("option_id").distinct(), "option_id", "left_semi").drop("w").withColumnRenamed("p", "rest")
        worse = worse.join(pairs, PAIR).join(da, ["option_id", "case_id", "s"], "left").join(db, ["option_id", "case_id", "t"], "left")
        worth = (F.col("a") - F.coalesce("da", F.lit(0.0))) * (F.col("b") - F.coalesce("db", F.lit(0.0)))
        parts = parts.unionByName(part(worse, (F.col("rest") - F.col("p")) * worth))
        return parts.groupBy("option_id", "case_id").agg(F.sum("part").alias("pc"))


def _with_none(best: DataFrame) -> DataFrame:
    return best.select(F.lit(NONE).alias("option_id"), *PAIR, "p", "w")
