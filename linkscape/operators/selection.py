"""Choosing options within a budget.

A method takes one option a step, and every step scores all its candidates in one batch; what a loop keeps on the driver is one row an option.
Forward methods move on: the chosen option's better paths, which the batch has just worked out, are merged into the closure,
so that the next step composes only the candidates' own arcs.  Backward methods keep, with each best path, the options it rests on and the best path without each of them
(``witnesses``), so that a removal touches only what rested on it.
Ties go to the option that stands first (``option_ord``); ratios are compared after rounding to 12 digits; sums of costs may exceed the budget by ``feasibility_tol``.
"""

from __future__ import annotations

import math
from copy import copy
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from linkscape.functions.criterion import Formula, score
from linkscape.landscape import Landscape
from linkscape.operators import relational as R
from linkscape.operators.closure import improved_inflow, merged, pc, potentials
from linkscape.operators.scenarios import better_paths, marginals, scenario_pc, terminal_closure
from linkscape.operators.simplify import option_bound_scores
from linkscape.operators.witnesses import NONE, Taken
from linkscape.storage import cut, local_frame

#: By how much costs may exceed a budget.
TOLERANCE = 1e-7


def _digits(x: Column) -> Column:
    """Twelve significant digits."""
    scale = F.pow(F.lit(10.0), 11 - F.floor(F.log10(F.abs(x))))
    return F.when((x == 0) | x.isNull(), F.lit(0.0)).otherwise(F.round(x * scale) / scale)


def _twelve(x: float) -> float:
    """``_digits`` of a number."""
    return float(f"{x:.11e}")


def _scores(land: Landscape, case_scores: DataFrame, by: str) -> DataFrame:
    return score(case_scores, land.criterion, by=(by,))


def _score_now(land: Landscape, paths: DataFrame) -> float:
    """Score of a landscape as it is."""
    row = _scores(land, pc(land, paths).withColumn("scenario_id", F.lit("now")), "scenario_id").first()
    return row["score"] if row else 0.0


def _ids(land: Landscape, ids: list[str]) -> DataFrame:
    return local_frame(land.options.sparkSession, {"option_id": list(ids)}, "option_id string")


def _ranked(land: Landscape, after: DataFrame, gain: Column) -> DataFrame:
    return after.join(land.options, "option_id").select("option_id", "option_ord", "cost", gain.alias("gain"), _digits(F.try_divide(gain, F.col("cost"))).alias("ratio"))


def option_gains(land: Landscape, taken: list[str], candidates: list[str], *, add: bool = True, paths: DataFrame | None = None, now: float | None = None) -> DataFrame:
    """``option_id, option_ord, cost, gain, ratio``: what each candidate adds to the score, or costs it if taken out, and that for each unit of cost (null for free ones)."""
    paths = terminal_closure(land) if paths is None else paths
    if now is None:
        chosen = _ids(land, [*taken, ""]).withColumn("scenario_id", F.lit("now"))
        row = _scores(land, scenario_pc(land, chosen, paths), "scenario_id").first() if taken else None
        now = _score_now(land, paths) if not taken else row["score"] if row else 0.0
    after = _scores(land, marginals(land, _ids(land, taken), _ids(land, candidates), add=add, paths=paths), "option_id")
    return _ranked(land, after, (F.col("score") - F.lit(now)) if add else (F.lit(now) - F.col("score")))


def ranking(land: Landscape, paths: DataFrame | None = None) -> DataFrame:
    """Gain and ratio of every option on its own."""
    paths = terminal_closure(land) if paths is None else paths
    each = land.options.select("option_id", F.col("option_id").alias("scenario_id"))
    after = _scores(land, scenario_pc(land, each, paths).withColumnRenamed("scenario_id", "option_id"), "option_id")
    return _ranked(land, after, F.col("score") - F.lit(_score_now(land, paths)))


def _running(placed: DataFrame) -> DataFrame:
    """``placed`` (with ``cost`` and ``_id``, its order) with ``_sum``, the cost up to and with each row, and ``_at``, its number from 1.

    Sums go by blocks of consecutive ids first, and one task sees a row for each block.
    """
    blocks = placed.withColumn("_block", F.shiftright("_id", 33))
    sums = blocks.groupBy("_block").agg(F.sum("cost").alias("_cost"), F.count("*").alias("_n"))
    before = W.orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select("_block", F.coalesce(F.sum("_cost").over(before), F.lit(0.0)).alias("_cost"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n"))
    within = W.partitionBy("_block").orderBy("_id").rowsBetween(W.unboundedPreceding, 0)
    found = blocks.withColumn("_own", F.sum("cost").over(within)).withColumn("_nth", F.count("*").over(within)).join(sums, "_block")
    return found.withColumn("_sum", F.col("_cost") + F.col("_own")).withColumn("_at", F.col("_n") + F.col("_nth")).drop("_block", "_cost", "_n", "_own", "_nth")


def _placed(ranked: DataFrame, order: list[Column]) -> DataFrame:
    """Sorted across tasks and written: ids increase along the order, by task."""
    return cut(ranked.orderBy(*order).withColumn("_id", F.monotonically_increasing_id()))


def budget_fill(ranked: DataFrame, budget: float, order: list[Column], max_rounds: int = 10_000, feasibility_tol: float = TOLERANCE) -> DataFrame:
    """Rows of ``ranked`` (with ``cost``) taken in order, each that still fits; those that do not are passed over.

    Each round takes the longest prefix that fits, drops the first row that does not and all dearer than what is left.
    """
    rest, taken, left = _placed(ranked, order), None, float(budget) + feasibility_tol
    for _ in range(max_rounds):
        running = cut(_running(rest))
        stop = running.where(F.col("_sum") > left).agg(F.min("_at")).first()[0]
        fits = running if stop is None else running.where(F.col("_at") < stop)
        taken = fits if taken is None else taken.unionByName(fits)
        if stop is None:
            break
        left -= fits.agg(F.coalesce(F.sum("cost"), F.lit(0.0))).first()[0]
        rest = running.where((F.col("_at") > stop) & (F.col("cost") <= left)).drop("_sum", "_at")
    return taken.drop("_sum", "_at").orderBy("_id").drop("_id")


def budget_cut(ranked: DataFrame, budget: float, order: list[Column], feasibility_tol: float = TOLERANCE) -> DataFrame:
    """Rows to remove, in order, until the rest costs at most ``budget``; at least the first one."""
    running = cut(_running(_placed(ranked, order)))
    total = running.agg(F.coalesce(F.sum("cost"), F.lit(0.0))).first()[0]
    gone = running.where((F.lit(total) - (F.col("_sum") - F.col("cost")) > budget + feasibility_tol) | (F.col("_at") == 1))
    return gone.drop("_id", "_sum", "_at")


def certificate(land: Landscape, budget: float) -> DataFrame:
    """One row ``base_score, bound``: no selection that costs at most ``budget`` scores more than ``bound`` (for the sum of all cases).

    From one closure of the landscape as it is: the score is at most the present one plus the bound scores of the options taken, so at most
    that plus the most bound score that the budget buys if options could be bought in part.  Options dearer than the budget are left out.
    """
    land = R.affordable(land, budget)
    rho = cut(potentials(land))
    own = land.vertices.select("case_id", F.col("vertex_id").alias("u"), "source_quality")
    base = rho.join(own, ["case_id", "u"]).agg(F.coalesce(F.sum(F.col("source_quality") * F.col("potential")), F.lit(0.0)).alias("base_score"))
    scores = option_bound_scores(land, rho, improved_inflow(land)).join(land.options, "option_id").where("score > 0")
    ratio = F.coalesce(F.try_divide("score", "cost"), F.lit(float("inf")))
    running = _running(_placed(scores.withColumn("ratio", ratio), [F.desc("ratio"), F.col("option_ord")]))
    left = F.lit(float(budget)) - (F.col("_sum") - F.col("cost"))
    share = F.when(F.col("cost") == 0, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(left, F.col("cost")))))
    filled = running.agg(F.coalesce(F.sum(F.col("score") * share), F.lit(0.0)).alias("filled"))
    return base.join(F.broadcast(filled)).select("base_score", (F.col("base_score") + F.col("filled")).alias("bound"))  # one row each


def _rows_frame(spark, rows: list) -> DataFrame:
    names = ["option_id", "option_ord", "cost", "ratio"]
    return local_frame(spark, {n: [r[n] for r in rows] for n in names}, "option_id string, option_ord long, cost double, ratio double")


@dataclass
class _State:
    """Options as rows on the driver, ids, costs and places, and the landscape with the free ones taken, its paths and score."""

    land: Landscape
    budget: float
    tol: float = TOLERANCE
    cost: dict[str, float] = field(default_factory=dict)
    place: dict[str, int] = field(default_factory=dict)

    def __post_init__(self):
        self.land = R.affordable(self.land, self.budget)
        rows = self.land.options.collect()  # one row an option
        self.cost = {r["option_id"]: r["cost"] for r in rows}
        self.place = {r["option_id"]: r["option_ord"] for r in rows}
        if self.free():
            self.land = _taking(self.land, self.free())
        self.paths = terminal_closure(self.land)
        self.now = _score_now(self.land, self.paths)

    def free(self) -> list[str]:
        return [o for o, c in self.cost.items() if c == 0]

    def paid(self) -> list[str]:
        return [o for o, c in self.cost.items() if c > 0]

    def total(self, ids: list[str]) -> float:
        return math.fsum(self.cost[o] for o in ids)

    def losses(self, state: Taken, taken: list[str]) -> list:
        """What each of ``taken``, which ``state`` has taken, costs if it is left out."""
        after = state.scores_without(_ids(self.land, [*taken, NONE]))
        scored = _scores(self.land, after, "option_id").collect()  # a row for each option, and one for none left out
        now = next(r["score"] for r in scored if r["option_id"] == NONE)
        out = [{"option_id": r["option_id"], "option_ord": self.place[r["option_id"]], "cost": self.cost[r["option_id"]], "gain": now - r["score"]} for r in scored if r["option_id"] != NONE]
        return [r | {"ratio": _twelve(r["gain"] / r["cost"])} for r in out]

    def moved(self, taken: list[str]) -> "_State":
        """The same with ``taken`` in the landscape and its paths."""
        if not taken:
            return self
        other = copy(self)
        everything = _ids(self.land, taken).withColumn("scenario_id", F.lit("now"))
        other.paths = _merged(self.paths, better_paths(self.land, everything, self.paths))
        other.land = _taking(self.land, taken)
        other.now = _score_now(other.land, other.paths)
        return other

    def gains(self, candidates: list[str]) -> tuple[list, DataFrame]:
        """Gains of candidates on top of this state, and the better paths of each."""
        each = _ids(self.land, candidates).withColumn("scenario_id", F.col("option_id"))
        better = better_paths(self.land, each, self.paths)
        after = _scores(self.land, scenario_pc(self.land, each, self.paths, better).withColumnRenamed("scenario_id", "option_id"), "option_id")
        return _ranked(self.land, after, F.col("score") - F.lit(self.now)).collect(), better

    def fill_greedy(self, taken: list[str], pool: list[str], worst: bool = False) -> list[str]:
        """``taken`` and, in order, the pool's best (or worst) ratio again and again while something fits; ``self`` has ``taken`` in it."""
        taken, state = list(taken), self
        while True:
            left = self.budget + self.tol - self.total(taken)
            pool = [o for o in pool if o not in taken and self.cost[o] <= left]
            if not pool:
                return taken
            rows, better = state.gains(pool)
            row = min(rows, key=lambda r: (r["ratio"] if worst else -r["ratio"], r["option_ord"]))
            taken.append(row["option_id"])
            if any(o != row["option_id"] and self.cost[o] <= left - row["cost"] for o in pool):
                state = copy(state)
                state.paths = _merged(state.paths, better.where(F.col("scenario_id") == row["option_id"]))
                state.land = _taking(state.land, [row["option_id"]])
                state.now += row["gain"]

    def cut_greedy(self, worst: bool = False) -> tuple[list[str], list[str]]:
        taken, gone = self.paid(), []
        if self.total(taken) <= self.budget + self.tol:
            return taken, gone
        state = Taken.of(self.land, _ids(self.land, taken))
        while taken and self.total(taken) > self.budget + self.tol:
            out = min(self.losses(state, taken), key=lambda r: (-r["ratio"] if worst else r["ratio"], r["option_ord"]))["option_id"]
            taken.remove(out)
            gone.append(out)
            if self.total(taken) > self.budget + self.tol:
                state = state.without(out)
        return taken, gone

    def fill_static(self, taken: list[str], pool: list[str]) -> list[str]:
        """``taken`` and what fits of the pool by ratios worked out once; ``self`` has ``taken`` in it."""
        if not pool:
            return taken
        ranked = _rows_frame(self.land.options.sparkSession, self.gains(pool)[0])
        left = self.budget - self.total(taken)
        return taken + [r["option_id"] for r in budget_fill(ranked, left, [F.desc("ratio"), F.col("option_ord")], feasibility_tol=self.tol).collect()]


def _taking(land: Landscape, ids: list[str]) -> Landscape:
    """The landscape after these options, written, so that a loop's plans stay short."""
    improved = R.with_selection(land, _ids(land, ids).withColumn("value", F.lit(1)))
    return land.with_(vertices=cut(improved.vertices), arcs=cut(improved.arcs))


def _merged(paths: DataFrame, better: DataFrame) -> DataFrame:
    keys = ["case_id", "s", "t"]
    return cut(merged([paths, better.select(*keys, "p")], keys))


def static_incr(land: Landscape, budget: float, feasibility_tol: float = TOLERANCE) -> list[str]:
    """Ratios once, from none taken; best first, whatever fits.  Free options are always taken."""
    s = _State(land, budget, feasibility_tol)
    return s.fill_static(s.free(), s.paid())


def greedy_incr(land: Landscape, budget: float, feasibility_tol: float = TOLERANCE) -> list[str]:
    """The best ratio again and again, scored anew after each, until nothing fits; in order of purchase."""
    s = _State(land, budget, feasibility_tol)
    return s.fill_greedy(s.free(), s.paid())


def static_decr(land: Landscape, budget: float, only_dec: bool = False, feasibility_tol: float = TOLERANCE) -> list[str]:
    """From all affordable ones, the smallest losses out until the budget holds (one at least); then what was removed is ranked once and refilled."""
    s = _State(land, budget, feasibility_tol)
    paid = s.paid()
    if not paid:
        return s.free()
    ranked = _rows_frame(land.options.sparkSession, s.losses(Taken.of(s.land, _ids(s.land, paid)), paid))
    gone = {r["option_id"] for r in budget_cut(ranked, budget, [F.col("ratio"), F.col("option_ord")], feasibility_tol).collect()}
    kept = [o for o in paid if o not in gone]
    return s.free() + kept if only_dec else s.moved(kept).fill_static(s.free() + kept, sorted(gone, key=s.place.get))


def greedy_decr(land: Landscape, budget: float, only_dec: bool = False, feasibility_tol: float = TOLERANCE) -> list[str]:
    """The smallest loss out, scored anew after each, until the budget holds; then a greedy refill from what was removed."""
    s = _State(land, budget, feasibility_tol)
    kept, gone = s.cut_greedy()
    return s.free() + kept if only_dec else s.moved(kept).fill_greedy(s.free() + kept, gone)


def worst_greedy_decr(land: Landscape, budget: float, feasibility_tol: float = TOLERANCE) -> list[str]:
    """The adversary: largest losses out, smallest gains in."""
    s = _State(land, budget, feasibility_tol)
    kept, gone = s.cut_greedy(worst=True)
    return s.moved(kept).fill_greedy(s.free() + kept, gone, worst=True)


METHODS = {f.__name__: f for f in (static_incr, greedy_incr, static_decr, greedy_decr, worst_greedy_decr)}


def selection_of(land: Landscape, ids: list[str]) -> DataFrame:
    """``option_id, value``: every option of the landscape, 1 if chosen."""
    chosen = _ids(land, ids).distinct().withColumn("value", F.lit(1))
    return land.options.select("option_id").join(chosen, "option_id", "left").select("option_id", F.coalesce("value", F.lit(0)).alias("value"))


def evaluation(land: Landscape, selection: DataFrame, criterion: Formula | None = None) -> DataFrame:
    """One row a case: ``case_id, base_pc, pc, base_score, score, cost``."""
    land = land.with_(criterion=criterion or land.criterion)
    paths = terminal_closure(land)
    chosen = R.chosen(selection).select(F.lit("after").alias("scenario_id"), "option_id")
    none = local_frame(land.options.sparkSession, {"scenario_id": ["before", "after"], "option_id": ["", ""]}, "scenario_id string, option_id string")
    scored = cut(scenario_pc(land, chosen.unionByName(none), paths))
    total = _scores(land, scored, "scenario_id").agg(F.max(F.when(F.col("scenario_id") == "before", F.col("score"))).alias("base_score"), F.max(F.when(F.col("scenario_id") == "after", F.col("score"))).alias("score"))
    cases = scored.groupBy("case_id").agg(F.max(F.when(F.col("scenario_id") == "before", F.col("pc"))).alias("base_pc"), F.max(F.when(F.col("scenario_id") == "after", F.col("pc"))).alias("pc"))
    return cases.join(F.broadcast(total)).join(F.broadcast(R.selection_cost(land, selection)))
