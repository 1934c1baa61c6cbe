"""Smaller landscapes with the same scores, and what arcs can never or must always carry."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkscape.landscape import Landscape
from linkscape.operators import relational as R
from linkscape.storage import Buckets, cut, cut_counted

ROUNDS = 10_000
#: Trimming steps before each colouring, finds kept apart before they are merged, and hops kept apart before the best of each vertex is rewritten.
TRIMS, PIECES, TURNS = 1_000, 100, 32
#: Step of the integer lengths, and the probability that stands for none.
GRAIN = 1e-8
#: Later than any arrival: lengths are below 2**31.
NEVER = 1 << 62
#: What an arc's race can show.
KINDS = ("strong", "useless")


def _jumped(ways: DataFrame) -> DataFrame:
    """``case_id, way, vertex_id, to, low, ring`` of pointers ``case_id, way, vertex_id, to, low``, one a vertex and way: followed to where they leave the table, with the least ``low`` on the way.

    Each round follows twice as many pointers at once.  Pointers in a ring never leave; ``low`` is that of the whole ring when a round lowers it nowhere, as stretches of equal length laid end to end go round it.
    """
    now = cut(ways.withColumn("ring", F.lit(True)))
    for _ in range(64):
        onward = now.select("case_id", "way", F.col("vertex_id").alias("to"), F.col("to").alias("further"), F.col("low").alias("below"))
        least, left = F.least("low", "below"), F.col("further").isNull()
        after = now.join(onward, ["case_id", "way", "to"], "left").select(
            "case_id", "way", "vertex_id", F.coalesce("further", "to").alias("to"), least.alias("low"), F.col("further").isNotNull().alias("ring"), ((F.col("ring") & left) | (least < F.col("low"))).alias("news")
        )
        after, news = cut_counted(after, F.col("news"))
        now = after.drop("news")
        if not news:
            return now
    raise RuntimeError("pointers did not settle")


def _sole(links: DataFrame, end: str, other: str) -> DataFrame:
    """``case_id, vertex_id, to``: the ``other`` ends of links whose ``end`` has just one."""
    return links.groupBy(F.col("c").alias("case_id"), F.col(end).alias("vertex_id")).agg(F.min(other).alias("to"), F.max(other).alias("most")).where("to = most").drop("most")


def _spread(labels: DataFrame, arcs: DataFrame) -> DataFrame:
    """Smallest label that reaches each vertex of ``labels`` (``case_id, vertex_id, label``) along ``arcs`` (``c, src, dst``, distinct, no loops).

    A vertex with one way in takes what its parent has, so whole trees, paths and rings fold into where they hang, with rounds that grow with the
    logarithm of their length; again as long as that takes a tenth of the vertices.  Labels spread hop by hop over what is left, each hop appended to what is known.
    """
    keys = ["case_id", "vertex_id"]
    (left, n), links, folds = cut_counted(labels), arcs, []
    while True:
        ways = _sole(links, "dst", "src").join(left, keys).select("case_id", F.lit("in").alias("way"), "vertex_id", "to", F.col("label").alias("low"))
        ways, m = cut_counted(ways)
        if m:
            fold = _jumped(ways).drop("way")
            folds.append(fold)
            tails = fold.select(F.col("case_id").alias("c"), F.col("vertex_id").alias("src"), "to", "low", "ring")
            onward = cut(links.join(fold.select(F.col("case_id").alias("c"), F.col("vertex_id").alias("dst")), ["c", "dst"], "left_anti").join(tails, ["c", "src"], "left"))
            brought = onward.where("low is not null").groupBy(F.col("c").alias("case_id"), F.col("dst").alias("vertex_id")).agg(F.min("low").alias("brought"))
            left, rest = cut_counted(left.join(fold, keys, "left_anti").join(brought, keys, "left").select(*keys, F.least("label", "brought").alias("label")))
            links, more = cut_counted(onward.where("ring is null or not ring").select("c", F.coalesce("to", "src").alias("src"), "dst").where("src <> dst").distinct())
        else:
            rest, more = n, links.limit(1).count()
        if not more or m * 10 < n:
            break
        n = rest
    known = left
    if more:
        reached = Buckets(labels.sparkSession, keys, rest)
        try:
            reached.append(left)
            for _ in range(ROUNDS):
                now = reached.last()
                came = now.join(links, (now["case_id"] == links["c"]) & (now["vertex_id"] == links["src"])).groupBy("case_id", F.col("dst").alias("vertex_id")).agg(F.min("label").alias("label"))
                if not reached.append(came.join(reached.best(old=F.min("label")), keys).where("label < old").select(*keys, "label")):
                    break
                if reached.turns % TURNS == 0:
                    reached = reached.compacted(label=F.min("label"))
            else:
                raise RuntimeError("labels did not settle")
            known = cut(reached.best(label=F.min("label")))
        finally:
            reached.close()
    for fold in reversed(folds):
        anchors = known.select("case_id", F.col("vertex_id").alias("to"), "label")
        known = cut(known.unionByName(fold.join(anchors, ["case_id", "to"], "left").select(*keys, F.when(F.col("ring"), F.col("low")).otherwise(F.least("low", "label")).alias("label"))))
    return known


def strong_components(vertices: DataFrame, arcs: DataFrame) -> DataFrame:
    """``case_id, vertex_id, component``: strongly connected components, named by their smallest vertex.

    Each round takes off the vertices without a live arc in or none out, which are components of their own, and folds chains of vertices with one way in and
    one out into one arc by pointer jumping, so that rivers and rings need rounds by the logarithm of their length.  Where neither finds anything, what is left is coloured, every
    vertex with the smallest one that reaches it; of each colour, what reaches its root again is a component.  A folded chain belongs to its ends' component if they share one; else its vertices stand alone.
    """
    keys = ["case_id", "vertex_id"]
    left = cut(vertices.select(*keys).distinct())
    links = cut(arcs.where("src <> dst").select(F.col("case_id").alias("c"), "src", "dst").distinct())
    pieces, folds, trims = [left.limit(0).withColumn("component", F.col("vertex_id"))], [], 0
    at = lambda df, end: df.select(F.col("case_id").alias("c"), F.col("vertex_id").alias(end))
    for _ in range(ROUNDS):
        if left.isEmpty():
            break
        live = cut(links.join(at(left, "src"), ["c", "src"], "left_semi").join(at(left, "dst"), ["c", "dst"], "left_semi").select("c", "src", "dst"))
        kept = cut(live.select(F.col("c").alias("case_id"), F.col("src").alias("vertex_id")).intersect(live.select(F.col("c").alias("case_id"), F.col("dst").alias("vertex_id"))))
        single, n = cut_counted(left.join(kept, keys, "left_anti").select(*keys, F.col("vertex_id").alias("component")))
        left, links, trims = kept, live, trims + 1
        if n:
            pieces.append(single)
            links = cut(live.join(at(single, "src"), ["c", "src"], "left_anti").join(at(single, "dst"), ["c", "dst"], "left_anti").select("c", "src", "dst"))
        onward, back = _sole(links, "src", "dst"), _sole(links, "dst", "src")
        ways = onward.join(back.drop("to"), keys, "left_semi").withColumn("way", F.lit("out")).unionByName(back.join(onward.drop("to"), keys, "left_semi").withColumn("way", F.lit("in")))
        ways, m = cut_counted(ways.select("case_id", "way", "vertex_id", "to", F.col("vertex_id").alias("low")))
        if m:
            far = _jumped(ways)
            pieces.append(far.where("ring and way = 'out'").select(*keys, F.col("low").alias("component")))
            ends = lambda way, name: far.where(F.col("way") == way).where("not ring").select(*keys, F.col("to").alias(name))
            chain = cut(ends("in", "head").join(ends("out", "tail"), keys))
            folds.append(chain)
            inner = ways.where("way = 'out'").select(*keys)
            left = cut(left.join(inner, keys, "left_anti"))
            outer = links.join(at(inner, "src"), ["c", "src"], "left_anti").join(at(inner, "dst"), ["c", "dst"], "left_anti").select("c", "src", "dst")
            links = cut(outer.unionByName(chain.where("head <> tail").select(F.col("case_id").alias("c"), F.col("head").alias("src"), F.col("tail").alias("dst"))).distinct())
        if (n or m) and trims % TRIMS:
            continue
        colour = _spread(left.withColumn("label", F.col("vertex_id")), links)
        named = lambda end, name: colour.select(F.col("case_id").alias("c"), F.col("vertex_id").alias(end), F.col("label").alias(name))
        inside = links.join(named("src", "x"), ["c", "src"]).join(named("dst", "y"), ["c", "dst"]).where("x = y")
        back = cut(inside.select("c", F.col("dst").alias("src"), F.col("src").alias("dst")))
        reach = _spread(colour.select(*keys, F.when(F.col("vertex_id") == F.col("label"), 0).otherwise(1).alias("label")), back)
        found = cut(colour.join(reach.where("label = 0"), keys, "left_semi").select(*keys, F.col("label").alias("component")))
        pieces.append(found)
        if len(pieces) > PIECES:
            pieces = [cut(reduce(DataFrame.unionByName, pieces))]
        left = cut(left.join(found, keys, "left_anti"))
    else:
        raise RuntimeError("components did not settle")
    known = cut(reduce(DataFrame.unionByName, pieces))
    if not folds:
        return known
    for chain in reversed(folds):
        end = lambda name, part: known.select("case_id", F.col("vertex_id").alias(name), F.col("component").alias(part))
        lying = chain.join(end("head", "x"), ["case_id", "head"]).join(end("tail", "y"), ["case_id", "tail"])
        known = cut(known.unionByName(lying.select(*keys, F.when(F.col("x") == F.col("y"), F.col("x")).otherwise(F.col("vertex_id")).alias("component"))))
    names = known.groupBy("case_id", "component").agg(F.min("vertex_id").alias("name"))
    return cut(known.join(names, ["case_id", "component"]).select(*keys, F.col("name").alias("component")))


def lossless_components(land: Landscape) -> DataFrame:
    """Components over arcs of probability exactly 1."""
    return strong_components(land.vertices, land.arcs.where("probability = 1"))


def contract_lossless(land: Landscape) -> Landscape:
    """One vertex for each lossless component, named by its members joined with ``+``: qualities add up, arcs inside go with their improvements. Scores stay."""
    found = lossless_components(land)
    names = found.groupBy("case_id", "component").agg(F.array_join(F.array_sort(F.collect_list("vertex_id")), "+").alias("name"))
    names = cut(found.join(names, ["case_id", "component"]).select("case_id", "vertex_id", "name"))
    end = lambda c: names.select("case_id", F.col("vertex_id").alias(c), F.col("name").alias(f"{c}_name"))
    vertices = land.vertices.join(names, ["case_id", "vertex_id"]).groupBy("case_id", F.col("name").alias("vertex_id")).agg(F.sum("source_quality").alias("source_quality"), F.sum("target_quality").alias("target_quality"))
    arcs = land.arcs.join(end("src"), ["case_id", "src"]).join(end("dst"), ["case_id", "dst"]).where("src_name <> dst_name").select("case_id", "arc_id", F.col("src_name").alias("src"), F.col("dst_name").alias("dst"), "probability")
    gains = land.vertex_improvements.join(names, ["case_id", "vertex_id"]).select("case_id", F.col("name").alias("vertex_id"), "option_id", "source_gain", "target_gain")
    return land.with_(vertices=vertices, arcs=arcs, vertex_improvements=gains, arc_improvements=land.arc_improvements.join(arcs, ["case_id", "arc_id"], "left_semi"))


def drop_unfed(land: Landscape) -> Landscape:
    """Without vertices that no (possible) source quality reaches, and their arcs and improvements."""
    fed = R.sources(land.vertices).select("case_id", "vertex_id").unionByName(land.vertex_improvements.where("source_gain > 0").select("case_id", "vertex_id")).distinct()
    usable = R.fully_improved_arcs(land).where("probability > 0").select(F.col("case_id").alias("c"), "src", "dst").distinct()
    usable = cut(usable.where("src <> dst"))
    labels = land.vertices.select("case_id", "vertex_id").distinct().join(fed.withColumn("label", F.lit(0)), ["case_id", "vertex_id"], "left")
    reached = _spread(labels.select("case_id", "vertex_id", F.coalesce("label", F.lit(1)).alias("label")), usable).where("label = 0").drop("label")
    end = lambda c: reached.withColumnRenamed("vertex_id", c)
    arcs = land.arcs.join(end("src"), ["case_id", "src"], "left_semi").join(end("dst"), ["case_id", "dst"], "left_semi").select(land.arcs.columns)
    return land.with_(
        vertices=land.vertices.join(reached, ["case_id", "vertex_id"], "left_semi"), arcs=arcs,
        vertex_improvements=land.vertex_improvements.join(reached, ["case_id", "vertex_id"], "left_semi"), arc_improvements=land.arc_improvements.join(arcs, ["case_id", "arc_id"], "left_semi"),
    )


def _length(p):
    return F.floor(-F.log(F.greatest(p, F.lit(GRAIN))) / F.log1p(F.lit(GRAIN))).cast("long")


def _race(arcs: DataFrame, seeds: DataFrame, settled: DataFrame | None = None) -> DataFrame:
    """``case_id, mu, arc_id, kind, vertex_id, wave, dist``: who reaches each vertex first without the arc in question, for each penalty and kind of race. Wave 0 wins ties.

    Nothing moves into a vertex of ``settled`` (``case_id, mu, arc_id, kind, vertex_id``). Races of all kinds share their rounds. Labels are set for good: a round closes every open vertex that nothing still open can reach sooner, as
    what comes later must leave an open vertex of its wave by an arc and enter by one.  Only what a round closes moves on, once for each vertex, so that arcs times reached vertices bound the rows of all rounds,
    a wave that loses a vertex never spreads from it, and cycles of length zero do no harm.
    """
    race, keys = ["case_id", "mu", "arc_id", "kind"], ["case_id", "mu", "arc_id", "kind", "vertex_id"]
    steps = cut(arcs.select("case_id", "mu", F.col("arc_id").alias("via"), F.col("src").alias("vertex_id"), F.col("dst").alias("to"), "base", "best"))
    leave = steps.groupBy("case_id", "mu", "vertex_id").agg(F.min("best").alias("out0"), F.min("base").alias("out1"))
    enter = steps.groupBy("case_id", "mu", F.col("to").alias("vertex_id")).agg(F.min("best").alias("in0"), F.min("base").alias("in1"))
    bounds = cut(leave.join(enter, ["case_id", "mu", "vertex_id"], "full"))
    first = lambda df: df.groupBy(*keys).agg(F.min(F.struct("dist", "wave")).alias("s")).select(*keys, "s.dist", "s.wave")
    at = lambda w: F.when(F.col("wave") == w, F.col("dist"))
    # an arc's race of a kind closes at most the ends of the arcs under its penalty
    each = bounds.groupBy("case_id", "mu").agg(F.count("*").alias("ends")).join(steps.groupBy("case_id", "mu").agg(F.count("*").alias("races")), ["case_id", "mu"])
    most = each.agg(F.sum(len(KINDS) * F.col("ends").cast("double") * F.col("races"))).first()[0]
    waiting, closed = cut(first(seeds)), Buckets(arcs.sparkSession, keys, most or 0)
    try:
        for _ in range(ROUNDS):
            known = waiting.join(bounds, ["case_id", "mu", "vertex_id"], "left")
            limits = known.groupBy(*race).agg(*[F.min(at(w)).alias(f"d{w}") for w in (0, 1)], *[F.min(at(w) + F.col(f"out{w}")).alias(f"l{w}") for w in (0, 1)])
            final = F.lit(True)
            for w in (0, 1):
                soonest = F.greatest(F.coalesce(f"l{w}", F.lit(NEVER)), F.coalesce(F.col(f"d{w}") + F.col(f"in{w}"), F.lit(NEVER)))
                final = final & ((F.col("dist") < soonest) | ((F.col("dist") == soonest) & (F.col("wave") <= w)))
            marked = cut(known.join(limits, race).select(*keys, "dist", "wave", final.alias("final")))
            closed.append(marked.where("final").select(*keys, "dist", "wave"))
            length = F.when(F.col("wave") == 1, F.col("base")).otherwise(F.col("best"))
            moved = closed.last().join(steps, ["case_id", "mu", "vertex_id"]).where("via <> arc_id").select(*race, F.col("to").alias("vertex_id"), (F.col("dist") + length).alias("dist"), "wave")
            moved = first(moved).join(closed.rows().select(*keys), keys, "left_anti")
            if settled is not None:
                moved = moved.join(settled, keys, "left_anti")
            waiting, n = cut_counted(first(marked.where("not final").select(moved.columns).unionByName(moved)))
            if not n:
                return cut(closed.rows().select(*keys, "wave", "dist"))
    finally:
        closed.close()
    raise RuntimeError("race did not settle")


def _penalties(land: Landscape, raised: DataFrame, n: int) -> DataFrame:
    """``case_id, mu``: 0, and ``n`` + 1 numbers in geometric steps from the least to the most that a unit of cost can be worth in length."""
    worth = raised.where("share > 0 and gained > 0").groupBy("case_id").agg(F.min(1 / F.col("share")).alias("least"), F.max(F.col("gained") / F.col("share")).alias("most"))
    series = F.transform(F.sequence(F.lit(0), F.lit(n)), lambda k: F.col("least") * F.pow(F.greatest(F.col("most") / F.col("least"), F.lit(1.0)), k / n))
    none = land.vertices.select("case_id").distinct().withColumn("mu", F.lit(0.0))
    return none.unionByName(worth.select("case_id", F.explode(series).alias("mu"))).distinct()


def _raised(land: Landscape) -> DataFrame:
    """``case_id, arc_id, share, improved, gained``: for each improvement of an arc its part of the option's cost, its length and what it saves."""
    best = R.arcs_by_option(land).join(land.options.select("option_id", "cost"), "option_id")
    arcs_of = best.groupBy("case_id", "option_id").agg(F.count_distinct("arc_id").alias("n"))
    base, improved = _length(F.col("probability")), _length(F.col("improved_probability"))
    return best.join(arcs_of, ["case_id", "option_id"]).select("case_id", "arc_id", (F.col("cost") / F.col("n")).alias("share"), improved.alias("improved"), (base - improved).alias("gained"))


def _carried_race(arcs: DataFrame, seeds: DataFrame) -> DataFrame:
    """``case_id, arc_id, kind, vertex_id`` that wave 1 wins under some penalty, in rising order of these: a vertex once won is settled, nothing
    moves into it under later penalties, and wave 1 starts from it too, as late as the penalty says.

    All penalties race at once, again and again with what they then know of lower ones, until nothing changes: each pass settles at
    least one more penalty for good, and mostly two or three passes do.
    """
    keys = ["case_id", "arc_id", "kind", "vertex_id"]
    late = arcs.select("case_id", "mu", "late").distinct()
    settled, more, before = None, seeds, None
    for _ in range(ROUNDS):
        won = _race(arcs, more, settled).where("wave = 1").join(late, ["case_id", "mu"])
        known = won.select(*keys, F.struct("mu", (F.col("dist") - F.col("late")).alias("own")).alias("x"))
        first = cut(known.groupBy(*keys).agg(F.min("x").alias("x")))
        state = first.agg(F.count("*"), F.sum(F.xxhash64(*keys, "x").cast("decimal(38,0)"))).first()
        if state == before:
            return first.select(*keys)
        before = state
        later = cut(first.join(late, "case_id").where(F.col("mu") > F.col("x.mu")).select("case_id", "mu", "arc_id", "kind", "vertex_id", (F.col("x.own") + F.col("late")).alias("dist")))
        settled = later.drop("dist")
        more = seeds.unionByName(later.select("case_id", "mu", "arc_id", "kind", "vertex_id", "dist", F.lit(1).alias("wave")))
    raise RuntimeError("penalties did not settle")


def arc_criticality(land: Landscape, budget: float | None = None, *, n_penalties: int = 10) -> DataFrame:
    """``case_id, arc_id, t, kind``: ``strong`` if the arc wins the race from its tail to target t in every scenario of improvements, ``useless`` if it never does.

    Without a budget the scenarios are all selections.  With one they are those that cost at most ``budget``, which makes more arcs critical:
    for penalties mu, improving an arc costs mu times the option's cost, shared by its arcs, in length, so that a path's length less mu * budget is at most what it
    is under any selection within the budget; the wave that must win starts mu * budget late.  A win under any penalty counts, and is carried on to the higher ones (``_carried_race``).
    """
    base, raised = _length(F.col("probability")), cut(_raised(land))
    mus = cut(_penalties(land, raised, n_penalties)) if budget is not None else land.vertices.select("case_id").distinct().withColumn("mu", F.lit(0.0))
    late = F.floor(F.col("mu") * float(budget or 0.0)).cast("long")
    shortest = raised.join(mus, "case_id").groupBy("case_id", "mu", "arc_id").agg(F.min(F.col("improved") + F.floor(F.col("mu") * F.col("share")).cast("long")).alias("improved"))
    arcs = land.arcs.select("case_id", "arc_id", "src", "dst", base.alias("base")).join(mus, "case_id").join(shortest, ["case_id", "mu", "arc_id"], "left")
    arcs = cut(arcs.select("case_id", "mu", "arc_id", "src", "dst", "base", F.least("base", F.coalesce("improved", "base")).alias("best"), late.alias("late")))

    def seed(kind: str, v: str, dist, wave: int) -> DataFrame:
        return arcs.select("case_id", "mu", "arc_id", F.lit(kind).alias("kind"), F.col(v).alias("vertex_id"), dist.cast("long").alias("dist"), F.lit(wave).alias("wave"))

    strong = seed("strong", "dst", F.col("base") + F.col("late"), 1).unionByName(seed("strong", "src", F.lit(0), 0))
    useless = seed("useless", "src", F.col("late"), 1).unionByName(seed("useless", "dst", F.col("best"), 0))
    seeds = strong.unionByName(useless)
    won = _carried_race(arcs, seeds) if budget is not None else _race(arcs, seeds).where("wave = 1")
    targets = land.vertices.where("target_quality > 0").select("case_id", "vertex_id").unionByName(land.vertex_improvements.where("target_gain > 0").select("case_id", "vertex_id")).distinct()
    return won.join(targets, ["case_id", "vertex_id"], "left_semi").select("case_id", "arc_id", F.col("vertex_id").alias("t"), "kind").distinct()


def prune_for_targets(land: Landscape, critical: DataFrame, targets: DataFrame) -> DataFrame:
    """``case_id, t, arc_id, src, dst, probability``: for each target (``case_id, t``) the arcs that can carry something to it: no useless ones, none out of t."""
    per = land.arcs.join(targets.select("case_id", "t").distinct(), "case_id").where("src <> t")
    return per.join(critical.where("kind = 'useless'"), ["case_id", "arc_id", "t"], "left_anti").select("case_id", "t", "arc_id", "src", "dst", "probability")


def contract_strong(land: Landscape, critical: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per target, vertices and arcs after moving the tails of strong, not improvable arcs to where these lead.

    Vertices ``case_id, t, vertex_id, source_quality``; arcs as of ``prune_for_targets``. At most one arc a tail; chains multiply, worked out by pointer jumping.
    """
    kept = cut(prune_for_targets(land, critical, targets))
    fixed = critical.where("kind = 'strong'").join(land.arc_improvements, ["case_id", "arc_id"], "left_anti")
    hops = kept.join(fixed, ["case_id", "arc_id", "t"], "left_semi").where("src <> t").groupBy("case_id", "t", F.col("src").alias("u")).agg(F.min(F.struct("arc_id", "dst", "probability")).alias("a"))
    jump = cut(hops.select("case_id", "t", "u", F.col("a.dst").alias("to"), F.col("a.probability").alias("q")))
    for _ in range(64):
        onward = jump.select("case_id", "t", F.col("u").alias("to"), F.col("to").alias("next"), F.col("q").alias("q2"))
        joined = jump.join(onward, ["case_id", "t", "to"], "left")
        after = cut(joined.select("case_id", "t", "u", F.coalesce("next", "to").alias("to"), (F.col("q") * F.coalesce("q2", F.lit(1.0))).alias("q"), F.col("next").isNotNull().alias("moved")))
        ended = after.where("moved").isEmpty()
        jump = after.drop("moved")
        if ended:
            break
    own = land.vertices.join(targets.select("case_id", "t").distinct(), "case_id").select("case_id", "t", F.col("vertex_id").alias("u"), "source_quality")
    moved = own.join(jump, ["case_id", "t", "u"], "left")
    vertices = moved.groupBy("case_id", "t", F.coalesce("to", "u").alias("vertex_id")).agg(F.sum(F.col("source_quality") * F.coalesce("q", F.lit(1.0))).alias("source_quality"))
    arcs = kept.join(jump.select("case_id", "t", F.col("u").alias("src")), ["case_id", "t", "src"], "left_anti")
    arcs = arcs.join(jump.select("case_id", "t", F.col("u").alias("dst"), "to", "q"), ["case_id", "t", "dst"], "left")
    arcs = arcs.select("case_id", "t", "arc_id", "src", F.coalesce("to", "dst").alias("dst"), (F.col("probability") * F.coalesce("q", F.lit(1.0))).alias("probability")).where("src <> dst")
    return vertices, arcs


def option_bound_scores(land: Landscape, potentials: DataFrame, limits: DataFrame) -> DataFrame:
    """``option_id, score``: at most what an option adds to the sum of all cases, given ``potentials`` of the present selection and ``limits`` (``case_id, t, inflow`` if all options were taken)."""
    rho = potentials.select("case_id", "t", "u", "potential")
    most = limits.select("case_id", F.col("t").alias("src"), F.col("inflow").alias("most"))
    arcs = R.arcs_by_option(land).join(most, ["case_id", "src"])
    at_head = arcs.join(rho.select("case_id", "t", F.col("u").alias("dst"), F.col("potential").alias("head")), ["case_id", "dst"])
    tails = rho.select("case_id", "t", F.col("u").alias("src"), F.col("potential").alias("tail"))
    gain = at_head.join(tails, ["case_id", "t", "src"], "left").select("option_id", (F.col("most") * F.greatest(F.lit(0.0), F.col("improved_probability") * F.col("head") - F.coalesce("tail", F.lit(0.0)))).alias("part"))
    ends = R.vertices_by_option(land)
    direct = ends.join(most.withColumnRenamed("src", "vertex_id"), ["case_id", "vertex_id"]).select("option_id", (F.col("most") * F.col("target_gain")).alias("part"))
    fed = ends.join(rho.withColumnRenamed("u", "vertex_id"), ["case_id", "vertex_id"]).select("option_id", (F.col("source_gain") * F.col("potential")).alias("part"))
    return gain.unionByName(direct).unionByName(fed).groupBy("option_id").agg(F.sum("part").alias("score"))
