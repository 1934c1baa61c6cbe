"""Best paths and what sums over them.

The closure is a fixpoint of joins: only pairs that became better in a round go on, and each round
takes the best way to each pair by a partial maximum before its shuffle.  What is known lies in buckets of pairs:
a round sends only what it reached, is compared bucket by bucket with what is known, and is appended there.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkscape.landscape import Landscape
from linkscape.operators import relational as R
from linkscape.operators import vectors as V
from linkscape.storage import Buckets, cut, cut_counted, local_frame

MAX_ROUNDS = 100_000
#: Rounds whose finds are kept apart before the best of each pair is rewritten.
TURNS = 32
#: Frames of finds that scenarios and witnesses keep apart before they are merged.
PIECES = 6
#: Buckets of arcs that a task holds, hashes tried for a number a vertex, rows sent to all tasks.
WHOLE, MAX_SEEDS, MOST_SENT = 4, 8, 1_000_000
#: Sources that take all arcs of a task, without a look for components.
ALONE = 128


def best_path_closure(arcs: DataFrame, sources: DataFrame, *, scope: tuple[str, ...] = ("case_id",), min_probability: float | None = None, max_hops: int | None = None) -> DataFrame:
    """``scope..., s, t, p``: probability of the most reliable path, itself included with 1; pairs without one are left out.

    ``sources``: ``scope..., vertex_id``.  With ``min_probability`` or ``max_hops`` set, weaker or longer paths are left out, and sums are lower bounds.
    """
    keys = [*scope, "s", "t"]
    steps = cut(arcs.where("probability > 0 and src <> dst").groupBy(*scope, F.col("src").alias("t"), F.col("dst").alias("to")).agg(F.max("probability").alias("q")))
    first = cut(sources.select(*scope, F.col("vertex_id").alias("s"), F.col("vertex_id").alias("t"), F.lit(1.0).alias("p")).distinct())
    # a source reaches itself and at most the heads of its scope's arcs
    heads, starts = steps.groupBy(*scope).agg(F.count_distinct("to").alias("heads")), first.groupBy(*scope).agg(F.count("*").alias("starts"))
    most = starts.join(heads, [*scope], "left").agg(F.sum(F.col("starts").cast("double") * (1 + F.coalesce("heads", F.lit(0))))).first()[0]
    known = Buckets(arcs.sparkSession, keys, most or 0)
    known.append(first)
    try:
        for hop in range(1, MAX_ROUNDS + 1):
            reach = known.last().join(steps, [*scope, "t"]).select(*scope, "s", F.col("to").alias("t"), (F.col("p") * F.col("q")).alias("p"))
            if min_probability is not None:
                reach = reach.where(F.col("p") >= min_probability)
            reach = reach.groupBy(*keys).agg(F.max("p").alias("p"))
            found = known.append(reach.join(known.best(old=F.max("p")), keys, "left").where("old is null or p > old").select(*keys, "p"))
            if not found or hop == max_hops:
                return cut(known.best(p=F.max("p")))
            if known.turns % TURNS == 0:
                known = known.compacted(p=F.max("p"))
    finally:
        known.close()
    raise RuntimeError(f"no end after {MAX_ROUNDS} rounds")


def merged(pieces: list[DataFrame], keys: list[str]) -> DataFrame:
    """The best of each pair over all pieces."""
    if len(pieces) == 1:
        return pieces[0]
    return reduce(DataFrame.unionByName, pieces).groupBy(*keys).agg(F.max("p").alias("p"))


def closure(land: Landscape, **options) -> DataFrame:
    """Best paths from every vertex with source quality."""
    return best_path_closure(land.arcs, R.sources(land.vertices), **options)


def weighted(paths: DataFrame, vertices: DataFrame) -> DataFrame:
    """Paths with the source quality ``a`` of s and the target quality ``b`` of t."""
    a = vertices.select("case_id", F.col("vertex_id").alias("s"), F.col("source_quality").alias("a"))
    b = vertices.select("case_id", F.col("vertex_id").alias("t"), F.col("target_quality").alias("b"))
    return paths.join(a, ["case_id", "s"]).join(b, ["case_id", "t"])


def pc(land: Landscape, paths: DataFrame | None = None) -> DataFrame:
    """``case_id, pc``: source quality times target quality times best probability, over all pairs."""
    paths = closure(land) if paths is None else paths
    return weighted(paths, land.vertices).groupBy("case_id").agg(F.sum(F.col("a") * F.col("b") * F.col("p")).alias("pc"))


def inflow(land: Landscape, paths: DataFrame | None = None) -> DataFrame:
    """``case_id, t, inflow``: source quality that reaches t."""
    paths = closure(land) if paths is None else paths
    return weighted(paths, land.vertices).groupBy("case_id", "t").agg(F.sum(F.col("a") * F.col("p")).alias("inflow"))


def _keyed(land: Landscape, both_ways: bool) -> tuple[DataFrame, DataFrame]:
    """Vertices ``case_id, vertex_id, a, v`` and arcs ``x, y, q``, whose ends are numbers: hashes of what names a vertex, taken anew while two vertices share one."""
    qualities = cut(land.vertices.select("case_id", "vertex_id", F.col("source_quality").alias("a")))
    for seed in range(MAX_SEEDS):
        key = lambda name: F.xxhash64("case_id", name, F.lit(seed)).bitwiseAND(F.lit((1 << 63) - 1))  # noqa: B023, E731
        vertices = qualities.withColumn("v", key("vertex_id"))
        if not vertices.groupBy("v").agg(F.min(F.struct("case_id", "vertex_id")).alias("one"), F.max(F.struct("case_id", "vertex_id")).alias("other")).where("one <> other").limit(1).count():
            arcs = land.arcs.where("probability > 0 and src <> dst").select(key("src").alias("x"), key("dst").alias("y"), F.col("probability").alias("q"))
            return vertices, arcs
    raise RuntimeError(f"two vertices share a number under each of {MAX_SEEDS} hashes")


def inflow_in_blocks(land: Landscape, sources_a_block: int = 1024, *, arcs_a_bucket: int = 500_000, values_a_block: int = 1 << 22, both_ways: bool = False) -> DataFrame:
    """As ``inflow``, for more sources than pairs can be kept for: vectors of probabilities from up to ``sources_a_block`` sources at once.

    Tasks find the components of the arcs they read, and only what joins these is exchanged.  Small components share a part; a part of up to ``WHOLE`` buckets
    of arcs is packed into a row, and each of its runs of sources is worked out in one task.  What lies in larger components goes over buckets.
    With ``both_ways`` each arc also leads back.  Parallel arcs may be there, the best counts.  Probabilities that underflow count as none.
    """
    spark = land.arcs.sparkSession
    vertices, arcs = _keyed(land, both_ways)
    own, n_sources = cut_counted(vertices.where("a > 0").select("v", "a"))
    if not n_sources:
        return local_frame(spark, {"case_id": [], "t": [], "inflow": []}, "case_id string, t string, inflow double")
    # arcs of one start go to one bucket, so that components are found over as few ends as can be; pages are large enough for a list of ends to pay
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    pieces = arcs.mapInArrow(V.dealt(buckets), f"bucket long, {V.PIECES}").repartition(buckets, "bucket")
    arcs, n_arcs = cut_counted(pieces.mapInArrow(V.rooted, "x long, y long, q double, root long"), **{"parquet.page.row.count.limit": V.CHUNK})
    ends = cut(arcs.select(F.explode(F.array("x", "y")).alias("v"), "root").distinct())
    parts = _parts(arcs, ends, n_arcs, n_sources, arcs_a_bucket)
    few = F.broadcast(parts) if parts.count() <= MOST_SENT else parts
    placed = cut(own.join(ends, "v", "left").join(few, "root", "left").select("v", "a", "part", "whole").distinct())
    found = placed.where("part is null").select("v", F.col("a").alias("inflow"))  # no arc meets these
    fed = placed.where("whole").groupBy("part").agg(F.count("*").alias("n")).collect()  # parts have an eighth of a bucket of arcs and more, or are as many as buckets
    if fed:
        row = "part long, v binary, root binary, x binary, y binary, q binary, source binary, a binary"
        # runs of sources as long as gives every core two
        run = V.SLICE * math.ceil(n_sources / (2 * spark.sparkContext.defaultParallelism * V.SLICE))
        runs = [(r["part"], k, min(k + run, r["n"])) for r in fed for k in range(0, r["n"], run)]
        asked = local_frame(spark, {"part": [r[0] for r in runs], "lo": [r[1] for r in runs], "hi": [r[2] for r in runs], "job": list(range(len(runs)))}, "part long, lo long, hi long, job long")
        whole = arcs.join(few.where("whole"), "root").join(F.broadcast(asked), "part", "left_semi").select("part", "x", "y", "q")
        packed = whole.mapInArrow(V.gathered, f"part long, {V.PIECES}").groupBy("part").cogroup(placed.where("whole").select("part", "v", "a").groupBy("part")).applyInArrow(V.packed, row)
        jobs = packed.join(F.broadcast(asked), "part").repartitionById(len(runs), F.col("job").cast("int")).drop("job")
        found = found.union(jobs.mapInArrow(V.inflow_of_parts(both_ways), "v long, inflow double"))
    far = placed.where("not whole").select("v", "a", "part")
    if not far.isEmpty():
        rest = arcs.join(few.where("not whole"), "root").join(far.select("part").distinct(), "part", "left_semi").select("part", "x", "y", "q")
        if both_ways:
            rest = rest.union(rest.select("part", F.col("y").alias("x"), F.col("x").alias("y"), "q"))
        found = found.union(_inflow_over_buckets(cut(rest.groupBy("part", "x", "y").agg(F.max("q").alias("q"))), cut(far), sources_a_block, arcs_a_bucket, values_a_block))
    return cut(found.groupBy("v").agg(F.sum("inflow").alias("inflow"))).join(vertices, "v").select("case_id", F.col("vertex_id").alias("t"), "inflow")


def _parts(arcs: DataFrame, ends: DataFrame, n_arcs: int, n_sources: int, arcs_a_bucket: int) -> DataFrame:
    """``root, part, whole``: where the components of ``arcs`` lie, from ``ends`` (``v, root``: what a task found), and whether that is little enough for a task."""
    if n_sources <= ALONE and n_arcs <= WHOLE * arcs_a_bucket:
        return cut(arcs.select("root", F.lit(0).cast("long").alias("part"), F.lit(True).alias("whole")).distinct())
    from linkscape.operators.simplify import _spread

    roots = ends.groupBy("v").agg(F.array_sort(F.collect_set("root")).alias("r")).where("size(r) > 1")
    links = roots.select(F.col("r")[0].alias("src"), F.explode(F.slice("r", 2, F.size("r"))).alias("dst")).distinct()
    links, n_links = cut_counted(links.union(links.select("dst", "src")).select(F.lit(0).alias("c"), "src", "dst").distinct())
    sizes = cut(arcs.groupBy("root").agg(F.count("*").alias("n")))
    labels = sizes.select("root", F.col("root").alias("label"))
    if n_links:
        spread = _spread(labels.select(F.lit(0).alias("case_id"), F.col("root").alias("vertex_id"), "label"), links)
        labels = cut(spread.select(F.col("vertex_id").alias("root"), "label"))
    whole = sizes.join(labels, "root").groupBy("label").agg(F.sum("n").alias("n"))
    shared = -1 - F.pmod(F.xxhash64("label"), F.lit(max(1, math.ceil(n_arcs / arcs_a_bucket))))
    part = F.when(F.col("n") * 8 >= arcs_a_bucket, F.col("label")).otherwise(shared)
    found = cut(labels.join(whole.select("label", part.alias("part"), "n"), "label").select("root", "label", "part", "n"))
    fits = found.select("label", "part", "n").distinct().groupBy("part").agg((F.sum("n") <= WHOLE * arcs_a_bucket).alias("whole"))
    return cut(found.join(fits, "part").select("root", "part", "whole"))


def _inflow_over_buckets(arcs: DataFrame, own: DataFrame, sources_a_block: int, arcs_a_bucket: int, values_a_block: int) -> DataFrame:
    """``v, inflow`` over arcs ``part, x, y, q`` from sources ``v, a, part`` of components that no task should hold.

    Arcs lie in buckets of the end that has fewer of them.  Vertices whose arcs all lie in one bucket are inner ones; vectors are kept for the others and
    for sources only (hubs).  In a round what got better at hubs goes to their buckets, from there over inner vertices to other hubs, and the best of all
    buckets is compared with what is known.  At the end each bucket sums over its inner vertices, whose pairs are never written.
    A block holds about ``values_a_block`` values, and sources of one part stand together.
    """
    spark, n_sources = arcs.sparkSession, own.count()
    width = 1 << min(sources_a_block.bit_length() - 1, (n_sources - 1).bit_length())
    degrees = cut(arcs.select("part", F.explode(F.array("x", "y")).alias("v")).groupBy("part", "v").agg(F.count("*").alias("degree")))
    parts, n_arcs = degrees.select("v", "part"), arcs.count()
    end = lambda name, degree: degrees.select(F.col("v").alias(name), F.col("degree").alias(degree))
    lying = arcs.join(end("x", "m"), "x").join(end("y", "n"), "y").select("part", "x", "y", "q", F.when((F.col("m") < F.col("n")) | ((F.col("m") == F.col("n")) & (F.col("x") < F.col("y"))), F.col("x")).otherwise(F.col("y")).alias("owner"))
    counts = cut(arcs.groupBy("part").agg(F.ceil(F.count("*") / arcs_a_bucket).alias("buckets")))
    arcs = cut(lying.join(counts, "part").select("part", F.xxhash64("part", F.pmod(F.xxhash64("owner"), F.col("buckets"))).alias("bucket"), "x", "y", "q"))
    at = cut(arcs.select("bucket", F.explode(F.array("x", "y")).alias("v")).distinct())
    hubs, n_hubs = cut_counted(at.groupBy("v").agg(F.count("*").alias("n")).where("n > 1").select("v").union(own.select("v")).distinct())
    mirrors = cut(at.join(hubs, "v"))
    most = hubs.join(parts, "v").groupBy("part").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    bits = min(width.bit_length() - 1, max(1, values_a_block // most).bit_length() - 1)
    width = 1 << bits
    # places of sources: sorted by part, a block is a run of them
    placed = cut(cut(own.orderBy("part", "v")).withColumn("id", F.monotonically_increasing_id()))
    placed = placed.select("v", "a", "part", F.shiftright("id", bits).alias("g"), F.col("id").bitwiseAND(width - 1).cast("int").alias("place"))
    groups = cut(placed.select("part", "g").distinct())
    marked = arcs.join(hubs.select(F.col("v").alias("x"), F.lit(True).alias("x_hub")), "x", "left").join(hubs.select(F.col("v").alias("y"), F.lit(True).alias("y_hub")), "y", "left")
    marked = marked.select("part", "bucket", "x", "y", "q", F.coalesce("x_hub", F.lit(False)).alias("x_hub"), F.coalesce("y_hub", F.lit(False)).alias("y_hub"))
    ways = Buckets(spark, ["g", "bucket"])
    try:
        ways.append(marked.join(groups, "part").drop("part"))
        row = "g long, v long, p binary"
        known = cut(placed.select("g", "v", "place").mapInArrow(V.units(width), row))
        news, by = known, ["g", "bucket"]
        shelf = F.pmod(F.xxhash64("v"), F.lit(max(1, math.ceil(n_arcs / arcs_a_bucket)))).alias("shelf")
        weights = cut(placed.select("g", "place", "a").groupBy("g").applyInArrow(V.weights(width), "g long, w binary"))
        for _ in range(MAX_ROUNDS):
            sent = news.join(mirrors, "v").select("g", "bucket", "v", "p")
            came = ways.rows().groupBy(*by).cogroup(sent.groupBy(*by)).applyInArrow(V.carried(width), row)
            rows = known.withColumn("old", F.lit(True)).unionByName(came.withColumn("old", F.lit(False)))
            merged_rows = rows.withColumn("shelf", shelf).groupBy("g", "shelf").applyInArrow(V.best(width), f"{row}, news binary")
            after, n = cut_counted(merged_rows, F.col("news").isNotNull())
            known, news = after.drop("news"), after.where("news is not null").select("g", "v", F.col("news").alias("p"))
            if not n:
                break
        else:
            raise RuntimeError(f"no end after {MAX_ROUNDS} rounds")
        sums = known.join(weights, "g").mapInArrow(V.totals(width), "v long, inflow double")
        every = known.join(mirrors, "v").select("g", "bucket", "v", "p").union(groups.join(arcs.select("part", "bucket").distinct(), "part").join(weights, "g").select("g", "bucket", F.lit(-1).cast("long"), "w"))
        inner = ways.rows().groupBy(*by).cogroup(every.groupBy(*by)).applyInArrow(V.inner_totals(width), "v long, inflow double")
        found = cut(sums.union(inner).groupBy("v").agg(F.sum("inflow").alias("inflow")))
    finally:
        ways.close()
    return found


def target_contribution(land: Landscape, paths: DataFrame | None = None) -> DataFrame:
    """``case_id, t, contribution``: a target's part of the score."""
    paths = closure(land) if paths is None else paths
    return weighted(paths, land.vertices).groupBy("case_id", "t").agg(F.sum(F.col("a") * F.col("p") * F.col("b")).alias("contribution"))


def potentials(land: Landscape, paths: DataFrame | None = None) -> DataFrame:
    """``case_id, t, u, potential``: what a unit of source quality at u adds through t."""
    paths = best_path_closure(land.arcs, land.vertices.select("case_id", "vertex_id")) if paths is None else paths
    b = land.vertices.where("target_quality > 0").select("case_id", F.col("vertex_id").alias("t"), F.col("target_quality").alias("b"))
    return paths.join(b, ["case_id", "t"]).select("case_id", "t", F.col("s").alias("u"), (F.col("b") * F.col("p")).alias("potential"))


def improved_inflow(land: Landscape) -> DataFrame:
    """Inflow if all options were taken: no selection brings more."""
    return inflow(land.with_(vertices=R.fully_improved_vertices(land), arcs=R.fully_improved_arcs(land)))


def budgeted_inflow(land: Landscape, budget: float) -> DataFrame:
    """``case_id, t, bound``: inflow over fully improved arcs with own qualities, plus the source gains that fit the budget, the last one in part.

    The fractional fill is at least what any selection within the budget brings.
    """
    paths = best_path_closure(R.fully_improved_arcs(land), R.sources(R.fully_improved_vertices(land)))
    base = weighted(paths, land.vertices).groupBy("case_id", "t").agg(F.sum(F.col("a") * F.col("p")).alias("base"))
    gains = R.vertices_by_option(land).where("source_gain > 0").withColumnRenamed("vertex_id", "s")
    gains = paths.join(gains, ["case_id", "s"]).groupBy("case_id", "t", "option_id").agg(F.sum(F.col("p") * F.col("source_gain")).alias("gain"))
    filled = fractional_fill(gains.join(land.options, "option_id"), ["case_id", "t"], budget)
    return base.join(filled, ["case_id", "t"], "left").select("case_id", "t", (F.col("base") + F.coalesce("filled", F.lit(0.0))).alias("bound"))


def fractional_fill(gains: DataFrame, by: list[str], budget: float) -> DataFrame:
    """``by..., filled``: the most gain that ``budget`` buys if options could be bought in part; free options count whole."""
    from pyspark.sql import Window as W

    ratio = F.when(F.col("cost") > 0, F.try_divide("gain", "cost")).otherwise(F.lit(float("inf")))
    before = W.partitionBy(*by).orderBy(F.desc("ratio"), "option_ord").rowsBetween(W.unboundedPreceding, -1)
    ranked = gains.withColumn("ratio", ratio).withColumn("left", F.lit(float(budget)) - F.coalesce(F.sum("cost").over(before), F.lit(0.0)))
    share = F.when(F.col("cost") == 0, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide("left", "cost"))))
    return ranked.groupBy(*by).agg(F.sum(F.col("gain") * share).alias("filled"))
