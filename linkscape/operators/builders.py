"""Landscapes from raw cell, link and cross-reference tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Levels of classes of one value, and of those without an end on some side.
POINT, ENDLESS = -5_000, 5_000


def _suffixed(c: str, end: str) -> Column:
    return F.concat(F.col(c), F.lit(end))


def split_cells(cells: DataFrame, split: str = "sqrt") -> tuple[DataFrame, DataFrame]:
    """Vertices and arcs of cells ``id, quality, probability``: each becomes a centre with an entrance and an exit.

    ``sqrt``: both arcs get the root of the probability, so crossing costs all of it; ``full``: both get all of it.
    """
    if split not in ("sqrt", "full"):
        raise ValueError(split)
    p = F.sqrt("probability") if split == "sqrt" else F.col("probability")
    kinds = F.array(F.struct(F.lit("").alias("end"), F.col("quality").alias("q")), F.struct(F.lit("_in").alias("end"), F.lit(0.0).alias("q")), F.struct(F.lit("_out").alias("end"), F.lit(0.0).alias("q")))
    vertices = cells.select("id", F.explode(kinds).alias("k")).select(F.concat("id", "k.end").alias("vertex_id"), F.col("k.q").alias("source_quality"), F.col("k.q").alias("target_quality"))
    ends = F.array(F.struct(_suffixed("id", "_in").alias("src"), F.col("id").alias("dst")), F.struct(F.col("id").alias("src"), _suffixed("id", "_out").alias("dst")))
    arcs = cells.select(p.alias("probability"), F.explode(ends).alias("e")).select(F.concat_ws(">", "e.src", "e.dst").alias("arc_id"), "e.src", "e.dst", "probability")
    return vertices, arcs


def _neighbour_arcs(pairs: DataFrame) -> DataFrame:
    src, dst = _suffixed("a", "_out"), _suffixed("b", "_in")
    return pairs.select(F.concat_ws(">", src, dst).alias("arc_id"), src.alias("src"), dst.alias("dst"), F.lit(1.0).alias("probability"))


def grid_adjacency(cells: DataFrame) -> DataFrame:
    """Arcs of probability 1 between exits and entrances of the four neighbours of cells ``id, x, y``."""
    offsets = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in ((1, 0), (-1, 0), (0, 1), (0, -1))])
    around = cells.select(F.col("id").alias("a"), "x", "y", F.explode(offsets).alias("o")).select("a", (F.col("x") + F.col("o.dx")).alias("x"), (F.col("y") + F.col("o.dy")).alias("y"))
    return _neighbour_arcs(around.join(cells.select(F.col("id").alias("b"), "x", "y"), ["x", "y"]))


def link_adjacency(links: DataFrame, cells: DataFrame) -> DataFrame:
    """Both arcs of every undirected link ``a, b`` whose ends are cells."""
    ids = cells.select("id")
    known = links.select("a", "b").join(ids.withColumnRenamed("id", "a"), "a", "left_semi").join(ids.withColumnRenamed("id", "b"), "b", "left_semi").select("a", "b")
    return _neighbour_arcs(known.unionByName(known.select(F.col("b").alias("a"), F.col("a").alias("b"))))


def land_cover(cells: DataFrame, classes: DataFrame) -> DataFrame:
    """Cells ``id, value`` with the row of ``classes`` (``low, high`` inclusive, and any values) that their value lies in; classes must not overlap.

    A class is cut at multiples of the power of two next above its width, which gives two or three bins; a cell looks into its own bin of each
    width that occurs, and the range is tested there.  So any number of classes, of any widths, is joined by equal keys.  Nulls and classes whose ends are crossed match nothing.
    """
    low, high, value = (F.col(c).cast("double") for c in ("low", "high", "value"))
    width = high - low
    level = F.when(width == 0, F.lit(POINT)).when(width < float("inf"), F.ceil(F.log2(width)).cast("int")).otherwise(F.lit(ENDLESS))
    size = F.pow(F.lit(2.0), -F.col("_level"))
    at = lambda x: F.when(F.col("_level") == POINT, x).when(F.col("_level") == ENDLESS, F.lit(0.0)).otherwise(F.rint(x * size - F.pmod(x * size, F.lit(1.0))))
    usable = classes.where("low <= high").withColumn("_level", level)
    levels = sorted(r[0] for r in usable.select("_level").distinct().collect())  # a few, at most one for each exponent that a double can have
    ends = F.array_distinct(F.array(at(low), at(low) + 1, at(high)))
    binned = usable.withColumn("_bin", F.explode(F.filter(ends, lambda x: x <= at(high))))
    asking = cells.withColumn("_level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>"))).withColumn("_bin", at(value))
    return asking.join(binned, ["_level", "_bin"]).where((F.col("value") >= F.col("low")) & (F.col("value") <= F.col("high"))).drop("low", "high", "_level", "_bin")


def stepwise(value: Column, steps: list[tuple[float, float]], last: float) -> Column:
    """The result of the first step ``(up to, result)`` that ``value`` does not exceed, else ``last``."""
    found = None
    for bound, result in steps:
        found = F.when(value <= bound, result) if found is None else found.when(value <= bound, result)
    return F.lit(last) if found is None else found.otherwise(last)


def crossing_probability(cost: Column, steps: list[tuple[float, float]], last: float, road: Column, road_coefficient: dict[str, float], distance: float) -> Column:
    """Stepwise probability of a cost, times a coefficient for the kind of road, to the power of the distance coefficient."""
    factor = F.lit(1.0)
    for kind, k in sorted(road_coefficient.items()):
        factor = F.when(road == kind, k).otherwise(factor)
    return F.pow(stepwise(cost, steps, last) * factor, F.lit(float(distance)))


def aggregate_cells(cells: DataFrame, by: str, *, flags: list[str], built_up: str | None = None, built_up_probability: float = 0.0, as_written: bool = False) -> DataFrame:
    """Coarse cells: mean of ``x, y, quality``, largest of the flags, geometric mean of ``probability`` (0 if any is 0).

    A coarse cell with the ``built_up`` flag gets ``built_up_probability``, unless ``as_written``, where that rule never takes effect.
    """
    mean = F.when(F.min("probability") <= 0, F.lit(0.0)).otherwise(F.exp(F.avg(F.log(F.when(F.col("probability") > 0, F.col("probability"))))))
    out = cells.groupBy(by).agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.avg("quality").alias("quality"), *[F.max(f).alias(f) for f in flags], mean.alias("probability"))
    if built_up and not as_written:
        out = out.withColumn("probability", F.when(F.col(built_up) > 0, F.lit(built_up_probability)).otherwise(F.col("probability")))
    return out


def distance_decay(arcs: DataFrame, lengths: DataFrame, *, median: float = 300.0, kept: float = 0.8) -> DataFrame:
    """Arcs ``arc_id, src, dst, blocked`` with ``probability`` halving every ``median`` of the ends' lengths (``vertex_id, length``), 0 where blocked, and ``improved_probability`` for blocked ones."""
    of = lambda c: lengths.select(F.col("vertex_id").alias(c), F.col("length").alias(f"{c}_length"))
    decay = F.exp(-(F.col("src_length") + F.col("dst_length")) * F.log(F.lit(2.0)) / median)
    joined = arcs.join(of("src"), "src").join(of("dst"), "dst")
    return joined.select("arc_id", "src", "dst", F.when(F.col("blocked"), 0.0).otherwise(decay).alias("probability"), F.when(F.col("blocked"), decay * kept).alias("improved_probability"))


def neighbour_max(cells: DataFrame, links: DataFrame, flag: str) -> DataFrame:
    """``id`` and the largest ``flag`` of the cell and the cells it is linked with."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    around = both.join(cells.select(F.col("id").alias("b"), F.col(flag).alias("f")), "b").groupBy(F.col("a").alias("id")).agg(F.max("f").alias("f"))
    return cells.join(around, "id", "left").select("id", F.greatest(F.col(flag), F.coalesce("f", F.col(flag))).alias(flag))


def options_from_reference(reference: DataFrame, cells: DataFrame, qualifies: Column) -> tuple[DataFrame, DataFrame]:
    """Options ``option_id, cost`` of a table ``option_id, id``: cost is the number of known cells; and ``option_id, id`` of cells that qualify."""
    met = reference.select("option_id", "id").distinct().join(cells.drop("option_id"), "id")
    return met.groupBy("option_id").agg(F.count("*").cast("double").alias("cost")), met.where(qualifies).select("option_id", "id")


def options_from_cells(cells: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Options, vertex gains and arc improvements of cells ``id, option_id, cost, gain, improved_probability``: costs add up over an option's cells."""
    own = cells.where("option_id is not null")
    options = own.groupBy("option_id").agg(F.sum("cost").alias("cost"))
    gains = own.where("gain > 0").select(F.col("id").alias("vertex_id"), "option_id", F.col("gain").alias("source_gain"), F.col("gain").alias("target_gain"))
    ids = F.array(F.concat_ws(">", _suffixed("id", "_in"), F.col("id")), F.concat_ws(">", F.col("id"), _suffixed("id", "_out")))
    arcs = own.where("improved_probability is not null").select(F.explode(ids).alias("arc_id"), "option_id", F.sqrt("improved_probability").alias("improved_probability"))
    return options, gains, arcs


def in_area(cells: DataFrame, area: str) -> DataFrame:
    """Cells whose area flag is 1."""
    return cells.where(F.col(area) == 1)
