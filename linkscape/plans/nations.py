"""Landscapes made from the trade tables, on which queries run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from linkscape.landscape import Landscape
from linkscape.storage import cut

BUDGET = 40.0
#: Suppliers (two numbers each) that are sent to every task rather than line items to them.
SENT = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nation_landscape(spark: SparkSession, sf_dir: str, by_segment: bool = False) -> Landscape:
    """Nations linked by where their suppliers' goods go most; with ``by_segment`` one case for each market segment."""
    t = lambda name: table(spark, sf_dir, name)
    case = F.col("c_mktsegment") if by_segment else F.lit("all")
    customers = t("customer").select("c_custkey", F.col("c_nationkey").alias("dst"), case.alias("case_id"))
    suppliers = t("supplier").select("s_suppkey", F.col("s_nationkey").alias("src"))
    sellers_of = F.broadcast(suppliers) if suppliers.count() <= SENT else suppliers
    # line items, the most rows, are shuffled once, with their nation: to orders that know theirs
    sold = t("lineitem").select("l_orderkey", "l_suppkey").join(sellers_of, F.col("l_suppkey") == F.col("s_suppkey")).select("l_orderkey", "src")
    bought = t("orders").select("o_orderkey", "o_custkey").join(customers, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "case_id", "dst")
    flow = sold.join(bought, F.col("l_orderkey") == F.col("o_orderkey")).where("src <> dst").groupBy("case_id", "src", "dst").agg(F.count("*").alias("n"))
    flow = flow.withColumn("rank", F.row_number().over(W.partitionBy("case_id", "src").orderBy(F.desc("n"), "dst"))).where("rank <= 3")
    flow = cut(flow.select("case_id", "src", "dst", "rank"))
    text = lambda c: F.col(c).cast("string")
    arc_id = F.concat_ws("-", text("src"), text("dst")).alias("arc_id")
    arcs = flow.select("case_id", arc_id, text("src").alias("src"), text("dst").alias("dst"), F.pow(F.lit(2.0), -F.col("rank")).alias("probability"))
    cases = customers.select("case_id").distinct()
    sellers = suppliers.groupBy("src").agg(F.count("*").alias("a"))
    buyers = customers.groupBy("case_id", "dst").agg(F.count("*").alias("b"))
    nations = t("nation").select("n_nationkey", "n_regionkey")
    grid = nations.join(F.broadcast(cases))  # 25 nations, at most five cases
    vertices = grid.join(sellers, F.col("n_nationkey") == F.col("src"), "left").join(buyers.withColumnRenamed("case_id", "c"), (F.col("n_nationkey") == F.col("dst")) & (F.col("case_id") == F.col("c")), "left")
    vertices = vertices.select("case_id", text("n_nationkey").alias("vertex_id"), F.coalesce("a", F.lit(0)).cast("double").alias("source_quality"), F.coalesce("b", F.lit(0)).cast("double").alias("target_quality"))
    by_nation = nations.select(F.concat(F.lit("n"), text("n_nationkey")).alias("option_id"), F.col("n_nationkey").cast("long").alias("option_ord"), (3 + F.col("n_nationkey") % 4).cast("double").alias("cost"))
    by_region = t("region").select(F.concat(F.lit("r"), text("r_regionkey")).alias("option_id"), (F.col("r_regionkey") + 25).cast("long").alias("option_ord"), F.lit(14.0).alias("cost"))
    gains = grid.select("case_id", text("n_nationkey").alias("vertex_id"), F.concat(F.lit("n"), text("n_nationkey")).alias("option_id"), F.lit(1.0).alias("source_gain"), F.lit(2.0).alias("target_gain"))
    into = flow.join(nations, F.col("dst") == F.col("n_nationkey")).withColumn("improved_probability", F.lit(0.5))
    raised = into.select("case_id", arc_id, F.concat(F.lit("n"), text("dst")).alias("option_id"), "improved_probability")
    raised = raised.unionByName(into.where("rank >= 2").select("case_id", arc_id, F.concat(F.lit("r"), text("n_regionkey")).alias("option_id"), "improved_probability"))
    return Landscape(by_nation.unionByName(by_region), cut(vertices), arcs, gains, cut(raised))


def part_supplier_landscape(spark: SparkSession, sf_dir: str) -> Landscape:
    """Parts linked to suppliers by line items, an arc each: the large, sparse case. Parallel arcs are left, as only the best counts; every arc is meant both ways."""
    lines = table(spark, sf_dir, "lineitem")
    text = lambda kind, name: F.concat(F.lit(kind), F.col(name).cast("string"))
    arc_id = F.concat_ws("-", "l_orderkey", "l_linenumber")
    arcs = lines.select(F.lit("ps").alias("case_id"), arc_id.alias("arc_id"), text("p", "l_partkey").alias("src"), text("s", "l_suppkey").alias("dst"), F.pow(F.lit(2.0), -(1 + F.col("l_linenumber"))).alias("probability"))
    ends = lambda kind, name, a, b: lines.select(name).distinct().select(F.lit("ps").alias("case_id"), text(kind, name).alias("vertex_id"), F.lit(a).alias("source_quality"), F.lit(b).alias("target_quality"))
    empty = lambda ddl: spark.createDataFrame([], ddl)
    from linkscape.landscape import SCHEMAS

    vertices = ends("s", "l_suppkey", 1.0, 0.0).unionByName(ends("p", "l_partkey", 0.0, 1.0))
    return Landscape(empty(SCHEMAS["options"]), vertices, arcs, empty(SCHEMAS["vertex_improvements"]), empty(SCHEMAS["arc_improvements"]))
