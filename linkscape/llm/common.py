"""What several operators of this subpackage share: reading tables, cutting lineage, connected components."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkscape.storage import cut


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder; any path that Spark's readers open will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def apart(df: DataFrame, *names: str) -> list[str]:
    """Names for columns to add, none of which ``df`` has: underscores are put before those it has."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


@contextmanager
def rows_at_once(spark: SparkSession, n: int):
    """While frames are written in it, wide rows go to Python ``n`` at a time."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, n)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Connected components of an undirected edge list: ``node, component`` with the smallest node as component, for every node of an edge.

    Alternating large-star and small-star rounds: each keeps at most as many edges as it
    got and none is collected.  A node's neighbourhood is reduced by a partial ``min``
    before its shuffle; the join back has one row a node on the reduced side, so a node with
    very many edges can be split by adaptive execution.
    """
    x, y = F.col(a), F.col(b)
    now = cut(edges.where(x.isNotNull() & y.isNotNull() & (x != y)).select(F.greatest(x, y).alias("hi"), F.least(x, y).alias("lo")).distinct())
    before = None
    for _ in range(max_rounds):
        state = now.agg(F.count("*"), F.sum(F.hash("hi", "lo").cast("decimal(38,0)"))).first()
        if state[0] == 0 or state == before:
            break
        before = state
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(now.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        lowest = large.groupBy("hi").agg(F.min("lo").alias("m"))
        joined = large.join(lowest, "hi")
        small = joined.where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).unionByName(lowest.select("hi", F.col("m").alias("lo")))
        now = cut(small.where("hi <> lo").distinct())
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(roots)
