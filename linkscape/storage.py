"""Cutting lineage: frames written to the folder all executors share, and read back."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


#: Keys that lie in one bucket.
FEW = 100_000


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where that is unset, a temporary one in local mode, as in tests, and an error on a cluster, whose executors would not see it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def cut(df: DataFrame, **options) -> DataFrame:
    """``df`` from files: an iterative plan starts anew, and a lost executor costs only its own tasks. ``options`` are those of the Parquet writer."""
    path = f"{shared_folder(df.sparkSession)}/linkscape-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_counted(df: DataFrame, of: Column | None = None, **options) -> tuple[DataFrame, int]:
    """``cut`` and the number of rows, or of those with ``of``, counted while they are written."""
    seen = Observation()
    found = cut(df.observe(seen, F.count_if(F.lit(True) if of is None else of).alias("n")), **options)
    return found, seen.get["n"]


class Buckets:
    """Rows that only grow, in the shared folder: what is appended is hashed by ``keys`` into as many buckets as the session shuffles to, so that joins and groups by these keys need no exchange of what is there.

    Where ``rows`` bounds the keys there can be and these are few, there is one bucket: each is a file a turn and a task a scan, however little lies in it. Numbers between are no use, as Spark exchanges what has fewer buckets than it shuffles to.
    Only tables of the catalog have buckets: its name for these files lasts until ``close``, after which no frame that reads them may be run.
    """

    def __init__(self, spark: SparkSession, keys: list[str], rows: float | None = None):
        self.spark, self.keys, self.most, self.turns = spark, keys, rows, 0
        self.name = f"linkscape_{uuid.uuid4().hex}"
        self.path = f"{shared_folder(spark)}/{self.name}"
        self.n = 1 if rows is not None and rows <= FEW else int(spark.conf.get("spark.sql.shuffle.partitions"))

    def append(self, df: DataFrame) -> int:
        """Adds the rows of ``df`` as one turn; gives their number."""
        seen = Observation()
        turn = df.observe(seen, F.count(F.lit(1)).alias("n")).withColumn("turn", F.lit(self.turns))
        turn.write.mode("append").format("parquet").partitionBy("turn").bucketBy(self.n, *self.keys).option("path", self.path).saveAsTable(self.name)
        self.turns += 1
        return seen.get["n"]

    def rows(self) -> DataFrame:
        return self.spark.table(self.name).drop("turn")

    def last(self) -> DataFrame:
        """The rows of the last turn."""
        return self.spark.table(self.name).where(F.col("turn") == self.turns - 1).drop("turn")

    def best(self, **columns: Column) -> DataFrame:
        """One row for each key over all turns."""
        return self.rows().groupBy(*self.keys).agg(*[c.alias(name) for name, c in columns.items()])

    def compacted(self, **columns: Column) -> "Buckets":
        """The best of each key in one turn and what the last turn found in another; closes this one."""
        fewer = Buckets(self.spark, self.keys, self.most)
        fewer.append(self.best(**columns))
        fewer.append(self.last().select(*self.keys, *columns))
        self.close()
        return fewer

    def close(self) -> None:
        """Out of the catalog; the files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def local_frame(spark: SparkSession, columns: dict[str, list], schema: str) -> DataFrame:
    """A few rows of the driver as a frame, by way of Arrow (no Python worker reads them)."""
    import pyarrow as pa

    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64()}
    named = [x.split() for x in schema.split(", ")]
    return spark.createDataFrame(pa.table([pa.array(columns[n], kinds[k]) for n, k in named], names=[n for n, _ in named]))
