"""Landscapes from a manifest and files, and results to files."""

from __future__ import annotations

import json
import posixpath
import re
from functools import reduce
from urllib.parse import unquote, urlsplit

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkscape.functions.criterion import parse
from linkscape.landscape import SCHEMAS, Landscape
from linkscape.operators.validation import PLACE, checked
from linkscape.storage import cut, local_frame

#: Logical column names of a manifest's tables and ours.
COLUMNS = {
    "options": {"id": "option_id", "cost": "cost"},
    "vertices": {"id": "vertex_id", "source_quality": "source_quality", "target_quality": "target_quality"},
    "arcs": {"id": "arc_id", "from": "src", "to": "dst", "probability": "probability"},
    "vertices_improvements": {"vertex_id": "vertex_id", "option_id": "option_id", "source_quality_gain": "source_gain", "target_quality_gain": "target_gain"},
    "arcs_improvements": {"arc_id": "arc_id", "option_id": "option_id", "improved_probability": "improved_probability"},
}
_NUMBERS = {"cost", "source_quality", "target_quality", "probability", "source_gain", "target_gain", "improved_probability"}


def _typed(df: DataFrame, table: str, aliases: dict[str, str], keep: tuple[Column, ...] = ()) -> DataFrame:
    """Physical columns under our names and types, and ``keep``; one physical column may serve several; others are left out."""
    missing = [aliases.get(k, k) for k in COLUMNS[table] if aliases.get(k, k) not in df.columns]
    if missing:
        raise ValueError(f"{table}: no column {', '.join(missing)}")
    return df.select(*[F.col(f"`{aliases.get(k, k)}`").cast("double" if v in _NUMBERS else "string").alias(v) for k, v in COLUMNS[table].items()], *keep)


def read_table(spark: SparkSession, table: str, spec, folder: str) -> DataFrame:
    """One table: ``{csv_file|parquet_file, csv_columns}`` or rows in place; None is empty."""
    if spec is None:
        ddl = ", ".join(f"{v} {'double' if v in _NUMBERS else 'string'}" for v in COLUMNS[table].values())
        return spark.createDataFrame([], ddl)
    if isinstance(spec, list):
        names = list(COLUMNS[table])
        rows = F.from_json(F.lit(json.dumps(spec)), "array<struct<" + ", ".join(f"`{n}`: string" for n in names) + ">>")
        return _typed(spark.range(1).select(F.inline(rows)), table, {})
    path = spec.get("csv_file") or spec["parquet_file"]
    path = _absolute(path, folder)
    df = spark.read.csv(path, header=True, inferSchema=False) if "csv_file" in spec else spark.read.parquet(path)
    aliases = spec.get("csv_columns", {})
    if table != "options":
        return _typed(df, table, aliases)
    if "option_ord" in df.columns:
        return _typed(df, table, aliases, (F.col("option_ord").cast("long").alias("option_ord"), _place()))
    # a file's blocks may be read in any order: sorted by file, block and place in the block, and numbered once
    placed = _typed(df, table, aliases, (_place(),)).orderBy(PLACE)
    return cut(placed.withColumn("option_ord", F.monotonically_increasing_id()))


def _place() -> Column:
    """Where a row stands: its file, block, and a number that rises in the block."""
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id")).alias(PLACE)


def _absolute(path: str, folder: str) -> str:
    return path if re.match(r"^(/|\w+:)", path) else posixpath.join(folder, path)


def read_cases(spark: SparkSession, table: str, specs: dict[str, dict | list | None], folder: str) -> DataFrame:
    """One table of all cases, ``case_id`` first: CSV files whose names of columns and heads agree are one scan, however many cases there are; a file's case is found by its path.

    A file may serve several cases. One job reads the heads of all files.
    """
    parts, files = [], {}
    for case, spec in sorted(specs.items()):
        if isinstance(spec, dict) and "csv_file" in spec:
            files.setdefault(json.dumps(spec.get("csv_columns", {}), sort_keys=True), {}).setdefault(_absolute(spec["csv_file"], folder), []).append(case)
        elif spec is not None:
            parts.append(read_table(spark, table, spec, folder).select(F.lit(case).alias("case_id"), "*"))
    for aliases, paths in files.items():
        lines = spark.read.text(list(paths)).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), "value")
        heads = lines.where("block = 0").groupBy("file").agg(F.min_by("value", "id").alias("head")).collect()  # one row a file
        plain = {unquote(urlsplit(p).path).rstrip("/"): cases for p, cases in paths.items()}
        alike: dict[str, list[tuple[str, str]]] = {}
        for file, head in heads:
            at = unquote(urlsplit(file).path)
            while at not in plain and at != posixpath.dirname(at):
                at = posixpath.dirname(at)
            alike.setdefault(head, []).extend((file, case) for case in plain[at])
        for own in alike.values():
            df = spark.read.csv(sorted({unquote(f) for f, _ in own}), header=True, inferSchema=False)
            cases = local_frame(spark, {"file": [f for f, _ in own], "case_id": [c for _, c in own]}, "file string, case_id string")
            typed = _typed(df, table, json.loads(aliases), (_place(),)).withColumn("file", F.col(PLACE)["file"])
            parts.append(typed.join(cases, "file").select("case_id", *COLUMNS[table].values(), PLACE))
    if not parts:
        parts.append(read_table(spark, table, None, folder).select(F.lit(None).cast("string").alias("case_id"), "*"))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def read_landscape(spark: SparkSession, manifest: str) -> Landscape:
    """The landscape a JSON manifest describes; relative paths start at its folder.

    Wrong ranges, unknown names and repeated ids raise an error that names file and row. Options without ``option_ord`` are ordered as they stand in their file or list.
    """
    rows = spark.read.text(manifest, wholetext=True).collect()  # one small file
    data, folder = json.loads(rows[0][0]), posixpath.dirname(manifest)
    options = read_table(spark, "options", data["options"], folder)
    if "option_ord" not in options.columns:
        options = options.withColumn("option_ord", F.monotonically_increasing_id())
    named = {"vertices": "vertices", "arcs": "arcs", "vertices_improvements": "vertex_improvements", "arcs_improvements": "arc_improvements"}
    tables = {ours: read_cases(spark, name, {case: spec.get(name) for case, spec in data["cases"].items()}, folder) for name, ours in named.items()}
    options = options.select("option_id", "option_ord", "cost", *[c for c in options.columns if c == PLACE])
    land = Landscape(options, **tables, criterion=parse(data["criterion"]) if "criterion" in data else None)
    return checked(land)


def write_landscape(land: Landscape, folder: str) -> str:
    """CSV files and a manifest; gives the manifest's path."""
    folder = folder.rstrip("/")
    back = {t: {v: k for k, v in c.items()} for t, c in COLUMNS.items()}
    land.options.withColumnRenamed("option_id", "id").coalesce(1).write.csv(f"{folder}/options", header=True)
    manifest: dict = {"options": {"csv_file": "options"}, "cases": {}}
    named = {"vertices": land.vertices, "arcs": land.arcs, "vertices_improvements": land.vertex_improvements, "arcs_improvements": land.arc_improvements}
    for case in [r[0] for r in land.vertices.select("case_id").distinct().orderBy("case_id").collect()]:
        spec = {}
        for table, df in named.items():
            at = f"{case}_{table}"
            df.where(F.col("case_id") == case).select(*[F.col(v).alias(k) for v, k in back[table].items()]).write.csv(f"{folder}/{at}", header=True)
            spec[table] = {"csv_file": at}
        manifest["cases"][case] = spec
    land.options.sparkSession.range(1).select(F.lit(json.dumps(manifest)).alias("value")).coalesce(1).write.text(f"{folder}/manifest")
    return f"{folder}/manifest"


def read_selection(spark: SparkSession, report: str) -> DataFrame:
    """``option_id, value`` from the ``solution`` map of a report."""
    rows = spark.read.text(report, wholetext=True).select(F.from_json("value", "solution map<string, int>").alias("r"))
    return rows.select(F.explode("r.solution").alias("option_id", "value"))


def selection_rows(options: DataFrame, selection: DataFrame) -> DataFrame:
    """A row for every option, 0 where the selection has none."""
    return options.join(selection.select("option_id", "value"), "option_id", "left").select("option_id", F.coalesce("value", F.lit(0)).cast("int").alias("value"))


def write_selection(options: DataFrame, selection: DataFrame, path: str) -> None:
    selection_rows(options, selection).write.csv(path, header=True)


def report(land: Landscape, selection: DataFrame, evaluation: DataFrame, *, algorithm: str, budget: float, seconds: float) -> DataFrame:
    """One row: algorithm, time, scores and case scores before and after, budget, cost, and the selection as a map (bounded by the number of options)."""
    cases = evaluation.agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("case_id", "base_pc")))).alias("initial_cases"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("case_id", "pc")))).alias("solution_cases"),
        F.max("base_score").alias("initial_score"), F.max("score").alias("solution_score"), F.max("cost").alias("cost"),
    )
    chosen = selection_rows(land.options, selection).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("option_id", "value")))).alias("solution"))
    return cases.join(F.broadcast(chosen)).select(F.lit(algorithm).alias("algorithm"), F.lit(float(seconds)).alias("time"), F.lit(float(budget)).alias("budget"), "*")
