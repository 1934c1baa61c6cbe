"""Registered queries and the SQL each is held against.

Landscapes are made from the trade tables (``nations``); cell tables for the builders come from ``events``: an
event is a cell, 128 to a row.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkscape.functions import criterion as C
from linkscape.landscape import Landscape
from linkscape.operators import builders as L
from linkscape.operators import closure as G
from linkscape.operators import relational as R
from linkscape.operators import scenarios as X
from linkscape.operators import selection as B
from linkscape.operators import simplify as M
from linkscape.operators import validation as V
from linkscape.plans import oracles as O
from linkscape.plans.nations import BUDGET, nation_landscape, part_supplier_landscape, table
from linkscape.sources import files as S
from linkscape.storage import cut, local_frame, shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return register


def on_nations(name: str, sql: str | None = None, by_segment: bool = False):
    """A query that is a function of the nation landscape."""

    def register(f):
        query(name, sql)(lambda spark, sf_dir: f(nation_landscape(spark, sf_dir, by_segment)))
        return f

    return register


def _picked(land: Landscape, ids: tuple[str, ...]) -> DataFrame:
    return local_frame(land.options.sparkSession, {"option_id": list(ids), "value": [1] * len(ids)}, "option_id string, value int")


PICKED = ("n2", "n3", "n7", "r1", "r3")
PICKED_SQL = "(" + ", ".join(f"'{x}'" for x in PICKED) + ")"
N, D = f"WITH {O.landscape()}\n", O.base() + "\n"
N5, D5 = f"WITH {O.landscape(True)}\n", O.base(True) + "\n"

# --- sources and sinks: the landscape written as CSV with a manifest, and read back


def _reread(spark: SparkSession, sf_dir: str) -> Landscape:
    return S.read_landscape(spark, S.write_landscape(nation_landscape(spark, sf_dir), f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"))


query("s1_read_landscape", D + "SELECT x.case_id, sum(x.a * y.b * d.p) AS pc FROM d JOIN vx x ON d.s = x.v JOIN vx y ON d.t = y.v GROUP BY 1")(lambda spark, d: G.pc(_reread(spark, d)))
query("s2_options", N + "SELECT option_id, cost FROM op")(lambda spark, d: _reread(spark, d).options.select("option_id", "cost"))
query("s3_vertices", N + "SELECT case_id, v AS vertex_id, a AS source_quality, b AS target_quality FROM vx")(lambda spark, d: _reread(spark, d).vertices)
query("s4_arcs", N + "SELECT case_id, arc_id, src, dst, p AS probability FROM ax")(lambda spark, d: _reread(spark, d).arcs)
query("s5_vertex_improvements", N + "SELECT * FROM vi")(lambda spark, d: _reread(spark, d).vertex_improvements.select("case_id", "vertex_id", "option_id", "source_gain", "target_gain"))
query("s6_arc_improvements", N + "SELECT case_id, arc_id, option_id, q AS improved_probability FROM ai")(lambda spark, d: _reread(spark, d).arc_improvements.select("case_id", "arc_id", "option_id", "improved_probability"))


@query("s7_inline_rows", "SELECT CAST(n_nationkey AS VARCHAR) AS option_id, CAST(n_regionkey AS DOUBLE) AS cost FROM nation")
def _inline(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [{"id": str(r[0]), "cost": r[1]} for r in table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey").collect()]
    return S.read_table(spark, "options", rows, "")


@query("s8_column_aliases", "SELECT CAST(c_custkey AS VARCHAR) AS vertex_id, CAST(c_nationkey AS DOUBLE) AS source_quality, CAST(c_nationkey AS DOUBLE) AS target_quality FROM customer")
def _aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.read_table(spark, "vertices", {"parquet_file": f"{sf_dir}/customer.parquet", "csv_columns": {"id": "c_custkey", "source_quality": "c_nationkey", "target_quality": "c_nationkey"}}, sf_dir)


def _report(spark: SparkSession, sf_dir: str) -> tuple[Landscape, DataFrame]:
    land = nation_landscape(spark, sf_dir)
    chosen = B.selection_of(land, list(PICKED))
    return land, S.report(land, chosen, B.evaluation(land, chosen), algorithm="picked", budget=BUDGET, seconds=0.0)


@query("s9_saved_selection", N + f"SELECT option_id, CAST(option_id IN {PICKED_SQL} AS INTEGER) AS value FROM op")
def _saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/report-{uuid.uuid4().hex}"
    _report(spark, sf_dir)[1].coalesce(1).write.json(path)
    return S.read_selection(spark, path)


@query("k1_selection_rows", N + f"SELECT option_id, CAST(option_id IN {PICKED_SQL} AS INTEGER) AS value FROM op")
def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    land, path = nation_landscape(spark, sf_dir), f"{shared_folder(spark)}/selection-{uuid.uuid4().hex}"
    S.write_selection(land.options, _picked(land, PICKED), path)
    return spark.read.schema("option_id string, value int").csv(path, header=True)


query("k2_report")(lambda spark, d: _report(spark, d)[1])


@query("k2_report_read_back", O.scenarios(f"SELECT 'some' AS scenario_id, option_id FROM op WHERE option_id IN {PICKED_SQL}") + ",\n" + O.closure("f", "ax", "vx") + f""",
z AS (SELECT sum(x.a * y.b * f.p) AS pc FROM f JOIN vx x ON f.s = x.v JOIN vx y ON f.t = y.v)
SELECT 'picked' AS algorithm, CAST(40 AS DOUBLE) AS budget, (SELECT sum(cost) FROM op WHERE option_id IN {PICKED_SQL}) AS cost, round(z.pc, 6) AS initial_score, round(sp.pc, 6) AS solution_score,
  option_id, CAST(option_id IN {PICKED_SQL} AS INTEGER) AS value FROM op, z, sp""")
def _report_read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report as a reader of its file finds it, a row for each option."""
    path = f"{shared_folder(spark)}/report-{uuid.uuid4().hex}"
    _report(spark, sf_dir)[1].coalesce(1).write.json(path)
    read = spark.read.schema("algorithm string, budget double, cost double, initial_score double, solution_score double, solution map<string, int>").json(path)
    return read.select("algorithm", "budget", "cost", F.round("initial_score", 6).alias("initial_score"), F.round("solution_score", 6).alias("solution_score"), F.explode("solution").alias("option_id", "value"))

# --- checks and profiles


def _broken(land: Landscape) -> Landscape:
    """Some wrong rows by rule: negative costs, unknown arcs, a repeated option."""
    options = land.options.withColumn("cost", F.when(F.col("cost") == 5, -1.0).otherwise(F.col("cost")))
    return land.with_(options=options.unionByName(options.where("option_id = 'n1'")), arcs=land.arcs.where("src <> '3'"))


on_nations("v1_domain", N + "SELECT 'options' AS \"table\", option_id AS key, 'cost >= 0' AS rule FROM op WHERE cost = 5 UNION ALL SELECT 'options', 'n1', 'cost >= 0' FROM op WHERE option_id = 'n1' AND cost = 5")(lambda land: V.domain_violations(_broken(land)))
on_nations("v2_references", N + "SELECT 'arc_improvements' AS \"table\", ai.arc_id AS key, 'unknown arc' AS rule FROM ai JOIN ax USING (arc_id) WHERE src = '3'")(lambda land: V.reference_violations(_broken(land)))
on_nations("v3_duplicates", "SELECT 'options' AS \"table\", 'n1' AS key, 'duplicate' AS rule")(lambda land: V.duplicate_keys(_broken(land)))
on_nations("v4_profile", N5 + """SELECT case_id, count(*) AS n_vertices, (SELECT count(DISTINCT vertex_id) FROM vi WHERE vi.case_id = vx.case_id) AS n_improvable_vertices, count(*) FILTER (a > 0 OR b > 0) AS n_habitat,
  (SELECT count(*) FROM ax WHERE ax.case_id = vx.case_id) AS n_arcs, (SELECT count(DISTINCT arc_id) FROM ai WHERE ai.case_id = vx.case_id) AS n_improvable_arcs, (SELECT count(*) FROM op) AS n_options, (SELECT count(*) FROM cases) AS n_cases FROM vx GROUP BY case_id""", True)(V.profile)
on_nations("v5_budget_share", N + "SELECT round(40.0 / sum(cost) * 100, 9) AS percent FROM op")(lambda land: V.budget_share(land, BUDGET).select(F.round("percent", 9).alias("percent")))

# --- filters, joins, unions
on_nations("p1_affordable", N + "SELECT option_id, cost FROM op WHERE cost <= 5")(lambda land: R.affordable(land, 5.0).options.select("option_id", "cost"))
on_nations("p2_sources", N + "SELECT case_id, v AS vertex_id FROM vx WHERE a > 0")(lambda land: R.sources(land.vertices).select("case_id", "vertex_id"))
on_nations("p3_vertices_by_option", N + "SELECT case_id, option_id, vertex_id, sum(source_gain) AS source_gain, sum(target_gain) AS target_gain FROM vi GROUP BY 1, 2, 3")(R.vertices_by_option)
on_nations("p4_arcs_by_option", N + "SELECT ai.case_id, option_id, arc_id, src, dst, p AS probability, max(q) AS improved_probability FROM ai JOIN ax USING (case_id, arc_id) GROUP BY 1, 2, 3, 4, 5, 6")(R.arcs_by_option)
on_nations("p5_improved_vertices", N + f"SELECT case_id, v AS vertex_id, a + coalesce(x, 0) AS source_quality, b + coalesce(y, 0) AS target_quality FROM vx LEFT JOIN (SELECT vertex_id, sum(source_gain) AS x, sum(target_gain) AS y FROM vi WHERE option_id IN {PICKED_SQL} GROUP BY 1) ON vertex_id = v")(lambda land: R.improved_vertices(land, _picked(land, PICKED)))
on_nations("p6_improved_arcs", N + f"SELECT case_id, arc_id, src, dst, greatest(p, coalesce(q, 0)) AS probability FROM ax LEFT JOIN (SELECT arc_id, max(q) AS q FROM ai WHERE option_id IN {PICKED_SQL} GROUP BY 1) USING (arc_id)")(lambda land: R.improved_arcs(land, _picked(land, PICKED)))
on_nations("p7_parallel_arcs", N + "SELECT case_id, arc_id, src, dst, NULL AS option_id, p AS probability FROM ax UNION ALL SELECT ax.case_id, arc_id, src, dst, option_id, q FROM ax JOIN ai USING (arc_id)")(R.parallel_arcs)
on_nations("p8_fully_improved_arcs", N + "SELECT case_id, arc_id, src, dst, greatest(p, coalesce(q, 0)) AS probability FROM ax LEFT JOIN (SELECT arc_id, max(q) AS q FROM ai GROUP BY 1) USING (arc_id)")(R.fully_improved_arcs)
on_nations("p9_fully_improved_vertices", N + "SELECT case_id, v AS vertex_id, a + 1 AS source_quality, b + 2 AS target_quality FROM vx")(R.fully_improved_vertices)
on_nations("p10_reversed_arcs", N + "SELECT case_id, arc_id, dst AS src, src AS dst, p AS probability FROM ax")(lambda land: R.reversed_arcs(land.arcs))
on_nations("p11_selection_cost", N + f"SELECT sum(cost) AS cost FROM op WHERE option_id IN {PICKED_SQL}")(lambda land: R.selection_cost(land, _picked(land, PICKED)))

# --- paths
JOINED = "FROM d JOIN vx x ON d.case_id = x.case_id AND d.s = x.v JOIN vx y ON d.case_id = y.case_id AND d.t = y.v"
ALL = O.scenarios("SELECT 'all' AS scenario_id, option_id FROM op")
SOME = O.scenarios(f"SELECT 'some' AS scenario_id, option_id FROM op WHERE option_id IN {PICKED_SQL}")
on_nations("g1_closure", D + "SELECT d.case_id, s, t, p FROM d JOIN vx ON d.s = vx.v WHERE a > 0")(G.closure)
on_nations("g2_pc", D + f"SELECT d.case_id, sum(x.a * y.b * d.p) AS pc {JOINED} GROUP BY 1")(G.pc)
on_nations("g3_pc_of_selection", SOME + "SELECT case_id, pc FROM sp")(lambda land: G.pc(R.with_selection(land, _picked(land, PICKED))))
on_nations("g4_inflow", D + f"SELECT d.case_id, t, sum(x.a * d.p) AS inflow {JOINED} WHERE x.a > 0 GROUP BY 1, 2")(G.inflow)
on_nations("g5_target_contribution", D + f"SELECT d.case_id, t, sum(x.a * y.b * d.p) AS contribution {JOINED} WHERE x.a > 0 GROUP BY 1, 2")(G.target_contribution)
on_nations("g5_potentials", D + f"SELECT d.case_id, t, s AS u, y.b * d.p AS potential {JOINED} WHERE y.b > 0")(G.potentials)
on_nations("g6_improved_inflow", ALL + "SELECT e.case_id, e.t, sum(x.a * e.p) AS inflow FROM e JOIN sv x ON x.v = e.s GROUP BY 1, 2")(G.improved_inflow)
on_nations("g7_budgeted_inflow", ALL + """, base AS (SELECT e.case_id, e.t, sum(x.a * e.p) AS base FROM e JOIN vx x ON x.v = e.s GROUP BY 1, 2),
g AS (SELECT e.case_id, e.t, vi.option_id, sum(e.p * source_gain) AS gain FROM e JOIN vi ON vi.vertex_id = e.s GROUP BY 1, 2, 3),
r AS (SELECT g.*, cost, 40 - coalesce(sum(cost) OVER (PARTITION BY case_id, t ORDER BY gain / cost DESC, option_ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest FROM g JOIN op USING (option_id))
SELECT case_id, t, round(base + coalesce((SELECT sum(gain * greatest(0, least(1, rest / cost))) FROM r WHERE r.case_id = base.case_id AND r.t = base.t), 0), 6) AS bound FROM base""")(lambda land: G.budgeted_inflow(land, BUDGET).select("case_id", "t", F.round("bound", 6).alias("bound")))
EACH = O.scenarios("SELECT option_id AS scenario_id, option_id FROM op")
BUT = O.scenarios(f"SELECT x.option_id AS scenario_id, y.option_id FROM op x, op y WHERE x.option_id IN {PICKED_SQL} AND y.option_id IN {PICKED_SQL} AND x.option_id <> y.option_id")


def _ids(land: Landscape, ids: tuple[str, ...] | None = None) -> DataFrame:
    return land.options.select("option_id") if ids is None else local_frame(land.options.sparkSession, {"option_id": list(ids)}, "option_id string")


on_nations("g9_marginals_incr", EACH + "SELECT scenario_id AS option_id, case_id, pc FROM sp")(lambda land: X.marginals(land, _ids(land, ()), _ids(land), add=True))
MORE = O.scenarios(f"SELECT option_id AS scenario_id, option_id FROM op UNION SELECT x.option_id, y.option_id FROM op x, op y WHERE y.option_id IN {PICKED_SQL}")
on_nations("g9_marginals_of_selection", MORE + "SELECT scenario_id AS option_id, case_id, pc FROM sp")(lambda land: X.marginals(land, _ids(land, PICKED), _ids(land), add=True))
on_nations("g10_marginals_decr", BUT + "SELECT scenario_id AS option_id, case_id, pc FROM sp")(lambda land: X.marginals(land, _ids(land, PICKED), _ids(land, PICKED), add=False))


def _lossless(spark: SparkSession, sf_dir: str) -> Landscape:
    """The nation landscape with the arcs of the first rank as lossless ones."""
    land = nation_landscape(spark, sf_dir)
    return land.with_(arcs=land.arcs.withColumn("probability", F.when(F.col("probability") == 0.5, 1.0).otherwise(F.col("probability"))))


SCC = f"""WITH {O.landscape()},
lx AS (SELECT case_id, src, dst, CASE WHEN p = 0.5 THEN 1.0 ELSE p END AS p FROM ax), l1 AS (SELECT * FROM lx WHERE p = 1.0),
{O.closure('r', 'l1', 'vx')}
"""
query("g8_lossless_components", SCC + "SELECT x.case_id, x.s AS vertex_id, min(x.t) AS component FROM r x JOIN r y ON x.s = y.t AND x.t = y.s GROUP BY 1, 2")(lambda spark, d: M.lossless_components(_lossless(spark, d)))
query("g8_contracted_pc", f"WITH {O.landscape()}, lx AS (SELECT case_id, src, dst, CASE WHEN p = 0.5 THEN 1.0 ELSE p END AS p FROM ax), {O.closure('d', 'lx', 'vx')} SELECT d.case_id, sum(x.a * y.b * d.p) AS pc {JOINED} GROUP BY 1")(lambda spark, d: G.pc(M.contract_lossless(_lossless(spark, d))))
on_nations("g11_arc_criticality")(M.arc_criticality)
on_nations("g12_budgeted_criticality")(lambda land: M.arc_criticality(land, BUDGET))


def _pruned_inflow(land: Landscape, contract: bool) -> DataFrame:
    """Inflow of each target over the smaller landscape of its own: as over the whole one."""
    critical = cut(M.arc_criticality(land))
    targets = land.vertices.where("target_quality > 0").select("case_id", F.col("vertex_id").alias("t"))
    if contract:
        vertices, arcs = M.contract_strong(land, critical, targets)
    else:
        arcs = M.prune_for_targets(land, critical, targets)
        vertices = land.vertices.join(targets, "case_id").select("case_id", "t", "vertex_id", "source_quality")
    scoped = arcs.withColumnRenamed("t", "goal")
    starts = vertices.where("source_quality > 0").withColumnRenamed("t", "goal")
    paths = G.best_path_closure(scoped, starts, scope=("case_id", "goal")).where("t = goal")
    a = starts.select("case_id", "goal", F.col("vertex_id").alias("s"), "source_quality")
    return paths.join(a, ["case_id", "goal", "s"]).groupBy("case_id", "t").agg(F.round(F.sum(F.col("source_quality") * F.col("p")), 6).alias("inflow"))


INFLOW = D + f"SELECT d.case_id, t, round(sum(x.a * d.p), 6) AS inflow {JOINED} WHERE x.a > 0 AND y.b > 0 GROUP BY 1, 2"
on_nations("g13_pruned_inflow", INFLOW)(lambda land: _pruned_inflow(land, False))
on_nations("g14_contracted_inflow", INFLOW)(lambda land: _pruned_inflow(land, True))
on_nations("g15_drop_unfed", D + f"SELECT DISTINCT d.case_id, t AS vertex_id {JOINED} WHERE s IN ('0', '5')")(
    lambda land: M.drop_unfed(land.with_(vertices=land.vertices.withColumn("source_quality", F.when(F.col("vertex_id").isin("0", "5"), 1.0).otherwise(0.0)), vertex_improvements=land.vertex_improvements.limit(0))).vertices.select("case_id", "vertex_id")
)
BOUNDS = O.scenarios("SELECT 'all' AS scenario_id, option_id FROM op") + f""",
{O.closure('d', 'ax', 'vx')},
m AS (SELECT e.case_id, e.t, sum(x.a * e.p) AS most FROM e JOIN sv x ON x.v = e.s GROUP BY 1, 2),
rho AS (SELECT d.case_id, d.t, d.s AS u, vx.b * d.p AS r FROM d JOIN vx ON vx.v = d.t WHERE vx.b > 0),
parts AS (
  SELECT ai.option_id, most * greatest(0, q * h.r - coalesce(tl.r, 0)) AS part
  FROM ai JOIN ax USING (arc_id) JOIN m ON m.t = ax.src JOIN rho h ON h.u = ax.dst LEFT JOIN rho tl ON tl.t = h.t AND tl.u = ax.src
  UNION ALL SELECT option_id, most * target_gain FROM vi JOIN m ON m.t = vi.vertex_id
  UNION ALL SELECT option_id, source_gain * r FROM vi JOIN rho ON rho.u = vi.vertex_id)
"""
on_nations("g16_option_bound_scores", BOUNDS + "SELECT option_id, round(sum(part), 4) AS score FROM parts GROUP BY 1")(lambda land: M.option_bound_scores(land, G.potentials(land), G.improved_inflow(land)).select("option_id", F.round("score", 4).alias("score")))

on_nations("g16_certificate", BOUNDS.rstrip() + """,
g AS (SELECT option_id, sum(part) AS score FROM parts GROUP BY 1),
r AS (SELECT score, cost, 40 - coalesce(sum(cost) OVER (ORDER BY score / cost DESC, option_ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest FROM g JOIN op USING (option_id) WHERE score > 0),
z AS (SELECT sum(a * r) AS base FROM rho JOIN vx ON vx.v = rho.u)
SELECT round(base, 4) AS base_score, round(base + (SELECT sum(score * greatest(0, least(1, rest / cost))) FROM r), 4) AS bound FROM z""")(lambda land: B.certificate(land, BUDGET).select(F.round("base_score", 4).alias("base_score"), F.round("bound", 4).alias("bound")))

# --- the large, sparse landscape: from every tenth supplier to everything, all paths; eight rounds are more than any best path has steps
_ROUNDS = ",\n".join(f"r{k} AS MATERIALIZED (SELECT s, t, max(q) AS q FROM (SELECT * FROM r{k - 1} UNION ALL SELECT r.s, a.b, r.q * a.q FROM r{k - 1} r JOIN arcs a ON a.a = r.t) GROUP BY 1, 2)" for k in range(1, 9))


def _ps_sql(sources: str) -> str:
    return f"""WITH e AS (SELECT 'p' || l_partkey AS p, 's' || l_suppkey AS s, pow(2.0, -(1 + min(l_linenumber))) AS q FROM lineitem GROUP BY 1, 2),
arcs AS (SELECT s AS a, p AS b, q FROM e UNION ALL SELECT p, s, q FROM e),
r0 AS (SELECT DISTINCT s, s AS t, CAST(1 AS DOUBLE) AS q FROM e WHERE {sources}),
{_ROUNDS}
SELECT 'ps' AS case_id, t, sum(q) AS inflow FROM r8 GROUP BY 1, 2"""


@query("ps_inflow", _ps_sql("CAST(substr(s, 2) AS BIGINT) % 10 = 0"))
def _ps(spark: SparkSession, sf_dir: str) -> DataFrame:
    land = part_supplier_landscape(spark, sf_dir)
    asked = F.col("vertex_id").startswith("s") & (F.substring("vertex_id", 2, 20).try_cast("long") % 10 == 0)
    return G.inflow_in_blocks(land.with_(vertices=land.vertices.withColumn("source_quality", F.when(asked, 1.0).otherwise(0.0))), both_ways=True)


@query("ps_inflow_all", _ps_sql("true"))
def _ps_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every supplier is a source, in blocks."""
    land = part_supplier_landscape(spark, sf_dir)
    return G.inflow_in_blocks(land.with_(vertices=land.vertices.withColumn("source_quality", F.col("vertex_id").startswith("s").cast("double"))), both_ways=True)


# --- criterion: five cases, one for each market segment
SEG = "SELECT d.case_id, sum(x.a * y.b * d.p) AS pc " + JOINED + " GROUP BY 1"
WIDE = D5 + f", c AS ({SEG}), w AS (SELECT " + ", ".join(f"max(CASE WHEN case_id = '{n}' THEN pc END) AS x{k}" for k, n in enumerate(("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"))) + " FROM c) "
A, BU, FU = C.Case("AUTOMOBILE"), C.Case("BUILDING"), C.Case("FURNITURE")
FORMULAS = {
    "c1_constant_and_case": (C.Sum((C.Constant(2.5), A)), "2.5 + coalesce(x0, 0)"),
    "c2_linear": (C.linear(0.25, BU), "0.25 * coalesce(x1, 0)"),
    "c3_sum": (C.Sum((A, BU, FU)), "coalesce(x0, 0) + coalesce(x1, 0) + coalesce(x2, 0)"),
    "c4_product": (C.Product((A, C.Constant(0.5), C.Product(()))), "coalesce(x0, 0) * 0.5"),
    "c5_min": (C.Least((A, C.linear(0.5, BU), C.Least(()))), "least(coalesce(x0, 0), 0.5 * coalesce(x1, 0))"),
    "c7_score": (C.Sum((C.linear(0.1, A), C.Least((C.linear(0.5, BU), FU)))), "0.1 * coalesce(x0, 0) + least(0.5 * coalesce(x1, 0), coalesce(x2, 0))"),
}


def _scored(land: Landscape, formula: C.Formula | None) -> DataFrame:
    return C.score(G.pc(land).withColumn("scenario_id", F.lit("base")), formula).select("scenario_id", F.round("score", 6).alias("score"))


for _name, (_formula, _sql) in FORMULAS.items():
    on_nations(_name, WIDE + f"SELECT 'base' AS scenario_id, round({_sql}, 6) AS score FROM w", True)(lambda land, f=_formula: _scored(land, f))
on_nations("c6_default", D5 + f"SELECT 'base' AS scenario_id, round(sum(pc), 6) AS score FROM ({SEG})", True)(lambda land: _scored(land, None))

# --- selection
RANKED = EACH + ",\n" + O.closure("f", "ax", "vx") + ",\nz AS (SELECT sum(x.a * y.b * f.p) AS pc FROM f JOIN vx x ON f.s = x.v JOIN vx y ON f.t = y.v), k AS (SELECT op.option_id, option_ord, cost, sp.pc - z.pc AS gain FROM sp JOIN op ON op.option_id = sp.scenario_id, z)\n"
on_nations("b8_ranking", RANKED + "SELECT option_id, cost, gain, round(gain / cost, 9) AS ratio FROM k")(lambda land: B.ranking(land).select("option_id", "cost", "gain", F.round("ratio", 9).alias("ratio")))


def _fill_sql(head: str, order: str) -> str:
    """Whatever fits, in order, as a recursion over ranks."""
    head = head.replace("WITH ", "WITH RECURSIVE ", 1)
    return head + f""", o AS (SELECT *, row_number() OVER (ORDER BY {order}) AS pos FROM k),
walk AS (SELECT CAST(0 AS BIGINT) AS pos, CAST(40.0 AS DOUBLE) AS rest, CAST('' AS VARCHAR) AS option_id, false AS took
  UNION ALL SELECT o.pos, CASE WHEN o.cost <= walk.rest THEN walk.rest - o.cost ELSE walk.rest END, o.option_id, o.cost <= walk.rest FROM walk JOIN o ON o.pos = walk.pos + 1)
SELECT option_id FROM walk WHERE took"""


def _method(name: str, budget: float) -> Callable[[Landscape], DataFrame]:
    def run(land: Landscape) -> DataFrame:
        ids = B.METHODS[name](land, budget)
        return local_frame(land.options.sparkSession, {"option_id": ids}, "option_id string")

    return run


on_nations("b1_static_incr", _fill_sql(RANKED, "round(gain / cost, 9) DESC, option_ord"))(_method("static_incr", BUDGET))
on_nations("b2_greedy_incr")(_method("greedy_incr", BUDGET))
# all but one each, the cheapest losses gone until 40 is kept, then what was removed ranked on top of what was kept
LESS = f"""WITH RECURSIVE {O.landscape()}, {O.scenario_parts("SELECT x.option_id AS scenario_id, y.option_id FROM op x, op y WHERE x.option_id <> y.option_id UNION ALL SELECT 'all', option_id FROM op")},
loss AS (SELECT op.option_id, option_ord, cost, round(((SELECT pc FROM sp WHERE scenario_id = 'all') - sp.pc) / cost, 9) AS ratio FROM sp JOIN op ON op.option_id = sp.scenario_id),
kept AS (SELECT option_id, cost FROM (SELECT *, sum(cost) OVER () - sum(cost) OVER w + cost AS rest, row_number() OVER w AS pos FROM loss WINDOW w AS (ORDER BY ratio, option_ord ROWS UNBOUNDED PRECEDING)) WHERE rest <= 40 AND pos > 1),
{O.scenario_parts("SELECT option_id AS scenario_id, option_id FROM op WHERE option_id NOT IN (SELECT option_id FROM kept) UNION ALL SELECT op.option_id, kept.option_id FROM op, kept WHERE op.option_id NOT IN (SELECT option_id FROM kept) UNION ALL SELECT 'kept', option_id FROM kept", "_2")},
k AS (SELECT op.option_id, option_ord, cost, round((sp_2.pc - (SELECT pc FROM sp_2 WHERE scenario_id = 'kept')) / cost, 9) AS ratio FROM sp_2 JOIN op ON op.option_id = sp_2.scenario_id),
o AS (SELECT *, row_number() OVER (ORDER BY ratio DESC, option_ord) AS pos FROM k),
walk AS (SELECT CAST(0 AS BIGINT) AS pos, CAST(40.0 - (SELECT sum(cost) FROM kept) AS DOUBLE) AS rest, CAST('' AS VARCHAR) AS option_id, false AS took
  UNION ALL SELECT o.pos, CASE WHEN o.cost <= walk.rest THEN walk.rest - o.cost ELSE walk.rest END, o.option_id, o.cost <= walk.rest FROM walk JOIN o ON o.pos = walk.pos + 1)
SELECT option_id FROM kept UNION ALL SELECT option_id FROM walk WHERE took"""
on_nations("b3_static_decr", LESS)(_method("static_decr", BUDGET))
on_nations("b4_greedy_decr")(_method("greedy_decr", BUDGET))
on_nations("b5_worst_greedy_decr")(_method("worst_greedy_decr", BUDGET))
on_nations("b6_budget_fill", f"WITH RECURSIVE {O.landscape()}, k AS (SELECT * FROM op), o AS (SELECT *, row_number() OVER (ORDER BY cost % 5 DESC, option_ord) AS pos FROM k), walk AS (SELECT CAST(0 AS BIGINT) AS pos, CAST(40.0 AS DOUBLE) AS rest, CAST('' AS VARCHAR) AS option_id, false AS took UNION ALL SELECT o.pos, CASE WHEN o.cost <= walk.rest THEN walk.rest - o.cost ELSE walk.rest END, o.option_id, o.cost <= walk.rest FROM walk JOIN o ON o.pos = walk.pos + 1) SELECT option_id FROM walk WHERE took")(
    lambda land: B.budget_fill(land.options, BUDGET, [F.desc(F.col("cost") % 5), F.col("option_ord")]).select("option_id")
)
on_nations("b7_budget_cut", N + "SELECT option_id FROM (SELECT option_id, sum(cost) OVER () - coalesce(sum(cost) OVER (ORDER BY option_ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest, row_number() OVER (ORDER BY option_ord) AS pos FROM op) WHERE rest > 40 OR pos = 1")(
    lambda land: B.budget_cut(land.options, BUDGET, [F.col("option_ord")]).select("option_id")
)
on_nations("b9_evaluation", SOME + ",\n" + O.closure("f", "ax", "vx") + f", z AS (SELECT f.case_id, sum(x.a * y.b * f.p) AS pc FROM f JOIN vx x ON f.s = x.v JOIN vx y ON f.t = y.v GROUP BY 1) SELECT sp.case_id, z.pc AS base_pc, sp.pc, z.pc AS base_score, sp.pc AS score, (SELECT sum(cost) FROM op WHERE option_id IN {PICKED_SQL}) AS cost FROM sp JOIN z ON z.case_id = sp.case_id")(
    lambda land: B.evaluation(land, _picked(land, PICKED))
)

# --- builders: cells from events
CELLS = "WITH cells AS (SELECT CAST(event_id AS VARCHAR) AS id, CAST(event_id % 128 AS INTEGER) AS x, CAST(event_id // 128 AS INTEGER) AS y, user_id % 97 AS value, CAST(user_id % 7 AS DOUBLE) AS quality, pow(2.0, -2 * (user_id % 3)) AS probability, event_type AS road, CAST(user_id % 2 AS INTEGER) AS area1, CAST(event_id % 3 = 0 AS INTEGER) AS flag, CAST(event_id // 16 AS VARCHAR) AS coarse, CASE WHEN user_id % 5 = 0 THEN 'o' || user_id END AS option_id FROM events), links AS (SELECT CAST(event_id AS VARCHAR) AS a, CAST(event_id * 2 AS VARCHAR) AS b FROM events WHERE event_id > 0)\n"


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    user = F.col("user_id")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("id"), (F.col("event_id") % 128).cast("int").alias("x"), F.floor(F.col("event_id") / 128).cast("int").alias("y"), (user % 97).alias("value"), (user % 7).cast("double").alias("quality"),
        F.pow(F.lit(2.0), -2 * (user % 3)).alias("probability"), F.col("event_type").alias("road"), (user % 2).cast("int").alias("area1"), (F.col("event_id") % 3 == 0).cast("int").alias("flag"),
        F.floor(F.col("event_id") / 16).cast("string").alias("coarse"), F.when(user % 5 == 0, F.concat(F.lit("o"), user.cast("string"))).alias("option_id"),
    )


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    return table(spark, sf_dir, "events").where(e > 0).select(e.cast("string").alias("a"), (e * 2).cast("string").alias("b"))


def on_cells(name: str, sql: str):
    def register(f):
        query(name, CELLS + sql)(lambda spark, sf_dir: f(_cells(spark, sf_dir), _links(spark, sf_dir)))
        return f

    return register


on_cells("l1_split_vertices", "SELECT id || e AS vertex_id, CASE WHEN e = '' THEN quality ELSE 0 END AS source_quality, CASE WHEN e = '' THEN quality ELSE 0 END AS target_quality FROM cells, (VALUES (''), ('_in'), ('_out')) t(e)")(lambda c, _: L.split_cells(c)[0])
on_cells("l1_split_arcs", "SELECT id || '_in>' || id AS arc_id, id || '_in' AS src, id AS dst, sqrt(probability) AS probability FROM cells UNION ALL SELECT id || '>' || id || '_out', id, id || '_out', sqrt(probability) FROM cells")(lambda c, _: L.split_cells(c)[1])
on_cells("l2_grid_adjacency", "SELECT p.id || '_out>' || q.id || '_in' AS arc_id, p.id || '_out' AS src, q.id || '_in' AS dst, 1.0::DOUBLE AS probability FROM cells p JOIN (SELECT id, x + dx AS x, y + dy AS y FROM cells, (VALUES (1, 0), (-1, 0), (0, 1), (0, -1)) t(dx, dy)) q ON p.x = q.x AND p.y = q.y")(lambda c, _: L.grid_adjacency(c))
on_cells("l3_link_adjacency", "SELECT p || '_out>' || q || '_in' AS arc_id, p || '_out' AS src, q || '_in' AS dst, 1.0::DOUBLE AS probability FROM (SELECT a AS p, b AS q FROM links UNION ALL SELECT b, a FROM links) WHERE p IN (SELECT id FROM cells) AND q IN (SELECT id FROM cells)")(lambda c, k: L.link_adjacency(k, c))
on_cells("l4_land_cover", "SELECT id, value, CASE WHEN value < 30 THEN 'forest' WHEN value < 60 THEN 'field' ELSE 'town' END AS class, CASE WHEN value < 30 THEN 8.0::DOUBLE WHEN value < 60 THEN 2.0 ELSE 0.0 END AS quality FROM cells")(
    lambda c, _: L.land_cover(c.select("id", "value"), local_frame(c.sparkSession, {"low": [0, 30, 60], "high": [29, 59, 96], "class": ["forest", "field", "town"], "quality": [8.0, 2.0, 0.0]}, "low long, high long, class string, quality double"))
)
on_cells("l5_crossing_probability", "SELECT id, round(pow(CASE WHEN value <= 10 THEN 1.0 WHEN value <= 50 THEN 0.5 ELSE 0.1 END * CASE WHEN road = 'click' THEN 0.5 ELSE 1.0 END, 2.0), 9) AS probability FROM cells")(
    lambda c, _: c.select("id", F.round(L.crossing_probability(F.col("value"), [(10, 1.0), (50, 0.5)], 0.1, F.col("road"), {"click": 0.5}, 2.0), 9).alias("probability"))
)
on_cells("l6_aggregate_cells", "SELECT coarse, round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(avg(quality), 6) AS quality, max(area1) AS area1, max(flag) AS flag, round(CASE WHEN max(flag) > 0 AND max(area1) = 0 THEN exp(avg(ln(probability))) WHEN max(area1) > 0 THEN 0.25 ELSE exp(avg(ln(probability))) END, 9) AS probability FROM cells GROUP BY coarse")(
    lambda c, _: L.aggregate_cells(c, "coarse", flags=["area1", "flag"], built_up="area1", built_up_probability=0.25).select("coarse", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), F.round("quality", 6).alias("quality"), "area1", "flag", F.round("probability", 9).alias("probability"))
)
on_cells("l7_distance_decay", ", arcs AS (SELECT a || '>' || b AS arc_id, a AS src, b AS dst, length(a) % 2 = 0 AS blocked FROM links WHERE b IN (SELECT id FROM cells)) SELECT arc_id, src, dst, round(CASE WHEN blocked THEN 0 ELSE exp(-(p.value + q.value) * ln(2.0) / 300) END, 9) AS probability, round(CASE WHEN blocked THEN exp(-(p.value + q.value) * ln(2.0) / 300) * 0.8 END, 9) AS improved_probability FROM arcs JOIN cells p ON p.id = src JOIN cells q ON q.id = dst")(
    lambda c, k: L.distance_decay(k.select(F.concat_ws(">", "a", "b").alias("arc_id"), F.col("a").alias("src"), F.col("b").alias("dst"), (F.length("a") % 2 == 0).alias("blocked")), c.select(F.col("id").alias("vertex_id"), F.col("value").alias("length"))).select("arc_id", "src", "dst", F.round("probability", 9).alias("probability"), F.round("improved_probability", 9).alias("improved_probability"))
)
on_cells("l8_neighbour_max", ", n AS (SELECT p AS id, max(flag) AS f FROM (SELECT a AS p, b AS q FROM links UNION ALL SELECT b, a FROM links) JOIN cells ON cells.id = q GROUP BY 1) SELECT id, greatest(flag, coalesce(f, flag)) AS flag FROM cells LEFT JOIN n USING (id)")(lambda c, k: L.neighbour_max(c, k, "flag"))


def _options_of(cells: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    return L.options_from_cells(cells.withColumns({"cost": F.col("value"), "gain": F.col("quality"), "improved_probability": F.col("probability")}))


on_cells("l10_options_from_cells", "SELECT option_id, sum(value) AS cost FROM cells WHERE option_id IS NOT NULL GROUP BY 1")(lambda c, _: _options_of(c)[0])
on_cells("l10_vertex_gains", "SELECT id AS vertex_id, option_id, quality AS source_gain, quality AS target_gain FROM cells WHERE option_id IS NOT NULL AND quality > 0")(lambda c, _: _options_of(c)[1])
on_cells("l10_arc_improvements", "SELECT CASE WHEN e = '_in' THEN id || '_in>' || id ELSE id || '>' || id || '_out' END AS arc_id, option_id, sqrt(probability) AS improved_probability FROM cells, (VALUES ('_in'), ('_out')) t(e) WHERE option_id IS NOT NULL")(lambda c, _: _options_of(c)[2])
on_cells("l11_in_area", "SELECT id, area1 FROM cells WHERE area1 = 1")(lambda c, _: L.in_area(c, "area1").select("id", "area1"))


def _reference(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    ref = table(spark, sf_dir, "events").select(F.concat(F.lit("o"), F.col("user_id").cast("string")).alias("option_id"), F.col("event_id").cast("string").alias("id"))
    return L.options_from_reference(ref, _cells(spark, sf_dir), F.col("flag") == 1)


query("l9_options_from_reference", "SELECT 'o' || user_id AS option_id, CAST(count(*) AS DOUBLE) AS cost FROM events GROUP BY 1")(lambda spark, d: _reference(spark, d)[0])
query("l9_qualifying_cells", "SELECT 'o' || user_id AS option_id, CAST(event_id AS VARCHAR) AS id FROM events WHERE event_id % 3 = 0")(lambda spark, d: _reference(spark, d)[1])
