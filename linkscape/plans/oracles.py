"""SQL that builds the same landscapes and sums, for checks in another engine."""

from __future__ import annotations


def landscape(by_segment: bool = False) -> str:
    case = "c.c_mktsegment" if by_segment else "'all'"
    return f"""
cases AS (SELECT DISTINCT {case} AS case_id FROM customer c),
flow AS (
  SELECT * FROM (
    SELECT case_id, src, dst, row_number() OVER (PARTITION BY case_id, src ORDER BY n DESC, dst) AS rank
    FROM (SELECT {case} AS case_id, s.s_nationkey AS src, c.c_nationkey AS dst, count(*) AS n
          FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey JOIN supplier s ON l.l_suppkey = s.s_suppkey
          WHERE s.s_nationkey <> c.c_nationkey GROUP BY 1, 2, 3)) WHERE rank <= 3),
vx AS (
  SELECT k.case_id, CAST(n.n_nationkey AS VARCHAR) AS v,
         CAST((SELECT count(*) FROM supplier s WHERE s.s_nationkey = n.n_nationkey) AS DOUBLE) AS a,
         CAST((SELECT count(*) FROM customer c WHERE c.c_nationkey = n.n_nationkey AND {case} = k.case_id) AS DOUBLE) AS b
  FROM nation n, cases k),
ax AS (SELECT case_id, src || '-' || dst AS arc_id, CAST(src AS VARCHAR) AS src, CAST(dst AS VARCHAR) AS dst, pow(2.0, -rank) AS p, rank, dst AS dk FROM flow),
op AS (
  SELECT 'n' || n_nationkey AS option_id, CAST(n_nationkey AS BIGINT) AS option_ord, CAST(3 + n_nationkey % 4 AS DOUBLE) AS cost FROM nation
  UNION ALL SELECT 'r' || r_regionkey, CAST(25 + r_regionkey AS BIGINT), 14.0 FROM region),
vi AS (SELECT k.case_id, CAST(n_nationkey AS VARCHAR) AS vertex_id, 'n' || n_nationkey AS option_id, CAST(1 AS DOUBLE) AS source_gain, CAST(2 AS DOUBLE) AS target_gain FROM nation, cases k),
ai AS (
  SELECT case_id, arc_id, 'n' || dk AS option_id, CAST(0.5 AS DOUBLE) AS q FROM ax
  UNION ALL SELECT case_id, arc_id, 'r' || n_regionkey, CAST(0.5 AS DOUBLE) FROM ax JOIN nation ON n_nationkey = dk WHERE rank >= 2)"""


def closure(name: str, arcs: str, vertices: str, keys: tuple[str, ...] = ("case_id",)) -> str:
    """Best paths as ``name`` (keys, s, t, p) by squaring five times: up to 32 steps."""
    k = ", ".join(keys)
    same = " AND ".join(f"x.{c} = y.{c}" for c in keys)
    out = [f"{name}0 AS MATERIALIZED (SELECT {k}, s, t, max(p) AS p FROM (SELECT {k}, src AS s, dst AS t, p FROM {arcs} UNION ALL SELECT {k}, v, v, 1.0 FROM {vertices}) GROUP BY {k}, s, t)"]
    for i in range(5):
        last = f"{name}{i + 1}" if i < 4 else name
        out.append(f"{last} AS MATERIALIZED (SELECT {', '.join('x.' + c for c in keys)}, x.s, y.t, max(x.p * y.p) AS p FROM {name}{i} x JOIN {name}{i} y ON {same} AND x.t = y.s GROUP BY {', '.join('x.' + c for c in keys)}, x.s, y.t)")
    return ",\n".join(out)


def base(by_segment: bool = False) -> str:
    return f"WITH {landscape(by_segment)},\n{closure('d', 'ax', 'vx')}"


def scenario_parts(sc: str, tag: str = "") -> str:
    """Scores of the selections that ``sc`` lists as scenario_id, option_id, in ``sp``; ``tag`` ends every name."""
    part = f"""
sc{tag} AS ({sc}), ids{tag} AS (SELECT DISTINCT scenario_id FROM sc{tag}),
sv{tag} AS (
  SELECT scenario_id, vx.case_id, v, a + coalesce((SELECT sum(source_gain) FROM vi JOIN sc{tag} USING (option_id) WHERE sc{tag}.scenario_id = ids{tag}.scenario_id AND vi.case_id = vx.case_id AND vi.vertex_id = v), 0) AS a,
         b + coalesce((SELECT sum(target_gain) FROM vi JOIN sc{tag} USING (option_id) WHERE sc{tag}.scenario_id = ids{tag}.scenario_id AND vi.case_id = vx.case_id AND vi.vertex_id = v), 0) AS b
  FROM vx, ids{tag}),
sq{tag} AS (SELECT sc{tag}.scenario_id, ai.case_id, ai.arc_id, max(q) AS q FROM ai JOIN sc{tag} USING (option_id) GROUP BY ALL),
sa{tag} AS (SELECT ids{tag}.scenario_id, ax.case_id, ax.src, ax.dst, greatest(p, coalesce(q, 0)) AS p FROM ax CROSS JOIN ids{tag} LEFT JOIN sq{tag} ON sq{tag}.scenario_id = ids{tag}.scenario_id AND sq{tag}.case_id = ax.case_id AND sq{tag}.arc_id = ax.arc_id),
{closure(f'e{tag}', f'sa{tag}', f'sv{tag}', ('scenario_id', 'case_id'))},
sp{tag} AS (SELECT e.scenario_id, e.case_id, sum(x.a * y.b * e.p) AS pc FROM e{tag} e JOIN sv{tag} x ON x.scenario_id = e.scenario_id AND x.case_id = e.case_id AND x.v = e.s JOIN sv{tag} y ON y.scenario_id = e.scenario_id AND y.case_id = e.case_id AND y.v = e.t GROUP BY 1, 2)"""
    return part


def scenarios(sc: str, by_segment: bool = False) -> str:
    return f"WITH {landscape(by_segment)}, {scenario_parts(sc)}"
