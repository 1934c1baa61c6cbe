"""The five tables of a landscape and its criterion."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame

from linkscape.functions.criterion import Formula

SCHEMAS = {
    "options": "option_id string, option_ord long, cost double",
    "vertices": "case_id string, vertex_id string, source_quality double, target_quality double",
    "arcs": "case_id string, arc_id string, src string, dst string, probability double",
    "vertex_improvements": "case_id string, vertex_id string, option_id string, source_gain double, target_gain double",
    "arc_improvements": "case_id string, arc_id string, option_id string, improved_probability double",
}


@dataclass(frozen=True)
class Landscape:
    """Every case in one set of tables, told apart by ``case_id``; ``criterion`` None is the sum of all cases."""

    options: DataFrame
    vertices: DataFrame
    arcs: DataFrame
    vertex_improvements: DataFrame
    arc_improvements: DataFrame
    criterion: Formula | None = None

    def with_(self, **tables) -> "Landscape":
        return replace(self, **tables)
