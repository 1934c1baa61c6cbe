"""How the scores of cases become one: a small formula tree, compiled to one column."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The least of nothing: the largest double.
LARGEST = 1.7976931348623157e308


class Formula:
    def column(self) -> Column:
        raise NotImplementedError

    def cases(self) -> set[str]:
        return set()


@dataclass(frozen=True)
class Constant(Formula):
    value: float

    def column(self) -> Column:
        return F.lit(float(self.value))


@dataclass(frozen=True)
class Case(Formula):
    name: str

    def column(self) -> Column:
        return F.coalesce(F.col(f"`{self.name}`"), F.lit(0.0))

    def cases(self) -> set[str]:
        return {self.name}


@dataclass(frozen=True)
class _Many(Formula):
    parts: tuple[Formula, ...]

    def cases(self) -> set[str]:
        return set().union(*(p.cases() for p in self.parts))


class Sum(_Many):
    def column(self) -> Column:
        return reduce(lambda a, b: a + b, [p.column() for p in self.parts], F.lit(0.0))


class Product(_Many):
    def column(self) -> Column:
        return reduce(lambda a, b: a * b, [p.column() for p in self.parts], F.lit(1.0))


class Least(_Many):
    def column(self) -> Column:
        columns = [p.column() for p in self.parts]
        return F.least(*columns) if len(columns) > 1 else columns[0] if columns else F.lit(LARGEST)


def linear(k: float, part: Formula) -> Formula:
    """``k`` times ``part``."""
    return Product((Constant(k), part))


def parse(value) -> Formula:
    """A formula from manifest JSON: number, case name, ``[k, f]``, or an object with ``sum``, ``product`` or ``min``."""
    if isinstance(value, bool) or value is None:
        raise ValueError(f"not a criterion: {value!r}")
    if isinstance(value, int | float):
        return Constant(float(value))
    if isinstance(value, str):
        return Case(value)
    if isinstance(value, list) and len(value) == 2 and isinstance(value[0], int | float):
        return linear(float(value[0]), parse(value[1]))
    if isinstance(value, dict) and len(value) == 1:
        (name, parts), kinds = next(iter(value.items())), {"sum": Sum, "product": Product, "min": Least}
        if name in kinds:
            return kinds[name](tuple(map(parse, parts)))
    raise ValueError(f"not a criterion: {value!r}")


def score(case_scores: DataFrame, criterion: Formula | Column | None = None, by: tuple[str, ...] = ("scenario_id",), value: str = "pc", cases: list[str] | None = None) -> DataFrame:
    """``by..., score``: the criterion over each group's case scores.  None sums all cases; a Column is taken over case columns named in ``cases``."""
    if criterion is None:
        return case_scores.groupBy(*by).agg(F.sum(value).alias("score"))
    names = sorted(cases or criterion.cases())
    wide = case_scores.groupBy(*by).agg(F.lit(0).alias("_any"), *[F.sum(F.when(F.col("case_id") == n, F.col(value))).alias(n) for n in names])
    return wide.select(*by, (criterion if isinstance(criterion, Column) else criterion.column()).alias("score"))
