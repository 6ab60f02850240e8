"""Queries over small made-up tables, with the answers stated by hand.

The driver's tables hold no awkward addresses, trees or clashes.  A ``Case``
has its rows, the operator applied to them, and the expected rows; its SQL
lists the expected rows, so a query that changes its answer is seen.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

_SQL_TYPES = {"string": "VARCHAR", "int": "INTEGER", "long": "BIGINT", "boolean": "BOOLEAN", "date": "DATE", "timestamp": "TIMESTAMP", "double": "DOUBLE"}


def _fields(ddl: str) -> list[tuple[str, str]]:
    return [tuple(part.split()) for part in ddl.split(", ")]


def _literal(value: object, kind: str) -> str:
    text = "NULL" if value is None else "'" + value.replace("'", "''") + "'" if isinstance(value, str) else str(value)
    return f"CAST({text} AS {_SQL_TYPES[kind]})"


@dataclass(frozen=True)
class Case:
    """``tables``: name to (column types, rows); ``call`` gets them as DataFrames; ``answer``: column types and rows."""

    name: str
    call: Callable[..., DataFrame]
    tables: dict[str, tuple[str, list[tuple]]] = field(hash=False)
    answer: tuple[str, list[tuple]] = field(hash=False)

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        frames = {name: spark.createDataFrame(rows, ddl) for name, (ddl, rows) in self.tables.items()}
        columns = [name for name, _ in _fields(self.answer[0])]
        return self.call(**frames).select(*columns)

    @property
    def sql(self) -> str:
        kinds = _fields(self.answer[0])
        rows = ", ".join("(" + ", ".join(_literal(v, kind) for v, (_, kind) in zip(row, kinds)) + ")" for row in self.answer[1])
        return f"SELECT * FROM (VALUES {rows}) t({', '.join(name for name, _ in kinds)})"


def mapped(name: str, call: Callable, inputs: list, outputs: list, kind: str = "string", in_kind: str = "string") -> Case:
    """A column function on numbered inputs."""
    from pyspark.sql import functions as F

    rows = [(k, *(x if isinstance(x, tuple) else (x,))) for k, x in enumerate(inputs)]
    names = [f"x{k}" for k in range(len(rows[0]) - 1)]
    ddl = ", ".join(["id long", *(f"{n} {in_kind}" for n in names)])
    run = lambda t: t.select("id", call(*map(F.col, names)).alias("y"))
    return Case(name, run, {"t": (ddl, rows)}, (f"id long, y {kind}", list(enumerate(outputs))))


def registered(cases: list[Case]) -> tuple[dict[str, Callable], dict[str, str]]:
    return {c.name: c for c in cases}, {c.name: c.sql for c in cases}
