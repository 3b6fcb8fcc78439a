"""Aggregates with the dialect's nulls: one NULL among the inputs makes MIN, MAX, SUM and AVG NULL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.errors import ValueError_
from millrace.functions.scalars import SPARK_TYPES, Typed

NAMES = ("avg", "count", "max", "min", "sum")


def aggregate(name: str, arg: Typed) -> tuple[Column, str | None]:
    """The aggregate's column (partial and final in Spark's hash aggregation) and type."""
    x = arg.column
    if name not in NAMES:
        raise ValueError_(f"Unknown function {name}")
    if name == "count":
        return F.count(x if not (arg.constant and arg.value is not None) else F.lit(1)).cast("bigint"), "INTEGER"
    if arg.kind is None or name in ("sum", "avg") and arg.kind not in ("INTEGER", "FLOAT"):
        return F.first(F.lit(None).cast(SPARK_TYPES[arg.kind or "BOOLEAN"])), arg.kind
    full = F.count(x) == F.count(F.lit(1))
    if name in ("min", "max"):
        return F.when(full, F.min(x) if name == "min" else F.max(x)), arg.kind
    if name == "sum":
        return F.when(full, F.sum(x)), arg.kind
    return F.when(full, F.call_function("div", F.sum(x), F.count(x)) if arg.kind == "INTEGER" else F.avg(x)), arg.kind
