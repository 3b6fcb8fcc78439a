"""What a statement gives."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame

from millrace.errors import ValueError_
from millrace.plans.constants import show


@dataclass
class Result:
    """kind: begin, commit, rollback, create, update, delete, query, create_table, drop_table or explain."""

    kind: str
    count: int = 0
    version: int | None = None
    read_only: bool = False
    name: str = ""
    text: str = ""


@dataclass
class Query(Result):
    """Rows stay a lazy DataFrame, with internal column names; labels may repeat."""

    df: DataFrame = None
    labels: list[str] = field(default_factory=list)
    kinds: list[str | None] = field(default_factory=list)

    def rows(self) -> list[tuple]:
        """All rows, here; for results that are meant to be looked at."""
        try:
            return [tuple(r) for r in self.df.collect()]
        except PySparkException as e:
            raise translated(e) from e

    def lines(self, headers: bool = False) -> list[str]:
        out = ["|".join(self.labels)] if headers else []
        return out + ["|".join(show(v) for v in r) for r in self.rows()]


def translated(e: Exception) -> Exception:
    """Run-time errors of Spark in the dialect's words."""
    text = str(e)
    if "DIVIDE_BY_ZERO" in text or "REMAINDER_BY_ZERO" in text:
        return ValueError_("Can't divide by zero")
    if "Can't take factorial of negative number" in text:
        return ValueError_("Can't take factorial of negative number")
    if "Integer power with negative exponent" in text:
        return ValueError_("Integer power with negative exponent")
    if "ARITHMETIC_OVERFLOW" in text or "Integer overflow" in text:
        return ValueError_("Integer overflow")
    return e
