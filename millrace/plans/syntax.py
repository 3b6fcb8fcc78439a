"""The syntax tree of statements."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any


@dataclass(frozen=True)
class Literal:
    value: Any  # None, bool, int, float or str


@dataclass(frozen=True)
class Field:
    table: str | None
    name: str

    def __str__(self) -> str:
        return f"{self.table}.{self.name}" if self.table else self.name


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple


@dataclass(frozen=True)
class Op:
    """and or not = > < >= <= != isnull + - * / % ^ ! neg pos like"""

    name: str
    args: tuple


@dataclass(frozen=True)
class Hole:
    """Stands for an already computed column (a group key or an aggregate)."""

    column: str
    kind: str | None


@dataclass(frozen=True)
class Table:
    name: str
    alias: str | None = None


@dataclass(frozen=True)
class Join:
    left: Any
    right: Any
    kind: str  # cross, inner, left, right
    on: Any = None


@dataclass
class Select:
    items: list[tuple[Any, str | None]] = field(default_factory=list)  # none: all columns
    sources: list = field(default_factory=list)
    where: Any = None
    group: list = field(default_factory=list)
    having: Any = None
    order: list[tuple[Any, bool]] = field(default_factory=list)  # expression, ascending
    limit: Any = None
    offset: Any = None


@dataclass
class Column:
    name: str
    kind: str
    primary: bool = False
    nullable: bool | None = None
    default: Any = None  # an expression
    unique: bool = False
    indexed: bool = False
    references: str | None = None


@dataclass
class CreateTable:
    name: str
    columns: list[Column]


@dataclass
class DropTable:
    name: str


@dataclass
class Insert:
    table: str
    columns: list[str] | None
    rows: list[list]


@dataclass
class Update:
    table: str
    assign: dict[str, Any]
    where: Any = None


@dataclass
class Delete:
    table: str
    where: Any = None


@dataclass
class Begin:
    read_only: bool = False
    version: int | None = None


@dataclass
class Commit:
    pass


@dataclass
class Rollback:
    pass


@dataclass
class Explain:
    statement: Any


def walk(e):
    """An expression and all below it."""
    yield e
    for x in getattr(e, "args", ()):
        yield from walk(x)
