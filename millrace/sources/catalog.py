"""Table definitions and their rules."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

from pyspark.sql import types as T

from millrace.errors import ValueError_
from millrace.plans.constants import fold, show, type_of
from millrace.plans.lexer import quote
from millrace.plans.syntax import CreateTable

SPARK = {"BOOLEAN": T.BooleanType(), "INTEGER": T.LongType(), "FLOAT": T.DoubleType(), "STRING": T.StringType()}
MOST_BYTES = 1024


@dataclass
class ColumnDef:
    name: str
    kind: str
    primary: bool = False
    nullable: bool = True
    has_default: bool = False
    default: object = None
    unique: bool = False
    indexed: bool = False
    references: str | None = None

    def ddl(self) -> str:
        out = f"{quote(self.name)} {self.kind}"
        out += " PRIMARY KEY" if self.primary else "" if self.nullable else " NOT NULL"
        out += f" DEFAULT {show(self.default)}" if self.has_default else ""
        out += " UNIQUE" if self.unique and not self.primary else ""
        out += f" REFERENCES {self.references}" if self.references else ""
        return out + (" INDEX" if self.indexed else "")


@dataclass
class TableDef:
    name: str
    columns: list[ColumnDef] = field(default_factory=list)

    @property
    def primary(self) -> ColumnDef:
        return next(c for c in self.columns if c.primary)

    def column(self, name: str) -> ColumnDef:
        for c in self.columns:
            if c.name == name:
                return c
        raise ValueError_(f"Column {name} does not exist in table {self.name}")

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(c.name, SPARK[c.kind]) for c in self.columns])

    def ddl(self) -> str:
        return f"CREATE TABLE {quote(self.name)} (\n" + ",\n".join("  " + c.ddl() for c in self.columns) + "\n)"

    def as_json(self) -> dict:
        def plain(v):
            return {"float": repr(v)} if isinstance(v, float) else v

        return {"name": self.name, "columns": [asdict(c) | {"default": plain(c.default)} for c in self.columns]}

    @classmethod
    def from_json(cls, x: dict) -> TableDef:
        def value(v):
            return float(v["float"]) if isinstance(v, dict) else v

        return cls(x["name"], [ColumnDef(**(c | {"default": value(c["default"])})) for c in x["columns"]])


def define(s: CreateTable, find) -> TableDef:
    """The table of a CREATE TABLE, checked. find: from a name to a TableDef or None."""
    out = TableDef(s.name)
    for c in s.columns:
        nullable = not c.primary if c.nullable is None else c.nullable
        has_default = c.default is not None or nullable
        out.columns.append(ColumnDef(c.name, c.kind, c.primary, nullable, has_default, fold(c.default) if c.default is not None else None, c.unique or c.primary, c.indexed and not c.primary, c.references))
    if not out.columns:
        raise ValueError_(f"Table {s.name} has no columns")
    n = sum(c.primary for c in out.columns)
    if n != 1:
        raise ValueError_(f"{'Multiple primary keys' if n else 'No primary key'} in table {s.name}")
    for c in out.columns:
        if c.primary and c.nullable:
            raise ValueError_(f"Primary key {c.name} cannot be nullable")
        if c.has_default and type_of(c.default) != c.kind:
            if c.default is not None:
                raise ValueError_(f"Default value for column {c.name} has datatype {type_of(c.default)}, must be {c.kind}")
            if not c.nullable:
                raise ValueError_(f"Can't use NULL as default value for non-nullable column {c.name}")
        if c.references:
            target = out if c.references == s.name else find(c.references)
            if target is None:
                raise ValueError_(f"Table {c.references} referenced by column {c.name} does not exist")
            if target.primary.kind != c.kind:
                raise ValueError_(f"Can't reference {target.primary.kind} primary key of table {target.name} from {c.kind} column {c.name}")
    return out
