"""SELECT as a DataFrame.

Columns of FROM get internal names (c0, c1, ...) that nothing can confuse; labels come back at the very end. Catalyst
sees one declarative plan: it prunes columns, pushes filters into the scans and picks the joins.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.errors import ValueError_
from millrace.functions.aggregates import NAMES, aggregate
from millrace.functions.scalars import SPARK_TYPES, Typed, build, condition
from millrace.plans.constants import fold, show
from millrace.plans.explain import Node, show_expression
from millrace.plans.syntax import Call, Field, Hole, Join, Op, Select, Table, walk
from millrace.sources.external import INSTANT

INT_MAX = 2**31 - 1


@dataclass
class Scope:
    """What names mean: (table label, column name, type, internal name), in FROM order."""

    columns: list[tuple[str, str, str, str]] = field(default_factory=list)
    constant: bool = False
    #: Internal names of texts of timestamps -> Spark type of these; they are under the name with "t" behind it.
    instants: dict[str, str] = field(default_factory=dict)

    def tables(self) -> set[str]:
        return {c[0] for c in self.columns}

    def find(self, f: Field) -> tuple[str, str, str, str]:
        if self.constant:
            raise ValueError_(f"Expression must be constant, found field {f}")
        if f.table is not None:
            if f.table not in self.tables():
                raise ValueError_(f"Unknown table {f.table}")
            found = [c for c in self.columns if c[:2] == (f.table, f.name)]
        else:
            found = [c for c in self.columns if c[1] == f.name]
            if len(found) > 1:
                raise ValueError_(f"Ambiguous field {f.name}")
        if not found:
            raise ValueError_(f"Unknown field {f}")
        return found[0]

    def resolve(self, f: Field) -> Typed:
        c = self.find(f)
        return Typed(F.col(c[3]), c[2], instant=(F.col(c[3] + "t"), self.instants[c[3]]) if c[3] in self.instants else None)

    def with_(self, other: Scope) -> Scope:
        for t in sorted(other.tables() & self.tables()):
            raise ValueError_(f"Duplicate table name {t}")
        return Scope(self.columns + other.columns, instants=self.instants | other.instants)


@dataclass
class Planned:
    """A query: its rows under unique names, the labels and types to show, and its tree."""

    df: DataFrame
    labels: list[str]
    kinds: list[str | None]
    tree: Node

    def labelled(self) -> DataFrame:
        """The rows under their labels (Spark allows repeated names in an output)."""
        return self.df.toDF(*self.labels)


def replace(e, f):
    """The expression with f applied from the top; where f gives None, its operands are tried."""
    new = f(e)
    if new is not None:
        return new
    if isinstance(e, Op):
        return Op(e.name, tuple(replace(x, f) for x in e.args))
    if isinstance(e, Call):
        return Call(e.name, tuple(replace(x, f) for x in e.args))
    return e


def is_aggregate(e) -> bool:
    return isinstance(e, Call) and e.name in NAMES


def has_aggregate(e) -> bool:
    return any(is_aggregate(x) for x in walk(e))


class Planner:
    """tables: from a name to (DataFrame, [(column, type)], primary key or None, indexed columns)."""

    def __init__(self, spark: SparkSession, tables):
        self.spark, self.tables, self.next = spark, tables, 0

    # FROM

    def scan(self, t: Table) -> tuple[DataFrame, Scope, Node]:
        df, columns, primary, indexed = self.tables(t.name)
        label, scope, out, instants, types = t.alias or t.name, [], [], {}, dict(df.dtypes)
        for name, kind in columns:
            internal = f"c{self.next}"
            self.next += 1
            scope.append((label, name, kind, internal))
            out.append(F.col("`" + name.replace("`", "``") + "`").alias(internal))
            if INSTANT + name in types:
                out.append(F.col("`" + (INSTANT + name).replace("`", "``") + "`").alias(internal + "t"))
                instants[internal] = types[INSTANT + name]
        node = Node("Scan", f"{t.name} as {t.alias}" if t.alias else t.name, [], {"table": t.name, "primary": primary, "indexed": indexed})
        return df.select(*out), Scope(scope, instants=instants), node

    def source(self, s) -> tuple[DataFrame, Scope, Node]:
        if isinstance(s, Table):
            return self.scan(s)
        left, scope, a = self.source(s.left)
        right, more, b = self.scan(s.right)
        scope = scope.with_(more)
        if s.kind == "cross":
            return left.crossJoin(right), scope, Node("NestedLoopJoin", "inner", [a, b])
        on = condition(s.on, scope.resolve, "Join predicate")
        equal = isinstance(s.on, Op) and s.on.name == "=" and all(isinstance(x, Field) for x in s.on.args)
        node = Node("HashJoin" if equal else "NestedLoopJoin", f"{'inner' if s.kind == 'inner' else 'outer'} on {show_expression(s.on)}", [a, b])
        return left.join(right, on, s.kind), scope, node

    def sources(self, sources: list) -> tuple[DataFrame, Scope, Node]:
        df, scope, node = self.source(sources[0])
        for s in sources[1:]:
            right, more, other = self.source(s)
            scope = scope.with_(more)
            df, node = df.crossJoin(right), Node("NestedLoopJoin", "inner", [node, other])
        return df, scope, node

    # SELECT

    def plan(self, s: Select) -> Planned:
        if s.sources:
            df, scope, node = self.sources(s.sources)
        elif not s.items:
            raise ValueError_("Can't select * without a table")
        else:
            df, scope, node = self.spark.range(1).select(), Scope(constant=True), Node("Nothing")
        if s.where is not None:
            df = df.filter(condition(s.where, scope.resolve, "Filter"))
            node = node.filtered(s.where, scope)
        items = s.items or [(Field(t, n), None) for t, n, _, _ in scope.columns]
        aliases = {label: e for e, label in items if label}

        def open_alias(e, inside: bool = False):
            """Aliases of the select list replaced by what they name."""

            def f(x):
                if is_aggregate(x):
                    args = tuple(open_alias(a, True) for a in x.args)
                    if any(has_aggregate(a) for a in args) and not any(has_aggregate(a) for a in x.args):
                        raise ValueError_("Aggregate function cannot reference aggregate")
                    return Call(x.name, args)
                if isinstance(x, Field) and x.table is None and x.name in aliases:
                    named = aliases[x.name]
                    if inside and not has_aggregate(named) and any(c[1] == x.name for c in scope.columns):
                        return x
                    return Op("alias", (named,))
                return None

            return replace(e, f)

        having = open_alias(s.having) if s.having is not None else None
        order = [(open_alias(e), up) for e, up in s.order]
        outputs = [e for e, _ in items]
        used = [*outputs, *([having] if having is not None else []), *(e for e, _ in order)]
        resolve = scope.resolve
        if s.group or any(has_aggregate(e) for e in used):
            df, rewrite, node = self.grouped(df, scope, [open_alias(e) for e in s.group], used, node)
            outputs = [rewrite(e) for e in outputs]
            having = rewrite(having) if having is not None else None
            order = [(rewrite(e), up) for e, up in order]

            def resolve(f: Field) -> Typed:
                raise ValueError_(f"Unknown field {f}")

        typed = [build(e, resolve) for e in outputs]
        if having is not None:
            df, node = df.filter(condition(having, resolve, "Filter")), Node("Filter", show_expression(having), [node])
        names = [f"o{i}" for i in range(len(typed))]
        hidden = [build(e, resolve) for e, _ in order]
        made = [t.column.cast(SPARK_TYPES[t.kind or "BOOLEAN"]).alias(n) for t, n in zip(typed, names, strict=True)]
        keys = [f"h{i}" for i in range(len(hidden))]
        df = df.select(*made, *[t.column.alias(k) for t, k in zip(hidden, keys, strict=True)])
        if order:
            df = df.orderBy(*[F.col(k).asc() if up else F.col(k).desc() for k, (_, up) in zip(keys, order, strict=True)])
            node = Node("Order", ", ".join(f"{show_expression(e)} {'asc' if up else 'desc'}" for e, up in s.order), [node])
        if s.offset is not None:
            n = count_of(s.offset, "offset")
            df = df.offset(n) if n <= INT_MAX else df.limit(0)
            node = Node("Offset", str(n), [node])
        if s.limit is not None:
            n = count_of(s.limit, "limit")
            df = df.limit(n) if n <= INT_MAX else df
            node = Node("Limit", str(n), [node])
        if keys:
            df = df.select(*names)
        if s.items:
            node = Node("Projection", ", ".join(show_expression(e) for e in [e for e, _ in items]), [node])
        labels = [label or (e.name if isinstance(e, Field) else "?") for e, label in items]
        return Planned(df, labels, [t.kind for t in typed], node)

    def grouped(self, df: DataFrame, scope: Scope, groups: list, used: list, node: Node):
        """Groups df; gives a function that replaces group keys and aggregates by the new columns."""

        def canonical(e):
            """Fields by internal name, so that t.x and x are the same; unknown ones stay."""

            def f(x):
                if isinstance(x, Field):
                    try:
                        return Hole(*scope.find(x)[3:1:-1])
                    except ValueError_:
                        return None
                return canonical(x.args[0]) if isinstance(x, Op) and x.name == "alias" else None

            return replace(e, f)

        for e in groups:
            for x in walk(e):
                if isinstance(x, Field):
                    scope.find(x)
                if is_aggregate(x):
                    raise ValueError_("Aggregate function cannot reference aggregate")
        keys, keyed = [], []
        for i, e in enumerate(groups):
            t = build(e, scope.resolve)
            keys.append((canonical(e), Hole(f"g{i}", t.kind)))
            keyed.append(t.column.cast(SPARK_TYPES[t.kind or "BOOLEAN"]).alias(f"g{i}"))
            if t.instant:  # the same groups; on streams this is what the watermark is about
                keyed.append(t.instant[0].alias(f"g{i}t"))
        found: dict = {}
        columns: list = []

        def rewrite(e, whole: bool = True):
            """Group columns may stand anywhere, other group expressions only as a whole (or behind an alias)."""
            if isinstance(e, Op) and e.name == "alias":
                return rewrite(e.args[0])
            own = canonical(e)
            for key, hole in keys:
                if own == key and (whole or isinstance(key, Hole)):
                    return hole
            if is_aggregate(e):
                if any(has_aggregate(a) for a in e.args):
                    raise ValueError_("Aggregate functions can't be nested")
                if len(e.args) != 1:
                    raise ValueError_(f"Unknown function {e.name}")
                if own not in found:
                    column, kind = aggregate(e.name, build(e.args[0], scope.resolve))
                    found[own] = Hole(f"a{len(found)}", kind)
                    columns.append(column.alias(found[own].column))
                return found[own]
            return Op(e.name, tuple(rewrite(a, False) for a in e.args)) if isinstance(e, Op) else e

        for e in used:
            rewrite(e)
        text = ", ".join({"avg": "average", "max": "maximum", "min": "minimum"}.get(k.name, k.name) for k in found)
        node = Node("Aggregation", text or "group", [node])
        if not columns:
            return df.select(*keyed).distinct(), rewrite, node
        return (df.groupBy(*keyed).agg(*columns) if keyed else df.agg(*columns)), rewrite, node


def count_of(e, what: str) -> int:
    v = fold(e)
    if isinstance(v, bool) or not isinstance(v, int) or v < 0:
        raise ValueError_(f"Invalid {what} {show(v)}")
    return v
