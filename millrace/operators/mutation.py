"""INSERT, UPDATE and DELETE over immutable versions, with the constraints checked set-wise.

The dialect carries a statement out row by row in key order, and each row sees those before it. The checks say the
same with joins: what row i meets is the new state of rows with smaller keys and the old state of the others.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.errors import ValueError_
from millrace.functions.scalars import SPARK_TYPES, build, condition
from millrace.operators.select import Scope
from millrace.plans.constants import fold, show, type_of
from millrace.plans.syntax import Delete, Insert, Update
from millrace.sources.catalog import MOST_BYTES, SPARK, ColumnDef, TableDef

#: Keys that a statement reports to the transaction, unless the engine says otherwise (Engine.most_keys); beyond, it
#: claims the whole table.
TOUCHED = 100_000


def c(name: str):
    return F.col("`" + name.replace("`", "``") + "`")


def scope_of(table: TableDef) -> Scope:
    return Scope([(table.name, x.name, x.kind, "`" + x.name.replace("`", "``") + "`") for x in table.columns])


def key(v):
    """NaN is one key."""
    return "nan" if isinstance(v, float) and math.isnan(v) else v


def touched_keys(df: DataFrame, name: str, most: int) -> set | None:
    found = df.select(name).limit(most + 1).collect()
    return None if len(found) > most else {key(r[0]) for r in found}


def present(df: DataFrame, column: ColumnDef, values: list) -> set:
    """Which of a statement's values a stored column holds. The values come from the statement's text."""
    if not values:
        return set()
    spark = df.sparkSession
    wanted = spark.createDataFrame([(v,) for v in values], f"__v {SPARK[column.kind].simpleString()}")
    return {key(r[0]) for r in df.join(F.broadcast(wanted), c(column.name) == F.col("__v"), "left_semi").select(c(column.name)).distinct().collect()}


def insert(txn, s: Insert) -> int:
    table = txn.must_find(s.table)
    rows = []
    for given in s.rows:
        values = [fold(e) for e in given]
        names = s.columns if s.columns is not None else [x.name for x in table.columns]
        if s.columns is None and len(values) > len(names):
            raise ValueError_(f"Row has {len(values)} columns, expected {len(names)}")
        if s.columns is not None and len(names) != len(values):
            raise ValueError_("Column and value counts do not match")
        row = {}
        for name, v in zip(names, values, strict=False):
            table.column(name)
            if name in row:
                raise ValueError_(f"Column {name} given multiple times")
            row[name] = v
        for x in table.columns:
            if x.name not in row:
                if not x.has_default:
                    raise ValueError_(f"Column {x.name} not given and has no default value")
                row[x.name] = x.default
        rows.append([row[x.name] for x in table.columns])
    stored, primary = txn.read(table), table.primary
    place = {x.name: i for i, x in enumerate(table.columns)}
    for row in rows:
        for x, v in zip(table.columns, row, strict=True):
            check_value(x, v)
    real = lambda v: v is not None and v == v
    known = {x.name: present(stored, x, [r[place[x.name]] for r in rows if real(r[place[x.name]])]) for x in table.columns if x.unique and not x.primary}
    known[primary.name] = present(stored, primary, [r[place[primary.name]] for r in rows])
    targets = {}
    for x in table.columns:
        if x.references:
            target = table if x.references == table.name else txn.must_find(x.references)
            targets[x.name] = present(txn.read(target), target.primary, [r[place[x.name]] for r in rows if real(r[place[x.name]])])
    for row in rows:
        own = row[place[primary.name]]
        for x, v in zip(table.columns, row, strict=True):
            if x.references and real(v) and v not in targets[x.name] and not (x.references == table.name and v == own):
                raise ValueError_(f"Referenced primary key {show(v)} in table {x.references} does not exist")
            if x.unique and not x.primary and real(v):
                if v in known[x.name]:
                    raise ValueError_(f"Unique value {show(v)} already exists for column {x.name}")
                known[x.name].add(v)
        if key(own) in known[primary.name]:
            raise ValueError_(f"Primary key {show(own)} already exists for table {table.name}")
        known[primary.name].add(key(own))
        for x in table.columns:
            if x.references == table.name:
                targets[x.name].add(own)
    new = txn.spark.createDataFrame([tuple(r) for r in rows], table.schema())
    txn.append(table, txn.stage(new.coalesce(1), table), {key(r[place[primary.name]]) for r in rows})  # rows of a statement's text
    return len(rows)


def load(txn, table: TableDef, df: DataFrame) -> int:
    """Adds many rows at once: the constraints as joins and aggregations, nothing on the driver but their outcome.

    All rows come at once, so they may reference each other in any order.
    """
    rows = df.select(*[c(x.name).cast(SPARK[x.kind]).alias(x.name) for x in table.columns])
    stored, primary = txn.read(table), table.primary
    path = txn.stage(rows, table)
    rows = txn.engine.store.read(table, [path])
    whole = stored.unionByName(rows)
    tests = [F.count("*").alias("n")]
    for x in table.columns:
        if not x.nullable:
            tests.append(F.sum(c(x.name).isNull().cast("long")).alias(f"null {x.name}"))
        if x.kind == "STRING":
            tests.append(F.sum((F.octet_length(c(x.name)) > MOST_BYTES).cast("long")).alias(f"long {x.name}"))
    found = rows.agg(*tests).first().asDict()
    n = found.pop("n")
    for test, bad in found.items():
        if bad:
            raise ValueError_(f"NULL value not allowed for column {test[5:]}" if test.startswith("null ") else "Strings cannot be more than 1024 bytes")
    for x in table.columns:
        if x.unique:
            twice = some(rows.filter(c(x.name).isNotNull()).groupBy(c(x.name)).count().filter("count > 1"), c(x.name)) or some(rows.join(stored.select(c(x.name).alias("__had")), c(x.name) == F.col("__had"), "left_semi"), c(x.name))
            if twice:
                raise ValueError_(f"Primary key {show(twice[0])} already exists for table {table.name}" if x.primary else f"Unique value {show(twice[0])} already exists for column {x.name}")
        if x.references:
            target = table if x.references == table.name else txn.must_find(x.references)
            keys = (whole if target is table else txn.read(target)).select(c(target.primary.name).alias("__key"))
            given = rows.filter(c(x.name).isNotNull() & (~F.isnan(c(x.name)) if x.kind == "FLOAT" else F.lit(True)))
            missing = some(given.join(keys, c(x.name) == F.col("__key"), "left_anti"), c(x.name))
            if missing:
                raise ValueError_(f"Referenced primary key {show(missing[0])} in table {x.references} does not exist")
    txn.append(table, path, touched_keys(rows, primary.name, txn.engine.most_keys))
    return n


def check_value(x: ColumnDef, v) -> None:
    if v is None:
        if not x.nullable:
            raise ValueError_(f"NULL value not allowed for column {x.name}")
    elif type_of(v) != x.kind:
        raise ValueError_(f"Invalid datatype {type_of(v)} for {x.kind} column {x.name}")
    elif isinstance(v, str) and len(v.encode()) > MOST_BYTES:
        raise ValueError_("Strings cannot be more than 1024 bytes")


def some(df: DataFrame, *columns):
    return df.select(*columns).first()


def update(txn, s: Update) -> int:
    table = txn.must_find(s.table)
    primary, resolve = table.primary.name, scope_of(table).resolve
    match = F.coalesce(condition(s.where, resolve, "Filter"), F.lit(False)) if s.where is not None else F.lit(True)
    new = {}
    for name, e in s.assign.items():
        x, t = table.column(name), build(e, resolve)
        if t.kind not in (x.kind, None):
            if not some(txn.read(table).filter(match), F.lit(1)):
                return 0  # no row is evaluated
            raise ValueError_(f"Invalid datatype {t.kind} for {x.kind} column {name}")
        new[name] = t.column.cast(SPARK_TYPES[x.kind])
    made = [F.when(match, new[x.name]).otherwise(c(x.name)).alias(x.name) if x.name in new else c(x.name) for x in table.columns]
    old = [c(n).alias(f"__old_{n}") for n in dict.fromkeys([primary, *s.assign])]
    tests = [F.count("*").alias("n")]
    for name in new:
        x = table.column(name)
        if not x.nullable:
            tests.append(F.sum(new[name].isNull().cast("long")).alias(f"null {name}"))
        if x.kind == "STRING":
            tests.append(F.sum((F.octet_length(new[name]) > MOST_BYTES).cast("long")).alias(f"long {name}"))
    counted = txn.read(table).filter(match).agg(*tests).first().asDict()
    n = counted.pop("n")
    if not n:
        return 0
    for test, bad in counted.items():
        if bad:
            raise ValueError_(f"NULL value not allowed for column {test[5:]}" if test.startswith("null ") else "Strings cannot be more than 1024 bytes")
    # the checks read the old parts with the new values beside the old; only the table's columns are written, at the end
    parts, others = txn.parts(table, match)
    staged = txn.read_parts(table, parts).select(*made, *old, match.alias("__m"))
    every = staged.unionByName(txn.read_parts(table, others).select("*", *old, F.lit(False).alias("__m"))) if others else staged
    hit, was = staged.filter("__m"), f"__old_{primary}"
    moved = hit.filter(c(primary) != c(was))
    i, j = staged.alias("i"), every.alias("j")
    at = lambda side, name: F.col(f"{side}.`{name}`")
    later = at("j", was) > at("i", was)
    moved_j = at("j", "__m") & (at("j", primary) != at("j", was))
    moved_i = at("i", "__m") & (at("i", primary) != at("i", was))
    if primary in new:
        clash = i.filter(moved_i).join(j, (at("i", primary) == at("j", was)) & (at("j", was) != at("i", was)) & (~moved_j | later), "left_semi").select(c(primary), c(was))
        twice = i.filter(moved_i).join(j, (at("i", primary) == at("j", primary)) & moved_j & (at("j", was) < at("i", was)), "left_semi").select(c(primary), c(was))
        found = some(clash.unionByName(twice).orderBy(c(was)), c(primary))
        if found:
            raise ValueError_(f"Primary key {show(found[0])} already exists for table {table.name}")
        for other, x in txn.references(table.name):
            if other.name == table.name:
                fk_was = at("j", f"__old_{x.name}") if x.name in new else at("j", x.name)
                fk = F.when(at("j", "__m") & (at("j", was) < at("i", was)), at("j", x.name)).otherwise(fk_was)
                hits = i.filter(moved_i).join(j, (at("i", was) == fk) & (at("i", was) != at("j", was)), "left_semi").select(c(was)).orderBy(c(was))
            else:
                hits = moved.join(txn.read(other).select(c(x.name).alias("__fk")), c(was) == F.col("__fk"), "left_semi").select(c(was)).orderBy(c(was))
            found = some(hits, c(was))
            if found:
                raise ValueError_(refused(found[0], table.name, x.name, other.name))
    for x in table.columns:
        if x.references == table.name and (x.name in new or primary in new):
            there = F.when(at("j", "__m") & (at("j", was) <= at("i", was)), at("j", primary)).otherwise(at("j", was))
            checked = i.filter(at("i", "__m") & at("i", x.name).isNotNull() & (F.lit(x.name in new) | moved_i))
            missing = some(checked.join(j, at("i", x.name) == there, "left_anti").orderBy(c(was)), c(x.name))
        elif x.references and x.name in new:
            target = txn.must_find(x.references)
            keys = txn.read(target).select(c(target.primary.name).alias("__key"))
            missing = some(hit.filter(c(x.name).isNotNull() & (~F.isnan(c(x.name)) if x.kind == "FLOAT" else F.lit(True))).join(keys, c(x.name) == F.col("__key"), "left_anti").orderBy(c(was)), c(x.name))
        else:
            missing = None
        if missing:
            raise ValueError_(f"Referenced primary key {show(missing[0])} in table {x.references} does not exist")
        if x.unique and not x.primary and x.name in new:
            mine, apart = i.filter(at("i", "__m")), at("i", was) != at("j", was)
            before = mine.join(j, (at("i", x.name) == at("j", f"__old_{x.name}")) & apart & (~at("j", "__m") | later), "left_semi").select(c(x.name), c(was))
            after = mine.join(j, (at("i", x.name) == at("j", x.name)) & at("j", "__m") & (at("j", was) < at("i", was)), "left_semi").select(c(x.name), c(was))
            found = some(before.unionByName(after).orderBy(c(was)), c(x.name))
            if found:
                raise ValueError_(f"Unique value {show(found[0])} already exists for column {x.name}")
    path = txn.stage(staged.select(*[c(x.name) for x in table.columns]), table)
    keys = touched_keys(hit, was, txn.engine.most_keys)
    if keys is not None and primary in new:
        more = touched_keys(hit, primary, txn.engine.most_keys)
        keys = None if more is None else keys | more
    txn.publish(table, path, others, keys)
    return n


def refused(v, table: str, column: str, other: str) -> str:
    return f"Cannot delete row {show(v)} from table {table} because it is referenced by column {column} in table {other}"


def delete(txn, s: Delete) -> int:
    table = txn.must_find(s.table)
    primary = table.primary.name
    match = F.coalesce(condition(s.where, scope_of(table).resolve, "Filter"), F.lit(False)) if s.where is not None else F.lit(True)
    rows = txn.read(table).withColumn("__m", match)
    doomed = rows.filter("__m")
    n = doomed.count()
    if not n:
        return 0
    for other, x in txn.references(table.name):
        if other.name == table.name:
            r, q = doomed.alias("r"), rows.alias("q")
            pk, fk, from_ = F.col(f"r.`{primary}`"), F.col(f"q.`{x.name}`"), F.col(f"q.`{primary}`")
            hits = r.join(q, (pk == fk) & (from_ != pk) & (~F.col("q.__m") | (from_ > pk)), "left_semi")
        else:
            hits = doomed.join(txn.read(other).select(c(x.name).alias("__fk")), c(primary) == F.col("__fk"), "left_semi")
        found = some(hits.orderBy(c(primary)), c(primary))
        if found:
            raise ValueError_(refused(found[0], table.name, x.name, other.name))
    parts, others = txn.parts(table, match)
    txn.publish(table, txn.stage(txn.read_parts(table, parts).filter(~match), table), others, touched_keys(doomed, primary, txn.engine.most_keys))
    return n


def merge(latest: DataFrame, mine: DataFrame, primary: ColumnDef, touched: set) -> DataFrame:
    """The latest version with a transaction's own rows in place of those that it touched."""
    values = [float("nan") if v == "nan" and primary.kind == "FLOAT" else v for v in touched]
    keys = F.broadcast(latest.sparkSession.createDataFrame([(v,) for v in values], f"__k {SPARK[primary.kind].simpleString()}"))  # at most TOUCHED
    on = c(primary.name) == F.col("__k")
    return reduce(DataFrame.unionByName, [latest.join(keys, on, "left_anti"), mine.join(keys, on, "left_semi")])
