"""Secondary indexes, derived on read: Parquet has the values, a scan with a pushed-down filter finds them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.errors import ValueError_
from millrace.operators.mutation import c
from millrace.sources.catalog import TableDef


def indexed(table: TableDef, column: str) -> None:
    if not table.column(column).indexed:
        raise ValueError_(f"Column {column} in table {table.name} is not indexed")


def scan_index(df: DataFrame, table: TableDef, column: str) -> DataFrame:
    """value, keys (sorted array) in the order of values, NULL first."""
    indexed(table, column)
    keys = F.sort_array(F.collect_set(c(table.primary.name))).alias("keys")
    return df.groupBy(c(column).alias("value")).agg(keys).orderBy("value")


def read_index(df: DataFrame, table: TableDef, column: str, value) -> DataFrame:
    """The keys with this value."""
    indexed(table, column)
    return df.filter(c(column).eqNullSafe(F.lit(value))).select(c(table.primary.name).alias("key")).orderBy("key")
