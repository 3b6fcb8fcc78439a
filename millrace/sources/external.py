"""Read-only tables over Parquet files that others wrote.

Columns of the dialect's types stay as they are, narrower numbers widen, timestamps (to the microsecond, those that are
instants in UTC) and dates show as ISO text; other types are left out. A timestamp itself goes along under a name of its
own, so that comparisons with constants reach the scan and groups are those of instants. Only the columns of a query are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: In front of the name of a timestamp column.
INSTANT = "__instant_"


def text_of(c: Column, is_instant: bool) -> Column:
    """yyyy-MM-dd HH:mm:ss and the fraction of a second without trailing zeros; texts order as their timestamps do. An
    instant is told in UTC, whatever the session's time zone."""
    if is_instant:
        seconds = (F.unix_micros(c).cast("decimal(20,0)") / F.lit(1000000)).cast("decimal(18,6)")
        c = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=seconds)
    return c.cast("string")


def typed(df: DataFrame) -> tuple[DataFrame, list[tuple[str, str]]]:
    """The columns that the dialect knows, with their types."""
    columns, kinds = [], []
    for f in df.schema:
        c = F.col("`" + f.name.replace("`", "``") + "`")
        if isinstance(f.dataType, T.BooleanType):
            kind = "BOOLEAN"
        elif isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
            kind, c = "INTEGER", c if isinstance(f.dataType, T.LongType) else c.cast("bigint")
        elif isinstance(f.dataType, (T.FloatType, T.DoubleType, T.DecimalType)):
            kind, c = "FLOAT", c if isinstance(f.dataType, T.DoubleType) else c.cast("double")
        elif isinstance(f.dataType, (T.StringType, T.CharType, T.VarcharType)):
            kind = "STRING"
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            columns.append(c.alias(INSTANT + f.name))
            kind, c = "STRING", text_of(c, isinstance(f.dataType, T.TimestampType))
        elif isinstance(f.dataType, T.DateType):
            kind, c = "STRING", F.date_format(c, "yyyy-MM-dd")
        else:
            continue
        columns.append(c.alias(f.name))
        kinds.append((f.name, kind))
    return df.select(*columns), kinds


def folder(spark: SparkSession, path: str):
    """A table source for a folder of <name>.parquet."""
    known: dict = {}

    def find(name: str):
        if name not in known:
            try:
                known[name] = (*typed(spark.read.parquet(f"{path}/{name}.parquet")), None, ())
            except Exception as e:  # Spark names the condition, not a class
                if "PATH_NOT_FOUND" in str(e):
                    return None
                raise
        return known[name]

    return find
