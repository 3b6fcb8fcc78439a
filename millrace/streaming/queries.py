"""The dialect over Structured Streaming: statements without sorting or limits run on unbounded tables as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.errors import ValueError_
from millrace.operators.select import Planner
from millrace.plans.parser import parse
from millrace.plans.syntax import Select
from millrace.sources import external


def select(spark: SparkSession, sql: str, tables: dict[str, DataFrame], event_time: str | None = None, late: str = "10 minutes") -> DataFrame:
    """A SELECT over streaming (or static) DataFrames by name; start it with writeStream.

    event_time: a timestamp column that gets a watermark, after which late rows and old state go.
    """
    s = parse(sql)
    if not isinstance(s, Select):
        raise ValueError_("Only SELECT runs on streams")
    if s.order or s.limit is not None or s.offset is not None:
        raise ValueError_("ORDER BY, LIMIT and OFFSET need all rows, which a stream never has")

    def find(name: str):
        if name not in tables:
            raise ValueError_(f"Table {name} does not exist")
        df = tables[name]
        if df.isStreaming and event_time in df.columns:
            df = df.withWatermark(event_time, late)
        return (*external.typed(df), None, ())

    p = Planner(spark, find).plan(s)
    return p.df.toDF(*p.labels)


def append_to(session, table: str, name: str | None = None):
    """A foreachBatch function that loads each micro-batch into a table in one transaction.

    The number of the last batch is committed with its rows, for each stream and table by itself, so a batch that is
    delivered again is left out. A stream is known by `name` or, without one, by the id that its checkpoint keeps: with a
    new checkpoint it is another stream.
    """

    def load(df: DataFrame, batch: int) -> None:
        engine = session.engine
        stream = name or df.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        if not stream:
            raise ValueError_("A batch outside a stream needs a name")
        mark = f"stream:{table}:{stream}"
        if int(engine.get_metadata(mark) or -1) >= batch:
            return
        txn = engine.begin()
        try:
            txn.load(table, df)
            txn.commit({mark: str(batch)})
        except BaseException:
            txn.rollback()
            raise

    return load
