"""Helpers that the corpus operators share: reading, chunked Arrow maps, durable checkpoints."""

from __future__ import annotations

import pickle
import re
import sys
import tempfile
import types
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space of the word rule: \x20 and \x09-\x0D (what bytes.split() splits at, too).
WS = " \t\n\x0b\x0c\r"
#: Text handled at once inside a Python worker, so that its memory doesn't follow the batch size.
CHUNK_BYTES = 4 << 20
#: Rows in an Arrow batch; long documents make larger batches too costly.
BATCH_ROWS = 1000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the corpus, read by Spark alone (any Hadoop path)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bounds the rows of an Arrow batch in this session; an even smaller setting stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder in spark.checkpoint.dir; where that is unset and all runs on this machine, a temporary one."""
    sc = spark.sparkContext
    found = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="millrace-checkpoint-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found


#: Lets Spark remove the shuffle files of an execution when it has ended; set while durable() writes.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def durable(df: DataFrame) -> DataFrame:
    """The rows of df, written to the shared folder as Parquet and read again: cuts the lineage, and
    survives lost executors. Column types and names stay; the files go with forget() or with the folder."""
    spark = df.sparkSession
    out = f"{checkpoint_dir(spark)}/millrace/{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        # the writer of a select() made now reads the setting
        df.select("*").write.option("compression", "zstd").parquet(out)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    made = spark.read.schema(df.schema).parquet(out)
    made.durable_path = out
    return made


def forget(*frames: DataFrame | None) -> None:
    """Deletes what durable() wrote for these frames; nothing that is still to run may read them."""
    for df in frames:
        path = getattr(df, "durable_path", None)
        if path:
            jvm = df.sparkSession.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
            df.durable_path = None


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in order, cut so that a piece holds about `most` bytes of `column` (or one row)."""
    import pyarrow.compute as pc

    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        first, held = 0, 0
        for i, n in enumerate(sizes):
            if held and held + n > most:
                yield batch.slice(first, i - first)
                first, held = i, 0
            held += n
        if first < len(sizes):
            yield batch.slice(first)


def by_text(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """mapInArrow over pieces of bounded text; f makes one record batch of each."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            yield f(piece)

    return df.mapInArrow(run, schema)


def reducers(spark: SparkSession, total_bytes: float = 0, each: int = 128 << 20) -> int:
    """Shuffle partitions: the session's number, more where a partition would exceed `each` bytes."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(total_bytes // each) + 1)


def fresh(taken: list[str], *wanted: str) -> list[str]:
    """The wanted column names, with underscores in front until no column in `taken` (any case) has them."""
    used = {c.lower() for c in taken}
    out = []
    for name in wanted:
        while name.lower() in used:
            name = "_" + name
        used.add(name.lower())
        out.append(name)
    return out


#: Copies of a row made from one array; more come from several.
COPIES = 1 << 16


def each_copy(df: DataFrame, times: str, copy: str) -> DataFrame:
    """As many rows of each row as its column `times` says, numbered from 0 in a new column `copy`; column times goes.
    Any number: the arrays in between have at most COPIES numbers, or one for each COPIES."""
    part = fresh(df.columns, "part")[0]
    parts = df.withColumn(part, F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(times) - 1) / COPIES))))
    last = F.least(F.col(times) - 1, (F.col(part) + 1) * COPIES - 1)
    return parts.withColumn(copy, F.explode(F.sequence(F.col(part) * COPIES, last))).drop(part, times)


def normal_text(text: str | F.Column = "text") -> F.Column:
    """Null as empty, each run of ASCII white space as one space."""
    return F.regexp_replace(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def shared(spark: SparkSession, value: object) -> Callable[[], object]:
    """A broadcast of a model of bounded size; its class travels by value, too. A Python worker loads it once and keeps
    it for its next tasks, until there is another."""
    sent, name = spark.sparkContext.broadcast(cloudpickle.dumps(value)), uuid.uuid4().hex

    def get() -> object:
        held = worker_wide("shared", dict)
        if name not in held:
            held.clear()
            held[name] = pickle.loads(sent.value)
        return held[name]

    return get


def worker_wide(name: str, make: Callable[[], object]) -> object:
    """An object of this Python worker, made once and kept from task to task (functions come anew with each task)."""
    held = sys.modules.setdefault("millrace_worker", types.ModuleType("millrace_worker")).__dict__
    if name not in held:
        held[name] = make()
    return held[name]


class Recent:
    """A bounded table: when it is full it becomes the old one, and what is asked for again moves to the new one."""

    def __init__(self, most: int):
        self.most, self.new, self.old = most, {}, {}

    def get(self, k):
        found = self.new.get(k)
        if found is None and (found := self.old.get(k)) is not None:
            self.put(k, found)
        return found

    def put(self, k, v) -> None:
        if len(self.new) >= self.most:
            self.old, self.new = self.new, {}
        self.new[k] = v
