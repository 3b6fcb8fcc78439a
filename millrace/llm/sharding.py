"""Extendible hashing into shards of at most LIMIT bytes.

A document's key is the hash of its id as bits; the directory is indexed by a prefix of them. Buckets begin as one; a
bucket over the limit splits on its next bit, and only such do, so a shard is the shortest prefix whose bucket fits.
The sizes of all prefixes come from one aggregation into cells (prefixes some bits longer than the corpus needs);
splitting works on the cells, and only rows of cells that are still too large are read again, with longer prefixes.

What no bit can split (a document over the limit alone, or rows with one id and together over it) is a shard for
each `page` other than 0: no page is over the limit, but for a single document that is.

Cases: null text has 0 bytes; null ids hash as 'null'; repeated rows are counted each; an empty table gives no rows;
columns other than doc_id and text aren't read.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.common import durable, each_copy, read

LIMIT = 8 << 20
SMALL = 256 << 10
#: Bits of the cells beyond log2(bytes / limit), so that nearly all shards are found in one aggregation.
SPARE = 4
BITS = 60


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, bits (60 hash bits as text)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).cast("binary"))
    return docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), F.lpad(F.conv(F.substring(key, 1, 15), 16, 2), BITS, "0").alias("bits"))


def split(cells: DataFrame, low: int, high: int, limit: int) -> DataFrame:
    """cells: prefix (of `high` bits), n_bytes. For each cell the shortest prefix from `low` bits on whose bucket
    fits; null where not even the cell does."""
    depth = F.explode(F.sequence(F.lit(low), F.lit(high))).alias("depth")
    at = cells.select("prefix", "n_bytes", depth).withColumn("bucket", F.substring("prefix", F.lit(1), F.col("depth")))
    fits = at.groupBy("depth", "bucket").agg(F.sum("n_bytes").alias("held")).filter(F.col("held") <= limit).select("depth", "bucket")
    return at.join(fits, ["depth", "bucket"]).groupBy("prefix").agg(F.min("depth").alias("depth"))


def shard(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """A row for each document: doc_id, n_bytes, shard (its prefix), local_depth, page."""
    rows = durable(keyed(docs))
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    done, low = [], 0
    high = min(BITS, math.ceil(math.log2(max(1, total / limit))) + SPARE)
    while True:
        sized = rows.withColumn("prefix", F.substring("bits", 1, high))
        found = durable(split(sized.groupBy("prefix").agg(F.sum("n_bytes").alias("n_bytes")), low, high, limit))
        placed = sized.join(found, "prefix", "left")
        done.append(placed.filter("depth IS NOT NULL").select("doc_id", "n_bytes", F.substring("bits", F.lit(1), F.col("depth")).alias("shard"), F.col("depth").alias("local_depth"), F.lit(0).cast("long").alias("page")))
        rows = durable(placed.filter("depth IS NULL").select("doc_id", "n_bytes", "bits"))
        if high == BITS or rows.isEmpty():
            break
        low, high = high + 1, min(BITS, high + 12)
    if not rows.isEmpty():  # one id, or ids with equal hashes
        done.append(pages(rows, limit))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def pages(rows: DataFrame, limit: int) -> DataFrame:
    """rows: doc_id, n_bytes, bits. Pages of at most `limit` bytes for what has equal bits.

    Rows over half the limit have a page each. The others, in the order of their sizes, go to the page in which their
    running sum begins, where a page is half a limit: so no page gets over the limit. Equal rows are counted first and
    the sums run over the counts, so an id with very many rows isn't gathered.
    """
    half = limit // 2
    counted = durable(rows.groupBy("bits", "doc_id", "n_bytes").agg(F.count("*").alias("times")))
    order = Window.partitionBy("bits").orderBy("n_bytes", F.col("doc_id").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    large = F.col("n_bytes") > half
    before = counted.select(
        "*", large.alias("large"), F.coalesce(F.sum(F.when(large, F.col("times"))).over(order), F.lit(0)).alias("larger"),
        F.coalesce(F.sum(F.when(~large, F.col("times") * F.col("n_bytes"))).over(order), F.lit(0)).alias("held"),
    )
    each = each_copy(before, "times", "copy")
    page = F.when(F.col("large"), -1 - F.col("larger") - F.col("copy")).otherwise(1 + F.floor((F.col("held") + F.col("copy") * F.col("n_bytes")) / max(half, 1)))
    return each.select("doc_id", "n_bytes", F.col("bits").alias("shard"), F.lit(BITS).alias("local_depth"), page.cast("long").alias("page"))


def directory(shards: DataFrame) -> DataFrame:
    """The shards: shard, page, local_depth, global_depth (the largest local one, to which the directory has doubled),
    n_entries (entries of the directory that point to the shard), n_docs, n_bytes."""
    each = durable(shards.groupBy("shard", "local_depth", "page").agg(F.count("*").alias("n_docs"), F.sum("n_bytes").alias("n_bytes")))
    depth = each.agg(F.max("local_depth").alias("global_depth"))
    return each.crossJoin(F.broadcast(depth)).withColumn("n_entries", F.pow(F.lit(2.0), F.col("global_depth") - F.col("local_depth")).cast("long"))


def op4_extendible_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(read(spark, sf_dir, "documents"))


def shards_of_256k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with shards of 256 KiB, so that small tables split, too."""
    return shard(read(spark, sf_dir, "documents"), SMALL)


def shard_directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return directory(shards_of_256k(spark, sf_dir))


def sql(limit: int) -> str:
    """For tables without what no bit can split."""
    return f"""
WITH k AS (
  SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes,
         lpad(bin(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15) AS BIGINT)), {BITS}, '0') AS bits
  FROM documents),
p AS (SELECT depth, substr(bits, 1, depth) AS bucket FROM k, (SELECT CAST(unnest(generate_series(0, 40)) AS INTEGER) AS depth) GROUP BY ALL HAVING sum(n_bytes) <= {limit}),
a AS (SELECT k.doc_id, k.n_bytes, k.bits, min(depth) AS d FROM k LEFT JOIN p ON substr(k.bits, 1, p.depth) = p.bucket GROUP BY ALL)
SELECT doc_id, n_bytes, substr(bits, 1, d) AS shard, d AS local_depth, CAST(0 AS BIGINT) AS page FROM a
"""


SQL = sql(LIMIT)
SQL_SMALL = sql(SMALL)
SQL_DIRECTORY = f"""
SELECT shard, page, local_depth, max(local_depth) OVER () AS global_depth, CAST(1 << (max(local_depth) OVER () - local_depth) AS BIGINT) AS n_entries, n_docs, n_bytes
FROM (SELECT shard, page, local_depth, count(*) AS n_docs, CAST(sum(n_bytes) AS BIGINT) AS n_bytes FROM ({SQL_SMALL}) GROUP BY ALL)
"""
