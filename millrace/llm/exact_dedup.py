"""Exact dedup against a minimal perfect hash of historical digests.

Texts are equal when their SHA-256 is, after each run of ASCII white space became one space. The rows are taken as
two deliveries: history (doc_id up to the middle of the range of ids) and the new ones. For the distinct digests of
the history, each shard (a slice of the digest space) gets a minimal perfect hash: n digests, n slots; a slot holds
the whole digest and its winner's locator (smallest doc_id) with the size of its group. A new digest goes to the one
slot that its hash names, and is a repeat only if all 32 bytes there agree. The rest group among themselves.

Equal digests are summed up before any shuffle, so a text with a third of all rows is one row from each task; shards
hold about SHARD_DIGESTS digests whatever the corpus.

Cases: null and empty texts are one group; the smallest non-null doc_id stays, null ids count as larger than all
others; of rows equal in both doc_id and text one stays; an empty table gives no rows; other columns aren't read
(deduplicate() returns all columns).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import durable, each_copy, forget, fresh, normal_text, read

#: Digests in a shard, on average: about 250 KB of slots.
SHARD_DIGESTS = 5_000
#: Keys in a bucket of the perfect hash, on average.
BUCKET = 4
LAST_ID = 2**63 - 1
INDEX = "shard long, n long, salt long, seeds binary, digests binary, locators binary, sizes binary"


def _mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (Stafford's variant 13)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _words(digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit words of each 32-byte digest (uint8 rows)."""
    w = np.ascontiguousarray(digests).view("<u8")
    return w[:, 1], w[:, 2]


def _slots(a: np.ndarray, b: np.ndarray, seeds: np.ndarray, n: int, salt: int) -> np.ndarray:
    bucket = (_mix(a + np.uint64(salt)) % np.uint64(len(seeds))).astype(np.int64)
    with np.errstate(over="ignore"):
        return (_mix(b + seeds[bucket].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(n)).astype(np.int64)


def perfect_hash(digests: np.ndarray) -> tuple[int, np.ndarray]:
    """Hash and displace: (salt, a seed for each bucket) so that distinct digests fill the slots 0..n-1.

    Buckets are placed from the largest down; each tries seeds 1, 2, ... until all its keys fall on free slots.
    """
    n = len(digests)
    a, b = _words(digests)
    for salt in range(1, 100):
        m = max(1, n // BUCKET)
        bucket = (_mix(a + np.uint64(salt)) % np.uint64(m)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        sizes = np.bincount(bucket, minlength=m)
        starts = np.concatenate([[0], np.cumsum(sizes)])
        seeds, free, done = np.zeros(m, np.uint32), np.ones(n, bool), True
        for k in np.argsort(-sizes, kind="stable"):
            if not sizes[k]:
                break
            keys, seed, step = b[order[starts[k] : starts[k + 1]]], 1, 64
            while True:
                tried = np.arange(seed, seed + step, dtype=np.uint64)
                with np.errstate(over="ignore"):
                    at = (_mix(keys[None, :] + tried[:, None] * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(n)).astype(np.int64)
                fits = free[at].all(axis=1)
                if len(keys) > 1:
                    ordered = np.sort(at, axis=1)
                    fits &= (ordered[:, 1:] != ordered[:, :-1]).all(axis=1)
                if fits.any():
                    i = int(np.argmax(fits))
                    free[at[i]] = False
                    seeds[k] = tried[i]
                    break
                seed, step = seed + step, min(step * 4, 1 << 16)
                if seed > 200 * n + (1 << 20):  # two keys share both words' hashes, or bad luck: another salt
                    done = False
                    break
            if not done:
                break
        if done:
            return salt, seeds
    raise ValueError("digests aren't distinct")


def _as_rows(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, 32)


def build_index(history: DataFrame, shards: int) -> DataFrame:
    """history: distinct digest (32 bytes), locator, size, shard. A row for each shard that has digests."""

    def build(table: pa.Table) -> pa.Table:
        digests = _as_rows(table.column("digest"))
        salt, seeds = perfect_hash(digests)
        a, b = _words(digests)
        at = _slots(a, b, seeds, len(digests), salt)
        placed = np.empty_like(digests)
        placed[at] = digests
        kept = {}
        for c in ("locator", "size"):
            kept[c] = np.empty(len(at), "<i8")
            kept[c][at] = table.column(c).to_numpy()
        row = [table.column("shard")[0].as_py(), len(at), salt, seeds.tobytes(), placed.tobytes(), kept["locator"].tobytes(), kept["size"].tobytes()]
        return pa.table([[x] for x in row], names=[x.split()[0] for x in INDEX.split(", ")])

    return history.groupBy("shard").applyInArrow(build, INDEX)


def look_up(index: dict, digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(slot, whether that slot's digest agrees in all bytes) for each digest."""
    a, b = _words(digests)
    at = _slots(a, b, np.frombuffer(index["seeds"], np.uint32), index["n"], index["salt"])
    return at, (np.frombuffer(index["digests"], np.uint8).reshape(-1, 32)[at] == digests).all(axis=1)


RESOLVED = "digest binary, keep_id long, group_size long"


def probe(new: DataFrame, index: DataFrame) -> DataFrame:
    """Groups of all digests, old and new: digest, keep_id, group_size.

    new: distinct digests with locator, size and shard. Members add their size to the slot's; nonmembers, already one
    row a digest, stand for their own group.
    """

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        digests, locator, size = (_as_rows(left.column("digest")), *(left.column(c).to_numpy().astype(np.int64) for c in ("locator", "size")))
        if right.num_rows:
            x = right.to_pylist()[0]
            at, found = look_up(x, digests) if len(digests) else (np.empty(0, np.int64), np.empty(0, bool))
            locators, sizes = np.frombuffer(x["locators"], "<i8").copy(), np.frombuffer(x["sizes"], "<i8").copy()
            sizes[at[found]] += size[found]
            locators[at[found]] = np.minimum(locators[at[found]], locator[found])
            old = np.frombuffer(x["digests"], np.uint8).reshape(-1, 32)
            digests, locator, size = np.concatenate([old, digests[~found]]), np.concatenate([locators, locator[~found]]), np.concatenate([sizes, size[~found]])
        return pa.table([pa.array([d.tobytes() for d in digests], pa.binary()), pa.array(locator), pa.array(size)], names=["digest", "keep_id", "group_size"])

    return new.groupBy("shard").cogroup(index.groupBy("shard")).applyInArrow(run, RESOLVED)


def digested(docs: DataFrame) -> DataFrame:
    """doc_id (null as LAST_ID), and the digest of the normalised text."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("doc_id"), F.unhex(F.sha2(normal_text(), 256)).alias("digest"))


def resolve(rows: DataFrame) -> DataFrame:
    """rows: doc_id, digest. A row for each group of equal rows: doc_id, digest, n (rows), keep_id, group_size."""
    each = durable(rows.groupBy("doc_id", "digest").agg(F.count("*").alias("n")))
    low, high, total = each.agg(F.min("doc_id"), F.max(F.when(F.col("doc_id") < LAST_ID, F.col("doc_id"))), F.count("*")).first()
    middle = LAST_ID if high is None else (low + high) // 2
    shards = max(1, (total or 0) // SHARD_DIGESTS)
    shard = F.pmod(F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long"), F.lit(shards))
    delivered = each.groupBy("digest", (F.col("doc_id") <= middle).alias("old")).agg(F.min("doc_id").alias("locator"), F.sum("n").alias("size")).withColumn("shard", shard)
    delivered = durable(delivered)
    old = delivered.filter("old").drop("old")
    groups = probe(delivered.filter("NOT old").drop("old"), build_index(old, shards))
    return each.join(groups, "digest")


def decide(docs: DataFrame) -> DataFrame:
    """A row for each document: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = resolve(digested(docs))
    # equal rows come back as many times as they were; the first copy of the winner stays
    rows = each_copy(rows, "n", "copy")
    back = lambda c: F.when(F.col(c) < LAST_ID, F.col(c)).alias(c)
    kept = (F.col("doc_id") == F.col("keep_id")) & (F.col("copy") == 0)
    return rows.select(back("doc_id"), back("keep_id"), "group_size", kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, one for each text, with all their columns."""
    names = docs.columns
    id_, digest = keys = fresh(names, "id", "digest")
    marked = docs.withColumns({id_: F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)), digest: F.unhex(F.sha2(normal_text(), 256))})
    groups = durable(resolve(digested(docs)))
    winners = groups.filter("doc_id = keep_id").select(F.col("doc_id").alias(id_), F.col("digest").alias(digest), F.col("n").alias("times"))
    out = marked.join(winners.filter("times = 1").select(*keys), keys, "left_semi")
    if not winners.filter("times > 1").isEmpty():  # rows equal in doc_id and text: any one of them stays
        again = marked.join(winners.filter("times > 1").select(*keys), keys, "left_semi")
        out = out.unionByName(again.dropDuplicates(keys))
    return out.select(*[F.col("`" + c.replace("`", "``") + "`") for c in names])


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decide(read(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (
  SELECT CAST(doc_id AS BIGINT) AS doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""
