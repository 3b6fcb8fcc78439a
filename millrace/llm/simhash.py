"""SimHash near-dedup by covering locality-sensitive hashing.

A document's fingerprint has 64 bits, each the majority of that bit over the XXH64 (seed 42) of its word shingles.
Fingerprints at most RADIUS = 4 bits apart are linked, and a document's component is what links reach.

Covering masks: each bit position i gets a vector a(i) of RADIUS + 1 bits; mask v keeps the positions with an odd
<a(i), v>. The a(i) of 4 differing positions span at most 4 dimensions, so some v != 0 is orthogonal to them all, and
that mask hides every difference: each pair within the radius agrees under one of the 31 masks, always.

Work is on distinct fingerprints only. A bucket (mask, kept bits) of more than BUCKET of them is not compared as it
is: its members, which differ in the some 32 hidden bits alone, are dealt again by 31 masks over those bits. What
then still meets differs in at most 2 ** 20 ways, by construction. Inside a bucket a search from each fingerprint
links what it reaches and drops it from the rest, so at most size - 1 links leave a bucket.

Cases: null counts as empty; documents without words have fingerprint zero and link like any other; repeated rows
share a fingerprint; an empty table gives no rows; null ids stay null and count only if a component has no other.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import by_text, durable, fresh, read, reducers
from millrace.llm.components import components

RADIUS = 4
SHINGLE = 4
SEED = 42
#: Distinct fingerprints compared within one bucket before it is dealt again.
BUCKET = 4096
#: Bytes of a dealt fingerprint in a task, and of all of them in a task.
ROW_BYTES, TASK_BYTES = 48, 64 << 20
LAST_ID = 2**63 - 1
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def shingles(text: str | None, size: int) -> np.ndarray:
    """The uint64 hash of each run of `size` lower-case words (of all words where there are fewer)."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.empty(0, "<u8")
    flat = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    n = max(1, len(words) - size + 1)
    stops = ends[-n:].tolist()
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    h, digest = xxhash.xxh64_intdigest, flat
    return np.fromiter((h(digest[i:j], SEED) for i, j in zip(starts, stops, strict=True)), "<u8", n)


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """The unsigned fingerprint of one text."""
    return majority(shingles(text, size))


def majority(hashes: np.ndarray) -> int:
    """The bits that more than half of the hashes have."""
    n = len(hashes)
    if not n:
        return 0
    total = np.zeros(64, np.int64)
    for i in range(0, n, 65536):
        total += np.unpackbits(hashes[i : i + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view("<u8")[0])


@cache
def vectors(count: int, radius: int, tries: int = 300) -> tuple[int, ...]:
    """A non-zero vector of radius + 1 bits for each of `count` positions. Any choice covers; of some seeded draws, and
    of dealing them in turn, that is taken whose weakest mask keeps most positions."""
    n, r = 2 ** (radius + 1), np.random.default_rng(64)
    drawn = [np.arange(count) * 4 % (n - 1) + 1, *(r.integers(1, n, count) for _ in range(tries))]
    weakest = [(np.bitwise_count(v[None, :] & np.arange(1, n)[:, None]) % 2).sum(axis=1).min() for v in drawn]
    return tuple(int(x) for x in drawn[int(np.argmax(weakest))])


def masks(positions: list[int], radius: int = RADIUS) -> list[int]:
    """2 ** (radius + 1) - 1 masks over some bit positions, of which one hides any `radius` of them."""
    dealt = list(zip(positions, vectors(len(positions), radius), strict=True))
    return [sum(1 << p for p, x in dealt if (x & v).bit_count() % 2) for v in range(1, 2 ** (radius + 1))]


MASKS = masks(list(range(64)))


def masks_of(radius: int) -> list[int]:
    return MASKS if radius == RADIUS else masks(list(range(64)), radius)


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def spanning_links(prints: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Links that connect what chains of at most `radius` differing bits connect among distinct uint64 prints."""
    links, rest = [], prints
    while len(rest) > 1:
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            x = front.pop()
            near = np.bitwise_count(rest ^ x) <= radius
            if near.any():
                found = rest[near]
                links += [(int(x), int(y)) for y in found]
                front += list(found)
                rest = rest[~near]
    return links


def _linker(radius: int):
    def run(batches):
        """Rows (t, kept, fp) of whole buckets, in any order, to links a, b."""
        tables = [b for b in batches if b.num_rows]
        if not tables:
            return
        t, kept, fp = (np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in tables]) for c in ("t", "kept", "fp"))
        order = np.lexsort((fp, kept, t))
        t, kept, fp = t[order], kept[order], fp[order].view(np.uint64)
        edge = np.flatnonzero(np.concatenate([[True], (t[1:] != t[:-1]) | (kept[1:] != kept[:-1]), [True]]))
        many = np.flatnonzero(np.diff(edge) > 1)
        links: set[tuple[int, int]] = set()
        for k in many:
            links.update(spanning_links(fp[edge[k] : edge[k + 1]], radius))
        if links:
            out = np.array(sorted(links), np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(out[:, 0]), pa.array(out[:, 1])], names=["a", "b"])

    return run


def _dealt_again(radius: int):
    """Rows (t, fp) of large buckets, dealt by masks over the positions that mask t hides; the new t names both."""
    first = masks_of(radius)
    second = [np.array([m | x for x in masks([p for p in range(64) if not m >> p & 1], radius)], np.uint64) for m in first]

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 1024):
                t, fp = (b.column(c).to_numpy(zero_copy_only=False)[i : i + 1024] for c in ("t", "fp"))
                kept = fp.view(np.uint64)[:, None] & np.stack([second[x] for x in t])
                n = kept.shape[1]
                name = (np.arange(1, n + 1)[None, :] * 1024 + t[:, None]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(name.ravel()), pa.array(kept.ravel().view(np.int64)), pa.array(np.repeat(fp, n))], names=["t", "kept", "fp"])

    return run


def links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """prints: distinct fp (long, the fingerprint's bits). Links a, b that connect all within the radius."""
    spark = prints.sparkSession
    rows = (prints.count() + 1) * len(masks_of(radius))
    parts = reducers(spark, rows * ROW_BYTES, TASK_BYTES)
    # dealt anew before each row becomes 31, so that this isn't left to the few tasks that a small table has
    prints = prints.repartition(parts, "fp")
    table = F.explode(F.array(*[F.struct(F.lit(i).alias("t"), F.lit(_signed(m)).alias("m")) for i, m in enumerate(masks_of(radius))]))
    dealt = prints.select("fp", table.alias("x")).select(F.col("x.t").alias("t"), F.col("fp").bitwiseAND(F.col("x.m")).alias("kept"), "fp")
    sizes = dealt.groupBy("t", "kept").agg(F.count("*").alias("n")).filter(F.col("n") > BUCKET)
    large = durable(sizes.select("t", "kept"))
    if not large.isEmpty():
        again = dealt.join(large, ["t", "kept"], "left_semi").select("t", "fp").mapInArrow(_dealt_again(radius), "t int, kept long, fp long")
        dealt = dealt.join(large, ["t", "kept"], "left_anti").select("t", "kept", "fp").unionByName(again)
    return dealt.repartition(parts, "t", "kept").mapInArrow(_linker(radius), "a long, b long")


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id (null as LAST_ID), tag (a hash of the text) and fp of each row."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = np.array([fingerprint(t, size) for t in batch.column("text").to_pylist()], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tag"), pa.array(made)], names=["doc_id", "tag", "fp"])

    return by_text(docs.select(*named(), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")), run, "doc_id long, tag long, fp long")


def named(prefix: str = "") -> list[F.Column]:
    """What tells rows apart: the id, and the text where ids repeat."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias(f"{prefix}doc_id"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias(f"{prefix}tag")]


def classes(rows: DataFrame, radius: int = RADIUS) -> DataFrame:
    """rows: doc_id, fp. A row for each distinct fp: fp, root (that of its component), component_id (its smallest doc_id)."""
    prints = durable(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(prints.select("fp"), radius))
    placed = durable(prints.join(roots, prints.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    # written out, so that the join has its own exchange, which Spark splits where a component is large
    least = durable(placed.groupBy("root").agg(F.min("least").alias("component_id")))
    return placed.join(least, "root").select("fp", "root", "component_id")


def near_dedup(docs: DataFrame, size: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """A row for each document: doc_id, fingerprint, component_id."""
    rows = durable(fingerprints(docs, size))
    out = rows.join(classes(rows, radius), "fp")
    back = lambda c: F.when(F.col(c) < LAST_ID, F.col(c)).alias(c)
    return out.select(back("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), back("component_id"))


def keep_first(docs: DataFrame, size: int = 5, radius: int = RADIUS) -> DataFrame:
    """The rows of docs that stay, one for each component, with all their columns."""
    rows = durable(fingerprints(docs, size))
    return stay(docs, rows, classes(rows, radius))


def stay(docs: DataFrame, rows: DataFrame, placed: DataFrame) -> DataFrame:
    """The rows of docs with the smallest id of their component; rows: doc_id, tag, fp; placed: fp, root, component_id."""
    names = docs.columns
    id_, tag = keys = fresh(names, "id", "tag")
    same = rows.join(placed, "fp").filter("doc_id = component_id").groupBy("root", "doc_id", "tag").agg(F.count("*").alias("n"))
    # of several texts with the id that stays, that with the smallest hash
    first = durable(same.groupBy("root", "doc_id").agg(F.min(F.struct("tag", "n")).alias("x")).select(F.col("doc_id").alias(id_), F.col("x.tag").alias(tag), F.col("x.n").alias("times")))
    mark = dict(zip(keys, named(), strict=True))
    marked = docs.withColumns(mark)
    out = marked.join(first.filter("times = 1").select(*keys), keys, "left_semi")
    if not first.filter("times > 1").isEmpty():  # rows equal in id and text: any one of them stays
        out = out.unionByName(marked.join(first.filter("times > 1").select(*keys), keys, "left_semi").dropDuplicates(keys))
    return out.select(*[F.col("`" + c.replace("`", "``") + "`") for c in names])


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(read(spark, sf_dir, "documents"))
