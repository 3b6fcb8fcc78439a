"""Conflict-constrained best-fit packing of documents into bins of CAPACITY words.

A bin takes at most one document of a source and one of a duplicate cluster (documents whose normalised texts are
equal). Rows are dealt by a hash of their content into groups of about GROUP documents, and each group is packed alone, from the largest
item down: an item goes to the tightest bin that it fits and that holds neither its source nor its cluster (the oldest
of equals), else to a new one. Bins hang on their residual; a bit set of occupied residuals gives the successor. For
keys (sources, clusters) with many items in the group, bins carry a bitmap and each such key has its own bit set of
residuals where a bin still lacks it, so the search jumps over bins that a hot source has filled; it goes on until a
compatible bin is found. Groups depend on the row, not on source or cluster, so a hot one is spread over all groups.

A text over CAPACITY words is cut: full pieces get bins of their own, the rest is an item.

Cases: null text is empty, an item of size 0; a null source is no source and conflicts with none; clusters of empty texts don't conflict;
repeated rows are items of their own; an empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

from bisect import insort
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import durable, each_copy, normal_text, read

CAPACITY = 2048
GROUP = 20_000
#: Items of a group from which a source or cluster gets a bit of its own.
HOT = 200


def best_fit(sizes: list[int], conflicts: list[tuple], capacity: int, hot: int = HOT) -> list[int]:
    """The bin of each item, in the order given. conflicts: an item's keys; no bin holds a key twice."""
    counts = Counter(k for ks in conflicts for k in ks)
    bit = {k: i for i, k in enumerate(sorted(k for k, n in counts.items() if n >= hot))}
    slots: dict[int, list[int]] = defaultdict(list)  # residual -> its bins in order
    occupied = 0  # bit r: a bin has residual r
    lack_n = [[0] * (capacity + 1) for _ in bit]  # per hot key: bins without it at each residual
    lack = [0] * len(bit)
    residual: list[int] = []
    bitmaps: list[int] = []
    rare: list[set] = []
    every = (1 << len(bit)) - 1
    out = []

    def shift(bitmap: int, r: int, step: int) -> None:
        free = every & ~bitmap
        while free:
            j = (free & -free).bit_length() - 1
            free &= free - 1
            lack_n[j][r] += step
            if lack_n[j][r] == (step > 0):
                lack[j] ^= 1 << r

    for size, keys in zip(sizes, conflicts, strict=True):
        own = [bit[k] for k in keys if k in bit]
        need = sum(1 << j for j in own)
        cold = {k for k in keys if k not in bit and counts[k] > 1}
        left = occupied
        for j in own:
            left &= lack[j]
        left = left >> size << size
        chosen = None
        while left and chosen is None:
            r = (left & -left).bit_length() - 1
            left &= left - 1
            chosen = next((b for b in slots[r] if not bitmaps[b] & need and not (cold and rare[b] & cold)), None)
        if chosen is None:
            chosen = len(residual)
            residual.append(capacity)
            bitmaps.append(0)
            rare.append(set())
        else:
            r = residual[chosen]
            slots[r].remove(chosen)
            if not slots[r]:
                occupied ^= 1 << r
            shift(bitmaps[chosen], r, -1)
        residual[chosen] -= size
        bitmaps[chosen] |= need
        rare[chosen] |= cold
        r = residual[chosen]
        if not slots[r]:
            occupied |= 1 << r
        insort(slots[r], chosen)
        shift(bitmaps[chosen], r, 1)
        out.append(chosen)
    return out


PLACED = "doc_id long, piece int, first_word long, n_words long, bin_id long, bin_words long"


def pack(items: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """items: doc_id, size (words), source, cluster. A row for each piece: PLACED."""
    # equal rows are numbered, so that they are spread, too, and in the same way however the rows lie in files
    counted = durable(items.groupBy("doc_id", "size", "source", "cluster").agg(F.count("*").alias("times")))
    n = counted.agg(F.sum("times")).first()[0] or 0
    groups = max(1, -(-n // group))
    each = each_copy(counted, "times", "copy")
    dealt = each.withColumn("grp", F.pmod(F.xxhash64("doc_id", "size", "source", "cluster", "copy"), F.lit(groups))).drop("copy")

    def run(table: pa.Table) -> pa.Table:
        ids, size = table.column("doc_id").to_pylist(), table.column("size").to_numpy()
        source, cluster = table.column("source").to_pylist(), table.column("cluster").to_pylist()
        base = table.column("grp")[0].as_py() << 32
        rest = [int((x - 1) % capacity + 1) if x else 0 for x in size]
        order = sorted(range(len(ids)), key=lambda i: (-rest[i], ids[i] is None, ids[i] or 0, source[i] or "", cluster[i] or 0, int(size[i])))
        keys = [tuple(x for x in (("s", source[i]), ("c", cluster[i])) if x[1] is not None) for i in order]
        bins = best_fit([rest[i] for i in order], keys, capacity)
        rows, used, fresh = [], Counter(), max(bins, default=-1) + 1
        for i, b in zip(order, bins, strict=True):
            full = (int(size[i]) - rest[i]) // capacity
            used[b] += rest[i]
            rows.append((ids[i], full, full * capacity, rest[i], b))
            for piece in range(full):
                rows.append((ids[i], piece, piece * capacity, capacity, fresh))
                used[fresh] = capacity
                fresh += 1
        columns = list(zip(*rows, strict=True))
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64()]
        made = [pa.array(c, kind) for c, kind in zip(columns, kinds, strict=False)]
        at = np.array(columns[4], np.int64)
        made += [pa.array(at + base), pa.array([used[b] for b in columns[4]], pa.int64())]
        return pa.table(made, names=[x.split()[0] for x in PLACED.split(", ")])

    return dealt.groupBy("grp").applyInArrow(run, PLACED)


def items(docs: DataFrame) -> DataFrame:
    """doc_id, size, source and cluster of each row."""
    text = normal_text(F.col("text").cast("string"))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.regexp_count(text, F.lit("[^ ]+")).cast("long").alias("size"), F.col("source").cast("string").alias("source"),
        F.when(F.trim(text) != "", F.xxhash64(text)).alias("cluster"),
    )


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(items(read(spark, sf_dir, "documents")))
