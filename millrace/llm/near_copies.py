"""Near copies: all pairs of documents whose sets of word shingles have a Jaccard similarity of NEAR or more, exactly.

A shingle is the XXH64 (seed 42) of `size` lower-case words, as in simhash; a node is a distinct set of them. Links are
found in two steps, and each is checked by the whole shingle sets before it counts:

1. SimHash: fingerprints of the shingles within 4 bits of one another, by simhash's covering masks; and, as fingerprints
   tell little from 0.8 to 0.9, the nodes that share a minimal hash with more than LARGE others, each against some of
   these (the pivots). This links most copies with few pairs, also in groups of very many.
2. What 4 bits miss: all sets are sorted in one order, shingles that a sample of documents has often last, the others by
   hash. Two sets of similarity NEAR share one of the first n - ceil(NEAR * n) + 1 shingles of each (the prefix), so
   nodes that meet in a prefix shingle are all the candidates there can be. Nodes that step 1 linked (over others, too)
   aren't paired again. Sizes and places rule out pairs that cannot reach NEAR, as does a sketch that each row of a
   bucket carries: counts, modulo 16, of the shingles by CELLS cells of their hash (sets differ in at least as many
   shingles as these counts do, taken the shorter way round). So no pair is lost, and most that are none aren't joined.
   Prefix shingles that no two roots of fitting sizes share are dropped first. The rows of the others also carry a
   longer sketch (SHORT bytes at most), so that unlike copies in a large group make no pair at all, and their node's
   BEFORE earlier shared shingles: a pair that has one of these in common met there already, and is left to it.

Pairs of either step then meet with longer sketches (parities of the counts of four to eight times as many cells as
shingles, a sixteenth to an eighth of a set's bytes; each odd difference is at least one shingle), which rule out nearly all below NEAR.
To check the rest, whole sets go to the pairs' components, once each; those of a component over BLOCK_BYTES (or with
more than BLOCK_PAIRS pairs) are dealt in blocks, and each pair of blocks with candidates gets their sets. Groups are what links reach.

Cases: null counts as empty; documents without words are copies of one another; texts under `size` words are one
shingle; repeated rows share a node; null ids count as LAST_ID and stay only if a group has no other; an empty table
gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import simhash
from millrace.llm.common import by_text, durable, forget, reducers, shared, small_batches
from millrace.llm.components import components
from millrace.llm.simhash import majority, named, shingles, stay

SIZE = 5
#: The least similarity of a link, as a fraction.
NEAR = (4, 5)
#: Documents whose shingles are counted for the order, and the most shingles that come last (both bounds of a broadcast).
SAMPLE, COMMON = 5000, 50_000
KEYS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xFF51AFD7ED558CCD)
LARGE, PIVOTS = 64, 4
#: Rows of a bucket above which the commonest group's rows aren't compared with one another.
BUCKET = 1024
#: Bits of a long sketch: at least, at most (longer sets' sketches tell less, what they don't rule out is checked).
BITS = (64, 1 << 15)
#: Cells of a sketch, half a byte each: two longs.
CELLS = 32
#: Bytes of a long sketch that a row of a bucket carries at most, and of how many earlier buckets it tells.
SHORT, BEFORE = 256, 4
#: Bytes of sets that a component's check has in one block, and pairs in a pair of blocks; bytes of rows or sets in a task.
BLOCK_BYTES, BLOCK_PAIRS, TASK_BYTES = 8 << 20, 20_000, 48 << 20


def similar(n: int, m: int, both: int) -> bool:
    """Whether sets of n and m members, of which they share `both`, have a similarity of NEAR or more."""
    p, q = NEAR
    return (p + q) * both >= p * (n + m)


def signed(x: np.ndarray) -> np.ndarray:
    return x.astype("<u8").view(np.int64)


def shingle_set(text: str | None, size: int) -> np.ndarray:
    return np.unique(shingles(text, size))


def sketch(members: np.ndarray) -> np.ndarray:
    """How many members (modulo 16) are in each of CELLS cells, as two longs."""
    many = (np.bincount((members % np.uint64(CELLS)).astype(np.int64), minlength=CELLS) & 15).astype(np.uint8)
    return (many[0::2] | many[1::2] << 4).view("<i8")


def apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For rows of two sketches each: the least number of members that one of the two sets has and the other has not."""
    out = np.empty(len(x), np.int64)
    for i in range(0, len(x), 65536):
        a, b = (np.ascontiguousarray(z[i : i + 65536]).view(np.uint8) for z in (x, y))
        low, high = ((a & 15) - (b & 15)) & 15, ((a >> 4) - (b >> 4)) & 15
        out[i : i + 65536] = np.minimum(low, 16 - low).sum(axis=1, dtype=np.int64) + np.minimum(high, 16 - high).sum(axis=1, dtype=np.int64)
    return out


def parities(members: np.ndarray) -> bytes:
    """Whether the number of members in each cell is odd, a bit each."""
    least, most = BITS
    cells = min(most, max(least, 1 << (4 * len(members)).bit_length()))
    odd = np.bincount((members & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def odd_apart(x: bytes, y: bytes) -> int:
    """The least number of members that one of the two sets has and the other has not; the longer one is folded."""
    a, b = (np.frombuffer(z, "<u8") for z in (x, y))
    if len(a) != len(b):
        a, b = (np.bitwise_xor.reduce(z.reshape(-1, min(len(a), len(b))), axis=0) for z in (a, b))
    return int(np.bitwise_count(a ^ b).sum())


def ruled(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """pairs: distinct a, b. Those that sizes and long sketches allow a similarity of NEAR."""

    def run(batches):
        p, q = NEAR
        for batch in batches:
            n, m, x, y = (batch.column(c).to_pylist() for c in ("n", "m", "x", "y"))
            ok = [q * min(i, j) >= p * max(i, j) and (p + q) * odd_apart(s, t) <= (q - p) * (i + j) for i, j, s, t in zip(n, m, x, y, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    small_batches(nodes.sparkSession)
    for node, n, bits in (("a", "n", "x"), ("b", "m", "y")):
        pairs = pairs.join(nodes.select(F.col("node").alias(node), F.col("n").alias(n), F.col("bits").alias(bits)), node)
    return durable(pairs.select("a", "b", "n", "m", "x", "y").mapInArrow(run, "a long, b long"))


def with_text(docs: DataFrame) -> DataFrame:
    return docs.select(*named(), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def common_shingles(docs: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that at least three of some SAMPLE documents have, ascending, and how many have them."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = [shingle_set(t, size) for t in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([pa.array(signed(np.concatenate([*made, np.empty(0, np.uint64)])))], names=["h"])

    one_in = max(1, docs.count() // SAMPLE)
    some = with_text(docs).filter(F.pmod(F.xxhash64("doc_id", "tag"), F.lit(one_in)) == 0).select("text")
    found = by_text(some, run, "h long").groupBy("h").agg(F.count("*").alias("n")).filter("n > 2").orderBy(F.desc("n"), "h").limit(COMMON).collect()
    h = np.array([r["h"] for r in found], np.int64).view(np.uint64)
    order = np.argsort(h)
    return h[order], np.array([r["n"] for r in found], np.int64)[order]


def prefixes(docs: DataFrame, size: int) -> DataFrame:
    """A row for each row of docs: doc_id, tag, node, n (shingles), fp (fingerprint),
    keys (minimal hashes), prefix, s0, s1 (the sketch), bits (the long one)."""
    common = shared(docs.sparkSession, common_shingles(docs, size))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        import xxhash

        listed, often = common()
        p, q = NEAR
        nodes, sizes, prints, keys, heads, cells, bits = [], [], [], [], [], [], []
        for text in batch.column("text").to_pylist():
            every = shingles(text, size)
            s = np.unique(every)
            n = len(s)
            prints.append(majority(every))
            rank = np.zeros(n, np.int64)
            if len(listed) and n:
                at = np.minimum(np.searchsorted(listed, s), len(listed) - 1)
                rank = np.where(listed[at] == s, often[at], 0)
            nodes.append(xxhash.xxh64_intdigest(s.tobytes()))
            sizes.append(n)
            keys.append(signed(np.array([((s ^ (s >> np.uint64(29))) * np.uint64(k)).min() for k in KEYS] if n else [], np.uint64)))
            cells.append(sketch(s))
            bits.append(parities(s))
            heads.append(signed(s[np.lexsort((s, rank))[: n - -(-p * n // q) + 1]]))
        columns = [batch.column("doc_id"), batch.column("tag"), pa.array(signed(np.array(nodes, np.uint64))), pa.array(sizes, pa.int32()), pa.array(signed(np.array(prints, np.uint64))), pa.array(keys, pa.list_(pa.int64())), pa.array(heads, pa.list_(pa.int64())), *(pa.array([c[k] for c in cells], pa.int64()) for k in (0, 1)), pa.array(bits, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "tag", "node", "n", "fp", "keys", "prefix", "s0", "s1", "bits"])

    return by_text(with_text(docs), run, "doc_id long, tag long, node long, n int, fp long, keys array<long>, prefix array<long>, s0 long, s1 long, bits binary")


def sets(docs: DataFrame, rows: DataFrame, chosen: DataFrame, size: int) -> DataFrame:
    """chosen: node. A row for each of these: node, members (its shingles, ascending, as bytes)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = [shingle_set(t, size).astype("<u8").tobytes() for t in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("node"), pa.array(made, pa.binary())], names=["node", "members"])

    one = rows.join(chosen.distinct(), "node", "left_semi").groupBy("node").agg(F.min(F.struct("doc_id", "tag")).alias("x")).select("node", "x.doc_id", "x.tag")
    return by_text(with_text(docs).join(one, ["doc_id", "tag"]).select("node", "text"), run, "node long, members binary").dropDuplicates(["node"])


def _checked(batches):
    """Rows of whole cells: sets (cell, node, members) and pairs (cell, a, b). The pairs of similarity NEAR or more."""
    sets_, pairs = {}, []
    for batch in batches:
        cell, node, a, b, members = (batch.column(c).to_pylist() for c in ("cell", "node", "a", "b", "members"))
        for i, m in enumerate(members):
            if m is None:
                pairs.append((cell[i], a[i], b[i]))
            else:
                sets_[cell[i], node[i]] = np.frombuffer(m, "<u8")
    near = []
    for cell, a, b in pairs:
        x, y = sets_[cell, a], sets_[cell, b]
        if similar(len(x), len(y), len(np.intersect1d(x, y, assume_unique=True))):
            near.append((a, b))
    if near:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*near, strict=True)], names=["a", "b"])


def verified(docs: DataFrame, rows: DataFrame, pairs: DataFrame, size: int) -> DataFrame:
    """pairs: distinct a, b. Those of similarity NEAR or more, by whole sets."""
    having = durable(sets(docs, rows, pairs.select(F.col("a").alias("node")).union(pairs.select("b")), size))
    roots = durable(components(pairs))
    rooted = durable(pairs.join(roots.select(F.col("node").alias("a"), "root"), "a").select("a", "b", "root"))
    sized = roots.join(having.select("node", F.octet_length("members").alias("bytes")), "node").select("root", "bytes", F.lit(0).alias("one"))
    weights = sized.union(rooted.select("root", F.lit(0), F.lit(1))).groupBy("root").agg(F.sum("bytes").alias("bytes"), F.sum("one").alias("many"))
    large = durable(weights.filter((F.col("bytes") > BLOCK_BYTES) | (F.col("many") > BLOCK_PAIRS)))
    blocks = F.coalesce(F.ceil(F.greatest(F.col("bytes") / BLOCK_BYTES, F.sqrt(2 * F.col("many") / BLOCK_PAIRS))), F.lit(1))
    i, j = (F.pmod(F.xxhash64(x), blocks) for x in ("a", "b"))  # a node's block: both ends have one root, so one number of blocks
    at = durable(rooted.join(large, "root", "left").select("a", "b", F.xxhash64("root", F.least(i, j), F.greatest(i, j)).alias("cell")))
    needed = at.select("cell", F.col("a").alias("node")).union(at.select("cell", "b")).distinct()
    shipped = needed.join(having, "node").select("cell", "node", F.lit(None).cast("long").alias("a"), F.lit(None).cast("long").alias("b"), "members")
    listed = at.select("cell", F.lit(None).cast("long").alias("node"), "a", "b", F.lit(None).cast("binary").alias("members"))
    total = having.agg(F.sum(F.octet_length("members"))).first()[0] or 0
    parts = reducers(docs.sparkSession, total, TASK_BYTES)
    made = durable(shipped.union(listed).repartition(parts, "cell").mapInArrow(_checked, "a long, b long"))
    forget(having, roots, rooted, large, at)
    return made


def first_pairs(nodes: DataFrame) -> DataFrame:
    """Step 1: pairs of nodes that fingerprints or minimal hashes suggest."""
    # nodes with one fingerprint hang on the first of them; linked fingerprints' first nodes on one another
    first = durable(nodes.groupBy("fp").agg(F.min("node").alias("head")))
    found = durable(simhash.links(first.select("fp")).distinct())
    linked = found.join(first.select(F.col("fp").alias("a"), F.col("head").alias("x")), "a").join(first.select(F.col("fp").alias("b"), F.col("head").alias("y")), "b").select("x", "y")
    same = nodes.select("node", "fp").join(first, "fp").select("node", "head")
    keyed = nodes.select("node", F.posexplode("keys").alias("k", "key"))
    large = durable(keyed.groupBy("k", "key").agg(F.count("*").alias("many")).filter(F.col("many") > LARGE))
    members = durable(keyed.join(large, ["k", "key"]))
    chosen = F.pmod(F.xxhash64("node"), F.ceil(F.col("many") / PIVOTS)) == 0
    pivots = members.filter(chosen).select("k", "key", F.col("node").alias("b"))
    near = members.select("k", "key", F.col("node").alias("a")).join(pivots, ["k", "key"]).select("a", "b")
    pairs = linked.union(same).union(near).toDF("a", "b").filter("a != b")
    out = durable(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    forget(first, found, large, members)
    return out


def _could(n, i, m, j):
    """Whether sets of n and m members that first meet in their places i and j can be similar."""
    p, q = NEAR
    return (q * np.minimum(n, m) >= p * np.maximum(n, m)) & ((p + q) * (1 + np.minimum(n - i - 1, m - j - 1)) >= p * (n + m))


def folded(bits: bytes, most: int = SHORT) -> bytes:
    """A long sketch as one of at most so many bytes."""
    if len(bits) <= most:
        return bits
    return np.bitwise_xor.reduce(np.frombuffer(bits, "<u8").reshape(-1, most // 8), axis=0).tobytes()


class Parities:
    """Long sketches by row (of at most SHORT bytes), to compare many pairs of rows at once."""

    def __init__(self, bits: list[bytes]):
        self.long = np.array([len(b) for b in bits], np.int64)
        self.row, self.made = np.empty(len(bits), np.int64), {}
        for size in np.unique(self.long):
            at = np.flatnonzero(self.long == size)
            self.row[at] = np.arange(len(at))
            self.made[int(size)] = np.frombuffer(b"".join([bits[k] for k in at]), "<u8").reshape(len(at), -1)

    def apart(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """odd_apart() of rows x and y."""
        out = np.empty(len(x), np.int64)
        i, j = self.long[x], self.long[y]
        for a, b in np.unique(np.column_stack([i, j]), axis=0).tolist():
            at = np.flatnonzero((i == a) & (j == b))
            for k in range(0, len(at), 8192):
                some = at[k : k + 8192]
                u, v = self.made[a][self.row[x[some]]], self.made[b][self.row[y[some]]]
                if a != b:
                    u, v = (np.bitwise_xor.reduce(z.reshape(len(z), -1, min(a, b) // 8), axis=1) for z in (u, v))
                out[some] = np.bitwise_count(u ^ v).sum(axis=1, dtype=np.int64)
        return out


def candidates(h, node, n, i, root, s0, s1, before=None, bits=None):
    """Pairs of rows of whole buckets (equal h), of different roots, that sizes, places and sketches allow: arrays a, b of
    nodes. before: for each row some earlier buckets of its node (0 for none), whose pairs are left to these."""
    order = np.lexsort((n, h))
    h, node, n, i, root = (x[order] for x in (h, node, n, i, root))
    cells = np.column_stack([s0[order], s1[order]]).astype("<i8")
    before = None if before is None else before[order]
    long = None if bits is None else Parities([bits[k] for k in order])
    p, q = NEAR
    n, i = n.astype(np.int64), i.astype(np.int64)
    begin = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    count = np.diff(np.append(begin, len(h)))
    mixed = np.minimum.reduceat(root, begin) != np.maximum.reduceat(root, begin)
    found = []

    def take(x, y):
        ok = (root[x] != root[y]) & _could(n[x], i[x], n[y], i[y])
        x, y = x[ok], y[ok]
        for j in range(0 if before is None else before.shape[1]):
            ok = (before[x, j] == 0) | (before[y] != before[x, j][:, None]).all(axis=1)
            x, y = x[ok], y[ok]
        ok = (p + q) * apart(cells[x], cells[y]) <= (q - p) * (n[x] + n[y])
        x, y = x[ok], y[ok]
        if long is not None:
            ok = (p + q) * long.apart(x, y) <= (q - p) * (n[x] + n[y])
            x, y = x[ok], y[ok]
        found.append((node[x], node[y]))

    for s, c in zip(begin[mixed & (count > BUCKET)], count[mixed & (count > BUCKET)], strict=True):
        names, times = np.unique(root[s : s + c], return_counts=True)
        every = np.arange(s, s + c)
        for x in every[root[s : s + c] != names[np.argmax(times)]]:
            take(np.full(c, x), every)
    small = mixed & (count <= BUCKET)
    end = np.repeat(np.where(small, begin + count, 0), count)
    active, d = np.arange(len(h)), 1
    while True:
        active = active[active + d < end[active]]
        active = active[q * n[active] >= p * n[active + d]]  # sizes ascend: farther ones don't fit, either
        if not len(active):
            break
        take(active, active + d)
        d += 1
    a, b = (np.concatenate([x[k] for x in found]) if found else np.empty(0, np.int64) for k in (0, 1))
    pairs = np.unique(np.column_stack([np.minimum(a, b), np.maximum(a, b)]), axis=0)
    return pairs[:, 0], pairs[:, 1]


def _columns(batches, *names: str) -> list[np.ndarray] | None:
    """Columns of all batches together; None if there are no rows."""
    held = [b for b in batches if b.num_rows]
    return [np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in held]) for c in names] if held else None


def _shared(batches):
    """Rows (h, node, n, i, root) of whole buckets, in any order: node, i and h of those that meet another root in a run
    of rows whose sizes, in order, each allow the next."""
    if (got := _columns(batches, "h", "node", "n", "i", "root")) is None:
        return
    order = np.lexsort((got[2], got[0]))
    h, node, n, i, root = (x[order] for x in got)
    p, q = NEAR
    size = n.astype(np.int64)
    begin = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (q * size[:-1] < p * size[1:])]))
    mixed = np.minimum.reduceat(root, begin) != np.maximum.reduceat(root, begin)
    kept = np.repeat(mixed, np.diff(np.append(begin, len(h))))
    yield pa.RecordBatch.from_arrays([pa.array(x[kept]) for x in (node, i, h)], names=["node", "i", "h"])


def _dealt(batches):
    """Rows (node, n, root, s0, s1, bits, held), held being its i and h in order, to one row for each of these, with the
    BEFORE ones that come before it."""
    for batch in batches:
        held = batch.column("held")
        offsets, flat = held.offsets.to_numpy().astype(np.int64), held.flatten()
        i, h = (flat.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        times = np.diff(offsets)
        row, at = np.repeat(np.arange(len(times)), times), np.arange(len(h))
        place = at - np.repeat(offsets[:-1] - offsets[0], times)
        before = np.stack([np.where(place >= k, h[np.maximum(at - k, 0)], 0) for k in range(1, BEFORE + 1)], axis=1)
        bits = pa.array([folded(b) for b in batch.column("bits").to_pylist()], pa.binary())
        for k in range(0, len(h), 16384):
            some = slice(k, k + 16384)
            mine = pa.array(row[some])
            columns = [pa.array(h[some]), pa.array(i[some]), *(batch.column(c).take(mine) for c in ("node", "n", "root", "s0", "s1")), pa.ListArray.from_arrays(np.arange(0, (len(mine) + 1) * BEFORE, BEFORE, dtype=np.int32), before[some].ravel()), bits.take(mine)]
            yield pa.RecordBatch.from_arrays(columns, names=["h", "i", "node", "n", "root", "s0", "s1", "before", "bits"])


def _paired(batches):
    """Rows (h, node, n, i, root, s0, s1, before, bits) of whole buckets, in any order, to candidate pairs a, b."""
    held = [b for b in batches if b.num_rows]
    if held:
        before = np.concatenate([b.column("before").flatten().to_numpy(zero_copy_only=False).reshape(-1, BEFORE) for b in held])
        bits = [x for b in held for x in b.column("bits").to_pylist()]
        a, b = candidates(*_columns(held, "h", "node", "n", "i", "root", "s0", "s1"), before, bits)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def meetings(rooted: DataFrame) -> DataFrame:
    """rooted: nodes with their root. The nodes whose prefixes meet others', with `held`: the shingles (i, h) where they do."""
    spark = rooted.sparkSession
    total = rooted.agg(F.sum(F.size("prefix"))).first()[0] or 0
    entries = rooted.select("node", "n", "root", F.posexplode("prefix").alias("i", "h")).select("h", "node", "n", "i", "root")
    met = entries.repartition(reducers(spark, 32 * total, TASK_BYTES), "h").mapInArrow(_shared, "node long, i int, h long")
    return durable(met.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("i", "h"))).alias("held")))


def further_pairs(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """Step 2: all pairs of nodes of different roots (node, root; others are their own) that may have similarity NEAR."""
    spark = nodes.sparkSession
    rooted = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    held = meetings(rooted)
    rows = durable(rooted.join(held, "node").select("node", "n", "root", "s0", "s1", "bits", "held"))
    size = F.size("held") * (F.lit(96) + F.least(F.octet_length("bits"), F.lit(SHORT)))
    parts = reducers(spark, rows.agg(F.sum(size)).first()[0] or 0, TASK_BYTES)
    small_batches(spark)
    dealt = rows.mapInArrow(_dealt, "h long, i int, node long, n int, root long, s0 long, s1 long, before array<long>, bits binary")
    met = durable(dealt.repartition(parts, "h").mapInArrow(_paired, "a long, b long").distinct())
    forget(held, rows)
    return met


def links(docs: DataFrame, rows: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """rows: doc_id, tag, node; nodes: what prefixes() says of each. Links a, b of nodes that connect all pairs of
    similarity NEAR or more, and no others."""
    met = first_pairs(nodes)
    pairs = ruled(met, nodes)
    forget(met)
    known = verified(docs, rows, pairs, size)
    roots = durable(components(known))
    met = further_pairs(nodes, roots)
    left = ruled(met, nodes)
    forget(met, roots, pairs)
    return verified(docs, rows, left, size).unionByName(known)


def classes(docs: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """(rows, groups). rows: doc_id, tag, fp (the node) of each row of docs; groups, for each node: fp, root,
    component_id (the smallest doc_id of its group)."""
    every = durable(prefixes(docs, size))
    light = durable(every.select("doc_id", "tag", "node"))
    nodes = durable(every.groupBy("node").agg(F.first(F.struct("n", "fp", "keys", "prefix", "s0", "s1", "bits")).alias("x")).select("node", "x.n", "x.fp", "x.keys", "x.prefix", "x.s0", "x.s1", "x.bits"))
    forget(every)
    linked = durable(links(docs, light, nodes, size))
    forget(nodes)
    roots = durable(components(linked))
    least = light.groupBy("node").agg(F.min("doc_id").alias("least"))
    placed = durable(least.join(roots, "node", "left").select(F.col("node").alias("fp"), "least", F.coalesce("root", "node").alias("root")))
    # written out, so that the join has its own exchange, which Spark splits where a group is large
    first = durable(placed.groupBy("root").agg(F.min("least").alias("component_id")))
    forget(linked, roots)
    return light.select("doc_id", "tag", F.col("node").alias("fp")), placed.join(first, "root").select("fp", "root", "component_id")


def keep_first(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """The rows of docs that stay, one for each group of near copies, with all their columns."""
    return stay(docs, *classes(docs, size))
