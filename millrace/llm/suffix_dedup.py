"""Suffix-array dedup: every byte covered by a LENGTH = 100 byte string that also starts earlier goes.

Sorting every suffix would move the corpus a hundred times over, so the sort is sparse first:

1. Anchors. Of the 57 positions where a 44-byte gram can start inside a 100-byte window, the one with the smallest
   hash is the window's anchor. That depends on the window's bytes alone, so equal windows have equal anchors at equal
   offsets, and no repeat is lost. Windows with one anchor are neighbours: a run. About 1 byte in 27 is an anchor.
2. Runs are suffixes that start at an anchor. They are dealt in ranges of their leading token (the gram's 64-bit
   hash, so even splitters suit), and each bucket sorts by multikey quicksort: token, then a hash of all the run's
   bytes, then place. Equal runs are neighbours; all but the first go as a whole.
3. What is left to compare are runs that share the gram and not all bytes (the edges of repeated passages). Their
   windows are dealt by sampled splitters over (gram, offset in the window, 64-bit hash of the 100 bytes), sorted in
   the same manner, and all but the first of each equal group go. Splitters are whole keys, so a gram with a third of
   all rows is cut between windows, and windows that compare equal never lie on two sides of a boundary.
4. A document's removed windows are united, and the bytes outside them kept.

Each task sorts what it holds before the shuffle and sends only the first of equal runs or windows on; the others are
known to go. Two strings count as equal if gram hash, offset and window hash (64 bits each, mixed) agree.

Order is (doc_id, hash of the text, position). Cases: null counts as empty; null ids count as larger than all others;
of rows equal in both doc_id and text the first keeps what it has alone, the others go as copies; texts under 100
bytes stay whole; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import durable, pieces, read, reducers, small_batches

LENGTH = 100
GRAM = 44
#: Bytes hashed at once, and windows or runs sorted at once before they are sent on.
SEGMENT = 1 << 20
FLUSH = 1 << 19
#: Bytes of text for each reducer of step 2.
REDUCER_BYTES = 48 << 20
#: Documents sampled for the splitters of step 3.
SAMPLE_DOCS = 400
LAST_ID = 2**63 - 1

_POS = np.uint64((1 << 21) - 1)
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(0, 2**64, 256, dtype=np.uint64)
_ODD = _RNG.integers(0, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def gram_hashes(b: np.ndarray, sizes: tuple[int, ...]) -> list[np.ndarray]:
    """For each size, the 64-bit hash of the bytes b[i : i + size] at each i. Hashes of 2m bytes come from two of m."""
    level, m = {1: _BYTE[b]}, 1
    while 2 * m <= max(sizes):
        x = level[m]
        y = x[: max(0, len(x) - m)] * _ODD[m.bit_length()] + x[m:]
        level[2 * m] = y ^ (y >> np.uint64(31))
        m *= 2
    out = []
    for size in sizes:
        n, acc, at = max(0, len(b) - size + 1), None, 0
        for bit in reversed(range(size.bit_length())):
            if size >> bit & 1:
                part = level[1 << bit][at : at + n]
                acc = part.copy() if acc is None else acc * _ODD[10] + part
                at += 1 << bit
        acc ^= acc >> np.uint64(29)
        acc *= _ODD[11]
        out.append(acc ^ (acc >> np.uint64(32)))
    return out


def anchors(g: np.ndarray, windows: int) -> np.ndarray:
    """For each of the first `windows` positions, where its anchor starts: the leftmost smallest gram hash (43 bits)."""
    wide = LENGTH - GRAM + 1
    value = (g & ~_POS) | np.arange(len(g), dtype=np.uint64)
    least, m = value, 1
    while 2 * m <= wide:
        least = np.minimum(least[:-m], least[m:])
        m *= 2
    return (np.minimum(least[:windows], least[wide - m : wide - m + windows]) & _POS).astype(np.int64)


def multikey_order(keys: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Multikey quicksort: sorts by the first key, then only what ties by the next, and so on.

    Returns the order and, for each key, where in it a group of equal (key 0..i) begins.
    """
    order = np.argsort(keys[0], kind="stable")
    first = np.ones(len(order), bool)
    sorted_key = keys[0][order]
    first[1:] = sorted_key[1:] != sorted_key[:-1]
    begins = [first]
    for key in keys[1:]:
        begin = begins[-1].copy()
        tied = ~begin
        tied[:-1] |= tied[1:]
        at = np.flatnonzero(tied)
        if len(at):
            group, part = np.cumsum(begins[-1])[at], order[at]
            part = part[np.lexsort((key[part], group))]
            order[at] = part
            values = key[part]
            differ = np.ones(len(at), bool)
            differ[1:] = (values[1:] != values[:-1]) | (group[1:] != group[:-1])
            begin[at] = differ
        begins.append(begin)
    return order, begins


def pack(columns: list[np.ndarray]) -> bytes:
    """Equally long arrays as byte planes, compressed."""
    raw = b"".join(np.ascontiguousarray(c).view(np.uint8).reshape(len(c), c.itemsize).T.tobytes() for c in columns)
    return len(columns[0]).to_bytes(4, "little") + len(raw).to_bytes(8, "little") + pa.Codec("zstd", compression_level=1).compress(raw, asbytes=True)


def unpack(blob: bytes, kinds: list[str]) -> list[np.ndarray]:
    n, size = int.from_bytes(blob[:4], "little"), int.from_bytes(blob[4:12], "little")
    raw, at, out = np.frombuffer(pa.Codec("zstd").decompress(blob[12:], decompressed_size=size, asbytes=True), np.uint8), 0, []
    for kind in kinds:
        width = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(raw[at : at + n * width].reshape(width, n).T).reshape(-1).view(kind))
        at += n * width
    return out


#: Rows between the steps: a blob for a bucket, or a removed or wanted range of window starts of a document.
DEALT = "bucket int, blob binary, doc_id long, tag long, start int, stop int, wanted boolean"
FOUND = "doc_id long, tag long, start int, stop int, wanted boolean"
RUN = ["<u8", "<u8", "<i8", "<i8", "<i4", "u1"]  # gram, run hash, doc_id, tag, first window, windows
WINDOW = ["<u8", "u1", "<u8", "<i8", "<i8", "<i4"]  # gram, offset, window hash, doc_id, tag, window


def _rows(schema: str, n: int, **columns) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "binary": pa.binary(), "long": pa.int64(), "boolean": pa.bool_()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(columns[c], kinds[k]) if c in columns else pa.nulls(n, kinds[k]) for c, k in fields], names=[c for c, _ in fields])


def _place(doc: np.ndarray, tag: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """Ranks of (doc_id, tag, position); the same place has the same rank."""
    order = np.lexsort((pos, tag, doc))
    d, t, p = doc[order], tag[order], pos[order]
    step = np.ones(len(order), np.int64)
    step[1:] = (d[1:] != d[:-1]) | (t[1:] != t[:-1]) | (p[1:] != p[:-1])
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(step)
    return rank


def _later(columns: list[np.ndarray], keys: int) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Order by the first `keys` columns, then place (the columns doc_id, tag, position after them).

    Returns it with the group begins, and which of the ordered rows stand at a later place than their group's first.
    """
    doc, tag, pos = columns[keys : keys + 3]
    place = _place(doc, tag, pos)
    order, begins = multikey_order([*columns[:keys], place])
    placed = place[order]
    head = placed[np.maximum.accumulate(np.where(begins[keys - 1], np.arange(len(order)), 0))] if len(order) else placed
    return order, begins, placed != head


def _removed(schema: str, doc: np.ndarray, tag: np.ndarray, start: np.ndarray, stop: np.ndarray, wanted: bool, **more) -> Iterator[pa.RecordBatch]:
    """Ranges of window starts, touching ones joined, as record batches."""
    order = np.lexsort((start, tag, doc))
    doc, tag, start, stop = doc[order], tag[order], start[order], stop[order]
    begin = np.ones(len(doc), bool)
    begin[1:] = (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1]) | (start[1:] > stop[:-1])
    at = np.flatnonzero(begin)
    for i in range(0, len(at), 50_000):
        own = at[i : i + 50_000]
        ends = (np.append(at[1:], len(doc)) - 1)[i : i + 50_000]
        extra = {k: v(doc[own], tag[own]) for k, v in more.items()}
        yield _rows(schema, len(own), doc_id=doc[own], tag=tag[own], start=start[own], stop=stop[ends], wanted=np.full(len(own), wanted), **extra)


def _bucket_of_doc(buckets: int):
    return lambda doc, tag: ((doc ^ tag) % buckets).astype(np.int32)


def _texts(piece: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bytes, and where each text begins and ends."""
    parts = [(t or "").encode("utf-8", "surrogatepass") for t in piece.column("text").to_pylist()]
    ends = np.cumsum([len(p) for p in parts], dtype=np.int64)
    return np.frombuffer(b"".join(parts), np.uint8), np.concatenate([[0], ends[:-1]]) if len(ends) else ends, ends


def runs(piece: pa.RecordBatch) -> Iterator[list[np.ndarray]]:
    """Step 1: the runs (columns of RUN) of some whole texts."""
    b, begins, ends = _texts(piece)
    doc, tag = (piece.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "tag"))
    for s in range(0, len(b) - LENGTH + 1, SEGMENT):
        part = b[s : s + SEGMENT + LENGTH - 1]
        g, h = gram_hashes(part, (GRAM, LENGTH))
        anchor = anchors(g, len(h))
        owner = np.searchsorted(ends, np.arange(s, s + len(h)), side="right")
        valid = np.arange(s, s + len(h)) + LENGTH <= ends[owner]
        fresh = np.ones(len(h), bool)
        fresh[1:] = (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1]) | ~valid[:-1]
        first = np.flatnonzero(fresh & valid)
        stops = np.flatnonzero(np.append(fresh[1:] | ~valid[1:], True) & valid)
        whole = (h[first] * _ODD[12] + h[stops]) * _ODD[13] + (stops - first).astype(np.uint64)
        own = owner[first]
        # anchors have small hashes; times an odd number they spread over the whole range of splitters
        yield [g[anchor[first]] * _ODD[14], whole, doc[own], tag[own], (first + s - begins[own]).astype(np.int32), (stops - first + 1).astype(np.uint8)]


def _span(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return first, first + count.astype(np.int32)


def deal_runs(docs: DataFrame, buckets: int) -> DataFrame:
    """Steps 1 and 2 before the shuffle."""
    half = np.uint64(32)

    def flush(held: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        columns = [np.concatenate(c) for c in zip(*held, strict=True)]
        order, begins, later = _later(columns, 2)
        doc, tag, first, count = (c[order[later]] for c in columns[2:])
        if len(doc):
            yield from _removed(DEALT, doc, tag, *_span(first, count), False, bucket=_bucket_of_doc(buckets))
        kept = [c[order[begins[1]]] for c in columns]
        to = ((kept[0] >> half) * np.uint64(buckets) >> half).astype(np.int32)
        edge = np.searchsorted(to, np.arange(buckets + 1))
        full = np.flatnonzero(np.diff(edge))
        for i in range(0, len(full), 64):
            own = full[i : i + 64]
            yield _rows(DEALT, len(own), bucket=own.astype(np.int32), blob=[pack([c[edge[k] : edge[k + 1]] for c in kept]) for k in own])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for piece in pieces(batches):
            for part in runs(piece):
                held.append(part)
                n += len(part[0])
            if n >= FLUSH:
                yield from flush(held)
                held, n = [], 0
        if n:
            yield from flush(held)

    return docs.mapInArrow(run, DEALT)


def _gathered(batches: Iterator[pa.RecordBatch], kinds: list[str]) -> Iterator[pa.RecordBatch | list[np.ndarray]]:
    """Passes ranges on; at the end, the columns of all blobs."""
    blobs = []
    for batch in batches:
        is_blob = batch.column("blob").is_valid()
        blobs += batch.column("blob").drop_null().to_pylist()
        ranges = batch.filter(pc.invert(is_blob))
        if ranges.num_rows:
            yield ranges.select([x.split()[0] for x in FOUND.split(", ")])
    if blobs:
        unpacked = [unpack(x, kinds) for x in blobs]
        del blobs
        yield [np.concatenate(c) for c in zip(*unpacked, strict=True)]


def sort_runs(dealt: DataFrame) -> DataFrame:
    """Step 2 in each bucket: ranges of windows that go (not wanted) or have to be compared (wanted)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _gathered(batches, RUN):
            if isinstance(x, pa.RecordBatch):
                yield x
                continue
            by_gram = np.sort(x[0])
            twice = np.unique(by_gram[1:][by_gram[1:] == by_gram[:-1]])
            at = np.searchsorted(twice, x[0])
            again = (twice[np.minimum(at, len(twice) - 1)] == x[0]) if len(twice) else np.zeros(len(x[0]), bool)
            columns = [c[again] for c in x]
            order, begins, later = _later(columns, 2)
            group = np.cumsum(begins[0]) - 1
            several = np.bincount(group, weights=begins[1])[group] > 1 if len(group) else np.zeros(0, bool)
            for rows, wanted in ((order[later], False), (order[~later & several], True)):
                doc, tag, first, count = (c[rows] for c in columns[2:])
                if len(doc):
                    yield from _removed(FOUND, doc, tag, *_span(first, count), wanted)

    return dealt.mapInArrow(run, FOUND)


def windows(piece: pa.RecordBatch) -> Iterator[list[np.ndarray]]:
    """Step 3: the wanted windows (columns of WINDOW) of some whole texts. Column ranges: start, stop pairs."""
    doc, tag = (piece.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "tag"))
    for i, (text, ranges) in enumerate(zip(piece.column("text").to_pylist(), piece.column("ranges").to_pylist(), strict=True)):
        b = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
        spans = sorted((r["start"], r["stop"]) for r in ranges)
        joined: list[list[int]] = []
        for s, e in spans:  # near ranges are hashed together
            if joined and s - joined[-1][1] < 2 * LENGTH and e - joined[-1][0] < SEGMENT:
                joined[-1][1] = max(joined[-1][1], e)
                joined[-1][2].append((s, e))
            else:
                joined.append([s, e, [(s, e)]])
        for s, e, own in joined:
            part = b[s : e + LENGTH - 1]
            g, h = gram_hashes(part, (GRAM, LENGTH))
            at = np.concatenate([np.arange(x, y) for x, y in own]) - s
            anchor = anchors(g, len(h))[at]
            n = len(at)
            yield [g[anchor], (anchor - at).astype(np.uint8), h[at], np.full(n, doc[i]), np.full(n, tag[i]), (at + s).astype(np.int32)]


def deal_windows(docs: DataFrame, splitters: list[tuple[int, int, int]]) -> DataFrame:
    """Step 3 before the shuffle. docs: doc_id, tag, text, ranges. splitters: sorted keys (gram, offset, window hash)."""
    cuts = [np.array([s[i] for s in splitters], kind) for i, kind in enumerate(WINDOW[:3])]
    buckets = len(splitters) + 1

    def flush(held: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        columns = [np.concatenate(c) for c in zip(*held, strict=True)]
        order, begins, later = _later(columns, 3)
        doc, tag, at = (c[order[later]] for c in columns[3:])
        if len(doc):
            yield from _removed(DEALT, doc, tag, at, at + 1, False, bucket=_bucket_of_doc(buckets))
        kept = [c[order[begins[2]]] for c in columns]
        edge = [0]
        for cut in zip(*cuts, strict=True):
            low, high = 0, len(kept[0])
            for key, value in zip(kept[:3], cut, strict=True):
                low, high = low + np.searchsorted(key[low:high], value, "left"), low + np.searchsorted(key[low:high], value, "right")
            edge.append(low)
        edge = np.array([*edge, len(kept[0])])
        full = np.flatnonzero(np.diff(edge))
        for i in range(0, len(full), 64):
            own = full[i : i + 64]
            yield _rows(DEALT, len(own), bucket=own.astype(np.int32), blob=[pack([c[edge[k] : edge[k + 1]] for c in kept]) for k in own])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for piece in pieces(batches):
            for part in windows(piece):
                held.append(part)
                n += len(part[0])
                if n >= FLUSH:
                    yield from flush(held)
                    held, n = [], 0
        if n:
            yield from flush(held)

    return docs.mapInArrow(run, DEALT)


def sort_windows(dealt: DataFrame) -> DataFrame:
    """Step 3 in each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _gathered(batches, WINDOW):
            if isinstance(x, pa.RecordBatch):
                yield x
                continue
            order, _, later = _later(x, 3)
            doc, tag, at = (c[order[later]] for c in x[3:])
            if len(doc):
                yield from _removed(FOUND, doc, tag, at, at + 1, False)

    return dealt.mapInArrow(run, FOUND)


def sample_splitters(docs: DataFrame, buckets: int) -> list[tuple[int, int, int]]:
    """Keys that cut a sample's wanted windows into equal parts. docs: at most SAMPLE_DOCS rows."""
    kinds = "gram long, place int, hash long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            for g, o, h, *_ in windows(piece):
                few = np.arange(0, len(g), 1 + len(g) // 200)
                yield pa.RecordBatch.from_arrays([pa.array(g[few].view(np.int64)), pa.array(o[few].astype(np.int32)), pa.array(h[few].view(np.int64))], names=["gram", "place", "hash"])

    keys = sorted((r["gram"] % 2**64, r["place"], r["hash"] % 2**64) for r in docs.mapInArrow(run, kinds).collect())
    return sorted({keys[i * len(keys) // buckets] for i in range(1, buckets)}) if keys else []


def keyed(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id (null as LAST_ID), tag (a hash of the text) and text (null as empty), in front of other columns."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("doc_id"), F.xxhash64(text).alias("tag"), text.alias("text"), *more)


def repeats(docs: DataFrame) -> DataFrame:
    """The windows that also start earlier: doc_id, tag, ranges (array of start, stop) for each document with any."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = keyed(docs)
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = reducers(spark, total, REDUCER_BYTES)
    dealt = deal_runs(rows, buckets).repartitionById(buckets, "bucket")
    found = durable(sort_runs(dealt))
    of_doc = lambda df: df.groupBy("doc_id", "tag").agg(F.collect_list(F.struct("start", "stop")).alias("ranges"))
    wanted = found.filter("wanted").select("doc_id", "tag", "start", "stop")
    some = wanted.select("doc_id", "tag").distinct().orderBy(F.xxhash64("doc_id", "tag")).limit(SAMPLE_DOCS)
    some = some.join(wanted, ["doc_id", "tag"])
    # at most SAMPLE_DOCS rows are broadcast, whatever the corpus
    splitters = sample_splitters(rows.join(F.broadcast(of_doc(some)), ["doc_id", "tag"]), buckets)
    compared = deal_windows(rows.join(of_doc(wanted), ["doc_id", "tag"]), splitters).repartitionById(buckets, "bucket")
    gone = found.filter("NOT wanted").unionByName(durable(sort_windows(compared)))
    return of_doc(gone)


def united(ranges: list[dict]) -> list[tuple[int, int]]:
    """Removed spans of bytes, joined where they touch, from ranges of window starts."""
    out: list[tuple[int, int]] = []
    for start, stop in sorted((r["start"], r["stop"] + LENGTH - 1) for r in ranges or ()):
        if out and start <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], stop)
        else:
            out.append((start, stop))
    return out


def cut(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    edges = [0, *(x for s in spans for x in s), len(data)]
    return b"".join(data[i:j] for i, j in zip(edges[::2], edges[1::2], strict=True))


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, tag long"


def summaries(docs: DataFrame) -> DataFrame:
    """A row for each document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    joined = keyed(docs).join(repeats(docs), ["doc_id", "tag"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            out = []
            for text, ranges in zip(piece.column("text").to_pylist(), piece.column("ranges").to_pylist(), strict=True):
                data, spans = text.encode("utf-8", "surrogatepass"), united(ranges)
                out.append((len(data), sum(j - i for i, j in spans), len(spans), hashlib.sha256(cut(data, spans)).hexdigest()))
            made = [pa.array(c) for c in zip(*out, strict=True)]
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), *made, piece.column("tag")], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "tag"])

    rows = joined.mapInArrow(run, RESULT)
    # rows equal in doc_id and text: all but one go as copies
    same = rows.groupBy("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "tag").agg(F.count("*").alias("n"))
    each = same.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("copy"))
    gone = (F.col("copy") > 1) & (F.col("n_bytes") >= LENGTH)
    return each.select(
        F.when(F.col("doc_id") < LAST_ID, F.col("doc_id")).alias("doc_id"), "n_bytes", F.when(gone, F.col("n_bytes")).otherwise(F.col("n_removed")).alias("n_removed"),
        F.when(gone, F.lit(1).cast("long")).otherwise(F.col("n_spans")).alias("n_spans"), F.when(gone, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
    )


def whole_characters(data: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans, shrunk to whole UTF-8 characters."""
    out = []
    for i, j in spans:
        while i < j and data[i] & 0xC0 == 0x80:
            i += 1
        while i < j < len(data) and data[j] & 0xC0 == 0x80:
            j -= 1
        if i < j:
            out.append((i, j))
    return out


def remove(docs: DataFrame) -> DataFrame:
    """The rows of docs without what repeats: text loses whole characters only, n_chars (if there) follows it.

    Rows whose whole text repeats stay, with an empty text. Of rows equal in id and text each is treated alike.
    """
    names, kinds = docs.columns, docs.schema
    others = [F.struct(*[F.col(c) for c in names]).alias("row")]
    joined = keyed(docs, *others).join(repeats(docs), ["doc_id", "tag"], "left").select("row", "ranges")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column("row").flatten()
            texts, sizes = [], []
            at = names.index("text")
            for text, ranges in zip(rows[at].to_pylist(), batch.column("ranges").to_pylist(), strict=True):
                if text and ranges:
                    data = text.encode("utf-8", "surrogatepass")
                    text = cut(data, whole_characters(data, united(ranges))).decode("utf-8", "surrogatepass")
                    sizes.append(len(text))
                else:
                    sizes.append(None)
                texts.append(text)
            rows[at] = pa.array(texts, rows[at].type)
            if "n_chars" in names:
                k = names.index("n_chars")
                rows[k] = pc.coalesce(pa.array(sizes, pa.int64()).cast(rows[k].type), rows[k])
            yield pa.RecordBatch.from_arrays(rows, names=names)

    return joined.mapInArrow(run, kinds)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries(read(spark, sf_dir, "documents"))
