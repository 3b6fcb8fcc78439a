"""Bounded, hashed samples of labelled documents, for models that are fitted on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import durable


def remainder(modulus: int, column: str = "doc_id") -> F.Column:
    """crc32 of the id as text, modulo `modulus`."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held_out: int, size: int, most_bytes: int) -> list[tuple[int, int, str]]:
    """(doc_id, label, text) of labelled documents whose remainder isn't held_out, by doc_id: at most `size` of them,
    and of each label at most half of `most_bytes` of text, so what comes to the driver is bounded twice.

    The ids are chosen from the labels alone, half of them for each label as far as there are as many, by the order
    of a hash; so at most `size` rows are broadcast to the scan of the documents. In the same order whole texts are
    taken while they fit the bytes. Null labels and ids don't count; of several labels for an id the largest does; of
    several rows with an id the one with the smallest text does.
    """
    usable = labels.filter(f"doc_id IS NOT NULL AND {label} IS NOT NULL").filter(remainder(modulus) != held_out)
    each = usable.groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("label"))
    half = [each.filter(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(size // 2) for k in (0, 1)]
    chosen = F.broadcast(half[0].unionByName(half[1]))
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(chosen, "doc_id")
    found = durable(texts.groupBy("doc_id", "label").agg(F.min("text").alias("text")))
    fits, held = [], {}
    for r in found.select("doc_id", "label", F.octet_length("text").alias("n")).orderBy(F.xxhash64("doc_id"), "doc_id").collect():
        if held.get(r["label"], 0) + r["n"] <= most_bytes // 2:
            held[r["label"]] = held.get(r["label"], 0) + r["n"]
            fits.append(r["doc_id"])
    rows = found.filter(F.col("doc_id").isin(fits)).collect() if fits else []
    return sorted((r["doc_id"], r["label"], r["text"]) for r in rows)


def base_rate(labels: DataFrame, label: str, modulus: int, held_out: int) -> float:
    """Share of label 1 among all labels that may be learnt from, drawn towards a tenth where there are few."""
    usable = labels.filter(f"doc_id IS NOT NULL AND {label} IS NOT NULL").filter(remainder(modulus) != held_out)
    n, ones = usable.agg(F.count("*"), F.sum((F.col(label).cast("int") == 1).cast("int"))).first()
    return ((ones or 0) + 1) / (n + 10)
