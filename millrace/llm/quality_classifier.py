"""Quality by nearest-neighbour voting over latent-semantic vectors.

A text's terms are its words as they stand (between white space), and three that no word can be: how many words repeat
the one before them, how many pairs of neighbours occurred before in the text, and how many lines did. TF-IDF over all
terms of at most EXAMPLES labelled documents with at most SAMPLE_BYTES of text (the bounds on the sample that the
classifier is fitted on) goes through a truncated singular value decomposition to DIMENSIONS. The examples' terms and
vectors are broadcast; every document's cosine with all of them comes from blocked matrix products, exactly, and its K
nearest (ties, to six decimals, go to the earlier example) vote with the power of their similarity.

Cases: null and empty texts, and those without a known term, get the base rate; rows are scored one by one, so repeated
rows and null ids have rows of their own; no labels: the score is 0.1 everywhere; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import by_text, read, shared
from millrace.llm.labelled import base_rate, remainder, sample

EXAMPLES = 4000
SAMPLE_BYTES = 32 << 20
DIMENSIONS = 16
K = 15
POWER = 8
PRIOR = 0.05
ROWS = 512
MODULUS, HELD_OUT = 5, 0
THRESHOLD = 0.3
#: Terms that no word can be, as they have spaces.
SAME, AGAIN, LINE = "word as before", "pair again", "line again"


def terms(text: str | None) -> Counter:
    """Counts of a text's terms."""
    text = text or ""
    words = text.split()
    counts = Counter(words)
    pairs = list(zip(words, words[1:], strict=False))
    lines = [x for x in text.split("\n") if x.strip()]
    for name, n in ((SAME, sum(a == b for a, b in pairs)), (AGAIN, len(pairs) - len(set(pairs))), (LINE, len(lines) - len(set(lines)))):
        if n:
            counts[name] = n
    return counts


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-9)


@dataclass
class Sparse:
    """A matrix by rows (examples) with unit-length rows: row i has terms[ptr[i] : ptr[i + 1]] and their weights."""

    ptr: np.ndarray
    terms: np.ndarray
    weights: np.ndarray
    width: int

    @cached_property
    def by_term(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.argsort(self.terms, kind="stable")
        rows = np.repeat(np.arange(len(self.ptr) - 1, dtype=np.int32), np.diff(self.ptr))
        return np.searchsorted(self.terms[order], np.arange(self.width + 1)), rows[order], self.weights[order]

    def times(self, m: np.ndarray) -> np.ndarray:
        return _sums(self.ptr, self.terms, self.weights, m)

    def transposed_times(self, m: np.ndarray) -> np.ndarray:
        return _sums(*self.by_term, m)


def _sums(ptr: np.ndarray, at: np.ndarray, weights: np.ndarray, m: np.ndarray) -> np.ndarray:
    """For each i the sum of weights[j] * m[at[j]] over j from ptr[i] to ptr[i + 1]; a bounded part at a time."""
    out = np.zeros((len(ptr) - 1, m.shape[1]), np.float32)
    first = 0
    while first < len(out):
        last = max(first + 1, int(np.searchsorted(ptr, ptr[first] + (1 << 17), "right")) - 1)
        a, b = ptr[first], ptr[last]
        own = np.flatnonzero(ptr[first + 1 : last + 1] > ptr[first:last]) + first
        if len(own):
            out[own] = np.add.reduceat(weights[a:b, None] * m[at[a:b]], ptr[own] - a, axis=0)
        first = last
    return out


def decompose(x: Sparse, rank: int) -> np.ndarray:
    """A matrix c so that the leading right singular vectors of x are x' c, by a randomised range finder (fixed seed)."""
    n = len(x.ptr) - 1
    rank = min(rank, n, x.width)
    drawn = np.random.default_rng(7).standard_normal((x.width, min(rank + 10, n, x.width)), dtype=np.float32)
    q = np.linalg.qr(x.times(drawn))[0]
    for _ in range(2):
        q = np.linalg.qr(x.times(x.transposed_times(q)))[0]
    b = x.transposed_times(q)  # its columns' left singular vectors are wanted
    values, u = np.linalg.eigh(b.T.astype(np.float64) @ b)
    values, u = values[::-1][:rank], u[:, ::-1][:, :rank]
    kept = values > 1e-9 * max(values[0], 1e-30)
    return (q @ (u[:, kept] / np.sqrt(values[kept]))).astype(np.float32)


@dataclass
class Model:
    vocabulary: dict[str, int]
    idf: np.ndarray
    examples: Sparse
    combined: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    weights: np.ndarray
    base: float

    @cached_property
    def basis(self) -> np.ndarray:
        """A row of DIMENSIONS numbers for each term; made from the examples where it's used, which are much smaller."""
        return self.examples.transposed_times(self.combined)

    def rows(self, counts: list[Counter]) -> np.ndarray:
        """Latent vectors of length 1 (zero where no term is known)."""
        out = np.zeros((len(counts), self.combined.shape[1]), np.float32)
        for i, c in enumerate(counts):
            at = [(self.vocabulary[t], n) for t, n in c.items() if t in self.vocabulary]
            if at:
                j, n = map(np.array, zip(*at, strict=True))
                w = (1 + np.log(n)) * self.idf[j]
                out[i] = (w / np.sqrt((w * w).sum())).astype(np.float32) @ self.basis[j]
        return unit(out)

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(x), self.base)
        cosine = x @ self.vectors.T
        n = cosine.shape[1]
        k = min(K, n)
        # whole numbers that order by similarity, then by place
        order = np.rint(cosine * (1 << 20)).astype(np.int64) * n - np.arange(n)
        near = np.argpartition(-order, k - 1, axis=1)[:, :k]
        s = np.clip(np.take_along_axis(cosine, near, axis=1), 0, 1).astype(np.float64) ** POWER * self.weights[near]
        return ((s * self.labels[near]).sum(axis=1) + PRIOR * self.base) / (s.sum(axis=1) + PRIOR)


def build(rows: list[tuple[int, int, Counter]], base: float) -> Model:
    """rows: doc_id, label, counts of terms. Each label's examples together weigh as its base rate."""
    rows = sorted(rows, key=lambda r: r[0])
    number: dict[str, int] = {}
    for _, _, counts in rows:
        for t in counts:
            number.setdefault(t, len(number))
    n = len(rows)
    ptr = np.concatenate([[0], np.cumsum([len(r[2]) for r in rows], dtype=np.int64)]).astype(np.int64)
    t = np.fromiter((number[x] for r in rows for x in r[2]), np.int32, ptr[-1])
    tf = np.fromiter((c for r in rows for c in r[2].values()), np.float64, ptr[-1])
    doc = np.repeat(np.arange(n), np.diff(ptr))
    idf = np.log((1 + n) / (1 + np.bincount(t, minlength=len(number)))) + 0.1
    w = (1 + np.log(tf)) * idf[t]
    w /= np.sqrt(np.bincount(doc, weights=w * w, minlength=n))[doc]
    x = Sparse(ptr, t, w.astype(np.float32), len(number))
    labels = np.array([r[1] for r in rows], float)
    ones = max(labels.mean(), 1e-9) if n else 1.0
    weights = np.where(labels == 1, base / ones, (1 - base) / max(1 - ones, 1e-9))
    combined = decompose(x, DIMENSIONS) if n and number else np.empty((n, 0), np.float32)
    model = Model(number, idf, x, combined, np.empty((n, combined.shape[1]), np.float32), labels, weights, base)
    if combined.shape[1]:
        model.vectors = unit(x.times(model.basis))
        del model.__dict__["basis"]  # workers make it anew
        x.__dict__.pop("by_term", None)
    return model


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Model:
    """The model of a bounded sample."""
    rows = sample(docs, labels, label, MODULUS, HELD_OUT, EXAMPLES, SAMPLE_BYTES)
    return build([(i, y, terms(text)) for i, y, text in rows], base_rate(labels, label, MODULUS, HELD_OUT))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """A row for each document: doc_id, held_out, score, predicted."""
    sent = shared(docs.sparkSession, model)  # its size is bound by EXAMPLES, SAMPLE_BYTES and DIMENSIONS

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        m, scores = sent(), []
        texts = batch.column("text").to_pylist()
        for i in range(0, len(texts), ROWS):
            scores.append(m.score(m.rows([terms(t) for t in texts[i : i + ROWS]])))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.concatenate(scores))], names=["doc_id", "score"])

    scored = by_text(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, "doc_id long, score double")
    held = F.coalesce(remainder(MODULUS) == HELD_OUT, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return score(docs, fit(docs, read(spark, sf_dir, "labels")))
