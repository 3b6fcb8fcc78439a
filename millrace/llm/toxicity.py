"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

Examples: at most EXAMPLES labelled documents with at most SAMPLE_BYTES of text (the bounds on the sample that the
classifier is fitted on). Terms: all lower-case words of the examples and the
first BEGINNING letters of longer ones; none is left out. A term weighs
(1 + log tf) * idf * relevance, where relevance is the square root of the share of the label's entropy that the term
tells in the examples; without it, what texts are about hides a few insults. Vectors have length 1 over all their terms;
a word that no example has tells nothing and weighs 0.

Examples lie in blocks of BLOCK; the inverted index has, for each term and block with it, its postings and their largest
weight. A document's bound for a block is the sum of its weights times these maxima. Blocks are opened from the largest
bound down, until the bound falls under the similarity of the K-th neighbour so far: no skipped example could enter,
so the K neighbours are exact (ties go to the earlier example).

Votes: each neighbour counts as much as it is similar, the label's base rate as much as PRIOR; leave-one-out votes of
CALIBRATION examples, weighed back to the base rate, calibrate the vote by logistic regression. Evidence: the ids of
the three nearest.

Cases: null and empty texts, and texts without a word of the examples, have no neighbour and get the base rate among
the examples without one; ties, repeated rows and null ids: rows are scored one by one; no labels: the score is
0.1 everywhere; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import by_text, read, shared
from millrace.llm.labelled import base_rate, remainder, sample

EXAMPLES = 2000
SAMPLE_BYTES = 32 << 20
CALIBRATION = 1000
#: Letters of the beginning of a word that is a term besides the word.
BEGINNING = 5
BLOCK = 64
#: Blocks opened at first; each further step opens four times as many.
OPENED = 4
K = 15
#: Words whose terms a worker keeps.
KNOWN_WORDS = 500_000
PRIOR = 0.05
MODULUS, HELD_OUT = 4, 2
THRESHOLD = 0.3
_WORD = re.compile(r"[^\W\d_]+")


def words(text: str | None) -> Counter:
    """How often each lower-case word occurs."""
    return Counter(_WORD.findall((text or "").lower()))


def terms_of(word: str) -> tuple[str, ...]:
    return (word, word[:BEGINNING] + "-") if len(word) > BEGINNING else (word,)


def terms(counts: Counter) -> Counter:
    """How often each term occurs, from counts of words."""
    out: Counter = Counter()
    for w, n in counts.items():
        for t in terms_of(w):
            out[t] += n
    return out


def spread(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The places start[i], start[i] + 1, ... (count[i] of them), one range after the other."""
    ends = np.cumsum(count)
    return np.repeat(start - ends + count, count) + np.arange(ends[-1] if len(ends) else 0)


@dataclass
class Index:
    """Block-max inverted index. Term t has the cells cells[t] to cells[t + 1]; cell c says for block[c] the largest
    weight most[c], and has the postings postings[c] to postings[c + 1] (example, weight)."""

    vocabulary: dict[str, int]
    factor: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    cells: np.ndarray
    block: np.ndarray
    most: np.ndarray
    postings: np.ndarray
    example: np.ndarray
    weight: np.ndarray
    base: float
    logit: list[float] = field(default_factory=lambda: [0.0, 0.0, 0.0])
    alone: float = 0.1
    #: The numbers of a word's terms, for the words met so far.
    numbers: dict[str, tuple[int, ...]] = field(default_factory=dict)

    def vector(self, counts: Counter) -> tuple[np.ndarray, np.ndarray]:
        """Term numbers, ascending, and weights (of length 1) from counts of words."""
        if len(self.numbers) > KNOWN_WORDS:
            self.numbers.clear()
        known, t, tf = self.numbers, [], []
        for w, n in counts.items():
            found = known.get(w)
            if found is None:
                found = known[w] = tuple(self.vocabulary[x] for x in terms_of(w) if x in self.vocabulary)
            for x in found:
                t.append(x)
                tf.append(n)
        t, at = np.unique(np.array(t, np.int64), return_inverse=True)
        w = (1 + np.log(np.bincount(at, weights=tf, minlength=len(t)))) * self.factor[t]
        return t, w / max(np.sqrt((w * w).sum()), 1e-12)

    def nearest(self, t: np.ndarray, q: np.ndarray, k: int = K, but: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The k most similar examples with a similarity over 0, and these; `but` is left out."""
        n = len(self.labels)
        first_cell, end = self.cells[t], self.cells[t + 1]
        count = end - first_cell
        cell, weight = spread(first_cell, count), np.repeat(q, count)
        block = self.block[cell]
        bound = np.bincount(block, weights=weight * self.most[cell], minlength=-(-n // BLOCK))
        order = np.argsort(-bound, kind="stable")
        s, floor, first, step = np.zeros(n), 0.0, 0, OPENED
        found, near = np.empty(0, np.int64), np.empty(0)
        while first < len(order):
            chosen = order[first : first + step]
            chosen = chosen[(bound[chosen] > 0) & (bound[chosen] >= floor - 1e-9)]
            if not len(chosen):
                break
            if 2 * len(chosen) > len(order):  # nearly all: all postings of a term at once, then the chosen blocks only
                begin, of = self.postings[first_cell], q
                size = self.postings[end] - begin
            else:
                open_ = np.zeros(len(order), bool)
                open_[chosen] = True
                own = open_[block]
                c, of = cell[own], weight[own]
                begin = self.postings[c]
                size = self.postings[c + 1] - begin
            at = spread(begin, size)
            s = np.bincount(self.example[at], weights=np.repeat(of, size) * self.weight[at], minlength=n)
            if first:
                s[found] = 0
            if but >= 0:
                s[but] = 0
            new = np.flatnonzero((s > 0) & (s >= floor - 1e-9))
            found, near = np.append(found, new), np.append(near, s[new])
            best = np.lexsort((found, -np.round(near, 9)))[:k]
            found, near = found[best], near[best]
            if len(near) == k:
                floor = near[-1]
            first, step = first + step, step * 4
        return found, near

    def vote(self, e: np.ndarray, s: np.ndarray) -> float:
        return float((s @ self.labels[e] + PRIOR * self.base) / (s.sum() + PRIOR))

    def score(self, t: np.ndarray, q: np.ndarray) -> tuple[float, np.ndarray]:
        e, s = self.nearest(t, q) if len(t) else (np.empty(0, np.int64), None)
        if not len(e):
            return self.alone, e
        a, b, c = self.logit
        return float(1 / (1 + np.exp(-np.clip(a + b * self.vote(e, s) + c * s[0], -30, 30)))), e


def fit_logit(x: np.ndarray, y: np.ndarray, w: np.ndarray, rounds: int = 50) -> list[float]:
    """Weighted logistic regression with a small ridge, by Newton's method."""
    x = np.column_stack([np.ones(len(x)), x])
    beta = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        g = x.T @ (w * (y - p)) - 0.1 * beta
        step = np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(x.shape[1]), g)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return [float(v) for v in beta]


def first_of(doc: np.ndarray, t: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """For each of n documents the term with the largest value (the lowest of equals); -1 without terms."""
    by = np.lexsort((t, -value, doc))
    head = by[np.concatenate([[True], doc[by][1:] != doc[by][:-1]])] if len(by) else by
    out = np.full(n, -1)
    out[doc[head]] = t[head]
    return out


def relevance(df: np.ndarray, ones: np.ndarray, n: int, n_ones: float) -> np.ndarray:
    """For terms in df of n examples, `ones` of them with label 1: from nearly 0 to 1, the square root of the share of
    the label's entropy that presence of the term tells. 1 for all where there is one label only."""

    def x_log_x(x):
        return np.where(x > 0, x * np.log(np.maximum(x, 1e-300)), 0)

    entropy = x_log_x(np.array(float(n))) - x_log_x(np.array(n_ones)) - x_log_x(np.array(n - n_ones))
    if entropy <= 0:
        return np.ones(len(df))
    inside = x_log_x(df) - x_log_x(ones) - x_log_x(df - ones)
    outside = x_log_x(n - df) - x_log_x(n_ones - ones) - x_log_x(n - n_ones - df + ones)
    return np.sqrt((np.maximum(entropy - inside - outside, 0) + 0.01) / (entropy + 0.01))


def build(rows: list[tuple[int, int, Counter]], base: float) -> Index:
    """rows: doc_id, label, counts of words."""
    rows = sorted(rows, key=lambda r: r[0])
    plain, rows = [r[2] for r in rows], [(*r[:2], terms(r[2])) for r in rows]
    n, number = len(rows), {}
    for _, _, counts in rows:
        for w in counts:
            number.setdefault(w, len(number))
    y = np.array([r[1] for r in rows], float)
    length = [len(r[2]) for r in rows]
    t = np.fromiter((number[w] for r in rows for w in r[2]), np.int64, sum(length))
    tf = np.fromiter((c for r in rows for c in r[2].values()), float, sum(length))
    doc = np.repeat(np.arange(n), length)
    df = np.bincount(t, minlength=len(number)).astype(float)
    ones = np.bincount(t, weights=y[doc], minlength=len(number))
    factor = (np.log((1 + n) / (1 + df)) + 1e-3) * relevance(df, ones, n, y.sum())
    w = (1 + np.log(tf)) * factor[t]
    w /= np.maximum(np.sqrt(np.bincount(doc, weights=w * w, minlength=n)), 1e-12)[doc]
    # examples with the same commonest word (which tells the language) and the same strongest term come to lie in the
    # same blocks, so that bounds are tight
    order = np.lexsort((np.arange(n), first_of(doc, t, w, n), first_of(doc, t, tf, n)))
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    e = place[doc]
    by = np.lexsort((e, t))
    t, w, e = t[by], w[by], e[by]
    begin = np.flatnonzero(np.concatenate([[True], (t[1:] != t[:-1]) | (e[1:] // BLOCK != e[:-1] // BLOCK)])) if len(t) else np.empty(0, np.int64)
    most = np.maximum.reduceat(w, begin) if len(begin) else np.empty(0)
    index = Index(
        number, factor, np.array([r[0] for r in rows], np.int64)[order], y[order], np.searchsorted(t[begin], np.arange(len(number) + 1)),
        e[begin] // BLOCK, most, np.append(begin, len(t)), e, w, base,
    )
    if n:
        calibrate(index, [plain[i] for i in order])
        index.numbers.clear()
    return index


def calibrate(index: Index, counts: list[Counter]) -> None:
    """The logistic curve over votes, from leave-one-out votes of at most CALIBRATION evenly spaced examples."""
    n, share = len(index.labels), index.labels.mean()
    weight = np.where(index.labels == 1, index.base / max(share, 1e-9), (1 - index.base) / max(1 - share, 1e-9))
    votes, alone = [], []
    for i in np.unique(np.linspace(0, n - 1, min(n, CALIBRATION)).astype(int)).tolist():
        t, q = index.vector(counts[i])
        near, s = index.nearest(t, q, but=i) if len(t) else (np.empty(0, np.int64), None)
        votes.append((i, index.vote(near, s), s[0])) if len(near) else alone.append(i)
    if votes:
        i = [v[0] for v in votes]
        index.logit = fit_logit(np.array([v[1:] for v in votes]), index.labels[i], weight[i])
    index.alone = float((weight[alone] @ index.labels[alone] + index.base) / (weight[alone].sum() + 1)) if alone else index.base


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> Index:
    """The index of a bounded sample."""
    rows = sample(docs, labels, label, MODULUS, HELD_OUT, EXAMPLES, SAMPLE_BYTES)
    return build([(i, y, words(text)) for i, y, text in rows], base_rate(labels, label, MODULUS, HELD_OUT))


def score(docs: DataFrame, index: Index, threshold: float = THRESHOLD) -> DataFrame:
    """A row for each document: doc_id, held_out, score, predicted, evidence (ids of the nearest examples)."""
    model = shared(docs.sparkSession, index)  # its size is bound by EXAMPLES and SAMPLE_BYTES

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = model()
        scores, evidence = [], []
        for text in batch.column("text").to_pylist():
            p, e = x.score(*x.vector(words(text)))
            scores.append(p)
            evidence.append(x.ids[e[:3]].tolist())
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64()), pa.array(evidence, pa.list_(pa.int64()))], names=["doc_id", "score", "evidence"])

    scored = by_text(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, "doc_id long, score double, evidence array<long>")
    held = F.coalesce(remainder(MODULUS) == HELD_OUT, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "evidence")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return score(docs, fit(docs, read(spark, sf_dir, "labels")))
