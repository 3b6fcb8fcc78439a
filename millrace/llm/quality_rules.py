"""Quality rules as weak supervision.

Rules look at counts of a document and vote good (1), bad (-1) or abstain (0). The votes of all documents are
counted by vote vector (at most 3 ** len(RULES) vectors, whatever the corpus), expectation-maximisation on these
counts estimates each rule's accuracies on good and on bad documents, and a document's verdict is the posterior
probability that it is good. Nothing has to pass every rule.

Cases: null text counts as empty; a document without words fails the base rule and gets no vote but that for its
length; rows are judged one by one, so repeated ids and null ids are kept apart; an empty table gives no rows and
the prior; columns other than doc_id and text aren't read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import by_text, durable, pieces, read, small_batches

WINDOW = 8
SYMBOLS = "[#*$%&|<>]"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_bangs", "n_marked", "n_stutter"]
SCHEMA = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS)


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return part / np.maximum(whole, 1)


def _vote(bad: np.ndarray, good: np.ndarray) -> np.ndarray:
    return np.where(bad, -1, np.where(good, 1, 0)).astype(np.int8)


def _rate(part: str, whole: str, low: float, high: float):
    """Bad above `high`, good up to `low`, between them an abstention; so is a text without words."""

    def rule(c: dict[str, np.ndarray]) -> np.ndarray:
        share = _share(c[part], c[whole])
        return _vote(share > high, (share <= low) & (c["n_words"] > 0))

    return rule


def _word_length(c: dict[str, np.ndarray]) -> np.ndarray:
    mean = _share(c["word_chars"], c["n_words"])
    return _vote((c["n_words"] > 0) & ((mean < 2) | (mean > 14)), (mean >= 3) & (mean <= 9))


#: Name -> votes from the counts. A rule abstains where its count says little.
RULES = {
    "symbols": _rate("n_symbols", "n_words", 0.05, 0.3),
    "marked": _rate("n_marked", "n_words", 0.05, 0.25),
    "repeats": _rate("n_repeat_words", "n_words", 0.1, 0.3),
    "lines": _rate("n_dup_lines", "n_lines", 0.2, 0.5),
    "word_length": _word_length,
    "length": lambda c: _vote(c["n_words"] < 20, c["n_words"] >= 50),
    "capitals": _rate("n_upper", "n_words", 0.1, 0.4),
    "bangs": _rate("n_bangs", "n_words", 0.1, 0.4),
    "stutter": _rate("n_stutter", "n_words", 0.05, 0.2),
}


def repeat_words(words: np.ndarray, owner: np.ndarray, n_docs: int, window: int = WINDOW) -> np.ndarray:
    """For each document, its words inside windows of 8 words that occur twice or more in it.

    words: integer codes of all words, document after document; owner: each word's document. A hash of each window
    finds the windows that may repeat; only those are compared, word by word.
    """
    n = len(words) - window + 1
    if n < 1:
        return np.zeros(n_docs, np.int64)
    code, key = words.astype(np.uint64), owner[:n].astype(np.uint64)
    with np.errstate(over="ignore"):
        for i in range(window):
            key = (key ^ code[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
    key[owner[:n] != owner[window - 1 :]] = np.arange(np.count_nonzero(owner[:n] != owner[window - 1 :]), dtype=np.uint64)
    ordered = np.sort(key)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    start = np.flatnonzero(np.isin(key, np.unique(twice))) if len(twice) else np.empty(0, np.int64)
    start = start[owner[start] == owner[start + window - 1]]
    if not len(start):
        return np.zeros(n_docs, np.int64)
    rows = np.column_stack([owner[start], *(words[start + i] for i in range(window))]).astype(np.int64)
    order = np.lexsort(rows.T)
    same = (rows[order][1:] == rows[order][:-1]).all(axis=1)
    again = start[order[np.append(same, False) | np.append(False, same)]]
    edge = np.bincount(again, minlength=len(words) + 1) - np.bincount(again + window, minlength=len(words) + 1)
    return np.bincount(owner[np.cumsum(edge[:-1]) > 0], minlength=n_docs)


def counts(texts: pa.Array) -> dict[str, np.ndarray]:
    """COUNTS of whole texts. Letters, symbols and marks are counted once for each distinct word."""
    texts, n = pc.fill_null(texts.cast(pa.large_string()), ""), len(texts)
    split = pc.ascii_split_whitespace(texts)
    owner, found = pc.list_parent_indices(split).to_numpy(zero_copy_only=False), split.flatten()
    real = pc.greater(pc.binary_length(found), 0)
    owner, coded = owner[real.to_numpy(zero_copy_only=False)], found.filter(real).dictionary_encode()
    word, known = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary

    def total(of_word: pa.Array) -> np.ndarray:
        each = of_word.to_numpy(zero_copy_only=False).astype(np.float64)
        return np.bincount(owner, weights=each[word], minlength=n).astype(np.int64)

    out = {"n_words": np.bincount(owner, minlength=n), "word_chars": total(pc.utf8_length(known)), "n_symbols": total(pc.count_substring_regex(known, SYMBOLS))}
    lines = pc.split_pattern(texts, "\n")
    holder, line = pc.list_parent_indices(lines).to_numpy(zero_copy_only=False), lines.flatten()
    real = pc.greater(pc.binary_length(pc.ascii_trim_whitespace(line)), 0)
    holder, line = holder[real.to_numpy(zero_copy_only=False)], line.filter(real).dictionary_encode()
    first = np.unique(holder * (len(line.dictionary) + 1) + line.indices.to_numpy(zero_copy_only=False)) // (len(line.dictionary) + 1)
    out["n_dup_lines"] = np.bincount(holder, minlength=n) - np.bincount(first, minlength=n)
    out["n_repeat_words"] = repeat_words(word, owner, n)
    out["n_lines"] = np.bincount(holder, minlength=n)
    out["n_upper"] = total(pc.and_(pc.utf8_is_upper(known), pc.greater(pc.utf8_length(known), 1)))
    out["n_bangs"] = total(pc.count_substring(known, "!"))
    out["n_marked"] = total(pc.match_substring_regex(known, SYMBOLS))
    same = np.flatnonzero((word[1:] == word[:-1]) & (owner[1:] == owner[:-1]))
    out["n_stutter"] = np.bincount(owner[same], minlength=n)
    return {c: out[c].astype(np.int64) for c in COUNTS}


def base_failed(c: dict[str, np.ndarray]) -> np.ndarray:
    return (c["n_words"] < 20) | (100 * c["n_repeat_words"] > 30 * c["n_words"])


def votes(c: dict[str, np.ndarray]) -> np.ndarray:
    """A row for each document, a column for each rule: 1, -1 or 0."""
    return np.stack([f(c) for f in RULES.values()], axis=1)


def vote_key(v: np.ndarray) -> np.ndarray:
    """A vote vector as one number in base 3."""
    return (v.astype(np.int64) + 1) @ (3 ** np.arange(v.shape[1], dtype=np.int64))


@dataclass
class LabelModel:
    """P(good), and for each rule P(votes good | good) and P(votes bad | bad), abstentions aside."""

    prior: float
    on_good: np.ndarray
    on_bad: np.ndarray

    def posterior(self, v: np.ndarray) -> np.ndarray:
        """P(good | votes); without a vote the prior."""
        good, bad = v == 1, v == -1
        a, b = self.on_good, self.on_bad
        ratio = np.log(self.prior / (1 - self.prior)) + good @ np.log(a / (1 - b)) + bad @ np.log((1 - a) / b)
        return 1 / (1 + np.exp(-np.clip(ratio, -500, 500)))


def fit(patterns: np.ndarray, weight: np.ndarray, rounds: int = 100, tolerance: float = 1e-9) -> LabelModel:
    """Expectation-maximisation over distinct vote vectors and how many documents cast them.

    It begins at 'good unless a rule says bad'. Beta pseudo-counts (95:5 on good, 50:50 on bad documents) and
    the bound on_good + on_bad >= 1.02 keep each rule better than chance, so the two classes can't change names.
    """
    good, bad, w = patterns == 1, patterns == -1, weight.astype(float)
    q = np.where(bad.any(axis=1), 0.1, 0.95)
    model = LabelModel(0.9, np.full(patterns.shape[1], 0.95), np.full(patterns.shape[1], 0.5))
    for _ in range(rounds):
        before = np.concatenate([[model.prior], model.on_good, model.on_bad])
        on_good = (95 + (w * q) @ good) / (100 + (w * q) @ (good | bad))
        on_bad = (50 + (w * (1 - q)) @ bad) / (100 + (w * (1 - q)) @ (good | bad))
        on_good, on_bad = np.clip(on_good, 0.5, 0.999), np.clip(on_bad, 0.001, 0.999)
        model = LabelModel(float(np.clip((9 + w @ q) / (10 + w.sum()), 0.05, 0.99)), on_good, np.maximum(on_bad, 1.02 - on_good))
        q = model.posterior(patterns)
        if np.abs(np.concatenate([[model.prior], model.on_good, model.on_bad]) - before).max() < tolerance:
            break
    return model


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, COUNTS and vote_key of each row."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = counts(batch.column("text"))
        return pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *map(pa.array, c.values()), pa.array(vote_key(votes(c)))], [*("doc_id", *COUNTS), "vote_key"])

    return by_text(docs.select("doc_id", F.col("text").cast("string").alias("text")), run, SCHEMA + ", vote_key long")


def fit_votes(measured: DataFrame) -> LabelModel:
    """The label model of all documents' votes: one aggregation, then at most 3 ** len(RULES) rows here."""
    seen = measured.groupBy("vote_key").count().orderBy("vote_key").collect()
    keys = np.array([r["vote_key"] for r in seen], np.int64)
    patterns = (keys[:, None] // 3 ** np.arange(len(RULES), dtype=np.int64)) % 3 - 1
    return fit(patterns, np.array([r["count"] for r in seen], np.int64))


def judge(measured: DataFrame, model: LabelModel, least: float = 0.5) -> DataFrame:
    """Adds base_failed, p_good and kept."""
    from pyspark.sql.functions import col, lit, when

    ratio = lit(float(np.log(model.prior / (1 - model.prior))))
    for j in range(len(RULES)):
        vote = F.pmod((col("vote_key") / lit(3**j)).cast("long"), lit(3))
        a, b = float(model.on_good[j]), float(model.on_bad[j])
        ratio = ratio + when(vote == 2, lit(float(np.log(a / (1 - b))))).when(vote == 0, lit(float(np.log((1 - a) / b)))).otherwise(lit(0.0))
    out = measured.withColumn("base_failed", (col("n_words") < 20) | (100 * col("n_repeat_words") > 30 * col("n_words")))
    out = out.withColumn("p_good", 1 / (1 + F.exp(-ratio)))
    return out.withColumn("kept", ~col("base_failed") & (col("p_good") >= least))


def score(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """A row for each document: doc_id, counts, base_failed, p_good, kept."""
    measured = durable(measure(docs))
    return judge(measured, fit_votes(measured), least).drop("vote_key")


def keep(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of docs that the rules keep, with all their columns.

    The votes are counted in a first pass; the second applies the model (some dozen numbers) row by row, so
    no text is shuffled.
    """
    small_batches(docs.sparkSession)
    model = fit_votes(measure(docs))

    def run(batches):
        for piece in pieces(batches):
            c = counts(piece.column("text"))
            yield piece.filter(pa.array(~base_failed(c) & (model.posterior(votes(c)) >= least)))

    return docs.mapInArrow(run, docs.schema)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(read(spark, sf_dir, "documents"))
