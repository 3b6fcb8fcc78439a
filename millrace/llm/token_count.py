"""Count-only Viterbi for a unigram vocabulary.

The count is that of the tokenizers library's Unigram model with a Metaspace pre-tokenizer (prepended always, split),
no byte fallback. Pieces with their scores come from a public sentencepiece file, named by a parameter. Words are the
pieces of Metaspace, so a text's count is the sum over its words and each distinct word that a worker meets is solved once.

For a word, an Aho-Corasick automaton enumerates all vocabulary matches; dynamic programming over end positions
carries the best score and, with it, the number of pieces on the best path and whether that ends in an unknown
character. Ties go as in the library: matches are taken by start, then by length, and only a strictly better score
replaces a path. A character that no one-character piece covers is unknown, with the lowest score of all minus 10, and
neighbouring unknowns on the best path are one piece.

Cases: null counts as empty, with 0 pieces; rows are counted one by one; an empty table gives no rows; other columns
aren't read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import Recent, by_text, read, worker_wide

UNKNOWN_PENALTY = 10.0
SPACE = "▁"
#: Words whose count a worker keeps.
KNOWN_WORDS = 300_000


def vocabulary_path() -> str:
    """The public vocabulary of this installation (a parameter of the operator)."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def vocabulary(path: str) -> list[tuple[str, float]]:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


class Counter:
    """Pieces of a word. unknown: the vocabulary's id for unknown characters."""

    def __init__(self, vocab: list[tuple[str, float]], unknown: int = 0):
        import ahocorasick

        self.known = Recent(KNOWN_WORDS)
        self.unknown, self.low = unknown, min(s for _, s in vocab) - UNKNOWN_PENALTY
        self.automaton = ahocorasick.Automaton()
        for i, (piece, score) in enumerate(vocab):
            if piece:
                self.automaton.add_word(piece, (len(piece), score, i == unknown))
        self.automaton.make_automaton()

    def count(self, word: str) -> int:
        """Ends are taken in order, and of each the longest match (earliest start) first, as the automaton gives them."""
        n, low, last = len(word), self.low, 0
        best, pieces, unknown = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        for end, (size, score, odd) in [*self.automaton.iter(word), (n, (0, 0.0, False))]:
            end += 1
            if end != last:
                if last and not single:  # noqa: F821
                    s = best[last - 1] + low
                    if not found or s > best[last]:  # noqa: F821
                        best[last], pieces[last], unknown[last] = s, pieces[last - 1] + (not unknown[last - 1]), True
                for last in range(last + 1, end):
                    best[last], pieces[last], unknown[last] = best[last - 1] + low, pieces[last - 1] + (not unknown[last - 1]), True
                if end > n:
                    break
                last, found, single = end, False, False
            start = end - size
            s = best[start] + score
            if not found or s > best[end]:
                best[end], pieces[end], unknown[end], found = s, pieces[start] + (not (odd and unknown[start])), odd, True
            if size == 1:
                single = True
        return pieces[n]


def counter(path: str) -> Counter:
    return worker_wide(f"unigram {path}", lambda: Counter(vocabulary(path)))


def count_tokens(docs: DataFrame, path: str | None = None) -> DataFrame:
    """A row for each document: doc_id, n_chars (code points), n_tokens."""
    path = path or vocabulary_path()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        solve, known = counter(path).count, counter(path).known
        chars, total = [], []
        for text in batch.column("text").to_pylist():
            text = text or ""
            n = 0
            if text:
                # Metaspace puts a space mark in front unless the text begins with one
                marked = text.replace(" ", SPACE)
                for w in (marked if marked[0] == SPACE else SPACE + marked).split(SPACE)[1:]:
                    c = known.get(w)
                    if c is None:
                        c = solve(SPACE + w)
                        known.put(w, c)
                    n += c
            chars.append(len(text))
            total.append(n)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.array(chars, np.int64)), pa.array(np.array(total, np.int64))], names=["doc_id", "n_chars", "n_tokens"])

    return by_text(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, "doc_id long, n_chars long, n_tokens long")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(read(spark, sf_dir, "documents"))
