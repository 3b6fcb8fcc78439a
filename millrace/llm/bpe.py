"""BPE encoding and decoding with content-defined chunks.

Texts are cut where a rolling hash of the last 16 bytes ends in CUT zero bits (at character boundaries, never inside a
special token), so equal passages of different documents have equal chunks, whatever stands before them. A worker
encodes each distinct chunk once, with the tokenizers library (new neighbours at once; where no token holds white space, word by word, each
word that it doesn't know), and keeps it in a bounded table: the ids of the pre-tokens (words, marks, runs of spaces)
that lie inside.

These hold in any text but for the chunk's edges, where pre-tokens may run on into the neighbour. So each join is repaired: from a boundary EDGE pre-tokens before it to one EDGE pre-tokens behind it the text
is encoded anew, until it agrees with the chunks on both sides: with the left one in the first pre-token, with the right
one from some boundary to the window's end, in places and ids. Where it doesn't, the window widens, in the end over whole
chunks. Pre-tokens are found from left to right without looking back, so from a common boundary on both agree for good.
That holds for the tokenizers that composable() lets pass; texts for any other are encoded as a whole.

The result is that of the library for the whole text: add_special_tokens=False, no truncation or padding. Decoding is
the library's decode(ids, skip_special_tokens=False) of all of a document's ids.

Cases: null counts as empty (no ids, empty text); a text without a boundary is one window; rows are encoded one by one,
so repeated rows and null ids have rows of their own; an empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import Recent, by_text, read, worker_wide

ROLL = 16
#: Zero bits at a cut: chunks have 2 ** CUT bytes on average.
CUT = 9
#: Pre-tokens of each side in a join's first window.
EDGE = 2
#: Neighbouring new chunks that are encoded at once: as a text by the library (places in which are looked up in time
#: that grows with it), or as words.
RUN, RUN_OF_WORDS = 4, 64
#: Bytes of chunks and joins (about, with their results; a full table begins anew) that a worker keeps.
KEPT_BYTES = 96 << 20
#: Words that a worker keeps, for tokenizers that are separable(); characters in which a piece's last words are looked for.
KEPT_WORDS = 250_000
TAIL = 200
WHITE = frozenset([b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r"])
_WORD = re.compile(r"[^ \t\n\x0b\x0c\r]+")
_TABLE = np.random.default_rng(16).integers(0, 2**32, 256, dtype=np.uint32)


def tokenizer_path() -> str:
    """The public tokenizer of this installation (a parameter of the operator)."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def cuts(data: bytes, apart: re.Pattern | None = None) -> list[int]:
    """Where chunks begin, 0 and the end included; not inside what matches `apart`."""
    b = np.frombuffer(data, np.uint8)
    if len(b) <= ROLL:
        return [0, len(b)] if len(b) else [0]
    h, m = _TABLE[b], 1
    while m < ROLL:
        h = h[:-m] * np.uint32(0x9E3779B1 + 2 * m) + h[m:]
        h ^= h >> np.uint32(15)
        m *= 2
    at = np.flatnonzero((h & np.uint32((1 << CUT) - 1)) == 0) + ROLL
    at = at[at < len(b)]
    at = at[b[at] & 0xC0 != 0x80]
    if apart is not None and len(at):
        for found in apart.finditer(data):
            at = at[(at <= found.start()) | (at >= found.end())]
    return [0, *at.tolist(), len(b)]


def composable(config: dict) -> bool:
    """Whether pre-tokens depend on the text behind their beginning alone, and normalisation on a character's neighbours."""

    def parts(x: dict | None, key: str) -> list[dict]:
        return [] if x is None else [z for y in x[key] for z in parts(y, key)] if x["type"] == "Sequence" else [x]

    def normalizer(x: dict) -> bool:
        return x["type"] in ("NFC", "Lowercase") or x["type"] == "Replace" and x["pattern"] == {"Regex": r"\s+"}

    def splitter(x: dict) -> bool:
        if x["type"] == "ByteLevel":
            return not x["add_prefix_space"]
        return x["type"] in ("Whitespace", "WhitespaceSplit") or x["type"] == "Split" and "(?<" not in str(x["pattern"]) and not re.search(r"\\[GKAbB]|\^", str(x["pattern"]).replace("[^", ""))

    return (
        config["model"]["type"] == "BPE" and not config["model"].get("dropout") and config["post_processor"] is None and bool(config["pre_tokenizer"])
        and all(map(normalizer, parts(config["normalizer"], "normalizers"))) and all(map(splitter, parts(config["pre_tokenizer"], "pretokenizers")))
        and not any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in config["added_tokens"])
    )


def separable(config: dict) -> bool:
    """Whether no pre-token or special token holds white space, so that words between it encode alike anywhere."""
    first = config["pre_tokenizer"] or {}
    first = first["pretokenizers"][0] if first.get("type") == "Sequence" else first
    if first.get("type") != "Split" or first["behavior"] != "Removed" or not first["invert"]:
        return False
    pattern = first["pattern"].get("Regex", " ").replace(r"[^\s", "")
    return not re.search(r"\\[sSWDP]|[ .]|\[\^", pattern) and not any(re.search(r"\s", t["content"]) for t in config["added_tokens"])


class Piece:
    """Ids (little-endian) of some pre-tokens in a row of a text, and where the first and the last of these end: pairs of
    place in the text and number of tokens up to there. whole: the ids are those of the text by itself."""

    __slots__ = ("text", "ids", "ends", "last", "whole")

    def __init__(self, text: str, ids: bytes, ends: tuple, last: tuple, whole: bool):
        self.text, self.ids, self.ends, self.last, self.whole = text, ids, ends, last, whole


def plain(text: str, place: int) -> bool:
    """Whether the signs at a boundary are one sign each also when normalised, and don't combine with neighbours (such as
    a dotted capital i, which becomes a letter and a mark); other places are no boundaries here."""
    near = text[max(0, place - 1) : place + 1]
    return near.isascii() or all(len(unicodedata.normalize("NFC", c.lower())) == 1 and unicodedata.category(c)[0] != "M" for c in near)


def marks(e, words: range, text: str, begin: int = 0, token: int = 0) -> tuple[tuple[int, int], ...]:
    """Where some pre-tokens end, in the text that begins at `begin` of what was encoded, and with its tokens."""
    found = [(e.word_to_chars(w), e.word_to_tokens(w)) for w in words]
    return tuple([(chars[1] - begin, tokens[1] - token) for chars, tokens in found if chars and tokens and plain(text, chars[1] - begin)])


def words_in(e) -> int:
    n = len(e)
    return (e.token_to_word(n - 1) or 0) + 1 if n else 0


def whole(text: str, e, edge: int = EDGE + 2) -> Piece:
    """A text by itself, with the first and last `edge` boundaries."""
    n = words_in(e) if edge else 0
    ids = np.array(e.ids, "<u4").tobytes()
    if n <= 2 * edge:
        ends = last = marks(e, range(n), text)
    else:
        ends, last = marks(e, range(edge), text), marks(e, range(n - edge, n), text)
    return Piece(text, ids, ends, last, True)


def inside(text: str, ids: bytes, e, begin: int, end: int, edge: int = EDGE + 2) -> Piece:
    """The pre-tokens of text[begin:end] that lie inside; the whole text was encoded."""
    own = text[begin:end]
    at = next((w for w in map(e.char_to_word, range(begin, end)) if w is not None), None)
    to = next((w for w in map(e.char_to_word, range(end - 1, begin - 1, -1)) if w is not None), None)
    if at is None:
        return Piece(own, b"", (), (), False)
    at += e.word_to_chars(at)[0] < begin
    to -= e.word_to_chars(to)[1] > end
    if at > to:
        return Piece(own, b"", (), (), False)
    token = e.word_to_tokens(at)[0]
    part = ids[4 * token : 4 * e.word_to_tokens(to)[1]]
    if to - at < 2 * edge:
        ends = last = marks(e, range(at, to + 1), own, begin, token)
    else:
        ends, last = marks(e, range(at, at + edge), own, begin, token), marks(e, range(to + 1 - edge, to + 1), own, begin, token)
    return Piece(own, part, ends, last, False)


def word_ends(text: str, parts: list[bytes], first: int, after: int, edge: int = EDGE + 2) -> tuple[tuple, tuple]:
    """The first and last `edge` boundaries behind words between white space. parts: the ids of the words from number
    `first` on; `after` words more follow them."""
    counts = [0, *accumulate(len(p) // 4 for p in parts)]
    if len(parts) <= 2 * edge:
        own = [m.end() for m in _WORD.finditer(text)][first : first + len(parts)]
        every = tuple([(p, n) for p, n in zip(own, counts[1:], strict=True) if plain(text, p)])
        return every, every
    head = [m.end() for m, _ in zip(_WORD.finditer(text), range(first + edge), strict=False)][first:]
    tail = [m.end() for m in _WORD.finditer(text, max(0, len(text) - TAIL))]
    if len(tail) <= edge + after:  # long words
        tail = [m.end() for m in _WORD.finditer(text)]
    tail = tail[len(tail) - after - edge : len(tail) - after]
    begins = tuple([(p, n) for p, n in zip(head, counts[1 : edge + 1], strict=True) if plain(text, p)])
    return begins, tuple([(p, n) for p, n in zip(tail, counts[-edge:], strict=True) if plain(text, p)])


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        config = json.loads(self.tokenizer.to_str())
        self.composable = composable(config)
        special = [re.escape(t["content"].encode()) for t in config["added_tokens"]]
        self.apart = re.compile(b"|".join(sorted(special, key=len, reverse=True))) if special else None
        #: Without a decoder the library puts a space between tokens.
        self.tokens = [self.tokenizer.id_to_token(i) for i in range(self.tokenizer.get_vocab_size())] if config["decoder"] is None else None
        self.chunks: dict[bytes, Piece] = {}
        self.joins: dict[tuple[str, str], tuple[bytes, tuple[int, int]] | None] = {}
        self.held = 0
        self.separable = self.composable and separable(config)
        self.words, self.now = Recent(KEPT_WORDS), {}

    def prepare(self, parted: list[list[bytes]]) -> None:
        """Makes room, and looks up or encodes at once the words of texts with new chunks (if the tokenizer is separable)."""
        if self.held > KEPT_BYTES:
            self.chunks, self.joins, self.held = {}, {}, 0
        self.now, wanted = {}, set()
        if self.separable:
            for chunks in parted:
                if any(c not in self.chunks for c in chunks):
                    wanted.update(b"".join(chunks).split())
        self._learn(wanted)

    def _learn(self, wanted: set[bytes]) -> None:
        new = []
        for w in wanted:
            found = self.words.get(w)
            if found is None:
                new.append(w)
            else:
                self.now[w] = found
        for i in range(0, len(new), 4096):
            part = new[i : i + 4096]
            e = self.tokenizer.encode([w.decode("utf-8") for w in part], is_pretokenized=True, add_special_tokens=False)
            ids, at = np.array(e.ids, "<u4").tobytes(), np.searchsorted(np.array(e.word_ids, np.int64), np.arange(len(part) + 1)).tolist()
            for w, j, k in zip(part, at, at[1:], strict=False):
                self.now[w] = ids[4 * j : 4 * k]
                self.words.put(w, self.now[w])

    def _parts(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word."""
        missing = {w for w in words if w not in self.now}
        if missing:
            self._learn(missing)
        return [self.now[w] for w in words]

    def _new_words(self, chunks: list[bytes], alone: bool) -> Piece:
        """As _new, from the ids of the words between white space."""
        data = b"".join(chunks)
        parts = self._parts(data.split())
        text = data.decode("utf-8")
        out = Piece(text, b"".join(parts), *(((), ()) if alone else word_ends(text, parts, 0, 0)), True)
        for c in chunks:
            words, first, after = c.split(), c[:1] not in WHITE, c[-1:] not in WHITE
            words = words[first : len(words) - after]
            parts, own = [self.now[w] for w in words], c.decode("utf-8")
            self.chunks[c] = Piece(own, b"".join(parts), *word_ends(own, parts, int(first), int(after)), False)
            self.held += 2 * len(c) + len(self.chunks[c].ids) + 1200
        return out

    def _encode(self, text: str):
        return self.tokenizer.encode(text, add_special_tokens=False)

    def _ids(self, text: str) -> bytes:
        return np.array(self._encode(text).ids, "<u4").tobytes()

    def _new(self, chunks: list[bytes], alone: bool) -> Piece:
        """Encodes neighbouring chunks at once, and keeps each. alone: they are a text, so there is nothing to join."""
        if self.separable:
            return self._new_words(chunks, alone)
        text = b"".join(chunks).decode("utf-8")
        e = self._encode(text)
        out, begin = whole(text, e, 0 if alone else EDGE + 2), 0
        for data in chunks:
            end = begin + len(data.decode("utf-8"))
            self.chunks[data] = inside(text, out.ids, e, begin, end)
            self.held += 2 * len(data) + len(self.chunks[data].ids) + 1200
            begin = end
        return out

    def pieces(self, chunks: list[bytes]) -> list[Piece]:
        """The chunks of a text: kept ones, and between them new ones, at most RUN at once."""
        out, new = [], []
        for data in chunks:
            found = self.chunks.get(data)
            if new and (found or len(new) == (RUN_OF_WORDS if self.separable else RUN)):
                out.append(self._new(new, False))
                new = []
            if found:
                out.append(found)
            else:
                new.append(data)
        return [*out, self._new(new, not out)] if new else out

    def _window(self, left: str, head: str, first: bytes, ends: tuple, ids: bytes) -> tuple[bytes, tuple[int, int]] | None:
        """The ids of left + head up to the first boundary in the right piece (whose pre-tokens have these ends, the last
        of them being head's) from which it agrees with that piece, and this boundary; None where there is none, or where
        its ids don't begin as the left piece says."""
        text = left + head
        e = self._encode(text)
        own = np.array(e.ids, "<u4").tobytes()
        if not own.startswith(first):
            return None
        places = {at - len(left): n for at, n in marks(e, range(words_in(e)), text)}
        for i, (at, n) in enumerate(ends[:-1]):
            if all(p in places for p, _ in ends[i:]) and own[4 * places[at] :] == ids[4 * n : 4 * ends[-1][1]]:
                return own[: 4 * places[at]], (at, n)
        return None

    def _join(self, left: str, first: bytes, right: Piece) -> tuple[bytes, tuple[int, int], Piece] | None:
        """As _window, with the first boundaries of the right piece, then with ever more of them; and that piece."""
        ends = right.ends[: EDGE + 1]
        if len(ends) > EDGE:
            key = left, right.text[: ends[-1][0]]
            if key not in self.joins:
                self.joins[key] = self._window(*key, first, ends, right.ids)
                self.held += 2 * len(left) + 500
            if self.joins[key] is not None:
                return *self.joins[key], right
        right = whole(right.text, self._encode(right.text), len(right.text) + 1)
        n = 4 * EDGE
        while n < len(right.ends):
            found = self._window(left, right.text[: right.ends[n][0]], first, right.ends[: n + 1], right.ids)
            if found is not None:
                return *found, right
            n *= 4
        return None

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text."""
        if not self.composable:
            return [self._ids(t.decode("utf-8")) for t in texts]
        parted = []
        for t in texts:
            at = cuts(t, self.apart)
            parted.append([t[i:j] for i, j in zip(at, at[1:], strict=False)])
        self.prepare(parted)
        return [self.joined(self.pieces(chunks)) for chunks in parted]

    def joined(self, pieces: list[Piece]) -> bytes:
        """The ids of a text that consists of pieces."""
        if not pieces:
            return b""
        # since: the place and tokens in the last piece from which its ids hold; None: the text `open_` is to be encoded
        out, last, since, open_ = [], pieces[0], (0, 0), ""
        if not last.whole:
            out, last, since, open_ = [], None, None, ""
        else:
            pieces = pieces[1:]
        for right in [*pieces, None]:
            if right is None and since is not None and last.whole:
                out.append(last.ids[4 * since[1] :])
                break
            joined, back = None, EDGE + 1
            inner = [x for x in last.last if x[0] > since[0]] if since is not None else []
            while joined is None and back <= len(inner):  # further back, where the window says otherwise
                place, n = inner[-back]
                left, first = last.text[place:], last.ids[4 * n : 4 * inner[1 - back][1]]
                back += 1
                if right is not None:
                    joined = self._join(left, first, right)
                else:
                    ids = self._ids(left)
                    joined = (ids, None, None) if ids.startswith(first) else None
            if since is not None:
                if joined is None:
                    place, n = since
                out.append(last.ids[4 * since[1] : 4 * n])
                open_ = last.text[place:]
            if joined is None:
                joined = (self._ids(open_), None, None) if right is None else self._join(open_, b"", right) if since is None else None
            if joined is None:
                open_, last, since = open_ + right.text, None, None
            else:
                out.append(joined[0])
                _, since, last = joined
        return b"".join(out)

    def decode(self, ids: list[bytes]) -> list[str]:
        numbers = [np.frombuffer(x, "<u4").tolist() for x in ids]
        if self.tokens is not None:
            return [" ".join(map(self.tokens.__getitem__, x)) for x in numbers]
        return self.tokenizer.decode_batch(numbers, skip_special_tokens=False)


def encoder(path: str) -> Encoder:
    return worker_wide(f"bpe {path}", lambda: Encoder(path))


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """A row for each document: doc_id, n_tokens, ids (little-endian unsigned 32-bit), decoded."""
    path = path or tokenizer_path()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        e = encoder(path)
        ids = e.encode([(text or "").encode("utf-8", "replace") for text in batch.column("text").to_pylist()])
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(e.decode(ids), pa.string())], names=["doc_id", "n_tokens", "ids", "decoded"])

    return by_text(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, "doc_id long, n_tokens long, ids binary, decoded string")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = encode(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
