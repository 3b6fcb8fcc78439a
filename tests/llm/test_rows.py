"""Operators that look at one document at a time, against plain Python or the library."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from millrace.llm import bpe, quality_rules, token_count
from tests.llm.helpers import documents, rows, same, texts

W = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    t = text or ""
    w = W.findall(t)
    n = Counter(tuple(w[j : j + 8]) for j in range(len(w) - 7))
    covered, seen, repeated = set(), set(), 0
    for j in range(len(w) - 7):
        if n[tuple(w[j : j + 8])] > 1:
            covered |= set(range(j, j + 8))
    for line in t.split("\n"):
        if W.search(line):
            repeated += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), repeated, len(covered)


def test_quality_counts(spark):
    data = rows() + [(2000, "a b c d e f g h " * 5 + "#x |\nq\nq\n q", "en", "s", 1)]
    got = quality_rules.score(documents(spark, data, extra=True)).collect()
    want = []
    for r in data:
        c = base(r[1])
        want.append((r[0], *c, c[0] < 20 or 100 * c[4] > 30 * c[0]))
    same([(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got], want)
    assert all(not (r.base_failed and r.kept) and r.kept == (not r.base_failed and r.p_good >= 0.5) for r in got)
    kept = quality_rules.keep(documents(spark, data, extra=True))
    assert "__m" in kept.columns
    stays = {(r.doc_id, r.n_words, r.word_chars) for r in got if r.kept}
    same([(r.doc_id, r.text) for r in kept.collect()], [(d[0], d[1]) for d in data if (d[0], *base(d[1])[:2]) in stays])


def test_label_model_finds_accuracies():
    r = np.random.default_rng(1)
    good = r.random(20000) < 0.8
    votes = np.stack([np.where(r.random(20000) < p, np.where(good, 1, -1), np.where(good, -1, 1)) * (r.random(20000) < 0.7) for p in (0.95, 0.9, 0.85, 0.7)], axis=1)
    patterns, n = np.unique(votes, axis=0, return_counts=True)
    m = quality_rules.fit(patterns, n)
    assert abs(m.prior - 0.8) < 0.04 and np.abs(m.on_good - [0.95, 0.9, 0.85, 0.7]).max() < 0.05
    assert ((m.posterior(votes) >= 0.5) == good).mean() > 0.93
    all_good = quality_rules.fit(np.ones((1, 3), int), np.array([5]))
    assert all_good.posterior(np.ones((1, 3), int))[0] > 0.9
    assert quality_rules.fit(np.empty((0, 3), int), np.empty(0, int)).prior > 0.5


def test_quality_of_nothing(spark):
    assert quality_rules.score(documents(spark, [])).count() == 0 and quality_rules.keep(documents(spark, [])).count() == 0


ODD = ["a", "B", "é", "é", " ", "\n", " ", " ", "'s", "12", "日", "🙂", "<|endoftext|>", "ß", "İ", "Σ", "!", "\x85", "\x1c"]


def tokenizer_file(name):
    import public_tokenizers

    return public_tokenizers.path(name)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_bpe_equals_the_library(spark, name):
    from tokenizers import Tokenizer

    lib, r = Tokenizer.from_file(tokenizer_file(name)), random.Random(5)
    assert bpe.Encoder(tokenizer_file(name)).composable
    data = rows() + [(3000 + i, "".join(r.choice(ODD) for _ in range(r.randint(1, 900))), None, None, None) for i in range(60)] + [(4000, "x" * 20000, None, None, None)]
    want = []
    for d in data:
        ids = lib.encode(d[1] or "", add_special_tokens=False).ids
        want.append((d[0], len(ids), np.array(ids, "<u4").tobytes(), lib.decode(ids, skip_special_tokens=False)))
    got = bpe.encode(documents(spark, data, extra=True), tokenizer_file(name)).collect()
    same([(x.doc_id, x.n_tokens, bytes(x.ids), x.decoded) for x in got], want)
    assert bpe.encode(documents(spark, [])).count() == 0


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
@pytest.mark.parametrize("cut", [4, 6])
def test_joins_of_small_chunks(monkeypatch, name, cut):
    """Chunks of some 16 or 64 bytes, met again in other surroundings; special tokens; long stretches without a boundary."""
    monkeypatch.setattr(bpe, "CUT", cut)
    e, r = bpe.Encoder(tokenizer_file(name)), random.Random(cut)
    passages = ["".join(r.choice(ODD) for _ in range(r.randint(20, 200))) for _ in range(12)] + texts(20) + ["x" * 3000, " " * 700, "<|endoftext|>" * 30]
    for _ in range(150):
        t = "".join(r.choice(passages)[r.randint(0, 9) :] for _ in range(r.randint(1, 6)))
        ids = e.encode([t.encode()])[0]
        want = e.tokenizer.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want
        assert e.decode([ids]) == [e.tokenizer.decode(want, skip_special_tokens=False)]
    assert len(e.chunks) > 100 and sum(x is not None for x in e.joins.values()) > 20


def test_other_tokenizers_encode_whole_texts(tmp_path):
    import json

    with open(tokenizer_file("byte_bpe_50k.json")) as f:
        config = json.load(f)
    config["pre_tokenizer"]["add_prefix_space"] = True
    (tmp_path / "t.json").write_text(json.dumps(config))
    e = bpe.Encoder(str(tmp_path / "t.json"))
    text = " ".join(texts(20))
    assert not e.composable and np.frombuffer(e.encode([text.encode()])[0], "<u4").tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids


def test_chunks_are_shared():
    """A passage has the same chunks behind different beginnings."""
    passage = " ".join(texts(30)).encode()
    a, b = (set(zip(c, c[1:], strict=False)) for c in (bpe.cuts(passage), [x - 7 for x in bpe.cuts(b"1234567" + passage)]))
    assert len(a & b) > 0.9 * len(a)


def unigram(vocab):
    from tokenizers import Tokenizer, models, pre_tokenizers

    t = Tokenizer(models.Unigram(vocab, unk_id=0, byte_fallback=False))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement=token_count.SPACE, prepend_scheme="always", split=True)
    return t


def test_token_counts_equal_the_library(spark):
    lib, r = unigram(token_count.vocabulary(token_count.vocabulary_path())), random.Random(6)
    data = rows(30) + [(3000 + i, "".join(r.choice("ab ▁\n͸🙂<unk>te") for _ in range(60)), None, None, None) for i in range(80)]
    got = token_count.count_tokens(documents(spark, data, extra=True)).collect()
    same([tuple(x) for x in got], [(d[0], len(d[1] or ""), len(lib.encode(d[1] or "", add_special_tokens=False).ids)) for d in data])
    assert token_count.count_tokens(documents(spark, [])).count() == 0


@pytest.mark.parametrize("seed", range(20))
def test_viterbi_ties(seed):
    r = random.Random(seed)
    vocab = [("<unk>", 0.0)] + [(p, float(r.randint(-4, 0))) for p in sorted({"".join(r.choice("abc") for _ in range(r.randint(1, 4))) for _ in range(12)})]
    ours = token_count.Counter(vocab)
    from tokenizers import Tokenizer, models

    lib = Tokenizer(models.Unigram(vocab, unk_id=0, byte_fallback=False))
    for _ in range(60):
        w = "".join(r.choice("abcd") for _ in range(r.randint(1, 15)))
        assert ours.count(w) == len(lib.encode(w).ids)


def test_queries_give_the_contract(spark, tmp_path):
    documents(spark, rows()).write.parquet(f"{tmp_path}/documents.parquet")
    out = bpe.op7_bpe(spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    empty = out.filter("doc_id = 1001").first()
    assert empty.n_tokens == 0 and empty.ids_sha256 == hashlib.sha256(b"").hexdigest() == empty.decoded_sha256
    assert pa.types.is_int64(quality_rules.op1_quality_rules(spark, str(tmp_path)).limit(1).toArrow().schema.field("n_symbols").type)
