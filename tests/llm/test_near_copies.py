"""The near-dedup stage against brute force over all pairs of shingle sets."""

import random
import re

import pytest

import corpus_pipeline
from millrace.llm import near_copies
from tests.llm.helpers import WIDTH, documents, rows

LAST = 2**63 - 1


def shingle_set(t, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def similarity(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def brute(data):
    """The least id of each group that links of similarity 0.8 or more make."""
    made = [shingle_set(d[1]) for d in data]
    group = list(range(len(data)))
    for i in range(len(data)):
        for j in range(i):
            if 5 * len(made[i] & made[j]) >= 4 * len(made[i] | made[j]) and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    least = {}
    for d, g in zip(data, group, strict=True):
        least[g] = min(least.get(g, LAST), LAST if d[0] is None else d[0])
    return sorted(least.values())


def planted(seed=5, bases=12):
    """Texts, each with copies that differ in 1 to 12 of 200 words: similarities from about 0.5 to 0.98."""
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(2000)]
    out = []
    for b in range(bases):
        base = [r.choice(words) for _ in range(200)]
        out.append(base)
        for changes in range(1, 13):
            copy = list(base)
            for at in r.sample(range(5, 195), changes):
                copy[at] = f"new{r.randint(0, 10**9)}"
            out.append(copy)
    return [(i + 1, " ".join(w), "en", f"s{i % 3}", len(" ".join(w))) for i, w in enumerate(out)]


def ids(df):
    return sorted(LAST if r.doc_id is None else r.doc_id for r in df.select("doc_id").collect())


@pytest.mark.parametrize("large", [64, 3])
def test_all_pairs_of_similarity_from_08(spark, monkeypatch, large):
    """Every planted pair from 0.8 on is found, with groups compared with pivots first and without."""
    monkeypatch.setattr(near_copies, "LARGE", large)
    data = planted() + [(1000 + (d[0] or 0), *d[1:]) for d in rows(40) if d[0] is not None]
    out = corpus_pipeline.simhash_stage(spark, documents(spark, data, extra=True), "")
    assert ids(out) == brute(data) and len(out.columns) == WIDTH
    sims = [similarity(shingle_set(data[b * 13][1]), shingle_set(data[b * 13 + k][1])) for b in range(12) for k in range(1, 13)]
    assert sum(0.8 <= x < 0.85 for x in sims) > 3 and sum(0.85 <= x < 0.95 for x in sims) > 10 and sum(x < 0.8 for x in sims) > 20


def test_nulls_and_empty_tables(spark):
    data = rows(60)
    assert ids(corpus_pipeline.simhash_stage(spark, documents(spark, data), "")) == brute(data)
    assert corpus_pipeline.simhash_stage(spark, documents(spark, []), "").count() == 0


def test_candidates_of_large_buckets(monkeypatch):
    """Buckets over BUCKET rows give the pairs that small ones do."""
    import numpy as np

    r = np.random.default_rng(3)
    h, n, i = r.integers(0, 4, 300), r.integers(20, 60, 300), r.integers(0, 4, 300)
    node, root = np.arange(300), np.where(r.random(300) < 0.6, 0, np.arange(300))
    cells = r.integers(0, 8, (300, 2))
    find = lambda: set(zip(*(x.tolist() for x in near_copies.candidates(h, node, n, i, root, *cells.T)), strict=True))
    want = find()
    monkeypatch.setattr(near_copies, "BUCKET", 10)
    assert find() == want and len(want) > 100


def test_sketches_never_tell_too_much():
    """Sets of any size differ in at least as many members as their sketches say; unlike sets differ a lot."""
    import numpy as np

    r = np.random.default_rng(4)
    for size in (0, 1, 30, 300, 5000, 40_000):
        for share in (0, 0.5, 0.8, 0.95, 1):
            both, rest = (r.integers(0, 2**64, k, np.uint64) for k in (int(size * share), size - int(size * share)))
            a, b = np.unique(both), np.unique(np.concatenate([both, rest]))
            differ = len(np.setxor1d(a, b))
            got = near_copies.apart(near_copies.sketch(a)[None], near_copies.sketch(b)[None])[0]
            odd = near_copies.odd_apart(near_copies.parities(a), near_copies.parities(b))
            assert max(got, odd) <= differ and (odd > 0 or differ == 0)
    x, y = (near_copies.sketch(r.integers(0, 2**64, 300, np.uint64))[None] for _ in "ab")
    assert 9 * near_copies.apart(x, y)[0] > 600
    for n, m in ((0, 0), (0, 3), (3, 40_000), (30, 33), (60_000, 50_000)):
        a, b = (r.integers(0, 2**64, k, np.uint64) for k in (n, m))
        assert near_copies.odd_apart(near_copies.parities(a), near_copies.parities(b)) <= n + m


def test_large_group_of_unlike_copies_makes_few_pairs(spark, monkeypatch):
    """Copies of one text whose similarity is just too small aren't paired with one another, the few that are links are."""
    r = random.Random(8)
    words = ["".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(2000)]
    base, made = [r.choice(words) for _ in range(300)], []
    for k in range(120):
        copy = list(base)
        for at in r.sample(range(5, 295), 5):
            copy[at] = f"new{r.randint(0, 10**9)}"
        made.append(copy)
        if k % 20 == 0:
            made.append([*copy, "one", "more"])
    data = [(i + 1, " ".join(w), "en", "s0", 1) for i, w in enumerate(made)]
    met, ruled = [], near_copies.ruled
    monkeypatch.setattr(near_copies, "SAMPLE", 1)
    monkeypatch.setattr(near_copies, "ruled", lambda pairs, nodes: met.append(pairs.count()) or ruled(pairs, nodes))
    assert ids(corpus_pipeline.simhash_stage(spark, documents(spark, data), "")) == brute(data)
    assert len(met) > 1 and sum(met[1:]) < 60 and len(brute(data)) < len(data)


def test_pairs_are_left_to_earlier_buckets():
    """Pairs that met in an earlier bucket aren't named again, and none is lost; as many tasks as buckets."""
    import numpy as np

    r = np.random.default_rng(6)
    held = [np.sort(r.choice(np.arange(1, 60), r.integers(1, 30), replace=False)) for _ in range(50)]
    row = [(h, k, 1000, i, [*held[k][max(0, i - near_copies.BEFORE) : i][::-1], *[0] * near_copies.BEFORE][: near_copies.BEFORE]) for k in range(50) for i, h in enumerate(held[k])]
    found = {True: [], False: []}
    for bucket in range(1, 60):
        h, node, n, i, before = (np.array(x) for x in zip(*[x for x in row if x[0] == bucket], strict=True))
        none = np.zeros(len(h), np.int64)
        for told in found:
            a, b = near_copies.candidates(h, node, n, i, node, none, none, before if told else None)
            found[told] += zip(a.tolist(), b.tolist(), strict=True)
    assert set(found[True]) == set(found[False]) and len(found[True]) < 0.8 * len(found[False])


def test_short_forms_of_long_sketches():
    """Parities compares many rows as odd_apart does two; a folded sketch never tells more than the whole one."""
    import numpy as np

    r = np.random.default_rng(7)
    sets_ = [r.integers(0, 2**64, int(k), np.uint64) for k in r.choice([0, 3, 20, 90, 400, 3000, 9000], 60)]
    long = [near_copies.parities(x) for x in sets_]
    short = [near_copies.folded(x) for x in long]
    assert max(map(len, long)) > near_copies.SHORT == max(map(len, short))
    x, y = (r.integers(0, 60, 500) for _ in "ab")
    got = near_copies.Parities(short).apart(x, y).tolist()
    assert got == [near_copies.odd_apart(short[i], short[j]) for i, j in zip(x, y, strict=True)]
    assert all(g <= near_copies.odd_apart(long[i], long[j]) <= len(np.setxor1d(sets_[i], sets_[j])) for g, i, j in zip(got, x, y, strict=True))
