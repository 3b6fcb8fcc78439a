"""Exact, near and partial copies, against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

from millrace.llm import components, exact_dedup, simhash, suffix_dedup
from tests.llm.helpers import WIDTH, documents, rows, same

LAST = 2**63 - 1


def normal(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def test_exact_dedup(spark):
    data = rows()
    got = exact_dedup.decide(documents(spark, data, extra=True)).collect()
    groups = {}
    for d in data:
        groups.setdefault(normal(d[1]), []).append(LAST if d[0] is None else d[0])
    want, left = [], {t: 1 for t in groups}
    for d in data:
        g, own = groups[normal(d[1])], LAST if d[0] is None else d[0]
        stays = own == min(g) and left[normal(d[1])] > 0
        left[normal(d[1])] -= stays
        want.append((d[0], None if min(g) == LAST else min(g), len(g), stays, hashlib.sha256(normal(d[1]).encode()).hexdigest()))
    same([tuple(r) for r in got], want)
    kept = exact_dedup.deduplicate(documents(spark, data, extra=True))
    assert len(kept.columns) == WIDTH and sorted(normal(r.text) for r in kept.collect()) == sorted(groups)
    assert exact_dedup.decide(documents(spark, [])).count() == 0 and exact_dedup.deduplicate(documents(spark, [])).count() == 0


def test_perfect_hash():
    for n in (1, 2, 3, 50, 5000):
        digests = np.array([list(hashlib.sha256(str(i).encode()).digest()) for i in range(n)], np.uint8)
        salt, seeds = exact_dedup.perfect_hash(digests)
        a, b = exact_dedup._words(digests)
        assert sorted(exact_dedup._slots(a, b, seeds, n, salt)) == list(range(n))
    at, found = exact_dedup.look_up({"seeds": seeds.tobytes(), "n": n, "salt": salt, "digests": digests.tobytes()}, digests[:3] ^ 1)
    assert not found.any()


def plain_fingerprint(t, k=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + k]).encode(), 42) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(prints, radius=4):
    """For each distinct print the smallest of its component, by comparing all pairs."""
    parent = {p: p for p in prints}

    def find(p):
        while parent[p] != p:
            p = parent[p]
        return p

    ordered = sorted(parent)
    for i, p in enumerate(ordered):
        for q in ordered[:i]:
            if (p ^ q).bit_count() <= radius:
                a, b = find(p), find(q)
                parent[max(a, b)] = min(a, b)
    return {p: find(p) for p in parent}


def test_near_dedup(spark):
    data = rows(90)
    prints = [plain_fingerprint(d[1]) for d in data]
    root = roots(prints)
    least = {}
    for d, p in zip(data, prints, strict=True):
        least[root[p]] = min(least.get(root[p], LAST), LAST if d[0] is None else d[0])
    want = [(d[0], f"{p:016x}", None if least[root[p]] == LAST else least[root[p]]) for d, p in zip(data, prints, strict=True)]
    same([tuple(r) for r in simhash.near_dedup(documents(spark, data, extra=True)).collect()], want)
    kept = simhash.keep_first(documents(spark, data, extra=True), size=4)
    assert kept.count() == len(least) and len(kept.columns) == WIDTH
    assert simhash.near_dedup(documents(spark, [])).count() == 0 and simhash.keep_first(documents(spark, [])).count() == 0


def test_masks_cover_the_radius():
    r = random.Random(1)
    second = simhash.masks([p for p in range(64) if not simhash.MASKS[5] >> p & 1])
    assert len(simhash.MASKS) == 31 and min(m.bit_count() for m in simhash.MASKS) >= 30
    for _ in range(5000):
        diff = sum(1 << p for p in r.sample(range(64), r.randint(1, 4)))
        assert any(m & diff == 0 for m in simhash.MASKS)
        hidden = diff & ~simhash.MASKS[5] & (2**64 - 1)
        assert any(m & hidden == 0 for m in second)


@pytest.mark.parametrize("bucket", [4096, 8])
def test_links_of_large_buckets(spark, monkeypatch, bucket):
    """Clusters of many prints give the same components, dealt once or twice."""
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    r = random.Random(2)
    prints = {0}
    for _ in range(4):
        centre = r.getrandbits(64)
        prints |= {centre ^ sum(1 << p for p in r.sample(range(64), r.randint(0, 4))) for _ in range(150)}
    prints |= {r.getrandbits(64) for _ in range(100)}
    df = spark.createDataFrame([(simhash._signed(p),) for p in prints], "fp long")
    got = {x.node: x.root for x in components.components(simhash.links(df)).collect()}
    want = roots(prints)
    pairs = lambda m: {frozenset(k for k in m if m[k] == v) for v in set(m.values())}
    whole = {simhash._signed(p): got.get(simhash._signed(p), simhash._signed(p)) for p in prints}
    assert pairs(whole) == {frozenset(map(simhash._signed, g)) for g in pairs(want)}


def test_components(spark):
    chain = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(300)] + [(-5, -9), (7, 7)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert {got[i] for i in range(201)} == {0} and {got[1000 + i] for i in range(300)} == {1000} and got[-5] == got[-9] == -9
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_suffixes(data, length=100):
    """(doc_id, n_bytes, n_removed, n_spans, kept) in the operator's order of rows."""
    seen, out, times = {}, [], {}
    order = sorted(data, key=lambda d: (LAST if d[0] is None else d[0]))
    for d in order:
        b = (d[1] or "").encode()
        again = times.setdefault((d[0], b), 0)
        times[d[0], b] += 1
        covered = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if b[i : i + length] in seen:
                covered[i : i + length] = b"\1" * length
            seen[b[i : i + length]] = again
        kept = bytes(x for x, c in zip(b, covered, strict=True) if not c)
        spans = sum(1 for i in range(len(b)) if covered[i] and (i == 0 or not covered[i - 1]))
        out.append((d[0], len(b), sum(covered), spans, hashlib.sha256(kept).hexdigest()))
    return out


def test_suffix_dedup(spark):
    r = random.Random(9)
    data = [d for d in rows(80) if d[0] is not None]
    ids = [d[0] for d in data]
    data = [d for d in data if ids.count(d[0]) == 1 or d == data[0]]  # one order of rows
    phrase = "".join(r.choice("abcdefgh ") for _ in range(99))
    for i in range(60):  # a string just too short, one just long enough, and self-repeats
        a, b = ("".join(r.choice("abcdefgh ") for _ in range(r.randint(5, 80))) for _ in range(2))
        data.append((5000 + i, a + phrase + ("!" if i % 2 else "?") + b, "en", "s", 0))
    data += [(6000, "ab" * 300, "en", "s", 0), (6001, "x" * 500, "en", "s", 0), (6002, "ü" * 99, "en", "s", 0), (6003, "é" * 51 + "ü" * 99, "en", "s", 0)]
    want = brute_suffixes(data)
    same([tuple(x) for x in suffix_dedup.summaries(documents(spark, data, extra=True)).collect()], want)
    out = suffix_dedup.remove(documents(spark, data, extra=True))
    assert len(out.columns) == WIDTH
    kept = {x.doc_id: x for x in out.collect()}
    assert len(kept) == len({d[0] for d in data}) and kept[6003].text == "é" * 51 + "ü" * 99 or len(kept[6003].text) < 150
    assert all(x.n_chars == len(x.text) for x in kept.values() if x.text is not None and x.doc_id < 1000)
    assert suffix_dedup.summaries(documents(spark, [])).count() == 0 and suffix_dedup.remove(documents(spark, [])).count() == 0


def test_multikey_order():
    r = np.random.default_rng(4)
    keys = [r.integers(0, 5, 500).astype(np.uint64) for _ in range(3)]
    order, begins = suffix_dedup.multikey_order(keys)
    ordered = list(zip(*(k[order] for k in keys), strict=True))
    assert ordered == sorted(ordered)
    for i, begin in enumerate(begins):
        assert [bool(b) for b in begin] == [j == 0 or ordered[j][: i + 1] != ordered[j - 1][: i + 1] for j in range(500)]
    columns = [r.integers(0, 2**63, 77).astype("<u8"), r.integers(0, 200, 77).astype("u1"), r.integers(-9, 9, 77).astype("<i8")]
    assert all((a == b).all() for a, b in zip(columns, suffix_dedup.unpack(suffix_dedup.pack(columns), ["<u8", "u1", "<i8"]), strict=True))
