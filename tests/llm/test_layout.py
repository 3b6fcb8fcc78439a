"""Shards and bins, and the pipeline."""

import random
from collections import defaultdict

import pytest

import corpus_pipeline
from millrace.llm import packing, sharding
from tests.llm.helpers import documents, rows, same


def brute(sizes, conflicts, capacity):
    bins, out = [], []
    for s, ks in zip(sizes, conflicts, strict=True):
        fits = [(r, i) for i, (r, held) in enumerate(bins) if r >= s and not held & set(ks)]
        i = min(fits)[1] if fits else len(bins)
        if not fits:
            bins.append((capacity, set()))
        bins[i] = (bins[i][0] - s, bins[i][1] | set(ks))
        out.append(i)
    return out


@pytest.mark.parametrize("seed", range(40))
def test_best_fit(seed):
    r = random.Random(seed)
    n = r.randint(0, 150)
    sizes = [r.randint(0, 60) for _ in range(n)]
    conflicts = [tuple(x for x in (("s", min(r.randint(0, 6), r.randint(0, 6))), ("c", r.randint(0, 40))) if r.random() < 0.9) for _ in range(n)]
    assert packing.best_fit(sizes, conflicts, 60, hot=3) == packing.best_fit(sizes, conflicts, 60, hot=200) == brute(sizes, conflicts, 60)


def test_packing(spark):
    data = rows(120)
    items = packing.items(documents(spark, data, extra=True))
    got = packing.pack(items, capacity=200, group=40).collect()
    words = defaultdict(list)
    for d in data:
        words[d[0]].append(len((d[1] or "").split()))
    placed, bins = defaultdict(int), defaultdict(list)
    for r in got:
        placed[r.doc_id] += r.n_words
        bins[r.bin_id].append(r)
    assert placed == {k: sum(v) for k, v in words.items()}
    source = {d[0]: d[3] for d in data}
    for b in bins.values():
        assert sum(r.n_words for r in b) == b[0].bin_words <= 200
        own = [source[r.doc_id] for r in b if r.doc_id is not None and source[r.doc_id] is not None]
        assert len(own) == len(set(own))
    assert packing.pack(packing.items(documents(spark, []))).count() == 0


def test_sharding(spark):
    data = rows(120)
    got = sharding.shard(documents(spark, data, extra=True), limit=3000)
    shards = {(r.shard, r.page): r for r in sharding.directory(got).collect()}
    assert sum(r.n_docs for r in shards.values()) == len(data)
    for (name, page), r in shards.items():
        assert r.n_bytes <= 3000 or r.n_docs == 1, (name, page, r)
    names = {n for n, p in shards if p == 0}
    assert not any(a != b and b.startswith(a) for a in names for b in names)  # a prefix code
    total = defaultdict(int)
    for r in got.collect():
        for d in range(r.local_depth):
            total[r.shard[:d]] += r.n_bytes
    assert all(v > 3000 for k, v in total.items())  # nothing split without need
    assert sharding.shard(documents(spark, [])).count() == 0


@pytest.mark.parametrize("limit", [1000, 777, 100])
def test_pages_keep_the_limit(spark, limit):
    """Rows that no bit can split: one id, null ids, sizes up to the limit and above it."""
    r = random.Random(limit)
    data = [(k, "x" * r.choice([0, 1, 90, 333, 500, 501, 999, 1000, 1001, 2500]), "en", "s", 0) for k in (7, None, 8) for _ in range(80)]
    got = sharding.shard(documents(spark, data), limit=limit)
    same([(x.doc_id, x.n_bytes) for x in got.collect()], [(d[0], len(d[1])) for d in data])
    shards = sharding.directory(got).collect()
    assert sum(x.n_docs for x in shards) == len(data) and all(x.n_bytes <= limit or x.n_docs == 1 for x in shards)
    by_name = defaultdict(list)
    for x in shards:
        by_name[x.shard].append(x)
    for pages in by_name.values():
        assert len(pages) <= 4 * sum(x.n_bytes for x in pages) / limit + 2  # and they are filled


def test_directory(spark):
    """Each of the directory's 2 ** global_depth entries points to one shard."""
    shards = sharding.directory(sharding.shard(documents(spark, [(i, "x" * 50, "en", "s", 50) for i in range(300)]), limit=600)).collect()
    assert {x.global_depth for x in shards} == {max(x.local_depth for x in shards)}
    assert sum(x.n_entries for x in shards) == 2 ** shards[0].global_depth and len(shards) > 20


def test_packing_does_not_depend_on_partitions(spark):
    data = rows(120)
    df = packing.items(documents(spark, data))
    a, b = (sorted(map(tuple, packing.pack(df.repartition(n), 200, 40).collect()), key=repr) for n in (2, 7))
    assert a == b


def test_pipeline(spark, tmp_path):
    good = [d for d in rows(150) if d[1] and len(d[1].split()) >= 25]
    data = good + rows(150)
    documents(spark, data).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    counts = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "best_fit_packing":
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        counts.append(docs.count())
    assert counts[0] > counts[1] >= counts[2] == counts[3] <= counts[4]
    assert docs.select("doc_id").distinct().count() > 20
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == counts[4]
    assert corpus_pipeline.ORACLE_SQL is None and [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "exact_dedup", "simhash_near_dedup", "suffix_dedup", "best_fit_packing"]
