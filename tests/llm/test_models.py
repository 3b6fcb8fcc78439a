"""Classifiers: exact neighbours, and accuracy on labels that they have not seen."""

import random
import zlib

import numpy as np
import pytest

from millrace.llm import quality_classifier, toxicity
from tests.llm.helpers import documents, rows, texts

BAD = ["vile", "vileness", "grimblo", "grimblos"]


def corpus(n=400, seed=2):
    r = random.Random(seed)
    base = texts(n, seed)
    data, labels = [], []
    for i, t in enumerate(base):
        toxic = i % 5 == 0
        if toxic:
            w = t.split()
            for _ in range(3):
                w.insert(r.randint(0, len(w)), r.choice(BAD))
            t = " ".join(w)
        poor = i % 6 == 1
        if poor:
            t = " ".join(x.upper() + "!!" for x in t.split()) if i % 12 == 1 else " | ".join(t.split())
        data.append((i, t, "en", "s", len(t)))
        labels.append((i, int(not poor), int(toxic)))
    return data, labels


def label_table(spark, labels):
    return spark.createDataFrame([*labels, (0, None, None), (None, 1, 1), (5, 1, 1)], "doc_id long, quality int, toxic int")


@pytest.mark.parametrize(("module", "label", "modulus", "rest"), [(toxicity, "toxic", 4, 2), (quality_classifier, "quality", 5, 0)])
def test_held_out(spark, module, label, modulus, rest):
    data, labels = corpus()
    docs = documents(spark, data + rows(5)[5:], extra=True)
    got = module.score(docs, module.fit(docs, label_table(spark, labels))).collect()
    assert len(got) == len(data + rows(5)[5:]) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % modulus == rest) for r in got)
    truth = {i: (q if label == "quality" else t) for i, q, t in labels}
    held = [(truth[r.doc_id], r.predicted) for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 50 and sum(a == b for a, b in held) / len(held) > 0.93


@pytest.mark.parametrize("module", [toxicity, quality_classifier])
def test_held_out_labels_are_not_read(spark, module):
    """Other labels for the held-out rows change nothing."""
    data, labels = corpus(150)
    docs = documents(spark, data)
    held = lambda i: zlib.crc32(str(i).encode()) % module.MODULUS == module.HELD_OUT
    turned = [(i, 1 - q, 1 - t) if held(i) else (i, q, t) for i, q, t in labels]
    a, b = ({r.doc_id: r.score for r in module.score(docs, module.fit(docs, spark.createDataFrame(x, "doc_id long, quality int, toxic int"))).collect()} for x in (labels, turned))
    assert a == b


@pytest.mark.parametrize("module", [toxicity, quality_classifier])
def test_without_labels_or_rows(spark, module):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = documents(spark, rows(5))
    got = module.score(docs, module.fit(docs, none)).collect()
    assert {round(r.score, 6) for r in got} == {0.1}
    assert module.score(documents(spark, []), module.fit(documents(spark, []), none)).count() == 0


@pytest.mark.parametrize("opened", [1, 4, 99])
def test_block_max_search_is_exact(monkeypatch, opened):
    """The neighbours of dense cosines over all terms, ties by place; also where few blocks are opened first."""
    monkeypatch.setattr(toxicity, "OPENED", opened)
    data, labels = corpus(300)
    data += [(1000 + i, *data[i][1:]) for i in range(20)]  # ties
    labels += [(1000 + i, *labels[i][1:]) for i in range(20)]
    made = [(d[0], t[2], toxicity.words(d[1])) for d, t in zip(data, labels, strict=True)]
    index = toxicity.build(made, 0.2)
    blocks = -(-len(data) // toxicity.BLOCK)
    every = {t for _, _, c in made for t in toxicity.terms(c)}
    assert set(index.vocabulary) == every  # nothing left out
    dense = np.zeros((len(every), blocks * toxicity.BLOCK))
    for t in range(len(every)):
        at = slice(index.postings[index.cells[t]], index.postings[index.cells[t + 1]])
        dense[t, index.example[at]] = index.weight[at]
    assert np.allclose((dense**2).sum(axis=0)[: len(data)], 1)
    for d in data[:60] + [(0, texts(80, seed=9)[k]) for k in range(40)]:
        t, q = index.vector(toxicity.words(d[1]))
        e, s = index.nearest(t, q)
        full = np.round(q @ dense[t], 9)
        want = np.lexsort((np.arange(len(full)), -full))[: toxicity.K]
        want = want[full[want] > 0]
        assert e.tolist() == want.tolist() and np.abs(s - full[want]).max(initial=0) < 1e-6


def test_cosines_are_exact():
    data, labels = corpus(200)
    data += [(1000 + i, *data[i][1:]) for i in range(30)]  # ties: the earlier example goes first
    labels += [(1000 + i, 1 - labels[i][1], 0) for i in range(30)]
    made = [(d[0], t[1], quality_classifier.terms(d[1])) for d, t in zip(data, labels, strict=True)]
    m = quality_classifier.build(made, 0.8)
    assert set(m.vocabulary) == {t for _, _, c in made for t in c}
    x = m.rows([quality_classifier.terms(d[1]) for d in data[:60]])
    got = m.score(x)
    for i in range(60):
        c = np.rint((m.vectors @ x[i]).astype(float) * (1 << 20)) / (1 << 20)
        best = np.argsort(-c, kind="stable")[: quality_classifier.K]
        s = np.clip(c[best], 0, 1) ** quality_classifier.POWER * m.weights[best]
        want = ((s * m.labels[best]).sum() + quality_classifier.PRIOR * 0.8) / (s.sum() + quality_classifier.PRIOR)
        assert abs(got[i] - want) < 2e-3


def test_decomposition_is_that_of_the_whole_matrix():
    """The space is that of the leading singular vectors of the dense matrix."""
    data, labels = corpus(60)
    m = quality_classifier.build([(d[0], t[1], quality_classifier.terms(d[1])) for d, t in zip(data, labels, strict=True)], 0.8)
    x = np.zeros((60, m.examples.width))
    x[np.repeat(np.arange(60), np.diff(m.examples.ptr)), m.examples.terms] = m.examples.weights
    assert np.allclose((x**2).sum(axis=1), 1, atol=1e-5)
    v = np.linalg.svd(x, full_matrices=False)[2][:4].T
    assert np.linalg.norm(m.basis.T @ v, axis=0).min() > 0.98


def test_samples_are_bounded(spark):
    from millrace.llm.labelled import sample

    data, labels = corpus(100)
    docs, table = documents(spark, data), label_table(spark, labels)
    few = sample(docs, table, "toxic", 4, 2, 20, 1 << 20)
    small = sample(docs, table, "toxic", 4, 2, 20, 4000)
    assert 10 < len(few) <= 20 and len(small) < len(few) and set(small) <= set(few)
    for k in (0, 1):
        assert sum(len(t.encode()) for _, y, t in small if y == k) <= 2000
    assert all(zlib.crc32(str(i).encode()) % 4 != 2 for i, _, _ in few)
