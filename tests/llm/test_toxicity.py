"""The factorization machine: pairs, held-out accuracy, awkward rows."""

import random
import zlib

import numpy as np

from storepulse.llm import toxicity
from storepulse.llm.common import read_table
from tests.conftest import SF_SMALL
from tests.llm.helpers import awkward, documents, prose, rows

SF = SF_SMALL.replace("0.001", "0.01")


def labels(spark, toxic):
    return spark.createDataFrame([(i, 1, t) for i, t in toxic], "doc_id long, quality int, toxic int")


def test_pairs_that_single_weights_miss():
    """Toxic only where both words meet: each word alone is as frequent in
    clean rows."""
    rng = np.random.default_rng(0)
    bags, y = [], []
    for _ in range(3000):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        bags.append(np.array(sorted({1 + k for k, on in ((0, a), (1, b)) if on} | {10 + int(rng.integers(50))})))
        y.append(a and b)
    y = np.array(y)
    model = toxicity.fit(bags, y, epochs=400)

    def score(*terms):
        k = np.searchsorted(model.buckets, terms)
        v = model.factors[k]
        raw = model.bias + model.weights[k].sum() + 0.5 * ((v.sum(0) ** 2) - (v ** 2).sum(0)).sum()
        return 1 / (1 + np.exp(-raw))

    assert score(1, 2) > 0.7 and score(1) < 0.5 and score(2) < 0.5
    assert np.abs(model.factors[np.searchsorted(model.buckets, [1, 2])]).max() > 0.1


def test_held_out_accuracy(spark):
    docs = read_table(spark, SF, "documents")
    label = read_table(spark, SF, "labels")
    model = toxicity.train(docs, label)
    out = {r["doc_id"]: r["score"] for r in rows(toxicity.score(docs.select("doc_id", "text"), model))}
    assert all(0 <= s <= 1 for s in out.values())
    held = [r for r in rows(label) if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    clean = [out[r["doc_id"]] for r in held if r["toxic"] == 0]
    toxic = [out[r["doc_id"]] for r in held if r["toxic"] == 1]
    assert np.mean(np.array(clean) < 0.7) > 0.97
    assert np.mean([t > c for t in toxic for c in clean]) > 0.7  # area under the curve, with a few dozen examples to learn from


def test_held_out_labels_are_not_learned(spark):
    """Changing the labels of held-out rows changes nothing."""
    rng = random.Random(1)
    texts = [" ".join(prose(20, s) + (["scum"] if s % 3 == 0 else [])) for s in range(200)]
    docs = documents(spark, texts)
    true = [(i, int(i % 3 == 0)) for i in range(200)]
    noisy = [(i, rng.randrange(2) if zlib.crc32(str(i).encode()) % 3 == 1 else t) for i, t in true]
    a = toxicity.train(docs, labels(spark, true))
    b = toxicity.train(docs, labels(spark, noisy))
    assert a.bias == b.bias and (a.weights == b.weights).all()


def test_awkward_and_empty(spark):
    docs = awkward(spark)
    texts = documents(spark, [f"{'awful' if s % 2 else 'fine'} word{s}" for s in range(60)])
    model = toxicity.train(texts, labels(spark, [(s, s % 2) for s in range(60)] + [(3, None), (4, 0)]))
    out = toxicity.score(docs, model)
    assert out.columns[:-1] == [c for c in docs.columns if c != "score"] and out.columns[-1] == "score"
    got = rows(out)
    assert len(got) == docs.count() and len({r["score"] for r in got if not (r["text"] or "").strip()}) == 1
    assert toxicity.train(docs, labels(spark, [(1, 0)])) is None
    assert {r["score"] for r in rows(toxicity.score(docs, None))} == {0.0}
    assert toxicity.score(docs.limit(0), model).count() == 0
    assert toxicity.train(docs.limit(0), labels(spark, [(1, 1)]).limit(0)) is None
