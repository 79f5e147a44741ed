"""Entropy-balanced mixing against plain water-filling, and rounding."""

import random

import pytest
from pyspark.sql import functions as F

from storepulse.llm import mixing
from tests.llm.helpers import awkward, documents, rows


def filled(sizes: dict) -> dict:
    """Targets by sharing again and again what capped sources leave."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    out, free, left = {}, set(order), 1.5 * sum(sizes.values())
    while free:
        share = left / sum(weight[s] for s in free)
        full = {s for s in free if weight[s] * share >= 2 * sizes[s]}
        if not full:
            return out | {s: weight[s] * share for s in free}
        for s in full:
            out[s] = 2 * sizes[s]
            left -= out[s]
        free -= full
    return out


def case(spark, counts, seed):
    rng = random.Random(seed)
    texts, sources = [], []
    for source, n in counts.items():
        for _ in range(n):
            texts.append("w " * int(rng.paretovariate(1.2) * 5))
            sources.append(source)
    return documents(spark, texts, sources=sources).drop("size", "target").withColumn("size", mixing.word_count(F.col("text")))


@pytest.mark.parametrize("seed", [1, 2])
def test_targets_and_copies(spark, seed):
    docs = case(spark, {"a": 700, "b": 60, "c": 300, None: 40, "z": 5, "é": 150, "only": 1}, seed)
    got = rows(mixing.mix(docs))
    assert len(got) == docs.count()
    sizes: dict = {}
    for r in got:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
    want = filled(sizes)
    taken: dict = {}
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        assert r["copies"] in (0, 1, 2) and r["taken"] == r["copies"] * r["size"] <= 2 * r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    for s, t in taken.items():
        smallest = min(r["size"] for r in got if r["source"] == s and r["size"])
        assert abs(t - want[s]) <= max(smallest, 0.01 * want[s]) + 1 or len([r for r in got if r["source"] == s]) < 10
    again = mixing.mix(docs.repartition(7))
    key = lambda r: (r["doc_id"], r["taken"])
    assert sorted(map(key, rows(again))) == sorted(map(key, got))


def test_rates_are_the_exponential_tilt(spark):
    cells = spark.createDataFrame([("a", 10, 4), ("a", 5, 2), ("b", 100, 1)], "s string, size long, n long")
    wanted = spark.createDataFrame([("a", 50, 5.0), ("b", 100, 200.0)], "source string, source_size long, target double")
    got = {r["source"]: r["rate"] for r in rows(mixing.balance(cells, wanted))}
    assert got["a"] == pytest.approx(0.1) and got["b"] == pytest.approx(2.0)


def test_one_hot_cell_is_spread(spark):
    """A third of the rows are one text: their copies differ by one at most."""
    texts = ["same words here"] * 600 + ["w " * (k % 90 + 1) for k in range(1200)]
    docs = documents(spark, texts, sources=["hot"] * 900 + ["b"] * 500 + ["c"] * 400).drop("size", "target")
    got = rows(mixing.mix(docs.withColumn("size", mixing.word_count(F.col("text")))))
    copies = {r["copies"] for r in got if r["text"] == "same words here"}
    assert len(copies) <= 2 and max(copies) - min(copies) <= 1


def test_awkward_and_empty(spark):
    docs = awkward(spark)
    out = mixing.mixed_documents(docs)
    assert out.columns == [*[c for c in docs.columns if c not in ("size", "target")]] or out.columns == docs.columns
    assert out.count() > 0
    sized = docs.drop("size").withColumn("size", mixing.word_count(F.col("text")))
    got = rows(mixing.mix(sized))
    assert len(got) == docs.count() and all(r["taken"] <= 2 * r["size"] for r in got)
    assert {r["size"] for r in got if r["text"] is None} == {0}
    assert rows(mixing.mix(sized.limit(0))) == [] and rows(mixing.mixed_documents(docs.limit(0))) == []
    blank = documents(spark, ["", None]).drop("size").withColumn("size", F.lit(0).cast("long"))
    assert [r["taken"] for r in rows(mixing.mix(blank))] == [0, 0]
