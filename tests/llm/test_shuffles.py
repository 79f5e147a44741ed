"""Whole texts are shuffled no more often than a step needs, also where the
other side of a join is too large to be broadcast."""

import pytest
from pyspark.sql import functions as F

from storepulse.llm import minhash, mixing
from tests.llm.helpers import documents, prose, rows

SETTINGS = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}


@pytest.fixture
def large(spark):
    """Plans as over large tables."""
    before = {k: spark.conf.get(k) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def texts_shuffled(df, names=("text", "row_")) -> tuple[list, int]:
    """The rows of df, and how many rows with a text went through a shuffle."""
    got, total, nodes = rows(df), 0, [df._jdf.queryExecution().executedPlan()]
    for node in nodes:
        children, output = node.children(), node.output()
        nodes += [children.apply(i) for i in range(children.size())]
        if node.nodeName() == "Exchange" and any(output.apply(i).name() in names for i in range(output.size())):
            total += node.metrics().apply("shuffleRecordsWritten").value()
    return got, total


def test_mixing_shuffles_a_text_once(spark, large):
    n = 300
    docs = documents(spark, [" ".join(prose(5 + k % 40, k)) for k in range(n)], sources=[["a", None, "b"][k % 3] for k in range(n)])
    got, shuffled = texts_shuffled(mixing.mix(docs.withColumn("size", mixing.word_count(F.col("text")))))
    assert len(got) == n and {r["source"] for r in got} == {"a", None, "b"}
    assert shuffled == n
    got, shuffled = texts_shuffled(mixing.mixed_documents(docs))
    assert len(got) > n and shuffled == n


def test_texts_of_few_documents_shuffle_these_alone(spark, large):
    n = 200
    docs = documents(spark, [" ".join(prose(9, k)) for k in range(n)] + [None, "again"], ids=[*range(n), None, 7])
    got, shuffled = texts_shuffled(minhash.texts_of(docs, spark.createDataFrame([(7,), (8,), (5000,)], "id long")))
    assert sorted(r["doc_id"] for r in got) == [7, 7, 8] and shuffled < 10


def test_near_dedup_shuffles_the_texts_that_go(spark, large):
    n, copies = 200, 20
    texts = [" ".join(prose(60, k)) for k in range(n)]
    docs = documents(spark, texts + texts[:copies] + [None, "", texts[0]], ids=[*range(n + copies), 900, 901, None])
    got, shuffled = texts_shuffled(minhash.keep_one(docs))
    assert {r["doc_id"] for r in got} == {*range(n), 900, 901, None} and len(got) == n + 3
    assert copies <= shuffled < 2 * copies
