"""Registration, and the pipeline stage by stage."""

import zlib

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from oracles.compare import compare, duck
from storepulse.llm import mixing, tokens
from storepulse.llm.common import read_table
from storepulse.llm.queries import ORACLES, QUERIES
from tests.conftest import SF_SMALL
from tests.llm.helpers import awkward, prose, rows


def test_registered():
    names = set(queries())
    assert set(QUERIES) | {"pipeline"} <= names and set(ORACLES) <= set(oracle_sql())
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES) == list(range(1, 14))


def test_run_chains_all_stages(spark):
    """What is left of the documents after four stages is tokenised whole, at
    most twice each, in ascending doc_id order, without gaps."""
    docs = {r["doc_id"]: r["text"] for r in rows(read_table(spark, SF_SMALL, "documents"))}
    out = sorted(rows(corpus_pipeline.run(spark, SF_SMALL)), key=lambda r: r["start"])
    ids = [r["doc_id"] for r in out]
    assert ids == sorted(ids) and 0 < len(set(ids)) < len(docs) and set(ids) <= set(docs)
    assert max(ids.count(i) for i in set(ids)) <= 2
    library = Tokenizer.from_file(tokens.default_vocabulary())
    at = 0
    for r in out:
        want = np.array(library.encode(docs[r["doc_id"]], add_special_tokens=False).ids + [2], "<u4")
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(want), zlib.crc32(want.tobytes()))
        at += len(want)


def test_minhash_query_matches_its_sql(spark):
    assert not compare(QUERIES["op2_minhash"](spark, SF_SMALL), duck(SF_SMALL), ORACLES["op2_minhash"])


def test_stages_on_planted_documents(spark, tmp_path):
    docs = read_table(spark, SF_SMALL, "documents")
    bench = " ".join(prose(30, 900))
    copy = " ".join(prose(60, 901))
    planted = spark.createDataFrame(
        [(10_001, copy, "en", "src1", 1), (10_002, copy + " end", "en", "src2", 1), (10_003, f"intro words\n{bench} outro", "en", "src1", 1),
         (10_004, " ".join(prose(50, 902)), "en", None, 1)], docs.schema)
    folder = str(tmp_path)
    for name in ("labels",):
        read_table(spark, SF_SMALL, name).write.parquet(f"{folder}/{name}.parquet")
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    now = docs.union(planted)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before, columns = {r["doc_id"] for r in rows(now)}, now.columns
        stage(spark, now, folder).write.parquet(f"{folder}/{k}")
        after = spark.read.parquet(f"{folder}/{k}")
        ids = {r["doc_id"] for r in rows(after)}
        if name != "token_ids":
            assert after.columns == columns and ids <= before
        gone = before - ids
        if name == "near_dedup":
            assert 10_002 in gone and 10_001 in ids and 10_003 in ids and 10_004 in ids
        elif name == "decontamination":
            assert gone == {10_003}
        elif name == "mixing":
            sizes = {}
            for r in rows(now.withColumn("w", mixing.word_count(now["text"]))):
                sizes[r["doc_id"]] = r["w"]
            words = sum(sizes[r["doc_id"]] for r in rows(after))
            assert abs(words / (1.5 * sum(sizes.values())) - 1) < 0.02
        elif name == "token_ids":
            assert after.count() == now.count()
        now = after


def test_stages_take_awkward_and_empty_documents(spark):
    docs = awkward(spark)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF_SMALL).count() > 0
        assert stage(spark, docs.limit(0), SF_SMALL).count() == 0
