"""Separator scan over flat blocks and raw files."""

import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from storepulse.llm import sepscan, tokens
from storepulse.llm.common import read_table, shared_folder
from tests.conftest import SF_SMALL
from tests.llm.helpers import awkward, rows


def brute(files, end):
    """position, start, n_tokens, closed over the joined files."""
    out, start = [], 0
    flat = [i for f in files for i in f]
    for k, i in enumerate(flat):
        if i == end:
            out.append((len(out), start, k - start + 1, True))
            start = k + 1
    return out + ([(len(out), start, len(flat) - start, False)] if start < len(flat) else [])


@pytest.mark.parametrize("size", [1, 3, 64, 1000])
def test_blocks_against_a_plain_scan(spark, size):
    """Documents straddle blocks and files; a file may have no separator."""
    rng = random.Random(size)
    files = [[rng.choice([0, 1, 2, 9, 9]) for _ in range(n)] for n in (50, 1, 130)] + [[1] * 70, [9] * 5, [3, 9, 4]]
    blocks = [(f, b, bytearray(np.array(ids[k:k + size], "<u2").tobytes()), 2)
              for f, ids in enumerate(files) for b, k in enumerate(range(0, len(ids), size))]
    df = spark.createDataFrame(blocks, "file long, block long, ids binary, width int").repartition(5)
    got = sorted((r["position"], r["start"], r["n_tokens"], r["closed"]) for r in rows(sepscan.scan(df, end=9)))
    assert got == brute(files, 9)


def test_raw_files(spark, tmp_path):
    rng = random.Random(4)
    files = [[rng.randrange(5) for _ in range(n)] for n in (40, 7, 90)]
    for k, ids in enumerate(files):
        (tmp_path / f"tokens-{k}.bin").write_bytes(np.array(ids, "<u4").tobytes())
    (tmp_path / "tokens-9.bin").write_bytes(b"")
    blocks = sepscan.file_blocks(spark, str(tmp_path), width=4, block_ids=16)
    got = sorted((r["position"], r["start"], r["n_tokens"], r["closed"]) for r in rows(sepscan.scan(blocks, end=3)))
    assert got == brute(files, 3)


def test_counts_of_documents(spark):
    docs = read_table(spark, SF_SMALL, "documents").repartition(3)
    got = {r["doc_id"]: r for r in rows(sepscan.count_documents(docs, block_ids=500))}
    coder = Tokenizer.from_file(tokens.default_vocabulary())
    coder.encode_special_tokens = True
    for r in rows(docs):
        assert got[r["doc_id"]]["n_tokens"] == len(coder.encode(r["text"], add_special_tokens=False).ids) + 1
    spans = sorted((r["start"], r["n_tokens"], r["position"]) for r in got.values())
    assert [s[0] for s in spans] == [sum(x[1] for x in spans[:k]) for k in range(len(spans))]
    assert [s[2] for s in spans] == list(range(len(spans)))


def test_awkward_and_empty(spark):
    docs = awkward(spark)
    got = rows(sepscan.count_documents(docs))
    assert len(got) == docs.count() and sum(r["doc_id"] is None for r in got) == 1
    assert {r["n_tokens"] for r in got if r["doc_id"] in (1, 2, 3)} == {1}
    assert rows(sepscan.count_documents(docs.limit(0))) == []
    assert shared_folder(spark)
