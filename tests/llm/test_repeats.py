"""Suffix arrays, pieces and removed bytes against plain definitions."""

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from storepulse.llm import induced, repeats
from storepulse.llm.common import read_table
from tests.conftest import SF_SMALL
from tests.llm.helpers import awkward, documents, rows


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=120), st.integers(1, 4))
def test_suffix_array(symbols, repeat):
    s = np.array(symbols * repeat, np.uint8)
    raw, n = s.tobytes(), len(s)
    order = induced.suffix_array(s, 256)
    assert order.tolist() == sorted(range(n), key=lambda i: raw[i:])
    prefix = induced.common_prefixes(s, order)
    for r in range(n):
        i, j, k = order[r], order[r - 1] if r else n, 0
        while i + k < n and j + k < n and raw[i + k] == raw[j + k]:
            k += 1
        assert prefix[i] == k


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2), min_size=1, max_size=300), st.lists(st.integers(0, 299), max_size=4), st.sampled_from([(12, 5), (12, 12), (7, 2)]))
def test_pieces_hold_every_window_once(symbols, cuts, sizes):
    length, gram = sizes
    buf = np.array(symbols, np.uint8)
    ends = np.array(sorted({c for c in cuts if 0 < c < len(buf)} | {len(buf)}))
    start, n, key, loops = repeats.pieces_of(buf, ends, length, gram)
    windows = sorted(w for a, k in zip(start.tolist(), n.tolist(), strict=True) for w in range(a, a + k))
    begin = 0
    want = []
    for e in ends.tolist():
        want += range(begin, e - length + 1)
        begin = e
    assert windows == want
    of_bytes = {}
    for a, k, key_, loop in zip(start.tolist(), n.tolist(), key.tolist(), loops.tolist(), strict=True):
        assert k <= length - gram + 1
        assert loop or len({buf[w:w + length].tobytes() for w in range(a, a + k)}) == k
        for w in range(a, a + k):
            assert of_bytes.setdefault(buf[w:w + length].tobytes(), key_) == key_


def brute(records, length):
    """(doc_id, n_bytes, spans, digest of what is left)."""
    raw = [(i, (t or "").encode()) for i, t in records]
    seen = {}
    for _, b in raw:
        for w in range(len(b) - length + 1):
            seen[b[w:w + length]] = seen.get(b[w:w + length], 0) + 1
    out = []
    for i, b in raw:
        gone = np.zeros(len(b) + 1, np.int64)
        for w in range(len(b) - length + 1):
            if seen[b[w:w + length]] > 1:
                gone[w] += 1
                gone[w + length] -= 1
        mark = np.concatenate(([False], np.cumsum(gone[:-1]) > 0, [False]))
        edge = np.flatnonzero(mark[1:] != mark[:-1]).tolist()
        spans = list(zip(edge[::2], edge[1::2], strict=True))
        kept = bytes(np.frombuffer(b, np.uint8)[~mark[1:-1]])
        out.append((i, len(b), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def found(docs, **options):
    return sorted(((r["doc_id"], r["n_bytes"], [(s["start"], s["end"]) for s in r["spans"]], r["kept_sha256"])
                   for r in rows(repeats.removed(docs, **options))), key=str)


def test_documents(spark):
    docs = read_table(spark, SF_SMALL, "documents")
    want = brute([(r["doc_id"], r["text"]) for r in rows(docs)], 400)
    assert sum(1 for r in want if r[2]) > 20
    assert found(docs) == want


def passages(seed):
    """Texts that share lines, long passages and whole texts, with repeats
    inside one text."""
    rng = random.Random(seed)
    word = lambda n: " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 6))) for _ in range(n))
    line, passage, other = word(8), word(40), word(90)
    texts = [word(30) + line + word(30) for _ in range(25)]
    texts += [word(rng.randrange(40)) + passage + word(rng.randrange(40)) for _ in range(15)]
    texts += [word(10) + other[rng.randrange(80):] + line for _ in range(10)]
    texts += [other, other, passage + passage, passage + word(30) + other + word(9), "ab" * 200, "x" * 500, "", None, other]
    return texts


@pytest.mark.parametrize("options", [
    {"length": 60, "grams": (20, 40, 50)}, {"length": 60, "grams": (10,), "crowd": 3}, {"length": 60, "grams": (15, 30, 50), "crowd": 2},
    {"length": 60, "grams": (), "crowd": 1}])
def test_shared_passages(spark, options):
    texts = passages(3)
    want = brute(enumerate(texts), 60)
    assert any(len(r[2]) > 1 for r in want) and any(not r[2] for r in want)
    assert found(documents(spark, texts), **options) == want


def test_small_shards_and_sections(spark, monkeypatch):
    texts = passages(5) + [" ".join(passages(6)[:40])]
    docs = documents(spark, texts)
    monkeypatch.setattr(repeats, "SECTION", 150)
    monkeypatch.setattr(repeats, "SHARD", 500)
    monkeypatch.setattr(repeats.tb, "CHUNK", 700)
    assert found(docs, length=60, grams=(20,)) == brute(enumerate(texts), 60)


def test_awkward(spark):
    docs = awkward(spark)
    assert found(docs) == brute([(r["doc_id"], r["text"]) for r in rows(docs)], 400)
    assert found(docs.limit(0)) == []
    left = rows(repeats.without_repeats(docs))
    assert len(left) == docs.count() and set(left[0]) == set(docs.columns)
    assert {hashlib.sha256(r["kept"]).hexdigest() for r in left} == {r[3] for r in found(docs)}


def test_frequent_keys_are_joined_where_they_lie(spark):
    left = spark.range(25_000).selectExpr("if(id < 20000, 0, id) AS k", "id")
    table = left.groupBy("k").agg({"id": "count"}).withColumnRenamed("count(id)", "n").where("k % 2 = 0")
    for how, size in (("inner", 22_500), ("left", 25_000)):
        got = repeats.spread_join(left, table, ["k"], "n", how)
        assert got.count() == size and got.where("k = 0 AND n = 20000").count() == 20_000
