"""Token ids equal the library's; the grammar files give them back."""

import functools
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from storepulse.llm import repair, textbytes, tokens
from storepulse.llm.common import BATCH, read_table, small_batches, written
from tests.conftest import SF_SMALL
from tests.llm.helpers import awkward, documents, rows

ODD = ["a\u00a0b c\u2003d", "x\u0085y", "İstanbul ΑΣ ΑΣ. it's don't 's", "e\u0301 \u0301a <|endoftext|> a<|startoftext|>b", "\x1c\x1d a\x1fb", "\u200bzero\ufeff",
       "ﬁ Å \u0308\u0301", "word., word.., .word, ,. 12.5 3rd ÀÉß ªº µ", "", " ", "A.B,C", "<|endoftext|>.", "don't.", "😀. é."]


def library():
    return Tokenizer.from_file(tokens.default_vocabulary())


@functools.cache
def library_once():
    return library()


def test_ids_equal_the_library(spark):
    texts = ODD + [r["text"] for r in rows(read_table(spark, SF_SMALL, "documents"))]
    want = [np.array(e.ids, "<u4").tobytes() for e in library().encode_batch(texts, add_special_tokens=False)]
    coder = tokens.Encoder(tokens.default_vocabulary())
    for _ in range(2):  # unknown words, then remembered ones
        assert list(coder.each(pa.array(texts))) == want


def test_forgetting_keeps_ids_right_and_bytes_bounded(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE", 4000)
    monkeypatch.setattr(tokens, "CHUNK", 30)
    texts = ["one two three four five six seven", "one eight nine ten", "two one eleven, twelve."] * 3 + ["z" * 3000 + " " + "é" * 400] + ODD * 2
    want = [np.array(e.ids, "<u4").tobytes() for e in library().encode_batch(texts, add_special_tokens=False)]
    coder = tokens.Encoder(tokens.default_vocabulary())
    assert list(coder.each(pa.array(texts))) == want
    assert coder.remembered() <= 4000 and len(coder.young) + len(coder.old) > 4
    assert not any(len(k) > tokens.LONGEST for part in (coder.young, coder.old) for k in part)


def test_one_cache_of_bounded_bytes_for_both_kinds():
    assert tokens.encoder(tokens.default_vocabulary()) is tokens.encoder(tokens.default_vocabulary())
    coder = tokens.Encoder(tokens.default_vocabulary())
    words = pa.array([" ".join(f"{a}{b}{c}{d}x" for c in "abcdefghij" for d in "klmnopqrst") for a in "uvwxyz" for b in "abcdefghij"] * 2)
    for plain in (False, True):
        for _ in coder.chunks(words, plain):
            pass
    assert coder.remembered() <= tokens.CACHE


def test_memory_of_long_texts_is_bounded():
    """Arrays in hand, while some megabytes of text are encoded, and after."""
    words = [f"{a}{b}{c}{d}" for a in "stuv" for b in "abcdefghij" for c in "klmnopqrst" for d in "aeiou"]
    texts = pa.array([" ".join(words[k:] + words[:k]) for k in range(1000)])
    assert texts.nbytes > 8 << 20
    coder = tokens.Encoder(tokens.default_vocabulary())
    tracemalloc.start()
    try:
        total = sum(int(counts.sum()) for _, counts in coder.chunks(texts))
        left, peak = tracemalloc.get_traced_memory()
    finally:
        tracemalloc.stop()
    assert total >= 2000 * 1000
    assert peak < 48 << 20 and left < 8 << 20


def test_freed_memory_and_tables_are_given_back():
    textbytes._power_tables(100)
    assert sum(t.nbytes for t in textbytes._powers) > 16 << 20
    textbytes.give_back()
    assert sum(t.nbytes for t in textbytes._powers) < 100
    buf = np.frombuffer(b"one two one", np.uint8)  # made again when asked for
    h = textbytes.span_hashes(buf, np.array([0, 4, 8]), np.array([3, 7, 11]), textbytes.BYTE_VALUE)
    assert h[0] == h[2] != h[1]


def test_texts_go_to_workers_in_small_batches(spark, monkeypatch):
    key, held = "spark.sql.execution.arrow.maxBytesPerBatch", []
    before = spark.conf.get(key)

    def noted(df, name):
        held.append((name, spark.conf.get(key)))
        return written(df, name)

    monkeypatch.setattr(repair, "written", noted)
    assert repair.round_trip(documents(spark, [(1, "a b c")])).count() == 1
    assert ("tokens", str(BATCH)) in held and spark.conf.get(key) == before
    with pytest.raises(KeyError), small_batches(spark, 1000):
        sizes = spark.range(0, 5000, 1, 1).selectExpr("repeat('x', 100) t").mapInArrow(
            lambda it: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"]) for b in it), "n long").collect()
        assert len(sizes) > 100
        raise KeyError
    assert spark.conf.get(key) == before


def test_separator_strings_are_text_where_asked():
    plain, special = library(), library()
    plain.encode_special_tokens = True
    coder = tokens.Encoder(tokens.default_vocabulary())
    texts = ["a <|endoftext|> b<|endoftext|>c", "<|EndOfText|> <|startoftext|>."] * 2
    for _ in range(2):
        for own, flag in ((special, False), (plain, True)):
            want = [np.array(e.ids, "<u4").tobytes() for e in own.encode_batch(texts, add_special_tokens=False)]
            assert list(coder.each(pa.array(texts), flag)) == want


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("aZÉéß×÷ÿÀ.,' \n\t\u0301\u00a0\u0130漢<|>0ªµ"), max_size=12), max_size=6))
def test_any_text_equals_the_library(texts):
    want = [np.array(e.ids, "<u4").tobytes() for e in library_once().encode_batch(texts, add_special_tokens=False)] if texts else []
    assert list(tokens.encoder(tokens.default_vocabulary()).each(pa.array(texts, pa.string()))) == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 6), max_size=400), st.sampled_from([7, 1 << 16]), st.integers(2, 4))
def test_grammar_round_trip(ids, first, fewest):
    ids = np.array(ids, "<u4")
    symbols, rules = repair.compress(ids, first, rounds=6, limit=20, fewest=fewest)
    lengths = repair.rule_lengths(rules, first)
    assert (repair.expand(symbols, rules, lengths, first) == ids).all()
    assert lengths.sum() >= 2 * len(rules) and len(symbols) <= len(ids)
    block = {"symbols": symbols.astype("<u4").tobytes(), "rules": rules.astype("<u4").tobytes(),
             "rule_lengths": lengths.astype("<u4").tobytes(), "first": first, "width": 4}
    for a in range(0, len(ids), 37):
        for b in range(a, len(ids) + 1, 53):
            assert (repair.decode_range(block, a, b) == ids[a:b]).all()


def test_repetition_is_compressed():
    ids = np.tile(np.arange(16, dtype="<u4"), 500)
    symbols, rules = repair.compress(ids, 100)
    assert len(symbols) + 2 * len(rules) < len(ids) / 10
    assert repair.rule_lengths(rules, 100).max() >= 16


def test_grammar_runs_until_no_pair_is_frequent():
    rng = np.random.default_rng(5)
    passage = rng.integers(0, 5000, 120)
    ids = np.concatenate([np.concatenate([rng.integers(0, 5000, 60), passage]) for _ in range(1000)]).astype("<u4")
    symbols, rules = repair.compress(ids, 5000)
    lengths = repair.rule_lengths(rules, 5000)
    assert (repair.expand(symbols, rules, lengths, 5000) == ids).all()
    assert lengths.max() >= 120 and len(symbols) < 62 * 1000
    for k in (np.arange(16) % 2, np.zeros(5000), rng.integers(0, 40, 20_000)):
        symbols, rules = repair.compress(k.astype("<u4"), 100)
        _, count = np.unique(np.stack([symbols[:-1], symbols[1:]], 1), axis=0, return_counts=True)
        assert not len(count) or count.max() < repair.FEWEST


def test_round_trip_of_documents(spark):
    docs = read_table(spark, SF_SMALL, "documents")
    got = {r["doc_id"]: r for r in rows(repair.round_trip(docs, per_shard=13))}
    at = 0
    for r in sorted(rows(docs), key=lambda r: r["doc_id"]):
        ids = np.array(library_once().encode(r["text"], add_special_tokens=False).ids + [2], "<u4")
        g = got[r["doc_id"]]
        assert (g["start"], g["n_tokens"], g["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_blocks_close_inside_a_shard(spark, monkeypatch):
    docs = documents(spark, [f"some words number {k}" for k in range(40)])
    whole = sorted(map(str, rows(repair.round_trip(docs))))
    blocks = repair.encode(docs, per_shard=20)
    assert blocks.count() == 2
    assert sorted(map(str, rows(repair.decode(blocks)))) == whole


def test_awkward_and_empty(spark):
    docs = awkward(spark)
    got = sorted(rows(repair.round_trip(docs, per_shard=2)), key=lambda r: r["start"])
    assert len(got) == docs.count()
    ids = [r["doc_id"] for r in got]
    assert ids[0] is None and ids[1:] == sorted(ids[1:])
    assert [r["start"] for r in got] == [sum(x["n_tokens"] for x in got[:k]) for k in range(len(got))]
    assert {r["n_tokens"] for r in got if r["doc_id"] in (1, 2, 3)} == {1}
    assert rows(repair.round_trip(docs.limit(0))) == []


def test_a_hot_id_has_several_shards(spark):
    docs = documents(spark, [f"text {k}" for k in range(300)], ids=[7 if k % 3 else k for k in range(300)]).repartition(6)
    got = sorted(rows(repair.round_trip(docs, per_shard=20)), key=lambda r: r["start"])
    ids = [r["doc_id"] for r in got]
    assert len(ids) == 300 and ids == sorted(ids)
    assert [r["start"] for r in got] == [sum(x["n_tokens"] for x in got[:k]) for k in range(300)]
    shards = tokens.sharded(docs.select("doc_id", "text"), 20).where("doc_id = 7").select("shard").distinct().count()
    assert shards >= 4


def test_largest_ids_and_fine_ranges(spark, monkeypatch):
    monkeypatch.setattr(tokens, "MOST_CUTS", 3)
    ids = [2**63 - 1, -2**63, 0, None, *range(10, 90)]
    docs = documents(spark, ["a b"] * len(ids), ids=ids)
    got = sorted(rows(repair.round_trip(docs, per_shard=4)), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [None, *sorted(i for i in ids if i is not None)]
