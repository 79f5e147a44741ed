"""Cuts equal plain string slicing; the index gives every boundary exactly."""

import hashlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from storepulse.llm import fim
from storepulse.llm.common import read_table
from tests.conftest import SF_SMALL
from tests.llm.helpers import awkward, documents, rows


def plainly(doc_id, text):
    """(n, form, prefix, middle, output) by the definition, on code points."""
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[k:k + 8], 16) for k in range(0, 32, 8)]
    n = len(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    p, m, s = text[:a], text[a:b], text[b:]
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


def check(docs):
    want = sorted(((r["doc_id"], *plainly(r["doc_id"], r["text"]), r["text"] or "") for r in rows(docs)), key=str)
    made = fim.transform(docs).withColumn("again", fim.restored(F.col("form"), F.col("output")))
    got = sorted(((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"], r["again"]) for r in rows(made)), key=str)
    assert got == want


def test_documents(spark):
    check(read_table(spark, SF_SMALL, "documents"))


def test_awkward(spark):
    check(awkward(spark))
    assert rows(fim.transform(awkward(spark).limit(0))) == []


def test_wide_characters_and_markers(spark):
    texts = ["é" * 9000 + "abc" * 4000 + "漢字" * 3000, "😀é漢a" * 700, "<P> in it", "ends with <", "<<S", "P>x<M", "M><P", "<S", "́e", "a\x00b"]
    texts += [f"<{k}é漢<P" for k in range(60)]
    check(documents(spark, texts, ids=[2**63 - 1, -5, *range(len(texts) - 2)]))


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=3000), st.integers(0, 5), st.integers(3, 60))
def test_every_boundary(widths, repeat, error):
    offsets = np.concatenate(([0], np.cumsum(np.array(widths * repeat, np.int64)))).astype(np.int64)
    model = fim.fit(offsets, error)
    assert (model.locate(np.arange(len(offsets))) == offsets).all()
    assert abs(offsets - model.predict(np.arange(len(offsets)))).max() <= error + 1


def test_few_segments_and_stored_index(spark):
    rng = np.random.default_rng(3)
    offsets = np.concatenate(([0], np.cumsum(rng.choice([1, 1, 1, 2], 200_000))))
    assert len(fim.fit(offsets).ranks) < 40
    text = "aé漢😀" * 500
    one = rows(fim.index(documents(spark, [text, "abc", None])))
    by_id = {r["doc_id"]: r for r in one}
    r = by_id[0]
    model = fim.Index(*(np.array(r[c], np.int64) for c in ("ranks", "offsets", "slopes")), np.frombuffer(r["residuals"], np.int8))
    at = model.locate(np.arange(r["n"] + 1))
    assert r["n"] == 2000 and at.tolist() == [len(text[:k].encode()) for k in range(2001)]
    assert by_id[1]["n"] == 3 and by_id[1]["residuals"] == b"" and by_id[2]["n"] == 0


def test_lines(spark):
    made = rows(fim.transform(documents(spark, ["a\nbc\n\ndé"] * 40, ids=range(40)), unit="line"))
    assert {r["n"] for r in made} == {4}
    for r in made:
        if r["form"] == "psm":
            assert r["output"].startswith("<P>" + "".join(["a\n", "bc\n", "\n", "dé"][:r["prefix_chars"]]) + "<S>")
