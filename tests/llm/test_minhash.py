"""Near-duplicates against brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest

from storepulse.llm import minhash
from tests.llm.helpers import awkward, documents, prose, rows

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(texts: dict, size: int, percent: int) -> dict:
    sets = {}
    for i, t in texts.items():
        w = (t or "").translate(FOLD).split()
        sets[i] = {tuple(w[k:k + size]) for k in range(len(w) - size + 1)} or ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    order = sorted(sets)
    for k, a in enumerate(order):
        for b in order[:k]:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                up[y] = x
    return {i: (len(sets[i]), top(i)) for i in sets}


def family(rng, n, size, edits, base=None):
    """Variants of one text with up to ``edits`` replaced words."""
    base = base or prose(size, rng.randrange(10 ** 6))
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(edits + 1)):
            w[rng.randrange(len(w))] = f"v{rng.randrange(10 ** 9)}"
        out.append(" ".join(w))
    return out


def test_components_match_brute_force(spark):
    rng = random.Random(5)
    texts = []
    for size, edits in ((120, 9), (60, 5), (200, 14), (12, 1)):
        texts += family(rng, 25, size, edits)
    # a chain: each step is close to the one before, its ends are far apart
    words = prose(150, 77)
    for k in range(12):
        words = words[4:] + prose(4, 1000 + k)
        texts.append(" ".join(words))
    # a shared passage in otherwise different short texts
    passage = prose(30, 9)
    texts += [" ".join(passage + prose(6, 2000 + k)) for k in range(25)]
    texts += [texts[0].upper(), texts[1], "", "a b", "A b", "c", "d e f", None]
    rng.shuffle(texts)
    got = {r["doc_id"]: r for r in rows(minhash.near_duplicates(documents(spark, texts), shingle=3, percent=85))}
    want = brute(dict(enumerate(texts)), 3, 85)
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == want
    assert all(r["kept"] == (i == r["component_id"]) for i, r in got.items())


def test_awkward_rows(spark):
    docs = awkward(spark)
    got = rows(minhash.near_duplicates(docs))
    assert len(got) == docs.count()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append((r["n_shingles"], r["component_id"], r["kept"]))
    assert by[None] == [(0, None, True)] and by[1] == [(0, 1, True)]
    assert by[4] == [(36, 4, True)] * 2 and by[5] == [(36, 4, False)]
    kept = minhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] or 0 for r in rows(kept)) == [0, 1, 2, 3, 4, 6, 7, 8, 9, 10]


def test_empty_table(spark):
    docs = documents(spark, ["x"]).limit(0)
    assert rows(minhash.near_duplicates(docs)) == []
    assert rows(minhash.keep_one(docs)) == []


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    order = minhash.densify_order(120)
    for n in (5, 30, 1000):
        same = []
        for _ in range(40):
            a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
            b = a.copy()
            b[: n // 5] = rng.integers(0, 1 << 63, n // 5, dtype=np.uint64)
            b = np.unique(b)
            same.append((minhash.signature(a, 120, order) == minhash.signature(b, 120, order)).mean())
        shared = n - n // 5
        assert np.mean(same) == pytest.approx(shared / (2 * n - shared), abs=0.08)


def test_shingles_do_not_depend_on_chunks(monkeypatch):
    texts = pa.array([" ".join(prose(50, s)) for s in range(30)] + [None, ""])
    whole = [s.tobytes() for _, s in minhash.shingle_sets(texts, 3)]
    for slice_ in (texts.slice(3, 9),):
        assert [s.tobytes() for _, s in minhash.shingle_sets(slice_, 3)] == whole[3:12]
    monkeypatch.setattr(minhash.tb.chunks, "__defaults__", (64,))
    assert [s.tobytes() for _, s in minhash.shingle_sets(texts, 3)] == whole
