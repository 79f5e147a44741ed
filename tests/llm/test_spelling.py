"""Near words, forms and roots equal a double loop over the vocabulary."""

import itertools
import random
import re
import zlib

import duckdb
import pytest

from storepulse.llm import oracles, spelling
from tests.llm.helpers import awkward, documents, rows

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def brute(records):
    n = {}
    for doc_id, text in records:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 7:
                n[run] = n.get(run, 0) + 1
    n = {w: k for w, k in n.items() if k >= 2}
    near = {w: [] for w in n}
    for a, b in itertools.combinations(n, 2):
        if one_edit(a, b):
            near[a].append(b)
            near[b].append(a)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-n[o], o), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out)


def found(docs, **options):
    return sorted((r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows(spelling.variants(docs, **options)))


def corpus(seed, letters="abéZ", words=500):
    rng = random.Random(seed)
    stems = ["".join(rng.choice(letters) for _ in range(rng.randrange(6, 11))) for _ in range(words)]
    weight = [rng.choice([1, 1, 2, 5, 60]) for _ in stems]
    return [" ".join(rng.choices(stems, weight, k=120)) + rng.choice(["", ".", "9x"]) for _ in range(80)]


@pytest.mark.parametrize("options", [{}, {"symbols": 2, "large": 30}, {"symbols": 3, "large": 0, "bits": 8}])
def test_against_a_double_loop(spark, options):
    texts = corpus(1)
    want = brute(enumerate(texts))
    assert sum(1 for r in want if r[1]) > 20
    assert found(documents(spark, texts), **options) == want


def test_chains_of_forms(spark):
    texts = [" ".join(["abcdefgh"] * 3 + ["abcdefgx"] * 40 + ["abcdefyx"] * 700), "abcdefgz " * 3, "zzzzzzzz zzzzzzzzz"]
    want = brute(enumerate(texts))
    assert found(documents(spark, texts)) == want


def test_awkward(spark):
    docs = awkward(spark)
    long = ["q" * 20_000 + " ", "q" * 20_001 + " ", "q" * 9000 + "z" + "q" * 11_000 + " "]
    more = documents(spark, [x * 2 for x in long] + ["Éclairage éclairage " * 4, "straße× straße÷ " * 3], ids=[20, 21, 22, None, -1])
    both = docs.unionByName(more)
    want = brute((r["doc_id"], r["text"]) for r in rows(both))
    assert found(both) == want and found(both, large=0) == want
    assert found(docs.limit(0)) == [] and found(documents(spark, ["once only words", None, ""])) == []


def test_sql_says_the_same(spark, tmp_path):
    docs = documents(spark, corpus(7, "abcdéÉ", 300))
    docs.select("doc_id", "text").toPandas().to_parquet(tmp_path / "documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    got = sorted(con.execute(f"SELECT word, form, root, n, n_near, form_n FROM ({oracles.SPELLING})").fetchall())
    assert got == found(docs)
