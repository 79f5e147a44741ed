"""Small fixtures for the corpus operators."""

from __future__ import annotations

import random

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, size long, score double, base string, "
          "spans string, component string, doc string, kept boolean, target string, shard string")
EXTRA = (7, 0.5, "b", "s", "c", "d", True, "t", "x")  # columns whose names the operators use themselves


def documents(spark, texts, ids=None, sources=None, langs=None):
    ids = range(len(texts)) if ids is None else ids
    rows = [(i, t, (langs or ["en"] * len(texts))[k], (sources or ["s"] * len(texts))[k], None if t is None else len(t), *EXTRA)
            for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
    return spark.createDataFrame(rows, SCHEMA)


def prose(n: int, seed: int, words: int = 4000) -> list[str]:
    rng = random.Random(seed)
    return [f"w{rng.randrange(words)}" for _ in range(n)]


def awkward(spark):
    """Null and empty texts, white space only, repeated rows, a null id, a
    null source and language, and a very long text."""
    long = " ".join(prose(60_000, 3))
    same = " ".join(prose(40, 4))
    return documents(
        spark, [None, "", " \n\t ", same, same, same, "one", long, "x" * 30_000, "9" * 30_000, "a.b@" * 5_000, None],
        ids=[1, 2, 3, 4, 4, 5, 6, 7, 8, 9, 10, None],
        sources=["a", "a", None, "b", "b", "b", None, "a", "a", "b", "a", "b"],
        langs=["en", None, "en", "en", "en", "de", "en", "en", None, "en", "en", "en"])


def rows(df) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]
