"""Base measures against plain Python; thresholds and their bounds."""

import math
import re

import pytest

from storepulse.llm import quality
from storepulse.llm.common import read_table
from tests.conftest import SF_SMALL
from tests.llm.helpers import awkward, documents, prose, rows


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    at = {}
    for k in range(len(words) - 7):
        at.setdefault(tuple(words[k:k + 8]), []).append(k)
    covered = {j for ks in at.values() if len(ks) > 1 for k in ks for j in range(k, k + 8)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered))


COLS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def test_measures_match_plain_python(spark):
    texts = [r["text"] for r in rows(read_table(spark, SF_SMALL, "documents"))]
    texts += ["a\n\na\n \n a\na", "é|ü #  x", "w " * 9, "w " * 7, "\x0ba\x1cb", "x y z x y z", "\n\n", "a b c d e f g h a b c d e f g h"]
    got = sorted(rows(quality.measures(documents(spark, texts))), key=lambda r: r["doc_id"])
    assert [tuple(r[c] for c in COLS) for r in got] == [brute(t) for t in texts]


def test_binomial_tail_is_exact():
    for n, p in ((10, 0.3), (200, 0.01), (5000, 0.008)):
        for k in range(0, int(n * p) + 1):
            exact = sum(math.comb(n, i) * p ** i * (1 - p) ** (n - i) for i in range(k + 1))
            assert quality.binomial_tail(k, n, p) == pytest.approx(exact, rel=1e-9)


def test_cutoffs_respect_the_risk(spark):
    """Half of the good 'de' documents use symbols: the rule must stay off
    there, and is on for 'en', where only bad documents do."""
    texts, langs, good = [], [], []
    for k in range(3000):
        words = prose(25, k)
        lang, ok = ("de", "en")[k % 2], k % 4 < 3
        symbols = not ok or (lang == "de" and k % 3 == 0)
        texts.append(" ".join(w + "###" if symbols else w for w in words))
        langs.append(lang)
        good.append(ok)
    docs = documents(spark, texts, langs=langs)
    label = spark.createDataFrame([(k, int(g), 0) for k, g in enumerate(good)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in rows(quality.judge(docs, label, risk=0.06))}
    english = [k for k in range(3000) if langs[k] == "en"]
    assert all(got[k]["kept"] == good[k] for k in english)
    assert all(got[k]["kept"] for k in range(3000) if langs[k] == "de" and good[k])
    # too few labels to show anything: no rule
    few = quality.judge(docs, label.limit(40), risk=0.06)
    assert few.where("NOT kept").count() == 0


def test_awkward_and_empty(spark):
    docs = awkward(spark)
    label = spark.createDataFrame([(1, None, None), (4, 1, 0), (4, 0, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = rows(quality.judge(docs, label))
    assert len(got) == docs.count()
    by = {r["doc_id"]: r for r in got}
    assert by[1]["base_failed"] and not by[1]["kept"] and by[1]["n_words"] == 0
    assert by[7]["n_words"] == 60_000 and by[7]["kept"] and by[8]["n_words"] == 1
    assert rows(quality.judge(docs.limit(0), label.limit(0))) == []
