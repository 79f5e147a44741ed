"""Spans against Python's re; the weak supervision behind added spans."""

import hashlib
import random
import re

from storepulse.llm import pii
from storepulse.llm import spans as sp
from storepulse.llm.common import read_table
from tests.conftest import SF_SMALL
from tests.llm.helpers import awkward, documents, rows

def digits(s):
    return re.sub("[^0-9]", "", s)


def luhn(s):
    total = 0
    for k, c in enumerate(reversed(s)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


BASE = [
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
    (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
    (r"[0-9]([\x20-]?[0-9])+", lambda s: 14 <= len(digits(s)) <= 19 and luhn(digits(s))),
    (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 10 <= len(digits(s)) <= 15),
]


def brute(text):
    found = [(m.start(), k, m.end()) for k, (p, ok) in enumerate(BASE) for m in re.finditer(p, text or "") if ok(m.group())]
    return ",".join(f"{pii.BASE[k]}:{a}:{b}" for a, k, b in sorted(found))


def digest(df):
    base = sp.joined(pii.F.col("base"), pii.KINDS)
    return rows(df.select("doc_id", base.alias("base"), pii.F.sha2(base, 256).alias("hash"), sp.joined(pii.F.col("spans"), pii.KINDS).alias("spans")))


def test_strict_spans_match_re(spark):
    rng = random.Random(3)
    pieces = ["a.b@c.de", "a@b.c_x@d.e", "a@b.c-x@y.z", "@", "a@b", ".", "x@y.z.", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "007.000255.1.2",
              "4111 1111 1111 1111", "4111-1111-1111-1111", "4111111111111112", "0" * 16, "12", "+1 (212) 555-0100", "+44 20 7946 0958.", "+1-2",
              "+1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6", "é", "😀", "\n", " ", "  ", "-", "--", "ü@x.de", "0000 0000 0000 00"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 14))) for _ in range(400)]
    texts += [" ".join(rng.choice(pieces) for _ in range(12)) for _ in range(200)]
    texts += [r["text"] for r in rows(read_table(spark, SF_SMALL, "documents"))]
    texts += ["9" * 40_000, "1 " * 20_000, "a" * 50_000 + "@b.c", "a@" * 9_000, "a@b" + ".c" * 9_000, "+1" + " " * 20_000 + "2", "1." * 9_000]
    got = {r["doc_id"]: r for r in digest(pii.detect(documents(spark, texts)))}
    for i, t in enumerate(texts):
        assert got[i]["base"] == brute(t), t[:200]
        assert got[i]["hash"] == hashlib.sha256(brute(t).encode()).hexdigest()
        assert set(got[i]["base"].split(",")) - {""} <= set(got[i]["spans"].split(","))


def test_reliabilities_are_recovered():
    rng = random.Random(8)
    counts = {}
    for _ in range(20_000):
        truth = rng.random() < 0.4
        votes = tuple(-1 if rng.random() < 0.2 else int((rng.random() < acc) == truth) for acc in (0.95, 0.8, 0.65))
        counts[votes] = counts.get(votes, 0) + 1
    after, right, prior = pii.reliabilities(counts)
    assert abs(prior - 0.4) < 0.05
    assert right[0][0] > right[1][0] > right[2][0] and abs(right[0][0] - 0.95) < 0.05
    assert after[1, 1, 1] > 0.95 and after[0, 0, 0] < 0.05


def test_added_spans(spark):
    yes = [f"please call my phone {200 + k % 700}-{200 + k}-{1000 + k} today" for k in range(120)]
    no = [f"see order ref {1000 + k} {1234 + k} {5000 + k} {1111 + k}1" for k in range(120)]
    got = {r["doc_id"]: r["spans"] for r in digest(pii.detect(documents(spark, yes + no)))}
    assert sum("telephone" in got[k] for k in range(120)) > 100
    assert sum("account" in got[k] for k in range(120, 240)) < 20
    clean = pii.detect(documents(spark, ["nothing personal here, 12 of 40", ""]))
    assert {r["spans"] for r in digest(clean)} == {""}


def test_awkward_and_empty(spark):
    docs = awkward(spark)
    got = digest(pii.detect(docs))
    assert len(got) == docs.count() and all(r["base"] == brute(t["text"]) for r, t in zip(
        sorted(got, key=lambda r: (r["doc_id"] is None, r["doc_id"])), sorted(rows(docs), key=lambda r: (r["doc_id"] is None, r["doc_id"])), strict=True))
    assert digest(pii.detect(docs.limit(0))) == []
