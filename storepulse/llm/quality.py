"""Quality rules with risk-controlled thresholds (operator 4).

Base measures of every whole text (words, symbols, repeated lines, repeated
windows of words) are taken in one pass.  Each rule rejects documents whose
measure exceeds a cutoff.  Its cutoff is selected per stratum (language) from
a fixed list: the sharpest one whose share of false rejections among the
labelled good documents is at most ``risk / rules``, shown by the exact
binomial test.  All cutoffs of all rules in all strata are tested, so each test
is held to ``delta / number of tests`` (Bonferroni): with probability 1 - delta
no stratum loses more than ``risk`` of its good documents to the rules.
Without enough labels a rule stays off.

A null text has no words and fails the base rule; a null language is a
stratum of its own; null labels are ignored, of repeated labels the lowest
quality counts; repeated rows are each judged; extra columns are not used.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storepulse.llm import textbytes as tb
from storepulse.llm.common import written

WINDOW = 8
SYMBOL = np.zeros(256, bool)
SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
CAPITAL = np.zeros(256, bool)
CAPITAL[65:91] = True
SMALL = np.zeros(256, bool)
SMALL[97:123] = True

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_exclaims", "n_capitals", "n_small"]

#: Rules: measure to reject above a cutoff, and the cutoffs from sharp to mild.
RULES = {
    "symbols": ("n_symbols / greatest(1, n_words)", [0.05, 0.1, 0.2, 0.3, 0.5, 0.8]),
    "exclaims": ("n_exclaims / greatest(1, n_words)", [0.05, 0.1, 0.3, 0.6, 1.0]),
    "capitals": ("n_capitals / greatest(1, n_capitals + n_small)", [0.2, 0.3, 0.5, 0.7, 0.9]),
    "dup_lines": ("n_dup_lines / greatest(1, n_lines)", [0.1, 0.2, 0.3, 0.5, 0.7]),
    "repeats": ("n_repeat_words / greatest(1, n_words)", [0.05, 0.1, 0.15, 0.2, 0.25]),
    "long_words": ("word_chars / greatest(1, n_words)", [8.0, 9.0, 10.0, 12.0, 15.0]),
}


def _distinct(doc: np.ndarray, key: np.ndarray, n: int) -> np.ndarray:
    """Distinct keys of each document."""
    mixed = tb.mix(key + (doc.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    _, first = np.unique(mixed, return_index=True)
    return np.bincount(doc[first], minlength=n)


def chunk_measures(c: tb.Chunk) -> dict[str, np.ndarray]:
    n, buf, offs = len(c.offs) - 1, c.buf, c.offs
    per_doc = lambda mask: np.diff(np.concatenate(([0], np.cumsum(mask)))[offs])
    in_word = tb.NOT_SPACE[buf]
    starts, ends = tb.spans(in_word, offs)
    doc = np.searchsorted(offs, starts, "right") - 1
    words = tb.span_hashes(buf, starts, ends, tb.BYTE_VALUE)

    line_starts, line_ends = tb.spans(buf != 10, offs)
    upto = np.concatenate(([0], np.cumsum(in_word)))
    full = upto[line_ends] > upto[line_starts]
    line_starts, line_ends = line_starts[full], line_ends[full]
    line_doc = np.searchsorted(offs, line_starts, "right") - 1
    n_lines = np.bincount(line_doc, minlength=n)
    lines = tb.span_hashes(buf, line_starts, line_ends, tb.BYTE_VALUE)

    grams = tb.window_hashes(words, WINDOW)
    first = np.flatnonzero(doc[:len(grams)] == doc[WINDOW - 1:]) if len(grams) else np.zeros(0, np.int64)
    repeated = np.zeros(len(words) + 1, np.int64)
    if len(first):
        key = tb.mix(grams[first] + (doc[first].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(first), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        at = first[twice]
        np.add.at(repeated, at, 1)
        np.add.at(repeated, at + WINDOW, -1)
    covered = np.cumsum(repeated[:-1]) > 0
    return {
        "n_words": np.bincount(doc, minlength=n), "word_chars": per_doc(in_word & ((buf & 0xC0) != 0x80)),
        "n_symbols": per_doc(SYMBOL[buf]), "n_dup_lines": n_lines - _distinct(line_doc, lines, n),
        "n_repeat_words": np.bincount(doc[covered], minlength=n), "n_lines": n_lines, "n_exclaims": per_doc(buf == 33),
        "n_capitals": per_doc(CAPITAL[buf]), "n_small": per_doc(SMALL[buf]),
    }


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, stratum and the base measures of every document."""
    def run(batches):
        for batch in batches:
            parts = [chunk_measures(c) for c in tb.chunks(batch.column(2))]
            columns = [pa.array(np.concatenate([p[m] for p in parts]) if parts else np.zeros(0, np.int64), pa.int64()) for m in MEASURES]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["doc_id", "stratum", *MEASURES])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("stratum"), "text").mapInArrow(
        run, "doc_id long, stratum string, " + ", ".join(f"{m} long" for m in MEASURES))


BASE_FAILED = "n_words < 20 or 100 * n_repeat_words > 30 * n_words"


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(Binomial(n, p) <= k), exactly up to one half."""
    if k >= n:
        return 1.0
    if k > n * p + 1:
        return 0.5  # at least that: no test at a level below one half passes
    log = lambda i: math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)
    top = log(min(k, int(n * p)))
    total, i = 0.0, k
    while i >= 0:
        term = log(i) - top
        total += math.exp(term)
        if i < n * p and term < -45:
            break
        i -= 1
    return min(1.0, total * math.exp(top))


def thresholds(measured: DataFrame, labels: DataFrame, risk: float = 0.05, delta: float = 0.05) -> dict[str, dict[str, float]]:
    """rule -> stratum -> selected cutoff.  One row per stratum is collected."""
    good = labels.where("quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality")).where("quality = 1")
    held = measured.where(f"not ({BASE_FAILED})").join(good, "doc_id")
    tests = [(r, i, f"{m} > {c}D") for r, (m, cuts) in RULES.items() for i, c in enumerate(cuts)]
    rows = held.groupBy("stratum").agg(F.count("*").alias("n"), *[
        F.count_if(F.expr(t)).alias(f"{r}_{i}") for r, i, t in tests]).collect()
    chosen: dict[str, dict[str, float]] = {r: {} for r in RULES}
    for row in rows:
        for r, (_, cuts) in RULES.items():
            for i, c in enumerate(cuts):
                if binomial_tail(row[f"{r}_{i}"], row["n"], risk / len(RULES)) <= delta / (len(tests) * len(rows)):
                    chosen[r][row["stratum"]] = c
                    break
    return chosen


def judge(docs: DataFrame, labels: DataFrame, risk: float = 0.05, delta: float = 0.05) -> DataFrame:
    """doc_id, stratum, the measures, base_failed, rejected_by and kept."""
    measured = written(measures(docs), "measures")
    chosen = thresholds(measured, labels, risk, delta)
    rejects = []
    for r, (m, _) in RULES.items():
        if chosen[r]:
            cut = F.element_at(F.create_map(*[F.lit(x) for pair in sorted(chosen[r].items()) for x in pair]), F.col("stratum"))
            rejects.append(F.when(F.expr(m) > cut, F.lit(r)))
    out = measured.withColumn("base_failed", F.expr(BASE_FAILED))
    safe = F.array_compact(F.array(*rejects)) if rejects else F.array().cast("array<string>")
    out = out.withColumn("rejected_by", F.when(F.col("base_failed"), F.array().cast("array<string>")).otherwise(safe))
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("rejected_by") == 0))
