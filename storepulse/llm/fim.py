"""Fill-in-middle transformation (operator 12).

Cuts are given in units (code points, or lines) but texts are bytes.  The map
from a unit's rank to the byte at which it begins is held as a learned index:
a piecewise-linear function, fitted to all boundaries of a text so that no
prediction is off by more than ``ERROR`` bytes, and one signed byte per
boundary, the residual.  A segment is the longest run of boundaries that one
line through its first boundary can follow within the error (the cone of
feasible slopes does not become empty); a text of one-byte characters is one
segment without residuals.  A cut's byte is the prediction plus the residual,
exactly; slopes are fixed-point numbers, so every reader predicts alike.

A text is cut into prefix, middle and suffix at two places drawn from its
doc_id alone and written as

    psm   <P>prefix<S>suffix<M>middle
    spm   <S>suffix<P>prefix<M>middle
    plain the text itself

A text that is empty or holds a marker is always plain; as no marker can begin
inside another, the text is found again from output and form (``restored``).

Null texts count as empty; a null doc_id draws as an empty id; rows that repeat
a doc_id draw alike and are cut each by its own text; very long texts are whole
segments of one task; an empty table gives an empty result; columns other than
doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storepulse.llm import textbytes as tb

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
ERROR = 120  # bytes by which a prediction may be off; a residual is a signed byte
_FRACTION = 32  # bits of a slope behind the point
_LONGEST = 1 << 26  # boundaries of a segment, so that slope times rank stays in 64 bits
_STEP = 4096  # boundaries that are tried at first


class Index(NamedTuple):
    """Rank of a boundary -> byte offset."""

    ranks: np.ndarray  # first boundary of each segment
    offsets: np.ndarray  # its byte offset
    slopes: np.ndarray  # bytes a unit, fixed-point
    residuals: np.ndarray  # one a boundary, or none at all if every one is 0

    def predict(self, rank: np.ndarray) -> np.ndarray:
        k = np.searchsorted(self.ranks, rank, "right") - 1
        return self.offsets[k] + (self.slopes[k] * (rank - self.ranks[k]) >> _FRACTION)

    def locate(self, rank: np.ndarray) -> np.ndarray:
        """The exact byte offsets of boundaries."""
        at = self.predict(rank)
        return at + self.residuals[rank] if len(self.residuals) else at


def fit(offsets: np.ndarray, error: int = ERROR) -> Index:
    """The index of ascending boundary offsets (at least one)."""
    n = len(offsets)
    ranks, slopes, s = [], [], 0
    while s < n:
        low, high, end, step = -np.inf, np.inf, s + 1, _STEP
        while end < min(n, s + _LONGEST):
            stop = min(n, end + step, s + _LONGEST)
            run = np.arange(end - s, stop - s)
            rise = offsets[end:stop] - offsets[s]
            lows = np.maximum(np.maximum.accumulate((rise - error) / run), low)
            highs = np.minimum(np.minimum.accumulate((rise + error) / run), high)
            empty = np.flatnonzero(lows > highs)
            last = empty[0] if len(empty) else len(run)
            if last:
                low, high = lows[last - 1], highs[last - 1]
            end += int(last)
            if len(empty):
                break
            step *= 2
        ranks.append(s)
        slopes.append(0 if end == s + 1 else round((low + high) / 2 * (1 << _FRACTION)))
        s = end
    at = np.array(ranks, np.int64)
    model = Index(at, offsets[at], np.array(slopes, np.int64), np.zeros(0, np.int8))
    residuals = offsets - model.predict(np.arange(n))
    if not residuals.any():
        return model
    return model._replace(residuals=residuals.astype(np.int8))


def begins(buf: np.ndarray, unit: str) -> np.ndarray:
    """With every byte, whether a unit begins there (the first byte of a text
    always begins one)."""
    if unit == "char":
        return (buf & 0xC0) != 0x80
    if unit == "line":
        return np.concatenate(([True], buf[:-1] == 0x0A)) if len(buf) else np.zeros(0, bool)
    raise ValueError(f"unknown unit: {unit}")


def _indexes(texts: pa.Array, unit: str):
    """(bytes, index, number of units) of every text."""
    for c in tb.chunks(texts):
        starts = begins(c.buf, unit)
        for i in range(len(c.offs) - 1):
            a, b = c.offs[i], c.offs[i + 1]
            begin = starts[a:b]
            if b > a:
                begin[0] = True
            units = int(np.count_nonzero(begin))
            if units == b - a:  # every unit is one byte
                model = Index(np.zeros(1, np.int64), np.zeros(1, np.int64), np.full(1, 1 << _FRACTION), np.zeros(0, np.int8))
            else:
                model = fit(np.append(np.flatnonzero(begin), b - a))
            yield c.buf[a:b], model, units


def index(docs: DataFrame, unit: str = "char") -> DataFrame:
    """doc_id, n, ranks, offsets, slopes, residuals: the stored index of every
    text (residuals empty where all are 0)."""

    def run(batches):
        for batch in batches:
            cols = [[], [], [], [], []]
            for _, m, n in _indexes(batch.column(1), unit):
                for col, v in zip(cols, (n, m.ranks, m.offsets, m.slopes, m.residuals.tobytes()), strict=True):
                    col.append(v)
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(cols[0], pa.int64()), *[pa.array(c, longs) for c in cols[1:4]], pa.array(cols[4], pa.binary())],
                ["doc_id", "n", "ranks", "offsets", "slopes", "residuals"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, n long, ranks array<bigint>, offsets array<bigint>, slopes array<bigint>, residuals binary")


def draws(doc_id: int | None, seed: str) -> tuple[int, int, int, int]:
    """Four numbers below 2^32 from the seed and the id alone."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[k:k + 4], "big") for k in (0, 4, 8, 12))


def transform(docs: DataFrame, seed: str = "1", percent: int = 90, spm_percent: int = 20, unit: str = "char") -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars (units; null if plain),
    output, segments (of the index), one row per input row.  ``percent`` of
    the texts are cut, ``spm_percent`` of these begin with the suffix."""
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
    p, s, m = marks

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_pylist()
            n, form, prefix, middle, output, segments = [], [], [], [], [], []
            for doc_id, (buf, model, units) in zip(ids, _indexes(batch.column(1), unit), strict=True):
                text = buf.tobytes()
                h1, h2, h3, h4 = draws(doc_id, seed)
                n.append(units)
                segments.append(len(model.ranks))
                if not text or h3 % 100 >= percent or any(x in text for x in marks):
                    form.append("plain")
                    prefix.append(None)
                    middle.append(None)
                    output.append(text)
                    continue
                first, second = sorted((h1 % (units + 1), h2 % (units + 1)))
                a, b = model.locate(np.array([first, second])).tolist()
                prefix.append(first)
                middle.append(second - first)
                if h4 % 100 < spm_percent:
                    form.append("spm")
                    output.append(b"".join((s, text[b:], p, text[:a], m, text[a:b])))
                else:
                    form.append("psm")
                    output.append(b"".join((p, text[:a], s, text[b:], m, text[a:b])))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()),
                 pa.array(middle, pa.int64()), pa.array(output, pa.binary()).cast(pa.string()), pa.array(segments, pa.int64())],
                ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "segments"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string, segments long")


def restored(form: Column, output: Column) -> Column:
    """The text behind an output, from its form and markers alone."""
    body = F.substr(output, F.lit(4))
    part = lambda c, mark, k: F.split_part(c, F.lit(mark), F.lit(k))
    psm = part(body, SUFFIX, 2)
    spm = part(body, PREFIX, 2)
    return (F.when(form == "psm", F.concat(part(body, SUFFIX, 1), part(psm, MIDDLE, 2), part(psm, MIDDLE, 1)))
            .when(form == "spm", F.concat(part(spm, MIDDLE, 1), part(spm, MIDDLE, 2), part(body, PREFIX, 1)))
            .otherwise(output))
