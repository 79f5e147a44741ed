"""Toxicity score by a factorization machine over hashed terms (operator 3).

A text is its set of lower-cased terms (runs of letters and digits), hashed
to 2**BITS buckets.  Its score is sigmoid(b + sum w_i + sum_{i<j} <v_i, v_j>)
over the buckets that the training sample shows to matter, so pairs of terms
add evidence beyond their own weights.

Training takes at most ``positives`` + ``negatives`` labelled rows (those with
the smallest hash of doc_id), reduces each to its term buckets on the
executors, and fits a model of bounded size; in every epoch half of each
row's terms are left out at random (fixed seed), so single terms must suffice.
Scoring reads every whole text.

Null or empty texts, and texts without a known term, get the base score;
labels that are null are ignored, of repeated labels the largest counts;
without a label of either kind the score is 0 everywhere; rows and their
extra columns pass through.
"""

from __future__ import annotations

import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from storepulse.llm import textbytes as tb

BITS = 20
TERM = np.zeros(256, bool)
TERM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


class Model(NamedTuple):
    bias: float
    buckets: np.ndarray  # sorted
    weights: np.ndarray
    factors: np.ndarray  # (len(buckets), k)


def held_out(doc_id) -> F.Column:
    """Rows kept from training: crc32 of the id as text leaves 1 modulo 3."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def term_buckets(c: tb.Chunk) -> tuple[np.ndarray, np.ndarray]:
    """(document, bucket) of each term of a chunk."""
    starts, ends = tb.spans(TERM[c.buf], c.offs)
    h = tb.span_hashes(c.buf, starts, ends, tb.BYTE_VALUE_FOLDED)
    return np.searchsorted(c.offs, starts, "right") - 1, (h >> np.uint64(64 - BITS)).astype(np.int64)


def _bags(sample: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            bags = []
            for c in tb.chunks(batch.column(0)):
                doc, bucket = term_buckets(c)
                cut = np.searchsorted(doc, np.arange(len(c.offs)))
                bags += [np.unique(bucket[cut[i]:cut[i + 1]]).astype(np.int32) for i in range(len(c.offs) - 1)]
            yield pa.RecordBatch.from_arrays([pa.array(bags, pa.list_(pa.int32())), batch.column(1)], ["terms", "toxic"])

    return sample.select("text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(run, "terms array<int>, toxic int")


def fit(bags: list[np.ndarray], toxic: np.ndarray, factors: int = 8, most: int = 8192, fewest: int = 3,
        epochs: int = 250, rate: float = 0.05, decay: float = 2e-4) -> Model | None:
    """A factorization machine by full-batch Adam on the logistic loss."""
    y = toxic.astype(np.float64)
    if not len(y) or y.min() == y.max():
        return None
    doc = np.repeat(np.arange(len(bags), dtype=np.int32), [len(b) for b in bags])
    flat = np.concatenate(bags) if len(doc) else np.zeros(0, np.int32)
    seen = np.bincount(flat, minlength=1 << BITS)
    yes = np.bincount(flat, weights=y[doc], minlength=1 << BITS)
    pos, neg = y.sum(), len(y) - y.sum()
    p, q = (yes + 0.5) / (pos + 1), (seen - yes + 0.5) / (neg + 1)
    z = np.abs(p - q) / np.sqrt(p * (1 - p) / pos + q * (1 - q) / neg)
    chosen = np.flatnonzero((seen >= fewest) & (z >= 2.5))
    chosen = np.sort(chosen[np.argsort(-z[chosen], kind="stable")[:most]])
    place = np.full(1 << BITS, -1, np.int32)
    place[chosen] = np.arange(len(chosen), dtype=np.int32)
    term = place[flat]
    doc, term = doc[term >= 0], term[term >= 0]
    del flat, place

    rng = np.random.default_rng(11)
    params = [np.zeros(1), np.zeros(len(chosen)), rng.normal(0, 0.05, (len(chosen), factors))]
    m, v = [np.zeros_like(a) for a in params], [np.zeros_like(a) for a in params]
    for t in range(1, epochs + 1):
        bias, w, vec = params
        in_use = rng.random(len(term)) < 0.5 if t % 2 else np.ones(len(term), bool)
        d, k = doc[in_use], term[in_use]
        total = np.stack([np.bincount(d, weights=vec[k, f], minlength=len(y)) for f in range(factors)], 1)
        square = np.bincount(d, weights=(vec[k] ** 2).sum(1), minlength=len(y))
        raw = bias[0] + np.bincount(d, weights=w[k], minlength=len(y)) + 0.5 * ((total ** 2).sum(1) - square)
        e = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y) / len(y)
        slope_v = np.stack([np.bincount(k, weights=e[d] * (total[d, f] - vec[k, f]), minlength=len(chosen)) for f in range(factors)], 1)
        slopes = [np.array([e.sum()]), np.bincount(k, weights=e[d], minlength=len(chosen)) + decay * w / max(1, len(chosen)), slope_v + decay * vec]
        for a, s, i in zip(params, slopes, range(3), strict=True):
            m[i] = 0.9 * m[i] + 0.1 * s
            v[i] = 0.999 * v[i] + 0.001 * s * s
            a -= rate * (m[i] / (1 - 0.9 ** t)) / (np.sqrt(v[i] / (1 - 0.999 ** t)) + 1e-9)
    return Model(float(params[0][0]), chosen, params[1], params[2])


def train(docs: DataFrame, labels: DataFrame, positives: int = 8000, negatives: int = 12000) -> Model | None:
    """Fit on a bounded sample of the labelled rows that are not held out.
    The sample's ids (at most positives + negatives) are broadcast, and its
    bags of term buckets come to the driver."""
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.where(~held_out(F.col("doc_id"))).withColumn("rank", F.xxhash64("doc_id"))
    take = lambda kind, n: known.where(F.col("toxic") == kind).orderBy("rank", "doc_id").limit(n).select("doc_id", "toxic")
    sample = take(1, positives).union(take(0, negatives))
    sample = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    table = _bags(sample).toArrow().combine_chunks()
    terms = table.column("terms").combine_chunks()
    offsets, flat = terms.offsets.to_numpy(), terms.values.to_numpy()
    bags = [flat[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    toxic = table.column("toxic").to_numpy()
    order = sorted(range(len(bags)), key=lambda i: (toxic[i], len(bags[i]), zlib.crc32(bags[i])))
    return fit([bags[i] for i in order], toxic[order])


def score(docs: DataFrame, model: Model | None, column: str = "score") -> DataFrame:
    """docs with the score of every whole text added as the last column."""
    docs = docs.drop(column)
    if model is None:
        return docs.withColumn(column, F.lit(0.0))
    sent = docs.sparkSession.sparkContext.broadcast(model)  # at most ``most`` terms
    cols = docs.columns

    def run(batches):
        model = sent.value
        place = np.full(1 << BITS, -1, np.int32)
        place[model.buckets] = np.arange(len(model.buckets), dtype=np.int32)
        size = len(model.buckets)
        for batch in batches:
            out = []
            for c in tb.chunks(batch.column(cols.index("text"))):
                n = len(c.offs) - 1
                doc, bucket = term_buckets(c)
                term = place[bucket]
                pair = np.unique(doc[term >= 0] * np.int64(size or 1) + term[term >= 0])
                d, k = pair // (size or 1), pair % (size or 1)
                total = np.stack([np.bincount(d, weights=f[k], minlength=n) for f in model.factors.T], 1)
                raw = model.bias + np.bincount(d, weights=model.weights[k], minlength=n) + 0.5 * (
                    (total ** 2).sum(1) - np.bincount(d, weights=(model.factors[k] ** 2).sum(1), minlength=n))
                out.append(1 / (1 + np.exp(-np.clip(raw, -30, 30))))
            scores = np.concatenate(out) if out else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], [*cols, column])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(column, DoubleType())]))
