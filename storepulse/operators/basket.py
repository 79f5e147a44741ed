"""Market-basket pairs.

Semantics (from the reference): baskets = transactions of the window with
at least two distinct products; each basket is the name-sorted list of its
item rows (duplicates kept); every position pair i < j gives the pair
(name_i, name_j).  frequency = number of such pairs over all baskets;
support = frequency / #baskets; confidence = frequency / (number of pairs
with the same product_a that survive ``frequency >= 3``); both rounded to 3
places; top 20 by frequency, then confidence (then names).

Plan
----
Position pairs are never materialised as rows.  Item rows are reduced to
(basket, name) -> count (partially before the shuffle); a name pair (a < b)
then occurs count_a * count_b times in a basket and (a, a)
count_a * (count_a - 1) / 2 times.  These rows, of baskets with two or more
distinct products, are stored once and read by two passes:

* the first adds every pair's weight to a table of hashed counts of fixed size
  (``BUCKETS``; tables of all tasks are merged in slices).  A pair whose count
  stays below the least frequency cannot be frequent;
* the second counts exactly, and only pairs whose hashed count reaches the
  least frequency leave a task.  Hash collisions only let more pairs through.

Shuffles of item rows, cells and pairs have a number of partitions in
proportion to their rows, so a task's sorts and hash tables do not grow with
the input.

A basket is cut into cells: its names are dealt to blocks of about ``WIDE``,
and a cell (basket, block, block) pairs two blocks, so a basket of any width
spreads over tasks.  Pairs are computed, and partial counts held, a bounded
number at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storepulse.functions.columns import between_ts, round_half_up, since
from storepulse.operators.common import Tables, line_parts, lines_by_transaction, parts_for, reuse, top_k

PAIR_SCHEMA = "a long, b long, w long"
PAIRS = 1 << 17  # pairs computed, and partial sums held, at once
WIDE = 1024  # names of a block of a basket
BUCKETS = 1 << 22  # hashed counts: 4 MB a task, a broadcast of 512 KB
SPREAD = 4  # partitions of pairs per partition of cells
SLICE = 1 << 14  # hashed counts that are merged at once
_CAP = 255  # a hashed count is a byte; enough to compare with a least frequency below that


def _cell_parts(pdf: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(a, b, weight) of the pairs of complete cells (rows sorted by cell, then
    block), about PAIRS at a time.  In a cell of one block every row is paired
    with the rows behind it, in a cell of two blocks every row of the first
    with all of the second."""
    name = pdf["name_id"].to_numpy(dtype=np.int64)
    cnt = pdf["c"].to_numpy(dtype=np.int64)
    cell = pdf[["transaction_id", "low", "high"]].to_numpy(dtype=np.int64)
    mine = pdf["mine"].to_numpy()
    one = cell[:, 1] == cell[:, 2]
    same = (cnt >= 2) & one  # same-name pairs of a basket: C(count, 2), in the cell of its own block
    if same.any():
        yield name[same], name[same], cnt[same] * (cnt[same] - 1) // 2
    rows = np.arange(len(name))
    edge = (cell[1:] != cell[:-1]).any(axis=1)
    ends = np.append(np.flatnonzero(edge) + 1, len(name))
    end = ends[np.searchsorted(ends, rows, "right")]
    turns = np.append(np.flatnonzero(edge | (mine[1:] != mine[:-1])) + 1, len(name))
    first = np.where(one, rows + 1, turns[np.searchsorted(turns, rows, "right")])  # first partner
    partners = end - first
    upto = np.cumsum(partners)
    a = 0
    while a < len(name):
        before = upto[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(upto, before + PAIRS, "right")))
        n = partners[a:b]
        left = np.repeat(rows[a:b], n)
        right = np.repeat(first[a:b] - (upto[a:b] - n - before), n) + np.arange(len(left))
        if len(left):
            yield np.minimum(name[left], name[right]), np.maximum(name[left], name[right]), cnt[left] * cnt[right]
        a = b


def _cells(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of a partition sorted by cell; a cell that goes on in the next
    batch is held back until it is complete (a cell has two blocks at most)."""
    held: list[pd.DataFrame] = []
    for pdf in batches:
        if pdf.empty:
            continue
        cell = pdf[["transaction_id", "low", "high"]].to_numpy()
        if held and tuple(held[0][["transaction_id", "low", "high"]].iloc[0]) != tuple(cell[0]):
            yield from _cell_parts(pd.concat(held, ignore_index=True))
            held = []
        other = np.flatnonzero((cell != cell[-1]).any(axis=1))
        tail = int(other[-1]) + 1 if len(other) else 0  # where the last, perhaps unfinished, cell begins
        if tail:
            yield from _cell_parts(pd.concat([*held, pdf.iloc[:tail]], ignore_index=True))
            held = []
        held.append(pdf.iloc[tail:])
    if held:
        yield from _cell_parts(pd.concat(held, ignore_index=True))


def _bucket(a: np.ndarray, b: np.ndarray, buckets: int) -> np.ndarray:
    h = a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + b.astype(np.uint64)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(32)) % np.uint64(buckets)


def possible_pairs(cells: DataFrame, least: int, buckets: int) -> np.ndarray:
    """Pass 1: with every bucket, whether the pairs hashed to it together
    reach ``least``.  ``buckets`` bits come to the driver, as slices."""
    def count(batches):
        table = np.zeros(buckets, np.uint8)
        for a, b, w in _cells(batches):
            at = _bucket(a, b, buckets).astype(np.int64)
            some, slot = np.unique(at, return_inverse=True)
            total = np.bincount(slot, weights=np.minimum(w, _CAP)) + table[some]
            table[some] = np.minimum(total, _CAP).astype(np.uint8)
        parts = table.reshape(-1, min(SLICE, buckets))
        full = np.flatnonzero(parts.any(axis=1))
        yield pd.DataFrame({"slice": full.astype(np.int64), "counts": [parts[k].tobytes() for k in full]})

    def merge(batches):
        current, total = None, None
        for pdf in batches:
            for k, counts in zip(pdf["slice"], pdf["counts"], strict=True):
                if k != current:
                    if current is not None:
                        yield pd.DataFrame({"slice": [current], "bits": [np.packbits(total >= least).tobytes()]})
                    current, total = k, np.zeros(min(SLICE, buckets), np.int64)
                total = np.minimum(total + np.frombuffer(counts, np.uint8), _CAP)
        if current is not None:
            yield pd.DataFrame({"slice": [current], "bits": [np.packbits(total >= least).tobytes()]})

    partial = cells.mapInPandas(count, "slice long, counts binary")
    merged = partial.repartition("slice").sortWithinPartitions("slice").mapInPandas(merge, "slice long, bits binary")
    out = np.zeros((buckets // min(SLICE, buckets), min(SLICE, buckets) // 8), np.uint8)
    for row in merged.toLocalIterator():  # buckets / SLICE rows at most
        out[row["slice"]] = np.frombuffer(row["bits"], np.uint8)
    return out.ravel()


def pair_counts(cells: DataFrame, bits: np.ndarray | None, buckets: int) -> DataFrame:
    """Pass 2: partial sums (a, b, w) of the pairs that pass 1 lets through,
    at most PAIRS of them held at once; the sum over all partitions is taken
    downstream."""
    sent = cells.sparkSession.sparkContext.broadcast(None if bits is None else bits.tobytes())

    def count(batches):
        table = None if sent.value is None else np.frombuffer(sent.value, np.uint8)
        held: list[pd.DataFrame] = []
        size = 0
        summed = lambda: pd.concat(held).groupby(["a", "b"], sort=False, as_index=False)["w"].sum()
        for a, b, w in _cells(batches):
            if table is not None:
                at = _bucket(a, b, buckets)
                keep = (table[at >> np.uint64(3)] >> (np.uint64(7) - (at & np.uint64(7))).astype(np.uint8)) & 1 != 0
                a, b, w = a[keep], b[keep], w[keep]
            held.append(pd.DataFrame({"a": a, "b": b, "w": w}))
            size += len(a)
            if size >= 2 * PAIRS:
                held = [summed()]
                size = len(held[0])
                if size >= PAIRS:
                    yield held[0]
                    held, size = [], 0
        if size:
            yield summed()

    return cells.mapInPandas(count, PAIR_SCHEMA)


def _name_ids(r: Tables) -> DataFrame:
    """One integer id per product name: the smallest product id carrying it.
    A grouped aggregate (partial per map task, hash-partitioned by name), so
    no single task sees every name.  Ids need not follow name order: pairs
    are keyed (smaller id, larger id) and put in name order once named."""
    return r["products"].groupBy("name").agg(F.min("id").alias("name_id"))


def basket_rows(r: Tables, window: Column | None) -> DataFrame:
    """transaction_id, name_id, c and blocks (of the basket) of baskets with at
    least two distinct products."""
    parts = line_parts(r, window)
    lines = lines_by_transaction(r, window, parts).select("transaction_id", "product_id")
    prod = r["products"].select(F.col("id").alias("product_id"), "name").join(_name_ids(r), "name").drop("name")
    # item rows are reduced to (basket, product) -> count with map-side partial
    # aggregation before products are joined, so no raw item row meets one
    per_name = (lines.groupBy("transaction_id", "product_id").agg(F.count(F.lit(1)).alias("c"))
                .join(prod, "product_id").repartition(parts, "transaction_id")
                .groupBy("transaction_id", "name_id")
                .agg(F.sum("c").alias("c"), F.min("product_id").alias("pmin"), F.max("product_id").alias("pmax")))
    basket = Window.partitionBy("transaction_id")  # the partitioning at hand
    return (per_name.select("transaction_id", "name_id", "c", F.min("pmin").over(basket).alias("lo"), F.max("pmax").over(basket).alias("hi"),
                            F.ceil(F.count(F.lit(1)).over(basket) / WIDE).cast("int").alias("blocks"))
            .filter("lo <> hi").select("transaction_id", "name_id", "c", "blocks"))


def cells_of(rows: DataFrame, *parts: int) -> DataFrame:
    """Basket rows dealt to the cells (transaction_id, low, high) of their
    block, cell by cell (in a number of partitions, if given)."""
    rows = rows.withColumn("mine", F.when(F.col("blocks") > 1, F.pmod(F.xxhash64("name_id"), F.col("blocks"))).otherwise(0).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    key = ["transaction_id", "low", "high"]
    return (rows.select("transaction_id", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"), "mine", "name_id", "c")
            .repartition(*parts, *key).sortWithinPartitions(*key, "mine"))


def frequently_bought_together_where(r: Tables, window: Column, limit: int = 20, min_frequency: int = 3,
                                     buckets: int = BUCKETS) -> DataFrame:
    """Pairs with at least ``min_frequency`` occurrences; one hashed count is a
    byte, so a least frequency beyond 255 is compared with 255 in pass 1."""
    ids = _name_ids(r)
    rows = reuse(basket_rows(r, window))  # read by both passes and the count of baskets
    parts = parts_for(rows.sparkSession, rows.agg(F.sum("blocks")).first()[0] or 0)  # a row is in as many cells
    cells = cells_of(rows, parts)
    bits = possible_pairs(cells, min(min_frequency, _CAP), buckets) if min_frequency > 1 else None
    sums = pair_counts(cells, bits, buckets).repartition(SPREAD * parts, "a", "b")  # summed in the tasks before
    frequent = sums.groupBy("a", "b").agg(F.sum("w").alias("frequency"))
    n_baskets = rows.agg(F.count_distinct("transaction_id").alias("frequency"))  # one row
    total = n_baskets.select(F.lit(None).cast("long").alias("a"), F.lit(None).cast("long").alias("b"), "frequency", F.lit(1).alias("is_total"))
    kept = frequent.filter(F.col("frequency") >= min_frequency).withColumn("is_total", F.lit(0)).unionByName(total)
    ida = ids.select(F.col("name_id").alias("a"), F.col("name").alias("product_a"))
    idb = ids.select(F.col("name_id").alias("b"), F.col("name").alias("product_b"))
    # the basket total keeps NULL names; a pair is reported in name order
    joined = kept.join(ida, "a", "left").join(idb, "b", "left")
    named = joined.select(
        F.least("product_a", "product_b").alias("product_a"), F.greatest("product_a", "product_b").alias("product_b"),
        "frequency", "is_total")
    # a grouped count, so a hot name is no single task; both branches read the
    # same shuffle of the partial sums
    per_a = named.groupBy("product_a").agg(F.count(F.lit(1)).alias("per_a"))
    scored = named.join(per_a, "product_a", "left").withColumn(
        "confidence", round_half_up(F.col("frequency").cast("double") / F.col("per_a").cast("double"), 3)).drop("per_a")
    # the one basket-total row rides through the top-k in first place, so
    # support needs no second pass; the window below spans <= limit + 1 rows
    top = top_k(scored, [F.col("is_total").desc(), F.col("frequency").desc(), F.col("confidence").desc(),
                         F.col("product_a"), F.col("product_b")], limit + 1)
    n_baskets = F.max(F.when(F.col("is_total") == 1, F.col("frequency"))).over(Window.partitionBy())
    return (top.withColumn("n_baskets", n_baskets).filter(F.col("is_total") == 0)
            .select("product_a", "product_b", "frequency",
                    round_half_up(F.col("frequency").cast("double") / F.col("n_baskets").cast("double"), 3)
                    .alias("support"), "confidence")
            .orderBy(F.col("frequency").desc(), F.col("confidence").desc(), "product_a", "product_b"))


def frequently_bought_together(r: Tables, as_of, days: int = 30, limit: int = 20) -> DataFrame:
    """Pairs over the trailing window."""
    return frequently_bought_together_where(r, since("transaction_date", as_of, days), limit)


def frequently_bought_together_range(r: Tables, start, end, limit: int = 20) -> DataFrame:
    """Pairs over [start, end]."""
    return frequently_bought_together_where(r, between_ts("transaction_date", start, end), limit)


def top_associations(pairs: DataFrame, n: int = 10) -> DataFrame:
    """A25: 'a → b' labels and frequency of the first ``n`` pairs."""
    return top_k(pairs, [F.col("frequency").desc(), F.col("confidence").desc(),
                         F.col("product_a"), F.col("product_b")], n).select(
        F.concat(F.col("product_a"), F.lit(" → "), F.col("product_b")).alias("association"), "frequency")
