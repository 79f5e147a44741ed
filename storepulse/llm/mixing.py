"""Mixing sources to target token counts by entropy balancing (operator 5).

Every token of the corpus starts with rate 1.  Sought are the rates closest to
that in relative entropy under one token constraint per source: the taken
tokens of source s equal its target t_s, no rate above ``most``.  The dual has
one variable per source and its solution is the exponential tilt
rate_i = min(most, exp(lambda_s)).  Newton's method runs on the dual of all
sources at once, each iteration one aggregation over the corpus's distinct
(source, size) cells, until every residual is below ``tolerance``.

Rates are rounded into copies (0 .. most) by systematic rounding along sizes:
the running sum of the rates, in order of size, is floored, which gives every
(source, size) cell a whole number of copies, and what one size loses the next
gains.  What a source still misses (about one long document) is then added to
or taken from cells from the longest size that fits down to the shortest.  A
cell's copies are spread evenly over its documents in order of (hash slice,
doc_id), so no window ever holds a whole source or a whole cell, however hot.

A null text or one without words has size 0 and adds nothing; null sources are
one source, last in order; repeated rows count each; null doc_ids are mixed
like the others; an empty table gives an empty result.  Extra columns are
passed through; clashing names are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from storepulse.llm.common import WORD, written

SLICES = 64


def word_count(text) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def targets(sources: DataFrame, weights: tuple = (3, 1, 2), total: float = 1.5, most: float = 2.0) -> DataFrame:
    """Add ``target`` to (source, source_size): ``total`` of all sizes is shared
    by the repeating weights in source order, no target above ``most`` times
    its source's size, the excess shared again by weight.

    In order of source_size / weight the capped sources come first, so the
    share per weight is the first one that the next source can take.
    """
    everyone = Window.partitionBy()  # one row per source
    at = F.pmod(F.row_number().over(everyone.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (at + 1).cast("int"))
    s = sources.withColumn("weight", weight).withColumn("bound", F.lit(float(most)) * F.col("source_size"))
    order = everyone.orderBy(F.col("bound") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    left = F.lit(float(total)) * F.sum("source_size").over(everyone) - F.coalesce(F.sum("bound").over(before), F.lit(0.0))
    share = left / (F.sum("weight").over(everyone) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    s = s.withColumn("share", share).withColumn("place", F.row_number().over(order))
    first = F.when(F.col("share") <= F.col("bound") / F.col("weight"), F.col("place"))
    level = F.min_by("share", first).over(everyone)
    return s.withColumn("level", level).select(
        "source", "source_size", F.least(F.col("bound"), F.coalesce(F.col("level") * F.col("weight"), F.col("bound"))).alias("target"))


def balance(cells: DataFrame, wanted: DataFrame, most: float = 2.0, tolerance: float = 1e-10, iterations: int = 60) -> DataFrame:
    """source, rate.  cells: source, size, n; wanted: source, source_size, target."""
    tilt = F.least(F.lit(float(most)), F.exp("lam"))
    state = wanted.where("source_size > 0").select(
        "source", "target", F.when(F.col("target") >= F.col("source_size") * most, F.log(F.lit(float(most)))).otherwise(0.0).alias("lam"))
    for _ in range(iterations):
        moved = cells.join(state, F.col("s").eqNullSafe(F.col("source"))).groupBy("source", "target", "lam").agg(
            F.sum(F.col("n") * F.col("size") * tilt).alias("taken"))
        # Newton: gradient taken - target, curvature taken; beyond log(most) the dual is flat
        step = F.when(F.col("target") > 0, (F.col("target") - F.col("taken")) / F.col("taken")).otherwise(0.0)
        state = written(moved.select("source", "target", "taken", F.least(F.log(F.lit(float(most))), F.col("lam") + F.greatest(F.lit(-2.0), step)).alias("lam")), "dual")
        off = state.agg(F.max(F.abs(F.col("taken") - F.col("target")) / F.greatest("target", F.lit(1.0)))).first()[0]
        if off is None or off < tolerance:
            break
    return state.select("source", F.when(F.col("target") > 0, F.least(F.lit(float(most)), F.exp("lam"))).otherwise(0.0).alias("rate"))


def cell_copies(sizes: DataFrame, info: DataFrame, most: int) -> DataFrame:
    """s, size, n, copies, source_size, target: whole copies of each cell."""
    before = Window.partitionBy("s").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    ranked = sizes.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))
    ranked = ranked.join(info, F.col("s").eqNullSafe(F.col("source"))).drop("source")
    place = lambda k: F.floor(F.col("rate") * k + 0.5)
    copies = F.least(place(F.col("start") + F.col("n")) - place(F.col("start")), F.col("n") * most)
    ranked = written(ranked.select("s", "size", "n", "source_size", "target", copies.cast("long").alias("copies")), "copies")
    cell = F.struct("size", "n", "copies")
    per_source = ranked.where("size > 0").groupBy("s").agg(
        F.sort_array(F.collect_list(cell), asc=False).alias("cells"),  # one entry per distinct size
        F.round(F.max("target") - F.sum(F.col("size") * F.col("copies"))).cast("long").alias("missing"))
    fold = f"""aggregate(cells, named_struct('missing', missing, 'more', cast(array() as array<struct<size: bigint, more: bigint>>)),
        (a, c) -> named_struct(
            'missing', a.missing - c.size * greatest(-c.copies, least(c.n * {int(most)} - c.copies, a.missing div c.size)),
            'more', if(greatest(-c.copies, least(c.n * {int(most)} - c.copies, a.missing div c.size)) = 0, a.more,
                concat(a.more, array(named_struct('size', c.size, 'more', greatest(-c.copies, least(c.n * {int(most)} - c.copies, a.missing div c.size))))))),
        a -> a.more)"""
    more = per_source.select(F.col("s").alias("s2"), F.expr(f"inline({fold})")).withColumnRenamed("size", "size2")
    return ranked.join(more, F.col("s").eqNullSafe(F.col("s2")) & (F.col("size") == F.col("size2")), "left").select(
        "s", "size", "n", "source_size", "target", (F.col("copies") + F.coalesce("more", F.lit(0))).alias("copies"))


def mix(docs: DataFrame, weights: tuple = (3, 1, 2), total: float = 1.5, most: int = 2) -> DataFrame:
    """docs (with a column size, see ``word_count``) plus source_size, target,
    copies and taken = copies * size."""
    cols = [c for c in docs.columns if c not in ("source_size", "target", "copies", "taken")]
    sliced = docs.select(*cols, F.pmod(F.xxhash64("doc_id", "source"), F.lit(SLICES)).cast("int").alias("slice_"))
    slices = written(sliced.groupBy(F.col("source").alias("s"), "size", "slice_").agg(F.count("*").alias("n")), "slices")
    sizes = written(slices.groupBy("s", "size").agg(F.sum("n").alias("n")), "sizes")
    sources = sizes.groupBy(F.col("s").alias("source")).agg(F.sum(F.col("size") * F.col("n")).cast("long").alias("source_size"))
    wanted = written(targets(sources, weights, total, most), "targets")
    rates = balance(sizes, wanted, most).withColumnRenamed("source", "t")
    info = wanted.join(rates, F.col("source").eqNullSafe(F.col("t")), "left").select(
        "source", "source_size", "target", F.coalesce("rate", F.lit(0.0)).alias("rate"))
    copies = cell_copies(sizes, info, most)
    before = Window.partitionBy("s", "size").orderBy("slice_").rowsBetween(Window.unboundedPreceding, -1)
    begin = slices.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n").alias("i").join(
        copies.alias("c"), F.col("i.s").eqNullSafe(F.col("c.s")) & (F.col("i.size") == F.col("c.size"))).select(
        F.struct(F.col("i.s").alias("source"), F.col("i.size").alias("size"), "slice_").alias("cell_"), "start", F.col("n").alias("n_"),
        F.col("copies").alias("all_"), "source_size", "target")
    # one key for the window and the join, null sources included: whole rows are shuffled once for both
    place = F.row_number().over(Window.partitionBy("cell_").orderBy(F.col("doc_id").asc_nulls_last()))
    cell = F.struct("source", "size", "slice_").cast(begin.schema["cell_"].dataType)  # also equal in what may be null
    out = sliced.withColumn("cell_", cell).withColumn("place_", place).join(begin, "cell_")
    upto = F.expr("(all_ * (start + place_)) div n_ - (all_ * (start + place_ - 1)) div n_")
    return out.withColumn("copies", upto).select(
        *cols, "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each document as many times as it has copies."""
    whole = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.struct("*").alias("row_"))
    out = mix(whole, **options).where("copies > 0")
    return out.withColumn("copy_", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row_.*")
