"""Shared building blocks over the retail tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Tables = dict  # name -> DataFrame, see storepulse.sources.retail

TASK_ROWS = 500_000  # rows that a task sorts or aggregates without a reduction


def transactions(r: Tables, window: Column | None = None) -> DataFrame:
    tx = r["sales_transactions"]
    return tx.filter(window) if window is not None else tx


def sold_lines(r: Tables, window: Column | None = None) -> DataFrame:
    """Item rows joined to their transaction (inner), transaction filtered
    first so the date predicate reaches the scan (and, via the runtime bloom
    filter, prunes the item scan too).

    Columns: transaction_id, product_id, quantity, unit_cents, total_cents,
    discount_cents, promotion_id, transaction_date, tx_cents.
    """
    tx = transactions(r, window).select(
        F.col("id").alias("transaction_id"), "transaction_date", F.col("total_cents").alias("tx_cents"))
    return items_in(r, window).join(tx, "transaction_id")


def parts_for(spark: SparkSession, rows: int) -> int:
    """Partitions of a shuffle of so many rows: one a core, or more, so that a
    task's share does not grow with the input."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // TASK_ROWS))


def line_parts(r: Tables, window: Column | None = None) -> int:
    """``parts_for`` of the item rows that are read for a window; on the plain
    views they are counted without reading a column."""
    items = items_in(r, window)
    return parts_for(items.sparkSession, items.count())


def lines_by_transaction(r: Tables, window: Column | None, parts: int) -> DataFrame:
    """``sold_lines`` dealt by transaction to ``parts`` partitions.  For
    aggregates with about a group per line (a product of a transaction), whose
    hash tables hold a task's whole share."""
    tx = transactions(r, window).select(
        F.col("id").alias("transaction_id"), "transaction_date", F.col("total_cents").alias("tx_cents"))
    return items_in(r, window).repartition(parts, "transaction_id").join(tx.repartition(parts, "transaction_id"), "transaction_id")


def items_in(r: Tables, window: Column | None = None) -> DataFrame:
    """Item rows that can belong to transactions of the window: pruned by
    the date that the canonical layout keeps on them, all of them on the
    plain views (the join with the filtered transactions decides)."""
    items = r["sales_transaction_items"]
    if "transaction_date" not in items.columns:
        return items
    return (items.filter(window) if window is not None else items).drop("transaction_date")


def product_dim(r: Tables, active_only: bool = False) -> DataFrame:
    """products JOIN categories -> product_id, product_name, category_id,
    category (+ stock columns).  Joined to aggregates *after* they are
    reduced to one row per product, never to raw item rows."""
    p = r["products"]
    if active_only:
        p = p.filter(F.col("is_active"))
    c = r["categories"].select(F.col("id").alias("category_id"), F.col("name").alias("category"))
    return (p.withColumnRenamed("id", "product_id").withColumnRenamed("name", "product_name")
            .join(c, "category_id"))


def reuse(df: DataFrame) -> DataFrame:
    """Materialise an intermediate that two branches of one plan consume.

    Written once with a reliable ``checkpoint`` into the shared
    ``spark.checkpoint.dir`` (never a local checkpoint), so the fact scan
    and shuffles behind it run once instead of once per branch, and a lost
    executor does not lose it.  Only used on aggregated intermediates
    (per product/category x day), never on raw fact rows.
    """
    from storepulse.session import shared_dir
    shared_dir(df.sparkSession)  # makes sure a checkpoint folder is set
    return df.checkpoint(eager=True)


def top_k(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    """ORDER BY ... LIMIT k; callers include a unique tie-break so the result
    is deterministic.  Planned as TakeOrderedAndProject (per-partition top-k
    then a k-row merge), so no full sort of the input."""
    return df.orderBy(*order).limit(k)
