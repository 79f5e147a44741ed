"""Retail tables derived from the driver's TPC-H-style parquet tables.

Canonical schema consumed by every operator (money in BIGINT cents):

=======================  ====================================================
sales_transactions       id, transaction_date (timestamp_ntz), total_cents
sales_transaction_items  transaction_id, product_id, quantity, unit_cents,
                         total_cents, discount_cents, promotion_id (nullable)
products                 id, name, sku, category_id, supplier_id (nullable),
                         current_stock, reorder_level, max_stock_level,
                         cost_cents, is_active
categories               id, name
suppliers                id, name, contact_person, phone, is_active
promotions               id, name, promotion_type, discount_percentage,
                         start_date, end_date (date), is_active, created_at
promotion_products       promotion_id, product_id
inventory_movements      product_id, movement_type ('inbound'/'outbound'),
                         quantity, movement_date (timestamp_ntz)
=======================  ====================================================

The derivation is a plain projection of each source table (no joins on the
large facts), so it costs one scan and keeps parquet pushdown/pruning: Spark
folds these projections into the operators' own plans.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from storepulse.operators.presence import STORED, bitmap_of

RETAIL_TABLES = (
    "sales_transactions",
    "sales_transaction_items",
    "products",
    "categories",
    "suppliers",
    "promotions",
    "promotion_products",
    "inventory_movements",
)

# Fixed fixture values: one promotion per group of parts (part key modulo 12),
# the first starting 1995-06-01, one every 180 days, each running 30 days.
PROMO_GROUPS = 12
PROMO_FIRST_START = _dt.date(1995, 6, 1)
PROMO_STEP_DAYS = 180
PROMO_LENGTH_DAYS = 30


def _cents(x):
    return F.floor(x * F.lit(100.0) + F.lit(0.5)).cast("bigint")


def transactions_from_orders(orders: DataFrame) -> DataFrame:
    """sales_transactions from orders (also usable on a streaming frame).
    Order dates carry no time of day; a deterministic minute offset spreads
    them over the day."""
    return orders.select(
        F.col("o_orderkey").alias("id"),
        (F.col("o_orderdate") + F.make_dt_interval(
            mins=((F.col("o_orderkey") * 37) % 1440).cast("int"))).alias("transaction_date"),
        _cents(F.col("o_totalprice")).alias("total_cents"),
    )


def items_from_lineitem(lineitem: DataFrame, *more) -> DataFrame:
    """sales_transaction_items from lineitem (batch or streaming), with more
    columns if wanted."""
    return lineitem.select(
        F.col("l_orderkey").alias("transaction_id"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_quantity").cast("bigint").alias("quantity"),
        _cents(F.col("l_extendedprice") / F.col("l_quantity")).alias("unit_cents"),
        _cents(F.col("l_extendedprice") * (F.lit(1) - F.col("l_discount"))).alias("total_cents"),
        _cents(F.col("l_extendedprice") * F.col("l_discount")).alias("discount_cents"),
        F.when(F.col("l_discount") >= F.lit(0.05), F.col("l_partkey") % PROMO_GROUPS + 1).alias("promotion_id"),
        *more,
    )


def movements_from_lineitem(lineitem: DataFrame) -> DataFrame:
    """inventory_movements from lineitem (batch or streaming)."""
    return lineitem.select(
        F.col("l_partkey").alias("product_id"),
        F.when(F.col("l_returnflag") == "R", "inbound").otherwise("outbound").alias("movement_type"),
        F.col("l_quantity").cast("bigint").alias("quantity"),
        F.col("l_shipdate").alias("movement_date"),
    )


def retail_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Build the eight retail DataFrames over ``{sf_dir}/<table>.parquet``."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    supplier = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    lineitem = spark.read.parquet(f"{sf_dir}/lineitem.parquet")

    # p_type has a handful of values: the ranking window runs on the distinct
    # set only.
    categories = (part.select(F.col("p_type").alias("name")).distinct()
                  .select(F.dense_rank().over(Window.orderBy("name")).cast("bigint").alias("id"), "name"))

    suppliers = supplier.select(
        F.col("s_suppkey").alias("id"),
        F.col("s_name").alias("name"),
        F.concat(F.lit("Contact "), F.col("s_suppkey").cast("string")).alias("contact_person"),
        F.concat(F.lit("555-"), F.col("s_suppkey").cast("string")).alias("phone"),
        (F.col("s_suppkey") % 10 != 9).alias("is_active"),
    )

    n_sup = supplier.agg(F.count(F.lit(1)).alias("n_sup"))  # one row
    # categories: joined by size-checked AQE planning (broadcast only when
    # the runtime size is under the threshold); n_sup is one row.
    products = (part.join(categories.withColumnRenamed("name", "p_type")
                          .withColumnRenamed("id", "category_id"), "p_type")
                .crossJoin(F.broadcast(n_sup))
                .select(
                    F.col("p_partkey").alias("id"),
                    F.col("p_name").alias("name"),
                    F.concat(F.lit("SKU-"), F.col("p_partkey").cast("string")).alias("sku"),
                    F.col("category_id"),
                    F.when(F.col("p_partkey") % 50 == 0, F.lit(None).cast("bigint"))
                     .otherwise(F.col("p_partkey") % F.col("n_sup")).alias("supplier_id"),
                    ((F.col("p_partkey") * 37) % 119).alias("current_stock"),
                    (F.lit(20) + F.col("p_size") % 20).cast("bigint").alias("reorder_level"),
                    F.lit(100).cast("bigint").alias("max_stock_level"),
                    F.floor(F.col("p_retailprice") * F.lit(60.0) + F.lit(0.5)).cast("bigint").alias("cost_cents"),
                    (F.col("p_partkey") % 20 != 0).alias("is_active"),
                ))

    transactions = transactions_from_orders(orders)
    items = items_from_lineitem(lineitem)

    i = F.col("id")
    start = F.date_add(F.lit(PROMO_FIRST_START), ((i - 1) * PROMO_STEP_DAYS).cast("int"))
    groups = part.select((F.col("p_partkey") % PROMO_GROUPS + 1).alias("id")).distinct()
    promotions = groups.select(
        i,
        F.concat(F.lit("Promo "), i.cast("string")).alias("name"),
        F.when(i % 3 == 0, "discount").when(i % 3 == 1, "bogo").otherwise("loyalty").alias("promotion_type"),
        (F.lit(5) + 2 * i).cast("bigint").alias("discount_percentage"),
        start.alias("start_date"),
        F.date_add(start, PROMO_LENGTH_DAYS).alias("end_date"),
        (i % 6 != 0).alias("is_active"),
        F.date_sub(start, 7).alias("created_at"),
    )

    promotion_products = part.filter(F.col("p_partkey") % 5 == 0).select(
        (F.col("p_partkey") % PROMO_GROUPS + 1).alias("promotion_id"), F.col("p_partkey").alias("product_id"))

    movements = movements_from_lineitem(lineitem)

    return {
        "sales_transactions": transactions,
        "sales_transaction_items": items,
        "products": products,
        "categories": categories,
        "suppliers": suppliers,
        "promotions": promotions,
        "promotion_products": promotion_products,
        "inventory_movements": movements,
    }


DIMENSIONS = ("products", "categories", "suppliers", "promotions", "promotion_products")


def cache_dimensions(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Persist the dimension tables (MEMORY_AND_DISK: evicted or lost blocks
    are re-read or recomputed from lineage).  They are read by most
    operators and are orders of magnitude smaller than the facts, which are
    left as scans so their date filters keep reaching the files."""
    from pyspark import StorageLevel
    out = dict(tables)
    for name in DIMENSIONS:
        out[name] = tables[name].persist(StorageLevel.MEMORY_AND_DISK)
    return out


# ---------------------------------------------------------------- canonical layout (ETL)
DATE_COLUMNS = {"sales_transactions": "transaction_date", "sales_transaction_items": "transaction_date",
                "inventory_movements": "movement_date"}


BUCKET_KEYS = {"sales_transactions": "id", "sales_transaction_items": "transaction_id"}


def materialize_retail(tables: dict[str, DataFrame], out_dir: str, partitions: int | None = None,
                       buckets: int | None = None, table_prefix: str | None = None) -> dict[str, DataFrame]:
    """Write the retail tables once in the layout the operators want at scale
    and return them read back.

    * fact tables are range-partitioned and sorted by their date, so every
      file / row group covers a narrow date range and a date window is a
      pushed-down parquet filter that skips most of the data;
    * item rows carry their transaction's date (denormalised), so the big
      item scan is pruned by the same window before the join;
    * item rows without a transaction stay, with a null date;
    * the products that occur in a fact at all are kept as a bitmap beside it;
    * with ``buckets=n`` and a ``table_prefix`` transactions and items are
      instead written as bucketed tables ``<table_prefix>_<name>`` (n buckets
      on the transaction id, each sorted by date): the item/transaction join
      then reads co-located buckets with no shuffle, and row groups still
      carry tight date ranges; ``load_retail`` with the same prefix reads them;
    * each table is written with ``mode('overwrite')`` -- a failed run is
      simply re-run.
    """
    if buckets and not table_prefix:
        raise ValueError("bucketed tables need a table_prefix")
    spark = next(iter(tables.values())).sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    tx = tables["sales_transactions"]
    dated_items = tables["sales_transaction_items"].join(
        tx.select(F.col("id").alias("transaction_id"), "transaction_date"), "transaction_id", "left")
    prepared = dict(tables)
    prepared["sales_transaction_items"] = dated_items
    # one bitmap of product ids per fact, see operators.presence
    prepared.update({STORED[fact]: bitmap_of(tables[fact]) for fact in STORED})
    out = {}
    for name, df in prepared.items():
        date_col = DATE_COLUMNS.get(name)
        path = f"{out_dir}/{name}"
        if buckets and name in BUCKET_KEYS:
            table = f"{table_prefix}_{name}"
            (df.write.mode("overwrite").option("path", path)
             .bucketBy(buckets, BUCKET_KEYS[name]).sortBy(date_col).saveAsTable(table))
            out[name] = spark.table(table)
            continue
        if date_col:
            df = df.repartitionByRange(n, date_col).sortWithinPartitions(date_col)
        df.write.mode("overwrite").parquet(path)
        out[name] = spark.read.parquet(path)
    return out


def load_retail(spark: SparkSession, folder: str, table_prefix: str | None = None) -> dict[str, DataFrame]:
    """Read tables written by ``materialize_retail``; with its
    ``table_prefix`` the bucketed ones as tables, so their buckets are used."""
    return {name: spark.table(f"{table_prefix}_{name}") if table_prefix and name in BUCKET_KEYS
            else spark.read.parquet(f"{folder}/{name}") for name in (*RETAIL_TABLES, *STORED.values())}
