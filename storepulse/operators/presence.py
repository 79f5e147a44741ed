"""Which products have any row in a fact table, as bitmaps.

The reference's ``date >= x OR date IS NULL`` after a left join treats a
product without any fact row unlike one whose rows are all older.  A bitmap
over product ids answers "any row at all" without reading old rows again: one
row per bucket of 32,768 ids, 4 KB each, kept beside the facts
(``materialize_retail``) and extended by ``add_rows``.  Where none is stored
it is built from the product column alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storepulse.operators.common import Tables

#: fact table -> name of its stored bitmap
STORED = {"sales_transaction_items": "sold_products", "inventory_movements": "moved_products"}


def bitmap_of(rows: DataFrame, column: str = "product_id") -> DataFrame:
    """bucket, bits of the ids in a column (combined before the shuffle)."""
    return (rows.filter(F.col(column).isNotNull()).groupBy(F.bitmap_bucket_number(column).alias("bucket"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position(column)).alias("bits")))


def add_rows(stored: DataFrame, rows: DataFrame, column: str = "product_id") -> DataFrame:
    """The bitmap with the ids of new rows; old rows are not read."""
    return stored.unionByName(bitmap_of(rows, column)).groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def presence(r: Tables, fact: str) -> DataFrame:
    """The stored bitmap of a fact table, or one made from its rows."""
    return r[STORED[fact]] if STORED[fact] in r else bitmap_of(r[fact])


def _bit(bits: Column, position: Column) -> Column:
    byte = F.conv(F.hex(F.substr(bits, (F.floor(position / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.call_function("shiftright", byte, (position % 8).cast("int")).bitwiseAND(F.lit(1)) == 1


def with_presence(products: DataFrame, r: Tables, fact: str, flag: str, column: str = "product_id") -> DataFrame:
    """``products`` with a boolean: has the product any row in the fact?"""
    bits = presence(r, fact).select(F.col("bucket").alias("bucket_"), F.col("bits").alias("bits_"))
    joined = products.withColumn("bucket_", F.bitmap_bucket_number(column)).join(bits, "bucket_", "left")
    return joined.withColumn(flag, F.coalesce(_bit(F.col("bits_"), F.bitmap_bit_position(column)), F.lit(False))).drop("bucket_", "bits_")
