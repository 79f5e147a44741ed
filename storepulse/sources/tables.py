"""Reading tables, parameterised SQL, schema profile."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REQUIRED_TABLES = ("promotions", "promotion_products", "sales_transaction_items", "sales_transactions")


FACT_TABLES = ("sales_transactions", "sales_transaction_items", "inventory_movements")


def load_tables(spark: SparkSession, source: str | dict, names=None,
                register_views: bool = True) -> dict[str, DataFrame]:
    """S1 ``load_tables``: read a named set of relational tables.

    ``source`` is either a folder holding ``<name>.parquet`` entries or a dict
    of JDBC options (``url``, ``user``, ``password``, ``driver`` ...; plus an
    optional ``partitions`` dict ``{table: (column, lower, upper, n)}`` so big
    tables are read by ``n`` parallel range queries instead of one).
    Each frame is also registered as a temp view when ``register_views``.
    """
    names = list(names or [])
    out: dict[str, DataFrame] = {}
    for name in names:
        if isinstance(source, str):
            df = spark.read.parquet(f"{source.rstrip('/')}/{name}.parquet")
        else:
            opts = {k: v for k, v in source.items() if k != "partitions"}
            reader = spark.read.format("jdbc").options(**opts).option("dbtable", name)
            part = (source.get("partitions") or {}).get(name)
            if part is None and name in FACT_TABLES:
                raise ValueError(f"give partitions[{name!r}] = (column, lower, upper, n): "
                                 "a fact table is not read through one connection")
            if part:
                col, lo, hi, n = part
                reader = (reader.option("partitionColumn", col).option("lowerBound", lo)
                          .option("upperBound", hi).option("numPartitions", n))
            df = reader.load()
        if register_views:
            df.createOrReplaceTempView(name)
        out[name] = df
    return out


def register(tables: dict[str, DataFrame]) -> None:
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def run_sql(spark: SparkSession, sql: str, **args) -> DataFrame:
    """S2 ``parameterised_sql``: SQL text with named ``:markers`` bound by
    Spark (values are never formatted into the text)."""
    return spark.sql(sql, args=args or None)


def schema_profile(tables: dict[str, DataFrame], required=REQUIRED_TABLES) -> DataFrame:
    """S3 ``schema_profile``: one row per (table, column) in declared order
    with the column type, whether the table is one of the required set, and
    the table's row count; a required table that is absent yields one row
    with ``is_missing`` and no column.

    Row counts are one global count per table (map-side partial counts, one
    row each) unioned together -- never a driver loop over data.
    """
    spark = next(iter(tables.values())).sparkSession
    found = [(t, pos, f.name, f.dataType.simpleString(), t in required, False)
             for t, df in tables.items() for pos, f in enumerate(df.schema.fields, start=1)]
    absent = [(t, None, None, None, True, True) for t in missing_required(tables, required)]
    cols = spark.createDataFrame(found + absent, "table_name string, ordinal_position int, column_name string, "
                                                 "data_type string, is_required boolean, is_missing boolean")
    counts = reduce(DataFrame.unionByName,
                    [df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(t).alias("table_name"), "row_count")
                     for t, df in tables.items()])
    return (cols.join(F.broadcast(counts), "table_name", "left")  # one row a table
            .select("table_name", "ordinal_position", "column_name", "data_type", "row_count", "is_required", "is_missing"))


def missing_required(tables: dict[str, DataFrame], required=REQUIRED_TABLES) -> list[str]:
    """Names of required tables that are absent (catalog-level check)."""
    return [t for t in required if t not in tables]
