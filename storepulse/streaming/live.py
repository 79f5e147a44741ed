"""Structured Streaming forms of the live-dashboard operators (ST1-ST5).

A dashboard that would poll "today" again and again is kept by streaming
aggregations over event-time windows: late rows inside the watermark still
update their window, older windows leave the state.  Batch operators A1-A6
stay the semantics to check against: on a closed input these streams give the
batch answer.

Sources are file streams over a folder (``pathGlobFilter`` picks the table
file).  In update mode every micro-batch writes the windows that changed to a
folder of its own epoch (``EpochLog``); a replayed epoch rewrites that folder.
Every few epochs the log is folded into a base folder, so the number of
folders stays bounded and readers never go through all epochs; nothing is
kept on the driver and a stopped stream goes on from its folder.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from storepulse.functions.columns import round_half_up
from storepulse.session import shared_dir
from storepulse.sources.retail import items_from_lineitem, movements_from_lineitem, retail_tables, transactions_from_orders

EVENT_WATERMARK = "2 hours"
FACT_WATERMARK = "1 day"
KEEP_EPOCHS = 8  # folders of single epochs after which they are folded into the base


# ---------------------------------------------------------------- sources / sink
def stream_table(spark: SparkSession, folder: str, table: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """A file stream over ``{folder}/{table}.parquet`` (and any later files
    matching the same name pattern)."""
    schema = spark.read.parquet(f"{folder}/{table}.parquet").schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", f"{table}*.parquet")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(folder)


class EpochLog:
    """Rows per epoch of a stream under ``folder``, folded now and then.

    ``batch-<e>`` holds the rows of epoch e, ``base-<e>`` what ``fold`` makes
    of all rows up to and including epoch e.  Writing an epoch again gives the
    same folders: a base of that epoch is dropped first, and folders that a
    base stands for are only removed while a later epoch is written, when the
    epoch of that base can no longer be replayed.  A folder counts once its
    write has succeeded (``_SUCCESS``).
    """

    def __init__(self, spark: SparkSession, folder: str, schema: StructType,
                 fold: Callable[[DataFrame], DataFrame], keep: int = KEEP_EPOCHS):
        self.spark, self.folder, self.fold, self.keep = spark, folder, fold, keep
        self.schema = StructType([*schema.fields, StructField("epoch", LongType())])
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        self.files = path.getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _epochs(self, kind: str) -> list[int]:
        """Epochs of the complete folders of a kind, ascending."""
        if not self.files.exists(self._path("")):
            return []
        names = [f.getPath().getName() for f in self.files.listStatus(self._path(""))]
        return sorted(int(n.split("-")[1]) for n in names
                      if n.startswith(f"{kind}-") and self.files.exists(self._path(f"{n}/_SUCCESS")))

    def _drop(self, kind: str, epochs) -> None:
        for e in epochs:
            self.files.delete(self._path(f"{kind}-{e}"), True)

    def write(self, rows: DataFrame, epoch: int) -> None:
        """Store the rows of an epoch; fold if there are enough epochs."""
        self._drop("base", [e for e in self._epochs("base") if e >= epoch])
        bases = self._epochs("base")
        if bases:
            self._drop("batch", [e for e in self._epochs("batch") if e <= bases[-1]])
            self._drop("base", bases[:-1])
        rows.withColumn("epoch", F.lit(epoch).cast("long")).select(self.schema.names).write.mode("overwrite").parquet(f"{self.folder}/batch-{epoch}")
        if len([e for e in self._epochs("batch") if e <= epoch]) >= self.keep:
            self.read(epoch).write.mode("overwrite").parquet(f"{self.folder}/base-{epoch}")

    def read(self, upto: int | None = None, where=None) -> DataFrame:
        """The folded rows (of epochs up to ``upto``)."""
        bases = [e for e in self._epochs("base") if upto is None or e < upto]
        last = bases[-1] if bases else -1
        paths = [f"{self.folder}/base-{e}" for e in bases[-1:]]
        paths += [f"{self.folder}/batch-{e}" for e in self._epochs("batch") if e > last and (upto is None or e <= upto)]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(self.schema).parquet(*paths)
        return self.fold(rows if where is None else rows.filter(where)).select(self.schema.names)


def newest(keys: list[str]) -> Callable[[DataFrame], DataFrame]:
    """Fold to the last version of each key."""
    def fold(rows: DataFrame) -> DataFrame:
        values = [c for c in rows.columns if c not in keys]
        return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "epoch").alias("v")).select(*keys, "v.*")
    return fold


def summed(keys: list[str]) -> Callable[[DataFrame], DataFrame]:
    """Fold to the sums of each key."""
    def fold(rows: DataFrame) -> DataFrame:
        values = [c for c in rows.columns if c not in keys and c != "epoch"]
        return rows.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in values], F.max("epoch").alias("epoch"))
    return fold


def run_stream(stream: DataFrame, name: str, output_mode: str = "update",
               keys: list[str] | None = None, folder: str | None = None) -> DataFrame:
    """Run a streaming aggregation until the available input is consumed and
    return its result so far.

    ``folder`` holds the stream's checkpoint and result and is given by the
    caller of a long-running stream: a later call with the same folder reads
    only new input and adds to the same result.  Without one (closed input) a
    new folder under the shared checkpoint location is taken.

    ``update``: each micro-batch carries only the windows that changed (by
    ``keys``, default: the window).  ``append``: windows are emitted once the
    watermark passes them, by the exactly-once parquet file sink.
    """
    spark = stream.sparkSession
    base = folder or shared_dir(spark, "stream", name)
    out = f"{base}/result"
    writer = stream.writeStream.outputMode(output_mode).option("checkpointLocation", f"{base}/checkpoint")
    if output_mode == "append":
        writer.format("parquet").option("path", out).trigger(availableNow=True).start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(out)
    if output_mode != "update":
        raise ValueError("a stream runs in update or append mode")
    log = EpochLog(spark, out, stream.schema, newest(keys or ["window"]))
    writer.foreachBatch(log.write).trigger(availableNow=True).start().awaitTermination()
    return log.read().drop("epoch")


def _purchases(spark: SparkSession, folder: str, max_files_per_trigger: int | None = None) -> DataFrame:
    ev = stream_table(spark, folder, "events", max_files_per_trigger)
    return (ev.filter(F.col("event_type") == "purchase")
            .select("event_id", F.col("ts").cast("timestamp").alias("ts"), "value")
            .withWatermark("ts", EVENT_WATERMARK))


def _bounds(window_col: str = "window"):
    return [F.col(f"{window_col}.start").cast("timestamp_ntz").alias("window_start"),
            F.col(f"{window_col}.end").cast("timestamp_ntz").alias("window_end")]


# ---------------------------------------------------------------- ST1 / ST2 / ST4 (events)
def stream_hourly_sales(spark: SparkSession, folder: str, output_mode: str = "update",
                        state: str | None = None) -> DataFrame:
    """ST1 (A2): purchase revenue and count per 1-hour event-time window."""
    agg = (_purchases(spark, folder).groupBy(F.window("ts", "1 hour"))
           .agg(F.sum("value").alias("rev"), F.count(F.lit(1)).alias("items_sold")))
    res = run_stream(agg, "hourly-sales", output_mode, folder=state)
    return res.select(*_bounds(), F.hour(F.col("window.start").cast("timestamp_ntz")).cast("bigint").alias("hour"),
                      round_half_up(F.col("rev"), 6).alias("hourly_revenue"), "items_sold")


def stream_daily_dashboard(spark: SparkSession, folder: str, output_mode: str = "update",
                           max_files_per_trigger: int | None = None, state: str | None = None) -> DataFrame:
    """ST2 (A1): per day -- purchases, revenue and average ticket."""
    agg = (_purchases(spark, folder, max_files_per_trigger).groupBy(F.window("ts", "1 day"))
           .agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("rev")))
    res = run_stream(agg, "daily-dashboard", output_mode, folder=state)
    return res.select(F.to_date(F.col("window.start").cast("timestamp_ntz")).alias("day"),
                      F.col("n").alias("todays_transactions"),
                      round_half_up(F.col("rev"), 6).alias("todays_revenue"),
                      round_half_up(F.col("rev") / F.col("n").cast("double"), 6).alias("avg_transaction_value"))


def stream_traffic(spark: SparkSession, folder: str, bucket: str = "1 hour", state: str | None = None) -> DataFrame:
    """ST4 (M16 hour/day buckets): distinct purchase transactions per
    window; exact distinct counting is replaced by de-duplicating the event
    ids inside the watermark, then counting."""
    dedup = _purchases(spark, folder).dropDuplicatesWithinWatermark(["event_id"])
    agg = (dedup.groupBy(F.window("ts", bucket))
           .agg(F.count(F.lit(1)).alias("transaction_count"), F.sum("value").alias("rev")))
    res = run_stream(agg, "traffic", folder=state)
    return res.select(*_bounds(), "transaction_count", round_half_up(F.col("rev"), 6).alias("total_revenue"))


# ---------------------------------------------------------------- ST3 / ST5 (retail facts)
def lines_as_sold(items: DataFrame, tx: DataFrame, early: str, late: str, delay: str) -> DataFrame:
    """Item rows (transaction_id, item_ts, ...) with their transaction (id,
    ts), both streams, each up to ``delay`` late.  An item belongs to its
    transaction if it is recorded between ``early`` before and ``late`` after
    it; so either side waits in the state for the other only until the
    watermarks have passed that bound, and is evicted then."""
    items = items.withWatermark("item_ts", delay)
    tx = tx.withWatermark("ts", delay)
    return items.join(tx, (F.col("transaction_id") == F.col("id"))
                      & (F.col("item_ts") >= F.col("ts") - F.expr(f"INTERVAL {early}"))
                      & (F.col("item_ts") <= F.col("ts") + F.expr(f"INTERVAL {late}")))


def stream_top_products(spark: SparkSession, folder: str, limit: int = 5, state: str | None = None,
                        early: str = "1 hour", late: str = "1 hour", delay: str = FACT_WATERMARK,
                        max_files_per_trigger: int | None = None, progress: list | None = None) -> DataFrame:
    """ST3 (A5): per day the ``limit`` products sold most, kept up to date from
    both streams, items and transactions (``lines_as_sold``; an item's own
    time is its record date).

    A stream-stream join emits each matched line once.  Every micro-batch adds
    the sums of its lines per (day, product) to one log, reads back the sums
    of the days that it touched, ranks them, and stores these days' new lists
    in another log; both logs are folded every few epochs.  Per epoch the work
    is that of the touched days.  ``progress`` collects the stream's progress
    reports."""
    base = state or shared_dir(spark, "stream", "top-products")
    tx = transactions_from_orders(stream_table(spark, folder, "orders", max_files_per_trigger)).select(
        "id", F.col("transaction_date").cast("timestamp").alias("ts"))
    items = items_from_lineitem(stream_table(spark, folder, "lineitem", max_files_per_trigger),
                                F.col("l_shipdate").cast("timestamp").alias("item_ts"))
    lines = lines_as_sold(items, tx, early, late, delay)
    lines = lines.select(F.to_date("ts").alias("day"), "product_id", "quantity", "total_cents")
    key = ["day", "product_id"]
    sums = EpochLog(spark, f"{base}/sums", spark.createDataFrame(
        [], "day date, product_id long, quantity_sold long, cents long").schema, summed(key))
    lists = EpochLog(spark, f"{base}/lists", spark.createDataFrame(
        [], "day date, rank long, product_id long, quantity_sold long, cents long").schema, newest(["day", "rank"]))

    def changes(batch: DataFrame, epoch: int) -> None:
        new = batch.groupBy(*key).agg(F.sum("quantity").alias("quantity_sold"), F.sum("total_cents").alias("cents"))
        sums.write(new, epoch)
        own = spark.read.schema(sums.schema).parquet(f"{base}/sums/batch-{epoch}").select("day").distinct()
        first, last = own.agg(F.min("day"), F.max("day")).first()
        if first is None:  # nothing matched: no list changes
            return
        total = sums.read(epoch, F.col("day").between(F.lit(first), F.lit(last))).join(own, "day", "left_semi")
        rank = F.row_number().over(Window.partitionBy("day").orderBy(F.col("quantity_sold").desc(), F.col("product_id")))
        lists.write(total.drop("epoch").withColumn("rank", rank.cast("long")).filter(F.col("rank") <= limit), epoch)

    query = (lines.writeStream.outputMode("append").option("checkpointLocation", f"{base}/checkpoint")
             .foreachBatch(changes).trigger(availableNow=True).start())
    query.awaitTermination()
    if progress is not None:
        progress.extend(query.recentProgress)
    names = retail_tables(spark, folder)["products"].select(F.col("id").alias("product_id"), F.col("name").alias("product_name"))
    return (lists.read().join(names, "product_id")
            .select("day", "rank", "product_name", "quantity_sold", (F.col("cents").cast("double") / 100.0).alias("revenue")))


def stream_movement_totals(spark: SparkSession, folder: str, state: str | None = None) -> DataFrame:
    """ST5 (R6): inbound / outbound quantity per category and day from the
    movement stream joined to the static product -> category mapping."""
    r = retail_tables(spark, folder)
    mv = movements_from_lineitem(stream_table(spark, folder, "lineitem"))
    cats = (r["products"].select(F.col("id").alias("product_id"), "category_id")
            .join(r["categories"].select(F.col("id").alias("category_id"), F.col("name").alias("category")),
                  "category_id"))
    out, inn = F.col("movement_type") == "outbound", F.col("movement_type") == "inbound"
    agg = (mv.join(cats, "product_id")
           .withColumn("ts", F.col("movement_date").cast("timestamp"))
           .withWatermark("ts", FACT_WATERMARK)
           .groupBy(F.window("ts", "1 day"), "category")
           .agg(F.sum(F.when(out, F.col("quantity")).otherwise(0)).alias("total_outbound"),
                F.sum(F.when(inn, F.col("quantity")).otherwise(0)).alias("total_inbound")))
    res = run_stream(agg, "movement-totals", keys=["window", "category"], folder=state)
    return res.select(F.to_date(F.col("window.start").cast("timestamp_ntz")).alias("day"), "category",
                      F.col("total_outbound").cast("bigint").alias("total_outbound"),
                      F.col("total_inbound").cast("bigint").alias("total_inbound"))
