"""Stream-stream top products, and the epoch log behind the streams."""

import datetime as dt

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from storepulse.streaming import live
from tests.conftest import SF_SMALL

DAY = dt.datetime(2024, 3, 1)


def copy_table(name, folder, parts=1, order=None):
    """The table as ``parts`` files."""
    table = pq.read_table(f"{SF_SMALL}/{name}.parquet")
    if order:
        table = table.sort_by(order)
    step = -(-table.num_rows // parts)
    for k in range(parts):
        pq.write_table(table.slice(k * step, step), f"{folder}/{name}{'' if k == 0 else f'_{k}'}.parquet")


def listed(df):
    return sorted(map(tuple, df.select("day", "rank", "product_name", "quantity_sold", "revenue").collect()))


def dimensions(folder):
    for name in ("part", "supplier"):
        copy_table(name, folder)


def test_top_products_follow_both_tables_in_several_batches(spark, tmp_path):
    """Orders and lines as files of several batches, lines before their orders
    and after them, stopped and started again: the batch answer."""
    from oracles.compare import compare, duck
    from oracles.queries_sql import ORACLES
    folder, state, held = tmp_path / "in", str(tmp_path / "state"), tmp_path / "held"
    folder.mkdir()
    held.mkdir()
    dimensions(folder)
    copy_table("orders", folder, 3)
    copy_table("lineitem", folder, 4, "l_partkey")
    for name in ("orders_2.parquet", "lineitem_3.parquet"):  # these come after the stop
        table = pq.read_table(folder / name)
        pq.write_table(table, held / name)
        pq.write_table(table.slice(0, 0), folder / name)
    wide = {"early": "2600 days", "late": "2600 days", "delay": "6000 days", "max_files_per_trigger": 1, "state": state}
    first = live.stream_top_products(spark, str(folder), **wide)
    assert first.count() > 0 and compare(first, duck(SF_SMALL), ORACLES["stream_top_products"])
    for name in ("orders_2.parquet", "lineitem_3.parquet"):
        pq.write_table(pq.read_table(held / name), folder / f"{name[:-8]}_late.parquet")
    again = live.stream_top_products(spark, str(folder), **wide)
    assert not compare(again, duck(SF_SMALL), ORACLES["stream_top_products"])
    assert not compare(live.stream_top_products(spark, str(folder), **wide), duck(SF_SMALL), ORACLES["stream_top_products"])  # nothing new
    epochs = [p.name for p in (tmp_path / "state" / "sums").iterdir()]
    assert len(epochs) >= 4


def files_of(folder, table, rows, number):
    names = {"orders": ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"),
             "lineitem": ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
                          "l_returnflag", "l_linestatus", "l_shipdate")}[table]
    schema = pq.read_schema(f"{SF_SMALL}/{table}.parquet")
    columns = [pa.array([r[k] for r in rows], schema.field(n).type) for k, n in enumerate(names)]
    name = f"{table}.parquet" if number == 0 else f"{table}_{number}.parquet"
    pq.write_table(pa.Table.from_arrays(columns, list(names)), f"{folder}/{name}")


def order(key, day):
    return (key, 1, "O", 10.0, DAY + dt.timedelta(days=day), "1")


def line(key, product, quantity, day, minutes=0):
    return (key, product, 1, 1, float(quantity), 2.0 * quantity, 0.0, 0.0, "N", "O", DAY + dt.timedelta(days=day, minutes=minutes))


def test_state_is_evicted_and_late_rows_are_kept_inside_the_watermark(spark, tmp_path):
    folder, state = tmp_path / "in", str(tmp_path / "state")
    folder.mkdir()
    dimensions(folder)
    n = 40
    files_of(folder, "orders", [order(1440 * k, k) for k in range(2)], 0)  # key * 37 % 1440 = 0: midnight
    files_of(folder, "lineitem", [line(0, 3, 5, 0, 10)], 0)
    progress = []
    options = {"early": "1 hour", "late": "1 hour", "delay": "1 day", "state": state, "progress": progress}
    assert [r["quantity_sold"] for r in live.stream_top_products(spark, str(folder), **options).collect()] == [5]
    # the line of order 1 comes late but inside the watermark, one line outside the bound of an hour
    files_of(folder, "lineitem", [line(1440, 4, 7, 1, 30), line(0, 3, 1, 0, 90)], 1)
    files_of(folder, "orders", [order(1440 * k, k) for k in range(2, n)], 1)
    got = live.stream_top_products(spark, str(folder), **options)
    assert sorted(r["quantity_sold"] for r in got.collect()) == [5, 7]
    for k in range(2, 5):  # the watermark moves on; a line far behind it is dropped
        files_of(folder, "lineitem", [line(1440 * (n - 2), 5, 1, n - 2, k)] + [line(1440, 4, 100, 1, 20)] * (k > 2), k)
        files_of(folder, "orders", [order(1440 * (n + k), n + k)], k)
        got = live.stream_top_products(spark, str(folder), **options)
    rows = {(r["day"], r["rank"]): r["quantity_sold"] for r in got.collect()}
    assert rows[((DAY + dt.timedelta(days=1)).date(), 1)] == 7  # 107 if the late line had counted
    assert rows[((DAY + dt.timedelta(days=n - 2)).date(), 1)] == 3
    joins = [s for p in progress for s in p["stateOperators"] if "Join" in s["operatorName"]]
    assert max(s["numRowsTotal"] for s in joins) > 30
    assert joins[-1]["numRowsTotal"] < 10  # orders of the first month left the state
    assert sum(s["numRowsDroppedByWatermark"] for s in joins) >= 1


def test_no_batch_scan_of_the_facts(spark, tmp_path):
    tx = spark.readStream.schema("id long, ts timestamp").parquet(str(tmp_path))
    items = spark.readStream.schema("transaction_id long, item_ts timestamp, product_id long").parquet(str(tmp_path))
    joined = live.lines_as_sold(items, tx, "1 hour", "1 hour", "1 day")
    assert joined.isStreaming
    text = joined._jdf.queryExecution().analyzed().toString()
    assert text.count("EventTimeWatermark") == 2 and text.count("StreamingRelation") == 2 and "Relation [" not in text.replace("StreamingRelation", "")


def log(spark, folder, fold, keep=5):
    return live.EpochLog(spark, folder, spark.createDataFrame([], "k long, v long").schema, fold, keep)


@pytest.mark.parametrize("kind", ["newest", "summed"])
def test_fifty_epochs_leave_few_folders(spark, tmp_path, kind):
    folder = str(tmp_path / "log")
    want, fold = {}, getattr(live, kind)(["k"])
    for e in range(50):
        rows = {e % 7: e, (3 * e) % 11 + 100: 1}
        store = log(spark, folder, fold)  # a new object each time: nothing is kept in it
        frame = spark.createDataFrame(list(rows.items()), "k long, v long").coalesce(1)
        store.write(frame, e)
        if e % 13 == 4:  # replayed, also right after folding
            store.write(frame, e)
        for k, v in rows.items():
            want[k] = v + (want.get(k, 0) if kind == "summed" else 0)
        if e % 9 == 0:
            assert {r["k"]: r["v"] for r in store.read().collect()} == want
    names = [p.name for p in (tmp_path / "log").iterdir()]
    assert len(names) <= 5 + 5 + 2 and {r["k"]: r["v"] for r in log(spark, folder, fold).read().collect()} == want


def test_an_unfinished_folder_does_not_count(spark, tmp_path):
    folder = str(tmp_path / "log")
    store = log(spark, folder, live.summed(["k"]), keep=3)
    for e in range(4):
        store.write(spark.createDataFrame([(1, 1)], "k long, v long"), e)
    (tmp_path / "log" / "base-9").mkdir()
    (tmp_path / "log" / "batch-9").mkdir()
    assert [r["v"] for r in store.read().collect()] == [4]
    assert store.read(1).agg(F.sum("v")).first()[0] == 2 or store._epochs("base")
