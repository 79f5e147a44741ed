"""Cases that lose or mix rows when handled carelessly."""

import datetime as dt

import pytest

from oracles.compare import canonical
from storepulse import session
from storepulse.operators import category, inventory, promo, sales, traffic, trends
from storepulse.sources.report import write_report_bundle
from storepulse.sources.retail import load_retail, materialize_retail, retail_tables
from storepulse.sources.tables import load_tables, schema_profile
from tests.conftest import SF_SMALL
from tests.micro import item, make, product, ts

AS_OF = "2024-03-10 12:00:00"


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_report_sections_with_equal_starts_keep_their_rows(spark):
    folder = session.shared_dir(spark, "report")
    title = "Sales by category and by region, "
    sections = {title + "part one": spark.range(3), title + "part two": spark.range(5),
                title + "part-one": spark.range(4), "empty": spark.range(0)}
    manifest = rows(write_report_bundle(spark, "R", sections, folder, AS_OF))
    assert {m["section"]: m["row_count"] for m in manifest} == {
        title + "part one": 3, title + "part two": 5, title + "part-one": 4}
    assert len({m["folder"] for m in manifest}) == 3 and len({m["sheet_name"] for m in manifest}) < 3
    for m in manifest:
        assert spark.read.parquet(f"{folder}/{m['folder']}").count() == m["row_count"]
    with pytest.raises(Exception):  # noqa: B017 - the empty section leaves no folder
        spark.read.parquet(f"{folder}/03_empty")


def test_report_as_csv_with_text_dates(spark):
    folder = session.shared_dir(spark, "report")
    df = spark.createDataFrame([(1, ts(AS_OF))], "id int, at timestamp_ntz")
    manifest = rows(write_report_bundle(spark, "R", {"A": df}, folder, AS_OF, fmt="csv", pdf_dates=True))
    assert spark.read.option("header", True).csv(f"{folder}/{manifest[0]['folder']}").first()["at"] == "2024-03-10"


def test_items_without_transaction_survive_the_canonical_layout(spark):
    r = make(spark, products=[product(1), product(2)], sales_transactions=[(1, ts("2024-03-09 10:00:00"), 500)],
             sales_transaction_items=[item(1, 1, 5), item(99, 2, 7)])
    canon = materialize_retail(r, session.shared_dir(spark, "orphans"), partitions=2)
    assert canon["sales_transaction_items"].count() == 2
    for op in (inventory.critical_inventory, inventory.restock_recommendations):
        a, b = op(r, AS_OF), op(canon, AS_OF)
        assert canonical([tuple(x) for x in a.collect()], a.columns) == canonical([tuple(x) for x in b.collect()], b.columns)
    sold = {x["product_name"]: x["sales_last_30_days"] for x in rows(inventory.critical_inventory(canon, AS_OF))}
    assert sold == {"P1": 5, "P2": 7}


def test_bucketed_tables_are_found_again_by_their_prefix(spark, retail):
    folder = session.shared_dir(spark, "again")
    materialize_retail(retail, folder, partitions=2, buckets=2, table_prefix="edges")
    back = load_retail(spark, folder, "edges")
    assert back["sales_transaction_items"].count() == retail["sales_transaction_items"].count()
    with pytest.raises(ValueError):
        materialize_retail(retail, folder, buckets=2)


def test_no_shared_folder_is_an_error():
    class Bare:
        conf = {"spark.master": "local"}
        sparkContext = type("C", (), {"getCheckpointDir": staticmethod(lambda: None)})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(Bare())


def test_trend_summary_takes_one_row(spark):
    """A name in two categories: both groups hold both total rows, and the
    summary may not mix them."""
    days = [ts("2024-03-01 10:00:00"), ts("2024-03-02 10:00:00"), ts("2024-03-03 10:00:00")]
    r = make(spark, products=[product(1, "Tea", 1), product(2, "Tea", 2)],
             sales_transactions=[(i, d, 100) for i, d in enumerate(days)],
             sales_transaction_items=[item(0, 1, 90), item(0, 2, 10), item(1, 2, 10), item(2, 2, 10)])
    out = rows(sales.product_trend_summary(sales.product_sales_trends(r, AS_OF, 30, 10)))
    assert len(out) == 2
    for x in out:
        assert (x["total_quantity"], x["avg_daily_quantity"], x["days_with_sales"]) == (90, 90.0, 1)


def test_unknown_promotion_gives_one_row(spark, retail):
    assert rows(promo.promotion_comparison(retail, 999)) == [{
        "revenue_before": None, "quantity_before": None, "transactions_before": 0,
        "revenue_during": None, "quantity_during": None, "transactions_during": 0}]


def test_promotions_come_from_the_given_tables(spark):
    r = retail_tables(spark, SF_SMALL)
    for df in (promo.active_promotions(r), promo.promotion_dates(r, 5)):
        assert "part.parquet" in df._jdf.queryExecution().toString()


def test_range_view_keeps_best_sellers_when_shown_by_growth(spark, retail):
    args = ("2001-08-02", 30, "All Categories", 5, "1996-01-01", "1998-12-31")
    by_growth = category.popular_products_view(retail, args[0], args[1], "growth_rate", *args[2:])
    by_units = category.popular_products_view(retail, args[0], args[1], "total_sold", *args[2:])
    assert sorted(map(tuple, by_growth.collect())) == sorted(map(tuple, by_units.collect()))
    growth = [x["growth_rate"] for x in by_growth.collect()]
    assert growth == sorted(growth, reverse=True)


def test_layers_of_different_periods_are_refused(spark, retail):
    day = traffic.customer_traffic(retail, AS_OF, "day", "1996-01-01", "1996-02-01")
    with pytest.raises(ValueError):
        traffic.traffic_layer_compare([("A", day, "day"), ("B", day, "week")])


def test_month_steps_from_a_month_end():
    steps = trends.spine_days("monthly", "2001-01-31", "2001-03-30")
    assert steps == [dt.date(2001, 1, 31), dt.date(2001, 2, 28), dt.date(2001, 3, 28)]
    assert trends.spine_days("quarterly", "2000-11-30", "2001-06-01") == [
        dt.date(2000, 11, 30), dt.date(2001, 2, 28), dt.date(2001, 5, 28)]


def test_rows_after_as_of_do_not_count(spark):
    r = make(spark, sales_transactions=[(1, ts("2024-03-09 10:00:00"), 100), (2, ts("2024-03-11 10:00:00"), 100)])
    assert sales.sales_trend(r, AS_OF, 30).count() == 1


def test_schema_profile_shows_missing_tables(spark):
    r = make(spark)
    del r["promotions"]
    out = rows(schema_profile(r))
    assert [x["table_name"] for x in out if x["is_missing"]] == ["promotions"]


def test_fact_tables_over_jdbc_need_bounds(spark):
    with pytest.raises(ValueError, match="sales_transactions"):
        load_tables(spark, {"url": "jdbc:none"}, ["sales_transactions"])
