"""Hand-made retail frames for edge-case tests."""

from __future__ import annotations

import datetime as dt

SCHEMAS = {
    "sales_transactions": "id bigint, transaction_date timestamp_ntz, total_cents bigint",
    "sales_transaction_items": ("transaction_id bigint, product_id bigint, quantity bigint, unit_cents bigint, "
                                "total_cents bigint, discount_cents bigint, promotion_id bigint"),
    "products": ("id bigint, name string, sku string, category_id bigint, supplier_id bigint, current_stock bigint, "
                 "reorder_level bigint, max_stock_level bigint, cost_cents bigint, is_active boolean"),
    "categories": "id bigint, name string",
    "suppliers": "id bigint, name string, contact_person string, phone string, is_active boolean",
    "promotions": ("id bigint, name string, promotion_type string, discount_percentage bigint, start_date date, "
                   "end_date date, is_active boolean, created_at date"),
    "promotion_products": "promotion_id bigint, product_id bigint",
    "inventory_movements": "product_id bigint, movement_type string, quantity bigint, movement_date timestamp_ntz",
}


def ts(s: str) -> dt.datetime:
    return dt.datetime.fromisoformat(s)


def product(pid, name=None, category_id=1, supplier_id=1, stock=50, reorder=20, max_stock=100, cost=100,
            active=True):
    return (pid, name or f"P{pid}", f"SKU-{pid}", category_id, supplier_id, stock, reorder, max_stock, cost, active)


def item(tx, pid, qty=1, unit=100, promo=None):
    return (tx, pid, qty, unit, qty * unit, 0, promo)


def make(spark, **rows) -> dict:
    """Retail tables from row lists; missing tables are empty (categories
    and suppliers get one default row)."""
    defaults = {
        "categories": [(1, "Cat A"), (2, "Cat B")],
        "suppliers": [(1, "Sup 1", "Contact 1", "555-1", True)],
    }
    out = {}
    for name, schema in SCHEMAS.items():
        data = rows.get(name, defaults.get(name, []))
        out[name] = spark.createDataFrame(data, schema)
    return out
