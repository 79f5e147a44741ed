"""The retail view layer as a DuckDB WITH-clause prefix.

Money is BIGINT cents.  The prefix ends without a trailing comma; oracles
append ``, more_ctes AS (...) SELECT ...`` or just ``SELECT ...``.
"""

RETAIL = """
WITH categories AS (
    SELECT CAST(dense_rank() OVER (ORDER BY p_type) AS BIGINT) AS id, p_type AS name
    FROM (SELECT DISTINCT p_type FROM part) t
),
suppliers AS (
    SELECT s_suppkey AS id, s_name AS name,
           'Contact ' || CAST(s_suppkey AS VARCHAR) AS contact_person,
           '555-' || CAST(s_suppkey AS VARCHAR) AS phone,
           (s_suppkey % 10 <> 9) AS is_active
    FROM supplier
),
products AS (
    SELECT p.p_partkey AS id, p.p_name AS name, 'SKU-' || CAST(p.p_partkey AS VARCHAR) AS sku,
           c.id AS category_id,
           CASE WHEN p.p_partkey % 50 = 0 THEN NULL
                ELSE p.p_partkey % (SELECT count(*) FROM supplier) END AS supplier_id,
           (p.p_partkey * 37) % 119 AS current_stock,
           CAST(20 + p.p_size % 20 AS BIGINT) AS reorder_level,
           CAST(100 AS BIGINT) AS max_stock_level,
           CAST(floor(p.p_retailprice * 60.0 + 0.5) AS BIGINT) AS cost_cents,
           (p.p_partkey % 20 <> 0) AS is_active
    FROM part p JOIN categories c ON p.p_type = c.name
),
sales_transactions AS (
    SELECT o_orderkey AS id,
           o_orderdate + CAST((o_orderkey * 37) % 1440 AS INTEGER) * INTERVAL '1' MINUTE AS transaction_date,
           CAST(floor(o_totalprice * 100.0 + 0.5) AS BIGINT) AS total_cents
    FROM orders
),
sales_transaction_items AS (
    SELECT l_orderkey AS transaction_id, l_partkey AS product_id,
           CAST(l_quantity AS BIGINT) AS quantity,
           CAST(floor(l_extendedprice / l_quantity * 100.0 + 0.5) AS BIGINT) AS unit_cents,
           CAST(floor(l_extendedprice * (1 - l_discount) * 100.0 + 0.5) AS BIGINT) AS total_cents,
           CAST(floor(l_extendedprice * l_discount * 100.0 + 0.5) AS BIGINT) AS discount_cents,
           CASE WHEN l_discount >= CAST(0.05 AS DOUBLE) THEN l_partkey % 12 + 1 END AS promotion_id
    FROM lineitem
),
promotions AS (
    SELECT i AS id, 'Promo ' || CAST(i AS VARCHAR) AS name,
           CASE i % 3 WHEN 0 THEN 'discount' WHEN 1 THEN 'bogo' ELSE 'loyalty' END AS promotion_type,
           CAST(5 + 2 * i AS BIGINT) AS discount_percentage,
           CAST(DATE '1995-06-01' + CAST((i - 1) * 180 AS INTEGER) AS DATE) AS start_date,
           CAST(DATE '1995-06-01' + CAST((i - 1) * 180 + 30 AS INTEGER) AS DATE) AS end_date,
           (i % 6 <> 0) AS is_active,
           CAST(DATE '1995-06-01' + CAST((i - 1) * 180 - 7 AS INTEGER) AS DATE) AS created_at
    FROM (SELECT DISTINCT p_partkey % 12 + 1 AS i FROM part) t
),
promotion_products AS (
    SELECT p_partkey % 12 + 1 AS promotion_id, p_partkey AS product_id FROM part WHERE p_partkey % 5 = 0
),
inventory_movements AS (
    SELECT l_partkey AS product_id,
           CASE WHEN l_returnflag = 'R' THEN 'inbound' ELSE 'outbound' END AS movement_type,
           CAST(l_quantity AS BIGINT) AS quantity,
           l_shipdate AS movement_date
    FROM lineitem
)
"""
