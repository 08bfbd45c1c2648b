"""DuckDB SQL for the correctness check.

``FIXTURE_CTE`` is the fixture mapping of FIXTURES.md §2 as common table
expressions over the raw driver tables (ids as BIGINT like the Spark side).  Each
oracle query is ``WITH <fixture>[, <extra ctes>] <body>``.  Output rules, the same
on the Spark side (plans.catalog.edge): exact decimals inside, DOUBLE at the outer
edge, dates as ISO text, averages rounded to 4 places.
"""

from __future__ import annotations

import re

# Report parameters used by the registered queries (FIXTURES.md §3).
REPORT_START = "1996-01-01"
REPORT_END = "1999-12-31"
REPORT_BRANCH = 3

FIXTURE_CTE = """
s_warehouse AS (
  SELECT CAST(r_regionkey+1 AS BIGINT) AS warehouse_id, r_name AS warehouse_name,
         concat('Loc', CAST(r_regionkey AS VARCHAR)) AS location,
         CASE WHEN r_regionkey<4 THEN '0100' END AS phone_number
  FROM region),
s_branch AS (
  SELECT CAST(n_nationkey+1 AS BIGINT) AS branch_id,
         CASE WHEN n_nationkey=24 THEN 'NATION_0' ELSE n_name END AS branch_name,
         concat('Loc', CAST(n_regionkey AS VARCHAR)) AS location,
         CAST(5000+n_nationkey AS VARCHAR) AS phone_number,
         CASE WHEN n_nationkey%12=5 THEN 1 END AS is_deleted
  FROM nation),
s_employee AS (
  SELECT CAST(n_nationkey*5+r_regionkey+1 AS BIGINT) AS employee_id,
         concat('Employee#', CAST((n_nationkey*5+r_regionkey+1)%120 AS VARCHAR)) AS employee_name,
         CAST(7000+n_nationkey*5+r_regionkey AS VARCHAR) AS phone_number,
         CASE WHEN (n_nationkey+r_regionkey)%4<>0 THEN make_date(1960+n_nationkey, r_regionkey+1, n_nationkey+1) END AS date_of_birth,
         CASE WHEN r_regionkey=0 THEN 'Keeper' WHEN r_regionkey=1 THEN NULL ELSE 'Seller' END AS position,
         CAST(1000+n_nationkey*10+r_regionkey AS DECIMAL(10,2)) AS salary,
         CAST(CASE WHEN r_regionkey=0 THEN n_nationkey%5+1 END AS BIGINT) AS warehouse_id,
         CAST(CASE WHEN r_regionkey>0 THEN n_nationkey+1 END AS BIGINT) AS branch_id,
         CASE WHEN (n_nationkey*5+r_regionkey+1)%17=0 THEN 1 END AS is_deleted,
         CASE WHEN n_nationkey=0 AND r_regionkey=0 THEN 'admin' ELSE 'normal' END AS access_level
  FROM nation CROSS JOIN region),
s_customer AS (
  SELECT CAST(c_custkey+1 AS BIGINT) AS customer_id, c_name AS customer_name,
         CAST(9000+c_custkey AS VARCHAR) AS phone_number,
         CASE WHEN c_custkey%3<>0 THEN make_date(CAST(1950+c_custkey%50 AS INT), CAST(c_custkey%12+1 AS INT), CAST(c_custkey%28+1 AS INT)) END AS date_of_birth,
         CASE WHEN c_custkey%5<>0 THEN concat(c_name, '@example.com') END AS email
  FROM customer),
s_supplier AS (
  SELECT CAST(s_suppkey+1 AS BIGINT) AS supplier_id, s_name AS supplier_name,
         concat('Loc', CAST(s_nationkey AS VARCHAR)) AS location,
         CAST(3000+s_suppkey AS VARCHAR) AS phone_number,
         CASE WHEN s_suppkey%4<>0 THEN concat(s_name, '@example.com') END AS email,
         CASE WHEN s_suppkey%9=4 THEN 1 END AS is_deleted
  FROM supplier),
s_product AS (
  SELECT CAST(p_partkey+1 AS BIGINT) AS product_id, p_name AS product_name, p_type AS category,
         CASE WHEN p_partkey%29=0 THEN 1 END AS is_deleted,
         CAST(CAST(p_retailprice AS DECIMAL(10,2))-100 AS DECIMAL(10,2)) AS purchase_price_per_kg,
         CAST(p_retailprice AS DECIMAL(10,2)) AS sale_price_per_kg
  FROM part),
s_sale AS (
  SELECT CAST(o_orderkey+1 AS BIGINT) AS sale_id,
         CAST(CASE WHEN o_orderkey%10=0 THEN NULL ELSE o_custkey+1 END AS BIGINT) AS customer_id,
         CAST(o_custkey%25+1 AS BIGINT) AS branch_id,
         CAST((o_custkey%25)*5+2+o_orderkey%4 AS BIGINT) AS employee_id,
         CAST(o_orderdate AS DATE) AS sale_date,
         CASE WHEN o_orderkey%3=0 THEN 'Card' ELSE 'Cash' END AS payment_method,
         CASE WHEN o_orderkey%13=0 THEN 1 END AS is_deleted
  FROM orders),
s_sale_detail AS (
  SELECT CAST(l_orderkey+1 AS BIGINT) AS sale_id, CAST(l_partkey+1 AS BIGINT) AS product_id,
         CAST(CASE WHEN l_linenumber>4 THEN l_quantity/4 ELSE l_quantity END AS DECIMAL(10,2)) AS quantity,
         CAST(l_extendedprice AS DECIMAL(10,2)) AS kg_price_at_sale_time,
         CASE WHEN l_linenumber=4 THEN 1 END AS is_deleted,
         CASE WHEN l_linenumber<>4 AND l_orderkey%13=0 THEN 1 END AS is_deleted_with_sale
  FROM lineitem),
s_pline AS (
  SELECT CAST(l_suppkey*1000+(year(l_shipdate)-1995)*12+month(l_shipdate) AS BIGINT) AS purchase_id,
         l_suppkey, CAST(date_trunc('month', l_shipdate) AS DATE) AS purchase_date,
         CAST(l_partkey+1 AS BIGINT) AS product_id, CAST(l_quantity AS DECIMAL(10,2)) AS quantity,
         CAST(l_extendedprice AS DECIMAL(10,2)) AS kg_price_at_purchase_time,
         CASE WHEN l_linenumber=7 THEN 1 END AS is_deleted
  FROM lineitem),
s_purchase AS (
  SELECT DISTINCT purchase_id, CAST((l_suppkey%25)*5+1 AS BIGINT) AS employee_id,
         CAST(l_suppkey%5+1 AS BIGINT) AS warehouse_id, CAST(l_suppkey+1 AS BIGINT) AS supplier_id,
         purchase_date, CASE WHEN purchase_id%19=0 THEN 1 END AS is_deleted
  FROM s_pline),
s_purchase_detail AS (
  SELECT purchase_id, product_id, quantity, kg_price_at_purchase_time, is_deleted,
         CASE WHEN purchase_id%19=0 THEN 1 END AS is_deleted_with_purchase
  FROM s_pline),
s_payment AS (
  SELECT p.purchase_id*2+k.k AS payment_id, p.purchase_id, p.employee_id,
         CAST(p.purchase_date + INTERVAL '15' DAY AS DATE) AS payment_date,
         CASE WHEN p.purchase_id%3=0 THEN CAST(t.total AS DECIMAL(10,2))
              WHEN k.k=0 THEN CAST(1000.25 AS DECIMAL(10,2)) ELSE CAST(500.50 AS DECIMAL(10,2)) END AS amount,
         CASE p.purchase_id%4 WHEN 0 THEN 'Cash' WHEN 1 THEN 'Bank' WHEN 2 THEN 'Check' ELSE 'Other' END AS method,
         CASE WHEN k.k=1 AND p.purchase_id%5=0 THEN 1 END AS is_deleted,
         CASE WHEN p.is_deleted=1 THEN 1 END AS is_deleted_with_purchase
  FROM s_purchase p
  JOIN (SELECT purchase_id, SUM(quantity*kg_price_at_purchase_time) AS total
        FROM s_purchase_detail WHERE is_deleted IS NULL GROUP BY purchase_id) t ON t.purchase_id=p.purchase_id
  CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 AS k) k
  WHERE p.purchase_id%7<>0 AND (k.k=0 OR p.purchase_id%3=2)),
s_tline AS (
  SELECT CAST(((l_suppkey%5)*25+o_custkey%25)*1000+(year(l_shipdate)-1995)*12+month(l_shipdate) AS BIGINT) AS transfer_id,
         CAST(l_suppkey%5+1 AS BIGINT) AS warehouse_id, CAST(o_custkey%25+1 AS BIGINT) AS branch_id,
         CAST(date_trunc('month', l_shipdate) AS DATE) AS transfer_date,
         CAST(l_partkey+1 AS BIGINT) AS product_id,
         CAST(CASE WHEN l_linenumber>5 THEN l_quantity/4 ELSE l_quantity END AS DECIMAL(10,2)) AS quantity
  FROM lineitem JOIN orders ON l_orderkey=o_orderkey),
s_transfer AS (
  SELECT DISTINCT transfer_id, warehouse_id, branch_id, (warehouse_id-1)*5+1 AS employee_id, transfer_date
  FROM s_tline),
s_transfer_detail AS (
  SELECT transfer_id, product_id, quantity FROM s_tline),
s_warehouse_stock AS (
  SELECT warehouse_id, product_id, CAST(SUM(q) AS DECIMAL(20,2)) AS quantity
  FROM (SELECT p.warehouse_id, d.product_id, d.quantity AS q
        FROM s_purchase p JOIN s_purchase_detail d ON p.purchase_id=d.purchase_id
        WHERE p.is_deleted IS NULL AND d.is_deleted IS NULL
        UNION ALL
        SELECT t.warehouse_id, d.product_id, -d.quantity AS q
        FROM s_transfer t JOIN s_transfer_detail d ON t.transfer_id=d.transfer_id) m
  GROUP BY warehouse_id, product_id),
s_branch_stock AS (
  SELECT branch_id, product_id, CAST(SUM(q) AS DECIMAL(20,2)) AS quantity
  FROM (SELECT t.branch_id, d.product_id, d.quantity AS q
        FROM s_transfer t JOIN s_transfer_detail d ON t.transfer_id=d.transfer_id
        UNION ALL
        SELECT s.branch_id, d.product_id, -d.quantity AS q
        FROM s_sale s JOIN s_sale_detail d ON s.sale_id=d.sale_id
        WHERE s.is_deleted IS NULL AND d.is_deleted IS NULL) m
  GROUP BY branch_id, product_id)"""


def with_fixture(body: str, extra_ctes: str = "") -> str:
    extra = f",\n{extra_ctes.strip()}" if extra_ctes.strip() else ""
    return f"WITH RECURSIVE {FIXTURE_CTE.strip()}{extra}\n{body.strip()}"


_D = f"DATE '{REPORT_START}'", f"DATE '{REPORT_END}'"


def _range(col: str) -> str:
    return f"{col} >= {_D[0]} AND {col} <= {_D[1]}"


def _report_sql(_range) -> dict[str, str]:
    """The reports, with the range of a date column as ``_range`` writes it."""
    return {
    "r01_income_per_branch": f"""
SELECT b.branch_name, CAST(SUM(d.quantity*d.kg_price_at_sale_time) AS DOUBLE) AS total_income
FROM s_sale s JOIN s_sale_detail d ON d.sale_id = s.sale_id JOIN s_branch b ON b.branch_id = s.branch_id
WHERE s.is_deleted IS NULL AND d.is_deleted IS NULL AND b.is_deleted IS NULL AND {_range('s.sale_date')}
GROUP BY b.branch_name""",
    "r02_sales_count_per_branch": f"""
SELECT b.branch_name, COUNT(*) AS sales_count
FROM s_sale s JOIN s_branch b ON b.branch_id = s.branch_id
WHERE s.is_deleted IS NULL AND b.is_deleted IS NULL AND {_range('s.sale_date')}
GROUP BY b.branch_name""",
    "r03_avg_sale_per_branch": f"""
SELECT b.branch_name, ROUND(CAST(SUM(d.quantity*d.kg_price_at_sale_time) / COUNT(DISTINCT s.sale_id) AS DOUBLE), 4) AS avg_sale_amount
FROM s_sale_detail d, s_sale s, s_branch b
WHERE s.sale_id = d.sale_id AND b.branch_id = s.branch_id AND d.is_deleted IS NULL AND s.is_deleted IS NULL AND b.is_deleted IS NULL
  AND {_range('s.sale_date')}
GROUP BY b.branch_name""",
    "r04_daily_amount_for_branch": f"""
SELECT CAST(s.sale_date AS VARCHAR) AS sale_date, CAST(SUM(d.quantity*d.kg_price_at_sale_time) AS DOUBLE) AS daily_amount
FROM s_sale s JOIN s_sale_detail d ON d.sale_id = s.sale_id
WHERE s.is_deleted IS NULL AND d.is_deleted IS NULL AND s.branch_id = {REPORT_BRANCH} AND {_range('s.sale_date')}
GROUP BY s.sale_date""",
    "r05_sales_per_employee": f"""
SELECT e.employee_name, COUNT(*) AS number_of_sales
FROM s_sale s JOIN s_employee e ON e.employee_id = s.employee_id
WHERE e.is_deleted IS NULL AND s.is_deleted IS NULL AND {_range('s.sale_date')}
GROUP BY e.employee_name""",
    "r06_revenue_per_product": f"""
SELECT p.product_id, p.product_name, CAST(SUM(d.quantity*d.kg_price_at_sale_time) AS DOUBLE) AS total_sales_amount
FROM s_sale_detail d JOIN s_sale s ON s.sale_id = d.sale_id JOIN s_product p ON p.product_id = d.product_id
WHERE d.is_deleted IS NULL AND s.is_deleted IS NULL AND {_range('s.sale_date')}
GROUP BY p.product_id, p.product_name""",
    "r07_revenue_per_category": f"""
SELECT p.category, CAST(SUM(d.quantity*d.kg_price_at_sale_time) AS DOUBLE) AS total_sales_amount
FROM s_sale_detail d JOIN s_sale s ON s.sale_id = d.sale_id JOIN s_product p ON p.product_id = d.product_id
WHERE d.is_deleted IS NULL AND s.is_deleted IS NULL AND {_range('s.sale_date')}
GROUP BY p.category""",
    "r08_spend_per_customer": f"""
SELECT c.customer_id, c.customer_name, CAST(SUM(d.quantity*d.kg_price_at_sale_time) AS DOUBLE) AS total_amount_spent
FROM s_sale s JOIN s_customer c ON c.customer_id = s.customer_id JOIN s_sale_detail d ON d.sale_id = s.sale_id
WHERE s.is_deleted IS NULL AND d.is_deleted IS NULL AND {_range('s.sale_date')}
GROUP BY c.customer_id, c.customer_name""",
    "r09_payments_per_supplier": f"""
SELECT su.supplier_id, su.supplier_name, CAST(SUM(pay.amount) AS DOUBLE) AS total_payments_amount
FROM s_payment pay JOIN s_purchase p ON p.purchase_id = pay.purchase_id JOIN s_supplier su ON su.supplier_id = p.supplier_id
WHERE su.is_deleted IS NULL AND pay.is_deleted IS NULL AND p.is_deleted IS NULL AND {_range('pay.payment_date')}
GROUP BY su.supplier_id, su.supplier_name""",
    "r10_unpaid_per_supplier": """
SELECT su.supplier_id, su.supplier_name, CAST(COALESCE(SUM(m.signed), 0) AS DOUBLE) AS unpaid_amount
FROM s_supplier su LEFT JOIN (
  SELECT p.supplier_id, d.quantity*d.kg_price_at_purchase_time AS signed
  FROM s_purchase_detail d JOIN s_purchase p USING (purchase_id) WHERE d.is_deleted IS NULL AND p.is_deleted IS NULL
  UNION ALL
  SELECT p.supplier_id, -y.amount FROM s_payment y JOIN s_purchase p USING (purchase_id)
  WHERE y.is_deleted IS NULL AND p.is_deleted IS NULL) m ON m.supplier_id = su.supplier_id
WHERE su.is_deleted IS NULL
GROUP BY su.supplier_id, su.supplier_name""",
    "r11_purchase_value_per_warehouse": f"""
SELECT w.warehouse_name, CAST(SUM(d.quantity*d.kg_price_at_purchase_time) AS DOUBLE) AS total_purchase_value
FROM s_purchase p JOIN s_purchase_detail d ON d.purchase_id = p.purchase_id JOIN s_warehouse w ON w.warehouse_id = p.warehouse_id
WHERE p.is_deleted IS NULL AND d.is_deleted IS NULL AND {_range('p.purchase_date')}
GROUP BY w.warehouse_name""",
    "r12_purchase_count_per_warehouse": f"""
SELECT w.warehouse_name, COUNT(*) AS purchases_count
FROM s_purchase p JOIN s_warehouse w ON w.warehouse_id = p.warehouse_id
WHERE p.is_deleted IS NULL AND {_range('p.purchase_date')}
GROUP BY w.warehouse_name""",
    "r13_purchased_per_supplier": f"""
SELECT su.supplier_id, su.supplier_name, CAST(SUM(d.quantity*d.kg_price_at_purchase_time) AS DOUBLE) AS total_purchased_amount
FROM s_purchase p JOIN s_purchase_detail d ON d.purchase_id = p.purchase_id JOIN s_supplier su ON su.supplier_id = p.supplier_id
WHERE su.is_deleted IS NULL AND p.is_deleted IS NULL AND d.is_deleted IS NULL AND {_range('p.purchase_date')}
GROUP BY su.supplier_id, su.supplier_name""",
    "r14_avg_purchase_per_supplier": f"""
SELECT su.supplier_name, ROUND(CAST(SUM(d.quantity*d.kg_price_at_purchase_time) / COUNT(DISTINCT h.purchase_id) AS DOUBLE), 4) AS avg_purchase_value
FROM s_purchase_detail d, s_purchase h, s_supplier su
WHERE h.purchase_id = d.purchase_id AND su.supplier_id = h.supplier_id AND d.is_deleted IS NULL AND h.is_deleted IS NULL
  AND su.is_deleted IS NULL AND {_range('h.purchase_date')}
GROUP BY su.supplier_name""",
    "r15_paid_per_method": f"""
SELECT pay.method, CAST(SUM(pay.amount) AS DOUBLE) AS total_amount
FROM s_payment pay
WHERE pay.is_deleted IS NULL AND {_range('pay.payment_date')}
GROUP BY pay.method""",
    "r16_transfers_per_branch": f"""
SELECT b.branch_name, COUNT(*) AS transfers_count
FROM s_transfer t JOIN s_branch b ON b.branch_id = t.branch_id
WHERE b.is_deleted IS NULL AND {_range('t.transfer_date')}
GROUP BY b.branch_name""",
    "r17_qty_transferred_per_branch": f"""
SELECT b.branch_name, CAST(SUM(d.quantity) AS DOUBLE) AS total_transferred_qty
FROM s_transfer t JOIN s_transfer_detail d ON d.transfer_id = t.transfer_id JOIN s_branch b ON b.branch_id = t.branch_id
WHERE b.is_deleted IS NULL AND {_range('t.transfer_date')}
GROUP BY b.branch_name""",
    "r18_qty_transferred_per_product": f"""
SELECT pr.product_id, pr.product_name, CAST(SUM(d.quantity) AS DOUBLE) AS total_transferred_qty
FROM s_transfer t JOIN s_transfer_detail d ON d.transfer_id = t.transfer_id JOIN s_product pr ON pr.product_id = d.product_id
WHERE {_range('t.transfer_date')}
GROUP BY pr.product_id, pr.product_name""",
    "r19_warehouse_out_of_stock": """
SELECT w.warehouse_name, p.product_id, p.product_name, CAST(ws.quantity AS DOUBLE) AS quantity
FROM s_warehouse_stock ws JOIN s_warehouse w ON w.warehouse_id = ws.warehouse_id JOIN s_product p ON p.product_id = ws.product_id
WHERE ws.quantity <= 0 AND p.is_deleted IS NULL""",
    "r20_branch_out_of_stock": """
SELECT b.branch_name, p.product_id, p.product_name, CAST(bs.quantity AS DOUBLE) AS quantity
FROM s_branch_stock bs JOIN s_branch b ON b.branch_id = bs.branch_id JOIN s_product p ON p.product_id = bs.product_id
WHERE bs.quantity <= 0 AND p.is_deleted IS NULL""",
}


REPORT_SQL: dict[str, str] = _report_sql(_range)

def _sales_sql(flag: str) -> str:
    return f"""
SELECT s.sale_id, s.customer_id, c.customer_name, s.employee_id, e.employee_name, s.branch_id, b.branch_name,
       CAST(s.sale_date AS VARCHAR) AS sale_date, s.payment_method,
       CAST(COALESCE(SUM(d.quantity*d.kg_price_at_sale_time), 0) AS DOUBLE) AS total
FROM s_sale s
LEFT JOIN s_customer c ON c.customer_id = s.customer_id
LEFT JOIN s_employee e ON e.employee_id = s.employee_id
LEFT JOIN s_branch b ON b.branch_id = s.branch_id
LEFT JOIN s_sale_detail d ON d.sale_id = s.sale_id AND d.is_deleted IS NULL
WHERE s.is_deleted {flag}
GROUP BY s.sale_id, s.customer_id, c.customer_name, s.employee_id, e.employee_name, s.branch_id, b.branch_name,
         s.sale_date, s.payment_method"""


_TOTALS = """
LEFT JOIN (SELECT purchase_id, SUM(quantity*kg_price_at_purchase_time) AS total
           FROM s_purchase_detail WHERE is_deleted IS NULL GROUP BY purchase_id) t ON t.purchase_id = p.purchase_id
LEFT JOIN (SELECT purchase_id, SUM(amount) AS paid
           FROM s_payment WHERE is_deleted IS NULL GROUP BY purchase_id) pay ON pay.purchase_id = p.purchase_id"""


def _purchases_sql(flag: str) -> str:
    return f"""
SELECT p.purchase_id, CAST(p.purchase_date AS VARCHAR) AS purchase_date, p.warehouse_id, w.warehouse_name,
       p.supplier_id, su.supplier_name, p.employee_id, e.employee_name,
       CAST(COALESCE(t.total, 0) AS DOUBLE) AS total, CAST(COALESCE(pay.paid, 0) AS DOUBLE) AS paid,
       CAST(COALESCE(t.total, 0) - COALESCE(pay.paid, 0) AS DOUBLE) AS remaining
FROM s_purchase p
LEFT JOIN s_warehouse w ON w.warehouse_id = p.warehouse_id
LEFT JOIN s_supplier su ON su.supplier_id = p.supplier_id
LEFT JOIN s_employee e ON e.employee_id = p.employee_id{_TOTALS}
WHERE p.is_deleted {flag}"""


def _settlement_sql(cmp: str) -> str:
    return f"""
SELECT p.purchase_id, CAST(p.purchase_date AS VARCHAR) AS purchase_date, su.supplier_name,
       CAST(COALESCE(t.total, 0) AS DOUBLE) AS total_amount, CAST(COALESCE(pay.paid, 0) AS DOUBLE) AS paid_amount,
       CAST(COALESCE(t.total, 0) - COALESCE(pay.paid, 0) AS DOUBLE) AS remaining
FROM s_purchase p JOIN s_supplier su ON su.supplier_id = p.supplier_id{_TOTALS}
WHERE COALESCE(pay.paid, 0) {cmp} COALESCE(t.total, 0) AND p.is_deleted IS NULL"""


def _statement_sql(line_filter: str) -> str:
    return f"""
SELECT p.purchase_id, p.supplier_id, su.supplier_name, p.employee_id, e.employee_name, p.warehouse_id,
       w.warehouse_name, CAST(p.purchase_date AS VARCHAR) AS purchase_date,
       CAST(COALESCE(t.total, 0) AS DOUBLE) AS total, CAST(COALESCE(pay.paid, 0) AS DOUBLE) AS total_paid,
       CAST(COALESCE(t.total, 0) - COALESCE(pay.paid, 0) AS DOUBLE) AS remaining
FROM s_purchase p
LEFT JOIN s_supplier su ON su.supplier_id = p.supplier_id
LEFT JOIN s_employee e ON e.employee_id = p.employee_id
LEFT JOIN s_warehouse w ON w.warehouse_id = p.warehouse_id
LEFT JOIN (SELECT purchase_id, SUM(quantity*kg_price_at_purchase_time) AS total
           FROM s_purchase_detail {line_filter} GROUP BY purchase_id) t ON t.purchase_id = p.purchase_id
LEFT JOIN (SELECT purchase_id, SUM(amount) AS paid
           FROM s_payment WHERE is_deleted IS NULL GROUP BY purchase_id) pay ON pay.purchase_id = p.purchase_id"""


def _payments_sql(flag: str) -> str:
    return f"""
SELECT pay.payment_id, pay.purchase_id, CAST(pay.payment_date AS VARCHAR) AS payment_date,
       CAST(pay.amount AS DOUBLE) AS amount, pay.method, e.employee_name
FROM s_payment pay LEFT JOIN s_employee e ON e.employee_id = pay.employee_id
WHERE pay.is_deleted {flag}"""


def _employees_sql(flag: str) -> str:
    return f"""
SELECT e.employee_id, e.employee_name, e.phone_number, COALESCE(CAST(e.date_of_birth AS VARCHAR), '') AS date_of_birth,
       e.position, CAST(e.salary AS DOUBLE) AS salary, e.warehouse_id, w.warehouse_name, e.branch_id,
       b.branch_name, e.is_deleted, e.access_level
FROM s_employee e
LEFT JOIN s_warehouse w ON w.warehouse_id = e.warehouse_id
LEFT JOIN s_branch b ON b.branch_id = e.branch_id
WHERE e.is_deleted {flag}"""


_ACTIVE, _DELETED = "IS NULL", "= 1"

LIST_SQL: dict[str, str] = {
    "l01_active_sales": _sales_sql(_ACTIVE),
    "l02_deleted_sales": _sales_sql(_DELETED),
    "l03_sale_lines": """
SELECT d.sale_id, d.product_id, p.product_name, CAST(d.quantity AS DOUBLE) AS quantity,
       CAST(d.kg_price_at_sale_time AS DOUBLE) AS kg_price_at_sale_time,
       CAST(d.quantity*d.kg_price_at_sale_time AS DOUBLE) AS line_total
FROM s_sale_detail d LEFT JOIN s_product p ON p.product_id = d.product_id
WHERE d.is_deleted IS NULL""",
    "l04_active_purchases": _purchases_sql(_ACTIVE),
    "l05_deleted_purchases": _purchases_sql(_DELETED),
    "l06_purchase_lines": """
SELECT d.purchase_id, d.product_id, p.product_name, CAST(d.quantity AS DOUBLE) AS quantity,
       CAST(d.kg_price_at_purchase_time AS DOUBLE) AS kg_price_at_purchase_time,
       CAST(d.quantity*d.kg_price_at_purchase_time AS DOUBLE) AS line_value
FROM s_purchase_detail d LEFT JOIN s_product p ON p.product_id = d.product_id
WHERE d.is_deleted IS NULL""",
    "l06_purchase_totals": """
SELECT p.purchase_id, CAST(COALESCE(SUM(d.quantity*d.kg_price_at_purchase_time), 0) AS DOUBLE) AS total
FROM s_purchase p LEFT JOIN s_purchase_detail d ON d.purchase_id = p.purchase_id AND d.is_deleted IS NULL
GROUP BY p.purchase_id""",
    "l07_transfers": """
SELECT t.transfer_id, CAST(t.transfer_date AS VARCHAR) AS transfer_date, t.warehouse_id, w.warehouse_name,
       t.branch_id, b.branch_name, t.employee_id, e.employee_name,
       CAST(COALESCE(SUM(d.quantity), 0) AS DOUBLE) AS total_qty
FROM s_transfer t
LEFT JOIN s_warehouse w ON w.warehouse_id = t.warehouse_id
LEFT JOIN s_branch b ON b.branch_id = t.branch_id
LEFT JOIN s_employee e ON e.employee_id = t.employee_id
LEFT JOIN s_transfer_detail d ON d.transfer_id = t.transfer_id
GROUP BY t.transfer_id, t.transfer_date, t.warehouse_id, w.warehouse_name, t.branch_id, b.branch_name,
         t.employee_id, e.employee_name""",
    "l08_transfer_lines": """
SELECT d.transfer_id, d.product_id, p.product_name, CAST(d.quantity AS DOUBLE) AS quantity
FROM s_transfer_detail d LEFT JOIN s_product p ON p.product_id = d.product_id""",
    "l09_unpaid_purchases": _settlement_sql("<"),
    "l10_completed_purchases": _settlement_sql(">="),
    "l11_payment_statement": _statement_sql("WHERE is_deleted IS NULL"),
    "l11_payment_statement_all_lines": _statement_sql(""),
    "l12_active_payments": _payments_sql(_ACTIVE),
    "l12_deleted_payments": _payments_sql(_DELETED),
    "l13_warehouse_stock": """
SELECT ws.warehouse_id, w.warehouse_name, ws.product_id, p.product_name, CAST(ws.quantity AS DOUBLE) AS quantity
FROM s_warehouse_stock ws
LEFT JOIN s_warehouse w ON w.warehouse_id = ws.warehouse_id
LEFT JOIN s_product p ON p.product_id = ws.product_id""",
    "l14_branch_stock": """
SELECT bs.branch_id, b.branch_name, bs.product_id, p.product_name, CAST(bs.quantity AS DOUBLE) AS quantity
FROM s_branch_stock bs
LEFT JOIN s_branch b ON b.branch_id = bs.branch_id
LEFT JOIN s_product p ON p.product_id = bs.product_id""",
    "l15_sellable_products": """
SELECT bs.branch_id, p.product_id, p.product_name, CAST(p.sale_price_per_kg AS DOUBLE) AS sale_price_per_kg,
       CAST(bs.quantity AS DOUBLE) AS quantity
FROM s_branch_stock bs JOIN s_product p ON p.product_id = bs.product_id
WHERE p.is_deleted IS NULL AND bs.quantity > 0""",
    "l16_own_line_availability": """
SELECT o.sale_id, s.branch_id, o.product_id, p.product_name, CAST(p.sale_price_per_kg AS DOUBLE) AS sale_price_per_kg,
       CAST(bs.quantity + o.own_qty AS DOUBLE) AS available_qty
FROM (SELECT sale_id, product_id, SUM(quantity) AS own_qty FROM s_sale_detail
      WHERE is_deleted IS NULL GROUP BY sale_id, product_id) o
JOIN s_sale s ON s.sale_id = o.sale_id
JOIN s_branch_stock bs ON bs.branch_id = s.branch_id AND bs.product_id = o.product_id
JOIN s_product p ON p.product_id = o.product_id
WHERE s.is_deleted IS NULL AND p.is_deleted IS NULL""",
    "l17_transferable_products": """
SELECT ws.warehouse_id, ws.product_id, p.product_name, CAST(ws.quantity AS DOUBLE) AS quantity
FROM s_warehouse_stock ws LEFT JOIN s_product p ON p.product_id = ws.product_id
WHERE ws.quantity > 0 AND p.is_deleted IS NULL""",
    "l18_active_products": """
SELECT product_id, product_name, category, CAST(purchase_price_per_kg AS DOUBLE) AS purchase_price_per_kg,
       CAST(sale_price_per_kg AS DOUBLE) AS sale_price_per_kg
FROM s_product WHERE is_deleted IS NULL""",
    "l18_deleted_products": """
SELECT product_id, product_name, category, CAST(purchase_price_per_kg AS DOUBLE) AS purchase_price_per_kg,
       CAST(sale_price_per_kg AS DOUBLE) AS sale_price_per_kg
FROM s_product WHERE is_deleted = 1""",
    "l19_active_employees": _employees_sql(_ACTIVE),
    "l19_deleted_employees": _employees_sql(_DELETED),
    "l20_active_suppliers": "SELECT * FROM s_supplier WHERE is_deleted IS NULL",
    "l20_deleted_suppliers": "SELECT * FROM s_supplier WHERE is_deleted = 1",
    "l21_active_branches": "SELECT * FROM s_branch WHERE is_deleted IS NULL",
    "l21_deleted_branches": "SELECT * FROM s_branch WHERE is_deleted = 1",
    "l22_warehouses": "SELECT * FROM s_warehouse",
    "l22_customers": """
SELECT customer_id, customer_name, phone_number, COALESCE(CAST(date_of_birth AS VARCHAR), '') AS date_of_birth, email
FROM s_customer""",
}


_WH_REBUILD = """
SELECT warehouse_id AS location_id, product_id, SUM(q) AS q FROM (
  SELECT p.warehouse_id, d.product_id, d.quantity AS q
  FROM s_purchase p JOIN s_purchase_detail d ON d.purchase_id = p.purchase_id
  WHERE p.is_deleted IS NULL AND d.is_deleted IS NULL
  UNION ALL
  SELECT t.warehouse_id, d.product_id, -d.quantity AS q
  FROM s_transfer t JOIN s_transfer_detail d ON d.transfer_id = t.transfer_id) m
GROUP BY warehouse_id, product_id"""

_BR_REBUILD = """
SELECT branch_id AS location_id, product_id, SUM(q) AS q FROM (
  SELECT t.branch_id, d.product_id, d.quantity AS q
  FROM s_transfer t JOIN s_transfer_detail d ON d.transfer_id = t.transfer_id
  UNION ALL
  SELECT s.branch_id, d.product_id, -d.quantity AS q
  FROM s_sale s JOIN s_sale_detail d ON d.sale_id = s.sale_id
  WHERE s.is_deleted IS NULL AND d.is_deleted IS NULL) m
GROUP BY branch_id, product_id"""


def _reconcile_sql(kind: str, snap: str, loc: str, rebuilt: str) -> str:
    return f"""
SELECT '{kind}' AS location_type, COALESCE(s.{loc}, r.location_id) AS location_id,
       COALESCE(s.product_id, r.product_id) AS product_id,
       CAST(s.quantity AS DOUBLE) AS snapshot_qty, CAST(r.q AS DOUBLE) AS rebuilt_qty,
       CAST(COALESCE(s.quantity, 0) - COALESCE(r.q, 0) AS DOUBLE) AS difference,
       CASE WHEN s.quantity IS NULL THEN 'missing_in_snapshot' WHEN r.q IS NULL THEN 'missing_in_rebuild'
            WHEN s.quantity = r.q THEN 'match' ELSE 'differs' END AS status
FROM {snap} s FULL OUTER JOIN ({rebuilt}) r ON r.location_id = s.{loc} AND r.product_id = s.product_id"""


def _audit_sql() -> str:
    from depotline.schemas import FOREIGN_KEYS, NOT_NULL, PRIMARY_KEYS
    parts = []
    for table, key in PRIMARY_KEYS.items():
        cols = ",".join(key)
        nonnull = " AND ".join(f"{k} IS NOT NULL" for k in key)
        anynull = " OR ".join(f"{k} IS NULL" for k in key)
        parts.append(f"SELECT '{table}' AS table_name, 'pk_duplicate' AS rule, '{cols}' AS column_name, "
                     f"CAST(COALESCE(SUM(n), 0) AS BIGINT) AS violations FROM (SELECT COUNT(*) AS n FROM s_{table} "
                     f"WHERE {nonnull} GROUP BY {cols} HAVING COUNT(*) > 1) x")
        parts.append(f"SELECT '{table}', 'pk_null', '{cols}', CAST(COUNT(*) AS BIGINT) FROM s_{table} WHERE {anynull}")
    for table, cols in NOT_NULL.items():
        for c in cols:
            parts.append(f"SELECT '{table}', 'not_null', '{c}', CAST(COUNT(*) AS BIGINT) FROM s_{table} WHERE {c} IS NULL")
    for child, col, parent, pcol in FOREIGN_KEYS:
        parts.append(f"SELECT '{child}', 'fk_orphan:{parent}', '{col}', CAST(COUNT(*) AS BIGINT) FROM s_{child} c "
                     f"WHERE c.{col} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM s_{parent} p WHERE p.{pcol} = c.{col})")
    return "\nUNION ALL\n".join(parts)


def _keyed_audit_sql() -> str:
    """The audit where line i of n has the key i, every key that ends in 005 is lost, and every row whose
    key ends in 006 stands twice."""
    from depotline.schemas import LINE_KEYS
    twice = {}
    for name, key in LINE_KEYS.items():
        numbered = f"(SELECT *, ROW_NUMBER() OVER () AS k FROM s_{name})"
        twice[name] = f"(SELECT * EXCLUDE (k), CASE WHEN k%1000<>5 THEN k END AS {key} FROM {numbered} UNION ALL SELECT * EXCLUDE (k), k FROM {numbered} WHERE k%1000=6)"
    keys = [f"""SELECT '{name}', 'pk_duplicate', '{key}', CAST(COALESCE(SUM(n), 0) AS BIGINT) FROM (SELECT COUNT(*) AS n FROM {twice[name]}
WHERE {key} IS NOT NULL GROUP BY {key} HAVING COUNT(*) > 1) x
UNION ALL SELECT '{name}', 'pk_null', '{key}', COUNT(*) FROM {twice[name]} WHERE {key} IS NULL""" for name, key in LINE_KEYS.items()]
    return "\nUNION ALL\n".join([_audit_sql(), *keys])


_LIVE_PURCHASE_MOVES = """
SELECT p.warehouse_id, d.product_id, SUM(d.quantity) AS q
FROM s_purchase p JOIN s_purchase_detail d ON d.purchase_id = p.purchase_id
WHERE p.is_deleted IS NULL AND d.is_deleted IS NULL
GROUP BY p.warehouse_id, d.product_id"""

_LIVE_SALE_MOVES = """
SELECT s.branch_id, d.product_id, SUM(d.quantity) AS q
FROM s_sale s JOIN s_sale_detail d ON d.sale_id = s.sale_id
WHERE s.is_deleted IS NULL AND d.is_deleted IS NULL
GROUP BY s.branch_id, d.product_id"""

_RECOVERABLE = """
SELECT DISTINCT purchase_id FROM s_purchase_detail WHERE is_deleted_with_purchase = 1 AND is_deleted IS NULL"""

OFFSET = 10 ** 12


def _new_id(key: str) -> str:
    """Id under which a batch posts a document again: 2 of every 50 keep theirs."""
    return f"CASE WHEN {key}%50=2 THEN {key} ELSE {key}+{OFFSET} END"


def _id_reason(key: str, ref: str, more: str = "") -> str:
    """Why a document of a batch is refused by the flaws planted in it."""
    return (f"CASE WHEN {key}%50=1 THEN 'duplicate_in_batch' WHEN {key}%50=2 THEN 'id_exists' {more} WHEN {key}%50=3 THEN 'unknown_{ref}' "
            f"WHEN {key}%50=4 THEN 'unknown_product' END")


def _good(key: str) -> str:
    return f"{key}%50 NOT IN (1, 2, 3, 4)"


# a sale without live lines names no unknown product
_GOOD_SALE = """(sale_id%50 NOT IN (1, 2, 3, 4) OR sale_id%50 = 4 AND NOT EXISTS (
  SELECT 1 FROM s_sale_detail x WHERE x.sale_id = h.sale_id AND x.is_deleted IS NULL))"""


def _admission(demand: str, missing_rejects: bool = False) -> str:
    """CTEs that decide documents in (date, id) order, as ``decided`` (doc_id, accepted, reason).

    ``demand`` has doc_id, doc_date, kind, place, product_id, qty and avail (NULL: no stock row).  A
    document is decided as soon as every earlier one that shares a place and product with it is; it is
    accepted if all its lines fit beside the accepted ones before it.
    """
    return f"""
demand AS MATERIALIZED (SELECT doc_id, kind, place, product_id, any_value(doc_date) AS doc_date, SUM(qty) AS qty,
         coalesce(any_value(avail), 0) AS avail, any_value(avail) IS NULL AS missing
  FROM ({demand}) GROUP BY doc_id, kind, place, product_id),
queue AS MATERIALIZED (SELECT *, dense_rank() OVER (ORDER BY doc_date NULLS FIRST, doc_id) AS turn FROM demand),
step(n, doc_id, state) AS (
  SELECT 0, doc_id, CASE WHEN {'bool_or(missing)' if missing_rejects else 'false'} THEN 3 ELSE 0 END FROM queue GROUP BY doc_id
  UNION ALL
  SELECT n + 1, doc_id, CASE WHEN state <> 0 THEN state WHEN bool_or(waits) THEN 0 WHEN bool_and(fits) THEN 1 ELSE 2 END
  FROM (SELECT s.n, q.doc_id, s.state, count(*) FILTER (s.state = 0) OVER earlier > 0 AS waits,
               coalesce(sum(qty) FILTER (s.state = 1) OVER earlier, 0) + qty <= avail AS fits
        FROM queue q JOIN step s ON s.doc_id = q.doc_id
        WHERE (SELECT min(state) FROM step) = 0
        WINDOW earlier AS (PARTITION BY kind, place, product_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
  GROUP BY n, doc_id, state),
decided AS (SELECT doc_id, state = 1 AS accepted,
                   CASE state WHEN 2 THEN 'insufficient_stock' WHEN 3 THEN 'missing_stock_row' END AS reason
            FROM step QUALIFY n = max(n) OVER ())"""


def _delivered(kind: str, share: str, moved: str) -> str:
    """CTE of a stock table after a delivery of a share of what ``moved`` (place, product_id, quantity) adds up to."""
    return f"""
delivered_{kind} AS MATERIALIZED (SELECT {kind}_id, product_id, CAST(SUM(quantity) AS DECIMAL(20,2)) AS quantity FROM (
  SELECT {kind}_id, product_id, quantity FROM s_{kind}_stock
  UNION ALL SELECT place, product_id, CAST(FLOOR(SUM(quantity)) AS BIGINT) * {share} FROM ({moved}) GROUP BY place, product_id)
  GROUP BY {kind}_id, product_id)"""


def _all_transfers(kind: str) -> str:
    return f"SELECT t.{kind}_id AS place, d.product_id, d.quantity FROM s_transfer t JOIN s_transfer_detail d ON d.transfer_id = t.transfer_id"


_ALL_PURCHASES = """SELECT p.warehouse_id AS place, d.product_id, d.quantity FROM s_purchase p JOIN s_purchase_detail d ON d.purchase_id = p.purchase_id
  WHERE p.is_deleted IS NULL AND d.is_deleted IS NULL"""
_WH_DELIVERED = _delivered("warehouse", "3 // 4", _all_transfers("warehouse"))
_WH_BOUGHT = _delivered("warehouse", "3 // 4", _ALL_PURCHASES)
_BR_DELIVERED = _delivered("branch", "(CASE WHEN product_id%5=0 THEN 8 ELSE 10 END) // 10", _all_transfers("branch"))


def _transfer_demand(doc_id: str, kind: str, where: str) -> str:
    return f"""
SELECT {doc_id} AS doc_id, t.transfer_date AS doc_date, '{kind}' AS kind, t.{kind}_id AS place, d.product_id, d.quantity AS qty, s.quantity AS avail
FROM s_transfer t JOIN s_transfer_detail d ON d.transfer_id = t.transfer_id
LEFT JOIN delivered_{kind} s ON s.{kind}_id = t.{kind}_id AND s.product_id = d.product_id WHERE {where}"""


def _purchase_demand(where: str) -> str:
    return f"""
SELECT p.purchase_id AS doc_id, p.purchase_date AS doc_date, 'warehouse' AS kind, p.warehouse_id AS place, d.product_id, d.quantity AS qty,
       s.quantity AS avail
FROM s_purchase p JOIN s_purchase_detail d ON d.purchase_id = p.purchase_id
LEFT JOIN delivered_warehouse s ON s.warehouse_id = p.warehouse_id AND s.product_id = d.product_id
WHERE p.is_deleted IS NULL AND d.is_deleted IS NULL AND {where}"""


_COUNTED = """
counted AS (SELECT branch_id, product_id, CASE WHEN product_id%5=0 THEN 0 ELSE quantity END AS quantity
            FROM s_branch_stock WHERE product_id%11<>0)"""

_FULL_WAREHOUSE = f"""
(SELECT * FROM s_warehouse_stock UNION ALL SELECT warehouse_id, {OFFSET}, 5 FROM s_warehouse)"""

_RETRANSFER = _WH_DELIVERED + "," + _admission(_transfer_demand(_new_id("t.transfer_id"), "warehouse", _good("t.transfer_id")))
_HAS_LINES = "EXISTS (SELECT 1 FROM s_purchase_detail d WHERE d.purchase_id = p.purchase_id AND d.is_deleted IS NULL)"

_FLAWED = f"""
a_purchase AS (SELECT purchase_id, employee_id, warehouse_id, CASE WHEN supplier_id%10=0 THEN supplier_id+{OFFSET} ELSE supplier_id END AS supplier_id
  FROM (SELECT * FROM s_purchase UNION ALL SELECT * FROM s_purchase WHERE purchase_id%50=1)),
a_sale AS (SELECT CASE WHEN sale_id%1000<>7 THEN sale_id END AS sale_id, customer_id, branch_id, employee_id FROM s_sale),
a_branch_stock AS (SELECT branch_id, product_id, CASE WHEN product_id%100<>3 THEN quantity END AS quantity FROM s_branch_stock)"""

JOB_SQL: dict[str, str] = {
    "x01_stock_reconcile": (_COUNTED, _reconcile_sql("warehouse", _FULL_WAREHOUSE, "warehouse_id", _WH_REBUILD)
    + "\nUNION ALL\n" + _reconcile_sql("branch", "counted", "branch_id", _BR_REBUILD)),
    "x01_reconcile_of_versions":
        _reconcile_sql("warehouse", "s_warehouse_stock", "warehouse_id",
                       _WH_REBUILD.replace("d.quantity AS q\n  FROM s_purchase", "d.quantity*CASE WHEN p.purchase_id%40=9 THEN 2 ELSE 1 END AS q\n  FROM s_purchase"))
        + "\nUNION ALL\n" + _reconcile_sql("branch", "s_branch_stock", "branch_id",
                                            _BR_REBUILD.replace("s.is_deleted IS NULL", "s.is_deleted IS NULL AND s.sale_id%40<>7")),
    "w04_post_purchases_stock": f"""
SELECT COALESCE(s.warehouse_id, m.warehouse_id) AS warehouse_id, COALESCE(s.product_id, m.product_id) AS product_id,
       CAST(COALESCE(s.quantity, 0) + COALESCE(m.q, 0) AS DOUBLE) AS quantity
FROM s_warehouse_stock s FULL OUTER JOIN ({_LIVE_PURCHASE_MOVES.replace("GROUP BY", f"AND {_good('p.purchase_id')} GROUP BY")}) m
  ON m.warehouse_id = s.warehouse_id AND m.product_id = s.product_id""",
    "w04_post_purchases_decisions": f"""
SELECT {_new_id('purchase_id')} AS doc_id, {_good('purchase_id')} AND {_HAS_LINES} AS accepted,
       {_id_reason('purchase_id', 'supplier', f"WHEN NOT {_HAS_LINES} THEN 'no_lines'")} AS reason
FROM s_purchase p WHERE is_deleted IS NULL""",
    "w04_post_purchases_stray_lines": f"""
SELECT purchase_id+2*{OFFSET} AS doc_id, product_id, CAST(quantity AS DOUBLE) AS quantity
FROM s_purchase_detail WHERE is_deleted IS NULL AND purchase_id%50=5
UNION ALL
SELECT d.purchase_id+CASE WHEN d.purchase_id%50=2 THEN 0 ELSE {OFFSET} END, d.product_id+CASE WHEN d.purchase_id%50=4 THEN {OFFSET} ELSE 0 END, CAST(d.quantity AS DOUBLE)
FROM s_purchase_detail d JOIN s_purchase p ON p.purchase_id = d.purchase_id WHERE p.is_deleted = 1 AND d.is_deleted IS NULL""",
    "w04_post_purchases_headers": f"""
SELECT purchase_id, employee_id, warehouse_id, supplier_id, CAST(purchase_date AS VARCHAR) AS purchase_date, is_deleted FROM s_purchase
UNION ALL
SELECT purchase_id+{OFFSET}, employee_id, warehouse_id, supplier_id, CAST(purchase_date AS VARCHAR), NULL
FROM s_purchase p WHERE is_deleted IS NULL AND {_good('purchase_id')} AND {_HAS_LINES}""",
    "w04_post_purchases_lines": f"""
SELECT purchase_id, product_id, CAST(quantity AS DOUBLE) AS quantity, CAST(kg_price_at_purchase_time AS DOUBLE) AS kg_price_at_purchase_time,
       COALESCE(is_deleted, 0) AS is_deleted, COALESCE(is_deleted_with_purchase, 0) AS is_deleted_with_purchase FROM s_purchase_detail
UNION ALL
SELECT d.purchase_id+{OFFSET}, d.product_id, CAST(d.quantity AS DOUBLE), CAST(d.kg_price_at_purchase_time AS DOUBLE), 0, 0
FROM s_purchase_detail d JOIN s_purchase p ON p.purchase_id = d.purchase_id
WHERE p.is_deleted IS NULL AND d.is_deleted IS NULL AND {_good('p.purchase_id')}""",
    "w06_post_sales_stock": f"""
SELECT s.branch_id, s.product_id, CAST(s.quantity - COALESCE(m.q, 0) AS DOUBLE) AS quantity
FROM s_branch_stock s LEFT JOIN ({_LIVE_SALE_MOVES.replace("GROUP BY", f"AND {_good('s.sale_id')} GROUP BY")}) m
  ON m.branch_id = s.branch_id AND m.product_id = s.product_id""",
    "w06_post_sales_decisions": f"""
SELECT {_new_id('sale_id')} AS doc_id, {_GOOD_SALE} AS accepted, CASE WHEN NOT {_GOOD_SALE} THEN {_id_reason('sale_id', 'branch')} END AS reason
FROM s_sale h WHERE is_deleted IS NULL""",
    "w06_post_sales_headers": f"""
SELECT sale_id, customer_id, branch_id, employee_id, CAST(sale_date AS VARCHAR) AS sale_date, payment_method, is_deleted FROM s_sale
UNION ALL
SELECT sale_id+{OFFSET}, customer_id, branch_id, employee_id, CAST(sale_date AS VARCHAR), payment_method, NULL
FROM s_sale h WHERE is_deleted IS NULL AND {_GOOD_SALE}""",
    "w06_post_sales_lines": f"""
SELECT sale_id, product_id, CAST(quantity AS DOUBLE) AS quantity, CAST(kg_price_at_sale_time AS DOUBLE) AS kg_price_at_sale_time,
       COALESCE(is_deleted, 0) AS is_deleted, COALESCE(is_deleted_with_sale, 0) AS is_deleted_with_sale FROM s_sale_detail
UNION ALL
SELECT d.sale_id+{OFFSET}, d.product_id, CAST(d.quantity AS DOUBLE), CAST(d.kg_price_at_sale_time AS DOUBLE), 0, 0
FROM s_sale_detail d JOIN s_sale s ON s.sale_id = d.sale_id WHERE s.is_deleted IS NULL AND d.is_deleted IS NULL AND {_good('s.sale_id')}""",
    "s07_posted_published_read_back": f"""
SELECT n.sale_id, CAST(COALESCE(SUM(d.quantity*d.kg_price_at_sale_time), 0) AS DOUBLE) AS total
FROM (SELECT sale_id, sale_id AS old_id FROM s_sale WHERE is_deleted IS NULL
      UNION ALL SELECT sale_id+{OFFSET}, sale_id FROM s_sale h WHERE is_deleted IS NULL AND {_GOOD_SALE}) n
LEFT JOIN s_sale_detail d ON d.sale_id = n.old_id AND d.is_deleted IS NULL
GROUP BY n.sale_id""",
    "s01_load_payments_with_rejects": """
SELECT CAST(payment_id AS VARCHAR) AS payment_id, CASE WHEN payment_id%40 NOT IN (1, 2, 3) THEN CAST(amount AS DOUBLE) END AS amount,
       CASE payment_id%40 WHEN 1 THEN 'bad_amount' WHEN 2 THEN 'bad_payment_date' WHEN 3 THEN 'bad_purchase_id' END AS reason FROM s_payment""",
    "s07_touched_parts_read_back": f"""
SELECT CASE WHEN s.sale_id%40=7 THEN s.sale_id+{OFFSET} ELSE s.sale_id END AS sale_id,
       CAST(COALESCE(SUM(d.quantity*d.kg_price_at_sale_time), 0) AS DOUBLE) AS total
FROM s_sale s LEFT JOIN s_sale_detail d ON d.sale_id = s.sale_id AND d.is_deleted IS NULL WHERE s.is_deleted IS NULL GROUP BY s.sale_id""",
    "w07_post_payments": f"""
SELECT payment_id, purchase_id, employee_id, CAST(payment_date AS VARCHAR) AS payment_date, CAST(amount AS DOUBLE) AS amount, method, is_deleted,
       is_deleted_with_purchase FROM s_payment
UNION ALL
SELECT payment_id+{OFFSET}, purchase_id, employee_id, CAST(payment_date AS VARCHAR), CAST(amount AS DOUBLE), method, NULL, NULL
FROM s_payment WHERE payment_id%50 NOT IN (1, 2, 3, 6)""",
    "w07_post_payments_decisions": f"""
SELECT {_new_id('payment_id')} AS doc_id, payment_id%50 NOT IN (1, 2, 3, 6) AS accepted,
       CASE payment_id%50 WHEN 1 THEN 'duplicate_in_batch' WHEN 2 THEN 'id_exists' WHEN 3 THEN 'unknown_purchase' WHEN 6 THEN 'missing_amount' END AS reason
FROM s_payment""",
    "w03_transfer_admission": (_RETRANSFER, f"""
SELECT doc_id, accepted, reason FROM decided
UNION ALL SELECT {_new_id('transfer_id')}, false, {_id_reason('transfer_id', 'branch')} FROM s_transfer WHERE NOT {_good('transfer_id')}"""),
    "w05_post_transfers_branch_stock": (_BR_DELIVERED + "," + _RETRANSFER, f"""
SELECT COALESCE(s.branch_id, m.branch_id) AS branch_id, COALESCE(s.product_id, m.product_id) AS product_id,
       CAST(COALESCE(s.quantity, 0) + COALESCE(m.q, 0) AS DOUBLE) AS quantity
FROM delivered_branch s FULL OUTER JOIN (
  SELECT t.branch_id, d.product_id, SUM(d.quantity) AS q
  FROM s_transfer t JOIN s_transfer_detail d ON d.transfer_id = t.transfer_id JOIN decided a ON a.doc_id = t.transfer_id+{OFFSET} AND a.accepted
  GROUP BY t.branch_id, d.product_id) m ON m.branch_id = s.branch_id AND m.product_id = s.product_id"""),
    "w08_delete_purchases": (_WH_BOUGHT + "," + _admission(_purchase_demand("true")), f"""
SELECT doc_id, accepted, reason FROM decided
UNION ALL SELECT purchase_id, true, NULL FROM s_purchase p WHERE is_deleted IS NULL AND NOT {_HAS_LINES}"""),
    "w11_recover_sales": (_COUNTED + "," + _admission("""
SELECT s.sale_id AS doc_id, s.sale_date AS doc_date, 'branch' AS kind, s.branch_id AS place, d.product_id, d.quantity AS qty, c.quantity AS avail
FROM s_sale s JOIN s_sale_detail d ON d.sale_id = s.sale_id
LEFT JOIN counted c ON c.branch_id = s.branch_id AND c.product_id = d.product_id
WHERE s.is_deleted = 1 AND d.is_deleted_with_sale = 1""", missing_rejects=True), """
SELECT doc_id, accepted, reason FROM decided
UNION ALL SELECT sale_id, true, NULL FROM s_sale s WHERE is_deleted = 1
  AND NOT EXISTS (SELECT 1 FROM s_sale_detail d WHERE d.sale_id = s.sale_id AND d.is_deleted_with_sale = 1)"""),
    "w12_delete_transfers": (_BR_DELIVERED + "," + _admission(_transfer_demand("t.transfer_id", "branch", "true")), "SELECT doc_id, accepted, reason FROM decided"),
    "w14_edit_purchases": (_WH_BOUGHT + "," + _admission(_purchase_demand("p.purchase_id%50 NOT IN (1, 3)")), f"""
SELECT doc_id, accepted, reason FROM decided
UNION ALL
SELECT purchase_id, false, CASE WHEN purchase_id%50=1 THEN 'duplicate_in_batch' WHEN NOT {_HAS_LINES} THEN 'no_lines' ELSE 'unknown_supplier' END
FROM s_purchase p WHERE is_deleted IS NULL AND (purchase_id%50 IN (1, 3) OR NOT {_HAS_LINES})"""),
    "w15_edit_transfers": (_WH_DELIVERED + "," + _BR_DELIVERED + """,
short AS MATERIALIZED (SELECT DISTINCT t.transfer_id FROM s_transfer t JOIN s_transfer_detail d ON d.transfer_id = t.transfer_id
  LEFT JOIN delivered_warehouse s ON s.warehouse_id = t.warehouse_id AND s.product_id = d.product_id WHERE COALESCE(s.quantity, 0) < 0),"""
    + _admission(_transfer_demand("t.transfer_id", "branch", "t.transfer_id%50 NOT IN (1, 3) AND t.transfer_id NOT IN (SELECT transfer_id FROM short)")), """
SELECT doc_id, accepted, reason FROM decided
UNION ALL SELECT transfer_id, false, CASE WHEN transfer_id%50=1 THEN 'duplicate_in_batch' ELSE 'unknown_product' END
FROM s_transfer WHERE transfer_id%50 IN (1, 3)
UNION ALL SELECT transfer_id, false, 'insufficient_stock' FROM short WHERE transfer_id%50 NOT IN (1, 3)"""),
    "w09_recover_purchases": f"""
SELECT p.purchase_id AS doc_id, r.purchase_id IS NOT NULL AS accepted,
       CASE WHEN r.purchase_id IS NULL THEN 'no_lines_to_recover' END AS reason
FROM s_purchase p LEFT JOIN ({_RECOVERABLE}) r ON r.purchase_id = p.purchase_id
WHERE p.is_deleted = 1""",
    "w09_recover_purchases_stock": """
SELECT COALESCE(s.warehouse_id, m.warehouse_id) AS warehouse_id, COALESCE(s.product_id, m.product_id) AS product_id,
       CAST(COALESCE(s.quantity, 0) + COALESCE(m.q, 0) AS DOUBLE) AS quantity
FROM s_warehouse_stock s FULL OUTER JOIN (
  SELECT p.warehouse_id, d.product_id, SUM(d.quantity) AS q
  FROM s_purchase p JOIN s_purchase_detail d ON d.purchase_id = p.purchase_id
  WHERE p.is_deleted = 1 AND d.is_deleted_with_purchase = 1 AND d.is_deleted IS NULL
  GROUP BY p.warehouse_id, d.product_id) m ON m.warehouse_id = s.warehouse_id AND m.product_id = s.product_id""",
    "w10_delete_sales_stock": f"""
SELECT s.branch_id, s.product_id, CAST(s.quantity + COALESCE(m.q, 0) AS DOUBLE) AS quantity
FROM s_branch_stock s LEFT JOIN ({_LIVE_SALE_MOVES}) m ON m.branch_id = s.branch_id AND m.product_id = s.product_id""",
    "w13_edit_sales_reprice": """
SELECT s.sale_id, CAST(COALESCE(SUM(l.quantity * l.price), 0) AS DOUBLE) AS total
FROM s_sale s LEFT JOIN (
  SELECT d.sale_id, d.quantity, CASE WHEN d.sale_id%50 IN (1, 3) THEN d.kg_price_at_sale_time ELSE p.sale_price_per_kg END AS price
  FROM s_sale_detail d JOIN s_product p ON p.product_id = d.product_id
  WHERE d.is_deleted IS NULL) l ON l.sale_id = s.sale_id
WHERE s.is_deleted IS NULL
GROUP BY s.sale_id""",
    "w16_recover_products_decisions": f"""
SELECT product_id AS doc_id, true AS accepted, NULL AS reason FROM s_product WHERE is_deleted = 1
UNION ALL SELECT product_id+{OFFSET}, false, 'not_found' FROM s_product WHERE is_deleted = 1""",
    "w17_new_products_decisions": f"""
SELECT product_id+CASE WHEN product_id%3=0 THEN {OFFSET} ELSE 0 END AS doc_id, product_id%3<>0 AS accepted,
       CASE WHEN product_id%3=0 THEN 'missing_category' END AS reason FROM s_product""",
    "w17_employees_decisions": """
SELECT employee_id AS doc_id, employee_id%7<>0 AS accepted, CASE WHEN employee_id%7=0 THEN 'unknown_branch' END AS reason FROM s_employee""",
    "w18_delete_customers_decisions": f"""
SELECT customer_id+CASE WHEN email IS NULL THEN 0 ELSE {OFFSET} END AS doc_id, email IS NULL AS accepted,
       CASE WHEN email IS NOT NULL THEN 'not_found' END AS reason FROM s_customer""",
    "w16_delete_idle_suppliers": """
SELECT su.supplier_id, su.supplier_name, su.location, su.phone_number, su.email,
       CASE WHEN su.supplier_id NOT IN (
         SELECT p.supplier_id FROM s_purchase p WHERE p.is_deleted IS NULL AND EXISTS (
           SELECT 1 FROM s_purchase_detail d WHERE d.purchase_id = p.purchase_id AND d.is_deleted IS NULL AND d.quantity >= 45)
         GROUP BY p.supplier_id HAVING COUNT(*) >= 10) THEN 1 ELSE su.is_deleted END AS is_deleted
FROM s_supplier su""",
    "w17_edit_suppliers": f"""
SELECT supplier_id, CASE WHEN supplier_id%50=1 THEN supplier_name ELSE upper(supplier_name) END AS supplier_name, location, phone_number,
       email, is_deleted FROM s_supplier
UNION ALL SELECT supplier_id+{OFFSET}, 'NEW', location, NULL, NULL, NULL FROM s_supplier WHERE is_deleted = 1""",
    "w17_edit_suppliers_decisions": f"""
SELECT supplier_id AS doc_id, supplier_id%50<>1 AS accepted, CASE WHEN supplier_id%50=1 THEN 'duplicate_in_batch' END AS reason FROM s_supplier
UNION ALL SELECT supplier_id+{OFFSET}, true, NULL FROM s_supplier WHERE is_deleted = 1""",
    "w17_edit_products_decisions": """
SELECT product_id AS doc_id, product_id%20<>0 AS accepted, CASE WHEN product_id%20=0 THEN 'missing_category' END AS reason FROM s_product""",
    "s04_explode_sale_forms": """
SELECT sale_id AS doc_id, product_id, CAST(quantity AS DOUBLE) AS quantity, CAST(kg_price_at_sale_time AS DOUBLE) AS price, NULL AS reason
FROM s_sale_detail WHERE product_id%17<>0 AND product_id%19<>0
UNION ALL SELECT sale_id, NULL, NULL, NULL, 'not_a_number' FROM s_sale_detail WHERE product_id%17<>0 AND product_id%19=0""",
    "s05_clean_employees": """
SELECT employee_id, employee_name, phone_number, position, CASE WHEN employee_id%25<>0 THEN CAST(salary AS DOUBLE) END AS salary,
       warehouse_id, branch_id, CASE WHEN employee_id%25=0 THEN 'salary_not_a_number' END AS reason FROM s_employee""",
    "l16_edit_availability_last_day": """
SELECT s.sale_id, p.product_id, p.product_name, CAST(p.sale_price_per_kg AS DOUBLE) AS sale_price_per_kg,
       CAST(bs.quantity + COALESCE(o.q, 0) AS DOUBLE) AS available_qty
FROM s_sale s JOIN s_branch_stock bs ON bs.branch_id = s.branch_id JOIN s_product p ON p.product_id = bs.product_id
LEFT JOIN (SELECT sale_id, product_id, SUM(quantity) AS q FROM s_sale_detail WHERE is_deleted IS NULL GROUP BY sale_id, product_id) o
  ON o.sale_id = s.sale_id AND o.product_id = bs.product_id
WHERE s.is_deleted IS NULL AND p.is_deleted IS NULL AND s.sale_date = (SELECT MAX(sale_date) FROM s_sale WHERE is_deleted IS NULL)""",
    "w18_delete_customers_without_email": """
SELECT s.sale_id, CASE WHEN g.customer_id IS NOT NULL THEN NULL ELSE s.customer_id END AS customer_id, s.branch_id
FROM s_sale s LEFT JOIN (SELECT customer_id FROM s_customer WHERE email IS NULL) g ON g.customer_id = s.customer_id""",
    "w19_delete_warehouses": f"""
SELECT w.warehouse_id AS doc_id, r.warehouse_id IS NULL AS accepted,
       CASE WHEN r.warehouse_id IS NOT NULL THEN 'referenced' END AS reason
FROM s_warehouse w LEFT JOIN (
  SELECT DISTINCT warehouse_id FROM (
    SELECT warehouse_id FROM s_employee UNION ALL SELECT warehouse_id FROM s_purchase
    UNION ALL SELECT warehouse_id FROM s_transfer UNION ALL SELECT warehouse_id FROM s_warehouse_stock) u
  WHERE warehouse_id IS NOT NULL) r ON r.warehouse_id = w.warehouse_id
UNION ALL SELECT warehouse_id+{OFFSET}, true, NULL FROM s_warehouse
UNION ALL SELECT warehouse_id+{5 * OFFSET}, false, 'not_found' FROM s_warehouse
UNION ALL SELECT warehouse_id+{6 * OFFSET}, false, 'not_found' FROM s_warehouse""",
    "x02_stream_stock_fold": f"""
SELECT 'warehouse' AS location_type, location_id, product_id, CAST(q AS DOUBLE) AS quantity FROM ({_WH_REBUILD}) w
UNION ALL
SELECT 'branch' AS location_type, location_id, product_id, CAST(q AS DOUBLE) AS quantity FROM ({_BR_REBUILD}) b""",
    "w07_delete_payments_of_deleted_purchases": """
SELECT payment_id, purchase_id, CASE WHEN is_deleted_with_purchase = 1 THEN 1 ELSE is_deleted END AS is_deleted
FROM s_payment""",
    "w17_upsert_cleaned_customers": """
SELECT customer_id, customer_name, phone_number, CAST(date_of_birth AS VARCHAR) AS date_of_birth, email
FROM s_customer""",
    "s02_fk_audit": (_FLAWED, re.sub(r"\bs_(purchase|sale|branch_stock)\b", r"a_\1", _audit_sql())),
    "s02_audit_with_line_keys": _keyed_audit_sql(),
    "s02_line_keys": "\nUNION ALL\n".join(
        f"""SELECT '{name}' AS table_name, {n} AS n_lines, {n} AS n_keys, 1 AS first_key, {n} AS last_key, (SELECT COUNT(*) FROM s_{name}) AS old_lines_kept"""
        for name, n in ((name, f"((SELECT COUNT(*) FROM s_{name}){more})") for name, more in (
            ("purchase_detail", f""" + (SELECT COUNT(*) FROM s_purchase_detail d JOIN s_purchase p ON p.purchase_id = d.purchase_id
              WHERE p.is_deleted IS NULL AND d.is_deleted IS NULL AND {_good('p.purchase_id')})"""), ("sale_detail", ""), ("transfer_detail", "")))),
    "s02_audit_of_versions": (_FLAWED.replace("product_id%100<>3", "product_id%200<>3") + f""",
a_supplier AS (SELECT supplier_id FROM s_supplier UNION ALL SELECT supplier_id+{OFFSET} FROM s_supplier WHERE supplier_id%20=0),
a_payment AS (SELECT * FROM s_payment UNION ALL SELECT * FROM s_payment WHERE payment_id%30=4),
a_customer AS (SELECT * FROM s_customer WHERE customer_id%70<>9)""",
                              re.sub(r"\bs_(purchase|sale|branch_stock|supplier|payment|customer)\b", r"a_\1", _audit_sql())),
    "s05_clean_customers": """
SELECT customer_id, customer_name, phone_number, CAST(date_of_birth AS VARCHAR) AS date_of_birth, email
FROM s_customer""",
}

JOB_SQL["s07_post_through_key_index"] = JOB_SQL["w06_post_sales_decisions"]

# The same dated reports over all dates: the range predicate becomes TRUE.
for _key, _sql in _report_sql(lambda col: "TRUE").items():
    if _sql != REPORT_SQL[_key]:
        REPORT_SQL[f"{_key}_all_dates"] = _sql

REPORT_SQL["r21_chart_series_income"] = f"""
SELECT b.branch_name AS label, CAST(SUM(d.quantity*d.kg_price_at_sale_time) AS DOUBLE) AS value
FROM s_sale s JOIN s_sale_detail d ON d.sale_id = s.sale_id JOIN s_branch b ON b.branch_id = s.branch_id
WHERE s.is_deleted IS NULL AND d.is_deleted IS NULL AND b.is_deleted IS NULL AND {_range('s.sale_date')}
GROUP BY b.branch_name"""

ORACLE_BODIES: dict[str, str] = {**REPORT_SQL, **LIST_SQL, **JOB_SQL}


def oracle_sql() -> dict[str, str]:
    out = {}
    for key, body in ORACLE_BODIES.items():
        if isinstance(body, tuple):
            extra, main = body
            out[key] = with_fixture(main, extra)
        else:
            out[key] = with_fixture(body)
    return out
