"""The twenty business reports (R01-R20) and their chart series.

Every report is ``fn(t, start=None, end=None, **params) -> DataFrame``.  The shape
of every plan is the same:

1. filter the fact table (flags, optional date range) - pushed into the scan;
2. join lines to the filtered headers (averages per document sum them to their
   document key first);
3. aggregate to the *id* of the dimension (partial + final aggregation, so a hot
   branch/supplier/product collapses map-side and never skews a shuffle);
4. only then look up the dimension row (at most one row per id on each side) and,
   where the report groups by *name* (rule K9), merge same-named ids.

Dimension lookups carry no broadcast hint: Spark broadcasts the side only when its
size estimate is under ``spark.sql.autoBroadcastJoinThreshold`` (or AQE finds the
materialised side small) and uses a sort-merge join beyond it.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depotline.functions.dates import DateLike, in_date_range, in_document_months
from depotline.functions.flags import active
from depotline.operators.rollups import purchase_amount, purchase_lines, sale_amount, sale_lines
from depotline.sources.tables import Tables

AVG_SCALE = 8  # an average of decimal(.,4) values keeps 4 more places


def exact_avg(total: Column, count: Column) -> Column:
    """sum / count of decimal(.,4) values as an exact decimal with 8 places (HALF_UP)."""
    return F.round(total.cast("decimal(28,4)") / count.cast("decimal(20,0)"), AVG_SCALE)


def _live_sales(t: Tables, start: DateLike, end: DateLike) -> DataFrame:
    return in_document_months(in_date_range(active(t.sale), "sale_date", start, end), start, end)


def _live_purchases(t: Tables, start: DateLike, end: DateLike) -> DataFrame:
    return in_document_months(in_date_range(active(t.purchase), "purchase_date", start, end), start, end)


def _sales_with_amount(t: Tables, start: DateLike, end: DateLike, *cols: str) -> DataFrame:
    """Live sales in range that have at least one live line, with their amount."""
    sales = _live_sales(t, start, end)
    return sales.select("sale_id", *cols).join(
        sale_amount(t, sales, start, end).select("sale_id", "amount"), "sale_id")


def _purchases_with_amount(t: Tables, start: DateLike, end: DateLike, *cols: str) -> DataFrame:
    purchases = _live_purchases(t, start, end)
    return purchases.select("purchase_id", *cols).join(
        purchase_amount(t, documents=purchases, start=start, end=end).select("purchase_id", "total"), "purchase_id")


def _sold(t: Tables, start: DateLike, end: DateLike, col: str) -> DataFrame:
    """``col`` of the header -> amount over live lines of live sales in range: a plain
    sum, so lines meet their filtered headers and no per-document step is needed."""
    sales = _live_sales(t, start, end).select("sale_id", col)
    return sale_lines(t, start=start, end=end).join(sales, "sale_id").groupBy(col).agg(F.sum("line_value").alias("amount"))


def _bought(t: Tables, start: DateLike, end: DateLike, col: str) -> DataFrame:
    purchases = _live_purchases(t, start, end).select("purchase_id", col)
    return purchase_lines(t, start=start, end=end).join(purchases, "purchase_id").groupBy(col).agg(F.sum("line_value").alias("total"))


def _branch_names(t: Tables) -> DataFrame:
    return active(t.branch).select("branch_id", "branch_name")


def _supplier_names(t: Tables) -> DataFrame:
    return active(t.supplier).select("supplier_id", "supplier_name")


# --------------------------------------------------------------------------- sales

def r01_income_per_branch(t: Tables, start: DateLike = None, end: DateLike = None) -> DataFrame:
    return (_sold(t, start, end, "branch_id").join(_branch_names(t), "branch_id")
            .groupBy("branch_name").agg(F.sum("amount").alias("total_income")))


def r02_sales_count_per_branch(t: Tables, start: DateLike = None, end: DateLike = None) -> DataFrame:
    per_branch = _live_sales(t, start, end).groupBy("branch_id").agg(F.count(F.lit(1)).alias("n"))
    return (per_branch.join(_branch_names(t), "branch_id")
            .groupBy("branch_name").agg(F.sum("n").alias("sales_count")))


def r03_avg_sale_per_branch(t: Tables, start: DateLike = None, end: DateLike = None) -> DataFrame:
    per_branch = (_sales_with_amount(t, start, end, "branch_id")
                  .groupBy("branch_id").agg(F.sum("amount").alias("s"), F.count(F.lit(1)).alias("n")))
    return (per_branch.join(_branch_names(t), "branch_id")
            .groupBy("branch_name")
            .agg(exact_avg(F.sum("s"), F.sum("n")).alias("avg_sale_amount")))


def r04_daily_amount_for_branch(t: Tables, start: DateLike = None, end: DateLike = None,
                                branch_id: int | None = None) -> DataFrame:
    """Without a branch the reference compares with NULL: the result is empty."""
    sales = _live_sales(t, start, end)
    if branch_id is None or (isinstance(branch_id, str) and not branch_id.strip()):
        sales = sales.where(F.lit(False))
    else:
        sales = sales.where(F.col("branch_id") == F.lit(int(branch_id)))
    return (sale_lines(t, start=start, end=end).join(sales.select("sale_id", "sale_date"), "sale_id")
            .groupBy("sale_date").agg(F.sum("line_value").alias("daily_amount"))
            .orderBy("sale_date"))


def r05_sales_per_employee(t: Tables, start: DateLike = None, end: DateLike = None) -> DataFrame:
    per_emp = _live_sales(t, start, end).groupBy("employee_id").agg(F.count(F.lit(1)).alias("n"))
    names = active(t.employee).select("employee_id", "employee_name")
    return (per_emp.join(names, "employee_id")
            .groupBy("employee_name").agg(F.sum("n").alias("number_of_sales"))
            .orderBy(F.desc("number_of_sales")))


def _revenue_per_product(t: Tables, start: DateLike, end: DateLike) -> DataFrame:
    """product_id -> revenue over live lines of live sales in range."""
    sales = _live_sales(t, start, end).select("sale_id")
    return (sale_lines(t, start=start, end=end).join(sales, "sale_id", "left_semi")
            .groupBy("product_id").agg(F.sum("line_value").alias("revenue")))


def r06_revenue_per_product(t: Tables, start: DateLike = None, end: DateLike = None) -> DataFrame:
    """Deleted products are kept."""
    return (_revenue_per_product(t, start, end)
            .join(t.product.select("product_id", "product_name"), "product_id")
            .select("product_id", "product_name", F.col("revenue").alias("total_sales_amount"))
            .orderBy(F.desc("total_sales_amount")))


def r07_revenue_per_category(t: Tables, start: DateLike = None, end: DateLike = None) -> DataFrame:
    return (_revenue_per_product(t, start, end)
            .join(t.product.select("product_id", "category"), "product_id")
            .groupBy("category").agg(F.sum("revenue").alias("total_sales_amount")))


def r08_spend_per_customer(t: Tables, start: DateLike = None, end: DateLike = None) -> DataFrame:
    """Walk-in sales (customer NULL) have no customer row and drop out (K6)."""
    per_cust = _sold(t, start, end, "customer_id").where(F.col("customer_id").isNotNull()).withColumnRenamed("amount", "spent")
    return (per_cust.join(t.customer.select("customer_id", "customer_name"), "customer_id")
            .select("customer_id", "customer_name", F.col("spent").alias("total_amount_spent"))
            .orderBy(F.desc("total_amount_spent")))


# ------------------------------------------------------------------ purchases

def _paid_per_supplier(t: Tables, start: DateLike, end: DateLike) -> DataFrame:
    """supplier_id -> live payments (dated in range) of live purchases."""
    per_purchase = (in_date_range(active(t.payment), "payment_date", start, end)
                    .groupBy("purchase_id").agg(F.sum("amount").alias("paid")))
    return (per_purchase.join(active(t.purchase).select("purchase_id", "supplier_id"), "purchase_id")
            .groupBy("supplier_id").agg(F.sum("paid").alias("paid")))


def r09_payments_per_supplier(t: Tables, start: DateLike = None, end: DateLike = None) -> DataFrame:
    """The date range applies to the payment date."""
    return (_paid_per_supplier(t, start, end).join(_supplier_names(t), "supplier_id")
            .select("supplier_id", "supplier_name", F.col("paid").alias("total_payments_amount"))
            .orderBy(F.desc("total_payments_amount")))


def r10_unpaid_per_supplier(t: Tables) -> DataFrame:
    """Live suppliers; nothing owed or paid -> 0; overpaid -> negative."""
    owed = _bought(t, None, None, "supplier_id").withColumnRenamed("total", "owed")
    paid = _paid_per_supplier(t, None, None)
    zero = F.lit(0).cast("decimal(10,2)")
    return (_supplier_names(t).join(paid, "supplier_id", "left").join(owed, "supplier_id", "left")
            .select("supplier_id", "supplier_name",
                    (F.coalesce(F.col("owed"), zero) - F.coalesce(F.col("paid"), zero)).alias("unpaid_amount"))
            .orderBy(F.desc("unpaid_amount")))


def r11_purchase_value_per_warehouse(t: Tables, start: DateLike = None, end: DateLike = None) -> DataFrame:
    per_wh = _bought(t, start, end, "warehouse_id").withColumnRenamed("total", "v")
    return (per_wh.join(t.warehouse.select("warehouse_id", "warehouse_name"), "warehouse_id")
            .groupBy("warehouse_name").agg(F.sum("v").alias("total_purchase_value"))
            .orderBy(F.desc("total_purchase_value")))


def r12_purchase_count_per_warehouse(t: Tables, start: DateLike = None, end: DateLike = None) -> DataFrame:
    per_wh = _live_purchases(t, start, end).groupBy("warehouse_id").agg(F.count(F.lit(1)).alias("n"))
    return (per_wh.join(t.warehouse.select("warehouse_id", "warehouse_name"), "warehouse_id")
            .groupBy("warehouse_name").agg(F.sum("n").alias("purchases_count"))
            .orderBy(F.desc("purchases_count")))


def r13_purchased_per_supplier(t: Tables, start: DateLike = None, end: DateLike = None) -> DataFrame:
    per_sup = _bought(t, start, end, "supplier_id").withColumnRenamed("total", "v")
    return (per_sup.join(_supplier_names(t), "supplier_id")
            .select("supplier_id", "supplier_name", F.col("v").alias("total_purchased_amount"))
            .orderBy(F.desc("total_purchased_amount")))


def r14_avg_purchase_per_supplier(t: Tables, start: DateLike = None, end: DateLike = None) -> DataFrame:
    """Purchases without live lines are not in the denominator (K8)."""
    per_sup = (_purchases_with_amount(t, start, end, "supplier_id")
               .groupBy("supplier_id").agg(F.sum("total").alias("s"), F.count(F.lit(1)).alias("n")))
    return (per_sup.join(_supplier_names(t), "supplier_id")
            .groupBy("supplier_name").agg(exact_avg(F.sum("s"), F.sum("n")).alias("avg_purchase_value"))
            .orderBy(F.desc("avg_purchase_value")))


def r15_paid_per_method(t: Tables, start: DateLike = None, end: DateLike = None) -> DataFrame:
    """Whether the purchase is deleted is not looked at."""
    return (in_date_range(active(t.payment), "payment_date", start, end)
            .groupBy("method").agg(F.sum("amount").alias("total_amount"))
            .orderBy(F.desc("total_amount")))


# ------------------------------------------------------------------ transfers

def _transfers(t: Tables, start: DateLike, end: DateLike) -> DataFrame:
    return in_document_months(in_date_range(t.transfer, "transfer_date", start, end), start, end)


def r16_transfers_per_branch(t: Tables, start: DateLike = None, end: DateLike = None) -> DataFrame:
    per_branch = _transfers(t, start, end).groupBy("branch_id").agg(F.count(F.lit(1)).alias("n"))
    return (per_branch.join(_branch_names(t), "branch_id")
            .groupBy("branch_name").agg(F.sum("n").alias("transfers_count"))
            .orderBy(F.desc("transfers_count")))


def r17_qty_transferred_per_branch(t: Tables, start: DateLike = None, end: DateLike = None) -> DataFrame:
    per_branch = (in_document_months(t.transfer_detail, start, end).join(_transfers(t, start, end).select("transfer_id", "branch_id"), "transfer_id")
                  .groupBy("branch_id").agg(F.sum("quantity").alias("q")))
    return (per_branch.join(_branch_names(t), "branch_id")
            .groupBy("branch_name").agg(F.sum("q").alias("total_transferred_qty"))
            .orderBy(F.desc("total_transferred_qty")))


def r18_qty_transferred_per_product(t: Tables, start: DateLike = None, end: DateLike = None,
                                    limit: int | None = None) -> DataFrame:
    """All products including deleted ones (K11); no limit unless asked."""
    headers = _transfers(t, start, end).select("transfer_id")
    per_product = (in_document_months(t.transfer_detail, start, end).join(headers, "transfer_id", "left_semi")
                   .groupBy("product_id").agg(F.sum("quantity").alias("q")))
    out = (per_product.join(t.product.select("product_id", "product_name"), "product_id")
           .select("product_id", "product_name", F.col("q").alias("total_transferred_qty"))
           .orderBy(F.desc("total_transferred_qty"), "product_id"))
    return out.limit(int(limit)) if limit is not None else out


# ---------------------------------------------------------------------- stock

def r19_warehouse_out_of_stock(t: Tables) -> DataFrame:
    """Existing stock rows with quantity <= 0 of active products."""
    return (t.warehouse_stock.where(F.col("quantity") <= 0)
            .join(t.warehouse.select("warehouse_id", "warehouse_name"), "warehouse_id")
            .join(active(t.product).select("product_id", "product_name"), "product_id")
            .select("warehouse_name", "product_id", "product_name", "quantity")
            .orderBy("warehouse_name", "product_name"))


def r20_branch_out_of_stock(t: Tables) -> DataFrame:
    """Deleted branches are kept."""
    return (t.branch_stock.where(F.col("quantity") <= 0)
            .join(t.branch.select("branch_id", "branch_name"), "branch_id")
            .join(active(t.product).select("product_id", "product_name"), "product_id")
            .select("branch_name", "product_id", "product_name", "quantity")
            .orderBy("branch_name", "product_name"))


# ------------------------------------------------------------------- registry

@dataclasses.dataclass(frozen=True)
class Report:
    report_id: str
    name: str
    chart: str  # bar | line | pie | table
    takes_dates: bool
    fn: Callable[..., DataFrame]


# Fixed report catalogue: id, title and chart kind as shown to users.
REPORTS: dict[str, Report] = {r.report_id: r for r in (
    Report("1", "Total Income per branch", "bar", True, r01_income_per_branch),
    Report("2", "Number of sales per branch", "bar", True, r02_sales_count_per_branch),
    Report("3", "Average amount of money in a sale per branch", "bar", True, r03_avg_sale_per_branch),
    Report("4", "Daily Sales Amount for a chosen branch", "line", True, r04_daily_amount_for_branch),
    Report("5", "Number of sales by employee", "table", True, r05_sales_per_employee),
    Report("6", "Total amount of money each product sold for", "table", True, r06_revenue_per_product),
    Report("7", "Sales amount for each product category", "pie", True, r07_revenue_per_category),
    Report("8", "Registered Customers and total amount spent by each one", "table", True, r08_spend_per_customer),
    Report("9", "Total payments amounts per supplier", "table", True, r09_payments_per_supplier),
    Report("10", "Total unpaid amount per supplier", "table", False, r10_unpaid_per_supplier),
    Report("11", "Total purchase value per warehouse", "bar", True, r11_purchase_value_per_warehouse),
    Report("12", "Number of purchases per warehouse", "bar", True, r12_purchase_count_per_warehouse),
    Report("13", "Total purchased amount per supplier", "table", True, r13_purchased_per_supplier),
    Report("14", "Average purchase value per supplier", "bar", True, r14_avg_purchase_per_supplier),
    Report("15", "Payment method distribution (by total amount)", "pie", True, r15_paid_per_method),
    Report("16", "Number of transfers per branch", "bar", True, r16_transfers_per_branch),
    Report("17", "Total quantity transferred to each branch", "bar", True, r17_qty_transferred_per_branch),
    Report("18", "Top transferred products by quantity", "table", True, r18_qty_transferred_per_product),
    Report("19", "Out-of-stock products at warehouses", "table", False, r19_warehouse_out_of_stock),
    Report("20", "Out-of-stock products at retail branches", "table", False, r20_branch_out_of_stock),
)}


def run_report(t: Tables, report_id: str | int, start: DateLike = None, end: DateLike = None,
               branch_id: int | str | None = None) -> DataFrame:
    """Run a report by id; empty strings mean "not given" (K5).

    Reports without dates ignore the range (K13); only report 4 takes a branch.
    """
    rep = REPORTS[str(report_id)]
    if not rep.takes_dates:
        return rep.fn(t)
    if rep.report_id == "4":
        return rep.fn(t, start, end, branch_id=branch_id or None)
    return rep.fn(t, start, end)


def chart_series(report_id: str | int, df: DataFrame) -> DataFrame | None:
    """For bar/line/pie reports the first column is the label, the second the value."""
    rep = REPORTS[str(report_id)]
    if rep.chart == "table":
        return None
    first, second = df.columns[0], df.columns[1]
    return df.select(F.col(first).alias("label"), F.col(second).alias("value"))
