"""Document and entity lists.

Lists keep every header row (left joins to names, rule K7: a document without live
lines shows total 0).  Line totals come from the pre-aggregated rollups, joined on
the document key; name lookups are left joins on unique keys, so they never add
rows.  Sorting follows the reference pages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depotline.functions.flags import active, line_value, state
from depotline.functions.joins import lookup
from depotline.operators.rollups import purchase_amount, purchase_balance, sale_amount, transfer_qty
from depotline.session import stage
from depotline.sources.tables import Tables


def _zero4() -> F.Column:
    return F.lit(0).cast("decimal(31,4)")


def _iso_or_empty(col: str) -> F.Column:
    return F.coalesce(F.date_format(F.col(col), "yyyy-MM-dd"), F.lit(""))


def _names(t: Tables) -> dict[str, DataFrame]:
    return {
        "customer": t.customer.select("customer_id", "customer_name"),
        "employee": t.employee.select("employee_id", "employee_name"),
        "branch": t.branch.select("branch_id", "branch_name"),
        "warehouse": t.warehouse.select("warehouse_id", "warehouse_name"),
        "supplier": t.supplier.select("supplier_id", "supplier_name"),
        "product": t.product.select("product_id", "product_name"),
    }


# ---------------------------------------------------------------- sales (L1-L3)

def sales_list(t: Tables, which: str = "active", employee_id: int | None = None) -> DataFrame:
    """L1/L2: sales with customer, employee and branch names and their total.

    ``employee_id`` restricts to one employee's sales (the non-admin scope).
    """
    n = _names(t)
    sales = state(t.sale, which)
    if employee_id is not None:
        sales = sales.where(F.col("employee_id") == F.lit(int(employee_id)))
    totals = sale_amount(t, sales).select("sale_id", F.col("amount").alias("total"))
    # Totals first (headers and lines share the sale_id partitioning), then the
    # customer lookup with NULL keys (walk-ins) salted so they spread out.
    return (lookup(sales.join(totals, "sale_id", "left"), n["customer"], "customer_id")
            .transform(lookup, n["employee"], "employee_id")
            .join(n["branch"], "branch_id", "left")
            .select("sale_id", "customer_id", "customer_name", "employee_id", "employee_name",
                    "branch_id", "branch_name", "sale_date", "payment_method",
                    F.coalesce(F.col("total"), _zero4()).alias("total"))
            .orderBy(F.desc("sale_date"), F.desc("sale_id")))


def sale_lines_list(t: Tables) -> DataFrame:
    """L3: live lines of every sale with product name and line total."""
    return (active(t.sale_detail).join(_names(t)["product"], "product_id", "left")
            .select("sale_id", "product_id", "product_name", "quantity", "kg_price_at_sale_time",
                    line_value("quantity", "kg_price_at_sale_time").alias("line_total")))


# ------------------------------------------------------------ purchases

def purchases_list(t: Tables, which: str = "active", warehouse_id: int | None = None) -> DataFrame:
    """Purchases with names, total (live lines), paid (live payments), remaining."""
    n = _names(t)
    purchases = state(t.purchase, which)
    if warehouse_id is not None:
        purchases = purchases.where(F.col("warehouse_id") == F.lit(int(warehouse_id)))
    bal = purchase_balance(t, documents=purchases)
    return (bal.join(n["warehouse"], "warehouse_id", "left")
            .join(n["supplier"], "supplier_id", "left")
            .transform(lookup, n["employee"], "employee_id")
            .select("purchase_id", "purchase_date", "warehouse_id", "warehouse_name", "supplier_id",
                    "supplier_name", "employee_id", "employee_name", "total", "paid", "remaining")
            .orderBy(F.desc("purchase_id")))


def purchase_lines_list(t: Tables) -> DataFrame:
    """Live purchase lines with product name and line value."""
    return (active(t.purchase_detail).join(_names(t)["product"], "product_id", "left")
            .select("purchase_id", "product_id", "product_name", "quantity", "kg_price_at_purchase_time",
                    line_value("quantity", "kg_price_at_purchase_time").alias("line_value")))


def purchase_totals(t: Tables) -> DataFrame:
    """Total of live lines for every purchase header (0 without lines)."""
    return (t.purchase.select("purchase_id")
            .join(purchase_amount(t).select("purchase_id", "total"), "purchase_id", "left")
            .select("purchase_id", F.coalesce(F.col("total"), _zero4()).alias("total")))


# ------------------------------------------------------------ transfers

def transfers_list(t: Tables, warehouse_id: int | None = None) -> DataFrame:
    """Transfers with names and total quantity (0 without lines)."""
    n = _names(t)
    tr = t.transfer
    if warehouse_id is not None:
        tr = tr.where(F.col("warehouse_id") == F.lit(int(warehouse_id)))
    per_transfer = transfer_qty(t, None if warehouse_id is None else tr)
    return (tr.join(per_transfer.select("transfer_id", "total_qty"), "transfer_id", "left")
            .join(n["warehouse"], "warehouse_id", "left")
            .join(n["branch"], "branch_id", "left")
            .transform(lookup, n["employee"], "employee_id")
            .select("transfer_id", "transfer_date", "warehouse_id", "warehouse_name", "branch_id",
                    "branch_name", "employee_id", "employee_name",
                    F.coalesce(F.col("total_qty"), F.lit(0).cast("decimal(20,2)")).alias("total_qty"))
            .orderBy(F.desc("transfer_id")))


def transfer_lines_list(t: Tables) -> DataFrame:
    """Transfer lines with product name."""
    return (t.transfer_detail.join(_names(t)["product"], "product_id", "left")
            .select("transfer_id", "product_id", "product_name", "quantity"))


# ------------------------------------------------------------ payments

def _settlement(t: Tables) -> DataFrame:
    """Live purchases with a supplier row (deleted suppliers too, K16)."""
    bal = purchase_balance(t, documents=active(t.purchase))
    return (bal.join(t.supplier.select("supplier_id", "supplier_name"), "supplier_id")
            .select("purchase_id", "purchase_date", "supplier_name",
                    F.col("total").alias("total_amount"), F.col("paid").alias("paid_amount"),
                    F.col("remaining")))


def unpaid_purchases(t: Tables) -> DataFrame:
    """Paid < total."""
    return _settlement(t).where(F.col("paid_amount") < F.col("total_amount")).orderBy(F.desc("purchase_date"), F.desc("purchase_id"))


def completed_purchases(t: Tables) -> DataFrame:
    """Paid >= total, so a zero-total unpaid purchase counts as completed."""
    return _settlement(t).where(F.col("paid_amount") >= F.col("total_amount")).orderBy(F.desc("purchase_date"), F.desc("purchase_id"))


def payment_statement(t: Tables, include_deleted_lines: bool = False) -> DataFrame:
    """Every purchase (deleted ones too) with names, total, total paid, remaining.

    Deleted payments never count.  ``include_deleted_lines=True`` also counts
    deleted purchase lines in the total, as the reference statement page does (D1).
    """
    n = _names(t)
    bal = purchase_balance(t, include_deleted_lines)
    return (bal.join(n["supplier"], "supplier_id", "left")
            .transform(lookup, n["employee"], "employee_id")
            .join(n["warehouse"], "warehouse_id", "left")
            .select("purchase_id", "supplier_id", "supplier_name", "employee_id", "employee_name",
                    "warehouse_id", "warehouse_name", "purchase_date", "total",
                    F.col("paid").alias("total_paid"), "remaining"))


def payments_list(t: Tables, which: str = "active", purchase_id: int | None = None) -> DataFrame:
    """Payments with the name of the employee who recorded them."""
    pay = state(t.payment, which)
    if purchase_id is not None:
        pay = pay.where(F.col("purchase_id") == F.lit(int(purchase_id)))
    return (pay.join(_names(t)["employee"], "employee_id", "left")
            .select("payment_id", "purchase_id", "payment_date", "amount", "method", "employee_name")
            .orderBy("payment_date", "payment_id"))


# --------------------------------------------------------------- stock

def warehouse_stock_view(t: Tables, warehouse_id: int | None = None) -> DataFrame:
    """L13."""
    n = _names(t)
    ws = t.warehouse_stock
    if warehouse_id is not None:
        ws = ws.where(F.col("warehouse_id") == F.lit(int(warehouse_id)))
    return (ws.join(n["warehouse"], "warehouse_id", "left").join(n["product"], "product_id", "left")
            .select("warehouse_id", "warehouse_name", "product_id", "product_name", "quantity")
            .orderBy("warehouse_id", "product_id"))


def branch_stock_view(t: Tables, branch_id: int | None = None) -> DataFrame:
    """L14."""
    n = _names(t)
    bs = t.branch_stock
    if branch_id is not None:
        bs = bs.where(F.col("branch_id") == F.lit(int(branch_id)))
    return (bs.join(n["branch"], "branch_id", "left").join(n["product"], "product_id", "left")
            .select("branch_id", "branch_name", "product_id", "product_name", "quantity")
            .orderBy("branch_id", "product_id"))


def sellable_products(t: Tables, branch_id: int | None = None) -> DataFrame:
    """Active products with positive stock at a branch (all branches if none given)."""
    bs = t.branch_stock.where(F.col("quantity") > 0)
    if branch_id is not None:
        bs = bs.where(F.col("branch_id") == F.lit(int(branch_id)))
    prod = active(t.product).select("product_id", "product_name", "sale_price_per_kg")
    return bs.join(prod, "product_id").select("branch_id", "product_id", "product_name",
                                              "sale_price_per_kg", "quantity")


def edit_availability(t: Tables, sale_ids: DataFrame) -> DataFrame:
    """L16 for a given set of sales being edited (``sale_ids`` has a ``sale_id`` column).

    For each such active sale and each active product stocked at its branch (also
    at quantity 0): branch stock plus the sale's own live quantity of the product.
    The output is (sales given) x (products stocked at the branch) by design, so
    the id set is the caller's edit batch, not all sales; see
    ``own_line_availability`` for the form that runs over all sales.
    The own quantities come to the stock row (a map by sale, of the given sales only), so
    the output itself is never shuffled.
    """
    sales = stage(active(t.sale).join(sale_ids.select("sale_id").distinct(), "sale_id", "left_semi")
                  .select("sale_id", "branch_id"), "edited-sales")
    own = (active(t.sale_detail).join(sales.select("sale_id"), "sale_id", "left_semi")
           .groupBy("sale_id", "product_id").agg(F.sum("quantity").alias("own_qty"))
           .join(sales.distinct(), "sale_id").groupBy("branch_id", "product_id")
           .agg(F.map_from_entries(F.collect_list(F.struct("sale_id", "own_qty"))).alias("own")))
    prod = active(t.product).select("product_id", "product_name", "sale_price_per_kg")
    stock = t.branch_stock.join(prod, "product_id").join(own, ["branch_id", "product_id"], "left")
    return (stock.join(sales, "branch_id")
            .select("sale_id", "product_id", "product_name", "sale_price_per_kg",
                    (F.col("quantity") + F.coalesce(F.try_element_at("own", F.col("sale_id")), F.lit(0))).alias("available_qty")))


def own_line_availability(t: Tables) -> DataFrame:
    """L16 restricted to the products each active sale already contains, for all sales.

    Rows are bounded by the number of live lines: (sale, product) -> branch stock
    plus the sale's own live quantity; products without a stock row at the branch
    or deleted products are absent, as on the edit page.
    """
    own = (active(t.sale_detail).groupBy("sale_id", "product_id").agg(F.sum("quantity").alias("own_qty"))
           .join(active(t.sale).select("sale_id", "branch_id"), "sale_id"))
    stock = t.branch_stock.join(active(t.product).select("product_id", "product_name", "sale_price_per_kg"),
                                "product_id")
    return (own.join(stock, ["branch_id", "product_id"])
            .select("sale_id", "branch_id", "product_id", "product_name", "sale_price_per_kg",
                    (F.col("quantity") + F.col("own_qty")).alias("available_qty")))


def transferable_products(t: Tables, warehouse_id: int | None = None) -> DataFrame:
    """Positive warehouse stock whose product is active *or missing* (left join, NULL test)."""
    ws = t.warehouse_stock.where(F.col("quantity") > 0)
    if warehouse_id is not None:
        ws = ws.where(F.col("warehouse_id") == F.lit(int(warehouse_id)))
    prod = t.product.select("product_id", "product_name", "is_deleted")
    return (ws.join(prod, "product_id", "left").where(F.col("is_deleted").isNull())
            .select("warehouse_id", "product_id", "product_name", "quantity")
            .orderBy("warehouse_id", "product_id"))


# ------------------------------------------------------------ entities

def products_list(t: Tables, which: str = "active") -> DataFrame:
    """L18."""
    return (state(t.product, which)
            .select("product_id", "product_name", "category", "purchase_price_per_kg", "sale_price_per_kg")
            .orderBy("product_id"))


def employees_list(t: Tables, which: str = "active") -> DataFrame:
    """Employees with location names, birth date as ISO text or '' (no password)."""
    n = _names(t)
    return (state(t.employee, which)
            .join(n["warehouse"], "warehouse_id", "left").join(n["branch"], "branch_id", "left")
            .select("employee_id", "employee_name", "phone_number",
                    _iso_or_empty("date_of_birth").alias("date_of_birth"), "position", "salary",
                    "warehouse_id", "warehouse_name", "branch_id", "branch_name", "is_deleted",
                    "access_level")
            .orderBy("employee_id"))


def suppliers_list(t: Tables, which: str = "active") -> DataFrame:
    """L20."""
    return state(t.supplier, which).select("supplier_id", "supplier_name", "location", "phone_number",
                                           "email", "is_deleted")


def branches_list(t: Tables, which: str = "active") -> DataFrame:
    """L21."""
    return state(t.branch, which).select("branch_id", "branch_name", "location", "phone_number", "is_deleted")


def warehouses_list(t: Tables) -> DataFrame:
    """L22."""
    return t.warehouse.select("warehouse_id", "warehouse_name", "location", "phone_number").orderBy("warehouse_id")


def customers_list(t: Tables) -> DataFrame:
    """Customers, birth date as ISO text or ''."""
    return t.customer.select("customer_id", "customer_name", "phone_number",
                             _iso_or_empty("date_of_birth").alias("date_of_birth"), "email")
