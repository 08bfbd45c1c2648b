"""Registered queries: ``key -> fn(spark, sf_dir) -> DataFrame``.

Each query derives the fifteen tables from the driver tables under ``sf_dir``
(sources.fixture) and runs one operator on the whole of them.  ``edge`` applies
the output convention shared with the DuckDB oracle (plans.oracle).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from depotline.functions.flags import active
from depotline.operators import ingest as I
from depotline.operators import lifecycle as LC
from depotline.operators import listings as L
from depotline.operators import quality as Q
from depotline.operators import stock as S
from depotline.operators import reports as R
from depotline.plans.oracle import REPORT_BRANCH, REPORT_END, REPORT_START
from depotline.sources.fixture import fixture_tables
from depotline.sources.tables import Tables, conform

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}


def edge(df: DataFrame, round4: tuple[str, ...] = ()) -> DataFrame:
    """Decimals -> double, dates -> ISO text, listed averages rounded to 4 places."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DecimalType):
            c = c.cast("double")
        elif isinstance(f.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        if f.name in round4:
            c = F.round(c, 4)
        cols.append(c.alias(f.name))
    return df.select(cols)


def register(key: str, round4: tuple[str, ...] = (), written: tuple[str, ...] = ()):
    """``written``: derived tables that the query reads several times (``fixture_tables``)."""
    def wrap(fn: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        def query(spark: SparkSession, sf_dir: str) -> DataFrame:
            return edge(fn(fixture_tables(spark, sf_dir, written)), round4)
        query.__name__ = key
        query.__doc__ = fn.__doc__
        query.operator = fn  # type: ignore[attr-defined]
        QUERIES[key] = query
        return fn
    return wrap


_S, _E = REPORT_START, REPORT_END


def _report(key: str, fn, dated: bool = True, round4: tuple[str, ...] = (), **params):
    """Register a report with the FIXTURES.md date range and, for dated reports,
    once more over all dates (``<key>_all_dates``)."""
    if dated:
        register(key, round4)(lambda t: fn(t, _S, _E, **params))
        register(f"{key}_all_dates", round4)(lambda t: fn(t, None, None, **params))
    else:
        register(key, round4)(lambda t: fn(t, **params))


_report("r01_income_per_branch", R.r01_income_per_branch)
_report("r02_sales_count_per_branch", R.r02_sales_count_per_branch)
_report("r03_avg_sale_per_branch", R.r03_avg_sale_per_branch, round4=("avg_sale_amount",))
_report("r04_daily_amount_for_branch", R.r04_daily_amount_for_branch, branch_id=REPORT_BRANCH)
_report("r05_sales_per_employee", R.r05_sales_per_employee)
_report("r06_revenue_per_product", R.r06_revenue_per_product)
_report("r07_revenue_per_category", R.r07_revenue_per_category)
_report("r08_spend_per_customer", R.r08_spend_per_customer)
_report("r09_payments_per_supplier", R.r09_payments_per_supplier)
_report("r10_unpaid_per_supplier", R.r10_unpaid_per_supplier, dated=False)
_report("r11_purchase_value_per_warehouse", R.r11_purchase_value_per_warehouse)
_report("r12_purchase_count_per_warehouse", R.r12_purchase_count_per_warehouse)
_report("r13_purchased_per_supplier", R.r13_purchased_per_supplier)
_report("r14_avg_purchase_per_supplier", R.r14_avg_purchase_per_supplier, round4=("avg_purchase_value",))
_report("r15_paid_per_method", R.r15_paid_per_method)
_report("r16_transfers_per_branch", R.r16_transfers_per_branch)
_report("r17_qty_transferred_per_branch", R.r17_qty_transferred_per_branch)
_report("r18_qty_transferred_per_product", R.r18_qty_transferred_per_product)
_report("r19_warehouse_out_of_stock", R.r19_warehouse_out_of_stock, dated=False)
_report("r20_branch_out_of_stock", R.r20_branch_out_of_stock, dated=False)


# ----------------------------------------------------------------------- lists
register("l01_active_sales")(lambda t: L.sales_list(t, "active"))
register("l02_deleted_sales")(lambda t: L.sales_list(t, "deleted"))
register("l03_sale_lines")(L.sale_lines_list)
register("l04_active_purchases")(lambda t: L.purchases_list(t, "active"))
register("l05_deleted_purchases")(lambda t: L.purchases_list(t, "deleted"))
register("l06_purchase_lines")(L.purchase_lines_list)
register("l06_purchase_totals")(L.purchase_totals)
register("l07_transfers")(L.transfers_list)
register("l08_transfer_lines")(L.transfer_lines_list)
register("l09_unpaid_purchases")(L.unpaid_purchases)
register("l10_completed_purchases")(L.completed_purchases)
register("l11_payment_statement")(L.payment_statement)
register("l11_payment_statement_all_lines")(lambda t: L.payment_statement(t, include_deleted_lines=True))
register("l12_active_payments")(lambda t: L.payments_list(t, "active"))
register("l12_deleted_payments")(lambda t: L.payments_list(t, "deleted"))
register("l13_warehouse_stock")(L.warehouse_stock_view)
register("l14_branch_stock")(L.branch_stock_view)
register("l15_sellable_products")(L.sellable_products)
register("l16_own_line_availability")(L.own_line_availability)
register("l17_transferable_products")(L.transferable_products)
register("l18_active_products")(lambda t: L.products_list(t, "active"))
register("l18_deleted_products")(lambda t: L.products_list(t, "deleted"))
register("l19_active_employees")(lambda t: L.employees_list(t, "active"))
register("l19_deleted_employees")(lambda t: L.employees_list(t, "deleted"))
register("l20_active_suppliers")(lambda t: L.suppliers_list(t, "active"))
register("l20_deleted_suppliers")(lambda t: L.suppliers_list(t, "deleted"))
register("l21_active_branches")(lambda t: L.branches_list(t, "active"))
register("l21_deleted_branches")(lambda t: L.branches_list(t, "deleted"))
register("l22_warehouses")(L.warehouses_list)
register("l22_customers")(L.customers_list)


# ---------------------------------------------------- stock, lifecycle, quality
# Batches are derived from the tables themselves, so every job runs over all of
# them: re-post every document once more, delete every active one, recover
# every deleted one.  Re-posted documents get ids shifted by NEW_ID_OFFSET.
NEW_ID_OFFSET = 10 ** 12


def _ids_of(df: DataFrame, col: str) -> DataFrame:
    return df.select(F.col(col))


def _reposted(heads: DataFrame, lines: DataFrame, key: str, ref: str) -> tuple[DataFrame, DataFrame]:
    """Documents posted once more under shifted ids, with planted flaws: of every 50
    ids, 1 stands twice in the batch, 2 keeps an id that is in use, 3 has a ``ref`` that
    names no row, the lines of 4 name no product, and those of 5 come once more under
    the id of a document that is not in the batch."""
    of = lambda n: F.col(key) % 50 == n
    changed = {key: F.when(of(2), F.col(key)).otherwise(F.col(key) + NEW_ID_OFFSET), ref: F.when(of(3), F.col(ref) + NEW_ID_OFFSET).otherwise(F.col(ref)),
               "product_id": F.when(of(4), F.col("product_id") + NEW_ID_OFFSET).otherwise(F.col("product_id"))}
    renew = lambda df: df.select(*(changed[c].alias(c) if c in changed else c for c in df.columns))
    stray = lines.where(of(5)).withColumn(key, F.col(key) + 2 * NEW_ID_OFFSET)
    return renew(heads.unionByName(heads.where(of(1)))), renew(lines).unionByName(stray)


def _twice(heads: DataFrame, key: str) -> DataFrame:
    """Edits in which 1 of every 50 ids stands twice."""
    return heads.unionByName(heads.where(F.col(key) % 50 == 1))


def _counted_branch_stock(t: Tables) -> Tables:
    """Branch stock after a count that found nothing of every fifth product and no
    row for every eleventh."""
    found = t.branch_stock.where(F.col("product_id") % 11 != 0)
    return t.replace(branch_stock=found.withColumn(
        "quantity", F.when(F.col("product_id") % 5 == 0, F.lit(0)).otherwise(F.col("quantity")).cast("decimal(20,2)")))


def _delivered(t: Tables, of: str = "transfer") -> Tables:
    """Stock after a delivery of three quarters of what all transfers (or live purchases) moved through the
    warehouses, and at the branches of all that transfers brought, of every fifth product four fifths: it
    covers a part of each batch."""
    def more(lines: DataFrame, loc: str, share: str) -> DataFrame:
        return lines.groupBy(loc, "product_id").agg(F.expr(f"cast(floor(sum(quantity)) as bigint) * {share}").alias("delta"))

    moved = t.transfer.join(t.transfer_detail, "transfer_id")
    bought = active(t.purchase).select("purchase_id", "warehouse_id").join(active(t.purchase_detail), "purchase_id")
    warehouse = S.apply_upsert(t.warehouse_stock, more(moved if of == "transfer" else bought, "warehouse_id", "3 div 4"), "warehouse_id")
    branch = S.apply_upsert(t.branch_stock, more(moved, "branch_id", "(CASE WHEN product_id % 5 = 0 THEN 8 ELSE 10 END) div 10"), "branch_id")
    return t.replace(warehouse_stock=conform(warehouse, "warehouse_stock"), branch_stock=conform(branch, "branch_stock"))


@register("x01_stock_reconcile", written=("purchase", "transfer"))
def _x01(t: Tables) -> DataFrame:
    """Documents against a snapshot that lost rows, has other quantities and holds a row too many."""
    t = _counted_branch_stock(t)
    extra = t.warehouse.select("warehouse_id", F.lit(NEW_ID_OFFSET).alias("product_id"), F.lit(5).cast("decimal(20,2)").alias("quantity"))
    return S.reconcile(t.replace(warehouse_stock=t.warehouse_stock.unionByName(extra)))


def _post_purchases(t: Tables) -> LC.JobResult:
    heads = active(t.purchase).select("purchase_id", "employee_id", "warehouse_id", "supplier_id", "purchase_date")
    lines = active(t.purchase_detail).select("purchase_id", "product_id", "quantity", F.col("kg_price_at_purchase_time").alias("price"))
    return LC.post_purchases(t, *_reposted(heads, lines, "purchase_id", "supplier_id"))


register("w04_post_purchases_stock")(lambda t: _post_purchases(t).tables.warehouse_stock)
register("w04_post_purchases_decisions")(lambda t: _post_purchases(t).decisions)
register("w04_post_purchases_stray_lines")(lambda t: _post_purchases(t).stray_lines)
register("w04_post_purchases_headers")(lambda t: _post_purchases(t).tables.purchase)
register("w04_post_purchases_lines")(lambda t: _post_purchases(t).tables.purchase_detail.fillna(0, ["is_deleted", "is_deleted_with_purchase"]))


def _sale_batch(t: Tables) -> tuple[DataFrame, DataFrame]:
    heads = active(t.sale).select("sale_id", "customer_id", "branch_id", "employee_id", "sale_date", "payment_method")
    lines = active(t.sale_detail).select("sale_id", "product_id", "quantity", F.col("kg_price_at_sale_time").alias("price"))
    return _reposted(heads, lines, "sale_id", "branch_id")


def _post_sales(t: Tables) -> LC.JobResult:
    return LC.post_sales(t, *_sale_batch(t))


register("w06_post_sales_stock")(lambda t: _post_sales(t).tables.branch_stock)
register("w06_post_sales_decisions")(lambda t: _post_sales(t).decisions)
register("w06_post_sales_headers")(lambda t: _post_sales(t).tables.sale)
register("w06_post_sales_lines")(lambda t: _post_sales(t).tables.sale_detail.fillna(0, ["is_deleted", "is_deleted_with_sale"]))


@register("w07_post_payments")
def _w07_post(t: Tables) -> DataFrame:
    """Every payment once more; of every 50 ids, 3 names an unknown purchase, 6 has no amount."""
    return _post_payments(t).tables.payment


def _post_payments(t: Tables) -> LC.JobResult:
    amount = F.when(F.col("payment_id") % 50 != 6, F.col("amount")).alias("amount")
    rows = t.payment.select("payment_id", "purchase_id", "employee_id", "payment_date", amount, "method")
    return LC.post_payments(t, _reposted(rows, rows, "payment_id", "purchase_id")[0])


register("w07_post_payments_decisions", written=("purchase",))(lambda t: _post_payments(t).decisions)


def _retransfer(t: Tables) -> LC.JobResult:
    t = _delivered(t)
    heads = t.transfer.select("transfer_id", "warehouse_id", "branch_id", "employee_id", "transfer_date")
    lines = t.transfer_detail.select("transfer_id", "product_id", "quantity")
    return LC.post_transfers(t, *_reposted(heads, lines, "transfer_id", "branch_id"))


register("w03_transfer_admission", written=("purchase", "transfer"))(lambda t: _retransfer(t).decisions)
register("w05_post_transfers_branch_stock", written=("purchase", "transfer"))(lambda t: _retransfer(t).tables.branch_stock)
register("w08_delete_purchases", written=("purchase", "transfer"))(
    lambda t: LC.delete_purchases(_delivered(t, "purchase"), _ids_of(active(t.purchase), "purchase_id")).decisions)
register("w09_recover_purchases")(
    lambda t: LC.recover_purchases(t, _ids_of(t.purchase.where(F.col("is_deleted") == 1), "purchase_id")).decisions)
register("w09_recover_purchases_stock")(
    lambda t: LC.recover_purchases(t, _ids_of(t.purchase.where(F.col("is_deleted") == 1),
                                              "purchase_id")).tables.warehouse_stock)
register("w10_delete_sales_stock")(
    lambda t: LC.delete_sales(t, _ids_of(active(t.sale), "sale_id")).tables.branch_stock)


@register("w11_recover_sales")
def _w11(t: Tables) -> DataFrame:
    """Recover every deleted sale against the counted branch stock, which does not cover all of them."""
    t = _counted_branch_stock(t)
    return LC.recover_sales(t, _ids_of(t.sale.where(F.col("is_deleted") == 1), "sale_id")).decisions


register("w12_delete_transfers", written=("purchase", "transfer"))(lambda t: LC.delete_transfers(_delivered(t), _ids_of(t.transfer, "transfer_id")).decisions)


@register("w13_edit_sales_reprice")
def _w13(t: Tables) -> DataFrame:
    """Edit every active sale: same products and quantities at today's sale price."""
    heads = active(t.sale).select("sale_id", "customer_id", "sale_date", "payment_method")
    lines = (active(t.sale_detail).select("sale_id", "product_id", "quantity")
             .join(t.product.select("product_id", F.col("sale_price_per_kg").alias("price")), "product_id"))
    customer = F.when(F.col("sale_id") % 50 == 3, NEW_ID_OFFSET).otherwise(F.col("customer_id")).alias("customer_id")  # names no row
    heads = heads.select("sale_id", customer, "sale_date", "payment_method")
    new = LC.edit_sales(t, _twice(heads, "sale_id"), lines).tables
    return L.sales_list(new, "active").select("sale_id", "total")


@register("w14_edit_purchases", written=("purchase", "transfer"))
def _w14(t: Tables) -> DataFrame:
    """Edit every active purchase to the same lines at the product's purchase price."""
    heads = active(t.purchase).select("purchase_id", "supplier_id", "warehouse_id", "purchase_date")
    lines = (active(t.purchase_detail).select("purchase_id", "product_id", "quantity")
             .join(t.product.select("product_id", F.col("purchase_price_per_kg").alias("price")), "product_id"))
    supplier = F.when(F.col("purchase_id") % 50 == 3, NEW_ID_OFFSET).otherwise(F.col("supplier_id")).alias("supplier_id")  # names no row
    heads = heads.select("purchase_id", supplier, "warehouse_id", "purchase_date")
    return LC.edit_purchases(_delivered(t, "purchase"), _twice(heads, "purchase_id"), lines).decisions


@register("w15_edit_transfers", written=("purchase", "transfer"))
def _w15(t: Tables) -> DataFrame:
    """Edit every transfer keeping its places and lines (checks both stock kinds)."""
    heads = t.transfer.select("transfer_id", "warehouse_id", "branch_id", "transfer_date")
    product = F.when(F.col("transfer_id") % 50 == 3, F.col("product_id") + NEW_ID_OFFSET).otherwise(F.col("product_id")).alias("product_id")  # names no row
    return LC.edit_transfers(_delivered(t), _twice(heads, "transfer_id"), t.transfer_detail.select("transfer_id", product, "quantity")).decisions


@register("w16_delete_idle_suppliers")
def _w16(t: Tables) -> DataFrame:
    """Soft-delete suppliers whose purchases are all small: no live line of 45 or more."""
    large = (active(t.purchase_detail).where(F.col("quantity") >= 45).select("purchase_id").distinct()
             .join(active(t.purchase).select("purchase_id", "supplier_id"), "purchase_id"))
    busy = large.groupBy("supplier_id").agg(F.count(F.lit(1)).alias("n")).where("n >= 10").select("supplier_id")
    idle = t.supplier.join(busy, "supplier_id", "left_anti").select("supplier_id")
    return LC.set_deleted(t, "supplier", idle).tables.supplier


@register("w16_recover_products_decisions")
def _w16_decisions(t: Tables) -> DataFrame:
    """Recover deleted products, and as many ids that do not exist."""
    ids = t.product.where(F.col("is_deleted") == 1).select("product_id")
    ids = ids.unionByName(ids.select((F.col("product_id") + NEW_ID_OFFSET).alias("product_id")))
    return LC.set_deleted(t, "product", ids, deleted=False).decisions


def _supplier_batch(t: Tables) -> LC.JobResult:
    """Every supplier's name in capitals without its flag, of every 50 ids 1 twice, and a new supplier for each deleted one."""
    edits = t.supplier.select("supplier_id", F.upper("supplier_name").alias("supplier_name"), "location")
    new = t.supplier.where(F.col("is_deleted") == 1).select(
        (F.col("supplier_id") + NEW_ID_OFFSET).alias("supplier_id"), F.lit("NEW").alias("supplier_name"), "location")
    return LC.upsert_rows(t, "supplier", _twice(edits, "supplier_id").unionByName(new))


register("w17_edit_suppliers")(lambda t: _supplier_batch(t).tables.supplier)
register("w17_edit_suppliers_decisions")(lambda t: _supplier_batch(t).decisions)


@register("w17_edit_products_decisions")
def _w17_products(t: Tables) -> DataFrame:
    """Products whose category is blank in the batch are refused."""
    category = F.when(F.col("product_id") % 20 == 0, F.lit("  ")).otherwise(F.col("category")).alias("category")
    return LC.upsert_rows(t, "product", t.product.select("product_id", "product_name", category)).decisions


@register("w17_new_products_decisions")
def _w17_new(t: Tables) -> DataFrame:
    """Rows without the category column: names of known products change, new products are refused."""
    new = F.when(F.col("product_id") % 3 == 0, F.col("product_id") + NEW_ID_OFFSET).otherwise(F.col("product_id")).alias("product_id")
    return LC.upsert_rows(t, "product", t.product.select(new, F.upper("product_name").alias("product_name"))).decisions


@register("w17_employees_decisions")
def _w17_employees(t: Tables) -> DataFrame:
    """Employees moved to other places; every seventh to a branch that does not exist."""
    branch = F.when(F.col("employee_id") % 7 == 0, NEW_ID_OFFSET).otherwise(F.col("branch_id")).alias("branch_id")
    return LC.upsert_rows(t, "employee", t.employee.select("employee_id", "warehouse_id", branch)).decisions


@register("w18_delete_customers_without_email")
def _w18(t: Tables) -> DataFrame:
    gone = t.customer.where(F.col("email").isNull()).select("customer_id")
    return LC.delete_customers(t, gone).tables.sale.select("sale_id", "customer_id", "branch_id")


@register("w18_delete_customers_decisions")
def _w18_decisions(t: Tables) -> DataFrame:
    gone = t.customer.select(F.when(F.col("email").isNull(), F.col("customer_id")).otherwise(F.col("customer_id") + NEW_ID_OFFSET).alias("customer_id"))
    return LC.delete_customers(t, gone).decisions


@register("w19_delete_warehouses")
def _w19(t: Tables) -> DataFrame:
    """Every warehouse, a spare one that nothing refers to for each, and ids that do not exist."""
    spare = t.warehouse.withColumn("warehouse_id", F.col("warehouse_id") + NEW_ID_OFFSET)
    t = t.replace(warehouse=t.warehouse.unionByName(spare))
    ids = t.warehouse.select("warehouse_id").unionByName(t.warehouse.select((F.col("warehouse_id") + 5 * NEW_ID_OFFSET).alias("warehouse_id")))
    return LC.delete_warehouses(t, ids).decisions


def _flawed(t: Tables) -> Tables:
    """Tables with planted orphans, repeated keys and NULLs."""
    lost = lambda key, every: F.when(F.col(key) % every == 0, F.col(key) + NEW_ID_OFFSET).otherwise(F.col(key)).alias(key)
    purchase = t.purchase.select("purchase_id", "employee_id", "warehouse_id", lost("supplier_id", 10), "purchase_date", "is_deleted")
    sale = t.sale.select(F.when(F.col("sale_id") % 1000 != 7, F.col("sale_id")).alias("sale_id"), *t.sale.columns[1:])
    stock = t.branch_stock.withColumn("quantity", F.when(F.col("product_id") % 100 != 3, F.col("quantity")))
    return t.replace(purchase=_twice(purchase, "purchase_id"), sale=sale, branch_stock=stock)


register("s02_fk_audit", written=("purchase", "transfer", "warehouse_stock", "branch_stock"))(lambda t: Q.audit(_flawed(t)))


@register("s04_explode_sale_forms")
def _s04(t: Tables) -> DataFrame:
    """Sales turned back into forms of parallel text arrays, then exploded (S4).  Of the products, every
    17th has a blank quantity (no line) and every other 19th a quantity that is no number (rejected)."""
    qty = (F.when(F.col("product_id") % 17 == 0, F.lit(" ")).when(F.col("product_id") % 19 == 0, F.lit("many"))
           .otherwise(F.col("quantity").cast("string")))
    line = F.struct("product_id", qty.alias("quantity"), F.col("kg_price_at_sale_time").cast("string").alias("price"))
    forms = t.sale_detail.groupBy(F.col("sale_id").alias("doc_id")).agg(F.array_sort(F.collect_list(line)).alias("z"))  # one form a sale
    part = lambda c: F.transform("z", lambda x: x[c].cast("string")).alias(c)
    lines, rejects = I.explode_lines(forms.select("doc_id", part("product_id"), part("quantity"), part("price")), "sale")
    good = lines.select("doc_id", "product_id", "quantity", "price", F.lit(None).cast("string").alias("reason"))
    return good.unionByName(rejects.select("doc_id", F.lit(None).cast("long").alias("product_id"), F.lit(None).cast("decimal(10,2)").alias("quantity"),
                                           F.lit(None).cast("decimal(10,2)").alias("price"), F.col("reject_reason").alias("reason")))


@register("s05_clean_customers")
def _s05(t: Tables) -> DataFrame:
    """Customers turned back into padded form text, then cleaned."""
    raw = t.customer.select(
        "customer_id", F.concat(F.lit("  "), F.col("customer_name"), F.lit(" ")).alias("name"),
        F.concat(F.lit(" "), F.col("phone_number")).alias("phone"),
        F.coalesce(F.year("date_of_birth").cast("string"), F.lit("")).alias("dob_year"),
        F.coalesce(F.month("date_of_birth").cast("string"), F.lit("")).alias("dob_month"),
        F.coalesce(F.dayofmonth("date_of_birth").cast("string"), F.lit("")).alias("dob_day"),
        F.coalesce(F.col("email"), F.lit(" ")).alias("email"))
    return I.clean_person(raw).select("customer_id", F.col("name").alias("customer_name"),
                                      F.col("phone").alias("phone_number"), "date_of_birth", "email")


@register("s05_clean_employees")
def _s05_employees(t: Tables) -> DataFrame:
    """Employees turned back into form text and cleaned; every 25th has a salary that is no number."""
    text = lambda c: F.coalesce(F.concat(F.lit(" "), F.col(c).cast("string"), F.lit(" ")), F.lit(" ")).alias(c)
    salary = F.when(F.col("employee_id") % 25 == 0, F.lit("a lot")).otherwise(F.concat(F.lit(" "), F.col("salary").cast("string"))).alias("salary")
    raw = t.employee.select("employee_id", text("employee_name"), text("phone_number"), text("position"), salary, text("warehouse_id"), text("branch_id"))
    good, bad = I.clean_record(raw, "employee")
    cols = ("employee_id", "employee_name", "phone_number", "position", "salary", "warehouse_id", "branch_id")
    return good.select(*cols, F.lit(None).cast("string").alias("reason")).unionByName(bad.select(*cols, F.col("reject_reason").alias("reason")))


register("l16_edit_availability_last_day")(lambda t: L.edit_availability(
    t, active(t.sale).join(active(t.sale).agg(F.max("sale_date").alias("sale_date")), "sale_date").select("sale_id")))


@register("x02_stream_stock_fold", written=("purchase", "transfer"))
def _x02(t: Tables) -> DataFrame:
    """Stream every document movement (delivered twice) through the stock fold."""
    from depotline.session import FREED, new_folder, settings
    from depotline.streaming.ledger import MOVEMENT_SCHEMA, movements_by_kind, read_snapshot, run_stock_stream

    spark = t.sale.sparkSession
    base = new_folder(spark, "x02")
    with settings(spark, FREED):  # a kind after the other, so that the shuffle of one is gone before the next; sorted ids take less place
        for moves in movements_by_kind(t):
            moves.sortWithinPartitions("movement_id").write.mode("append").option("compression", "zstd").parquet(f"{base}/in/delivery=1")
    spark.read.schema(MOVEMENT_SCHEMA).parquet(f"{base}/in/delivery=1").write.option("compression", "zstd").parquet(f"{base}/in/delivery=2")  # a replay: every id again
    last = run_stock_stream(spark, f"{base}/in/*", f"{base}/out", f"{base}/checkpoint", max_files_per_trigger=8, compact_every=2, keep_bases=2)
    return read_snapshot(spark, last)


@register("s07_posted_published_read_back")
def _s07(t: Tables) -> DataFrame:
    """Post every active sale again, publish the new rows and the changed stock, read the current
    version back, and post the same batch once more: the retry is refused and changes nothing."""
    from depotline.session import new_folder
    from depotline.sources import tables as TB

    spark = t.sale.sparkSession
    base = new_folder(spark, "s07")
    start = TB.publish(spark, base, TB.write_snapshot(t, base, ("sale", "sale_detail", "branch_stock")))
    heads = active(t.sale).select("sale_id", "customer_id", "branch_id", "employee_id", "sale_date", "payment_method")
    lines = active(t.sale_detail).select("sale_id", "product_id", "quantity", F.col("kg_price_at_sale_time").alias("price"))
    batch = _reposted(heads, lines, "sale_id", "branch_id")
    version = start
    for _ in range(2):
        now = TB.load_current(spark, base).replace(branch=t.branch, customer=t.customer, employee=t.employee, product=t.product)
        res = LC.post_sales(now, *batch)
        added = {n: TB.write_rows(rows, base, n) for n, rows in res.added.items()}
        version = TB.publish(spark, base, {"branch_stock": TB.write_table(res.tables.branch_stock, base, "branch_stock")}, added, expected=version)
    return L.sales_list(TB.load_current(spark, base).replace(customer=t.customer, employee=t.employee, branch=t.branch), "active").select("sale_id", "total")


@register("s01_load_payments_with_rejects")
def _s01(t: Tables) -> DataFrame:
    """Payments as CSV text with planted flaws of amount, date and reference, loaded again; rows and rejects."""
    from depotline.session import new_folder
    from depotline.sources.tables import read_with_rejects

    of = lambda n: F.col("payment_id") % 40 == n
    flawed = {"amount": F.when(of(1), F.lit("12,5o")).otherwise(F.col("amount").cast("string")),
              "payment_date": F.when(of(2), F.lit("1997-13-40")).otherwise(F.col("payment_date").cast("string")),
              "purchase_id": F.when(of(3), F.lit("P-7")).otherwise(F.col("purchase_id").cast("string"))}
    path = new_folder(t.payment.sparkSession, "s01")
    t.payment.select(*(flawed[c].alias(c) if c in flawed else c for c in t.payment.columns)).write.option("header", "true").csv(path)
    good, bad = read_with_rejects(t.payment.sparkSession, path, "payment")
    rows = good.select(F.col("payment_id").cast("string").alias("payment_id"), F.col("amount").cast("double").alias("amount"), F.lit(None).cast("string").alias("reason"))
    return rows.unionByName(bad.select(F.get_json_object("record", "$.payment_id").alias("payment_id"), F.lit(None).cast("double").alias("amount"), "reason"))


@register("s07_touched_parts_read_back", written=("purchase", "transfer"))
def _s07_touched(t: Tables) -> DataFrame:
    """All tables as stored parts; delete every 40th active sale by rewriting the parts that hold one, post the
    same sales again as new parts beside the others, and read the current version's sales list back."""
    from depotline.session import new_folder
    from depotline.sources import versions as V
    from depotline.sources.layout import plain_columns

    spark = t.sale.sparkSession
    base = new_folder(spark, "s07-parts")
    V.create(spark, t, base, 2)
    start, now = V.open_version(spark, base)
    ids = active(t.sale).where("sale_id % 40 = 7").select("sale_id")
    places = V.touched(now, start, "sale", ids)
    res = LC.delete_sales(V.only(now, "sale", places), ids).tables
    written = V.rewrite(res, base, start, "sale", places) | V.write_parts(res, base, start.buckets, ("branch_stock",))
    V.publish(spark, base, start, written)
    second, now = V.open_version(spark, base)
    gone = now.sale.join(ids, "sale_id", "left_semi")
    heads = gone.select((F.col("sale_id") + NEW_ID_OFFSET).alias("sale_id"), "customer_id", "branch_id", "employee_id", "sale_date", "payment_method")
    lines = now.sale_detail.where("is_deleted IS NULL AND is_deleted_with_sale = 1").join(ids, "sale_id", "left_semi").select(
        (F.col("sale_id") + NEW_ID_OFFSET).alias("sale_id"), "product_id", "quantity", F.col("kg_price_at_sale_time").alias("price"))
    res = LC.post_sales(plain_columns(now), heads, lines)
    new = res.tables.replace(**res.added)
    V.publish(spark, base, second, V.write_parts(new, base, second.buckets, ("branch_stock",)),
              appended=V.write_parts(new, base, second.buckets, ("sale", "sale_detail")))
    return L.sales_list(V.open_version(spark, base)[1], "active").select("sale_id", "total")


@register("s07_post_through_key_index", written=("purchase", "transfer"))
def _s07_posted(t: Tables) -> DataFrame:
    """All tables as stored parts; every active sale is posted once more, with planted flaws, by a job that
    reads only the parts that can hold an id of the batch.  Its decisions."""
    from depotline.session import new_folder
    from depotline.sources import key_index as K
    from depotline.sources import versions as V

    spark, base = t.sale.sparkSession, new_folder(t.sale.sparkSession, "s07-keys")
    version = V.create(spark, t, base, 2)
    heads, lines = _sale_batch(t)
    return LC.post_sales(K.for_posting(spark, base, version, t, "sale", heads.select("sale_id")), heads, lines).decisions


@register("s02_audit_with_line_keys", written=("purchase", "transfer", "warehouse_stock", "branch_stock"))
def _s02_keyed(t: Tables) -> DataFrame:
    """The audit of numbered lines, of which some lost their key and some stand twice."""
    from depotline.operators.lines import number_lines
    from depotline.schemas import LINE_KEYS

    t = number_lines(t)

    def flawed(lines: DataFrame, key: str) -> DataFrame:
        lost = lines.withColumn(key, F.when(F.col(key) % 1000 != 5, F.col(key)))
        return lost.unionByName(lines.where(F.col(key) % 1000 == 6))

    return Q.audit(t.replace(**{n: flawed(getattr(t, n), key) for n, key in LINE_KEYS.items()}))


@register("s02_line_keys", written=("purchase", "transfer"))
def _s02_line_keys(t: Tables) -> DataFrame:
    """Numbered lines after purchases were posted once more: keys without gaps, those of old lines unchanged."""
    from depotline.operators.lines import number_lines
    from depotline.schemas import LINE_KEYS
    from depotline.session import stage

    old = number_lines(t)
    new = number_lines(_post_purchases(old).tables)
    parts = []
    for n, key in LINE_KEYS.items():
        before, after = getattr(old, n), getattr(new, n)
        line = F.struct(*getattr(t, n).columns)
        both = after.join(before.select(key, line.alias("_old")), key, "left")
        counts = both.agg(F.count(F.lit(1)).alias("n_lines"), F.countDistinct(key).alias("n_keys"), F.min(key).alias("first_key"),
                          F.max(key).alias("last_key"), F.count_if(F.col("_old").eqNullSafe(line)).alias("old_lines_kept"))
        parts.append(stage(counts.select(F.lit(n).alias("table_name"), "*"), "line-keys"))  # the shuffle of one table is gone before the next
    return reduce(DataFrame.unionByName, parts)


@register("s02_audit_of_versions", written=("purchase", "transfer"))
def _s02_versions(t: Tables) -> DataFrame:
    """The audit of a third version, carried from that of the first: tables with planted flaws are stored and
    audited; then half of the unknown suppliers come and payments are repeated, in parts beside the others;
    then customers leave and half of the stock rows without a quantity get one."""
    from depotline.operators import versioned as W
    from depotline.session import new_folder
    from depotline.sources import versions as V

    spark, base = t.sale.sparkSession, new_folder(t.sale.sparkSession, "s02-parts")
    t, whole_stock = _flawed(t), t.branch_stock
    first = V.create(spark, t, base, 2)
    W.audit_version(spark, base)
    came = t.supplier.where("supplier_id % 20 = 0").withColumn("supplier_id", F.col("supplier_id") + NEW_ID_OFFSET)
    more = t.replace(supplier=came, payment=t.payment.where("payment_id % 30 = 4"))
    second = V.publish(spark, base, first, {}, appended=V.write_parts(more, base, 2, ("supplier", "payment")))
    stock = whole_stock.withColumn("quantity", F.when(F.col("product_id") % 200 != 3, F.col("quantity")))
    after = t.replace(customer=t.customer.where("customer_id % 70 <> 9"), branch_stock=stock)
    V.publish(spark, base, second, V.write_parts(after, base, 2, ("customer", "branch_stock")))
    return W.audit_version(spark, base)


@register("x01_reconcile_of_versions", written=("purchase", "transfer"))
def _x01_versions(t: Tables) -> DataFrame:
    """Stock against documents of which some were deleted and some posted since the balances were made, by
    jobs that left the stock as it was: every 40th active sale in rewritten parts, every 40th purchase once
    more in parts beside the others."""
    from depotline.operators import versioned as W
    from depotline.session import new_folder
    from depotline.sources import versions as V

    spark, base = t.sale.sparkSession, new_folder(t.sale.sparkSession, "x01-parts")
    V.create(spark, t, base, 2)
    W.balances_of_version(spark, base)
    start, now = V.open_version(spark, base)
    ids = active(t.sale).where("sale_id % 40 = 7").select("sale_id")
    places = V.touched(now, start, "sale", ids)
    start = V.publish(spark, base, start, V.rewrite(LC.delete_sales(V.only(now, "sale", places), ids).tables, base, start, "sale", places))
    again = lambda df: df.where("purchase_id % 40 = 9").withColumn("purchase_id", F.col("purchase_id") + NEW_ID_OFFSET)
    more = t.replace(purchase=again(t.purchase), purchase_detail=again(t.purchase_detail))
    V.publish(spark, base, start, {}, appended=V.write_parts(more, base, 2, ("purchase", "purchase_detail")))
    return W.reconcile_version(spark, base)


register("r21_chart_series_income")(lambda t: R.chart_series("1", R.r01_income_per_branch(t, _S, _E)))


@register("w07_delete_payments_of_deleted_purchases")
def _w07(t: Tables) -> DataFrame:
    """Soft-delete every payment whose purchase was deleted with it."""
    ids = t.payment.where(F.col("is_deleted_with_purchase") == 1).select("payment_id")
    return LC.delete_payments(t, ids).tables.payment.select("payment_id", "purchase_id", "is_deleted")


@register("w17_upsert_cleaned_customers")
def _w17(t: Tables) -> DataFrame:
    """Load the customer master again from cleaned form records (insert or overwrite)."""
    return LC.upsert_rows(t, "customer", _s05(t)).tables.customer
