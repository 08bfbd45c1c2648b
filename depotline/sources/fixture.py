"""Derive the fifteen tables from the driver's TPC-H-like tables (FIXTURES.md §2).

Every table is a lazy DataFrame over ``sf_dir/<name>.parquet``; nothing is
materialised here, so a query only pays for the views it touches.  A query that reads
a derived table several times names it in ``written``: the table is then derived once
and written (``session.stage``).  The rules are
the fixed mapping written down in FIXTURES.md (ids shifted by one, flags chosen
by residues of the source keys).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from depotline.schemas import MONEY, STOCK_QTY
from depotline.session import stage
from depotline.sources.tables import Tables, conform


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _flag(cond: Column) -> Column:
    return F.when(cond, F.lit(1))


def _month_start(ts: Column) -> Column:
    return F.trunc(F.to_date(ts), "month")


def _month_index(ts: Column) -> Column:
    return (F.year(ts) - 1995) * 12 + F.month(ts)


def fixture_tables(spark: SparkSession, sf_dir: str, written: tuple[str, ...] = ()) -> Tables:
    """The fifteen tables; those named in ``written`` (of purchase, transfer, warehouse_stock and
    branch_stock; ``transfer`` with its lines) are derived once and written."""
    once = lambda df, name, of=None: stage(df, f"fixture-{name}") if (of or name) in written else df
    region = _read(spark, sf_dir, "region")
    nation = _read(spark, sf_dir, "nation")
    customer = _read(spark, sf_dir, "customer")
    supplier = _read(spark, sf_dir, "supplier")
    part = _read(spark, sf_dir, "part")
    orders = _read(spark, sf_dir, "orders")
    lineitem = _read(spark, sf_dir, "lineitem")

    warehouse = region.select(
        (F.col("r_regionkey") + 1).alias("warehouse_id"),
        F.col("r_name").alias("warehouse_name"),
        F.concat(F.lit("Loc"), F.col("r_regionkey").cast("string")).alias("location"),
        F.when(F.col("r_regionkey") < 4, F.lit("0100")).alias("phone_number"),
    )

    branch = nation.select(
        (F.col("n_nationkey") + 1).alias("branch_id"),
        F.when(F.col("n_nationkey") == 24, F.lit("NATION_0")).otherwise(F.col("n_name")).alias("branch_name"),
        F.concat(F.lit("Loc"), F.col("n_regionkey").cast("string")).alias("location"),
        (F.col("n_nationkey") + 5000).cast("string").alias("phone_number"),
        _flag(F.col("n_nationkey") % 12 == 5).alias("is_deleted"),
    )

    # Five employees per nation, one per region key: a fixed five-way expansion
    # of each nation row by the region keys (region is five rows in every scale).
    n, r = F.col("n_nationkey"), F.col("r_regionkey")
    emp_id = n * 5 + r + 1
    employee = (
        nation.select("n_nationkey")
        .withColumn("r_regionkey", F.explode(F.sequence(F.lit(0), F.lit(4))))
        .join(region.select("r_regionkey"), "r_regionkey")
        .select(
            emp_id.alias("employee_id"),
            F.concat(F.lit("Employee#"), (emp_id % 120).cast("string")).alias("employee_name"),
            (n * 5 + r + 7000).cast("string").alias("phone_number"),
            F.when((n + r) % 4 != 0, F.make_date(n + 1960, r + 1, n + 1)).alias("date_of_birth"),
            F.when(r == 0, F.lit("Keeper")).when(r == 1, F.lit(None)).otherwise(F.lit("Seller")).alias("position"),
            (n * 10 + r + 1000).cast(MONEY).alias("salary"),
            F.when(r == 0, n % 5 + 1).alias("warehouse_id"),
            F.when(r > 0, n + 1).alias("branch_id"),
            _flag(emp_id % 17 == 0).alias("is_deleted"),
            F.when((n == 0) & (r == 0), F.lit("admin")).otherwise(F.lit("normal")).alias("access_level"),
        )
    )

    c = F.col("c_custkey")
    customer_t = customer.select(
        (c + 1).alias("customer_id"),
        F.col("c_name").alias("customer_name"),
        (c + 9000).cast("string").alias("phone_number"),
        F.when(c % 3 != 0, F.make_date((c % 50 + 1950).cast("int"), (c % 12 + 1).cast("int"),
                                       (c % 28 + 1).cast("int"))).alias("date_of_birth"),
        F.when(c % 5 != 0, F.concat(F.col("c_name"), F.lit("@example.com"))).alias("email"),
    )

    s = F.col("s_suppkey")
    supplier_t = supplier.select(
        (s + 1).alias("supplier_id"),
        F.col("s_name").alias("supplier_name"),
        F.concat(F.lit("Loc"), F.col("s_nationkey").cast("string")).alias("location"),
        (s + 3000).cast("string").alias("phone_number"),
        F.when(s % 4 != 0, F.concat(F.col("s_name"), F.lit("@example.com"))).alias("email"),
        _flag(s % 9 == 4).alias("is_deleted"),
    )

    p = F.col("p_partkey")
    product = part.select(
        (p + 1).alias("product_id"),
        F.col("p_name").alias("product_name"),
        F.col("p_type").alias("category"),
        _flag(p % 29 == 0).alias("is_deleted"),
        (F.col("p_retailprice").cast(MONEY) - 100).cast(MONEY).alias("purchase_price_per_kg"),
        F.col("p_retailprice").cast(MONEY).alias("sale_price_per_kg"),
    )

    o = F.col("o_orderkey")
    sale = orders.select(
        (o + 1).alias("sale_id"),
        F.when(o % 10 == 0, F.lit(None)).otherwise(F.col("o_custkey") + 1).alias("customer_id"),
        (F.col("o_custkey") % 25 + 1).alias("branch_id"),
        ((F.col("o_custkey") % 25) * 5 + 2 + o % 4).alias("employee_id"),
        F.to_date(F.col("o_orderdate")).alias("sale_date"),
        F.when(o % 3 == 0, F.lit("Card")).otherwise(F.lit("Cash")).alias("payment_method"),
        _flag(o % 13 == 0).alias("is_deleted"),
    )

    ln = F.col("l_linenumber")
    quarter = (F.col("l_quantity") / 4).cast(MONEY)
    sale_detail = lineitem.select(
        (F.col("l_orderkey") + 1).alias("sale_id"),
        (F.col("l_partkey") + 1).alias("product_id"),
        F.when(ln > 4, quarter).otherwise(F.col("l_quantity").cast(MONEY)).alias("quantity"),
        F.col("l_extendedprice").cast(MONEY).alias("kg_price_at_sale_time"),
        _flag(ln == 4).alias("is_deleted"),
        _flag((ln != 4) & (F.col("l_orderkey") % 13 == 0)).alias("is_deleted_with_sale"),
    )

    sk = F.col("l_suppkey")
    pline = lineitem.select(
        (sk * 1000 + _month_index(F.col("l_shipdate"))).alias("purchase_id"),
        sk.alias("l_suppkey"),
        _month_start(F.col("l_shipdate")).alias("purchase_date"),
        (F.col("l_partkey") + 1).alias("product_id"),
        F.col("l_quantity").cast(MONEY).alias("quantity"),
        F.col("l_extendedprice").cast(MONEY).alias("kg_price_at_purchase_time"),
        _flag(ln == 7).alias("is_deleted"),
    )
    pid = F.col("purchase_id")
    purchase = pline.select(
        pid,
        ((sk % 25) * 5 + 1).alias("employee_id"),
        (sk % 5 + 1).alias("warehouse_id"),
        (sk + 1).alias("supplier_id"),
        "purchase_date",
        _flag(pid % 19 == 0).alias("is_deleted"),
    ).distinct()
    purchase = once(purchase, "purchase")
    purchase_detail = pline.select(
        pid, "product_id", "quantity", "kg_price_at_purchase_time", "is_deleted",
        _flag(pid % 19 == 0).alias("is_deleted_with_purchase"),
    )

    live_total = (
        purchase_detail.where(F.col("is_deleted").isNull())
        .groupBy("purchase_id")
        .agg(F.sum(F.col("quantity") * F.col("kg_price_at_purchase_time")).alias("total"))
    )
    # One payment per purchase, a second one for purchase ids = 2 (mod 3): a fixed
    # two-way expansion of each purchase row.
    k = F.col("k")
    payment = (
        purchase.join(live_total, "purchase_id")
        .withColumn("k", F.explode(F.array(F.lit(0), F.lit(1))))
        .where((pid % 7 != 0) & ((k == 0) | (pid % 3 == 2)))
        .select(
            (pid * 2 + k).alias("payment_id"),
            pid,
            "employee_id",
            F.date_add(F.col("purchase_date"), 15).alias("payment_date"),
            F.when(pid % 3 == 0, F.col("total").cast(MONEY))
            .when(k == 0, F.lit(1000.25).cast(MONEY))
            .otherwise(F.lit(500.50).cast(MONEY)).alias("amount"),
            F.when(pid % 4 == 0, F.lit("Cash")).when(pid % 4 == 1, F.lit("Bank"))
            .when(pid % 4 == 2, F.lit("Check")).otherwise(F.lit("Other")).alias("method"),
            _flag((k == 1) & (pid % 5 == 0)).alias("is_deleted"),
            _flag(F.col("is_deleted") == 1).alias("is_deleted_with_purchase"),
        )
    )

    tline = (
        lineitem.select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_quantity", "l_shipdate")
        .join(orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
        .select(
            (((sk % 5) * 25 + F.col("o_custkey") % 25) * 1000 + _month_index(F.col("l_shipdate")))
            .alias("transfer_id"),
            (sk % 5 + 1).alias("warehouse_id"),
            (F.col("o_custkey") % 25 + 1).alias("branch_id"),
            _month_start(F.col("l_shipdate")).alias("transfer_date"),
            (F.col("l_partkey") + 1).alias("product_id"),
            F.when(ln > 5, quarter).otherwise(F.col("l_quantity").cast(MONEY)).alias("quantity"),
        )
    )
    tline = once(tline, "transfer_lines", "transfer")
    transfer = tline.select(
        "transfer_id", "warehouse_id", "branch_id",
        ((F.col("warehouse_id") - 1) * 5 + 1).alias("employee_id"),
        "transfer_date",
    ).distinct()
    transfer = once(transfer, "transfer")
    transfer_detail = tline.select("transfer_id", "product_id", "quantity")

    # Opening stock = the fold of all document movements (see operators.stock).
    wh_moves = (
        purchase.where(F.col("is_deleted").isNull()).select("purchase_id", "warehouse_id")
        .join(purchase_detail.where(F.col("is_deleted").isNull()).select("purchase_id", "product_id", "quantity"),
              "purchase_id")
        .select("warehouse_id", "product_id", F.col("quantity").alias("q"))
        .unionByName(tline.select("warehouse_id", "product_id", (-F.col("quantity")).alias("q")))
    )
    warehouse_stock = once(wh_moves.groupBy("warehouse_id", "product_id").agg(
        F.sum("q").cast(STOCK_QTY).alias("quantity")), "warehouse_stock")

    # A line brings what its transfer moves to the branch and takes what its sale sells there, if both are live.
    live = F.coalesce(ln != 4, F.lit(True)) & (F.col("l_orderkey") % 13 != 0)
    whole = F.col("l_quantity").cast(MONEY)
    sold = F.when(live, F.when(ln > 4, quarter).otherwise(whole)).otherwise(F.lit(0).cast(MONEY))
    br_moves = (
        lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
        .join(orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
        .select(
            (F.col("o_custkey") % 25 + 1).alias("branch_id"), (F.col("l_partkey") + 1).alias("product_id"),
            (F.when(ln > 5, quarter).otherwise(whole) - sold).alias("q"),
        )
    )
    branch_stock = once(br_moves.groupBy("branch_id", "product_id").agg(
        F.sum("q").cast(STOCK_QTY).alias("quantity")), "branch_stock")

    frames = dict(
        warehouse=warehouse, branch=branch, employee=employee, customer=customer_t,
        supplier=supplier_t, product=product, purchase=purchase, purchase_detail=purchase_detail,
        payment=payment, sale=sale, sale_detail=sale_detail, transfer=transfer,
        transfer_detail=transfer_detail, warehouse_stock=warehouse_stock, branch_stock=branch_stock,
    )
    return Tables(**{name: conform(df, name) for name, df in frames.items()})
