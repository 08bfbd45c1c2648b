"""Command line: run a report, a list, the audit or the stock reconciliation.

    spark-submit -m depotline.cli report 1 --tables s3://.../retail --start 2024-01-01 --out s3://.../r1
    python -m depotline.cli list unpaid_purchases --tables /data/retail --show 20
    python -m depotline.cli audit --tables /data/retail --out /data/audit
    python -m depotline.cli report 4 --tables /data/retail-parts --layout parts --version 12 --branch-id 3

``--layout`` says how the tables are kept: plain folders, published snapshots (``sources.tables``), stored parts
(``sources.versions``, of any kept version) or buckets (``sources.layout``).  The audit and the reconciliation
of stored parts are carried from the last version that was audited or reconciled.

``--out`` writes the whole result as Parquet (or CSV with ``--csv``); without it the
first ``--show`` rows are printed, with a note where there are more.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession

from depotline.operators import listings, quality, reports, stock, versioned
from depotline.session import configure
from depotline.sources import versions
from depotline.sources.layout import register_bucketed
from depotline.sources.tables import Tables, load_current, load_tables

LISTS = {
    "sales": lambda t, a: listings.sales_list(t, a.which, a.employee_id),
    "sale_lines": lambda t, a: listings.sale_lines_list(t),
    "purchases": lambda t, a: listings.purchases_list(t, a.which, a.warehouse_id),
    "purchase_lines": lambda t, a: listings.purchase_lines_list(t),
    "transfers": lambda t, a: listings.transfers_list(t, a.warehouse_id),
    "transfer_lines": lambda t, a: listings.transfer_lines_list(t),
    "unpaid_purchases": lambda t, a: listings.unpaid_purchases(t),
    "completed_purchases": lambda t, a: listings.completed_purchases(t),
    "payment_statement": lambda t, a: listings.payment_statement(t),
    "payments": lambda t, a: listings.payments_list(t, a.which),
    "warehouse_stock": lambda t, a: listings.warehouse_stock_view(t, a.warehouse_id),
    "branch_stock": lambda t, a: listings.branch_stock_view(t, a.branch_id),
    "sellable_products": lambda t, a: listings.sellable_products(t, a.branch_id),
    "transferable_products": lambda t, a: listings.transferable_products(t, a.warehouse_id),
    "products": lambda t, a: listings.products_list(t, a.which),
    "employees": lambda t, a: listings.employees_list(t, a.which),
    "suppliers": lambda t, a: listings.suppliers_list(t, a.which),
    "branches": lambda t, a: listings.branches_list(t, a.which),
    "warehouses": lambda t, a: listings.warehouses_list(t),
    "customers": lambda t, a: listings.customers_list(t),
}


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="depotline")
    p.add_argument("command", choices=["report", "list", "audit", "reconcile"])
    p.add_argument("name", nargs="?", help="report id (1-20) or list name")
    p.add_argument("--tables", required=True, help="folder with one sub-folder per table")
    p.add_argument("--layout", choices=["folders", "published", "parts", "buckets"], default="folders")
    p.add_argument("--version", type=int, default=None, help="number of a version of stored parts; the current one if not given")
    p.add_argument("--database", default="depotline", help="catalog database in which buckets are declared")
    p.add_argument("--line-keys", dest="line_keys", action="store_true", help="read the keys of lines too (folders and published)")
    p.add_argument("--format", default="parquet")
    p.add_argument("--start", default=None)
    p.add_argument("--end", default=None)
    p.add_argument("--branch-id", dest="branch_id", default=None)
    p.add_argument("--warehouse-id", dest="warehouse_id", type=int, default=None)
    p.add_argument("--employee-id", dest="employee_id", type=int, default=None)
    p.add_argument("--which", choices=["active", "deleted"], default="active")
    p.add_argument("--chart", action="store_true", help="label/value series of a chart report")
    p.add_argument("--out", default=None)
    p.add_argument("--csv", action="store_true")
    p.add_argument("--show", type=int, default=20)
    return p


def open_tables(spark: SparkSession, args: argparse.Namespace) -> Tables:
    if args.version is not None and args.layout != "parts":
        raise SystemExit("--version needs --layout parts")
    if args.layout == "parts":
        return versions.open_version(spark, args.tables, args.version)[1]
    if args.layout == "published":
        return load_current(spark, args.tables, args.line_keys)
    if args.layout == "buckets":
        return register_bucketed(spark, args.database, args.tables)
    return load_tables(spark, args.tables, args.format, line_keys=args.line_keys)


def build(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    if args.layout == "parts" and args.command in ("audit", "reconcile"):
        carried = versioned.audit_version if args.command == "audit" else versioned.reconcile_version
        return carried(spark, args.tables, args.version)
    t = open_tables(spark, args)
    if args.command == "report":
        df = reports.run_report(t, args.name, args.start, args.end, args.branch_id)
        if args.chart:
            series = reports.chart_series(args.name, df)
            df = series if series is not None else df
        return df
    if args.command == "list":
        return LISTS[args.name](t, args)
    if args.command == "audit":
        return quality.audit(t)
    return stock.reconcile(t)


def main(argv: list[str] | None = None) -> None:
    args = _parser().parse_args(argv)
    spark = configure(SparkSession.builder.appName(f"depotline-{args.command}").getOrCreate())
    df = build(spark, args)
    if args.out:
        (df.write.mode("errorifexists").option("header", "true").csv(args.out) if args.csv
         else df.write.mode("errorifexists").parquet(args.out))
    else:
        df.show(args.show, truncate=False)
        if len(df.take(args.show + 1)) > args.show:
            print(f"Only the first {args.show} rows are shown; use --out for all of them, or a larger --show.")


if __name__ == "__main__":
    main()
