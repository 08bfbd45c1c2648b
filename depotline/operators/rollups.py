"""Shared per-document rollups.

Lines are always aggregated to their document key *before* they meet the header
table.  The aggregate runs as partial (map-side) + final hash aggregation, so a
document with a huge number of lines collapses to one row per map task before
the shuffle; the header join that follows reuses the same hash partitioning on
the document key, so it adds no second exchange for the line side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depotline.functions.dates import DateLike, in_document_months
from depotline.functions.flags import active, line_value
from depotline.sources.tables import Tables


def _of(lines: DataFrame, documents: DataFrame | None, key: str) -> DataFrame:
    """Only the lines of ``documents`` (filtered headers), where they are given: the
    lines of other documents drop out before anything is summed."""
    return lines if documents is None else lines.join(documents.select(key), key, "left_semi")


def sale_lines(t: Tables, documents: DataFrame | None = None, start: DateLike = None, end: DateLike = None) -> DataFrame:
    """Live sale lines with their value (rule K2: a deleted line never counts).  A date
    range only prunes month partitions; it does not filter by itself."""
    return _of(in_document_months(active(t.sale_detail), start, end), documents, "sale_id").select(
        "sale_id", "product_id", "quantity",
        line_value("quantity", "kg_price_at_sale_time").alias("line_value"))


def sale_amount(t: Tables, documents: DataFrame | None = None, start: DateLike = None, end: DateLike = None) -> DataFrame:
    """sale_id -> amount (sum of live line values), number of live lines."""
    return sale_lines(t, documents, start, end).groupBy("sale_id").agg(
        F.sum("line_value").alias("amount"), F.count(F.lit(1)).alias("n_lines"))


def purchase_lines(t: Tables, include_deleted_lines: bool = False, documents: DataFrame | None = None,
                   start: DateLike = None, end: DateLike = None) -> DataFrame:
    lines = t.purchase_detail if include_deleted_lines else active(t.purchase_detail)
    return _of(in_document_months(lines, start, end), documents, "purchase_id").select(
        "purchase_id", "product_id", "quantity",
        line_value("quantity", "kg_price_at_purchase_time").alias("line_value"))


def purchase_amount(t: Tables, include_deleted_lines: bool = False, documents: DataFrame | None = None,
                    start: DateLike = None, end: DateLike = None) -> DataFrame:
    """purchase_id -> total of its (live) lines."""
    return purchase_lines(t, include_deleted_lines, documents, start, end).groupBy("purchase_id").agg(
        F.sum("line_value").alias("total"), F.count(F.lit(1)).alias("n_lines"))


def purchase_paid(t: Tables, documents: DataFrame | None = None) -> DataFrame:
    """purchase_id -> sum of live payments."""
    return _of(active(t.payment), documents, "purchase_id").groupBy("purchase_id").agg(F.sum("amount").alias("paid"))


def transfer_qty(t: Tables, documents: DataFrame | None = None) -> DataFrame:
    """transfer_id -> total transferred quantity (transfer lines have no flag)."""
    return _of(t.transfer_detail, documents, "transfer_id").groupBy("transfer_id").agg(
        F.sum("quantity").alias("total_qty"), F.count(F.lit(1)).alias("n_lines"))


def purchase_balance(t: Tables, include_deleted_lines: bool = False, documents: DataFrame | None = None) -> DataFrame:
    """Every purchase header (or each of ``documents``) with total, paid and remaining (rule K7: no lines -> 0).

    Lines and payments are aggregated separately and then joined, never joined
    with each other (that would multiply rows).
    """
    totals = purchase_amount(t, include_deleted_lines, documents).select("purchase_id", "total")
    paid = purchase_paid(t, documents)
    return (
        (t.purchase if documents is None else documents).join(totals, "purchase_id", "left").join(paid, "purchase_id", "left")
        .withColumn("total", F.coalesce(F.col("total"), F.lit(0).cast("decimal(31,4)")))
        .withColumn("paid", F.coalesce(F.col("paid"), F.lit(0).cast("decimal(20,2)")))
        .withColumn("remaining", F.col("total") - F.col("paid"))
    )
