"""Stock as a fold of signed movements (W1, W2) and its reconciliation.

A movement is ``(location_id, product_id, delta)``.  Deltas are summed per key
before they touch the stock table (partial + final aggregation), so a batch with
millions of movements on one product is one row per map task before the shuffle.
Applying a batch rewrites the stock snapshot with one shuffle on
(location, product).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depotline.functions.flags import active
from depotline.schemas import STOCK_QTY
from depotline.sources.tables import Tables

WAREHOUSE, BRANCH = "warehouse", "branch"


def _net(deltas: DataFrame, loc: str) -> DataFrame:
    return deltas.groupBy(loc, "product_id").agg(F.sum("delta").alias("delta"))


def apply_upsert(stock: DataFrame, deltas: DataFrame, loc: str) -> DataFrame:
    """W1 insert-or-add: every (location, product) of the batch ends with a row;
    rows that reach 0 are kept, untouched rows pass through."""
    moved = _net(deltas, loc).select(loc, "product_id", F.col("delta").alias("q"))
    return (stock.select(loc, "product_id", F.col("quantity").alias("q")).unionByName(moved)
            .groupBy(loc, "product_id").agg(F.sum("q").cast(STOCK_QTY).alias("quantity")))


def apply_update_only(stock: DataFrame, deltas: DataFrame, loc: str) -> tuple[DataFrame, DataFrame]:
    """W2 update-only (sales): pairs without a stock row are not inserted.

    Returns ``(new_stock, ignored)`` where ``ignored`` lists the net deltas that had
    no stock row (X1 reports them as differences later).
    """
    net = _net(deltas, loc)
    new_stock = (stock.join(net, [loc, "product_id"], "left")
                 .select(loc, "product_id",
                         (F.col("quantity") + F.coalesce(F.col("delta"), F.lit(0))).cast(STOCK_QTY)
                         .alias("quantity")))
    ignored = net.join(stock.select(loc, "product_id"), [loc, "product_id"], "left_anti")
    return new_stock, ignored


def movements(t: Tables) -> DataFrame:
    """Signed movements implied by the documents: location_type, location_id, product_id, delta.

    Warehouse: + live lines of live purchases, - transfer lines.
    Branch: + transfer lines, - live lines of live sales.  A transfer line is read
    once and exploded into its two movements.
    """
    def move(kind: str, loc: str, sign: int):
        return F.struct(F.lit(kind).alias("location_type"), F.col(loc).alias("location_id"), (F.col("quantity") * sign).alias("delta"))

    cols = ("move.location_type", "move.location_id", "product_id", "move.delta")
    bought = (active(t.purchase).select("purchase_id", "warehouse_id")
              .join(active(t.purchase_detail).select("purchase_id", "product_id", "quantity"), "purchase_id")
              .withColumn("move", move(WAREHOUSE, "warehouse_id", 1)).select(*cols))
    moved = (t.transfer.select("transfer_id", "warehouse_id", "branch_id")
             .join(t.transfer_detail.select("transfer_id", "product_id", "quantity"), "transfer_id")
             .withColumn("move", F.explode(F.array(move(WAREHOUSE, "warehouse_id", -1), move(BRANCH, "branch_id", 1)))).select(*cols))
    sold = (active(t.sale).select("sale_id", "branch_id")
            .join(active(t.sale_detail).select("sale_id", "product_id", "quantity"), "sale_id")
            .withColumn("move", move(BRANCH, "branch_id", -1)).select(*cols))
    return bought.unionByName(moved).unionByName(sold)


def _rebuilt(t: Tables) -> DataFrame:
    return (movements(t).groupBy("location_type", "location_id", "product_id")
            .agg(F.sum("delta").cast(STOCK_QTY).alias("quantity")))


def rebuild_stock(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Stock rebuilt from the documents alone: (warehouse_stock, branch_stock)."""
    both = _rebuilt(t)
    of = lambda kind, loc: both.where(F.col("location_type") == kind).select(
        F.col("location_id").alias(loc), "product_id", "quantity")
    return of(WAREHOUSE, "warehouse_id"), of(BRANCH, "branch_id")


KEY = ["location_type", "location_id", "product_id"]


def reconcile(t: Tables) -> DataFrame:
    """Snapshot vs rebuild for both location kinds, every key of either side."""
    return against(t, _rebuilt(t))


def against(t: Tables, rebuilt: DataFrame) -> DataFrame:
    """The snapshot of ``t`` beside rebuilt stock: location_type, location_id, product_id, quantity."""
    key = KEY
    of = lambda df, kind, loc: df.select(F.lit(kind).alias("location_type"), F.col(loc).alias("location_id"), "product_id",
                                         F.col("quantity").alias("snapshot_qty"))
    snapshot = of(t.warehouse_stock, WAREHOUSE, "warehouse_id").unionByName(of(t.branch_stock, BRANCH, "branch_id"))
    zero = F.lit(0).cast(STOCK_QTY)
    return (snapshot.join(rebuilt.withColumnRenamed("quantity", "rebuilt_qty"), key, "full_outer")
            .select(*key, "snapshot_qty", "rebuilt_qty",
                    (F.coalesce(F.col("snapshot_qty"), zero) - F.coalesce(F.col("rebuilt_qty"), zero)).alias("difference"),
                    F.when(F.col("snapshot_qty").isNull(), F.lit("missing_in_snapshot"))
                    .when(F.col("rebuilt_qty").isNull(), F.lit("missing_in_rebuild"))
                    .when(F.col("snapshot_qty") == F.col("rebuilt_qty"), F.lit("match"))
                    .otherwise(F.lit("differs")).alias("status")))


# ------------------------------------------------------------------ balances carried between versions
BALANCE = "location_type string, location_id long, product_id long, quantity decimal(20,2), movements long, valued long"


def balances(t: Tables) -> DataFrame:
    """Rebuilt stock that changes can be folded into: quantity (0 where no movement has one), number of
    movements, and of those with a quantity."""
    return _summed(_signed(t, 1))


def fold(kept: DataFrame, before: Tables, after: Tables) -> DataFrame:
    """``kept`` balances without the documents of ``before`` and with those of ``after``.  A key whose last
    movement left is gone, as in a rebuild."""
    change = _summed(_signed(before, -1).unionByName(_signed(after, 1)))
    return _summed(kept.unionByName(change)).where("movements <> 0")


def rebuilt_of(kept: DataFrame) -> DataFrame:
    """Balances as ``rebuild_stock`` gives them: NULL where no movement has a quantity."""
    return kept.select(*KEY, F.when(F.col("valued") != 0, F.col("quantity")).alias("quantity"))


def _signed(t: Tables, sign: int) -> DataFrame:
    has = F.col("delta").isNotNull()
    return movements(t).select(*KEY, F.when(has, F.col("delta") * sign).otherwise(0).cast(STOCK_QTY).alias("quantity"),
                               F.lit(sign).cast("long").alias("movements"), F.when(has, sign).otherwise(0).cast("long").alias("valued"))


def _summed(signed: DataFrame) -> DataFrame:
    sums = [F.sum("quantity").cast(STOCK_QTY).alias("quantity"), F.sum("movements").alias("movements"), F.sum("valued").alias("valued")]
    return signed.groupBy(*KEY).agg(*sums)
