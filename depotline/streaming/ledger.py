"""Keep stock current from a stream of movements (Structured Streaming).

A movement is ``movement_id, location_type, location_id, product_id, delta,
event_time``.  The ids of applied movements are the keyed state of the stream, spread
over the state partitions by the hash of the id and kept in RocksDB: a micro-batch
looks up and adds its own ids only, whatever the age of the stream, and its
checkpoint uploads the changes.  A movement delivered again is dropped however long
ago the first was, also with another event time.  A movement without an id cannot be
recognised and counts every time it is delivered.

Each micro-batch writes the deltas it newly applies, summed per (location, product);
the stock is the last compacted table plus the deltas after it, and every
``compact_every`` batches the two are folded into one (rule W1).  A batch replayed
after a failure starts from the state before it and overwrites its own version, so
restarts from the checkpoint are idempotent.  The checkpoint is part of the data: a
stream that starts with a new one knows none of the ids applied before, so one beside
stock of earlier batches is refused.

    <out>/delta/v=<n>/                summed deltas that version n applied
    <out>/base/v=<n>/                 stock up to version n; all are kept unless ``keep_bases`` says how many
    <out>/_versions/                  published versions, and which have a base
"""

from __future__ import annotations

import gc
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from depotline.schemas import STOCK_QTY
from depotline.session import FREED, settings
from depotline.sources.tables import Tables

MOVEMENT_SCHEMA = T.StructType([
    T.StructField("movement_id", T.StringType()),
    T.StructField("location_type", T.StringType()),
    T.StructField("location_id", T.LongType()),
    T.StructField("product_id", T.LongType()),
    T.StructField("delta", STOCK_QTY),
    T.StructField("event_time", T.TimestampType()),
])

KEY = ["location_type", "location_id", "product_id"]


def document_movements(t: Tables) -> DataFrame:
    """Every stock movement implied by the documents, as stream records (``movements_by_kind`` together)."""
    return reduce(DataFrame.unionByName, movements_by_kind(t))


def movements_by_kind(t: Tables) -> list[DataFrame]:
    """Stock movements as stream records, a table for each of purchases, both sides of transfers, and sales.

    One movement per (document, location, product) with the quantities summed
    (lines have no natural key of their own); its id
    "<kind>:<document id>:<product id>" is stable, so a replayed record is
    recognised as the same movement.
    """
    def moves(lines: DataFrame, kind: str, doc: str, loc_type: str, loc: str, date: str, sign: int) -> DataFrame:
        return (lines.groupBy(doc, loc, "product_id", date).agg(F.sum("quantity").alias("q"))
                .select(F.concat_ws(":", F.lit(kind), F.col(doc).cast("string"),
                                    F.col("product_id").cast("string")).alias("movement_id"),
                        F.lit(loc_type).alias("location_type"), F.col(loc).alias("location_id"), "product_id",
                        (F.col("q") * F.lit(sign)).cast(STOCK_QTY).alias("delta"),
                        F.col(date).cast("timestamp").alias("event_time")))

    p = (t.purchase.where(F.col("is_deleted").isNull()).select("purchase_id", "warehouse_id", "purchase_date")
         .join(t.purchase_detail.where(F.col("is_deleted").isNull()).select("purchase_id", "product_id", "quantity"),
               "purchase_id"))
    tr = (t.transfer.select("transfer_id", "warehouse_id", "branch_id", "transfer_date")
          .join(t.transfer_detail.select("transfer_id", "product_id", "quantity"), "transfer_id"))
    s = (t.sale.where(F.col("is_deleted").isNull()).select("sale_id", "branch_id", "sale_date")
         .join(t.sale_detail.where(F.col("is_deleted").isNull()).select("sale_id", "product_id", "quantity"),
               "sale_id"))
    return [moves(p, "purchase", "purchase_id", "warehouse", "warehouse_id", "purchase_date", 1),
            moves(tr, "transfer_out", "transfer_id", "warehouse", "warehouse_id", "transfer_date", -1),
            moves(tr, "transfer_in", "transfer_id", "branch", "branch_id", "transfer_date", 1),
            moves(s, "sale", "sale_id", "branch", "branch_id", "sale_date", -1)]


def fold_batch(stock: DataFrame, batch: DataFrame) -> DataFrame:
    """W1 on one micro-batch: stock (KEY, quantity) + summed deltas, rows at 0 kept."""
    moved = batch.groupBy(*KEY).agg(F.sum("delta").alias("q"))
    return (stock.select(*KEY, F.col("quantity").alias("q")).unionByName(moved)
            .groupBy(*KEY).agg(F.sum("q").cast(STOCK_QTY).alias("quantity")))


STOCK_SCHEMA = T.StructType([T.StructField(k, MOVEMENT_SCHEMA[k].dataType) for k in KEY]
                            + [T.StructField("quantity", STOCK_QTY)])


VERSIONS = "v long, has_base boolean"


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(place)


def _publish(spark: SparkSession, out_dir: str, version: int, has_base: bool) -> None:
    spark.createDataFrame([(version, has_base)], VERSIONS).coalesce(1).write.mode("append").parquet(f"{out_dir}/_versions")


def _last(spark: SparkSession, out_dir: str, up_to: int | None = None, with_base: bool = False) -> int:
    """Highest published version (not above ``up_to``, with a base), -1 if none."""
    if not _exists(spark, f"{out_dir}/_versions"):
        return -1
    rows = spark.read.schema(VERSIONS).parquet(f"{out_dir}/_versions")
    if up_to is not None:
        rows = rows.where(F.col("v") <= up_to)
    if with_base:
        rows = rows.where("has_base")
    found = rows.agg(F.max("v")).first()[0]
    return -1 if found is None else int(found)


def _forget(spark: SparkSession, out_dir: str, version: int, keep: int) -> None:
    """Remove all bases before the last ``keep`` up to a version, and the deltas up to the oldest one kept."""
    oldest = version
    for _ in range(keep - 1):
        oldest = _last(spark, out_dir, oldest - 1, with_base=True)
    for kind, last in (("base", oldest - 1), ("delta", oldest)):
        place = spark._jvm.org.apache.hadoop.fs.Path(f"{out_dir}/{kind}")
        fs = place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        for f in fs.listStatus(place) if fs.exists(place) else []:
            name = f.getPath().getName()
            if name.startswith("v=") and int(name[2:]) <= last:
                fs.delete(f.getPath(), True)


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """Stock at a version, named ``<out_dir>/v=<n>`` as ``run_stock_stream`` returns it."""
    out_dir, _, number = path.rpartition("/v=")
    base = _last(spark, out_dir, int(number), with_base=True)
    stock = spark.read.schema(STOCK_SCHEMA).parquet(f"{out_dir}/base/v={base}")
    if int(number) == base:
        return stock
    deltas = (spark.read.schema(T.StructType([*STOCK_SCHEMA.fields, T.StructField("v", T.LongType())])).option("basePath", f"{out_dir}/delta").parquet(f"{out_dir}/delta")
              .where((F.col("v") > base) & (F.col("v") <= int(number))))
    return fold_batch(stock, deltas.withColumnRenamed("quantity", "delta"))


#: How the ids are kept, whatever the session's own settings for other streams are.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # Ids differ little from their neighbours: they take about half the place so, in the checkpoint and beside it.
    "spark.sql.streaming.stateStore.compression.codec": "zstd",
    "spark.sql.streaming.stateStore.rocksdb.compression": "zstd",
    # A restart needs the last state; without this, a hundred older ones stay whole in the checkpoint.
    "spark.sql.streaming.minBatchesToRetain": "3",
}


def fresh(movements: DataFrame) -> DataFrame:
    """Movements that were never delivered before, each once, and all without an id."""
    key = F.coalesce(F.concat(F.lit("id:"), "movement_id"), F.concat(F.lit("none:"), F.expr("uuid()")))
    return movements.withColumn("_key", key).dropDuplicates(["_key"]).drop("_key")


def run_stock_stream(spark: SparkSession, source_dir: str, out_dir: str, checkpoint: str,
                     opening: DataFrame | None = None, max_files_per_trigger: int | None = None,
                     compact_every: int = 20, keep_bases: int | None = None) -> str:
    """Fold every movement file under ``source_dir`` into stock; returns the name of
    the last version, for ``read_snapshot``.  Runs with ``availableNow`` (process what
    is there in as many micro-batches as the source limits ask for, then stop).
    Version 0 is the opening stock, micro-batch ``b`` makes version b + 1.  With ``keep_bases`` (two at least: a
    replayed batch starts before its own) older bases, and the deltas they hold, are removed; versions before
    the oldest base kept can then not be read any more."""
    if keep_bases is not None and keep_bases < 2:
        raise ValueError("keep_bases must be 2 or more")
    out_dir = out_dir.rstrip("/")
    if _last(spark, out_dir) > 0 and not _exists(spark, f"{checkpoint}/offsets"):
        raise ValueError(f"{out_dir} holds applied movements, but {checkpoint} is not the checkpoint that knows their ids")
    if _last(spark, out_dir) < 0:
        start = opening if opening is not None else spark.createDataFrame([], STOCK_SCHEMA)
        start.select(*KEY, F.col("quantity").cast(STOCK_QTY)).write.mode("overwrite").parquet(f"{out_dir}/base/v=0")
        _publish(spark, out_dir, 0, True)

    reader = spark.readStream.schema(MOVEMENT_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)

    def apply(batch: DataFrame, batch_id: int) -> None:
        session, version = batch.sparkSession, batch_id + 1
        (batch.groupBy(*KEY).agg(F.sum("delta").cast(STOCK_QTY).alias("quantity"))
         .write.mode("overwrite").parquet(f"{out_dir}/delta/v={version}"))
        compact = version - _last(session, out_dir, version - 1, with_base=True) >= compact_every
        if compact:
            read_snapshot(session, f"{out_dir}/v={version}").write.mode("overwrite").parquet(f"{out_dir}/base/v={version}")
        _publish(session, out_dir, version, compact)
        if compact and keep_bases:
            _forget(session, out_dir, version, keep_bases)
        gc.collect()
        session._jvm.System.gc()  # shuffle files of earlier batches go with the plans that named them

    with settings(spark, STATE | FREED):
        query = (fresh(reader.parquet(source_dir)).writeStream.foreachBatch(apply)
                 .option("checkpointLocation", checkpoint)
                 .trigger(availableNow=True)
                 .queryName(f"stock_fold_{uuid.uuid4().hex[:8]}")
                 .start())
    query.awaitTermination()
    if query.exception() is not None:
        raise RuntimeError(str(query.exception()))
    return f"{out_dir}/v={_last(spark, out_dir)}"
