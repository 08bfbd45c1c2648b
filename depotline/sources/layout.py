"""Bucketed storage layout for co-located document joins.

Headers and lines of one document kind are bucketed (and sorted) by the same
document key into the same number of buckets.  Joins of lines with their
headers, and the per-document line aggregates of every report and list, then
read matching buckets side by side: no shuffle of the line tables, which are
the largest tables of the model.  Dimension and stock tables stay plain Parquet
(the dimensions are looked up after pre-aggregation, the stock by its pair key).

Skew: a bucket is read by one task, so one document holding a large share of
the lines would turn its bucket into a straggler that AQE cannot split.  When
writing, each document kind is measured (largest document / all lines, one
partial aggregation) and kinds above ``max_doc_share`` are written plain
instead; their joins then shuffle, where partial aggregation and AQE skew
splitting spread a hot document over many tasks.

Tables are external tables in the session catalog over a folder; a new session
re-registers them with ``register_bucketed`` (DDL only, no data is moved).  How
each table was written is stored with the data (``_layout``) and read back there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depotline.functions.dates import MONTH
from depotline.schemas import SCHEMAS, TABLE_NAMES
from depotline.sources.tables import Tables, conform

# Document kinds: the line table whose per-document size decides the layout.
KIND_LINES = {"sale": ("sale", "sale_detail"), "purchase": ("purchase", "purchase_detail", "payment"),
              "transfer": ("transfer", "transfer_detail")}

# Document key of each bucketed table.
BUCKET_KEYS: dict[str, str] = {
    "sale": "sale_id", "sale_detail": "sale_id",
    "purchase": "purchase_id", "purchase_detail": "purchase_id", "payment": "purchase_id",
    "transfer": "transfer_id", "transfer_detail": "transfer_id",
}


LAYOUT = "name string, key string, buckets int, by_month boolean"

# Date of each document kind, for tables stored by document month.
DATES = {"sale": "sale_date", "purchase": "purchase_date", "transfer": "transfer_date"}


def _with_month(tables: Tables, kind: str, name: str, df: DataFrame) -> DataFrame:
    """The table with the month of its document."""
    key, date = BUCKET_KEYS[name], DATES[kind]
    month = F.date_format(date, "yyyy-MM").alias(MONTH)
    if name == kind:
        return df.select("*", month)
    return df.join(conform(getattr(tables, kind), kind).select(key, month), key, "left")


def _ddl_type(dt) -> str:
    return dt.simpleString()


def largest_document_share(lines, key: str) -> float:
    """Share of all rows held by the largest document (0 for an empty table)."""
    per_doc = lines.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    row = per_doc.agg(F.max("n").alias("top"), F.sum("n").alias("all")).first()
    return 0.0 if not row or not row["all"] else row["top"] / row["all"]


def save_bucketed(spark: SparkSession, tables: Tables, database: str, location: str, buckets: int,
                  max_doc_share: float | None = None, by_month: bool = False) -> Tables:
    """Write all fifteen tables under ``location`` (documents bucketed by their key
    unless one document is too large a share of its kind) and return them read
    through the catalog.

    ``by_month`` also partitions headers, lines and payments by the month of their
    document, so that dated reports read only the months of their range; worth it
    where a month's bucket still fills a file.  The tables then have the partition
    column as well; jobs that write tables take ``plain_columns`` of them."""
    location = location.rstrip("/")
    limit = max_doc_share if max_doc_share is not None else 1.0 / (4 * buckets)
    plain = set()
    for kind, names in KIND_LINES.items():
        line_table = names[1]
        if largest_document_share(getattr(tables, line_table), BUCKET_KEYS[line_table]) > limit:
            plain.update(names)
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database} LOCATION '{location}'")
    layout = []
    for name in TABLE_NAMES:
        df = conform(getattr(tables, name), name)
        key = BUCKET_KEYS.get(name) if name not in plain else None
        monthly = by_month and name in BUCKET_KEYS
        layout.append((name, key, buckets if key else None, monthly))
        if monthly:
            df = _with_month(tables, next(k for k, names in KIND_LINES.items() if name in names), name, df)
        if key:
            df = df.repartition(buckets, key)  # one file a bucket instead of one a task and bucket
        writer = df.write.format("parquet").option("path", f"{location}/{name}")
        if key:
            writer = writer.bucketBy(buckets, key).sortBy(key)
        if monthly:
            writer = writer.partitionBy(MONTH)
        writer.saveAsTable(f"{database}.{name}")
    spark.createDataFrame(layout, LAYOUT).coalesce(1).write.mode("overwrite").parquet(f"{location}/_layout")
    return load_bucketed(spark, database)


def register_bucketed(spark: SparkSession, database: str, location: str) -> Tables:
    """Declare the external tables of an existing layout in this session's catalog, as
    they were written."""
    location = location.rstrip("/")
    layout = {r["name"]: r for r in spark.read.schema(LAYOUT).parquet(f"{location}/_layout").collect()}  # a row a table
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database} LOCATION '{location}'")
    for name in TABLE_NAMES:
        cols = ", ".join(f"`{f.name}` {_ddl_type(f.dataType)}" for f in SCHEMAS[name].fields)
        key, buckets, monthly = layout[name]["key"], layout[name]["buckets"], layout[name]["by_month"]
        clustered = f" CLUSTERED BY ({key}) SORTED BY ({key}) INTO {buckets} BUCKETS" if key else ""
        parts = f" PARTITIONED BY ({MONTH})" if monthly else ""
        cols += f", {MONTH} string" if monthly else ""
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({cols}) USING parquet{parts}{clustered} "
                  f"LOCATION '{location}/{name}'")
        if monthly:
            spark.catalog.recoverPartitions(f"{database}.{name}")
    return load_bucketed(spark, database)


def load_bucketed(spark: SparkSession, database: str) -> Tables:
    return Tables(**{name: spark.table(f"{database}.{name}") for name in TABLE_NAMES})


def plain_columns(t: Tables) -> Tables:
    """The tables with the columns of the data model only."""
    return Tables(**{name: conform(getattr(t, name), name) for name in TABLE_NAMES})
