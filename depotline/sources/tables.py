"""S1 load the fifteen tables with their fixed schema; S7 write and publish snapshots.

A snapshot folder holds, per table, parts that are never changed once written, and
numbered manifests that say which parts make up the current version:

    <base>/<table>/v=<uuid>/        parts of a table
    <base>/_manifest/<number>.json  table -> folders of its parts

``publish`` adds the next manifest; it is written under a temporary name and
renamed, and the rename fails if another job has taken the number, so readers see
either the old version or the new one, and no publication is lost.
"""

from __future__ import annotations

import dataclasses
import functools
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from depotline.schemas import LINE_KEYS, SCHEMAS, TABLE_NAMES, schema_of


@dataclasses.dataclass(frozen=True)
class Tables:
    """The fifteen tables of the data model as DataFrames."""

    warehouse: DataFrame
    branch: DataFrame
    employee: DataFrame
    customer: DataFrame
    supplier: DataFrame
    product: DataFrame
    purchase: DataFrame
    purchase_detail: DataFrame
    payment: DataFrame
    sale: DataFrame
    sale_detail: DataFrame
    transfer: DataFrame
    transfer_detail: DataFrame
    warehouse_stock: DataFrame
    branch_stock: DataFrame

    def replace(self, **changed: DataFrame) -> "Tables":
        return dataclasses.replace(self, **changed)

    def as_dict(self) -> dict[str, DataFrame]:
        return {name: getattr(self, name) for name in TABLE_NAMES}


def conform(df: DataFrame, name: str) -> DataFrame:
    """Select and cast the columns of ``df`` to the fixed schema of table ``name``, with the key of lines
    that have one."""
    schema = schema_of(name, LINE_KEYS.get(name) in df.columns)
    return df.select([df[f.name].cast(f.dataType).alias(f.name) for f in schema.fields])


def load_tables(spark: SparkSession, path: str, fmt: str = "parquet",
                options: dict[str, str] | None = None, line_keys: bool = False) -> Tables:
    """Read ``path/<table>`` for every table with the fixed schema.

    ``fmt`` may be any batch source Spark reads (parquet, orc, csv, json); for a
    JDBC database pass ``fmt="jdbc"`` and the connection ``options`` with a
    ``{table}`` placeholder in ``dbtable``.  Nothing is inferred.  A CSV or JSON value
    that does not fit the schema fails the load (``mode`` FAILFAST), since a flag or
    id read as NULL would change its meaning; ``options={"mode": ...}`` overrides it.
    ``line_keys`` reads the keys of the line tables too.
    """
    options = dict(options or {})
    frames = {}
    for name in TABLE_NAMES:
        reader = spark.read.format(fmt)
        if fmt == "jdbc":
            opts = {k: v.format(table=name) for k, v in options.items()}
            frames[name] = conform(reader.options(**opts).load(), name)
        else:
            if fmt in ("csv", "json"):
                reader = reader.option("mode", "FAILFAST").option("header", "true")
            frames[name] = reader.schema(schema_of(name, line_keys)).options(**options).load(f"{path.rstrip('/')}/{name}")
    return Tables(**frames)


#: Name of the text of a row that is no row of its file format.
CORRUPT = "_corrupt_record"


def read_with_rejects(spark: SparkSession, path: str, name: str, fmt: str = "csv", options: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """S1 for text files of a table: (rows with the fixed schema, rejects ``table_name, reason, record``).

    Every column is read as text and cast on its own.  A row with a text that does not fit its column is
    rejected as ``bad_<column>`` (the first such column), a row that the format cannot read as
    ``malformed``; ``record`` is the row as JSON, or its raw text.  Blank text is NULL, never a reject."""
    fields = SCHEMAS[name].fields
    raw_schema = ", ".join([*(f"`{f.name}` string" for f in fields), f"{CORRUPT} string"])
    reader = spark.read.format(fmt).schema(raw_schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
    raw = reader.option("header", "true").options(**(options or {})).load(path)
    text = {f.name: F.when(F.trim(f.name) != "", F.col(f.name)) for f in fields}
    cast = {f.name: F.trim(text[f.name]).try_cast(f.dataType) if not isinstance(f.dataType, T.StringType) else F.col(f.name) for f in fields}
    reason = F.when(F.col(CORRUPT).isNotNull(), F.lit("malformed"))
    for f in fields:
        if not isinstance(f.dataType, T.StringType):
            reason = reason.when(text[f.name].isNotNull() & cast[f.name].isNull(), F.lit(f"bad_{f.name}"))
    marked = raw.withColumn("_reason", reason)
    good = marked.where(F.col("_reason").isNull()).select(*(cast[f.name].alias(f.name) for f in fields))
    record = F.coalesce(F.col(CORRUPT), F.to_json(F.struct(*(f.name for f in fields))))
    return good, marked.where(F.col("_reason").isNotNull()).select(F.lit(name).alias("table_name"), F.col("_reason").alias("reason"), record.alias("record"))


def load_with_rejects(spark: SparkSession, path: str, fmt: str = "csv", options: dict[str, str] | None = None,
                      max_reject_share: float | None = None) -> tuple[Tables, DataFrame]:
    """All fifteen tables of text files under ``path``, and the rejects of all of them.

    With ``max_reject_share`` a table of which a larger share of rows is rejected fails the load (one
    count a table); otherwise nothing is run here."""
    both = {n: read_with_rejects(spark, f"{path.rstrip('/')}/{n}", n, fmt, options) for n in TABLE_NAMES}
    if max_reject_share is not None:
        for name, (good, bad) in both.items():
            n_good, n_bad = good.count(), bad.count()
            if n_bad > max_reject_share * (n_good + n_bad):
                raise ValueError(f"{n_bad} of {n_good + n_bad} rows of {name} are rejected")
    return Tables(**{n: good for n, (good, _) in both.items()}), functools.reduce(DataFrame.unionByName, (bad for _, bad in both.values()))


def write_table(df: DataFrame, base: str, name: str, partition_by: tuple[str, ...] = (),
                fmt: str = "parquet") -> str:
    """Write one table as a new snapshot version and return its directory.

    Never overwrites a path that may be read by the plan producing ``df``: each
    call writes a fresh ``<base>/<name>/v=<uuid>`` directory; publishing (switching
    readers to the new version) is the caller's last step.
    """
    target = f"{base.rstrip('/')}/{name}/v={uuid.uuid4().hex}"
    writer = conform(df, name).write.mode("errorifexists").format(fmt)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(target)
    return target


def write_snapshot(tables: Tables, base: str, names: tuple[str, ...] | None = None,
                   fmt: str = "parquet") -> dict[str, str]:
    """Write the given tables (default all) as new versions; returns name -> path."""
    out = {}
    for name in names or TABLE_NAMES:
        out[name] = write_table(getattr(tables, name), base, name, fmt=fmt)
    return out


def folder(spark: SparkSession, path: str):
    """The Hadoop file system of ``path``, and the path in its terms."""
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(conf), place


def current_version(spark: SparkSession, base: str) -> tuple[int, dict[str, list[str]]]:
    """Number of the current version (0: none yet) and the folders of its tables."""
    fs, place = folder(spark, f"{base.rstrip('/')}/_manifest")
    if not fs.exists(place):
        return 0, {}
    names = [f.getPath().getName() for f in fs.listStatus(place)]
    last = max((int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith((".", "_"))), default=0)
    if not last:
        return 0, {}
    text = spark.read.text(f"{place.toString()}/{last:012d}.json", wholetext=True).first()[0]
    return last, json.loads(text)


def publish(spark: SparkSession, base: str, changed: dict[str, str], appended: dict[str, str] | None = None,
            expected: int | None = None) -> int:
    """Make the written parts the current version and return its number.

    ``changed`` replaces the parts of a table, ``appended`` adds a part to them; other
    tables keep theirs.  ``expected`` is the version that the job started from: if
    another job has published since, this one fails and nothing changes.
    """
    number, tables = current_version(spark, base)
    if expected is not None and number != expected:
        raise RuntimeError(f"version {number} was published after version {expected}, on which this job is based")
    tables = {**tables, **{n: [p] for n, p in changed.items()}}
    for name, part in (appended or {}).items():
        tables[name] = [*tables.get(name, []), part]
    fs, place = folder(spark, f"{base.rstrip('/')}/_manifest")
    fs.mkdirs(place)
    path = spark._jvm.org.apache.hadoop.fs.Path
    temporary, final = path(place, f"_{uuid.uuid4().hex}"), path(place, f"{number + 1:012d}.json")
    out = fs.create(temporary, False)
    out.write(json.dumps(tables).encode())
    out.close()
    if fs.exists(final) or not fs.rename(temporary, final):
        fs.delete(temporary, False)
        raise RuntimeError(f"version {number + 1} was published by another job")
    return number + 1


def load_current(spark: SparkSession, base: str, line_keys: bool = False) -> Tables:
    """The tables of the current version, on request with the keys of lines; a table without parts is empty."""
    _, tables = current_version(spark, base)
    frames = {}
    for name in TABLE_NAMES:
        parts = tables.get(name)
        schema = schema_of(name, line_keys)
        frames[name] = spark.read.schema(schema).parquet(*parts) if parts else spark.createDataFrame([], schema)
    return Tables(**frames)


def write_rows(rows: DataFrame, base: str, name: str) -> str:
    """Write new rows of a table (a post adds rows, it changes none) as a part to be appended."""
    return write_table(rows, base, name)


def materialize(spark: SparkSession, tables: Tables, base: str, fmt: str = "parquet") -> Tables:
    """Write every table under ``base/<name>`` and read them back with the fixed schema."""
    for name in TABLE_NAMES:
        conform(getattr(tables, name), name).write.mode("errorifexists").format(fmt).save(
            f"{base.rstrip('/')}/{name}")
    return load_tables(spark, base, fmt)


def tables_from_rows(spark: SparkSession, **rows: list) -> Tables:
    """Small in-memory Tables for tests and examples; tables not given are empty."""
    frames = {}
    for name in TABLE_NAMES:
        data = rows.get(name, [])
        frames[name] = spark.createDataFrame(data, SCHEMAS[name])
    return Tables(**frames)
