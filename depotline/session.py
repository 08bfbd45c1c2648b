"""Spark session settings and the shared checkpoint folder.

The library never creates a session for a cluster job: callers pass their own.
``local_session`` is for tests and the benchmark only.
"""

from __future__ import annotations

import contextlib
import contextvars
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every job of this package relies on.  AQE re-plans joins at runtime
# (broadcast when a materialised side is small, split skewed partitions), and the
# static broadcast threshold is the size check for dimension lookups: Spark only
# broadcasts a side whose estimated size is below it and falls back to a
# sort-merge join otherwise.
RECOMMENDED_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64m",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.autoBroadcastJoinThreshold": "32m",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "32m",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.files.maxPartitionBytes": "128m",
    # Parquet is compressed: size estimates from file sizes are scaled up so the
    # static broadcast decision stays conservative (AQE still uses real sizes).
    "spark.sql.sources.fileCompressionFactor": "3.0",
}


def configure(spark: SparkSession, overrides: dict[str, str] | None = None) -> SparkSession:
    """Apply the recommended SQL settings to an existing (cluster) session.

    All of them are runtime SQL settings; executor sizing, shuffle partitions
    for the data size and ``spark.checkpoint.dir`` stay with the deployment.
    """
    for key, value in {**RECOMMENDED_CONF, **(overrides or {})}.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "depotline") -> SparkSession:
    """Session for tests and benchmarks on one machine (UI off, no ports)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in RECOMMENDED_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Jobs of this package write their intermediate tables below it.  Where the
    setting is missing, a folder given to ``SparkContext.setCheckpointDir`` is
    used; a session on one machine (``local`` master, as in tests) then gets a
    scratch folder of its own, and any other session is told to set one.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    if current:
        return current
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="depotline-ckpt-"))
    return sc.getCheckpointDir()


def new_folder(spark: SparkSession, name: str) -> str:
    """Path of a fresh folder (not yet made) under the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/depotline-{name}-{uuid.uuid4().hex}"


_scopes: contextvars.ContextVar[tuple[list[DataFrame], ...]] = contextvars.ContextVar("depotline_scopes", default=())


@contextlib.contextmanager
def staged_tables():
    """Removes, at its end, every table that ``stage`` wrote inside and that is not taken out of the list
    it gives.  Results of jobs read staged tables when they are written, so a caller writes them inside:

        with staged_tables():
            publish(... write_table(lifecycle.post_sales(t, headers, lines).tables.sale, ...) ...)
    """
    written: list[DataFrame] = []
    token = _scopes.set((*_scopes.get(), written))
    try:
        yield written
    finally:
        _scopes.reset(token)
        unstage(*written)


#: Shuffle files go when the query that wrote them ends, not when the driver happens to collect its garbage.
FREED = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


@contextlib.contextmanager
def settings(spark: SparkSession, wanted: dict[str, str]):
    """The settings for what is started inside; the session's own come back after."""
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` once to a fresh folder under the shared checkpoint folder and
    read it back.

    Used where a job reads the same derived batch several times (validation,
    admission rounds, new table versions): later steps scan the written copy
    instead of recomputing it, and the copy survives lost executors.  ``unstage``
    removes the copy when nothing reads it any more.  Shuffle files of the write go at its end.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    with settings(spark, FREED):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._depotline_stage = path
    if _scopes.get():
        _scopes.get()[-1].append(out)
    return out


def unstage(*tables: DataFrame | None) -> None:
    """Remove the written copies behind tables that ``stage`` returned."""
    for df in tables:
        path = getattr(df, "_depotline_stage", None)
        if path:
            jvm, conf = df.sparkSession._jvm, df.sparkSession._jsparkSession.sessionState().newHadoopConf()
            folder = jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(conf).delete(folder, True)
