"""S7 on stored parts: versions that stay co-located, of which a job rewrites the touched parts only.

Headers, lines and payments are stored by the month of their document and the bucket of its key; one
folder a (month, bucket) is a part.  A part is never changed.  A manifest lists the parts of all tables
of a version, and publishing writes the next manifest:

    <base>/<table>/w=<uuid>/doc_month=<m>/doc_bucket=<b>/    parts of one write
    <base>/_manifest/<number>.json                           version -> parts

``open_version`` declares a version's tables in the session's catalog as bucketed external tables, each
partition at the folder that the manifest names.  Joins and aggregations by document therefore find
matching buckets side by side in every version, however often parts were replaced, and filters on month
or bucket prune folders.  Tables with more than ``BUCKET_BYTES`` a bucket are declared as plain partitioned
ones, since a bucket is read by one task.  Dimension and stock tables are plain parts.

``touched`` finds the parts that hold given documents, ``only`` restricts tables to them (a job on the
restricted tables gives their new content), and ``write_parts`` writes it; all other parts are carried
over by name.  ``publish`` takes what a job read and wrote: it succeeds if no other job has replaced any
of these parts since, on whatever version, and fails otherwise.  ``vacuum`` forgets old versions and
removes the parts that only they name.
"""

from __future__ import annotations

import dataclasses
import json
import time
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from depotline.functions.dates import MONTH
from depotline.schemas import LINE_KEYS, TABLE_NAMES, schema_of
from depotline.sources.layout import BUCKET_KEYS, DATES, KIND_LINES, plain_columns
from depotline.sources.tables import Tables, conform, folder

BUCKET, PIECE = "doc_bucket", "doc_piece"
#: (month, bucket) of a part; None for plain tables.
Place = tuple[str, int] | None
KIND_OF = {name: kind for kind, names in KIND_LINES.items() for name in names}
#: Bytes of a table that one task reads as its bucket; larger buckets are read as plain files.
BUCKET_BYTES = 24 * 2**20
#: Month of documents without a date.
NO_MONTH = "none"


class Conflict(RuntimeError):
    """Another job has replaced a part that this one read or wrote."""


@dataclasses.dataclass(frozen=True)
class Version:
    """A version's number, its number of buckets, the folders of its parts by table and place (rows
    appended to a place are one more folder there), and the next free key of each line table with keys."""

    number: int
    buckets: int
    parts: dict[str, dict[Place, tuple[str, ...]]]
    next_line: dict[str, int] = dataclasses.field(default_factory=dict)

    def schema(self, name: str) -> T.StructType:
        return schema_of(name, name in self.next_line)


def _path(base: str, number: int) -> str:
    return f"{base.rstrip('/')}/_manifest/{number:012d}.json"


def _numbers(spark: SparkSession, base: str) -> list[int]:
    fs, place = folder(spark, f"{base.rstrip('/')}/_manifest")
    if not fs.exists(place):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(place)]
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0].isdigit())


def read_version(spark: SparkSession, base: str, number: int | None = None) -> Version:
    """The manifest of a version, the current one if no number is given."""
    numbers = _numbers(spark, base)
    if number is None:
        number = numbers[-1] if numbers else 0
    if number not in numbers:
        raise ValueError(f"{base} has no version {number}")
    body = json.loads(spark.read.text(_path(base, number), wholetext=True).first()[0])
    parts = {t: {None if m is None else (m, b): tuple(paths) for m, b, paths in rows} for t, rows in body["parts"].items()}
    return Version(number, body["buckets"], parts, body.get("next_line", {}))


def derived(base: str, what: str, number: int) -> str:
    """Folder of a kept result of a version (see ``sources.changes``)."""
    return f"{base.rstrip('/')}/_derived/{what}/{number:012d}"


def _write_manifest(spark: SparkSession, base: str, version: Version) -> None:
    fs, place = folder(spark, f"{base.rstrip('/')}/_manifest")
    fs.mkdirs(place)
    path = spark._jvm.org.apache.hadoop.fs.Path
    temporary, final = path(place, f"_{uuid.uuid4().hex}"), path(place, f"{version.number:012d}.json")
    rows = {t: [[*(p or (None, None)), list(paths)] for p, paths in places.items()] for t, places in version.parts.items()}
    out = fs.create(temporary, False)
    out.write(json.dumps({"buckets": version.buckets, "parts": rows, "next_line": version.next_line}).encode())
    out.close()
    if fs.exists(final) or not fs.rename(temporary, final):
        fs.delete(temporary, False)
        raise Conflict(f"version {version.number} was published by another job")


# -------------------------------------------------------------------------------------- writing
def _placed(tables: Tables, name: str, buckets: int) -> DataFrame:
    """A document table with the month and bucket of its rows' documents."""
    key, kind = BUCKET_KEYS[name], KIND_OF[name]
    month = F.coalesce(F.date_format(DATES[kind], "yyyy-MM"), F.lit(NO_MONTH)).alias(MONTH)
    df = conform(getattr(tables, name), name)
    if name == kind:
        df = df.select("*", month)
    else:
        # of an id that stands twice, lines follow one header and come once
        months = conform(getattr(tables, kind), kind).groupBy(key).agg(F.min(month).alias(MONTH))
        df = df.join(months, key, "left").fillna(NO_MONTH, [MONTH])
    return df.select(*schema_of(name, LINE_KEYS.get(name) in df.columns).names, MONTH, F.pmod(F.hash(key), F.lit(buckets)).alias(BUCKET))


def write_parts(tables: Tables, base: str, buckets: int, names: tuple[str, ...] = TABLE_NAMES) -> dict[str, dict[Place, tuple[str, ...]]]:
    """Write the tables as new parts; returns their folders by table and place."""
    spark, out = getattr(tables, names[0]).sparkSession, {}
    for name in names:
        target = f"{base.rstrip('/')}/{name}/w={uuid.uuid4().hex}"
        if name not in BUCKET_KEYS:
            conform(getattr(tables, name), name).write.parquet(target)
            out[name] = {None: (target,)}
            continue
        key, table = BUCKET_KEYS[name], f"depotline_w_{uuid.uuid4().hex}"
        # rows of a part meet in one task, unless there are too many: any number of tasks writes few buckets
        writer = _placed(tables, name, buckets).hint("rebalance", MONTH, BUCKET).write.format("parquet").option("path", target)
        writer.partitionBy(MONTH, BUCKET).bucketBy(buckets, key).sortBy(key).saveAsTable(table)
        spark.sql(f"DROP TABLE {table}")  # external: only the files were wanted
        fs, place = folder(spark, target)
        out[name] = {}
        for m in fs.listStatus(place):
            if m.isDirectory() and m.getPath().getName().startswith(f"{MONTH}="):
                for b in fs.listStatus(m.getPath()):
                    month, bucket = (x.getPath().getName().partition("=")[2] for x in (m, b))
                    out[name][month, int(bucket)] = (b.getPath().toString(),)
    return out


def create(spark: SparkSession, tables: Tables, base: str, buckets: int) -> Version:
    """Version 1: all tables, in parts.  Line tables that have keys (operators.lines) keep them from then on."""
    keyed = {n: k for n, k in LINE_KEYS.items() if k in getattr(tables, n).columns}
    written = write_parts(tables, base, buckets)
    last = {n: getattr(tables, n).agg(F.max(k)).first()[0] or 0 for n, k in keyed.items()}
    version = Version(1, buckets, written, {n: last[n] + 1 for n in keyed})
    _write_manifest(spark, base, version)
    return version


# -------------------------------------------------------------------------------------- reading
def _stored_bytes(spark: SparkSession, base: str, name: str) -> int:
    """Bytes of all stored parts of a table, those of older versions too."""
    fs, place = folder(spark, f"{base.rstrip('/')}/{name}")
    return fs.getContentSummary(place).getLength() if fs.exists(place) else 0


def open_version(spark: SparkSession, base: str, number: int | None = None) -> tuple[Version, Tables]:
    """A version and its tables; document tables also have the partition columns ``doc_month``,
    ``doc_bucket`` and ``doc_piece`` (number of the folder at its place).  A kind of documents whose buckets
    are too large for a task each is declared without buckets: its files are split, and its joins shuffle."""
    version = read_version(spark, base, number)
    small = {kind: max(_stored_bytes(spark, base, n) for n in names) <= BUCKET_BYTES * version.buckets for kind, names in KIND_LINES.items()}
    frames = {}
    for name in TABLE_NAMES:
        places = version.parts.get(name, {})
        if name not in BUCKET_KEYS:
            paths = [p for ps in places.values() for p in ps]
            frames[name] = spark.read.schema(version.schema(name)).parquet(*paths) if paths else spark.createDataFrame([], version.schema(name))
            continue
        table, key = f"depotline_v_{uuid.uuid4().hex}", BUCKET_KEYS[name]
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in version.schema(name).fields)
        clustered = f"CLUSTERED BY ({key}) SORTED BY ({key}) INTO {version.buckets} BUCKETS " if small[KIND_OF[name]] else ""
        spark.sql(f"CREATE TABLE {table} ({columns}, {MONTH} string, {BUCKET} int, {PIECE} int) USING parquet PARTITIONED BY ({MONTH}, {BUCKET}, {PIECE}) "
                  f"{clustered}LOCATION '{base.rstrip('/')}/{name}'")
        specs = [f"PARTITION ({MONTH}='{m}', {BUCKET}={b}, {PIECE}={n}) LOCATION '{path}'"
                 for (m, b), paths in places.items() for n, path in enumerate(paths)]
        for at in range(0, len(specs), 1000):
            spark.sql(f"ALTER TABLE {table} ADD {' '.join(specs[at : at + 1000])}")
        frames[name] = spark.table(table)
    return version, Tables(**frames)


def touched(tables: Tables, version: Version, kind: str, ids: DataFrame) -> set[tuple[str, int]]:
    """Places of the parts that hold the given documents (a column of ids) of a kind; the set is bounded by
    the number of parts.  Only the ids' buckets of the header table are read."""
    key = BUCKET_KEYS[kind]
    wanted = ids.select(ids[ids.columns[0]].cast("long").alias(key)).distinct()
    buckets = [r[0] for r in wanted.select(F.pmod(F.hash(key), F.lit(version.buckets))).distinct().collect()]  # at most the buckets
    heads = getattr(tables, kind).where(F.col(BUCKET).isin(buckets)).join(wanted, key, "left_semi")
    return {(r[0], r[1]) for r in heads.select(MONTH, BUCKET).distinct().collect()}


def only(tables: Tables, kind: str, places: set[tuple[str, int]]) -> Tables:
    """``tables`` with the columns of the data model, where those of a kind of documents are read at the
    given places only."""
    months: dict[str, list[int]] = {}
    for m, b in places:
        months.setdefault(m, []).append(b)
    within = reduce(lambda x, y: x | y, ((F.col(MONTH) == m) & F.col(BUCKET).isin(bs) for m, bs in sorted(months.items())), F.lit(False))
    return plain_columns(tables.replace(**{n: getattr(tables, n).where(within) for n in KIND_LINES[kind]}))


def rewrite(tables: Tables, base: str, version: Version, kind: str, places: set[tuple[str, int]]) -> dict[str, dict[Place, tuple[str, ...]]]:
    """Write the new content of a kind's tables at the given places, from a job on tables restricted to
    them.  A place without rows is empty from then on.  Documents that the job moved to another month
    must find that place among the given ones, since what stood there would be lost."""
    written = write_parts(tables, base, version.buckets, KIND_LINES[kind])
    beyond = {p for parts in written.values() for p in parts} - places
    if beyond:
        raise ValueError(f"documents moved to {sorted(beyond)}, which the job did not read")
    return {t: {p: parts.get(p, ()) for p in places} for t, parts in written.items()}


# ------------------------------------------------------------------------------------ publishing
def publish(spark: SparkSession, base: str, started: Version, written: dict[str, dict[Place, tuple[str, ...]]],
            appended: dict[str, dict[Place, tuple[str, ...]]] | None = None, read: dict[str, set[Place]] | None = None,
            attempts: int = 20) -> Version:
    """Make the written parts current, in place of those at their places; appended ones stand beside them.

    ``started`` is the version that the job read, ``read`` the places whose content its decisions rest
    on, besides those it wrote or appended to.  Parts that other jobs have published since at other places are kept, so
    disjoint jobs both succeed; a part of the job's that was replaced raises ``Conflict``, and nothing
    changes."""
    checked: dict[str, set[Place]] = {}
    for touched_places in (written, appended or {}, read or {}):
        for t, places in touched_places.items():
            checked.setdefault(t, set()).update(places)
    for attempt in range(attempts):
        now = read_version(spark, base)
        for t, places in checked.items():
            for p in places:
                if now.parts.get(t, {}).get(p) != started.parts.get(t, {}).get(p):
                    raise Conflict(f"{t} at {p} was replaced in version {now.number} or before, after version {started.number}")
        parts = {**now.parts, **{t: {**now.parts.get(t, {}), **places} for t, places in written.items()}}
        for t, places in (appended or {}).items():
            parts[t] = {**parts.get(t, {}), **{p: (*parts.get(t, {}).get(p, ()), *paths) for p, paths in places.items()}}
        try:
            new = Version(now.number + 1, now.buckets, parts, now.next_line)
            _write_manifest(spark, base, new)
            return new
        except Conflict:  # another job took the number: look again at what it replaced
            if attempt == attempts - 1:
                raise
    raise Conflict("no attempts")


def reserve_lines(spark: SparkSession, base: str, counts: dict[str, int], attempts: int = 20) -> dict[str, int]:
    """Take that many keys of each line table out of the store, whatever other jobs take at the same time;
    returns the first of each.  Keys that a job takes and never publishes stay unused."""
    for attempt in range(attempts):
        now = read_version(spark, base)
        taken = now.next_line | {n: now.next_line[n] + count for n, count in counts.items()}
        try:
            _write_manifest(spark, base, Version(now.number + 1, now.buckets, now.parts, taken))
            return {n: now.next_line[n] for n in counts}
        except Conflict:
            if attempt == attempts - 1:
                raise
    raise Conflict("no attempts")


def vacuum(spark: SparkSession, base: str, keep: int, grace_seconds: float = 7 * 86400) -> list[str]:
    """Forget all but the last ``keep`` versions (at least one), and remove the parts that no kept version names and that
    were written longer than ``grace_seconds`` ago (jobs that run may still be writing or reading younger
    ones).  Returns the removed folders."""
    numbers = _numbers(spark, base)
    old, kept = numbers[:-max(1, keep)], numbers[-max(1, keep):]
    named = lambda n: {p for places in read_version(spark, base, n).parts.values() for ps in places.values() for p in ps}
    live = set().union(*map(named, kept))
    dead = set().union(*map(named, old)) - live
    removed = []
    for p in sorted(dead):
        fs, place = folder(spark, p)
        if fs.exists(place) and fs.getFileStatus(place).getModificationTime() / 1000 <= time.time() - grace_seconds:
            fs.delete(place, True)
            removed.append(p)
    if len(removed) == len(dead):  # else the old manifests still name what is left to remove
        fs, kinds = folder(spark, f"{base.rstrip('/')}/_derived")
        whats = [f.getPath().getName() for f in fs.listStatus(kinds)] if fs.exists(kinds) else []
        for n in old:
            for path in (_path(base, n), *(derived(base, what, n) for what in whats)):
                fs, place = folder(spark, path)
                fs.delete(place, True)
    return removed
