"""What differs between two stored versions, and results that are carried from one to the next.

A part is never changed once written, so the folders that only one of two manifests names are all that
differs: rows of ``removed`` folders left, rows of ``added`` ones came.  A job that knows its result for an
earlier version reads these, and of the folders that both name only those that can matter.

Results are kept beside the data and found again by version:

    <base>/_derived/<what>/<number>/<uuid>/

A result counts once its folder holds Spark's ``_SUCCESS``; two jobs that derive the same one write two
equal folders.  ``versions.vacuum`` removes those of the versions that it forgets.
"""

from __future__ import annotations

import dataclasses
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession

from depotline.schemas import TABLE_NAMES
from depotline.sources.layout import BUCKET_KEYS, KIND_LINES
from depotline.sources.tables import Tables, folder
from depotline.sources.versions import NO_MONTH, Place, Version, _numbers, derived, read_version


@dataclasses.dataclass(frozen=True)
class Change:
    """Two versions of one base."""

    old: Version
    new: Version

    def folders(self, name: str, side: str, buckets: Iterable[int] | None = None) -> list[str]:
        """Folders of a table that only the old version names (``removed``), only the new one (``added``)
        or both (``common``); of a document table on request those of the given buckets only."""
        within = None if buckets is None else set(buckets)
        of = lambda v: {f for p, fs in v.parts.get(name, {}).items() if within is None or p is None or p[1] in within for f in fs}
        before, after = of(self.old), of(self.new)
        return sorted({"removed": before - after, "added": after - before, "common": before & after}[side])

    def touches(self, *names: str) -> bool:
        return any(self.folders(n, side) for n in names for side in ("removed", "added"))

    def places(self, *names: str) -> set[Place]:
        """Places of the given tables at which the versions name different folders."""
        return {p for n in names for p in {*self.old.parts.get(n, {}), *self.new.parts.get(n, {})}
                if set(self.old.parts.get(n, {}).get(p, ())) != set(self.new.parts.get(n, {}).get(p, ()))}

    def document_places(self, head: str, lines: str) -> set[Place]:
        """Places at which documents may have come, left or changed, with all places where their lines
        may stand: a line whose document was unknown when it was written stands without a month, so it
        may belong to any document of its bucket."""
        changed = self.places(head, lines)
        loose = {p[1] for p in changed if p[0] == NO_MONTH}
        everywhere = {p for v in (self.old, self.new) for n in (head, lines) for p in v.parts.get(n, {}) if p[1] in loose}
        return changed | everywhere | {(NO_MONTH, p[1]) for p in changed}


def read_folders(spark: SparkSession, version: Version, name: str, paths: Iterable[str]) -> DataFrame:
    """Rows of a table in the given part folders."""
    paths, schema = list(paths), version.schema(name)
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def tables_at(spark: SparkSession, version: Version, places: dict[str, set[Place]]) -> Tables:
    """The tables named in ``places`` at these places of a version; other tables are empty."""
    return Tables(**{n: read_folders(spark, version, n, [f for p in sorted(places.get(n, ()), key=str) for f in version.parts.get(n, {}).get(p, ())])
                     for n in TABLE_NAMES})


def carried(spark: SparkSession, base: str, what: str, number: int | None, schema: str, full: Callable[[Version], DataFrame],
            step: Callable[[DataFrame, Change], DataFrame]) -> DataFrame:
    """The result ``what`` of a version (the current one if no number is given).

    It is read if it was kept; else made by ``step`` from the kept result of the latest earlier version, or
    by ``full`` if there is none; and kept in turn."""
    version = read_version(spark, base, number)
    if kept := _kept(spark, base, what, version.number):
        return spark.read.schema(schema).parquet(kept)
    out = None
    for earlier in reversed([n for n in _numbers(spark, base) if n < version.number]):
        if kept := _kept(spark, base, what, earlier):
            out = step(spark.read.schema(schema).parquet(kept), Change(read_version(spark, base, earlier), version))
            break
    out = full(version) if out is None else out
    path = f"{derived(base, what, version.number)}/{uuid.uuid4().hex}"
    out.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def _kept(spark: SparkSession, base: str, what: str, number: int) -> str | None:
    fs, place = folder(spark, derived(base, what, number))
    if not fs.exists(place):
        return None
    path = spark._jvm.org.apache.hadoop.fs.Path
    done = sorted(f.getPath().toString() for f in fs.listStatus(place) if fs.exists(path(f.getPath(), "_SUCCESS")))
    return done[0] if done else None


def bucket_key(name: str) -> str | None:
    """The column by which a table's rows are dealt to buckets."""
    return BUCKET_KEYS.get(name)


#: Header and line table of each kind of documents.
DOCUMENTS = {kind: (names[0], names[1]) for kind, names in KIND_LINES.items()}
