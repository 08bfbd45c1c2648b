"""Keys of the line tables: every line gets a number of its own, without gaps.

Lines that have no key are written once, sorted by document inside each file, and numbered by their place:
the rows of the files before theirs, plus their own row in the file.  Nothing is shuffled or gathered by
key but one row a file, and a task that runs again finds the same files, so it gives the same numbers.
Keys that lines have stay theirs; later jobs number only what they add.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from depotline.schemas import LINE_KEYS
from depotline.session import stage
from depotline.sources.layout import BUCKET_KEYS
from depotline.sources.tables import Tables
from depotline.sources.versions import read_version, reserve_lines


def number_lines(t: Tables, first: dict[str, int] | None = None, names: tuple[str, ...] = tuple(LINE_KEYS)) -> Tables:
    """The tables with a key on every line: where it is missing, the numbers after the greatest key of
    the table, or from ``first`` on where that names the table."""
    return t.replace(**{n: _numbered(getattr(t, n), n, (first or {}).get(n)) for n in names})


def number_stored(spark: SparkSession, base: str, new: Tables) -> Tables:
    """New rows for a store of parts (``sources.versions``), whose line tables have keys, with keys that no
    other job takes."""
    names = tuple(read_version(spark, base).next_line)
    bare = {n: _bare(getattr(new, n), n) for n in names}
    first = reserve_lines(spark, base, {n: df.count() for n, df in bare.items()})
    return new.replace(**{n: _keyed(getattr(new, n), n).where(F.col(LINE_KEYS[n]).isNotNull()).unionByName(_placed_numbers(bare[n], n, first[n]))
                          for n in names})


def _keyed(lines: DataFrame, name: str) -> DataFrame:
    key = LINE_KEYS[name]
    return lines if key in lines.columns else lines.withColumn(key, F.lit(None).cast("long"))


def _bare(lines: DataFrame, name: str) -> DataFrame:
    """Lines without a key, written."""
    key = LINE_KEYS[name]
    return stage(_keyed(lines, name).where(F.col(key).isNull()).drop(key).sortWithinPartitions(BUCKET_KEYS[name]), "unnumbered")


def _placed_numbers(bare: DataFrame, name: str, first: int) -> DataFrame:
    """Written lines with their keys, from ``first`` on."""
    placed = bare.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    before = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)  # a row a file
    offsets = placed.groupBy("_file").agg(F.count(F.lit(1)).alias("_n")).select(
        "_file", (F.coalesce(F.sum("_n").over(before), F.lit(0)) + first).alias("_first"))
    return placed.join(offsets, "_file").select(*bare.columns, (F.col("_first") + F.col("_row")).cast("long").alias(LINE_KEYS[name]))


def _numbered(lines: DataFrame, name: str, first: int | None) -> DataFrame:
    key, lines = LINE_KEYS[name], _keyed(lines, name)
    bare = _bare(lines, name)
    if first is None:
        first = (lines.agg(F.max(key)).first()[0] or 0) + 1
    return lines.where(F.col(key).isNotNull()).unionByName(_placed_numbers(bare, name, first))
