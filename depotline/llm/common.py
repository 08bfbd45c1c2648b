"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(docs: DataFrame, text_col: str) -> Column:
    """The text as a string; null counts as empty."""
    return F.coalesce(docs[text_col].cast("string"), F.lit(""))


def id_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the id (as long) and the text, so that no other column's name can clash."""
    return docs.select(docs[id_col].cast("long").alias("doc_id"), text_of(docs, text_col).alias("text"))


def lower_ascii(c: Column) -> Column:
    """A-Z lower-cased, every other character as it is."""
    return F.translate(c, UPPER, LOWER)


#: Rows, and bytes of their largest columns, that are Python objects at a time.
SLICE, SLICE_BYTES = 512, 4 << 20


def release() -> None:
    """Memory that this worker holds but does not use goes back to the system: workers live on and
    serve later stages, whose memory it would take."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def slice_ends(columns: list[pa.Array]) -> Iterator[tuple[int, int]]:
    """Places from and to which rows are taken together: at most SLICE, and SLICE_BYTES where that
    is more than a row."""
    size = np.zeros(len(columns[0]) if columns else 0, np.int64)
    for c in columns:
        if pa.types.is_string(c.type) or pa.types.is_binary(c.type) or pa.types.is_large_string(c.type) or pa.types.is_large_binary(c.type):
            size += pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False)
    total, at = np.cumsum(size), 0
    while at < len(size):
        before = total[at - 1] if at else 0
        end = max(at + 1, min(at + SLICE, int(np.searchsorted(total, before + SLICE_BYTES, "right"))))
        yield at, end
        at = end


def map_slices(df: DataFrame, fn: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """``df.mapInPandas(fn, schema)`` in slices of bounded rows and bytes, so that a task holds few
    texts as Python strings whatever the size of its batches."""
    arrow = to_arrow_schema(T.StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frames = (b.slice(at, end - at).to_pandas(integer_object_nulls=True) for b in batches for at, end in slice_ends(b.columns))
        for out in fn(frames):
            yield pa.RecordBatch.from_pandas(out, schema=arrow, preserve_index=False)
        release()

    return df.mapInArrow(run, schema)


def text_slices(texts: pa.Array) -> Iterator[list[str]]:
    """The strings of an array, in slices of bounded rows and bytes."""
    for at, end in slice_ends([texts]):
        yield texts.slice(at, end - at).to_pylist()


#: A key is hot when it has more than one of so many rows; so there are fewer hot keys than this.
HOT_SHARE = 10_000
#: Parts that the rows of a hot key are dealt in.
SPREAD = 64


def spread_join(rows: DataFrame, table: DataFrame, key: str, by: str, hot: DataFrame) -> DataFrame:
    """``rows.join(table, key)`` where rows of the ``hot`` keys (a column ``key``, fewer than HOT_SHARE
    rows) are dealt in SPREAD parts by the hash of ``by``, and meet as many copies of their row in
    ``table``; so no task gets all rows of a hot key."""
    flag = F.broadcast(hot.select(key, F.lit(True).alias("_hot")))
    part = F.when(F.col("_hot"), F.pmod(F.xxhash64(by), F.lit(SPREAD)).cast("int")).otherwise(0)
    every = F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SPREAD - 1))).otherwise(F.array(F.lit(0))))
    dealt = rows.join(flag, key, "left").withColumn("_part", part).drop("_hot")
    copies = table.join(flag, key, "left").select("*", every.alias("_part")).drop("_hot")
    return dealt.join(copies, [key, "_part"]).drop("_part")
