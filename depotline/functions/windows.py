"""Running sums that stay parallel when one key holds a large share of the rows.

A plain ``sum().over(partitionBy(key).orderBy(...))`` sends every row of a key to
one task.  ``chunked_running_sum`` splits each key into order-preserving chunks
(any columns whose values are contiguous in the sort order, e.g. the date and a
bucket of the id within the date), runs the window per (key, chunk), aggregates one
total per chunk, prefix-sums those totals per key (a table with one row per chunk)
and adds that offset back with an equi-join on (key, chunk).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def chunked_running_sum(df: DataFrame, keys: list[str], chunk: list[str], order: list[Column | str],
                        values: dict[str, str]) -> DataFrame:
    """Add ``out`` = running sum of ``col`` (rows up to and including this one) for
    every ``out -> col`` in ``values``, over ``keys`` in ``order``.

    ``chunk`` columns must be non-decreasing along ``order`` within a key.  The
    input is shuffled once, by (keys, chunk); the chunk totals are the running
    sums at each chunk's last row, taken from rows that are already partitioned
    that way, so only the small chunk table moves again.
    """
    w_in = (Window.partitionBy(*keys, *chunk).orderBy(*order)
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    inner = df
    for out, col in values.items():
        inner = inner.withColumn(f"_in_{out}", F.sum(col).over(w_in))
    last = F.struct(*[F.col(o) if isinstance(o, str) else o for o in order])
    totals = inner.groupBy(*keys, *chunk).agg(
        *[F.max_by(f"_in_{out}", last).alias(f"_ct_{out}") for out in values])
    w_chunks = (Window.partitionBy(*keys).orderBy(*chunk)
                .rowsBetween(Window.unboundedPreceding, -1))
    on = [*keys, *chunk]
    offsets = totals.select(*[F.col(c).alias(f"_o_{c}") for c in on], *[
        F.coalesce(F.sum(f"_ct_{out}").over(w_chunks), F.lit(0)).alias(f"_off_{out}") for out in values])
    # Null-safe: a NULL date or key is a chunk like any other and must not drop out.
    cond = [F.col(c).eqNullSafe(F.col(f"_o_{c}")) for c in on]
    joined = inner.join(offsets, cond)
    for out in values:
        joined = joined.withColumn(out, F.col(f"_in_{out}") + F.col(f"_off_{out}"))
    return joined.drop(*[f"_in_{o}" for o in values], *[f"_off_{o}" for o in values],
                       *[f"_o_{c}" for c in on])

