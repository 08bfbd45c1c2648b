"""S3 soft-delete predicates and line arithmetic.

A flag column holds NULL for an active row and 1 for a deleted one.  Any other
value (0 included) is in neither list, so the predicates are ``IS NULL`` and
``= 1`` and never ``!= 1``.  Both push down to the Parquet scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_active(flag: str = "is_deleted") -> Column:
    return F.col(flag).isNull()


def is_deleted(flag: str = "is_deleted") -> Column:
    return F.col(flag) == 1


def active(df: DataFrame, flag: str = "is_deleted") -> DataFrame:
    return df.where(is_active(flag))


def deleted(df: DataFrame, flag: str = "is_deleted") -> DataFrame:
    return df.where(is_deleted(flag))


def state(df: DataFrame, which: str, flag: str = "is_deleted") -> DataFrame:
    """``which`` is "active" or "deleted"."""
    if which == "active":
        return active(df, flag)
    if which == "deleted":
        return deleted(df, flag)
    raise ValueError(f"state must be 'active' or 'deleted', not {which!r}")


def line_value(qty: str, price: str) -> Column:
    """quantity x price; decimal(10,2) x decimal(10,2) = decimal(21,4), exact."""
    return F.col(qty) * F.col(price)

