"""Optional, inclusive date ranges (rules K4, K5).

Either end may be absent; an empty string means "no bound".  Once a bound is set,
rows with a NULL date drop out.  The filter is only built for bounds that are set,
so an unset range adds nothing to the plan and a set one is a plain pushed filter.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DateLike = _dt.date | str | None


def _bound(value: DateLike) -> _dt.date | None:
    if value is None:
        return None
    if isinstance(value, _dt.datetime):
        return value.date()
    if isinstance(value, _dt.date):
        return value
    text = str(value).strip()
    if not text:
        return None
    return _dt.date.fromisoformat(text)


def date_range_condition(col: str, start: DateLike = None, end: DateLike = None) -> Column | None:
    lo, hi = _bound(start), _bound(end)
    cond = None
    if lo is not None:
        cond = F.col(col) >= F.lit(lo)
    if hi is not None:
        upper = F.col(col) <= F.lit(hi)
        cond = upper if cond is None else cond & upper
    return cond


def in_date_range(df: DataFrame, col: str, start: DateLike = None, end: DateLike = None) -> DataFrame:
    cond = date_range_condition(col, start, end)
    return df if cond is None else df.where(cond)


#: Partition column of tables stored by document month (sources.layout); text "yyyy-MM".
MONTH = "doc_month"


def in_document_months(df: DataFrame, start: DateLike = None, end: DateLike = None) -> DataFrame:
    """Only the month partitions that a date range touches, where ``df`` is stored by
    document month.  Lines carry the month of their document, so a range prunes
    them like their headers; the exact dates are still compared on the headers."""
    if MONTH not in df.columns:
        return df
    lo, hi = _bound(start), _bound(end)
    if lo is not None:
        df = df.where(F.col(MONTH) >= lo.strftime("%Y-%m"))
    if hi is not None:
        df = df.where(F.col(MONTH) <= hi.strftime("%Y-%m"))
    return df
