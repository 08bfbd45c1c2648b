"""S2 constraint audit: primary keys, NOT NULL and the 23 foreign keys.

Spark does not enforce keys, so the audit counts violations instead:

* ``pk_duplicate``: (line keys are audited where the lines have them) rows whose key occurs more than once (group by key, count);
* ``pk_null`` / ``not_null``: rows with a NULL in a required column;
* ``fk_orphan``: rows with a non-NULL reference that has no parent row
  (``left_anti`` join; NULL references are allowed).

The result has one row per rule: ``(table_name, rule, column_name, violations)``.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depotline.schemas import FOREIGN_KEYS, LINE_KEYS, NOT_NULL, PRIMARY_KEYS
from depotline.sources.tables import Tables


def keys_of(keyed: set[str]) -> dict[str, tuple[str, ...]]:
    """The primary keys, of line tables where they are keyed: fifteen with all of them."""
    return PRIMARY_KEYS | {n: (k,) for n, k in LINE_KEYS.items() if n in keyed}


def _counts(table: str, df: DataFrame, counts: dict[tuple[str, str], Column]) -> DataFrame:
    """One aggregation of the table, one result row a rule."""
    rules = list(counts)
    one = df.agg(*(F.coalesce(counts[r].cast("long"), F.lit(0)).alias(f"c{i}") for i, r in enumerate(rules)))
    return one.select(F.explode(F.array(*(
        F.struct(F.lit(table).alias("table_name"), F.lit(rule).alias("rule"), F.lit(col).alias("column_name"), F.col(f"c{i}").alias("violations"))
        for i, (rule, col) in enumerate(rules)))).alias("r")).select("r.*")


def audit(t: Tables) -> DataFrame:
    """All NULL counts of a table come from one scan, and all repeated keys from one
    grouping; the references of all foreign keys to one parent are grouped together
    and meet the parent's keys once."""
    frames = t.as_dict()
    keys = keys_of({n for n, df in frames.items() if LINE_KEYS.get(n) in df.columns})
    parts: list[DataFrame] = []
    for table in dict.fromkeys([*keys, *NOT_NULL]):
        counts = {}
        if key := keys.get(table):
            any_null = functools.reduce(lambda a, b: a | b, [F.col(k).isNull() for k in key])
            counts["pk_null", ",".join(key)] = F.count_if(any_null)
        for c in NOT_NULL.get(table, ()):
            counts["not_null", c] = F.count_if(F.col(c).isNull())
        parts.append(_counts(table, frames[table], counts))
    for table, key in keys.items():
        times = frames[table].dropna(subset=list(key)).groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
        parts.append(_counts(table, times, {("pk_duplicate", ",".join(key)): F.sum(F.when(F.col("n") > 1, F.col("n")))}))
    for parent, pcol in dict.fromkeys((p, c) for _, _, p, c in FOREIGN_KEYS):
        # References are counted per child, column and value before they meet the parent: a value
        # used by a third of the rows collapses map-side.
        links = [(child, col) for child, col, p, c in FOREIGN_KEYS if (p, c) == (parent, pcol)]
        refs = functools.reduce(DataFrame.unionByName, (
            frames[child].where(F.col(col).isNotNull()).select(F.lit(i).alias("link"), F.col(col).alias("ref")) for i, (child, col) in enumerate(links)))
        orphans = (refs.groupBy("link", "ref").agg(F.count(F.lit(1)).alias("n"))
                   .join(frames[parent].select(F.col(pcol).alias("ref")), "ref", "left_anti"))
        one = orphans.agg(*(F.coalesce(F.sum(F.when(F.col("link") == i, F.col("n"))), F.lit(0)).cast("long").alias(f"c{i}") for i in range(len(links))))
        parts.append(one.select(F.explode(F.array(*(
            F.struct(F.lit(child).alias("table_name"), F.lit(f"fk_orphan:{parent}").alias("rule"), F.lit(col).alias("column_name"),
                     F.col(f"c{i}").alias("violations")) for i, (child, col) in enumerate(links)))).alias("r")).select("r.*"))
    return functools.reduce(DataFrame.unionByName, parts)
