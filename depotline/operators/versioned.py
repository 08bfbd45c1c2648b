"""S2 and X1 on stored versions: the audit and the rebuilt stock of a version are made from those of an
earlier one and from the parts that differ.

``reconcile_version``: documents of the touched places are taken out as they were and put in as they are,
which folds into the balances kept for the earlier version.  Exact while document ids are unique (S2).

``audit_version``: every rule counts rows, so its count changes by what came and left.

* NULL counts: rows of added folders less rows of removed ones.
* Repeated keys: only keys that stand in an added or removed folder can have changed; their other rows are
  looked for in the buckets that can hold them, or, where a table is not dealt by that key, between the
  least and greatest of these keys, which Parquet's statistics turn into skipped row groups.
* References: changed references meet the parent's keys, again between their least and greatest.
  Unchanged rows are read only if a parent key left, or if one came and the rule had orphans before.

A table that did not change is not read but for its keys, where a changed row refers to them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from depotline.operators import quality, stock
from depotline.schemas import FOREIGN_KEYS, NOT_NULL
from depotline.session import stage, staged_tables
from depotline.sources.changes import DOCUMENTS, Change, bucket_key, carried, read_folders, tables_at
from depotline.sources.layout import plain_columns
from depotline.sources.tables import Tables
from depotline.sources.versions import Version, open_version, read_version

AUDIT = "table_name string, rule string, column_name string, violations long"


def _whole(spark: SparkSession, base: str, version: Version) -> Tables:
    """All tables of a version, documents side by side in their buckets."""
    return plain_columns(open_version(spark, base, version.number)[1])


# ------------------------------------------------------------------------------------------ X1
def balances_of_version(spark: SparkSession, base: str, number: int | None = None) -> DataFrame:
    """Balances (``stock.balances``) of a version's documents."""
    def step(kept: DataFrame, change: Change) -> DataFrame:
        places = {n: change.document_places(*names) for names in DOCUMENTS.values() for n in names}
        return stock.fold(kept, tables_at(spark, change.old, places), tables_at(spark, change.new, places))

    return carried(spark, base, "balances", number, stock.BALANCE,
                   lambda version: stock.balances(_whole(spark, base, version)), step)


def reconcile_version(spark: SparkSession, base: str, number: int | None = None) -> DataFrame:
    """X1 of a version, equal to ``stock.reconcile`` of its tables."""
    version = read_version(spark, base, number)
    kept = balances_of_version(spark, base, version.number)
    snapshot = tables_at(spark, version, {n: {None} for n in ("warehouse_stock", "branch_stock")})
    return stock.against(snapshot, stock.rebuilt_of(kept))


# ------------------------------------------------------------------------------------------ S2
def audit_version(spark: SparkSession, base: str, number: int | None = None) -> DataFrame:
    """S2 of a version, equal to ``quality.audit`` of its tables."""
    with staged_tables():  # the result is written when ``carried`` returns
        return carried(spark, base, "audit", number, AUDIT, lambda version: quality.audit(_whole(spark, base, version)),
                       lambda kept, change: _audit_step(spark, kept, change))


def _audit_step(spark: SparkSession, kept: DataFrame, change: Change) -> DataFrame:
    before = {(r.table_name, r.rule, r.column_name): r.violations for r in kept.collect()}  # a row a rule
    parts = [kept]
    keys = quality.keys_of(set(change.new.next_line))
    for table in dict.fromkeys([*keys, *NOT_NULL]):
        if change.touches(table):
            parts.append(_null_change(spark, change, table, keys.get(table)))
            if table in keys:
                parts.append(_repeat_change(spark, change, table, list(keys[table])))
    moved = {}  # keys that came and left, by parent
    for child, col, parent, pcol in FOREIGN_KEYS:
        if change.touches(parent) and parent not in moved:
            moved[parent] = stage(_moved_keys(spark, change, parent, pcol), "audit-moved")
        orphans = before.get((child, f"fk_orphan:{parent}", col), 0)
        if change.touches(child):
            parts.append(_changed_refs(spark, change, child, col, parent, pcol))
        if parent in moved:
            wanted = moved[parent].where("gone OR came") if orphans else moved[parent].where("gone")
            if not wanted.isEmpty():
                parts.append(_changed_parents(spark, change, child, col, parent, pcol, wanted))
    rows = reduce(DataFrame.unionByName, parts)
    return rows.groupBy("table_name", "rule", "column_name").agg(F.sum("violations").alias("violations"))


def _rule(table: str, rule: str, column: str, violations: Column) -> list[Column]:
    return [F.lit(table).alias("table_name"), F.lit(rule).alias("rule"), F.lit(column).alias("column_name"),
            F.coalesce(violations.cast("long"), F.lit(0)).alias("violations")]


def _came_and_left(spark: SparkSession, change: Change, table: str) -> DataFrame:
    """Rows of the folders that differ, with the column ``sign``: 1 came, -1 left."""
    side = lambda s, sign: read_folders(spark, change.new, table, change.folders(table, s)).withColumn("sign", F.lit(sign))
    return side("added", 1).unionByName(side("removed", -1))


def _null_change(spark: SparkSession, change: Change, table: str, key: tuple[str, ...] | None) -> DataFrame:
    rules = {("not_null", c): F.col(c).isNull() for c in NOT_NULL.get(table, ())}
    if key:
        rules["pk_null", ",".join(key)] = reduce(lambda a, b: a | b, (F.col(k).isNull() for k in key))
    one = _came_and_left(spark, change, table).agg(*(F.sum(F.when(c, F.col("sign"))).alias(f"c{i}") for i, c in enumerate(rules.values())))
    return one.select(F.explode(F.array(*(F.struct(*_rule(table, *name, F.col(f"c{i}"))) for i, name in enumerate(rules)))).alias("r")).select("r.*")


def _buckets(change: Change, table: str, key: str) -> set[int] | None:
    """Buckets in which keys of the changed rows can stand, if the table is dealt by this key."""
    return {p[1] for p in change.places(table)} if bucket_key(table) == key else None


def _between(rows: DataFrame, col: str, keys: DataFrame, key: str) -> DataFrame:
    """``rows`` from the least to the greatest of the keys, as a literal range that reaches the scan."""
    low, high = keys.agg(F.min(key), F.max(key)).first()
    return rows.where(F.lit(False)) if low is None else rows.where(F.col(col).between(low, high))


def _repeat_change(spark: SparkSession, change: Change, table: str, key: list[str]) -> DataFrame:
    changed = _came_and_left(spark, change, table).dropna(subset=key).groupBy(*key).agg(
        F.count_if(F.col("sign") == 1).alias("came"), F.count_if(F.col("sign") == -1).alias("left"))
    changed = stage(changed.where("came <> left"), "audit-keys")
    stood = read_folders(spark, change.new, table, change.folders(table, "common", _buckets(change, table, key[0]) if len(key) == 1 else None))
    stood = _between(stood.select(*key), key[0], changed, key[0]).join(changed, key, "left_semi")
    n = stood.select(*key, F.lit(0).alias("came"), F.lit(0).alias("left"), F.lit(1).alias("stood")).unionByName(
        changed.withColumn("stood", F.lit(0))).groupBy(*key).agg(*(F.sum(c).alias(c) for c in ("came", "left", "stood")))
    after, before = F.col("stood") + F.col("came"), F.col("stood") + F.col("left")
    repeated = lambda c: F.when(c > 1, c).otherwise(0)
    return n.agg(F.sum(repeated(after) - repeated(before)).alias("n")).select(*_rule(table, "pk_duplicate", ",".join(key), F.col("n")))


def _changed_refs(spark: SparkSession, change: Change, child: str, col: str, parent: str, pcol: str) -> DataFrame:
    """References that came, less those that left, of which the new version has no parent; rows that were
    only rewritten cancel out."""
    net = _came_and_left(spark, change, child).where(F.col(col).isNotNull()).groupBy(F.col(col).alias("ref")).agg(F.sum("sign").alias("n"))
    net = stage(net.where("n <> 0"), "audit-refs")
    within = _buckets(change, child, col) if bucket_key(parent) == pcol else None
    folders = change.folders(parent, "common", within) + change.folders(parent, "added", within)
    keys = _between(read_folders(spark, change.new, parent, folders).select(F.col(pcol).alias("ref")), "ref", net, "ref")
    return net.join(keys, "ref", "left_anti").agg(F.sum("n").alias("n")).select(*_rule(child, f"fk_orphan:{parent}", col, F.col("n")))


def _changed_parents(spark: SparkSession, change: Change, child: str, col: str, parent: str, pcol: str, moved: DataFrame) -> DataFrame:
    """The old version's references to keys that are gone, less those to keys that came."""
    within = _buckets(change, parent, pcol) if bucket_key(child) == col else None
    folders = change.folders(child, "common", within) + change.folders(child, "removed", within)
    refs = _between(read_folders(spark, change.new, child, folders).select(F.col(col).alias("ref")), "ref", moved, "ref")
    counted = refs.groupBy("ref").agg(F.count(F.lit(1)).alias("n")).join(moved, "ref")
    return counted.agg(F.sum(F.when(F.col("gone"), F.col("n")).otherwise(-F.col("n"))).alias("n")).select(
        *_rule(child, f"fk_orphan:{parent}", col, F.col("n")))


def _moved_keys(spark: SparkSession, change: Change, parent: str, pcol: str) -> DataFrame:
    """Keys (ref) that no row of the new version has any more (gone), or that none of the old one had (came)."""
    rows = _came_and_left(spark, change, parent).where(F.col(pcol).isNotNull())
    ends = rows.groupBy(F.col(pcol).alias("ref")).agg(F.bool_or(F.col("sign") == 1).alias("after"), F.bool_or(F.col("sign") == -1).alias("before"))
    moved = ends.where("after <> before").select("ref", F.col("before").alias("gone"), F.col("after").alias("came"))
    common = change.folders(parent, "common", _buckets(change, parent, pcol))
    if not common:
        return moved
    stood = _between(read_folders(spark, change.new, parent, common).select(F.col(pcol).alias("ref")), "ref", moved, "ref")
    return moved.join(stood, "ref", "left_anti")
