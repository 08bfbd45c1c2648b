"""W3 admission: accept a batch of documents only where stock covers them.

Documents are taken in ``(doc_date, doc_id)`` order.  A document is accepted if
stock covers *all* of its lines after the demand of the documents accepted before
it, otherwise it is rejected whole and consumes nothing - the result of handling
the documents one at a time.  The batch form is exact and works on independent
parts side by side:

1. demand is summed per (document, location, product); lines of one product are
   checked together;
2. a key whose stock covers all of its demand decides nothing.  Its lines drop out,
   and documents without other lines are accepted;
   In a batch too large for one task, a document that asks of a key for more than its
   stock can ever be is rejected then; it takes nothing, and keys without it are looked at again;
3. documents that share no contested location are independent, so the rest falls
   into parts: locations, joined where a document has several.  A part of up to
   ``GROUP_LINES`` lines is decided one document after another in a task of its own,
   all parts at once;
4. larger parts go through rounds.  A running sum over each key (chunked, so a hot
   key spans many tasks) accepts every document that fits even if all open ones
   before it are accepted, and rejects every one that does not fit even if they are
   all rejected.  A round that leaves at most half of its lines open is followed by the next one.
   Else what stays open falls into connected components of documents and
   contested keys; those of up to ``GROUP_LINES`` lines are decided as in 3, all at
   once.  Of a component that is larger still, the earliest documents are decided so,
   as many as ``GROUP_LINES`` lines allow: nothing before them is open.

The number of rounds therefore does not depend on the number of independent parts,
only on the length of one part that the running sums cannot break up.  There is no
limit on rounds.  Each round's tables are written to fresh folders under
``spark.checkpoint.dir``, which cuts lineage, and removed when used up.
"""

from __future__ import annotations

from functools import reduce
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depotline.functions.components import connected_components
from depotline.functions.windows import chunked_running_sum
from depotline.session import stage, unstage

PLACE = ["location_type", "location_id"]
KEY = [*PLACE, "product_id"]
ORDER = ["doc_date", "doc_id"]
#: Lines that one task decides one document after another.
GROUP_LINES = 200_000


def _join_keys(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """``left`` joined with ``right`` on the stock key, where a NULL is a value like any other."""
    other = right.select(*(F.col(c).alias(f"_{c}") if c in KEY else F.col(c) for c in right.columns))
    on = reduce(lambda x, y: x & y, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in KEY))
    return left.join(other, on, how).drop(*(f"_{k}" for k in KEY))


def _one_by_one(lines: pd.DataFrame) -> pd.DataFrame:
    """Decisions of a part's documents in order; ``taken`` is the demand accepted outside of them before each line."""
    lines = lines.sort_values(ORDER, kind="stable", na_position="first")
    key = lines.groupby(KEY, sort=False, dropna=False).ngroup().tolist()
    doc, need = lines["doc_id"].to_numpy(), lines["qty"].tolist()
    free = (lines["avail"] - lines["taken"]).tolist()
    used: dict = {}
    starts = [0, *(np.flatnonzero(doc[1:] != doc[:-1]) + 1).tolist()]
    accepted = []
    for first, last in zip(starts, [*starts[1:], len(doc)], strict=True):
        own = range(first, last)
        fits = all(used.get(key[i], 0) + need[i] <= free[i] for i in own)
        if fits:
            for i in own:
                used[key[i]] = used.get(key[i], 0) + need[i]
        accepted.append(fits)
    return pd.DataFrame({"doc_id": doc[starts], "accepted": accepted})


def _side_by_side(lines: DataFrame) -> DataFrame:
    """doc_id, accepted of the documents of all parts (column ``part``), each part decided in its own group."""
    schema = lines.select("doc_id").withColumn("accepted", F.lit(True)).schema
    return lines.select("part", *ORDER, *KEY, "qty", "avail", "taken").groupBy("part").applyInPandas(_one_by_one, schema)


def _by_places(lines: DataFrame) -> DataFrame:
    """``lines`` with the part they belong to: their location, joined with those that one document binds to it."""
    bound = (lines.groupBy("doc_id").agg(F.min("place").alias("a"), F.max("place").alias("last"), F.collect_set("place").alias("places"))
             .where("a < last").select("a", F.explode("places").alias("b")).where("a <> b"))
    if bound.isEmpty():
        return lines.withColumnRenamed("place", "part")
    roots = connected_components(bound.distinct())  # at most an edge a pair of locations
    return lines.join(roots.select(F.col("v").alias("place"), "root"), "place", "left").select(
        *lines.columns, F.coalesce("root", "place").alias("part")).drop("place")


def _by_keys(lines: DataFrame) -> DataFrame:
    """``lines`` with the part they belong to: a component of documents and the keys they contest."""
    first = lines.groupBy(*KEY).agg(F.min("doc_id").alias("b"))
    roots = connected_components(_join_keys(lines.select("doc_id", *KEY), first).select(F.col("doc_id").alias("a"), "b").distinct())
    return lines.join(roots.select(F.col("v").alias("doc_id"), F.col("root").alias("part")), "doc_id")


def _packed(parts: DataFrame, size: DataFrame, group_lines: int) -> DataFrame:
    """Lines of the parts in ``size`` with parts dealt to bins, a bin a group: parts share no key, so their
    documents may be decided in one order, and a group for each of very many small parts would cost more."""
    total = size.agg(F.sum("lines")).first()[0] or 0
    bins = ceil(total / max(1, group_lines // 16)) or 1
    return parts.join(size, "part", "left_semi").withColumn("part", -1 - F.pmod(F.xxhash64("part"), F.lit(bins)))


def _earliest(lines: DataFrame, group_lines: int) -> DataFrame:
    """doc_id of the earliest documents of each part, with up to ``group_lines`` lines, and the first at least."""
    docs = lines.groupBy("part", *ORDER).agg(F.count("*").alias("lines"))
    docs = stage(docs.repartitionByRange("part", *ORDER).withColumn("chunk", F.spark_partition_id()), "admit-order")
    run = chunked_running_sum(docs, ["part"], ["chunk"], ORDER, {"run": "lines"})
    return run.where((F.col("run") <= group_lines) | (F.col("run") == F.col("lines"))).select("doc_id")


def _rounds(live: DataFrame, group_lines: int) -> list[DataFrame]:
    """doc_id, accepted, round of the documents of parts that are too large for one task."""
    kind = live.schema["qty"].dataType
    nothing = F.lit(0).cast(kind)
    live = live.repartitionByRange(*KEY, *ORDER).withColumn("chunk", F.spark_partition_id()).withColumn("fresh", F.lit(False))
    live = stage(live, "admit-large")
    decided: list[DataFrame] = []
    used_up: list[DataFrame] = [live]
    round_no = 1
    while True:
        round_no += 1
        amount = lambda fresh, sign: F.when(fresh, sign(F.col("qty"))).otherwise(nothing)
        more, less = (lambda q: F.greatest(q, nothing)), (lambda q: F.least(q, nothing))
        live = (live.withColumn("most", amount(~F.col("fresh"), more)).withColumn("least", amount(~F.col("fresh"), less))
                .withColumn("now", amount(F.col("fresh"), lambda q: q)))
        run = chunked_running_sum(live, KEY, ["chunk"], ORDER, {"run_most": "most", "run_least": "least", "run_now": "now"})
        taken = (F.col("taken") + F.col("run_now")).cast(kind)
        seen = stage(run.where(~F.col("fresh")).select(
            *ORDER, *KEY, "qty", "avail", "chunk", taken.alias("taken"),
            (taken + F.col("run_most") - F.col("most") + F.col("qty") <= F.col("avail")).alias("fits"),
            (taken + F.col("run_least") - F.col("least") + F.col("qty") > F.col("avail")).alias("over")), "admit-round")
        unstage(*used_up)
        by_doc = seen.groupBy("doc_id").agg(F.bool_and("fits").alias("fits"), F.bool_or("over").alias("over"), F.count("*").alias("lines"))
        sure = stage(by_doc.select("doc_id", F.when(F.col("over"), False).when(F.col("fits"), True).alias("accepted"), "lines"), "admit-sure")
        size = sure.agg(F.sum("lines").alias("all"), F.sum(F.when(F.col("accepted").isNull(), F.col("lines"))).alias("open")).first()
        open_lines = size["open"] or 0
        rest = None
        if open_lines and (open_lines <= group_lines or 2 * open_lines > size["all"]):
            rest = seen.join(sure.where("accepted IS NULL").select("doc_id"), "doc_id", "left_semi").drop("fits", "over")
            # a sure document counts for those after it, and sure ones stand between those that are open
            rest = stage(_with_taken(rest, seen, sure), "admit-open")
        written, sure = sure, sure.drop("lines")
        found = sure.where("accepted IS NOT NULL")
        if open_lines and open_lines <= group_lines:
            found = found.unionByName(_side_by_side(rest.withColumn("part", F.lit(0))))
        elif rest is not None:
            parts = stage(_by_keys(rest), "admit-parts")
            size = parts.groupBy("part").agg(F.count("*").alias("lines"))
            small = _packed(parts, size.where(F.col("lines") <= group_lines), group_lines)
            large = parts.join(size.where(F.col("lines") > group_lines), "part", "left_semi")
            early = large.join(_earliest(large, group_lines), "doc_id", "left_semi")
            found = found.unionByName(_side_by_side(small.unionByName(early)))
        found = stage(found, "admit-found")
        decided.append(found.withColumn("round", F.lit(round_no)))
        still = seen.join(found, "doc_id", "left_anti")
        if open_lines <= group_lines or still.isEmpty():
            unstage(seen, written, rest)
            return decided
        new = _join_keys(seen.join(found.where("accepted").select("doc_id"), "doc_id", "left_semi"), still.select(*KEY).distinct(), "left_semi")
        live = stage(still.withColumn("fresh", F.lit(False)).unionByName(new.withColumn("fresh", F.lit(True))).drop("fits", "over"), "admit-live")
        unstage(seen, written, rest)
        used_up = [live]


def _without_hopeless(live: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lines, rejected): documents that ask of a key for more than the batch can ever leave them (``most``)
    are rejected, and the lines of the others that are still contested stay."""
    rejected = stage(live.where(F.col("qty") > F.col("most")).select("doc_id").distinct(), "admit-hopeless")
    live = stage(live.join(rejected, "doc_id", "left_anti"), "admit-hopeful")
    need = live.groupBy(*KEY).agg(F.sum(F.greatest(F.col("qty"), F.lit(0))).alias("all"), F.first("avail").alias("avail"))
    return stage(_join_keys(live, need.where(F.col("all") > F.col("avail")).select(*KEY), "left_semi"), "admit-contested"), rejected


def _with_taken(rest: DataFrame, seen: DataFrame, sure: DataFrame) -> DataFrame:
    """Open lines whose ``taken`` includes the documents of this round that are sure to be accepted before them."""
    kind = seen.schema["qty"].dataType
    new = seen.join(sure.where("accepted").select("doc_id"), "doc_id", "left_semi").drop("fits", "over")
    new = _join_keys(new, rest.select(*KEY).distinct(), "left_semi")
    both = (rest.withColumn("open", F.lit(True)).withColumn("now", F.lit(0).cast(kind))
            .unionByName(new.withColumn("open", F.lit(False)).withColumn("now", F.col("qty"))))
    run = chunked_running_sum(both, KEY, ["chunk"], ORDER, {"run_now": "now"})
    return run.where("open").withColumn("taken", (F.col("taken") + F.col("run_now")).cast(kind)).select(rest.columns)


def admit(demand: DataFrame, stock: DataFrame, docs: DataFrame | None = None, *,
          missing_rejects: bool = False, group_lines: int | None = None) -> DataFrame:
    """Decide every document of the batch.

    ``demand``: doc_id, doc_date, location_type, location_id, product_id, qty.
    ``stock``: location_type, location_id, product_id, quantity (a missing row is
    0, or a rejection when ``missing_rejects``).
    ``docs``: doc_id list of the whole batch, for batches with documents without
    demand, which are accepted.  Returns doc_id, accepted, reason, round (0: nothing
    contested).
    """
    group_lines = group_lines or GROUP_LINES
    nothing = F.lit(0)
    need = demand.groupBy(*KEY).agg(F.sum(F.greatest(F.col("qty"), nothing)).alias("all"), F.sum(F.least(F.col("qty"), nothing)).alias("back"))
    keys = need.join(stock.select(*KEY, F.col("quantity").alias("avail")), KEY, "left").select(
        *KEY, "all", F.coalesce("avail", nothing).alias("avail"), F.col("avail").isNull().alias("missing"), "back")
    keys = keys.withColumn("most", F.col("avail") - F.col("back")).drop("back")
    decisive = F.col("all") > F.col("avail")
    keys = stage(keys.where(decisive | F.col("missing") if missing_rejects else decisive), "admit-keys")
    lines = (_join_keys(demand, keys.drop("all")).groupBy("doc_id", "doc_date", *KEY)
             .agg(F.sum("qty").alias("qty"), F.first("avail").alias("avail"), F.first("missing").alias("missing"), F.first("most").alias("most")))
    lines = stage(lines.withColumn("place", F.xxhash64(*PLACE)), "admit-contested")
    gone = lines.where("missing").select("doc_id").distinct() if missing_rejects else None
    live = lines.join(gone, "doc_id", "left_anti") if missing_rejects else lines
    hopeless = None
    if lines.count() > group_lines:
        live, hopeless = _without_hopeless(live)
    live = _by_places(live.drop("missing", "most").withColumn("taken", nothing.cast(lines.schema["qty"].dataType)))
    large = live.groupBy("part").agg(F.count("*").alias("lines")).where(F.col("lines") > group_lines).select("part")
    if large.isEmpty():
        decided = [stage(_side_by_side(live), "admit-found").withColumn("round", F.lit(1))]
    else:
        large = stage(large, "admit-large-parts")
        decided = [stage(_side_by_side(live.join(large, "part", "left_anti")), "admit-found").withColumn("round", F.lit(1)),
                   *_rounds(live.join(large, "part", "left_semi").drop("part"), group_lines)]
        unstage(large)
    if hopeless is not None:
        decided.append(hopeless.select("doc_id", F.lit(False).alias("accepted"), F.lit(0).alias("round")))
    found = reduce(DataFrame.unionByName, decided).withColumn("reason", F.when(~F.col("accepted"), F.lit("insufficient_stock")))
    if missing_rejects:
        found = found.unionByName(stage(gone, "admit-missing").select(
            "doc_id", F.lit(False).alias("accepted"), F.lit(0).alias("round"), F.lit("missing_stock_row").alias("reason")))
    unstage(keys, lines)
    batch = (demand if docs is None else docs).select("doc_id").distinct()
    return batch.join(found, "doc_id", "left").select(
        "doc_id", F.coalesce("accepted", F.lit(True)).alias("accepted"), "reason", F.coalesce("round", F.lit(0)).alias("round"))
