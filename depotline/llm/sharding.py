"""Sharding by best-fit-decreasing bin packing.

Documents of equal text form a group, which goes into one shard.  Groups are taken by falling size;
each enters the shard with the least room left that still holds it, found in a balanced search tree.
For a given number of shards the capacity is the smallest for which the packing needs no more shards.

What is packed is the histogram of sizes, not the groups: sizes are rounded up to ``DIGITS`` leading
binary digits, so there are at most 2^DIGITS and half as many more for each further binary digit of
the largest size, whatever the number of documents.  All groups of one rounded size are alike; while
they fit, they fill the tightest shard one after the other, so a run of them is placed in one step.
The plan says how many groups of each size go into each shard, in order.  Groups are numbered within
their size, chunk by chunk, and look up their shard; documents look up their group's.

A group larger than an even share of all bytes cannot be placed whole with even shards; it is cut into
the fewest equal pieces that hold at most an even share, and the pieces are packed like groups.

Defined results: a null text is a text without bytes, of the same group as the empty text; rows with
null or repeated ids are placed like others; other columns play no part; an empty table gives an
empty table.
"""

from __future__ import annotations

from math import ceil
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depotline.llm.common import HOT_SHARE, spread_join, text_of
from depotline.session import stage, unstage

#: Bytes that a row counts for beside its text.
ROW_BYTES = 16
DIGITS = 11
#: Rows that are numbered in one piece.
CHUNK_ROWS = 4096


# ---------------------------------------------------------------------------------- balanced tree
class _Node:
    __slots__ = ("key", "left", "level", "right")

    def __init__(self, key: tuple[int, int]):
        self.key, self.left, self.right, self.level = key, None, None, 1


def _level(node: _Node | None) -> int:
    return node.level if node else 0


def _skew(t: _Node) -> _Node:
    if t.left and t.left.level == t.level:
        other = t.left
        t.left, other.right = other.right, t
        return other
    return t


def _split(t: _Node) -> _Node:
    if t.right and t.right.right and t.right.right.level == t.level:
        other = t.right
        t.right, other.left = other.left, t
        other.level += 1
        return other
    return t


def insert(t: _Node | None, key: tuple[int, int]) -> _Node:
    if t is None:
        return _Node(key)
    if key < t.key:
        t.left = insert(t.left, key)
    else:
        t.right = insert(t.right, key)
    return _split(_skew(t))


def remove(t: _Node | None, key: tuple[int, int]) -> _Node | None:
    if t is None:
        return None
    if key < t.key:
        t.left = remove(t.left, key)
    elif key > t.key:
        t.right = remove(t.right, key)
    elif t.left is None or t.right is None:
        return t.left or t.right
    else:
        after = t.right
        while after.left:
            after = after.left
        t.key = after.key
        t.right = remove(t.right, after.key)
    # levels fall where a child is too low, then the row is put right
    low = min(_level(t.left), _level(t.right)) + 1
    if low < t.level:
        t.level = low
        if t.right and t.right.level > low:
            t.right.level = low
    t = _skew(t)
    if t.right:
        t.right = _skew(t.right)
        if t.right.right:
            t.right.right = _skew(t.right.right)
    t = _split(t)
    if t.right:
        t.right = _split(t.right)
    return t


def tightest(t: _Node | None, size: int) -> tuple[int, int] | None:
    """The smallest key whose first part is at least ``size``."""
    found = None
    while t:
        if t.key[0] >= size:
            found, t = t.key, t.left
        else:
            t = t.right
    return found


# ---------------------------------------------------------------------------------------- packing
class Run(NamedTuple):
    """Groups of one rounded size, numbers ``first`` to ``first + count - 1``, go into ``shard``."""

    size: int
    first: int
    count: int
    shard: int


def best_fit(histogram: list[tuple[int, int]], capacity: int, most: int | None = None) -> list[Run] | None:
    """Best-fit-decreasing placement of (size, number of groups); None if it needs over ``most``
    shards.  Every size must be at most the capacity."""
    tree, shards, plan = None, 0, []
    for size, number in sorted(histogram, reverse=True):
        first = 0
        while first < number:
            fit = tightest(tree, size)
            if fit is None:
                if shards == most:
                    return None
                fit, shards = (capacity, shards), shards + 1
            else:
                tree = remove(tree, fit)
            room, shard = fit
            count = min(number - first, room // size)
            plan.append(Run(size, first, count, shard))
            first += count
            tree = insert(tree, (room - count * size, shard))
    return plan


def even_plan(histogram: list[tuple[int, int]], shards: int) -> list[Run]:
    """Best fit at the smallest capacity that gives at most ``shards`` shards."""
    if not histogram:
        return []
    total, largest = sum(s * n for s, n in histogram), max(s for s, _ in histogram)
    low, high = max(ceil(total / shards), largest), max(ceil(2 * total / shards), largest) + largest
    while low < high:
        middle = (low + high) // 2
        if best_fit(histogram, middle, shards) is None:
            low = middle + 1
        else:
            high = middle
    return best_fit(histogram, low, shards)


def rounded(size):
    """The size column rounded up to DIGITS leading binary digits."""
    digits = F.length(F.bin(size))
    step = F.call_function("shiftleft", F.lit(1).cast("long"), F.greatest(digits - DIGITS, F.lit(0)))
    return F.floor((size + step - 1) / step) * step


# ----------------------------------------------------------------------------------- numbering
def _offsets(rows: DataFrame, within: str, chunk: str) -> DataFrame:
    """Rows before each chunk of its part, from the number of rows by part and chunk."""
    counts = rows.groupBy(within, chunk).agg(F.count("*").alias("rows"))
    return counts.selectExpr(within, chunk, f"sum(rows) OVER (PARTITION BY {within} ORDER BY {chunk}) - rows AS before")


def numbered(rows: DataFrame, within: str, order: str, name: str) -> DataFrame:
    """``rows`` with their number from 0 within each value of ``within``.  The number of a row is that
    of its chunk's first row and its place in the chunk; a chunk is a hash range of about CHUNK_ROWS
    rows, so no value of ``within`` meets in one task."""
    chunks = max(1, ceil(rows.count() / CHUNK_ROWS))
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64(order), F.lit(chunks)))
    # dealt by both columns, also where ``rows`` are dealt by ``within`` alone already
    placed = rows.repartition(within, "chunk").selectExpr("*", f"row_number() OVER (PARTITION BY {within}, chunk ORDER BY {order}) - 1 AS place")
    out = placed.join(_offsets(rows, within, "chunk"), [within, "chunk"])
    return out.withColumn(name, F.col("before") + F.col("place")).drop("chunk", "place", "before")


# ------------------------------------------------------------------------------------------- whole
def shard(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, size, text_crc32, shard, slot (number from 0 in the shard) and
    group_key (SHA-256 of the text)."""
    spark = docs.sparkSession
    text = text_of(docs, text_col)
    rows = stage(docs.select(docs[id_col].cast("long").alias("doc_id"), (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
                             F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("group_key"))
                 .withColumn("rid", F.monotonically_increasing_id()), "shard-rows")
    groups = rows.groupBy("group_key").agg(F.count("*").alias("copies"), F.first("size").alias("size"))
    total = rows.agg(F.sum("size")).first()[0] or 0
    # pieces of a group: the fewest of equal numbers of copies that hold at most an even share
    share = max(1, total // shards)
    most = F.greatest(F.floor(F.lit(share) / F.col("size")), F.lit(1))
    groups = groups.withColumn("pieces", F.ceil(F.col("copies") / most).cast("long"))
    pieces = groups.select("group_key", "size", "copies", "pieces", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)).alias("piece"))
    held = F.floor(F.col("copies") / F.col("pieces")) + F.when(F.col("piece") < F.col("copies") % F.col("pieces"), 1).otherwise(0)
    pieces = pieces.withColumn("class", rounded(F.col("size") * held)).withColumn(
        "pid", F.xxhash64("group_key", "piece")).select("group_key", "pieces", "piece", "class", "pid")
    pieces = stage(pieces, "shard-pieces")
    histogram = [(r["class"], r["count"]) for r in pieces.groupBy("class").count().collect()]  # bounded by DIGITS
    plan = spark.createDataFrame([tuple(r) for r in even_plan(histogram, shards)], "class long, first long, number long, shard int")
    order = numbered(pieces, "class", "pid", "rank")
    # a class's runs follow each other: the last that starts at or before the rank holds it
    runs = plan.groupBy("class").agg(F.array_sort(F.collect_list(F.struct("first", "shard"))).alias("runs"))
    at = F.element_at(F.filter("runs", lambda r: r["first"] <= F.col("rank")), -1)["shard"]
    placed = stage(order.join(runs, "class").select("group_key", "pieces", "piece", at.alias("shard")), "shard-plan")
    whole = placed.where("pieces = 1").select("group_key", "shard")
    cut = placed.where("pieces > 1")
    hot = groups.where(F.col("copies") > rows.count() / HOT_SHARE).select("group_key")
    found = spread_join(rows, whole, "group_key", "rid", hot)
    if not cut.isEmpty():
        # every cut group is larger than an even share, so there are fewer than there are shards
        parts = cut.groupBy("group_key").agg(F.first("pieces").alias("pieces"), F.array_sort(F.collect_list(F.struct("piece", "shard"))).alias("list"))
        # number the copies of cut groups in even turns: the n-th copy goes to piece n modulo pieces
        copies = numbered(rows.join(F.broadcast(parts.select("group_key")), "group_key", "left_semi"), "group_key", "rid", "copy")
        dealt = copies.join(F.broadcast(parts), "group_key").withColumn(
            "shard", F.get("list", F.pmod("copy", F.col("pieces")).cast("int"))["shard"])
        found = found.select(*rows.columns, "shard").unionByName(dealt.select(*rows.columns, "shard"))
    found = stage(found, "shard-rows")
    unstage(rows, pieces, placed)
    return numbered(found, "shard", "rid", "slot").select("doc_id", "size", "text_crc32", F.col("shard").cast("int").alias("shard"),
                                                         F.col("slot").cast("long").alias("slot"), "group_key")
