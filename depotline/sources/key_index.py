"""Which stored parts can hold a document id: so that a post reads a few parts, not a table, to refuse used
ids and unknown documents.

Every part of a header or payment table has an entry: least and greatest id, and a Bloom filter of its
ids.  Entries are kept by version (``sources.changes``): a new version adds those of its new parts and drops
those of parts that left.  An id is looked up among the parts of its own bucket, by range and filter.  What
passes by chance is read in vain, never believed: jobs join the ids of the parts found.

A filter has ten bits an id up to ``MOST_WORDS`` words; larger parts let more ids pass, and stay exact.
Payments are dealt by purchase, so their own ids are looked up by range alone.
"""

from __future__ import annotations

from functools import reduce
from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from depotline.schemas import PRIMARY_KEYS
from depotline.session import stage, staged_tables, unstage
from depotline.sources.changes import Change, bucket_key, carried, read_folders
from depotline.sources.layout import KIND_LINES
from depotline.sources.tables import Tables
from depotline.sources.versions import Version

ENTRY = "table_name string, bucket int, folder string, low long, high long, words array<long>"
TABLES = ("sale", "purchase", "transfer", "payment")
BITS_PER_KEY, HASHES, MOST_WORDS = 10, 5, 16_384
#: Ids of a batch that one task looks up among the parts of a bucket.
IDS_A_SHARE = 1_000_000


def _name(folder: str) -> str:
    """A part's name: write, month and bucket, without the store's place."""
    return "/".join(folder.rstrip("/").split("/")[-3:])


def _part_of(path: Column) -> Column:
    """``_name`` of a file's part.  By counting slashes, which costs little; a search costs more than the rest of a row."""
    return F.substring_index(F.substring_index(path, "/", -4), "/", 3)


def _bits(key: Column, words: Column) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(i)), words * 64) for i in range(HASHES)]


def _entries(spark: SparkSession, version: Version, table: str, folders: list[str]) -> DataFrame:
    key = PRIMARY_KEYS[table][0]
    rows = read_folders(spark, version, table, folders).select(F.col(key).alias("id"), _part_of(F.col("_metadata.file_path")).alias("folder")).where("id IS NOT NULL")
    ends = stage(rows.groupBy("folder").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count(F.lit(1)).alias("n")), "key-ends")
    most = ends.agg(F.max("n")).first()[0] or 0
    size = F.lit(max(1, min(MOST_WORDS, ceil(most * BITS_PER_KEY / 64)))).cast("long")
    bits = rows.select("folder", F.explode(F.array(*_bits(F.col("id"), size))).alias("bit"))
    some = bits.select("folder", F.floor(F.col("bit") / 64).alias("word"),
                       F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("bit", F.lit(64)).cast("int")).alias("value"))
    none = ends.select("folder", F.explode(F.sequence(F.lit(0).cast("long"), size - 1)).alias("word"), F.lit(0).cast("long").alias("value"))
    words = some.unionByName(none).groupBy("folder", "word").agg(F.bit_or("value").alias("value")).groupBy("folder").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("word", "value"))), lambda x: x["value"]).alias("words"))
    return ends.join(words, "folder").select(F.lit(table).alias("table_name"), F.regexp_extract("folder", r"=(\d+)$", 1).cast("int").alias("bucket"),
                                             "folder", "low", "high", "words")


def entries_of_version(spark: SparkSession, base: str, number: int | None = None) -> DataFrame:
    """The entries of all parts of a version; only parts that came since the last kept entries are read."""
    every = lambda version, table: [f for fs in version.parts.get(table, {}).values() for f in fs]

    def step(kept: DataFrame, change: Change) -> DataFrame:
        left = [(_name(f),) for table in TABLES for f in change.folders(table, "removed")]
        parts = [kept.join(spark.createDataFrame(left, "folder string"), "folder", "left_anti").select("table_name", "bucket", "folder", "low", "high", "words")]
        parts += [_entries(spark, change.new, table, came) for table in TABLES if (came := change.folders(table, "added"))]
        return reduce(DataFrame.unionByName, parts)

    with staged_tables():  # the result is written when ``carried`` returns
        return carried(spark, base, "keys", number, ENTRY,
                       lambda version: reduce(DataFrame.unionByName, (_entries(spark, version, t, every(version, t)) for t in TABLES)), step)


def parts_with(spark: SparkSession, base: str, version: Version, table: str, ids: DataFrame) -> list[str]:
    """Folders of the parts that can hold one of the ids (a column) of a table; at most its parts."""
    entries = entries_of_version(spark, base, version.number).where(F.col("table_name") == table)
    wanted = ids.select(ids[ids.columns[0]].cast("long").alias("id")).where("id IS NOT NULL").distinct()
    if bucket_key(table) == PRIMARY_KEYS[table][0]:
        low, high = entries.agg(F.min("low"), F.max("high")).first()
        if low is None:
            return []
        # new ids mostly lie beyond all parts; the others are looked up in shares, since a bucket's ids would be one task's
        within = stage(wanted.where(F.col("id").between(low, high)), "wanted-ids")
        shares = ceil(within.count() / IDS_A_SHARE) or 1
        wanted = within.withColumn("bucket", F.pmod(F.hash("id"), F.lit(version.buckets))).withColumn("share", F.pmod(F.xxhash64("id"), F.lit(shares)))
        entries = entries.withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shares - 1).cast("long"))))
        held = [F.getbit(F.get("words", F.floor(b / 64).cast("int")), F.pmod(b, F.lit(64))) == 1 for b in _bits(F.col("id"), F.size("words").cast("long"))]
        hit = wanted.join(entries, ["bucket", "share"]).where(F.col("id").between(F.col("low"), F.col("high")) & reduce(lambda a, b: a & b, held))
    else:
        within = None
        low, high = wanted.agg(F.min("id"), F.max("id")).first()
        hit = entries.where(F.lit(False)) if low is None else entries.where((F.col("low") <= high) & (F.col("high") >= low))
    names = {r[0] for r in hit.select("folder").distinct().collect()}
    unstage(within)
    return sorted(f for fs in version.parts.get(table, {}).values() for f in fs if _name(f) in names)


def for_posting(spark: SparkSession, base: str, version: Version, t: Tables, kind: str, ids: DataFrame) -> Tables:
    """``t`` for a job that posts new documents of a kind: of its header table only the parts that can hold
    one of the batch's ids, of its lines none, since a post changes none.  ``new_rows`` takes the result."""
    heads, lines = KIND_LINES[kind][:2]
    return t.replace(**{heads: read_folders(spark, version, heads, parts_with(spark, base, version, heads, ids)), lines: read_folders(spark, version, lines, [])})


def for_payments(spark: SparkSession, base: str, version: Version, t: Tables, payments: DataFrame) -> Tables:
    """``t`` for a job that posts payments: the parts that can hold one of their ids or of their purchases."""
    found = {n: parts_with(spark, base, version, n, payments.select(PRIMARY_KEYS[n][0])) for n in ("payment", "purchase")}
    return t.replace(**{n: read_folders(spark, version, n, folders) for n, folders in found.items()})


def new_rows(posted: Tables, kind: str, decisions: DataFrame) -> Tables:
    """The rows that a post added for its accepted documents: what is to be appended to the store."""
    heads, lines = KIND_LINES[kind][:2]
    key = PRIMARY_KEYS[heads][0]
    good = decisions.where("accepted").select(F.col("doc_id").alias(key))
    return posted.replace(**{n: getattr(posted, n).join(good, key, "left_semi") for n in (heads, lines)})
