"""URL filter by a cascade of Bloom filters, in DataFrame functions only.

The cascade answers exactly, over a known universe of keys, whether a key is listed.  Level 0 encodes
the listed keys.  The unlisted keys of the universe that pass it by chance are encoded in level 1,
the listed keys that pass level 1 in level 2, and so on until none passes.  A key is looked up level
by level; the first level that it fails, or the last that it passes, decides.

Keys are dealt by hash to shards of a fixed mean size, and each shard has its own small cascade: an
array of 64-bit words a level.  A lookup joins a row to its shard's words, never to keys, so no
filter grows with the corpus, and Spark broadcasts the shards' table only where it is small.

Defined results: a null url, or one without ``://``, has empty host and path, fits no rule, is never
listed and is allowed; repeated rows each give their row; null page ids are passed on; other columns
play no part; an empty table gives an empty table.
"""

from __future__ import annotations

from functools import reduce
from math import ceil
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from depotline.llm.common import lower_ascii
from depotline.session import stage, unstage

KEYS_PER_SHARD = 256
BITS_PER_KEY = 12
HASHES = 4


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def parse(url: Column) -> tuple[Column, Column]:
    """Host (after the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z lower-cased) and path
    (from there up to ``?``, ``#`` or the end)."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    path = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return F.coalesce(lower_ascii(host), F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(rules: list[Rule], host: Column, path: Column, value) -> Column:
    """``value(rule)`` of the longest rule that fits, else null.  Of equally long rules the one with
    the longer host wins, then the one that blocks."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), len(r.host), r.verdict == "block")):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.lit(value(r))).otherwise(out)
    return out


# ------------------------------------------------------------------------------------------ cascade
class Cascade(NamedTuple):
    """``words`` has a row a shard: shard and the arrays w0, w1 and so on, ``sizes`` their lengths."""

    words: DataFrame
    sizes: list[int]
    shards: int


def _hashes(key: Column) -> list[Column]:
    return [F.xxhash64(key).alias("h"), F.xxhash64(F.lit("second"), key).alias("g")]


def _bits(level: int, size: int) -> list[Column]:
    """Places of a key's bits in a level of ``size`` words."""
    return [F.pmod(F.xxhash64(F.col("h"), F.col("g"), F.lit(level), F.lit(i)), F.lit(64 * size)) for i in range(HASHES)]


def _passes(level: int, size: int) -> Column:
    """Whether all bits of the row's key are set in the array of the level."""
    tests = [F.getbit(F.get(F.col(f"w{level}"), F.floor(b / 64).cast("int")), F.pmod(b, F.lit(64))) == 1 for b in _bits(level, size)]
    return reduce(lambda a, b: a & b, tests)


def _encode(spark: SparkSession, keys: DataFrame, level: int, shards: int) -> tuple[DataFrame, int]:
    """Words of the level that encodes the keys, and their number a shard."""
    most = keys.groupBy("shard").count().agg(F.max("count")).first()[0] or 0
    size = max(1, ceil(most * BITS_PER_KEY / 64))
    bits = keys.select("shard", F.explode(F.array(*_bits(level, size))).alias("bit"))
    set_words = bits.select("shard", F.floor(F.col("bit") / 64).alias("word"),
                            F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("bit", F.lit(64)).cast("int")).alias("bits"))
    no_bits = spark.range(shards * size).select(F.floor(F.col("id") / size).alias("shard"), F.pmod("id", F.lit(size)).alias("word"),
                                               F.lit(0).cast("long").alias("bits"))
    words = set_words.unionByName(no_bits).groupBy("shard", "word").agg(F.bit_or("bits").alias("bits"))
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("word", "bits"))), lambda x: x["bits"])
    return words.groupBy("shard").agg(in_order.alias(f"w{level}")), size


def build(universe: DataFrame) -> Cascade:
    """The cascade over ``universe``: distinct keys (key string) with the flag ``listed``."""
    spark = universe.sparkSession
    hashed = stage(universe.select(*_hashes(F.col("key")), "listed"), "cascade-keys")
    shards = max(1, ceil(hashed.count() / KEYS_PER_SHARD))
    keys = hashed.withColumn("shard", F.pmod("h", F.lit(shards)))
    members, others = keys.where("listed").drop("listed"), keys.where(~F.col("listed")).drop("listed")
    levels, sizes, old = [], [], []
    while True:
        level = len(levels)
        words, size = _encode(spark, members, level, shards)
        words = stage(words, f"cascade-{level}")
        levels.append(words)
        sizes.append(size)
        chance = stage(others.join(words, "shard").where(_passes(level, size)).select(*others.columns), "cascade-chance")
        if chance.isEmpty():
            unstage(chance, *old, hashed)
            break
        members, others = chance, members
        old.append(chance)
    whole = stage(reduce(lambda a, b: a.join(b, "shard"), levels), "cascade")
    unstage(*levels)
    return Cascade(whole, sizes, shards)


def look_up(rows: DataFrame, cascade: Cascade, key: str, name: str) -> DataFrame:
    """``rows`` with the boolean column ``name``: whether the row's key, of the cascade's universe,
    is listed.  A null key is not."""
    kept = rows.columns
    hashed = rows.withColumns(dict(zip(("h", "g"), _hashes(F.col(key))))).withColumn(
        "shard", F.when(F.col(key).isNotNull(), F.pmod("h", F.lit(cascade.shards))))
    last = len(cascade.sizes) - 1
    answer = F.lit(last % 2 == 0)
    for level in range(last, -1, -1):
        answer = F.when(_passes(level, cascade.sizes[level]), answer).otherwise(F.lit(level % 2 == 1))
    found = hashed.join(cascade.words, "shard", "left")
    return found.select(*kept, (F.col("shard").isNotNull() & answer).alias(name))


def judge(pages: DataFrame, rules: list[Rule], listed: Column, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, listed of every page.  ``listed`` is a condition on
    ``pages``: an address (host and path) is listed if it holds for any page of that address.
    The longest rule that fits decides; without one, listed addresses are blocked."""
    host, path = parse(pages[url_col].cast("string"))
    rows = pages.select(pages[id_col].cast("long").alias("page_id"), host.alias("host"), path.alias("path"),
                        F.coalesce(listed, F.lit(False)).alias("mark"))
    rows = rows.withColumn("key", F.when(F.col("host") != "", F.concat("host", "path")))
    universe = rows.where(F.col("key").isNotNull()).groupBy("key").agg(F.bool_or("mark").alias("listed"))
    found = look_up(rows, build(universe), "key", "listed")
    rule = rule_of(rules, F.col("host"), F.col("path"), lambda r: r.text)
    said = rule_of(rules, F.col("host"), F.col("path"), lambda r: r.verdict)
    return found.select("page_id", "host", "path", rule.alias("rule"),
                        F.coalesce(said, F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"), "listed")


def oracle(rules: list[Rule], listed_sql: str) -> str:
    """The same rows in DuckDB SQL over ``pages``; ``listed_sql`` is the condition on a page."""
    values = ", ".join(f"('{r.verdict}', '{r.host}', '{r.path}')" for r in rules)
    return f"""
WITH p AS (SELECT page_id, ({listed_sql}) AS mark,
  translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
listed AS (SELECT DISTINCT host, path FROM p WHERE mark AND host <> ''),
r(verdict, h, q) AS (VALUES {values})
SELECT page_id, host, path, rule, coalesce(said, CASE WHEN listed THEN 'block' ELSE 'allow' END) AS verdict, listed
FROM (SELECT page_id, host, path,
        (SELECT arg_max(h || q, length(h || q)) FROM r WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q)) AS rule,
        (SELECT arg_max(r.verdict, length(h || q)) FROM r WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q)) AS said,
        EXISTS (SELECT 1 FROM listed l WHERE l.host = p.host AND l.path = p.path) AS listed FROM p)"""
