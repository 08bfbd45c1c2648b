"""Registered queries of this subpackage, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depotline.llm import (byte_bpe, chosen_path, difference_cover, hashing_index, licenses, line_crf, orchard, packing, secrets, sharding, threshold,
                           topk, url_filter)
from depotline.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def put(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return put


@register("op1_multi_index_hashing")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hashing_index.search(table(spark, sf_dir, "embeddings"), k=20, every=20)


@register("op2_secret_ownership")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Owners are the documents' sources; a source's repositories are its parts by language."""
    docs = table(spark, sf_dir, "documents")
    return secrets.scan(docs, owner=docs["source"], repository=F.concat_ws("/", docs["source"], docs["lang"]))


@register("op4_spm_byte_bpe")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"),
                            public_tokenizers.PATTERN)


@register("op6_license_dice", licenses.oracle())
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


@register("op7_vector_packing")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest columns of the packed pieces, ids left out."""
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                        public_tokenizers.PATTERN).select(packing.DIGEST)


RULES = [url_filter.Rule(*r) for r in (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
                                       ("allow", "com", "/fr/"), ("block", "com", "/de/"))]


@register("op9_filter_cascade", url_filter.oracle(RULES, "starts_with(url, 'http://')"))
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses that any page serves without encryption are listed."""
    pages = table(spark, sf_dir, "pages")
    return url_filter.judge(pages, RULES, pages["url"].startswith("http://"))


VECTORS = "embedding"
_FINITE = f"{VECTORS} IS NOT NULL AND len({VECTORS}) > 0 AND len(list_filter({VECTORS}, lambda x: x IS NULL OR NOT isfinite(x))) = 0"


@register("op10_tiled_topk", f"""
WITH v AS (SELECT vec_id, list_transform({VECTORS}, lambda x: floor(1024 * x::DOUBLE)) AS w
           FROM embeddings WHERE vec_id IS NOT NULL AND {_FINITE}),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.w, c.w)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.w) = len(c.w) WHERE q.vec_id % 100 = 0)
SELECT query_id, rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s) WHERE rank <= 10""")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), k=10, every=100)


@register("op5_chosen_path")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen_path.near_duplicates(table(spark, sf_dir, "documents"))


@register("op3_best_fit_shards")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard sizes are near equal, which is the law ``bytes``."""
    placed = sharding.shard(table(spark, sf_dir, "documents"), shards=40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


@register("op8_crf_quality")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_crf.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.3)


@register("op11_threshold_negatives", threshold.oracle())
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids divisible by 7 have the next label."""
    vectors = table(spark, sf_dir, "embeddings")
    label = F.when(vectors["vec_id"] % 7 == 0, (vectors["label"] + 1) % 10).otherwise(vectors["label"])
    return threshold.mine(vectors, label, every=100, positives=5, k=10)


@register("op12_difference_cover", difference_cover.oracle())
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest of the kept words instead of the words."""
    return difference_cover.remove_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@register("op13_orchard_clusters", orchard.oracle())
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orchard.assignments(table(spark, sf_dir, "embeddings"), k=16, rounds=3)


QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
