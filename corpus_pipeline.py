"""Corpus pipeline over ``documents``: quality classifier, near-duplicate removal, secret scan, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next stage's ``docs``.  All stages but the last return the columns of documents.

* quality classifier: documents that the line field scores below 0.3 go.
* MinHash near-dedup: of each component of near-duplicates the document of the smallest id stays.
* secret scans: live-looking secrets in the texts are replaced by ``[SECRET]``; every document stays.
* packing: the documents become token sequences, one row a piece, with its ids as little-endian 32-bit
  numbers; a document's pieces in order of ``start`` give the redacted text back, and the end id.

Defined results, for every stage and for run():

* null and empty texts score 0 as documents without lines and go in the first stage; given to a later
  stage they stay, have no secrets, and pack as the end id alone.
* null ids are values like any other: such rows are scored, and stay as others do; near-duplicates that
  all lack an id keep one of them.  Of repeated rows one stays.
* texts of any length are worked on whole, in slices of bounded bytes.
* ties: of near-duplicates of one id (repeated with different texts) the first read stays.
* an empty table, or one of which a stage keeps nothing, gives an empty table with the same columns.
* further columns, whatever their names, are carried along to the last stage and play no part.

SQL cannot express the stages, so there is no ``ORACLE_SQL``; ``tests/llm`` holds the stages against
plain versions.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depotline.llm import chosen_path, line_crf, packing, secrets
from depotline.llm.common import table
from depotline.session import stage, staged_tables, unstage


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_crf.keep_good(docs, table(spark, sf_dir, "labels"), threshold=0.3)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return chosen_path.keep_one(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = secrets.redact(docs, owner=docs["source"], repository=F.concat_ws("/", docs["source"], docs["lang"]))
    return out.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


STAGES = [("quality classifier", quality), ("MinHash near-dedup", dedup), ("secret scans", secret_scan), ("packing", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        with staged_tables() as inner:  # a stage's own tables go when its result is written, and then its input
            out = stage(step(spark, docs, sf_dir), name.replace(" ", "-"))
            inner.remove(out)
        unstage(docs)
        docs = out
    return docs
