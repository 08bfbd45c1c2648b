"""Lookups of dimension rows.

No broadcast hints here: Spark broadcasts the dimension side only when its size
estimate is below ``spark.sql.autoBroadcastJoinThreshold`` (AQE re-checks with
the real size at runtime) and sort-merge joins it otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lookup(df: DataFrame, dim: DataFrame, key: str, salt_buckets: int = 1024) -> DataFrame:
    """Left join ``dim`` (unique on ``key``) onto ``df`` without a NULL-key hot spot.

    Rows whose key is NULL can never match, yet in a shuffled join they would all
    hash to one reducer (walk-in sales are such rows).  They get a stand-in join
    key spread over ``salt_buckets`` negative values (a hash of the row, so a
    retried task routes them the same way) and the join condition also requires
    the real key to be set, so they still match nothing and keep NULL dimension
    columns.  One join, no union: the partitioning of ``df`` is not disturbed.
    """
    k = F.col(key)
    stand_in = F.when(k.isNull(), F.lit(-1) - F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]),
                                                    F.lit(salt_buckets))).otherwise(k.cast("long"))
    left = df.withColumn("_lookup_key", stand_in)
    right = dim.withColumnRenamed(key, "_dim_key")
    cond = (F.col("_lookup_key") == F.col("_dim_key")) & k.isNotNull()
    return left.join(right, cond, "left").drop("_lookup_key", "_dim_key")
