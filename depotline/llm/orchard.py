"""Centroid clustering with Orchard's search for the nearest centroid.

Every centroid has a list of the other centroids, sorted by their distance from it.  A vector starts
at centroid 0 and walks along the list of its current centroid; a centroid met for the first time is
marked visited and its distance taken, and if it is closer (or equally close with a smaller number),
the walk jumps to the start of that centroid's list.  The walk ends when the list does, or when the
next centroid is strictly further from the current one than twice the vector's current distance: by
the triangle inequality neither it nor any after it is closer or as close.  Vectors of a batch walk in
step.

Vectors become whole numbers, floor(scale * x) for each component x, held within plus and minus 2^62,
and all decisions are exact: squared distances are taken in doubles while no sum can reach 2^52, else
in unbounded whole numbers.  A round reads the table once; each task adds up its vectors by cluster
and returns one row a cluster, so rounds shuffle and collect a number of rows that depends on tasks
and centroids only.

Defined results: rows with a null id, and vectors that are null, of another length, or hold null or
non-finite components, take no part.  With fewer vectors than centroids each vector starts one.  Rows
that repeat an id each take part; of rows with equal ids the smaller vector starts first.  Distances
and sums beyond a long are held at its end.  An empty table gives an empty table; other columns play
no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from depotline.llm.tiles import rows_of
from depotline.llm.topk import whole
from depotline.session import stage

LONG = np.iinfo(np.int64).max
#: Vectors that walk in step.
SLICE = 4096


class Centroids(NamedTuple):
    """Whole-number centroids, their sorted neighbour lists and squared distances to those."""

    at: np.ndarray
    order: np.ndarray
    far: np.ndarray


def exact(*parts: np.ndarray) -> list[np.ndarray]:
    """The arrays as doubles where four times a squared distance between their rows is exact in
    doubles, else as Python's whole numbers."""
    most = max((int(max(abs(int(p.max(initial=0))), abs(int(p.min(initial=0))))) for p in parts), default=0)
    kind = float if 4 * parts[0].shape[1] * (2 * most) ** 2 < 2**52 else object
    return [p.astype(kind) for p in parts]


def neighbour_lists(at: np.ndarray) -> Centroids:
    """The centroids with the others of each, nearest first, ties to the smaller number."""
    wide = at.astype(object)
    apart = ((wide[:, None, :] - wide[None, :, :]) ** 2).sum(axis=2).reshape(len(at), len(at))
    order = np.array([[j for _, j in sorted((apart[i, j], j) for j in range(len(at)) if j != i)] for i in range(len(at))], int)
    order = order.reshape(len(at), max(0, len(at) - 1))
    return Centroids(at, order, np.take_along_axis(apart, order, 1))


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((a - b) ** 2).sum(axis=1)


def nearest(vecs: np.ndarray, centroids: Centroids) -> tuple[np.ndarray, np.ndarray]:
    """Number of each vector's nearest centroid, and the squared distance."""
    vec, at = exact(vecs, centroids.at)
    far = centroids.far.astype(vec.dtype)
    current = np.zeros(len(vec), int)
    near = squared(vec, at[current])
    seen = np.zeros((len(vec), len(at)), bool)
    seen[:, 0] = True
    place, walking = np.zeros(len(vec), int), np.arange(len(vec))
    while len(walking):
        walking = walking[place[walking] < centroids.order.shape[1]]
        here, step = current[walking], place[walking]
        within = ~(far[here, step] > 4 * near[walking])  # strictly beyond twice the current distance ends the walk
        walking, here, step = walking[within], here[within], step[within]
        place[walking] += 1
        other = centroids.order[here, step]
        new = ~seen[walking, other]
        rows, other = walking[new], other[new]
        seen[rows, other] = True
        d = squared(vec[rows], at[other])
        closer = (d < near[rows]) | ((d == near[rows]) & (other < current[rows]))
        jump = rows[closer]
        current[jump], near[jump], place[jump] = other[closer], d[closer], 0
    return current, near


def matrices(batches: Iterator[pa.RecordBatch], dim: int, scale: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and whole-number vectors, SLICE rows at a time."""
    for b in batches:
        for at in range(0, b.num_rows, SLICE):
            part = b.slice(at, SLICE)
            flat = part.column("vec").flatten().to_numpy(zero_copy_only=False)
            yield part.column("vec_id").to_numpy(zero_copy_only=False), whole(flat.reshape(-1, dim), scale)


def first_centroids(rows: DataFrame, k: int, seed: int, scale: float) -> np.ndarray:
    """The k vectors whose ``<seed>:<vec_id>`` have the smallest SHA-256, in that order."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = rows.orderBy(key, "vec").limit(k).collect()  # k rows
    return whole(np.array([r["vec"] for r in first], float), scale)


def moved(rows: DataFrame, centroids: Centroids, dim: int, scale: float) -> np.ndarray:
    """Centroids at the floor of the mean of their vectors; those without vectors stay."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(centroids.at), dim), object)
        counts = np.zeros(len(centroids.at), int)
        for _, vecs in matrices(batches, dim, scale):
            cluster, _ = nearest(vecs, centroids)
            for c in np.unique(cluster):
                mine = exact(vecs[cluster == c])[0]
                sums[c] += [int(s) for s in mine.sum(axis=0)]
                counts[c] += len(mine)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(used.repeat(dim), pa.int32()), pa.array(np.tile(np.arange(dim), len(used)), pa.int32()),
             pa.array([Decimal(s) for c in used for s in sums[c]], pa.decimal128(38, 0)), pa.array(counts[used].repeat(dim), pa.int64())],
            names=["cluster", "component", "total", "count"])

    parts = rows.select("vec_id", "vec").mapInArrow(run, "cluster int, component int, total decimal(38,0), count long")
    sums = parts.groupBy("cluster", "component").agg(F.sum("total").alias("total"), F.sum("count").alias("count")).collect()  # k * dim rows
    out = centroids.at.copy()
    for r in sums:
        out[r["cluster"], r["component"]] = int(r["total"]) // r["count"]
    return out


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, dim: int = 64, scale: float = 64.0, seed: int = 1, id_col: str = "vec_id",
            vector_col: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """vec_id, cluster and distance (squared) of each vector after ``rounds`` rounds, and the centroids."""
    rows = rows_of(vectors, id_col, vector_col).where(F.size("vec") == dim)
    at = first_centroids(rows, k, seed, scale)
    schema = "vec_id long, cluster int, distance long"
    if not len(at):
        return vectors.sparkSession.createDataFrame([], schema), at
    for _ in range(rounds):
        at = moved(rows, neighbour_lists(at), dim, scale)
    centroids = neighbour_lists(at)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, vecs in matrices(batches, dim, scale):
            number, distance = nearest(vecs, centroids)
            held = distance if distance.dtype == float else np.minimum(distance, LONG)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(number, pa.int32()), pa.array(held.astype(np.int64))],
                                             names=["vec_id", "cluster", "distance"])

    return rows.select("vec_id", "vec").mapInArrow(run, schema), at


def assignments(vectors: DataFrame, **how) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of each vector."""
    placed, at = cluster(vectors, **how)
    placed = stage(placed, "orchard-placed")
    held = lambda total: min(int(total or 0), int(LONG))
    sums = {r["cluster"]: r["total"] for r in placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}  # k rows
    inertia = held(sum(sums.values()))
    digests = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in at]
    schema = T.StructType([T.StructField("cluster", T.IntegerType()), T.StructField("cluster_inertia", T.LongType()),
                           T.StructField("inertia", T.LongType()), T.StructField("centroid_sha256", T.StringType())])
    table = placed.sparkSession.createDataFrame([(c, held(sums[c]), inertia, digests[c]) for c in sorted(sums)], schema)
    return placed.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows


def oracle(k: int = 16, rounds: int = 3, dim: int = 64, scale: int = 64, seed: int = 1) -> str:
    """DuckDB SQL of the same rows, every vector against every centroid."""
    def nearest_of(centroids: str) -> str:
        return f"""(SELECT vec_id, w, c AS cluster, d AS distance FROM (
            SELECT v.vec_id, v.n, any_value(v.w) AS w, arg_min(c.cluster, (list_sum(list_transform(list_zip(v.w, c.at), lambda p: (p[1]-p[2])*(p[1]-p[2]))), c.cluster)) AS c,
                   min(list_sum(list_transform(list_zip(v.w, c.at), lambda p: (p[1]-p[2])*(p[1]-p[2])))) AS d
            FROM v CROSS JOIN {centroids} c GROUP BY v.vec_id, v.n))"""
    steps = []
    for r in range(rounds):
        steps.append(f"""a{r} AS {nearest_of(f'c{r}')},
m{r} AS (SELECT cluster, i, sum(w[i])::HUGEINT AS s, count(*) AS n FROM (SELECT cluster, w, unnest(range(1, {dim + 1})) AS i FROM a{r}) GROUP BY cluster, i),
c{r + 1} AS (SELECT c.cluster, coalesce(x.at, c.at) AS at FROM c{r} c LEFT JOIN (
  SELECT cluster, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS at FROM m{r} GROUP BY cluster) x USING (cluster))""")
    return f"""
WITH v AS (SELECT vec_id, row_number() OVER () AS n, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS w FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS (SELECT row_number() OVER (ORDER BY sha256(concat('{seed}:', vec_id)), w) - 1 AS cluster, w AS at FROM v
  QUALIFY cluster < {k}),
{','.join(steps)},
f AS {nearest_of(f'c{rounds}')}
SELECT vec_id, f.cluster::INT AS cluster, distance::BIGINT AS distance, (sum(distance) OVER (PARTITION BY f.cluster))::BIGINT AS cluster_inertia,
       (sum(distance) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.at, ',')) AS centroid_sha256
FROM f JOIN c{rounds} c ON c.cluster = f.cluster"""
