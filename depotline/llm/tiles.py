"""Search of a set of query vectors against all vectors, tile by tile.

Vectors are packed into blocks of bounded size, as binary columns.  Blocks of queries and blocks of
candidates meet in a grid: each cell holds a few blocks of either side, and a kernel returns the best
candidates of each query in the cell.  The cells' lists are merged in a tree of bounded fan-in.  No
pair of vectors ever becomes a row, and a block of equal vectors is no larger than any other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from math import ceil

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depotline.session import stage

CANDIDATES_PER_BLOCK = 8192
QUERIES_PER_BLOCK = 256
QUERY_BLOCKS_PER_CELL, CANDIDATE_BLOCKS_PER_CELL = 8, 8
FAN_IN = 16

#: A kernel takes the candidates' ids and block, the queries' ids and block (each a dict of arrays)
#: and k, and returns for each query its best candidates' scores and ids, best first, as two arrays
#: of k columns; unused places have the id ``NONE``.
Kernel = Callable[[dict, dict, int], tuple[np.ndarray, np.ndarray]]
NONE = np.iinfo(np.int64).min


def usable(vector: Column) -> Column:
    """Vectors that are not null or empty and have only finite components."""
    return vector.isNotNull() & (F.size(vector) > 0) & F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))


def rows_of(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id and vec (array<double>) of the rows that take part; rows without an id do not."""
    vec = vectors[vector_col].cast("array<double>")
    return vectors.select(vectors[id_col].cast("long").alias("vec_id"), vec.alias("vec")).where(
        F.col("vec_id").isNotNull() & usable(F.col("vec")))


def blocks(rows: DataFrame, size: int, encode: Callable[[np.ndarray], dict[str, np.ndarray]],
           names: list[str]) -> DataFrame:
    """Rows packed as they are read: block, dim, vec_id (binary, ascending) and the named arrays that
    ``encode`` makes of a matrix of doubles.  Only vectors of equal length share a block."""
    schema = ", ".join(["block long", "dim int", "vec_id binary", *(f"{n} binary" for n in names)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        made = TaskContext.get().partitionId() << 33

        def pack(dim: int, ids: np.ndarray, mat: np.ndarray) -> pd.DataFrame:
            nonlocal made
            order = np.argsort(ids, kind="stable")
            parts = encode(mat[order])
            made += 1
            return pd.DataFrame([[made, dim, ids[order].tobytes(), *(np.ascontiguousarray(parts[n]).tobytes() for n in names)]],
                                columns=["block", "dim", "vec_id", *names])

        for b in batches:
            lengths = b["vec"].map(len).to_numpy()
            for dim in np.unique(lengths):
                part = b[lengths == dim]
                new = (part["vec_id"].to_numpy(np.int64), np.stack(part["vec"].to_numpy()).astype(float))
                have = [*held.pop(dim, []), new]
                ids, mat = np.concatenate([x for x, _ in have]), np.concatenate([x for _, x in have])
                while len(ids) >= size:
                    yield pack(dim, ids[:size], mat[:size])
                    ids, mat = ids[size:], mat[size:]
                held[dim] = [(ids, mat)]
        for dim, have in held.items():
            if len(have[0][0]):
                yield pack(dim, *have[0])

    return rows.mapInPandas(run, schema)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of each row: highest score first, then smallest id; places with id NONE last."""
    worth = np.lexsort((ids, -scores, ids == NONE), axis=1)[:, :k]
    scores, ids = np.take_along_axis(scores, worth, 1), np.take_along_axis(ids, worth, 1)
    short = k - ids.shape[1]
    if short > 0:
        scores = np.pad(scores, ((0, 0), (0, short)))
        ids = np.pad(ids, ((0, 0), (0, short)), constant_values=NONE)
    return scores, ids


def search(candidates: DataFrame, queries: DataFrame, types: dict[str, tuple[str, int | None]], kernel: Kernel, k: int,
           score: str = "double") -> DataFrame:
    """query_id, rank, vec_id, score of the k best candidates of each query.

    ``candidates`` and ``queries`` are tables of ``blocks``; ``types`` names the arrays with their
    numpy type and their number of columns (None: the dimension)."""
    names = list(types)
    n_queries, n_blocks = queries.count(), candidates.count()
    stripes = max(1, ceil(n_queries / QUERY_BLOCKS_PER_CELL))
    # a query block goes to every column: as few as hold the candidates, but a cell a core while there are blocks for it
    spare = ceil(candidates.sparkSession.sparkContext.defaultParallelism / stripes)
    columns = max(1, min(n_blocks, max(ceil(n_blocks / CANDIDATE_BLOCKS_PER_CELL), spare)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    spread = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    left = candidates.select("*", spread("block", columns).alias("column")).select("*", every(stripes).alias("stripe"))
    right = queries.select("*", spread("block", stripes).alias("stripe")).select("*", every(columns).alias("column"))
    kind = np.dtype(np.float64 if score == "double" else np.int64)

    def unpack(row) -> dict:
        out = {"dim": row.dim, "vec_id": np.frombuffer(row.vec_id, np.int64)}
        n = len(out["vec_id"])
        for name, (t, width) in types.items():
            out[name] = np.frombuffer(getattr(row, name), t).reshape(n, row.dim if width is None else width)
        return out

    def cell(key: tuple, vecs: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        out = []
        sides = [unpack(r) for r in vecs.itertuples()]
        for q in asks.itertuples():
            ask, lists = unpack(q), []
            for side in sides:
                if side["dim"] == ask["dim"]:
                    lists.append(kernel(side, ask, k))
            if lists:
                s, i = best(np.concatenate([x for x, _ in lists], 1), np.concatenate([x for _, x in lists], 1), k)
                out.append((q.block, key[0], ask["vec_id"].tobytes(), s.astype(kind).tobytes(), i.tobytes()))
        return pd.DataFrame(out, columns=["block", "part", "query_id", "scores", "ids"])

    def merge(key: tuple, lists: pd.DataFrame) -> pd.DataFrame:
        s, i = best(np.concatenate([np.frombuffer(x, kind).reshape(-1, k) for x in lists["scores"]], 1),
                    np.concatenate([np.frombuffer(x, np.int64).reshape(-1, k) for x in lists["ids"]], 1), k)
        return pd.DataFrame([(key[0], key[1], lists["query_id"].iloc[0], s.tobytes(), i.tobytes())],
                            columns=["block", "part", "query_id", "scores", "ids"])

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples():
                ask, s, i = np.frombuffer(r.query_id, np.int64), np.frombuffer(r.scores, kind), np.frombuffer(r.ids, np.int64)
                out = pd.DataFrame({"query_id": np.repeat(ask, k), "rank": np.tile(np.arange(1, k + 1, dtype=np.int32), len(ask)),
                                    "vec_id": i, "score": s})
                yield out[i != NONE]

    schema = "block long, part int, query_id binary, scores binary, ids binary"
    lists = left.groupBy("column", "stripe").cogroup(right.groupBy("column", "stripe")).applyInPandas(cell, schema)
    parts = columns
    while parts > 1:
        parts = ceil(parts / FAN_IN)
        lists = lists.withColumn("part", F.pmod("part", F.lit(parts))).groupBy("block", "part").applyInPandas(merge, schema)
    return lists.mapInPandas(rows, f"query_id long, rank int, vec_id long, score {score}")


def staged_blocks(rows: DataFrame, every: int, encode, names: list[str], name: str) -> tuple[DataFrame, DataFrame]:
    """Written blocks of all rows, and of the rows whose id is divisible by ``every``."""
    asked = rows.where(F.col("vec_id") % every == 0)
    return (stage(blocks(rows, CANDIDATES_PER_BLOCK, encode, names), name),
            stage(blocks(asked, QUERIES_PER_BLOCK, encode, names), f"{name}-queries"))


def exact_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, summed component by component, so that equal vectors score equal."""
    return reduce(lambda s, d: s + a[:, d] * b[:, d], range(1, a.shape[1]), a[:, 0] * b[:, 0])
