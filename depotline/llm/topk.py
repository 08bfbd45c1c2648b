"""Exact top-k search by tiled matrix products.

Queries and shards of candidates meet tile by tile (``tiles``): a matrix product gives all scores of
a tile, partial selection keeps each query's k best, and the lists of all tiles are merged in a tree.

Vectors become whole numbers, floor(scale * x) for each component x, held within plus and minus
2^62.  Scores are whole inner products.  They are computed in doubles where no sum can pass 2^52,
which is exact, else in unbounded whole numbers; a score beyond a long is held at its end.

Defined results: rows with a null id, and vectors null, empty or holding null or non-finite
components, take no part.  A query's own rows, those with its id, are no candidates.  Vectors meet
only vectors of their own length.  Each row of a repeated id is searched and found by itself.  An
empty table gives an empty table; other columns play no part.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from depotline.llm import tiles


def whole(mat: np.ndarray, scale: float) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.clip(np.floor(scale * mat), -(2.0**62), 2.0**62).astype(np.int64)


def _scores(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Whole inner products; as doubles where those are exact, else as objects."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(v).max(initial=0)) * q.shape[1]
    if most < 2.0**52:
        return q.astype(float) @ v.astype(float).T
    return q.astype(object) @ v.astype(object).T


def kernel(side: dict, ask: dict, k: int) -> tuple[np.ndarray, np.ndarray]:
    scores, ids = _scores(ask["vec"], side["vec"]), side["vec_id"]
    own = ask["vec_id"][:, None] == ids[None, :]
    n = min(k, len(ids))
    if scores.dtype == object:
        scores = np.clip(scores, -(2**63), 2**63 - 1).astype(np.int64)
        out = np.full((2, len(scores), n), tiles.NONE, np.int64)
        for r in range(len(scores)):  # sorted whole; ids ascend, so a stable sort breaks ties
            free = np.flatnonzero(~own[r])
            at = free[np.argsort(~scores[r][free], kind="stable")][:n]  # ~x falls as x rises, without overflow
            out[0, r, : len(at)], out[1, r, : len(at)] = scores[r][at], ids[at]
        return out[0], out[1]
    scores[own] = -np.inf
    # the place breaks ties: ids ascend, so of equal scores the earlier place is the smaller id
    cut = np.partition(scores, -n, axis=1)[:, -n]
    out_s, out_i = np.zeros((len(scores), n), np.int64), np.full((len(scores), n), tiles.NONE, np.int64)
    for r in range(len(scores)):
        at = np.flatnonzero(scores[r] >= cut[r])
        at = at[np.argsort(-scores[r][at], kind="stable")][:n]
        at = at[scores[r][at] > -np.inf]
        out_s[r, : len(at)], out_i[r, : len(at)] = scores[r][at], ids[at]
    return out_s, out_i


def search(vectors: DataFrame, k: int = 10, every: int = 100, scale: float = 1024.0, id_col: str = "vec_id",
           vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score (long): for each row whose id is divisible by ``every`` its k
    best candidates among all other rows, ties to the smaller id."""
    rows = tiles.rows_of(vectors, id_col, vector_col)
    both = tiles.staged_blocks(rows, every, lambda m: {"vec": whole(m, scale)}, ["vec"], "topk")
    return tiles.search(*both, {"vec": ("<i8", None)}, kernel, k, "long")
