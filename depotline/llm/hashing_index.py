"""Approximate nearest neighbours by multi-index hashing.

A vector's code has ``BITS`` bits: signs along learned directions.  The directions are rotations
fitted to a bounded sample (iterative quantisation: turn the sample's principal axes until the signs
lose least), as many as the code needs.  So that nearness is the inner product, candidates get one
more component that brings them all to the largest norm, and queries get a zero there.

A code is split into ``PARTS`` substrings, and each block of codes is indexed by each of them when it is
written.  If two
codes differ in at most r bits, some substring differs in at most r // PARTS (pigeonhole); so probing
the buckets within that distance of the query's substrings finds every code within r.  Codes found
are checked on the whole code, and of those within r, and of no others, the inner products are taken.  The radius
is learned on the sample: it holds the wanted share of the sample's true neighbours.  Neighbours only
come closer as rows are added, so the share holds for the whole table; a block with fewer than k
codes within the radius is probed further, to its k-th nearest code.

Defined results: rows with a null id, and vectors null, empty, zero or holding null or non-finite
components, take no part.  A query's own rows are no candidates; vectors meet only vectors of their
own length, and lengths that the sample does not hold are searched without a radius.  Each row of a
repeated id is searched and found by itself.  An empty table gives an empty table; other columns play
no part.
"""

from __future__ import annotations

from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depotline.llm import tiles

BITS, PARTS = 128, 8
#: Rows that the directions and the radius are fitted to, those with the smallest hashes, and how
#: many of them serve as queries.
SAMPLE, SAMPLE_QUERIES = 4096, 256
#: Share of true neighbours within the radius.
WANTED = 0.985
TURNS = 30
#: So many vector lengths, the most frequent ones, get directions; others are searched whole.
LENGTHS = 64


class Model(NamedTuple):
    """Per vector length: the directions (length + 1 rows, BITS columns); and the radius."""

    directions: dict[int, np.ndarray]
    radius: dict[int, int]
    norm: dict[int, float]


def lifted(mat: np.ndarray, norm: float) -> np.ndarray:
    """Vectors with the component that brings them to the norm."""
    rest = np.sqrt(np.maximum(norm**2 - (mat**2).sum(1), 0))
    return np.concatenate([mat, rest[:, None]], 1)


def rotation(points: np.ndarray, seed: int) -> np.ndarray:
    """Directions in whose signs the points lose least, by alternating signs and best rotation."""
    dim = points.shape[1]
    axes = np.linalg.eigh(points.T @ points)[1]
    turn = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, dim)))[0]
    along = points @ axes
    for _ in range(TURNS):
        u, _, v = np.linalg.svd(np.where(along @ turn >= 0, 1.0, -1.0).T @ along)
        turn = (u @ v).T
    return axes @ turn


def codes(points: np.ndarray, directions: np.ndarray) -> np.ndarray:
    """PARTS 16-bit substrings a row."""
    return np.packbits(points @ directions >= 0, axis=1, bitorder="little").view("<u2")


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits between every row of a and every row of b."""
    x, y = a.view("<u8"), b.view("<u8")
    return sum(np.bitwise_count(x[:, None, j] ^ y[None, :, j]).astype(np.int16) for j in range(x.shape[1]))


def _scale(mat: np.ndarray) -> float:
    return float(np.abs(mat).max(initial=0)) or 1.0


def fit(sample: pd.DataFrame, norms: dict[int, float], k: int, wanted: float = WANTED) -> Model:
    """The model of sampled rows (vec_id, vec); ``norms`` has the largest norm by vector length."""
    out = Model({}, {}, norms)
    for dim, part in sample.groupby(sample["vec"].map(len)):
        if dim not in norms:
            continue
        mat = np.stack(part["vec"].to_numpy()) / norms[dim]
        points = lifted(mat, 1.0)
        turns = [rotation(points, seed) for seed in range(-(-BITS // points.shape[1]))]
        out.directions[dim] = np.concatenate(turns, 1)[:, :BITS]
        asks = mat[:SAMPLE_QUERIES]
        score = asks @ mat.T
        score[np.arange(len(asks)), np.arange(len(asks))] = -np.inf
        near = np.argsort(-score, axis=1)[:, : min(k, len(mat) - 1)]
        gaps = distances(codes(lifted(asks, 0.0), out.directions[dim]), codes(points, out.directions[dim]))
        found = np.take_along_axis(gaps, near, 1)
        out.radius[dim] = int(np.quantile(found, wanted, method="higher")) if found.size else BITS
    return out


def index(side_codes: np.ndarray) -> np.ndarray:
    """For each substring the rows in the order of its values: rows of equal values, a bucket, stand together."""
    return np.argsort(side_codes, axis=0, kind="stable").astype("<u2")


@lru_cache(maxsize=32)
def flips(reach: int) -> np.ndarray:
    """All 16-bit numbers of at most ``reach`` set bits: what a substring is flipped by to name its buckets."""
    every = np.arange(1 << 16, dtype=np.uint16)
    return every[np.bitwise_count(every) <= reach]


class Buckets:
    """The stored index of a block: for each substring its values and where their buckets lie."""

    def __init__(self, side_codes: np.ndarray, order: np.ndarray) -> None:
        self.codes, self.order = side_codes, order
        self.values, self.ends = [], []
        for j in range(PARTS):
            sorted_codes = side_codes[order[:, j], j]
            first = np.flatnonzero(np.append(True, sorted_codes[1:] != sorted_codes[:-1])) if len(sorted_codes) else np.zeros(0, int)
            self.values.append(sorted_codes[first])
            self.ends.append(np.append(first, len(sorted_codes)))

    def probe(self, code: np.ndarray, reach: int) -> np.ndarray:
        """Rows that have a substring within ``reach`` bits of the code's, as marks: the buckets so near are
        named one by one where those are fewer than the buckets there are, else found among them."""
        hit = np.zeros(len(self.codes), bool)
        for j in range(PARTS):
            values, ends = self.values[j], self.ends[j]
            if len(flips(reach)) < len(values):
                named = code[j] ^ flips(reach)
                at = np.searchsorted(values, named)
                near = at[(at < len(values)) & (values[np.minimum(at, len(values) - 1)] == named)]
            else:
                near = np.flatnonzero(np.bitwise_count(values ^ code[j]) <= reach)
            if len(near) == len(values):
                return np.ones(len(self.codes), bool)
            size = ends[near + 1] - ends[near]
            place = np.arange(size.sum()) + np.repeat(ends[near] - (np.cumsum(size) - size), size)
            hit[self.order[place, j]] = True
        return hit


def within(buckets: Buckets, code: np.ndarray, radius: int, k: int, own: np.ndarray) -> np.ndarray:
    """Rows whose codes are within the radius of the code, or within the distance of its k-th nearest
    code if fewer than k are; none of its own rows (marks)."""
    found = np.flatnonzero(buckets.probe(code, radius // PARTS) & ~own)
    found = found[distances(code[None, :], buckets.codes[found])[0] <= radius]
    others = np.flatnonzero(~own)
    if len(found) < min(k, len(others)):
        gap = distances(code[None, :], buckets.codes[others])[0]
        found = others[gap <= np.partition(gap, min(k, len(others)) - 1)[min(k, len(others)) - 1]]
    return found


def search(vectors: DataFrame, k: int = 20, every: int = 20, wanted: float = WANTED, id_col: str = "vec_id",
           vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score (double): for each row whose id is divisible by ``every`` its k
    largest inner products found among all other rows, ties to the smaller id."""
    rows = tiles.rows_of(vectors, id_col, vector_col).where(F.exists("vec", lambda x: x != 0))
    largest = F.array_max(F.transform("vec", F.abs))
    length = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + (x / F.col("largest")) ** 2)) * F.col("largest")
    norms = {r["dim"]: r["norm"] for r in rows.withColumn("largest", largest).groupBy(F.size("vec").alias("dim"))
             .agg(F.max(length).alias("norm"), F.count("*").alias("n")).orderBy(F.desc("n")).limit(LENGTHS).collect()}
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toPandas()
    model = fit(sample, norms, k, wanted)

    def encode(is_query: bool):
        def run(mat: np.ndarray) -> dict[str, np.ndarray]:
            dim = mat.shape[1]
            if dim not in model.directions:  # searched whole: all codes equal
                code = np.zeros((len(mat), PARTS), "<u2")
            else:
                code = codes(lifted(mat / model.norm[dim], 0.0 if is_query else 1.0), model.directions[dim])
            return {"vec": mat, "code": code, "order": index(code)}
        return run

    def kernel(side: dict, ask: dict, k: int) -> tuple[np.ndarray, np.ndarray]:
        ids, v, q = side["vec_id"], side["vec"], ask["vec"]
        buckets, by_v, n = Buckets(side["code"], side["order"]), _scale(v), min(k, len(ids))
        radius = model.radius.get(side["dim"], BITS)
        out_s, out_i = np.zeros((len(q), n)), np.full((len(q), n), tiles.NONE, np.int64)
        for r in range(len(q)):
            at = within(buckets, ask["code"][r], radius, k, ids == ask["vec_id"][r])  # rows ascend, and ids with them
            rough = (v[at] / by_v) @ (q[r] / _scale(q[r]))  # of retrieved rows only
            if len(at) > n:
                keep = rough >= np.partition(rough, -n)[-n] - 1e-9  # rounding of the product moves no score so far
                at = at[keep]
            score = tiles.exact_scores(np.broadcast_to(q[r], (len(at), q.shape[1])), v[at])
            first = np.argsort(-score, kind="stable")[:n]
            out_s[r, : len(first)], out_i[r, : len(first)] = score[first], ids[at[first]]
        return out_s, out_i

    asked = rows.where(F.col("vec_id") % every == 0)
    both = (tiles.stage(tiles.blocks(rows, tiles.CANDIDATES_PER_BLOCK, encode(False), ["vec", "code", "order"]), "codes"),
            tiles.stage(tiles.blocks(asked, tiles.QUERIES_PER_BLOCK, encode(True), ["vec", "code", "order"]), "code-queries"))
    return tiles.search(*both, {"vec": ("<f8", None), "code": ("<u2", PARTS), "order": ("<u2", PARTS)}, kernel, k, "double")
