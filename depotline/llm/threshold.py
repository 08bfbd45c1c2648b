"""Hard negatives by Fagin's threshold algorithm.

Vectors are packed into blocks of bounded size.  A block keeps, for each dimension, the list of its
rows sorted by that component; the lists are made once, when the block is written.

An anchor reads a block by sorted access: for each dimension where its own component is positive the
list from the top, where it is negative from the bottom, some places of every list at a time.  Each
row met for the first time is scored by random access, as a whole inner product.  The threshold is
the score of a made-up row with the last component read in every list; no unseen row can score more.
Reading stops once, for each window of scores asked for, the threshold is strictly below the window's
kth score, or strictly below the window itself; so ties with the kth are all seen.

Blocks of anchors and blocks of candidates meet in a grid of cells with several blocks of either
side.  Within a cell an anchor carries its lists from block to block, so later blocks are left sooner,
and the cells' lists are merged in a tree of bounded fan-in.  The grid is walked twice: first for the
positives (one window without bounds over rows of the anchor's label), then, with a window of scores
for each positive, for the negatives (rows of other labels).  No pair of vectors becomes a row, and
no cell grows with the number of equal vectors or the size of a label.

Vectors become whole numbers, floor(scale * x) for each component x, held within plus and minus 2^62.
Scores are taken in doubles where no sum can reach 2^52, else in unbounded whole numbers; a score
beyond a long is held at its end.

Defined results: rows with a null id or label, and vectors null, empty or holding null or non-finite
components, take no part.  Vectors meet only vectors of their own length.  Rows with the anchor's id
are no positives.  Each anchor row of a repeated id is searched, and each candidate row found, by
itself.  An anchor without positives, or a positive without negatives in its window, gives no row.
An empty table gives an empty table; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depotline.llm.tiles import NONE, best, usable
from depotline.llm.topk import whole
from depotline.session import stage, unstage

CANDIDATES_PER_BLOCK, ANCHORS_PER_BLOCK = 8192, 64
BLOCKS_PER_CELL, ANCHOR_BLOCKS_PER_CELL = 8, 8
FAN_IN = 16
#: Places read of every list before the threshold is first looked at; doubled each time.
FIRST_DEPTH = 16
LOWEST, HIGHEST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


class Window(NamedTuple):
    """The k best rows with scores from low to high are asked for."""

    low: int
    high: int


# ----------------------------------------------------------------------------------------- blocks
def packed(rows: DataFrame, size: int, scale: float, lists: bool) -> DataFrame:
    """Rows (vec_id, label, vec) packed as they are read: block, dim, and as binary columns vec_id
    (ascending), label, vec and, where asked for, the sorted lists."""
    schema = "block long, dim int, vec_id binary, label binary, vec binary, lists binary"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, pd.DataFrame] = {}
        made = TaskContext.get().partitionId() << 33

        def block(dim: int, part: pd.DataFrame) -> pd.DataFrame:
            nonlocal made
            made += 1
            part = part.sort_values("vec_id", kind="stable")
            mat = whole(np.stack(part["vec"].to_numpy()).astype(float), scale)
            order = np.argsort(mat, axis=0, kind="stable").T.astype("<u4").tobytes() if lists else b""
            return pd.DataFrame([(made, dim, part["vec_id"].to_numpy("<i8").tobytes(), part["label"].to_numpy("<i8").tobytes(),
                                  mat.astype("<i8").tobytes(), order)], columns=["block", "dim", "vec_id", "label", "vec", "lists"])

        for b in batches:
            for dim, part in b.groupby(b["vec"].map(len)):
                rest = pd.concat([held.pop(dim), part], ignore_index=True) if dim in held else part
                while len(rest) >= size:
                    yield block(dim, rest.iloc[:size])
                    rest = rest.iloc[size:]
                if len(rest):
                    held[dim] = rest
        for dim, rest in held.items():
            yield block(dim, rest)

    return rows.mapInPandas(run, schema)


class Block:
    """A row of ``packed``, as arrays."""

    def __init__(self, row) -> None:
        self.dim = row.dim
        self.ids, self.labels = np.frombuffer(row.vec_id, "<i8"), np.frombuffer(row.label, "<i8")
        self.vecs = np.frombuffer(row.vec, "<i8").reshape(-1, row.dim)
        self.lists = np.frombuffer(row.lists, "<u4").reshape(row.dim, -1) if row.lists else None
        self.most = max(int(self.vecs.max()), -int(self.vecs.min()))
        self._cast: dict[type, np.ndarray] = {}

    def as_kind(self, kind: type) -> np.ndarray:
        if kind not in self._cast:
            self._cast[kind] = self.vecs.astype(kind)
        return self._cast[kind]


# ---------------------------------------------------------------------------------------- reading
class Found:
    """The best rows found so far in each window of an anchor."""

    def __init__(self, windows: list[Window], k: int) -> None:
        self.windows, self.k = windows, k
        self.rows = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in windows]

    def offer(self, scores: np.ndarray, ids: np.ndarray) -> None:
        for w, window in enumerate(self.windows):
            fits = (scores >= window.low) & (scores <= window.high)
            if not fits.any():
                continue
            s = np.concatenate([self.rows[w][0], scores[fits]])
            i = np.concatenate([self.rows[w][1], ids[fits]])
            order = np.lexsort((i, ~s))[: self.k]  # ~s falls as s rises, without overflow
            self.rows[w] = s[order], i[order]

    def settled(self, threshold: int) -> bool:
        """Whether no row of at most this score can change anything."""
        return all(window.low > window.high or threshold < window.low or (len(s) == self.k and threshold < s[-1])
                   for window, (s, _) in zip(self.windows, self.rows, strict=True))


def _long(score: int) -> int:
    return max(LOWEST, min(HIGHEST, int(score)))


def read(block: Block, anchor: np.ndarray, takes: np.ndarray, found: Found) -> int:
    """Threshold algorithm over one block for one anchor; ``takes`` marks the rows that count.
    Returns the number of rows scored."""
    most = int(np.abs(anchor).max())
    kind = float if most * block.most * block.dim < 2**52 else object
    mine, vecs = anchor.astype(kind), block.as_kind(kind)
    n = len(block.ids)
    used = np.flatnonzero(anchor)
    if not len(used):
        used = np.array([0])
    lists = block.lists[used]
    rising = (anchor[used] <= 0)[:, None]  # read from the smallest component
    seen = np.zeros(n, bool)
    depth, step, scored = 0, FIRST_DEPTH, 0
    while depth < n:
        end = min(n, depth + step)
        up, down = lists[:, depth:end], lists[:, n - end : n - depth][:, ::-1]
        access = np.where(rising, up, down)
        fresh = np.zeros(n, bool)
        fresh[access] = True
        new = np.flatnonzero(fresh & ~seen)
        seen[new] = True
        counted = new[takes[new]]
        if len(counted):
            scores = vecs[counted] @ mine
            if kind is object:
                scores = np.array([_long(s) for s in scores], np.int64)
            found.offer(scores.astype(np.int64), block.ids[counted])
        scored += len(counted)
        depth, step = end, 2 * step
        threshold = _long((vecs[access[:, -1], used] * mine[used]).sum())
        if found.settled(threshold):
            break
    return scored


# ------------------------------------------------------------------------------------------- grid
def _grid(blocks: DataFrame, anchors: DataFrame, windows: int, k: int, same: bool) -> DataFrame:
    """block, scores, ids: for each block of anchors the k best rows in each window of each anchor,
    as arrays of anchors x windows x k; unused places have the id NONE.  ``anchors`` bring the bounds of
    their windows (low, high); ``same`` asks for rows of the anchor's label, else of other labels."""
    n_blocks, n_anchors = blocks.count(), anchors.count()
    stripes = max(1, ceil(n_anchors / ANCHOR_BLOCKS_PER_CELL))
    spare = ceil(blocks.sparkSession.sparkContext.defaultParallelism / stripes)
    columns = max(1, min(n_blocks, max(ceil(n_blocks / BLOCKS_PER_CELL), spare)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    spread = lambda n: F.pmod(F.xxhash64("block"), F.lit(n)).cast("int")
    left = blocks.withColumn("column", spread(columns)).select("*", every(stripes).alias("stripe"))
    right = anchors.withColumn("stripe", spread(stripes)).select("*", every(columns).alias("column"))

    def cell(key: tuple, vecs: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        sides = [Block(r) for r in vecs.itertuples()]
        out = []
        for ask in asks.itertuples():
            anchor = Block(ask)
            low, high = (np.frombuffer(b, "<i8").reshape(-1, windows) for b in (ask.low, ask.high))
            scores = np.zeros((len(anchor.ids), windows, k), np.int64)
            ids = np.full((len(anchor.ids), windows, k), NONE, np.int64)
            for a in range(len(anchor.ids)):
                found = Found([Window(*w) for w in zip(low[a].tolist(), high[a].tolist(), strict=True)], k)
                for side in sides:
                    if side.dim != anchor.dim:
                        continue
                    equal = side.labels == anchor.labels[a]
                    read(side, anchor.vecs[a], equal & (side.ids != anchor.ids[a]) if same else ~equal, found)
                for w, (s, i) in enumerate(found.rows):
                    scores[a, w, : len(s)], ids[a, w, : len(i)] = s, i
            out.append((ask.block, key[0], scores.tobytes(), ids.tobytes()))
        return pd.DataFrame(out, columns=["block", "part", "scores", "ids"])

    def merge(key: tuple, lists: pd.DataFrame) -> pd.DataFrame:
        s, i = (np.concatenate([np.frombuffer(x, np.int64).reshape(-1, k) for x in lists[c]], 1) for c in ("scores", "ids"))
        s, i = best(s, i, k)
        return pd.DataFrame([(*key, s.tobytes(), i.tobytes())], columns=["block", "part", "scores", "ids"])

    schema = "block long, part int, scores binary, ids binary"
    lists = left.groupBy("column", "stripe").cogroup(right.groupBy("column", "stripe")).applyInPandas(cell, schema)
    parts = columns
    while parts > 1:
        parts = ceil(parts / FAN_IN)
        lists = lists.withColumn("part", F.pmod("part", F.lit(parts))).groupBy("block", "part").applyInPandas(merge, schema)
    return lists.select("block", "scores", "ids")


def _open(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One window without bounds for each anchor."""
    for b in batches:
        rows = b["vec_id"].map(len) // 8
        yield b.assign(low=[np.full(n, LOWEST, "<i8").tobytes() for n in rows], high=[np.full(n, HIGHEST, "<i8").tobytes() for n in rows])


def _bounded(least: int, most: int):
    """A window for each positive: least to most hundredths of its score; none where it is missing."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            low, high = [], []
            for s, i in zip(b["scores"], b["ids"], strict=True):
                p, there = np.frombuffer(s, np.int64).tolist(), np.frombuffer(i, np.int64) != NONE
                low.append(np.where(there, np.array([-((-least * x) // 100) for x in p], np.int64), 1).tobytes())
                high.append(np.where(there, np.array([most * x // 100 for x in p], np.int64), 0).tobytes())
            yield b.assign(low=low, high=high)
    return run


def _rows(positives: int, k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples():
                whose = np.repeat(np.frombuffer(r.vec_id, "<i8"), positives * k)
                read_as = lambda x: np.frombuffer(x, np.int64)
                out = pd.DataFrame({"anchor_id": whose, "positive_id": np.repeat(read_as(r.positive_ids), k),
                                    "rank": np.tile(np.arange(1, k + 1, dtype=np.int32), len(whose) // k), "negative_id": read_as(r.ids),
                                    "positive_score": np.repeat(read_as(r.positive_scores), k), "negative_score": read_as(r.scores)})
                yield out[out["negative_id"] != NONE]
    return run


# ------------------------------------------------------------------------------------------ whole
def mine(vectors: DataFrame, label: Column, every: int = 100, positives: int = 5, k: int = 10, least: int = 30, most: int = 90,
         scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows whose id is divisible by ``every``.  An anchor's positives are its
    ``positives`` best other rows of its label; for each of them, the k best rows of other labels
    whose scores are from ``least`` to ``most`` hundredths of the positive's."""
    rows = vectors.select(vectors[id_col].cast("long").alias("vec_id"), label.cast("long").alias("label"),
                          vectors[vector_col].cast("array<double>").alias("vec"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("vec")))
    blocks = stage(packed(rows, CANDIDATES_PER_BLOCK, scale, True), "threshold-blocks")
    anchors = stage(packed(rows.where(F.col("vec_id") % every == 0), ANCHORS_PER_BLOCK, scale, False), "threshold-anchors")
    fields = "block long, dim int, vec_id binary, label binary, vec binary, lists binary"
    first = stage(_grid(blocks, anchors.mapInPandas(_open, f"{fields}, low binary, high binary"), 1, positives, True), "threshold-positives")
    asked = anchors.join(first, "block").mapInPandas(
        _bounded(least, most), f"{fields}, scores binary, ids binary, low binary, high binary").drop("scores", "ids")
    second = stage(_grid(blocks, asked, positives, k, False), "threshold-negatives")
    unstage(blocks)
    known = first.select("block", F.col("scores").alias("positive_scores"), F.col("ids").alias("positive_ids"))
    return anchors.select("block", "vec_id").join(known, "block").join(second, "block").mapInPandas(
        _rows(positives, k), "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")


def oracle(every: int = 100, positives: int = 5, k: int = 10, least: int = 30, most: int = 90, scale: int = 256) -> str:
    """DuckDB SQL of the same rows, every anchor against every row."""
    return f"""
WITH v AS (SELECT vec_id, row_number() OVER () AS n, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)) AS w
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.n, c.vec_id, a.label = c.label AS same, list_inner_product(a.w, c.w)::BIGINT AS score
  FROM v a JOIN v c ON len(a.w) = len(c.w) AND a.vec_id % {every} = 0),
p AS (SELECT anchor_id, n, vec_id AS positive_id, score AS positive_score FROM s WHERE same AND vec_id <> anchor_id
  QUALIFY row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) <= {positives})
SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.n, positive_id ORDER BY score DESC, vec_id)::INT AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.n = p.n AND NOT same AND {least} * positive_score <= 100 * score AND 100 * score <= {most} * positive_score
QUALIFY rank <= {k}"""
