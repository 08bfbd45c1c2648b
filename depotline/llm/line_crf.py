"""Document quality from a linear-chain conditional random field over lines.

Every line of a text is good or bad.  A line's features are shape measures of itself and of the lines
before and after it; transition weights tie neighbouring labels.  Forward and backward sums give each
line's probability of being good, and a document's score is their mean weighted by line length.

The field is trained on a bounded sample of labelled documents: of ``sample`` ids, those with the
smallest hashes, the documents of up to ``longest`` characters.  Both are parameters and bound what the
driver holds while it trains; their lines all carry the document's label.  Only the text is an input
of a score.

Defined results: blank lines do not count; a text without other lines (null texts too) scores 0;
without any labelled row every other text scores 0.5; rows with null ids are scored and not held out;
repeated rows each give their row; of contradictory labels of one id the lower counts; other columns
play no part; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from depotline.llm.common import release, text_of, text_slices

#: Defaults of the most labelled documents that the field is trained on, and the longest of them, in characters.
SAMPLE, LONGEST = 4000, 20_000
STEPS, RATE, DECAY = 200, 0.08, 1e-4
#: Every FOLDS-th id by CRC-32 is held out from training.
FOLDS = 5

_UPPER, _DIGIT, _STOP = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:?'\"()-"
_SIGN = bytes(c for c in range(33, 127) if not chr(c).isalnum() and c not in _STOP)
_HIGH = bytes(range(128, 256))
OWN = 12


def line_features(line: str, before: set[str]) -> tuple[float, ...]:
    """Shape measures of a line, each from 0 to about 1; ``before`` holds the text's earlier lines."""
    words, raw = line.split(), line.encode()
    n, size = len(words), len(raw)
    share = lambda chars: (size - len(raw.translate(None, chars))) / size
    lengths = list(map(len, words))
    return (min(n, 400) ** 0.5 / 20, 1 - len(set(words)) / n, sum(map(eq, words, words[1:])) / n, share(_UPPER), share(_SIGN),
            share(_DIGIT), share(_STOP), share(_HIGH), min(sum(lengths) / n, 24) / 12, sum(x < 4 for x in lengths) / n,
            lengths.count(1) / n, float(line in before))


def text_lines(text: str) -> tuple[list[tuple[float, ...]], list[int]]:
    """Features and lengths of a text's lines."""
    rows, lengths, seen = [], [], set()
    for line in text.split("\n"):
        if line.split():
            rows.append(line_features(line, seen))
            lengths.append(len(line))
            seen.add(line)
    return rows, lengths


class Lines(NamedTuple):
    """Lines of several documents, one after the other: features with those of both neighbours,
    lengths, and the number of lines by document."""

    inputs: np.ndarray
    lengths: np.ndarray
    counts: np.ndarray


def gather(texts: list[str]) -> Lines:
    found = [text_lines(t) for t in texts]
    own = np.array([r for rows, _ in found for r in rows], float).reshape(-1, OWN)
    counts = np.array([len(rows) for rows, _ in found], np.int64)
    first = np.zeros(len(own), bool)
    first[(np.cumsum(counts) - counts)[counts > 0]] = True
    last = np.roll(first, -1)
    up, down = np.roll(own, 1, axis=0), np.roll(own, -1, axis=0)
    up[first], down[last] = 0, 0
    inputs = np.concatenate([np.ones((len(own), 1)), first[:, None], last[:, None], own, up, down], axis=1)
    return Lines(inputs, np.array([n for _, lengths in found for n in lengths], float), counts)


class Field(NamedTuple):
    """Weights of the inputs for a good line, and of transitions from one label to the next."""

    weights: np.ndarray
    moves: np.ndarray


def empty_field() -> Field:
    return Field(np.zeros(3 + 3 * OWN), np.zeros((2, 2)))


class Chains(NamedTuple):
    """Results of both passes: probability of good by line, sum over documents of log totals, and
    expected transitions."""

    good: np.ndarray
    total: float
    moves: np.ndarray


def run_chains(field: Field, lines: Lines) -> Chains:
    """Forward and backward sums of all documents in step, longest first."""
    unary = np.zeros((len(lines.inputs), 2))
    unary[:, 1] = lines.inputs @ field.weights
    order = np.argsort(-lines.counts, kind="stable")
    counts = lines.counts[order]
    start = (np.cumsum(lines.counts) - lines.counts)[order]
    steps = int(counts[0]) if len(counts) else 0
    alive = [int(np.searchsorted(-counts, -t, side="left")) for t in range(steps)]  # documents of over t lines
    forward, backward = np.zeros_like(unary), np.zeros_like(unary)
    for t in range(steps):
        at = start[: alive[t]] + t
        forward[at] = unary[at]
        if t:
            forward[at] += np.logaddexp.reduce(forward[at - 1][:, :, None] + field.moves, axis=1)
    for t in range(steps - 1, 0, -1):
        at = start[: alive[t]] + t
        backward[at - 1] = np.logaddexp.reduce(field.moves + (unary[at] + backward[at])[:, None, :], axis=2)
    both = forward + backward
    total = np.logaddexp(both[:, 0], both[:, 1])
    moves = np.zeros((2, 2))
    for t in range(1, steps):
        at = start[: alive[t]] + t
        pair = forward[at - 1][:, :, None] + field.moves + (unary[at] + backward[at])[:, None, :] - total[at][:, None, None]
        moves += np.exp(pair).sum(axis=0)
    return Chains(np.exp(both[:, 1] - total), float(total[start[counts > 0]].sum()), moves)


def train(lines: Lines, good: np.ndarray) -> Field:
    """Weights that make the labels likely: gradient steps with momentum and scaling (Adam)."""
    if not len(lines.inputs):
        return empty_field()
    label = np.repeat(good, lines.counts).astype(float)
    held = np.zeros((2, 2))
    for y in (0, 1):
        held[y, y] = np.maximum(lines.counts[good == y] - 1, 0).sum()
    width = lines.inputs.shape[1]
    weights, first, second = np.zeros(width + 4), np.zeros(width + 4), np.zeros(width + 4)
    for step in range(1, STEPS + 1):
        field = Field(weights[:width], weights[width:].reshape(2, 2))
        chains = run_chains(field, lines)
        slope = np.concatenate([lines.inputs.T @ (label - chains.good), (held - chains.moves).ravel()]) / len(label) - DECAY * weights
        first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope**2
        weights = weights + RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return Field(weights[:width], weights[width:].reshape(2, 2))


def score_texts(field: Field, texts: list[str]) -> np.ndarray:
    """Score of each text: mean probability of its lines to be good, weighted by length."""
    lines = gather(texts)
    if not len(lines.lengths):
        return np.zeros(len(texts))
    doc = np.repeat(np.arange(len(texts)), lines.counts)
    good = np.bincount(doc, run_chains(field, lines).good * lines.lengths, len(texts))
    size = np.bincount(doc, lines.lengths, len(texts))
    return np.clip(np.divide(good, size, out=np.zeros(len(texts)), where=size > 0), 0, 1)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("long").cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
        sample: int = SAMPLE, longest: int = LONGEST) -> Field:
    """The field of a bounded sample of the labelled documents that are not held out: at most ``sample``
    of them, those of more than ``longest`` characters left out."""
    marks = labels.select(labels[id_col].cast("long").alias("id"), labels[label_col].cast("int").alias("good"))
    marks = marks.where(F.col("id").isNotNull() & F.col("good").isin(0, 1) & ~held_out(F.col("id")))
    chosen = marks.groupBy("id").agg(F.min("good").alias("good")).orderBy(F.xxhash64("id"), "id").limit(sample)
    text = text_of(docs, text_col)
    rows = docs.select(docs[id_col].cast("long").alias("id"), text.alias("text")).where(F.length("text") <= longest)
    found = rows.join(F.broadcast(chosen), "id")  # at most ``sample`` rows
    # rows that repeat a document could make the sample large: the least text of each id, and whole tasks only reduce
    got = found.groupBy("id").agg(F.min("text").alias("text"), F.min("good").alias("good")).orderBy("id").toPandas()
    return train(gather(got["text"].tolist()), got["good"].to_numpy(int))


def scorer(field: Field):
    """Column function: text to score."""
    @F.arrow_udf(T.DoubleType())
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            yield pa.array(np.concatenate([np.zeros(0), *(score_texts(field, t) for t in text_slices(b))]))
        release()
    return score


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "quality", sample: int = SAMPLE, longest: int = LONGEST) -> DataFrame:
    """One row a document: doc_id, held_out, score (0 to 1) and predicted (1 from the threshold on)."""
    field = fit(docs, labels, id_col, text_col, label_col, sample, longest)
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), scorer(field)(text_of(docs, text_col)).alias("score"))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                       (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text",
              label_col: str = "quality", sample: int = SAMPLE, longest: int = LONGEST) -> DataFrame:
    """``docs`` without the documents that score below the threshold; rows and columns as they are."""
    field = fit(docs, labels, id_col, text_col, label_col, sample, longest)
    return docs.where(scorer(field)(text_of(docs, text_col)) >= threshold)
