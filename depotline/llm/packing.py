"""Packing of token sequences by vector bin packing.

Each document becomes its token ids and an end id, and is cut into pieces.  A sequence takes pieces
under three limits at once: tokens, number of segments, and tokens that bear loss (all but the first
of a piece, which nothing precedes).  Full-length pieces are sequences of their own.  Every other
piece waits in a block; a sequence is filled by taking, again and again, the waiting piece with the
largest dot product between its vector and the room left, among those that fit.  Where none fits, the
best piece is cut to the room left.  A block's last sequence goes on in the next block; what is left
at the end of a task is split into sequences whose lengths are powers of two, which need no padding.

Every task packs the documents it reads, block by block, so nothing is shuffled and a task holds one
block.  Results depend on how the input is split into tasks, but every id is in exactly one piece.

Defined results: a null text counts as empty and yields the end id only; null and repeated document
ids are passed on, row by row; other columns play no part; an empty table gives an empty table.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame

from depotline.llm.common import id_text, map_slices

#: Pieces that wait in a task at a time.
BLOCK = 1024
#: Room smaller than this stays padding; larger room is filled by cutting a piece.
LEAST_CUT = 8
#: Rows and bytes of ids that a task holds until it hands them on.
FLUSH_ROWS, FLUSH_BYTES = 4096, 4 << 20
#: Columns that tell of the pieces without their ids.
DIGEST = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


class Limits(NamedTuple):
    """Limits of one sequence; ``loss`` of None stands for all tokens but one."""

    tokens: int = 2048
    segments: int = 256
    loss: int | None = None

    def vector(self) -> np.ndarray:
        return np.array([self.tokens, self.segments, self.tokens - 1 if self.loss is None else self.loss], float)


class Piece(NamedTuple):
    doc: int  # number of the document in its task
    start: int
    ids: np.ndarray


@lru_cache(maxsize=2)
def vocabulary(path: str, pattern: str, added: bool = False) -> Callable[[str], np.ndarray]:
    """Text to ids for a byte-level BPE vocabulary file of the tokenizers library.

    The file's ids are the order of its merges, so its vocabulary serves as rank table.  With ``added``
    a text is split at the file's added tokens first, which yield their own ids, as the library does by
    default; without, their strings are ordinary text (the library's ``encode_special_tokens``)."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte_of = {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(sorted(set(range(256)) - set(shown)))}
    special = {t["content"]: t["id"] for t in file["added_tokens"]}
    if added and any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in file["added_tokens"]):
        raise ValueError(f"{path}: added tokens that take in blanks or only stand for whole words are not supported")
    if added and any(a != b and a in b for a in special for b in special):
        raise ValueError(f"{path}: added tokens that hold each other are not supported")
    ranks = {bytes(byte_of[c] for c in piece): rank for piece, rank in file["model"]["vocab"].items() if piece not in special}
    tool = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special if added else {})
    return lambda text: tool.encode_to_numpy(text, allowed_special="all", disallowed_special=())


def _loss(length: np.ndarray | int):
    return np.maximum(length - 1, 0)


class _Block:
    """Pieces that wait, and the sequence being filled."""

    def __init__(self, limits: np.ndarray):
        self.limits = limits
        self.waiting: list[Piece] = []
        self.open: list[Piece] = []
        self.room = limits.copy()

    def fill(self, last: bool) -> Iterator[list[Piece]]:
        """Finished sequences.  Unless ``last``, the one that runs out of pieces stays open."""
        pieces, limits = self.waiting, self.limits
        sizes = np.array([len(p.ids) for p in pieces], float)
        alive = len(pieces)
        while alive:
            tokens, segments, loss = self.room
            fits = (sizes > 0) & (sizes <= tokens) & (_loss(sizes) <= loss) & (segments >= 1)
            weight = self.room / limits**2
            gain = sizes * weight[0] + weight[1] + _loss(sizes) * weight[2]  # dot product with the room, in units of the limits
            if fits.any():
                k = int(np.where(fits, gain, -1.0).argmax())
                self._place(pieces[k])
                sizes[k], alive = 0, alive - 1
                continue
            room = int(min(tokens, loss + 1))
            if segments >= 1 and room >= LEAST_CUT:
                k = int(np.where(sizes > 0, gain, -1.0).argmax())
                whole = pieces[k]
                self._place(Piece(whole.doc, whole.start, whole.ids[:room]))
                pieces[k] = Piece(whole.doc, whole.start + room, whole.ids[room:])
                sizes[k] = len(pieces[k].ids)
            yield self._close()
        self.waiting = []
        if self.room[0] == 0:
            yield self._close()
        if last and self.open:
            yield from _powers(self._close())

    def _place(self, piece: Piece) -> None:
        self.open.append(piece)
        self.room = self.room - (len(piece.ids), 1, _loss(len(piece.ids)))

    def _close(self) -> list[Piece]:
        done, self.open, self.room = self.open, [], self.limits.copy()
        return done


def _powers(pieces: list[Piece]) -> Iterator[list[Piece]]:
    """The pieces cut into sequences whose lengths are falling powers of two."""
    total = sum(len(p.ids) for p in pieces)
    rest = list(reversed(pieces))
    while total:
        want = 1 << (total.bit_length() - 1)
        total -= want
        out = []
        while want:
            p = rest.pop()
            if len(p.ids) > want:
                rest.append(Piece(p.doc, p.start + want, p.ids[want:]))
                p = Piece(p.doc, p.start, p.ids[:want])
            want -= len(p.ids)
            out.append(p)
        yield out


def pack_texts(texts: Iterator[str], encode: Callable[[str], np.ndarray], end_id: int,
               limits: Limits, block: int = BLOCK) -> Iterator[tuple[list[Piece], dict[int, int]]]:
    """Sequences of one task, with the token counts of the documents in them."""
    wait, longest = _Block(limits.vector()), int(limits.tokens)
    full = min(longest, int(limits.vector()[2]) + 1)
    sizes: dict[int, int] = {}

    def out(pieces: list[Piece]):
        return pieces, {p.doc: sizes[p.doc] for p in pieces}

    for doc, text in enumerate(texts):
        ids = np.append(encode(text), np.uint32(end_id)).astype("<u4")
        sizes[doc] = len(ids)
        cut = len(ids) - len(ids) % full
        for start in range(0, cut, full):
            yield out([Piece(doc, start, ids[start : start + full])])
        if cut < len(ids):
            wait.waiting.append(Piece(doc, cut, ids[cut:].copy()))
        if len(wait.waiting) >= block:
            yield from map(out, list(wait.fill(last=False)))
            sizes = {p.doc: sizes[p.doc] for p in wait.open}
    yield from map(out, list(wait.fill(last=True)))


def pack(docs: DataFrame, vocabulary_path: str, pattern: str, end_id: int = 1, limits: Limits = Limits(),
         id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and the
    ids as little-endian 32-bit numbers where asked for."""
    schema = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
              + ", ids binary" * with_ids)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = vocabulary(vocabulary_path, pattern, added=True)
        names: dict[int, int | None] = {}

        def texts() -> Iterator[str]:
            n = 0
            for b in batches:
                for doc_id, text in zip(b["doc_id"].astype("Int64"), b["text"], strict=True):
                    names[n] = None if doc_id is pd.NA else int(doc_id)
                    n += 1
                    yield text

        first = TaskContext.get().partitionId() << 40
        rows: list[tuple] = []
        held = 0
        frame = lambda: pd.DataFrame(rows, columns=[x.split()[0] for x in schema.split(", ")]).astype({"doc_id": "Int64"})
        for k, (pieces, sizes) in enumerate(pack_texts(texts(), encode, end_id, limits)):
            at = 0
            held += sum(p.ids.nbytes for p in pieces) * with_ids
            for p in pieces:
                raw = p.ids.tobytes()
                rows.append((names[p.doc], p.start, len(p.ids), zlib.crc32(raw), sizes[p.doc], first + k, at) + (raw,) * with_ids)
                at += len(p.ids)
            if len(rows) >= FLUSH_ROWS or held >= FLUSH_BYTES:
                yield frame()
                rows, held = [], 0
        if rows:
            yield frame()

    return map_slices(id_text(docs, id_col, text_col), run, schema)
