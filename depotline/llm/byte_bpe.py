"""Byte-level BPE through a sentencepiece model that is written straight from a rank file.

A rank file lists the byte strings of a vocabulary by rank.  ``serialise`` writes them as a
sentencepiece BPE model: each byte string becomes a piece of printable characters (one character
a byte), its score is the negative rank, and the normaliser leaves text as it is.  The highest
score merges first, so the model merges like the ranks do, and piece ids equal ranks.  Encoding
splits the text into pre-tokens, maps their bytes to characters and encodes each by itself;
decoding maps the pieces of the ids back to bytes.

Defined results: a null text counts as empty and has no ids; null ids stay null; repeated rows each
give their row; other columns of the input play no part; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import pandas as pd
from pyspark.sql import DataFrame

from depotline.llm.common import id_text, map_slices

#: Pre-tokens that a worker remembers at least before it forgets all, and the longest of them.
REMEMBERED, LONGEST = 200_000, 64
#: Texts whose ids are in memory at a time.
TOGETHER = 128


def byte_chars() -> list[str]:
    """A printable character for each byte: itself where it is printable, else one from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """The byte strings of a rank file, by rank; the ranks must be 0, 1, 2 and so on."""
    with open(path, "rb") as lines:
        pairs = sorted((int(rank), base64.b64decode(piece)) for piece, rank in (x.split() for x in lines if x.strip()))
    if [rank for rank, _ in pairs] != list(range(len(pairs))):
        raise ValueError("the ranks have gaps")
    return [piece for _, piece in pairs]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes(out + bytes([n]))


def _field(number: int, value: bytes | int | float) -> bytes:
    """One field in protocol-buffer wire format: bytes, whole number or 32-bit float."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def serialise(pieces: list[bytes]) -> bytes:
    """A sentencepiece model whose piece ids are the ranks; its unknown piece comes after them."""
    chars = byte_chars()
    # fixed values of the model format: fields of ModelProto 1 pieces, 2 trainer, 3 normalizer;
    # of a piece 1 text, 2 score, 3 type (1 normal, 2 unknown); trainer 3 model type (2: BPE),
    # 4 vocabulary size, 40 unknown id, 41-43 begin, end and padding id (-1: none);
    # normalizer 1 name, 3 dummy prefix, 4 extra spaces removed, 5 spaces escaped
    none = (1 << 64) - 1
    out = [_field(1, _field(1, "".join(chars[b] for b in p).encode()) + _field(2, -float(rank)) + _field(3, 1))
           for rank, p in enumerate(pieces)]
    out.append(_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2)))
    out.append(_field(2, _field(3, 2) + _field(4, len(pieces) + 1) + _field(40, len(pieces))
                      + b"".join(_field(k, none) for k in (41, 42, 43))))
    out.append(_field(3, _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)))
    return b"".join(out)


class Codec:
    """Encoder and decoder of one vocabulary, for use inside a task."""

    def __init__(self, ranks_path: str, pattern: str):
        import regex
        import sentencepiece

        self.pieces = read_ranks(ranks_path)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise(self.pieces))
        self.find = regex.compile(pattern).findall
        self.chars = dict(enumerate(byte_chars()))
        self.known: dict[str, tuple[int, ...]] = {}

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text.  Pre-tokens of the texts are encoded once each and remembered."""
        tokens = [self.find(t) for t in texts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known = self.known
        missing = [t for t in set(chain.from_iterable(tokens)) if t not in known]
        mapped = [t.encode().decode("latin-1").translate(self.chars) for t in missing]
        known.update(zip(missing, map(tuple, self.model.encode(mapped, num_threads=1)), strict=True))
        out = [list(chain.from_iterable(map(known.__getitem__, x))) for x in tokens]
        for t in missing:
            if len(t) > LONGEST:
                del known[t]
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids))


@lru_cache(maxsize=2)
def codec(ranks_path: str, pattern: str) -> Codec:
    return Codec(ranks_path, pattern)


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids array<int>: the token ids of each whole text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tool = codec(ranks_path, pattern)
        for b in batches:
            for at in range(0, len(b), TOGETHER):
                part = b.iloc[at : at + TOGETHER]
                yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy(), "ids": tool.encode(part["text"].tolist())})

    return map_slices(id_text(docs, id_col, text_col), run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, bytes binary: the bytes that the ids of each row stand for; null ids stand for none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tool = codec(ranks_path, pattern)
        for b in batches:
            texts = [tool.decode(list(ids)) if ids is not None else b"" for ids in b["ids"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "bytes": texts})

    return map_slices(encoded.select("doc_id", "ids"), run, "doc_id long, bytes binary")


def digests(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Round trip in one pass: doc_id, n_tokens, and SHA-256 of the ids (decimal, joined by one
    space) and of the bytes decoded from them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tool = codec(ranks_path, pattern)
        decimal = list(map(str, range(len(tool.pieces))))
        for b in batches:
            texts, out = b["text"].tolist(), []
            for at in range(0, len(texts), TOGETHER):
                for ids in tool.encode(texts[at : at + TOGETHER]):
                    shown = " ".join(map(decimal.__getitem__, ids)).encode()
                    out.append((len(ids), hashlib.sha256(shown).hexdigest(), hashlib.sha256(tool.decode(ids)).hexdigest()))
            done = pd.DataFrame(out, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
            yield done.assign(doc_id=b["doc_id"].to_numpy())

    return map_slices(id_text(docs, id_col, text_col), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
