"""Removal of repeated passages by difference-cover anchors.

A window is WINDOW consecutive words.  A word goes if some window over it starts in a document with a
smaller id too; windows are judged on the input, not on what is left.

Places of a document are anchors where their number modulo PERIOD is in COVER, a difference cover:
for any two places i and j some step d < PERIOD brings both i + d and j + d onto anchors.  Windows of
equal words, wherever they start, therefore share an aligned anchor, and with it the ANCHOR words from
there on, which all lie inside both.  So only the words at anchors are hashed, one place in five:

1. Each anchor is a row: the hash of its ANCHOR words, and of its context, all words of the windows
   that hold it (cut at the document's ends).  The rows are dealt by ranges of (hash, context, id) and
   sorted, so that equal hashes lie side by side, and a hash held by a third of all rows is spread over
   as many tasks as it needs.
2. Read in order, an anchor whose context stands in a smaller id is settled: every window that holds it
   is repeated.  Where all anchors of a hash have one context, nothing is left to ask of them.  The
   first and last hash of a range may go on in the next, so all their unsettled anchors are asked for.
3. Unsettled anchors of hashes with several contexts extend: their windows, but those in a settled
   context, become rows of two 64-bit hashes.  Take a window and the smallest id that has it: it is never
   settled, and any other document that has the window shares an aligned anchor with it, whose contexts
   are equal (the other is settled) or not (both ask for the window).  The least id by window is taken with map-side sums; windows held by more than one of
   HOT_SHARE rows, fewer than HOT_SHARE of them, are looked up by broadcast and all others by a join.
4. Runs of settled words and repeated windows meet their documents, and the other words are kept.

Equality of windows is that of 128 bits of two independent hashes.

Defined results: null and empty texts have no words; texts of fewer than WINDOW words are kept whole.
Rows without an id are kept whole and are no source of others' passages; rows that repeat an id are no
source for each other, and each gives its row.  An empty table gives an empty table; other columns
play no part.  Kept words are joined by one space; a text of which nothing is removed is so too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depotline.llm.common import release, slice_ends, text_of
from depotline.session import stage, unstage

WINDOW = 50
#: A perfect difference set: every number modulo PERIOD is the difference of two of them.
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)
#: Words hashed at an anchor; a window holds them wherever the anchor is within PERIOD places of its start.
ANCHOR = WINDOW - PERIOD + 1
#: Windows held by more than one of so many rows are looked up by broadcast: fewer than this number.
HOT_SHARE = 10_000

_IS_ANCHOR = np.isin(np.arange(PERIOD), COVER)
_BASE = np.random.default_rng(12).integers(1, 1 << 63, 2, dtype=np.uint64) | np.uint64(1)
_INVERSE = np.array([pow(int(b), -1, 1 << 64) for b in _BASE], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Bits of each number stirred, one to one (a public 64-bit finaliser)."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Digests(dict):
    """128-bit hashes of words, remembered; emptied between batches when large."""

    def __missing__(self, word: bytes) -> bytes:
        self[word] = out = xxhash.xxh3_128_digest(word)
        return out


class Stream:
    """The words of several texts one after another; hashes of any runs of them."""

    def __init__(self, texts: list[list[bytes]], digests: Digests) -> None:
        self.sizes = np.array([len(t) for t in texts], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        raw = np.frombuffer(b"".join(digests[w] for t in texts for w in t), "<u8").reshape(-1, 2)
        self.sums, self.turns = [], []
        for half in range(2):
            powers = np.full(len(raw) + 1, _BASE[half])
            turns = np.full(len(raw) + 1, _INVERSE[half])
            powers[0] = turns[0] = 1
            np.multiply.accumulate(powers, out=powers)
            np.multiply.accumulate(turns, out=turns)
            self.sums.append(np.concatenate([np.zeros(1, np.uint64), np.cumsum(raw[:, half] * powers[:-1])]))
            self.turns.append(turns)

    def runs(self, first: np.ndarray, last: np.ndarray, half: int) -> np.ndarray:
        """Hashes of the words from first up to but not last, by their places in the stream."""
        return mix((self.sums[half][last] - self.sums[half][first]) * self.turns[half][first])


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[list[bytes]]]]:
    """Batches in slices of bounded rows and bytes of text, with the words of each text."""
    for b in batches:
        for at, end in slice_ends([b.column("text")]):
            part = b.slice(at, end - at)
            yield part, [t.split() for t in part.column("text").to_pylist()]  # of bytes: blanks 0x20 and 0x09 to 0x0D only
    release()


def _contexts(place: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last (exclusive) words of all windows that hold the anchors at these places of texts
    of these sizes."""
    return np.maximum(place - (PERIOD - 1), 0), np.minimum(place + WINDOW, size)


# -------------------------------------------------------------------------------------------- anchors
def anchors(rows: DataFrame) -> DataFrame:
    """hash, context, doc, row, place of the anchors of texts that have a window."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digests = Digests()
        for part, texts in slices(batches):
            s = Stream(texts, digests)
            text = np.repeat(np.arange(len(texts)), s.sizes)
            place = np.arange(len(text)) - s.starts[text]
            at = np.flatnonzero(_IS_ANCHOR[place % PERIOD] & (place + ANCHOR <= s.sizes[text]) & (s.sizes[text] >= WINDOW))
            text, place = text[at], place[at]
            first, last = _contexts(place, s.sizes[text])
            extent = ((place - first) * (WINDOW + 1) + last - place).astype(np.uint64)
            context = mix(s.runs(s.starts[text] + first, s.starts[text] + last, 1) + mix(extent))
            names = {"hash": s.runs(at, at + ANCHOR, 0).view(np.int64), "context": context.view(np.int64),
                     "doc": part.column("doc").to_numpy()[text], "row": part.column("row").to_numpy()[text], "place": place.astype(np.int32)}
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in names.values()], names=list(names))
            if len(digests) > 100_000:
                digests.clear()

    return rows.where(F.col("doc").isNotNull()).mapInArrow(run, "hash long, context long, doc long, row long, place int")


def settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc, row, code of the anchors that matter, from rows in the order of (hash, context, doc); the
    code is twice the place, and one more where the context stands in a smaller id.  Of the others only
    those of hashes with several contexts are returned, and all of the first and last hash read."""
    hash_ = context = least = None  # of the last row; least: the first id of its context
    contexts, first_hash = 0, True  # contexts of the last row's hash so far, and whether it is the first hash read
    waiting: list[tuple[np.ndarray, ...]] = []  # rows of the last hash that matter if it has another context

    def batch(rows: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*rows, strict=True)], names=["doc", "row", "code"])

    for b in batches:
        if not b.num_rows:
            continue
        h, c, doc, row, place = (b.column(n).to_numpy() for n in ("hash", "context", "doc", "row", "place"))
        new_hash, new = np.ones(len(h), bool), np.ones(len(h), bool)
        new_hash[1:] = h[1:] != h[:-1]
        new[1:] = new_hash[1:] | (c[1:] != c[:-1])
        new_hash[0] = hash_ is None or h[0] != hash_
        new[0] = new_hash[0] or c[0] != context
        start = np.maximum.accumulate(np.where(new, np.arange(len(h)), -1))
        low = np.where(start < 0, doc[0] if least is None else least, doc[np.maximum(start, 0)])
        group = np.cumsum(new_hash)  # 0: the hash of the last batch's last row
        each = np.bincount(group, new, group[-1] + 1).astype(np.int64)
        each[0] += contexts
        matters = each > 1
        if waiting and (matters[0] or group[-1] and first_hash):
            yield batch(waiting)
        if matters[0] or group[-1]:
            waiting = []
        if first_hash:  # group 1 is the first hash of all in the first batch, else group 0 is
            matters[1 if hash_ is None else 0] = True
        less = doc > low
        code = 2 * place.astype(np.int64) + less
        out = less | matters[group]
        if out.any():
            yield batch([(doc[out], row[out], code[out])])
        later = ~out & (group == group[-1])
        if later.any():
            waiting.append((doc[later], row[later], code[later]))
        first_hash = first_hash and group[-1] == (1 if hash_ is None else 0)
        hash_, context, least, contexts = h[-1], c[-1], low[-1], int(each[-1])
    if waiting:
        yield batch(waiting)


# -------------------------------------------------------------------------------------------- windows
def _starts_of(codes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Which windows of a text (by start) hold a settled anchor, and which hold another and no settled one."""
    n = size - WINDOW + 1
    marks = []
    for kind in (codes % 2 == 1, codes % 2 == 0):
        place = codes[kind] // 2
        edge = np.zeros(n + 1, np.int64)
        np.add.at(edge, np.maximum(place - (PERIOD - 1), 0), 1)
        np.add.at(edge, np.minimum(place + 1, n), -1)
        marks.append(np.cumsum(edge[:n]) > 0)
    return marks[0], marks[1] & ~marks[0]


def _runs(mark: np.ndarray) -> list[int]:
    """First and last (exclusive) places of the runs of marked ones, one after another."""
    return np.flatnonzero(np.diff(np.concatenate([[0], mark.astype(np.int8), [0]]))).tolist()


def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc, row, runs of starts of repeated windows, and the windows to ask for: starts and two hashes."""
    digests = Digests()
    for part, texts in slices(batches):
        s = Stream(texts, digests)
        out = []
        for t, codes in enumerate(part.column("codes")):
            known, ask = _starts_of(codes.values.to_numpy(), int(s.sizes[t]))
            at = np.flatnonzero(ask)
            first = s.starts[t] + at
            out.append((_runs(known), at, *(s.runs(first, first + WINDOW, half).view(np.int64) for half in range(2))))
        runs, at, one, two = zip(*out, strict=True)
        yield pa.RecordBatch.from_arrays(
            [part.column("doc"), part.column("row"), pa.array(runs, pa.list_(pa.int64())), pa.array(at, pa.list_(pa.int64())),
             pa.array(one, pa.list_(pa.int64())), pa.array(two, pa.list_(pa.int64()))], names=["doc", "row", "runs", "at", "one", "two"])
        if len(digests) > 100_000:
            digests.clear()


def repeated(asked: DataFrame) -> DataFrame:
    """doc, row, starts of the windows asked for that start in a smaller id too."""
    total = asked.agg(F.sum(F.size("at"))).first()[0] or 0
    each = asked.select("doc", "row", F.inline(F.arrays_zip("at", "one", "two")))
    least = stage(each.groupBy("one", "two").agg(F.min("doc").alias("least"), F.count("*").alias("rows")).where("rows > 1"), "cover-least")
    is_hot = F.col("rows") > total / HOT_SHARE
    hot = least.where(is_hot).select("one", "two", F.col("least").alias("hot_least"))  # fewer than HOT_SHARE rows
    dealt = each.join(F.broadcast(hot), ["one", "two"], "left")
    common = dealt.where("hot_least < doc").select("doc", "row", "at")
    rest = dealt.where("hot_least IS NULL").join(least.where(~is_hot), ["one", "two"]).where("least < doc").select("doc", "row", "at")
    return common.unionByName(rest).groupBy("doc", "row").agg(F.collect_list("at").alias("starts"))  # of one text


# -------------------------------------------------------------------------------------------- whole
def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, texts in slices(batches):
        gone, left = [], []
        for words, runs, starts in zip(texts, part.column("runs"), part.column("starts"), strict=True):
            edge = np.zeros(len(words) + 1, np.int64)
            if runs.is_valid:
                ends = runs.values.to_numpy()
                np.add.at(edge, ends[::2], 1)
                np.add.at(edge, ends[1::2] - 1 + WINDOW, -1)
            if starts.is_valid:
                at = starts.values.to_numpy()
                np.add.at(edge, at, 1)
                np.add.at(edge, at + WINDOW, -1)
            off = np.cumsum(edge[:-1]) > 0
            gone.append(int(off.sum()))
            left.append(b" ".join(w for w, o in zip(words, off.tolist(), strict=True) if not o) if gone[-1] else b" ".join(words))
        yield pa.RecordBatch.from_arrays([part.column("doc"), pa.array([len(t) for t in texts], pa.int64()), pa.array(gone, pa.int64()),
                                          pa.array(left, pa.binary())], names=["doc_id", "n_words", "n_removed", "kept"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, n_words, n_removed and kept (the words left, joined by one space)."""
    text, doc = text_of(docs, text_col), docs[id_col].cast("long").alias("doc")
    # texts of one id are told apart by their hashes; where no id repeats, a constant takes less room in every row
    repeats = not docs.select(doc).where("doc IS NOT NULL").groupBy("doc").count().where("count > 1").isEmpty()
    row = F.xxhash64(text) if repeats else F.lit(0).cast("long")
    rows = docs.select(doc, row.alias("row"), text.cast("binary").alias("text"))
    order = ["hash", "context", "doc", "row", "place"]
    found = stage(anchors(rows), "cover-anchors")
    marks = (found.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(settled, "doc long, row long, code long")
             .groupBy("doc", "row").agg(F.collect_list("code").alias("codes")))  # of one text
    lists = "array<long>"
    asked = stage(rows.join(marks, ["doc", "row"]).select("doc", "row", "text", "codes").mapInArrow(
        windows, f"doc long, row long, runs {lists}, at {lists}, one {lists}, two {lists}"), "cover-windows")
    unstage(found)
    flags = asked.groupBy("doc", "row").agg(F.first("runs").alias("runs")).join(repeated(asked.where("size(at) > 0")), ["doc", "row"], "left")
    flags = flags.where("size(runs) > 0 OR starts IS NOT NULL")
    out = rows.join(flags, ["doc", "row"], "left").select("doc", "text", "runs", "starts").mapInArrow(
        _kept, "doc_id long, n_words long, n_removed long, kept binary")
    return out.withColumn("kept", F.col("kept").cast("string"))


def oracle() -> str:
    """DuckDB SQL of the query's rows, over all windows."""
    return f"""
WITH d AS (SELECT row_number() OVER () AS n, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT n, doc_id, i, md5(array_to_string(list_slice(w, i, i + {WINDOW - 1}), ' ')) AS h
  FROM (SELECT n, doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM d WHERE doc_id IS NOT NULL AND len(w) >= {WINDOW})),
r AS (SELECT n, i FROM (SELECT n, i, doc_id, min(doc_id) OVER (PARTITION BY h) AS least FROM s) WHERE least < doc_id),
gone AS (SELECT n, list(DISTINCT j) AS js FROM (SELECT n, unnest(range(i, i + {WINDOW})) AS j FROM r) GROUP BY n),
k AS (SELECT d.n, doc_id, len(w) AS n_words, coalesce(len(js), 0) AS n_removed,
             CASE WHEN js IS NULL THEN array_to_string(w, ' ') ELSE '' END AS whole FROM d LEFT JOIN gone USING (n)),
p AS (SELECT n, string_agg(word, ' ' ORDER BY j) AS kept FROM (
        SELECT d.n, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS j FROM d JOIN gone USING (n)) x
      WHERE NOT EXISTS (SELECT 1 FROM (SELECT n, unnest(js) AS j FROM gone) g WHERE g.n = x.n AND g.j = x.j) GROUP BY n)
SELECT doc_id, n_words::BIGINT AS n_words, n_removed::BIGINT AS n_removed, sha256(coalesce(kept, whole)) AS kept_sha256
FROM k LEFT JOIN p USING (n)"""
