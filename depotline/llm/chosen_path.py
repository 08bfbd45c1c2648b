"""Near-duplicate detection by a chosen-path set similarity join.

A document's set holds its distinct shingles of five words.  Documents with equal sets form a class,
and one of them stands for it.  A class has ``TOKENS`` minwise tokens.  Each of ``TREES`` independent
trees sends it down paths: a node chooses one or two token places (4/3 on average, one over the
similarity sought) by its own hash, and a class goes on to the child named by its token there.  Nodes
of one class are dropped.  From ``FIRST`` tokens on, nodes of up to ``SMALL`` classes are compared
exhaustively on their tokens; larger ones branch on, down to ``DEEPEST`` tokens.

Comparing classes on their tokens yields candidates, which are confirmed on the full sets.  What is
asked for are connected components, so pairs are taken in two rounds.  The first takes each class's
best partner and its smallest very likely one, which ties a group of copies together without listing
its pairs.  The second covers every candidate pair whose ends are still in different components: such
components form clusters, the classes of a cluster bring their full sets together, and those outside
its largest component are compared with all others in memory; a class keeps one link for each
component it reaches.  Nodes and clusters too large for one task are dealt in chunks: the first round
adds the node's smallest class to each chunk, the second has every chunk of classes outside the main
component meet every chunk.

Two classes of similarity 0.75 share a node of a given tree in about half of all cases.  They escape
all 16 trees in about 2 of 100,000 cases where nodes are compared at FIRST, and, as nodes of more than
SMALL classes branch on, in up to 7 of 10,000 at DEEPEST; more similar ones escape less often.

Defined results: null texts count as empty; a text without words has an empty set and is linked with
nothing; a text of one to four words has one shingle, all its words.  Repeated rows have equal sets
and are linked.  Rows without a doc_id take part; they are never the smallest id while another is in
their component, and a component of such rows only has a null id.  Other columns play no part in the
decisions; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depotline.llm.common import HOT_SHARE, map_slices, release, spread_join, text_of
from depotline.session import stage, unstage

WORDS = 5
#: Similarity sought, as shared * PARTS >= all * SHARE.
PARTS, SHARE = 100, 75
TOKENS, TREES, FIRST, DEEPEST = 64, 16, 3, 5
SMALL, CHUNK = 256, 512
#: Shingles that the classes of a chunk have on average at most, where their full sets are compared.
CHUNK_SHINGLES = 1 << 20
#: Equal tokens from which a pair becomes a candidate.  At similarity 0.75 a pair has fewer in about
#: one of 100,000 cases.
EQUAL_TOKENS = 32
#: Equal tokens from which a pair is very likely similar enough.
SURE_TOKENS = 52

_RANDOM = np.random.default_rng(5)
_FACTORS = _RANDOM.integers(1, 1 << 63, WORDS, dtype=np.uint64) | np.uint64(1)
_SHORT = _RANDOM.integers(1, 1 << 63, 1, dtype=np.uint64)[0]
_MASKS = _RANDOM.integers(1, 1 << 63, TOKENS, dtype=np.uint64)
_TURNS = _RANDOM.integers(1, 1 << 63, TOKENS, dtype=np.uint64) | np.uint64(1)
_ROOTS = _RANDOM.integers(1, 1 << 63, TREES, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Bits of each number stirred, one to one (a public 64-bit finaliser)."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


# ------------------------------------------------------------------------------------------- sets
class Words(dict):
    """Hashes of words, remembered; emptied between batches when large."""

    def __missing__(self, word: bytes) -> int:
        self[word] = out = xxhash.xxh3_64_intdigest(word)
        return out


def shingles(text: str, words: Words) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    parts = text.encode().lower().split()  # of bytes: A-Z, and blanks 0x20 and 0x09 to 0x0D only
    w = np.fromiter(map(words.__getitem__, parts), np.uint64, len(parts))
    if not len(w):
        return w
    if len(w) < WORDS:
        return mix(np.append(w * _FACTORS[: len(w)], _SHORT * _FACTORS[len(w) : len(w) + 1]).sum(keepdims=True))
    n = len(w) - WORDS + 1
    return np.unique(mix(sum(w[i : i + n] * _FACTORS[i] for i in range(WORDS))))


def tokens(hashes: np.ndarray) -> np.ndarray:
    """Minwise tokens of a set: for each of TOKENS orders the smallest member, as 32 bits."""
    low = np.full(TOKENS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 2048):
        low = np.minimum(low, ((hashes[at : at + 2048, None] ^ _MASKS) * _TURNS).min(axis=0))
    return (low >> np.uint64(32)).astype("<u4")


def sketch(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """rid (a number for each row), doc_id, text_hash, n_shingles, set_key (null: empty set), tokens,
    and bytes (the lowest byte of each token)."""
    text = text_of(docs, text_col)
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = Words()
        for b in batches:
            out = []
            for t in b["text"]:
                s = shingles(t, words)
                if len(s):
                    m = tokens(s)
                    out.append((len(s), xxhash.xxh3_128_digest(s.tobytes()), m.tobytes(), m.astype(np.uint8).tobytes()))
                else:
                    out.append((0, None, None, None))
            if len(words) > 100_000:
                words.clear()
            done = pd.DataFrame(out, columns=["n_shingles", "set_key", "tokens", "bytes"])
            yield done.assign(doc_id=b["doc_id"].to_numpy(), text_hash=b["text_hash"].to_numpy())

    schema = "doc_id long, text_hash long, n_shingles long, set_key binary, tokens binary, bytes binary"
    return map_slices(rows, run, schema).withColumn("rid", F.monotonically_increasing_id())


# ------------------------------------------------------------------------------------------ trees
def branch(path: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Children of nodes: rows of ``token`` that go on, and the paths they go to."""
    row = np.arange(len(path))
    first = mix(path ^ np.uint64(0x51))
    place = first % np.uint64(TOKENS)
    more = np.flatnonzero((first >> np.uint64(32)) % np.uint64(3) == 0)  # one node of three chooses a second place
    other = (place[more] + np.uint64(1) + mix(path[more] ^ np.uint64(0x52)) % np.uint64(TOKENS - 1)) % np.uint64(TOKENS)
    row, place, path = np.concatenate([row, more]), np.concatenate([place, other]), np.concatenate([path, path[more]])
    value = token[row, place.astype(np.int64)].astype(np.uint64)
    return row, mix(mix(path + place) ^ value)


def _matrix(column: pd.Series, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column), kind).reshape(len(column), TOKENS)


def first_nodes(classes: DataFrame) -> DataFrame:
    """node, rid: where the classes are after FIRST tokens, in all trees."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 2000):
                part = b.iloc[at : at + 2000]
                token, rid = _matrix(part["tokens"], "<u4"), part["rid"].to_numpy()
                row = np.tile(np.arange(len(part)), TREES)
                path = np.repeat(_ROOTS, len(part))
                for _ in range(FIRST):
                    went, path = branch(path, token[row])
                    row = row[went]
                yield pd.DataFrame({"node": path.view(np.int64), "rid": rid[row]}).drop_duplicates()

    return classes.select("rid", "tokens").mapInPandas(run, "node long, rid long")


def next_nodes(members: DataFrame) -> DataFrame:
    """Children of members' nodes."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            row, path = branch(b["node"].to_numpy().view(np.uint64), _matrix(b["tokens"], "<u4"))
            yield pd.DataFrame({"node": path.view(np.int64), "rid": b["rid"].to_numpy()[row]})

    return members.select("node", "rid", "tokens").mapInPandas(run, "node long, rid long")


def shared(rows: DataFrame) -> DataFrame:
    """node, rid of nodes with several classes, with the node's size and smallest class (hub)."""
    sizes = stage(rows.groupBy("node").agg(F.count("*").alias("size"), F.min("rid").alias("hub")).where("size > 1"), "path-sizes")
    return spread_join(rows, sizes, "node", "rid", _hot(sizes.select("node", "size")))


def _hot(sizes: DataFrame) -> DataFrame:
    """The keys of more than one of HOT_SHARE rows, from (key, size)."""
    total = sizes.agg(F.sum("size")).first()[0] or 0
    return sizes.where(F.col("size") > total / HOT_SHARE).select(sizes.columns[0])


def leaves(classes: DataFrame) -> DataFrame:
    """node, rid, size, hub of the nodes to compare; written."""
    level = stage(shared(first_nodes(classes)), "path-nodes")
    done = []
    for depth in range(FIRST, DEEPEST + 1):
        large = level.where(F.col("size") > SMALL)
        if depth == DEEPEST or large.isEmpty():
            done.append(level)
            break
        done.append(level.where(F.col("size") <= SMALL))
        level = stage(shared(next_nodes(large.join(classes.select("rid", "tokens"), "rid"))), "path-nodes")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


# -------------------------------------------------------------------------------------- comparing
def _groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Rows sorted by ``keys`` in whole groups, with the place of each group's first row."""
    held = None
    for b in batches:
        b = b if held is None else pd.concat([held, b], ignore_index=True)
        new = np.flatnonzero((b[keys].to_numpy()[1:] != b[keys].to_numpy()[:-1]).any(axis=1)) + 1
        if not len(new):
            held = b
            continue
        whole, held = b.iloc[: new[-1]], b.iloc[new[-1] :].reset_index(drop=True)
        yield whole, np.concatenate([[0], new[:-1]])
    if held is not None and len(held):
        yield held, np.array([0])


def _equal(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Equal tokens of every row of a with every row of b; leading axes run in step."""
    out = np.zeros((*a.shape[:-1], b.shape[-2]), np.uint8)
    for j in range(TOKENS):
        out += a[..., :, None, j] == b[..., None, :, j]
    return out


def partners(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For each member of each group its best and its smallest partner of enough equal tokens."""
    for rows, starts in _groups(batches, ["node", "chunk"]):
        token, rid = _matrix(rows["bytes"], "u1"), rows["rid"].to_numpy()
        sizes = np.diff(np.append(starts, len(rows)))
        for size in np.unique(sizes[sizes > 1]):
            at = starts[sizes == size]
            step = max(1, 4_000_000 // int(size) ** 2)
            for k in range(0, len(at), step):
                member = at[k : k + step, None] + np.arange(size)
                same = _equal(token[member], token[member])
                ids = rid[member]
                enough = (same >= EQUAL_TOKENS) & (ids[:, :, None] != ids[:, None, :])
                g, i = np.nonzero(enough.any(axis=2))
                best = np.where(enough, same, 0).argmax(axis=2)[g, i]
                sure = enough & (same >= SURE_TOKENS)
                least = np.where(sure, ids[:, None, :], ids[:, :, None]).min(axis=2)[g, i]
                yield pd.DataFrame({"rid": ids[g, i], "best": ids[g, best], "equal": same[g, i, best].astype(int), "least": least})


#: Rows of a group that are compared with others, or that others are compared with, or both.
LEFT, RIGHT, BOTH = 1, 2, 3


def meetings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Edges between components that candidate pairs of a group connect: each component of such a
    connected lot with the smallest one."""
    for rows, starts in _groups(batches, ["node", "part", "chunk"]):
        token, root, side = _matrix(rows["bytes"], "u1"), rows["root"].to_numpy(), rows["side"].to_numpy()
        out = []
        for a, b in zip(starts, np.append(starts[1:], len(rows)), strict=True):
            left, right = a + np.flatnonzero(side[a:b] & LEFT), a + np.flatnonzero(side[a:b] & RIGHT)
            if not len(left) or not len(right):
                continue
            far = (_equal(token[left], token[right]) >= EQUAL_TOKENS) & (root[left, None] != root[None, right])
            left, right, far = left[far.any(axis=1)], right[far.any(axis=0)], far[far.any(axis=1)][:, far.any(axis=0)]
            if not len(left):
                continue
            names, place = np.unique(np.concatenate([root[left], root[right]]), return_inverse=True)
            lot = np.arange(len(names))  # the smallest component reached, until nothing changes
            mine, theirs = place[: len(left)], place[len(left) :]
            while True:
                old = lot.copy()
                np.minimum.at(lot, mine, np.where(far, lot[theirs][None, :], len(names)).min(axis=1))
                np.minimum.at(lot, theirs, np.where(far, lot[mine][:, None], len(names)).min(axis=0))
                lot = lot[lot]
                if (lot == old).all():
                    break
            other = np.flatnonzero(lot != np.arange(len(names)))
            out.append(pd.DataFrame({"a": names[lot[other]], "b": names[other]}))
        if out:
            yield pd.concat(out).drop_duplicates()


def set_links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links between rows of each group in different components, by their full sets; of several links
    of a row to one component the first."""
    for rows, starts in _groups(batches, ["cluster", "part", "chunk"]):
        rid, root, side = rows["rid"].to_numpy(), rows["root"].to_numpy(), rows["side"].to_numpy()
        token = _matrix(rows["bytes"], "u1")
        for a, b in zip(starts, np.append(starts[1:], len(rows)), strict=True):
            left, right = np.flatnonzero(side[a:b] & LEFT), np.flatnonzero(side[a:b] & RIGHT)
            if not len(left) or not len(right):
                continue
            sets = [np.frombuffer(x, np.uint64) for x in rows["shingles"].iloc[a:b]]
            sizes = np.array(list(map(len, sets)))
            values, place = np.unique(np.concatenate(sets), return_inverse=True)
            places = np.split(place, np.cumsum(sizes)[:-1])
            near = (_equal(token[a + left], token[a + right]) >= EQUAL_TOKENS) & (root[a + left, None] != root[None, a + right])
            mine = np.zeros(len(values), bool)
            for i, row in zip(left, near, strict=True):
                others = right[row]
                if not len(others):
                    continue
                mine[places[i]] = True
                there = mine[np.concatenate([places[j] for j in others])]
                both = np.add.reduceat(there, np.cumsum(sizes[others]) - sizes[others], dtype=np.int64)
                mine[places[i]] = False
                hit = others[PARTS * both >= SHARE * (sizes[i] + sizes[others] - both)]
                if len(hit):
                    one = a + hit[np.unique(root[a + hit], return_index=True)[1]]
                    yield pd.DataFrame({"a": np.minimum(rid[a + i], rid[one]), "b": np.maximum(rid[a + i], rid[one])})


def _dealt(rid: str, n) -> Column:
    return F.pmod(F.xxhash64(rid), F.greatest(n, F.lit(1)))


def first_pairs(members: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs a < b of the first round."""
    chunks = F.ceil(F.col("size") / CHUNK)
    rows = members.select("node", _dealt("rid", chunks).alias("chunk"), "rid")
    hubs = members.where((F.col("rid") == F.col("hub")) & (F.col("size") > CHUNK)).select(
        "node", F.explode(F.sequence(F.lit(0).cast("long"), chunks - 1)).alias("chunk"), "rid", _dealt("rid", chunks).alias("own"))
    rows = rows.unionByName(hubs.where("chunk <> own").drop("own")).join(classes.select("rid", "bytes"), "rid")
    found = (rows.select("node", "chunk", "rid", "bytes").repartition("node", "chunk").sortWithinPartitions("node", "chunk")
             .mapInPandas(_lean(partners), "rid long, best long, equal int, least long"))
    one = found.groupBy("rid").agg(F.max(F.col("equal").cast("long")).alias("equal"), F.max_by("best", "equal").alias("best"),
                                   F.min("least").alias("least"))
    both = one.select("rid", F.explode(F.array("best", "least")).alias("other"))
    return both.where("rid <> other").select(F.least("rid", "other").alias("a"), F.greatest("rid", "other").alias("b")).distinct()


def _met(rows: DataFrame, key: str) -> DataFrame:
    """``key``, part, chunk, side and the other columns of ``rows``, which have a key, rid, mark, and the
    numbers of chunks of the key's rows (chunks) and of its marked ones (parts): each part of the marked
    rows meets each chunk of all rows; where there is one of both, each row stands once."""
    chunks, parts = F.col("chunks"), F.col("parts")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    none, one = F.lit(0).cast("long"), chunks <= 1
    rest = [c for c in rows.columns if c not in (key, "mark", "chunks", "parts")]
    small = rows.where(one).select(key, none.alias("part"), none.alias("chunk"), F.when(F.col("mark"), BOTH).otherwise(RIGHT).alias("side"), *rest)
    left = rows.where(~one & F.col("mark")).select(key, _dealt("rid", parts).alias("part"), every(chunks).alias("chunk"), F.lit(LEFT).alias("side"), *rest)
    right = rows.where(~one).select(key, every(parts).alias("part"), _dealt("rid", chunks).alias("chunk"), F.lit(RIGHT).alias("side"), *rest)
    order = [key, "part", "chunk"]
    return small.unionByName(left).unionByName(right).repartition(*order).sortWithinPartitions(*order)


def _rooted(rows: DataFrame, roots: DataFrame) -> DataFrame:
    root = roots.select(F.col("v").alias("rid"), "root")
    return rows.join(root, "rid", "left").withColumn("root", F.coalesce("root", "rid"))


def met_components(members: DataFrame, classes: DataFrame, roots: DataFrame) -> DataFrame:
    """Edges a < b between components that candidate pairs connect."""
    rows = _rooted(members.select("node", "rid"), roots)
    # marked are the classes outside the node's largest component; nodes of one component need nothing
    by_root = rows.groupBy("node", "root").agg(F.count("*").alias("n"))
    mixed = by_root.groupBy("node").agg(F.sum("n").alias("size"), F.max("n").alias("most"), F.max_by("root", "n").alias("main")).where("most < size")
    mixed = stage(mixed.select("node", "size", "main", F.ceil(F.col("size") / CHUNK).alias("chunks"),
                               F.ceil((F.col("size") - F.col("most")) / CHUNK).alias("parts")), "path-mixed")
    rows = spread_join(rows, mixed.drop("size"), "node", "rid", _hot(mixed.select("node", "size"))).withColumn("mark", F.col("root") != F.col("main"))
    rows = rows.join(classes.select("rid", "bytes"), "rid").select("node", "rid", "root", "bytes", "mark", "chunks", "parts")
    return _met(rows, "node").mapInPandas(_lean(meetings), "a long, b long").distinct()


def _lean(run):
    """``run``, giving unused memory back at its end."""
    def then_release(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from run(batches)
        release()
    return then_release


def cluster_rows(classes: DataFrame, roots: DataFrame, clusters: DataFrame) -> DataFrame:
    """cluster, rid, root, bytes, mark, chunks, parts of the classes of all clusters; marked are those
    outside a cluster's largest component.  Chunks are bounded in classes and, on average, in shingles."""
    named = clusters.select(F.col("v").alias("root"), F.col("root").alias("cluster"))
    rows = _rooted(classes.select("rid", "bytes", "n_shingles"), roots)
    by_root = stage(rows.groupBy("root").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("shingles")).join(named, "root"), "path-by-root")
    needed = lambda n, shingles: F.ceil(F.greatest(n / CHUNK, shingles / CHUNK_SHINGLES))
    main = F.max_by(F.struct("root", "n", "shingles"), "n")
    sizes = by_root.groupBy("cluster").agg(F.sum("n").alias("n"), F.sum("shingles").alias("shingles"), main.alias("main"))
    sizes = sizes.select("cluster", F.col("main.root").alias("main"), needed(F.col("n"), F.col("shingles")).alias("chunks"),
                         needed(F.col("n") - F.col("main.n"), F.col("shingles") - F.col("main.shingles")).alias("parts"))
    known = by_root.select("root", "cluster").join(sizes, "cluster")
    hot = _hot(by_root.select("root", F.col("n").alias("size")))
    return spread_join(rows.drop("n_shingles"), known, "root", "rid", hot).select(
        "cluster", "rid", "root", "bytes", (F.col("root") != F.col("main")).alias("mark"), "chunks", "parts")


def second_links(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """Links a < b among the classes of each cluster, confirmed on the full sets."""
    return _met(rows.join(sets, "rid"), "cluster").mapInPandas(_lean(set_links), "a long, b long").distinct()


# ------------------------------------------------------------------------------------- confirming
def confirm(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pairs whose full sets are similar enough."""
    words, last = Words(), (None, None)
    for b in batches:
        keep = []
        for i, x, y in zip(b["b"], b["text_a"], b["text_b"], strict=True):
            if last[0] != i:
                last = (i, shingles(y, words))
            one, two = shingles(x, words), last[1]
            both = len(np.intersect1d(one, two, assume_unique=True))
            keep.append(PARTS * both >= SHARE * (len(one) + len(two) - both))
        if len(words) > 100_000:
            words.clear()
        yield b.loc[keep, ["a", "b"]]


def links(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    a = texts.select(F.col("rid").alias("a"), F.col("text").alias("text_a"))
    b = texts.select(F.col("rid").alias("b"), F.col("text").alias("text_b"))
    return map_slices(pairs.join(a, "a").join(b, "b"), confirm, "a long, b long")


def texts_of(ends: DataFrame, classes: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """rid, text of the classes named in ``ends`` (distinct rid)."""
    wanted = classes.join(ends, "rid", "left_semi").select("rid", F.col("doc_id").alias("want_id"), F.col("text_hash").alias("want_hash"))
    text = text_of(docs, text_col)
    rows = docs.select(docs[id_col].cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("hash"))
    found = rows.join(wanted, rows["id"].eqNullSafe(wanted["want_id"]) & (rows["hash"] == wanted["want_hash"]))
    return found.select("rid", "text").dropDuplicates(["rid"])


def full_sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    words = Words()
    for b in batches:
        yield pd.DataFrame({"rid": b["rid"].to_numpy(), "shingles": [shingles(t, words).tobytes() for t in b["text"]]})
        if len(words) > 100_000:
            words.clear()


def components(pairs: DataFrame) -> DataFrame:
    """v, root (the smallest v of the component) of all ends of the pairs; written.

    Each round every vertex points to its smallest neighbour, pointers are followed twice, and the
    edges move to where their ends point; rounds are few, since chains shorten fourfold."""
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = stage(both.distinct(), "path-edges")
    found = stage(edges.select(F.col("a").alias("v"), F.col("a").alias("root")).distinct(), "path-roots")
    while not edges.isEmpty():
        up = stage(edges.groupBy("a").agg(F.least("a", F.min("b")).alias("p")), "path-up")
        twice = stage(up.join(up.select(F.col("a").alias("p"), F.col("p").alias("to")), "p").select(F.col("a").alias("root"), "to"), "path-up")
        new = stage(found.join(twice, "root", "left").select("v", F.coalesce("to", "root").alias("root")), "path-roots")
        a = twice.select(F.col("root").alias("a"), F.col("to").alias("x"))
        b = twice.select(F.col("root").alias("b"), F.col("to").alias("y"))
        moved = edges.join(a, "a").join(b, "b").where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()
        moved = stage(moved, "path-edges")
        unstage(up, twice, edges, found)
        edges, found = moved, new
    return found


# ------------------------------------------------------------------------------------------- whole
def _decide(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """The written sketch, and by set_key the component's least row: root, component_id, keep (a
    struct of doc_id, rid and text_hash)."""
    rows = stage(sketch(docs, id_col, text_col), "path-sketch")
    full = rows.where(F.col("set_key").isNotNull())
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid", "text_hash")
    by_set = stage(full.groupBy("set_key").agg(F.min("rid").alias("rep"), F.min(key).alias("least")), "path-sets")
    classes = stage(full.join(by_set.select(F.col("rep").alias("rid")), "rid", "left_semi")
                    .select("rid", "doc_id", "text_hash", "n_shingles", "tokens", "bytes"), "path-classes")
    members = leaves(classes)
    pairs = stage(first_pairs(members, classes), "path-pairs")
    texts = stage(texts_of(pairs.select(F.explode(F.array("a", "b")).alias("rid")).distinct(), classes, docs, id_col, text_col), "path-texts")
    found = stage(links(pairs, texts), "path-links")
    unstage(pairs)
    roots = components(found)
    met = stage(met_components(members, classes, roots), "path-met")
    if not met.isEmpty():
        second = stage(cluster_rows(classes, roots, components(met)), "path-clusters")
        # a class with a candidate partner was nearly always paired in the first round, so its text is there
        missing = stage(second.select("rid").join(texts, "rid", "left_anti"), "path-missing")
        there = texts.join(second, "rid", "left_semi")
        if not missing.isEmpty():
            there = there.unionByName(texts_of(missing, classes, docs, id_col, text_col))
        sets = stage(map_slices(there, full_sets, "rid long, shingles binary"), "path-sets")
        extra = stage(second_links(second, sets), "path-links")
        unstage(sets, roots, missing, second)
        roots = components(found.unionByName(extra))
    unstage(met, texts)
    placed = by_set.join(roots.withColumnRenamed("v", "rep"), "rep", "left").select(
        "set_key", F.coalesce("root", "rep").alias("root"), "least")
    least = placed.groupBy("root").agg(F.min("least").alias("keep"))
    return rows, placed.select("set_key", "root").join(least, "root")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id (the smallest doc_id reachable by links,
    its own included) and kept (whether that is its own)."""
    rows, placed = _decide(docs, id_col, text_col)
    out = rows.join(placed.select("set_key", F.col("keep.doc_id").alias("least_id")), "set_key", "left")
    component = F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(F.col("least_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component, the one of the smallest id, whole and unchanged;
    every row without words stays."""
    rows, placed = _decide(docs, id_col, text_col)
    chosen = placed.select(F.col("keep.rid").alias("rid"))
    same = rows.where(F.col("set_key").isNotNull()).join(chosen, "rid", "left_semi").select(
        F.col("doc_id").alias("keep_id"), F.col("text_hash").alias("keep_hash"))
    empty = rows.where(F.col("set_key").isNull()).select(F.col("doc_id").alias("keep_id"), F.col("text_hash").alias("keep_hash"))
    copies = rows.where(F.col("set_key").isNotNull()).groupBy("doc_id", "text_hash").count().where("count > 1")
    text_hash = F.xxhash64(text_of(docs, text_col))
    fits = lambda k: docs[id_col].cast("long").eqNullSafe(k["keep_id"]) & (text_hash == k["keep_hash"])
    same = stage(same, "path-keep")
    again = stage(same.join(copies, same["keep_id"].eqNullSafe(copies["doc_id"]) & (same["keep_hash"] == copies["text_hash"]), "left_semi"),
                  "path-keep")
    once = same.unionByName(empty)
    if again.isEmpty():
        return docs.join(once, fits(once), "left_semi")
    once = once.join(again.select(F.col("keep_id").alias("i"), F.col("keep_hash").alias("h")),
                     F.col("keep_id").eqNullSafe(F.col("i")) & (F.col("keep_hash") == F.col("h")), "left_anti")
    first = docs.join(again, fits(again), "left_semi")
    number = "repeated row"
    while number in docs.columns:
        number += "'"
    repeated = first.withColumn(number, F.xxhash64(text_of(first, text_col))).dropDuplicates([id_col, number]).drop(number)
    return docs.join(once, fits(once), "left_semi").unionByName(repeated)
