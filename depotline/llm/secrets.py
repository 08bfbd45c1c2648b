"""Secret scan with corpus-wide ownership frequency.

Each text is searched whole for candidate secrets.  Candidates travel on as SHA-256 digests, which
are counted by distinct repositories and distinct owners.  A value of many owners, or of several in
many repositories, is a widely copied example; any other looks like a live credential of its owners.  Spans of the
fixed kinds (assign, access, hex) are always reported; the scan adds spans of kind ``mixed``: long
random-looking tokens outside those spans whose value is owner-specific.

Defined results: a null text counts as empty; null owners or repositories count as one more owner
or repository; repeated rows each give their row, but count once by owner and repository; null ids
stay null; other columns play no part; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from depotline.llm.common import HOT_SHARE, release, spread_join, text_of, text_slices
from depotline.session import stage

# fixed values: the kinds in the order in which equal starts are listed, their patterns and least lengths
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex", "mixed")
LEAST = {"assign": 6, "access": 20, "hex": 24, "mixed": 20}

#: Shannon entropy, in bits a character, from which a mixed token looks random.
MIN_ENTROPY = 3.5
#: A value of at least so many owners is a copied example; so is one that several owners hold in at
#: least so many repositories.  What one owner holds is that owner's, in however many repositories.
EXAMPLE_OWNERS, EXAMPLE_REPOSITORIES = 3, 6

_assign = re.compile(ASSIGN, re.IGNORECASE | re.ASCII)
_access = re.compile(ACCESS)
_hex = re.compile("[0-9a-f]{%d,}" % LEAST["hex"])  # the runs of HEX that are long enough
_mixed = re.compile(r"[A-Za-z0-9+/_-]{%d,}" % LEAST["mixed"])


def _random_looking(token: str) -> bool:
    if not (re.search("[0-9]", token) and re.search("[a-z]", token) and re.search("[A-Z]", token)):
        return False
    n = len(token)
    return -sum(c / n * math.log2(c / n) for c in Counter(token).values()) >= MIN_ENTROPY


def find_candidates(text: str) -> list[tuple[int, int, int, str]]:
    """(start, number of the kind, end, value) of every candidate, in that order."""
    found = [(m.start(), 0, m.end(), m[2]) for m in _assign.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m[0]) for m in _access.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    found += [(m.start(), 2, m.end(), m[0]) for m in _hex.finditer(text)]
    taken: list[list[int]] = []  # places inside base spans, overlapping ones joined
    for start, _, end, _ in sorted(found):
        if taken and start <= taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], end)
        else:
            taken.append([start, end])
    at = 0
    for m in _mixed.finditer(text):  # both lists are walked once, in order
        while at < len(taken) and taken[at][1] <= m.start():
            at += 1
        if (at == len(taken) or taken[at][0] >= m.end()) and _random_looking(m[0]):
            found.append((m.start(), 3, m.end(), m[0]))
    return sorted(found)


@F.arrow_udf(T.ArrayType(T.StringType()))
def candidates(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Candidates of each text as ``kind:start:end:digest of the value``."""
    for b in texts:
        yield pa.array([[f"{KINDS[k]}:{start}:{end}:{hashlib.sha256(v.encode()).hexdigest()}"
                         for start, k, end, v in find_candidates(t)] for part in text_slices(b) for t in part], pa.list_(pa.string()))
    release()


def frequency(occurrences: DataFrame) -> DataFrame:
    """digest, n_repositories, n_owners of (digest, owner, repository) rows.

    Rows are reduced to distinct ones before they move, and counted by owner before by digest, so a
    digest of very many documents reaches the last step as one row an owner."""
    return (occurrences.groupBy("digest", "owner", "repository").agg(F.lit(1).alias("one"))
            .groupBy("digest", "owner").agg(F.count("*").alias("repositories"))
            .groupBy("digest").agg(F.sum("repositories").alias("n_repositories"), F.count("*").alias("n_owners")))


def judge(found: DataFrame, example_owners: int = EXAMPLE_OWNERS, example_repositories: int = EXAMPLE_REPOSITORIES) -> DataFrame:
    """Occurrences (rid, candidate, owner, repository) with their kind, place, the numbers of owners and
    repositories that hold the value, and ``live``: whether it is owner-specific.  A digest that a large
    share of all rows holds is dealt over many tasks."""
    parts = F.split("candidate", ":")
    occurrences = found.select("rid", "owner", "repository", parts[0].alias("kind"), parts[1].cast("long").alias("start"),
                               parts[2].cast("long").alias("end"), parts[3].alias("digest"))
    counts = frequency(occurrences.select("digest", "owner", "repository"))
    copied = (F.col("n_owners") >= example_owners) | ((F.col("n_owners") > 1) & (F.col("n_repositories") >= example_repositories))
    sizes = occurrences.groupBy("digest").agg(F.count("*").alias("size"))
    total = occurrences.count()
    hot = sizes.where(F.col("size") > total / HOT_SHARE).select("digest")
    return spread_join(occurrences, counts, "digest", "rid", hot).withColumn("live", ~copied)


def _place(c: Column) -> Column:
    """``kind:start:end:digest`` without the digest."""
    return F.regexp_replace(c, ":[0-9a-f]{64}$", "")


def _joined(spans: str) -> Column:
    """The span texts of (start, kind_number, span) in order, comma-joined."""
    return F.coalesce(F.array_join(F.transform(F.array_sort(spans), lambda s: s["span"]), ","), F.lit(""))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner: Column | None = None,
         repository: Column | None = None, example_owners: int = EXAMPLE_OWNERS, example_repositories: int = EXAMPLE_REPOSITORIES) -> DataFrame:
    """One row a document: doc_id, n_assign, n_access, n_hex, n_mixed, n_live, n_examples, base_sha256,
    spans, and ownership (every candidate as kind:start:end:owners:repositories, comma-joined).
    ``owner`` and ``repository`` are columns of ``docs``; each document is its own owner where they
    are left out."""
    own = owner if owner is not None else docs[id_col]
    repo = repository if repository is not None else own
    seen = stage(
        docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(own.cast("string"), F.lit("")).alias("owner"),
                    F.coalesce(repo.cast("string"), F.lit("")).alias("repository"),
                    candidates(text_of(docs, text_col)).alias("candidates"))
        .withColumn("rid", F.monotonically_increasing_id()), "secrets")
    found = seen.select("rid", "owner", "repository", F.explode("candidates").alias("candidate"))
    judged = judge(found, example_owners, example_repositories)
    order = {k: i for i, k in enumerate(KINDS)}
    number = F.element_at(F.create_map(*(F.lit(x) for kv in order.items() for x in kv)), F.col("kind"))
    shown = F.struct("start", number.alias("kind_number"), F.concat_ws(":", "kind", "start", "end").alias("span"))
    added = judged.groupBy("rid").agg(
        F.collect_list(F.when((F.col("kind") != "mixed") | F.col("live"), shown)).alias("list"),
        F.collect_list(F.struct("start", number.alias("kind_number"), F.concat_ws(":", "kind", "start", "end", "n_owners", "n_repositories").alias("span"))).alias("held"),
        F.count_if("live").alias("n_live"), F.count_if(~F.col("live")).alias("n_examples"),
        F.count_if((F.col("kind") == "mixed") & F.col("live")).alias("n_mixed"))
    base = F.filter("candidates", lambda c: ~c.startswith("mixed:"))
    count = lambda kind: F.size(F.filter("candidates", lambda c: c.startswith(kind + ":"))).cast("long")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return seen.join(added, "rid", "left").select(
        "doc_id", *(count(k).alias(f"n_{k}") for k in KINDS[:3]), zero("n_mixed"), zero("n_live"), zero("n_examples"),
        F.sha2(F.array_join(F.transform(base, _place), ","), 256).alias("base_sha256"),
        _joined("list").alias("spans"), _joined("held").alias("ownership"))


@F.arrow_udf(T.StringType())
def _masked(texts: pa.Array, places: pa.Array) -> pa.Array:
    out = []
    for text, spans in zip(texts.to_pylist(), places.to_pylist(), strict=True):
        joined: list[list[int]] = []  # spans that overlap or touch become one
        for start, end in sorted(tuple(map(int, p.split(":"))) for p in spans):
            if joined and start <= joined[-1][1]:
                joined[-1][1] = max(joined[-1][1], end)
            else:
                joined.append([start, end])
        for start, end in reversed(joined):
            text = text[:start] + "[SECRET]" + text[end:]
        out.append(text)
    return pa.array(out, pa.string())


def redact(docs: DataFrame, text_col: str = "text", owner: Column | None = None, repository: Column | None = None,
           example_owners: int = EXAMPLE_OWNERS, example_repositories: int = EXAMPLE_REPOSITORIES) -> DataFrame:
    """``docs`` with every live-looking secret in the text replaced by ``[SECRET]``; widely copied
    examples and all other text stay.  Only documents with candidates are moved; rows, order of
    columns and all other columns stay as they are."""
    names = docs.columns
    own = F.coalesce((owner if owner is not None else F.lit("")).cast("string"), F.lit(""))
    repo = F.coalesce((repository if repository is not None else F.lit("")).cast("string"), F.lit(""))
    marked = docs.select(F.struct(*(docs[c] for c in names)).alias("row"), own.alias("owner"), repo.alias("repository"),
                         candidates(text_of(docs, text_col)).alias("candidates"))
    hold = stage(marked.where(F.size("candidates") > 0).withColumn("rid", F.monotonically_increasing_id()), "secret-rows")
    live = judge(hold.select("rid", "owner", "repository", F.explode("candidates").alias("candidate")), example_owners, example_repositories).where("live")
    places = live.groupBy("rid").agg(F.collect_list(F.concat_ws(":", "start", "end")).alias("places"))
    text = F.col(f"row.`{text_col}`")
    changed = F.when(F.col("places").isNull(), text).otherwise(
        _masked(F.coalesce(text.cast("string"), F.lit("")), F.coalesce("places", F.array().cast("array<string>"))))
    mended = hold.join(places, "rid", "left").select(
        *((changed.alias(c) if c == text_col else F.col(f"row.`{c}`")) for c in names))
    clean = marked.where(F.size("candidates") == 0).select(*(F.col(f"row.`{c}`") for c in names))
    return clean.unionByName(mended)
