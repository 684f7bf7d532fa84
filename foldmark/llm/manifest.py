"""Merkle manifest of a table: a content-addressed DAG, and proofs by descent.

Every row is a leaf, the hash of its fields.  The leaves of a group (a source)
ascend by key; runs of ``FAN`` nodes become their hash until one, the subroot,
remains.  The subroots, in order of their groups, likewise become the root.

The DAG is stored as records from a digest to the digests of its children, in
packs of ``HEIGHT`` levels: a pack is found by the digest at its top.  A tree is
built in passes that each rise by one pack, so no task holds more than a pack.

Proofs go the other way.  Requests are grouped by pack and descend from the
root: the digits of a leaf's rank, to the base ``FAN``, say which child comes
next, and the children not selected are collected.  A path shared by a whole
pack is walked once.  The segments, collected from the top, are kept reversed,
so a path reads from leaf to root.

Defined results: a null field is hashed as ``-``; a null group is a group of
its own and comes first; rows without a key come first in their group; equal
keys are ordered by their leaf; repeated rows are leaves of their own; other
columns, whatever their names, are not hashed; an empty table has no root and
no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from foldmark.llm.order import small, width, written
from foldmark.operators.lookup import LevelTable, lookup

FAN = 3
# Levels of a pack, which so holds FAN ** HEIGHT nodes at its bottom.
HEIGHT = 6
DIGEST = 64         # characters

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


# -- hashes ----------------------------------------------------------------------

def framed(value: Column) -> Column:
    """``<bytes>:<value>``, or ``-`` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(fields: list[Column]) -> Column:
    return F.sha2(F.concat(*[framed(f) for f in fields]), 256)


def joined(digests: Iterable[str]) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def folded(leaf: str, places: str, siblings: str) -> str:
    """The root that a leaf and its path lead to.

    ``places`` has two digits a level, from the leaf on: the node's place in its
    run, and how many others there are; ``siblings`` their digests.
    """
    at = 0
    for i in range(0, len(places), 2):
        place, others = int(places[i]), int(places[i + 1])
        cut, end = at + place * DIGEST, at + others * DIGEST
        leaf = hashlib.sha256(f"{siblings[at:cut]}{leaf}{siblings[cut:end]}".encode()).hexdigest()
        at = end
    return leaf


# -- order -------------------------------------------------------------------------

def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Written with ``_rank``, the place of each row in the whole order, from 0."""
    cut = (df.repartitionByRange(width(df.sparkSession), *order).sortWithinPartitions(*order)
           .withColumn("_at", F.monotonically_increasing_id()))
    rows = written(cut, name).withColumn("_piece", F.shiftright("_at", 33))
    # one line per task
    sizes = sorted((r["_piece"], r["n"]) for r in
                   rows.groupBy("_piece").agg(F.count(F.lit(1)).alias("n")).collect())
    before, starts = 0, []
    for piece, n in sizes:
        starts.append((piece, before - (piece << 33)))
        before += n
    starts = df.sparkSession.createDataFrame(starts, "_piece long, _shift long")
    return (rows.join(F.broadcast(starts), "_piece")
            .withColumn("_rank", F.col("_at") + F.col("_shift")).drop("_piece", "_at", "_shift"))


# -- building ------------------------------------------------------------------------

PACK = "tree long, block long, top string, records map<string, array<string>>"
PACK_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.map_(pa.string(), pa.list_(pa.string()))]


def levels_above(n: int, height: int) -> int:
    """Levels that a pack rises over n nodes of its tree."""
    levels = 0
    while n > 1 and levels < height:
        n, levels = -(-n // FAN), levels + 1
    return levels


def pack_of(digests: list[str], n: int, height: int) -> tuple[str, dict[str, list[str]]]:
    """The top over consecutive nodes, and the records below it."""
    records: dict[str, list[str]] = {}
    for _ in range(levels_above(n, height)):
        runs = [digests[i:i + FAN] for i in range(0, len(digests), FAN)]
        digests = [joined(r) for r in runs]
        records.update(zip(digests, runs))
    return digests[0], records


def risen(nodes: DataFrame, height: int, name: str) -> DataFrame:
    """Packs over (tree, rank, n, digest), written."""
    def made(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[str] = []
        at, size = None, 0
        for b in batches:
            done = []
            for tree, block, n, digest in zip(*[b.column(c).to_pylist()
                                                for c in ("tree", "block", "n", "digest")]):
                if held and at != (tree, block):
                    done.append((*at, *pack_of(held, size, height)))
                    held = []
                at, size = (tree, block), n
                held.append(digest)
            yield as_packs(done)
        if held:
            yield as_packs([(*at, *pack_of(held, size, height))])

    def as_packs(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [(), (), (), ()]
        columns[3] = [list(r.items()) for r in columns[3]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, PACK_TYPES)],
                                          ["tree", "block", "top", "records"])

    cut = nodes.withColumn("block", F.floor(F.col("rank") / FAN ** height).cast("long"))
    dealt = (cut.repartition(width(nodes.sparkSession), "tree", "block")
             .sortWithinPartitions("tree", "block", "rank"))
    return written(dealt.select("tree", "block", "n", "digest").mapInArrow(made, PACK), name)


@dataclass(frozen=True)
class Forest:
    """The packs of each pass, and each tree's top: tree, top, n (leaves), at (its pass)."""
    passes: list[DataFrame]
    tops: DataFrame


def nodes_left(n: Column, height: int, passes: int) -> Column:
    """Nodes of a tree of n leaves after some passes."""
    return F.ceil(n / FAN ** (height * passes)).cast("long")


def built(nodes: DataFrame, sizes: DataFrame, most: int, height: int, name: str) -> Forest:
    """All trees over (tree, rank, n, digest); ``sizes`` has the n of each, ``most`` the largest."""
    passes, tops = [], None
    while True:
        packs = risen(nodes, height, name)
        passes.append(packs)
        done = len(passes)
        most = -(-most // FAN ** height)
        risen_to = (packs.select("tree", F.col("block").alias("rank"), F.col("top").alias("digest"))
                    .join(small(sizes), "tree")
                    .withColumn("_left", nodes_left(F.col("n"), height, done)))
        whole = risen_to.filter("_left = 1").select(
            "tree", F.col("digest").alias("top"), "n", F.lit(done - 1).alias("at"))
        tops = whole if tops is None else tops.unionByName(whole)
        if most <= 1:
            return Forest(passes, tops)
        nodes = risen_to.filter("_left > 1").select("tree", "rank", F.col("_left").alias("n"), "digest")


@dataclass(frozen=True)
class Manifest:
    """The stored DAG.  ``leaves`` has what was asked to be kept beside
    ``tree``, ``rank``, ``n`` and ``leaf``; ``groups`` has ``_group``, ``tree``,
    ``n`` and the group's ``place``.  Without rows the root is null."""

    leaves: DataFrame
    groups: DataFrame
    trees: Forest
    above: Forest | None
    root: str | None
    height: int = HEIGHT


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, key: str = "doc_id",
             group: str = "source", keep: dict[str, Column] | None = None,
             height: int = HEIGHT) -> Manifest:
    """Hash every row once and build the DAG over the hashes."""
    keep = keep or {}
    at = F.col(f"`{group}`").cast("string")
    leaves = written(docs.select(
        F.col(f"`{key}`").cast("long").alias("_id"),
        # bytewise order with null first
        F.when(at.isNull(), "").otherwise(F.concat(F.lit("+"), at)).alias("_group"),
        leaf_of([F.col(f"`{f}`") for f in fields]).alias("leaf"),
        F.monotonically_increasing_id().alias("_row"),
        *[c.alias(n) for n, c in keep.items()]), "manifest-leaves")
    rows = numbered(leaves, ["_group", "_id", "leaf", "_row"], "manifest-order")
    groups = written(rows.groupBy("_group").agg(F.min("_rank").alias("tree"),
                                                F.count(F.lit(1)).alias("n")), "manifest-groups")
    groups = numbered(groups, ["tree"], "manifest-places").withColumnRenamed("_rank", "place")
    facts = groups.agg(F.count(F.lit(1)).alias("groups"), F.max("n").alias("most"), F.sum("n").alias("rows"),
                       F.sum(F.octet_length("_group")).alias("size")).first()
    table = LevelTable(groups, ("_group",), facts["groups"], facts["rows"] or 0, facts["size"] or 0)
    placed = lookup(rows, table, [F.col("_group")], {"tree": "tree", "n": "n"}, F.col("_row"))
    placed = placed.select("_id", "_row", "leaf", *keep, "tree", "n",
                           (F.col("_rank") - F.col("tree")).alias("rank"))
    if not facts["groups"]:
        return Manifest(placed, groups, Forest([], groups.limit(0)), None, None, height)
    trees = built(placed.select("tree", "rank", "n", F.col("leaf").alias("digest")),
                  groups.select("tree", "n"), facts["most"], height, "manifest-packs")
    tops = trees.tops.join(small(groups.select("tree", "place")), "tree")
    one = F.lit(-1).cast("long").alias("tree")
    above = built(tops.select(one, F.col("place").alias("rank"),
                              F.lit(facts["groups"]).alias("n"), F.col("top").alias("digest")),
                  docs.sparkSession.createDataFrame([(-1, facts["groups"])], "tree long, n long"),
                  facts["groups"], height, "manifest-above")
    return Manifest(placed, groups, trees, above, above.tops.first()["top"], height)


# -- descending ------------------------------------------------------------------------

def descended(top: str, records: dict[str, list[str]], entries: Iterable[int], levels: int,
              places: str, siblings: str) -> dict[int, tuple[str, str, str]]:
    """Digest, places and siblings of entries of a pack, by the digits of their ranks."""
    wanted = list(entries)
    found = {0: (top, places, siblings)}
    for level in reversed(range(levels)):
        lower = {}
        for i in {e // FAN ** level for e in wanted}:
            digest, far, others = found[i // FAN]
            run = records[digest]
            k = i % FAN
            lower[i] = (run[k], f"{k}{len(run) - 1}{far}", "".join(run[:k] + run[k + 1:]) + others)
        found = lower
    return found


HEAD = "tree long, block long, top string, places string, siblings string, subroot string"


def heads_below(wanted: DataFrame, packs: DataFrame, heads: DataFrame, height: int) -> DataFrame:
    """The heads of the packs one pass lower: ``wanted`` has (tree, block, n, entries)."""
    span = FAN ** height

    def made(batches):
        for b in batches:
            rows = []
            for r in b.to_pylist():
                found = descended(r["top"], dict(r["records"]), r["entries"],
                                  levels_above(r["n"], height), r["places"], r["siblings"])
                rows += [(r["tree"], r["block"] * span + e, *found[e], r["subroot"])
                         for e in r["entries"]]
            columns = list(zip(*rows)) or [()] * 6
            kinds = [pa.int64(), pa.int64(), *[pa.string()] * 4]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)],
                ["tree", "block", "top", "places", "siblings", "subroot"])

    joined_up = wanted.join(with_records(heads, packs), ["tree", "block"])
    return joined_up.mapInArrow(made, HEAD)


def with_records(heads: DataFrame, packs: DataFrame) -> DataFrame:
    """Heads beside the records found by their top digest."""
    return heads.join(packs.select("top", "records").dropDuplicates(["top"]), "top")


def walked(forest: Forest, requests: DataFrame, heads: DataFrame, height: int) -> DataFrame:
    """Descend to the packs of the lowest pass.

    ``requests`` has (tree, rank, n), ``heads`` one row per tree: tree, at (the
    pass of its top), top, places, siblings, subroot.
    """
    current = None
    for p in reversed(range(len(forest.passes))):
        new = heads.filter(F.col("at") == p).select(
            "tree", F.lit(0).cast("long").alias("block"), "top", "places", "siblings", "subroot")
        current = new if current is None else current.unionByName(new)
        if p == 0:
            return written(current, "manifest-heads")
        at = requests.select(
            "tree", F.floor(F.col("rank") / FAN ** (height * p)).cast("long").alias("rank"),
            nodes_left(F.col("n"), height, p).alias("n")).filter("n > 1").distinct()
        current = written(heads_below(by_pack(at, height, entry_of(height)), forest.passes[p],
                                      current, height), "manifest-heads")
    raise ValueError("a forest has one pass at least")


def entry_of(height: int) -> Column:
    return (F.col("rank") % FAN ** height).cast("int")


def by_pack(requests: DataFrame, height: int, entry: Column) -> DataFrame:
    """(tree, block, n, entries) over (tree, rank, n); a pack's requests are a bounded list
    unless a leaf is asked for again and again."""
    return requests.groupBy(
        "tree", F.floor(F.col("rank") / FAN ** height).cast("long").alias("block")).agg(
        F.max("n").alias("n"), F.collect_list(entry).alias("entries"))


PROOF = ("_id long, leaf string, subroot string, proof_sha256 string, folded_root string, "
         "places string, siblings string")


def proofs(m: Manifest, candidate: str = "leaf", chosen: Column | None = None,
           with_paths: bool = True) -> DataFrame:
    """A proof for every chosen leaf, found by descent from the root.

    ``folded_root`` folds the column ``candidate`` along the path.  A path is
    ``places`` and ``siblings`` as :func:`folded` takes them.
    """
    spark = m.leaves.sparkSession
    if m.root is None:
        empty = spark.createDataFrame([], PROOF)
        return empty if with_paths else empty.drop("places", "siblings")
    requests = m.leaves if chosen is None else m.leaves.filter(chosen)

    height = m.height

    # to the subroots
    places = m.groups.select(F.lit(-1).cast("long").alias("tree"), F.col("place").alias("rank"),
                             F.lit(m.above.tops.first()["n"]).cast("long").alias("n"))
    start = m.above.tops.select("tree", "at", "top", F.lit("").alias("places"),
                                F.lit("").alias("siblings"), F.lit("").alias("subroot"))
    low = walked(m.above, places, start, height)
    subroots = written(heads_below(by_pack(places, height, entry_of(height)), m.above.passes[0],
                                   low, height), "manifest-subroots")
    named = m.groups.select(F.col("place").alias("block"), F.col("tree").alias("_tree"))
    heads = (subroots.drop("tree").join(small(named), "block")
             .join(small(m.trees.tops.select(F.col("tree").alias("_tree"), "at")), "_tree")
             .select(F.col("_tree").alias("tree"), "at", "top", "places", "siblings",
                     F.col("top").alias("subroot")))

    # to the leaves
    low = walked(m.trees, requests.select("tree", "rank", "n"), heads, height)
    asked = by_pack(requests, height, F.struct(entry_of(height).alias("entry"), F.col("_id").alias("id"),
                                               F.col(candidate).alias("candidate")))
    names = ["_id", "leaf", "subroot", "proof_sha256", "folded_root"]
    names += ["places", "siblings"] if with_paths else []

    def made(batches):
        for b in batches:
            for r in b.to_pylist():
                found = descended(r["top"], dict(r["records"]), [e["entry"] for e in r["entries"]],
                                  levels_above(r["n"], height), r["places"], r["siblings"])
                rows = []
                for e in r["entries"]:
                    leaf, path, others = found[e["entry"]]
                    proof = (e["id"], leaf, r["subroot"], hashlib.sha256(others.encode()).hexdigest(),
                             folded(e["candidate"], path, others))
                    rows.append(proof + (path, others) if with_paths else proof)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64() if n == "_id" else pa.string())
                     for n, c in zip(names, zip(*rows))], names)

    schema = PROOF if with_paths else PROOF.split(", places")[0]
    ready = asked.join(with_records(low, m.trees.passes[0]), ["tree", "block"])
    return ready.mapInArrow(made, schema)


def tampered_text(key: Column, text: Column) -> Column:
    """The text without its line ends, where 2 divides the CRC-32 of the key."""
    hit = F.crc32(key.cast("string").cast("binary")) % 2 == 0
    return F.when(hit, F.replace(text, F.lit("\n"), F.lit(""))).otherwise(text)


def audit(docs: DataFrame, key: str = "doc_id", height: int = HEIGHT) -> DataFrame:
    """Every row's proof, and whether the row, perhaps tampered with, still leads to the root."""
    changed = [tampered_text(F.col(f"`{key}`"), F.col("text")) if f == "text" else F.col(f"`{f}`")
               for f in FIELDS]
    m = manifest(docs, key=key, keep={"candidate": leaf_of(changed)}, height=height)
    root = F.lit(m.root).cast("string")
    return proofs(m, "candidate", with_paths=False).select(
        F.col("_id").alias(key), "leaf", "subroot", root.alias("root"), "proof_sha256",
        "folded_root", (F.col("folded_root") == root).alias("verified"))
