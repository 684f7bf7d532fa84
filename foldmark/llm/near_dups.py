"""Near-duplicates by bottom-k sketches.

One hash function orders all shingles; the k smallest hashes of a document are
its sketch.  Two documents whose Jaccard similarity is at least the threshold
share most of the k smallest values of their union, so they share at least
half of their sketches but for a chance below 1e-8 (k = 64, threshold 0.8).
Hence each document enters the inverted lists only under the rarest of its
retained values, so many more than may differ that linked documents meet in
``NEED`` lists.  Passages that many documents share give long lists only for
documents that consist of little else.

Lists generate candidates without pairing their members with one another.
Every list compares its members with one pivot, first the one whose values are
the most common; links that hold on the full sets form components, and lists
whose members all lie in one component are done.  Other lists go on with
another pivot while that pays.  In what is left, lists with few members outside
their largest component compare those with every other component.  Members of
other lists get deeper sketches (k = 65,536), which are whole sets for nearly
all texts, and lists of them under their rarest values, two kinds of places
each: a pair must meet where the smaller set is among its first ninth of
values, roughly, so texts that share only a passage do not meet, however many
there are.  Whole sets also tell which member of a list is the most central;
once all others were compared with it, few pairs of components meet.  No link
between components is missed, and groups of thousands of copies cost one
comparison per member and round.

Documents with equal sets are one class from the start.  Rows have a written
number of their own, by which classes and components are named, so rows that
share an id, or have none, stay apart.

Defined results: a null or empty text, or one without words, has an empty set
and is linked with nothing; fewer words than a shingle give one shingle; rows
that share an id follow their own text each; a null id takes part, and counts
as larger than every other id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from foldmark.llm import bytetools as bt
from foldmark.llm.order import small, tidied, written
from foldmark.session import discard, stored

NO_ID = 2 ** 63 - 1
PIVOT_ROUNDS = 2
FEW = 8  # members outside the largest component that a list compares with all others
DEEP = 1 << 16  # retained values of the deeper sketches
NEED = 8
HOT_SHARE = 1000  # a class with more than this part of the rows is not shuffled
HOT_LEAST = 10_000
CHUNK_BYTES = 4_000_000


@dataclass(frozen=True)
class Likeness:
    """Link when ``100 * intersection >= percent * union``."""
    shingle: int = 5
    percent: int = 80
    k: int = 64

    def shared(self, n: Column) -> Column:
        """Retained values that linked sets share at least, for a set of n.

        A set of at most ``whole()`` values, and every set linked with it, is
        retained whole, so the bound is exact; else it is six deviations below
        the mean, or the exact one where that is less.
        """
        p = self.percent / 100
        exact = F.ceil(n * F.lit(self.percent) / F.lit(100))
        bound = max(1, int(self.k * p - 6 * (self.k * p * (1 - p)) ** 0.5))
        return F.when(n <= self.whole(), exact).otherwise(F.least(exact, F.lit(bound)))

    def whole(self) -> int:
        """Largest size of a set that is retained whole like all sets linked with it."""
        return self.k * self.percent // 100


def chunks(batch: pa.RecordBatch, text: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``limit`` bytes of text, one row at least."""
    _, starts = bt.flat(batch.column(text))
    at = 0
    while at < batch.num_rows:
        to = int(np.searchsorted(starts, starts[at] + limit, side="right")) - 1
        to = min(max(to, at + 1), batch.num_rows)
        yield batch.slice(at, to - at)
        at = to


def shingle_sets(texts: pa.Array, shingle: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes per text."""
    raw, starts = bt.flat(texts)
    begin, end, owner = bt.word_spans(raw := bt.LOWER[raw], starts)
    words = bt.word_hashes(raw, begin, end)
    first = np.searchsorted(owner, np.arange(len(starts)))
    value = np.zeros(len(words), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(shingle):
            # words beyond the end count as nothing: only short texts see that
            w = np.zeros(len(words), np.uint64)
            w[:len(words) - j] = words[j:]
            beyond = np.ones(len(words), bool)
            beyond[:len(words) - j] = owner[j:] != owner[:len(words) - j]
            w[beyond] = 0
            value = bt.mix(value + w, seed=11 + j)
    out = []
    for a, b in zip(first[:-1], first[1:]):
        n = b - a
        out.append(np.unique(value[a:a + max(n - shingle + 1, 1)]) if n else value[:0])
    return out


def lists_of(arrays: list[np.ndarray]) -> pa.ListArray:
    sizes = np.cumsum([0] + [len(a) for a in arrays]).astype(np.int32)
    flat = np.concatenate(arrays) if arrays else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(sizes), pa.array(flat.view(np.int64)))


def sketches(docs: DataFrame, like: Likeness) -> DataFrame:
    """``_id``, ``_key``, set size, two digests of the set, and the sketch."""
    def made(batches):
        for big in batches:
            for b in chunks(big, "_text"):
                sets = shingle_sets(b.column("_text"), like.shingle)
                with np.errstate(over="ignore"):
                    one = np.array([bt.mix(s, 21).sum(dtype=np.uint64) for s in sets], np.uint64)
                    two = np.array([np.bitwise_xor.reduce(bt.mix(s, 22)) if len(s) else 0
                                    for s in sets], np.uint64)
                yield pa.RecordBatch.from_arrays([
                    b.column("_id"), b.column("_key"), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(one.view(np.int64)), pa.array(two.view(np.int64)),
                    lists_of([s[:like.k] for s in sets])],
                    ["_id", "_key", "n", "d1", "d2", "sketch"])
    return docs.select("_id", "_key", "_text").mapInArrow(
        made, "_id long, _key long, n long, d1 long, d2 long, sketch array<long>")


def full_sets(docs: DataFrame, like: Likeness) -> DataFrame:
    """``_id`` and its whole set."""
    def made(batches):
        for big in batches:
            for b in chunks(big, "_text"):
                yield pa.RecordBatch.from_arrays(
                    [b.column("_id"), lists_of(shingle_sets(b.column("_text"), like.shingle))],
                    ["_id", "shingles"])
    return docs.select("_id", "_text").mapInArrow(made, "_id long, shingles array<long>")


def inverted_lists(classes: DataFrame, like: Likeness) -> DataFrame:
    """(value, rep, need, central) under the rarest retained values, lists of one left out.

    ``central`` says how common the retained values of a set are.  Sets that share c retained values share ``need`` of their s - c + need rarest.
    """
    kept = classes.select("rep", "n", F.explode("sketch").alias("v"))
    often = kept.groupBy("v").agg(F.count(F.lit(1)).alias("often")).filter("often > 1")
    size = F.least("n", F.lit(like.k))
    need = F.least(F.lit(NEED), like.shared(F.col("n")))
    # values of one document come first, but have no list: they only use up places
    places = size - like.shared(F.col("n")) + need
    found = (kept.join(often, "v").groupBy("rep", "n")
             .agg(F.sort_array(F.collect_list(F.struct("often", "v"))).alias("vs"),
                  F.sum("often").alias("common"))
             .withColumn("central", F.col("common") / size)
             .withColumn("places", F.greatest(places - (size - F.size("vs")), F.lit(0)).cast("int")))
    listed = found.select("rep", need.cast("int").alias("need"), "central",
                          F.explode(F.slice("vs", F.lit(1), F.col("places"))).alias("x"))
    return listed.select(F.col("x.v").alias("v"), "rep", "need", "central")


def deeper_lists(members: DataFrame, sets: DataFrame, like: Likeness) -> DataFrame:
    """(v, rep, component, n, central, place, first) under the rarest values of deeper sketches.

    ``members``: (rep, component).  The rarest value that two linked sets share
    has at most as many values of either before it as they may differ in.
    ``first`` marks the fewer places where it can lie in a set that is linked
    with one at least as large.
    """
    n = F.size("shingles").cast("long")
    kept = written(members.join(sets, "rep")
                   .select("rep", "component", n.alias("n"),
                           F.explode(F.slice("shingles", 1, like.k)).alias("v")), "deeper")
    often = kept.groupBy("v").agg(F.count(F.lit(1)).alias("often")).filter("often > 1")
    size, n = F.least("n", F.lit(like.k)), F.col("n")
    found = (kept.join(often, "v").groupBy("rep", "component", "n")
             .agg(F.sort_array(F.collect_list(F.struct("often", "v"))).alias("vs"),
                  F.sum("often").alias("common"))
             .withColumn("central", F.col("common") / size)
             # values of one document come first
             .withColumn("alone", size - F.size("vs")))
    places = F.greatest(size - like.shared(n) + 1 - F.col("alone"), F.lit(0)).cast("int")
    listed = found.select("rep", "component", "n", "central", "alone",
                          F.posexplode(F.slice("vs", F.lit(1), places)).alias("at", "x"))
    place = F.col("alone") + F.col("at")
    # with a set at least as large: intersection >= percent / (100 + percent) * 2n
    first = (n > like.whole()) | ((n - place) * (100 + like.percent) >= 2 * like.percent * n)
    return listed.select(F.col("x.v").alias("v"), "rep", "component", "n", "central",
                         place.alias("place"), first.alias("first"))


def linked(pairs: DataFrame, classes: DataFrame, sets: DataFrame, like: Likeness) -> DataFrame:
    """Of candidate pairs (a, b): those whose full sets are alike enough."""
    # counted, and sent to both sides: written, so that pairs are taken apart once
    needed = written(pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct(), "needed")
    info = classes.select("rep", "n", "sketch").join(small(needed), "rep", "left_semi")
    a = info.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("ka"))
    b = info.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("kb"))
    lesser, larger = F.least("na", "nb"), F.greatest("na", "nb")
    united = F.slice(F.array_sort(F.array_union("ka", "kb")), 1, like.k)
    common = F.size(F.array_intersect(united, F.array_intersect("ka", "kb")))
    likely = (pairs.join(a, "a").join(b, "b")
              .filter(lesser * 100 >= larger * like.percent)
              .filter(common >= F.when(larger <= like.k, F.lit(1))
                      .otherwise(like.shared(F.lit(like.k))))
              .select("a", "b"))
    x = sets.select(F.col("rep").alias("a"), F.col("shingles").alias("sa"))
    y = sets.select(F.col("rep").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb")).cast("long")
    return (likely.join(x, "a").join(y, "b")
            .filter(both * 100 >= (F.size("sa") + F.size("sb") - both) * like.percent)
            .select("a", "b"))


def contracted(links: DataFrame) -> DataFrame:
    """(rep, component) of every linked rep: the smallest rep it reaches.

    Each round sends every node to its smallest neighbour, or itself, follows
    those steps once more, and merges what meets; edges inside a merged node
    vanish, so a star is done in one round.
    """
    edges = written(links.select("a", "b").distinct(), "links")
    names = written(edges.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
                    .select("rep", F.col("rep").alias("component")), "names")
    while not edges.isEmpty():
        ways = edges.select("a", "b").union(edges.select("b", "a"))
        step = written(ways.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("to")), "steps")
        second = step.select(F.col("a").alias("to"), F.col("to").alias("next"))
        step = written(step.join(second, "to", "left")
                       .select(F.col("a"), F.coalesce("next", "to").alias("to")), "steps")
        left = step.select("a", F.col("to").alias("a2"))
        right = step.select(F.col("a").alias("b"), F.col("to").alias("b2"))
        edges = written(edges.join(left, "a").join(right, "b").filter("a2 <> b2")
                        .select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b"))
                        .distinct(), "links")
        renamed = step.select(F.col("a").alias("component"), "to")
        names = written(names.join(renamed, "component", "left")
                        .select("rep", F.coalesce("to", "component").alias("component")), "names")
    return names


def numbered(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` as ``_doc``, written with a number of their own, ``_row``."""
    return written(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"),
                               F.monotonically_increasing_id().alias("_row")), "numbered")


def components(rows: DataFrame, like: Likeness, key: str, text: str) -> tuple[DataFrame, list[str]]:
    """Of numbered rows: (_row, _key, n, component, least), and the paths of the
    written tables that it is read from; all others are removed.

    A component has the smallest row number of it as its name; ``least`` is
    its smallest id.  An empty set is a component of its own.
    """
    ids = F.coalesce(F.col("_doc")[key].cast("long"), F.lit(NO_ID))
    docs = rows.select(F.col("_row").alias("_id"), ids.alias("_key"), F.col("_doc")[text].alias("_text"))
    base, at = stored(sketches(docs, like), "sketches")
    with tidied(rows.sparkSession):
        label, names = stored(class_labels(docs, base, like), "labels")
    return labelled(base, label), [at, names]


def class_labels(docs: DataFrame, base: DataFrame, like: Likeness) -> DataFrame:
    """(component, n, d1, d2, copies, least) of every class of equal sets."""
    classes = written(base.filter("n > 0").groupBy("n", "d1", "d2")
                      .agg(F.min("_id").alias("rep"), F.min("_key").alias("least"),
                           F.count(F.lit(1)).alias("copies"),
                           F.first("sketch").alias("sketch")), "classes")
    lists = inverted_lists(classes, like)
    lists = written(lists, "lists")
    shared = lists.groupBy("v").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select("v")
    at = written(lists.join(shared, "v").withColumn("component", F.col("rep")), "open")
    size = at.count()
    listed = at.select(F.col("rep").alias("_id")).distinct()
    sets = written(full_sets(docs.join(small(listed), "_id", "left_semi"), like)
                   .withColumnRenamed("_id", "rep"), "sets")
    found, names = [], None

    def compared(pairs: DataFrame) -> DataFrame:
        """Components by all links found so far and those among ``pairs``."""
        found.append(written(linked(written(pairs, "pairs"), classes, sets, like), "found"))
        return contracted(reduce(DataFrame.unionByName, found))

    for turn in range(PIVOT_ROUNDS + 1):
        if at.isEmpty():
            break
        last = turn == PIVOT_ROUNDS or turn > 0 and crossing(at).agg(
            F.sum("pairs")).first()[0] <= 2 * size
        if last:
            short, deep = left_over(at)
            deeper = written(deeper_lists(deep, sets, replace(like, k=DEEP)), "deeper-lists")
            if not deeper.isEmpty():
                # what is not linked with the most central set has few places to meet others in
                deeper = written(renamed(deeper, compared(against_pivot(deeper, 0))), "deeper-lists")
            names = compared(against_others(short).union(against_deeper(deeper, like)).distinct())
            break
        names = compared(against_pivot(at, turn))
        at = renamed(at, names)
        several = (at.groupBy("v").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
                   .filter("lo < hi").select("v"))
        at = written(at.join(several, "v"), "open")
    if names is None:
        names = lists.select("rep", F.col("rep").alias("component")).limit(0)
    label = written(classes.join(names, "rep", "left").select(
        "n", "d1", "d2", "copies", "least", F.coalesce("component", "rep").alias("component")), "labels")
    least = label.groupBy("component").agg(F.min("least").alias("least"))
    return label.drop("least").join(small(written(least, "least")), "component")


def labelled(base: DataFrame, label: DataFrame) -> DataFrame:
    """Rows with the component of their class; large classes travel, not their rows."""
    same = ["n", "d1", "d2"]
    many = max(HOT_LEAST, base.count() // HOT_SHARE)
    hot = label.filter(F.col("copies") > many).select(*same, F.struct("component", "least").alias("_of"))
    # fewer than HOT_SHARE classes hold that many rows each
    marked = base.select("_id", "_key", *same).join(F.broadcast(hot), same, "left")
    alone = F.struct(F.col("_id").alias("component"), F.col("_key").alias("least"))
    done = (marked.filter("_of IS NOT NULL OR n = 0")
            .withColumn("_of", F.coalesce("_of", alone)))
    cold = label.filter(F.col("copies") <= many).select(*same, F.struct("component", "least").alias("_of"))
    rest = marked.filter("_of IS NULL AND n > 0").drop("_of").join(cold, same)
    return done.unionByName(rest).select(F.col("_id").alias("_row"), "_key", "n", "_of.component", "_of.least")


def ordered_pair(a: str, b: str) -> tuple[Column, Column]:
    return F.least(a, b).alias("a"), F.greatest(a, b).alias("b")


def against_pivot(at: DataFrame, turn: int) -> DataFrame:
    """Every member with the pivot that it meets in most of its lists.

    A list's pivot is its most central member first, then a random one.
    """
    order = (F.struct(-F.col("central"), F.col("rep")) if turn == 0
             else F.xxhash64(F.lit(turn), "v", "rep"))
    pivots = at.groupBy("v").agg(F.min_by(F.struct("rep", "component"), order).alias("p"))
    met = (at.join(pivots, "v").filter("component <> p.component")
           .groupBy("rep", F.col("p.rep").alias("pivot")).agg(F.count(F.lit(1)).alias("m")))
    best = met.groupBy("rep").agg(F.max_by("pivot", F.struct("m", "pivot")).alias("pivot"))
    return best.select(*ordered_pair("rep", "pivot")).distinct()


def crossing(at: DataFrame) -> DataFrame:
    """Per list: its largest component, members outside it, and pairs to compare to be complete."""
    sizes = at.groupBy("v", "component").agg(F.count(F.lit(1)).alias("m"))
    return (sizes.groupBy("v").agg(F.sum("m").alias("all"),
                                   F.max(F.struct("m", "component")).alias("top"))
            .select("v", F.col("top.component").alias("main"), (F.col("all") - F.col("top.m")).alias("minor"),
                    ((F.col("all") - F.col("top.m")) * F.col("all")).alias("pairs")))


def renamed(at: DataFrame, names: DataFrame) -> DataFrame:
    """With the component of every member by ``names``; one that has none is its own."""
    return (at.drop("component").join(names, "rep", "left")
            .withColumn("component", F.coalesce("component", "rep")))


def left_over(at: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Short lists, and the members of the others: (rep, component).

    A pair of which one member is in short lists only meets in those; all
    other pairs meet in the lists of deeper sketches.
    """
    lists = written(crossing(at), "crossing")
    long = lists.filter(F.col("minor") > FEW).select("v")
    deep = written(at.join(long, "v").select("rep", "component").distinct(), "long")
    marked = (at.join(lists.filter(F.col("minor") <= FEW).select("v", "main"), "v")
              .join(small(deep.select("rep", F.lit(True).alias("deep"))), "rep", "left")
              .withColumn("deep", F.coalesce("deep", F.lit(False))))
    return marked, deep


def against_others(at: DataFrame) -> DataFrame:
    """Members outside the largest component of a list, with all other components.

    Pairs that meet in too few lists to be alike are left out.
    """
    minor = (at.filter("component <> main")
             .select("v", F.col("rep").alias("x"), F.col("component").alias("cx"),
                     F.col("need").alias("nx"), F.col("deep").alias("dx")))
    met = (minor.join(at, "v").filter("NOT (deep AND dx)")
           .filter("component <> cx AND (component = main OR rep < x)"))
    return (met.groupBy(*ordered_pair("rep", "x"))
            .agg(F.count(F.lit(1)).alias("m"), F.min(F.least("need", "nx")).alias("need"))
            .filter("m >= need").select("a", "b"))


def against_deeper(lists: DataFrame, like: Likeness) -> DataFrame:
    """Pairs that share a value where linked sets would share their rarest one."""
    x = lists.select("v", F.col("rep").alias("x"), F.col("component").alias("cx"),
                     F.col("n").alias("nx"), F.col("place").alias("px"))
    # what comes after the places in whole sets bounds the intersection
    after = F.least(F.col("n") - F.col("place"), F.col("nx") - F.col("px"))
    possible = (F.col("nx") > DEEP) | (
        after * (100 + like.percent) >= (F.col("n") + F.col("nx")) * like.percent)
    pairs = lists.filter("first").join(
        x, (lists.v == x.v) & (F.col("component") != F.col("cx"))
        & ((F.col("nx") > F.col("n")) | (F.col("nx") == F.col("n")) & (F.col("x") > F.col("rep")))
        & (F.col("nx") * like.percent <= F.col("n") * 100) & possible)
    return pairs.select(*ordered_pair("rep", "x")).distinct()


def near_duplicates(docs: DataFrame, like: Likeness = Likeness(), key: str = "doc_id",
                    text: str = "text") -> DataFrame:
    """Key, n_shingles, component_id and kept, one row per row of ``docs``."""
    rows = numbered(docs.select(F.col(f"`{key}`"), F.col(f"`{text}`")))
    found, _ = components(rows, like, key, text)
    shown = {c: F.when(F.col(c) < F.lit(NO_ID), F.col(c)) for c in ("_key", "least")}
    return found.select(shown["_key"].alias(key), F.col("n").alias("n_shingles"),
                        shown["least"].alias("component_id"),
                        (F.col("_key") == F.col("least")).alias("kept"))


def one_of_each(docs: DataFrame, like: Likeness = Likeness(), key: str = "doc_id",
                text: str = "text") -> DataFrame:
    """Rows of ``docs`` without those that have a kept near-duplicate.

    Of each component the row with the smallest id stays, of such rows the
    first by number; a row goes only for one of its own component.
    """
    rows = numbered(docs)
    found, paths = components(rows, like, key, text)
    kept = written(found.filter(F.col("_key") == F.col("least"))
                   .groupBy("component").agg(F.min("_row").alias("_row")), "kept").select("_row")
    for path in paths:
        discard(docs.sparkSession, path)
    return rows.join(small(kept), "_row", "left_semi").select("_doc.*")
