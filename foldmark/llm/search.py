"""Ranked lexical search for a stated set of items, evaluated together.

The items are taken in blocks.  For a block, the set of terms that most items
share is mined pair by pair: a pair that several items hold becomes a node, and
stands for both in all of them, until no pair is held twice.  What results is
a DAG from terms over shared sets to items.

Two passes go over the documents.  The first reduces each text to its length
and to the block's terms it holds, and gives the counts N, L and df over all
documents.  The second takes documents in batches: an accumulator per node
holds the partial score of every document of the batch, computed once from the
node's two parts, and items add up their nodes.  A task keeps the best of each
item; merging them is a ranking in two steps, so that no item's candidates meet
in one task at once.

Scores are sums of 64-bit integers: w * ((10^9 tf) div (1000 tf + 12 m)), with
w = floor(1000 ln((2N + 2) / (2 df + 1))) and m = 75 + ((25 n N) div L).

Defined results: a term is a run of bytes other than ASCII punctuation, space
and control characters, with A-Z lower-cased; a null or empty text has none; an
item without a term, or whose terms occur nowhere, has no rows; a term an item
repeats counts as often; repeated items are ranked each for itself, repeated
documents are ranked one after the other; equal scores go by key, without a key
last; other columns, whatever their names, are not read; without documents or
items there are no rows.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from foldmark.llm import bytetools as bt
from foldmark.llm.near_dups import chunks
from foldmark.llm.order import written

# What a block of items may hold: items, and pairs of terms looked at when mining.
BLOCK_ITEMS = 512
BLOCK_PAIRS = 4_000_000
# Bytes of accumulators that a batch of documents may take, and bytes of text per chunk.
ACCUMULATORS = 64_000_000
CHUNK = 2_000_000
SALTS = 32

APART = np.zeros(256, dtype=bool)
APART[[*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True


# -- terms ------------------------------------------------------------------------

def terms_of(text: str | None) -> list[bytes]:
    raw, starts = bt.flat(pa.array([text], pa.string()))
    raw = bt.LOWER[raw]
    begin, end, _ = bt.word_spans(raw, starts, APART)
    return [raw[a:z].tobytes() for a, z in zip(begin, end)]


class Vocabulary:
    """Finds a block's terms among words, by hash and then byte by byte."""

    def __init__(self, terms: list[bytes]):
        self.terms = terms
        self.raw = np.frombuffer(b"".join(terms), np.uint8)
        self.length = np.array([len(t) for t in terms], np.int64)
        self.start = np.cumsum(self.length) - self.length
        hashes = bt.word_hashes(self.raw, self.start, self.start + self.length)
        self.order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[self.order]
        if len(np.unique(self.hashes)) < len(terms):
            raise ValueError("two terms have one hash")

    def codes(self, raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The number of each word's term, -1 where it is none of them."""
        if not len(begin) or not self.terms:
            return np.full(len(begin), -1)
        h = bt.word_hashes(raw, begin, end)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        hit = np.flatnonzero(self.hashes[at] == h)
        code = self.order[at[hit]]
        same = end[hit] - begin[hit] == self.length[code]
        hit, code = hit[same], code[same]
        left = np.arange(len(hit))
        good = np.ones(len(hit), bool)
        for i in range(int(self.length[code].max(initial=0))):
            left = left[self.length[code[left]] > i]
            good[left] &= raw[begin[hit[left]] + i] == self.raw[self.start[code[left]] + i]
        out = np.full(len(begin), -1)
        out[hit[good]] = code[good]
        return out


# -- the plan of a block -------------------------------------------------------------

@dataclass(frozen=True)
class Plan:
    """``parts[i]`` are the two parts of node ``len(leaves) + i``; a leaf is a
    term and a factor; ``items`` lists the nodes each item adds up."""

    leaves: list[tuple[int, int]]
    parts: list[tuple[int, int]]
    items: list[list[int]]


def plan_of(needs: list[Counter], pairs: int = BLOCK_PAIRS) -> Plan:
    """Mine the sets that items share; ``needs`` counts each item's terms.

    A term repeated q times is its plain leaf, which others may share, and
    another leaf of factor q - 1.  Items of very many terms are not mined, as their
    pairs alone would exceed ``pairs``; they add up leaves.
    """
    leaves: dict[tuple[int, int, bool], int] = {}
    holds: list[set[int]] = []
    for need in needs:
        wanted = [(t, 1, True) for t in need]
        wanted += [(t, q - 1, False) for t, q in need.items() if q > 1]
        holds.append({leaves.setdefault(leaf, len(leaves)) for leaf in wanted})
    mined = [i for i, h in enumerate(holds) if len(h) ** 2 <= 2 * pairs]
    # only what two items hold can be part of a shared set
    often = Counter(n for i in mined for n in holds[i])
    users: dict[tuple[int, int], set[int]] = {}
    for i in mined:
        known = sorted(n for n in holds[i] if often[n] > 1)
        for k, a in enumerate(known):
            for b in known[k + 1:]:
                users.setdefault((a, b), set()).add(i)
    queue = [(-len(u), pair) for pair, u in users.items() if len(u) > 1]
    heapq.heapify(queue)
    parts: list[tuple[int, int]] = []
    while queue:
        n, (a, b) = heapq.heappop(queue)
        now = users[a, b]
        if len(now) < 2:
            continue
        if len(now) != -n:                  # others took some of its items since
            heapq.heappush(queue, (-len(now), (a, b)))
            continue
        node = len(leaves) + len(parts)
        parts.append((a, b))
        met: dict[int, set[int]] = {}
        for i in list(now):
            holds[i] -= {a, b}
            for c in holds[i]:
                for gone in (a, b):
                    pair = (c, gone) if c < gone else (gone, c)
                    if pair in users:
                        users[pair].discard(i)
                if often[c] > 1:
                    met.setdefault(c, set()).add(i)
            holds[i].add(node)
        often[node] = len(now)
        users[a, b] = set()
        for c, u in met.items():
            if len(u) > 1:
                users[c, node] = u
                heapq.heappush(queue, (-len(u), (c, node)))
    return Plan([(t, q) for t, q, _ in leaves], parts, [sorted(h) for h in holds])


def scores(plan: Plan, contributions: np.ndarray) -> np.ndarray:
    """Scores of items (rows) and documents (columns), from those of terms."""
    n, docs = len(plan.leaves), contributions.shape[1]
    nodes = np.empty((n + len(plan.parts), docs), np.int64)
    for k, (term, factor) in enumerate(plan.leaves):
        np.multiply(contributions[term], factor, out=nodes[k])
    for k, (a, b) in enumerate(plan.parts):
        np.add(nodes[a], nodes[b], out=nodes[n + k])
    out = np.zeros((len(plan.items), docs), np.int64)
    for i, parts in enumerate(plan.items):
        for k in parts:
            out[i] += nodes[k]
    return out


# -- documents -------------------------------------------------------------------------

POSTINGS = "doc_id long, n long, terms array<int>, tfs array<long>"


def postings(docs: DataFrame, vocabulary: Vocabulary, key: str, text: str) -> DataFrame:
    """Per document: n, and the terms of the block it holds, with their numbers."""
    size = max(1, len(vocabulary.terms))

    def made(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for b in chunks(big, "_text", CHUNK):
                raw, starts = bt.flat(b.column("_text"))
                raw = bt.LOWER[raw]
                begin, end, owner = bt.word_spans(raw, starts, APART)
                code = vocabulary.codes(raw, begin, end)
                found, tf = np.unique(owner[code >= 0] * size + code[code >= 0], return_counts=True)
                ends = np.searchsorted(found, np.arange(b.num_rows + 1) * size).astype(np.int32)
                lists = [pa.ListArray.from_arrays(ends, pa.array(v, t)) for v, t in (
                    ((found % size).astype(np.int32), pa.int32()), (tf, pa.int64()))]
                yield pa.RecordBatch.from_arrays(
                    [b.column("_key"), pa.array(np.bincount(owner, minlength=b.num_rows)), *lists],
                    ["doc_id", "n", "terms", "tfs"])

    plain = docs.select(F.col(f"`{key}`").cast("long").alias("_key"),
                        F.col(f"`{text}`").cast("string").alias("_text"))
    return plain.mapInArrow(made, POSTINGS)


class Best:
    """The best documents of each item so far."""

    def __init__(self, items: int, top: int):
        self.top = top
        self.rows = [np.zeros((3, 0), np.int64) for _ in range(items)]   # score, no key, key
        self.least = np.ones(items, np.int64)

    def add(self, found: np.ndarray, missing: np.ndarray, keys: np.ndarray) -> None:
        for i in np.flatnonzero((found >= self.least[:, None]).any(axis=1)):
            at = np.flatnonzero(found[i] >= self.least[i])
            rows = np.hstack([self.rows[i], np.stack([found[i][at], missing[at], keys[at]])])
            order = np.lexsort((rows[2], rows[1], -rows[0]))[:self.top]
            self.rows[i] = rows[:, order]
            if len(order) == self.top:
                self.least[i] = rows[0, order[-1]]


def candidates(posted: DataFrame, plan: Plan, weights: np.ndarray, n_docs: int, n_terms: int,
               top: int) -> DataFrame:
    """Each task's best documents of every item."""
    width = len(plan.leaves) + len(plan.parts) + len(plan.items) + len(weights)
    step = max(16, ACCUMULATORS // (8 * max(1, width)))

    def made(batches):
        best = Best(len(plan.items), top)
        for big in batches:
            for at in range(0, big.num_rows, step):
                b = big.slice(at, step)
                n = b.column("n").to_numpy(zero_copy_only=False).astype(np.int64)
                ids = b.column("doc_id")
                ends = b.column("terms").offsets.to_numpy().astype(np.int64)
                term = b.column("terms").values.to_numpy()[ends[0]:ends[-1]]
                tf = b.column("tfs").values.to_numpy()[ends[0]:ends[-1]].astype(np.int64)
                owner = np.repeat(np.arange(b.num_rows), np.diff(ends))
                m = 100 - 25 + (25 * n * n_docs) // n_terms
                part = np.zeros((len(weights), b.num_rows), np.int64)
                part[term, owner] = weights[term] * ((1_000_000_000 * tf)
                                                     // (1000 * tf + 12 * m[owner]))
                best.add(scores(plan, part), ids.is_null().to_numpy(zero_copy_only=False).astype(np.int64),
                         ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        items = np.concatenate([np.full(r.shape[1], i) for i, r in enumerate(best.rows)])
        score, missing, keys = np.hstack(best.rows)
        yield pa.RecordBatch.from_arrays(
            [pa.array(items), pa.array(keys, mask=missing.astype(bool)), pa.array(score)],
            ["_item", "doc_id", "score"])

    return posted.mapInArrow(made, "_item long, doc_id long, score long")


def ranked(found: DataFrame, top: int) -> DataFrame:
    """The best of each item, first within shares of the tasks and then over all."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    part = F.pmod(F.spark_partition_id(), F.lit(SALTS))
    few = (found.withColumn("_part", part)
           .withColumn("rank", F.row_number().over(W.partitionBy("_item", "_part").orderBy(*order)))
           .filter(F.col("rank") <= top).drop("rank"))
    return (few.withColumn("rank", F.row_number().over(W.partitionBy("_item").orderBy(*order)))
            .filter(F.col("rank") <= top))


# -- items -----------------------------------------------------------------------------

def blocks(items: DataFrame, key: str, text: str) -> Iterator[list[tuple[int | None, Counter]]]:
    """Items in blocks of bounded size; one block at a time is on the driver."""
    block, pairs = [], 0
    rows = items.select(F.col(f"`{key}`").cast("long").alias("k"),
                        F.col(f"`{text}`").cast("string").alias("t"))
    for r in rows.toLocalIterator():
        need = Counter(terms_of(r["t"]))
        block.append((r["k"], need))
        pairs += len(need) ** 2 // 2
        if len(block) >= BLOCK_ITEMS or pairs >= BLOCK_PAIRS:
            yield block
            block, pairs = [], 0
    if block:
        yield block


def search(docs: DataFrame, items: DataFrame, top: int = 20, key: str = "doc_id",
           text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """item_id, rank, doc_id and score of each item's ``top`` documents."""
    spark = docs.sparkSession
    out = []
    for block in blocks(items, item_key, item_text):
        terms = sorted({t for _, need in block for t in need})
        number = {t: i for i, t in enumerate(terms)}
        plan = plan_of([Counter({number[t]: q for t, q in need.items()}) for _, need in block])
        posted = written(postings(docs, Vocabulary(terms), key, text), "search-postings")
        facts = posted.agg(F.count_if(F.col("n") > 0).alias("docs"), F.sum("n").alias("terms")).first()
        if not facts["terms"] or not terms:
            continue
        # as many lines as the block has terms
        df = np.zeros(len(terms), np.int64)
        for r in posted.select(F.explode("terms").alias("t")).groupBy("t").count().collect():
            df[r["t"]] = r["count"]
        n = facts["docs"]
        weights = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1)))
                            for d in df.tolist()], np.int64)
        best = ranked(candidates(posted, plan, weights, n, facts["terms"], top), top)
        names = spark.createDataFrame([(i, k) for i, (k, _) in enumerate(block)], "_item long, item_id long")
        out.append(written(best.join(F.broadcast(names), "_item").select(
            "item_id", "rank", "doc_id", "score"), "search-ranked"))
    if not out:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    return found
