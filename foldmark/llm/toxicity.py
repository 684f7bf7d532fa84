"""Toxicity by the nearest labelled examples.

Labelled documents are sampled up to ``Settings.per_class`` per class, by a
hash of their id; that bound is the only one on what is learnt from.  All terms
that go with the label (chi-square over the sample) form the vocabulary, and
examples become unit vectors of TF-IDF weights over it.  Over all words instead,
topics outweigh toxicity and the neighbours say little.

A document's neighbours are its exact k best examples by cosine.  The examples
lie in blocks, and the inverted index knows for every term the largest weight
per block.  Their sum bounds the cosine of a whole block: blocks with the best
bounds are opened first, and those whose bound stays below the k-th best cosine
are never opened.  Neighbours vote with their cosine as weight; votes are turned into
probabilities by isotonic regression over the sample, each example being left
out of its own vote, and weighted so that the classes have their true shares.

Defined results: a text without terms of the vocabulary, such as a null or an
empty one, has no neighbours and gets the score of a vote of zero; without
labels every score is 0; cosines and votes have nine digits, and of equal ones
the example that lies first in the index comes first; labels of one id that contradict count as toxic; an
example does not vote on a row with its own id; rows that share an id are
scored one by one.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from foldmark.llm.near_dups import chunks
from foldmark.llm.order import written

KNOWN = 20_000
TOGETHER = 256  # queries scored side by side
DIGITS = 9  # of a cosine or vote, so that the order of sums does not matter
EXACT = 1e-8
WORD = re.compile(r"\w+")


@dataclass(frozen=True)
class Settings:
    per_class: int = 4000
    least_documents: int = 5
    least_chi_square: float = 15.0
    neighbours: int = 15
    block: int = 64
    smoothing: float = 0.25


def held_out(key: Column) -> Column:
    """Rows never learnt from: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def terms_of(text: str | None) -> Counter:
    return Counter(words_of(text))


class BlockMaxIndex:
    """Examples by block and term, and the largest weight of a term per block."""

    def __init__(self, rows: list[dict[int, float]], n_terms: int, block: int):
        # examples with the same main term lie together, so that bounds tell blocks apart
        self.order = sorted(range(len(rows)), key=lambda i: max(
            ((w, -t) for t, w in rows[i].items()), default=(0.0, 0))[::-1])
        self.n, self.n_terms = len(rows), n_terms
        self.cuts = [*range(0, self.n, block), self.n]
        self.top = np.zeros((n_terms, len(self.cuts) - 1))
        self.blocks: list[tuple[np.ndarray, np.ndarray]] = []  # its terms; weights, term by example
        for b, (a, z) in enumerate(zip(self.cuts[:-1], self.cuts[1:])):
            inside = [rows[i] for i in self.order[a:z]]
            terms = sorted({t for r in inside for t in r})
            place = {t: i for i, t in enumerate(terms)}
            weight = np.zeros((len(terms), z - a))
            for j, r in enumerate(inside):
                for t, w in r.items():
                    weight[place[t], j] = w
            at = np.array(terms, np.int64)
            self.blocks.append((at, weight))
            if terms:
                self.top[at, b] = weight.max(axis=1)

    def nearest(self, query: dict[int, float], k: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions in ``order`` and cosines of the k best, best first.

        Of equal cosines the earlier position wins; only those above EXACT count.
        """
        return self.nearest_of([query], k)[0]

    def nearest_of(self, queries: list[dict[int, float]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """``nearest`` of several queries, scored side by side in every block they open."""
        if not self.n:
            return [(np.zeros(0, np.int64), np.zeros(0))] * len(queries)
        asked = np.zeros((len(queries), self.n_terms))
        for i, q in enumerate(queries):
            asked[i, list(q)] = list(q.values())
        bound = asked @ self.top
        scores = np.zeros((len(queries), self.n))
        # the blocks with the best bounds first, then all that may still hold a neighbour
        step = self.cuts[1]
        begun = np.argsort(-bound, axis=1, kind="stable")[:, :max(2, -(-4 * k // step))]
        chosen = np.zeros(bound.shape, bool)
        np.put_along_axis(chosen, begun, True, axis=1)
        self.open(asked, chosen, scores)
        at = (begun[:, :, None] * step + np.arange(step)).reshape(len(queries), -1)
        seen = np.where(at < self.n, np.take_along_axis(scores, np.minimum(at, self.n - 1), axis=1), 0)
        least = kth_best(seen, k)[:, None] - EXACT
        self.open(asked, ~chosen & (bound > 0) & (bound >= least), scores)
        out = []
        for row, low in zip(scores, kth_best(scores, k)):
            hit = np.flatnonzero(row >= max(low - EXACT, EXACT))
            near = np.round(row[hit], DIGITS)
            best = np.argsort(-near, kind="stable")[:k]
            out.append((hit[best], near[best]))
        return out

    def open(self, asked: np.ndarray, chosen: np.ndarray, scores: np.ndarray) -> None:
        """Write the cosines of the examples in the blocks that each query chose."""
        for (terms, weight), a, z, wanted in zip(self.blocks, self.cuts[:-1], self.cuts[1:], chosen.T):
            rows = np.flatnonzero(wanted)
            if len(rows) and len(terms):
                scores[rows, a:z] = asked[np.ix_(rows, terms)] @ weight


def kth_best(scores: np.ndarray, k: int) -> np.ndarray:
    """Per row; 0 where there are fewer."""
    if scores.shape[1] < k:
        return np.zeros(len(scores))
    return np.partition(scores, -k, axis=1)[:, -k]


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rising steps of the weighted mean of y: (from x on, value)."""
    order = np.argsort(x, kind="stable")
    stack: list[list[float]] = []
    for xi, yi, wi in zip(x[order], y[order], w[order]):
        if stack and stack[-1][0] == xi:
            stack[-1][1] += yi * wi
            stack[-1][2] += wi
        else:
            stack.append([xi, yi * wi, wi])
    out: list[list[float]] = []
    for s in stack:
        out.append(s)
        while len(out) > 1 and out[-2][1] * out[-1][2] >= out[-1][1] * out[-2][2]:
            last = out.pop()
            out[-1][1] += last[1]
            out[-1][2] += last[2]
    return np.array([s[0] for s in out]), np.array([s[1] / s[2] for s in out])


class Scorer:
    """What is sent to the tasks: vocabulary, index, labels and calibration."""

    def __init__(self, vocabulary: dict[str, int], idf: np.ndarray, examples: list[tuple],
                 shares: dict[int, float], settings: Settings):
        """``examples``: (id, toxic, {term: count}); ``shares``: documents per class."""
        self.vocabulary, self.idf, self.settings = vocabulary, idf.tolist(), settings
        self.known: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}  # answers given before
        rows = [self.vector(c) for _, _, c in examples]
        self.index = BlockMaxIndex(rows, len(vocabulary), settings.block)
        order = self.index.order
        self.ids = np.array([examples[i][0] for i in order], np.int64)
        self.toxic = np.array([examples[i][1] for i in order], np.int64)
        votes = np.array([v[0] for v in self.votes([rows[i] for i in order], own=True)])
        n = np.bincount(self.toxic, minlength=2) if len(order) else np.zeros(2)
        weight = np.array([shares.get(c, 0) / max(n[c], 1) for c in (0, 1)])
        self.steps, self.values = isotonic(votes, self.toxic.astype(float), weight[self.toxic]) \
            if len(order) else (np.zeros(1), np.zeros(1))

    def vector(self, counts: dict[int, int]) -> dict[int, float]:
        raw = {t: (1 + math.log(c)) * self.idf[t] for t, c in counts.items()}
        norm = sum(w * w for w in raw.values()) ** 0.5
        return {t: w / norm for t, w in sorted(raw.items())} if norm else {}

    def votes(self, queries: list[dict[int, float]], own: bool = False
              ) -> Iterator[tuple[float, np.ndarray, np.ndarray]]:
        """Vote, nearest examples and their cosines of every query.

        With ``own``, the queries are the examples in order, and none votes on itself.
        """
        k = self.settings.neighbours
        for a in range(0, len(queries), TOGETHER):
            part = [tuple(q.items()) for q in queries[a:a + TOGETHER]]
            if len(self.known) > KNOWN:
                self.known.clear()
            new = [q for q in dict.fromkeys(part) if q not in self.known]
            if new:
                self.known.update(zip(new, self.index.nearest_of([dict(q) for q in new], k + 1)))
            for i, q in enumerate(part, a):
                at, near = self.known[q]
                if own:
                    at, near = at[at != i], near[at != i]
                at, near = at[:k], near[:k]
                vote = float((near * self.toxic[at]).sum() / (near.sum() + self.settings.smoothing))
                yield round(vote, DIGITS), at, near

    def scores(self, texts: list[str | None]) -> Iterator[tuple[float, list[tuple]]]:
        """Score and evidence of every text."""
        known = self.vocabulary
        queries = [self.vector(Counter(known[w] for w in words_of(t) if w in known)) for t in texts]
        for vote, at, near in self.votes(queries):
            step = max(np.searchsorted(self.steps, vote, side="right") - 1, 0)
            yield float(self.values[step]), [
                (int(self.ids[a]), float(s), int(self.toxic[a])) for a, s in zip(at[:3], near[:3])]


def training_sample(labels: DataFrame, settings: Settings, key: str, label: str
                    ) -> tuple[DataFrame, dict[int, float]]:
    """(_id, toxic): at most ``per_class`` ids of each class; documents per class."""
    known = (labels.filter(F.col(f"`{key}`").isNotNull() & F.col(f"`{label}`").isNotNull()
                           & ~held_out(F.col(f"`{key}`")))
             .groupBy(F.col(f"`{key}`").cast("long").alias("_id"))
             .agg(F.max(F.col(f"`{label}`").cast("int")).alias("toxic")))
    known = written(known, "toxic-labels")
    shares = {r["toxic"]: float(r["n"]) for r in
              known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    parts = [known.filter(F.col("toxic") == c).orderBy(F.xxhash64("_id"), "_id").limit(settings.per_class)
             for c in (0, 1)]
    return written(parts[0].unionByName(parts[1]), "toxic-sample"), shares


def fitted(docs: DataFrame, labels: DataFrame, settings: Settings, key: str, text: str,
           label: str) -> Scorer:
    """Learn from the sample: its bounds hold for all that reaches the driver."""
    sample, shares = training_sample(labels, settings, key, label)
    # at most 2 * per_class ids are sent to the tasks
    examples = written(docs.select(F.col(f"`{key}`").cast("long").alias("_id"), F.col(f"`{text}`").alias("_text"))
                       .join(F.broadcast(sample), "_id"), "toxic-examples")

    def per_term(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for b in chunks(big, "_text", 2_000_000):
                rows = [(w, toxic) for toxic, t in zip(b.column("toxic").to_pylist(), b.column("_text").to_pylist())
                        for w in terms_of(t)]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()),
                                                  pa.array([r[1] for r in rows], pa.int32())], ["term", "toxic"])

    n = {r["toxic"]: r["n"] for r in examples.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n0, n1 = float(n.get(0, 0)), float(n.get(1, 0))
    seen = (examples.select("toxic", "_text").mapInArrow(per_term, "term string, toxic int")
            .groupBy("term").agg(F.sum("toxic").cast("double").alias("a"),
                                 F.count(F.lit(1)).cast("double").alias("df"))
            .filter(F.col("df") >= settings.least_documents))
    a, b = F.col("a"), F.col("df") - F.col("a")
    c, d = F.lit(n1) - a, F.lit(n0) - b
    chi = F.lit(n0 + n1) * F.pow(a * d - b * c, 2) / ((a + b) * (c + d) * F.lit(max(n1, 1)) * F.lit(max(n0, 1)))
    chosen = (seen.withColumn("chi", chi).filter(F.col("chi") >= settings.least_chi_square)
              .orderBy(F.desc("chi"), "term").collect())  # of a bounded sample
    vocabulary = {r["term"]: i for i, r in enumerate(chosen)}
    idf = np.log((1 + n0 + n1) / np.array([r["df"] for r in chosen] or [1.0])) + 1

    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [[(vocabulary[w], m) for w, m in terms_of(t).items() if w in vocabulary]
                    for t in batch.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([
                batch.column("_id"), batch.column("toxic"),
                pa.array([[x[0] for x in r] for r in rows], pa.list_(pa.int32())),
                pa.array([[x[1] for x in r] for r in rows], pa.list_(pa.int32()))],
                ["_id", "toxic", "terms", "counts"])

    found = (examples.select("_id", "toxic", "_text")
             .mapInArrow(counted, "_id long, toxic int, terms array<int>, counts array<int>").collect())
    rows = sorted((r["_id"], r["toxic"], tuple(sorted(zip(r["terms"], r["counts"])))) for r in found)
    return Scorer(vocabulary, idf, [(i, t, dict(c)) for i, t, c in rows], shares, settings)


def scored(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), key: str = "doc_id",
           text: str = "text", label: str = "toxic") -> DataFrame:
    """Key, held_out, score, predicted and evidence: the three nearest examples."""
    scorer = docs.sparkSession.sparkContext.broadcast(fitted(docs, labels, settings, key, text, label))

    def judged(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = scorer.value
        kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("toxic", pa.int32())]))
        for big in batches:
            for at in range(0, big.num_rows, 500):
                b = big.slice(at, 500)
                rows = list(s.scores(b.column("_text").to_pylist()))
                yield pa.RecordBatch.from_arrays([
                    b.column("_id"), pa.array([r[0] for r in rows], pa.float64()),
                    pa.array([[dict(zip(("doc_id", "cosine", "toxic"), e)) for e in r[1]] for r in rows], kind)],
                    ["_id", "score", "evidence"])

    plain = docs.select(F.col(f"`{key}`").cast("long").alias("_id"), F.col(f"`{text}`").alias("_text"))
    out = plain.mapInArrow(judged, "_id long, score double,"
                                   " evidence array<struct<doc_id: long, cosine: double, toxic: int>>")
    return out.select(F.col("_id").alias(key), held_out(F.col("_id")).alias("held_out"), "score",
                      (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")
