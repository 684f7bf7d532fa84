"""Document fingerprints by consistent weighted sampling.

A document is a set of words weighted by how often they occur.  For each of K
samples every word draws, from its hash alone, two gamma variates and an
offset; the word whose quantised weight gives the smallest key is the sample,
together with its quantum.  Two documents agree in a sample with a probability
equal to their generalised Jaccard similarity (sum of smaller over sum of
larger weights).  A sample is kept as 16 bits, four hex digits.

Comparing each document with the next one needs the order of ids: the table is
cut into ranges of ids, each range also receives the first row of the range
after it, and a task walks its ranges in order.  Texts travel once, compressed.

Defined results: a null text is empty; a text without words has the fingerprint
of zeros, which only another such text shares; rows that share an id are
ordered by their text; a null id comes first; the row after the last one is the
first; a single row is followed by itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from foldmark.llm import bytetools as bt
from foldmark.llm.near_dups import chunks
from foldmark.llm.order import in_pieces, width
from foldmark.llm.repeats import small_slices, texts_of

SAMPLES = 128
TERMS_AT_ONCE = 2048
DRAWN_AT_ONCE = 256  # their draws stay in a core's cache
FIRST = -2 ** 63


def uniform(terms: np.ndarray, samples: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent numbers in (0, 1) per term and sample."""
    with np.errstate(over="ignore"):
        h = bt.mix(terms[:, None] + (np.arange(samples, dtype=np.uint64) * np.uint64(0x9FB21C651E98DF25)),
                   seed)
    scale = np.float32(2.0 ** -32)
    low = (h & np.uint64(0xFFFFFFFF)).astype(np.float32)
    return ((h >> np.uint64(32)).astype(np.float32) + np.float32(0.5)) * scale, (low + np.float32(0.5)) * scale


def draws(terms: np.ndarray, samples: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gamma(2, 1) variates r and log c, and offsets, per term and sample."""
    a, b = uniform(terms, samples, 61)
    c, d = uniform(terms, samples, 62)
    offset, _ = uniform(terms, samples, 63)
    return -np.log(a * b), np.log(-np.log(c * d)), offset


def keys_of(terms: np.ndarray, counts: np.ndarray, samples: int) -> tuple[np.ndarray, np.ndarray]:
    """Key and quantum of every weighted word per sample."""
    keys = np.empty((len(terms), samples), np.float32)
    quanta = np.empty((len(terms), samples), np.float32)
    for k in range(0, len(terms), DRAWN_AT_ONCE):
        part = slice(k, k + DRAWN_AT_ONCE)
        r, log_c, offset = draws(terms[part], samples)
        quantum = np.floor(np.log(counts[part].astype(np.float32))[:, None] / r + offset)
        keys[part] = log_c - r * (quantum - offset) - r
        quanta[part] = quantum
    return keys, quanta


def sample_bits(names: np.ndarray) -> np.ndarray:
    """16 bits of names, never all zero."""
    return (names >> np.uint64(48)).astype(np.uint16) | np.uint16(1)


def signatures(texts: pa.Array, samples: int = SAMPLES) -> np.ndarray:
    """One row of 16-bit samples per text.

    Keys depend on the word and its weight alone and are drawn once per batch.
    Words seen once in a text have quantum 0 whatever their draws.
    """
    raw, starts = bt.flat(texts)
    begin, end, owner = bt.word_spans(raw, starts)
    words = bt.word_hashes(raw, begin, end)
    cuts = np.searchsorted(owner, np.arange(len(starts)))
    sets = [np.unique(words[a:z], return_counts=True) for a, z in zip(cuts[:-1], cuts[1:])]
    singles = np.unique(np.concatenate([u[c == 1] for u, c in sets])) if sets else words[:0]
    keys = np.empty((len(singles), samples), np.float32)
    for k in range(0, len(singles), DRAWN_AT_ONCE):
        r, log_c, offset = draws(singles[k:k + DRAWN_AT_ONCE], samples)
        keys[k:k + DRAWN_AT_ONCE] = log_c + r * offset - r
    repeated = [(u[c > 1], c[c > 1]) for u, c in sets]
    pairs = np.zeros(sum(len(u) for u, _ in repeated), [("word", np.uint64), ("count", np.int64)])
    if sets:
        pairs["word"] = np.concatenate([u for u, _ in repeated])
        pairs["count"] = np.concatenate([c for _, c in repeated])
    weighted, place = np.unique(pairs, return_inverse=True)
    many_keys, quanta = keys_of(weighted["word"], weighted["count"], samples)
    ends = np.cumsum([0] + [len(u) for u, _ in repeated])
    at = np.arange(samples)
    out = np.zeros((len(sets), samples), np.uint16)
    with np.errstate(over="ignore"):
        zero = bt.mix(np.zeros(1, np.uint64), 64)
        single_bits = sample_bits(bt.mix(singles + zero, 65))
    # names of samples that repeated words give are made once for all texts
    picked = np.full((len(sets), samples), -1)
    for i, (u, c) in enumerate(sets):
        best = np.full(samples, np.inf, np.float32)
        often = place[ends[i]:ends[i + 1]]
        once = np.searchsorted(singles, u[c == 1])
        for rows, key in ((often, many_keys), (once, keys)):
            for k in range(0, len(rows), TERMS_AT_ONCE):
                some = rows[k:k + TERMS_AT_ONCE]
                part = key.take(some, axis=0)
                row = part.argmin(axis=0)
                least = part[row, at]
                better = least < best
                best = np.where(better, least, best)
                if rows is often:
                    picked[i] = np.where(better, some[row], picked[i])
                else:
                    picked[i, better] = -1
                    out[i] = np.where(better, single_bits[some[row]], out[i])
    texts_at, samples_at = np.nonzero(picked >= 0)
    word = picked[texts_at, samples_at]
    chosen = quanta[word, samples_at].astype(np.int64).view(np.uint64)
    with np.errstate(over="ignore"):
        out[texts_at, samples_at] = sample_bits(bt.mix(weighted["word"][word] + bt.mix(chosen, 64), 65))
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated generalised Jaccard similarity of two fingerprints."""
    return float(np.mean(a == b))


def shown(signature: np.ndarray) -> str:
    return signature.astype(">u2").tobytes().hex()


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text",
                 samples: int = SAMPLES) -> DataFrame:
    """Key and fingerprint of every row; nothing is shuffled."""
    def made(batches):
        for big in batches:
            for b in chunks(big, "_text"):
                yield pa.RecordBatch.from_arrays(
                    [b.column("_id"), pa.array([shown(s) for s in signatures(b.column("_text"), samples)],
                                               pa.string())], ["_id", "fingerprint"])
    plain = docs.select(F.col(f"`{key}`").cast("long").alias("_id"), F.col(f"`{text}`").alias("_text"))
    return (plain.mapInArrow(made, "_id long, fingerprint string")
            .withColumnRenamed("_id", key))


def dealt(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Rows by range of ids: (piece, turn, _id, _z), turn 1 for the first row after it."""
    spark = docs.sparkSession
    ids = F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(FIRST))
    # one id per piece comes to the driver: as many as there are shuffle partitions
    heads = np.array(sorted(r[0] for r in in_pieces(docs.select(ids.alias("_id")), ["_id"], "ids")
                            .groupBy("_piece").agg(F.min("_id")).select("min(_id)").collect()), np.int64)
    pieces = len(heads)

    def deal(batches):
        codec = pa.Codec("zstd", compression_level=1)
        for big in batches:
            for b in chunks(big, "_text"):
                raw, starts = bt.flat(b.column("_text"))
                data = raw.tobytes()
                z = [len(data[a:e]).to_bytes(8, "little") + codec.compress(data[a:e], asbytes=True)
                     for a, e in zip(starts[:-1], starts[1:])]
                own = b.column("_id").to_numpy(zero_copy_only=False)
                piece = np.searchsorted(heads, own, side="right") - 1
                first = np.flatnonzero(own == heads[piece])
                take = pa.array(np.concatenate([np.arange(len(own)), first]))
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate([piece, (piece[first] - 1) % pieces]).astype(np.int32)),
                    pa.array(np.repeat([0, 1], [len(own), len(first)]).astype(np.int32)),
                    b.column("_id").take(take), pa.array(z, pa.binary()).take(take)],
                    ["piece", "turn", "_id", "_z"])

    plain = docs.select(ids.alias("_id"), F.col(f"`{text}`").alias("_text"))
    return (plain.mapInArrow(deal, "piece int, turn int, _id long, _z binary")
            .repartitionById(width(spark), "piece").sortWithinPartitions("piece", "turn", "_id", "_z"))


def compared(batches, samples: int) -> Iterator[pa.RecordBatch]:
    """Rows of pieces in order, each with its edited text and its next row."""
    held = None
    for b in small_slices(batches):
        plain = [t.decode("utf-8", "replace") for t in texts_of(b).to_pylist()]
        rows = list(zip(b.column("piece").to_pylist(), b.column("turn").to_pylist(),
                        b.column("_id").to_pylist(), plain))
        ahead = [held[:4]] if held is not None else []
        near = [(x, y) for x, y in zip(ahead + rows, (ahead + rows)[1:]) if x[0] == y[0] and x[1] == 0]
        edited = [x[3][:len(x[3]) - len(x[3]) // 2] + y[3][:len(x[3]) // 2] for x, y in near]
        # both at once, since an edited text has the words of its neighbours
        signs = signatures(pa.array(plain + edited, pa.large_string()), samples)
        rows = ([held] if held is not None else []) + [(*r, g) for r, g in zip(rows, signs)]
        signs = signs[len(plain):]
        held = rows[-1]
        pairs = [(x, y) for x, y in zip(rows, rows[1:]) if x[0] == y[0] and x[1] == 0]
        if not pairs:
            continue
        columns = list(zip(*[
            (x[2], len(x[3]), hashlib.sha256(e.encode()).hexdigest(), shown(x[4]), shown(s),
             likeness(x[4], s), likeness(x[4], y[4])) for (x, y), e, s in zip(pairs, edited, signs)]))
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], [
            "_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited",
            "near_next"])


def edit_report(docs: DataFrame, key: str = "doc_id", text: str = "text",
                samples: int = SAMPLES) -> DataFrame:
    """Fingerprints of each text, of its edited text, and how near they are.

    The edited text has its last half replaced by as much of the next one.
    """
    def walk(batches):
        yield from compared(batches, samples)

    out = dealt(docs, key, text).mapInArrow(
        walk, "_id long, n_chars long, edited_sha256 string, fingerprint string,"
              " edited_fingerprint string, near_edited double, near_next double")
    return out.select(F.when(F.col("_id") > F.lit(FIRST), F.col("_id")).alias(key), *out.columns[1:])
