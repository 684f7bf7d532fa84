"""Repeated byte strings across documents, by prefix-free parsing.

A rolling hash of ``TRIGGER`` bytes picks triggers: of every string of
``width`` bytes, the position with the smallest hash.  Consecutive strings with
one trigger form a phrase, so each string of the corpus lies in one phrase and
its trigger depends on its own bytes only.

1. Dictionary.  Equal phrases meet; all but those of the smallest document are
   repeats as a whole.  Triggers met in one phrase only are settled by that.
2. Order of suffixes.  Where a trigger is met in different phrases, their
   strings of ``width`` bytes, the suffixes of the dictionary cut to the depth
   that counts, are brought into classes of equal strings, each with its
   smallest document.  Only equality at this depth matters, so classes are
   formed by hash and not sorted.

Phrases and strings travel as packed arrays, dealt by hash into buckets whose
number follows the bytes of the corpus.  Before they travel, each task keeps
one entry per phrase or string and settles later documents of its own.  What is
settled depends on the borders of tasks, so it travels with the entries of the
same run.  A trigger with many phrases in a task is dealt by phrase instead, so
a passage in a third of all documents loads no single bucket.

Texts are taken as UTF-8 bytes; hashes are 64 bits wide, phrases being compared
together with 32 bits of their trigger.

Defined results: a null text is empty; texts shorter than ``width`` lose
nothing; a string that repeats only inside one document stays; rows that share
an id are one document for this purpose, neither being smaller; a null id is
smaller than all others; without rows there is no result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from foldmark.llm import bytetools as bt
from foldmark.llm.near_dups import chunks
from foldmark.llm.order import written

WIDTH = 50
TRIGGER = 20
HOT = 16
FLUSH = 600_000
BUCKET_BYTES = 12_000_000
CHUNK_BYTES = 1_500_000


def loads(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from every position on, as one number each."""
    return np.ndarray((max(len(raw) - 7, 0),), "<u8", raw, 0, (1,))


def spans_hash(eight: np.ndarray, at: np.ndarray, width: int, seed: int) -> np.ndarray:
    """Hash of ``width`` bytes (8 at least) from each position."""
    value = np.zeros(len(at), np.uint64)
    with np.errstate(over="ignore"):
        for off in [*range(0, width - 8, 8), width - 8]:
            value = bt.mix(value ^ eight[at + off], seed + off)
    return value


def trigger_hash(eight: np.ndarray, n: int) -> np.ndarray:
    """Hash of TRIGGER bytes from every position: the rolling hash."""
    with np.errstate(over="ignore"):
        x = (eight[:n] * np.uint64(0x9E3779B97F4A7C15)
             ^ eight[8:n + 8] * np.uint64(0xC2B2AE3D27D4EB4F))
        x ^= x >> np.uint64(29)
        x += eight[TRIGGER - 8:TRIGGER - 8 + n] * np.uint64(0x165667B19E3779F9)
        x *= np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


class Phrases:
    """Phrases of the texts of one chunk: owner row, start, strings in it, trigger, hash."""

    def __init__(self, texts: pa.Array, width: int = WIDTH):
        self.raw, self.starts = bt.flat(texts)
        self.width = width
        self.raw = np.ascontiguousarray(self.raw)
        n = len(self.raw) - width + 1
        if n <= 0:
            self.eight = np.zeros(0, np.uint64)
            self.owner = self.start = self.count = np.zeros(0, np.int64)
            self.trigger = self.hash = np.zeros(0, np.uint64)
            return
        self.eight = loads(self.raw)
        least = bt.sliding_min(trigger_hash(self.eight, n + width - TRIGGER), width - TRIGGER + 1)
        row = np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts))
        inside = row[:n] == row[width - 1:]
        new = np.ones(n, bool)
        new[1:] = (least[1:] != least[:-1]) | ~inside[:-1]
        # the first and last string of a phrase must cover it for its hash to tell
        runs = np.flatnonzero(new)
        lengths = np.diff(np.append(runs, n))
        longest = width - TRIGGER + 1
        if (lengths > longest).any():
            away = np.arange(n) - np.repeat(runs, lengths)
            new |= away % longest == 0
            runs = np.flatnonzero(new)
            lengths = np.diff(np.append(runs, n))
        good = inside[runs]
        # a run that leaves its text ends with the last string inside
        ends = np.append(runs[1:], n)
        total = np.concatenate([[0], np.cumsum(inside)])
        self.start = runs[good]
        self.count = (total[ends] - total[runs])[good]
        self.owner = row[self.start]
        self.trigger = least[self.start]
        last = self.start + self.count - 1
        with np.errstate(over="ignore"):
            self.hash = bt.mix(spans_hash(self.eight, self.start, width, 31)
                               + bt.mix(spans_hash(self.eight, last, width, 32)
                                        ^ self.count.astype(np.uint64), 33), 34)

    def strings(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start of every string of the chosen phrases, and its hash."""
        count = self.count[chosen]
        first = np.repeat(self.start[chosen], count)
        step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        return first + step, spans_hash(self.eight, first + step, self.width, 31)


def smaller_first(hashes: np.ndarray, ids: np.ndarray, more: np.ndarray | None = None
                  ) -> tuple[np.ndarray, np.ndarray]:
    """Order by (more,) hash and id; marks where a new hash begins in it."""
    order = np.lexsort((ids, hashes) if more is None else (ids, hashes, more))
    h = hashes[order]
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    if more is not None:
        m = more[order]
        new[1:] |= m[1:] != m[:-1]
    return order, new


def packed(kind: int, bucket: np.ndarray, columns: list[np.ndarray]) -> Iterator[tuple]:
    """One row per bucket: (bucket, kind, bytes of each column)."""
    order = np.argsort(bucket, kind="stable")
    b = bucket[order]
    cuts = np.flatnonzero(np.append(True, b[1:] != b[:-1])) if len(b) else []
    for a, z in zip(cuts, [*cuts[1:], len(b)]):
        yield (int(b[a]), kind, *[c[order[a:z]].tobytes() for c in columns])


def by_document(ids: np.ndarray, kind: int, hashes: np.ndarray) -> Iterator[tuple]:
    """One row per document: (id, kind, packed hashes)."""
    order = np.argsort(ids, kind="stable")
    i = ids[order]
    cuts = np.flatnonzero(np.append(True, i[1:] != i[:-1])) if len(i) else []
    for a, z in zip(cuts, [*cuts[1:], len(i)]):
        yield int(i[a]), kind, hashes[order[a:z]].tobytes()


def settled(ids: np.ndarray, kind: int, hashes: np.ndarray, buckets: int) -> Iterator[tuple]:
    """Decisions as entries, one row per document, in buckets below 0."""
    for i, k, h in by_document(ids, kind, hashes):
        of = i.to_bytes(8, "little", signed=True)
        yield -1 - zlib.crc32(h[:8] + of) % buckets, k, None, h, of


ENTRIES = "bucket int, kind int, trigger binary, hash binary, ids binary"
DECISIONS = "_id long, kind int, hashes binary"
WHOLE, OPEN, STRING = 0, 1, 2


def frames(rows: Iterable[tuple], names: str, limit: int = 4000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    schema = pa.schema([(n.split()[0], {"int": pa.int32(), "long": pa.int64(),
                                        "binary": pa.binary()}[n.split()[1]])
                        for n in names.split(", ")])

    def made():
        columns = list(zip(*held))
        return pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    for r in rows:
        held.append(r)
        if len(held) >= limit:
            yield made()
            held.clear()
    if held:
        yield made()


def phrase_entries(batches: Iterable[pa.RecordBatch], buckets: int, width: int,
                   limit: int = FLUSH) -> Iterator[tuple]:
    """Entries (bucket, kind, ...) of all kinds, with what is settled here among them."""
    held: list[tuple[np.ndarray, ...]] = []
    size = 0

    def flush():
        trigger, value, ids = (np.concatenate(c) for c in zip(*held))
        held.clear()
        if not len(value):
            return
        order, new = smaller_first(value, ids, trigger)
        trigger, value, ids = trigger[order], value[order], ids[order]
        first = np.repeat(ids[new], np.diff(np.append(np.flatnonzero(new), len(ids))))
        late = ids > first
        yield from settled(ids[late], WHOLE, value[late], buckets)
        trigger, value, ids = trigger[new], value[new], ids[new]
        start = np.append(True, trigger[1:] != trigger[:-1])
        group = np.cumsum(start) - 1
        many = np.bincount(group)[group] > HOT
        home = bt.mix(trigger, 41)
        deal = np.where(many, bt.mix(trigger ^ value, 42), home) % np.uint64(buckets)
        short = (trigger >> np.uint64(32)).astype(np.uint32)
        for kind, chosen in ((0, ~many), (1, many)):
            yield from packed(kind, deal[chosen].astype(np.int64),
                              [short[chosen], value[chosen], ids[chosen]])
        # a hot trigger tells its own bucket that its other phrases are not alone
        hot = np.flatnonzero(many & start)
        yield from packed(2, (home[hot] % np.uint64(buckets)).astype(np.int64),
                          [short[hot], value[hot], ids[hot]])

    for big in batches:
        for b in chunks(big, "_text", CHUNK_BYTES):
            ids = b.column("_id").to_numpy(zero_copy_only=False)
            p = Phrases(b.column("_text"), width)
            held.append((p.trigger, p.hash, ids[p.owner]))
            size += len(p.hash)
            if size >= limit:
                yield from flush()
                size = 0
    if held:
        yield from flush()


def unpacked(pdf: pd.DataFrame, column: str, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(pdf[column]), dtype=kind)


def met_phrases(pdf: pd.DataFrame) -> Iterator[tuple]:
    """Decisions of one bucket: whole repeats, and first phrases still open."""
    size = [len(h) // 8 for h in pdf["hash"]]
    trigger, value = unpacked(pdf, "trigger", "<u4"), unpacked(pdf, "hash", "<u8")
    ids = unpacked(pdf, "ids", "<i8")
    kind = np.repeat(pdf["kind"].to_numpy(), size)
    real = kind < 2
    order, new = smaller_first(value[real], ids[real], trigger[real])
    t, v, i, k = (x[real][order] for x in (trigger, value, ids, kind))
    groups = np.diff(np.append(np.flatnonzero(new), len(v)))
    late = i > np.repeat(i[new], groups)
    yield from by_document(i[late], WHOLE, v[late])
    hot = np.logical_or.reduceat(k == 1, np.flatnonzero(new)) if len(v) else np.zeros(0, bool)
    t, v, i = t[new], v[new], i[new]
    _, inverse, met = np.unique(t, return_inverse=True, return_counts=True)
    still = (met[inverse] > 1 if len(t) else np.zeros(0, bool)) | hot
    still |= np.isin(t, trigger[~real])
    yield from by_document(i[still], OPEN, v[still])


def decisions(entries: DataFrame, met) -> DataFrame:
    """(_id, kind, hashes) from packed entries, bucket by bucket.

    Entries are made once: a second run could settle others than the first.
    """
    def here(pdf: pd.DataFrame) -> Iterator[tuple]:
        for kind, h, i in pdf[["kind", "hash", "ids"]].itertuples(index=False):
            yield int.from_bytes(i, "little", signed=True), kind, h

    def grouped(pdf: pd.DataFrame) -> pd.DataFrame:
        found = here if pdf["bucket"].iat[0] < 0 else met
        return pd.DataFrame(list(found(pdf)), columns=["_id", "kind", "hashes"])

    return entries.groupBy("bucket").applyInPandas(grouped, DECISIONS)


def decided(docs: DataFrame, found: DataFrame, pack) -> DataFrame:
    """Documents with their decisions of each kind in one array column.

    Texts travel compressed.
    """
    kinds = [F.collect_list(F.when(F.col("kind") == k, F.col("hashes"))).alias(f"_{k}")
             for k in (WHOLE, OPEN, STRING)]
    return docs.mapInArrow(pack, "_id long, _row binary, _z binary").join(
        found.groupBy("_id").agg(*kinds), "_id", "left")


def packer(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    codec = pa.Codec("zstd", compression_level=1)
    for big in batches:
        for b in chunks(big, "_text"):
            raw, starts = bt.flat(b.column("_text"))
            data = raw.tobytes()
            z = [len(data[a:e]).to_bytes(8, "little") + codec.compress(data[a:e], asbytes=True)
                 for a, e in zip(starts[:-1], starts[1:])]
            yield pa.RecordBatch.from_arrays(
                [b.column("_id"), b.column("_row"), pa.array(z, pa.binary())],
                ["_id", "_row", "_z"])


def texts_of(b: pa.RecordBatch) -> pa.Array:
    codec = pa.Codec("zstd")
    z = b.column("_z").to_pylist()
    return pa.array([codec.decompress(x[8:], int.from_bytes(x[:8], "little"), asbytes=True)
                     for x in z], pa.large_binary())


def small_slices(batches: Iterable[pa.RecordBatch], limit: int = CHUNK_BYTES):
    """Slices of about ``limit`` bytes of text, from the lengths before the packed texts."""
    for b in batches:
        sizes = [int.from_bytes(x[:8], "little") for x in b.column("_z").to_pylist()]
        at = held = 0
        for i, n in enumerate(sizes):
            if held and held + n > limit:
                yield b.slice(at, i - at)
                at, held = i, 0
            held += n
        if at < b.num_rows:
            yield b.slice(at)


def listed(b: pa.RecordBatch, kind: int) -> list[np.ndarray]:
    return [np.sort(np.frombuffer(b"".join(x or []), "<u8")) for x in b.column(f"_{kind}").to_pylist()]


def among(hashes: np.ndarray, owner: np.ndarray, lists: list[np.ndarray]) -> np.ndarray:
    """Whether each hash is in the list of its row; owners ascend."""
    out = np.zeros(len(hashes), bool)
    cuts = np.searchsorted(owner, np.arange(len(lists) + 1))
    for k, want in enumerate(lists):
        if len(want) and cuts[k] < cuts[k + 1]:
            h = hashes[cuts[k]:cuts[k + 1]]
            at = np.minimum(np.searchsorted(want, h), len(want) - 1)
            out[cuts[k]:cuts[k + 1]] = want[at] == h
    return out


def string_entries(batches: Iterable[pa.RecordBatch], buckets: int, width: int,
                   limit: int = FLUSH) -> Iterator[tuple]:
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def flush():
        value, ids = (np.concatenate(c) for c in zip(*held))
        held.clear()
        if not len(value):
            return
        order, new = smaller_first(value, ids)
        value, ids = value[order], ids[order]
        first = np.repeat(ids[new], np.diff(np.append(np.flatnonzero(new), len(ids))))
        late = ids > first
        yield from settled(ids[late], STRING, value[late], buckets)
        value, ids = value[new], ids[new]
        yield from packed(0, (bt.mix(value, 43) % np.uint64(buckets)).astype(np.int64),
                          [np.zeros(len(value), np.uint8), value, ids])

    for b in small_slices(batches):
        p = Phrases(texts_of(b), width)
        still = among(p.hash, p.owner, listed(b, OPEN))
        at, value = p.strings(still)
        ids = b.column("_id").to_numpy(zero_copy_only=False)
        held.append((value, np.repeat(ids[p.owner[still]], p.count[still])))
        size += len(value)
        if size >= limit:
            yield from flush()
            size = 0
    if held:
        yield from flush()


def met_strings(pdf: pd.DataFrame) -> Iterator[tuple]:
    value, ids = unpacked(pdf, "hash", "<u8"), unpacked(pdf, "ids", "<i8")
    order, new = smaller_first(value, ids)
    value, ids = value[order], ids[order]
    late = ids > np.repeat(ids[new], np.diff(np.append(np.flatnonzero(new), len(ids))))
    yield from by_document(ids[late], STRING, value[late])


def removals(b: pa.RecordBatch, width: int) -> Iterator[tuple[bytes, np.ndarray]]:
    """Per row of a small slice: its bytes, and which of them are covered."""
    texts = texts_of(b)
    p = Phrases(texts, width)
    whole = among(p.hash, p.owner, listed(b, WHOLE))
    still = among(p.hash, p.owner, listed(b, OPEN)) & ~whole
    at, value = p.strings(still)
    hit = among(value, np.repeat(p.owner[still], p.count[still]), listed(b, STRING))
    edge = np.zeros(len(p.raw) + 1, np.int64)
    np.add.at(edge, p.start[whole], 1)
    np.add.at(edge, p.start[whole] + p.count[whole] - 1 + width, -1)
    np.add.at(edge, at[hit], 1)
    np.add.at(edge, at[hit] + width, -1)
    covered = np.cumsum(edge[:-1]) > 0
    for a, z in zip(p.starts[:-1], p.starts[1:]):
        yield p.raw[a:z], covered[a:z]


def repeats(docs: DataFrame, row, apply, schema: str, key: str = "doc_id", text: str = "text",
            width: int = WIDTH, flush: int = FLUSH) -> DataFrame:
    """``apply(slice, removals)`` over all documents, joined with their decisions.

    ``row`` is a binary column that travels with each text; a task settles after
    ``flush`` phrases or strings.
    """
    plain = docs.select(F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(-2 ** 63)).alias("_id"),
                        row.alias("_row"), F.col(f"`{text}`").alias("_text"))
    bytes_in = plain.agg(F.coalesce(F.sum(F.octet_length("_text")), F.lit(0))).first()[0]
    # about 20 bytes travel for every 16 of text
    buckets = max(2, -(-bytes_in * 5 // 4 // BUCKET_BYTES))

    def first(batches):
        yield from frames(phrase_entries(batches, buckets, width, flush), ENTRIES)

    def second(batches):
        yield from frames(string_entries(batches, buckets, width, flush), ENTRIES)

    entries = plain.select("_id", "_text").mapInArrow(first, ENTRIES)
    whole = written(decisions(entries, met_phrases), "repeat-phrases")
    entries = decided(plain, whole, packer).filter(F.size(f"_{OPEN}") > 0).mapInArrow(second, ENTRIES)
    strings = written(decisions(entries, met_strings), "repeat-strings")

    def last(batches):
        for b in small_slices(batches):
            yield apply(b, removals(b, width))

    return decided(plain, whole.unionByName(strings), packer).mapInArrow(last, schema)


def removal_counts(docs: DataFrame, key: str = "doc_id", text: str = "text",
                   width: int = WIDTH, flush: int = FLUSH) -> DataFrame:
    """Key, n_bytes, n_removed, n_spans and kept_sha256 per row."""
    def counts(b, found):
        rows = []
        for raw, covered in found:
            begins = np.count_nonzero(np.diff(np.concatenate([[False], covered]).astype(np.int8)) == 1)
            rows.append((len(raw), int(covered.sum()), int(begins),
                         hashlib.sha256(raw[~covered].tobytes()).hexdigest()))
        columns = list(zip(*rows))
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays(
            [b.column("_row"), *[pa.array(c, t) for c, t in zip(columns, types)]],
            ["_row", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    out = repeats(docs, F.col(f"`{key}`").cast("string").cast("binary"), counts,
                  "_row binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string",
                  key, text, width, flush)
    return out.withColumn(key, F.col("_row").cast("string").cast("long")).select(
        key, "n_bytes", "n_removed", "n_spans", "kept_sha256")


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text",
                    length: str | None = "n_chars", width: int = WIDTH) -> DataFrame:
    """``docs`` with repeated strings cut out of the texts.

    Characters that a cut leaves incomplete are dropped; ``length``, if there
    is such a column, becomes the new number of characters.
    """
    names = [c for c in docs.columns if c != text]
    other = docs.select(*[F.col(f"`{c}`") for c in names])
    row = F.to_json(F.struct(*[F.col(f"`{c}`") for c in names]),
                    {"ignoreNullFields": "false"}).cast("binary")

    def cut(b, found):
        texts = [raw[~covered].tobytes().decode("utf-8", "ignore") for raw, covered in found]
        return pa.RecordBatch.from_arrays(
            [b.column("_row"), pa.array(texts, pa.string())], ["_row", "_text"])

    out = repeats(docs, row, cut, "_row binary, _text string", key, text, width)
    out = out.withColumn("_o", F.from_json(F.col("_row").cast("string"), other.schema))
    columns = {c: F.col("_text") if c == text else F.col(f"_o.`{c}`") for c in docs.columns}
    if length in columns:
        columns[length] = F.length("_text").cast(docs.schema[length].dataType)
    return out.select(*[v.alias(c) for c, v in columns.items()])
