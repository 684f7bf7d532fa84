"""Token ids in compressed files: context mixing and a range coder.

A block holds at most BLOCK ids and depends on no other block.  Three models
predict the next id: the id that last followed the last two ids (order 2), the
one that last followed the last id (order 1), and how often each id occurred
(order 0).  Their predictions are mixed with weights learnt in the same
situation (how often the first two were right in a row, and whether they agree),
and the mixture drives a range coder (rANS) with one step per id.

A block is cut into lanes of about LANE ids that are coded side by side and
share the models.  Orders 1 and 2 and the weights are renewed after every STEP
ids of the lanes (at first after every one, every two, ...), counts whenever
they have grown by a quarter; both from all lanes.  Between renewals the models
stand still, so a step is array work over all lanes.  All arithmetic is on
integers, so files read the same everywhere.

A block record is: magic, number of ids, size of the vocabulary, crc32 of the
ids as little-endian 32-bit numbers, number of words, then 32-bit words: low and
high half of each lane's last state, then what decoding reads, in its order.

Files are written by Spark's writer to the shared folder: each row holds a run
of documents in ascending order of ids (their ids and lengths) and the blocks
of their token ids.

Defined results: a null text is empty and has only its end id; rows that share
an id are ordered by their texts; a null id comes first; without rows there is an
empty file set.  Ids of 65,536 or more are an error.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Callable, Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from foldmark.llm import bytetools as bt
from foldmark.llm.near_dups import chunks
from foldmark.llm.order import small, width
from foldmark.session import scratch_path

MAGIC = b"FTB2"
HEAD = struct.Struct("<4sIIII")
BLOCK = 1 << 20
LANE = 512
STEP = 8
ROW_IDS = 1 << 21
COUNT = 192
TOTAL = 24  # bits of a coding interval
PART = 12  # of them, bits of a weight
PLAIN = 18  # bits of an order 0 interval
CERTAIN = 4000  # most of 2 ** PART that orders 1 and 2 may get
LEAST = 1 << 31  # a lane's state lies from here to LEAST << 32
FIRST = -2 ** 63
KNOWN = 1_000_000

#: Situations: 4 * state of order 2 + state of order 1, and 16 more where they agree.
STATES = np.arange(32)
NO_TWO = STATES % 16 < 4
NO_ONE = (STATES % 4 == 0) | (STATES >= 16) & ~NO_TWO
#: State of an entry after an id, by situation and (second half) whether it was right.
AFTER2, AFTER1 = (np.concatenate([np.ones(32, np.int64), np.where(old == 0, 1, np.minimum(old + 1, 3))])
                  for old in (STATES % 16 // 4, STATES % 4))
AFTER2 <<= 2


def first_counts(vocabulary: int) -> np.ndarray:
    """Before anything is counted: early ids of a vocabulary are likelier."""
    return 1 + 65536 // (np.arange(vocabulary, dtype=np.int64) + 512)


def weights(n: np.ndarray, two: np.ndarray, one: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights of orders 2 and 1 by situation."""
    w2 = np.maximum(CERTAIN * (4 * two + 1) // (4 * n + 8), 1)
    w1 = np.maximum(CERTAIN * (4 * one + 1) // (4 * n + 8), 1)
    w2[NO_TWO] = 0  # no prediction
    w1[NO_ONE] = 0
    return w2, w1


class Mixture:
    """What the ids coded so far say about the next ones; both directions use it.

    An entry of order 1 or 2 is its place in the order of learning (32 bits), the
    id (28) and a state of two bits, those of order 2 above those of order 1: 0
    nothing yet, 1 wrong last time, 2 right once, 3 right more often.  The largest
    entry of a context is its latest, in whatever order they come; to look it up
    takes only its lower half.
    """

    def __init__(self, n: int, vocabulary: int):
        if vocabulary >= 1 << PLAIN:
            raise ValueError(f"a vocabulary must be smaller than {1 << PLAIN}")
        bits = min(max(n.bit_length(), 8), 20)
        self.shift = 64 - bits
        self.two, self.one = np.zeros(1 << bits, "<i8"), np.zeros(vocabulary + 1, "<i8")
        self.low2, self.low1 = self.two.view("<i4"), self.one.view("<i4")
        self.fresh: list[np.ndarray] = []
        self.count = first_counts(vocabulary)
        self.seen = np.zeros((3, 32), np.int64)
        self.learnt = self.counted = 0
        self._weigh()
        self._order0()

    def _weigh(self) -> None:
        self.w2, self.w1 = (w << PART for w in weights(*self.seen))
        self.base = self.w2 + self.w1
        self.rest = (1 << TOTAL) - self.base

    def _order0(self) -> None:
        """Intervals of 2 ** PLAIN by counts, one at least for each id."""
        n = len(self.count)
        ends = np.cumsum(self.count)
        scale = (((1 << PLAIN) - n) << 30) // int(ends[-1])
        self.ends = np.zeros(n + 1, np.int64)
        self.ends[1:] = (ends * scale >> 30) + np.arange(1, n + 1)
        self.ends[-1] = 1 << PLAIN
        self.at = None

    def inverse(self) -> np.ndarray:
        """The id at each place of the order 0 intervals."""
        if self.at is None:
            self.at = np.repeat(np.arange(len(self.count)), np.diff(self.ends))
        return self.at

    def slots(self, last: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Table places of contexts of order 2."""
        key = (last << 20) + before
        return (key.view(np.uint64) * bt.BASE >> np.uint64(self.shift)).view(np.int64)

    def look(self, last: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, ...]:
        """Slot of order 2, ids of orders 2 and 1, the situation."""
        slot = self.slots(last, before)
        e2, e1 = self.low2.take(slot << 1), self.low1.take(last << 1)
        case = ((e2 | e1) & 15).astype(np.int64)
        case += ((e2 ^ e1) < 16) * 16
        return slot, e2 >> 4, e1 >> 4, case

    def learn(self, ids: np.ndarray, last: np.ndarray, slot: np.ndarray, p2: np.ndarray,
              p1: np.ndarray, case: np.ndarray) -> None:
        """Take in ids (flat, in their order) and what was looked up for them."""
        right2, right1 = p2 == ids, p1 == ids
        fresh = np.arange(self.learnt + 1, self.learnt + 1 + len(ids)) << 32
        fresh |= ids << 4
        case2 = case + 32 * right2
        np.maximum.at(self.two, slot, fresh | AFTER2.take(case2))
        np.maximum.at(self.one, last, fresh | AFTER1.take(case + 32 * right1))
        right1 &= ~right2
        which = np.bincount(case2 + 64 * right1, minlength=96).reshape(3, 32)
        self.seen += [which.sum(axis=0), which[1], which[2]]
        self._weigh()
        self.fresh.append(ids)
        self.learnt += len(ids)
        if 4 * (self.learnt - self.counted) >= self.counted:
            self.count += COUNT * np.bincount(np.concatenate(self.fresh), minlength=len(self.count))
            self.fresh.clear()
            self._order0()
            self.counted = self.learnt


def shape(n: int) -> tuple[int, int, int]:
    """Lanes of a block of ``n`` ids, steps, and how many lanes take the last step."""
    lanes = max(1, n // LANE)
    steps = -(-n // lanes)
    return lanes, steps, n - lanes * (steps - 1) if n else 0


def renewals(steps: int) -> Iterator[tuple[int, int]]:
    """Steps from one renewal of the models to the next; the last step, which not
    all lanes may take, stands alone."""
    a = 0
    while a < steps - 1:
        z = min(a + min(max(a, 1), STEP), steps - 1)
        yield a, z
        a = z
    if steps:
        yield a, steps


def encode_blocks(blocks: list[np.ndarray], vocabulary: int) -> list[bytes]:
    """Records of blocks of ids below ``vocabulary``."""
    return [_encoded(b, vocabulary) for b in blocks]


def _encoded(block: np.ndarray, vocabulary: int) -> bytes:
    n = len(block)
    lanes, steps, full = shape(n)
    grid = np.full((steps + 2, lanes), vocabulary, np.int64)  # two unknown ids come first
    if steps:
        flat = np.asarray(block).astype(np.int64)
        grid[2:, :full] = flat[:full * steps].reshape(full, steps).T
        grid[2:-1, full:] = flat[full * steps:].reshape(lanes - full, steps - 1).T
    m = Mixture(n, vocabulary)
    starts, widths = [], []
    for a, z in renewals(steps):
        k = lanes if z < steps else full
        ids, last, before = (np.ascontiguousarray(grid[a + d:z + d, :k]).ravel() for d in (2, 1, 0))
        slot, p2, p1, case = m.look(last, before)
        w2, w1, rest = m.w2.take(case), m.w1.take(case), m.rest.take(case)
        start = m.ends.take(ids) * rest >> PLAIN
        wide = (m.ends.take(ids + 1) * rest >> PLAIN) - start
        start += m.base.take(case)
        hit, = ((p1 == ids) & (w1 > 0)).nonzero()
        start[hit], wide[hit] = w2[hit], w1[hit]
        hit, = ((p2 == ids) & (w2 > 0)).nonzero()
        start[hit], wide[hit] = 0, w2[hit]
        starts.append(start.reshape(z - a, k).view(np.uint64))
        widths.append(wide.reshape(z - a, k).view(np.uint64))
        if z < steps:
            m.learn(ids, last, slot, p2, p1, case)
    # the last id is coded first
    state = np.full(lanes, LEAST, np.uint64)
    half, full_bits, whole = np.uint64(32), np.uint64(63 - TOTAL), np.uint64(1 << TOTAL)
    words: list[np.ndarray] = []
    for start, wide in zip(reversed(starts), reversed(widths)):
        now = state[:start.shape[1]]
        for t in range(len(start) - 1, -1, -1):
            w = wide[t]
            big, = (now >> full_bits >= w).nonzero()
            out = now[big]
            words.append(out.astype("<u4"))
            now[big] = out >> half
            now += now // w * (whole - w) + start[t]
    data = np.concatenate([state.astype("<u8").view("<u4"), *reversed(words)])
    crc = zlib.crc32(np.asarray(block).astype("<u4").tobytes())
    return HEAD.pack(MAGIC, n, vocabulary, crc, len(data)) + data.tobytes()


def decode_blocks(records: list[bytes]) -> list[np.ndarray]:
    """Ids of block records; a record that was damaged is an error."""
    return [_decoded(r) for r in records]


def _decoded(record: bytes) -> np.ndarray:
    head = HEAD.unpack_from(record) if len(record) >= HEAD.size else (b"",)
    if head[0] != MAGIC or len(record) != HEAD.size + 4 * head[4]:
        raise ValueError("not a whole block of token ids")
    _, n, vocabulary, crc, size = head
    lanes, steps, full = shape(n)
    if size < 2 * lanes or not 0 < vocabulary < 1 << PLAIN:
        raise ValueError("a block of token ids has a damaged head")
    data = np.frombuffer(record, "<u4", size, HEAD.size)
    state = data[:2 * lanes].copy().view("<i8").astype(np.int64)
    words, taken = data[2 * lanes:].astype(np.int64), 0
    grid = np.full((steps + 2, lanes), vocabulary, np.int64)
    m = Mixture(n, vocabulary)
    for a, z in renewals(steps):
        k = lanes if z < steps else full
        now, ends, at = state[:k], m.ends, m.inverse()
        held = []
        for t in range(a, z):
            slot, p2, new, case = found = m.look(grid[t + 1, :k], grid[t, :k])
            held.append(found)
            start, wide, base = m.w2.take(case), m.w1.take(case), m.base.take(case)
            x = now & ((1 << TOTAL) - 1)
            hit, = (x < start).nonzero()
            far, = (x >= base).nonzero()
            new = new.copy()
            new[hit], wide[hit], start[hit] = p2[hit], start[hit], 0
            b = base[far]
            rest = (1 << TOTAL) - b
            # below 2 ** 43 by at least 2 ** 18: rounding does not reach the next number
            place = ((((x[far] - b + 1) << PLAIN) - 1) / rest).astype(np.int64)
            found = at.take(place)
            low = ends.take(found) * rest >> PLAIN
            new[far], start[far] = found, b + low
            wide[far] = (ends.take(found + 1) * rest >> PLAIN) - low
            grid[t + 2, :k] = new
            now >>= TOTAL
            now *= wide
            now += x - start
            short, = (now < LEAST).nonzero()
            more = words[taken:taken + len(short)]
            if len(more) < len(short):
                raise ValueError("a block of token ids ends too early")
            now[short] = (now[short] << 32) | more
            taken += len(short)
        if z < steps:
            looked = map(np.concatenate, zip(*held))
            m.learn(grid[a + 2:z + 2].ravel(), grid[a + 1:z + 1].ravel(), *looked)
    ids = np.concatenate([grid[2:, :full].T.ravel(), grid[2:-1, full:].T.ravel()]) if n else grid[2:].ravel()
    if zlib.crc32(ids.astype("<u4").tobytes()) != crc:
        raise ValueError("a block of token ids fails its checksum")
    return ids


#: Letters, numbers and other characters apart, after lower-casing.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SPACES, LETTER, DIGIT, OTHER, APOSTROPHE, ODD = range(6)
KIND = np.full(256, ODD, np.uint8)  # also of "<", which may open a special token
KIND[:128] = OTHER
KIND[bt.SPACE] = SPACES
KIND[[*range(65, 91), *range(97, 123)]] = LETTER
KIND[48:58] = DIGIT
KIND[ord("'")] = APOSTROPHE
KIND[ord("<")] = ODD
#: The second byte of the letters from U+00C0 on, which has 0xC3 before it.
SECOND = np.zeros(256, bool)
SECOND[[*range(0x80, 0x97), *range(0x98, 0xB7), *range(0xB8, 0xC0)]] = True


def parted(before: int, after: int) -> bool:
    """May no match of PATTERN run across these kinds of characters?"""
    return (DIGIT in (before, after) or (before, after) == (OTHER, LETTER)
            or before == LETTER and after in (OTHER, APOSTROPHE))


PAIRS = [divmod(pair, 8) for pair in range(256)]
BEGINS = np.array([b != SPACES and (a == SPACES or parted(a, b)) for a, b in PAIRS], np.uint8)
ENDS = np.array([a != SPACES and (b == SPACES or parted(a, b)) for a, b in PAIRS], np.uint8)


def looked_up(raw: np.ndarray, table: np.ndarray) -> np.ndarray:
    """``table[raw]`` for bytes, without an index of 8 bytes for each."""
    return np.frombuffer(bytearray(raw).translate(table.tobytes()), np.uint8)


def units(raw: np.ndarray, starts: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Parts of texts that PATTERN never runs across, in lower case, and how many
    lie before the end of each text.  Words with other bytes than ASCII and letters up
    to U+00FF, or with "<", stay whole and as they are."""
    if not len(raw):
        return pa.array([], pa.large_string()), np.zeros(len(starts) - 1, np.int64)
    kind, low = looked_up(raw, KIND), looked_up(raw, bt.LOWER)
    latin = np.flatnonzero(raw[:-1] == 0xC3)
    if len(latin):
        second = raw[latin + 1]
        good = SECOND[second]
        latin, second = latin[good] + 1, second[good]
        kind[latin - 1] = kind[latin] = LETTER
        low[latin] = second + 32 * (second < 0x9F)
    odd = np.flatnonzero(kind == ODD)
    edge = starts[1:-1]
    edge = edge[(edge > 0) & (edge < len(raw))]
    if len(odd):
        begin, stop, _ = bt.word_spans(raw, starts)
        word = np.unique(np.searchsorted(begin, odd, side="right") - 1)
        sizes = stop[word] - begin[word]
        at = np.repeat(begin[word] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        kind[at] = ODD
        low[at] = raw[at]
    pair = (kind[:-1] << 3) | kind[1:]
    begins, ends = np.empty(len(raw), bool), np.empty(len(raw), bool)
    begins[0], ends[-1] = kind[0] != SPACES, kind[-1] != SPACES
    begins[1:], ends[:-1] = looked_up(pair, BEGINS), looked_up(pair, ENDS)
    begins[edge] |= kind[edge] != SPACES
    ends[edge - 1] |= kind[edge - 1] != SPACES
    begin, last = np.flatnonzero(begins), np.flatnonzero(ends)
    data = low[kind != SPACES]
    cuts = np.zeros(len(begin) + 1, np.int64)
    np.cumsum(last - begin + 1, out=cuts[1:])
    found = pa.LargeStringArray.from_buffers(len(begin), pa.py_buffer(cuts), pa.py_buffer(data))
    return found, np.searchsorted(begin, starts[1:], side="left")


class WordTokenizer:
    """Ids of texts by a tokenizer whose tokens never run across white space.

    Equal words are encoded once per worker.  Where its rules are those of PATTERN,
    words of ASCII are taken apart first, and new runs of letters are encoded
    together: the last token of each has a mark.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        rules = json.loads(self.tokenizer.to_str())
        mark = rules["model"].get("end_of_word_suffix")
        vocabulary = self.tokenizer.get_vocab()
        # every byte has an id, with and without the mark
        self.plain = bool(mark) and rules["model"]["type"] == "BPE" and not rules["post_processor"] and (
            rules["normalizer"] == {"type": "Sequence", "normalizers": [
                {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "},
                {"type": "Lowercase"}]}
            and rules["pre_tokenizer"] == {"type": "Sequence", "pretokenizers": [
                {"type": "Split", "pattern": {"Regex": PATTERN}, "behavior": "Removed", "invert": True},
                {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
            and all(t["content"].startswith("<") for t in rules["added_tokens"])
            and all(c in vocabulary and c + mark in vocabulary for c in pre_tokenizers.ByteLevel.alphabet()))
        self.last = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        if mark:
            self.last[[i for w, i in vocabulary.items() if w.endswith(mark)]] = True
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.starts = np.zeros(1 << 16, np.int64), np.zeros(1 << 14, np.int64)

    def _add(self, words: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        n = len(self.known)
        ends = self.starts[n] + np.cumsum(sizes)
        self.starts = room(self.starts, n + len(words) + 1)
        self.starts[n + 1:n + 1 + len(words)] = ends
        self.ids = room(self.ids, int(self.starts[n + len(words)]))
        self.ids[self.starts[n]:self.starts[n + len(words)]] = ids
        self.known.update(zip(words, range(n, n + len(words))))

    def _learn(self, words: list[str]) -> None:
        """Encode words that are not known."""
        rest = words
        if self.plain:
            letters = [w for w in words if w.isalpha() and max(w) <= "\xff" and w.islower()]
            if letters:
                joined = self.tokenizer.encode_batch_fast([" ".join(letters)], add_special_tokens=False)
                ids = np.array(joined[0].ids, np.int64)
                ends = np.flatnonzero(self.last[ids]) + 1
                if len(ends) == len(letters) and ends[-1] == len(ids):
                    self._add(letters, ids, np.diff(ends, prepend=0))
                    rest = [w for w in words if w not in self.known]
        if rest:
            found = [e.ids for e in self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)]
            self._add(rest, np.array([i for e in found for i in e], np.int64),
                      np.array([len(e) for e in found], np.int64))

    def encode(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts back to back, an end id after each; where texts start."""
        raw, starts = bt.flat(texts)
        if self.plain:
            words, before = units(raw, starts)
        else:
            begin, stop, _ = bt.word_spans(raw, starts)
            cuts = np.concatenate([[0], np.cumsum(stop - begin)]).astype(np.int64)
            words = pa.LargeStringArray.from_buffers(len(begin), pa.py_buffer(cuts),
                                                     pa.py_buffer(raw[~bt.SPACE[raw]]))
            before = np.searchsorted(begin, starts[1:], side="left")
        words = words.dictionary_encode()
        distinct = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.known) + len(distinct) > KNOWN:
            self._forget()
        place = np.fromiter(map(self.known.get, distinct, repeat(-1)), np.int64, len(distinct))
        new = np.flatnonzero(place < 0)
        if len(new):
            self._learn([distinct[i] for i in new])
            place[new] = np.fromiter(map(self.known.get, map(distinct.__getitem__, new)), np.int64, len(new))
        # the end id comes after the last word of its text
        offsets = np.append(self.starts[place], 0)
        sizes = np.append(self.starts[place + 1] - self.starts[place], 1)
        codes = np.insert(words.indices.to_numpy(), before, len(distinct))
        n = sizes[codes]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        at = np.repeat(offsets[codes] - ends + n, n)
        at += np.arange(total)
        stops = ends[before + np.arange(len(before))]
        at[stops - 1] = 0
        ids = self.ids[at]
        ids[stops - 1] = end
        return ids, np.concatenate([[0], stops]).astype(np.int64)


def room(values: np.ndarray, n: int) -> np.ndarray:
    """``values`` with places for ``n`` at least."""
    return values if n <= len(values) else np.concatenate([values, np.zeros(max(n, len(values)), values.dtype)])


_READ: dict[str, WordTokenizer] = {}


def tokenizer_of(path: str) -> WordTokenizer:
    if path not in _READ:
        _READ[path] = WordTokenizer(path)
    return _READ[path]


def token_ids(batches: Iterable[pa.RecordBatch], t: WordTokenizer, end: int) -> Iterator[pa.RecordBatch]:
    """``_id`` and its ids as 16-bit numbers, some millions of bytes of text at a time."""
    for big in batches:
        for b in chunks(big, "_text", 4_000_000):
            ids, starts = t.encode(b.column("_text"), end)
            if ids.max(initial=0) > 0xFFFF:
                raise ValueError("ids must be below 65,536")
            data = ids.astype("<u2").tobytes()
            yield pa.RecordBatch.from_arrays([b.column("_id"), pa.array(
                [data[2 * a:2 * z] for a, z in zip(starts[:-1], starts[1:])], pa.binary())],
                ["_id", "ids"])


ROW = "piece int, seq int, doc_ids binary, lengths binary, blocks array<binary>"


def evenly(ids: np.ndarray) -> list[np.ndarray]:
    """Blocks whose sizes differ by one at most."""
    return np.array_split(ids, max(1, -(-len(ids) // BLOCK)))


def packed_rows(batches: Iterable[pa.RecordBatch], piece: int, vocabulary: int,
                limit: int = ROW_IDS) -> Iterator[pa.RecordBatch]:
    """File rows of documents that come in order; a row has about ``limit`` ids."""
    held_ids: list[int] = []
    held: list[np.ndarray] = []
    size = seq = 0

    def row():
        blocks = encode_blocks(evenly(np.concatenate(held)), vocabulary)
        return pa.RecordBatch.from_arrays([
            pa.array([piece], pa.int32()), pa.array([seq], pa.int32()),
            pa.array([np.array(held_ids, "<i8").tobytes()]),
            pa.array([np.array([len(h) for h in held], "<i8").tobytes()]),
            pa.array([blocks], pa.list_(pa.binary()))], ["piece", "seq", "doc_ids", "lengths", "blocks"])

    for b in batches:
        for i, data in zip(b.column("_id").to_pylist(), b.column("ids").to_pylist()):
            held_ids.append(i)
            held.append(np.frombuffer(data, "<u2"))
            size += len(held[-1])
            if size >= limit:
                yield row()
                held_ids.clear()
                held.clear()
                size, seq = 0, seq + 1
    if held:
        yield row()


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end: int = 1, key: str = "doc_id",
                 text: str = "text") -> str:
    """Write the ids of all documents, in ascending order of their ids."""
    def packed(batches):
        # one worker a task holds both the tokenizer and the blocks
        t = tokenizer_of(tokenizer)
        yield from packed_rows(token_ids(batches, t, end), TaskContext.get().partitionId(),
                               t.tokenizer.get_vocab_size())

    # ranges are drawn before there are tokens, so that every text is tokenised once
    plain = docs.select(F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(FIRST)).alias("_id"),
                        F.col(f"`{text}`").alias("_text"))
    placed = plain.repartitionByRange(width(docs.sparkSession), "_id").sortWithinPartitions("_id", "_text")
    placed.mapInArrow(packed, ROW).write.parquet(path)
    return path


def read_documents(spark: SparkSession, path: str, apply: Callable[[np.ndarray], tuple], schema: str,
                   kinds: list[pa.DataType]) -> DataFrame:
    """(_id, piece, seq, place, offset, n_tokens, ...) with ``apply(ids)`` of every document."""
    names = ["_id", "piece", "seq", "place", "offset", "n_tokens"]
    more = [c.split()[0] for c in schema.split(", ")]

    def made(batches):
        for b in batches:
            for r in range(b.num_rows):
                row = {n: b.column(n)[r].as_py() for n in b.schema.names}
                flat = np.concatenate(decode_blocks(row["blocks"]))
                ids, n = np.frombuffer(row["doc_ids"], "<i8"), np.frombuffer(row["lengths"], "<i8")
                at = np.cumsum(n) - n
                found = list(zip(*[apply(flat[a:a + k]) for a, k in zip(at, n)]))
                fixed = [ids, np.full(len(ids), row["piece"], np.int32),
                         np.full(len(ids), row["seq"], np.int32), np.arange(len(ids)), at, n]
                yield pa.RecordBatch.from_arrays(
                    [*map(pa.array, fixed), *[pa.array(c, k) for c, k in zip(found, kinds)]],
                    names + more)

    return spark.read.parquet(path).mapInArrow(
        made, "_id long, piece int, seq int, place long, offset long, n_tokens long, " + schema)


def token_report(docs: DataFrame, tokenizer: str, end: int = 1, key: str = "doc_id",
                 text: str = "text") -> DataFrame:
    """Key, start, n_tokens and ids_crc32, from files written and read back."""
    spark = docs.sparkSession
    path = write_tokens(docs, scratch_path(spark, "token-files"), tokenizer, end, key, text)
    rows = read_documents(spark, path, lambda ids: (zlib.crc32(ids.astype("<u4").tobytes()),),
                          "ids_crc32 long", [pa.int64()])
    lengths = scratch_path(spark, "token-rows")
    rows.write.parquet(lengths)
    rows = spark.read.parquet(lengths)
    # one line per file row, that is per some millions of ids
    sizes = rows.groupBy("piece", "seq").agg(F.sum("n_tokens").alias("n"))
    before = W.orderBy("piece", "seq").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("piece", "seq", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return rows.join(small(offsets), ["piece", "seq"]).select(
        F.when(F.col("_id") > F.lit(FIRST), F.col("_id")).alias(key),
        (F.col("before") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")
