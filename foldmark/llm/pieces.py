"""Encoding and decoding with a SentencePiece model, as a streaming Viterbi.

The model at hand is of the BPE kind.  Its encoding of a text is the one path
through the lattice of pieces in which every two neighbours are compatible:
the merges of the two pieces' own string give those two pieces again.  So each
boundary has one surviving path, kept as a back pointer to where its last
piece begins.  A window of pointers, as long as the longest piece, is all that
later pieces can reach; once every pointer in it leads to one boundary, the ids
up to there are final and are given out.

A boundary before a white space that follows another character is always such
a point, since no piece of the model runs across one (this is checked when the
model is read).  The stretches between are therefore encoded on their own.
Those that occur again are looked up; new short ones, of fewer characters than
the window, go through the lattice side by side in arrays, one boundary at a
time, and longer ones are streamed.

Characters without a piece become byte pieces.  Decoding joins the pieces.

Defined results: null and empty texts have no ids; the white space mark U+2581
in a text is read as a space, as the model does; a text with it does not come
back the same.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from foldmark.llm import bytetools as bt
from foldmark.llm.near_dups import chunks

MARK = "▁"
KNOWN = 300_000  # pairs
STRETCHES = 600_000  # stretches looked up
SHORT = 64
POINTS = 0x110000  # code points
PLACES = 20  # bits of a place in the cache of pairs


class Pieces:
    """A model's pieces, and paths through their lattice."""

    def __init__(self, model: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        n = sp.get_piece_size()
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i) for i in range(n)]
        self.ids = {sp.id_to_piece(i): i for i in range(n) if not special[i]}
        self.score = {p: sp.get_score(i) for p, i in self.ids.items()}
        self.byte = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(n) if sp.is_byte(i)}
        crossing = [p for p in self.ids if any(a != MARK == b for a, b in zip(p, p[1:]))]
        if crossing or len(self.byte) != 256 or any(c not in self.ids for p in self.ids for c in p):
            raise ValueError("pieces must not run across word starts, and all bytes and characters need a piece")
        self.longest = max(map(len, self.ids))
        self.whole = {p for p in self.ids if len(p) == 1 or self.merged(p) == [p]}
        ends: dict[str, set[int]] = {}
        for p in self.whole:
            if len(p) > 1:
                ends.setdefault(p[-2:], {1}).add(len(p))
        # by the last two characters: sizes a piece may have, longest first
        self.sizes = {e: tuple(sorted(n, reverse=True)) for e, n in ends.items()}
        self.texts = [b""] * n
        for p, i in self.ids.items():
            self.texts[i] = p.replace(MARK, " ").encode()
        for b, i in self.byte.items():
            self.texts[i] = bytes([b])
        self.lengths = np.array([len(t) for t in self.texts])
        self.offsets = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(self.texts), np.uint8)
        self.pairs: dict[tuple[str, str], bool] = {}
        self.edges: dict[tuple[str, bool], list[tuple[float, str]]] = {}  # two per piece at most
        self.names = {i: p for p, i in self.ids.items()}
        self.asked = np.full(1 << PLACES, -1, np.int64)  # pairs of ids, by place
        self.fits = np.zeros(1 << PLACES, bool)
        self.grown()
        self.forget()

    def forget(self) -> None:
        """No stretches are known."""
        # stretches by whether they open a text; ids of stretch k: stored[at[k]:at[k + 1]]
        self.known: tuple[dict[str, int], dict[str, int]] = ({}, {})
        self.stored, self.at = np.zeros(1 << 16, np.int32), np.zeros(1, np.int64)

    def grown(self) -> None:
        """Pieces as a tree of characters: steps as sorted numbers, the piece that ends at a node."""
        nodes: dict[str, int] = {"": 0}
        for p in self.whole:
            for n in range(1, len(p) + 1):
                nodes.setdefault(p[:n], len(nodes))
        step = np.array([nodes[p[:-1]] * POINTS + ord(p[-1]) for p in nodes if p], np.int64)
        order = np.argsort(step)
        self.steps, self.node = step[order], order + 1
        self.ending = np.array([self.ids[p] if p in self.whole else -1 for p in nodes], np.int64)

    def merged(self, text: str) -> list[str]:
        """Pieces of a short string by its merges, best score first."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                return parts
            parts[at:at + 2] = [parts[at] + parts[at + 1]]

    def edge(self, piece: str, right: bool) -> list[tuple[float, str]]:
        """How the outermost part of a piece grows: (when, part), one character first.

        Time is the rank of the latest merge up to then.
        """
        parts, now = list(piece), -1.0
        out = [(now, parts[-1] if right else parts[0])]
        while len(parts) > 1:
            at = max(range(len(parts) - 1),
                     key=lambda i: (self.score.get(parts[i] + parts[i + 1], -1e30), -i))
            joined = parts[at] + parts[at + 1]
            if joined not in self.score:
                break
            now = max(now, -self.score[joined])
            outer = at + 2 == len(parts) if right else at == 0
            parts[at:at + 2] = [joined]
            if outer:
                out.append((now, joined))
        return out

    def compatible(self, left: str, right: str) -> bool:
        """Whether no merge crosses from one piece into the other.

        The parts at the boundary are followed while they grow: they may never
        form a piece that would be merged before one of them grows on.  At
        equal ranks the leftmost merge comes first.
        """
        found = self.pairs.get((left, right))
        if found is not None:
            return found
        if len(self.pairs) > KNOWN:
            self.pairs.clear()
        if (left, True) not in self.edges:
            self.edges[left, True] = self.edge(left, True)
        if (right, False) not in self.edges:
            self.edges[right, False] = self.edge(right, False)
        a, b = self.edges[left, True], self.edges[right, False]
        i = j = 0
        now, found = -1.0, True
        while True:
            ta = a[i + 1][0] if i + 1 < len(a) else 1e30
            tb = b[j + 1][0] if j + 1 < len(b) else 1e30
            score = self.score.get(a[i][1] + b[j][1])
            if score is not None:
                due = max(now, -score)
                if due < ta and due <= tb:
                    found = False
                    break
            if ta == tb == 1e30:
                break
            if ta <= tb:
                i, now = i + 1, ta
            else:
                j, now = j + 1, tb
        self.pairs[left, right] = found
        return found

    def stream(self, text: str) -> Iterator[list[int]]:
        """Ids of a stretch, as soon as they are final."""
        ids, longest = self.ids, self.longest
        begins: list[int] = []  # begins[e - 1 - done]: where the last piece of text[:e] begins
        done, n = 0, len(text)

        def path(end: int, stop: int) -> list[int]:
            out = []
            while end > stop:
                start = begins[end - 1 - done]
                piece = text[start:end]
                if piece in ids:
                    out.append(ids[piece])
                else:
                    out.extend(self.byte[b] for b in reversed(piece.encode()))
                end = start
            return out[::-1]

        for end in range(1, n + 1):
            begin = end - 1
            for size in self.sizes.get(text[end - 2:end], (1,)) if end > 1 else (1,):
                start = end - size
                if start < done:
                    continue
                piece = text[start:end]
                if size > 1 and piece not in ids:
                    continue
                if start == 0:
                    ok = piece in self.whole
                elif start == done:
                    ok = self.compatible(last, piece)  # noqa: F821  (set when ids were given out)
                else:
                    ok = self.compatible(text[begins[start - 1 - done]:start], piece)
                if ok:
                    begin = start
                    break
            begins.append(begin)
            if end - done >= 4 * longest:
                # every pointer a later piece can reach: do they share a boundary?
                reach = {e for e in range(end - longest + 1, end + 1)}
                while len(reach) > 1 and max(reach) > done:
                    top = max(reach)
                    reach.discard(top)
                    reach.add(begins[top - 1 - done])
                common = reach.pop()
                if common > done:
                    start = begins[common - 1 - done]
                    last = text[start:common]
                    yield path(common, done)
                    begins = begins[common - done:]
                    done = common
        if n > done:
            yield path(n, done)

    def compatible_ids(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """``compatible`` of pairs of ids; -1, a character without a piece, goes with all."""
        pair = left * len(self.texts) + right
        place = (bt.mix(pair.astype(np.uint64), 91) >> np.uint64(64 - PLACES)).astype(np.int64)
        known = self.asked[place] == pair
        out = np.where(known, self.fits[place], True)
        open_ = np.flatnonzero(~known & (left >= 0) & (right >= 0))
        if len(open_):
            new, first, back = np.unique(pair[open_], return_index=True, return_inverse=True)
            names, ask = self.names, open_[first]
            found = np.array([self.compatible(names[a], names[b])
                              for a, b in zip(left[ask].tolist(), right[ask].tolist())])
            out[open_] = found[back]
            # of several pairs at one place one stays, with its own answer
            self.asked[place[ask]] = new
            stays = self.asked[place[ask]] == new
            self.fits[place[ask[stays]]] = found[stays]
        return out

    def side_by_side(self, stretches: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of stretches back to back and how many each has; all paths go on one boundary at a time."""
        sizes = np.array([len(s) for s in stretches], np.int64)
        points = np.frombuffer("".join(stretches).encode("utf-32-le"), np.uint32).astype(np.int64)
        n, firsts = len(points), np.cumsum(sizes) - sizes
        lane = np.repeat(np.arange(len(sizes)), sizes)
        room = np.repeat(firsts + sizes, sizes) - np.arange(n)
        # all pieces that lie in the stretches: where, how long, which
        at, node = np.arange(n), np.zeros(n, np.int64)
        found = []
        for size in range(1, self.longest + 1):
            keep = room[at] >= size
            at, node = at[keep], node[keep]
            step = node * POINTS + points[at + size - 1]
            i = np.minimum(np.searchsorted(self.steps, step), len(self.steps) - 1)
            hit = self.steps[i] == step
            if size == 1:
                lone = at[~hit]
                found.append((lone, np.ones(len(lone), np.int64), np.full(len(lone), -1)))
            at, node = at[hit], self.node[i[hit]]
            ends = self.ending[node] >= 0
            found.append((at[ends], np.full(ends.sum(), size), self.ending[node[ends]]))
        start, size, piece = (np.concatenate(c) for c in zip(*found))
        boundary = start + size - firsts[lane[start]]
        order = np.lexsort((-size, start + size, boundary))
        start, size, piece, boundary = start[order], size[order], piece[order], boundary[order]
        cuts = np.searchsorted(boundary, np.arange(1, sizes.max(initial=0) + 2))
        last, back = np.zeros(n, np.int64), np.zeros(n, np.int64)  # at the character before a boundary
        for a, z in zip(cuts[:-1], cuts[1:]):
            s, k, p = start[a:z], size[a:z], piece[a:z]
            fits = (k == 1) | (s == firsts[lane[s]])
            ask = np.flatnonzero(~fits)
            fits[ask] = self.compatible_ids(last[s[ask] - 1], p[ask])
            s, k, p = s[fits], k[fits], p[fits]
            end = s + k - 1
            head = np.ones(len(end), bool)  # the longest piece that fits
            head[1:] = end[1:] != end[:-1]
            last[end[head]], back[end[head]] = p[head], k[head]
        # back along the pointers
        on = np.zeros(n, bool)
        end = (firsts + sizes - 1)[sizes > 0]
        while len(end):
            on[end] = True
            before = end - back[end]
            end = before[before >= firsts[lane[end]]]
        ends = np.flatnonzero(on)
        ids, owner = last[ends], lane[ends]
        bare = np.flatnonzero(ids < 0)
        if len(bare):
            data = [[self.byte[b] for b in chr(c).encode()] for c in points[ends[bare]].tolist()]
            times = np.ones(len(ids), np.int64)
            times[bare] = [len(d) for d in data]
            first = (np.cumsum(times) - times)[bare]
            ids, owner = np.repeat(ids, times), np.repeat(owner, times)
            for f, d in zip(first.tolist(), data):
                ids[f:f + len(d)] = d
        return ids.astype(np.int32), np.bincount(owner, minlength=len(sizes))

    def numbered(self, words: list[str], opening: bool) -> np.ndarray:
        """The number of each stretch under which its ids are stored."""
        known = self.known[opening]
        new = [w for w in words if w not in known]
        extra = MARK if opening else ""
        spelt = [extra + w.replace(" ", MARK) for w in new]
        short = [i for i, w in enumerate(spelt) if len(w) <= SHORT]
        long = [i for i, w in enumerate(spelt) if len(w) > SHORT]
        parts, sizes = self.side_by_side([spelt[i] for i in short])
        streamed = [np.array([i for part in self.stream(spelt[k]) for i in part], np.int32) for k in long]
        for i, k in enumerate(short + long, len(self.at) - 1):
            known[new[k]] = i
        ends = self.at[-1] + np.cumsum(np.concatenate([sizes, [len(x) for x in streamed]]).astype(np.int64))
        self.at = np.concatenate([self.at, ends])
        if self.at[-1] > len(self.stored):
            self.stored = np.concatenate([self.stored, np.zeros(int(self.at[-1]), np.int32)])
        added = np.concatenate([parts, *streamed])
        self.stored[self.at[-1] - len(added):self.at[-1]] = added
        return np.array([known[w] for w in words], np.int64)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts back to back, and where each text's ids start."""
        raw, starts = bt.flat(texts)
        # cut before each space that follows another character, and at text starts
        blank = raw == 0x20
        mark = np.zeros(len(raw), bool)
        if len(raw) > 2:
            mark[:-2] = (raw[:-2] == 0xE2) & (raw[1:-1] == 0x96) & (raw[2:] == 0x81)
        opens = blank | mark
        inner = np.zeros(len(raw), bool)
        inner[1:] = blank[:-1]
        inner[3:] |= mark[:-3]
        cut = opens & ~inner
        first = starts[:-1][np.diff(starts) > 0]
        cut[first] = True
        at = np.flatnonzero(cut)
        head = np.zeros(len(raw), bool)
        head[first] = True
        stretches = pa.LargeStringArray.from_buffers(
            len(at), pa.py_buffer(np.append(at, len(raw)).astype(np.int64).tobytes()),
            pa.py_buffer(np.ascontiguousarray(raw).tobytes()))
        # a stretch that opens a text gets the space that the model puts there
        opening = head[at]
        codes = np.empty(len(at), np.int64)
        if not len(at):
            return np.zeros(0, np.int32), np.zeros(len(starts), np.int64)
        if len(self.at) > STRETCHES or len(self.stored) > 16 * STRETCHES:
            self.forget()
        for chosen, first_one in ((np.flatnonzero(opening), True), (np.flatnonzero(~opening), False)):
            coded = stretches.take(pa.array(chosen)).dictionary_encode()
            numbers = self.numbered(coded.dictionary.to_pylist(), first_one)
            codes[chosen] = numbers[coded.indices.to_numpy()]
        sizes = np.diff(self.at)
        ids = ragged(self.stored, self.at[:-1], sizes, codes)
        total = np.concatenate([[0], np.cumsum(sizes[codes])])
        return ids, total[np.searchsorted(at, starts)]

    def decode(self, ids: np.ndarray, starts: np.ndarray) -> list[bytes]:
        """Texts of ids; the space put before each text is taken away again."""
        data = ragged(self.flat, self.offsets, self.lengths, ids).tobytes()
        ends = np.concatenate([[0], np.cumsum(self.lengths[ids])])[starts]
        return [data[a + 1:z] if data[a:a + 1] == b" " else data[a:z] for a, z in zip(ends[:-1], ends[1:])]


def ragged(values: np.ndarray, offsets: np.ndarray, sizes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """values[offsets[r]:offsets[r] + sizes[r]] of every row, back to back."""
    n = sizes[rows]
    step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return values[np.repeat(offsets[rows], n) + step]


_READ: dict[str, Pieces] = {}


def pieces_of(model: str) -> Pieces:
    """The model, read once per worker."""
    if model not in _READ:
        _READ[model] = Pieces(model)
    return _READ[model]


def encoded(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text",
            with_ids: bool = True) -> DataFrame:
    """Key, n_tokens, ids_crc32 (ids as little-endian 32-bit numbers), n_bytes,
    round_trip, and the ids themselves on request.  Nothing is shuffled."""
    def made(batches):
        p = pieces_of(model)
        for big in batches:
            for b in chunks(big, "_text", 2_000_000):
                ids, starts = p.encode(b.column("_text"))
                raw, at = bt.flat(b.column("_text"))
                data = raw.tobytes()
                same = [data[x:y] == t for x, y, t in zip(at[:-1], at[1:], p.decode(ids, starts))]
                crc = [zlib.crc32(ids[x:y].astype("<u4").tobytes()) for x, y in zip(starts[:-1], starts[1:])]
                columns = [b.column("_id"), pa.array(np.diff(starts)), pa.array(crc, pa.int64()),
                           pa.array(np.diff(at)), pa.array(same)]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(ids)))
                yield pa.RecordBatch.from_arrays(columns, names)

    names = ["_id", "n_tokens", "ids_crc32", "n_bytes", "round_trip"] + ["ids"] * with_ids
    schema = ("_id long, n_tokens long, ids_crc32 long, n_bytes long, round_trip boolean"
              + ", ids array<int>" * with_ids)
    plain = docs.select(F.col(f"`{key}`").cast("long").alias("_id"), F.col(f"`{text}`").alias("_text"))
    return plain.mapInArrow(made, schema).withColumnRenamed("_id", key)


def decoded(rows: DataFrame, model: str, key: str = "doc_id", ids: str = "ids",
            text: str = "text") -> DataFrame:
    """Key and text of rows of ids; null ids give an empty text."""
    def made(batches):
        p = pieces_of(model)
        for b in batches:
            lists = [np.array(x or [], np.int32) for x in b.column("_ids").to_pylist()]
            starts = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
            flat = np.concatenate(lists) if lists else np.zeros(0, np.int32)
            texts = [t.decode("utf-8", "replace") for t in p.decode(flat, starts)]
            yield pa.RecordBatch.from_arrays([b.column("_id"), pa.array(texts, pa.string())], ["_id", "_text"])

    plain = rows.select(F.col(f"`{key}`").cast("long").alias("_id"), F.col(f"`{ids}`").alias("_ids"))
    return (plain.mapInArrow(made, "_id long, _text string")
            .withColumnsRenamed({"_id": key, "_text": text}))
