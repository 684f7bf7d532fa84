"""Shards of near equal bytes: minimax contiguous partition.

Documents with equal texts form one group that no cut divides.  Groups stand in
the order of their smallest id.  The smallest capacity for which filling one
shard after the other needs no more than the given number of shards is found
by bisection, and the cuts are those of that filling.

The filling asks one question: which group end is the last at or before a
position?  Ends are counted in cells, a bounded number of which reach the
driver.  A cell gives a lower and an upper answer; both are bisected, and only
cells that can still change the result are divided further, by another count
over those ranges of positions.  After a few counts the answer is exact.

Defined results: a null text has no bytes and counts as an empty one; rows
that share an id are separate rows; null ids come first; without rows there is
no result; a group larger than an even share fills a shard of its own.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import DataFrame, functions as F

from foldmark.llm.order import in_pieces, running, written

CELLS = 8192
OVERHEAD = 8


class Ends:
    """What is known of the sorted group ends: cells of (first, last, count)."""

    def __init__(self, cells: list[tuple[int, int, int]]):
        self.cells = sorted(cells)
        self.firsts = [c[0] for c in self.cells]

    def last_upto(self, x: int) -> tuple[int, int]:
        """Smallest and largest possible value of the last end at or before x."""
        i = bisect_right(self.firsts, x) - 1
        if i < 0:
            return 0, 0
        first, last, n = self.cells[i]
        if x >= last:
            return last, last
        return (first, first) if n <= 2 else (first, min(x, last - 1))

    def fill(self, capacity: int, shards: int, total: int, best: bool) -> tuple[list[int], bool]:
        """Ends of the shards filled one after the other; whether all fits."""
        at, cuts = 0, []
        for _ in range(shards):
            if at + capacity >= total:
                return cuts + [total], True
            at = self.last_upto(at + capacity)[1 if best else 0]
            cuts.append(at)
        return cuts, at >= total

    def smallest(self, lo: int, hi: int, shards: int, total: int, best: bool) -> int:
        while lo < hi:
            mid = (lo + hi) // 2
            if self.fill(mid, shards, total, best)[1]:
                hi = mid
            else:
                lo = mid + 1
        return lo

    def divided(self, spans: list[tuple[int, int]], cells: list[tuple[int, int, int]]) -> "Ends":
        rest = [c for c in self.cells if not any(a <= c[0] and c[1] <= b for a, b in spans)]
        return Ends(rest + cells)


def counted(ends: DataFrame, spans: list[tuple[int, int]], cells: int) -> list[tuple[int, int, int]]:
    """Ends inside the spans, in at most ``cells`` cells altogether."""
    cell = None
    for k, (a, b) in enumerate(spans):
        step = max(1, -(-(b - a + 1) // max(1, cells // len(spans))))
        inside = F.col("end").between(a, b)
        name = F.struct(F.lit(k).alias("k"),
                        F.floor((F.col("end") - F.lit(a)) / F.lit(step)).alias("i"))
        cell = F.when(inside, name) if cell is None else cell.when(inside, name)
    rows = (ends.withColumn("cell", cell).filter("cell IS NOT NULL").groupBy("cell")
            .agg(F.min("end").alias("a"), F.max("end").alias("b"),
                 F.count_distinct("end").alias("n")).collect())
    return [(r["a"], r["b"], r["n"]) for r in rows]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def cuts_of(ends: DataFrame, total: int, largest: int, shards: int,
            cells: int = CELLS) -> tuple[int, list[int]]:
    """The smallest capacity, and the ends of the shards it is filled to.

    ``ends`` has the running byte total ``end`` of every group.
    """
    if total <= 0:
        return 0, []
    lo, hi = max(-(-total // shards), largest), -(-total // shards) + largest
    known = Ends(counted(ends, [(1, total)], cells))
    while True:
        lo = known.smallest(lo, hi, shards, total, best=True)
        hi = known.smallest(lo, hi, shards, total, best=False)
        low, high = (known.fill(c, shards, total, b)[0] for c, b in ((lo, False), (hi, True)))
        if lo == hi and low == high:
            return lo, low
        spans = []
        for a, b in zip([0, *low], [0, *high]):
            near = [c for c in known.cells if c[2] > 2 and c[0] < b + hi and c[1] > a + lo]
            if near:
                spans.append((near[0][0], near[-1][1]))
        spans = merged(spans)
        known = known.divided(spans, counted(ends, spans, cells))


def by_bytes(docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, size, text_crc32, law, shard, slot and grown_shard of every row."""
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = in_pieces(docs.select(
        F.col(f"`{key}`").alias("_key"), (F.octet_length(t) + F.lit(OVERHEAD)).cast("long").alias("_size"),
        F.crc32(t.cast("binary")).alias("_crc"), F.md5(t.cast("binary")).alias("_group")),
        ["_key", "_group"], "shard-rows")
    groups = (rows.groupBy("_group").agg(F.min("_key").alias("_first"),
                                         F.sum("_size").alias("_bytes")))
    order = ["_first", "_group"]
    ends = written(running(in_pieces(groups, order, "shard-groups"), order,
                           {"_before": F.col("_bytes")})
                   .select("_group", (F.col("_before") + F.col("_bytes")).alias("end"), "_bytes"),
                   "shard-ends")
    whole = ends.agg(F.coalesce(F.max("end"), F.lit(0)), F.coalesce(F.max("_bytes"), F.lit(0))).first()
    _, cuts = cuts_of(ends.select("end"), whole[0], whole[1], shards)
    shard = F.lit(0)
    for c in cuts[:-1]:
        shard = shard + (F.col("end") > F.lit(c)).cast("int")
    placed = (rows.join(ends.select("_group", shard.alias("_shard")), "_group"))
    placed = running(written(placed, "shard-placed"), ["_key", "_group"],
                     {"_slot": F.lit(1)}, ["_shard"])
    return placed.select(
        F.col("_key").alias(key), F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"),
        F.lit("bytes").alias("law"), F.col("_shard").cast("int").alias("shard"),
        F.col("_slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
