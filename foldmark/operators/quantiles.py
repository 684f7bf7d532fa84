"""Exact quantiles of many columns and slots without a global sort.

``percentile`` keeps every distinct value of a column in one buffer, which a
continuous column of a large table does not fit.  Here a sketch gives, for
each wanted rank, a narrow interval of values.  One grouped pass counts the
rows in the gaps between intervals and the values inside them, per fold; only
the latter are ordered.  Intervals that hold too much are narrowed first.
Counts add up, so every "all folds but k" comes out of the same pass.

On large tables the sketch reads a sample, since the sketches of many tasks
are merged by one.  That only places the intervals: the counts of all rows
decide, and a rank outside its interval makes the interval grow.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass
from math import ceil, floor, inf, nextafter

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from foldmark.constants import SEED
from foldmark.operators.slots import Slots
from foldmark.session import materialize

ACCURACY = 10_000
MAX_INSIDE = 2_000_000
SKETCH_ROWS = 10_000_000
KEPT_CELLS = 50_000_000          # tables counted to be this small are kept
LARGEST = sys.float_info.max     # stands for infinity, as splits are finite


# -- bisection ----------------------------------------------------------------

def with_ranks(df: DataFrame, wanted: dict[str, tuple[Column, list[float]]]) -> DataFrame:
    """Add, per name, how many of the ascending splits are <= the value.

    ``Bucketizer`` bisects, so the cost hardly grows with the splits.
    """
    names = [n for n, (_, splits) in wanted.items() if splits]
    out = df.withColumns({n: x.cast("double") if splits else F.when(x.isNotNull(), F.lit(0))
                          for n, (x, splits) in wanted.items()})
    if not names:
        return out
    made = [f"{n}#" for n in names]
    bucket = Bucketizer(splitsArray=[[-inf, *wanted[n][1], inf] for n in names],
                        inputCols=names, outputCols=made, handleInvalid="keep")
    return bucket.transform(out).withColumns(
        {n: F.when(F.col(n).isNotNull(), F.col(m).cast("int"))
         for n, m in zip(names, made)}).drop(*made)


def with_bins(df: DataFrame, wanted: dict[str, tuple[Column, list[float]]]) -> DataFrame:
    """Add, per name, the number of cut points below the value."""
    return with_ranks(df, {n: (x, sorted({nextafter(c, inf) for c in cuts}))
                           for n, (x, cuts) in wanted.items()})


def _sketched(df: DataFrame, n: int) -> DataFrame:
    """At most about ``SKETCH_ROWS`` of n rows, to place cuts by."""
    return df if n <= SKETCH_ROWS else df.sample(SKETCH_ROWS / n, seed=SEED)


def rough_cuts(df: DataFrame, x: Column, pieces: int, n: int) -> list[float]:
    """Approximate cut points of n rows, repeated where one value fills several."""
    probs = F.array(*[F.lit(i / pieces) for i in range(1, pieces)])
    got = _sketched(df, n).agg(F.percentile_approx(x, probs, F.lit(max(ACCURACY, 4 * pieces)))).first()[0]
    return got or []


# -- intervals ----------------------------------------------------------------

@dataclass
class _Source:
    """A column: the wanted ranks of each slot, and intervals to hold them."""

    ranks: list[list[int]]
    intervals: list[tuple[float, float]]


def _merge(intervals: list[tuple[float, float]]) -> list[tuple[float, float]]:
    out: list[tuple[float, float]] = []
    for low, high in sorted(intervals):
        if out and low <= nextafter(out[-1][1], inf):
            out[-1] = (out[-1][0], max(out[-1][1], high))
        else:
            out.append((low, high))
    return out


def _long(wide: DataFrame, sources: list[_Source]) -> DataFrame:
    """``(_fold, s, code, value)`` of every value.

    The code is 2j in the gap before interval j and 2j + 1 inside it; the
    value is kept inside only, so that all rows of a gap are one group.
    """
    ranked = with_ranks(wide, {
        f"_c{i}": (F.col(f"_x{i}"), [e for low, high in s.intervals
                                     for e in (low, nextafter(high, inf)) if e < inf])
        for i, s in enumerate(sources)})
    cells = [c for i in range(len(sources)) for c in (
        F.lit(i), F.col(f"_c{i}"), F.when(F.col(f"_c{i}") % 2 == 1, F.col(f"_x{i}")))]
    return (ranked.select("_fold", F.stack(F.lit(len(sources)), *cells)
                          .alias("s", "code", "value"))
            .filter(F.col("code").isNotNull()))


def _per_slot(slots: Slots) -> list[Column]:
    """Row counts: all, and of every fold."""
    return [F.count(F.lit(1)).alias("n"),
            *[F.count_if(F.col("_fold") == k).alias(f"n{k}") for k in range(slots.folds)]]


def _totals(counts: DataFrame, slots: Slots) -> dict[int, dict[int, list[int]]]:
    """Rows by source, code and slot: two codes per interval come back."""
    names = ["n", *[f"n{k}" for k in range(slots.folds)]]
    out: dict[int, dict[int, list[int]]] = {}
    for r in counts.groupBy("s", "code").agg(*[F.sum(c).alias(c) for c in names]).collect():
        out.setdefault(r["s"], {})[r["code"]] = [
            *[r["n"] - r[f"n{k}"] for k in range(slots.folds)], r["n"]]
    return out


def _place(totals: dict[int, list[int]], slot: int, rank: int) -> tuple[int, int]:
    """Code that holds a rank of a slot, and the slot's rows before it."""
    before = 0
    for code in sorted(totals):
        if rank < before + totals[code][slot]:
            return code, before
        before += totals[code][slot]
    raise AssertionError("rank beyond the counted rows")


def _widen(source: _Source, totals: dict[int, list[int]]) -> bool:
    """Add the gaps that hold a rank, where the sketch was off."""
    codes = {_place(totals, k, r)[0] for k, ranks in enumerate(source.ranks) for r in ranks}
    for code in (c for c in codes if c % 2 == 0):
        j = code // 2
        low = source.intervals[j - 1][1] if j > 0 else -LARGEST
        high = source.intervals[j][0] if j < len(source.intervals) else LARGEST
        source.intervals = [*source.intervals, (low, high)]
    source.intervals = _merge(source.intervals)
    return any(c % 2 == 0 for c in codes)


def _narrow(wide: DataFrame, sources: list[_Source], slots: Slots) -> bool:
    """Replace crowded intervals by those of a sketch of their own rows."""
    totals = _totals(_long(wide, sources).groupBy("s", "code").agg(*_per_slot(slots)), slots)
    cols, plan, crowd = [], [], 0
    for i, s in enumerate(sources):
        if i not in totals or _widen(s, totals[i]):
            continue
        for j, (low, high) in enumerate(s.intervals):
            inside = totals[i].get(2 * j + 1)
            if inside is None or inside[-1] <= MAX_INSIDE or low == high:
                continue
            crowd = max(crowd, inside[-1])
            asked = []      # per slot: lowest and highest share of its rows here
            for k, ranks in enumerate(s.ranks):
                at = [(r - b) / inside[k] for r in ranks
                      for c, b in [_place(totals[i], k, r)] if c == 2 * j + 1]
                step = 2 / ACCURACY + 2 / min(max(inside[k], 1), SKETCH_ROWS) ** 0.5
                asked += [(k, max(a - step, 0.0), min(a + step, 1.0)) for a in at]
            x = F.col(f"_x{i}")
            for k, lo, hi in asked:
                own = F.lit(True) if k == slots.folds else F.col("_fold") != k
                cols.append(F.percentile_approx(
                    F.when(x.between(low, high) & own, x),
                    F.array(F.lit(lo), F.lit(hi)), F.lit(ACCURACY)).alias(f"c{len(cols)}"))
            plan.append((i, j, len(asked)))
    if not plan:
        return False
    found = iter(_sketched(wide, crowd).agg(*cols).first())
    before = [list(s.intervals) for s in sources]
    kept = [[iv for j, iv in enumerate(s.intervals) if (i, j) not in {p[:2] for p in plan}]
            for i, s in enumerate(sources)]
    for i, _, width in plan:
        kept[i] += [tuple(edge) for edge in (next(found) for _ in range(width)) if edge]
    for s, intervals in zip(sources, kept):
        s.intervals = _merge(intervals)
    return before != [s.intervals for s in sources]


def _wanted(n: int, p: float, discrete: bool) -> tuple[int, int, float]:
    """Two ranks and the weight of the second."""
    if discrete:
        r = max(ceil(round(n * p, 9)) - 1, 0)
        return r, r, 0.0
    at = (n - 1) * p
    return floor(at), ceil(at), at - floor(at)


def slot_quantiles(df: DataFrame, columns: dict[str, Column], probs: list[float],
                   slots: Slots = Slots(), discrete: bool = False
                   ) -> dict[str, list[list[float | None]]]:
    """Quantiles by column, slot and probability.

    Values are interpolated between neighbours, or, with ``discrete``, taken
    from the column.  Nulls and NaN are left out.  What comes back to the
    driver is a fixed number of values per column, slot and probability.
    """
    names = list(columns)
    nothing = {c: [[None] * len(probs) for _ in range(slots.count)] for c in names}
    if not names or not probs:
        return nothing
    fold = F.col(slots.fold) if slots.fold is not None else F.lit(0)
    wide = df.select(fold.cast("int").alias("_fold"), *[
        columns[c].cast("double").alias(f"_y{i}") for i, c in enumerate(names)])
    wide = wide.select("_fold", *[
        F.when(F.col(y).isNotNull() & ~F.isnan(y),
               F.greatest(F.least(y, F.lit(LARGEST)), F.lit(-LARGEST))).alias(f"_x{i}")
        for i, y in enumerate(f"_y{i}" for i in range(len(names)))])

    sized = wide.groupBy("_fold").agg(*[F.count(f"_x{i}").alias(f"n{i}")
                                        for i in range(len(names))]).collect()
    sizes = []
    for i in range(len(names)):
        own = {r["_fold"]: r[f"n{i}"] for r in sized}
        total = sum(own.values())
        sizes.append([*[total - own.get(k, 0) for k in range(slots.folds)], total])
    if not any(n[-1] for n in sizes):
        return nothing

    # A small table may come out of a single file part: deal it over the cores.
    small = sum(n[-1] for n in sizes) <= KEPT_CELLS
    if small:
        wide = wide.repartition(df.sparkSession.sparkContext.defaultParallelism).persist()
    try:
        return _find(wide, names, sizes, probs, slots, discrete)
    finally:
        if small:
            wide.unpersist()


def _find(wide: DataFrame, names: list[str], sizes: list[list[int]], probs: list[float],
          slots: Slots, discrete: bool) -> dict[str, list[list[float | None]]]:
    largest = max(n[-1] for n in sizes)
    # The sketch is off by 1 / ACCURACY, a sample of m rows by about
    # 1 / sqrt(m), and a slot differs from the whole by about 1 / sqrt(n).
    spread = 2.0 / ACCURACY
    spread += 2.0 / SKETCH_ROWS ** 0.5 if largest > SKETCH_ROWS else 0.0
    spread += 2.0 / (min(n[-1] for n in sizes if n[-1]) * max(slots.folds - 1, 1)) ** 0.5 \
        if slots.folds else 0.0
    edges = [min(max(p + d, 0.0), 1.0) for p in probs for d in (-spread, spread)]
    ask = F.array(*[F.lit(e) for e in edges])
    sketch = _sketched(wide, largest).agg(*[
        F.percentile_approx(f"_x{i}", ask, F.lit(ACCURACY)).alias(f"e{i}")
        for i in range(len(names))]).first()
    sources, spots = [], []
    for i, by_slot in enumerate(sizes):
        spots.append([[_wanted(n, p, discrete) for p in probs] if n else [] for n in by_slot])
        found = sketch[f"e{i}"]
        sources.append(_Source(
            [sorted({r for spot in spots[i][k] for r in spot[:2]}) for k in range(slots.count)],
            _merge([(found[2 * q], found[2 * q + 1]) for q in range(len(probs))])
            if found else [(-LARGEST, LARGEST)]))

    crowded = largest * 2 * spread > MAX_INSIDE
    while True:
        while crowded and _narrow(wide, sources, slots):
            pass
        counts = materialize(_long(wide, sources).groupBy("s", "code", "value")
                             .agg(*_per_slot(slots)))
        totals = _totals(counts, slots)
        missed = [_widen(s, totals[i]) for i, s in enumerate(sources) if i in totals]
        if not any(missed):
            break
        crowded = largest > MAX_INSIDE

    # Look every rank up inside its interval: one row per rank comes back.
    ranks = []
    for i, s in enumerate(sources):
        for k in range(slots.count):
            for r in s.ranks[k]:
                code, before = _place(totals[i], k, r)
                ranks.append((i, code, k, r, r - before))
    wanted = wide.sparkSession.createDataFrame(
        ranks, "s int, code int, slot int, rank long, at long")
    running = W.partitionBy("s", "code").orderBy("value").rowsBetween(W.unboundedPreceding, 0)
    inside = counts.filter(F.col("value").isNotNull()).withColumn(
        "own", slots.less_own(F.col("n"), [F.col(f"n{k}") for k in range(slots.folds)]))
    upto = F.array(*[F.sum(F.element_at("own", k + 1)).over(running)
                     for k in range(slots.count)])
    last = F.element_at("upto", F.col("slot") + 1)
    first = last - F.element_at("own", F.col("slot") + 1)
    placed = (inside.withColumn("upto", upto).join(F.broadcast(wanted), ["s", "code"])
              .filter((F.col("at") < last) & (F.col("at") >= first)))
    at = {(r["s"], r["slot"], r["rank"]): r["value"]
          for r in placed.select("s", "slot", "rank", "value").collect()}
    return {c: [[at[i, k, a] + (at[i, k, b] - at[i, k, a]) * w for a, b, w in spots[i][k]]
                or [None] * len(probs) for k in range(slots.count)]
            for i, c in enumerate(names)}


def exact_quantiles(df: DataFrame, columns: dict[str, Column], probs: list[float],
                    discrete: bool = False) -> dict[str, list[float | None]]:
    """Quantiles by column and probability, over all rows."""
    return {c: v[-1] for c, v in slot_quantiles(df, columns, probs, Slots(), discrete).items()}


def cut_points(df: DataFrame, columns: dict[str, Column], bins: int) -> dict[str, list[float]]:
    """Inner cut points of equal-frequency bins: existing values, ascending."""
    got = exact_quantiles(df, columns, [i / bins for i in range(1, bins)], discrete=True)
    return {c: sorted(set(v) - {None}) for c, v in got.items()}
