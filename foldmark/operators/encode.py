"""Fitted statistics, for the whole table and for "all folds but k" at once.

Counts and sums add up, so one grouped aggregate with a slot per fold gives
every leave-one-fold-out value as total minus own.  A state table has one row
per level with arrays of ``folds + 1`` values: slot k leaves fold k out, the
last slot uses all rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from foldmark.constants import SKEW_LIMIT, TE_SMOOTHING, TOP_VARIANCE
from foldmark.functions.features import null_token, smoothed
from foldmark.functions.moments import Moments
from foldmark.operators.lookup import LevelTable, lookup
from foldmark.operators.quantiles import slot_quantiles
from foldmark.operators.slots import Slots
from foldmark.operators.unpivot import long_values
from foldmark.session import materialize


def target_totals(df: DataFrame, y: Column, slots: Slots = Slots()) -> tuple[list, list]:
    """Sum and count of the target per slot: two short driver lists."""
    x = y.cast("double")
    cols = []
    for k in range(slots.count):
        kept = F.when(~slots.own(k), x)
        cols += [F.sum(kept).alias(f"s{k}"), F.count(kept).alias(f"n{k}")]
    row = df.agg(*cols).first()
    return ([row[f"s{k}"] or 0.0 for k in range(slots.count)],
            [row[f"n{k}"] for k in range(slots.count)])


def global_means(df: DataFrame, y: Column, slots: Slots = Slots()) -> list[float | None]:
    sums, counts = target_totals(df, y, slots)
    return [s / n if n else None for s, n in zip(sums, counts)]


def level_counts(df: DataFrame, columns: dict[str, Column], y: Column | None = None,
                 slots: Slots = Slots(), null_level: bool = True,
                 keep_nulls: bool = False) -> DataFrame:
    """``(feature, level, n, counts[, ysums, ycounts])`` with slot arrays.

    All features in one shuffle.  ``null_level`` makes null a level of its
    own; otherwise null rows are left out, or kept under a null level.
    """
    exprs = {c: null_token(x) if null_level else x for c, x in columns.items()}
    keep = {}
    if slots.fold is not None:
        keep["_fold"] = F.col(slots.fold)
    if y is not None:
        keep["_y"] = y.cast("double")
    rows = long_values(df, exprs, keep=keep)
    if not keep_nulls:
        rows = rows.filter(F.col("value").isNotNull())
    aggs = [F.count(F.lit(1)).alias("n")]
    if y is not None:
        aggs += [F.sum("_y").alias("ys"), F.count("_y").alias("yn")]
    for k in range(slots.folds):
        own = F.col("_fold") == k
        aggs.append(F.count_if(own).alias(f"n{k}"))
        if y is not None:
            aggs += [F.sum(F.when(own, F.col("_y"))).alias(f"ys{k}"),
                     F.count(F.when(own, F.col("_y"))).alias(f"yn{k}")]
    grouped = rows.groupBy(F.col("column").alias("feature"), F.col("value").alias("level")) \
        .agg(*aggs)

    def slot_array(name: str) -> Column:
        zero = F.lit(0.0) if name == "ys" else F.lit(0)
        return slots.less_own(F.coalesce(F.col(name), zero),
                              [F.coalesce(F.col(f"{name}{k}"), zero)
                               for k in range(slots.folds)])

    out = ["feature", "level", "n", slot_array("n").alias("counts")]
    if y is not None:
        out += [slot_array("ys").alias("ysums"), slot_array("yn").alias("ycounts")]
    return grouped.select(*out)


def as_level_table(table: DataFrame, keys: tuple[str, ...], total: int) -> LevelTable:
    """Write a state table and count it, so that lookups know its size."""
    written = materialize(table)
    return LevelTable(written, keys, written.count(), total)


# -- encoders ------------------------------------------------------------------

@dataclass(frozen=True)
class LevelEncoder:
    """Frequency and target encodings of a set of columns."""

    columns: dict[str, Column]
    levels: LevelTable
    slots: Slots
    rows: list[int]                 # rows behind each slot
    means: list[float | None]       # global target mean of each slot
    smoothing: float
    null_level: bool
    with_target: bool
    sizes: dict[str, tuple[int, int]]   # levels of each column, and their bytes

    def _level(self, c: str) -> Column:
        x = self.columns[c]
        return null_token(x) if self.null_level else x.cast("string")

    def _constant(self, values: list, holdout: int | None) -> Column:
        array = F.array(*[F.lit(v).cast("double") for v in values])
        return self.slots.pick(array, holdout)

    def transform(self, df: DataFrame, key: str, holdout: int | None = None, *,
                  frequency: str | None = None, count: str | None = None,
                  target: str | None = None) -> DataFrame:
        """Add ``<column><suffix>`` for each suffix given.

        ``frequency``: share of rows, unseen 0.  ``count``: rows, unseen 0.
        ``target``: smoothed mean, unseen the global mean.
        """
        out = df
        for c in self.columns:
            table = self.levels.table.filter(F.col("feature") == c)
            n_levels, size = self.sizes.get(c, (0, 0))
            one = LevelTable(table, ("level",), n_levels, self.levels.total, size)
            values = {"counts": "_counts"}
            if self.with_target:
                values |= {"ysums": "_ysums", "ycounts": "_ycounts"}
            out = lookup(out, one, [self._level(c)], values, F.col(key))
            n = F.coalesce(self.slots.pick(F.col("_counts"), holdout), F.lit(0))
            new = {}
            if frequency:
                new[f"{c}{frequency}"] = n / self._constant(self.rows, holdout)
            if count:
                new[f"{c}{count}"] = n
            if target:
                prior = self._constant(self.means, holdout)
                total = F.coalesce(self.slots.pick(F.col("_ysums"), holdout), F.lit(0.0))
                seen = F.coalesce(self.slots.pick(F.col("_ycounts"), holdout), F.lit(0))
                new[f"{c}{target}"] = F.when(
                    seen > 0, smoothed(total, seen, prior, self.smoothing)).otherwise(prior)
            out = out.withColumns(new).drop(*values.values())
        return out


def fit_levels(df: DataFrame, columns: dict[str, Column] | list[str],
               y: Column | None = None, slots: Slots = Slots(),
               smoothing: float = TE_SMOOTHING, null_level: bool = True) -> LevelEncoder:
    """Fit all level statistics of all columns in one scan.

    The levels of any one column, null among them, cover all rows: the sizes
    and target means of the slots are sums over its short table.
    """
    if not isinstance(columns, dict):
        columns = {c: F.col(c) for c in columns}
    table = materialize(level_counts(df, columns, y, slots, null_level, keep_nulls=True))

    def over(name: str) -> list[Column]:
        return [F.sum(F.element_at(name, k + 1)).alias(f"{name}{k}") for k in range(slots.count)]

    arrays = ["counts", *(["ysums", "ycounts"] if y is not None else [])]
    sums = (table.filter(F.col("feature") == next(iter(columns)))
            .agg(*[c for name in arrays for c in over(name)])).first()
    rows = [sums[f"counts{k}"] or 0 for k in range(slots.count)]
    means = [sums[f"ysums{k}"] / sums[f"ycounts{k}"] if sums[f"ycounts{k}"] else None
             for k in range(slots.count)] if y is not None else []
    levels = table.filter(F.col("level").isNotNull())
    # a wide column must not keep the short ones from being broadcast
    sizes = {r["feature"]: (r["n"], r["size"] or 0) for r in levels.groupBy("feature").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("level")).alias("size")).collect()}
    whole = LevelTable(levels, ("feature", "level"), sum(n for n, _ in sizes.values()), rows[-1],
                       sum(b for _, b in sizes.values()))
    return LevelEncoder(columns, whole, slots, rows, means, smoothing, null_level, y is not None, sizes)


def smoothed_levels(df: DataFrame, column: str, y: Column, weight: float,
                    null_level: bool = True) -> DataFrame:
    """``(level, n, te)``: the target-encoding table of one column."""
    prior = df.agg(F.avg(y.cast("double"))).scalar()
    counts = level_counts(df, {column: F.col(column)}, y, null_level=null_level)
    return counts.select(
        "level", F.col("n"),
        smoothed(F.element_at("ysums", 1), F.element_at("ycounts", 1), prior, weight)
        .alias("te"))


def composite(*columns: str) -> Column:
    """Key of a level combination, unambiguous for any contents."""
    return F.to_json(F.array(*[null_token(F.col(c)) for c in columns]))


# -- scalar statistics -----------------------------------------------------------

def fit_medians(df: DataFrame, columns: list[str],
                slots: Slots = Slots()) -> dict[str, list[float | None]]:
    """Exact median of every column for every slot."""
    got = slot_quantiles(df, {c: F.col(c) for c in columns}, [0.5], slots)
    return {c: [q[0] for q in v] for c, v in got.items()}


def fit_moments(df: DataFrame, columns: list[str],
                slots: Slots = Slots()) -> dict[str, list[Moments]]:
    """Moments per slot: one row per fold, merged for "all but k"."""
    aggs = [m for c in columns for m in Moments.columns(c, F.col(c).cast("double"))]
    if not aggs:
        return {}
    group = F.col(slots.fold) if slots.fold is not None else F.lit(0)
    found = {r["_f"]: r for r in df.groupBy(group.alias("_f")).agg(*aggs).collect()}
    out = {}
    for c in columns:
        parts = {f: Moments.from_row(r, c) for f, r in found.items()}
        slot_values = []
        for k in range(slots.count):
            total = Moments()
            for f, m in sorted(parts.items()):
                if slots.fold is None or k == slots.folds or f != k:
                    total = total.merge(m)
            slot_values.append(total)
        out[c] = slot_values
    return out


def skewed_columns(moments: dict[str, list[Moments]], slot: int = -1) -> list[str]:
    """Columns whose values are all positive and whose skew exceeds 1.

    A column without values counts as positive, but has no skew.
    """
    return [c for c, m in moments.items()
            if m[slot].n and m[slot].low > 0 and abs(m[slot].skew) > SKEW_LIMIT]


def top_variance(moments: dict[str, list[Moments]], slot: int = -1,
                 top: int = TOP_VARIANCE) -> list[str]:
    """Columns of largest sample variance, ties by name."""
    ranked = sorted((-(m[slot].variance or 0.0), c) for c, m in moments.items()
                    if m[slot].variance is not None)
    return [c for _, c in ranked[:top]]


def target_range(df: DataFrame, y: Column, slots: Slots = Slots()) -> list[tuple]:
    x = y.cast("double")
    row = df.agg(*[f(F.when(~slots.own(k), x)).alias(f"{n}{k}")
                   for k in range(slots.count) for f, n in ((F.min, "lo"), (F.max, "hi"))]).first()
    return [(row[f"lo{k}"], row[f"hi{k}"]) for k in range(slots.count)]
