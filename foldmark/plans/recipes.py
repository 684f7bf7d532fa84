"""Feature recipes: the five cumulative steps, and the recorded best set."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import ClassVar

from pyspark.sql import Column, DataFrame, functions as F

from foldmark.constants import TE_SMOOTHING, TE_SMOOTHING_SUM
from foldmark.functions import features as fx
from foldmark.functions.kinds import non_numeric_columns, numeric_columns
from foldmark.operators.encode import (
    LevelEncoder, Slots, fit_levels, fit_medians, fit_moments, skewed_columns,
    target_range, top_variance,
)
from foldmark.operators.framing import ProblemSpec
from foldmark.operators.sequence import event_history
from foldmark.plans.contract import (
    FOLD, KEY, LABEL, NONE, OWN_FOLD, RESERVED, Solution, reserved,
)


class PassThrough(Solution):
    """Inputs without the id: the baseline every recipe has to beat."""

    slot_aware = True

    def fit(self, train: DataFrame, spec: ProblemSpec, slots: Slots) -> None:
        self.columns = [c for c in train.columns if c not in (*RESERVED, spec.id)]

    def transform(self, df: DataFrame, holdout: int | None = NONE) -> DataFrame:
        return df.select(*reserved(df), *self.columns)


STEPS = ("clean", "frequency", "target", "numeric", "clip")


class Curriculum(Solution):
    """Five steps, each adding to the one before.

    0 impute with flags, log of skewed positives, null token; 1 level
    frequencies; 2 smoothed target encodings; 3 products, ratios and row
    statistics of the five widest numeric columns; 4 clipped predictions.
    """

    slot_aware = True

    def __init__(self, step: int):
        self.step = min(step, len(STEPS) - 1)

    def fit(self, train: DataFrame, spec: ProblemSpec, slots: Slots) -> None:
        self.slots, self.problem_type = slots, spec.problem_type
        inputs = train.drop(*RESERVED, *([spec.id] if spec.id else []))
        self.numbers = numeric_columns(inputs)
        self.texts = non_numeric_columns(inputs)
        self.medians = fit_medians(train, self.numbers, slots)
        moments = fit_moments(train, self.numbers, slots)
        each = range(slots.count)
        self.skewed = [skewed_columns(moments, k) for k in each]
        self.widest = [top_variance(moments, k) for k in each] if self.step >= 3 else []
        self.encoder: LevelEncoder | None = None
        if self.step >= 1 and self.texts:
            self.encoder = fit_levels(train, self.texts,
                                      F.col(LABEL) if self.step >= 2 else None,
                                      slots, TE_SMOOTHING)
        if self.step >= 4 and self.problem_type == "regression":
            self.range = target_range(train, F.col(LABEL), slots)

    # per-slot choices ------------------------------------------------------

    def _slot(self, holdout: int | None) -> int:
        return self.slots.folds if holdout is NONE else holdout

    def _value(self, values: list, holdout: int | None) -> Column:
        return self.slots.pick(F.array(*[F.lit(v).cast("double") for v in values]), holdout)

    def _where(self, chosen: list[bool], column: Column, holdout: int | None) -> Column | None:
        """A column that exists only in some slots: null in the others."""
        if holdout != OWN_FOLD:
            return column if chosen[self._slot(holdout)] else None
        folds = [k for k in range(self.slots.folds) if chosen[k]]
        if len(folds) == self.slots.folds:
            return column
        return F.when(F.col(FOLD).isin(folds), column) if folds else None

    def transform(self, df: DataFrame, holdout: int | None = NONE) -> DataFrame:
        filled = {c: fx.impute(F.col(c), self._value(self.medians[c], holdout))
                  for c in self.numbers}
        out: dict[str, Column | None] = {}
        for c in self.numbers:
            out[c] = filled[c]
            out[f"{c}__isna"] = fx.is_missing(F.col(c))
        for c in self.numbers:
            out[f"{c}__log1p"] = self._where([c in s for s in self.skewed],
                                             fx.log1p_floor(filled[c]), holdout)
        if self.step >= 3:
            self._add_numeric(out, filled, holdout)
        rows = df
        added = []
        if self.encoder is not None:
            rows = self.encoder.transform(df, KEY, holdout, frequency="__freq",
                                          target="__te" if self.step >= 2 else None)
            added = [c for c in rows.columns if c not in df.columns]
        clean = fx.inf_to_null if self.step >= 3 else (lambda x: x)
        return rows.select(
            *reserved(df),
            *[clean(e).alias(n) for n, e in out.items() if e is not None],
            *[F.col(c) for c in added],
            *[fx.null_token(F.col(c)).alias(c) for c in self.texts])

    def _add_numeric(self, out: dict, filled: dict, holdout: int | None) -> None:
        def orders(pair):       # a pair is built the way round its slot ranks it
            a, b = pair
            return [a in w and b in w and w.index(a) < w.index(b) for w in self.widest]

        used = sorted({c for w in self.widest for c in w})
        for a in used:
            for b in used:
                if a != b:
                    chosen = orders((a, b))
                    out[f"{a}_x_{b}"] = self._where(
                        chosen, fx.product(filled[a], filled[b]), holdout)
                    out[f"{a}_div_{b}"] = self._where(
                        chosen, fx.ratio(filled[a], filled[b]), holdout)
        sets = sorted({tuple(w) for w in self.widest if w})
        means, stds = [], []
        for s in sets:
            cols = [filled[c] for c in s]
            chosen = [tuple(w) == s for w in self.widest]
            means.append(self._where(chosen, fx.row_mean(cols), holdout))
            stds.append(self._where(chosen, fx.row_std(cols), holdout))
        for name, parts in (("__row_mean", means), ("__row_std", stds)):
            parts = [p for p in parts if p is not None]
            out[name] = F.coalesce(*parts) if parts else None

    def postprocess(self, pred: Column, holdout: int | None = NONE) -> Column:
        if self.step < 4 or self.problem_type != "regression":
            return pred
        low = self._value([r[0] for r in self.range], holdout)
        high = self._value([r[1] for r in self.range], holdout)
        return fx.clip_to_range(pred, low, high)


@dataclass
class RecordedFeatures(Solution):
    """The recorded winning set, for columns of the user's choice.

    Raw counts, zero flags, logs, target encodings with nulls left out, a
    cyclic pair, encoding × raw products, and optionally a running history.
    Columns that the table lacks are passed over.
    """

    slot_aware: ClassVar[bool] = True

    count_columns: list[str] = field(default_factory=list)
    zero_columns: list[str] = field(default_factory=list)
    log_columns: list[str] = field(default_factory=list)
    target_columns: list[str] = field(default_factory=list)
    cyclic_columns: list[str] = field(default_factory=list)
    crosses: list[tuple[str, str]] = field(default_factory=list)
    history: tuple[list[str], str, str] | None = None   # entity, order, flag
    history_cross: str | None = None
    smoothing: float = TE_SMOOTHING_SUM

    def fit(self, train: DataFrame, spec: ProblemSpec, slots: Slots) -> None:
        have = set(train.columns)
        self.base = [c for c in train.columns if c not in (*RESERVED, spec.id)]
        self._counts = [c for c in self.count_columns if c in have]
        self._targets = [c for c in self.target_columns if c in have]
        levels = list(dict.fromkeys([*self._counts, *self._targets]))
        self.encoder = fit_levels(train, levels, F.col(LABEL), slots, self.smoothing,
                                  null_level=False) if levels else None

    def transform(self, df: DataFrame, holdout: int | None = NONE) -> DataFrame:
        rows = df
        if self.encoder is not None:
            rows = self.encoder.transform(df, KEY, holdout, count="_freq", target="_te")
        have = set(df.columns)
        new: dict[str, Column] = {}
        for c in self.zero_columns:
            if c in have:
                new[f"{c}_is_zero"] = fx.zero_flag(F.col(c))
        for c in self.log_columns:
            if c in have:
                new[f"log_{c}"] = fx.log1p_floor(F.col(c))
        for c in self.cyclic_columns:
            if c in have:
                new[f"{c}_sin"], new[f"{c}_cos"] = fx.cyclic(F.col(c))
        for a, b in self.crosses:
            if a in self._targets and b in have:
                new[f"{a}_te_{b}"] = fx.product(F.col(f"{a}_te"), F.col(b))
        rows = rows.withColumns(new) if new else rows
        extra = []
        if self.history is not None:
            entity, order, flag = self.history
            rows = event_history(rows, entity, order, KEY, F.col(flag) == 1)
            extra = ["cum_count", "since_last"]
            if self.history_cross:
                rows = rows.withColumn(
                    f"cum_{self.history_cross}",
                    fx.product(F.col("cum_count"), F.col(self.history_cross)))
                extra.append(f"cum_{self.history_cross}")
        return rows.select(*reserved(df), *self.base,
                           *[f"{c}_freq" for c in self._counts], *new,
                           *[f"{c}_te" for c in self._targets], *extra)
