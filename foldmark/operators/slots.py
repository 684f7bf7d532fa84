"""Which rows a fitted value was learned from.

With ``folds`` folds there are ``folds + 1`` slots: slot k leaves fold k out,
the last slot uses all rows.  Counts and sums of a slot are total minus own.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F


@dataclass(frozen=True)
class Slots:
    fold: str | None = None     # fold column, none for a plain fit
    folds: int = 0

    @property
    def count(self) -> int:
        return self.folds + 1

    def own(self, slot: int) -> Column:
        """True for rows that the slot leaves out."""
        if slot == self.folds or self.fold is None:
            return F.lit(False)
        return F.col(self.fold) == slot

    def less_own(self, total: Column, own: list[Column]) -> Column:
        return F.array(*[total - o for o in own], total)

    def pick(self, values: Column, holdout: int | None) -> Column:
        """The value for a row: of one holdout, of the row's own fold
        (``holdout=-1``), or learned from all rows (``None``)."""
        if holdout is None:
            return F.element_at(values, self.count)
        if holdout >= 0:
            return F.element_at(values, holdout + 1)
        return F.element_at(values, F.col(self.fold).cast("int") + 1)
