"""What a solution has to provide, and the reserved columns around it.

The engine hides the target from ``transform``: it sees the input columns, the
key and the fold, which it must pass on untouched; the label is joined back by
the key afterwards.  Everything else it returns is a feature.

``fit`` gets the target.  In cross-validation an ordinary solution is fitted
once per fold, on the rows of the other folds alone.  A class that declares
``slot_aware = True`` itself is fitted once on all rows and learns a slot per
fold; ``holdout`` then says whose statistics a call may use.  The declaration
is not inherited: a subclass that changes ``fit`` has to make it again.
"""

from __future__ import annotations

from abc import ABC, abstractmethod

from pyspark.sql import Column, DataFrame, functions as F

from foldmark.operators.slots import Slots
from foldmark.operators.framing import ProblemSpec

KEY, FOLD, LABEL = "_key", "_fold", "_label"
RESERVED = (KEY, FOLD, LABEL)

# holdout values: the row's own fold, or no row left out
OWN_FOLD, NONE = -1, None


class Solution(ABC):
    """Base class of feature recipes; postprocessing defaults to identity."""

    slot_aware = False

    @abstractmethod
    def fit(self, train: DataFrame, spec: ProblemSpec, slots: Slots) -> None:
        """Learn all statistics, per slot, from input and LABEL columns."""

    @abstractmethod
    def transform(self, df: DataFrame, holdout: int | None = NONE) -> DataFrame:
        """Feature columns beside the reserved ones."""

    def postprocess(self, pred: Column, holdout: int | None = NONE) -> Column:
        return pred


def keeps_slots(solution: Solution) -> bool:
    """Whether the solution's own class says that it learns per slot."""
    return bool(vars(type(solution)).get("slot_aware", False))


def feature_names(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in RESERVED]


def features_only(df: DataFrame) -> DataFrame:
    return df.drop(*RESERVED)


def reserved(df: DataFrame) -> list[Column]:
    return [F.col(c) for c in RESERVED if c in df.columns]
