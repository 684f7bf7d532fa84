"""Class labels to positions and back."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def label_index(y: Column, labels: list) -> Column:
    """Position of a class in the sorted label list, as a double."""
    place = F.array_position(F.array(*[F.lit(v) for v in labels]), y)
    return F.when(place > 0, (place - 1).cast("double"))


def decode_probabilities(probs: Column, labels: list) -> Column:
    """Label of the largest probability, the first one on ties."""
    best = F.array_position(probs, F.array_max(probs)).cast("int")
    return F.element_at(F.array(*[F.lit(v) for v in labels]), best)


def decode_binary(p: Column, labels: list) -> Column:
    return F.when(p >= 0.5, F.lit(labels[1])).otherwise(F.lit(labels[0]))
