"""Seeded hash of a key, identical in any engine that has md5."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from foldmark.constants import SEED


def seeded_md5(key: Column, seed: int = SEED) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string")).cast("binary"))


def hash_number(key: Column, seed: int = SEED) -> Column:
    """First 32 bits of the seeded md5 as a bigint."""
    return F.conv(F.substring(seeded_md5(key, seed), 1, 8), 16, 10).cast("bigint")


def hash_unit(key: Column, seed: int = SEED) -> Column:
    """Uniform value in [0, 1)."""
    return hash_number(key, seed) / F.lit(4294967296.0)


def hash_fold(key: Column, folds: int, seed: int = SEED) -> Column:
    return F.pmod(hash_number(key, seed), F.lit(folds)).cast("int")
