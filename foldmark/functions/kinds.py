"""Column kinds, decided from the schema alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, types as T


def kind_of(dtype: T.DataType) -> str:
    if isinstance(dtype, T.BooleanType):
        return "bool"
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "datetime"
    if isinstance(dtype, T.IntegralType):
        return "integer"
    if isinstance(dtype, T.NumericType):
        return "float"
    if isinstance(dtype, T.StringType):
        return "categorical"
    raise TypeError(f"no kind for {dtype.simpleString()}; cast or drop the column")


def kinds(df: DataFrame) -> dict[str, str]:
    return {f.name: kind_of(f.dataType) for f in df.schema.fields}


def numeric_columns(df: DataFrame) -> list[str]:
    return [c for c, k in kinds(df).items() if k in ("integer", "float")]


def categorical_columns(df: DataFrame) -> list[str]:
    """What the model treats as categories: text and booleans."""
    return [c for c, k in kinds(df).items() if k in ("categorical", "bool")]


def non_numeric_columns(df: DataFrame) -> list[str]:
    """The complement of the numeric columns, as the encoders use it."""
    numeric = set(numeric_columns(df))
    return [c for c in df.columns if c not in numeric]
