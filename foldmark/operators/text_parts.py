"""Date parts and composite ids hidden in text columns.

What a column holds is decided by votes: every candidate is tried on every
value and the counts of all rows decide, in one pass.  A column is read as a
date or as a composite only where nearly all of its values agree; the others
give nulls.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

# Day and month both fit "01/02/2024"; the count of values that fit decides,
# and the earlier entry on a draw.
FORMATS = ("yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy/MM/dd", "yyyyMMdd",
           "dd.MM.yyyy", "MM/dd/yyyy", "dd/MM/yyyy", "dd-MM-yyyy")
SEPARATORS = ("-", "_", "/", ":", ".", "|", "#")
AGREEMENT = 0.95
PARTS = 8           # a composite has from two to this many parts

DATE_PARTS = {"year": F.year, "month": F.month, "day": F.dayofmonth, "weekday": F.weekday,
              "yearday": F.dayofyear, "hour": F.hour}


def _parsed(text: Column, form: str) -> Column:
    """The time, if the value has exactly this form."""
    at = F.try_to_timestamp(F.trim(text), F.lit(form))
    return F.when(F.date_format(at, form) == F.trim(text), at)


def date_formats(df: DataFrame, columns: list[str], agreement: float = AGREEMENT) -> dict[str, str | None]:
    """The date format of each text column, none where too few values agree."""
    if not columns:
        return {}
    votes = df.agg(*[F.count(F.col(f"`{c}`")).alias(f"n{i}") for i, c in enumerate(columns)],
                   *[F.count(_parsed(F.col(f"`{c}`"), f)).alias(f"v{i}_{j}")
                     for i, c in enumerate(columns) for j, f in enumerate(FORMATS)]).first()
    out = {}
    for i, c in enumerate(columns):
        best = max(range(len(FORMATS)), key=lambda j: (votes[f"v{i}_{j}"], -j))
        enough = votes[f"n{i}"] and votes[f"v{i}_{best}"] >= agreement * votes[f"n{i}"]
        out[c] = FORMATS[best] if enough else None
    return out


def with_date_parts(df: DataFrame, formats: dict[str, str | None]) -> DataFrame:
    """Add ``<column>_<part>`` for every column with a format."""
    new = {}
    for c, form in formats.items():
        if form is not None:
            at = _parsed(F.col(f"`{c}`"), form)
            new |= {f"{c}_{part}": fn(at) for part, fn in DATE_PARTS.items()}
    return df.withColumns(new) if new else df


@dataclass(frozen=True)
class Composite:
    separator: str
    parts: int
    numeric: tuple[bool, ...]


def _pieces(text: Column, separator: str) -> Column:
    return F.split(text, f"\\Q{separator}\\E")


def composites(df: DataFrame, columns: list[str], agreement: float = AGREEMENT) -> dict[str, Composite | None]:
    """How each text column is put together, none where too few values agree.

    One pass counts, for every separator, how many values have each number of
    parts; a second one asks which parts are numbers throughout.
    """
    if not columns:
        return {}
    votes = df.agg(*[F.count(F.col(f"`{c}`")).alias(f"n{i}") for i, c in enumerate(columns)],
                   *[F.count_if(F.size(_pieces(F.col(f"`{c}`"), s)) == k).alias(f"v{i}_{j}_{k}")
                     for i, c in enumerate(columns) for j, s in enumerate(SEPARATORS)
                     for k in range(2, PARTS + 1)]).first()
    found: dict[str, tuple[str, int] | None] = {}
    for i, c in enumerate(columns):
        n, j, k = max((votes[f"v{i}_{j}_{k}"], -j, k) for j in range(len(SEPARATORS)) for k in range(2, PARTS + 1))
        found[c] = (SEPARATORS[-j], k) if votes[f"n{i}"] and n >= agreement * votes[f"n{i}"] else None
    split = {c: f for c, f in found.items() if f is not None}
    if not split:
        return dict.fromkeys(columns)
    checks = [(c, p) for c, (_, k) in split.items() for p in range(k)]
    facts = df.agg(*[F.count_if(_part(c, split[c], p).isNotNull() & _part(c, split[c], p).try_cast("double").isNull())
                     .alias(f"b{q}") for q, (c, p) in enumerate(checks)]).first()
    numeric = {at: facts[f"b{q}"] == 0 for q, at in enumerate(checks)}
    return {c: None if found[c] is None else Composite(
        *found[c], tuple(numeric[c, p] for p in range(found[c][1]))) for c in columns}


def _part(column: str, form: tuple[str, int], place: int) -> Column:
    cut = _pieces(F.col(f"`{column}`"), form[0])
    return F.when(F.size(cut) == form[1], cut[place])


def with_composite_parts(df: DataFrame, forms: dict[str, Composite | None]) -> DataFrame:
    """Add ``<column>_part<i>``: numbers where a part is numeric throughout."""
    new = {}
    for c, form in forms.items():
        for p in range(form.parts if form else 0):
            part = _part(c, (form.separator, form.parts), p)
            new[f"{c}_part{p}"] = part.try_cast("double") if form.numeric[p] else part
    return df.withColumns(new) if new else df
