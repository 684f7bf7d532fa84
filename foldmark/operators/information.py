"""Mutual information from joint counts, in nats.

With counts n_xy, n_x, n_y over n rows,

    I(X;Y) = ln n + (sum n_xy ln n_xy - sum n_x ln n_x - sum n_y ln n_y) / n

so three grouped sums are enough; no marginal is ever joined back, and hot
levels are combined before any shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from foldmark.constants import (
    CLASS_LIMIT, CLASS_SHARE, INTERACTION_CLASS_LIMIT, INTERACTION_COLUMNS,
    INTERACTION_PAIRS, RELATION_TOP,
)
from foldmark.functions.features import product, ratio
from foldmark.functions.kinds import kinds
from foldmark.operators.quantiles import cut_points, exact_quantiles, with_bins
from foldmark.operators.unpivot import long_values

BINS = 32


def _n_log_n(n: Column) -> Column:
    return n * F.ln(n.cast("double"))


def mutual_information(df: DataFrame, features: list[str], y: str) -> DataFrame:
    """``(column, n, mutual_info)`` of discrete columns with a discrete y.

    Null is a level of its own on both sides, as grouping has it.
    """
    same = len({df.schema[c].dataType for c in features}) == 1
    pairs = (df.select(F.col(y).alias("_y"), *features)
             .unpivot(["_y"], features, "column", "value") if same
             else long_values(df, features, keep={"_y": F.col(y)}))
    joint = pairs.groupBy("column", "value", "_y").agg(F.count(F.lit(1)).alias("n"))
    by_value = (joint.groupBy("column", "value")
                .agg(F.sum("n").alias("nx"), F.sum(_n_log_n(F.col("n"))).alias("sxy")))
    by_column = (by_value.groupBy("column")
                 .agg(F.sum("nx").alias("n"), F.sum("sxy").alias("sxy"),
                      F.sum(_n_log_n(F.col("nx"))).alias("sx")))
    by_target = (df.groupBy(F.col(y).alias("_y")).agg(F.count(F.lit(1)).alias("ny"))
                 .agg(F.sum(_n_log_n(F.col("ny"))).alias("sy")))
    value = (F.ln(F.col("n").cast("double"))
             + (F.col("sxy") - F.col("sx") - by_target.scalar()) / F.col("n"))
    return by_column.select("column", "n", F.greatest(value, F.lit(0.0)).alias("mutual_info"))


def is_classification(df: DataFrame, target: str, share: float = CLASS_SHARE,
                      limit: int = CLASS_LIMIT) -> bool:
    """Text target, or few enough distinct values."""
    if isinstance(df.schema[target].dataType, T.StringType):
        return True
    facts = (df.groupBy(target).agg(F.count(F.lit(1)).alias("n"))
             .agg(F.sum("n").alias("n"), F.count(target).alias("levels")).first())
    return facts["levels"] <= max(limit, int(share * (facts["n"] or 0)))


def discrete(df: DataFrame, columns: list[str], bins: int = BINS,
             also: list[str] = ()) -> DataFrame:
    """Columns as levels, beside untouched others.

    Floats, dates and times, and any further column named in ``also``, are cut
    into equal-frequency bins after filling nulls with the median; other
    columns stay as they are.
    """
    kind = kinds(df)
    dates = [c for c in [*columns, *also] if kind[c] == "datetime"]
    if dates:
        df = df.withColumns({c: F.unix_micros(F.col(c).cast("timestamp")).cast("double") for c in dates})
    floats = [c for c in [*columns, *also] if kind[c] in ("float", "datetime") or c in also]
    gaps = df.agg(*[F.count_if(F.col(c).isNull()).alias(f"{i}")
                    for i, c in enumerate(floats)]).first() if floats else []
    holed = {c: F.col(c) for c, n in zip(floats, gaps) if n}
    medians = exact_quantiles(df, holed, [0.5])
    filled = df.withColumns({c: F.coalesce(x.cast("double"), F.lit(medians[c][0]))
                             for c, x in holed.items()}) if holed else df
    cuts = cut_points(filled, {c: F.col(c) for c in floats}, bins)
    return with_bins(filled, {c: (F.col(c), cuts[c]) for c in floats})


def target_relation(df: DataFrame, target: str, top: int = RELATION_TOP,
                    bins: int = BINS, columns: list[str] | None = None) -> DataFrame:
    """The features that tell most about the target.

    Continuous columns use equal-frequency bins, an estimator that differs
    from a nearest-neighbour one in value but needs only counts.
    """
    columns = columns or [c for c in df.columns if c != target]
    classify = is_classification(df, target)
    table = discrete(df.select(target, *columns), columns, bins, [] if classify else [target])
    features = [c for c in columns if c in table.columns]
    scored = mutual_information(table, features, target)
    return scored.select("column", "mutual_info").orderBy(
        F.desc("mutual_info"), "column").limit(top)


def interaction_pairs(df: DataFrame, columns: list[str], max_pairs: int = INTERACTION_PAIRS,
                      max_columns: int = INTERACTION_COLUMNS) -> list[tuple[str, str]]:
    kind = kinds(df.select(*columns))
    nums = [c for c in columns if kind[c] in ("integer", "float")][:max_columns]
    pairs = [(a, b) for i, a in enumerate(nums) for b in nums[i + 1:]]
    return pairs[:max_pairs]


def interaction_scan(df: DataFrame, target: str, columns: list[str],
                     max_pairs: int = INTERACTION_PAIRS, bins: int = BINS,
                     max_columns: int = INTERACTION_COLUMNS) -> DataFrame:
    """Products and ratios of numeric pairs, by information on the target."""
    classify = is_classification(df, target, share=0.0, limit=INTERACTION_CLASS_LIMIT)
    exprs: dict[str, Column] = {}
    for a, b in interaction_pairs(df, columns, max_pairs, max_columns):
        zero = F.lit(0.0)
        exprs[f"{a}*{b}"] = product(F.coalesce(F.col(a).cast("double"), zero),
                                    F.coalesce(F.col(b).cast("double"), zero))
        exprs[f"{a}/{b}"] = F.coalesce(ratio(F.col(a), F.col(b)), zero)
    places = {f"_p{i}": name for i, name in enumerate(exprs)}
    wide = df.select(F.col(target).alias("_y"),
                     *[exprs[name].alias(p) for p, name in places.items()])
    table = discrete(wide, list(places), bins, [] if classify else ["_y"])
    named = F.element_at(F.create_map(*[F.lit(x) for p in places.items() for x in p]),
                         F.col("column"))
    return (mutual_information(table, list(places), "_y")
            .select(named.alias("pair"), F.col("mutual_info").alias("mi"))
            .orderBy(F.desc("mi"), "pair"))
