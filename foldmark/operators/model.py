"""The frozen model: boosted trees on numbers, dates and categories of any width."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from foldmark.functions.features import null_token
from foldmark.functions.kinds import categorical_columns
from foldmark.operators.boosting import Boosted, ModelParams, boosted, predicted
from foldmark.operators.ordered import OrderedStatistics, fit_ordered, piece_of
from foldmark.session import discard, stored

__all__ = ["FittedModel", "ModelParams", "fit_model", "fit_models", "prepare"]


def as_double(df: DataFrame, column: str) -> Column:
    """Numbers as they are, dates and times as microseconds."""
    dtype, x = df.schema[column].dataType, F.col(f"`{column}`")
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        x = F.unix_micros(x.cast("timestamp"))
    return x.cast("double")


@dataclass(frozen=True)
class FittedModel:
    """Features are the numeric columns, then the categories."""

    boosted: Boosted
    numbers: list[str]
    categories: OrderedStatistics | None
    problem_type: str

    @property
    def features(self) -> list[str]:
        return [*self.numbers, *(self.categories.columns if self.categories else [])]

    @property
    def n_trees(self) -> int:
        return len(self.boosted.trees)

    @property
    def n_leaves(self) -> int:
        return sum(len(t.values) for t in self.boosted.trees)

    def inputs(self, df: DataFrame) -> list[Column]:
        made = [n for c in self.categories.columns for n in self.categories.names(c)] \
            if self.categories else []
        return [*[as_double(df, c) for c in self.numbers], *[F.col(c) for c in made]]

    def predict(self, df: DataFrame, name: str = "pred") -> DataFrame:
        """Value, probability of class 1, or array of class probabilities."""
        rows = df if self.categories is None else self.categories.transform(
            df, F.xxhash64(*[F.col(f"`{c}`") for c in self.features]))
        return rows.select(*[F.col(f"`{c}`") for c in df.columns if c != name], predicted(
            self.boosted, self.inputs(rows), self.problem_type).alias(name))

    def importance(self, spark: SparkSession) -> DataFrame:
        """``(feature, importance)``: shares of the gain; the list is as long as the schema."""
        shares = self.boosted.gains().tolist()
        each = dict(zip(self.numbers, shares))
        if self.categories:
            k, at = self.categories.outputs, len(self.numbers)
            for i, c in enumerate(self.categories.columns):
                each[c] = sum(shares[at + i * k:at + (i + 1) * k])
        return spark.createDataFrame(list(each.items()), "feature string, importance double")


def prepare(df: DataFrame) -> DataFrame:
    """Categories as text with a token for null; the originals kept aside."""
    texts = categorical_columns(df)
    if not texts:
        return df
    return (df.withColumn("_in", F.struct(*[F.col(f"`{c}`") for c in texts]))
            .withColumns({c: null_token(F.col(f"`{c}`")) for c in texts}))


def fit_models(parts: dict[int, tuple[DataFrame, DataFrame | None]], features: list[str], label: str,
               problem_type: str, params: ModelParams = ModelParams(),
               n_classes: int | None = None, key: str | None = None) -> dict[int, FittedModel]:
    """A model for each part, boosted in step.

    A part is the rows to learn from and, perhaps, rows held out to decide how
    many rounds count.  Categories of any number of levels become ordered
    target statistics, learnt from the part's own rows in the order of the
    hash of ``key`` (without one, of the features).  Rows without a label are
    left out.
    """
    if not features:
        raise ValueError("no feature columns")
    tables = None
    for p, sides in parts.items():
        for rows, held in zip(sides, (False, True)):
            if rows is not None:
                one = rows.select(
                    F.lit(p).alias("_part"), F.lit(held).alias("_held"),
                    F.col(f"`{label}`").cast("double").alias("_y"),
                    F.xxhash64(*[F.col(f"`{c}`") for c in ([key] if key else features)]).alias("_hash"),
                    *[F.col(f"`{c}`") for c in features]).filter("_y IS NOT NULL")
                tables = one if tables is None else tables.unionByName(one)
    inputs = tables.select(*[F.col(f"`{c}`") for c in features])
    texts = categorical_columns(inputs)
    numbers = [c for c in features if c not in texts]
    outputs = 1
    if problem_type == "multiclass":
        outputs = n_classes or int(tables.agg(F.max("_y")).first()[0] or 0) + 1
    made, stats = [as_double(inputs, c) for c in numbers], None
    if texts:
        piece = piece_of([F.col("_hash")])
        stats = fit_ordered(tables.filter("NOT _held"), texts, F.col("_y"), piece, outputs,
                            part=F.col("_part"))
        tables = stats.transform(tables, F.col("_hash"), F.when(~F.col("_held"), piece), F.col("_part"))
        made += [F.col(n) for c in texts for n in stats.names(c)]
    width = len(made)
    tables = tables.select(
        F.col("_part").alias("part"), F.col("_held").alias("held"), F.col("_y").alias("y"),
        F.col("_hash").alias("key"), *[x.alias(f"x{j}") for j, x in enumerate(made)])
    table, path = stored(tables, "model-rows")
    grown = boosted(table, width, problem_type, outputs, params)
    discard(table.sparkSession, path)
    return {p: FittedModel(grown[p], numbers, stats and stats.only(p), problem_type) for p in parts}


def fit_model(df: DataFrame, features: list[str], label: str, problem_type: str,
              params: ModelParams = ModelParams(), holdout: DataFrame | None = None,
              n_classes: int | None = None, key: str | None = None) -> FittedModel:
    """One model; with a ``holdout``, its rounds up to the one of least loss there."""
    return fit_models({0: (df, holdout)}, features, label, problem_type, params, n_classes, key)[0]
