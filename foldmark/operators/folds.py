"""Fold columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from foldmark.constants import CV_FOLDS, SEED
from foldmark.functions.hashing import hash_fold, seeded_md5
from foldmark.operators.lookup import LevelTable, lookup
from foldmark.operators.ranks import with_counts
from foldmark.session import materialize


def kfold(df: DataFrame, key: str, folds: int = CV_FOLDS, seed: int = SEED,
          name: str = "fold") -> DataFrame:
    """Fold from the hash of a key: a projection, no shuffle."""
    return df.withColumn(name, hash_fold(F.col(key), folds, seed))


def stratified_kfold(df: DataFrame, key: str, y: str, folds: int = CV_FOLDS,
                     seed: int = SEED, name: str = "fold",
                     prefix: int = 3) -> DataFrame:
    """Folds whose sizes differ by at most one within every class.

    The rank of a row among its class, in hash order, modulo ``folds``.  The
    rank is counted inside buckets of the hash (``prefix`` hex digits, so
    evenly filled whatever the data) and moved up by the size of the buckets
    before, so no task ever orders a whole class.
    """
    hashed = (df.withColumn("_md5", seeded_md5(F.col(key), seed))
              .withColumn("_bucket", F.substring("_md5", 1, prefix))
              .withColumn("_class", F.coalesce(F.col(y).cast("string"), F.lit("\0"))))
    counts = (hashed.groupBy("_class", "_bucket").agg(F.count(F.lit(1)).alias("n"))
              .withColumn("before", F.coalesce(F.sum("n").over(
                  W.partitionBy("_class").orderBy("_bucket")
                  .rowsBetween(W.unboundedPreceding, -1)), F.lit(0))))
    counts = materialize(counts)
    size = counts.agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("total")).first()
    offsets = LevelTable(counts, ("_class", "_bucket"), size["rows"], size["total"] or 0)
    order = W.partitionBy("_class", "_bucket").orderBy("_md5", key)
    ranked = hashed.withColumn("_rank", F.row_number().over(order))
    placed = lookup(ranked, offsets, [F.col("_class"), F.col("_bucket")],
                    {"before": "_before"}, F.col(key))
    fold = F.pmod(F.col("_before") + F.col("_rank") - 1, F.lit(folds)).cast("int")
    return (placed.withColumn(name, fold)
            .drop("_md5", "_bucket", "_class", "_rank", "_before"))


# A group above this share of a fold is placed by itself, so their number is bounded.
BIG_SHARE = 0.001


def group_kfold(df: DataFrame, group: str, key: str, folds: int = CV_FOLDS, seed: int = SEED,
                name: str = "fold", prefix: int = 3) -> DataFrame:
    """Folds of about equal size that keep every group together.

    Groups with more than a thousandth of a fold are packed, the largest
    first, into the fold with least rows.  The others, in the order of the hash
    of their name, fill what is left of each fold: their sizes are summed up
    inside buckets of the hash and moved up by the buckets before, so no task
    orders all groups.  A row without a group is a group of its own.
    """
    named = F.when(F.col(group).isNotNull(), F.concat(F.lit("g"), F.col(group).cast("string"))) \
        .otherwise(F.concat(F.lit("r"), F.col(key).cast("string")))
    rows = df.withColumn("_group", named)
    sizes = materialize(rows.groupBy("_group").agg(F.count(F.lit(1)).alias("n")))
    facts = sizes.agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("total"),
                      F.sum(F.octet_length("_group")).alias("bytes")).first()
    total = facts["total"] or 0
    limit = max(1, int(BIG_SHARE * total / folds))
    # fewer than folds / BIG_SHARE groups can be this large
    big = sizes.filter(F.col("n") > limit).orderBy(F.desc("n"), "_group").collect()
    load, place = [0] * folds, {}
    for r in big:
        k = load.index(min(load))
        place[r["_group"]] = k
        load[k] += r["n"]
    # ends of what the small groups may fill, along their running sum
    level = _water_level(load, total - sum(load))
    ends, at = [], 0.0
    for used in load:
        at += max(0.0, level - used)
        ends.append(at)
    small = (sizes.filter(F.col("n") <= limit).withColumn("_md5", seeded_md5(F.col("_group"), seed))
             .withColumn("_bucket", F.substring("_md5", 1, prefix)))
    before = W.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    # 16 ** prefix lines at most
    buckets = small.groupBy("_bucket").agg(F.sum("n").alias("n")).select(
        "_bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    inside = W.partitionBy("_bucket").orderBy("_md5", "_group").rowsBetween(W.unboundedPreceding, 0)
    middle = F.col("_before") + F.sum("n").over(inside) - F.col("n") / 2
    fold: Column = F.lit(folds - 1)
    for k in reversed(range(folds - 1)):
        fold = F.when(middle <= ends[k], F.lit(k)).otherwise(fold)
    dealt = small.join(F.broadcast(buckets), "_bucket").select("_group", fold.cast("int").alias("_f"))
    if place:
        dealt = dealt.unionByName(df.sparkSession.createDataFrame(
            list(place.items()), "_group string, _f int"))
    table = LevelTable(materialize(dealt), ("_group",), facts["rows"], total, facts["bytes"] or 0)
    return (lookup(rows, table, [F.col("_group")], {"_f": name}, F.col(key)).drop("_group"))


def _water_level(load: list[int], rest: int) -> float:
    """Height to which the folds are filled when ``rest`` more rows are poured in."""
    level = 0.0
    for k, used in enumerate(sorted(load), start=1):
        level = (sum(sorted(load)[:k]) + rest) / k
        if k == len(load) or level <= sorted(load)[k]:
            break
    return level


def time_blocks(df: DataFrame, time: str, folds: int = CV_FOLDS, name: str = "fold") -> DataFrame:
    """Blocks 0 to ``folds`` of about equal size that follow each other in time.

    Block k is tested after training on the blocks before it, so block 0 is
    only trained on.  Equal times share a block; rows without a time belong to
    block 0, as nothing may be known to come after them.
    """
    timed = with_counts(df.withColumn("_time", F.col(time)), "_time", [])
    n = timed.agg(F.count(F.lit(1))).first()[0]
    block = F.floor(F.col("less") * (folds + 1) / F.lit(max(n, 1))).cast("int")
    placed = timed.withColumn(name, block).select(*df.columns, name)
    return placed.unionByName(df.filter(F.col(time).isNull()).withColumn(name, F.lit(0)))
