from pyspark.sql import functions as F

from foldmark.plans import evaluation
from foldmark.plans.contract import FOLD, KEY, LABEL


class Same:
    def transform(self, df, holdout):
        return df


def test_labels_of_several_folds_are_joined_in_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(evaluation, "ROWS_PER_JOIN", 500)
    rows = spark.range(6000).select(F.col("id").alias(KEY), (F.col("id") % 3).alias(FOLD),
                                    (F.col("id") * 2).alias(LABEL), F.lit(1).alias("x"))
    pieces = evaluation.join_pieces(rows)
    assert pieces == 12
    made = [evaluation.labelled_features(Same(), rows.filter(F.col(FOLD) != k), None, pieces) for k in range(3)]
    both = made[0].unionByName(made[1]).unionByName(made[2])
    sizes = [r["count"] for r in both.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 36 and max(sizes) < 600
    assert both.filter(F.col(LABEL) == F.col(KEY) * 2).count() == 12000
