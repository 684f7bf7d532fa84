"""Schema operators, framing, labels and guards."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldmark.functions.kinds import categorical_columns, numeric_columns
from foldmark.functions.labels import decode_binary, decode_probabilities, label_index
from foldmark.operators import eda, framing
from foldmark.plans import fixtures as fx
from foldmark.plans.catalog.base import query, union_sql
from foldmark.sources.tables import read_table

_COLUMNS = ["order_id", "acctbal", "order_year", "segment", "nation", "priority", "price",
            "status", "y", "fold", "big", "day"]
_TYPED = fx.ORDERS + """, typed AS (
  SELECT b.*, b.price > 250000 AS big, o.o_orderdate AS day
  FROM orders_base b JOIN orders o ON b.order_id = o.o_orderkey)"""


def _typed(spark, folder):
    days = read_table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("order_id"), F.col("o_orderdate").alias("day"))
    return (fx.orders_base(spark, folder).withColumn("big", F.col("price") > 250000)
            .join(days, "order_id").select(*_COLUMNS))


def _kind_sql(where: str = "true") -> str:
    parts = [f"""SELECT '{c}' AS "column", CASE
      WHEN typeof(any_value({c})) = 'BOOLEAN' THEN 'bool'
      WHEN typeof(any_value({c})) = 'VARCHAR' THEN 'categorical'
      WHEN typeof(any_value({c})) IN ('DOUBLE', 'FLOAT') THEN 'float'
      WHEN typeof(any_value({c})) LIKE 'TIMESTAMP%' THEN 'datetime'
      ELSE 'integer' END AS kind, count({c}) AS n_values FROM typed""" for c in _COLUMNS]
    return f"WITH {_TYPED} SELECT * FROM ({union_sql(parts)}) WHERE {where}"


@query("kind", _kind_sql())
def kind(spark, folder):
    return eda.kind_table(_typed(spark, folder))


@query("cat_features", _kind_sql("kind IN ('categorical', 'bool')"))
def cat_features(spark, folder):
    rows = _typed(spark, folder)
    return eda.kind_table(rows.select(*categorical_columns(rows)))


@query("numeric_columns", _kind_sql("kind IN ('integer', 'float')"))
def numeric(spark, folder):
    rows = _typed(spark, folder)
    return eda.kind_table(rows.select(*numeric_columns(rows)))


_SPLIT = f"""{fx.ORDERS}, split AS (
  SELECT *, {fx.sql_number('order_id').replace('42|', '7|')} / 4294967296.0 < 0.8 AS is_train
  FROM orders_base)"""


@query("guess_target", f"""WITH {_SPLIT}
SELECT 'y' AS target, count(y) AS n_values, CAST(sum(y) AS BIGINT) AS total
FROM split WHERE is_train""")
def guess_target(spark, folder):
    spec = fx.order_spec(spark, folder)
    name = framing.guess_target(spec.train, spec.test, spec.task_text)
    return spec.train.agg(F.lit(name).alias("target"), F.count(name).alias("n_values"),
                          F.sum(name).alias("total"))


@query("guess_id", f"""WITH {_SPLIT}
SELECT 'order_id' AS id, count(*) FILTER (is_train) = count(DISTINCT order_id) FILTER (is_train)
  AND count(*) FILTER (NOT is_train) = count(DISTINCT order_id) FILTER (NOT is_train) AS is_id
FROM split UNION ALL
SELECT 'segment', count(*) FILTER (is_train) = count(DISTINCT segment) FILTER (is_train)
  AND count(*) FILTER (NOT is_train) = count(DISTINCT segment) FILTER (NOT is_train) FROM split""")
def guess_id(spark, folder):
    spec = fx.order_spec(spark, folder)
    found = framing.guess_id(spec.train, spec.test)
    return spark.createDataFrame([(c, c == found) for c in ("order_id", "segment")],
                                 "id string, is_id boolean")


def _problem_sql(target: str) -> str:
    y = f"CAST({target} AS VARCHAR)"
    return f"""SELECT '{target}' AS target, CASE
      WHEN NOT broken AND k = 2 THEN 'binary'
      WHEN NOT broken AND (text OR (k <= greatest(20, floor(0.05 * n)) AND k <= 50)) THEN 'multiclass'
      ELSE 'regression' END AS problem_type,
      CASE WHEN NOT broken AND (k = 2 OR text OR (k <= greatest(20, floor(0.05 * n)) AND k <= 50))
      THEN k ELSE 1 END AS n_classes,
      CASE WHEN NOT broken AND (k = 2 OR text OR (k <= greatest(20, floor(0.05 * n)) AND k <= 50))
      THEN labels ELSE '' END AS labels
      FROM (SELECT count({target}) AS n, count(DISTINCT {target}) AS k,
        typeof(any_value({target})) = 'VARCHAR' AS text,
        CASE WHEN typeof(any_value({target})) = 'DOUBLE'
             THEN bool_or(abs(TRY_CAST({target} AS DOUBLE) - round(TRY_CAST({target} AS DOUBLE))) > 1e-8)
             ELSE false END AS broken,
        string_agg(DISTINCT {y}, ',' ORDER BY {y}) AS labels FROM orders_base)"""


@query("problem_type", f"WITH {fx.ORDERS} " + union_sql(
    [_problem_sql(t) for t in ("y", "status", "order_year", "price", "segment")]))
def problem_type(spark, folder):
    rows = fx.orders_base(spark, folder)
    found = []
    for t in ("y", "status", "order_year", "price", "segment"):
        kind_, k, labels = framing.problem_type(rows, t)
        found.append((t, kind_, k, ",".join(str(v) for v in labels or [])))
    return spark.createDataFrame(
        found, "target string, problem_type string, n_classes bigint, labels string")


_SUMMARY = f"""WITH {_SPLIT}
SELECT 'binary' AS problem_type, 2 AS n_classes, 'y' AS target, 'order_id' AS id,
       count(*) FILTER (is_train) AS n_train, count(*) FILTER (NOT is_train) AS n_test,
       5 AS n_features FROM split"""


@query("build_spec", _SUMMARY)
def build_spec(spark, folder):
    return fx.order_spec(spark, folder).summary()


@query("spec_summary", f"""WITH {_SPLIT}
SELECT 'regression' AS problem_type, 1 AS n_classes, 'price' AS target, 'order_id' AS id,
       count(*) FILTER (is_train) AS n_train, count(*) FILTER (NOT is_train) AS n_test,
       5 AS n_features FROM split""")
def spec_summary(spark, folder):
    return fx.order_spec(spark, folder, "price", "target: price").summary()


@query("drop_cols", f"WITH {fx.ORDERS} SELECT acctbal, order_year, segment, nation, priority, "
                    "price, status FROM orders_base")
def drop_cols(spark, folder):
    return fx.orders_base(spark, folder).drop("order_id", "y", "fold", "not_there")


@query("select_features", f"WITH {fx.ORDERS} SELECT nation, acctbal, order_year FROM orders_base")
def select_features(spark, folder):
    return fx.orders_base(spark, folder).select("nation", "acctbal", "order_year")


@query("label_index", f"""WITH {fx.ORDERS}, places AS (
  SELECT status, CAST(row_number() OVER (ORDER BY status) - 1 AS DOUBLE) AS label
  FROM (SELECT DISTINCT status FROM orders_base))
SELECT order_id, status, label FROM orders_base JOIN places USING (status)""")
def label(spark, folder):
    rows = fx.orders_base(spark, folder)
    labels = framing.problem_type(rows, "status")[2]
    return rows.select("order_id", "status", label_index(F.col("status"), labels).alias("label"))


@query("label_decode", f"""WITH {fx.CLASSED}
SELECT truth, CASE WHEN p0 >= p1 AND p0 >= p2 THEN 'A' WHEN p1 >= p2 THEN 'N' ELSE 'R' END AS best,
       CASE WHEN p0 >= 0.5 THEN 'yes' ELSE 'no' END AS half FROM classed""")
def label_decode(spark, folder):
    rows = fx.classed(spark, folder)
    return rows.select("truth", decode_probabilities(F.col("probs"), ["A", "N", "R"]).alias("best"),
                       decode_binary(F.element_at("probs", 1), ["no", "yes"]).alias("half"))


# -- guards: each on a proper feature table and on one with the fault -----------------

def _outcomes(rows, cases):
    """What every case raised, beside the rows it was asked about."""
    def raised(check) -> bool:
        try:
            check()
        except ValueError:
            return True
        return False
    names = [(name, raised(check)) for name, check in cases]
    return rows.agg(F.count(F.lit(1)).alias("n_rows")).select(
        F.explode(F.array(*[F.struct(F.lit(n).alias("case_name"), F.lit(r).alias("raised"))
                            for n, r in names])).alias("s"), "n_rows").select("s.*", "n_rows")


_GUARD = f"""WITH {fx.ORDERS}
SELECT 'proper' AS case_name, false AS raised, count(*) AS n_rows FROM orders_base
UNION ALL SELECT 'faulty', true, count(*) FROM orders_base"""
_FEATURES = ["acctbal", "order_year", "segment"]


@query("guard_target_leak", _GUARD)
def guard_target_leak(spark, folder):
    rows = fx.orders_base(spark, folder)
    return _outcomes(rows, [
        ("proper", lambda: framing.guard_target(rows.select(*_FEATURES), "y")),
        ("faulty", lambda: framing.guard_target(rows.select(*_FEATURES, "y"), "y"))])


@query("guard_id", _GUARD)
def guard_id(spark, folder):
    rows = fx.orders_base(spark, folder)
    return _outcomes(rows, [
        ("proper", lambda: framing.guard_id(rows.select(*_FEATURES), "order_id")),
        ("faulty", lambda: framing.guard_id(rows.select("order_id"), "order_id"))])


@query("guard_columns_equal", _GUARD)
def guard_columns_equal(spark, folder):
    rows = fx.orders_base(spark, folder).select(*_FEATURES)
    return _outcomes(rows, [
        ("proper", lambda: framing.guard_same_columns(rows, rows)),
        ("faulty", lambda: framing.guard_same_columns(rows, rows.select(*_FEATURES[::-1])))])


@query("guard_nonempty", _GUARD)
def guard_nonempty(spark, folder):
    rows = fx.orders_base(spark, folder)
    return _outcomes(rows, [
        ("proper", lambda: framing.guard_nonempty(rows.select(*_FEATURES))),
        ("faulty", lambda: framing.guard_nonempty(rows.select()))])


@query("guard_all_null", f"""WITH {fx.DOCS}
SELECT 'n_chars' AS "column", count(n_chars) AS n_values, count(n_chars) = 0 AS all_null FROM docs
UNION ALL SELECT 'quality', count(quality), count(quality) = 0 FROM docs
UNION ALL SELECT 'tiny', count(CASE WHEN n_chars < 0 THEN 1 END),
       count(CASE WHEN n_chars < 0 THEN 1 END) = 0 FROM docs""")
def guard_all_null(spark, folder):
    rows = fx.docs(spark, folder).select(
        "n_chars", "quality", F.when(F.col("n_chars") < 0, 1).alias("tiny"))
    return framing.all_null_columns(rows)
