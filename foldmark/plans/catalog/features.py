"""Scalar features and recipes."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldmark.functions import features as fn
from foldmark.functions.hashing import hash_fold
from foldmark.operators import encode, text_parts
from foldmark.operators.slots import Slots
from foldmark.operators.framing import ProblemSpec
from foldmark.plans import fixtures as fx
from foldmark.plans.catalog.base import query, rounded
from foldmark.plans.contract import FOLD, KEY, LABEL, OWN_FOLD
from foldmark.plans.recipes import Curriculum, RecordedFeatures
from foldmark.sources.tables import read_table

KEYS = ["order_id"]


def _orders(select: str) -> str:
    return f"WITH {fx.ORDERS} SELECT order_id, {select} FROM orders_base"


@query("f_isna", _orders("CAST(acctbal IS NULL AS INTEGER) AS acctbal__isna, "
                         "CAST(priority IS NULL AS INTEGER) AS priority__isna"))
def f_isna(spark, folder):
    return fx.orders_base(spark, folder).select(
        *KEYS, fn.is_missing(F.col("acctbal")).alias("acctbal__isna"),
        fn.is_missing(F.col("priority")).alias("priority__isna"))


@query("f_impute", _orders("round(coalesce(acctbal, (SELECT median(acctbal) FROM orders_base)), 6) AS acctbal"))
def f_impute(spark, folder):
    rows = fx.orders_base(spark, folder)
    median = encode.fit_medians(rows, ["acctbal"])["acctbal"][-1]
    return rounded(rows.select(*KEYS, fn.impute(F.col("acctbal"), median).alias("acctbal")))


@query("f_log1p", _orders("round(CASE WHEN acctbal IS NOT NULL THEN ln(1 + greatest(acctbal - 2000, 0)) END, 6) "
                          "AS acctbal__log1p"))
def f_log1p(spark, folder):
    return rounded(fx.orders_base(spark, folder).select(
        *KEYS, fn.log1p_floor(F.col("acctbal") - 2000).alias("acctbal__log1p")))


@query("f_nulltoken", _orders("coalesce(priority, '__nan__') AS priority"))
def f_nulltoken(spark, folder):
    return fx.orders_base(spark, folder).select(*KEYS, fn.null_token(F.col("priority")).alias("priority"))


@query("f_freq", f"""WITH {fx.ORDERS}, t AS (SELECT * FROM orders_base WHERE order_year < 2000),
m AS (SELECT coalesce(priority, '__nan__') AS lv, count(*) / (SELECT count(*) FROM t) AS f FROM t GROUP BY 1)
SELECT order_id, round(coalesce(f, 0), 6) AS priority__freq
FROM orders_base LEFT JOIN m ON coalesce(priority, '__nan__') = lv""")
def f_freq(spark, folder):
    rows = fx.orders_base(spark, folder)
    encoder = encode.fit_levels(rows.filter("order_year < 2000"), ["priority"])
    return rounded(encoder.transform(rows, "order_id", frequency="__freq")
                   .select(*KEYS, "priority__freq"))


@query("f_te", f"""WITH {fx.ORDERS}, t AS (SELECT * FROM orders_base WHERE order_year < 1998),
g AS (SELECT avg(y) AS g FROM t),
m AS (SELECT order_year AS lv, (sum(y) + 10 * any_value(g)) / (count(*) + 10) AS te FROM t, g GROUP BY 1)
SELECT order_id, round(coalesce(te, g), 6) AS order_year_te
FROM orders_base CROSS JOIN g LEFT JOIN m ON order_year = lv""")
def f_te(spark, folder):
    """Years after the training rows are unseen levels."""
    rows = fx.orders_base(spark, folder)
    encoder = encode.fit_levels(rows.filter("order_year < 1998"), ["order_year"], F.col("y"),
                                smoothing=10.0, null_level=False)
    return rounded(encoder.transform(rows, "order_id", target="_te").select(*KEYS, "order_year_te"))


def _lines(select: str) -> str:
    return f"WITH {fx.LINES} SELECT l_orderkey, {select} FROM lines"


@query("f_zero", "SELECT l_orderkey, CAST(l_tax = 0 AS INTEGER) AS tax_is_zero, "
                 "coalesce(CAST(nullif(l_discount, 0.1) = 0 AS INTEGER), 0) AS discount_is_zero FROM lineitem")
def f_zero(spark, folder):
    rows = spark.read.parquet(f"{folder}/lineitem.parquet")
    return rows.select("l_orderkey", fn.zero_flag(F.col("l_tax")).alias("tax_is_zero"),
                       fn.zero_flag(F.nullif("l_discount", F.lit(0.1))).alias("discount_is_zero"))


@query("f_product", _lines("round(quantity * price, 4) AS quantity_x_price, "
                           "round(price * discount, 4) AS price_x_discount"))
def f_product(spark, folder):
    return rounded(fx.lines(spark, folder).select(
        "l_orderkey", fn.product(F.col("quantity"), F.col("price")).alias("quantity_x_price"),
        fn.product(F.col("price"), F.col("discount")).alias("price_x_discount")), 4)


@query("f_ratio", _lines("round(price / nullif(tax, 0), 4) AS price_div_tax, "
                         "round(price / nullif(discount, 0), 4) AS price_div_discount"))
def f_ratio(spark, folder):
    return rounded(fx.lines(spark, folder).select(
        "l_orderkey", fn.ratio(F.col("price"), F.col("tax")).alias("price_div_tax"),
        fn.ratio(F.col("price"), F.col("discount")).alias("price_div_discount")), 4)


_ROW = ["quantity", "discount", "tax", "line"]
_LIST = "[CAST(quantity AS DOUBLE), discount, tax, CAST(line AS DOUBLE)]"


@query("f_row_mean", _lines(f"round(list_avg({_LIST}), 6) AS row_mean"))
def f_row_mean(spark, folder):
    return rounded(fx.lines(spark, folder).select(
        "l_orderkey", fn.row_mean([F.col(c) for c in _ROW]).alias("row_mean")))


@query("f_row_std", _lines(f"round(list_stddev_samp({_LIST}), 6) AS row_std"))
def f_row_std(spark, folder):
    return rounded(fx.lines(spark, folder).select(
        "l_orderkey", fn.row_std([F.col(c) for c in _ROW]).alias("row_std")))


@query("f_inf_null", _lines("CASE WHEN tax = 0 THEN NULL ELSE round(tax, 6) END AS tax"))
def f_inf_null(spark, folder):
    endless = F.when(F.col("tax") == 0, F.lit(float("-inf"))).otherwise(F.col("tax"))
    return rounded(fx.lines(spark, folder).select("l_orderkey", fn.inf_to_null(endless).alias("tax")))


@query("f_cyclic", _lines("round(sin(2 * pi() * tax * 10), 6) + 0.0 AS tax_sin, "
                          "round(cos(2 * pi() * tax * 10), 6) + 0.0 AS tax_cos"))
def f_cyclic(spark, folder):
    s, c = fn.cyclic(F.col("tax") * 10)
    # adding zero makes -0.0 and 0.0 one value
    return fx.lines(spark, folder).select("l_orderkey", (F.round(s, 6) + 0.0).alias("tax_sin"),
                                          (F.round(c, 6) + 0.0).alias("tax_cos"))


@query("f_te_cross", f"""WITH {fx.ORDERS}, g AS (SELECT avg(y) AS g FROM orders_base),
m AS (SELECT nation, (sum(y) + 10 * any_value(g)) / (count(*) + 10) AS te FROM orders_base, g GROUP BY 1)
SELECT order_id, round(te * acctbal, 4) AS nation_te_acctbal FROM orders_base JOIN m USING (nation)""")
def f_te_cross(spark, folder):
    rows = fx.orders_base(spark, folder)
    encoder = encode.fit_levels(rows, ["nation"], F.col("y"), smoothing=10.0, null_level=False)
    return rounded(encoder.transform(rows, "order_id", target="_te").select(
        *KEYS, fn.product(F.col("nation_te"), F.col("acctbal")).alias("nation_te_acctbal")), 4)


@query("f_clip", f"""WITH {fx.ORDERS}, r AS (SELECT min(acctbal) AS lo, max(acctbal) AS hi FROM orders_base)
SELECT order_id, round(least(greatest(price / 20.0 - 1000, lo - 0.02 * (hi - lo)), hi + 0.02 * (hi - lo)), 4)
AS pred FROM orders_base, r""")
def f_clip(spark, folder):
    rows = fx.orders_base(spark, folder)
    low, high = encode.target_range(rows, F.col("acctbal"))[-1]
    return rounded(rows.select(*KEYS, fn.clip_to_range(F.col("price") / 20.0 - 1000, low, high)
                               .alias("pred")), 4)


@query("f_identity_post", _orders("round(price / 1000.0, 6) AS pred"))
def f_identity_post(spark, folder):
    post = RecordedFeatures().postprocess(F.col("price") / 1000.0)
    return rounded(fx.orders_base(spark, folder).select(*KEYS, post.alias("pred")))


# -- recipes ----------------------------------------------------------------------------

# labelled documents: two numeric columns (one with nulls), two text columns
_LABELLED = f"""{fx.DOCS}, t AS (
  SELECT doc_id, n_chars, CASE WHEN lang = 'en' THEN toxic END AS toxic,
         lang, nullif(source, 'src0') AS source, CAST(quality AS DOUBLE) AS label,
         {fx.sql_fold('doc_id')} AS fold FROM docs WHERE quality IS NOT NULL)"""


def labelled_docs(spark, folder):
    """Labelled documents with key, label and fold in the reserved columns."""
    return fx.docs(spark, folder).filter(F.col("quality").isNotNull()).select(
        F.col("doc_id").alias(KEY), "n_chars",
        F.when(F.col("lang") == "en", F.col("toxic")).alias("toxic"), "lang",
        F.nullif("source", F.lit("src0")).alias("source"),
        F.col("quality").cast("double").alias(LABEL),
        hash_fold(F.col("doc_id"), fx.FOLDS).alias(FOLD))


def doc_spec(rows) -> ProblemSpec:
    return ProblemSpec("", "", "quality", None, "binary", 2, [0, 1], rows, rows)


def _recipe_sql(slot: str) -> str:
    """The fourth step; ``slot`` says which rows a row's statistics use."""
    own = slot == "own"
    groups = "range(0, 5) r(k)" if own else "range(9, 10) r(k)"
    me = "t.fold" if own else "9"
    return f"""WITH {_LABELLED},
    stat AS (SELECT k, median(n_chars) AS m_chars, median(toxic) AS m_toxic, avg(label) AS g,
        count(*) AS rows_, min(n_chars) > 0 AND abs(skewness(n_chars)) > 1 AS log_chars,
        var_samp(n_chars) >= var_samp(toxic) AS chars_first
      FROM t JOIN {groups} ON t.fold <> k GROUP BY k),
    lv AS (SELECT k, coalesce(lang, '__nan__') AS lv, 'lang' AS f, count(*) AS n, sum(label) AS s
      FROM t JOIN {groups} ON t.fold <> k GROUP BY ALL
      UNION ALL SELECT k, coalesce(source, '__nan__'), 'source', count(*), sum(label)
      FROM t JOIN {groups} ON t.fold <> k GROUP BY ALL),
    x AS (SELECT t.*, stat.*, coalesce(t.n_chars, m_chars) AS a, coalesce(t.toxic, m_toxic) AS b,
        a.n AS an, a.s AS as_, c.n AS cn, c.s AS cs
      FROM t JOIN stat ON stat.k = {me}
      LEFT JOIN lv a ON a.k = {me} AND a.f = 'lang' AND a.lv = coalesce(t.lang, '__nan__')
      LEFT JOIN lv c ON c.k = {me} AND c.f = 'source' AND c.lv = coalesce(t.source, '__nan__'))
    SELECT doc_id, round(CAST(a AS DOUBLE), 6) AS n_chars, 0 AS n_chars__isna,
      round(CAST(b AS DOUBLE), 6) AS toxic, CAST(toxic IS NULL AS INTEGER) AS toxic__isna,
      CASE WHEN log_chars THEN round(ln(1 + a), 6) END AS n_chars__log1p,
      CASE WHEN chars_first THEN round(a * b, 6) END AS n_chars_x_toxic,
      CASE WHEN chars_first THEN round(a / nullif(b, 0), 6) END AS n_chars_div_toxic,
      round((a + b) / 2.0, 6) AS __row_mean, round(abs(a - b) / sqrt(2), 6) AS __row_std,
      round(coalesce(an / rows_, 0), 6) AS lang__freq,
      round((coalesce(as_, 0) + 20 * g) / (coalesce(an, 0) + 20), 6) AS lang__te,
      round(coalesce(cn / rows_, 0), 6) AS source__freq,
      round((coalesce(cs, 0) + 20 * g) / (coalesce(cn, 0) + 20), 6) AS source__te,
      coalesce(lang, '__nan__') AS lang, coalesce(source, '__nan__') AS source FROM x"""


@query("f_recipe", _recipe_sql("all"))
def f_recipe(spark, folder):
    rows = labelled_docs(spark, folder)
    recipe = Curriculum(4)
    recipe.fit(rows, doc_spec(rows), Slots())
    return rounded(recipe.transform(rows).withColumnRenamed(KEY, "doc_id").drop(FOLD, LABEL))


@query("cv_features", _recipe_sql("own"))
def cv_features(spark, folder):
    """Features of every row from the rows outside its fold."""
    rows = labelled_docs(spark, folder)
    recipe = Curriculum(3)
    recipe.fit(rows, doc_spec(rows), Slots(FOLD, fx.FOLDS))
    return rounded(recipe.transform(rows, OWN_FOLD).withColumnRenamed(KEY, "doc_id")
                   .drop(FOLD, LABEL))


@query("udf_contract", f"""WITH {fx.ORDERS}, g AS (SELECT avg(y) AS g FROM orders_base),
m AS (SELECT nation AS nv, (sum(y) + 10 * any_value(g)) / (count(*) + 10) AS te, count(*) AS n
  FROM orders_base, g GROUP BY 1),
c AS (SELECT priority AS pv, count(*) AS n FROM orders_base WHERE priority IS NOT NULL GROUP BY 1)
SELECT order_id, acctbal, nation, priority, coalesce(c.n, 0) AS priority_freq, m.n AS nation_freq,
  coalesce(CAST(acctbal = 0 AS INTEGER), 0) AS acctbal_is_zero,
  round(CASE WHEN acctbal IS NOT NULL THEN ln(1 + greatest(acctbal, 0)) END, 6) AS log_acctbal,
  round(m.te * acctbal, 4) AS nation_te_acctbal, round(m.te, 6) AS nation_te
FROM orders_base JOIN m ON nation = nv LEFT JOIN c ON priority = pv""")
def udf_contract(spark, folder):
    """A user's solution run through fit and transform."""
    rows = fx.orders_base(spark, folder).select(
        F.col("order_id").alias(KEY), F.col("y").cast("double").alias(LABEL),
        "acctbal", "nation", "priority")
    spec = ProblemSpec("", "", "y", None, "binary", 2, [0, 1], rows, rows)
    mine = RecordedFeatures(count_columns=["priority", "nation"], zero_columns=["acctbal"],
                            log_columns=["acctbal"], target_columns=["nation"],
                            crosses=[("nation", "acctbal")])
    mine.fit(rows, spec, Slots())
    return rounded(mine.transform(rows).withColumnRenamed(KEY, "order_id").drop(LABEL),
                   6, nation_te_acctbal=4)


_DATED = """dated AS (SELECT o_orderkey, strftime(o_orderdate, '%d.%m.%Y') AS day,
  o_custkey || '-' || o_orderstatus || '-' || o_orderkey AS code, o_orderpriority AS plain FROM orders)"""


@query("f_date_parts", f"""WITH {_DATED}
SELECT o_orderkey, CAST(year(d) AS INTEGER) AS day_year, CAST(month(d) AS INTEGER) AS day_month,
  CAST(day(d) AS INTEGER) AS day_day, CAST(isodow(d) - 1 AS INTEGER) AS day_weekday,
  CAST(dayofyear(d) AS INTEGER) AS day_yearday, 0 AS day_hour
FROM (SELECT o_orderkey, strptime(day, '%d.%m.%Y') AS d FROM dated)""")
def f_date_parts(spark, folder):
    """Parts of dates kept as text, whose format is found by votes."""
    rows = _dated(spark, folder).select("o_orderkey", "day", "plain")
    formats = text_parts.date_formats(rows, ["day", "plain"])
    return text_parts.with_date_parts(rows, formats).drop("day", "plain")


@query("f_composite", f"""WITH {_DATED}
SELECT o_orderkey, CAST(split_part(code, '-', 1) AS DOUBLE) AS code_part0, split_part(code, '-', 2) AS code_part1,
  CAST(split_part(code, '-', 3) AS DOUBLE) AS code_part2 FROM dated""")
def f_composite(spark, folder):
    """Parts of composite ids, whose separator is found by votes."""
    rows = _dated(spark, folder).select("o_orderkey", "code")
    return text_parts.with_composite_parts(rows, text_parts.composites(rows, ["code"])).drop("code")


def _dated(spark, folder):
    return read_table(spark, folder, "orders").select(
        "o_orderkey", F.date_format("o_orderdate", "dd.MM.yyyy").alias("day"),
        F.concat_ws("-", "o_custkey", "o_orderstatus", "o_orderkey").alias("code"),
        F.col("o_orderpriority").alias("plain"))
