"""Profiles, information, leak scans and the digest."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from foldmark.operators import eda
from foldmark.operators import information as info
from foldmark.plans import fixtures as fx
from foldmark.plans.catalog.base import query, rounded, union_sql
from foldmark.operators.neighbours import neighbour_information
from foldmark.operators.ranks import spearman_top
from foldmark.sources.tables import read_table

LINE_NUMBERS = ["quantity", "price", "discount", "tax", "line"]
LINE_COLUMNS = [*LINE_NUMBERS, "flag", "status"]
DOC_COLUMNS = ["doc_id", "lang", "source", "n_chars", "quality", "toxic", "text"]


def per_column(columns, body: str, table: str) -> str:
    """SQL with ``{c}`` for the column, once per column."""
    return union_sql([f"SELECT '{c}' AS \"column\", {body.format(c=c)} FROM {table}"
                      for c in columns])


@query("profile_shape", f"WITH {fx.DOCS} SELECT count(*) AS n_rows, 7 AS n_cols FROM docs")
def profile_shape(spark, folder):
    return eda.shape(fx.docs(spark, folder))


_MISSING = per_column(DOC_COLUMNS, "round(avg(CAST({c} IS NULL AS INTEGER)), 4) AS missing_frac", "docs")
_UNIQUE = per_column(DOC_COLUMNS, "count(DISTINCT {c}) AS n_unique", "docs")


@query("profile_missing", f"WITH {fx.DOCS} {_MISSING}")
def profile_missing(spark, folder):
    return eda.missing(fx.docs(spark, folder))


@query("profile_nunique", f"WITH {fx.LINES} "
       + per_column(LINE_COLUMNS, "count(DISTINCT {c}) AS n_unique", "lines"))
def profile_nunique(spark, folder):
    return eda.distinct_counts(fx.lines(spark, folder), LINE_COLUMNS)


_NUMERIC = ("CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max, "
            "round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, "
            "round(" + fx.sql_skew("{c}") + ", 6) AS skew, "
            "round(avg(CAST({c} = 0 AS INTEGER)), 4) AS zeros_frac")


@query("profile_numeric", f"WITH {fx.LINES} {per_column(LINE_NUMBERS, _NUMERIC, 'lines')}")
def profile_numeric(spark, folder):
    return rounded(eda.numeric_stats(fx.lines(spark, folder), LINE_NUMBERS), 6, mean=4, std=4)


def _top_sql(columns, table, top=5) -> str:
    """Ties go by value, those of long texts by length and digest."""
    parts = per_column(columns, "any_value(CAST({c} AS VARCHAR)) AS whole, count(*) AS n, "
                       "CASE WHEN length(CAST({c} AS VARCHAR)) > 64 THEN length(CAST({c} AS VARCHAR)) || '#' "
                       "|| sha256(CAST({c} AS VARCHAR)) ELSE CAST({c} AS VARCHAR) END AS value", table)
    parts = "\nUNION ALL ".join(
        f"{p} WHERE {c} IS NOT NULL GROUP BY ALL"
        for p, c in zip(parts.split("\nUNION ALL "), columns))
    return f"""SELECT "column", whole AS value, n, CAST(place AS INTEGER) AS place FROM (
      SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS place
      FROM ({parts})) WHERE place <= {top}"""


@query("profile_top_values", f"WITH {fx.ORDERS} "
       + _top_sql(["segment", "nation", "priority", "status"], "orders_base"))
def profile_top_values(spark, folder):
    return eda.top_values(fx.orders_base(spark, folder))


@query("profile_high_card", "SELECT * FROM (" + per_column(
    ["text", "lang", "source"], "count(DISTINCT {c}) AS n_unique, "
    "count(DISTINCT {c}) > 0.5 * count(*) AS high_cardinality", "documents") + ")")
def profile_high_card(spark, folder):
    return eda.high_cardinality(read_table(spark, folder, "documents"), ["text", "lang", "source"])


@query("profile_target", f"""WITH {fx.DOCS}
SELECT coalesce(CAST(quality AS VARCHAR), 'null') AS stat, CAST(count(*) AS DOUBLE) AS value
FROM docs GROUP BY 1
UNION ALL SELECT 'n_chars ' || stat, round(value, 4) FROM (
  SELECT 'min' AS stat, CAST(min(n_chars) AS DOUBLE) AS value FROM docs
  UNION ALL SELECT 'max', CAST(max(n_chars) AS DOUBLE) FROM docs
  UNION ALL SELECT 'mean', avg(n_chars) FROM docs
  UNION ALL SELECT 'skew', {fx.sql_skew('n_chars')} FROM docs)""")
def profile_target(spark, folder):
    """A class target with nulls, and a wide numeric one."""
    rows = fx.docs(spark, folder)
    wide = eda.target_profile(rows, "n_chars").withColumn(
        "stat", F.concat(F.lit("n_chars "), F.col("stat")))
    return rounded(eda.target_profile(rows, "quality").unionByName(wide), 4)


@query("profile", f"""WITH {fx.DOCS},
m AS ({_MISSING}), u AS ({_UNIQUE}), nums AS ({per_column(
    ["doc_id", "n_chars", "quality", "toxic"], _NUMERIC, "docs")}),
tops AS ({_top_sql(["lang", "source", "text"], "docs")}),
kinds("column", kind) AS (VALUES ('doc_id', 'integer'), ('lang', 'categorical'),
  ('source', 'categorical'), ('n_chars', 'integer'), ('quality', 'integer'),
  ('toxic', 'integer'), ('text', 'categorical'), ('', 'table')),
long AS (
  SELECT '' AS "column", 'n_rows' AS stat, CAST(count(*) AS DOUBLE) AS value FROM docs
  UNION ALL SELECT '', 'n_cols', 7
  UNION ALL SELECT "column", 'missing_frac', missing_frac FROM m
  UNION ALL SELECT "column", 'n_unique', n_unique FROM u
  UNION ALL SELECT "column", stat, value FROM nums
    UNPIVOT (value FOR stat IN (min, max, mean, std, skew, zeros_frac))
  UNION ALL SELECT "column", 'high_cardinality', CASE WHEN count(DISTINCT v) > 0.5 * count(*) THEN 1 ELSE 0 END
    FROM (SELECT 'lang' AS "column", lang AS v FROM docs UNION ALL SELECT 'source', source FROM docs
      UNION ALL SELECT 'text', text FROM docs)
    GROUP BY "column"
  UNION ALL SELECT "column", 'top:' || value, n FROM tops
  UNION ALL SELECT 'quality', 'target:' || coalesce(CAST(quality AS VARCHAR), 'null'), count(*)
    FROM docs GROUP BY ALL)
SELECT "column", kind, stat, round(value, 4) AS value FROM long JOIN kinds USING ("column")""")
def profile(spark, folder):
    table = eda.profile(fx.docs(spark, folder), "quality")
    number = F.coalesce(F.expr("try_cast(value AS double)"),
                        F.expr("CAST(try_cast(value AS boolean) AS double)"))
    return rounded(table.withColumn("value", number), 4)


# -- mutual information --------------------------------------------------------------

def mi_sql(features: dict[str, str], y: str, table: str) -> str:
    """Mutual information from the definition, joint against marginals."""
    joint = union_sql([
        f"SELECT '{name}' AS f, coalesce(CAST({expr} AS VARCHAR), '__nan__') AS x, "
        f"coalesce(CAST({y} AS VARCHAR), '__nan__') AS y, count(*) AS n FROM {table} GROUP BY ALL"
        for name, expr in features.items()])
    return f"""joint AS ({joint}),
    px AS (SELECT f, x, sum(n) AS nx FROM joint GROUP BY f, x),
    py AS (SELECT f, y, sum(n) AS ny FROM joint GROUP BY f, y),
    total AS (SELECT f, sum(n) AS nn FROM joint GROUP BY f),
    mi AS (SELECT f, round(greatest(sum(n / nn * ln(n * nn / (nx * ny))), 0.0), 6) AS mi
      FROM joint JOIN px USING (f, x) JOIN py USING (f, y) JOIN total USING (f) GROUP BY f)"""


def bins_sql(name: str, column: str, table: str, bins: int = 32) -> str:
    """A CTE of the distinct equal-frequency cut points of a column."""
    probs = ", ".join(str(i / bins) for i in range(1, bins))
    return (f"{name} AS (SELECT list_distinct(quantile_disc({column}, [{probs}])) AS cuts "
            f"FROM {table})")


def in_bin(column: str, name: str) -> str:
    return (f"CASE WHEN {column} IS NOT NULL THEN "
            f"(SELECT len(list_filter(cuts, lambda c: c < {column})) FROM {name}) END")


_MI_DISCRETE = {c: c for c in ("segment", "nation", "priority", "order_year")}


@query("mi_discrete", f"WITH {fx.ORDERS}, {mi_sql(_MI_DISCRETE, 'y', 'orders_base')} "
                      "SELECT f AS \"column\", mi AS mutual_info FROM mi")
def mi_discrete(spark, folder):
    rows = fx.orders_base(spark, folder)
    return rounded(info.mutual_information(rows, list(_MI_DISCRETE), "y").drop("n"))


_FILLED = f"""WITH {fx.LINES}, filled AS (
  SELECT quantity, price, tax, line, flag, status,
         coalesce(discount, (SELECT median(discount) FROM lines)) AS discount FROM lines),
{bins_sql('cq', 'quantity', 'filled')}, {bins_sql('cp', 'price', 'filled')},
{bins_sql('cd', 'discount', 'filled')}, {bins_sql('ct', 'tax', 'filled')},
binned AS (SELECT line, flag, status, {in_bin('quantity', 'cq')} AS quantity,
  {in_bin('price', 'cp')} AS price, {in_bin('discount', 'cd')} AS discount,
  {in_bin('tax', 'ct')} AS tax FROM filled)"""


@query("mi_continuous", f"""{_FILLED}, {mi_sql({c: c for c in ('price', 'discount', 'tax')}, 'flag', 'binned')}
SELECT f AS "column", mi AS mutual_info FROM mi""")
def mi_continuous(spark, folder):
    columns = ["price", "discount", "tax"]
    table = info.discrete(fx.lines(spark, folder).select("flag", *columns), columns)
    return rounded(info.mutual_information(table, columns, "flag").drop("n"))


@query("mi_regression_discrete", f"""{_FILLED}, {mi_sql({c: c for c in ('flag', 'status', 'line')}, 'price', 'binned')}
SELECT f AS "column", mi AS mutual_info FROM mi""")
def mi_regression_discrete(spark, folder):
    columns = ["flag", "status", "line"]
    table = info.discrete(fx.lines(spark, folder).select("price", *columns), columns,
                          also=["price"])
    return rounded(info.mutual_information(table, columns, "price").drop("n"))


# psi of an integer, and the nearest-neighbour estimate from the definition
_PSI = "(-0.5772156649015329 + coalesce(list_sum(list_transform(range(1, {n}), lambda i: 1.0 / i)), 0))"


def neighbours_sql(x: str, y: str, table: str, k: int = 3) -> str:
    near = ", ".join(f"x - lag(x, {i}) OVER w, lead(x, {i}) OVER w - x" for i in range(1, k + 1))
    return f"""SELECT '{x}' AS "column", count(*) AS n, round(greatest({_PSI.format(n='count(*)')} + avg(
      {_PSI.format(n='k')} - {_PSI.format(n='n')} - {_PSI.format(n='m')}), 0), 6) AS mutual_info FROM (
    SELECT a.row, any_value(CASE WHEN a.r = 0 THEN a.ties ELSE a.k END) AS k, any_value(a.n) AS n, count(*) AS m
    FROM (SELECT *, list_sort(list_filter(gaps, lambda g: g IS NOT NULL))[k] AS r FROM (
      SELECT {x} AS x, {y} AS y, row_number() OVER () AS row, count(*) OVER (PARTITION BY {y}) AS n,
        count(*) OVER (PARTITION BY {y}, {x}) AS ties,
        least({k}, count(*) OVER (PARTITION BY {y}) - 1) AS k,
        [{near.replace('lag(x', f'lag({x}').replace('lead(x', f'lead({x}').replace('x -', f'{x} -').replace('- x', f'- {x}')}] AS gaps
      FROM {table} WHERE {x} IS NOT NULL WINDOW w AS (PARTITION BY {y} ORDER BY {x})) WHERE n > 1) a
    JOIN (SELECT {x} AS z FROM {table} WHERE {x} IS NOT NULL AND {y} IN (
      SELECT {y} FROM {table} WHERE {x} IS NOT NULL GROUP BY 1 HAVING count(*) > 1)) b
      ON abs(z - a.x) < a.r OR z = a.x GROUP BY a.row)"""


@query("mi_neighbours", union_sql([neighbours_sql("c_acctbal", "c_mktsegment", "customer"),
                                   neighbours_sql("c_custkey", "c_mktsegment", "customer")]))
def mi_neighbours(spark, folder):
    """Nearest-neighbour information of continuous columns with a class."""
    return rounded(neighbour_information(read_table(spark, folder, "customer"),
                                         ["c_acctbal", "c_custkey"], "c_mktsegment"))


_RELATION = ["quantity", "price", "discount", "tax", "line", "status"]
_RELATION_SQL = f"{_FILLED}, {mi_sql({c: c for c in _RELATION}, 'flag', 'binned')}"


@query("target_relation", f"{_RELATION_SQL} SELECT f AS \"column\", mi AS mutual_info FROM mi")
def target_relation(spark, folder):
    return rounded(info.target_relation(fx.lines(spark, folder), "flag", columns=_RELATION))


_DATED = {"o_orderdate": "epoch_us(CAST(o_orderdate AS TIMESTAMP))", "o_totalprice": "o_totalprice"}


@query("target_relation_dates", f"""WITH dated AS (SELECT o_orderstatus, o_orderpriority, {', '.join(
    f'CAST({e} AS DOUBLE) AS {c}' for c, e in _DATED.items())} FROM orders),
{', '.join(bins_sql(f'c_{c}', c, 'dated') for c in _DATED)},
binned AS (SELECT o_orderstatus, o_orderpriority, {', '.join(f"{in_bin(c, f'c_{c}')} AS {c}" for c in _DATED)} FROM dated),
{mi_sql({c: c for c in [*_DATED, 'o_orderpriority']}, 'o_orderstatus', 'binned')}
SELECT f AS "column", mi AS mutual_info FROM mi""")
def target_relation_dates(spark, folder):
    """Dates are measured like numbers."""
    return rounded(info.target_relation(read_table(spark, folder, "orders"), "o_orderstatus",
                                        columns=[*_DATED, "o_orderpriority"]))


@query("topk_mi", f"""{_RELATION_SQL} SELECT f AS "column", mi AS mutual_info FROM mi
ORDER BY mi DESC, f LIMIT 3""")
def topk_mi(spark, folder):
    return rounded(info.target_relation(fx.lines(spark, folder), "flag", top=3, columns=_RELATION))


_PAIRS = [(a, b) for i, a in enumerate(LINE_NUMBERS) for b in LINE_NUMBERS[i + 1:]][:8]
_PAIR_EXPR = {}
for _a, _b in _PAIRS:
    _PAIR_EXPR[f"{_a}*{_b}"] = f"coalesce({_a}, 0) * coalesce({_b}, 0)"
    _PAIR_EXPR[f"{_a}/{_b}"] = f"coalesce({_a} / nullif({_b}, 0), 0)"


@query("interaction_scan", f"""WITH {fx.LINES}, pairs AS (SELECT status, {', '.join(
    f'CAST({e} AS DOUBLE) AS p{i}' for i, e in enumerate(_PAIR_EXPR.values()))} FROM lines),
{', '.join(bins_sql(f'c{i}', f'p{i}', 'pairs') for i in range(len(_PAIR_EXPR)))},
binned AS (SELECT status, {', '.join(f"{in_bin(f'p{i}', f'c{i}')} AS p{i}" for i in range(len(_PAIR_EXPR)))}
FROM pairs), {mi_sql({n: f'p{i}' for i, n in enumerate(_PAIR_EXPR)}, 'status', 'binned')}
SELECT f AS pair, mi FROM mi""")
def interaction_scan(spark, folder):
    return rounded(info.interaction_scan(fx.lines(spark, folder), "status", LINE_NUMBERS))


# -- correlation and leaks -------------------------------------------------------------

# a copy of the target with a little noise, which both scans must find
_LEAKY = "leaky AS (SELECT *, p_retailprice * 1.5 + (p_partkey % 7) * 0.01 AS copied FROM part)"
_PART_CORR = per_column(["p_partkey", "p_size", "copied"],
                        "abs(corr({c}, p_retailprice)) AS abs_corr", "leaky")


def leaky_parts(spark, folder):
    copied = F.col("p_retailprice") * 1.5 + (F.col("p_partkey") % 7) * 0.01
    return read_table(spark, folder, "part").withColumn("copied", copied)


@query("corr_target", f"WITH {fx.LINES} SELECT \"column\", round(abs_corr, 6) AS abs_corr FROM ("
       + per_column(["quantity", "discount", "tax", "line"],
                    "abs(corr({c}, price)) AS abs_corr", "lines") + ")")
def corr_target(spark, folder):
    return rounded(eda.target_correlation(fx.lines(spark, folder), "price",
                                          ["quantity", "discount", "tax", "line"]))


@query("corr_top", f"""WITH {fx.LINES} SELECT "column", round(abs_corr, 6) AS abs_corr FROM ("""
       + per_column(["l_orderkey", "fold", "quantity", "discount", "tax", "line"],
                    "abs(corr({c}, price)) AS abs_corr", "lines")
       + """) ORDER BY round(abs_corr, 9) DESC LIMIT 3""")
def corr_top(spark, folder):
    return rounded(eda.correlation_top(fx.lines(spark, folder), "price", 3))


def _spearman_sql(columns: list[str], y: str, table: str) -> str:
    average = "rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0"
    return union_sql([
        f"""SELECT '{c}' AS "column", abs(corr(a, b)) AS abs_corr FROM (
        SELECT {average.format(c=c)} AS a, {average.format(c=y)} AS b FROM {table}
        WHERE {c} IS NOT NULL AND {y} IS NOT NULL)""" for c in columns])


@query("corr_spearman", f"""WITH {fx.LINES} SELECT "column", round(abs_corr, 6) AS abs_corr FROM ({_spearman_sql(
    ['l_orderkey', 'quantity', 'discount', 'tax', 'line'], 'price', 'lines')})
ORDER BY round(abs_corr, 9) DESC LIMIT 4""")
def corr_spearman(spark, folder):
    """Correlations of average ranks, with ties and nulls."""
    return rounded(spearman_top(fx.lines(spark, folder).drop("fold"), "price", 4))


@query("leak_corr", f"""WITH {_LEAKY} SELECT "column", round(abs_corr, 6) AS abs_corr FROM ({_PART_CORR})
WHERE abs_corr > 0.98 AND (SELECT count(DISTINCT p_retailprice) FROM part) > 2""")
def leak_corr(spark, folder):
    return rounded(eda.leak_by_correlation(leaky_parts(spark, folder), "p_retailprice"))


def _fd_sql(columns, y, table) -> str:
    return union_sql([
        f"""SELECT '{c}' AS "column", count(*) AS n_levels, avg(CAST(k <= 1 AS INTEGER)) AS single_share
        FROM (SELECT {c}, count(DISTINCT {y}) AS k FROM {table} WHERE {c} IS NOT NULL GROUP BY {c})"""
        for c in columns])


_CUSTOMER_LEAK = """oc AS (SELECT o_orderkey, o_custkey, o_orderpriority, c_nationkey, c_mktsegment
  FROM orders JOIN customer ON o_custkey = c_custkey)"""


def order_customers(spark, folder):
    return (read_table(spark, folder, "orders")
            .join(read_table(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey"))
            .select("o_orderkey", "o_custkey", "o_orderpriority", "c_nationkey", "c_mktsegment"))


@query("leak_fd", f"""WITH {_CUSTOMER_LEAK}
SELECT "column", n_levels, round(single_share, 6) AS single_share FROM ({_fd_sql(
    ['o_orderkey', 'o_custkey', 'o_orderpriority', 'c_nationkey'], 'c_mktsegment', 'oc')})
WHERE single_share > 0.999 AND n_levels > 5""")
def leak_fd(spark, folder):
    return rounded(eda.leak_by_dependency(order_customers(spark, folder), "c_mktsegment"))


@query("leakage_scan", f"""WITH {_LEAKY}
SELECT "column", 'correlation' AS reason, round(abs_corr, 6) AS value FROM ({_PART_CORR})
WHERE abs_corr > 0.98
UNION ALL SELECT "column", 'single target per value', round(single_share, 6) FROM ({_fd_sql(
    ['p_partkey', 'p_name', 'p_brand', 'p_type', 'p_size', 'copied'], 'p_retailprice', 'leaky')})
WHERE single_share > 0.999 AND n_levels > 5""")
def leakage_scan(spark, folder):
    return rounded(eda.leakage_scan(leaky_parts(spark, folder), "p_retailprice"))


# -- digest --------------------------------------------------------------------------

@query("dup_rows", """
SELECT 'documents' AS tab, CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM documents)) AS BIGINT)
  AS n_duplicates FROM documents
UNION ALL SELECT 'lineitem', CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM lineitem)) AS BIGINT)
FROM lineitem
UNION ALL SELECT 'documents without id', CAST(count(*) - (SELECT count(*) FROM (
  SELECT DISTINCT text, lang, source, n_chars FROM documents)) AS BIGINT) FROM documents""")
def dup_rows(spark, folder):
    """Whole rows that repeat; ids are unique, so documents also without theirs."""
    documents = read_table(spark, folder, "documents")
    tables = {"documents": documents, "lineitem": read_table(spark, folder, "lineitem"),
              "documents without id": documents.drop("doc_id")}
    return reduce(DataFrame.unionAll, [
        eda.duplicate_rows(t).select(F.lit(name).alias("tab"), "n_duplicates") for name, t in tables.items()])


@query("digest_missing", f"""WITH {fx.DOCS}, m AS ({_MISSING})
SELECT * FROM m WHERE missing_frac > 0 ORDER BY missing_frac DESC, "column" LIMIT 15""")
def digest_missing(spark, folder):
    return eda.digest_missing(fx.docs(spark, folder))


@query("digest_cardinality", f"""WITH {fx.DOCS}, u AS ({_UNIQUE})
SELECT * FROM u ORDER BY n_unique DESC, "column" LIMIT 3""")
def digest_cardinality(spark, folder):
    return eda.digest_cardinality(fx.docs(spark, folder), 3)


@query("digest_target", f"""WITH {fx.DOCS}
SELECT 'n_chars' AS "column", count(DISTINCT n_chars) AS n_unique, round(avg(n_chars), 4) AS mean,
  CAST(min(n_chars) AS DOUBLE) AS min, CAST(max(n_chars) AS DOUBLE) AS max,
  round(stddev_samp(n_chars), 4) AS std, round(skewness(n_chars), 6) AS skewness,
  round(kurtosis(n_chars), 6) AS kurtosis FROM docs""")
def digest_target(spark, folder):
    return rounded(eda.digest_target(fx.docs(spark, folder), "n_chars"), 6, mean=4, std=4)


@query("digest_alerts", f"""WITH {fx.DOCS}, m AS ({_MISSING}), u AS ({_UNIQUE}),
s AS ({per_column(['doc_id', 'n_chars', 'quality', 'toxic'],
    fx.sql_skew('{c}') + ' AS skew, round(avg(CAST({c} = 0 AS INTEGER)), 4) AS zeros_frac', 'docs')}),
base AS (SELECT * FROM u JOIN m USING ("column") LEFT JOIN s USING ("column"))
SELECT 'UNIQUE' AS alert, "column" FROM base WHERE n_unique = (SELECT count(*) FROM docs)
UNION ALL SELECT 'CONSTANT', "column" FROM base WHERE n_unique = 1
UNION ALL SELECT 'MISSING', "column" FROM base WHERE missing_frac > 0.05
UNION ALL SELECT 'SKEWED', "column" FROM base WHERE abs(skew) > 20
UNION ALL SELECT 'ZEROS', "column" FROM base WHERE zeros_frac > 0.1""")
def digest_alerts(spark, folder):
    return eda.digest_alerts(fx.docs(spark, folder))
