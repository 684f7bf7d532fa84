"""Tables that the named queries start from, in Spark and as SQL.

Both forms describe the same rows, so that a SQL engine can check the result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from foldmark.functions.hashing import hash_fold, hash_unit
from foldmark.operators.framing import ProblemSpec, build_spec
from foldmark.sources.tables import nan_to_null, read_table

FOLDS = 5

# -- hash expressions in SQL ---------------------------------------------------


def sql_number(key: str, seed: int = 42) -> str:
    return f"CAST(('0x' || substr(md5('{seed}|' || CAST({key} AS VARCHAR)), 1, 8)) AS BIGINT)"


def sql_fold(key: str, folds: int = FOLDS) -> str:
    return f"CAST({sql_number(key)} % {folds} AS INTEGER)"


def sql_unit(key: str) -> str:
    return f"({sql_number(key)} / 4294967296.0)"


def sql_skew(x: str) -> str:
    """DuckDB's skewness is the adjusted one, NaN or null where undefined."""
    return (f"CASE WHEN count({x}) = 0 THEN NULL WHEN count({x}) < 3 OR min({x}) = max({x}) "
            f"THEN 0.0 ELSE skewness({x}) END")


# -- orders with customer data -----------------------------------------------------

# id, five features (two with nulls), three targets
ORDERS = f"""orders_base AS (
  SELECT o_orderkey AS order_id,
         CASE WHEN c_acctbal < 500 THEN NULL ELSE c_acctbal END AS acctbal,
         CAST(date_part('year', o_orderdate) AS INTEGER) AS order_year,
         c_mktsegment AS segment, n_name AS nation,
         nullif(o_orderpriority, '5-LOW') AS priority,
         o_totalprice AS price, o_orderstatus AS status,
         CAST(o_orderstatus = 'F' AS INTEGER) AS y,
         {sql_fold('o_orderkey')} AS fold
  FROM orders JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey)"""


def orders_base(spark: SparkSession, folder: str) -> DataFrame:
    orders = read_table(spark, folder, "orders")
    customer = read_table(spark, folder, "customer")
    nation = read_table(spark, folder, "nation")
    return (orders.join(customer, orders.o_custkey == customer.c_custkey)
            .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
            .select(F.col("o_orderkey").alias("order_id"),
                    F.when(F.col("c_acctbal") >= 500, F.col("c_acctbal")).alias("acctbal"),
                    F.year("o_orderdate").alias("order_year"),
                    F.col("c_mktsegment").alias("segment"), F.col("n_name").alias("nation"),
                    F.nullif("o_orderpriority", F.lit("5-LOW")).alias("priority"),
                    F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("status"),
                    (F.col("o_orderstatus") == "F").cast("int").alias("y"),
                    hash_fold(F.col("o_orderkey"), FOLDS).alias("fold")))


# -- documents with labels -----------------------------------------------------------

DOCS = """docs AS (
  SELECT d.doc_id, d.lang, d.source, d.n_chars,
         l.quality, l.toxic, d.text
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


def docs(spark: SparkSession, folder: str) -> DataFrame:
    documents = read_table(spark, folder, "documents")
    labels = read_table(spark, folder, "labels")
    return documents.join(labels, "doc_id", "left").select(
        "doc_id", "lang", "source", "n_chars", "quality", "toxic", "text")


# -- line items: numeric columns, and discounts with nulls ------------------------------

LINES = f"""lines AS (
  SELECT l_orderkey, {sql_fold('l_orderkey')} AS fold, l_quantity AS quantity, l_extendedprice AS price,
         nullif(l_discount, 0) AS discount, l_tax AS tax,
         l_linenumber AS line, l_returnflag AS flag, l_linestatus AS status
  FROM lineitem)"""


def lines(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "lineitem").select(
        "l_orderkey", hash_fold(F.col("l_orderkey"), FOLDS).alias("fold"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_extendedprice").alias("price"),
        F.nullif("l_discount", F.lit(0.0)).alias("discount"), F.col("l_tax").alias("tax"),
        F.col("l_linenumber").alias("line"), F.col("l_returnflag").alias("flag"),
        F.col("l_linestatus").alias("status"))


# -- event sequences ---------------------------------------------------------------------

def events(spark: SparkSession, folder: str) -> DataFrame:
    return nan_to_null(read_table(spark, folder, "events").drop("props"))


# -- scored rows: two predictions with folds, for the metrics ------------------------------

SCORED = f"""scored AS (
  SELECT l_orderkey, fold, y, price, value,
         least(greatest(l_quantity / 51.0 + 0.05 * y - 0.02, 0.0), 1.0) AS p,
         CAST(l_quantity >= 26 AS INTEGER) AS hard
  FROM (SELECT l_orderkey, l_quantity, {sql_fold('l_orderkey')} AS fold,
               CAST(l_returnflag = 'A' AS INTEGER) AS y,
               l_extendedprice / 1000.0 AS price,
               l_quantity * 2.1 - 1.5 AS value FROM lineitem))"""


def scored(spark: SparkSession, folder: str) -> DataFrame:
    """Binary truth and probability, and a numeric truth with a prediction."""
    rows = read_table(spark, folder, "lineitem").select(
        "l_orderkey", "l_quantity", hash_fold(F.col("l_orderkey"), FOLDS).alias("fold"),
        (F.col("l_returnflag") == "A").cast("int").alias("y"),
        (F.col("l_extendedprice") / 1000.0).alias("price"),
        (F.col("l_quantity") * 2.1 - 1.5).alias("value"))
    p = F.least(F.greatest(F.col("l_quantity") / 51.0 + F.lit(0.05) * F.col("y") - 0.02,
                           F.lit(0.0)), F.lit(1.0))
    return rows.select("l_orderkey", "fold", "y", "price", "value", p.alias("p"),
                       (F.col("l_quantity") >= 26).cast("int").alias("hard"))


# three class probabilities from two line columns; truth is the order's status
CLASSED = f"""classed AS (
  SELECT {sql_fold('l_orderkey')} AS fold,
         CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS label,
         l_returnflag AS truth,
         a / (a + b + 0.3) AS p0, b / (a + b + 0.3) AS p1, 0.3 / (a + b + 0.3) AS p2
  FROM (SELECT l_orderkey, l_returnflag, l_quantity / 50.0 AS a, l_tax * 10 + 0.01 AS b
        FROM lineitem))"""


def classed(spark: SparkSession, folder: str) -> DataFrame:
    rows = read_table(spark, folder, "lineitem").select(
        "l_orderkey", "l_returnflag", (F.col("l_quantity") / 50.0).alias("a"),
        (F.col("l_tax") * 10 + 0.01).alias("b"))
    whole = F.col("a") + F.col("b") + 0.3
    return rows.select(
        hash_fold(F.col("l_orderkey"), FOLDS).alias("fold"),
        F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1)
        .otherwise(2).alias("label"), F.col("l_returnflag").alias("truth"),
        F.array(F.col("a") / whole, F.col("b") / whole, F.lit(0.3) / whole).alias("probs"))


# -- train and test ------------------------------------------------------------------------

def order_spec(spark: SparkSession, folder: str, target: str = "y",
               text: str = "Predict the target column: y") -> ProblemSpec:
    """Orders split by the hash of their key, four fifths for training."""
    rows = orders_base(spark, folder).drop("fold", *{"y", "status", "price"} - {target})
    unit = hash_unit(F.col("order_id"), 7)
    return build_spec([text], ["orders with customer data"], rows.filter(unit < 0.8),
                      rows.filter(unit >= 0.8).drop(target))


# -- a journal out of the events -------------------------------------------------------------

# Texts of the derived proposals.
PROPOSALS = [
    "Target encoding of the customer segment",
    "Target encoding x interaction of nation and priority",
    "Product interaction of quantity and price",
    "Cyclic sin/cos of the order date",
    "Cumulative count of purchases and rows since the last one",
    "Frequency encoding of the nation",
    "**Hypothesis**:",
]
# Model names of the derived usage rows.
MODELS = ["Qwen3-235B-A22B-FP8", "gpt://folder/gpt-oss-20b/latest", " deepseek-v32/rc ",
          "unnamed-model", "gpt-oss-120b"]
TOOLS = ["python_exec", "submit_solution", "read_incumbent", "add_insight"]


def _case(key: str, values: list[str]) -> str:
    arms = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"CASE {key} % {len(values)} {arms} END"


# SQL that Spark and DuckDB both run. A signup is a run's baseline, a click a
# result (accepted when marked), an error a failed evaluation, a view a tool
# call with its result, a purchase a usage record.
_EVENT_ROWS = f"""
  SELECT CAST(user_id AS {{text}}) AS run, {{t}} AS t, event_id, event_type, value,
         {_case('event_id', PROPOSALS)} AS proposal,
         {_case('event_id', MODELS)} AS model_name,
         {_case('event_id', TOOLS)} AS tool
  FROM events"""

_PARTS = [
    # event, from type, iter, ok, score, std, n_features, msg, name, model, input, output
    ("BASELINE", "signup", "-1", "true", "0.5 + value / 10000", "0.001", "14", "NULL",
     "NULL", "NULL", "NULL", "NULL"),
    ("PROPOSE", "click", "event_id", "NULL", "NULL", "NULL", "NULL", "proposal",
     "NULL", "NULL", "NULL", "NULL"),
    ("RESULT", "click", "event_id", "value > 2", "0.5 + value / 2000",
     "0.001 + value / 100000", "14 + event_id % 20", "NULL", "NULL", "NULL", "NULL", "NULL"),
    ("PROPOSE", "error", "event_id", "NULL", "NULL", "NULL", "NULL", "proposal",
     "NULL", "NULL", "NULL", "NULL"),
    ("EVAL_ERROR", "error", "event_id", "NULL", "NULL", "NULL", "NULL", "'raised'",
     "NULL", "NULL", "NULL", "NULL"),
    ("TOOL_CALL", "view", "event_id - event_id % 500", "NULL", "NULL", "NULL", "NULL",
     "NULL", "tool", "NULL", "NULL", "NULL"),
    ("TOOL_RESULT", "view", "event_id - event_id % 500", "NULL", "NULL", "NULL", "NULL",
     "NULL", "tool", "NULL", "NULL", "NULL"),
    ("TOKEN_USAGE", "purchase", "event_id", "NULL", "NULL", "NULL", "NULL", "NULL",
     "NULL", "model_name", "floor(value * 1000)", "floor(value * 50)"),
]


def _part(p: tuple, text: str) -> str:
    (event, kind, it, ok, score, std, feats, msg, name, model, tin, tout) = p
    return (f"SELECT run, '{event}' AS event, t, CAST({it} AS INTEGER) AS iter, "
            f"CAST({ok} AS BOOLEAN) AS ok, CAST({score} AS DOUBLE) AS score, "
            f"CAST({std} AS DOUBLE) AS std, CAST({feats} AS INTEGER) AS n_features, "
            f"CAST({msg} AS {text}) AS msg, CAST({name} AS {text}) AS name, "
            f"CAST({model} AS {text}) AS model, CAST({tin} AS BIGINT) AS input, "
            f"CAST({tout} AS BIGINT) AS output FROM event_rows WHERE event_type = '{kind}'")


_ACCEPT = ("ACCEPT", "click", "event_id", "NULL", "0.5 + value / 2000", "NULL", "NULL", "'new incumbent'",
           "NULL", "NULL", "NULL", "NULL")


def _journal_body(text: str) -> str:
    parts = [_part(p, text) for p in _PARTS]
    parts.append(_part(_ACCEPT, text) + " AND value > 120")
    return "\nUNION ALL ".join(parts)


JOURNAL = ("event_rows AS (" + _EVENT_ROWS.format(
    text="VARCHAR", t="strftime(ts, '%Y-%m-%d %H:%M:%S')")
    + "),\njournal AS (" + _journal_body("VARCHAR") + ")")


def journal_of(rows: DataFrame) -> DataFrame:
    """Journal events of an events table or stream.

    One pass over the events: each row is turned into an array of its
    journal events, which is then exploded.
    """
    base = rows.selectExpr(
        "CAST(user_id AS STRING) AS run", "date_format(ts, 'yyyy-MM-dd HH:mm:ss') AS t",
        "event_id", "event_type", "value", f"{_case('event_id', PROPOSALS)} AS proposal",
        f"{_case('event_id', MODELS)} AS model_name", f"{_case('event_id', TOOLS)} AS tool")

    def struct(p: tuple, condition: str) -> str:
        (event, _, it, ok, score, std, feats, msg, name, model, tin, tout) = p
        return (f"if({condition}, named_struct('event', '{event}', 'iter', CAST({it} AS INT), "
                f"'ok', CAST({ok} AS BOOLEAN), 'score', CAST({score} AS DOUBLE), "
                f"'std', CAST({std} AS DOUBLE), 'n_features', CAST({feats} AS INT), "
                f"'msg', CAST({msg} AS STRING), 'name', CAST({name} AS STRING), "
                f"'model', CAST({model} AS STRING), 'input', CAST({tin} AS BIGINT), "
                f"'output', CAST({tout} AS BIGINT)), NULL)")

    made = [struct(p, f"event_type = '{p[1]}'") for p in _PARTS]
    made.append(struct(_ACCEPT, "event_type = 'click' AND value > 120"))
    return (base.selectExpr("run", "t", f"explode(array_compact(array({', '.join(made)}))) AS e")
            .select("run", "t", "e.*"))


def journal(spark: SparkSession, folder: str) -> DataFrame:
    return journal_of(read_table(spark, folder, "events"))
