"""Reading and writing."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldmark.operators import eda
from foldmark.plans import fixtures as fx
from foldmark.plans.catalog.base import query, rounded
from foldmark.session import scratch_path
from foldmark.sources import journal as journal_source
from foldmark.sources import tables


@query("src_csv", """
SELECT o_orderkey, o_custkey, o_orderstatus, round(o_totalprice, 2) AS o_totalprice,
       o_orderpriority FROM orders""")
def src_csv(spark, folder):
    rows = tables.read_table(spark, folder, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    back = tables.read_csv(spark, tables.write_csv(rows, scratch_path(spark, "csv")))
    return rounded(back.withColumns({c: F.col(c).cast("bigint")
                                     for c in ("o_orderkey", "o_custkey")}), 2)


@query("src_text_multi", r"""
SELECT page_id, md5(concat_ws(E'\n\n', url, html)) AS joined_md5,
       CAST(length(concat_ws(E'\n\n', url, html)) AS BIGINT) AS joined_length FROM pages""")
def src_text_multi(spark, folder):
    joined = tables.join_text_columns([F.col("url"), F.col("html")])
    return tables.read_table(spark, folder, "pages").select(
        "page_id", F.md5(joined.cast("binary")).alias("joined_md5"),
        F.length(joined).cast("bigint").alias("joined_length"))


@query("src_journal", f"""
WITH {fx.JOURNAL}
SELECT run, event, t, iter, round(score, 6) AS score, msg, input FROM journal""")
def src_journal(spark, folder):
    path = journal_source.append_journal(fx.journal(spark, folder),
                                         scratch_path(spark, "journal"), by_run=False)
    return rounded(journal_source.read_journal(spark, path).select(
        "run", "event", "t", "iter", "score", "msg", "input"))


@query("src_head", """
SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem
ORDER BY l_orderkey, l_linenumber, l_quantity, l_partkey LIMIT 1000""")
def src_head(spark, folder):
    rows = tables.read_table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_partkey")
    return tables.head(rows, 1000, ["l_orderkey", "l_linenumber", "l_quantity",
                                    "l_partkey"]).drop("l_partkey")


@query("src_sample", """
SELECT o_orderkey, o_custkey, o_totalprice FROM orders
ORDER BY md5('42|' || CAST(o_orderkey AS VARCHAR)), o_orderkey LIMIT 500""")
def src_sample(spark, folder):
    rows = tables.read_table(spark, folder, "orders").select(
        "o_orderkey", "o_custkey", "o_totalprice")
    return tables.seeded_sample(rows, "o_orderkey", size=500, threshold=1000)


@query("snk_submission", f"""
WITH {fx.ORDERS} SELECT order_id, y FROM orders_base""")
def snk_submission(spark, folder):
    rows = fx.orders_base(spark, folder).select("order_id", "y")
    path = tables.write_csv(rows, scratch_path(spark, "submission"))
    return tables.read_csv(spark, path, "order_id bigint, y int")


@query("snk_journal", f"""
WITH {fx.JOURNAL} SELECT event, 2 * count(*) AS n FROM journal GROUP BY event""")
def snk_journal(spark, folder):
    """Appending the same events twice keeps both."""
    path = scratch_path(spark, "journal")
    rows = fx.journal(spark, folder)
    journal_source.append_journal(rows, path, by_run=False)
    journal_source.append_journal(rows, path, by_run=False)
    return journal_source.read_journal(spark, path).groupBy("event").agg(
        F.count(F.lit(1)).alias("n"))


@query("snk_profile", f"""
WITH {fx.DOCS}
SELECT 'doc_id' AS "column", 'integer' AS kind, CAST(count(DISTINCT doc_id) AS VARCHAR) AS value FROM docs
UNION ALL SELECT 'lang', 'categorical', CAST(count(DISTINCT lang) AS VARCHAR) FROM docs
UNION ALL SELECT 'source', 'categorical', CAST(count(DISTINCT source) AS VARCHAR) FROM docs
UNION ALL SELECT 'n_chars', 'integer', CAST(count(DISTINCT n_chars) AS VARCHAR) FROM docs
UNION ALL SELECT 'quality', 'integer', CAST(count(DISTINCT quality) AS VARCHAR) FROM docs
UNION ALL SELECT 'toxic', 'integer', CAST(count(DISTINCT toxic) AS VARCHAR) FROM docs
UNION ALL SELECT 'text', 'categorical', CAST(count(DISTINCT text) AS VARCHAR) FROM docs""")
def snk_profile(spark, folder):
    """The written profile, read back: the distinct counts in it."""
    path = tables.write_json(eda.profile(fx.docs(spark, folder)),
                             scratch_path(spark, "profile"))
    back = spark.read.schema("column string, kind string, stat string, value string").json(path)
    return back.filter(F.col("stat") == "n_unique").drop("stat")


@query("src_texts", """WITH files AS (SELECT item_id % 3 AS f,
  string_agg(text || chr(10), '' ORDER BY item_id) AS t FROM benchmark GROUP BY 1)
SELECT string_agg(t, chr(10) || chr(10) ORDER BY f) AS whole FROM files""")
def src_texts(spark, folder):
    """Several text files, joined by blank lines in the order given."""
    rows = tables.read_table(spark, folder, "benchmark")
    paths = []
    for f in range(3):
        paths.append(scratch_path(spark, "texts"))
        (rows.filter(F.col("item_id") % 3 == f).coalesce(1).sortWithinPartitions("item_id")
         .select("text").write.text(paths[-1]))
    return spark.createDataFrame([(tables.read_texts(spark, paths),)], "whole string")


@query("src_journal_followed", f"""WITH {fx.JOURNAL}
SELECT event, count(*) AS n FROM journal GROUP BY event
UNION ALL SELECT 'bad line', count(*) FROM events WHERE event_id % 50 = 0""")
def src_journal_followed(spark, folder):
    """Event counts of a followed journal, and its bad lines."""
    path = scratch_path(spark, "followed")
    good = fx.journal(spark, folder).select(F.to_json(F.struct("*")).alias("value"))
    bad = tables.read_table(spark, folder, "events").filter("event_id % 50 = 0").select(
        F.concat(F.lit('{"event": "RESULT", "score": '), F.col("event_id").cast("string")))
    good.unionAll(bad).write.text(path)
    rows, lines = journal_source.follow_journal(spark, path)
    return (rows.groupBy("event").agg(F.count(F.lit(1)).alias("n"))
            .unionAll(lines.agg(F.count(F.lit(1)).alias("n")).select(F.lit("bad line"), "n")))
