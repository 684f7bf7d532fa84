import os

from pyspark.sql import functions as F

from foldmark.operators.text_parts import composites, date_formats, with_composite_parts, with_date_parts
from foldmark.sources.journal import append_journal, follow_journal


def test_planted_formats_are_found(spark):
    rows = spark.range(400).select(F.date_add(F.lit("2023-01-05").cast("date"), F.col("id").cast("int")).alias("d"))
    rows = rows.select("d", *[F.date_format("d", f).alias(n) for n, f in (
        ("iso", "yyyy-MM-dd"), ("us", "MM/dd/yyyy"), ("eu", "dd/MM/yyyy"), ("dots", "dd.MM.yyyy"), ("dense", "yyyyMMdd"))],
        F.when(F.dayofmonth("d") % 2 == 0, F.date_format("d", "yyyy-MM-dd")).otherwise("soon").alias("mixed"),
        F.when(F.dayofyear("d") % 40 == 0, "n/a").when(F.dayofmonth("d") > 3, F.date_format("d", "yyyy-MM-dd"))
        .alias("holed"), F.lit(None).cast("string").alias("empty"))
    formats = date_formats(rows, ["iso", "us", "eu", "dots", "dense", "mixed", "holed", "empty"])
    assert formats == {"iso": "yyyy-MM-dd", "us": "MM/dd/yyyy", "eu": "dd/MM/yyyy", "dots": "dd.MM.yyyy",
                       "dense": "yyyyMMdd", "mixed": None, "holed": "yyyy-MM-dd", "empty": None}
    out = with_date_parts(rows, formats)
    assert out.filter((F.col("us_month") != F.month("d")) | (F.col("eu_day") != F.dayofmonth("d"))
                      | (F.col("dense_year") != F.year("d"))).count() == 0
    assert out.filter("holed = 'n/a'").filter("holed_year IS NOT NULL").count() == 0
    assert "mixed_year" not in out.columns and out.count() == 400


def test_composites_are_taken_apart(spark):
    rows = spark.range(300).select(
        F.concat_ws("_", F.col("id") % 7, F.lit("ab"), "id").alias("code"),
        F.concat_ws(".", F.col("id"), F.lit("x")).alias("dotted"), F.col("id").cast("string").alias("plain"),
        F.when(F.col("id") % 2 == 0, "a-b").otherwise("c").alias("mixed"))
    forms = composites(rows, ["code", "dotted", "plain", "mixed"])
    assert forms["plain"] is None and forms["mixed"] is None
    assert (forms["code"].separator, forms["code"].parts, forms["code"].numeric) == ("_", 3, (True, False, True))
    out = with_composite_parts(rows, forms)
    assert dict(out.dtypes)["code_part0"] == "double" and dict(out.dtypes)["dotted_part1"] == "string"
    assert out.filter("code_part2 <> CAST(plain AS double) OR code_part1 <> 'ab'").count() == 0
    assert composites(rows, []) == {} and date_formats(rows, []) == {}


def test_a_followed_journal_takes_new_files_only(spark, tmp_path):
    path, place = f"{tmp_path}/journal", f"{tmp_path}/place"
    append_journal(spark.createDataFrame([("r1", "START"), ("r1", "RESULT")], "run string, event string"), path)
    rows, bad = follow_journal(spark, path, place)
    assert rows.count() == 2 and bad.count() == 0
    os.makedirs(path, exist_ok=True)
    with open(f"{path}/more.json", "w") as f:
        f.write('{"event": "DONE", "run": "r2", "score": NaN}\n\n{"event": "DO\nnot json\n{"run": "r3"}\n')
    rows, bad = follow_journal(spark, path, place)
    assert sorted(r["event"] for r in rows.collect()) == ["DONE", "RESULT", "START"]
    assert rows.filter("event = 'DONE'").first()["score"] is None
    assert sorted(r["value"] for r in bad.collect()) == ['not json', '{"event": "DO', '{"run": "r3"}']
