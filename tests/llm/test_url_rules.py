from foldmark.llm import url_rules
from foldmark.llm.url_rules import SITE_RULES, UrlRule, site_rule


def judge(spark, urls, **kw):
    rows = [(i, u, "x", "y") for i, u in enumerate(urls)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, token string")
    got = url_rules.judged(pages, **kw).collect()
    return [tuple(r)[1:] for r in sorted(got, key=lambda r: r.page_id)]


def test_contract_cases(spark):
    got = judge(spark, [
        None, "", "no scheme", "http://A.Example.ORG/es/1?q#f", "http://example.org/en/12",
        "http://example.org/en/2", "http://org", "http://org/", "http://xorg/",
        "https://x.com/fr/", "https://x.com/fr", "https://x.com/de/?u=://y", "ftp://com/de/",
        "http://casino-win.example.net/", "http://casinos.example.net/a", "://?q"])
    assert [g[2] for g in got] == [
        None, None, None, "example.org/es/", "example.org/en/1", "org/", None, "org/", None,
        "com/fr/", None, "com/de/", "com/de/", None, None, None]
    assert [g[3] for g in got] == [
        "allow", "allow", "allow", "block", "block", "allow", "allow", "allow", "allow",
        "allow", "allow", "block", "block", "block", "allow", "allow"]
    assert got[3][:2] == ("a.example.org", "/es/1") and got[15][:2] == ("", "")


def test_only_candidates_run(spark):
    never = UrlRule("never", "block", "[", ("absent",))  # this expression cannot be compiled
    assert judge(spark, ["http://a.org/x"], rules=SITE_RULES + (never,))[0][2] == "org/"


def test_quotes_in_rules(spark):
    odd = site_rule("a.b/x\\E+/", "block")
    assert [g[2] for g in judge(spark, ["http://a.b/x\\E+/y", "http://a.b/xE"], rules=(odd,))] == [
        odd.name, None]


def test_no_rows_and_repeats(spark):
    assert judge(spark, []) == []
    assert len(judge(spark, ["http://a.org/x"] * 50)) == 50
