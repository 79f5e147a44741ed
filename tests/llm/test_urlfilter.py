"""URL rules and the Bloom filter with its exact join."""

from pyspark.sql import functions as F

from oracles.compare import compare, duck
from storepulse.llm import urlfilter
from storepulse.llm.queries import ORACLES, QUERIES
from tests.conftest import SF_SMALL
from tests.llm.helpers import rows

RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def pages(spark, urls):
    return spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)], "page_id long, url string, host string, listed string")


def test_query_matches_its_sql(spark):
    assert not compare(QUERIES["op7_url_filter"](spark, SF_SMALL), duck(SF_SMALL), ORACLES["op7_url_filter"])


def test_hosts_paths_and_rules(spark):
    cases = {
        "http://A.Example.ORG/es/1?x#y": ("a.example.org", "/es/1", "example.org/es/", "block"),
        "https://example.org/en/12": ("example.org", "/en/12", "example.org/en/1", "block"),
        "https://badexample.org/en/12": ("badexample.org", "/en/12", "org/", "allow"),
        "x://com/fr/": ("com", "/fr/", "com/fr/", "allow"),
        "http://a.com/de/x": ("a.com", "/de/x", "com/de/", "block"),
        "http://a.com?/de/": ("a.com", "", None, "allow"),
        "http://a.com#/de/": ("a.com", "", None, "allow"),
        "http://É.com/de/": ("É.com", "/de/", "com/de/", "block"),
        "no scheme": ("", "", None, "allow"), "": ("", "", None, "allow"), None: ("", "", None, "allow"),
        "://": ("", "", None, "allow"), "a://b://c/de/": ("b:", "//c/de/", None, "allow"),
        "http://org": ("org", "", None, "allow"),
    }
    listed = spark.createDataFrame([], "canonical string")
    got = rows(urlfilter.judge(pages(spark, cases), listed, RULES).orderBy("page_id"))
    assert [(r["host"], r["path"], r["rule"], r["verdict"]) for r in got] == list(cases.values())


def test_false_positives_are_removed(spark):
    """A filter of one bit a key lets nearly everything through; the join
    still leaves exactly the listed URLs."""
    listed = spark.createDataFrame([(f"bad.net/{k}",) for k in range(300)] * 2 + [(None,)], "canonical string")
    urls = [f"http://www.bad.net/{k}.html?a=1" for k in range(600)]
    got = rows(urlfilter.judge(pages(spark, urls), listed, []).orderBy("page_id"))
    assert [r["listed"] for r in got] == [k < 300 for k in range(600)]
    assert all((r["verdict"] == "block") == r["listed"] and r["rule"] is None for r in got)
    words = urlfilter.bloom(listed.where("canonical IS NOT NULL").distinct(), bits_per_key=1)
    assert words.count() <= 1 and words.first()["blocks"] == 1
    many = rows(urlfilter.bloom(listed.where("canonical IS NOT NULL").distinct()).agg(F.max("blocks").alias("b"), F.count("*").alias("n")))[0]
    assert many["b"] == 16 and many["n"] == 16


def test_canonical_urls(spark):
    same = ["http://www.a.net/x/", "https://a.net/x?utm=1", "http://A.net/x#top", "http://m.a.net:8080/x.html", "https://a.net/x/index.html"]
    out = {r["canonical"] for r in rows(urlfilter.judge(pages(spark, same), spark.createDataFrame([], "canonical string"), []))}
    assert out == {"a.net/x"}


def test_empty_and_repeated(spark):
    listed = spark.createDataFrame([("a.net/x",)], "canonical string")
    assert rows(urlfilter.judge(pages(spark, []), listed, RULES)) == []
    twice = pages(spark, ["http://a.net/x"]).union(pages(spark, ["http://a.net/x"]))
    assert [r["listed"] for r in rows(urlfilter.judge(twice, listed, RULES))] == [True, True]
