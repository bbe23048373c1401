import pytest
from pyspark.sql import functions as F

from voxlake.llm.queries import URL_RULES
from voxlake.llm.url_trust import host_scores, url_verdicts


@pytest.mark.parametrize("n", [2, 100])
def test_all_linkers_of_one_blocked_host_are_blocked(spark, n):
    bad = '<a href="http://bad.net/es/1">x</a>'
    many = "".join(f'<a href="http://h{i}.info/">' for i in range(100))
    pages = [(0, "http://bad.net/es/1", ""), *((i, f"http://farm{i}.org/", bad) for i in range(1, n + 1)),
             (1001, "http://good.com/a", bad), (1002, "http://hub.org/", many + bad), (1003, "http://h1.info/", many),
             (1004, "http://alone.org/", "")]
    got = {r["page_id"]: r["verdict"] for r in url_verdicts(
        spark.createDataFrame(pages, "page_id long, url string, html string"), URL_RULES).collect()}
    assert all(got[i] == "block" for i in range(n + 1))
    assert all(got[i] == "allow" for i in range(1001, 1005))


def test_rounds_go_on_to_the_tolerance(spark):
    """Over a chain of hosts, trust and distrust reach further than ten of them."""
    names = [f"h{i:02}" for i in range(16)]
    pages = spark.createDataFrame([(h, {"h00": "allow", "h15": "block"}.get(h)) for h in names], "host string, verdict string")
    links = spark.createDataFrame(list(zip(names, names[1:])), "source string, target string")
    got = {r["host"]: r for r in host_scores(pages, links).filter(F.col("host").isin("h12", "h03")).collect()}
    assert abs(got["h12"]["trust"] - 0.85 ** 12) < 0.01
    assert abs(got["h03"]["distrust"] - 0.85 ** 12) < 0.01 and abs(got["h03"]["leads"] - 0.85 ** 12) < 0.01
