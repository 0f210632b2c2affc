"""Cascades of many keys, their exact fallback, and names that clash."""

import pytest
from pyspark.sql import functions as F

from quern.llm import queries
from quern.llm.url_filter import Cascade, url_verdicts

RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/")]


@pytest.mark.parametrize("keys", [1, 7, 20_000])
def test_cascade_is_exact_for_its_universe(spark, keys):
    universe = spark.range(keys).select(F.concat(F.lit("h"), "id").alias("key"))
    here = F.crc32(F.col("key").cast("binary")) % 7 == 0
    listed = universe.filter(here).unionAll(spark.range(50).select(F.concat(F.lit("not there "), "id").alias("key")))
    cascade = Cascade(listed, universe)
    assert keys < 100 or len(cascade.levels) > 1
    assert universe.filter(cascade.has(F.col("key")) != here).count() == 0


@pytest.mark.parametrize("max_bytes", [1 << 26, 10])
def test_a_hundred_thousand_listed_hosts(spark, max_bytes):
    """By cascade, and by the join for lists too large for literals."""
    blocked = spark.range(100_000).select(F.concat(F.lit("bad"), "id", F.lit(".example.org")).alias("key")).unionAll(spark.createDataFrame([(None,)], "key string"))
    n = F.col("id")
    hosts = F.when(n % 3 == 0, F.concat(F.lit("www.bad"), n * 7, F.lit(".example.org"))).when(n % 3 == 1, F.concat(F.lit("bad"), n + 99_000, F.lit(".example.org"))).otherwise(F.concat(F.lit("good"), n, F.lit(".example.com")))
    pages = spark.range(30_000).select("id", F.concat(F.lit("http://"), hosts, F.lit("/en/")).alias("url"))
    out = url_verdicts(pages, RULES, blocked, max_bytes=max_bytes).select("id", "rule", "verdict")
    wrong = F.when(n % 3 == 0, (F.col("verdict") == "block") != (n * 7 < 100_000)).when(n % 3 == 1, (F.col("verdict") == "block") != (n + 99_000 < 100_000)).otherwise((F.col("verdict") != "block") | (F.col("rule") != "example.com/en/"))
    assert out.count() == 30_000 and out.filter(wrong).count() == 0
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert ("Join" in plan) == (max_bytes == 10)


def test_names_that_clash(spark):
    pages = spark.createDataFrame([(1, "http://example.com/en/", "a", "b", "c", "d"), (2, None, None, None, None, None)], "page_id long, url string, __host string, __RULES string, __path string, host string")
    blocked = spark.createDataFrame([(None,), ("x.org",)], "key string")
    out = url_verdicts(pages, RULES, blocked)
    assert out.columns == [*pages.columns, "path", "rule", "verdict"]
    assert [tuple(r) for r in out.orderBy("page_id").collect()] == [(1, "http://example.com/en/", "a", "b", "c", "example.com", "/en/", "example.com/en/", "block"), (2, None, None, None, None, "", "", None, "allow")]
    assert url_verdicts(pages, [], blocked.limit(0)).filter("verdict = 'allow'").count() == 2


def test_the_plan_is_native(spark):
    plan = queries.op3_url_filter(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Join" not in plan
