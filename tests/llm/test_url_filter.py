import re

from pyspark.sql import functions as F

from cropline.llm import url_filter
from cropline.llm.queries import URL_RULES
from cropline.llm.url_filter import canonical, judge_urls

SCHEMA = "page_id long, url string, host string, listed string, verdict int, _block int"
URLS = [
    None,
    "",
    "no scheme.org/es/",
    "http://example.org",
    "http://example.org/",
    "HTTP://WWW.Example.ORG/es/1?x=1#y",
    "https://example.org/en/12",
    "https://example.org/en/2",
    "https://badexample.org/es/1",
    "https://a.b.example.org/en/1",
    "https://org/x",
    "https://x.com/fr/a?b=/de/",
    "https://x.com/de/",
    "https://x.com/de",
    "https://x.com?/de/",
    "https://x.net/de/://y.org/",
    "ftp://user@x.com:80/de/1",
    "http://x.net/a//?utm_source=q&b=2&a=1&ref=z&&refer=1#f",
    "http://m.x.net:443/a?a=1&b=2&refer=1",
    "https://İ.org/K/",
    "http:// .org/\n?",
    "https://x.org/" + "y" * 50_000,
]


def plain_parts(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def plain_verdict(url, listed):
    host, path = plain_parts(url)
    fits = [
        (len(r.host + r.path), r.host + r.path, r.verdict)
        for r in URL_RULES
        if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)
    ]
    if fits:
        return max(fits)[1:]
    return None, "block" if listed else "allow"


def _pages(spark):
    rows = [(i, u, None, "x", 1, 2) for i, u in enumerate([*URLS, *URLS])]
    return spark.createDataFrame([*rows, (None, URLS[5], None, None, None, None)], SCHEMA)


def test_rules_and_list_match_brute_force(spark):
    pages = _pages(spark)
    listed = spark.createDataFrame([("x.net/a?a=1&b=2&refer=1",), ("x.net/a?a=1&b=2&refer=1",), (None,)], "c string")
    got = judge_urls(pages, listed, URL_RULES).collect()
    assert len(got) == pages.count()
    urls = {r.page_id: r.url for r in pages.collect()}
    for row in got:
        url = urls[row._id]
        assert (row.host, row.path) == plain_parts(url)
        assert row.listed == (row.canonical == "x.net/a?a=1&b=2&refer=1")
        assert (row.rule, row.verdict) == plain_verdict(url, row.listed)
    assert sum(r.listed for r in got) == 4


def test_canonical_forms(spark):
    rows = spark.createDataFrame([(u,) for u in URLS], "url string").select("url", canonical("url").alias("c"))
    found = {r.url: r.c for r in rows.collect()}
    assert found["HTTP://WWW.Example.ORG/es/1?x=1#y"] == "example.org/es/1?x=1"
    assert found["http://example.org/"] == found["http://example.org"] == "example.org"
    assert found[None] is None and found[""] is None


def test_filter_loses_nothing_and_errs_only_before_the_join(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "MAX_BLOCKS", 4)  # far too small: many false hits
    pages = spark.range(6000).selectExpr("id AS page_id", "concat('http://h', id % 2000, '.net/', id) AS url")
    listed = pages.filter("page_id % 3 = 0").select(canonical("url").alias("c"))
    got = judge_urls(pages, listed)
    assert got.filter(F.col("listed") != (F.col("_id") % 3 == 0)).count() == 0 and got.count() == 6000


def test_blocks_keep_most_others_out(spark):
    keys = spark.range(4000).selectExpr("concat('k', id) AS c")
    bloom = url_filter.bloom_blocks(keys, "c", 256)
    others = spark.range(4000, 24000).selectExpr("concat('k', id) AS c")
    probe = others.withColumn("b", url_filter._block("c", 256)).join(bloom, F.col("b") == F.col("_block"))
    hit = F.lit(True)
    for i, mask in enumerate(url_filter._masks("c")):
        hit = hit & (F.col(f"_w{i}").bitwiseAND(mask) == mask)
    assert probe.filter(hit).count() < 0.03 * 20000


def test_empty_tables(spark):
    none = spark.createDataFrame([], "c string")
    assert judge_urls(_pages(spark).limit(0), none, URL_RULES).count() == 0
    assert judge_urls(_pages(spark), none).filter("verdict <> 'allow'").count() == 0
