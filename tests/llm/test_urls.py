"""URL filters: cascades against sets, verdicts against a plain version."""
import random
import re

from pyspark.sql import functions as F

from cohortlab.llm import urls

RULES = "host string, path string, verdict string"


def parts_of(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match("[^/?#]*", rest).group()
    return re.sub("[A-Z]", lambda m: m.group().lower(), host), re.match("[^?#]*", rest[len(host):]).group()


def plain(rows, rules, hosts=None, share=urls.SHARE):
    found = []
    for page, url in rows:
        host, path = parts_of(url)
        fits = [(len(h + p), h + p, v) for h, p, v in rules if None not in (h, p) and (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits) if fits else (0, None, None)
        found.append((page, host, path, best[1], best[2]))
    if hosts is None:
        by = {}
        for _, host, _, _, v in found:
            by.setdefault(host, []).append(v)
        hosts = {h for h, v in by.items() if h and "block" in v and v.count("block") * share >= len(v) and "allow" not in v}
    return sorted(((p, h, x, r, v or ("block" if h in hosts else "allow"), h in hosts) for p, h, x, r, v in found), key=repr)


def check(spark, pages, rules, **kw):
    got = urls.judged(pages, spark.createDataFrame(rules, RULES), **kw)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain([tuple(r) for r in pages.select("page_id", "url").collect()], rules)
    assert got.columns == ["page_id", "host", "path", "rule", "verdict", "listed"]


def test_cascade_is_exact_over_its_universe(spark):
    rng = random.Random(1)
    for n, share, pass_bits in ((4000, 0.02, urls.PASS_BITS), (3000, 0.4, urls.PASS_BITS), (600, 0.3, 512), (50, 1.0, urls.PASS_BITS), (50, 0.0, urls.PASS_BITS)):
        rows = [(f"k{i}é", rng.random() < share) for i in range(n)]
        universe = spark.createDataFrame(rows, "key string, listed boolean")
        cascade = urls.build(universe, pass_bits)
        assert (len(cascade.levels) > 1) == (pass_bits == 512)
        out = cascade.flagged(universe, {"found": F.col("key")})
        assert out.where("found IS DISTINCT FROM listed").count() == 0
        if share == 0.4:
            assert len(cascade.levels[0]) >= 3  # listed keys, false positives and their false positives
    assert urls.build(universe.limit(0)).flagged(universe, {"found": F.col("key")}).where("found").count() == 0


def test_verdicts_of_the_table(spark, sf):
    check(spark, spark.read.parquet(f"{sf}/pages.parquet"), urls.RULES)


def test_odd_urls_and_rules(spark):
    found = ["http://a.net", "http://a.net/", "http://NET/x", "http://xnet/", "http://x.example.net/en/1?q#f", "http://example.net/en", "https://É.Example.NET/en/?a", "http://www.example.com/de/x", "http://www.example.com/it/x",
             "http://notexample.com/de/", "http://b.org/fr/", "b.org/fr/", "://org/fr/x://net/", "http://?x", "http://#", "", None, "http:///path", "http://a..net/é\n/x?y", "http://net:80/", "x" * 50000, "http://" + "a." * 3000 + "net/" + "p" * 9000,
             "http://www.example.com/it/x", "http://www.example.com/de/y", "http://net./", "http://c.example.com#/de/"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(found)] + [(None, "http://a.net/z"), (3, "http://a.net/z"), (3, "http://a.net/z")], "page_id long, url string")
    pages = pages.select("*", *[F.lit("x").alias(c) for c in ("host", "path", "rule", "verdict", "key", "listed", "html", "rest", "best", "_k0")])
    check(spark, pages, urls.RULES)
    check(spark, pages, urls.RULES, pass_bits=8)
    check(spark, pages, [("net", "/", "allow"), ("net", "/", "block"), ("", "", "block"), (None, "/", "block"), ("a.net", "/z", "allow"), ("a.net", "/", "block"), ("com", "/de", "allow")])
    check(spark, pages.limit(0), urls.RULES)
    assert urls.judged(pages, spark.createDataFrame([], RULES)).where("rule IS NOT NULL OR verdict <> 'allow'").count() == 0
    named = urls.judged(pages, spark.createDataFrame(urls.RULES, RULES), spark.createDataFrame([("b.org",), (None,), ("xnet",), ("nowhere",)], "host string"))
    got = [tuple(r) for r in named.collect()]
    assert sorted(got, key=repr) == plain([tuple(r) for r in pages.select("page_id", "url").collect()], urls.RULES, {"b.org", "xnet", "nowhere"})


def test_no_join_and_no_python_in_the_plan(spark, sf):
    df = urls.judged(spark.read.parquet(f"{sf}/pages.parquet"), spark.createDataFrame(urls.RULES, RULES))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Python" not in plan and "Arrow" not in plan
