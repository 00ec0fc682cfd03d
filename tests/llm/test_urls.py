import random
import re

from pyspark.sql import functions as F

from lodestone.llm import urls

_RULES = "host string, path string, verdict string"


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url[url.index("://") + 3 :]
    host = re.match("[^/?#]*", rest).group()
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    return lower, re.match("[^?#]*", rest[len(host) :]).group()


def judged(url, rules):
    host, path = parts(url)
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if url and "://" in url and (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[2:] if fits else (None, None)


URLS = [
    None, "", "no scheme.org/", "http://", "://org/", "http://ORG/", "https://a.example.org/es/x", "https://example.org/es", "http://EXAMPLE.org/en/1?x=/es/", "http://example.org/en/2", "http://notexample.org/es/",
    "http://xorg/", "https://example.com/fr/#t", "https://example.com/de/", "https://example.com", "http://a.com?/fr/", "http://é.com/fr/É", "http://org:80/x", "http://user@org/x", "ftp://a..org//", "http://example.net/fr/1", "x://y://org/", "http://org\n/", "http://a.org/" + "y/" * 5000,
]


def test_rules_on_odd_urls(spark):
    rows = [(k, u) for k, u in enumerate(URLS)] + [(0, URLS[6]), (None, URLS[6])]
    df = spark.createDataFrame(rows, "page_id long, url string").withColumns({"host": F.lit("x"), "key": F.lit(1), "rule": F.lit(None).cast("string")})
    found = urls.judge(df, spark.createDataFrame(urls.RULES, _RULES))
    want = sorted(((k, *parts(u), *((r, v) if (r := judged(u, urls.RULES)[0]) and (v := judged(u, urls.RULES)[1]) else (None, "allow"))) for k, u in rows), key=str)
    assert sorted((tuple(r)[:5] for r in found.collect()), key=str) == want
    assert urls.judge(df.where("page_id > 999"), spark.createDataFrame(urls.RULES, _RULES)).count() == 0


def test_many_rules_of_many_shapes_as_brute_force(spark):
    draw = random.Random(3)
    name = lambda n: ".".join(draw.choice(["a", "b", "cc"]) for _ in range(n))
    tail = lambda n: "".join(draw.choice(["/", "x", "yy"]) for _ in range(n))
    rules = list({(h, p): (h, p, v) for h, p, v in ((name(draw.randrange(1, 5)), draw.choice(["", "/"]) + tail(draw.randrange(5)), draw.choice(["allow", "block"])) for _ in range(400))}.values())
    rules = [r for r in rules if r[1] == "" or r[1].startswith("/")]
    rows = [(k, f"http://{name(draw.randrange(1, 6))}/{tail(draw.randrange(9))}") for k in range(1500)]
    found = urls.judge(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(rules, _RULES))
    got = {r["id"]: (r["rule"], r["verdict"]) for r in found.collect()}
    for k, u in rows:
        rule, verdict = judged(u, rules)
        assert got[k] == (rule, verdict or "allow"), u


def test_listed_urls_block_in_all_their_spellings_and_no_others(spark):
    listed = spark.createDataFrame([("http://A.net/x/?b=1&a=2",), ("https://c.net",), (None,), ("nothing",), ("http://example.com/fr/z",)], "url string")
    rows = {
        "https://a.net:443/x?a=2&utm_source=q&b=1#top": "block", "http://u@a.net/x.html?a=2&b=1": "block", "http://a.net/x": "allow", "http://b.a.net/x?a=2&b=1": "allow",
        "http://c.net/?ref=1": "block", "http://c.net/d": "allow", "nothing": "allow", "http://example.com/fr/z": "allow", "http://example.com/de/z": "block",
    }
    df = spark.createDataFrame([(k, u) for k, u in enumerate(rows)], "page_id long, url string")
    found = urls.judge(df, spark.createDataFrame(urls.RULES, _RULES), listed)
    assert [r["verdict"] for r in found.orderBy("id").collect()] == list(rows.values())
    none = urls.judge(df, spark.createDataFrame([], _RULES))
    assert {r["verdict"] for r in none.collect()} == {"allow"}


def test_the_filter_passes_every_listed_key_and_few_others(spark):
    keys = spark.range(20000).select(F.concat(F.lit("u:site"), "id").alias("key"))
    blocks = 20000 // urls.KEYS_A_BLOCK
    filled = urls.bloom(keys, blocks)
    assert urls.possible(keys, filled, blocks).count() == 20000
    assert urls.possible(spark.range(20000).select(F.concat(F.lit("u:other"), "id").alias("key")), filled, blocks).count() < 60
    # A filter that is far too small passes all and still loses none.
    assert urls.possible(keys, urls.bloom(keys, 1), 1).count() == 20000


def test_the_query_moves_no_page_text_and_runs_no_python(spark):
    found = urls.op12_bloom_url_filter(spark, "/root/testdata/sf0.001")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "html" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
    assert found.count() == 50
