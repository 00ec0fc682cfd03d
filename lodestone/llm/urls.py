"""URL filters: rules on hosts and paths, and a list of URLs, by a blocked Bloom filter and an exact hash join.

Rules and listed URLs are one table of canonical keys. A URL has a few keys of its own: its canonical form, and for each
shape of rule (labels of the host, characters of the path) its host's last labels with its path's first characters. The
keys that the filter passes go to an exact hash join with the table, which removes false positives. All of it is DataFrame
functions; distinct URLs are judged once and joined back to their rows.

The filter has 512-bit blocks, 16 bits a key, a bit in each of a block's eight words: about one in 1,500 absent keys passes. It is
broadcast, so its blocks are bounded; with more keys than that is room for, more pass, and the join still decides.

Defined results: a URL that is null or has no ``://`` has an empty host and path, fits no rule and is on no list; of several rules that
fit, the one with the most characters wins, of equally long ones that with the longer host; where one rule both allows and blocks, it
blocks; a URL without a rule is blocked if listed and allowed if not; rows that repeat are judged alike, each for
itself; an empty table has no rows; columns of other names are not read. Without rules or listed URLs, all is allowed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, table

#: Fixed values of the rules: host and path, and what they say.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
#: Words of 64 bits of a block, listed keys for a block, and blocks at most (16 MB of rows).
WORDS, KEYS_A_BLOCK, MOST_BLOCKS = 8, 32, 1 << 17
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Query parameters that say where a visitor came from; names beginning with utm_ count too.
TRACKING = ["fbclid", "gclid", "ref"]


def _rest(url: Column) -> Column:
    """What follows the first ``://``, or null."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), _UPPER, _LOWER), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Host without user and standard port, path without its last slashes and ``.html``, parameters sorted without those of tracking; null without ``://``."""
    at = F.regexp_replace(F.regexp_replace(host(url), "^[^@]*@", ""), ":(80|443)?$", "")
    query = F.regexp_extract(_rest(url), r"^[^?#]*\?([^#]*)", 1)
    told = F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike("^(utm_[^=]*|" + "|".join(TRACKING) + ")(=|$)"))
    asked = F.array_join(F.sort_array(told), "&")
    whole = F.concat(at, F.regexp_replace(path(url), r"(\.html|/+)$", ""), F.when(asked != "", F.concat(F.lit("?"), asked)).otherwise(""))
    return F.when(_rest(url).isNotNull(), whole)


def _labels(name: Column) -> Column:
    return F.length(name) - F.length(F.replace(name, F.lit("."), F.lit(""))) + 1


def listing(rules: DataFrame, listed: DataFrame | None = None) -> DataFrame:
    """(key, rule, size, host_size, labels, path_size, verdict) of rules (host, path, verdict) and listed URLs (url); one row a key."""
    name, start = F.translate(F.coalesce("host", F.lit("")), _UPPER, _LOWER), F.coalesce("path", F.lit(""))
    keys = rules.select(F.concat(F.lit("r:"), name, F.lit(" "), start).alias("key"), F.concat(name, start).alias("rule"), F.length(name).alias("host_size"), _labels(name).alias("labels"), F.length(start).alias("path_size"), "verdict")
    keys = keys.groupBy("key", "rule", "host_size", "labels", "path_size").agg(F.max("verdict").alias("verdict"))
    if listed is not None:
        known = listed.select(canonical(F.col("url")).alias("c")).where("c IS NOT NULL").distinct()
        null = [F.lit(None).cast(t).alias(n) for n, t in (("rule", "string"), ("host_size", "int"), ("labels", "int"), ("path_size", "int"))]
        keys = keys.unionByName(known.select(F.concat(F.lit("u:"), "c").alias("key"), *null, F.lit("block").alias("verdict")))
    return keys


def _bits(key: Column) -> list[Column]:
    """The bit in each word of a block."""
    second = F.xxhash64(key, F.lit(1))
    return [F.shiftrightunsigned(second, 6 * k).bitwiseAND(F.lit(63)).cast("int") for k in range(WORDS)]


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def bloom(keys: DataFrame, blocks: int) -> DataFrame:
    """(block, w0 .. w7): the blocks of the filter that hold any key."""
    words = [F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias(f"w{k}") for k, bit in enumerate(_bits(F.col("key")))]
    return keys.groupBy(_block(F.col("key"), blocks).alias("block")).agg(*words)


def possible(asked: DataFrame, filled: DataFrame, blocks: int) -> DataFrame:
    """The rows of ``asked`` (with a column key) that the filter passes; they are not moved."""
    probe = asked.withColumn("block", _block(F.col("key"), blocks)).withColumns({f"b{k}": bit for k, bit in enumerate(_bits(F.col("key")))})
    hit = reduce(lambda a, b: a & b, [F.call_function("shiftrightunsigned", F.col(f"w{k}"), F.col(f"b{k}")).bitwiseAND(F.lit(1).cast("long")) == 1 for k in range(WORDS)])
    return probe.join(F.broadcast(filled), "block").where(hit).select(*asked.columns)


def _asked(shapes: list[tuple[int, int]]) -> Column:
    """The keys of a URL: its canonical form, and those of rules of each shape (labels, path characters) that it is large enough for."""
    held = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(size).alias("size")) for n, size in shapes]) if shapes else F.expr("array()").cast("array<struct<n:int,size:int>>")

    def key(s: Column) -> Column:
        fits = (F.col("labels") >= s["n"]) & (F.length("path") >= s["size"])
        return F.when(fits, F.concat(F.lit("r:"), F.call_function("substring_index", F.col("host"), F.lit("."), -s["n"]), F.lit(" "), F.call_function("substring", F.col("path"), F.lit(1), s["size"])))

    return F.filter(F.concat(F.array(F.concat(F.lit("u:"), "canonical")), F.transform(held, key)), lambda k: k.isNotNull())


def judge(pages: DataFrame, rules: DataFrame, listed: DataFrame | None = None, *, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict, listed) of every row of ``pages``."""
    keys = table(listing(rules, listed), "url-keys")
    blocks = max(1, min(MOST_BLOCKS, keys.count() // KEYS_A_BLOCK))
    filled = table(bloom(keys, blocks), "url-bloom")
    shaped = keys.where("rule IS NOT NULL").select("labels", "path_size").distinct()
    # At most the labels of a host times the characters of a path, and in fact a few.
    shapes = [tuple(r) for r in shaped.orderBy("labels", "path_size").collect()]

    urls = pages.select(F.col(url_col).alias("url")).where("url IS NOT NULL").distinct()
    urls = urls.select("url", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), canonical(F.col("url")).alias("canonical"))
    urls = urls.withColumn("labels", _labels(F.col("host"))).where("canonical IS NOT NULL")
    asked = urls.select("url", F.explode(_asked(shapes)).alias("key"))
    hits = possible(asked, filled, blocks)
    held = keys.hint("shuffle_hash").select("key", F.struct(F.length("rule").alias("size"), "host_size", "rule", "verdict").alias("k"))
    best = hits.join(held, "key").groupBy("url").agg(F.max(F.when(F.col("k.rule").isNotNull(), F.col("k"))).alias("r"), F.bool_or(F.col("k.rule").isNull()).alias("listed"))
    best = table(best.select("url", F.col("r.rule").alias("rule"), F.col("r.verdict").alias("said"), "listed"), "url-verdicts")
    discard(keys, filled)

    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")).join(best, "url", "left")
    on_list = F.coalesce("listed", F.lit(False))
    verdict = F.coalesce("said", F.when(on_list, "block").otherwise("allow"))
    return rows.select("id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), "rule", verdict.alias("verdict"), on_list.alias("listed"))


def several_spellings(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """(url) of a spelling of each canonical URL that the rows spell in several ways."""
    spelt = pages.select(F.col(url_col).alias("url")).where("url IS NOT NULL").distinct()
    spelt = spelt.groupBy(canonical(F.col("url")).alias("c")).agg(F.min("url").alias("lo"), F.max("url").alias("hi"))
    return spelt.where("c IS NOT NULL AND lo <> hi").select(F.col("lo").alias("url"))


def op12_bloom_url_filter(spark, sf_dir: str) -> DataFrame:
    """Pages by the rules; the list is of the URLs that the pages spell in several ways, as such pages are copies of each other."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    rules = spark.sql(f"SELECT * FROM VALUES {_values()} AS v(host, path, verdict)")
    found = judge(pages, rules, several_spellings(pages))
    return found.withColumnRenamed("id", "page_id")


def _values() -> str:
    return ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)


ORACLE = f"""
WITH p AS (SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substring(url, strpos(url, '://') + 3) END AS rest FROM pages),
q AS (SELECT page_id, url, rest, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}'), '') AS host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path,
  list_sort(list_filter(string_split(regexp_extract(rest, '^[^?#]*\\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[^=]*|{"|".join(TRACKING)})(=|$)'))) AS told FROM p),
c AS (SELECT *, CASE WHEN rest IS NOT NULL THEN regexp_replace(regexp_replace(host, '^[^@]*@', ''), ':(80|443)?$', '') || regexp_replace(path, '(\\.html|/+)$', '') || CASE WHEN len(told) > 0 THEN '?' || array_to_string(told, '&') ELSE '' END END AS canonical FROM q),
l AS (SELECT canonical FROM c WHERE canonical IS NOT NULL GROUP BY canonical HAVING count(DISTINCT url) > 1),
r AS (SELECT * FROM (VALUES {_values()}) AS v(rhost, rpath, rverdict)),
f AS (SELECT c.page_id, c.url, c.host, c.path, c.canonical, rhost || rpath AS rule, rverdict, row_number() OVER (PARTITION BY c.page_id, c.url ORDER BY length(rhost || rpath) DESC, length(rhost) DESC) AS place
  FROM c LEFT JOIN r ON rest IS NOT NULL AND (c.host = rhost OR ends_with(c.host, '.' || rhost)) AND starts_with(c.path, rpath))
SELECT page_id, host, path, rule, coalesce(rverdict, CASE WHEN l.canonical IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict, l.canonical IS NOT NULL AS listed
FROM f LEFT JOIN l ON f.canonical = l.canonical WHERE place = 1
"""
