"""URL filters: host and path rules, and a blocked Bloom filter of listed urls before an exact join; DataFrame functions only.

The filter has blocks of four 64-bit words; a canonical url sets one bit of each word of one block. Blocks are
built by ``bit_or`` aggregation and are broadcast: there are ``MAX_BLOCKS`` at most (about 12 MB), however
long the list. Urls that pass the filter are joined with the list by equality, which removes false
positives; a fuller filter lets more urls through to that join and changes nothing else.

A null url, or one without ``://``, has an empty host and path, fits no rule and is allowed. Rows are kept,
repeated ones as well. An empty list blocks nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import table

#: (verdict, host, path) rules of the query (fixed values).
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
#: Words between dots or dashes of a host whose urls the query lists.
LISTED_WORDS = ("spam", "casino", "pills", "bets", "ads", "track")
#: Query parameters that do not change the page (fixed values).
NOISE = r"^(utm_[a-z]+|ref|fbclid|gclid)="
MAX_RULES, MAX_BLOCKS, BITS_PER_URL = 500, 1 << 18, 12
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
QUERY = r"(?s)^.*?://[^?#]*\?([^#]*)"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def canonical(url: Column) -> Column:
    """Host without ``www.``, path without slashes at its end, other parameters sorted; no scheme or fragment. Null without a host."""
    kept = F.array_sort(F.filter(F.split(F.regexp_extract(url, QUERY, 1), "&"), lambda p: (p != "") & ~p.rlike(NOISE)))
    query = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.when(host_of(url) != "", F.concat(F.regexp_replace(host_of(url), r"^www\.", ""), F.regexp_replace(path_of(url), "/+$", ""), query))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits; of equal ones a block comes first."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"at most {MAX_RULES} rules; longer lists belong in the url list")
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r[0] == "block")):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, kind).otherwise(verdict)
    return name, verdict


def block_of(value: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(value), F.lit(blocks)).cast("int")


def bits_of(value: Column) -> list[Column]:
    """One bit for each of the four words of the block, from a second hash."""
    h = F.xxhash64(value, F.lit(1))
    return [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * w).bitwiseAND(F.lit(63).cast("long")).cast("int")) for w in range(4)]


def bloom(listed: DataFrame, blocks: int) -> DataFrame:
    """(block, w0 ... w3) of the column ``url_key``."""
    bits = listed.select(block_of(F.col("url_key"), blocks).alias("block"), *[b.alias(f"w{w}") for w, b in enumerate(bits_of(F.col("url_key")))])
    return bits.groupBy("block").agg(*[F.bit_or(f"w{w}").alias(f"w{w}") for w in range(4)])


def judge(pages: DataFrame, listed: DataFrame, url: str = "url", rules=RULES) -> DataFrame:
    """All columns of ``pages`` with host, path, rule and verdict; ``listed`` holds urls in a column ``url``."""
    known = listed.select(canonical(F.col("url")).alias("url_key")).where("url_key is not null").distinct()
    blocks = 1 << 10
    need = known.count() * BITS_PER_URL // 256
    while blocks < min(need, MAX_BLOCKS):
        blocks *= 2
    host, path = host_of(F.col(f"`{url}`")), path_of(F.col(f"`{url}`"))
    df = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns if c not in ("host", "path", "rule", "verdict")]).alias("_page"), host.alias("_host"), path.alias("_path"), canonical(F.col(f"`{url}`")).alias("url_key"))
    name, verdict = rule_of(F.col("_host"), F.col("_path"), rules)
    df = df.withColumn("_rule", name).withColumn("_verdict", verdict)
    probe = df.where("_rule is null and url_key is not null").withColumn("block", block_of(F.col("url_key"), blocks)).join(F.broadcast(bloom(known, blocks)), "block", "left")
    hit = reduce(lambda a, b: a & b, [F.coalesce(F.col(f"w{w}").bitwiseAND(b) != 0, F.lit(False)) for w, b in enumerate(bits_of(F.col("url_key")))])
    possible = probe.where(hit).join(known.withColumn("_listed", F.lit(True)), "url_key", "left")
    out = ["_page", "_host", "_path", "_rule"]
    rest = df.where("_rule is not null or url_key is null").select(*out, F.coalesce("_verdict", F.lit("allow")).alias("_verdict"))
    got = rest.unionByName(probe.where(~hit).select(*out, F.lit("allow").alias("_verdict"))).unionByName(possible.select(*out, F.when(F.col("_listed"), "block").otherwise("allow").alias("_verdict")))
    return got.select("_page.*", F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_rule").alias("rule"), F.col("_verdict").alias("verdict"))


def listed_urls(pages: DataFrame, url: str = "url", words: tuple[str, ...] = LISTED_WORDS) -> DataFrame:
    """Urls on hosts that have one of the words between dots or dashes."""
    return pages.select(F.col(f"`{url}`").alias("url")).where(host_of(F.col("url")).rlike(rf"(^|[.-])({'|'.join(words)})([.-]|$)"))


def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, listed_urls(pages)).select("page_id", "host", "path", "rule", "verdict")


def oracle() -> str:
    key = "CASE WHEN host <> '' THEN regexp_replace(host, '^www\\.', '') || regexp_replace(path, '/+$', '') || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END END"
    fits = "CASE " + " ".join(
        f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN {{{i}}}" for i, (_, h, p) in enumerate(sorted(RULES, key=lambda r: -len(r[1]) - len(r[2])))
    ) + " END"
    order = sorted(RULES, key=lambda r: -len(r[1]) - len(r[2]))
    rule, verdict = fits.format(*[f"'{h}{p}'" for _, h, p in order]), fits.format(*[f"'{v}'" for v, _, _ in order])
    return f"""
WITH p AS (SELECT page_id, translate(coalesce(regexp_extract(url, '{PARTS}', 1), ''), '{UPPER}', '{LOWER}') AS host, coalesce(regexp_extract(url, '{PARTS}', 2), '') AS path,
       list_sort(list_filter(string_split(coalesce(regexp_extract(url, '{QUERY}', 1), ''), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '{NOISE}'))) AS q FROM pages),
  k AS (SELECT *, {key} AS url_key FROM p),
  listed AS (SELECT DISTINCT url_key FROM k WHERE url_key IS NOT NULL AND regexp_matches(host, '(^|[.-])({'|'.join(LISTED_WORDS)})([.-]|$)'))
SELECT page_id, host, path, {rule} AS rule, coalesce({verdict}, CASE WHEN url_key IN (SELECT url_key FROM listed) THEN 'block' ELSE 'allow' END) AS verdict FROM k"""
