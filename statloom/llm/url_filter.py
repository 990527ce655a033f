"""URL filters: rules by host and path, and a blocked Bloom filter of listed URLs.

The list's canonical URLs fill a blocked Bloom filter, held as a table with one
row per block of eight 32-bit words. A URL probes its one block; only possible
hits reach the exact hash join with the list, which removes false positives.
DataFrame functions only.

Defined results: a null URL, or one without ``://``, has an empty host and path
and is never listed; empty tables give empty results; repeated rows are judged
one by one; only the id and URL columns of the input are read.
"""

from __future__ import annotations

import string
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh

WORDS = 8
BITS_PER_KEY = 16
#: Tables of up to this many bytes, as counted, are sent to all tasks; larger ones are joined by shuffle, with the same result.
BROADCAST_BYTES = 16 << 20
#: Bytes of a block of the filter as a row.
BLOCK_BYTES = 100
#: Keys that rows without a possible hit take in a shuffled join, so that they don't meet.
SPREAD = 4096

#: Rules as (host, path, verdict).
RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)
#: Site names whose pages the query's list holds.
LISTED_SITES = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ``://``."""
    rest = F.coalesce(_rest(url), F.lit(""))
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest.substr(F.length(raw) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(raw, string.ascii_uppercase, string.ascii_lowercase), path


def canonical(host: Column, path: Column) -> Column:
    """Host without leading ``www.``/``m.``/``blog.``, and the path without its ending; no scheme, query or fragment."""
    site = F.regexp_replace(host, r"^(www|m|blog)\.", "")
    return F.concat(site, F.regexp_replace(F.regexp_replace(path, r"/+$", ""), r"\.html?$", ""))


def rule_for(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> tuple[Column, Column]:
    """The longest fitting rule (host and path joined) and its verdict, or nulls. ``rules`` is a short, stated list."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("long")


def _mask(key: Column, word: int) -> Column:
    bit = F.shiftright(F.xxhash64(key, F.lit("bits")), 5 * word).bitwiseAND(F.lit(31).cast("long")).cast("int")
    return F.call_function("shiftleft", F.lit(1), bit)


def bloom_filter(keys: DataFrame, column: str, n_keys: int) -> tuple[DataFrame, int]:
    """Blocked filter of ``keys``: (block, w0..w7), and the number of blocks."""
    blocks = max(1, -(-n_keys * BITS_PER_KEY // (32 * WORDS)))
    key = F.col(column)
    return keys.groupBy(_block(key, blocks).alias("block")).agg(*(F.bit_or(_mask(key, w)).alias(f"w{w}") for w in range(WORDS))), blocks


def listed(rows: DataFrame, column: str, urls: DataFrame, out: str = "listed") -> DataFrame:
    """``rows`` with a boolean ``out``: is ``column`` in ``urls`` (one string column)?

    Null and empty values are never listed.
    """
    out_, block_, hit_, listed_ = fresh(rows, out, "_block", "_hit", "_listed")
    urls = urls.select(F.col(urls.columns[0]).alias(listed_)).where(F.col(listed_) != "").distinct()
    n, size = urls.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(listed_)), F.lit(0))).first()
    if n == 0:
        return rows.withColumn(out_, F.lit(False))
    small = lambda df, width: F.broadcast(df) if width <= BROADCAST_BYTES else df
    blocks, n_blocks = bloom_filter(urls, listed_, n)
    key = F.coalesce(F.col(column), F.lit(""))
    blocks = blocks.select(F.col("block").alias(block_), F.array(*(f"w{w}" for w in range(WORDS))).alias(hit_))
    # an empty key probes a block of its own choice, so that many of them don't meet
    at = F.when(key != "", _block(key, n_blocks)).otherwise(-1 - F.pmod(F.monotonically_increasing_id(), F.lit(SPREAD)))
    probed = rows.withColumn(block_, at).join(small(blocks, n_blocks * BLOCK_BYTES), block_, "left")
    hit = reduce(lambda a, b: a & b, (F.col(hit_)[w].bitwiseAND(_mask(key, w)) != 0 for w in range(WORDS)))
    # only possible hits can find their URL; the others' keys equal none
    probe = F.when(F.coalesce(hit, F.lit(False)), key).otherwise(F.concat(F.lit("\0"), F.pmod(F.monotonically_increasing_id(), F.lit(SPREAD))))
    probed = probed.withColumn(hit_, probe)
    found = probed.join(small(urls, size + 16 * n), F.col(hit_) == F.col(listed_), "left")
    return found.select(*rows.columns, F.col(listed_).isNotNull().alias(out_))


def judge(pages: DataFrame, urls: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, canonical_url and listed of every row; ``urls`` holds canonical URLs."""
    host, path = host_path(F.col("_url"))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("_url")).select("page_id", host.alias("host"), path.alias("path"))
    rows = rows.withColumn("canonical_url", canonical(F.col("host"), F.col("path")))
    rows = listed(rows, "canonical_url", urls)
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    return rows.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"), "canonical_url", "listed")


def site_urls(pages: DataFrame, sites: tuple[str, ...] = LISTED_SITES, url_col: str = "url") -> DataFrame:
    """Canonical URLs of the pages of the named sites: the list that the query uses."""
    host, path = host_path(F.col("url"))
    rows = pages.select(F.col(url_col).alias("url")).select(host.alias("host"), path.alias("path"))
    return rows.where(F.regexp_replace("host", r"^(www|m|blog)\.", "").rlike("^(" + "|".join(sites) + r")\.")).select(canonical(F.col("host"), F.col("path")).alias("canonical_url"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import table

    pages = table(spark, sf_dir, "pages")
    return judge(pages, site_urls(pages))


_RULE_FIT = "(host = '{h}' OR suffix(host, '.{h}')) AND starts_with(path, '{p}')"
_CASES = lambda what: " ".join(f"WHEN {_RULE_FIT.format(h=h, p=p)} THEN '{h + p if what == 'rule' else v}'" for h, p, v in sorted(RULES, key=lambda r: -len(r[0] + r[1])))
OP2_SQL = f"""
WITH a AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, coalesce(rest, '') AS rest, regexp_extract(coalesce(rest, ''), '^[^/?#]*', 0) AS raw FROM a),
c AS (
  SELECT page_id, translate(raw, '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS host,
         regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*', 0) AS path FROM b),
d AS (
  SELECT *, regexp_replace(host, '^(www|m|blog)\\.', '') AS site FROM c),
e AS (
  SELECT *, site || regexp_replace(regexp_replace(path, '/+$', ''), '\\.html?$', '') AS canonical_url FROM d),
l AS (SELECT DISTINCT canonical_url AS u FROM e WHERE regexp_matches(site, '^({"|".join(LISTED_SITES)})\\.') AND canonical_url <> '')
SELECT page_id, host, path, CASE {_CASES("rule")} ELSE NULL END AS rule,
       CASE {_CASES("verdict")} WHEN u IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict,
       canonical_url, u IS NOT NULL AS listed
FROM e LEFT JOIN l ON e.canonical_url = l.u
"""
