"""URL filter: host and path rules, then a list of canonical URLs behind a blocked Bloom filter.

A listed URL sets a few bits in one block of four 64-bit words. The blocks are built as
an aggregate (``bit_or`` by block), and their number is bounded by ``max_blocks``: a
longer list fills them more, which lets more pages through to the exact join but never
loses one. So the filter may be broadcast at any size of list and pages. Pages whose
bits are all set join the list by their canonical URL; that removes false positives.

Edge cases: a null URL or one without ``://`` has empty host and path, fits no rule and
is never listed; repeated rows and null ids are judged row by row; an empty list blocks
nothing; empty pages give an empty result. Further columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.registry import query, table
from corpusloom.storage import stage

#: 131,072 blocks of 32 bytes: a broadcast of 4 MB of bits whatever the list's length.
MAX_BLOCKS = 1 << 17
BITS_PER_URL = 16


@dataclass(frozen=True)
class HostRule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | host.endswith("." + self.host)) & path.startswith(self.path)


RULES = (
    HostRule("allow", "org", "/"), HostRule("block", "example.org", "/es/"),
    HostRule("block", "example.org", "/en/1"), HostRule("allow", "com", "/fr/"),
    HostRule("block", "com", "/de/"),
)
#: Pages whose html holds three such symbols in a row make up the list of the registered query.
JUNK = "[#$%*]{3}"


def _lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    return _lower(F.coalesce(F.regexp_extract(url, r"^(?s)(?:.*?)://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s)(?:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    """Host without ``www.``, path without a last slash; scheme, query and fragment go."""
    return F.concat(F.regexp_replace(host, r"^www\.", ""), F.regexp_replace(path, r"/$", ""))


def matching_rule(host: Column, path: Column, rules: Sequence[HostRule], value: str) -> Column:
    """``value`` (``name`` or ``verdict``) of the longest rule that fits, or null."""
    ordered = sorted(rules, key=lambda r: (-len(r.name), r.name))
    return F.coalesce(F.lit(None).cast("string"), *[
        F.when(r.fits(host, path), F.lit(getattr(r, value))) for r in ordered])


def _block(url: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(blocks)).cast("int")


def _words(url: Column) -> list[Column]:
    """Two bits in each of the block's four words, from four independent hashes."""
    out = []
    for i in range(4):
        h = F.xxhash64(url, F.lit(i + 1))
        low = F.pmod(h, F.lit(64)).cast("int")
        high = F.pmod(F.shiftright(h, 32), F.lit(64)).cast("int")
        out.append(F.call_function("shiftleft", F.lit(1).cast("long"), low).bitwiseOR(
            F.call_function("shiftleft", F.lit(1).cast("long"), high)))
    return out


def blocked_bloom(listed: DataFrame, url: str, max_blocks: int = MAX_BLOCKS) -> tuple[DataFrame, int]:
    """Blocks (``block``, ``w0`` .. ``w3``) of the listed URLs and the number of blocks."""
    needed = listed.count() * BITS_PER_URL // 256 + 1
    blocks = min(needed, max_blocks)
    words = _words(F.col(url))
    bits = listed.where(F.col(url).isNotNull()).select(
        _block(F.col(url), blocks).alias("block"), *[w.alias(f"w{i}") for i, w in enumerate(words)])
    return bits.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(4)]), blocks


def url_filter(pages: DataFrame, listed: DataFrame, rules: Sequence[HostRule] = RULES,
               key: str = "page_id", url: str = "url", listed_url: str = "canonical_url",
               max_blocks: int = MAX_BLOCKS) -> DataFrame:
    """``key``, host, path, rule, canonical_url, listed and verdict of each page.

    ``listed`` holds canonical URLs (as ``canonical`` gives them) in ``listed_url``.
    """
    named = stage(listed.select(F.col(listed_url).alias("_l")).where("_l IS NOT NULL").distinct())
    bloom, blocks = blocked_bloom(named, "_l", max_blocks)
    raw = pages.select(F.col(key).alias("_k"), host_of(F.col(url)).alias("_host"),
                       path_of(F.col(url)).alias("_path"))
    judged = raw.select(
        "*", F.nullif(canonical(F.col("_host"), F.col("_path")), F.lit("")).alias("_url"),
        matching_rule(F.col("_host"), F.col("_path"), rules, "name").alias("_rule"),
        matching_rule(F.col("_host"), F.col("_path"), rules, "verdict").alias("_ruled"))
    # At most max_blocks rows of five numbers: bounded whatever the data.
    probe = F.broadcast(bloom.select(F.col("block").alias("_b"), *[f"w{i}" for i in range(4)]))
    words = _words(F.col("_url"))
    hit = F.col("_b").isNotNull()
    for i, w in enumerate(words):
        hit = hit & (F.col(f"w{i}").bitwiseAND(w) == w)
    probed = judged.join(probe, _block(F.col("_url"), blocks) == F.col("_b"), "left").select(
        *judged.columns, F.coalesce(hit, F.lit(False)).alias("_hit"))
    passed = probed.where("NOT _hit").select(*judged.columns, F.lit(False).alias("_listed"))
    found = probed.where("_hit").join(named, F.col("_url") == F.col("_l"), "left").select(
        *judged.columns, F.col("_l").isNotNull().alias("_listed"))
    return passed.unionByName(found).select(
        F.col("_k").alias(key), F.col("_host").alias("host"), F.col("_path").alias("path"),
        F.col("_rule").alias("rule"), F.col("_url").alias("canonical_url"),
        F.col("_listed").alias("listed"),
        F.coalesce("_ruled", F.when(F.col("_listed"), "block").otherwise("allow")).alias("verdict"))


_SQL = rf"""
WITH p AS (SELECT page_id, html,
    coalesce(regexp_extract(url, '^(?s).*?://([^/?#]*)', 1), '') AS h0,
    coalesce(regexp_extract(url, '^(?s).*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
h AS (SELECT page_id, html, path, translate(h0, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host FROM p),
c AS (SELECT *, regexp_replace(host, '^www\.', '') || regexp_replace(path, '/$', '') AS url,
    CASE WHEN (host = 'example.org' OR host LIKE '%.example.org') AND path LIKE '/en/1%' THEN 'example.org/en/1'
         WHEN (host = 'example.org' OR host LIKE '%.example.org') AND path LIKE '/es/%' THEN 'example.org/es/'
         WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/de/%' THEN 'com/de/'
         WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/fr/%' THEN 'com/fr/'
         WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/%' THEN 'org/' END AS rule FROM h),
listed AS (SELECT DISTINCT url FROM c
    WHERE url <> '' AND regexp_matches(html, '{JUNK}'))
SELECT page_id, host, path, rule,
  CASE rule WHEN 'example.org/en/1' THEN 'block' WHEN 'example.org/es/' THEN 'block'
    WHEN 'com/de/' THEN 'block' WHEN 'com/fr/' THEN 'allow' WHEN 'org/' THEN 'allow'
    ELSE CASE WHEN url IN (SELECT url FROM listed) THEN 'block' ELSE 'allow' END END AS verdict
FROM c"""


def listed_pages(pages: DataFrame) -> DataFrame:
    """The canonical URLs of pages full of symbols: the list of the registered query.

    No host is named, so it takes the join to tell listed pages from others of their host.
    """
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    return pages.where(F.col("html").rlike(JUNK)).select(
        F.nullif(canonical(host, path), F.lit("")).alias("canonical_url"))


@query("op9_url_filter", _SQL)
def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_filter(pages, listed_pages(pages)).select("page_id", "host", "path", "rule", "verdict")
