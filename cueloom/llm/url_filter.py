"""URL filters: host and path rules, and a list of canonical URLs behind a blocked Bloom filter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cueloom.checkpoints import freeze

#: Fixed values: (verdict, host, path), as the query states them.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
#: A block of the filter has 256 bits and is meant for so many URLs, so each has 16 bits and about one in 5,000 others passes.
URLS_PER_BLOCK = 16
#: The filter has 2**MOST_BLOCK_BITS blocks at most, so its broadcast table has a fixed largest size (19 MB of numbers, for four million URLs).
MOST_BLOCK_BITS = 18
LANES = 8
#: Hot listed URLs are spread over so many parts in the exact join.
SALTS = 16
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Query parameters that do not change the page.
TRACKING = r"(?:utm_[a-z]+|ref|fbclid|gclid)=[^&]*"


def _rest(url: Column) -> Column:
    """What follows the first ``://``; null if there is none."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """One spelling per page: no scheme, leading ``www.`` ``m.`` or ``blog.``, fragment, tracking parameters, ``.html`` or last slash; null without ``://``."""
    host = F.regexp_replace(host_of(url), r"^(?:www|m|blog)\.", "")
    path = F.regexp_replace(path_of(url), r"(?:\.html?|/)+$", "")
    query = F.regexp_extract(_rest(url), r"^[^?#]*\?([^#]*)", 1)
    query = F.regexp_replace(F.regexp_replace(query, r"(^|&)" + TRACKING, ""), "^&", "")
    return F.when(_rest(url).isNotNull(), F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def rule_columns(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, like ``net/``, and its verdict; null if none fits."""
    rule = verdict = None
    for said, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, h + p) if rule is None else rule.when(fits, h + p)
        verdict = F.when(fits, said) if verdict is None else verdict.when(fits, said)
    none = F.lit(None).cast("string")
    return (rule, verdict) if rule is not None else (none, none)


def block_bits(n_urls: int) -> int:
    """The filter of n_urls URLs has two to this power blocks."""
    return min(MOST_BLOCK_BITS, max(1, (-(-n_urls // URLS_PER_BLOCK) - 1).bit_length()))


def _block(h: Column, bits: int) -> Column:
    return F.shiftrightunsigned(h, 64 - bits)


def _lane_bits(h: Column) -> list[Column]:
    """One bit of 32 for each of the eight lanes, from successive groups of five bits of the hash."""
    one = F.lit(1).cast("long")
    return [F.call_function("shiftleft", one, F.shiftright(h, 5 * i).bitwiseAND(31).cast("int")) for i in range(LANES)]


def bloom_blocks(canon: DataFrame, bits: int) -> DataFrame:
    """The filter of a table of distinct canonical URLs (column canon): one row per used block of 2**bits, eight lanes."""
    h = F.xxhash64("canon")
    return canon.select(_block(h, bits).alias("block"), *[b.alias(f"lane{i}") for i, b in enumerate(_lane_bits(h))]).groupBy("block").agg(*[F.bit_or(f"lane{i}").alias(f"lane{i}") for i in range(LANES)])


def filter_urls(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str, str]] = RULES, url: str = "url", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """Judge each page's URL: the longest fitting rule decides, else whether its canonical URL is listed.

    listed has a column url. Its canonical URLs are written once and counted, and the filter is made for that many.
    Every page passes the filter where it is read (it is broadcast and cannot grow past 2**MOST_BLOCK_BITS blocks);
    only possible hits are shuffled to an exact join with the list, salted so that one hot URL is spread over SALTS
    tasks. The list may have any size: beyond four million URLs a fuller filter lets more pages through to the exact join. Null URLs, and URLs without ``://``, have empty host and path, match
    no rule and are never listed, so they are allowed. Returns keep, host, path, rule, verdict, canonical_url,
    bloom_hit and listed, one row per page.
    """
    canon = freeze(listed.select(canonical(F.col("url")).alias("canon")).where("canon is not null").distinct(), "listed_urls")
    bits = block_bits(canon.count())
    host, path = host_of(F.col("_url")), path_of(F.col("_url"))
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    judged = pages.select(*keep, F.col(url).alias("_url")).select(*keep, host.alias("host"), path.alias("path"), canonical(F.col("_url")).alias("canonical_url"))
    judged = judged.select("*", rule.alias("rule"), verdict.alias("_said"), F.xxhash64("canonical_url").alias("_h"))
    blocks = bloom_blocks(canon, bits)
    hit = F.col("block").isNotNull()
    for i, bit in enumerate(_lane_bits(F.col("_h"))):
        hit = hit & (F.col(f"lane{i}").bitwiseAND(bit) != 0)
    probed = judged.join(F.broadcast(blocks), _block(F.col("_h"), bits) == F.col("block"), "left").withColumn("bloom_hit", F.coalesce(hit & F.col("canonical_url").isNotNull(), F.lit(False)))
    probed = probed.drop("block", "_h", *[f"lane{i}" for i in range(LANES)])
    salted = canon.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    hits = probed.where("bloom_hit").withColumn("_salt", F.pmod(F.xxhash64(*keep), F.lit(SALTS)).cast("int"))
    exact = hits.join(salted, (F.col("canonical_url") == F.col("canon")) & (hits["_salt"] == salted["_salt"]), "left").withColumn("listed", F.col("canon").isNotNull())
    columns = [*keep, "host", "path", "rule", F.coalesce("_said", F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"), "canonical_url", "bloom_hit", "listed"]
    missed = probed.where("not bloom_hit").withColumn("listed", F.lit(False))
    return exact.select(*columns).unionByName(missed.select(*columns))
