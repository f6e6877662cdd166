"""URL filters: host and path rules first, then a list of URLs behind a blocked Bloom filter and an exact join.

The Bloom filter is blocked by 64-bit words: a URL's hash picks one word and six bits in it. The words are built by a
summed-up ``bit_or`` per word and have a fixed greatest number, so the side that is broadcast never exceeds
``MAX_WORDS`` rows of two longs, however long the list is; a longer list only lets more pages through to the exact
join, which removes every false positive. Pages that a rule decides or that the filter excludes are never shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, materialize

#: (verdict, host, path)
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Query parameters that say where a visitor came from and not which page is meant.
TRACKING = "^(utm_[^=]*|gclid|dclid|fbclid|msclkid|mc_cid|mc_eid)(=|$)"
#: Sites whose pages the query's list holds, by the label before the registered name.
LISTED_SITES = r"(^|\.)(ads-track|casino-win|cheap-pills|free-bets|spam-farm)\.[^.]+\.[^.]+$"
#: At most so many 64-bit words: 2**20 rows of (long, long), some 32 MB where they are broadcast.
MAX_WORDS = 1 << 20
BITS = 6


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def canonical(url: Column) -> Column:
    """What addresses of one page have in common; null without a host. Scheme and fragment do not count.

    Host: in lower case, without user information, default port, a final dot and a leading ``www.``. Path: hexadecimal
    digits of escapes in upper case, ``.`` and ``..`` resolved, without slashes at its end. Query: its parameters but for
    those that only track visitors, in order.
    """
    host, path = host_of(url), path_of(url)
    plain = F.regexp_replace(F.regexp_replace(host, "^.*@", ""), r"(:(80|443)?)?$", "")
    plain = F.regexp_replace(F.regexp_replace(plain, r"\.$", ""), r"^www\.", "")
    parts = F.split(path, "%", -1)
    escape = lambda x: F.when(x.rlike("^[0-9a-fA-F]{2}"), F.concat(F.upper(F.substring(x, 1, 2)), x.substr(F.lit(3), F.length(x)))).otherwise(x)
    even = F.array_join(F.concat(F.slice(parts, 1, 1), F.transform(F.slice(parts, F.lit(2), F.size(parts)), escape)), "%")
    up = lambda done: F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
    step = lambda done, x: F.when(x == "..", up(done)).when(x == ".", done).otherwise(F.concat(done, F.array(x)))
    # The first segment is empty: the path starts with a slash.
    segments = F.aggregate(F.slice(F.split(even, "/", -1), F.lit(2), F.lit(1 << 30)), F.array().cast("array<string>"), step)
    clean = F.regexp_replace(F.concat(F.lit("/"), F.array_join(segments, "/")), "/+$", "")
    query = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*[^?#]*\?([^#]*)", 1)
    kept = F.array_join(F.array_sort(F.filter(F.split(query, "&", -1), lambda x: (x != "") & ~x.rlike(TRACKING))), "&")
    return F.when(plain != "", F.concat(plain, clean, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise("")))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The rule that fits (host and path joined, else null) and its verdict: the longest, of equal ones the first."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def _word_and_mask(key: Column, words: int) -> tuple[Column, Column]:
    h = F.xxhash64(key)
    bits = [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * k).bitwiseAND(63).cast("int")) for k in range(BITS)]
    mask = bits[0]
    for bit in bits[1:]:
        mask = mask.bitwiseOR(bit)
    return F.shiftrightunsigned(h, 36).bitwiseAND(words - 1), mask


def bloom_words(listed: DataFrame, words: int) -> DataFrame:
    """Rows (word, bits), at most ``words`` of them (a power of two), of the column ``listed_url``."""
    word, mask = _word_and_mask(F.col("listed_url"), words)
    return listed.select(word.alias("word"), mask.alias("mask")).groupBy("word").agg(F.bit_or("mask").alias("bits"))


def filter_urls(pages: DataFrame, listed: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: Sequence[tuple[str, str, str]] = RULES, max_words: int = MAX_WORDS) -> DataFrame:
    """One row per row of ``pages``: the id, host, path, rule, verdict, listed.

    A rule that fits decides. Where none fits, the verdict is block for pages whose canonical URL is one of ``listed``
    (a column ``url``; null, empty and repeated rows do no harm), else allow. Null URLs and those without ``://`` have
    an empty host and path and are allowed. listed is null where a rule decided. Rows that repeat are judged each, and
    alike; with nothing listed the rules alone block; empty tables give no rows. Other columns are ignored.
    """
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    keys = listed.select(canonical(F.col("url")).alias("listed_url")).where("listed_url is not null").distinct()
    keys = materialize(keys, "listed")
    n, words = keys.count(), 1 << 10
    while words < min(max_words, n // 4):  # 16 bits a URL
        words *= 2
    bloom = materialize(bloom_words(keys, words), "bloom")

    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url")).select("id", "url", host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", rule).withColumn("verdict", verdict)
    rows = rows.withColumn("key", F.when(F.col("rule").isNull(), canonical(F.col("url")))).drop("url")
    word, mask = _word_and_mask(F.col("key"), words)
    rows = rows.withColumn("w", word).withColumn("mask", mask)
    # The size of the broadcast side is bounded by max_words.
    rows = rows.join(F.broadcast(bloom), F.col("w") == F.col("word"), "left")
    possible = F.coalesce(F.col("bits").bitwiseAND(F.col("mask")) == F.col("mask"), F.lit(False)) & F.col("key").isNotNull()
    rows = rows.select("id", "host", "path", "rule", "verdict", "key", possible.alias("possible"))

    out = [F.col("id").alias(id_col), "host", "path", "rule"]
    sure = rows.where(~F.col("possible"))
    sure = sure.select(*out, F.coalesce("verdict", F.lit("allow")).alias("verdict"), F.when(F.col("rule").isNull(), F.lit(False)).alias("listed"))
    hits = rows.where("possible").join(keys, F.col("key") == F.col("listed_url"), "left")
    found = F.col("listed_url").isNotNull()
    hits = hits.select(*out, F.when(found, "block").otherwise("allow").alias("verdict"), found.alias("listed"))
    return sure.unionByName(hits)


_HOST = "translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{}', '{}')".format(UPPER, LOWER)
_PATH = "regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1)"
_FITS = " ".join(
    f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{{{i}}}'"
    for i, (_, h, p) in sorted(enumerate(RULES), key=lambda r: -len(r[1][1] + r[1][2]))
)
_PLAIN = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(host, '^.*@', ''), '(:(80|443)?)?$', ''), '\\.$', ''), '^www\\.', '')"
_SEGMENTS = """list_reduce(list_prepend([]::VARCHAR[], list_transform(string_split(array_to_string(
    list_transform(string_split(path, '%'), lambda x, i: CASE WHEN i > 1 AND regexp_matches(x, '^[0-9a-fA-F]{2}') THEN upper(x[1:2]) || x[3:] ELSE x END), '%'), '/')[2:], lambda x: [x])),
    lambda done, x: CASE x[1] WHEN '..' THEN done[1:greatest(len(done) - 1, 0)] WHEN '.' THEN done ELSE list_concat(done, x) END)"""
_QUERY = f"array_to_string(list_sort(list_filter(string_split(regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*[^?#]*\\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '{TRACKING}'))), '&')"
SQL = f"""
WITH urls AS (SELECT page_id, url, {_HOST} AS host, {_PATH} AS path FROM pages),
parts AS (
  SELECT *, CASE {_FITS.format(*(h + p for _, h, p in RULES))} END AS rule, CASE {_FITS.format(*(v for v, _, _ in RULES))} END AS said,
         {_PLAIN} AS plain, {_SEGMENTS} AS segments, {_QUERY} AS query
  FROM urls
),
keys AS (
  SELECT *, CASE WHEN plain <> '' THEN plain || regexp_replace('/' || array_to_string(segments, '/'), '/+$', '') || CASE WHEN query <> '' THEN '?' || query ELSE '' END END AS key
  FROM parts
),
listed AS (SELECT DISTINCT key FROM keys WHERE regexp_matches(host, '{LISTED_SITES}') AND key IS NOT NULL)
SELECT page_id, host, path, rule,
       coalesce(said, CASE WHEN key IN (SELECT key FROM listed) THEN 'block' ELSE 'allow' END) AS verdict,
       CASE WHEN rule IS NULL THEN coalesce(key IN (SELECT key FROM listed), false) END AS listed
FROM keys
"""
