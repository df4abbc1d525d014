"""URL filtering: host rules, and a list of canonical URLs behind a blocked Bloom filter.

The list's 64-bit hashes are set in blocks of eight 32-bit words: a hash picks a block, and one bit in each
word by the word's own hash. A block is one row, built by bit_or, so the filter is a table of blocks that
pages are joined to by block number: broadcast while its computed size is within `broadcast_bytes`, shuffled
beyond. URLs whose eight bits are all set are possible hits; only those go through the exact join with the
list, which removes the false positives. All steps are column expressions. Null URLs and those without a host are on
no list; URLs and pages of any length are taken whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, materialize

WORDS = 8
BITS_PER_URL = 16

# (verdict, host, path): fixed values of the query
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def host_of(url: Column) -> Column:
    """What follows the first :// up to / ? # or the end, with A-Z lower-cased; empty if there is none."""
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """What follows the host up to ? # or the end; empty if there is none."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """One form of the URLs of a page: no scheme, `www.` or `m.`, tracking parameter, fragment or end `/` or `.html`.

    Null for URLs without a host.
    """
    host = F.regexp_replace(host_of(url), r"^(www|m)\.", "")
    path = F.regexp_replace(path_of(url), r"(/|\.html?)$", "")
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: ~p.rlike(r"^(utm_\w+|ref)(=|$)") & (p != "")))
    tail = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit(""))
    return F.when(host != "", F.concat(host, path, tail))


def best_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, or nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, own, start in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(start)
        rule = F.when(fits, F.lit(own + start)).otherwise(rule)
        verdict = F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def hashes(key: Column, blocks: int) -> tuple[Column, Column]:
    """The block of a URL, and its bit in each of the block's words as an array of masks."""
    block = F.pmod(F.xxhash64(key), F.lit(blocks))
    spread = F.xxhash64(F.lit("bits"), key)
    bits = [F.shiftright(spread, 5 * w).bitwiseAND(F.lit(31)).cast("int") for w in range(WORDS)]
    masks = [F.call_function("shiftleft", F.lit(1).cast("long"), bit) for bit in bits]
    return block, F.array(*masks)


def bloom_blocks(listed: DataFrame, blocks: int) -> DataFrame:
    """(block, w0 .. w7) of a table with a column key."""
    block, masks = hashes(F.col("key"), blocks)
    rows = listed.select(block.alias("block"), masks.alias("m"))
    return rows.groupBy("block").agg(*[F.bit_or(F.col("m")[w]).alias(f"w{w}") for w in range(WORDS)])


def listed_pages(pages: DataFrame, listed: DataFrame, url_col: str = "url", broadcast_bytes: int = 8 << 20) -> DataFrame:
    """pages with a column listed: whether the URL's canonical form is one of listed's.

    listed: a table with a string column key; nulls and repeats don't count. Pages without a host are
    not listed. `listed` replaces a column of that name.
    """
    keys = materialize(listed.select("key").where("key is not null").distinct(), "listed")
    n = keys.count()
    blocks = max(1, -(-n * BITS_PER_URL // (32 * WORDS)))
    filter_rows = bloom_blocks(keys, blocks).toDF("_loom_b", *[f"_loom_w{w}" for w in range(WORDS)])
    if blocks * WORDS * 8 <= broadcast_bytes:
        filter_rows = F.broadcast(filter_rows)
    block, masks = hashes(F.col("_loom_key"), blocks)
    named = pages.drop("listed").withColumn("_loom_key", canonical(F.col(url_col)))
    # URLs without a host are dealt over all blocks, lest they meet in one task
    dealt = named.withColumn("_loom_block", F.coalesce(block, F.pmod(F.xxhash64(F.col(url_col), F.rand(7)), F.lit(blocks))))
    probed = dealt.withColumn("_loom_masks", masks).join(filter_rows, F.col("_loom_block") == F.col("_loom_b"), "left")
    hit = F.coalesce(F.expr(" and ".join(f"_loom_w{w} & _loom_masks[{w}] <> 0" for w in range(WORDS))), F.lit(False))
    probed = probed.withColumn("_loom_maybe", hit).select(*[F.col(f"`{c}`") for c in named.columns], "_loom_maybe")
    keep = [F.col(f"`{c}`") for c in pages.columns if c != "listed"]
    clear = probed.where(~F.col("_loom_maybe")).select(*keep, F.lit(False).alias("listed"))
    possible = probed.where("_loom_maybe")
    exact = possible.join(keys.select(F.col("key").alias("_loom_listed"), F.lit(True).alias("_loom_hit")), F.col("_loom_key") == F.col("_loom_listed"), "left")
    return clear.union(exact.select(*keep, F.coalesce("_loom_hit", F.lit(False)).alias("listed")))


def judge_urls(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str, str]] = RULES, url_col: str = "url") -> DataFrame:
    """pages with host, path, rule and verdict: the longest rule's, else block if listed, else allow.

    These four replace columns of those names.
    """
    host, path = host_of(F.col(url_col)), path_of(F.col(url_col))
    found = listed_pages(pages.drop("host", "path", "rule", "verdict"), listed, url_col)
    found = found.withColumns({"host": host, "path": path})
    rule, verdict = best_rule(F.col("host"), F.col("path"), rules)
    other = F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow"))
    return found.withColumns({"rule": rule, "verdict": F.coalesce(verdict, other)}).drop("listed")


# Titles stuffed with symbols, and the size under which a page has hardly any text: fixed values of the query's list
STUFFED = r"<title>[^<]*(###|\*\*\*|%%%|&amp;&amp;)"
THIN = 900


def bad_pages(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """A list by content: the canonical URLs (key) of pages whose title is stuffed or whose html is under THIN bytes.

    What a URL's host is has no part in it; other pages under the same canonical URL are then blocked with it. A
    null html is under no size.
    """
    html = F.col(html_col)
    bad = html.rlike(STUFFED) | (F.octet_length(html) < THIN)
    return pages.where(bad).select(canonical(F.col(url_col)).alias("key"))


SQL = r"""
WITH parts AS (
  SELECT page_id, url, html,
         translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path,
         coalesce(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '') AS query
  FROM pages),
kept AS (
  SELECT *, list_sort(list_filter(string_split(query, '&'),
           lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_\w+|ref)(=|$)'))) AS params FROM parts),
canon AS (
  SELECT *, CASE WHEN host <> '' THEN regexp_replace(host, '^(www|m)\.', '')
           || regexp_replace(path, '(/|\.html?)$', '')
           || CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END END AS key
  FROM kept),
listed AS (
  SELECT DISTINCT key FROM canon
  WHERE regexp_matches(html, '<title>[^<]*(###|\*\*\*|%%%|&amp;&amp;)') OR strlen(html) < 900),
rules(verdict, rh, rp) AS (VALUES
  ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
  ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
ranked AS (
  SELECT c.page_id, c.url, r.rh || r.rp AS rule, r.verdict,
         row_number() OVER (PARTITION BY c.page_id ORDER BY length(r.rh || r.rp) DESC) AS n
  FROM canon c JOIN rules r ON (c.host = r.rh OR ends_with(c.host, '.' || r.rh)) AND starts_with(c.path, r.rp))
SELECT c.page_id, c.host, c.path, r.rule,
       coalesce(r.verdict, CASE WHEN l.key IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM canon c LEFT JOIN ranked r ON c.page_id = r.page_id AND r.n = 1 LEFT JOIN listed l ON c.key = l.key
"""
