"""URL verdicts: host and path rules, and a blocked Bloom filter in front of an exact join with listed URLs. DataFrame functions only.

A listed URL sets one bit in each of the eight words of its block; the block is chosen by one hash and the bits by another. A URL is a possible hit if
all its eight bits are set, and only possible hits go on to the exact hash join that removes false ones. The filter has BITS_PER_URL bits for each listed URL.
It is broadcast while it has at most MAX_BROADCAST_BLOCKS blocks (its size is counted first); beyond that, blocks are joined by a shuffle of 8-byte hashes.

A canonical URL is the host without www. or m., the path without a final slash or .html, and the query without tracking parameters; scheme and
fragment are dropped.

Defined cases: a null URL or one without :// has an empty host and path, no rule and no canonical URL, and is allowed; an empty list or an empty table
gives no hits; repeated URLs and rows each get their verdict; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

BITS_PER_URL = 12
BLOCK_BITS = 256
MAX_BROADCAST_BLOCKS = 1 << 20  # 64 bytes or so each

Rule = tuple[str, str]  # verdict, and host with path


def _lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    return _lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Null for a URL without host."""
    host = F.regexp_replace(host_of(url), r"^(www|m)\.", "")
    path = F.regexp_replace(path_of(url), r"(\.html|/)$", "")
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike("^(utm_[a-z]+|ref)=")), "&")
    return F.when(host != "", F.concat(host, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise("")))


def rule_for(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """The longest rule that fits a host (or a subdomain of it) and the beginning of a path, and its verdict; null if none does."""
    rule = verdict = F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):  # the longest is looked at first
        own, slash, rest = text.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def _block(url: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(blocks))


def _bits(url: Column) -> list[Column]:
    """Eight masks of one bit in 32."""
    h = F.xxhash64(F.lit("bits"), url)
    return [F.call_function("shiftleft", F.lit(1), F.shiftrightunsigned(h, 5 * k).bitwiseAND(F.lit(31)).cast("int")) for k in range(BLOCK_BITS // 32)]


def bloom(listed: DataFrame, blocks: int, column: str = "canonical") -> DataFrame:
    """(block, w0..w7) for the blocks that have a bit set. listed: distinct URLs."""
    words = [F.bit_or(mask).alias(f"w{k}") for k, mask in enumerate(_bits(F.col(column)))]
    return listed.groupBy(_block(F.col(column), blocks).alias("block")).agg(*words)


def judge(pages: DataFrame, listed: DataFrame, rules: list[Rule], key: str = "page_id", url: str = "url") -> DataFrame:
    """(key, host, path, rule, verdict, canonical, listed) of every row. listed: a table with a column `canonical`; its URLs are blocked unless a
    rule says otherwise."""
    listed = listed.select("canonical").dropna().distinct()
    blocks = max(1, -(-listed.count() * BITS_PER_URL // BLOCK_BITS))
    table = bloom(listed, blocks)
    table = F.broadcast(table) if blocks <= MAX_BROADCAST_BLOCKS else table

    rows = pages.select(pages[key].alias("key"), pages[url].alias("url"))
    rows = rows.select("key", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), canonical(F.col("url")).alias("canonical"))
    all_set = F.lit(True)
    for k, mask in enumerate(_bits(F.col("canonical"))):
        all_set = all_set & (F.col(f"w{k}").bitwiseAND(mask) != 0)
    probed = rows.withColumn("block", F.when(F.col("canonical").isNotNull(), _block(F.col("canonical"), blocks))).join(table, "block", "left")
    probed = probed.select("key", "host", "path", "canonical", F.coalesce(all_set, F.lit(False)).alias("possible"))
    # Possible hits go through the exact join, the others around it.
    hits = probed.filter("possible").join(listed.withColumn("listed", F.lit(True)), "canonical", "left").select("key", "host", "path", "canonical", F.coalesce("listed", F.lit(False)).alias("listed"))
    judged = hits.unionByName(probed.filter("not possible").select("key", "host", "path", "canonical", F.lit(False).alias("listed")))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow"))
    return judged.select(F.col("key").alias(key), "host", "path", rule.alias("rule"), F.coalesce(verdict, method).alias("verdict"), "canonical", "listed")
