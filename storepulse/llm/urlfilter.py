"""URL filter (operator 7): rules on host and path, then a blocked Bloom
filter of listed canonical URLs whose possible hits go to an exact join.

The filter is a table of blocks of eight 64-bit words.  A URL's hash picks its
block and one bit in each word, so one look-up reads one block.  The number of
blocks follows the list (about 16 bits a URL, a power of two); the table is
joined on the block number, so Spark broadcasts it only when it sees that it
is small, and shuffles the distinct URLs otherwise.  Possible hits are joined
with the list itself, which removes false positives.

A null URL, or one without ``://``, has an empty host and path, fits no rule
and is listed nowhere: allow.  Of rules of equal length the first one counts.
Repeated rows are each answered; extra columns pass through, clashing ones
are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storepulse.llm.common import lower_ascii

WORDS = 8
Rule = tuple[str, str, str]  # verdict, host, path


def host_of(url: Column) -> Column:
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    """Host without port and www./m., path without index page, extension and
    closing slash; scheme, query and fragment do not count.  Null for no host."""
    bare = F.regexp_replace(F.regexp_replace(host, r":[0-9]*$", ""), r"^(?:www|m)\.([^.]+\.)", "$1")
    page = F.regexp_replace(F.regexp_replace(path, r"(/index)?\.(html?|php)$", ""), r"/+$", "")
    return F.when(host != "", F.concat(bare, page))


def rule_columns(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits (a short, fixed list)."""
    name = verdict = None
    for kind, at, prefix in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == at) | host.endswith("." + at)) & path.startswith(prefix)
        name = F.when(fits, at + prefix) if name is None else name.when(fits, at + prefix)
        verdict = F.when(fits, kind) if verdict is None else verdict.when(fits, kind)
    return (F.lit(None).cast("string"), F.lit(None).cast("string")) if name is None else (name, verdict)


def _bits(key: Column) -> list[Column]:
    """One bit for each word of the block."""
    h = F.xxhash64(key, F.lit(1))
    return [F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(h, F.lit(i)), F.lit(64)).cast("int"))
            for i in range(WORDS)]


def _block(key: Column, blocks: Column) -> Column:
    return F.pmod(F.xxhash64(key), blocks)


def bloom(listed: DataFrame, key: str = "canonical", bits_per_key: int = 16) -> DataFrame:
    """block, blocks and the words w0..w7 of the filter over ``listed``."""
    size = listed.agg(F.greatest(F.lit(1.0), F.ceil(F.count(key) * bits_per_key / (64 * WORDS)).cast("double")).alias("x")).select(
        F.pow(F.lit(2.0), F.ceil(F.log2("x"))).cast("long").alias("blocks"))
    sized = listed.where(F.col(key).isNotNull()).join(F.broadcast(size))  # one row
    return sized.select("blocks", _block(F.col(key), F.col("blocks")).alias("block"),
                        *[b.alias(f"w{i}") for i, b in enumerate(_bits(F.col(key)))]).groupBy("blocks", "block").agg(
        *[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)])


def judge(pages: DataFrame, listed: DataFrame, rules: list[Rule], url: str = "url") -> DataFrame:
    """pages with host, path, canonical, rule, listed and verdict.  ``listed``
    has distinct or repeated values in its column canonical."""
    listed = listed.select("canonical").where("canonical IS NOT NULL").distinct()
    pages = pages.drop("host", "path", "canonical", "rule", "listed", "verdict")
    parts = pages.withColumn("host", host_of(F.col(url))).withColumn("path", path_of(F.col(url)))
    parts = parts.withColumn("canonical", canonical(F.col("host"), F.col("path")))
    words = bloom(listed)
    blocks = words.agg(F.max("blocks").alias("blocks"))
    asked = parts.select("canonical").where("canonical IS NOT NULL").distinct().join(F.broadcast(blocks))  # one row
    asked = asked.withColumn("block", _block(F.col("canonical"), F.col("blocks"))).drop("blocks")
    hit = None
    for i, b in enumerate(_bits(F.col("canonical"))):
        this = F.col(f"w{i}").bitwiseAND(b) != 0
        hit = this if hit is None else hit & this
    possible = asked.join(words.drop("blocks"), "block").where(hit).select("canonical")
    sure = possible.join(listed, "canonical").select("canonical", F.lit(True).alias("listed"))
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    return (parts.join(sure, "canonical", "left").withColumn("listed", F.coalesce("listed", F.lit(False)))
            .withColumn("rule", rule)
            .withColumn("verdict", F.coalesce(verdict, F.when(F.col("listed"), "block").otherwise("allow"))))
