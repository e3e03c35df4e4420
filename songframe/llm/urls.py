"""URL filters: path rules, and a list behind a blocked Bloom filter.

All of it is column expressions and joins. The list's canonical URLs set one bit in each of four
64-bit words of a block; a page's URL looks at one block. Only possible hits meet the list itself, in
an exact join that removes the false positives.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from songframe.llm.storage import Workspace

#: The fixed rules of the production query: verdict, host and path.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Query parameters that name no resource.
TRACKING = r"^(utm_[^=]*|fbclid|gclid|ref)(=|$)"
#: Bits of the filter per listed URL; about one false positive in 200.
BITS = 16
#: Hosts whose pages make up the production list: advertising, gambling, pills, spam and adult families.
LISTED_HOSTS = r"(^|\.)(ads-track|casino-win|free-bets|cheap-pills|spam-farm|adult-x)\."

_WORDS = 4


def _lower(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def host(url: Column) -> Column:
    """From the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without it."""
    return _lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Host, path without a final slash, and the sorted parameters that name the resource."""
    asked = F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(asked, "&"), lambda p: ~p.rlike(TRACKING) & (p != "")))
    place = F.concat(host(url), F.regexp_replace(path(url), "/+$", ""))
    return F.coalesce(F.when(F.size(kept) > 0, F.concat(place, F.lit("?"), F.array_join(kept, "&"))).otherwise(place), F.lit(""))


def by_rules(of_host: Column, of_path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule as a string, and its verdict; null where none fits."""
    rule = verdict = None
    for kind, rule_host, rule_path in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((of_host == rule_host) | of_host.endswith("." + rule_host)) & of_path.startswith(rule_path)
        name, says = F.lit(rule_host + rule_path), F.lit(kind)
        rule = F.when(fits, name) if rule is None else rule.when(fits, name)
        verdict = F.when(fits, says) if verdict is None else verdict.when(fits, says)
    return rule, verdict


def _bits(url: str) -> list[Column]:
    """For each word of a block the one bit a URL sets."""
    spread = f"shiftrightunsigned(xxhash64(1, {url}), {{}})"
    return [F.expr(f"shiftleft(1L, cast({spread.format(6 * i)} & 63 as int))") for i in range(_WORDS)]


def _block(url: str, blocks: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(0), F.col(url)), F.lit(blocks).cast("long"))


def bloom(listed: DataFrame, blocks: int) -> DataFrame:
    """The filter of a table ``listed(canonical)``: block and its four words."""
    bits = [bit.alias(f"b{i}") for i, bit in enumerate(_bits("canonical"))]
    return listed.select(_block("canonical", blocks).alias("block"), *bits).groupBy("block").agg(
        *[F.bit_or(f"b{i}").alias(f"w{i}") for i in range(_WORDS)]
    )


def judge(pages: DataFrame, listed: DataFrame, rules=RULES, url: str = "url") -> DataFrame:
    """``pages`` with host, path, rule, verdict and listed.

    The verdict is that of the longest fitting rule, else block for a URL whose canonical form is in
    ``listed(canonical)`` and allow for others. Repeated list entries count once, null ones never. A
    null URL, or one without ``://``, has an empty host and path, fits no rule and is allowed. Columns
    of ``pages`` with the names of results are replaced; repeated rows are judged alike.
    """
    space = Workspace(pages.sparkSession)
    listed = space.keep(listed.where("canonical <> ''").select("canonical").distinct(), "listed")
    blocks = max(1, listed.count() * BITS // (64 * _WORDS))
    pages = pages.drop("host", "path", "rule", "verdict", "listed")
    names = pages.columns
    source = pages.toDF(*[f"c{i}" for i in range(len(names))])
    asked = F.col(f"c{names.index(url)}")
    keyed = source.withColumns({"host": host(asked), "path": path(asked), "canonical": canonical(asked)})
    probed = keyed.withColumn("block", _block("canonical", blocks)).join(bloom(listed, blocks), "block", "left")
    possible = None
    for i, bit in enumerate(_bits("canonical")):
        here = F.coalesce(F.col(f"w{i}"), F.lit(0).cast("long")).bitwiseAND(bit) != 0
        possible = here if possible is None else possible & here
    hits = probed.where(possible).join(listed.withColumn("listed", F.lit(True)), "canonical", "left")
    judged = hits.withColumn("listed", F.coalesce("listed", F.lit(False))).select(*source.columns, "host", "path", "listed")
    rest = probed.where(~possible).select(*source.columns, "host", "path", F.lit(False).alias("listed"))
    rule, verdict = by_rules(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("listed"), "block").otherwise("allow")
    out = judged.unionByName(rest).select(*source.columns, "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "listed")
    return out.toDF(*names, "host", "path", "rule", "verdict", "listed")


def unwanted_pages(pages: DataFrame, url: str = "url") -> DataFrame:
    """The production list: canonical URLs of pages on unwanted hosts."""
    asked = F.col(url)
    return pages.where(host(asked).rlike(LISTED_HOSTS)).select(canonical(asked).alias("canonical"))


def query(spark: SparkSession, folder: str) -> DataFrame:
    """op4: the verdict on every page's URL."""
    pages = spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "url")
    return judge(pages, unwanted_pages(pages)).drop("url")


_AZ = f"'{string.ascii_uppercase}', '{string.ascii_lowercase}'"
_FITS = "\n".join(
    f"    WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{{}}'".replace("{}", f"{h}{p}|{v}")
    for v, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2]))
)
ORACLE = rf"""
WITH a AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), {_AZ}) AS host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path,
         coalesce(regexp_extract(url, '^.*?://[^?#]*\?([^#]*)', 1, 's'), '') AS asked
  FROM pages),
b AS (
  SELECT *, list_sort([x FOR x IN string_split(asked, '&')
            IF NOT regexp_matches(x, '{TRACKING}') AND x <> '']) AS kept FROM a),
c AS (
  SELECT *, host || regexp_replace(path, '/+$', '')
         || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END AS canonical FROM b),
d AS (
  SELECT *, canonical <> '' AND canonical IN (
    SELECT canonical FROM c WHERE regexp_matches(host, '{LISTED_HOSTS}')) AS listed,
    CASE
{_FITS}
    END AS hit
  FROM c)
SELECT page_id, host, path, split_part(hit, '|', 1) AS rule,
       coalesce(split_part(hit, '|', 2), CASE WHEN listed THEN 'block' ELSE 'allow' END) AS verdict, listed
FROM d
"""
