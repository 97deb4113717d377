"""URL rules behind a blocked Bloom filter.

A rule is a host and the start of a path; its canonical URL is the two together.  A page's URL gives one canonical URL for
every ending of its host and every path length that the list has.  A Bloom filter of 512-bit blocks (one bit in each
of eight words) lets through those that may be listed; an exact equi-join with the list removes the false
positives.  The filter has a row per block and at most ``max_blocks`` rows, so it is broadcast whatever the list's
size; a list that outgrows it only lets more candidates through to the join.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelmill.llm.common import fresh, lower_ascii

WORDS, MAX_BLOCKS, RULES_PER_BLOCK = 8, 1 << 16, 32
# The rules of the query (host, path, verdict).
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)


def rules_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame([tuple(r) for r in rules], "host string, path string, verdict string")


def url_host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lowered; empty for null and without ://."""
    return F.when(F.instr(url, "://") > 0, lower_ascii(F.regexp_extract(_rest(url), r"^[^/?#]*", 0))).otherwise("")


def url_path(url: Column) -> Column:
    """After the host up to ?, # or the end."""
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def _rest(url: Column) -> Column:
    return F.substr(url, F.instr(url, "://") + 3)


def _bits(name: str) -> list[Column]:
    """One bit for each word of a block, from a second hash of the name."""
    h = F.xxhash64(name, F.lit("bits"))
    place = lambda i: F.shiftrightunsigned(h, 6 * i).bitwiseAND(63).cast("int")
    return [F.call_function("shiftleft", F.lit(1).cast("long"), place(i)) for i in range(WORDS)]


def bloom_filter(names: DataFrame, name: str, blocks: int) -> DataFrame:
    """(block, w0 .. w7): a row for each block that has a name."""
    marked = names.select(F.pmod(F.xxhash64(name), F.lit(blocks)).alias("block"),
                          *[b.alias(f"w{i}") for i, b in enumerate(_bits(name))])
    return marked.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)])


def _passes(name: str) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"w{i}").bitwiseAND(b) != 0 for i, b in enumerate(_bits(name))])


def judge_urls(pages: DataFrame, rules: DataFrame, output: str, url: str = "url", default: str = "allow",
               max_blocks: int = MAX_BLOCKS) -> DataFrame:
    """``pages`` with the struct column ``output``: host, path, rule, verdict.

    A rule (host, path, verdict) fits its host and all subdomains if the URL's path starts with the rule's.  The longest
    fitting rule wins, then the one with the longer host; a URL that is both allowed and blocked by one rule is blocked.
    Without a fitting rule the rule is null and the verdict ``default``.  Null URLs and URLs without :// have
    an empty host and path.  Rules with a null in any column are ignored; every page is kept.
    """
    listed = rules.select("host", "path", "verdict").dropna().withColumn("rule", F.concat("host", "path"))
    facts = listed.agg(
        F.count("*").alias("n"), F.sort_array(F.collect_set(F.length("path"))).alias("lengths"),
        F.sort_array(F.collect_set(F.size(F.split("host", r"\.")))).alias("labels")).head()
    if not facts["n"]:
        empty = F.struct(url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path"),
                         F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
        return pages.withColumn(output, empty)
    blocks = min(max_blocks, 1 << (max(1, -(-facts["n"] // RULES_PER_BLOCK)) - 1).bit_length())

    urls = pages.select(F.col(url).alias("url")).where("url is not null").distinct()
    urls = urls.select("url", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path")).where("host != ''")
    ints = lambda xs: F.array(*[F.lit(x) for x in xs])
    parts = F.split("host", r"\.")
    ending = F.explode(F.filter(ints(facts["labels"]), lambda n: n <= F.size(parts))).alias("n")
    length = F.explode(F.filter(ints(facts["lengths"]), lambda n: n <= F.length("path"))).alias("m")
    asked = urls.select("url", "path", "host", ending).select("url", "path", "host", "n", length).select(
        "url", F.concat(F.array_join(F.slice(parts, -F.col("n"), F.col("n")), "."),
                        F.substr("path", F.lit(1), F.col("m"))).alias("rule"))
    bloom = F.broadcast(bloom_filter(listed, "rule", blocks))
    possible = asked.withColumn("block", F.pmod(F.xxhash64("rule"), F.lit(blocks))).join(bloom, "block").where(
        _passes("rule")).select("url", "rule")
    best = possible.join(listed, "rule").groupBy("url").agg(F.max(F.struct(
        F.length("rule").alias("length"), F.length("host").alias("host"), F.col("verdict"), F.col("rule"))).alias("best"))
    key, answer = fresh(pages, "_url"), fresh(pages, "_best")
    best = best.select(F.col("url").alias(key), F.col("best").alias(answer))
    out = pages.join(best, F.col(url) == F.col(key), "left")
    struct = F.struct(
        url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path"), F.col(f"{answer}.rule").alias("rule"),
        F.coalesce(f"{answer}.verdict", F.lit(default)).alias("verdict"))
    return out.withColumn(output, struct).drop(key, answer)


def digest(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict."""
    rules = rules_table(pages.sparkSession)
    return judge_urls(pages.select("page_id", "url"), rules, "_j").select("page_id", "_j.*")


ORACLE = r"""
WITH p AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
u AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
r(rhost, rpath, rverdict) AS (VALUES
  ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'),
  ('com', '/de/', 'block')),
f AS (
  SELECT page_id, max({'n': length(rhost || rpath), 'rule': rhost || rpath, 'verdict': rverdict}) AS best
  FROM u JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id)
SELECT u.page_id, u.host, u.path, f.best.rule AS rule, coalesce(f.best.verdict, 'allow') AS verdict
FROM u LEFT JOIN f USING (page_id)"""
