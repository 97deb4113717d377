"""Readers for nested JSON documents: ``day -> {id: code}`` and ``year -> day -> thread``.

Each reader has an expression form over a string column (one JSON document per row) and a
file form.  The file form reads one document per row, so a directory of many files is
parallel by file; ``splittable=True`` reads a huge document by byte ranges (``json_ranges``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelmill.sources import json_ranges as jr
from labelmill.vocab import FIRST_DAY, FIRST_YEAR, LAST_DAY, LAST_YEAR

THREAD_DDL = (
    "map<string, map<string, struct<puzzle_id: string, url: string, "
    "comments: array<struct<author: string, code: string, language: string>>>>>"
)


def whole_text(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: (path, json)."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("path"), F.col("value").alias("json")
    )


def explode_solutions(df: DataFrame, json_col: str, *keep: str) -> DataFrame:
    """``day -> {id: code}`` to rows (keep..., day, id, code).

    Day keys that are no integer, days outside the calendar and days whose value is no
    object give no rows.  A null code stays a row with a null code.
    """
    days = df.select(*keep, F.explode(F.from_json(json_col, "map<string,variant>")).alias("day", "_body"))
    days = days.withColumn("day", F.expr("try_cast(day as int)")).where(
        F.col("day").between(FIRST_DAY, LAST_DAY)
    )
    # A value that is no object, a string that holds one included, has no such map.
    bodies = days.select(*keep, "day", F.explode(F.expr("try_variant_get(_body, '$', 'map<string,variant>')")).alias("id", "_code"))
    return bodies.select(*keep, "day", "id", F.expr("try_variant_get(_code, '$', 'string')").alias("code"))


def read_nested_solutions(spark: SparkSession, path: str, splittable: bool = False) -> DataFrame:
    """Rows (path, day, id, code) of every ``day -> {id: code}`` file under ``path``."""
    if splittable:
        return solutions_of(jr.fragments(spark, path))
    return explode_solutions(whole_text(spark, path), "json", "path")


def solutions_of(fragments: DataFrame) -> DataFrame:
    """Rows (path, day, id, code) of the ``day -> {id: code}`` documents that ``fragments`` make up.

    The rules are those of ``explode_solutions``; a document is no unit of work, only a code is.
    """
    pairs = jr.inner(jr.members(fragments, 2), 2).where("opens = '{'").select(
        "path", F.expr("try_cast(k1 as int)").alias("day"), F.concat(F.lit("{"), "text", F.lit("}")).alias("_pair"))
    pairs = pairs.where(F.col("day").between(FIRST_DAY, LAST_DAY)).select(
        "path", "day", F.explode(F.from_json("_pair", "map<string,variant>")).alias("id", "_code"))
    return pairs.select("path", "day", "id", F.expr("try_variant_get(_code, '$', 'string')").alias("code"))


def explode_threads(df: DataFrame, json_col: str, *keep: str) -> DataFrame:
    """``year -> day -> {..., comments[]}`` to rows (keep..., year, day, pos, author, code).

    A missing author becomes 'unknown', missing code becomes ''.
    """
    years = df.select(*keep, F.explode(F.from_json(json_col, THREAD_DDL)).alias("year", "_days"))
    days = years.select(
        *keep, F.expr("try_cast(year as int)").alias("year"),
        F.explode("_days").alias("day", "_thread"),
    ).withColumn("day", F.expr("try_cast(day as int)"))
    comments = days.where(F.col("day").between(FIRST_DAY, LAST_DAY)).select(
        *keep, "year", "day", F.posexplode(F.col("_thread.comments")).alias("pos", "_c")
    )
    return comments.select(
        *keep, "year", "day", "pos",
        F.coalesce("_c.author", F.lit("unknown")).alias("author"),
        F.coalesce("_c.code", F.lit("")).alias("code"),
    )


def read_thread_solutions(spark: SparkSession, path: str, splittable: bool = False) -> DataFrame:
    """Rows (year, day, pos, author, code) of every ``year -> day -> thread`` file under ``path``."""
    if splittable:
        return threads_of(jr.fragments(spark, path))
    return explode_threads(whole_text(spark, path), "json")


def threads_of(fragments: DataFrame) -> DataFrame:
    """Rows (year, day, pos, author, code) of the documents that ``fragments`` make up, by the rules of ``explode_threads``.

    A comment is the unit of work.  One that is no object counts as one without author and code.
    """
    comments = jr.inner(jr.members(fragments, 4), 4).where("opens = '[' and k3 = 'comments'").select(
        F.expr("try_cast(k1 as int)").alias("year"), F.expr("try_cast(k2 as int)").alias("day"),
        F.col("place").cast("int").alias("pos"), F.from_json("text", "author string, code string").alias("_c"))
    return comments.where(F.col("day").between(FIRST_DAY, LAST_DAY)).select(
        "year", "day", "pos", F.coalesce("_c.author", F.lit("unknown")).alias("author"),
        F.coalesce("_c.code", F.lit("")).alias("code"))


def read_thread_urls(spark: SparkSession, path: str) -> DataFrame:
    """``year -> [url, ...]`` to rows (year, day, url); the day is the list position plus one."""
    docs = whole_text(spark, path)
    years = docs.select(F.explode(F.from_json("json", "map<string,array<string>>")).alias("year", "_urls"))
    return years.select(
        F.expr("try_cast(year as int)").alias("year"), F.posexplode("_urls").alias("_pos", "url")
    ).select("year", (F.col("_pos") + 1).alias("day"), "url")


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)\z", 1)


def tag_year(path: Column) -> Column:
    """The first four digits in a row of the file name, as int; null when there are none."""
    return F.nullif(F.regexp_extract(file_name(path), r"(\d{4})", 1), F.lit("")).cast("int")


def tag_source(path: Column) -> Column:
    """Source family from the file name: reddit, leaderboard (contains 'lb') or extra."""
    name = file_name(path)
    return (
        F.when(name.contains("reddit"), "reddit")
        .when(name.contains("lb"), "leaderboard")
        .otherwise("extra")
    )


def read_tagged_dir(spark: SparkSession, path: str) -> DataFrame:
    """Every preprocessed file under ``path`` as (code, source, year, day, id); empty code is dropped."""
    rows = read_nested_solutions(spark, path).where(F.length("code") > 0)
    return rows.select(
        "code", tag_source(F.col("path")).alias("source"), tag_year(F.col("path")).alias("year"), "day", "id"
    )


def in_calendar(year: Column, day: Column) -> Column:
    """The configured years and the days of one calendar."""
    return year.between(FIRST_YEAR, LAST_YEAR) & day.between(FIRST_DAY, LAST_DAY)
