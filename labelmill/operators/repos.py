"""Solution files in repository listings: which file answers which (year, day)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelmill.functions.arrays import let
from labelmill.vocab import FIRST_DAY, FIRST_YEAR, LAST_DAY, LAST_YEAR

DAY = r"(0?[1-9]|1\d|2[0-5])"
# Path forms that name a solution.  Groups are (day), (year, day) or (year).
ANY_YEAR_RE = rf"(?i)day[_-]?{DAY}\.py\z"
NAMED_YEAR_RE = rf"(?i)day[_-]?(\d{{4}})_{DAY}\.py\z"
NUMBERED_RE = rf"(?i)(\d{{4}})/{DAY}\.py\z"
NUMBERED_ANY_RE = r"(?i)(\d{4})/\d{1,2}\.py\z"
DAY_FOLDER_RE = rf"(?i)(\d{{4}}/day{DAY})(?=/)"
YEAR_FOLDER_RE = r"(\d{4})(?=/)"


def _group(text: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit("")).cast("int")


def _key(year: Column, day: Column, rank: Column) -> Column:
    return F.struct(year.cast("int").alias("year"), day.cast("int").alias("day"), rank.cast("int").alias("rank"))


def _answered(path: Column, numbered_any_day: bool) -> Column:
    """array<struct<year, day, rank>> of the keys a path can answer; year null = every year, rank 0 =
    in a folder of the year."""
    none, zero, one = F.lit(None), F.lit(0), F.lit(1)
    folder_years = F.array_distinct(F.regexp_extract_all(path, F.lit(YEAR_FOLDER_RE), F.lit(1)).cast("array<int>"))
    dated = _group(path, ANY_YEAR_RE, 1)
    named_year, named_day = (_group(path, NAMED_YEAR_RE, g) for g in (1, 2))
    named_rank = F.when(F.array_contains(folder_years, named_year), zero).otherwise(one)
    if numbered_any_day:
        year = _group(path, NUMBERED_ANY_RE, 1)
        numbered = F.transform(F.sequence(F.lit(FIRST_DAY), F.lit(LAST_DAY)), lambda d: _key(year, d, zero))
    else:
        numbered = F.array(_key(_group(path, NUMBERED_RE, 1), _group(path, NUMBERED_RE, 2), zero))
    in_day_folder = F.transform(
        F.regexp_extract_all(path, F.lit(DAY_FOLDER_RE), F.lit(1)),
        lambda f: _key(F.substring(f, 1, 4), _group(f, r"(\d+)\z", 1), zero),
    )
    return F.concat(
        F.array(_key(none, dated, one)),
        F.transform(folder_years, lambda y: _key(y, dated, zero)),
        F.array(_key(named_year, named_day, named_rank)),
        F.filter(numbered, lambda k: k["year"].isNotNull()),
        F.filter(in_day_folder, lambda k: path.rlike(r"(?i)\.py\z")),
    )


def _every_year(year: Column) -> Column:
    """One row per calendar year where the year is open, else the year itself."""
    return F.explode(
        F.when(year.isNull(), F.sequence(F.lit(FIRST_YEAR), F.lit(LAST_YEAR))).otherwise(F.array(year))
    ).alias("year")


IN_CALENDAR = f"day between {FIRST_DAY} and {LAST_DAY} and (year is null or year between {FIRST_YEAR} and {LAST_YEAR})"


def match_solution_path(files: DataFrame, repo: str = "repo", path: str = "path", pos: str = "pos",
                        numbered_any_day: bool = False) -> DataFrame:
    """The best file per (repo, year, day): files in a folder of the year first, then listing order.

    Every path yields the (year, day) keys it can answer from its own text, so the listing is read
    once and never joined with the puzzle calendar.  A file whose name has a day and no year answers
    every year; those are reduced to one per (repo, day) before they are repeated for the years.  All
    reductions are a min over a struct and combine map-side: a repository with a third of all files
    is one row per task and key.  ``numbered_any_day`` lets ``year/NN.py`` answer every day.
    """
    base = files.select(F.col(repo).alias("repo"), F.col(pos).alias("pos"), F.col(path).alias("path"))
    keys = F.explode(let(F.col("path"), lambda p: _answered(p, numbered_any_day))).alias("k")
    found = base.select("repo", "pos", "path", keys).select("repo", "k.year", "k.day", F.struct("k.rank", "pos", "path").alias("best"))
    return _best_per_key(found.where(IN_CALENDAR))


def _best_per_key(found: DataFrame) -> DataFrame:
    """(repo, year, day, path, pos) of the least ``best`` struct, open years repeated after a first reduction."""
    reduced = found.groupBy("repo", "year", "day").agg(F.min("best").alias("best"))
    dated = reduced.select("repo", _every_year(F.col("year")), "day", "best")
    return (
        dated.groupBy("repo", "year", "day").agg(F.min("best").alias("best"))
        .select("repo", "year", "day", "best.path", "best.pos")
    )


# The search folders of the strict variant, tried in this order.  {y} is the year, {d} the day.
SEARCH_FOLDERS = ("", "solutions", "src", "day{d}", "{y}/day{d}", "{y}/{d}", "aoc{y}", "AoC{y}")


def _folder_pattern(form: str) -> str:
    return r"\A" + form.replace("{y}", r"\d{4}").replace("{d}", r"[1-9]\d?") + r"\z"


def _search_place(folder: Column) -> Column:
    """struct<idx, year, day> of a search folder, null parts meaning 'any'; null for any other folder."""
    year = F.when(folder.rlike(r"\d{4}"), _group(folder, r"(\d{4})", 1))
    day = F.when(folder.rlike(r"day|/"), _group(folder, r"(\d{1,2})\z", 1))
    idx = F.coalesce(*[F.when(folder.rlike(_folder_pattern(f)), i) for i, f in enumerate(SEARCH_FOLDERS)])
    return F.when(idx.isNotNull(), F.struct(idx.alias("idx"), year.alias("year"), day.alias("day")))


def _strict_hits(path: Column) -> Column:
    """array<struct<idx, year, day, nested>>: the searches a file can end, directly or from a day folder."""
    above, last = r"\A(?:(.*)/)?[^/]*\z", r"([^/]*)\z"

    def hit(place: Column, day: Column, nested: int, ok: Column) -> Column:
        fits = ok & place.isNotNull() & F.coalesce(place["day"] == day, F.lit(True))
        return F.when(fits, F.struct(
            place["idx"].alias("idx"), place["year"].alias("year"), day.alias("day"), F.lit(nested).alias("nested")
        ))

    def both(s: Column) -> Column:
        folder, upper = s["folder"], F.regexp_extract(s["folder"], above, 1)
        own_day = _group(F.regexp_extract(s["path"], last, 1), r"(?:\A|[\D_])(\d{1,2})\D?\.py\z", 1)
        folder_day = _group(F.regexp_extract(folder, last, 1), r"(?i)\A(?:day)?(\d{1,2})\z", 1)
        python = s["path"].rlike(r"(?i)\.py\z") & (folder != "")
        hits = F.array(
            let(_search_place(folder), lambda p: hit(p, own_day, 0, F.lit(True))),
            let(_search_place(upper), lambda p: hit(p, folder_day, 1, python)),
        )
        return F.filter(hits, lambda h: h.isNotNull())

    return let(F.struct(path.alias("path"), F.regexp_extract(path, above, 1).alias("folder")), both)


def match_day_file(files: DataFrame, repo: str = "repo", path: str = "path", pos: str = "pos") -> DataFrame:
    """Strict variant: search folders tried in order, giving up at the first that does not exist.

    In a folder a file named after the day wins; otherwise the first Python file of a sub-folder
    named after the day.  Hits are reduced per search folder first.  A repository's existing search
    folders are a set of at most a few hundred names (the calendar bounds it), so the check that all
    earlier folders exist is one join by repository on reduced rows.
    """
    base = files.select(F.col(repo).alias("repo"), F.col(pos).alias("pos"), F.col(path).alias("path"))
    hits = base.select("repo", "pos", "path", F.explode(_strict_hits(F.col("path"))).alias("h"))
    best = (
        hits.select("repo", "h.year", "h.day", F.struct("h.idx", "h.nested", "pos", "path").alias("best"))
        .where(IN_CALENDAR).groupBy("repo", "year", "day", F.col("best.idx").alias("idx"))
        .agg(F.min("best").alias("best"))
    )
    dated = best.select("repo", _every_year(F.col("year")), "day", "best")

    def named(parts: Column) -> Column:
        deepest = F.least(F.size(parts) - 1, F.lit(2))
        names = F.transform(F.array(F.lit(1), F.lit(2)), lambda n: F.when(
            n <= deepest, F.array_join(F.slice(parts, F.lit(1), n), "/")))
        return F.filter(names, lambda f: let(_search_place(f), lambda s: (
            s.isNotNull()
            & F.coalesce(s["year"].between(FIRST_YEAR, LAST_YEAR), F.lit(True))
            & F.coalesce(s["day"].between(FIRST_DAY, LAST_DAY), F.lit(True))
        )))

    folders = base.select("repo", F.explode(let(F.split("path", "/"), named)).alias("folder"))
    exists = folders.groupBy("repo").agg(F.collect_set("folder").alias("folders"))
    checked = dated.join(exists, "repo", "left")
    year, day = F.col("year").cast("string"), F.col("day").cast("string")
    wanted = F.array(*[
        F.replace(F.replace(F.lit(f), F.lit("{y}"), year), F.lit("{d}"), day) for f in SEARCH_FOLDERS
    ])
    earlier = F.slice(wanted, F.lit(2), F.greatest(F.col("best.idx") - 1, F.lit(0)))
    missing = F.array_except(earlier, F.coalesce("folders", F.array().cast("array<string>")))
    return _best_per_key(checked.where(F.size(missing) == 0).select("repo", "year", "day", "best"))


def decode_blob(content: Column, encoding: Column) -> Column:
    """File content from an API answer: base64 is decoded to text, anything else is taken as it is."""
    return F.when(encoding == "base64", F.decode(F.unbase64(content), "UTF-8")).otherwise(content)
