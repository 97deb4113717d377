"""Extraction from landed pages: links, URLs, comment blocks."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelmill.functions.html import BlockSpec, page_blocks, page_links, page_text
from labelmill.functions.pycode import repair_or_drop
from labelmill.functions.text import RANK_LINE_RE, strip_space

# Fixed value: the pattern of thread names.
PUZZLE_RE = r"(\d{4})_day_(\d{1,2})"

PAGES_PER_BATCH = 256


def _parse_pages(pages: DataFrame, html: str, keep: tuple[str, ...], parse, fields: dict[str, tuple[str, pa.DataType]]) -> DataFrame:
    """Rows (keep..., fields...) of every page; ``parse`` gives a page's rows in order.

    A page is parsed in its own task row, batch by batch; only the kept columns and the page reach Python.
    """
    ddl = [f"`{f.name}`: {f.dataType.simpleString()}" for f in pages.select(*keep).schema.fields]
    ddl += [f"{name}: {kind}" for name, (kind, _) in fields.items()]
    names, kinds = [*keep, *fields], [kind for _, kind in fields.values()]

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, PAGES_PER_BATCH):
                part = batch.slice(start, PAGES_PER_BATCH)
                texts = part.column(part.num_columns - 1).to_pylist()
                found = [(i, *row) for i, page in enumerate(texts) for row in parse(page)]
                source, *values = zip(*found) if found else ((),) * (len(fields) + 1)
                rows = pa.array(source, pa.int64())
                kept = [part.column(c).take(rows) for c in range(part.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*kept, *map(pa.array, values, kinds)], names=names)

    return pages.select(*keep, html).mapInArrow(run, f"struct<{', '.join(ddl)}>")


def extract_links(pages: DataFrame, html: str, *keep: str, within: str | None = "td") -> DataFrame:
    """Targets of the anchors inside ``within`` elements (None: of all) in document order as (keep..., day, href).
    The position defines the day.  Any order and quoting of attributes; character references are decoded."""
    return _parse_pages(pages, html, keep, lambda page: enumerate(page_links(page, within), 1), {
        "day": ("int", pa.int32()), "href": ("string", pa.string())})


def rewrite_url(url: Column, year: Column, base: str, odd_year: int = 2023) -> Column:
    """Thread link of a year: the odd year stores a path to be put behind ``base``, the other
    years a full link whose every 'www' becomes 'old'."""
    return F.when(year == odd_year, F.concat(F.lit(base), url)).otherwise(
        F.replace(url, F.lit("www"), F.lit("old"))
    )


def raw_blob_url(url: Column, host: str = "github.com", raw_host: str = "raw.githubusercontent.com") -> Column:
    """Address of a file's raw content; null when the URL is no blob URL of the host."""
    raw = F.replace(F.replace(url, F.lit(host), F.lit(raw_host)), F.lit("/blob/"), F.lit("/"))
    return F.when(url.contains(host) & url.contains("/blob/"), raw)


def thread_url(year: Column, day: Column, url: Column) -> Column:
    return F.concat(
        url, F.lit("/"), year.cast("string"), F.lit("_day_"), day.cast("string"),
        F.lit("_solutions/?sort=top&limit=500"),
    )


def puzzle_key(url: Column) -> Column:
    """'year_day' from the first ``dddd_day_d[d]`` of the URL, or null."""
    key = F.concat_ws("_", F.regexp_extract(url, PUZZLE_RE, 1), F.regexp_extract(url, PUZZLE_RE, 2))
    return F.nullif(key, F.lit("_"))


def extract_blocks(pages: DataFrame, html: str, *keep: str, spec: BlockSpec | None = None) -> DataFrame:
    """One row per comment block: (keep..., pos, author, body, code)."""
    spec = spec or BlockSpec()
    return _parse_pages(pages, html, keep, lambda page: ((i, *block) for i, block in enumerate(page_blocks(page, spec))), {
        "pos": ("int", pa.int32()), "author": ("string", pa.string()), "body": ("string", pa.string()),
        "code": ("string", pa.string())})


def extract_page_text(pages: DataFrame, html: str, *keep: str) -> DataFrame:
    """One row per page, from all of it: (keep..., title, body, item), the first h1, all p and the first li."""
    return _parse_pages(pages, html, keep, lambda page: [page_text(page)], {
        "title": ("string", pa.string()), "body": ("string", pa.string()), "item": ("string", pa.string())})


def has_rank_line(body: Column) -> Column:
    """The body tells a leaderboard rank: '[language: X] a/b' with a or b in 1..100."""
    return F.coalesce(body.rlike(RANK_LINE_RE), F.lit(False))


def drop_ranked_authors(blocks: DataFrame, body: str = "body") -> DataFrame:
    return blocks.where(~has_rank_line(F.col(body)))


def drop_no_code(blocks: DataFrame, code: str = "code") -> DataFrame:
    return blocks.where(F.col(code).isNotNull())


def forum_solutions(pages: DataFrame, html: str, *keep: str) -> DataFrame:
    """Blocks that carry valid (or repairable) Python and no leaderboard rank."""
    blocks = drop_no_code(drop_ranked_authors(extract_blocks(pages, html, *keep)))
    return blocks.withColumn("code", repair_or_drop(F.col("code"))).where(F.col("code").isNotNull())


def harvest_urls(texts: DataFrame, text: str, host: str) -> DataFrame:
    """The lines that name the host."""
    return texts.where(F.col(text).contains(host))


def parse_repo_url(url: Column, host: str = "github.com") -> tuple[Column, Column]:
    """(user, repo) of a repository URL; both null when malformed."""
    pattern = rf"\Ahttps?://{host.replace('.', r'\.')}/([^/]+)/([^/]+)(?:/|\z)"
    trimmed = strip_space(url)
    user, repo = (F.nullif(F.regexp_extract(trimmed, pattern, g), F.lit("")) for g in (1, 2))
    return user, repo


def distinct_links(links: DataFrame, *keys: str) -> DataFrame:
    """Each link once per (year, day); duplicates merge before the shuffle."""
    return links.select(*keys).distinct()
