"""Registered queries: nested JSON, pages, URLs, repository listings."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelmill.operators import pages as pg
from labelmill.operators import repos as rp
from labelmill.session import spread, table
from labelmill.sources import nested_json as nj

BASE = "https://old.example.org/r/forum/comments"


def nested_json_explode(spark, sf):
    """Each event as one 'day -> {id: code}' document that also holds a day without an object and a
    day key that is no number."""
    doc = F.concat(
        F.lit('{"'), F.dayofmonth("ts").cast("string"), F.lit('": '), F.col("props"),
        F.lit(', "'), (F.dayofmonth("ts") % 25 + 1).cast("string"), F.lit('": 5, "'), F.col("event_type"),
        F.lit('": {"a": "b"}}'),
    )
    docs = spread(table(spark, sf, "events").select("event_id", "ts", "event_type", "props")).select(
        "event_id", doc.alias("json"))
    return nj.explode_solutions(docs, "json", "event_id")


def json_range_members(spark, sf):
    """All documents as one ``day -> {id: text}`` document, read back from its fragments.

    The fragments are those that a scan of the file would give, in ranges of 1,000 document ids, with a first and a last one
    around them; each document adds ``"day": {"id": text}, `` and its opening quote is the one after the fragment before.
    """
    whole = F.to_json(F.struct(F.col("text").alias("t")))
    value = F.when(F.col("text").isNull(), "null").otherwise(F.substring(whole, F.lit(6), F.length(whole) - 6))
    day = (F.col("doc_id") % 25 + 1).cast("string")
    member = F.concat(day, F.lit('": {"'), F.col("doc_id").cast("string"), F.lit('": '), value, F.lit("}, "))
    inner = spread(table(spark, sf, "documents").select("doc_id", "text")).select(
        F.floor(F.col("doc_id") / 1000).alias("block"), F.col("doc_id"), F.posexplode(F.split(member, '"')).alias("pos", "value"))
    place = F.col("doc_id") % 1000 * F.lit(1 << 40) + F.col("pos")
    inner = inner.select(F.lit("all").alias("path"), "block", place.alias("id"), "value")
    ends = spark.range(3).select(
        F.lit("all").alias("path"), F.when(F.col("id") == 0, -1).otherwise(F.lit((1 << 63) - 1)).alias("block"), "id",
        F.get(F.array(F.lit("{"), F.lit("0"), F.lit(": {}}")), F.col("id").cast("int")).alias("value"))
    rows = nj.solutions_of(inner.unionByName(ends))
    return rows.select("day", "id", F.length("code").alias("n_chars"), F.md5("code").alias("code_md5"))


def conversation_rows(spark, sf):
    """Each turn as one 'year -> day -> thread' document with a single comment; system turns have no
    author, first turns no code."""
    turns = spread(table(spark, sf, "conversations"))
    comment = F.struct(
        F.when(F.col("role") != "system", F.col("role")).alias("author"),
        F.when(F.col("turn") > 0, F.col("text")).alias("code"),
    )
    thread = F.struct(F.lit("p").alias("puzzle_id"), F.array(comment).alias("comments"))
    day = (F.col("conv_id") % 27).cast("string")
    doc = F.to_json(F.create_map(F.lit("2015"), F.create_map(day, thread)))
    rows = nj.explode_threads(turns.select("conv_id", "turn", doc.alias("json")), "json", "conv_id", "turn")
    return rows.select("conv_id", "turn", "year", "day", "author", F.md5("code").alias("code_md5"))


def source_tag(spark, sf):
    """File names made of a family, the page's host and a year."""
    family = F.get(F.array(F.lit("reddit"), F.lit("lb"), F.lit("extra_repos")), (F.col("page_id") % 3).cast("int"))
    host = F.regexp_extract("url", "https?://([^/]+)", 1)
    year = F.when(F.col("page_id") % 10 != 0, (2015 + F.col("page_id") % 9).cast("string")).otherwise("x")
    path = F.concat(F.lit("/data/2001/"), family, F.lit("_"), host, F.lit("_"), year, F.lit(".json"))
    rows = table(spark, sf, "pages").select("page_id", path.alias("path"))
    return rows.select("page_id", nj.tag_source(F.col("path")).alias("source"), nj.tag_year(F.col("path")).alias("year"))


def page_links(spark, sf):
    return pg.extract_links(spread(table(spark, sf, "pages").select("page_id", "html")), "html", "page_id", within=None)


def _year_day(df):
    year = (2015 + F.col("page_id") % 9).cast("int")
    return df.withColumn("year", year).withColumn("day", (F.col("page_id") % 25 + 1).cast("int"))


def url_rewrite(spark, sf):
    """Thread links per year, their crawl address, and the raw address of a file behind the URL."""
    pages = _year_day(table(spark, sf, "pages").select("page_id", "url"))
    url = F.when(F.col("year") == 2023, F.regexp_extract("url", r"https?://[^/]+(/.*)", 1)).otherwise(F.col("url"))
    link = pg.rewrite_url(url, F.col("year"), BASE)
    blob = F.concat(F.lit("https://github.com/u/r/blob/"), F.col("page_id").cast("string"), F.lit(".py"))
    raw = pg.raw_blob_url(F.when(F.col("page_id") % 2 == 0, blob).otherwise(F.col("url")))
    return pages.select("page_id", link.alias("link"),
                        pg.thread_url(F.col("year"), F.col("day"), link).alias("thread"), raw.alias("raw"))


def url_key_extract(spark, sf):
    pages = _year_day(table(spark, sf, "pages").select("page_id", "url"))
    return pages.select("page_id", pg.puzzle_key(F.col("url")).alias("plain"),
                        pg.puzzle_key(pg.thread_url(F.col("year"), F.col("day"), F.col("url"))).alias("key"))


def _thread_pages(spark, sf):
    """Each conversation turn as a page: an outer comment area around one comment with author,
    paragraphs, code and one reply."""
    text = F.replace(F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")),
                     F.lit(">"), F.lit("&gt;"))
    turn = F.col("turn").cast("string")
    html = F.concat(
        F.lit('<html><body><div class="commentarea"><div class="thing comment"><p class="tagline">'
              '<a class="author may-blank">'), F.col("role"), F.lit('</a></p><div class="md x"><p> '), text,
        F.lit("</p><p>[LANGUAGE: Python] "), (F.col("conv_id") * 3).cast("string"), F.lit(" / "),
        (F.col("conv_id") * 7).cast("string"), F.lit("</p><blockquote><p>quoted</p></blockquote>"),
        F.when(F.col("turn") % 2 == 0, F.concat(F.lit("<pre><code>x = "), turn, F.lit(" &lt; 5\n</code></pre>")))
        .otherwise(""),
        F.lit('<pre><code>y</code></pre></div><div class="child"><div class="comment"><a class="author">re</a>'
              '<div class="md"><p>ok</p></div></div></div></div></div></body></html>'),
    )
    return spread(table(spark, sf, "conversations")).select("conv_id", "turn", html.alias("html"))


def page_blocks(spark, sf):
    blocks = pg.extract_blocks(_thread_pages(spark, sf), "html", "conv_id", "turn")
    return blocks.select("conv_id", "turn", "pos", "author", F.md5("body").alias("body_md5"), "code")


def page_block_filter(spark, sf):
    """Blocks without a leaderboard rank and with code."""
    blocks = pg.extract_blocks(_thread_pages(spark, sf), "html", "conv_id", "turn")
    return pg.drop_no_code(pg.drop_ranked_authors(blocks)).select("conv_id", "turn", "pos", "code")


def page_text_blocks(spark, sf):
    """The landed pages themselves: each navigation bar is a block, its first link the author."""
    spec = pg.BlockSpec(block_tag="nav", block_class="", author_class="")
    pages = spread(table(spark, sf, "pages").select("page_id", "html"))
    return pg.extract_blocks(pages, "html", "page_id", spec=spec).select("page_id", "pos", "author", "body", "code")


def page_text(spark, sf):
    """Title, paragraphs and first list item of the whole landed pages."""
    return pg.extract_page_text(spread(table(spark, sf, "pages").select("page_id", "html")), "html", "page_id")


def rank_line_filter(spark, sf):
    """A rank line composed from each order; the lines without a rank remain."""
    word = F.when(F.col("o_orderstatus") == "F", "LANGUAGE").otherwise("lang")
    line = F.concat(F.lit("see ["), word, F.lit(": Py 3] "), F.col("o_custkey").cast("string"),
                    F.when(F.col("o_orderkey") % 2 == 0, "/").otherwise(" / "),
                    (F.col("o_orderkey") % 1999).cast("string"), F.lit(" done"))
    rows = table(spark, sf, "orders").select("o_orderkey", line.alias("body"))
    return pg.drop_ranked_authors(rows)


def url_harvest(spark, sf):
    return pg.harvest_urls(table(spark, sf, "pages").select("page_id", "url"), "url", "example.org")


def repo_parts(spark, sf):
    """Repository URLs from each page's host and path; some lack the repository, some the scheme."""
    host = F.regexp_extract("url", "https?://([^/]+)", 1)
    lang = F.regexp_extract("url", "https?://[^/]+/([a-z]{2})/", 1)
    tail = F.get(F.array(F.lit(""), F.lit("/"), F.lit("/tree/main"), F.lit("\n")), (F.col("page_id") % 4).cast("int"))
    head = F.get(F.array(F.lit(" https://github.com/"), F.lit("http://github.com/"), F.lit("github.com/")),
                 (F.col("page_id") % 3).cast("int"))
    repo = F.when(F.col("page_id") % 5 == 0, "").otherwise(F.concat(F.lit("/aoc-"), lang, tail))
    rows = table(spark, sf, "pages").select("page_id", F.concat(head, host, repo).alias("url"))
    user, name = pg.parse_repo_url(F.col("url"))
    return rows.select("page_id", user.alias("user"), name.alias("repo"))


def distinct_links(spark, sf):
    pages = spread(table(spark, sf, "pages").select("page_id", "html"))
    links = pg.extract_links(pages.withColumn("year", (2015 + F.col("page_id") % 9).cast("int")), "html", "year", within=None)
    return pg.distinct_links(links, "year", "day", "href")


def _pick(index, *values):
    return F.get(F.array(*values), index.cast("int"))


def _calendar_parts():
    y = (2015 + F.floor(F.col("page_id") / 8) % 9).cast("string")
    d = (1 + F.floor(F.col("page_id") / 3) % 25).cast("string")
    return y, d, F.lpad(d, 2, "0")


def best_path_per_key(spark, sf):
    """File listings made from the pages: seven repositories, eight path forms."""
    y, d, dd = _calendar_parts()
    path = _pick(
        F.col("page_id") % 8,
        F.concat(y, F.lit("/day"), dd, F.lit(".py")), F.concat(y, F.lit("/"), dd, F.lit(".py")),
        F.concat(F.lit("aoc"), y, F.lit("/day_"), d, F.lit(".py")), F.concat(F.lit("src/day"), d, F.lit(".py")),
        F.concat(y, F.lit("/12/Day-"), d, F.lit(".PY")), F.concat(y, F.lit("/day"), dd, F.lit("/main.py")),
        F.concat(F.lit("day_"), y, F.lit("_"), d, F.lit(".py")), F.concat(F.lit("notes/day"), d, F.lit(".txt")),
    )
    files = table(spark, sf, "pages").select(
        F.concat(F.lit("r"), (F.col("page_id") % 7).cast("string")).alias("repo"), F.col("page_id").alias("pos"),
        path.alias("path"))
    return rp.match_solution_path(files)


def strict_path_per_key(spark, sf):
    """File listings for the strict search, ten path forms."""
    y, d, dd = _calendar_parts()
    path = _pick(
        F.col("page_id") % 10,
        F.concat(F.lit("sol_"), dd, F.lit("a.py")), F.concat(F.lit("solutions/day"), d, F.lit(".py")),
        F.concat(F.lit("src/"), d, F.lit(".py")), F.concat(F.lit("day"), d, F.lit("/main.py")),
        F.concat(y, F.lit("/day"), d, F.lit("/sol"), d, F.lit(".py")), F.concat(y, F.lit("/"), d, F.lit("/a"), d, F.lit(".py")),
        F.concat(F.lit("aoc"), y, F.lit("/"), d, F.lit(".py")), F.concat(F.lit("AoC"), y, F.lit("/"), dd, F.lit(".py")),
        F.concat(F.lit("docs/"), d, F.lit("/readme.md")), F.concat(F.lit("src/Day"), dd, F.lit("/x.py")),
    )
    files = table(spark, sf, "pages").select(
        F.concat(F.lit("r"), (F.col("page_id") % 4).cast("string")).alias("repo"), F.col("page_id").alias("pos"),
        path.alias("path"))
    return rp.match_day_file(files)


def decode_blob(spark, sf):
    """Part names as API file answers, every second one base64."""
    coded = F.col("p_partkey") % 2 == 0
    text = F.concat("p_name", F.lit(" é\n"))
    content = F.when(coded, F.base64(F.encode(text, "UTF-8"))).otherwise(text)
    rows = table(spark, sf, "part").select(
        "p_partkey", content.alias("content"), F.when(coded, "base64").otherwise("none").alias("encoding"))
    return rows.select("p_partkey", rp.decode_blob(F.col("content"), F.col("encoding")).alias("code"))


QUERIES = {
    f.__name__: f
    for f in (
        nested_json_explode, json_range_members, conversation_rows, source_tag, page_links, url_rewrite, url_key_extract, page_blocks,
        page_block_filter, page_text_blocks, page_text, rank_line_filter, url_harvest, repo_parts, distinct_links,
        best_path_per_key, strict_path_per_key, decode_blob,
    )
}

WS = r"[\s\x0B\x1C-\x1F\x{85}\p{Z}]"
_YD = "(2015 + page_id % 9)::INT AS year, (page_id % 25 + 1)::INT AS day"
_FILES = """
WITH RECURSIVE y AS (SELECT page_id, (2015 + (page_id // 8) % 9)::VARCHAR AS y, (1 + (page_id // 3) % 25)::VARCHAR AS d FROM pages),
cal AS (SELECT yy::INT AS year, dd::INT AS day, lpad(dd::VARCHAR, 2, '0') AS pad
        FROM range(2015, 2024) a(yy), range(1, 26) b(dd)),
"""


def _plain(x: str) -> str:
    """SQL: the text of a piece of a page."""
    bare = f"regexp_replace(regexp_replace({x}, '<[^>]*>', '', 'g'), '&amp$', '&amp;')"
    return f"regexp_replace(replace(replace({bare}, '&quot;', '\"'), '&amp;', '&'), '^{WS}+|{WS}+$', '', 'g')"


_BLOCKS = f"""
WITH c AS (SELECT conv_id, turn, role, regexp_replace(text, '^{WS}+|{WS}+$', '', 'g') AS body,
  '[LANGUAGE: Python] ' || (conv_id * 3) || ' / ' || (conv_id * 7) AS rank,
  CASE WHEN turn % 2 = 0 THEN 'x = ' || turn || ' < 5' ELSE 'y' END AS code FROM conversations),
b AS (
  SELECT conv_id, turn, 0 AS pos, role AS author, body || chr(10) || rank || chr(10) || 'ok' AS body, code FROM c
  UNION ALL SELECT conv_id, turn, 1, role, body || chr(10) || rank || chr(10) || 'ok', code FROM c
  UNION ALL SELECT conv_id, turn, 2, 're', 'ok', NULL FROM c)
"""

ORACLES = {
    "nested_json_explode": """
WITH e AS (SELECT event_id, day(ts)::INT AS day, props, unnest(json_keys(props)) AS id FROM events)
SELECT event_id, day, id, json_extract_string(props, '$.' || id) AS code FROM e WHERE day BETWEEN 1 AND 25""",
    "json_range_members": """
SELECT (doc_id % 25 + 1)::INT AS day, doc_id::VARCHAR AS id, length(text)::INT AS n_chars, md5(text) AS code_md5 FROM documents""",
    "conversation_rows": """
SELECT conv_id, turn, 2015 AS year, (conv_id % 27)::INT AS day,
  CASE WHEN role = 'system' THEN 'unknown' ELSE role END AS author,
  md5(CASE WHEN turn > 0 THEN text ELSE '' END) AS code_md5
FROM conversations WHERE conv_id % 27 BETWEEN 1 AND 25""",
    "source_tag": """
WITH p AS (SELECT page_id, ['reddit', 'lb', 'extra_repos'][page_id % 3 + 1] || '_'
  || regexp_extract(url, 'https?://([^/]+)', 1) || '_'
  || CASE WHEN page_id % 10 <> 0 THEN (2015 + page_id % 9)::VARCHAR ELSE 'x' END || '.json' AS name FROM pages)
SELECT page_id, CASE WHEN contains(name, 'reddit') THEN 'reddit' WHEN contains(name, 'lb') THEN 'leaderboard'
  ELSE 'extra' END AS source, nullif(regexp_extract(name, '\\d{4}'), '')::INT AS year FROM p""",
    "page_links": """
WITH l AS (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS h FROM pages)
SELECT page_id, unnest(range(1, len(h) + 1))::INT AS day, unnest(h) AS href FROM l""",
    "url_rewrite": f"""
WITH p AS (SELECT page_id, url, {_YD} FROM pages),
l AS (SELECT *, CASE WHEN year = 2023 THEN '{BASE}' || regexp_extract(url, 'https?://[^/]+(/.*)', 1)
  ELSE replace(url, 'www', 'old') END AS link FROM p)
SELECT page_id, link, link || '/' || year || '_day_' || day || '_solutions/?sort=top&limit=500' AS thread,
  CASE WHEN page_id % 2 = 0 THEN 'https://raw.githubusercontent.com/u/r/' || page_id || '.py' END AS raw FROM l""",
    "url_key_extract": f"""
WITH p AS (SELECT page_id, url, {_YD} FROM pages)
SELECT page_id, NULL::VARCHAR AS plain, year || '_' || day AS key FROM p""",
    "page_blocks": _BLOCKS + "SELECT conv_id, turn, pos, author, md5(body) AS body_md5, code FROM b",
    "page_block_filter": _BLOCKS + """
SELECT conv_id, turn, pos, code FROM b
WHERE code IS NOT NULL AND NOT (conv_id * 3 BETWEEN 1 AND 100 AND conv_id * 7 <= 9999
  OR conv_id * 7 BETWEEN 1 AND 100 AND conv_id * 3 <= 9999)""",
    "page_text_blocks": """
SELECT page_id, 0 AS pos, trim(replace(regexp_extract(html, '(?s)<nav>.*?<a [^>]*>([^<]*)</a>', 1), '&amp;', '&')) AS author,
  '' AS body, NULL::VARCHAR AS code FROM pages WHERE contains(html, '<nav>')""",
    "page_text": f"""
WITH raw AS (
  SELECT page_id, regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1) AS title, regexp_extract(html, '(?s)<li>(.*?)</li>', 1) AS item,
         list_transform(string_split(html, '<p>')[2:], lambda x: regexp_extract(x, '(?s)^(.*?)(</p>|</article>|$)', 1)) AS parts
  FROM pages)
SELECT page_id, {_plain('title')} AS title, {_plain('item')} AS item,
  array_to_string(list_transform(parts, lambda x: {_plain('x')}), chr(10)) AS body FROM raw""",
    "rank_line_filter": """
WITH r AS (SELECT o_orderkey, o_custkey AS a, o_orderkey % 1999 AS b, 'see [' || CASE WHEN o_orderstatus = 'F'
  THEN 'LANGUAGE' ELSE 'lang' END || ': Py 3] ' || o_custkey || CASE WHEN o_orderkey % 2 = 0 THEN '/' ELSE ' / ' END
  || (o_orderkey % 1999) || ' done' AS body FROM orders)
SELECT o_orderkey, body FROM r
WHERE NOT ((a BETWEEN 1 AND 100) OR (b BETWEEN 1 AND 100 AND a <= 9999))""",
    "url_harvest": "SELECT page_id, url FROM pages WHERE contains(url, 'example.org')",
    "repo_parts": """
WITH p AS (SELECT page_id, regexp_extract(url, 'https?://([^/]+)', 1) AS host,
  regexp_extract(url, 'https?://[^/]+/([a-z]{2})/', 1) AS lang FROM pages)
SELECT page_id, CASE WHEN page_id % 3 < 2 AND page_id % 5 > 0 THEN host END AS "user",
  CASE WHEN page_id % 3 < 2 AND page_id % 5 > 0 THEN 'aoc-' || lang END AS repo FROM p""",
    "distinct_links": """
WITH l AS (SELECT (2015 + page_id % 9)::INT AS year, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS h FROM pages)
SELECT DISTINCT * FROM (SELECT year, unnest(range(1, len(h) + 1))::INT AS day, unnest(h) AS href FROM l)""",
    "best_path_per_key": _FILES + """
f AS (SELECT 'r' || (page_id % 7) AS repo, page_id AS pos, CASE page_id % 8
    WHEN 0 THEN y || '/day' || lpad(d, 2, '0') || '.py' WHEN 1 THEN y || '/' || lpad(d, 2, '0') || '.py'
    WHEN 2 THEN 'aoc' || y || '/day_' || d || '.py' WHEN 3 THEN 'src/day' || d || '.py'
    WHEN 4 THEN y || '/12/Day-' || d || '.PY' WHEN 5 THEN y || '/day' || lpad(d, 2, '0') || '/main.py'
    WHEN 6 THEN 'day_' || y || '_' || d || '.py' ELSE 'notes/day' || d || '.txt' END AS path FROM y),
hit AS (SELECT repo, year, day, path, pos, contains(path, year || '/') AS in_year FROM f, cal
  WHERE regexp_matches(path, '(?i)day[_-]?(' || day || '|' || pad || ')\\.py$')
     OR regexp_matches(path, '(?i)day[_-]?' || year || '_(' || day || '|' || pad || ')\\.py$')
     OR regexp_matches(path, '(?i)' || year || '/(' || day || '|' || pad || ')\\.py$')
     OR regexp_matches(path, '(?i)' || year || '/day(' || day || '|' || pad || ')/.*\\.py$')
     OR regexp_matches(path, '(?i)' || year || '/.*day[_-]?(' || day || '|' || pad || ')\\.py$'))
SELECT repo, year, day, path, pos FROM (
  SELECT *, row_number() OVER (PARTITION BY repo, year, day ORDER BY in_year DESC, pos) AS k FROM hit) WHERE k = 1""",
    "strict_path_per_key": _FILES + """
f AS (SELECT 'r' || (page_id % 4) AS repo, page_id AS pos, CASE page_id % 10
    WHEN 0 THEN 'sol_' || lpad(d, 2, '0') || 'a.py' WHEN 1 THEN 'solutions/day' || d || '.py'
    WHEN 2 THEN 'src/' || d || '.py' WHEN 3 THEN 'day' || d || '/main.py'
    WHEN 4 THEN y || '/day' || d || '/sol' || d || '.py' WHEN 5 THEN y || '/' || d || '/a' || d || '.py'
    WHEN 6 THEN 'aoc' || y || '/' || d || '.py' WHEN 7 THEN 'AoC' || y || '/' || lpad(d, 2, '0') || '.py'
    WHEN 8 THEN 'docs/' || d || '/readme.md' ELSE 'src/Day' || lpad(d, 2, '0') || '/x.py' END AS path FROM y),
g AS (SELECT *, regexp_extract(path, '([^/]*)$', 1) AS name, rtrim(regexp_replace(path, '[^/]*$', ''), '/') AS folder FROM f),
dirs AS (SELECT repo, folder FROM g WHERE folder <> ''
  UNION SELECT repo, rtrim(regexp_replace(folder, '[^/]*$', ''), '/') FROM dirs WHERE contains(folder, '/')),
places AS (SELECT year, day, pad, unnest(range(0, 8)) AS idx,
  unnest(['', 'solutions', 'src', 'day' || day, year || '/day' || day, year || '/' || day, 'aoc' || year, 'AoC' || year]) AS place
  FROM cal),
open AS (SELECT r.repo, p.*, (p.idx = 0 OR d.folder IS NOT NULL) AS found
  FROM (SELECT DISTINCT repo FROM g) r CROSS JOIN places p LEFT JOIN dirs d ON d.repo = r.repo AND d.folder = p.place),
reach AS (SELECT *, bool_and(found) OVER (PARTITION BY repo, year, day ORDER BY idx) AS ok FROM open),
hit AS (
  SELECT r.repo, r.year, r.day, r.idx, 0 AS nested, g.pos, g.path FROM reach r JOIN g ON g.repo = r.repo AND g.folder = r.place
  WHERE r.ok AND regexp_matches(g.name, '(?i)(^|[\\D_])(' || r.day || '|' || r.pad || ')($|[\\D_])?\\.py$')
  UNION ALL
  SELECT r.repo, r.year, r.day, r.idx, 1, g.pos, g.path FROM reach r JOIN g ON g.repo = r.repo AND g.folder <> ''
    AND rtrim(regexp_replace(g.folder, '[^/]*$', ''), '/') = r.place
  WHERE r.ok AND regexp_matches(g.name, '(?i)\\.py$')
    AND regexp_matches(regexp_extract(g.folder, '([^/]*)$', 1), '(?i)^(day)?(' || r.day || '|' || r.pad || ')$'))
SELECT repo, year, day, path, pos FROM (
  SELECT *, row_number() OVER (PARTITION BY repo, year, day ORDER BY idx, nested, pos) AS k FROM hit) WHERE k = 1""",
    "decode_blob": "SELECT p_partkey, p_name || ' é' || chr(10) AS code FROM part",
}
