"""Golden cases for pages, URLs and repository listings."""

import random
import re

import pytest
from pyspark.sql import functions as F

from labelmill.functions.html import BlockSpec, page_blocks
from labelmill.operators import pages as pg
from labelmill.operators import repos as rp

PAGE = """<html><body><div class="commentarea"><!-- x -->
<div class="thing comment"><p class="tagline"><a class="author id-1" href="#">ann</a> <a class="author">no</a></p>
 <div class="md"><p>one <b> two </b>three &amp; four</p><p>5 &lt; 6<br>tail</p><blockquote><p>quote</p></blockquote>
 <pre><code>a = 1
b = <span>2</span></code></pre><pre><code>second</code></pre></div>
 <div class="child"><div class="comment"><a class="author">bob</a><div class="md"><p>reply</p></div></div></div>
</div><div class="comment deleted"><div class="md"></div><code>loose</code></div></div></body></html>"""


def test_blocks_include_nested_blocks():
    got = page_blocks(PAGE, BlockSpec())
    first = "one" + "two" + "three & four\n5 < 6tail\nreply"
    assert got == [
        ("ann", first, "a = 1\nb =2"),
        ("ann", first, "a = 1\nb =2"),
        ("bob", "reply", None),
        (None, "", None),
    ]


def test_links_of_table_cells(spark):
    page = ('<nav><a href="/nav">n</a></nav><table><tr><td><a rel="x" href="/d1">1</a></td><td>'
            "<a href='/d2'>2</a></td><th><a href=\"/no\">h</a></th><td><b><a href=/d3?a=1&amp;b=2>3</a></b></td></tr></table>")
    df = spark.createDataFrame([(7, page), (8, None), (9, "<td><a>x</a>")], "k int, html string")
    got = [tuple(r) for r in pg.extract_links(df, "html", "k").orderBy("k", "day").collect()]
    assert got == [(7, 1, "/d1"), (7, 2, "/d2"), (7, 3, "/d3?a=1&b=2")]
    assert pg.extract_links(df, "html", "k", within=None).where("k = 7").count() == 5


def test_own_blocks_only():
    got = page_blocks(PAGE, BlockSpec(own_only=True))
    assert got[0] == (None, "", None)
    assert got[1] == ("ann", "onetwothree & four\n5 < 6tail", "a = 1\nb =2")
    assert got[2] == ("bob", "reply", None)


@pytest.mark.parametrize("html", [None, "", "<div class='comment'", "</div></p>", "<div class=comment><p>x", "text"])
def test_broken_pages_do_not_fail(html):
    assert isinstance(page_blocks(html, BlockSpec()), list)


def test_forum_solutions(spark):
    def page(rank, code):
        return (f'<div class="comment"><a class="author">u</a><div class="md"><p>[lang: py] {rank}</p>'
                f"<pre><code>{code}</code></pre></div></div>")

    pages = [page("12/900", "x = 1"), page("900/901", "print 'a'"), page("900/901", "def f(:"), page("", "ok()")]
    df = spark.createDataFrame(list(enumerate(pages)), "id int, html string")
    got = pg.forum_solutions(df, "html", "id").select("id", "author", "code").orderBy("id").collect()
    assert [tuple(r) for r in got] == [(1, "u", "print('a')"), (3, "u", "ok()")]


def test_urls(spark):
    urls = ["https://www.x.com/www/2021_day_5_solutions", "/r/abc", "https://github.com/u/r/blob/main/a.py",
            " https://github.com/u/r ", "https://github.com/u", "xhttps://github.com/u/r"]
    df = spark.createDataFrame(list(enumerate(urls)), "id int, url string")
    user, repo = pg.parse_repo_url(F.col("url"))
    rows = df.select(
        pg.rewrite_url(F.col("url"), F.lit(2021), "B").alias("a"), pg.rewrite_url(F.col("url"), F.lit(2023), "B").alias("b"),
        pg.puzzle_key(F.col("url")).alias("k"), pg.raw_blob_url(F.col("url")).alias("raw"), user.alias("u"), repo.alias("r"),
    ).orderBy("id").collect()
    assert rows[0]["a"] == "https://old.x.com/old/2021_day_5_solutions" and rows[0]["k"] == "2021_5"
    assert rows[1]["b"] == "B/r/abc" and rows[1]["k"] is None
    assert rows[2]["raw"] == "https://raw.githubusercontent.com/u/r/main/a.py" and rows[1]["raw"] is None
    assert [(r["u"], r["r"]) for r in rows[2:]] == [("u", "r"), ("u", "r"), (None, None), (None, None)]


def _forms(year, day, numbered_any):
    pad = f"{day:02d}"
    any_day = rf"day[_-]?({day}|{pad})\.py$"
    number = r"\d{1,2}" if numbered_any else f"({day}|{pad})"
    return [any_day, rf"day[_-]?{year}_({day}|{pad})\.py$", rf"{year}/{number}\.py$",
            rf"{year}/day({day}|{pad})/.*\.py$"]


def _brute(files, numbered_any):
    out = {}
    for repo in {r for r, _, _ in files}:
        for year in range(2015, 2024):
            for day in range(1, 26):
                hits = [(0 if f"{year}/" in p else 1, pos, p) for r, pos, p in files if r == repo and any(
                    re.search(f, p, re.IGNORECASE) for f in _forms(year, day, numbered_any))]
                if hits:
                    out[repo, year, day] = min(hits)[2]
    return out


@pytest.mark.parametrize("numbered_any", [False, True])
def test_solution_paths_against_brute_force(spark, numbered_any):
    rng = random.Random(3)
    names = ["2021/day05.py", "2021/07.py", "aoc2020/day_5.py", "src/day5.py", "12021/day05/2020/day06/x.py",
             "2018/a/day-12.py", "day_2019_03.py", "2022/day3/main.PY", "day005.py", "2021/day05.py.bak", "day26.py",
             "2021/2020/DAY9.py", "2014/day1.py", "2023/30.py", "days/day1", "2020/day11/sub/day2.py"]
    files = [(f"r{rng.randrange(3)}", i, rng.choice(names)) for i in range(40)]
    df = spark.createDataFrame(files, "repo string, pos int, path string").repartition(4)
    got = rp.match_solution_path(df, numbered_any_day=numbered_any).collect()
    assert {(r["repo"], r["year"], r["day"]): r["path"] for r in got} == _brute(files, numbered_any)
    assert len(got) == len(_brute(files, numbered_any))


def test_strict_search_stops_at_a_missing_folder(spark):
    files = [("full", 0, "readme.md"), ("full", 1, "solutions/x.py"), ("full", 2, "src/y.py"), ("full", 3, "day4/n.txt"),
             ("full", 4, "2020/day4/best4.py"), ("gap", 0, "solutions/x.py"), ("gap", 1, "day4/a.py"),
             ("gap", 2, "2020/day5/best5.py"), ("root", 0, "d04.py"), ("root", 1, "04/first.py"), ("root", 2, "day4.py")]
    df = spark.createDataFrame(files, "repo string, pos int, path string")
    got = {(r["repo"], r["year"], r["day"]): r["path"] for r in rp.match_day_file(df).collect()}
    assert got["full", 2020, 4] == "2020/day4/best4.py" and ("full", 2021, 4) not in got
    assert got["gap", 2016, 4] == "day4/a.py" and ("gap", 2020, 5) not in got
    assert got["root", 2015, 4] == "d04.py" and len([k for k in got if k[0] == "root"]) == 9


def test_decode_blob(spark):
    df = spark.createDataFrame([("w6kK\n", "base64"), ("plain", "utf-8"), ("raw", None)], "c string, e string")
    assert [r[0] for r in df.select(rp.decode_blob(F.col("c"), F.col("e"))).collect()] == ["é\n", "plain", "raw"]


def test_page_text_is_the_whole_page(spark):
    rows = [
        "<html><nav><a href='/'>Home</a></nav><h1>A &amp; B</h1><p> one <b>bold</b></p><p>two<ul><li>first<li>second</ul><p>three</html>",
        "<h1>x</h1><h1>y</h1><div><p>in<script>no()</script>side</div>out<ul><li>a<ul><li>b</li></ul></li></ul>", "no parts", "", None,
    ]
    docs = spark.createDataFrame(list(enumerate(rows)), "page_id long, html string")
    got = [tuple(r)[1:] for r in pg.extract_page_text(docs, "html", "page_id").orderBy("page_id").collect()]
    assert got == [("A & B", "one bold\ntwo\nthree", "first"), ("x", "inside", "ab"), (None, "", None), (None, "", None), (None, "", None)]
