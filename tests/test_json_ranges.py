"""One JSON document read by byte ranges, against the readers of whole documents."""

import json
import random

import pytest
from pyspark.sql import functions as F

from labelmill.sources import json_ranges as jr
from labelmill.sources import nested_json as nj
from labelmill.sources import samples as sm

ODD = ['say "hi"', "back\\", '\\"', "{[,]}", "é漢\n", "", '"', 'a\\\\"b', "}, {", None, 7, True, {"x": ["y", {}]}, [1, "2"]]


@pytest.fixture()
def ranges(spark):
    """Byte ranges of 64 bytes, so that strings, keys and escapes lie across many of them."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    old = [spark.conf.get(n) for n in names]
    for n, v in zip(names, ("64b", "0")):
        spark.conf.set(n, v)
    yield
    for n, v in zip(names, old):
        spark.conf.set(n, v)


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_solutions(spark, ranges, tmp_path):
    rng = random.Random(1)
    document = {
        str(day): {f'u"{i}\\' if i % 3 == 0 else f"u{i}": rng.choice(ODD) for i in range(12)} for day in range(1, 6)}
    document |= {"bad": {"a": "b"}, "7": [1, "x", {"k": "v"}], "8": {}, "26": {"q": "z"}, "9": 5, "10": "s"}
    (tmp_path / "a_2016.json").write_text(json.dumps(document, ensure_ascii=False), encoding="utf-8")
    (tmp_path / "b_2017.json").write_text(json.dumps({"1": {"n": None, "u": "x = 1"}}, indent=2) + "\n", encoding="utf-8")
    (tmp_path / "empty.json").write_text("")
    (tmp_path / "torn.json").write_text('{"1": {"a": "b", "c": "d')
    parts = jr.fragments(spark, str(tmp_path))
    assert parts.where("path like '%a_2016.json'").select("block").distinct().count() > 5
    got = rows(nj.read_nested_solutions(spark, str(tmp_path), splittable=True), "path", "day", "id", "code")
    assert got == rows(nj.read_nested_solutions(spark, str(tmp_path)), "path", "day", "id", "code")
    assert len(got) == 62


def test_threads(spark, ranges, tmp_path):
    comments = [{"author": f"a{i}", "code": c, "language": "Python"} for i, c in enumerate(ODD[:9])]
    thread = {"puzzle_id": "p", "url": "u", "comments": [*comments, {"code": "2"}, {"author": None}, {}, None]}
    other = {"url": "u", "comments": [], "puzzle_id": '"'}
    (tmp_path / "t.json").write_text(json.dumps(
        {"2015": {"1": thread, "30": thread, "2": other}, "2016": {"3": {"comments": [{"code": "last"}]}, "4": {}}}))
    columns = ("year", "day", "pos", "author", "code")
    got = rows(nj.read_thread_solutions(spark, str(tmp_path), splittable=True), *columns)
    assert got == rows(nj.read_thread_solutions(spark, str(tmp_path)), *columns)
    assert len(got) == 14 and (2016, 3, 0, "unknown", "last") in got


def test_records(spark, ranges, tmp_path):
    records = [{"Year": 2015, "Day": i, "DataSource": "reddit", "Data": f'x = "{i}" [', "Labels": ["Grid", None, "}"]} for i in range(9)]
    (tmp_path / "r.json").write_text(json.dumps([*records, {}, None, {"code": "b", "labels": "Opt, BFS"}]))
    columns = ("Year", "Day", "DataSource", "code", "labels")
    for style in ("list", "text"):
        got = rows(sm.read_samples(spark, str(tmp_path), style, splittable=True), *columns)
        assert got == rows(sm.read_samples(spark, str(tmp_path), style), *columns) and len(got) == 10


def test_members_name_their_container(spark):
    value = '{"a": [1, {"b": 2}], "c": {}}'
    parts = spark.createDataFrame([("p", 0, i, v) for i, v in enumerate(value.split('"'))], "path string, block long, id long, value string")
    got = rows(jr.members(parts, 2).withColumn("text", F.trim("text")), "level", "opens", "place", "text")
    assert got == [(1, "{", 0, '"a":'), (1, "{", 1, '"c":'), (2, "[", 0, "1"), (2, "[", 1, '{"b": 2}')]
    assert jr.members(parts.limit(0), 2).count() == 0
