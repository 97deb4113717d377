"""Readers and writers, round trips through files."""

import json

import pytest
from pyspark.sql import functions as F

from labelmill.operators.splits import cardinality, hash_split
from labelmill.session import ensure_checkpoint_dir
from labelmill.sources import nested_json as nj
from labelmill.sources import samples as sm
from labelmill.sources import sinks
from labelmill.vocab import LABEL_CODES


def write(folder, name, value):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text(json.dumps(value, indent=1), encoding="utf-8")


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_nested_solutions(spark, tmp_path):
    write(tmp_path, "lb_2016.json", {"1": {"u": "x = 1", "n": None}, "bad": {"a": "b"}, "2": [1], "3": {}, "26": {"q": "z"}, "4": 5})
    got = rows(nj.read_nested_solutions(spark, str(tmp_path)), "day", "id", "code")
    assert got == [(1, "n", None), (1, "u", "x = 1")]


def test_thread_solutions(spark, tmp_path):
    comments = [{"author": "a", "code": "1", "language": "Python "}, {"code": "2"}, {"author": None}]
    write(tmp_path, "t.json", {"2015": {"1": {"puzzle_id": "2015_1", "url": "u", "comments": comments}, "30": {"comments": comments}}})
    got = rows(nj.read_thread_solutions(spark, str(tmp_path)), "year", "day", "author", "code")
    assert got == [(2015, 1, "a", "1"), (2015, 1, "unknown", ""), (2015, 1, "unknown", "2")]


def test_thread_urls(spark, tmp_path):
    write(tmp_path, "u.json", {"2015": ["x", "y"], "2016": []})
    assert rows(nj.read_thread_urls(spark, str(tmp_path)), "year", "day", "url") == [(2015, 1, "x"), (2015, 2, "y")]


def test_tagged_dir(spark, tmp_path):
    write(tmp_path, "lb_2016.json", {"1": {"u": "c1", "e": ""}})
    write(tmp_path, "reddit_2017.json", {"2": {"u": "c2", "n": None}})
    write(tmp_path, "extra_repos_2018.json", {"3": {"u": "c3"}})
    got = rows(nj.read_tagged_dir(spark, str(tmp_path)), "source", "year", "day", "id", "code")
    assert got == [("extra", 2018, 3, "u", "c3"), ("leaderboard", 2016, 1, "u", "c1"), ("reddit", 2017, 2, "u", "c2")]


def test_label_matrix(spark, tmp_path):
    head = "Year,Day,Title,Cmnts,Thread,P1Desc,P2Desc,P1Lead,P2Lead,P1LOC,P2LOC," + ",".join(LABEL_CODES)
    marks = ["X" if c in ("Grid", "BFS") else "" for c in LABEL_CODES]
    (tmp_path / "m.csv").write_text(head + "\n2015,25,\"A, b\",1,u,2,3,0'1'2,1’2,4,," + ",".join(marks) + "\n", encoding="utf-8")
    from labelmill.operators.labels import matrix_to_labels

    wide = sm.read_label_matrix(spark, str(tmp_path / "m.csv"))
    assert wide.head()["P2LOC"] is None and wide.head()["Title"] == "A, b"
    assert rows(matrix_to_labels(wide, ["Year", "Day"], LABEL_CODES), "Year", "Day", "Labels") == [(2015, 25, ["Grid", "BFS"])]


def test_sample_readers(spark, tmp_path):
    records = [
        {"Year": 2015, "Day": 1, "DataSource": "reddit", "Data": "a", "Labels": ["Grid", None, " "]},
        {"code": "b", "Labels": "Opt, BFS"}, {"Data": " ", "Labels": ["x"]}, {"Data": None, "Labels": ["x"]},
        {"Data": "c", "Labels": []}, {"Data": "d", "Labels": "[\"Sim\"]"}, {"Data": "e"},
        {"code": "f", "labels": ["Log"], "year": 2019, "day": 2, "source": "leaderboard"}, {"Data": "g", "Labels": None},
    ]
    write(tmp_path, "train.json", records)
    got = dict(rows(sm.read_samples(spark, str(tmp_path)), "code", "labels"))
    assert got == {"a": ["Grid"], "b": ["Opt, BFS"], "c": ["Unknown"], "d": ['["Sim"]'], "f": ["Log"], "g": ["Unknown"]}
    got = dict(rows(sm.read_samples(spark, str(tmp_path), "text"), "code", "labels"))
    assert got == {"a": ["Grid"], "b": ["Opt", "BFS"], "c": [], "d": ["Sim"], "e": [], "f": ["Log"]}
    (tmp_path / "lines").mkdir()
    (tmp_path / "lines" / "x.json").write_text("\n".join(json.dumps(r) for r in records))
    same = rows(sm.read_samples(spark, str(tmp_path / "lines"), lines=True), "Year", "DataSource", "code", "labels")
    assert same == rows(sm.read_samples(spark, str(tmp_path / "train.json")), "Year", "DataSource", "code", "labels")
    assert (2019, "leaderboard", "f", ["Log"]) in same


@pytest.fixture()
def samples(spark):
    df = spark.range(200).select(
        F.lit(2015).alias("Year"), (F.col("id") % 25 + 1).cast("int").alias("Day"),
        F.when(F.col("id") % 3 == 0, "reddit").otherwise("github").alias("DataSource"),
        F.concat(F.lit("x = "), F.col("id").cast("string"), F.lit(' \n"q", é')).alias("Data"),
        F.when(F.col("id") % 2 == 0, F.array(F.lit("Grid"))).otherwise(F.array(F.lit("Grid"), F.lit("BFS"))).alias("Labels"),
    )
    return df.withColumn("split", hash_split(F.col("Data")))


def test_write_and_load_samples(spark, samples, tmp_path):
    out = str(tmp_path / "set")
    sinks.write_samples(samples, out)
    back = sm.load_splits(spark, out)
    assert back.select(*samples.columns).exceptAll(samples).count() == 0 and back.count() == 200
    test = back.where((F.col("split") == "test") & (F.col("DataSource") == "reddit"))
    assert "PartitionFilters: [isnotnull(split" in test._jdf.queryExecution().executedPlan().toString()
    assert back.where(cardinality(F.col("Labels")) == "multi").count() == 100
    sinks.write_samples(samples.where("split <> 'val'"), str(tmp_path / "two"))
    with pytest.raises(FileNotFoundError):
        sm.load_splits(spark, str(tmp_path / "two"))
    assert sm.load_splits(spark, str(tmp_path / "two"), strict=False).count() < 200


def test_labelled_table_and_ngrams(spark, samples, tmp_path):
    from labelmill.operators.labels import label_join

    labels = spark.createDataFrame([(2015, 1, ["Grid"]), (2016, 1, ["Sim"])], "Year int, Day int, Labels array<string>")
    joined = label_join(labels, samples.drop("Labels"), ["Year", "Day"])
    sinks.write_labelled_table(joined, str(tmp_path / "p"), str(tmp_path / "c"))
    assert spark.read.parquet(str(tmp_path / "p")).where("Data is null").count() == 1
    csv = spark.read.csv(str(tmp_path / "c"), header=True, multiLine=True, escape='"')
    assert csv.count() == joined.count() and csv.where("Labels = '[\"Sim\"]'").count() == 1
    sinks.write_ngrams(samples, str(tmp_path / "n"), 3)
    grams = spark.read.json(str(tmp_path / "n")).where("Data like 'x = 7 %'").head()["ngrams"]
    assert grams == [["x", "=", "7"], ["=", "7", '"q",'], ["7", '"q",', "é"]]


def test_projection_and_metrics(spark, tmp_path):
    df = spark.createDataFrame([(1.0, 2.0, "a, b", 'say "hi"')], "x double, y double, label string, snippet string")
    sinks.export_projection(df, str(tmp_path / "p"))
    back = spark.read.csv(str(tmp_path / "p"), header=True, escape='"').head()
    assert (back["label"], back["snippet"]) == ("a, b", 'say "hi"')
    metrics = spark.createDataFrame([("overall", "all", "f1_micro", 0.5)], "slice_type string, slice string, metric string, value double")
    sinks.save_metrics(metrics, str(tmp_path / "m"))
    assert spark.read.parquet(str(tmp_path / "m")).collect() == metrics.collect()


def test_checkpoint_folder_comes_from_the_session(spark):
    folder = ensure_checkpoint_dir(spark)
    assert folder and ensure_checkpoint_dir(spark) == folder
