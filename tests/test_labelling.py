"""Labels, joins, splits."""

import hashlib

import pytest
from pyspark.sql import functions as F

from labelmill.operators import labels as lb
from labelmill.operators import splits as sp
from labelmill.operators.cleaning import last_per_key, project_records
from labelmill.sources import samples as sm
from labelmill.vocab import LABEL_CODES, LABEL_NAMES, LABELS


def values(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_vocabulary():
    assert len(LABEL_CODES) == 22 and len(set(LABELS)) == 22 and LABEL_NAMES["VM"] == "virtual_machine"


def test_normalise_labels(spark):
    cases = [([], []), (["Grid"], ["grid_traversal"]), (["BFS", " DFS "], ["breadth_first_search", "depth_first_search"]),
             (["Cellular-Automata", "New Thing"], ["cellular_automata", "new_thing"]), (["", "  "], []),
             (["grid"], ["grid"]), (["scaling"], ["scaling"])]
    df = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(cases)], "i int, l array<string>")
    got = df.select("i", lb.normalise_labels(F.col("l")).alias("o")).orderBy("i").collect()
    assert [r["o"] for r in got] == [w for _, w in cases]


def test_parse_label_text(spark):
    cases = [('["a", "b"]', ["a", "b"]), ("a, b ,,c", ["a", "b", "c"]), ("", []), (None, []), ("one", ["one"]),
             ('["a", b', ['["a"', "b"])]
    df = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(cases)], "i int, l string")
    got = df.select("i", sm.parse_label_text(F.col("l")).alias("o")).orderBy("i").collect()
    assert [r["o"] for r in got] == [w for _, w in cases]


def test_clean_labels(spark):
    df = spark.createDataFrame([(0, None), (1, []), (2, [None, " "]), (3, ["a", None])], "i int, l array<string>")
    got = df.select("i", sm.clean_labels(F.col("l")).alias("o")).orderBy("i").collect()
    assert [r["o"] for r in got] == [["Unknown"], ["Unknown"], ["Unknown"], ["a"]]


def test_matrix_and_first_row(spark):
    wide = spark.createDataFrame([(1, "X", None, "X"), (2, None, "x", None)], "k int, A string, B string, C string")
    assert values(lb.matrix_to_labels(wide, ["k"], ["A", "B", "C"]), "k", "Labels") == [(1, ["A", "C"]), (2, [])]
    rows = spark.createDataFrame([(1, 5, ["late"]), (1, 2, ["first"]), (2, 1, [])], "k int, pos int, Labels array<string>")
    assert values(lb.first_row_per_key(rows, ["k"], "pos"), "k", "Labels") == [(1, ["first"]), (2, [])]


def test_label_join_equals_a_left_join(spark):
    labels = spark.createDataFrame([(y, d, [f"{y}-{d}"]) for y in (1, 2) for d in (1, 2, 3)], "Year int, Day int, Labels array<string>")
    # One key holds most samples; some keys have no label row.
    keys = [(1, 1)] * 300 + [(2, 2)] * 5 + [(9, 9)] * 7
    samples = spark.createDataFrame([(y, d, f"c{i}") for i, (y, d) in enumerate(keys)], "Year int, Day int, Data string")
    got = lb.label_join(labels, samples, ["Year", "Day"])
    want = labels.join(samples, ["Year", "Day"], "left")
    assert got.columns == want.columns
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_attach_labels(spark):
    labels = spark.createDataFrame([(1, ["a"])], "k int, Labels array<string>")
    samples = spark.createDataFrame([(1, "x"), (2, "y"), (None, "z")], "k int, v string")
    assert values(lb.attach_labels(samples, labels, ["k"]), "v", "Labels") == [("x", ["a"]), ("y", []), ("z", [])]


def test_last_per_key(spark):
    rows = [(1, "a", i, f"v{i}") for i in (3, 1, 9, 2)] + [(1, "b", 1, None)]
    df = spark.createDataFrame(rows, "day int, author string, pos int, code string")
    got = last_per_key(df, ["day", "author"], ["pos"])
    assert values(got, "day", "author", "pos", "code") == [(1, "a", 9, "v9"), (1, "b", 1, None)]


def test_project_records(spark):
    rows = [(2015, 1, "s", "x", ["a"], 0), (2014, 1, "s", "x", [], 0), (2015, 26, "s", "x", [], 0), (2016, 25, "s", " \n", [], 0)]
    df = spark.createDataFrame(rows, "Year int, Day int, DataSource string, Data string, Labels array<string>, extra int")
    assert project_records(df).count() == 1 and len(project_records(df).columns) == 5


@pytest.mark.parametrize("n", [1, 9, 10, 1003])
def test_exact_split_sizes_and_order(spark, n):
    df = spark.range(n).withColumn("k", F.concat(F.lit("doc"), F.col("id").cast("string")))
    got = {r["k"]: r["split"] for r in sp.exact_split(df, "k", 7).collect()}
    ranked = sorted(got, key=lambda k: hashlib.md5(f"7:{k}".encode()).hexdigest())
    a, b = int(0.8 * n), int(0.8 * n) + int(0.1 * n)
    assert [got[k] for k in ranked] == ["train"] * a + ["val"] * (b - a) + ["test"] * (n - b)


def test_exact_split_keeps_copies_together(spark):
    df = spark.range(900).select(F.when(F.col("id") < 300, "hot").otherwise(F.col("id").cast("string")).alias("k"))
    rows = sp.exact_split(df, "k").groupBy("k").agg(F.count_distinct("split").alias("n")).where("n > 1").count()
    assert rows == 0


def test_hash_split_is_disjoint_and_stable(spark):
    df = spark.range(5000).select(F.col("id").cast("string").alias("k"))
    one = values(df.select("k", sp.hash_split(F.col("k")).alias("s")), "k", "s")
    two = values(df.repartition(13).select("k", sp.hash_split(F.col("k")).alias("s")), "k", "s")
    sizes = {s: sum(1 for _, x in one if x == s) for s in ("train", "val", "test")}
    assert one == two and sum(sizes.values()) == 5000 and abs(sizes["test"] - 500) < 100 and abs(sizes["val"] - 500) < 100


def test_fallback_val_split(spark):
    one = spark.range(1)
    train, val = sp.fallback_val_split(one, "id")
    assert train.count() == val.count() == 1
    train, val = sp.fallback_val_split(spark.range(1000), "id")
    assert train.count() + val.count() == 1000 and 120 < val.count() < 280
    assert train.intersect(val).count() == 0


def test_multi_hot_round_trip(spark):
    df = spark.createDataFrame([(0, ["b", "zz"]), (1, []), (2, None), (3, ["a", "b"])], "i int, l array<string>")
    hot = df.select("i", *lb.multi_hot(F.col("l"), ["a", "b", "c"]))
    assert values(hot, "i", "a", "b", "c") == [(0, 0, 1, 0), (1, 0, 0, 0), (2, 0, 0, 0), (3, 1, 1, 0)]
    back = hot.select("i", lb.label_string(["a", "b", "c"]).alias("s"))
    assert values(back, "i", "s") == [(0, "b"), (1, "No Label"), (2, "No Label"), (3, "a, b")]


def test_cardinality(spark):
    df = spark.createDataFrame([([],), (["a"],), (["a", "b"],)], "l array<string>")
    assert [r[0] for r in df.select(sp.cardinality(F.col("l"))).collect()] == [None, "single", "multi"]
