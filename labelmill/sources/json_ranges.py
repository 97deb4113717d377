"""Reads one huge JSON document by many tasks.

A document without line breaks is one record to a line reader.  Here the quote is the record separator, so Spark splits the file
into byte ranges as it does with lines, and a record is a *fragment*: what lies between two quotes.  Whether a fragment is
inside a string, how deep it is and which member it belongs to depend on all text before it.  These are prefix sums, taken in two
levels: each range is summed up in one row, a window over a file's ranges gives what each range starts with, and a
window within a range does the rest.  No task sees more than a range, a member or the ranges' summaries.

1. A quote is real if an even number of backslashes precedes it; an odd number of real quotes before a fragment puts it inside a string.
   A range does not know its first parity yet, so its summary holds the brackets it opens for either.
2. With parity and depth known, brackets and commas down to the depth asked for are cuts, counted per level in the same two steps.
3. Fragments between two cuts are one member ``"key": value`` or element, put together by a shuffle on its number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RANGE = ["path", "block"]


def fragments(spark: SparkSession, path: str) -> DataFrame:
    """(path, block, id, value): the fragments of every file; ``id`` orders those of a byte range.  Compressed files are one range."""
    return spark.read.text(path, lineSep='"').select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("id"), "value")


def _count(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def _before(order: list[str], keys: list[str]):
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)


def _sum_before(value: Column | str, window) -> Column:
    return F.coalesce(F.sum(value).over(window), F.lit(0))


def _tokens(parts: DataFrame) -> DataFrame:
    """(path, block, id, pos, text, own, level): the document cut at its brackets and commas; ``own`` is the depth of the
    container that a token lies in, ``level`` that of the container whose bracket or comma it is, null for other tokens."""
    real = (F.length("value") - F.length(F.expr(r"rtrim('\\', value)"))) % 2 == 0
    step = _count(F.col("value"), "{[") - _count(F.col("value"), "}]")
    local = parts.withColumns({"real": real.cast("long"), "step": step}).withColumn(
        "odd", _sum_before("real", _before(["id"], RANGE)) % 2)
    ranges = local.groupBy(*RANGE).agg(
        F.sum("real").alias("quotes"), F.sum(F.when(F.col("odd") == 0, F.col("step")).otherwise(0)).alias("even_steps"),
        F.sum(F.when(F.col("odd") == 1, F.col("step")).otherwise(0)).alias("odd_steps"))
    earlier, whole = _before(["block"], ["path"]), Window.partitionBy("path")
    starts = ranges.withColumn("start_odd", _sum_before("quotes", earlier) % 2).withColumn(
        "steps", F.when(F.col("start_odd") == 0, F.col("even_steps")).otherwise(F.col("odd_steps")))
    # The last fragment counts as if a quote followed, so a balanced document has an odd number of them.
    starts = starts.withColumns({
        "start_depth": _sum_before("steps", earlier), "all_quotes": F.sum("quotes").over(whole), "all_steps": F.sum("steps").over(whole),
    }).where("all_quotes % 2 = 1 and all_steps = 0").select(*RANGE, "start_odd", "start_depth")
    known = local.join(starts, RANGE).withColumn("inside", (F.col("odd") + F.col("start_odd")) % 2 == 1)
    cut = F.expr(r"regexp_extract_all(value, '[{}\\[\\],]|[^{}\\[\\],]+', 0)")
    pieces = F.when(F.col("inside"), F.array(F.concat("value", F.lit('"')))).otherwise(F.concat(cut, F.array(F.lit('"'))))
    tokens = known.select(*RANGE, "id", "inside", "start_depth", F.posexplode(pieces).alias("pos", "text"))
    mark = F.when(~F.col("inside") & F.col("text").isin(*"{}[],"), F.col("text"))
    tokens = tokens.withColumn("mark", mark).withColumn(
        "turn", F.when(F.col("mark").isin("{", "["), 1).when(F.col("mark").isin("}", "]"), -1).otherwise(0))
    depth = F.col("start_depth") + _sum_before("turn", _before(["id", "pos"], RANGE))
    return tokens.withColumn("depth", depth).select(
        *RANGE, "id", "pos", "text", "mark", F.least("depth", F.col("depth") + F.col("turn")).alias("own"),
        F.when(F.col("mark").isNotNull(), F.greatest("depth", F.col("depth") + F.col("turn"))).alias("level"))


def members(parts: DataFrame, depth: int) -> DataFrame:
    """(path, level, n1 ... n<depth>, number, text): members and elements of all containers down to ``depth`` (1: the outermost).

    ``parts`` are fragments (path, block, id, value).  Text is ``"key": value`` in an object and the value in an array; a
    member whose value is a container of a level that is cut, too, ends after its colon.  ``n<k>`` counts the members of
    level k in the document up to this one, so a member's parent is the one of level k - 1 with the same n1 ... n<k-1>;
    ``opens`` is the bracket of its own container, ``place`` its place in there from 0.  A document whose quotes or brackets do not balance gives no rows, nor
    does an empty file.  Repeated keys stay repeated.
    """
    levels = [f"n{k}" for k in range(1, depth + 1)]
    tokens = _tokens(parts).withColumn("cut", F.col("level") <= depth)
    counted = {n: (F.coalesce((F.col("level") == k) & F.col("mark").isin("{", "[", ","), F.lit(False))).cast("long")
               for k, n in enumerate(levels, 1)}
    counted["number"] = F.coalesce("cut", F.lit(False)).cast("long")
    # What a container starts with is found from the count at its opening bracket.
    tokens = tokens.withColumns(counted)
    names = [*levels, "number"]
    sums = tokens.groupBy(*RANGE).agg(*[F.sum(n).alias(f"_{n}") for n in names])
    starts = sums.select(*RANGE, *[_sum_before(f"_{n}", _before(["block"], ["path"])).alias(f"_{n}") for n in names])
    so_far = Window.partitionBy(*RANGE).orderBy("id", "pos").rowsBetween(Window.unboundedPreceding, 0)
    placed = tokens.join(starts, RANGE).withColumns({n: F.sum(n).over(so_far) + F.col(f"_{n}") for n in names})
    piece = F.when(~F.coalesce("cut", F.lit(False)), F.struct("block", "id", "pos", "text"))
    found = placed.groupBy("path", "number").agg(
        F.min(F.when(~F.coalesce("cut", F.lit(False)), F.col("own"))).alias("level"),
        F.array_join(F.transform(F.array_sort(F.collect_list(piece)), lambda t: t["text"]), "").alias("text"),
        *[F.max(n).alias(n) for n in levels])
    found = found.where(F.col("level").between(1, depth) & (F.trim("text") != "") & (F.col("text") != '"'))
    # A container's bracket and first count, by its parent's number: one row per container.
    opened = None
    for k in range(1, depth + 1):
        own = placed.where((F.col("level") == k) & F.col("mark").isin("{", "[")).select(
            "path", F.lit(k).alias("level"), (F.col(levels[k - 2]) if k > 1 else F.lit(0)).cast("long").alias("_parent"),
            F.col("mark").alias("opens"), F.col(levels[k - 1]).alias("_first"))
        opened = own if opened is None else opened.unionByName(own)
    above = F.lit(0)
    mine = F.col(levels[0])
    for k in range(2, depth + 1):
        above = F.when(F.col("level") == k, F.col(levels[k - 2])).otherwise(above)
        mine = F.when(F.col("level") == k, F.col(levels[k - 1])).otherwise(mine)
    joined = found.withColumn("_parent", above.cast("long")).join(opened, ["path", "level", "_parent"])
    return joined.select("path", "level", *levels, "number", "opens", (mine - F.col("_first")).alias("place"), "text")


def key_of(text: Column) -> Column:
    """The key of a member whose value is cut off: ``"key":``."""
    return F.get(F.map_keys(F.from_json(F.concat(F.lit("{"), text, F.lit("null}")), "map<string,string>")), F.lit(0))


def inner(spark_rows: DataFrame, depth: int) -> DataFrame:
    """The members of level ``depth`` with the keys of their parents as k1 ... k<depth-1>."""
    levels = [f"n{k}" for k in range(1, depth + 1)]
    out = spark_rows.where(F.col("level") == depth)
    for k in range(1, depth):
        parents = spark_rows.where((F.col("level") == k) & (F.col("opens") == "{") & F.rtrim("text").endswith(":")).select(
            "path", levels[k - 1], key_of(F.col("text")).alias(f"k{k}"))
        out = out.join(parents, ["path", levels[k - 1]])
    return out
