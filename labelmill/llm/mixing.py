"""Mixing sources to target weights, by DataFrame functions only.

Each source's documents, in a pseudorandom order, form one stream of tokens that is cut into blocks of a fixed length; the
last block of a source is shorter.  Output shards have a fixed number of slots.  A shard draws how many of its slots each source
gets: multinomial counts by systematic sampling (slot k of n takes the source at (k + u) / n of the cumulated shares, with one
random u per shard), whose mean is exact and which differ from it by less than one slot per shard.  A source numbers its slots over all
shards, and slot j takes block pi(j mod blocks) in pass j div blocks, pi being the pass's own permutation of the
block numbers.  A join by source and block number gives each slot its documents.

Order numbers and stream offsets come from two-level prefix sums, so no source's rows meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelmill.llm.common import checkpoint

BLOCK_TOKENS, SHARD_SLOTS = 128, 256
BUCKETS = 1024            # parts of a source in the first level of its prefix sum
CELLS = 4096              # parts of the unit interval that slots and sources meet in
MOST_PASSES = 3
WEIGHTS = (1.0, 2.0, 3.0)
# Fixed value: what separates tokens.
SPACE = r"[\x20\x09-\x0D]+"
# Multipliers of the permutations: primes, so that they share no factor with a smaller block number.
PRIMES = (2147483647, 2147483629, 2147483587, 2147483579, 2147483563, 2147483549, 2147483543, 2147483497)


def token_count(text: Column) -> Column:
    """Runs of other characters than ASCII white space; 0 for null."""
    squeezed = F.trim(F.regexp_replace(text, SPACE, " "))
    spaces = F.length(squeezed) - F.length(F.replace(squeezed, F.lit(" "), F.lit("")))
    return F.coalesce(F.when(squeezed != "", spaces + 1), F.lit(0)).cast("long")


def _random(*parts) -> Column:
    """A number in [0, 1) that depends on the parts only."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 40)) / float(1 << 40)


def source_targets(sizes: DataFrame, weights=WEIGHTS, most: float = MOST_PASSES) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Sources by code point, null last, weigh ``weights`` in turn and share the sum of all sizes; a target stops at ``most``
    times its source's size and the excess is shared again by weight among the others until none is above.  With
    sources in order of size / weight that is one prefix sum: a source is capped if the water level, what is left
    over the weight that is left, is above ``most`` times its size / weight.
    """
    # One row per source.
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    listed = F.array(*[F.lit(float(w)) for w in weights])
    w = sizes.withColumn("w", F.get(listed, F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))))
    w = w.where("source_size > 0").withColumn("cap", most * F.col("source_size"))
    rise = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), F.col("source").cast("binary"))
    before = rise.rowsBetween(Window.unboundedPreceding, -1)
    all_rows = Window.partitionBy()
    left = F.sum("source_size").over(all_rows) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    weight = F.sum("w").over(all_rows) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    w = w.withColumn("level", left / weight)
    # The first source that stays below its cap fixes the level for all that follow.
    free = F.min(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct(F.col("cap") / F.col("w"), "level"))).over(all_rows)
    target = F.least(F.col("cap"), F.coalesce(free["level"] * F.col("w"), F.col("cap")))
    return w.select("source", F.col("source_size"), target.alias("target"))


def _offsets(rows: DataFrame, group: str, bucket: Column, order: list, size: Column) -> DataFrame:
    """``rows`` with _start: the sum of ``size`` over the rows of the group before this one, by bucket, then ``order``."""
    rows = rows.withColumn("_bucket", bucket)
    sums = rows.groupBy(group, "_bucket").agg(F.sum(size).alias("_sum"))
    earlier = Window.partitionBy(group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(group, "_bucket", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_low"))
    inside = Window.partitionBy(group, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    within = rows.withColumn("_in", F.coalesce(F.sum(size).over(inside), F.lit(0)))
    return within.join(sums, [group, "_bucket"]).withColumn("_start", F.col("_low") + F.col("_in")).drop(
        "_bucket", "_low", "_in")


def _permuted(j: Column, n: Column, *seed) -> Column:
    """A permutation of 0 .. n - 1 that the seed chooses."""
    prime = F.get(F.array(*[F.lit(p) for p in PRIMES]), F.pmod(F.xxhash64(*seed, F.lit("a")), F.lit(len(PRIMES))).cast("int"))
    # Products stay below 2^63 for block numbers below 2^31.
    return F.pmod(F.pmod(prime, n) * j + F.pmod(F.xxhash64(*seed, F.lit("b")), n), n)


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS,
        block_tokens: int = BLOCK_TOKENS, shard_slots: int = SHARD_SLOTS, most: int = MOST_PASSES,
        seed: int = 42) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, targets, pieces).

    rows: doc_id, source, size, copy of every row of ``docs``; copy numbers rows of one key, source and size, so that
    (doc_id, source, size, copy) names a row.  targets: source, source_size, target.  pieces: shard, slot, place,
    doc_id, source, size, copy, first, n_tokens: what each slot takes, in order of place; first is the token of the document
    it starts with.  Null text has size 0 and is never taken; null sources are one source.  Results depend on the rows and
    the seed only, not on partitions or order.
    """
    rows = docs.select(F.col(key).alias("doc_id"), F.col(source).cast("string").alias("source"),
                       token_count(F.col(text)).alias("size"))
    # Rows that repeat a key are told apart by their number; a hot null key is dealt by size and source as well.
    same = Window.partitionBy("doc_id", "source", "size").orderBy("doc_id")
    rows = checkpoint(rows.withColumn("copy", F.row_number().over(same)).withColumn(
        "name", F.coalesce(F.concat(F.lit("="), "source"), F.lit("null"))))
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = checkpoint(source_targets(sizes, weights, most))

    # Sources: blocks, mean tokens of a block, and the share of slots.
    named = targets.withColumn("name", F.coalesce(F.concat(F.lit("="), "source"), F.lit("null")))
    plan = named.withColumn("blocks", F.ceil(F.col("source_size") / block_tokens).cast("long")).withColumn(
        "slots", F.col("target") * F.col("blocks") / F.col("source_size"))
    up_to = Window.orderBy("name").rowsBetween(Window.unboundedPreceding, 0)
    all_rows = Window.partitionBy()
    plan = plan.withColumn("total", F.sum("slots").over(all_rows)).withColumn("high", F.sum("slots").over(up_to) / F.col("total"))
    plan = plan.withColumn("low", F.coalesce(F.lag("high").over(Window.orderBy("name")), F.lit(0.0))).withColumn(
        "last", F.col("name") == F.max("name").over(all_rows))
    plan = checkpoint(plan.withColumn("high", F.when(F.col("last"), 2.0).otherwise(F.col("high"))).select(
        "name", "blocks", "low", "high", "total"))
    total = plan.agg(F.max("total")).head()[0] or 0.0
    n_slots = int(round(total))

    # Slots: source by systematic sampling within the shard; sources and slots meet in cells of the unit interval.
    slot = docs.sparkSession.range(n_slots).select("id", F.floor(F.col("id") / shard_slots).alias("shard"))
    full = F.least(F.lit(shard_slots), F.lit(n_slots) - F.col("shard") * shard_slots)
    point = (F.col("id") - F.col("shard") * shard_slots + _random(F.lit(seed), "shard")) / full
    slot = slot.withColumn("point", point).withColumn("cell", F.least(F.floor(F.col("point") * CELLS), F.lit(CELLS - 1)))
    cell_of = lambda x: F.least(F.floor(F.least(x, F.lit(1.0)) * CELLS), F.lit(CELLS - 1))
    ranges = plan.select("name", "blocks", "low", "high", F.explode(F.sequence(cell_of(F.col("low")), cell_of(F.col("high")))).alias("cell"))
    drawn = slot.join(ranges, "cell").where("point >= low and point < high").select("id", "shard", "name", "blocks")

    # Each source numbers its slots; slot j takes a block of pass j div blocks.
    numbered = _offsets(drawn, "name", F.floor(F.col("shard") / 64), ["id"], F.lit(1).cast("long"))
    turn = F.floor(F.col("_start") / F.col("blocks"))
    taken = numbered.where(F.col("_start") < F.col("blocks") * most).select(
        "shard", F.col("id").alias("slot"), "name",
        _permuted(F.pmod(F.col("_start"), F.col("blocks")), F.col("blocks"), F.lit(seed), F.col("name"), turn).alias("block"))

    # Documents in stream order, cut at block bounds.
    streamed = rows.where("size > 0").withColumn("_h", F.xxhash64(F.lit(seed), "doc_id", "size", "copy"))
    streamed = _offsets(streamed, "name", F.pmod(F.col("_h"), F.lit(BUCKETS)), ["_h", "doc_id", "size", "copy"], F.col("size"))
    ends = F.floor((F.col("_start") + F.col("size") - 1) / block_tokens)
    cut = streamed.withColumn("block", F.explode(F.sequence(F.floor(F.col("_start") / block_tokens), ends)))
    first = F.greatest(F.col("block") * block_tokens - F.col("_start"), F.lit(0))
    until = F.least((F.col("block") + 1) * block_tokens - F.col("_start"), F.col("size"))
    cut = cut.select("name", "block", "doc_id", "source", "size", "copy", first.alias("first"), (until - first).alias("n_tokens"),
                     (F.col("_start") + first - F.col("block") * block_tokens).alias("place"))
    pieces = taken.join(cut, ["name", "block"]).select(
        "shard", "slot", "place", "doc_id", "source", "size", "copy", "first", "n_tokens")
    return rows.drop("name"), targets, pieces


def mixed_counts(docs: DataFrame, **settings) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target, taken."""
    rows, targets, pieces = mix(docs, **settings)
    name = ["doc_id", "source", "size", "copy"]
    marks = lambda df: [F.col(c).isNull().alias(f"_{c}") for c in ("doc_id", "source")]
    plain = [F.coalesce("doc_id", F.lit(0)).alias("_i"), F.coalesce("source", F.lit("")).alias("_s")]
    taken = pieces.groupBy(*name).agg(F.sum("n_tokens").alias("taken")).select(
        *marks(pieces), *plain, "size", "copy", "taken")
    keyed = rows.select("doc_id", "source", *marks(rows), *plain, "size", "copy")
    whole = keyed.join(taken, ["_doc_id", "_source", "_i", "_s", "size", "copy"], "left")
    share = targets.select(F.col("source").isNull().alias("_source"), F.coalesce("source", F.lit("")).alias("_s"),
                           "source_size", "target")
    return whole.join(share, ["_source", "_s"], "left").select(
        "doc_id", "size", F.coalesce("source_size", F.lit(0)).cast("long").alias("source_size"),
        F.coalesce("target", F.lit(0.0)).alias("target"), F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """(shard, slot, text): every slot's tokens, joined by a blank.  Keys must be unique and not null."""
    _, _, pieces = mix(docs, key, text, **settings)
    tokens = F.filter(F.split(F.col(text), SPACE), lambda t: t != "")
    whole = docs.select(F.col(key).alias("doc_id"), tokens.alias("_t"))
    parts = pieces.join(whole, "doc_id").select(
        "shard", "slot", "place", F.array_join(F.slice("_t", F.col("first").cast("int") + 1, F.col("n_tokens").cast("int")), " ").alias("_p"))
    # A slot has at most block_tokens parts.
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "_p"))), lambda x: x["_p"]), " ")
    return parts.groupBy("shard", "slot").agg(joined.alias("text"))
