"""Operator 9: mixes sources to target weights by capped water-filling, then samples whole and fractional repetitions.

Water level: every source gets level * weight words, or max_epochs times its size where that is less. Each round reshares what the
clamped sources can't take among the others in proportion to weight, until no source is above its cap.
Sampling: a source's target is a number of whole passes over it and a rest. The rest takes documents in a seeded
order until it is used up. The order is dealt into buckets by the seeded hash, so that running sums need no source in
one task: sizes are summed by source and bucket, and only inside a bucket are documents lined up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamarack.llm.common import n_words, passing, row_mark, written

BUCKETS, SEED = 4096, 20_240_601


def ranked(sources: DataFrame) -> DataFrame:
    """sources with place: 0, 1, ... by code point, null last. Ranges are sorted apart and then shifted by the rows before
    them, so that no task sorts all sources."""
    parts = written(
        sources.repartitionByRange(F.col("source").asc_nulls_last()).sortWithinPartitions(F.col("source").asc_nulls_last())
        .withColumn("at", F.monotonically_increasing_id()), "mix-sources",
    )
    part, inside = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    starts = parts.groupBy(part.alias("part")).agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return parts.withColumn("part", part).join(starts, "part").withColumn("place", F.col("start") + inside).drop("at", "part", "start")


def water_level(sources: DataFrame, max_epochs: float) -> float:
    """The level at which least(max_epochs * source_size, level * weight) sums to all sizes. One row comes back a round."""
    cap, level = F.col("source_size") * F.lit(float(max_epochs)), 0.0
    while True:
        full = cap <= F.col("weight") * F.lit(level)
        total, taken, left = sources.agg(F.sum("source_size"), F.sum(F.when(full, cap).otherwise(0.0)), F.sum(F.when(~full, F.col("weight")).otherwise(0.0))).first()
        if not total or not left:
            return level
        new = max(level, (total - taken) / left)
        if new <= level * (1 + 1e-12):
            return level
        level = new


def targets(sized: DataFrame, weights: tuple = (5.0, 2.0, 1.0), max_epochs: float = 3) -> DataFrame:
    """source, source_size, weight, target. sized: source, size. Weights are given in turn to the sources by code point,
    null last; targets share the sum of all sizes. A source of size 0 gets 0."""
    sources = ranked(sized.groupBy("source").agg(F.sum("size").alias("source_size")))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    sources = written(sources.withColumn("weight", weight), "mix-weights")
    level = water_level(sources, max_epochs)
    return sources.withColumn("target", F.least(F.col("source_size") * F.lit(float(max_epochs)), F.col("weight") * F.lit(level)))


def mixed(docs: DataFrame, weights: tuple = (5.0, 2.0, 1.0), max_epochs: float = 3, seed: int = SEED, partial: bool = True) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, part, taken, pos (which row of equal ids it is) for each row of docs.

    copies: whole repetitions; part: words of one more, partial copy. With partial, only the last document that a source's
    rest reaches is partial, and a source's taken words are its target, rounded. Without, that document is taken whole if half
    of it or more fits. Nulls: a null text has size 0; the null source is a source; rows of equal or null id are lined up
    by source and size. An empty table gives an empty table. The same rows and seed give the same mix.
    """
    key = F.xxhash64(F.lit(seed), F.col("doc_id"))
    with passing() as own:
        sized = written(docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), n_words(F.col("text")).alias("size")), "mix-sizes")
        passes = F.when(F.col("source_size") > 0, F.floor(F.round("target") / F.col("source_size"))).otherwise(0)
        sources = targets(sized, weights, max_epochs).withColumn("passes", passes)
        sources = written(sources.withColumn("rest", (F.round("target") - F.col("passes") * F.col("source_size")).cast("long")), "mix-targets")
        own.keep(sized, sources)
    # null ids share a key: there, a bucket is of one size
    of_null = F.xxhash64(F.lit(seed), F.lit(None).cast("long"))
    inner = F.when(F.col("doc_id").isNull(), F.col("size") + 1).when(F.col("key") < of_null, 0).otherwise((1 << 63) - 1)
    dealt = sized.withColumn("key", key).withColumn("bucket", F.struct(F.shiftrightunsigned("key", 52).alias("high"), inner.alias("inner")))
    sums = dealt.groupBy("source", "bucket").agg(F.sum("size").alias("in_bucket"))
    up_to = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("start", F.coalesce(F.sum("in_bucket").over(up_to), F.lit(0))).withColumnsRenamed({"source": "s", "bucket": "b"}).drop("in_bucket")
    line = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = dealt.join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")), "left").drop("s", "b")
    rows = rows.withColumn("before", F.col("start") + F.coalesce(F.sum("size").over(line), F.lit(0))).drop("start", "bucket", "key")
    rows = rows.join(sources.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left")
    fits = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("before"))).cast("long")
    part = fits if partial else F.when(fits * 2 >= F.col("size"), F.col("size")).otherwise(0).cast("long")
    whole = (F.col("size") > 0) & (part == F.col("size"))
    return rows.select(
        "doc_id", "source", "size", "source_size", "target",
        (F.col("passes") + whole.cast("long")).alias("copies"), F.when(whole, 0).otherwise(part).cast("long").alias("part"),
        (F.col("passes") * F.col("size") + part).alias("taken"),
    )


def applied(docs: DataFrame, **options) -> DataFrame:
    """docs with each row repeated as the mix takes it; whole copies only. Rows with equal doc_id, source and size are one
    kind: their repetitions are dealt out evenly among them, so that the sum stays right. Null ids, sources and texts as in mixed; an empty
    table gives an empty one. Copies are decided on keys; each text is shuffled once, to meet them."""
    def keys(doc_id: Column, source: Column, size: Column) -> list[Column]:  # without nulls, so that the join's partitions serve the window
        i, s = doc_id.cast("long"), source.cast("string")
        return [F.coalesce(i, F.lit(0)).alias("k0_"), i.isNull().alias("k1_"), F.coalesce(s, F.lit("")).alias("k2_"), s.isNull().alias("k3_"), size.alias("k4_")]

    names = [f"k{n}_" for n in range(5)]
    taken = mixed(docs, partial=False, **options)
    kinds = taken.select(*keys(*(F.col(c) for c in ("doc_id", "source", "size"))), "copies").groupBy(*names).agg(F.sum("copies").alias("sum_"), F.count("*").alias("n_")).filter("sum_ > 0")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("all_"), *keys(F.col("doc_id"), F.col("source"), n_words(F.col("text"))))
    line = Window.partitionBy(*names).orderBy(F.when(F.col("n_") > 1, row_mark(docs, "all_")))
    joined = rows.join(kinds, names).withColumn("nth_", F.row_number().over(line) - 1)
    times = F.floor(F.col("sum_") / F.col("n_")) + (F.col("nth_") < F.col("sum_") % F.col("n_")).cast("long")
    return joined.withColumn("times_", times).filter("times_ > 0").select("all_", F.explode(F.sequence(F.lit(1), F.col("times_").cast("int")))).select("all_.*")
