"""Bags of rows held against one another by sums of hashes: the same rows as two differences of bags, and next to no shuffle where tables agree."""

import random

from pyspark.sql import functions as F

from tamarack import plans

COLUMNS = "a long, b string, c double"


def by_differences(a, b):
    text = lambda d: d.select(*[F.col(c).cast("string").alias(c) for c in sorted(d.columns)])
    return sorted((tuple(r) for r in text(a).exceptAll(text(b)).unionByName(text(b).exceptAll(text(a))).collect()), key=repr)


def bag(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def shuffled_bytes(spark):
    sc, empty = spark.sparkContext._jsc.sc(), spark._jvm.java.util.ArrayList
    sc.listenerBus().waitUntilEmpty(10_000)
    stages = sc.statusStore().stageList(empty(), False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), empty())
    return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))


def test_the_same_rows(spark):
    r = random.Random(2)
    row = lambda: (r.choice([1, 2, None]), r.choice(["x", "", None, "1"]), r.choice([0.5, None, float("nan")]))
    for n in (0, 1, 60):
        rows = [row() for _ in range(n)]
        for other in (rows, rows[1:], rows[:-1] + [row()], [row() for _ in range(n)], rows + rows[:3]):
            a, b = (spark.createDataFrame(x, COLUMNS) for x in (rows, r.sample(other, len(other))))
            assert bag(plans.unequal(a, b)) == by_differences(a, b)
    a = spark.createDataFrame([(None, "null", 1.0)], COLUMNS)
    b = spark.createDataFrame([(None, None, 1.0)], COLUMNS)
    assert len(bag(plans.unequal(a, b))) == 2 and plans.unequal(a, a.select("c", "a", "b")).count() == 0


def test_equal_tables_hardly_shuffle(spark):
    rows = spark.range(200_000).select(F.col("id").alias("a"), F.sha2(F.col("id").cast("string"), 256).alias("b"), (F.col("id") / 3).alias("c"))
    start = shuffled_bytes(spark)
    assert plans.unequal(rows, rows.orderBy("b").coalesce(1)).count() == 0
    equal = shuffled_bytes(spark) - start
    ordered = shuffled_bytes(spark)
    rows.orderBy("b").coalesce(1).write.format("noop").mode("overwrite").save()
    equal -= 2 * (shuffled_bytes(spark) - ordered)  # the sort itself, which both steps read
    start = shuffled_bytes(spark)
    changed = rows.withColumn("c", F.when(F.col("a") == 77, 0.0).otherwise(F.col("c")))
    assert plans.unequal(rows, changed).count() == 2
    one = shuffled_bytes(spark) - start
    start = shuffled_bytes(spark)
    assert len(by_differences(rows, changed)) == 2
    assert max(equal, one) < 0.03 * (shuffled_bytes(spark) - start)
