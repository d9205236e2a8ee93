"""Views over the driver's tables in the shape of benchmark tables: trials, predictions, metrics, epochs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Key columns of a condition.
CONDITION = ["dataset", "target_subject", "method", "regime", "budget"]
METRICS = ["roc_auc", "balanced_accuracy", "accuracy", "macro_f1", "brier", "log_loss"]
TRIAL = T.StructType([T.StructField(n, t) for n, t in [("dataset", T.StringType()), ("subject", T.StringType()), ("session", T.IntegerType()), ("run", T.IntegerType()), ("trial_uid", T.StringType()), ("label", T.IntegerType()), ("value", T.DoubleType())]])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A CSV (or gzipped CSV) of a fixed schema with a header; values that don't parse raise. Doubles round-trip exactly."""
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)


def write_csv(df: DataFrame, path: str, columns: list[str], gzip: bool = True) -> None:
    """Appends exactly these columns, with a header."""
    df.select(*columns).write.mode("append").option("header", True).option("compression", "gzip" if gzip else "none").csv(path)


def append_once(new: DataFrame, old: DataFrame, keys: list[str], expected: str = "n_expected") -> DataFrame:
    """Rows of new whose key is not in old. A key of which old has some rows, but fewer than expected, raises."""
    seen = old.groupBy(*keys).agg(F.count("*").alias("seen_"))
    both = new.join(seen, keys, "left")
    bad = F.col("seen_").isNotNull() & (F.col("seen_") != F.col(expected))
    checked = both.withColumn("seen_", F.when(bad, F.raise_error(F.lit("partial append"))).otherwise(F.col("seen_")))
    return checked.filter("seen_ is null").drop("seen_")


def kept(df: DataFrame) -> DataFrame:
    """df computed once, for several steps that read it: in spark.checkpoint.dir, which outlives executors, or where that is unset with the executors. For tables that are small
    beside what they are made of."""
    return df.checkpoint() if df.sparkSession.conf.get("spark.checkpoint.dir", None) else df.localCheckpoint()


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").filter("event_type <> 'error'")
    return e.select(
        F.concat(F.lit("D"), (F.col("user_id") % 3).cast("string")).alias("dataset"), F.col("user_id").cast("string").alias("subject"),
        F.floor((F.dayofmonth("ts") - 1) / 10).cast("int").alias("session"), F.floor(F.hour("ts") / 6).cast("int").alias("run"),
        F.concat(F.lit("E:"), F.col("event_id").cast("string")).alias("trial_uid"), F.col("event_type").isin("purchase", "signup").cast("int").alias("label"), "value",
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    j = li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    p = F.substring("o_orderpriority", 1, 1)
    budget = F.when(p == "1", 0).when(p == "2", 5).when(p == "3", 10).when(p == "4", 20).otherwise(40)
    uid = F.sha2(F.concat_ws("|", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.round(F.col("l_quantity") * 100).cast("long"), F.round(F.col("l_extendedprice") * 100).cast("long"), F.unix_timestamp("l_shipdate")), 256)
    scores = F.array(
        F.struct(F.lit("csp_lda").alias("method"), (F.col("l_discount") * 10).alias("y_score")), F.struct(F.lit("riemann_lr").alias("method"), (F.col("l_quantity") / 50).alias("y_score")),
        F.struct(F.lit("logvar_lda").alias("method"), ((F.col("l_discount") * 10 + F.col("l_quantity") / 50) / 2).alias("y_score")),
    )
    out = j.select(
        F.col("l_linestatus").alias("dataset"), (F.col("l_suppkey") % 20).cast("string").alias("target_subject"), (F.col("l_linenumber") % 3).cast("int").alias("repeat"),
        F.when(p == "1", "population").when(F.col("l_partkey") % 2 == 0, "subject").otherwise("source_plus_target").alias("regime"), budget.alias("budget"),
        uid.alias("trial_uid"), (F.col("l_returnflag") == "R").cast("int").alias("y_true"), F.inline(scores),
    )
    return out.withColumn("y_score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), "y_score"))).withColumn("y_pred", (F.col("y_score") >= 0.5).cast("int"))


def epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, subject, label, x: four channels of sixteen samples."""
    x = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda c: F.transform(F.slice("embedding", c * 16 + 1, 16), lambda v: v.cast("double")))
    return table(spark, sf_dir, "embeddings").select("vec_id", (F.col("vec_id") % 10).alias("subject"), (F.col("label") % 2).alias("label"), x.alias("x"))
