"""Means of symmetric positive definite matrices by group, where no task holds a group.

Matrices are dealt into parts of their groups and kept there. Each round brings every part its group's mean so far, and takes back the sum of the part's log maps at that mean; sums
add up before they are shuffled. A group stops when the norm of its mean log map is small enough; the driver sees one number a round.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarack.operators import kernels


def square(rows) -> np.ndarray:
    v = np.array([np.asarray(r, float) for r in rows])
    p = round(v.shape[1] ** 0.5)
    return v.reshape(len(v), p, p)


def added(parts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n, s: sums of n and, entry by entry, of the flat matrices s. Spark adds up within tasks first; what meets by group is a row for each entry."""
    entries = parts.select(*keys, "n", F.posexplode("s").alias("at", "v")).groupBy(*keys, "at").agg(F.sum("n").alias("n"), F.sum("v").alias("v"))
    return entries.groupBy(*keys).agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("at", "v"))), lambda x: x["v"]).alias("s"))


def riemannian_means(matrices: DataFrame, keys: list[str], column: str = "m", most: int = 50, tolerance: float = 1e-9, parts: int | None = None) -> DataFrame:
    """keys, n, mean (flat), residual: the norm of the mean log map at the mean. matrices: keys, which are not null, and symmetric positive definite matrices as arrays of rows, of
    one size in a group. parts: into how many each group is dealt, as many as Spark shuffles into by default. The same steps as kernels.riemannian_mean."""
    spark = matrices.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    types = {f.name: f.dataType.simpleString() for f in matrices.schema}
    head = ", ".join(f"{k} {types[k]}" for k in keys)
    flat = matrices.select(*keys, F.flatten(column).alias("m"))
    own = flat.withColumn("part", F.pmod(F.xxhash64("m"), F.lit(parts)).cast("int")).repartition(*keys, "part").persist()
    start = added(own.select(*keys, F.lit(1).cast("long").alias("n"), F.col("m").alias("s")), keys)
    floor = lambda i, p: F.when(i % (p + 1) == 0, kernels.FLOOR).otherwise(0.0)
    p = F.round(F.sqrt(F.size("s"))).cast("int")
    state = start.select(*keys, "n", F.transform("s", lambda v, i: v / F.col("n") + floor(i, p)).alias("mean"), F.lit(float("inf")).alias("norm"))

    def mapped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for _, some in b.groupby(keys, sort=False):
                at = square(some["mean"].iloc[:1])[0]
                s = kernels.log_map(square(some["m"]), at).sum(axis=0)
                yield pd.DataFrame({**{k: some[k].iloc[:1] for k in keys}, "n": [len(some)], "s": [s.ravel()]})

    def moved(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            means, norms = [], []
            for at, s, n in zip(b["mean"], b["s"], b["n"], strict=True):
                step = square([s])[0] / n
                root = kernels.power(square([at])[0], 0.5)
                means.append((root @ kernels.on_eigenvalues(step, np.exp, None) @ root).ravel())
                norms.append(float(np.linalg.norm(step)))
            yield pd.DataFrame({**{k: b[k] for k in keys}, "n": b["n"], "mean": means, "norm": norms})

    def stepped(state: DataFrame) -> DataFrame:
        spread = state.select(*keys, "mean", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
        sums = added(own.join(spread, [*keys, "part"]).select(*keys, "m", "mean").mapInPandas(mapped, f"{head}, n long, s array<double>"), keys)
        return state.select(*keys, "mean").join(sums, keys).mapInPandas(moved, f"{head}, n long, mean array<double>, norm double")

    def cut(df: DataFrame) -> DataFrame:
        return df.checkpoint() if spark.conf.get("spark.checkpoint.dir", None) else df.persist()

    state, done = cut(state), None
    for _ in range(most):
        new = cut(stepped(state))
        whole = new.filter(F.col("norm") < tolerance)
        done = whole if done is None else done.unionByName(whole)
        state = new.filter(~(F.col("norm") < tolerance))
        if not (state.agg(F.max("norm")).first()[0] or 0) >= tolerance:
            break
    at = done.unionByName(state).drop("norm")
    return stepped(at).select(*keys, "n", "norm").withColumnRenamed("norm", "residual").join(at.select(*keys, "mean"), keys)
