"""Leakage-controlled assignments: hold-out splits, nested calibration samples, target-disjoint sources."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamarack.operators import digests as digests_of

SUBJECT = ["dataset", "subject"]


def latest_session(t: DataFrame) -> DataFrame:
    """role: test for the strictly latest session, calibration_pool for the others; subjects with one session go."""
    w = Window.partitionBy(*SUBJECT)
    marked = t.withColumn("last_", F.max("session").over(w)).withColumn("first_", F.min("session").over(w)).filter("first_ < last_")
    return marked.withColumn("role", F.when(F.col("session") == F.col("last_"), "test").otherwise("calibration_pool")).drop("last_", "first_")


def run_suffix(t: DataFrame, fraction: float) -> DataFrame:
    """The smallest suffix of session::run groups with at least the fraction of a subject's trials, else the largest below it, as first test
    session and run. A suffix of all trials is none."""
    g = t.groupBy(*SUBJECT, "session", "run").agg(F.count("*").alias("n"))
    suffix = Window.partitionBy(*SUBJECT).orderBy("session", "run").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    s = g.withColumn("n_test", F.sum("n").over(suffix)).withColumn("n_all", F.sum("n").over(Window.partitionBy(*SUBJECT))).filter("n_test < n_all")
    short = F.col("n_test") / F.col("n_all") < fraction
    rank = F.struct(short.alias("short"), F.when(short, -F.col("n_test")).otherwise(F.col("n_test")).alias("size"))
    best = s.groupBy(*SUBJECT).agg(F.min_by(F.struct("session", "run", "n_test"), rank).alias("b"))
    return best.select(*SUBJECT, F.col("b.session").alias("session"), F.col("b.run").alias("run"), F.col("b.n_test").alias("n_test"))


def seeded(seed: int, *parts: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *parts))


#: Policies, and the strategies that each tries.
POLICIES = {"latest_session_only": ("latest_session",), "latest_session_then_latest_runs": ("latest_session", "latest_runs"), "latest_runs_only": ("latest_runs",)}


def target_split(t: DataFrame, fraction: float, least_test: int, least_pool: int, seed: int, trial_level: bool = False, policy: str = "latest_session_then_latest_runs") -> DataFrame:
    """role (test, calibration_pool) and strategy: each subject's first valid split of those that the policy tries and, where allowed, single
    trials. Valid is one with least_test trials of either class to test and least_pool to calibrate.

    Of run suffixes, the smallest with the fraction of trials wins, else the largest below it. Single trials are taken
    from each class in a seeded order; as all draws have the same number of each class, one draw is valid if any is. A subject with one session has
    no latest one. Subjects without a valid split stay, with null role and strategy.
    """
    tried = POLICIES[policy]
    w = Window.partitionBy(*SUBJECT)
    zero, one = F.col("label") == 0, F.col("label") == 1
    g = t.groupBy(*SUBJECT, "session", "run").agg(F.count_if(zero).alias("a"), F.count_if(one).alias("b"))
    late = w.orderBy("session", "run").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    g = g.select(*SUBJECT, F.struct("session", "run").alias("at"), *[F.sum(c).over(x).alias(c + n) for c in "ab" for x, n in ((late, "_test"), (w, "_all"))])
    g = g.withColumn("n", F.col("a_test") + F.col("b_test")).filter(
        (F.least("a_test", "b_test") >= least_test) & (F.least(F.col("a_all") - F.col("a_test"), F.col("b_all") - F.col("b_test")) >= least_pool)
    )
    short = F.col("n") / (F.col("a_all") + F.col("b_all")) < fraction
    best = g.groupBy(*SUBJECT).agg(F.min_by("at", F.struct(short.alias("short"), F.when(short, -F.col("n")).otherwise(F.col("n")).alias("size"))).alias("from_"))
    in_class = Window.partitionBy(*SUBJECT, "label")
    placed = t.withColumn("latest_", F.col("session") == F.max("session").over(w)).join(best, SUBJECT, "left")
    if trial_level:
        place = F.row_number().over(in_class.orderBy(seeded(seed, F.col("trial_uid")), "trial_uid"))
        placed = placed.withColumn("drawn_", place <= F.ceil(F.lit(fraction) * F.count("*").over(in_class)))
    else:
        placed = placed.withColumn("drawn_", F.lit(False))

    def valid(test: Column) -> Column:
        least = lambda x: F.least(F.count_if(x & zero).over(w), F.count_if(x & one).over(w))
        return (least(test) >= least_test) & (least(~test) >= least_pool)

    strategy = F.when(F.lit("latest_session" in tried) & valid(F.col("latest_")), "latest_session").when(F.lit("latest_runs" in tried) & F.col("from_").isNotNull(), "latest_runs").when(valid(F.col("drawn_")), "trial_level")
    test = F.when(F.col("strategy") == "latest_session", F.col("latest_")).when(F.col("strategy") == "latest_runs", F.struct("session", "run") >= F.col("from_")).when(F.col("strategy") == "trial_level", F.col("drawn_"))
    role = F.when(test, "test").when(~test, "calibration_pool")
    return placed.withColumn("strategy", strategy).withColumn("role", role).drop("latest_", "from_", "drawn_")


def nested(pool: DataFrame, budgets: list[int], seed: int) -> DataFrame:
    """Each class's seeded order; a budget b takes the first b of each class, so samples nest. selected_at_budget: the least that takes a trial.
    Subjects short of a budget skip it."""
    w = Window.partitionBy(*SUBJECT, "label").orderBy(seeded(seed, F.col("trial_uid")), "trial_uid")
    per = pool.groupBy(*SUBJECT).agg(F.count_if(F.col("label") == 0).alias("c0"), F.count_if(F.col("label") == 1).alias("c1"))
    placed = pool.withColumn("place", F.row_number().over(w)).join(per, SUBJECT)
    budget = F.array(*[F.lit(b) for b in budgets if b])
    taken = placed.withColumn("budget", F.explode(F.filter(budget, lambda b: (b >= F.col("place")) & (b <= F.least("c0", "c1")))))
    first = F.min("budget").over(Window.partitionBy(*SUBJECT, "trial_uid"))
    return taken.select(*SUBJECT, "label", "trial_uid", "budget", first.alias("selected_at_budget"))


#: Targets, and sources, that a task of sources() holds against one another.
TARGETS_AT_ONCE, SOURCES_AT_ONCE = 2048, 65536


def sources(t: DataFrame, most: int, seed: int) -> DataFrame:
    """For each target, at most `most` other subjects of its dataset, in a seeded order: the target's own seed orders its dataset's subjects.

    Each pair has a digest of its own, so all are computed: blocks of targets meet blocks of sources, each two in a task, which keeps of a target's block only what can be among its
    first; whole digests then order what is left of all blocks."""
    spark = t.sparkSession
    s = t.select(*SUBJECT).dropna().distinct()
    n = s.groupBy("dataset").agg(F.count("*").alias("n_"))
    dealt = lambda size: F.pmod(F.xxhash64("subject"), F.ceil(F.col("n_") / size)).cast("int")
    every = lambda size: F.sequence(F.lit(0), (F.ceil(F.col("n_") / size) - 1).cast("int"))
    sides = F.array(F.struct(F.lit(True).alias("target_"), F.array(dealt(TARGETS_AT_ONCE)).alias("a"), every(SOURCES_AT_ONCE).alias("b")), F.struct(F.lit(False).alias("target_"), every(TARGETS_AT_ONCE).alias("a"), F.array(dealt(SOURCES_AT_ONCE)).alias("b")))
    block = ["dataset", "a_", "b_"]
    rows = s.join(n, "dataset").select(*SUBJECT, F.inline(sides)).select(*SUBJECT, "target_", F.explode("a").alias("a_"), "b").select(*SUBJECT, "target_", "a_", F.explode("b").alias("b_"))
    rows = rows.repartition(max(64, int(spark.conf.get("spark.sql.shuffle.partitions"))), *block)  # a number, as blocks are few bytes and much work

    def first(d: pd.DataFrame) -> pd.DataFrame:
        others = d.loc[~d["target_"], "subject"].to_numpy()
        ends = digests_of.Endings([str(x).encode() for x in others])
        targets = d.loc[d["target_"], "subject"].to_numpy()
        found = [ends.first(f"{seed}:{x}:".encode(), most + 1) for x in targets]  # the target itself may be among them
        at = np.concatenate([*found, np.empty(0, int)]).astype(int)
        return pd.DataFrame({"dataset": d["dataset"].iloc[0], "target_subject": targets.repeat([len(f) for f in found]), "source_subject": others[at]})

    kind = t.schema["subject"].dataType.simpleString()
    near = rows.groupBy(*block).applyInPandas(first, f"dataset {t.schema['dataset'].dataType.simpleString()}, target_subject {kind}, source_subject {kind}").filter("target_subject <> source_subject")
    own = F.struct(seeded(seed, F.col("target_subject"), F.col("source_subject")).alias("h"), F.col("source_subject").alias("s"))
    placed = near.groupBy("dataset", "target_subject").agg(F.slice(F.array_sort(F.collect_list(own)), 1, most).alias("x"))  # little more than `most` of each block
    return placed.select("dataset", "target_subject", F.posexplode("x").alias("k", "x")).select("dataset", "target_subject", F.col("x.s").alias("source_subject"), (F.col("k") + 1).alias("place"))


def drawn_sources(t: DataFrame, most: int, seed: int) -> DataFrame:
    """For each target, `most` other subjects of its dataset drawn without replacement (all where there are no more), each target's draw for itself: dataset, target_subject,
    source_subject, place.

    A target takes as many hashes as it draws: the k-th draw is from the first numbers up to a bound that grows by one, and where it hits a number that is taken, the bound itself is taken
    instead; all sets are equally likely. Numbers are those of the dataset's subjects in order, without the target's, and become subjects by a join."""
    line = Window.partitionBy("dataset").orderBy("subject")
    s = t.select(*SUBJECT).distinct().withColumn("number", F.row_number().over(line) - 1).withColumn("others", F.count("*").over(Window.partitionBy("dataset")) - 1)
    draw = lambda i: (F.conv(F.substring(seeded(seed, F.col("subject"), i.cast("string")), 1, 8), 16, 10).cast("long") % F.greatest(i + 1, F.lit(1))).cast("int")

    def take(had: Column, i: Column) -> Column:
        return F.concat(had, F.array(F.when(F.array_contains(had, draw(i)), i).otherwise(draw(i))))

    bounds = F.sequence(F.greatest(F.col("others") - most, F.lit(0)).cast("int"), (F.col("others") - 1).cast("int"))
    drawn = s.filter("others > 0").withColumn("taken", F.aggregate(bounds, F.array().cast("array<int>"), take))
    rows = drawn.select("dataset", F.col("subject").alias("target_subject"), "number", F.posexplode("taken").alias("k", "n"))
    rows = rows.select("dataset", "target_subject", (F.col("n") + (F.col("n") >= F.col("number")).cast("int")).alias("number"), (F.col("k") + 1).alias("place"))
    return rows.join(s.select("dataset", "number", F.col("subject").alias("source_subject")), ["dataset", "number"]).select("dataset", "target_subject", "source_subject", "place")


def capped(t: DataFrame, cap: int, seed: int) -> DataFrame:
    """At most `cap` trials of either class of each subject, whatever the other class has."""
    w = Window.partitionBy(*SUBJECT, "label").orderBy(seeded(seed, F.col("trial_uid")), "trial_uid")
    return t.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= cap).drop("place")


def balanced(t: DataFrame, cap: int, seed: int) -> DataFrame:
    """The same number of trials of either class of each subject: the smaller class's, capped."""
    per = t.groupBy(*SUBJECT).agg(F.least(F.count_if(F.col("label") == 0), F.count_if(F.col("label") == 1), F.lit(cap)).alias("n"))
    w = Window.partitionBy(*SUBJECT, "label").orderBy(seeded(seed, F.col("trial_uid")), "trial_uid")
    return t.withColumn("place", F.row_number().over(w)).join(per, SUBJECT).filter("place <= n").drop("place", "n")


def digests(t: DataFrame) -> DataFrame:
    """A subject's trials, by class, and the SHA-256 of their sorted ids."""
    ids = F.to_json(F.array_sort(F.collect_list("trial_uid")))
    return t.groupBy(*SUBJECT).agg(F.count("*").alias("n"), F.count_if(F.col("label") == 0).alias("class_0"), F.count_if(F.col("label") == 1).alias("class_1"), F.sha2(ids, 256).alias("digest"))


def grid(splits: DataFrame, methods: list[str], budgets: list[int]) -> DataFrame:
    """Every condition to expect: zero budget for population and pooled, positive ones for subject and pooled."""
    cells = [("population", 0), ("source_plus_target", 0)] + [(r, b) for b in budgets if b for r in ("subject", "source_plus_target")]
    cell = F.array(*[F.struct(F.lit(m).alias("method"), F.lit(r).alias("regime"), F.lit(b).alias("budget")) for m in methods for r, b in cells])
    return splits.select("*", F.inline(cell))


#: Stored names of strategies.
STRATEGIES = {"latest_session": "latest_session_holdout", "latest_runs": "latest_run_suffix_holdout", "trial_level": "trial_level_fallback"}


def tables(t: DataFrame, seed: int, split: dict, calibration: dict, source: dict) -> dict[str, DataFrame]:
    """The four assignment tables of a run (sources.results), from settings of the configuration's sections. t: dataset, subject, session, run, trial_uid, label.

    A target without a valid split, a budget that a target's pool can't fill (where that is an error), and a source without both classes raise as
    the tables are computed."""
    t = t.select(*SUBJECT, "session", "run", "trial_uid", "label")
    group = F.concat_ws("::", "session", "run")
    splits, samples = [], []
    budgets = [b for b in calibration["budgets_per_class"] if b]
    for r in range(split["repeats"]):
        own = target_split(t, split["test_fraction"], split["minimum_test_per_class"], split["minimum_calibration_per_class"], seed + r, split["allow_trial_level_fallback"], split["policy"])
        none = F.raise_error(F.concat(F.lit("no valid split of "), F.concat_ws("::", *SUBJECT))).cast("string")
        named = F.coalesce(*[F.when(F.col("strategy") == k, v) for k, v in STRATEGIES.items()], none)
        splits.append(own.select(*SUBJECT, F.lit(r).alias("repeat"), named.alias("split_strategy"), "trial_uid", "session", "run", group.alias("group_id"), "label", "role"))
        samples.append(nested(own.filter("role = 'calibration_pool'"), budgets, seed + r).withColumn("repeat", F.lit(r)))
    every = splits[0]
    for more in splits[1:]:
        every = every.unionByName(more)
    ids = lambda role: F.array_sort(F.collect_list(F.when(F.col("role") == role, F.col("trial_uid"))))
    named = every.groupBy(*SUBJECT, "repeat").agg(F.first("split_strategy").alias("s"), ids("calibration_pool").alias("pool"), ids("test").alias("test"))
    payload = F.to_json(F.struct(F.col("pool").alias("calibration_trial_uids"), F.col("s").alias("strategy"), F.col("test").alias("test_trial_uids")))
    split_id = named.select(*SUBJECT, "repeat", F.substring(F.sha2(payload, 256), 1, 20).alias("split_id"))
    every = every.join(split_id, [*SUBJECT, "repeat"])
    chosen = samples[0]
    for more in samples[1:]:
        chosen = chosen.unionByName(more)
    at = every.filter("role = 'calibration_pool'").select(*SUBJECT, "repeat", "split_id", "trial_uid", "session", "run", "group_id")
    if calibration["insufficient_budget"] == "error":
        found = chosen.groupBy(*SUBJECT, "repeat").agg(F.max("budget").alias("top"))
        short = F.raise_error(F.concat(F.lit("too few calibration trials of "), F.concat_ws("::", *SUBJECT))).cast("string")
        at = at.join(found, [*SUBJECT, "repeat"], "left").withColumn("split_id", F.when(F.coalesce("top", F.lit(0)) < max(budgets, default=0), short).otherwise(F.col("split_id"))).drop("top")
    chosen = at.join(chosen, [*SUBJECT, "repeat", "trial_uid"], "left").filter("budget is not null")
    target = lambda df: df.withColumnRenamed("subject", "target_subject")
    cap = source["max_trials_per_class_per_subject"] or 2**31 - 1
    taken = balanced(t, cap, seed) if source["balance_classes_within_subject"] else capped(t, cap, seed)
    pairs = drawn_sources(t, source["max_subjects"] or 2**31 - 1, seed).drop("place")
    from tamarack import functions as fn

    pairs = pairs.withColumn("selection_seed", fn.derive_seed(seed, F.col("dataset"), F.col("target_subject"), F.col("source_subject"), F.lit("source_trials")))
    both = digests(taken)
    empty = F.raise_error(F.concat(F.lit("a source lacks a class: "), F.col("source_subject"))).cast("long")
    selection = pairs.join(both.withColumnRenamed("subject", "source_subject"), ["dataset", "source_subject"], "left")
    selection = selection.select("dataset", "target_subject", "source_subject", "selection_seed", F.when(F.coalesce(F.least("class_0", "class_1"), F.lit(0)) == 0, empty).otherwise(F.col("n")).alias("selected_trials"), F.col("class_0").alias("class_0_trials"), F.col("class_1").alias("class_1_trials"), F.col("digest").alias("selected_trial_uid_sha256"))
    detail = pairs.join(taken.withColumnRenamed("subject", "source_subject"), ["dataset", "source_subject"])
    return {"split_assignments": target(every), "calibration_assignments": target(chosen.withColumnRenamed("budget", "budget_per_class")), "source_selection": selection, "source_trial_assignments": detail}
