"""Operator 13: near-duplicate embeddings by cross-polytope hashing after fast Hadamard rotations, with multiprobe buckets and verified pairs.

Vectors of one label and length are compared; equal ones are one kind, with a count. A hash is the axis, with its sign, that a vector lies nearest to after three rounds
of random signs and a fast Hadamard transform; HASHES of them are a table's code. In each of TABLES tables a kind is at home in the bucket of its code and
visits those of the next likeliest codes. Two kinds are candidates where one of them is at home; their cosine in double precision decides.
Balls: kinds of a home bucket of the first table within half the angle of its least one all link with each other, whatever their number. They are counted, not compared.
Buckets where nothing but one ball meets are left out. A bucket above MOST is dealt into blocks, and the pairs of blocks that have something to compare go
to tasks of their own, so that nothing is left out and a task holds two blocks.
Count once: a pair that meets in several buckets counts in the first. Tables are taken one after another, so that the disk holds one table's vectors.
Chance that a pair of cosine exactly 0.98 in 64 dimensions meets nowhere: 0.17 a table, one in 7,000 in all; less for closer ones.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarack.llm.common import passing, written
from tamarack.llm.components import components
from tamarack.llm.simhash import spanning

LEAST, TABLES, HASHES, PROBES, SEED = 0.98, 5, 3, 4, 20_240_613
#: Kinds of a bucket that are compared at once; rows of one matrix product; pairs whose earlier meetings are looked up at once.
MOST, STRIPE, PAIRS = 2048, 256, 1 << 16
BUCKET = ["lab", "code"]


def transform(x: np.ndarray) -> np.ndarray:
    """The fast Hadamard transform of each row; lengths are powers of two."""
    h = 1
    while h < x.shape[1]:
        y = x.reshape(len(x), -1, 2, h)
        x = np.concatenate([y[:, :, :1] + y[:, :, 1:], y[:, :, :1] - y[:, :, 1:]], 2).reshape(len(x), -1)
        h *= 2
    return x / math.sqrt(x.shape[1])


def unit(rows: list) -> np.ndarray:
    """Rows of one length as unit vectors in double precision."""
    x = np.array([np.asarray(r, float) for r in rows])
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def codes(x: np.ndarray, table: int) -> np.ndarray:
    """For each unit vector the codes of the buckets in a table: its home, then those it visits, likeliest first."""
    d = max(2, 1 << (x.shape[1] - 1).bit_length())
    padded = np.zeros((len(x), d))
    padded[:, : x.shape[1]] = x
    tops, gaps = [], []
    deep = min(PROBES, 2 * d)
    for k in range(HASHES):
        signs = np.random.default_rng([SEED, table, k, d]).choice([-1.0, 1.0], (3, d))
        v = padded
        for s in signs:
            v = transform(v * s)
        v = np.concatenate([v, -v], 1)
        top = np.argpartition(-v, deep - 1, 1)[:, :deep]
        value = np.take_along_axis(v, top, 1)
        order = np.lexsort((top, -value), 1)
        top, value = np.take_along_axis(top, order, 1), np.take_along_axis(value, order, 1)
        tops.append(top)
        gaps.append((value[:, :1] - value) ** 2)
    ways = np.array([w for w in product(range(deep), repeat=HASHES) if np.prod(np.array(w) + 1) <= PROBES])
    cost = sum(gaps[k][:, ways[:, k]] for k in range(HASHES))
    best = ways[np.argsort(cost, 1, kind="stable")[:, :PROBES]]
    return sum(np.take_along_axis(tops[k], best[:, :, k], 1).astype(np.int64) * (2 * d) ** k for k in range(HASHES))


def met_before(own: np.ndarray, a: np.ndarray, b: np.ndarray, table: int, code: int) -> np.ndarray:
    """Which pairs a, b, found in a bucket, met in an earlier table, or meet in a lower bucket of this one too. own: codes of kind, table, probe."""
    out = np.zeros(len(a), bool)
    for t in range(table + 1):
        x, y = own[a, t], own[b, t]
        at_y, at_x = (x == y[:, :1]).any(1), (y == x[:, :1]).any(1)
        out |= (at_y | at_x) if t < table else (at_y & (y[:, 0] < code)) | (at_x & (x[:, 0] < code))
    return out


def labelled(vectors: DataFrame, label: str, vector: str) -> Column:
    """Label and length of a row whose vector can link: neither is null, all components are finite, one is not zero. Null otherwise."""
    v = F.col(vector)
    sound = F.col(label).isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    return F.when(sound, F.concat_ws("/", F.size(v).cast("string"), F.col(label).cast("string")))


def marks(kinds: DataFrame) -> DataFrame:
    """kind, lab, t, code, home: a row for each bucket that a kind is in."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for _, some in b.groupby(b["lab"].str.split("/").str[0]):
                x = unit(some["v"].tolist())
                for t in range(TABLES):
                    c = codes(x, t)
                    m = c.shape[1]
                    yield pd.DataFrame({
                        "kind": np.repeat(some["kind"].to_numpy(), m), "lab": np.repeat(some["lab"].to_numpy(), m), "t": np.int32(t),
                        "code": c.ravel(), "home": np.tile(np.arange(m) == 0, len(some)),
                    })

    return kinds.select("kind", "lab", "v").mapInPandas(run, "kind long, lab string, t int, code long, home boolean")


def balls(found: DataFrame, kinds: DataFrame, least: float) -> DataFrame:
    """kind, ball: kinds within half the angle of the least kind of their home in the first table, named by that; both ends included, balls of one left out."""
    home = found.filter("t = 0 and home").select("kind", *BUCKET)
    hubs = home.groupBy(*BUCKET).agg(F.min("kind").alias("ball"), F.count("*").alias("all")).filter("`all` > 1").drop("all")
    hubs = written(hubs.join(kinds.select(F.col("kind").alias("ball"), F.col("v").alias("hub")), "ball"), "hubs")
    pairs = home.join(hubs.select(*BUCKET, "ball"), BUCKET).join(kinds.select("kind", "v"), "kind").join(hubs.select("ball", "hub"), "ball")
    half = math.sqrt((1 + least) / 2) + 1e-12

    @F.pandas_udf("boolean")
    def inside(v: pd.Series, hub: pd.Series) -> pd.Series:
        out = np.zeros(len(v), bool)
        size = v.map(len).to_numpy()
        for d in np.unique(size):
            at = np.flatnonzero(size == d)
            out[at] = (unit(v.iloc[at].tolist()) * unit(hub.iloc[at].tolist())).sum(1) >= half
        return pd.Series(out)

    near = pairs.select("kind", "ball", ((F.col("kind") == F.col("ball")) | inside("v", "hub")).alias("ok")).filter("ok").select("kind", "ball")
    near = written(near, "near")
    more = near.filter("kind <> ball").select("ball").distinct()
    return near.join(more, "ball", "left_semi").select("kind", "ball")


def dealt(own: DataFrame, most: int) -> DataFrame:
    """The rows of a table's buckets (lab, code, kind, home, g) with block and side: whole buckets as (0, 0); those above `most` in pairs of blocks, (pair, 1)
    against (pair, 2), or (pair, 0) for one within itself. Members of a ball that fills a block have blocks of their own, which are not compared with each other."""
    sizes = own.groupBy(*BUCKET).agg(F.count("*").alias("all"), F.min("g").alias("least"), F.max("g").alias("greatest"), F.max("home").alias("any"))
    sizes = written(sizes.filter("any and least <> greatest").select(*BUCKET, "all"), "sizes")
    small = own.join(sizes.filter(F.col("all") <= most).select(*BUCKET), BUCKET, "left_semi").withColumns({"block": F.lit(0).cast("long"), "side": F.lit(0)})
    large = own.join(sizes.filter(F.col("all") > most).select(*BUCKET), BUCKET, "left_semi")
    half = most // 2
    by = large.groupBy(*BUCKET, "g").agg(F.count("*").alias("n")).withColumn("big", F.col("n") > half)
    big = by.filter("big").select(*BUCKET, F.col("g").alias("own"), F.ceil(F.col("n") / half).alias("blocks"))
    rest = by.filter("not big").groupBy(*BUCKET).agg(F.lit(None).cast("long").alias("own"), F.ceil(F.sum("n") / half).alias("blocks"))
    parts = big.unionByName(rest).withColumn("nth", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    parts = written(parts.withColumn("name", F.xxhash64(F.coalesce("own", F.lit(-1).cast("long")), F.col("own").isNull(), "nth")), "blocks")
    named = large.join(big.withColumnRenamed("own", "g"), [*BUCKET, "g"], "left").join(rest.select(*BUCKET, F.col("blocks").alias("others")), BUCKET, "left")
    nth = F.pmod(F.xxhash64(F.lit(3), "kind"), F.coalesce("blocks", "others"))
    named = named.withColumn("own", F.when(F.col("blocks").isNotNull(), F.col("g"))).withColumn("name", F.xxhash64(F.coalesce("own", F.lit(-1).cast("long")), F.col("own").isNull(), nth))
    one, two = parts.select(*BUCKET, F.col("own").alias("o1"), F.col("name").alias("n1")), parts.select(*BUCKET, F.col("own").alias("o2"), F.col("name").alias("n2"))
    pairs = one.join(two, BUCKET).filter("n1 <= n2 and (o1 is null or o2 is null or o1 <> o2)").withColumn("block", F.xxhash64("n1", "n2"))
    sides = F.when(F.col("n1") == F.col("n2"), F.array(F.struct(F.col("n1").alias("name"), F.lit(0).alias("side")))).otherwise(F.array(F.struct(F.col("n1").alias("name"), F.lit(1).alias("side")), F.struct(F.col("n2").alias("name"), F.lit(2).alias("side"))))
    asked = pairs.select(*BUCKET, "block", F.inline(sides))
    return small.unionByName(named.select(*own.columns, "name").join(asked, [*BUCKET, "name"]).select(*small.columns))


def compared(rows: DataFrame, table: int, least: float) -> DataFrame:
    """a, b, n from the rows of a table's buckets with g, n, v: a kind and how many vectors it links with that were not counted before (b null), and links that join
    what a task found (n null)."""

    def bucket(code: int, kind: np.ndarray, home: np.ndarray, side: np.ndarray, g: np.ndarray, n: np.ndarray, v: list) -> pd.DataFrame:
        x = unit(v)
        left, right = (np.flatnonzero(side <= 1), np.flatnonzero(side != 1))
        own, count, root = None, np.zeros(len(kind), np.int64), np.arange(len(kind))
        for at in range(0, len(left), STRIPE):
            some = left[at : at + STRIPE]
            a, b = np.nonzero(x[some] @ x[right].T >= least)
            a, b = some[a], right[b]
            ok = (a != b) & (home[a] | home[b]) & (g[a] != g[b]) & ((side[a] != 0) | (a < b))
            a, b = a[ok], b[ok]
            if len(a) and own is None:
                own = np.stack([codes(x, t) for t in range(table + 1)], 1)
            for k in range(0, len(a), PAIRS):
                p, q = a[k : k + PAIRS], b[k : k + PAIRS]
                new = ~met_before(own, p, q, table, code)
                np.add.at(count, p[new], n[q[new]])
                np.add.at(count, q[new], n[p[new]])
                root = spanning(len(kind), p, q, root)
        some, hit = np.flatnonzero(count), np.flatnonzero(root != np.arange(len(kind)))
        return pd.DataFrame({"a": np.concatenate([kind[some], kind[root[hit]]]), "b": pd.array([None] * len(some) + kind[hit].tolist(), "Int64"), "n": pd.array(count[some].tolist() + [None] * len(hit), "Int64")})

    keys = [*BUCKET, "block"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for b in batches:
            b = b if rest is None else pd.concat([rest, b], ignore_index=True)
            new = (b[keys] != b[keys].shift()).any(axis=1).to_numpy()
            starts = np.flatnonzero(new)
            cut = starts[-1] if len(starts) else 0  # the last bucket may go on
            rest, done = b.iloc[cut:], b.iloc[:cut]
            yield from each(done, starts[:-1])
        if rest is not None and len(rest):
            yield from each(rest.reset_index(drop=True), np.array([0]))

    def each(b: pd.DataFrame, starts: np.ndarray) -> Iterator[pd.DataFrame]:
        code, home, n = b["code"].to_numpy(), b["home"].to_numpy(bool), b["n"].to_numpy()
        kind, side, g, v = b["kind"].to_numpy(), b["side"].to_numpy(), b["g"].to_numpy(), b["v"].tolist()
        found = []
        for s, e in zip(starts, [*starts[1:], len(b)][: len(starts)], strict=True):
            found.append(bucket(int(code[s]), *(c[s:e] for c in (kind, home, side, g, n, v))))
        if found:
            yield pd.concat(found, ignore_index=True)

    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartition(parts, *keys).sortWithinPartitions(*keys).mapInPandas(run, "a long, b long, n long")


def linked(vectors: DataFrame, least: float = LEAST, most: int = MOST, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of vectors.

    Rows link where their labels are equal and not null, their vectors are of one length and their cosine is `least` or more. Null labels, null, empty and zero vectors, and those that
    hold a null, NaN or infinite component, link with nothing. Rows of equal vectors link, of one vec_id or not. A null vec_id
    takes part but names no component; it is not kept. Rows stay in number; an empty table gives an empty one. Other columns are not read.
    """
    v = F.col(vector)
    with passing() as own:
        base = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), labelled(vectors, label, vector).alias("lab"), v.alias("v"), F.xxhash64(v).alias("x"), F.xxhash64(F.lit(1), v).alias("y"))
        rows = written(base.drop("v"), "vectors")
        kinds = base.filter("lab is not null").groupBy("lab", "x", "y").agg(F.count("*").alias("n"), F.min("vec_id").alias("first"), F.first("v").alias("v"))
        kinds = written(kinds.withColumn("kind", F.monotonically_increasing_id()), "kinds")
        found = written(marks(kinds), "marks")
        ball = written(balls(found, kinds, least), "balls")
        members = ball.join(kinds.select("kind", "n"), "kind")
        weight = members.groupBy("ball").agg(F.sum("n").alias("weight"))
        grouped = written(found.join(ball, "kind", "left").select("kind", *BUCKET, "t", "home", F.coalesce("ball", "kind").alias("g")), "grouped")
        got = []
        for t in range(TABLES):
            meet = dealt(grouped.filter(F.col("t") == t).drop("t"), most)
            got.append(written(compared(meet.join(kinds.select("kind", "n", "v"), "kind"), t, least), "links"))
        every = got[0]
        for more in got[1:]:
            every = every.unionByName(more)
        edges = every.filter("b is not null").select("a", "b").unionByName(ball.filter("kind <> ball").select(F.col("ball").alias("a"), F.col("kind").alias("b")))
        roots = written(components(edges), "roots")
        inside = members.join(weight, "ball").select("kind", (F.col("weight") - F.col("n")).alias("n"))
        links = every.filter("n is not null").select(F.col("a").alias("kind"), "n").unionByName(inside).groupBy("kind").agg(F.sum("n").alias("links"))
        of = kinds.drop("v").join(links, "kind", "left").join(roots.withColumnRenamed("v", "kind"), "kind", "left").withColumn("root", F.coalesce("root", "kind"))
        named = of.join(of.groupBy("root").agg(F.min("first").alias("component_id")), "root")
        named = written(named.select("lab", "x", "y", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id"), "named")
        own.keep(rows, named)
    out = rows.join(named, ["lab", "x", "y"], "left")
    component = F.when(F.col("lab").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


ORACLE = """
with recursive sound as (
    select row_number() over () as k, vec_id, label, case when embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0 and label is not null
        then cast(embedding as double[]) end as v from embeddings
), pairs as (
    select a.k as a, b.k as b from sound a join sound b on a.label = b.label and len(a.v) = len(b.v) and a.k <> b.k where list_cosine_similarity(a.v, b.v) >= 0.98
), reach(k, r) as (
    select k, k from sound union select reach.k, pairs.b from reach join pairs on pairs.a = reach.r
), named as (
    select reach.k, min(s.vec_id) as component_id from reach join sound s on s.k = reach.r group by reach.k
)
select vec_id, (select count(*) from pairs where pairs.a = sound.k) as n_links, component_id, vec_id = component_id as kept from sound join named using (k)
"""


def report(vectors: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id, kept."""
    return linked(vectors)
