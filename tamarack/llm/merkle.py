"""Operator 12: a Merkle manifest of a dataset, built and verified by supersteps over RDDs.

Leaves are digests of rows. Each group (a language) has a binary tree over its leaves in order of id; the trees' roots, in order of group, are the leaves of
one more tree. Vertices are dealt out by subtrees of LEVELS levels, of 2^LEVELS children at most, so that no vertex gets a message for each row of its group.
Up: in each superstep children message their digests to the vertex above; a vertex whose children are complete hashes its
levels and forwards its digest. A tree that is down to one node halts. Down: in reverse, each vertex hands to each child the path of siblings
from that child to the root, its own and what it got from above. At the leaves a path is folded onto the row's digest and held against the root.
Every superstep's vertices are a written table, which cuts the lineage: a lost executor costs a superstep. Texts never leave the JVM, nor are they shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

from pyspark import RDD
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from tamarack.llm.common import passing, written

#: Levels of a tree that one superstep climbs; nodes for each partition of a superstep.
LEVELS, NODES = 8, 20_000
#: Steps of a path: no sibling at that level, one to the right, one to the left.
ALONE, RIGHT, LEFT = 0, 1, 2
VERTEX = "tree long, place long, n long, kids binary, top binary, done boolean, ids array<long>, told array<binary>"
PROOF = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def hashed(*digests: bytes) -> bytes:
    """The digest of digests written as hexadecimal text."""
    return hashlib.sha256("".join(d.hex() for d in digests).encode()).digest()


def field(value: Column) -> Column:
    """A value with its count of UTF-8 bytes before it, so that fields cannot run into one another; "-" for null."""
    text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def levels(kids: list[bytes], climb: int | None) -> list[list[bytes]]:
    """The levels of a subtree, from its children up: so many, or with None until one node is left."""
    out = [kids]
    while len(out) - 1 < climb if climb is not None else len(out[-1]) > 1:
        out.append([hashed(*out[-1][k : k + 2]) for k in range(0, len(out[-1]), 2)])
    return out


def climbed(n: int, most: int) -> int | None:
    """How many levels a vertex climbs in a tree with n nodes at its level: the most where more than one vertex has that level."""
    return most if n > 1 << most else None


def steps(above: list[list[bytes]], k: int) -> tuple[bytes, bytes]:
    """The path of child k: what stands at each level, and the siblings' digests."""
    codes, siblings = bytearray(), []
    for level in above[:-1]:
        other = k ^ 1
        if other < len(level):
            codes.append(RIGHT if other > k else LEFT)
            siblings.append(level[other])
        else:
            codes.append(ALONE)
        k >>= 1
    return bytes(codes), b"".join(siblings)


def folded(digest: bytes, codes: bytes, siblings: bytes) -> bytes:
    """What the path makes of a leaf's digest."""
    at = 0
    for code in codes:
        if code == ALONE:
            digest = hashed(digest)
            continue
        other, at = siblings[at : at + 32], at + 32
        digest = hashed(digest, other) if code == RIGHT else hashed(other, digest)
    return digest


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """rows, as a written table, with part and at: the range of the order (nulls first) that holds the row, and its place in that. No task
    sorts more than a range."""
    by = [F.col(c).asc_nulls_first() for c in order]
    dealt = rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("at", F.monotonically_increasing_id())
    dealt = written(dealt, "merkle-ranges")
    return dealt.withColumn("part", F.shiftright("at", 33)).withColumn("at", F.col("at").bitwiseAND((1 << 33) - 1))


def placed(leaves: DataFrame) -> DataFrame:
    """leaves (group, doc_id, leaf, told, row) with tree (the group's place among groups), place (the row's in its tree) and n (rows of the tree). row tells
    equal rows apart, so that however many there are, they spread over ranges."""
    rows = numbered(leaves, "group", "doc_id", "leaf", "row")
    runs = rows.groupBy("part", "group").agg(F.count("*").alias("here"), F.min("at").alias("first"))
    before = Window.partitionBy("group").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range at most
    runs = runs.withColumn("start", F.coalesce(F.sum("here").over(before), F.lit(0)) - F.col("first")).withColumn("n", F.sum("here").over(Window.partitionBy("group")))
    groups = numbered(runs.select("group").distinct(), "group")
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    starts = groups.groupBy("part").agg(F.count("*").alias("here")).select("part", F.coalesce(F.sum("here").over(ahead), F.lit(0)).alias("ahead"))
    trees = groups.join(starts, "part").select(F.col("group").alias("g"), (F.col("ahead") + F.col("at")).alias("tree"))
    runs = runs.join(trees, F.col("group").eqNullSafe(F.col("g"))).select(F.col("part").alias("p"), "g", "tree", "start", "n")
    of = (F.col("part") == F.col("p")) & F.col("group").eqNullSafe(F.col("g"))
    return rows.join(runs, of).select("tree", (F.col("at") + F.col("start")).alias("place"), "n", "doc_id", F.unhex("leaf").alias("digest"), F.unhex("told").alias("told"))


def parts_of(n: int, spark) -> int:
    return max(1, min(-(-n // NODES), int(spark.conf.get("spark.sql.shuffle.partitions"))))


def climb(nodes: DataFrame, count: int, most: int) -> list[DataFrame]:
    """The vertices of each superstep up, from nodes (tree, place, n, digest, and of leaves doc_id and told). count: of nodes."""
    spark, out, mask = nodes.sparkSession, [], (1 << most) - 1
    while count:
        leaves = not out

        def message(r: Row, leaves: bool = leaves) -> tuple:
            own = (r.place & mask, bytes(r.digest), r.n)
            return (r.tree, r.place >> most), own + ((r.doc_id, bytes(r.told) if r.told is not None else None) if leaves else ())

        def vertex(x: tuple, leaves: bool = leaves) -> tuple:
            (tree, place), got = x
            got = sorted(got, key=lambda m: m[0])
            kids, n = [m[1] for m in got], got[0][2]
            top = levels(kids, climbed(n, most))[-1][0]
            return tree, place, n, b"".join(kids), top, n <= 1 << most, [m[3] for m in got] if leaves else None, [m[4] for m in got] if leaves else None

        grouped = nodes.rdd.map(message).groupByKey(parts_of(count, spark)).map(vertex)
        out.append(written(spark.createDataFrame(grouped, VERTEX, verifySchema=False), "merkle-vertices"))
        going = out[-1].filter("not done")
        count = going.count()
        nodes = going.select("tree", "place", F.ceil(F.col("n") / (1 << most)).alias("n"), F.col("top").alias("digest"))
    return out


def with_paths(vertices: DataFrame, paths: RDD, most: int, per_child: Callable[[Row, int, bytes, bytes, tuple], object]) -> RDD:
    """per_child(vertex, k, codes, siblings, rest) of each child of vertices that paths ((tree, place), (codes, siblings, *rest)) reach."""

    def handed(x: tuple) -> Iterator[object]:
        _, (v, path) = x
        kids = [bytes(v.kids[k : k + 32]) for k in range(0, len(v.kids), 32)]
        above = levels(kids, climbed(v.n, most))
        for k in range(len(kids)):
            codes, siblings = steps(above, k)
            yield per_child(v, k, codes + path[0], siblings + path[1], path[2:])

    parts = parts_of(vertices.count() << most, vertices.sparkSession)
    return vertices.rdd.map(lambda v: ((v.tree, v.place), v)).join(paths, parts).flatMap(handed)


def descend(steps_up: list[DataFrame], tops: RDD, most: int, last: Callable[[Row, int, bytes, bytes, tuple], object]) -> RDD:
    """last() of each child of the first superstep. tops: (tree, (codes, siblings, *rest)), the path above each tree's root."""
    lower = lambda v, k, codes, siblings, rest: ((v.tree, (v.place << most) + k), (codes, siblings, *rest))
    spark, tops, paths = steps_up[0].sparkSession, tops.map(lambda x: ((x[0], 0), x[1])), None
    for level in reversed(range(len(steps_up))):
        vertices = steps_up[level]
        halted = vertices.filter("done").rdd.map(lambda v: ((v.tree, v.place), None)).join(tops).mapValues(lambda x: x[1])
        paths = halted if paths is None else paths.union(halted)
        if not level:
            return with_paths(vertices, paths, most, last)
        down = with_paths(vertices, paths, most, lower).map(lambda x: (*x[0], *x[1]))
        names = "tree long, place long, codes binary, siblings binary, subroot binary, root binary"
        down = written(spark.createDataFrame(down, names, verifySchema=False), "merkle-paths")
        paths = down.rdd.map(lambda r: ((r.tree, r.place), (bytes(r.codes), bytes(r.siblings), bytes(r.subroot), bytes(r.root))))
    raise AssertionError


def proved(leaves: DataFrame, most: int = LEVELS) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified for each row of leaves (group, doc_id, leaf, told, row): told is the digest (hexadecimal) of
    the row as it is now, null where it is as it was. most: levels of a superstep. An empty table gives an empty one."""
    spark = leaves.sparkSession
    with passing() as own:
        nodes = written(placed(written(leaves, "merkle-leaves")), "merkle-placed")
        up = climb(nodes, nodes.count(), most)
        if not up:
            out = written(spark.createDataFrame([], PROOF), "merkle-proofs")
            own.keep(out)
            return out
        roots = up[0]
        for more in up[1:]:
            roots = roots.unionByName(more)
        roots = written(roots.filter("done").select("tree", F.col("top").alias("digest")), "merkle-roots")
        trees = roots.count()
        above = climb(roots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("place"), F.lit(trees).cast("long").alias("n"), "digest", F.col("tree").alias("doc_id"), F.lit(None).cast("binary").alias("told")), trees, most)
        root = bytes(above[-1].first().top)
        child = lambda v, k, codes, siblings, rest: (v.ids[k], (codes, siblings, bytes(v.kids[32 * k : 32 * k + 32]), root))
        start = spark.sparkContext.parallelize([(0, (b"", b"", b"", b""))], 1)
        tops = descend(above, start, most, child)

        def proof(v: Row, k: int, codes: bytes, siblings: bytes, rest: tuple) -> tuple:
            leaf, told, (subroot, root) = bytes(v.kids[32 * k : 32 * k + 32]), v.told[k], rest
            got = folded(leaf if told is None else bytes(told), codes, siblings)
            return v.ids[k], leaf.hex(), subroot.hex(), root.hex(), hashlib.sha256(siblings.hex().encode()).hexdigest(), got.hex(), got == root

        out = written(spark.createDataFrame(descend(up, tops, most, proof), PROOF, verifySchema=False), "merkle-proofs")
        own.keep(out)
    return out


def leaf_of(values: list[Column]) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def manifest(docs: DataFrame, columns: list[str], group: str, changed: dict[str, Column] | None = None, when: Column | None = None, most: int = LEVELS) -> DataFrame:
    """The proofs (see proved) of docs' rows, whose digests cover `columns`, in a tree for each value of `group`, null one of them. changed, where `when` holds: what a
    tampered row has instead, so that verification can be seen to find it. Null ids come first in their tree; rows of one id follow the order of
    their digests. Equal rows each have a leaf. Other columns are not read."""
    told = leaf_of([(changed or {}).get(c, F.col(c)) for c in columns]) if changed else F.lit(None).cast("string")
    told = F.when(when, told) if changed and when is not None else told
    return proved(docs.select(F.col(group).cast("string").alias("group"), F.col("doc_id").cast("long"), leaf_of([F.col(c) for c in columns]).alias("leaf"), told.alias("told"), F.monotonically_increasing_id().alias("row")), most)


def report(docs: DataFrame, most: int = LEVELS) -> DataFrame:
    """The manifest of documents by language, where each row whose crc32(doc_id) 7 divides has n_chars one too high. Rows of null id are left as they are."""
    tampered = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % 7 == 0
    return manifest(docs, ["doc_id", "source", "lang", "n_chars", "text"], "lang", {"n_chars": F.col("n_chars") + 1}, tampered, most)


def crc_table() -> list[int]:
    """The remainders of a byte's eight steps, by the reflected polynomial of CRC-32."""
    out = list(range(256))
    for _ in range(8):
        out = [c >> 1 ^ 0xEDB88320 if c & 1 else c >> 1 for c in out]
    return out


def _sql() -> str:
    field = lambda c: f"case when {c} is null then '-' else cast(octet_length(encode(cast({c} as varchar))) as varchar) || ':' || cast({c} as varchar) end"
    leaf = lambda n: "sha256(" + " || ".join(field(c) for c in ("doc_id", "source", "lang", n, "text")) + ")"
    fold = """
        select k, lvl + 1, pos // 2, (n + 1) // 2, sha256(case when d is null then cur when pos % 2 = 0 then cur || d else d || cur end), sibs || coalesce(d, '')
        from (select f.*, s.d from {f} f left join {nodes} s on s.lvl = f.lvl and {same}s.idx = xor(f.pos, 1) where f.n > 1)
    """
    return f"""
with recursive table_of as (select {crc_table()}::bigint[] as t),
docs as (
    select *, xor(list_reduce(list_prepend(4294967295::bigint, [ascii(c)::bigint for c in string_split(cast(doc_id as varchar), '')]), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295::bigint) as crc
    from documents, table_of
), leaves as (
    select *, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as idx, count(*) over (partition by lang) as n, row_number() over () as k
    from (select doc_id, lang, {leaf("n_chars")} as leaf, case when crc % 7 = 0 then {leaf("n_chars + 1")} end as told from docs)
), nodes(lvl, lang, idx, n, d) as (
    select 0, lang, idx, n, leaf from leaves
    union all
    select lvl + 1, lang, idx // 2, (n + 1) // 2, sha256(string_agg(d, '' order by idx)) from nodes where n > 1 group by lvl, lang, idx // 2, n
), subs as (
    select lang, d as subroot, row_number() over (order by lang nulls first) - 1 as idx, count(*) over () as n from nodes where n = 1
), tops(lvl, idx, n, d) as (
    select 0, idx, n, subroot from subs
    union all
    select lvl + 1, idx // 2, (n + 1) // 2, sha256(string_agg(d, '' order by idx)) from tops where n > 1 group by lvl, idx // 2, n
), low(k, lvl, pos, n, cur, sibs) as (
    select k, 0, idx, n, coalesce(told, leaf), '' from leaves
    union all {fold.format(f="low", nodes="(select n.*, l.k from nodes n join leaves l on n.lang is not distinct from l.lang)", same="s.k = f.k and ")}
), high(k, lvl, pos, n, cur, sibs) as (
    select low.k, 0, subs.idx, subs.n, low.cur, low.sibs from low join leaves using (k) join subs on subs.lang is not distinct from leaves.lang where low.n = 1
    union all {fold.format(f="high", nodes="tops", same="")}
)
select leaves.doc_id, leaf, subroot, root.d as root, sha256(sibs) as proof_sha256, cur as folded_root, cur = root.d as verified
from leaves join high using (k) join subs on subs.lang is not distinct from leaves.lang, (select d from tops where n = 1) root where high.n = 1
"""


ORACLE = _sql()
