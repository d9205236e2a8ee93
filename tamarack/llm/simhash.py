"""Operator 6: SimHash fingerprints, linked by a self-join of binary tries, and their connected components.

Fingerprints: each of 64 bits is 1 if more than half of the shingle hashes have it. Equal fingerprints become one row first, so
that copies cost nothing later.
Dealing: two fingerprints with at most 2 differing bits agree on 2 of 4 slices of 16 bits at least. So each goes to 6 groups, by the
two slices held fixed; a link meets in one of them. A group above a bound is dealt again by its free bits in the same
way, until it is small enough or no free bits are left to tell its members apart, which bounds every task.
Join: within a group, a binary trie over the free bits is traversed in pairs of nodes. A pair of nodes that differs adds one
to the pair's differing bits; above the budget, the pair is left.
Components: see components.py.

Near copies beyond what slices serve (`deduplicated`): texts of one set of shingles become one row, rows that share a minimum of rehashed
shingles are held against one another by the same join. Sketches tell which may be similar enough; their whole sets decide.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarack.llm.common import passing, row_mark, written
from tamarack.llm.components import components

BUDGET, GROUP, WIDTH, AT_ONCE = 2, 1024, 3, 4_000_000
#: A sketch has so many bins; so many pairs of sketches are compared at once; groups above MOST are cut into blocks. A key is of so many minima.
BINS, SKETCHES, MOST, BAND = 256, 16_384, 4096, 2
#: Groups above FEW are joined to so many hubs first, then to a stripe of those left at a time.
FEW, STARS, STRIPE = 64, 4, 256
#: The sketches of a pair may fall short of its similarity by so much: 8 standard errors of 256 bins at 0.8.
SLACK = 0.2
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: str.split() would cut at other white space as well
BLANKS = str.maketrans("\t\n\x0b\x0c\r", "     ")


def shingles(text: str, width: int) -> list[str]:
    w = [x for x in text.translate(LOWER).translate(BLANKS).split(" ") if x]
    if len(w) < width:
        return [" ".join(w)] if w else []
    return list(map(" ".join, zip(*(w[k:] for k in range(width)), strict=False)))


def hashed(text: str, width: int) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.array([digest(x.encode(errors="surrogatepass"), 42) for x in shingles(text, width)], np.uint64)


def bits_of(h: np.ndarray) -> int:
    """Bit k is 1 if it is set in over half of the hashes; 0 for no hashes."""
    if not len(h):
        return 0
    ones = np.unpackbits(h.byteswap().view(np.uint8)).reshape(len(h), 64).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(h)).tobytes(), "big")


def fingerprint(text: str, width: int = WIDTH) -> int:
    return bits_of(hashed(text, width))


def fingerprints(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, fp (long) for each row of docs; null texts count as empty and get 0, as texts without a word do."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fp = np.array([fingerprint(t or "", width) for t in b["text"]], np.uint64)
            yield pd.DataFrame({"doc_id": b["doc_id"], "fp": fp.view(np.int64)})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(run, "doc_id long, fp long")


def sketch(distinct: np.ndarray) -> bytes:
    """One byte for each of BINS bins of shingle hashes: 0 for an empty bin, else the low bits of its least rehashed one.

    No bin is filled from another: of few shingles, nearly each has a bin of its own, so that likeness is nearly exact there.
    """
    out = np.zeros(BINS, np.uint8)
    h = np.sort(distinct * np.uint64(0x9E3779B97F4A7C15))
    at = (h >> np.uint64(56)).astype(np.int64) * BINS >> 8
    first = np.flatnonzero(np.append(True, at[1:] != at[:-1])) if len(h) else at
    out[at[first]] = 1 + h[first] % np.uint64(255)
    return out.tobytes()


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity of shingle sets, from rows of sketches: bins with the same least shingle among those not empty in
    both. Two texts without shingles are alike."""
    used = ((a | b) != 0).sum(1)
    same = ((a == b) & (a != 0)).sum(1)
    return np.where(used, same / np.maximum(used, 1), 1.0)


class Hashes(dict):
    """Hashes of words; it forgets all when it has grown to a bound."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 1 << 18:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word.encode(errors="surrogatepass"), 3)
        return h


def quickly_hashed(text: str, width: int, known: Hashes) -> np.ndarray:
    """A hash of each shingle, made of its words' hashes: no string is built."""
    w = [x for x in text.translate(LOWER).translate(BLANKS).split(" ") if x]
    one = np.fromiter(map(known.__getitem__, w), np.uint64, len(w))
    n = max(len(one) - width + 1, min(len(one), 1))
    h = np.zeros(n, np.uint64)
    for k in range(min(width, len(one))):
        h = (h ^ one[k : k + n]) * np.uint64(0x9FB21C651E98DF25)
        h ^= h >> np.uint64(32)
    return h


def marks(docs: DataFrame, width: int, keys: int, sets: bool = True) -> DataFrame:
    """doc_id, mark, id (a hash of the set of shingles), fp (of that set too), keys (that many, each of BAND minima of rehashed shingle hashes), sketch,
    set (the distinct shingle hashes, sorted; null without sets) for each row of docs."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        factors = (np.random.default_rng(11).integers(1 << 62, 1 << 63, keys * BAND).astype(np.uint64) | np.uint64(1))[:, None]
        known = Hashes()
        for b in batches:
            rows = []
            for t in b["text"]:
                u = np.unique(quickly_hashed(t or "", width, known))
                if len(u):
                    least = np.full(keys * BAND, np.iinfo(np.uint64).max)
                    for at in range(0, len(u), 4096):
                        x = u[at : at + 4096] * factors
                        np.minimum(least, (x ^ x >> np.uint64(31)).min(1), out=least)
                else:
                    least = np.zeros(keys * BAND, np.uint64)
                band = [xxhash.xxh64_intdigest(x.tobytes(), k) - (1 << 63) for k, x in enumerate(least.reshape(keys, BAND))]
                rows.append((xxhash.xxh64_intdigest(u.tobytes(), 7), bits_of(u), band, sketch(u), u.tobytes() if sets else None))
            ids, fps, bands, sketches, own = zip(*rows, strict=True) if rows else ((), (), (), (), ())
            whole = lambda x: np.array(x, np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": b["doc_id"], "mark": b["mark"], "id": whole(ids), "fp": whole(fps), "keys": bands, "sketch": sketches, "set": own})

    return docs.select(F.col("doc_id").cast("long"), row_mark(docs), "text").mapInPandas(run, "doc_id long, mark long, id long, fp long, keys array<long>, sketch binary, set binary")


def sets_of(docs: DataFrame, width: int, wanted: DataFrame) -> DataFrame:
    """id, set: the shingle hashes of the rows of docs whose marks are wanted (mark, id), made anew, so that sets of others are never stored."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Hashes()
        for b in batches:
            rows = [(i, np.unique(quickly_hashed(t or "", width, known)).tobytes()) for i, t in zip(b["id"].tolist(), b["text"], strict=True)]
            ok = [r for r in rows if xxhash.xxh64_intdigest(r[1], 7) == r[0] % (1 << 64)]  # another row may have the same mark
            yield pd.DataFrame(ok, columns=["id", "set"]).astype({"id": "int64"})

    return docs.select(row_mark(docs), "text").join(wanted, "mark").select("id", "text").mapInPandas(run, "id long, set binary")


def trie_join(fps: np.ndarray, starts: np.ndarray, ends: np.ndarray, budget: int, starts2: np.ndarray | None = None, ends2: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places of linked fingerprints, from the groups fps[start:end]; in a group, fingerprints are sorted. A pair comes once, a place
    with itself not at all. With starts2 and ends2, links between each group and the range of its group given there.

    A trie node is a range of the array at a bit. All pairs of nodes at a bit are kept as arrays, so that a level of all
    groups' tries takes a few array operations. A pair that has spent more than the budget is not kept. A node of one fingerprint is a
    leaf: what two leaves have left to differ in is counted at once.
    """
    lo1, hi1 = starts, ends
    lo2, hi2 = (starts, ends) if starts2 is None else (starts2, ends2)
    spent = np.zeros(len(starts), np.int64)
    top = fps[1:] ^ fps[:-1]
    left, right = [], []
    for bit in map(np.uint64, range(63, -1, -1)):
        leaves = (hi1 - lo1 == 1) & (hi2 - lo2 == 1)
        a, b = lo1[leaves], lo2[leaves]
        near = (np.bitwise_count(fps[a] ^ fps[b]) <= budget) & (a != b)
        left.append(a[near])
        right.append(b[near])
        lo1, hi1, lo2, hi2, spent = (x[~leaves] for x in (lo1, hi1, lo2, hi2, spent))
        if not len(lo1):
            break
        at = np.flatnonzero(top >> bit == 1) + 1  # where nodes of this level fall into their two halves
        at = np.append(at, len(fps) + 1)

        def half(lo: np.ndarray, hi: np.ndarray, at: np.ndarray = at, bit: np.uint64 = bit) -> np.ndarray:
            cut = at[np.searchsorted(at, lo, "right")]
            return np.where(cut < hi, cut, np.where(fps[lo] >> bit & np.uint64(1), lo, hi))

        mid1, mid2, same, more = half(lo1, hi1), half(lo2, hi2), lo1 == lo2, spent < budget
        kept = []
        for a, b, c, d, extra, wanted in ((lo1, mid1, lo2, mid2, 0, True), (mid1, hi1, mid2, hi2, 0, True), (lo1, mid1, mid2, hi2, 1, more), (mid1, hi1, lo2, mid2, 1, more & ~same)):
            ok = (a < b) & (c < d) & wanted & ((a != c) | (b - a > 1))  # a node of one has no link to itself
            kept.append((a[ok], b[ok], c[ok], d[ok], spent[ok] + extra))
        lo1, hi1, lo2, hi2, spent = map(np.concatenate, zip(*kept, strict=True))
    # what is left are nodes of equal fingerprints: all their pairs
    wide = hi2 - lo2
    n = (hi1 - lo1) * wide
    of = np.repeat(np.arange(len(n)), n)
    k = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    a, b = lo1[of] + k // wide[of], lo2[of] + k % wide[of]
    apart = (a < b) | (lo1 != lo2)[of]
    return np.concatenate([*left, a[apart]]), np.concatenate([*right, b[apart]])


def spanning(n: int, a: np.ndarray, b: np.ndarray, root: np.ndarray | None = None) -> np.ndarray:
    """For each of n places the smallest that links, and those that root stands for, reach from it."""
    root = np.arange(n) if root is None else root.copy()
    while len(a):
        ra, rb = root[a], root[b]
        lo, hi = np.minimum(ra, rb), np.maximum(ra, rb)
        np.minimum.at(root, hi, lo)
        while (root[root] != root).any():
            root = root[root]
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
    return root


def jaccard(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard similarity of the pairs a, b of sets of distinct hashes: those of an a are flagged, and the flags of each of its b counted. Two empty
    sets are alike."""
    own, back = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = back[: len(a)], back[len(a) :]
    size = np.array([len(sets[k]) for k in own], np.int64)
    rank = np.unique(np.concatenate([sets[k] for k in own]), return_inverse=True)[1]
    rank = np.split(rank, np.cumsum(size)[:-1])
    flags, common = np.zeros(int(size.sum()) + 1, bool), np.zeros(len(a), np.int64)
    order = np.argsort(a, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(a[order])) + 1):
        flags[rank[a[part[0]]]] = True
        for k in part:
            common[k] = np.count_nonzero(flags[rank[b[k]]])
        flags[rank[a[part[0]]]] = False
    union = size[a] + size[b] - common
    return np.where(union > 0, common / np.maximum(union, 1), 1.0)


def joined_by(root: np.ndarray, a: np.ndarray, b: np.ndarray, sketches: np.ndarray, least: float, sets: np.ndarray | None) -> np.ndarray:
    """root, after joining the pairs a, b whose sketches have that likeness; with sets (of bytes), whose sets have that similarity, asked where
    sketches are within SLACK. Pairs that are joined already are not compared."""
    for k in range(0, len(a), SKETCHES):
        x, y = a[k : k + SKETCHES], b[k : k + SKETCHES]
        apart = root[x] != root[y]
        x, y = x[apart], y[apart]
        ok = likeness(sketches[x], sketches[y]) >= least - (0 if sets is None else SLACK)
        x, y = x[ok], y[ok]
        if sets is not None and len(x):
            own, back = np.unique(np.concatenate([x, y]), return_inverse=True)
            ok = jaccard([np.frombuffer(v, np.uint64) for v in sets[own]], back[: len(x)], back[len(x) :]) >= least
            x, y = x[ok], y[ok]
        if len(x):
            root = spanning(len(root), x, y, root)
    return root


def star_first(root: np.ndarray, fp: np.ndarray, start: int, end: int, hub: int, budget: int, sketches: np.ndarray, least: float, sets: np.ndarray | None) -> np.ndarray:
    """root, after joining all links among the sorted fingerprints start..end of one group. First all are held against the hub, and then against the
    first of those left, a few times: this joins near copies of one text. Then tries are traversed, in pairs of nodes of those left and of
    all. What the largest part holds is joined, so no link is lost."""
    all_ = np.arange(start, end)
    for _ in range(STARS):
        near = all_[(np.bitwise_count(fp[all_] ^ fp[hub]) <= budget) & (all_ != hub)]
        root = joined_by(root, np.full(len(near), hub), near, sketches, least, sets)
        left = all_[root[all_] != root[hub]]
        if not len(left):
            return root
        hub = left[0]
    parts, n = np.unique(root[all_], return_counts=True)
    left = all_[root[all_] != parts[n.argmax()]]
    for k in range(0, len(left), STRIPE):
        some = left[k : k + STRIPE]
        both = np.concatenate([fp[some], fp[start:end]])
        x, y = trie_join(both, *(np.array([v]) for v in (0, len(some))), budget, *(np.array([v]) for v in (len(some), len(both))))
        root = joined_by(root, some[x], y - len(some) + start, sketches, least, sets)
    return root


def dealt(rows: DataFrame, width: int, budget: int) -> DataFrame:
    """rows (g, fp, free) into the groups that hold all but `budget` slices of the lowest `width` bits of free fixed."""
    parts = budget + 2
    size = width // parts
    cut = lambda k: F.shiftrightunsigned("free", k * size).bitwiseAND((1 << size) - 1)
    out = []
    for held in combinations(range(parts), parts - budget):
        key = F.concat_ws(".", "g", F.lit("".join(map(str, held))), *[F.hex(cut(k)) for k in held])
        rest = F.lit(0).cast("long")
        for place, k in enumerate(k for k in range(parts) if k not in held):
            rest = rest.bitwiseOR(F.shiftleft(cut(k), place * size))
        out.append(F.struct(key.alias("g"), "fp", rest.alias("free")))
    return rows.select(F.inline(F.array(*out)))


def links(fps: DataFrame, budget: int = BUDGET, most: int = GROUP) -> DataFrame:
    """a, b: links among the distinct fingerprints fps (fp) that join whatever two differ in at most `budget` bits.

    Links within a group come as a star on its smallest member of each local component; no two linked
    fingerprints stay apart, and a dense group gives as many rows as it has members, not pairs.
    """
    if 64 % (budget + 2):
        raise ValueError("a budget for which 64 bits fall into budget + 2 equal slices is needed")
    rows, width, small = fps.select(F.lit("").alias("g"), "fp", F.col("fp").alias("free")), 64, []
    while True:
        rows = written(dealt(rows, width, budget), "groups")
        width = width // (budget + 2) * budget
        sizes = rows.groupBy("g").count()
        # a group is no larger than its free bits tell apart
        again = width % (budget + 2) == 0 and 2**width > most
        small.append(rows.join(sizes.filter(F.col("count").between(2, most if again else 2**62)).select("g"), "g", "left_semi").select("g", "fp"))
        if not again:
            break
        large = written(rows.join(sizes.filter(F.col("count") > most).select("g"), "g", "left_semi"), "groups")
        if large.isEmpty():
            break
        rows = large
    held = small[0]
    for more in small[1:]:
        held = held.unionByName(more)
    return grouped_links(held, budget)


def grouped_links(held: DataFrame, budget: int, least: float | None = None) -> DataFrame:
    """a, b: links within the groups of held (g, fp), each local component as a star on its smallest member. Rows (g, fp) are distinct,
    and a group fits a task.

    With least, held is (g, side, id, fp, sketch), its links also need that likeness of sketches, and join ids. With a column set
    too, they need that similarity of sets instead. Sides: 0 members, among which links are sought; 1 members, likewise, with the hub of their
    larger group among them on side 2: members that the hub is not joined to come as (a, null). Or sides 3 and 4, between which links are
    sought.
    """
    whole_sets = "set" in held.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for b in batches:
            b = b if rest is None else pd.concat([rest, b], ignore_index=True)
            last = int((b["g"].to_numpy() == b["g"].iloc[-1]).argmax()) if len(b) else 0  # the last group may go on
            rest, b = b.iloc[last:], b.iloc[:last]
            if len(b):
                yield joined(b) if least is None else near(b)
        if rest is not None and len(rest):
            yield joined(rest) if least is None else near(rest)

    def small_jobs(starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        squares = np.cumsum((ends - starts).astype(np.int64) ** 2) // AT_ONCE
        for k in np.unique(squares):  # so many groups at once that all their pairs would fit
            yield starts[squares == k], ends[squares == k]

    def stars(root: np.ndarray, ids: np.ndarray) -> pd.DataFrame:
        hit = root != np.arange(len(root))
        return pd.DataFrame({"a": ids[root[hit]], "b": pd.array(ids[hit], "Int64")})

    def joined(b: pd.DataFrame) -> pd.DataFrame:
        g, fp = pd.factorize(b["g"])[0], b["fp"].to_numpy().astype(np.int64).view(np.uint64)
        order = np.lexsort((fp, g))
        g, fp = g[order], fp[order]
        starts = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
        ends = np.append(starts[1:], len(g))
        root = np.arange(len(g))
        small = ends - starts <= GROUP
        jobs = [(*x, None, None) for x in small_jobs(starts[small], ends[small])]
        for n in np.flatnonzero(~small):  # a large one by pairs of its parts
            cuts = [*range(starts[n], ends[n], GROUP), ends[n]]
            parts = list(zip(cuts[:-1], cuts[1:], strict=True))
            jobs += [tuple(np.array([x]) for x in (*p, *q)) for k, p in enumerate(parts) for q in parts[k:]]
        for a, z, a2, z2 in jobs:
            x, y = trie_join(fp, a, z, budget, a2, z2)
            if len(x):
                root = spanning(len(root), x, y, root)
        return stars(root, fp.view(np.int64))

    def near(b: pd.DataFrame) -> pd.DataFrame:
        g, side, fp = pd.factorize(b["g"])[0], b["side"].to_numpy(), b["fp"].to_numpy().astype(np.int64).view(np.uint64)
        order = np.lexsort((fp, side == 4, g))
        g, side, fp, ids = g[order], side[order], fp[order], b["id"].to_numpy()[order]
        sketches = np.frombuffer(b"".join(b["sketch"].to_numpy()[order]), np.uint8).reshape(-1, BINS)
        sets = b["set"].to_numpy()[order] if whole_sets else None
        starts = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
        ends = np.append(starts[1:], len(g))
        root, lone = np.arange(len(g)), []
        few = (side[starts] == 0) & (ends - starts <= FEW)
        for a, z in small_jobs(starts[few], ends[few]):
            root = joined_by(root, *trie_join(fp, a, z, budget), sketches, least, sets)
        for start, end in zip(starts[~few], ends[~few], strict=True):
            if side[start] in (3, 4):
                cut = start + int((side[start:end] == 3).sum())
                for k in range(start, cut, STRIPE):
                    x, y = trie_join(fp, *(np.array([v]) for v in (k, min(k + STRIPE, cut))), budget, *(np.array([v]) for v in (cut, end)))
                    root = joined_by(root, x, y, sketches, least, sets)
                continue
            hubs = np.flatnonzero(side[start:end] == 2)
            root = star_first(root, fp, start, end, start + (int(hubs[0]) if len(hubs) else 0), budget, sketches, least, sets)
            if len(hubs):
                own = np.arange(start, end)
                lone.append(pd.DataFrame({"a": ids[own[root[own] != root[start + hubs[0]]]]}))
        return pd.concat([stars(root, ids), *lone], ignore_index=True)

    parts = max(1, int(held.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return held.repartition(parts, "g").sortWithinPartitions("g").mapInPandas(run, "a long, b long")


def within(one: DataFrame, data: DataFrame, budget: int, least: float, most: int) -> DataFrame:
    """a, b: links among the ids of each group of one (g, id), by data (id, fp, sketch, and set where sets decide).

    A group above `most` is cut into blocks. Each is linked by itself, the group's hub, its smallest id, with it. Pairs of which both are joined to
    the hub need nothing more. All others have a member that is not, and these go to all blocks, a stripe at a time: nothing is left
    out, no task takes more than a block and a stripe, and of a group of near copies of one text little work is left.
    """
    one = written(one, "groups")
    sizes = written(one.groupBy("g").agg(F.count("*").alias("all"), F.min("id").alias("hub")).filter("`all` > 1"), "sizes")
    small = one.join(sizes.filter(F.col("all") <= most).select("g"), "g").select("g", F.lit(0).alias("side"), "id")
    large = sizes.filter(F.col("all") > most).withColumn("blocks", F.ceil(F.col("all") / most).cast("int"))
    named = lambda *c: F.xxhash64(*c).alias("g")  # noqa: E731  two groups of one name only meet needlessly
    cut = one.join(large, "g").withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    hubs = large.select("g", "hub", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    blocks = cut.filter("id <> hub").select(named("g", "block"), F.lit(1).alias("side"), "id").unionByName(hubs.select(named("g", "block"), F.lit(2).alias("side"), F.col("hub").alias("id")))
    found = written(grouped_links(small.unionByName(blocks).join(data, "id"), budget, least), "near")
    linked = found.filter("b is not null")
    lone = found.filter("b is null").select(F.col("a").alias("id")).distinct()
    if large.isEmpty() or lone.isEmpty():
        return linked
    left = cut.join(lone, "id").withColumn("stripe", F.floor(F.pmod(F.xxhash64(F.lit(1), "id"), F.col("blocks"))).cast("int"))
    stripes = left.select("g", "stripe").distinct()
    other = F.sequence(F.lit(0), F.col("blocks") - 1)
    ask = left.withColumn("block", F.explode(other)).select(named("g", "block", "stripe"), F.lit(3).alias("side"), "id")
    all_ = cut.join(stripes, "g").select(named("g", "block", "stripe"), F.lit(4).alias("side"), "id")
    more = written(grouped_links(ask.unionByName(all_).join(data, "id"), budget, least), "near")
    return linked.unionByName(more)


def near_links(kinds: DataFrame, budget: int, least: float, most: int | None = None, sets: DataFrame | Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """a, b: links among kinds (id, fp, keys, sketch) that share one of their keys, differ in at most `budget` bits and have sketches of a
    likeness of `least` or more; with sets (id, set; rows may repeat; or a function that gives those of a table of ids), sets of that
    similarity. Sets travel only for the ids that sketches leave a partner.

    For budgets that slices of the fingerprint can't serve. Texts of Jaccard similarity s share a given key with chance s ^ BAND.
    """
    most = most or MOST
    one = kinds.select("id", F.posexplode("keys").alias("i", "key")).select(F.xxhash64("i", "key").alias("g"), "id")
    data = kinds.select("id", "fp", "sketch")
    if sets is None:
        return within(one, data, budget, least, most)
    likely = within(one, data, budget, least - SLACK, most)
    likely = written(likely.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "likely")
    found = sets(likely) if callable(sets) else sets.join(likely, "id", "left_semi")
    whole = written(found.dropDuplicates(["id"]).join(data, "id"), "sets")
    return within(one.join(likely, "id"), whole, budget, least, most)


def names(by: str, linked: DataFrame, kinds: DataFrame) -> DataFrame:
    """by, root, which stands for all that links between values of the column `by` reach, and component_id, the smallest doc_id
    (first, in kinds) of these."""
    roots = written(components(linked), "components")
    of = kinds.join(roots.withColumnRenamed("v", by), by, "left").select(by, "first", F.coalesce("root", by).alias("root"))
    out = written(of.join(of.groupBy("root").agg(F.min("first").alias("component_id")), "root").select(by, "root", "component_id"), "names")
    return out


def clustered(docs: DataFrame, width: int = WIDTH, budget: int = BUDGET) -> DataFrame:
    """doc_id, fp, component_id for each row of docs: the smallest doc_id that links reach, its own included.

    Null and empty texts get fingerprint 0, which links like any other. A null doc_id takes part in its text's component but
    names none; a component of null ids only has a null component_id. Repeated rows stay. An empty table gives an empty one.
    """
    with passing() as own:
        marked = written(fingerprints(docs, width), "fingerprints")
        kinds = written(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "kinds")
        named = names("fp", links(kinds.select("fp"), budget), kinds)
        own.keep(marked, named)
    return marked.join(named, "fp").select("doc_id", "fp", "component_id")


def near_named(docs: DataFrame, width: int, budget: int, keys: int, least: float) -> DataFrame:
    """doc_id, mark (of row_mark), root, component_id for each row of docs, by the links of near_links. Rows of one component have one root,
    and a root has one component, null ids or not."""
    with passing() as own:
        marked = written(marks(docs, width, keys, False).drop("set"), "fingerprints")
        rows = written(marked.select("doc_id", "mark", "id"), "rows")
        kinds = marked.groupBy("id").agg(F.min("doc_id").alias("first"), F.min("mark").alias("mark"), F.first(F.struct("fp", "keys", "sketch")).alias("of"))
        kinds = written(kinds.select("id", "first", "mark", "of.*"), "kinds")
        linked = near_links(kinds, budget, least, sets=lambda likely: sets_of(docs, width, kinds.select("id", "mark").join(likely, "id", "left_semi")))
        named = names("id", linked, kinds.select("id", "first"))
        own.keep(rows, named)
    return rows.join(named, "id").drop("id")


def near_clustered(docs: DataFrame, width: int, budget: int, keys: int, least: float) -> DataFrame:
    """doc_id, component_id for each row of docs, by the links of near_links. Texts of one set of shingles belong together; so do all texts
    without a word, null ones included. Null ids, repeated rows and empty tables as in clustered."""
    return near_named(docs, width, budget, keys, least).select("doc_id", "component_id")


def deduplicated(docs: DataFrame, width: int, budget: int, keys: int, least: float = 0.8) -> DataFrame:
    """docs with one row of each component of near_clustered: that of its smallest doc_id, and of these, of the least hash of its values. A row
    of null doc_id stays only where its component has no other. Of equal rows, one stays. Columns are those of docs."""
    with passing() as own:
        found = near_named(docs, width, budget, keys, least)
        first = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "mark")).alias("of"))
        first = written(first.select(F.col("of.doc_id").alias("id_"), F.col("of.mark").alias("mark_")), "kept")
        own.keep(first)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("doc"), row_mark(docs))
    return rows.join(first, F.col("doc").eqNullSafe(F.col("id_")) & (F.col("mark") == F.col("mark_"))).dropDuplicates(["doc", "mark"]).select("row.*")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits), component_id."""
    return clustered(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
