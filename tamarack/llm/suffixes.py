"""Operator 7: removes every byte that lies in a long string which starts more than once.

All suffixes of a corpus, sorted by the difference-cover algorithm, would move tens of bytes for each byte of text. Two equal strings
of LENGTH bytes need only meet in one sort, though, and what they are known to share need not be sorted again. So:
1. Anchors. Of the ANCHOR-byte windows of each LENGTH-byte string, the first of least hash is its anchor; equal strings have equal
   anchors at equal places. About one byte in 150 starts an anchor, and only these travel.
2. Contexts. All strings that one anchor is least in lie in the bytes around it. Where the whole context occurs twice, all of it
   goes, and one of the equal contexts stands for them from then on. Anchors with one context alone are done.
3. Names. The strings of a context that begin in one of PARTS ranges before the anchor all hold the same middle bytes, 325 of
   400. A middle gets a name; a range whose name occurs once has no repeat, and goes no further. In a range that does go on, the
   middle is one letter, its name, with at most 75 bytes to either side.
4. Suffix sort. Ranges of one name meet in one bundle, whose suffixes are sorted by the difference-cover algorithm: triples at places 1
   and 2 mod 3 are sorted and named, their names sorted in turn by recursion, the remaining suffixes sorted by their letter
   and the name behind it, and both merged. Neighbours whose prefixes agree, letter by letter, over the length of a string, go.
5. Names with too many ranges for one task: such ranges are halved, which makes the middle longer and its names rarer, until
   they are few enough or one string is left of each range, which its name alone decides.
The same goes for passages of PASSAGE words, in any case and spacing: each word becomes four bytes, a hash of it, and strings of so many
words are sought among these in the same sort. They are counted, not removed.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarack.llm.common import dropped, passing, written

LENGTH, PASSAGE, PARTS, BUNDLE, MOST, PIECE = 400, 50, 4, 100_000, 4096, 1 << 18
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ\t\n\x0b\x0c\r", "abcdefghijklmnopqrstuvwxyz     ")


class Size(NamedTuple):
    """The length in bytes of the strings sought, and of their anchors."""

    length: int
    anchor: int

    @property
    def reach(self) -> int:
        return self.length - self.anchor

    def edges(self) -> list[int]:
        """Where the ranges of a string's start before its anchor begin."""
        return [round(k * (self.reach + 1) / PARTS) for k in range(PARTS + 1)]


#: Strings of the text's bytes, and of four bytes for each word.
BYTES, WORDS = Size(LENGTH, 100), Size(4 * PASSAGE, 40)


def written_in(text: str, z: Size) -> bytes:
    if z == BYTES:
        return text.encode()
    digest = xxhash.xxh32_intdigest
    return np.array([digest(w.encode()) for w in text.translate(LOWER).split(" ") if w], np.uint32).tobytes()
BASE, BACK = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
LETTERS = np.random.default_rng(20240607).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = 1 << max(16, n.bit_length())
        _powers[:] = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, x)]), dtype=np.uint64) for x in (BASE, BACK)]
    return _powers[0][:n], _powers[1][:n]


def window_hashes(b: np.ndarray, width: int) -> np.ndarray:
    """64-bit hashes of all strings of width bytes, from running sums."""
    up, down = powers(len(b))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(LETTERS[b] * down, dtype=np.uint64)])
    h = (sums[width:] - sums[:-width]) * up[: len(b) - width + 1]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ h >> np.uint64(29)


def sliding(x: np.ndarray, width: int, least) -> np.ndarray:
    span = 1
    while span * 2 <= width:
        x = least(x[:-span], x[span:])
        span *= 2
    return least(x[: len(x) - (width - span)], x[width - span :]) if span < width else x


def anchors(b: np.ndarray, ends: np.ndarray, z: Size, first: int = 0, last: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Where anchors start, their hashes, and how many bytes before and behind an anchor belong to strings that it anchors.

    b: texts behind each other, which end at `ends`. Strings start within a text at first..last of b. Those of one anchor begin at a run of
    places, as a lesser hash to either side ends them, or an equal one before."""
    none, reach = np.empty(0, np.int64), z.reach
    if len(b) < z.length:
        return none, none.astype(np.uint64), none, none
    h = window_hashes(b, z.anchor)
    least = sliding(h, reach + 1, np.minimum)
    starts = np.append(0, ends[:-1])
    valid = np.zeros(len(b) + 1, np.int8)  # starts of strings that end within their text
    long = ends - starts >= z.length
    np.add.at(valid, starts[long], 1)
    np.add.at(valid, ends[long] - z.length + 1, -1)
    ok = np.cumsum(valid, dtype=np.int8)[: len(least)] > 0
    ok[:first] = False
    if last is not None:
        ok[last + 1 :] = False
    least[~ok] = 0
    pad = np.zeros(reach, np.uint64)
    at = np.flatnonzero((sliding(np.concatenate([pad, least, pad]), reach + 1, np.maximum) == h) & (h > 0))
    if not len(at):
        return none, none.astype(np.uint64), none, none
    begin = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    end, value = np.append(begin[1:], len(least)) - 1, least[begin]
    low, high = np.maximum(at - reach, 0), np.minimum(at, len(least) - 1)
    run = np.searchsorted(begin, low, "right") - 1
    seek = np.flatnonzero(value[run] != h[at])
    while len(seek):
        run[seek] += 1
        seek = seek[value[run[seek]] != h[at[seek]]]
    low, high = np.maximum(low, begin[run]), np.minimum(high, end[run])
    # of equal hashes in one string, the first is its anchor
    again = np.flatnonzero(h[at[1:]] == h[at[:-1]]) + 1
    low[again] = np.maximum(low[again], at[again - 1] + 1)
    own = low <= high
    at, low, high = at[own], low[own], high[own]
    return at, h[at], at - low, reach - (at - high)


def pieces(raws: list[bytes], z: Size) -> Iterator[tuple[list[int], bytes, int, int | None, int]]:
    """Texts' numbers, their bytes behind each other, the first and last start of a string, and where in the text these bytes begin: many short texts
    at once, a long text in parts that overlap, so that memory is bounded."""
    some, size = [], 0
    for k, raw in enumerate(raws):
        if len(raw) < z.length:
            continue
        if len(raw) > 2 * PIECE:
            for at in range(0, len(raw) - z.length + 1, PIECE):  # a string starts in one piece only
                yield [k], raw[at : at + PIECE + z.length - 1], 0, PIECE - 1, at
            continue
        if size + len(raw) > PIECE and some:
            yield some, b"".join(raws[x] for x in some), 0, None, 0
            some, size = [], 0
        some.append(k)
        size += len(raw)
    if some:
        yield some, b"".join(raws[x] for x in some), 0, None, 0


def contexts_of(raws: list[bytes], z: Size) -> Iterator[pd.DataFrame]:
    """of (number of the text), size, at, left, right, h, c (hash of the context), n, self for the texts' anchors. Of equal contexts in one piece, the first
    stands for all n, and self has the spans of their bytes, start and end by turns."""
    digest = xxhash.xxh3_64_intdigest
    for some, raw, first, last, shift in pieces(raws, z):
        ends = np.cumsum([len(raws[x]) for x in some]) if last is None else np.array([len(raw)])
        at, h, left, right = anchors(np.frombuffer(raw, np.uint8), ends, z, first, last)
        if not len(at):
            continue
        c = np.array([digest(raw[a - lo : a + z.anchor + hi], lo) for a, lo, hi in zip(at.tolist(), left.tolist(), right.tolist(), strict=True)], np.uint64)
        of = np.searchsorted(ends, at, "right")
        order = np.lexsort((at, c, h, of))
        one = lambda x: x[order]
        new = np.concatenate([[True], (one(of)[1:] != one(of)[:-1]) | (one(h)[1:] != one(h)[:-1]) | (one(c)[1:] != one(c)[:-1])])
        begin = np.flatnonzero(new)
        n = np.diff(np.append(begin, len(order)))
        own = at + shift - np.append(0, ends)[of]
        kept = order[begin]
        spans: list[list[int] | None] = [None] * len(begin)
        for k in np.flatnonzero(n > 1):
            x = order[begin[k] : begin[k] + n[k]]
            spans[k] = [v for s in merged(own[x] - left[x], own[x] + z.anchor + right[x]) for v in s]
        yield pd.DataFrame({"of": np.array(some)[of[kept]], "size": z.length, "at": own[kept], "left": left[kept], "right": right[kept], "h": h[kept].view(np.int64), "c": c[kept].view(np.int64), "n": n, "self": spans})


def all_anchors(docs: DataFrame) -> DataFrame:
    """x, y (of the text), size, at, left, right, h, c, n, self: the contexts of all texts that are long enough."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            x, y = d["x"].to_numpy(), d["y"].to_numpy()
            for z in (BYTES, WORDS):
                for found in contexts_of([written_in(t, z) for t in d["text"]], z):
                    of = found.pop("of").to_numpy()
                    found.insert(0, "x", x[of])
                    found.insert(1, "y", y[of])
                    yield found

    return docs.select("x", "y", "text").mapInPandas(run, "x long, y long, size int, at int, left int, right int, h long, c long, n long, self array<int>")


def ordered(keys: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of keys, none above most, and the keys in it. Places ride in the low bits where they fit: a sort of numbers
    takes a fraction of the time of a sort of places."""
    bits = len(keys).bit_length()
    if most.bit_length() + bits > 63:
        order = np.argsort(keys)
        return order, keys[order]
    both = keys << bits
    both |= np.arange(len(keys))
    both.sort()
    return both & ((1 << bits) - 1), both >> bits


def suffix_array(t: np.ndarray) -> np.ndarray:
    """The starts of t's suffixes in order. t: numbers from 1."""
    n = len(t)
    if n < 4:
        return np.array(sorted(range(n), key=lambda i: t[i:].tolist()), np.int64)
    s = np.zeros(n + 5, np.int64)
    s[:n] = t
    n0, n1, n2 = (n + 2) // 3, (n + 1) // 3, n // 3
    m1 = n0  # places 1 mod 3, with n itself where n % 3 is 1: it keeps the two halves apart
    wide = int(s.max()) + 1
    triple = np.empty(m1 + n2, np.int64)
    triple[:m1] = (s[1::3][:m1] * wide + s[2::3][:m1]) * wide + s[3::3][:m1]
    triple[m1:] = (s[2::3][:n2] * wide + s[3::3][:n2]) * wide + s[4::3][:n2]
    order, keys = ordered(triple, wide**3)
    names = np.empty(m1 + n2, np.int64)
    name = np.cumsum(np.concatenate([[True], keys[1:] != keys[:-1]]))
    names[order] = name
    if name[-1] < len(names):
        order = suffix_array(names)
        names[order] = np.arange(1, len(order) + 1)
    rank = np.zeros(n + 5, np.int64)
    rank[1::3][:m1], rank[2::3][:n2] = names[:m1], names[m1:]
    of_one = order < m1
    sa12 = np.where(of_one, 3 * order + 1, 3 * (order - m1) + 2)
    if m1 > n1:
        inside = sa12 < n
        sa12, of_one = sa12[inside], of_one[inside]
    big = len(rank) + 1
    zero, behind = ordered(s[0::3][:n0] * big + rank[1::3][:n0], wide * big)
    zero *= 3
    one, two = sa12[of_one], sa12[~of_one]
    before = np.searchsorted(s[one] * big + rank[one + 1], behind)
    key = lambda i: (s[i] * wide + s[i + 1]) * big + rank[i + 2]
    before += np.searchsorted(key(two), key(zero))
    out = np.empty(n, np.int64)
    own = before + np.arange(n0)
    rest = np.ones(n, bool)
    rest[own] = False
    out[own], out[rest] = zero, sa12
    return out


def merged(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Overlapping or touching spans as one, in order."""
    order = np.lexsort((ends, starts))
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.flatnonzero(np.concatenate([[True], starts[1:] > ends[:-1]])) if len(starts) else np.empty(0, int)
    return list(zip(starts[new].tolist(), ends[np.append(new[1:] - 1, len(ends) - 1)].tolist(), strict=True)) if len(new) else []


MARK = "h long, c long, start int, end int"
RANGE = "h long, c long, k long, size int, base int, width int, lo int, hi int, before binary, behind binary"


def ranges(texts: DataFrame) -> DataFrame:
    """The ranges of the contexts that texts (text, asked: size, h, c, at, left, right) are asked for. Strings of a range begin base + lo .. base + hi bytes before
    the anchor, of at most width such places; k is the name of their middle; before and behind are the bytes around it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        digest = lambda x, seed: xxhash.xxh3_64_intdigest(x, seed) - (1 << 63)
        for b in batches:
            rows = []
            for text, asked in zip(b["text"], b["asked"], strict=True):
                for z in (BYTES, WORDS):
                    want = [w for w in asked if w["size"] == z.length]
                    raw, edges = written_in(text, z) if want else b"", z.edges()
                    for w in want:
                        at, low, high = w["at"], z.reach - w["right"], w["left"]
                        for e, end in zip(edges[:-1], edges[1:], strict=True):
                            lo, hi = max(low, e) - e, min(high, end - 1) - e
                            if lo <= hi:
                                to = at + z.length - end + 1
                                rows.append((w["h"], w["c"], digest(raw[at - e : to], e), z.length, e, end - e, lo, hi, raw[at - e - hi : at - e], raw[to : at + z.length - e - lo]))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in RANGE.split(", ")])

    return texts.mapInPandas(run, RANGE)


def repeated(groups: np.ndarray, width: np.ndarray, lo: np.ndarray, hi: np.ndarray, before: list[bytes], behind: list[bytes]) -> list[np.ndarray]:
    """For each range, how far before the middle its repeated strings begin, ascending. Ranges of one group have one middle and one width.

    A range is written as its bytes before the middle, the group's letter and the bytes behind. A string is as many letters as the
    range is wide, and takes in the group's letter. So strings that agree are of one group and begin equally far before the middle,
    and no two of one range do."""
    own = [a + b"\0" + b + b"\0" for a, b in zip(before, behind, strict=True)]
    lengths = np.array([len(x) for x in own])
    starts = np.cumsum(lengths) - lengths
    t = np.frombuffer(b"".join(own), np.uint8).astype(np.int64) + 2
    t[starts + lengths - 1] = 1
    t[starts + hi] = 258 + groups
    sa = suffix_array(t)
    of = np.repeat(np.arange(len(own)), lengths)
    place = np.arange(len(t)) - starts[of]
    sa = sa[place[sa] <= (hi - lo)[of[sa]]]  # where strings start
    a, b = sa[:-1], sa[1:]
    ahead = hi[of[sa]] - place[sa]  # letters before the group's
    pair = np.flatnonzero((groups[of[a]] == groups[of[b]]) & (ahead[:-1] == ahead[1:]))
    wide = width[of[a[pair]]]
    for k in range(int(wide.max()) if len(pair) else 0):  # compare adjacent prefixes, letter by letter
        same = (k >= wide) | (t[np.minimum(a[pair] + k, len(t) - 1)] == t[np.minimum(b[pair] + k, len(t) - 1)])
        pair, wide = pair[same], wide[same]
    hit = np.zeros(len(sa), bool)
    hit[pair] = hit[pair + 1] = True
    at, far = of[sa[hit]], ahead[hit]
    order = np.lexsort((far, at))
    return np.split(far[order], np.searchsorted(at[order], np.arange(1, len(own))))


def solved(b: pd.DataFrame) -> pd.DataFrame:
    """The removed spans, counted from the anchor, of ranges (RANGE) that come group by group. Equal ranges are sorted as one and a copy, as two
    of a kind suffice."""
    new = (b["h"].to_numpy()[1:] != b["h"].to_numpy()[:-1]) | (b["k"].to_numpy()[1:] != b["k"].to_numpy()[:-1])
    group = np.concatenate([[0], np.cumsum(new)])
    seen: dict[tuple, int] = {}
    kind = np.array([seen.setdefault(x, len(seen)) for x in zip(group.tolist(), b["lo"], b["hi"], b["before"], b["behind"], strict=True)])
    once, first, n = np.unique(kind, return_index=True, return_counts=True)
    d = b.iloc[first]
    found = repeated(group[first], *(d[c].to_numpy() for c in ("width", "lo", "hi")), list(d["before"]), list(d["behind"]))
    spans = []
    for f, many, lo, hi, base, size in zip(found, n.tolist(), d["lo"], d["hi"], d["base"], d["size"], strict=True):
        far = np.arange(lo, hi + 1) if many > 1 else f
        spans.append(merged(-(base + far), size - base - far))
    out = [(h, c, s, e) for h, c, k in zip(b["h"], b["c"], kind.tolist(), strict=True) for s, e in spans[k]]
    return pd.DataFrame(out, columns=["h", "c", "start", "end"])


def sorted_bundles(rows: DataFrame) -> DataFrame:
    """h, c, start, end: removed spans, counted from the anchor. rows: RANGE; those of one name are few enough for one task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: pd.DataFrame | None = None
        for b in batches:
            b = b if rest is None else pd.concat([rest, b], ignore_index=True)
            size = np.cumsum(b["before"].str.len().to_numpy() + b["behind"].str.len().to_numpy() + 2)
            h, k = b["h"].to_numpy(), b["k"].to_numpy()
            start = 0
            for cut in np.flatnonzero((h[1:] != h[:-1]) | (k[1:] != k[:-1])) + 1:
                if size[cut - 1] - (size[start - 1] if start else 0) >= BUNDLE:
                    yield solved(b.iloc[start:cut])
                    start = cut
            rest = b.iloc[start:]
        if rest is not None and len(rest):
            yield solved(rest)

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "h", "k").sortWithinPartitions("h", "k").mapInPandas(run, MARK)


def narrowed(rows: DataFrame, most: int) -> tuple[list[DataFrame], list[DataFrame], list[DataFrame]]:
    """Tables of ranges whose names are shared by 2 to `most`, and of spans found on the way; and the tables that these read. Ranges of more
    frequent names are halved: the bytes that all strings of a half share join the middle, and its name."""
    small, marks, read = [], [], [rows]
    while True:
        names = written(rows.groupBy("h", "k").agg(F.count("*").alias("all")).filter("all > 1"), "names")
        small.append(rows.join(names.filter(F.col("all") <= most).select("h", "k"), ["h", "k"], "left_semi"))
        often = names.filter(F.col("all") > most).select("h", "k")
        read.append(names)
        if often.isEmpty():
            return small, marks, read
        large = written(rows.join(often, ["h", "k"], "left_semi"), "ranges")
        start = -(F.col("base") + F.col("lo"))
        marks.append(large.filter("width = 1").select("h", "c", start.alias("start"), (start + F.col("size")).alias("end")))  # a string each, and all alike
        half = F.floor(F.col("width") / 2).cast("int")

        def part(low: bool, half=half):  # places 0..half-1 before the middle, or the others
            end = half if low else F.col("width")
            begin = F.lit(0) if low else half
            lo, hi = F.greatest("lo", begin) - begin, F.least("hi", end - 1) - begin
            # strings share `begin` bytes before the old middle, and width - end behind it
            near, far = F.lit(begin), F.col("width") - end
            n, m = F.length("before"), F.length("behind")
            new = F.xxhash64("k", F.lit(low), F.substring(F.col("before"), n - near + 1, near), F.substring(F.col("behind"), F.lit(1), far))
            before = F.substring(F.col("before"), n - near - hi + 1, hi)
            behind = F.substring(F.col("behind"), far + 1, F.least(m - far, end - begin - 1 - lo))
            return F.when(hi >= lo, F.struct("h", "c", new.alias("k"), "size", (F.col("base") + begin).alias("base"), (end - begin).alias("width"), lo.alias("lo"), hi.alias("hi"), before.alias("before"), behind.alias("behind")))

        parts = large.filter("width > 1").select(F.explode(F.array(part(True), part(False))).alias("r")).filter("r is not null").select("r.*")
        rows = written(parts, "ranges")
        read += [large, rows]


def marked(docs: DataFrame, most: int | None = None) -> DataFrame:
    """x, y, spans (of size, start, end): the repeated strings of each text that has any, of both sizes. docs: x, y, row, text; x and y name the text, row tells
    its copies apart: the one of least row is read for all, and copies do not meet.

    Each step's result is written, and the tables and shuffles that no later step reads go at once, so that the disk holds about one step."""
    with passing() as own:
        spans = _marked(docs, most or MOST)
        own.keep(spans)
    return spans


def _marked(docs: DataFrame, most: int) -> DataFrame:
    spark, text = docs.sparkSession, ["x", "y"]
    found = written(all_anchors(docs), "anchors")
    kinds = written(found.groupBy("h", "c").agg(F.sum("n").alias("n"), F.min(F.struct(*text, "at")).alias("one"), *[F.min(c).alias(c) for c in ("size", "left", "right")]), "contexts")
    unlike = kinds.groupBy("h").agg(F.count("*").alias("kinds")).filter("kinds > 1").select("h")
    asked = kinds.join(unlike, "h", "left_semi").select("one.x", "one.y", F.struct("size", "h", "c", "one.at", "left", "right").alias("a"))
    least = docs.groupBy(*text).agg(F.min("row").alias("row"))
    asked = written(asked.groupBy(*text).agg(F.collect_list("a").alias("asked")).join(least, text), "asked")  # a text's own anchors
    whole = written(kinds.filter("n > 1").select("h", "c", (-F.col("left")).alias("start"), (F.when(F.col("size") == WORDS.length, WORDS.anchor).otherwise(BYTES.anchor) + F.col("right")).alias("end")), "marks")
    dropped(kinds)
    rows = written(ranges(docs.join(asked, [*text, "row"]).dropDuplicates([*text, "row"])), "ranges")
    dropped(asked)
    small, marks, read = narrowed(rows, most)
    few = small[0]
    for more in small[1:]:
        few = few.unionByName(more)
    every = whole
    for more in [sorted_bundles(few), *marks]:
        every = every.unionByName(more)
    every = written(every, "marks")
    dropped(whole, *read)
    own = found.select(*text, "size", "at", "h", "c").join(every, ["h", "c"]).select(*text, "size", (F.col("at") + F.col("start")).alias("start"), (F.col("at") + F.col("end")).alias("end"))
    pairs = F.transform(F.sequence(F.lit(0), F.size("self") - 2, F.lit(2)), lambda k: F.struct(F.get("self", k).alias("start"), F.get("self", k + 1).alias("end")))
    selves = found.filter("self is not null").select(*text, "size", F.inline(pairs))
    spans = written(own.unionByName(selves).groupBy(*text).agg(F.collect_set(F.struct("size", "start", "end")).alias("spans")), "spans")
    dropped(found, every)
    return spans


def cleaned(docs: DataFrame, most: int | None = None) -> DataFrame:
    """doc_id, n_bytes, spans (removed, in bytes), kept (the remaining bytes), passage_words for each row of docs. passage_words: how many words lie in
    passages of PASSAGE words that also start elsewhere.

    Null texts count as empty. Equal texts of LENGTH bytes or more go wholly. Texts that are shorter have nothing to
    remove. A null doc_id is an id like any other. An empty table gives an empty table. What goes depends on texts alone, so that rows
    of equal texts, of one doc_id or not, get equal results. Long texts are taken in overlapping pieces, and of the many equal
    contexts of a text of one letter, one travels.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    own = own.withColumn("x", F.xxhash64("text")).withColumn("y", F.xxhash64(F.lit(1), "text"))
    both = own.join(marked(own.select("x", "y", F.xxhash64("doc_id").alias("row"), "text"), most), ["x", "y"], "left").select("doc_id", "text", "spans")

    def joined(found: np.ndarray | None, z: Size) -> list[tuple[int, int]]:
        found = [] if found is None else [s for s in found if s["size"] == z.length]
        return merged(np.array([s["start"] for s in found], np.int64), np.array([s["end"] for s in found], np.int64))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            n, spans, kept, passages = [], [], [], []
            for text, found in zip(b["text"], b["spans"], strict=True):
                raw, one = text.encode(), joined(found, BYTES)
                cuts = [0, *(x for s in one for x in s), len(raw)]
                n.append(len(raw))
                spans.append([{"start": s, "end": e} for s, e in one])
                kept.append(b"".join(raw[s:e] for s, e in zip(cuts[::2], cuts[1::2], strict=True)))
                passages.append(sum(e // 4 - -(-s // 4) for s, e in joined(found, WORDS)))
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "n_bytes": n, "spans": spans, "kept": kept, "passage_words": passages})

    return both.mapInPandas(run, "doc_id long, n_bytes long, spans array<struct<start:int,end:int>>, kept binary, passage_words long")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, passage_words."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return cleaned(docs).select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), "passage_words")
