"""Operator 3: document fingerprints by one-permutation MinHash.

Every shingle is hashed once; the hash's upper bits choose its bin, and a bin keeps its least hash. Empty bins copy a bin that is
not empty, found by a sequence of hashes of the bin's own number (optimal densification); past a few tries, by the least hash of
the pair of bins, which is the same draw without repetition. Each bin keeps low bits of its value, hashed. As those agree
by chance once in 2^bits, likeness is corrected for that. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamarack.llm.common import let, words

#: 2^BIN_BITS bins with 4 bits, one hexadecimal digit, each.
BIN_BITS, DIGIT, WIDTH, TRIES = 8, 4, 5, 8
BINS = 1 << BIN_BITS
#: Rows of a range of doc_id; bounds of ranges.
ROWS, QUANTILES = 20_000, 4096


def shingle_hashes(w: Column, width: int = WIDTH) -> Column:
    """Hashes of all runs of width words; of the whole sequence where it is shorter, and of nothing where there is none."""
    parts = lambda i: [x for k in range(width) for x in (F.get(w, i + k), F.lit(" "))]
    return F.when(F.size(w) < width, F.array(F.xxhash64(F.array_join(w, " ")))).otherwise(F.transform(F.slice(w, width, 1 << 30), lambda _, i: F.xxhash64(*parts(i))))


def digits(text: Column) -> Column:
    """The fingerprint: a hexadecimal digit for each bin."""
    bin_of = lambda h: F.shiftright(h, 64 - BIN_BITS) + BINS // 2  # noqa: E731  signed, so that bins follow the order of hashes

    def least(h: Column) -> Column:  # sorted: a bin's least hash is the first of its run
        return F.filter(h, lambda x, k: (k == 0) | (bin_of(x) != bin_of(F.get(h, k - 1))))

    def spread(m: Column) -> Column:  # nulls for the empty bins
        gap = lambda n: F.array_repeat(F.lit(None).cast("long"), n.cast("int"))
        before = F.transform(m, lambda x, k: F.concat(gap(bin_of(x) - F.coalesce(bin_of(F.get(m, k - 1)), F.lit(-1)) - 1), F.array(x)))
        return F.concat(F.flatten(before), gap(BINS - 1 - bin_of(F.element_at(m, -1))))

    def dense(m: Column) -> Column:
        def filled(v: Column) -> Column:
            tries = lambda i: [F.get(v, F.pmod(F.xxhash64(i, F.lit(a)), F.lit(BINS)).cast("int")) for a in range(TRIES)]
            last = lambda i: F.array_min(F.transform(m, lambda x: F.struct(F.xxhash64(i, bin_of(x)).alias("rank"), x.alias("x"))))["x"]
            return F.transform(v, lambda x, i: F.coalesce(x, *tries(i), last(i)))
        return F.when(F.size(m) == BINS, m).otherwise(let(spread(m), filled))

    hashes = lambda w: F.sort_array(shingle_hashes(w))
    bins = let(words(text), lambda w: let(hashes(w), lambda h: let(least(h), dense)))
    # the bin's number is hashed in, else bins that copy one value would agree by chance all at once
    return F.lower(F.array_join(F.transform(bins, lambda x, i: F.hex(F.xxhash64(x, i).bitwiseAND((1 << DIGIT) - 1))), ""))


def likeness(a: Column, b: Column) -> Column:
    """The estimated share of common shingles, from two fingerprints: 0 to 1."""
    chance = 1 / (1 << DIGIT)
    same = F.aggregate(F.arrays_zip(F.split(a, "").alias("a"), F.split(b, "").alias("b")), F.lit(0), lambda n, x: n + (x["a"] == x["b"]).cast("int"))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (same / F.lit(float(BINS)) - chance) / (1 - chance)))


def at_or_below(table: Column, size: int, value: Column) -> Column:
    """How many entries of the ascending array are at or below value, by bisection; 0 for null. size: a power of two, less 1."""
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(size.bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda lo, s: F.when(F.get(table, lo + s - 1) <= value, lo + s).otherwise(lo))


def cut_points(docs: DataFrame, rows: int) -> tuple[list[int], int]:
    """Bounds of ranges of doc_id, the least id first and one above the greatest last, and into how many equal parts to cut each range, so that a
    part has about `rows` rows. Bounds are quantiles, QUANTILES at most, and for an id that several of them hit, the next id too, so that a
    frequent id has a range of its own."""
    n, low, high = docs.agg(F.count("*"), F.min("doc_id"), F.max("doc_id")).first()
    n = max(1, n // rows)
    if low is None:
        return [0, 1], 1
    few = min(n, QUANTILES)
    found = [int(x) for x in docs.stat.approxQuantile("doc_id", [k / few for k in range(1, few)], 1 / (8 * few))] if few > 1 else []
    often = {x for x, y in zip(found, found[1:], strict=False) if x == y}
    return sorted({low, high + 1, *(x for y in found for x in (y, y + 1)[: 1 + (y in often)] if low < x <= high)}), -(-n // few)


def neighbours(docs: DataFrame, rows: int = ROWS) -> DataFrame:
    """doc_id, text, fingerprint, next_text and next_fingerprint, those of the next row by descending doc_id; null ids last, equal ones by descending
    text; after the last, the first. docs: doc_id, text.

    Rows are lined up within ranges of doc_id, of about `rows` rows each, and of the text's first two bytes where a range is of one id, null or
    frequent. Each range also gets, as a last row, the first row of the range after it. So ranges grow in number
    with the input, not in size, and a text is shuffled once.
    """
    bounds, parts = cut_points(docs, rows)
    size = (1 << len(bounds).bit_length()) - 1
    table = F.split(F.lit(",".join(map(str, bounds + [(1 << 63) - 1] * (size - len(bounds))))), ",").cast("array<bigint>")

    def placed(at: Column) -> Column:
        low, high = F.get(table, at - 1), F.get(table, at)
        far = lambda x: x.cast("double") - low.cast("double")
        part = F.least(F.lit(parts - 1), F.floor(far(F.col("doc_id")) * parts / far(high)).cast("int"))
        start = F.conv(F.rpad(F.hex(F.substring(F.col("text").cast("binary"), 1, 2)), 4, "0"), 16, 10).cast("int")
        alone = F.col("doc_id").isNull() | (high == low + 1)
        return (F.when(F.col("doc_id").isNull(), -1).otherwise(at * parts + part)).cast("long") * (1 << 16) + F.when(alone, start).otherwise(0)

    dealt = docs.withColumn("range_", let(F.least(at_or_below(table, size, F.col("doc_id")), F.lit(len(bounds) - 1)), placed)).withColumn("last_", F.lit(0))
    firsts = dealt.groupBy("range_").agg(F.max(F.struct("doc_id", "text")).alias("row"))
    order = Window.orderBy("range_")  # a row for each range
    upper = F.coalesce(F.lead("range_").over(order), F.min("range_").over(Window.partitionBy()))
    ends = firsts.select(upper.alias("range_"), "row.*", F.lit(1).alias("last_"))
    line = Window.partitionBy("range_").orderBy("last_", F.col("doc_id").desc_nulls_last(), F.col("text").desc())
    # each text's fingerprint is made before it is dealt, once, and once more for a range's first row
    both = dealt.withColumn("fingerprint", digits(F.col("text"))).unionByName(ends.withColumn("fingerprint", digits(F.col("text"))))
    return both.select("*", *[F.lead(c).over(line).alias(f"next_{c}") for c in ("text", "fingerprint")]).filter("last_ = 0").drop("range_", "last_")


def report(docs: DataFrame, rows: int = ROWS) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for each row of docs.

    The edited text has its last floor(n_chars / 2) code points replaced by as many first ones of the next document's text, or by all
    where it has fewer. Null texts count as empty. Empty texts have the fingerprint of the empty sequence, alike to each
    other only. A table of one row is its own next; an empty one gives an empty one. Repeated rows follow each other.
    """
    own = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    placed = neighbours(own, rows)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = placed.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half)))
    got = edited.select(
        "doc_id", n.cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        "fingerprint", digits(F.col("edited")).alias("edited_fingerprint"), "next_fingerprint",
    )
    return got.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"))
