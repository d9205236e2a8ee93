"""Operator 10: quality rules, and a hashed n-gram log-likelihood ratio between a trusted target and the raw corpus.

Words and word pairs are hashed into a fixed number of buckets. Their counts in the trusted documents and in all documents make
two smoothed multinomials; a document's score is the mean, over its n-grams, of the log ratio of its bucket. Every document
at or above one threshold passes: nothing is drawn at random. DataFrame functions only; the ratios (a fixed number of them)
reach the expressions as one array literal.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarack.llm.common import let, words

BUCKETS, SMOOTHING, THRESHOLD = 1 << 14, 1.0, -0.15
SYMBOLS, BLANKS = "#*$%&|<>", " \t\n\x0b\x0c\r"


def grams(w: Column, buckets: int) -> Column:
    """The buckets of an array's words and of its pairs of neighbours."""
    one = F.transform(w, lambda x: F.pmod(F.xxhash64(x), F.lit(buckets)).cast("int"))
    two = F.transform(F.slice(w, 2, 1 << 30), lambda x, i: F.pmod(F.xxhash64(F.get(w, i), x), F.lit(buckets)).cast("int"))
    return F.concat(one, two)


def counted(docs: DataFrame, trusted: DataFrame, buckets: int) -> DataFrame:
    """bucket, t, n: n-grams of the trusted documents and of all, by bucket. trusted: doc_id of the documents to resemble.

    Both cover every document. Only the target's side meets the trusted ids, by a merge join at any size; the raw counts need no join.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ids = trusted.select(F.col("doc_id").cast("long").alias("doc_id")).dropna().distinct()

    def found(rows: DataFrame, t: int, n: int) -> DataFrame:
        bucket = F.explode(let(words(F.col("text")), lambda w: grams(w, buckets))).alias("bucket")
        return rows.select(bucket).groupBy("bucket").count().select("bucket", (F.col("count") * t).alias("t"), (F.col("count") * n).alias("n"))

    both = found(docs.join(ids.hint("merge"), "doc_id", "left_semi"), 1, 0).unionByName(found(docs, 0, 1))
    return both.groupBy("bucket").agg(F.sum("t").alias("t"), F.sum("n").alias("n"))


def ratios(counts: DataFrame, buckets: int, smoothing: float) -> Column:
    """An array of log(p_target / p_raw) by bucket. Its size is the number of buckets at any size of the corpus."""
    t, n = [0] * buckets, [0] * buckets
    for bucket, x, y in counts.collect():  # no more rows than buckets
        t[bucket], n[bucket] = x, y
    log = lambda x, total: math.log((x + smoothing) / (total + smoothing * buckets))
    values = (log(x, sum_t) - log(y, sum_n) for sum_t, sum_n in [(sum(t), sum(n))] for x, y in zip(t, n, strict=True))
    return F.split(F.lit(",".join(f"{v:.5f}" for v in values)), ",").cast("array<double>")


def repeat_words(w: Column) -> Column:
    """Words inside a 3-word window that the text has twice or more. Sorted, equal window hashes are neighbours; each repeat
    covers three words, less those that the next repeat covers too. Where many windows repeat, they are sorted once more with
    their places, as looking each up among many would take their product."""
    same = lambda v, k, x: F.coalesce(F.get(v, k) == x, F.lit(False))
    twin = lambda v, k, x: F.coalesce(F.get(v, k)["h"] == x["h"], F.lit(False))
    none = F.struct(F.lit(0).alias("n"), F.lit(-3).alias("at"))

    def few(h: Column, again: Column) -> Column:
        return F.filter(F.transform(h, lambda x, i: F.when(F.array_contains(again, x), i)), lambda i: i.isNotNull())

    def many(h: Column) -> Column:
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return let(placed, lambda v: F.sort_array(F.transform(F.filter(v, lambda x, k: twin(v, k - 1, x) | twin(v, k + 1, x)), lambda x: x["i"])))

    def covered(places: Column) -> Column:
        return F.aggregate(places, none, lambda a, i: F.struct((a["n"] + F.least(F.lit(3), i - a["at"])).alias("n"), i.alias("at")), lambda a: a["n"].cast("long"))

    def counted_in(h: Column) -> Column:
        again = let(F.sort_array(h), lambda v: F.array_distinct(F.filter(v, lambda x, k: same(v, k - 1, x))))
        return let(again, lambda r: F.when(F.size(r) == 0, F.lit(0).cast("long")).when(F.size(r) <= 40, covered(few(h, r))).otherwise(covered(many(h))))

    hashes = F.transform(F.slice(w, 3, 1 << 30), lambda x, i: F.xxhash64(F.get(w, i), F.lit(" "), F.get(w, i + 1), F.lit(" "), x))
    return let(hashes, counted_in)


def dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, BLANKS, "")) > 0)
    return let(lines, lambda v: (F.size(v) - F.size(F.array_distinct(v))).cast("long"))


def judged(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, smoothing: float = SMOOTHING, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, score for each row of docs.

    Null and empty texts have no words, fail the base rules and have a null score. Rows of trusted with a null id or
    without a document count for nothing; with no trusted rows all ratios compare with an even distribution. Repeated rows
    are each judged, and each counted in the corpus. An empty table gives an empty table.
    """
    ratio = ratios(counted(docs, trusted, buckets), buckets, smoothing)
    text = F.coalesce(F.col("text"), F.lit(""))
    def found(w: Column) -> Column:
        total = F.aggregate(grams(w, buckets), F.lit(0.0), lambda a, b: a + F.get(ratio, b))
        return F.struct(F.size(w).cast("long").alias("n_words"), repeat_words(w).alias("n_repeat_words"), total.alias("sum"))


    out = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), let(words(text), found).alias("w"),
        F.length(F.translate(text, BLANKS, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"), dup_lines(text).alias("n_dup_lines"),
    )
    out = out.select("*", "w.n_words", "w.n_repeat_words", F.expr("w.sum / nullif(2 * w.n_words - 1, if(w.n_words = 0, -1, 0))").alias("score"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        (~failed & F.coalesce(F.col("score") >= threshold, F.lit(False))).alias("kept"), "score",
    )
