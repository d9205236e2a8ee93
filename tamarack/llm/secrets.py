"""Operator 2: secret scans. Fixed patterns, and a sliding-window Shannon entropy over candidate strings.

A candidate is a long run of key characters. A window slides over it; as a character enters or leaves,
its count changes by one and the sum of c*log2(c) by a difference of two table values, from which the window's entropy follows. The
best window is held against the threshold of the candidate's character class: digits, hexadecimal digits, letters, or all. Runs on the allow-list (numbered names,
paths, dates, UUIDs, placeholders, counting sequences) are left alone. DataFrame functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarack.llm.common import let

#: Kind, pattern, the group whose length counts, and its least length.
BASE = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
)
WINDOW = 20
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{%d,}" % WINDOW
#: Class, pattern of the whole candidate, least entropy in bits a character. The first that fits counts. A window's entropy is below log2(20) = 4.32,
#: of digits below 3.32, of hexadecimal ones of one case below 3.93.
CLASSES = (("digits", r"^[0-9]+$", 3.25), ("hex", r"^([0-9a-f]+|[0-9A-F]+)$", 3.0), ("letters", r"^([a-z]+|[A-Z]?[a-z]+|[A-Z]+)$", 4.05), ("base64", r"^[A-Za-z0-9+/_=-]+$", 3.6))
ALLOWED = (
    r"^([A-Za-z]+|[0-9]{1,4})([_/=+-]+([A-Za-z]+|[0-9]{1,4})?)+$",
    r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",
    r"(?i)example|placeholder|changeme|x{6,}|abcdefgh|01234567|12345678",
)
SPAN = "array<struct<start:int,kind_no:int,kind:string,end:int>>"


def spans(text: Column, pattern: str, number: int, kind: str, keep) -> Column:
    """Leftmost non-overlapping matches that pass keep(match number, matches), with places in code points. Places come from
    the lengths of what lies between the matches."""
    none = F.array().cast(SPAN)

    def places(found: Column) -> Column:
        first = F.struct(F.lit(0).alias("at"), none.alias("out"))

        def step(a: Column, gap: Column, i: Column) -> Column:
            start = a["at"] + F.length(gap["g"])
            end = start + F.length(F.get(found, i))
            span = F.array(F.struct(start.alias("start"), F.lit(number).alias("kind_no"), F.lit(kind).alias("kind"), end.alias("end")))
            return F.struct(end.alias("at"), F.when(gap["keep"], F.concat(a["out"], span)).otherwise(a["out"]).alias("out"))

        gaps = F.transform(F.slice(F.split(text, pattern, -1), 1, F.size(found)), lambda g, i: F.struct(g.alias("g"), i.alias("i"), keep(i, found).alias("keep")))
        return F.aggregate(gaps, first, lambda a, g: step(a, g, g["i"]), lambda a: a["out"])

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: F.when(F.size(found) > 0, places(found)).otherwise(none))


def base_spans(text: Column) -> list[Column]:
    out = []
    for number, (kind, pattern, group, least) in enumerate(BASE):
        if group:
            values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
            def long_enough(v: Column, at=(pattern, number, kind), least: int = least) -> Column:
                return spans(text, *at, lambda i, _: F.length(F.get(v, i)) >= least)

            out.append(F.when(text.rlike(pattern), let(values, long_enough)).otherwise(F.array().cast(SPAN)))
        else:  # a match is a whole run or the rest of one, so asking for the least length right away drops the same ones
            longer = pattern[:-1] + "{%d,}" % (least - (4 if kind == "access" else 0))
            out.append(spans(text, longer, number, kind, lambda i, found: F.lit(True)))
    return out


def best_entropy(s: Column, window: int = WINDOW) -> Column:
    """The largest Shannon entropy, in bits, of any window of s; 0 where s is shorter. The state is a count for each letter, and the sum of
    c*log2(c) over them: one count goes down as a letter leaves, one goes up as a letter enters, and the sum moves by two table values."""
    table = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(window + 1)])
    moved = lambda k, by: F.get(table, k + by) - F.get(table, k)

    def scan(codes: Column) -> Column:
        def step(a: Column, i: Column) -> Column:
            enters, leaves = F.get(codes, i), F.coalesce(F.get(codes, i - window), F.lit(-1))
            had = F.coalesce(F.get(a["counts"], leaves), F.lit(0))
            now = F.get(a["counts"], enters) - (enters == leaves).cast("int")
            total = a["sum"] + F.when(leaves >= 0, moved(had, -1)).otherwise(0.0) + moved(now, 1)
            counts = F.transform(a["counts"], lambda n, k: n + (k == enters).cast("int") - (k == leaves).cast("int"))
            entropy = F.when(i >= window - 1, F.lit(math.log2(window)) - total / window).otherwise(0.0)
            return F.struct(counts.alias("counts"), total.alias("sum"), F.greatest(a["best"], entropy).alias("best"))

        start = F.struct(F.array_repeat(F.lit(0), len(LETTERS)).alias("counts"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("best"))
        return F.aggregate(F.sequence(F.lit(0), F.size(codes) - 1), start, step, lambda a: a["best"])

    return F.when(F.length(s) >= window, let(F.transform(F.split(s, ""), lambda c: F.position(c, F.lit(LETTERS)) - 1), scan)).otherwise(0.0)


def entropy_spans(text: Column) -> Column:
    def keep(i: Column, found: Column) -> Column:
        s = F.get(found, i)
        asked = F.lit(None).cast("double")
        for _, pattern, least in reversed(CLASSES):
            asked = F.when(s.rlike(pattern), F.lit(least)).otherwise(asked)
        plain = F.lit(True)
        for allowed in ALLOWED:
            plain = plain & ~s.rlike(allowed)
        return F.when(plain, F.coalesce(best_entropy(s) >= asked, F.lit(False))).otherwise(F.lit(False))

    return F.when(text.rlike(CANDIDATE), spans(text, CANDIDATE, len(BASE), "entropy", keep)).otherwise(F.array().cast(SPAN))


def scanned(docs: DataFrame) -> DataFrame:
    """docs with base (array of base spans by start and kind) and found (base and entropy spans, likewise).

    A null or empty text has none. Both kinds of span stay where they overlap. Columns of docs keep
    their names and values; base and found replace any of that name. Repeated rows are each scanned.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    out = docs.withColumn("base", F.sort_array(F.concat(*base_spans(text)))).withColumn("found", entropy_spans(text))
    return out.withColumn("found", F.when(F.size("found") == 0, F.col("base")).otherwise(F.sort_array(F.concat("base", "found"))))


def listed(of: Column) -> Column:
    return F.array_join(F.transform(of, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_entropy for each row of docs."""
    got = scanned(docs.select(F.col("doc_id").cast("long"), "text"))
    many = lambda col, kind: F.size(F.filter(col, lambda s: s["kind"] == kind)).cast("long")
    return got.select(
        "doc_id", *[many("base", kind).alias(f"n_{kind}") for kind, *_ in BASE], F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        listed(F.col("found")).alias("spans"), many("found", "entropy").alias("n_entropy"),
    )


def redacted(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """docs with every found span replaced by mark, and n_chars, where there is one, set to the new length. Texts without
    spans, nulls included, stay as they are."""
    got = scanned(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text"))

    def step(a: Column, s: Column) -> Column:
        gap = F.substring(F.col("text"), a["at"] + 1, F.greatest(s["start"] - a["at"], F.lit(0)))
        fresh = s["start"] >= a["at"]
        return F.struct(F.when(fresh, F.concat(a["out"], gap, F.lit(mark))).otherwise(a["out"]).alias("out"), F.greatest(a["at"], s["end"]).alias("at"))

    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    new = F.aggregate("found", start, step, lambda a: F.concat(a["out"], F.substring(F.col("text"), a["at"] + 1, F.lit(2**31 - 1) - a["at"])))
    hit = F.size("found") > 0
    out = got.select("row", F.when(hit, new).otherwise(F.col("text")).alias("new"), hit.alias("hit"))
    changed = {"text": F.col("new"), "n_chars": F.when(F.col("hit"), F.length("new").cast("long")).otherwise(F.col("row").getField("n_chars") if "n_chars" in docs.columns else F.lit(0))}
    return out.select(*[(changed[c] if c in changed else F.col("row").getField(c)).alias(c) for c in docs.columns])
