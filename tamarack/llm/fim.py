"""Operator 11: fill-in-middle transformation over ropes.

A rope is a tree of pieces of a text. Leaves hold a piece and how many units (runs of letters, or single other characters) and code points it has; inner
nodes hold the sums of these. Leaves end where units end, so that counts add up. A text is cut by splitting its tree at two ranks of
units; the three trees are put together in another order, with sentinels as leaves between them. The transformed text is undone by splitting its
tree where the sentinels stand and joining what lies between them in the old order. Splitting touches one path of the tree, whatever the text's length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]")
#: Code points of a leaf, unless a unit is longer.
LEAF = 512
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Shares in percent: texts that are transformed, and those of them that put the suffix first.
RATE, SPM = 90, 20


@dataclass(slots=True)
class Rope:
    """A leaf has text and no sides; an inner node has sides and no text. depth: of the deepest leaf."""

    units: int
    chars: int
    depth: int
    text: str | None = None
    left: Rope | None = None
    right: Rope | None = None

    def __str__(self) -> str:
        out, todo = [], [self]
        while todo:
            node = todo.pop()
            if node.text is not None:
                out.append(node.text)
            else:
                todo += (node.right, node.left)
        return "".join(out)


EMPTY = Rope(0, 0, 0, "")


def leaf(text: str) -> Rope:
    return Rope(len(UNIT.findall(text)), len(text), 0, text) if text else EMPTY


SENTINELS = tuple(map(leaf, (PREFIX, SUFFIX, MIDDLE)))


def joined(a: Rope, b: Rope) -> Rope:
    """One rope of two. Of unlike depths, the shallow one is put on the side of the deep one, so that depth stays near the logarithm."""
    if not a.chars or not b.chars:
        return b if not a.chars else a
    if a.depth > b.depth + 1:
        return _node(a.left, joined(a.right, b))
    if b.depth > a.depth + 1:
        return _node(joined(a, b.left), b.right)
    return _node(a, b)


def _node(a: Rope, b: Rope) -> Rope:
    return Rope(a.units + b.units, a.chars + b.chars, max(a.depth, b.depth) + 1, None, a, b)


def unit_starts(text: str) -> np.ndarray:
    """Where units begin, in code points."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32) | np.uint32(32)
    letter = (c >= ord("a")) & (c <= ord("z"))
    return np.flatnonzero(np.append(True, ~(letter[1:] & letter[:-1])))


def rope(text: str, size: int = LEAF) -> Rope:
    """A balanced rope of a text. Leaves end where a unit ends."""
    if not text:
        return EMPTY
    starts = unit_starts(text)
    first = np.unique(np.searchsorted(starts, np.arange(0, len(text), size)))  # units that begin a leaf
    first = np.append(first[first < len(starts)], len(starts))
    at = np.append(starts, len(text))[first].tolist()
    units = np.diff(first).tolist()
    level = [Rope(n, e - s, 0, text[s:e]) for n, s, e in zip(units, at[:-1], at[1:], strict=True)]
    while len(level) > 1:
        level = [_node(*level[k : k + 2]) if k + 1 < len(level) else level[k] for k in range(0, len(level), 2)]
    return level[0]


def split_units(r: Rope, rank: int) -> tuple[Rope, Rope]:
    """The first `rank` units, and the rest."""
    if rank <= 0:
        return EMPTY, r
    if rank >= r.units:
        return r, EMPTY
    if r.text is not None:
        at = 0
        for k, m in enumerate(UNIT.finditer(r.text)):
            if k == rank:
                at = m.start()
                break
        return Rope(rank, at, 0, r.text[:at]), Rope(r.units - rank, r.chars - at, 0, r.text[at:])
    if rank < r.left.units:
        a, b = split_units(r.left, rank)
        return a, joined(b, r.right)
    a, b = split_units(r.right, rank - r.left.units)
    return joined(r.left, a), b


def split_chars(r: Rope, rank: int) -> tuple[Rope, Rope]:
    """The first `rank` code points, and the rest."""
    if rank <= 0:
        return EMPTY, r
    if rank >= r.chars:
        return r, EMPTY
    if r.text is not None:
        a, cut = leaf(r.text[:rank]), UNIT.match(r.text, rank - 1).end() > rank
        return a, Rope(r.units - a.units + cut, r.chars - rank, 0, r.text[rank:])
    if rank < r.left.chars:
        a, b = split_chars(r.left, rank)
        return a, joined(b, r.right)
    a, b = split_chars(r.right, rank - r.left.chars)
    return joined(r.left, a), b


def arranged(r: Rope, first: int, second: int, form: str) -> tuple[Rope, int, int]:
    """The rope with its middle, from unit `first` to unit `second`, last; and the code points of prefix and middle."""
    head, suffix = split_units(r, second)
    prefix, middle = split_units(head, first)
    p, s, m = SENTINELS
    parts = (p, prefix, s, suffix, m, middle) if form == "psm" else (s, suffix, p, prefix, m, middle)
    out = EMPTY
    for part in parts:
        out = joined(out, part)
    return out, prefix.chars, middle.chars


def undone(text: str, form: str) -> str:
    """The text that was transformed into this one. No sentinel stands in a transformed text but those put there: one that began in a neighbour would
    end in "<" or hold a second "<"."""
    if form not in ("psm", "spm"):
        return text
    one, two = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    cuts = [text.index(one), text.index(two), text.index(MIDDLE)]
    rest, parts = rope(text), []
    for at in reversed(cuts):
        rest, tail = split_chars(rest, at)
        parts.append(split_chars(tail, len(one))[1])
    middle, second, first = parts
    prefix, suffix = (first, second) if form == "psm" else (second, first)
    return str(joined(joined(prefix, middle), suffix))


def draws(doc_id: Column, seed: int = 1) -> list[Column]:
    """Four numbers of 32 bits, from the seed and the id; a null id is written as nothing."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("long").cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def transformed(docs: DataFrame, rate: int = RATE, spm: int = SPM, seed: int = 1) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output for each row of docs.

    Forms: plain (the text itself), psm (prefix, suffix, middle) and spm (suffix, prefix, middle). Null texts count as empty. Empty texts and
    those that hold a sentinel stay plain, as does all but `rate` percent. Both cuts are drawn from the id alone, so that reruns, and rows of one id and text,
    agree; rows of null id draw alike. An empty table gives an empty one. Other columns are not read.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for text, *h in b[["text", "h0", "h1", "h2", "h3"]].itertuples(index=False, name=None):
                r = rope(text)
                if not text or any(x in text for x in (PREFIX, SUFFIX, MIDDLE)) or h[2] % 100 >= rate:
                    out.append((r.units, "plain", None, None, text))
                    continue
                form = "spm" if h[3] % 100 < spm else "psm"
                first, second = sorted(x % (r.units + 1) for x in h[:2])
                moved, prefix, middle = arranged(r, first, second, form)
                out.append((r.units, form, prefix, middle, str(moved)))
            got = pd.DataFrame(out, columns=["n", "form", "prefix_chars", "middle_chars", "output"])
            got.insert(0, "doc_id", b["doc_id"].to_numpy())
            yield got.astype({"n": "int64", "prefix_chars": "Int64", "middle_chars": "Int64"})

    # as text: pandas would make floats of ids where some are null
    rows = docs.select(F.col("doc_id").cast("long").cast("string"), F.coalesce("text", F.lit("")).alias("text"), *[h.alias(f"h{k}") for k, h in enumerate(draws(F.col("doc_id"), seed))])
    return rows.mapInPandas(run, "doc_id string, n long, form string, prefix_chars long, middle_chars long, output string").withColumn("doc_id", F.col("doc_id").cast("long"))


def restored(rows: DataFrame) -> DataFrame:
    """rows with text, rebuilt from output and form alone. A null output counts as empty; an unknown or null form as plain."""
    names = [f.name for f in rows.schema if f.name != "text"]

    @F.pandas_udf("string")
    def back(output: pd.Series, form: pd.Series) -> pd.Series:
        return pd.Series([undone(o or "", f) for o, f in zip(output, form, strict=True)], dtype=object)

    return rows.select(*[f"`{n}`" for n in names], back("output", "form").alias("text"))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256."""
    return restored(transformed(docs)).select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("text", 256).alias("restored_sha256"))


ORACLE = r"""
with cut as (
    select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') as units, sha256('1:' || coalesce(cast(doc_id as varchar), '')) as digest from documents
), drawn as (
    select *, len(units) as n, [cast('0x' || substr(digest, 8 * k + 1, 8) as ubigint) for k in range(4)] as h from cut
), ranked as (
    select *, least(h[1] % (n + 1), h[2] % (n + 1)) as one, greatest(h[1] % (n + 1), h[2] % (n + 1)) as two,
        case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h[3] % 100 >= 90 then 'plain' when h[4] % 100 < 20 then 'spm' else 'psm' end as form from drawn
), parts as (
    select *, array_to_string(units[1:one], '') as prefix, array_to_string(units[one + 1:two], '') as middle, array_to_string(units[two + 1:], '') as suffix from ranked
)
select doc_id, n, form, case when form <> 'plain' then length(prefix) end as prefix_chars, case when form <> 'plain' then length(middle) end as middle_chars,
    sha256(case form when 'plain' then text when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256,
    sha256(text) as restored_sha256
from parts
"""
