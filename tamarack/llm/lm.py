"""Operator 5: language-model scores by deleted interpolation.

Word pairs, words and an even distribution are mixed: P(w|h) = a*c(h,w)/c(h) + b*c(w)/N + c/(V+1). The weights depend on the
bucket of the context's frequency c(h). They are learnt by expectation-maximisation on a deleted fold of the training documents,
against counts of the other folds; scores then use the counts of all training documents.

Counting: documents are dealt into blocks. A block's distinct words and pairs go, as sorted 64-bit hashes in a few byte strings, to
the owners of hash ranges; an owner adds up and answers each block in its own order, so that answers need no keys. A frequent
word is one number a block, wherever it occurs; nothing is skewed, and what travels is about the distinct pairs of each block.
No block writes more than FAN strings: where there are more ranges, FAN blocks at a time are first added up in nodes of wide
ranges, and nodes ask in their stead; so strings number the blocks times FAN for each such step, of which there are as many as the
number of ranges has digits to base FAN.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarack.llm.common import passing, shuffles_dropped, written

BLOCK_BYTES, RANGE_TOKENS, FOLDS, DELETED = 6 << 20, 1 << 19, 10, 1
#: Estimates are told apart to half an octave: 32 * (2 * 47 + 1)^2 classes, or 9 MB, at the very most for 2^47 tokens.
BUCKETS, STEPS, ROUNDS = 32, 2, 60
FAN = 512
END = np.uint64(0x9E3779B97F4A7C15)
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ\t\n\x0b\x0c\r", "abcdefghijklmnopqrstuvwxyz     ")
ASKED = "part long, team long, block long, kind int, keys binary, kept binary, gone binary"
ANSWER = "block long, part long, kind int, keys binary, counts binary, n_kept long, n_gone long, v_kept long, v_all long"


def packed(x: np.ndarray) -> bytes:
    """Numbers as their lowest bytes, then their next ones, and so on: what compression needs to drop leading zeros."""
    return np.ascontiguousarray(x.astype(np.uint64).view(np.uint8).reshape(-1, 8).T).tobytes()


def unpacked(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(8, -1).T).view(np.uint64).ravel()


class Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 1 << 18:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word.encode(errors="surrogatepass"), 1)
        return h


def tokens(texts: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """The words' hashes of all texts, each text's followed by END; and each text's number of tokens."""
    known, parts, n = Hashes(), [], []
    for t in texts:
        w = [x for x in (t or "").translate(LOWER).split(" ") if x]
        a = np.empty(len(w) + 1, np.uint64)
        a[:-1] = np.fromiter(map(known.__getitem__, w), np.uint64, len(w))
        a[-1] = END
        parts.append(a)
        n.append(len(a))
    return (np.concatenate(parts) if parts else np.empty(0, np.uint64)), np.array(n, np.int64)


def pairs(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The contexts, each token's predecessor (END before a text's first), and hashes of the pairs."""
    before = np.concatenate([[END], t[:-1]]).astype(np.uint64)[: len(t)]
    x = before * np.uint64(0xC2B2AE3D27D4EB4F) + t
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x165667B19E3779F9)
    return before, x ^ x >> np.uint64(32)


def fold(doc_id: Column) -> Column:
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS).cast("int")


def dealt(docs: DataFrame) -> tuple[DataFrame, int]:
    """doc_id, text, fold, block; and how many ranges of hashes to count in."""
    own = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    size = own.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    ranges = 1 << max(0, (size // 6 // RANGE_TOKENS).bit_length())
    return own.withColumn("fold", fold(F.col("doc_id"))).withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks))), ranges


def dealt_out(kind: int, distinct: np.ndarray, kept: np.ndarray, gone: np.ndarray, ranges: int) -> Iterator[tuple]:
    """part, kind, keys, kept, gone: a string for each of the ranges that sorted hashes fall into."""
    part = (distinct >> np.uint64(64 - ranges.bit_length() + 1)).astype(np.int64) if ranges > 1 else np.zeros(len(distinct), np.int64)
    new = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else part
    for start, end in zip(new, np.append(new[1:], len(part)), strict=True):
        s = slice(start, end)
        yield int(part[start]), kind, packed(np.diff(distinct[s], prepend=np.uint64(0))), packed(kept[s]), packed(gone[s])


def asked(dealt_docs: DataFrame, ranges: int, fan: int) -> DataFrame:
    """What each block has: for each range and kind (1 word, 2 pair), sorted hashes, counts in kept and in deleted training rows. team: of
    fan blocks."""

    def run(b: pd.DataFrame) -> pd.DataFrame:
        t, n = tokens(b["text"])
        of, block = np.repeat(b["fold"].to_numpy(), n), int(b["block"].iloc[0])
        rows = []
        for kind, keys in ((1, t), (2, pairs(t)[1])):
            distinct, at = np.unique(keys, return_inverse=True)
            kept, gone = (np.bincount(at, weights=w, minlength=len(distinct)) for w in ((of != 0) & (of != DELETED), of == DELETED))
            rows += [(p, block // fan, block, *x) for p, *x in dealt_out(kind, distinct, kept, gone, ranges)]
        return pd.DataFrame(rows, columns=["part", "team", "block", "kind", "keys", "kept", "gone"])

    return dealt_docs.groupBy("block").applyInPandas(run, ASKED)


def added(own: pd.DataFrame) -> tuple:
    """Of strings of one kind: the distinct hashes, each string's places in them, its counts in deleted rows, its hashes, and the sums
    of kept and deleted counts."""
    keys = [np.cumsum(unpacked(k), dtype=np.uint64) for k in own["keys"]]
    gone = [unpacked(k) for k in own["gone"]]
    distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
    add = lambda x: np.bincount(at, weights=np.concatenate(x), minlength=len(distinct)).astype(np.uint64)
    cuts = np.cumsum([len(k) for k in keys])[:-1]
    return distinct, np.split(at, cuts), gone, keys, add([unpacked(k) for k in own["kept"]]), add(gone)


def answer(block: int, part: int, kind: int, keys: np.ndarray, gone: np.ndarray, counts: np.ndarray, kept: np.ndarray) -> Iterator[tuple]:
    yield block, part, kind, None, packed(counts), *[None] * 4
    if (gone > 0).any():
        yield block, part, kind + 2, packed(keys[gone > 0]), packed(kept[gone > 0]), *[None] * 4


def answer_frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split()[0] for c in ANSWER.split(", ")]).astype({c: "Int64" for c in ("n_kept", "n_gone", "v_kept", "v_all")})


def nodes(questions: DataFrame, width: int, ranges: int, fan: int) -> DataFrame:
    """The questions of nodes, each of a team's strings of one range, in finer ranges."""

    def run(b: pd.DataFrame) -> pd.DataFrame:
        team, part = int(b["team"].iloc[0]), int(b["part"].iloc[0])
        rows = []
        for kind, own in b.groupby("kind"):
            distinct, *_, kept, gone = added(own)
            rows += [(p, team // fan, team * width + part, *x) for p, *x in dealt_out(int(kind), distinct, kept, gone, ranges)]
        return pd.DataFrame(rows, columns=["part", "team", "block", "kind", "keys", "kept", "gone"])

    return questions.groupBy("team", "part").applyInPandas(run, ASKED)


def handed_down(questions: DataFrame, answers: DataFrame, width: int) -> DataFrame:
    """A node's answers (block: the node) to those whose questions it added up."""

    def run(key: tuple, b: pd.DataFrame, a: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for kind, own in b.groupby("kind"):
            _, places, gone, keys, _, _ = added(own)
            counts, known, kept = joined(a, kind, "counts"), joined(a, kind + 2, "keys"), joined(a, kind + 2, "counts")
            for block, part, at, g, k in zip(own["block"], own["part"], places, gone, keys, strict=True):
                own_kept = np.zeros(len(k), np.uint64)
                own_kept[g > 0] = kept[np.searchsorted(known, k[g > 0])]
                rows += answer(block, part, int(kind), k, g, counts[at], own_kept)
        return answer_frame(rows)

    node = questions.withColumn("node", F.col("team") * width + F.col("part"))
    back = node.groupBy("node").cogroup(answers.filter("block >= 0").withColumnRenamed("block", "node").groupBy("node")).applyInPandas(run, ANSWER)
    return back.unionByName(answers.filter("block < 0"))


def counted(questions: DataFrame, width: int, ranges: int, fan: int) -> DataFrame:
    """Answers to questions in `width` ranges, of all that are asked in `ranges`."""
    if width == ranges:
        return written(answered(questions), "lm-answers")
    finer = min(ranges, width * fan)
    questions = written(questions, "lm-asked")
    return written(handed_down(questions, counted(nodes(questions, width, finer, fan), finer, ranges, fan), width), "lm-answers")


def answered(questions: DataFrame) -> DataFrame:
    """To each block, in its own order, the counts over all blocks (kinds 1, 2); for its hashes in deleted rows, with keys, the kept
    counts (kinds 3, 4); and to block -1 each range's sums."""

    def run(b: pd.DataFrame) -> pd.DataFrame:
        part, rows, sums = int(b["part"].iloc[0]), [], [0, 0, 0, 0]
        for kind, own in b.groupby("kind"):
            _, places, gone, keys, all_kept, all_gone = added(own)
            if kind == 1:
                sums = [int(all_kept.sum()), int(all_gone.sum()), int((all_kept > 0).sum()), int((all_kept + all_gone > 0).sum())]
            for block, at, g, k in zip(own["block"], places, gone, keys, strict=True):
                rows += answer(block, part, int(kind), k, g, (all_kept + all_gone)[at], all_kept[at])
        rows.append((-1, part, 0, None, None, *sums))
        return answer_frame(rows)

    return questions.groupBy("part").applyInPandas(run, ANSWER)


def joined(a: pd.DataFrame, kind: int, column: str) -> np.ndarray:
    own = a[a["kind"] == kind].sort_values("part")[column]
    return np.concatenate([unpacked(x) for x in own]) if len(own) else np.empty(0, np.uint64)


def bucket_of(context: np.ndarray) -> np.ndarray:
    """0 for a context never seen, then one for each doubling."""
    return np.where(context > 0, np.minimum(np.floor(np.log2(np.maximum(context, 1))) + 1, BUCKETS - 1), 0).astype(np.int64)


def events(dealt_docs: DataFrame, answers: DataFrame, n: int) -> DataFrame:
    """bucket, pair, word, n: how many tokens of the deleted fold have that context bucket and those maximum-likelihood estimates by the
    kept folds, given as 1 + 8 * -log2, rounded, or 0 for an estimate of 0. There are no more rows than such classes."""

    def run(key: tuple, d: pd.DataFrame, a: pd.DataFrame) -> pd.DataFrame:
        t, _ = tokens(d["text"])
        before, pair = pairs(t)
        words, counts, pair_keys, pair_counts = joined(a, 3, "keys"), joined(a, 3, "counts"), joined(a, 4, "keys"), joined(a, 4, "counts")
        if not len(t):
            return pd.DataFrame(columns=["bucket", "pair", "word", "n"])
        at = lambda keys, x: np.minimum(np.searchsorted(keys, x), len(keys) - 1)  # noqa: E731  every key of these rows is there
        c, h, two = (y[at(k, x)].astype(float) for k, y, x in ((words, counts, t), (words, counts, before), (pair_keys, pair_counts, pair)))
        with np.errstate(divide="ignore", invalid="ignore"):
            level = lambda p: np.where(p > 0, 1 + np.round(-STEPS * np.log2(p)), 0).astype(np.int64)
            got = pd.DataFrame({"bucket": bucket_of(h), "pair": level(two / h), "word": level(c / n)})
        return got.value_counts().rename("n").reset_index()

    gone, asked_for = dealt_docs.filter(F.col("fold") == DELETED), answers.filter("kind in (3, 4)").select("block", "part", "kind", "keys", "counts")
    each = gone.groupBy("block").cogroup(asked_for.groupBy("block")).applyInPandas(run, "bucket long, pair long, word long, n long")
    return each.groupBy("bucket", "pair", "word").agg(F.sum("n").alias("n"))


def learnt(found: pd.DataFrame, v: int) -> np.ndarray:
    """Weights (pair, word, even) by bucket, by expectation-maximisation on the deleted fold's counts; a bucket without
    any takes those of all buckets together."""
    out = np.zeros((BUCKETS, 3))

    def rounds(x: pd.DataFrame, start: np.ndarray) -> np.ndarray:
        est = lambda c: np.where(x[c] > 0, 2.0 ** (-(x[c].to_numpy() - 1) / STEPS), 0.0)
        p = np.stack([est("pair"), est("word"), np.full(len(x), 1 / (v + 1))], 1)
        n, w = x["n"].to_numpy(float), start
        for _ in range(ROUNDS):
            share = p * w
            share *= (n / share.sum(1))[:, None]
            w = share.sum(0) + [1e-3, 1e-3, 1e-3]
            w = w / w.sum()
        return w

    even = np.full(3, 1 / 3)
    common = rounds(found, even) if len(found) else even
    for b in range(BUCKETS):
        x = found[found["bucket"] == b]
        out[b] = rounds(x, even) if len(x) else common
    return out


def scored(docs: DataFrame, fan: int = FAN) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of docs. fan: a power of two.

    Null and empty texts have the end token alone. A null doc_id counts as the empty text where rows are held out. Without training
    rows all scores come from the even distribution over one unseen word. Repeated rows each count and are each scored.
    """
    spark = docs.sparkSession
    rows, ranges = dealt(docs)
    width = min(ranges, fan)
    with passing() as own:
        answers = counted(asked(rows, width, fan), width, ranges, fan)
        own.keep(answers)
    n_kept, n_gone, v_kept, v = (x or 0 for x in answers.filter("block = -1").agg(*[F.sum(c) for c in ("n_kept", "n_gone", "v_kept", "v_all")]).first())
    with shuffles_dropped(spark):
        found = events(rows, answers, max(n_kept, 1)).toPandas()
    weights = learnt(found, v_kept)
    n = n_kept + n_gone

    def run(key: tuple, d: pd.DataFrame, a: pd.DataFrame) -> pd.DataFrame:
        t, lengths = tokens(d["text"])
        before, pair = pairs(t)
        words, at = np.unique(t, return_inverse=True)
        count = joined(a, 1, "counts")
        c = count[at].astype(float)
        place = np.minimum(np.searchsorted(words, before), len(words) - 1)
        h = np.where(words[place] == before, count[place], 0).astype(float)
        two = joined(a, 2, "counts")[np.unique(pair, return_inverse=True)[1]].astype(float)
        w = weights[bucket_of(h)]
        p = w[:, 0] * two / np.maximum(h, 1) + w[:, 1] * c / max(n, 1) + w[:, 2] / (v + 1)
        starts = np.cumsum(lengths) - lengths
        total = lambda x: np.add.reduceat(x, starts)
        return pd.DataFrame({
            "doc_id": d["doc_id"], "held_out": d["fold"] == 0, "n_tokens": lengths, "n_known": total((c > 0).astype(np.int64)), "train_tokens": n,
            "base_score": total(np.log10((c + 0.1) / (n + 0.1 * (v + 1)))), "score": total(np.log10(p)),
        })

    counts = answers.filter("kind in (1, 2)").select("block", "part", "kind", "counts")
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return rows.groupBy("block").cogroup(counts.groupBy("block")).applyInPandas(run, schema)
