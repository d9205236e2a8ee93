"""Operator 4: byte-pair encoding and decoding through a tokenization automaton.

The automaton's arcs are tokens; a token sequence is a path exactly if it is what the merges make of its bytes.
It starts as one state with a loop for every byte. Each merge (u, v) -> w, in order of rank, adds a gadget: from the states behind
tokens that still end in u when the merge comes, the arcs of tokens that still begin with v go, and the arc w, with a state
behind it, runs beside the path u v. All gadgets are compiled into one table beforehand: a row of bits, of the arcs that are gone, for each
state; tokens behind which the same arcs are gone share a state.

As a path is right exactly if each of its arcs is there, every prefix of a word has one path. A word is encoded from left to right, without
search: a byte takes a trie of tokens with failure links to the longest token that ends there. Of it and its shorter endings, the first that
is an arc from the state at its start ends the prefix's path, and sets the state at the byte's end. Decoding emits the arcs' labels.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the published pattern that splits text before byte-level merges.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
WORDS_KEPT, LONG = 1 << 17, 64
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write for bytes: printable ones stand for themselves, others follow from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Words(dict):
    """What _word says of words; long ones are not kept. When there are many, they become the old ones, and those that were old and not met since are forgotten."""

    def __init__(self, automaton: MergeAutomaton):
        super().__init__()
        self.automaton, self.old = automaton, {}

    def __missing__(self, word: str) -> tuple[int, str, bytes, tuple[int, ...]]:
        got = self.old.get(word) or self.automaton._word(self.automaton.encode_word(word.encode()))
        if len(word) <= LONG:
            if len(self) >= WORDS_KEPT:
                self.old = dict(self)
                self.clear()
            self[word] = got
        return got


class MergeAutomaton:
    """labels: the bytes of each token id. merges: (u, v, w) ids by rank. special: text -> id of tokens matched before splitting."""

    def __init__(self, labels: dict[int, bytes], merges: list[tuple[int, int, int]], special: dict[str, int] | None = None):
        self.special = special or {}
        size = max([*labels, *self.special.values()]) + 1
        self.labels = [labels.get(i, b"") for i in range(size)]
        for text, i in self.special.items():
            self.labels[i] = text.encode()
        used = set(self.special.values())
        own = [i for i, label in enumerate(self.labels) if label and i not in used]
        self._compile(own, merges)
        self._trie(own)
        self.split = regex.compile(SPLIT)
        self.marks = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.known = Words(self)

    def _trie(self, own: list[int]) -> None:
        """goes: from node << 8 | byte to a node. last: the longest token that ends at a node. shorter: a token's longest proper ending that is one."""
        self.goes: dict[int, int] = {}
        self.fails, self.last, self.shorter, self.whole = [0], [-1], [-1] * len(self.labels), {}
        level: list[tuple[int, int, int]] = []  # parent, byte, node
        for i in own:
            at = 0
            for b in self.labels[i]:
                nxt = self.goes.get(at << 8 | b)
                if nxt is None:
                    nxt = self.goes[at << 8 | b] = len(self.last)
                    self.last.append(-1)
                    self.fails.append(0)
                    level.append((at, b, nxt))
                at = nxt
            self.last[at] = i
            self.whole[self.labels[i]] = i
        deep = [0] * len(self.last)
        for parent, _, node in level:  # a parent's number is less than its child's
            deep[node] = deep[parent] + 1
        for parent, b, node in sorted(level, key=lambda x: deep[x[2]]):
            fail = 0
            if parent:
                at = self.fails[parent]
                while (fail := self.goes.get(at << 8 | b)) is None and at:
                    at = self.fails[at]
                fail = fail or 0
            self.fails[node] = fail
            if self.last[node] < 0:
                self.last[node] = self.last[fail]
            else:
                self.shorter[self.last[node]] = self.last[fail]
        self.links: dict[int, int] = {}

    def _failed(self, at: int, b: int) -> int:
        """Where byte b leads from a node without a child for it."""
        key, goes = at << 8 | b, self.goes
        nxt = self.links.get(key)
        if nxt is None:
            while at and nxt is None:
                at = self.fails[at]
                nxt = goes.get(at << 8 | b)
            nxt = nxt or 0
            if len(self.links) >= WORDS_KEPT:
                self.links.clear()
            self.links[key] = nxt
        return nxt

    def _compile(self, own: list[int], merges: list[tuple[int, int, int]]) -> None:
        """The states: state[t] behind token t, gone[s] the row of state s, at[x] the place of arc x in a row (-1: it never goes)."""
        size, last = len(self.labels), len(merges)
        left, right, made = np.full(size, -1), np.full(size, -1), np.full(size, -1)
        for rank, (u, v, w) in enumerate(merges):
            if made[w] >= 0:
                raise ValueError(f"merge {rank} makes a token a second time")
            left[w], right[w], made[w] = u, v, rank

        def ends(of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Tokens by what they end in (or begin with), sorted by it, and the merge that takes it up; `last` if none does."""
            t = np.array(own)
            x, until, out = t, np.full(len(t), last), []
            while len(t):
                out.append((x, t, until))
                more = made[x] >= 0
                t, x = t[more], x[more]
                until, x = made[x], of[x]
            x, t, until = map(np.concatenate, zip(*out, strict=True))
            order = np.argsort(x, kind="stable")
            return x[order], t[order], until[order]

        behind, before = ends(right), ends(left)
        # arcs that begin alike are neighbours in a row, so that a gadget takes away a short piece of it
        place = np.full(size, -1)
        place[sorted(own, key=self.labels.__getitem__)] = np.arange(len(own))
        pairs = np.array(merges, np.int64).reshape(-1, 3)
        cut = lambda x, of: (np.searchsorted(of[0], x), np.searchsorted(of[0], x, "right"))
        gone_at = np.zeros(len(own), bool)
        gadgets = []
        for rank, (u, v, a, b, c, d) in enumerate(zip(pairs[:, 0].tolist(), pairs[:, 1].tolist(), *(x.tolist() for x in (*cut(pairs[:, 0], behind), *cut(pairs[:, 1], before))), strict=True)):
            tails = behind[1][a:b][behind[2][a:b] > rank]
            # of three like tokens the first two merge, so the third is still there for the same merge
            arcs = place[before[1][c:d][before[2][c:d] > rank - (u == v)]]
            gadgets.append((tails, arcs))
            gone_at[arcs] = True
        near = np.where(gone_at, np.cumsum(gone_at) - 1, -1)
        width = max(1, int(gone_at.sum()) + 7 >> 3)
        rows = np.zeros((size, width), np.uint8)
        for tails, arcs in gadgets:
            if len(tails) and len(arcs):
                arcs = near[arcs]
                lo, hi = int(arcs.min()) >> 3, (int(arcs.max()) >> 3) + 1
                piece = np.zeros((hi - lo) * 8, bool)
                piece[arcs - lo * 8] = True
                rows[tails, lo:hi] |= np.packbits(piece, bitorder="little")
        states: dict[bytes, int] = {bytes(width): 0}
        self.state = [states.setdefault(row.tobytes(), len(states)) for row in rows]
        self.gone = list(states)
        self.at = np.where(place >= 0, near[place], -1).tolist()
        self.behind = [self.gone[k] for k in self.state] + [self.gone[0]]  # the last: before any token
        self.size = list(map(len, self.labels))
        self.asked = [(c >> 3, 1 << (c & 7), n) if c >= 0 else (0, 0, n) for c, n in zip(self.at, self.size, strict=True)]  # byte and bit of a row, and length

    def arc(self, t: int, x: int) -> bool:
        """Whether token x may follow token t."""
        c = self.at[x]
        return c < 0 or not self.gone[self.state[t]][c >> 3] >> (c & 7) & 1

    def encode_word(self, raw: bytes) -> tuple[int, ...]:
        """The path of raw. Each offset is reached by one arc, the last of its prefix's path."""
        if raw in self.whole:  # an arc from the start
            return (self.whole[raw],)
        goes, last, shorter, asked, behind, size, failed = self.goes.get, self.last, self.shorter, self.asked, self.behind, self.size, self._failed
        row, came, at, end = [behind[-1]], [-1], 0, 0
        for b in raw:
            at = goes(at << 8 | b) or failed(at, b)
            end += 1
            x = last[at]
            k, bit, n = asked[x]
            while row[end - n][k] & bit:
                x = shorter[x]
                k, bit, n = asked[x]
            came.append(x)
            row.append(behind[x])
        path = []
        while end:
            path.append(came[end])
            end -= size[came[end]]
        path.reverse()
        return tuple(path)

    def words(self, text: str) -> list[tuple[int, str, bytes, tuple[int, ...]]]:
        """For each word of the text, special tokens included: number of tokens, their ids as text and as numbers, their labels joined."""
        out: list = []
        at = 0
        if self.marks is not None:
            for m in self.marks.finditer(text):
                self._plain(text[at : m.start()], out)
                out.append(self._word((self.special[m[0]],)))
                at = m.end()
        self._plain(text[at:] if at else text, out)
        return out

    def _word(self, ids: tuple[int, ...]) -> tuple[int, str, bytes, tuple[int, ...]]:
        return len(ids), ",".join(map(str, ids)), b"".join(map(self.labels.__getitem__, ids)), ids

    def _plain(self, text: str, out: list) -> None:
        out.extend(map(self.known.__getitem__, self.split.findall(text)))

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(w[3] for w in self.words(text)))

    def decode(self, ids: list[int]) -> str:
        """The labels of the path's arcs, as UTF-8; bytes that are none become U+FFFD."""
        return b"".join(map(self.labels.__getitem__, ids)).decode(errors="replace")


@lru_cache(2)
def load(path: str) -> MergeAutomaton:
    """Compiles a byte-level BPE file; once in each Python worker."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    letters = byte_letters()
    vocab = spec["model"]["vocab"]
    special = {a["content"]: a["id"] for a in spec["added_tokens"]}
    labels = {i: bytes(letters[c] for c in t) for t, i in vocab.items() if t not in special}
    pairs = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
    return MergeAutomaton(labels, [(vocab[u], vocab[v], vocab[u + v]) for u, v in pairs], special)


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, text, ids: each text's tokens. A null text counts as empty and has no ids; other columns go; repeated rows stay."""

    def run(batches: Iterator) -> Iterator:
        a = load(path)
        for b in batches:
            b["ids"] = [a.encode(t or "") for t in b["text"]]
            yield b

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(run, "doc_id long, text string, ids array<int>")


def decoded(tokens: DataFrame, path: str) -> DataFrame:
    """doc_id, text: the text that each row's ids stand for; null ids give an empty text."""

    def run(batches: Iterator) -> Iterator:
        a = load(path)
        for b in batches:
            b["text"] = [a.decode([] if i is None else list(i)) for i in b["ids"]]
            yield b[["doc_id", "text"]]

    return tokens.select(F.col("doc_id").cast("long"), "ids").mapInPandas(run, "doc_id long, text string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, and the SHA-256 of the ids, comma-joined, and of the decoded text.

    It encodes and decodes batch by batch, so ids never cross to the JVM. Null texts count as empty (0 tokens, the
    digests of nothing); null ids stay null; repeated rows are each encoded; an empty table gives an empty table.
    """

    def run(batches: Iterator) -> Iterator:
        a = load(path)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for b in batches:
            rows = []
            for text in b["text"]:
                n, ids, labels, _ = zip(*a.words(text or ""), strict=True) if text else ((), (), (), ())
                rows.append((sum(n), sha(",".join(ids).encode()), sha(b"".join(labels).decode(errors="replace").encode())))
            b[["n_tokens", "ids_sha256", "decoded_sha256"]] = rows if rows else None
            yield b[["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]]

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(run, SCHEMA)
