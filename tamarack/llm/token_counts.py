"""Operator 8: greedy longest-match word pieces, counted by a linear-time automaton.

A trie of the vocabulary (word-initial pieces from one root, continuing pieces from another) has failure links: where
no arc goes on, the link leads to the state that the rest of the word reaches once the longest pieces are popped.
How many pieces a link pops is computed beforehand, so that a count needs one pass and builds no piece.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarack.llm.bpe import byte_letters
from tamarack.llm.common import WORD

KEPT = 1 << 18


class PieceCounter:
    """first: pieces that begin a word. rest: pieces that continue one."""

    def __init__(self, first: set[str], rest: set[str]):
        self.goes: dict[tuple[int, str], int] = {}
        ends, self.link, self.pops, order = [False, False], [-1, -1], [0, 0], []
        children: list[list[tuple[str, int]]] = [[], []]
        for root, pieces in ((0, first), (1, rest)):
            for piece in sorted(pieces):
                at = root
                for c in piece:
                    nxt = self.goes.get((at, c))
                    if nxt is None:
                        nxt = self.goes[at, c] = len(ends)
                        ends.append(False)
                        children.append([])
                        children[at].append((c, nxt))
                    at = nxt
                if at > 1:
                    ends[at] = True
        self.link += [-1] * (len(ends) - 2)
        self.pops += [0] * (len(ends) - 2)
        order = [0, 1]
        for at in order:  # breadth first; grows while it runs
            for c, nxt in children[at]:
                order.append(nxt)
                if ends[nxt]:
                    self.link[nxt], self.pops[nxt] = 1, 1
                    continue
                popped, z = self.pops[at], self.link[at]
                while z >= 0 and (z, c) not in self.goes:
                    popped, z = popped + self.pops[z], self.link[z]
                if z >= 0:
                    self.link[nxt], self.pops[nxt] = self.goes[z, c], popped

    def count(self, word: str) -> int:
        """How many pieces the word gives; 1, the unknown piece, where the pieces don't cover it."""
        at = n = 0
        goes, link, pops = self.goes, self.link, self.pops
        for c in word:
            nxt = goes.get((at, c))
            while nxt is None:
                if link[at] < 0:
                    return 1
                n += pops[at]
                at = link[at]
                nxt = goes.get((at, c))
            at = nxt
        while at != 1:
            if link[at] < 0:
                return 1 if word else 0
            n += pops[at]
            at = link[at]
        return n


@lru_cache(2)
def load(path: str) -> tuple[PieceCounter, list[str]]:
    """Word pieces from a byte-level vocabulary: entries with a leading space begin words, the others continue them."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    first, rest = pieces(spec)
    letters = [""] * 256
    for c, b in byte_letters().items():
        letters[b] = c
    return PieceCounter(first, rest), letters


def pieces(spec: dict) -> tuple[set[str], set[str]]:
    special = {a["content"] for a in spec["added_tokens"]}
    space = next(c for c, b in byte_letters().items() if b == 32)
    vocab = set(spec["model"]["vocab"]) - special
    return {t[1:] for t in vocab if t[:1] == space and t[1:]}, {t for t in vocab if t[:1] != space}


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_words, n_pieces: words are runs without ASCII white space, each cut greedily into the longest pieces.

    Null and empty texts give 0 and 0; a word that the pieces don't cover counts as one piece; null ids and repeated rows
    stay, other columns go. A worker remembers a bounded number of short words, which changes nothing but time.
    """

    def run(batches: Iterator) -> Iterator:
        counter, letters = load(path)
        word, known = re.compile(WORD), {}
        for b in batches:
            n, m = [], []
            for text in b["text"]:
                found = word.findall(text or "")
                total = 0
                for w in found:
                    k = known.get(w)
                    if k is None:
                        k = counter.count("".join([letters[x] for x in w.encode()]))
                        if len(w) <= 64:
                            if len(known) >= KEPT:
                                known.clear()
                            known[w] = k
                    total += k
                n.append(len(found))
                m.append(total)
            b["n_words"], b["n_pieces"] = n, m
            yield b[["doc_id", "n_words", "n_pieces"]]

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(run, "doc_id long, n_words long, n_pieces long")
