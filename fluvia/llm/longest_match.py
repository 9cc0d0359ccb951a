"""Token counts by a linear longest-match automaton.

A trie of the vocabulary gets failure links in the way of fast word-piece matching: where a node has no child
for the next byte, the pieces that greedy longest match would cut off by then are already known, and so is the
node to go on from.  Only their number is kept, so a word's length in pieces comes out in one pass over its
bytes, and no piece is ever built.

A word stands between white space (``str.split``) and is matched as a space followed by the word's UTF-8 bytes;
every single byte is in the vocabulary, so a match never fails.

Defined cases: a null text counts as empty; an empty text has no words and no tokens; rows with equal ids are
separate rows; other columns of the input are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from fluvia.llm.common import kept, per_batch

MEMO_WORDS = 400_000
#: Words of more bytes run alone; shorter ones run side by side.
SIDE_BY_SIDE = 48


def vocabulary(path: str) -> list[bytes]:
    """Tokens of a ranks file: a base64 token and its rank on each line."""
    with open(path, "rb") as f:
        return [base64.b64decode(line.split()[0]) for line in f if line.strip()]


class Automaton:
    """Trie, failure links and popped-token counts of a vocabulary of byte strings."""

    def __init__(self, tokens: Iterable[bytes]):
        child: dict[int, int] = {}
        parent, byte, depth, is_token = [0], [0], [0], [False]
        for token in tokens:
            v = 0
            for c in token:
                key = v << 8 | c
                u = child.get(key)
                if u is None:
                    u = child[key] = len(parent)
                    parent.append(v)
                    byte.append(c)
                    depth.append(depth[v] + 1)
                    is_token.append(False)
                v = u
            is_token[v] = True
        for c in range(256):
            if not is_token[child.get(c, 0)] or c not in child:
                raise ValueError("every single byte must be a token")
        fail, pops = [0] * len(parent), [0] * len(parent)
        for v in sorted(range(1, len(parent)), key=depth.__getitem__):
            if is_token[v]:
                fail[v], pops[v] = 0, 1
                continue
            z, n, c = parent[v], 0, byte[v]
            while True:
                n += pops[z]
                z = fail[z]
                if (u := child.get(z << 8 | c)) is not None:
                    fail[v], pops[v] = u, n
                    break
        #: Pieces that remain when the input ends at a node.
        rest = [0] * len(parent)
        for v in sorted(range(1, len(parent)), key=depth.__getitem__):
            rest[v] = pops[v] + rest[fail[v]]
        self.child, self.fail, self.pops, self.rest = child, np.array(fail, np.int32), np.array(pops, np.int32), np.array(rest, np.int32)
        self._lists = fail, pops, rest
        keys = np.fromiter(child, np.int64, len(child))
        self.bits = max(8, int(np.ceil(np.log2(len(keys)))) + 2)
        self.keys, self.to = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int32)
        left, at = keys, self._slot(keys)
        to = np.fromiter(child.values(), np.int32, len(child))
        while len(left):
            free = self.keys[at] < 0
            _, one = np.unique(np.where(free, at, -1), return_index=True)
            one = one[free[one]]
            self.keys[at[one]], self.to[at[one]] = left[one], to[one]
            wait = np.ones(len(left), bool)
            wait[one] = False
            left, to, at = left[wait], to[wait], (at[wait] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _go(self, keys: np.ndarray) -> np.ndarray:
        """Children by key ``node << 8 | byte``, 0 where there is none."""
        at = self._slot(keys)
        out = np.zeros(len(keys), np.int32)
        look = np.arange(len(keys))
        while len(look):
            found = self.keys[at]
            hit = found == keys[look]
            out[look[hit]] = self.to[at[hit]]
            on = ~hit & (found >= 0)
            look, at = look[on], (at[on] + 1) & ((1 << self.bits) - 1)
        return out

    def count(self, word: bytes) -> int:
        """Pieces of one byte string."""
        child, (fail, pops, rest) = self.child, self._lists
        v = n = 0
        for c in word:
            while (u := child.get(v << 8 | c)) is None:
                n += pops[v]
                v = fail[v]
            v = u
        return n + rest[v]

    def counts(self, words: list[bytes]) -> np.ndarray:
        """Pieces of many byte strings."""
        out = np.zeros(len(words), np.int64)
        size = np.fromiter(map(len, words), np.int64, len(words))
        for i in np.flatnonzero(size > SIDE_BY_SIDE):
            out[i] = self.count(words[i])
        order = np.flatnonzero(size <= SIDE_BY_SIDE)
        order = order[np.argsort(-size[order], kind="stable")]
        size = size[order]
        begin = np.concatenate([[0], np.cumsum(size)])[:-1]
        flat = np.frombuffer(b"".join([words[i] for i in order]), np.uint8)
        node, n = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
        for step in range(int(size[0]) if len(size) else 0):
            lanes = np.arange(np.searchsorted(-size, -step, side="left"))
            byte = flat[begin[lanes] + step]
            while len(lanes):
                to = self._go(node[lanes] << 8 | byte)
                node[lanes[to > 0]] = to[to > 0]
                lanes, byte = lanes[to == 0], byte[to == 0]
                n[lanes] += self.pops[node[lanes]]
                node[lanes] = self.fail[node[lanes]]
        out[order] = n + self.rest[node]
        return out


class Counter(dict):
    """word -> pieces, emptied when full."""

    def __init__(self, automaton: Automaton):
        super().__init__()
        self.automaton = automaton

    def texts(self, texts: list[str]) -> list[int]:
        """Pieces of whole texts."""
        if len(self) > MEMO_WORDS:
            self.clear()
        split = [t.split() for t in texts]
        new = list({w for words in split for w in words} - self.keys())
        counts = self.automaton.counts([b" " + w.encode("utf-8", "surrogatepass") for w in new]).tolist()
        self.update(zip(new, counts, strict=True))
        return [sum(map(self.__getitem__, words)) for words in split]


def counter(path: str) -> Counter:
    held = kept("longest match")
    if path not in held:
        held[path] = Counter(Automaton(vocabulary(path)))
    return held[path]


def token_counts(df: DataFrame, path: str) -> DataFrame:
    """doc_id, n_words, n_tokens of every document by the ranks file ``path``. One pass, no shuffle."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t or "" for t in batch.column("text").to_pylist()]
        counts = counter(path).texts(texts)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(t.split()) for t in texts], pa.int64()), pa.array(counts, pa.int64())], ["doc_id", "n_words", "n_tokens"])

    rows = df.select("doc_id", "text")
    schema = T.StructType([rows.schema["doc_id"], T.StructField("n_words", T.LongType()), T.StructField("n_tokens", T.LongType())])
    return rows.mapInArrow(per_batch(run, "longest match"), schema)
