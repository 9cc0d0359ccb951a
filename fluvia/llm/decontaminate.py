"""Benchmark decontamination by pigeonhole edit matching.

An item of m characters may be found with up to ``budget(m)`` edits.  Cut into one piece more than that, at least
one piece of any such occurrence is untouched, so exact piece hits (one automaton for all pieces of all items)
propose every place, and a bit-parallel edit distance over the place's window decides.  Items and texts are
compared in lower case with white space as one space.

The items go to every executor in batches of bounded size, and each batch is one pass over the documents, so a
benchmark of any size is matched whole.  There is no shuffle of texts.

An item too short for an edit is sought as it is, where no letter or digit stands beside it.

Defined cases: null or empty texts and items match nothing, nor do rows of a null item id; a null doc_id is kept; equal items
each match; rows with equal ids are rows of their own; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fluvia.llm.common import kept, per_batch

#: Edits allowed for each character of an item.
ERROR_RATE = 0.05
#: Characters of items sent to the executors at once.
BATCH_CHARS = 4 << 20


def canonical(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def budget(length: int, rate: float = ERROR_RATE) -> int:
    return int(length * rate)


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """k + 1 pieces of near equal length with their offsets."""
    bounds = [len(item) * i // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(bounds, bounds[1:], strict=False)]


def myers(pattern: str, text: str) -> tuple[int, int]:
    """Least edit distance between ``pattern`` and a substring of ``text``, and where the first such substring ends."""
    m = len(pattern)
    at: dict[str, int] = {}
    for i, c in enumerate(pattern):
        at[c] = at.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best, end = m, 0
    for j, c in enumerate(text, 1):
        eq = at.get(c, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        ph = minus | (full & ~(xh | plus))
        mh = plus & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = ph << 1 & full
        mh = mh << 1 & full
        plus = mh | (full & ~(xv | ph))
        minus = ph & xv
        if score < best:
            best, end = score, j
    return best, end


def _alone(text: str, begin: int, end: int) -> bool:
    """Whether no letter or digit stands beside the place."""
    return not text[begin - 1 : begin].isalnum() and not text[end : end + 1].isalnum()


class Matcher:
    """Finds items in texts."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        import ahocorasick

        self.items = [(i, t, budget(len(t), rate)) for i, t in items]
        where: dict[str, list[tuple[int, int]]] = {}
        for number, (_, text, k) in enumerate(self.items):
            for offset, piece in pieces(text, k):
                where.setdefault(piece, []).append((number, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, places in where.items():
            self.automaton.add_word(piece, (len(piece), places))
        self.automaton.make_automaton()

    def find(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(item id, distance, start, end) of each item in the text, at its best place; offsets in the canonical text."""
        text = canonical(text)
        if not text or not self.items:
            return []
        spots: dict[int, set[int]] = {}
        for end, (length, places) in self.automaton.iter(text):
            for number, offset in places:
                spots.setdefault(number, set()).add(end + 1 - length - offset)
        out = []
        for number, begins in spots.items():
            item, pattern, k = self.items[number]
            m, best = len(pattern), None
            for begin in sorted(begins):
                if begin >= 0 and text.startswith(pattern, begin) and (k or _alone(text, begin, begin + m)):
                    best = 0, begin, begin + m
                    break
            if best is None and k:
                done = -1
                for begin in sorted(begins):
                    lo, hi = max(0, begin - k), min(len(text), begin + m + k)
                    if hi <= done:
                        continue
                    # Near places share a window.
                    hi = min(len(text), hi + k)
                    done = hi
                    distance, stop = myers(pattern, text[lo:hi])
                    if distance <= k and (best is None or distance < best[0]):
                        _, back = myers(pattern[::-1], text[max(lo, lo + stop - m - k) : lo + stop][::-1])
                        best = distance, lo + stop - back, lo + stop
            if best is not None:
                out.append((item, *best))
        return out


def _batches(items: DataFrame, key: str, text: str) -> Iterator[list[tuple[int, str]]]:
    """Canonical items in batches of bounded size; the driver holds one at a time."""
    batch, held = [], 0
    for row in items.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).where("key is not null and text is not null").toLocalIterator():
        item = canonical(row["text"])
        if not item:
            continue
        batch.append((row["key"], item))
        held += len(item)
        if held >= BATCH_CHARS:
            yield batch
            batch, held = [], 0
    if batch:
        yield batch


def _matcher(sent, rate: float) -> Matcher:
    """This worker's automaton for a broadcast batch of items."""
    held = kept("decontaminate")
    if held.get("for") != (sent.value[0], rate):
        held["for"], held["matcher"] = (sent.value[0], rate), Matcher(sent.value[1], rate)
    return held["matcher"]


def leaks(df: DataFrame, items: DataFrame, rate: float = ERROR_RATE) -> DataFrame:
    """doc_id, item_id, distance, match_start, match_end: items found in documents within their edit budget."""
    rows = df.select("doc_id", "text")
    schema = T.StructType([rows.schema["doc_id"], *[T.StructField(n, k) for n, k in (("item_id", T.LongType()), ("distance", T.IntegerType()), ("match_start", T.LongType()), ("match_end", T.LongType()))]])
    found = None
    for batch in _batches(items, "item_id", "text"):
        sent = df.sparkSession.sparkContext.broadcast((hash(tuple(batch)), batch))

        def run(rows: pa.RecordBatch, sent=sent) -> pa.RecordBatch:
            matcher = _matcher(sent, rate)
            at, out = [], []
            for i, text in enumerate(rows.column("text").to_pylist()):
                for hit in matcher.find(text):
                    at.append(i)
                    out.append(hit)
            cols = list(zip(*out, strict=True)) or [()] * 4
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([rows.column("doc_id").take(pa.array(at, pa.int64())), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], schema.names)

        part = rows.mapInArrow(per_batch(run, "decontaminate"), schema)
        found = part if found is None else found.unionByName(part)
    return df.sparkSession.createDataFrame([], schema) if found is None else found


def keep_clean(df: DataFrame, items: DataFrame, rate: float = ERROR_RATE) -> DataFrame:
    """Rows of ``df`` in whose text no item is found."""
    for batch in _batches(items, "item_id", "text"):
        sent = df.sparkSession.sparkContext.broadcast((hash(tuple(batch)), batch))

        def run(rows: pa.RecordBatch, sent=sent) -> pa.RecordBatch:
            matcher = _matcher(sent, rate)
            return rows.filter(pa.array(np.array([not matcher.find(t) for t in rows.column("text").to_pylist()], bool)))

        df = df.mapInArrow(per_batch(run, "decontaminate"), df.schema)
    return df
