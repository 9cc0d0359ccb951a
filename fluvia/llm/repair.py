"""Token ids as Re-Pair grammars: the library's binary file format for encoded documents.

A block is a shard of the file: the ids of some hundreds of documents with a grammar of their own.  Round by round
the repeated neighbouring pairs become nonterminals, the more frequent before the less frequent where they overlap,
until none of the block occurs ``LEAST_USE`` times (``compress(least_use=2)``: until no pair repeats).  A pair never crosses a document's end, so each document stays
addressable.  A block keeps the rules, the length that each rule expands to, and for each document where its symbols
begin and how many ids they stand for, which is enough to expand one document without the others.

Blocks are rows of a Parquet table, in ascending document order, written by Spark's committer to a folder
that all executors share.  A range partition holds consecutive documents; no task sees more than its range.

Defined cases: a null text counts as empty, and still yields its end id; rows with equal ids follow each other,
ordered by text; null ids come first; other columns are ignored; an empty table makes an empty file.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fluvia.llm.common import per_batch, per_task, written
from fluvia.llm.tokenize import byte_level_ids, spans

MAGIC = b"RPG2"
BLOCK_IDS = 1 << 18
#: A pair becomes a rule while it occurs so often: a rule takes the room of three to four symbols, which a rarer pair does not give back. On
#: documents of the check a block of 532664 bytes of ids takes 362267 bytes so, and 377866 if rules go on until no pair repeats (2).
LEAST_USE = 4
FIRST_RULE = 1 << 16
#: Bits of a symbol, and two marks above them. A block of more than 900000 rules stops there.
_SYMBOL, _LIVE, _LAST = np.uint32((1 << 20) - 1), np.uint32(1 << 20), np.uint32(1 << 21)


def compress(ids: np.ndarray, doc_lengths: np.ndarray, least_use: int = LEAST_USE) -> bytes:
    """A block's bytes. ``ids``: of all its documents, each below 65536; ``doc_lengths``: ids of each document; ``least_use``: 2 at least."""
    # A symbol, and above it whether it ends a document and whether its pair with the next may still be repeated.
    word = ids.astype(np.uint32)
    ends = np.cumsum(doc_lengths)
    word[ends[doc_lengths > 0] - 1] |= _LAST
    left, right, rounds, known = [], [], [], FIRST_RULE
    live = np.flatnonzero(word < _LAST)
    while len(live):
        bits = np.uint64(len(word).bit_length())
        pair = (word[live] & _SYMBOL).astype(np.uint64) << np.uint64(20) | (word[live + 1] & _SYMBOL)
        # Of overlapping places of one pair (a a a) the first, third, ... count.
        follows = np.flatnonzero((pair[1:] == pair[:-1]) & (live[1:] == live[:-1] + 1)) + 1
        even = slice(None)
        if len(follows):
            run = np.diff(follows, prepend=-1) != 1
            even = np.ones(len(live), bool)
            even[follows[(np.arange(len(follows)) - np.flatnonzero(run)[np.cumsum(run) - 1]) % 2 == 0]] = False
        if bits <= 24:
            order = np.sort(pair[even] << bits | live[even].astype(np.uint64))
            pair, at = order >> bits, order & ((np.uint64(1) << bits) - np.uint64(1))
        else:
            order = np.argsort(pair[even], kind="stable")
            pair, at = pair[even][order], live[even][order]
        edge = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
        count = np.diff(np.append(edge, len(pair)))
        often = count >= least_use
        if not often.any():
            break
        keys = pair[edge[often]]
        at = at[np.repeat(often, count)].astype(np.int64)
        count = count[often]
        by_use = np.argsort(-count, kind="stable")
        rank_of = np.empty(len(keys), np.int32)
        rank_of[by_use] = np.arange(len(keys), dtype=np.int32)
        rank = np.full(len(word) + 1, len(keys), np.int32)
        rank[at] = own = np.repeat(rank_of, count)
        # Where places of different pairs overlap, the more frequent pair has them; so the most frequent one has all of its own.
        chosen = (own < rank[at - 1]) & (own < rank[at + 1])
        used = np.bincount(own[chosen], minlength=len(keys))
        rules = np.flatnonzero(used >= 2)[: int(_SYMBOL) + 1 - known]
        if not len(rules):
            break
        name = np.zeros(len(keys), np.uint32)
        name[rules] = np.arange(known, known + len(rules), dtype=np.uint32)
        made = keys[by_use[rules]]
        left.append((made >> np.uint64(20)).astype(np.uint32))
        right.append((made & np.uint64(_SYMBOL)).astype(np.uint32))
        rounds.append(len(rules))
        known += len(rules)
        symbol = name[own]
        symbol[~chosen] = 0
        replaced = symbol > 0
        where = at[replaced]
        # Only new pairs and pairs that occur often enough can do so later: all others lose places and never gain one.
        word &= ~_LIVE
        word[at] |= _LIVE
        if len(follows):
            twin = at[((word[at] ^ word[at + 1]) & _SYMBOL) == 0]
            word[twin + 1] |= _LIVE
        word[where[where > 0] - 1] |= _LIVE
        word[where] = symbol[replaced] | _LIVE | (word[where + 1] & _LAST)
        stay = np.ones(len(word), bool)
        stay[where + 1] = False
        word = word[stay]
        live = np.flatnonzero((word & (_LIVE | _LAST)) == _LIVE)
    seq, last = word & _SYMBOL, (word & _LAST) > 0
    # An empty document owns no symbol; it takes the next one's place.
    full = doc_lengths > 0
    starts = np.concatenate([[0], np.flatnonzero(last) + 1])[np.cumsum(full) - full].astype("<u4")
    none = np.empty(0, np.uint32)
    left, right = np.concatenate([*left, none]), np.concatenate([*right, none])
    planes = max(0, (known - 1).bit_length() - 16)
    head = np.array([len(left), len(seq), len(doc_lengths), len(rounds), planes], "<u4").tobytes()
    sizes = _rule_sizes(left, right, rounds)
    wide = "<u2" if not len(sizes) or sizes.max() < 1 << 16 else "<u4"
    return b"".join([
        MAGIC, head, np.array(rounds, "<u4").tobytes(), wide.encode()[1:], sizes.astype(wide).tobytes(),
        *(_packed(x, planes) for x in (left, right, seq)), starts.tobytes(), doc_lengths.astype("<u4").tobytes(),
    ])


def _rule_sizes(left: np.ndarray, right: np.ndarray, rounds: list[int]) -> np.ndarray:
    """Ids that each rule expands to; a rule's parts come from earlier rounds."""
    sizes = np.ones(FIRST_RULE + len(left), np.int64)
    at = 0
    for n in rounds:
        sizes[FIRST_RULE + at : FIRST_RULE + at + n] = sizes[left[at : at + n]] + sizes[right[at : at + n]]
        at += n
    return sizes[FIRST_RULE:]


def _packed(symbols: np.ndarray, planes: int) -> bytes:
    """The symbols' low 16 bits as they are, behind them planes of one bit each."""
    return (symbols & 0xFFFF).astype("<u2").tobytes() + b"".join(np.packbits(symbols >> (16 + k) & 1).tobytes() for k in range(planes))


class Block:
    """A block read back."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a block of this format")
        rules, symbols, docs, rounds, planes = np.frombuffer(data, "<u4", 5, 4).tolist()
        at = 24

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        def unpacked(n: int) -> np.ndarray:
            out = take("<u2", n).astype(np.uint32)
            for k in range(planes):
                out |= np.unpackbits(take("u1", (n + 7) // 8), count=n).astype(np.uint32) << np.uint32(16 + k)
            return out

        self.rounds = take("<u4", rounds).tolist()
        wide = "<" + take("u1", 2).tobytes().decode()
        self.sizes = take(wide, rules).astype(np.int64)
        self.left, self.right, self.seq = unpacked(rules), unpacked(rules), unpacked(symbols)
        self.starts, self.doc_lengths = take("<u4", docs), take("<u4", docs)
        self.flat, self.flat_at = self._expansions()

    def _expansions(self) -> tuple[np.ndarray, np.ndarray]:
        """The rules' expansions one after another behind the plain ids, and where each begins."""
        begins = FIRST_RULE + np.cumsum(self.sizes) - self.sizes
        flat = np.empty(FIRST_RULE + int(self.sizes.sum()), np.uint32)
        flat[:FIRST_RULE] = np.arange(FIRST_RULE)
        at = np.concatenate([np.arange(FIRST_RULE), begins])
        size = np.concatenate([np.ones(FIRST_RULE, np.int64), self.sizes])
        done = 0
        for n in self.rounds:
            parts = np.stack([self.left[done : done + n], self.right[done : done + n]], axis=1).ravel()
            if n:
                got = flat[spans(at[parts], size[parts])]
                flat[begins[done] : begins[done] + len(got)] = got
            done += n
        return flat, at

    def _expand(self, seq: np.ndarray) -> np.ndarray:
        n = np.ones(len(seq), np.int64)
        rule = seq >= FIRST_RULE
        n[rule] = self.sizes[seq[rule] - FIRST_RULE]
        return self.flat[spans(self.flat_at[seq], n)]

    def ids(self) -> np.ndarray:
        """Ids of all documents of the block."""
        return self._expand(self.seq)

    def document(self, k: int) -> np.ndarray:
        """Ids of the block's document ``k``, expanded alone."""
        later = self.starts[k + 1] if k + 1 < len(self.starts) else len(self.seq)
        return self._expand(self.seq[self.starts[k] : later])


def write_documents(df: DataFrame, path: str, end_id: int = 0, block_ids: int = BLOCK_IDS) -> str:
    """Encode ``doc_id, text`` with the byte-level tokenizer file ``path`` and write blocks in ascending doc_id order.

    Returns the folder. A row: part (range partition, ascending), first_id (ids of the part before the block),
    doc_ids, block.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        before, docs, ids, held = 0, [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal before, docs, ids, held
            lengths = np.array([len(x) for x in ids], np.int64)
            block = compress(np.concatenate(ids), lengths)
            row = pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([before], pa.int64()), pa.array([held], pa.int64()), pa.array([docs], pa.list_(pa.int64())), pa.array([block], pa.binary())],
                ["part", "first_id", "n_ids", "doc_ids", "block"],
            )
            before, docs, ids, held = before + held, [], [], 0
            return row

        end = np.array([end_id], np.uint16)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for doc, code in zip(batch.column("doc_id").to_pylist(), byte_level_ids(texts, path), strict=True):
                docs.append(doc)
                ids.append(np.concatenate([code, end]))
                held += len(code) + 1
                if held >= block_ids:
                    yield flush()
        if docs:
            yield flush()

    schema = "part int, first_id long, n_ids long, doc_ids array<long>, block binary"
    ordered = df.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return written(ordered.mapInArrow(per_task(run, "token files"), schema), "fluvia/token-ids")


def read_documents(spark, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids_crc32, ids array<int> from a folder of blocks."""
    return _read(spark, folder, True)


def read_digests(spark, folder: str) -> DataFrame:
    """As ``read_documents`` without the ids."""
    return _read(spark, folder, False)


def _read(spark, folder: str, with_ids: bool) -> DataFrame:
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[tuple] = []
        for part, first, docs, data in zip(*[batch.column(c).to_pylist() for c in ("part", "first_id", "doc_ids", "block")], strict=True):
            block = Block(data)
            ids = block.ids().astype("<u4")
            ends = np.cumsum(block.doc_lengths, dtype=np.int64)
            for doc, n, end in zip(docs, block.doc_lengths.tolist(), ends.tolist(), strict=True):
                own = ids[end - n : end]
                out.append((part, doc, first + end - n, n, zlib.crc32(own), own.astype(np.int32) if with_ids else None))
        cols = list(zip(*out, strict=True)) or [()] * 6
        kinds = [("part", pa.int32()), ("doc_id", pa.int64()), ("rel", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.list_(pa.int32()))]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(cols, kinds, strict=True)], [n for n, _ in kinds])

    blocks = spark.read.parquet(folder)
    # One row a range partition: their number is set by the writer's partitioning, not by the documents.
    totals = sorted((r["part"], r["n"]) for r in blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    before, base = [], 0
    for part, n in totals:
        before.append((part, base))
        base += n
    offsets = spark.createDataFrame(before, "part int, base long")
    rows = blocks.mapInArrow(per_batch(run), "part int, doc_id long, rel long, n_tokens long, ids_crc32 long, ids array<int>")
    out = rows.join(F.broadcast(offsets), "part").select("doc_id", (F.col("base") + F.col("rel")).alias("start"), "n_tokens", "ids_crc32", "ids")
    return out if with_ids else out.drop("ids")
