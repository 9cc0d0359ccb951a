"""BPE encoding and decoding by content-defined chunk reuse.

A gear hash over the text's bytes cuts it where its content says so, wherever the passage stands, so a
passage that several documents share falls into the same chunks.  A worker encodes a chunk once and keeps
its ids under the chunk's bytes.  A cut may part a word: the words at both sides of a join are encoded again
as one, and the join widens over chunks without white space until both sides agree at a white space, which no
pre-token of such a tokenizer crosses.
No shuffle is needed, memory is bounded by ``CHUNK_CACHE_BYTES``, and a lost task repeats alone.

Defined cases: a null text counts as empty; an empty text has no ids; rows with equal ids are separate rows;
other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from fluvia.llm.common import kept, per_batch
from fluvia.llm.tokenize import PieceMemo, token_texts, words_of

CHUNK_MIN, CHUNK_MAX, CHUNK_BITS = 256, 8192, 10
CHUNK_CACHE_BYTES = 24 << 20
_GEAR = np.random.default_rng(20240229).integers(0, 1 << 32, 256, dtype=np.uint32)
_SPACE = b" \n\t\r"


def cuts(data: bytes) -> list[int]:
    """Ends of the content-defined chunks of ``data``: UTF-8 boundaries where a rolling hash of 32 bytes has ``CHUNK_BITS`` zero bits."""
    n = len(data)
    if n <= CHUNK_MIN:
        return [n] if n else []
    b = np.frombuffer(data, np.uint8)
    h = _GEAR[b]
    for step in (1, 2, 4, 8, 16):
        h[step:] += h[:-step].copy() << np.uint32(step)
    marks = np.flatnonzero(h >> np.uint32(32 - CHUNK_BITS) == 0) + 1
    ends, last = [], 0
    for m in [*marks.tolist(), n]:
        while m - last > CHUNK_MAX:
            at = last + CHUNK_MAX
            while at < n and data[at] & 0xC0 == 0x80:
                at += 1
            ends.append(at)
            last = at
        while m < n and data[m] & 0xC0 == 0x80:
            m += 1
        if m > last and (m - last >= CHUNK_MIN or m == n):
            ends.append(m)
            last = m
    return ends


class ChunkCoder:
    """Encodes texts chunk by chunk with a tokenizer whose pre-tokens never cross white space."""

    def __init__(self, path: str):
        self.words = PieceMemo(path)
        self.chunks: dict[bytes, tuple] = {}
        self.held = self.reused = 0

    def _parted(self, data: bytes) -> tuple:
        """(head, inner words, tail) of a chunk; the words are None for one without white space."""
        words = words_of(data.decode("utf-8", "surrogatepass"))
        spaced = data[:1] in _SPACES, data[-1:] in _SPACES
        if not any(spaced) and len(words) == 1:
            return words[0], None, ""
        head = "" if spaced[0] or not words else words.pop(0)
        tail = "" if spaced[1] or not words else words.pop()
        return head, words, tail

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, int, int]]:
        """For each text its ids, equal to ``Tokenizer.encode(text, add_special_tokens=False).ids``, and its numbers of chunks and of joins encoded again."""
        if self.held > CHUNK_CACHE_BYTES:
            self.chunks.clear()
            self.held = 0
        known = self.chunks
        fresh: dict[bytes, tuple] = {}
        laid: list[list[bytes]] = []
        for text in texts:
            data = text.encode("utf-8", "surrogatepass")
            last, row = 0, []
            for end in cuts(data):
                row.append(piece := data[last:end])
                last = end
                if piece in known or piece in fresh:
                    self.reused += 1
                else:
                    fresh[piece] = self._parted(piece)
            laid.append(row)
        self.words.learn({w for _, words, _ in fresh.values() if words for w in words})
        for piece, (head, words, tail) in fresh.items():
            known[piece] = head, None if words is None else b"".join(map(self.words.__getitem__, words)), tail
            self.held += 2 * len(piece) + 300
        parts: list[list[bytes | str]] = [self._joined(row) for row in laid]
        self.words.learn({x for row in parts for x in row if isinstance(x, str)})
        take = self.words.__getitem__
        return [
            (np.frombuffer(b"".join([take(x) if isinstance(x, str) else x for x in row]), "<u2"), len(chunks), sum(isinstance(x, str) for x in row))
            for row, chunks in zip(parts, laid, strict=True)
        ]

    def _joined(self, row: list[bytes]) -> list[bytes | str]:
        """A document's parts: ids of chunks, and as text the words that stand across their joins."""
        parts: list[bytes | str] = []
        seam: list[str] = []
        for piece in row:
            head, body, tail = self.chunks[piece]
            if head:
                seam.append(head)
            if body is None:
                continue
            if seam:
                parts.append("".join(seam))
                seam = []
            parts.append(body)
            if tail:
                seam.append(tail)
        if seam:
            parts.append("".join(seam))
        return parts


_SPACES = tuple(bytes([c]) for c in _SPACE)
def coder(path: str) -> ChunkCoder:
    """This worker's coder for a tokenizer file."""
    held = kept("bpe")
    if path not in held:
        held[path] = ChunkCoder(path)
    return held[path]


def decode_ids(ids: np.ndarray, path: str) -> str:
    """The tokens' strings joined by one space: what the library gives for a file without a decoder."""
    return " ".join(map(token_texts(path).__getitem__, ids.tolist()))


def _texts(batch: pa.RecordBatch, name: str) -> list[str]:
    return [t or "" for t in batch.column(name).to_pylist()]


def encode_documents(df: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, ids array<int>) of every row of ``df``."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        code = coder(path)
        ids = [x.astype(np.int32) for x, *_ in code.encode(_texts(batch, "text"))]
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
        flat = np.concatenate([*ids, np.empty(0, np.int32)])
        return pa.RecordBatch.from_arrays([batch.column("key"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], ["key", "ids"])

    rows = df.select(df[key].alias("key"), df[text].alias("text"))
    schema = T.StructType([rows.schema["key"], T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return rows.mapInArrow(per_batch(run, "bpe"), schema).withColumnRenamed("key", key)


def decode_documents(df: DataFrame, path: str, ids: str = "ids", key: str = "doc_id") -> DataFrame:
    """(key, text) of every row of ``df``, from its ids."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = [decode_ids(np.asarray(x or [], np.int64), path) for x in batch.column("ids").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("key"), pa.array(out, pa.string())], ["key", "text"])

    rows = df.select(df[key].alias("key"), df[ids].alias("ids"))
    schema = T.StructType([rows.schema["key"], T.StructField("text", T.StringType())])
    return rows.mapInArrow(per_batch(run, "bpe"), schema).withColumnRenamed("key", key)


def round_trip_digests(df: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and the chunk counts of every document: encode and decode fused in one pass."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        code = coder(path)
        out: list[tuple] = []
        for ids, *counts in code.encode(_texts(batch, "text")):
            decoded = decode_ids(ids, path)
            out.append((
                len(ids),
                hashlib.sha256(ids.astype("<u4")).hexdigest(),
                hashlib.sha256(decoded.encode("utf-8", "surrogatepass")).hexdigest(),
                *counts,
            ))
        cols = list(zip(*out, strict=True))
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string()), *[pa.array(c, pa.int32()) for c in cols[3:]]],
            ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_chunks", "n_joins"],
        )

    rows = df.select("doc_id", "text")
    schema = T.StructType([
        rows.schema["doc_id"],
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_sha256", T.StringType()),
        T.StructField("decoded_sha256", T.StringType()),
        T.StructField("n_chunks", T.IntegerType()),
        T.StructField("n_joins", T.IntegerType()),
    ])
    return rows.mapInArrow(per_batch(run, "bpe"), schema)
