import hashlib
import zlib

import numpy as np
import pandas as pd
import pytest

from fluvia.llm import bpe, longest_match, repair
from fluvia.llm.tokenize import byte_level_ids, default_path
from tokenizers import Tokenizer

ODD = [
    "", " ", "a", "<|endoftext|>", "x<|endoftext|>y " * 200, "漢字" * 3000, "a b \x1c c" * 100, "don't   stop\n\n\t" * 100,
    "é" * 5000 + " b", "́a" * 500, "x" * 300 + "́" + "y" * 9000, "Σ ΑΣ " * 400, "İ ß" * 300, " a b", " a  b",
    "a \n b\n \n c", "a\n\n b ", "\n\n a", "  ", "a   b", "x   y", "<|endoftext|> <|endoftext|>", "a\xa0b \xa0 c", "a\0 b",
    "and, or. 1, 2. it's, we'll.",
]


def documents(spark, texts):
    return spark.createDataFrame([(i, t, "x", 7) for i, t in enumerate(texts)], "doc_id long, text string, ids string, key int")


def test_chunked_ids_and_decoding_equal_the_library(spark):
    path = default_path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    words = np.random.default_rng(8).integers(0, 10**6, 1500)
    shared = "".join(f"w{w} ".translate(str.maketrans("0123456789", "aeioustrnl")) for w in words)
    texts = [*ODD, shared, "Begin. " + shared + "end", shared * 3, None]
    got = {r["doc_id"]: r for r in bpe.round_trip_digests(documents(spark, texts).coalesce(1), path).collect()}
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        assert got[i]["n_tokens"] == len(ids), t
        assert got[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    chunked = bpe.ChunkCoder(path)
    chunked.encode([shared, "Begin. " + shared])
    assert chunked.reused >= 4
    coded = bpe.encode_documents(documents(spark, texts), path)
    assert {r["doc_id"]: r["text"] for r in bpe.decode_documents(coded, path).collect()}[3] == library.decode(library.encode(ODD[3], add_special_tokens=False).ids, skip_special_tokens=False)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_random_strings_equal_the_library(name):
    """Letters that lower-case into marks, combining marks, special tokens, odd white space, points after all of them."""
    rng = np.random.default_rng(5)
    signs = ["İ", "i\u0307", "é", "e\u0301", "Σ", "ς", "ß", "ŉ", "ǰ", "Ⅷ", "ª", "漢", "א", "ﬁ", "a", "b", "I", "'s", "7", ".", ",", "!", "-", " ", " ", "  ", "\n", "\t", "\xa0", "\u2028", "\u0300", "\u200d", "<|endoftext|>", "<|startoftext|>", "😀", "\0", "the", "lower", "ción", "über", "Ü", "×", "42", "$$", "(", "x" * 300]
    texts = ["".join(signs[k] for k in rng.integers(0, len(signs), rng.integers(1, 40))) for _ in range(10_000)] + ["İzmİ. a", "İ,"]
    library = Tokenizer.from_file(default_path(name))
    if name.startswith("word"):
        got = [ids.tolist() for ids, *_ in bpe.ChunkCoder(default_path(name)).encode(texts)]
    else:
        got = [ids.tolist() for ids in byte_level_ids(texts, default_path(name))]
    assert [t for t, ids in zip(texts, got, strict=True) if ids != library.encode(t, add_special_tokens=False).ids] == []


def test_cuts_follow_content():
    rng = np.random.default_rng(1)
    data = bytes(rng.integers(97, 123, 40_000, dtype=np.uint8))
    ends = bpe.cuts(data)
    assert ends[-1] == len(data) and all(b > a for a, b in zip(ends, ends[1:]))
    moved = {data[a:b] for a, b in zip([0, *ends], ends)} & {(b"zz" + data)[a:b] for a, b in zip([0, *bpe.cuts(b"zz" + data)], bpe.cuts(b"zz" + data))}
    assert len(moved) >= len(ends) - 2
    assert bpe.cuts(b"") == []


def test_byte_level_ids_equal_the_library():
    path = default_path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    for t, ids in zip(ODD, byte_level_ids(ODD, path), strict=True):
        assert ids.tolist() == library.encode(t, add_special_tokens=False).ids, t


@pytest.mark.parametrize("texts", [[*ODD, None, "same", "same"], []])
def test_repair_files_give_back_all_ids(spark, texts):
    path = default_path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    folder = repair.write_documents(documents(spark, texts), path, block_ids=300)
    got = {r["doc_id"]: r for r in repair.read_documents(spark, folder).collect()}
    start = 0
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids"]) == (start, len(ids), ids)
        assert got[i]["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)


def test_repair_blocks_compress_and_give_single_documents():
    rng = np.random.default_rng(5)
    phrases = [rng.integers(0, 50_000, 12) for _ in range(9)]
    docs = [np.concatenate([phrases[k] for k in rng.integers(0, 9, n)] or [np.empty(0, int)]).astype("<u2") for n in (40, 0, 300, 1, 0, 70, 500)]
    block = repair.compress(np.concatenate(docs), np.array(list(map(len, docs))))
    read = repair.Block(block)
    for k, d in enumerate(docs):
        assert read.document(k).tolist() == d.tolist()
    assert len(read.left) > 0 and len(read.seq) < sum(map(len, docs)) / 2
    with pytest.raises(ValueError):
        repair.Block(b"nope" + block[4:])


@pytest.mark.parametrize("least_use", [2, 5])
def test_repair_goes_on_until_no_pair_repeats(least_use):
    rng = np.random.default_rng(6)
    docs = [np.minimum(rng.zipf(1.3, n), 400) for n in rng.integers(0, 900, 30)] + [np.zeros(700, int), np.ones(3, int), np.tile([4, 5, 6], 50)]
    lengths = np.array(list(map(len, docs)))
    read = repair.Block(repair.compress(np.concatenate(docs), lengths, least_use))
    assert read.ids().tolist() == np.concatenate(docs).tolist()
    seen = {}
    for k in range(len(docs)):
        later = int(read.starts[k + 1]) if k + 1 < len(docs) else len(read.seq)
        own, at = read.seq[int(read.starts[k]) : later].tolist(), 0
        while at + 1 < len(own):
            seen[tuple(own[at : at + 2])] = seen.get(tuple(own[at : at + 2]), 0) + 1
            at += 2 if own[at : at + 2] == own[at + 1 : at + 3] else 1
    assert max(seen.values()) < least_use
    for k in (0, 29, 30, 31, 32):
        assert read.document(k).tolist() == docs[k].tolist()


def test_repair_files_keep_rows_of_repeated_and_null_ids(spark):
    path = default_path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    rows = [(7, "b b"), (7, "a"), (None, "n"), (7, "a"), (None, None), (3, "c " * 900 + "d")]
    folder = repair.write_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), path)
    got = repair.read_documents(spark, folder).orderBy("start").collect()
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    assert [(r["doc_id"], r["ids"]) for r in got] == [(d, [*library.encode(t or "", add_special_tokens=False).ids, 0]) for d, t in want]
    assert got[-1]["start"] == sum(r["n_tokens"] for r in got[:-1])


def greedy(vocabulary, word):
    n = at = 0
    while at < len(word):
        end = max(e for e in range(at + 1, len(word) + 1) if word[at:e] in vocabulary)
        n, at = n + 1, end
    return n


def test_longest_match_counts_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    vocabulary = {bytes([c]) for c in range(256)} | {bytes(rng.choice(list(b" abc"), rng.integers(2, 7)).tolist()) for _ in range(120)}
    automaton = longest_match.Automaton(sorted(vocabulary))
    words = [bytes(rng.choice(list(b" abcd"), n).tolist()) for n in rng.integers(0, 90, 400)]
    assert automaton.counts(words).tolist() == [greedy(vocabulary, w) for w in words]
    path = default_path("byte_bpe_50k.tiktoken")
    full = set(longest_match.vocabulary(path))
    got = {r["doc_id"]: (r["n_words"], r["n_tokens"]) for r in longest_match.token_counts(documents(spark, [*ODD[:12], None]), path).collect()}
    for i, t in enumerate([*ODD[:12], None]):
        words = [(" " + w).encode() for w in (t or "").split()]
        if sum(map(len, words)) < 3000:
            assert got[i] == (len(words), sum(greedy(full, w) for w in words))
