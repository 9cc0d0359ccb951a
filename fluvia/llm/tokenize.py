"""Piece-wise exact encoding with a public tokenizer.

``PieceMemo`` keeps the ids of text pieces that are safe to encode on their own, so a piece that occurs
again anywhere in a worker's input costs one dictionary look-up.  Its size is bounded; a full memo is emptied.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterable

import numpy as np

from fluvia.llm.common import kept

#: White space to Unicode other than space and line feed: fixed values.
_OTHER_SPACE = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_PLAIN_SPACE = re.compile("[ \t\n\r]+")

MEMO_PIECES = 150_000
MEMO_PIECE_CHARS = 64


def default_path(name: str) -> str:
    """Where the installed package of public tokenizer files keeps ``name``."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _only_plain(text: str) -> bool:
    """Whether the text has no white space but spaces and line feeds."""
    if any(c in text for c in "\t\r\x0b\x0c\x1c\x1d\x1e\x1f"):
        return False
    return text.isascii() or not _OTHER_SPACE.search(text)


def words_of(text: str) -> list[str]:
    """Words between plain white space; other white space stays inside a word."""
    if _only_plain(text):
        return text.split()
    return [w for w in _PLAIN_SPACE.split(text) if w]


def plainly_spaced(text: str) -> bool:
    """Whether pieces that begin at single spaces are whole byte-level pre-tokens, whatever stands beside them.

    Not so where a run of white space may be one pre-token across a piece's end.
    """
    return not ("  " in text or "\n \n" in text or text[:1] == " " or text[-1:] == " ") and _only_plain(text)


def _stands_apart(letter: str) -> bool:
    """Whether a mark behind this letter is a pre-token of its own, whatever the file's normaliser makes of the letter."""
    return letter.isalpha() and letter < "\u0250" and len(letter.lower()) == 1


class PieceMemo(dict):
    """piece -> ids as little-endian uint16 bytes.

    Two generations bound it: a full one becomes the old one, and what is used again comes back from there.
    """

    def __init__(self, path: str):
        super().__init__()
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.old: dict[str, bytes] = {}
        self.points = {c: self.whole(c) for c in ".,"}

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece) or self.whole(piece)
        if len(piece) <= MEMO_PIECE_CHARS:
            self[piece] = ids
        return ids

    def learn(self, pieces: Iterable[str]) -> None:
        """Encode the pieces not known yet, in one call.

        A full stop or comma after a letter that stays one letter in lower case is a pre-token of its own, so such a
        piece follows from its stem.
        """
        if len(self) > MEMO_PIECES:
            self.old = dict(self)
            self.clear()
        old = self.old
        new: list[str] = []
        pointed: list[str] = []
        for p in set(pieces).difference(self):
            if p in old:
                self[p] = old[p]
            elif len(p) > MEMO_PIECE_CHARS:
                continue
            elif p[-1:] in self.points and _stands_apart(p[-2:-1]):
                pointed.append(p)
                if (stem := p[:-1]) not in self:
                    new.append(stem)
                    self[stem] = old.get(stem, b"")
            else:
                new.append(p)
        new = [p for p in dict.fromkeys(new) if not self.get(p)]
        self.update(zip(new, [array("H", code.ids).tobytes() for code in self.tokenizer.encode_batch_fast(new, add_special_tokens=False)], strict=True))
        for p in pointed:
            self[p] = self[p[:-1]] + self.points[p[-1]]

    def whole(self, text: str) -> bytes:
        return array("H", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()


#: Entries of a hashed memo, and bytes of text that it looks up at once.
HASHED_PIECES, HASHED_BYTES = 400_000, 1 << 20
_SLOT_BITS = 21
#: Longest piece that the memo takes, in bytes.
HASHED_PIECE = 256
_RNG = np.random.default_rng(4242)
_SIGN_CODES = _RNG.integers(0, 1 << 64, HASHED_PIECE << 8, dtype=np.uint64), _RNG.integers(0, 1 << 32, HASHED_PIECE << 8, dtype=np.uint32)
_NO_RANK = np.int32(1 << 30)
# Kinds of bytes: 1 letter, 2 and 3 first and second byte of the letters U+00C0 to U+00FF, 4 mark, 5 space, 6 digit, 7 line
# feed; 0 others, and apostrophes and angle brackets, which begin contractions and special tokens.
_KIND = np.zeros(256, np.uint8)
_KIND[33:127], _KIND[48:58] = 4, 6
_KIND[65:91] = _KIND[97:123] = 1
_KIND[0xC3], _KIND[0x80:0xC0], _KIND[32], _KIND[10] = 2, 3, 5, 7
_KIND[[39, 60, 0x97, 0xB7]] = 0
_RUN = np.array([0, 1, 1, 1, 4, 5, 6, 7], np.uint8)


def _piece_hashes(data: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64 and 32 bits of hash of each piece of ``data``: sums of a random number for each byte at its place."""
    at = np.arange(len(data), dtype=np.int32)
    at -= np.repeat(begins.astype(np.int32), lengths)
    at <<= 8
    at |= data
    return np.add.reduceat(_SIGN_CODES[0][at], begins), np.add.reduceat(_SIGN_CODES[1][at], begins)


class Merger:
    """Byte-pair merges of many pre-tokens side by side: in each round every one of them makes its merge of least rank.

    A merge's parts are made by merges of lower rank, so all places of a pre-token's least rank merge at once.
    """

    BITS = 19

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        # The byte-level alphabet: printable bytes stand for themselves, the others for the characters from U+0100 on.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        alphabet = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
        self.byte_ids = np.array([vocab[alphabet[b]] for b in range(256)], np.int32)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left, right = (np.array([vocab[x[k]] for x in pairs], np.uint32) for k in (0, 1))
        self.made = np.array([vocab[x + y] for x, y in pairs], np.int32)
        self.keys = np.full(1 << self.BITS, 0xFFFFFFFF, np.uint32)
        self.ranks = np.full(1 << self.BITS, _NO_RANK, np.int32)
        keys, rank = left << np.uint32(16) | right, np.arange(len(pairs), dtype=np.int32)
        at = self._slot(keys)
        self.reach = 0
        while len(keys):
            free = self.keys[at] == 0xFFFFFFFF
            self.keys[at[free]], self.ranks[at[free]] = keys[free], rank[free]
            lost = self.keys[at] != keys
            keys, rank, at = keys[lost], rank[lost], (at[lost] + 1) & ((1 << self.BITS) - 1)
            self.reach += 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint32(0x9E3779B1) >> np.uint32(32 - self.BITS)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair's merge."""
        keys = left.astype(np.uint32) << np.uint32(16) | right.astype(np.uint32)
        at = self._slot(keys)
        held = self.keys[at]
        out = np.where(held == keys, self.ranks[at], _NO_RANK)
        todo = np.flatnonzero((held != keys) & (held != 0xFFFFFFFF))
        while len(todo):
            at[todo] = (at[todo] + 1) & ((1 << self.BITS) - 1)
            held = self.keys[at[todo]]
            same = held == keys[todo]
            out[todo[same]] = self.ranks[at[todo[same]]]
            todo = todo[~same & (held != 0xFFFFFFFF)]
        return out

    def merge(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pre-tokens that end before ``ends`` in ``data``, one after another, and how many each has."""
        sym = self.byte_ids[data]
        owner = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
        rank = np.full(len(sym), _NO_RANK, np.int32)
        inner = np.flatnonzero(owner[:-1] == owner[1:])
        rank[inner] = self.rank(sym[inner], sym[inner + 1])
        done_sym, done_owner = [], []
        while len(sym):
            begins = np.flatnonzero(np.diff(owner, prepend=-1))
            least = np.minimum.reduceat(rank, begins)
            over = least == _NO_RANK
            sizes = np.diff(begins, append=len(sym))
            if over.any():
                gone = np.repeat(over, sizes)
                done_sym.append(sym[gone])
                done_owner.append(owner[gone])
                stay = ~gone
                sym, owner, rank = sym[stay], owner[stay], rank[stay]
                least, sizes = least[~over], sizes[~over]
                if not len(sym):
                    break
            hit = rank == np.repeat(least, sizes)
            at = np.flatnonzero(hit)
            # Of overlapping places (a a a) the first, third, ... merge.
            close = np.flatnonzero(np.diff(at) == 1)
            if len(close):
                run = np.concatenate([[True], np.diff(at) != 1])
                offset = np.arange(len(at)) - np.flatnonzero(run)[np.cumsum(run) - 1]
                at = at[offset % 2 == 0]
            sym[at] = self.made[rank[at]]
            stay = np.ones(len(sym), bool)
            stay[at + 1] = False
            at -= np.arange(len(at))
            sym, owner, rank = sym[stay], owner[stay], rank[stay]
            near = np.zeros(len(sym), bool)
            near[at] = near[at[at > 0] - 1] = True
            anew = np.flatnonzero(near)
            last = anew == len(sym) - 1
            rank[anew[last]] = _NO_RANK
            anew = anew[~last]
            inside = owner[anew] == owner[anew + 1]
            rank[anew[~inside]] = _NO_RANK
            anew = anew[inside]
            rank[anew] = self.rank(sym[anew], sym[anew + 1])
        sym, owner = np.concatenate([*done_sym, np.empty(0, np.int32)]), np.concatenate([*done_owner, np.empty(0, np.int64)])
        order = np.argsort(owner, kind="stable")
        return sym[order].astype(np.uint16), np.bincount(owner, minlength=len(ends))


class HashedMemo:
    """Ids of byte-level pieces under two 64-bit hashes, looked up and put together a megabyte of text at a time.

    New pieces of plain signs are merged side by side; the library encodes the others joined, many in one call, which
    are parted again by the bytes that their tokens stand for.  A full memo keeps the half that was used most.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        # In a byte-level file a vocabulary string has one character a byte; an added token stands for its own text.
        added = {i: t.content for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.token_bytes = np.array([len(added[i].encode()) if i in added else len(self.tokenizer.id_to_token(i) or "") for i in range(size)], np.int64)
        self.merger = Merger(path)
        self._empty()

    def _empty(self) -> None:
        self.slots = np.full(1 << _SLOT_BITS, -1, np.int32)
        self.first, self.second = np.empty(0, np.uint64), np.empty(0, np.uint32)
        self.begin, self.size = np.empty(0, np.int64), np.empty(0, np.int64)
        self.uses = np.empty(0, np.int64)
        self.flat = np.empty(0, np.uint16)

    def _find(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Entry of each piece, or -1."""
        at = (first >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)
        found = self.slots[at]
        known = found >= 0
        wrong = np.flatnonzero(known)
        if len(wrong):
            entry = found[wrong]
            wrong = wrong[(self.first[entry] != first[wrong]) | (self.second[entry] != second[wrong])]
        while len(wrong):
            at[wrong] = (at[wrong] + 1) & ((1 << _SLOT_BITS) - 1)
            found[wrong] = entry = self.slots[at[wrong]]
            wrong = wrong[(entry >= 0) & ((self.first[entry] != first[wrong]) | (self.second[entry] != second[wrong]))]
        return found

    def _enter(self, entries: np.ndarray) -> None:
        at = (self.first[entries] >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)
        while len(entries):
            free = self.slots[at] < 0
            self.slots[at[free]] = entries[free]
            lost = self.slots[at] != entries
            entries, at = entries[lost], (at[lost] + 1) & ((1 << _SLOT_BITS) - 1)

    def _shrink(self) -> None:
        """Keep the entries used most; their uses are halved, so that old ones fade."""
        kept = np.sort(np.argsort(-self.uses, kind="stable")[: HASHED_PIECES // 2])
        sizes = self.size[kept]
        flat = self.flat[spans(self.begin[kept], sizes)]
        first, second, uses = self.first[kept], self.second[kept], self.uses[kept] // 2
        self._empty()
        self.first, self.second, self.uses, self.size, self.flat = first, second, uses, sizes, flat
        self.begin = np.cumsum(sizes) - sizes
        self._enter(np.arange(len(kept), dtype=np.int32))

    def _learn(self, first: np.ndarray, second: np.ndarray, whole: bytes, begins: np.ndarray, sizes: np.ndarray) -> None:
        """Add the pieces of ``whole`` at ``begins`` of ``sizes`` bytes."""
        data = np.frombuffer(whole, np.uint8)
        near = spans(begins, sizes)
        kind = _KIND[data[near]]
        ends = np.cumsum(sizes)
        starts = ends - sizes
        unfit = kind == 0
        # A second byte behind each first byte and nowhere else; one line feed behind other signs.
        pair = kind[1:] == 3, kind[:-1] == 2
        unfit[1:] |= (pair[0] != pair[1]) | (kind[1:] == 7) & (kind[:-1] == 7)
        unfit[starts] = (kind[starts] == 0) | (kind[starts] == 3)
        unfit[1:] |= (kind[1:] == 7) & (kind[:-1] == 5)
        fit = ~np.logical_or.reduceat(unfit, starts) & (kind[ends - 1] != 2) & (kind[ends - 1] != 5)
        counts = np.zeros(len(sizes), np.int64)
        parts, members = [], []
        plain = np.flatnonzero(fit)
        if len(plain):
            # A pre-token is a run of letters, of marks or of digits, with the space before it, or a line feed.
            inside = spans(begins[plain], sizes[plain])
            own = _RUN[_KIND[data[inside]]]
            cut = np.concatenate([(own[1:] != own[:-1]) & (own[:-1] != 5), [True]])
            until = np.cumsum(sizes[plain])
            cut[until - 1] = True
            cut = np.flatnonzero(cut) + 1
            ids, each = self.merger.merge(data[inside], cut)
            counts[plain] = np.add.reduceat(each, np.searchsorted(cut, until - sizes[plain], side="right"))
            parts.append(ids)
            members.append(plain)
        other = np.flatnonzero(~fit)
        # What does not begin with a space cannot follow another piece in one text.
        apart = data[begins[other]] != 32
        joined, lone = other[~apart], other[apart]
        calls = [joined[at : at + 1000] for at in range(0, len(joined), 1000)] + [lone[i : i + 1] for i in range(len(lone))]
        span = np.stack([begins, begins + sizes], axis=1).tolist()
        texts = ["".join([whole[x:y].decode("utf-8", "surrogatepass") for x, y in [span[i] for i in own.tolist()]]) for own in calls]
        for own, code in zip(calls, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            got = np.array(code.ids, np.uint16)
            held, until = np.cumsum(self.token_bytes[got]), np.cumsum(sizes[own])
            stops = np.searchsorted(held, until)
            if not len(got) or stops[-1] >= len(got) or (held[stops] != until).any():
                raise ValueError("pieces and their tokens differ in bytes: not a byte-level tokenizer file")
            counts[own] = np.diff(stops, prepend=-1)
            parts.append(got)
            members.append(own)
        order = np.concatenate(members)
        ids = np.concatenate(parts)
        begin = np.empty(len(sizes), np.int64)
        begin[order] = np.cumsum(counts[order]) - counts[order]
        old = len(self.first)
        self.begin = np.concatenate([self.begin, begin + len(self.flat)])
        self.flat = np.concatenate([self.flat, ids])
        self.first, self.second = np.concatenate([self.first, first]), np.concatenate([self.second, second])
        self.size, self.uses = np.concatenate([self.size, counts]), np.concatenate([self.uses, np.zeros(len(sizes), np.int64)])
        self._enter(np.arange(old, len(self.first), dtype=np.int32))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of texts, equal to ``Tokenizer.encode``."""
        out: list[np.ndarray | None] = [None] * len(texts)
        batch, held = {}, 0
        for i, text in enumerate(texts):
            if text and plainly_spaced(text):
                batch[i] = text.encode("utf-8", "surrogatepass")
                held += len(batch[i])
            if held >= HASHED_BYTES or i + 1 == len(texts) and batch:
                for k, ids in zip(batch, self._encode(list(batch.values())), strict=True):
                    out[k] = ids
                batch, held = {}, 0
        return [np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, np.uint16) if ids is None else ids for t, ids in zip(texts, out, strict=True)]

    def _encode(self, texts: list[bytes]) -> list[np.ndarray | None]:
        """Ids of plainly spaced texts; None for one with too long a piece."""
        whole = b"".join(texts)
        data = np.frombuffer(whole, np.uint8)
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
        starts = np.concatenate([[0], ends[:-1]])
        cut = data == 32
        cut[starts] = True
        begins = np.flatnonzero(cut)
        lengths = np.diff(np.concatenate([begins, [len(data)]]))
        if (long := lengths > HASHED_PIECE).any():
            out: list[np.ndarray | None] = [None] * len(texts)
            far = set(np.searchsorted(ends, begins[long], side="right").tolist())
            near = [i for i in range(len(texts)) if i not in far]
            for i, ids in zip(near, self._encode([texts[i] for i in near]) if near else [], strict=True):
                out[i] = ids
            return out
        first, second = _piece_hashes(data, begins, lengths)
        if len(self.first) + len(begins) // 4 > HASHED_PIECES:
            self._shrink()
        entry = self._find(first, second)
        new = np.flatnonzero(entry < 0)
        if len(new):
            _, once = np.unique(first[new], return_index=True)
            once = new[once]
            self._learn(first[once], second[once], whole, begins[once], lengths[once])
            entry[new] = self._find(first[new], second[new])
        self.uses += np.bincount(entry, minlength=len(self.uses))
        sizes = self.size[entry]
        ids = self.flat[spans(self.begin[entry], sizes)]
        counts = np.add.reduceat(sizes, np.searchsorted(begins, starts))
        return np.split(ids, np.cumsum(counts)[:-1])


def spans(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All places of the spans that begin at ``begins``, one span after another."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(begins - (ends - sizes), sizes)


def byte_level_ids(texts: list[str], path: str) -> list[np.ndarray]:
    """Ids (uint16) of whole texts by a byte-level BPE file of fewer than 65536 ids, equal to ``Tokenizer.encode``."""
    held = kept("token files")
    if path not in held:
        held[path] = HashedMemo(path)
    return held[path].encode(texts)


_texts_of_tokens: dict[str, list[str]] = {}


def token_texts(path: str) -> list[str]:
    """Token strings by id, added tokens included."""
    if path not in _texts_of_tokens:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        by_id = {i: t for t, i in model["model"]["vocab"].items()} | {a["id"]: a["content"] for a in model["added_tokens"]}
        _texts_of_tokens[path] = [by_id.get(i, "") for i in range(max(by_id) + 1)]
    return _texts_of_tokens[path]
