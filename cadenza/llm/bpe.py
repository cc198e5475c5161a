"""Byte-level BPE encoding and decoding with a segment tree over the ranks of adjacent pairs.

A piece of text (as the public pre-tokenizer's pattern cuts it) is a row of symbols. The tree's
leaves hold, for each symbol, the rank of the pair that it forms with its right neighbour, with the
position in the low bits; the root is thus the leftmost pair of lowest rank. A merge changes three
leaves at most, each in logarithmic time, so a piece of n bytes costs O(n log n) however long it is.
Pieces of up to ``MANY`` bytes have trees of a few sizes; those of one size are rows of an array and
merge together, one merge a row and step. Longer pieces have a tree each.

Pieces recur, so a task keeps what it has encoded (``STORE_BYTES`` at most, then it starts anew) and
drops it at its end: this changes the time only. Special tokens in a text are taken as the library does
by default: the string of an added token is one token. Null counts as the empty text, which has no ids.
A vocabulary file whose settings ask for anything else than this raises a ValueError.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator, Sequence
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import arrow

STORE_BYTES = 24 << 20
ENTRY_BYTES = 200  # of a stored piece, beside its text and ids
PIECES = 1 << 18  # pieces that are looked up together
MANY = 65
LONG = 1 << 20  # a longer text is cut into pieces step by step
MAX_VOCABULARY_BYTES = 64 << 20
_PATTERN = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
_NONE = 1 << 62
_LOW = (1 << 40) - 1
_U = np.uint64


def byte_letters() -> dict[str, int]:
    """The printable letter of each byte in a byte-level vocabulary: itself, or the next free one from U+0100."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = (b for b in range(256) if b not in plain)
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


def check(told: dict) -> None:
    """Raises a ValueError if a vocabulary file asks for something that isn't done here."""
    model, cut = told["model"], told.get("pre_tokenizer") or {}
    wrong = [name for name in ("normalizer", "truncation", "padding") if told.get(name)]
    wrong += [name for name in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(name)]
    if model.get("type", "BPE") != "BPE":
        wrong.append("model")
    if cut.get("type") != "ByteLevel" or cut.get("add_prefix_space", True) or not cut.get("use_regex", True):
        wrong.append("pre_tokenizer")
    if (told.get("decoder") or {}).get("type") != "ByteLevel":
        wrong.append("decoder")
    if any(t.get(flag) for t in told["added_tokens"] for flag in ("single_word", "lstrip", "rstrip", "normalized")):
        wrong.append("added_tokens")
    if not set(byte_letters()) <= model["vocab"].keys():
        wrong.append("vocab")
    if wrong:
        raise ValueError(f"not plain byte-level BPE: {', '.join(wrong)}")


class Codec:
    """A vocabulary in the tokenizers library's JSON."""

    def __init__(self, text: str):
        told = json.loads(text)
        check(told)
        vocab, letters = told["model"]["vocab"], byte_letters()
        self.size = max([*vocab.values(), *(t["id"] for t in told["added_tokens"])]) + 1
        self.first = [0] * 256
        for letter, b in letters.items():
            self.first[b] = vocab[letter]
        self.ranks, self.merged = {}, []
        for rank, pair in enumerate(told["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks.setdefault(vocab[a] * self.size + vocab[b], rank)
            self.merged.append(vocab[a + b])
        self.added = {t["content"].encode(): np.int32(t["id"]).tobytes() for t in told["added_tokens"]}
        self.cut = regex.compile("|".join(regex.escape(t.decode()) for t in sorted(self.added, key=len, reverse=True))) if self.added else None
        spelled = [b""] * self.size
        for token, i in vocab.items():
            spelled[i] = bytes(map(letters.__getitem__, token))
        for t in told["added_tokens"]:
            spelled[t["id"]] = t["content"].encode()
        self.lengths = np.array([*map(len, spelled)], np.int64)
        self.begins = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(spelled), np.uint8)
        self._arrays()

    def _arrays(self) -> None:
        """The same as ``first``, ``merged`` and ``ranks``, for many pieces at once; the last by open addressing."""
        self.firsts, self.mergeds = np.array(self.first), np.array([*self.merged, 0])
        self.bits = max(4, (4 * len(self.ranks)).bit_length())
        self.slot_key, self.slot_rank = np.full(1 << self.bits, -1), np.full(1 << self.bits, -1)
        keys, ranks = np.array([*self.ranks], np.int64), np.array([*self.ranks.values()], np.int64)
        slot = self._slot(keys)
        while len(keys):
            free = np.flatnonzero(self.slot_key[slot] < 0)
            self.slot_key[slot[free]] = keys[free]
            placed = self.slot_key[slot] == keys
            self.slot_rank[slot[placed]] = ranks[placed]
            keys, ranks, slot = keys[~placed], ranks[~placed], (slot[~placed] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(_U) * _U(0x9E3779B97F4A7C15)) >> _U(64 - self.bits)).astype(np.int64)

    def ranks_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair of symbols; -1 without one."""
        key = a * self.size + b
        slot = self._slot(key)
        have = self.slot_key[slot]
        out = np.where(have == key, self.slot_rank[slot], -1)
        todo = np.flatnonzero((have != key) & (have >= 0))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)
            have = self.slot_key[slot[todo]]
            hit = have == key[todo]
            out[todo[hit]] = self.slot_rank[slot[todo[hit]]]
            todo = todo[~hit & (have >= 0)]
        return out

    def merge_rows(self, raw: list[bytes], leaves: int) -> list[bytes]:
        """The ids of pieces that have at most ``leaves`` (a power of two) adjacent pairs: a tree a row."""
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        rows, width = len(raw), leaves + 1
        symbols = np.full((rows, width), -1)
        shift = np.cumsum(size) - size
        symbols[np.repeat(np.arange(rows), size), np.arange(int(size.sum())) - np.repeat(shift, size)] = self.firsts[np.frombuffer(b"".join(raw), np.uint8)]
        tree = np.full((rows, 2 * leaves), _NONE)
        r, i = np.nonzero(symbols[:, 1:] >= 0)
        rank = self.ranks_of(symbols[r, i], symbols[r, i + 1])
        tree[r, leaves + i] = np.where(rank >= 0, rank << 8 | i, _NONE)
        half = leaves
        while half > 1:
            half //= 2
            tree[:, half : 2 * half] = np.minimum(tree[:, 2 * half : 4 * half : 2], tree[:, 2 * half + 1 : 4 * half : 2])
        right, left = np.tile(np.arange(1, width + 1), rows), np.tile(np.arange(-1, width), rows)
        symbol, node = symbols.reshape(-1), tree.reshape(-1)

        def leaf(place: np.ndarray, a: np.ndarray, b: np.ndarray, some: np.ndarray) -> np.ndarray:
            out = np.full(len(place), _NONE)
            rank = self.ranks_of(a[some], b[some])
            out[some] = np.where(rank >= 0, rank << 8 | place[some], _NONE)
            return out

        live = np.flatnonzero(tree[:, 1] != _NONE)
        while len(live):
            best = tree[live, 1]
            i, at, root = best & 255, live * width, live * 2 * leaves
            j = right[at + i]
            k = right[at + j]
            symbol[at + i], symbol[at + j], right[at + i] = self.mergeds[best >> 8], -1, k
            inner = np.flatnonzero(k < size[live])
            # ``left`` has a place more a row, for the symbol after the last
            left[(live * (width + 1) + k)[inner]] = i[inner]
            h = left[live * (width + 1) + i]
            new = symbol[at + i]
            after = leaf(i, new, symbol[at + np.minimum(k, width - 1)], inner)
            before = leaf(h, symbol[at + np.maximum(h, 0)], new, np.flatnonzero(h >= 0))
            # of three leaves those that aren't there stand for the middle one, which is written last
            h, j = np.where(h >= 0, h, i), np.where(j < leaves, j, i)
            changed = [root + leaves + x for x in (j, h, i)]
            for where, value in zip(changed, (_NONE, before, after), strict=True):
                node[where] = value
            paths, high = [leaves + j, leaves + h, leaves + i], leaves
            while high > 1:
                high //= 2
                paths = [p >> 1 for p in paths]
                for p in paths:
                    node[root + p] = np.minimum(node[root + 2 * p], node[root + 2 * p + 1])
            live = live[node[root + 1] != _NONE]
        there = symbols >= 0
        flat, ends = symbols[there].astype(np.int32).tobytes(), 4 * np.cumsum(there.sum(axis=1))
        return [flat[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def merge_many(self, pieces: list[str]) -> list[bytes]:
        """The ids of each piece, as int32 bytes."""
        raw = [p.encode("utf-8", "replace") for p in pieces]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        out = [b""] * len(raw)
        leaves, least = 1, 0
        while leaves < MANY:
            mine = np.flatnonzero((size > least) & (size <= leaves + 1)).tolist()
            step = (1 << 17) // leaves
            for at in range(0, len(mine), step):
                some = mine[at : at + step]
                for i, ids in zip(some, self.merge_rows([raw[i] for i in some], leaves), strict=True):
                    out[i] = ids
            leaves, least = 2 * leaves, leaves + 1
        for i in np.flatnonzero(size > least).tolist():
            out[i] = np.array(self.merge([*map(self.first.__getitem__, raw[i])]), np.int32).tobytes()
        return out

    def merge(self, symbols: list[int]) -> list[int]:
        """All merges of one piece, lowest rank first, leftmost first among equals."""
        n = len(symbols)
        m = n - 1
        if m < 1:
            return symbols
        ranks, size, merged = self.ranks, self.size, self.merged
        tree = [_NONE] * (2 * m)
        for i in range(m):
            r = ranks.get(symbols[i] * size + symbols[i + 1])
            if r is not None:
                tree[m + i] = r << 40 | i
        for i in range(m - 1, 0, -1):
            a, b = tree[2 * i], tree[2 * i + 1]
            tree[i] = a if a < b else b
        right, left = list(range(1, n + 1)), list(range(-1, m))
        while tree[1] != _NONE:
            best = tree[1]
            i = best & _LOW
            j = right[i]
            k = right[j]
            symbols[i] = merged[best >> 40]
            symbols[j] = -1
            right[i] = k
            changed = [(j, _NONE)] if j < m else []
            if k < n:
                left[k] = i
                r = ranks.get(symbols[i] * size + symbols[k])
                changed.append((i, _NONE if r is None else r << 40 | i))
            else:
                changed.append((i, _NONE))
            h = left[i]
            if h >= 0:
                r = ranks.get(symbols[h] * size + symbols[i])
                changed.append((h, _NONE if r is None else r << 40 | h))
            for leaf, value in changed:
                p = m + leaf
                if tree[p] == value:
                    continue
                tree[p] = value
                while p > 1:
                    other = tree[p ^ 1]
                    p >>= 1
                    if other < value:
                        value = other
                    if tree[p] == value:
                        break
                    tree[p] = value
        return [s for s in symbols if s >= 0]

    def pieces(self, text: str) -> Iterator[list[str | bytes]]:
        """The pieces of a text, some at a time; added tokens as bytes."""
        if self.cut is not None and self.cut.search(text):
            at = 0
            for m in self.cut.finditer(text):
                yield from self._cut(text[at : m.start()])
                yield [m[0].encode()]
                at = m.end()
            text = text[at:]
        yield from self._cut(text)

    def _cut(self, text: str) -> Iterator[list[str | bytes]]:
        if len(text) <= LONG:
            yield _PATTERN.findall(text)
            return
        found = _PATTERN.finditer(text)
        while some := [m[0] for m in islice(found, PIECES)]:
            yield some

    def encode_all(self, texts: Iterable[str], store: Store) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids one after the other, and where each text's begin (one more than texts)."""
        coded: list[bytes] = []
        sizes: list[int] = []
        held: list[tuple[int, list[str | bytes]]] = []
        count = 0
        for row, text in enumerate(texts):
            sizes.append(0)
            for some in self.pieces(text):
                held.append((row, some))
                count += len(some)
                if count >= PIECES:
                    self._look_up(held, coded, sizes, store)
                    held, count = [], 0
        self._look_up(held, coded, sizes, store)
        return np.frombuffer(b"".join(coded), np.int32), np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]) // 4

    def _look_up(self, held: list, coded: list[bytes], sizes: list[int], store: Store) -> None:
        new = [p for p in set().union(*[some for _, some in held]) if p not in store]
        store.add(new, self.merge_many(new))
        for row, some in held:
            coded.append(b"".join(map(store.__getitem__, some)))
            sizes[row] += len(coded[-1])
        store.settle()

    def spell(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bytes of all ids, and where each id's bytes begin (one more than ids)."""
        out = []
        for some in np.array_split(ids, max(1, len(ids) // PIECES)):
            n = self.lengths[some]
            at = np.concatenate([[0], np.cumsum(n)])
            out.append(self.flat[np.repeat(self.begins[some] - at[:-1], n) + np.arange(at[-1])].tobytes())
        return b"".join(out), np.concatenate([[0], np.cumsum(self.lengths[ids])])

    def decode(self, ids: Sequence[int]) -> str:
        return self.spell(np.asarray(ids, np.int64))[0].decode("utf-8", "replace")


class Store(dict):
    """From a piece to its ids, as int32 bytes; added tokens are always in it."""

    def __init__(self, added: dict[bytes, bytes], most: int = STORE_BYTES):
        super().__init__(added)
        self.added, self.most, self.used = added, most, 0

    def add(self, pieces: list[str], ids: list[bytes]) -> None:
        self.update(zip(pieces, ids, strict=True))
        self.used += ENTRY_BYTES * len(pieces) + sum(map(len, pieces)) + sum(map(len, ids))

    def settle(self) -> None:
        """Starts anew if there is too much."""
        if self.used > self.most:
            self.clear()
            self.update(self.added)
            self.used = 0


_codecs: dict[bytes, Codec] = {}


def codec(text: str) -> Codec:
    """The codec of a vocabulary; a worker keeps one between tasks: tables of the vocabulary's size and nothing that grows."""
    key = hashlib.sha256(text.encode()).digest()
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(text)
    return _codecs[key]


def read_vocabulary(path: str) -> str:
    """The vocabulary file, read on the driver; over ``MAX_VOCABULARY_BYTES`` it raises, as it is broadcast."""
    with open(path, encoding="utf-8") as f:
        text = f.read(MAX_VOCABULARY_BYTES + 1)
    if len(text) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} is larger than {MAX_VOCABULARY_BYTES} bytes")
    return text


def encode_decode(df: DataFrame, vocabulary: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``df`` with the ids of each whole text and the text that those ids decode to.

    ``vocabulary``: path of a byte-level BPE file of the tokenizers library. Null and empty texts get
    no ids and the empty text. Repeated rows stay. Columns named as the new ones are replaced.
    """
    told = df.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))

    def make():
        known = codec(told.value)
        store = Store(known.added)

        def work(part: pa.RecordBatch) -> list:
            data, at = arrow.text_bytes(part.column(part.schema.get_field_index(text)))
            flat, ends = known.encode_all((arrow.row_text(data, at, i) for i in range(part.num_rows)), store)
            raw, begins = known.spell(flat)
            texts = [raw[begins[a] : begins[b]].decode("utf-8", "replace") for a, b in zip(ends[:-1], ends[1:], strict=True)]
            return [arrow.lists(flat, ends), pa.array(texts, pa.string())]

        return work

    fields = [T.StructField(ids, T.ArrayType(T.IntegerType(), False)), T.StructField(decoded, T.StringType())]
    return arrow.with_columns(df, text, fields, make)
