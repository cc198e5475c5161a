"""Substring dedup with difference-cover anchors.

A window is ``size`` consecutive words of one text; a word goes if any window that covers it also
starts anywhere else. Hashing every window would move a key for each word. Instead short windows are
hashed at cover positions only: those whose place in the text, modulo a period, is in a difference
cover. Any two places have an offset below the period at which both are cover positions; so two equal
windows share an anchor at the same offset in them, and every repeated window holds an anchor that
recurs. Only around recurring anchors the match is extended: the full windows that contain them are
hashed to 128 bits and counted, which settles each window whatever led to it.

Texts are dealt to blocks by a hash of the row. Anchors and windows go to hash ranges and back to the
blocks that have them, so a passage that thousands of texts share costs an entry a block. Two equal
windows of a block count as two. No pair is ever formed.

Null texts have no words; texts of fewer than ``size`` words lose none; all are returned.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import arrow
from . import packed as px
from .words import SPACED, windows

BLOCK_CHARS = 4_000_000
#: Difference covers: for each period, places whose differences give every residue.
COVERS = {1: (0,), 3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 6, 8, 18), 31: (0, 1, 3, 8, 12, 18)}


def cover_for(size: int) -> tuple[int, tuple[int, ...]]:
    """The longest period that leaves anchors of two fifths of the window."""
    period = max(p for p in COVERS if p == 1 or p <= 0.6 * size)
    return period, COVERS[period]


class Texts:
    """The words of some rows, their values, and how many windows each row has room for."""

    def __init__(self, column: pa.Array, size: int):
        self.data, self.at = arrow.text_bytes(column)
        self.starts, self.ends, self.rows = SPACED.spans(self.data, self.at)
        self.values = SPACED.values(self.data, self.starts)
        self.size = size
        n = np.diff(self.rows)
        self.first = np.repeat(self.rows[:-1], n)  # of each word's row
        self.left = np.repeat(self.rows[1:], n) - np.arange(len(self.values))  # words to the row's end

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Cover positions in rows of at least one window, and the hash of the short window at each."""
        period, cover = cover_for(self.size)
        short = self.size - period + 1
        chosen = np.zeros(period, bool)
        chosen[list(cover)] = True
        place = np.arange(len(self.values)) - self.first
        at = np.flatnonzero(chosen[place % period] & (self.left >= short) & (place + self.left >= self.size))
        return at, windows(self.values, short)[at] if len(at) else np.zeros(0, np.uint64)

    def candidates(self, anchors: np.ndarray) -> np.ndarray:
        """Starts of the windows that contain one of the anchors."""
        period, _ = cover_for(self.size)
        low = np.maximum(anchors - (period - 1), self.first[anchors])
        high = np.minimum(anchors, anchors + self.left[anchors] - self.size)
        keep = low <= high
        mark = np.zeros(len(self.values) + 1, np.int64)
        np.add.at(mark, low[keep], 1)
        np.add.at(mark, high[keep] + 1, -1)
        return np.flatnonzero(np.cumsum(mark[:-1]) > 0)

    def keys(self, starts: np.ndarray) -> np.ndarray:
        if not len(starts):
            return np.zeros((0, 2), np.uint64)
        return np.stack([windows(self.values, self.size, 2)[starts], windows(self.values, self.size, 3)[starts]], axis=1)

    def covered(self, starts: np.ndarray) -> np.ndarray:
        mark = np.zeros(len(self.values) + 1, np.int64)
        mark[starts] += 1
        np.add.at(mark, starts + self.size, -1)
        return np.cumsum(mark[:-1]) > 0

    def without(self, gone: np.ndarray) -> pa.Array:
        """Each row's remaining words, joined by one space."""
        word = np.flatnonzero(~gone)
        row = np.searchsorted(self.rows, word, side="right") - 1
        size = self.ends[word] - self.starts[word]
        last = np.ones(len(word), bool)
        last[:-1] = row[1:] != row[:-1]
        width = size + ~last
        to = np.concatenate([[0], np.cumsum(width)])
        source = np.repeat(self.starts[word] - to[:-1], width) + np.arange(to[-1])
        out = self.data[np.minimum(source, max(len(self.data) - 1, 0))] if len(word) else np.zeros(0, np.uint8)
        out[to[1:][~last] - 1] = 0x20
        edge = to[np.searchsorted(row, np.arange(len(self.rows)))]
        return pa.LargeStringArray.from_buffers(len(self.rows) - 1, pa.py_buffer(edge.astype(np.int64).tobytes()), pa.py_buffer(out.tobytes())).cast(pa.string())


def _inside(keys: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which rows of ``keys`` are among the ordered rows ``known``."""
    if not len(known) or not len(keys):
        return np.zeros(len(keys), bool)
    low, high = np.searchsorted(known[:, 0], keys[:, 0]), np.searchsorted(known[:, 0], keys[:, 0], side="right")
    if keys.shape[1] == 1:
        return high > low
    found = np.zeros(len(keys), bool)
    for step in range(int((high - low).max())):
        at = np.minimum(low + step, len(known) - 1)
        found |= (low + step < high) & (known[at, 1] == keys[:, 1])
    return found


def remove_repeats(df: DataFrame, text: str = "text", size: int = 35, kept: str = "kept", n_words: str = "n_words", n_removed: str = "n_removed") -> DataFrame:
    """``df`` with each text's remaining words, the number of its words and of those removed.

    Columns of ``df`` with these names are replaced; rows come in no order.
    """
    spark = df.sparkSession
    arrow.small_batches(spark)
    fields = [T.StructField(kept, T.StringType()), T.StructField(n_words, T.LongType()), T.StructField(n_removed, T.LongType())]
    new = {f.name.lower() for f in fields} | {"__block"}
    passed = [f for f in df.schema.fields if f.name.lower() not in new]
    parts = px.partitions(spark)
    chars = df.agg(F.sum(F.length(text))).first()[0] or 0
    number = max(2 * parts, math.ceil(chars / BLOCK_CHARS))
    names = [f.name for f in passed]
    docs = df.select(*[F.col(f"`{n}`") for n in names], px.block_of(number, *names).alias("__block")).repartition(parts, "__block")

    def pack(block: int, found: list[np.ndarray], width: int) -> pa.Table:
        keys = np.concatenate([*found, np.zeros((0, width), np.uint64)])
        part, blob = px.packed(px.at_most_twice(px.ordered(keys)), parts)
        return pa.table([pa.array(part, pa.int32()), pa.array([block] * len(part), pa.int32()), pa.array(blob, pa.binary())], names=["part", "block", "blob"])

    def pieces(table: pa.Table, name: str):
        for batch in table.combine_chunks().to_batches():
            yield from arrow.slices(batch, name)

    def anchor_keys(table: pa.Table) -> pa.Table:
        found = [Texts(p.column(p.schema.get_field_index(text)), size).anchors()[1].reshape(-1, 1) for p in pieces(table, text)]
        return pack(table.column("__block")[0].as_py(), found, 1)

    def known_of(table: pa.Table, width: int) -> np.ndarray:
        return px.ordered(px.unpacked(table.column("blob").to_pylist(), width))

    def window_keys(table: pa.Table, again: pa.Table) -> pa.Table:
        if not table.num_rows or not again.num_rows:
            return pack(0, [], 2)
        known, found = known_of(again, 1), []
        for p in pieces(table, text):
            some = Texts(p.column(p.schema.get_field_index(text)), size)
            at, keys = some.anchors()
            found.append(some.keys(some.candidates(at[_inside(keys.reshape(-1, 1), known)])))
        return pack(table.column("__block")[0].as_py(), found, 2)

    def cut(table: pa.Table, again: pa.Table) -> pa.Table:
        known = known_of(again, 2) if again.num_rows else np.zeros((0, 2), np.uint64)
        made = []
        for p in pieces(table, text):
            some = Texts(p.column(p.schema.get_field_index(text)), size)
            gone = np.zeros(len(some.values), bool)
            if len(known):
                at = np.flatnonzero(some.left >= size)
                gone = some.covered(at[_inside(some.keys(at), known)])
            total = np.concatenate([[0], np.cumsum(gone)])
            made.append(pa.RecordBatch.from_arrays([*[p.column(p.schema.get_field_index(n)) for n in names], some.without(gone), pa.array(np.diff(some.rows)), pa.array(total[some.rows[1:]] - total[some.rows[:-1]])], names=[*names, *[f.name for f in fields]]))
        return pa.Table.from_batches(made) if made else pa.table([pa.array([], s.type) for s in schema_of(table)], names=[*names, *[f.name for f in fields]])

    def schema_of(table: pa.Table) -> list[pa.Field]:
        return [*[table.schema.field(n) for n in names], *[pa.field(n, t) for n, t in ((kept, pa.string()), (n_words, pa.int64()), (n_removed, pa.int64()))]]

    keys = "part int, block int, blob binary"
    # all three passes read the same columns, so that they share one exchange of the texts
    repeated = px.recurring(docs.groupBy("__block").applyInArrow(anchor_keys, keys), parts, 1)
    repeated = px.recurring(_together(docs, repeated, parts, window_keys, keys), parts, 2)
    return _together(docs, repeated, parts, cut, T.StructType(passed + fields))


def _together(docs: DataFrame, found: DataFrame, parts: int, work: Callable, schema) -> DataFrame:
    """``work`` on each block's rows and what was found for it."""
    return docs.groupBy("__block").cogroup(found.repartition(parts, "block").groupBy("block")).applyInArrow(work, schema)
