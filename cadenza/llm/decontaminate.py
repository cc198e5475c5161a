"""Benchmark decontamination by suffix arrays over the training documents.

The documents are cut into shards (``SHARD_BYTES`` of text each). In a shard, words become the test
vocabulary's ranks, and every suffix that can match a window at all (it begins with enough words of
that vocabulary in a row) goes into a suffix array, sorted by prefix doubling. Every window of every
test suffix is then binary-searched in it, all windows at once. The matched range of the array gives
the locations. Matches at neighbouring places of a document and of one item, in step, join into the
longest verbatim matches, each with its item and both places (``verbatim``). Without regard to items,
the hit words join into stretches (``matches``), which may run over several items' text.

A test item's windows are its runs of ``size`` words; an item of fewer words, but not none, is one
window. Nothing depends on where shards are cut, as no document is in two.

The test items are broadcast in blocks of about ``BLOCK_BYTES`` of text; with more than one, each is
a pass over the documents that unites its hits with those so far (written out after every fourth), so
a benchmark of any size is matched in bounded memory.

Null texts have no words. An item with a null id counts for hits and verbatim matches (as null) but
is not listed. Repeated ids are listed once; each of their rows has its own verbatim matches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import arrow
from .shared import kept
from .words import ALNUM_FOLDED

BLOCK_BYTES = 2 << 20
SHARD_BYTES = 4 << 20


@dataclass
class Tests:
    """A block of test items: distinct windows by length, and the items of each window."""

    vocabulary: np.ndarray  # sorted values of the words
    windows: dict[int, np.ndarray]  # length -> distinct rows of ranks (1 .. len(vocabulary)), sorted
    items: dict[int, list[list[str]]]  # length -> for each row the ids of its items
    names: list[str | None]  # the items' ids
    places: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]  # length -> items' numbers and first words by window, where each window's begin


def tests_of(rows: list[tuple[str | None, str]], size: int) -> Tests:
    data, at = arrow.text_bytes(pa.array([t for _, t in rows], pa.large_string()))
    starts, _, edge = ALNUM_FOLDED.spans(data, at)
    vocabulary, ranks = np.unique(ALNUM_FOLDED.values(data, starts), return_inverse=True)
    ranks = ranks.reshape(-1).astype(np.int64) + 1
    found: dict[int, list] = {}
    for i, (name, _) in enumerate(rows):
        own = ranks[edge[i] : edge[i + 1]]
        if len(own):
            n = min(size, len(own))
            found.setdefault(n, []).append((np.lib.stride_tricks.sliding_window_view(own, n), name, i))
    out = Tests(vocabulary, {}, {}, [name for name, _ in rows], {})
    for n, parts in found.items():
        every = np.concatenate([w for w, _, _ in parts])
        out.windows[n], which = np.unique(every, axis=0, return_inverse=True)
        which = which.reshape(-1)
        order = np.argsort(which, kind="stable")
        item = np.concatenate([np.full(len(w), i) for w, _, i in parts])
        word = np.concatenate([np.arange(len(w)) for w, _, _ in parts])
        out.places[n] = item[order], word[order], np.searchsorted(which[order], np.arange(len(out.windows[n]) + 1))
        names: list[set] = [set() for _ in range(len(out.windows[n]))]
        k = 0
        for w, name, _ in parts:
            for u in which[k : k + len(w)]:
                if name is not None:
                    names[u].add(name)
            k += len(w)
        out.items[n] = [sorted(x) for x in names]
    return out


class Shard:
    """The suffix array of those word positions from which at least ``least`` words of the vocabulary follow."""

    def __init__(self, values: np.ndarray, rows: np.ndarray, vocabulary: np.ndarray, least: int):
        place = np.searchsorted(vocabulary, values)
        place[place == len(vocabulary)] = 0
        known = vocabulary[place] == values if len(vocabulary) else np.zeros(len(values), bool)
        stop = ~known
        # the first word from each one on that is unknown or of the next row
        edges = np.unique(np.concatenate([np.flatnonzero(stop), rows[1:]]))
        at = np.flatnonzero(known)
        run = edges[np.searchsorted(edges, at, side="right")] - at if len(at) else at
        self.at = at[run >= least]
        self.run = run[run >= least]
        # the text of the suffixes: the words that any of them reaches, a zero after each run
        self.ranks = np.where(known, place + 1, 0)
        self._sort()

    def _sort(self) -> None:
        n = len(self.at)
        if not n:
            self.order = self.length = np.zeros(0, np.int64)
            return
        # positions that suffixes reach: each run's tail, too
        keep = np.zeros(len(self.ranks) + 1, np.int32)
        np.add.at(keep, self.at, 1)
        np.add.at(keep, self.at + self.run, -1)
        text = np.flatnonzero(np.cumsum(keep[:-1]) > 0)
        self.length = np.zeros(len(self.ranks), np.int64)
        self.length[self.at] = self.run
        # words left in the run at each kept place: what its suffix has, or what the last suffix before it has left
        place = np.arange(len(text))
        source = np.maximum.accumulate(np.where(self.length[text] > 0, place, -1))
        rest = self.length[text][source] - (place - source)
        rank = self.ranks[text]
        step = 1
        while step < int(rest.max()):
            after = np.zeros(len(rank), np.int64)
            ok = np.flatnonzero(rest > step)
            after[ok] = rank[ok + step]
            pair = rank * (int(rank.max()) + 1) + after
            _, new = np.unique(pair, return_inverse=True)
            rank, step = new.reshape(-1) + 1, step * 2
        where = np.searchsorted(text, self.at)
        self.order = self.at[np.argsort(rank[where], kind="stable")]

    def find(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Binary search: where each window's range of the array begins and ends."""
        m, n = windows.shape
        bounds = []
        for right in (False, True):
            low, high = np.zeros(m, np.int64), np.full(m, len(self.order), np.int64)
            while True:
                open_ = np.flatnonzero(low < high)
                if not len(open_):
                    break
                mid = (low[open_] + high[open_]) // 2
                start = self.order[mid]
                offset = np.arange(n)
                at = np.minimum(start[:, None] + offset, len(self.ranks) - 1)
                words = np.where(offset < self.length[start][:, None], self.ranks[at], 0)
                differs = words != windows[open_]
                first = differs.argmax(axis=1)
                some = differs.any(axis=1)
                pick = np.arange(len(open_))
                less = np.where(some, words[pick, first] < windows[open_][pick, first], right)
                low[open_[less]] = mid[less] + 1
                high[open_[~less]] = mid[~less]
            bounds.append(low)
        return bounds[0], bounds[1]


def search(values: np.ndarray, rows: np.ndarray, tests: Tests) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray, int]]]:
    """Which words are hit, and (positions, windows' numbers, length) of the matches."""
    hit = np.zeros(len(values) + 1, np.int64)
    found = []
    if not tests.windows or not len(values):
        return hit[:-1] > 0, found
    shard = Shard(values, rows, tests.vocabulary, min(tests.windows))
    if not len(shard.order):
        return hit[:-1] > 0, found
    for n, windows in tests.windows.items():
        low, high = shard.find(windows)
        count = high - low
        which = np.repeat(np.arange(len(windows)), count)
        at = shard.order[np.repeat(low, count) + np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)]
        np.add.at(hit, at, 1)
        np.add.at(hit, at + n, -1)
        if len(at):
            found.append((at, which, n))
    return np.cumsum(hit[:-1]) > 0, found


def longest(place: np.ndarray, which: np.ndarray, n: int, tests: Tests, rows: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
    """(row, item's number, item's first word, document's first word, words) of each longest verbatim match.

    A match that can't be longer is a run of windows at neighbouring places on both sides.
    """
    items, words, begin = tests.places[n]
    count = begin[which + 1] - begin[which]
    take = np.repeat(begin[which], count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    at, item, word = np.repeat(place, count), items[take], words[take]
    row = np.searchsorted(rows, at, side="right") - 1
    order = np.lexsort((at, at - word, item, row))
    row, item, word, at = row[order], item[order], word[order], at[order]
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(row) != 0) | (np.diff(item) != 0) | (np.diff(at) != 1) | (np.diff(word) != 1)
    first = np.flatnonzero(new)
    length = np.diff(np.concatenate([first, [len(at)]])) + n - 1
    yield from zip(row[first].tolist(), item[first].tolist(), word[first].tolist(), (at[first] - rows[row[first]]).tolist(), length.tolist(), strict=True)


def blocks(benchmark: DataFrame, item: str, text: str, budget: int) -> Iterator[list[tuple[str | None, str]]]:
    some, used = [], 0
    for r in benchmark.select(F.col(item).cast("string").alias("i"), F.col(text).alias("t")).filter("t is not null").toLocalIterator():
        some.append((r["i"], r["t"]))
        used += len(r["t"])
        if used > budget:
            yield some
            some, used = [], 0
    if some:
        yield some


def match(
    df: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", size: int = 10, budget: int = BLOCK_BYTES
) -> DataFrame:
    """``df`` with what each whole text shares with the benchmark.

    ``n_words``, ``n_hit`` (words inside any occurring window), ``items`` (sorted ids, as strings, of the
    items with occurring windows), ``matches`` (the stretches of hit words: first word, words), ``verbatim``
    (the longest verbatim matches, by place: item, the item's first word, the document's first word, words).
    Columns of ``df`` with these names are replaced.
    """
    context = df.sparkSession.sparkContext
    out, done, sent = df, 0, []
    for rows in blocks(benchmark, item, item_text, budget):
        sent.append(context.broadcast(tests_of(rows, size)))
        out = _pass(out, sent[-1], text, done > 0)
        done += 1
        if done % 4 == 0:
            out = kept(out)
            while sent:  # written out: they aren't needed again
                sent.pop().destroy()
    return out if done else _pass(out, context.broadcast(tests_of([], size)), text, False)


def _pass(df: DataFrame, told: Broadcast, text: str, more: bool) -> DataFrame:
    """One block's matches; with ``more`` they are united with those that ``df`` already has."""

    def make():
        tests: Tests = told.value

        def work(part: pa.RecordBatch) -> list:
            column = lambda name: part.column(part.schema.get_field_index(name))
            data, at = arrow.text_bytes(column(text))
            starts, _, rows = ALNUM_FOLDED.spans(data, at)
            hit, found = search(ALNUM_FOLDED.values(data, starts), rows, tests)
            names: list[set] = [set(x) for x in column("items").to_pylist()] if more else [set() for _ in range(part.num_rows)]
            if more:
                for first, spans in zip(rows, column("matches").to_pylist(), strict=False):
                    for s in spans:
                        hit[first + s["first"] : first + s["first"] + s["words"]] = True
            verbatim: list[list[dict]] = [list(x) for x in column("verbatim").to_pylist()] if more else [[] for _ in range(part.num_rows)]
            for place, which, n in found:
                for r, i, word, first, length in longest(place, which, n, tests, rows):
                    verbatim[r].append({"item": tests.names[i], "item_first": word, "first": first, "words": length})
                row = np.searchsorted(rows, place, side="right") - 1
                for r, w in np.unique(np.stack([row, which]), axis=1).T:
                    names[r].update(tests.items[n][w])
            total = np.concatenate([[0], np.cumsum(hit)])
            n_hit = total[rows[1:]] - total[rows[:-1]]
            stretches: list[list[dict]] = [[] for _ in range(part.num_rows)]
            for r in np.flatnonzero(n_hit):
                own = np.concatenate([[0], hit[rows[r] : rows[r + 1]].astype(np.int8), [0]])
                step = np.diff(own)
                stretches[r] = [{"first": int(a), "words": int(b - a)} for a, b in zip(np.flatnonzero(step == 1), np.flatnonzero(step == -1), strict=True)]
            return [pa.array(np.diff(rows)), pa.array(n_hit), pa.array([sorted(x) for x in names], pa.list_(pa.string())), pa.array(stretches, kind), pa.array([sorted(x, key=by_place) for x in verbatim], exact)]

        return work

    kind = pa.list_(pa.struct([("first", pa.int32()), ("words", pa.int32())]))
    exact = pa.list_(pa.struct([("item", pa.string()), ("item_first", pa.int32()), ("first", pa.int32()), ("words", pa.int32())]))
    by_place = lambda m: (m["first"], m["words"], m["item"] or "", m["item_first"])
    whole = T.StructType([T.StructField("item", T.StringType()), *[T.StructField(c, T.IntegerType()) for c in ("item_first", "first", "words")]])
    struct = T.StructType([T.StructField("first", T.IntegerType()), T.StructField("words", T.IntegerType())])
    fields = [T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("matches", T.ArrayType(struct)), T.StructField("verbatim", T.ArrayType(whole))]
    return arrow.with_columns(df, text, fields, make, budget=SHARD_BYTES)


def decontaminate(df: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """``df``'s rows that share no window with the benchmark, with ``df``'s columns."""
    return match(df, benchmark, **how).filter(F.col("n_hit") == 0).select(*df.columns)
