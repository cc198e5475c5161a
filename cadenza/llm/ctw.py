"""Language-model scoring by context-tree weighting over bytes.

A text is scored as its words, A-Z folded, each followed by one blank and the last by a line end (an
empty text is the line end alone); no word holds either byte, so this is a distribution over word
sequences. Each byte is eight binary decisions. Every decision, told apart by the bits before it, has
a context tree over the up to ``depth`` bytes before the byte (line ends before the text). A node of
the tree mixes the Krichevsky-Trofimov estimate of its own counts with what its children say, half to
half a priori and by their likelihood on the training bytes a posteriori; where training never saw the
longer context, the node's own estimate stands alone.

All counts are of the whole training texts. Runs of depth + 1 bytes are counted in each task and go,
packed, to hash ranges, which add up. Only then, each distinct run once, they go to the partition of their two
latest context bytes; such a partition holds whole subtrees and computes their weights bottom-up. So the
commonest pair of bytes is as large as its distinct runs are, however often they occur. What is above
(contexts of one byte and none) is one table of 256 x 256 numbers whatever the corpus; it is the only
thing that is broadcast. Texts are dealt to blocks. Each block asks the hash ranges for the runs that occur
in it; these ask the subtrees for each run once, hand the probabilities back to the blocks, and the block
adds them up for each text. So the model grows with the corpus and stays distributed.

Word counts for the unigram base go the same way, but for the subtrees.

Null texts are empty texts. Without training texts every byte has probability 1/256.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import arrow
from . import packed as px
from .shared import kept
from .words import SPACED_FOLDED, mix

DEPTH = 5  # of 7 at most: a run is a 64-bit key
TOP = 2  # context bytes that choose the partition
BLOCK_CHARS = 24_000_000
BLANK, END = 0x20, 0x0A
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] = _FOLD[97:123]
_U = np.uint64


def log_gamma(x: np.ndarray) -> np.ndarray:
    """log of the gamma function for x >= 1/2, by Stirling's series at x + 7."""
    y, product = x + 7.0, np.ones_like(x)
    for i in range(7):
        product = product * (x + i)
    z = 1 / (y * y)
    series = (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z / 1680))) / y
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + series - np.log(product)


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """log of the Krichevsky-Trofimov probability of n0 zeros and n1 ones."""
    return log_gamma(n0 + 0.5) + log_gamma(n1 + 0.5) - log_gamma(n0 + n1 + 1.0) - math.log(math.pi)


class Streams:
    """The canonical bytes of some rows, and the run of depth + 1 bytes that ends in each."""

    def __init__(self, column: pa.Array, depth: int):
        data, at = arrow.text_bytes(column)
        starts, ends, self.rows = SPACED_FOLDED.spans(data, at)
        self.words = SPACED_FOLDED.values(data, starts)
        n = np.diff(self.rows)
        width = ends - starts + 1
        total = np.concatenate([[0], np.cumsum(width)])
        own = total[self.rows[1:]] - total[self.rows[:-1]]
        own[n == 0] = 1
        self.at = np.concatenate([[0], np.cumsum(own)])  # of each row's own bytes
        # every row is laid out as depth line ends and its own bytes
        begin = self.at[:-1] + depth * np.arange(1, len(n) + 1)
        out = np.full(int(self.at[-1]) + depth * len(n), END, np.uint8)
        if len(starts):
            to = total[:-1] + np.repeat(begin - total[self.rows[:-1]], n)
            size = ends - starts
            shift = np.cumsum(size) - size
            flat = np.arange(int(size.sum()))
            out[flat + np.repeat(to - shift, size)] = _FOLD[data[flat + np.repeat(starts - shift, size)]]
            out[to + size] = BLANK
            last = self.rows[1:][n > 0] - 1
            out[to[last] + size[last]] = END
        m = len(out) - depth
        key = np.zeros(max(m, 0), _U)
        for i in range(depth, 0, -1):  # the latest context byte on top
            key = key << _U(8) | out[i - 1 : i - 1 + m]
        key = key << _U(8) | out[depth:]
        place = np.arange(int(self.at[-1])) + np.repeat(depth * np.arange(len(n)), own)
        self.keys = key[place]


def counted(keys: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and how often each is there (or the sum of its weights)."""
    if weights is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys, kind="stable")
        keys, weights = keys[order], weights[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    if weights is None:
        return keys[first], np.diff(np.concatenate([first, [len(keys)]]))
    return keys[first], np.add.reduceat(weights, first) if len(keys) else weights


def spread(keys: np.ndarray) -> np.ndarray:
    """Runs and words go by their hash."""
    return mix(keys)


def owned(depth: int) -> Callable[[np.ndarray], np.ndarray]:
    """Subtrees go by their latest context bytes."""
    return lambda keys: mix(keys >> _U(8 * (depth + 1 - TOP)))


def dealt(keys: np.ndarray, by: Callable[[np.ndarray], np.ndarray], parts: int) -> list[tuple[int, np.ndarray]]:
    """(part, places of its keys) for sorted keys; ``by`` gives a 64-bit value for each key."""
    part = ((by(keys) >> _U(32)) * _U(parts) >> _U(32)).astype(np.int32)
    order = np.argsort(part, kind="stable")
    at = np.searchsorted(part[order], np.arange(parts + 1))
    return [(p, order[at[p] : at[p + 1]]) for p in np.flatnonzero(np.diff(at)).tolist()]


class Tree:
    """The subtrees of one partition: contexts of TOP bytes and more."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, depth: int):
        self.depth = depth
        self.nodes: dict[tuple[int, int], tuple[np.ndarray, ...]] = {}  # (depth, bits) -> keys, ones' share, own weight
        below: list[tuple[np.ndarray, np.ndarray]] | None = None
        self.up: list[tuple[np.ndarray, ...]] = []
        for depth in range(self.depth, TOP - 1, -1):
            runs, n = counted((keys >> _U(8 * (self.depth + 1 - depth))) << _U(8) | (keys & _U(255)), counts.astype(np.float64))
            level = []
            for bits in range(8):
                node = runs >> _U(8 - bits)
                first = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]])) if len(node) else np.zeros(0, np.int64)
                one = ((runs >> _U(7 - bits)) & _U(1)).astype(np.float64)
                node = node[first]
                n1 = np.add.reduceat(n * one, first) if len(first) else np.zeros(0)
                n0 = np.add.reduceat(n, first) - n1 if len(first) else np.zeros(0)
                own = log_kt(n0, n1)
                if below is None:
                    weighted, weight = own, np.ones(len(own))
                else:
                    low, said = below[bits]
                    parent = (low >> _U(bits + 8)) << _U(bits) | (low & _U((1 << bits) - 1))
                    deep = np.bincount(np.searchsorted(node, parent), said, minlength=len(node))
                    weighted = math.log(0.5) + np.logaddexp(own, deep)
                    weight = np.exp(math.log(0.5) + own - weighted)
                self.nodes[depth, bits] = node, (n1 + 0.5) / (n0 + n1 + 1), weight
                level.append((node, weighted))
                if depth == TOP:  # for the contexts above
                    above = (node >> _U(bits + 8)) << _U(8) | _U(1 << bits) | (node & _U((1 << bits) - 1))
                    self.up.append((above, n0, n1, weighted))
            below = level

    def log10(self, keys: np.ndarray, top: Top) -> np.ndarray:
        """log10 of the probability of each run's last byte after the others."""
        total = np.zeros(len(keys))
        last = keys & _U(255)
        for bits in range(8):
            bit = ((last >> _U(7 - bits)) & _U(1)).astype(bool)
            prefix = last >> _U(8 - bits)
            chance, deeper = np.full(len(keys), 0.5), np.zeros(len(keys), bool)
            for depth in range(self.depth, TOP - 1, -1):
                node, ones, weight = self.nodes[depth, bits]
                want = (keys >> _U(8 * (self.depth + 1 - depth))) << _U(bits) | prefix
                at = np.searchsorted(node, want)
                at[at == len(node)] = 0
                known = node[at] == want if len(node) else np.zeros(len(keys), bool)
                if len(node):
                    own = np.where(bit, ones[at], 1 - ones[at])
                    chance = np.where(deeper, weight[at] * own + (1 - weight[at]) * chance, np.where(known, own, chance))
                    deeper |= known
            place = (1 << bits) | prefix.astype(np.int64)
            latest = (keys >> _U(8 * self.depth)).astype(np.int64)
            for ones, weight, known in ((top.ones[latest, place], top.weight[latest, place], top.seen[latest, place]), (top.root_ones[place], top.root_weight[place], np.ones(len(keys), bool))):
                own = np.where(bit, ones, 1 - ones)
                chance = np.where(deeper, weight * own + (1 - weight) * chance, np.where(known, own, chance))
                deeper = deeper | known
            total += np.log10(chance)
        return total


class Top:
    """Contexts of one byte and none: 256 x 256 numbers."""

    def __init__(self, rows: list[tuple[int, float, float, float]]):
        n0, n1, deep = np.zeros((256, 256)), np.zeros((256, 256)), np.zeros((256, 256))
        for where, a, b, c in rows:
            n0[where >> 8, where & 255], n1[where >> 8, where & 255], deep[where >> 8, where & 255] = a, b, c
        self.seen = n0 + n1 > 0
        own = log_kt(n0, n1)
        weighted = np.where(self.seen, math.log(0.5) + np.logaddexp(own, deep), 0.0)
        self.ones, self.weight = (n1 + 0.5) / (n0 + n1 + 1), np.exp(math.log(0.5) + own - np.where(self.seen, weighted, math.log(0.5) + own))
        r0, r1, said = n0.sum(axis=0), n1.sum(axis=0), weighted.sum(axis=0)
        own = log_kt(r0, r1)
        self.root_ones = (r1 + 0.5) / (r0 + r1 + 1)
        self.root_weight = np.exp(own - np.logaddexp(own, said))


class Lookup:
    """Values of known keys, by open addressing: each key's place is where a probe sequence first meets it."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(len(keys) * 2.5).bit_length())
        self.keys, self.values = keys, values
        self.table = np.full(1 << self.bits, -1, np.int32)
        todo = np.arange(len(keys), dtype=np.int32)
        slot = self._slot(keys)
        while len(todo):
            free = self.table[slot] < 0
            self.table[slot[free]] = todo[free]
            rest = self.table[slot] != todo
            todo, slot = todo[rest], (slot[rest] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _U(0x9E3779B97F4A7C15)) >> _U(64 - self.bits)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """All keys must be known."""
        slot = self._slot(keys)
        at = self.table[slot]
        todo = np.flatnonzero(self.keys[at] != keys)
        while len(todo):
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)
            at[todo] = self.table[slot[todo]]
            todo = todo[self.keys[at[todo]] != keys[todo]]
        return self.values[at]


class Counter:
    """Counts of keys over many slices, merged whenever enough have come."""

    def __init__(self):
        self.keys, self.counts, self.size = [], [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.keys.append(keys)
        self.counts.append(counts)
        self.size += len(keys)
        if len(self.keys) > 8 and self.size > 2 * len(self.keys[0]):
            self.merge()

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        if len(self.keys) != 1:
            keys = np.concatenate([*self.keys, np.zeros(0, _U)])
            counts = np.concatenate([*self.counts, np.zeros(0, np.int64)])
            keys, counts = counted(keys, counts)
            self.keys, self.counts, self.size = [keys], [counts], len(keys)
        return self.keys[0], self.counts[0]


END_WORD = _U(1)  # the end's value among words


def by_row(values: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Each row's sum, which doesn't hang on the rows around it."""
    out = np.zeros(len(rows) - 1, values.dtype)
    some = np.flatnonzero(np.diff(rows))
    if len(some):
        out[some] = np.add.reduceat(values, rows[some])
    return out


def _rows(rows: list[tuple], **kinds: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds.values())], names=[*kinds])


def score(
    df: DataFrame, learn: Column, text: str = "text", out: str = "score", base: str = "base_score", n_tokens: str = "n_tokens", n_known: str = "n_known", train_tokens: str = "train_tokens", n_bytes: str = "n_bytes", rate: str = "bits_per_byte", depth: int = DEPTH
) -> DataFrame:
    """``df`` with each whole text's log10 probability, learned from the rows where ``learn`` holds.

    Also the number of coded bytes, the code length in bits per byte, and the unigram base with add-one smoothing
    and its counts. Columns of ``df`` with these names are replaced; repeated rows stay; rows come in no
    order. ``depth``: context bytes, 2 to 7.
    """
    if not TOP <= depth <= 7:
        raise ValueError(f"depth must be {TOP} to 7")
    spark = df.sparkSession
    arrow.small_batches(spark)
    fields = [T.StructField(n_tokens, T.LongType()), T.StructField(n_known, T.LongType()), T.StructField(train_tokens, T.LongType()), T.StructField(base, T.DoubleType()), T.StructField(out, T.DoubleType()), T.StructField(n_bytes, T.LongType()), T.StructField(rate, T.DoubleType())]
    new = {f.name.lower() for f in fields} | {"__block"}
    passed = [f for f in df.schema.fields if f.name.lower() not in new]
    names = [f.name for f in passed]
    parts = px.partitions(spark)
    whole = {"part": pa.int32(), "kind": pa.int32(), "keys": pa.binary(), "counts": pa.binary()}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, words = Counter(), Counter()

        def flush() -> Iterator[pa.RecordBatch]:
            for kind, counter in ((0, runs), (1, words)):
                keys, n = counter.merge()
                rows = [(p, kind, keys[at].tobytes(), n[at].astype(np.int64).tobytes()) for p, at in dealt(keys, spread, parts)]
                counter.__init__()
                if rows:
                    yield _rows(rows, **whole)

        for batch in batches:
            for piece in arrow.slices(batch, "t"):
                s = Streams(piece.column(0), depth)
                runs.add(*counted(s.keys))
                words.add(*counted(np.where(s.words == END_WORD, _U(2), s.words)))
                words.add(np.array([END_WORD]), np.array([piece.num_rows]))
                if runs.size > 3_000_000:
                    runs.merge()
                    if runs.size > 1_500_000:
                        yield from flush()
        yield from flush()
        arrow.settled()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], Counter] = {}
        for batch in batches:
            for p, kind, keys, n in zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True):
                held.setdefault((p, kind), Counter()).add(np.frombuffer(keys, _U), np.frombuffer(n, np.int64))
        for (p, kind), counter in held.items():
            keys, n = counter.merge()
            yield _rows([(p, kind, keys.tobytes(), n.tobytes(), len(keys), int(n.sum()))], **whole, distinct=pa.int64(), total=pa.int64())
        arrow.settled()

    def to_owners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                keys, n = np.frombuffer(a, _U), np.frombuffer(n, np.int64)
                yield _rows([(p, keys[at].tobytes(), n[at].tobytes()) for p, at in dealt(keys, owned(depth), parts)], owner=pa.int32(), keys=pa.binary(), counts=pa.binary())

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[bytes, bytes]]] = {}
        for batch in batches:
            for p, *row in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
                held.setdefault(p, []).append(tuple(row))
        for p, rows in held.items():
            keys, n = np.frombuffer(b"".join(r[0] for r in rows), _U), np.frombuffer(b"".join(r[1] for r in rows), np.int64)
            order = np.argsort(keys)
            yield _rows([(p, keys[order].tobytes(), n[order].tobytes())], owner=pa.int32(), keys=pa.binary(), counts=pa.binary())

    shape = "part int, kind int, keys binary, counts binary"
    sent = df.filter(learn).select(F.col(text).alias("t")).mapInArrow(count, shape)
    sums = kept(sent.repartition(parts, "part").mapInArrow(merge, shape + ", distinct long, total long"))
    told = sums.filter("kind = 1").agg(F.sum("distinct"), F.sum("total")).first()
    V, N = told[0] or 0, told[1] or 0
    trees = "owner int, keys binary, counts binary"
    model = kept(sums.filter("kind = 0").select("keys", "counts").mapInArrow(to_owners, trees).repartition(parts, "owner").mapInArrow(gather, trees))

    def tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for where, n0, n1, said in Tree(np.frombuffer(keys, _U), np.frombuffer(n, np.int64), depth).up:
                    u, i = np.unique(where, return_inverse=True)
                    yield pa.RecordBatch.from_arrays([pa.array(u.astype(np.int64)), *[pa.array(np.bincount(i, x)) for x in (n0, n1, said)]], names=["at", "n0", "n1", "said"])
        arrow.settled()

    summed = model.select("keys", "counts").mapInArrow(tops, "at long, n0 double, n1 double, said double")
    rows = summed.groupBy("at").agg(*[F.sum(c).alias(c) for c in ("n0", "n1", "said")]).collect()  # 65,280 rows at most
    top = spark.sparkContext.broadcast(Top([tuple(r) for r in rows]))

    chars = df.agg(F.sum(F.length(text))).first()[0] or 0
    number = max(2 * spark.sparkContext.defaultParallelism, math.ceil(chars / BLOCK_CHARS))
    docs = df.select(*[F.col(f"`{n}`") for n in names], px.block_of(number, *names).alias("__block")).repartition(number, "__block")

    def ask(table: pa.Table) -> pa.Table:
        runs, words, block = Counter(), Counter(), table.column("__block")[0].as_py()
        for batch in table.combine_chunks().to_batches():
            for piece in arrow.slices(batch, text):
                s = Streams(piece.column(piece.schema.get_field_index(text)), depth)
                for counter, keys in ((runs, s.keys), (words, s.words)):
                    counter.add(*counted(keys))
        rows = []
        for kind, counter in ((0, runs), (1, words)):
            keys = counter.merge()[0]
            rows += [(p, kind, block, keys[at].tobytes()) for p, at in dealt(keys, spread, parts)]
        return pa.Table.from_batches([_rows(rows, part=pa.int32(), kind=pa.int32(), block=pa.int32(), keys=pa.binary())])

    def keys_of(table: pa.Table, kind: int) -> list[np.ndarray]:
        return [np.frombuffer(x, _U) for x in table.filter(pa.compute.equal(table.column("kind"), kind)).column("keys").to_pylist()]

    def once(asked: pa.Table) -> pa.Table:
        runs = keys_of(asked, 0)
        every = np.unique(np.concatenate([*runs, np.zeros(0, _U)]))
        rows = [(p, asked.column("part")[0].as_py(), every[at].tobytes()) for p, at in dealt(every, owned(depth), parts)]
        return pa.Table.from_batches([_rows(rows, owner=pa.int32(), part=pa.int32(), keys=pa.binary())])

    def answer(wanted: pa.Table, known: pa.Table) -> pa.Table:
        none = np.zeros(0, _U), np.zeros(0, np.int64)
        have = [(np.frombuffer(a, _U), np.frombuffer(n, np.int64)) for a, n in zip(known.column("keys").to_pylist(), known.column("counts").to_pylist(), strict=True)]
        asked = [np.frombuffer(x, _U) for x in wanted.column("keys").to_pylist()]
        rows: list[tuple] = []
        if asked:
            every = np.concatenate(asked)  # of different hash ranges: no run twice
            values = Tree(*(have or [none])[0], depth).log10(every, top.value).astype(np.float32)
            ends = np.cumsum([len(x) for x in asked])
            rows = [(p, 0, x.tobytes(), values[z - len(x) : z].tobytes()) for p, x, z in zip(wanted.column("part").to_pylist(), asked, ends, strict=True)]
        return pa.Table.from_batches([_rows(rows, part=pa.int32(), kind=pa.int32(), keys=pa.binary(), values=pa.binary())])

    def reply(asked: pa.Table, found: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        for kind, dtype in ((0, np.float32), (1, np.int64)):
            mine = found.filter(pa.compute.equal(found.column("kind"), kind))
            keys, values = np.frombuffer(b"".join(mine.column("keys").to_pylist()), _U), np.frombuffer(b"".join(mine.column("values").to_pylist()), dtype)
            order = np.argsort(keys)
            keys, values = keys[order], values[order]
            blocks = asked.filter(pa.compute.equal(asked.column("kind"), kind)).column("block").to_pylist()
            for block, want in zip(blocks, keys_of(asked, kind), strict=True):
                at = np.searchsorted(keys, want)
                at[at == len(keys)] = 0
                said = np.where(keys[at] == want, values[at], 0).astype(dtype) if len(keys) else np.zeros(len(want), dtype)  # words may be unknown
                rows.append((block, kind, want.tobytes(), said.tobytes()))
        return pa.Table.from_batches([_rows(rows, block=pa.int32(), kind=pa.int32(), keys=pa.binary(), values=pa.binary())])

    def add_up(table: pa.Table, answers: pa.Table) -> pa.Table:
        look: list[Lookup] = []
        for kind, dtype in ((0, np.float32), (1, np.int64)):
            mine = answers.filter(pa.compute.equal(answers.column("kind"), kind))
            keys = np.frombuffer(b"".join(mine.column("keys").to_pylist()), _U)
            look.append(Lookup(keys, np.frombuffer(b"".join(mine.column("values").to_pylist()), dtype)))
        ends = base_of(np.array([told_end]))[0]
        made = []
        for batch in table.combine_chunks().to_batches():
            for piece in arrow.slices(batch, text):
                s = Streams(piece.column(piece.schema.get_field_index(text)), depth)
                score_ = np.add.reduceat(look[0](s.keys).astype(np.float64), s.at[:-1])
                n = look[1](s.words) if len(s.words) else np.zeros(0, np.int64)
                known_, base_ = (by_row(x, s.rows) for x in ((n > 0).astype(np.int64), base_of(n)))
                own = [np.diff(s.rows) + 1, known_ + int(told_end > 0), np.full(piece.num_rows, N), base_ + ends, score_, np.diff(s.at), score_ / -math.log10(2) / np.diff(s.at)]
                made.append(pa.RecordBatch.from_arrays([*[piece.column(piece.schema.get_field_index(c)) for c in names], *map(pa.array, own)], names=[*names, *[f.name for f in fields]]))
        kinds = [*[table.schema.field(c).type for c in names], pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.float64()]
        return pa.Table.from_batches(made) if made else pa.table([pa.array([], k) for k in kinds], names=[*names, *[f.name for f in fields]])

    def base_of(n: np.ndarray) -> np.ndarray:
        return np.log10((n + 1) / (N + V + 1))

    told_end = df.filter(learn).count()
    replies = "block int, kind int, keys binary, values binary"
    # both passes over the texts read the same columns and share one exchange; so do both over what was asked
    asked = docs.groupBy("__block").applyInArrow(ask, "part int, kind int, block int, keys binary").repartition(parts, "part")
    wanted = asked.groupBy("part").applyInArrow(once, "owner int, part int, keys binary").repartition(parts, "owner")
    answers = wanted.groupBy("owner").cogroup(model.repartition(parts, "owner").groupBy("owner")).applyInArrow(answer, "part int, kind int, keys binary, values binary")
    found = answers.unionByName(sums.filter("kind = 1").select("part", "kind", "keys", F.col("counts").alias("values"))).repartition(parts, "part")
    back = asked.groupBy("part").cogroup(found.groupBy("part")).applyInArrow(reply, replies)
    return docs.groupBy("__block").cogroup(back.repartition(number, "block").groupBy("block")).applyInArrow(add_up, T.StructType(passed + fields))
