"""N-gram Jaccard join with PartEnum signatures.

A text's set holds the 64-bit values of its distinct shingles (A-Z folded; with fewer words than a
shingle, the whole sequence). Texts with one set are one node, so copies never meet each other. Two
sets link when intersection : union is at least ``share`` : 100.

Sets of similar sizes differ in at most k features, where k follows from the sizes and the threshold.
Sizes are cut into bands; the family of a band has all sets that may be in a pair whose smaller set is
in the band, and one k. The feature domain is partitioned on two levels. Of more than k / (k2 + 1) first
partitions, one at least has no more than k2 of a pair's differences. Each is cut into ``SECOND``
partitions, and all subsets that leave out k2 = ``LEFT_OUT`` of them are enumerated: within that first
partition, the pair is equal in one of the subsets. A set has one signature for each subset that holds any
of its features: the hash of all its features there. A first partition is solid if the set has features in
more than k2 of its second partitions, so that none of its subsets is empty; a set with more than
k / (k2 + 1) solid ones shares a signature with every set that it links with. Sets that fail this, which are
small, get finer partitions, each its own subset; if they fail it again, one signature for the family, so no
pair is lost.

Signatures meet in packed form. Those that share one are paired with one of them, the hub. Sizes and
marks (features counted in about half as many ranges as there are; the counts' distance is at most the
sets' difference) rule out most pairs that don't link; the others' texts are compared exactly; links give
components. Where a hub's nodes are not all in its component, those outside are compared with all: both are
cut into blocks, and a task has a block of either. First only sizes and marks go, and tell which nodes may link
with any of another component; a frequent shingle can be all that the others share. The texts of those nodes
go next, and a task intersects its blocks' sets by one sorted list of their features. It returns links that
join components only. So a group of near copies costs a pair for each member, no task holds more than two
blocks, pairs within a component are not formed, and no link that would join two components is missed.

Components come from hooking to the least neighbour and halving paths, by joins and aggregations.

Null, empty and wordless texts have the empty set, no link, and themselves as component. Rows of
equal ids are separate rows. A null id doesn't name a component unless all its ids are null.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import arrow
from . import packed as px
from .shared import kept, let_go
from .words import SPACED_FOLDED, mix, windows

_U = np.uint64
_C = [_U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F), _U(0x165667B19E3779F9), _U(0xD6E8FEB86659FD93)]
WIDEN = 1.6
LEAST_MARK = 128
SECOND, LEFT_OUT = 3, 1  # second partitions of each first one, and how many a subset leaves out
MET = 200_000  # signatures that a task sorts together
BLOCK_FEATURES, BLOCK_NODES = 400_000, 512  # of a block of a hub's nodes
BLOCK_MARKS, BLOCK_MARKED = 1 << 20, 2048  # bytes of marks, and nodes, of a block that is sent without texts
BITS = 24  # of the filter that keeps texts without candidates from being sent


def bands(largest: int, share: int) -> tuple[np.ndarray, np.ndarray]:
    """The bands' first sizes up to ``largest``, and each family's k."""
    firsts, ks, size = [], [], 1
    while size <= largest:
        last = max(size, int(size * WIDEN) - 1)
        firsts.append(size)
        ks.append((last + last * 100 // share) * (100 - share) // (100 + share))
        size = last + 1
    return np.array(firsts, np.int64), np.array(ks, np.int64)


def first_partitions(bad: np.ndarray, size: np.ndarray) -> np.ndarray:
    """How many first partitions a family has: the fewest with which most sets of its least size have more than ``bad`` solid ones."""
    out = np.zeros(len(bad), np.int64)
    for slack in (4, 8, 12, 16, 20, 25, 30):
        n = bad + 1 + np.maximum(1, -(-bad * slack // 100))
        empty = np.exp(-size / (n * SECOND))  # the chance that a second partition has none of the features
        loose = sum(math.comb(SECOND, i) * (1 - empty) ** i * empty ** (SECOND - i) for i in range(LEFT_OUT + 1))
        enough = n * (1 - loose) - 1.5 * np.sqrt(n * loose) > bad + 0.5
        out = np.where((out == 0) & (enough | (slack == 30)), n, out)
    return out


class Sets:
    """The sorted distinct shingles of some rows, one row after the other."""

    def __init__(self, column: pa.Array, width: int):
        data, at = arrow.text_bytes(column)
        starts, _, rows = SPACED_FOLDED.spans(data, at)
        values = SPACED_FOLDED.values(data, starts)
        every = windows(values, width)
        found = []
        for a, b in zip(rows[:-1], rows[1:], strict=True):
            if b - a >= width:
                found.append(np.unique(every[a : b - width + 1]))
            else:
                found.append(windows(values[a:b], b - a) if b > a else np.zeros(0, _U))
        self.sizes = np.array([len(x) for x in found], np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.sizes)])
        self.flat = np.concatenate([*found, np.zeros(0, _U)])
        self.sets = found
        # the sum of mixed features tells a set whatever their order
        sums = np.concatenate([np.zeros(1, _U), np.cumsum(mix(self.flat * _C[3]))])
        self.nodes = mix(sums[self.at[1:]] - sums[self.at[:-1]] + self.sizes.astype(_U) * _C[0]) >> _U(1)


def signatures(s: Sets, chosen: np.ndarray, share: int) -> np.ndarray:
    """(signature, node) of the chosen rows of non-empty sets."""
    chosen = chosen[s.sizes[chosen] > 0]
    if not len(chosen):
        return np.zeros((0, 2), _U)
    firsts, ks = bands(int(s.sizes.max()), share)
    band = np.searchsorted(firsts, s.sizes, side="right") - 1
    lasts = np.concatenate([firsts[1:] - 1, [max(int(firsts[-1] * WIDEN) - 1, firsts[-1])]])
    out = []
    for back in (0, 1):
        family = band[chosen] - back
        rows, fam = chosen[family >= 0], family[family >= 0]
        fits = (s.sizes[rows] <= lasts[fam] * 100 // share) & (ks[fam] > 0)
        rows, fam = rows[fits], fam[fits]
        for level in (0, 1):
            if not len(rows):
                break
            k = ks[fam]
            second, left_out = (SECOND, LEFT_OUT) if level == 0 else (1, 0)
            bad = k // (left_out + 1)  # first partitions with more than ``left_out`` differences
            first = first_partitions(bad, firsts[fam]) if level == 0 else 4 * k + 16
            sig, owner, solid = _enumerate(s, rows, first, second, left_out, fam, level)
            out.append(np.stack([sig, s.nodes[rows][owner]], axis=1))
            short = solid <= bad
            rows, fam = rows[short], fam[short]
        if len(rows):
            out.append(np.stack([mix(fam.astype(_U) * _C[1] + _C[2]), s.nodes[rows]], axis=1))
    return np.concatenate([*out, np.zeros((0, 2), _U)])


def _enumerate(s: Sets, rows: np.ndarray, first: np.ndarray, second: int, left_out: int, family: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signatures, the number of each one's row in ``rows``, and how many solid first partitions each row has."""
    sizes = s.sizes[rows]
    shift = np.cumsum(sizes) - sizes
    take = np.arange(int(sizes.sum())) + np.repeat(s.at[rows] - shift, sizes)
    feature = s.flat[take]
    owner = np.repeat(np.arange(len(rows)), sizes)
    if level:  # another order of the domain
        feature = mix(feature * _C[2])
        feature = feature[np.lexsort((feature, owner))]
    cell = (feature >> _U(32)) * np.repeat((first * second).astype(_U), sizes) >> _U(32)
    new = np.ones(len(feature), bool)
    new[1:] = (cell[1:] != cell[:-1]) | (owner[1:] != owner[:-1])
    new = np.flatnonzero(new)
    total = np.add.reduceat(mix(feature * _C[1]), new)
    owner, cell = owner[new], cell[new]
    part, place = cell // _U(second), (cell % _U(second)).astype(np.int64)
    new = np.ones(len(part), bool)
    new[1:] = (part[1:] != part[:-1]) | (owner[1:] != owner[:-1])
    which = np.cumsum(new) - 1
    owner, part = owner[new], part[new]
    # a row for each first partition with features: the hash of each second partition's, and whether it has any
    sums, filled = np.zeros((len(owner), second), _U), np.zeros((len(owner), second), bool)
    sums[which, place], filled[which, place] = total, True
    out, owners = [], []
    for number, subset in enumerate(combinations(range(second), second - left_out)):
        some = np.flatnonzero(filled[:, subset].any(axis=1))
        own = sums[np.ix_(some, subset)].sum(axis=1, dtype=_U)
        out.append(mix(own + family[owner[some]].astype(_U) * _C[2] + part[some] * _C[0] + mix(np.array([2 * number + level + 1], _U))))
        owners.append(owner[some])
    return np.concatenate(out), np.concatenate(owners), np.bincount(owner[filled.sum(axis=1) > left_out], minlength=len(rows))


def linked(a: np.ndarray, b: np.ndarray, share: int) -> bool:
    """Whether two sorted sets link."""
    low, high = sorted((len(a), len(b)))
    if 100 * low < share * high:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= share * (low + high - both)


def mark(features: np.ndarray) -> bytes:
    """How many of a set's features are in each of a power of two of equal ranges (255 at most, which only lessens a distance)."""
    bits = max(LEAST_MARK, len(features) // 2).bit_length() - 1
    return np.minimum(np.bincount((features >> _U(64 - bits)).astype(np.int64), minlength=1 << bits), 255).astype(np.uint8).tobytes()


def _folded(marks: list[bytes], size: int) -> np.ndarray:
    """Marks as rows of ``size`` counts, where longer ones' neighbouring ranges are added."""
    return np.stack([np.frombuffer(m, np.uint8).reshape(size, -1).sum(axis=1, dtype=np.int32) for m in marks]) if marks else np.zeros((0, size), np.int32)


def _close(size: int, mark: np.ndarray, sizes: np.ndarray, marks: np.ndarray, share: int) -> np.ndarray:
    """Which sets may link with one, as far as sizes and marks tell."""
    both = sizes + size
    least = np.abs(marks - mark).sum(axis=-1) * (100 + share) <= both * (100 - share)
    return least & (100 * np.minimum(sizes, size) >= share * np.maximum(sizes, size))


def _near(pairs: DataFrame, marks: DataFrame, share: int) -> DataFrame:
    """The pairs whose marks don't rule out a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for size_a, mark_a, size_b, mark_b in zip(*[b.column(i).to_pylist() for i in (2, 3, 4, 5)], strict=True):
                n = min(len(mark_a), len(mark_b))
                keep.append(bool(_close(size_a, _folded([mark_a], n)[0], np.array([size_b]), _folded([mark_b], n), share)[0]))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], names=["a", "b"])

    one = marks.select(F.col("node").alias("a"), F.col("size").alias("sa"), F.col("mark").alias("ma"))
    two = marks.select(F.col("node").alias("b"), F.col("size").alias("sb"), F.col("mark").alias("mb"))
    return kept(pairs.join(one, "a").join(two, "b").select("a", "b", "sa", "ma", "sb", "mb").mapInArrow(run, "a long, b long"))


ASKS, ASKED = 1, 2  # what a row of a pair of blocks is there for


def _in_blocks(told: DataFrame, block: Column, least: int) -> DataFrame:
    """(hub, node, component, role, row, column) of the hubs with nodes outside and ``least`` nodes: ``block`` is a block's number of nodes, by the largest ``size`` of a hub.

    Each pair of blocks, one of nodes outside and one of all, is a task's; every block goes to all of the other
    kind. A hub of a single pair of blocks has each node once, for both.
    """
    odd = told.groupBy("hub").agg(F.count(F.lit(1)).alias("n"), F.count_if("out").alias("m"), F.max("size").alias("size")).filter(f"m > 0 AND n >= {least}")
    odd = kept(odd.select("hub", F.ceil(F.col("m") / block).cast("int").alias("rows"), F.ceil(F.col("n") / block).cast("int").alias("columns")))
    dealt = told.drop("size").join(odd, "hub")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    mine = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    single = F.col("columns") == 1
    asking = dealt.filter(F.col("out") & ~single).select("hub", "node", "component", F.lit(ASKS).alias("role"), mine("rows").alias("row"), upto("columns").alias("column"))
    role = F.when(F.col("out") & single, ASKS | ASKED).otherwise(ASKED)
    asked = dealt.select("hub", "node", "component", role.alias("role"), upto("rows").alias("row"), mine("columns").alias("column"))
    return asking.unionByName(asked)


def _may_link(told: DataFrame, texts: DataFrame, share: int) -> DataFrame:
    """(hub, node) of nodes whose sizes and marks don't rule out a link with one of another component at their hub, one of the two outside."""

    def compare(table: pa.Table) -> pa.Table:
        hub, node, comps, role, sizes = (table.column(c).to_numpy() for c in ("hub", "node", "component", "role", "size"))
        marks = table.column("mark").to_pylist()
        marks = _folded(marks, min(map(len, marks))).astype(np.int16)
        all_ = np.flatnonzero(role & ASKED)
        found = np.zeros(len(node), bool)
        for i in np.flatnonzero(role & ASKS):
            may = all_[(comps[all_] != comps[i]) & (100 * np.minimum(sizes[all_], sizes[i]) >= share * np.maximum(sizes[all_], sizes[i]))]
            may = may[_close(sizes[i], marks[i], sizes[may], marks[may], share)]
            found[may] = True
            found[i] |= len(may) > 0
        return pa.table([pa.array(hub[found]), pa.array(node[found])], names=["hub", "node"])

    # a mark has a byte for two of a set's features, or LEAST_MARK
    block = F.greatest(F.lit(8), F.least(F.lit(BLOCK_MARKED), F.floor(F.lit(BLOCK_MARKS) / F.greatest(F.lit(LEAST_MARK), F.col("size") / 2))))
    both = _in_blocks(told, block, 3).join(texts.select("node", "size", "mark"), "node")  # two have been compared as a pair
    return both.groupBy("hub", "row", "column").applyInArrow(compare, "hub long, node long").distinct()


def _outside(stars: DataFrame, comp: DataFrame, texts: DataFrame, width: int, share: int) -> DataFrame:
    """Links (a, b) between a hub's nodes outside its component and all its nodes, enough to join what links."""
    told = stars.select(F.col("a").alias("hub"), F.col("b").alias("node")).unionByName(stars.select(F.col("a").alias("hub"), F.col("a").alias("node")).distinct())
    home = comp.select(F.col("node").alias("hub"), F.col("component").alias("home"))
    told = told.join(comp, "node").join(home, "hub").join(texts.select("node", "size"), "node").withColumn("out", F.col("component") != F.col("home"))
    told = kept(told.select("hub", "node", "component", "out", "size"))
    told = kept(told.join(kept(_may_link(told, texts, share)), ["hub", "node"]))
    both = _in_blocks(told, F.greatest(F.lit(8), F.least(F.lit(BLOCK_NODES), F.floor(F.lit(BLOCK_FEATURES) / F.col("size")))), 2)
    both = both.join(_of_nodes(texts, told.select("node")), "node")

    def compare(table: pa.Table) -> pa.Table:
        node, comps, role = (table.column(c).to_numpy() for c in ("node", "component", "role"))
        s = Sets(table.column("t"), width)
        all_, some = np.flatnonzero(role & ASKED), np.flatnonzero(role & ASKS)
        flat = np.concatenate([*[s.sets[i] for i in all_], np.zeros(0, _U)])
        order = np.argsort(flat, kind="stable")
        flat, own = flat[order], np.repeat(np.arange(len(all_)), s.sizes[all_])[order]
        root: dict[int, int] = {}

        def find(c: int) -> int:
            while (up := root.get(c, c)) != c:
                root[c] = root.get(up, up)
                c = up
            return c

        a, b = [], []
        for i in some:
            low, high = np.searchsorted(flat, s.sets[i]), np.searchsorted(flat, s.sets[i], side="right")
            n = high - low
            shared = np.bincount(own[np.repeat(low - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))], minlength=len(all_))
            for j in all_[np.flatnonzero(100 * shared >= share * (s.sizes[i] + s.sizes[all_] - shared))]:
                x, y = find(int(comps[i])), find(int(comps[j]))
                if x != y:
                    root[max(x, y)] = min(x, y)
                    a.append(int(node[i]))
                    b.append(int(node[j]))
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return both.groupBy("hub", "row", "column").applyInArrow(compare, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of the edges (a, b); a component is named by its least node."""
    done: list[DataFrame] = []
    edges = kept(edges.filter("a <> b").select("a", "b"))
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = kept(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("to")).withColumnRenamed("a", "node"))
        while True:  # halve the paths
            over = up.select(F.col("node").alias("mid"), F.col("to").alias("far"))
            up2 = kept(up.join(over, F.col("to") == F.col("mid")).select("node", F.col("far").alias("to"), (F.col("far") != F.col("to")).alias("moved")))
            moved = not up2.filter("moved").isEmpty()
            up = up2.drop("moved")
            if not moved:
                break
        done.append(up)
        one = up.select(F.col("node").alias("a"), F.col("to").alias("a2"))
        two = up.select(F.col("node").alias("b"), F.col("to").alias("b2"))
        edges = kept(edges.join(one, "a").join(two, "b").select(F.col("a2").alias("a"), F.col("b2").alias("b")).filter("a <> b").distinct())
    if not done:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    out = done[0]
    for later in done[1:]:
        names = later.select(F.col("node").alias("to"), F.col("to").alias("root"))
        out = out.join(names, "to", "left").select("node", F.coalesce("root", "to").alias("to"))
    return kept(out.select("node", F.col("to").alias("component")))


def _distinct(rows: np.ndarray) -> np.ndarray:
    """Ordered rows, each once."""
    return rows[np.concatenate([[True], (rows[1:] != rows[:-1]).any(axis=1)])] if len(rows) else rows


def _meet(sent: DataFrame, parts: int) -> DataFrame:
    """From packed (signature, node) to pairs (a, b): of the nodes with one signature the least, and each other one.

    A pair that shares several signatures comes from several tasks; pairs go packed to hash ranges of b,
    where each is taken once.
    """

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow.settled()
        rows = [x for b in batches for x in px.views(b.column(1), 2)]
        found = []
        for every in px.in_pieces(rows, max(1, sum(map(len, rows)) // MET)):
            every = _distinct(every)
            again = np.concatenate([[False], every[1:, 0] == every[:-1, 0]])
            hub = np.flatnonzero(~again)[np.cumsum(~again) - 1]
            # nodes have 63 bits, ranges are of 64
            found.append(_distinct(px.ordered(np.stack([every[again, 1] << _U(1), every[hub[again], 1]], axis=1))))
        del rows
        if found:
            part, blob = px.packed(_distinct(px.ordered(np.concatenate(found))), parts)
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(blob, pa.binary())], names=["part", "blob"])
        arrow.settled()

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow.settled()
        rows = [x for b in batches for x in px.views(b.column(1), 2)]
        for pairs in px.in_pieces(rows, max(1, sum(map(len, rows)) // MET)):
            pairs = _distinct(pairs)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 1].astype(np.int64)), pa.array((pairs[:, 0] >> _U(1)).astype(np.int64))], names=["a", "b"])
        arrow.settled()

    met = sent.repartition(parts, "part").select("part", "blob").mapInArrow(pair, "part int, blob binary")
    return met.repartition(parts, "part").select("part", "blob").mapInArrow(once, "a long, b long")


def join(df: DataFrame, text: str = "text", key: str = "doc_id", width: int = 4, share: int = 85, out: str = "component_id", size: str = "n_shingles", number: str | None = None) -> DataFrame:
    """``df`` with the size of each text's set and the least key that its links reach, itself included.

    A column named ``number`` gets the component's own number, which doesn't hang on keys; it is null for
    texts without words. Columns of ``df`` with these names are replaced; rows come in no order.
    """
    if not 100 / WIDEN < share <= 100:
        raise ValueError("a pair's sizes must be in neighbouring bands: share has to be above 100 / WIDEN")
    spark = df.sparkSession
    arrow.small_batches(spark)
    parts = px.partitions(spark)
    docs = df.select(F.col(f"`{text}`").alias("t"))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow.settled()
        seen: set[int] = set()
        held, count = [], 0
        for batch in batches:
            for piece in arrow.slices(batch, "t"):
                s = Sets(piece.column(0), width)
                new = []
                for i, node in enumerate(s.nodes.tolist()):
                    if node not in seen:
                        seen.add(node)
                        new.append(i)
                held.append(signatures(s, np.array(new, np.int64), share))
                count += len(held[-1])
                if count > 300_000:
                    yield _packed(held)
                    held, count = [], 0
        if held:
            yield _packed(held)
        del held
        arrow.settled()

    def _packed(held: list[np.ndarray]) -> pa.RecordBatch:
        part, blob = px.packed(px.ordered(np.concatenate(held)), parts)
        return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(blob, pa.binary())], names=["part", "blob"])

    stars = kept(_meet(docs.mapInArrow(send, "part int, blob binary"), parts))
    nodes = kept(stars.select(F.col("a").alias("node")).unionByName(stars.select(F.col("b").alias("node"))).distinct())
    texts = kept(_texts(docs, nodes, width, parts))
    comp = _relabelled(nodes.select("node", F.col("node").alias("component")), kept(_verified(texts, _near(stars, texts.select("node", "size", "mark"), share), width, share)))
    comp = _relabelled(comp, kept(_outside(stars, comp, texts, width, share).distinct()))
    let_go(texts)

    fields = [T.StructField(size, T.LongType()), T.StructField("__node", T.LongType())]

    def make():
        def work(part: pa.RecordBatch) -> list:
            s = Sets(part.column(part.schema.get_field_index(text)), width)
            return [pa.array(s.sizes), pa.array(np.where(s.sizes > 0, s.nodes, 0).astype(np.int64))]

        return work

    keep = [c for c in df.columns if c.lower() not in (out.lower(), size.lower(), "__node", (number or out).lower())]
    rows = arrow.with_columns(df.select(*[F.col(f"`{c}`") for c in keep]), text, fields, make)
    ids = arrow.with_columns(df.select(F.col(f"`{key}`").alias("__key"), F.col(f"`{text}`").alias(text)), text, fields, make).filter(F.col(size) > 0)
    least = ids.groupBy("__node").agg(F.min("__key").alias("__key")).join(comp.withColumnRenamed("node", "__node"), "__node", "left")
    least = least.select("__node", "__key", F.coalesce("component", "__node").alias("c"))
    named = least.join(least.groupBy("c").agg(F.min("__key").alias("__least")), "c").select("__node", "__least", F.col("c").alias("__number"))
    named = kept(named)
    extra = [F.when(F.col(size) > 0, F.col("__number")).alias(number)] if number else []
    return rows.join(named, "__node", "left").select(*[F.col(f"`{c}`") for c in keep], size, F.when(F.col(size) > 0, F.col("__least")).otherwise(F.col(f"`{key}`")).alias(out), *extra)


def _relabelled(comp: DataFrame, links: DataFrame) -> DataFrame:
    """(node, component) after the components that the links (a, b) touch have been joined."""
    if links.isEmpty():
        return comp
    one = comp.select(F.col("node").alias("a"), F.col("component").alias("ca"))
    two = comp.select(F.col("node").alias("b"), F.col("component").alias("cb"))
    over = links.join(one, "a").join(two, "b").select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct()
    new = components(over).select(F.col("node").alias("component"), F.col("component").alias("to"))
    return kept(comp.join(new, "component", "left").select("node", F.coalesce("to", "component").alias("component")))


def _mask(nodes: DataFrame) -> np.ndarray:
    """A bit for each place that one of the nodes has; 2 MB however many nodes there are."""
    place = F.pmod("node", F.lit(1 << BITS))
    bits = nodes.groupBy(F.bitmap_bucket_number(place).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("m")).collect()  # 4 KB for each 32,768 places
    mask = np.zeros(((1 << BITS) // 32768 + 2, 4096), np.uint8)
    for r in bits:
        mask[r["k"]] = np.frombuffer(bytes(r["m"]), np.uint8)
    return mask


def _marked(mask: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """Whether each node's place has a bit. A place p > 0 is in bucket 1 + (p - 1) // 32768, at bit (p - 1) % 32768; p = 0 in bucket 0."""
    at = (nodes.astype(_U) % _U(1 << BITS)).astype(np.int64)
    bucket, bit = np.where(at > 0, 1 + (at - 1) // 32768, 0), np.where(at > 0, (at - 1) % 32768, 0)
    return ((mask[bucket, bit // 8] >> (bit % 8).astype(np.uint8)) & 1) > 0


def _texts(docs: DataFrame, nodes: DataFrame, width: int, parts: int) -> DataFrame:
    """(node, t, size, mark): one text for each of the nodes, and for some others that share a place of the filter with them."""
    told = docs.sparkSession.sparkContext.broadcast(_mask(nodes))

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow.settled()
        want, seen = told.value, set()
        for batch in batches:
            for piece in arrow.slices(batch, "t"):
                s = Sets(piece.column(0), width)
                take = []
                for i in np.flatnonzero(_marked(want, s.nodes) & (s.sizes > 0)).tolist():
                    if int(s.nodes[i]) not in seen:
                        seen.add(int(s.nodes[i]))
                        take.append(i)
                marks = [mark(s.sets[i]) for i in take]
                yield pa.RecordBatch.from_arrays([pa.array(s.nodes[take].astype(np.int64)), piece.column(0).take(pa.array(take, pa.int64())), pa.array(s.sizes[take]), pa.array(marks, pa.binary())], names=["node", "t", "size", "mark"])
        arrow.settled()

    sent = docs.mapInArrow(texts, "node long, t string, size long, mark binary").repartition(parts, "node")
    return sent.dropDuplicates(["node"])


def _of_nodes(texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, t) of the nodes, and of some others that share a place of the filter with them."""
    told = texts.sparkSession.sparkContext.broadcast(_mask(nodes))

    def needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_marked(told.value, batch.column(0).to_numpy())))

    return texts.select("node", "t").mapInArrow(needed, "node long, t string")


def _verified(texts: DataFrame, pairs: DataFrame, width: int, share: int) -> DataFrame:
    """The pairs (a, b) of nodes whose sets link, found by comparing their texts' sets."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, have = None, None
        for batch in batches:
            a, keep = batch.column(0).to_pylist(), []
            for i in range(batch.num_rows):
                if a[i] != last:
                    last, have = a[i], Sets(batch.column(2).slice(i, 1), width).sets[0]
                keep.append(linked(have, Sets(batch.column(3).slice(i, 1), width).sets[0], share))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])

    pairs = kept(pairs)
    texts = _of_nodes(texts, pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))))
    two = pairs.join(texts.select(F.col("node").alias("b"), F.col("t").alias("tb")), "b")
    four = two.join(texts.select(F.col("node").alias("a"), F.col("t").alias("ta")), "a")
    return four.select("a", "b", "ta", "tb").mapInArrow(compare, "a long, b long")
