"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are ranked by length (integer squared norms) and cut into buckets of about ``BUCKET`` vectors,
longest first. A query's running k-th best score, over its length and the bucket's greatest length, is
the bucket's local cosine threshold. Above 1 the whole bucket is out. Otherwise the bucket is pruned
by length (a vector's own length gives a smaller cosine bound) where the threshold is low, and by
coordinates where it is high: the query's largest coordinates (its focus) give a partial cosine, and
what the rest can add is at most the product of the two remainders' lengths. The survivors' integer
products are computed and kept.

The k-th best starts at the one among the longest vectors (a sample of at most ``HEAD`` vectors), so
most buckets are pruned from the first. Each query goes to the buckets that it must visit, in blocks of about
``QUERY_BLOCK`` a bucket; a bucket's vectors go to as many blocks as its visitors need, to none if there
are none. Only the best k of each meeting go on.

Components are floor(1024 x) as integers; products are exact in 64 bits. Vectors that are null, empty
or hold a null or non-finite component take no part. Vectors of unlike lengths are compared over the
common coordinates. Ties go to the smaller id. A row with a null id takes no part. An id stands for
one vector, as in the query's SQL: no row of a query's own id is its candidate, and ranks are by id.
Where ids repeat all the same, other ids' rows are separate candidates, and equal query rows are one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import kept

SCALE = 1024
BUCKET = 4096
QUERY_BLOCK = 1024
HEAD = 2048
FOCUS = 8


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of integers as a matrix; shorter rows are filled with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    width = int(sizes.max()) if len(sizes) else 0
    out = np.zeros((len(sizes), width), np.int64)
    begin = np.cumsum(sizes) - sizes
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(begin, sizes)] = flat
    return out


def alike(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = max(a.shape[1], b.shape[1])
    return tuple(np.pad(x, ((0, 0), (0, n - x.shape[1]))) for x in (a, b))


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id, in order."""
    if len(ids) > 4 * k:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= cut)
    else:
        some = np.arange(len(ids))
    return some[np.lexsort((ids[some], -scores[some]))[:k]]


class Bucket:
    """Vectors of similar length."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.exact = ids, vectors
        self.real = vectors.astype(np.float64)
        self.norms = np.sqrt((self.real**2).sum(axis=1))
        self.longest = float(self.norms.max()) if len(ids) else 0.0

    def search(self, query: np.ndarray, own: int, least: float, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the bucket's best k for a query, of those that reach ``least``."""
        q = query.astype(np.float64)
        length = float(np.sqrt((q**2).sum()))
        bound = length * self.longest * (1 + 1e-9)
        none = np.zeros(0, np.int64)
        if bound < least:
            return none, none
        cosine = least / bound if bound > 0 else -1.0
        if cosine <= 0:
            some = np.arange(len(self.ids))
        elif cosine < 0.5:  # length pruning
            some = np.flatnonzero(self.norms * length * (1 + 1e-9) >= least)
        else:  # coordinate pruning
            focus = np.argsort(-np.abs(q), kind="stable")[:FOCUS]
            part = self.real[:, focus] @ q[focus]
            rest_q = math.sqrt(max(length**2 - float((q[focus] ** 2).sum()), 0.0))
            rest = np.sqrt(np.maximum(self.norms**2 - (self.real[:, focus] ** 2).sum(axis=1), 0))
            some = np.flatnonzero(part + rest * rest_q >= least - 1e-6 * (1 + abs(least)))
        some = some[self.ids[some] != own]
        if not len(some):
            return none, none
        # floats hold these products exactly up to 2**53; beyond it integers are multiplied
        if length * self.longest < 2.0**52:
            scores = np.rint(self.real[some] @ q).astype(np.int64)
        else:
            scores = self.exact[some] @ query
        keep = np.flatnonzero(scores >= least)
        top = keep[best(self.ids[some][keep], scores[keep], k)]
        return self.ids[some][top], scores[top]


def search(df: DataFrame, is_query: Column, k: int = 10, key: str = "vec_id", vector: str = "embedding", bucket: int = BUCKET, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row where ``is_query`` holds, its k best other rows (all, if fewer)."""
    spark = df.sparkSession
    whole = F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * SCALE).cast("long"))
    fine = F.coalesce(F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))), F.lit(False))
    rows = df.filter(fine & (F.size(vector) > 0) & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), whole.alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    rows = kept(rows.withColumn("norm", F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))))
    head = rows.orderBy(F.desc("norm"), "id").limit(HEAD).select("id", "v").toArrow()  # HEAD rows at most
    total = rows.count()
    if not total:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    n_buckets = max(1, math.ceil(total / bucket))
    top = spark.sparkContext.broadcast((head.column("id").to_numpy().astype(np.int64), matrix(head.column("v"))))

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors = top.value
        for b in batches:
            q, v = alike(matrix(b.column(1)), vectors)
            head_ = Bucket(ids, v)
            least = []
            for own, query in zip(b.column(0).to_pylist(), q, strict=True):
                found = head_.search(query, own, -math.inf, k)[1]
                least.append(float(found[-1]) if len(found) == k else -math.inf)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(least)], names=["id", "v", "norm", "least"])

    queries = kept(rows.filter("q").select("id", "v", "norm").dropDuplicates(["id", "v"]).mapInArrow(start, "id long, v array<long>, norm double, least double"))
    # buckets by length: equal shares of the norms' order; where many vectors have one length, a hash of the row cuts further
    cuts = sorted(set(rows.approxQuantile("norm", [i / n_buckets for i in range(1, min(n_buckets, 1024))], 1 / (4 * n_buckets)) if n_buckets > 1 else []), reverse=True)
    group = F.lit(0)
    if cuts:
        group = F.aggregate(F.array(*[F.lit(float(c)) for c in cuts]), F.lit(0), lambda s, c: s + (F.col("norm") < c).cast("int"))
    sizes = {r["g"]: r["count"] for r in rows.groupBy(group.alias("g")).count().collect()}  # 1,024 at most
    shards = [max(1, math.ceil(sizes.get(g, 0) / bucket)) for g in range(len(cuts) + 1)]
    offsets = [sum(shards[:g]) for g in range(len(shards))]
    numbers = lambda values: F.array(*[F.lit(x) for x in values])
    place = F.element_at(numbers(offsets), F.col("g") + 1) + F.pmod(F.xxhash64("id", "v"), F.element_at(numbers(shards), F.col("g") + 1)).cast("int")
    vectors = rows.withColumn("g", group).select("id", "v", "g", place.alias("bucket"))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        out_q, out_i, out_s = [], [], []
        if left.num_rows and right.num_rows:
            q, v = alike(matrix(left.column("v")), matrix(right.column("v")))
            own = Bucket(right.column("id").to_numpy().astype(np.int64), v)
            for mine, query, least in zip(left.column("id").to_pylist(), q, left.column("least").to_pylist(), strict=True):
                ids, scores = own.search(query, mine, least, k)
                out_q.append(np.full(len(ids), mine, np.int64))
                out_i.append(ids)
                out_s.append(scores)
        flat = [np.concatenate([*x, np.zeros(0, np.int64)]) for x in (out_q, out_i, out_s)]
        return pa.table([pa.array(x) for x in flat], names=["query_id", "vec_id", "score"])

    # a bucket whose greatest length can't give a query's k-th best is not visited
    uppers = F.array(*[F.lit(float(c)) for c in [math.inf, *cuts]])
    left = queries.select("id", "v", "least", "norm", F.posexplode(uppers).alias("g", "upper")).filter(F.col("least") <= F.sqrt(F.col("norm")) * F.sqrt("upper") * (1 + 1e-9))
    visits = {r["g"]: r["count"] for r in left.groupBy("g").count().collect()}  # 1,024 at most
    n_blocks = F.element_at(numbers([math.ceil(visits.get(g, 0) / query_block) for g in range(len(shards))]), F.col("g") + 1)
    first = F.element_at(numbers(offsets), F.col("g") + 1)
    every = F.explode(F.sequence(first, first + F.element_at(numbers(shards), F.col("g") + 1) - 1)).alias("bucket")
    left = left.select("id", "v", "least", F.pmod(F.xxhash64("id", "v"), n_blocks).cast("int").alias("block"), every)
    right = vectors.filter(n_blocks > 0).select("id", "v", "bucket", F.explode(F.sequence(F.lit(0), n_blocks - 1)).alias("block"))
    found = left.groupBy("block", "bucket").cogroup(right.groupBy("block", "bucket")).applyInArrow(meet, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
