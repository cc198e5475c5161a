"""Speaker consistency: each clip's cosine to the centroid of the other clips of its group."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.functions import vectors as vx


def leave_one_out(df: DataFrame, group: Sequence[str], vector: str = "embedding", out: str = "speaker_cosine") -> DataFrame:
    """``df`` with the cosine between each unit vector and the sum of its group's others.

    The group's vector sum is aggregated by coordinate (partial sums in each task, then one row a
    group) and joined back; with u of length 1 and the group's sum S, u.(S - u) / |S - u| needs u.S and
    |S| only. Null for zero or non-finite vectors, which don't count, and in groups of one.
    """
    units = df.withColumn("__u", vx.unit(F.col(vector)))
    parts = units.filter("__u IS NOT NULL").select(*group, F.posexplode("__u").alias("__i", "__x"))
    sums = parts.groupBy(*group, "__i").agg(F.sum("__x").alias("__s"), F.count(F.lit(1)).alias("__n"))
    total = sums.groupBy(*group).agg(F.transform(F.sort_array(F.collect_list(F.struct("__i", "__s"))), lambda x: x["__s"]).alias("__S"), F.max("__n").alias("__n"))
    total = total.withColumn("__ss", vx.dot(F.col("__S"), F.col("__S")))
    # group columns may be null: joined null-safely, under names of their own
    total = total.select(*[F.col(g).alias(f"__g{i}") for i, g in enumerate(group)], "__S", "__n", "__ss")
    condition = reduce(and_, [F.col(g).eqNullSafe(F.col(f"__g{i}")) for i, g in enumerate(group)])
    us = vx.dot(F.col("__u"), F.col("__S"))
    rest = F.sqrt(F.greatest(F.col("__ss") - 2 * us + 1, F.lit(0.0)))
    score = F.when((F.col("__n") > 1) & (rest > 0), (us - 1) / rest)
    return units.join(total, condition, "left").select(*df.columns, score.alias(out))


def per_group(scores: DataFrame, group: Sequence[str], score: str = "speaker_cosine") -> DataFrame:
    return scores.groupBy(*group).agg(
        F.count(score).alias("n"),
        F.avg(score).alias("mean"),
        F.median(score).alias("median"),
        F.stddev_samp(score).alias("standard_deviation"),
        F.min(score).alias("minimum"),
        F.max(score).alias("maximum"),
    )


def overall(scores: DataFrame, by: Sequence[str] = ("system",), language: str = "lang", score: str = "speaker_cosine") -> DataFrame:
    """Macro mean over languages and mean over all clips."""
    each = scores.groupBy(*by, language).agg(F.count(score).alias("n"), F.avg(score).alias("mean"), F.sum(score).alias("sum"))
    return each.groupBy(*by).agg(F.sum("n").alias("n"), F.avg("mean").alias("macro_mean_across_languages"), (F.sum("sum") / F.sum("n")).alias("all_clips_mean"))


def small_groups(df: DataFrame, group: Sequence[str]) -> DataFrame:
    return df.groupBy(*group).count().filter("count < 2")
