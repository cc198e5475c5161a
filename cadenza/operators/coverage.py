"""Coverage: the expected grid, what is missing, and ids that every system has."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def grid(items: DataFrame, systems: Sequence[str]) -> DataFrame:
    """Every item for every system; the systems are a literal list, so no join is needed."""
    return items.withColumn("system", F.explode(F.array(*map(F.lit, systems))))


def matched(rows: DataFrame, n_systems: int, key: str = "id", system: str = "system") -> DataFrame:
    """Keys that occur with each of ``n_systems`` systems."""
    return rows.groupBy(key).agg(F.count_distinct(system).alias("__n")).filter(F.col("__n") == n_systems).select(key)


def only_matched(rows: DataFrame, n_systems: int, key: str = "id", system: str = "system") -> DataFrame:
    return rows.join(matched(rows, n_systems, key, system), key, "left_semi")


def missing(expected: DataFrame, present: DataFrame, on: Sequence[str] = ("system", "id")) -> DataFrame:
    return expected.join(present.select(*on), list(on), "left_anti")


def set_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that one side has more often than the other: (row, side). Empty if both are equal as multisets."""
    names = left.columns
    counted = left.withColumn("__d", F.lit(1)).unionByName(right.select(*names).withColumn("__d", F.lit(-1)))
    return counted.groupBy(*names).agg(F.sum("__d").alias("excess")).filter("excess <> 0")


def repeated(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).count().filter("count > 1")


def counts(expected: DataFrame, scored: DataFrame, on: Sequence[str] = ("system", "id")) -> DataFrame:
    """expected_clips, scored_clips (distinct), and whether coverage is complete."""
    a = expected.select(*on).distinct().agg(F.count(F.lit(1)).alias("expected_clips"))
    b = scored.select(*on).distinct().agg(F.count(F.lit(1)).alias("scored_clips"))
    left = missing(expected.select(*on), scored, on).agg((F.count(F.lit(1)) == 0).alias("coverage_complete"))
    one = F.lit(1).alias("__k")
    return a.select("*", one).join(b.select("*", one), "__k").join(left.select("*", one), "__k").drop("__k")


def supported(rows: DataFrame, languages: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows of supported languages, and the excluded ones with their reason."""
    fine = F.coalesce(F.col("lang").isin(*languages), F.lit(False))
    return rows.filter(fine), rows.filter(~fine).withColumn("reason", F.lit("unsupported_by_asr"))
