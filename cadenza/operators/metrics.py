"""Aggregates over scored clips: error rates, audio quality, counts, cost and slices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def error_rates() -> list[Column]:
    """Corpus rates are sums over sums; sentence rates are means over clips."""
    ratio = lambda a, b: F.try_divide(F.lit(100.0) * F.sum(a), F.sum(b))
    return [
        F.count(F.lit(1)).alias("clips"),
        F.count_distinct("lang").alias("languages"),
        (F.lit(100.0) * F.avg("wer")).alias("mean_sentence_wer_percent"),
        (F.lit(100.0) * F.avg("cer")).alias("mean_sentence_cer_percent"),
        ratio("word_edits", "reference_words").alias("corpus_wer_percent"),
        ratio("character_edits", "reference_characters").alias("corpus_cer_percent"),
        F.sum("reference_words").alias("reference_words"),
        F.sum("word_edits").alias("word_edits"),
    ]


def quality() -> list[Column]:
    return [F.count(F.lit(1)).alias("n"), F.avg("p808").alias("p808"), F.avg("ovrl").alias("ovrl")]


def slices(rows: DataFrame, measures: Sequence[Column], keys: Sequence[str] = ("lang", "usecase"), by: str = "system", flag: str | None = "has_digits") -> DataFrame:
    """(by, slice_kind, slice_value, measures): all rows, each value of each key, and rows without ``flag``.

    One pass over the rows. A null value is a slice of its own, told from the total by the kind.
    """
    kinds = {"matched_only": []} | {k: [k] for k in keys} | ({f"without_{flag}": ["__flag"]} if flag else {})
    data = rows.withColumn("__flag", F.col(flag)) if flag else rows
    columns = [*keys, *(["__flag"] if flag else [])]
    sets = [[F.col(by), *map(F.col, k)] for k in kinds.values()]
    grouped = data.groupingSets(sets, F.col(by), *map(F.col, columns)).agg(*measures, F.grouping_id().alias("__id"))
    # bit i of the id, from the last column, is 1 where that column is not grouped by
    width = len(columns)
    bits = {name: sum(1 << (width - 1 - columns.index(c)) for c in columns if c not in own) for name, own in kinds.items()}
    kind = F.coalesce(*[F.when(F.col("__id") == b, F.lit(name)) for name, b in bits.items()])
    value = F.coalesce(*[F.when(F.col("__id") == bits[k], F.col(k).cast("string")) for k in keys], F.lit(None).cast("string")) if keys else F.lit(None).cast("string")
    out = grouped.withColumns({"slice_kind": kind, "slice_value": value})
    if flag:
        out = out.filter((F.col("slice_kind") != f"without_{flag}") | (~F.col("__flag")))
    return out.drop("__id", *columns)


def on_grid(measured: DataFrame, systems: DataFrame, kinds: Sequence[str] = ("matched_only", "without_has_digits"), by: str = "system", count: str = "clips") -> DataFrame:
    """Slices that have no rows, for each system: their count is 0 and all else null."""
    grid = systems.select(by).distinct().withColumn("slice_kind", F.explode(F.array(*map(F.lit, kinds))))
    absent = grid.join(measured.select(by, "slice_kind"), [by, "slice_kind"], "left_anti").withColumn(count, F.lit(0).cast("long"))
    return measured.unionByName(absent, allowMissingColumns=True)


def by_value(measured: DataFrame, kind: str) -> DataFrame:
    """One kind's slices in order of their value; a null value is sorted as the text ``None``."""
    return measured.filter(F.col("slice_kind") == kind).orderBy("system", F.coalesce("slice_value", F.lit("None")))


def cost(remaining: DataFrame, per_hour: float = 30.0, seconds: str = "audio_seconds") -> DataFrame:
    """Upper bound of what transcription of the clips costs."""
    total = F.coalesce(F.sum(seconds), F.lit(0.0))
    return remaining.agg(F.count(F.lit(1)).alias("clips"), (total / 3600).alias("hours"), (total / 3600 * per_hour).alias("cost"))


def pivoted(measured: DataFrame, value: str, rows: str, systems: Sequence[str]) -> DataFrame:
    """One row for each value of ``rows``, one column for each system."""
    return measured.groupBy(rows).pivot("system", list(systems)).agg(F.first(value))
