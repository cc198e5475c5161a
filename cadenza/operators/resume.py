"""Reuse of earlier results by content: equal keys, audio hash and language, finite values."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.functions import vectors as vx
from cadenza.operators.validate import InvalidData, require


def same_settings(saved: Mapping, current: Mapping, keys: Sequence[str]) -> None:
    for k in keys:
        if saved.get(k) != current.get(k):
            raise InvalidData(f"the saved run has another {k}")


def cached(clips: DataFrame, cache: DataFrame, on: Sequence[str] = ("system", "id", "wav_sha256", "lang"), values: Sequence[str] = ("p808", "ovrl")) -> tuple[DataFrame, DataFrame]:
    """(reused with their values, to be scored)."""
    fine = cache
    for v in values:
        fine = fine.filter(vx.is_finite(F.col(v)))
    fine = fine.select(*on, *values).dropDuplicates(list(on))
    plain = clips.drop(*values)
    return plain.join(fine, list(on)), plain.join(fine, list(on), "left_anti")


def reused_transcripts(current: DataFrame, items: DataFrame, earlier: DataFrame, earlier_inputs: DataFrame) -> DataFrame:
    """Current records with an earlier run's transcripts.

    Earlier rows of other clips are ignored; for the same clip, another hash, language, code or input
    text is an error, as is a repeated row or a missing transcript.
    """
    require(earlier.groupBy("system", "id").count().filter("count > 1"), "repeated earlier results")
    keys = ["wav_sha256", "lang", "language_code"]
    was = earlier.filter("status = 'ok'").select("system", "id", "transcript", "request_id", "detected_language", "input_text", F.struct(*keys).alias("__was"))
    inputs = earlier_inputs.select("system", "id", F.struct(*keys).alias("__input"))
    now = current.join(items.select("id", F.col("text").alias("__text")), "id").withColumn("__now", F.struct(*keys))
    both = now.join(was, ["system", "id"]).join(inputs, ["system", "id"], "left")
    odd = F.lit(False)
    for k in keys:
        odd = odd | ~F.col(f"__was.{k}").eqNullSafe(F.col(f"__now.{k}")) | ~F.col(f"__input.{k}").eqNullSafe(F.col(f"__now.{k}"))
    odd = odd | ~F.col("input_text").eqNullSafe(F.col("__text")) | F.col("transcript").isNull()
    require(both.filter(odd).select("system", "id"), "earlier results are of other audio, language or text")
    return both.select(*current.columns, F.lit("ok").alias("status"), "transcript", "request_id", "detected_language", F.lit(True).alias("reused_asr"))


def remaining(records: DataFrame, done: DataFrame, on: Sequence[str] = ("system", "id")) -> DataFrame:
    return records.join(done.select(*on), list(on), "left_anti")


def together(*results: DataFrame) -> DataFrame:
    out = results[0]
    for r in results[1:]:
        out = out.unionByName(r, allowMissingColumns=True)
    return out
