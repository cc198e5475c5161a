"""Fail-closed checks. Each gives the violating rows; ``require`` raises if there is one."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.functions import text as tx
from cadenza.functions import vectors as vx
from cadenza.operators import coverage


class InvalidData(ValueError):
    """A check failed; the message has the first violations."""


def require(violations: DataFrame, what: str, show: int = 5) -> None:
    rows = violations.limit(show).collect()
    if rows:
        raise InvalidData(f"{what}: " + "; ".join(str(r.asDict()) for r in rows))


def items(df: DataFrame) -> DataFrame:
    """(id, violation) for each broken rule of the prompt table."""
    reference = tx.reference_of(F.col("spoken_reference"), F.col("text")) if "spoken_reference" in df.columns else F.col("text")
    category = F.coalesce(F.col("eval_category"), F.lit("high_quality")) if "eval_category" in df.columns else F.lit("high_quality")
    rules = {
        "unsafe id": tx.is_safe_id(F.col("id")),
        "unusable lang": tx.is_usable(F.col("lang")),
        "unusable text": tx.is_usable(F.col("text")),
        "empty reference": F.coalesce(tx.normalize(reference) != "", F.lit(False)),
        "other track": category == "high_quality",
    }
    broken = F.filter(F.array(*[F.when(~fine, F.lit(name)) for name, fine in rules.items()]), lambda x: x.isNotNull())
    one = df.select("id", F.explode(broken).alias("violation"))
    return one.unionByName(coverage.repeated(df, "id").select("id", F.lit("repeated id").alias("violation")))


def check_items(df: DataFrame) -> DataFrame:
    if df.isEmpty():
        raise InvalidData("the prompt table is empty")
    require(items(df), "invalid prompts")
    return df


def check_systems(systems: Sequence[str], exactly: int | None = None) -> list[str]:
    names = list(systems)
    if len(set(names)) != len(names) or not names or any(not re.fullmatch(r"[A-Za-z0-9_-]+", n) for n in names):
        raise InvalidData("systems need distinct names of letters, digits, _ and -")
    if exactly is not None and len(names) != exactly:
        raise InvalidData(f"expected {exactly} systems")
    return names


def manifest(clips: DataFrame, wanted: DataFrame, dataset_hash: str) -> DataFrame:
    """(system, id, violation): another dataset, or ids that aren't those of the prompts."""
    other = clips.filter(~F.col("sentences_sha256").eqNullSafe(dataset_hash)).select("system", F.lit(None).cast("string").alias("id"), F.lit("other dataset").alias("violation")).distinct()
    have, want = clips.select("system", "id"), wanted.select("system", "id")
    odd = coverage.set_difference(have, want).select("system", "id", F.when(F.col("excess") > 0, "unexpected id").otherwise("missing id").alias("violation"))
    return other.unionByName(odd)


def audio(clips: DataFrame, files: DataFrame) -> DataFrame:
    """``clips`` with ``problem``: null, or why a clip's file can't be used. ``files``: (system, id, sha256, header)."""
    from cadenza.functions import audio as ax

    both = clips.join(files, ["system", "id"], "left")
    problem = (
        F.when(~F.col("status").eqNullSafe("ok"), "not generated")
        .when(F.col("sha256").isNull(), "no file")
        .when(~F.col("sha256").eqNullSafe(F.col("wav_sha256")), "other audio")
        .when(~ax.is_standard(F.col("header")), "other format")
    )
    return both.withColumn("problem", problem)


def same_clips(left: DataFrame, right: DataFrame, on: Sequence[str] = ("system", "id"), equal: Sequence[str] = ("wav_sha256", "lang")) -> DataFrame:
    """(on, violation) where the sides don't have the same clips with equal, non-null values."""
    a = left.select(*on, F.struct(*equal).alias("__a"))
    b = right.select(*on, F.struct(*equal).alias("__b"))
    both = a.join(b, list(on), "full_outer")
    differs = F.lit(False)
    for c in equal:
        differs = differs | F.coalesce(F.col(f"__a.{c}") != F.col(f"__b.{c}"), F.lit(True))
    why = F.when(F.col("__a").isNull(), "only right").when(F.col("__b").isNull(), "only left").when(differs, "differs")
    return both.select(*on, why.alias("violation")).filter("violation IS NOT NULL")


def finite_scores(scores: DataFrame, columns: Sequence[str] = ("p808", "ovrl")) -> DataFrame:
    fine = F.lit(True)
    for c in columns:
        fine = fine & vx.is_finite(F.col(c))
    return scores.filter(~fine)
