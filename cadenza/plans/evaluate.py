"""The evaluation as plans: transcripts, audio quality, speaker consistency, and the gates before a report."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.functions import audio as ax
from cadenza.functions import text as tx
from cadenza.operators import consistency, coverage, metrics, resume, validate


def records(items: DataFrame, clips: DataFrame, files: DataFrame, systems: Sequence[str], dataset_hash: str) -> DataFrame:
    """Checked input records of transcription; raises for any clip that can't be used."""
    expected = coverage.grid(items.select("id", "lang", "language_code"), systems)
    validate.require(clips.filter(~F.col("sentences_sha256").eqNullSafe(dataset_hash)), "a manifest is of another dataset")
    known = validate.audio(expected.join(clips.select("system", "id", "status", "wav_sha256"), ["system", "id"], "left"), files)
    validate.require(known.filter("problem IS NOT NULL").select("system", "id", "problem"), "audio can't be used")
    return known.select(
        "system", "id", "lang", "language_code",
        F.concat_ws("__", "system", F.concat("id", F.lit(".wav"))).alias("upload_name"),
        F.concat_ws("/", "system", F.concat("id", F.lit(".wav"))).alias("relative_wav"),
        "wav_sha256", "audio_seconds",
    )


def transcripts(results: DataFrame, items: DataFrame) -> DataFrame:
    """Successful results with their references and scores; a result of an unknown prompt raises."""
    ok = results.filter("status = 'ok'")
    validate.require(ok.join(items, "id", "left_anti").select("system", "id"), "results of unknown prompts")
    told = items.select("id", F.col("text").alias("input_text"), tx.reference_of(F.col("spoken_reference"), F.col("text")).alias("reference"), "usecase")
    rows = ok.join(told, "id").withColumns({"hypothesis": F.col("transcript"), "has_digits": tx.has_digits(F.col("input_text"))})
    return tx.score_text(rows, deal=["system", "id"])


def failures(results: DataFrame) -> DataFrame:
    return results.filter(~F.col("status").eqNullSafe("ok"))


def transcript_summary(rows: DataFrame, systems: DataFrame, n_systems: int, coverage_kind: str = "matched") -> DataFrame:
    """Slices over the prompts that all systems have, or over all ``available`` rows."""
    used = coverage.only_matched(rows, n_systems) if coverage_kind == "matched" else rows
    return metrics.on_grid(metrics.slices(used, metrics.error_rates()), systems)


def audio_quality(clips: DataFrame, files: DataFrame, cache: DataFrame | None, scorer: Callable, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> tuple[DataFrame, DataFrame]:
    """(scores, exceptions): cached values where audio and language are the same, others from ``scorer``.

    ``clips``: the expected ones with status and hash. ``files``: (system, id, content). ``keep`` writes what
    the scorer gave and reads it back, so that it is called once a clip and not for each of the two results.
    """
    hashed = files.select("system", "id", F.sha2("content", 256).alias("sha256"))
    known = clips.join(hashed, ["system", "id"], "left")
    missing = known.filter("sha256 IS NULL").select("system", "id", "lang", F.lit("missing").alias("problem"))
    fine = F.col("status").eqNullSafe("ok") & F.col("wav_sha256").eqNullSafe(F.col("sha256"))
    changed = known.filter(F.col("sha256").isNotNull() & ~fine).select("system", "id", "lang", F.lit("other audio").alias("problem"))
    usable = known.filter(fine).select("system", "id", "lang", "wav_sha256")
    if cache is None:
        reused, todo = usable.limit(0).selectExpr("*", "CAST(NULL AS DOUBLE) p808", "CAST(NULL AS DOUBLE) ovrl"), usable
    else:
        reused, todo = resume.cached(usable, cache)
    scored = keep(ax.scored(todo.join(files, ["system", "id"]), scorer))
    failed = scored.filter("error_type IS NOT NULL").select("system", "id", "lang", F.col("error_type").alias("problem"))
    good = scored.filter("error_type IS NULL").drop("error_type")
    return reused.select(good.columns).unionByName(good), missing.unionByName(changed).unionByName(failed)


def quality_summary(scores: DataFrame, systems: DataFrame, n_systems: int) -> DataFrame:
    measured = metrics.slices(coverage.only_matched(scores, n_systems), metrics.quality(), keys=("lang",), flag=None)
    return metrics.on_grid(measured, systems, kinds=("matched_only",), count="n")


def speaker_consistency(embeddings: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(per clip, per system, language and voice, per system); a group of one clip raises."""
    rows = embeddings.withColumn("voice", F.coalesce("voice", F.lit("unknown")))
    group = ["system", "lang", "voice"]
    validate.require(consistency.small_groups(rows, group), "a voice needs two clips")
    scores = consistency.leave_one_out(rows, group)
    return scores.drop("embedding"), consistency.per_group(scores, group), consistency.overall(scores)


def gate(items: DataFrame, systems: Sequence[str], transcripts_: DataFrame, scores: DataFrame, inputs: DataFrame, per_clip: DataFrame | None = None) -> None:
    """Raises unless every prompt of every system has a transcript, a finite score and, if given, a cosine, all of the same audio."""
    validate.check_systems(systems)
    expected = coverage.grid(items.select("id", "lang"), systems).select("system", "id", "lang")
    for name, rows in (("transcripts", transcripts_), ("audio scores", scores), ("inputs", inputs), *([("consistency", per_clip)] if per_clip is not None else [])):
        validate.require(coverage.set_difference(expected, rows.select("system", "id", "lang")), f"{name} don't cover the prompts")
        validate.require(validate.same_clips(inputs, rows, equal=("wav_sha256", "lang")), f"{name} are of other audio")
    validate.require(validate.finite_scores(scores).select("system", "id"), "scores aren't finite")
    if per_clip is not None:
        validate.require(validate.finite_scores(per_clip, ("speaker_cosine",)).select("system", "id"), "cosines aren't finite")
