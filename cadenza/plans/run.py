"""Stage runner: generate, asr, mos, consistency, report, each over tables of one run folder.

Services and models come from factories named on the command line (``package.module:function``), as
none is part of this library; a stage whose factory is missing stops the run. Every stage reads what
earlier ones wrote, reuses what is still valid, and a failing one leaves earlier output as it is. A
stage's settings are saved with its first output; a later run with other settings stops.
"""

from __future__ import annotations

import argparse
import importlib
import json
import logging
import sys
import uuid
from collections.abc import Callable, Mapping, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza import schemas
from cadenza.functions import audio as ax
from cadenza.operators import batching, coverage, metrics, resume, validate
from cadenza.plans import evaluate, report
from cadenza.sources import sinks, tables
from cadenza.sources.clients import STOPPING, Refused

STAGES = ("generate", "asr", "mos", "consistency", "report")
# what must be equal for earlier clips, and for an earlier run's transcripts, to be taken
CLIP_SETTINGS = ("system", "endpoint", "voice", "model", "sample_rate_requested", "sentences_sha256")
ASR_SETTINGS = ("model", "mode", "transport", "diarization", "sample_rate", "systems")
log = logging.getLogger("cadenza")


def loaded(name: str | None, what: str) -> Callable:
    if not name:
        raise validate.InvalidData(f"no {what} is given")
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


class Run:
    """``folder`` must be one that driver and executors share."""

    def __init__(self, spark: SparkSession, sentences: str, folder: str, systems: Sequence[str], code_field: str = "language_code"):
        self.spark, self.folder, self.systems = spark, folder, validate.check_systems(systems)
        self.items = tables.items(spark, sentences, code_field)
        self.hash = tables.dataset_hash(spark, sentences)
        self.names = spark.createDataFrame([(s,) for s in self.systems], "system string")

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def saved(self, name: str, schema=None) -> DataFrame | None:
        jvm = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name))
        if not jvm.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(jvm):
            return None
        reader = self.spark.read.schema(schema) if schema else self.spark.read
        return reader.parquet(self.path(name))

    def clips(self) -> DataFrame:
        got = self.saved("clips")
        if got is None:
            raise validate.InvalidData("nothing was generated yet")
        return got

    def keep(self, name: str, rows: DataFrame) -> DataFrame:
        """``rows`` as a table of the run, in place of an earlier one."""
        rows.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.parquet(self.path(name))

    def same(self, name: str, settings: Mapping, keys: Sequence[str] | None = None) -> None:
        """Saves the settings, or compares them with the saved ones."""
        told = self.saved(f"{name}-settings")
        if told is not None:
            resume.same_settings(json.loads(told.first()["settings"]), settings, keys or sorted(settings))
        else:
            self.keep(f"{name}-settings", self.spark.createDataFrame([(json.dumps(dict(settings), sort_keys=True),)], "settings string"))

    def generate(self, synthesizer: Callable[[str], Callable[[dict], dict]], settings: Mapping[str, Mapping] | None = None, waves: int = 4) -> None:
        """``synthesizer(system)`` is called in each task and gives a function from a prompt to a clip.

        ``settings``: endpoint, voice, model and sample rate of each system. Prompts are dealt to ``waves``; each is
        committed when it ends, and none is begun after one in which a service refused.
        """
        for system in self.systems:
            own = {"sample_rate_requested": 24_000, **(settings or {}).get(system, {}), "system": system, "sentences_sha256": self.hash}
            self.same(f"clips-{system}", {k: own.get(k) for k in CLIP_SETTINGS}, CLIP_SETTINGS)
        todo = coverage.grid(self.items, self.systems)
        done = self.saved("clips")
        if done is not None:
            validate.require(done.filter(~F.col("sentences_sha256").eqNullSafe(self.hash)), "earlier clips are of another dataset")
            fine = done.filter("status = 'ok'")
            validate.require(fine.filter(~F.sha2("content", 256).eqNullSafe(F.col("wav_sha256"))).select("system", "id"), "saved audio is missing or was changed")
            todo = resume.remaining(todo, fine)
        digest, call = self.hash, uuid.uuid4().hex

        def speak(frames):
            made: dict[str, Callable] = {}
            for frame in frames:
                for r in frame.to_dict("records"):
                    if r["system"] not in made:
                        made[r["system"]] = synthesizer(r["system"])
                    got = made[r["system"]](r)
                    told = {k: got.get(k) for k in ("status", "voice", "content", "audio_seconds", "error_type", "http_status")}
                    yield pd.DataFrame([{"system": r["system"], "id": r["id"], "lang": r["lang"], **told, "sentences_sha256": digest}]).astype({"http_status": "Int64"})
                    if got.get("http_status") in STOPPING:
                        return  # the service won't answer; what is left stays to be generated

        shape = "system string, id string, lang string, status string, voice string, content binary, audio_seconds double, error_type string, http_status long, sentences_sha256 string"
        place = F.pmod(F.xxhash64("system", "id"), F.lit(waves))
        todo = self.keep("todo", todo.withColumn("wave", place))
        for wave in sorted(r["wave"] for r in todo.select("wave").distinct().collect()):  # ``waves`` at most
            some = todo.filter(F.col("wave") == wave).drop("wave").repartition("system", "id")
            sinks.append(some.mapInPandas(speak, shape).withColumn("wav_sha256", F.sha2("content", 256)).withColumns({"call": F.lit(call), "wave": F.lit(wave)}), self.path("clips"))
            made = self.clips()
            log.info("wave %d: %d of %d clips", wave, made.filter("status = 'ok'").select("system", "id").distinct().count(), self.expected())
            if not made.filter(F.col("http_status").isin(*STOPPING) & (F.col("call") == call)).isEmpty():
                raise Refused("a service refused; run again once that is settled")

    def expected(self) -> int:
        return self.items.count() * len(self.systems)

    def usable(self) -> DataFrame:
        """The latest state of each clip: a successful one if there is any."""
        order = F.max_by(F.struct("*"), F.when(F.col("status") == "ok", 1).otherwise(0))
        return self.clips().groupBy("system", "id").agg(order.alias("c")).select("c.*")

    def inputs(self) -> DataFrame:
        clips = self.usable()
        files = clips.select("system", "id", F.sha2("content", 256).alias("sha256"), ax.header("content").alias("header"), "audio_seconds")
        return evaluate.records(self.items, clips.drop("audio_seconds"), files, self.systems, self.hash)

    def asr(self, transcriber: Callable[[str, list[dict]], list[dict]], dry: bool = False, size: int = 20, settings: Mapping | None = None, reuse: str | None = None) -> dict:
        """One call of ``transcriber(batch key, records)`` for each batch of one language, on the driver: services take few at a time.

        ``reuse``: another run's folder; its transcripts are taken where audio, language, text and settings are the
        same. Transcripts, summary and settings are published after each batch, also after one that failed.
        """
        own = {**(settings or {}), "systems": self.systems, "sentences_sha256": self.hash}
        records = self.inputs()
        done = self.saved("asr", schemas.RESULT)
        earlier = None
        if reuse is not None:
            if reuse.rstrip("/") == self.folder.rstrip("/"):
                raise validate.InvalidData("a run can't reuse itself")
            earlier = self.reused(reuse, own, records)
            if done is not None:
                earlier = resume.remaining(earlier, done.filter("status = 'ok'"))
        had = [x.select("system", "id") for x in (None if done is None else done.filter("status = 'ok'"), earlier) if x is not None]
        todo = records
        for x in had:
            todo = resume.remaining(todo, x)
        told = metrics.cost(todo).first().asDict()
        if dry:
            return told
        self.same("asr", own)
        self.keep("asr-inputs", records.join(self.items.select("id", F.col("text").alias("input_text")), "id"))
        # written once: each batch is then read from there, and what is appended doesn't change what is left
        batches = self.keep("asr-batches", batching.numbered(todo, size=size))
        if earlier is not None:
            sinks.append(self.spark.createDataFrame([], schemas.RESULT).unionByName(earlier, allowMissingColumns=True), self.path("asr"))
        record = F.sort_array(F.collect_list(F.struct("id", "system", F.struct(*records.columns).alias("r"))))  # ``size`` records at most
        try:
            for b in batches.groupBy("batch_key").agg(record.alias("rows")).orderBy("batch_key").toLocalIterator():
                found = transcriber(b["batch_key"], [x["r"].asDict() for x in b["rows"]])
                sinks.append(self.spark.createDataFrame([[x.get(f.name) for f in schemas.RESULT.fields] for x in found], schemas.RESULT), self.path("asr"))
                log.info("%s: %d records", b["batch_key"], len(found))
                self.publish_transcripts(own)
        finally:
            if self.saved("asr") is not None:
                self.publish_transcripts(own)
        return told

    def reused(self, folder: str, settings: Mapping, records: DataFrame) -> DataFrame:
        """What an earlier run's folder has for this run's records."""
        other = Run.__new__(Run)
        other.spark, other.folder = self.spark, folder
        told, results, inputs = other.saved("asr-settings"), other.saved("asr", schemas.RESULT), other.saved("asr-inputs")
        if told is None or results is None or inputs is None:
            raise validate.InvalidData(f"no transcripts in {folder}")
        resume.same_settings(json.loads(told.first()["settings"]), settings, ASR_SETTINGS)
        return resume.reused_transcripts(records, self.items, results.join(inputs.select("system", "id", "input_text"), ["system", "id"]), inputs)

    def publish_transcripts(self, settings: Mapping) -> None:
        """Transcripts as TSV, matched ids as a table, and a summary; small whatever the run's size."""
        got = self.saved("asr", schemas.RESULT)
        rows = self.keep("transcripts", evaluate.transcripts(got, self.items))
        sinks.write_tsv(rows, self.path("transcripts.tsv"))
        n = self.keep("matched-ids", coverage.matched(rows, len(self.systems))).count()
        scored = rows.select("system", "id").distinct().count()
        measured = self.keep("transcript-summary", evaluate.transcript_summary(rows, self.names, len(self.systems)))
        kinds = {kind: [r.asDict() for r in metrics.by_value(measured, kind).collect()] for kind in ("matched_only", "lang", "usecase", "without_has_digits")}
        summary = {
            "created_utc": sinks.now_utc(), "config": dict(settings), "expected_clips": self.expected(), "scored_clips": scored,
            "coverage_complete": scored == self.expected(), "matched_ids": n, "failed": evaluate.failures(got).count(), "slices": kinds,
        }
        sinks.write_shared(self.spark, self.path("config.json"), dict(settings))
        sinks.write_shared(self.spark, self.path("summary.json"), summary)

    def transcripts(self) -> DataFrame:
        got = self.saved("asr", schemas.RESULT)
        if got is None:
            raise validate.InvalidData("nothing was transcribed yet")
        return evaluate.transcripts(got, self.items)

    def recognize(self, recognizer: Callable, languages: Sequence[str], settings: Mapping | None = None) -> None:
        """Transcripts from a local recognizer, for the languages that it has; the others' clips are listed with their reason."""
        self.same("asr", {**(settings or {}), "systems": self.systems, "sentences_sha256": self.hash})
        records = self.inputs()
        fine, odd = coverage.supported(records, languages)
        self.keep("asr-excluded", odd)
        done = self.saved("asr", schemas.RESULT)
        todo = fine if done is None else resume.remaining(fine, done.filter("status = 'ok'"))
        found = ax.recognized(todo.join(self.usable().select("system", "id", "content"), ["system", "id"]), recognizer)
        out = found.withColumns({"status": F.when(F.col("error").isNull(), "ok").otherwise("failed"), "reason": F.col("error")}).drop("error")
        sinks.append(self.keep("recognized", self.spark.createDataFrame([], schemas.RESULT).unionByName(out, allowMissingColumns=True)), self.path("asr"))

    def mos(self, scorer: Callable, settings: Mapping | None = None) -> None:
        self.same("mos", {**(settings or {}), "systems": self.systems, "sentences_sha256": self.hash})
        clips = self.usable()
        cache = self.saved("mos", schemas.MOS)
        found, odd = evaluate.audio_quality(
            clips.select("system", "id", "lang", "status", "wav_sha256"), clips.filter("content IS NOT NULL").select("system", "id", "content"), cache, scorer, lambda df: self.keep("mos-scored", df)
        )
        # written under another name first: the cache is still being read
        found = self.keep("mos-next", found.select([f.name for f in schemas.MOS.fields]))
        self.keep("mos-exceptions", odd)
        self.keep("mos", found)

    def consistency(self, encoder: Callable, seconds: float = 6.0, batch: int = 8, settings: Mapping | None = None) -> None:
        if seconds <= 0 or not 1 <= batch <= 32:
            raise validate.InvalidData("seconds must be positive and batches of 1 to 32 clips")
        self.same("consistency", {**(settings or {}), "seconds": seconds, "systems": self.systems, "sentences_sha256": self.hash})
        clips = self.usable().filter("status = 'ok'").select("system", "id", "lang", "voice", "wav_sha256", "content")
        vectors = self.keep("embeddings", ax.embedded(clips, encoder, batch, seconds))  # the encoder is called once a clip
        per_clip, per_voice, overall = evaluate.speaker_consistency(vectors)
        self.keep("consistency", per_clip)
        self.keep("consistency-voices", per_voice)
        self.keep("consistency-overall", overall)

    def of_this_run(self) -> None:
        """Raises if a stage's saved output is of another dataset or other systems."""
        for name in ("asr", "mos", "consistency"):
            told = self.saved(f"{name}-settings")
            if told is not None:
                resume.same_settings(json.loads(told.first()["settings"]), {"systems": self.systems, "sentences_sha256": self.hash}, ("systems", "sentences_sha256"))

    def report(self, path: str, title: str = "Speech synthesis evaluation") -> str:
        rows, scores, per_clip = self.transcripts(), self.saved("mos"), self.saved("consistency")
        if scores is None:
            raise validate.InvalidData("nothing was scored yet")
        self.of_this_run()
        evaluate.gate(self.items, self.systems, rows, scores, self.inputs(), per_clip)
        n = len(self.systems)
        spoken = None
        if per_clip is not None:
            from cadenza.operators import consistency

            spoken = consistency.per_group(per_clip, ["system", "lang"]), self.saved("consistency-overall")
        text = report.render(title, self.systems, self.hash, evaluate.transcript_summary(rows, self.names, n), evaluate.quality_summary(scores, self.names, n), spoken)
        report.publish(path, text)
        return text


def main(args: Sequence[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="python -m cadenza.plans.run", description=__doc__)
    p.add_argument("--sentences", required=True)
    p.add_argument("--output", required=True, help="run folder, shared by driver and executors")
    p.add_argument("--systems", nargs="+", default=["alpha", "beta"])
    p.add_argument("--stage", choices=["all", *STAGES], default="all")
    p.add_argument("--code-field", default="language_code")
    for name in ("synthesizer", "transcriber", "scorer", "encoder"):
        p.add_argument(f"--{name}", help="package.module:function")
    p.add_argument("--max-audio-seconds", type=float, default=6.0)
    p.add_argument("--batch-size", type=int, default=8)
    p.add_argument("--dry-run", action="store_true")
    p.add_argument("--report", default="REPORT.md")
    p.add_argument("--setting", action="append", default=[], metavar="SYSTEM.NAME=VALUE", help="endpoint, voice, model or sample_rate_requested of a system; the synthesizer factory gets them")
    p.add_argument("--asr-setting", action="append", default=[], metavar="NAME=VALUE", help="model, mode, transport, diarization, sample_rate ...; the transcriber factory gets them")
    p.add_argument("--reuse-asr", metavar="FOLDER", help="another run, whose transcripts of the same audio are taken")
    p.add_argument("--waves", type=int, default=4, help="commits of the generate stage")
    p.add_argument("--timeout", type=float, default=180.0, help="seconds of a call; given to the factories")
    p.add_argument("--wait-seconds", type=float, default=900.0, help="seconds of a batch job; given to the transcriber factory")
    a = p.parse_args(args)
    if min(a.timeout, a.wait_seconds) <= 0 or a.waves < 1:
        p.error("times and waves must be positive")
    logging.basicConfig(level=logging.WARNING, format="%(message)s")
    log.setLevel(logging.INFO)
    spark = SparkSession.builder.appName("cadenza").getOrCreate()
    want = lambda stage: a.stage in ("all", stage)
    try:
        by_system: dict[str, dict] = {s: {} for s in a.systems}
        for told in a.setting:
            at, _, value = told.partition("=")
            system, _, name = at.partition(".")
            if system not in by_system or name not in CLIP_SETTINGS:
                raise validate.InvalidData(f"no such setting: {at}")
            by_system[system][name] = value
        asr = {k: v for k, _, v in (told.partition("=") for told in a.asr_setting)}
        run = Run(spark, a.sentences, a.output, a.systems, a.code_field)
        if want("generate"):
            make, timeout = loaded(a.synthesizer, "synthesizer"), a.timeout
            run.generate(lambda system: make(system, {**by_system[system], "timeout": timeout}), by_system, a.waves)
        if want("asr"):
            speak = None if a.dry_run else loaded(a.transcriber, "transcriber")({**asr, "timeout": a.timeout, "wait_seconds": a.wait_seconds})
            print(run.asr(speak, a.dry_run, settings=asr, reuse=a.reuse_asr))
            if a.dry_run:
                return 0
        if want("mos"):
            run.mos(loaded(a.scorer, "scorer"))
        if want("consistency"):
            run.consistency(loaded(a.encoder, "encoder"), a.max_audio_seconds, a.batch_size)
        if want("report"):
            print(run.report(a.report))
    except (ValueError, RuntimeError, OSError) as e:
        print(f"stopped: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
