import base64
import json
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza import schemas
from cadenza.functions import audio as ax
from cadenza.functions import ctc
from cadenza.functions import text as tx
from cadenza.operators import batching, consistency, coverage, metrics, resume, validate
from cadenza.plans import evaluate, report
from cadenza.sources import clients, sinks, tables


def value(spark, column, **data):
    return spark.createDataFrame([tuple(data.values())], ", ".join(f"{k} string" for k in data)).select(column).first()[0]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(prev[j] + 1, row[-1] + 1, prev[j - 1] + (x != y)))
    return row[-1]


def wav(payload=b"\0\0\x10\0" * 2400, channels=1, rate=24000, bits=16, extra=b""):
    fmt = struct.pack("<HHIIHH", 1, channels, rate, rate * channels * bits // 8, channels * bits // 8, bits)
    body = b"WAVE" + b"fmt " + struct.pack("<I", 16) + fmt + extra + b"data" + struct.pack("<I", len(payload)) + payload
    return b"RIFF" + struct.pack("<I", len(body)) + body


@pytest.mark.parametrize(
    "given, expected",
    [("Hello,  World!", "hello world"), ("snake_case 42", "snake_case 42"), ("क‍ष", "कष"), ("য়", "য়"), ("é", "é"), ("…!", ""), ("ΑΣ", "ας"), (None, None)],
)
def test_normalize(spark, given, expected):
    assert value(spark, tx.normalize(F.col("t")), t=given) == expected


def test_edits_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(" ".join(rng.choices("ab cd ef gé हि".split(), k=rng.randrange(9))), " ".join(rng.choices("ab cd xx gé हि".split(), k=rng.randrange(9)))) for _ in range(60)]
    df = tx.score_text(spark.createDataFrame(rows, "reference string, hypothesis string"))
    for r in df.collect():
        assert r["word_edits"] == distance(r["reference"].split(), r["hypothesis"].split())
        assert r["character_edits"] == distance(r["reference"], r["hypothesis"])
        assert r["wer"] == (r["word_edits"] / len(r["reference"].split()) if r["reference"] else None)


def test_many_distinct_words(spark):
    a, b = " ".join(f"w{i}" for i in range(7000)), " ".join(f"w{i}" for i in range(10, 7000))
    assert value(spark, tx.word_edits(F.col("a"), F.col("b")), a=a, b=b) == 10


def test_digits_ids_blank_base64(spark):
    assert value(spark, tx.has_digits(F.col("t")), t="१८") and not value(spark, tx.has_digits(F.col("t")), t="x")
    assert [value(spark, tx.is_safe_id(F.col("t")), t=t) for t in ("a-b_1", "a\n", "a.b", None)] == [True, False, False, False]
    assert [value(spark, tx.is_usable(F.col("t")), t=t) for t in ("a", " 　", "", "a\0", None)] == [True, False, False, False, False]
    good = base64.b64encode(b"wav").decode()
    assert [value(spark, tx.strict_base64(F.col("t")), t=t) for t in (good, "!!!!", "YQ", f"{good}\n", f"{good[:2]}\n{good[2:]}")] == [bytearray(b"wav"), None, None, None, None]
    size = value(spark, F.length(tx.strict_base64(F.repeat(F.col("t"), 1_000_000))), t=good)  # 3 MB of audio
    assert size == 3_000_000


def test_ctc(spark):
    df = spark.createDataFrame([([0, 1, 1, 0, 1, 2, 2],)], "ids array<int>")
    row = df.select(ctc.collapsed(F.col("ids"), F.lit(0)).alias("c"), ctc.spelled(ctc.collapsed(F.col("ids"), F.lit(0)), F.array(F.lit("-"), F.lit("▁a"), F.lit("b"))).alias("s"), ctc.argmax(F.array(F.lit(0.1), F.lit(0.7), F.lit(0.7))).alias("m")).first()
    assert (row["c"], row["s"], row["m"]) == ([1, 1, 2], "a ab", 1)


def test_slices_keep_null_groups_and_empty_slices(spark):
    rows = [("alpha", "hi", None, True, 0.5, 0.25, 1, 2, 1, 4), ("alpha", "en", "chat", True, 0.0, 0.0, 0, 2, 0, 4)]
    df = spark.createDataFrame(rows, "system string, lang string, usecase string, has_digits boolean, wer double, cer double, word_edits long, reference_words long, character_edits long, reference_characters long")
    out = metrics.on_grid(metrics.slices(df, metrics.error_rates()), df.select("system"))
    got = {(r["slice_kind"], r["slice_value"]): r for r in out.collect()}
    assert got["matched_only", None]["corpus_wer_percent"] == 25 and got["usecase", None]["clips"] == 1
    assert got["without_has_digits", None]["clips"] == 0 and got["without_has_digits", None]["corpus_wer_percent"] is None


def test_leave_one_out(spark):
    rows = [("hi1", "hi", [1.0, 0.0]), ("hi2", "hi", [1.0, 0.0]), ("en1", "en", [0.0, 1.0]), ("en2", "en", [0.0, 2.0]), ("x", None, [1.0, 1.0]), ("z", "hi", [0.0, 0.0])]
    df = spark.createDataFrame(rows, "id string, lang string, embedding array<double>")
    got = {r["id"]: r["speaker_cosine"] for r in consistency.leave_one_out(df, ["lang"]).collect()}
    assert got["hi1"] == pytest.approx(1) and got["en2"] == pytest.approx(1) and got["x"] is None and got["z"] is None
    with pytest.raises(validate.InvalidData):
        evaluate.speaker_consistency(df.selectExpr("'s' AS system", "*", "CAST(NULL AS STRING) AS voice", "'h' AS wav_sha256"))


def test_coverage(spark):
    rows = spark.createDataFrame([("alpha", "a"), ("beta", "a"), ("alpha", "b"), ("alpha", "b")], "system string, id string")
    assert [r["id"] for r in coverage.matched(rows, 2).collect()] == ["a"]
    expected = coverage.grid(rows.select("id").distinct(), ["alpha", "beta"])
    assert [tuple(r) for r in coverage.missing(expected, rows).select("system", "id").collect()] == [("beta", "b")]
    assert tuple(coverage.counts(expected, rows).first()) == (4, 3, False)
    assert coverage.set_difference(rows, rows).isEmpty() and not coverage.set_difference(rows, rows.distinct()).isEmpty()
    fine, out = coverage.supported(spark.createDataFrame([("hi",), (None,)], "lang string"), ["hi"])
    assert fine.count() == 1 and out.first()["reason"] == "unsupported_by_asr"


def test_items_validation(spark, tmp_path):
    path = tmp_path / "items.json"
    path.write_text(json.dumps({"items": [{"id": "hi1", "lang": "hi", "code": "hi-IN", "text": "नमस्ते"}, {"id": "en1", "lang": "en", "code": "en-IN", "text": "Hello"}]}))
    assert tables.items(spark, str(path), code_field="code").count() == 2 and len(tables.dataset_hash(spark, str(path))) == 64
    path.write_text(json.dumps({"items": [{"id": "a.b", "lang": "hi", "text": "…"}, {"id": "c", "lang": " ", "text": "x"}, {"id": "c", "lang": "x", "text": "y"}]}))
    got = sorted(map(tuple, validate.items(tables.items(spark, str(path), check=False)).collect()))
    assert got == [("a.b", "empty reference"), ("a.b", "unsafe id"), ("c", "repeated id"), ("c", "unusable lang")]
    with pytest.raises(validate.InvalidData):
        tables.items(spark, str(path))
    for bad in ([], ["a", "a"], ["a b"]):
        with pytest.raises(validate.InvalidData):
            validate.check_systems(bad)


def test_wav(spark):
    good, chunked, stereo = wav(), wav(extra=b"LIST" + struct.pack("<I", 4) + b"abcd"), wav(channels=2)
    df = spark.createDataFrame([(good,), (chunked,), (stereo,), (good[:100],), (b"no",), (None,)], "content binary")
    rows = df.select(ax.header("content").alias("h"), ax.canonical_header(F.col("content")).alias("c")).select("h", "c", ax.is_standard(F.col("h")).alias("ok")).collect()
    assert [r["ok"] for r in rows] == [True, True, False, False, False, False]
    assert tuple(rows[0]["c"]) == (1, 2, 24000, 4800) and rows[1]["c"] is None and rows[1]["h"]["frames"] == 4800
    assert ax.ratio(24000) == (2, 3) and len(ax.samples(good)) == 3200
    tone = np.sin(np.arange(2400) * 2 * np.pi * 440 / 24000)
    assert np.abs(ax.resample(tone, 2, 3)[100:1500] - np.sin(np.arange(1600) * 2 * np.pi * 440 / 16000)[100:1500]).max() < 1e-2
    assert ax.unit_range(np.array([-1.014, 0.5, 1.014])).tolist() == [-1, 0.5, 1]
    for bad in ([], [np.nan], [np.inf]):
        with pytest.raises(ValueError):
            ax.unit_range(np.array(bad))


def test_batches(spark):
    df = spark.createDataFrame([("hi", f"{i:03d}", s) for i in range(25) for s in ("a", "b")] + [("en", "x", "a")], "language_code string, id string, system string")
    got = {(r["language_code"], r["id"], r["system"]): r["batch_key"] for r in batching.numbered(df).collect()}
    assert len(got) == 51 and got["hi", "009", "b"] == "hi_0000" and got["hi", "010", "a"] == "hi_0001" and got["hi", "024", "b"] == "hi_0002" and got["en", "x", "a"] == "en_0000"


def test_batches_of_many_rows_with_other_columns(spark, tmp_path):
    """No row is lost and all numbers are those of one sorted list, whatever columns are read and however often."""
    rows = spark.range(400_000).select(
        F.when(F.col("id") % 50 == 0, F.lit(None)).when(F.col("id") % 3 == 0, "hi").otherwise("en").alias("language_code"),
        F.format_string("%06d", F.pmod(F.xxhash64("id"), F.lit(10**6))).alias("id"), F.col("id").alias("system"), F.repeat(F.col("id").cast("string"), 3).alias("text"),
    )
    batching.numbered(rows, number=7).write.parquet(str(tmp_path / "out"))
    got = spark.read.parquet(str(tmp_path / "out")).toPandas()
    assert len(got) == 400_000 and got.system.nunique() == 400_000 and (got.text == got.system.astype(str) * 3).all()
    got = got.sort_values(["id", "system"], kind="stable")
    want = got.fillna({"language_code": "unknown"}).groupby("language_code", sort=False).cumcount() // 20
    assert (got.batch == want).all()
    assert (got.batch_key == got.language_code.fillna("unknown") + "_" + want.astype(str).str.zfill(4)).all()


class Service:
    def __init__(self, *answers):
        self.answers, self.seen = list(answers), []

    def __call__(self, method, url, headers, body):
        self.seen.append((method, url, dict(headers)))
        status, data = self.answers.pop(0)
        return status, data if isinstance(data, bytes) else json.dumps(data).encode()


def test_addresses_and_keys(tmp_path):
    key = "k" * 40
    assert clients.key_headers("https://tts.example/synthesize", {"TTS_API_KEY": key}) == {"Authorization": f"Bearer {key}"}
    assert clients.key_headers("http://127.0.0.1:8080", {"TTS_API_KEY": key}) and clients.key_headers("http://far.example", {}) == {}
    (tmp_path / "empty").write_text("")
    for url, env in (("http://far.example", {"TTS_API_KEY": key}), ("https://u:p@x.example", {}), ("https://x.example?q=1", {}), ("https://x.example#f", {}), ("https://x.example", {"TTS_API_KEY": key, "TTS_API_KEY_FILE": "f"}), ("https://x.example", {"TTS_API_KEY_FILE": str(tmp_path / "empty")}), ("https://x.example", {"TTS_API_KEY": "short"})):
        with pytest.raises(validate.InvalidData):
            clients.key_headers(url, env)
    assert [clients.voice_of(m, "hi") for m in ("", "lang_female", "en_default", "own")] == [None, "hi_female_default", "en_female_default", "own"]


def test_synthesizer():
    slept = []
    s = clients.Synthesizer("https://x.example", Service((429, b""), (200, wav())), {"Authorization": "Bearer secret"}, sleep=slept.append)
    made = s.speak({"text": "a"})
    assert made["status"] == "ok" and made["audio_seconds"] == 0.2 and slept == [10]
    failed = clients.Synthesizer("https://x.example", Service((302, b"secret body")), sleep=slept.append).speak({"text": "a"})
    assert failed == {"status": "failed", "error_type": "RuntimeError", "http_status": 302}


def test_batch_transcriber():
    records = [{"system": "alpha", "id": "a", "upload_name": "alpha__a.wav"}]
    service = Service(
        (200, {"job_id": "j", "storage_container_type": "Azure"}),
        (200, {"job_state": "Accepted"}),
        (200, {"upload_urls": {"alpha__a.wav": {"file_url": "https://s.example/up"}}, "storage_container_type": "Azure"}),
        (201, b""),
        (200, {"job_state": "Running"}),
        (200, {"job_state": "Completed", "job_details": [{"inputs": [{"file_name": "alpha__a.wav"}], "state": "Success", "outputs": [{"file_name": "o.json"}]}]}),
        (200, {"download_urls": {"o.json": {"file_url": "https://s.example/down"}}}),
        (200, {"transcript": "hello", "language_code": "en-IN"}),
    )
    store: dict = {}
    t = clients.BatchTranscriber("https://api.example/job", service, "KEY", store, sleep=lambda s: None)
    out = t.run("en_0000", records, {"model": "m"}, lambda r: b"wav")
    assert out[0]["transcript"] == "hello" and t.run("en_0000", records, {"model": "m"}, None) == out
    assert all("api-subscription-key" not in h for _, url, h in service.seen if "s.example" in url) and "KEY" not in json.dumps(store)
    with pytest.raises(validate.InvalidData):
        t.run("en_0000", records, {"model": "other"}, None)
    store["x"] = {"identity": {"parameters": {}, "inputs": []}, "creation_pending": True}  # the answer to creation was lost
    with pytest.raises(clients.Refused):
        t.run("x", [], {}, None)


def fixture(spark, tmp_path):
    items = spark.createDataFrame([("hi1", "hi", "hi-IN", "नमस्ते दुनिया", None, None), ("en1", "en", "en-IN", "Hello world 5", None, "chat")], "id string, lang string, language_code string, text string, spoken_reference string, usecase string")
    for system in ("alpha", "beta"):
        (tmp_path / system).mkdir()
        for k, i in enumerate(("hi1", "en1")):
            (tmp_path / system / f"{i}.wav").write_bytes(wav(bytes([k, 0, 16, 0]) * 2400))
    files = tables.audio(spark, str(tmp_path))
    shas = {(r["system"], r["id"]): r["sha256"] for r in tables.described(files).collect()}
    langs = {"hi1": "hi", "en1": "en"}
    clips = spark.createDataFrame([(s, i, langs[i], "ok", h, "D") for (s, i), h in shas.items()], "system string, id string, lang string, status string, wav_sha256 string, sentences_sha256 string")
    return items, files, clips


def test_plans_end_to_end(spark, tmp_path):
    items, files, clips = fixture(spark, tmp_path)
    systems = ["alpha", "beta"]
    names = clips.select("system").distinct()
    inputs = evaluate.records(items, clips, tables.described(files), systems, "D")
    assert inputs.count() == 4
    results = inputs.join(items.select("id", F.col("text").alias("transcript")), "id").withColumn("status", F.lit("ok"))
    rows = evaluate.transcripts(results, items)
    rates = evaluate.transcript_summary(rows, names, 2)
    scores, odd = evaluate.audio_quality(clips.drop("sentences_sha256"), files, None, lambda: lambda x: (3.5, 3.8))
    assert odd.isEmpty() and scores.count() == 4
    again, _ = evaluate.audio_quality(clips.drop("sentences_sha256"), files, scores, lambda: lambda x: 1 / 0)
    assert again.count() == 4
    quality = evaluate.quality_summary(scores, names, 2)
    evaluate.gate(items, systems, rows, scores, inputs)
    text = report.render("T", systems, "D", rates, quality)
    assert "| Corpus WER % | 0.00 | 0.00 |" in text and "| DNSMOS OVRL | 3.80 | 3.80 |" in text
    report.publish(str(tmp_path / "R.md"), text)
    sinks.write_json(str(tmp_path / "s.json"), {"é": 1})
    assert (tmp_path / "s.json").read_text() == '{\n  "é": 1\n}\n'
    sinks.write_tsv(rows, str(tmp_path / "tsv"))
    for bad in (
        dict(transcripts_=rows.filter("id = 'hi1'")),
        dict(scores=scores.filter("system = 'alpha'")),
        dict(scores=scores.withColumn("id", F.concat("id", F.lit("x")))),
        dict(scores=scores.withColumn("wav_sha256", F.lit("other"))),
        dict(transcripts_=rows.withColumn("lang", F.lit("xx"))),
        dict(scores=scores.withColumn("ovrl", F.lit(float("nan")))),
    ):
        with pytest.raises(validate.InvalidData):
            evaluate.gate(items, systems, **{"transcripts_": rows, "scores": scores, "inputs": inputs} | bad)
    with pytest.raises(validate.InvalidData):
        evaluate.records(items, clips, tables.described(files), systems, "other dataset")


def test_failed_missing_and_changed_audio(spark, tmp_path):
    items, files, clips = fixture(spark, tmp_path)
    (tmp_path / "alpha" / "hi1.wav").unlink()
    (tmp_path / "beta" / "en1.wav").write_bytes(wav(b"\1\0" * 100))

    def broken():
        def score(x):
            raise RuntimeError

        return score

    good, odd = evaluate.audio_quality(clips.drop("sentences_sha256"), tables.audio(spark, str(tmp_path)), None, broken)
    assert good.isEmpty() and sorted((r["system"], r["id"], r["problem"]) for r in odd.collect()) == [("alpha", "en1", "RuntimeError"), ("alpha", "hi1", "missing"), ("beta", "en1", "other audio"), ("beta", "hi1", "RuntimeError")]


def test_resume(spark):
    now = spark.createDataFrame([("alpha", "a", "hi", "hi-IN", "h1", 1.0), ("beta", "a", "hi", "hi-IN", "h2", 2.0)], "system string, id string, lang string, language_code string, wav_sha256 string, audio_seconds double")
    items = spark.createDataFrame([("a", "x")], "id string, text string")
    was = now.filter("system = 'alpha'").selectExpr("*", "'ok' AS status", "'t' AS transcript", "'r' AS request_id", "'hi-IN' AS detected_language", "'x' AS input_text")
    reused = resume.reused_transcripts(now, items, was, now)
    assert reused.count() == 1 and resume.remaining(now, reused).first()["system"] == "beta"
    for bad in (was.withColumn("wav_sha256", F.lit("z")), was.withColumn("input_text", F.lit("z")), was.unionAll(was), was.withColumn("transcript", F.lit(None).cast("string"))):
        with pytest.raises(validate.InvalidData):
            resume.reused_transcripts(now, items, bad, now)
    with pytest.raises(validate.InvalidData):
        resume.same_settings({"model": 1}, {"model": 2}, ["model"])
    assert metrics.cost(now).first()["cost"] == pytest.approx(3 / 3600 * 30)


def test_embeddings_fall_back(spark):
    def encoder():
        def encode(clips):
            if len(clips) > 1:
                raise MemoryError
            return np.array([[len(c), 1.0] for c in clips])

        return encode

    df = spark.createDataFrame([("a", wav()), ("b", wav(b"\1\0" * 2400))], "id string, content binary")
    assert {r["id"]: r["embedding"] for r in ax.embedded(df, encoder).collect()} == {"a": [3200.0, 1.0], "b": [1600.0, 1.0]}


def test_recognized(spark):
    df = spark.createDataFrame([("a", "hi", wav()), ("b", "hi", b"no")], "id string, lang string, content binary")
    got = {r["id"]: (r["transcript"], r["error"]) for r in ax.recognized(df, lambda: lambda x, lang: f"{lang} {len(x)}").collect()}
    assert got == {"a": ("hi 3200", None), "b": (None, "no 16-bit PCM WAV")}


def test_streaming(spark, tmp_path):
    from cadenza.streaming import results as stream

    items = spark.createDataFrame([("a", "hi", "hello world", None, None)], "id string, lang string, text string, spoken_reference string, usecase string")
    one = spark.createDataFrame([("alpha", "a", "hi", "hi-IN", "u", "w", "h", 1.0, "ok", "hello word", None, None, None, None)], schemas.RESULT)
    for _ in range(2):
        one.write.mode("append").parquet(str(tmp_path / "in"))
    got = []
    q = stream.summarized(stream.arriving(spark, str(tmp_path / "in")), items, str(tmp_path / "store"), str(tmp_path / "cp"), lambda df: got.append({r["slice_kind"]: r["clips"] for r in df.collect()}))
    q.awaitTermination(120)
    assert got[-1]["matched_only"] == 1


def test_stage_runner(spark, tmp_path):
    from cadenza.plans.run import Run, main

    (tmp_path / "items.json").write_text(json.dumps({"items": [{"id": f"{lang}{i}", "lang": lang, "language_code": lang, "text": f"hello {i}"} for lang in ("hi", "en") for i in range(2)]}))
    run = Run(spark, str(tmp_path / "items.json"), str(tmp_path / "run"), ["alpha", "beta"])
    sound = wav(b"\1\0\x10\0" * 2400)
    run.generate(lambda system: lambda item: {"status": "ok", "content": sound, "audio_seconds": 0.2, "voice": "v"})
    run.generate(lambda system: lambda item: 1 / 0)  # all is there already
    assert run.asr(None, dry=True)["clips"] == 8
    said = []
    run.asr(lambda key, rows: said.append(key) or [{**r, "status": "ok", "transcript": f"hello {r['id'][-1]}"} for r in rows])
    assert said == ["en_0000", "hi_0000"] and run.asr(None, dry=True)["clips"] == 0
    run.mos(lambda: lambda x: (3.0, 4.0))
    run.mos(lambda: lambda x: 1 / 0)
    run.consistency(lambda: lambda clips: np.ones((len(clips), 3)))
    text = run.report(str(tmp_path / "R.md"))
    assert "| Voice consistency | 1.00 | 1.00 |" in text and (tmp_path / "R.md").read_text() == text
    assert main(["--sentences", str(tmp_path / "items.json"), "--output", str(tmp_path / "none"), "--stage", "report"]) == 1


def prompts(tmp_path, n=2):
    (tmp_path / "items.json").write_text(json.dumps({"items": [{"id": f"{lang}{i}", "lang": lang, "language_code": lang, "text": f"hello {i}"} for lang in ("hi", "en") for i in range(n)]}))
    return str(tmp_path / "items.json")


def said(key, rows):
    return [{**r, "status": "ok", "transcript": f"hello {r['id'][-1]}"} for r in rows]


def test_runner_settings_reuse_and_outputs(spark, tmp_path):
    from cadenza.plans.run import Run

    sound = wav(b"\1\0\x10\0" * 2400)
    speak = lambda system: lambda item: {"status": "ok", "content": sound, "audio_seconds": 0.2, "voice": "v"}
    run = Run(spark, prompts(tmp_path), str(tmp_path / "run"), ["alpha", "beta"])
    told = {"alpha": {"model": "m1", "endpoint": "https://x.example"}, "beta": {}}
    run.generate(speak, told)
    for key, other in (("model", "m2"), ("endpoint", "https://y.example"), ("voice", "w"), ("sample_rate_requested", 8000)):
        with pytest.raises(validate.InvalidData, match=key):
            run.generate(speak, {**told, "alpha": {**told["alpha"], key: other}})
    run.asr(said, settings={"model": "a"}, size=3)
    summary = json.loads((tmp_path / "run" / "summary.json").read_text())
    assert summary["coverage_complete"] and summary["scored_clips"] == 8 and summary["matched_ids"] == 4 and summary["config"]["model"] == "a" and summary["created_utc"].endswith("+00:00")
    assert [x["slice_value"] for x in summary["slices"]["lang"]] == ["en", "hi", "en", "hi"]
    lines = spark.read.text(str(tmp_path / "run" / "transcripts.tsv")).collect()
    assert {r[0] for r in lines if r[0].startswith("system")} == {"system\tid\tlang\tusecase\tWER_percent\tCER_percent\treference\tASR_hypothesis"}
    assert sum(not r[0].startswith("system") for r in lines) == 8 and any(r[0].startswith("alpha\ten0\ten\t") and r[0].endswith("0.0\t0.0\thello 0\thello 0") for r in lines)
    with pytest.raises(validate.InvalidData, match="model"):
        run.asr(said, settings={"model": "b"})
    other = Run(spark, prompts(tmp_path), str(tmp_path / "other"), ["alpha", "beta"])
    other.generate(speak, told)
    assert other.asr(None, dry=True, settings={"model": "a"}, reuse=str(tmp_path / "run"))["clips"] == 0
    other.asr(lambda key, rows: 1 / 0, settings={"model": "a"}, reuse=str(tmp_path / "run"))
    assert other.transcripts().filter("reused_asr").count() == 8
    for bad in (dict(settings={"model": "b"}, reuse=str(tmp_path / "run")), dict(reuse=str(tmp_path / "other"))):
        with pytest.raises(validate.InvalidData):
            other.asr(said, dry=True, **bad)


def test_runner_stops_and_resumes(spark, tmp_path):
    """A refusal ends the stage after its wave, a failed batch leaves the others' results, changed audio is found."""
    from cadenza.plans.run import Run

    sound = wav(b"\1\0\x10\0" * 2400)
    run = Run(spark, prompts(tmp_path, 8), str(tmp_path / "run"), ["alpha", "beta"])
    with pytest.raises(clients.Refused):
        run.generate(lambda system: lambda item: {"status": "failed", "http_status": 429}, waves=8)
    asked = run.clips().count()
    assert 0 < asked < 32
    run.generate(lambda system: lambda item: {"status": "ok", "content": sound, "audio_seconds": 0.2, "voice": "v"}, waves=2)

    def half(key, rows):
        if key == "hi_0000":
            raise TimeoutError
        return said(key, rows)

    with pytest.raises(TimeoutError):
        run.asr(half)
    summary = json.loads((tmp_path / "run" / "summary.json").read_text())
    assert summary["scored_clips"] == 16 and not summary["coverage_complete"] and run.asr(None, dry=True)["clips"] == 16
    clips = run.clips().withColumn("content", F.when(F.col("id") == "hi0", F.lit(b"x")).otherwise(F.col("content")))
    clips.write.parquet(str(tmp_path / "changed"))
    spark.read.parquet(str(tmp_path / "changed")).write.mode("overwrite").parquet(str(tmp_path / "run" / "clips"))
    with pytest.raises(validate.InvalidData, match="changed"):
        run.generate(lambda system: lambda item: 1 / 0)


def test_models_are_called_once_a_clip(spark, tmp_path):
    from cadenza.plans.run import Run

    calls, sound = tmp_path / "calls", wav(b"\1\0\x10\0" * 2400)
    run = Run(spark, prompts(tmp_path), str(tmp_path / "run"), ["alpha"])
    run.generate(lambda system: lambda item: {"status": "ok", "content": sound, "audio_seconds": 0.2, "voice": "v"})
    told = str(calls)

    def note(what, n=1):
        with open(told, "a") as f:
            f.write(what * n)

    run.mos(lambda: lambda x: note("s") or (3.0, 4.0))
    run.consistency(lambda: lambda clips: note("e", len(clips)) or np.ones((len(clips), 3)))
    assert sorted(calls.read_text()) == ["e"] * 4 + ["s"] * 4
    run.recognize(lambda: lambda x, lang: f"hello {lang}", ["hi"])
    assert run.transcripts().count() == 2 and {r["reason"] for r in run.saved("asr-excluded").collect()} == {"unsupported_by_asr"}


def test_assets_addresses_padding_and_order(spark, tmp_path):
    from cadenza.sources import assets

    (tmp_path / "model.bin").write_bytes(b"weights")
    told = assets.identity(str(tmp_path), ["model.bin"])
    assert assets.pinned(str(tmp_path), told, lambda folder: "loaded")() == "loaded"
    with pytest.raises(validate.InvalidData):
        assets.pinned(str(tmp_path), {"model.bin": "0" * 64}, lambda folder: None)()
    assert clients.endpoint("https://x.example/", "speak") == clients.endpoint("https://x.example", "speak") == "https://x.example/speak"
    rows, sizes = ax.padded([np.ones(2), np.ones(4)])
    assert rows.tolist() == [[1, 1, 0, 0], [1, 1, 1, 1]] and sizes.tolist() == [0.5, 1]
    df = spark.createDataFrame([("a", "usecase", v) for v in ("Z", None, "A")], "system string, slice_kind string, slice_value string")
    assert [r["slice_value"] for r in metrics.by_value(df, "usecase").collect()] == ["A", None, "Z"]
    logits = spark.createDataFrame([([0.5, 3.0, 1.0, 2.0], [0, 2, 3])], "logits array<double>, mask array<int>")
    assert logits.select(ctc.argmax(ctc.masked(F.col("logits"), F.col("mask")))).first()[0] == 2
    assert sinks.now_utc()[:2] == "20"


def test_manifests_and_their_ids(spark, tmp_path):
    head = {"system": "alpha", "sentences_sha256": "D", "model": "m"}
    (tmp_path / "a.json").write_text(json.dumps({**head, "items": [{"id": "x", "lang": "hi", "code": "hi-IN", "status": "ok", "wav_sha256": "h"}, {"id": "z", "status": "failed", "error_type": "E"}]}))
    clips = tables.manifests(spark, [str(tmp_path / "a.json")], code_field="code")
    assert {(r["system"], r["id"], r["language_code"], r["system_model"]) for r in clips.collect()} == {("alpha", "x", "hi-IN", "m"), ("alpha", "z", None, "m")}
    assert [r["id"] for r in evaluate.failures(clips).collect()] == ["z"]
    wanted = spark.createDataFrame([("alpha", "x"), ("alpha", "y")], "system string, id string")
    assert {(r["id"], r["violation"]) for r in validate.manifest(clips, wanted, "D").collect()} == {("z", "unexpected id"), ("y", "missing id")}
    assert validate.manifest(clips.filter("id = 'x'"), wanted.filter("id = 'x'"), "other").first()["violation"] == "other dataset"


def test_stereo_and_saved_audio(spark, tmp_path):
    left = np.array([1000, 2000, 3000], "<i2")
    both = np.stack([left, -left], axis=1).tobytes()
    assert not ax.samples(wav(both, channels=2)).any() and ax.samples(wav(np.stack([left, left], axis=1).tobytes(), channels=2, rate=16000)).tolist() == (left / 32768).tolist()
    folder = str(tmp_path)

    def save(system, name, content):
        with open(f"{folder}/{system}__{name}.wav", "wb") as f:
            f.write(content)

    sinks.write_audio(spark.createDataFrame([("a", "x", "ok", b"1"), ("a", "y", "failed", None)], "system string, id string, status string, content binary"), save)
    assert [p.name for p in tmp_path.iterdir()] == ["a__x.wav"] and (tmp_path / "a__x.wav").read_bytes() == b"1"
