"""The registered queries of the evaluation operators, each with SQL of the same result where SQL can say it.

The test tables hold no audio or transcripts, so operators run on the nearest table: consecutive turns
of a conversation stand for reference and hypothesis, event types for systems, labels for scores,
embeddings of one label for a voice's clips.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadenza.functions import ctc
from cadenza.functions import text as tx
from cadenza.functions import vectors as vx
from cadenza.operators import batching, consistency, coverage, metrics, resume, validate
from cadenza.plans import evaluate
from cadenza.sources import tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def long(*names: str) -> list:
    return [F.col(n).cast("long").alias(n) for n in names]


CLEAN = "trim(regexp_replace(regexp_replace(regexp_replace(lower({t}), '[‌‍]', '', 'g'), '[^\\p{{L}}\\p{{M}}\\p{{N}}_]', ' ', 'g'), ' +', ' ', 'g'))"
SPLIT = "list_filter(string_split({t}, ' '), lambda w: w <> '')"

PAIRS = f"""
turns AS (SELECT conv_id, turn, role, text AS reference, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS hypothesis FROM conversations),
clean AS (SELECT conv_id, turn, role, {CLEAN.format(t='nfc_normalize(reference)')} AS r, {CLEAN.format(t='nfc_normalize(hypothesis)')} AS h FROM turns WHERE hypothesis IS NOT NULL),
split AS (SELECT *, {SPLIT.format(t='r')} AS rw, {SPLIT.format(t='h')} AS hw, list_distinct(string_split(r || h, '')) AS vc FROM clean),
ids AS (SELECT *, list_distinct(list_concat(rw, hw)) AS v FROM split),
coded AS (
  SELECT *, list_transform(rw, lambda w: CAST(list_position(v, w) AS INTEGER)) AS ri, list_transform(hw, lambda w: [CAST(list_position(v, w) AS INTEGER)]) AS hi,
    array_to_string(list_transform(string_split(r, ''), lambda c: chr(CAST(list_position(vc, c) AS INTEGER) + 31)), '') AS rc,
    array_to_string(list_transform(string_split(h, ''), lambda c: chr(CAST(list_position(vc, c) AS INTEGER) + 31)), '') AS hc
  FROM ids
),
edits AS (
  SELECT conv_id, turn, role, CAST(len(rw) AS BIGINT) AS reference_words, CAST(length(r) AS BIGINT) AS reference_characters, CAST(levenshtein(rc, hc) AS BIGINT) AS character_edits,
    CAST(list_reduce(hi, lambda row, w: list_reduce(list_transform(range(1, len(ri) + 1), lambda j: [CAST(j AS INTEGER)]),
      lambda acc, j: list_append(acc, least(row[j[1] + 1] + 1, acc[j[1]] + 1, row[j[1]] + CASE WHEN ri[j[1]] = w[1] THEN 0 ELSE 1 END)), [row[1] + 1]),
      list_transform(range(0, len(ri) + 1), lambda i: CAST(i AS INTEGER)))[-1] AS BIGINT) AS word_edits
  FROM coded
)"""


def turn_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Consecutive turns as reference and hypothesis, scored."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    turns = read(spark, sf, "conversations").select("conv_id", "turn", "role", F.col("text").alias("reference"), F.lead("text").over(w).alias("hypothesis"))
    return tx.score_text(turns.filter("hypothesis IS NOT NULL"), deal=["conv_id", "turn"])


@query(f"WITH {PAIRS} SELECT conv_id, turn, word_edits, character_edits, reference_words, reference_characters FROM edits")
def q_edit_counts(spark: SparkSession, sf: str) -> DataFrame:
    return turn_pairs(spark, sf).select("conv_id", "turn", "word_edits", "character_edits", "reference_words", "reference_characters")


@query(f"""WITH {PAIRS} SELECT role, count(*) AS clips, CAST(sum(reference_words) AS BIGINT) AS reference_words, CAST(sum(word_edits) AS BIGINT) AS word_edits,
round(100.0 * sum(word_edits) / sum(reference_words), 6) AS corpus_wer_percent, round(100.0 * sum(character_edits) / sum(reference_characters), 6) AS corpus_cer_percent,
round(100 * avg(word_edits / reference_words), 6) AS mean_sentence_wer_percent, round(100 * avg(character_edits / reference_characters), 6) AS mean_sentence_cer_percent
FROM edits GROUP BY role""")
def q_wer_by_role(spark: SparkSession, sf: str) -> DataFrame:
    rows = turn_pairs(spark, sf).withColumn("lang", F.lit("any"))
    out = rows.groupBy("role").agg(*metrics.error_rates())
    rates = ["corpus_wer_percent", "corpus_cer_percent", "mean_sentence_wer_percent", "mean_sentence_cer_percent"]
    return out.select("role", *long("clips", "reference_words", "word_edits"), *[F.round(c, 6).alias(c) for c in rates])


@query(f"SELECT doc_id, {CLEAN.format(t='nfc_normalize(text)')} AS normalized, CAST(len({SPLIT.format(t=CLEAN.format(t='nfc_normalize(text)'))}) AS BIGINT) AS n_words FROM documents")
def q_normalize_text(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents").select("doc_id", tx.normalize(F.col("text")).alias("normalized"))
    return docs.select("doc_id", "normalized", F.size(tx.words(F.col("normalized"))).cast("long").alias("n_words"))


@query("SELECT lang, count(*) FILTER (regexp_matches(text, '\\p{Nd}')) AS with_digits, count(*) AS n FROM documents GROUP BY lang")
def q_has_digits_by_lang(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "documents").groupBy("lang").agg(F.count_if(tx.has_digits(F.col("text"))).alias("with_digits"), F.count(F.lit(1)).alias("n"))


@query("""WITH d AS (SELECT doc_id % 2 AS sys, lang, source, n_chars, regexp_matches(text, '\\p{Nd}') AS dig FROM documents)
SELECT CASE WHEN sys = 0 THEN 'even' ELSE 'odd' END AS system, 'matched_only' AS slice_kind, CAST(NULL AS VARCHAR) AS slice_value, count(*) AS clips, CAST(sum(n_chars) AS BIGINT) AS chars FROM d GROUP BY sys
UNION ALL SELECT CASE WHEN sys = 0 THEN 'even' ELSE 'odd' END, 'lang', lang, count(*), CAST(sum(n_chars) AS BIGINT) FROM d GROUP BY sys, lang
UNION ALL SELECT CASE WHEN sys = 0 THEN 'even' ELSE 'odd' END, 'usecase', source, count(*), CAST(sum(n_chars) AS BIGINT) FROM d GROUP BY sys, source
UNION ALL SELECT CASE WHEN sys = 0 THEN 'even' ELSE 'odd' END, 'without_has_digits', NULL, count(*), CAST(sum(n_chars) AS BIGINT) FROM d WHERE NOT dig GROUP BY sys""")
def q_slices_grouping_sets(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents").select(F.when(F.col("doc_id") % 2 == 0, "even").otherwise("odd").alias("system"), "lang", F.col("source").alias("usecase"), "n_chars", tx.has_digits(F.col("text")).alias("has_digits"))
    out = metrics.slices(docs, [F.count(F.lit(1)).alias("clips"), F.sum("n_chars").alias("chars")])
    return out.select("system", "slice_kind", "slice_value", "clips", "chars")


N_TYPES = "(SELECT count(DISTINCT event_type) FROM events)"


def event_types(spark: SparkSession, sf: str) -> tuple[DataFrame, int]:
    e = read(spark, sf, "events").select(F.col("event_type").alias("system"), F.col("user_id").alias("id"), "value")
    return e, e.agg(F.count_distinct("system")).first()[0]


@query(f"SELECT user_id AS id FROM events GROUP BY user_id HAVING count(DISTINCT event_type) = {N_TYPES}")
def q_matched_ids(spark: SparkSession, sf: str) -> DataFrame:
    return coverage.matched(*event_types(spark, sf))


@query(f"""SELECT event_type AS system, count(*) AS n, round(avg(value), 6) AS mean_value FROM events
WHERE user_id IN (SELECT user_id FROM events GROUP BY user_id HAVING count(DISTINCT event_type) = {N_TYPES}) GROUP BY event_type""")
def q_matched_metrics(spark: SparkSession, sf: str) -> DataFrame:
    rows = coverage.only_matched(*event_types(spark, sf))
    return rows.groupBy("system").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean_value"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def q_missing_anti(spark: SparkSession, sf: str) -> DataFrame:
    return coverage.missing(read(spark, sf, "documents").select("doc_id"), read(spark, sf, "labels"), on=("doc_id",))


@query("""SELECT 2 * count(*) AS expected_clips, 2 * (SELECT count(DISTINCT doc_id) FROM labels) AS scored_clips,
2 * count(*) = 2 * (SELECT count(DISTINCT doc_id) FROM labels) AS coverage_complete FROM (SELECT DISTINCT doc_id FROM documents)""")
def q_coverage_counts(spark: SparkSession, sf: str) -> DataFrame:
    both = ["alpha", "beta"]
    expected = coverage.grid(read(spark, sf, "documents").select(F.col("doc_id").alias("id")), both)
    return coverage.counts(expected, coverage.grid(read(spark, sf, "labels").select(F.col("doc_id").alias("id")), both))


@query("""WITH l AS (SELECT doc_id, count(*) AS k FROM labels GROUP BY 1), d AS (SELECT doc_id, count(*) AS k FROM documents GROUP BY 1)
SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CAST(coalesce(d.k, 0) - coalesce(l.k, 0) AS BIGINT) AS excess FROM d FULL JOIN l ON d.doc_id = l.doc_id WHERE coalesce(d.k, 0) <> coalesce(l.k, 0)""")
def q_set_equality(spark: SparkSession, sf: str) -> DataFrame:
    return coverage.set_difference(read(spark, sf, "documents").select("doc_id"), read(spark, sf, "labels").select("doc_id"))


@query("SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels")
def q_intersect_ids(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "documents").select("doc_id").intersect(read(spark, sf, "labels").select("doc_id"))


@query("SELECT sha256(text) AS text_sha256, count(*) AS count FROM documents GROUP BY 1 HAVING count(*) > 1")
def q_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return coverage.repeated(read(spark, sf, "documents").select(F.sha2("text", 256).alias("text_sha256")), "text_sha256")


@query(f"""SELECT CAST(doc_id AS VARCHAR) AS id, 'empty reference' AS violation FROM documents WHERE {CLEAN.format(t='text')} = ''
UNION ALL SELECT CAST(doc_id AS VARCHAR), 'unusable text' FROM documents WHERE regexp_matches(text, '^[\\s\\p{{Z}}]*$') OR text IS NULL
UNION ALL SELECT source || '.' || doc_id, 'unsafe id' FROM documents WHERE doc_id % 10 = 0""")
def q_validation_violations(spark: SparkSession, sf: str) -> DataFrame:
    """Every tenth prompt is given an id with a dot, so that there is something to find."""
    plain = F.col("doc_id").cast("string")
    name = F.when(F.col("doc_id") % 10 == 0, F.concat("source", F.lit("."), plain)).otherwise(plain)
    return validate.items(read(spark, sf, "documents").select(name.alias("id"), "lang", "text"))


@query("SELECT doc_id, sha256(text) AS sha256 FROM documents")
def q_content_sha256(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))


@query("""WITH c AS (SELECT doc_id AS id, CAST(quality AS DOUBLE) AS p808, CAST(toxic AS DOUBLE) AS ovrl FROM labels)
SELECT d.doc_id AS id, d.lang, c.p808, c.ovrl, c.id IS NOT NULL AS reused FROM documents d LEFT JOIN c ON d.doc_id = c.id""")
def q_cache_reuse_join(spark: SparkSession, sf: str) -> DataFrame:
    """Labels stand for cached scores: documents with a label reuse it, the others are to be scored."""
    docs = read(spark, sf, "documents").select(F.col("doc_id").alias("id"), "lang")
    cache = read(spark, sf, "labels").select(F.col("doc_id").alias("id"), F.col("quality").cast("double").alias("p808"), F.col("toxic").cast("double").alias("ovrl"))
    reused, todo = resume.cached(docs, cache, on=("id",))
    both = resume.together(reused.withColumn("reused", F.lit(True)), todo.withColumn("reused", F.lit(False)))
    return both.select("id", "lang", "p808", "ovrl", "reused")


@query("""SELECT lang AS language_code, doc_id AS id, CAST(floor((row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1) / 20) AS BIGINT) AS batch,
lang || '_' || format('{:04d}', CAST(floor((row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1) / 20) AS BIGINT)) AS batch_key,
source, sha256(text) AS text_sha256 FROM documents""")
def q_batches_of_20(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents").select(F.col("lang").alias("language_code"), F.col("doc_id").alias("id"), "source", "text")
    return batching.numbered(docs, order=("id",)).withColumn("text_sha256", F.sha2("text", 256)).drop("text")


UNITS = """
raw AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
unit AS (SELECT vec_id, label, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS u FROM raw),
flat AS (SELECT label, unnest(u) AS x, unnest(range(1, len(u) + 1)) AS i FROM unit),
sums AS (SELECT label, list(s ORDER BY i) AS S FROM (SELECT label, i, sum(x) AS s FROM flat GROUP BY label, i) GROUP BY label),
rest AS (SELECT vec_id, label, u, list_transform(range(1, len(u) + 1), lambda i: S[i] - u[i]) AS c FROM unit JOIN sums USING (label)),
score AS (SELECT vec_id, label, list_dot_product(u, c) / sqrt(list_dot_product(c, c)) AS cosine FROM rest)"""


def cosines(spark: SparkSession, sf: str) -> DataFrame:
    return consistency.leave_one_out(read(spark, sf, "embeddings").select("vec_id", "label", "embedding"), ["label"])


@query(f"WITH {UNITS} SELECT vec_id, label, round(cosine, 6) AS speaker_cosine FROM score")
def q_loo_cosine(spark: SparkSession, sf: str) -> DataFrame:
    return cosines(spark, sf).select("vec_id", "label", F.round("speaker_cosine", 6).alias("speaker_cosine"))


@query(f"""WITH {UNITS} SELECT label, count(*) AS n, round(avg(cosine), 6) AS mean, round(median(cosine), 6) AS median, round(stddev_samp(cosine), 6) AS standard_deviation,
round(min(cosine), 6) AS minimum, round(max(cosine), 6) AS maximum FROM score GROUP BY label""")
def q_consistency_stats(spark: SparkSession, sf: str) -> DataFrame:
    out = consistency.per_group(cosines(spark, sf), ["label"])
    return out.select("label", "n", *[F.round(c, 6).alias(c) for c in ("mean", "median", "standard_deviation", "minimum", "maximum")])


@query(f"""WITH {UNITS}, each AS (SELECT label % 2 AS system, label, count(*) AS n, avg(cosine) AS m, sum(cosine) AS s FROM score GROUP BY ALL)
SELECT system, CAST(sum(n) AS BIGINT) AS n, round(avg(m), 6) AS macro_mean_across_languages, round(sum(s) / sum(n), 6) AS all_clips_mean FROM each GROUP BY system""")
def q_consistency_overall(spark: SparkSession, sf: str) -> DataFrame:
    rows = cosines(spark, sf).withColumn("system", F.col("label") % 2)
    out = consistency.overall(rows, language="label")
    return out.select("system", *long("n"), F.round("macro_mean_across_languages", 6).alias("macro_mean_across_languages"), F.round("all_clips_mean", 6).alias("all_clips_mean"))


@query("SELECT count(*) AS clips, round(sum(value) / 3600, 6) AS hours, round(sum(value) / 3600 * 30, 6) AS cost FROM events")
def q_cost_estimate(spark: SparkSession, sf: str) -> DataFrame:
    out = metrics.cost(read(spark, sf, "events"), seconds="value")
    return out.select("clips", F.round("hours", 6).alias("hours"), F.round("cost", 6).alias("cost"))


@query("""SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN NULL WHEN doc_id % 4 = 1 THEN lang || '_female_default' WHEN doc_id % 4 = 2 THEN 'en_female_default' ELSE source END AS voice,
coalesce(CASE WHEN doc_id % 4 = 0 THEN NULL WHEN doc_id % 4 = 1 THEN lang || '_female_default' WHEN doc_id % 4 = 2 THEN 'en_female_default' ELSE source END, 'unknown') AS voice_or_unknown FROM documents""")
def q_voice_case(spark: SparkSession, sf: str) -> DataFrame:
    """The modes take turns; a source stands for a preset's name."""
    case = F.col("doc_id") % 4
    mode = F.when(case == 0, "").when(case == 1, "lang_female").when(case == 2, "en_default").otherwise(F.col("source"))
    voice = tx.voice(mode, F.col("lang"))
    return read(spark, sf, "documents").select("doc_id", voice.alias("voice"), F.coalesce(voice, F.lit("unknown")).alias("voice_or_unknown"))


@query("SELECT doc_id, coalesce(quality_note, source) AS reference FROM (SELECT d.doc_id, d.source, CASE WHEN l.quality = 1 THEN 'spoken ' || d.lang END AS quality_note FROM documents d LEFT JOIN labels l USING (doc_id))")
def q_reference_fallback(spark: SparkSession, sf: str) -> DataFrame:
    both = read(spark, sf, "documents").join(read(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    spoken = F.when(F.col("quality") == 1, F.concat(F.lit("spoken "), "lang"))
    return both.select("doc_id", tx.reference_of(spoken, F.col("source")).alias("reference"))


@query("""SELECT coalesce(d.doc_id, l.doc_id) AS id, CASE WHEN d.doc_id IS NULL THEN 'only right' WHEN l.doc_id IS NULL THEN 'only left' ELSE 'differs' END AS violation
FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id WHERE d.doc_id IS NULL OR l.doc_id IS NULL OR d.doc_id % 2 <> l.quality""")
def q_audit_join(spark: SparkSession, sf: str) -> DataFrame:
    left = read(spark, sf, "documents").select(F.col("doc_id").alias("id"), (F.col("doc_id") % 2).cast("int").alias("mark"))
    right = read(spark, sf, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("mark"))
    return validate.same_clips(left, right, on=("id",), equal=("mark",))


@query("SELECT event_id, coalesce(json_extract_string(props, '$.k'), 'none') AS k, sha256(coalesce(props, '')) AS props_sha256 FROM events")
def q_json_props(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "events").select("event_id", F.coalesce(F.get_json_object("props", "$.k"), F.lit("none")).alias("k"), F.sha2(F.coalesce("props", F.lit("")), 256).alias("props_sha256"))


TYPES = "(SELECT list(DISTINCT event_type ORDER BY event_type) FROM events)"


@query(f"""WITH c AS (SELECT user_id, event_id, ts, list_position({TYPES}, event_type) - 1 AS code FROM events),
k AS (SELECT user_id, event_id, ts, code, lag(code) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM c)
SELECT user_id, array_to_string(list(CAST(code AS VARCHAR) ORDER BY ts, event_id) FILTER (code <> 0 AND (before IS NULL OR before <> code)), ' ') AS codes FROM k GROUP BY user_id
HAVING count(*) FILTER (code <> 0) > 0""")
def q_ctc_collapse(spark: SparkSession, sf: str) -> DataFrame:
    """Each user's events in time order as a frame sequence; the first type is the blank."""
    e = read(spark, sf, "events")
    types = [r[0] for r in e.select("event_type").distinct().orderBy("event_type").collect()]
    code = F.array_position(F.array(*map(F.lit, types)), F.col("event_type")) - 1
    runs = e.groupBy("user_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("ts", "event_id", code.cast("int").alias("code")))), lambda x: x["code"]).alias("ids"))
    kept = ctc.collapsed(F.col("ids"), F.lit(0))
    return runs.select("user_id", F.array_join(F.transform(kept, lambda x: x.cast("string")), " ").alias("codes")).filter("codes <> ''")


@query("""SELECT CAST(floor(user_id / 10) AS BIGINT) AS slice_value, CAST(count(*) FILTER (event_type = 'view') AS BIGINT) AS view, CAST(count(*) FILTER (event_type = 'click') AS BIGINT) AS click,
CAST(count(*) FILTER (event_type IS NULL OR event_type NOT IN ('view', 'click')) AS BIGINT) AS other FROM events GROUP BY 1""")
def q_report_rows(spark: SparkSession, sf: str) -> DataFrame:
    system = F.when(F.col("event_type").isin("view", "click"), F.col("event_type")).otherwise("other")
    e = read(spark, sf, "events").groupBy(F.floor(F.col("user_id") / 10).alias("slice_value"), system.alias("system")).count()
    out = metrics.pivoted(e, "count", "slice_value", ["view", "click", "other"])
    return out.select("slice_value", *[F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c) for c in ("view", "click", "other")])


@query("""SELECT label, count(*) AS n, round(avg(list_dot_product(e, list_transform(e, lambda x: greatest(-0.5, least(0.5, x))))), 6) AS clipped_dot
FROM (SELECT label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings) GROUP BY label""")
def q_clipped_vectors(spark: SparkSession, sf: str) -> DataFrame:
    e = read(spark, sf, "embeddings").select("label", F.col("embedding").cast("array<double>").alias("e"))
    return e.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(vx.dot(F.col("e"), vx.clipped(F.col("e"), -0.5, 0.5))), 6).alias("clipped_dot"))


# Synthetic clips: a document's length gives the number of silent frames of a WAV file at 24 kHz. In the odd set some have
# two channels, no frame, another hash or a failed status, and only labelled documents have a file.
_LE4 = "substr(format('{{:08X}}', {n}), 7, 2) || substr(format('{{:08X}}', {n}), 5, 2) || substr(format('{{:08X}}', {n}), 3, 2) || substr(format('{{:08X}}', {n}), 1, 2)"
_LE2 = "substr(format('{{:04X}}', {n}), 3, 2) || substr(format('{{:04X}}', {n}), 1, 2)"


def _wav_sql(frames: str, channels: str) -> str:
    size = "CAST(2 * ch * frames AS BIGINT)"
    return f"""wav AS (
  SELECT doc_id, lang, frames, ch, unhex('52494646' || {_LE4.format(n=f'36 + {size}')} || '57415645666D7420100000000100' || {_LE2.format(n='ch')} || 'C05D0000' ||
    {_LE4.format(n='48000 * ch')} || {_LE2.format(n='2 * ch')} || '100064617461' || {_LE4.format(n=size)} || repeat('00', {size})) AS content
  FROM (SELECT doc_id, lang, CAST({frames} AS BIGINT) AS frames, CAST({channels} AS BIGINT) AS ch FROM documents)
)"""


CLEAN_WAV = _wav_sql("coalesce(n_chars, 0) % 400 + 1", "1")
ODD_WAV = _wav_sql("coalesce(n_chars, 0) % 400", "CASE WHEN doc_id % 7 = 0 THEN 2 ELSE 1 END")
LABELLED = "(SELECT DISTINCT doc_id FROM labels)"


def little_endian(n: Column, size: int) -> Column:
    """Hex digits of a number's bytes, the lowest first."""
    digits = F.lpad(F.hex(n.cast("long")), 2 * size, "0")
    return F.concat(*[F.substring(digits, 2 * i + 1, 2) for i in reversed(range(size))])


def clips(spark: SparkSession, sf: str, odd: bool) -> DataFrame:
    """(system, doc_id, id, lang, status, wav_sha256, content) of synthetic clips."""
    length = F.coalesce("n_chars", F.lit(0)) % 400
    channels = F.when(F.col("doc_id") % 7 == 0, 2).otherwise(1) if odd else F.lit(1)
    docs = read(spark, sf, "documents").withColumns({"frames": length if odd else length + 1, "ch": channels})
    ch, size = F.col("ch"), F.col("frames") * F.col("ch") * 2
    head = F.concat(
        F.lit("52494646"), little_endian(size + 36, 4), F.lit("57415645666D7420100000000100"), little_endian(ch, 2), F.lit("C05D0000"),
        little_endian(ch * 48_000, 4), little_endian(ch * 2, 2), F.lit("100064617461"), little_endian(size, 4),
    )
    out = docs.withColumn("content", F.unhex(F.concat(head, F.repeat(F.lit("00"), size.cast("int")))))
    status, digest = F.lit("ok"), F.sha2("content", 256)
    if odd:
        status, digest = F.when(F.col("doc_id") % 13 == 0, "failed").otherwise("ok"), F.when(F.col("doc_id") % 5 == 0, "another").otherwise(digest)
    return out.select(F.lit("alpha").alias("system"), "doc_id", F.col("doc_id").cast("string").alias("id"), "lang", status.alias("status"), digest.alias("wav_sha256"), "content")


def labelled(spark: SparkSession, sf: str, rows: DataFrame) -> DataFrame:
    return rows.join(read(spark, sf, "labels"), "doc_id", "left_semi")


@query(f"""WITH {ODD_WAV} SELECT CAST(w.doc_id AS VARCHAR) AS id,
CASE WHEN w.doc_id % 13 = 0 THEN 'not generated' WHEN l.doc_id IS NULL THEN 'no file' WHEN w.doc_id % 5 = 0 THEN 'other audio' WHEN ch = 2 OR frames = 0 THEN 'other format' END AS problem,
CASE WHEN l.doc_id IS NOT NULL THEN sha256(content) END AS sha256, CASE WHEN l.doc_id IS NOT NULL THEN ch END AS channels,
CASE WHEN l.doc_id IS NOT NULL THEN frames END AS frames, CASE WHEN l.doc_id IS NOT NULL THEN round(frames / 24000.0, 6) END AS audio_seconds
FROM wav w LEFT JOIN {LABELLED} l USING (doc_id)""")
def q_audio_problems(spark: SparkSession, sf: str) -> DataFrame:
    """Every clip with its file's hash and header, and why it can't be used."""
    made = clips(spark, sf, odd=True)
    files = tables.described(labelled(spark, sf, made))
    out = validate.audio(made.select("system", "id", "status", "wav_sha256"), files)
    return out.select("id", "problem", "sha256", "header.channels", "header.frames", F.round("audio_seconds", 6).alias("audio_seconds"))


@query(f"""WITH {CLEAN_WAV} SELECT 'alpha' AS system, CAST(doc_id AS VARCHAR) AS id, lang, upper(lang) AS language_code, 'alpha__' || doc_id || '.wav' AS upload_name,
'alpha/' || doc_id || '.wav' AS relative_wav, sha256(content) AS wav_sha256, round(frames / 24000.0, 6) AS audio_seconds FROM wav""")
def q_input_records(spark: SparkSession, sf: str) -> DataFrame:
    made = clips(spark, sf, odd=False).withColumn("sentences_sha256", F.lit("dataset"))
    items = made.select("id", "lang", F.upper("lang").alias("language_code"))
    out = evaluate.records(items, made, tables.described(made), ["alpha"], "dataset")
    return out.withColumn("audio_seconds", F.round("audio_seconds", 6))


def lengths() -> Callable:
    """A scorer whose values are known: the number of samples at 16 kHz, and half of it."""
    return lambda x: (float(len(x)), len(x) / 2)


@query(f"""WITH {ODD_WAV}, known AS (
  SELECT CAST(w.doc_id AS VARCHAR) AS id, frames, k.quality, k.toxic,
    CASE WHEN k.doc_id IS NULL THEN 'missing' WHEN w.doc_id % 13 = 0 OR w.doc_id % 5 = 0 THEN 'other audio' WHEN k.quality <> 1 AND frames = 0 THEN 'ValueError' END AS problem
  FROM wav w LEFT JOIN labels k USING (doc_id)
)
SELECT id, problem, CASE WHEN problem IS NULL THEN CASE WHEN quality = 1 THEN CAST(toxic AS DOUBLE) ELSE ceil(frames * 2 / 3.0) END END AS p808,
CASE WHEN problem IS NULL THEN CASE WHEN quality = 1 THEN 1.0 ELSE ceil(frames * 2 / 3.0) / 2 END END AS ovrl FROM known""")
def q_audio_quality(spark: SparkSession, sf: str) -> DataFrame:
    """Labels of quality 1 stand for cached values; other clips that can be used are scored."""
    made = clips(spark, sf, odd=True)
    known = read(spark, sf, "labels").filter("quality = 1").select("doc_id", F.col("toxic").cast("double").alias("p808"), F.col("quality").cast("double").alias("ovrl"))
    cache = made.join(known, "doc_id").select("system", "id", "wav_sha256", "lang", "p808", "ovrl")
    files = labelled(spark, sf, made).select("system", "id", "content")
    good, odd = evaluate.audio_quality(made.drop("content", "doc_id"), files, cache, lengths)
    return resume.together(good.select("id", "p808", "ovrl"), odd.select("id", "problem")).select("id", "problem", "p808", "ovrl")


SAID = """said AS (
  SELECT s.system, CAST(d.doc_id AS VARCHAR) AS id, d.lang, d.source AS usecase, regexp_matches(d.text, '\\p{Nd}') AS dig,
    CASE s.system WHEN 'alpha' THEN 0 WHEN 'beta' THEN 1 ELSE 2 END AS we, length(d.source || ' ' || d.lang) AS rc,
    CASE s.system WHEN 'alpha' THEN 0 WHEN 'beta' THEN levenshtein(d.source || ' ' || d.lang, d.source || ' x') ELSE length(d.source || ' ' || d.lang) END AS ce
  FROM documents d, (VALUES ('alpha'), ('beta'), ('gamma')) s(system) WHERE s.system <> 'gamma' OR d.doc_id IN (SELECT doc_id FROM labels)
)""".replace("\\\\", "\\")
RATES = """count(*) AS clips, count(DISTINCT lang) AS languages, CAST(2 * count(*) AS BIGINT) AS reference_words, CAST(sum(we) AS BIGINT) AS word_edits, round(100.0 * sum(we) / (2 * count(*)), 6) AS corpus_wer_percent,
round(100.0 * sum(ce) / sum(rc), 6) AS corpus_cer_percent, round(100 * avg(we / 2.0), 6) AS mean_sentence_wer_percent, round(100 * avg(ce / rc), 6) AS mean_sentence_cer_percent"""


def said(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(items, results): the spoken reference is source and language; one system repeats it, one gets a word wrong, one is silent and has labelled prompts only."""
    docs = read(spark, sf, "documents").select("doc_id", F.col("doc_id").cast("string").alias("id"), "lang", "text", F.concat_ws(" ", "source", "lang").alias("spoken_reference"), F.col("source").alias("usecase"))
    every = coverage.grid(docs, ["alpha", "beta"]).unionByName(labelled(spark, sf, docs).withColumn("system", F.lit("gamma")))
    heard = F.when(F.col("system") == "alpha", F.col("spoken_reference")).when(F.col("system") == "beta", F.concat("usecase", F.lit(" x"))).otherwise("")
    return docs.drop("doc_id"), every.select("system", "id", "lang", F.lit("ok").alias("status"), heard.alias("transcript"))


@query(f"""WITH {SAID}, m AS (SELECT * FROM said WHERE id IN (SELECT id FROM said GROUP BY id HAVING count(DISTINCT system) = 3))
SELECT system, 'matched_only' AS slice_kind, CAST(NULL AS VARCHAR) AS slice_value, {RATES} FROM m GROUP BY system
UNION ALL SELECT system, 'lang', lang, {RATES} FROM m GROUP BY system, lang
UNION ALL SELECT system, 'usecase', usecase, {RATES} FROM m GROUP BY system, usecase
UNION ALL SELECT system, 'without_has_digits', NULL, {RATES} FROM m WHERE NOT dig GROUP BY system
UNION ALL SELECT s.system, k.kind, NULL, 0, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM (VALUES ('alpha'), ('beta'), ('gamma'), ('delta')) s(system), (VALUES ('matched_only'), ('without_has_digits')) k(kind)
WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.system = s.system AND (k.kind = 'matched_only' OR NOT m.dig))""")
def q_transcript_summary(spark: SparkSession, sf: str) -> DataFrame:
    """From results to published slices; a system without results has slices of zero clips."""
    items, results = said(spark, sf)
    systems = spark.createDataFrame([(s,) for s in ("alpha", "beta", "gamma", "delta")], "system string")
    out = evaluate.transcript_summary(evaluate.transcripts(results, items), systems, 3)
    rates = ["corpus_wer_percent", "corpus_cer_percent", "mean_sentence_wer_percent", "mean_sentence_cer_percent"]
    return out.select("system", "slice_kind", "slice_value", "clips", "languages", "reference_words", "word_edits", *[F.round(c, 6).alias(c) for c in rates])


@query("""SELECT CAST(doc_id AS VARCHAR) AS id, CASE WHEN quality = 1 THEN 'ok' WHEN toxic = 0 THEN 'failed' END AS status FROM labels WHERE quality <> 1""")
def q_failed_results(spark: SparkSession, sf: str) -> DataFrame:
    status = F.when(F.col("quality") == 1, "ok").when(F.col("toxic") == 0, "failed")
    return evaluate.failures(read(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("id"), status.alias("status")))


QUALITY = "count(*) AS n, round(avg(value), 6) AS p808, round(avg(value / 2), 6) AS ovrl"


@query(f"""WITH m AS (SELECT event_type AS system, CAST(user_id % 5 AS VARCHAR) AS lang, value FROM events WHERE user_id IN (SELECT user_id FROM events GROUP BY user_id HAVING count(DISTINCT event_type) = {N_TYPES}))
SELECT system, 'matched_only' AS slice_kind, CAST(NULL AS VARCHAR) AS slice_value, {QUALITY} FROM m GROUP BY system
UNION ALL SELECT system, 'lang', lang, {QUALITY} FROM m GROUP BY system, lang
UNION ALL SELECT 'silent', 'matched_only', NULL, 0, NULL, NULL""")
def q_quality_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Events stand for scored clips; a system without any has a slice of none."""
    e, n = event_types(spark, sf)
    scores = e.select("system", "id", (F.col("id") % 5).cast("string").alias("lang"), F.col("value").alias("p808"), (F.col("value") / 2).alias("ovrl"))
    systems = e.select("system").distinct().unionByName(spark.createDataFrame([("silent",)], "system string"))
    out = evaluate.quality_summary(scores, systems, n)
    return out.select("system", "slice_kind", "slice_value", "n", F.round("p808", 6).alias("p808"), F.round("ovrl", 6).alias("ovrl"))


@query("""WITH c AS (SELECT doc_id, count(*) AS k FROM labels GROUP BY 1), d AS (SELECT doc_id, count(*) AS k FROM documents GROUP BY 1)
SELECT DISTINCT 'alpha' AS system, CAST(NULL AS VARCHAR) AS id, 'other dataset' AS violation FROM labels WHERE toxic = 1
UNION ALL SELECT 'alpha', CAST(coalesce(c.doc_id, d.doc_id) AS VARCHAR), CASE WHEN coalesce(c.k, 0) > coalesce(d.k, 0) THEN 'unexpected id' ELSE 'missing id' END
FROM c FULL JOIN d ON c.doc_id = d.doc_id WHERE coalesce(c.k, 0) <> coalesce(d.k, 0)""")
def q_manifest_violations(spark: SparkSession, sf: str) -> DataFrame:
    """Labels stand for a manifest's clips, toxic ones for clips of another dataset."""
    named = [F.lit("alpha").alias("system"), F.col("doc_id").cast("string").alias("id")]
    told = F.when(F.col("toxic") == 1, "another").otherwise("dataset").alias("sentences_sha256")
    return validate.manifest(read(spark, sf, "labels").select(*named, told), read(spark, sf, "documents").select(*named), "dataset")


@query("""SELECT lang, CASE WHEN lang IN ('de', 'en') THEN NULL ELSE 'unsupported_by_asr' END AS reason, count(*) AS n FROM documents GROUP BY 1, 2""")
def q_supported_languages(spark: SparkSession, sf: str) -> DataFrame:
    fine, odd = coverage.supported(read(spark, sf, "documents").select("lang"), ["de", "en"])
    return resume.together(odd, fine).groupBy("lang", "reason").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT 'alpha' AS system, CAST(d.doc_id AS VARCHAR) AS id, d.lang, sha256(d.text) AS wav_sha256, 'ok' AS status, concat_ws(' ', d.lang, d.source) AS transcript,
'r' || d.doc_id AS request_id, d.lang AS detected_language, TRUE AS reused_asr FROM documents d JOIN labels l USING (doc_id) WHERE l.quality = 1""")
def q_reused_transcripts(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled documents stand for an earlier run's results, those of quality 1 for successful ones."""
    docs = read(spark, sf, "documents").select(
        "doc_id", F.lit("alpha").alias("system"), F.col("doc_id").cast("string").alias("id"), "lang", F.col("lang").alias("language_code"), F.sha2("text", 256).alias("wav_sha256"), "text", "source"
    )
    told = {"status": F.when(F.col("quality") == 1, "ok").otherwise("failed"), "transcript": F.concat_ws(" ", "lang", "source"), "request_id": F.concat(F.lit("r"), "id"), "detected_language": F.col("lang"), "input_text": F.col("text")}
    earlier = docs.join(read(spark, sf, "labels").select("doc_id", "quality"), "doc_id").withColumns(told)
    out = resume.reused_transcripts(docs.drop("doc_id", "text", "source"), docs.select("id", "text"), earlier, docs)
    return out.drop("language_code")


@query("""SELECT vec_id, CAST(list_position(m, list_max(m)) - 1 AS INTEGER) AS token, round(list_max(m), 6) AS logit
FROM (SELECT vec_id, list_transform([6, 4, 1, 8], lambda i: CAST(embedding[i] AS DOUBLE)) AS m FROM embeddings)""")
def q_masked_argmax(spark: SparkSession, sf: str) -> DataFrame:
    """Embeddings stand for a frame's logits; a language has four tokens."""
    own = ctc.masked(F.col("embedding").cast("array<double>"), F.array(*map(F.lit, (5, 3, 0, 7))))
    return read(spark, sf, "embeddings").select("vec_id", own.alias("own")).select("vec_id", ctc.argmax(F.col("own")).alias("token"), F.round(F.array_max("own"), 6).alias("logit"))


@query("""SELECT vec_id, CAST(len(s) AS INTEGER) AS samples, round(list_sum(s), 6) AS total
FROM (SELECT vec_id, list_transform(range(1, least(len(e), 16) + 1), lambda i: (e[i] + e[len(e) + 1 - i]) / 2) AS s FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings))""")
def q_downmix(spark: SparkSession, sf: str) -> DataFrame:
    """An embedding and its reverse stand for two channels; the first millisecond of their mean."""
    e = F.col("embedding").cast("array<double>")
    mono = vx.first_seconds(vx.channel_mean(F.array(e, F.reverse(e))), 0.001)
    total = F.aggregate("mono", F.lit(0.0), lambda s, x: s + x)
    return read(spark, sf, "embeddings").select("vec_id", mono.alias("mono")).select("vec_id", F.size("mono").alias("samples"), F.round(total, 6).alias("total"))


@query("SELECT doc_id, sha256(CAST(to_json({'doc_id': doc_id, 'lang': lang, 'source': source, 'n_chars': n_chars}) AS VARCHAR)) AS fingerprint FROM documents")
def q_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "documents").select("doc_id", tx.fingerprint("doc_id", "lang", "source", "n_chars").alias("fingerprint"))


@query("SELECT doc_id, CASE WHEN doc_id % 4 < 2 THEN NULL ELSE sha256(text) END AS decoded_sha256 FROM documents")
def q_strict_base64(spark: SparkSession, sf: str) -> DataFrame:
    """Every other pair of documents has something before or after its code that the strict form refuses."""
    case, code = F.col("doc_id") % 4, F.translate(F.base64(F.encode("text", "UTF-8")), "\r\n", "")  # the built-in encoder breaks lines
    sent = F.when(case == 0, F.concat(code, F.lit("!"))).when(case == 1, F.concat(F.lit("\n"), code)).otherwise(code)
    return read(spark, sf, "documents").select("doc_id", F.sha2(tx.strict_base64(sent), 256).alias("decoded_sha256"))
