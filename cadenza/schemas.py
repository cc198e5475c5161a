"""Explicit schemas of the logical tables; nothing is inferred in production reads."""

from pyspark.sql import types as T

S, L, D, B = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType()


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


ITEM = struct(id=S, lang=S, language_code=S, text=S, spoken_reference=S, usecase=S, eval_category=S, source_row=L, has_digits=B, has_latin_in_indic=B)
CLIP = T.StructType([*ITEM.fields, *struct(status=S, voice=S, wav=S, wav_sha256=S, audio_seconds=D, elapsed_seconds=D, error_type=S, http_status=L).fields])
MANIFEST = T.StructType([*struct(system=S, created_utc=S, sentences_sha256=S, endpoint=S, voice=S, model=S, sample_rate_requested=L).fields, T.StructField("items", T.ArrayType(CLIP))])
RECORD = struct(system=S, id=S, lang=S, language_code=S, upload_name=S, relative_wav=S, wav_sha256=S, audio_seconds=D)
RESULT = T.StructType([*RECORD.fields, *struct(status=S, transcript=S, request_id=S, detected_language=S, reason=S, reused_asr=B).fields])
MOS = struct(system=S, id=S, lang=S, wav_sha256=S, p808=D, ovrl=D)
EMBEDDING = T.StructType([*struct(system=S, id=S, lang=S, voice=S, wav_sha256=S).fields, T.StructField("embedding", T.ArrayType(D))])
