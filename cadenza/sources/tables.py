"""Readers: prompts, manifests, audio files, earlier runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadenza import schemas
from cadenza.functions import audio as ax
from cadenza.operators import validate


def _json(spark: SparkSession, path: str | Sequence[str], schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def items(spark: SparkSession, path: str, code_field: str = "language_code", check: bool = True) -> DataFrame:
    """Prompts of a dataset file. ``code_field``: the file's name for the external language code."""
    fields = [T.StructField(code_field if f.name == "language_code" else f.name, f.dataType) for f in schemas.ITEM.fields]
    rows = _json(spark, path, T.StructType([T.StructField("items", T.ArrayType(T.StructType(fields)))])).select(F.explode("items").alias("i")).select("i.*")
    rows = rows.withColumnRenamed(code_field, "language_code")
    return validate.check_items(rows) if check else rows


def manifests(spark: SparkSession, paths: Sequence[str], code_field: str = "language_code") -> DataFrame:
    """Clips of generation manifests, each with its manifest's head."""
    clip = [T.StructField(code_field if f.name == "language_code" else f.name, f.dataType) for f in schemas.CLIP.fields]
    head = [f for f in schemas.MANIFEST.fields if f.name != "items"]
    whole = _json(spark, list(paths), T.StructType([*head, T.StructField("items", T.ArrayType(T.StructType(clip)))]))
    out = whole.select("system", "sentences_sha256", F.col("model").alias("system_model"), F.explode("items").alias("i"))
    return out.select("system", "sentences_sha256", "system_model", "i.*").withColumnRenamed(code_field, "language_code")


def audio(spark: SparkSession, root: str) -> DataFrame:
    """(system, id, content) of ``<root>/<system>/<id>.wav``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.wav").load(root)
    part = lambda i: F.regexp_extract("path", r"([A-Za-z0-9_-]+)/([A-Za-z0-9_-]+)\.wav$", i)
    return files.select(part(1).alias("system"), part(2).alias("id"), "content").filter("id <> ''")


def described(files: DataFrame) -> DataFrame:
    """(system, id, sha256, header, audio_seconds) of audio files."""
    out = files.select("system", "id", F.sha2("content", 256).alias("sha256"), ax.header("content").alias("header"))
    return out.withColumn("audio_seconds", F.try_divide(F.col("header.frames").cast("double"), F.col("header.rate")))


def dataset_hash(spark: SparkSession, path: str) -> str:
    """SHA-256 of a file's bytes."""
    return spark.read.format("binaryFile").load(path).select(F.sha2("content", 256)).first()[0]


def results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.RESULT).parquet(path)


def scores(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.MOS).parquet(path)
