"""The corpus pipeline: stages over ``documents``, each on all that the one before it kept.

Every stage but the last returns the columns of ``documents``; the last one encodes.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm import bpe, credentials, decontaminate, jaccard, langid, queries
from cadenza.llm.shared import drop, drop_kept, ensure_folder, write


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that language ID rejects go: without a letter, or below the calibrated least confidence."""
    model = langid.fit(docs, queries.remainder(4) != 2)
    return langid.identify(docs, model, lang="__lang", score="__score", rejected="__rejected").filter(~F.col("__rejected")).select(*docs.columns)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of linked documents one row stays, that of least id: words in fives, similarity 0.8.

    Rows without an id come last, rows of one id by their hash. Texts without words link with none: of
    them one row of each id stays, and of those without an id one of each equal row.
    """
    found = jaccard.join(docs, width=5, share=80, out="__component", size="__size", number="__number")
    row = F.xxhash64(*docs.columns)
    alone = F.when(F.col("__number").isNull(), F.when(F.col("doc_id").isNull(), row).otherwise(F.xxhash64("doc_id")))
    first = F.min_by(F.struct(*docs.columns), F.struct(F.col("doc_id").isNull(), "doc_id", row))
    return found.groupBy("__number", alone.alias("__alone")).agg(first.alias("__row")).select("__row.*")


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share a window with the benchmark go."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret's span is replaced by a mark of its kind; n_chars follows."""
    return credentials.redact(docs, "text", "n_chars").select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each text; a round trip that changes the text would show as ``intact`` = false."""
    coded = bpe.encode_decode(docs, queries.vocabulary())
    return coded.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("intact"))


STAGES = [
    ("language_id", keep_known_languages),
    ("near_duplicates", keep_one_of_near_copies),
    ("decontamination", keep_uncontaminated),
    ("secrets", mask_secrets),
    ("encoding", encode),
]

#: SQL can express neither the trained language ID nor BPE.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder and read again as the next one's documents.

    What a stage kept aside, and the output of the one before it, are deleted once it is written.
    """
    folder = f"{ensure_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for number, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        write(out, path := f"{folder}/{number}-{name}")
        drop_kept(spark)
        drop(spark, *before)
        docs, before = spark.read.parquet(path), [path]
    return docs
