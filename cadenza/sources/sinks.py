"""Writers: JSON and text replaced in one step, transcripts as TSV, audio files, tables."""

from __future__ import annotations

import json
import os
from datetime import datetime, timezone
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_text(path: str, text: str) -> None:
    """All or nothing: written beside the target and moved over it."""
    with open(part := f"{path}.part", "w", encoding="utf-8", newline="") as f:
        f.write(text)
    os.replace(part, path)


def write_json(path: str, data: object) -> None:
    write_text(path, json.dumps(data, ensure_ascii=False, indent=2) + "\n")


def now_utc() -> str:
    """The time of a run, for its records only; never part of a compared result."""
    return datetime.now(timezone.utc).isoformat()


def write_shared(spark: SparkSession, path: str, data: object) -> None:
    """JSON at a path of any file system that Spark knows: written beside the target, then moved over it."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    target, part = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.part")
    files = target.getFileSystem(conf)
    stream = files.create(part, True)
    try:
        stream.write(bytearray((json.dumps(data, ensure_ascii=False, indent=2) + "\n").encode()))
    finally:
        stream.close()
    files.delete(target, False)
    if not files.rename(part, target):
        raise OSError(f"{path} can't be written")


def write_tsv(rows: DataFrame, path: str, with_usecase: bool = True) -> None:
    """Transcripts with percent columns, tab-separated with a header."""
    columns = ["system", "id", "lang", *(["usecase"] if with_usecase else []), (F.col("wer") * 100).alias("WER_percent"), (F.col("cer") * 100).alias("CER_percent"), "reference", F.col("hypothesis").alias("ASR_hypothesis")]
    rows.select(*columns).write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def write_audio(clips: DataFrame, save: Callable[[str, str, bytes], None]) -> None:
    """``save(system, id, bytes)`` on the executors for each generated clip."""

    def each(rows) -> None:
        for r in rows:
            save(r["system"], r["id"], bytes(r["content"]))

    clips.filter("status = 'ok'").select("system", "id", "content").foreachPartition(each)


def append(rows: DataFrame, path: str) -> None:
    """Results of one batch; a committed write is whole or absent."""
    rows.write.mode("append").parquet(path)
