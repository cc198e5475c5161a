"""An extension: summaries kept up to date while results arrive as files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from cadenza import schemas
from cadenza.operators import metrics
from cadenza.plans import evaluate


def arriving(spark: SparkSession, folder: str) -> DataFrame:
    """Each clip's result once, however often it is delivered."""
    return spark.readStream.schema(schemas.RESULT).parquet(folder).dropDuplicates(["system", "id", "wav_sha256"])


def summarized(results: DataFrame, items: DataFrame, store: str, checkpoint: str, then: Callable[[DataFrame], None]) -> StreamingQuery:
    """Scores each new batch, stores it under its number, and hands the summary of all so far to ``then``.

    A batch that is run again replaces its own rows, so nothing is counted twice.
    """

    def each(batch: DataFrame, number: int) -> None:
        evaluate.transcripts(batch, items).write.mode("overwrite").parquet(f"{store}/batch={number}")
        then(metrics.slices(batch.sparkSession.read.parquet(store), metrics.error_rates()))

    return results.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
