"""Batches for external jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SAMPLED = 64  # rows for each piece of the order


def pieces(records: DataFrame, keys: list[str], number: int) -> Column:
    """The piece of the order by ``keys`` that a row is in, from 0.

    The bounds are values of a bounded sample (the rows of least hash), taken to the driver once. So a
    row's piece hangs on its values only, however often and wherever it is computed.
    """
    least = records.select(*keys).orderBy(F.xxhash64(*keys), *keys).limit(SAMPLED * number)
    kinds = dict(records.dtypes)
    some = least.orderBy(*keys).collect()
    bounds = [some[i] for i in range(SAMPLED, len(some), SAMPLED)]
    if not bounds:
        return F.lit(0)
    told = F.array(*[F.struct(*[F.lit(r[k]).cast(kinds[k]).alias(f"c{i}") for i, k in enumerate(keys)]) for r in bounds])
    own = F.struct(*[F.col(k).alias(f"c{i}") for i, k in enumerate(keys)])
    return F.size(F.filter(told, lambda bound: bound <= own))


def numbered(records: DataFrame, by: str = "language_code", order: tuple[str, ...] = ("id", "system"), size: int = 20, number: int | None = None) -> DataFrame:
    """``records`` with ``batch`` (number within ``by``) and ``batch_key``.

    The order by (by, order) is cut into ``number`` pieces (the session's shuffle partitions, if not given);
    rows are numbered within a piece and counts of the pieces before are added, so no group has to fit
    into one task. A null ``by`` is a group like others, ``unknown`` in the key. Rows equal in all keys
    stay and follow each other in no order.
    """
    number = number or int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = records.withColumn("__piece", pieces(records, [by, *order], number))
    inside = cut.withColumn("__r", F.row_number().over(Window.partitionBy(by, "__piece").orderBy(*order)))
    sizes = cut.groupBy(by, "__piece").count()  # few rows: pieces and groups that meet
    before = F.coalesce(F.sum("count").over(Window.partitionBy(by).orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    told = sizes.select(F.col(by).alias("__by"), F.col("__piece").alias("__at"), before.alias("__before"))
    both = inside.join(told, F.col(by).eqNullSafe(F.col("__by")) & (F.col("__piece") == F.col("__at")))
    batch = F.floor((F.col("__before") + F.col("__r") - 1) / size).cast("long")
    key = F.concat(F.coalesce(F.col(by).cast("string"), F.lit("unknown")), F.format_string("_%04d", batch))
    return both.select(*records.columns, batch.alias("batch"), key.alias("batch_key"))
