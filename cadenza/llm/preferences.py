"""Preference formatting: one prompt, two masked completions.

A pair is two conversations, a chosen and a rejected one. Their longest common prefix of turns is
rendered once, as the prompt; what follows in either is its completion. The result has a row for each
rendered turn, so that no conversation has to fit into one row or task: ``part`` (prompt, chosen or
rejected), ``turn``, ``role``, ``rendered`` and ``loss`` (whether the turn's tokens count in training:
those of the trained role in completions). A part's text is its rows' ``rendered`` in order of ``turn``.

The prefix ends before the first turn at which the two don't have the same rows; this is found by
counting equal (turn, role, text) on either side, not by lining conversations up. Rows of equal turns
stay together. If one conversation is the other's beginning, its completion has no rows; if both are
equal, all is prompt. Conversations without a partner are no pair and have no rows. A null turn comes
last; a null role is the role ``unknown``, a null text the empty text; rows with a null pair are left
out. Role marks in a text are broken up, so a text can't open a turn. Repeated turns stay, in no order among
themselves. :func:`paired` makes of the rows one record a pair, where a pair isn't too long for that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LAST = (1 << 63) - 1


def format_preferences(df: DataFrame, pair: Column, is_chosen: Column, turn: str = "turn", role: str = "role", text: str = "text", trained: str = "assistant") -> DataFrame:
    """(pair_id, part, turn, role, rendered, loss) for the conversations' turns in ``df``."""
    t = df.select(
        pair.alias("pair_id"),
        is_chosen.alias("good"),
        F.coalesce(F.col(turn).cast("long"), F.lit(LAST)).alias("turn"),
        F.coalesce(F.col(role), F.lit("unknown")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    ).filter("pair_id IS NOT NULL AND good IS NOT NULL")
    counts = t.groupBy("pair_id", "turn", "role", "text").agg(F.count_if("good").alias("n1"), F.count_if(~F.col("good")).alias("n0"))
    ends = counts.groupBy("pair_id").agg(F.min(F.when(F.col("n1") != F.col("n0"), F.col("turn"))).alias("cut"), F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
    ends = ends.filter("n1 > 0 AND n0 > 0").select("pair_id", "cut")
    shared = F.col("cut").isNull() | (F.col("turn") < F.col("cut"))
    part = F.when(shared, "prompt").when(F.col("good"), "chosen").otherwise("rejected")
    rendered = F.concat(F.lit("<|"), F.replace("role", F.lit("|"), F.lit("")), F.lit("|>\n"), F.replace("text", F.lit("<|"), F.lit("< |")), F.lit("<|end|>\n"))
    rows = t.join(ends, "pair_id").filter(~shared | F.col("good"))
    return rows.select("pair_id", part.alias("part"), "turn", "role", rendered.alias("rendered"), (~shared & (F.col("role") == trained)).alias("loss"))


def paired(rows: DataFrame, most: int = 10_000) -> tuple[DataFrame, DataFrame]:
    """Of :func:`format_preferences`' rows the records (pair_id, prompt, chosen, rejected), and the rows of longer pairs.

    ``prompt`` is a text, a completion an array of (text, loss) in order of turns; joined texts are what a model
    reads, and it learns those with ``loss``. Pairs of more than ``most`` rows stay rows, as no group is
    gathered whatever its size; an empty part is the empty text or array.
    """
    size = rows.groupBy("pair_id").count()
    short, long = (rows.join(size.filter(which).select("pair_id"), "pair_id", "left_semi") for which in (F.col("count") <= most, F.col("count") > most))
    turns = lambda part: F.sort_array(F.collect_list(F.when(F.col("part") == part, F.struct("turn", "rendered", "loss"))))
    told = short.groupBy("pair_id").agg(*[turns(part).alias(part) for part in ("prompt", "chosen", "rejected")])
    masked = [F.transform(part, lambda t: F.struct(t["rendered"].alias("text"), t["loss"].alias("loss"))).alias(part) for part in ("chosen", "rejected")]
    return told.select("pair_id", F.array_join(F.transform("prompt", lambda t: t["rendered"]), "").alias("prompt"), *masked), long
