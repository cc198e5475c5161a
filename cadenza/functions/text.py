"""Text normalization, edit distances and predicates, as column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

JOINERS = "[‌‍]"
OTHER = "[^\\p{L}\\p{M}\\p{N}_]"
BLANK = "^[\\s\\p{Z}\\x1c-\\x1f\\x85]*\\z"
SAFE_ID = "^[A-Za-z0-9_-]+\\z"


@F.pandas_udf(StringType())
def _composed(text: pd.Series) -> pd.Series:
    return text.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


def nfc(text: Column) -> Column:
    """Canonical composition: the only step that Spark has no expression for. ASCII texts aren't sent to Python."""
    return F.coalesce(_composed(F.when(text.rlike("[^\\x00-\\x7F]"), text)), text)


def simplified(text: Column) -> Column:
    """Composed text in lower case with letters, marks, numbers and underscores kept; joiners vanish, the rest are single blanks."""
    kept = F.regexp_replace(F.regexp_replace(F.lower(text), JOINERS, ""), OTHER, " ")
    return F.trim(F.regexp_replace(kept, " +", " "))


def normalize(text: Column) -> Column:
    return simplified(nfc(text))


def words(text: Column) -> Column:
    """The words of a simplified text; none for the empty text."""
    return F.filter(F.split(text, " "), lambda w: w != "")


def character_edits(reference: Column, hypothesis: Column) -> Column:
    return F.levenshtein(reference, hypothesis).cast("long")


def word_edits(reference: Column, hypothesis: Column) -> Column:
    """Word-level Levenshtein distance of two simplified texts, without leaving the JVM.

    Each distinct word of the pair is one private-use character (planes 15 and 16, 131,068 of them);
    the distance of the encoded strings is the distance of the word sequences.
    """
    letter = lambda known, w: F.decode(F.unhex(F.lpad(F.hex(_place(F.array_position(known, w))), 8, "0")), "UTF-32")
    encoded = lambda known, ws: F.array_join(F.transform(ws, lambda w: letter(known, w)), "")
    too_many = F.raise_error(F.lit("more distinct words in a pair than private-use characters"))

    def distance(pair: Column) -> Column:
        known = pair["known"]
        return F.when(F.size(known) > 131_068, too_many.cast("long")).otherwise(F.levenshtein(encoded(known, pair["r"]), encoded(known, pair["h"])).cast("long"))

    r, h = words(reference), words(hypothesis)
    # as variables of a function over one pair, the words are split and made distinct once and not for each word
    pair = F.array(F.struct(r.alias("r"), h.alias("h"), F.array_distinct(F.concat(r, h)).alias("known")))
    return F.when(reference == hypothesis, F.lit(0).cast("long")).otherwise(F.element_at(F.transform(pair, distance), 1))


def _place(n: Column) -> Column:
    """The n-th character of planes 15 and 16; the last two of a plane are none."""
    return F.when(n <= 65_534, F.lit(0xF0000) + n - 1).otherwise(F.lit(0x100000) + n - 65_535)


def score_text(df: DataFrame, reference: str = "reference", hypothesis: str = "hypothesis", compose: bool = True, deal: Sequence[str] = ()) -> DataFrame:
    """Edit counts and rates of each pair. ``compose=False`` is for texts that are known to be composed.

    Scoring takes long for few bytes, so partitions of a size that suits other steps keep few cores busy:
    with ``deal``, rows are dealt by these columns to as many partitions as the session shuffles to.
    """
    clean = normalize if compose else simplified
    if deal:
        df = df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *deal)
    out = df.withColumns({"normalized_reference": clean(F.col(reference)), "normalized_hypothesis": clean(F.col(hypothesis))})
    r, h = F.col("normalized_reference"), F.col("normalized_hypothesis")
    out = out.withColumns({
        "reference_words": F.size(words(r)).cast("long"),
        "word_edits": word_edits(r, h),
        "reference_characters": F.char_length(r).cast("long"),
        "character_edits": character_edits(r, h),
    })
    return out.withColumns({
        "wer": F.try_divide(F.col("word_edits").cast("double"), F.col("reference_words")),
        "cer": F.try_divide(F.col("character_edits").cast("double"), F.col("reference_characters")),
    })


def has_digits(text: Column) -> Column:
    """Decimal digits of any script."""
    return text.rlike("\\p{Nd}")


def is_blank(text: Column) -> Column:
    return text.rlike(BLANK)


def is_usable(text: Column) -> Column:
    """Neither null nor blank, and without NUL."""
    return F.coalesce(~is_blank(text) & ~text.contains("\x00"), F.lit(False))


def is_safe_id(name: Column) -> Column:
    return F.coalesce(name.rlike(SAFE_ID), F.lit(False))


def reference_of(spoken: Column, text: Column) -> Column:
    return F.coalesce(spoken, text)


def voice(mode: Column, lang: Column) -> Column:
    """A system's voice by its mode: none for '', a language's default female one, the English one, or a named preset."""
    return F.when(mode == "lang_female", F.concat(lang, F.lit("_female_default"))).when(mode == "en_default", F.lit("en_female_default")).when(mode != "", mode)


def strict_base64(text: Column) -> Column:
    """Decoded bytes of canonical padded base64; null for anything else, where the built-in decoder is lenient."""
    fine = text.rlike("^(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?\\z")
    return F.when(fine, F.unbase64(text))


def fingerprint(*columns: str) -> Column:
    """SHA-256 of the columns' canonical JSON; nulls and order count."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
