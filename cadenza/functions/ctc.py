"""Greedy CTC decoding over arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def masked(logits: Column, mask: Column) -> Column:
    """The logits of a language's tokens only."""
    return F.transform(mask, lambda i: F.element_at(logits, i + 1))


def argmax(logits: Column) -> Column:
    """Place of the first greatest value, from 0; softmax keeps the order, so logits do."""
    return (F.array_position(logits, F.array_max(logits)) - 1).cast("int")


def collapsed(ids: Column, blank: int | Column) -> Column:
    """Runs of one id become one; blanks go."""
    single = F.filter(ids, lambda x, i: (i == 0) | (x != F.try_element_at(ids, i.cast("int"))))
    return F.filter(single, lambda x: x != blank)


def spelled(ids: Column, vocabulary: Column) -> Column:
    """Tokens joined, with word marks as blanks."""
    return F.trim(F.replace(F.array_join(F.transform(ids, lambda i: F.element_at(vocabulary, i + 1)), ""), F.lit("▁"), F.lit(" ")))
