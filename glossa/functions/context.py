"""Sentence and block windows as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .patterns import BLANK_LINE, BOUNDARY
from .spans import count_while, find_all, let


def boundaries(text: Column) -> Column:
    """array<bigint>: where sentences after the first begin; full stops of abbreviations do not count."""
    return F.transform(find_all(text, BOUNDARY), lambda m: m["end"])


def block_cuts(text: Column) -> Column:
    """array<bigint>: where blocks after the first begin, each after a blank line."""
    return F.transform(find_all(text, BLANK_LINE), lambda m: m["end"])


def window_at(offset: Column, length: Column, cuts: Column) -> Column:
    """struct<start, end> of the part between cuts that holds the offset; beyond the end, the last part."""
    at = F.least(offset, F.greatest(length - 1, F.lit(0)))

    def between(before: Column) -> Column:
        start = F.coalesce(F.get(cuts, before - 1), F.lit(0).cast("long"))
        end = F.coalesce(F.get(cuts, before), length)
        return F.struct(start.alias("start"), end.alias("end"))

    return let(count_while(cuts, lambda c: c <= at), between)


def sentence_window(offset: Column, length: Column, sentences: Column, blocks: Column) -> Column:
    """Window of an offset: by sentences, or by blocks where the text has no sentence boundary.

    Among blocks, an offset at the end of the text or beyond has the whole text.
    """
    whole = F.struct(F.lit(0).cast("long").alias("start"), length.alias("end"))
    block = F.when(offset >= length, whole).otherwise(window_at(offset, length, blocks))
    return F.when(F.size(sentences) > 0, window_at(offset, length, sentences)).otherwise(block)
