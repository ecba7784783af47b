"""Applying choices: validated, spliced in order, in the case of what they replace."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.spans import let, parts, piece

#: What may be wrong with choices.
OUT_OF_ORDER, OVERLAP = "choices are not in document order", "choices overlap"


def transfer_case(surface: Column, replacement: Column) -> Column:
    """The replacement in upper case, with a capital, in lower case or as it is, after the surface."""
    first = F.substring(surface, F.lit(1), F.lit(1))
    cased = lambda c, way, other: (way(c) == c) & (other(c) != c)
    capital = F.concat(F.upper(F.substring(replacement, F.lit(1), F.lit(1))), F.substring(replacement, F.lit(2), F.length(replacement)))
    return (
        F.when(cased(surface, F.upper, F.lower), F.upper(replacement))
        .when(cased(first, F.upper, F.lower), capital)
        .when(cased(surface, F.lower, F.upper), F.lower(replacement))
        .otherwise(replacement)
    )


def spliced(of: Column, length: Column, choices: Column) -> Column:
    """The text, given by its parts and length, with an ordered array of (start, end, replacement) put in."""

    def with_gap(c: Column, i: Column) -> Column:
        at = F.when(i == 0, F.lit(0).cast("long")).otherwise(F.get(choices, i - 1)["end"])
        surface = piece(of, c["start"], c["end"] - c["start"])
        return F.array(let(at, lambda a: piece(of, a, c["start"] - a)), let(surface, lambda x: transfer_case(x, c["replacement"])))

    last = F.get(choices, F.size(choices) - 1)["end"]
    return F.concat(F.array_join(F.flatten(F.transform(choices, with_gap)), ""), piece(of, last, length - last))


def revised(docs: DataFrame, choices: DataFrame, *more: Column) -> DataFrame:
    """doc_id, revised and more columns for every document; choices: doc_id, choices (ordered array) and what `more` reads.

    Texts without choices are passed on as they are.
    """
    joined = docs.select("doc_id", "text").join(choices, "doc_id", "left")
    text, put = F.col("text"), F.col("choices")
    changed = let(F.struct(parts(text).alias("parts"), F.length(text).cast("long").alias("n")), lambda t: spliced(t["parts"], t["n"], put))
    return joined.select("*", F.when((F.size(put) > 0) & text.isNotNull(), changed).otherwise(text).alias("revised"), *more)


def _ordered(choices: DataFrame) -> DataFrame:
    """doc_id, choices: array of (choice_ord, start, end, replacement) in the order given."""
    order = "choice_ord" if "choice_ord" in choices.columns else "start"
    one = F.struct(F.col(order).cast("long").alias("choice_ord"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "replacement")
    return choices.groupBy("doc_id").agg(F.array_sort(F.collect_list(one)).alias("choices"))


def _error(choices: Column) -> Column:
    """What is wrong with an ordered array of choices, or null: the first pair of neighbours that does not fit."""

    def fits(c: Column, i: Column) -> Column:
        before = F.get(choices, i - 1)
        return F.when(i == 0, F.lit(None).cast("string")).when(before["start"] > c["start"], OUT_OF_ORDER).when(before["end"] > c["start"], OVERLAP)

    return F.get(F.filter(F.transform(choices, fits), lambda e: e.isNotNull()), F.lit(0))


def choice_errors(choices: DataFrame) -> DataFrame:
    """doc_id, error for documents whose choices are out of order or overlap."""
    return _ordered(choices).select("doc_id", _error(F.col("choices")).alias("error")).where("error IS NOT NULL")


def apply_choices(docs: DataFrame, choices: DataFrame, validate: bool = True) -> DataFrame:
    """doc_id, revised for every document; without choices the text is unchanged.

    choices: doc_id, start, end, replacement and, if the order given matters, choice_ord.  With
    validate, a document whose choices are out of order or overlap ends the job that reads it, with its
    id and the reason; `choice_errors` lists such documents.
    """
    ordered = _ordered(choices)
    if validate:
        error = _error(F.col("choices"))
        stop = F.raise_error(F.concat(error, F.lit(" (document "), F.col("doc_id").cast("string"), F.lit(")"))).cast(ordered.schema["choices"].dataType)
        ordered = ordered.select("doc_id", F.when(error.isNotNull(), stop).otherwise(F.col("choices")).alias("choices"))
    return revised(docs, ordered).select("doc_id", "revised")
