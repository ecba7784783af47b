"""Occurrences of lexicon words in documents, with alternatives and sentence windows.

Everything is a projection and one broadcast join with the lexicon's closure, so a
stream of documents runs through the same plan; texts stay behind when occurrences become
rows.  The closure is a curated list (some six rows for each base word); past BROADCAST_ROWS
the join is left to the planner.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.context import block_cuts, boundaries, sentence_window
from ..functions.patterns import HINTS, PROTECTED, WORD, any_of
from ..functions.spans import MATCH, find_all, let, merged, only_spans, overlaps, parts, piece, pieces
from ..sources.lexicon import Lexicon

BROADCAST_ROWS = 100_000
#: Rows of words that a task hands on at once.
ROWS = 100_000


def _kind(text: Column, kind: str) -> Column:
    """Matches of one kind of protected region; texts without its hint are not looked through."""
    hinted = F.lit(False)
    for hint in HINTS[kind]:
        hinted = hinted | F.contains(text, F.lit(hint))
    return F.when(hinted, find_all(text, PROTECTED[kind])).when(text.isNotNull(), F.array().cast(f"array<{MATCH}>"))


def protected_by_kind(text: Column) -> Column:
    """array<struct<kind, start, end>> of all protected regions, kind by kind."""
    named = lambda kind: F.transform(_kind(text, kind), lambda m: F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end")))
    return F.concat(*(named(kind) for kind in PROTECTED))


def protected_spans(text: Column) -> Column:
    """array<struct<start, end>>: code and links, merged and in order."""
    return merged(F.concat(*(only_spans(_kind(text, kind)) for kind in PROTECTED)))


def _placed(keep: bool | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of the matches among pieces: offsets are running sums over all pieces of a batch, less those before the document.

    With `keep`, only of matches that overlap the document's merged spans or, if false, of those that do not.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, of = b.column(0), b.column(1)
            at, flat = of.offsets.to_numpy().astype(np.int64), of.flatten()
            at -= at[0]
            sizes = pc.utf8_length(flat).to_numpy().astype(np.int64)
            upto = np.concatenate(([0], np.cumsum(sizes)))
            base = upto[at[:-1]]
            doc = np.repeat(np.arange(len(ids)), np.diff(at))
            found = np.flatnonzero((np.arange(len(flat)) - at[:-1][doc]) % 2)
            if keep is not None:
                spans = b.column(2)
                near = spans.flatten()
                before = np.repeat(base, np.diff(spans.offsets.to_numpy()))
                starts, ends = (near.field(i).to_numpy() + before for i in (0, 1))
                last = np.searchsorted(starts, upto[found + 1]) - 1
                inside = (last >= 0) & (ends[last] > upto[found]) if len(ends) else np.zeros(len(found), bool)
                found = found[inside == keep]
            for i in range(0, len(found), ROWS):
                some = found[i : i + ROWS]
                d = doc[some]
                start = upto[some] - base[d]
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(d)), pa.array(start), pa.array(start + sizes[some]), flat.take(pa.array(some))], ["doc_id", "start", "end", "surface"])

    return run


def tokens(docs: DataFrame, protected: bool | None = None) -> DataFrame:
    """doc_id, start, end, surface of every word; with `protected`, of those that overlap a protected region or do not.

    Words are found by Spark; their offsets are added up in Arrow batches, as a lambda for each word took most of the time.
    """
    text, kind = F.col("text"), docs.schema["doc_id"].dataType.simpleString()
    found = docs.where("text IS NOT NULL").select("doc_id", pieces(text, WORD).alias("pieces"), *([] if protected is None else [protected_spans(text).alias("spans")]))
    return found.mapInArrow(_placed(protected), f"doc_id {kind}, start bigint, end bigint, surface string")


def occurrences(text: Column, words: list[str]) -> Column:
    """array<struct<start, end, surface>>: unprotected occurrences of the words."""
    plain = all(w.isascii() and w.replace("_", "a").isalnum() for w in words)
    # Past ASCII, case folding in patterns differs from lower(): look every word up then.
    known = (lambda k: k.rlike(r"^[\x00-\x7f]*\z")) if plain else (lambda k: k.isin(*words))
    free = lambda found: let(protected_spans(text), lambda spans: F.filter(found, lambda m: known(F.lower(m["surface"])) & ~overlaps(m["start"], m["end"], spans)))
    return let(find_all(text, any_of(words) if plain else WORD), lambda found: F.when(F.size(found) > 0, free(found)).otherwise(found))


def with_windows(df: DataFrame) -> tuple[DataFrame, Column]:
    """df (doc_id, text, found) with helper columns, and `found` with win_start, win_end and sentence.

    What windows need is taken once for each document that has occurrences.  Every step names the
    columns of the one before more than once, so the optimizer does not fold it into the next one's
    lambdas; and what is exploded is no column by itself, as a filter on its size would be moved below all steps.
    """
    text = F.col("text")
    of = F.struct(F.length(text).cast("long").alias("n"), boundaries(text).alias("cuts"), parts(text).alias("parts"))
    df = df.select("doc_id", "text", "found", F.when(F.size("found") > 0, of).alias("of"))
    df = df.select("doc_id", "found", "of", F.when(F.size("of.cuts") == 0, block_cuts(text)).alias("blocks"))
    fields = lambda m: [m[c].alias(c) for c in ("start", "end", "surface")]
    at = lambda m: sentence_window(m["start"], F.col("of.n"), F.col("of.cuts"), F.col("blocks"))
    df = df.select("doc_id", "of", F.transform("found", lambda m: F.struct(*fields(m), at(m).alias("w"))).alias("placed"))
    sentence = lambda w: piece(F.col("of.parts"), w["start"], w["end"] - w["start"])
    shown = lambda m: F.struct(*fields(m), m["w"]["start"].alias("win_start"), m["w"]["end"].alias("win_end"), sentence(m["w"]).alias("sentence"))
    return df, F.when(F.size("placed") > 0, F.transform("placed", shown))


def suggest(docs: DataFrame, lexicon: Lexicon | None = None, context: bool = False) -> DataFrame:
    """doc_id, match_ord, start, end, surface, base, suffix, alternatives, raws of every occurrence.

    docs: doc_id and text, batch or streaming.  With context also win_start, win_end and
    sentence.  Documents without occurrences, and null texts, have no rows.
    """
    lexicon = lexicon or Lexicon.default()
    words = [row[0] for row in lexicon.closure(docs.sparkSession)]
    found = occurrences(F.col("text"), words)
    df = docs.select("doc_id", "text")
    out = ["doc_id", "match_ord", "start", "end", "surface", "base", "suffix", "alternatives", "raws"]
    if context:
        df, found = with_windows(df.withColumn("found", found))
        out += ["win_start", "win_end", "sentence"]
    df = df.select("doc_id", F.posexplode(found).alias("match_ord", "m")).select("doc_id", "match_ord", "m.*").withColumn("key", F.lower("surface"))
    closure = lexicon.closure_table(docs.sparkSession)
    if 8 * len(lexicon.entries) <= BROADCAST_ROWS:
        closure = F.broadcast(closure)
    return df.join(closure, "key").select(*out)


def offers(matches: DataFrame) -> DataFrame:
    """doc_id, match_ord, option_no (from 1), alternative, raw."""
    both = F.arrays_zip(F.col("alternatives"), F.col("raws"))
    return matches.select("doc_id", "match_ord", F.posexplode(both).alias("option_no", "o")).select("doc_id", "match_ord", (F.col("option_no") + 1).alias("option_no"), F.col("o.alternatives").alias("alternative"), F.col("o.raws").alias("raw"))
