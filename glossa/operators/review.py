"""Prompts, and the replay of recorded decisions."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .apply import revised

NO_CHANGE = "NO CHANGE"
BOLD, RESET = "\x1b[1m", "\x1b[0m"
#: A decision line that stands for an interrupt.
INTERRUPT = "^C"
DONE, INTERRUPTED = 0, 130
#: Documents that a replay by lines takes out of an Arrow batch at once.
DOCUMENTS = 256
#: Decimal digits of all scripts, and the ASCII digit of each.
_DIGITS = "".join(c for c in map(chr, range(128, sys.maxunicode + 1)) if unicodedata.decimal(c, None) is not None)
_PLAIN = "".join(str(unicodedata.decimal(c)) for c in _DIGITS)


def prompt(sentence: Column, start: Column, end: Column, alternatives: Column, default: Column | None = None, color: bool = False) -> Column:
    """The text shown for one occurrence: sentence, carets, numbered options.

    start and end are offsets within the sentence; default is an option number or null.
    """
    line = F.rtrim(sentence, F.lit("\n"))
    if color:
        part = lambda a, n: F.substring(line, a.cast("int") + 1, n.cast("int"))
        line = F.concat(part(F.lit(0), start), F.lit(BOLD), part(start, end - start), F.lit(RESET), part(end, F.greatest(F.length(line) - end, F.lit(0))))
    carets = F.concat(F.repeat(F.lit(" "), start.cast("int")), F.repeat(F.lit("^"), F.greatest(F.lit(1), (end - start).cast("int"))))
    chosen = F.lit(None).cast("int") if default is None else default

    def option(label: Column, i: Column) -> Column:
        return F.concat(F.lit("  "), i.cast("string"), F.lit(") "), label, F.when(i == chosen, F.lit(" [default]")).otherwise(F.lit("")))

    options = F.transform(F.concat(F.array(F.lit(NO_CHANGE)), alternatives), option)
    return F.concat(F.array_join(F.concat(F.array(line, carets), options), "\n"), F.lit("\n"))


def stripped(line: Column) -> Column:
    return F.regexp_replace(line, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")


def number(entered: Column) -> Column:
    """The integer that a stripped line stands for, as Python's int() reads it; null where it is none.

    Any decimal digits count, single underscores between them too.  Numbers of more than nine digits
    are no option's and come out as -1.
    """
    plain = F.translate(entered, _DIGITS, _PLAIN)
    digits = F.regexp_replace(F.regexp_replace(plain, "[+_-]", ""), "^0+(?=.)", "")
    size = F.when(F.length(digits) <= 9, digits.cast("int")).otherwise(F.lit(-1))
    return F.when(plain.rlike(r"^[+-]?[0-9]+(?:_[0-9]+)*\z"), F.when(plain.startswith("-"), -size).otherwise(size))


def read_lines(df: DataFrame) -> DataFrame:
    """Adds `entered`, `number` and `valid` of the `line` that answers each match."""
    df = df.withColumn("entered", stripped(F.coalesce("line", F.lit("")))).withColumn("number", number(F.col("entered")))
    return df.withColumn("valid", (F.col("entered") == "") | F.coalesce(F.col("number").between(0, F.size("alternatives")), F.lit(False)))


def parsed(matches: DataFrame, decisions: DataFrame | None = None) -> DataFrame:
    """matches with `line`, `entered`, `number` and `valid`, one decision for each match; without decisions, matches have their `line`."""
    if decisions is None:
        return read_lines(matches)
    return read_lines(matches.join(decisions.select("doc_id", "match_ord", "line"), ["doc_id", "match_ord"], "left"))


def picked() -> Column:
    """The raw alternative that a match's own line picks; null where it picks none."""
    return F.when(F.col("valid") & (F.col("number") > 0), F.try_element_at("raws", F.col("number")))


def with_default(df: DataFrame) -> DataFrame:
    """Adds `default_no`: the option of the `remembered` raw alternative, if it is offered here too."""
    same = F.array_position("raws", F.col("remembered"))
    at = F.array_position("alternatives", F.try_element_at("alternatives", F.when(same > 0, same.cast("int"))))
    return df.withColumn("default_no", F.when(at > 0, at.cast("int")))


def remembered(parsed_matches: DataFrame) -> DataFrame:
    """Adds `remembered` (raw alternative picked last for the base in the document) and `default_no`."""
    before = Window.partitionBy("doc_id", "base").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    df = parsed_matches.withColumn("__picked", picked())
    return with_default(df.withColumn("remembered", F.last("__picked", ignorenulls=True).over(before)).drop("__picked"))


def chosen(decided: DataFrame) -> DataFrame:
    """Adds `choice_no`: the option that the decision comes to; 0 for an invalid one."""
    by_enter = F.coalesce("default_no", F.lit(0))
    return decided.withColumn("choice_no", F.when(F.col("entered") == "", by_enter).when(F.col("valid"), F.col("number")).otherwise(0))


def replay(docs: DataFrame, matches: DataFrame, decisions: DataFrame | None = None) -> DataFrame:
    """doc_id, revised, exit_code: one decision for each match, by (doc_id, match_ord) or in the matches' own `line`.

    A decision of '^C' ends its document's session there: what was chosen before it is applied.
    """
    df = chosen(remembered(parsed(matches, decisions)))
    stop = F.min(F.when(F.col("entered") == INTERRUPT, F.col("match_ord"))).over(Window.partitionBy("doc_id"))
    df = df.withColumn("stop", stop)
    counts = (F.col("choice_no") > 0) & (F.col("stop").isNull() | (F.col("match_ord") < F.col("stop")))
    made = F.when(counts, F.struct("match_ord", "start", "end", F.try_element_at("alternatives", F.col("choice_no")).alias("replacement")))
    code = F.when(F.max("stop").isNotNull(), INTERRUPTED).otherwise(DONE)
    per_doc = df.groupBy("doc_id").agg(F.array_sort(F.collect_list(made)).alias("choices"), code.alias("exit_code"))
    return revised(docs, per_doc, F.coalesce("exit_code", F.lit(DONE)).alias("exit")).select("doc_id", "revised", F.col("exit").alias("exit_code"))


class Session:
    """One document's prompts, answered line by line."""

    def __init__(self, matches: list[dict]):
        self.matches, self.at = matches, 0
        self.memory: dict[str, str] = {}
        self.choices: list[tuple[int, int, str]] = []

    @property
    def current(self) -> dict | None:
        return self.matches[self.at] if self.at < len(self.matches) else None

    def default(self) -> int | None:
        """The option that was picked last for the base, if it is offered here too."""
        m = self.current
        raw = self.memory.get(m["base"])
        return m["alternatives"].index(m["alternatives"][m["raws"].index(raw)]) + 1 if raw in m["raws"] else None

    def answer(self, number: int | None) -> str | None:
        """Take one line's number, null for an empty line; the message for an invalid one, which changes nothing."""
        m, n = self.current, len(self.current["alternatives"])
        number = self.default() or 0 if number is None else number
        if not 0 <= number <= n:
            return f"  Invalid: enter a number from 0 to {n}.\n"
        if number:
            self.memory[m["base"]] = m["raws"][number - 1]
            self.choices.append((m["start"], m["end"], m["alternatives"][number - 1]))
        self.at += 1
        return None


def typed(line: str) -> int | None:
    """What `answer` takes, for a line typed at a terminal."""
    try:
        return int(line) if line.strip() else None
    except ValueError:
        return -1


def _walk(ident: object, matches: list[dict], lines: list[dict]) -> tuple[list[dict], int, int]:
    """Choices, exit code and number of invalid lines of one document, in order."""
    s, answers, code, invalid = Session(matches), iter(lines), DONE, 0
    while s.current is not None:
        line = next(answers, None)
        if line is None:
            raise EOFError(f"document {ident}: no line for the occurrence at {s.current['start']}")
        if line["entered"] == INTERRUPT:
            code = INTERRUPTED
            break
        invalid += s.answer(line["number"] if line["entered"] else None) is not None
    return [{"start": a, "end": b, "replacement": t} for a, b, t in s.choices], code, invalid


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    made = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("replacement", pa.string())]))
    for b in batches:
        for i in range(0, len(b), DOCUMENTS):
            part = b.slice(i, DOCUMENTS)
            ids = part.column("doc_id")
            out = [_walk(*row) for row in zip(ids.to_pylist(), part.column("ms").to_pylist(), part.column("ls").to_pylist(), strict=True)]
            choices, codes, wrong = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([ids, pa.array(choices, made), pa.array(codes, pa.int32()), pa.array(wrong, pa.int32())], ["doc_id", "choices", "code", "wrong"])


def _typed(line: Column) -> list[Column]:
    """What is read of a raw line: `entered` and `number`."""
    entered = stripped(F.coalesce(line, F.lit("")))
    return [entered.alias("entered"), F.coalesce(number(entered), F.lit(-1)).alias("number")]


def replay_lines(docs: DataFrame, matches: DataFrame, lines: DataFrame | None = None) -> DataFrame:
    """doc_id, revised, exit_code, invalid: raw lines (doc_id, line_no, line), as typed.

    Without `lines`, the matches have their own: `typed`, an array of (line_no, line), of which none is null.
    Which line answers which match depends on the lines before it, so each document is
    walked through in order, many documents in an Arrow batch; running out of lines is an error.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    one = F.struct("match_ord", "start", "end", "base", "alternatives", "raws")
    told = F.struct("line_no", "entered", "number")
    if lines is None:
        read = F.transform("typed", lambda t: F.struct(t["line_no"].alias("line_no"), *_typed(t["line"])))
        grouped = matches.select("doc_id", one.alias("m"), read.alias("l")).groupBy("doc_id").agg(F.array_sort(F.collect_list("m")).alias("ms"), F.array_sort(F.flatten(F.collect_list("l"))).alias("ls"))
    else:
        read = lines.select("doc_id", "line_no", *_typed(F.col("line"))).groupBy("doc_id").agg(F.array_sort(F.collect_list(told)).alias("ls"))
        own = matches.select("doc_id", one.alias("m")).groupBy("doc_id").agg(F.array_sort(F.collect_list("m")).alias("ms"))
        none = F.array().cast(read.schema["ls"].dataType)
        grouped = own.join(read, own["doc_id"].eqNullSafe(read["doc_id"]), "left").select(own["doc_id"], "ms", F.coalesce("ls", none).alias("ls"))
    schema = f"doc_id {kind}, choices array<struct<start:bigint,end:bigint,replacement:string>>, code int, wrong int"
    walked = grouped.mapInArrow(_walked, schema)
    out = revised(docs, walked, F.coalesce("code", F.lit(DONE)).alias("exit_code"), F.coalesce("wrong", F.lit(0)).alias("invalid"))
    return out.select("doc_id", "revised", "exit_code", "invalid")


def fetch(matches: DataFrame) -> Iterator[dict]:
    """The occurrences of one document, in order, for a live session."""
    return (r.asDict() for r in matches.orderBy("match_ord").collect())
