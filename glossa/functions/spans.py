"""Spans of a pattern in a column of texts, as arrays of half-open code-point offsets.

The gaps of a text between the matches of a pattern and the matches themselves alternate;
one pass of the pattern marks the matches with a sentinel, splitting at it gives the pieces, and
a running sum of their lengths every offset.  Texts that hold the sentinel are
split by the pattern itself, which is slower.  All of it stays a projection and works on streams.

Arrays cannot grow in place, so running sums go block by block: with blocks of the cube
root of the length, 100,000 matches take some fifty copies each instead of as many as there are.
Sorted arrays are searched by halving.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SENTINEL = "\x01"
SPAN = "struct<start:bigint,end:bigint>"
MATCH = "struct<start:bigint,end:bigint,surface:string>"
#: Characters of a part of a text, so that taking a piece of it does not count from its start.
PART = 512


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value taken once however often the body names it."""
    return F.get(F.transform(F.array(value), lambda x: body(x)), F.lit(0))


def indices(n: Column) -> Column:
    """array<int>: 0 to n - 1."""
    return F.when(n > 0, F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1)).otherwise(F.array().cast("array<int>"))


def _scanned(values: Column, merge: Callable[[Column, Column], Column]) -> Column:
    def step(acc: Column, v: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        return F.concat(acc, F.array(F.when(last.isNull(), v).otherwise(merge(last, v))))

    return F.aggregate(values, F.array().cast("array<bigint>"), step)


def running(values: Column, merge: Callable[[Column, Column], Column]) -> Column:
    """array<bigint>: each value merged with all before it, for an associative merge of bigints."""

    def by_blocks(v: Column, size: Column) -> Column:
        count = F.ceil(F.size(v) / size).cast("int")
        blocks = F.transform(indices(count), lambda k: _scanned(F.slice(v, k * size + 1, size), merge))

        def joined(bs: Column) -> Column:
            upto = _scanned(F.transform(bs, lambda b: F.element_at(b, -1)), merge)
            return let(upto, lambda u: F.flatten(F.transform(bs, lambda b, k: F.when(k == 0, b).otherwise(F.transform(b, lambda x: merge(F.get(u, k - 1), x))))))

        return let(blocks, joined)

    def choose(v: Column) -> Column:
        return F.when(F.size(v) <= 16, _scanned(v, merge)).otherwise(let(F.ceil(F.cbrt(F.size(v))).cast("int"), lambda size: by_blocks(v, size)))

    return let(values, choose)


def pieces(text: Column, pattern: str) -> Column:
    """Gaps and matches in turn: a gap first and last."""
    marked = F.split(F.regexp_replace(text, pattern, f"{SENTINEL}$0{SENTINEL}"), SENTINEL, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.flatten(F.zip_with(F.split(text, pattern, -1), found, lambda g, m: F.array(g, m)))
    return F.when(F.contains(text, F.lit(SENTINEL)), F.slice(pairs, F.lit(1), F.greatest(F.size(pairs) - 1, F.lit(1)))).otherwise(marked)


def find_all(text: Column, pattern: str) -> Column:
    """array<struct<start, end, surface>> of all matches."""
    none = F.array().cast(f"array<{MATCH}>")

    def located(p: Column) -> Column:
        at = indices(F.floor(F.size(p) / 2).cast("int"))
        ends = running(F.transform(at, lambda i: (F.length(F.get(p, 2 * i)) + F.length(F.get(p, 2 * i + 1))).cast("long")), lambda a, b: a + b)

        def one(end: Column, i: Column) -> Column:
            surface = F.get(p, 2 * i + 1)
            return F.struct((end - F.length(surface)).alias("start"), end.alias("end"), surface.alias("surface"))

        return F.when(F.size(p) > 1, F.transform(ends, one)).otherwise(none)

    return F.when(text.isNotNull(), let(pieces(text, pattern), located))


def only_spans(found: Column) -> Column:
    return F.transform(found, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end")))


def merged(spans: Column) -> Column:
    """Spans in order, those that overlap or touch made one."""

    def islands(s: Column, reach: Column) -> Column:
        last = F.size(s) - 1
        firsts = F.filter(s, lambda x, i: (i == 0) | (x["start"] > F.get(reach, i - 1)))
        ends = F.filter(reach, lambda r, i: (i == last) | (F.get(s, i + 1)["start"] > r))
        return F.zip_with(firsts, ends, lambda x, r: F.struct(x["start"].alias("start"), r.alias("end")))

    return let(F.array_sort(spans), lambda s: let(running(F.transform(s, lambda x: x["end"]), lambda a, b: F.greatest(a, b)), lambda r: islands(s, r)))


def count_while(array: Column, holds: Callable[[Column], Column]) -> Column:
    """How many leading elements fulfil a condition that no element after them does, by halving."""
    n = F.size(array)

    def step(acc: Column, _: Column) -> Column:
        middle = F.shiftright(acc["lo"] + acc["hi"], 1)
        more = F.struct((middle + 1).alias("lo"), acc["hi"].alias("hi"))
        return F.when(acc["lo"] >= acc["hi"], acc).when(holds(F.get(array, middle)), more).otherwise(F.struct(acc["lo"].alias("lo"), middle.alias("hi")))

    steps = F.sequence(F.lit(1), F.length(F.bin(n.cast("long"))))
    return F.aggregate(steps, F.struct(F.lit(0).alias("lo"), n.alias("hi")), step, lambda acc: acc["lo"])


def overlaps(start: Column, end: Column, spans: Column) -> Column:
    """Whether [start, end) shares a position with any of the merged spans; touching is not overlap."""
    return F.when(F.size(spans) > 0, F.coalesce(F.get(spans, count_while(spans, lambda p: p["start"] < end) - 1)["end"] > start, F.lit(False))).otherwise(F.lit(False))


def parts(text: Column) -> Column:
    """The text in parts of PART characters, for `piece`."""
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{PART}}}"), F.lit(0))


def piece(of: Column, start: Column, length: Column) -> Column:
    """A substring from an offset, out of a text's parts."""
    first = F.floor(start / PART).cast("int")
    count = F.floor((start + F.greatest(length, F.lit(1)) - 1) / PART).cast("int") - first + 1
    some = F.when(F.size(of) > first, F.array_join(F.slice(of, first + 1, count), "")).otherwise(F.lit(""))
    return F.substring(some, (start - first * PART).cast("int") + 1, length.cast("int"))
