"""Counts at all levels of several dimensions at once, with exact numbers of distinct ids.

Rows are first counted by id and all dimensions, within the tasks that read them, so what is expanded to
levels is one row for each id and combination, not each row.  Those are sorted by id, and Arrow batches mark at which levels a
row is the first of its id; so levels add up marks, and hold one row for each combination and pattern of marks, not one for each
id.  Ids that may reach over the edge of a batch keep their name and are counted by it.
So the data is read once, no level keeps a set of ids, and an id has no more rows than there are combinations.

Defined results: `level` has a bit for each dimension that is left out, the first dimension's the highest; a
null dimension is a value of its own, told from a total by the level; null ids are counted as rows but not as ids; empty rows
give no rows, not even a grand total.  With `weight`, a row stands for as many and rows are taken as counted; repeated ones do no harm.
Strings as dimensions are told apart by their bytes, so collations that hold unequal bytes equal are not for this.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType, StringType, StructType

#: Types with equal values that look unequal (0.0 and -0.0); grouping makes them one.
UNEQUAL = (ArrayType, DoubleType, FloatType, StructType)


def _codes(values: pa.Array) -> np.ndarray:
    """Equal values, nulls too, by equal numbers."""
    if pa.types.is_nested(values.type):  # Arrow has no dictionary of these
        values = pa.array([repr(v) for v in values.to_pylist()], pa.string())
    return values.dictionary_encode(null_encoding="encode").indices.to_numpy().astype(np.int64)


def _marked(kept: list[tuple[int, ...]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of `kept` dimensions, id, number and place within the id as dimensions, number, held id and marks of levels, "1" where a row is the first of its id in the batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            *dims, ids, n, place = b.columns
            starts = place.to_numpy() == 1
            of = np.cumsum(starts)
            codes = [_codes(d) for d in dims]
            marks, keys = np.full((len(b), len(kept)), ord("0"), np.uint8), {}
            for own in sorted(kept, key=len):  # numbered anew with each dimension, so that products stay small
                key = keys[own[:-1]] * (codes[own[-1]].max() + 1) + codes[own[-1]] if own else of
                _, first, keys[own] = np.unique(key, return_index=True, return_inverse=True)
                marks[first, kept.index(own)] = ord("1")
            known = ids.is_valid().to_numpy(zero_copy_only=False)
            marks[~known] = ord("0")
            edge = known & ((of == of[-1]) | (of == 0))
            held = ids.take(pa.array(np.arange(len(b)), mask=~edge))
            marks = pa.array(marks.view(f"S{len(kept)}").ravel().astype(str), pa.string())
            yield pa.RecordBatch.from_arrays([*dims, n, held, marks], [*b.schema.names[: len(dims)], "__n", "__held", "__first"])

    return run


def level_counts(rows: DataFrame, dims: Sequence[str], ident: str, weight: str | None = None) -> DataFrame:
    """dims..., level, n (rows) and ids (distinct values of `ident`) for every combination of dimensions and totals."""
    dims = list(dims)
    times, ident = F.lit(1) if weight is None else F.col(weight).cast("long"), F.col(ident).alias("__id")
    if weight is None or any(isinstance(rows.schema[d].dataType, UNEQUAL) for d in dims):
        fine = rows.groupBy(*dims, ident).agg(F.sum(times).cast("long").alias("__n"))
    else:
        fine = rows.select(*dims, ident, times.alias("__n"))
    placed = fine.withColumn("__place", F.row_number().over(Window.partitionBy("__id").orderBy("__id")))
    kept = [tuple(i for i in range(len(dims)) if not level >> (len(dims) - 1 - i) & 1) for level in range(1 << len(dims))]
    schema = StructType([fine.schema[d] for d in dims]).add(fine.schema["__n"]).add("__held", fine.schema["__id"].dataType).add("__first", StringType())
    marked = placed.mapInArrow(_marked(kept), schema)
    always = ["__held", "__first"]
    each = marked.groupingSets([[*(F.col(dims[i]) for i in own), *map(F.col, always)] for own in kept], *dims, *always).agg(
        F.grouping_id(*dims, *always).alias("__level"), F.sum("__n").alias("__n"), F.count(F.lit(1)).alias("__rows")
    )
    level = F.shiftright("__level", len(always)).cast("long")  # what is held and the marks are never left out
    each = each.withColumn("__level", level).withColumn("__is", F.substring("__first", F.col("__level").cast("int") + 1, F.lit(1)) == "1")
    alone = F.sum(F.when(F.col("__is") & F.col("__held").isNull(), F.col("__rows")).otherwise(0))
    return each.groupBy(*dims, F.col("__level").alias("level")).agg(F.sum("__n").alias("n"), (alone + F.count_distinct(F.when(F.col("__is"), F.col("__held")))).alias("ids"))
