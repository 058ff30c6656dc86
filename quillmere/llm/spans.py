"""Places of regular-expression matches, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,end:int>>"


def spans(text: Column | str, pattern: Column | str) -> Column:
    """Leftmost non-overlapping matches as array<struct<start, end>> (code points, end exclusive).

    The text between matches (split) and the matches themselves (extract all) give
    the places as running sums of lengths.  The pattern must not match the empty string.
    """
    text = F.col(text) if isinstance(text, str) else text
    expression = F.lit(pattern) if isinstance(pattern, str) else pattern
    between = F.transform(F.split(text, pattern if isinstance(pattern, str) else expression, -1), lambda x: F.length(x))
    matches = F.transform(F.regexp_extract_all(text, expression, F.lit(0)), lambda x: F.length(x))
    pairs = F.arrays_zip(between.alias("b"), matches.alias("m"))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

    def step(a: Column, x: Column) -> Column:
        start = a["at"] + x["b"]
        end = start + x["m"]
        return F.struct(F.coalesce(end, start).alias("at"), F.when(x["m"].isNull(), a["out"]).otherwise(F.concat(a["out"], F.array(F.struct(start.alias("start"), end.alias("end"))))).alias("out"))

    return F.aggregate(pairs, zero, step, lambda a: a["out"])
