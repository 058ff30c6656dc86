"""Quality rules with adaptive thresholds, in DataFrame operations only.

Five values of each document that passes the base rules are sketched per language and
source: the mean word length, the share of punctuation, the variety of words
(log distinct words over log words), and the shares of repeated words and lines.  A sketch
counts values on a fixed grid; sketches merge exactly by addition and give quantiles to
one grid step.  A group of few documents uses the merged sketch of its language, or of all; where
these hold few as well there is no limit.

All limits are quantiles of these sketches, without a constant of their own: a value may lie
FENCE times as far beyond an outer quartile as this lies from the median.  Repeated words
and lines are absent from most documents; there the sketch holds those that have some,
and the upper quartile may be exceeded by its own ratio to the median.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, written

SPACE = r"[ \x09-\x0D]+"
WINDOW = 8
#: Documents that a group's own sketch of a value needs.
GROUP_ROWS = 50
#: How many times the distance from the median to a quartile a value may lie beyond that quartile.
FENCE = 8
GRID = 10_000
#: Values with an upper and a lower limit, and those that most documents have none of.
UPPER, LOWER, SPARSE = ("length", "punctuation", "repeated", "lines"), ("length", "variety"), ("repeated", "lines")
#: What is not ASCII punctuation.
NOT_PUNCTUATION = r"[^!-/:-@\[-`{-~]+"


def repeated_words(words: str, codes: str) -> Column:
    """Words in windows that occur twice or more, from a column of words and one of sorted (code, place) structs."""
    twice = F.filter(
        F.col(codes),
        lambda x, i: (F.get(F.col(codes), i + 1)["code"].eqNullSafe(x["code"])) | ((i > 0) & F.get(F.col(codes), F.greatest(i - 1, F.lit(0)))["code"].eqNullSafe(x["code"])),
    )
    places = F.array_sort(F.transform(twice, lambda x: x["place"]))
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("to"))
    return F.aggregate(places, zero, lambda a, p: F.struct((a["n"] + p + WINDOW - F.greatest(p, a["to"])).alias("n"), (p + WINDOW).alias("to")), lambda a: a["n"])


def measures(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", source_column: str = "source") -> DataFrame:
    """Per row: doc_id, lang, source, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_punctuation, n_distinct."""
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    base = docs.select(F.col(id_column).alias("doc_id"), F.col(lang_column).cast("string").alias("lang"), F.col(source_column).cast("string").alias("source"), text.alias("text"))
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^ \x09-\x0D]"))
    split = base.select(
        "doc_id", "lang", "source",
        F.array_remove(F.split("text", SPACE, -1), "").alias("words"), lines.alias("lines"),
        (F.length("text") - F.length(F.translate("text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"), F.length(F.regexp_replace("text", NOT_PUNCTUATION, "")).cast("long").alias("n_punctuation"),
    )
    n = F.size("words")
    windows = F.when(n >= WINDOW, F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("words", i, WINDOW)))).otherwise(F.array().cast("array<bigint>"))
    coded = split.select(
        "doc_id", "lang", "source", "n_symbols", "n_punctuation", F.size(F.array_distinct("words")).cast("long").alias("n_distinct"), n.cast("long").alias("n_words"), F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), "words", windows.alias("windows"),
    )
    # only texts in which some window repeats go on to the sorted form, there by the words themselves
    repeats = F.size("windows") > F.size(F.array_distinct("windows"))
    exact = F.transform(F.col("windows"), lambda c, i: F.struct(F.array_join(F.slice("words", i + 1, WINDOW), " ").alias("code"), i.alias("place")))
    sorted_codes = coded.withColumn("codes", F.when(repeats, F.sort_array(exact)))
    return sorted_codes.select(
        "doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines",
        F.coalesce(F.when(F.col("codes").isNotNull(), repeated_words("words", "codes")), F.lit(0)).cast("long").alias("n_repeat_words"), "n_punctuation", "n_distinct",
    )


def failed() -> Column:
    """The base rules of the contract."""
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def values() -> dict[str, Column]:
    """Grid values of a measured row that passes the base rules, integers from 0 to GRID."""

    def share(a: str, b: str, scale: int = GRID) -> Column:
        return F.least(F.floor(F.try_divide(F.col(a) * scale, F.col(b))), F.lit(GRID).cast("long"))

    # the small addend keeps quotients that are whole but for the last bit on one side
    variety = F.floor(GRID * F.log("n_distinct") / F.log("n_words") + 1e-6)
    found = {"length": share("word_chars", "n_words", 100), "punctuation": share("n_punctuation", "word_chars"), "variety": variety, "repeated": share("n_repeat_words", "n_words"), "lines": share("n_dup_lines", "n_lines")}
    return {k: F.coalesce(v, F.lit(0).cast("long")) for k, v in found.items()}


def limits(measured: DataFrame) -> DataFrame:
    """Limits by (lang, source): lo and hi of each value, from the sketch of the group, its language or all rows."""
    whole = measured.where(~failed())
    points = whole.select("lang", "source", F.explode(F.array(*(F.struct(F.lit(k).alias("what"), v.alias("at")) for k, v in values().items()))).alias("p"))
    group = points.groupBy("lang", "source", F.col("p.what").alias("what"), F.col("p.at").alias("at")).agg(F.count("*").alias("n"))
    merged = {
        0: group,
        1: group.groupBy("lang", "what", "at").agg(F.sum("n").alias("n")).withColumn("source", F.lit(None).cast("string")),
        2: group.groupBy("what", "at").agg(F.sum("n").alias("n")).withColumns({"lang": F.lit(None).cast("string"), "source": F.lit(None).cast("string")}),
    }
    chosen = {}
    for level, sketch in merged.items():
        keys = ["lang", "source", "what"]
        w = Window.partitionBy(*keys)
        present = sketch.where((F.col("at") > 0) | ~F.col("what").isin(*SPARSE))
        ranked = present.withColumn("up_to", F.sum("n").over(w.orderBy("at"))).withColumn("total", F.sum("n").over(w))
        first = lambda q: F.min(F.when(F.col("up_to") * 4 >= F.col("total") * q, F.col("at")))
        q = ranked.groupBy(*keys).agg(F.max("total").alias("total"), *(first(k).alias(f"q{k}") for k in (1, 2, 3)))
        fence = F.col("q3") + FENCE * (F.col("q3") - F.col("q2"))
        q = q.withColumn("hi", F.when(F.col("what").isin(*SPARSE), F.floor(F.col("q3") * F.col("q3") / F.col("q2"))).otherwise(fence)).withColumn("lo", F.col("q1") - FENCE * (F.col("q2") - F.col("q1")))
        one = [F.max(F.when((F.col("what") == k) & (F.col("total") >= GROUP_ROWS), F.struct("lo", "hi"))).alias(f"{k}_{level}") for k in values()]
        chosen[level] = q.groupBy(F.col("lang").alias(f"lang_{level}"), F.col("source").alias(f"source_{level}")).agg(*one)
    joined = chosen[0].join(chosen[1], F.col("lang_0").eqNullSafe(F.col("lang_1")), "left").join(F.broadcast(chosen[2]), F.lit(True), "left")
    return joined.select(F.col("lang_0").alias("lang"), F.col("source_0").alias("source"), *(F.coalesce(*(F.col(f"{k}_{level}") for level in chosen)).alias(k) for k in values()))


def quality_rules(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", source_column: str = "source") -> DataFrame:
    """Per row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept.

    Null texts count as empty: no words, base_failed.  A null language or source is
    a group of its own.  Repeated rows are measured each; other columns are not read.
    """
    measured = written(measures(docs, id_column, text_column, lang_column, source_column), "measures")
    table = written(limits(measured), "limits")
    if table.count() <= BROADCAST_ROWS // 8:
        table = F.broadcast(table)
    joined = measured.join(table.withColumnsRenamed({"lang": "l", "source": "s"}), F.col("lang").eqNullSafe(F.col("l")) & F.col("source").eqNullSafe(F.col("s")), "left")
    inside = F.lit(True)
    for k, v in values().items():
        if k in UPPER:
            inside = inside & F.coalesce(v <= F.col(k)["hi"], F.lit(True))
        if k in LOWER:
            inside = inside & F.coalesce(v >= F.col(k)["lo"], F.lit(True))
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed().alias("base_failed"), (~failed() & inside).alias("kept"))
