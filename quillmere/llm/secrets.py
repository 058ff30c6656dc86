"""Secret scans by character Markov models, in DataFrame operations only.

Base detections are patterns.  The method adds strings that look random: two
first-order character models, one of random strings and one of ordinary identifiers,
are trained from labelled samples; a candidate string whose log-likelihood
ratio per character is large enough is a secret.  The sample table is an argument; the
default holds random strings made by rule from hash values, and identifiers
made from everyday words in the usual spellings.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .spans import SPAN, spans

#: Characters of the models; every other character is the last class.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: A whole run of any length, after whatever stands before it ("=" too), with the padding that ends it.
CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+(?:={1,2}(?![A-Za-z0-9+/_=-]))?"
#: Mean log-likelihood ratio for each character that makes a candidate a secret.
THRESHOLD = 0.9
KINDS = ("assign", "access", "hex", "markov")
_ANY_CASE = "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in "password|passwd|secret|token|api_?key")
ASSIGN = rf"""({_ANY_CASE})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
#: Everyday words of identifiers.
WORDS = (
    "account address admin amount array async author backup batch binary bucket buffer button cache call cell change channel char check child class clear client close code color column "
    "command comment commit common compare config connect content context control convert copy count create current cursor data database date debug decode default delete detail device "
    "digest dialog direct display document domain double driver dump element email enable encode engine entry error event exact example execute export factory failed feature fetch field "
    "file filter final find first flag float folder font format frame from function future gather general global graph group handle handler hash header height history host image import "
    "index info init input insert instance integer internal invoice item iterator join json kernel label language last layout length level library limit line link list listener load "
    "local location lock logger login loop main manager map margin marker master match matrix maximum member memory menu merge message method metric minimum model module monitor mouse "
    "name native network next node notify number object offset open option order output owner package page panel parameter parent parse partition path pattern pending person phone picture "
    "pixel plugin pointer policy pool position prefix print private process product profile project property protocol provider proxy public query queue random range read record region "
    "register release remote remove render report request reset resource response result return route row sample schema scope screen script search section select send sequence series "
    "server service session setting shape shard signal simple size socket sort source split stack start state static status step storage store stream string style submit suffix summary "
    "sync system table target task template test text thread time title toggle tool topic total trace transaction transform tree trigger type union unique update upload user util valid "
    "value vector version video view virtual visible wait watch weight widget width window worker wrapper write yield zone"
)


def default_samples(spark: SparkSession, n: int = 3_000) -> DataFrame:
    """Labelled samples (text, label): 1 random strings, 0 ordinary identifiers; ``n`` of each, made by rule."""
    ids = spark.range(n)
    random = ids.select(F.substring(F.base64(F.unhex(F.sha2(F.concat(F.lit("sample "), F.col("id").cast("string")).cast("binary"), 384))), 1, 48).alias("text"), F.lit(1).alias("label"))
    words = F.split(F.lit(WORDS), " ")
    word = lambda k: F.get(words, F.pmod(F.xxhash64("id", F.lit(k)), F.size(words)).cast("int"))
    kind = F.pmod(F.col("id"), F.lit(4))
    joined = (
        F.when(kind == 0, F.concat(word(0), F.initcap(word(1)), F.initcap(word(2)), F.initcap(word(3))))
        .when(kind == 1, F.concat_ws("_", word(0), word(1), word(2), F.pmod(F.col("id"), F.lit(100)).cast("string")))
        .when(kind == 2, F.concat_ws("-", word(0), word(1), word(2)))
        .otherwise(F.concat_ws("/", word(0), word(1), F.concat_ws("_", F.upper(word(2)), F.upper(word(3)))))
    )
    return random.unionByName(ids.select(joined.alias("text"), F.lit(0).alias("label")))


def fit(samples: DataFrame, smooth: float = 0.5) -> list[float]:
    """Log ratios log P1(b|a) - log P0(b|a) of all pairs of character classes, by a * classes + b.

    Counts are one aggregation; what comes to the driver has at most 2 * classes**2 rows.
    """
    k = len(ALPHABET) + 1
    codes = samples.where("text is not null and label in (0, 1)").select("label", numbered(F.col("text")).alias("codes"))
    pairs = codes.select("label", F.explode(F.zip_with(F.slice("codes", 1, F.greatest(F.size("codes") - 1, F.lit(0))), F.slice("codes", 2, F.greatest(F.size("codes") - 1, F.lit(0))), lambda a, b: a * k + b)).alias("pair"))
    count = [[smooth] * (k * k), [smooth] * (k * k)]
    for r in pairs.groupBy("label", "pair").count().collect():
        count[r.label][r.pair] += r["count"]
    log_p = []
    for c in count:
        total = [sum(c[a * k : a * k + k]) for a in range(k)]
        log_p.append([math.log(c[a * k + b] / total[a]) for a in range(k) for b in range(k)])
    return [x - y for x, y in zip(log_p[1], log_p[0])]


def numbered(text: Column) -> Column:
    """array<int>: the class of each character of a text."""
    table = F.create_map(*(F.lit(x) for i, c in enumerate(ALPHABET) for x in (c, i)))
    return F.transform(F.filter(F.split(text, "", -1), lambda c: F.length(c) > 0), lambda c: F.coalesce(F.try_element_at(table, c), F.lit(len(ALPHABET))))


def ratio(codes: Column, table: Column) -> Column:
    """Mean log ratio of the pairs of an array of classes, with the table of log ratios as an array column."""
    k = len(ALPHABET) + 1
    start = F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("sum"))
    total = F.aggregate(codes, start, lambda a, c: F.struct(c.alias("last"), (a["sum"] + F.when(a["last"] < 0, F.lit(0.0)).otherwise(F.get(table, a["last"] * k + c))).alias("sum")), lambda a: a["sum"])
    return total / F.greatest(F.size(codes) - 1, F.lit(1))


def detect(docs: DataFrame, table: list[float], id_column: str = "doc_id", text_column: str = "text", threshold: float = THRESHOLD, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows with doc_id, kept columns, text, and arrays of (start, end) spans by kind: assign, access, hex, markov."""
    base = docs.select(F.col(id_column).alias("doc_id"), *keep, F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("_text"))
    none = F.array().cast(SPAN)
    cut = lambda s: F.substring(F.col("_text"), s["start"] + 1, s["end"] - s["start"])
    found = base.select(
        "*",
        F.when(F.col("_text").rlike(ASSIGN), spans("_text", ASSIGN)).otherwise(none).alias("_assign"),
        F.when(F.col("_text").contains("AKIA"), F.filter(spans("_text", ACCESS), lambda s: s["end"] - s["start"] >= 20)).otherwise(none).alias("access"),
        F.when(F.col("_text").rlike(HEX), spans("_text", HEX)).otherwise(none).alias("hex"),
        F.when(F.col("_text").rlike(CANDIDATE), spans("_text", CANDIDATE)).otherwise(none).alias("_candidates"),
    )
    found = found.withColumn("assign", F.filter("_assign", lambda s: F.length(F.regexp_extract(cut(s), ASSIGN, 2)) >= 6))
    # random strings hold a digit and a letter and lie outside the base detections
    mixed = lambda t: t.rlike("[0-9]") & t.rlike("[A-Za-z]")
    found = found.withColumn("_base", F.concat("assign", "access", "hex"))
    free = lambda s: ~F.exists("_base", lambda b: (b["start"] < s["end"]) & (b["end"] > s["start"]))
    found = found.withColumn("_candidates", F.filter("_candidates", lambda s: mixed(cut(s)) & free(s)))
    numbers = F.array(*map(F.lit, table))
    scored = F.when(F.size("_candidates") > 0, F.filter("_candidates", lambda s: ratio(numbered(cut(s)), numbers) >= threshold)).otherwise(none)
    return found.select("doc_id", *keep, F.col("_text").alias("text"), "assign", "access", "hex", scored.alias("markov"))


def _named(kinds: tuple[str, ...]) -> Column:
    """'kind:start:end' of all spans by start, then kind as listed, comma-joined."""

    def named(i: int, kind: str) -> Column:
        return F.transform(F.col(kind), lambda s: F.struct(s["start"].alias("start"), F.lit(i).alias("kind"), F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string")).alias("name")))

    rows = F.concat(*(named(i, k) for i, k in enumerate(kinds)))
    return F.array_join(F.transform(F.array_sort(rows), lambda x: x["name"]), ",")


def secret_scan(docs: DataFrame, table: list[float], id_column: str = "doc_id", text_column: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Per row: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    Null and empty texts have no spans.  Repeated rows are scanned each; other columns are not read.
    """
    found = detect(docs, table, id_column, text_column, threshold)
    base = ("assign", "access", "hex")
    return found.select("doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k in base), F.sha2(_named(base).cast("binary"), 256).alias("base_sha256"), _named(KINDS).alias("spans"))


def redact(docs: DataFrame, table: list[float], text_column: str = "text", mark: str = "[SECRET]", threshold: float = THRESHOLD, before: str | None = None) -> DataFrame:
    """``docs`` with every span replaced by ``mark`` (spans that overlap: one mark); other texts and columns are unchanged.

    ``before`` names a further column with the text as it was.
    """
    columns = docs.columns
    row = docs.select(F.struct(*columns).alias("_row"), F.col(text_column).cast("string").alias("_body"))
    found = detect(row, table, "_body", "_body", threshold, keep=("_row",))
    found = found.withColumn("every", F.array_sort(F.concat(*(F.col(k) for k in KINDS))))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    joined = F.aggregate(
        "every", start,
        lambda a, s: F.when(s["start"] < a["at"], F.struct(F.greatest(a["at"], s["end"]).alias("at"), a["out"].alias("out"))).otherwise(
            F.struct(s["end"].alias("at"), F.concat(a["out"], F.substring(F.col("text"), a["at"] + 1, s["start"] - a["at"]), F.lit(mark)).alias("out"))
        ),
        lambda a: F.concat(a["out"], F.substring(F.col("text"), a["at"] + 1, F.lit(2**31 - 1))),
    )
    found = found.select("_row", F.when(F.size("every") > 0, joined).otherwise(F.col("_row")[text_column]).alias("_clean"))
    kept = [F.col("_clean" if c == text_column else f"_row.`{c}`").alias(c) for c in columns]
    return found.select(*kept, *([F.col("_row")[text_column].alias(before)] if before else []))
