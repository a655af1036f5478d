"""Rule-based quality filter whose thresholds come from the data of each language and source.

Main path: DataFrame functions only.  One pass measures every text; the measures
are written once.  Each (lang, source) then gets a quantile sketch of every
measure: counts of logarithmic buckets of integers, 32 to the octave, so a
quantile is at most 1/32 too large.  Sketches add up, which gives the sketches of
a language and of everything from the same counts; they serve the sources with
fewer than ``min_rows`` documents.  Fences from the quartiles are joined back.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kelpgrid.llm.common import join_null_safe, whole, words
from kelpgrid.session import materialize

SYMBOLS = "[#*$%&|<>]"
WINDOW = 5
BASE_MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


@dataclass(frozen=True)
class Rules:
    """Fences are q75 + reach * max(q75 - q25, step), and the same below q25 for word length.

    ``steps``: the least spread of each measure, so that a source whose documents
    agree does not reject the first one that differs.  Units: hundredths of a
    character, and events per thousand words or lines.
    """

    min_words: int = 10
    repeat_percent: int = 20
    min_rows: int = 200
    reach: int = 3
    steps: tuple[tuple[str, int], ...] = (("word_length", 50), ("symbols", 30), ("dup_lines", 60), ("repeats", 40))


def with_repeat_words(df: DataFrame, ws: str, name: str) -> DataFrame:
    """Add the number of words covered by windows of five words that occur twice or more in the array ``ws``.

    Every intermediate array is a column of its own, so none is computed again inside a lambda.
    """
    n = F.size(ws)
    keys = F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.get(ws, i + k) for k in range(WINDOW)]))
    df = df.withColumn("__k", F.when(n > WINDOW, keys))
    # Equal keys become neighbours; positions of keys with an equal neighbour are covered.
    placed = F.array_sort(F.transform("__k", lambda k, i: F.struct(k.alias("k"), i.alias("i"))))
    df = df.withColumn("__s", F.when(F.size(F.array_distinct("__k")) < F.size("__k"), placed))

    def same(x, j):
        return F.coalesce(F.get("__s", j)["k"] == x["k"], F.lit(False))

    twins = F.filter("__s", lambda x, j: same(x, j - 1) | same(x, j + 1))
    df = df.withColumn("__p", F.array_sort(F.transform(twins, lambda x: x["i"])))
    start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("total"))
    covered = F.aggregate("__p", start, lambda acc, p: F.struct(
        p.alias("last"), (acc["total"] + F.least(F.lit(WINDOW), p - acc["last"])).alias("total")), lambda acc: acc["total"])
    return df.withColumn(name, F.coalesce(covered, F.lit(0)).cast("long")).drop("__k", "__s", "__p")


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without the text, plus the base measures of every whole text (null: none)."""
    keep = [c for c in docs.columns if c != text and c not in [*BASE_MEASURES, "n_lines"]]
    body = whole(F.col(text))
    staged = docs.select(*keep, body.alias("__body")).withColumn("__w", words(F.col("__body"))).withColumn(
        "__l", F.filter(F.split("__body", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    staged = with_repeat_words(staged, "__w", "n_repeat_words")
    return staged.select(
        *keep, F.size("__w").cast("long").alias("n_words"), F.length(F.array_join("__w", "")).cast("long").alias("word_chars"),
        F.regexp_count("__body", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words", F.size("__l").cast("long").alias("n_lines"))


def _ratio(num: str, den: str, unit: int) -> Column:
    return F.when(F.col(den) > 0, F.expr(f"{unit} * {num} div {den}")).otherwise(F.lit(0).cast("long"))


def bucket(v: Column) -> Column:
    """Sketch bucket of an integer >= 0: itself below 64, then 32 to the octave."""
    e = F.length(F.bin(v)) - 6
    shift = F.call_function("shiftright", v, e)
    return F.when(v < 64, v).otherwise(e * 32 + shift).cast("long")


def bucket_top(b: Column) -> Column:
    """Largest integer of a bucket."""
    e = (F.floor(b / 32) - 1).cast("int")
    return F.when(b < 64, b).otherwise(F.call_function("shiftleft", b % 32 + 33, e) - 1).cast("long")


def sketches(measured: DataFrame, names: list[str]) -> DataFrame:
    """(lang, source, measure, bucket, n): one mergeable sketch for each language, source and measure."""
    pairs = F.array(*[F.struct(F.lit(m).alias("measure"), bucket(F.col(m)).alias("bucket")) for m in names])
    return (measured.select("lang", "source", F.explode(pairs).alias("m")).select("lang", "source", "m.*")
            .groupBy("lang", "source", "measure", "bucket").agg(F.count(F.lit(1)).alias("n")))


def quartiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """q25 and q75 of each (keys, measure), as bucket tops, with the number of rows ``n``."""
    merged = sketch.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))
    within = Window.partitionBy(*keys, "measure")
    cum = merged.select(*keys, "measure", "bucket", F.sum("n").over(within).alias("n"),
                        F.sum("n").over(within.orderBy("bucket")).alias("cum"))
    return cum.groupBy(*keys, "measure").agg(
        F.max("n").alias("n"),
        *[bucket_top(F.min(F.when(F.col("cum") * 4 >= F.col("n") * q, F.col("bucket")))).alias(f"q{25 * q}") for q in (1, 3)])


def fences(sketch: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """(lang, source) with ``lo_`` and ``hi_`` of every measure."""
    own = quartiles(sketch, ["lang", "source"])
    lang = quartiles(sketch, ["lang"]).select("lang", "measure", *[F.col(c).alias(f"l_{c}") for c in ("n", "q25", "q75")])
    everything = quartiles(sketch, []).select("measure", *[F.col(c).alias(f"a_{c}") for c in ("q25", "q75")])
    both = join_null_safe(own, lang, ["lang", "measure"]).join(everything, "measure")

    def pick(c):
        return F.when(F.col("n") >= rules.min_rows, F.col(c)).when(
            F.col("l_n") >= rules.min_rows, F.col(f"l_{c}")).otherwise(F.col(f"a_{c}"))

    step = F.element_at(F.create_map(*[F.lit(x).cast("long") if i else F.lit(x) for m in rules.steps for i, x in enumerate(m)]), F.col("measure"))
    both = both.select("lang", "source", "measure", pick("q25").alias("q25"), pick("q75").alias("q75"), step.alias("step"))
    spread = F.greatest(F.col("q75") - F.col("q25"), "step") * rules.reach
    return both.groupBy("lang", "source").agg(
        *[F.max(F.when(F.col("measure") == m, F.col("q75") + spread)).alias(f"hi_{m}") for m, _ in rules.steps],
        *[F.max(F.when(F.col("measure") == m, F.col("q25") - spread)).alias(f"lo_{m}") for m, _ in rules.steps])


def judge(docs: DataFrame, rules: Rules = Rules(), text: str = "text") -> DataFrame:
    """One row for each document: base measures, ``base_failed``, fences and ``kept``.

    Null text: no words, so it fails the base rule.  Null ``lang`` or ``source`` form
    groups of their own.  Repeated rows are judged alike; an empty table gives no
    rows.  Columns of ``docs`` named like a measure are replaced by it.  Only
    documents that pass the base rule feed the sketches.
    """
    made = {*BASE_MEASURES, "n_lines", "base_failed", "kept", *[m for m, _ in rules.steps],
            *[f"{s}_{m}" for m, _ in rules.steps for s in ("hi", "lo")]}
    docs = docs.select(*[c for c in docs.columns if c not in made])
    m = measures(docs, text)
    m = m.withColumn("base_failed", (F.col("n_words") < rules.min_words)
                     | (F.col("n_repeat_words") * 100 > F.col("n_words") * rules.repeat_percent))
    m = m.withColumns({"word_length": _ratio("word_chars", "n_words", 100), "symbols": _ratio("n_symbols", "n_words", 1000),
                       "dup_lines": _ratio("n_dup_lines", "n_lines", 1000), "repeats": _ratio("n_repeat_words", "n_words", 1000)})
    m = materialize(m)
    names = [x for x, _ in rules.steps]
    limits = fences(sketches(m.filter(~F.col("base_failed")), names), rules)
    out = join_null_safe(m, limits, ["lang", "source"], "left")
    inside = F.col("word_length") >= F.col("lo_word_length")
    for x in names:
        inside = inside & (F.col(x) <= F.col(f"hi_{x}"))
    return out.withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(True)))
