"""Quality rules with adaptive thresholds (DataFrame functions only).

Every whole text gives a few integer measures. For each language and source the measures' distribution is
kept as a histogram sketch: counts per integer bucket (permille, or tenths of a character), which merge by
addition, are independent of partitioning and place any quantile within one bucket. Sketches of sources
merge into the language's and those into the whole corpus's; a group of fewer than ``GROUP`` documents
takes its thresholds from the next wider one. A document fails if a measure lies beyond
``FENCE`` interquartile ranges, and a slack, from the quartiles of its group.

Sketch rows number at most groups x measures x buckets, whatever the number of documents; one group holding
most rows is summed up map-side first.

Defined cases: null or word-free text has zero counts and fails the base rule (fewer than 10 words); null
language or source is a group of its own; repeated rows count and are judged each for itself; an empty table
gives no rows; other columns are ignored.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlab.llm.common import SEPARATORS, kept, stored

SPLIT = "[ \\t\\n\\x0B\\f\\r]+"
SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
NGRAM = 5
#: Least words of a document; most repeated words of 100.
LEAST_WORDS, MOST_REPEATED = 10, 20
#: Documents a group needs for thresholds of its own.
GROUP = 200
FENCE = 3
#: Measure -> (slack below the lower fence or None, slack above the upper one), in buckets.
MEASURES: dict[str, tuple[int | None, int]] = {"symbols": (None, 50), "dup_lines": (None, 350), "repeats": (None, 200), "upper": (None, 150), "word_length": (15, 15)}
#: Files of a stored sketch.
FILES = 4
#: Largest bucket.
TOP = 1000


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeated_words(words: Column) -> Column:
    """Words that lie in NGRAM-word windows found twice or more."""

    def positions(g: Column) -> Column:
        pairs = F.array_sort(F.transform(g, lambda x, i: F.struct(x.alias("g"), i.alias("i"))))
        twice = lambda s: F.filter(s, lambda x, i: (
            (i > 0) & (F.get(s, i - 1)["g"] == x["g"])) | ((i < F.size(s) - 1) & (F.get(s, i + 1)["g"] == x["g"])))
        return F.array_sort(F.transform(let(pairs, twice), lambda x: x["i"]))

    def cover(at: Column) -> Column:
        start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
        return F.aggregate(at, start, lambda s, p: F.struct((p + NGRAM).alias("end"), (s["n"] + p + NGRAM - F.greatest(s["end"], p)).alias("n")))["n"]

    def windows(h: Column) -> Column:
        return F.transform(F.slice(h, 1, F.size(h) - (NGRAM - 1)), lambda x, i: F.xxhash64(*[F.get(h, i + j) for j in range(NGRAM)]))

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    some = lambda g: F.when(F.size(F.array_distinct(g)) < F.size(g), cover(positions(g))).otherwise(0)
    return F.when(F.size(words) >= NGRAM, let(let(hashes, windows), some)).otherwise(0).cast("long")


def _without(text: Column, chars: str) -> Column:
    return F.length(F.translate(text, chars, "")).cast("long")


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts of every whole text."""
    own = docs.select(F.col("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.coalesce("text", F.lit("")).alias("text"))
    trimmed = F.btrim("text", F.lit(SEPARATORS))
    words = F.when(F.length(trimmed) > 0, F.split(trimmed, SPLIT)).otherwise(F.array().cast("array<string>"))
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(F.btrim(x, F.lit(SEPARATORS))) > 0)
    counts = lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words"))
    per_line = lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))
    size = F.length("text").cast("long")
    drawn = own.select("doc_id", "lang", "source", let(words, counts).alias("w"), let(lines, per_line).alias("l"), _without(F.col("text"), SEPARATORS).alias("word_chars"),
                       (size - _without(F.col("text"), SYMBOLS)).alias("n_symbols"), (size - _without(F.col("text"), UPPER)).alias("n_upper"))
    return drawn.select("doc_id", "lang", "source", "w.*", "l.*", "word_chars", "n_symbols", "n_upper")


def buckets(counts: DataFrame) -> DataFrame:
    c = F.col
    exact = lambda part, whole, unit: F.when(whole > 0, F.least((part * unit - F.pmod(part * unit, whole)) / whole, F.lit(TOP))).otherwise(0).cast("long")
    return counts.withColumns({
        "symbols": exact(c("n_symbols"), c("word_chars"), 1000), "dup_lines": exact(c("n_dup_lines"), c("n_lines"), 1000),
        "repeats": exact(c("n_repeat_words"), c("n_words"), 1000), "upper": exact(c("n_upper"), c("word_chars"), 1000),
        "word_length": exact(c("word_chars"), c("n_words"), 10)})


def sketches(bucketed: DataFrame) -> DataFrame:
    """lang, source, measure, bucket, n: the mergeable sketch of each language and source."""
    long = bucketed.select("lang", "source", F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("bucket")) for m in MEASURES])).alias("s"))
    return long.groupBy("lang", "source", "s.measure", "s.bucket").agg(F.count("*").alias("n"))


def merged(sketch: DataFrame, by: list[str]) -> DataFrame:
    return sketch.groupBy(*by, "measure", "bucket").agg(F.sum("n").alias("n"))


def fences(sketch: DataFrame, by: list[str]) -> DataFrame:
    """One row per group: documents, and for each measure the lowest and highest bucket that passes."""
    group = Window.partitionBy(*by, "measure")
    cum = sketch.withColumn("upto", F.sum("n").over(group.orderBy("bucket"))).withColumn("all", F.sum("n").over(group))
    quartiles = cum.groupBy(*by, "measure").agg(
        F.max("all").alias("docs"), F.min(F.when(4 * F.col("upto") >= F.col("all"), F.col("bucket"))).alias("q1"),
        F.min(F.when(4 * F.col("upto") >= 3 * F.col("all"), F.col("bucket"))).alias("q3"))
    wide = F.lit(FENCE) * (F.col("q3") - F.col("q1"))
    lows = F.create_map(*[x for m, (lo, _) in MEASURES.items() for x in (F.lit(m), F.lit(lo).cast("long"))])
    highs = F.create_map(*[x for m, (_, hi) in MEASURES.items() for x in (F.lit(m), F.lit(hi).cast("long"))])
    bound = quartiles.select(*by, "docs", "measure", (F.col("q1") - wide - lows[F.col("measure")]).alias("lo"), (F.col("q3") + wide + highs[F.col("measure")]).alias("hi"))
    return bound.groupBy(*by).agg(F.max("docs").alias("docs"), *[
        F.max(F.when(F.col("measure") == m, F.struct("lo", "hi"))).alias(m) for m in MEASURES])


def thresholds(sketch: DataFrame) -> DataFrame:
    """lang, source and the fences of the narrowest level with enough documents."""
    fine = fences(sketch, ["lang", "source"])
    lang = fences(merged(sketch, ["lang"]), ["lang"])
    every = fences(merged(sketch, []).withColumn("whole", F.lit(1)), ["whole"])
    named = lambda df, keys, tag: df.select(*[F.col(k).alias(f"{tag}_{k}") for k in keys], F.struct("docs", *MEASURES).alias(tag))
    joined = (named(fine, ["lang", "source"], "own").join(named(lang, ["lang"], "wide"), F.col("own_lang").eqNullSafe(F.col("wide_lang")))
              .crossJoin(F.broadcast(named(every, [], "all"))))  # one row
    level = F.when(F.col("own")["docs"] >= GROUP, F.col("own")).when(F.col("wide")["docs"] >= GROUP, F.col("wide")).otherwise(F.col("all"))
    return joined.select(F.col("own_lang").alias("t_lang"), F.col("own_source").alias("t_source"), level.alias("t"))


def judged(docs: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed, kept and failed (the measures beyond their fences)."""
    drawn = kept(buckets(measured(docs)))
    # both are small (groups x measures x buckets): a few files each
    limits = stored(thresholds(stored(sketches(drawn).coalesce(FILES), "sketch")).coalesce(FILES), "thresholds")
    out = drawn.join(limits, F.col("lang").eqNullSafe(F.col("t_lang")) & F.col("source").eqNullSafe(F.col("t_source")))
    beyond = lambda m: (F.col(m) > F.col("t")[m]["hi"]) | F.coalesce(F.col(m) < F.col("t")[m]["lo"], F.lit(False))
    failed = F.filter(F.array(*[F.when(beyond(m), F.lit(m)) for m in MEASURES]), lambda x: x.isNotNull())
    base = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    out = out.withColumn("base_failed", base).withColumn("failed", F.array_join(failed, ","))
    return out.select("doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "base_failed",
                      (~F.col("base_failed") & (F.col("failed") == "")).alias("kept"), "failed")


def filtered(docs: DataFrame) -> DataFrame:
    """The kept rows of ``docs``. Rows that share a doc_id must be equal."""
    good = judged(docs).where("kept").select(F.col("doc_id").alias("_id")).distinct()
    return docs.join(good, docs["doc_id"] == good["_id"], "left_semi")
