"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree (DataFrame functions only).

Each source's documents, in the order of a hash, form a line of words that is walked from its start as
often as the source's target asks (its last walk may end inside a document). The line is cut into blocks
of ``BLOCK`` words; a source's quota is its number of blocks. The root of a binary tree holds all quotas;
every node splits them between its two halves of the output shards by exact hypergeometric draws, source
by source, so block counts are conserved at every node. A leaf's quotas are consecutive places in its
sources' block permutations (ranks of a keyed hash of the block): shards draw disjoint blocks. Within a shard rows are ordered by hash.

The line's offsets are sums per hash bucket and running sums within buckets, so no source is one task.
All draws come from hashes of node and source: reruns agree.

Targets: sources by code point, null last, weigh 5, 2, 1, repeating, and share the sum of all sizes; none
exceeds ``CAP`` times its source's size, the excess goes to the others by weight.

Defined cases: null text has size 0; a document without words is never drawn (taken 0); a null source is a
source of its own; repeated rows are drawn each for itself; an empty table gives no rows; other columns
are ignored.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlab.llm.common import SEPARATORS, kept, parts, stored

WEIGHTS, CAP = (5, 2, 1), 3
#: Words of a block and of an output shard.
BLOCK, SHARD = 1 << 13, 1 << 18
#: Hash buckets of a source's line (bits).
BUCKET_BITS = 12
#: Nodes of a tree level from which on the levels are spread over the cluster.
WIDE = 256


def word_count(text: Column) -> Column:
    """Each word with the separators after it becomes one mark; the marks are counted."""
    marks = F.regexp_replace(F.ltrim(text, F.lit(SEPARATORS)), "[^ \\t\\n\\x0B\\f\\r]+[ \\t\\n\\x0B\\f\\r]*", "x")
    return F.coalesce(F.length(marks), F.lit(0)).cast("long")


def source_targets(sized: DataFrame) -> DataFrame:
    """source, place (from 0, by code point, null last), source_size, target. One row per source."""
    total = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    every = Window.partitionBy()
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (F.col("place") % len(WEIGHTS) + 1).cast("int"))
    own = (total.withColumn("place", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
           .withColumn("weight", weight.cast("double")).withColumn("all", F.sum("source_size").over(every)).withColumn("weights", F.sum("weight").over(every))
           .withColumn("most", (CAP * F.col("source_size")).cast("double")))
    # fill by rising most / weight: the first source that its level leaves below its cap sets the level of all after it
    before = Window.orderBy(F.col("most") / F.col("weight"), "place").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0.0)
    level = (F.col("all") - F.coalesce(F.sum("most").over(before), zero)) / (F.col("weights") - F.coalesce(F.sum("weight").over(before), zero))
    own = own.withColumn("level", level)
    fits = F.when(F.col("most") >= F.col("level") * F.col("weight"), F.struct((F.col("most") / F.col("weight")).alias("r"), "place", "level"))
    own = own.withColumn("water", F.coalesce(F.min(fits).over(every)["level"], F.lit(float("inf"))))
    return own.select("source", "place", "source_size", F.least("most", F.col("water") * F.col("weight")).alias("target"))


def lines(sized: DataFrame, seed: int) -> DataFrame:
    """Adds ``at``: the words of the source's line before the document."""
    hashed = sized.withColumn("u", F.xxhash64(F.lit(seed), "doc_id")).withColumn("bucket", F.shiftrightunsigned("u", 64 - BUCKET_BITS))
    sums = hashed.groupBy("place", "bucket").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("place").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("place", "bucket", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("first"))
    within = Window.partitionBy("place", "bucket").orderBy("u", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    return (hashed.join(sums, ["place", "bucket"]).withColumn("at", F.col("first") + F.coalesce(F.sum("size").over(within), F.lit(0)))
            .drop("u", "bucket", "first"))


def hypergeometric(u: Column, total: Column, good: Column, drawn: Column) -> Column:
    """A draw by inverse transform: how many of ``drawn`` of ``total`` items are among the ``good``.

    Relative weights are summed over the support, or over 9 standard deviations either way of the mean where
    it is longer (what lies beyond has a probability below 1e-17).
    """
    total, good, drawn = total.cast("double"), good.cast("double"), drawn.cast("double")
    mean = drawn * good / F.greatest(total, F.lit(1.0))
    sd = F.sqrt(F.greatest(mean * (1 - good / F.greatest(total, F.lit(1.0))) * (total - drawn) / F.greatest(total - 1, F.lit(1.0)), F.lit(0.0)))
    lo = F.greatest(F.lit(0.0), drawn + good - total, F.floor(mean - 9 * sd - 2).cast("double")).cast("long")
    hi = F.least(good, drawn, F.ceil(mean + 9 * sd + 2).cast("double")).cast("long")
    ratio = lambda x: (good - x) * (drawn - x) / ((x + 1) * (total - good - drawn + x + 1))
    start = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("sum"))
    # w is the weight of x; a summand that no longer counts is no harm
    summed = F.aggregate(F.sequence(lo, hi), start, lambda s, x: F.struct((s["w"] * F.when(x < hi, ratio(x)).otherwise(0.0)).alias("w"), (s["sum"] + s["w"]).alias("sum")))["sum"]
    seek = F.struct(F.lit(1.0).alias("w"), (u * summed).alias("left"), lo.alias("x"))
    found = F.aggregate(F.sequence(lo, hi), seek, lambda s, x: F.struct(
        (s["w"] * F.when(x < hi, ratio(x)).otherwise(0.0)).alias("w"), (s["left"] - s["w"]).alias("left"),
        F.when((s["left"] > s["w"]) & (x < hi), x + 1).otherwise(s["x"]).alias("x")))
    return found["x"]


def shard_quotas(quotas: DataFrame, shard_blocks: int, seed: int) -> DataFrame:
    """quotas (place, quota, quota > 0) -> shard, place, begin, quota: each shard's range of each source's block permutation."""
    root = quotas.agg(F.array_sort(F.collect_list(F.struct("place", "quota"))).alias("all"), F.sum("quota").alias("blocks")).where("blocks > 0")
    root = root.select(F.lit(0).cast("long").alias("lo"), F.ceil(F.col("blocks") / shard_blocks).cast("long").alias("hi"), "blocks",
                       F.transform("all", lambda s: s["place"]).alias("places"), F.transform("all", lambda s: s["quota"]).alias("q"),
                       F.transform("all", lambda s: F.lit(0).cast("long")).alias("begin"))
    found = root.select("hi").first()
    shards = found["hi"] if found else 0
    nodes, width = root.withColumn("shards", F.col("hi")), 1
    while width < shards:
        mid = ((F.col("lo") + F.col("hi")) / 2).cast("long")
        until = lambda s: F.floor(s * F.col("blocks") / F.col("shards")).cast("long")
        state = F.struct(F.aggregate("q", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), (until(mid) - until(F.col("lo"))).alias("take"),
                         F.array().cast("array<long>").alias("out"))

        def draw(s: Column, x: Column) -> Column:
            own = F.element_at("q", x + 1)
            u = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("lo"), F.col("hi"), x), 11) / F.lit(float(1 << 53))
            got = hypergeometric(u, s["total"], own, s["take"])
            return F.struct((s["total"] - own).alias("total"), (s["take"] - got).alias("take"), F.concat(s["out"], F.array(got)).alias("out"))

        left = F.aggregate(F.sequence(F.lit(0), F.size("q") - 1), state, draw)["out"]
        nodes = nodes.withColumn("mid", mid).withColumn("left", F.when(F.col("hi") - F.col("lo") > 1, left))
        half = F.struct("lo", F.col("mid").alias("hi"), F.col("left").alias("q"), "begin")
        rest = F.struct(F.col("mid").alias("lo"), "hi", F.zip_with("q", "left", lambda a, b: a - b).alias("q"), F.zip_with("begin", "left", lambda a, b: a + b).alias("begin"))
        same = F.struct("lo", "hi", "q", "begin")
        nodes = nodes.select("blocks", "shards", "places", F.explode(F.when(F.col("left").isNull(), F.array(same)).otherwise(F.array(half, rest))).alias("n"))
        nodes = nodes.select("blocks", "shards", "places", "n.*")
        width *= 2
        if width == WIDE:
            nodes = nodes.repartition(parts(nodes.sparkSession), "lo")
    leaf = nodes.select(F.col("lo").alias("shard"), F.explode(F.arrays_zip("places", "begin", "q")).alias("s"))
    return leaf.select("shard", F.col("s.places").alias("place"), F.col("s.begin").alias("begin"), F.col("s.q").alias("quota")).where("quota > 0")


def seats(ranges: DataFrame, seed: int) -> DataFrame:
    """ranges (shard, place, begin, quota) -> place, block, shard: the shard of every block of every source.

    A block's seat is the rank of its hash in its source; ranks are running sums over hash buckets and ranks within them.
    """
    every = ranges.select("place", "shard", F.explode(F.sequence(F.col("begin"), F.col("begin") + F.col("quota") - 1)).alias("seat"))
    hashed = every.select("place", F.col("seat").alias("block"), F.xxhash64(F.lit(seed), F.lit("block"), "place", "seat").alias("u"))
    hashed = hashed.withColumn("bucket", F.shiftrightunsigned("u", 64 - BUCKET_BITS))
    sums = hashed.groupBy("place", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("place").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("place", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    within = Window.partitionBy("place", "bucket").orderBy("u", "block")
    ranked = hashed.join(sums, ["place", "bucket"]).select("place", "block", (F.col("first") + F.row_number().over(within) - 1).alias("seat"))
    return ranked.join(every, ["place", "seat"]).select("place", "block", "shard")


def mixture(docs: DataFrame, block: int = BLOCK, shard: int = SHARD, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """(documents, copies).

    documents: doc_id, size, source_size, target, place, at; copies: place, at, copy, words, shard, key.
    ``place`` and ``at`` name a document with words; ``key`` orders a shard's rows.
    """
    sized = kept(docs.select("doc_id", F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size")))
    targets = stored(source_targets(sized).coalesce(1), "targets")  # one row per source
    told = sized.join(targets.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s", "source")
    placed = kept(lines(told, seed))
    want = F.round("target").cast("long")
    passes = F.when(F.col("source_size") > 0, F.floor(want / F.col("source_size"))).otherwise(0).cast("long")
    drawn = (placed.where("size > 0").withColumn("want", want).withColumn("passes", passes).select("place", "at", "size", "source_size", "want", "passes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("passes"))).alias("copy"))
             .withColumn("words", F.when(F.col("copy") < F.col("passes"), F.col("size")).otherwise(
                 F.least(F.col("size"), F.col("want") - F.col("passes") * F.col("source_size") - F.col("at")))).where("words > 0"))
    drawn = drawn.select("place", "at", "copy", "words", F.floor((F.col("copy") * F.col("source_size") + F.col("at")) / block).cast("long").alias("block"))
    quotas = targets.select("place", F.ceil(F.round("target") / block).cast("long").alias("quota")).where("quota > 0")
    ranges = shard_quotas(quotas, max(1, shard // block), seed)
    copies = drawn.join(stored(seats(stored(ranges, "ranges"), seed), "seats"), ["place", "block"]).withColumn("key", F.xxhash64(F.lit(seed), "place", "at", "copy"))
    return placed, copies.select("place", "at", "copy", "words", "shard", "key")


def mixed_sizes(docs: DataFrame, **knobs: int) -> DataFrame:
    """doc_id, size, source_size, target, taken, shards (of its copies) for every row of docs."""
    placed, copies = mixture(docs, **knobs)
    taken = copies.groupBy("place", "at").agg(F.sum("words").alias("taken"), F.array_sort(F.collect_list("shard")).alias("shards"))
    taken = taken.select(F.col("place").alias("p"), F.col("at").alias("a"), "taken", "shards")
    out = placed.join(taken, (F.col("place") == F.col("p")) & (F.col("at") == F.col("a")) & (F.col("size") > 0), "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"),
                      F.coalesce("shards", F.array().cast("array<long>")).alias("shards"))


def mixed_documents(docs: DataFrame, **knobs: int) -> DataFrame:
    """The mix itself: one row per copy with shard, slot (order within the shard), copy, words, and the document's columns.

    ``words`` is below the document's size where a source's last walk ends inside it; the text stays whole.
    Of rows that share a doc_id each is drawn for itself; they must be equal.
    """
    placed, copies = mixture(docs, **knobs)
    named = copies.join(placed.select("place", "at", "doc_id", "size").where("size > 0").drop("size"), ["place", "at"])
    order = Window.partitionBy("shard").orderBy("key", "place", "at", "copy")
    plan = named.withColumn("slot", F.row_number().over(order) - 1).select(F.col("doc_id").alias("_id"), "shard", "slot", "copy", "words")
    docs = docs.dropDuplicates(["doc_id"])  # the join below uses the same partitioning
    own = [docs[c] for c in docs.columns if c not in ("shard", "slot", "copy", "words")]
    return docs.join(plan, docs["doc_id"] == plan["_id"]).select(plan["shard"], plan["slot"], plan["copy"], plan["words"], *own)
