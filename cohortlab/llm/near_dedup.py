"""MinHash near-duplicates with tensored banding.

Two collections of ``m`` small hashes, each made of ``rows`` minhash values, give ``m * m`` tables:
the key of table (i, j) combines hash i of the first with hash j of the second collection. That
takes ``2 * m * rows`` minhash values where independent tables would need ``2 * m * m * rows``.
Two sets collide in some table exactly if they share a small hash in each collection, so a class of
equal sets that shares none in either is dropped before any table key is formed.

Candidates are confirmed on the full shingle sets. Within a table's bucket every member is first
compared with one member (a star); confirmed links are contracted to components; buckets that still
hold several components are compared in blocks of bounded size, in full, and yield at most a
spanning forest of their links. No pair list of a bucket is ever made. Joins whose sides grow with the corpus never broadcast, so
the driver holds no part of them.

Defined cases: null or word-free text has an empty set and no links; a text of fewer than five words
has one shingle, its whole word sequence; equal sets are one class; repeated doc_ids keep one row
per input row; other columns are ignored.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlab.llm.common import compact, discard, lists, map_arrow, merged, release, stored
from cohortlab.llm.components import components
from cohortlab.llm.words import GRAM, SPACED, U, mix, pieces, same_row

SHINGLE = 5
#: Links: PART * |intersection| >= WHOLE * |union|
PART, WHOLE = 100, 75
#: 10 x 10 tables of 2 + 2 values find a pair at similarity 0.75 with probability 0.9995.
SMALL_HASHES, ROWS = 10, 2
#: Members of one comparison block.
BLOCK = 256


def shingle_sets(texts: pa.Array):
    """Yields (first row, rows, shingle hashes sorted within each row, count of each row)."""
    for p in pieces(texts, SPACED, fold=True):
        h = p.hashes()
        start = np.flatnonzero(same_row(p.row, SHINGLE))
        row, gram = p.row[start], GRAM.windows(h, SHINGLE)[start] if len(start) else np.empty(0, dtype=U)
        short = np.flatnonzero((p.count > 0) & (p.count < SHINGLE))
        if len(short):
            whole = GRAM.slices(h, p.begin[short], p.begin[short + 1])
            row, gram = np.concatenate([row, short]), np.concatenate([gram, whole ^ p.count[short].astype(U)])
        order = np.lexsort((gram, row))
        row, gram = row[order], gram[order]
        fresh = np.ones(len(row), dtype=bool)
        fresh[1:] = (row[1:] != row[:-1]) | (gram[1:] != gram[:-1])
        row, gram = row[fresh], gram[fresh]
        yield p.first, p.rows, gram, np.bincount(row, minlength=p.rows)


def _multipliers(n: int) -> np.ndarray:
    return np.random.default_rng(7).integers(0, 1 << 62, (2, n), dtype=np.int64).view(U) * U(2) + U(1)


def sketches(docs: DataFrame, m: int = SMALL_HASHES, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, a 128-bit digest of the set (d1, d2), and the small hashes a and b."""
    mult = _multipliers(2 * m * rows)

    def run(batch: pa.RecordBatch):
        ids, text = batch.column(0), batch.column(1)
        for first, n, gram, count in shingle_sets(text):
            full = np.flatnonzero(count)
            begin = (np.cumsum(count) - count)[full]
            small = np.zeros((n, 2 * m), dtype=U)
            digest = np.zeros((n, 2), dtype=U)
            if len(full):
                for j in range(2 * m):
                    key = np.full(len(full), j, dtype=U)
                    for r in range(rows):
                        a, b = mult[:, j * rows + r]
                        key = mix(key * U(0x9E3779B97F4A7C15) + np.minimum.reduceat((gram ^ a) * b, begin))
                    small[full, j] = key
                digest[full, 0] = np.add.reduceat(gram, begin)
                digest[full, 1] = np.add.reduceat(mix(gram ^ U(0x5851F42D4C957F2D)), begin)
            signed, per = small.view(np.int64), np.where(count > 0, m, 0)
            yield pa.record_batch(
                [ids.slice(first, n), pa.array(count.astype(np.int64)), pa.array(digest[:, 0].view(np.int64)), pa.array(digest[:, 1].view(np.int64)),
                 lists(signed[full, :m].ravel(), per, pa.int64()), lists(signed[full, m:].ravel(), per, pa.int64())],
                ["doc_id", "n_shingles", "d1", "d2", "a", "b"])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run,
                     "doc_id long, n_shingles long, d1 long, d2 long, a array<long>, b array<long>")


def _buckets(classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, node) rows of the tables' buckets that hold two classes or more; and the stored rows below."""
    side = classes.select("node", "a", "b")
    small = stored(side.select("node", F.explode(F.concat(
        F.transform("a", lambda x: F.struct(F.lit(0).alias("side"), x.alias("h"))),
        F.transform("b", lambda x: F.struct(F.lit(1).alias("side"), x.alias("h"))))).alias("s")).select("node", "s.side", "s.h"), "small")
    shared = stored(compact(small.groupBy("side", "h").agg(F.count("*").alias("n")).where("n > 1").drop("n")), "shared")  # stored: the join can split hot keys
    mine = (small.join(merged(shared), ["side", "h"]).groupBy("node")
            .agg(F.collect_list(F.when(F.col("side") == 0, F.col("h"))).alias("a"), F.collect_list(F.when(F.col("side") == 1, F.col("h"))).alias("b"))
            .where((F.size("a") > 0) & (F.size("b") > 0)))
    keys = stored(mine.select("node", "b", F.explode("a").alias("x")).select("node", "x", F.explode("b").alias("y"))
                  .select("node", F.xxhash64("x", "y").alias("key")), "keys")
    return keys, small


def _stars(keys: DataFrame) -> DataFrame:
    centre = stored(compact(keys.groupBy("key").agg(F.min("node").alias("centre"), F.count("*").alias("n")).where("n > 1").select("key", "centre")), "centres")
    return keys.join(merged(centre), "key").where("node <> centre").select("node", "centre").distinct()


def _sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, grams (the sorted shingle hashes as bytes) of the named classes, from the whole text of one member."""
    chosen = docs.select(F.col("doc_id").cast("long").alias("node"), "text").join(merged(nodes), "node")

    def run(batch: pa.RecordBatch):
        for first, n, gram, count in shingle_sets(batch.column(1)):
            raw, end = gram.tobytes(), np.cumsum(count) * 8
            yield pa.record_batch([batch.column(0).slice(first, n),
                                   pa.array([raw[e - c * 8 : e] for e, c in zip(end.tolist(), count.tolist())], type=pa.binary())], ["node", "grams"])

    return stored(map_arrow(chosen, run, "node long, grams binary"), "sets")


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (u, v) whose full sets are similar enough."""

    def run(batch: pa.RecordBatch):
        same = []
        for x, y in zip(batch.column(2), batch.column(3)):
            x, y = np.frombuffer(x.as_buffer(), dtype=U), np.frombuffer(y.as_buffer(), dtype=U)
            both = len(np.intersect1d(x, y, assume_unique=True)) if 4 * min(len(x), len(y)) >= 3 * max(len(x), len(y)) else 0
            same.append(PART * both >= WHOLE * (len(x) + len(y) - both))
        yield pa.record_batch([batch.column(0), batch.column(1)], ["u", "v"]).filter(pa.array(same, type=pa.bool_()))

    left = pairs.join(merged(sets.select(F.col("node").alias("u"), F.col("grams").alias("x"))), "u")
    both = left.join(merged(sets.select(F.col("node").alias("v"), F.col("grams").alias("y"))), "v")
    return map_arrow(both.select("u", "v", "x", "y"), run, "u long, v long")


def links_within(node: np.ndarray, comp: np.ndarray, part: np.ndarray, grams: list[bytes]) -> list[tuple[int, int]]:
    """A spanning forest of the links between different components, of two parts or within the one part given."""
    sets = [np.frombuffer(g, dtype=U) for g in grams]
    size = np.array([len(s) for s in sets])
    flat = np.concatenate(sets) if sets else np.empty(0, dtype=U)
    owner = np.repeat(np.arange(len(sets)), size)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    first = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]]) if len(flat) else np.empty(0, dtype=np.int64)
    ends = np.r_[first[1:], len(flat)]
    root = {int(c): int(c) for c in comp}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    # shingles of one set only count towards no intersection
    multi = ends - first > 1
    common = np.zeros((len(sets), len(sets)), dtype=np.float32)
    spans = list(zip(first[multi].tolist(), ends[multi].tolist()))
    for i in range(0, len(spans), 4096):
        some = spans[i : i + 4096]
        has = np.zeros((len(sets), len(some)), dtype=np.float32)
        for j, (s, e) in enumerate(some):
            has[owner[s:e], j] = 1
        common += has @ has.T
    union = size[:, None] + size[None, :] - common
    near = (PART * common >= WHOLE * union) & (comp[:, None] != comp[None, :])
    if len(np.unique(part)) > 1:
        near &= part[:, None] != part[None, :]
    out = []
    for i, j in zip(*np.nonzero(np.triu(near, 1))):
        x, y = find(int(comp[i])), find(int(comp[j]))
        if x != y:
            root[x] = y
            out.append((int(node[i]), int(node[j])))
    return out


def _between(keys: DataFrame, comps: DataFrame, sets: DataFrame) -> DataFrame:
    """Links between components that share a bucket: blocks of the groups that such buckets connect."""
    mine = keys.join(merged(comps), "node", "left").select("key", "node", F.coalesce("component", "node").alias("comp"))
    open_keys = mine.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key", "lo")
    open_keys = stored(compact(open_keys), "keys")
    rest = stored(compact(mine.join(merged(open_keys), "key").select("node", "comp", F.col("lo").alias("group")).distinct()), "open")
    # groups that share a component are one
    near = rest.select(F.col("comp").alias("u"), F.col("group").alias("v")).distinct()
    whole = components(near)
    members = (rest.select("node", "comp").distinct().join(merged(whole.withColumnRenamed("node", "comp")), "comp", "left")
               .select("node", "comp", F.coalesce("component", "comp").alias("group")))
    members = stored(compact(members), "members")
    # groups of several blocks only, a row for more than BLOCK members: the one side that may be broadcast, if its size allows
    blocks = members.groupBy("group").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).where("blocks > 1")
    placed = members.join(blocks, "group", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("part", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    tasks = placed.select("node", "comp", "group", "part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    tasks = tasks.select("node", "comp", "group", "part", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"))

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        found = links_within(pdf["node"].to_numpy(), pdf["comp"].to_numpy(), pdf["part"].to_numpy(), list(pdf["grams"]))
        return pd.DataFrame(found, columns=["u", "v"], dtype="int64")

    return tasks.join(merged(sets), "node").groupBy("group", "p", "q").applyInPandas(block, "u long, v long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest linked doc_id), kept, class_id (smallest doc_id with the same set)."""
    spark = docs.sparkSession
    drawn = stored(sketches(docs), "sketches")
    classes = stored(drawn.where("n_shingles > 0").groupBy("n_shingles", "d1", "d2").agg(
        F.min_by(F.struct("a", "b"), "doc_id").alias("s"), F.min("doc_id").alias("node")).select("n_shingles", "d1", "d2", "node", "s.a", "s.b"), "classes")
    keys, small = _buckets(classes)
    pairs = stored(compact(_stars(keys)), "pairs")
    nodes = keys.select("node").distinct()
    sets = _sets(docs, nodes)
    release(spark)
    first = stored(_confirmed(pairs.select(F.col("node").alias("u"), F.col("centre").alias("v")), sets), "links")
    comps = components(first)
    more = stored(_between(keys, comps, sets), "links")
    comps = stored(compact(components(first.unionByName(more))), "components")
    discard(small, keys, pairs, sets, first, more)
    release(spark)
    by_class = classes.select("n_shingles", "d1", "d2", "node").join(merged(comps), "node", "left")
    by_class = by_class.select("n_shingles", "d1", "d2", F.col("node").alias("class_id"), F.coalesce("component", "node").alias("component_id"))
    out = drawn.select("doc_id", "n_shingles", "d1", "d2").join(merged(by_class), ["n_shingles", "d1", "d2"], "left")
    own = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", own.alias("component_id"), (F.col("doc_id") == own).alias("kept"), F.coalesce("class_id", "doc_id").alias("class_id"))
