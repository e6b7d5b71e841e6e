"""Connected components of an edge table by alternating large-star and small-star steps.

A step is one partial aggregate and one equi-join, so a node with very many neighbours is never
gathered in one place; the aggregate is stored first, so that the join can split a hot node's edges. Each
step's edges are written to the shared checkpoint folder. Joins never broadcast, so the driver holds no part of the graph.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlab.llm.common import compact, discard, merged, stored


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], row["s"]


def _large_star(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = stored(compact(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))), "least")
    return both.where("v > u").join(merged(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), least


def _small_star(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    least = stored(compact(down.groupBy("u").agg(F.min("v").alias("m"))), "least")
    moved = down.join(merged(least), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), least


def _stepped(star, edges: DataFrame) -> DataFrame:
    out, least = star(edges)
    after = stored(compact(out), "edges")
    discard(edges, least)
    return after


def components(edges: DataFrame) -> DataFrame:
    """(u, v) rows of any orientation -> (node, component) for every node with an edge.

    ``component`` is the smallest node that can be reached. Self loops, repeated rows and an empty
    table are fine; rows with a null end are ignored.
    """
    now = stored(compact(edges.select("u", "v").where("u <> v").distinct()), "edges")
    mark = _mark(now)
    while mark[0]:
        now = _stepped(_small_star, _stepped(_large_star, now))
        seen = _mark(now)
        if seen == mark:
            break
        mark = seen
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots).distinct()
