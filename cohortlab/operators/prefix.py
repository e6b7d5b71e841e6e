"""Distributed ordered scans: running sums, ranks and exact quantiles.

A plain ``sum() over (order by x)`` window without a partition key runs in one
task. Here the ordered domain is cut into value blocks at approximate quantiles
(one small sketch per group), each block is scanned by its own window, and the
exclusive offset of every block (a table with one row per block) is added back.
Block membership depends only on the value, so ties always share a block and the
result does not depend on physical partitioning or task retries.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlab.session import materialize


def default_blocks(spark) -> int:
    return max(8, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))


def blocks_below(bounds: Column, value: Column, n: int) -> Column:
    """How many of the n sorted bounds lie below the value, by binary search."""
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(max(1, n.bit_length())))])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(
        (at + step <= F.size(bounds)) & (F.get(bounds, at + step - 1) < value), at + step).otherwise(at))


def running_sums(df: DataFrame, order_col: str, sum_cols: list[str], group_cols: list[str] | None = None,
                 descending: bool = False, tie_cols: list[str] | None = None, n_blocks: int | None = None,
                 prefix: str = "cum_") -> DataFrame:
    """Add inclusive running sums ``cum_<c>`` of ``sum_cols`` in ``order_col`` order.

    Rows with equal ``order_col`` are ordered by ``tie_cols`` (if given); running
    sums restart per ``group_cols``.
    """
    group_cols = list(group_cols or [])
    tie_cols = list(tie_cols or [])
    n_blocks = n_blocks or default_blocks(df.sparkSession)
    o = F.col(order_col).cast("double")
    work = df.withColumn("_o", -o if descending else o)
    fracs = [i / n_blocks for i in range(1, n_blocks)]
    sketch = (work.groupBy(*group_cols).agg(
        F.percentile_approx("_o", F.array(*[F.lit(f) for f in fracs]), 10000).alias("_bounds"))
        if group_cols else
        work.agg(F.percentile_approx("_o", F.array(*[F.lit(f) for f in fracs]), 10000).alias("_bounds")))
    # ungrouped: one row; grouped: one row per group, whose size Spark checks before broadcasting
    work = work.join(sketch, group_cols, "left") if group_cols else work.crossJoin(F.broadcast(sketch))
    work = work.withColumn("_blk", blocks_below(F.col("_bounds"), F.col("_o"), n_blocks - 1)).drop("_bounds")
    totals = work.groupBy(*group_cols, "_blk").agg(*[F.sum(c).alias(f"_t_{c}") for c in sum_cols])
    wo = Window.partitionBy(*group_cols).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*group_cols, "_blk", *[
        F.coalesce(F.sum(f"_t_{c}").over(wo), F.lit(0)).alias(f"_off_{c}") for c in sum_cols])
    work = work.join(offsets, group_cols + ["_blk"], "inner")
    wr = (Window.partitionBy(*group_cols, "_blk").orderBy("_o", *tie_cols)
          .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    for c in sum_cols:
        work = work.withColumn(f"{prefix}{c}", F.sum(c).over(wr) + F.col(f"_off_{c}"))
    return work.drop("_o", "_blk", *[f"_off_{c}" for c in sum_cols])


def ranks(df: DataFrame, order_col: str, group_cols: list[str] | None = None,
          tie_cols: list[str] | None = None, n_blocks: int | None = None) -> DataFrame:
    """1-based row rank within ``group_cols`` by (order_col, tie_cols); adds ``rank``."""
    out = running_sums(df.withColumn("_one", F.lit(1)), order_col, ["_one"], group_cols,
                       tie_cols=tie_cols, n_blocks=n_blocks)
    return out.withColumnRenamed("cum__one", "rank").drop("_one")


def exact_quantiles(df: DataFrame, value_col: str, qs: list[float], group_cols: list[str] | None = None,
                    n_blocks: int | None = None) -> DataFrame:
    """Exact linear-interpolation quantiles (position (n-1)q) per group.

    Values are compressed to (value, count) cells, ranks come from ``running_sums``,
    and the two order statistics around each position are picked by a range join
    against a table of (#groups x #qs) targets. Output: (group..., q, value).
    """
    group_cols = list(group_cols or [])
    cells = (df.where(F.col(value_col).isNotNull())
               .groupBy(*group_cols, F.col(value_col).cast("double").alias("v"))
               .agg(F.count(F.lit(1)).alias("cnt")))
    cells = materialize(cells, "quantile-cells")  # scanned by the sketch, the scan and the totals
    cum = running_sums(cells, "v", ["cnt"], group_cols, n_blocks=n_blocks)
    cum = cum.select(*group_cols, "v", (F.col("cum_cnt") - F.col("cnt")).alias("lo_rank"),
                     F.col("cum_cnt").alias("hi_rank"))
    tot = cells.groupBy(*group_cols).agg(F.sum("cnt").alias("n"))
    qdf = df.sparkSession.createDataFrame([(float(q), i) for i, q in enumerate(qs)], "q double, q_idx int")
    targets = (tot.crossJoin(F.broadcast(qdf))
                  .withColumn("pos", (F.col("n") - 1).cast("double") * F.col("q"))
                  .withColumn("lo_pos", F.floor("pos")).withColumn("hi_pos", F.ceil("pos")))
    # targets is tiny (groups x qs); each range condition picks exactly one cell
    tg = targets.select(*[F.col(g).alias(f"_t_{g}") for g in group_cols], "q", "q_idx", "pos", "lo_pos", "hi_pos")
    lo = cum.select(*[F.col(g).alias(f"_l_{g}") for g in group_cols], F.col("v").alias("lo_v"),
                    F.col("lo_rank").alias("a1"), F.col("hi_rank").alias("b1"))
    cond_lo = [F.col(f"_l_{g}") == F.col(f"_t_{g}") for g in group_cols] + [
        F.col("lo_pos") >= F.col("a1"), F.col("lo_pos") < F.col("b1")]
    j = lo.join(F.broadcast(tg), cond_lo, "inner").select(
        *[f"_t_{g}" for g in group_cols], "q", "q_idx", "pos", "lo_pos", "hi_pos", "lo_v")
    hi = cum.select(*[F.col(g).alias(f"_h_{g}") for g in group_cols], F.col("v").alias("hi_v"),
                    F.col("lo_rank").alias("a2"), F.col("hi_rank").alias("b2"))
    cond_hi = [F.col(f"_h_{g}") == F.col(f"_t_{g}") for g in group_cols] + [
        F.col("hi_pos") >= F.col("a2"), F.col("hi_pos") < F.col("b2")]
    k = hi.join(F.broadcast(j), cond_hi, "inner").select(
        *[F.col(f"_t_{g}").alias(g) for g in group_cols], "q", "q_idx", "pos", "lo_pos", "lo_v", "hi_v")
    frac = F.col("pos") - F.col("lo_pos")
    return k.select(*group_cols, "q", "q_idx",
                    (F.col("lo_v") + (F.col("hi_v") - F.col("lo_v")) * frac).alias("value"))


def exact_quantile_sql(source: str, value_expr: str, qs: list[float], out_q: str = "q") -> str:
    """The same computation as ``exact_quantiles`` (ungrouped) in DuckDB SQL."""
    qvals = ", ".join(f"({repr(float(q))}, {i})" for i, q in enumerate(qs))
    return f"""(SELECT q.q AS {out_q}, q.q_idx, lv.v + (hv.v - lv.v) * (q.pos - floor(q.pos)) AS value
   FROM (SELECT t.q, t.q_idx, CAST(n - 1 AS DOUBLE) * t.q AS pos
         FROM (SELECT count(*) AS n FROM {source} WHERE {value_expr} IS NOT NULL) tot,
              (VALUES {qvals}) t(q, q_idx)) q
   JOIN (SELECT v, sum(cnt) OVER (ORDER BY v) - cnt AS a, sum(cnt) OVER (ORDER BY v) AS b
         FROM (SELECT CAST({value_expr} AS DOUBLE) AS v, count(*) AS cnt FROM {source}
               WHERE {value_expr} IS NOT NULL GROUP BY 1) c) lv ON floor(q.pos) >= lv.a AND floor(q.pos) < lv.b
   JOIN (SELECT v, sum(cnt) OVER (ORDER BY v) - cnt AS a, sum(cnt) OVER (ORDER BY v) AS b
         FROM (SELECT CAST({value_expr} AS DOUBLE) AS v, count(*) AS cnt FROM {source}
               WHERE {value_expr} IS NOT NULL GROUP BY 1) c) hv ON ceil(q.pos) >= hv.a AND ceil(q.pos) < hv.b)"""


def fold_hash(key: Column, seed: int = 42) -> Column:
    """Keyed integer hash in [0, 2^32): Fibonacci multiplicative hashing, no overflow.

    Written with integer arithmetic only, so any SQL engine computes the same value.
    """
    return F.pmod(F.pmod(key.cast("bigint") + F.lit(seed), F.lit(4294967291)) * F.lit(1640531527),
                  F.lit(4294967296))


def fold_hash_sql(key: str, seed: int = 42) -> str:
    return f"((((CAST({key} AS BIGINT) + {seed}) % 4294967291) * 1640531527) % 4294967296)"
