"""Stored distribution: percentiles against a count, block borders, pruning to the blocks of a batch, reload."""
import bisect
import random

from pyspark.sql import functions as F

from cohortlab.operators import ecdf


def _percentiles(stored, spark, values):
    req = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, probability double")
    return {r["id"]: r["percentile"] for r in stored.percentile(req).collect()}


def test_equals_a_count_over_block_borders(spark):
    rng = random.Random(5)
    ref = [round(rng.random(), 2) for _ in range(500)]
    stored = ecdf.store(spark.createDataFrame([(v,) for v in ref] + [(None,)], "score double"), block_values=7)
    assert len(stored.highs) > 10 and stored.total == 500
    ordered = sorted(ref)
    asked = [-1.0, 2.0, 0.5, None, 0.5] + ref[:20] + [v + 0.003 for v in ref[:20]] + list(stored.highs)
    got = _percentiles(stored, spark, asked)
    for i, v in enumerate(asked):
        assert got[i] == (None if v is None else 100.0 * bisect.bisect_right(ordered, v) / 500)
    assert _percentiles(ecdf.load(spark, stored.path), spark, asked) == got


def test_a_batch_reads_its_blocks_only(spark):
    stored = ecdf.store(spark.range(10_000).select((F.col("id") / 10_000).alias("score")), block_values=100)
    assert len(stored.highs) == 100
    out = stored.percentile(spark.createDataFrame([(0.50501,), (0.5052,)], "probability double"))
    plan = out._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(blk" in plan or "PartitionFilters: [blk" in plan
    assert [r["n_at_or_below"] for r in out.orderBy("probability").collect()] == [5051, 5053]
    cells = stored.cells(spark).where("blk IN (50)")
    assert len(cells.inputFiles()) and cells.count() == 100


def test_empty_reference(spark):
    stored = ecdf.store(spark.createDataFrame([], "score double"))
    assert _percentiles(stored, spark, [0.5, None]) == {0: None, 1: None}
