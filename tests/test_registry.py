"""Registry: concurrent writers, replays, half-written commits, latest versions."""
import os
from concurrent.futures import ThreadPoolExecutor

import pytest

from cohortlab.sources import registry


def _rows(spark, auc, *models):
    return spark.createDataFrame([(m, auc) for m in models], "model_name string, roc_auc double")


def test_two_writers_and_a_replay(spark, tmp_path):
    path = str(tmp_path / "r")
    with ThreadPoolExecutor(4) as pool:  # two runs, each written twice at once
        list(pool.map(lambda run: registry.commit(_rows(spark, 0.5, "a", "b"), path, run), ["one", "two", "one", "two"]))
    assert registry.commit(_rows(spark, 0.9, "a", "b"), path, "one") is False
    got = sorted((r["model_name"], r["run_id"], r["roc_auc"]) for r in registry.read(spark, path).collect())
    assert got == [("a", "one", 0.5), ("a", "two", 0.5), ("b", "one", 0.5), ("b", "two", 0.5)]


def test_whole_commits_only(spark, tmp_path):
    path = str(tmp_path / "r")
    with pytest.raises(FileNotFoundError):
        registry.read(spark, path)
    _rows(spark, 0.1, "half").write.parquet(f"{path}/staging/0123")  # a writer that died before its rename
    registry.commit(_rows(spark, 0.7, "a"), path, "one")
    os.makedirs(f"{path}/commits/not-a-commit")
    assert [r["model_name"] for r in registry.read(spark, path).collect()] == ["a"]


def test_latest_and_new_columns(spark, tmp_path):
    path = str(tmp_path / "r")
    registry.commit(_rows(spark, 0.7, "a", "b"), path, "one")
    registry.commit(spark.createDataFrame([("a", 0.8, "v2")], "model_name string, roc_auc double, note string"), path, "two")
    got = {r["model_name"]: (r["run_id"], r["roc_auc"], r["note"]) for r in registry.latest(spark, path).collect()}
    assert got == {"a": ("two", 0.8, "v2"), "b": ("one", 0.7, None)}


def test_bad_runs(spark, tmp_path):
    path = str(tmp_path / "r")
    with pytest.raises(ValueError):
        registry.commit(_rows(spark, 0.7, "a"), path, "../x")
    for rows in (_rows(spark, 0.7, "a", "a"), _rows(spark, 0.7, None)):
        with pytest.raises(ValueError):
            registry.commit(rows, path, "one")
    with pytest.raises(FileNotFoundError):
        registry.read(spark, path)
