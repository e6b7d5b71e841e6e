"""The catalogue as the driver uses it: zipped pyspark, foreign working directory, optional subpackage."""
import os
import subprocess
import sys

import pyspark

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
ZIPPED = os.path.join(os.path.dirname(pyspark.__file__), "python", "lib", "pyspark.zip")


def run(code: str, cwd: str, first: str = "") -> str:
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    if first:
        env["PYTHONPATH"] = first
    done = subprocess.run([sys.executable, "-c", f"import sys; sys.path.insert(0, {REPO!r})\n" + code], cwd=cwd, env=env, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-3000:]
    return done.stdout


def test_import_from_zipped_pyspark(tmp_path):
    out = run("import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))", str(tmp_path), ZIPPED if os.path.exists(ZIPPED) else "")
    n, sql = map(int, out.split()[-2:])
    assert n >= 100 and sql >= 85


def test_worker_functions_need_no_path(tmp_path):
    """applyInPandas and mapInPandas of the package run from a foreign folder without PYTHONPATH."""
    run("""
from cohortlab.session import get_session
spark = get_session(master="local[2]", shuffle_partitions=2)
from cohortlab.operators import calibration as ca
cal = spark.range(50).selectExpr("id / 50.0 AS raw_score", "CAST(id % 2 AS int) AS label")
curves = ca.bootstrap_curves(ca.bootstrap_cells(cal, n_bootstrap=4))
assert ca.bootstrap_band(cal, curves).count() == 50
""", str(tmp_path))


def test_entry_works_without_the_optional_subpackage(tmp_path):
    out = run("""
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name == "corpus_pipeline" or name.startswith("cohortlab.llm"):
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
print(len(e.queries()), any(q.startswith("op") for q in e.queries()))
""", str(tmp_path))
    assert out.split()[-1] == "False"
