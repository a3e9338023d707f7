"""Driver contract: entry smoke check, registry consistency and Spark-vs-DuckDB
parity of every registered query that has an oracle (at sf0.001 here; the
same check runs at sf0.01 with ``python tests/oracle_check.py``)."""

import pytest

import os, sys
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import __spark_entry__ as E  # noqa: E402
from conftest import SF_SMALL
from oracle_check import check


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns == ["category", "product_count", "avg_price", "min_price", "max_price", "price_stddev",
                          "organic_count", "store_brand_count"]


def test_registry_keys():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 100
    import re
    from larder.plans.registry import all_queries
    own = all_queries()
    assert not [k for k in own if k == "pipeline" or re.match(r"op\d+_", k)]
    assert set(own) <= set(q)


def test_entry_works_without_the_optional_parts(monkeypatch):
    import sys

    class Blocked:
        def find_spec(self, name, path=None, target=None):
            if name == "corpus_pipeline" or name.startswith("larder.llm"):
                raise ModuleNotFoundError(f"No module named {name!r}", name=name)
    for m in [m for m in sys.modules if m == "corpus_pipeline" or m.startswith("larder.llm")]:
        monkeypatch.delitem(sys.modules, m)
    monkeypatch.setattr(sys, "meta_path", [Blocked(), *sys.meta_path])
    import re
    assert len(E.queries()) >= 100 and set(E.oracle_sql()) <= set(E.queries())
    assert not [k for k in E.queries() if k == "pipeline" or re.match(r"op\d+_", k)]


ORACLE_NAMES = sorted(E.oracle_sql())


@pytest.mark.parametrize("name", ORACLE_NAMES)
def test_oracle_parity(spark, name):
    res = check(spark, SF_SMALL, [name], verbose=False)[name]
    assert res.startswith("PASS"), res


def test_queries_run_from_another_folder(tmp_path):
    """A script elsewhere that only extends its own sys.path: the workers get the package from the entry."""
    import os
    import subprocess
    import sys
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    script = tmp_path / "elsewhere.py"
    script.write_text(f"""
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
import __spark_entry__ as entry
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").getOrCreate()
print("ROWS", entry.queries()["vector_top_k"](spark, "/root/testdata/sf0.001").count())
print("ROWS", len(entry.queries()["vector_top_k"](spark, "/root/testdata/sf0.001").collect()))
""")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert done.stdout.count("ROWS") == 2
