"""Every query with SQL against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest

from strandloom.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query(spark, duck, name, tmp_path):
    df = registry.QUERIES[name](spark, SF)
    df.write.parquet(f"{tmp_path}/out")
    if name not in registry.SQL:
        return
    columns = ", ".join(f'"{c}"' for c in sorted(df.columns))
    want = f"SELECT {columns} FROM ({registry.SQL[name]})"
    found = f"SELECT {columns} FROM '{tmp_path}/out/*.parquet'"
    assert duck.sql(f"SELECT * FROM ({want}) LIMIT 0").types == duck.sql(f"SELECT * FROM ({found}) LIMIT 0").types
    for a, b in ((want, found), (found, want)):
        assert duck.sql(f"SELECT count(*) FROM ({a} EXCEPT ALL {b})").fetchall() == [(0,)]


def test_entry_without_optional_parts(tmp_path):
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for name in ("__spark_entry__.py", "strandloom"):
        os.symlink(f"{root}/{name}", tmp_path / name)
    os.unlink(tmp_path / "strandloom")
    subprocess.run(["cp", "-r", f"{root}/strandloom", str(tmp_path)], check=True)
    subprocess.run(["rm", "-rf", str(tmp_path / "strandloom" / "llm")], check=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'e2_minimizers' in q and not any(n.startswith('op') for n in q); assert set(e.oracle_sql()) <= set(q)"
    os.unlink(tmp_path / "__spark_entry__.py")
    subprocess.run(["cp", f"{root}/__spark_entry__.py", str(tmp_path)], check=True)
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": ""})
