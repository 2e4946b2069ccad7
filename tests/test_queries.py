"""Every registered query against its DuckDB oracle, and what holds without the training-data operators."""

import datetime
import decimal
import glob
import math
import os
import subprocess
import sys

import duckdb
import pytest
from blockweave.plans import catalog_models, catalog_tables

QUERIES = catalog_tables.QUERIES | catalog_models.QUERIES
ORACLES = catalog_tables.ORACLES | catalog_models.ORACLES
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(x):
    if x is None or isinstance(x, bool | int | str):
        return x
    if isinstance(x, float | decimal.Decimal):
        x = float(x)
        return str(x) if not math.isfinite(x) else float(f"{x:.7g}") + 0.0
    if isinstance(x, list | tuple):
        return tuple(map(plain, x))
    if isinstance(x, dict):
        return tuple(sorted((k, plain(v)) for k, v in x.items()))
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None)
    return x


def ordered(columns, rows):
    at = [columns.index(c) for c in sorted(columns)]
    return sorted((tuple(plain(r[i]) for i in at) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    result = duck.execute(ORACLES[name])
    columns = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(columns)
    assert ordered(df.columns, df.collect()) == ordered(columns, result.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, sf, name):
    df = QUERIES[name](spark, sf)
    assert df.columns and df.collect()


def test_entry_without_training_data_operators(tmp_path):
    for name in ("__spark_entry__.py", "blockweave"):
        os.symlink(f"{ROOT}/{name}", tmp_path / name) if name.endswith(".py") else (tmp_path / name).mkdir()
    for part in os.listdir(f"{ROOT}/blockweave"):
        if part not in ("llm", "__pycache__"):
            os.symlink(f"{ROOT}/blockweave/{part}", tmp_path / "blockweave" / part)
    (tmp_path / "__spark_entry__.py").unlink()
    (tmp_path / "__spark_entry__.py").write_text(open(f"{ROOT}/__spark_entry__.py").read())
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op1_') for k in q) and set(e.oracle_sql()) <= set(q)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True)
