"""Every query of the catalogue gives the rows of its SQL."""

import glob
import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from tidemark.plans import catalog

SF = "/root/testdata/sf0.001"
QUERIES, ORACLE = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


def plain(v):
    return round(v, 9) if isinstance(v, float) else v if isinstance(v, (int, bool, str, type(None))) else str(v)


@pytest.mark.parametrize("name", [n for n in QUERIES if not n.startswith("q_scan_")])
def test_query(spark, db, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    found = db.execute(ORACLE[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = sorted(repr([plain(r[names.index(c)]) for c in columns]) for r in found.fetchall())
    assert sorted(repr([plain(r[c]) for c in columns]) for r in df.collect()) == want


def test_boundary_among_many_instants(spark, tmp_path):
    """The ends of the range are exact where there are more instants than an approximate percentile tells apart."""
    n = 1_000_000
    id_, at = "CAST(range AS BIGINT) AS event_id", f"TIMESTAMP '2024-01-05' + to_microseconds(range * 7919 % {n} * 100003)"
    duckdb.execute(f"COPY (SELECT {id_}, {at} AS ts, 1::BIGINT AS user_id, 'a' AS event_type, 0::DOUBLE AS value, '' AS props FROM range({n})) TO '{tmp_path}/events.parquet'")
    want = duckdb.execute(f"WITH events AS (SELECT * FROM '{tmp_path}/events.parquet') SELECT count(*), min(event_id), sum(event_id), min(ts), max(ts) FROM ({ORACLE['q_range_boundary']})").fetchone()
    found = QUERIES["q_range_boundary"](spark, str(tmp_path)).selectExpr("count(*)", "min(event_id)", "sum(event_id)", "min(ts)", "max(ts)").first()
    assert tuple(found) == want and want[0] == n // 4


def test_at_shares(spark):
    shares = [(1, 4), (1, 2), (1, 1)]
    for values in ([7], [-1, 0, 1], [5] * 9, [-(2**63), 2**63 - 1, 0, -65536, -65537, 65535, 65536], [i * 7919 % 101 - 50 << i % 57 for i in range(400)]):
        want = [sorted(values)[-(-a * len(values) // b) - 1] for a, b in shares]
        assert catalog.at_shares(spark.createDataFrame([(v,) for v in [*values, None]], "v long"), shares) == want
    assert catalog.at_shares(spark.createDataFrame([], "v long"), shares) is None


def test_entry(spark):
    import __spark_entry__

    assert set(ORACLE) == set(QUERIES) and set(QUERIES) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).columns == ["event_id", "user_id"]


ROOT = Path(__file__).resolve().parent.parent


@pytest.mark.parametrize("gone", [(), ("corpus_pipeline.py",)], ids=["folders", "folders and pipeline"])
def test_without_the_training_data_operators(tmp_path, gone):
    """The rest imports and registers its queries once the operators' folders are deleted, with or without the pipeline."""
    for name in ("tidemark", "tests"):
        shutil.copytree(ROOT / name, tmp_path / name, ignore=shutil.ignore_patterns("__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py", "bench.py"):
        if (ROOT / name).exists():
            shutil.copy(ROOT / name, tmp_path)
    for name in ("tidemark/llm", "tests/llm"):
        shutil.rmtree(tmp_path / name, ignore_errors=True)
    for name in gone:
        (tmp_path / name).unlink(missing_ok=True)
    code = "import __spark_entry__ as e, tests.test_catalog as t; assert set(e.queries()) == set(e.oracle_sql()) == set(t.QUERIES), set(e.queries()) ^ set(t.QUERIES)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": ""}, timeout=120)
