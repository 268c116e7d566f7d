"""The catalog's queries against DuckDB at the smallest scale, and the plans that matter."""

import math
import os

import pytest

from porelake.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("SET threads TO 2")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cell = lambda v: None if v is None or isinstance(v, float) and math.isnan(v) else float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v
    return sorted((tuple(cell(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_like_duckdb(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    got = duck.execute(catalog.ORACLE[name])
    columns = [c[0] for c in got.description]
    assert sorted(df.columns) == sorted(columns)
    assert _rows(df.columns, df.collect()) == _rows(columns, got.fetchall())


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_sweep_reads_three_columns_and_crosses_nothing(spark):
    plan = _plan(catalog.threshold_sweep_hist(spark, SF))
    assert "props" not in plan and "CartesianProduct" not in plan


def test_overlap_is_an_equality_join(spark):
    plan = _plan(catalog.strand_merge_overlap(spark, SF))
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_filter_reaches_the_scan(spark):
    assert "PushedFilters: [IsNotNull(l_returnflag)" in _plan(catalog.views.table(spark, SF, "lineitem").filter("l_returnflag = 'R'").select("l_orderkey"))


def test_gate_parses_a_cigar_once(spark):
    plan = catalog.read_quality_filter(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1


@pytest.mark.parametrize(("name", "most"), [("correlation_matrix", 2), ("compare_confidence", 2), ("downsample_curve", 2), ("distance_smoothed", 2), ("roc_auc", 1), ("threshold_sweep_hist", 1), ("high_confidence_ratio", 1)])
def test_few_scans(spark, name, most):
    plan = _plan(catalog.QUERIES[name](spark, SF))
    assert plan.count("FileScan") <= most and "NestedLoop" not in plan


def test_entry_without_the_operators(tmp_path):
    """The other queries are there if the operators' folder isn't, or what it needs can't be imported."""
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(os.path.join(root, "porelake"), tmp_path / "porelake", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(root, "__spark_entry__.py"), tmp_path)
    run = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    env = {**os.environ, "PYTHONPATH": str(tmp_path)}
    got = subprocess.run([sys.executable, "-c", run], cwd=tmp_path, env=env, capture_output=True, text=True, check=True).stdout.split()
    assert got == [str(len(catalog.QUERIES)), str(len(catalog.ORACLE))]


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 101
    assert set(e.oracle_sql()) <= set(e.queries())


def test_argmax_class_where_terms_cancel(spark, tmp_path):
    """Rows whose terms come to 0 lie at one half up to the order of the sum, which must be that of the SQL."""
    import duckdb
    import numpy as np
    import pyarrow as pa
    import pyarrow.parquet as pq

    raw, w = np.random.default_rng(0).integers(-400, 400, (500, 64)), np.arange(57) % 7 - 3
    raw[:, 4] -= raw[:, :57] @ w  # a weight of 1
    path = str(tmp_path / "embeddings.parquet")
    pq.write_table(pa.table({"vec_id": pa.array(range(500), pa.int64()), "embedding": pa.array((raw / 1000).astype(np.float32).tolist(), pa.list_(pa.float32()))}), path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{path}'")
    want = con.execute(catalog.ORACLE["argmax_class"]).fetchall()
    assert {p for _, p in want} == {0, 1}
    assert sorted((r.vec_id, r.predicted) for r in catalog.argmax_class(spark, str(tmp_path)).collect()) == sorted(want)


def test_labels_are_not_broadcast(spark):
    """Only the reference, up to its measured limit, goes through the driver."""
    plan = _plan(catalog.feature_rows(spark, SF))
    assert plan.count("BroadcastExchange") == 1 and plan.count("SortMergeJoin") == 4


def test_training_makes_its_features_once(spark, monkeypatch):
    plans, train = [], catalog.bilstm.train
    monkeypatch.setattr(catalog.bilstm, "train", lambda rows, *a, **kw: plans.append(_plan(rows)) or train(rows, *a, **kw))
    assert catalog.bilstm_training(spark, SF).count() == 2
    assert "FileScan" in plans[0] and "InArrow" not in plans[0] and "Join" not in plans[0]


def test_sam_lines_are_split_once(spark):
    plan = catalog.sam_text_decode(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") <= 2 and plan.count("array_position") == 0  # the line, and its move table
