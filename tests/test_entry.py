import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
DATA = "/root/testdata/sf0.001"


def test_registered_names():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert all(map(callable, entry.queries().values()))


def test_import_without_the_training_data_part(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'knn5' in q and 'pipeline' not in q and not any(x.startswith('op') and x[2].isdigit() for x in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, env=os.environ | {"PYTHONPATH": str(copy)}, timeout=120)


@pytest.mark.skipif(not os.path.exists(DATA), reason="no tables")
def test_queries_run_and_match_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    from quillmere.plans.oracles import ORACLES
    from quillmere.plans.queries import QUERIES

    own = duckdb.connect()
    for name in ("part", "lineitem", "embeddings", "supplier"):
        own.sql(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    for name in ("prep_transform", "knn5", "pca_2col_whiten", "mds_table_map", "outline_size", "onnx_argmax", "knn_graph_distance"):
        got = QUERIES[name](spark, DATA).toPandas()
        want = own.sql(ORACLES[name]).df()
        columns = sorted(got.columns)
        assert columns == sorted(want.columns)
        rows = [sorted(map(tuple, df[columns].round(6).itertuples(index=False)), key=repr) for df in (got, want)]
        assert rows[0] == rows[1], name


@pytest.mark.skipif(not os.path.exists(DATA), reason="no tables")
def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 2500
