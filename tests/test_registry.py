"""Registered queries against DuckDB on the smallest driver tables, and the entry point without the deletable parts."""

import os
import subprocess
import sys

import pytest

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")
def test_queries_match_sql(spark):
    import duckdb

    from lookbook.plans import registry

    db = duckdb.connect()
    for name in ("documents", "labels", "pages", "embeddings", "part", "supplier"):
        db.execute(f"create view {name} as select * from read_parquet('{SF}/{name}.parquet')")
    for name, sql in registry.oracle_sql().items():
        got = registry.queries()[name](spark, SF)
        cols = sorted(got.columns)
        have = sorted(repr(tuple(r[c] for c in cols)) for r in got.collect())
        want = sorted(map(repr, db.execute(f"select {', '.join(f'x.\"{c}\"' for c in cols)} from ({sql}) x").fetchall()))
        assert have == want, name


def test_entry_works_without_the_subpackage(tmp_path):
    for name in ("lookbook", "__spark_entry__.py"):
        os.symlink(f"{ROOT}/{name}", tmp_path / name) if name.endswith(".py") else _copy_without_llm(tmp_path)
    code = "import __spark_entry__ as e; n = e.queries(); assert n and not any(k.startswith('op') for k in n) and 'pipeline' not in n; e.oracle_sql()"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})


def _copy_without_llm(to):
    import shutil

    shutil.copytree(f"{ROOT}/lookbook", to / "lookbook", ignore=shutil.ignore_patterns("llm", "__pycache__"))


def test_searches_are_registered_over_the_whole_range(spark, monkeypatch):
    import inspect

    from lookbook.operators import cluster, search
    from lookbook.plans import registry, workloads

    seen, out = {}, spark.range(1).selectExpr("id key", "0 cluster", "0 best_k")
    for module, name in ((search, "grid_search"), (cluster, "search_kmeans"), (workloads, "configuration_search"), (workloads, "families")):
        shape = inspect.signature(getattr(module, name))

        def stub(*a, name=name, shape=shape, **b):
            given = shape.bind(*a, **b)
            given.apply_defaults()
            seen[name] = given.arguments
            return out if name == "families" else (out, out)

        monkeypatch.setattr(module, name, stub)
    for query in ("grid_search", "kmeans_search", "random_search", "families"):
        registry.queries()[query](spark, SF)
    assert list(seen["grid_search"]["ks"]) == list(range(2, 21)) and seen["grid_search"]["min_sizes"] == (5, 10, 20, 30)
    assert list(seen["search_kmeans"]["ks"]) == list(range(2, 12)) and seen["configuration_search"]["trials"] == 50
    assert list(seen["families"]["ks"]) == list(range(3, 21))


def test_a_failed_job_fails_the_search(spark, monkeypatch):
    from lookbook.operators import search

    def fails(error):
        def sets(*_):
            raise error

        monkeypatch.setattr(search, "_label_sets", sets)
        return search._trial_scores(None, [{}, {}], 1)

    assert fails(ValueError("no such linkage")) == [-1e9, -1e9]
    with pytest.raises(RuntimeError):
        fails(RuntimeError("executor lost"))
