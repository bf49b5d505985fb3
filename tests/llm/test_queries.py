"""The registered queries on the smallest driver tables."""

import os

import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")


def test_queries_match_sql(spark):
    import duckdb

    from lookbook.llm import queries as q

    db = duckdb.connect()
    for name in ("documents", "benchmark", "pages", "conversations"):
        db.execute(f"create view {name} as select * from read_parquet('{SF}/{name}.parquet')")
    for name, sql in q.oracle_sql().items():
        got = q.queries()[name](spark, SF)
        cols = sorted(got.columns)
        have = sorted(map(repr, (tuple(r[c] for c in cols) for r in got.collect())))
        cur = db.execute(f"select {', '.join(f'x.\"{c}\"' for c in cols)} from ({sql}) x")
        assert have == sorted(map(repr, cur.fetchall())), name


def test_pipeline_keeps_its_stages(spark):
    import corpus_pipeline
    from lookbook.llm import queries as q

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "simhash_dedup", "decontaminate", "personal_data", "mixture"]
    sizes = [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), out.schema)
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0
    assert q.queries()["pipeline"](spark, SF).count() == sizes[-1]


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_take_odd_tables(spark):
    import corpus_pipeline
    from pyspark.sql import functions as F

    prose = "The cat sat on the mat and looked at {} birds that flew over the old house near a river. It was a fine day for all of them."
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").where("length(text) > 100").head()["text"]
    rows = [(i, prose.format(i) + f" Then {i} more came by, and {i * 7} left again for the woods.", "en", "a", 1) for i in range(30)]
    rows += [(1, rows[1][1], "en", "a", 1), (None, rows[2][1], "en", None, None), (None, None, None, None, None), (40, "", "en", "b", 0), (41, bench, "en", "b", 5), (42, rows[3][1] + " Mail joe@mail.com now.", "en", "c", 1), (43, "long words in a row. " * 20_000, "en", "c", 1)]
    docs = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("x") for c in ("row", "s", "mark", "key", "rid", "item", "w", "_spans", "kept", "n_words")}).withColumn("void", F.lit(None))
    for empty in (True, False):
        for name, stage in corpus_pipeline.STAGES:
            given = docs.limit(0) if empty else docs
            out = stage(spark, given, SF)
            assert out.columns[: len(docs.columns)] == docs.columns or name == "mixture", name
            got = out.collect()
            assert not got if empty else got, name
    by = {name: stage(spark, docs, SF).collect() for name, stage in corpus_pipeline.STAGES}
    assert {r["doc_id"] for r in by["quality_rules"]} <= set(range(30)) | {None, 42, 41} and not any(r["text"] in (None, "") for r in by["quality_rules"])
    assert sum(r["doc_id"] == 1 for r in by["simhash_dedup"]) == 1
    assert 41 not in {r["doc_id"] for r in by["decontaminate"]} and len(by["decontaminate"]) == len(rows) - 1
    assert next(r["text"] for r in by["personal_data"] if r["doc_id"] == 42).endswith("Mail <EMAIL> now.") and len(by["personal_data"]) == len(rows)
    assert len(by["mixture"]) == len(rows) and all(r["taken"] <= 3 * r["size"] for r in by["mixture"])


def test_plans_that_the_driver_holds_stay_small(spark, capsys):
    """The driver keeps and prints each plan again and again, so a plan names a step once."""
    from pyspark.sql import functions as F

    from lookbook.llm import mixture, personal_data

    def size(df):
        capsys.readouterr()
        df.explain("extended")
        return len(capsys.readouterr().out)

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert size(personal_data.with_candidates(docs, F.col("text"))) < 150_000
    assert size(mixture.mixed_documents(docs)) < 20_000
    points = spark.range(4096).select("id", mixture.radical_inverse(F.col("id"), 40).alias("point"))
    assert size(points) < 2_000
    assert all(r["point"] == int(f"{r['id']:040b}"[::-1], 2) for r in points.collect())


def test_pipeline_of_empty_tables(spark, tmp_path):
    import corpus_pipeline

    for name in ("documents", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.collect() == [] and {"doc_id", "text", "size", "source_size", "target", "taken"} <= set(out.columns)
