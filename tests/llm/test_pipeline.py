"""The registered queries against their SQL, and the pipeline's stages."""

import os

import pytest

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables not present")


def _views(folder):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for file in os.listdir(folder):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{folder}/{file}'")
    return con


@pytest.mark.parametrize("name", ["op1_line_dedup", "op4_decontamination", "op7_mixing", "op8_chat", "op11_merkle"])
def test_query_equals_sql(spark, name):
    from tallybrook.llm import registered

    cursor = _views(FOLDER).execute(registered.oracle_sql()[name])
    names = [c[0] for c in cursor.description]
    df = registered.queries()[name](spark, FOLDER)
    assert sorted(df.columns) == sorted(names)
    assert sorted(df.select(*names).collect()) == sorted(cursor.fetchall())


def test_all_are_registered():
    import __spark_entry__ as entry

    names = [n.split("_")[0] for n in entry.queries()]
    assert [sum(n == f"op{k}" for n in names) for k in range(1, 14)] == [1] * 13
    assert "pipeline" in entry.queries()


def test_pipeline_stages(spark):
    """Each stage against what its operator says of its own input."""
    import corpus_pipeline
    from tallybrook.llm import decontamination, lines, quality, simhash
    from tallybrook.llm.store import table, written

    docs = table(spark, FOLDER, "documents")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = written(stage(spark, before, FOLDER), f"test-{name}")
        was, now = {r.doc_id: r for r in before.collect()}, [r for r in docs.collect()]
        assert set(columns) <= set(docs.columns) and {r.doc_id for r in now} <= set(was)
        if name != "mixing":
            assert docs.columns == columns
        if name == "quality_rules":
            assert {r.doc_id for r in now} == {r.doc_id for r in quality.assess(before).filter("kept").collect()}
            assert all(r.text == was[r.doc_id].text for r in now)
        elif name == "line_dedup":
            cut = {r.doc_id: r for r in lines.dedup_lines(before).collect()}
            assert all(r.text == cut[r.doc_id].text for r in now)
            assert all(r.n_chars == len(r.text) for r in now)
            assert all(not r.text.strip() for i, r in cut.items() if i not in {x.doc_id for x in now})
        elif name == "simhash_near_dedup":
            groups = simhash.near_duplicates(before).collect()
            assert {r.doc_id for r in now} == {g.component_id for g in groups}
        elif name == "decontamination":
            report = decontamination.scan(before, table(spark, FOLDER, "benchmark")).filter(decontamination.contaminated())
            assert {r.doc_id for r in now} == set(was) - {r.doc_id for r in report.collect()}
        else:
            assert 0 < len(now) and {r.epoch for r in now} <= {0, 1}
    ran = sorted(r for r in corpus_pipeline.run(spark, FOLDER).collect())
    assert ran == sorted(docs.collect())


def test_pipeline_with_extra_columns_and_no_rows(spark):
    import corpus_pipeline
    from pyspark.sql import functions as F
    from tallybrook.llm.store import table

    docs = table(spark, FOLDER, "documents").withColumns({c: F.lit("x") for c in ("n_words", "_id", "_doc", "kept", "n_lines", "_at")})
    for frame in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            frame = stage(spark, frame, FOLDER)
            assert frame.columns == docs.columns
            frame.count()
        out = corpus_pipeline.STAGES[-1][1](spark, frame, FOLDER)
        out.write.format("noop").mode("overwrite").save()
