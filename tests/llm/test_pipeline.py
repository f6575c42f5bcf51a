import corpus_pipeline as P
from pyspark.sql import functions as F

SMALL = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_clean_documents(spark, small):
    docs = small("documents").withColumn("_cut", F.lit("x"))
    first = docs.count()
    for name, step in P.STAGES[:-1]:
        out = P.stage(step(spark, docs, SMALL), f"test-{name}")
        assert out.dtypes == docs.dtypes and set(r[0] for r in out.select("doc_id").collect()) <= set(
            r[0] for r in docs.select("doc_id").collect())
        docs = out
    assert 0.7 * first < docs.count() < first
    assert P.STAGES[-1][1](spark, docs, SMALL).count() == docs.count()


def test_empty_and_odd_documents(spark, small):
    schema = small("documents").schema
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", None, 0), (2, None, None, "s", None)], schema)
    for docs in (odd, odd.where("false")):
        for name, step in P.STAGES:
            docs = P.stage(step(spark, docs, SMALL), f"test-{name}")
        assert docs.count() == 0


def test_language_shuffles_no_texts(spark, small):
    """Past the size that Spark broadcasts by itself, documents still do not move for the few that go."""
    kept, before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), "spark.sql.autoBroadcastJoinThreshold"
    spark.conf.set(before, "-1")
    try:
        plan = P.identify_language(spark, small("documents"), SMALL)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(before, kept)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "hashpartitioning" not in plan


def test_rows_of_an_id_go_together(spark, small):
    """An id goes only if none of its rows has a language; null ids always go."""
    docs = small("documents").limit(60).cache()
    text = docs.where("lang is not null").orderBy(F.length("text").desc()).first().text
    odd = spark.createDataFrame([(-1, text), (-1, "12 34"), (-2, "12 34"), (-2, None), (None, text)], "doc_id long, text string")
    rows = docs.unionByName(odd, allowMissingColumns=True)
    out = P.identify_language(spark, rows, SMALL).where("doc_id < 0 or doc_id is null").select("doc_id", "text")
    assert sorted(map(tuple, out.collect())) == sorted([(-1, text), (-1, "12 34")])


def test_stages_leave_only_what_their_results_read(spark, small, monkeypatch):
    import os
    from scriptmill import session
    made = []
    monkeypatch.setattr(session, "new_path", lambda *a, f=session.new_path: made.append(f(*a)) or made[-1])
    docs = small("documents")
    for name, step in P.STAGES:
        made.clear()
        out = step(spark, docs, SMALL)
        left = {p for p in made if os.path.exists(p)}
        assert left <= {p for p in made if any(p in f for f in out.inputFiles())} and len(left) <= 1
        docs = P.stage(out, f"test-{name}")


def test_queries_are_registered():
    import __spark_entry__ as e
    names = e.queries()
    assert "pipeline" in names and [n for n in range(1, 11) if not any(k.startswith(f"op{n}_") for k in names)] == []
