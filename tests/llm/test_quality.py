import pytest
from pyspark.sql import functions as F

from scriptmill.llm import quality as Q


def test_tree_rules():
    text = """Model
  Tree 0 (weight 1.0):
    If (feature 2 <= 0.5)
     If (feature 1 <= 3.0)
      Predict: 0.0
     Else (feature 1 > 3.0)
      Predict: 1.0
    Else (feature 2 > 0.5)
     Predict: 0.0
  Tree 1 (weight 1.0):
    Predict: 1.0
"""
    assert Q.tree_rules(text) == {((2, False, 0.5),), ((2, True, 0.5),), ((1, False, 3.0), (2, False, 0.5)),
                                  ((1, True, 3.0), (2, False, 0.5))}


@pytest.fixture(scope="module")
def scored(spark, small):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    return Q.score_quality(docs, labels).join(labels, "doc_id").cache(), labels


def test_held_out_accuracy(scored):
    right, rows = scored[0].where("held_out").agg(F.sum((F.col("predicted") == F.col("quality")).cast("int")),
                                                  F.count("*")).first()
    assert rows > 50 and right / rows > 0.95


def test_edge_rows(docs, scored):
    df = docs((None, "a b c"), (1, None), (1, ""), (2, " "), (3, "word " * 50_000))
    rows = Q.score_quality(df, scored[1]).collect()
    assert len(rows) == 5 and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out for r in rows if r.doc_id is None)
    assert Q.score_quality(df.where("false"), scored[1]).count() == 0


def test_labels_of_no_use(docs, spark):
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, None), (None, 0), (3, 7)], "doc_id long, quality int")
    df = docs((1, "a"), (4, "b"))
    assert {r.predicted for r in Q.score_quality(df, labels).collect()} == {1}
    assert {r.score for r in Q.score_quality(df, labels.where("false")).collect()} == {0.5}
