from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptmill.llm import language as L
from scriptmill.llm.common import held_out


def test_forward_backward_equals_enumeration():
    field, rng = L.Field(["a", "b", "c"]), np.random.default_rng(2)
    field.turns, field.first = rng.normal(size=(3, 3)), rng.normal(size=3)
    sizes = [5, 1, 7, 3]
    emit = rng.random((sum(sizes), 3)) + 0.01
    begins = np.zeros(len(emit), bool)
    begins[np.cumsum([0, *sizes[:-1]])] = True
    got, at = field.marginals(emit, begins), 0
    for n in sizes:
        want = np.zeros((n, 3))
        for path in product(range(3), repeat=n):
            w = np.exp(field.first[path[0]]) * emit[at, path[0]]
            for t in range(1, n):
                w *= np.exp(field.turns[path[t - 1], path[t]]) * emit[at + t, path[t]]
            want[np.arange(n), path] += w
        assert np.allclose(got[at:at + n], want / want.sum(1, keepdims=True))
        at += n


@pytest.fixture(scope="module")
def field(spark):
    return L.fit_field(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), lines=2000)


def test_held_out_accuracy(spark, field):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where(held_out(F.col("doc_id")))
    got = L.identify(df, field).join(df, "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert got > 0.97


def test_code_switching_is_labelled_by_word(docs, small, field):
    texts = {r.lang: r.text for r in small("documents").where("length(text) > 300").select("lang", "text").collect()}
    en, de = (" ".join(L.find_words(texts[x])[:25]) for x in ("en", "de"))
    row = L.identify(docs((1, f"{en} {de}")), field, spans=True).first()
    assert [s["lang"] for s in (row.spans[0].asDict(), row.spans[-1].asDict())] == ["en", "de"]
    assert sum(s["words"] for s in row.spans) == 50 and row.spans[0]["words"] > 15


def test_edge_rows(docs, spark, field):
    df = docs((None, "the and of"), (1, None), (1, ""), (2, "123 !? 45"), (3, "x" * 300_000), (4, "der die und " * 40_000),
              (4, "der die und " * 40_000))
    rows = L.identify(df, field).collect()
    by = sorted((str(r.doc_id), r.lang_pred) for r in rows)
    assert by[0] == by[1] == ("1", "und") and by[2] == ("2", "und") and len(rows) == 7
    assert all(0 <= r.score <= 1 for r in rows) and [r.lang_pred for r in rows if r.doc_id == 4] == ["de", "de"]
    assert L.identify(df.where("false"), field).count() == 0
    none = L.fit_field(df.withColumn("lang", F.lit(None).cast("string")))
    assert {(r.lang_pred, r.score) for r in L.identify(df, none).collect()} == {("und", 0.0)}


def test_long_lines_and_words_are_learned_from(spark):
    words = {"aa": "alba mana tara ", "bb": "zilch morx quip ", "cc": "\u6f22\u5b57\u8a9e\u6587"}
    rows = [(i, w * (4 * L.SAMPLE_CHARS // len(w)), lang) for i in range(30) for lang, w in words.items()]
    field = L.fit_field(spark.createDataFrame(rows, "doc_id long, text string, lang string"), lines=200)
    assert field.languages == ["aa", "bb", "cc"]
    asked = spark.createDataFrame([(k, w * 5) for k, w in enumerate(words.values())], "doc_id long, text string")
    assert [r.lang_pred for r in L.identify(asked, field).orderBy("doc_id").collect()] == ["aa", "bb", "cc"]
    assert set(L.features("a" * 50 + "xyz" + "a" * 50, {})) != set(L.features("a" * 103, {}))


def test_new_words_are_scored_a_few_at_a_time(monkeypatch):
    field = L.Field(["a", "b"]).fit([("a", "one two three four"), ("b", "ein zwei drei vier")] * 20)
    texts = [" ".join(f"{w}x" * k for w in ("one", "zwei", "four", "drei")) for k in range(1, 9)]
    want = list(L.Labeller(field).label(texts))
    sizes, plain = [], field.emissions
    monkeypatch.setattr(L, "SCORED_WORDS", 3)
    monkeypatch.setattr(field, "emissions", lambda words: sizes.append(len(words)) or plain(words))
    got = list(L.Labeller(field).label(texts))
    assert sizes and max(sizes) <= 3
    assert all((a == b).all() for a, b in zip(got, want, strict=True))


def test_features_of_many_words_at_once_are_those_of_each():
    words = ["a", "ab", "abc", "straße", "été", "漢字", "\U00010400\U00010401x", "x\ud800y", "", "z" * 70]
    lexicon = {"ab": ("lexicon 0",), "été": ("lexicon 1", "lexicon 3")}
    flat, sizes = L.all_features(words, lexicon)
    assert [p.tolist() for p in np.split(flat, np.cumsum(sizes)[:-1])] == [L.features(w, lexicon) for w in words]
    assert [len(x) for x in L.all_features([], {})] == [0, 0]


def test_words_of_a_chunk_are_held_a_part_at_a_time(monkeypatch):
    field = L.Field(["a", "b"]).fit([("a", "one two three four"), ("b", "ein zwei drei vier")] * 20)
    texts = ["one two zwei", None, "", "drei " * 40, "12", "four ein"] * 5
    want = list(L.Labeller(field).label(texts))
    held, plain = [], L.Labeller._numbers
    monkeypatch.setattr(L, "PART_CHARS", 30)
    monkeypatch.setattr(L, "KEPT_WORDS", 2)
    monkeypatch.setattr(L.Labeller, "_numbers", lambda self, words: held.append(sum(map(len, words))) or plain(self, words))
    got = list(L.Labeller(field).label(texts))
    assert len(held) > 5 and max(held) == 40
    assert all((a is None and b is None) or (a == b).all() for a, b in zip(got, want, strict=True))
