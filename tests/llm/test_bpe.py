import random

import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from scriptmill.llm import bpe


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.default_path())


ENCODER = bpe.Encoder(bpe.Vocabulary(bpe.default_path()))


def encode(texts):
    ids, counts = ENCODER.encode(texts)
    ids, out = iter(ids.tolist()), []
    for n in counts:
        out.append([next(ids) for _ in range(n)])
    return out


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aaabehllnooostt'ABZé ñüßİΣς́ \x1c\n!.,123€中🙂ﬁ", max_size=50))
def test_equals_the_library(text):
    assert encode([text]) == [Tokenizer_ids(text)]


def Tokenizer_ids(text, held=[]):  # noqa: B006
    held or held.append(Tokenizer.from_file(bpe.default_path()))
    return held[0].encode(text, add_special_tokens=False).ids


def test_runs_and_special_tokens(library):
    r = random.Random(1)
    texts = ["a" * n for n in range(120)] + ["".join(r.choice("ab") for _ in range(400)), "x" * 5000 + "é" * 500,
             "<|endoftext|>Hi<|startoftext|>", "<|endof", "don't WE'LL 'S", "", None]
    assert encode(texts) == [library.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_queries_digest_and_round_trip(docs, library):
    df = docs((None, "Hello  WORLD"), (1, None), (1, ""), (2, "<|endoftext|> naïve"), (3, "ab " * 50_000), (3, "ab " * 50_000))
    rows = bpe.decode(bpe.encode(df)).collect()
    assert len(rows) == 6 and bpe.round_trip(df).collect() == rows
    for r in rows:
        assert r.decoded == library.decode(list(r.ids), skip_special_tokens=False)
    assert sorted(len(r.ids) for r in rows)[:2] == [0, 0]
    empty = bpe.digests(df.where("doc_id = 1")).first()
    assert empty.n_tokens == 0 and empty.ids_sha256 == empty.decoded_sha256
    assert bpe.digests(df.where("false")).count() == 0


def test_decode_of_odd_lists(spark):
    df = spark.createDataFrame([([0, None, 1],), (None,), ([],), ([-4, 10**8],)], "ids array<int>")
    assert [r.decoded for r in bpe.decode(df).collect()][:1] == ["! \""]
    assert bpe.decode(df).where(F.coalesce("decoded", F.lit("")) == "").count() == 3


def test_small_caches_change_nothing(monkeypatch, small):
    texts = [r.text for r in small("documents").limit(40).collect()]
    want = encode(texts)
    monkeypatch.setattr(bpe, "KEPT_WORDS", 10)
    monkeypatch.setattr(bpe, "KEPT_SIZE", 3)
    assert [encode([t])[0] for t in texts] == want


def test_texts_become_strings_a_chunk_at_a_time(monkeypatch):
    monkeypatch.setattr(bpe, "CHUNK_CHARS", 4)
    assert list(bpe.chunks(pa.array(["ab", None, "éé", "abcdefgh", "a"]))) == [(0, 3), (3, 4), (4, 5)]
    assert list(bpe.chunks(pa.array([], pa.string()))) == []
