import hashlib
import random

import pytest
import sentencepiece
from hypothesis import example, given, settings, strategies as st

from scriptmill.llm import pieces

LIBRARY = sentencepiece.SentencePieceProcessor(model_file=pieces.default_path())
VOCABULARY = pieces.Vocabulary(pieces.default_path())
ENCODER, DECODER = pieces.Encoder(VOCABULARY), pieces.Decoder(VOCABULARY)


def encode(texts):
    ids, counts = ENCODER.encode(texts)
    ids = iter(ids.tolist())
    return [[next(ids) for _ in range(n)] for n in counts]


def library(texts):
    return [LIBRARY.encode(t or "", add_eos=True) for t in texts]


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="aaabehllnooosttt   'ABZé ñüßİΣς́ \x00\x1c\n\t!.,129中🙂ﬁ▁<>/s", max_size=60))
@example("\0a\0\0b \0")
def test_equals_the_library(text):
    assert encode([text]) == library([text])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(sorted(VOCABULARY.ids)), max_size=12))
def test_borders_of_all_kinds_of_tokens(tokens):
    text = "".join(tokens)
    assert encode([text]) == library([text])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 400) | st.integers(0, 31_999), max_size=30))
def test_decodes_any_ids(ids):
    assert DECODER.text(ids) == LIBRARY.decode(ids)


def test_long_runs_and_random_letters():
    r = random.Random(1)
    texts = [" " * n + "the" for n in range(70)] + ["a" * n for n in range(120)]
    texts += ["".join(r.choice(some) for _ in range(3000)) for some in ("ab", "etaoin", "etaoin  ", "abc的一\n")]
    texts += ["x" * 5000 + "é" * 500, "</s> <s><0x0A>", "", None]
    assert encode(texts) == library(texts)


def test_small_caches_change_nothing(monkeypatch, small):
    texts = [r.text for r in small("documents").collect()]
    want = library(texts)
    assert encode(texts) == want
    monkeypatch.setattr(pieces, "KEPT_WORDS", 10)
    monkeypatch.setattr(pieces, "KEPT_SIZE", 3)
    assert [encode([t])[0] for t in texts[:40]] == want[:40]


def test_digests_and_round_trip(docs):
    long = "A  long, long téxt\n" * 20_000
    df = docs((None, "Hello  WORLD"), (1, None), (1, ""), (2, " </s> naïve 😀"), (3, long), (3, long))
    coded = pieces.decode(pieces.encode(df)).collect()
    assert [r.decoded for r in coded] == ["Hello  WORLD", "", "", " </s> naïve 😀", long, long]
    assert pieces.round_trip(df).collect() == coded
    rows = {r.doc_id: r for r in pieces.digests(df).collect()}
    for i, text in ((None, "Hello  WORLD"), (1, ""), (3, long)):
        ids = LIBRARY.encode(text, add_eos=True)
        assert rows[i].n_tokens == len(ids)
        assert rows[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert rows[i].decoded_sha256 == hashlib.sha256(LIBRARY.decode(ids).encode()).hexdigest()
    assert pieces.digests(df.where("false")).count() == 0


def test_odd_lists_of_ids(spark):
    df = spark.createDataFrame([([259, None, 264],), (None,), ([],), ([-4, 10**8, 2],)], "ids array<int>")
    assert [r.decoded for r in pieces.decode(df).collect()] == ["  a", "", "", ""]


def test_other_models_are_refused(tmp_path):
    (tmp_path / "m").write_bytes(b"\x12\x02\x18\x01")
    with pytest.raises(ValueError, match="not a BPE model"):
        pieces.Vocabulary(str(tmp_path / "m"))
