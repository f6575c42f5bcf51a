"""BPE by prefix-sharing trie traversal, and decoding.

Distinct words are put in order, which is a depth-first walk of their trie; every node on the way gets the last token
of the encoding of its prefix. That token t, of length n, is the one whose pair with the last token of the prefix n symbols shorter
survives all merges, so the encoding of a prefix that many words share is found once, from two states.
"""

import functools
import json
import unicodedata
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F

from scriptmill.llm.common import table

TOKENIZER = "word_bpe_49k.json"
#: a beginning of tokens that is none itself
NO_TOKEN = -1
#: a worker forgets its encoded words when it holds so many (some 60 MB), and never keeps longer ones
KEPT_WORDS, KEPT_SIZE = 300_000, 32
#: pairs of tokens that a worker remembers (some 20 MB)
KEPT_PAIRS = 1 << 17
#: characters that a worker splits into words at a time, whole texts at least
CHUNK_CHARS = 1 << 18


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def byte_signs() -> dict[int, str]:
    """The printable sign that stands for each byte: printable Latin-1 for itself, others from U+0100 on."""
    plain = {b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b}
    others = iter(range(256, 512))
    return {b: chr(b if b in plain else next(others)) for b in range(256)}


class Vocabulary:
    """A tokenizer file with word ends: lower case NFC text, byte signs, merges by rank."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        model = told["model"]
        kinds = [n["type"] for n in told["normalizer"]["normalizers"]]
        split, byte_level = told["pre_tokenizer"]["pretokenizers"]
        if (kinds != ["NFC", "Replace", "Lowercase"] or model["type"] != "BPE" or not model["end_of_word_suffix"]
                or not split["invert"] or byte_level["type"] != "ByteLevel" or told["decoder"] is not None):
            raise ValueError(f"{path}: not a lower-case BPE with word ends")
        self.end = model["end_of_word_suffix"]
        # the library's \s are the White_Space characters
        self.pattern = split["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}")
        self.ids = model["vocab"]
        self.special = {t["content"]: t["id"] for t in told["added_tokens"]}
        self.tokens = [""] * (max([*self.ids.values(), *self.special.values()]) + 1)
        for token, i in [*self.ids.items(), *self.special.items()]:
            self.tokens[i] = token
        self.ranks, self.halves = {}, {}
        for rank, merge in enumerate(model["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            pair, whole = (self.ids[a], self.ids[b]), self.ids[a + b]
            self.ranks[pair] = rank
            self.halves.setdefault(whole, (rank, *pair))


class Encoder:
    """Encodes texts of one worker. Words seen before are looked up."""

    def __init__(self, vocabulary: Vocabulary):
        self.v, self.kept = vocabulary, {}
        self.signs = byte_signs()
        self.find = regex.compile(vocabulary.pattern).findall
        self.marks = regex.compile("|".join(map(regex.escape, sorted(
            vocabulary.special, key=len, reverse=True)))) if vocabulary.special else None
        # tokens that words can be made of, by their signs: inside a word, with all their beginnings, and at its end
        self.inside, self.last = {}, {}
        for token, i in vocabulary.ids.items():
            ends = token.endswith(vocabulary.end)
            body = token[:-len(vocabulary.end)] if ends else token
            if body and (len(body) == 1 or i in vocabulary.halves):
                for n in range(1, len(body) + 1):
                    self.inside.setdefault(body[:n], NO_TOKEN)
                (self.last if ends else self.inside)[body] = i
        self.fits = functools.lru_cache(KEPT_PAIRS)(self._fits)
        self.spine = functools.lru_cache(None)(self._spine)

    def _spine(self, token: int, side: int) -> list[tuple[int, float]]:
        """The tokens at one edge of `token` while it is merged, with the rank of the merge that ends each."""
        out, ends = [(token, float("inf"))], 0.0
        while token in self.v.halves:
            ends, *halves = self.v.halves[token]
            token = halves[side]
            out.append((token, ends))
        return out

    def _fits(self, left: int, right: int) -> bool:
        """Whether no merge ever crosses the border between two neighbouring tokens. Of equal ranks the left merges first."""
        ranks = self.v.ranks
        for a, a_ends in self.spine(left, 1):
            for b, b_ends in self.spine(right, 0):
                rank = ranks.get((a, b))
                if rank is not None and rank < a_ends and rank <= b_ends:
                    return False
        return True

    def learn(self, words: Iterable[str]) -> dict[str, bytes]:
        """The ids of distinct words as little-endian 32-bit numbers.

        `states` holds, for each prefix of the word at hand, the token that ends its encoding, that token's length, and how
        many signs at the prefix's end begin some token. A word shares the states of the prefix that the word before has too.
        """
        sign, last = self.signs.__getitem__, self._last
        found, states, before = {}, [(NO_TOKEN, 0, 0)], ""
        for signs, word in sorted(("".join(map(sign, word.encode())), word) for word in words):
            shared, most = 0, min(len(states) - 1, len(signs) - 1)
            while shared < most and signs[shared] == before[shared]:
                shared += 1
            del states[shared + 1:]
            for depth in range(shared + 1, len(signs)):
                states.append(last(signs, depth, states, self.inside))
            before, at, ids = signs, len(signs), []
            token, n, _ = last(signs, at, states, self.last)
            while True:
                ids.append(token)
                at -= n
                if not at:
                    break
                token, n, _ = states[at]
            found[word] = array("i", ids[::-1]).tobytes()
        return found

    def _last(self, signs: str, depth: int, states: list, tokens: dict[str, int]) -> tuple[int, int, int]:
        """The state of the first `depth` signs. Exactly one of `tokens` fits."""
        reach, fits = 0, self.fits
        for n in range(states[depth - 1][2] + 1, 0, -1):
            token = tokens.get(signs[depth - n:depth])
            if token is not None:
                reach = reach or n
                if token != NO_TOKEN and (n == depth or fits(states[depth - n][0], token)):
                    return token, n, reach
        raise ValueError(f"no token ends {signs[:depth][-40:]!r}")

    def words(self, text: str) -> list[str]:
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()  # no final sigma, as in the library
        return self.find(text)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each)."""
        pieces = []
        for text in texts:
            text = text or ""
            marks = list(self.marks.finditer(text)) if self.marks and "<" in text else []
            at, own = 0, []
            for m in marks:
                own += [*self.words(text[at:m.start()]), self.v.special[m[0]]]
                at = m.end()
            pieces.append(own + self.words(text[at:] if at else text))
        kept = self.kept
        if len(kept) > KEPT_WORDS:
            kept.clear()
        new = {w for own in pieces for w in own if w not in kept}
        special = {w for w in new if isinstance(w, int)}
        known = self.learn(new - special) | {i: array("i", [i]).tobytes() for i in special}
        if any(isinstance(w, str) and len(w) > KEPT_SIZE for w in known):
            kept.update((w, b) for w, b in known.items() if isinstance(w, int) or len(w) <= KEPT_SIZE)
            coded = [b"".join([kept[w] if w in kept else known[w] for w in own]) for own in pieces]
        else:
            kept.update(known)
            coded = [b"".join([kept[w] for w in own]) for own in pieces]
        return np.frombuffer(b"".join(coded), "<i4"), np.array([len(b) // 4 for b in coded], np.int64)


def chunks(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Spans of whole texts of about CHUNK_CHARS."""
    start = size = 0
    for i, own in enumerate(pc.fill_null(pc.utf8_length(texts), 0).to_pylist()):
        size += own
        if size >= CHUNK_CHARS:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def _texts(lists: pa.Array, tokens: pa.Array) -> pa.Array:
    """The tokens of each list of ids, joined by one space; null lists give nothing, as do null and unknown ids."""
    flat = lists.flatten()
    known = pc.if_else(pc.and_(pc.greater_equal(flat, 0), pc.less(flat, len(tokens))), flat, None)
    strings = tokens.take(known)
    counts = pc.fill_null(pc.list_value_length(lists), 0)
    offsets = np.concatenate([[0], np.cumsum(counts.to_numpy(zero_copy_only=False))]).astype(np.int64)
    if strings.null_count:
        kept = strings.is_valid().to_numpy(zero_copy_only=False)
        offsets = np.concatenate([[0], np.cumsum(kept)])[offsets]
        strings = strings.drop_null()
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), strings), " ")


def _coded(df: DataFrame, key: str, text: str, path: str | None, decoded: str | None) -> DataFrame:
    held = df.sparkSession.sparkContext.broadcast(Vocabulary(path or default_path()))
    kind = df.schema[key].dataType.simpleString()
    names = ["_key", "ids", *([decoded] if decoded else [])]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, tokens = Encoder(held.value), pa.array(held.value.tokens, pa.string())
        for batch in batches:
            texts = batch.column(1)
            for start, stop in chunks(texts):  # only a chunk's texts are strings of Python at once
                ids, counts = encoder.encode(texts.slice(start, stop - start).to_pylist())
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids, pa.int32()))
                out = [batch.column(0).slice(start, stop - start), lists]
                yield pa.RecordBatch.from_arrays(out + ([_texts(lists, tokens)] if decoded else []), names)

    return df.select(F.col(key).alias("_key"), F.col(text).alias("_text")).mapInArrow(
        run, f"_key {kind}, ids array<int>" + (f", {decoded} string" if decoded else "")).withColumnRenamed("_key", key)


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """key and `ids` (array<int>) of every whole text, as the tokenizers library encodes it without added
    special tokens; the strings of special tokens in a text become their ids, as there.

    Null and empty texts have no ids. Keys may be null or repeated; other columns are not read. Words of any
    length are encoded; texts are never cut. The vocabulary's size bounds what is sent to the workers.
    """
    return _coded(df, key, text, path, None)


def round_trip(df: DataFrame, key: str = "doc_id", text: str = "text", into: str = "decoded",
               path: str | None = None) -> DataFrame:
    """`encode` with the text that its ids decode to, as `decode` gives it, in one pass."""
    return _coded(df, key, text, path, into)


def decode(df: DataFrame, ids: str = "ids", into: str = "decoded", path: str | None = None) -> DataFrame:
    """`df` with the text of each list of ids: tokens joined by one space, as the library does for a file
    without a decoder. Null lists and null or unknown ids in them give nothing."""
    held = df.sparkSession.sparkContext.broadcast(Vocabulary(path or default_path()).tokens)

    @F.arrow_udf("string")
    def text_of(lists: pa.Array) -> pa.Array:
        return _texts(lists, pa.array(held.value, pa.string()))

    return df.withColumn(into, text_of(F.col(ids)))


def digests(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """key, n_tokens and the digests of the ids and of the decoded text of every row."""
    return round_trip(df, key, text, path=path).select(key, F.size("ids").cast("long").alias("n_tokens"),
                        F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
