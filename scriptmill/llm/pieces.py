"""Encoding and decoding with a SentencePiece BPE model, by a merge-type prefix table.

For every prefix of a word exactly one token can end its encoding: a token that ends there, found by an automaton of all
tokens, whose border with the last token of the prefix before it survives all merges. The table of these last tokens
is filled from left to right; the ids are read off it backwards.
"""

import functools
import itertools
import re
import struct
from array import array
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from scriptmill.llm.common import table

MODEL = "piece_bpe_32k.model"
#: what a model file has for a space; in texts it is one
SIGN = "▁"
#: a worker forgets its encoded words when it holds so many (some 80 MB), and never keeps longer ones
KEPT_WORDS, KEPT_SIZE = 400_000, 32
#: borders between tokens that a worker remembers (some 15 MB)
KEPT_BORDERS = 1 << 17
#: bytes of text that a worker splits into words at a time, whole texts at least
CHUNK_BYTES = 1 << 20
#: kinds of pieces in a model file
NORMAL, UNKNOWN, CONTROL, UNUSED, BYTE = 1, 2, 3, 5, 6
BPE = 2
INF = float("inf")
#: stands between words, and for the token before a word's first one
SEPARATOR, START = "\0", -1


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(MODEL)


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol buffer message; lengths, 32-bit and 64-bit values as bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        number, kind = divmod(varint(), 8)
        if kind == 0:
            yield number, varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            yield number, data[at:at + size]
            at += size


class Vocabulary:
    """A BPE model with byte fallback and a space before the text; nothing else is normalised.

    `rank` orders merges by falling score; equal scores share a rank, and of equal ranks the left merges first.
    `halves` says which two tokens a token's own text is merged from last; tokens that their own text does not lead to
    are never made, so they are left out of it. Tokens have a space where the file has its sign for one.
    """

    def __init__(self, path: str):
        with open(path, "rb") as file:
            message = list(_fields(file.read()))
        pieces = [dict(_fields(value)) for number, value in message if number == 1]
        trainer = dict(_fields(next((v for n, v in message if n == 2), b"")))
        rules = dict(_fields(next((v for n, v in message if n == 3), b"")))
        self.tokens = [p[1].decode() for p in pieces]
        kinds = [p.get(3, NORMAL) for p in pieces]
        scores = [struct.unpack("<f", p[2])[0] if 2 in p else 0.0 for p in pieces]
        spaced = any(" " in t for t in self.tokens)
        self.tokens = [t.replace(SIGN, " ") for t in self.tokens]
        self.ids = {t: i for i, (t, k) in enumerate(zip(self.tokens, kinds)) if k == NORMAL}
        signs = {t for t in self.ids if len(t) == 1}
        foreign = {c for t in self.ids if len(t) > 1 for c in t} - signs
        if (trainer.get(3) != BPE or rules.get(2) or rules.get(3, 1) != 1 or rules.get(4, 1) != 0 or rules.get(5, 1) != 1
                or kinds.count(BYTE) != 256 or set(kinds) - {NORMAL, UNKNOWN, CONTROL, UNUSED, BYTE} or foreign
                or spaced or SEPARATOR in signs or any(re.search("[^ ] ", t) for t in self.ids)):
            raise ValueError(f"{path}: not a BPE model with byte fallback and identical text")
        self.signs = signs
        self.bytes = [i for _, i in sorted((int(t[3:5], 16), i) for i, t in enumerate(self.tokens) if kinds[i] == BYTE)]
        self.end = trainer.get(42, 2)
        self.unknown = [i for i, k in enumerate(kinds) if k == UNKNOWN]
        self.silent = {i for i, k in enumerate(kinds) if k == CONTROL}
        order = {s: r for r, s in enumerate(sorted({scores[i] for i in self.ids.values()}, reverse=True), 1)}
        self.rank = {i: order[scores[i]] for i in self.ids.values()}
        self.halves = {}
        for token, i in self.ids.items():
            if len(token) > 1 and (pair := self._last_merge(token)):
                self.halves[i] = pair
        late = [self.tokens[i] for i, pair in self.halves.items()
                if any(self.rank[h] > self.rank[i] for h in pair if h in self.halves)]
        if late:
            raise ValueError(f"{path}: parts are merged after the whole: {late[:5]}")
        # a single sign is there from the start
        for token in self.signs:
            self.rank[self.ids[token]] = 0

    def _last_merge(self, text: str) -> tuple[int, int] | None:
        parts = list(text)
        while len(parts) > 2:
            ranks = [self.rank.get(self.ids.get(a + b), INF) for a, b in zip(parts, parts[1:])]
            best = min(ranks)
            if best == INF:
                return None
            at = ranks.index(best)
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return self.ids[parts[0]], self.ids[parts[1]]


class Encoder:
    """Encodes texts of one worker. Words seen before are looked up."""

    def __init__(self, vocabulary: Vocabulary):
        self.v, self.kept = vocabulary, {}
        letters = {c for c in vocabulary.signs if c.isalpha()}
        groups = [letters, vocabulary.signs - letters - {" "}]
        if any((a in letters) != (b in letters) for t in vocabulary.ids for a, b in itertools.pairwise(t.lstrip(" "))):
            groups = [groups[0] | groups[1]]
        # no token crosses the border of two groups, holds a space after another sign, or a sign without an entry:
        # such pieces of a text are encoded alone
        known = ["".join(map(re.escape, sorted(group))) for group in groups]
        self.find = re.compile("|".join([f" *[{signs}]+" for signs in known] + [" +", f"[^{''.join(known)} ]+"])).findall
        self.ends = ahocorasick.Automaton()
        for token, i in vocabulary.ids.items():
            if i in vocabulary.halves:
                self.ends.add_word(token, (len(token), i))
        self.ends.make_automaton()
        self.single = {t: vocabulary.ids[t] for t in vocabulary.signs} | {SEPARATOR: START}
        self.spine = functools.lru_cache(None)(self._spine)
        self.fits = functools.lru_cache(KEPT_BORDERS)(self._fits)

    def _spine(self, token: int, side: int) -> list[tuple[int, int, float]]:
        """(text, rank that makes it, rank that ends it) of the tokens at one edge of `token` while it is merged."""
        out, ends = [], INF
        while True:
            out.append((self.v.tokens[token], self.v.rank[token], ends))
            if token not in self.v.halves:
                return out
            ends, token = self.v.rank[token], self.v.halves[token][side]

    def _fits(self, left: int, right: int) -> bool:
        """Whether no merge ever crosses the border between two neighbouring tokens."""
        if left == START:
            return True
        ids, rank = self.v.ids, self.v.rank
        for a, a_made, a_ends in self.spine(left, 1):
            for b, b_made, b_ends in self.spine(right, 0):
                whole = ids.get(a + b)
                if whole is not None:
                    when = max(rank[whole], a_made, b_made)
                    if when < a_ends and when <= b_ends:
                        return False
        return True

    def learn(self, words: Iterable[str]) -> dict[str, bytes]:
        """The ids of pieces of texts as little-endian 32-bit numbers. The tables of all of them are filled in one run
        of the automaton, over the pieces behind one another."""
        found, known = {}, []
        for word in words:
            if word[0] in self.v.signs:
                known.append(word)
            else:
                found[word] = array("i", [self.v.bytes[b] for b in word.encode()]).tobytes()
        text = SEPARATOR.join(["", *known])
        # where no longer token ends a prefix, its last sign does
        last, sizes = [*map(self.single.get, text)], [1] * len(text)
        filled, fits = -1, self.fits
        for end, (size, token) in self.ends.iter(text):
            if end != filled and fits(last[end - size], token):
                last[end], sizes[end], filled = token, size, end
        stop = 0
        for word in known:
            start, stop = stop, stop + 1 + len(word)
            ids, at = [], stop - 1
            while at > start:
                ids.append(last[at])
                at -= sizes[at]
            ids.reverse()
            found[word] = array("i", ids).tobytes()
        return found

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each); every text has the id of its end."""
        kept, find = self.kept, self.find
        if len(kept) > KEPT_WORDS:
            kept.clear()
        pieces = [find(" " + text.replace(SIGN, " ")) if text else [] for text in texts]
        new = self.learn(set().union(*pieces).difference(kept))
        kept.update(new)
        end, look = array("i", [self.v.end]).tobytes(), kept.__getitem__
        coded = [b"".join(map(look, own)) + end for own in pieces]
        for word in new:
            if len(word) > KEPT_SIZE:
                del kept[word]
        return np.frombuffer(b"".join(coded), "<i4"), np.array([len(b) // 4 for b in coded], np.int64)


class Decoder:
    """The text of lists of ids. Signs in bytes that are no UTF-8 become U+FFFD, one for each byte."""

    def __init__(self, vocabulary: Vocabulary):
        self.parts = {i: t.encode() for i, t in enumerate(vocabulary.tokens)}
        self.parts |= {i: bytes([b]) for b, i in enumerate(vocabulary.bytes)}
        self.parts |= dict.fromkeys(vocabulary.silent, b"")
        self.parts |= dict.fromkeys(vocabulary.unknown, " ⁇ ".encode())
        self.silent = vocabulary.silent
        self.led = {i for t, i in vocabulary.ids.items() if t[0] == " "}

    def text(self, ids: list[int]) -> str:
        parts = self.parts
        try:
            raw = b"".join(map(parts.__getitem__, ids))
        except KeyError:  # null or unknown ids
            ids = [i for i in ids if i in parts]
            raw = b"".join(map(parts.__getitem__, ids))
        first = next((i for i in ids if i not in self.silent), None)
        if first in self.led:
            raw = raw[1:]
        try:
            return raw.decode()
        except UnicodeDecodeError:
            return _each_byte(raw)


def _each_byte(raw: bytes) -> str:
    out, at = [], 0
    while True:
        try:
            out.append(raw[at:].decode())
            return "".join(out)
        except UnicodeDecodeError as fault:
            out += [raw[at:at + fault.start].decode(), "�" * (fault.end - fault.start)]
            at += fault.end


def _chunks(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Spans of whole texts of about CHUNK_BYTES."""
    total = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(total):
        before = total[start - 1] if start else 0
        stop = min(len(total), int(np.searchsorted(total, before + CHUNK_BYTES)) + 1)
        yield start, stop
        start = stop


def _coded(df: DataFrame, key: str, text: str, path: str | None, decoded: str | None) -> DataFrame:
    held = df.sparkSession.sparkContext.broadcast(Vocabulary(path or default_path()))
    kind = df.schema[key].dataType.simpleString()
    names = ["_key", "ids", *([decoded] if decoded else [])]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = Encoder(held.value), Decoder(held.value)
        for batch in batches:
            texts = batch.column(1)
            for start, stop in _chunks(texts):
                ids, counts = encoder.encode(texts.slice(start, stop - start).to_pylist())
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                out = [batch.column(0).slice(start, stop - start), pa.ListArray.from_arrays(
                    pa.array(offsets), pa.array(ids, pa.int32()))]
                if decoded:
                    flat, ends = ids.tolist(), offsets.tolist()
                    out.append(pa.array([decoder.text(flat[a:b]) for a, b in itertools.pairwise(ends)], pa.string()))
                yield pa.RecordBatch.from_arrays(out, names)

    return df.select(F.col(key).alias("_key"), F.col(text).alias("_text")).mapInArrow(
        run, f"_key {kind}, ids array<int>" + (f", {decoded} string" if decoded else "")).withColumnRenamed("_key", key)


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """key and `ids` (array<int>) of every whole text, as the sentencepiece library encodes it with an end id only.

    Null and empty texts have the end id alone. Keys may be null or repeated; other columns are not read. Words of any
    length are encoded in time linear in their length; texts are never cut. The model is read on the driver; its size
    bounds what is sent to the workers.
    """
    return _coded(df, key, text, path, None)


def round_trip(df: DataFrame, key: str = "doc_id", text: str = "text", into: str = "decoded",
               path: str | None = None) -> DataFrame:
    """`encode` with the text that its ids decode to, as `decode` gives it, in one pass."""
    return _coded(df, key, text, path, into)


def decode(df: DataFrame, ids: str = "ids", into: str = "decoded", path: str | None = None) -> DataFrame:
    """`df` with the text of each list of ids, as the library's decode. Null lists give an empty text, as do null ids
    and ids that the model does not have."""
    held = df.sparkSession.sparkContext.broadcast(Vocabulary(path or default_path()))

    @F.arrow_udf("string")
    def text_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        decoder = Decoder(held.value)
        for lists in batches:
            yield pa.array([decoder.text(own.values.tolist()) if own.is_valid and not own.values.null_count else
                            decoder.text(own.as_py() or []) for own in lists], pa.string())

    return df.withColumn(into, text_of(F.col(ids)))


def digests(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """key, n_tokens and the digests of the ids and of the decoded text of every row."""
    return round_trip(df, key, text, path=path).select(key, F.size("ids").cast("long").alias("n_tokens"),
                        F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
