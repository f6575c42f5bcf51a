"""Substring dedup: content-defined chunks by a gear rolling hash, deduplicated by digest across documents.

A cut depends on the 16 bytes before it and on cuts close by, so an insertion moves only the cuts next to it and
the chunks of a shared passage are the same wherever it stands.
"""

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from scriptmill.llm.common import stage, table

#: a position is a cut with a chance of one in RATE, if none lies in the LEAST bytes before; chunks end after MOST bytes
RATE, LEAST, MOST = 24, 8, 1024
#: gaps between cuts that are searched for repetition, with periods of at most so many bytes; bytes of the pieces they are cut into, at least
GAP, PERIOD, PIECE = 96, 64, 32
#: words that a run of repeated chunks has at least; the parts of chunks at its ends are not counted, so this finds passages of 50
WORDS = 20
#: characters of a script without spaces that count as a word
SIGNS = 2
#: first and last characters of such scripts: Thai, Lao, Tibetan and Burmese; Khmer; kana and bopomofo; Han; Yi; Han again; half-width kana; more Han
UNSPACED = ((0x0E00, 0x109F), (0x1780, 0x17FF), (0x3041, 0x312F), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xA000, 0xA4CF),
            (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x20000, 0x3FFFF))
#: chunks that leave a worker at a time, those of whole texts at least
CHUNKS = 100_000
#: 16-bit numbers for the byte values, derived from their digests
GEAR = np.array([int.from_bytes(hashlib.blake2b(bytes([b]), digest_size=2).digest(), "big") for b in range(256)], np.uint16)


def gear(data: np.ndarray) -> np.ndarray:
    """The rolling hash at each byte: h = 2 h + GEAR[byte] in 16 bits, so over the last 16 bytes, by doubling steps."""
    h = GEAR[data]
    for step in (1, 2, 4, 8):
        older = np.zeros_like(h)
        older[step:] = h[:-step] if step < len(h) else 0
        h = h + (older << np.uint16(step))
    return h


def periodic(h: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Cuts in a stretch without others, whose rolling hashes are h, where it repeats itself. `starts` says which bytes are followed
    by a character's start. Each repetition is cut at one place of its period, chosen by its hash, into whole periods, so
    its pieces are the same wherever it stands."""
    again = np.zeros(len(h), bool)
    for p in range(1, min(PERIOD, len(h) - 1) + 1):
        again[p:] |= h[p:] == h[:-p]
    bounds = np.flatnonzero(np.diff(again, prepend=False, append=False))
    out = []
    for a, b in zip(bounds[::2], bounds[1::2], strict=True):
        at = np.flatnonzero(starts[a:b]) + a
        if b - a < PIECE or not len(at):
            continue
        at = at[h[at] == h[at].min()]
        out.append(at[::-(-PIECE // int(np.diff(at).min()))] if len(at) > 1 else at)
    return np.concatenate(out) + 1 if out else np.zeros(0, np.int64)


def cuts(data: np.ndarray) -> np.ndarray:
    """The ends of the chunks of one text, in order; never inside a UTF-8 character."""
    size = len(data)
    if not size:
        return np.zeros(0, np.int64)
    h = gear(data)
    marks = np.flatnonzero(h < 65536 // RATE) + 1
    marks = marks[marks < size]
    marks = marks[(data[marks] & 0xC0) != 0x80]
    marks = marks[np.diff(marks, prepend=-LEAST) >= LEAST]
    begins, ends = np.append(0, marks), np.append(marks, size)
    if (wide := np.flatnonzero(ends - begins >= GAP)).size:
        starts = np.append((data[1:] & 0xC0) != 0x80, False)
        more = [periodic(h[a:b], starts[a:b]) + a for a, b in zip(begins[wide], ends[wide], strict=True)]
        marks = np.unique(np.concatenate([marks, *more]))
    ends = np.append(marks, size)
    gaps = np.diff(ends, prepend=0)
    if gaps.max() > MOST:
        more = [np.arange(e - g + MOST, e, MOST) for e, g in zip(ends[gaps > MOST], gaps[gaps > MOST], strict=True)]
        more = np.concatenate(more)
        for _ in range(3):
            more = np.where((data[more] & 0xC0) == 0x80, more + 1, more)
        ends = np.unique(np.concatenate([ends, more[more < size]]))
    return ends


def chunk_rows(documents: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, start and size in bytes, words (white space within), signs (characters of scripts without spaces), whether it
    ends the text, and digest of every chunk."""
    kind = documents.schema[doc_id].dataType.simpleString()
    space, unspaced = np.zeros(0x110000, bool), np.zeros(0x110000, bool)
    space[[9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200C), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = True
    for first, last in UNSPACED:
        unspaced[first:last + 1] = True

    def of(text: str | None, i: int) -> tuple:
        """Arrays over the chunks of text i: i, start, size, words, signs, ends, digest."""
        data = (text or "").encode()
        raw = np.frombuffer(data, np.uint8)
        ends = cuts(raw)
        sizes = np.diff(ends, prepend=0)
        starts = ends - sizes
        digests = [hashlib.blake2b(data[a:b], digest_size=8).digest() for a, b in zip(starts, ends, strict=True)]
        words = signs = np.zeros(len(ends), np.int32)
        if len(data) and text.isascii():
            words = np.add.reduceat(space[raw], starts, dtype=np.int32)
        elif len(data):
            codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
            begins = np.cumsum((raw & 0xC0) != 0x80)[starts] - 1  # a chunk begins with a character
            words = np.add.reduceat(space[codes], begins, dtype=np.int32)
            signs = np.add.reduceat(unspaced[codes], begins, dtype=np.int32)
        return np.full(len(ends), i), starts, sizes, words, signs, ends == len(data), np.frombuffer(b"".join(digests), np.int64)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size = [], 0
            for i, value in enumerate(batch.column(1)):
                held.append(of(value.as_py(), i))
                size += len(held[-1][1])
                if size >= CHUNKS or i == batch.num_rows - 1:
                    rows, start, length, words, signs, ends, digest = map(np.concatenate, zip(*held, strict=True))
                    yield pa.RecordBatch.from_arrays([
                        batch.column(0).take(pa.array(rows)), pa.array(start, pa.int64()), pa.array(length, pa.int32()),
                        pa.array(words, pa.int32()), pa.array(signs, pa.int32()), pa.array(ends), pa.array(digest)],
                        ["doc_id", "start", "size", "words", "signs", "ends", "digest"])
                    held, size = [], 0

    return documents.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run, f"doc_id {kind}, start long, size int, words int, signs int, ends boolean, digest long")


def _spans(documents: DataFrame, doc_id: str, text: str, words: int, *more: Column) -> DataFrame:
    """The rows of repeated_spans, with more aggregates over the chunks of each run."""
    rows = stage(chunk_rows(documents, doc_id, text), "substring-chunks")
    repeated = stage(rows.groupBy("digest").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc")).where(
        "first_doc <> last_doc").select("digest", "first_doc"), "repeated-digests")
    found = rows.join(repeated, "digest").select("doc_id", "start", "size", "words", "signs", "ends", "first_doc").distinct()
    order = Window.partitionBy("doc_id").orderBy("start")
    begins = F.coalesce(F.col("start") != F.lag(F.col("start") + F.col("size")).over(order), F.lit(True))
    return found.withColumn("begins", begins.cast("int")).withColumn("run", F.sum("begins").over(order)).groupBy(
        "doc_id", "run").agg(
        F.min("start").alias("start"), F.sum("size").alias("size"),
        (F.sum("words") + F.floor(F.sum("signs") / SIGNS)).alias("n_words"),
        ((F.min("start") == 0) & F.max("ends")).alias("whole"), F.min("first_doc").alias("first_doc"),
        F.sum(F.when(F.col("first_doc") != F.col("doc_id"), F.col("size")).otherwise(0)).alias("n_removed"), *more).where(
        (F.col("n_words") >= words) | (F.col("whole") & (F.col("n_words") > 0))).drop("run", "whole")


def repeated_spans(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """doc_id, start, size, n_words, first_doc, n_removed: runs of chunks that other documents have too.

    One row per maximal run of neighbouring repeated chunks that has at least `words` words or is a whole text of more than one word, in bytes of the UTF-8 text; first_doc is the
    smallest id that holds one of its chunks, n_removed the bytes whose first document is another one. Digests are counted
    with partial sums; AQE splits a hot one where rows meet their counts. A 64-bit digest stands for a chunk: chance
    equals would have to follow each other to make a run.

    Words are counted by white space of any kind, in scripts without spaces as SIGNS characters each. Stretches that repeat
    themselves are cut by their period.

    Null and empty texts and null ids have no rows. Rows that share an id are one document. A text of one word without spaces is
    never reported. Other columns are not read.
    """
    return _spans(documents, doc_id, text, words)


def drop_repeated_substrings(documents: DataFrame, doc_id: str = "doc_id", text: str = "text",
                             words: int = WORDS) -> DataFrame:
    """`documents` without those chunks of runs that a document with a smaller id has, so the first copy of each chunk stays.

    All rows and columns stay. Null ids and texts are left alone; rows that share an id are cut alike only where their
    bytes fit, since a cut that would split a character is left out.
    """
    elsewhere = F.when(F.col("first_doc") != F.col("doc_id"), F.struct("start", "size"))
    spans = stage(_spans(documents, doc_id, text, words, F.collect_list(elsewhere).alias("cut")).where("n_removed > 0").groupBy(
        F.col("doc_id").alias("_cut_id")).agg(F.sort_array(F.flatten(F.collect_list("cut"))).alias("_cut")), "substring-cuts")

    @F.arrow_udf("string")
    def without(texts: pa.Array, spans: pa.Array) -> pa.Array:
        out = []
        for value, own in zip(texts.to_pylist(), spans.to_pylist(), strict=True):
            if value is not None and own:
                data, at, parts = value.encode(), 0, []
                for s in own:
                    parts.append(data[at:s["start"]])
                    at = s["start"] + s["size"]
                value = b"".join([*parts, data[at:]]).decode("utf-8", "ignore")
            out.append(value)
        return pa.array(out, pa.string())

    rows = documents.select(F.col(doc_id).alias("_id"), F.struct(*(F.col(f"`{c}`") for c in documents.columns)).alias("_row"))
    joined = rows.join(spans, F.col("_id") == F.col("_cut_id"), "left")
    left = without(F.col("_row").getField(text), F.col("_cut"))
    return joined.withColumn("_text", F.when(F.col("_cut").isNull(), F.col("_row").getField(text)).otherwise(left)).select(
        *((F.col("_text") if c == text else F.col("_row").getField(c)).alias(c) for c in documents.columns))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(table(spark, sf_dir, "documents"))
