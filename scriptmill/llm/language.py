"""Language identification: a linear-chain conditional random field over the words of a text.

Hashed affix, n-gram and lexicon features score a word for each language, learned transitions tie neighbouring
words, and forward-backward gives each word's probabilities, so code-switched texts are labelled word by word.
"""

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from scriptmill.llm.common import held_out, table

#: lines the field is fitted on at most (those with the smallest hash of id and position), and characters of the
#: pieces that longer ones are split into, at white space where there is some
SAMPLE_LINES, SAMPLE_CHARS = 12_000, 2_000
#: hash buckets of the features; words of the lexicon of each language
BUCKETS, LEXICON = 1 << 16, 300
SALTS = 64
EPOCHS, BATCH, RATE, DECAY, SEED = 3, 256, 0.2, 1e-6, 7
#: a worker forgets its scored words when it holds so many
KEPT_WORDS = 150_000
#: words whose features are looked up at once
SCORED_WORDS = 4_096
#: characters whose words go through forward-backward at once, whole texts at least
CHUNK_CHARS = 2_000_000
#: characters whose words are held as strings at once, whole texts at least
PART_CHARS = 1 << 18
UNKNOWN = "und"
find_words = re.compile(r"[^\W\d_]+").findall


def features(word: str, lexicon: dict[str, tuple]) -> list[int]:
    """Buckets of a word's affixes of 1 to 3 letters, its 2- and 3-grams, and the lexicons that hold it."""
    framed, size = f"^{word}$", len(word)
    names = [f"p{word[:n]}" for n in (1, 2, 3) if n <= size] + [f"s{word[-n:]}" for n in (1, 2, 3) if n <= size]
    names += [framed[i:i + n] for n in (2, 3) for i in range(len(framed) - n + 1)]
    names += lexicon.get(word, ())
    return [zlib.crc32(name.encode("utf-8", "surrogatepass")) % BUCKETS for name in names]


def _crc_table() -> np.ndarray:
    """The state that the checksum of zlib goes to on each byte."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


CRC = _crc_table()


def all_features(words: list[str], lexicon: dict[str, tuple]) -> tuple[np.ndarray, np.ndarray]:
    """(the `features` of every word end to end, how many each has); checksums of all parts of words go on byte by byte side by side."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    told = [lexicon.get(w, ()) for w in words]
    extra = np.fromiter(map(len, told), np.int64, len(words))
    data = np.frombuffer("".join([f"^{w}$" for w in words]).encode("utf-8", "surrogatepass"), np.uint8)
    at = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))  # where each character begins
    frame = np.cumsum(size + 2) - size - 2
    edges = np.minimum(size, 3)
    sizes = 2 * edges + 2 * size + 1 + extra
    place = np.cumsum(sizes) - sizes
    total = int(sizes.sum())
    first, count, state = np.zeros(total, np.int64), np.zeros(total, np.int64), np.full(total, 0xFFFFFFFF, np.uint32)

    def put(rows: np.ndarray, where: np.ndarray, begin: np.ndarray, n: int, mark: bytes = b"") -> None:
        """Characters `begin` to `begin + n` of the rows' frames go to their place, after a mark."""
        where, begin = place[rows] + where, frame[rows] + begin
        first[where], count[where] = at[begin], at[begin + n] - at[begin]
        if mark:
            state[where] = zlib.crc32(mark) ^ 0xFFFFFFFF

    for n in (1, 2, 3):
        rows = np.flatnonzero(size >= n)
        put(rows, n - 1, 1, n, b"p")
        put(rows, edges[rows] + n - 1, size[rows] + 1 - n, n, b"s")
    for n, before, many in ((2, 2 * edges, size + 1), (3, 2 * edges + size + 1, size)):
        rows = np.repeat(np.arange(len(words)), many)
        each = np.arange(len(rows)) - np.repeat(np.cumsum(many) - many, many)
        put(rows, before[rows] + each, each, n)
    for k in range(int(count.max(initial=0))):
        rows = np.flatnonzero(count > k)
        now = state[rows]
        state[rows] = CRC[(now ^ data[first[rows] + k]) & 0xFF] ^ (now >> 8)
    flat = (state ^ np.uint32(0xFFFFFFFF)).astype(np.int64) % BUCKETS
    for i in np.flatnonzero(extra):
        flat[place[i] + sizes[i] - extra[i]:place[i] + sizes[i]] = [zlib.crc32(name.encode()) % BUCKETS for name in told[i]]
    return flat, sizes


class Field:
    """Weights of features, of transitions and of the first label."""

    def __init__(self, languages: list[str]):
        k = len(languages)
        self.languages, self.lexicon = languages, {}
        self.weights, self.turns, self.first = np.zeros((BUCKETS, k)), np.zeros((k, k)), np.zeros(k)

    def emissions(self, words: list[str]) -> np.ndarray:
        """exp(score) of each distinct word, scaled to a largest of 1."""
        flat, sizes = all_features(words, self.lexicon)
        scores = np.add.reduceat(self.weights[flat], np.cumsum(sizes) - sizes)
        return np.exp(scores - scores.max(1, keepdims=True))

    def fit(self, lines: list[tuple[str, str]]) -> "Field":
        """lines: (language, text). Two lines of any languages make a sequence, so switches are learned too."""
        order, rng = {x: i for i, x in enumerate(self.languages)}, np.random.default_rng(SEED)
        lines = [(order[lang], words) for lang, text in lines if (words := find_words(text.lower()))]
        if not lines:
            return self
        counts = [Counter() for _ in self.languages]
        for y, words in lines:
            counts[y].update(words)
        for i, count in enumerate(counts):
            for word, _ in sorted(count.items(), key=lambda x: (-x[1], x[0]))[:LEXICON]:
                self.lexicon[word] = (*self.lexicon.get(word, ()), f"lexicon {i}")
        vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for _, words in lines for w in words))}
        flat, sizes = all_features(list(vocabulary), self.lexicon)
        starts = np.cumsum(sizes) - sizes
        lines = [(y, np.array([vocabulary[w] for w in words])) for y, words in lines]
        squares = [np.full_like(p, 1e-8) for p in (self.weights, self.turns, self.first)]
        for _ in range(EPOCHS):
            pairs = list(zip(rng.permutation(len(lines)), rng.permutation(len(lines)), strict=True))
            pairs.sort(key=lambda p: len(lines[p[0]][1]) + len(lines[p[1]][1]))
            batches = [pairs[i:i + BATCH] for i in range(0, len(pairs), BATCH)]
            for i in rng.permutation(len(batches)):
                self._step([(lines[a], lines[b]) for a, b in batches[i]], flat, starts, sizes, squares)
        return self

    def _step(self, batch, flat, starts, sizes, squares) -> None:
        """One AdaGrad step on the likelihood of a batch of sequences, padded to the longest."""
        seqs = [np.concatenate([a[1], b[1]]) for a, b in batch]
        length, k, rows = max(map(len, seqs)), len(self.languages), len(seqs)
        words, label = np.zeros((rows, length), np.int64), np.zeros((rows, length), np.int64)
        real = np.zeros((rows, length), bool)
        for r, ((a, b), seq) in enumerate(zip(batch, seqs, strict=True)):
            words[r, :len(seq)], real[r, :len(seq)] = seq, True
            label[r, :len(a[1])], label[r, len(a[1]):len(seq)] = a[0], b[0]
        used, inverse = np.unique(words, return_inverse=True)
        inverse = inverse.reshape(words.shape)
        index = np.repeat(starts[used] - np.cumsum(sizes[used]) + sizes[used], sizes[used]) + np.arange(sizes[used].sum())
        own = flat[index]
        bounds = np.cumsum(sizes[used]) - sizes[used]
        scores = np.add.reduceat(self.weights[own], bounds)
        emit = np.exp(scores - scores.max(1, keepdims=True))[inverse]
        turns, first = np.exp(self.turns), np.exp(self.first)
        alpha, beta = np.zeros((rows, length, k)), np.zeros((rows, length, k))
        a = first * emit[:, 0]
        alpha[:, 0] = a / a.sum(1, keepdims=True)
        for t in range(1, length):
            a = (alpha[:, t - 1] @ turns) * emit[:, t]
            alpha[:, t] = np.where(real[:, t, None], a / a.sum(1, keepdims=True), alpha[:, t - 1])
        beta[:, -1] = 1 / k
        pairs = np.zeros((k, k))
        for t in range(length - 1, 0, -1):
            after = emit[:, t] * beta[:, t]
            joint = alpha[:, t - 1, :, None] * turns * after[:, None, :]
            pairs += ((joint / joint.sum((1, 2), keepdims=True)) * real[:, t, None, None]).sum(0)
            b = after @ turns.T
            beta[:, t - 1] = np.where(real[:, t, None], b / b.sum(1, keepdims=True), beta[:, t])
        gamma = alpha * beta
        gamma /= gamma.sum(2, keepdims=True)
        wrong = (np.eye(k)[label] - gamma) * real[:, :, None]
        told = np.zeros((k, k))
        both = real[:, 1:]
        np.add.at(told, (label[:, :-1][both], label[:, 1:][both]), 1.0)
        by_word = np.zeros((len(used), k))
        np.add.at(by_word, inverse.ravel(), wrong.reshape(-1, k))
        gradient = np.zeros_like(self.weights)
        np.add.at(gradient, own, np.repeat(by_word, sizes[used], axis=0))
        for p, g, s in zip((self.weights, self.turns, self.first), (gradient, told - pairs, wrong[:, 0].sum(0)),
                           squares, strict=True):
            g = g / rows - DECAY * p
            s += g * g
            p += RATE * g / np.sqrt(s)

    def marginals(self, emit: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Probabilities of each word's language, by forward-backward over many texts laid end to end.

        Where `begins` is set a text starts: its step forgets what came before, so texts do not mix. The chain is cut
        into blocks whose transfer matrices are multiplied side by side; then every block runs from its exact
        entry state. The cost is that of the plain recursion, in about the root of its number of steps.
        """
        n, k = emit.shape
        size = max(1, int(np.ceil(np.sqrt(n))))
        blocks = -(-n // size)
        e = np.ones((blocks * size, k))
        e[:n] = emit
        del emit
        e, starts = e.reshape(blocks, size, k), np.zeros(blocks * size, bool)
        starts[:n] = begins
        starts = starts.reshape(blocks, size)
        turns, first = np.exp(self.turns - self.turns.max()), np.exp(self.first - self.first.max())

        def forward(states: np.ndarray, s: int) -> np.ndarray:
            """states (blocks, m, k), each row a distribution, one step on."""
            fresh = states.sum(2, keepdims=True) * first
            return np.where(starts[:, s, None, None], fresh, states @ turns) * e[:, s, None, :]

        product = np.broadcast_to(np.eye(k), (blocks, k, k))
        for s in range(size):
            product = forward(product, s)
            product = product / product.sum((1, 2), keepdims=True)
        entry, leave = np.full((blocks, 1, k), 1 / k), np.full((blocks, k), 1 / k)
        for b in range(1, blocks):
            a = entry[b - 1, 0] @ product[b - 1]
            entry[b, 0] = a / a.sum()
        for b in range(blocks - 2, -1, -1):
            a = product[b + 1] @ leave[b + 1]
            leave[b] = a / a.sum()
        alpha, state = np.empty((blocks, size, k)), entry
        for s in range(size):
            state = forward(state, s)
            state = state / state.sum(2, keepdims=True)
            alpha[:, s] = state[:, 0]
        state = leave
        for s in range(size - 1, -1, -1):
            alpha[:, s] *= state
            after = e[:, s] * state
            state = np.where(starts[:, s, None], (after * first).sum(1, keepdims=True), after @ turns.T)
            state = state / state.sum(1, keepdims=True)
        gamma = alpha.reshape(-1, k)[:n]
        gamma /= gamma.sum(1, keepdims=True)
        return gamma


def fit_field(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
              lines: int = SAMPLE_LINES) -> Field:
    """A field fitted on at most `lines` lines, or pieces of at most SAMPLE_CHARS characters of longer ones (so what the driver gets is
    bounded), an equal number for each language, from documents outside the held-out fifth."""
    whole = documents.select(F.col(doc_id).alias("i"), F.col(lang).cast("string").alias("lang"),
                             F.posexplode(F.split(F.col(text), "\n")).alias("at", "line")).where(
        F.col("lang").isNotNull() & ~held_out(F.col("i")))
    pieces = F.when(F.length("line") <= SAMPLE_CHARS, F.array("line")).otherwise(F.regexp_extract_all(
        "line", F.lit(f"(?s).{{1,{SAMPLE_CHARS}}}(?:(?<=\\s)|(?=\\s)|$)|.{{1,{SAMPLE_CHARS}}}"), F.lit(0)))
    rows = whole.select("i", "lang", "at", F.posexplode(pieces).alias("piece", "line")).where(F.col("line").rlike("\\p{L}"))
    rows = rows.withColumn("order", F.when(F.col("piece") == 0, F.xxhash64("i", "at")).otherwise(F.xxhash64("i", "at", "piece")))
    salt = F.pmod("order", F.lit(SALTS))  # no task ranks all lines of a language
    rank = F.row_number().over(Window.partitionBy("lang", salt).orderBy("order", "i", "at", "piece"))
    sample = rows.withColumn("rank", rank).where(F.col("rank") <= -(-lines // SALTS)).orderBy("rank", "lang").limit(
        lines).select("lang", "line", "order").collect()
    sample.sort(key=lambda r: (r.order, r.line))
    return Field(sorted({r.lang for r in sample})).fit([(r.lang, r.line) for r in sample])


class Labeller:
    """Labels texts in one worker; words seen before keep their scores."""

    def __init__(self, field: Field):
        self.field, self.kept = field, {}
        self.scores = np.zeros((1024, len(field.languages)))

    def _numbers(self, texts: list[list[str]]) -> np.ndarray:
        kept = self.kept
        if len(kept) > KEPT_WORDS:
            kept.clear()
        new = list({w for words in texts for w in words if w not in kept})
        if new:
            need = len(kept) + len(new)
            if need > len(self.scores):
                self.scores = np.concatenate([self.scores, np.zeros((max(need, len(self.scores)), self.scores.shape[1]))])
            for at in range(0, len(new), SCORED_WORDS):
                part = new[at:at + SCORED_WORDS]
                self.scores[len(kept) + at:len(kept) + at + len(part)] = self.field.emissions(part)
            kept.update(zip(new, range(len(kept), need), strict=True))
        return np.array([kept[w] for words in texts for w in words], np.int64)

    def _emissions(self, texts: list[str | None]) -> tuple[np.ndarray, list[int]]:
        """(`Field.emissions` of every word of the texts end to end, how many words each has)."""
        words = [find_words((t or "").lower()) if self.field.languages else [] for t in texts]
        numbers = self._numbers(words)  # before the scores are read: it may replace their table
        return self.scores[numbers], [len(w) for w in words]

    def label_chunk(self, texts: list[str | None]) -> Iterator[np.ndarray | None]:
        """`label` of the texts of one chunk."""
        emit, sizes = [], []
        for start, stop in chunks([len(t or "") for t in texts], PART_CHARS):
            part, own = self._emissions(texts[start:stop])
            emit.append(part)
            sizes += own
        sizes = np.array(sizes)
        ends = np.cumsum(sizes)
        if ends[-1]:
            begins = np.zeros(ends[-1], bool)
            begins[(ends - sizes)[sizes > 0]] = True
            found = self.field.marginals(np.concatenate(emit), begins)
        for size, end in zip(sizes, ends, strict=True):
            yield found[end - size:end] if size else None

    def label(self, texts: list[str | None]) -> Iterator[np.ndarray | None]:
        """For each text the words' probabilities (words by languages), or None where it has no letter."""
        for start, stop in chunks([len(t or "") for t in texts], CHUNK_CHARS):
            yield from self.label_chunk(texts[start:stop])


def chunks(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Spans of texts of so many characters that have `most` together, or of one larger text."""
    at = 0
    while at < len(sizes):
        stop, size = at, 0
        while stop < len(sizes) and (stop == at or size + sizes[stop] <= most):
            size += sizes[stop]
            stop += 1
        yield at, stop
        at = stop


def identify(documents: DataFrame, field: Field, doc_id: str = "doc_id", text: str = "text",
             spans: bool = False) -> DataFrame:
    """doc_id, lang_pred, score of every whole text; with `spans` also runs of words of one language.

    lang_pred is the language with the largest mean probability over all words, score that mean. Null
    texts, empty ones and texts without a letter get `und` and 0.0, as do all texts where no labelled
    row could be learned from. Spans are (first word, number of words, language), by the likeliest
    language of each word. Null or repeated ids are kept, ties go to the language that sorts first,
    other columns are not read, texts are never cut.
    """
    held = documents.sparkSession.sparkContext.broadcast(field)
    kind = documents.schema[doc_id].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller, names = Labeller(held.value), held.value.languages
        for batch in batches:
            picks, scores, runs, texts = [], [], [], batch.column(1)
            sizes = pc.fill_null(pc.utf8_length(texts), 0).to_pylist()
            for p in (p for start, stop in chunks(sizes, CHUNK_CHARS)
                      for p in labeller.label_chunk(texts.slice(start, stop - start).to_pylist())):
                mean = None if p is None else p.mean(0)
                picks.append(UNKNOWN if p is None else names[int(mean.argmax())])
                scores.append(0.0 if p is None else min(1.0, float(mean.max())))
                if spans:
                    best = np.zeros(0, int) if p is None else p.argmax(1)
                    cuts = np.flatnonzero(np.diff(best, prepend=-1))
                    runs.append([{"first": int(a), "words": int(b - a), "lang": names[best[a]]}
                                 for a, b in zip(cuts, [*cuts[1:], len(best)])])
            columns = [batch.column(0), pa.array(picks, pa.string()), pa.array(scores, pa.float64())]
            if spans:
                columns.append(pa.array(runs, pa.list_(pa.struct(
                    [("first", pa.int32()), ("words", pa.int32()), ("lang", pa.string())]))))
            yield pa.RecordBatch.from_arrays(columns, ["_key", "lang_pred", "score", "spans"][:len(columns)])

    schema = f"_key {kind}, lang_pred string, score double" + (
        ", spans array<struct<first:int,words:int,lang:string>>" if spans else "")
    return documents.select(F.col(doc_id).alias("_key"), F.col(text).alias("_text")).mapInArrow(
        run, schema).withColumnRenamed("_key", doc_id)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    found = identify(documents, fit_field(documents))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
