"""The character registry: scores, operations on it, rosters and request tables."""

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from scriptmill import fixed
from scriptmill.functions.chars import column, strip
from scriptmill.functions.tokens import token_count
from scriptmill.operators.answers import in_halves
from scriptmill.operators.ordered import SumBefore, running
from scriptmill.session import stage

KEYS = ["book_id"]
OPS = ["book_id", "batch_no", "op_no", "operation", "name", "existing_name", "age", "gender",
       "description"]


def gender_score(age, gender, mode: str = "hash", identity=("book_id", "name")) -> Column:
    """Score of a character. Where several are allowed, one is chosen by a hash of its identity,
    or the lowest with mode="min"."""
    out = F.lit(fixed.NEUTRAL_SCORE)
    for (g, a), scores in fixed.SCORE_CHOICES.items():
        if mode == "min" or len(scores) == 1:
            chosen = F.lit(min(scores))
        else:
            spot = F.pmod(F.xxhash64(*map(column, identity)), F.lit(len(scores))).cast("int")
            chosen = F.get(F.array(*map(F.lit, scores)), spot)
        out = F.when((column(gender) == g) & (column(age) == a), chosen).otherwise(out)
    return out.cast("int")


def check_enums(ops: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, rejected): operations, ages and genders outside their literals are rejected."""
    bad = F.concat_ws(", ", *[
        F.when(~F.coalesce(F.col(c).isin(allowed), F.lit(False)), c)
        for c, allowed in (("operation", fixed.OPERATIONS), ("age", fixed.AGES),
                           ("gender", fixed.GENDERS))])
    marked = ops.withColumn("invalid", bad)
    return (marked.where(F.col("invalid") == "").drop("invalid"),
            marked.where(F.col("invalid") != ""))


def clean_names(ops: DataFrame) -> DataFrame:
    """Operations with a name; names in lower case, a null description as an empty one."""
    tidy = ops.select(*OPS).withColumns({
        "name": F.lower(strip("name")), "existing_name": F.lower(strip("existing_name")),
        "description": F.coalesce("description", F.lit(""))})
    return tidy.where(F.col("name") != "")


def _place():
    return F.struct("batch_no", "op_no")


def upsert_latest(ops: DataFrame) -> DataFrame:
    """Registry from inserts and updates alone, by aggregation.

    Operations of one batch see the registry as it was before it, so a name's last operation in
    a batch counts. An insert replaces the character. An update keeps what is known: the age,
    a gender other than unknown, and the longer description.
    """
    one = clean_names(ops).groupBy("book_id", "name", "batch_no").agg(
        F.max_by(F.struct("op_no", "operation", "age", "gender", "description"), "op_no")
        .alias("o"), F.min("op_no").alias("first_op"))
    flat = one.select("book_id", "name", "batch_no", "first_op", "o.*")
    seen = flat.groupBy("book_id", "name").agg(
        F.max(F.when(F.col("operation") == "insert", F.col("batch_no"))).alias("base"),
        F.min(F.struct("batch_no", "first_op")).alias("first_seen"))
    since = flat.join(seen, ["book_id", "name"]).where(
        F.col("base").isNull() | (F.col("batch_no") >= F.col("base")))
    known = F.when(F.col("gender") != "unknown", F.col("batch_no"))
    return since.groupBy("book_id", "name").agg(
        F.min_by("age", "batch_no").alias("age"),
        F.coalesce(F.min_by("gender", known), F.lit("unknown")).alias("gender"),
        F.max_by("description", F.struct(F.length("description"), -F.col("batch_no")))
        .alias("description"),
        F.first("first_seen").alias("at"), F.max("batch_no").alias("last_batch")
    ).select("book_id", "name", "age", "gender", "description",
             F.col("at.batch_no").alias("seen_batch"), F.col("at.first_op").alias("seen_op"),
             "last_batch")


def merge_families(ops: DataFrame) -> DataFrame:
    """book_id, name, family: names that merges tie together, directly or through others.

    Labels spread along distinct merge edges and jump to their label's label, so long rename
    chains need few rounds. Only the count of changed labels reaches the driver.
    """
    tied = ops.where((F.col("operation") == "merge") & F.col("existing_name").isNotNull()
                     & (F.col("existing_name") != "")
                     & ~F.col("existing_name").isin(fixed.NO_NAME)
                     & (F.col("existing_name") != F.col("name")))
    one_way = tied.select("book_id", F.col("name").alias("a"), F.col("existing_name").alias("b"))
    edges = stage(one_way.unionByName(
        one_way.select("book_id", F.col("b").alias("a"), F.col("a").alias("b"))).distinct(),
        "edges")
    labels = stage(edges.groupBy("book_id", F.col("a").alias("name")).agg(
        F.least(F.col("name"), F.min("b")).alias("family")), "labels")
    while True:
        spread = edges.join(
            labels.select("book_id", F.col("name").alias("b"), "family"), ["book_id", "b"]
        ).groupBy("book_id", F.col("a").alias("name")).agg(F.min("family").alias("near"))
        nearer = labels.join(spread, ["book_id", "name"]).select(
            "book_id", "name", "family", F.least("family", "near").alias("next"))
        jumped = stage(nearer.join(
            labels.select("book_id", F.col("name").alias("next"), F.col("family").alias("far")),
            ["book_id", "next"]).select(
            "book_id", "name", "family", F.least("next", "far").alias("next")), "labels")
        changed = jumped.where(F.col("next") != F.col("family")).count()
        labels = jumped.select("book_id", "name", F.col("next").alias("family"))
        if changed == 0:
            return labels


class Roster:
    """Characters of one book or family while operations are applied batch by batch.

    Values are (age, gender, description, seen_batch, seen_op), kept in order of first sight.
    """

    def __init__(self):
        self.known: dict[str, tuple] = {}
        self.changed: dict[str, int] = {}
        self.batch_no = None
        self.pending: list = []

    def seed(self) -> None:
        for i, (name, age, gender, _, text) in enumerate(fixed.SEED_CHARACTERS):
            self.known[name] = (age, gender, text, -1, i)
            self.changed[name] = -1

    def add(self, op) -> None:
        if op.batch_no != self.batch_no:
            self.flush()
            self.batch_no = op.batch_no
        self.pending.append(op)

    def flush(self) -> None:
        """Applies the pending batch; all of it reads the state from before the batch."""
        fresh, gone = {}, set()
        for op in self.pending:
            source = self._source(op)
            if source is False:
                continue
            old = self.known.get(source) if source else None
            fresh[op.name] = (*self._values(op, old, renamed=source != op.name),
                              *fresh.get(op.name, (0, 0, 0, op.batch_no, op.op_no))[3:])
            if source and source != op.name:
                gone.add(source)
        for name in gone:
            fresh.pop(name, None)
            self.known.pop(name, None)
        for name, value in fresh.items():
            if name in self.known:
                value = (*value[:3], *self.known[name][3:])
            self.known[name] = value
            self.changed[name] = self.batch_no
        self.pending = []

    def _source(self, op):
        """Name whose present values the operation builds on: none, or False to skip it."""
        if op.operation == "update":
            return op.name
        if op.operation != "merge":
            return None
        old = op.existing_name
        if not old or old in fixed.NO_NAME:
            return False
        return old if old == op.name or old in self.known else False

    @staticmethod
    def _values(op, old, renamed):
        if old is None:
            return op.age, op.gender, op.description
        age, gender, text = old[:3]
        longer = len(op.description) > len(text)
        if not renamed:
            return age, (op.gender if gender == "unknown" else gender), (
                op.description if longer else text)
        return op.age, (gender if op.gender == "unknown" else op.gender), (
            op.description if longer else f"{text} {op.description}".strip())

    def rows(self, **keys) -> list[dict]:
        return [{**keys, "name": name, "age": v[0], "gender": v[1], "description": v[2],
                 "seen_batch": v[3], "seen_op": v[4], "last_batch": self.changed[name]}
                for name, v in self.known.items()]


REGISTRY = ("book_id string, name string, age string, gender string, description string, "
            "seen_batch long, seen_op long, last_batch long")
REGISTRY_COLUMNS = [part.split()[0] for part in REGISTRY.split(", ")]


def fold_families(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Folds operations that arrive ordered by book, family, batch and operation.

    Streams: what is held is one family's roster and one batch of operations.
    """
    roster, current = Roster(), None
    for frame in batches:
        done = []
        frame = frame.astype({"existing_name": object}).where(frame.notna(), None)
        for op in frame.itertuples(index=False):
            if (op.book_id, op.family) != current:
                if current is not None:
                    roster.flush()
                    done += roster.rows(book_id=current[0])
                roster, current = Roster(), (op.book_id, op.family)
            roster.add(op)
        yield pd.DataFrame(done, columns=REGISTRY_COLUMNS)
    if current is not None:
        roster.flush()
        yield pd.DataFrame(roster.rows(book_id=current[0]), columns=REGISTRY_COLUMNS)


def seed_ops(books: DataFrame) -> DataFrame:
    """The characters every book starts with, as inserts of a batch before the first."""
    seeds = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(a).alias("age"),
                               F.lit(g).alias("gender"), F.lit(d).alias("description"),
                               F.lit(i).cast("long").alias("op_no"))
                      for i, (n, a, g, _, d) in enumerate(fixed.SEED_CHARACTERS)])
    return books.select("book_id", F.explode(seeds).alias("s")).select(
        "book_id", F.lit(-1).cast("long").alias("batch_no"), "s.op_no",
        F.lit("insert").alias("operation"), "s.name",
        F.lit(None).cast("string").alias("existing_name"), "s.age", "s.gender", "s.description")


def apply_char_ops(ops: DataFrame, mode: str = "hash") -> DataFrame:
    """Registry after all insert, update and merge operations.

    A merge renames: the new name builds on the old one's values, so names tied by merges must
    be folded in order, together. All other names are independent of each other and come from
    one aggregation, however many operations a book or a name has.
    """
    tidy = clean_names(ops)
    tidy = tidy.unionByName(seed_ops(tidy.select("book_id").distinct())).withColumns(
        {"batch_no": F.col("batch_no").cast("long"), "op_no": F.col("op_no").cast("long")})
    # Read by several passes, and by every round of the family search only as edges.
    tidy = stage(tidy, "ops")
    families = merge_families(tidy)
    alone = upsert_latest(
        tidy.join(families, ["book_id", "name"], "left_anti")
        # A merge that ties no names: without a valid old name it is skipped, onto itself it is
        # an update.
        .where((F.col("operation") != "merge") | (F.col("existing_name") == F.col("name")))
        .where((F.col("operation") != "merge") | ~F.col("name").isin(fixed.NO_NAME))
        .withColumn("operation", F.when(F.col("operation") == "merge", "update")
                    .otherwise(F.col("operation"))))
    tied = (tidy.join(families, ["book_id", "name"])
            .repartition("book_id", "family")
            .sortWithinPartitions("book_id", "family", "batch_no", "op_no")
            .mapInPandas(fold_families, REGISTRY))
    return with_scores(alone.unionByName(tied), mode)


def with_scores(registry: DataFrame, mode: str = "hash") -> DataFrame:
    """The narrator keeps its seed's score 0 until an operation changes it."""
    seed = (F.col("name") == "narrator") & (F.col("last_batch") == -1)
    score = F.when(seed, F.lit(fixed.SEED_CHARACTERS[0][3])).otherwise(
        gender_score("age", "gender", mode))
    return registry.withColumn("gender_score", score)


# Order of first sight. Blocks hold the characters first seen in 1,024 batches.
SEEN = ["seen_batch", "seen_op"]
SEEN_BATCHES = 1 << 10


def in_parts(df: DataFrame, text: Column, joined: str, out: str, part_rows: int) -> DataFrame:
    """Per-book text from ordered rows, cut into parts of `part_rows` rows.

    A usual book has one part, number 0. One with a huge roster never becomes one string; `join_parts` makes
    it one for readers that need it.
    """
    one = F.lit(1).cast("bigint")
    placed = running(df, KEYS, SEEN, {"__n": SumBefore(one)}, SEEN_BATCHES).withColumn(
        "__text", text)
    grouped = placed.groupBy(
        "book_id", F.floor(F.col("__n") / part_rows).cast("bigint").alias("part_no")).agg(
        F.sort_array(F.collect_list(F.struct("__n", "__text"))).alias("__l"))
    return grouped.select("book_id", "part_no", F.array_join(
        F.transform("__l", lambda r: r["__text"]), joined).alias(out))


def join_parts(parts: DataFrame, out: str, joined: str = "\n") -> DataFrame:
    """One text per book from the parts of `in_parts`; the caller knows that a book's text fits a row."""
    ordered = F.sort_array(F.collect_list(F.struct("part_no", out)))
    return parts.groupBy("book_id").agg(F.array_join(F.transform(ordered, lambda p: p[out]), joined).alias(out))


def roster_text(characters: DataFrame, part_rows: int) -> DataFrame:
    """`- name: description (Age: a, Gender: g)` lines without the narrator, as first seen, in parts of `part_rows`."""
    line = F.concat(
        F.lit("- "), F.col("name"), F.lit(": "),
        F.coalesce("description", F.lit("No description")), F.lit(" (Age: "),
        F.coalesce("age", F.lit("unknown")), F.lit(", Gender: "),
        F.coalesce("gender", F.lit("unknown")), F.lit(")"))
    books = characters.select("book_id").distinct()
    listed = in_parts(characters.where(F.col("name") != "narrator"), line, "\n", "roster", part_rows)
    return books.join(listed, "book_id", "left").select(
        "book_id", F.coalesce("part_no", F.lit(0)).alias("part_no"),
        F.coalesce("roster", F.lit(fixed.NO_CHARACTERS)).alias("roster"))


def valid_names_text(characters: DataFrame, part_rows: int) -> DataFrame:
    """Numbered list: narrator, unknown, then the book's characters as first seen, in parts of `part_rows`.

    A registry holds `unknown` from the start, so it comes twice, as in the lists that models
    were given so far.
    """
    books = characters.select("book_id").distinct()
    first = books.select("book_id", F.posexplode(F.array(F.lit("narrator"), F.lit("unknown")))
                         .alias("seen_op", "name")).select(
        "book_id", "name", F.lit(-2).cast("bigint").alias("seen_batch"),
        F.col("seen_op").cast("bigint").alias("seen_op"))
    rest = characters.where(F.col("name") != "narrator").select("book_id", "name", *SEEN)
    numbered = F.concat((F.col("__n") + 1).cast("string"), F.lit(". "), F.col("name"))
    return in_parts(first.unionByName(rest), numbered, "\n", "names", part_rows)


def prompt_table(df: DataFrame, kind: str, key: Column, text: Column,
                 tokens=token_count, counted: Column | None = None) -> DataFrame:
    """One request per row: book, kind, key, user text and its token count, which may be `counted` already."""
    said = [F.lit(kind).alias("kind"), key.alias("key"), text.alias("user_text")]
    if counted is not None:
        return df.select("book_id", *said, counted.cast("bigint").alias("tokens"))
    return df.select("book_id", *said).withColumn("tokens", tokens("user_text"))


#: wordings of requests; callers give their own, with the same places in braces
EXTRACT = "Who appears in this passage?\n\n[passage]\n{text}\n[end]"
MATCH = "Who speaks the line between?\n\n[before]\n{before}\n\n[line]\n{line}\n\n[after]\n{after}\n[end]"
TAG = "[lines]\n{lines}\n[end]"


def places(template: str) -> list[str]:
    """The template cut at its places: text, name, text, name, ..., text."""
    return re.split(r"\{(\w+)\}", template)


def filled(template: str, **values) -> Column:
    """The template with a column at each of its places. Values that hold braces stay as they are."""
    parts = places(template)
    if unknown := set(parts[1::2]) - set(values):
        raise ValueError(f"no value for {', '.join(sorted(unknown))}")
    return F.concat(*(column(values[p]) if i % 2 else F.lit(p) for i, p in enumerate(parts)))


def filled_tokens(template: str, tokens=token_count, **counts) -> Column:
    """Tokens of a filled template from the counts of its values, for counts in which white space divides tokens.

    Each place must lie between white space or the template's ends, so that no token is part text and part value.
    """
    parts = places(template)
    edges = [t[-1:] for t in parts[0:-1:2]] + [t[:1] for t in parts[2::2]]
    if any(e and not e.isspace() for e in edges) or "" in parts[2:-1:2]:
        raise ValueError("places must lie between white space")
    total = F.lit(0).cast("bigint")
    for i, p in enumerate(parts):
        total = total + (column(counts[p]) if i % 2 else tokens(F.lit(p)))
    return total


def extraction_text(text, template: str = EXTRACT) -> Column:
    return filled(template, text=text)


def matching_text(before, dialogue, after, template: str = MATCH) -> Column:
    return filled(template, before=before, line=dialogue, after=after)


def tagging_text(paragraphs, template: str = TAG) -> Column:
    return filled(template, lines=paragraphs)


def run_rowwise(df: DataFrame, fn: Callable[[list[str]], list[str]], text: str = "user_text",
                key=("book_id", "key"), partitions: int | None = None, batch_rows: int = 256) -> DataFrame:
    """Applies a caller's function to batches of requests: key columns, response, error.

    A batch that fails is tried again in halves, so one bad request costs its own answer and a call for
    each halving. `batch_rows` bounds a call, `partitions` how many calls run at once. Stage the result before
    reading it more than once, or the calls are made again; `answers.ask` keeps answers in a log.
    """
    from pyspark.sql.types import StringType, StructField, StructType

    rows = df.select(*key, text)
    if partitions:
        rows = rows.repartition(partitions)
    out = StructType([df.schema[k] for k in key]
                     + [StructField("response", StringType()), StructField("error", StringType())])
    names = [*key, "response", "error"]

    def apply(frames):
        for frame in frames:
            texts = frame[text].tolist()
            pairs = [p for i in range(0, len(texts), batch_rows) for p in in_halves(fn, texts[i:i + batch_rows])]
            answered = frame[list(key)].copy()
            answered["response"] = [p[0] for p in pairs]
            answered["error"] = [p[1] for p in pairs]
            yield answered[names]

    return rows.mapInPandas(apply, out)


def attribution_stats(script: DataFrame, characters: DataFrame) -> DataFrame:
    """Per book: items, attributed lines, distinct speakers, speakers not in the registry.

    Lines are first counted per speaker, so a book's many rows meet as few.
    """
    spoken = script.groupBy("book_id", F.col("speaker").alias("name")).agg(
        F.count(F.lit(1)).alias("n"))
    names = characters.select("book_id", "name", F.lit(1).alias("listed")).distinct()
    both = spoken.join(names, ["book_id", "name"], "full")
    return both.groupBy("book_id").agg(
        F.count_if(F.col("listed").isNotNull()).alias("in_registry"),
        F.count_if(F.col("listed").isNotNull() & ~F.col("name").isin("narrator", "unknown"))
        .alias("characters"),
        F.count_if(F.col("n").isNotNull()).alias("speakers"),
        F.count_if(F.col("n").isNotNull() & F.col("listed").isNull()).alias("invalid_speakers"),
        F.coalesce(F.sum(F.when(F.col("name") != "narrator", F.col("n"))), F.lit(0))
        .alias("attributed_lines"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("items"))
