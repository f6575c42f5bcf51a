"""The character registry against a plain fold, in batch and as a stream."""

import random

import pytest
from pyspark.sql import functions as F

from scriptmill import fixed
from scriptmill.operators import registry
from scriptmill.operators.registry import OPS
from scriptmill.session import new_path
from scriptmill.streaming import streams

SCHEMA = ("book_id string, batch_no long, op_no long, operation string, name string, existing_name string, "
          "age string, gender string, description string")


def fold(ops):
    """name -> (age, gender, description) and the order names were first seen in."""
    chars = {n: (a, g, d) for n, a, g, _, d in fixed.SEED_CHARACTERS}
    for batch in sorted({o["batch_no"] for o in ops}):
        updates, renamed = {}, {}
        for o in sorted((o for o in ops if o["batch_no"] == batch), key=lambda o: o["op_no"]):
            name = o["name"].strip().lower()
            old_name = (o["existing_name"] or "").strip().lower()
            new = (o["age"], o["gender"], o["description"])
            if not name:
                continue
            as_update = o["operation"] == "update"
            if o["operation"] == "merge":
                if old_name in ("", "none", "null", "n/a", "unknown"):
                    continue
                if old_name == name:
                    as_update = True
                elif old_name in chars:
                    renamed[old_name] = name
                    age, gender, text = chars[old_name]
                    new = (new[0], gender if new[1] == "unknown" else new[1],
                           new[2] if len(new[2]) > len(text) else f"{text} {new[2]}".strip())
                else:
                    continue
            if as_update and name in chars:
                age, gender, text = chars[name]
                new = (age, new[1] if gender == "unknown" else gender,
                       new[2] if len(new[2]) > len(text) else text)
            updates[name] = new
        for old in renamed:
            updates.pop(old, None)
            chars.pop(old, None)
        chars.update(updates)
    return chars


def random_ops(rng, book, names, n, merges):
    kinds = ["insert", "update", "update"] + ["merge"] * merges
    return [dict(zip(OPS, (
        book, i // 3, i, rng.choice(kinds), rng.choice(names), rng.choice([*names, None, "none", "narrator"]),
        rng.choice(fixed.AGES), rng.choice(fixed.GENDERS), "d" * rng.randint(0, 6)))) for i in range(n)]


@pytest.fixture(scope="module")
def books():
    rng = random.Random(7)
    made = {}
    for k in range(25):
        names = ["a", "b", " C", "unknown", "e f", "narrator"][:rng.randint(2, 6)]
        made[f"b{k}"] = random_ops(rng, f"b{k}", names, rng.randint(1, 24), k % 3)
    return made


def as_dict(rows):
    out = {}
    for r in rows:
        out.setdefault(r["book_id"], {})[r["name"]] = (r["age"], r["gender"], r["description"])
    return out


def frame(spark, books):
    return spark.createDataFrame([tuple(o[c] for c in OPS) for ops in books.values() for o in ops], SCHEMA)


def test_apply_char_ops_matches_a_fold(spark, books):
    rows = registry.apply_char_ops(frame(spark, books)).collect()
    assert as_dict(rows) == {b: fold(ops) for b, ops in books.items()}
    # First-seen order is the order a plain map of characters would have.
    for book, ops in books.items():
        mine = sorted((r for r in rows if r["book_id"] == book), key=lambda r: (r["seen_batch"], r["seen_op"]))
        assert [r["name"] for r in mine] == list(fold(ops)), book


def test_narrator_score_is_the_seed_until_changed(spark):
    ops = [("b", 0, 0, "insert", "x", None, "adult", "male", "d"),
           ("c", 0, 0, "update", "narrator", None, "adult", "male", "d")]
    rows = registry.apply_char_ops(spark.createDataFrame(ops, SCHEMA), "min").collect()
    assert {(r["book_id"], r["gender_score"]) for r in rows if r["name"] == "narrator"} == {("b", 0), ("c", 7)}


def test_families_follow_chains_and_stay_in_their_book(spark):
    def merge(book, name, old):
        return (book, 0, 0, "merge", name, old, "adult", "male", "")

    ops = [merge("b", f"n{i + 1:02}", f"n{i:02}") for i in range(12)] + [
        merge("b", "x", "y"), merge("c", "n01", "n02"), merge("b", "z", "z"), merge("b", "q", "none")]
    got = {(r["book_id"], r["name"]): r["family"]
           for r in registry.merge_families(spark.createDataFrame(ops, SCHEMA)).collect()}
    assert {got["b", f"n{i:02}"] for i in range(13)} == {"n00"}
    assert got["b", "x"] == got["b", "y"] == "x" and got["c", "n01"] == got["c", "n02"] == "n01"
    assert ("b", "z") not in got and ("b", "q") not in got


def test_stream_of_char_ops_equals_batch(spark, books):
    path = new_path(spark, "ops")
    ops = frame(spark, books)
    for k in range(4):  # files in order of batches, read one per trigger
        ops.where((F.col("batch_no") >= 2 * k) & ((F.col("batch_no") < 2 * k + 2) | F.lit(k == 3))).coalesce(
            1).write.mode("append").parquet(path)
    stream = streams.table_stream(spark, path, files_per_trigger=1)
    changes = streams.run_available(streams.char_ops_stream(stream), "registry")
    rows = streams.latest_registry(changes).collect()
    assert as_dict(rows) == {b: fold(ops) for b, ops in books.items()}


def test_check_enums(spark):
    ops = spark.createDataFrame([("b", 0, 0, "insert", "x", None, "adult", "male", ""),
                                 ("b", 0, 1, "drop", "x", None, "old", None, "")], SCHEMA)
    good, bad = registry.check_enums(ops)
    assert good.count() == 1 and bad.first()["invalid"] == "operation, age, gender"


CHARS = "book_id string, name string, age string, gender string, description string, seen_batch long, seen_op long"


def test_rosters(spark):
    chars = spark.createDataFrame([
        ("b", "narrator", "adult", "female", "tells", -1, 0), ("b", "zed", "child", "male", "small", 0, 1),
        ("b", "amy", "adult", "female", None, 0, 0), ("c", "narrator", "adult", "female", "tells", -1, 0)], CHARS)
    assert {(r["book_id"], r["roster"]) for r in registry.roster_text(chars, 100).collect()} == {
        ("b", "- amy: No description (Age: adult, Gender: female)\n- zed: small (Age: child, Gender: male)"),
        ("c", "No characters identified yet.")}
    assert {(r["book_id"], r["names"]) for r in registry.valid_names_text(chars, 100).collect()} == {
        ("b", "1. narrator\n2. unknown\n3. amy\n4. zed"), ("c", "1. narrator\n2. unknown")}


def test_long_rosters_come_in_parts(spark):
    chars = spark.range(25).select(F.lit("b").alias("book_id"), F.col("id").alias("seen_batch"),
                                   F.lit(0).cast("long").alias("seen_op"), F.col("id").cast("string").alias("name"))
    parts = registry.in_parts(chars, F.col("name"), ",", "t", part_rows=10).orderBy("part_no").collect()
    assert [r["t"] for r in parts] == [",".join(map(str, range(a, min(a + 10, 25)))) for a in (0, 10, 20)]


def test_run_rowwise_isolates_failures(spark):
    def answer(texts):
        return [str(10 // int(t)) for t in texts]

    df = spark.createDataFrame([("b", i, str(i)) for i in range(4)], "book_id string, key long, user_text string")
    got = {r["key"]: (r["response"], r["error"])
           for r in registry.run_rowwise(df, answer, partitions=2).collect()}
    assert [got[i][0] for i in range(4)] == [None, "10", "5", "3"]
    assert got[0][1].startswith("ZeroDivisionError") and got[1][1] is None


def test_attribution_stats(spark):
    script = spark.createDataFrame([("b", i, s, "x") for i, s in enumerate(["narrator", "amy", "amy", "bob"])],
                                   "book_id string, item_no long, speaker string, line string")
    chars = spark.createDataFrame([("b", n) for n in ("narrator", "unknown", "amy")], "book_id string, name string")
    assert registry.attribution_stats(script, chars).first().asDict() == {
        "book_id": "b", "in_registry": 3, "characters": 1, "speakers": 3, "invalid_speakers": 1,
        "attributed_lines": 3, "items": 4}


def test_stream_takes_batches_in_pieces(spark):
    """One batch in two files gives the same registry whether its files come in one trigger or in two."""
    first = [("b", 0, 0, "insert", "x", None, "adult", "unknown", "first"), ("b", 1, 0, "insert", "y", None, "child", "male", "a")]
    second = [("b", 1, 1, "update", "y", None, "adult", "female", "a longer text"),
              ("b", 1, 2, "merge", "z", "x", "adult", "male", "z"), ("b", 0, 9, "insert", "late", None, "adult", "male", "")]
    want = None
    for per_trigger in (1, 64):
        path = new_path(spark, "pieces")
        for ops in (first, second):
            spark.createDataFrame(ops, SCHEMA).coalesce(1).write.mode("append").parquet(path)
        changes = streams.run_available(streams.char_ops_stream(streams.table_stream(spark, path, per_trigger)), "registry")
        rows = {r["name"]: (r["age"], r["gender"], r["description"]) for r in streams.latest_registry(changes).collect()}
        late = [(r["batch_no"], r["op_no"]) for r in streams.late_ops(changes).collect()]
        rows.pop("late", None)
        want = want or rows
        assert rows == want and "x" not in rows and "z" in rows
        assert late == ([(0, 9)] if per_trigger == 1 else [])


def test_null_descriptions_are_empty(spark, books):
    """In names of their own and in merge families alike."""
    bare = {k: [{**o, "description": None if len(o["description"]) < 3 else o["description"]} for o in ops]
            for k, ops in books.items()}
    empty = {k: [{**o, "description": o["description"] or ""} for o in ops] for k, ops in bare.items()}
    got = as_dict(registry.apply_char_ops(frame(spark, bare)).collect())
    assert got == {k: fold(ops) for k, ops in empty.items()}
