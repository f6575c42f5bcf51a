"""What the tagging round trip makes, stages and moves once, and that its short ways give what the long ones do."""

import itertools
import os
import time

import pytest
from pyspark.sql import functions as F

from scriptmill import fixed, session
from scriptmill.functions import clean, paragraphs, segment, tagging
from scriptmill.functions.chars import WORD, WS, WS_CHARS
from scriptmill.operators import answers, budgets, roundtrip, tags
from scriptmill.session import new_path

CHUNKS = "book_id string, chunk_no long, start_line long, end_line long, original string"


@pytest.fixture
def staged(monkeypatch):
    """(label, columns) of the tables that modules of the round trip stage."""
    seen = []
    for module in (answers, roundtrip, tags):
        def record(df, label, made=module.stage, **more):
            seen.append((label, df.columns))
            return made(df, label, **more)

        monkeypatch.setattr(module, "stage", record)
    return seen


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def round_trip(spark):
    lines = spark.createDataFrame([("b", i, f"line number {i} is here") for i in range(6)],
                                  "book_id string, line_no long, line string")
    chunks = spark.createDataFrame([("b", 0, 1, 3, "line number 1 is here\nline number 2 is here"),
                                    ("b", 1, 4, 5, "line number 4 is here")], CHUNKS)
    log = new_path(spark, "answer-log")

    def model(texts):
        return [b + (" no" if "|||" in b else " <laugh>") for b in (t.split("\n")[1] for t in texts)]

    return roundtrip.tag_lines(lines, chunks, lambda asked: answers.ask(asked, model, log, partitions=2))


def test_between_the_rounds_a_chunk_is_one_text(spark, staged):
    got = {r["line_no"]: (r["line"], r["replaced"], r["message"]) for r in round_trip(spark).collect()}
    assert got == {i: (f"line number {i} is here" + (" <laugh>" if i in (1, 2, 4) else ""), i in (1, 2, 4), None)
                   for i in range(6)}
    assert [label for label, _ in staged] == ["chunks", "answers-new", "checked", "answers-found", "answers-known",
                                              "answers-new", "tagged-lines", "twice"]
    assert dict(staged)["checked"] == ["book_id", "chunk_no", "start_line", "end_line", "text", "reverted"]


def test_what_a_round_stages_goes_after_it(spark, monkeypatch):
    made = []
    for module in (answers, roundtrip, tags):
        def record(df, label, kept=module.stage, **more):
            made.append((label, out := kept(df, label, **more), out.inputFiles()))
            return out

        monkeypatch.setattr(module, "stage", record)
    out = round_trip(spark)
    left = {label for label, _, files in made if files and os.path.exists(files[0].removeprefix("file://"))}
    assert left == {"tagged-lines"} and out.where("replaced").count() == 3


def test_shuffles_of_a_staged_table_go_with_its_write(spark):
    def shuffles():
        root = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
        return sum(name.startswith("shuffle_") for place in root for _, _, names in os.walk(place) for name in names)

    before, setting = shuffles(), spark.conf.get(session.CLEANUP)
    table = spark.range(100).repartition(3, "id").groupBy("id").count()
    staged = session.stage(table, "counts")
    for _ in range(50):  # files are deleted in the background
        if shuffles() <= before:
            break
        time.sleep(0.1)
    assert shuffles() <= before and spark.conf.get(session.CLEANUP) == setting and staged.count() == 100
    with session._shuffles_go(spark), session._shuffles_go(spark):
        assert spark.conf.get(session.CLEANUP) == "true"
    assert spark.conf.get(session.CLEANUP) == setting and table.count() == table.count() == 100


def test_a_new_log_is_not_searched(spark, staged):
    asked = spark.createDataFrame([("a",), ("a",), (None,)], "user_text string")
    log = new_path(spark, "answer-log")
    got = answers.ask(asked, lambda ts: [t.upper() for t in ts], log, partitions=2).collect()
    assert sorted((r["user_text"] or "", r["response"], r["error"]) for r in got) == [
        ("", None, "No request"), ("a", "A", None), ("a", "A", None)]
    assert [label for label, _ in staged] == ["answers-new"]
    answers.ask(asked, lambda ts: ["x"] * len(ts), log, partitions=2)
    assert [label for label, _ in staged][1:] == ["answers-found", "answers-known", "answers-new"]


def test_batches_of_a_call_are_as_long_as_asked(spark, tmp_path):
    def fn(texts):
        with open(tmp_path / "sizes", "a") as out:
            out.write(f"{len(texts)}\n")
        return [t * 2 for t in texts]

    asked = spark.createDataFrame([(f"t{i}",) for i in range(11)], "user_text string")
    got = answers.ask(asked, fn, f"{tmp_path}/log", partitions=1, batch_rows=4).collect()
    assert {r["user_text"]: r["response"] for r in got} == {f"t{i}": f"t{i}" * 2 for i in range(11)}
    assert (tmp_path / "sizes").read_text().split() == ["4", "4", "3"]


def test_texts_of_tagged_lines_move_for_their_join_only(spark, staged, monkeypatch):
    lines = spark.createDataFrame([(b, i, f"{b}{i}") for b in "xy" for i in range(3)], "book_id string, line_no long, line string")
    made = spark.createDataFrame([("x", 0, 2, "X0\nX1"), ("x", 7, 8, "X7"), ("x", 7, 8, "X7"), ("y", 1, 3, "only one")],
                                 "book_id string, start_line long, end_line long, text string")
    plans = []
    recorded = tags.stage
    monkeypatch.setattr(tags, "stage", lambda df, label, **more: plans.append((label, plan_of(df))) or recorded(
        df, label, **more))
    out = tags.reassemble(lines, made.repartition(3)).orderBy("book_id", "line_no").collect()
    assert [r["line"] for r in out] == ["X0", "X1", "x2", "y0", "y1", "y2"]
    assert [r["replaced"] for r in out] == [True, True] + [False] * 4 and {r["message"] for r in out} == {None}
    assert "hashpartitioning(book_id" not in dict(plans)["tagged-lines"]


def test_sizes_of_a_text_are_made_once():
    assert str(roundtrip.answer_lines("x", "y")._jc.toString()).count("y+|n") == 1


def test_pieces_hold_no_copy_of_their_block(spark):
    packed = spark.createDataFrame([("b", 0, [0, 1, 2, 3], [5, 5, 5, 5], [], False, 0), ("b", 1, [4, 5], [5, 9], [1], False, 6)],
                                   "k string, __block long, pos array<long>, tokens array<long>, breaks array<int>, closed boolean, entry int")
    pieces = budgets._pieces(packed, ["k"], budgets.Chunks(10))
    assert sorted(tuple(r) for r in pieces.collect()) == [
        ("b", 0, 1, 2, 10, 1), ("b", 2, 3, 2, 10, 1), ("b", 4, 4, 1, 5, 0), ("b", 5, 5, 1, 9, 1)]
    assert "posexplode" not in plan_of(pieces)


LINES = ["", " ", "a", "a ", "\tb", "\x85", " c\x1f", "d\r"]


def test_joined_paragraphs_of_all_kinds_of_lines(apply):
    texts = ["\n".join(ls) for n in (1, 2, 3) for ls in itertools.product(LINES, repeat=n)]

    def joined(text):
        out = ""
        lines = text.split("\n")
        for line, after in itertools.zip_longest(lines, lines[1:]):
            marked = after is not None and line.strip(WS_CHARS) and after.strip(WS_CHARS)
            out += line + ("" if after is None else fixed.LINE_MARKER if marked else "\n")
        return out

    assert apply(paragraphs.join_paragraphs, [*texts, None]) == [*map(joined, texts), None]


PIECES = ["a", "é", "\U0001d49c", " ", "\n", " ", "<sigh>", "<b>", "<", ">", "&lt;", "think>", '"']


def test_short_ways_give_what_the_long_ones_do(spark):
    """Texts of up to three pieces, by the patterns alone and by the functions that search plainly first."""
    texts = ["".join(p) for n in (0, 1, 2, 3) for p in itertools.product(PIECES, repeat=n)]
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "x string").coalesce(1)
    bare = F.regexp_replace("x", rf"{clean.TAG}[{WS}]*", "")
    kinds = "|".join(fixed.EMOTIONS)
    pairs = {
        "tag": (clean.has_emotion_tag("x"), F.col("x").rlike(clean.TAG)),
        "bare": (clean.strip_emotion_tags("x"), bare),
        "broken": (F.coalesce(tagging.reject_reason("x", F.regexp_replace("x", clean.TAG, "")), F.lit("")) ==
                   "Emotion tags breaking words detected",
                   F.col("x").rlike(rf"[{WORD}]<(?:{kinds})>[{WORD}]") & ~F.col("x").rlike(r"<b>|<[^>]*\z|\A[^<]*>|&lt;")
                   & ~F.col("x").rlike(r"<(?!sigh>)[^>]+>") & (F.size(F.split(bare, "\n")) == F.size(F.split(
                       F.regexp_replace("x", clean.TAG, ""), "\n")))),
        "kept": (tagging.reject_reason("x", "x"), tagging._first_broken(F.col("x"), F.col("x"), tagging.found_tags("x"))),
    }
    rows = df.select("x", *[F.struct(a.alias("a"), b.alias("b")).alias(k) for k, (a, b) in pairs.items()]).collect()
    for row in rows:
        for kind in pairs:
            assert row["x"] is None and kind == "broken" or row[kind]["a"] == row[kind]["b"], (row["x"], kind)
    assert any(r["broken"]["a"] for r in rows) and sum(r["kept"]["a"] is None for r in rows) > 100


def test_white_space_of_all_kinds_does_not_count(apply):
    got = apply(tagging.reject_reason, [("a b c", "ab\tc"), ("a b c <sigh>", "a b c"), ("a b", "a c"),
                                        ("a b", "ab")], "x string, y string")
    assert got == [None, None, "Text content was modified beyond adding tags.", None]


def test_keywords_in_any_case_and_place(apply):
    cases = {"A LAUGH.": True, "laughs": True, "slaughter": False, "Sighing": True, "élaugh": False, "(gasped)": True,
             "yawny": False, "cough": True, "": False, "chuckle_": False}
    assert apply(segment.has_emotion_keyword, list(cases)) == list(cases.values())
