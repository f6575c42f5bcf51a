"""What must not grow faster than the input: broadcasts of listed rows, repeated passes, copies of blocks."""

import pytest
from pyspark.sql import functions as F

from catalog import manuscripts as queries
from scriptmill.functions import clean, tagging
from scriptmill.functions.tokens import token_count
from scriptmill.operators import answers, budgets, manuscripts, registry, tags, windows
from scriptmill.plans import narration
from scriptmill.session import new_path


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def lines_of_book(spark, n, text="concat('word ', id, ' <laugh>')"):
    return spark.range(n).select(F.lit("b").alias("book_id"), F.col("id").alias("line_no"), F.expr(text).alias("line"))


def test_group_text_lists_no_positions_in_a_broadcast(spark):
    lines = lines_of_book(spark, 3000)
    made = budgets.chunk_by_tokens(lines, ["book_id"], "line_no", "line", 1000)
    text = budgets.group_text(lines, made, ["book_id"], "line_no", "line", "chunk_no")
    joined = [r for r in plan_of(text).splitlines() if "Join" in r and "line_no#" in r]
    assert joined and all("SortMergeJoin" in r for r in joined)
    assert sorted(text.agg(F.sum(F.size(F.split("text", "\n")))).first()) == [3000]


def test_window_lines_lists_no_lines_in_a_broadcast(spark):
    lines = lines_of_book(spark, 50, "if(id % 9 = 0, 'a laugh', 'plain')")
    inside = windows.window_lines(lines, windows.emotion_windows(lines, 2))
    assert "SortMergeJoin" in plan_of(inside).split("Exchange")[0]
    assert inside.columns == ["book_id", "line_no", "line", "window_no", "opens"]


def test_pairs_are_made_once(spark):
    made = str(clean.parse_key_values("x")._jc.toString())
    assert made.count("split(") == 1
    tagged = str(narration.metadata_tags(clean.parse_key_values("x"))._jc.toString())
    assert tagged.count("split(") == 1


def test_last_value_of_a_key_in_order_of_its_line(apply):
    got = apply(lambda x: F.map_entries(clean.parse_key_values(x)), ["a: 1\nb: 2\nnone\na: 3\nc: 4\nb: ", "no pair"])
    assert [[tuple(e) for e in m] for m in got] == [[("a", "3"), ("c", "4"), ("b", "")], []]


def test_tags_of_a_text_are_found_once():
    assert str(tagging.reject_reason("x", "y")._jc.toString()).count("<[^>]+>") == 1


def test_a_text_that_came_back_is_still_judged(apply):
    got = apply(tagging.reject_reason, [("a &lt;b", "a &lt;b"), ("a > b", "a > b"), ("a <laugh>", "a <laugh>"),
                                        ("a", "a"), ("a b", "a c")], "x string, y string")
    assert got == ["HTML entities found in emotion tags", "Malformed emotion tags found",
                   "Text content was modified beyond adding tags.", None, "Text content was modified beyond adding tags."]


def chunk(book, start, text):
    return (book, start, start + len(text.split("\n")), text)


def test_reassemble_goes_through_chunks_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(frames):
        for frame in frames:
            seen.add(len(frame))
            yield frame

    lines = spark.createDataFrame([(b, i, f"{b}{i}") for b in "xyz" for i in range(4)], "book_id string, line_no long, line string")
    made = spark.createDataFrame([chunk("x", 0, "X0\nX1"), chunk("y", 1, "Y1\nY2"), chunk("y", 2, "YY2"), chunk("z", 9, "Z9"),
                                  chunk("z", 9, "Z9")], "book_id string, start_line long, end_line long, text string")
    out = tags.reassemble(lines, made.mapInPandas(counted, made.schema)).orderBy("book_id", "line_no").collect()
    assert seen.value == 5
    assert [r.line for r in out] == ["X0", "X1", "x2", "x3", "y0", "y1", "y2", "y3", "z0", "z1", "z2", "z3"]
    # lines given twice that the book doesn't have are no overlap
    assert [r.book_id for r in out if r.message == tags.OVERLAP] == ["y"] * 4
    assert [r.replaced for r in out] == [True, True] + [False] * 10


def test_ask_moves_only_answers_it_needs(spark):
    log = new_path(spark, "answer-log")

    def requests(*texts):
        return spark.createDataFrame([(t,) for t in texts], "user_text string")

    answers.ask(requests("a", "b", "b", None), lambda ts: [t.upper() for t in ts], log, partitions=2).collect()
    held = answers.logged(spark, log, answers.logged_digests(spark, log).limit(0))
    assert held.count() == 0 and answers.logged(spark, log).count() == 2
    again = answers.ask(requests("b", "c", "c"), lambda ts: [t * 2 for t in ts], log, partitions=2).collect()
    assert sorted((r.user_text, r.response, r.error) for r in again) == [("b", "B", None), ("c", "cc", None), ("c", "cc", None)]


def test_texts_of_paragraphs_move_once_after_they_are_numbered(spark):
    lines = lines_of_book(spark, 40, "if(id % 5 = 4, '', concat('l', id))")
    joined = manuscripts.join_paragraph_lines(lines)
    conf = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        top = plan_of(manuscripts.join_paragraph_lines(lines)).split("SortMergeJoin")[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", conf)
    assert "Exchange" not in top
    assert joined.count() == 16


def test_contexts_are_made_without_a_copy_of_the_block(spark):
    items = lines_of_book(spark, 6, "concat('say ', id, '.')").select(
        "book_id", F.col("line_no").alias("item_no"), F.when(F.col("line_no") % 2 == 1, "dialogue").otherwise(
            "narrator").alias("type"), F.col("line").alias("content"), F.col("line").alias("original_line"),
        F.lit("mia").alias("speaker"))
    found = windows.current_line_context(windows.dialogue_context(items, max_tokens=8, limit=2, counts=True))
    assert "posexplode" not in plan_of(found)
    counts = registry.filled_tokens(registry.MATCH, before="tokens_before", line="tokens_content", after="tokens_after")
    asked = registry.prompt_table(found, "match", F.col("item_no"), registry.matching_text(
        "context_before", "content", "context_after"), counted=counts)
    rows = asked.select("tokens", token_count("user_text").alias("whole")).collect()
    assert len(rows) == 3 and all(r.tokens == r.whole for r in rows)


def test_places_inside_words_have_no_sum():
    with pytest.raises(ValueError):
        registry.filled_tokens("a{x}", x=F.lit(1))


def test_split_back_joins_paragraphs_once(spark):
    plan = plan_of(queries.split_back(spark, "/root/testdata/sf0.001"))
    assert "collect_list" not in plan
