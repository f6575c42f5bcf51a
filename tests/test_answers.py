"""The log of answers and the tagging round trip."""

import subprocess
import sys
from collections import Counter
from pathlib import Path

import pytest

from scriptmill.operators import answers, roundtrip

ROOT = Path(__file__).resolve().parents[1]
CHUNKS = "book_id string, chunk_no long, start_line long, end_line long, original string"


def requests(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "k int, user_text string")


def counting(folder):
    """Upper case, with a file that says which texts were asked; texts with a bar fail."""
    def fn(texts):
        if any("|" in t for t in texts):
            raise ValueError("no bars")
        with open(f"{folder}/calls", "a") as out:
            out.writelines(f"{t}\n" for t in texts)
        return [t.upper() for t in texts]
    return fn


def calls(folder):
    path = Path(folder) / "calls"
    return Counter(path.read_text().split("\n")[:-1]) if path.exists() else Counter()


def test_each_text_is_asked_once(spark, tmp_path):
    fn, log = counting(tmp_path), f"{tmp_path}/log"
    texts = [f"t{i % 7}" for i in range(20)] + ["a|b", "", None]
    got = {r["k"]: (r["response"], r["error"]) for r in answers.ask(
        requests(spark, texts), fn, log, partitions=3, batch_rows=2).collect()}
    assert {k: v for k, v in got.items() if k < 20} == {i: (f"T{i % 7}", None) for i in range(20)}
    assert got[20] == (None, "ValueError: no bars") and got[21] == ("", None) and got[22] == (None, "No request")
    assert calls(tmp_path) == Counter({**{f"t{i}": 1 for i in range(7)}, "": 1})
    # A later run asks what is new and what failed; another model has answers of its own.
    more = answers.ask(requests(spark, [*texts, "t9"]), lambda ts: ["new"] * len(ts), log, partitions=2).collect()
    assert {r["k"]: r["response"] for r in more} == {
        **{k: v[0] for k, v in got.items() if k < 20}, 20: "new", 21: "", 22: None, 23: "new"}
    other = answers.ask(requests(spark, ["t0"]), lambda ts: ["mine"] * len(ts), log, model="other").collect()
    assert [r["response"] for r in other] == ["mine"]
    assert not (tmp_path / "log" / "open").exists()


def test_no_requests_make_no_calls(spark, tmp_path):
    got = answers.ask(requests(spark, []), counting(tmp_path), f"{tmp_path}/log")
    assert got.columns == ["k", "user_text", "response", "error"] and got.collect() == []
    assert not calls(tmp_path)


def test_a_lost_run_goes_on_where_it_stopped(spark, tmp_path):
    count, log = counting(tmp_path), f"{tmp_path}/log"
    texts = [f"t{i}" for i in range(40)]

    said = tmp_path / "calls"

    def dies(ts):
        if said.exists() and said.read_text().count("\n") >= 20:
            raise SystemExit("lost")
        return count(ts)

    with pytest.raises(Exception):
        answers.ask(requests(spark, texts), dies, log, partitions=1, batch_rows=5).collect()
    assert sum(calls(tmp_path).values()) == 20
    got = answers.ask(requests(spark, texts), count, log, partitions=1, batch_rows=5).collect()
    assert {r["k"]: r["response"] for r in got} == {i: f"T{i}" for i in range(40)}
    assert calls(tmp_path) == Counter({t: 1 for t in texts})


KILLED = """
import os, sys
sys.path[:0] = [{root!r}, {tests!r}]
from pyspark.sql import SparkSession
from scriptmill.operators import answers
from scriptmill.session import configure
spark = configure(SparkSession.builder.master("local[2,4]").config("spark.ui.enabled", "false")).getOrCreate()
folder = {folder!r}

def fn(texts):
    with open(folder + "/calls", "a") as out:
        out.writelines(t + "\\n" for t in texts)
    if "t17" in texts and not os.path.exists(folder + "/killed"):
        open(folder + "/killed", "w").close()
        os._exit(9)
    return [t.upper() for t in texts]

df = spark.createDataFrame([(i, f"t{{i}}") for i in range(40)], "k int, user_text string")
got = {{r["k"]: r["response"] for r in answers.ask(df, fn, folder + "/log", partitions=2, batch_rows=4).collect()}}
assert got == {{i: f"T{{i}}" for i in range(40)}}, got
"""


def test_a_killed_worker_repeats_its_batch_only(tmp_path):
    script = tmp_path / "killed.py"
    script.write_text(KILLED.format(root=str(ROOT), tests=str(ROOT / "tests"), folder=str(tmp_path)))
    done = subprocess.run([sys.executable, str(script)], capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert (tmp_path / "killed").exists()
    twice = [t for t, n in calls(tmp_path).items() if n > 1]
    assert max(calls(tmp_path).values()) == 2 and "t17" in twice and len(twice) <= 4


def chunk(spark, *originals):
    rows, start = [], 0
    for i, text in enumerate(originals):
        end = start + text.count("\n") + 1
        rows.append(("b", i, start, end, text))
        start = end
    return spark.createDataFrame(rows, CHUNKS)


def table_of(spark, rows, key="book_id string, chunk_no long"):
    return spark.createDataFrame(rows, f"{key}, response string")


def test_answers_become_chunks(spark):
    chunks = chunk(spark, 'He ran.\n"Stop!" said Ann.\n\nThe end of it.', "one line", "never answered", "null answer")
    asked = {r["chunk_no"]: r["user_text"] for r in roundtrip.chunk_requests(chunks).collect()}
    assert 'He ran. ||| "Stop!" said Ann.\n\nThe end of it.' in asked[0]
    responses = table_of(spark, [
        ("b", 0, '<think>a\n\nb</think>\n He ran. ||| "Stop <gasp>!" said Ann.\n\nThe end of it. \n'),
        ("b", 1, "one line more"), ("b", 3, None), ("b", 9, "no such chunk"), ("other", 0, "x")])
    got = {r["chunk_no"]: r for r in roundtrip.chunk_answers(chunks, responses).collect()}
    assert got[0]["text"] == 'He ran.\n"Stop <gasp>!" said Ann.\n\nThe end of it.' and got[0]["success"]
    assert got[1]["text"] == "one line" and got[1]["reason"] == "Text content was modified beyond adding tags."
    assert [got[i]["reason"] for i in (2, 3)] == ["No response"] * 2 and len(got) == 4


def test_reverted_chunks_ask_for_lines(spark):
    chunks = chunk(spark, "Good lines\nall of them", 'He ran a long way.\n\n"Stop!" said Ann to him.\nThe end of it all.')
    first = table_of(spark, [("b", 0, "Good lines ||| all of them"), ("b", 1, "something else")])
    checked = roundtrip.chunk_answers(chunks, first)
    asked = {(r["chunk_no"], r["at"]) for r in roundtrip.line_requests(checked).collect()}
    assert asked == {(1, 0), (1, 2), (1, 3)}
    second = table_of(spark, [("b", 1, 0, "He ran a long way. <sigh>"), ("b", 1, 2, '"Stop <gasp>!" said Ann to him.'),
                              ("b", 1, 3, "The end.")], "book_id string, chunk_no long, at int")
    got = {r["chunk_no"]: (r["text"], r["lines_tagged"]) for r in roundtrip.line_answers(checked, second).collect()}
    assert got == {0: ("Good lines\nall of them", None),
                   1: ('He ran a long way. <sigh>\n\n"Stop <gasp>!" said Ann to him.\nThe end of it all.', 2)}


def test_both_rounds_reassemble(spark, tmp_path):
    """Whole chunks fail, single lines are tagged; lines of no chunk stay."""
    lines = spark.createDataFrame([("b", i, f"line number {i} is here") for i in range(6)],
                                  "book_id string, line_no long, line string")
    chunks = spark.createDataFrame([("b", 0, 1, 3, "line number 1 is here\nline number 2 is here"),
                                    ("b", 1, 4, 5, "line number 4 is here")], CHUNKS)

    def model(texts):
        bodies = [t.split("\n")[1] for t in texts]
        return [b + (" no" if "|||" in b else " <laugh>") for b in bodies]

    def ask(asked):
        return answers.ask(asked, model, f"{tmp_path}/log", partitions=2)

    got = {r["line_no"]: (r["line"], r["replaced"]) for r in roundtrip.tag_lines(lines, chunks, ask).collect()}
    assert got == {i: (f"line number {i} is here" + (" <laugh>" if i in (1, 2, 4) else ""), i in (1, 2, 4))
                   for i in range(6)}
    empty = roundtrip.tag_lines(lines, chunks.limit(0), ask)
    assert {r["line"] for r in empty.collect()} == {f"line number {i} is here" for i in range(6)}


def test_wordings_are_the_callers(spark):
    from scriptmill.operators.registry import filled, matching_text

    df = spark.createDataFrame([("a {line} $1", "b", "c")], "x string, y string, z string")
    assert df.select(matching_text("x", "y", "z", "<{line}> after {before} {line}")).first()[0] == "<b> after a {line} $1 b"
    assert df.select(filled("no places")).first()[0] == "no places"
    with pytest.raises(ValueError, match="no value for other"):
        filled("{other}", line="x")
    chunks = chunk(spark, "one\ntwo")
    assert roundtrip.chunk_requests(chunks, "tag: {lines}").first()["user_text"] == "tag: one ||| two"
