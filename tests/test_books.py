"""A small book end to end, files, joins and plans."""

import json

import pytest
from pyspark.sql import functions as F

from scriptmill.functions import clean
from scriptmill.operators import script as scripts, voices, windows
from scriptmill.plans import narration
from scriptmill.session import new_path, stage
from scriptmill.sources import books, characters as maps, files
from scriptmill.streaming import streams

TEXT = """The Lamp

Chapter 1: Dusk
Ada lit the lamp. “Who is there?”
“Only me,” said Tom — and he laughed.

...
PART Two
“Good night.
Chapter 1: Dusk
Tom’s boots were gone…"""

SCRIPT = "book_id string, item_no long, speaker string, line string"


@pytest.fixture
def lines(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "lamp.txt").write_text(TEXT, encoding="utf-8")
    book = books.read_books(spark, str(folder)).withColumn("book_id", F.lit("lamp"))
    cleaned = book.withColumn("text", clean.fix_unterminated_quotes(
        clean.normalize_line_breaks(clean.ascii_punct("text"))))
    return books.book_lines(cleaned)


def test_cleaned_book(lines):
    assert [r["line"] for r in lines.orderBy("line_no").collect()] == [
        "The Lamp", "Chapter 1: Dusk", 'Ada lit the lamp. "Who is there?"', '"Only me," said Tom - and he laughed.',
        "...", "PART Two", '"Good night."', "Chapter 1: Dusk", "Tom's boots were gone..."]


def test_items_and_speakers(spark, lines):
    items = windows.to_items(lines)
    rows = items.orderBy("item_no").collect()
    assert [(r["item_no"], r["type"], r["content"]) for r in rows][2:6] == [
        (2, "narrator", "Ada lit the lamp."), (3, "dialogue", '"Who is there?"'),
        (4, "dialogue", '"Only me,"'), (5, "narrator", "said Tom - and he laughed.")]
    cast = spark.createDataFrame([("lamp", "ada"), ("lamp", "tom"), ("lamp", "old man"), ("other", "lit")],
                                 "book_id string, name string")
    script = scripts.attribute(items, scripts.match_by_name(items, cast))
    said = {r["line"]: r["speaker"] for r in script.collect() if r["line"].startswith('"')}
    assert said == {'"Who is there?"': "ada", '"Only me,"': "tom", '"Good night."': "unknown"}


def test_names_match_as_whole_words_and_only_alone(spark):
    items = spark.createDataFrame([
        ("b", 0, "narrator", "The old man sat.", 0), ("b", 1, "dialogue", '"x"', 0),
        ("b", 2, "narrator", "Thomas and Ann", 1), ("b", 3, "dialogue", '"y"', 1),
        ("b", 4, "narrator", "Ann's Tom", 2), ("b", 5, "dialogue", '"z"', 2)],
        "book_id string, item_no long, type string, content string, line_no long")
    cast = spark.createDataFrame([("b", n) for n in ("old man", "man o", "tom", "ann", "narrator")],
                                 "book_id string, name string")
    assert {r["item_no"]: r["speaker"] for r in scripts.match_by_name(items, cast).collect()} == {
        1: "old man", 3: "ann", 5: "unknown"}


def test_names_are_sought_in_lines_with_dialogue(spark):
    items = spark.createDataFrame([
        (b, i, t, c, line) for i, (b, t, c, line) in enumerate([
            ("b", "narrator", "Mary Ann Lee left.", 0),  # no dialogue
            ("b", "narrator", "said mary", 1), ("b", "dialogue", '"x"', 1), ("b", "narrator", "ann lee", 1),
            ("b", "narrator", "Then Mary-Ann LEE, Mary Ann Lee!", 2), ("b", "dialogue", '"y"', 2), ("b", "dialogue", '"z"', 2),
            ("b", "dialogue", '"alone"', 3), ("b", "narrator", " ", 4), ("b", "dialogue", '"blank"', 4),
            ("c", "narrator", "Mary Ann Lee", 5), ("c", "dialogue", '"other book"', 5),
            ("b", "narrator", None, 6), ("b", "dialogue", '"null"', 6)])],
        "book_id string, item_no long, type string, content string, line_no long")
    cast = spark.createDataFrame([("b", n) for n in ("mary ann lee", "mary ann lee", "lee ann", "...", "")],
                                 "book_id string, name string")
    found = {r["item_no"]: r["speaker"] for r in scripts.match_by_name(items, cast).collect()}
    assert found == {2: "unknown", 5: "mary ann lee", 6: "mary ann lee", 7: "unknown", 9: "unknown",
                     11: "unknown", 13: "unknown"}
    nobody = scripts.match_by_name(items, cast.where("false"))
    assert {r["speaker"] for r in nobody.collect()} == {"unknown"} and nobody.count() == 7


def test_matching_reads_its_items_once(spark):
    """Lines are gathered in one pass; no run of words is shuffled but those of lines with dialogue."""
    items = spark.range(3).selectExpr("'b' as book_id", "id as item_no", "'dialogue' as type", "'x' as content", "id as line_no")
    cast = spark.createDataFrame([("b", "sam")], "book_id string, name string")
    plan = scripts.match_by_name(items, cast)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Range (0, 3") == 1


def test_plan_of_one_voice(lines):
    plan = narration.narration_plan_single(lines, "orpheus", "female").orderBy("line_no", "part_no").collect()
    assert [(r["chapter_no"], r["chapter"], r["voice"], r["text"]) for r in plan] == [
        (1, "Introduction", "tara", "The Lamp"), (2, "Chapter 1 Dusk", "tara", "Chapter 1: Dusk"),
        (2, "Chapter 1 Dusk", "tara", "Ada lit the lamp."), (2, "Chapter 1 Dusk", "leah", "Who is there?"),
        (2, "Chapter 1 Dusk", "leah", "Only me,"), (2, "Chapter 1 Dusk", "tara", "said Tom - and he laughed."),
        (3, "PART Two", "tara", "PART Two"), (3, "PART Two", "leah", "Good night."),
        (2, "Chapter 1 Dusk", "tara", "Chapter 1: Dusk"), (2, "Chapter 1 Dusk", "tara", "Tom's boots were gone...")]
    assert [r["line_no"] for r in plan] == [0, 1, 2, 2, 3, 3, 5, 6, 7, 8]


def test_plan_of_many_voices(spark):
    script = spark.createDataFrame([("b", 0, "narrator", "Part one"), ("b", 1, "Ada", '"Hi" all'), ("b", 2, "x", '"Yo"'),
                                    ("b", 3, "ada", "..."), ("b", 4, "odd", '"Hm"')], SCRIPT)
    cast = spark.createDataFrame([("b", "ada", 9), ("b", "odd", 77)], "book_id string, name string, gender_score int")
    plan = narration.narration_plan_multi(script, cast, "kokoro", "male").orderBy("line_no", "part_no").collect()
    assert [(r["line_no"], r["speaker"], r["voice"]) for r in plan] == [
        (0, "narrator", "am_puck"), (1, "Ada", "af_sarah"), (1, "Ada", "am_puck"),
        (2, "x", "af_alloy+am_puck"), (4, "odd", "am_puck")]


def test_timeline_has_no_gaps(spark, lines):
    spoken, chapters = narration.spoken_lines(lines)
    timed = narration.chapter_timeline(narration.chapter_durations(spoken, chapters, F.lit(100))).orderBy("chapter_no")
    assert [(r["start_ms"], r["end_ms"]) for r in timed.collect()] == [(0, 1100), (1100, 2600), (2600, 3800)]
    text = "\n".join(r["value"] for r in files.chapter_metadata(timed).orderBy("chapter_no").collect()) + "\n"
    assert text.startswith(";FFMETADATA1\n[CHAPTER]\nTIMEBASE=1/1000\nSTART=0\nEND=1100\ntitle=Introduction\n\n[CHAPTER]")


def test_options(spark):
    rows = [("a.epub", "m4b", "male", "Title: x", True), ("a;b.epub", "m4b", "male", "Title: x", True),
            ("a.epub", "m4b", "male", "none", True), ("a.epub", "m4b", "male", "Title: x", False),
            ("a;b", "mp3", "female", None, False), ("a", "ogg", "male", "", True), ("a", "mp3", "none", "", True)]
    df = spark.createDataFrame(rows, "path string, output_format string, narrator_gender string, metadata_text string, has_cover boolean")
    got = [(r["is_valid"], (r["message"] or "").split(":")[0]) for r in narration.book_options(df).collect()]
    assert got == [(True, ""), (False, "Invalid or inaccessible book file"),
                   (False, "No metadata could be extracted from the book file"),
                   (False, "Could not extract cover image from the book file"), (True, ""),
                   (False, "Invalid output format"), (False, "Invalid narrator gender")]


def test_script_files_round_trip(spark, tmp_path):
    rows = [("b", i, "s", f'li"ne {i}é') for i in range(5)] + [("c", 0, "t", "x")]
    script = spark.createDataFrame(rows, SCRIPT).repartition(3)
    for _ in range(2):  # the second write replaces the first
        books.write_script(script, str(tmp_path / "all"))
    back = spark.read.schema(SCRIPT).json(str(tmp_path / "all")).collect()
    assert sorted(map(tuple, back)) == sorted(rows)
    books.write_script(script, str(tmp_path / "each"), per_book=True)
    texts = [p.read_text("utf-8") for p in sorted((tmp_path / "each" / "book_id=b").rglob("part-*.txt"))]
    assert [json.loads(x)["line"] for x in "".join(texts).splitlines()] == [r[3] for r in rows[:5]]


def test_read_script(spark, tmp_path):
    (tmp_path / "s.jsonl").write_text('{"speaker": "a", "line": "x"}\n\n  \n{"line": "\\"y\\"", "speaker": "b"}\n')
    got = books.read_script(spark, str(tmp_path / "s.jsonl")).orderBy("item_no").collect()
    assert [(r["item_no"], r["speaker"], r["line"]) for r in got] == [(0, "a", "x"), (1, "b", '"y"')]


def test_character_map_round_trip(spark):
    rows = [("b", n, "adult", "male", i, f'd "{n}"', 0, i) for i, n in enumerate(["z", "a", "m"])]
    df = spark.createDataFrame(rows, "book_id string, name string, age string, gender string, gender_score int, "
                                     "description string, seen_batch long, seen_op long")
    docs = maps.character_map_text(df, 100)
    doc = json.loads(docs.first()["text"])
    assert list(doc["scores"]) == ["z", "a", "m"] and doc["legend"]["10"] == "completely feminine"
    assert sorted(map(tuple, maps.parse_character_map(docs).collect())) == sorted(r[:6] for r in rows)
    assert maps.character_map_text(df, part_rows=2).count() == 2


def test_voices(spark):
    assert voices.load_voices(spark).count() == 44
    pairs = {tuple(r) for r in voices.load_voice_pairs(spark).collect()}
    assert ("kokoro", "male", "am_puck", "af_alloy+am_puck") in pairs and len(pairs) == 4
    listed = spark.createDataFrame([(0, "b"), (1, "a"), (2, "c")], "pos int, voice string")
    assert {r[0] for r in voices.voice_combinations(listed).collect()} == {"b", "a", "c", "b+a", "b+c", "a+c"}
    with pytest.raises(Exception, match="no voices for engine: bark"):
        voices.require_engine(spark.createDataFrame([("bark",)], "engine string")).collect()
    with pytest.raises(ValueError):
        voices.voice_of_score(F.lit(1), "bark", "male")


def test_tagged_lines_need_equal_counts(spark):
    script = spark.createDataFrame([("b", 0, "s", "x"), ("b", 1, "s", ""), ("c", 0, "s", "y"), ("d", 0, "s", "z")], SCRIPT)
    tagged = spark.createDataFrame([("b", 0, "X"), ("b", 1, "Y"), ("c", 0, "1"), ("c", 1, "2")],
                                   "book_id string, line_no long, line string")
    got = {(r["book_id"], r["item_no"]): (r["line"], r["applied"]) for r in
           scripts.apply_tagged_lines(script, tagged).collect()}
    assert got == {("b", 0): ("X", True), ("b", 1): ("Y", True), ("c", 0): ("y", False), ("d", 0): ("z", False)}
    back = {(r["book_id"], r["item_no"]): r["line"] for r in scripts.map_back_to_script(script, tagged).collect()}
    assert back == {("b", 0): "X", ("b", 1): "", ("c", 0): "1", ("d", 0): "z"}


def test_word_budget(spark):
    rows = [("b", 0, " ".join(f"w{i}" for i in range(9))), ("b", 1, " a  b c "), ("b", 2, "x y z"), ("b", 3, "late")]
    df = spark.createDataFrame(rows, "book_id string, snippet_no long, text string")
    got = windows.word_budget(df, per_snippet=4, total=8).orderBy("snippet_no").collect()
    assert [r["text"] for r in got] == ["w0 w1 w2 w3", "a b c", "x"]


def test_streams_equal_batch(spark, lines):
    path = new_path(spark, "lines")
    lines.repartition(4).write.parquet(path)
    stored = stage(lines, "stored")
    parts = streams.run_available(streams.clean_line_stream(streams.table_stream(spark, path, 1)), "parts").collect()
    assert sorted(map(tuple, parts)) == sorted(map(tuple, streams.clean_line_stream(stored).collect()))
    log = streams.progress_log(streams.table_stream(spark, path, 1))
    total = lines.count()
    assert log.agg(F.max("completed")).first()[0] == total
    assert streams.progress_counts(stored).first()["completed"] == total


def test_scripts_keep_rows_without_a_speaker(spark):
    script = spark.createDataFrame([("b", 0, None, "x"), ("b", 1, "s", "y")], SCRIPT)
    tagged = spark.createDataFrame([("b", 0, "X"), ("b", 1, "Y")], "book_id string, line_no long, line string")
    got = {(r["item_no"], r["speaker"], r["line"], r["applied"]) for r in scripts.apply_tagged_lines(script, tagged).collect()}
    assert got == {(0, None, "X", True), (1, "s", "Y", True)}


def test_line_breaks_and_broken_rows(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"one\r\ntwo\rthree\nfour")
    assert books.read_books(spark, str(tmp_path)).first()["text"] == "one\ntwo\nthree\nfour"
    texts = spark.createDataFrame([("b", '{"speaker": "s", "line": "x"}\n\nnot json\n{"speaker": null, "line": "y"}')],
                                  "book_id string, text string")
    assert [(r["item_no"], r["broken"]) for r in books.broken_rows(texts).collect()] == [(1, "not json")]
    with pytest.raises(Exception, match="not a script row: not json"):
        books.parse_script(texts).collect()
    good = spark.createDataFrame([("b", '{"speaker": null, "line": "y"}')], "book_id string, text string")
    assert [tuple(r) for r in books.parse_script(good).collect()] == [("b", 0, None, "y")]


def test_staging_needs_a_shared_folder(spark):
    from scriptmill import session

    class Conf:
        def __init__(self, **known):
            self.known = {k.replace("_", "."): v for k, v in known.items()}

        def get(self, key, default=None):
            return self.known.get(key, default)

    class Fake:
        sparkContext = spark.sparkContext

        def __init__(self, **known):
            self.conf = Conf(**known)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_folder(Fake(spark_master="spark://host:7077"))
    assert session.shared_folder(Fake(spark_master="yarn", spark_checkpoint_dir="hdfs://x/y")) == "hdfs://x/y"
    assert session.shared_folder(Fake(spark_master="local[4]"))


def test_staged_tables_can_be_dropped(spark, monkeypatch):
    import os

    from scriptmill import session

    monkeypatch.setattr(session, "_made", {})
    path = new_path(spark, "gone")
    spark.range(3).write.parquet(path)
    assert os.path.exists(path) and session.drop_staged(spark) == 1 and not os.path.exists(path)
