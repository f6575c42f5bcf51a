"""The narration plan: who says what, in which chapter, and when."""

from pyspark.sql import Column, DataFrame, functions as F

from scriptmill import fixed
from scriptmill.functions.chars import column, let, strip
from scriptmill.functions.clean import (
    escape_metadata, is_only_punctuation, is_safe_path, sanitize_title, strip_emotion_tags)
from scriptmill.functions.segment import speakable_parts
from scriptmill.functions.speech import prepare_for_tts
from scriptmill.operators.chapters import number_chapters
from scriptmill.operators.ordered import RunningSum, SumBefore, running
from scriptmill.operators.script import apply_tagged_lines
from scriptmill.operators.voices import assign_voice_multi, assign_voice_single
from scriptmill.session import stage

KEYS = ["book_id"]


def spoken_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines that are read aloud, renumbered without the blank ones, with their chapter; and the
    chapters with their numbers."""
    marked = lines.withColumn("line", strip("line"))
    nonblank = (F.col("line") != "").cast("bigint")
    spoken, chapters = number_chapters(marked, ~is_only_punctuation("line"),
                                       specs={"__no": SumBefore(nonblank)})
    return spoken.withColumn("line_no", F.col("__no")).drop("__no"), chapters


def _parts(spoken: DataFrame) -> DataFrame:
    said = spoken.select(*spoken.columns, F.explode(speakable_parts("line")).alias("part"))
    return said.select(*spoken.columns, "part.*")


PLAN = ["book_id", "chapter_no", "chapter", "line_no", "part_no", "type", "speaker", "voice",
        "text"]


def narration_plan_single(lines: DataFrame, engine: str, gender: str) -> DataFrame:
    """One row per spoken part: narration in one voice, dialogue in another.

    Where an engine needs its lines prepared or there are tagged lines, `prepared_lines` comes before this.
    """
    spoken, chapters = spoken_lines(lines.select("book_id", "line_no", "line"))
    voiced = assign_voice_single(_parts(spoken), engine, gender).withColumn(
        "speaker", F.lit(None).cast("string"))
    return voiced.join(chapters, ["book_id", "chapter"]).select(*PLAN)


def narration_plan_multi(script: DataFrame, characters: DataFrame, engine: str,
                         gender: str) -> DataFrame:
    """One row per spoken part of a script: narration in the narrator's voice, dialogue in the
    speaker's. Items keep their numbers, as scripts have no lines to leave out."""
    items = script.withColumnRenamed("item_no", "line_no").withColumn("line", strip("line"))
    spoken, chapters = number_chapters(items, ~is_only_punctuation("line"))
    # Casting the narration parts as the narrator keeps them out of the join with characters.
    cast = _parts(spoken).withColumnRenamed("speaker", "__said").withColumn(
        "speaker", F.when(F.col("type") == "narration", "narrator").otherwise(F.col("__said")))
    voiced = assign_voice_multi(cast, characters, engine, gender).withColumn(
        "speaker", F.col("__said"))
    return voiced.join(chapters, ["book_id", "chapter"]).select(*PLAN)


def prepared_lines(lines: DataFrame, engine: str, tagged: DataFrame | None = None) -> DataFrame:
    """book_id, line_no, line, as the engine reads them.

    A book with any `tagged` lines (book_id, line_no, line) is made of these alone, as they are. Other books keep
    their lines, prepared where the engine asks for it; line 0 is then taken for a title. Tagged books are
    staged, as few rows: the join is a broadcast by measured size, or one whose hot books AQE can split.
    """
    own = lines.select("book_id", "line_no", "line")
    if tagged is not None:
        books = stage(tagged.select("book_id").distinct(), "tagged-books")
        own = own.join(books, "book_id", "left_anti")
    if engine in fixed.PREPARED_ENGINES:
        own = prepare_for_tts(own, "line", "line", "line_no")
    return own if tagged is None else own.unionByName(tagged.select("book_id", "line_no", "line"))


def prepared_script(script: DataFrame, engine: str, tagged: DataFrame | None = None) -> DataFrame:
    """book_id, item_no, speaker, line, as the engine reads them.

    With `tagged` lines a book gets those if they are as many as its items, else it keeps its own; without, all
    tags are taken out. Each item is prepared by itself where the engine asks for it.
    """
    if tagged is None:
        said = script.withColumn("line", strip_emotion_tags("line"))
    else:
        said = apply_tagged_lines(script, tagged)
    said = said.select("book_id", "item_no", "speaker", "line")
    return prepare_for_tts(said, "line", "line") if engine in fixed.PREPARED_ENGINES else said


def voice_rollup(plan: DataFrame) -> DataFrame:
    """Parts and characters to synthesise per book, chapter and voice."""
    return plan.groupBy("book_id", "chapter_no", "chapter", "voice").agg(
        F.count(F.lit(1)).alias("n_parts"), F.sum(F.length("text")).alias("n_chars"))


def book_options(manifest: DataFrame) -> DataFrame:
    """Adds is_valid and message: the first thing wrong with a book's options."""
    m4b = F.col("output_format") == "m4b"
    path = F.coalesce("path", F.lit(""))
    message = (
        F.when(~F.coalesce(F.col("output_format").isin(fixed.FORMATS), F.lit(False)),
               "Invalid output format")
        .when(~F.coalesce(F.col("narrator_gender").isin(fixed.NARRATOR_GENDERS), F.lit(False)),
              "Invalid narrator gender")
        .when(m4b & ~is_safe_path("path"),
              F.concat(F.lit("Invalid or inaccessible book file: "), path))
        .when(m4b & ~F.coalesce(F.contains(F.col("metadata_text"), F.lit(": ")), F.lit(False)),
              F.concat(F.lit("No metadata could be extracted from the book file: "), path))
        .when(m4b & ~F.coalesce(F.col("has_cover"), F.lit(False)),
              F.concat(F.lit("Could not extract cover image from the book file: "), path)))
    return manifest.withColumn("message", message).withColumn(
        "is_valid", F.col("message").isNull())


def chapter_timeline(chapters: DataFrame, pause_ms: int = 1000) -> DataFrame:
    """Adds start_ms and end_ms to chapters (book_id, chapter_no, duration_ms).

    A chapter lasts as long as its segments and the pause after it.
    """
    lasting = chapters.withColumn("duration_ms", F.col("duration_ms") + pause_ms)
    timed = running(lasting, KEYS, "chapter_no", {"end_ms": RunningSum(F.col("duration_ms"))})
    return timed.withColumn("start_ms", F.col("end_ms") - F.col("duration_ms"))


def chapter_durations(spoken: DataFrame, chapters: DataFrame, duration_ms: Column) -> DataFrame:
    """Sum of `duration_ms` over every chapter: book_id, chapter_no, chapter, duration_ms."""
    lengths = spoken.groupBy("book_id", "chapter").agg(F.sum(duration_ms).alias("duration_ms"))
    return lengths.join(chapters, ["book_id", "chapter"]).select(
        "book_id", "chapter_no", "chapter", "duration_ms")


def metadata_tags(metadata) -> Column:
    """Tag map of the finished file; empty values are left out."""
    # The map is made once, not for each of its keys.
    return let(metadata, _tags_of)


def _tags_of(meta: Column) -> Column:
    def value(key):
        return escape_metadata(meta[key])

    tags = F.create_map(
        F.lit("title"), value("Title"), F.lit("artist"), value("Author(s)"),
        F.lit("album"), value("Title"), F.lit("genre"), F.lit("Audiobook"),
        F.lit("publisher"), value("Publisher"), F.lit("language"), value("Languages"),
        F.lit("date"), value("Published"), F.lit("description"), value("Comments"))
    return F.map_filter(tags, lambda _, v: v != "")


def encode_profile(sample_rate, output_format) -> Column:
    """(sample_rate, bitrate) an encoder is run with; no bitrate for lossless formats."""
    rate, kind = column(sample_rate), column(output_format)
    opus = kind == "opus"

    def bucket(values):
        return (F.when(rate <= 10000, values[0]).when(rate <= 14000, values[1])
                .when(rate <= 20000, values[2]).when(rate <= 36000, values[3])
                .otherwise(values[4]))

    return F.struct(
        F.when(opus, bucket([8000, 12000, 16000, 24000, 48000])).otherwise(rate)
        .alias("sample_rate"),
        F.when(opus, bucket(["64k", "80k", "96k", "128k", "160k"]))
        .when(kind == "mp3", F.when(rate >= 44100, "192k").otherwise("160k"))
        .when(kind.isin("m4a", "m4b"), "256k").alias("bitrate"))


def output_name(title, output_format) -> Column:
    return F.concat(column(title), F.lit("."), F.lower(column(output_format)))


def book_title(title, path) -> Column:
    """The title given, else the file's name without extension; made safe as a name."""
    base = F.regexp_extract(column(path), r"([^/]*)\z", 1)
    # A leading dot is part of the name, not an extension.
    stem = F.regexp_replace(base, r"(?s)\A(\.*[^.].*)\.[^.]*\z", "$1")
    return sanitize_title(F.coalesce(F.when(column(title) != "", column(title)), stem))
