"""Files that describe a finished book, as ordered rows of text."""

from pyspark.sql import DataFrame, functions as F

LINE_FOLDER = "temp_audio/line_segments"
CHAPTER_FOLDER = "temp_audio"


def line_manifest(chapter_lines: DataFrame, folder: str = LINE_FOLDER) -> DataFrame:
    """`file '...'` row of every line of every chapter, in order of `place`."""
    entry = F.format_string(f"file '{folder}/line_%06d.wav'", F.col("line_no"))
    return chapter_lines.select("book_id", "chapter_no", "chapter", "place",
                                entry.alias("value"))


def book_manifest(chapters: DataFrame, folder: str = CHAPTER_FOLDER) -> DataFrame:
    """`file '...'` row of every chapter of every book, in order of `chapter_no`."""
    entry = F.concat(F.lit(f"file '{folder}/"), F.col("chapter"), F.lit(".m4a'"))
    return chapters.select("book_id", "chapter_no", entry.alias("value"))


def chapter_metadata(timeline: DataFrame) -> DataFrame:
    """Chapter file of every book as text blocks: the head at chapter 0, then each chapter."""
    block = F.concat(
        F.lit("[CHAPTER]\nTIMEBASE=1/1000\nSTART="), F.col("start_ms").cast("string"),
        F.lit("\nEND="), F.col("end_ms").cast("string"), F.lit("\ntitle="), F.col("chapter"),
        F.lit("\n"))
    heads = timeline.select("book_id").distinct().select(
        "book_id", F.lit(0).cast("bigint").alias("chapter_no"),
        F.lit(";FFMETADATA1").alias("value"))
    return heads.unionByName(timeline.select("book_id", "chapter_no", block.alias("value")))
