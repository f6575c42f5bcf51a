"""Tagged chunks: validation, fallback to lines, and putting them back into the book."""

from pyspark.sql import DataFrame, functions as F

from scriptmill.functions.chars import lines_of
from scriptmill.functions.tagging import (
    clean_response, is_orphan, repair_orphans, response_reason, validate_by_line)
from scriptmill.session import stage

OVERLAP = "Chunks overlap, the book keeps its lines"


def validate_chunks(chunks: DataFrame) -> DataFrame:
    """Adds text, success, reverted and reason to chunks with `enhanced` and `original`.

    The same as `validate_tagged`, with the reason as a column of its own, so that it is found
    once for the three columns that depend on it.
    """
    found = chunks.withColumn("__clean", clean_response("enhanced")).withColumn(
        "reason", response_reason("__clean", "original"))
    fixed_text = F.when(F.col("reason").isNull(), repair_orphans("__clean", "original"))
    return found.select(
        *chunks.columns, fixed_text.otherwise(F.col("original")).alias("text"),
        F.col("reason").isNull().alias("success"), F.col("reason").isNotNull().alias("reverted"),
        "reason")


def flag_orphans(lines: DataFrame) -> DataFrame:
    """Lines that hold a tag and almost nothing else; reported, not rejected."""
    return lines.where(is_orphan("line"))


def fallback_by_line(checked: DataFrame) -> DataFrame:
    """Reverted chunks get what can be kept of them line by line; the others stay."""
    return checked.withColumn(
        "text", F.when(F.col("reverted"), validate_by_line("enhanced", "original"))
        .otherwise(F.col("text")))


def reassemble(lines: DataFrame, chunks: DataFrame) -> DataFrame:
    """The book's lines with the chunks' lines in their places.

    A chunk with another number of lines than its range replaces nothing. Where chunks of a book give a line twice,
    none of its lines is replaced, and `message` says so. Books with such lines are few rows of their own, so that
    the chunks are gone through once and texts meet their lines in one join, the only time that they move. What the
    result reads lasts beyond the `passing` block that the chunks were made in.
    """
    parts = lines_of("text")
    # Not a filter: that would be pushed below, and the text be made twice.
    fitting = F.when(F.size(parts) == F.col("end_line") - F.col("start_line"), parts)
    tagged = stage(chunks.select(
        "book_id", "start_line", F.posexplode(fitting).alias("at", "tagged")
    ).select("book_id", (F.col("start_line") + F.col("at")).alias("line_no"), "tagged"), "tagged-lines", lasting=True)
    twice = stage(tagged.groupBy("book_id", "line_no").agg(F.count("*").alias("times")).where("times > 1").select(
        "book_id", "line_no"), "twice")
    placed = lines.select("book_id", "line_no", "line").where("book_id is not null and line_no is not null")
    over = None
    if not twice.isEmpty():  # else no line is read to be found given once
        over = stage(twice.join(lines.select("book_id", "line_no"), ["book_id", "line_no"], "left_semi").select(
            "book_id").distinct().withColumn("__over", F.lit(True)), "overlaps", lasting=True)
        tagged = tagged.join(over, "book_id", "left_anti")
    # What is left has each line of a book at most once.
    both = placed.join(tagged, ["book_id", "line_no"], "left")
    fits = F.lit(True) if over is None else F.col("__over").isNull()
    return (both if over is None else both.join(over, "book_id", "left")).select(
        "book_id", "line_no", F.coalesce("tagged", "line").alias("line"), F.col("tagged").isNotNull().alias("replaced"),
        F.when(~fits, F.lit(OVERLAP)).alias("message"))
