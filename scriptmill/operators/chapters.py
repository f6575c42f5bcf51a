"""Chapters: which chapter a line belongs to, and the chapters of a book in order."""

from pyspark.sql import Column, DataFrame, functions as F

from scriptmill.functions.segment import chapter_title
from scriptmill.operators.ordered import (
    LatestMark, RunningSum, Spec, block_summary, number_rows, running)
from scriptmill.session import stage

KEYS = ["book_id"]
INTRODUCTION = "Introduction"


def assign_chapters(lines: DataFrame, text: str = "line") -> DataFrame:
    """Adds `chapter`: title of the latest heading at or before the line."""
    titled = running(lines, KEYS, "line_no", {"__title": LatestMark(chapter_title(text))})
    return titled.withColumn("chapter", F.coalesce("__title", F.lit(INTRODUCTION))).drop("__title")


def number_chapters(lines: DataFrame, usable: Column, text: str = "line",
                    specs: dict[str, Spec] | None = None) -> tuple[DataFrame, DataFrame]:
    """The usable lines with `chapter`, and the chapters with their numbers.

    For results that need both: the chapters' order is read off the block table that places the
    lines, so lines are gone through once for that table and once for the result. `specs` are
    further running columns over all lines, usable or not.
    """
    marks = {"__title": LatestMark(F.when(usable, chapter_title(text))), **(specs or {})}
    summary = stage(block_summary(lines, KEYS, "line_no", marks,
                                  __first=F.min(F.when(usable, F.col("line_no")))), "blocks")
    rows = running(lines, KEYS, "line_no", marks, summary=summary).where(usable).withColumn(
        "chapter", F.coalesce("__title", F.lit(INTRODUCTION))).drop("__title")
    heads = summary.select("book_id", F.explode(F.col("__s___title")).alias("h")).select(
        "book_id", F.col("h.pos").alias("first_line"), F.col("h.mark").alias("chapter"))
    # The first usable line opens the introduction, unless it is a heading.
    opening = summary.groupBy("book_id").agg(F.min("__first").alias("first_line")).where(
        F.col("first_line").isNotNull()).join(
        heads.select("book_id", "first_line"), ["book_id", "first_line"], "left_anti").select(
        "book_id", "first_line", F.lit(INTRODUCTION).alias("chapter"))
    firsts = heads.unionByName(opening).groupBy("book_id", "chapter").agg(
        F.min("first_line").alias("first_line"))
    chapters = number_rows(firsts, KEYS, "first_line", "chapter_no", start=1)
    return rows, chapters.select("book_id", "chapter", "chapter_no")


def chapter_table(assigned: DataFrame) -> DataFrame:
    """One row per title of a book; a repeated title joins the earlier chapter.

    Numbered from 1 in order of first appearance.
    """
    titles = assigned.groupBy("book_id", "chapter").agg(
        F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"),
        F.count(F.lit(1)).alias("n_lines"))
    # Small, and numbering reads it twice.
    return number_rows(stage(titles, "chapters"), KEYS, "first_line", "chapter_no", start=1
                       ).select("book_id", "chapter_no", "chapter", "n_lines", "first_line",
                                "last_line")


def chapter_lines(assigned: DataFrame) -> DataFrame:
    """Every line with its chapter's number and its place in that chapter.

    The ordered line list of a chapter is kept as rows: one chapter may be most of a table.
    """
    # Read by four passes: numbers and titles, without the text.
    narrow = stage(assigned.select("book_id", "line_no", "chapter"), "assigned")
    chapters = chapter_table(narrow).select("book_id", "chapter", "chapter_no")
    one = F.lit(1).cast("bigint")
    return running(narrow.join(chapters, ["book_id", "chapter"]), ["book_id", "chapter_no"],
                   "line_no", {"place": RunningSum(one)}).select(
        "book_id", "chapter_no", "chapter", "line_no", "place")
