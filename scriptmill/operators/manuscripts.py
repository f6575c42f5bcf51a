"""Cleaning and paragraphs of books that are tables of lines.

What the column functions do to a whole text in one string, for books of any size: rows book_id, line_no, line with
lines numbered densely from 0. Results equal the lines of the string forms on the joined text.
"""

from pyspark.sql import Column, DataFrame, functions as F

from scriptmill import fixed
from scriptmill.functions.chars import WS_CHARS, all_lines_of, is_blank, strip
from scriptmill.functions.clean import close_quotes
from scriptmill.operators.ordered import BLOCK_ROWS, SumBefore, number_rows, running
from scriptmill.session import stage

KEYS = ["book_id"]
BOOK_LINE = ["book_id", "line_no", "line"]


def _broken_up(lines: DataFrame, keep, made, block_rows: int) -> DataFrame:
    """Each line cut at all kinds of line breaks; `made` of the parts that `keep` keeps, numbered anew."""
    parts = F.transform(F.filter(all_lines_of("line"), keep), made)
    cut = lines.select("book_id", "line_no", parts.alias("parts"))
    placed = running(cut, KEYS, "line_no", {"first": SumBefore(F.size("parts").cast("bigint"))}, block_rows)
    return placed.select("book_id", "first", F.posexplode("parts").alias("nth", "line")).select(
        "book_id", (F.col("first") + F.col("nth")).alias("line_no"), "line")


def normalize_lines(lines: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Lines trimmed, blank ones dropped; a book of blank lines only has none."""
    return _broken_up(lines, lambda ln: ~is_blank(ln), strip, block_rows)


def close_line_quotes(lines: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """`close_quotes` on every line that is not blank; blank ones are dropped."""
    return _broken_up(lines, lambda ln: ~is_blank(ln), close_quotes, block_rows)


def _is_section(line: Column, start: str, end: str) -> Column:
    hit = F.lit(False)
    for mark in [start.lower(), end.lower(), *fixed.SECTION_WORDS]:
        hit = hit | F.contains(F.lower(line), F.lit(mark))
    return hit


def main_content_lines(lines: DataFrame, start: str = "PROLOGUE", end: str = "ABOUT THE AUTHOR", min_chars: int = 100,
                       block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Lines from the last start marker to the last end marker of a book, section lines trimmed at both ends.

    A book that lacks a marker, or has fewer than `min_chars` characters between them, stays as it is; one with nothing
    but section lines there becomes one empty line. Markers lie within a line and start and end with a sign. What
    decides are maxima and minima per book of narrow rows; they are added up before they move, so a hot book is none.
    """
    if min_chars < 1 or any(m.strip(WS_CHARS) != m or not m or "\n" in m for m in (start, end)):
        raise ValueError("markers must not be blank at an edge and min_chars must be at least 1")

    def last(marker):
        after = F.length(F.substring_index("line", marker, -1))
        place = F.struct("line_no", (F.length("line") - after - len(marker)).alias("col"))
        return F.max(F.when(F.contains("line", F.lit(marker)), place))

    marks = lines.groupBy(*KEYS).agg(last(start).alias("s"), last(end).alias("e"))
    framed = stage(marks.where("s < e").select(*KEYS, "s", "e"), "marks")

    # the lines between, cut at the markers
    begins, ends = F.col("line_no") == F.col("s.line_no"), F.col("line_no") == F.col("e.line_no")
    from_col = F.when(begins, F.col("s.col")).otherwise(0)
    to_col = F.when(ends, F.col("e.col")).otherwise(F.length("line"))
    body = lines.join(framed, KEYS).where("line_no between s.line_no and e.line_no").select(
        *KEYS, "line_no", F.when(begins | ends, F.substring("line", from_col + 1, to_col - from_col)).otherwise(
            F.col("line")).alias("line"))
    blank, section = is_blank("line"), _is_section(F.col("line"), start, end)
    facts = stage(body.select(*KEYS, "line_no", F.length("line").alias("n"), F.length(F.rtrim("line", F.lit(WS_CHARS))).alias("kept"),
                              blank.alias("blank"), section.alias("section")), "facts")
    # white space at both ends falls first; the body starts with a marker, so none is before it
    ruled = facts.groupBy(*KEYS).agg(F.max(F.when(~F.col("blank"), F.col("line_no"))).alias("stop"),
                                     F.min(F.when(~F.col("section"), F.col("line_no"))).alias("head"))
    inside = facts.join(ruled, KEYS).where("line_no <= stop")
    sized = inside.groupBy(*KEYS, "stop", "head").agg(
        F.sum(F.when(F.col("line_no") == F.col("stop"), F.col("kept")).otherwise(F.col("n") + 1)).alias("chars"),
        F.max(F.when(~F.col("section"), F.col("line_no"))).alias("tail")).where(F.col("chars") >= min_chars)
    left = facts.join(sized, KEYS).where("not blank and line_no between head and tail")
    edges = left.groupBy(*KEYS).agg(F.min("line_no").alias("lo"), F.max("line_no").alias("hi"))
    found = stage(sized.select(*KEYS).join(edges, KEYS, "left"), "content")

    at_lo, at_hi = F.col("line_no") == F.col("lo"), F.col("line_no") == F.col("hi")
    line = F.when(at_lo, F.ltrim("line", F.lit(WS_CHARS))).otherwise(F.col("line"))
    line = F.when(at_hi, F.rtrim(line, F.lit(WS_CHARS))).otherwise(line)
    content = body.join(found.where("lo is not null"), KEYS).where("line_no between lo and hi").select(
        *KEYS, (F.col("line_no") - F.col("lo")).alias("line_no"), line.alias("line"))
    nothing = found.where("lo is null").select(*KEYS, F.lit(0).cast("bigint").alias("line_no"), F.lit("").alias("line"))
    return lines.select(*BOOK_LINE).join(found, KEYS, "left_anti").union(content).union(nothing)


def _runs(lines: DataFrame, block_rows: int) -> DataFrame:
    """`paragraph_lines` with `run`, which names a paragraph in its book too."""
    blank = is_blank("line")
    told = running(lines.withColumn("__blank", blank.cast("bigint")), KEYS, "line_no",
                   {"__blanks": SumBefore(F.col("__blank"))}, block_rows)
    named = stage(told.select(*BOOK_LINE, (F.col("__blanks") * 2 + F.col("__blank")).alias("run")), "runs")
    runs = stage(named.groupBy(*KEYS, "run").agg(F.min("line_no").alias("first"), F.count("*").alias("size")), "paragraphs")
    numbered = number_rows(runs, KEYS, "first", "paragraph_no", block_rows=block_rows)
    size = F.when(F.col("run") % 2 == 1, F.lit(0)).otherwise(F.col("size"))
    return named.join(numbered, [*KEYS, "run"]).select(
        *BOOK_LINE, "run", "paragraph_no", (F.col("line_no") - F.col("first")).alias("place"), size.cast("bigint").alias("size"))


def paragraph_lines(lines: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Adds to each line its paragraph (`paragraph_no`, from 0), its place there and the paragraph's `size` in lines.

    A run of lines that are not blank is a paragraph; a blank line is one of its own, of size 0. Paragraphs cross
    blocks: the number of blank lines before a run names it, so no line looks at its neighbours, and a paragraph may be
    as long as its book.
    """
    return _runs(lines, block_rows).drop("run")


def join_paragraph_lines(lines: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """book_id, paragraph_no, size and text: a paragraph's lines in one, the line ends shown by a marker.

    A paragraph must fit in a row here; `paragraph_lines` keeps longer ones as rows.
    """
    ordered = F.sort_array(F.collect_list(F.struct("place", "line")))
    # Grouped by what the lines were joined on, so that their texts move once for both.
    return _runs(lines, block_rows).groupBy(*KEYS, "run", "paragraph_no", "size").agg(ordered.alias("__lines")).select(
        *KEYS, "paragraph_no", "size", F.array_join(F.col("__lines.line"), fixed.LINE_MARKER).alias("text"))


def split_paragraph_lines(paragraphs: DataFrame, sizes: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Lines of joined paragraphs (book_id, paragraph_no, text) again, by `sizes` (book_id, paragraph_no, size).

    A paragraph with another number of parts than its size, or without a size, stays one line; one of size 0 is a
    blank line whatever came back for it.
    """
    parts = F.split("text", fixed.LINE_MARKER.replace("|", r"\|"), -1)
    sized = paragraphs.select(*KEYS, "paragraph_no", "text").join(
        sizes.select(*KEYS, "paragraph_no", "size"), [*KEYS, "paragraph_no"], "left")
    restored = F.when(F.col("size") == 0, F.array(F.lit(""))).when(F.size(parts) == F.col("size"), parts).otherwise(
        F.array("text"))
    cut = stage(sized.select(*KEYS, "paragraph_no", restored.alias("parts")), "parts")
    placed = running(cut, KEYS, "paragraph_no", {"first": SumBefore(F.size("parts").cast("bigint"))}, block_rows)
    return placed.select(*KEYS, "first", F.posexplode("parts").alias("nth", "line")).select(
        *KEYS, (F.col("first") + F.col("nth")).alias("line_no"), "line")
