"""Line-level windows of a book: keyword contexts, dialogue contexts, budgets, progress."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from scriptmill import fixed
from scriptmill.functions.chars import WS, is_blank, strip
from scriptmill.functions.clean import is_only_punctuation
from scriptmill.functions.segment import has_emotion_keyword, line_items
from scriptmill.functions.tokens import token_count
from scriptmill.operators.budgets import chunk_counted
from scriptmill.operators.ordered import (
    BLOCK, HOME, Previous, RunningSum, SumBefore, WholeSum, block_of, number_rows, running,
    with_neighbours)
from scriptmill.session import stage

KEYS = ["book_id"]
#: items of a block whose texts are gathered at once for its dialogue contexts
CONTEXT_ROWS = 1024


def drop_blank_lines(lines: DataFrame, trim: bool = True) -> DataFrame:
    """Non-blank lines with dense numbers from 0; `source_line` keeps the old number."""
    kept = lines.where(~is_blank("line")).withColumnRenamed("line_no", "source_line")
    if trim:
        kept = kept.withColumn("line", strip("line"))
    return number_rows(kept, KEYS, "source_line", "line_no").select(
        "book_id", "line_no", "source_line", "line")


def drop_punctuation_lines(lines: DataFrame) -> DataFrame:
    return lines.where(~is_only_punctuation("line"))


def to_items(lines: DataFrame) -> DataFrame:
    """Lines as narrator and dialogue items, numbered through the book from 0."""
    itemised = lines.withColumn("__items", line_items("line"))
    placed = running(itemised, KEYS, "line_no",
                     {"__first": SumBefore(F.size("__items").cast("bigint"))})
    return placed.select(
        "book_id", "line_no", F.col("line").alias("original_line"), "__first",
        F.posexplode("__items").alias("__at", "it"),
    ).select("book_id", (F.col("__first") + F.col("__at")).alias("item_no"), "it.type",
             "it.content", "line_no", "original_line")


def emotion_hits(lines: DataFrame) -> DataFrame:
    return lines.where(has_emotion_keyword("line"))


def emotion_windows(lines: DataFrame, n: int = 2) -> DataFrame:
    """Half-open line ranges of `n` lines around every keyword line.

    Overlapping ranges are one window, touching ones are not. Lines must be densely numbered
    from 0. All ranges have the same width, so a hit opens a window exactly when the hit before
    it is at least that width away.
    """
    hits = stage(emotion_hits(lines).select("book_id", "line_no"), "hits")
    opened = running(hits, KEYS, "line_no", {"prev": Previous(F.col("line_no"))}).select(
        "book_id", "line_no",
        (F.col("prev").isNull() | (F.col("line_no") - F.col("prev") >= 2 * n + 1))
        .cast("bigint").alias("opens"))
    numbered = running(opened, KEYS, "line_no", {"window": RunningSum(F.col("opens"))})
    ranges = numbered.groupBy("book_id", (F.col("window") - 1).alias("window_no")).agg(
        F.min("line_no").alias("lo"), F.max("line_no").alias("hi"))
    lengths = lines.groupBy("book_id").agg((F.max("line_no") + 1).alias("n_lines"))
    start = F.greatest(F.col("lo") - n, F.lit(0)).cast("bigint")
    end = F.least(F.col("hi") + n + 1, F.col("n_lines"))
    return (ranges.join(lengths, "book_id")
            .select("book_id", "window_no", start.alias("start_line"), end.alias("end_line"))
            .withColumn("line_count", F.col("end_line") - F.col("start_line")))


def window_lines(lines: DataFrame, windows: DataFrame) -> DataFrame:
    """The lines inside windows, each with its window; `opens` marks a window's first line.

    A window is cut at block edges before its lines are listed, so a window as long as a book
    is listed by many tasks. The listed lines are joined by a shuffle: what Spark measures is the windows before
    they are listed, so that it would broadcast them at any size.
    """
    return _inside(lines.select("book_id", "line_no", "line"), windows)


def _inside(rows: DataFrame, windows: DataFrame) -> DataFrame:
    step = 4096
    cuts = F.sequence(block_of("start_line", step), block_of(F.col("end_line") - 1, step))
    cut = windows.select("book_id", "window_no", "start_line", "end_line",
                         F.explode(cuts).alias("cut"))
    listed = F.sequence(F.greatest(F.col("start_line"), F.col("cut") * step),
                        F.least(F.col("end_line"), (F.col("cut") + 1) * step) - 1)
    members = cut.repartition("book_id", "cut").select(
        "book_id", "window_no", "start_line", F.explode(listed).alias("line_no")).hint("merge")
    return rows.join(members, ["book_id", "line_no"]).select(
        *rows.columns, "window_no", (F.col("line_no") == F.col("start_line")).alias("opens"))


def window_chunks(lines: DataFrame, windows: DataFrame, max_tokens: int = 500,
                  tokens: Column | None = None) -> DataFrame:
    """Token chunks inside windows; a chunk never leaves its window.

    Lines are counted where they are read, so their texts don't move.
    """
    counted = lines.select("book_id", "line_no", (token_count("line") if tokens is None else tokens).alias("__n"),
                           is_blank("line").alias("__blank"))
    inside = stage(_inside(counted, windows), "inside")
    chunks = chunk_counted(inside, KEYS, "line_no", F.col("__n"), F.col("__blank"), max_tokens, F.col("opens"))
    owner = inside.select("book_id", F.col("line_no").alias("start_line"), "window_no")
    return chunks.join(owner, ["book_id", "start_line"]).select(
        "book_id", "window_no", "chunk_no", "start_line", "end_line", "line_count", "tokens")


def window_coverage(lines: DataFrame, windows: DataFrame) -> DataFrame:
    """Share of a book's lines that lies in windows, and what is saved by leaving out the rest."""
    totals = lines.groupBy("book_id").agg(F.count(F.lit(1)).alias("n_lines"))
    covered = windows.groupBy("book_id").agg(
        F.count(F.lit(1)).alias("n_windows"), F.sum("line_count").alias("covered"))
    share = F.col("lines_in_windows") * 100.0 / F.col("n_lines")
    return totals.join(covered, "book_id", "left").select(
        "book_id", "n_lines", F.coalesce("n_windows", F.lit(0)).alias("n_windows"),
        F.coalesce("covered", F.lit(0)).alias("lines_in_windows"),
    ).withColumns({"coverage_percent": F.round(share, 1),
                   "reduction_percent": F.round(100.0 - share, 1)})


def dialogue_context(items: DataFrame, max_tokens: int = 1000, limit: int = 30,
                     tokens=token_count, counts: bool = False) -> DataFrame:
    """For every dialogue item, the nearest items each way that fit the token budget.

    `items` has book_id, item_no (dense), type, content, original_line and speaker. Counting
    stops at the first item that does not fit; counts are never negative, so that is the
    cumulative sum passing the budget. With `counts` it also returns tokens_before, tokens_content and tokens_after,
    sums of the items' counts, so that contexts many times the book's size need not be counted again.
    """
    said = F.when(
        (F.col("type") == "dialogue") & (F.col("speaker") != "narrator"),
        F.concat(F.lit("["), F.col("speaker"), F.lit("]: "), F.col("content"))
    ).otherwise(F.col("content"))
    shown = with_neighbours(
        items.select("book_id", "item_no", "type", "content", "original_line",
                     said.alias("said"), tokens("content").alias("content_n")).withColumn(
            # Only what is shown with its speaker is counted a second time.
            "said_n", F.when(F.col("said") == F.col("content"), F.col("content_n"))
            .otherwise(tokens("said"))),
        "item_no", limit, limit, block_rows=max(CONTEXT_ROWS, limit))
    near = Window.partitionBy("book_id", BLOCK).orderBy("item_no")
    upto = near.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    asks = F.col(HOME) & (F.col("type") == "dialogue")
    # A block's items once, with sums up to each; only dialogue rows reach into them.
    blocks = shown.withColumns({
        "said_before": F.sum("said_n").over(upto) - F.col("said_n"),
        "content_sum": F.sum("content_n").over(upto)}).groupBy("book_id", BLOCK).agg(
        F.sort_array(F.collect_list(F.struct(
            "item_no", "said", "content", "said_n", "content_n", "said_before", "content_sum", asks.alias("asks"),
            F.when(asks, F.col("original_line")).alias("original_line")))).alias("__b"))

    def around(it, i):
        back = F.slice("__b", F.greatest(i - limit, F.lit(0)) + 1, F.least(i, F.lit(limit)))
        ahead = F.slice("__b", i + 2, limit)
        fits_back = F.filter(back, lambda x: it["said_before"] - x["said_before"] <= max_tokens)
        fits_ahead = F.filter(ahead, lambda x: x["content_sum"] - it["content_sum"] <= max_tokens)
        return F.when(it["asks"], F.struct(
            it["item_no"].alias("item_no"), it["content"].alias("content"), it["original_line"].alias("original_line"),
            fits_back.getField("said").alias("back"), fits_ahead.getField("content").alias("ahead"),
            *([total(fits_back, "said_n", fixed.NO_BEFORE).alias("back_n"), it["content_n"].alias("content_n"),
               total(fits_ahead, "content_n", fixed.NO_AFTER).alias("ahead_n")] if counts else [])))

    def total(kept, count, none):
        return F.when(F.size(kept) == 0, tokens(F.lit(none)).cast("bigint")).otherwise(
            F.aggregate(kept.getField(count), F.lit(0).cast("bigint"), lambda a, n: a + n))

    def joined(kept, none):
        return F.when(F.size(kept) == 0, F.lit(none)).otherwise(F.array_join(kept, "\n"))

    # Made inside the array: a row for each item would hold a copy of its whole block.
    found = F.filter(F.transform("__b", around), lambda x: x.isNotNull())
    return blocks.select("book_id", F.explode(found).alias("c")).select(
        "book_id", "c.item_no", "c.content", "c.original_line",
        joined(F.col("c.back"), fixed.NO_BEFORE).alias("context_before"),
        joined(F.col("c.ahead"), fixed.NO_AFTER).alias("context_after"),
        *([F.col("c.back_n").alias("tokens_before"), F.col("c.content_n").alias("tokens_content"),
           F.col("c.ahead_n").alias("tokens_after")] if counts else []))


CURRENT = "\n\n[CURRENT LINE WITH DIALOGUE TAGS]: "


def current_line_context(contexts: DataFrame, tokens=token_count) -> DataFrame:
    """Shows the whole original line, with its dialogue tags, after the context before."""
    if "tokens_before" in contexts.columns:
        contexts = contexts.withColumn(
            "tokens_before", F.col("tokens_before") + tokens(F.lit(CURRENT)) + tokens("original_line"))
    return contexts.withColumn("context_before", F.concat(F.col("context_before"), F.lit(CURRENT), F.col("original_line")))


def word_budget(snippets: DataFrame, per_snippet: int = 150, total: int = 800) -> DataFrame:
    """Snippets cut to `per_snippet` words, kept in order until `total` words; last one cut."""
    split = F.split(strip("text"), rf"[{WS}]+", per_snippet + 1)
    words = F.slice(F.filter(split, lambda w: w != ""), 1, per_snippet)
    cut = snippets.withColumn("__words", words)
    summed = running(cut, KEYS, "snippet_no",
                     {"__before": SumBefore(F.size("__words").cast("bigint"))})
    room = F.greatest(F.lit(0), F.least(F.size("__words").cast("bigint"),
                                        total - F.col("__before"))).cast("int")
    return summed.withColumn("n_words", room).where(F.col("n_words") > 0).select(
        "book_id", "snippet_no", "n_words",
        F.array_join(F.slice("__words", 1, F.col("n_words")), " ").alias("text"))


def progress_percent(rows: DataFrame, pos: str = "line_no", keys=("book_id",)) -> DataFrame:
    """Completed rows over all rows of the book, after each row."""
    one = F.lit(1).cast("bigint")
    counted = running(rows.select(*keys, pos), keys, pos,
                      {"completed": RunningSum(one), "total": WholeSum(one)})
    return counted.withColumn("percent", F.round(F.col("completed") * 100.0 / F.col("total"), 1))
