"""Punctuation rules that make a line safe to synthesise."""

from pyspark.sql import Column, DataFrame, functions as F

from scriptmill import fixed
from scriptmill.functions.chars import (
    EDGE, NOT_AFTER_WORD, NOT_BEFORE_WORD, WORD, WS, column, strip, words_of)


def needs_no_stop(line) -> Column:
    """Very short lines, and lines that end in an abbreviation."""
    line = column(line)
    # The longest abbreviation, its dot, and the character before it.
    reach = max(map(len, fixed.ABBREVIATIONS)) + 2
    tail = F.substring(line, -reach, reach)
    abbreviation = rf"(?i){NOT_AFTER_WORD}(?:{'|'.join(fixed.ABBREVIATIONS)})\.\z"
    return ((F.length(strip(line)) <= 2)
            | (F.endswith(line, F.lit(".")) & tail.rlike(abbreviation)))


def resolve_colons(line) -> Column:
    """Times and ratios without a colon; any other colon becomes a dash."""
    clock = rf"{NOT_AFTER_WORD}(\p{{Nd}}{{1,2}}):(\p{{Nd}}{{2}})[{WS}]*(AM|PM|am|pm)?{EDGE}"
    ratio = rf"{NOT_AFTER_WORD}(\p{{Nd}}+):(\p{{Nd}}+){NOT_BEFORE_WORD}"
    line = column(line)
    freed = F.regexp_replace(strip(F.regexp_replace(line, clock, "$1.$2 $3")), ratio, "$1 to $2")
    # Most lines have no colon and are spared the two searches.
    out = F.when(F.contains(line, F.lit(":")), F.replace(freed, F.lit(":"), F.lit(" -"))
                 ).otherwise(line)
    return strip(F.regexp_replace(out, rf"[{WS}]+", " "))


def move_punctuation_inside(line) -> Column:
    return F.regexp_replace(column(line), r"""(["'])([.!?…])""", "$2$1")


def ends_with_punctuated_dialogue(line) -> Column:
    line = column(line)
    verbs = "|".join(fixed.ATTRIBUTION_VERBS)
    return (line.rlike(rf"""[.!?…][{WS}]*['"]?"\z""")
            | line.rlike(r"""['"][.!?…]\z""")
            | line.rlike(rf"""(?i)",?[{WS}]+[{WORD}]+[{WS}]+(?:{verbs})[^\n]*[.!?]\z"""))


def is_unpunctuated_dialogue(line) -> Column:
    return column(line).rlike(r"""[^.!?…]["']\z""")


def punctuate_dialogue(line) -> Column:
    return F.regexp_replace(column(line), r"""([^.!?…])(["'])\z""", "$1.$2")


def is_title_or_heading(line, index) -> Column:
    """The first line, a numbered chapter line, or a short line without a function word."""
    line = column(line)
    plain = ~F.lower(line).rlike("|".join(fixed.FUNCTION_WORDS))
    return ((column(index) == 0)
            | line.rlike(rf"(?i)\AChapter[{WS}]+\p{{Nd}}")
            | ((F.size(words_of(line)) <= 6) & plain))


def prepare_for_tts(df: DataFrame, text: str, out: str, index: str | None = None) -> DataFrame:
    """Adds `out`: `text` under the first rule that applies.

    `index` is the line's number in its book. Without it every line is the first line of its
    own item, which is how scripts with speakers are prepared.
    """
    at = F.lit(0) if index is None else F.col(index)
    # Staged columns: each rewrite is evaluated once although many rules look at it.
    staged = (df.withColumn("__plain", strip(text))
              .withColumn("__moved", move_punctuation_inside(resolve_colons("__plain"))))
    moved = F.col("__moved")
    stopped = F.concat(moved, F.lit("."))
    ruled = (F.when(needs_no_stop("__plain"), F.col("__plain"))
             .when(ends_with_punctuated_dialogue(moved), moved)
             .when(is_unpunctuated_dialogue(moved), punctuate_dialogue(moved))
             .when(moved.rlike(r"[.!?:;…]\z"), moved)
             .when(is_title_or_heading(moved, at), stopped)
             .when(F.endswith(moved, F.lit(",")), moved)
             .otherwise(stopped))
    return staged.withColumn(out, ruled).drop("__plain", "__moved")
