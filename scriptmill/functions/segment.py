"""Splitting lines into narration and dialogue, and recognising headings and keywords."""

from pyspark.sql import Column, functions as F

from scriptmill import fixed
from scriptmill.functions.chars import (
    NOT_AFTER_WORD, NOT_BEFORE_WORD, WORD, WS, column, interleave, let, strip)
from scriptmill.functions.clean import sanitize_title, speakable_text

QUOTED = r'"[^"]+"'
HEADING = rf"(?i)\A(?:Chapter|Part)[{WS}]+([{WORD}\-]+)"
# A keyword's first letter is looked for before what stands in front of it, which takes longer to tell.
KEYWORD = (rf"(?i)(?=[{''.join(sorted({name[0] for name in fixed.EMOTIONS}))}]){NOT_AFTER_WORD}(?:" + "|".join(fixed.EMOTIONS)
           + rf")(?:ed|ing|s|es)?{NOT_BEFORE_WORD}")


def split_dialogue(line) -> Column:
    """Array of (text, type); the texts put together give the line again."""
    parts = F.filter(interleave(line, QUOTED, lambda g: g, lambda q: q),
                     lambda p: p.isNotNull() & (p != ""))

    def annotate(part):
        quoted = F.startswith(part, F.lit('"')) & F.endswith(part, F.lit('"'))
        return F.struct(part.alias("text"),
                        F.when(quoted, "dialogue").otherwise("narration").alias("type"))

    return F.transform(parts, annotate)


def speakable_parts(line) -> Column:
    """Array of (part_no, type, text): the parts of a line that have something to say.

    Filtered inside the array: a filter on the exploded rows would be pushed below and make
    every text twice.
    """
    said = F.transform(split_dialogue(line), lambda p, i: F.struct(
        i.alias("part_no"), p["type"].alias("type"), speakable_text(p["text"]).alias("text")))
    return F.filter(said, lambda p: p["text"].isNotNull())


def line_items(line) -> Column:
    """Array of (type, content): a line without dialogue stays whole and untrimmed."""
    line = column(line)

    def item(kind, content):
        return F.struct(F.lit(kind).alias("type"), content.alias("content"))

    mixed = F.filter(
        interleave(line, QUOTED, lambda g: item("narrator", strip(g)),
                   lambda q: item("dialogue", q)),
        lambda it: it["content"].isNotNull() & (it["content"] != ""))
    return F.when(has_dialogue(line), mixed).otherwise(F.array(item("narrator", line)))


def extract_dialogues(text) -> Column:
    return F.regexp_extract_all(column(text), F.lit(QUOTED), F.lit(0))


def has_dialogue(line) -> Column:
    return column(line).rlike(QUOTED)


def is_chapter_heading(line) -> Column:
    """`Chapter` or `Part`, then digits or an English number word (hyphens allowed)."""
    # Few lines start like a heading; the others are spared the look at number words.
    token = F.lower(F.regexp_extract(column(line), HEADING, 1))
    return F.when(column(line).rlike(HEADING), let(token, _is_number)).otherwise(False)


def _is_number(token: Column) -> Column:
    words = F.filter(F.split(token, "-", -1), lambda w: w.isin(fixed.NUMBER_WORDS))

    def count(word):
        return F.size(F.filter(words, lambda w: w == word))

    def at(word):
        return F.array_position(words, word)

    once = F.lit(True)
    for word in ("thousand", "million", "billion", "point"):
        once = once & (count(word) <= 1)
    ordered = ~(((at("thousand") > 0) & ((at("thousand") < at("million"))
                                         | (at("thousand") < at("billion"))))
                | ((at("million") > 0) & (at("million") < at("billion"))))
    spelled = (F.size(words) > 0) & once & ordered
    return token.rlike(r"\A\p{Nd}+\z") | spelled


def chapter_title(line) -> Column:
    """Title a heading line opens, null for other lines."""
    return F.when(is_chapter_heading(line), sanitize_title(line))


def has_emotion_keyword(line) -> Column:
    return column(line).rlike(KEYWORD)
