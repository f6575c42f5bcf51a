"""Validation and repair of text that came back with emotion tags."""

from pyspark.sql import Column, functions as F

from scriptmill import fixed
from scriptmill.functions.chars import (
    WORD, WS, column, interleave, is_blank, let, lines_of, strip, words_of)
from scriptmill.functions.clean import TAG, has_emotion_tag, strip_emotion_tags

TAGGED_QUOTE = rf'"[^"]*{TAG}[^"]*"'
MIN_LINE_CHARS = 10


def is_orphan(line) -> Column:
    """A line with a tag and almost nothing else."""
    return has_emotion_tag(line) & (F.length(strip(strip_emotion_tags(line))) < MIN_LINE_CHARS)


def first_tag(line) -> Column:
    return F.regexp_extract(column(line), TAG, 0)


def move_tag_to_dialogue(line, tag) -> Column:
    """Puts a tag into the line's first quoted span, before its final punctuation."""
    line, tag = column(line), column(tag)
    span = F.regexp_extract(line, r'"([^"]*)"', 1)
    last = F.substring(span, -1, 1)
    moved = F.when(
        last.isin(".", "!", "?", ",", ":", ";"),
        F.concat(F.regexp_replace(span, r"(?s).\z", ""), F.lit(" "), tag, last)
    ).otherwise(F.concat(span, F.lit(" "), tag, F.lit(".")))

    def quoted(text):
        return F.concat(F.lit('"'), text, F.lit('"'))

    return F.when(line.rlike(r'"[^"]*"'), F.replace(line, quoted(span), quoted(moved))
                  ).otherwise(line)


def fix_tag_punctuation(line) -> Column:
    """Adds the stop that a quotation ending in a tag lacks."""
    def stopped(quote):
        bare = ~quote.rlike(rf"{TAG}[{WS}]*[.!?]") & F.endswith(quote, F.lit('>"'))
        return F.when(bare, F.regexp_replace(quote, r'"\z', '."')).otherwise(quote)

    parts = interleave(line, TAGGED_QUOTE, lambda gap: gap, stopped)
    return F.array_join(parts, "")


def own_repair(line, original) -> Column:
    """A line's repair from itself alone: an orphan loses its tags, quotations get their stop."""
    line = column(line)
    bare = strip(strip_emotion_tags(line))
    kept = F.when(has_emotion_tag(line) & (F.length(bare) < MIN_LINE_CHARS), F.when(
        bare != "", bare).otherwise(F.coalesce(column(original), F.lit("")))).otherwise(line)
    return let(kept, _stop_quotes)


def _stop_quotes(kept: Column) -> Column:
    return F.when(F.contains(kept, F.lit('"')) & has_emotion_tag(kept),
                  fix_tag_punctuation(kept)).otherwise(kept)


def repair_orphans(text, original) -> Column:
    """Moves the tag of an orphan line into the quotation of the line before it.

    A line is changed by its own repair and then by the line after it only, so it is enough to
    look one line ahead.
    """
    both = F.struct(lines_of(text).alias("new"), lines_of(original).alias("old"))

    def repaired(b):
        def line(ln, i):
            own = own_repair(ln, F.get(b["old"], i))
            following = F.get(b["new"], i + 1)

            def receive(kept):
                takes = is_orphan(following) & F.contains(kept, F.lit('"'))
                return F.when(takes, move_tag_to_dialogue(kept, first_tag(following))
                              ).otherwise(kept)

            return let(own, receive)

        return F.array_join(F.transform(b["new"], line), "\n")

    # Only lines with a tag, and those before them, are changed.
    return F.when(F.contains(column(text), F.lit("<")), let(both, repaired)).otherwise(column(text))


def found_tags(text) -> Column:
    return F.array_distinct(F.regexp_extract_all(column(text), F.lit("<[^>]+>"), F.lit(0)))


def reject_reason(text, original) -> Column:
    """Why a tagged text cannot be used: the first rule it breaks, null if none."""
    # What several rules look at is made once: Spark makes it anew for each inside a lambda or a branch.
    seen = F.struct(column(text).alias("text"), column(original).alias("original"), found_tags(text).alias("tags"))
    text = column(text)
    plain = (text == column(original)) & ~(
        F.contains(text, F.lit("<")) | F.contains(text, F.lit(">")) | F.contains(text, F.lit("&")))
    # A text that came back as it was breaks no rule unless it holds a sign that tags are made of.
    return F.when(~F.coalesce(plain, F.lit(False)), let(seen, lambda s: _first_broken(s["text"], s["original"], s["tags"])))


def _first_broken(text: Column, original: Column, tags: Column) -> Column:
    def listed(tags):
        return F.array_join(F.sort_array(tags), ", ")

    def no_blanks(t):
        return F.replace(F.replace(t, F.lit(" "), F.lit("")), F.lit("\n"), F.lit(""))

    def no_space(t):
        return F.regexp_replace(t, rf"[{WS}]+", "")

    def same_signs(pair):
        # Other white space is looked for only where texts differ without the two usual kinds.
        return F.when(pair["text"] == pair["original"], True).otherwise(no_space(pair["text"]) == no_space(pair["original"]))

    invalid = F.array_except(tags, F.array(*map(F.lit, fixed.EMOTION_TAGS)))
    leaked = F.array_intersect(tags, F.array(*map(F.lit, fixed.STRUCTURAL_TAGS)))
    most = let(F.size(words_of(original)), lambda n: F.when(
        (n > 0) & (F.size(tags) > F.greatest(F.lit(1), F.floor(n / 10))), n))
    before = F.size(lines_of(original))
    after = F.size(lines_of(strip_emotion_tags(text)))
    # A text that came back as it was and has no tag needs no search.
    same = F.when((text == original) & ~F.contains(text, F.lit("<")), True).otherwise(let(F.struct(
        no_blanks(F.regexp_replace(text, TAG, "")).alias("text"), no_blanks(original).alias("original")), same_signs))
    return (
        F.when((F.size(invalid) > 0) & (F.size(leaked) > 0),
               F.concat(F.lit("Structural markup leaked from prompt: "), listed(leaked)))
        .when(F.size(invalid) > 0,
              F.concat(F.lit("Invalid emotion tags found: "), listed(invalid)))
        .when(~same, "Text content was modified beyond adding tags.")
        .when(before != after, F.format_string("Line structure changed (%d -> %d lines)",
                                               before, after))
        .when(text.rlike(r"<[^>]*\z|\A[^<]*>"), "Malformed emotion tags found")
        .when(text.rlike("&lt;|&gt;"), "HTML entities found in emotion tags")
        .when(text.rlike(rf"[{WORD}]{TAG}[{WORD}]"), "Emotion tags breaking words detected")
        # One tag is never too many.
        .when((F.size(tags) > 1) & most.isNotNull(),
              F.format_string("Excessive emotion tags detected (%d tags for %d words)", F.size(tags), most))
        .when(text.rlike(rf"{TAG}[{WS}]*{TAG}"), "Consecutive emotion tags detected"))


def clean_response(enhanced) -> Column:
    """A response without the backticks that models put around it."""
    return F.replace(column(enhanced), F.lit("`"), F.lit(""))


def response_reason(clean, original) -> Column:
    return F.when(column(clean).isNull(), "No response").otherwise(
        reject_reason(clean, original))


def validate_tagged(enhanced, original) -> Column:
    """(text, success, reverted, reason): the repaired text, or the original with a reason."""
    clean = clean_response(enhanced)
    reason = response_reason(clean, original)
    return F.struct(
        F.when(reason.isNull(), repair_orphans(clean, original)).otherwise(column(original))
        .alias("text"),
        reason.isNull().alias("success"), reason.isNotNull().alias("reverted"),
        reason.alias("reason"))


def validate_by_line(enhanced, original) -> Column:
    """Every line of a text validated alone; blank lines and missing responses stay as they were."""
    def by_line(answers):
        def checked(line, i):
            def settled(answer):
                usable = ~is_blank(line) & answer.isNotNull() & reject_reason(answer, line).isNull()
                # One line has no neighbours, so its own repair is the whole repair.
                return F.when(usable, own_repair(answer, line)).otherwise(line)

            return let(clean_response(F.get(answers, i)), settled)

        return F.array_join(F.transform(lines_of(original), checked), "\n")

    return let(lines_of(enhanced), by_line)
