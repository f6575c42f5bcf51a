"""Cleaning of book text and of the small texts around it."""

from pyspark.sql import Column, functions as F

from scriptmill import fixed
from scriptmill.functions.chars import (
    WORD, WS, all_lines_of, column, is_blank, let, lines_of, strip)

PUNCTUATION = r"""!-/:-@\[-`{-~—–…‚„‹›«»‰‱"""
TAG = "<(?:" + "|".join(fixed.EMOTIONS) + ")>"


def ascii_punct(text) -> Column:
    """Curly quotes, long dashes and the ellipsis sign as ASCII."""
    flat = F.translate(column(text), "“”’‘—–", "\"\"''--")
    return F.replace(flat, F.lit("…"), F.lit("..."))


def normalize_line_breaks(text) -> Column:
    """Lines trimmed, blank ones dropped, joined by one newline."""
    trimmed = F.transform(all_lines_of(text), strip)
    return F.array_join(F.filter(trimmed, lambda ln: ln != ""), "\n")


def close_quotes(line) -> Column:
    """One line with an odd number of double quotes gets one more.

    A line that does not end in a quote gets it at the end. One that does gets it before the
    first character that neither is a quote nor stands beside one, else at the start.
    """
    return let(line, _close_quotes)


def _close_quotes(line: Column) -> Column:
    odd = (F.length(line) - F.length(F.replace(line, F.lit('"'), F.lit("")))) % 2 == 1
    inserted = F.regexp_replace(line, r'(?s)\A(.*?)(?<!")([^"])(?!")', '$1"$2')
    return (F.when(~odd, line)
            .when(~F.endswith(line, F.lit('"')), F.concat(line, F.lit('"')))
            .when(inserted != line, inserted)
            .otherwise(F.concat(F.lit('"'), line)))


def fix_unterminated_quotes(text) -> Column:
    """`close_quotes` on every non-blank line of a text."""
    kept = F.filter(all_lines_of(text), lambda ln: ~is_blank(ln))
    return F.array_join(F.transform(kept, close_quotes), "\n")


def extract_main_content(text, start: str = "PROLOGUE", end: str = "ABOUT THE AUTHOR",
                         min_chars: int = 100) -> Column:
    """Text from the last start marker to the last end marker, section lines trimmed."""
    text = column(text)
    found = F.contains(text, F.lit(start)) & F.contains(text, F.lit(end))

    def last_at(marker):
        return F.length(text) - F.length(F.substring_index(text, marker, -1)) - len(marker)

    width = F.greatest(last_at(end) - last_at(start), F.lit(0))
    main = F.when(found, strip(F.substring(text, last_at(start) + 1, width)))
    marks = [m.lower() for m in (start, end)] + fixed.SECTION_WORDS

    def is_section(line):
        hit = F.lit(False)
        for mark in marks:
            hit = hit | F.contains(F.lower(line), F.lit(mark))
        return hit

    def trimmed(lines):
        flags = F.transform(lines, is_section)
        head = F.array_position(flags, False).cast("int")
        tail = F.array_position(F.reverse(flags), False).cast("int")
        return F.when(head == 0, F.lit("")).otherwise(strip(F.array_join(
            F.slice(lines, F.greatest(head, F.lit(1)),
                    F.greatest(F.size(lines) - tail - head + 2, F.lit(0))), "\n")))

    cut = let(main, lambda body: F.when(F.length(body) >= min_chars,
                                        let(lines_of(body), trimmed)))
    return F.coalesce(cut, text)


def is_only_punctuation(text) -> Column:
    return column(text).rlike(rf"\A[{WS}{PUNCTUATION}]*\z")


def strip_thinking(text) -> Column:
    """Reasoning blocks of a model response removed."""
    text = column(text)
    out = F.regexp_replace(text, r"(?s)<think>.*?</think>", "")
    out = F.regexp_replace(out, r"(?s)\A.*?</think>", "")
    out = F.regexp_replace(out, r"</?think>", "")
    # Most responses have none, and are not searched three times for it.
    return strip(F.when(F.contains(text, F.lit("think>")), out).otherwise(text))


def has_emotion_tag(text) -> Column:
    # A plain search first: few texts hold what a tag starts with.
    return F.contains(column(text), F.lit("<")) & column(text).rlike(TAG)


def strip_emotion_tags(text) -> Column:
    text = column(text)
    return F.when(F.contains(text, F.lit("<")), F.regexp_replace(text, rf"{TAG}[{WS}]*", "")).otherwise(text)


def escape_metadata(value) -> Column:
    kept = F.regexp_replace(column(value), rf"""[^{WORD}{WS}\-.,!?'"()\[\]:;]""", "")
    return F.coalesce(F.replace(kept, F.lit('"'), F.lit('\\"')), F.lit(""))


def sanitize_title(text) -> Column:
    """A name that is safe as a file name."""
    out = F.translate(column(text), "/.'\":?\\|*<>", "  ")
    out = F.replace(out, F.lit("&"), F.lit("and"))
    return strip(F.regexp_replace(out, rf"[^A-Za-z0-9\-_]+", " "))


def speakable_text(text) -> Column:
    """What is sent to synthesis; null when there is nothing to say."""
    text = strip(text)
    return F.when(~is_only_punctuation(text), F.translate(text, '"\\', ""))


def is_safe_path(path) -> Column:
    allowed = rf"A-Za-z0-9{WS}\-_.:/'\\,"
    named = rf"\A[{allowed}]+\.[A-Za-z0-9]{{1,10}}\n?\z|\A[{allowed}]+/\n?\z"
    return F.coalesce(column(path).rlike(named) & ~F.contains(column(path), F.lit("..")),
                      F.lit(False))


def parse_key_values(text) -> Column:
    """`Key: value` lines as a map; the last line of a key wins."""
    pairs = F.transform(
        F.filter(lines_of(text), lambda ln: F.contains(ln, F.lit(": "))),
        lambda ln: F.struct(strip(F.substring_index(ln, ": ", 1)).alias("key"),
                            strip(F.regexp_replace(ln, r"(?s)\A.*?: ", "")).alias("value")))

    # Two sorts find the last of each key; looking through the later keys of each would be quadratic in the lines.
    by_key = F.sort_array(F.transform(pairs, lambda p, i: F.struct(
        p["key"].alias("key"), i.alias("at"), p["value"].alias("value"))))

    def last_of_each(sorted_pairs):
        return F.filter(sorted_pairs, lambda p, i: F.coalesce(F.get(sorted_pairs, i + 1)["key"] != p["key"], F.lit(True)))

    in_order = F.sort_array(F.transform(let(by_key, last_of_each), lambda p: F.struct(
        p["at"].alias("at"), p["key"].alias("key"), p["value"].alias("value"))))
    return F.map_from_entries(F.transform(in_order, lambda p: F.struct(p["key"], p["value"])))


PROBE = ("streams array<struct<codec_type string, sample_rate string, channels string>>, "
         "format struct<duration string>")


def parse_probe_json(text) -> Column:
    """First audio stream of a probe report; defaults when it cannot be read."""
    probe = F.from_json(column(text), PROBE)
    # A stream without a type before the audio stream makes the report unreadable.
    typed = F.filter(probe["streams"],
                     lambda s: F.coalesce(s["codec_type"], F.lit("audio")) == "audio")
    audio = F.get(typed, F.lit(0))
    rate = audio["sample_rate"].try_cast("int")
    channels = audio["channels"].try_cast("int")
    written = probe["format"]["duration"]
    seconds = F.when(written.isNull(), F.lit(0.0)).otherwise(written.try_cast("double"))
    good = (audio["codec_type"].isNotNull() & rate.isNotNull() & channels.isNotNull()
            & seconds.isNotNull())
    return F.struct(
        F.when(good, rate).otherwise(44100).alias("sample_rate"),
        F.when(good, channels).otherwise(1).alias("channels"),
        F.when(good & (channels != 1), "stereo").otherwise("mono").alias("channel_layout"),
        F.when(good, seconds).otherwise(0.0).alias("duration"))


def parse_progress_time(log) -> Column:
    """First `time=H:M:S` of a log in whole milliseconds, null if there is none."""
    pattern = r"time=(\d+):(\d+):([\d.]+)"
    hours, minutes, seconds = (
        F.regexp_extract(column(log), pattern, i).try_cast("double") for i in (1, 2, 3))
    return ((hours * 3600 + minutes * 60 + seconds) * 1000).cast("bigint")
