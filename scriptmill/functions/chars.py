"""Character classes and small texts shared by all patterns.

`\\s`, `\\w` and `\\b` are not Unicode in Java's regex, so patterns spell the classes out.
"""

from pyspark.sql import Column, functions as F

# Unicode white space and the four information separators.
WS = r"\p{IsWhite_Space}\x1c-\x1f"
WS_CHARS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(
    map(chr, range(0x2000, 0x200b))) + "\u2028\u2029\u202f\u205f\u3000"
LINE_BREAKS = "\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"
WORD = r"\p{L}\p{N}_"
NOT_AFTER_WORD = rf"(?<![{WORD}])"
NOT_BEFORE_WORD = rf"(?![{WORD}])"
EDGE = rf"(?:(?<=[{WORD}])(?![{WORD}])|(?<![{WORD}])(?=[{WORD}]))"


def column(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value, body) -> Column:
    """`body` of a value that it uses several times and that should be made once."""
    return F.get(F.transform(F.array(column(value)), body), F.lit(0))


def strip(c) -> Column:
    return F.btrim(column(c), F.lit(WS_CHARS))


def is_blank(c) -> Column:
    return strip(c) == ""


def all_lines_of(c) -> Column:
    """Lines at any kind of line break; one of two characters leaves a blank line behind."""
    return lines_of(F.translate(column(c), LINE_BREAKS, "\n" * len(LINE_BREAKS)))


def lines_of(c) -> Column:
    return F.split(column(c), "\n", -1)


def words_of(c) -> Column:
    """Whitespace-separated words; none for a blank text."""
    return F.filter(F.split(column(c), rf"[{WS}]+", -1), lambda w: w != "")


def interleave(text, pattern: str, on_gap, on_hit) -> Column:
    """Pieces of `text` in order: what lies between matches, and the matches themselves."""
    text = column(text)
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    return F.flatten(F.transform(gaps, lambda gap, i: F.array(on_gap(gap), on_hit(F.get(hits, i)))))
