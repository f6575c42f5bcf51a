"""SQL expressions that several checks use."""

import re

from scriptmill import fixed
from scriptmill.functions.clean import PUNCTUATION, TAG

# The same classes as in the library, in the words of RE2.
WS = r"\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WORD = r"\p{L}\p{N}_"
LINE_BREAK = r"\r\n|[\n-\r\x1c-\x1e\x85\x{2028}\x{2029}]"


def q(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


def fill(template, **values):
    """A request's wording with SQL at its places."""
    parts = re.split(r"\{(\w+)\}", template)
    return " || ".join(values[p] if i % 2 else q(p) for i, p in enumerate(parts) if p)


def sub(x, pattern, to, flags="g"):
    return f"regexp_replace({x}, {q(pattern)}, {q(to)}, {q(flags)})"


def like(x, pattern):
    return f"regexp_matches({x}, {q(pattern)})"


def strip(x):
    return sub(x, rf"\A[{WS}]+|[{WS}]+\z", "")


def blank(x):
    return f"({strip(x)} = '')"


def tokens(x):
    return f"len(regexp_extract_all({x}, {q(rf'[{WORD}]+|[^{WORD}{WS}]')}))"


def words(x):
    return f"list_filter(string_split_regex({x}, {q(rf'[{WS}]+')}), lambda w: w <> '')"


def only_punctuation(x):
    return like(x, rf"\A[{WS}{PUNCTUATION}]*\z")


def ascii_punct(x):
    return f"replace(translate({x}, '“”’‘—–', '\"\"''''--'), '…', '...')"


def sanitize(x):
    x = f"replace(replace({x}, '/', ' '), '.', ' ')"
    x = sub(x, r"""['":?\\|*<>]""", "")
    x = f"replace({x}, '&', 'and')"
    return strip(sub(sub(x, r"[^A-Za-z0-9\-_]", " "), " +", " "))


def close_quotes(x):
    spot = (f"list_filter(range(1, length({x}) + 1), lambda i: {x}[i] <> '\"' "
            f"and (i = 1 or {x}[i - 1] <> '\"') and (i = length({x}) or {x}[i + 1] <> '\"'))[1]")
    return (f"case when len(regexp_extract_all({x}, '\"')) % 2 = 0 then {x} "
            f"when not ends_with({x}, '\"') then {x} || '\"' "
            f"when {spot} is null then '\"' || {x} "
            f"else substr({x}, 1, cast({spot} - 1 as bigint)) || '\"' || substr({x}, cast({spot} as bigint)) end")


def heading(x):
    token = f"lower(regexp_extract({x}, {q(rf'(?i)^(chapter|part)[{WS}]+([{WORD}-]+)')}, 2))"
    names = "[" + ", ".join(q(w) for w in fixed.NUMBER_WORDS) + "]"
    return f"({like(token, '^[0-9]+$')} or list_has_any(string_split({token}, '-'), {names}))"


def without_tags(x):
    return sub(x, rf"{TAG}[{WS}]*", "")


KEYWORD = (rf"(?i)(^|[^{WORD}])(" + "|".join(fixed.EMOTIONS) + rf")(ed|ing|s|es)?($|[^{WORD}])")

# Parts of the lines of `manuscript`: gaps and quotations in turn.
PARTS = """cut as (select *, string_split_regex(line, '"[^"]+"') as gaps,
  regexp_extract_all(line, '"[^"]+"') as hits from {lines}),
pieces as (select * exclude (gaps, hits), unnest(list_concat(
  list_transform(range(1, len(gaps) + 1), lambda i: {{'spot': 2 * i, 'piece': gaps[i], 'hit': false}}),
  list_transform(range(1, len(hits) + 1), lambda i: {{'spot': 2 * i + 1, 'piece': hits[i], 'hit': true}})
  ), recursive := true) from cut)"""
