"""Cleaning and paragraphs of books of many documents, as tables of lines."""

from pyspark.sql import functions as F

from catalog import sqltext as s
from catalog.cleaning import _MARKS, MARKED, QUOTED
from catalog.data import table
from catalog.windows import SPACED
from scriptmill.operators import manuscripts
from scriptmill.session import stage
from scriptmill.sources.books import document_lines


def book_lines(spark, sf_dir, prepare):
    """The lines of books of up to 64 documents of a source, each document changed by `prepare`."""
    return document_lines(table(spark, sf_dir, "documents").select(
        F.concat("source", F.lit("-"), F.floor(F.col("doc_id") / 64).cast("string")).alias("book_id"), "doc_id",
        F.expr(prepare).alias("text")))


def normalized(spark, sf_dir):
    return manuscripts.normalize_lines(book_lines(spark, sf_dir, SPACED))


def closed(spark, sf_dir):
    return manuscripts.close_line_quotes(book_lines(spark, sf_dir, QUOTED))


def main_content(spark, sf_dir):
    return manuscripts.main_content_lines(book_lines(spark, sf_dir, MARKED))


def joined(spark, sf_dir):
    return manuscripts.join_paragraph_lines(book_lines(spark, sf_dir, SPACED))


def split_back(spark, sf_dir):
    """Paragraphs of which every third comes back with its markers lost."""
    paragraphs = stage(joined(spark, sf_dir), "joined")
    answer = F.expr("case when paragraph_no % 3 = 1 then replace(text, ' ||| ', ' ') else text end")
    return manuscripts.split_paragraph_lines(paragraphs.withColumn("text", answer), paragraphs)


QUERIES = {
    "normalize_lines": normalized,
    "close_line_quotes": closed,
    "main_content_lines": main_content,
    "join_paragraph_lines": joined,
    "split_paragraph_lines": split_back,
}

_LINES = """l as (select book_id, doc_id, unnest(parts) as line, unnest(range(0, len(parts))) as nth from (
  select source || '-' || (doc_id // 64) as book_id, doc_id, {split} as parts from documents))"""
_ROW = "row_number() over (partition by book_id order by doc_id, nth) - 1"
_RUNS = _LINES.format(split=f"string_split({SPACED}, chr(10))") + f""",
b as (select *, {_ROW} as line_no, {s.blank("line")} as blank from l),
g as (select *, sum(case when blank or before then 1 else 0 end) over (partition by book_id order by line_no) - 1 as paragraph_no
  from (select *, coalesce(lag(blank) over (partition by book_id order by line_no), true) as before from b)),
p as (select book_id, cast(paragraph_no as bigint) as paragraph_no, bool_and(blank) as blank, count(*) as n,
  string_agg(line, ' ||| ' order by line_no) as text from g group by all)"""


def _any_line(prepare):
    return _LINES.format(split=f"string_split_regex({prepare}, {s.q(s.LINE_BREAK)})")


SQL = {
    "normalize_lines": f"""with {_any_line(SPACED)}
        select book_id, {_ROW} as line_no, {s.strip("line")} as line from l where not {s.blank("line")}""",
    "close_line_quotes": f"""with {_any_line(QUOTED)}
        select book_id, {_ROW} as line_no, {s.close_quotes("line")} as line from l where not {s.blank("line")}""",
    "main_content_lines": f"""
        with t as (select source || '-' || (doc_id // 64) as book_id,
          string_agg({MARKED}, chr(10) order by doc_id) as text from documents group by 1),
        p as (select *, contains(text, 'PROLOGUE') and contains(text, 'ABOUT THE AUTHOR') as found,
          length(text) - strpos(reverse(text), reverse('PROLOGUE')) - 6 as a,
          length(text) - strpos(reverse(text), reverse('ABOUT THE AUTHOR')) - 14 as z from t),
        b as (select *, {s.strip("substr(text, a, greatest(z - a, 0))")} as body from p),
        n as (select *, string_split(body, chr(10)) as lines from b),
        k as (select *, list_filter(range(1, len(lines) + 1), lambda i:
          not list_transform([lines[i]], lambda x: {_MARKS})[1]) as keep from n),
        c as (select book_id, string_split(case when not found or length(body) < 100 then text
          when len(keep) = 0 then '' else {s.strip("array_to_string(lines[keep[1]:keep[-1]], chr(10))")} end, chr(10)) as parts
          from k)
        select book_id, unnest(range(0, len(parts))) as line_no, unnest(parts) as line from c""",
    "join_paragraph_lines": f"""with {_RUNS} select book_id, paragraph_no,
        case when blank then 0 else n end as size, text from p""",
    "split_paragraph_lines": f"""with {_RUNS},
        a as (select *, case when paragraph_no % 3 = 1 then replace(text, ' ||| ', ' ') else text end as answer from p),
        r as (select book_id, paragraph_no, case when blank then [''] when len(string_split(answer, ' ||| ')) = n
          then string_split(answer, ' ||| ') else [answer] end as parts from a),
        u as (select book_id, paragraph_no, unnest(parts) as line, unnest(range(0, len(parts))) as nth from r)
        select book_id, row_number() over (partition by book_id order by paragraph_no, nth) - 1 as line_no, line from u""",
}
