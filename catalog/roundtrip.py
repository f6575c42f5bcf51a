"""Tagging from requests to reassembled lines, with a stand-in for the model."""

from pyspark.sql import functions as F

from catalog import sqltext as s
from catalog.budgets import INSIDE_SQL, KEYS, chunks_sql, narrative
from catalog.data import ms
from catalog.tagging import has_tag, own_sql, reason_sql, repair_sql, stop_sql
from scriptmill.operators import answers, budgets, roundtrip, windows
from scriptmill.operators.registry import TAG
from scriptmill.session import new_path, stage


def stand_in(texts):
    """Stands for a model: by a text's length it reasons and tags, breaks a rule, loses line marks, or fails."""
    bodies = [t.split("\n", 1)[1].rsplit("\n", 1)[0] for t in texts]
    if any(len(b) % 6 == 5 for b in bodies):
        raise ValueError("out of words")
    return [(f"<think>{len(b)}?</think>\n" + b.replace('" ', ' <laugh>" '), b + " <smile>", b + " extra",
             b.replace(" and ", " and <gasp> "), b.replace(" ||| ", " | "))[len(b) % 6] for b in bodies]


def _chunks(lines):
    made = windows.window_chunks(lines, windows.emotion_windows(lines, n=8), max_tokens=120)
    return budgets.group_text(lines, made, KEYS, "line_no", "line", "chunk_no").withColumnRenamed("text", "original")


def _asked(spark):
    log = new_path(spark, "answer-log")
    return lambda requests: answers.ask(requests, stand_in, log, partitions=8)


def tag_chunks(spark, sf_dir):
    return roundtrip.tag_chunks(_chunks(narrative(spark, sf_dir)), _asked(spark)).select(
        "book_id", "chunk_no", "text", "success", "reason", "lines_tagged")


def tag_lines(spark, sf_dir):
    lines = narrative(spark, sf_dir)
    return roundtrip.tag_lines(lines, _chunks(lines), _asked(spark))


def answered_requests(spark, sf_dir):
    """Chunk requests asked twice through one log: the second time only those that failed are asked."""
    requests = stage(roundtrip.chunk_requests(_chunks(narrative(spark, sf_dir))), "requests")
    log = new_path(spark, "answer-log")
    answers.ask(requests, stand_in, log, partitions=8)
    return answers.ask(requests, lambda texts: ["again"] * len(texts), log, partitions=8).select(
        "book_id", "chunk_no", "tokens", "response", F.col("error").isNotNull().alias("failed"))


QUERIES = {"tag_chunks": tag_chunks, "tag_lines": tag_lines, "answered_requests": answered_requests}


def reply_sql(x):
    return f"""case length({x}) % 6 when 0 then replace({x}, '" ', ' <laugh>" ') when 1 then {x} || ' <smile>'
  when 2 then {x} || ' extra' when 3 then replace({x}, ' and ', ' and <gasp> ')
  when 4 then replace({x}, ' ||| ', ' | ') end"""


CHUNKED_SQL = f"""{INSIDE_SQL},{chunks_sql("inside", 120, "first")},
asked as (select c.book_id, c.chunk_no, c.start_line, c.end_line,
  string_agg(i.line, chr(10) order by i.line_no) as original from chunks c join inside i
  on i.book_id = c.book_id and i.line_no >= c.start_line and i.line_no < c.end_line group by all),
joined as (select *, replace(original, chr(10), ' ||| ') as body,
  len(string_split(original, chr(10))) as size from asked)"""
_line_reasons = reason_sql("line_replies", "book_id, chunk_no, nth").replace("reasons as", "line_reasons as", 1)
TAGGED_SQL = f"""{CHUNKED_SQL},
replies as (select *, {s.strip(reply_sql("body"))} as reply from joined),
tagged as (select book_id, chunk_no, original, case when len(string_split(reply, ' ||| ')) = size
  then replace(reply, ' ||| ', chr(10)) else reply end as enhanced from replies),
{reason_sql("tagged", "book_id, chunk_no").replace("reason\n  from", "found\n  from")},
judged as (select *, case when clean is null then 'No response' else found end as reason from reasons),
fixable as (select book_id, chunk_no, clean as enhanced, original from judged where reason is null),
{repair_sql("fixable", "book_id, chunk_no")},
split as (select book_id, chunk_no, unnest(string_split(original, chr(10))) as original,
  unnest(range(1, len(string_split(original, chr(10))) + 1)) as nth from judged where reason is not null),
line_replies as (select book_id, chunk_no, nth, original, {s.strip(reply_sql("original"))} as enhanced from split),
{_line_reasons},
line_kept as (select *, {own_sql("clean", "original")} as kept from line_reasons),
line_new as (select *, case when clean is null or reason is not null then original
  when contains(kept, '"') and {has_tag("kept")} then {stop_sql("kept")} else kept end as line from line_kept),
lines_back as (select book_id, chunk_no, string_agg(line, chr(10) order by nth) as text,
  count(*) filter (line <> original) as lines_tagged from line_new group by all),
settled as (select j.book_id, j.chunk_no, coalesce(b.text, p.text) as text, reason is null as success,
  reason, lines_tagged from judged j left join repaired p using (book_id, chunk_no)
  left join lines_back b using (book_id, chunk_no))"""

SQL = {
    "tag_chunks": ms(TAGGED_SQL + " select * from settled", True),
    "tag_lines": ms(TAGGED_SQL + """,
        back as (select s.book_id, unnest(string_split(s.text, chr(10))) as tagged,
          unnest(range(0, len(string_split(s.text, chr(10))))) + a.start_line as line_no
          from settled s join asked a using (book_id, chunk_no)
          where len(string_split(s.text, chr(10))) = a.end_line - a.start_line)
        select n.book_id, n.line_no, coalesce(b.tagged, n.line) as line, b.tagged is not null as replaced,
          null::varchar as message from narrative n left join back b using (book_id, line_no)""", True),
    "answered_requests": ms(CHUNKED_SQL + f""",
        said as (select book_id, chunk_no, body, {s.fill(TAG, lines="body")} as request,
          {reply_sql("body")} as reply from joined)
        select book_id, chunk_no, {s.tokens("request")} as tokens, case when reply is null then 'again'
          when length(body) % 6 = 0 then '<think>' || length(body) || '?</think>' || chr(10) || reply
          else reply end as response, false as failed from said""", True),
}
