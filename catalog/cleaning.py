"""Text cleaning."""

from pyspark.sql import functions as F

from catalog import sqltext as s
from catalog.data import MANIFEST_SQL, manifest, manuscript, ms, table
from scriptmill import fixed
from scriptmill.functions import clean
from catalog.sqltext import LINE_BREAK, WORD, WS
from scriptmill.operators.windows import drop_blank_lines


def _lines(out):
    """A query on the manuscript's lines with one more column."""
    def run(spark, sf_dir):
        return manuscript(spark, sf_dir).select("book_id", "line_no", out())
    return run


def _texts(prepare: str, op):
    """A query on whole documents."""
    def run(spark, sf_dir):
        docs = table(spark, sf_dir, "documents").withColumn("text", F.expr(prepare))
        return docs.select("doc_id", op("text").alias("text"))
    return run


BROKEN = """concat('  ', replace(text, '. ', concat(' .', chr(13), chr(10), ' ', chr(9), chr(10))),
  chr(12), chr(10))"""
QUOTED = """concat(replace(text, ',', '"'), case when doc_id % 2 = 0 then '"' else '' end)"""
MARKED = """case doc_id % 4
  when 0 then concat('CONTENTS PROLOGUE', chr(10), 'PROLOGUE', chr(10), 'The Partners', chr(10), text,
    chr(10), 'Next book', chr(10), 'ABOUT THE AUTHOR ABOUT THE AUTHOR')
  when 1 then concat('PROLOGUE', text) when 2 then concat('PROLOGUE Chapter', text, 'ABOUT THE AUTHOR')
  else concat('ABOUT THE AUTHOR', text, 'PROLOGUE') end"""
THOUGHT = """case doc_id % 4 when 0 then concat('<think>a', chr(10), 'b</think> ', text, '<think>c</think>')
  when 1 then concat(text, '</think>', text) when 2 then concat(text, chr(10), '<think> ')
  else text end"""
LOG = "concat('size= 1kB time=0', cast(event_id % 3 as string), ':', cast(user_id % 60 as string), ':', cast(value as string), case when event_id % 4 = 0 then '.5' else ' x time=9:9:9' end)"


def drop_blank(spark, sf_dir):
    return drop_blank_lines(manuscript(spark, sf_dir))


def book_has_emotion_tags(spark, sf_dir):
    tagged = manuscript(spark, sf_dir).withColumn("line", F.expr(TAGGED))
    return tagged.groupBy("book_id").agg(
        F.bool_or(clean.has_emotion_tag("line")).alias("has_tags"))


TAGGED = ("case when length(book_id) = 4 and line_no % 5 = 0 then concat(replace(line, ' and ', "
          "' <sigh>  and '), '<laugh>') else line end")


def strip_emotion_tags(spark, sf_dir):
    return manuscript(spark, sf_dir).select(
        "book_id", "line_no", clean.strip_emotion_tags(F.expr(TAGGED)).alias("line"))


def key_values(spark, sf_dir):
    return manifest(spark, sf_dir).select(
        "book_id", F.explode(clean.parse_key_values("metadata_text")).alias("key", "value"))


def probe(spark, sf_dir):
    return manifest(spark, sf_dir).select(
        "book_id", clean.parse_probe_json("probe_json").alias("p")).select(
        "book_id", F.col("p.sample_rate").cast("bigint").alias("sample_rate"),
        F.col("p.channels").cast("bigint").alias("channels"), "p.channel_layout", "p.duration")


def progress_time(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        "event_id", clean.parse_progress_time(F.expr(LOG)).alias("ms"))


def safe_path(spark, sf_dir):
    return manifest(spark, sf_dir).select("book_id", clean.is_safe_path("path").alias("safe"))


QUERIES = {
    "ascii_punct": _lines(lambda: clean.ascii_punct("line").alias("line")),
    "normalize_line_breaks": _texts(BROKEN, clean.normalize_line_breaks),
    "fix_unterminated_quotes": _texts(QUOTED, clean.fix_unterminated_quotes),
    "close_quotes": _lines(lambda: clean.close_quotes(clean.ascii_punct("line")).alias("line")),
    "extract_main_content": _texts(MARKED, clean.extract_main_content),
    "is_only_punctuation": _lines(lambda: clean.is_only_punctuation("line").alias("only")),
    "drop_blank_lines": drop_blank,
    "strip_thinking": _texts(THOUGHT, clean.strip_thinking),
    "book_has_emotion_tags": book_has_emotion_tags,
    "strip_emotion_tags": strip_emotion_tags,
    "escape_metadata": _lines(
        lambda: clean.escape_metadata(F.expr("concat(line, ' $<é> \"x\"')")).alias("value")),
    "sanitize_title": _lines(lambda: clean.sanitize_title(
        F.expr("concat('a/b.c & \"d\" <', line, '>')")).alias("title")),
    "speakable_text": _lines(lambda: clean.speakable_text(
        F.concat("line", F.lit(" \\ "))).alias("text")),
    "is_safe_path": safe_path,
    "parse_key_values": key_values,
    "parse_probe_json": probe,
    "parse_progress_time": progress_time,
}

_TITLE = "('a/b.c & \"d\" <' || line || '>')"
_UNSAFE = f"""[^{WORD}{WS}\\-.,!?'"()\\[\\]:;]"""
_LINES = "select book_id, line_no, {} from manuscript"
_MARKS = " or ".join(f"contains(lower(x), {s.q(m)})"
                     for m in ("prologue", "about the author", *fixed.SECTION_WORDS))
_PATH = rf"A-Za-z0-9{WS}\-_.:/'\\,"

SQL = {
    "ascii_punct": ms(_LINES.format(s.ascii_punct("line") + " as line")),
    "normalize_line_breaks": f"""
        select doc_id, array_to_string(list_filter(list_transform(string_split_regex(text,
          {s.q(LINE_BREAK)}), lambda x: {s.strip("x")}), lambda x: x <> ''), chr(10)) as text
        from (select doc_id, {BROKEN} as text from documents)""",
    "fix_unterminated_quotes": f"""
        with t as (select doc_id, {QUOTED} as text from documents),
        l as (select doc_id, unnest(string_split_regex(text, {s.q(LINE_BREAK)})) as line,
          generate_subscripts(string_split_regex(text, {s.q(LINE_BREAK)}), 1) as spot from t)
        select t.doc_id, coalesce(x.text, '') as text from t left join (
          select doc_id, string_agg({s.close_quotes("line")}, chr(10) order by spot) as text
          from l where not {s.blank("line")} group by doc_id) x on x.doc_id = t.doc_id""",
    "close_quotes": ms(
        f"a as (select book_id, line_no, {s.ascii_punct('line')} as line from manuscript) "
        f"select book_id, line_no, {s.close_quotes('line')} as line from a"),
    "extract_main_content": f"""
        with t as (select doc_id, {MARKED} as text from documents),
        p as (select *, contains(text, 'PROLOGUE') and contains(text, 'ABOUT THE AUTHOR') as found,
          length(text) - strpos(reverse(text), reverse('PROLOGUE')) - 6 as a,
          length(text) - strpos(reverse(text), reverse('ABOUT THE AUTHOR')) - 14 as z from t),
        b as (select *, {s.strip("substr(text, a, greatest(z - a, 0))")} as body from p),
        l as (select *, string_split(body, chr(10)) as lines from b),
        k as (select *, list_filter(range(1, len(lines) + 1), lambda i:
          not list_transform([lines[i]], lambda x: {_MARKS})[1]) as keep from l)
        select doc_id, case when not found or length(body) < 100 then text
          when len(keep) = 0 then ''
          else {s.strip("array_to_string(lines[keep[1]:keep[-1]], chr(10))")} end as text from k""",
    "is_only_punctuation": ms(_LINES.format(s.only_punctuation("line") + " as only")),
    "drop_blank_lines": ms(f"""select book_id,
        row_number() over (partition by book_id order by line_no) - 1 as line_no,
        line_no as source_line, {s.strip("line")} as line
        from manuscript where not {s.blank("line")}"""),
    "strip_thinking": f"""select doc_id, {s.strip(s.sub(s.sub(s.sub(
        'text', '(?s)<think>.*?</think>', ''), '(?s)^.*?</think>', '', ''), '</?think>', ''))}
        as text from (select doc_id, {THOUGHT} as text from documents)""",
    "book_has_emotion_tags": ms(f"""select book_id, bool_or({s.like(TAGGED, clean.TAG)}) as has_tags
        from manuscript group by book_id"""),
    "strip_emotion_tags": ms(_LINES.format(s.without_tags(TAGGED) + " as line")),
    "escape_metadata": ms(_LINES.format(
        "replace(" + s.sub("(line || ' $<é> \"x\"')", _UNSAFE, "")
        + """, '"', '\\"') as value""")),
    "sanitize_title": ms(_LINES.format(s.sanitize(_TITLE) + " as title")),
    "speakable_text": ms(f"""a as (select book_id, line_no, {s.strip("line || ' \\ '")} as line
        from manuscript) select book_id, line_no, case when not {s.only_punctuation("line")}
        then replace(replace(line, '"', ''), '\\', '') end as text from a"""),
    "is_safe_path": f"""with {MANIFEST_SQL} select book_id, ({s.like("path", rf"^[{_PATH}]+[.][A-Za-z0-9]{{1,10}}$")}
        or {s.like("path", rf"^[{_PATH}]+/$")}) and not contains(path, '..') as safe from manifest""",
    "parse_key_values": f"""with {MANIFEST_SQL},
        l as (select book_id, unnest(string_split(metadata_text, chr(10))) as line,
          generate_subscripts(string_split(metadata_text, chr(10)), 1) as spot from manifest),
        kv as (select book_id, spot, {s.strip("split_part(line, ': ', 1)")} as key,
          {s.strip("substr(line, strpos(line, ': ') + 2)")} as value
          from l where contains(line, ': '))
        select book_id, key, arg_max(value, spot) as value from kv group by book_id, key""",
    "parse_probe_json": f"""with {MANIFEST_SQL},
        j as (select book_id, case when json_valid(probe_json) then probe_json end as j from manifest),
        a as (select book_id, j, list_filter(from_json(json_extract(j, '$.streams'), '["json"]'),
          lambda x: x->>'$.codec_type' = 'audio')[1] as s from j),
        v as (select book_id, try_cast(s->>'$.sample_rate' as bigint) as r,
          try_cast(s->>'$.channels' as bigint) as c,
          case when j->>'$.format.duration' is null then 0.0
            else try_cast(j->>'$.format.duration' as double) end as d from a)
        select book_id, case when ok then r else 44100 end as sample_rate,
          case when ok then c else 1 end as channels,
          case when ok and c <> 1 then 'stereo' else 'mono' end as channel_layout,
          case when ok then d else cast(0 as double) end as duration
        from (select *, r is not null and c is not null and d is not null as ok from v)""",
    "parse_progress_time": f"""with l as (select event_id, {LOG} as log from events),
        p as (select event_id, regexp_extract(log, 'time=([0-9]+):([0-9]+):([0-9.]+)',
          ['h', 'm', 's']) as t from l)
        select event_id, cast(trunc((try_cast(t.h as double) * 3600 + try_cast(t.m as double) * 60
          + try_cast(t.s as double)) * 1000) as bigint) as ms from p""",
}
