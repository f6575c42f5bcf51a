"""Narration plans, timelines and output settings."""

from pyspark.sql import functions as F

from catalog import sqltext as s
from catalog.casting import MANUSCRIPT_SCRIPT_SQL, VOICES_SQL, manuscript_script
from catalog.data import CHARACTERS_SQL, MANIFEST_SQL, characters, manifest, manuscript, ms
from catalog.segmenting import ready_sql
from catalog.windows import ASSIGNED_SQL
from scriptmill.functions.clean import ascii_punct, close_quotes, parse_key_values, parse_probe_json
from scriptmill.plans import narration
from scriptmill.session import stage


def cleaned(spark, sf_dir):
    """The manuscript as plans read it. Staged, as a plan goes through its lines more than once."""
    return stage(manuscript(spark, sf_dir).withColumn("line", close_quotes(ascii_punct("line"))), "cleaned")


def plan_single(spark, sf_dir):
    return narration.narration_plan_single(cleaned(spark, sf_dir), "kokoro", "male").withColumn(
        "part_no", F.col("part_no").cast("bigint")).drop("speaker")


def plan_multi(spark, sf_dir):
    return narration.narration_plan_multi(
        stage(manuscript_script(spark, sf_dir), "script"), characters(spark, sf_dir), "orpheus", "female"
    ).withColumn("part_no", F.col("part_no").cast("bigint"))


# Books whose number is even have tagged lines; of scripts, those that end in 4 or 8 lack one.
TAGGED_BOOK = "right(book_id, 1) in ('0', '2', '4', '6', '8')"
SHORT_BOOK = "right(book_id, 1) in ('4', '8')"
TAGGED = """replace(line, '" ', ' <laugh>" ')"""


def plan_prepared(spark, sf_dir):
    lines = cleaned(spark, sf_dir)
    tagged = lines.where(TAGGED_BOOK).withColumn("line", F.expr(TAGGED))
    return narration.narration_plan_single(
        narration.prepared_lines(lines, "orpheus", tagged), "orpheus", "female").withColumn(
        "part_no", F.col("part_no").cast("bigint")).drop("speaker")


def script_prepared(spark, sf_dir):
    script = stage(manuscript_script(spark, sf_dir), "script")
    tagged = script.where(TAGGED_BOOK).where(f"item_no > 0 or not {SHORT_BOOK}").select(
        "book_id", F.col("item_no").alias("line_no"), F.expr(TAGGED).alias("line"))
    return narration.prepared_script(script, "orpheus", tagged)


def untagged_script(spark, sf_dir):
    script = manuscript_script(spark, sf_dir).withColumn("line", F.expr(TAGGED))
    return narration.prepared_script(script, "kokoro")


def rollup(spark, sf_dir):
    return narration.voice_rollup(
        narration.narration_plan_single(cleaned(spark, sf_dir), "kokoro", "male"))


def book_options(spark, sf_dir):
    return narration.book_options(manifest(spark, sf_dir)).select("book_id", "is_valid", "message")


def timeline(spark, sf_dir):
    spoken, chapters = narration.spoken_lines(manuscript(spark, sf_dir))
    return narration.chapter_timeline(narration.chapter_durations(
        spoken, chapters, (F.length("line") * 40).cast("bigint")))


def metadata_tags(spark, sf_dir):
    return manifest(spark, sf_dir).select("book_id", F.explode(narration.metadata_tags(
        parse_key_values("metadata_text"))).alias("tag", "value"))


def encode_profile(spark, sf_dir):
    probe = parse_probe_json("probe_json")["sample_rate"]
    return manifest(spark, sf_dir).select("book_id", narration.encode_profile(
        probe, "output_format").alias("p")).select(
        "book_id", F.col("p.sample_rate").cast("bigint").alias("sample_rate"), "p.bitrate")


def titles(spark, sf_dir):
    return manifest(spark, sf_dir).select(
        "book_id", narration.book_title("title", "path").alias("title"))


def output_name(spark, sf_dir):
    return manifest(spark, sf_dir).select("book_id", narration.output_name(
        narration.book_title("title", "path"), F.upper("output_format")).alias("name"))


QUERIES = {
    "narration_rollup": rollup,
    "narration_plan_single": plan_single,
    "narration_plan_multi": plan_multi,
    "narration_plan_prepared": plan_prepared,
    "prepared_script": script_prepared,
    "untagged_script": untagged_script,
    "book_options": book_options,
    "chapter_timeline": timeline,
    "metadata_tags": metadata_tags,
    "encode_profile": encode_profile,
    "book_title_from_path": titles,
    "output_name": output_name,
}

PLAN_SQL = f"""nonblank as (select book_id, {s.strip(s.ascii_punct("line"))} as line,
  row_number() over (partition by book_id order by line_no) - 1 as line_no
  from manuscript where not {s.blank("line")}),
closed as (select book_id, line_no, {s.close_quotes("line")} as line from nonblank),
{ASSIGNED_SQL.replace("from manuscript", "from closed")},
numbered as (select a.*, c.chapter_no from assigned a join chapters c using (book_id, chapter)),
{s.PARTS.format(lines="numbered")},
typed as (select *, row_number() over (partition by book_id, line_no order by spot) - 1 as part_no,
  case when starts_with(piece, '"') and ends_with(piece, '"') then 'dialogue' else 'narration' end as type
  from pieces where piece <> ''),
plan as (select book_id, chapter_no, chapter, line_no, part_no, type,
  case type when 'narration' then 'am_puck' else 'af_alloy+am_puck' end as voice,
  replace(replace({s.strip("piece")}, '"', ''), '\\', '') as text
  from typed where not {s.only_punctuation("piece")})"""

MULTI_SQL = f"""{MANUSCRIPT_SCRIPT_SQL.replace("cut as", "item_cut as").replace("from cut)", "from item_cut)").replace("pieces as", "item_pieces as").replace("from pieces where", "from item_pieces where")},
{CHARACTERS_SQL}, {VOICES_SQL},
tidy as (select book_id, item_no as line_no, speaker, {s.strip("line")} as line from script),
{ASSIGNED_SQL.replace("from manuscript", "from tidy")},
numbered as (select a.*, c.chapter_no, t.speaker from assigned a join chapters c using (book_id, chapter)
  join tidy t using (book_id, line_no)),
{s.PARTS.format(lines="numbered")},
typed as (select *, row_number() over (partition by book_id, line_no order by spot) - 1 as part_no,
  case when starts_with(piece, '"') and ends_with(piece, '"') then 'dialogue' else 'narration' end as type
  from pieces where piece <> ''),
scored as (select t.*, case when type = 'narration' or lower(speaker) = 'narrator' then 0
  else coalesce(c.gender_score, 5) end as score
  from typed t left join characters c on c.book_id = t.book_id and c.name = lower(t.speaker))
select x.book_id, chapter_no, chapter, line_no, part_no, type, speaker, v.voice,
  replace(replace({s.strip("piece")}, '"', ''), '\\', '') as text
from scored x join voices v on v.engine = 'orpheus' and v.narrator_gender = 'female'
  and v.score = cast(x.score as varchar) where not {s.only_punctuation("piece")}"""

TIMELINE_SQL = f"""nonblank as (select book_id, {s.strip("line")} as line,
  row_number() over (partition by book_id order by line_no) - 1 as line_no
  from manuscript where not {s.blank("line")}),
{ASSIGNED_SQL.replace("from manuscript", "from nonblank")},
lengths as (select book_id, chapter, cast(sum(length(line) * 40) + 1000 as bigint) as duration_ms
  from assigned group by all),
timeline as (select book_id, chapter_no, chapter, duration_ms, cast(sum(duration_ms) over (
  partition by book_id order by chapter_no) as bigint) as end_ms, cast(sum(duration_ms) over (
  partition by book_id order by chapter_no) - duration_ms as bigint) as start_ms
  from lengths join chapters using (book_id, chapter))"""

_KV = f"""with {MANIFEST_SQL},
  l as (select book_id, unnest(string_split(metadata_text, chr(10))) as line,
    generate_subscripts(string_split(metadata_text, chr(10)), 1) as spot from manifest),
  kv as (select book_id, {s.strip("split_part(line, ': ', 1)")} as key,
    arg_max({s.strip("substr(line, strpos(line, ': ') + 2)")}, spot) as value
    from l where contains(line, ': ') group by 1, 2)"""
_ESCAPED = "replace(" + s.sub("value", rf"""[^{s.WORD}{s.WS}\-.,!?'"()\[\]:;]""", "") + """, '"', '\\"')"""
_BASE = "regexp_extract(path, '([^/]*)$', 1)"
_STEM = s.sub(_BASE, r"\A(\.*[^.].*)\.[^.]*\z", r"\1", "")
_TITLE = s.sanitize(f"case when title <> '' then title else {_STEM} end")
_PATH = rf"A-Za-z0-9{s.WS}\-_.:/'\\,"
_SAFE = (f"({s.like('path', rf'^[{_PATH}]+[.][A-Za-z0-9]{{1,10}}$')} or "
         f"{s.like('path', rf'^[{_PATH}]+/$')}) and not contains(path, '..')")

SQL = {
    "narration_rollup": ms(PLAN_SQL + """ select book_id, chapter_no, chapter, voice,
        count(*) as n_parts, cast(sum(length(text)) as bigint) as n_chars from plan group by all"""),
    "narration_plan_single": ms(PLAN_SQL + " select * from plan"),
    "narration_plan_multi": ms(MULTI_SQL),
    "narration_plan_prepared": ms(f"""varied as (select book_id, line_no, {s.close_quotes(s.ascii_punct("line"))} as line
          from manuscript),
        ready as ({ready_sql("line_no")}),
        lines as (select book_id, line_no, case when {TAGGED_BOOK} then {TAGGED} else ready end as line
          from varied join ready using (book_id, line_no)),
        {PLAN_SQL.replace("from manuscript", "from lines").replace("am_puck' else 'af_alloy+am_puck", "tara' else 'leah")}
        select * from plan"""),
    "prepared_script": ms(f"""{MANUSCRIPT_SCRIPT_SQL},
        varied as (select book_id, item_no as line_no, case when {TAGGED_BOOK} and not {SHORT_BOOK} then {TAGGED}
          else line end as line from script),
        ready as ({ready_sql("0")})
        select s.book_id, s.item_no, s.speaker, r.ready as line from script s
        join ready r on r.book_id = s.book_id and r.line_no = s.item_no"""),
    "untagged_script": ms(f"""{MANUSCRIPT_SCRIPT_SQL} select book_id, item_no, speaker,
        {s.without_tags(TAGGED)} as line from script"""),
    "book_options": f"""with {MANIFEST_SQL},
        m as (select book_id, case
          when output_format not in ('m4b','aac','m4a','mp3','wav','opus','flac','pcm') then 'Invalid output format'
          when narrator_gender not in ('male', 'female') then 'Invalid narrator gender'
          when output_format <> 'm4b' then null
          when not ({_SAFE}) then 'Invalid or inaccessible book file: ' || path
          when not contains(metadata_text, ': ') then 'No metadata could be extracted from the book file: ' || path
          when not has_cover then 'Could not extract cover image from the book file: ' || path
          end as message from manifest)
        select *, message is null as is_valid from m""",
    "chapter_timeline": ms(TIMELINE_SQL + " select * from timeline"),
    "metadata_tags": _KV + f""", t as (
        select book_id, unnest(case key when 'Title' then ['title', 'album'] when 'Author(s)' then ['artist']
          when 'Publisher' then ['publisher'] when 'Languages' then ['language']
          when 'Published' then ['date'] when 'Comments' then ['description'] else [] end) as tag,
          {_ESCAPED} as value from kv
        union all select book_id, 'genre', 'Audiobook' from manifest)
        select * from t where value <> ''""",
    "encode_profile": f"""with {MANIFEST_SQL}, r as (select book_id, output_format as f,
          case cast(book_id as bigint) % 6 when 0 then 48000 when 1 then 8000 + cast(book_id as bigint) * 150
            when 5 then 22050 else 44100 end as r from manifest)
        select book_id, case when f <> 'opus' then r when r <= 10000 then 8000 when r <= 14000 then 12000
          when r <= 20000 then 16000 when r <= 36000 then 24000 else 48000 end as sample_rate,
          case when f = 'opus' then case when r <= 10000 then '64k' when r <= 14000 then '80k'
            when r <= 20000 then '96k' when r <= 36000 then '128k' else '160k' end
          when f = 'mp3' then case when r >= 44100 then '192k' else '160k' end
          when f in ('m4a', 'm4b') then '256k' end as bitrate from r""",
    "book_title_from_path": f"with {MANIFEST_SQL} select book_id, {_TITLE} as title from manifest",
    "output_name": f"with {MANIFEST_SQL} select book_id, {_TITLE} || '.' || lower(output_format) as name from manifest",
}
