"""Voices, speakers and joins onto scripts."""

from pyspark.sql import functions as F

from catalog import sqltext as s
from catalog.data import (
    CHARACTERS_SQL, CONVERSATION_SCRIPT_SQL, characters, conversation_script, manuscript, ms, table)
from catalog.segmenting import ITEMS_SQL
from scriptmill import fixed
from scriptmill.functions.segment import split_dialogue
from scriptmill.operators import script as scripts, voices, windows

# Speaker of a dialogue item: the name its line was made with.
SPEAKER = ("case when type = 'narrator' then 'narrator' else case line_no % 5 when 0 then 'Mia' "
           "when 1 then 'sam' when 2 then 'Ellie' when 3 then 'jack' else 'Luna' end end")
MANUSCRIPT_SCRIPT_SQL = f"""{ITEMS_SQL},
script as (select book_id, item_no, {SPEAKER} as speaker, content as line from items)"""


def manuscript_script(spark, sf_dir):
    return windows.to_items(manuscript(spark, sf_dir)).select(
        "book_id", "item_no", F.expr(SPEAKER).alias("speaker"), F.col("content").alias("line"))


def load_voices(spark, sf_dir):
    """The voice table with the number of characters that get each voice."""
    used = characters(spark, sf_dir).groupBy(
        F.col("gender_score").cast("string").alias("score")).agg(F.count(F.lit(1)).alias("n"))
    return voices.load_voices(spark).join(used, "score", "left").select(
        "engine", "narrator_gender", "score", "voice", F.coalesce("n", F.lit(0)).alias("n_used"))


def voices_multi(spark, sf_dir):
    return voices.assign_voice_multi(manuscript_script(spark, sf_dir), characters(spark, sf_dir),
                                     "kokoro", "female").select(
        "book_id", "item_no", "speaker", "voice")


OWN_MAP = voices.VOICE_MAP.replace('"af_', '"own_af_').replace('"am_', '"own_am_')


def voices_own_map(spark, sf_dir):
    """Casting by a user's own voice map."""
    return voices.assign_voice_multi(manuscript_script(spark, sf_dir), characters(spark, sf_dir),
                                     "kokoro", "female", OWN_MAP).select("book_id", "item_no", "speaker", "voice")


def voices_single(spark, sf_dir):
    parts = manuscript(spark, sf_dir).select(
        "book_id", "line_no", F.posexplode(split_dialogue("line")).alias("p", "part")).select(
        "book_id", "line_no", F.col("p").cast("bigint").alias("part_no"), "part.type")
    return voices.assign_voice_single(parts, "orpheus", "male")


ENGINE = "case when page_id % 2 = 0 then 'kokoro' else 'orpheus' end"


def require_engine(spark, sf_dir):
    wanted = table(spark, sf_dir, "pages").select("page_id", F.expr(ENGINE).alias("engine"))
    return voices.require_engine(wanted)


TAGGED_LINES = """select book_id, item_no as line_no, concat(line, ' <sigh>') as line
  from {script} where not (book_id like '%1' and item_no = 0) and not (book_id like '%2')"""


def apply_tagged(spark, sf_dir):
    script = conversation_script(spark, sf_dir)
    tagged = spark.sql(TAGGED_LINES, script=script)
    return scripts.apply_tagged_lines(script, tagged)


def map_back(spark, sf_dir):
    script = manuscript_script(spark, sf_dir)
    tagged = windows.drop_blank_lines(manuscript(spark, sf_dir)).select(
        "book_id", "line_no", F.concat(F.lit("<gasp> "), "line").alias("line"))
    return scripts.map_back_to_script(script, tagged)


def lower_script(spark, sf_dir):
    return manuscript_script(spark, sf_dir).withColumn("speaker", F.lower("speaker"))


def unknown_speakers(spark, sf_dir):
    found = scripts.unknown_speakers(lower_script(spark, sf_dir), characters(spark, sf_dir))
    return found.select("book_id", "name", F.col("name_no").cast("bigint").alias("name_no"),
                        F.col("sample_no").cast("bigint").alias("sample_no"), "sample")


def found_characters(spark, sf_dir):
    return scripts.found_characters(characters(spark, sf_dir))


def match_speakers(spark, sf_dir):
    return scripts.match_by_name(windows.to_items(manuscript(spark, sf_dir)),
                                 characters(spark, sf_dir))


def check_matches(spark, sf_dir):
    answers = lower_script(spark, sf_dir).select("book_id", "item_no", "speaker")
    return scripts.check_matches(answers, characters(spark, sf_dir))


def attribute(spark, sf_dir):
    items = windows.to_items(manuscript(spark, sf_dir))
    return scripts.attribute(items, scripts.match_by_name(items, characters(spark, sf_dir)))


def voice_combinations(spark, sf_dir):
    """Combinations of the voices that the books' scores use."""
    used = characters(spark, sf_dir).select(
        voices.voice_of_score("gender_score", "kokoro", "male").alias("voice")).distinct()
    return voices.voice_combinations(used.select(F.col("voice").alias("pos"), "voice"))


RESULTS = """select source as book_id, cast(doc_id % 5 as bigint) as priority,
  case when doc_id % 3 = 0 then text else 'No search results found for this book.' end
  as result, doc_id from {documents}"""


def first_usable(spark, sf_dir):
    results = spark.sql(RESULTS, documents=table(spark, sf_dir, "documents")).withColumn(
        "priority", F.struct("priority", "doc_id"))
    return scripts.first_usable_source(results)


QUERIES = {
    "load_voices": load_voices,
    "assign_voice_multi": voices_multi,
    "assign_voice_own_map": voices_own_map,
    "assign_voice_single": voices_single,
    "require_engine": require_engine,
    "apply_tagged_lines": apply_tagged,
    "map_back_to_script": map_back,
    "unknown_speakers": unknown_speakers,
    "found_characters": found_characters,
    "match_speakers": match_speakers,
    "check_matches": check_matches,
    "attribute_speakers": attribute,
    "voice_combinations": voice_combinations,
    "first_usable_source": first_usable,
}

_VOICES = ", ".join(
    f"('{e}', '{g}', '{i}', '{v}')" for (e, g), names in fixed.VOICE_SCORES.items()
    for i, v in enumerate(names))
VOICES_SQL = f"voices as (select * from (values {_VOICES}) as v(engine, narrator_gender, score, voice))"
MATCH_SQL = f"""{ITEMS_SQL},
{CHARACTERS_SQL},
named as (select i.book_id, i.line_no, c.name from items i join characters c using (book_id)
  where i.type = 'narrator' and c.name not in ('narrator', 'unknown')
  and regexp_matches(lower(i.content), '(^|[^{s.WORD}])' || c.name || '($|[^{s.WORD}])')),
single as (select book_id, line_no, min(name) as name from named group by all
  having count(distinct name) = 1),
matches as (select i.book_id, i.item_no, coalesce(s.name, 'unknown') as speaker
  from items i left join single s using (book_id, line_no) where i.type = 'dialogue')"""

SQL = {
    "load_voices": f"""with {CHARACTERS_SQL}, {VOICES_SQL} select v.*,
        (select count(*) from characters c where cast(c.gender_score as varchar) = v.score) as n_used
        from voices v""",
    "assign_voice_multi": ms(f"""{MANUSCRIPT_SCRIPT_SQL}, {CHARACTERS_SQL}, {VOICES_SQL},
        cast_score as (select m.book_id, m.item_no, m.speaker, case when lower(m.speaker) = 'narrator'
          then 0 else coalesce(c.gender_score, 5) end as score from script m left join characters c
          on c.book_id = m.book_id and c.name = lower(m.speaker))
        select book_id, item_no, speaker, voice from cast_score x join voices v
        on v.engine = 'kokoro' and v.narrator_gender = 'female' and v.score = cast(x.score as varchar)"""),
    "assign_voice_own_map": ms(f"""{MANUSCRIPT_SCRIPT_SQL}, {CHARACTERS_SQL}, {VOICES_SQL},
        cast_score as (select m.book_id, m.item_no, m.speaker, case when lower(m.speaker) = 'narrator'
          then 0 else coalesce(c.gender_score, 5) end as score from script m left join characters c
          on c.book_id = m.book_id and c.name = lower(m.speaker))
        select book_id, item_no, speaker, regexp_replace(voice, '^(af|am)_', 'own_\\1_') as voice from cast_score x join voices v
        on v.engine = 'kokoro' and v.narrator_gender = 'female' and v.score = cast(x.score as varchar)"""),
    "assign_voice_single": ms(s.PARTS.format(lines="manuscript") + """
        select book_id, line_no, row_number() over (partition by book_id, line_no order by spot) - 1
          as part_no, case when starts_with(piece, '"') and ends_with(piece, '"') then 'dialogue'
          else 'narration' end as type, case when starts_with(piece, '"') and ends_with(piece, '"')
          then 'dan' else 'zac' end as voice from pieces where piece <> ''"""),
    "require_engine": f"select page_id, {ENGINE} as engine from pages",
    "apply_tagged_lines": f"""with {CONVERSATION_SCRIPT_SQL},
        tagged as ({TAGGED_LINES.format(script="script")}),
        a as (select book_id, count(*) as n from script group by all),
        b as (select book_id, count(*) as m from tagged group by all)
        select book_id, s.item_no, s.speaker, case when n = m then t.line else s.line end as line,
          coalesce(n = m, false) as applied, case when m is null then 'No pre-processed emotion tags found'
          when n = m then 'Successfully applied pre-processed emotion tags' else
          'Line count mismatch: ' || m || ' enhanced lines vs ' || n || ' speaker-attributed lines' end
          as message
        from script s join a using (book_id) left join b using (book_id)
        left join tagged t on t.book_id = s.book_id and t.line_no = s.item_no""",
    "map_back_to_script": ms(f"""{MANUSCRIPT_SCRIPT_SQL},
        tagged as (select book_id, '<gasp> ' || {s.strip("line")} as line,
          row_number() over (partition by book_id order by line_no) as k
          from manuscript where not {s.blank("line")}),
        ranked as (select *, row_number() over (partition by book_id order by item_no) as k
          from script where not {s.blank("line")})
        select x.book_id, x.item_no, x.speaker, coalesce(t.line, x.line) as line
        from script x left join ranked r using (book_id, item_no)
        left join tagged t on t.book_id = r.book_id and t.k = r.k"""),
    "unknown_speakers": ms(f"""{MANUSCRIPT_SCRIPT_SQL}, {CHARACTERS_SQL},
        missing as (select distinct book_id, lower(speaker) as name from script
          except select book_id, name from characters),
        shown as (select *, row_number() over (partition by book_id order by name) as name_no from missing),
        l as (select book_id, lower(speaker) as name, line, row_number() over (
          partition by book_id, lower(speaker) order by item_no) as sample_no from script)
        select book_id, name, name_no, sample_no, case when length(line) > 60
          then substr(line, 1, 60) || '...' else line end as sample
        from shown join l using (book_id, name) where name_no <= 5 and sample_no <= 2"""),
    "found_characters": f"""with {CHARACTERS_SQL} select distinct book_id, name from characters
        where name not in ('narrator', 'unknown')""",
    "match_speakers": ms(MATCH_SQL + " select * from matches"),
    "check_matches": ms(f"""{MANUSCRIPT_SCRIPT_SQL}, {CHARACTERS_SQL}
        select book_id, item_no, coalesce(c.name, 'unknown') as speaker from script m
        left join (select book_id, name from characters) c using (book_id)
        where c.name = lower(m.speaker) union all
        select book_id, item_no, 'unknown' from script m where not exists (select 1 from characters c
          where c.book_id = m.book_id and c.name = lower(m.speaker))"""),
    "attribute_speakers": ms(MATCH_SQL + f""" select i.book_id, i.item_no, i.content as line,
        case when i.type = 'narrator' or {s.blank("i.content")} then 'narrator' else m.speaker end as speaker
        from items i left join matches m using (book_id, item_no)"""),
    "voice_combinations": f"""with {CHARACTERS_SQL}, {VOICES_SQL},
        used as (select distinct voice from characters c join voices v on v.engine = 'kokoro'
          and v.narrator_gender = 'male' and v.score = cast(c.gender_score as varchar))
        select voice from used union all
        select a.voice || '+' || b.voice from used a join used b on a.voice < b.voice""",
    "first_usable_source": f"""with r as ({RESULTS.format(documents="documents")})
        select book_id, coalesce(arg_min(result, (priority, doc_id))
          filter (where result <> 'No search results found for this book.'), 'unknown') as result
        from r group by book_id""",
}
