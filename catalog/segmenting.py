"""Segmentation and narration-text rules."""

from pyspark.sql import functions as F

from catalog import sqltext as s
from catalog.data import manuscript, ms
from scriptmill import fixed
from scriptmill.functions import segment, speech
from catalog.sqltext import WORD, WS
from scriptmill.operators.windows import to_items


def split_dialogue(spark, sf_dir):
    return manuscript(spark, sf_dir).select(
        "book_id", "line_no", F.posexplode(segment.split_dialogue("line")).alias("at", "p")
    ).select("book_id", "line_no", F.col("at").cast("bigint").alias("part_no"), "p.text", "p.type")


def items(spark, sf_dir):
    return to_items(manuscript(spark, sf_dir))


def extract_dialogues(spark, sf_dir):
    return manuscript(spark, sf_dir).select(
        "book_id", "line_no", F.posexplode(segment.extract_dialogues("line")).alias("nth", "dialogue")
    ).select("book_id", "line_no", F.col("nth").cast("bigint").alias("nth"), "dialogue")


def _flag(op, text="line"):
    def run(spark, sf_dir):
        return manuscript(spark, sf_dir).select("book_id", "line_no",
                                                op(F.expr(text)).alias("hit"))
    return run


def _rewrite(op, text="line"):
    def run(spark, sf_dir):
        return manuscript(spark, sf_dir).select("book_id", "line_no",
                                                op(F.expr(text)).alias("line"))
    return run


# Lines with more colons, abbreviations, short texts and punctuation after quotes.
VARIED = """case line_no % 11 when 0 then concat('score 15:3 ', line, ' at 12:45pm, see: ')
  when 1 then concat(line, ' Mr.') when 2 then concat('a ', line)
  when 3 then concat(line, '."') when 4 then concat('"', line, '".') when 5 then concat(line, ',')
  when 6 then concat('"Yes," Sam replied', line, '!')
  when 7 then concat(line, '''') else line end"""


def varied(spark, sf_dir):
    return manuscript(spark, sf_dir).withColumn("line", F.expr(VARIED))


def prepare_item(spark, sf_dir):
    return speech.prepare_for_tts(varied(spark, sf_dir), "line", "ready").select(
        "book_id", "line_no", "ready")


def prepare_book(spark, sf_dir):
    return speech.prepare_for_tts(varied(spark, sf_dir), "line", "ready", "line_no").select(
        "book_id", "line_no", "ready")


def title_or_heading(spark, sf_dir):
    return manuscript(spark, sf_dir).select(
        "book_id", "line_no", speech.is_title_or_heading("line", "line_no").alias("hit"))


QUERIES = {
    "split_dialogue": split_dialogue,
    "to_items": items,
    "extract_dialogues": extract_dialogues,
    "has_dialogue": _flag(segment.has_dialogue),
    "is_chapter_heading": _flag(segment.is_chapter_heading),
    "needs_no_stop": _flag(speech.needs_no_stop, VARIED),
    "resolve_colons": _rewrite(speech.resolve_colons, VARIED),
    "move_punctuation_inside": _rewrite(speech.move_punctuation_inside, VARIED),
    "ends_with_punctuated_dialogue": _flag(speech.ends_with_punctuated_dialogue, VARIED),
    "punctuate_dialogue": _rewrite(speech.punctuate_dialogue, VARIED),
    "is_title_or_heading": title_or_heading,
    "prepare_for_tts_item": prepare_item,
    "prepare_for_tts_book": prepare_book,
}

ITEMS_SQL = s.PARTS.format(lines="manuscript") + f""",
raw_items as (
  select book_id, line_no, line, spot, case when hit then 'dialogue' else 'narrator' end as type,
    case when hit then piece else {s.strip("piece")} end as content
  from pieces where {s.like("line", '"[^"]+"')}
  union all select book_id, line_no, line, 0, 'narrator', line from manuscript
  where not {s.like("line", '"[^"]+"')}),
items as (
  select book_id, row_number() over (partition by book_id order by line_no, spot) - 1 as item_no,
    type, content, line_no, line as original_line
  from raw_items where content <> '' or not {s.like("line", '"[^"]+"')})"""

_ABBREVIATION = rf"(?i)(^|[^{WORD}])(" + "|".join(fixed.ABBREVIATIONS) + r")\.$"
_VERBS = "|".join(fixed.ATTRIBUTION_VERBS)


def no_stop_sql(x):
    return f"(length({s.strip(x)}) <= 2 or {s.like(x, _ABBREVIATION)})"


def colons_sql(x):
    x = s.strip(s.sub(x, rf"\b([0-9]{{1,2}}):([0-9]{{2}})[{WS}]*(AM|PM|am|pm)?\b", r"\1.\2 \3"))
    x = f"replace({s.sub(x, r'\b([0-9]+):([0-9]+)\b', r'\1 to \2')}, ':', ' -')"
    return s.strip(s.sub(x, rf"[{WS}]+", " "))


def moved_sql(x):
    return s.sub(x, r"""(["'])([.!?…])""", r"\2\1")


def punctuated_sql(x):
    return (f"({s.like(x, rf'''[.!?…][{WS}]*['\"]?\"$''')} or {s.like(x, '''['\"][.!?…]$''')} or "
            + s.like(x, rf'''(?i)",?[{WS}]+[{WORD}]+[{WS}]+({_VERBS}).*[.!?]$''') + ")")


def stop_sql(x):
    return s.sub(x, r"""([^.!?…])(["'])$""", r"\1.\2")


def title_sql(x, index):
    plain = " and ".join(f"not contains(lower({x}), {s.q(w)})" for w in fixed.FUNCTION_WORDS)
    return (f"({index} = 0 or {s.like(x, rf'(?i)^Chapter[{WS}]+[0-9]')} or "
            f"(len({s.words(x)}) <= 6 and {plain}))")


def ready_sql(index):
    unpunctuated = s.like("m", """[^.!?…]["']$""")
    closed = s.like("m", "[.!?:;…]$")
    return f"""select book_id, line_no, case when {no_stop_sql("p")} then p
        when {punctuated_sql("m")} then m when {unpunctuated} then {stop_sql("m")}
        when {closed} then m when {title_sql("m", index)} then m || '.'
        when ends_with(m, ',') then m else m || '.' end as ready
        from (select *, {moved_sql("c")} as m from (select *, {colons_sql("p")} as c
        from (select *, {s.strip("line")} as p from varied)))"""


_VARIED = f"varied as (select book_id, line_no, {VARIED} as line from manuscript)\n"
_FLAG = "select book_id, line_no, {} as hit from "
_REWRITE = "select book_id, line_no, {} as line from "

SQL = {
    "split_dialogue": ms(s.PARTS.format(lines="manuscript") + """
        select book_id, line_no, row_number() over (partition by book_id, line_no order by spot) - 1
          as part_no, piece as text, case when starts_with(piece, '"') and ends_with(piece, '"')
          then 'dialogue' else 'narration' end as type from pieces where piece <> ''"""),
    "to_items": ms(ITEMS_SQL + " select * from items"),
    "extract_dialogues": ms("""d as (select book_id, line_no,
        regexp_extract_all(line, '"[^"]+"') as hits from manuscript)
        select book_id, line_no, unnest(range(0, len(hits))) as nth, unnest(hits) as dialogue from d"""),
    "has_dialogue": ms(_FLAG.format(s.like("line", '"[^"]+"')) + "manuscript"),
    "is_chapter_heading": ms(_FLAG.format(s.heading("line")) + "manuscript"),
    "needs_no_stop": ms(_VARIED + _FLAG.format(no_stop_sql("line")) + "varied"),
    "resolve_colons": ms(_VARIED + _REWRITE.format(colons_sql("line")) + "varied"),
    "move_punctuation_inside": ms(_VARIED + _REWRITE.format(moved_sql("line")) + "varied"),
    "ends_with_punctuated_dialogue": ms(
        _VARIED + _FLAG.format(punctuated_sql("line")) + "varied"),
    "punctuate_dialogue": ms(_VARIED + _REWRITE.format(stop_sql("line")) + "varied"),
    "is_title_or_heading": ms(_FLAG.format(title_sql("line", "line_no")) + "manuscript"),
    "prepare_for_tts_item": ms(_VARIED + "," + "ready as (" + ready_sql("0") + ") select * from ready"),
    "prepare_for_tts_book": ms(_VARIED + "," + "ready as (" + ready_sql("line_no") + ") select * from ready"),
}
