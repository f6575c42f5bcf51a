"""Validation and repair of tagged text."""

from pyspark.sql import functions as F

from catalog import sqltext as s
from catalog.data import BLOCKS_SQL, blocks_of, manuscript, ms, tagged_blocks
from scriptmill import fixed
from scriptmill.functions import tagging
from catalog.sqltext import WORD, WS
from scriptmill.functions.clean import TAG
from scriptmill.operators import tags
from scriptmill.session import stage


def validate(spark, sf_dir):
    return tags.validate_chunks(tagged_blocks(spark, sf_dir)).select(
        "book_id", "block_no", "text", "success", "reverted", "reason")


def repair(spark, sf_dir):
    return tagged_blocks(spark, sf_dir).select(
        "book_id", "block_no", tagging.repair_orphans("enhanced", "original").alias("text"))


TAG_OF = "case line_no % 3 when 0 then '<laugh>' when 1 then '<sigh>' else '<gasp>' end"


def move_tag(spark, sf_dir):
    return manuscript(spark, sf_dir).select(
        "book_id", "line_no",
        tagging.move_tag_to_dialogue("line", F.expr(TAG_OF)).alias("line"))


# Lines with tags before quotes, some of them stopped.
UNSTOPPED = """case line_no % 4 when 0 then replace(line, '" ', ' <sigh>" ')
  when 1 then replace(line, '"', ' <laugh> "') when 2 then concat('"a <gasp>." b <sigh>"', line)
  else concat(line, '"so <yawn>!"') end"""


def fix_punctuation(spark, sf_dir):
    return manuscript(spark, sf_dir).select(
        "book_id", "line_no", tagging.fix_tag_punctuation(F.expr(UNSTOPPED)).alias("line"))


ORPHANED = "case when line_no % 4 = 2 then case when length(line) < 12 then concat(line, ' <cough>  ') else concat(line, ' <cough> ', line) end else concat(line, ' <sigh>') end"


def flag_orphans(spark, sf_dir):
    lines = manuscript(spark, sf_dir).withColumn("line", F.expr(ORPHANED))
    return tags.flag_orphans(lines)


def fallback(spark, sf_dir):
    checked = tags.fallback_by_line(tags.validate_chunks(tagged_blocks(spark, sf_dir)))
    return checked.select("book_id", "block_no", "text")


def reassemble(spark, sf_dir):
    lines = stage(manuscript(spark, sf_dir), "manuscript")
    checked = tags.fallback_by_line(tags.validate_chunks(blocks_of(lines)))
    return tags.reassemble(lines, checked)


QUERIES = {
    "validate_tagged": validate,
    "repair_orphans": repair,
    "move_tag_to_dialogue": move_tag,
    "fix_tag_punctuation": fix_punctuation,
    "flag_orphans": flag_orphans,
    "fallback_by_line": fallback,
    "reassemble": reassemble,
}


def has_tag(x):
    return s.like(x, TAG)


def orphan(x):
    return f"({has_tag(x)} and length({s.strip(s.without_tags(x))}) < 10)"


def move_sql(x, tag):
    span = f"regexp_extract({x}, '\"([^\"]*)\"', 1)"
    stopped = s.like(span, "[.!?,:;]$")
    return (f"case when not {s.like(x, chr(34) + '[^' + chr(34) + ']*' + chr(34))} then {x} else "
            f"replace({x}, '\"' || {span} || '\"', '\"' || case when {stopped} "
            f"then {span}[1:-2] || ' ' || {tag} || {span}[-1] "
            f"else {span} || ' ' || {tag} || '.' end || '\"') end")


QUOTE = tagging.TAGGED_QUOTE


def stop_sql(x):
    bare = f"not {s.like('h', TAG + rf'[{WS}]*[.!?]')} and ends_with(h, '>\"')"
    hits = (f"list_transform(regexp_extract_all({x}, {s.q(QUOTE)}), "
            f"lambda h: case when {bare} then h[1:-2] || '.\"' else h end)")
    gaps = f"string_split_regex({x}, {s.q(QUOTE)})"
    return (f"array_to_string(list_transform(list_zip({gaps}, {hits}), "
            f"lambda p: p[1] || coalesce(p[2], '')), '')")


def own_sql(x, original):
    bare = s.strip(s.without_tags(x))
    return (f"case when {orphan(x)} then case when {bare} <> '' then {bare} "
            f"else coalesce({original}, '') end else {x} end")


def repair_sql(source, keys):
    """repaired: `source` (keys, enhanced, original) after the repair of its lines."""
    return f"""rl as (select {keys}, unnest(string_split(enhanced, chr(10))) as line,
  unnest(range(1, len(string_split(enhanced, chr(10))) + 1)) as nth,
  string_split(original, chr(10)) as originals from {source}),
ro as (select *, {own_sql("line", "originals[nth]")} as kept from rl),
rs as (select *, case when contains(kept, '"') and {has_tag("kept")} then {stop_sql("kept")}
  else kept end as own, lead(line) over (partition by {keys} order by nth) as following from ro),
rm as (select {keys}, nth, case when following is not null and {orphan("following")}
  and contains(own, '"') then {move_sql("own", f"regexp_extract(following, {s.q(TAG)})")} else own end
  as line from rs),
repaired as (select {keys}, string_agg(line, chr(10) order by nth) as text from rm group by all)"""


_ALLOWED = "[" + ", ".join(s.q(t) for t in fixed.EMOTION_TAGS) + "]"
_STRUCTURAL = "[" + ", ".join(s.q(t) for t in fixed.STRUCTURAL_TAGS) + "]"


def _listed(tags_sql):
    return f"array_to_string(list_sort({tags_sql}), ', ')"


def reason_sql(source, keys):
    """reasons: `source` with the cleaned text and the first broken rule."""
    found = "list_distinct(regexp_extract_all(clean, '<[^>]+>'))"
    bad = f"list_filter({found}, lambda t: not list_contains({_ALLOWED}, t))"
    leaked = f"list_filter({found}, lambda t: list_contains({_STRUCTURAL}, t))"
    n_words = f"len({s.words('original')})"
    before = "len(string_split(original, chr(10)))"
    after = f"len(string_split({s.without_tags('clean')}, chr(10)))"
    squeezed = s.sub(s.sub("clean", TAG, ""), f"[{WS}]+", "")
    return f"""reasons as (select {keys}, clean, original, case
  when len({bad}) > 0 and len({leaked}) > 0
    then 'Structural markup leaked from prompt: ' || {_listed(leaked)}
  when len({bad}) > 0 then 'Invalid emotion tags found: ' || {_listed(bad)}
  when {squeezed} <> {s.sub("original", f"[{WS}]+", "")} then 'Text content was modified beyond adding tags.'
  when {before} <> {after} then 'Line structure changed (' || {before} || ' -> ' || {after} || ' lines)'
  when {s.like("clean", "<[^>]*$|^[^<]*>")} then 'Malformed emotion tags found'
  when contains(clean, '&lt;') or contains(clean, '&gt;') then 'HTML entities found in emotion tags'
  when {s.like("clean", f"[{WORD}]{TAG}[{WORD}]")} then 'Emotion tags breaking words detected'
  when {n_words} > 0 and len({found}) > greatest(1, {n_words} // 10)
    then 'Excessive emotion tags detected (' || len({found}) || ' tags for ' || {n_words} || ' words)'
  when {s.like("clean", rf"{TAG}[{WS}]*{TAG}")} then 'Consecutive emotion tags detected' end as reason
  from (select *, replace(enhanced, '`', '') as clean from {source}))"""


VALID_SQL = f"""{BLOCKS_SQL},
{reason_sql("tagged", "book_id, block_no")},
fixable as (select book_id, block_no, clean as enhanced, original from reasons where reason is null),
{repair_sql("fixable", "book_id, block_no")},
valid as (select r.book_id, r.block_no, case when reason is null then p.text else original end as text,
  reason is null as success, reason is not null as reverted, reason
  from reasons r left join repaired p using (book_id, block_no))"""

# Lines of the reverted blocks, each checked alone.
_line_reasons = reason_sql("answers", "book_id, block_no, nth").replace("reasons as", "line_reasons as", 1)
FALLBACK_SQL = f"""{VALID_SQL},
answers as (select book_id, block_no, unnest(string_split(original, chr(10))) as original,
  unnest(range(1, len(string_split(original, chr(10))) + 1)) as nth, enhanced as whole
  from tagged join valid using (book_id, block_no) where reverted),
answered as (select book_id, block_no, nth, original, string_split(whole, chr(10))[nth] as enhanced
  from answers),
{_line_reasons.replace("from answers)", "from answered)")},
line_kept as (select *, {own_sql("clean", "original")} as kept from line_reasons),
lines_back as (select book_id, block_no, string_agg(case when {s.blank("original")} or clean is null
  or reason is not null then original when contains(kept, '"') and {has_tag("kept")}
  then {stop_sql("kept")} else kept end, chr(10) order by nth) as text from line_kept group by all),
settled as (select v.book_id, v.block_no, coalesce(b.text, v.text) as text
  from valid v left join lines_back b using (book_id, block_no))"""

SQL = {
    "validate_tagged": ms(VALID_SQL + " select * from valid"),
    "repair_orphans": ms(f"""{BLOCKS_SQL}, {repair_sql("tagged", "book_id, block_no")}
        select * from repaired"""),
    "move_tag_to_dialogue": ms(f"""t as (select *, {TAG_OF} as tag from manuscript)
        select book_id, line_no, {move_sql("line", "tag")} as line from t"""),
    "fix_tag_punctuation": ms(f"""u as (select book_id, line_no, {UNSTOPPED} as line from manuscript)
        select book_id, line_no, {stop_sql("line")} as line from u"""),
    "flag_orphans": ms(f"""o as (select book_id, line_no, {ORPHANED} as line from manuscript)
        select * from o where {orphan("line")}"""),
    "fallback_by_line": ms(FALLBACK_SQL + " select * from settled"),
    "reassemble": ms(FALLBACK_SQL + """,
        back as (select s.book_id, unnest(string_split(s.text, chr(10))) as tagged,
          unnest(range(0, len(string_split(s.text, chr(10))))) + t.start_line as line_no
          from settled s join tagged t using (book_id, block_no)
          where len(string_split(s.text, chr(10))) = t.end_line - t.start_line)
        select m.book_id, m.line_no, coalesce(b.tagged, m.line) as line, b.tagged is not null as replaced,
          null::varchar as message
        from manuscript m left join back b using (book_id, line_no)"""),
}
