"""The character registry and request tables."""

from pyspark.sql import functions as F

from catalog import sqltext as s
from catalog.budgets import NARRATIVE_SQL, chunks_sql, narrative
from catalog.casting import MANUSCRIPT_SCRIPT_SQL, lower_script
from catalog.data import (
    CHAR_OPS_SQL, CHARACTERS_SQL, char_ops, characters, manuscript, ms, table)
from catalog.segmenting import ITEMS_SQL
from catalog.windows import context_sql, speaking_items, windows_sql
from scriptmill.functions.paragraphs import join_paragraphs
from scriptmill.operators import budgets, registry, windows
from scriptmill.session import stage

KEYS = ["book_id"]


def gender_score(spark, sf_dir):
    return char_ops(spark, sf_dir).select(
        "book_id", "batch_no", "op_no",
        registry.gender_score("age", "gender", "min").cast("bigint").alias("score"))


def apply_char_ops(spark, sf_dir):
    return registry.apply_char_ops(char_ops(spark, sf_dir), "min")


def upsert_latest(spark, sf_dir):
    return registry.upsert_latest(
        char_ops(spark, sf_dir).where(F.col("operation") != "merge")).drop("last_batch")


LOOSE = """select book_id, batch_no, op_no, case when op_no = 7 then 'replace' else operation end as operation,
  name, existing_name, case when op_no = 9 then 'old' when op_no = 7 then null else age end as age, gender,
  description from {ops}"""


def check_enums(spark, sf_dir):
    ops = spark.sql(LOOSE, ops=char_ops(spark, sf_dir))
    good, bad = registry.check_enums(ops)
    return good.withColumn("invalid", F.lit("")).unionByName(bad).select(
        "book_id", "batch_no", "op_no", "invalid")


def roster_text(spark, sf_dir):
    return registry.roster_text(characters(spark, sf_dir), 10_000)


def valid_names(spark, sf_dir):
    return registry.valid_names_text(characters(spark, sf_dir), 10_000)


def extraction_requests(spark, sf_dir):
    # Staged, as items are counted and then gathered.
    items = stage(windows.to_items(manuscript(spark, sf_dir)).select("book_id", "item_no", "content"), "items")
    made = budgets.batch_by_tokens(items, KEYS, "item_no", "content", 2000)
    text = budgets.group_text(items.where(~windows.is_blank("content")), made, KEYS, "item_no",
                              "content", "batch_no")
    return registry.prompt_table(text, "extract", F.col("batch_no"),
                                 registry.extraction_text("text"))


def matching_requests(spark, sf_dir):
    contexts = windows.current_line_context(
        windows.dialogue_context(speaking_items(spark, sf_dir), counts=True))
    return registry.prompt_table(
        contexts, "match", F.col("item_no"),
        registry.matching_text("context_before", "content", "context_after"),
        counted=registry.filled_tokens(
            registry.MATCH, before="tokens_before", line="tokens_content", after="tokens_after"))


def tagging_requests(spark, sf_dir):
    lines = narrative(spark, sf_dir)
    made = windows.window_chunks(lines, windows.emotion_windows(lines), max_tokens=500)
    text = budgets.group_text(lines, made, KEYS, "line_no", "line", "chunk_no", ["window_no"])
    return registry.prompt_table(text, "tag", F.col("chunk_no"),
                                 registry.tagging_text(join_paragraphs("text")))


def underline(texts):
    """Stands for a model; fails on the texts that hold a bar."""
    if any("|" in t for t in texts):
        raise ValueError("no bars, please")
    return [t.replace(" ", "_") for t in texts]


def run_rowwise(spark, sf_dir):
    """A caller's function over requests made of documents; some of its calls fail."""
    requests = table(spark, sf_dir, "documents").select(
        F.col("source").alias("book_id"), F.col("doc_id").alias("key"),
        F.col("text").alias("user_text"))
    return registry.run_rowwise(requests, underline)


def attribution_stats(spark, sf_dir):
    return registry.attribution_stats(lower_script(spark, sf_dir), characters(spark, sf_dir))


QUERIES = {
    "gender_score": gender_score,
    "apply_char_ops": apply_char_ops,
    "upsert_latest": upsert_latest,
    "check_enums": check_enums,
    "roster_text": roster_text,
    "valid_names_text": valid_names,
    "extraction_requests": extraction_requests,
    "matching_requests": matching_requests,
    "tagging_requests": tagging_requests,
    "run_rowwise": run_rowwise,
    "attribution_stats": attribution_stats,
}

# The fold over batches as a recursion whose state is a book's list of characters.
FOLD_SQL = f"""{CHAR_OPS_SQL},
tidy as (select * exclude (name), {s.strip("lower(name)")} as name from ops),
batches as (select book_id, batch_no, list({{'op_no': op_no, 'kind': operation, 'name': name,
  'old': existing_name, 'age': age, 'gender': gender, 'd': description}} order by op_no) as ops,
  row_number() over (partition by book_id order by batch_no) as k from tidy group by book_id, batch_no),
fold as (
  select distinct book_id, cast(0 as bigint) as k, [
    {{'name': 'narrator', 'age': 'adult', 'gender': 'female', 'd': 'The narrator of the story',
      'sb': cast(-1 as bigint), 'so': cast(0 as bigint), 'lb': cast(-1 as bigint)}},
    {{'name': 'unknown', 'age': 'adult', 'gender': 'unknown', 'd': 'Unknown or ambiguous speaker',
      'sb': cast(-1 as bigint), 'so': cast(1 as bigint), 'lb': cast(-1 as bigint)}}] as chars from batches
  union all
  select book_id, k, list_concat(
    list_filter(chars, lambda c: not list_contains(gone, c.name) and not list_contains(named, c.name)),
    list_transform(kept, lambda u: {{'name': u.name, 'age': u.age, 'gender': u.gender, 'd': u.d,
      'sb': coalesce(list_filter(chars, lambda c: c.name = u.name)[1].sb, batch_no),
      'so': coalesce(list_filter(chars, lambda c: c.name = u.name)[1].so,
        list_min(list_transform(list_filter(made, lambda m: m.name = u.name), lambda m: m.op_no))),
      'lb': batch_no}})) as chars
  from (select *, list_transform(kept, lambda u: u.name) as named from (
    select *, list_filter(made, lambda u: not list_contains(gone, u.name) and len(list_filter(made,
      lambda m: m.name = u.name and m.op_no > u.op_no)) = 0) as kept from (
    select *, list_transform(list_filter(made, lambda u: u.kind = 'merge'), lambda u: u.old) as gone from (
    select *, list_transform(paired, lambda p: {{'op_no': p.o.op_no, 'name': p.o.name, 'kind': p.o.kind,
      'old': p.o.old,
      'age': case when p.o.kind = 'update' then coalesce(p.c.age, p.o.age) else p.o.age end,
      'gender': case when p.o.kind = 'insert' or p.c is null then p.o.gender
        when p.o.kind = 'update' then case when p.c.gender = 'unknown' then p.o.gender else p.c.gender end
        when p.o.gender = 'unknown' then p.c.gender else p.o.gender end,
      'd': case when p.o.kind = 'insert' or p.c is null or length(p.o.d) > length(p.c.d) then p.o.d
        when p.o.kind = 'update' then p.c.d else {s.strip("p.c.d || ' ' || p.o.d")} end}}) as made from (
    select f.book_id, b.k, b.batch_no, f.chars, list_filter(list_transform(b.ops, lambda o: {{'o': o,
      'c': list_filter(f.chars, lambda c: c.name = case when o.kind = 'merge' then o.old else o.name end)[1]}}),
      lambda p: p.o.kind <> 'merge' or p.c is not null) as paired
    from fold f join batches b on b.book_id = f.book_id and b.k = f.k + 1)))))),
folded as (select book_id, unnest(chars) as c from fold
  qualify k = max(k) over (partition by book_id))
select book_id, c.name as name, c.age as age, c.gender as gender, c.d as description,
  c.sb as seen_batch, c.so as seen_op, c.lb as last_batch,
  case when c.name = 'narrator' and c.lb = -1 then 0 else case c.gender
    when 'male' then case c.age when 'child' then 4 else 1 end
    when 'female' then case c.age when 'child' then 10 when 'adult' then 7 else 6 end
    else 5 end end as gender_score from folded"""

SQL = {
    "apply_char_ops": "with recursive " + FOLD_SQL,
    "gender_score": f"""with {CHAR_OPS_SQL} select book_id, batch_no, op_no, case gender
        when 'male' then case age when 'child' then 4 else 1 end
        when 'female' then case age when 'child' then 10 when 'adult' then 7 else 6 end
        else 5 end as score from ops""",
    "upsert_latest": f"""with {CHAR_OPS_SQL},
        o as (select book_id, {s.strip("lower(name)")} as name, * exclude (book_id, name) from ops
          where operation <> 'merge'),
        l as (select *, row_number() over (partition by book_id, name, batch_no order by op_no desc) as rn,
          min(op_no) over (partition by book_id, name, batch_no) as first_op from o),
        b as (select *, max(case when operation = 'insert' then batch_no end) over (
          partition by book_id, name) as base from l where rn = 1),
        k as (select *, row_number() over (partition by book_id, name order by batch_no) as k,
          row_number() over (partition by book_id, name order by case when gender = 'unknown' then 1
            else 0 end, batch_no) as g,
          row_number() over (partition by book_id, name order by length(description) desc, batch_no) as d
          from b where base is null or batch_no >= base),
        f as (select book_id, name, min(batch_no) as seen_batch, arg_min(first_op, batch_no) as seen_op
          from b group by all)
        select book_id, name, max(case when k = 1 then age end) as age,
          max(case when g = 1 then gender end) as gender,
          max(case when d = 1 then description end) as description,
          any_value(seen_batch) as seen_batch, any_value(seen_op) as seen_op
        from k join f using (book_id, name) group by book_id, name""",
    "check_enums": f"""with {CHAR_OPS_SQL}, l as ({LOOSE.format(ops="ops")})
        select book_id, batch_no, op_no, array_to_string(list_filter([
          case when operation not in ('insert', 'update', 'merge') then 'operation' end,
          case when age is null or age not in ('child', 'adult', 'elderly') then 'age' end,
          case when gender not in ('male', 'female', 'unknown') then 'gender' end],
          lambda x: x is not null), ', ') as invalid from l""",
    "roster_text": f"""with {CHARACTERS_SQL} select book_id, 0 as part_no, string_agg('- ' || name || ': '
        || description || ' (Age: ' || age || ', Gender: ' || gender || ')', chr(10)
        order by seen_batch, seen_op) as roster from characters where name <> 'narrator' group by book_id""",
    "valid_names_text": f"""with {CHARACTERS_SQL},
        n as (select book_id, name, seen_batch, seen_op from characters where name <> 'narrator'
          union all select distinct book_id, 'narrator', -3, 0 from characters
          union all select distinct book_id, 'unknown', -2, 0 from characters),
        r as (select book_id, name, row_number() over (partition by book_id order by seen_batch, seen_op)
          as k from n)
        select book_id, 0 as part_no, string_agg(k || '. ' || name, chr(10) order by k) as names
        from r group by book_id""",
    "extraction_requests": ms(f"""{ITEMS_SQL},
        t as (select book_id, item_no, content, {s.tokens("content")} as n,
          row_number() over (partition by book_id order by item_no) as rn
          from items where not {s.blank("content")}),
        f as (select book_id, rn, content, n as total, cast(0 as bigint) as key from t where rn = 1
          union all select t.book_id, t.rn, t.content,
            case when f.total >= 2000 then t.n else f.total + t.n end,
            f.key + case when f.total >= 2000 then 1 else 0 end
          from f join t on t.book_id = f.book_id and t.rn = f.rn + 1),
        g as (select book_id, key, string_agg(content, chr(10) order by rn) as body from f group by book_id, key),
        h as (select book_id, key, {s.fill(registry.EXTRACT, text="body")} as user_text from g)
        select *, 'extract' as kind, {s.tokens("user_text")} as tokens from h""", True),
    "matching_requests": ms(context_sql(30, 1000) + f""",
        around as (select book_id, item_no as key, content, context_after, context_before || chr(10) || chr(10)
          || '[CURRENT LINE WITH DIALOGUE TAGS]: ' || contexts.original_line as before
          from contexts join items using (book_id, item_no)),
        g as (select book_id, key, {s.fill(registry.MATCH, before="before", line="content", after="context_after")}
          as user_text from around)
        select *, 'match' as kind, {s.tokens("user_text")} as tokens from g"""),
    "run_rowwise": """select source as book_id, doc_id as key,
        case when not contains(text, '|') then replace(text, ' ', '_') end
          as response,
        case when contains(text, '|') then 'ValueError: no bars, please' end as error
        from documents""",
    "tagging_requests": ms(f"""{NARRATIVE_SQL},
        {windows_sql(2, "narrative")},
        inside as (select n.book_id, n.line_no, n.line, n.line_no = w.start_line as first
          from narrative n join windows w on n.book_id = w.book_id and n.line_no >= w.start_line
          and n.line_no < w.end_line),
        {chunks_sql("inside", 500, "first")},
        g as (select c.book_id, c.chunk_no as key, string_agg(n.line, ' ||| ' order by n.line_no) as body
          from chunks c join narrative n on n.book_id = c.book_id
          and n.line_no >= c.start_line and n.line_no < c.end_line group by 1, 2),
        h as (select book_id, key, {s.fill(registry.TAG, lines="body")} as user_text from g)
        select *, 'tag' as kind, {s.tokens("user_text")} as tokens from h""", True),
    "attribution_stats": ms(f"""{MANUSCRIPT_SCRIPT_SQL}, {CHARACTERS_SQL},
        a as (select book_id, count(*) as items, count(distinct lower(speaker)) as speakers,
          count(*) filter (where speaker <> 'narrator') as attributed_lines from script group by all),
        b as (select book_id, count(*) as in_registry,
          count(*) filter (where name not in ('narrator', 'unknown')) as characters
          from characters group by all),
        x as (select m.book_id, count(distinct lower(speaker)) as invalid_speakers from script m
          where not exists (select 1 from characters c where c.book_id = m.book_id
          and c.name = lower(m.speaker)) group by all)
        select book_id, in_registry, characters, speakers, coalesce(invalid_speakers, 0) as invalid_speakers,
          attributed_lines, items from a join b using (book_id) left join x using (book_id)"""),
}
