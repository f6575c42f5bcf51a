"""Token chunks and batches."""

from catalog import sqltext as s
from catalog.data import manuscript, ms
from catalog.segmenting import ITEMS_SQL
from catalog.windows import windows_sql
from scriptmill.operators import budgets, windows
from scriptmill.session import passing, stage

KEYS = ["book_id"]


def chunks(spark, sf_dir, max_tokens=500):
    return budgets.chunk_by_tokens(manuscript(spark, sf_dir), KEYS, "line_no", "line", max_tokens)


def small_chunks(spark, sf_dir):
    return chunks(spark, sf_dir, 40)


def batches(spark, sf_dir, min_tokens=2000):
    items = windows.to_items(manuscript(spark, sf_dir))
    return budgets.batch_by_tokens(items, KEYS, "item_no", "content", min_tokens)


def small_batches(spark, sf_dir):
    return batches(spark, sf_dir, 150)


def narrative(spark, sf_dir):
    """The manuscript without blank lines, which is what gets tagged. Staged, as several passes read it."""
    with passing(spark):
        kept = windows.drop_blank_lines(manuscript(spark, sf_dir, staged=True))
        return stage(kept.select("book_id", "line_no", "line"), "narrative", lasting=True)


def window_chunks(spark, sf_dir):
    lines = narrative(spark, sf_dir)
    return windows.window_chunks(lines, windows.emotion_windows(lines, n=8), max_tokens=120)


def chunk_text(spark, sf_dir):
    lines = manuscript(spark, sf_dir)
    made = budgets.chunk_by_tokens(lines, KEYS, "line_no", "line", 100)
    return budgets.group_text(lines, made, KEYS, "line_no", "line", "chunk_no")


def average_tokens(spark, sf_dir):
    return budgets.average_tokens(chunks(spark, sf_dir), KEYS)


QUERIES = {
    "average_tokens": average_tokens,
    "chunk_by_tokens": chunks,
    "chunk_by_tokens_small": small_chunks,
    "batch_by_tokens": batches,
    "batch_by_tokens_small": small_batches,
    "window_chunks": window_chunks,
    "chunk_text": chunk_text,
}


def chunks_sql(lines, limit, opens="false"):
    """Greedy chunks by a recursion over each book's lines."""
    return f"""t as (select book_id, line_no, line, {s.tokens("line")} as n, {s.blank("line")} as blank,
  {opens} as opens, row_number() over (partition by book_id order by line_no) as rn from {lines}),
f as (select book_id, rn, line_no, n as total, cast(0 as bigint) as chunk_no, blank from t where rn = 1
  union all
  select t.book_id, t.rn, t.line_no,
    case when f.blank or t.opens or f.total + t.n > {limit} then t.n else f.total + t.n end,
    f.chunk_no + case when f.blank or t.opens or f.total + t.n > {limit} then 1 else 0 end, t.blank
  from f join t on t.book_id = f.book_id and t.rn = f.rn + 1),
chunks as (select f.book_id, chunk_no, min(f.line_no) as start_line, max(f.line_no) + 1 as end_line,
  count(*) as line_count, cast(sum(t.n) as bigint) as tokens
  from f join t using (book_id, line_no) group by 1, 2)"""


def batches_sql(minimum):
    return f"""{ITEMS_SQL},
t as (select book_id, item_no, {s.tokens("content")} as n,
  row_number() over (partition by book_id order by item_no) as rn
  from items where not {s.blank("content")}),
f as (select book_id, rn, item_no, n, n as total, cast(0 as bigint) as batch_no from t where rn = 1
  union all
  select t.book_id, t.rn, t.item_no, t.n, case when f.total >= {minimum} then t.n else f.total + t.n end,
    f.batch_no + case when f.total >= {minimum} then 1 else 0 end
  from f join t on t.book_id = f.book_id and t.rn = f.rn + 1)
select book_id, batch_no, min(item_no) as start_line, max(item_no) + 1 as end_line,
  count(*) as line_count, cast(sum(n) as bigint) as tokens from f group by 1, 2"""


NARRATIVE_SQL = f"""narrative as (select book_id, {s.strip("line")} as line,
  row_number() over (partition by book_id order by line_no) - 1 as line_no
  from manuscript where not {s.blank("line")})"""
INSIDE_SQL = f"""{NARRATIVE_SQL},
{windows_sql(8, "narrative")},
inside as (select n.book_id, n.line_no, n.line, w.window_no, n.line_no = w.start_line as first
  from narrative n join windows w on n.book_id = w.book_id and n.line_no >= w.start_line
  and n.line_no < w.end_line)"""

SQL = {
    "average_tokens": ms(chunks_sql("manuscript", 500) + """ select book_id, count(*) as n_groups,
        round(avg(tokens), 1) as average_tokens from chunks group by 1""", True),
    "chunk_by_tokens": ms(chunks_sql("manuscript", 500) + " select * from chunks", True),
    "chunk_by_tokens_small": ms(chunks_sql("manuscript", 40) + " select * from chunks", True),
    "batch_by_tokens": ms(batches_sql(2000), True),
    "batch_by_tokens_small": ms(batches_sql(150), True),
    "window_chunks": ms(INSIDE_SQL + "," + chunks_sql("inside", 120, "first") + """
        select c.*, i.window_no from chunks c join inside i
        on i.book_id = c.book_id and i.line_no = c.start_line""", True),
    "chunk_text": ms(chunks_sql("manuscript", 100) + """
        select c.book_id, chunk_no, tokens, start_line, end_line,
          string_agg(m.line, chr(10) order by m.line_no) as text
        from chunks c join manuscript m on m.book_id = c.book_id and m.line_no >= c.start_line
        and m.line_no < c.end_line group by all""", True),
}
