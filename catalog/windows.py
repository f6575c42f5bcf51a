"""Chapters, keyword windows, contexts and progress."""

from pyspark.sql import functions as F

from catalog import sqltext as s
from catalog.data import manuscript, ms, table
from catalog.segmenting import ITEMS_SQL
from scriptmill.functions.paragraphs import (
    join_paragraphs, paragraph_sizes, split_paragraphs, with_top_snippets)
from scriptmill.functions.tokens import token_count
from scriptmill.operators import chapters, windows


def assigned(spark, sf_dir):
    lines = windows.drop_punctuation_lines(manuscript(spark, sf_dir))
    return chapters.assign_chapters(lines)


def assign_chapters(spark, sf_dir):
    return assigned(spark, sf_dir).select("book_id", "line_no", "chapter")


def chapter_table(spark, sf_dir):
    return chapters.chapter_table(assigned(spark, sf_dir))


def chapter_lines(spark, sf_dir):
    return chapters.chapter_lines(assigned(spark, sf_dir))


def emotion_hits(spark, sf_dir):
    return windows.emotion_hits(manuscript(spark, sf_dir)).select("book_id", "line_no")


def emotion_windows(spark, sf_dir):
    return windows.emotion_windows(manuscript(spark, sf_dir))


def wide_windows(spark, sf_dir):
    return windows.emotion_windows(manuscript(spark, sf_dir), n=12)


def coverage(spark, sf_dir):
    lines = manuscript(spark, sf_dir)
    return windows.window_coverage(lines, windows.emotion_windows(lines))


def speaking_items(spark, sf_dir):
    """Items with a speaker for every dialogue item."""
    name = F.expr("case item_no % 3 when 0 then 'mia' when 1 then 'sam' else 'narrator' end")
    return windows.to_items(manuscript(spark, sf_dir)).withColumn(
        "speaker", F.when(F.col("type") == "dialogue", name).otherwise("narrator"))


def dialogue_context(spark, sf_dir):
    return windows.dialogue_context(speaking_items(spark, sf_dir)).select(
        "book_id", "item_no", "context_before", "context_after")


def current_line_context(spark, sf_dir):
    contexts = windows.dialogue_context(speaking_items(spark, sf_dir))
    return windows.current_line_context(contexts).select("book_id", "item_no", "context_before")


SPACED = "replace(replace(text, '. ', concat('.', chr(10), chr(10), ' ')), ', ', concat(' ,', chr(10)))"


def paragraphs(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("text", F.expr(SPACED))
    return docs.select("doc_id", join_paragraphs("text").alias("joined"),
                       F.array_join(paragraph_sizes("text").cast("array<string>"), ",")
                       .alias("sizes"))


def split_back(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("text", F.expr(SPACED))
    answer = F.expr("case when doc_id % 3 = 0 then replace(joined, 'a ||| ', 'a | ') "
                    "when doc_id % 3 = 1 then concat(joined, chr(10), 'more ||| lines') "
                    "else joined end")
    return docs.select("doc_id", join_paragraphs("text").alias("joined"),
                       paragraph_sizes("text").alias("sizes")).select(
        "doc_id", split_paragraphs(answer, "sizes").alias("text"))


def snippets(spark, sf_dir):
    """Documents of a source as search results about it."""
    return table(spark, sf_dir, "documents").select(
        F.col("source").alias("book_id"), F.col("doc_id").alias("snippet_no"), "text")


def word_budget(spark, sf_dir):
    return windows.word_budget(snippets(spark, sf_dir)).select(
        "book_id", "snippet_no", F.col("n_words").cast("bigint").alias("n_words"), "text")


def snippets_of_page(spark, sf_dir):
    html = F.expr("case when page_id % 5 = 0 then replace(html, '<p>', '<div>') else html end")
    pages = table(spark, sf_dir, "pages").select("page_id", html.alias("html"))
    return with_top_snippets(pages, "html", "texts").select(
        "page_id", F.posexplode(F.slice("texts", 1, 5)).alias("nth", "text")).select(
        "page_id", F.col("nth").cast("bigint").alias("nth"), "text")


def progress(spark, sf_dir):
    return windows.progress_percent(manuscript(spark, sf_dir))


def tokens(spark, sf_dir):
    return manuscript(spark, sf_dir).select("book_id", "line_no",
                                            token_count("line").alias("tokens"))


QUERIES = {
    "assign_chapters": assign_chapters,
    "chapter_table": chapter_table,
    "chapter_lines": chapter_lines,
    "emotion_hits": emotion_hits,
    "emotion_windows": emotion_windows,
    "emotion_windows_wide": wide_windows,
    "window_coverage": coverage,
    "token_count": tokens,
    "dialogue_context": dialogue_context,
    "current_line_context": current_line_context,
    "join_paragraphs": paragraphs,
    "split_paragraphs": split_back,
    "word_budget": word_budget,
    "top_snippets": snippets_of_page,
    "progress_percent": progress,
}

ASSIGNED_SQL = f"""usable as (select * from manuscript where not {s.only_punctuation("line")}),
titled as (select *, case when {s.heading("line")} then {s.sanitize("line")} end as title from usable),
assigned as (select book_id, line_no, line, coalesce(last_value(title ignore nulls) over (
  partition by book_id order by line_no), 'Introduction') as chapter from titled),
firsts as (select book_id, chapter, min(line_no) as first_line, max(line_no) as last_line,
  count(*) as n_lines from assigned group by all),
chapters as (select *, row_number() over (partition by book_id order by first_line) as chapter_no
  from firsts)"""


def windows_sql(n, lines="manuscript"):
    return f"""hits as (select book_id, line_no from {lines} where {s.like("line", s.KEYWORD)}),
lens as (select book_id, max(line_no) + 1 as n_lines from {lines} group by all),
ranges as (select book_id, greatest(line_no - {n}, 0) as lo, least(line_no + {n + 1}, n_lines) as hi
  from hits join lens using (book_id)),
flags as (select *, case when lo >= max(hi) over (partition by book_id order by lo, hi
  rows between unbounded preceding and 1 preceding) then 1 else 0 end as opens from ranges),
islands as (select *, sum(opens) over (partition by book_id order by lo, hi) as window_no from flags),
windows as (select book_id, cast(window_no as bigint) as window_no, min(lo) as start_line,
  max(hi) as end_line, max(hi) - min(lo) as line_count from islands group by 1, 2)"""


def context_sql(limit, budget):
    return f"""{ITEMS_SQL},
spoken as (select *, case when type = 'dialogue' then case item_no % 3 when 0 then 'mia' when 1
  then 'sam' else 'narrator' end else 'narrator' end as speaker from items),
said as (select *, case when type = 'dialogue' and speaker <> 'narrator'
  then '[' || speaker || ']: ' || content else content end as said from spoken),
counted as (select *, {s.tokens("said")} as said_n, {s.tokens("content")} as content_n from said),
back as (select a.book_id, a.item_no, b.item_no as other, b.said as t, sum(b.said_n) over (
  partition by a.book_id, a.item_no order by b.item_no desc) as total
  from said a join counted b on a.book_id = b.book_id
  and b.item_no between a.item_no - {limit} and a.item_no - 1 where a.type = 'dialogue'),
ahead as (select a.book_id, a.item_no, b.item_no as other, b.content as t, sum(b.content_n) over (
  partition by a.book_id, a.item_no order by b.item_no) as total
  from said a join counted b on a.book_id = b.book_id
  and b.item_no between a.item_no + 1 and a.item_no + {limit} where a.type = 'dialogue'),
b as (select book_id, item_no, string_agg(t, chr(10) order by other) as t from back
  where total <= {budget} group by all),
f as (select book_id, item_no, string_agg(t, chr(10) order by other) as t from ahead
  where total <= {budget} group by all),
contexts as (select x.book_id, x.item_no, x.original_line,
  coalesce(b.t, '[No previous context]') as context_before,
  coalesce(f.t, '[No following context]') as context_after
  from items x left join b using (book_id, item_no) left join f using (book_id, item_no)
  where x.type = 'dialogue')"""


# Lines of spaced documents, their paragraphs, and the paragraphs joined.
_PARAGRAPHS = f"""d as (select doc_id, string_split({SPACED}, chr(10)) as lines from documents),
l as (select doc_id, unnest(lines) as line, unnest(range(0, len(lines))) as nth from d),
b as (select *, {s.blank("line")} as blank from l),
g as (select *, sum(case when blank or before then 1 else 0 end) over (partition by doc_id
  order by nth) as para from (select *, coalesce(lag(blank) over (partition by doc_id order by nth),
  true) as before from b)),
p as (select doc_id, para, bool_and(blank) as blank, count(*) as n,
  string_agg(line, ' ||| ' order by nth) as t from g group by all)"""

def _page_sql(x):
    x = s.sub(x, r"(?s)<!--.*?-->", " ")
    x = s.sub(x, r"(?is)<script\b[^>]*>.*?</script>", " ")
    return plain_sql(s.sub(x, r"(?is)<style\b[^>]*>.*?</style>", " "))


def plain_sql(x):
    x = s.sub(x, "<[^>]*>", " ")
    for entity, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'),
                         ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&")):
        x = f"replace({x}, {s.q(entity)}, {s.q(sign)})"
    return s.strip(s.sub(x, rf"[{s.WS}]+", " "))


SQL = {
    "assign_chapters": ms(ASSIGNED_SQL + " select book_id, line_no, chapter from assigned"),
    "chapter_table": ms(ASSIGNED_SQL + " select * from chapters"),
    "chapter_lines": ms(ASSIGNED_SQL + """ select book_id, chapter_no, chapter, line_no,
        row_number() over (partition by book_id, chapter_no order by line_no) as place
        from assigned join chapters using (book_id, chapter)"""),
    "emotion_hits": ms(f"h as (select book_id, line_no from manuscript "
                       f"where {s.like('line', s.KEYWORD)}) select * from h"),
    "emotion_windows": ms(windows_sql(2) + " select * from windows"),
    "emotion_windows_wide": ms(windows_sql(12) + " select * from windows"),
    "window_coverage": ms(windows_sql(2) + """,
        c as (select book_id, count(*) as n, sum(line_count) as covered from windows group by all)
        select book_id, n_lines, coalesce(n, 0) as n_windows,
          cast(coalesce(covered, 0) as bigint) as lines_in_windows,
          round(coalesce(covered, 0) * 100.0 / n_lines, 1) as coverage_percent,
          round(100.0 - coalesce(covered, 0) * 100.0 / n_lines, 1) as reduction_percent
        from lens left join c using (book_id)"""),
    "token_count": ms(f"t as (select book_id, line_no, {s.tokens('line')} as tokens "
                      "from manuscript) select * from t"),
    "dialogue_context": ms(context_sql(30, 1000) + """ select book_id, item_no, context_before,
        context_after from contexts"""),
    "current_line_context": ms(context_sql(30, 1000) + """ select book_id, item_no, context_before
        || chr(10) || chr(10) || '[CURRENT LINE WITH DIALOGUE TAGS]: ' || original_line
        as context_before from contexts"""),
    "join_paragraphs": f"""with {_PARAGRAPHS} select doc_id,
        string_agg(t, chr(10) order by para) as joined,
        string_agg(case when blank then '0' else cast(n as varchar) end, ',' order by para) as sizes
        from p group by doc_id""",
    "split_paragraphs": f"""with {_PARAGRAPHS},
        j as (select doc_id, case doc_id % 3 when 0 then replace(string_agg(t, chr(10) order by para),
            'a ||| ', 'a | ') when 1 then string_agg(t, chr(10) order by para) || chr(10) || 'more ||| lines'
            else string_agg(t, chr(10) order by para) end as answer from p group by doc_id),
        a as (select doc_id, unnest(string_split(answer, chr(10))) as t,
            unnest(range(1, len(string_split(answer, chr(10))) + 1)) as para from j)
        select doc_id, string_agg(case when p.n is null then a.t when p.blank then ''
            when len(string_split(a.t, ' ||| ')) = p.n then replace(a.t, ' ||| ', chr(10)) else a.t end,
            chr(10) order by para) as text
        from a left join p using (doc_id, para) group by doc_id""",
    "word_budget": f"""with w as (select source as book_id, doc_id as snippet_no,
          {s.words("text")}[1:150] as words from documents),
        c as (select *, coalesce(sum(len(words)) over (partition by book_id order by snippet_no
          rows between unbounded preceding and 1 preceding), 0) as before from w),
        r as (select *, cast(greatest(0, least(len(words), 800 - before)) as bigint) as n_words from c)
        select book_id, snippet_no, n_words, array_to_string(words[1:n_words], ' ') as text
        from r where n_words > 0""",
    "top_snippets": f"""with h as (select page_id, case when page_id % 5 = 0
          then replace(html, '<p>', '<div>') else html end as html from pages),
        b as (select page_id, html, list_filter(list_transform(regexp_extract_all(html,
          {s.q(r'(?is)<p(?:\s[^>]*)?>(.*?)</p>')}, 1), lambda x: {plain_sql("x")}),
          lambda x: x <> '') as texts from h),
        w as (select page_id, texts, {_page_sql("html")} as whole from b),
        t as (select page_id, case when len(texts) > 0 then texts[1:5] else list_transform(
          range(0, least(5, cast(ceil(length(whole) / 500) as bigint))),
          lambda i: substr(whole, i * 500 + 1, 500)) end as texts from w)
        select page_id, unnest(range(0, len(texts))) as nth, unnest(texts) as text from t""",
    "progress_percent": ms("""p as (select book_id, line_no,
          row_number() over (partition by book_id order by line_no) as completed,
          count(*) over (partition by book_id) as total from manuscript)
        select *, round(completed * 100.0 / total, 1) as percent from p"""),
}
