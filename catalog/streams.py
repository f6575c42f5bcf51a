"""Streams over what the given tables hold now."""

from pyspark.sql import functions as F

from catalog import sqltext as s
from catalog.data import CHAR_OPS
from catalog.registry import FOLD_SQL
from catalog.segmenting import ready_sql
from scriptmill.functions.chars import lines_of
from scriptmill.operators.registry import with_scores
from scriptmill.streaming import streams


def document_stream(spark, sf_dir):
    """Lines of documents as they arrive."""
    docs = streams.table_stream(spark, f"{sf_dir}/documents.parquet")
    return docs.select(F.col("source").alias("book_id"), "doc_id",
                       F.posexplode(lines_of("text")).alias("line_no", "line"))


def clean_lines(spark, sf_dir):
    noted = document_stream(spark, sf_dir).withColumn(
        "line", F.expr("concat('“', line, '” — she said at 3:30')"))
    return streams.run_available(streams.clean_line_stream(noted), "clean").select(
        "book_id", "doc_id", F.col("line_no").cast("bigint").alias("line_no"),
        F.col("part_no").cast("bigint").alias("part_no"), "type", "text")


def char_ops(spark, sf_dir):
    events = streams.table_stream(spark, f"{sf_dir}/events.parquet")
    ops = spark.sql(CHAR_OPS, events=events)
    changes = streams.run_available(streams.char_ops_stream(ops), "registry")
    return with_scores(streams.latest_registry(changes), "min")


def progress(spark, sf_dir):
    done = streams.progress_log(document_stream(spark, sf_dir))
    return done.groupBy("book_id").agg(F.max("completed").alias("completed"))


QUERIES = {
    "stream_clean_lines": clean_lines,
    "stream_char_ops": char_ops,
    "stream_progress": progress,
}

_NOTED = f"""noted as (select source as book_id, doc_id, {s.ascii_punct("line")} as line, line_no from (
  select source, doc_id, '“' || unnest(string_split(text, chr(10))) || '” — she said at 3:30' as line,
    unnest(range(0, len(string_split(text, chr(10))))) as line_no from documents)),
closed as (select * exclude (line), {s.close_quotes("line")} as line from noted
  where not {s.only_punctuation("line")}),
varied as (select book_id, doc_id || ':' || line_no as line_no, line from closed),
ready as ({ready_sql("0")}),
lines as (select book_id, line_no as key, ready as line from ready)"""

SQL = {
    "stream_char_ops": "with recursive " + FOLD_SQL,
    "stream_clean_lines": f"""with {_NOTED},
        {s.PARTS.format(lines="lines")},
        typed as (select *, row_number() over (partition by book_id, key order by spot) - 1 as part_no,
          case when starts_with(piece, '"') and ends_with(piece, '"') then 'dialogue' else 'narration' end
          as type from pieces where piece <> '')
        select book_id, cast(split_part(key, ':', 1) as bigint) as doc_id,
          cast(split_part(key, ':', 2) as bigint) as line_no, part_no, type,
          replace(replace({s.strip("piece")}, '"', ''), '\\', '') as text
        from typed where not {s.only_punctuation("piece")}""",
    "stream_progress": """select source as book_id,
        cast(sum(len(string_split(text, chr(10)))) as bigint) as completed from documents group by all""",
}
