"""Reading and writing."""

from pyspark.sql import functions as F

from catalog import sqltext as s
from catalog.data import (
    CHARACTERS_SQL, CONVERSATION_SCRIPT_SQL, characters, conversation_script, ms, table)
from catalog.planning import TIMELINE_SQL, timeline
from catalog.windows import ASSIGNED_SQL, _page_sql, chapter_lines, chapter_table
from scriptmill import fixed
from scriptmill.functions.clean import normalize_line_breaks
from scriptmill.functions.markup import page_text
from scriptmill.session import new_path
from scriptmill.sources import books, characters as maps, files


def as_files(texts, label):
    """Writes texts (book, pos, value) as one text file per book, in order; returns the files' paths.

    There are as many files as books, so tasks put them in their places; else the driver would, one after another.
    """
    path = new_path(texts.sparkSession, label)
    texts.repartition("book").sortWithinPartitions("book", "pos").select("book", "value").write.option(
        "mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy("book").text(path)
    return path + "/*/*.txt"


def book_of_path():
    return F.regexp_extract("book_id", "book=([^/]+)/", 1)


def read_books(spark, sf_dir):
    """Lines of text files that hold some hundred documents each, written with both kinds of line breaks."""
    texts = table(spark, sf_dir, "documents").select(
        F.concat("source", F.lit("-"), F.floor(F.col("doc_id") / 256).cast("string")).alias("book"),
        F.col("doc_id").alias("pos"), F.when(F.col("doc_id") % 2 == 0, F.replace("text", F.lit("\n"), F.lit("\r\n")))
        .otherwise(F.col("text")).alias("value"))
    return books.read_lines(spark, as_files(texts, "book-files")).withColumn("book_id", book_of_path())


def number_lines(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("book_id"), "doc_id", "text")
    return books.document_lines(docs)


def read_script(spark, sf_dir):
    """JSON-lines texts with blank lines in them, two rows for every turn of a conversation."""
    row = F.to_json(F.struct(F.col("role").alias("speaker"), F.col("text").alias("line")))
    upper = F.to_json(F.struct(F.upper("role").alias("speaker"), F.lit("...").alias("line")))
    texts = table(spark, sf_dir, "conversations").select(
        F.floor(F.col("conv_id") / 8).cast("string").alias("book"), F.struct("conv_id", "turn").alias("pos"),
        F.concat(F.lit("\n"), row, F.lit("\n \n"), upper).alias("value"))
    return books.read_script(spark, as_files(texts, "script-files")).withColumn("book_id", book_of_path())


def script_rows(spark, sf_dir):
    return books.script_rows(conversation_script(spark, sf_dir))


def write_script(spark, sf_dir):
    """Rows of the files a script was written to."""
    path = new_path(spark, "script")
    books.write_script(conversation_script(spark, sf_dir), path)
    return spark.read.schema("book_id string, item_no long, speaker string, line string").json(path)


def character_map_text(spark, sf_dir):
    return maps.character_map_text(characters(spark, sf_dir), 10_000)


def read_character_map(spark, sf_dir):
    return maps.parse_character_map(character_map_text(spark, sf_dir)).withColumn(
        "gender_score", F.col("gender_score").cast("bigint"))


def line_manifest(spark, sf_dir):
    return files.line_manifest(chapter_lines(spark, sf_dir))


def book_manifest(spark, sf_dir):
    return files.book_manifest(chapter_table(spark, sf_dir))


def chapter_metadata(spark, sf_dir):
    return files.chapter_metadata(timeline(spark, sf_dir))


def extract_page_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", page_text("html").alias("text"))


def save_text(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("book_id"), normalize_line_breaks("text").alias("text"))
    path = new_path(spark, "books")
    books.save_text(docs, path)
    return spark.read.parquet(path)


QUERIES = {
    "read_books": read_books,
    "document_lines": number_lines,
    "read_script": read_script,
    "script_rows": script_rows,
    "write_script": write_script,
    "read_character_map": read_character_map,
    "character_map_text": character_map_text,
    "line_manifest": line_manifest,
    "book_manifest": book_manifest,
    "chapter_metadata": chapter_metadata,
    "extract_page_text": extract_page_text,
    "save_text": save_text,
}

_JSON = """'{"speaker":' || to_json(speaker) || ',"line":' || to_json(line) || '}'"""
_LEGEND = ", ".join(f'"{k}":"{v}"' for k, v in fixed.SCORE_LEGEND.items()).replace(", ", ",")

SQL = {
    "read_books": """with l as (select source || '-' || (doc_id // 256) as book_id,
        string_split(string_agg(text, chr(10) order by doc_id) || chr(10), chr(10)) as l from documents group by 1)
        select book_id, unnest(range(0, len(l))) as line_no, unnest(l) as line from l""",
    "document_lines": """select source as book_id, row_number() over (partition by source order by doc_id, i) - 1 as line_no,
        line from (select source, doc_id, unnest(string_split(text, chr(10))) as line,
          unnest(range(0, len(string_split(text, chr(10))))) as i from documents)""",
    "read_script": """select cast(conv_id // 8 as varchar) as book_id,
        row_number() over (partition by conv_id // 8 order by conv_id, turn, k) - 1 as item_no, speaker, line from (
        select conv_id, turn, 0 as k, role as speaker, text as line from conversations union all
        select conv_id, turn, 1, upper(role), '...' from conversations)""",
    "script_rows": f"with {CONVERSATION_SCRIPT_SQL} select book_id, item_no, {_JSON} as value from script",
    "write_script": f"with {CONVERSATION_SCRIPT_SQL} select * from script",
    "read_character_map": f"""with {CHARACTERS_SQL} select book_id, name, age, gender, gender_score,
        description from characters""",
    "character_map_text": f"""with {CHARACTERS_SQL} select book_id, 0 as part_no,
        '{{"legend":{{{_LEGEND}}},"scores":{{' || string_agg('"' || name || '":{{"name":"' || name
        || '","age":"' || age || '","gender":"' || gender || '","gender_score":' || gender_score
        || ',"description":"' || description || '"}}', ',' order by seen_batch, seen_op) || '}}}}' as text
        from characters group by book_id""",
    "line_manifest": ms(ASSIGNED_SQL + """ select book_id, chapter_no, chapter,
        row_number() over (partition by book_id, chapter_no order by line_no) as place,
        'file ''temp_audio/line_segments/line_' || lpad(cast(line_no as varchar), 6, '0') || '.wav''' as value
        from assigned join chapters using (book_id, chapter)"""),
    "book_manifest": ms(ASSIGNED_SQL + """ select book_id, chapter_no,
        'file ''temp_audio/' || chapter || '.m4a''' as value from chapters"""),
    "chapter_metadata": ms(TIMELINE_SQL + """ select book_id, chapter_no, '[CHAPTER]' || chr(10)
        || 'TIMEBASE=1/1000' || chr(10) || 'START=' || start_ms || chr(10) || 'END=' || end_ms || chr(10)
        || 'title=' || chapter || chr(10) as value from timeline
        union all select distinct book_id, 0, ';FFMETADATA1' from timeline"""),
    "extract_page_text": f"select page_id, {_page_sql('html')} as text from pages",
    "save_text": f"""select cast(doc_id as varchar) as book_id, array_to_string(list_filter(list_transform(
        string_split_regex(text, {s.q(s.LINE_BREAK)}), lambda x: {s.strip("x")}), lambda x: x <> ''), chr(10))
        as text from documents""",
}
