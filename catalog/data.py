"""Input views derived from the given tables, in Spark and as SQL.

The two sides share the SQL text where it means the same in both engines.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F

from scriptmill.session import stage
from scriptmill.sources.books import document_lines

WHO = """case ((doc_id * 3 + pos) % 5) when 0 then 'Mia' when 1 then 'Sam' when 2 then 'Ellie'
  when 3 then 'Jack' else 'Luna' end"""
# What a document's line becomes: itself, spoken or quoted in some way, with lines put before and after it.
NUMBER = "(doc_id * 3 + pos)"
LINE_CASE = f"""case
  when {NUMBER} % 40 = 20 then concat('Part of ', raw)
  when {NUMBER} % 8 = 1 then concat({WHO}, ' said, "', raw, '" and left')
  when {NUMBER} % 8 = 2 then concat('"', raw, '" replied ', {WHO}, '.')
  when {NUMBER} % 8 = 3 and {NUMBER} % 3 = 0 then concat({WHO}, ' laughed at ', raw)
  when {NUMBER} % 8 = 4 then concat('"', raw)
  when {NUMBER} % 8 = 5 then concat(raw, '"')
  when {NUMBER} % 8 = 7 then concat('“', raw, '” — ', {WHO}, '’s note at 3:30 PM…')
  else raw end"""
BEFORE_CASE = f"""case
  when {NUMBER} % 160 = 120 then concat('PART Twenty-One ', raw)
  when {NUMBER} % 40 = 0 then concat('Chapter ', cast(cast(floor({NUMBER} / 40) as bigint) % 9 + 1 as string), ': Section')
  when {NUMBER} % 16 = 6 then '...'
  when {NUMBER} % 16 = 14 then '' end"""

MANUSCRIPT_SQL = f"""r as (
  select source as book_id, doc_id, i - 1 as pos, string_split(text, chr(10))[i] as raw
  from (select *, unnest(range(1, len(string_split(text, chr(10))) + 1)) as i from documents)),
n as (select book_id, doc_id, pos, unnest(case when {BEFORE_CASE} is null then [{LINE_CASE}]
  else [{BEFORE_CASE}, {LINE_CASE}] end) as line, unnest([1, 2]) as part from r),
manuscript as (select book_id, cast(row_number() over (partition by book_id order by doc_id, pos, part) - 1 as bigint)
  as line_no, line from n where line is not null)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def manuscript(spark: SparkSession, sf_dir: str, staged: bool = False) -> DataFrame:
    """The documents of a source as a book. Every line of every document is in it, whole.

    Lines are counted before they are placed; `staged` documents are not made a second time for that.
    """
    lines = table(spark, sf_dir, "documents").select(
        F.col("source").alias("book_id"), "doc_id", F.expr(
            f"flatten(transform(split(text, '\\n'), (raw, pos) -> filter(array({BEFORE_CASE}, {LINE_CASE}),"
            " x -> x is not null)))").alias("lines"))
    books = lines.select("book_id", "doc_id", F.array_join("lines", "\n").alias("text"))
    return document_lines(stage(books, "books") if staged else books)


def ms(body: str, recursive: bool = False) -> str:
    """A query on the manuscript view: `body` is more CTEs and the final select."""
    return f"with {'recursive ' if recursive else ''}{MANUSCRIPT_SQL},\n{body}"


# Characters of every book; luna is left out so that one speaker is not in the registry.
CAST = [
    ("narrator", "adult", "female", 0, "The narrator of the story", -1, 0),
    ("unknown", "adult", "unknown", 5, "Unknown or ambiguous speaker", -1, 1),
    ("mia", "adult", "female", 8, "A brave leader", 0, 0),
    ("sam", "adult", "male", 2, "A clever inventor", 0, 1),
    ("ellie", "child", "female", 10, "Loves animals", 1, 0),
    ("jack", "adult", "male", 1, "Strong and loyal", 1, 1),
]
CHARACTERS_SQL = f"""characters as (select book_id, c.* from
  (select distinct source as book_id from documents) b, (values {", ".join(map(str, CAST))})
  as c(name, age, gender, gender_score, description, seen_batch, seen_op))"""


def characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    books = table(spark, sf_dir, "documents").select(F.col("source").alias("book_id")).distinct()
    cast = F.expr("array(" + ", ".join(f"struct{row}" for row in CAST) + ")")
    names = ["name", "age", "gender", "gender_score", "description", "seen_batch", "seen_op"]
    types = ["string", "string", "string", "int", "string", "bigint", "bigint"]
    return books.select("book_id", F.explode(cast).alias("c")).select(
        "book_id", *[F.col(f"c.col{i + 1}").cast(t).alias(n)
                     for i, (n, t) in enumerate(zip(names, types))])


CONVERSATION_SCRIPT = """select cast(conv_id as string) as book_id, cast(turn as bigint) as item_no,
  role as speaker, text as line from {conversations}"""


def conversation_script(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(CONVERSATION_SCRIPT, conversations=table(spark, sf_dir, "conversations"))


CONVERSATION_SCRIPT_SQL = ("script as ("
                           + CONVERSATION_SCRIPT.format(conversations="conversations") + ")")

MANIFEST = """select cast(page_id as string) as book_id,
  case page_id % 6 when 0 then concat('books/', replace(substr(url, 9), '?', '$'), '.epub')
    when 1 then concat('books/', cast(page_id as string), '/My Book, vol. 2.pdf')
    when 2 then concat('../', cast(page_id as string), '.txt')
    when 3 then concat('shelf/', cast(page_id as string))
    when 4 then concat('shelf/it''s ', cast(page_id as string), '/')
    else concat('.hidden', cast(page_id as string)) end as path,
  case when page_id % 3 = 0 then '' when page_id % 3 = 1 then concat('Title: "', url, '" & more?')
    else concat('No. ', cast(page_id as string), ' / second') end as title,
  case page_id % 9 when 0 then 'm4b' when 1 then 'aac' when 2 then 'm4a' when 3 then 'mp3'
    when 4 then 'wav' when 5 then 'opus' when 6 then 'flac' when 7 then 'm4b' else 'ogg' end
    as output_format,
  case page_id % 7 when 0 then 'male' when 6 then 'other' else 'female' end as narrator_gender,
  case when page_id % 4 = 3 then 'nothing here' else concat(
    'Title               : The "', url, '"', chr(10), 'Title: Book ',
    cast(page_id as string), ' <i>', chr(10), 'no value', chr(10), 'Author(s): A. Writer: B', chr(10),
    'Publisher:  ', chr(10), 'Languages: ', html, chr(10), 'Title: Last ',
    cast(page_id as string), chr(10), 'Comments: $5; "so" it is') end as metadata_text,
  case page_id % 6
    when 0 then '{"streams":[{"codec_type":"video"},{"codec_type":"audio","sample_rate":"48000","channels":2}],"format":{"duration":"12.5"}}'
    when 1 then concat('{"streams":[{"codec_type":"audio","sample_rate":"', cast(8000 + page_id * 150 as string), '","channels":1}],"format":{}}')
    when 2 then '{"streams":[{"codec_type":"video"}]}'
    when 3 then 'not json'
    when 4 then '{"streams":[{"codec_type":"audio","sample_rate":"fast","channels":1}],"format":{"duration":"3"}}'
    else '{"streams":[{"codec_type":"audio","sample_rate":22050,"channels":6}],"format":{"duration":"0.25"}}' end
    as probe_json,
  page_id % 5 <> 0 as has_cover
from {pages}"""
MANIFEST_SQL = "manifest as (" + MANIFEST.replace("{pages}", "pages") + ")"


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Braces of JSON texts would be read as parameters, so the view is named instead.
    table(spark, sf_dir, "pages").createOrReplaceTempView("manifest_pages")
    return spark.sql(MANIFEST.replace("{pages}", "manifest_pages"))


CHAR_OPS = """select cast(user_id % 10 as string) as book_id,
  cast(floor(event_id / 50) as bigint) as batch_no, cast(event_id % 50 as bigint) as op_no,
  case event_id % 5 when 0 then 'insert' when 1 then 'insert' when 4 then 'merge' else 'update' end
    as operation,
  concat(' C', cast(user_id % 7 as string)) as name,
  case when event_id % 5 = 4 then concat('c', cast((user_id + 1) % 7 as string)) end as existing_name,
  case event_id % 3 when 0 then 'child' when 1 then 'adult' else 'elderly' end as age,
  case event_id % 11 when 0 then 'unknown' when 1 then 'unknown'
    else case when user_id % 2 = 0 then 'male' else 'female' end end as gender,
  concat(event_type, ' ', substr('a long description of someone', 1, cast(floor(value) % 20 as int)))
    as description
from {events}"""
CHAR_OPS_SQL = "ops as (" + CHAR_OPS.format(events="events") + ")"


def char_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(CHAR_OPS, events=table(spark, sf_dir, "events"))


# Blocks of four lines with what a model might make of them.
BLOCKS_LINES = """select book_id, line_no, cast(floor(line_no / 4) as bigint) as block_no,
  case when line_no % 8 = 4 then concat(line, '"') when line_no % 8 = 5 then concat('"', line)
    else line end as line from {manuscript}"""
BLOCKS = """select book_id, block_no, start_line, end_line, original,
  case block_no % 8
    when 0 then replace(original, '" ', ' <laugh>" ')
    when 1 then case when block_no % 3 = 0 then concat('<text>', original) else concat(original, ' <smile>') end
    when 2 then concat(original, ' extra')
    when 3 then replace(original, chr(10), ' ')
    when 4 then replace(original, ' and ', ' and <gasp> ')
    when 5 then concat('`', replace(original, '...', '... <cough>'), '`')
    when 6 then case when block_no % 3 = 0 then concat(original, ' <sigh> <gasp>') when block_no % 3 = 1
      then concat('<laugh> ', replace(original, chr(10), concat(' <sigh>', chr(10), '<cough> ')), ' <gasp>')
      else concat(original, ' > ') end
    else case when block_no % 3 = 0 then replace(original, 'e', 'e<sigh>e') when block_no % 3 = 1
      then regexp_replace(original, '([a-z])([a-z])', '{one}<sigh>{two}') else original end end as enhanced
from (select book_id, block_no, start_line, end_line,
  case when block_no % 8 = 4 and block_no % 3 <> 0 then concat(text, ' &lt;ok') else text end as original
  from {blocks}) b"""


def tagged_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks_of(manuscript(spark, sf_dir))


def blocks_of(lines: DataFrame) -> DataFrame:
    """Tagged blocks of lines that a query also needs for itself."""
    spark = lines.sparkSession
    lines = spark.sql(BLOCKS_LINES, manuscript=lines)
    blocks = lines.groupBy("book_id", "block_no").agg(
        F.min("line_no").alias("start_line"), (F.max("line_no") + 1).alias("end_line"),
        F.sort_array(F.collect_list(F.struct("line_no", "line"))).alias("l")
    ).withColumn("text", F.array_join(F.transform("l", lambda x: x["line"]), "\n"))
    return spark.sql(BLOCKS.replace("{one}", "$1").replace("{two}", "$2"), blocks=blocks)


BLOCKS_SQL = (
    "block_lines as (" + BLOCKS_LINES.format(manuscript="manuscript") + "),\n"
    "blocks as (select book_id, block_no, min(line_no) as start_line, max(line_no) + 1 as end_line,"
    " string_agg(line, chr(10) order by line_no) as text from block_lines group by all),\n"
    "tagged as (" + BLOCKS.replace("{one}", r"\1").replace("{two}", r"\2")
    .replace("{blocks}", "blocks").replace("<sigh>\\2')", "<sigh>\\2', 'g')") + ")")
