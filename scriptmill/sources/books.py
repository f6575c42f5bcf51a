"""Books and scripts as tables."""

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from scriptmill.functions.chars import is_blank, lines_of, strip
from scriptmill.operators.ordered import SumBefore, number_rows, running
from scriptmill.session import stage

SCRIPT_ROW = "speaker string, line string"


def read_books(spark: SparkSession, path: str) -> DataFrame:
    """One row per text file: book_id is its path, text its whole content, each line break as one line feed.

    For files that fit in a row; `read_lines` has no such bound.
    """
    return spark.read.text(path, wholetext=True).select(
        F.input_file_name().alias("book_id"), F.regexp_replace("value", "\r\n?", "\n").alias("text"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files, numbered from 0: the lines of `book_lines(read_books(...))`, but a file is as many tasks as
    it has splits.

    Splits are counted, and a line's number is that of its split's first line plus its place there. What is read is
    staged, as another reading may cut other splits. Line feeds, carriage returns and both together end a line; text
    that ends so has an empty last line. Compressed files are one split, and have no such last line.
    """
    raw = spark.read.option("lineSep", "\n").text(path).select(
        F.input_file_name().alias("book_id"), F.col("_metadata.file_block_start").alias("split"),
        F.col("_metadata.file_size").alias("size"), F.monotonically_increasing_id().alias("at"), "value")
    returned = F.endswith("value", F.lit("\r"))
    line = F.when(returned, F.expr("left(value, length(value) - 1)")).otherwise(F.col("value"))
    rows = stage(raw.select("book_id", "split", "size", "at", (F.octet_length("value") + 1).cast("bigint").alias("bytes"),
                            returned.alias("returned"), line.alias("value")), "read")
    # carriage returns inside a row are line breaks too
    breaks = F.length("value") - F.length(F.replace("value", F.lit("\r"), F.lit("")))
    splits = rows.groupBy("book_id", "split").agg(
        F.min("at").alias("first"), F.count("*").alias("rows"), F.sum(breaks.cast("bigint")).alias("breaks"),
        F.max("size").alias("size"), F.sum("bytes").alias("bytes"), F.max(F.struct("at", "returned")).alias("end"))
    book = Window.partitionBy("book_id").orderBy("split")
    before = book.rowsBetween(Window.unboundedPreceding, -1)
    lines = F.col("rows") + F.col("breaks")
    placed = stage(splits.select(
        "book_id", "split", "first", "breaks", F.coalesce(F.sum(lines).over(before), F.lit(0)).alias("offset"),
        lines.alias("lines"), F.lead("split").over(book).isNull().alias("last"),
        # the rest of a file of which every line has been read: its mark of UTF-8, if it has one, and no missing line feed
        (F.col("end.returned") | (F.col("size") - F.sum("bytes").over(book)).isin(0, 3)).alias("ended")), "splits")
    plain = rows.join(placed.where("breaks = 0").select("book_id", "split", "first", "offset"), ["book_id", "split"]).select(
        "book_id", (F.col("offset") + F.col("at") - F.col("first")).alias("line_no"), F.col("value").alias("line"))
    inside = Window.partitionBy("book_id", "split").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    broken = rows.join(placed.where("breaks > 0").select("book_id", "split", "offset"), ["book_id", "split"]).select(
        "book_id", (F.col("offset") + F.coalesce(F.sum(breaks.cast("bigint") + 1).over(inside), F.lit(0))).alias("from"),
        "value").select("book_id", "from", F.posexplode(F.split("value", "\r", -1)).alias("nth", "line")).select(
        "book_id", (F.col("from") + F.col("nth")).alias("line_no"), "line")
    ends = placed.where("last and ended").select("book_id", (F.col("offset") + F.col("lines")).alias("line_no"),
                                                 F.lit("").alias("line"))
    return plain.union(broken).union(ends)


def book_lines(books: DataFrame) -> DataFrame:
    """Lines of whole-text books, numbered from 0."""
    return books.select("book_id", F.posexplode(lines_of("text")).alias("line_no", "line")
                        ).withColumn("line_no", F.col("line_no").cast("bigint"))


def document_lines(documents: DataFrame) -> DataFrame:
    """Lines of books that come in many documents (book_id, doc_id, text), numbered from 0.

    Line counts are summed over documents, so only the documents move, once, as they are.
    """
    count = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    placed = running(documents, ["book_id"], "doc_id",
                     {"__first": SumBefore(count.cast("bigint"))}, block_rows=1 << 12)
    return placed.select("book_id", "__first",
                         F.posexplode(lines_of("text")).alias("__at", "line")).select(
        "book_id", (F.col("__first") + F.col("__at")).alias("line_no"), "line")


def script_lines(lines: DataFrame) -> DataFrame:
    """Rows of JSON lines (book_id, line_no, line): speaker, line, and in `broken` what is not a JSON object.

    Blank lines are skipped, order is kept, broken rows are numbered with the others.
    """
    return number_rows(lines.where(~is_blank("line")), ["book_id"], "line_no", "item_no").select(
        "book_id", "item_no", F.from_json(strip("line"), SCRIPT_ROW + ", broken string", {
            "columnNameOfCorruptRecord": "broken"}).alias("r")).select(
        "book_id", "item_no", "r.speaker", "r.line", "r.broken")


def _checked(rows: DataFrame) -> DataFrame:
    message = F.concat(F.lit("not a script row: "), F.col("broken"))
    checked = F.when(F.col("broken").isNotNull(), F.raise_error(message).cast("string")).otherwise(F.col("line"))
    return rows.select("book_id", "item_no", "speaker", checked.alias("line"))


def parse_script(texts: DataFrame) -> DataFrame:
    """Script rows of JSON-lines texts (book_id, text); a broken row fails the job when it is read."""
    return _checked(script_lines(book_lines(texts)))


def broken_rows(texts: DataFrame) -> DataFrame:
    """The rows that `parse_script` would fail on: book_id, item_no, broken."""
    return script_lines(book_lines(texts)).where("broken is not null").select("book_id", "item_no", "broken")


def read_script(spark: SparkSession, path: str) -> DataFrame:
    """Script rows of JSON-lines files of any size; a broken row fails the job when it is read."""
    return _checked(script_lines(read_lines(spark, path)))


def script_rows(script: DataFrame) -> DataFrame:
    """Script rows as JSON text: book_id, item_no, value."""
    return script.select("book_id", "item_no",
                         F.to_json(F.struct("speaker", "line")).alias("value"))


ROWS_PER_PART = 1 << 20


def write_ordered_text(df: DataFrame, pos: str, path: str, keys=("book_id",), rows_per_part: int = ROWS_PER_PART) -> None:
    """One folder per book and part with text files, rows in the book's order.

    A book is cut into parts of `rows_per_part` rows, so a long one is written by many tasks; the
    parts' names sort in order. For the books one means to hand out: a folder each is too many
    for a whole corpus.
    """
    part = F.floor(F.col(pos) / rows_per_part).cast("bigint")
    cut = df.withColumn("part", F.lpad(part.cast("string"), 8, "0"))
    (cut.repartition(*keys, "part").sortWithinPartitions(*keys, "part", pos)
        .select(*keys, "part", "value").write.partitionBy(*keys, "part").mode("overwrite")
        .text(path))


def write_script(script: DataFrame, path: str, per_book: bool = False) -> None:
    """JSON rows in order; what was there is replaced.

    By default rows carry book_id and item_no and many books share a file, each in one piece
    and in order. With `per_book` every book gets a folder of plain speaker/line rows.
    """
    if per_book:
        write_ordered_text(script_rows(script), "item_no", path)
        return
    part = F.floor(F.col("item_no") / ROWS_PER_PART)
    (script.withColumn("__part", part).repartition("book_id", "__part")
        .sortWithinPartitions("book_id", "item_no")
        .select("book_id", "item_no", "speaker", "line").write.mode("overwrite").json(path))


def save_text(books: DataFrame, path: str) -> None:
    """Edited text per book; what was there is replaced."""
    books.select("book_id", "text").write.mode("overwrite").parquet(path)
