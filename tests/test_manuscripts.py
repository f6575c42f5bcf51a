"""Line tables give the lines of the string forms, across small blocks."""

import random

import pytest
from pyspark.sql import functions as F

from scriptmill.functions import clean, paragraphs
from scriptmill.functions.chars import lines_of
from scriptmill.operators import manuscripts as m
from scriptmill.sources.books import document_lines

BLOCK = 4


@pytest.fixture
def books(spark):
    """Texts by book and their line tables."""
    def made(texts):
        df = spark.createDataFrame(list(texts.items()), "book_id string, text string")
        return df, document_lines(df.withColumn("doc_id", F.lit(0)))
    return made


def lines_by_string(df, fn):
    return sorted((r.book_id, i, line) for r in df.select("book_id", lines_of(fn("text")).alias("lines")).collect()
                  for i, line in enumerate(r.lines))


def rows(df):
    return sorted((r.book_id, r.line_no, r.line) for r in df.collect())


def corpus(seed, parts, n=60, size=14):
    r = random.Random(seed)
    return {f"b{i}": "\n".join("".join(r.choice(parts) for _ in range(r.randrange(4))) for _ in range(r.randrange(1, size)))
            for i in range(n)}


@pytest.mark.parametrize("fn, table", [(clean.normalize_line_breaks, m.normalize_lines),
                                       (clean.fix_unterminated_quotes, m.close_line_quotes)])
def test_cleaning(books, fn, table):
    df, lines = books(corpus(1, ["a", ' "', " \t", "\r", "\x0b", "x y", ""]))
    want = [r for r in lines_by_string(df, fn)]
    # a text without lines is an empty string, a book without lines has no rows
    assert rows(table(lines, BLOCK)) == [r for r in want if r[2] or r[1]]


@pytest.mark.parametrize("seed, min_chars", [(1, 1), (2, 5), (3, 20), (4, 60)])
def test_main_content(books, seed, min_chars):
    parts = ["PROLOGUE", "THE END", "Part", "a chapter", "words ", " ", "  ", "", "\t", "more words here", "\xa0"]
    df, lines = books(corpus(seed, parts, 150) | {
        "same line": "x PROLOGUE text of it THE END", "twice": "PROLOGUE THE END\nPROLOGUE\n\nwords\n\nPart\nTHE END THE END",
        "none": "a\nb", "reversed": "THE END words words PROLOGUE", "sections": "PROLOGUE\nPart\n\n \nchapter THE END",
        "edges": "PROLOGUE\n\n Part\n \n  text \n\n book\n\n  \nTHE END", "empty": "", "only": "PROLOGUE chapter THE END"})

    def by_string(text):
        return clean.extract_main_content(text, "PROLOGUE", "THE END", min_chars)

    got = rows(m.main_content_lines(lines, "PROLOGUE", "THE END", min_chars, BLOCK))
    assert got == lines_by_string(df, by_string)


def test_main_content_of_a_book_in_many_documents(spark):
    docs = spark.createDataFrame([("b", i, t) for i, t in enumerate(
        ["CONTENTS\nPROLOGUE", *["words and words\n"] * 50, "ABOUT THE AUTHOR\nx"])], "book_id string, doc_id long, text string")
    got = rows(m.main_content_lines(document_lines(docs), block_rows=BLOCK))
    assert [line for *_, line in got] == (["words and words", ""] * 50)[:-1]


@pytest.mark.parametrize("marks", [("", "x"), (" a", "b"), ("a\nb", "c")])
def test_markers_that_no_line_holds(books, marks):
    with pytest.raises(ValueError, match="markers"):
        m.main_content_lines(books({"b": "x"})[1], *marks)


def test_paragraphs_there_and_back(books):
    df, lines = books(corpus(5, ["a", " b ", "", " ", "\t", "c ||| d"], size=30) | {"long": "\n".join("abcdefghijk" * 3), "empty": ""})
    joined = m.join_paragraph_lines(lines, BLOCK)
    want = {r.book_id: (r.t.split("\n"), r.s) for r in df.select(
        "book_id", paragraphs.join_paragraphs("text").alias("t"), paragraphs.paragraph_sizes("text").alias("s")).collect()}
    got = {}
    for r in sorted(joined.collect(), key=lambda r: (r.book_id, r.paragraph_no)):
        texts, sizes = got.setdefault(r.book_id, ([], []))
        assert r.paragraph_no == len(texts)
        texts.append(r.text)
        sizes.append(r.size)
    assert got == want
    # lines that come back in another number, and paragraphs without a size
    answered = joined.withColumn("text", F.when(F.col("paragraph_no") % 3 == 1, F.replace("text", F.lit(" ||| "), F.lit(" "))).otherwise(
        F.col("text"))).unionByName(joined.groupBy("book_id").agg(F.max("paragraph_no").alias("p")).select(
            "book_id", (F.col("p") + 1).alias("paragraph_no"), F.lit(9).cast("bigint").alias("size"), F.lit("more ||| lines").alias("text")))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("paragraph_no", "text"))), lambda x: x["text"]), "\n")
    texts = answered.groupBy("book_id").agg(text.alias("text")).join(
        df.select("book_id", paragraphs.paragraph_sizes("text").alias("sizes")), "book_id")
    whole = lines_by_string(texts, lambda t: paragraphs.split_paragraphs(t, "sizes"))
    assert rows(m.split_paragraph_lines(answered, joined, BLOCK)) == whole


def test_a_paragraph_as_long_as_its_book_stays_rows(spark):
    lines = spark.range(50).select(F.lit("b").alias("book_id"), F.col("id").alias("line_no"), F.lit("x").alias("line"))
    made = m.paragraph_lines(lines, BLOCK)
    assert [tuple(r) for r in made.orderBy("line_no").select("paragraph_no", "place", "size").collect()] == [
        (0, i, 50) for i in range(50)]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "book_id string, line_no long, line string")
    for fn in (m.normalize_lines, m.close_line_quotes, m.main_content_lines, m.paragraph_lines, m.join_paragraph_lines):
        assert fn(none).count() == 0
