"""From a book's lines to tagged lines: requests for chunks, their answers, requests for single lines, theirs.

Chunks have book_id, chunk_no, start_line, end_line and `original`, their lines; (book_id, chunk_no) names a chunk.
An answer function takes requests (with `user_text`) and returns them with `response`; `answers.ask` is one.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from scriptmill.functions.chars import is_blank, lines_of
from scriptmill.functions.clean import strip_thinking
from scriptmill.functions.paragraphs import join_paragraphs, paragraph_sizes, split_paragraphs
from scriptmill.functions.tokens import token_count
from scriptmill.operators.registry import TAG, tagging_text
from scriptmill.operators.tags import reassemble, validate_chunks
from scriptmill.session import passing, stage

CHUNK = ["book_id", "chunk_no"]
LINE = [*CHUNK, "at"]


def _requests(df: DataFrame, kind: str, key: list[str], original: str, template: str) -> DataFrame:
    text = tagging_text(join_paragraphs(original), template)
    return df.select(*key, F.lit(kind).alias("kind"), text.alias("user_text")).withColumn(
        "tokens", token_count("user_text"))


def chunk_requests(chunks: DataFrame, template: str = TAG) -> DataFrame:
    """One request a chunk: book_id, chunk_no, kind, user_text (its lines in paragraph form), tokens."""
    return _requests(chunks, "tag", CHUNK, "original", template)


def answer_lines(response, original) -> Column:
    """The lines of a response to `original`: no reasoning, no space around it, paragraphs as lines again."""
    return split_paragraphs(strip_thinking(response), paragraph_sizes(original))


def chunk_answers(chunks: DataFrame, responses: DataFrame) -> DataFrame:
    """Chunks with their validated answers: text, success, reverted, reason.

    `responses` has book_id, chunk_no and response. A chunk without a response, or with a null one, keeps its
    lines, with a reason; responses to other chunks are passed over.
    """
    both = chunks.join(responses.select(*CHUNK, "response"), CHUNK, "left")
    answered = both.withColumn("enhanced", answer_lines("response", "original"))
    return validate_chunks(answered).drop("response")


def reverted_lines(checked: DataFrame) -> DataFrame:
    """The lines of reverted chunks: book_id, chunk_no, at (place in the chunk), line."""
    return checked.where("reverted").select(*CHUNK, F.posexplode(lines_of("original")).alias("at", "line"))


def line_requests(checked: DataFrame, template: str = TAG) -> DataFrame:
    """One request for each line of a reverted chunk that is not blank."""
    return _requests(reverted_lines(checked).where(~is_blank("line")), "tag_line", LINE, "line", template)


def line_answers(checked: DataFrame, responses: DataFrame) -> DataFrame:
    """Reverted chunks with their lines' answers, each validated alone; other chunks as they are.

    `responses` has book_id, chunk_no, at and response. A line whose answer is missing or breaks a rule stays.
    `lines_tagged` counts the lines that an answer changed, null where no line was asked for. Lines meet again
    by chunk, whose size the token budget bounds.
    """
    both = reverted_lines(checked).join(responses.select(*LINE, "response"), LINE, "left")
    valid = validate_chunks(both.select(*LINE, F.col("line").alias("original"),
                                        answer_lines("response", "line").alias("enhanced")))
    placed = F.sort_array(F.collect_list(F.struct("at", "text")))
    back = valid.groupBy(*CHUNK).agg(
        F.array_join(F.transform(placed, lambda x: x["text"]), "\n").alias("__text"),
        F.count_if(F.col("text") != F.col("original")).alias("lines_tagged"))
    return checked.join(back, CHUNK, "left").withColumn("text", F.coalesce("__text", "text")).drop("__text")


def _first_round(chunks: DataFrame, ask: Callable[[DataFrame], DataFrame], template: str) -> DataFrame:
    chunks = stage(chunks, "chunks")
    return chunk_answers(chunks, ask(chunk_requests(chunks, template)))


def _second_round(checked: DataFrame, ask: Callable[[DataFrame], DataFrame], template: str) -> DataFrame:
    return line_answers(checked, ask(line_requests(checked, template)))


def tag_chunks(chunks: DataFrame, ask: Callable[[DataFrame], DataFrame], template: str = TAG) -> DataFrame:
    """Chunks after both rounds: text; success, reverted and reason of the first; lines_tagged of the second.

    What is read more than once is staged, so that no answer is asked for again.
    """
    checked = stage(_first_round(chunks, ask, template), "checked")
    return stage(_second_round(checked, ask, template), "tagged")


def tag_lines(lines: DataFrame, chunks: DataFrame, ask: Callable[[DataFrame], DataFrame],
              template: str = TAG) -> DataFrame:
    """The book's lines after both rounds of `tag_chunks`, as `reassemble` gives them.

    Between the rounds a chunk is one text: a reverted one is its original, of others that is not needed again.
    `reassemble` goes through the chunks once, so they are not staged for it. What a round stages goes after it.
    """
    spark = lines.sparkSession
    with passing(spark):
        with passing(spark):
            first = _first_round(chunks, ask, template).select(*CHUNK, "start_line", "end_line", "text", "reverted")
            checked = stage(first, "checked", lasting=True).withColumn("original", F.col("text"))
        return reassemble(lines, _second_round(checked, ask, template))
