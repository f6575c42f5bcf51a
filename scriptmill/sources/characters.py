"""Character maps: one JSON document per book and table rows."""

from pyspark.sql import DataFrame, functions as F

from scriptmill import fixed
from scriptmill.operators.ordered import SumBefore, running
from scriptmill.operators.registry import SEEN, SEEN_BATCHES

INFO = "struct<name:string,age:string,gender:string,gender_score:int,description:string>"
CHARACTER_MAP = f"struct<legend:map<string,string>,scores:map<string,{INFO}>>"


def parse_character_map(docs: DataFrame) -> DataFrame:
    """Characters of map documents (book_id, text)."""
    scores = F.from_json("text", CHARACTER_MAP)["scores"]
    return docs.select("book_id", F.explode(scores).alias("key", "c")).select(
        "book_id", F.col("key").alias("name"), "c.age", "c.gender", "c.gender_score",
        "c.description")


def character_map_text(characters: DataFrame, part_rows: int) -> DataFrame:
    """`{legend, scores}` documents: book_id, part_no, text, for `part_rows` characters each.

    A usual book is part 0. Parts of a huge roster are maps of their own; `parse_character_map` reads all of them.
    """
    one = F.lit(1).cast("bigint")
    placed = running(characters, ["book_id"], SEEN, {"__n": SumBefore(one)}, SEEN_BATCHES)
    info = F.struct("name", "age", "gender", "gender_score", "description")
    grouped = placed.groupBy(
        "book_id", F.floor(F.col("__n") / part_rows).cast("bigint").alias("part_no")).agg(
        F.sort_array(F.collect_list(F.struct("__n", "name", info.alias("info")))).alias("l"))
    legend = F.create_map(*[F.lit(x) for pair in fixed.SCORE_LEGEND.items() for x in pair])
    scores = F.map_from_entries(F.transform("l", lambda r: F.struct(r["name"], r["info"])))
    return grouped.select("book_id", "part_no", F.to_json(
        F.struct(legend.alias("legend"), scores.alias("scores"))).alias("text"))
