"""Speaker-attributed scripts: attribution, checks, and applying tagged lines to them."""

from pyspark.sql import DataFrame, Window, functions as F

from scriptmill import fixed
from scriptmill.functions.chars import WORD, is_blank
from scriptmill.operators.ordered import SumBefore, WholeSum, running

KEYS = ["book_id"]
SPECIAL = ["narrator", "unknown"]


def apply_tagged_lines(script: DataFrame, tagged: DataFrame) -> DataFrame:
    """Tagged lines in place of the script's, by position, if the counts of a book agree.

    Rows without a speaker are rows of the script like others.     The counts travel through the block table, so no row waits for its whole book.
    """
    one = F.lit(1).cast("bigint")
    both = script.withColumnRenamed("line", "__script").withColumn("__s", F.lit(True)).join(
        tagged.select("book_id", F.col("line_no").alias("item_no"), F.col("line").alias("__tag"),
                      F.lit(True).alias("__t")), ["book_id", "item_no"], "full")
    counted = running(both, KEYS, "item_no", {
        "n_script": WholeSum(F.when(F.col("__s"), one).otherwise(0)),
        "n_tagged": WholeSum(F.when(F.col("__t"), one).otherwise(0))})
    same = F.col("n_script") == F.col("n_tagged")
    message = F.when(F.col("n_tagged") == 0, "No pre-processed emotion tags found").when(
        same, "Successfully applied pre-processed emotion tags").otherwise(F.format_string(
            "Line count mismatch: %d enhanced lines vs %d speaker-attributed lines",
            F.col("n_tagged"), F.col("n_script")))
    return counted.where(F.col("__s")).select(
        "book_id", "item_no", "speaker",
        F.when(same, F.col("__tag")).otherwise(F.col("__script")).alias("line"),
        (same & (F.col("n_tagged") > 0)).alias("applied"), message.alias("message"))


def map_back_to_script(script: DataFrame, tagged: DataFrame) -> DataFrame:
    """The k-th tagged line goes to the k-th non-blank script row; further lines are ignored."""
    filled = (~is_blank("line")).cast("bigint")
    ranked = running(script, KEYS, "item_no", {"__before": SumBefore(filled)}).withColumn(
        "__rank", F.when(~is_blank("line"), F.col("__before")))
    answers = tagged.select("book_id", F.col("line_no").alias("__rank"),
                            F.col("line").alias("__tag"))
    # Blank rows take no part in the join: they would all meet at the null rank.
    rows = ranked.where(F.col("__rank").isNotNull()).join(
        answers, ["book_id", "__rank"], "left").select(
        "book_id", "item_no", "speaker", F.coalesce("__tag", "line").alias("line"))
    return rows.unionByName(ranked.where(F.col("__rank").isNull()).select(
        "book_id", "item_no", "speaker", "line"))


def script_names(script: DataFrame) -> DataFrame:
    return script.select("book_id", F.col("speaker").alias("name")).distinct()


def unknown_speakers(script: DataFrame, characters: DataFrame, names: int = 5, samples: int = 2,
                     width: int = 60) -> DataFrame:
    """Speakers of the script that the registry lacks, with sample lines for the first ones.

    Samples are limited before the shuffle, so a busy speaker sends few rows.
    """
    missing = script_names(script).join(
        characters.select("book_id", "name"), ["book_id", "name"], "left_anti")
    order = Window.partitionBy("book_id").orderBy("name")
    shown = missing.withColumn("name_no", F.row_number().over(order)).where(
        F.col("name_no") <= names)
    nearest = Window.partitionBy("book_id", "name").orderBy("item_no")
    lines = script.select(
        "book_id", F.col("speaker").alias("name"), "item_no",
        F.when(F.length("line") > width, F.concat(F.substring("line", 1, width), F.lit("...")))
        .otherwise(F.col("line")).alias("sample")
    ).withColumn("sample_no", F.row_number().over(nearest)).where(F.col("sample_no") <= samples)
    return shown.join(lines, ["book_id", "name"]).select(
        "book_id", "name", "name_no", "sample_no", "sample")


def found_characters(characters: DataFrame) -> DataFrame:
    return characters.select("book_id", "name").distinct().where(~F.col("name").isin(SPECIAL))


def match_by_name(items: DataFrame, characters: DataFrame) -> DataFrame:
    """Speaker of a dialogue item: the one character named in the narration of its line.

    Names meet the narration as whole words. Only lines that hold dialogue are asked: each word of
    their narration, with the words after it, looks for names that begin with that word (an equi-join
    on book and word), and the rest of a name is compared in place.
    """
    def words(text):
        return F.filter(F.split(F.lower(text), rf"[^{WORD}]+", -1), lambda w: w != "")

    named = characters.where(~F.col("name").isin(SPECIAL)).select(
        "book_id", "name", words(F.col("name")).alias("__name")).where(F.size("__name") > 0)
    # One whole number: how many words the longest name has.
    longest = named.agg(F.max(F.size("__name"))).first()[0] or 1
    told = (F.col("type") == "narrator") & ~is_blank("content")
    lines = items.groupBy("book_id", "line_no").agg(
        F.collect_list(F.when(F.col("type") == "dialogue", F.struct("item_no"))).alias("__spoken"),
        F.collect_list(F.when(told, F.col("content"))).alias("__told")).where(F.size("__spoken") > 0)

    def runs(told_words):
        """Each word of an item with the words after it, as many as a name may have."""
        return F.transform(told_words, lambda w, i: F.slice(told_words, i + 1, longest))

    found = lines.select("book_id", "line_no", "__spoken", F.posexplode_outer(
        F.array_distinct(F.flatten(F.transform(F.transform("__told", words), runs)))).alias("__at", "__run")).select(
        "book_id", "line_no", "__run", F.col("__run")[0].alias("__first"),
        # One row of a line carries its items.
        F.when(F.coalesce("__at", F.lit(0)) == 0, F.col("__spoken")).alias("__spoken"))
    index = named.withColumnRenamed("book_id", "__book").withColumn("__start", F.col("__name")[0])
    whole = F.slice("__run", 1, F.size("__name")) == F.col("__name")
    hits = found.join(index, (F.col("book_id") == F.col("__book")) & (F.col("__first") == F.col("__start"))
                      & whole, "left")
    single = hits.groupBy("book_id", "line_no").agg(
        F.min("name").alias("lo"), F.max("name").alias("hi"),
        F.first("__spoken", ignorenulls=True).alias("__spoken"))
    speaker = F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise("unknown")
    return single.select("book_id", speaker.alias("speaker"), F.explode("__spoken").alias("__s")).select(
        "book_id", "__s.item_no", "speaker")


def check_matches(matches: DataFrame, characters: DataFrame) -> DataFrame:
    """Matches from outside; a speaker who is not of the book becomes `unknown`."""
    known = characters.select("book_id", F.col("name").alias("speaker"),
                              F.lit(True).alias("__known")).distinct()
    return matches.join(known, ["book_id", "speaker"], "left").select(
        "book_id", "item_no", F.when(F.col("speaker").isin(SPECIAL) | F.col("__known"),
                                     F.col("speaker")).otherwise("unknown").alias("speaker"))


def attribute(items: DataFrame, matches: DataFrame) -> DataFrame:
    """The script: narrator and blank items to the narrator, dialogue to its match."""
    told = (F.col("type") == "narrator") | is_blank("content")
    return items.join(matches, ["book_id", "item_no"], "left").select(
        "book_id", "item_no",
        F.when(told, "narrator").otherwise(F.coalesce("speaker", F.lit("unknown")))
        .alias("speaker"), F.col("content").alias("line"))


def first_usable_source(results: DataFrame) -> DataFrame:
    """Per book, the result of the first method in priority order that found something."""
    usable = F.col("result") != fixed.NO_RESULTS
    return results.groupBy("book_id").agg(F.coalesce(
        F.min_by(F.when(usable, F.col("result")), F.when(usable, F.col("priority"))),
        F.lit("unknown")).alias("result"))
