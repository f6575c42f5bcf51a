"""Voices: the fixed voice table and the casting of narration and speakers."""

import json

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from scriptmill import fixed
from scriptmill.functions.chars import column

VOICE_MAP = json.dumps({
    engine: {
        **{f"{g}_narrator": fixed.VOICE_PAIRS[engine, g][0] for g in fixed.NARRATOR_GENDERS},
        **{f"{g}_dialogue": fixed.VOICE_PAIRS[engine, g][1] for g in fixed.NARRATOR_GENDERS},
        **{f"{g}_score_map": {str(i): v for i, v in enumerate(fixed.VOICE_SCORES[engine, g])}
           for g in fixed.NARRATOR_GENDERS},
    } for engine in sorted({engine for engine, _ in fixed.VOICE_PAIRS})})


def load_voices(spark: SparkSession, voice_map: str = VOICE_MAP) -> DataFrame:
    """Score rows of a voice map: engine, narrator_gender, score, voice."""
    engines = spark.createDataFrame([(voice_map,)], "doc string").select(
        F.explode(F.from_json("doc", "map<string,struct<male_score_map map<string,string>,"
                                     "female_score_map map<string,string>>>")))
    maps = engines.select(F.col("key").alias("engine"), F.explode(F.create_map(
        F.lit("male"), F.col("value.male_score_map"),
        F.lit("female"), F.col("value.female_score_map"))).alias("narrator_gender", "scores"))
    return maps.select("engine", "narrator_gender", F.explode("scores").alias("score", "voice"))


def load_voice_pairs(spark: SparkSession, voice_map: str = VOICE_MAP) -> DataFrame:
    """engine, narrator_gender, narrator_voice, dialogue_voice."""
    fields = ", ".join(f"{g}_{part}:string" for g in fixed.NARRATOR_GENDERS
                       for part in ("narrator", "dialogue"))
    engines = spark.createDataFrame([(voice_map,)], "doc string").select(
        F.explode(F.from_json("doc", f"map<string,struct<{fields}>>")))
    pairs = F.array(*[
        F.struct(F.lit(g).alias("narrator_gender"),
                 F.col(f"value.{g}_narrator").alias("narrator_voice"),
                 F.col(f"value.{g}_dialogue").alias("dialogue_voice"))
        for g in fixed.NARRATOR_GENDERS])
    return engines.select(F.col("key").alias("engine"), F.explode(pairs).alias("p")).select(
        "engine", "p.*")


def require_engine(df: DataFrame, engine: str = "engine", voice_map: str = VOICE_MAP) -> DataFrame:
    """Fails the job when a row names an engine without voices."""
    known = sorted(json.loads(voice_map))
    good = F.coalesce(F.col(engine).isin(known), F.lit(False))
    message = F.concat(F.lit("no voices for engine: "), F.coalesce(F.col(engine), F.lit("null")))
    return df.withColumn(engine, F.when(good, F.col(engine)).otherwise(
        F.raise_error(message).cast("string")))


def _voices(voice_map: str, engine: str, gender: str) -> tuple[dict, str]:
    """The engine's part of a voice map (a small JSON text), and the narrator's gender there."""
    engines = json.loads(voice_map)
    if engine not in engines:
        raise ValueError(f"no voices for engine: {engine}")
    return engines[engine], "male" if gender == "male" else "female"


def voice_of_score(score, engine: str, gender: str, voice_map: str = VOICE_MAP) -> Column:
    """Voice of a gender score; a score without one gets that of score 0, the narrator's."""
    known, narrator = _voices(voice_map, engine, gender)
    scores = known[f"{narrator}_score_map"]
    table = F.create_map(*[F.lit(x) for pair in scores.items() for x in pair])
    return F.coalesce(F.try_element_at(table, column(score).cast("string")), F.lit(scores["0"]))


def assign_voice_multi(script: DataFrame, characters: DataFrame, engine: str,
                       gender: str, voice_map: str = VOICE_MAP) -> DataFrame:
    """Adds `voice` by the speaker's gender score: narrator 0, speakers without a score 5.

    The voice map is a literal inside the expression. The one join is on (book, name);
    narrator rows, the bulk of a script, do not take part in it. A roster small enough is
    broadcast by its measured size, and otherwise AQE splits the rows of one busy speaker.
    """
    name = F.lower("speaker")
    narrator = F.coalesce(name == "narrator", F.lit(False))
    scores = characters.select("book_id", F.col("name").alias("__name"),
                               F.col("gender_score").alias("__score"))
    cast = script.where(~narrator).withColumn("__name", name).join(
        scores, ["book_id", "__name"], "left").select(
        *script.columns,
        voice_of_score(F.coalesce("__score", F.lit(fixed.NEUTRAL_SCORE)), engine, gender, voice_map)
        .alias("voice"))
    told = script.where(narrator).withColumn("voice", voice_of_score(F.lit(0), engine, gender, voice_map))
    return told.unionByName(cast)


def assign_voice_single(parts: DataFrame, engine: str, gender: str, voice_map: str = VOICE_MAP) -> DataFrame:
    """Adds `voice`: one voice for narration, one for dialogue."""
    known, gender = _voices(voice_map, engine, gender)
    narrator, dialogue = known[f"{gender}_narrator"], known[f"{gender}_dialogue"]
    return parts.withColumn(
        "voice", F.when(F.col("type") == "narration", narrator).otherwise(dialogue))


def voice_combinations(voices: DataFrame, most: int = 500) -> DataFrame:
    """All voices, then all unordered pairs of them joined by `+`.

    `voices` (pos, voice) is a synthesis engine's own list, of at most `most` voices; a longer one fails
    the job. Each pair is made in the row of its first voice, from one sorted list.
    """
    few = voices.limit(most + 1).agg(F.sort_array(F.collect_list(F.struct("pos", "voice"))).alias("all"))
    listed = few.select(F.when(F.size("all") <= most, F.col("all")).otherwise(
        F.raise_error(F.lit(f"more than {most} voices")).cast(few.schema["all"].dataType)).alias("all"))
    paired = listed.select(F.explode("all").alias("v"), "all").select(
        F.col("v.voice").alias("a"),
        F.explode(F.filter("all", lambda o: o["pos"] > F.col("v.pos"))).alias("o"))
    return voices.select("voice").unionByName(
        paired.select(F.concat("a", F.lit("+"), "o.voice").alias("voice")))
