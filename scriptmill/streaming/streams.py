"""Line cleaning, registry state and progress over streams."""

import json
from collections.abc import Iterator
from types import SimpleNamespace

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from scriptmill.functions.clean import ascii_punct, close_quotes, is_only_punctuation
from scriptmill.functions.segment import speakable_parts
from scriptmill.functions.speech import prepare_for_tts
from scriptmill.operators.registry import REGISTRY, Roster, clean_names
from scriptmill.session import new_path


def run_available(stream: DataFrame, label: str) -> DataFrame:
    """Runs a stream over what is there now into files and reads them."""
    spark = stream.sparkSession
    path = new_path(spark, label)
    (stream.writeStream.format("parquet").outputMode("append")
        .option("checkpointLocation", path + "-state").option("path", path)
        .trigger(availableNow=True).start().awaitTermination())
    return spark.read.schema(stream.schema).parquet(path)


def table_stream(spark: SparkSession, path: str, files_per_trigger: int = 64) -> DataFrame:
    """A parquet table, a folder or a single file, as a stream of its files.

    A stream takes a single file only by way of a glob, so the last letter is made one.
    """
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option(
        "maxFilesPerTrigger", files_per_trigger).parquet(f"{path[:-1]}[{path[-1]}]")


def clean_line_stream(lines: DataFrame) -> DataFrame:
    """Cleaned, prepared and spoken parts of a stream of lines. Without state, so a batch of the
    same lines gives the same rows."""
    # Nothing but punctuation stays so through all later rules; asking first keeps the filter
    # off the prepared text, which it would otherwise have made twice.
    worded = lines.withColumn("line", ascii_punct("line")).where(~is_only_punctuation("line"))
    ready = prepare_for_tts(worded.withColumn("line", close_quotes("line")), "line", "line")
    keys = [c for c in lines.columns if c != "line"]
    return ready.select(*keys, F.explode(speakable_parts("line")).alias("part")).select(
        *keys, "part.*")


CHANGES = REGISTRY + ", revision long, removed boolean, late boolean"
CHANGE_COLUMNS = [part.split()[0] for part in CHANGES.split(", ")]
OP_COLUMNS = ["batch_no", "op_no", "operation", "name", "existing_name", "age", "gender", "description"]


def _apply_ops(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The state is the registry before the newest batch, that batch's operations so far, and what was told last."""
    settled, told = Roster(), Roster()
    settled.seed()
    newest, held, revision = None, [], 0
    if state.exists:
        known, changed, newest, held, told.known, revision = json.loads(state.get[0])
        settled.known, settled.changed = {n: tuple(v) for n, v in known.items()}, changed
        told.known = {n: tuple(v) for n, v in told.known.items()}
    ops = pd.concat([f[OP_COLUMNS] for f in frames]).astype(object)
    ops = [dict(zip(OP_COLUMNS, row, strict=True)) for row in ops.where(ops.notna(), None).itertuples(index=False)]
    late = [op for op in ops if newest is not None and op["batch_no"] < newest]
    held += [op for op in ops if newest is None or op["batch_no"] >= newest]
    held.sort(key=lambda op: (op["batch_no"], op["op_no"]))
    newest = held[-1]["batch_no"] if held else newest
    for op in held:
        if op["batch_no"] < newest:
            settled.add(SimpleNamespace(**op))
    settled.flush()
    held = [op for op in held if op["batch_no"] == newest]
    now = Roster()
    now.known, now.changed = dict(settled.known), dict(settled.changed)
    for op in held:
        now.add(SimpleNamespace(**op))
    now.flush()
    revision += len(ops)
    state.update((json.dumps([settled.known, settled.changed, newest, held, now.known, revision], default=int),))
    rows = [r | {"removed": False, "late": False} for r in now.rows(book_id=key[0])
            if told.known.get(r["name"]) != now.known[r["name"]]]
    rows += [{"book_id": key[0], "name": n, "seen_batch": v[3], "seen_op": v[4], "last_batch": newest, "removed": True,
              "late": False} for n, v in told.known.items() if n not in now.known]
    rows += [{"book_id": key[0], "name": op["name"], "description": json.dumps(op, default=int), "last_batch": op["batch_no"],
              "seen_op": op["op_no"], "removed": False, "late": True} for op in late]
    yield pd.DataFrame(rows, columns=CHANGE_COLUMNS).assign(revision=revision)


def char_ops_stream(ops: DataFrame) -> DataFrame:
    """Registry changes per book as operations arrive.

    A book's batches must arrive in order; a batch may come in pieces. Its operations are held until one of
    a higher batch_no arrives, and every trigger tells the registry as it is with those so far, so the result does
    not depend on how files fall into triggers. Operations of an older batch change nothing and are told as `late`
    rows, the operation as JSON in `description`. A task holds one book's registry and one trigger's operations on it.
    """
    return clean_names(ops).groupBy("book_id").applyInPandasWithState(
        _apply_ops, CHANGES, "roster string", "append", GroupStateTimeout.NoTimeout)


def latest_registry(changes: DataFrame) -> DataFrame:
    """The registry that a log of changes amounts to."""
    values = F.struct(*[c for c in changes.columns if c not in ("book_id", "name")])
    return changes.where("not late").groupBy("book_id", "name").agg(
        F.max_by(values, "revision").alias("v")).select("book_id", "name", "v.*").where(
        ~F.col("removed")).drop("removed", "revision", "late")


def late_ops(changes: DataFrame) -> DataFrame:
    """Operations that came after a newer batch of their book: book_id, batch_no, op_no, operation (JSON)."""
    return changes.where("late").select("book_id", F.col("last_batch").alias("batch_no"), F.col("seen_op").alias("op_no"),
                                        F.col("description").alias("operation"))


def progress_counts(lines: DataFrame) -> DataFrame:
    """Completed lines per book, for sinks that take updates."""
    return lines.groupBy("book_id").agg(F.count(F.lit(1)).alias("completed"))


def progress_log(lines: DataFrame, label: str = "progress") -> DataFrame:
    """Completed lines per book after every trigger of what is there now, as a table.

    Spark keeps the counts; each trigger's updates are appended under its number, and a repeated trigger overwrites.
    """
    spark = lines.sparkSession
    path = new_path(spark, label)

    def write(updates: DataFrame, batch: int) -> None:
        updates.write.mode("overwrite").parquet(f"{path}/trigger={batch}")

    (progress_counts(lines).writeStream.outputMode("update").option("checkpointLocation", path + "-state")
        .foreachBatch(write).trigger(availableNow=True).start().awaitTermination())
    return spark.read.schema("book_id string, completed long").parquet(f"{path}/trigger=*")
