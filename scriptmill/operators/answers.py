"""Asking a model through a log of answers, so that no request is asked twice."""

import json
import uuid
from collections.abc import Callable, Iterator
from hashlib import sha256

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from scriptmill.session import stage

LOGGED = "digest string, response string"
ANSWERED = "digest string, response string, error string"


def request_digest(text, model: str) -> Column:
    """What an answer is kept under: the model's name and the whole text asked."""
    return F.sha2(F.concat(F.lit(f"{model}\n"), text), 256)


def _place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if ":" in path.split("/")[0] else f"file://{path}")


def _held(path: str) -> dict[str, str]:
    """Answers of a batch that an earlier attempt has written; none where there is no such file."""
    system, name = _place(path)
    if system.get_file_info(name).type != fs.FileType.File:
        return {}
    with system.open_input_stream(name) as stream:
        return json.loads(stream.read())


def _hold(path: str, answers: dict[str, str]) -> None:
    """Writes a batch's answers under another name first, so that a lost task leaves no half of a file."""
    system, name = _place(path)
    system.create_dir(name.rpartition("/")[0], recursive=True)
    part = f"{name}.{uuid.uuid4().hex}"
    with system.open_output_stream(part) as stream:
        stream.write(json.dumps(answers).encode())
    if system.get_file_info(name).type == fs.FileType.File:  # an attempt before this one had some answers
        system.delete_file(name)
    system.move(part, name)


def in_halves(fn: Callable[[list[str]], list[str]], texts: list[str]) -> list[tuple[str | None, str | None]]:
    """(answer, error) for each text. A call that fails is made again in halves, down to the failing texts."""
    try:
        answers = list(fn(texts))
        if len(answers) != len(texts):
            raise ValueError("one response per request expected")
        return [(a, None) for a in answers]
    except Exception as error:  # the caller's function may raise anything
        if len(texts) == 1:
            return [(None, f"{type(error).__name__}: {error}")]
        half = len(texts) // 2
        return in_halves(fn, texts[:half]) + in_halves(fn, texts[half:])


def _rows(spark: SparkSession, log: str) -> DataFrame:
    if _is_new(spark, log):
        return spark.createDataFrame([], LOGGED)
    return spark.read.schema(LOGGED).parquet(f"{log}/answers")


def _is_new(spark: SparkSession, log: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{log}/answers")
    return not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def logged_digests(spark: SparkSession, log: str) -> DataFrame:
    """digest: the requests that the log holds answers to, each once."""
    return _rows(spark, log).select("digest").distinct()


def logged(spark: SparkSession, log: str, digests: DataFrame | None = None) -> DataFrame:
    """digest, response: what the log holds, or of that the `digests`. A log that nobody has written to is empty."""
    rows = _rows(spark, log)
    if digests is not None:
        rows = rows.join(digests, "digest", "left_semi")
    # An append that was repeated gives an answer twice.
    return rows.groupBy("digest").agg(F.first("response").alias("response"))


def ask(requests: DataFrame, fn: Callable[[list[str]], list[str]], log: str, model: str = "model",
        text: str = "user_text", partitions: int = 64, batch_rows: int = 64) -> DataFrame:
    """`requests` with response and error; answers are kept in the shared folder `log` and never asked for again.

    Equal texts are asked once. `partitions` bounds the calls that run at once, `batch_rows` the texts of a call.
    Every batch is written to the log's `open` folder as soon as it is answered, under the digest of its
    requests. Requests reach tasks by hash and are sorted there, so that a task that runs again, after its
    executor or the whole application was lost, finds the same batches and asks only for those not written: at
    most one batch per task is asked twice. Answers of a finished run are appended to the log as one table.
    Errors are not kept: such requests are asked again by the next run. A null text gets no answer and an error.
    One application at a time writes to a log. No requests: no rows, no calls.
    """
    spark = requests.sparkSession
    keyed = requests.withColumn("__digest", request_digest(F.col(text), model))
    wanted = keyed.where("__digest is not null").select(F.col("__digest").alias("digest"), F.col(text).alias("text"))
    missing, known = wanted, None
    if not _is_new(spark, log):  # else no request is made just to find that its answer is not held
        # Of the log only what is asked for moves: digests first, then the answers of those found.
        held = logged_digests(spark, log)
        found = stage(held.join(wanted.select("digest"), "digest", "left_semi"), "answers-found")
        known = stage(logged(spark, log, found), "answers-known")
        missing = wanted.join(found, "digest", "left_anti")
    # Equal texts meet where they are asked, so that texts move once.
    missing = missing.repartition(partitions, "digest").groupBy("digest").agg(
        F.first("text").alias("text")).sortWithinPartitions("digest")

    def answer(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            asked, texts = frame.column("digest").to_pylist(), frame.column("text").to_pylist()
            responses, failures = [], []
            for start in range(0, len(asked), batch_rows):
                digests = asked[start:start + batch_rows]
                path = f"{log}/open/{sha256(' '.join(digests).encode()).hexdigest()}.json"
                held = _held(path)
                left = [(d, t) for d, t in zip(digests, texts[start:start + batch_rows], strict=True) if d not in held]
                errors = {}
                if left:
                    for (digest, _), (response, error) in zip(left, in_halves(fn, [t for _, t in left]), strict=True):
                        if error is None and response is not None:
                            held[digest] = response
                        else:
                            errors[digest] = error or "No response"
                    _hold(path, held)
                responses += [held.get(d) for d in digests]
                failures += [errors.get(d) for d in digests]
            yield pa.record_batch([pa.array(column, pa.string()) for column in (asked, responses, failures)],
                                  ["digest", "response", "error"])

    new = stage(missing.mapInArrow(answer, ANSWERED), "answers-new")
    good = new.where("response is not null").select("digest", "response")
    good.write.mode("append").option("compression", "zstd").parquet(f"{log}/answers")
    # What is open is now in the table.
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{log}/open")
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    both = new if known is None else known.withColumn("error", F.lit(None).cast("string")).unionByName(new)
    return keyed.join(both, F.col("__digest") == F.col("digest"), "left").select(
        *requests.columns, "response",
        F.when(F.col("__digest").isNull(), "No request").otherwise(F.col("error")).alias("error"))
