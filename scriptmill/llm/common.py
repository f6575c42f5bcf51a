"""What several operators share: reading tables, text columns, the training split."""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from scriptmill.session import passing, stage

__all__ = ["ascii_lower", "bounded", "few", "held_out", "let", "passing", "stage", "table"]

#: tables of at most so many narrow rows (some 40 bytes each) are broadcast, larger ones joined by a shuffle
BROADCAST_ROWS = 500_000
#: narrow rows that a task takes at least, where a count of them is known
TASK_ROWS = 20_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, everything else as it is."""
    return F.translate(text, UPPER, LOWER)


def held_out(doc_id: Column) -> Column:
    """Rows no model may learn from; a null id counts as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def let(value: Column, body) -> Column:
    """`body(value)` with `value` computed once, even where `body` refers to it inside a lambda."""
    return F.transform(F.array(value), body)[0]


def bounded(df: DataFrame, weight: Column | None = None) -> DataFrame:
    """A staged table for a join: broadcast where a count proves that it is small, else joined by a shuffle.

    `weight` says how many narrow rows a row with arrays or texts counts for.
    """
    if weight is None:
        rows = df.limit(BROADCAST_ROWS + 1).count()
    else:
        rows = df.agg(F.coalesce(F.sum(weight), F.lit(0))).first()[0]
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def few(df: DataFrame, rows: int) -> DataFrame:
    """`df` in tasks of no fewer than TASK_ROWS of its some `rows` narrow rows, however many partitions a shuffle has."""
    return df.coalesce(rows // TASK_ROWS + 1)
