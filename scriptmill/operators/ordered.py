"""Ordered computations over one book that never put a whole book into one task.

A book's rows are cut into blocks by position (`pos div block_rows`). What a row needs from
earlier blocks is carried by a table with one row per block; what it needs from its own block
is a window inside that block. One book may hold a third of all rows: its blocks still spread
over the cluster, and only the block table (rows / block_rows) is ordered per book.
Keys and positions must not be null.
"""

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from scriptmill.functions.chars import column

BLOCK = "__block"
BLOCK_ROWS = 1 << 16


def block_of(pos, block_rows: int = BLOCK_ROWS) -> Column:
    return F.floor(column(pos) / F.lit(block_rows)).cast("bigint")


@dataclass(frozen=True)
class Spec:
    value: Column


class RunningSum(Spec):
    """Sum over this row and all before it."""

    def summary(self, v, pos):
        return F.sum(v)

    def carried(self, s, before: WindowSpec, whole: WindowSpec):
        return F.coalesce(F.sum(s).over(before), F.lit(0))

    def result(self, v, carry, upto: WindowSpec, earlier: WindowSpec):
        return carry + F.coalesce(F.sum(v).over(upto), F.lit(0))


class SumBefore(RunningSum):
    """Sum over the rows before this one."""

    def result(self, v, carry, upto, earlier):
        return carry + F.coalesce(F.sum(v).over(earlier), F.lit(0))


class Latest(Spec):
    """Last non-null value at or before this row."""

    def summary(self, v, pos):
        return F.max_by(v, F.when(v.isNotNull(), pos))

    def carried(self, s, before, whole):
        return F.last(s, ignorenulls=True).over(before)

    def result(self, v, carry, upto, earlier):
        return F.coalesce(F.last(v, ignorenulls=True).over(upto), carry)


class LatestMark(Latest):
    """`Latest` for texts that few rows have.

    The block table lists a block's marks. Text cannot be kept in a hash aggregation's buffer,
    so the plain form would sort every row on its way to the block table.
    """

    def summary(self, v, pos):
        return F.collect_list(F.when(v.isNotNull(), F.struct(pos.alias("pos"), v.alias("mark"))))

    def carried(self, s, before, whole):
        return F.last(F.array_max(s)["mark"], ignorenulls=True).over(before)


class Previous(Latest):
    """Last non-null value before this row."""

    def result(self, v, carry, upto, earlier):
        return F.coalesce(F.last(v, ignorenulls=True).over(earlier), carry)


class WholeSum(Spec):
    """Sum over all rows of the key."""

    def summary(self, v, pos):
        return F.sum(v)

    def carried(self, s, before, whole):
        return F.sum(s).over(whole)

    def result(self, v, carry, upto, earlier):
        return carry


def _placed(df, pos, specs, block_rows):
    first = pos if isinstance(pos, str) else pos[0]
    return df.withColumn(BLOCK, block_of(first, block_rows)).withColumns(
        {f"__v_{name}": spec.value for name, spec in specs.items()})


def block_summary(df: DataFrame, keys: Sequence[str], pos: str | Sequence[str],
                  specs: dict[str, Spec], block_rows: int = BLOCK_ROWS,
                  **more: Column) -> DataFrame:
    """The block table of `running`: keys, BLOCK, a column `__s_<name>` per spec, and `more`
    aggregates. To be given to `running` where it is needed for something else too."""
    place = F.col(pos) if isinstance(pos, str) else F.struct(*pos)
    return _placed(df, pos, specs, block_rows).groupBy(*keys, BLOCK).agg(*[
        spec.summary(F.col(f"__v_{name}"), place).alias(f"__s_{name}")
        for name, spec in specs.items()], *[agg.alias(name) for name, agg in more.items()])


def running(df: DataFrame, keys: Sequence[str], pos: str | Sequence[str], specs: dict[str, Spec],
            block_rows: int = BLOCK_ROWS, summary: DataFrame | None = None) -> DataFrame:
    """Adds one column per spec, computed over each key's rows in `pos` order.

    With several order columns, blocks are cut by the first one.
    """
    order = [pos] if isinstance(pos, str) else list(pos)
    at = [*keys, BLOCK]
    if summary is None:
        summary = block_summary(df, keys, pos, specs, block_rows)
    whole = Window.partitionBy(*keys)
    before = whole.orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    carry = summary.select(*at, *[
        spec.carried(F.col(f"__s_{name}"), before, whole).alias(f"__c_{name}")
        for name, spec in specs.items()])
    inside = Window.partitionBy(*at).orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    joined = _placed(df, pos, specs, block_rows).join(carry, at)
    return joined.select(*df.columns, *[
        spec.result(F.col(f"__v_{name}"), F.col(f"__c_{name}"), upto, earlier).alias(name)
        for name, spec in specs.items()])


def number_rows(df: DataFrame, keys: Sequence[str], pos: str, out: str, start: int = 0,
                block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Dense numbers in `pos` order."""
    numbered = running(df, keys, pos, {out: SumBefore(F.lit(1).cast("bigint"))}, block_rows)
    return numbered if start == 0 else numbered.withColumn(out, F.col(out) + start)


HOME = "__home"


def with_neighbours(df: DataFrame, pos: str, before: int, after: int,
                    block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Copies the rows near a block's edge into the neighbouring block.

    Windows over (keys, BLOCK) then see `before` rows back and `after` rows ahead; keep the
    rows with HOME afterwards. Positions must be dense and the reach at most one block.
    """
    if max(before, after) > block_rows:
        raise ValueError("a row may reach no further than one block")
    home = block_of(pos, block_rows)
    reach = F.array_distinct(F.array(
        home, block_of(F.col(pos) - after, block_rows), block_of(F.col(pos) + before, block_rows)))
    return (df.withColumn(BLOCK, F.explode(F.filter(reach, lambda b: b >= 0)))
            .withColumn(HOME, F.col(BLOCK) == home))
