"""Greedy token budgets: chunks that stay under a limit and batches that reach a minimum.

Where a group ends depends on where it began, so the rule is a fold in line order. A fold over
a whole book would be one task. Here each block of rows is folded on its own, given the state
(the tokens of the still open group) it is entered with:

1. a block's transfer table says for every entry state which state it is left in; with a
   forced group start inside, that is one state whatever the entry;
2. tables are composed up a tree of fixed fan-in, and entry states are handed down it again, which
   gives every block its own;
3. every block is cut once from its entry state, and the pieces of a group that crosses a block
   edge are put together by an aggregation.

Steps 1 and 3 see arrays of token counts, never text, and use prefix sums: Spark's own array
functions have no running fold that does not copy what it has gathered at every step.
"""

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from scriptmill.functions.chars import is_blank
from scriptmill.functions.tokens import token_count
from scriptmill.operators.ordered import BLOCK, RunningSum, block_of, running
from scriptmill.session import stage

FOLD_ROWS = 1 << 11  # rows of one block; arrays never grow past this
FAN_IN = 64          # tables composed in one step

# States of the open group, as places in a transfer table:
# 0 = no open group, 1 + n = an open group of n tokens, the last = over the limit.


class Chunks:
    """A group closes before the row that would take it over `limit`."""

    def __init__(self, limit: int):
        self.limit = limit
        self.top = limit + 1  # tokens of an open group, from here on all alike

    def next_starts(self, sums: np.ndarray) -> np.ndarray:
        """For a group that starts at each row, the row the next one starts at; past the rows
        if it is still open at their end."""
        n = len(sums) - 1
        fits = np.searchsorted(sums, sums[:n] + self.limit, side="right") - 1
        after = np.maximum(fits, np.arange(1, n + 1))
        return np.where(after >= n, n + 1, after)

    def entered(self, sums: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        """The same for groups that are entered open, by the tokens they have."""
        n = len(sums) - 1
        after = np.searchsorted(sums[1:], self.limit - tokens, side="right")
        after = np.where(tokens > self.limit, 0, after)
        return np.where(after >= n, n + 1, after)


class Batches:
    """A group closes after the row that takes it to `minimum` or more."""

    def __init__(self, minimum: int):
        self.minimum = minimum
        self.top = minimum - 1

    def next_starts(self, sums):
        n = len(sums) - 1
        return np.maximum(np.searchsorted(sums, sums[:n] + self.minimum, side="left"),
                          np.arange(1, n + 1))

    def entered(self, sums, tokens):
        return np.searchsorted(sums[1:], self.minimum - tokens, side="left") + 1


def _sums(tokens) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(np.asarray(tokens, dtype=np.int64))])


def exit_states(rule, tokens, breaks, closed: bool) -> np.ndarray:
    """A block's transfer table. `breaks` are rows a group must start at; `closed` says that the
    group of the last row ends with it."""
    sums = _sums(tokens)
    n, states = len(sums) - 1, rule.top + 2
    if closed:
        return np.zeros(states, dtype=np.int32)
    nxt = rule.next_starts(sums)
    # A group that is open at the end points at itself; jumps double until all arrive.
    last = np.append(np.where(nxt > n, np.arange(n), nxt), n)
    while not np.array_equal(last[last], last):
        last = last[last]

    def opened(start):
        """State left by the chain of groups from `start`; n means none is open."""
        begin = last[np.minimum(start, n)]
        return np.where(begin >= n, 0, np.minimum(sums[n] - sums[begin], rule.top) + 1)

    if len(breaks):
        return np.full(states, opened(breaks[-1]), dtype=np.int32)
    held = np.arange(rule.top + 1)
    after = rule.entered(sums, held)
    still_open = np.minimum(held + sums[n], rule.top) + 1
    return np.append(opened(0), np.where(after > n, still_open, opened(after))).astype(np.int32)


def group_starts(rule, tokens, breaks, entry: int) -> list[int]:
    """Rows of a block that groups start at, from its entry state."""
    sums = _sums(tokens)
    n = len(sums) - 1
    nxt = rule.next_starts(sums)
    forced = np.full(n + 1, n + 1)
    forced[np.asarray(breaks, dtype=np.int64)] = breaks
    # First break at or after each row; a group ends at the one after its own start.
    forced = np.minimum.accumulate(forced[::-1])[::-1]
    nxt = np.minimum(nxt, forced[1:]).tolist()
    at = 0 if entry == 0 else min(int(rule.entered(sums, np.array([entry - 1]))[0]),
                                  int(forced[0]))
    starts = []
    while at < n:
        starts.append(at)
        at = nxt[at]
    return starts


def narrowed(table: np.ndarray) -> np.ndarray:
    """A table as runs of states that are left alike or one after another: their first states, the states these are
    left in, and steps of 0 or 1. Groups soon close alike however they were entered, so there are few."""
    rise = np.diff(table)
    straight = (rise == 0) | (rise == 1)
    straight[1:] &= rise[1:] == rise[:-1]
    first = np.flatnonzero(np.append(True, ~straight))
    step = np.append(rise, 0)[first]
    step[np.diff(np.append(first, len(table))) == 1] = 0
    return np.concatenate([first, table[first], step]).astype(np.int32)


def widened(runs: np.ndarray, states: int) -> np.ndarray:
    """The whole table of `narrowed`."""
    first, to, step = np.asarray(runs).reshape(3, -1)
    run = np.repeat(np.arange(len(first)), np.diff(np.append(first, states)))
    return to[run] + step[run] * (np.arange(states) - first[run])


def left_in(runs: np.ndarray, state: int) -> int:
    """The state that `state` is left in."""
    first, to, step = np.asarray(runs).reshape(3, -1)
    run = np.searchsorted(first, state, side="right") - 1
    return int(to[run] + step[run] * (state - first[run]))


def _pack(rows: DataFrame, keys) -> DataFrame:
    """One row per block: its positions and counts in order, and where groups must start."""
    ordered = F.sort_array(F.collect_list(F.struct("pos", "tokens", "opens", "ends")))
    packed = rows.groupBy(*keys, BLOCK).agg(ordered.alias("rows"))
    places = F.sequence(F.lit(0), F.size("rows") - 1)
    must_start = F.filter(places, lambda i: F.get("rows", i)["opens"] | F.coalesce(
        F.get("rows", i - 1)["ends"], F.lit(False)))
    return packed.select(
        *keys, BLOCK, F.transform("rows", lambda r: r["pos"]).alias("pos"),
        F.transform("rows", lambda r: r["tokens"]).alias("tokens"),
        must_start.alias("breaks"), F.element_at("rows", -1)["ends"].alias("closed"))


def _transfer(packed: DataFrame, keys, rule) -> DataFrame:
    """keys, BLOCK, table: the exit state for every entry state, narrowed."""
    @F.pandas_udf("array<int>")
    def tables(tokens: pd.Series, breaks: pd.Series, closed: pd.Series) -> pd.Series:
        return pd.Series([narrowed(exit_states(rule, *row)) for row in zip(tokens, breaks, closed)])

    return packed.select(*keys, BLOCK, tables("tokens", "breaks", "closed").alias("table"))


def _entry_states(transfer: DataFrame, keys, rule) -> DataFrame:
    """keys, BLOCK, entry: the state every block is entered with.

    Up the tree, FAN_IN neighbouring tables become one; down it, each of them is told its entry. No row holds more than
    FAN_IN tables, whatever the length of a book; a level has FAN_IN times fewer rows than the one below.
    """
    states, top = rule.top + 2, transfer.agg(F.max(BLOCK)).first()[0] or 0

    @F.pandas_udf("array<int>")
    def composed(tables: pd.Series) -> pd.Series:
        out = []
        for own in tables:
            whole = np.arange(states)
            for runs in own:
                whole = widened(runs, states)[whole]
            out.append(narrowed(whole))
        return pd.Series(out)

    @F.pandas_udf("array<int>")
    def entered(tables: pd.Series, first: pd.Series) -> pd.Series:
        out = []
        for own, state in zip(tables, first):
            passed = [int(state)]
            for runs in own[:-1]:
                passed.append(left_in(runs, passed[-1]))
            out.append(passed)
        return pd.Series(out)

    level, spans = transfer.withColumnRenamed(BLOCK, "at"), []
    ordered = F.sort_array(F.collect_list(F.struct(F.col("at"), F.col("table"))))
    while True:
        grouped = level.groupBy(*keys, block_of("at", FAN_IN).alias("span")).agg(ordered.alias("seq"))
        spans.append(stage(grouped, "spans"))
        top //= FAN_IN
        if not top:
            break
        level = spans[-1].select(*keys, F.col("span").alias("at"), composed("seq.table").alias("table"))
    entries = spans[-1].select(*keys, "span", F.lit(0).alias("entry"))
    for grouped in reversed(spans):
        told = grouped.join(entries, [*keys, "span"]).select(*keys, F.explode(F.arrays_zip(
            F.col("seq.at").alias("span"), entered("seq.table", "entry").alias("entry"))).alias("e"))
        entries = told.select(*keys, "e.span", "e.entry")
    return entries.withColumnRenamed("span", BLOCK)


def _pieces(packed: DataFrame, keys, rule) -> DataFrame:
    """One row per group and block: first and last position, rows, tokens, and whether the
    group starts here."""
    @F.pandas_udf("array<int>")
    def cuts(tokens: pd.Series, breaks: pd.Series, entry: pd.Series) -> pd.Series:
        return pd.Series([group_starts(rule, *row) for row in zip(tokens, breaks, entry)])

    cut = packed.withColumn("starts", cuts("tokens", "breaks", "entry"))
    # The head of the block, where it belongs to a group that was open before.
    head = F.when((F.size("starts") == 0) | (F.get("starts", F.lit(0)) > 0),
                  F.array(F.lit(0))).otherwise(F.array().cast("array<int>"))
    edged = cut.withColumn("edges", F.concat(head, "starts")).withColumn("headed", F.size(head))

    def piece(lo, nth):
        hi = F.coalesce(F.get("edges", nth + 1), F.size("pos"))
        counts = F.slice("tokens", lo + 1, hi - lo)
        return F.struct(
            F.get("pos", lo).alias("first"), F.get("pos", hi - 1).alias("last"),
            (hi - lo).cast("bigint").alias("rows"),
            F.aggregate(counts, F.lit(0).cast("bigint"), lambda a, t: a + t).alias("tokens"),
            (nth >= F.col("headed")).cast("bigint").alias("starts"))

    # Made inside the array: a row for each piece would hold a copy of its whole block.
    return edged.select(*keys, F.explode(F.transform("edges", piece)).alias("p")).select(
        *keys, "p.first", "p.last", "p.rows", "p.tokens", "p.starts")


def _group(df: DataFrame, keys: Sequence[str], pos: str, tokens: Column, rule, number: str,
           opens: Column | None, ends: Column | None) -> DataFrame:
    keys = list(keys)
    no = F.lit(False)
    narrow = df.select(
        *keys, F.col(pos).alias("pos"), tokens.cast("bigint").alias("tokens"),
        F.coalesce(no if opens is None else opens, no).alias("opens"),
        F.coalesce(no if ends is None else ends, no).alias("ends"),
        block_of(pos, FOLD_ROWS).alias(BLOCK))
    # Four passes below read these rows: positions, counts and flags, without the text.
    packed = stage(_pack(narrow, keys), "budget")
    entry = _entry_states(_transfer(packed, keys, rule), keys, rule)
    pieces = stage(_pieces(packed.join(entry, [*keys, BLOCK]), keys, rule), "pieces")
    numbered = running(pieces, keys, "first", {number: RunningSum(F.col("starts"))})
    return numbered.groupBy(*keys, number).agg(
        F.min("first").alias("start_line"), (F.max("last") + 1).alias("end_line"),
        F.sum("rows").alias("line_count"), F.sum("tokens").alias("tokens"),
    ).withColumn(number, (F.col(number) - 1).cast("bigint"))


def chunk_by_tokens(df: DataFrame, keys: Sequence[str], pos: str, text: str,
                    max_tokens: int = 500, tokens: Column | None = None,
                    opens: Column | None = None) -> DataFrame:
    """Chunks of at most `max_tokens`; a blank line ends its chunk, a longer line is one alone.

    `opens` marks rows a new chunk must begin at, such as the first line of a window.
    """
    count = token_count(text) if tokens is None else tokens
    return chunk_counted(df, keys, pos, count, is_blank(text), max_tokens, opens)


def chunk_counted(df: DataFrame, keys: Sequence[str], pos: str, tokens: Column, blank: Column, max_tokens: int = 500,
                  opens: Column | None = None) -> DataFrame:
    """`chunk_by_tokens` of rows that need not hold their text."""
    return _group(df, keys, pos, tokens, Chunks(max_tokens), "chunk_no", opens, blank)


def batch_by_tokens(df: DataFrame, keys: Sequence[str], pos: str, text: str,
                    min_tokens: int = 2000, tokens: Column | None = None) -> DataFrame:
    """Batches closed by the item that takes them to `min_tokens`; blank items are skipped."""
    count = token_count(text) if tokens is None else tokens
    return _group(df.where(~is_blank(text)), keys, pos, count, Batches(min_tokens), "batch_no",
                  None, None)


def average_tokens(groups: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Number of groups and average tokens of each, rounded to one digit, per key."""
    return groups.groupBy(*keys).agg(F.count("*").alias("n_groups"), F.round(F.avg("tokens"), 1).alias("average_tokens"))


def group_text(df: DataFrame, groups: DataFrame, keys: Sequence[str], pos: str, text: str,
               number: str, extra: Sequence[str] = ()) -> DataFrame:
    """The groups with their lines joined by newlines; a group's size is bounded by its budget.

    The listed positions are as many as the lines, which Spark, seeing the groups they come from, takes for few:
    unhinted it would send all of them through the driver as a broadcast.
    """
    members = groups.select(
        *keys, number, *extra, "tokens", "start_line", "end_line",
        F.explode(F.sequence("start_line", F.col("end_line") - 1)).alias(pos)).hint("merge")
    ordered = F.sort_array(F.collect_list(F.struct(F.col(pos), F.col(text).alias("text"))))
    by = [*keys, number, *extra, "tokens", "start_line", "end_line"]
    return (members.join(df.select(*keys, pos, text), [*keys, pos])
            .groupBy(*by).agg(ordered.alias("__m"))
            .select(*by, F.array_join(F.transform("__m", lambda m: m["text"]), "\n")
                    .alias("text")))
