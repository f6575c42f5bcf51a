"""Prefix trie of conversations, by vertical bitmaps.

Conversations are cut into segments of SEGMENT turns, and segments dealt, in order of conv_id, into shards of some
SHARD_ROWS turns. A shard indexes (position, turn) to bitsets of its conversations; a depth-first walk intersects the
bitset of a node with the postings of the next position, which gives its children, their popcounts and those that end
there. Shards are then summed up by node. A node's key is the XOR of two 64-bit hashes of (position, turn) over its
turns, so that a segment knows the nodes that it starts from.
"""

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from scriptmill.llm.common import stage, table
from scriptmill.operators.ordered import RunningSum, SumBefore, WholeSum, running

SEGMENT = 256
SHARD_ROWS = 16_384
#: conversation ids in one row of a node's list of ends
ENDS_A_ROW = 256
KEY = ["k1", "k2"]
SHARD_NODE = ("k1 long, k2 long, p1 long, p2 long, depth long, n long, first long, chars long, n_ends long, "
              "ends array<long>")


class RunningXor(RunningSum):
    """XOR over this row and all before it."""

    def summary(self, v, pos):
        return F.bit_xor(v)

    def carried(self, s, before, whole):
        return F.coalesce(F.bit_xor(s).over(before), F.lit(0))

    def result(self, v, carry, upto, earlier):
        return carry.bitwiseXOR(F.bit_xor(v).over(upto))


def ordered_turns(df: DataFrame) -> DataFrame:
    """conv_id, pos, role, text, turn_key of all rows with a conv_id.

    Turns are numbered from 0 in order of `turn`, nulls first, and of equal turns by role and text; null roles and texts
    are empty. Repeated rows are turns of their own. turn_key is a 128-bit digest of role and text.
    """
    named = df.where("conv_id is not null").select(
        "conv_id", F.coalesce(F.col("turn").cast("long"), F.lit(-2**63)).alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    numbered = running(named, ["conv_id"], ["turn", "role", "text"], {"pos": SumBefore(F.lit(1).cast("long"))})
    whole = F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")
    return numbered.select("conv_id", "pos", "role", "text", F.unhex(F.md5(whole.cast("binary"))).alias("turn_key"))


def rebuilt(turns: DataFrame, share: Column, head: Column, most: int) -> DataFrame:
    """conv_id, pos, turn_key, chars of conversations whose first `share` turns (at most `most`) are those of conversation
    `head`: of all that it has, if fewer, and none if it is absent. Conversations left without a turn have one row with
    pos null.

    `turns` must be staged. Only first turns of heads move to other conversations.
    """
    convs = turns.groupBy("conv_id").agg(F.count("*").alias("_n")).select(
        "conv_id", "_n", share.cast("long").alias("_share"), head.alias("_head"))
    firsts = turns.where(F.col("pos") < most).groupBy(F.col("conv_id").alias("_head")).agg(
        F.sort_array(F.collect_list(F.struct("pos", "turn_key", "chars"))).alias("_firsts"))
    wanted = convs.select("_head").distinct()
    taken = stage(convs.join(firsts.join(wanted, "_head", "left_semi"), "_head", "left").select(
        "conv_id", "_n", "_share", F.coalesce(F.slice("_firsts", F.lit(1), F.col("_share").cast("int")),
                                              F.array()).alias("_top")), "heads")
    own = turns.join(taken.select("conv_id", "_share", F.size("_top").alias("_k")), "conv_id").where("pos >= _share").select(
        "conv_id", (F.col("pos") - F.col("_share") + F.col("_k")).alias("pos"), "turn_key", "chars")
    given = taken.select("conv_id", F.explode("_top").alias("t")).select("conv_id", "t.pos", "t.turn_key", "t.chars")
    bare = taken.where("size(_top) = 0 and _n <= _share").select(
        "conv_id", F.lit(None).cast("long").alias("pos"), F.lit(None).cast("binary").alias("turn_key"),
        F.lit(0).cast("long").alias("chars"))
    return own.union(given).union(bare)


def _walk(rows: dict[str, np.ndarray]) -> Iterator[tuple]:
    """The nodes of one shard: turns of one segment, ordered by conv_id and depth, depths of a conversation dense."""
    conv, depth = rows["conv_id"], rows["depth"].tolist()
    starts = np.flatnonzero(np.r_[True, conv[1:] != conv[:-1]])
    ids, member = conv[starts].tolist(), (np.cumsum(np.r_[False, conv[1:] != conv[:-1]])).tolist()
    starts = starts.tolist()
    turn = list(zip(rows["h1"].tolist(), rows["h2"].tolist()))
    key = list(zip(rows["k1"].tolist(), rows["k2"].tolist()))
    chars, last = rows["chars"].tolist(), rows["last"].tolist()
    base = depth[0]
    postings: dict[tuple, int] = {}
    there, ended = [0] * SEGMENT, [0] * SEGMENT
    for r, m in enumerate(member):
        d, bit = depth[r] - base, 1 << m
        postings[(d, turn[r])] = postings.get((d, turn[r]), 0) | bit
        there[d] |= bit
        if last[r]:
            ended[d] |= bit
    entries: dict[tuple | None, int] = {}
    for m, r in enumerate(starts):
        above = (key[r][0] ^ turn[r][0], key[r][1] ^ turn[r][1]) if base else (None, None)
        entries[above] = entries.get(above, 0) | 1 << m
    todo = [(bits, 0, above) for above, bits in entries.items()]
    while todo:
        bits, d, above = todo.pop()
        left = bits & there[d]
        while left:
            m = (left & -left).bit_length() - 1
            r = starts[m] + d
            child = left & postings[(d, turn[r])]
            left ^= child
            ends = child & ended[d]
            done = _members(ends, ids) if ends else None
            yield *key[r], *above, base + d, child.bit_count(), ids[m], chars[r], ends.bit_count(), done and done[:ENDS_A_ROW]
            for at in range(ENDS_A_ROW, len(done or ()), ENDS_A_ROW):
                yield *key[r], *above, base + d, 0, None, chars[r], 0, done[at:at + ENDS_A_ROW]
            if d + 1 < SEGMENT and child != ends:
                todo.append((child ^ ends, d + 1, key[r]))


def _members(bits: int, ids: list[int]) -> list[int]:
    out = []
    while bits:
        low = bits & -bits
        out.append(ids[low.bit_length() - 1])
        bits ^= low
    return out


def _shard_nodes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Walks shard by shard through rows ordered by (segment, conv_id, depth)."""
    names = ["segment", "conv_id", "depth", "h1", "h2", "k1", "k2", "chars", "last"]
    schema = pa.schema([(name, pa.int64()) for name in
                        ["k1", "k2", "p1", "p2", "depth", "n", "first", "chars", "n_ends"]] + [("ends", pa.list_(pa.int64()))])

    def walked(rows: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([dict(zip(schema.names, node)) for node in _walk(rows)], schema)

    def cut(rows: dict, all_of_it: bool) -> Iterator[tuple[int, int]]:
        """Spans of whole segments of conversations; the last one may go on in the next batch."""
        new = np.r_[True, (rows["conv_id"][1:] != rows["conv_id"][:-1]) | (rows["segment"][1:] != rows["segment"][:-1])]
        borders = np.flatnonzero(new)
        turns = set(np.flatnonzero(np.r_[True, rows["segment"][1:] != rows["segment"][:-1]]).tolist())
        begin = 0
        for border in [*borders[1:].tolist(), *([len(new)] if all_of_it else [])]:
            if border - begin >= SHARD_ROWS or border in turns or all_of_it and border == len(new):
                yield begin, border
                begin = border

    held: dict[str, np.ndarray] = {}
    for batch in batches:
        if not batch.num_rows:
            continue
        now = {n: batch.column(i).to_numpy(zero_copy_only=False) for i, n in enumerate(names)}
        held = {n: np.concatenate([held[n], now[n]]) for n in names} if held else now
        if len(held["depth"]) > SHARD_ROWS:
            stop = 0
            for start, stop in cut(held, False):
                yield walked({n: c[start:stop] for n, c in held.items()})
            held = {n: c[stop:] for n, c in held.items()}
    if held:
        for start, stop in cut(held, True):
            yield walked({n: c[start:stop] for n, c in held.items()})


@dataclass(frozen=True)
class Trie:
    """`nodes`: a row per node with its key (k1, k2), that of its parent (p1, p2), depth, conv_id (the smallest member),
    parent_conv_id, n_convs, n_children, n_leaves and saved_chars, the characters that its subtree saves. `ends`: the
    conversations that end at a node, as rows (k1, k2, ends) with ascending lists of at most ENDS_A_ROW ids, all ids of one
    row below or above all of another. `paths`: the node of each turn, as rows (conv_id, depth, k1, k2)."""

    nodes: DataFrame
    ends: DataFrame
    paths: DataFrame


def prefix_trie(turns: DataFrame) -> Trie:
    """The trie of all conversations in `turns` (conv_id, pos, turn_key, chars).

    Positions are dense from 0; a row with a null position stands for a conversation without turns. The root, of depth 0,
    has all conversations; without any there is no node. A hot turn, prefix or conversation is spread over shards; what
    shards say of a node is added up before it is shuffled.
    """
    long = F.lit(0).cast("long")
    seed = [F.xxhash64(F.lit(s), "depth", "turn_key").alias(f"h{s}") for s in (1, 2)]
    placed = turns.where("pos is not null").select("conv_id", (F.col("pos") + 1).alias("depth"), "turn_key", "chars").select(
        "conv_id", "depth", *seed, "chars")
    lengths = turns.groupBy("conv_id").agg(F.coalesce(F.max("pos") + 1, long).alias("_length"))
    roots = lengths.select("conv_id", long.alias("depth"), long.alias("h1"), long.alias("h2"), long.alias("chars"))
    steps = stage(placed.union(roots).join(lengths, "conv_id").select(
        "conv_id", "depth", "h1", "h2", "chars", (F.col("depth") == F.col("_length")).alias("last")), "steps")
    paths = stage(running(steps, ["conv_id"], "depth", {k: RunningXor(F.col(h)) for k, h in (("k1", "h1"), ("k2", "h2"))},
                          SEGMENT), "paths")

    shards = stage(paths.select(F.expr(f"depth div {SEGMENT}").alias("segment"), "conv_id", "depth", "h1", "h2", "k1", "k2",
                                "chars", "last").repartitionByRange("segment", "conv_id").sortWithinPartitions(
        "segment", "conv_id", "depth").mapInArrow(_shard_nodes, SHARD_NODE), "shards")
    nodes = stage(shards.groupBy(*KEY).agg(
        F.max("p1").alias("p1"), F.max("p2").alias("p2"), F.max("depth").alias("depth"), F.sum("n").alias("n_convs"),
        F.min("first").alias("conv_id"), F.max("chars").alias("chars"), F.sum("n_ends").alias("n_ends")), "nodes")

    # a node's value is booked on its smallest member; a conversation's bookings from a depth on belong to the subtree
    # of its node there, so subtrees are sums over the paths of their members
    booked = nodes.select("conv_id", "depth", (F.col("n_ends") == F.col("n_convs")).cast("long").alias("leaf"),
                          ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"))
    owners = booked.select("conv_id").distinct()
    booking = stage(paths.select("conv_id", "depth", *KEY).join(owners, "conv_id", "left_semi").join(
        booked, ["conv_id", "depth"], "left"), "booking")
    sums = {f"{name}_{c}": spec(F.coalesce(F.col(c), long)) for c in ("leaf", "saved")
            for name, spec in (("all", WholeSum), ("before", SumBefore))}
    rolled = running(booking, ["conv_id"], "depth", sums, SEGMENT).select(
        *KEY, (F.col("all_leaf") - F.col("before_leaf")).alias("leaves"),
        (F.col("all_saved") - F.col("before_saved")).alias("saved"))
    told = nodes.select(*KEY, "p1", "p2", "depth", "n_convs", "conv_id").unionByName(
        nodes.where("p1 is not null").select(F.col("p1").alias("k1"), F.col("p2").alias("k2"), F.lit(1).alias("child")),
        allowMissingColumns=True).unionByName(rolled, allowMissingColumns=True)
    whole = stage(told.groupBy(*KEY).agg(
        *[F.max(c).alias(c) for c in ("p1", "p2", "depth", "n_convs", "conv_id")],
        F.coalesce(F.sum("child"), long).alias("n_children"), F.sum("leaves").alias("n_leaves"),
        F.sum("saved").alias("saved_chars")), "trie")
    above = whole.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    return Trie(whole.join(above, ["p1", "p2"], "left"), shards.where("ends is not null").select(*KEY, "ends"),
                paths.select("conv_id", "depth", *KEY))


def _hashes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of each node's ids, comma-joined; rows come ordered by node and first id. Holds one digest's state."""
    key, state = None, None
    for batch in batches:
        keys, out = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())), []
        for at, now in enumerate(keys):
            text = batch.column(2)[at].as_py().encode()
            if now == key:
                state.update(b"," + text)
            else:
                if key is not None:
                    out.append((*key, state.hexdigest()))
                key, state = now, hashlib.sha256(text)
        yield _digest_rows(out)
    if key is not None:
        yield _digest_rows([(*key, state.hexdigest())])


def _digest_rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()),
                                       pa.array(columns[2], pa.string())], ["k1", "k2", "ends_sha256"])


def ends_digests(ends: DataFrame) -> DataFrame:
    """k1, k2, ends_sha256: a digest of all ids in a node's `ends`, ascending and comma-joined. A node's rows stream
    through one task in order; SHA-256 has no other way."""
    listed = ends.select(*KEY, F.array_join("ends", ",").alias("ids"), F.col("ends")[0].alias("first"))
    return listed.repartition(*KEY).sortWithinPartitions(*KEY, "first").select(*KEY, "ids").mapInArrow(
        _hashes, "k1 long, k2 long, ends_sha256 string")


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("conv_id")
    share = F.crc32(c.cast("string").cast("binary")) % 6
    turns = stage(ordered_turns(table(spark, sf_dir, "conversations")).select(
        "conv_id", "pos", "turn_key", F.length("text").cast("long").alias("chars")), "turns")
    trie = prefix_trie(stage(rebuilt(turns, share, c - c % 100, 5), "rebuilt"))
    return trie.nodes.join(ends_digests(trie.ends), KEY, "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved_chars").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))


#: CRC-32 bit by bit; a node's key is the list of its turns
SQL = """
WITH turns AS (
  SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS pos
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
convs AS (
  SELECT conv_id, count(*) AS n, conv_id - conv_id % 100 AS head,
    xor(list_reduce(list_prepend(4294967295, list_transform(string_split(conv_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)),
      lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
        lambda x, step: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 6 AS h
  FROM turns GROUP BY conv_id),
given AS (
  SELECT c.conv_id, t.pos, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.head AND t.pos < c.h),
made AS (
  SELECT conv_id, pos, role, text FROM given
  UNION ALL
  SELECT c.conv_id, t.pos - c.h + (SELECT count(*) FROM given g WHERE g.conv_id = c.conv_id), t.role, t.text
  FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.pos >= c.h),
paths AS (
  SELECT conv_id, pos + 1 AS depth, length(text) AS chars,
    list(md5(length(role) || ':' || role || text)) OVER (PARTITION BY conv_id ORDER BY pos) AS key FROM made
  UNION ALL
  SELECT conv_id, 0, 0, []::VARCHAR[] FROM convs),
lengths AS (SELECT conv_id, max(depth) AS length FROM paths GROUP BY conv_id),
nodes AS (
  SELECT key, depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(chars) AS chars,
    coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (depth = length), '') AS ends
  FROM paths JOIN lengths USING (conv_id) GROUP BY key, depth),
kids AS (SELECT key[:depth - 1] AS key, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
trees AS (
  SELECT p.key, sum(CASE WHEN k.key IS NULL THEN 1 ELSE 0 END) AS n_leaves, sum((n.n_convs - 1) * n.chars) AS saved
  FROM nodes n LEFT JOIN kids k ON k.key = n.key JOIN paths p ON p.conv_id = n.conv_id AND p.depth <= n.depth GROUP BY p.key)
SELECT n.conv_id, n.depth::BIGINT AS depth, up.conv_id AS parent_conv_id, n.n_convs,
  coalesce(k.n_children, 0) AS n_children, t.n_leaves::BIGINT AS n_leaves, t.saved::BIGINT AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM nodes n JOIN trees t ON t.key = n.key LEFT JOIN kids k ON k.key = n.key
LEFT JOIN nodes up ON n.depth > 0 AND up.key = n.key[:n.depth - 1]
"""
