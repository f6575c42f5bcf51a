import hashlib
import random
from collections import defaultdict
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from scriptmill.llm import conversations as c

SCHEMA = "conv_id long, turn long, role string, text string, depth string, k1 string, pos string"


def brute(rows, share, head):
    """Nodes as the query returns them, from plain dictionaries of whole prefixes."""
    own = defaultdict(list)
    for i, turn, role, text in rows:
        if i is not None:
            own[i].append((turn is not None, turn or 0, role or "", text or ""))
    own = {i: [t[2:] for t in sorted(turns)] for i, turns in own.items()}
    made = {i: own.get(head(i), [])[:share(i)] + turns[share(i):] for i, turns in own.items()}
    members = defaultdict(list)
    for i in sorted(made):
        for d in range(len(made[i]) + 1):
            members[tuple(made[i][:d])].append(i)
    kids = defaultdict(list)
    for path in members:
        if path:
            kids[path[:-1]].append(path)

    def tree(path):
        below = [tree(k) for k in kids[path]]
        saved = (len(members[path]) - 1) * len(path[-1][1]) if path else 0
        return sum(b[0] for b in below) or 1, saved + sum(b[1] for b in below)

    out = []
    for path, ids in members.items():
        ends = ",".join(str(i) for i in ids if len(made[i]) == len(path))
        out.append((ids[0], len(path), members[path[:-1]][0] if path else None, len(ids), len(kids[path]), *tree(path),
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def h(i):
    return crc32(str(i).encode()) % 6


def run(spark, tmp_path, rows):
    spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA).repartition(3).write.parquet(
        f"{tmp_path}/conversations.parquet")
    return sorted(map(tuple, c.op12_conversation_trie(spark, str(tmp_path)).collect()), key=repr)


def corpus(seed, convs=60):
    r = random.Random(seed)
    rows = []
    for i in r.sample(range(700), convs):
        for t in range(r.choice([1, 2, 3, 4, 9, 40])):
            rows.append((i, None if t == 0 and r.random() < .2 else t * 3, r.choice(["user", "bot", None]),
                         r.choice(["", None, "a", "bé😀", "c" * 30]) if r.random() < .5 else "same"))
    return rows


@pytest.mark.parametrize("segment, shard, listed", [(256, 16_384, 256), (4, 7, 2), (3, 1, 1)])
def test_equals_whole_prefixes(spark, tmp_path, monkeypatch, segment, shard, listed):
    monkeypatch.setattr(c, "SEGMENT", segment)
    monkeypatch.setattr(c, "SHARD_ROWS", shard)
    monkeypatch.setattr(c, "ENDS_A_ROW", listed)
    rows = corpus(segment)
    assert run(spark, tmp_path, rows) == brute(rows, h, lambda i: i - i % 100)


def test_odd_rows(spark, tmp_path):
    """Null ids, null turns, equal turns, repeated rows, conversations left without a turn, copies in masses."""
    rows = [(None, 0, "a", "b"), (200, 1, "u", "x"), (200, 1, "u", "x"), (200, None, None, None), (201, 5, "u", "y"),
            (201, 5, "a", "y"), (1, 0, "u", "alone"), (7, 0, "u", "alone")]
    rows += [(i, 0, "u", "copy " * 2000) for i in range(1000, 1400)]
    got = run(spark, tmp_path, rows)
    assert got == brute(rows, h, lambda i: i - i % 100)
    assert sum(r[1] == 0 for r in got) == 1


def test_empty(spark, tmp_path):
    assert run(spark, tmp_path, []) == []


def test_roles_and_texts_are_kept_apart(spark):
    df = spark.createDataFrame([(1, 0, "ab", "c", "", "", ""), (2, 0, "a", "bc", "", "", "")], SCHEMA)
    assert c.ordered_turns(df).select("turn_key").distinct().count() == 2


def test_operator_gives_lists_and_paths(spark):
    turns = spark.createDataFrame([(i, p, bytes([t]), 2) for i in range(5) for p, t in enumerate([7, i % 2])],
                                  "conv_id long, pos long, turn_key binary, chars long")
    trie = c.prefix_trie(turns)
    assert sorted(sorted(r.ends) for r in trie.ends.collect()) == [[0, 2, 4], [1, 3]]
    assert trie.paths.count() == 15 and trie.nodes.agg(F.sum("n_convs")).first()[0] == 15


def test_no_shard_is_larger_than_told(spark, tmp_path, monkeypatch):
    """One conversation of a third of all rows, and one turn that all others share, spread over shards."""
    seen = tmp_path / "seen"
    seen.mkdir()
    walk = c._walk

    def told(rows):
        (seen / f"{rows['segment'][0]}-{rows['conv_id'][0]}").write_text(str(len(rows["depth"])))
        return walk(rows)

    monkeypatch.setattr(c, "SHARD_ROWS", 500)
    monkeypatch.setattr(c, "_walk", told)
    rows = [(2, t, "u", str(t)) for t in range(2000)] + [(100 * i, t, "u", "s") for i in range(1000) for t in range(2)]
    turns = c.ordered_turns(spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)).select(
        "conv_id", "pos", "turn_key", F.lit(1).cast("long").alias("chars"))
    assert c.prefix_trie(turns).nodes.count() == 2000 + 2 + 1
    sizes = [int(p.read_text()) for p in seen.iterdir()]
    assert max(sizes) <= 500 + c.SEGMENT and len(sizes) > 9
