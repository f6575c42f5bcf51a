"""Approximate nearest neighbours by multi-index hashing of learned rotated binary codes."""

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from scriptmill.llm.common import table

#: vectors the codes and the radius are learned from at most, those with the smallest hash of their id
SAMPLE_ROWS = 4096
#: vectors of the sample whose neighbours set the radius
SAMPLE_QUERIES = 256
#: share of the sample's true neighbours that lie within the radius
WITHIN = 0.99
BITS, PART_BITS, ROUNDS, SEED = 64, 8, 20, 7
#: rows of a block of the index, and queries that meet a block at once
BLOCK_ROWS, BLOCK_QUERIES = 8192, 2048


def usable(vector):
    """Not null, no null or non-finite component, not all zero."""
    return F.coalesce(F.forall(vector, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)) & ~F.isnan(x))
                      & F.exists(vector, lambda x: x != 0), F.lit(False))


class Codes:
    """Binary codes: signs of the centred vectors on principal axes, turned by a learned rotation."""

    def __init__(self, sample: np.ndarray, k: int):
        self.mean = sample.mean(0)
        self.bits = max(1, min(BITS, sample.shape[1]))
        centred = sample - self.mean
        axes = np.linalg.svd(centred, full_matrices=True)[2][:self.bits].T if len(sample) < 2 else np.linalg.eigh(
            centred.T @ centred)[1][:, ::-1][:, :self.bits]
        flat = centred @ axes
        turn = np.linalg.qr(np.random.default_rng(SEED).normal(size=(self.bits, self.bits)))[0]
        for _ in range(ROUNDS):
            left, _, right = np.linalg.svd(np.where(flat @ turn >= 0, 1.0, -1.0).T @ flat)
            turn = (left @ right).T
        self.turn = axes @ turn
        self.radius = self._radius(sample, k)

    def _radius(self, sample: np.ndarray, k: int) -> int:
        codes, seen = self.of(sample), []
        for i in range(min(SAMPLE_QUERIES, len(sample))):
            far = ((sample - sample[i]) ** 2).sum(1)
            far[i] = np.inf
            near = np.argsort(far, kind="stable")[:min(k, len(sample) - 1)]
            seen.append(np.bitwise_count(codes[near] ^ codes[i]))
        seen = np.concatenate(seen) if seen else np.zeros(0)
        return int(np.quantile(seen, WITHIN, method="higher")) if len(seen) else self.bits

    def of(self, vectors: np.ndarray) -> np.ndarray:
        signs = (vectors - self.mean) @ self.turn >= 0
        weights = np.uint64(1) << np.arange(self.bits, dtype=np.uint64)
        return (signs * weights).sum(1, dtype=np.uint64)


class MultiIndex:
    """A table from every part of the codes to its rows; finds all codes within a Hamming radius.

    If two codes of m parts differ in at most r bits, some part differs in at most r // m bits.
    """

    def __init__(self, codes: np.ndarray, bits: int):
        self.codes, self.count = codes, -(-bits // PART_BITS)
        self.tables = []
        for j in range(self.count):
            part = self.part(codes, j)
            order = np.argsort(part, kind="stable")
            self.tables.append((order, np.searchsorted(part[order], np.arange((1 << PART_BITS) + 1))))

    @staticmethod
    def part(codes, j: int):
        return ((codes >> np.uint64(j * PART_BITS)) & np.uint64((1 << PART_BITS) - 1)).astype(np.int64)

    @staticmethod
    def flips(most: int) -> np.ndarray:
        return np.array([sum(1 << b for b in bits) for n in range(min(most, PART_BITS) + 1)
                         for bits in combinations(range(PART_BITS), n)])

    def within(self, code: np.uint64, radius: int) -> np.ndarray:
        flips, seen = self.flips(radius // self.count), np.zeros(len(self.codes), bool)
        for j, (order, starts) in enumerate(self.tables):
            for value in self.part(code, j) ^ flips:
                seen[order[starts[value]:starts[value + 1]]] = True
        rows = np.flatnonzero(seen)
        return rows[np.bitwise_count(self.codes[rows] ^ code) <= radius]


def search_block(codes: Codes, base_ids, base, query_ids, queries, k: int) -> list[tuple]:
    """(query, distance, id) of the k nearest that each query's probes find in a block, ties to smaller ids."""
    index, found = MultiIndex(codes.of(base), codes.bits), []
    for query_id, vector, code in zip(query_ids, queries, codes.of(queries), strict=True):
        radius = codes.radius
        rows = index.within(code, radius)
        while np.count_nonzero(base_ids[rows] != query_id) < k and radius < codes.bits:
            radius = min(codes.bits, 2 * radius + 1)  # too few so near: look further
            rows = index.within(code, radius)
        rows = rows[base_ids[rows] != query_id]
        far = np.sqrt(((base[rows] - vector) ** 2).sum(1))
        best = np.lexsort((base_ids[rows], far))[:k]
        found += zip([query_id] * len(best), far[best].tolist(), base_ids[rows][best].tolist(), strict=True)
    return found


def nearest(vectors: DataFrame, is_query, k: int = 10, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows of each row where `is_query` holds, by Euclidean distance.

    The rotation and the Hamming radius are learned from a bounded sample; every row is indexed. Rows are
    dealt by a hash of their id into blocks of some BLOCK_ROWS, each block holds a multi-index, and blocks of
    queries meet blocks of rows; at most k rows per query leave a block. A query that finds fewer than k in a
    block within the radius searches that block further out, so k rows come back wherever k exist.

    Rows with a null id or vector, a null, infinite or not-a-number component, only zeros, or another
    length than most of the sample take no part. Rows with a query's own id are not its candidates; a query id
    that occurs in several rows searches with its smallest vector. Ties go to the smaller id; rows repeated in full appear
    as often as they occur. Other columns are not read. An empty table gives no rows.
    """
    rows = vectors.select(
        F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"),
        F.coalesce(is_query, F.lit(False)).alias("asks")).where(F.col("id").isNotNull() & usable(F.col("v")))
    sample = rows.select("v").orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS).collect()
    schema = "query_id long, rank int, vec_id long, score double"
    if not sample:
        return vectors.sparkSession.createDataFrame([], schema)
    lengths = [len(r.v) for r in sample]
    width = max(set(lengths), key=lambda n: (lengths.count(n), n))
    codes = Codes(np.array([r.v for r in sample if len(r.v) == width]), k)
    rows = rows.where(F.size("v") == width)
    count = rows.agg(F.count("*"), F.count_if("asks")).first()
    blocks, groups = -(-count[0] // BLOCK_ROWS) or 1, -(-count[1] // BLOCK_QUERIES) or 1

    def spread(n: int):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    base = rows.select("id", "v", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"),
                       spread(groups).alias("part"))
    asks = rows.where("asks").groupBy("id").agg(F.min("v").alias("v")).select(
        "id", "v", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(groups)).cast("int").alias("part"),
        spread(blocks).alias("block"))

    def search(base: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        found = search_block(codes, base.id.to_numpy(), np.stack(base.v), asks.id.to_numpy(), np.stack(asks.v),
                             k) if len(base) and len(asks) else []
        return pd.DataFrame(found, columns=["query_id", "score", "vec_id"]).astype(
            {"query_id": "int64", "score": "float64", "vec_id": "int64"})

    keys = ["block", "part"]
    found = base.groupBy(*keys).cogroup(asks.groupBy(*keys)).applyInPandas(
        search, "query_id long, score double, vec_id long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
