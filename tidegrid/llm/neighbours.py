"""Nearest neighbours by multi-index hashing.

Vectors get binary codes: signs after rotations that are learned (principal axes, then the rotation that brings the
data nearest to the corners of a cube). A code is split into substrings of eight bits and each substring is indexed.
Two codes at Hamming distance r or less are, by the pigeonhole principle, within r_j in some substring j when the
r_j + 1 add up to r + 1; so looking up each substring's neighbourhood finds every code within r. All codes within a
query's radius are ranked by the exact inner product.

The radius is proven: where a bit differs, a vector is at least as far from the query along that axis as the query is
from the plane that the bit is the side of. So the k-th best inner product so far says how many bits the code of a row
that is as near can differ in. Where the tables can't exclude much within that radius, all rows of the block are ranked.

Inner products are turned into distances first: each vector gets one more coordinate that brings it to the largest norm.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import blocks_for, checkpointed, column

SUB_BITS = 8
_POPCOUNT = np.array([bin(i).count("1") for i in range(256)], np.uint8)
_DISTANCE = _POPCOUNT[np.arange(256)[:, None] ^ np.arange(256)[None, :]]


@dataclass
class Coder:
    """Learned rotations: codes of whole bytes."""

    mean: np.ndarray
    axes: np.ndarray
    norm: float
    rotations: int

    def codes(self, vectors: np.ndarray) -> np.ndarray:
        """[rows, bytes] codes of vectors in double precision."""
        lift = np.sqrt(np.maximum(self.norm**2 - (vectors**2).sum(axis=1), 0))
        return self._signs(np.column_stack((vectors, lift)))

    def query_codes(self, vectors: np.ndarray) -> np.ndarray:
        return self._signs(self._lifted_queries(vectors))

    def _lifted_queries(self, vectors: np.ndarray) -> np.ndarray:
        """A query's length doesn't change its order of answers, so it is brought to the largest norm too."""
        own = np.sqrt((vectors**2).sum(axis=1, keepdims=True))
        return np.column_stack((vectors * (self.norm / np.maximum(own, 1e-300)), np.zeros(len(vectors))))

    def radii(self, vectors: np.ndarray, worst: np.ndarray) -> np.ndarray:
        """For each query a radius: the code of every row whose inner product is `worst` or more is within it.

        Axes of one rotation are orthonormal, so the squared margins of the bits in which codes differ add up to at
        most the squared distance, times the number of rotations.
        """
        margins = np.cumsum(np.sort(((self._lifted_queries(vectors) - self.mean) @ self.axes) ** 2, axis=1), axis=1)
        own = np.sqrt((vectors**2).sum(axis=1))
        square = 2 * self.norm**2 - 2 * worst * (self.norm / np.maximum(own, 1e-300))
        room = 1e-9 * self.norm**2  # for rounding
        return (~(margins > (self.rotations * (square + room))[:, None])).sum(axis=1)

    def _signs(self, lifted: np.ndarray) -> np.ndarray:
        return np.packbits((lifted - self.mean) @ self.axes > 0, axis=1)


def learn(sample: np.ndarray, norm: float, *, bits: int = 256, rounds: int = 25, seed: int = 5) -> Coder:
    """Rotations fitted one after another, from different starts, until there are `bits` bits."""
    rng = np.random.default_rng(seed)
    dim = sample.shape[1]
    lifted = np.column_stack((sample, np.sqrt(np.maximum(norm**2 - (sample**2).sum(axis=1), 0)))) if len(sample) else np.zeros((1, dim + 1))
    mean = lifted.mean(axis=0)
    _, vectors = np.linalg.eigh(np.cov((lifted - mean).T) if len(lifted) > 1 else np.eye(dim + 1))
    base = vectors[:, ::-1]
    axes, have = [], 0
    while have < bits:
        own = base[:, : min(dim, bits - have)]
        z = (lifted - mean) @ own
        rotation, _ = np.linalg.qr(rng.normal(size=(own.shape[1], own.shape[1])))
        for _ in range(rounds):
            left, _, right = np.linalg.svd(np.where(z @ rotation > 0, 1.0, -1.0).T @ z)
            rotation = (left @ right).T
        axes.append(own @ rotation)
        have += own.shape[1]
    return Coder(mean, np.concatenate(axes, axis=1), norm, len(axes))


class MultiIndex:
    """One table for each substring of the codes: value -> bitmap of the rows with it, as neighbourhoods are looked up."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.words = np.ascontiguousarray(np.pad(codes, ((0, 0), (0, -codes.shape[1] % 8)))).view(np.uint64)
        self.parts = codes.shape[1]
        self.bitmaps = [np.packbits(codes[:, j][None, :] == np.arange(256, dtype=np.uint8)[:, None], axis=1) for j in range(self.parts)]
        self.balls: dict[tuple[int, int], np.ndarray] = {}

    def ball(self, part: int, radius: int) -> np.ndarray:
        """[value, row bits]: rows whose substring is within the radius of the value."""
        if (part, radius) not in self.balls:
            rows = np.unpackbits(self.bitmaps[part], axis=1)
            near = (_DISTANCE <= radius).astype(np.float32) @ rows.astype(np.float32) > 0
            self.balls[part, radius] = np.packbits(near, axis=1)
        return self.balls[part, radius]

    def within(self, queries: np.ndarray, query_words: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query numbers, row numbers and distances of all codes within the radius."""
        each, more = divmod(radius + 1, self.parts)  # the r_j + 1: `more` of them are larger by one
        found = None
        for j in range(self.parts):
            r = each + (j < more) - 1
            if r >= 0:
                hit = self.ball(j, min(r, SUB_BITS))[queries[:, j]]
                found = hit if found is None else np.bitwise_or(found, hit, out=found)
        n = len(self.codes)
        q, row = np.nonzero(np.unpackbits(found, axis=1)[:, :n]) if found is not None else (np.zeros(0, int), np.zeros(0, int))
        far = np.bitwise_count(self.words[row] ^ query_words[q]).sum(axis=1, dtype=np.int64)
        near = far <= radius
        return q[near], row[near], far[near]


def _ranked(rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray, q_rows: np.ndarray, q_vectors: np.ndarray, q: np.ndarray, row: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of pairs of query and row numbers the k best of each query, best first, and their scores; ties go to the smaller id."""
    other = rows[row] != q_rows[q]
    q, row = q[other], row[other]
    parts = [(vectors[row[a : a + (1 << 16)]] * q_vectors[q[a : a + (1 << 16)]]).sum(axis=1) for a in range(0, len(q), 1 << 16)]
    score = np.concatenate(parts) if parts else np.zeros(0)  # one order of summing for every pair
    order = np.lexsort((ids[row], -score, q))
    q, row, score = q[order], row[order], score[order]
    best = np.arange(len(q)) - np.searchsorted(q, q) < k
    return q[best], row[best], score[best]


def _scanned(rows: np.ndarray, vectors: np.ndarray, q_rows: np.ndarray, q_vectors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Query and row numbers of all pairs that can be among a query's k best: fast products, with room for their rounding."""
    fast = q_vectors @ vectors.T
    room = 1e-15 * vectors.shape[1] * np.sqrt((q_vectors**2).sum(axis=1) * (vectors**2).sum(axis=1).max())
    fast[rows[None, :] == q_rows[:, None]] = -np.inf
    at = max(0, len(rows) - k)
    return np.nonzero(fast >= (np.partition(fast, at, axis=1)[:, at] - room)[:, None])


def nearest(index: MultiIndex, coder: Coder, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray, q_rows: np.ndarray, q_vectors: np.ndarray, k: int):
    """Query numbers, row numbers and scores of each query's k best rows of a block, a part of the queries at a time."""
    codes = coder.query_codes(q_vectors)
    words = np.ascontiguousarray(np.pad(codes, ((0, 0), (0, -codes.shape[1] % 8)))).view(np.uint64)
    radius = index.parts - 1  # as far as equal substrings reach
    q, row, _ = index.within(codes, words, radius)
    q, row, score = _ranked(rows, ids, vectors, q_rows, q_vectors, q, row, k)
    worst = np.full(len(q_rows), -np.inf)
    full = np.bincount(q, minlength=len(q_rows)) == k
    worst[full] = score[np.searchsorted(q, np.flatnonzero(full)) + k - 1]
    need = coder.radii(q_vectors, worst)
    proven = need[q] <= radius
    yield q[proven], row[proven], score[proven]
    # one bit off in a substring brings two thirds of random codes, two bits nearly all
    farther = (need > radius) & (need < 2 * index.parts)
    for r in np.unique(need[farther]):
        mine = np.flatnonzero(need == r)
        q, row, _ = index.within(codes[mine], words[mine], int(r))
        q, row, score = _ranked(rows, ids, vectors, q_rows[mine], q_vectors[mine], q, row, k)
        yield mine[q], row, score
    mine = np.flatnonzero(need >= 2 * index.parts)
    if len(mine):
        q, row, score = _ranked(rows, ids, vectors, q_rows[mine], q_vectors[mine], *_scanned(rows, vectors, q_rows[mine], q_vectors[mine], k), k)
        yield mine[q], row, score


def usable(vector: Column) -> Column:
    """Whether a vector takes part: not null, every component finite, one not zero."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    flat = column.combine_chunks()
    flat = flat.flatten() if isinstance(flat, pa.ListArray) else pa.concat_arrays([c.flatten() for c in flat.chunks] or [pa.array([], pa.float64())])
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def search(df: DataFrame, is_query: Column, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, bits: int = 256, sample: int = 10_000, rows_per_block: int = 8192, least_blocks: int = 24, queries_per_block: int = 16_384, seed: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of df that is_query holds for, its k nearest other rows.

    Nearness is the inner product in double precision; ties go to the smaller id. Rows lie in blocks by their ids'
    hashes, and each block of queries meets each block of rows. A block answers with the k nearest of all its rows, so
    the result is exact. Rotations are fitted on at most `sample` rows.

    Rows with unusable() vectors, null ids, or another dimension than the most frequent one take no part. A query's
    own row is not among its answers. Rows that repeat an id are rows of their own, as queries and as answers. Vectors
    are scaled by a power of two inside, so that large ones don't overflow before their scores do. No rows: an empty result.
    """
    rows = df.filter(usable(column(vector_col)) & column(id_col).isNotNull()).select(F.monotonically_increasing_id().alias("row"), column(id_col).cast("long").alias("vec_id"), column(vector_col).alias("v"), F.coalesce(is_query, F.lit(False)).alias("is_query"))
    rows = checkpointed(rows).withColumn("v", F.col("v").cast("array<double>"))  # a row's number holds as it is written
    largest = F.max(F.array_max(F.transform("v", F.abs)))
    dims = rows.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("is_query").cast("long")).alias("q"), largest.alias("largest")).orderBy(F.desc("n"), "dim").limit(1).collect()
    spark = df.sparkSession
    if not dims:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, total, n_queries = dims[0]["dim"], dims[0]["n"], dims[0]["q"]
    scale = 2.0 ** -int(np.clip(np.frexp(dims[0]["largest"])[1], -1000, 1000))
    rows = rows.filter(F.size("v") == dim)
    norm = rows.agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + (x * scale) * (x * scale)))).first()[0] ** 0.5
    taken = rows.select("vec_id", "v", F.xxhash64("vec_id").alias("h")).orderBy("h", "vec_id").limit(sample).select("v").toArrow()
    coder = learn(_matrix(taken.column("v"), dim) * scale, norm, bits=bits, seed=seed)

    blocks, query_blocks = blocks_for(total, rows_per_block, least_blocks), blocks_for(n_queries, queries_per_block)
    block = F.pmod(F.xxhash64(F.lit(seed), "row"), F.lit(blocks)).cast("int").alias("block")
    query_block = F.pmod(F.xxhash64(F.lit(seed), "row"), F.lit(query_blocks)).cast("int").alias("query_block")
    index = rows.select("row", "vec_id", "v", block).withColumn("query_block", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    queries = rows.filter("is_query").select("row", "vec_id", "v", query_block).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def answer(own: pa.Table, asked: pa.Table) -> pa.Table:
        numbers, ids, vectors = own.column("row").to_numpy(), own.column("vec_id").to_numpy(), _matrix(own.column("v"), dim) * scale
        q_numbers, qids, qvectors = asked.column("row").to_numpy(), asked.column("vec_id").to_numpy(), _matrix(asked.column("v"), dim) * scale
        out: list[tuple] = []
        if len(ids) and len(qids):
            index = MultiIndex(coder.codes(vectors))
            for a in range(0, len(qids), 128):
                q_ids, q_rows, q_vectors = qids[a : a + 128], q_numbers[a : a + 128], qvectors[a : a + 128]
                for q, row, score in nearest(index, coder, numbers, ids, vectors, q_rows, q_vectors, k):
                    out.append((q_rows[q], q_ids[q], ids[row], score))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [[], [], [], []]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64())
        return pa.table(dict(zip(("row", "query_id", "vec_id", "score"), map(pa.array, columns, kinds), strict=True)))

    near = index.groupBy("block", "query_block").cogroup(queries.groupBy("block", "query_block")).applyInArrow(answer, "row long, query_id long, vec_id long, score double")
    order = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    best = near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", (F.col("score") / scale / scale).alias("score"))
