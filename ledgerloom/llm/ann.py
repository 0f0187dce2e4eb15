"""Nearest neighbours by inner product over randomly rotated one-bit codes.

A unit vector o, rotated by a random orthogonal matrix, is kept as the signs of its coordinates, packed into bits, with
two scalars: its length and the cosine c between o and its code. For a rotated unit query q the inner product with the
code, divided by c, estimates that of q and o, and the error stays within EPSILON * sqrt((1 - c^2) / (c^2 (d - 1))) with
a chance that falls as exp(-EPSILON^2 / 2). Each candidate has so a lower and an upper bound; those whose upper bound
reaches the k-th largest lower bound (a neighbour is lost only if both are off) are reranked by their exact inner product in double precision.

Candidates form blocks of about ``BLOCK`` rows by hash, queries groups of about ``GROUP``; each block meets each group
in one task, which returns the block's k best per query, and a last step keeps the k best of the blocks. Equal vectors
of a block are coded and scored once, and each stands for all its rows, so copies cost nothing and none is lost.

Defined cases: vectors that are null, empty, zero or hold null or not finite components take no part, nor do rows with a
null id; rows that repeat an id and vector are one candidate; vectors of another length than the query's are not
its candidates; ties go to the smaller id; with fewer than k candidates all are returned; other columns do not matter.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows of a block of candidates and of a group of queries, about; width of the error bounds.
BLOCK, GROUP, EPSILON = 8_192, 16_384, 1.9
_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


@lru_cache(maxsize=8)
def rotation(d: int) -> np.ndarray:
    """A random orthogonal matrix with a fixed seed."""
    q, r = np.linalg.qr(np.random.default_rng(d).normal(size=(d, d)))
    return q * np.sign(np.diag(r))


def packed_words(bits: np.ndarray) -> np.ndarray:
    """Bits of each row in 64-bit words."""
    out = np.zeros((len(bits), -(-bits.shape[1] // 64) * 8), np.uint8)
    packed = np.packbits(bits, axis=1)
    out[:, : packed.shape[1]] = packed
    return out.view(np.uint64)


def units(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors and lengths of rows, also of those whose squares are too small or large for a double."""
    scale = np.abs(x).max(1, keepdims=True)
    x = x / scale
    length = np.linalg.norm(x, axis=1, keepdims=True)
    with np.errstate(over="ignore"):
        return x / length, (length * scale)[:, 0]


def codes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed signs, lengths and the cosine of each rotated vector and its code."""
    d = x.shape[1]
    unit, length = units(x)
    turned = unit @ rotation(d)
    return packed_words(turned > 0), length, np.abs(turned).sum(1) / np.sqrt(d)


def estimates(packed: np.ndarray, cosine: np.ndarray, queries: np.ndarray, bits: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Estimated inner products of unit vectors, a row for each rotated unit query, and the half width of their bounds.
    The query is quantised to ``bits`` bits; a candidate's sum over set bits is a popcount for each bit of the query."""
    d = queries.shape[1]
    low, top = queries.min(1, keepdims=True), queries.max(1, keepdims=True)
    unit = np.maximum(top - low, 1e-12) / (2**bits - 1)
    level = np.rint((queries - low) / unit).astype(np.uint16)
    ones = np.bitwise_count(packed).sum(1, dtype=np.int32)
    total = np.zeros((len(queries), len(packed)), np.int32)
    for b in range(bits):
        plane = packed_words(((level >> b) & 1).astype(bool))
        for k in range(packed.shape[1]):
            total += np.bitwise_count(plane[:, k, None] & packed[None, :, k]).astype(np.int32) << b
    # the code is (2 bit - 1) / sqrt(d), the query low + unit * level
    inner = 2 * (low * ones + unit * total) - (low * d + unit * level.sum(1, keepdims=True, dtype=np.int64))
    lost = unit * np.sqrt(d) / 2  # by quantising the query, at most
    spread = EPSILON * np.sqrt(np.maximum(1 - cosine**2, 0) / (cosine**2 * max(d - 1, 1)))
    return inner / np.sqrt(d) / cosine, spread + lost / cosine


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows in double precision, summed in the order of components."""
    out = np.zeros(len(a))
    for k in range(a.shape[1]):
        out += a[:, k] * b[:, k]
    return out


def best_in_block(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, candidate, score) with the block's k best candidates of each query."""
    order = np.lexsort((ids, *x.T[::-1]))
    ids, x = ids[order], x[order]
    same = np.zeros(len(ids), bool)
    same[1:] = (x[1:] == x[:-1]).all(1)
    first = np.flatnonzero(~same)
    begin = np.append(first, len(ids))
    size = np.diff(begin)
    own = x[first]  # one of each class of equal vectors; the ids of a class ascend
    packed, length, cosine = codes(own)
    turned = units(queries)[0] @ rotation(x.shape[1])
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for a in range(0, len(queries), 64):
        q, q_ids = queries[a : a + 64], query_ids[a : a + 64]
        middle, half = estimates(packed, cosine, turned[a : a + 64])
        with np.errstate(over="ignore", invalid="ignore"):
            middle, half = middle * length, np.broadcast_to(half, middle.shape) * length
            lower = middle - half
        need = min(k + 1, lower.shape[1])  # one more, as a query may meet itself
        limit = np.partition(lower, lower.shape[1] - need, axis=1)[:, lower.shape[1] - need]
        for r in range(len(q)):
            near = np.flatnonzero(~(middle[r] + half[r] < limit[r]))  # what overflows is not below
            rough = own[near] @ q[r]
            place = max(len(rough) - need, 0)
            last = np.partition(rough, place)[place]
            near = near[~(rough < last - 1e-9 * (1 + abs(last)))]  # sums in another order differ by far less
            score = exact(np.broadcast_to(q[r], (len(near), len(q[r]))), own[near])
            take = np.minimum(size[near], k + 1)  # of a class, its k + 1 least ids suffice
            at = np.repeat(first[near], take) + np.arange(take.sum()) - np.repeat(np.cumsum(take) - take, take)
            score = np.repeat(score, take)
            other = ids[at] != q_ids[r]
            at, score = at[other], score[other]
            best = np.lexsort((ids[at], -score))[:k]
            out.append((np.full(len(best), q_ids[r]), ids[at[best]], score[best]))
    return tuple(np.concatenate([o[c] for o in out]) if out else np.zeros(0) for c in range(3))  # type: ignore[return-value]


def matrix(column: pa.ChunkedArray, d: int) -> np.ndarray:
    column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """For each row whose id ``every`` divides: its k nearest other rows as (query_id, rank, vec_id, score)."""
    usable = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x")).where(
        F.col("vec_id").isNotNull() & (F.size("x") > 0) & F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("x", lambda v: v != 0.0)
    )
    is_query = F.pmod("vec_id", F.lit(every)) == 0
    counts = usable.agg(F.count("*"), F.count_if(is_query)).first()
    blocks, groups = -(-counts[0] // BLOCK) or 1, -(-counts[1] // GROUP) or 1
    # blocks and groups are cut by hash; each side is repeated for the numbers of the other
    block, group = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)), F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(groups))
    candidates = usable.select("vec_id", "x", F.size("x").alias("d"), block.cast("int").alias("b"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"))
    queries = usable.where(is_query).select("vec_id", "x", F.size("x").alias("d"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"), group.cast("int").alias("g"))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _FOUND.empty_table()
        d = left.column("d")[0].as_py()
        c_ids, q_ids = left.column("vec_id").to_numpy(), right.column("vec_id").to_numpy()
        c, q = matrix(left.column("x"), d), matrix(right.column("x"), d)
        c_keep, q_keep = (np.unique(np.column_stack([i, (x + 0.0).view(np.int64)]), axis=0, return_index=True)[1] for i, x in ((c_ids, c), (q_ids, q)))
        found = best_in_block(c_ids[c_keep], c[c_keep], q_ids[q_keep], q[q_keep], k)
        return pa.table([pa.array(v, t) for v, t in zip(found, _FOUND.types, strict=True)], schema=_FOUND)

    met = candidates.groupBy("b", "g", "d").cogroup(queries.groupBy("b", "g", "d")).applyInArrow(meet, "query_id BIGINT, vec_id BIGINT, score DOUBLE")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", F.col("vec_id"), "score")
