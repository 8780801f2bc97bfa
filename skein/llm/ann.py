"""Approximate nearest neighbours by a permutation index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace

#: Pivots, the nearest of them that represent a vector, and the distinct vectors looked at to choose them.
PIVOTS, PREFIX, PIVOT_SAMPLE = 256, 64, 4096
#: Share of each block that is reranked, those of equal footrule distance with it; rows of a block of candidates and of queries.
SHARE = 0.3
BLOCK, QUERY_BLOCK = 8192, 2048
FOUND = "query_id long, vec_id long, score double"


def usable(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, v: the vectors that take part, as doubles.

    Out go rows with a null id or vector, null or non-finite components or no length.
    """
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return rows.where("vec_id is not null and v is not null").where(fine)


def choose_pivots(rows: DataFrame, pivots: int = PIVOTS, sample: int = PIVOT_SAMPLE) -> np.ndarray:
    """Unit pivots from the first `sample` distinct vectors by hash, near copies of earlier ones passed over."""
    picked = rows.select("v").distinct().orderBy(F.xxhash64("v"), "v").limit(sample).collect()
    x = np.asarray([r["v"] for r in picked], np.float64)
    if not len(x):
        return np.zeros((0, 1))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    taken: list[int] = []
    for i in range(len(x)):
        if len(taken) == pivots:
            break
        if not taken or (x[taken] @ x[i]).max() < 0.9:
            taken.append(i)
    return x[taken]


def permutations(x: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """The ids of the nearest pivots of each vector, nearest first, ties to the lower id."""
    near = -(x @ pivots.T)
    m = min(prefix, near.shape[1])
    return np.argsort(near, axis=1, kind="stable")[:, :m].astype(np.int16)


class Postings:
    """Inverted files of one block: for each pivot the vectors that have it in their prefix, and where."""

    def __init__(self, perms: np.ndarray, pivots: int):
        self.n, self.m = perms.shape
        order = np.argsort(perms.ravel(), kind="stable")
        self.rows, self.places = (order // self.m).astype(np.int64), order % self.m
        self.bounds = np.searchsorted(perms.ravel()[order], np.arange(pivots + 1))

    def gains(self, perm: np.ndarray) -> np.ndarray:
        """What each vector's footrule distance from a query falls short of the largest one."""
        gain = np.zeros(self.n, np.int32)
        for place, pivot in enumerate(perm.tolist()):
            lo, hi = self.bounds[pivot], self.bounds[pivot + 1]
            gain[self.rows[lo:hi]] += (self.m - np.abs(self.places[lo:hi] - place)).astype(np.int32)
        return gain


def nearest_in_block(ids, vectors, postings: Postings, query_ids, queries, query_perms, k: int, share: float):
    """(query, vec_id, score) of the k largest inner products among each query's candidates in the block."""
    found: tuple[list, list, list] = ([], [], [])
    keep = min(len(ids), max(4 * k + 1, int(np.ceil(share * len(ids)))))
    for q, x, perm in zip(query_ids, queries, query_perms, strict=True):
        gain = postings.gains(perm)
        near = np.flatnonzero(gain >= np.partition(gain, len(gain) - keep)[len(gain) - keep])
        near = near[ids[near] != q]
        score = vectors[near] @ x
        best = np.lexsort((ids[near], -score))[:k]
        found[0].extend([q] * len(best))
        found[1].extend(ids[near][best].tolist())
        found[2].extend(score[best].tolist())
    return found


class PermutationIndex:
    """Every usable row, under its ordered nearest pivots, in blocks of a bounded number of rows.

    The pivots come from a bounded sample of distinct vectors of each dimension; no row is left out,
    and vectors of one dimension are each other's candidates. `rows` is a written table (vec_id, v,
    perm, block); `search` may be called for any set of queries. An empty table gives an empty index;
    other columns are ignored, whatever their names.
    """

    def __init__(self, vectors: DataFrame, work: Workspace, vec_id: str = "vec_id", embedding: str = "embedding", pivots: int = PIVOTS, prefix: int = PREFIX):
        rows = usable(vectors, vec_id, embedding)
        self.work, self.most = work, pivots
        sizes = {r["n"]: r["k"] for r in rows.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("k")).collect()}
        chosen = {n: choose_pivots(rows.where(F.size("v") == n), pivots) for n in sorted(sizes)}

        @F.pandas_udf("array<short>")
        def perm(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for part in parts:
                out: list = [None] * len(part)
                lengths = part.map(len).to_numpy()
                for n in np.unique(lengths).tolist():
                    at = np.flatnonzero(lengths == n)
                    for i, p in zip(at.tolist(), permutations(np.stack(part.iloc[at].to_list()).astype(np.float64), chosen[n], prefix), strict=True):
                        out[i] = p
                yield pd.Series(out, dtype=object)

        # blocks of one dimension follow one another
        blocks = {n: max(1, -(-k // BLOCK)) for n, k in sizes.items()}
        first, block = 0, F.lit(0)
        self.spaces: list[tuple[int, int, int]] = []
        for n in sorted(sizes):
            block = F.when(F.size("v") == n, F.lit(first) + F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks[n]))).otherwise(block)
            self.spaces.append((n, first, blocks[n]))
            first += blocks[n]
        self.rows = work.save(rows.select("vec_id", "v", perm("v").alias("perm"), block.cast("int").alias("block")), "index")

    def search(self, queries: DataFrame, k: int = 20, share: float = SHARE) -> DataFrame:
        """query_id, rank, vec_id, score for rows of the index whose vec_id is in `queries`.

        Query and candidate blocks meet pairwise, both bounded; only k rows a query and block leave
        a task. Candidates of the query's own id are left out; ties go to the smaller vec_id. A
        repeated query id is searched once, with its smallest vector; repeated candidates are found
        once each.
        """
        asked = self.rows.join(queries.select("vec_id").where("vec_id is not null").distinct(), "vec_id", "left_semi")
        asked = asked.groupBy("vec_id").agg(F.min(F.struct("v", "perm")).alias("s")).select("vec_id", "s.v", "s.perm")
        n = asked.count()
        groups = max(1, -(-n // QUERY_BLOCK))
        left = self.rows.groupBy("block").agg(F.collect_list(F.struct("vec_id", "v", "perm")).alias("rows"))
        left = left.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
        right = asked.groupBy(F.size("v").alias("n"), F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int").alias("part")).agg(F.collect_list(F.struct("vec_id", "v", "perm")).alias("queries"))
        # a dimension's queries meet its blocks
        own = F.array().cast("array<int>")
        for size, first, blocks in self.spaces:
            own = F.when(F.col("n") == size, F.sequence(F.lit(first), F.lit(first + blocks - 1))).otherwise(own)
        right = right.withColumn("block", F.explode(own)).drop("n")
        pivots = self.most

        def unpacked(rows: pa.ListScalar) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            x = rows.values
            count = len(x)
            floats = x.field("v").flatten().to_numpy().reshape(count, -1)
            return x.field("vec_id").to_numpy(), floats, x.field("perm").flatten().to_numpy().reshape(count, -1)

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for mine, theirs in zip(batch.column("rows"), batch.column("queries"), strict=True):
                    ids, vectors, perms = unpacked(mine)
                    got = nearest_in_block(ids, vectors, Postings(perms, pivots), *unpacked(theirs), k, share)
                    yield pa.RecordBatch.from_arrays([pa.array(got[0], pa.int64()), pa.array(got[1], pa.int64()), pa.array(got[2], pa.float64())], names=["query_id", "vec_id", "score"])

        found = left.join(right, ["block", "part"]).select("rows", "queries").mapInArrow(meet, FOUND)
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        return found.select("query_id", "rank", "vec_id", "score")


def exact(vectors: DataFrame, query_ids: list[int], k: int = 20) -> dict[int, list[int]]:
    """Brute force for a few queries of a table of one dimension, to measure recall with."""
    rows = usable(vectors).toPandas()
    x, ids = np.stack(rows["v"].to_list()), rows["vec_id"].to_numpy()
    out = {}
    for q in query_ids:
        score = x @ x[np.flatnonzero(ids == q)[0]]
        order = np.lexsort((ids, -score))
        out[q] = ids[order][ids[order] != q][:k].tolist()
    return out
