"""Approximate nearest neighbours by multi-index hashing.

* **Codes.** A rotation learned on a bounded sample (iterative quantisation)
  turns every vector into ``BITS`` bits, the signs of its rotated components;
  several rotations are stacked where the vector has fewer dimensions.  For
  inner products of vectors of unequal length, one more component completes
  each candidate to the length of the longest.
* **Index.** A code is cut into ``PIECES`` substrings; each has a table from
  substring value to the codes that hold it.
* **Probing.** By the pigeonhole principle a code within Hamming distance r of
  a query has a substring within ``r // PIECES`` of the query's; the buckets
  of all such values are read, and the codes in them checked: every code
  within the radius is retrieved, none is dropped.  Where a block holds fewer
  than k codes within r, the radius grows until it has k.
* **Rerank.** Retrieved vectors are ranked by the exact inner product in
  double precision, ties to the smaller id.

The radius comes from the sample: the distance within which ``COVER`` of the
sample queries' nearest vectors lie, counted at the rank that corresponds to k
in the whole table.

Scale: candidates are dealt into blocks of about ``BLOCK`` vectors by a hash of
their position, queries into blocks of ``QUERY_BLOCK``; each pair of blocks is
one group (index built, probed, k best kept), so no group grows with the data.
Long codes separate near from far: of 51,000 vectors a query retrieves and
reranks 3 to 4 %, with 64 bits it was 27 %.  A candidate travels once per block
of queries, a query once per block of candidates.
Equal vectors are one index entry that carries its k + 1 smallest ids, the
only ones a result can name; equal query vectors are searched once, and their
asking rows are joined back to what was found (the adaptive skew join splits
the rows of a common vector), so no task gathers the ids of one vector.

Defined cases: vectors null, empty, zero, of another length than most, or
holding null or non-finite components take no part; of rows with
equal ids each vector counts, and a query never finds its own id; fewer than k others give all of
them; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_batches, saved

BITS, PIECES = 256, 8                # substrings of 32 bits
SAMPLE, SAMPLE_QUERIES = 4096, 512   # bound of the rows the rotation and radius are fitted on
COVER = 0.98
BLOCK, QUERY_BLOCK = 4096, 8192
ROUNDS = 30                          # of iterative quantisation


def _completed(x: np.ndarray, longest: float) -> np.ndarray:
    """Candidates with one component more: all of the same length."""
    rest = np.maximum(longest ** 2 - np.einsum("ij,ij->i", x, x), 0.0)
    return np.hstack([x, np.sqrt(rest)[:, None]]) / longest


def _asked(q: np.ndarray) -> np.ndarray:
    return np.hstack([q / np.linalg.norm(q, axis=1, keepdims=True), np.zeros((len(q), 1))])


def learn_rotation(x: np.ndarray, seed: int = 7) -> np.ndarray:
    """Columns that map a (completed) vector to ``BITS`` signed components."""
    rng = np.random.default_rng(seed)
    dim, parts = x.shape[1], []
    while sum(p.shape[1] for p in parts) < BITS:
        keep = min(dim, BITS - sum(p.shape[1] for p in parts))
        _, _, axes = np.linalg.svd(x, full_matrices=False)
        base = np.linalg.qr(rng.standard_normal((dim, dim)))[0][:, :keep] if parts or len(axes) < keep else axes[:keep].T
        v = x @ base
        r = np.linalg.qr(rng.standard_normal((keep, keep)))[0]
        for _ in range(ROUNDS):
            u, _, w = np.linalg.svd(np.sign(v @ r).T @ v)
            r = (u @ w).T
        parts.append(base @ r)
    return np.hstack(parts)


def codes(x: np.ndarray, rotation: np.ndarray) -> np.ndarray:
    """(n, PIECES) substrings of the codes as 32-bit numbers."""
    bits = np.packbits(x @ rotation > 0, axis=1)
    return np.ascontiguousarray(bits).view(np.uint32)


def fit_radius(x: np.ndarray, rotation: np.ndarray, longest: float, near: int) -> int:
    """Radius that covers ``COVER`` of the sample queries' ``near`` nearest."""
    q = x[:SAMPLE_QUERIES]
    score = q @ x.T
    score[np.arange(len(q)), np.arange(len(q))] = -np.inf
    best = np.argsort(-score, axis=1)[:, :near]
    cq, cx = codes(_asked(q), rotation), codes(_completed(x, longest), rotation)
    far = np.bitwise_count(cq[:, None, :] ^ cx[best]).sum(axis=2, dtype=np.int64)
    return int(np.quantile(far, COVER, method="higher"))


class Index:
    """Substring tables of a block of codes."""

    def __init__(self, code: np.ndarray):
        self.code = code
        self.tables = []
        for j in range(code.shape[1]):
            order = np.argsort(code[:, j], kind="stable")
            values, starts = np.unique(code[order, j], return_index=True)
            self.tables.append((values, order, starts, np.diff(np.append(starts, len(order)))))

    def within(self, q: np.ndarray, radius: int) -> np.ndarray:
        """Every position whose code lies within ``radius`` of ``q``."""
        seen = np.zeros(len(self.code), dtype=bool)
        for j, (values, order, starts, sizes) in enumerate(self.tables):
            hit = np.bitwise_count(values ^ q[j]) <= radius // len(self.tables)
            seen[order[np.repeat(hit, sizes)]] = True
        at = np.flatnonzero(seen)
        return at[np.bitwise_count(self.code[at] ^ q).sum(axis=1, dtype=np.int64) <= radius]

    def at_least(self, q: np.ndarray, radius: int, k: int) -> np.ndarray:
        found = self.within(q, radius)
        while len(found) < min(k, len(self.code)):
            radius += 2
            found = self.within(q, radius)
        return found


def _vectors(table: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec as doubles) of the rows that take part."""
    v = F.col(vec_col).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return table.select(F.col(id_col).cast("long").alias("id"), v.alias("vec")).where(
        v.isNotNull() & (F.size(v) > 0) & ~bad & F.exists(v, lambda x: x != 0))


def nearest_neighbours(table: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id",
                       vec_col: str = "embedding") -> DataFrame:
    """The k nearest of every row whose id is divisible by ``every``:
    (query_id, rank, id, score)."""
    spark = table.sparkSession
    arrow_batches(spark)
    good = _vectors(table, id_col, vec_col)
    modal = good.groupBy(F.size("vec").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    empty = f"query_id long, rank int, {id_col} long, score double"
    if not modal:
        return spark.createDataFrame([], empty)
    good = good.where(F.size("vec") == modal[0]["dim"])
    # one entry for equal vectors, with the smallest ids; null ids cannot be named in a result
    entries = saved(_distinct(good.where("id is not null"), k, every)).withColumn("e", F.monotonically_increasing_id())
    square = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)
    total, longest = entries.agg(F.count("*"), F.sqrt(F.max(square))).first()
    if not total:
        return spark.createDataFrame([], empty)
    sample = np.array([r.vec for r in entries.select("vec").orderBy(F.xxhash64("vec"), F.col("ids")[0]).limit(SAMPLE).collect()])
    rotation = learn_rotation(_completed(sample, longest))
    near = max(1, min(round(k * len(sample) / total), len(sample) - 1))
    radius = fit_radius(sample, rotation, longest, near) if len(sample) > 1 else BITS
    n_blocks = max(1, -(-total // BLOCK))
    asked = entries.where("asked")
    q_total = asked.count()
    q_blocks = max(1, -(-q_total // QUERY_BLOCK))
    pick = lambda n, salt: F.pmod(F.xxhash64("vec", F.lit(salt)), F.lit(n)).cast("int")
    cand = entries.select("vec", "ids", pick(n_blocks, 1).alias("cb"), F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))).alias("qb"))
    query = asked.select(F.col("vec").alias("qvec"), F.col("e").alias("qid"), pick(q_blocks, 2).alias("qb"),
                         F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("cb"))
    found = query.groupBy("cb", "qb").cogroup(cand.groupBy("cb", "qb")).applyInPandas(
        _search(rotation, float(longest), radius, k), "qid long, id long, score double")
    # back to every asking id: its own row goes, k remain
    asking = good.where(F.col("id") % every == 0).select(F.col("id").alias("query_id"), "vec").distinct()
    asker = asking.join(asked.select("vec", F.col("e").alias("a")), "vec").select("a", "query_id")
    pairs = asker.join(found, F.col("a") == F.col("qid")).where(F.col("id") != F.col("query_id"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return (pairs.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", "rank", F.col("id").alias(id_col), "score"))


def _distinct(good: DataFrame, k: int, every: int) -> DataFrame:
    """(vec, ids, asked): the k + 1 smallest ids of each vector and whether any
    of its ids asks.  Of the asking and of the other ids, every task keeps the
    k + 1 smallest before the shuffle by vector (a window group limit), so
    copies that make up a third of the table do not meet in one task."""
    each = good.groupBy("vec", "id").agg((F.col("id") % every == 0).alias("asks"))
    by = Window.partitionBy("vec", "asks").orderBy("id")
    least = each.withColumn("r", F.row_number().over(by)).where(F.col("r") <= k + 1)
    return least.groupBy("vec").agg(F.slice(F.sort_array(F.collect_list("id")), 1, k + 1).alias("ids"), F.max("asks").alias("asked"))


def _search(rotation: np.ndarray, longest: float, radius: int, k: int):
    """The k best of one block of candidates for one block of queries."""

    def run(query: pd.DataFrame, cand: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(query) and len(cand):
            x = np.array(cand["vec"].tolist(), dtype=np.float64)
            q = np.array(query["qvec"].tolist(), dtype=np.float64)
            index, cq = Index(codes(_completed(x, longest), rotation)), codes(_asked(q), rotation)
            first = np.array([i[0] for i in cand["ids"]], dtype=np.int64)
            ids = cand["ids"].tolist()
            for i, qid in enumerate(query["qid"].tolist()):
                at = index.at_least(cq[i], radius, k + 1)
                score = x[at] @ q[i]
                top = at[np.lexsort((first[at], -score))[:k + 1]]
                rows = [(qid, int(j), float(np.dot(x[p], q[i]))) for p in top for j in ids[p]]
                out += sorted(rows, key=lambda r: (-r[2], r[1]))[:k + 1]
        return pd.DataFrame(out, columns=["qid", "id", "score"])

    return run
