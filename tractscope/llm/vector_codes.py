"""Vector compression by product codes, the nearest entry found by equal-average search.

Vectors become integers (``floor(SCALE * x)``) and are cut into ``PARTS`` equal
consecutive parts; each part position has a codebook of at most ``ENTRIES``
entries, refined in ``ROUNDS`` rounds of assigning every part to its nearest
entry (ties to the lower index) and replacing entries by the floored mean of
their parts.  Everything is integer arithmetic, so results do not depend on
partitioning or order.

Equal-average search: entries are sorted by the sum of their components.  From
the part's own sum the search goes outward, the nearer sum first on either
side; since (sum gap)^2 / dimension is a lower bound of the squared distance, a
side ends once that bound strictly exceeds the best distance (strictly, so
ties are seen), and no entry that could win is left out.

Defined cases: rows whose vector is null, empty, or holds null or non-finite
components take no part, nor do vectors of another length than the most common
one (ties: the shorter); components beyond a bound (131,072 at 64 of them) count
as that bound, so that squared distances fit 64 bits; where the length is no
multiple of ``PARTS`` the first parts are one component longer.  Rows with equal ids, or null ids (after all others), follow each other
by their components.  Fewer than ``ENTRIES`` rows give fewer entries; an
empty table gives an empty result; null labels are one label; other columns,
whatever their names, take no part.

Scale: integer vectors are written once; each round is one pass over them with
the codebooks (at most 4 x 256 entries) sent to the tasks, and at most one
row of sums per task, part and entry is shuffled.  No vector is gathered but
the ``ENTRIES`` first ones.  A label may hold any share of the rows: its sums
are combined before the shuffle and joined back by a size-checked join.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.joins import join_small
from .common import arrow_batches, saved

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
SEARCH_ROWS = 4096   # searched together
FAR = 1 << 60        # beyond any sum of components


def bounds(dim: int, parts: int = PARTS) -> list[tuple[int, int]]:
    """[from, to) of each part."""
    sizes = [dim // parts + (p < dim % parts) for p in range(parts)]
    ends = np.cumsum(sizes).tolist()
    return [(e - s, e) for e, s in zip(ends, sizes)]


class Codebook:
    """Entries of one part position, ready for equal-average search."""

    def __init__(self, entries: np.ndarray):
        sums = entries.sum(axis=1)
        self.order = np.lexsort((np.arange(len(entries)), sums))
        self.sorted = entries[self.order]
        # a sum no part comes near at either end: the search stops there
        self.sums = np.concatenate([[-FAR], sums[self.order], [FAR]])

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of each row's nearest entry."""
        n, dim = len(x), max(1, x.shape[1])
        largest = max(int(np.abs(x).max(initial=0)), int(np.abs(self.sorted).max(initial=0)))
        # doubles hold the squared distances exactly (and faster) while they stay below 2^53
        kind = np.float64 if 4 * largest * largest * dim < 1 << 53 else np.int64
        entries, x = self.sorted.astype(kind), x.astype(kind)
        own = x.sum(axis=1).astype(np.int64)
        up = np.searchsorted(self.sums, own)
        down = up - 1
        rows = np.arange(n)
        best, index = np.full(n, np.iinfo(np.int64).max, dtype=np.int64), np.full(n, len(entries), dtype=np.int64)
        near, entry = best.copy(), index.copy()      # of the rows still searching
        while len(rows):
            above, below = self.sums[up] - own, own - self.sums[down]
            rising = above <= below
            # (sum gap)^2 / dim > best: no entry further out on either side can win; the margin covers the rounding of doubles
            gap = np.where(rising, above, below).astype(np.float64)
            on = (gap < FAR / 2) & (gap * gap <= near.astype(np.float64) * dim * (1 + 1e-9))
            # a row that is done may go on (nothing it meets can win) until an eighth of them are
            if 8 * np.count_nonzero(on) <= 7 * len(on):
                best[rows[~on]], index[rows[~on]] = near[~on], entry[~on]
                rows, x, own, up, down, near, entry, rising = (v[on] for v in (rows, x, own, up, down, near, entry, rising))
                if not len(rows):
                    break
            at = np.clip(np.where(rising, up, down) - 1, 0, len(entries) - 1)
            diff = x - entries[at]
            dist = np.einsum("ij,ij->i", diff, diff).astype(np.int64)
            tried = self.order[at]
            won = (dist < near) | (dist == near) & (tried < entry)
            near, entry = np.where(won, dist, near), np.where(won, tried, entry)
            up, down = np.minimum(up + rising, len(entries) + 1), np.maximum(down - (~rising), 0)
        return index, best


def integer_vectors(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, vec as integers, label) of the rows that take part, all of one length, written once."""
    v = F.col("v")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = table.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v"), F.col(label_col).alias("label"))
    rows = rows.where(v.isNotNull() & (F.size(v) > 0) & ~bad)
    # (2 * clamp)^2 * length stays below 2^62
    clamp = F.floor(F.sqrt(F.lit(2.0 ** 60) / F.size(v))).cast("double")
    whole = F.transform(v, lambda x: F.floor(F.greatest(-F.col("clamp"), F.least(F.col("clamp"), x * SCALE))).cast("long"))
    good = saved(rows.withColumn("clamp", clamp).select("id", whole.alias("vec"), "label"))
    modal = good.groupBy(F.size("vec").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    return good.where(F.size("vec") == (modal["dim"] if modal else 0))


def _matrices(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows of several batches with their vectors as a matrix, ``SEARCH_ROWS`` or a little more at a time."""
    held, rows = [], 0

    def taken() -> tuple[pa.Table, np.ndarray]:
        table = pa.Table.from_batches(held)
        return table, table.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1)

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            rows += batch.num_rows
            if rows >= SEARCH_ROWS:
                yield taken()
                held, rows = [], 0
    if rows:
        yield taken()


def _refined(vectors: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """Codebooks after one round: floored means of the parts nearest each entry; unused entries stay."""
    cuts = bounds(sum(b.shape[1] for b in books), len(books))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = [Codebook(b) for b in books]
        sums = [np.zeros((len(b), b.shape[1] + 1), dtype=np.int64) for b in books]  # the last column counts
        for _, x in _matrices(batches):
            for (a, e), book, total in zip(cuts, search, sums):
                index, _ = book.nearest(x[:, a:e])
                np.add.at(total, index, np.hstack([x[:, a:e], np.ones((len(x), 1), dtype=np.int64)]))
        for p, total in enumerate(sums):
            entry, pos = np.nonzero(np.repeat(total[:, -1:] > 0, total.shape[1], axis=1))
            if len(entry):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(entry), p, dtype=np.int32)), pa.array(entry.astype(np.int32)),
                                                  pa.array(pos.astype(np.int32)), pa.array(total[entry, pos])], names=["part", "entry", "pos", "s"])

    tasks = vectors.select("vec").mapInArrow(run, "part int, entry int, pos int, s long")
    out = [b.copy() for b in books]
    totals = [np.zeros((len(b), b.shape[1] + 1), dtype=np.int64) for b in books]
    for r in tasks.groupBy("part", "entry", "pos").agg(F.sum("s").alias("s")).collect():  # at most entries * (length + parts)
        totals[r["part"]][r["entry"], r["pos"]] = r["s"]
    for book, total in zip(out, totals):
        used = total[:, -1] > 0
        book[used] = total[used, :-1] // total[used, -1:]
    return out


def learn_codebooks(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    """The codebook of each part position, from :func:`integer_vectors`; none for an empty table."""
    arrow_batches(vectors.sparkSession)
    first = vectors.orderBy(F.col("id").asc_nulls_last(), "vec").limit(entries).collect()
    if not first:
        return []
    x = np.array([r["vec"] for r in first], dtype=np.int64)
    books = [x[:, a:e] for a, e in bounds(x.shape[1], parts)]
    for _ in range(rounds):
        books = _refined(vectors, books)
    return books


def encode(vectors: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """(id, label, code, error): the nearest entry of each part as two hex digits, and the squared distances' sum."""
    arrow_batches(vectors.sparkSession)
    id_kind, label_kind = (vectors.schema[c].dataType.simpleString() for c in ("id", "label"))
    cuts = bounds(sum(b.shape[1] for b in books), len(books))
    if any(len(b) > 256 for b in books):
        raise ValueError("a code byte names at most 256 entries")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = [Codebook(b) for b in books]
        for table, x in _matrices(batches):
            near = [book.nearest(x[:, a:e]) for (a, e), book in zip(cuts, search)]
            code = np.stack([i for i, _ in near], axis=1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays(
                [table.column(0).combine_chunks(), table.column(1).combine_chunks(), pa.array([bytes(c).hex() for c in code]),
                 pa.array(sum(d for _, d in near))], names=["id", "label", "code", "error"])

    return vectors.select("id", "label", "vec").mapInArrow(run, f"id {id_kind}, label {label_kind}, code string, error long")


def decode(codes: Iterable[str], books: list[np.ndarray]) -> np.ndarray:
    """The vectors that codes stand for, as real numbers."""
    index = np.array([list(bytes.fromhex(c)) for c in codes], dtype=np.int64).reshape(-1, len(books))
    return np.hstack([b[index[:, p]] for p, b in enumerate(books)]) / SCALE


def codebooks_digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(v) for b in books for v in b.ravel().tolist()).encode()).hexdigest()


def compress_vectors(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per vector that takes part: (id, code, error, label_error, codebooks_sha256)."""
    vectors = integer_vectors(table, id_col, vec_col, label_col)
    books = learn_codebooks(vectors)
    if not books:
        return vectors.select(F.col("id").alias(id_col), F.lit("").alias("code"), F.lit(0).cast("long").alias("error"),
                              F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    same = F.coalesce(F.col("label").cast("string"), F.lit(""))
    coded = saved(encode(vectors, books)).withColumn("known", F.col("label").isNotNull()).withColumn("same", same)
    by_label = coded.groupBy("known", "same").agg(F.sum("error").alias("label_error"))
    joined = join_small(coded, by_label, ["known", "same"], "inner")
    return joined.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(codebooks_digest(books)).alias("codebooks_sha256"))
