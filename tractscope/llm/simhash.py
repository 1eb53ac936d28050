"""SimHash near-duplicates by deletion-variant signatures.

* **Fingerprint.** Words of the lower-cased text (A-Z), shingles of ``SHINGLE``
  words with repeats; bit i is set if it is set in over half the shingles'
  64-bit hashes.
* **Signatures.** 64 bits are cut into three segments; of two fingerprints at
  most 4 bits apart, one segment differs in at most one bit.  Each segment is
  indexed under every variant with one bit struck out, so such segments share a
  variant: 64 variants per distinct fingerprint, joined by equality.
* **Verifying.** Within a variant's bucket, pairs are compared bit by bit in
  vector blocks; of a bucket of more than 32 rows only a spanning forest of the
  links goes on (the same components, no pair list).  A bucket larger than ``CELL`` is dealt into
  slices, and each pair of slices is a task's cell, so no bucket is gathered
  whole and no link is lost.
* **Components.** Large-star and small-star rounds on the forest's edges until
  every member points at its component's smallest fingerprint.

Copies share one fingerprint and enter the search once.

Defined cases: a null or empty text has fingerprint zero and is linked like any
other; a null id is never a component id unless all ids of the component are
null; repeated rows keep one row each; an empty table gives an empty result;
other columns are carried by :func:`keep_one` and ignored otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, saved, ship_package

SHINGLE = 4
MAX_BITS = 4
SEED = 42
SEGMENTS = ((0, 22), (22, 21), (43, 21))   # (lowest bit, width): three, as 4 // 3 == 1
CELL = 2048                                # rows of a bucket compared in one go
VARIANTS = 64                              # per fingerprint
TASK_ROWS = 8 << 20                        # index rows of a task, at most on average
BATCH_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of a whole text."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split()
    n = len(words) - shingle + 1
    if not words:
        return 0
    if n <= 1:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    line, hashed = b" ".join(words), xxhash.xxh64_intdigest
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1
    start = np.cumsum(size) - size
    end = start[shingle - 1:] + size[shingle - 1:] - 1
    h = np.array([hashed(line[a:b], SEED) for a, b in zip(start[:n].tolist(), end.tolist())], dtype="<u8")
    count = np.zeros(64, dtype=np.int64)
    for a in range(0, n, 1 << 16):  # bits of a block of hashes at a time
        count += np.unpackbits(h[a:a + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * count > n, bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, th, fp): fingerprints as signed longs, with a hash of the text; saved."""

    def run(cols: dict[str, list]) -> dict[str, list]:
        fps = [fingerprint(t or "", shingle) for t in cols["text"]]
        return {"id": cols["id"], "th": cols["th"], "fp": [f - (1 << 64) if f >= 1 << 63 else f for f in fps]}

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
    return saved(map_rows(rows, run, f"id {kind}, th long, fp long"))


def _variants(fps: DataFrame) -> DataFrame:
    """(key, fp): every fingerprint under its 64 one-wildcard segment variants.

    The key holds the segment without the struck bit, and the bit's number."""
    keys = []
    for low, width in SEGMENTS:
        segment = F.shiftrightunsigned("fp", low).bitwiseAND(F.lit((1 << width) - 1))
        for bit in range(width):
            rest = segment.bitwiseAND(F.lit(((1 << width) - 1) ^ (1 << bit)))
            keys.append(rest * 64 + F.lit(low + bit))
    return fps.select(F.explode(F.array(*keys)).alias("key"), "fp")


def _links_small(cell: np.ndarray, fp: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Verified pairs of sorted cells, neighbour distance by neighbour distance."""
    left, right = [], []
    for step in range(1, len(fp)):
        same = cell[step:] == cell[:-step]
        if not same.any():
            break
        at = np.flatnonzero(same)
        at = at[np.bitwise_count(fp[at] ^ fp[at + step]) <= max_bits]
        left.append(at)
        right.append(at + step)
    none = np.empty(0, dtype=np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def _forest_of_cell(fp: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """A spanning forest of one large cell's links: from each row found, the
    rows not found yet are compared, so a dense cell is done after few rows."""
    out, unseen = [], np.arange(len(fp))
    while len(unseen):
        queue, unseen = [int(unseen[0])], unseen[1:]
        while queue and len(unseen):
            i = queue.pop()
            near = np.bitwise_count(fp[unseen] ^ fp[i]) <= max_bits
            found = unseen[near].tolist()
            unseen = unseen[~near]
            out += [(i, j) for j in found]
            queue += found
    return out


def _cell_edges(cell: np.ndarray, fp: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Forest edges (smaller, larger fingerprint) of whole cells, sorted by cell."""
    edge = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1], [True]]))
    sizes = np.diff(edge)
    large = sizes > 32
    small = np.repeat(~large, sizes)
    a, b = _links_small(cell[small], fp[small], max_bits)
    pairs = [(fp[small][a], fp[small][b])]
    for s, n in zip(edge[:-1][large].tolist(), sizes[large].tolist()):
        own = fp[s:s + n]
        links = np.array(_forest_of_cell(own, max_bits), dtype=np.int64).reshape(-1, 2)
        pairs.append((own[links[:, 0]], own[links[:, 1]]))
    x, y = np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs])
    x, y = x.view(np.int64), y.view(np.int64)
    both = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1), axis=0) if len(x) else np.empty((0, 2), dtype=np.int64)
    return both[:, 0], both[:, 1]


def _verify(max_bits: int):
    """Cells sorted by (key, part) within a partition; cells may cross batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_cell, held_fp = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64)

        def made(cell: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            x, y = _cell_edges(cell, fp, max_bits)
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], ["u", "v"])

        for batch in batches:
            if not batch.num_rows:
                continue
            cell = np.concatenate([held_cell, batch.column(0).to_numpy()])
            fp = np.concatenate([held_fp, batch.column(1).to_numpy().view(np.uint64)])
            cut = int(np.searchsorted(cell != cell[-1], False)) if cell[0] == cell[-1] else int(np.flatnonzero(cell != cell[-1])[-1]) + 1
            if cut:
                yield made(cell[:cut], fp[:cut])
            held_cell, held_fp = cell[cut:], fp[cut:]
        if len(held_fp):
            yield made(held_cell, held_fp)

    return run


def links(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(u, v), u < v: a graph with the components of "at most ``max_bits`` bits
    apart" over the distinct fingerprints ``fps`` (column fp); saved."""
    if max_bits // len(SEGMENTS) > 1:
        raise ValueError(f"{len(SEGMENTS)} segments with one wildcard find at most {2 * len(SEGMENTS) - 1} bits")
    spark = fps.sparkSession
    ship_package(spark)
    variants = _variants(fps)
    sizes = saved(variants.groupBy("key").count().where(F.col("count") > CELL).select(
        F.col("key").alias("hot"), F.ceil(F.col("count") / (CELL // 2)).cast("int").alias("slices")))
    n_hot = sizes.count()
    cells = variants.withColumn("cell", F.col("key"))
    if n_hot:
        hot = F.broadcast(sizes) if n_hot <= 100_000 else sizes
        cells = variants.join(hot, F.col("key") == F.col("hot"), "left")
        mine = F.pmod(F.xxhash64("fp"), F.col("slices").cast("long"))
        others = F.sequence(F.lit(0).cast("long"), (F.col("slices") - 1).cast("long"))
        cell = F.transform(others, lambda o: F.xxhash64("key", F.least(mine, o), F.greatest(mine, o)))
        cells = cells.select("fp", F.explode(F.when(F.col("slices").isNull(), F.array("key")).otherwise(cell)).alias("cell"))
    # the tasks follow the rows: a fixed number is neither split nor merged later
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-fps.count() * VARIANTS // TASK_ROWS))
    dealt = cells.select("cell", "fp").repartition(tasks, "cell").sortWithinPartitions("cell", "fp")
    caller = spark.conf.get(BATCH_CONF)
    spark.conf.set(BATCH_CONF, "65536")
    try:
        return saved(dealt.mapInArrow(_verify(max_bits), "u long, v long").distinct())
    finally:
        spark.conf.set(BATCH_CONF, caller)


def components(edges: DataFrame) -> DataFrame:
    """(node, root): every node of the edges (u, v) with its component's smallest
    node, by alternating star rounds; each round is an aggregate and an equality
    join, saved so that the lineage stays one round long."""
    now = edges.select("u", "v")
    before = None
    while True:
        # large star: larger neighbours hang onto the smallest of the neighbourhood
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, F.col("u") == F.col("n")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small star: smaller neighbours and the node itself hang onto the smallest of them
        down = large.distinct()
        low = down.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), "m")
        small = down.join(low, F.col("u") == F.col("n")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        now = saved(small.unionAll(low.select(F.col("n").alias("u"), F.col("m").alias("v"))).select(
            F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if before == (state.n, state.h):
            break
        before = (state.n, state.h)
    stars = now.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")
    return stars.unionAll(stars.select(F.col("root").alias("node"), "root").distinct())


def grouped(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(fp, component_id, keep): each distinct fingerprint with the smallest id
    of its component and the (id, th) of the component's first row."""
    first = F.min(F.struct(F.col("id").isNull().alias("no"), "id", "th"))
    reps = saved(prints.groupBy("fp").agg(first.alias("first")))
    edges = links(reps.select("fp"), max_bits)
    roots = components(edges)
    rooted = reps.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first", F.col("root"))
    of_root = rooted.where("root is not null").groupBy(F.col("root").alias("r")).agg(F.min("first").alias("all_first"))
    joined = rooted.where("root is not null").join(of_root, F.col("root") == F.col("r")).select("fp", F.col("all_first").alias("keep"))
    alone = rooted.where("root is null").select("fp", F.col("first").alias("keep"))
    return joined.unionAll(alone).select("fp", F.col("keep.id").alias("component_id"), "keep")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                    max_bits: int = MAX_BITS) -> DataFrame:
    """One row per document: id, fingerprint (16 hex digits), component_id."""
    prints = fingerprints(docs, id_col, text_col, shingle)
    groups = grouped(prints, max_bits).withColumnRenamed("fp", "g_fp")
    out = prints.join(groups, F.col("fp") == F.col("g_fp"))
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
             max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with the first row of each component (smallest id), all columns
    as they are; other rows of the component, repeats included, go."""
    prints = fingerprints(docs, id_col, text_col, shingle)
    # one column for both keys, nulls equal: rows the join brought together are also where repeats are dropped
    kind = f"struct<id:{docs.schema[id_col].dataType.simpleString()},th:bigint>"
    row = F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th")).cast(kind)
    keep = grouped(prints, max_bits).select(F.struct("keep.id", "keep.th").cast(kind).alias("__keep")).distinct()
    kept = docs.withColumn("__row", row).join(keep, F.col("__row") == F.col("__keep"), "left_semi")
    return kept.dropDuplicates(["__row"]).select(*[F.col(f"`{c}`") for c in docs.columns])
