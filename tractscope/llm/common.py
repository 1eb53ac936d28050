"""Helpers shared by the training-data operators.

Python stages run as ``mapInArrow`` over record batches; how many rows a
batch holds is bounded by :func:`arrow_batches`, so a run of very long texts
cannot build one huge batch.  Native stages share :func:`regex_spans`.
"""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ensure_checkpoint_dir

BATCH_ROWS = 512          # rows in an Arrow batch
BATCH_BYTES = 32 << 20    # and bytes, whichever is reached first


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of the data folder, through Spark's reader only."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def arrow_batches(spark: SparkSession) -> None:
    """Make Python tasks ready: sources sent, Arrow batches bounded by rows and bytes (a session setting: it changes
    no result, only how many rows a Python task holds at a time)."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package's sources to the executors (once per application), so
    Python tasks can import it where it is not installed."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    top = Path(__file__).resolve().parent.parent
    archive = Path(tempfile.mkdtemp(prefix="tractscope-")) / "tractscope_src.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f.relative_to(top.parent))
    sc.addPyFile(str(archive))
    _SHIPPED.add(sc.applicationId)


def saved(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared checkpoint folder: later stages read
    the files, so a lost executor costs no recomputation of what came before
    and no second pass over the texts."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def map_rows(df: DataFrame, fn: Callable[[dict[str, list]], dict[str, list]], schema: str | T.StructType,
             init: Callable[[], object] | None = None) -> DataFrame:
    """``fn`` over Arrow batches as columns of Python values.

    ``fn`` takes ``{column: values}`` and returns the output columns (the
    number of rows may change).  ``init`` runs once per task, its result is
    the second argument of ``fn``.
    """
    arrow_batches(df.sparkSession)
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    target = arrow_schema(schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        extra = () if init is None else (init(),)
        for batch in batches:
            if batch.num_rows:
                out = fn({n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)}, *extra)
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in target], schema=target)

    return df.mapInArrow(run, schema)


def regex_spans(text: Column, pattern: str, gate: Column | None = None, groups: tuple[int, ...] = (0,),
                context: int = 0) -> Column:
    """Leftmost non-overlapping matches of ``pattern`` as an array of structs,
    in SQL functions only.

    Fields: ``start`` and ``end`` (code points, end exclusive), ``g<k>`` for
    each group asked for, and with ``context`` the ``before`` and ``after``
    text around the match, up to the neighbouring matches.  ``gate`` is a
    cheap test that holds for every text with a match; other texts skip the
    work.  A null text has no span.

    The texts between the matches (``split``) and the matches themselves
    alternate, so a running sum of both lengths gives the positions.
    """
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    fields = {"part": F.split(text, pattern, -1), "hit": whole}
    for g in groups:
        fields[f"g{g}"] = whole if g == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(g))
    if context:
        parts = F.split(text, pattern, -1)
        fields["next"] = F.slice(parts, F.lit(2), F.size(parts))
    kind = "struct<start:int,end:int," + ",".join(f"g{g}:string" for g in groups)
    kind += ",before:string,after:string>" if context else ">"

    def shape(r: Column, at: Column) -> Column:
        start = at + F.length(r["part"])
        out = [start.alias("start"), (start + F.length(r["hit"])).alias("end"), *[r[f"g{g}"].alias(f"g{g}") for g in groups]]
        if context:
            out += [F.right(r["part"], F.lit(context)).alias("before"), F.left(r["next"], F.lit(context)).alias("after")]
        return F.struct(*out)

    def located(rows: Column) -> Column:
        used = F.transform(rows, lambda r: F.length(r["part"]) + F.length(r["hit"]))
        return _let(used, lambda u: _let(sums_before(u), lambda at: F.transform(rows, lambda r, i: shape(r, F.get(at, i)))))

    rows = F.filter(F.arrays_zip(*[c.alias(n) for n, c in fields.items()]), lambda r: r["hit"].isNotNull())
    found = _let(rows, located).cast(f"array<{kind}>")
    gate = F.lit(True) if gate is None else gate
    return F.when(text.isNotNull() & gate, found).otherwise(F.array().cast(f"array<{kind}>"))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, as a lambda's argument."""
    return F.transform(F.array(value), use)[0]


SUM_CHUNK = 128


def sums_before(numbers: Column) -> Column:
    """For each element of an array, the sum of those before it."""
    return folded_before(numbers, lambda a, x: a + x)


def folded_before(numbers: Column, fold: Callable[[Column, Column], Column]) -> Column:
    """For each element of an array, those before it and 0 folded by an
    associative function that 0 does not change (a sum, a maximum).

    Adding to an array copies it, so folds run within chunks and over the
    chunks' results: a text of many matches does not cost their square."""
    def running(c: Column) -> Column:
        return F.aggregate(c, F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(fold(F.element_at(a, -1), x))))

    last = F.floor(F.size(numbers) / SUM_CHUNK).cast("int")
    chunks = F.transform(F.sequence(F.lit(0), last), lambda k: running(F.slice(numbers, k * SUM_CHUNK + 1, F.lit(SUM_CHUNK))))

    def joined(cs: Column) -> Column:
        offsets = running(F.transform(cs, lambda c: F.element_at(c, -1)))
        return _let(offsets, lambda o: F.flatten(F.transform(cs, lambda c, k: F.transform(
            F.slice(c, F.lit(1), F.size(c) - 1), lambda x: fold(F.get(o, k), x)))))

    return _let(chunks, joined)


def spans_text(spans: Column) -> Column:
    """``kind:start:end`` comma-joined, from an array of structs with those fields."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def remove_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder of intermediate data, wherever Spark stores it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
