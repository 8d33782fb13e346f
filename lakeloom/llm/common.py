"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import re
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which all executors share.

    Where it is unset a local master (tests) gets a temporary folder; a cluster has none that all share, so that is an error.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if named is None and sc.getCheckpointDir() is None:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="lakeloom-checkpoint-"))
    if named is not None and sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named or sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder; its files go when the result is no longer referenced."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def giving_back(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` for ``mapInArrow``, whose task ends by giving the memory it freed back to the system.

    Python workers stay for later tasks and stages, and what their allocators keep would count beside the JVM's.
    """

    def wrapped(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
        if trim:
            trim(0)

    return wrapped


def arrow_rows(df: DataFrame, rows: Callable[..., Iterator[dict]], schema: str, slice_bytes: int = 4 << 20, sized: str | None = None, give_back: bool = False) -> DataFrame:
    """``mapInArrow`` where ``rows(columns) -> dict of lists`` sees slices of bounded bytes.

    ``columns`` holds one Python list per input column.  A slice ends once its bytes reach
    ``slice_bytes``, so one long text never drags others into memory with it; only the slice's values
    become Python objects.  ``sized`` names the column that counts, the first of strings or bytes by itself.
    ``give_back`` is for large slices: see ``giving_back``.
    """
    from pyspark.sql.types import _parse_datatype_string
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches):
        for batch in batches:
            for lo, hi in _slices(batch, slice_bytes, sized):
                part = batch.slice(lo, hi - lo)
                for out in rows(*[c.to_pylist() for c in part.columns]):
                    yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(giving_back(run) if give_back else run, schema)


def _slices(batch: pa.RecordBatch, slice_bytes: int, sized: str | None) -> Iterator[tuple[int, int]]:
    texts = [f.name for f in batch.schema if pa.types.is_string(f.type) or pa.types.is_binary(f.type) or pa.types.is_large_string(f.type) or pa.types.is_large_binary(f.type)]
    name = sized or (texts[0] if texts else None)
    sizes = pc.fill_null(pc.binary_length(batch.column(name)), 0).to_pylist() if name else [8] * batch.num_rows
    return cuts(sizes, slice_bytes)


def slices(columns: list[list], n: int, slice_bytes: int) -> Iterator[tuple[int, int]]:
    """``cuts`` by the characters of the first column of strings or bytes."""
    sized = next((c for c in columns if any(isinstance(x, (str, bytes)) for x in c)), None)
    return cuts([len(x or "") for x in sized] if sized is not None else [8] * n, slice_bytes)


def cuts(sizes: list[int], slice_bytes: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive items; one ends with the item that brings its sizes to ``slice_bytes``."""
    lo = size = 0
    for i, x in enumerate(sizes):
        size += x
        if size >= slice_bytes:
            yield lo, i + 1
            lo, size = i + 1, 0
    if lo < len(sizes):
        yield lo, len(sizes)


def unused(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` does not have, in any case of its letters."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def remainder(key, n: int):
    """crc32 of the id written as text, modulo ``n`` (a null id counts as the empty text)."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % n


#: Logarithm of the bits of the bitmap of ``among``: 2 MB, whatever the number of keys.
FILTER_BITS = 24


def among(rows: DataFrame, key: str, keys: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """The rows whose ``key`` may be one of the first column of ``keys``: all that are, and some others.

    A bitmap of hashed keys of fixed size goes to the tasks, so that rows which no join wants are not
    shuffled.  With many more keys than bits nearly all rows pass, and the join that follows decides.
    """

    def slot(c):
        return F.pmod(F.xxhash64(c), F.lit(1 << bits))

    one = keys.select(slot(F.col(keys.columns[0])).alias("slot"))
    # at most 2^bits / 64 rows
    bitmap = one.groupBy((F.col("slot") / 64).cast("long").alias("__word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("slot").cast("int") % 64)).alias("__mask"))
    held = rows.join(F.broadcast(bitmap), (slot(F.col(key)) / 64).cast("long") == F.col("__word"))
    return held.where(F.call_function("shiftrightunsigned", F.col("__mask"), slot(F.col(key)).cast("int") % 64).bitwiseAND(1) == 1).drop("__word", "__mask")


def connected_components(edges: DataFrame) -> DataFrame:
    """Smallest reachable vertex of each vertex of undirected ``edges(a, b)``: rows ``(v, component)``.

    Minimum labels of neighbours, then labels of labels (pointer jumping), until nothing changes;
    every round reads and writes distributed tables, so no component meets in one task.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = cut_lineage(both)
    label = cut_lineage(both.groupBy(F.col("a").alias("v")).agg(F.least(F.first("a"), F.min("b")).alias("component")))
    if label.isEmpty():
        return label
    while True:
        near = both.join(label.withColumnRenamed("v", "b"), "b").groupBy(F.col("a").alias("v")).agg(F.min("component").alias("near"))
        step = label.join(near, "v").select("v", F.col("component").alias("old"), F.least("component", "near").alias("mid"))
        top = step.select(F.col("v").alias("mid"), F.col("mid").alias("component"))
        step = cut_lineage(step.join(top, "mid").select("v", "old", "component"))
        label = step.select("v", "component")
        if step.where("old <> component").isEmpty():
            return label
