"""Helpers that run inside tasks: Arrow batches in pieces of bounded bytes."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearsay.session import scratch_path, ship_package

SLICE_BYTES = 2 << 20


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text",
                max_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each slice holds about ``max_bytes`` of text, one row at least.

    A row is never cut: a single very long text is a slice of its own.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).tolist()
        start = total = 0
        for i, n in enumerate(sizes):
            if total and total + n > max_bytes:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        yield batch.slice(start)


def _trimmed() -> None:
    """Give memory that a task has freed back to the system: the worker stays, and others run beside it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)      # of glibc
    if trim:
        trim(0)


def map_arrow(df: DataFrame, function, schema: str) -> DataFrame:
    """``mapInArrow`` with the package at hand in every Python worker, which holds no freed memory between tasks."""
    ship_package(df.sparkSession)

    def run(batches):
        yield from function(batches)
        _trimmed()

    return df.mapInArrow(run, schema)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared scratch folder and read it back.

    Cuts lineage so that later jobs reuse the rows instead of computing them
    again; the files outlive a lost executor.
    """
    spark: SparkSession = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


FILTER_BITS = 25            # at most 2**25 bits, 4 MB, whatever the number of ids
BITS_PER_ID = 16


class IdFilter:
    """A Bloom filter over ids, of bounded size, to tell rows apart before a join.

    Says no only of ids that it does not hold. Beyond about two million ids it
    says yes more and more often; then more rows take part in the join that
    follows, and results stay the same.
    """

    def __init__(self, ids: DataFrame, column: str):
        hashed = ids.select(F.xxhash64(column).alias("h"))
        self.bits = min(FILTER_BITS, max(10, (BITS_PER_ID * hashed.count()).bit_length()))
        mask = F.lit((1 << self.bits) - 1)
        places = hashed.select(F.explode(F.array(
            F.col("h").bitwiseAND(mask), F.shiftrightunsigned("h", 32).bitwiseAND(mask))).alias("p"))
        words = places.groupBy(F.expr("shiftright(p, 5)").alias("w")).agg(
            F.expr("bit_or(shiftleft(1L, cast(p & 31 as int)))").alias("b")).toPandas()
        self.words = np.zeros(1 << (self.bits - 5), np.uint32)
        self.words[words["w"].to_numpy(np.int64)] = words["b"].to_numpy(np.int64).astype(np.uint32)

    def maybe(self, hashes: np.ndarray) -> np.ndarray:
        h, mask = hashes.view(np.uint64), np.uint64((1 << self.bits) - 1)
        found = np.ones(len(h), bool)
        for place in (h & mask, (h >> np.uint64(32)) & mask):
            found &= (self.words[(place >> np.uint64(5)).astype(np.int64)] >> (place & np.uint64(31)).astype(np.uint32)) & np.uint32(1) == 1
        return found

    def rows(self, df: DataFrame, column: str, held: bool = True) -> DataFrame:
        """The rows whose id the filter may hold, or with ``held=False`` the others."""
        names = [f"_c{i}" for i in range(len(df.columns))]
        chosen = df.select(F.xxhash64(F.col(column)).alias("_h"), *(df[c].alias(n) for c, n in zip(df.columns, names)))
        schema = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, df.schema.fields))

        def run(batches):
            for batch in batches:
                keep = self.maybe(batch.column(0).to_numpy()) == held
                yield pa.RecordBatch.from_arrays(batch.columns[1:], names=names).filter(pa.array(keep))

        return map_arrow(chosen, run, schema).select(*(F.col(n).alias(c) for c, n in zip(df.columns, names)))
