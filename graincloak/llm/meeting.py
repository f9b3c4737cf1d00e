"""Vectors meet queries, shard by shard.

``meet`` sends rows and queries to the tasks of their shards. Within a task they arrive in order of shard, rows first, so a
shard's rows are made into an index once and its queries stream past it in small batches: a task holds one shard and one
batch. Nothing passes through the driver and nothing is broadcast.
"""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHARD = 64 << 20  # bytes of a shard's vectors, as doubles
LEAST = 1024  # rows that make a shard of their own worth it
BATCH = 256  # queries at a time


def finite(vector: Column) -> Column:
    """Whether a vector is there and has numbers in all places."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))


def shards(rows: DataFrame, vector: str) -> int:
    """As many shards as keep each below ``SHARD`` bytes; more where cores would stay idle. Results don't depend on it."""
    n, numbers = rows.agg(F.count("*"), F.sum(F.size(vector))).first()
    return max(1, -(-8 * (numbers or 0) // SHARD), min(rows.sparkSession.sparkContext.defaultParallelism, n // LEAST))


def matrix(column: pa.ListArray) -> np.ndarray:
    """Vectors of one length as rows of doubles, without negative zeros."""
    size = len(column.flatten()) // max(len(column), 1)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), size) + 0.0


def by_length(batch: pa.RecordBatch, vector: str) -> Iterator[pa.RecordBatch]:
    sizes = batch.column(vector).value_lengths().to_numpy(zero_copy_only=False)
    for size in np.unique(sizes):
        yield batch if (sizes == size).all() else batch.take(pa.array(np.flatnonzero(sizes == size)))


def meet(rows: DataFrame, queries: DataFrame, parts: int, index: Callable, answer: Callable, schema: str) -> DataFrame:
    """``answer(index(rows of a shard), some of its queries)`` gives the arrays of ``schema``. Both tables have a column
    ``shard`` and vectors ``v``; in one shard, only vectors of one length meet."""
    both = rows.withColumn("asks", F.lit(False)).unionByName(queries.withColumn("asks", F.lit(True)), allowMissingColumns=True)
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        at, held, made = None, [], {}
        for batch in batches:
            shard = batch.column("shard").to_numpy(zero_copy_only=False)
            asks = batch.column("asks").to_numpy(zero_copy_only=False)
            ends = np.append(np.flatnonzero((shard[1:] != shard[:-1]) | (asks[1:] != asks[:-1])) + 1, len(shard))
            start = 0
            for end in ends:
                piece, here = batch.slice(start, end - start), shard[start]
                if here != at:
                    at, held, made = here, [], {}
                if not asks[start]:
                    held.append(piece)
                else:
                    if held:
                        whole = pa.Table.from_batches(held).combine_chunks().to_batches()
                        made = {len(p.column("v")[0]): index(p) for b in whole for p in by_length(b, "v")}
                        held = []
                    for i in range(0, len(piece), BATCH):
                        for some in by_length(piece.slice(i, BATCH), "v"):
                            mine = made.get(len(some.column("v")[0]))
                            out = None if mine is None else answer(mine, some)
                            if out is not None and len(out[0]):
                                yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], names)
                start = end
        pa.default_memory_pool().release_unused()

    return both.repartition(parts, "shard").sortWithinPartitions("shard", "asks").mapInArrow(run, schema)
