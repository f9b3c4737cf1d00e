"""Whole text columns as numpy arrays, inside Spark's Arrow tasks.

``map_slices`` cuts every Arrow batch of a task into slices of about ``SLICE`` bytes (one document at least), so that the
arrays made for a slice stay small whatever the batch size. Null texts count as empty.
"""

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

SLICE = 1 << 18
U = np.uint64
BASE = U(0x9E3779B97F4A7C15)
INVERSE = U(pow(int(BASE), -1, 1 << 64))
WHITE = np.zeros(256, bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


BYTE = mix(np.arange(1, 257, dtype=U) * BASE)
LOWER = np.arange(256)
LOWER[65:91] += 32
BYTE_LOWER = BYTE[LOWER]


def powers(name: str, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, for "up" (BASE) or "down" (its inverse)."""
    if name not in _powers or len(_powers[name]) < n:
        steps = np.full(max(n, 2 * SLICE), BASE if name == "up" else INVERSE)
        steps[0] = 1
        _powers[name] = np.multiply.accumulate(steps)
    return _powers[name][:n]


def prefix(symbols: np.ndarray) -> np.ndarray:
    """Running sums from which ``span_hash`` takes the hash of any span of ``symbols`` (64-bit each)."""
    out = np.zeros(len(symbols) + 1, U)
    np.cumsum(symbols * powers("up", len(symbols)), out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of spans: equal symbols give equal hashes wherever they stand."""
    down = powers("down", len(sums))
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(U) * U(0xD6E8FEB86659FD93))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes and the offsets of its texts in them."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


class Words:
    """The words of a slice: ``start``, ``end`` (bytes), ``hash`` of each; ``of`` has the offsets of the documents' words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        word = ~WHITE[data]
        first = np.zeros(len(data) + 1, bool)
        first[offsets] = True
        before = np.ones(len(data), bool)
        before[1:] = ~word[:-1]
        self.start = np.flatnonzero(word & (before | first[:-1]))
        after = np.ones(len(data), bool)
        after[:-1] = ~word[1:]
        self.end = np.flatnonzero(word & (after | first[1:])) + 1
        self.of = np.searchsorted(self.start, offsets)
        self.hash = span_hash(prefix((BYTE_LOWER if lower else BYTE)[data]), self.start, self.end)

    def doc(self) -> np.ndarray:
        """The document, by its place in the slice, of every word."""
        return np.repeat(np.arange(len(self.of) - 1), np.diff(self.of))


def give_back() -> None:
    """Workers live on after their task, and idle ones count: what the task freed goes back to the system."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc only
        trim(0)


def tidy(each: Callable) -> Callable:
    """A function for ``mapInArrow`` that gives back its memory once its frame, with the last batch and slice, is gone."""

    def run(batches):
        yield from each(batches)
        give_back()

    return run


def slices(batch: pa.RecordBatch, text: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    data, offsets = text_bytes(batch.column(text))
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE, side="right")) - 1)
        yield batch.slice(at, to - at), data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def map_slices(df: DataFrame, text: str, each: Callable, schema: str | StructType, names: list[str] | None = None) -> DataFrame:
    """``each(rows, data, offsets)`` gives the arrays of ``schema``'s columns, or None, for every slice of ``df``. With a
    StructType, columns have plain names on their way, so that any name may be carried."""
    given, wanted = df.columns, names or [x.split()[0] for x in schema.split(", ")]
    names, carried = wanted, isinstance(schema, StructType)
    if carried:
        names = [f"c{i}" for i in range(len(wanted))]
        df = df.toDF(*(f"c{i}" for i in range(len(given))))
        schema = StructType([StructField(c, f.dataType) for c, f in zip(names, schema.fields)])

    def run(batches):
        for batch in batches:
            batch = batch.rename_columns(given)
            for rows, data, offsets in slices(batch, text):
                out = each(rows, data, offsets)
                if out is not None and len(out[0]):
                    yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in out], names)

    out = df.mapInArrow(tidy(run), schema)
    return out.toDF(*wanted) if carried else out


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def blobs(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Binary values: the bytes of ``values`` between the offsets (counted in values)."""
    at = pa.py_buffer(np.asarray(offsets * values.itemsize, np.int32))
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, at, pa.py_buffer(np.ascontiguousarray(values))])


def saved(df: DataFrame) -> DataFrame:
    """The rows, computed once and written to the session's checkpoint folder; lineage ends here. The folder is the one that
    ``spark.checkpoint.dir`` or ``setCheckpointDir`` names; without one there is no place that all executors can read."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        if not (shared := spark.conf.get("spark.checkpoint.dir", "")):
            raise ValueError("name a folder that driver and executors share in spark.checkpoint.dir")
        spark.sparkContext.setCheckpointDir(shared)
    return df.checkpoint()


def small(df: DataFrame, rows: int = 1_000_000) -> DataFrame:
    """``df`` (narrow and saved), to be broadcast if it is counted to have at most ``rows`` rows; else it is shuffled."""
    return F.broadcast(df) if df.count() <= rows else df
