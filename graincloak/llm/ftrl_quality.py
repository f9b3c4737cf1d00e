"""Quality classifier: logistic regression on hashed word n-grams, trained with follow-the-regularised-leader updates.

A document's features are its word 1- and 2-grams, and 1- to 3-grams of word outlines (the kinds of a word's first and last
two characters), all hashed to 2**BITS weights and averaged over the document; a score is the logistic of that sparse dot
product. ``train`` fits on some ``max_rows`` labelled rows of some ``max_bytes`` in all (documented bounds on the fit, kept
on average: a hash of the id picks the rows) in SHARDS shards, whose weights are averaged; scoring covers every row.
``labelled_rows`` picks the same rows where texts and labels are in two tables, without moving the texts, for ``fit``.

Defined results: a null or empty text has no n-grams and gets the bias alone; rows with a null id or label never train;
without labelled rows every score is 0.5; repeated rows are scored alike; extra columns are carried
along, but a column named score is replaced.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .textcols import U, Words, blobs, map_slices, mix, saved, small

BITS = 20
SHARDS = 4
MAX_ROWS = 20_000
MAX_BYTES = 256 << 20
KIND = np.arange(256)
KIND[[*range(97, 123), *range(128, 256)]] = 97
KIND[65:91] = 65
KIND[48:58] = 48


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Slots of the n-grams that begin at each word (a list for each kind of n-gram) and the documents' offsets of words.
    N-grams that run over a document's end get a slot for the end."""
    words = Words(data, offsets)
    kind = KIND[data].astype(U)
    outline = (kind[words.start] << U(16)) | (kind[np.maximum(words.end - 2, words.start)] << U(8)) | kind[words.end - 1] if len(words.start) else np.zeros(0, U)
    last = np.zeros(len(words.start) + 1, bool)
    last[words.of] = True
    out = []
    for symbols, most in ((words.hash, 2), (mix(outline + U(1)), 3)):
        gram = symbols
        for n in range(1, most + 1):
            if n > 1:
                after = np.zeros_like(symbols)
                after[: -(n - 1)] = symbols[n - 1 :]
                ends = np.zeros(len(symbols), bool)
                for k in range(1, n):
                    ends |= last[np.minimum(np.arange(len(symbols)) + k, len(symbols))]
                gram = mix(gram * U(31) + np.where(ends, U(7), after))
            out.append((mix(gram + U(n)) & U((1 << BITS) - 1)).astype(np.int32))
    return out, words.of


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = 3, alpha: float = 0.5, beta: float = 1.0, l1: float = 1e-4, l2: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias after per-coordinate FTRL updates over ``rows`` of (slots, values, label)."""
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(at):
        return np.where(np.abs(z[at]) <= l1, 0, (np.sign(z[at]) * l1 - z[at]) / ((beta + np.sqrt(n[at])) / alpha + l2))

    for _ in range(epochs):
        for slots, values, label in rows:
            w = weights(slots)
            g = (1 / (1 + np.exp(-np.clip(w @ values, -35, 35))) - label) * values
            z[slots] += g - (np.sqrt(n[slots] + g * g) - np.sqrt(n[slots])) / alpha * w
            n[slots] += g * g
    w = weights(np.arange(len(z)))
    return w[:-1].astype(np.float32), float(w[-1])


def part(total: int, size: int, max_rows: int, max_bytes: int) -> Column:
    """Whether a fit that keeps to its bounds takes the rows of an ``id``, out of ``total`` rows of ``size`` bytes."""
    return F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(1_000_000 * min(1.0, max_rows / max(total, 1), max_bytes / max(size, 1)))


def train(labelled: DataFrame, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES, scale: float = 20.0) -> tuple[np.ndarray, float]:
    """``labelled``: id, text, label. Returns averaged weights and bias."""
    usable = labelled.filter("id IS NOT NULL AND label IS NOT NULL")
    total, size = usable.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    return fit(usable.filter(part(total, size, max_rows, max_bytes)), scale)


def labelled_rows(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> DataFrame:
    """The rows (id, text, label) that ``train`` picks from the join of ``docs`` (id, text) and ``labels`` (id, label). To count
    that join only ids and sizes of texts move; then the labels that are picked are sent to the texts."""
    wanted = labels.filter("id IS NOT NULL AND label IS NOT NULL").select("id", "label")
    sizes = docs.select("id", F.octet_length("text").cast("long").alias("size"))
    total, size = sizes.join(wanted, "id").agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    return docs.join(small(saved(wanted.filter(part(total, size, max_rows, max_bytes)))), "id").select("id", "text", "label")


def fit(labelled: DataFrame, scale: float = 20.0) -> tuple[np.ndarray, float]:
    """Averaged weights and bias of a fit on all rows of ``labelled``: id, text, label."""

    def each(rows, data, offsets):
        grams, of = features(data, offsets)
        slots = np.stack(grams, 1).ravel() if len(grams[0]) else np.zeros(0, np.int32)
        return [rows.column("id").cast(pa.int64()), rows.column("label").cast(pa.int32()), blobs(slots, of * len(grams))]

    def learn(table: pa.Table) -> pa.Table:
        table = table.take(pa.array(np.argsort(mix(table.column("id").to_numpy().astype(U)), kind="stable")))
        rows = []
        for blob, label in zip(table.column("slots"), table.column("label").to_pylist()):
            slots, count = np.unique(np.frombuffer(blob.as_buffer(), np.int32), return_counts=True)
            rows.append((np.append(slots, 1 << BITS), np.append(count * (scale / max(count.sum(), 1)), 1.0), label))
        w, bias = ftrl(rows)
        return pa.table([pa.array([w.tobytes()], pa.binary()), pa.array([bias]), pa.array([len(rows)], pa.int64())], ["w", "bias", "n"])

    grams = map_slices(labelled.select("id", "text", "label"), "text", each, "id long, label int, slots binary")
    got = grams.groupBy(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(SHARDS))).applyInArrow(learn, "w binary, bias double, n long").collect()
    if not got:
        return np.zeros(1 << BITS, np.float32), 0.0
    share = np.array([r.n for r in got], float) / sum(r.n for r in got)
    return sum(s * np.frombuffer(r.w, np.float32) for s, r in zip(share, got)).astype(np.float32) * np.float32(scale), float(sum(s * r.bias for s, r in zip(share, got)))


def score(docs: DataFrame, model: tuple[np.ndarray, float], text_col: str = "text") -> DataFrame:
    """``docs`` with a column score: the probability of label 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rest = [f for f in docs.schema.fields if f.name != "score"]

    def each(rows, data, offsets):
        w, bias = shared.value
        grams, of = features(data, offsets)
        total = np.concatenate([[0], np.cumsum(sum(w[g].astype(np.float64) for g in grams))])
        n = np.diff(of) * len(grams)
        x = bias + (total[of[1:]] - total[of[:-1]]) / np.maximum(n, 1)
        return [*rows.columns, 1 / (1 + np.exp(-np.clip(x, -35, 35)))]

    schema = StructType([*rest, StructField("score", DoubleType())])
    return map_slices(docs.select(*(F.col(f"`{f.name}`") for f in rest)), text_col, each, schema, [*(f.name for f in rest), "score"])
