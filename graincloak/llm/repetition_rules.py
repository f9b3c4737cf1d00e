"""Quality rules from repeated word substrings, found by suffix arrays.

Per document, the suffix array over its words and the longest common prefixes of neighbours in it are computed (prefix
doubling over a slice of documents; words of different documents never compare equal). An interval of the array whose
common prefix has ``min_words`` words or more is a repeat; extended to its longest common prefix it is a maximal repeated
substring. The union of all their spans gives the covered fraction. A document fails above ``max_covered`` or above
``max_repeat`` (words of the longest repeat, overlapping copies included), or by the base rules.

Defined results: a null or empty text has no words, so it fails the base rules (fewer than 50 words). Rows are judged one
by one: null ids, repeated rows and extra columns (carried along unless their name clashes with a result's) are harmless.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .suffixes import deepening, deeper, first_ranks, shared
from .textcols import BYTE, U, WHITE, Words, map_slices, mix, prefix, span_hash

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered_words", "longest_repeat")


def per_doc(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(mask)])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def dup_lines(data: np.ndarray, offsets: np.ndarray, sums: np.ndarray) -> np.ndarray:
    docs = len(offsets) - 1
    breaks = np.flatnonzero(data == 10)
    start = np.sort(np.concatenate([offsets[:-1], breaks + 1]))
    # a document begins a line, and so does the place after each break; an empty last line has no word
    end = np.sort(np.concatenate([offsets[1:], breaks]))
    words = np.concatenate([[0], np.cumsum(~WHITE[data])])
    some = words[end] > words[start]
    start, end = start[some], end[some]
    doc = np.searchsorted(offsets, start, side="right") - 1
    lines = mix(span_hash(sums, start, end) + doc.astype(U) * U(0x9E3779B97F4A7C15))
    total = np.bincount(doc, minlength=docs)
    _, first = np.unique(lines, return_index=True)
    return total - np.bincount(doc[first], minlength=docs)


def common_spans(sums: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Lengths of the longest common prefixes of suffixes ``i`` and ``j``, by hashes of spans of 2**k, 2**(k-1), ... symbols.
    Needs no more than a few arrays, however long they are."""
    n, length = len(sums) - 1, np.zeros(len(i), np.int64)
    for k in reversed(range(n.bit_length())):
        a, b = i + length, j + length
        ok = np.flatnonzero(np.maximum(a, b) + (1 << k) <= n)
        a, b = a[ok], b[ok]
        length[ok[span_hash(sums, a, a + (1 << k)) == span_hash(sums, b, b + (1 << k))]] += 1 << k
    return length


def repeats(words: Words, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per document: words in repeated 3-word windows, words in maximal repeats, words of the longest repeat."""
    n, docs, doc = len(words.hash), len(words.of) - 1, words.doc()
    if not n:
        return (np.zeros(docs, np.int64),) * 3
    symbols = mix(words.hash ^ mix(doc.astype(U)))
    twice, base, final = None, None, None
    for depth, final in deepening(first_ranks(symbols)):
        twice = final if depth == 2 else twice
        base = final if depth <= min_words else base
    three = deeper(twice, 1, np.flatnonzero(np.bincount(twice, minlength=n)[twice] > 1))[1] if twice is not None else np.zeros(0, np.int64)

    def covered(start, length):
        edge = np.zeros(n + 1, np.int64)
        np.add.at(edge, start, 1)
        np.add.at(edge, np.minimum(start + length, n), -1)
        return per_doc(np.cumsum(edge[:-1]) > 0, words.of)

    live = shared(base)
    order = live[np.argsort(final[live], kind="stable")]
    left, right = order[:-1], order[1:]
    lcp = common_spans(prefix(symbols), left, right)
    long = lcp >= min_words
    left, right, lcp = left[long], right[long], lcp[long]
    longest = np.zeros(docs, np.int64)
    np.maximum.at(longest, doc[left], lcp)
    return covered(three, np.full(len(three), 3)), covered(np.concatenate([left, right]), np.concatenate([lcp, lcp])), longest


def repetition_rules(docs: DataFrame, text_col: str = "text", min_words: int = 8, max_covered: float = 0.3, max_repeat: int = 400) -> DataFrame:
    """``docs`` with the counts of ``COUNTS``, base_failed and kept."""
    taken = {*COUNTS, "base_failed", "kept"}
    rest = [f for f in docs.schema.fields if f.name not in taken]
    slim = docs.select(*(F.col(f"`{f.name}`") for f in rest))

    def each(rows, data, offsets):
        words = Words(data, offsets)
        sums = prefix(BYTE[data])
        three, cover, longest = repeats(words, min_words)
        out = [np.diff(words.of), per_doc(~WHITE[data] & ((data & 0xC0) != 0x80), offsets), per_doc(SYMBOLS[data], offsets), dup_lines(data, offsets, sums), three, cover, longest]
        return [*rows.columns, *(pa.array(x.astype(np.int64)) for x in out)]

    schema = StructType([*rest, *(StructField(c, LongType()) for c in COUNTS)])
    out = map_slices(slim, text_col, each, schema, schema.names)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    bad = (F.col("n_covered_words") > max_covered * F.col("n_words")) | (F.col("longest_repeat") > max_repeat)
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & ~bad)
