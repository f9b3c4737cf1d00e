"""Substring dedup by relative Lempel-Ziv parsing over words.

The corpus is cut into reference blocks: windows of ``width`` words are dealt by their anchors (see ``anchors``), so every
window of a document that stands in some other place meets it in one block. Each piece is parsed greedily against its
block's suffix order: a factor is the longest match, anywhere else in the block (with ``keep_first``: before it), of what is
still to be parsed. Windows inside a factor of ``width`` words or more are duplicates. A window that is not inside one factor
crosses a factor's boundary; these are looked up one by one. Windows come from the parse alone: without factors there are
none. Equal pieces are one piece in a block (the first one), their number is kept.

Defined results: null texts have no words; texts of fewer than ``width`` words lose nothing; a null id comes back null;
repeated rows are copies of each other; extra columns are ignored.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .anchors import reduced
from .suffixes import common, first_ranks, levels, previous_factors
from .textcols import U, mix


def factors(longest: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the greedy factors of all pieces [begin, end)."""
    at, out = begin.copy(), []
    while len(at):
        size = np.maximum(longest[at], 1)
        out.append((at, size))
        at, end = at + size, end
        going = at < end
        at, end = at[going], end[going]
    return np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out])


def matches(symbols: np.ndarray, keep_first: bool) -> np.ndarray:
    """The longest match of each suffix anywhere else; with ``keep_first``, before it."""
    found, _ = levels(first_ranks(symbols))
    sa = np.argsort(found[-1][1], kind="stable")
    lcp = np.zeros(len(sa), np.int64)
    lcp[1:] = common(found, sa[:-1], sa[1:])
    longest = np.zeros(len(symbols), np.int64)
    longest[sa] = previous_factors(sa, lcp) if keep_first else np.maximum(lcp, np.append(lcp[1:], 0))
    return longest


def between(begin: np.ndarray, end: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` places lie in one of the ranges [begin, end)."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, begin, 1)
    np.add.at(edge, end, -1)
    return np.cumsum(edge[:-1]) > 0


def parsed(symbols, of, starts, width, keep_first):
    """Whether each window stands in the block again (with ``keep_first``: before it), by factors and their boundaries."""
    pieces = np.arange(len(of) - 1)
    apart = mix(mix(pieces.astype(U)) + U(width))  # a symbol of its own ends each piece
    symbols = np.insert(symbols, of[1:], apart)
    begin, end = of[:-1] + pieces, of[1:] + pieces
    starts = starts + np.searchsorted(of, starts, side="right") - 1
    n, longest = len(symbols), matches(symbols, keep_first)
    first, size = factors(longest, begin, end)
    long = size >= width
    inside = between(first[long], first[long] + size[long] - width + 1, n)
    bound = first + size
    crossing = starts[between(np.maximum(bound - width + 1, 0), bound, n)[starts] & ~inside[starts]]
    inside[crossing] = longest[crossing] >= width
    return inside[starts]


def rlz_dedup(docs: DataFrame, width: int = 35, keep_first: bool = True, gram: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, n_removed, spans (word ranges removed), kept (words joined by one space) for every row of ``docs``."""

    def kept(data, offsets, mask, words):
        stay = np.flatnonzero(~mask)
        edge = np.zeros(len(data) + 2, np.int64)
        np.add.at(edge, words.start[stay], 1)
        doc = words.doc()[stay]
        last = np.ones(len(stay), bool)
        last[:-1] = doc[1:] != doc[:-1]
        np.add.at(edge, words.end[stay] + ~last, -1)  # with the white space after it
        take = np.cumsum(edge[: len(data)]) > 0
        white = np.zeros(len(data) + 1, bool)
        white[words.end[stay[~last]]] = True
        out = np.where(white[: len(data)], 32, data).astype(np.uint8)[take]
        at = np.concatenate([[0], np.cumsum(take)])[offsets].astype(np.int32)
        return pa.Array.from_buffers(pa.string(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(out))])

    return reduced(docs, id_col, text_col, "words", width, gram or max(1, width // 3), parsed, keep_first, kept, "string")
