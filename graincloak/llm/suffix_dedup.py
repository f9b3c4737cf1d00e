"""Substring dedup by longest-previous-factor arrays.

Windows of ``width`` bytes are dealt to blocks so that equal ones meet (see ``anchors``). In a block the suffixes at all
window starts of all distinct pieces are sorted to depth ``width``, ties by place, with the common prefixes of neighbours. The
previous and next smaller positions in that order give each suffix's longest previous factor; one of ``width`` bytes is an
earlier copy of the window. The same on positions from the end gives later copies. ``keep_first`` removes only what has an
earlier copy; without it, all copies go. Suffixes that share less than a power of two of at least half the width with any
other are left out, as their factors are shorter. Equal pieces are one piece in a block (the first one), their number is kept.

Defined results: null texts are empty; texts shorter than ``width`` lose nothing; a null id comes back null; repeated rows
are copies of each other; extra columns are ignored.
"""

import numpy as np
from pyspark.sql import DataFrame

from .anchors import reduced
from .suffixes import common, deeper, first_ranks, previous_factors, shared
from .textcols import blobs


def depth_ranks(symbols: np.ndarray, width: int) -> list[tuple[int, np.ndarray]]:
    """Ranks of all suffixes by their first 1, 2, 4, ... bytes, and by their first ``width``."""
    ranks = first_ranks(symbols.astype(np.int64))
    out, live = [(1, ranks)], shared(ranks)
    while (depth := out[-1][0]) < width:
        step = min(depth, width - depth)
        ranks, live = deeper(ranks, step, live)
        out.append((depth + step, ranks))
    return out


def suffix_factors(symbols: np.ndarray, starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Window starts in suffix order (those that share ``least`` bytes with another), the common prefix of each with the one
    before, up to ``width`` (0 where it is under ``least``), and ``least``."""
    found = depth_ranks(symbols, width)
    least, coarse = max((x for x in found if x[0] < width), key=lambda x: x[0], default=found[0])
    final = found[-1][1]
    places = starts[np.bincount(coarse[starts], minlength=len(symbols))[coarse[starts]] > 1]
    sa = places[np.argsort(final[places], kind="stable")]
    lcp = np.zeros(len(sa), np.int64)
    lcp[1:] = np.where(final[sa[1:]] == final[sa[:-1]], width, common(found[:-1], sa[:-1], sa[1:]) if len(found) > 1 else 0)
    lcp[lcp < least] = 0
    return sa, lcp, least


def repeated(symbols, of, starts, width, keep_first):
    """Whether each window stands in the block again; with ``keep_first``, whether it does so before."""
    sa, lcp, _ = suffix_factors(symbols, starts, width)
    again = previous_factors(sa, lcp) >= width
    if not keep_first:
        again |= previous_factors(-sa, lcp) >= width
    out = np.zeros(len(symbols) + 1, bool)
    out[sa[again]] = True
    return out[starts]


def suffix_dedup(docs: DataFrame, width: int = 400, keep_first: bool = True, gram: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, n_removed, spans (byte ranges removed), kept (bytes) for every row of ``docs``."""

    def kept(data, offsets, mask, _):
        left = np.concatenate([[0], np.cumsum(~mask)])
        return blobs(data[~mask], left[offsets])

    return reduced(docs, id_col, text_col, "bytes", width, gram or max(1, width * 8 // 25), repeated, keep_first, kept, "binary")
