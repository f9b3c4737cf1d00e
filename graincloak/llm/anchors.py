"""Windows of ``width`` symbols (bytes or words) that stand more than once in a corpus.

Every window is dealt by its anchor: the leftmost of its ``gram``-symbol grams with the smallest hash. Equal windows have
equal anchors, so they meet whatever documents they are in. Consecutive windows with one anchor form a run; its text is a
piece. Runs are rows of a few numbers; what happens next needs only those:

* runs whose anchor stands once are dropped, before anything else is moved;
* equal pieces (by two 64-bit hashes) are counted, and of each one copy goes on, so groups of copies collapse early;
* the distinct pieces of an anchor are fetched from the texts and compared in blocks by a ``core`` (suffix arrays or
  relative Lempel-Ziv factors), which says which window starts stand in the block again;
* an anchor with more than MOST distinct pieces is cut by more context: equal windows have their anchor at one distance from
  their start, so windows are dealt again by a range of that distance and by the text that all windows of that range have.
  The narrower the range, the more text they share; a range of one distance shares the whole window. The same core compares
  the pieces that come of it.

Repeated rows are occurrences like any others. Documents are told apart by (id, hash of the text).
"""

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textcols import BYTE, U, Words, blobs, map_slices, mix, prefix, saved, signed, small, span_hash

MOST = 1500
BLOCK = 1 << 20
NULL_ID = -(1 << 63)
KEY = ["id", "tkey"]
PIECE = ["anchor", "piece", "id", "first", "n", "symbols"]


class Symbols:
    """A slice as symbols: ``hash`` and ``raw`` of each, the documents' offsets ``of``."""

    def __init__(self, kind: str, data: np.ndarray, offsets: np.ndarray):
        if kind == "bytes":
            self.raw, self.hash, self.of = data, BYTE[data], offsets
        else:
            words = Words(data, offsets)
            self.raw, self.hash, self.of = words.hash, words.hash, words.of
        self.sums = prefix(self.hash)

    def runs(self, width: int, gram: int):
        """Document, first and last window start (in the slice) and anchor place of each run."""
        n, span = len(self.hash), width - gram + 1
        none = np.zeros(0, np.int64)
        if n < width:
            return none, none, none, none
        at = np.arange(n - gram + 1)
        grams = span_hash(self.sums, at, at + gram)
        if n >= 1 << 28:
            raise ValueError("a text has more than 2**28 symbols")
        packed = (grams & ~U((1 << 28) - 1)) | at.astype(U)
        rows = -(-len(packed) // span)
        grid = np.full(rows * span, ~U(0), U)
        grid[: len(packed)] = packed
        grid = grid.reshape(rows, span)
        ahead = np.minimum.accumulate(grid, axis=1).ravel()
        back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        starts = np.arange(n - width + 1)
        anchor = (np.minimum(back[starts], ahead[starts + span - 1]) & U((1 << 28) - 1)).astype(np.int64)
        doc = np.searchsorted(self.of, starts, side="right") - 1
        inside = starts + width <= self.of[doc + 1]
        starts, anchor, doc = starts[inside], anchor[inside], doc[inside]
        if not len(starts):
            return none, none, none, none
        new = np.ones(len(starts), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(starts)) - 1
        return doc[first], starts[first], starts[last], anchor[first]


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.coalesce(F.col(id_col), F.lit(NULL_ID)).cast("long").alias("id"), F.xxhash64(text).alias("tkey"), text.alias("text"))


def find_runs(texts: DataFrame, kind: str, width: int, gram: int) -> DataFrame:
    def each(rows, data, offsets):
        s = Symbols(kind, data, offsets)
        doc, first, last, anchor = s.runs(width, gram)
        if not len(doc):
            return None
        piece = mix(span_hash(s.sums, first, last + width) + (anchor - first).astype(U))
        name = span_hash(s.sums, anchor, anchor + gram)
        take = pa.array(doc)
        return [signed(name), signed(piece), rows.column("id").take(take), rows.column("tkey").take(take), (first - s.of[doc]).astype(np.int32), (last - first + 1).astype(np.int32)]

    return map_slices(texts, "text", each, "anchor long, piece long, id long, tkey long, first int, n int")


def cut(texts: DataFrame, wanted: DataFrame, kind: str, width: int) -> DataFrame:
    """The symbols of each wanted piece."""

    def each(rows, data, offsets):
        s = Symbols(kind, data, offsets)
        asked = rows.column("asked")
        flat = asked.flatten()
        anchor, piece, first, n = (flat.field(k).to_numpy() for k in range(4))
        doc = np.repeat(np.arange(len(rows)), np.diff(asked.offsets.to_numpy()))
        begin = s.of[doc] + first
        size = n + width - 1
        of = np.concatenate([[0], np.cumsum(size)])
        at = np.arange(of[-1]) + np.repeat(begin - of[:-1], size)
        return [anchor, piece, rows.column("id").take(pa.array(doc)), first, n, blobs(s.raw[at], of)]

    per_doc = saved(wanted.groupBy(*KEY).agg(F.collect_list(F.struct("anchor", "piece", "first", "n")).alias("asked")))  # bounded by the text
    texts = texts.join(small(per_doc.select(*KEY)), KEY, "left_semi")
    return map_slices(texts.join(per_doc.hint("merge"), KEY).select("id", "text", "asked"), "text", each, "anchor long, piece long, id long, first int, n int, symbols binary")


FLAGS = "anchor long, piece long, s int, e int"


def compared(pieces: DataFrame, kind: str, width: int, core: Callable, keep_first: bool) -> DataFrame:
    """(anchor, piece, s, e): ranges [s, e) of window starts, from a piece's first, that ``core`` finds in the block again.
    ``pieces``: anchor, piece, id, first, n, symbols."""
    dtype = np.uint8 if kind == "bytes" else U

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        anchor, piece, ids, first, n = (table.column(c).to_numpy() for c in ("anchor", "piece", "id", "first", "n"))
        order = np.lexsort((first, ids))
        _, once = np.unique(np.stack([anchor[order], piece[order]]), axis=1, return_index=True)
        order = order[np.sort(once)]
        parts = table.column("symbols").combine_chunks().take(pa.array(order))
        symbols = np.concatenate([np.frombuffer(x.as_buffer(), dtype) for x in parts])
        n = n[order].astype(np.int64)
        of = np.concatenate([[0], np.cumsum(n + width - 1)])
        starts = np.arange(n.sum()) + np.repeat(of[:-1] - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
        owner = np.repeat(np.arange(len(n)), n)
        flags = core(symbols, of, starts, width, keep_first)
        edge, close = flags.copy(), flags.copy()
        edge[1:] &= ~(flags[:-1] & (owner[1:] == owner[:-1]))
        close[:-1] &= ~(flags[1:] & (owner[1:] == owner[:-1]))
        a, b = np.flatnonzero(edge), np.flatnonzero(close)
        who = order[owner[a]]
        return pa.table([pa.array(anchor[who]), pa.array(piece[who]), pa.array((starts[a] - of[owner[a]]).astype(np.int32)), pa.array((starts[b] - of[owner[b]] + 1).astype(np.int32))], ["anchor", "piece", "s", "e"])

    symbols = pieces.agg(F.sum(F.col("n") + width - 1)).first()[0] or 0
    blocks = max(1, symbols * (1 if kind == "bytes" else 4) // BLOCK)
    return pieces.groupBy(F.pmod(F.xxhash64("anchor"), F.lit(blocks)).alias("block")).applyInArrow(run, FLAGS)


def cut_more(pieces: DataFrame, kind: str, width: int, gram: int, step: int) -> DataFrame:
    """Parts of ``pieces`` (see ``compared``) whose windows have their anchor in one range of ``step`` distances: anchor,
    piece (new ones, by the text that the range's windows share), id, first, n, symbols, and the piece that it is from
    (old_anchor, old_piece, shift). ``base`` names the gram that is the anchor of all windows, whatever else they are dealt by."""
    dtype = np.uint8 if kind == "bytes" else U
    names = [*PIECE, "base", "old_anchor", "old_piece", "shift"]

    def run(batches):
        for batch in batches:
            out = {c: [] for c in names}
            for row in range(batch.num_rows):
                anchor, piece, i, first, n, base = (batch.column(c)[row].as_py() for c in ("anchor", "piece", "id", "first", "n", "base"))
                raw = np.frombuffer(batch.column("symbols")[row].as_buffer(), dtype)
                sums = prefix(BYTE[raw] if kind == "bytes" else raw)
                at = np.arange(len(raw) - gram + 1)
                place = int(np.flatnonzero(signed(span_hash(sums, at, at + gram)) == base)[0])
                for k in range((place - n + 1) // step, place // step + 1):
                    low, high = max(0, place - (k + 1) * step + 1), min(n - 1, place - k * step)
                    context = span_hash(sums, np.array([place - k * step]), np.array([place - (k + 1) * step + 1 + width]))
                    text = span_hash(sums, np.array([low]), np.array([high + width]))
                    new = signed(np.concatenate([mix(context + U(k) + U(anchor & (1 << 64) - 1)), mix(text + U(place - low))]))
                    for c, v in zip(names, (int(new[0]), int(new[1]), i, first + low, high - low + 1, raw[low : high + width].tobytes(), base, anchor, piece, low)):
                        out[c].append(v)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(out[c], t) for c, t in zip(names, kinds)], names)

    return pieces.select(*PIECE, "base").mapInArrow(run, "anchor long, piece long, id long, first int, n int, symbols binary, base long, old_anchor long, old_piece long, shift int")


def settled(pieces: DataFrame, kind: str, width: int, gram: int, core: Callable, keep_first: bool, step: int) -> DataFrame:
    """What ``compared`` gives, for anchors with very many pieces."""
    parts = saved(cut_more(pieces, kind, width, gram, step))
    same = parts.groupBy("anchor", "piece").agg(F.count("*").alias("copies"), F.min(F.struct("id", "first")).alias("low"))
    several = same.groupBy("anchor").agg(F.count("*").alias("variants"))
    same = saved(same.join(several, "anchor"))
    low = F.struct("id", "first")
    full = parts.join(same.filter("copies > 1"), ["anchor", "piece"])
    if keep_first:
        full = full.filter(low != F.col("low"))
    whole = [F.col("old_anchor").alias("anchor"), F.col("old_piece").alias("piece")]
    out = full.select(*whole, F.col("shift").alias("s"), (F.col("shift") + F.col("n")).alias("e"))
    rest = saved(parts.join(same.filter("variants > 1"), ["anchor", "piece"]).filter(low == F.col("low")))
    flags = compared(rest.filter(F.col("variants") <= MOST).select(*PIECE), kind, width, core, keep_first)
    if not rest.filter(F.col("variants") > MOST).isEmpty():
        flags = flags.unionByName(settled(rest.filter(F.col("variants") > MOST), kind, width, gram, core, keep_first, max(1, step // 8)))
    back = parts.select("anchor", "piece", "old_anchor", "old_piece", "shift").join(flags, ["anchor", "piece"])
    return out.unionByName(back.select(*whole, (F.col("s") + F.col("shift")).alias("s"), (F.col("e") + F.col("shift")).alias("e")))


def repeated_spans(texts: DataFrame, kind: str, width: int, gram: int, core: Callable, keep_first: bool) -> DataFrame:
    """(id, tkey, spans): the symbol ranges, as an array of (start, end) in order and apart, that repeated windows cover.
    With ``keep_first``, a window's first occurrence (by id, then place) does not count as repeated."""
    runs = saved(find_runs(texts, kind, width, gram))
    twice = small(saved(runs.groupBy("anchor").count().filter("count > 1").select("anchor")))
    runs = saved(runs.join(twice, "anchor"))
    pieces = saved(runs.groupBy("anchor", "piece").agg(F.count("*").alias("copies"), F.min(F.struct("id", "first", "tkey", "n")).alias("low")).select("anchor", "piece", "copies", "low.*"))
    per_anchor = pieces.groupBy("anchor").agg(F.count("*").alias("variants")).filter("variants > 1")
    several = saved(pieces.join(per_anchor, "anchor").drop("copies"))
    hot = several.filter(F.col("variants") > MOST)
    flags = compared(cut(texts, several.filter(F.col("variants") <= MOST), kind, width), kind, width, core, keep_first)
    if not hot.isEmpty():
        flags = flags.unionByName(settled(cut(texts, hot, kind, width).withColumn("base", F.col("anchor")), kind, width, gram, core, keep_first, max(1, (width - gram + 1) // 8)))
    copied = pieces.filter("copies > 1").select("anchor", "piece", F.lit(0).alias("s"), F.col("n").alias("e"), F.struct("id", "first", "tkey").alias("low"))
    marks = flags.withColumn("low", F.lit(None).cast(copied.schema["low"].dataType)).unionByName(copied)
    both = saved(marks.groupBy("anchor", "piece").agg(F.collect_list(F.struct("s", "e", "low")).alias("marks")))  # a run's marks: at most its windows
    here = F.struct("id", "first", "tkey")
    hit = runs.join(small(both, 100_000), ["anchor", "piece"]).select(*KEY, "first", F.explode("marks").alias("m"), here.alias("here"))
    if keep_first:
        hit = hit.filter("m.low IS NULL OR m.low <> here")
    span = F.struct((F.col("first") + F.col("m.s")).cast("long").alias("start"), (F.col("first") + F.col("m.e") + (width - 1)).cast("long").alias("end"))
    return hit.groupBy(*KEY).agg(F.collect_list(span).alias("spans"))


def union(spans: pa.Array, of: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """From a slice's spans (null: none) and its documents' offsets in symbols: a mask of covered symbols, and the starts
    and ends of each document's joined spans."""
    sizes = np.diff(of)
    flat, at = spans.flatten(), spans.value_lengths().fill_null(0).to_numpy()
    doc = np.repeat(np.arange(len(at)), at)
    edge = np.zeros(of[-1] + 1, np.int64)
    np.add.at(edge, flat.field(0).to_numpy() + of[doc], 1)
    np.add.at(edge, flat.field(1).to_numpy() + of[doc], -1)
    mask = np.cumsum(edge[:-1]) > 0
    out = []
    for a, n in zip(of[:-1], sizes):
        step = np.diff(np.concatenate([[0], mask[a : a + n].astype(np.int8), [0]]))
        out.append((np.flatnonzero(step == 1), np.flatnonzero(step == -1)))
    return mask, out


def reduced(docs: DataFrame, id_col: str, text_col: str, kind: str, width: int, gram: int, core: Callable, keep_first: bool, kept: Callable, kept_type: str) -> DataFrame:
    """One row per document: id, its number of symbols, the number removed, the removed spans, what is kept."""
    texts = keyed(docs, id_col, text_col)
    spans = saved(repeated_spans(texts, kind, width, gram, core, keep_first))
    some = small(spans.select(*KEY))
    touched = texts.join(some, KEY, "left_semi").join(spans.hint("merge"), KEY).select("id", "text", "spans")
    rest = texts.join(some, KEY, "left_anti").select("id", "text", F.lit(None).cast(spans.schema["spans"].dataType).alias("spans"))

    def each(rows, data, offsets):
        of = offsets if kind == "bytes" else (words := Words(data, offsets)).of
        mask, found = union(rows.column("spans"), of)
        starts = [pa.array(x[0]) for x in found]
        sizes = np.array([len(x) for x in starts])
        ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        values = pa.StructArray.from_arrays([pa.array(np.concatenate([x[0] for x in found])), pa.array(np.concatenate([x[1] for x in found]))], ["start", "end"])
        sums = np.concatenate([[0], np.cumsum(mask)])
        left = kept(data, offsets, mask, None if kind == "bytes" else words)
        return [rows.column("id"), np.diff(of).astype(np.int64), (sums[of[1:]] - sums[of[:-1]]).astype(np.int64), pa.ListArray.from_arrays(pa.array(ends), values), left]

    schema = f"id long, n long, n_removed long, spans array<struct<start:long,end:long>>, kept {kept_type}"
    names = ["id", "n", "n_removed", "spans", "kept"]
    out = map_slices(touched.unionByName(rest), "text", each, schema, names)
    return out.select(F.when(F.col("id") != NULL_ID, F.col("id")).alias(id_col), F.col("n").alias(f"n_{kind}"), "n_removed", "spans", "kept")
