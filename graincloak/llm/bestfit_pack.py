"""Best-fit packing planned on the histogram of lengths.

Documents become token ids and are cut into pieces of at most ``size``. Only the histogram of piece lengths (``size`` counts
at most) reaches the driver, where best-fit decreasing runs over counts: bins of one kind are filled together, so the plan
has a few entries a length whatever the number of documents. Each piece then takes the planned slot that has its rank
within its length. Ranks are counted per (length, salt) and shifted by the salts' running totals, so a length that most
pieces share is spread over many tasks.

Defined results: a null or empty text is one piece of one token (the end id); null ids, repeated rows and ties all get
slots of their own; an empty table gives no rows; extra columns are ignored.
"""

import json
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .textcols import BYTE, WHITE, U, map_slices, mix, prefix, saved, span_hash

CACHE = 300_000
# fixed values: how a tokenizer file says that it lower-cases, drops white space and keeps letters, digits and signs apart
NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLIT = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}
BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
KIND = np.full(256, 3, np.uint8)  # of a byte: letter, digit or sign
KIND[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
KIND[48:58] = 2
RARE = np.zeros(256, bool)  # bytes of words that the tokenizer takes as a whole: apostrophes, control characters, other scripts
RARE[[*range(33), 39, 127, 0xC2, *range(0xCA, 256)]] = True
_state: dict = {}


def by_words(tokenizer) -> bool:
    """Whether a tokenizer works on words without white space, as ``Known`` takes for granted."""
    if not tokenizer.normalizer or not tokenizer.pre_tokenizer or type(tokenizer.model).__name__ != "BPE":
        return False
    normalizer, pre = (json.loads(x.__getstate__()) for x in (tokenizer.normalizer, tokenizer.pre_tokenizer))
    return normalizer.get("normalizers") == NORMALIZER and pre.get("pretokenizers") == [SPLIT, BYTE_LEVEL]


def byte_letters() -> dict[int, str]:
    """The characters that byte-level vocabularies write bytes with: printable ones stand for themselves."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = (chr(256 + n) for n in range(256))
    return {b: chr(b) if b in shown else next(others) for b in range(256)}


class Known:
    """Ids of parts of words, by the hash of the part: sorted names, and their places in one flat array of ids."""

    def __init__(self):
        self.clear()

    def clear(self):
        self.names, self.at, self.size, self.ids = np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def place(self, names: np.ndarray) -> np.ndarray:
        """Where each name is, or -1."""
        at = np.minimum(np.searchsorted(self.names, names), max(len(self.names) - 1, 0))
        return np.where(self.names[at] == names, at, -1) if len(self.names) else np.full(len(names), -1)

    def add(self, names: np.ndarray, found: list[list[int]]):
        size = np.array([len(x) for x in found], np.int64)
        at = len(self.ids) + np.cumsum(size) - size
        where = np.searchsorted(self.names, names)
        self.names, self.at, self.size = np.insert(self.names, where, names), np.insert(self.at, where, at), np.insert(self.size, where, size)
        self.ids = np.concatenate([self.ids, np.array([i for x in found for i in x], np.uint32)])


def parts(data: np.ndarray, offsets: np.ndarray, whole: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the parts of a slice's words (runs of letters, of signs, and digits one by one), and which of them
    are words that the tokenizer has to take as a whole (all, if ``whole``)."""
    n = len(data)
    word = ~WHITE[data]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    begin = word.copy()
    begin[1:] &= ~word[:-1] | first[1:-1]
    owner = np.cumsum(begin) - 1
    after = np.append(data[1:], 0)
    rare = RARE[data] | ((data == 0xC3) & ((after == 0x97) | (after == 0xB7))) | ((data == 0xC4) & (after == 0xB0)) | ((data == 0xC9) & (after > 0x8F))
    slow = np.zeros(begin.sum(), bool)
    slow[owner[rare & word]] = True
    if whole:
        slow[:] = True
    kind = KIND[data]
    cut = begin.copy()
    cut[1:] |= word[1:] & ((kind[1:] != kind[:-1]) | (kind[1:] == 2)) & ~slow[owner[1:]] if len(slow) else False
    start = np.flatnonzero(cut)
    stop = np.ones(n, bool)
    stop[:-1] = cut[1:] | ~word[1:] | first[1:-1]
    return start, np.flatnonzero(stop & word) + 1, slow[owner[start]] if len(start) else np.zeros(0, bool)


def text_ids(data: np.ndarray, offsets: np.ndarray, path: str) -> tuple[np.ndarray, np.ndarray]:
    """The ids of a slice's texts, and their offsets. A tokenizer of words drops white space, so a text's ids are those of
    its words; each distinct part of a slice's words is looked up once. Others encode whole texts."""
    if _state.get("path") != path:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokens = [t.content.encode() for t in tokenizer.get_added_tokens_decoder().values()]
        _state.update(path=path, tokenizer=tokenizer, letters=byte_letters(), known=Known(), special=tokens, words=by_words(tokenizer))
    tokenizer, known, raw = _state["tokenizer"], _state["known"], data.tobytes()
    if not _state["words"]:
        found = [tokenizer.encode(raw[a:b].decode(), add_special_tokens=False).ids for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        return np.array([i for x in found for i in x], np.uint32), np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int64)
    if len(known.names) > CACHE:
        known.clear()
    special = any(x in raw for x in _state["special"])
    start, end, slow = parts(data, offsets, special)
    names = mix(span_hash(prefix(BYTE[data]), start, end) + slow.astype(U) + U(2 * special))
    at = known.place(names)
    missing = np.flatnonzero(at < 0)
    if len(missing):
        new, first = np.unique(names[missing], return_index=True)
        first, found = missing[first], []
        letters, tokenize = _state["letters"], tokenizer.model.tokenize
        for a, b, whole in zip(start[first].tolist(), end[first].tolist(), slow[first].tolist()):
            text = raw[a:b].decode()
            if whole:
                found.append(tokenizer.encode(text, add_special_tokens=False).ids)
            else:
                text = text.lower()
                text = "".join([letters[x] for x in text.encode()]) if not text.isascii() else text
                found.append([t.id for t in tokenize(text)])
        known.add(new, found)
        at = known.place(names)
    n = known.size[at]
    of = np.concatenate([[0], np.cumsum(n)])
    ids = known.ids[np.arange(of[-1]) + np.repeat(known.at[at] - of[:-1], n)]
    return ids, of[np.searchsorted(start, offsets)]


def pieces(docs: DataFrame, path: str, size: int, end_id: int, id_col: str, text_col: str, with_ids: bool) -> DataFrame:
    end = np.array([end_id], "<u4").tobytes()
    kind = docs.schema[id_col].dataType.simpleString()

    def each(rows, data, offsets):
        doc, piece, length, crc, parts = [], [], [], [], []
        flat, of = text_ids(data, offsets, path)
        flat = flat.astype("<u4").tobytes()
        for i in range(len(rows)):
            ids = flat[4 * of[i] : 4 * of[i + 1]] + end
            for k in range(0, len(ids), 4 * size):
                part = ids[k : k + 4 * size]
                doc.append(i)
                piece.append(k // (4 * size))
                length.append(len(part) // 4)
                crc.append(zlib.crc32(part))
                if with_ids:
                    parts.append(part)
        piece = np.array(piece, np.int32)
        out = [rows.column("id").take(pa.array(doc)), piece, piece.astype(np.int64) * size, np.array(length, np.int64), np.array(crc, np.int64)]
        return [*out, pa.array(parts, pa.binary())] if with_ids else out

    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return map_slices(slim, "text", each, f"id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


def plan(counts: dict[int, int], size: int) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Best-fit decreasing over counts. Entries (length, first rank, pieces, first sequence, pieces a sequence, offset) and
    the number of sequences."""
    room: list[list[tuple[int, int]]] = [[] for _ in range(size + 1)]  # by free tokens: (first sequence, sequences)
    out, opened = [], 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0

        def put(first, bins, free):
            nonlocal left, rank
            each = free // length
            for n, per in ((min(bins, left // each), each), (1, left % each if left // each < bins else 0)):
                if n and per:
                    out.append((length, rank, n * per, first, per, size - free))
                    room[free - per * length].append((first, n))
                    rank, left, first, bins = rank + n * per, left - n * per, first + n, bins - n
            if bins:
                room[free].append((first, bins))

        for free in range(length, size + 1):
            groups = room[free]
            room[free] = []
            while groups and left:
                put(*groups.pop(), free)
            room[free] += groups
            if not left:
                break
        if left:
            bins = -(-left // (size // length))
            opened += bins
            put(opened - bins, bins, size)
    return out, opened


def best_fit_pack(docs: DataFrame, path: str, size: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: the id, piece, start, length, ids_crc32 (and ids, if asked for), sequence_id, offset."""
    spark = docs.sparkSession
    cut = saved(pieces(docs, path, size, end_id, id_col, text_col, with_ids))
    counts = {r.length: r["count"] for r in cut.groupBy("length").count().collect()}  # at most ``size`` rows
    slots, _ = plan(counts, size)
    salts = spark.createDataFrame(pa.table({"length": pa.array(counts.keys(), pa.int64()), "salts": pa.array([1 + c // 1_000 for c in counts.values()], pa.int64())}))
    salted = cut.join(F.broadcast(salts), "length").withColumn("salt", F.pmod(F.xxhash64("id", "piece", "ids_crc32"), F.col("salts"))).drop("salts")
    key = ["length", "salt"]
    before = salted.groupBy(*key).count().withColumn("before", F.sum("count").over(Window.partitionBy("length").orderBy("salt")) - F.col("count")).drop("count")
    order = Window.partitionBy(*key).orderBy("id", "piece", "ids_crc32")
    ranked = salted.withColumn("rank", F.row_number().over(order) - 1).join(before, key).withColumn("rank", F.col("rank") + F.col("before"))
    names = ["slot_length", "first_rank", "n", "first_seq", "per", "base"]
    table = F.broadcast(spark.createDataFrame(pa.table([pa.array([s[i] for s in slots], pa.int64()) for i in range(6)], names)))  # a few entries for each of ``size`` lengths
    at = F.col("rank") - F.col("first_rank")
    placed = ranked.join(table, (F.col("length") == F.col("slot_length")) & (at >= 0) & (at < F.col("n")))
    sequence = F.col("first_seq") + F.floor(at / F.col("per"))
    offset = F.col("base") + at % F.col("per") * F.col("length")
    keep = ["piece", "start", "length", "ids_crc32", *["ids"] * with_ids]
    return placed.select(F.col("id").alias(id_col), *keep, sequence.cast("long").alias("sequence_id"), offset.cast("long").alias("offset"))
