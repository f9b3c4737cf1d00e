"""Collocations: phrases of two to four words whose words follow each other more often than their own counts suggest.

Texts are cut into pieces at punctuation and line breaks, and pieces into words. Every word has a 64-bit hash; prefix sums of
hash times power give the fingerprint of every n-gram of a piece at once. Tasks count fingerprints before the shuffle, which
adds counts and keeps one occurrence (text, byte) of each; a row of it is three numbers. Pairs are only counted where both
words are frequent and a sketch has ``least`` or more: counters by hash, which tasks send as gaps and small counts. Longer
n-grams are only counted where all their pairs are, and by a sketch of their own. Bit maps of bounded size say so; they let some rare ones through and lose
none.

Fingerprints that reach ``least`` are read back from their occurrence, and only these. A second polynomial, modulo a prime,
checks them: the text that an occurrence points to must give both numbers, and a fingerprint that was seen with two check
numbers stands for several phrases, which are then counted by their texts. Counts are those of texts either way.

Defined results: null texts are empty, null languages are "und". Repeated rows count as often as they stand there; other
columns and ids are not looked at.
"""

import re
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graincloak.llm.textcols import BYTE, LOWER, U, map_slices, mix, prefix, saved, slices, small, span_hash

PRIME = U(2**31 - 1)
BASES = (48271, 16807)  # of the check numbers of words and of phrases
STOPS = np.zeros(256, bool)
STOPS[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = True  # fixed values: what ends a piece
GAPS = STOPS.copy()
GAPS[[0x20, 0x09]] = True
WORD, GAP = re.compile(rb"[^ \t.,;:!?\n-\r]+"), re.compile(rb"[ \t]+")
HELD = 1_500_000  # fingerprints that a task holds
LOW = 2**32 - 1  # two numbers share a long: check and text, count and byte
MAP_BITS = 28  # the largest bit map: 32 MB
RANGE = 22  # log2 of the counters that are added up together
POINTERS = 1_000_000  # that are broadcast; more meet the texts in a shuffle
_tables: dict[int, np.ndarray] = {}


def prime_powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo the prime."""
    table = _tables.get(base, np.ones(1, U))
    while len(table) < n:
        table = np.concatenate([table, table * U(pow(base, len(table), int(PRIME))) % PRIME])
    _tables[base] = table
    return table[:n]


def prime_spans(symbols: np.ndarray, base: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Polynomials of spans of ``symbols`` modulo the prime, each as if it began at 0; below 2**31."""
    sums = np.zeros(len(symbols) + 1, U)
    np.cumsum(symbols % PRIME * prime_powers(base, len(symbols)) % PRIME, out=sums[1:])
    back = prime_powers(pow(base, -1, int(PRIME)), len(symbols) + 1)
    return (sums[end] - sums[start]) % PRIME * back[start] % PRIME


class Pieces:
    """The words of a slice: ``start``, ``end`` (bytes), ``doc``, and ``left``: how many words its piece has from it on."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, marks: np.ndarray, bits: int):
        word = ~GAPS[data]
        first = np.zeros(len(data) + 1, bool)
        first[offsets] = True
        before, after = np.ones(len(data), bool), np.ones(len(data), bool)
        before[1:], after[:-1] = ~word[:-1], ~word[1:]
        self.start = np.flatnonzero(word & (before | first[:-1]))
        self.end = np.flatnonzero(word & (after | first[1:])) + 1
        self.doc = np.searchsorted(offsets, self.start, "right") - 1
        lower = LOWER[data]
        self.hash = span_hash(prefix(BYTE[lower]), self.start, self.end)
        self.check = prime_spans((lower + 1).astype(U), BASES[0], self.start, self.end)
        piece = np.cumsum(STOPS[data] | first[:-1])[self.start] if len(data) else np.zeros(0, int)
        new = np.flatnonzero(np.append(True, (piece[1:] != piece[:-1]) | (self.doc[1:] != self.doc[:-1]))) if len(piece) else np.zeros(0, int)
        self.left = np.repeat(np.append(new[1:], len(piece)), np.diff(np.append(new, len(piece)))) - np.arange(len(piece))
        self.sums, self.marks, self.mask = prefix(self.hash), marks, U((1 << bits) - 1)

    def grams(self, n: int) -> np.ndarray:
        """The words at which an n-gram begins."""
        return np.flatnonzero(self.left >= n)

    def prints(self, at: np.ndarray, n: int) -> np.ndarray:
        """Fingerprints of the n-grams at these words; each language has its own. The last four bits say n."""
        return mix(span_hash(self.sums, at, at + n) ^ self.marks[self.doc[at]]) & self.mask & ~U(15) | U(n)

    def checks(self, at: np.ndarray, n: int) -> np.ndarray:
        return prime_spans(self.check, BASES[1], at, at + n).astype(np.int64)

    def texts(self, data: np.ndarray, at: np.ndarray, n: int) -> list[str]:
        lower = LOWER[data].astype(np.uint8).tobytes()
        return [b" ".join(lower[self.start[j] : self.end[j]] for j in range(i, i + n)).decode("utf-8", "replace") for i in at]


def language_marks(rows: pa.RecordBatch) -> np.ndarray:
    return rows.column("mark").to_numpy(zero_copy_only=False).view(U)


def in_map(bits: np.ndarray, prints: np.ndarray) -> np.ndarray:
    place = prints >> U(4) & U(8 * len(bits) - 1)
    return (bits[(place >> U(3)).astype(np.int64)] >> (place & U(7)).astype(np.uint8)) & 1 == 1


def bit_map(frequent: DataFrame) -> np.ndarray:
    """A bit for each fingerprint, in a map of 16 bits for each, of at most 2**MAP_BITS: what reaches the driver is bounded."""
    bits = min(MAP_BITS, max(10, (16 * frequent.count()).bit_length()))
    placed = frequent.select(F.expr(f"shiftrightunsigned(print, 4) & {(1 << bits) - 1}").alias("place"))
    words = placed.groupBy(F.expr("shiftright(place, 5)").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(place & 31 AS INT))")).alias("on"))
    rows = words.toArrow()
    out = np.zeros((1 << bits) // 32, np.uint32)
    out[rows.column("word").to_numpy()] = rows.column("on").to_numpy()
    return out.view(np.uint8)


def sketch(docs: DataFrame, sizes: tuple[int, ...], inside: np.ndarray, inner: int, bits: int, least: int, size: int) -> np.ndarray:
    """A bit for each of 2**``size`` counters: whether it has seen ``least`` of the n-grams whose ``inner``-grams are in the map
    ``inside``. Tasks send the counters that they raised, in order, as gaps of two bytes and counts of one; counts add up in
    ranges of counters, and only the bits come to the driver."""
    held, sent, width, most = HELD, docs.sparkSession.sparkContext.broadcast(inside), min(size, RANGE), min(least, 255)

    def send(places):
        places, counts = np.unique(np.concatenate(places), return_counts=True)
        counts = np.minimum(counts, most).astype(np.uint8)
        for part in np.unique(places >> width):
            some = slice(*np.searchsorted(places, [part << width, (part + 1) << width]))
            gaps = np.diff(places[some] - (part << width), prepend=-1)
            jumps = (gaps - 1) // 65535  # entries that only move on
            at = np.cumsum(jumps + 1) - 1
            steps, raised = np.full(at[-1] + 1, 65535, np.uint16), np.zeros(at[-1] + 1, np.uint8)
            steps[at], raised[at] = gaps - jumps * 65535, counts[some]
            yield pa.RecordBatch.from_arrays([pa.array([int(part)]), pa.array([steps.tobytes()]), pa.array([raised.tobytes()])], ["part", "steps", "raised"])

    def count(batches):
        waiting, total = [], 0
        for batch in batches:
            for rows, data, offsets in slices(batch, "text"):
                pieces = Pieces(data, offsets, language_marks(rows), bits)
                good, at = np.zeros(len(pieces.start), bool), pieces.grams(inner)
                good[at] = in_map(sent.value, pieces.prints(at, inner))
                for n in sizes:
                    at = pieces.grams(n)
                    for j in range(n - inner + 1):
                        at = at[good[at + j]]
                    waiting.append((pieces.prints(at, n) >> U(4) & U((1 << size) - 1)).astype(np.int64))
                    total += len(at)
                if total > 2 * held:
                    yield from send(waiting)
                    waiting, total = [], 0
        if total:
            yield from send(waiting)

    def add(batches):
        now, sums = None, np.zeros(1 << width, np.uint32)
        for batch in batches:
            for part, steps, raised in zip(*(batch.column(c).to_pylist() for c in ("part", "steps", "raised"))):
                if part != now and now is not None:
                    yield full(now, sums)
                    sums[:] = 0
                now, counts = part, np.frombuffer(raised, np.uint8)
                at = np.cumsum(np.frombuffer(steps, np.uint16).astype(np.int64)) - 1
                sums[at] = np.minimum(sums[at] + counts, most)  # places differ within a blob; those of jumps add nothing
        if now is not None:
            yield full(now, sums)

    def full(part, sums):
        bits = np.packbits(sums >= most, bitorder="little")
        return pa.RecordBatch.from_arrays([pa.array([part]), pa.array([bits.tobytes()])], ["part", "bits"])

    parts = docs.select("text", "mark").mapInArrow(count, "part long, steps binary, raised binary").repartition("part").sortWithinPartitions("part")
    out = np.zeros((1 << size) // 8, np.uint8)
    for row in parts.mapInArrow(add, "part long, bits binary").toLocalIterator():  # 2**MAP_BITS bits at most
        out[(row.part << width) // 8 :][: (1 << width) // 8] = np.frombuffer(row.bits, np.uint8)
    return out


class Counter:
    """Counts of fingerprints, as sorted arrays of about ``held`` at a time: fingerprint, seen (check, key) and count."""

    def __init__(self, held: int):
        self.held, self.done, self.open, self.waiting = held, None, [], 0

    def add(self, columns: list[np.ndarray]):
        self.open.append(columns)
        self.waiting += len(columns[0])
        if self.waiting > max(self.held // 2, 0 if self.done is None else len(self.done[0])):
            self.merge()
        if self.done is not None and len(self.done[0]) > self.held:
            yield self.batch()

    def merge(self):
        if self.open:
            prints, seen, count = (np.concatenate(c) for c in zip(*self.open, *([] if self.done is None else [self.done])))
            order = np.argsort(prints, kind="stable")
            prints, seen, count = prints[order], seen[order], count[order]
            check = seen >> 32
            new = np.flatnonzero(np.append(True, (prints[1:] != prints[:-1]) | (check[1:] != check[:-1]))) if len(order) else order
            at = (count & LOW)[new]
            count = np.add.reduceat(count >> 32, new) if len(new) else count
            self.done, self.open, self.waiting = [prints[new], seen[new], count << 32 | at], [], 0

    def batch(self):
        self.merge()
        prints, seen, count = self.done
        self.done = None
        return pa.RecordBatch.from_arrays([pa.array(prints.view(np.int64)), pa.array(seen), pa.array(count)], ["print", "seen", "count"])


def count_prints(docs: DataFrame, sizes: tuple[int, ...], inside: np.ndarray | None, whole: np.ndarray | None, inner: int, bits: int) -> DataFrame:
    """(print, f, seen, other, at): counts of the n-grams of these sizes whose ``inner``-grams are all in the map ``inside``
    and that are, if longer, in the map ``whole`` themselves,
    with the least and greatest number of check and text that was seen, and the byte of the former. Size 0 stands for all
    words of a language."""
    held, sent = HELD, docs.sparkSession.sparkContext.broadcast((inside, whole))  # at most 2**MAP_BITS bits each

    def run(batches):
        counter = Counter(held)
        for batch in batches:
            for rows, data, offsets in slices(batch, "text"):
                pieces = Pieces(data, offsets, language_marks(rows), bits)
                keys, begin, one = rows.column("key").to_numpy(), offsets[pieces.doc], np.int64(1 << 32)
                if 0 in sizes:
                    yield from counter.add([pieces.marks & ~U(15), keys, np.bincount(pieces.doc, minlength=len(rows)) << 32])
                good = np.ones(len(pieces.start), bool)
                parts, wholes = sent.value
                if parts is not None:
                    good[:] = False
                    at = pieces.grams(inner)
                    good[at] = in_map(parts, pieces.prints(at, inner))
                for n in (n for n in sizes if n):
                    at = pieces.grams(n)
                    for j in range(n - inner + 1 if parts is not None else 0):
                        at = at[good[at + j]]
                    if parts is not None and n > inner:
                        at = at[in_map(wholes, pieces.prints(at, n))]
                    yield from counter.add([pieces.prints(at, n), pieces.checks(at, n) << 32 | keys[pieces.doc[at]], one | (pieces.start[at] - begin[at])])
        if counter.open or counter.done is not None:
            yield counter.batch()
        pa.default_memory_pool().release_unused()

    parts = docs.select("text", "mark", "key").mapInArrow(run, "print long, seen long, count long").repartition("print")
    sums = (F.sum(F.expr("shiftright(count, 32)")).alias("f"), F.min("seen").alias("seen"), F.max("seen").alias("other"), F.min_by(F.expr(f"count & {LOW}"), "seen").alias("at"))
    return parts.groupBy("print").agg(*sums)


def phrase_at(raw: bytes, at: int, n: int) -> bytes | None:
    """The ``n`` words from byte ``at`` on, joined by a space, if a piece has them there."""
    words = []
    while True:
        word = WORD.match(raw, at)
        if not word:
            return None
        words.append(word[0])
        if len(words) == n:
            return b" ".join(words).lower()
        gap = GAP.match(raw, word.end())
        if not gap:
            return None
        at = gap.end()


def read_back(docs: DataFrame, frequent: DataFrame, bits: int) -> DataFrame:
    """(lang, phrase, f) for the frequent fingerprints: phrases from the texts that their occurrences point to, if the text
    gives the fingerprint and its check. Rows of equal texts give a phrase once."""
    pointers = F.collect_list(F.struct("print", F.expr("shiftright(seen, 32)").alias("check"), "at", "f"))
    wanted = saved(frequent.groupBy(F.expr(f"seen & {LOW}").alias("key")).agg(pointers.alias("wanted")))
    pointed = docs.join(F.broadcast(wanted) if frequent.count() <= POINTERS else wanted, "key")

    def run(batches):
        found, texts = set(), set()
        for batch in batches:
            out = []
            for key, wanted, lang, mark, text in zip(*(batch.column(c).to_pylist() for c in ("key", "wanted", "lang", "mark", "text"))):
                if (key, hash(text)) not in texts:
                    texts.add((key, hash(text)))
                    raw = text.encode()
                    tried = ((w, phrase_at(raw, w["at"], w["print"] & 15)) for w in wanted if w["print"] not in found)
                    out += [(w, phrase, lang, mark) for w, phrase in tried if phrase]
            if not out:
                continue
            data = np.frombuffer(b"".join(x[1] for x in out), np.uint8)
            offsets = np.append(0, np.cumsum([len(x[1]) for x in out]))
            pieces = Pieces(data, offsets, np.array([x[3] for x in out]).view(U), bits)
            first, sizes = np.searchsorted(pieces.start, offsets[:-1]), np.array([x[0]["print"] & 15 for x in out])
            good = np.zeros(len(out), bool)
            for n in np.unique(sizes):
                some = np.flatnonzero(sizes == n)
                prints, checks = pieces.prints(first[some], n).view(np.int64), pieces.checks(first[some], n)
                good[some] = (prints == [out[i][0]["print"] for i in some]) & (checks == [out[i][0]["check"] for i in some])
            out = [x for x, ok in zip(out, good) if ok]
            found |= {x[0]["print"] for x in out}
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in ([x[0]["print"] for x in out], [x[2] for x in out], [x[1].decode() for x in out], [x[0]["f"] for x in out])], ["print", "lang", "phrase", "f"])

    return pointed.mapInArrow(run, "print long, lang string, phrase string, f long").dropDuplicates(["print"]).select("lang", "phrase", "f")


def recount(docs: DataFrame, collided: DataFrame, sizes: tuple[int, ...], least: int, bits: int) -> DataFrame:
    """(lang, phrase, f) of all frequent phrases whose fingerprint is among the ``collided``, counted by their texts."""
    sent = docs.sparkSession.sparkContext.broadcast(bit_map(collided))

    def each(rows, data, offsets):
        pieces, out, langs = Pieces(data, offsets, language_marks(rows), bits), {}, rows.column("lang").to_pylist()
        for n in (n for n in sizes if n):
            at = pieces.grams(n)
            prints = pieces.prints(at, n)
            hit = in_map(sent.value, prints)
            for p, doc, text in zip(prints[hit].view(np.int64).tolist(), pieces.doc[at[hit]], pieces.texts(data, at[hit], n)):
                out[p, langs[doc], text] = out.get((p, langs[doc], text), 0) + 1
        return [*map(list, zip(*out)), list(out.values())] if out else None

    found = map_slices(docs.select("text", "lang", "mark"), "text", each, "print long, lang string, phrase string, n long")
    found = found.groupBy("print", "lang", "phrase").agg(F.sum("n").alias("f")).filter(F.col("f") >= least)
    return found.join(collided.select("print"), "print", "left_semi").select("lang", "phrase", "f")


def phrase_counts(df: DataFrame, text: str = "text", lang: str = "lang", most: int = 4, least: int = 30, bits: int = 64) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, f) for the phrases of up to ``most`` words that occur ``least`` times, and (lang, n): all words.
    ``bits``: how much of a fingerprint is used."""
    docs = df.select(F.coalesce(text, F.lit("")).alias("text"), F.coalesce(lang, F.lit("und")).alias("lang"))
    docs = docs.withColumns({"mark": F.xxhash64("lang"), "key": F.xxhash64("lang", "text").bitwiseAND(LOW)})
    all_frequent, all_found, inside, whole = [], [], None, None
    for sizes, inner in (((0, 1), 0), (tuple(range(2, most + 1)), 2)):
        if not sizes:
            break
        counted = saved(count_prints(docs, sizes, inside, whole, inner, bits).filter((F.col("f") >= least) | (F.expr("print & 15") == 0)))
        frequent, alike = counted.filter("print & 15 > 0"), F.expr("shiftright(seen, 32) = shiftright(other, 32)")
        all_frequent.append(frequent.filter(alike))
        collided = saved(frequent.filter(~alike).select("print"))
        if not collided.isEmpty():
            all_found.append(recount(docs, collided, sizes, least, bits))
        if 0 in sizes:
            names = docs.select("lang", F.expr("mark & ~15L").alias("print")).distinct()
            words = saved(counted.filter("print & 15 = 0").join(names, "print").select("lang", F.col("f").alias("n")))
            total = words.agg(F.sum("n")).first()[0] or 0
            size = min(MAP_BITS, max(10, (2 * total).bit_length()))
            inside = sketch(docs, (2,), bit_map(frequent), 1, bits, least, size)
            whole = sketch(docs, tuple(range(3, most + 1)), inside, 2, bits, least, size)
    all_found.append(read_back(docs, saved(reduce(DataFrame.unionByName, all_frequent)), bits))
    return saved(reduce(DataFrame.unionByName, all_found)), words


def collocations(df: DataFrame, text: str = "text", lang: str = "lang", most: int = 4, least: int = 30, scale: int = 2_000_000, covered: int = 80, top: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases. A phrase is cut in two where the score, the
    floor of scale * a / (l + r), is lowest (the first such cut); it is left out if a longer phrase that holds it has at least
    ``covered`` percent of its occurrences."""
    counts, words = phrase_counts(df, text, lang, most, least)
    counts = counts.withColumn("words", F.split("phrase", " ")).withColumn("n_words", F.size("words"))
    long = counts.filter("n_words > 1")
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    cut = long.select("lang", "phrase", F.col("f").alias("a"), "words", F.explode(F.sequence(F.lit(1), F.col("n_words") - 1)).alias("k"))
    part = lambda start, size: F.array_join(F.slice("words", start, size), " ")
    cut = cut.withColumns({"first": part(F.lit(1), F.col("k")), "rest": part(F.col("k") + 1, F.size("words") - F.col("k"))})
    for c, n in (("first", "l"), ("rest", "r")):
        cut = cut.join(counts.select("lang", F.col("phrase").alias(c), F.col("f").alias(n)), ["lang", c])
    cut = cut.withColumn("score", F.expr(f"(CAST({scale} AS DECIMAL(20,0)) * CAST(a AS DECIMAL(18,0))) DIV (CAST(l AS DECIMAL(20,0)) + r)"))
    best = cut.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("b")).select("lang", "phrase", "b.*")
    inner = long.filter("n_words > 2").select("lang", "words", "n_words", F.col("f").alias("outer_f"))
    inner = inner.withColumn("size", F.explode(F.sequence(F.lit(2), F.col("n_words") - 1))).withColumn("start", F.explode(F.sequence(F.lit(1), F.col("n_words") - F.col("size") + 1)))
    inner = inner.groupBy("lang", part(F.col("start"), F.col("size")).alias("phrase")).agg(F.max("outer_f").alias("outer_f"))
    kept = best.join(inner, ["lang", "phrase"], "left").filter(F.col("outer_f").isNull() | (wide("outer_f") * 100 < wide("a") * covered))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    ranked = kept.withColumn("rank", rank).filter(F.col("rank") <= top)
    return ranked.join(small(words), "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
