"""Benchmark decontamination: a BM25 inverted index of test items, queried by every training passage.

Texts are lower-cased and split at everything but letters, digits and non-ASCII characters. Each document is cut into
chunks of as many words as the longest item has; a passage is two neighbouring chunks, so an item that stands in a document
stands in one passage. An item's score is its BM25 score for the passage's distinct terms, divided by its score for all
terms of its own, so one threshold serves all items.

Items are indexed in blocks of BLOCK. For a passage, block-max WAND adds up the largest weights that its terms have in each
block: terms with few blocks (essential) exactly, common ones by their largest weight anywhere. Blocks that can't reach the
threshold are skipped, those left are scored in full. What is retrieved is verified: either the shares of the item's question
and of its answer (its last sentence; for one sentence its last third) whose ``n``-word shingles stand in the passage both
reach ``overlap``, or so does the share of the whole item's words that lie in shingles which the passage has. These have
``n`` words, fewer in items of under ``n / (1 - overlap)`` words (two at least), so that one changed word does not hide an
item of ten words or more however short its answer is.

The index comes in parts of about POSTINGS postings (a few MB each), built in tasks from statistics of all items and
written out. All passages query every part: one part is broadcast at a time, and released before the next. With several
parts the documents are written once with a row number, and each pass writes the matches it finds.

Defined results: null or empty texts match nothing; items without terms match nothing; a null doc_id is carried; repeated
rows are judged alike; repeated item rows are items of their own; extra columns are carried along, but a column named matches is replaced.
"""

import pickle
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from .native_spans import fresh
from .textcols import U, Words, map_slices, mix, saved, small, text_bytes

BLOCK = 8
POSTINGS = 500_000
CELLS = 1 << 20  # sums of blocks held at a time, however long a text and however many the items
K1, B = 1.2, 0.75
MATCH = ArrayType(StructType([StructField("item_id", LongType()), *(StructField(c, DoubleType()) for c in ("score", "question_overlap", "answer_overlap"))]))
PLAIN = np.full(256, 32, np.uint8)
for _low, _high in ((48, 58), (97, 123), (128, 256)):
    PLAIN[_low:_high] = np.arange(_low, _high)
PLAIN[65:91] = np.arange(97, 123)


def plain_words(texts: list[str]) -> Words:
    data, offsets = text_bytes(pa.array(texts, pa.large_string()))
    return Words(PLAIN[data], offsets)


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the distinct ``n``-word shingles; a shorter text is one shingle."""
    if not len(hashes):
        return np.zeros(0, U)
    return np.unique(shingle_hashes(hashes, min(n, len(hashes))))


def shingle_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """The hash of the ``n``-word shingle at every word that one starts at."""
    out = np.zeros(max(len(hashes) - n + 1, 0), U)
    for k in range(n):
        out = mix(out * U(0x9E3779B97F4A7C15) + hashes[k : len(hashes) - n + 1 + k] + U(k + 1)) if len(out) else out
    return out


def covered(item: np.ndarray, passage: np.ndarray, n: int) -> float:
    """The share of the item's words that lie in ``n``-word shingles of the passage."""
    at = np.flatnonzero(np.isin(shingle_hashes(item, n), shingle_hashes(passage, n)))
    return len(np.unique(at[:, None] + np.arange(n))) / max(len(item), 1)


def question_answer(text: str) -> tuple[str, str]:
    parts = re.split(r"(?<=[.?!])\s+", text.strip())
    if len(parts) > 1:
        return " ".join(parts[:-1]), parts[-1]
    words = text.split()
    cut = len(words) - max(1, len(words) // 3)
    return " ".join(words[:cut]), " ".join(words[cut:])


class Index:
    """Items of one part: terms (sorted hashes), postings by term with weights, block maxima by term, shingles to verify."""

    def __init__(self, items: list[tuple[int, str]], df: tuple[np.ndarray, np.ndarray], n_items: int, mean_words: float, longest: int, n: int):
        items = sorted(items)
        self.ids = np.array([i for i, _ in items], np.int64)
        words = plain_words([t for _, t in items])
        count = np.diff(words.of)
        self.longest = longest
        doc = words.doc()
        pairs, tf = np.unique(np.stack([words.hash, doc.astype(U)]), axis=1, return_counts=True)
        self.terms, term = np.unique(pairs[0], return_inverse=True)
        item = pairs[1].astype(np.int64)
        order = np.argsort(df[0])
        freq = df[1][order][np.searchsorted(df[0], self.terms.view(np.int64), sorter=order)].astype(float)
        idf = np.log(1 + (n_items - freq + 0.5) / (freq + 0.5))
        weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * count[item] / mean_words))
        whole = np.bincount(item, weight, len(items))
        self.item, self.weight = item, weight / whole[item]
        self.at = np.searchsorted(term, np.arange(len(self.terms) + 1))
        blocks = -(-max(len(items), 1) // BLOCK)
        key, where = np.unique(term * blocks + item // BLOCK, return_inverse=True)
        most = np.zeros(len(key))
        np.maximum.at(most, where, self.weight)
        self.blocks, self.block, self.most = blocks, key % blocks, most
        self.block_at = np.searchsorted(key // blocks, np.arange(len(self.terms) + 1))
        self.common = np.diff(self.block_at) > max(1, blocks // 2)
        self.bound = np.zeros(len(self.terms))
        np.maximum.at(self.bound, term, self.weight)
        self.words = [words.hash[words.of[k] : words.of[k + 1]] for k in range(len(items))]
        both = [question_answer(t) for _, t in items]
        q, a = plain_words([x for x, _ in both]), plain_words([x for _, x in both])
        self.question, self.answer = ([(min(n, int(x.of[k + 1] - x.of[k])), grams(x.hash[x.of[k] : x.of[k + 1]], n)) for k in range(len(items))] for x in (q, a))

    def expand(self, at: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the entries of ``terms`` in a table with offsets ``at``, and which term each is of."""
        size = at[terms + 1] - at[terms]
        of = np.cumsum(size) - size
        return np.arange(size.sum()) + np.repeat(at[terms] - of, size), np.repeat(np.arange(len(terms)), size)


def retrieve(ix: Index, words: Words, least: float) -> list[tuple[int, int, int, int, float]]:
    """(document, first word, end word, item, score) of all passages and items at or above ``least``."""
    size, docs = ix.longest, len(words.of) - 1
    count = np.diff(words.of)
    chunks = -(-count // size)
    first = np.concatenate([[0], np.cumsum(chunks)])
    place = np.searchsorted(ix.terms, words.hash)
    hit = np.flatnonzero(ix.terms[np.minimum(place, len(ix.terms) - 1)] == words.hash)
    if not len(hit):
        return []
    doc = np.searchsorted(words.of, hit, side="right") - 1
    chunk = first[doc] + (hit - words.of[doc]) // size
    v = len(ix.terms)
    pair = np.unique(chunk * v + place[hit])
    chunk, term = pair // v, pair % v
    begin = np.searchsorted(chunk, np.arange(first[-1] + 1))
    owner = np.repeat(np.arange(docs), chunks)
    size_of = np.where(ix.common[term], 0, ix.block_at[term + 1] - ix.block_at[term])
    cost = np.concatenate([[0], np.cumsum(np.bincount(chunk, size_of, first[-1]) + ix.blocks)])
    out, at = [], 0
    while at < first[-1]:
        to = max(at + 1, int(np.searchsorted(cost, cost[at] + CELLS, side="right")) - 1)
        for p, open_blocks in reachable(ix, chunk, term, begin, owner, at, to, least):
            two = p + 1 < first[-1] and owner[p + 1] == owner[p]
            terms = np.unique(term[begin[p] : begin[p + 1 + two]])
            entry, _ = ix.expand(ix.at, terms)
            entry = entry[open_blocks[ix.item[entry] // BLOCK]]
            scores = np.bincount(ix.item[entry], ix.weight[entry], len(ix.ids))
            start = words.of[owner[p]] + (p - first[owner[p]]) * size
            end = min(start + 2 * size, words.of[owner[p] + 1])
            out += [(int(owner[p]), int(start), int(end), int(i), float(scores[i])) for i in np.flatnonzero(scores >= least)]
        at = to
    return out


def reachable(ix: Index, chunk: np.ndarray, term: np.ndarray, begin: np.ndarray, owner: np.ndarray, at: int, to: int, least: float) -> Iterator[tuple[int, np.ndarray]]:
    """The passages that begin at chunks ``at`` to ``to`` (exclusive) and have a block whose bound reaches ``least``, with a
    mask of these blocks. ``chunk`` and ``term`` are the distinct terms of each chunk, ``begin`` the places of its first."""
    last = min(to + 1, len(owner))  # a passage needs the chunk after its first
    mine = slice(begin[at], begin[last])
    chunk, term, n = chunk[mine] - at, term[mine], last - at
    rest = np.bincount(chunk, np.where(ix.common[term], ix.bound[term], 0), n)
    rare = ~ix.common[term]
    entry, which = ix.expand(ix.block_at, term[rare])
    upper = np.bincount(chunk[rare][which] * ix.blocks + ix.block[entry], ix.most[entry], n * ix.blocks).reshape(-1, ix.blocks) + rest[:, None]
    both = upper[: to - at].copy()
    same = np.flatnonzero(owner[at + 1 : last] == owner[at : last - 1])
    both[same] += upper[same + 1]
    enough = both >= least - 1e-9
    for p in np.flatnonzero(enough.any(axis=1)):
        yield int(p) + at, enough[p]


def indexes(items: DataFrame, n: int, postings: int) -> tuple[DataFrame, int]:
    """(part, index): the pickled index of each part of ``items``, written out, and the number of parts."""

    def terms(rows, data, offsets):
        words = Words(PLAIN[data], offsets)
        pairs = np.unique(np.stack([words.hash, words.doc().astype(U)]), axis=1)
        return [rows.column("item_id").take(pa.array(pairs[1].astype(np.int64))), pairs[0].view(np.int64)]

    entries = saved(map_slices(items, "text", terms, "item_id long, term long"))
    sizes = map_slices(items, "text", lambda rows, data, offsets: [np.diff(Words(PLAIN[data], offsets).of).astype(np.int64)], "n long")
    n_items, mean_words, longest = sizes.agg(F.count("*"), F.avg("n"), F.max("n")).first()
    parts = -(-entries.count() // postings)
    part = F.pmod(F.xxhash64("item_id"), F.lit(max(parts, 1))).cast("int").alias("part")

    def build(mine: pa.Table, df: pa.Table) -> pa.Table:
        if not len(mine):
            return pa.table([pa.array([], pa.int32()), pa.array([], pa.binary())], ["part", "index"])
        rows = list(zip(mine.column("item_id").to_pylist(), mine.column("text").to_pylist()))
        made = Index(rows, (df.column("term").to_numpy(), df.column("df").to_numpy()), n_items, mean_words or 1.0, max(longest, 1), n)
        return pa.table([pa.array([mine.column("part")[0].as_py()], pa.int32()), pa.array([pickle.dumps(made)], pa.binary())], ["part", "index"])

    df = entries.select(part, "term").distinct().join(entries.groupBy("term").agg(F.count("*").alias("df")), "term")
    both = items.select(part, "item_id", "text").groupBy("part").cogroup(df.select("part", "term", "df").groupBy("part"))
    return saved(both.applyInArrow(build, "part int, index binary")), parts


def decontaminate(docs: DataFrame, items: DataFrame, least: float = 0.5, n: int = 5, overlap: float = 0.8, text_col: str = "text", postings: int = POSTINGS) -> DataFrame:
    """``docs`` with a column matches: the verified items of each document (the best passage's figures), by item id.
    ``items``: item_id, text."""
    spark = docs.sparkSession
    docs = docs.drop("matches")
    made, parts = indexes(items.filter("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("long"), "text"), n, postings)

    def index(part: int):
        return spark.sparkContext.broadcast(pickle.loads(made.filter(F.col("part") == part).first()["index"]))

    if parts == 0:
        return docs.withColumn("matches", F.array().cast(MATCH))
    if parts == 1:
        return matched(docs, index(0), least, n, overlap, text_col)
    row, found = fresh(docs, "row"), []
    docs = saved(docs.withColumn(row, F.monotonically_increasing_id()))
    for part in range(parts):
        if made.filter(F.col("part") == part).isEmpty():
            continue
        shared = index(part)
        found.append(saved(matched(docs.select(row, text_col), shared, least, n, overlap, text_col).filter(F.size("matches") > 0).select(row, "matches")))
        shared.destroy()
    hits = found[0]
    for more in found[1:]:
        hits = hits.unionByName(more)
    hits = saved(hits.groupBy(row).agg(F.array_sort(F.flatten(F.collect_list("matches"))).alias("matches")))
    out = docs.join(small(hits), row, "left").drop(row)
    return out.withColumn("matches", F.coalesce("matches", F.array().cast(MATCH)))


def matched(docs: DataFrame, index, least: float, n: int, overlap: float, text_col: str) -> DataFrame:
    """``docs`` with a column matches: what the items of one part find."""
    kinds = pa.list_(pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("question_overlap", pa.float64()), ("answer_overlap", pa.float64())]))

    def share(of: tuple[int, np.ndarray], passage: np.ndarray) -> float:
        size, shingles = of
        return float(np.isin(shingles, grams(passage, size)).mean()) if size else 1.0

    def each(rows, data, offsets):
        ix, best = index.value, [{} for _ in range(len(rows))]
        words = Words(PLAIN[data], offsets)
        if len(ix.terms):
            for doc, start, end, item, score in retrieve(ix, words, least):
                q, a = (share(x[item], words.hash[start:end]) for x in (ix.question, ix.answer))
                whole = ix.words[item]
                short = min(n, max(2, int(len(whole) * (1 - overlap) + 1e-9)), len(whole))
                if (q >= overlap and a >= overlap or covered(whole, words.hash[start:end], short) >= overlap) and (item not in best[doc] or score > best[doc][item]["score"]):
                    best[doc][item] = {"item_id": int(ix.ids[item]), "score": score, "question_overlap": q, "answer_overlap": a}
        return [*rows.columns, pa.array([[b[k] for k in sorted(b)] for b in best], kinds)]

    schema = StructType([*docs.schema.fields, StructField("matches", MATCH)])
    return map_slices(docs, text_col, each, schema, [*docs.columns, "matches"])
