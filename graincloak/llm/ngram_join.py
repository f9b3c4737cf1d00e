"""N-gram Jaccard self-join: rare-first prefix filtering, verified once per pair, down to connected components.

Every text becomes a set of word n-gram hashes. Two texts link when ``den * |A & B| >= num * |A | B|``.

1. A count sketch of all n-grams orders n-grams rare first; any fixed order gives right results, so its errors cost time
   only. It has about one counter for 16 n-grams, up to 2**MOST_BITS (16 MB, as it is broadcast).
2. Texts with the same set share a class; only its first document goes on, so groups of copies collapse before any join.
3. The first ``n - ceil(t n) + 1`` n-grams of a set are its prefix: sets that link share one. Prefix n-grams are dealt once,
   those that the sketch counts more than SPLIT times over several salts. N-grams that stand in one set only are dropped,
   as are those whose other sets are all of sizes that cannot link.
4. Candidates pass length, positional and suffix filters (the last on counts of the set in RANGES hash ranges) and are
   verified once. So as not to emit all pairs of a bucket (the sets with one prefix n-gram), members are first compared with
   one pivot of their bucket (of its salt, where there are several). Buckets whose sets are now in one component are
   dropped; in the others, members are compared with sets of up to four other components. Where very many pairs of different
   components are left in a bucket, the n-grams that stand in one set of such buckets only are counted: they are in no
   intersection, which bounds every similarity of a set. There, members are compared with the four sets that have fewest of
   them (the text that others were made from, say). Last, in buckets that still hold several components, all pairs of
   different components are compared, in blocks where there are very many of them, without sets that by this bound link with
   no size of their bucket. Any two linked texts end up in one component, and no pair inside a component is compared again.

Defined results: null or empty texts have an empty set and link with nothing; rows that repeat an id are one node, with the
links of all their texts; rows with a null id link with nothing (null id and component_id out); extra columns are ignored.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .textcols import U, Words, blobs, map_slices, mix, saved, signed, slices, small, text_bytes, tidy

LEAST_BITS, MOST_BITS = 16, 24
CHUNKS = 64
RANGES = 64
SPLIT = 2_000
PAIRS = 10_000
NULL_ID = -(1 << 63)


def shingles(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word n-grams of each document of a slice, and the documents' offsets in them. Shorter documents give
    their whole sequence as one n-gram; documents without words give none."""
    count = np.diff(words.of)
    grams = np.where(count >= n, count - n + 1, (count > 0).astype(int))
    of = np.concatenate([[0], np.cumsum(grams)])
    at = np.arange(of[-1]) + np.repeat(words.of[:-1] - of[:-1], grams)
    width = np.repeat(np.minimum(count, n), grams)
    out = np.zeros(len(at), U)
    for k in range(n):
        live = width > k
        out[live] = mix(out[live] * U(0x9E3779B97F4A7C15) + words.hash[at[live] + k] + U(k + 1))
    return out, of


def sketch(docs: DataFrame, n: int) -> np.ndarray:
    """Approximate counts of all n-grams, by the low bits of their hash (counts above 255 stand for their logarithm, see
    ``estimate``). Tasks send counts of up to 15, two to a byte; a chunk of counters is added up as its parts stream by."""
    words = (docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // 6
    size = 1 << min(MOST_BITS, max(LEAST_BITS, int(words // 16).bit_length()))
    part = size // CHUNKS

    def count(batches):
        total, waiting = np.zeros(size, np.uint8), []

        def add_up():
            if waiting:
                slot, times = np.unique(np.concatenate(waiting), return_counts=True)
                total[slot] = np.minimum(total[slot] + times, 15)
                waiting.clear()

        for batch in batches:
            for _, data, offsets in slices(batch, "text"):
                waiting.append((shingles(Words(data, offsets, lower=True), n)[0] & U(size - 1)).astype(np.uint32))
                if sum(map(len, waiting)) > 1 << 20:
                    add_up()
        add_up()
        if total.any():
            packed = total[0::2] | (total[1::2] << 4)
            yield pa.RecordBatch.from_arrays([pa.array(range(CHUNKS), pa.int32()), blobs(packed, np.arange(CHUNKS + 1) * (part // 2))], ["chunk", "counts"])

    def add(batches):
        totals = {}
        for batch in batches:
            for chunk, blob in zip(batch.column("chunk").to_pylist(), batch.column("counts")):
                packed = np.frombuffer(blob.as_buffer(), np.uint8)
                total = totals.setdefault(chunk, np.zeros(part, np.int64))
                total[0::2] += packed & 15
                total[1::2] += packed >> 4
        for chunk, total in totals.items():
            big = total > 191  # above, steps of a quarter of a power of two
            total[big] = np.minimum(192 + np.floor(4 * np.log2(total[big] / 192)), 255)
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([total.astype(np.uint8).tobytes()], pa.binary())], ["chunk", "counts"])

    parts = docs.mapInArrow(tidy(count), "chunk int, counts binary").repartition(CHUNKS, "chunk")
    rows = parts.mapInArrow(tidy(add), "chunk int, counts binary").collect()
    return np.concatenate([np.frombuffer(r.counts, np.uint8) for r in sorted(rows)]) if rows else np.zeros(size, np.uint8)


def estimate(code: np.ndarray) -> np.ndarray:
    return np.where(code < 192, code, 192 * 2.0 ** ((code.astype(float) - 191) / 4))


def signatures(docs: DataFrame, n: int, num: int, den: int, counts) -> DataFrame:
    """Per document: set size, two keys of the whole set, the rare-first prefix, into how many salts its last (most frequent)
    n-grams are dealt, set counts by hash range."""

    def lists(values: list, kind) -> pa.Array:
        ends = np.concatenate([[0], np.cumsum([len(x) for x in values])]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*values, np.zeros(0, kind)]).astype(kind)))

    def each(rows, data, offsets):
        grams, of = shingles(Words(data, offsets, lower=True), n)
        seen, k1, k2, tops, salts, ranges = [], [], [], [], [], []
        freq = counts.value
        for a, b in zip(of[:-1], of[1:]):
            own = np.unique(grams[a:b])
            size = len(own)
            seen.append(size)
            k1.append(int(mix(own).sum()) if size else 0)
            k2.append(int(mix(own ^ U(0xA5A5A5A5A5A5A5A5)).sum()) if size else 0)
            keep = size - -(-num * size // den) + 1 if size else 0
            often = freq[(own & U(len(freq) - 1)).astype(np.int64)]
            order = np.lexsort((own, often))[:keep]
            tops.append(signed(own[order]))
            many = estimate(often[order])
            salts.append(np.ceil(many[many > SPLIT] / SPLIT))
            ranges.append(np.minimum(np.bincount((own >> U(58)).astype(np.int64), minlength=RANGES), 127))  # capped counts differ by less
        return [rows.column("id"), np.array(seen, np.int64), signed(np.array(k1, U)), signed(np.array(k2, U)), lists(tops, np.int64), lists(salts, np.int32), lists(ranges, np.int8)]

    return map_slices(docs, "text", each, "id long, n long, k1 long, k2 long, top array<long>, salts array<int>, ranges array<tinyint>")


def components(edges: DataFrame) -> DataFrame:
    """(id, low): the smallest id that each id of ``edges`` (a, b) reaches. Alternating large-star and small-star steps:
    per-node minima by aggregation, then a join, so that a node with very many edges is never gathered."""
    edges = saved(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*").filter("a <> b").distinct()
        edges = saved(small)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("a").alias("id"), F.col("b").alias("low"))
        before = now


def verify(pairs: DataFrame, docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """``pairs`` (a < b, saved) with whether the whole sets link. A pair's less often paired text is sent to the other, which
    is dealt over salts, so a text in very many pairs makes no large group. Only texts that are in a pair are moved."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").count().filter("count > 1")
    often = small(saved(ends))
    degree = pairs.join(often.toDF("a", "deg_a"), "a", "left").join(often.toDF("b", "deg_b"), "b", "left").fillna(1, ["deg_a", "deg_b"])
    turn = F.col("deg_b") > F.col("deg_a")
    sent = degree.select(F.when(turn, F.col("b")).otherwise(F.col("a")).alias("p"), F.when(turn, F.col("a")).otherwise(F.col("b")).alias("q"), F.ceil(F.greatest("deg_a", "deg_b") / 500).cast("int").alias("of"))
    sent = small(saved(sent.withColumn("salt", F.pmod(F.xxhash64("q"), F.col("of")))))
    x = docs.join(sent.select(F.col("p").alias("id"), "salt").distinct(), "id").select(F.col("id").alias("p"), "salt", F.col("text").alias("x"))
    y = docs.join(sent.withColumnRenamed("q", "id"), "id").select("p", "salt", F.col("id").alias("q"), F.col("text").alias("y"))

    def run(batches):
        for batch in batches:
            for rows, data, offsets in slices(batch, "x"):
                x, x_of = shingles(Words(data, offsets, lower=True), n)
                y, y_of = shingles(Words(*text_bytes(rows.column("y")), lower=True), n)
                ok = []
                for k in range(len(rows)):
                    p, q = np.unique(x[x_of[k] : x_of[k + 1]]), np.unique(y[y_of[k] : y_of[k + 1]])
                    both = len(np.intersect1d(p, q, assume_unique=True))
                    ok.append(den * both >= num * (len(p) + len(q) - both))
                p, q = (rows.column(c).to_numpy() for c in ("p", "q"))
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(p, q)), pa.array(np.maximum(p, q)), pa.array(ok, pa.bool_())], ["a", "b", "linked"])

    return y.join(x.hint("merge"), ["p", "salt"]).select("p", "q", "x", "y").mapInArrow(tidy(run), "a long, b long, linked boolean").distinct()


def own_grams(docs: DataFrame, ids: DataFrame, n: int) -> DataFrame:
    """(id, own): how many n-grams of the set of each of ``ids`` stand in no other of their sets. Ids with none, and those of
    several rows, are left out: nothing is known to be their own."""
    texts = docs.join(ids, "id", "left_semi")

    def each(rows, data, offsets):
        grams, of = shingles(Words(data, offsets, lower=True), n)
        sets = [np.unique(grams[a:b]) for a, b in zip(of[:-1], of[1:])]
        ids = np.repeat(rows.column("id").to_numpy(), [len(x) for x in sets])
        found, first, times = np.unique(np.concatenate([*sets, np.zeros(0, U)]), return_index=True, return_counts=True)
        return [signed(found), ids[first], times]

    grams = map_slices(texts, "text", each, "gram long, id long, times long")
    alone = grams.groupBy("gram").agg(F.sum("times").alias("times"), F.min("id").alias("id")).filter("times = 1")
    once = texts.groupBy("id").count().filter("count = 1").select("id")
    return saved(alone.groupBy("id").agg(F.count("*").cast("int").alias("own")).join(once, "id"))


def able(rows: DataFrame, others: DataFrame, num: int, den: int) -> DataFrame:
    """The ``rows`` (tok, n, own) that may link with a set of one of the sizes that their bucket has in ``others``."""
    n = F.col("n")
    fits = lambda s: (F.least(n, s) * den >= F.greatest(n, s) * num) & ((n - F.col("own")) * (num + den) >= (n + s) * num)
    sizes = others.groupBy("tok").agg(F.collect_set("n").alias("sizes"))
    return rows.join(sizes, "tok").filter(F.exists("sizes", fits)).drop("sizes")


def verify_blocks(left: DataFrame, right: DataFrame, reps: DataFrame, docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """Links between ``left`` and ``right`` (tok, id, comp, m_left, m, chunk: a number of sets) of buckets with very many
    pairs, as many as hold the linked sets of a block together. Both sides are cut into chunks; every two chunks of a bucket
    meet in one group of bounded size, which filters by length and by hash ranges and compares at once what is left. Two texts
    are compared in the smallest of the buckets that they share (not always the one with their first common n-gram, which is
    the only one that the positional filter holds for)."""
    lefts, rights = (F.ceil(F.col(c) / F.col("chunk")) for c in ("m_left", "m"))
    here = F.pmod(F.xxhash64("id"), F.col("mine"))
    sides = [side.withColumn("mine", mine).select("tok", "id", "comp", F.lit(k).alias("side"), here.cast("int").alias("here"), other.cast("int").alias("others")) for k, (side, mine, other) in enumerate(((left, lefts, rights), (right, rights, lefts)))]
    toks = saved(right.groupBy("id").agg(F.collect_set("tok").alias("toks")))  # at most a prefix
    texts = docs.join(small(toks.select("id")), "id", "left_semi")
    whole = toks.join(reps.select("id", "ranges"), "id").join(texts, "id")
    rows = sides[0].unionByName(sides[1]).join(whole, "id").withColumn("there", F.explode(F.sequence(F.lit(0), F.col("others") - 1)))
    rows = rows.withColumns({"i": F.when(F.col("side") == 0, F.col("here")).otherwise(F.col("there")), "j": F.when(F.col("side") == 0, F.col("there")).otherwise(F.col("here"))}).drop("here", "there", "others")

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        ids, comp, side = (table.column(c).to_numpy() for c in ("id", "comp", "side"))
        tok = table.column("tok")[0].as_py()
        lower = [{t for t in x if t < tok} for x in table.column("toks").to_pylist()]
        ranges = np.array(table.column("ranges").to_pylist(), np.int16)
        grams, of = shingles(Words(*text_bytes(table.column("text").combine_chunks()), lower=True), n)
        own = [np.unique(grams[a:b]) for a, b in zip(of[:-1], of[1:])]
        size = np.array([len(x) for x in own])
        p, q = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        sp, sq = size[p][:, None], size[q][None, :]
        maybe = (comp[p][:, None] != comp[q][None, :]) & (np.minimum(sp, sq) * den >= np.maximum(sp, sq) * num)
        apart = sum(np.abs(ranges[p, r][:, None] - ranges[q, r][None, :]).astype(np.int32) for r in range(RANGES))
        maybe &= apart * (num + den) <= (sp + sq) * (den - num)
        for i in np.flatnonzero(maybe.any(axis=1)):
            for j in np.flatnonzero(maybe[i]):
                maybe[i, j] = not (lower[p[i]] & lower[q[j]])
        some = [m[maybe.any(axis=1 - k)] for k, m in enumerate((p, q))]
        maybe = maybe[maybe.any(axis=1)][:, maybe.any(axis=0)]
        if not maybe.size:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.bool_())], ["a", "b", "linked"])
        names, at = np.unique(np.concatenate([own[k] for m in some for k in m]), return_inverse=True)
        doc = np.repeat(np.arange(len(some[0]) + len(some[1])), [size[k] for m in some for k in m])
        both = np.zeros(maybe.shape, np.float32)
        for k in range(0, len(names), 4096):
            part = (at >= k) & (at < k + 4096)
            dense = np.zeros((len(some[0]) + len(some[1]), min(4096, len(names) - k)), np.float32)
            dense[doc[part], at[part] - k] = 1
            both += dense[: len(some[0])] @ dense[len(some[0]) :].T
        linked = maybe & (den * both >= num * (size[some[0]][:, None] + size[some[1]][None, :] - both))
        top, found = {}, set()
        for i, j in zip(*np.nonzero(linked)):  # a forest of links
            ends = [int(ids[some[0][i]]), int(ids[some[1][j]])]
            roots = []
            for x in ends:
                while (up := top.get(x, x)) != x:
                    x = up
                roots.append(x)
            if roots[0] != roots[1]:
                top[max(roots)] = min(roots)
                found.add((min(ends), max(ends)))
        a, b = [x for x, _ in found], [x for _, x in found]
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array([True] * len(a), pa.bool_())], ["a", "b", "linked"])

    return rows.groupBy("tok", "i", "j").applyInArrow(run, "a long, b long, linked boolean").distinct()


def alike(num: int, den: int):
    """Length and positional filter of two postings (n, pos) and (n2, pos2)."""
    n, n2, pos, pos2 = (F.col(c) for c in ("n", "n2", "pos", "pos2"))
    return (F.least(n, n2) * den >= F.greatest(n, n2) * num) & (F.least(n - pos, n2 - pos2) * (num + den) >= (n + n2) * num)


def postings(reps: DataFrame, num: int, den: int) -> DataFrame:
    """(tok, id, n, pos, two, pivot): a row for each prefix n-gram of each set, where the n-gram stands in other sets of a like
    size. The sets of an n-gram, in order of size, are cut wherever the next one is too large to link; no link crosses a cut,
    so each run is a bucket of its own (``tok`` names n-gram and run) and runs of one set are dropped. Very frequent n-grams
    are dealt over salts; they are not cut, and their bucket is all their salts. ``pivot``: the bucket's (or salt's) set with
    the smallest hash, if that passes the filters; ``two``: the bucket has no other sets than these. One exchange in all."""
    rows = reps.select("id", F.col("n").cast("int"), "salts", F.size("top").alias("size"), F.posexplode("top").alias("pos", "gram"))
    of = F.coalesce(F.get("salts", F.col("pos") - F.col("size") + F.size("salts")), F.lit(1))
    rows = rows.select("id", "n", "pos", "gram", F.when(of > 1, F.pmod(F.xxhash64("id"), of)).otherwise(-1).cast("int").alias("salt")).repartition("gram", "salt")
    rows = rows.withColumn("df", F.count("*").over(Window.partitionBy("gram", "salt"))).filter("df > 1 OR salt >= 0")
    by_size = Window.partitionBy("gram", "salt").orderBy("n")
    cut = F.coalesce(((F.lag("n").over(by_size) * den < F.col("n") * num) & (F.col("salt") < 0)).cast("int"), F.lit(0))
    runs = rows.withColumn("cut", cut).withColumn("run", F.sum("cut").over(by_size))
    bucket = Window.partitionBy("gram", "salt", "run")
    many = runs.withColumns({"df": F.count("*").over(bucket), "first": F.min(F.struct(F.xxhash64("id").alias("h"), F.col("id").alias("id2"), F.col("n").alias("n2"), F.col("pos").alias("pos2"))).over(bucket)})
    many = many.filter("df > 1 OR salt >= 0").select(F.xxhash64("gram", "run").alias("tok"), "id", "n", "pos", (F.col("df") == 2) & (F.col("salt") < 0), "first.id2", "first.n2", "first.pos2")
    return many.toDF("tok", "id", "n", "pos", "two", "id2", "n2", "pos2").select("tok", "id", "n", "pos", "two", F.when((F.col("id") != F.col("id2")) & alike(num, den), F.col("id2")).alias("pivot"))


def jaccard_components(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text", pivots: int = 4) -> DataFrame:
    """(id, n_shingles, component_id) for every row of ``docs``; component_id is the smallest id reachable by links."""
    spark = docs.sparkSession
    docs = docs.select(F.coalesce(F.col(id_col), F.lit(NULL_ID)).cast("long").alias("id"), F.col(text_col).alias("text"))
    counts = spark.sparkContext.broadcast(sketch(docs, n))
    sigs = saved(signatures(docs, n, num, den, counts))
    key = ["n", "k1", "k2"]
    some = (F.col("n") > 0) & (F.col("id") != NULL_ID)
    classes = small(saved(sigs.filter(some).groupBy(*key).agg(F.min("id").alias("rep"), F.count("*").alias("copies")).filter("copies > 1").drop("copies")))
    keyed = sigs.filter(some).join(classes, key, "left").withColumn("rep", F.coalesce("rep", "id"))
    reps = keyed.filter("id = rep").select("id", *key, "top", "salts", "ranges")
    posted = saved(postings(reps, num, den))  # a row that repeats id and text posts the same again, which adds no pair

    sizes = [reps.select(F.col("id").alias(i), F.col("n").alias(f"n_{i}"), F.col("ranges").alias(f"ranges_{i}")) for i in ("a", "b")]
    apart = F.aggregate(F.zip_with("ranges_a", "ranges_b", lambda x, y: F.abs(x.cast("int") - y)), F.lit(0), lambda s, x: s + x)
    suffix = apart * (num + den) <= (F.col("n_a") + F.col("n_b")) * (den - num)
    done = spark.range(0).select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(True).alias("linked"))
    pair = [F.least("id", "id2").alias("a"), F.greatest("id", "id2").alias("b")]

    def checked(pairs, done):
        pairs = saved(pairs.select(*pair).distinct().join(done, ["a", "b"], "left_anti"))
        ends = small(saved(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()))
        sides = [side.join(ends.withColumnRenamed("id", i), i, "left_semi") for side, i in zip(sizes, ("a", "b"))]
        pairs = saved(pairs.join(sides[0], "a").join(sides[1], "b").filter(suffix).select("a", "b").distinct())
        return done.limit(0) if pairs.isEmpty() else verify(pairs, docs, n, num, den)

    def grown(comp, links):
        """Components after more links (saved): those of before serve as links to their smallest ids."""
        links = links.filter("linked").select("a", "b")
        return comp if links.isEmpty() else components(comp.toDF("a", "b").unionByName(links))

    def mixed(comp):
        """Postings with their components, in buckets that hold several of them (those of two sets have been compared); and
        (tok, comp, members, h: their smallest hash) of these buckets."""
        rows = posted.filter("NOT two").join(comp, "id", "left").select("tok", "id", "n", "pos", F.coalesce("low", "id").alias("comp"))
        per = saved(rows.groupBy("tok", "comp").agg(F.count("*").alias("members"), F.min(F.xxhash64("id")).alias("h")))
        main = F.max(F.struct("members", "comp")).alias("main")
        toks = per.groupBy("tok").agg(F.count("*").alias("comps"), F.sum("members").alias("m"), main).filter("comps > 1")
        toks = small(saved(toks.select("tok", "m", F.col("main.comp").alias("main"), (F.col("m") - F.col("main.members")).alias("m_left"))))
        return saved(rows.join(toks, "tok")), per.join(toks, "tok", "left_semi")

    done = saved(checked(posted.filter("pivot IS NOT NULL").select("id", F.col("pivot").alias("id2")), done))
    comp = components(done.filter("linked"))
    rows, per = mixed(small(comp))
    crowd = F.col("m_left") * F.col("m") > PAIRS
    other = [F.col(c).alias(f"{c}2") for c in ("id", "n", "pos", "comp", "own")]
    shared = F.least(F.col("n") - F.col("own"), F.col("n2") - F.col("own2")) * (num + den) >= (F.col("n") + F.col("n2")) * num
    apt = (F.col("comp") != F.col("comp2")) & alike(num, den) & shared
    crowds = small(saved(rows.filter(crowd).select("id").distinct()))
    crowded = not crowds.isEmpty()
    own = small(own_grams(docs, crowds, n)) if crowded else None
    known = lambda rows: saved(rows.join(own, "id", "left").fillna(0, ["own"])) if crowded else rows.withColumn("own", F.lit(0))
    rows = known(rows)
    largest = Window.partitionBy("tok").orderBy(F.desc("members"), "comp")
    few = small(saved(per.withColumn("rank", F.row_number().over(largest)).filter(F.col("rank") <= pivots).select("tok", "comp", "h")))
    few = rows.join(few.withColumnRenamed("comp", "comp2"), "tok").filter("xxhash64(id) = h AND comp = comp2").filter(~crowd).select("tok", *other)
    if crowded:
        fewest = Window.partitionBy("tok").orderBy("own", F.xxhash64("id"), "id")
        few = few.unionByName(rows.filter(crowd).withColumn("rank", F.row_number().over(fewest)).filter(F.col("rank") <= pivots).select("tok", *other))
    found = saved(checked(rows.join(small(saved(few)), "tok").filter(apt), done))
    done = done.unionByName(found)
    before, comp = comp, grown(comp, found)
    if comp is not before:
        rows = known(mixed(small(comp))[0])
    right = rows.filter(~crowd).select("tok", *other)
    once = (F.col("comp2") == F.col("main")) | (F.col("id") < F.col("id2"))
    found = checked(rows.filter(~crowd & (F.col("comp") != F.col("main"))).join(right, "tok").filter(apt & once), done)
    if crowded:
        dense = rows.filter(crowd).drop("m", "m_left")
        left = saved(able(dense.filter("comp <> main"), dense, num, den))
        right = saved(able(dense, left, num, den))
        lefts, rights = (side.groupBy("tok").agg(F.count("*").alias(m), F.max("n").alias(f"widest_{m}")) for side, m in ((left, "m_left"), (right, "m")))
        chunk = F.greatest(F.lit(16), F.least(F.lit(500), F.floor(400_000 / F.greatest("widest_m_left", "widest_m")))).alias("chunk")
        counts = small(saved(lefts.join(rights, "tok").select("tok", "m_left", "m", chunk)))
        left, right = (saved(side.join(counts, "tok")) for side in (left, right))
        found = found.unionByName(verify_blocks(left, right, reps, docs, n, num, den))
    comp = small(grown(comp, saved(found)).withColumnRenamed("id", "rep"))
    linked = keyed.select("id", "n", "rep").join(comp, "rep", "left").select("id", "n", F.coalesce("low", "rep").alias("low"))
    out = linked.unionByName(sigs.filter(~some).select("id", "n", F.col("id").alias("low")))
    real = lambda c: F.when(F.col(c) != NULL_ID, F.col(c))
    return out.select(real("id").alias(id_col), F.col("n").alias("n_shingles"), real("low").alias("component_id"))
