"""Hard negatives: for each anchor and each of its positives, the best rows of other labels within a window below the positive.

An anchor's windows overlap, so none is searched alone. The upper limits of its positives, in descending order, cut the scores
into disjoint slots; every row of another label falls into one slot at most. A shard keeps the first k of each (anchor, slot),
the shuffle keeps the first k of those, and a window is answered by merging the slots from its own downwards: what stands
first among all scores up to a limit stands first within some slot up to it. Scores are inner products of whole numbers, exact.

Defined results: rows without an id, a label or a vector, or with a null or a number that is not finite, take no part; only
vectors of one length are compared. Rows that repeat an id are candidates each, never for an anchor of their id; of anchors
that repeat an id the smallest (label, vector) counts. Ties go to the smaller id. A score beyond 64 bits counts as the last
number that they hold. An anchor without positives, or a window without rows, gives no rows.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graincloak.llm.meeting import finite, matrix, meet, shards
from graincloak.llm.textcols import saved

CELLS = 4_000_000  # scores held at a time
TOP = 2**63 - 1


class Rows:
    """A shard's rows in order of their ids; labels as codes."""

    def __init__(self, rows: pa.RecordBatch, scale: float):
        ids = rows.column("id").to_numpy()
        order = np.argsort(ids, kind="stable")
        self.ids, self.x = ids[order], np.floor(matrix(rows.column("v"))[order] * scale)
        self.names, codes = np.unique(rows.column("label").to_numpy(zero_copy_only=False).astype(str), return_inverse=True)
        self.labels = codes[order]

    def codes(self, labels: np.ndarray) -> np.ndarray:
        """The anchors' labels as codes; -1 where no row has it."""
        at = np.minimum(np.searchsorted(self.names, labels), len(self.names) - 1)
        return np.where(self.names[at] == labels, at, -1)


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers, as longs."""
    if np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * q.shape[1] < 2**53:
        return (q @ x.T).astype(np.int64)
    whole = lambda m: np.array([[int(v) for v in r] for r in m], object).reshape(m.shape)
    return np.clip(whole(q) @ whole(x).T if q.shape[1] else np.zeros((len(q), len(x)), object), -TOP, TOP).astype(np.int64)


def first_of(group: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the first ``k`` of each group, by score (descending), then id."""
    order = np.lexsort((ids, -score, group))
    kept = group[order]
    return order[np.arange(len(kept)) - np.searchsorted(kept, kept) < k]


def best_of_label(rows: Rows, q: np.ndarray, qid: np.ndarray, labels: np.ndarray, k: int, cells: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, id, score): the first ``k`` rows of the anchor's label and of another id."""
    mine, out, step = rows.codes(labels), [], max(1, cells // max(len(q), 1))
    for a in range(0, len(rows.ids), step):
        b = min(a + step, len(rows.ids))
        score = products(q, rows.x[a:b])
        fits = (rows.labels[a:b][None] == mine[:, None]) & (rows.ids[a:b][None] != qid[:, None])
        if b - a > 4 * k:  # those below the k-th best need no sorting
            least = np.partition(np.where(fits, score, -TOP), b - a - k, axis=1)[:, b - a - k]
            fits &= score >= least[:, None]
        at, row = np.nonzero(fits)
        kept = first_of(at, score[at, row], rows.ids[a + row], k)
        out.append((at[kept], rows.ids[a + row[kept]], score[at[kept], row[kept]]))
    at, ids, score = (np.concatenate(c) for c in zip(*out))
    kept = first_of(at, score, ids, k)
    return at[kept], ids[kept], score[kept]


def best_of_slots(rows: Rows, q: np.ndarray, labels: np.ndarray, limits: list[np.ndarray], least: np.ndarray, k: int, cells: int) -> tuple[np.ndarray, ...]:
    """(anchor, slot, id, score): the first ``k`` rows of other labels in each slot. ``limits``: each anchor's upper limits in
    ascending order; a slot is what lies above the limit before it, and the lowest one reaches down to ``least``."""
    mine, out, step = rows.codes(labels), [], max(1, cells // max(len(q), 1))
    width = max(map(len, limits))
    tops = np.array([np.pad(x, (0, width - len(x)), constant_values=TOP) for x in limits])
    highest = np.array([x[-1] for x in limits])
    for a in range(0, len(rows.ids), step):
        b = min(a + step, len(rows.ids))
        score = products(q, rows.x[a:b])
        fits = (score <= highest[:, None]) & (score >= least[:, None]) & (rows.labels[a:b][None] != mine[:, None])
        at, row = np.nonzero(fits)
        score = score[at, row]
        slot = (tops[at] < score[:, None]).sum(axis=1)
        kept = first_of(at * width + slot, score, rows.ids[a + row], k)
        out.append((at[kept], slot[kept], rows.ids[a + row[kept]], score[kept]))
    at, slot, ids, score = (np.concatenate(c) for c in zip(*out))
    kept = first_of(at * width + slot, score, ids, k)
    return at[kept], slot[kept], ids[kept], score[kept]


def hard_negatives(rows: DataFrame, asks: Column, key: str = "vec_id", vector: str = "embedding", label: Column | str = "label", positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: float = 256.0) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows for which ``asks`` holds: of
    each of the first ``positives`` rows of the anchor's label, the first ``negatives`` rows of other labels that score from
    ``low`` to ``high`` percent of it. Vectors are multiplied by ``scale`` and rounded down."""
    label = F.col(label) if isinstance(label, str) else label
    good = rows.filter(F.col(key).isNotNull() & label.isNotNull() & finite(F.col(vector)))
    table = good.select(F.col(key).cast("long").alias("id"), label.cast("string").alias("label"), F.col(vector).alias("v"), F.coalesce(asks, F.lit(False)).alias("is_anchor"))
    parts, cells = shards(table, "v"), CELLS
    table = saved(table.withColumn("shard", F.pmod(F.xxhash64("id", "v"), F.lit(parts))))
    one = table.filter("is_anchor").groupBy("id").agg(F.min(F.struct("label", "v")).alias("one")).select("id", "one.label", "one.v")
    anchors = saved(one)
    held, every = table.select("shard", "id", "label", "v"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long")))
    index = lambda part: Rows(part, scale)
    asked = lambda part: (np.floor(matrix(part.column("v")) * scale), part.column("id").to_numpy(), part.column("label").to_numpy(zero_copy_only=False).astype(str))

    def nearest(mine, part):
        q, qid, labels = asked(part)
        at, ids, score = best_of_label(mine, q, qid, labels, positives, cells)
        return qid[at], ids, score

    found = meet(held, anchors.withColumn("shard", every), parts, index, nearest, "anchor_id long, positive_id long, positive_score long")
    place = F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id"))
    found = found.withColumn("place", place).filter(F.col("place") <= positives)
    score = F.col("positive_score").cast("decimal(20,0)")
    down = lambda x: ((x - F.pmod(x, F.lit(100).cast("decimal(38,0)"))) / 100).cast("decimal(38,0)")
    bounds = {"lo": -down((score * F.lit(-low)).cast("decimal(38,0)")), "hi": down((score * F.lit(high)).cast("decimal(38,0)"))}
    most = F.lit(TOP).cast("decimal(38,0)")
    pairs = saved(found.select("anchor_id", "positive_id", "positive_score", "place", *(F.greatest(F.least(x, most), -most).cast("long").alias(c) for c, x in bounds.items())))
    windows = pairs.filter("lo <= hi").groupBy("anchor_id").agg(F.array_sort(F.collect_set("hi")).alias("limits"), F.min("lo").alias("least"))
    open_anchors = anchors.join(windows, anchors["id"] == windows["anchor_id"]).drop("anchor_id").withColumn("shard", every)

    def slotted(mine, part):
        q, qid, labels = asked(part)
        limits = [np.array(x) for x in part.column("limits").to_pylist()]
        at, slot, ids, score = best_of_slots(mine, q, labels, limits, part.column("least").to_numpy(), negatives, cells)
        return qid[at], slot, ids, score

    kept = meet(held, open_anchors, parts, index, slotted, "anchor_id long, slot long, negative_id long, negative_score long")
    place = F.row_number().over(Window.partitionBy("anchor_id", "slot").orderBy(F.desc("negative_score"), "negative_id"))
    kept = kept.withColumn("place", place).filter(F.col("place") <= negatives)
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("negative_score")).alias("below"), F.col("negative_id").alias("id"))))
    merged = kept.groupBy("anchor_id").agg(ranked.alias("ranked"))  # at most negatives for each of at most positives slots
    below = F.slice(F.filter("ranked", lambda x: -x["below"] <= F.col("hi")), 1, negatives)
    inside = F.filter(below, lambda x: -x["below"] >= F.col("lo"))
    out = pairs.join(merged, "anchor_id").select("anchor_id", "positive_id", "positive_score", F.posexplode(inside).alias("at", "x"))
    return out.select("anchor_id", "positive_id", (F.col("at") + 1).alias("rank"), F.col("x.id").alias("negative_id"), "positive_score", (-F.col("x.below")).alias("negative_score"))
