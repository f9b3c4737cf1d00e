"""Nearest neighbours by vantage-point trees, one for each shard of the rows.

A small tree over a sample of rows (bounded, the same whatever the partitioning) deals all rows to shards: at every node the
rows within the median distance of the vantage point go left, the others right. Shards of many rows are cut further by a hash.
A query's distance to its k-th nearest sample row bounds its search, so it visits only the shards whose side of every vantage
point can hold something nearer. A shard's rows form a vantage-point tree, in which a batch of queries first goes down to the
leaf of each query, then through all nodes that the triangle inequality leaves open.

``factor`` relaxes the pruning: a node is left out if its gap to the query exceeds the bound divided by ``factor``. With 1 the
search is exact; larger factors visit less and may miss neighbours.

Defined results: vectors that are null, empty, zero or hold a null or a number that is not finite take no part, nor do rows
without an id. Only vectors of one length are compared. Rows that repeat an id are candidates each, never for a query of their
own id; of queries that repeat an id the smallest vector asks. Ties go to the smaller id. A table without rows gives none.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graincloak.llm.meeting import LEAST, by_length, finite, matrix, meet, shards
from graincloak.llm.textcols import saved

SAMPLE = 2048
LEAF = 128
PAIRS = 1_000_000
NEAR = 1e-9  # of the squared lengths: what rounding may change


def apart(x: np.ndarray, point: np.ndarray) -> np.ndarray:
    return np.sqrt(((x - point) ** 2).sum(axis=-1))


def squares(q: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances of all queries to all rows, by one product of matrices, and by how much rounding may change them."""
    qq, xx = (q**2).sum(axis=1)[:, None], (x**2).sum(axis=1)[None]
    return np.maximum(qq + xx - 2 * (q @ x.T), 0), NEAR * (qq + xx)


def exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Distances of pairs, added up from the first place to the last."""
    total = np.zeros(len(q))
    for j in range(q.shape[1]):
        total += (q[:, j] - x[:, j]) ** 2
    return np.sqrt(total)


class Router:
    """The upper levels: a heap of vantage points and median distances."""

    def __init__(self, x: np.ndarray, depth: int):
        self.depth, self.dim = depth, x.shape[1]
        self.point, self.cut = np.zeros((1 << depth, self.dim)), np.zeros(1 << depth)
        held = {1: np.arange(len(x))}
        for node in range(1, 1 << depth):
            rows = held[node]
            if len(rows):
                self.point[node] = x[rows[0]]
                d = apart(x[rows], self.point[node])
                self.cut[node] = np.median(d)
                held[2 * node], held[2 * node + 1] = rows[d <= self.cut[node]], rows[d > self.cut[node]]
            else:
                held[2 * node] = held[2 * node + 1] = rows

    def shard(self, x: np.ndarray) -> np.ndarray:
        node = np.ones(len(x), np.int64)
        for _ in range(self.depth):
            node = 2 * node + (apart(x, self.point[node]) > self.cut[node])
        return node

    def open(self, q: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, shard) for every shard that may hold rows within the bound."""
        at, node = np.arange(len(q)), np.ones(len(q), np.int64)
        for _ in range(self.depth):
            d, limit = apart(q[at], self.point[node]), bound[at]
            slack = NEAR * (1 + d)
            left, right = d - self.cut[node] <= limit + slack, self.cut[node] - d <= limit + slack
            at, node = np.concatenate([at[left], at[right]]), np.concatenate([2 * node[left], 2 * node[right] + 1])
        return at, node


class Tree:
    """A vantage-point tree over distinct vectors, each with its smallest ids (one more than are asked for)."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, most: int):
        order = np.lexsort((ids, *x.T[::-1]))
        ids, x = ids[order], x[order]
        new = np.append(True, (x[1:] != x[:-1]).any(axis=1))
        start = np.flatnonzero(new)
        self.x, self.all = x[start], np.sort(ids)
        rank = np.arange(len(ids)) - np.repeat(start, np.diff(np.append(start, len(ids))))
        few = rank < most
        self.ids, self.of = ids[few], np.append(0, np.cumsum(np.bincount(np.cumsum(new)[few] - 1, minlength=len(start))))
        self.place = np.arange(len(start))
        self.nodes, todo = [], [(0, len(start), -1, 0)]
        while todo:
            a, b, parent, side = todo.pop()
            if parent >= 0:
                self.nodes[parent][3 + side] = len(self.nodes)
            rows = self.place[a:b]
            d = apart(self.x[rows], self.x[rows[0]])
            if b - a <= LEAF or d.max() == 0:
                self.nodes.append([a, b, None, -1, -1, None])
                continue
            order = np.argsort(d, kind="stable")
            self.place[a:b], d, half = rows[order], d[order], (b - a) // 2
            self.nodes.append([a, b, self.x[rows[0]], -1, -1, (d[0], d[half - 1], d[half], d[-1])])
            todo += [(a, a + half, len(self.nodes) - 1, 0), (a + half, b, len(self.nodes) - 1, 1)]

    def search(self, qid: np.ndarray, q: np.ndarray, bound: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, id, distance) of each query's k nearest within ``bound``."""
        own = np.searchsorted(self.all, qid, "right") - np.searchsorted(self.all, qid)  # rows of the query's id don't count
        best = np.full((len(q), k + int(own.max(initial=0))), np.inf)
        limit, state = bound**2, [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        pending, seen = [], np.full(len(q), -1)

        def settle():
            nonlocal pending, state
            at, row = (np.concatenate([p[i] for p in pending]) if pending else np.zeros(0, np.int64) for i in (0, 1))
            pending = []
            d = exact(q[at], self.x[row])
            many = np.diff(self.of)[row]
            spread = np.repeat(self.of[row], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            at, ids, d = np.repeat(at, many), self.ids[spread], np.repeat(d, many)
            at, ids, d = (np.concatenate([old, new[ids != qid[at]]]) for old, new in zip(state, (at, ids, d)))
            order = np.lexsort((ids, d, at))
            at, ids, d = at[order], ids[order], d[order]
            first = np.arange(len(at)) - np.searchsorted(at, at) < k
            state = [at[first], ids[first], d[first]]

        def leaf(active, a, b):
            rows = self.place[a:b]
            d2, slack = squares(q[active], self.x[rows])
            both = np.concatenate([best[active], d2 + slack], axis=1)
            width = best.shape[1]
            best[active] = np.sort(np.partition(both, width - 1, axis=1)[:, :width], axis=1)
            limit[active] = np.minimum(limit[active], best[active, k - 1 + own[active]])
            near = np.nonzero(d2 - slack <= limit[active][:, None])
            pending.append((active[near[0]], rows[near[1]]))
            if sum(len(p[0]) for p in pending) > PAIRS:
                settle()

        todo = [(0, np.arange(len(q)))]
        while todo:  # each query's own leaf first
            n, active = todo.pop()
            a, b, point, left, right, reach = self.nodes[n]
            if point is None:
                leaf(active, a, b)
                seen[active] = n
                continue
            near = apart(q[active], point) <= (reach[1] + reach[2]) / 2
            todo += [(child, some) for child, some in ((left, active[near]), (right, active[~near])) if len(some)]
        todo = [(0, np.arange(len(q)))]
        while todo:
            n, active = todo.pop()
            a, b, point, left, right, reach = self.nodes[n]
            if point is None:
                active = active[seen[active] != n]
                if len(active):
                    leaf(active, a, b)
                continue
            d, allowed = apart(q[active], point), np.sqrt(limit[active]) / factor
            slack = NEAR * (1 + d)
            for child, lo, hi in ((left, *reach[:2]), (right, *reach[2:])):
                some = active[np.maximum(lo - d, d - hi) <= allowed + slack]
                if len(some):
                    todo.append((child, some))
        settle()
        return tuple(state)


def sample_bounds(ids: np.ndarray, x: np.ndarray, qid: np.ndarray, q: np.ndarray, k: int) -> np.ndarray:
    """Each query's distance to its k-th nearest sample row of another id, rounded up; infinite with fewer such rows."""
    if len(x) < k or x.shape[1] != q.shape[1]:
        return np.full(len(q), np.inf)
    d2, slack = squares(q, x)
    d2 = np.where(ids[None] == qid[:, None], np.inf, d2 + slack)
    return np.sqrt(np.partition(d2, k - 1, axis=1)[:, k - 1]) * (1 + NEAR)


def nearest_neighbours(rows: DataFrame, asks: Column, key: str = "vec_id", vector: str = "embedding", k: int = 10, factor: float = 1.0) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows nearest to each row of ``rows`` for which ``asks`` holds, without rows of
    its own id; Euclidean distances in double precision."""
    good = rows.filter(F.col(key).isNotNull() & finite(F.col(vector)) & F.exists(vector, lambda x: x != 0))
    table = good.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"), F.coalesce(asks, F.lit(False)).alias("is_query"))
    count = shards(table, "v")
    sample = table.select("id", "v").orderBy(F.xxhash64("id"), "id", "v").limit(SAMPLE).toArrow()  # bounded by SAMPLE
    usual = int(np.bincount(sample.column("v").combine_chunks().value_lengths().to_numpy(zero_copy_only=False)).argmax()) if len(sample) else 1
    of_size = [p for b in sample.combine_chunks().to_batches() for p in by_length(b, "v") if len(p.column("v")[0]) == usual]
    some_ids, some = (of_size[0].column("id").to_numpy(), matrix(of_size[0].column("v"))) if of_size else (np.zeros(0, np.int64), np.zeros((0, usual)))
    router = Router(some, max(0, count - 1).bit_length())

    def deal(batches):
        for batch in batches:
            for part in by_length(batch, "v"):
                size = len(part.column("v")[0])
                shard = router.shard(matrix(part.column("v"))) if size == usual else np.full(len(part), -size, np.int64)
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("v"), part.column("is_query"), pa.array(shard)], ["id", "v", "is_query", "home"])

    kind = table.schema["v"].dataType.simpleString()
    dealt = saved(table.mapInArrow(deal, f"id long, v {kind}, is_query boolean, home long"))
    n, leaves = dealt.count(), 1 << router.depth
    sizes = dealt.groupBy("home").count().withColumn("n_cuts", F.ceil(F.col("count") / max(LEAST, 2 * n // leaves)).cast("int"))
    cuts = F.broadcast(saved(sizes.filter("n_cuts > 1").select("home", "n_cuts")))  # fewer rows than the router has leaves
    many = F.coalesce("n_cuts", F.lit(1))

    def visits(batches):
        for batch in batches:
            for part in by_length(batch, "v"):
                q, qid = matrix(part.column("v")), part.column("id").to_numpy()
                if q.shape[1] == usual:
                    bound = sample_bounds(some_ids, some, qid, q, k)
                    at, home = router.open(q, bound / factor)
                else:
                    bound, at, home = np.full(len(q), np.inf), np.arange(len(q)), np.full(len(q), -q.shape[1], np.int64)
                for i in range(0, len(at), 4096):
                    one = at[i : i + 4096]
                    yield pa.RecordBatch.from_arrays([pa.array(qid[one]), part.column("v").take(pa.array(one)), pa.array(home[i : i + 4096]), pa.array(bound[one])], ["id", "v", "home", "bound"])

    queries = dealt.filter("is_query").groupBy("id").agg(F.min("v").alias("v"))
    queries = queries.mapInArrow(visits, f"id long, v {kind}, home long, bound double")
    queries = queries.join(cuts, "home", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), many - 1)))
    queries = queries.select(F.xxhash64("home", F.col("salt").cast("long")).alias("shard"), "id", "v", "bound")
    cut = F.xxhash64("home", F.pmod(F.xxhash64("id", "v"), many).cast("long"))
    held = dealt.join(cuts, "home", "left").select(cut.alias("shard"), "id", "v")
    index = lambda rows: Tree(rows.column("id").to_numpy(), matrix(rows.column("v")), k + 1)

    def answer(tree, part):
        qid = part.column("id").to_numpy()
        at, ids, d = tree.search(qid, matrix(part.column("v")), part.column("bound").to_numpy(), k, factor)
        return qid[at], ids, d

    found = meet(held, queries, leaves, index, answer, "query_id long, vec_id long, score double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
