"""Mondrian partitioning, level by level.

While some node has more than ``local_rows`` rows, a level is a few passes over the rows: an aggregation that gives every node
its size, variances and ends, counts by bins of the chosen dimension (of the key, where one number fills the middle) that
narrow a bracket around the middle, and one that finds the exact cut among the few rows inside it. No task sorts a whole
node, tied or not. The driver holds a few numbers for each node of more than ``local_rows`` rows, no others. The rows are
written every third level. As soon as every open node is small, one shuffle by node brings each to one task, where numpy finishes the
recursion by the same rules; ``local_rows`` does not change the result. A large node that median or total may not split (a
side empty or under ``k``, as tied values leave it) is closed.

Rows with a null, NaN or infinite dimension take no part and get a null group, in nodes of any size. Null or repeated keys
raise ValueError, so every rank cut halves its node.

Rules:
* rank: split ``m > 2k`` rows in two halves by (value, key) on the dimension of the largest variance; all rows get a group.
* median: accept ``k <= m <= 2k`` with ``e`` sensitive values; split ``m > 2k`` at the median (ties left) unless the largest
  variance is at most ``least_variance`` or a side has fewer than ``k`` rows; what is neither is remainder (null group).
* total: as median, but on the sum of sample variances; below ``least_variance`` the dimension is picked by a hash; sides
  may be small; small leaves are kept or dropped by ``small``.
"""

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


DEPTH = 20
SMALL = 100_000  # rows of a table of nodes that is broadcast
FEW = 100_000  # rows of a bracket among which the exact cut is found
BINS = 2**15  # of all nodes together, as far as each has 32 to 4,096
NODE = ["root", "node"]


def widest(variances: np.ndarray) -> int:
    return int(np.argmax(np.round(variances, 9)))


def rank_leaves(x: np.ndarray, keys: np.ndarray, node: int, k: int) -> dict[int, np.ndarray]:
    out, todo = {}, [(node, np.arange(len(x)))]
    while todo:
        name, rows = todo.pop()
        if len(rows) <= 2 * k:
            out[name] = rows
            continue
        dim = widest(x[rows].var(axis=0))
        rows = rows[np.lexsort((keys[rows], x[rows, dim]))]
        half = (len(rows) + 1) // 2
        todo += [(2 * name, rows[:half]), (2 * name + 1, rows[half:])]
    return out


def median_leaves(x: np.ndarray, sa: np.ndarray, node: int, k: int, e: int, least_variance: float) -> dict[int, np.ndarray]:
    out, todo = {}, [(node, np.arange(len(x)))]
    while todo:
        name, rows = todo.pop()
        m = len(rows)
        if k <= m <= 2 * k and len(set(sa[rows])) >= e:
            out[name] = rows
        elif m > 2 * k:
            var = x[rows].var(axis=0)
            dim = widest(var)
            left = x[rows, dim] <= np.median(x[rows, dim])
            if var[dim] > least_variance and min(left.sum(), m - left.sum()) >= k:
                todo += [(2 * name, rows[left]), (2 * name + 1, rows[~left])]
    return out


def total_leaves(x: np.ndarray, sa: np.ndarray, node: int, k: int, e: int, least_variance: float, small: str, seed: int, depth: int = DEPTH) -> dict[int, np.ndarray]:
    out, todo = {}, [(node, np.arange(len(x)))]
    while todo:
        name, rows = todo.pop()
        m = len(rows)
        if m <= 2 * k or name.bit_length() > depth:
            if m and (m >= k or small == "keep"):
                out[name] = rows
            continue
        var = x[rows].var(axis=0, ddof=1)
        dim = widest(var) if var.sum() > least_variance else (name * 2654435761 + seed) % x.shape[1]
        left = x[rows, dim] <= np.median(x[rows, dim])
        if left.all():
            out[name] = rows
        else:
            todo += [(2 * name, rows[left]), (2 * name + 1, rows[~left])]
    return out


def kept(df: DataFrame) -> DataFrame:
    if not df.sparkSession.sparkContext.getCheckpointDir() and df.sparkSession.conf.get("spark.checkpoint.dir", "") == "":
        return df.persist()  # a session without a checkpoint folder
    return df.checkpoint()


def sized(table: DataFrame, n: int | None = None) -> DataFrame:
    """``table`` (of ``n`` rows, or written before), to be broadcast if it is small."""
    return F.broadcast(table) if (table.count() if n is None else n) <= SMALL else table


def by_runs(rows: DataFrame, by: list[str], rule: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``rule`` on the rows of each value of ``by``, in order of ``key``. One Python call goes through all the runs of a
    partition and holds no more than a batch and a run."""

    def each(frames):
        held = None
        for pdf in frames:
            if len(pdf):
                pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
                new = np.zeros(len(pdf) - 1, bool)
                for c in by:
                    new |= pdf[c].to_numpy()[1:] != pdf[c].to_numpy()[:-1]
                ends = np.flatnonzero(new) + 1
                held = pdf.iloc[ends[-1] if len(ends) else 0 :]
                if len(ends):
                    yield pd.concat([rule(pdf.iloc[a:b]) for a, b in zip([0, *ends], ends)], ignore_index=True)
        if held is not None:
            yield rule(held)

    return rows.repartition(*by).sortWithinPartitions(*by, "key").mapInPandas(each, schema)


def decide(keep: DataFrame, xs: list[str], rule: str, limit: int, least_variance: float, seed: int) -> DataFrame:
    """Each open node of more than ``limit`` rows: its size ``m``, the dimension to cut, its lowest and highest number there
    (``lo``, ``hi``), and whether it is to be closed instead. One pass over the rows."""
    var = F.var_samp if rule == "total" else F.var_pop
    numbers = [f(x).alias(f"{n}{i}") for i, x in enumerate(xs) for n, f in (("v", var), ("lo", F.min), ("hi", F.max))]
    stats = keep.filter("NOT closed").groupBy(*NODE).agg(F.count("*").alias("m"), *numbers).filter(F.col("m") > limit)
    v = F.array(*(f"v{i}" for i in range(len(xs))))
    plain = F.transform(v, lambda x: F.round(x, 9))
    dim, shut = (F.array_position(plain, F.array_max(plain)) - 1).cast("int"), F.lit(False)
    if rule == "median":
        shut = ~(F.array_max(v) > least_variance)
    elif rule == "total":
        picked = F.pmod(F.col("node") * 2654435761 + seed, F.lit(len(xs))).cast("int")
        dim = F.when(F.aggregate(v, F.lit(0.0), lambda a, b: a + b) > least_variance, dim).otherwise(picked)
        shut = F.col("node") >= 2**DEPTH
    end = {n: F.element_at(F.array(*(f"{n}{i}" for i in range(len(xs)))), F.col("dim") + 1).alias(n) for n in ("lo", "hi")}
    return stats.withColumn("dim", dim).select(*NODE, "m", "dim", shut.alias("shut"), *end.values())


class Middle:
    """What the driver knows of a large node: ``count`` rows have a number in ``lo`` .. ``hi`` (and, with ``keys``, a key in
    these ends), ``before`` rows come before them; the row in place ``first`` and the one in place ``second`` are among them."""

    def __init__(self, r, by_key: bool):
        self.at, self.dim, self.m, self.lo, self.hi, self.before, self.count, self.keys = (r.root, r.node), r.dim, r.m, r.lo, r.hi, 0, r.m, None
        self.first, self.second, self.stays = (r.m + 1) // 2, (r.m + 1) // 2 if by_key else r.m // 2 + 1, False
        self.cut = self.cut_key = self.n_left = None
        self.turn = self.same = 0

    def asks(self, bins: int) -> tuple:
        """A row of the table that the next pass is told: bins are in turn equal shares of the range of numbers and of its
        logarithm (so that no distribution takes many passes), or equal in the leading bits of the key."""
        if self.keys:
            shift = max(0, (self.keys[1] - self.keys[0]).bit_length() - bins.bit_length() + 1)
            return *self.at, self.dim, self.lo, self.hi, 0.0, 0.0, *self.keys, shift, self.keys[0] >> shift
        width = max(self.hi / 2 - self.lo / 2, 1e-300)
        scale, fold = (1e300 / width, bins / 691) if self.turn % 2 else (bins / width, 0.0)
        return *self.at, self.dim, self.lo, self.hi, min(scale, 1e300), fold, None, None, 0, 0

    def narrow(self, parts: list) -> None:
        """Take over the bins in which both places are. If they are two, the middle lies between their ends."""
        if len(parts) == 2:
            a, b = sorted(parts, key=lambda p: p.bin)
            if (a.x_hi + b.x_lo) / 2 < b.x_lo:
                self.cut, self.n_left, self.count = (a.x_hi + b.x_lo) / 2, self.first, 0
                return
        was, self.turn = (self.lo, self.hi, self.keys), self.turn + 1
        self.before, self.count = min(p.before for p in parts), sum(p.n for p in parts)
        self.lo, self.hi = min(p.x_lo for p in parts), max(p.x_hi for p in parts)
        if self.keys:
            self.keys = (min(p.key_lo for p in parts), max(p.key_hi for p in parts))
        self.same = self.same + 1 if was == (self.lo, self.hi, self.keys) else 0
        self.stays = self.same > 1  # as close as bins can tell


def along(xs: list[str]):
    """The number in the dimension ``dim``."""
    return F.coalesce(*(F.when(F.col("dim") == i, F.col(x)) for i, x in enumerate(xs)))


def has(place: str, before, n):
    return (F.col(place) > before) & (F.col(place) <= before + n)


def exact_cuts(keep: DataFrame, xs: list[str], nodes: list, by_key: bool, ends: tuple | None) -> tuple[list[Middle], list[Middle]]:
    """The exact middle of each of ``nodes`` (rows of ``decide``): ``cut`` and ``n_left`` rows up to it. With ``by_key``, rows
    with equal numbers stand in order of their key and the cut is the last row (``cut``, ``cut_key``) of the first half; else
    it is the mean of the two middle numbers. ``ends``: the smallest and largest key, if keys are whole numbers. The second
    list has the nodes with so many equal numbers in the middle that their keys, of another type, must be sorted."""
    spark, kinds = keep.sparkSession, {f.name: f.dataType.simpleString() for f in keep.schema.fields}
    node, x = f"root {kinds['root']}, node long, dim int, lo double, hi double", along(xs)
    told = lambda rows, more: sized(spark.createDataFrame(rows, f"{node}, {more}"), len(rows))
    inside = lambda table: keep.filter("NOT closed").join(table, NODE).withColumn("x", x).filter("x >= lo AND x <= hi")
    places = "first long, second long, already long"
    every = [Middle(r, by_key) for r in nodes]
    while True:
        for c in every:
            if by_key and c.lo == c.hi and c.count > FEW and ends and not c.keys:
                c.keys, c.stays = ends, False
        wide = [c for c in every if c.count > FEW and not c.stays and (c.keys or c.lo < c.hi)]
        if not wide:
            break
        bins = 2 ** int(np.log2(np.clip(BINS // len(wide), 32, 4096)))
        table = told([(*c.asks(bins), c.first, c.second, c.before) for c in wide], f"scale double, fold double, key_from long, key_to long, shift int, base long, {places}")
        rows = inside(table)
        place = (F.col("x") / 2 - F.col("lo") / 2) * F.col("scale")
        bin = F.floor(F.when(F.col("fold") == 0, place).otherwise(F.log1p(place) * F.col("fold")))
        key_ends = [F.lit(None).cast("long").alias(n) for n in ("key_lo", "key_hi")]
        if ends:
            rows = rows.filter("key_from IS NULL OR (key >= key_from AND key <= key_to)")
            bin = F.when(F.col("key_from").isNull(), bin).otherwise(F.expr("shiftright(CAST(key AS BIGINT), shift)") - F.col("base"))
            key_ends = [F.min(F.col("key").cast("long")).alias("key_lo"), F.max(F.col("key").cast("long")).alias("key_hi")]
        counts = rows.groupBy(*NODE, bin.alias("bin"), "first", "second", "already").agg(F.count("*").alias("n"), F.min("x").alias("x_lo"), F.max("x").alias("x_hi"), *key_ends)
        counts = counts.withColumn("before", F.col("already") + F.sum("n").over(Window.partitionBy(*NODE).orderBy("bin")) - F.col("n"))
        found: dict[tuple, list] = {}
        for r in counts.filter(has("first", F.col("before"), F.col("n")) | has("second", F.col("before"), F.col("n"))).collect():  # at most two a node
            found.setdefault((r.root, r.node), []).append(r)
        for c in wide:
            c.narrow(found[c.at])
    tied = [c for c in every if by_key and c.count > FEW and not c.keys]
    todo = {c.at: c for c in every if c not in tied and c.cut is None}
    for c in list(todo.values()):
        if not by_key and c.lo == c.hi:
            c.cut, c.n_left = c.lo, c.before + c.count
            del todo[c.at]
    if todo:
        table = told([(*c.at, c.dim, c.lo, c.hi, *(c.keys or (None, None)), c.first, c.second, c.before) for c in todo.values()], f"key_from long, key_to long, {places}")
        rows = inside(table)
        if by_key:
            rows = rows.filter("key_from IS NULL OR (key >= key_from AND key <= key_to)") if ends else rows
            place = F.row_number().over(Window.partitionBy(*NODE).orderBy("x", "key"))
            for r in rows.select(*NODE, "x", "key", "first", "already").withColumn("place", place).filter("place + already = first").collect():  # one a node
                c = todo[r.root, r.node]
                c.cut, c.cut_key, c.n_left = r.x, r.key, c.first
        else:
            counts = rows.groupBy(*NODE, "x", "first", "second", "already").agg(F.count("*").alias("n"))
            counts = counts.withColumn("upto", F.col("already") + F.sum("n").over(Window.partitionBy(*NODE).orderBy("x")))
            before = F.col("upto") - F.col("n")
            for r in counts.filter(has("first", before, F.col("n")) | has("second", before, F.col("n"))).orderBy("x").collect():  # at most two a node
                c = todo[r.root, r.node]
                c.cut, c.n_left = (r.x, r.upto) if c.cut is None else ((c.cut + r.x) / 2, r.upto if (c.cut + r.x) / 2 >= r.x else c.n_left)
    return [c for c in every if c not in tied], tied


def tied_cuts(keep: DataFrame, xs: list[str], nodes: list[Middle]) -> None:
    """The cut of each of ``nodes``, in whose middle many rows have one number: their keys are sorted over range partitions."""
    kind = keep.schema["root"].dataType.simpleString()
    asked = sized(keep.sparkSession.createDataFrame([(*c.at, c.dim, c.lo, c.hi, c.before, c.first) for c in nodes], f"root {kind}, node long, dim int, lo double, hi double, already long, first long"), len(nodes))
    x = along(xs).alias("x")
    few = keep.filter("NOT closed").join(asked, NODE).select(*NODE, x, "key", "lo", "hi", "already", "first").filter("x >= lo AND x <= hi").drop("lo", "hi")
    dealt = kept(few.repartitionByRange(*NODE, "x", "key").withColumn("part", F.spark_partition_id()))
    parts = dealt.groupBy(*NODE, "part", "already", "first").agg(F.count("*").alias("size"))
    parts = parts.withColumn("before", F.col("already") + F.sum("size").over(Window.partitionBy(*NODE).orderBy("part")) - F.col("size"))
    parts = parts.filter(has("first", F.col("before"), F.col("size"))).select(*NODE, "part", "before")  # one a node
    place = F.col("before") + F.row_number().over(Window.partitionBy(*NODE, "part").orderBy("x", "key"))
    at = {c.at: c for c in nodes}
    for r in dealt.join(sized(parts, len(nodes)), [*NODE, "part"]).withColumn("place", place).filter("place = first").collect():  # one a node
        c = at[r.root, r.node]
        c.cut, c.cut_key, c.n_left = r.x, r.key, c.first


def mondrian(df: DataFrame, key: str, dims: list[str], k: int, rule: str = "rank", sensitive: str | None = None, e: int = 1, least_variance: float = 0.0, small: str = "keep", seed: int = 42, local_rows: int | None = None, start: str | None = None, refine: Callable | None = None) -> DataFrame:
    """(key, group_id) for every row: a leaf's number in the tree (children 2n and 2n + 1), null for remainder rows.

    With ``start``, the rows of each of its values have a tree of their own, all are cut at once, and it is a column of the
    result. With ``refine`` (numbers, sensitive values, rows of a leaf -> groups of rows), leaves become its groups, named by
    their smallest key; rows in none have a null group. ``local_rows`` is 1,500,000 numbers, 250,000 rows at most, if not
    given."""
    local_rows = local_rows or min(250_000, 1_500_000 // max(len(dims), 1))
    kind = df.schema[key].dataType.simpleString()
    xs = [f"x{i}" for i in range(len(dims))]
    sa = F.col(sensitive) if sensitive else F.lit("")
    rows = df.select(F.col(key).alias("key"), *(F.col(c).cast("double").alias(x) for x, c in zip(xs, dims)), sa.cast("string").alias("sa"), (F.col(start) if start else F.lit(0)).alias("root"), F.lit(1).cast("long").alias("node"))
    known = F.forall(F.array(*xs), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.col("root").isNotNull()
    rows = kept(rows.withColumns({"known": F.coalesce(known, F.lit(False)), "closed": F.lit(False)}))
    if not rows.groupBy("key").count().filter("count > 1 OR key IS NULL").isEmpty():
        raise ValueError(f"{key} has nulls or repeated values")
    keep, level, ends = rows.filter("known").drop("known"), 0, None
    while True:
        nodes = decide(keep, xs, rule, max(local_rows, 2 * k), least_variance, seed).collect()  # of more than local_rows rows each
        if not nodes:
            break
        if rule == "rank" and ends is None and kind in ("tinyint", "smallint", "int", "bigint"):
            ends = tuple(rows.agg(F.min("key"), F.max("key")).first())
        cuts, tied = exact_cuts(keep, xs, [r for r in nodes if not r.shut], rule == "rank", ends)
        if tied:
            tied_cuts(keep, xs, tied)
        least = {"rank": 0, "median": k, "total": 1}[rule]
        made = [(r.root, r.node, r.dim, True, None, None) for r in nodes if r.shut]
        made += [(*c.at, c.dim, min(c.n_left, c.m - c.n_left) < least, c.cut, c.cut_key) for c in cuts + tied]
        table = sized(rows.sparkSession.createDataFrame(made, f"root {rows.schema['root'].dataType.simpleString()}, node long, dim int, shut boolean, cut double, cut_key {kind}"), len(made))
        x = along(xs)
        right = (x > F.col("cut")) | ((x == F.col("cut")) & (F.col("key") > F.col("cut_key"))) if rule == "rank" else x > F.col("cut")
        keep = keep.join(table, NODE, "left").withColumns({"node": F.when(F.col("shut") | F.col("shut").isNull(), F.col("node")).otherwise(2 * F.col("node") + right.cast("long")), "closed": F.col("closed") | F.coalesce("shut", F.lit(False))})
        keep, level = keep.select("key", *xs, "sa", "root", "node", "closed"), level + 1
        if level % 3 == 0:
            keep = kept(keep)

    def tail(pdf: pd.DataFrame) -> pd.DataFrame:
        x, keys, node, labels = pdf[xs].to_numpy(float), pdf["key"].to_numpy(), int(pdf["node"].iloc[0]), pdf["sa"].to_numpy()
        if rule == "rank":
            leaves = rank_leaves(x, keys, node, k)
        else:
            leaves = median_leaves(x, labels, node, k, e, least_variance) if rule == "median" else total_leaves(x, labels, node, k, e, least_variance, small, seed)
        group = np.full(len(keys), None, object)
        for name, at in leaves.items():
            for members in [at] if refine is None else refine(x, labels, np.sort(at)):
                group[members] = name if refine is None else keys[members].min()
        return pd.DataFrame({"key": keys, "root": pdf["root"].to_numpy(), "group_id": group})

    root, name = rows.schema["root"].dataType.simpleString(), "long" if refine is None else kind
    out = by_runs(keep.filter("NOT closed"), NODE, tail, f"key {kind}, root {root}, group_id {name}")
    whole = F.col("node") if rule == "total" and refine is None else F.lit(None)
    out = out.unionByName(keep.filter("closed").select("key", "root", whole.cast(name).alias("group_id")))
    out = out.unionByName(rows.filter("NOT known").select("key", "root", F.lit(None).cast(name).alias("group_id")))
    return out.select(F.col("key").alias(key), *([F.col("root").alias(start)] if start else []), "group_id")
