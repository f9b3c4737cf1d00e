import math
import random
from collections import Counter
from dataclasses import replace

import pytest

from graincloak import queries as Q
from graincloak.jobs import Job, anonymize
from graincloak.operators.release import audit, release
from graincloak.operators.repair import repair
from tests.oracle import compare

WHO = replace(Q.WHO, k=3, e=2)


def plain(leaves, alpha, entropy):
    """Level by level: breaking groups take in all that hangs below their parent. ``leaves``: node -> sensitive values."""

    def good(values):
        n = Counter(v for v in values)
        h = -sum(c / len(values) * math.log(c / len(values)) for c in n.values())
        return len(values) >= WHO.k and len(n.keys() - {None}) >= WHO.e and max(n.values()) / len(values) <= alpha and (entropy <= 0 or h >= entropy + 1e-9)

    def under(node, top):
        return node >> (node.bit_length() - top.bit_length()) == top if node >= top else False

    to = {x: x for x in leaves}
    for depth in range(max(map(int.bit_length, leaves)), 1, -1):
        for group in {g for g in to.values() if g.bit_length() == depth}:
            if not good([v for x, g in to.items() if g == group for v in leaves[x]]):
                to |= {x: group // 2 for x in leaves if under(x, group // 2)}
    return {x: g if good([v for y, h in to.items() if h == g for v in leaves[y]]) else None for x, g in to.items()}


def cut(some, node, depth):
    return [node] if depth == 0 or some.random() < 0.2 else cut(some, 2 * node, depth - 1) + cut(some, 2 * node + 1, depth - 1)


@pytest.mark.parametrize("alpha,entropy", [(0.8, 0.0), (0.5, 0.9), (0.45, 1.05), (0.2, 0.0)])
def test_repair_equals_merging_by_levels(spark, alpha, entropy):
    """A forest of random trees at once, rows without a group among them; only groups under no holding node are suppressed
    (the plain rules suppress all of a root that breaks, which is all of them)."""
    some, rows, want, key = random.Random(alpha), [], {}, 0
    for tree in range(12):
        leaves = {x: some.choices(["a", "b", "c", "d", None], weights=[9 if x % 3 else 2, 3, 2, 1, 1], k=some.randint(1, 7)) for x in cut(some, 1, 5)}
        to = plain(leaves, alpha, entropy)
        for x, values in leaves.items():
            for v in values:
                rows.append((key, v, f"t{tree}", x))
                want[key] = (f"t{tree}", to[x])
                key += 1
    rows.append((key, "a", "t0", None))
    want[key] = ("t0", None)
    df = spark.createDataFrame(rows, "row_key long, segment string, tree string, group_id long")
    got = {r.row_key: (r.tree, r.group_id) for r in repair(df.select("row_key", "segment"), df.drop("segment"), WHO, alpha, entropy, start="tree").collect()}
    whole = {t for t in {w[0] for w in want.values()} if any(w == (t, None) for k, w in want.items() if k != key)}
    assert got.keys() == want.keys()
    assert {k: g for k, g in got.items() if g[0] not in whole} == {k: w for k, w in want.items() if w[0] not in whole}
    for tree in whole:  # no root that holds: what holds by itself stays
        groups = Counter(g for k, (t, g) in got.items() if t == tree and g is not None)
        assert all(n >= WHO.k for n in groups.values())


def test_nothing_to_repair_and_no_rows(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2], 1) for i in range(6)], "row_key long, segment string, group_id long")
    assert {r.group_id for r in repair(df.drop("group_id"), df.drop("segment"), WHO).collect()} == {1}
    assert repair(df.drop("group_id").limit(0), df.drop("segment").limit(0), WHO).count() == 0
    assert {r.group_id for r in repair(df.drop("group_id"), df.drop("segment"), WHO, alpha=0.1).collect()} == {None}


def test_repaired_release_breaks_nothing(spark, small):
    got = {r.release: r for r in Q.queries()["repair_audit"](spark, small).collect()}
    assert got["rank"].breaks_alpha > 0 and got["rank"].breaks_entropy > 0
    done = got["repaired"]
    assert (done.breaks_k, done.breaks_e, done.breaks_alpha, done.breaks_entropy, done.n_suppressed) == (0, 0, 0, 0, 0)
    assert done.n_rows == got["rank"].n_rows and 1 < done.n_groups < got["rank"].n_groups and done.ncp >= got["rank"].ncp


def test_job_with_repair(spark, small):
    job = Job(Q.WHO, "median", alpha=0.45, entropy=1.0, repair=True)
    r = anonymize(Q.people(spark, small), job).report.first()
    assert r.breaks_k == r.breaks_e == r.breaks_alpha == r.breaks_entropy == 0 and r.n_rows + r.n_suppressed == r.n_input
    with pytest.raises(ValueError, match="repaired"):
        Job(Q.WHO, "cluster", repair=True)


@pytest.mark.parametrize("name", ["repair", "repair_forest", "mondrian_total"])
def test_whole_table(spark, small, name):
    compare(spark, Q.queries()[name], Q.oracle_sql()[name], "/root/testdata/sf0.001")
