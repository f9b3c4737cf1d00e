from collections import Counter
from statistics import mean, stdev

import pytest

from graincloak import queries as Q
from tests.oracle import compare


@pytest.mark.parametrize("name", Q.oracle_sql())
def test_query_equals_sql(spark, small, name):
    compare(spark, Q.queries()[name], Q.oracle_sql()[name], small)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 1


@pytest.mark.parametrize("name", ["mondrian_median", "mondrian_total", "microagg_latent", "microagg_strict", "cluster_parts"])
def test_groupings_cover_all_rows(spark, small, name):
    got = Q.queries()[name](spark, small).collect()
    want = {r.row_key for r in Q.people(spark, small).select("row_key").collect()}
    assert {r.row_key for r in got} == want and len(got) == len(want)
    sizes = Counter(r.group_id for r in got if r.group_id is not None)
    assert name == "mondrian_total" or min(sizes.values(), default=8) >= 8  # that rule keeps small leaves


def test_comparison_of_methods(spark, small):
    got = {r.method: r for r in Q.queries()["method_comparison"](spark, small).collect()}
    assert got.keys() == Q.METHODS.keys()
    assert all(r.n_rows == 1500 and r.breaks_k == 0 and 0 < r.ncp < 1 for r in got.values())
    assert got["latent"].breaks_e == 0 and got["strict"].breaks_e == 0


def test_sweep_and_sensitivity(spark, small):
    runs = Q.queries()["encoding_sweep"](spark, small).collect()
    shuffled = [r.ncp for r in runs if r.variant.startswith("permutation")]
    assert len(runs) == 7 and len(shuffled) == 5
    got = Q.queries()["permutation_sensitivity"](spark, small).first()
    assert got.n_runs == 5 and abs(got.ncp_mean - mean(shuffled)) < 1e-5 and abs(got.ncp_std - stdev(shuffled)) < 1e-5
