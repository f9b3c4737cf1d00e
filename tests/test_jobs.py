import pytest

from graincloak import queries as Q
from graincloak.jobs import Job, anonymize, assign
from graincloak.sources.tables import by_kind, complete, fixed_sample, read_table, required, write_table


def test_sweep_of_jobs(spark, small):
    got = {r.job: r for r in Q.queries()["job_sweep"](spark, small).collect()}
    unknown = spark.read.parquet(f"{small}/orders.parquet").filter("o_orderstatus = 'P'").count()
    assert got.keys() == Q.JOBS.keys()
    for r in got.values():
        assert r.n_input == 1500 and r.n_incomplete == unknown > 0
        assert r.n_rows + r.n_suppressed + r.n_incomplete == r.n_input
        assert r.breaks_k == 0 and 0 < r.ncp < 1 and r.min_size >= 8


def test_written_release(spark, small, tmp_path):
    made = anonymize(fixed_sample(Q.people(spark, small), "row_key", 200), Job(Q.WHO))
    for kind in ("parquet", "csv"):
        made.write(str(tmp_path / kind), kind)
    groups = read_table(spark, str(tmp_path / "csv" / "groups"), "csv", header=True)
    assert groups.count() == made.groups.count() and groups.filter("histogram LIKE '{%}' AND status_set LIKE '[%]'").count() == groups.count()
    assert read_table(spark, str(tmp_path / "parquet" / "assignment")).count() == 200
    assert read_table(spark, str(tmp_path / "parquet" / "report")).first().n_rows == 200


def test_refused_jobs(spark, small):
    few = Q.people(spark, small).limit(7)
    with pytest.raises(ValueError, match="fewer than 8"):
        anonymize(few, Job(Q.WHO))
    with pytest.raises(ValueError, match="missing columns: segment"):
        required(few.drop("segment"), Q.WHO)
    with pytest.raises(ValueError, match="method is one of"):
        Job(Q.WHO, "other")
    with pytest.raises(ValueError, match="no encoder"):
        Job(Q.WHO, "cluster", "linear")


def test_incomplete_rows_and_columns_by_kind(spark, small):
    rows = Q.unfinished(spark, small)
    whole = complete(rows, Q.WHO)
    assert whole.filter("status IS NULL").count() == 0 and whole.count() == rows.filter("status IS NOT NULL").count()
    assert by_kind(rows, ["totalprice", "nation", "absent"]) == (["totalprice"], ["nation"])
    once, more = ({r.row_key for r in fixed_sample(rows.repartition(p), "row_key", n).collect()} for p, n in ((1, 50), (7, 100)))
    assert len(once) == 50 and len(more) == 100 and once < more


def test_one_group_for_k_rows(spark, small):
    got = assign(complete(Q.people(spark, small), Q.WHO).limit(8), Job(Q.WHO))
    assert got.select("group_id").distinct().count() == 1 and got.count() == 8


def test_tables_as_csv(spark, tmp_path):
    write_table(spark.sql("SELECT 1 AS a, map('x', 2) AS m"), str(tmp_path / "t"), "csv", header=True)
    assert read_table(spark, str(tmp_path / "t"), "csv", header=True).first().m == '{"x":2}'
