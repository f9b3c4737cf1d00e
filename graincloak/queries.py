"""The registered queries of the anonymisation jobs, with the SQL that gives the same rows."""

from dataclasses import replace

from pyspark.sql import functions as F

from graincloak.functions.encode import encode_codes, encode_onehot, standardise
from graincloak.functions.latent import autoencoder, covariances, encode, principal
from graincloak.jobs import Job, anonymize, linkage_risk, sweep
from graincloak.operators.cluster import cluster_groups
from graincloak.operators.metrics import attacks, linkage, linkage_rates, ncp, over_seeds, utility
from graincloak.operators.microagg import microaggregate
from graincloak.operators.mondrian import DEPTH, kept, mondrian
from graincloak.operators.release import audit, range_text, record_level, release, set_text, skew
from graincloak.operators.remainder import centroids, nearest, place_with_seats
from graincloak.operators.repair import repair
from graincloak.operators.whole import whole_groups
from graincloak.sources.tables import ORDERS as WHO
from graincloak.sources.tables import complete, people, read_table

DIMS = [f"z_{c}" for c in WHO.identifiers]
STATUS = ["F", "O", "P"]
LEVELS = 24
TREE = "segment || '-' || nation"


def encoded(spark, sf_dir):
    df = complete(people(spark, sf_dir), WHO).persist()  # read by each of the aggregations that fit the codes
    return encode_codes(standardise(df, list(WHO.numeric)), list(WHO.categorical))


def assigned(spark, sf_dir):
    rows = encoded(spark, sf_dir).persist()
    return rows, mondrian(rows, WHO.key, DIMS, WHO.k).persist()


def released(spark, sf_dir):
    rows, groups = assigned(spark, sf_dir)
    return rows, groups, release(rows, groups, WHO).persist()


def encode_query(spark, sf_dir):
    return encoded(spark, sf_dir).select("row_key", *(F.round(c, 6).alias(c) for c in DIMS))


def onehot_query(spark, sf_dir):
    return encode_onehot(complete(people(spark, sf_dir), WHO), "status", STATUS).select("row_key", *(f"status_{v}" for v in STATUS))


def node_stats_query(spark, sf_dir):
    df = people(spark, sf_dir)
    return df.groupBy("nation").agg(F.count("*").alias("m"), F.count_distinct("segment").alias("sa_values"), F.round(F.median("totalprice"), 4).alias("med"), F.round(F.var_pop("acctbal"), 2).alias("var_pop"), F.round(F.var_samp("days"), 2).alias("var_samp"))


def mondrian_query(spark, sf_dir):
    return assigned(spark, sf_dir)[1]


def release_query(spark, sf_dir):
    out = released(spark, sf_dir)[2]
    ranges = [F.round(f"{c}_{n}", 4).alias(f"{c}_{n}") for c in WHO.numeric for n in ("lo", "hi")]
    sets = [set_text(F.col(f"{c}_set")).alias(c) for c in WHO.categorical]
    return out.select("group_id", "group_size", "sa_values", *ranges, *sets, "sa_first", F.round("p_max", 6).alias("p_max"), F.round("entropy", 6).alias("entropy"), F.round("entropy_bits", 6).alias("entropy_bits"))


def release_text_query(spark, sf_dir):
    df = people(spark, sf_dir).groupBy("nation").agg(F.min("days").cast("long").alias("lo"), F.max("days").cast("long").alias("hi"), F.array_sort(F.collect_set("priority")).alias("s"))
    return df.select("nation", range_text(F.col("lo"), F.col("hi")).alias("days"), set_text(F.col("s"), trim=True).alias("priority"))


def histogram_query(spark, sf_dir):
    out = skew(people(spark, sf_dir), "nation", "segment")
    text = F.array_join(F.transform(F.map_entries("histogram"), lambda x: F.concat_ws("=", x["key"], x["value"].cast("string"))), ",")
    return out.select("nation", "group_size", text.alias("histogram"), F.round("entropy_bits", 6).alias("entropy_bits"))


def ncp_query(spark, sf_dir):
    rows, _, out = released(spark, sf_dir)
    return ncp(out, rows, WHO).select("n_groups", "n_rows", F.round("ncp", 8).alias("ncp"))


def utility_query(spark, sf_dir):
    rows, _, out = released(spark, sf_dir)
    got = utility(out, rows, WHO)
    return got.select("n_groups", "min_size", "max_size", *(F.round(c, 8).alias(c) for c in ("avg_size", "avg_p_max", "max_p_max", "avg_entropy", "avg_entropy_bits", "avg_loss")))


def audit_query(spark, sf_dir):
    return audit(released(spark, sf_dir)[2], WHO, alpha=0.5, entropy=0.5)


ALPHA, ENTROPY = 0.4, 1.2


def repair_query(spark, sf_dir):
    """The rank split with groups merged upwards until no segment has more than a share of ALPHA, and the entropy is ENTROPY."""
    rows, groups = assigned(spark, sf_dir)
    return repair(rows, groups, WHO, ALPHA, ENTROPY)


def repair_forest_query(spark, sf_dir):
    """The forest of ``mondrian_forest``, every tree repaired on its own for the priority: (row_key, tree, group_id)."""
    rows = encoded(spark, sf_dir).persist()
    return repair(rows, kept(forest_query(spark, sf_dir)), replace(WHO, sensitive="priority"), ALPHA, ENTROPY, start="tree")


def repair_audit_query(spark, sf_dir):
    """Broken promises before and after, and what the repair costs."""
    rows, groups = assigned(spark, sf_dir)
    out = None
    for name, some in (("rank", groups), ("repaired", kept(repair(rows, groups, WHO, ALPHA, ENTROPY)))):
        made = release(rows, some, WHO).persist()
        lost = some.agg(F.count_if(F.col("group_id").isNull()).alias("n_suppressed"))
        cost = ncp(made, rows, WHO).select("n_rows", F.round("ncp", 8).alias("ncp"))
        one = audit(made, WHO, ALPHA, ENTROPY).crossJoin(cost).crossJoin(lost).select(F.lit(name).alias("release"), "*")  # one row each
        out = one if out is None else out.unionByName(one)
    return out


def record_query(spark, sf_dir):
    rows, groups, out = released(spark, sf_dir)
    return record_level(rows, groups, out, WHO).select("row_key", "segment", "group_id", "group_size", F.round("totalprice_lo", 4).alias("totalprice_lo"), F.round("totalprice_hi", 4).alias("totalprice_hi"))


def linkage_query(spark, sf_dir):
    rows, _, out = released(spark, sf_dir)
    return linkage(out, rows, WHO)


def linkage_rates_query(spark, sf_dir):
    got = linkage_rates(linkage_query(spark, sf_dir))
    return got.select("n_external", F.round("umr", 8).alias("umr"), F.round("err", 8).alias("err"))


def attack_query(spark, sf_dir):
    """The linkage attack for each fraction and seed."""
    got = attacks(kept(linkage_query(spark, sf_dir)), WHO.key)
    return got.select("frac", "seed", "n_external", F.round("umr", 8).alias("umr"), F.round("err", 8).alias("err"))


def attack_summary_query(spark, sf_dir):
    got = over_seeds(attacks(kept(linkage_query(spark, sf_dir)), WHO.key))
    return got.select("frac", *(F.round(c, 8).alias(c) for c in got.columns if c != "frac"))


def covariance_query(spark, sf_dir):
    return covariances(encoded(spark, sf_dir), DIMS).select("i", "j", F.round("cov", 6).alias("cov"))


LATENT = 3


def linear_query(spark, sf_dir):
    """Each row's place on the first principal axes."""
    rows = encoded(spark, sf_dir)
    return encode(rows, DIMS, principal(rows, DIMS, LATENT)).select(WHO.key, *(f"latent_{j}" for j in range(LATENT)))


def with_latent(spark, sf_dir):
    rows = encoded(spark, sf_dir).persist()
    return encode(rows, DIMS, autoencoder(rows, WHO.key, DIMS, LATENT)[0])


def trained_query(spark, sf_dir):
    """Each row's place in the space of the trained encoder."""
    return with_latent(spark, sf_dir).select(WHO.key, *(f"latent_{j}" for j in range(LATENT)))


def encoder_query(spark, sf_dir):
    """Microaggregation in the space of the trained encoder."""
    return microaggregate(with_latent(spark, sf_dir), WHO.key, [f"latent_{j}" for j in range(LATENT)], WHO.sensitive, WHO.k, WHO.e)


def cluster_drop_query(spark, sf_dir):
    """Clusters with the rows of small ones suppressed: groups, and how many rows lost theirs."""
    got = cluster_groups(complete(people(spark, sf_dir), WHO), WHO.key, list(WHO.numeric), WHO.sensitive, WHO.k, WHO.e, small="drop")
    return got.agg(F.count_distinct("group_id").alias("n_groups"), F.count("group_id").alias("n_kept"), F.count_if(F.col("group_id").isNull()).alias("n_suppressed"))


def nearest_query(spark, sf_dir):
    """Each customer's nearest nation, by the mean balance and order price of its orders."""
    df = standardise(people(spark, sf_dir), ["totalprice", "acctbal"])
    dims = ["z_totalprice", "z_acctbal"]
    groups = df.select("row_key", F.col("nation").alias("group_id"))
    return nearest(df, centroids(df, groups, "row_key", dims), "row_key", dims)


def seats_query(spark, sf_dir):
    """The remainder of a median split, row by row in the nearest group that has fewer than 2 k rows; null without a seat."""
    rows = encoded(spark, sf_dir).persist()
    groups = mondrian(rows, WHO.key, DIMS, WHO.k, "median", WHO.sensitive, WHO.e, least_variance=0.05).persist()
    rest = rows.join(groups.filter("group_id IS NULL").select(WHO.key), WHO.key, "left_semi")
    placed = place_with_seats(rest, centroids(rows, groups, WHO.key, DIMS), WHO.key, DIMS, 2 * WHO.k)[0]
    return rest.select(WHO.key).join(placed, WHO.key, "left")


def latent_query(spark, sf_dir, e=WHO.e):
    return microaggregate(encoded(spark, sf_dir), WHO.key, DIMS, WHO.sensitive, WHO.k, e)


def strict_query(spark, sf_dir):
    return microaggregate(encoded(spark, sf_dir), WHO.key, DIMS, WHO.sensitive, WHO.k, WHO.e, "strict")


def cluster_query(spark, sf_dir):
    """Clusters on the raw numeric columns."""
    return cluster_groups(complete(people(spark, sf_dir), WHO), WHO.key, list(WHO.numeric), WHO.sensitive, WHO.k, WHO.e)


def median_query(spark, sf_dir):
    return mondrian(encoded(spark, sf_dir), WHO.key, DIMS, WHO.k, "median", WHO.sensitive, WHO.e, least_variance=0.05)


def forest_query(spark, sf_dir):
    """Each segment and nation has a median tree of its own; all are cut at once."""
    rows = encoded(spark, sf_dir).withColumn("tree", F.concat_ws("-", "segment", "nation"))
    return mondrian(rows, WHO.key, DIMS[:4], WHO.k, "median", "priority", WHO.e, least_variance=0.05, start="tree")


def again_query(spark, sf_dir):
    """The median split, then another one of all rows that the first left over: (row_key, pass, group_id)."""
    rows = encoded(spark, sf_dir).persist()
    cut = lambda some: kept(mondrian(some, WHO.key, DIMS, WHO.k, "median", WHO.sensitive, WHO.e, least_variance=0.05))
    first = cut(rows)
    again = cut(rows.join(first.filter("group_id IS NULL").select(WHO.key), WHO.key, "left_semi"))
    rows.unpersist()
    return first.filter("group_id IS NOT NULL").withColumn("pass", F.lit(1)).unionByName(again.withColumn("pass", F.lit(2)))


def whole_query(spark, sf_dir):
    """Microaggregation of the whole table, with seats for the remainder and large groups split again."""
    return whole_groups(encoded(spark, sf_dir), WHO.key, DIMS, WHO.sensitive, WHO.k, WHO.e)


def total_query(spark, sf_dir):
    return mondrian(complete(people(spark, sf_dir), WHO), WHO.key, list(WHO.numeric), WHO.k, "total", WHO.sensitive, WHO.e, least_variance=1000.0)


METHODS = {"rank": mondrian_query, "latent": encoder_query, "latent without encoder": latent_query, "strict": strict_query, "cluster": cluster_query, "latent without diversity": lambda spark, sf_dir: latent_query(spark, sf_dir, e=1)}


def comparison_query(spark, sf_dir):
    """Each method's release of the same table: groups, broken promises, NCP."""
    rows, out = encoded(spark, sf_dir).persist(), None
    for name, method in METHODS.items():
        made = release(rows, method(spark, sf_dir), WHO).persist()
        cost = ncp(made, rows, WHO).select("n_groups", "n_rows", F.round("ncp", 8).alias("ncp"))
        one = cost.crossJoin(audit(made, WHO).select("breaks_k", "breaks_e")).select(F.lit(name).alias("method"), "*")  # one row each
        out = one if out is None else out.unionByName(one)
    return out


def onehot_variant(base):
    """``base`` with a 0/1 column for each category, and the dimensions to split on."""
    columns = []
    for c in WHO.categorical:
        values = [r[0] for r in base.select(c).distinct().orderBy(c).collect()]  # fitted categories become columns
        base, columns = encode_onehot(base, c, values), columns + [f"`{c}_{v}`" for v in values]
    return base, [f"z_{c}" for c in WHO.numeric] + columns


def sweep_query(spark, sf_dir, seeds=range(5), ordered=True):
    """The rank release under each encoding of the categorical columns: codes in order, one-hot columns, shuffled codes."""
    base, out = standardise(complete(people(spark, sf_dir), WHO), list(WHO.numeric)).persist(), None
    coded = ({"integer": None} if ordered else {}) | {f"permutation {s}": s for s in seeds}
    variants = {v: (encode_codes(base, list(WHO.categorical), seed=seed), DIMS) for v, seed in coded.items()}
    if ordered:
        variants["onehot"] = onehot_variant(base)
    for name, (rows, dims) in variants.items():
        made = release(base, mondrian(rows, WHO.key, dims, WHO.k), WHO).persist()
        rates = linkage_rates(linkage(made, base, WHO)).select(F.round("umr", 8).alias("umr"), F.round("err", 8).alias("err"))
        one = ncp(made, base, WHO).select("n_groups", "n_rows", F.round("ncp", 8).alias("ncp")).crossJoin(rates).select(F.lit(name).alias("variant"), "*")  # one row each
        out = one if out is None else out.unionByName(one)
    return out


def sensitivity_query(spark, sf_dir):
    """Mean and sample deviation of each measure over the shuffled codes."""
    runs = sweep_query(spark, sf_dir, ordered=False)
    return runs.agg(F.count("*").alias("n_runs"), *(F.round(f(c), 6).alias(f"{c}_{n}") for c in ("n_groups", "ncp", "umr", "err") for n, f in (("mean", F.avg), ("std", F.stddev_samp))))


def unfinished(spark, sf_dir):
    """The people table with an unknown status for partly filled orders."""
    return people(spark, sf_dir).withColumn("status", F.when(F.col("status") != "P", F.col("status")))


def job_query(spark, sf_dir):
    """The report of a release of a table with incomplete rows."""
    got = anonymize(unfinished(spark, sf_dir), Job(WHO, alpha=0.5, entropy=0.5)).report
    exact = ["n_input", "n_incomplete", "n_suppressed", "n_groups", "n_rows", "min_size", "max_size", "breaks_k", "breaks_e", "breaks_alpha", "breaks_entropy"]
    return got.select(*exact, *(F.round(c, 8).alias(c) for c in ("avg_size", "avg_p_max", "max_p_max", "avg_entropy", "avg_entropy_bits", "avg_loss", "ncp")))


def job_risk_query(spark, sf_dir):
    """The linkage attack on that release, by attackers who know complete rows."""
    made = anonymize(unfinished(spark, sf_dir), Job(WHO))
    got = linkage_risk(made.groups, made.rows, WHO)
    return got.select("frac", *(F.round(c, 8).alias(c) for c in got.columns if c != "frac"))


JOBS = {"rank in a linear latent space": Job(WHO, encoder="linear"), "median": Job(WHO, "median"), "latent": Job(WHO, "latent", alpha=0.6), "clusters, small ones dropped": Job(WHO, "cluster", small="drop")}


def job_sweep_query(spark, sf_dir):
    """Reports of further jobs on that table."""
    got = sweep(unfinished(spark, sf_dir), JOBS)
    return got.select(*(F.round(c, 8).alias(c) if t == "double" else c for c, t in got.dtypes))


def visits_query(spark, sf_dir):
    """Sensitive-value statistics of a skewed table: the events of each hour."""
    events = read_table(spark, f"{sf_dir}/events.parquet").withColumn("hour", F.hour("ts"))
    return skew(events, "hour", "event_type").select("hour", "group_size", "sa_values", F.round("p_max", 6).alias("p_max"), F.round("entropy", 6).alias("entropy"))


def repair_ctes(source: str, sensitive: str, tree: str = "0") -> str:
    """``source`` (row_key, group_id) repaired: every breaking node goes to the first one above it that holds, which takes all
    that lies below it. It ends in repaired (row_key, tree, group_id)."""
    figures = "sum(n) AS size, count(value) AS kinds, max(n) AS most, ln(sum(n)) - sum(n * ln(n)) / sum(n) AS h"
    good = f"size >= {WHO.k} AND kinds >= {WHO.e} AND most / size <= {ALPHA} AND h >= {ENTROPY} + 1e-9"
    return f"""rp_c AS MATERIALIZED (SELECT {tree} AS tree, group_id AS leaf, {sensitive} AS value, count(*) AS n FROM {source} WHERE group_id IS NOT NULL GROUP BY ALL),
  rp_up AS MATERIALIZED (SELECT tree, leaf, leaf >> i AS node FROM (SELECT DISTINCT tree, leaf FROM rp_c), range(62) r(i) WHERE leaf >> i > 0),
  rp_v AS (SELECT tree, node, value, sum(n) AS n FROM rp_c JOIN rp_up USING (tree, leaf) GROUP BY ALL),
  rp_f AS MATERIALIZED (SELECT tree, node, {good} AS good FROM (SELECT tree, node, {figures} FROM rp_v GROUP BY tree, node)),
  rp_bad AS (SELECT tree, node AS leaf FROM rp_f WHERE NOT good AND (tree, node) IN (SELECT (tree, leaf) FROM rp_c)),
  rp_end AS MATERIALIZED (SELECT tree, leaf, max(node) FILTER (good) AS stop FROM rp_bad JOIN rp_up USING (tree, leaf) JOIN rp_f USING (tree, node) GROUP BY tree, leaf),
  rp_to AS (SELECT u.tree, u.leaf, min(u.node) AS stop FROM rp_up u JOIN (SELECT DISTINCT tree, stop FROM rp_end) e ON u.tree = e.tree AND u.node = e.stop GROUP BY ALL),
  rp_rows AS (SELECT row_key, {tree} AS tree, group_id AS leaf FROM {source}),
  repaired AS (SELECT row_key, r.tree, CASE WHEN b.leaf IS NOT NULL AND b.stop IS NULL THEN NULL ELSE coalesce(t.stop, r.leaf) END AS group_id
    FROM rp_rows r LEFT JOIN rp_to t ON r.tree = t.tree AND r.leaf = t.leaf LEFT JOIN rp_end b ON r.tree = b.tree AND r.leaf = b.leaf)"""


def total_ctes(dims: list[str], least: float, seed: int = 42) -> str:
    """The split by the sum of sample variances with its levels written out; it ends in t{DEPTH + 1} (row_key, node)."""
    xs, n = ", ".join(dims), len(dims)
    out = [f"{PEOPLE}, t0 AS (SELECT row_key, {xs}, CAST(1 AS BIGINT) AS node FROM people)"]
    var = ", ".join(f"var_samp({x}) AS v{j}" for j, x in enumerate(dims))
    plain = [f"round(v{j}, 9)" for j in range(n)]
    widest = " ".join(f"WHEN {p} = greatest({', '.join(plain)}) THEN {j}" for j, p in enumerate(plain))
    dim = f"CASE WHEN {' + '.join(f'v{j}' for j in range(n))} > {least} THEN CASE {widest} END ELSE (node * 2654435761 + {seed}) % {n} END"
    for i in range(DEPTH + 1):
        out.append(f"ts{i} AS MATERIALIZED (SELECT node, {dim} AS dim FROM (SELECT node, {var} FROM t{i} WHERE node < {2**DEPTH} GROUP BY node HAVING count(*) > {2 * WHO.k}))")
        out.append(f"tx{i} AS MATERIALIZED (SELECT row_key, {xs}, node, CASE dim {' '.join(f'WHEN {j} THEN {x}' for j, x in enumerate(dims))} END AS x FROM t{i} LEFT JOIN ts{i} USING (node))")
        out.append(f"tm{i} AS MATERIALIZED (SELECT node, median(x) AS cut, max(x) AS top FROM tx{i} WHERE x IS NOT NULL GROUP BY node)")
        out.append(f"t{i + 1} AS MATERIALIZED (SELECT row_key, {xs}, CASE WHEN cut < top THEN 2 * node + CAST(x > cut AS BIGINT) ELSE node END AS node FROM tx{i} LEFT JOIN tm{i} USING (node))")
    return ", ".join(out)


def queries():
    return {
        "encode_identity": encode_query, "encode_onehot": onehot_query, "node_stats": node_stats_query, "mondrian_rank": mondrian_query,
        "release_groups": release_query, "release_text": release_text_query, "sa_histogram": histogram_query, "release_ncp": ncp_query,
        "release_utility": utility_query, "release_audit": audit_query, "release_records": record_query, "linkage_matches": linkage_query,
        "linkage_rates": linkage_rates_query, "nearest_group": nearest_query, "remainder_seats": seats_query, "visit_skew": visits_query,
        "mondrian_median": median_query, "mondrian_total": total_query, "mondrian_forest": forest_query, "remainder_again": again_query, "microagg_whole": whole_query, "microagg_latent": latent_query, "microagg_strict": strict_query,
        "encode_covariance": covariance_query, "encode_linear": linear_query, "encode_trained": trained_query, "microagg_encoder": encoder_query,
        "linkage_attack": attack_query, "linkage_attack_summary": attack_summary_query, "cluster_drop": cluster_drop_query, "cluster_parts": cluster_query, "method_comparison": comparison_query, "encoding_sweep": sweep_query, "permutation_sensitivity": sensitivity_query,
        "repair": repair_query, "repair_forest": repair_forest_query, "repair_audit": repair_audit_query, "job_report": job_query, "job_risk": job_risk_query, "job_sweep": job_sweep_query,
    }


PEOPLE = """people AS (SELECT o_orderkey AS row_key, o_totalprice AS totalprice, c_acctbal AS acctbal,
  CAST(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS DOUBLE) AS days, o_orderstatus AS status, o_orderpriority AS priority,
  CAST(c_nationkey AS VARCHAR) AS nation, c_mktsegment AS segment FROM orders JOIN customer ON o_custkey = c_custkey)"""
_Z = ", ".join(f"({c} - avg({c}) OVER ()) / coalesce(nullif(stddev_pop({c}) OVER (), 0), 1) AS z_{c}" for c in WHO.numeric)
_CODES = ", ".join(f"CAST(dense_rank() OVER (ORDER BY {c}) - 1 AS DOUBLE) AS z_{c}" for c in WHO.categorical)
ENCODED = f"{PEOPLE}, encoded AS (SELECT *, {_Z}, {_CODES} FROM people)"


def mondrian_sql() -> str:
    """The rank split with its levels written out."""
    out, zs = [f"{ENCODED}, n0 AS (SELECT row_key, {', '.join(DIMS)}, CAST(1 AS BIGINT) AS node FROM encoded)"], ", ".join(DIMS)
    for i in range(LEVELS):
        var = ", ".join(f"round(var_pop({z}), 9) AS v{j}" for j, z in enumerate(DIMS))
        best = f"greatest({', '.join(f'v{j}' for j in range(len(DIMS)))})"
        pick = " ".join(f"WHEN v{j} = {best} THEN {z}" for j, z in enumerate(DIMS))
        out.append(f"s{i} AS MATERIALIZED (SELECT node, count(*) AS m, {var} FROM n{i} GROUP BY node HAVING count(*) > {2 * WHO.k})")
        out.append(f"p{i} AS MATERIALIZED (SELECT n{i}.row_key, {zs}, n{i}.node, m, CASE {pick} END AS x FROM n{i} LEFT JOIN s{i} USING (node))")
        side = "CASE WHEN m IS NULL THEN node ELSE 2 * node + CASE WHEN 2 * row_number() OVER (PARTITION BY node ORDER BY x, row_key) <= m + 1 THEN 0 ELSE 1 END END"
        out.append(f"n{i + 1} AS MATERIALIZED (SELECT row_key, {zs}, {side} AS node FROM p{i})")
    return ", ".join(out) + f", grouped AS MATERIALIZED (SELECT encoded.*, n{LEVELS}.node AS group_id FROM encoded JOIN n{LEVELS} USING (row_key))"


def median_ctes(source: str, p: str, dims: list[str], sensitive: str, tree: str = "0") -> str:
    """The median split of ``source`` with its levels written out, a tree for each value of ``tree``. It ends in {p}_out
    (row_key, tree, group_id), null for the remainder."""
    zs, k = ", ".join(dims), WHO.k
    out = [f"{p}_n0 AS (SELECT row_key, {sensitive} AS sa, {tree} AS tree, {zs}, CAST(1 AS BIGINT) AS node FROM {source})"]
    best = f"greatest({', '.join(f'v{j}' for j in range(len(dims)))})"
    pick = " ".join(f"WHEN v{j} = {best} THEN {z}" for j, z in enumerate(dims))
    for i in range(LEVELS):
        var = ", ".join(f"round(var_pop({z}), 9) AS v{j}" for j, z in enumerate(dims))
        out.append(f"{p}_s{i} AS MATERIALIZED (SELECT tree, node, count(*) AS m, {var} FROM {p}_n{i} WHERE node IS NOT NULL GROUP BY tree, node HAVING count(*) > {2 * k})")
        out.append(f"{p}_p{i} AS MATERIALIZED (SELECT n.*, m, {best} AS best, CASE {pick} END AS x FROM {p}_n{i} n LEFT JOIN {p}_s{i} USING (tree, node))")
        out.append(f"{p}_c{i} AS MATERIALIZED (SELECT tree, node, median(x) AS cut FROM {p}_p{i} WHERE m IS NOT NULL GROUP BY tree, node)")
        out.append(f"{p}_l{i} AS MATERIALIZED (SELECT tree, node, cut, count(*) FILTER (x <= cut) AS n_left FROM {p}_p{i} JOIN {p}_c{i} USING (tree, node) GROUP BY tree, node, cut)")
        side = f"CASE WHEN m IS NULL THEN node WHEN best > 0.05 AND least(n_left, m - n_left) >= {k} THEN 2 * node + CAST(x > cut AS INTEGER) END"
        out.append(f"{p}_n{i + 1} AS MATERIALIZED (SELECT row_key, sa, tree, {zs}, {side} AS node FROM {p}_p{i} LEFT JOIN {p}_l{i} USING (tree, node))")
    out.append(f"{p}_good AS (SELECT tree, node, node AS good FROM {p}_n{LEVELS} WHERE node IS NOT NULL GROUP BY tree, node HAVING count(*) BETWEEN {k} AND {2 * k} AND count(DISTINCT sa) >= {WHO.e})")
    out.append(f"{p}_out AS MATERIALIZED (SELECT row_key, tree, good AS group_id FROM {p}_n{LEVELS} LEFT JOIN {p}_good USING (tree, node))")
    return ", ".join(out)


def oracle_sql():
    num, cat = WHO.numeric, WHO.categorical
    ranges = ", ".join(f"min({c}) AS {c}_lo, max({c}) AS {c}_hi" for c in num)
    sets = ", ".join(f"list_sort(list(DISTINCT {c})) AS {c}_set" for c in cat)
    ecs = f"""{mondrian_sql()}, counted AS (SELECT group_id, segment, count(*) AS n FROM grouped GROUP BY ALL),
  skewed AS (SELECT group_id, sum(n) AS size, count(*) AS sa_values, max(n) AS most, sum(n * ln(n)) AS nlogn FROM counted GROUP BY group_id),
  ecs AS MATERIALIZED (SELECT group_id, CAST(size AS BIGINT) AS group_size, sa_values, {ranges}, {sets}, arg_min(segment, row_key) AS sa_first,
    any_value(most / size) AS p_max, any_value(ln(size) - nlogn / size) AS entropy, any_value((ln(size) - nlogn / size) / ln(2)) AS entropy_bits
    FROM grouped JOIN skewed USING (group_id) GROUP BY group_id, size, sa_values)"""
    width = {c: f"(SELECT max({c}) - min({c}) FROM people)" for c in num}
    parts = [f"least(greatest(({c}_hi - {c}_lo) / {width[c]}, 0), 1)" for c in num] + [f"least(len({c}_set) / (SELECT count(DISTINCT {c}) FROM people), 1)" for c in cat]
    inside = " AND ".join([f"r.{c} BETWEEN g.{c}_lo AND g.{c}_hi" for c in num] + [f"list_contains(g.{c}_set, r.{c})" for c in cat])
    met = f"""{ecs}, met AS (SELECT r.row_key, count(g.group_id) AS n_match, CAST(coalesce(sum(g.group_size), 0) AS BIGINT) AS rows_match
    FROM encoded r LEFT JOIN ecs g ON {inside} GROUP BY r.row_key)"""
    known = f"""{met}, spun AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY md5(row_key || '-' || seed), row_key) AS place FROM met CROSS JOIN (SELECT unnest([0, 1, 2, 3, 4])::INT AS seed)),
  tried AS (SELECT frac, seed, count(*) AS n_external, avg(CAST(n_match = 1 AS INTEGER)) AS umr, avg(CASE WHEN rows_match > 0 THEN 1 / rows_match ELSE 0 END) AS err
    FROM spun CROSS JOIN (SELECT unnest([0.05::DOUBLE, 0.1::DOUBLE, 0.2::DOUBLE]) AS frac) WHERE place <= greatest(1, floor((SELECT count(*) FROM met) * frac)) GROUP BY frac, seed)"""
    covs = " UNION ALL ".join(f"SELECT {i} AS i, {j} AS j, round(covar_pop({DIMS[i]}, {DIMS[j]}), 6) AS cov FROM encoded" for i in range(len(DIMS)) for j in range(i, len(DIMS)))
    sql = {
        "encode_covariance": f"WITH {ENCODED} {covs}",
        "linkage_attack": f"WITH {known} SELECT frac, seed, n_external, round(umr, 8) AS umr, round(err, 8) AS err FROM tried",
        "linkage_attack_summary": f"WITH {known} SELECT frac, {', '.join(f'round(avg({c}), 8) AS {c}_mean, round(stddev_samp({c}), 8) AS {c}_std' for c in ('err', 'umr'))} FROM tried GROUP BY frac",
        "encode_identity": f"WITH {ENCODED} SELECT row_key, {', '.join(f'round({z}, 6) AS {z}' for z in DIMS)} FROM encoded",
        "encode_onehot": f"WITH {PEOPLE} SELECT row_key, {', '.join(f'''CAST(status = '{v}' AS INTEGER) AS status_{v}''' for v in STATUS)} FROM people",
        "node_stats": f"WITH {PEOPLE} SELECT nation, count(*) AS m, count(DISTINCT segment) AS sa_values, round(median(totalprice), 4) AS med, round(var_pop(acctbal), 2) AS var_pop, round(var_samp(days), 2) AS var_samp FROM people GROUP BY nation",
        "mondrian_rank": f"WITH {mondrian_sql()} SELECT row_key, group_id FROM grouped",
        "release_groups": f"WITH {ecs} SELECT group_id, group_size, sa_values, {', '.join(f'round({c}_{n}, 4) AS {c}_{n}' for c in num for n in ('lo', 'hi'))}, {', '.join(f'array_to_string({c}_set, chr(92)) AS {c}' for c in cat)}, sa_first, round(p_max, 6) AS p_max, round(entropy, 6) AS entropy, round(entropy_bits, 6) AS entropy_bits FROM ecs",
        "release_text": f"WITH {PEOPLE}, g AS (SELECT nation, CAST(min(days) AS BIGINT) AS lo, CAST(max(days) AS BIGINT) AS hi, list_sort(list(DISTINCT priority)) AS s FROM people GROUP BY nation) SELECT nation, CASE WHEN lo = hi THEN '[' || lo || ']' ELSE '[' || lo || ',' || hi || ']' END AS days, array_to_string(s, chr(92)) AS priority FROM g",
        "sa_histogram": f"WITH {PEOPLE}, c AS (SELECT nation, segment, count(*) AS n FROM people GROUP BY ALL) SELECT nation, CAST(sum(n) AS BIGINT) AS group_size, string_agg(segment || '=' || n, ',' ORDER BY segment) AS histogram, round((ln(sum(n)) - sum(n * ln(n)) / sum(n)) / ln(2), 6) AS entropy_bits FROM c GROUP BY nation",
        "release_ncp": f"WITH {ecs} SELECT count(*) AS n_groups, CAST(sum(group_size) AS BIGINT) AS n_rows, round(sum(group_size * ({' + '.join(parts)}) / {len(parts)}) / sum(group_size), 8) AS ncp FROM ecs",
        "release_utility": f"WITH {ecs} SELECT count(*) AS n_groups, min(group_size) AS min_size, max(group_size) AS max_size, round(avg(group_size), 8) AS avg_size, round(avg(p_max), 8) AS avg_p_max, round(max(p_max), 8) AS max_p_max, round(avg(entropy), 8) AS avg_entropy, round(avg(entropy_bits), 8) AS avg_entropy_bits, round(({' + '.join(f'sum(({c}_hi - {c}_lo) / {width[c]})' for c in num)}) / (count(*) * {len(num)}), 8) AS avg_loss FROM ecs",
        "release_audit": f"WITH {ecs} SELECT count(*) AS n_groups, count(*) FILTER (group_size < {WHO.k}) AS breaks_k, count(*) FILTER (sa_values < {WHO.e}) AS breaks_e, count(*) FILTER (p_max > 0.5) AS breaks_alpha, count(*) FILTER (entropy < 0.5) AS breaks_entropy FROM ecs",
        "release_records": f"WITH {ecs} SELECT row_key, segment, group_id, group_size, round(totalprice_lo, 4) AS totalprice_lo, round(totalprice_hi, 4) AS totalprice_hi FROM grouped JOIN ecs USING (group_id)",
        "linkage_matches": f"WITH {met} SELECT * FROM met",
        "linkage_rates": f"WITH {met} SELECT count(*) AS n_external, round(avg(CAST(n_match = 1 AS INTEGER)), 8) AS umr, round(avg(CASE WHEN rows_match > 0 THEN 1 / rows_match ELSE 0 END), 8) AS err FROM met",
        "nearest_group": f"""WITH {ENCODED}, centres AS (SELECT nation AS group_id, avg(z_totalprice) AS a, avg(z_acctbal) AS b FROM encoded GROUP BY nation),
  far AS (SELECT row_key, group_id, round(sqrt((z_totalprice - a) * (z_totalprice - a) + (z_acctbal - b) * (z_acctbal - b)), 9) AS d FROM encoded CROSS JOIN centres)
  SELECT row_key, group_id FROM far QUALIFY row_number() OVER (PARTITION BY row_key ORDER BY d, group_id) = 1""",
        "visit_skew": "WITH c AS (SELECT CAST(hour(ts) AS INTEGER) AS hour, event_type, count(*) AS n FROM events GROUP BY ALL) SELECT hour, CAST(sum(n) AS BIGINT) AS group_size, count(*) AS sa_values, round(max(n) / sum(n), 6) AS p_max, round(ln(sum(n)) - sum(n * ln(n)) / sum(n), 6) AS entropy FROM c GROUP BY hour",
    }
    finished = lambda name: sql[name].replace("ON o_custkey = c_custkey)", "ON o_custkey = c_custkey WHERE o_orderstatus <> 'P')")
    sql["job_report"] = f"""SELECT i.n_input, i.n_input - n.n_rows AS n_incomplete, CAST(0 AS BIGINT) AS n_suppressed, u.*, n.n_rows, n.ncp, a.* EXCLUDE (n_groups)
  FROM (SELECT count(*) AS n_input FROM orders JOIN customer ON o_custkey = c_custkey) i CROSS JOIN ({finished("release_utility")}) u CROSS JOIN ({finished("release_ncp")}) n CROSS JOIN ({finished("release_audit")}) a"""
    once = f"{ENCODED}, {median_ctes('encoded', 'a', DIMS, 'segment')}"
    sql["mondrian_median"] = f"WITH {once} SELECT row_key, group_id FROM a_out"
    rest = "rest AS MATERIALIZED (SELECT encoded.* FROM encoded JOIN a_out USING (row_key) WHERE group_id IS NULL)"
    both = "SELECT row_key, 1 AS pass, group_id FROM a_out WHERE group_id IS NOT NULL UNION ALL SELECT row_key, 2 AS pass, group_id FROM b_out"
    sql["remainder_again"] = f"WITH {once}, {rest}, {median_ctes('rest', 'b', DIMS, 'segment')} {both}"
    sql["mondrian_forest"] = f"WITH {ENCODED}, {median_ctes('encoded', 'a', DIMS[:4], 'priority', TREE)} SELECT row_key, tree, group_id FROM a_out"
    sql["repair"] = f"WITH {mondrian_sql()}, {repair_ctes('grouped', 'segment')} SELECT row_key, group_id FROM repaired"
    forest = "SELECT encoded.*, tree, group_id FROM encoded JOIN a_out USING (row_key)"
    sql["repair_forest"] = f"WITH {ENCODED}, {median_ctes('encoded', 'a', DIMS[:4], 'priority', TREE)}, grouped AS MATERIALIZED ({forest}), {repair_ctes('grouped', 'priority', 'tree')} SELECT row_key, tree, group_id FROM repaired"
    sql["mondrian_total"] = f"WITH {total_ctes(list(WHO.numeric), 1000.0)} SELECT row_key, node AS group_id FROM t{DEPTH + 1}"
    sql["job_risk"] = finished("linkage_attack_summary")
    return sql
