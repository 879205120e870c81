"""Queries over trial results, coverage of planned work, and reports. Orders stand for trials: type by status is a method at a setting."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditlake.functions import strings
from auditlake.operators import reports
from auditlake.plans.registry import query
from auditlake.sources.tables import discover, patch_column, table
from auditlake.sources.views import CELLS_SQL, cells

_RESULTS = "r AS (SELECT o_orderpriority AS method, o_custkey % 4 AS nd, o_orderkey % 5 AS trial, avg(o_totalprice) / 1e6 AS auc FROM orders GROUP BY ALL)"


def _results(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.groupBy(F.col("o_orderpriority").alias("method"), (F.col("o_custkey") % 4).alias("nd"), (F.col("o_orderkey") % 5).alias("trial")).agg((F.avg("o_totalprice") / 1e6).alias("auc"))


def _summary(spark, sf_dir, sample):
    out = reports.trial_summary(_results(spark, sf_dir), ["method", "nd"], "auc", sample, planned=6)
    return out.select("method", "nd", F.round("mean", 9).alias("mean"), F.round("std", 9).alias("std"), "n", F.col("label").endswith("*").alias("starred"))


_SUMMARY = f"WITH {_RESULTS} SELECT method, nd, round(avg(auc), 9) AS mean, round({{}}(auc), 9) AS std, count(*) AS n, count(*) < 6 AS starred FROM r GROUP BY ALL"


@query(_SUMMARY.format("stddev_pop"))
def trial_summary_pop(spark, sf_dir):
    return _summary(spark, sf_dir, False)


@query(_SUMMARY.format("stddev_samp"))
def trial_summary_samp(spark, sf_dir):
    return _summary(spark, sf_dir, True)


@query(f"WITH {_RESULTS}, m AS (SELECT method, avg(auc) AS m FROM r GROUP BY 1) SELECT method, round(m, 9) AS mean, round(m - (SELECT m FROM m WHERE method = '5-LOW'), 9) AS delta FROM m")
def delta_to_baseline(spark, sf_dir):
    return reports.delta_to_baseline(_results(spark, sf_dir), "method", "auc", "5-LOW").select("method", F.round("mean", 9).alias("mean"), F.round("delta", 9).alias("delta"))


@query(f"WITH {_RESULTS}, d AS (SELECT method, avg(auc) AS auc, max(auc) AS top FROM r GROUP BY 1) SELECT method, round(auc, 9) AS auc, round(top, 9) AS top FROM (SELECT * FROM d UNION ALL SELECT 'average', avg(auc), avg(top) FROM d)")
def average_row(spark, sf_dir):
    detail = _results(spark, sf_dir).groupBy("method").agg(F.avg("auc").alias("auc"), F.max("auc").alias("top"))
    return reports.with_average_row(detail, "method", ["auc", "top"]).select("method", F.round("auc", 9).alias("auc"), F.round("top", 9).alias("top"))


@query(f"""WITH {_RESULTS}, m AS (SELECT method, nd, avg(auc) AS a FROM r GROUP BY ALL) SELECT method, round(max(a) FILTER (WHERE nd = 0), 9) AS nd0, round(max(a) FILTER (WHERE nd = 1), 9) AS nd1,
round(max(a) FILTER (WHERE nd = 2), 9) AS nd2, round(max(a) FILTER (WHERE nd = 3), 9) AS nd3 FROM m GROUP BY 1""")
def results_pivot(spark, sf_dir):
    m = _results(spark, sf_dir).groupBy("method", "nd").agg(F.avg("auc").alias("a"))
    wide = reports.pivot_results(m, ["method"], "nd", [0, 1, 2, 3], "a")
    return wide.select("method", *(F.round(str(i), 9).alias(f"nd{i}") for i in range(4)))


# A unit of work is a method, a donor and a trial; it is done if one of its orders is fulfilled, and fresh if that is recent.
_DONE = """w AS (SELECT DISTINCT o_orderpriority AS method, o_custkey AS nd, (o_orderkey % 5)::BIGINT AS trial FROM orders),
d AS (SELECT o_orderpriority AS method, o_custkey AS nd, (o_orderkey % 5)::BIGINT AS trial, max(o_orderdate) >= TIMESTAMP '1996-01-01' AS fresh FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL)"""


def _work(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("method"), F.col("o_custkey").alias("nd"), (F.col("o_orderkey") % 5).alias("trial"), "o_orderstatus", "o_orderdate")
    keys = ["method", "nd", "trial"]
    done = o.where("o_orderstatus = 'F'").groupBy(*keys).agg((F.max("o_orderdate") >= F.lit("1996-01-01").cast("timestamp_ntz")).alias("fresh"))
    return o.select(*keys).distinct(), done


@query(f"WITH {_DONE} SELECT method, nd, count(*) AS wanted, count(*) FILTER (WHERE fresh) AS fresh, count(*) FILTER (WHERE NOT fresh) AS stale, count(*) FILTER (WHERE fresh IS NULL) AS missing FROM w LEFT JOIN d USING (method, nd, trial) GROUP BY ALL")
def coverage_grid(spark, sf_dir):
    return reports.coverage(*_work(spark, sf_dir), ["method", "nd", "trial"], ["method", "nd"])


@query(f"WITH {_DONE} SELECT * FROM w ANTI JOIN d USING (method, nd, trial)")
def pending_work(spark, sf_dir):
    return reports.pending(*_work(spark, sf_dir), ["method", "nd", "trial"])


@query(f"WITH {_DONE}, p AS (SELECT * FROM w ANTI JOIN d USING (method, nd, trial)) SELECT method, nd, trial, row_number() OVER (ORDER BY CASE WHEN nd < 5 THEN 0 WHEN nd < 15 THEN 1 ELSE 2 END, nd, method, trial)::INT AS rank FROM p QUALIFY row_number() OVER (ORDER BY CASE WHEN nd < 5 THEN 0 WHEN nd < 15 THEN 1 ELSE 2 END, nd, method, trial) <= 20")
def job_queue(spark, sf_dir):
    """The next twenty units: a report of the queue's head."""
    tier = F.when(F.col("nd") < 5, 0).when(F.col("nd") < 15, 1).otherwise(2)
    p = reports.pending(*_work(spark, sf_dir), ["method", "nd", "trial"])
    return reports.top_n(p, [], [tier, F.col("nd"), F.col("method"), F.col("trial")], 20)


@query(f"WITH {_DONE} SELECT method, nd, min(trial) FILTER (WHERE d.fresh IS NULL) AS trial FROM w LEFT JOIN d USING (method, nd, trial) GROUP BY ALL")
def first_incomplete(spark, sf_dir):
    w, d = _work(spark, sf_dir)
    t = w.join(d, ["method", "nd", "trial"], "left").withColumn("done", F.col("fresh").isNotNull().cast("int"))
    return reports.first_incomplete(t, ["method", "nd"], "done")


@query("SELECT CASE WHEN o_custkey % 11 = 0 THEN NULL ELSE o_orderstatus END AS status, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 9) AS share FROM orders GROUP BY 1")
def value_shares(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.when(F.col("o_custkey") % 11 != 0, F.col("o_orderstatus")).alias("status"))
    return reports.value_share(o, "status").withColumn("share", F.round("share", 9))


@query("SELECT r.range::INT AS label, count(e.vec_id) AS n FROM range(14) r LEFT JOIN embeddings e ON e.label = r.range GROUP BY 1")
def bin_counts(spark, sf_dir):
    return reports.bin_counts(table(spark, sf_dir, "embeddings"), "label", 14)


@query(f"WITH {CELLS_SQL}, g AS (SELECT c_custkey AS donor_id, c_mktsegment AS grp FROM customer WHERE c_acctbal >= 0) SELECT donor_id, count(*) AS n, grp FROM cells JOIN g USING (donor_id) GROUP BY ALL")
def subgroup_join(spark, sf_dir):
    donors = cells(spark, sf_dir).groupBy("donor_id").agg(F.count("*").alias("n"))
    g = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("donor_id"), F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment")).alias("grp"))
    return reports.attach_subgroup(donors, g, "grp")


@query("""WITH a AS (SELECT o_orderpriority AS k, avg(o_totalprice) AS x FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1), b AS (SELECT o_orderpriority AS k, avg(o_totalprice) AS x FROM orders WHERE o_orderkey % 2 = 1 GROUP BY 1)
SELECT k, round(a.x, 4) AS old, round(b.x, 4) AS new, round(b.x - a.x, 4) AS delta, round((b.x - a.x) / abs(a.x), 9) AS relative FROM a JOIN b USING (k)""")
def stale_metric_comparison(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumnRenamed("o_orderpriority", "k")
    side = lambda i: o.where(F.col("o_orderkey") % 2 == i).groupBy("k").agg(F.avg("o_totalprice").alias("x"))
    out = reports.compare_metrics(side(0), side(1), ["k"], "x")
    return out.select("k", *(F.round(c, 4).alias(c) for c in ("old", "new", "delta")), F.round("relative", 9).alias("relative"))


@query("""WITH t AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'no_dp' WHEN 1 THEN 'eps_' || p_size WHEN 2 THEN 'v2_eps_' || rpad('1', (p_size % 5 + 1)::INT, '0') ELSE p_brand END AS v FROM part)
SELECT p_partkey, v AS variant, CASE WHEN v = 'no_dp' THEN '∞' WHEN regexp_full_match(regexp_extract(replace(v, 'v2_', ''), 'eps_(\\d+)', 1), '10*') THEN '10^' || (length(regexp_extract(replace(v, 'v2_', ''), 'eps_(\\d+)', 1)) - 1)::VARCHAR
ELSE nullif(regexp_extract(replace(v, 'v2_', ''), 'eps_(\\d+)', 1), '') END AS label FROM t""")
def epsilon_labels(spark, sf_dir):
    size = F.col("p_size").cast("string")
    of = [F.lit("no_dp"), F.concat(F.lit("eps_"), size), F.concat(F.lit("v2_eps_"), F.rpad(F.lit("1"), (F.col("p_size") % 5 + 1).cast("int"), F.lit("0"))), F.col("p_brand")]
    variant = F.when(F.col("p_partkey") % 4 == 0, of[0]).when(F.col("p_partkey") % 4 == 1, of[1]).when(F.col("p_partkey") % 4 == 2, of[2]).otherwise(of[3])
    return table(spark, sf_dir, "part").select("p_partkey", variant.alias("variant")).withColumn("label", strings.epsilon_label(F.col("variant")))


@query("SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def patched_column(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    changes = o.where("o_totalprice > 300000").select("o_orderkey", F.lit("X").alias("o_orderstatus"))
    return patch_column(o.select("o_orderkey", "o_orderstatus"), changes, ["o_orderkey"], "o_orderstatus")


@query("SELECT n_nationkey, '{\"n_nationkey\":' || n_nationkey || ',\"n_name\":\"' || n_name || '\"}' AS record FROM nation")
def json_records(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return n.select("n_nationkey", F.to_json(F.struct("n_nationkey", "n_name")).alias("record"))


@query("SELECT n_name, regexp_replace(replace(replace(n_name, '_', '\\_'), '&', '\\&'), '^(-?)0\\.', '\\1.') AS escaped, regexp_replace(round(n_nationkey / 25, 3)::VARCHAR, '^(-?)0\\.', '\\1.') AS share FROM nation")
def report_strings(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    return n.select("n_name", strings.latex_escape(F.col("n_name")).alias("escaped"), strings.strip_zero(F.round(F.col("n_nationkey") / 25, 3).cast("string")).alias("share"))


@query("SELECT region, n, '| ' || region || ' | ' || n || ' |' AS line FROM (SELECT r_name AS region, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1)")
def markdown_report(spark, sf_dir):
    n = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    counts = n.groupBy(F.col("r_name").alias("region")).agg(F.count("*").alias("n"))
    lines = reports.markdown(counts, ["region", "n"]).withColumn("region", F.trim(F.split("line", "\\|")[1]))
    return counts.join(lines, "region")


@query()
def discovered_files(spark, sf_dir):
    """The region table's file, found by a glob, with its time."""
    return discover(spark, f"{sf_dir}/region*.parquet", "parquet").select("r_name", "file_path", "nd")


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY ALL")
def event_windows(spark, sf_dir):
    """The streaming extension's window over a batch: the same plan that a stream runs."""
    from auditlake.streaming.scorer import windowed_activity

    out = windowed_activity(table(spark, sf_dir, "events"))
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("value", 4).alias("value"))


@query("SELECT user_id AS donor_id, round(avg(value), 6) AS score, count(*) AS n FROM events GROUP BY 1")
def running_donor_means(spark, sf_dir):
    from auditlake.streaming.scorer import running_donor_means as means

    return means(table(spark, sf_dir, "events")).withColumn("score", F.round("score", 6))


@query("SELECT n_regionkey, max(n_nationkey) AS latest, max_by(n_name, n_nationkey) AS path FROM nation GROUP BY 1")
def latest_checkpoint(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    step = F.regexp_extract(F.concat(F.lit("model"), F.col("n_nationkey").cast("string"), F.lit(".pt")), r"model(\d+)", 1).cast("int")
    return n.groupBy("n_regionkey").agg(F.max(step).alias("latest"), F.max_by("n_name", step).alias("path"))


