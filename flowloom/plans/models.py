"""Queries of sources, models and forecasts (S*, M*, P7, K6, K7, streaming)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import aggregates, flow, models, privacy, quality, topics
from ..sources import tables as src
from ..streaming import daily as stream
from ..views import cases, table
from .aggregates import rounded, timed
from .flow import BACKLOG, HORIZON, PANEL, horizon
from .registry import query
from .stats import MONTHS, monthly


def panel(spark: SparkSession, d: str) -> DataFrame:
    c = cases(spark, d)
    return flow.daily_panel(c, horizon(c))


def design(spark: SparkSession, d: str) -> DataFrame:
    c = cases(spark, d)
    staff = aggregates.staffing_daily(c, "dt_alloc", "staff_id", "case_id").select("date", "staff")
    return models.backlog_design(flow.backlog_series(c, horizon(c)).withColumnRenamed("backlog_available", "backlog"), staff)


def series(spark: SparkSession, d: str) -> DataFrame:
    """Monthly receipts of each case type."""
    return cases(spark, d).groupBy("case_type", F.trunc("dt_received", "month").alias("m")).agg(
        F.count("*").cast("double").alias("x"), F.avg("weighting").alias("w")
    )


@query(
    "s1_read_extract",
    "SELECT case_id::VARCHAR AS case_id, staff_id AS staff_name, nullif(CASE WHEN case_id % 3 > 0 THEN risk ELSE '' END, '') AS risk FROM cases",
)
def s1(spark: SparkSession, d: str) -> DataFrame:
    path = src.scratch(spark, "extract")
    raw = cases(spark, d).select(
        F.col("case_id").alias("Case ID"),
        F.concat(F.lit("  "), "staff_id").alias("Staff Name"),
        F.when(F.col("case_id") % 3 > 0, F.col("risk")).otherwise(" ").alias("Risk"),
        F.lit("").alias("Empty"),
    )
    raw.write.csv(path, header=True, sep=";", ignoreLeadingWhiteSpace=False, emptyValue="")
    return src.read_extract(spark, path)


@query("s3_normalise_headers", "SELECT c_custkey AS cust_key, c_name AS cust_key__1, c_mktsegment AS segment FROM customer", cases=False)
def s3(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment").toDF(*src.normalise_headers(["Cust Key", "cust-key ", " Segment"]))


@query("s4_resolve", "SELECT c_custkey, c_mktsegment AS segment, NULL::VARCHAR AS nothing FROM customer", cases=False)
def s4(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    return c.select("c_custkey", src.resolve(c, "mktsegment").alias("segment"), src.resolve(c, "zzzz").alias("nothing"))


@query("s5_snake_headers", "SELECT c_custkey AS customer_key, c_name AS full_name FROM customer", cases=False)
def s5(spark: SparkSession, d: str) -> DataFrame:
    return src.snake_headers(table(spark, d, "customer").select(F.col("c_custkey").alias(" Customer Key"), F.col("c_name").alias("Full  Name ")))


@query("s6_write_table", "SELECT case_id, team, dt_received FROM cases")
def s6(spark: SparkSession, d: str) -> DataFrame:
    path = src.scratch(spark, "out") + ".parquet"
    src.write_table(cases(spark, d).select("case_id", "team", "dt_received"), path)
    return src.read_table(spark, path)


@query(
    "s7_write_bundle",
    f"WITH {HORIZON}, {BACKLOG} SELECT 'arrivals' AS name, count(*) AS \"rows\" FROM (SELECT DISTINCT date_trunc('month', dt_received), case_type "
    "FROM cases) UNION ALL SELECT 'backlog', count(*) FROM bl UNION ALL SELECT 'staffing', count(DISTINCT dt_alloc) FROM cases UNION ALL "
    "SELECT 'routing', count(DISTINCT case_type) FROM cases",
)
def s7(spark: SparkSession, d: str) -> DataFrame:
    c = cases(spark, d)
    parts = {
        "arrivals": aggregates.arrivals(c, "dt_received", "case_type", "month"),
        "backlog": flow.backlog_series(c, horizon(c)),
        "staffing": aggregates.staffing_daily(c, "dt_alloc", "staff_id", "case_id"),
        "routing": aggregates.routing(c, ["case_type"], "needs_legal_review"),
    }
    return src.write_bundle(parts, src.scratch(spark, "bundle"))


@query("s10_synth_cases")
def s10(spark: SparkSession, d: str) -> DataFrame:
    return src.synth_cases(cases(spark, d), 7)


@query("s10_synth_normal")
def s10_normal(spark: SparkSession, d: str) -> DataFrame:
    return src.synth_cases(cases(spark, d), 7, "normal")


def raw_cases(spark: SparkSession, d: str) -> DataFrame:
    """Cases as messy text."""
    k = F.col("case_id")
    day = lambda c: F.coalesce(F.date_format(c, "dd/MM/yyyy"), F.lit("n/a"))
    dates = ("dt_received", "dt_alloc", "dt_signoff", "dt_close", "dt_legal_req_1", "dt_legal_approval", "dt_date_of_order")
    return cases(spark, d).select(
        "case_id", F.concat(F.lit(" "), "staff_id").alias("investigator"), "team",
        F.when(k % 3 == 0, "-").otherwise(F.col("fte").cast("string")).alias("fte"), F.col("weighting").cast("string").alias("weighting"),
        F.when(k % 2 == 0, " Closed ").otherwise("odd").alias("status"), F.when(k % 5 == 0, "Yes").otherwise("No").alias("reallocated"),
        "case_type", "risk", *(day(c).alias(c) for c in dates),
    )


@query(
    "s11_run_all",
    """WITH t AS (SELECT *, CASE WHEN case_id % 3 = 0 THEN 1.0::DOUBLE ELSE fte END AS f, dt_signoff - dt_alloc AS days FROM cases),
x AS (SELECT count(*) AS n, min(dt_received) AS a, max(dt_received) AS b, max(dt_signoff) - min(dt_received) + 1 AS span FROM t),
r AS (SELECT 'engineered' AS name, n AS "rows" FROM x
  UNION ALL SELECT 'events', count(dt_alloc) + count(dt_legal_req_1) + count(dt_legal_approval) + count(dt_date_of_order) FROM t
  UNION ALL SELECT 'backlog', span FROM x
  UNION ALL SELECT 'panel', span * (SELECT count(*) FROM (SELECT DISTINCT staff_id, team, f FROM t)) FROM x
  UNION ALL SELECT 'panel_summary', count(DISTINCT staff_id) FROM t
  UNION ALL SELECT 'annual', count(*) FROM (SELECT DISTINCT year(dt_alloc), case_type FROM t WHERE days IS NOT NULL)
  UNION ALL SELECT 'team_trend', count(*) FROM (SELECT DISTINCT team, date_trunc('month', dt_alloc) FROM t WHERE days IS NOT NULL AND dt_alloc >= (SELECT max(dt_alloc) FROM t) - 365))
SELECT r.*, x.a AS first, x.b AS last FROM r, x""",
)
def s11(spark: SparkSession, d: str) -> DataFrame:
    raw = src.scratch(spark, "raw")
    raw_cases(spark, d).write.csv(raw, header=True, sep=";", ignoreLeadingWhiteSpace=False)
    return src.run_all(spark, raw, src.scratch(spark, "run"))


@query("s2_read_table", "SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer", cases=False)
def s2(spark: SparkSession, d: str) -> DataFrame:
    path = src.scratch(spark, "typed") + ".csv"
    src.write_table(table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment"), path)
    return src.read_table(spark, path).withColumn("c_custkey", F.col("c_custkey").cast("bigint"))


@query(
    "p7_engineer",
    "SELECT case_id, 'S_' || substr(sha256(lower(staff_id)), 1, 12) AS staff_id, CASE WHEN case_id % 3 = 0 THEN 1.0::DOUBLE ELSE fte END AS fte, "
    "CASE WHEN case_id % 2 = 0 THEN 'Closed' END AS status, CASE WHEN case_id % 2 = 0 THEN 4 ELSE 0 END AS status_rank, "
    "case_id % 5 = 0 AS is_reallocated, dt_received, dt_alloc, (dt_signoff - dt_alloc)::DOUBLE AS days_to_signoff, "
    "(dt_alloc - dt_received)::DOUBLE AS days_to_alloc, (dt_legal_req_1 IS NOT NULL)::INT AS legal_review FROM cases",
)
def p7(spark: SparkSession, d: str) -> DataFrame:
    out = quality.engineer(raw_cases(spark, d))
    return out.select(
        "case_id",
        "staff_id",
        "fte",
        "status",
        F.coalesce("status_rank", F.lit(0)).alias("status_rank"),
        "is_reallocated",
        "dt_received",
        "dt_alloc",
        "days_to_signoff",
        "days_to_alloc",
        "legal_review",
    )


@query(
    "m1_backlog_design",
    f"WITH {HORIZON}, {BACKLOG}, s AS (SELECT dt_alloc AS date, count(DISTINCT staff_id) AS staff FROM cases WHERE dt_alloc IS NOT NULL "
    "GROUP BY 1) SELECT bl.date, backlog_available AS backlog, coalesce(staff, 0) AS staff, (bl.date - (SELECT min(date) FROM bl))::DOUBLE AS t "
    "FROM bl LEFT JOIN s ON s.date = bl.date",
)
def m1(spark: SparkSession, d: str) -> DataFrame:
    return design(spark, d)


@query("m2_fit_backlog")
def m2(spark: SparkSession, d: str) -> DataFrame:
    kind, w = models.fit_backlog(design(spark, d))
    return spark.createDataFrame([(kind, t, float(v)) for t, v in zip(("const", "staff", "t"), w, strict=True)], "model string, term string, coef double")


@query("m3_staffing_scenario")
def m3(spark: SparkSession, d: str) -> DataFrame:
    x = design(spark, d)
    return models.staffing_scenario(x, models.fit_backlog(x)[1], 2.0)


@query("m4_forecast_glm")
def m4(spark: SparkSession, d: str) -> DataFrame:
    x = design(spark, d)
    return models.forecast_glm(x, models.fit_backlog(x)[1], 30)


@query("m5_preprocessor")
def m5(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    c = timed(spark, d).select(
        "case_id", F.col("wait").cast("double").alias("wait"), "weighting", "risk", "region", F.col("needs_legal_review").cast("double").alias("y")
    )
    made = models.preprocessor(["wait", "weighting"], ["risk"], high=["region"], y="y").fit(c).transform(c)
    return made.select("case_id", F.transform(vector_to_array("features"), lambda v: F.round(v, 6)).cast("string").alias("features"))


@query(
    "m6_target_encode",
    "WITH t AS (SELECT region, sum(needs_legal_review) AS s, count(*) AS n FROM cases GROUP BY 1) SELECT case_id, "
    "round((s + 10 * (SELECT avg(needs_legal_review) FROM cases)) / (n + 10), 6) AS region_te FROM cases JOIN t USING (region)",
)
def m6(spark: SparkSession, d: str) -> DataFrame:
    return rounded(models.target_encode(cases(spark, d), "region", "needs_legal_review").select("case_id", "region_te"))


def review(spark: SparkSession, d: str) -> DataFrame:
    return timed(spark, d).select("case_id", "needs_legal_review", F.col("wait").cast("double").alias("wait"), "weighting", "risk", "region")


@query("m7_fit_review")
def m7(spark: SparkSession, d: str) -> DataFrame:
    return models.fit_review(review(spark, d), "needs_legal_review", ["wait", "weighting"], ["risk"], "case_id", high=["region"])[2]


@query("m7_fit_plain")
def m7_plain(spark: SparkSession, d: str) -> DataFrame:
    return models.fit_review(review(spark, d), "needs_legal_review", ["wait", "weighting"], ["risk"], "case_id", mixes=(0.0,), strengths=(0.0,))[2]


@query(
    "q15_logit",
    "WITH r AS (SELECT avg(needs_legal_review) FILTER (WHERE dt_received < DATE '1998-01-01') AS a, "
    "avg(needs_legal_review) FILTER (WHERE dt_received >= DATE '1998-01-01') AS b FROM cases) SELECT 'const' AS term, round(ln(a / (1 - a)), "
    "4) AS coef FROM r UNION ALL SELECT '~post', round(ln(b / (1 - b)) - ln(a / (1 - a)), 4) FROM r",
)
def q15(spark: SparkSession, d: str) -> DataFrame:
    side = F.when(F.col("dt_received") < F.lit("1998-01-01").cast("date"), "pre").otherwise("~post")
    return models.logit(cases(spark, d).withColumn("side", side), "needs_legal_review", "side").withColumn("coef", F.round("coef", 4))


@query("s12_save_model")
def s12(spark: SparkSession, d: str) -> DataFrame:
    """Fit, save, load again and score: the saved metrics, and the same ones of the loaded model on the held-out rows."""
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    c = review(spark, d)
    model, auc, _ = models.fit_review(c, "needs_legal_review", ["wait", "weighting"], ["risk"], "case_id", mixes=(0.5,), strengths=(0.01,))
    path = src.scratch(spark, "model")
    src.save_model(model, {"auc": auc}, path, spark)
    loaded, saved = src.load_model(spark, path)
    held = models.stratified_split(c.withColumn("needs_legal_review", F.col("needs_legal_review").cast("double")), "needs_legal_review", "case_id")[1]
    again = BinaryClassificationEvaluator(labelCol="needs_legal_review").evaluate(loaded.transform(held))
    return saved.unionByName(spark.createDataFrame([("auc_of_loaded", float(again))], "metric string, value double"))


def survival(spark: SparkSession, d: str) -> DataFrame:
    """Days from allocation to sign-off or the end of the data, whether signed off, and three covariates."""
    return cases(spark, d).where("dt_alloc IS NOT NULL").select(
        "case_id",
        F.datediff(F.coalesce("dt_signoff", F.lit("2001-12-31").cast("date")), "dt_alloc").alias("t"),
        F.col("dt_signoff").isNotNull().cast("int").alias("e"),
        "weighting",
        "fte",
        (F.col("risk") == "BUILDING").cast("int").alias("building"),
    )


COX = ["weighting", "fte", "building"]


@query("m8_fit_cox")
def m8(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame(models.fit_cox(survival(spark, d), "t", "e", COX)).drop("mean")


@query("m8_cox_score")
def m8_score(spark: SparkSession, d: str) -> DataFrame:
    """case_id, partial_hazard, cumulative_hazard, survival at each case's own time."""
    c = survival(spark, d)
    fit = models.fit_cox(c, "t", "e", COX)
    scored = models.cox_score(c, "t", fit, models.cox_baseline(c, "t", "e", fit))
    return scored.select("case_id", "partial_hazard", "cumulative_hazard", "survival")


@query(
    "m9_pickup_posterior",
    f"""WITH RECURSIVE {PANEL}, gg AS (SELECT staff_id, (1 + sum(event_newcase))::INT AS shape, 1.0::DOUBLE + count(*) AS rate FROM panel GROUP BY 1),
bi AS (SELECT staff_id, shape, q, 0.0::DOUBLE AS lo, shape + 20 * sqrt(shape) + 50 AS hi, 0 AS k FROM gg, (SELECT unnest([0.05, 0.5, 0.95]::DOUBLE[]) AS q)
  UNION ALL SELECT staff_id, shape, q, CASE WHEN tail > 1 - q THEN mid ELSE lo END, CASE WHEN tail > 1 - q THEN hi ELSE mid END, k + 1
  FROM (SELECT *, list_sum(list_transform(range(shape), lambda i: exp(i * ln(mid) - mid - lgamma(i + 1)))) AS tail FROM (SELECT *, (lo + hi) / 2 AS mid FROM bi WHERE k < 60)))
SELECT staff_id, gg.shape, rate, round(gg.shape / rate, 6) AS mean, round(max(lo) FILTER (WHERE q = 0.5) / rate, 6) AS median, round(max(lo) FILTER (WHERE q = 0.05) / rate, 6) AS p5,
  round(max(lo) FILTER (WHERE q = 0.95) / rate, 6) AS p95, round(7 * gg.shape / rate, 6) AS expected_7, round(28 * gg.shape / rate, 6) AS expected_28
FROM gg JOIN bi USING (staff_id) WHERE k = 60 GROUP BY staff_id, gg.shape, rate""",
)
def m9(spark: SparkSession, d: str) -> DataFrame:
    return rounded(models.pickup_posterior(panel(spark, d)))


@query("m10_fit_delta")
def m10(spark: SparkSession, d: str) -> DataFrame:
    c = cases(spark, d)
    f = models.fit_delta(flow.backlog_series(c, horizon(c)))
    return spark.createDataFrame(
        [(t, float(m), float(s)) for t, m, s in zip(("const", *models.DELTA_TERMS), f["mean"], f["cov"].diagonal() ** 0.5, strict=True)],
        "term string, mean double, scale double",
    )


@query("m11_forecast_fan")
def m11(spark: SparkSession, d: str) -> DataFrame:
    c = cases(spark, d)
    b = flow.backlog_series(c, horizon(c))
    return models.forecast_fan(b, models.fit_delta(b), 1000, 30, 2025)


@query("m11_history_fan")
def m11_history(spark: SparkSession, d: str) -> DataFrame:
    """The backlog of the next thirty days, spread by the errors that the model made from every day of the history."""
    c = cases(spark, d)
    b = flow.backlog_series(c, horizon(c))
    return models.history_fan(b, models.fit_delta(b), 30)


def predictive_sql(by: str) -> str:
    """Least counts at which the negative binomial's mass reaches 5 % and 95 %."""
    return f"""gg AS (SELECT {by}, 1 + sum(event_newcase) AS a, 1.0::DOUBLE + count(DISTINCT date) AS b FROM panel GROUP BY 1),
ks AS (SELECT {by}, a, b, k, sum(exp(lgamma(a + k) - lgamma(a) - lgamma(k + 1) + a * ln(b / (b + 1)) - k * ln(b + 1))) OVER (PARTITION BY {by} ORDER BY k) AS upto
  FROM gg, (SELECT unnest(range(2000)) AS k)),
pp AS (SELECT {by}, round(a / b, 6) AS mean, min(k) FILTER (WHERE upto >= 0.05)::INT AS p5, min(k) FILTER (WHERE upto >= 0.95)::INT AS p95 FROM ks GROUP BY {by}, a, b)"""


@query("m12_pickup_predictive", f"WITH {PANEL}, {predictive_sql('team')} SELECT * FROM pp")
def m12(spark: SparkSession, d: str) -> DataFrame:
    return rounded(models.pickup_predictive(panel(spark, d), "team"))


@query(
    "m13_forecast_pickups",
    f"WITH {PANEL}, {predictive_sql('staff_id')} SELECT staff_id, (SELECT max(date) FROM panel) + n::INT AS date, mean, p5, p95 FROM pp, "
    "(SELECT unnest(range(1, 91)) AS n)",
)
def m13(spark: SparkSession, d: str) -> DataFrame:
    return rounded(models.forecast_pickups(panel(spark, d), "staff_id"))


@query("m14_fit_pickup")
def m14(spark: SparkSession, d: str) -> DataFrame:
    return models.fit_pickup(panel(spark, d), "event_newcase", "backlog_available")


@query("m14_fit_legal")
def m14_legal(spark: SparkSession, d: str) -> DataFrame:
    return models.fit_pickup(panel(spark, d), "event_legal", "wip")


@query("m14_fit_court")
def m14_court(spark: SparkSession, d: str) -> DataFrame:
    return models.fit_pickup(panel(spark, d), "event_court", "wip")


@query(
    "m15_naive_forecast",
    f"WITH {MONTHS} SELECT step::INT AS step, x AS forecast FROM (SELECT unnest(range(1, 25)) AS step) JOIN (SELECT x, "
    "row_number() OVER (ORDER BY m DESC) AS k FROM mm) ON k = 12 - (step - 1) % 12",
)
def m15(spark: SparkSession, d: str) -> DataFrame:
    return models.naive_forecast(monthly(spark, d), "m", "x", 24, 12)


@query("m16_smooth_forecast")
def m16(spark: SparkSession, d: str) -> DataFrame:
    return models.smooth_forecast(series(spark, d), "case_type", "m", "x", 12, 12)


@query("m17_grid_forecast")
def m17(spark: SparkSession, d: str) -> DataFrame:
    return models.grid_forecast(series(spark, d), "case_type", "m", "x", 12)


@query("m18_forecast_exog")
def m18(spark: SparkSession, d: str) -> DataFrame:
    return models.forecast_exog(series(spark, d), "case_type", "m", "x", ["w"], [1, 12], 12)


def embedded(spark: SparkSession, d: str) -> DataFrame:
    """vec_id, and all components of the embeddings."""
    e = table(spark, d, "embeddings")
    n = e.agg(F.max(F.size("embedding"))).first()[0] or 0
    return e.select("vec_id", *(F.get("embedding", F.lit(i)).cast("double").alias(f"x{i}") for i in range(n)))


@query("m19_pca")
def m19(spark: SparkSession, d: str) -> DataFrame:
    e = embedded(spark, d).drop("vec_id")
    return models.pca(e, e.columns, 3).select("component", "share")


@query("m19_pca_share")
def m19_share(spark: SparkSession, d: str) -> DataFrame:
    """The components that hold nine tenths of the variance."""
    e = embedded(spark, d).drop("vec_id")
    return models.pca(e, e.columns, share=0.9).select("component", "share", "cumulative")


@query("m20_cluster")
def m20(spark: SparkSession, d: str) -> DataFrame:
    e = embedded(spark, d)
    return models.cluster(e, e.columns[1:], 5, bisecting=True).select("vec_id", "cluster")


@query("m20_kmeans")
def m20_kmeans(spark: SparkSession, d: str) -> DataFrame:
    e = embedded(spark, d)
    return models.cluster(e, e.columns[1:], 5).select("vec_id", "cluster")


@query("m21_topics")
def m21(spark: SparkSession, d: str) -> DataFrame:
    return topics.topics(table(spark, d, "documents").select("text"), "text", 4)


def classified(spark: SparkSession, d: str, kind: str) -> DataFrame:
    c = timed(spark, d).where("wait IS NOT NULL").select(
        "case_id", F.col("needs_legal_review").cast("double").alias("y"), F.col("wait").cast("double").alias("wait"), "weighting", "fte"
    )
    return models.fit_classifier(c, kind, "y", ["wait", "weighting", "fte"]).select("case_id", "prediction")


@query("m22_fit_classifier")
def m22(spark: SparkSession, d: str) -> DataFrame:
    return classified(spark, d, "bayes")


@query("m22_forest")
def m22_forest(spark: SparkSession, d: str) -> DataFrame:
    return classified(spark, d, "forest")


@query("m22_perceptron")
def m22_perceptron(spark: SparkSession, d: str) -> DataFrame:
    return classified(spark, d, "perceptron")


@query("k6_synthesise")
def k6(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "lineitem")
    return privacy.synthesise(c, ["l_quantity", "l_extendedprice"], "l_returnflag", c.count() // 10, 7)


@query("k6_stratified")
def k6_stratified(spark: SparkSession, d: str) -> DataFrame:
    return privacy.stratified_synthesis(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice"], ["l_returnflag", "l_linenumber"], 7)


def halves(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    c = table(spark, d, "lineitem")
    odd = F.col("l_orderkey") % 2 == 1
    return c.where(~odd), c.where(odd)


@query("k7_transfer_auc")
def k7_auc(spark: SparkSession, d: str) -> DataFrame:
    real, made = (x.withColumn("returned", (F.col("l_returnflag") == "R").cast("int")) for x in halves(spark, d))
    return privacy.transfer_auc(real, made, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], "returned")


@query(
    "k7_neighbour_gaps",
    """WITH a AS (SELECT c_acctbal::DOUBLE AS c_acctbal, c_nationkey::DOUBLE AS c_nationkey, count(*) AS n_ FROM customer WHERE c_custkey % 2 = 0 GROUP BY ALL),
b AS (SELECT DISTINCT c_acctbal::DOUBLE AS x, c_nationkey::DOUBLE AS y FROM customer WHERE c_custkey % 2 = 1)
SELECT c_acctbal, c_nationkey, n_, round(min(sqrt(pow(c_acctbal - x, 2) + pow(c_nationkey - y, 2))), 6) AS gap FROM a, b GROUP BY ALL""",
    cases=False,
)
def k7_gaps(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    return rounded(privacy.neighbour_gaps(c.where("c_custkey % 2 = 0"), c.where("c_custkey % 2 = 1"), ["c_acctbal", "c_nationkey"]), "gap")


@query(
    "k7_privacy_report",
    "WITH a AS (SELECT * FROM lineitem WHERE l_orderkey % 2 = 0), b AS (SELECT * FROM lineitem WHERE l_orderkey % 2 = 1), g AS (SELECT p.n, "
    "min(sqrt(pow(p.x - q.x, 2) + pow(p.y - q.y, 2))) AS gap FROM (SELECT l_quantity AS x, l_discount AS y, count(*) AS n FROM a "
    "GROUP BY ALL) p, (SELECT DISTINCT l_quantity AS x, l_discount AS y FROM b) q GROUP BY p.x, p.y, p.n) "
    "SELECT 'mean_diff_l_quantity' AS measure, round(abs((SELECT avg(l_quantity) FROM a) - (SELECT avg(l_quantity) FROM b)), 4) AS value "
    "UNION ALL SELECT 'var_diff_l_quantity', round(abs((SELECT var_samp(l_quantity) FROM a) - (SELECT var_samp(l_quantity) FROM b)), 4) "
    "UNION ALL SELECT 'mean_diff_l_discount', round(abs((SELECT avg(l_discount) FROM a) - (SELECT avg(l_discount) FROM b)), 4) UNION ALL "
    "SELECT 'var_diff_l_discount', round(abs((SELECT var_samp(l_discount) FROM a) - (SELECT var_samp(l_discount) FROM b)), 4) UNION ALL "
    "SELECT 'corr_l1', round(abs((SELECT corr(l_quantity, l_discount) FROM a) - (SELECT corr(l_quantity, l_discount) FROM b)), 4) UNION ALL "
    "SELECT 'match_rate', round((SELECT count(*) FROM (SELECT DISTINCT l_suppkey, l_returnflag FROM a INTERSECT SELECT DISTINCT l_suppkey, "
    "l_returnflag FROM b)) / (SELECT count(*) FROM (SELECT DISTINCT l_suppkey, l_returnflag FROM a)), 4) UNION ALL SELECT 'nn_gap_mean', "
    "round(sum(n * gap) / sum(n), 4) FROM g UNION ALL SELECT 'nn_gap_min', round(min(gap), 4) FROM g",
    cases=False,
)
def k7(spark: SparkSession, d: str) -> DataFrame:
    return privacy.privacy_report(*halves(spark, d), ["l_quantity", "l_discount"], ["l_suppkey", "l_returnflag"]).withColumn("value", F.round("value", 4))


@query("st_daily_counts", "SELECT ts::DATE AS day, event_type, count(*) AS n FROM events GROUP BY ALL", cases=False)
def st(spark: SparkSession, d: str) -> DataFrame:
    return stream.run_stream(spark, d)


@query(
    "st_finished_days",
    "SELECT ts::DATE AS day, event_type, count(*) AS n FROM events WHERE ts::DATE + 1 <= (SELECT max(ts) FROM events) - INTERVAL 7 DAY GROUP BY ALL",
    cases=False,
)
def st_finished(spark: SparkSession, d: str) -> DataFrame:
    return stream.run_finished(spark, d)


@query("t8_pickup_features", f"WITH {PANEL} SELECT staff_id, date, wip, time_since_last_pickup, event_newcase FROM panel WHERE backlog_available > 0")
def t8(spark: SparkSession, d: str) -> DataFrame:
    return panel(spark, d).where("backlog_available > 0").select("staff_id", "date", "wip", "time_since_last_pickup", "event_newcase")
