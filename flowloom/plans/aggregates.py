"""Queries of the aggregations (A*)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import aggregates as op
from ..operators import flow
from ..views import AS_OF, cases, table
from .flow import PANEL, horizon
from .registry import query

DUR = "d AS (SELECT *, dt_signoff - dt_alloc AS days, dt_alloc - dt_received AS wait FROM cases)"
SPREAD = "count({0}) AS n, round(avg({0}), 6) AS mean, round(coalesce(stddev_samp({0}), 0), 6) AS std, min({0})::DOUBLE AS min, " + ", ".join(
    "round(quantile_cont({0}, %s), 6) AS p%d" % (p, round(p * 100))
    for p in op.QUANTILES
) + ", max({0})::DOUBLE AS max"


def rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), 6) for c in cols or [c for c, t in df.dtypes if t == "double"]})


def timed(spark: SparkSession, d: str) -> DataFrame:
    return cases(spark, d).withColumns({"days": F.datediff("dt_signoff", "dt_alloc"), "wait": F.datediff("dt_alloc", "dt_received")})


@query(
    "a1_group_summary",
    f"WITH {DUR} SELECT case_type, team, round(avg(days), 6) AS mean_days, count(days) AS n_days, round(quantile_cont(wait, 0.5), "
    "6) AS median_wait, round(sum(weighting), 6) AS load, count(DISTINCT staff_id) AS staff FROM d GROUP BY ALL",
)
def a1(spark: SparkSession, d: str) -> DataFrame:
    return rounded(
        op.group_summary(
            timed(spark, d),
            ["case_type", "team"],
            {
                "mean_days": ("days", "mean"),
                "n_days": ("days", "count"),
                "median_wait": ("wait", "median"),
                "load": ("weighting", "sum"),
                "staff": ("staff_id", "nunique"),
            },
        )
    )


@query(
    "a2_distribution",
    f"WITH {DUR}, l AS (SELECT 'days' AS metric, days::DOUBLE AS v FROM d UNION ALL SELECT 'wait', wait FROM d) SELECT metric, "
    f"{SPREAD.format('v')} FROM l WHERE v >= 0 GROUP BY 1",
)
def a2(spark: SparkSession, d: str) -> DataFrame:
    return rounded(op.distribution(timed(spark, d), ["days", "wait"]))


@query(
    "a3_distribution_by",
    f"WITH {DUR}, l AS (SELECT 'days' AS metric, CASE WHEN risk <> 'BUILDING' THEN risk END AS risk, days::DOUBLE AS v FROM d UNION ALL "
    f"SELECT 'wait', CASE WHEN risk <> 'BUILDING' THEN risk END, wait FROM d) SELECT metric, risk, {SPREAD.format('v')} FROM l WHERE v >= 0 "
    "GROUP BY ALL",
)
def a3(spark: SparkSession, d: str) -> DataFrame:
    c = timed(spark, d).withColumn("risk", F.when(F.col("risk") != "BUILDING", F.col("risk")))
    return rounded(op.distribution_by(c, ["risk"], ["days", "wait"]))


@query(
    "a4_monthly_trend",
    f"WITH {DUR}, m AS (SELECT team, strftime(dt_alloc, '%Y-%m') AS month, quantile_cont(days, 0.5) AS value FROM d WHERE days IS NOT NULL "
    "GROUP BY ALL) SELECT team, month, round(value, 6) AS value, round(value - lag(value) OVER (PARTITION BY team ORDER BY month), 6) AS delta "
    "FROM m",
)
def a4(spark: SparkSession, d: str) -> DataFrame:
    return rounded(op.monthly_trend(timed(spark, d), "dt_alloc", "days", by=["team"]), "value", "delta")


@query(
    "a5_volatility",
    f"WITH {DUR}, m AS (SELECT case_type, date_trunc('week', dt_alloc) AS w, quantile_cont(days, 0.5) AS m FROM d WHERE days IS NOT NULL "
    "GROUP BY ALL) SELECT case_type, round(stddev_samp(m), 6) AS volatility, count(*) AS periods FROM m GROUP BY 1",
)
def a5(spark: SparkSession, d: str) -> DataFrame:
    return rounded(op.volatility(timed(spark, d), "dt_alloc", "days", ["case_type"]), "volatility")


@query(
    "a6_monthly_interval_stats",
    f"""WITH {DUR}, r AS (SELECT strftime(dt_alloc, '%Y-%m') AS ym, case_type AS category, days AS v FROM d WHERE dt_alloc BETWEEN DATE '1996-01-01' AND DATE '2000-12-31' AND days >= 0)
SELECT ym, CASE WHEN grouping(category) = 1 THEN 'ALL' ELSE category END AS category, round(avg(v), 6) AS mean, round(quantile_cont(v, 0.5), 6) AS median, round(stddev_samp(v), 6) AS std, round(quantile_cont(v, 0.25), 6) AS p25, round(quantile_cont(v, 0.75), 6) AS p75, count(v) AS n
FROM r GROUP BY GROUPING SETS ((ym, category), (ym)) HAVING grouping(category) = 1 OR category IS NOT NULL""",
)
def a6(spark: SparkSession, d: str) -> DataFrame:
    return rounded(op.monthly_interval_stats(timed(spark, d), "dt_alloc", "days", "case_type", "1996-01-01", "2000-12-31"))


@query(
    "a7_interval_change",
    f"""WITH {DUR}, s AS (SELECT year(dt_alloc) AS year, risk, quantile_cont(days, 0.5) AS median, quantile_cont(days, 0.25) AS p25, quantile_cont(days, 0.75) AS p75, avg(days) AS mean, count(*) AS n FROM d WHERE days IS NOT NULL GROUP BY ALL),
y AS (SELECT year, lag(year) OVER (ORDER BY year) AS prev FROM (SELECT DISTINCT year FROM s))
SELECT s.year::INT AS year, s.risk, round(s.median, 6) AS median, round(s.p25, 6) AS p25, round(s.p75, 6) AS p75, round(s.mean, 6) AS mean, s.n, round(s.median - b.median, 6) AS yoy_change FROM s JOIN y USING (year) LEFT JOIN s b ON b.year = y.prev AND b.risk = s.risk""",
)
def a7(spark: SparkSession, d: str) -> DataFrame:
    return rounded(op.interval_change(timed(spark, d), "dt_alloc", "days", "risk"))


@query("a8_arrivals", "SELECT date_trunc('month', dt_received)::DATE AS period, case_type, count(*) AS arrivals FROM cases GROUP BY ALL")
def a8(spark: SparkSession, d: str) -> DataFrame:
    return op.arrivals(cases(spark, d), "dt_received", "case_type", "month")


@query(
    "a9_staffing_daily",
    "SELECT dt_alloc AS date, count(DISTINCT staff_id) AS staff, count(case_id) AS allocations FROM cases WHERE dt_alloc IS NOT NULL GROUP BY 1",
)
def a9(spark: SparkSession, d: str) -> DataFrame:
    return op.staffing_daily(cases(spark, d), "dt_alloc", "staff_id", "case_id")


@query("a10_routing", "SELECT case_type, risk, round(avg(needs_legal_review), 6) AS rate, count(*) AS n FROM cases GROUP BY ALL")
def a10(spark: SparkSession, d: str) -> DataFrame:
    return rounded(op.routing(cases(spark, d), ["case_type", "risk"], "needs_legal_review"))


@query(
    "a11_review_rate",
    f"WITH {DUR} SELECT region, round(avg(needs_legal_review), 6) AS rate, count(*) AS n, round(quantile_cont(days, 0.5), 6) AS median, "
    "round(avg(days), 6) AS mean FROM d GROUP BY 1",
)
def a11(spark: SparkSession, d: str) -> DataFrame:
    return rounded(op.review_rate(timed(spark, d), ["region"], "needs_legal_review", "days"))


@query(
    "a12_weighted_mean",
    "SELECT l_returnflag, round(sum(l_discount * l_quantity) / sum(l_quantity), 6) AS weighted_mean, count(*) AS n FROM lineitem GROUP BY 1",
    cases=False,
)
def a12(spark: SparkSession, d: str) -> DataFrame:
    return rounded(op.weighted_mean(table(spark, d, "lineitem"), "l_discount", "l_quantity", ["l_returnflag"]))


@query(
    "a13_pickup_grid",
    f"""WITH {PANEL}, l AS (SELECT unnest(['Low', 'Medium', 'High', 'Very high']) AS load_band), g2 AS (SELECT unnest(['<1 week', '1-2 weeks', '2-4 weeks', '4-13 weeks', '>13 weeks']) AS gap_band),
b AS (SELECT CASE WHEN wip < 40 THEN 'Low' WHEN wip < 80 THEN 'Medium' WHEN wip < 120 THEN 'High' ELSE 'Very high' END AS load_band, CASE WHEN time_since_last_pickup < 7 THEN '<1 week' WHEN time_since_last_pickup < 14 THEN '1-2 weeks' WHEN time_since_last_pickup < 28 THEN '2-4 weeks' WHEN time_since_last_pickup < 90 THEN '4-13 weeks' ELSE '>13 weeks' END AS gap_band, event_newcase FROM panel WHERE wip >= 0)
SELECT load_band, gap_band, round(avg(event_newcase), 6) AS probability, count(event_newcase) AS n FROM l CROSS JOIN g2 LEFT JOIN b USING (load_band, gap_band) GROUP BY ALL""",
)
def a13(spark: SparkSession, d: str) -> DataFrame:
    c = cases(spark, d)
    return rounded(op.pickup_grid(flow.daily_panel(c, horizon(c)), F.col("wip"), F.col("time_since_last_pickup"), "event_newcase"), "probability")


@query(
    "a14_binned_interaction",
    """WITH q AS (SELECT list_sort(list_distinct([quantile_cont(l_quantity, 0.0), quantile_cont(l_quantity, 0.2), quantile_cont(l_quantity, 0.4), quantile_cont(l_quantity, 0.6), quantile_cont(l_quantity, 0.8), quantile_cont(l_quantity, 1.0)])) AS x FROM lineitem)
SELECT greatest(1, len(list_filter(x, lambda v: v < l_quantity)))::INT AS bin, l_returnflag, round(avg(l_extendedprice), 4) AS mean_target, count(*) AS n FROM lineitem, q GROUP BY ALL""",
    cases=False,
)
def a14(spark: SparkSession, d: str) -> DataFrame:
    return op.binned_interaction(
        table(spark, d, "lineitem"), "l_quantity", "l_returnflag", "l_extendedprice", 5
    ).withColumn("mean_target", F.round("mean_target", 4))


@query(
    "a14_interaction_table",
    """WITH q AS (SELECT list_sort(list_distinct([quantile_cont(l_quantity, 0.0), quantile_cont(l_quantity, 0.2), quantile_cont(l_quantity, 0.4), quantile_cont(l_quantity, 0.6), quantile_cont(l_quantity, 0.8), quantile_cont(l_quantity, 1.0)])) AS x FROM lineitem)
SELECT greatest(1, len(list_filter(x, lambda v: v < l_quantity)))::INT AS bin, round(avg(l_extendedprice) FILTER (WHERE l_returnflag = 'A'), 4) AS a, round(avg(l_extendedprice) FILTER (WHERE l_returnflag = 'N'), 4) AS n, round(avg(l_extendedprice) FILTER (WHERE l_returnflag = 'R'), 4) AS r FROM lineitem, q GROUP BY ALL""",
    cases=False,
)
def a14_table(spark: SparkSession, d: str) -> DataFrame:
    made = op.interaction_table(table(spark, d, "lineitem"), "l_quantity", "l_returnflag", "l_extendedprice", 5, ["A", "N", "R"])
    return made.select("bin", *(F.round(c, 4).alias(c.lower()) for c in "ANR"))


@query(
    "a15_monthly_kpis",
    f"WITH {DUR} SELECT strftime(dt_received, '%Y-%m') AS month, team, arg_max(weighting, (dt_received, case_id)) AS last_backlog, "
    "round(quantile_cont(wait, 0.5), 6) AS median_duration, round(avg(needs_legal_review), 6) AS rate FROM d GROUP BY ALL",
)
def a15(spark: SparkSession, d: str) -> DataFrame:
    return rounded(op.monthly_kpis(timed(spark, d), "dt_received", "case_id", "team", "weighting", "wait", "needs_legal_review"))


@query(
    "a16_resample",
    """WITH p AS (SELECT date_trunc('day', ts)::DATE AS period, count(value) AS n, avg(value) AS mean FROM events GROUP BY 1),
s AS (SELECT unnest(generate_series(min(period), max(period), INTERVAL 1 DAY))::DATE AS period FROM p), j AS (SELECT s.period, n, mean FROM s LEFT JOIN p ON p.period = s.period)
SELECT period, n, round(mean, 6) AS mean, round(CASE WHEN count(n) OVER w >= 3 THEN avg(n) OVER w END, 6) AS n_roll, round(CASE WHEN count(mean) OVER w >= 3 THEN avg(mean) OVER w END, 6) AS mean_roll FROM j WINDOW w AS (ORDER BY period ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""",
    cases=False,
)
def a16(spark: SparkSession, d: str) -> DataFrame:
    return rounded(op.resample(table(spark, d, "events"), "ts", "day", {"n": ("value", "count"), "mean": ("value", "mean")}))


@query(
    "a17_period_counts",
    """WITH p AS (SELECT date_trunc('day', ts)::DATE AS period, event_type, count(*) AS n FROM events GROUP BY ALL),
s AS (SELECT unnest(generate_series(min(period), max(period), INTERVAL 1 DAY))::DATE AS period FROM p), k AS (SELECT DISTINCT event_type FROM p)
SELECT s.period, k.event_type, coalesce(n, 0) AS n FROM s CROSS JOIN k LEFT JOIN p ON p.period = s.period AND p.event_type = k.event_type""",
    cases=False,
)
def a17(spark: SparkSession, d: str) -> DataFrame:
    return op.period_counts(table(spark, d, "events"), "ts", "event_type", "day")


@query(
    "a18_aggregate_backlog",
    f"""WITH b AS (SELECT unnest(generate_series(dt_received, coalesce(dt_alloc, DATE '{AS_OF}'), INTERVAL 1 DAY))::DATE AS date FROM cases),
m AS (SELECT date_trunc('month', date)::DATE AS period, count(*) AS backlog FROM b GROUP BY 1), k AS (SELECT case_type, count(DISTINCT case_id) AS n FROM cases GROUP BY 1)
SELECT period, case_type, backlog * n AS backlog FROM m CROSS JOIN k""",
)
def a18(spark: SparkSession, d: str) -> DataFrame:
    c = cases(spark, d)
    return op.aggregate_backlog(flow.open_backlog(c, AS_OF), "month", c.groupBy("case_type").agg(F.count_distinct("case_id").alias("n")))


@query(
    "a19_pickup_history",
    f"WITH {PANEL}, pu AS (SELECT team, date, sum(event_newcase)::BIGINT AS pickups FROM panel GROUP BY ALL) SELECT *, "
    "sum(pickups) OVER (PARTITION BY team ORDER BY date)::BIGINT AS cumulative FROM pu",
)
def a19(spark: SparkSession, d: str) -> DataFrame:
    c = cases(spark, d)
    return op.pickup_history(flow.daily_panel(c, horizon(c)), "team")


@query(
    "a20_category_trend",
    "SELECT strftime(o_orderdate, '%Y-%m') AS period, count(*) FILTER (WHERE o_orderstatus = 'F') AS F, "
    "count(*) FILTER (WHERE o_orderstatus = 'O') AS O, count(*) FILTER (WHERE o_orderstatus = 'P') AS P FROM orders GROUP BY 1",
    cases=False,
)
def a20(spark: SparkSession, d: str) -> DataFrame:
    return op.category_trend(table(spark, d, "orders"), "o_orderdate", "o_orderstatus", ["F", "O", "P"])


@query(
    "a21_pre_post",
    "WITH n AS (SELECT CASE WHEN o_orderdate < DATE '1998-06-01' THEN 'pre' ELSE 'post' END AS period, o_orderpriority, count(*) AS n "
    "FROM orders GROUP BY ALL) SELECT *, round(n / sum(n) OVER (PARTITION BY period), 6) AS share FROM n",
    cases=False,
)
def a21(spark: SparkSession, d: str) -> DataFrame:
    return rounded(op.pre_post(table(spark, d, "orders"), "o_orderpriority", "o_orderdate", "1998-06-01"))


@query(
    "a22_delay_bounds",
    f"""WITH {DUR} SELECT period, case_type, round(min(wait) / 30.4375, 6) AS least_months, round(max(wait) / 30.4375, 6) AS most_months
FROM d JOIN (VALUES ('early', DATE '1995-01-01', DATE '1997-12-31'), ('late', DATE '1998-01-01', DATE '2001-12-31')) p(period, a, b) ON dt_received BETWEEN a AND b WHERE wait IS NOT NULL GROUP BY ALL""",
)
def a22(spark: SparkSession, d: str) -> DataFrame:
    return rounded(
        op.delay_bounds(timed(spark, d), "dt_received", "case_type", "wait", [("early", "1995-01-01", "1997-12-31"), ("late", "1998-01-01", "2001-12-31")])
    )


@query(
    "a23_order_list", "SELECT o_custkey, string_agg(o_orderkey || ':' || o_orderstatus, ',' ORDER BY o_orderkey) AS orders FROM orders GROUP BY 1", cases=False
)
def a23(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.joins import order_list

    items = order_list(table(spark, d, "orders"), "o_custkey", ["o_orderkey", "o_orderstatus"])
    return items.select(
        "o_custkey", F.array_join(F.transform("items", lambda x: F.concat_ws(":", x["o_orderkey"].cast("string"), x["o_orderstatus"])), ",").alias("orders")
    )


@query("a24_earliest", "SELECT staff_id, min(dt_received) AS dt_received FROM cases GROUP BY 1")
def a24(spark: SparkSession, d: str) -> DataFrame:
    return op.earliest(cases(spark, d), "staff_id", "dt_received")


@query(
    "a25_describe_all",
    """WITH l AS (SELECT 'c_mktsegment' AS "column", c_mktsegment AS text, NULL::DOUBLE AS x FROM customer UNION ALL SELECT 'c_nationkey', c_nationkey::VARCHAR, c_nationkey FROM customer),
p AS (SELECT "column", text, count(*) AS k FROM l GROUP BY ALL), t AS (SELECT "column", first(text ORDER BY k DESC, text) AS top, max(k) AS freq, count(*) AS "distinct" FROM p GROUP BY 1)
SELECT t."column", t.top, t.freq, t."distinct", count(*) AS n, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std, round(quantile_cont(x, 0.25), 6) AS p25, round(quantile_cont(x, 0.5), 6) AS p50, round(quantile_cont(x, 0.75), 6) AS p75 FROM l JOIN t USING ("column") GROUP BY ALL""",
    cases=False,
)
def a25(spark: SparkSession, d: str) -> DataFrame:
    return rounded(op.describe_all(table(spark, d, "customer").select("c_mktsegment", "c_nationkey")))


@query(
    "a26_overview",
    """WITH r AS (SELECT count(*)::DOUBLE AS "rows", 4.0::DOUBLE AS columns, (count(*) * 4 - count(case_id) - count(dt_received) - count(dt_close) - count(needs_legal_review)) / (4 * count(*))::DOUBLE AS missing_share,
  (count(case_id) - count(DISTINCT case_id))::DOUBLE AS repeated_ids, avg(needs_legal_review) AS target_share, (max(dt_received) - min(dt_received))::DOUBLE AS span_dt_received FROM cases)
SELECT measure, round(value, 6) AS value FROM (UNPIVOT r ON COLUMNS(*) INTO NAME measure VALUE value)""",
)
def a26(spark: SparkSession, d: str) -> DataFrame:
    c = cases(spark, d).select("case_id", "dt_received", "dt_close", "needs_legal_review")
    return rounded(op.overview(c, "case_id", ["dt_received"], "needs_legal_review"))


@query(
    "a27_missingness",
    "SELECT \"column\", missing, round(missing / n, 6) AS share FROM (SELECT 'dt_alloc' AS \"column\", count(*) - count(dt_alloc) AS missing, "
    "count(*) AS n FROM cases UNION ALL SELECT 'dt_close', count(*) - count(dt_close), count(*) FROM cases UNION ALL SELECT 'risk', "
    "count(*) - count(risk), count(*) FROM cases)",
)
def a27(spark: SparkSession, d: str) -> DataFrame:
    return rounded(op.missingness(cases(spark, d).select("dt_alloc", "dt_close", "risk")), "share")


@query("a28_missing_by_target", "SELECT needs_legal_review, round(avg((dt_close IS NULL)::INT), 6) AS missing_share, count(*) AS n FROM cases GROUP BY 1")
def a28(spark: SparkSession, d: str) -> DataFrame:
    return rounded(op.missing_by_target(cases(spark, d), "dt_close", "needs_legal_review"), "missing_share")


@query(
    "a29_imbalance",
    "SELECT count(*) FILTER (WHERE toxic = 0) AS n0, count(*) FILTER (WHERE toxic = 1) AS n1, round(avg(toxic), 6) AS share FROM labels",
    cases=False,
)
def a29(spark: SparkSession, d: str) -> DataFrame:
    return rounded(op.imbalance(table(spark, d, "labels"), "toxic"))


@query(
    "a30_profile",
    """SELECT 'c_mktsegment' AS "column", 'string' AS type, min(c_mktsegment) AS least, max(c_mktsegment) AS largest, count(DISTINCT c_mktsegment) AS cardinality, string_agg(DISTINCT c_mktsegment, '|' ORDER BY c_mktsegment) AS "values" FROM customer
UNION ALL SELECT 'c_name', 'string', min(c_name), max(c_name), count(DISTINCT c_name), NULL FROM customer""",
    cases=False,
)
def a30(spark: SparkSession, d: str) -> DataFrame:
    return op.profile(table(spark, d, "customer").select("c_mktsegment", "c_name"))
