"""Queries of joins, windows, top rows, filters and imputation (J*, W*, D*, O*, F*, I*, K*)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import aggregates, flow, joins, privacy, quality, windows
from ..views import AS_OF, cases, table
from .aggregates import DUR, rounded, timed
from .flow import BACKLOG, HORIZON, horizon
from .registry import query

DAILY = "e AS (SELECT ts::DATE AS day, count(*) AS n, sum(value) AS v FROM events GROUP BY 1)"


def daily(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.sum("value").alias("v"))


@query(
    "j1_zero_filled",
    f"WITH {HORIZON}, {BACKLOG}, s AS (SELECT dt_alloc AS date, count(DISTINCT staff_id) AS staff FROM cases WHERE dt_alloc IS NOT NULL "
    "GROUP BY 1) SELECT bl.date, backlog_available, coalesce(staff, 0) AS staff FROM bl LEFT JOIN s ON s.date = bl.date",
)
def j1(spark: SparkSession, d: str) -> DataFrame:
    c = cases(spark, d)
    staff = aggregates.staffing_daily(c, "dt_alloc", "staff_id", "case_id").select("date", "staff")
    return joins.zero_filled(flow.backlog_series(c, horizon(c)), staff, ["date"], ["staff"])


@query("j2_staff_days", f"WITH {HORIZON} SELECT staff_id, team, date FROM (SELECT DISTINCT staff_id, team FROM cases) CROSS JOIN spine")
def j2(spark: SparkSession, d: str) -> DataFrame:
    c = cases(spark, d)
    return c.select("staff_id", "team").distinct().crossJoin(F.broadcast(flow.day_spine(horizon(c))))


@query("j3_keys_by_horizon", "SELECT team, n, day FROM (SELECT team, count(*) AS n FROM cases GROUP BY 1) CROSS JOIN (SELECT unnest(range(1, 91)) AS day)")
def j3(spark: SparkSession, d: str) -> DataFrame:
    per = cases(spark, d).groupBy("team").agg(F.count("*").alias("n"))
    return per.crossJoin(F.broadcast(spark.range(1, 91).withColumnRenamed("id", "day")))


@query("j4_lookup_join", "SELECT c_custkey, n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey", cases=False)
def j4(spark: SparkSession, d: str) -> DataFrame:
    dim = table(spark, d, "nation").withColumnRenamed("n_nationkey", "c_nationkey")
    return joins.lookup_join(table(spark, d, "customer"), dim, "c_nationkey").select("c_custkey", "n_name")


def caseload_tables(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    k = F.col("c_custkey")
    clients = c.select(k.alias("client_id"), F.col("c_name").alias("name"), F.when(k % 4 == 0, F.floor(k / 2)).alias("payer_id"))
    ok = F.col("o_orderkey")
    return {
        "clients": clients,
        "addresses": c.where(k % 3 != 0).select(k.alias("client_id"), F.concat(F.lit("A"), k).alias("address")),
        "deaths": c.where(k % 10 == 0).select(k.alias("client_id"), F.date_add(F.lit("1999-01-01").cast("date"), (k % 365).cast("int")).alias("died")),
        "reductions": o.where(ok % 6 == 0).select(
            F.col("o_custkey").alias("client_id"),
            ok.alias("reduction_id"),
            F.to_date("o_orderdate").alias("start"),
            F.when(ok % 12 == 0, F.date_add(F.to_date("o_orderdate"), 365)).alias("end"),
        ),
        "orders": o.select(F.col("o_custkey").alias("client_id"), ok.alias("order_id"), F.to_date("o_orderdate").alias("made")),
        "levels": o.select(F.col("o_custkey").alias("client_id"), F.col("o_orderpriority").alias("level"), F.to_date("o_orderdate").alias("created")),
    }


REDUCTIONS = "SELECT o_custkey AS client_id, max(o_orderkey) AS reduction_id FROM orders WHERE o_orderkey % 6 = 0 AND o_orderdate::DATE <= DATE '1999-06-30' AND (o_orderkey % 12 <> 0 OR o_orderdate::DATE + 365 >= DATE '1999-06-30') GROUP BY 1"


@query(
    "j7_caseload_extract",
    f"""WITH o AS (SELECT o_custkey AS client_id, min(o_orderdate)::DATE AS first_order, count(*) AS n_orders FROM orders GROUP BY 1),
l AS (SELECT client_id, max(level) AS level FROM (SELECT o_custkey AS client_id, o_orderpriority AS level, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderdate::DATE DESC) AS r FROM orders) WHERE r = 1 GROUP BY 1), r AS ({REDUCTIONS})
SELECT c.c_custkey AS client_id, c.c_name AS name, CASE WHEN c.c_custkey % 4 = 0 THEN c.c_custkey // 2 END AS payer_id, p.c_name AS payer_name, CASE WHEN c.c_custkey % 3 <> 0 THEN 'A' || c.c_custkey END AS address,
  CASE WHEN c.c_custkey % 10 = 0 THEN DATE '1999-01-01' + CAST(c.c_custkey % 365 AS INT) END AS died, reduction_id, first_order, coalesce(n_orders, 0) AS n_orders, level
FROM customer c LEFT JOIN customer p ON c.c_custkey % 4 = 0 AND p.c_custkey = c.c_custkey // 2 LEFT JOIN o ON o.client_id = c.c_custkey LEFT JOIN l ON l.client_id = c.c_custkey LEFT JOIN r ON r.client_id = c.c_custkey""",
    cases=False,
)
def j7(spark: SparkSession, d: str) -> DataFrame:
    t = caseload_tables(spark, d)
    t["reductions"] = joins.active_reductions(t["reductions"], t["clients"], "1999-06-30", "client_id", "reduction_id", "start", "end")
    return joins.caseload_extract(**t)


@query("j8_active_reductions", REDUCTIONS, cases=False)
def j8(spark: SparkSession, d: str) -> DataFrame:
    t = caseload_tables(spark, d)
    return joins.active_reductions(t["reductions"], t["clients"], "1999-06-30", "client_id", "reduction_id", "start", "end")


@query(
    "j9_latest_per_key",
    "SELECT staff_id, case_id, dt_received FROM (SELECT *, rank() OVER (PARTITION BY staff_id ORDER BY dt_received DESC) AS r FROM cases) "
    "WHERE r = 1",
)
def j9(spark: SparkSession, d: str) -> DataFrame:
    return joins.latest_per_key(cases(spark, d), ["staff_id"], "dt_received").select("staff_id", "case_id", "dt_received")


@query(
    "j10_overlay",
    "SELECT case_id, status, CASE WHEN status = 'F' AND dt_close IS NULL AND case_id % 2 = 0 THEN dt_received + 100 "
    "ELSE dt_close END AS dt_close FROM cases",
)
def j10(spark: SparkSession, d: str) -> DataFrame:
    c = cases(spark, d)
    ext = c.where(F.col("case_id") % 2 == 0).select("case_id", "staff_id", F.date_add("dt_received", 100).alias("closed_on"))
    return joins.overlay(
        c, ext, ["case_id", "staff_id"], {"dt_close": "closed_on"}, "status = 'F' AND dt_close IS NULL"
    ).select("case_id", "status", "dt_close")


@query("j11_first_attribute", "SELECT case_id, first_value(case_type) OVER (PARTITION BY staff_id ORDER BY dt_received, case_id) AS first_case_type FROM cases")
def j11(spark: SparkSession, d: str) -> DataFrame:
    return joins.first_attribute(cases(spark, d), "staff_id", "case_type", ["dt_received", "case_id"]).select("case_id", "first_case_type")


@query(
    "s8_pin_snapshots",
    "SELECT o_orderkey, o_orderdate::DATE AS export_date FROM orders WHERE o_orderdate::DATE = (SELECT max(o_orderdate::DATE) FROM orders "
    "WHERE o_orderdate::DATE <= (SELECT max(o_orderdate::DATE) FROM orders WHERE o_orderstatus = 'F'))",
    cases=False,
)
def s8(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", F.to_date("o_orderdate").alias("export_date"))
    return joins.pin_snapshots(
        {"driver": (o.where("o_orderstatus = 'F'"), "export_date"), "orders": (o, "export_date")}, "driver"
    )["orders"].select("o_orderkey", "export_date")


@query(
    "w1_inter_pickup",
    "SELECT case_id, dt_alloc - lag(dt_alloc) OVER (PARTITION BY staff_id ORDER BY dt_alloc NULLS LAST, case_id) AS inter_pickup_days FROM cases",
)
def w1(spark: SparkSession, d: str) -> DataFrame:
    return windows.inter_pickup(cases(spark, d)).select("case_id", "inter_pickup_days")


@query(
    "w2_new_starter",
    "SELECT case_id, min(dt_alloc) OVER (PARTITION BY staff_id) AS first_alloc, "
    "round((dt_alloc - min(dt_alloc) OVER (PARTITION BY staff_id)) / 7, 6) AS weeks_since_first, "
    "coalesce((dt_alloc - min(dt_alloc) OVER (PARTITION BY staff_id)) / 7 <= 12, false) AS is_new_starter FROM cases",
)
def w2(spark: SparkSession, d: str) -> DataFrame:
    return rounded(windows.new_starter(cases(spark, d), "dt_alloc").select("case_id", "first_alloc", "weeks_since_first", "is_new_starter"))


@query(
    "w3_time_since_pickup",
    "WITH a AS (SELECT DISTINCT team, dt_alloc FROM cases WHERE dt_alloc IS NOT NULL) SELECT team, dt_alloc, "
    "dt_alloc - lag(dt_alloc) OVER (PARTITION BY team ORDER BY dt_alloc) AS gap FROM a",
)
def w3(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    a = cases(spark, d).where("dt_alloc IS NOT NULL").select("team", "dt_alloc").distinct()
    return a.withColumn("gap", F.datediff("dt_alloc", F.lag("dt_alloc").over(Window.partitionBy("team").orderBy("dt_alloc"))))


@query(
    "w4_allocation_gaps",
    "SELECT * FROM (SELECT case_id, lag(dt_alloc) OVER w AS prev_alloc, dt_alloc - lag(dt_alloc) OVER w AS gap_days FROM cases "
    "WHERE dt_alloc IS NOT NULL WINDOW w AS (PARTITION BY staff_id ORDER BY dt_alloc, case_id)) WHERE gap_days > 0",
)
def w4(spark: SparkSession, d: str) -> DataFrame:
    return windows.allocation_gaps(cases(spark, d)).select("case_id", "prev_alloc", "gap_days")


@query(
    "w5_gap_summary",
    "WITH g AS (SELECT case_type, dt_alloc - lag(dt_alloc) OVER (PARTITION BY staff_id ORDER BY dt_alloc, case_id) AS g FROM cases "
    "WHERE dt_alloc IS NOT NULL) SELECT case_type, count(g) AS n, round(avg(g), 6) AS mean, round(quantile_cont(g, 0.5), 6) AS median, "
    "round(quantile_cont(g, 0.25), 6) AS p25, round(quantile_cont(g, 0.75), 6) AS p75 FROM g WHERE g > 0 GROUP BY 1",
)
def w5(spark: SparkSession, d: str) -> DataFrame:
    return rounded(windows.gap_summary(windows.allocation_gaps(cases(spark, d)), ["case_type"]))


@query(
    "w6_lag_features",
    "SELECT event_id, value, lag(value, 1) OVER w AS value_lag1, lag(value, 2) OVER w AS value_lag2 "
    "FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)",
    cases=False,
)
def w6(spark: SparkSession, d: str) -> DataFrame:
    return windows.lag_features(table(spark, d, "events"), "value", 2, ["user_id"], ["ts", "event_id"]).select("event_id", "value", "value_lag1", "value_lag2")


@query(
    "w7_lag_corr",
    f"WITH {DAILY}, l AS (SELECT n, lag(v, 1) OVER (ORDER BY day) AS b1, lag(v, 7) OVER (ORDER BY day) AS b7 FROM e) SELECT 1 AS lag, "
    "round(corr(n, b1), 6) AS r FROM l WHERE b1 IS NOT NULL UNION ALL SELECT 7, round(corr(n, b7), 6) FROM l WHERE b7 IS NOT NULL",
    cases=False,
)
def w7(spark: SparkSession, d: str) -> DataFrame:
    return rounded(windows.lag_corr(daily(spark, d), "n", "v", [1, 7], "day"))


@query("w8_lead_target", "SELECT event_id, lead(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS value_next FROM events", cases=False)
def w8(spark: SparkSession, d: str) -> DataFrame:
    return windows.lead_target(table(spark, d, "events"), "value", ["user_id"], ["ts", "event_id"]).select("event_id", "value_next")


@query(
    "w9_rolling_mean",
    "SELECT event_id, round(CASE WHEN count(value) OVER w >= 3 THEN avg(value) OVER w END, 6) AS value_roll7 "
    "FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)",
    cases=False,
)
def w9(spark: SparkSession, d: str) -> DataFrame:
    return rounded(windows.rolling_mean(table(spark, d, "events"), "value", 7, 3, ["user_id"], ["ts", "event_id"]).select("event_id", "value_roll7"))


@query(
    "w10_differences",
    "WITH x AS (SELECT event_id, user_id, ts, value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS d FROM events) "
    "SELECT event_id, round(d, 6) AS d_value, round(lag(d) OVER (PARTITION BY user_id ORDER BY ts, event_id), 6) AS d_value_lag1 FROM x",
    cases=False,
)
def w10(spark: SparkSession, d: str) -> DataFrame:
    return rounded(windows.differences(table(spark, d, "events"), "value", ["user_id"], ["ts", "event_id"]).select("event_id", "d_value", "d_value_lag1"))


@query("w11_weeks_since_start", "SELECT case_id, round((dt_received - min(dt_received) OVER ()) / 7, 6) AS weeks FROM cases")
def w11(spark: SparkSession, d: str) -> DataFrame:
    c = cases(spark, d)
    return rounded(c.crossJoin(F.broadcast(c.agg(F.min("dt_received").alias("d0")))).select("case_id", (F.datediff("dt_received", "d0") / 7).alias("weeks")))


@query(
    "w12_split",
    "SELECT case_id, date_trunc('month', dt_received) >= (SELECT min(m) FROM (SELECT DISTINCT date_trunc('month', dt_received) AS m FROM cases "
    "ORDER BY m DESC LIMIT 12)) AS last_12, (dt_received - DATE '1970-01-01') > (SELECT quantile_cont(dt_received - DATE '1970-01-01', 0.8) "
    "FROM cases) AS above_q80 FROM cases",
)
def w12(spark: SparkSession, d: str) -> DataFrame:
    c = cases(spark, d).select("case_id", "dt_received", F.trunc("dt_received", "month").alias("m"))
    return windows.split_quantile(
        windows.split_last(c, "m", 12).withColumnRenamed("is_test", "last_12"), "dt_received", 0.8
    ).select("case_id", "last_12", F.col("is_test").alias("above_q80"))


@query(
    "d1_dedup_first",
    "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM orders) "
    "WHERE r = 1",
    cases=False,
)
def d1(spark: SparkSession, d: str) -> DataFrame:
    return windows.dedup_first(table(spark, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey")


@query("d2_duplicate_count", "SELECT count(l_orderkey) - count(DISTINCT l_orderkey) AS duplicates FROM lineitem", cases=False)
def d2(spark: SparkSession, d: str) -> DataFrame:
    return windows.duplicate_count(table(spark, d, "lineitem"), "l_orderkey")


@query("o1_top_k", "SELECT staff_id, count(*) AS n FROM cases GROUP BY 1 ORDER BY n DESC, staff_id LIMIT 10")
def o1(spark: SparkSession, d: str) -> DataFrame:
    return windows.top_k(cases(spark, d), "staff_id", 10)


@query(
    "o1_top_movers",
    "WITH m AS (SELECT region, count(*) FILTER (WHERE year(dt_received) = 1999) - count(*) FILTER (WHERE year(dt_received) = 1996) AS change "
    "FROM cases WHERE year(dt_received) IN (1996, 1999) GROUP BY 1) SELECT * FROM (SELECT *, 'up' AS side FROM m ORDER BY change DESC, "
    "region LIMIT 3) UNION ALL SELECT * FROM (SELECT *, 'down' FROM m ORDER BY change, region LIMIT 3)",
)
def o1m(spark: SparkSession, d: str) -> DataFrame:
    return windows.top_movers(cases(spark, d).withColumn("year", F.year("dt_received")), "year", "region", "1996", "1999", 3)


@query("o4_union_all", "SELECT case_type AS category, count(*) AS n FROM cases GROUP BY 1 UNION ALL SELECT 'ALL', count(*) FROM cases")
def o4(spark: SparkSession, d: str) -> DataFrame:
    c = cases(spark, d)
    return c.groupBy(F.col("case_type").alias("category")).agg(F.count("*").alias("n")).unionByName(
        c.agg(F.count("*").alias("n")).select(F.lit("ALL").alias("category"), "n")
    )


@query(
    "o5_match_rate",
    "SELECT round(count(b.staff_id) / count(*), 6) AS match_rate FROM (SELECT DISTINCT staff_id, region FROM cases WHERE case_id % 2 = 0) a LEFT "
    "JOIN (SELECT DISTINCT staff_id, region FROM cases WHERE case_id % 2 = 1) b ON a.staff_id = b.staff_id AND a.region = b.region",
)
def o5(spark: SparkSession, d: str) -> DataFrame:
    c, even = cases(spark, d), F.col("case_id") % 2 == 0
    return rounded(windows.match_rate(c.where(even), c.where(~even), ["staff_id", "region"]))


@query("f1_filter_years", "SELECT case_id FROM cases WHERE dt_received BETWEEN DATE '2000-06-30' - 1460 AND DATE '2000-06-30'")
def f1(spark: SparkSession, d: str) -> DataFrame:
    return quality.filter_years(cases(spark, d), "dt_received", "2000-06-30").select("case_id")


@query("f2_filter_metric", f"WITH {DUR} SELECT case_id, days FROM d WHERE dt_alloc BETWEEN DATE '1997-01-01' AND DATE '1998-12-31' AND days >= 0")
def f2(spark: SparkSession, d: str) -> DataFrame:
    return quality.filter_metric(timed(spark, d), "dt_alloc", "days", "1997-01-01", "1998-12-31").select("case_id", "days")


@query("f3_validate_dates", "SELECT case_id, dt_received AS a, dt_alloc AS b FROM cases")
def f3(spark: SparkSession, d: str) -> DataFrame:
    c = cases(spark, d).select(
        "case_id", F.date_format("dt_received", "d/M/yyyy").alias("a"), F.coalesce(F.date_format("dt_alloc", "yyyy-MM-dd"), F.lit("tbc")).alias("b")
    )
    return quality.validate_dates(c, ["a", "b"])


@query("f4_flag_invalid", "SELECT case_id, coalesce(dt_legal_req_1 > dt_close, true) AS invalid FROM cases")
def f4(spark: SparkSession, d: str) -> DataFrame:
    return quality.flag_invalid(cases(spark, d), "dt_legal_req_1", "dt_close").select("case_id", "invalid")


@query(
    "f5_check_rules",
    "SELECT 'late' AS rule, count(*) FILTER (WHERE dt_close > dt_alloc + 60) AS violations FROM cases UNION ALL SELECT 'heavy', "
    "count(*) FILTER (WHERE weighting > 4) FROM cases",
)
def f5(spark: SparkSession, d: str) -> DataFrame:
    return quality.check_rules(cases(spark, d), {"late": "dt_close > date_add(dt_alloc, 60)", "heavy": "weighting > 4"})


@query(
    "f6_validate",
    "SELECT 'dt_close' AS \"column\", 'null' AS \"check\", count(*) - count(dt_close) AS failures FROM cases UNION ALL SELECT 'weighting', "
    "'type', 0 FROM (SELECT 1) UNION ALL SELECT 'weighting', 'min', count(*) FILTER (WHERE weighting < 2) FROM cases UNION ALL "
    "SELECT 'weighting', 'max', count(*) FILTER (WHERE weighting > 4) FROM cases UNION ALL SELECT 'status', 'allowed', "
    "count(*) FILTER (WHERE status NOT IN ('O', 'F')) FROM cases",
)
def f6(spark: SparkSession, d: str) -> DataFrame:
    return quality.validate(
        cases(spark, d), {"dt_close": {"nullable": False}, "weighting": {"type": "double", "min": 2, "max": 4}, "status": {"allowed": ["O", "F"]}}
    )


@query("f7_leakage_scan", "SELECT case_id, dt_legal_req_1, dt_legal_approval, needs_legal_review FROM cases")
def f7(spark: SparkSession, d: str) -> DataFrame:
    c = cases(spark, d)
    return c.select("case_id", *quality.leakage_scan(c, ["legal"]))


@query("f8_drop_constant", "SELECT case_id, risk FROM cases")
def f8(spark: SparkSession, d: str) -> DataFrame:
    return quality.drop_constant(cases(spark, d).select("case_id", "risk", F.lit("x").alias("same"), F.lit(None).cast("string").alias("nothing")))


@query("f9_retention", f"SELECT case_id FROM cases WHERE dt_received >= DATE '{AS_OF}' - INTERVAL 36 MONTH")
def f9(spark: SparkSession, d: str) -> DataFrame:
    return quality.retention(cases(spark, d), "dt_received", 3, AS_OF).select("case_id")


IMPUTED = """x AS (SELECT *, CASE WHEN dt_legal_req_1 <= dt_close THEN dt_close - dt_legal_req_1 END AS delay, year(coalesce(dt_legal_req_1, dt_close)) AS y FROM cases),
g AS (SELECT *, coalesce(delay, avg(delay) OVER (PARTITION BY y)) AS d1 FROM x), m AS (SELECT avg(d1) AS m FROM g)"""


@query(
    "f10_run_checks",
    f"WITH {IMPUTED}, k AS (SELECT case_id, round(coalesce(d1, m), 6) AS delay, CASE WHEN dt_close IS NOT NULL "
    "THEN staff_id || '_' || strftime(dt_close, '%Y%m%d') ELSE case_id::VARCHAR END AS key FROM g, m) SELECT key, case_id, delay FROM (SELECT *, "
    "row_number() OVER (PARTITION BY key ORDER BY case_id) AS r FROM k) WHERE r = 1",
)
def f10(spark: SparkSession, d: str) -> DataFrame:
    c = cases(spark, d).select("case_id", "staff_id", F.col("dt_legal_req_1").cast("string").alias("a"), F.col("dt_close").cast("string").alias("b"))
    return rounded(quality.run_checks(c, "a", "b", "staff_id", "case_id").select("key", "case_id", "delay"))


@query(
    "i1_impute",
    "SELECT case_id, coalesce(dt_signoff - dt_alloc, (SELECT quantile_cont(dt_signoff - dt_alloc, 0.5) FROM cases))::DOUBLE AS days, CASE "
    "WHEN case_id % 3 = 0 THEN (SELECT risk FROM cases WHERE case_id % 3 <> 0 GROUP BY 1 ORDER BY count(*) DESC, risk LIMIT 1) "
    "ELSE risk END AS risk FROM cases",
)
def i1(spark: SparkSession, d: str) -> DataFrame:
    c = timed(spark, d).select("case_id", "days", F.when(F.col("case_id") % 3 != 0, F.col("risk")).alias("risk"))
    return privacy.impute(c, {"days": "median", "risk": "mode"})


@query("i2_impute_group_mean", f"WITH {IMPUTED} SELECT case_id, round(coalesce(d1, m), 6) AS delay FROM g, m")
def i2(spark: SparkSession, d: str) -> DataFrame:
    c = quality.compute_delay(cases(spark, d), "dt_legal_req_1", "dt_close")
    return rounded(privacy.impute_group_mean(c, "delay", F.year(F.coalesce("dt_legal_req_1", "dt_close"))).select("case_id", "delay"))


BOUNDS = "q AS (SELECT quantile_cont(l_extendedprice, 0.25) AS a, quantile_cont(l_extendedprice, 0.75) AS b FROM lineitem)"


@query(
    "i3_iqr_outliers",
    f"WITH {BOUNDS} SELECT l_orderkey, l_linenumber, l_extendedprice, round(a - 1.5 * (b - a), 4) AS low, round(b + 1.5 * (b - a), 4) AS high "
    "FROM lineitem, q WHERE l_extendedprice < a - 1.5 * (b - a) OR l_extendedprice > b + 1.5 * (b - a)",
    cases=False,
)
def i3(spark: SparkSession, d: str) -> DataFrame:
    out = privacy.iqr_outliers(table(spark, d, "lineitem"), "l_extendedprice")
    return out.select("l_orderkey", "l_linenumber", "l_extendedprice", F.round("low", 4).alias("low"), F.round("high", 4).alias("high"))


@query(
    "i4_iqr_clip",
    f"WITH {BOUNDS} SELECT l_orderkey, l_linenumber, round(least(greatest(l_extendedprice, a - 0.5 * (b - a)), b + 0.5 * (b - a)), "
    "4) AS l_extendedprice FROM lineitem, q",
    cases=False,
)
def i4(spark: SparkSession, d: str) -> DataFrame:
    return privacy.iqr_clip(table(spark, d, "lineitem"), ["l_extendedprice"], 0.5).select(
        "l_orderkey", "l_linenumber", F.round("l_extendedprice", 4).alias("l_extendedprice")
    )


@query(
    "k1_top_code",
    "SELECT l_orderkey, l_linenumber, round(least(l_quantity, (SELECT quantile_cont(l_quantity, 0.9) FROM lineitem)), 6) AS l_quantity FROM lineitem",
    cases=False,
)
def k1(spark: SparkSession, d: str) -> DataFrame:
    return rounded(privacy.top_code(table(spark, d, "lineitem"), ["l_quantity"], 0.9).select("l_orderkey", "l_linenumber", "l_quantity"))


@query(
    "k2_bin_numeric",
    "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity <= 10 THEN '(0, 10]' WHEN l_quantity <= 30 THEN '(10, 30]' WHEN l_quantity <= 50 "
    "THEN '(30, 50]' END AS l_quantity FROM lineitem",
    cases=False,
)
def k2(spark: SparkSession, d: str) -> DataFrame:
    return privacy.bin_numeric(table(spark, d, "lineitem"), {"l_quantity": [0, 10, 30, 50]}).select("l_orderkey", "l_linenumber", "l_quantity")


@query(
    "k3_collapse_rare",
    "SELECT c_custkey, CASE WHEN count(*) OVER (PARTITION BY c_nationkey) < 60 THEN 'Other' ELSE c_nationkey::VARCHAR END AS c_nationkey "
    "FROM customer",
    cases=False,
)
def k3(spark: SparkSession, d: str) -> DataFrame:
    return privacy.collapse_rare(table(spark, d, "customer"), "c_nationkey", 60).select("c_custkey", "c_nationkey")


@query(
    "k4_k_anonymise",
    "SELECT c_custkey, c_nationkey::VARCHAR AS c_nationkey, CASE WHEN count(*) OVER (PARTITION BY c_nationkey, c_mktsegment) < 12 THEN 'Other' "
    "ELSE c_mktsegment END AS c_mktsegment FROM customer",
    cases=False,
)
def k4(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").withColumn("c_nationkey", F.col("c_nationkey").cast("string"))
    return privacy.k_anonymise(c, ["c_nationkey", "c_mktsegment"], 12).select("c_custkey", "c_nationkey", "c_mktsegment")


@query("j5_rare_marks", "SELECT c_custkey, count(*) OVER (PARTITION BY c_nationkey, c_mktsegment) < 12 AS rare FROM customer", cases=False)
def j5(spark: SparkSession, d: str) -> DataFrame:
    return privacy.rare_marks(
        table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment"), ["c_nationkey", "c_mktsegment"], 12
    ).select("c_custkey", "rare")


@query(
    "k5_coarsen",
    "WITH t AS (SELECT c_custkey, least(c_acctbal, (SELECT quantile_cont(c_acctbal, 0.95) FROM customer)) AS c_acctbal, CASE "
    "WHEN count(*) OVER (PARTITION BY c_nationkey) < 60 THEN 'Other' ELSE c_nationkey::VARCHAR END AS c_nationkey, c_mktsegment FROM customer) "
    "SELECT c_custkey, round(c_acctbal, 4) AS c_acctbal, c_nationkey, CASE WHEN count(*) OVER (PARTITION BY c_nationkey, c_mktsegment) < 12 "
    "THEN 'Other' ELSE c_mktsegment END AS c_mktsegment FROM t",
    cases=False,
)
def k5(spark: SparkSession, d: str) -> DataFrame:
    out = privacy.coarsen(
        table(spark, d, "customer"), drop=["c_name"], top={"c_acctbal": 0.95}, rare={"c_nationkey": 60}, quasi=["c_nationkey", "c_mktsegment"], k=12
    )
    return out.withColumn("c_acctbal", F.round("c_acctbal", 4))


@query(
    "m23_time_folds",
    "WITH f AS (SELECT d, (ntile(5) OVER (ORDER BY d) - 1)::INT AS fold FROM (SELECT DISTINCT dt_received AS d FROM cases)) SELECT case_id, fold "
    "FROM cases JOIN f ON dt_received = d",
)
def m23(spark: SparkSession, d: str) -> DataFrame:
    return windows.time_folds(cases(spark, d), "dt_received", 5).select("case_id", "fold")
