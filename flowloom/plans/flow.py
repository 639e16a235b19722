"""Queries of the case-flow tables (T*, J6, S9, O2, O3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import flow as op
from ..views import AS_OF, cases, table
from .registry import query

HORIZON = "h AS (SELECT min(dt_received) AS s, max(dt_signoff) AS e FROM cases), spine AS (SELECT unnest(generate_series(s, e, INTERVAL 1 DAY))::DATE AS date FROM h)"
WIP = """k AS (SELECT DISTINCT staff_id, team FROM cases, h WHERE dt_alloc <= e AND coalesce(dt_close, dt_signoff, e) >= s),
x AS (SELECT staff_id, team, greatest(dt_alloc, s) AS date, 1 AS d FROM cases, h WHERE dt_alloc <= e AND coalesce(dt_close, dt_signoff, e) >= s
  UNION ALL SELECT staff_id, team, least(coalesce(dt_close, dt_signoff, e), e) + 1, -1 FROM cases, h WHERE dt_alloc <= e AND coalesce(dt_close, dt_signoff, e) >= s),
p AS (SELECT staff_id, team, date, sum(d) AS d FROM x GROUP BY ALL),
wip AS (SELECT k.staff_id, k.team, spine.date, CAST(coalesce(sum(p.d) OVER (PARTITION BY k.staff_id, k.team ORDER BY spine.date), 0) AS BIGINT) AS wip
  FROM k CROSS JOIN spine LEFT JOIN p ON p.staff_id = k.staff_id AND p.team = k.team AND p.date = spine.date)"""
BACKLOG = """bl AS (SELECT spine.date, CAST(coalesce(sum(d) OVER (ORDER BY spine.date), 0) AS BIGINT) AS backlog_available FROM spine LEFT JOIN (
  SELECT date, sum(d) AS d FROM (SELECT dt_received AS date, 1 AS d FROM cases UNION ALL SELECT dt_alloc, -1 FROM cases) WHERE date IS NOT NULL GROUP BY date) q ON q.date = spine.date)"""
EVENTS = """ev AS (SELECT dt_alloc AS date, staff_id, team, fte, case_id, 'newcase' AS event, '' AS meta FROM cases WHERE dt_alloc IS NOT NULL
  UNION ALL SELECT dt_legal_req_1, staff_id, team, fte, case_id, 'legal_request', '' FROM cases WHERE dt_legal_req_1 IS NOT NULL
  UNION ALL SELECT dt_legal_approval, staff_id, team, fte, case_id, 'legal_approval', '' FROM cases WHERE dt_legal_approval IS NOT NULL
  UNION ALL SELECT dt_date_of_order, staff_id, team, fte, case_id, 'court_order', '' FROM cases WHERE dt_date_of_order IS NOT NULL)"""
PANEL = f"""{HORIZON}, {WIP}, {BACKLOG}, {EVENTS},
st AS (SELECT DISTINCT staff_id, team, '' AS role, fte FROM cases),
fl AS (SELECT staff_id, date, max((event = 'newcase')::INT) AS nc, max((event LIKE 'legal%')::INT) AS lg, max((event = 'court_order')::INT) AS co FROM ev GROUP BY ALL),
fa AS (SELECT staff_id, min(dt_alloc) AS fa FROM cases GROUP BY 1),
g AS (SELECT spine.date, st.*, coalesce(wip, 0) AS wip, coalesce(nc, 0) AS nc, coalesce(lg, 0) AS lg, coalesce(co, 0) AS co,
    greatest(coalesce(floor((spine.date - fa) / 7), 0), 0)::INT AS weeks, backlog_available
  FROM st CROSS JOIN spine LEFT JOIN wip USING (staff_id, team, date) LEFT JOIN fl USING (staff_id, date) LEFT JOIN fa USING (staff_id) LEFT JOIN bl USING (date)),
r AS (SELECT *, sum(nc) OVER (PARTITION BY staff_id ORDER BY date, team, role, fte ROWS UNBOUNDED PRECEDING) AS run, sum(nc) OVER (PARTITION BY staff_id) AS alln FROM g),
panel AS (SELECT date, staff_id, team, role, fte, (weeks < 4)::INT AS is_new_starter, weeks AS weeks_since_start, wip,
  CASE WHEN alln = 0 THEN 99 ELSE row_number() OVER (PARTITION BY staff_id, run ORDER BY date, team, role, fte) - 1 END::INT AS time_since_last_pickup,
  0 AS mentoring_flag, 0 AS trainee_flag, backlog_available, (month(date) <> 8)::INT AS term_flag,
  CASE WHEN month(date) IN (12, 1, 2) THEN 'winter' WHEN month(date) < 6 THEN 'spring' WHEN month(date) < 9 THEN 'summer' ELSE 'autumn' END AS season,
  strftime(date, '%a') AS dow, 0 AS bank_holiday, nc AS event_newcase, lg AS event_legal, co AS event_court FROM r)"""
SNAPS = """months AS (SELECT last_day(m)::DATE AS month_end FROM (SELECT unnest(generate_series(date_trunc('month', min(dt_received)), date_trunc('month', max(dt_received)), INTERVAL 1 MONTH))::DATE AS m FROM cases)),
snaps AS (SELECT month_end, case_id, CAST(20 + case_id % 60 AS INT) AS age_years FROM cases JOIN months ON dt_received <= month_end AND (dt_close IS NULL OR dt_close > month_end))"""


def flow_sql(months: int, by: str = "") -> str:
    b = f", {by}" if by else ""
    return f"""f AS (SELECT m AS month_end{b}, count(nw) AS active, count(*) FILTER (WHERE th IS NULL) AS entered, count(*) FILTER (WHERE nw IS NULL) AS exited FROM (
  SELECT coalesce(a.m, b.m) AS m, coalesce(a.case_id, b.case_id) AS case_id{f', coalesce(a.{by}, b.{by}) AS {by}' if by else ''}, a.nw, b.th
  FROM (SELECT month_end AS m, case_id{b}, 1 AS nw FROM snaps) a FULL JOIN (SELECT last_day(month_end + INTERVAL {months} MONTH)::DATE AS m, case_id{b}, 1 AS th FROM snaps) b
  ON a.m = b.m AND a.case_id = b.case_id{f' AND a.{by} = b.{by}' if by else ''}) WHERE m BETWEEN (SELECT min(month_end) FROM snaps) AND (SELECT max(month_end) FROM snaps) GROUP BY ALL)"""


def horizon(df: DataFrame) -> DataFrame:
    return op.date_horizon(df)


def months(df: DataFrame) -> DataFrame:
    m = df.agg(F.min("dt_received").alias("a"), F.max("dt_received").alias("b"))
    return m.select(
        F.explode(F.sequence(F.trunc("a", "month"), F.trunc("b", "month"), F.expr("INTERVAL 1 MONTH"))).alias("m")
    ).select(F.last_day("m").alias("month_end"))


def aged(df: DataFrame) -> DataFrame:
    return df.withColumn("age_years", (20 + F.col("case_id") % 60).cast("int"))


def snapshots(df: DataFrame) -> DataFrame:
    return op.month_end_snapshots(aged(df), months(df), ["age_years"])


def flows(spark: SparkSession, d: str, back: int = 1, by: tuple[str, ...] = ()) -> DataFrame:
    c = cases(spark, d)
    return op.case_flow(aged(c), months(c), back, by)


@query("t1_date_horizon", "SELECT min(dt_received) AS start, max(dt_signoff) + 3 AS \"end\" FROM cases")
def t1(spark: SparkSession, d: str) -> DataFrame:
    return op.date_horizon(cases(spark, d), pad=3, as_of=AS_OF)


@query("t2_event_log", f"WITH {EVENTS} SELECT * FROM ev")
def t2(spark: SparkSession, d: str) -> DataFrame:
    return op.event_log(cases(spark, d))


@query("t3_wip_series", f"WITH {HORIZON}, {WIP} SELECT * FROM wip")
def t3(spark: SparkSession, d: str) -> DataFrame:
    c = cases(spark, d)
    return op.wip_series(c, horizon(c))


@query("t4_backlog_series", f"WITH {HORIZON}, {BACKLOG} SELECT * FROM bl")
def t4(spark: SparkSession, d: str) -> DataFrame:
    c = cases(spark, d)
    return op.backlog_series(c, horizon(c))


@query("t5_daily_panel", f"WITH {PANEL} SELECT * FROM panel")
def t5(spark: SparkSession, d: str) -> DataFrame:
    c = cases(spark, d)
    return op.daily_panel(c, horizon(c))


@query(
    "t6_interval_frame",
    """WITH b AS (SELECT *, coalesce(dt_alloc, dt_received) AS date FROM cases),
n AS (SELECT d.date, count(*) AS active FROM (SELECT DISTINCT date FROM b) d JOIN cases ON dt_received <= d.date AND (dt_close IS NULL OR dt_close > d.date) GROUP BY 1),
w AS (SELECT *, coalesce(date >= dt_alloc AND (dt_close IS NULL OR date < dt_close), false) AS wip FROM b)
SELECT w.date, staff_id, team, case_id, case_type, NULL::VARCHAR AS concern_type, status, dt_alloc AS dt_alloc_invest, dt_signoff AS dt_pg_signoff, dt_received AS dt_received_inv,
  NULL::DATE AS dt_alloc_team, dt_close, NULL::DATE AS dt_sent_to_ca, dt_legal_req_1, (dt_signoff - dt_alloc)::DOUBLE AS days_to_pg_signoff, (dt_alloc - dt_received)::DOUBLE AS days_to_alloc,
  (dt_legal_req_1 - dt_received)::DOUBLE AS days_received_to_legal_review, (dt_legal_req_1 - dt_alloc)::DOUBLE AS days_alloc_to_req_legal_review, fte, weighting, wip,
  round(fte * weighting * wip::INT, 6) AS wip_load,
  (dt_alloc - lag(dt_alloc) OVER (PARTITION BY staff_id ORDER BY dt_alloc NULLS LAST, case_id))::DOUBLE AS time_since_last_pickup,
  round((w.date - min(w.date) OVER ()) / 7, 6) AS weeks_since_start, coalesce((w.date - min(dt_alloc) OVER (PARTITION BY staff_id)) / 7 <= 12, false) AS is_new_starter,
  coalesce(w.date >= dt_received AND (dt_close IS NULL OR w.date < dt_close), false) AS backlog_available, month(w.date) IN (1, 4, 7, 10) AS term_flag,
  CASE WHEN month(w.date) IN (12, 1, 2) THEN 'winter' WHEN month(w.date) < 6 THEN 'spring' WHEN month(w.date) < 9 THEN 'summer' ELSE 'autumn' END AS season,
  strftime(w.date, '%A') AS dow, w.date = DATE '1998-12-25' AS bank_holiday, coalesce(w.date = dt_legal_req_1, false) AS event_req_legal_review, w.date = dt_received AS event_newcase,
  regexp_matches(lower(concat_ws(' ', status, '', case_type)), '\\blegal\\b|solicitor|attorney|advice') AS event_legal, regexp_matches(lower(concat_ws(' ', status, '', case_type)), '\\bcourt\\b|hearing|tribunal') AS event_court,
  regexp_matches(lower(concat_ws(' ', status, '', case_type)), '\\bflag|priority|escalat') AS event_flagged, coalesce(w.date = dt_signoff, false) AS event_pg_signoff,
  needs_legal_review AS legal_review, needs_legal_review::VARCHAR AS legal_review_cat, coalesce(active, 0)::DOUBLE AS backlog
FROM w LEFT JOIN n ON n.date = w.date""",
)
def t6(spark: SparkSession, d: str) -> DataFrame:
    frame = op.interval_frame(cases(spark, d).withColumn("legal_review", F.col("needs_legal_review")), holidays=["1998-12-25"])
    return frame.withColumns({"wip_load": F.round("wip_load", 6), "weeks_since_start": F.round("weeks_since_start", 6)})


@query(
    "t7_open_backlog",
    f"""WITH s AS (SELECT unnest(generate_series(min(dt_received), greatest(max(dt_alloc), DATE '{AS_OF}'), INTERVAL 1 DAY))::DATE AS date FROM cases),
x AS (SELECT date, sum(d) AS d FROM (SELECT dt_received AS date, 1 AS d FROM cases WHERE coalesce(dt_alloc, DATE '{AS_OF}') >= dt_received UNION ALL SELECT coalesce(dt_alloc, DATE '{AS_OF}') + 1, -1 FROM cases WHERE coalesce(dt_alloc, DATE '{AS_OF}') >= dt_received) GROUP BY 1)
SELECT * FROM (SELECT s.date, CAST(coalesce(sum(d) OVER (ORDER BY s.date), 0) AS BIGINT) AS backlog FROM s LEFT JOIN x ON x.date = s.date) WHERE backlog >= 1""",
)
def t7(spark: SparkSession, d: str) -> DataFrame:
    return op.open_backlog(cases(spark, d), AS_OF)


@query(
    "t8_panel_summary",
    f"""WITH {PANEL} SELECT staff_id, season, count(*) AS days, round(avg(wip), 6) AS mean_wip, max(wip) AS max_wip, round(avg(backlog_available), 6) AS mean_backlog,
  sum(event_newcase)::BIGINT AS n_newcase, sum(event_legal)::BIGINT AS n_legal, sum(event_court)::BIGINT AS n_court FROM panel GROUP BY ALL""",
)
def t8(spark: SparkSession, d: str) -> DataFrame:
    c = cases(spark, d)
    return op.panel_summary(op.daily_panel(c, horizon(c)), ["staff_id", "season"]).withColumns(
        {"mean_wip": F.round("mean_wip", 6), "mean_backlog": F.round("mean_backlog", 6)}
    )


@query("j6_active_at", f"WITH {SNAPS} SELECT month_end AS date, count(*) AS active FROM snaps GROUP BY 1")
def j6(spark: SparkSession, d: str) -> DataFrame:
    c = cases(spark, d)
    return op.active_at(c, months(c).select(F.col("month_end").alias("date")))


@query("s9_month_end_snapshots", f"WITH {SNAPS} SELECT * FROM snaps")
def s9(spark: SparkSession, d: str) -> DataFrame:
    return snapshots(cases(spark, d))


@query("o2_monthly_flow", f"WITH {SNAPS}, {flow_sql(1)} SELECT * FROM f")
def o2(spark: SparkSession, d: str) -> DataFrame:
    return flows(spark, d)


@query("o3_yoy_flow", f"WITH {SNAPS}, {flow_sql(12)} SELECT * FROM f")
def o3(spark: SparkSession, d: str) -> DataFrame:
    return flows(spark, d, 12)


@query(
    "t9_age_rates",
    f"WITH {SNAPS}, {flow_sql(1, 'age_years')} SELECT *, round(exited / nullif(active, 0), 6) AS termination_rate, "
    "round(1 - exited / nullif(active, 0), 6) AS retention_rate FROM f",
)
def t9(spark: SparkSession, d: str) -> DataFrame:
    r = op.age_rates(flows(spark, d, 1, ("age_years",)))
    return r.withColumns({c: F.round(c, 6) for c in ("termination_rate", "retention_rate")})


@query(
    "t10_redistribute_unknown",
    """WITH a AS (SELECT team, CASE WHEN case_id % 11 = 0 THEN NULL ELSE CAST(20 + case_id % 60 AS INT) END AS age, count(*) AS n FROM cases GROUP BY ALL),
l AS (SELECT team, sum(n) AS lost FROM a WHERE age IS NULL GROUP BY 1),
q AS (SELECT a.team, age, n, coalesce(lost, 0) AS lost, n * coalesce(lost, 0) / sum(n) OVER (PARTITION BY a.team) AS quota FROM a LEFT JOIN l USING (team) WHERE age IS NOT NULL),
r AS (SELECT *, floor(quota) AS base, row_number() OVER (PARTITION BY team ORDER BY round(quota - floor(quota), 9) DESC, age) AS rk FROM q)
SELECT team, age, CAST(n + base + (rk <= lost - sum(base) OVER (PARTITION BY team))::INT AS BIGINT) AS n FROM r""",
)
def t10(spark: SparkSession, d: str) -> DataFrame:
    a = cases(spark, d).withColumn(
        "age", F.when(F.col("case_id") % 11 != 0, (20 + F.col("case_id") % 60).cast("int"))
    ).groupBy("team", "age").agg(F.count("*").alias("n"))
    return op.redistribute_unknown(a, ["team"], "age", "n")


def forecast(spark: SparkSession, d: str, scale: float = 1.0) -> DataFrame:
    r = flows(spark, d, 1, ("age_years",))
    return op.stop_flow(op.flow_scenario(r, scale) if scale != 1 else r, 12)


def forecast_sql(scale: float = 1.0) -> str:
    e = f"CAST(round(entered * {scale}) AS BIGINT)" if scale != 1 else "entered"
    return f"""{SNAPS}, {flow_sql(1, 'age_years')}, mx AS (SELECT max(month_end) AS last FROM f),
ages AS (SELECT DISTINCT age_years FROM f),
st AS (SELECT age_years, last, coalesce((SELECT active FROM f WHERE f.age_years = ages.age_years AND month_end = last), 0) AS v FROM ages, mx),
fc AS (WITH RECURSIVE r AS (SELECT age_years, last, 0 AS p, v FROM st UNION ALL
  SELECT r.age_years, r.last, p + 1, greatest(v + coalesce(g.net, 0), 0) FROM r LEFT JOIN (SELECT month_end, age_years, {e} - exited AS net FROM f) g
    ON g.age_years = r.age_years AND g.month_end = last_day(r.last + to_months(CAST(p % 12 - 11 AS INT)))::DATE WHERE p < 12)
  SELECT last_day(last + to_months(CAST(p AS INT)))::DATE AS month_end, age_years, CAST(v AS BIGINT) AS forecast FROM r WHERE p > 0)"""


@query("t11_stop_flow", f"WITH {forecast_sql()} SELECT * FROM fc")
def t11(spark: SparkSession, d: str) -> DataFrame:
    return forecast(spark, d)


@query(
    "t12_count_band",
    f"WITH {SNAPS}, {flow_sql(1)} SELECT *, round(greatest(active - 1.96 * sqrt(1.5 * active), 0), 6) AS low, "
    "round(active + 1.96 * sqrt(1.5 * active), 6) AS high FROM f",
)
def t12(spark: SparkSession, d: str) -> DataFrame:
    b = op.count_band(flows(spark, d), "active", 1.5)
    return b.withColumns({c: F.round(c, 6) for c in ("low", "high")})


@query("t13_flow_scenario", f"WITH {forecast_sql(0.8)} SELECT month_end, CAST(sum(forecast) AS BIGINT) AS total FROM fc GROUP BY 1")
def t13(spark: SparkSession, d: str) -> DataFrame:
    return forecast(spark, d, 0.8).groupBy("month_end").agg(F.sum("forecast").alias("total"))


@query(
    "t14_receipts_ratio",
    """SELECT coalesce(a.year, b.year)::INT AS year, coalesce(receipts, 0) AS receipts, coalesce(demand, 0) AS demand, round(receipts / nullif(demand, 0), 6) AS ratio
FROM (SELECT year(dt_received) AS year, count(*) AS receipts FROM cases GROUP BY 1) a FULL JOIN (SELECT year(dt_close) AS year, count(*) AS demand FROM cases WHERE dt_close IS NOT NULL GROUP BY 1) b ON a.year = b.year""",
)
def t14_ratio(spark: SparkSession, d: str) -> DataFrame:
    c = cases(spark, d)
    return op.receipts_ratio(c, "dt_received", c, "dt_close").withColumn("ratio", F.round("ratio", 6))


@query(
    "t14_age_demand",
    """WITH y AS (SELECT 365 * (min(n) + max(n)) / 2.0::DOUBLE AS year FROM (SELECT count(*) AS n FROM cases GROUP BY dt_received)),
a AS (SELECT (20 + case_id % 60)::INT AS age, count(*)::DOUBLE AS n FROM cases GROUP BY 1)
SELECT age, round(n / sum(n) OVER (), 8) AS share, round(n / sum(n) OVER () * year, 6) AS expected FROM a, y""",
)
def t14(spark: SparkSession, d: str) -> DataFrame:
    c = cases(spark, d).withColumn("age", (20 + F.col("case_id") % 60).cast("int"))
    return op.age_demand(c, c, "dt_received", "age").select("age", F.round("share", 8).alias("share"), F.round("expected", 6).alias("expected"))


@query(
    "t15_flow_insights",
    f"""WITH {forecast_sql()}, tot AS (SELECT month_end, sum(forecast) AS n FROM fc GROUP BY 1),
mv AS (SELECT age_years, max_by(forecast, month_end) - min_by(forecast, month_end) AS v FROM fc GROUP BY 1 ORDER BY abs(v) DESC, age_years LIMIT 3)
SELECT 'horizon_change' AS measure, 'all' AS label, CAST(max_by(n, month_end) - min_by(n, month_end) AS BIGINT) AS value FROM tot
UNION ALL SELECT * FROM (SELECT 'peak', month_end::VARCHAR, CAST(n AS BIGINT) FROM tot ORDER BY n DESC, month_end LIMIT 1) UNION ALL SELECT 'mover', age_years::VARCHAR, v FROM mv""",
)
def t15(spark: SparkSession, d: str) -> DataFrame:
    return op.flow_insights(forecast(spark, d))
