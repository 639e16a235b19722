"""Queries of the scalar functions (P*)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as fn
from ..views import cases, table
from .registry import query

SEASON = "CASE WHEN month({0}) IN (12, 1, 2) THEN 'winter' WHEN month({0}) < 6 THEN 'spring' WHEN month({0}) < 9 THEN 'summer' WHEN {0} IS NOT NULL THEN 'autumn' END"
MESSY = {0: "'unknown'", 1: "' N/A '", 2: "'-'", 3: "''"}


@query("p1_null_tokens", "SELECT case_id, CASE WHEN case_id % 7 > 3 THEN risk END AS cleaned FROM cases")
def p1(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("case_id") % 7
    messy = F.when(k == 0, " unknown ").when(k == 1, "N/A").when(k == 2, "-").when(k == 3, "").otherwise(F.concat(F.lit("  "), "risk"))
    return cases(spark, d).select("case_id", fn.null_tokens(messy).alias("cleaned"))


@query("p2_parse_date", "SELECT case_id, CASE WHEN case_id % 7 <> 6 THEN dt_received END AS parsed FROM cases")
def p2(spark: SparkSession, d: str) -> DataFrame:
    k, r = F.col("case_id") % 7, F.col("dt_received")
    dom = F.dayofmonth(r)
    ordinal = F.concat(
        dom, F.when(dom.isin(1, 21, 31), "st").when(dom.isin(2, 22), "nd").when(dom.isin(3, 23), "rd").otherwise("th"), F.date_format(r, " MMM yyyy")
    )
    text = F.when(k == 0, F.date_format(r, "yyyy-MM-dd")).when(k == 1, F.date_format(r, "dd/MM/yyyy")).when(k == 2, ordinal).when(
        k == 3, F.datediff(r, F.lit("1899-12-30").cast("date")).cast("string")
    ).when(k == 4, F.concat(F.lit("  "), F.date_format(r, "d MMMM yyyy"))).when(k == 5, F.date_format(r, "yyyy-MM-dd HH:mm:ss")).otherwise("not complete")
    return cases(spark, d).select("case_id", fn.parse_date(text).alias("parsed"))


@query(
    "p3_hash_id", "SELECT DISTINCT staff_id, 'S_' || substr(sha256(lower(staff_id)), 1, 12) AS id, 'S' || substr(sha1(staff_id), 1, 8) AS short_id FROM cases"
)
def p3(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("staff_id")
    return cases(spark, d).select("staff_id", fn.hash_id(s).alias("id"), fn.hash_id(s, "sha1").alias("short_id")).distinct()


@query("p4_season", f"SELECT case_id, {SEASON.format('dt_alloc')} AS season FROM cases")
def p4(spark: SparkSession, d: str) -> DataFrame:
    return cases(spark, d).select("case_id", fn.season(F.col("dt_alloc")).alias("season"))


@query("p5_term_flag", "SELECT case_id, month(dt_alloc) <> 8 AS panel_term, month(dt_alloc) IN (1, 4, 7, 10) AS interval_term FROM cases")
def p5(spark: SparkSession, d: str) -> DataFrame:
    a = F.col("dt_alloc")
    return cases(spark, d).select("case_id", fn.term_flag(a).alias("panel_term"), fn.term_flag(a, (1, 4, 7, 10)).alias("interval_term"))


@query("p6_application_type", "SELECT case_id, CASE WHEN case_id % 3 = 2 THEN NULL ELSE (case_id % 3)::INT END AS application_type FROM cases")
def p6(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("case_id")
    text = F.when(
        k % 3 == 0, F.concat(F.lit("LPA 7001-"), F.lpad((k % 10000).cast("string"), 4, "0"), F.lit(" 3350"))
    ).when(k % 3 == 1, k.cast("string")).otherwise("  ")
    return cases(spark, d).select("case_id", fn.application_type(text).alias("application_type"))


@query(
    "p8_basic_clean",
    "SELECT case_id, CASE WHEN case_id % 4 = 0 THEN 'Unknown' ELSE risk END AS risk, case_id % 2 = 1 AS reallocation, least(weighting * 1.5, "
    "5.0) AS weighting FROM cases",
)
def p8(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.quality import basic_clean

    c = cases(spark, d).select(
        "case_id",
        F.when(F.col("case_id") % 4 == 0, " n/a ").otherwise(F.col("risk")).alias("risk"),
        F.when(F.col("case_id") % 2 == 1, " Yes").otherwise("no").alias("reallocation"),
        (F.col("weighting") * 1.5).cast("string").alias("weighting"),
    )
    return basic_clean(c, ["risk"], "reallocation", "weighting")


@query(
    "p9_engineer_intervals",
    "SELECT case_id, dt_alloc - dt_received AS days_to_alloc, dt_signoff - dt_alloc AS days_to_signoff, "
    "(dt_signoff IS NOT NULL)::INT AS event_signoff, (status IN ('O', 'P'))::INT AS in_backlog, "
    "(dt_legal_req_1 IS NOT NULL OR dt_legal_approval IS NOT NULL)::INT AS needs_legal FROM cases",
)
def p9(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.quality import engineer_intervals

    return engineer_intervals(cases(spark, d), ["O", "P"])


@query(
    "p10_derive_durations",
    "SELECT case_id, CASE WHEN dt_legal_req_1 - dt_received >= 0 THEN dt_legal_req_1 - dt_received END AS d_legal, CASE "
    "WHEN dt_close - dt_alloc >= 0 THEN dt_close - dt_alloc END AS d_close, (dt_legal_req_1 IS NOT NULL)::INT AS e_legal, "
    "(dt_close IS NOT NULL)::INT AS e_close FROM cases",
)
def p10(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.quality import derive_durations

    return derive_durations(
        cases(spark, d), {"legal": ("dt_received", "dt_legal_req_1"), "close": ("dt_alloc", "dt_close")}
    ).select("case_id", "d_legal", "d_close", "e_legal", "e_close")


@query(
    "p11_time_interval",
    "SELECT event_id, floor(epoch(TIMESTAMP '2024-03-01' - ts) / 86400) AS days, "
    "round((epoch_us(TIMESTAMP '2024-03-01') - epoch_us(ts)) / 3600e6, 6) AS hours FROM events",
    cases=False,
)
def p11(spark: SparkSession, d: str) -> DataFrame:
    to = F.lit("2024-03-01").cast("timestamp")
    return table(spark, d, "events").select(
        "event_id", fn.time_interval(F.col("ts"), to).alias("days"), F.round(fn.time_interval(F.col("ts"), to, "hours"), 6).alias("hours")
    )


@query(
    "p12_calendar",
    "SELECT DISTINCT dt_received AS d, year(dt_received)::INT AS year, month(dt_received)::INT AS month, (isodow(dt_received) - 1)::INT AS dow, "
    "week(dt_received)::INT AS week, (day(dt_received) = 1)::INT AS is_month_start, (dt_received = last_day(dt_received))::INT AS is_month_end "
    "FROM cases",
)
def p12(spark: SparkSession, d: str) -> DataFrame:
    return fn.calendar(cases(spark, d).select(F.col("dt_received").alias("d")).distinct(), "d")


@query(
    "p13_fourier",
    "SELECT DISTINCT dt_received AS d, round(sin(2 * pi() * dayofyear(dt_received) / 365.25), 6) AS sin_year, round(cos(2 * pi() * dayofyear(dt_received) / 365.25), 6) AS cos_year, " + ", ".join(
        f"(isodow(dt_received) = {k + 1})::INT AS dow_{k}"
        for k in range(1, 7)
    ) + " FROM cases",
)
def p13(spark: SparkSession, d: str) -> DataFrame:
    return fn.fourier(cases(spark, d).select(F.col("dt_received").alias("d")).distinct(), "d").withColumns({c: F.round(c, 6) for c in ("sin_year", "cos_year")})


@query(
    "p14_fte_band",
    "SELECT case_id, CASE WHEN fte >= 0.8 THEN 'FT_0_8_to_1_0' WHEN fte >= 0.5 THEN 'PT_0_5_to_0_8' WHEN fte > 0 THEN 'PT_lt_0_5' "
    "ELSE 'Unknown_FTE' END AS fte_band FROM cases",
)
def p14(spark: SparkSession, d: str) -> DataFrame:
    return cases(spark, d).select("case_id", fn.fte_band(F.col("fte")).alias("fte_band"))


@query(
    "p15_band",
    "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity < 10 THEN 'Low' WHEN l_quantity < 25 THEN 'Medium' ELSE 'High' END AS left_band, CASE "
    "WHEN l_quantity <= 10 THEN 'Low' WHEN l_quantity <= 25 THEN 'Medium' ELSE 'High' END AS right_band FROM lineitem",
    cases=False,
)
def p15(spark: SparkSession, d: str) -> DataFrame:
    e, names, q = (float("-inf"), 10, 25, float("inf")), ("Low", "Medium", "High"), F.col("l_quantity")
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", fn.band(q, e, names).alias("left_band"), fn.band(q, e, names, right=True).alias("right_band")
    )


@query(
    "p16_age_years",
    "SELECT case_id, round((dt_received - DATE '1950-06-15') / 365.25, 6) AS age, greatest(round((dt_received - DATE '1950-06-15') / 365.25), "
    "0)::INT AS age_whole FROM cases",
)
def p16(spark: SparkSession, d: str) -> DataFrame:
    dob = F.lit("1950-06-15").cast("date")
    return cases(spark, d).select(
        "case_id", F.round(fn.age_years(dob, F.col("dt_received")), 6).alias("age"), fn.age_years(dob, F.col("dt_received"), whole=True).alias("age_whole")
    )


@query("p17_compute_delay", "SELECT case_id, dt_close - dt_legal_req_1 AS delay FROM cases WHERE dt_close >= dt_legal_req_1")
def p17(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.quality import compute_delay

    return compute_delay(cases(spark, d), "dt_legal_req_1", "dt_close", drop=True).select("case_id", "delay")


@query(
    "p18_derive_key",
    "SELECT case_id, CASE WHEN dt_alloc IS NOT NULL THEN case_id || '_' || strftime(dt_alloc, '%Y%m%d') ELSE 'u' || case_id END AS key FROM cases",
)
def p18(spark: SparkSession, d: str) -> DataFrame:
    return cases(spark, d).select("case_id", fn.derived_key(F.col("case_id"), F.col("dt_alloc"), F.concat(F.lit("u"), "case_id")).alias("key"))


@query(
    "p19_month_spine",
    "SELECT m.month, last_day(m.month)::DATE AS month_end, count(case_id) AS n FROM (SELECT unnest(generate_series(DATE '1995-01-01', "
    "DATE '2001-12-01', INTERVAL 1 MONTH))::DATE AS month) m LEFT JOIN cases ON date_trunc('month', dt_received) = m.month GROUP BY ALL",
)
def p19(spark: SparkSession, d: str) -> DataFrame:
    per = cases(spark, d).groupBy(F.trunc("dt_received", "month").alias("month")).agg(F.count("*").alias("n"))
    return fn.month_spine(spark, "'1995-01'", "2001-12").join(per, "month", "left").fillna({"n": 0})


@query(
    "p20_text_flags",
    "SELECT doc_id, regexp_matches(lower(text), '\\blegal\\b|solicitor|attorney|advice') AS event_legal, regexp_matches(lower(text), "
    "'\\bcourt\\b|hearing|tribunal') AS event_court, regexp_matches(lower(text), '\\bflag|priority|escalat') AS event_flagged FROM documents",
    cases=False,
)
def p20(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", *(c.alias(n) for n, c in fn.text_flags(F.col("text")).items()))


@query("p21_bank_holiday", "SELECT case_id, dt_received IN (DATE '1998-12-25', DATE '1999-01-01', DATE '2000-12-25') AS bank_holiday FROM cases")
def p21(spark: SparkSession, d: str) -> DataFrame:
    return cases(spark, d).select("case_id", fn.bank_holiday(F.col("dt_received"), ["1998-12-25", "1999-01-01", "2000-12-25"]).alias("bank_holiday"))


@query(
    "p22_ratio_feature",
    "SELECT l_orderkey, l_linenumber, round(l_extendedprice / pow(l_quantity, 2), 6) AS ratio FROM lineitem WHERE l_quantity <> 0",
    cases=False,
)
def p22(spark: SparkSession, d: str) -> DataFrame:
    return fn.ratio_feature(
        table(spark, d, "lineitem"), "l_extendedprice", "l_quantity", 2.0, "ratio"
    ).select("l_orderkey", "l_linenumber", F.round("ratio", 6).alias("ratio"))


@query(
    "p23_coalesce_status",
    "SELECT case_id, CASE WHEN case_id % 97 = 0 THEN 'Manual Override' WHEN dt_close IS NOT NULL THEN 'Case Closed' WHEN dt_signoff IS NOT NULL "
    "THEN 'Signed Off' ELSE 'Open' END AS outcome FROM cases",
)
def p23(spark: SparkSession, d: str) -> DataFrame:
    c = cases(spark, d)
    manual = c.where(F.col("case_id") % 97 == 0).select("case_id", F.lit("Manual Override").alias("manual"))
    outcome = fn.coalesce_status([(F.col("dt_close").isNotNull(), "case closed"), (F.col("dt_signoff").isNotNull(), "signed off")], "Open")
    return c.join(manual, "case_id", "left").select("case_id", F.coalesce("manual", outcome).alias("outcome"))
