"""Case-flow tables: events, work in progress, backlog, panels, snapshots and stock-flow forecasts.

Day-grained counts come from line sweeps: each case adds one at its start and takes one off after its
end, so the work is linear in cases and the running sums are over days, not over cases.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import days, season, term_flag, text_flags

EVENTS = {
    "dt_alloc": "newcase",
    "dt_legal_req_1": "legal_request",
    "dt_legal_req_2": "legal_request",
    "dt_legal_req_3": "legal_request",
    "dt_legal_approval": "legal_approval",
    "dt_date_of_order": "court_order",
}


def date_horizon(df: DataFrame, pad: int = 0, as_of: str | None = None) -> DataFrame:
    """One row (start, end): first receipt to last sign-off plus pad; else the span of all dates; else thirty days to as_of."""
    dates = [c for c in df.columns if c.startswith("dt_")]
    low, high = (F.coalesce(*(f(c) for c in dates)) if len(dates) == 1 else g(*(f(c) for c in dates)) for f, g in ((F.min, F.least), (F.max, F.greatest)))
    day = F.lit(as_of).cast("date")
    return df.agg(
        F.coalesce(F.min("dt_received"), low, F.date_sub(day, 30)).alias("start"), F.date_add(F.coalesce(F.max("dt_signoff"), high, day), pad).alias("end")
    )


def day_spine(horizon: DataFrame) -> DataFrame:
    """One row for each day of the horizon (a row of start and end)."""
    return horizon.select(F.explode(F.sequence("start", "end")).alias("date"))


def event_log(df: DataFrame) -> DataFrame:
    """date, staff_id, team, fte, case_id, event, meta: one row for each dated event of a case."""
    each = F.array(*(F.struct(F.col(c).alias("date"), F.lit(e).alias("event")) for c, e in EVENTS.items() if c in df.columns))
    return df.select("staff_id", "team", "fte", "case_id", F.explode(each).alias("e")).where("e.date IS NOT NULL").select(
        "e.date", "staff_id", "team", "fte", "case_id", "e.event", F.lit("").alias("meta")
    )


def _swept(deltas: DataFrame, spine: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Running sum of d by day for each key."""
    per_day = deltas.groupBy(*keys, "date").agg(F.sum("d").alias("d"))
    grid = per_day.select(*keys).distinct().crossJoin(F.broadcast(spine)) if keys else spine
    w = Window.partitionBy(*keys).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return grid.join(per_day, [*keys, "date"], "left").select(*keys, "date", F.coalesce(F.sum("d").over(w), F.lit(0)).cast("bigint").alias(name))


def _ends(start: Column, after: Column) -> Column:
    return F.explode(F.array(F.struct(start.alias("date"), F.lit(1).alias("d")), F.struct(after.alias("date"), F.lit(-1).alias("d"))))


def wip_series(df: DataFrame, horizon: DataFrame, drop_reversed: bool = False) -> DataFrame:
    """staff_id, team, date, wip: open cases on each day, from allocation to close (else sign-off, else the horizon's end), both included."""
    h = F.broadcast(horizon.select(F.col("start").alias("h0"), F.col("end").alias("h1")))
    end = F.coalesce("dt_close", "dt_signoff", "h1")
    rows = df.where(
        "staff_id IS NOT NULL AND team IS NOT NULL AND dt_alloc IS NOT NULL"
    ).crossJoin(h).where((F.col("dt_alloc") <= F.col("h1")) & (end >= F.col("h0")))
    if drop_reversed:
        rows = rows.where(end >= F.col("dt_alloc"))
    swept = rows.select(
        "staff_id", "team", _ends(F.greatest("dt_alloc", "h0"), F.date_add(F.least(end, F.col("h1")), 1)).alias("e")
    ).select("staff_id", "team", "e.date", "e.d")
    return _swept(swept, day_spine(horizon), ["staff_id", "team"], "wip")


def backlog_series(df: DataFrame, horizon: DataFrame) -> DataFrame:
    """date, backlog_available: received so far less allocated so far; only dates inside the horizon count."""
    each = F.explode(
        F.array(F.struct(F.col("dt_received").alias("date"), F.lit(1).alias("d")), F.struct(F.col("dt_alloc").alias("date"), F.lit(-1).alias("d")))
    )
    # counts by day first: the running sum is over one row a day
    return _swept(df.select(each.alias("e")).select("e.date", "e.d").where("date IS NOT NULL"), day_spine(horizon), [], "backlog_available")


def open_backlog(df: DataFrame, as_of: str) -> DataFrame:
    """date, backlog: cases waiting on each day from receipt to allocation (as_of if open), both included; days with one or more."""
    end = F.coalesce(F.col("dt_alloc"), F.lit(as_of).cast("date"))
    rows = df.where(F.col("dt_received").isNotNull() & (end >= F.col("dt_received")))
    deltas = rows.select(_ends(F.col("dt_received"), F.date_add(end, 1)).alias("e")).select("e.date", "e.d")
    spine = day_spine(rows.agg(F.min("dt_received").alias("start"), F.max(end).alias("end")).where("start IS NOT NULL"))
    return _swept(deltas, spine, [], "backlog").where("backlog >= 1")


def daily_panel(df: DataFrame, horizon: DataFrame, none_gap: int = 99) -> DataFrame:
    """One row for each staff member and day, 19 columns. Staff are few; days are broadcast."""
    df = df if "role" in df.columns else df.withColumn("role", F.lit(""))
    staff = df.where("staff_id IS NOT NULL").select("staff_id", "team", "role", "fte").distinct()
    grid = staff.crossJoin(F.broadcast(day_spine(horizon)))
    flags = event_log(df).groupBy("staff_id", "date").pivot("event", ["newcase", "legal_request", "legal_approval", "court_order"]).agg(F.lit(1))
    first = df.groupBy("staff_id").agg(F.min("dt_alloc").alias("first_alloc"))
    grid = grid.join(
        wip_series(df, horizon), ["staff_id", "team", "date"], "left"
    ).join(flags, ["staff_id", "date"], "left").join(first, "staff_id", "left").join(F.broadcast(backlog_series(df, horizon)), "date", "left")
    flag = lambda c: F.coalesce(c, F.lit(0))
    order = Window.partitionBy("staff_id").orderBy("date", "team", "role", "fte")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    grid = grid.withColumn("newcase", flag("newcase")).withColumn("run", F.sum("newcase").over(so_far))
    gap = F.row_number().over(Window.partitionBy("staff_id", "run").orderBy("date", "team", "role", "fte")) - 1
    weeks = F.greatest(F.coalesce(F.floor(F.datediff("date", "first_alloc") / 7), F.lit(0)), F.lit(0)).cast("int")
    return grid.select(
        "date", "staff_id", "team", "role", "fte",
        (weeks < 4).cast("int").alias("is_new_starter"), weeks.alias("weeks_since_start"),
        F.coalesce("wip", F.lit(0)).alias("wip"),
        F.when(F.sum("newcase").over(Window.partitionBy("staff_id")) == 0, none_gap).otherwise(gap).cast("int").alias("time_since_last_pickup"),
        F.lit(0).alias("mentoring_flag"), F.lit(0).alias("trainee_flag"),
        F.coalesce("backlog_available", F.lit(0)).alias("backlog_available"),
        term_flag(F.col("date")).cast("int").alias("term_flag"), season(F.col("date")).alias("season"), F.date_format("date", "EEE").alias("dow"), F.lit(0).alias("bank_holiday"),
        F.col("newcase").alias("event_newcase"),
        F.greatest(flag("legal_request"), flag("legal_approval")).alias("event_legal"),
        flag("court_order").alias("event_court"),
    )


def panel_summary(panel: DataFrame, by: Sequence[str]) -> DataFrame:
    """Means of load and sums of events for each key."""
    return panel.groupBy(*by).agg(
        F.count("*").alias("days"),
        F.avg("wip").alias("mean_wip"),
        F.max("wip").alias("max_wip"),
        F.avg("backlog_available").alias("mean_backlog"),
        *(F.sum(f"event_{e}").alias(f"n_{e}") for e in ("newcase", "legal", "court")),
    )


def active_at(df: DataFrame, dates: DataFrame) -> DataFrame:
    """date, active: cases received by the day and not closed by it. dates: a few distinct days, broadcast; a sweep answers them."""
    inside = df.where("dt_received IS NOT NULL AND (dt_close IS NULL OR dt_close > dt_received)")
    ups = inside.groupBy(F.col("dt_received").alias("date")).agg(F.count("*").alias("d"))
    downs = inside.where("dt_close IS NOT NULL").groupBy(F.col("dt_close").alias("date")).agg((-F.count("*")).alias("d"))
    wanted = dates.select("date").distinct().select("date", F.lit(0).cast("bigint").alias("d"), F.lit(True).alias("asked"))
    both = ups.unionByName(downs).select("date", "d", F.lit(False).alias("asked")).unionByName(wanted).groupBy("date").agg(
        F.sum("d").alias("d"), F.max("asked").alias("asked")
    )
    w = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)  # one row a day
    return both.select("date", "asked", F.sum("d").over(w).alias("active")).where("asked").select("date", "active")


def interval_frame(df: DataFrame, term_months: Sequence[int] = (1, 4, 7, 10), starter_weeks: float = 12.0, holidays: Sequence[str] = ()) -> DataFrame:
    """39 columns of intervals and flags for each case; columns that df lacks are null."""
    have = set(df.columns)
    get = lambda c, t: F.col(c).cast(t) if c in have else F.lit(None).cast(t)
    text = "team case_type concern_type status staff_id".split()
    dates = "date dt_alloc dt_signoff dt_received dt_alloc_team dt_close dt_sent_to_ca dt_legal_req_1".split()
    d = df.select(
        F.col("case_id"),
        *(get(c, "string").alias(c) for c in text),
        *(get(c, "date").alias(c) for c in dates),
        F.coalesce(get("fte", "double"), F.lit(1.0)).alias("fte"),
        F.coalesce(get("weighting", "double"), F.lit(1.0)).alias("weighting"),
        get("legal_review", "int").alias("legal_review"),
    )
    d = d.withColumn("date", F.coalesce("date", "dt_alloc", "dt_received"))
    first_day = F.broadcast(d.agg(F.min("date").alias("first_day")))
    # cases without staff are dealt by a hash; what is by staff is null for them
    staff = Window.partitionBy("staff_id", F.when(F.col("staff_id").isNull(), F.xxhash64("case_id")))
    d = d.crossJoin(first_day).withColumn(
        "wip", F.coalesce((F.col("date") >= F.col("dt_alloc")) & (F.col("dt_close").isNull() | (F.col("date") < F.col("dt_close"))), F.lit(False))
    )
    d = d.join(F.broadcast(active_at(df, d.where("date IS NOT NULL").select("date"))), "date", "left")
    at = F.col("date")
    return d.select(
        "date", "staff_id", "team", "case_id", "case_type", "concern_type", "status", F.col("dt_alloc").alias("dt_alloc_invest"), F.col("dt_signoff").alias("dt_pg_signoff"), F.col("dt_received").alias("dt_received_inv"), "dt_alloc_team", "dt_close", "dt_sent_to_ca", "dt_legal_req_1",
        days(F.col("dt_alloc"), F.col("dt_signoff")).cast("double").alias("days_to_pg_signoff"), days(
            F.col("dt_received"), F.col("dt_alloc")
        ).cast("double").alias("days_to_alloc"),
        days(
            F.col("dt_received"), F.col("dt_legal_req_1")
        ).cast("double").alias("days_received_to_legal_review"), days(F.col("dt_alloc"), F.col("dt_legal_req_1")).cast("double").alias("days_alloc_to_req_legal_review"),
        "fte", "weighting", "wip", (F.col("fte") * F.col("weighting") * F.col("wip").cast("double")).alias("wip_load"),
        F.when(
            F.col("staff_id").isNotNull(), F.datediff("dt_alloc", F.lag("dt_alloc").over(staff.orderBy(F.asc_nulls_last("dt_alloc"), "case_id")))
        ).cast("double").alias("time_since_last_pickup"),
        (F.datediff("date", "first_day") / 7).alias("weeks_since_start"),
        F.coalesce(
            F.col("staff_id").isNotNull() & (F.datediff("date", F.min("dt_alloc").over(staff)) / 7 <= starter_weeks), F.lit(False)
        ).alias("is_new_starter"),
        F.coalesce((at >= F.col("dt_received")) & (F.col("dt_close").isNull() | (at < F.col("dt_close"))), F.lit(False)).alias("backlog_available"),
        F.coalesce(term_flag(at, term_months), F.lit(False)).alias("term_flag"), season(at).alias("season"), F.date_format("date", "EEEE").alias("dow"),
        (at.isin(*(F.lit(h).cast("date") for h in holidays)) if holidays else F.lit(False)).alias("bank_holiday"),
        F.coalesce(
            at == F.col("dt_legal_req_1"), F.lit(False)
        ).alias("event_req_legal_review"), F.coalesce(at == F.col("dt_received"), F.lit(False)).alias("event_newcase"),
        *(c.alias(n) for n, c in text_flags(F.col("status"), F.col("concern_type"), F.col("case_type")).items()),
        F.coalesce(at == F.col("dt_signoff"), F.lit(False)).alias("event_pg_signoff"),
        "legal_review", F.col("legal_review").cast("string").alias("legal_review_cat"), F.col("active").cast("double").alias("backlog"),
    )


def month_end_snapshots(df: DataFrame, months: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """month_end and case_id (and keep) of the cases that are active at each month end. months: a few rows, broadcast as one array."""
    ends = F.broadcast(months.agg(F.array_sort(F.collect_set("month_end")).alias("ends_")))

    def active(m: Column) -> Column:
        return (F.col("dt_received") <= m) & (F.col("dt_close").isNull() | (F.col("dt_close") > m))

    return df.crossJoin(ends).select(F.explode(F.filter("ends_", active)).alias("month_end"), "case_id", *keep)


def flow(snaps: DataFrame, months: int = 1, by: Sequence[str] = ()) -> DataFrame:
    """month_end, active, entered, exited against the snapshot so many months before (by: within keys)."""
    now = snaps.select(F.col("month_end").alias("m"), "case_id", *by).distinct()
    then = now.select(F.last_day(F.add_months("m", months)).alias("m"), "case_id", *by)
    span = F.broadcast(now.agg(F.min("m").alias("m0"), F.max("m").alias("m1")))
    both = now.withColumn("now", F.lit(1)).join(then.withColumn("then", F.lit(1)), ["m", "case_id", *by], "full").crossJoin(span).where("m BETWEEN m0 AND m1")
    return both.groupBy(F.col("m").alias("month_end"), *by).agg(
        F.count("now").alias("active"), F.count(F.when(F.col("then").isNull(), 1)).alias("entered"), F.count(F.when(F.col("now").isNull(), 1)).alias("exited")
    )


def case_flow(df: DataFrame, months: DataFrame, back: int = 1, by: Sequence[str] = ()) -> DataFrame:
    """What flow(month_end_snapshots(df, months, by), back, by) gives, from the cases themselves.

    A case is active from the month of its receipt to the month before its close. Cases are counted by
    those two months, and sums over months give the flows, so neither snapshots nor their join are
    made. months: a row for each month end of a span without gaps. A null key is a group of its own.
    """
    number = lambda c: F.year(c) * 12 + F.month(c) - 1
    span = F.broadcast(months.agg(F.min(number("month_end")).alias("m0"), F.max(number("month_end")).alias("m1")))
    rows = df.where("dt_received IS NOT NULL").crossJoin(span).select(
        *by, F.greatest(number("dt_received"), F.col("m0")).alias("a"), F.least(F.coalesce(number("dt_close") - 1, F.col("m1")), F.col("m1")).alias("b")
    )
    pairs = rows.where("a <= b").groupBy(*by, "a", "b").agg(F.count("*").alias("n"))  # at most one row a key and two months
    a, b, n, zero = F.col("a"), F.col("b"), F.col("n"), F.lit(0).cast("bigint")
    # months from which a count goes up or down: active a to b, entered a to a + back - 1, exited from the first month gone to b + back
    change = lambda m, x, y, z: F.struct(m.alias("m"), x.alias("active"), y.alias("entered"), z.alias("exited"))
    each = F.array(
        change(a, n, n, zero),
        change(b + 1, -n, zero, zero),
        change(F.least(b + 1, a + back), zero, -n, zero),
        change(F.greatest(a + back, b + 1), zero, zero, n),
        change(b + back + 1, zero, zero, -n),
    )
    names = ("active", "entered", "exited")
    per = pairs.select(*by, F.explode(each).alias("c")).groupBy(*by, "c.m").agg(*(F.sum(f"c.{c}").alias(c) for c in names))
    ends = pairs.agg(F.min("a").alias("first"), F.max("b").alias("last")).where("first IS NOT NULL").select(F.explode(F.sequence("first", "last")).alias("m"))
    grid = pairs.select(*by).distinct().crossJoin(F.broadcast(ends)).withColumns(dict.fromkeys(names, zero)) if by else ends.withColumns(dict.fromkeys(names, zero))
    w = Window.partitionBy(*by).orderBy("m").rowsBetween(Window.unboundedPreceding, 0)  # one row a month and key
    all_ = per.unionByName(grid).groupBy(*by, "m").agg(*(F.sum(c).alias(c) for c in names)).select(*by, "m", *(F.sum(c).over(w).alias(c) for c in names))
    inside = all_.join(F.broadcast(ends), "m", "left_semi").where("active > 0 OR exited > 0")
    return inside.select(F.last_day(F.make_date(F.expr("m DIV 12").cast("int"), F.col("m") % 12 + 1, F.lit(1))).alias("month_end"), *by, *names)


def age_rates(flows: DataFrame) -> DataFrame:
    """Flows by month and age, with termination and retention rates."""
    rate = F.try_divide(F.col("exited"), F.col("active"))
    return flows.withColumns({"termination_rate": rate, "retention_rate": 1 - rate})


def redistribute_unknown(df: DataFrame, by: Sequence[str], age: str, n: str) -> DataFrame:
    """Counts by age with the unknown age's count shared out by largest remainder (ties: the smaller age); totals stay."""
    w = Window.partitionBy(*by)
    known = df.where(F.col(age).isNotNull())
    lost = df.where(F.col(age).isNull()).groupBy(*by).agg(F.sum(n).alias("lost"))
    d = known.join(lost, list(by), "left").fillna({"lost": 0}).withColumn(
        "quota", F.try_divide(F.col(n) * F.col("lost"), F.sum(n).over(w))
    ).withColumn("base", F.floor("quota"))
    left = F.col("lost") - F.sum("base").over(w)
    d = d.withColumn("extra", (F.row_number().over(w.orderBy(F.desc(F.round(F.col("quota") - F.col("base"), 9)), age)) <= left).cast("int"))
    return d.select(*by, age, (F.col(n) + F.col("base") + F.col("extra")).cast("bigint").alias(n))


def stop_flow(rates: DataFrame, periods: int, age: str = "age_years") -> DataFrame:
    """period, age, forecast: the last stock carried forward by the flows of a year before, never below zero.

    rates: month_end, age, active, entered, exited. Past a year, the last observed year repeats.
    """
    rows = rates.groupBy(age).agg(F.array_sort(F.collect_list(F.struct("month_end", "active", (F.col("entered") - F.col("exited")).alias("net")))).alias("h"))
    last = rates.agg(F.max("month_end").alias("last"))
    h = F.filter("h", lambda r: r["month_end"] > F.add_months(F.col("last"), -12))
    net = lambda t: F.coalesce(F.element_at(F.map_from_entries(F.transform(h, lambda r: F.struct(r["month_end"], r["net"]))), F.last_day(F.add_months(F.col("last"), t))), F.lit(0))
    steps = F.transform(F.sequence(F.lit(1), F.lit(periods)), lambda p: net((p - 1) % 12 - 11))
    start = F.aggregate(F.filter("h", lambda r: r["month_end"] == F.col("last")), F.lit(0).cast("bigint"), lambda a, r: a + r["active"])
    path = F.aggregate(steps, F.array(start), lambda a, s: F.concat(a, F.array(F.greatest(F.element_at(a, -1) + s, F.lit(0).cast("bigint")))))
    d = rows.crossJoin(F.broadcast(last)).select(age, "last", F.posexplode(path).alias("p", "forecast")).where("p > 0")
    return d.select(F.last_day(F.add_months("last", F.col("p"))).alias("month_end"), age, "forecast")


def flow_scenario(rates: DataFrame, scale: float) -> DataFrame:
    """Rates with the entering cases scaled (and rounded)."""
    return rates.withColumn("entered", F.round(F.col("entered") * F.lit(scale)).cast("bigint"))


def count_band(df: DataFrame, c: str, phi: float = 1.0) -> DataFrame:
    """c with a band of 1.96 standard errors of an overdispersed count, from zero up."""
    half = 1.96 * F.sqrt(F.lit(phi) * F.col(c))
    return df.withColumns({"low": F.greatest(F.col(c) - half, F.lit(0.0)), "high": F.col(c) + half})


def flow_insights(forecast: DataFrame, k: int = 3, age: str = "age_years") -> DataFrame:
    """measure, label, value: change over the horizon, the peak month, and the ages that move most."""
    total = forecast.groupBy("month_end").agg(F.sum("forecast").alias("n"))
    ends = total.agg(
        (F.max_by("n", "month_end") - F.min_by("n", "month_end")).alias("change"),
        F.max_by("month_end", F.struct("n", F.datediff(F.lit("2100-01-01").cast("date"), "month_end"))).alias("peak"),
        F.max("n").alias("most"),
    )
    moves = forecast.groupBy(age).agg(
        (F.max_by("forecast", "month_end") - F.min_by("forecast", "month_end")).alias("value")
    ).orderBy(F.desc(F.abs("value")), age).limit(k)
    return ends.select(F.lit("horizon_change").alias("measure"), F.lit("all").alias("label"), F.col("change").alias("value")).unionByName(
        ends.select(F.lit("peak").alias("measure"), F.col("peak").cast("string").alias("label"), F.col("most").alias("value"))
    ).unionByName(moves.select(F.lit("mover").alias("measure"), F.col(age).cast("string").alias("label"), "value"))


def receipts_ratio(receipts: DataFrame, d: str, demand: DataFrame, due: str) -> DataFrame:
    """year, receipts, demand, ratio of the two (null without demand)."""
    side = lambda df, c, n: df.where(F.col(c).isNotNull()).groupBy(F.year(c).alias("year")).agg(F.count("*").alias(n))
    both = side(receipts, d, "receipts").join(side(demand, due, "demand"), "year", "full").withColumn("ratio", F.try_divide("receipts", "demand"))
    return both.fillna(0, ["receipts", "demand"])


def age_demand(receipts: DataFrame, demand: DataFrame, d: str, age: str) -> DataFrame:
    """age, share, expected: demand's age shares times a year of receipts, each day's number spread evenly between the least and most received on a day.

    receipts: days d; demand: ages. The mean of an even spread is the middle of its ends.
    """
    daily = receipts.groupBy(d).agg(F.count("*").alias("n"))
    year = daily.agg((365 * (F.min("n") + F.max("n")) / 2).alias("year"))
    ages = demand.groupBy(age).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy())  # one row an age
    return ages.withColumn("share", F.col("n") / total).crossJoin(F.broadcast(year)).select(age, "share", (F.col("share") * F.col("year")).alias("expected"))
