"""Aggregations. Null group keys are dropped or kept as each docstring says; exact quantiles have an approx option for scale."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scans import HELD, grouped_quantiles, kept, meet

QUANTILES = (0.1, 0.25, 0.5, 0.75, 0.9)


def aggregate(name: str, c: str, approx: bool = False) -> Column:
    """An aggregate by name: mean, sum, count, min, max, std, nunique, median, pNN; median for unknown names."""
    plain = {"mean": F.avg, "avg": F.avg, "sum": F.sum, "count": F.count, "min": F.min, "max": F.max, "std": F.stddev_samp, "nunique": F.count_distinct}
    if name in plain:
        return plain[name](c)
    q = int(name[1:]) / 100 if name[:1] == "p" and name[1:].isdigit() else 0.5
    return (F.percentile_approx if approx else F.percentile)(F.col(c), q)


def group_summary(df: DataFrame, by: Sequence[str], metrics: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Named aggregates by key; null keys are dropped."""
    return df.dropna(subset=list(by)).groupBy(*by).agg(*(aggregate(f, c).alias(n) for n, (c, f) in metrics.items()))


def _spread(c: str, approx: bool = False) -> list[Column]:
    q = F.percentile_approx if approx else F.percentile
    return [
        F.count(c).alias("n"),
        F.avg(c).alias("mean"),
        F.coalesce(F.stddev_samp(c), F.lit(0.0)).alias("std"),
        F.min(c).cast("double").alias("min"),
        *(q(F.col(c), p).alias(f"p{int(p * 100)}") for p in QUANTILES),
        F.max(c).cast("double").alias("max"),
    ]


def _long(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """metric, value: one row for each value."""
    return df.select(
        *by, F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in cols))).alias("x")
    ).select(*by, "x.metric", "x.value")


def distribution(df: DataFrame, cols: Sequence[str], approx: bool = False) -> DataFrame:
    """Count, mean, std (0 for one value), least, quantiles, largest of the values from zero up."""
    return _long(df, cols).where("value >= 0").groupBy("metric").agg(*_spread("value", approx))


def distribution_by(df: DataFrame, by: Sequence[str], cols: Sequence[str], approx: bool = False) -> DataFrame:
    """The same for each key; a null key is a group of its own."""
    return _long(df, cols, by).where("value >= 0").groupBy("metric", *by).agg(*_spread("value", approx))


def monthly_trend(df: DataFrame, d: str, metric: str, agg: str = "median", by: Sequence[str] = (), approx: bool = False) -> DataFrame:
    """month, value, delta against the previous month that is there; null keys, days and values are dropped."""
    m = df.dropna(subset=[d, metric, *by]).groupBy(*by, F.date_format(d, "yyyy-MM").alias("month")).agg(aggregate(agg, metric, approx).alias("value"))
    return m.withColumn("delta", F.col("value") - F.lag("value").over(Window.partitionBy(*by).orderBy("month")))


def volatility(df: DataFrame, d: str, metric: str, by: Sequence[str], freq: str = "week") -> DataFrame:
    """Standard deviation of the periods' medians (weeks end on Sunday), and the number of periods; null keys are kept."""
    period = F.date_trunc(freq, d).cast("date")
    per = df.dropna(subset=[d, metric]).groupBy(*by, period.alias("period")).agg(F.median(metric).alias("m"))
    return per.groupBy(*by).agg(F.stddev_samp("m").alias("volatility"), F.count("*").alias("periods"))


def monthly_interval_stats(df: DataFrame, d: str, metric: str, category: str, start: str, end: str, approx: bool = False) -> DataFrame:
    """Stats by month and category and, under ALL, by month: one scan with grouping sets."""
    rows = df.where(F.col(d).between(F.lit(start).cast("date"), F.lit(end).cast("date")) & (F.col(metric) >= 0)).select(
        F.date_format(d, "yyyy-MM").alias("ym"), F.col(category).alias("category"), F.col(metric).alias("v")
    )
    q = F.percentile_approx if approx else F.percentile
    stats = [
        F.avg("v").alias("mean"),
        q("v", 0.5).alias("median"),
        F.stddev_samp("v").alias("std"),
        q("v", 0.25).alias("p25"),
        q("v", 0.75).alias("p75"),
        F.count("v").alias("n"),
        F.grouping("category").alias("all_"),
    ]
    g = rows.groupingSets([[F.col("ym"), F.col("category")], [F.col("ym")]], "ym", "category").agg(*stats)
    return g.where("all_ = 1 OR category IS NOT NULL").withColumn("category", F.when(F.col("all_") == 1, "ALL").otherwise(F.col("category"))).drop("all_")


def interval_change(df: DataFrame, d: str, metric: str, by: str) -> DataFrame:
    """Stats by year and key, and the change of the median against the year before that is there in any group."""
    rows = df.dropna(subset=[d, metric, by]).select(F.year(d).alias("year"), F.col(by), F.col(metric).alias("v"))
    rows = kept(rows)
    exact = grouped_quantiles(rows, ["year", by], "v", {"median": 0.5, "p25": 0.25, "p75": 0.75})
    s = kept(meet(rows.groupBy("year", by).agg(F.avg("v").alias("mean"), F.count("v").alias("n")), exact, ["year", by]))
    years = s.select("year").distinct().withColumn("prev", F.lag("year").over(Window.orderBy("year")))  # one row a year
    then = s.select(F.col("year").alias("prev"), by, F.col("median").alias("median_before"))
    return s.join(F.broadcast(years), "year").join(then, ["prev", by], "left").select(
        "year", by, "median", "p25", "p75", "mean", "n", (F.col("median") - F.col("median_before")).alias("yoy_change")
    )


def arrivals(df: DataFrame, d: str, by: str, freq: str) -> DataFrame:
    return df.where(F.col(d).isNotNull()).groupBy(
        F.date_trunc(freq, d).cast("date").alias("period"), F.coalesce(by, F.lit("Unknown")).alias(by)
    ).agg(F.count("*").alias("arrivals"))


def staffing_daily(df: DataFrame, d: str, staff: str, case: str) -> DataFrame:
    return df.where(F.col(d).isNotNull()).groupBy(F.col(d).alias("date")).agg(F.count_distinct(staff).alias("staff"), F.count(case).alias("allocations"))


def routing(df: DataFrame, by: Sequence[str], flag: str) -> DataFrame:
    filled = df.withColumns({c: F.coalesce(c, F.lit("Unknown")) for c in by})
    return filled.groupBy(*by).agg(F.avg(flag).alias("rate"), F.count("*").alias("n"))


def review_rate(df: DataFrame, by: Sequence[str], flag: str, duration: str) -> DataFrame:
    """Rate, number, median and mean duration; null keys are kept."""
    rest = df.groupBy(*by).agg(F.avg(flag).alias("rate"), F.count("*").alias("n"), F.avg(duration).alias("mean"))
    return meet(rest, grouped_quantiles(df, by, duration, {"median": 0.5}), by).select(*by, "rate", "n", "median", "mean")


def weighted_mean(df: DataFrame, v: str, w: str, by: Sequence[str]) -> DataFrame:
    return df.where(F.col(v).isNotNull() & F.col(w).isNotNull()).groupBy(*by).agg(
        F.try_divide(F.sum(F.col(v) * F.col(w)), F.sum(w)).alias("weighted_mean"), F.count("*").alias("n")
    )


def pickup_grid(df: DataFrame, load: Column, gap: Column, flag: str) -> DataFrame:
    """Mean flag and count for each load band and gap band; empty cells are there."""
    from ..functions.scalars import band

    inf = float("inf")
    loads, gaps = ("Low", "Medium", "High", "Very high"), ("<1 week", "1-2 weeks", "2-4 weeks", "4-13 weeks", ">13 weeks")
    cells = df.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, loads))).alias("load_band")).select(
        "load_band", F.explode(F.array(*map(F.lit, gaps))).alias("gap_band")
    )
    rows = df.select(
        band(load, (0, 40, 80, 120, inf), loads).alias("load_band"), band(gap, (0, 7, 14, 28, 90, inf), gaps).alias("gap_band"), F.col(flag).alias("flag")
    ).dropna(subset=["load_band", "gap_band"])
    return cells.join(
        rows.groupBy("load_band", "gap_band").agg(F.avg("flag").alias("probability"), F.count("*").alias("n")), ["load_band", "gap_band"], "left"
    ).fillna({"n": 0})


def quantile_bin(df: DataFrame, num: str, q: int) -> DataFrame:
    """df with bin: which of q quantile intervals, open on the left, holds the value; equal edges are merged."""
    edges = df.agg(F.array_distinct(F.percentile(num, [k / q for k in range(q + 1)])).alias("edges_"))
    x = F.col(num)
    return df.crossJoin(F.broadcast(edges)).withColumn(
        "bin", F.when(x.isNotNull(), F.greatest(F.lit(1), F.size(F.filter("edges_", lambda e: e < x))))
    ).drop("edges_")


def binned_interaction(df: DataFrame, num: str, cat: str, target: str, q: int) -> DataFrame:
    """bin, category, mean of the target, n; pivot it on the category for a table."""
    return quantile_bin(df.dropna(subset=[num, cat, target]), num, q).groupBy("bin", cat).agg(F.avg(target).alias("mean_target"), F.count("*").alias("n"))


def interaction_table(df: DataFrame, num: str, cat: str, target: str, q: int, values: Sequence[str]) -> DataFrame:
    """binned_interaction as a table: a row for each bin, a column of means for each of the stated values."""
    return quantile_bin(df.dropna(subset=[num, cat, target]), num, q).groupBy("bin").pivot(cat, list(values)).agg(F.avg(target))


def monthly_kpis(df: DataFrame, ts: str, case: str, team: str, backlog: str, duration: str, flag: str) -> DataFrame:
    """Last backlog, median duration and flag rate of each team and month."""
    return df.where(F.col(ts).isNotNull()).groupBy(F.date_format(ts, "yyyy-MM").alias("month"), team).agg(
        F.max_by(backlog, F.struct(ts, case)).alias("last_backlog"), F.percentile(duration, 0.5).alias("median_duration"), F.avg(flag).alias("rate")
    )


def resample(df: DataFrame, d: str, freq: str, metrics: Mapping[str, tuple[str, str]], roll: int = 7, least: int = 3) -> DataFrame:
    """Aggregates by day, week or month with empty periods there, and rolling means over so many periods."""
    step = {"day": "INTERVAL 1 DAY", "week": "INTERVAL 7 DAYS", "month": "INTERVAL 1 MONTH"}[freq]
    period = F.date_trunc(freq, d).cast("date")
    per = df.where(F.col(d).isNotNull()).groupBy(period.alias("period")).agg(*(aggregate(f, c).alias(n) for n, (c, f) in metrics.items()))
    spine = per.agg(F.min("period").alias("a"), F.max("period").alias("b")).select(F.explode(F.sequence("a", "b", F.expr(step))).alias("period"))
    w = Window.orderBy("period").rowsBetween(1 - roll, 0)  # one row a period
    return spine.join(per, "period", "left").withColumns({f"{n}_roll": F.when(F.count(n).over(w) >= least, F.avg(n).over(w)) for n in metrics})


def period_counts(df: DataFrame, d: str, by: str, freq: str) -> DataFrame:
    """Counts by period and key, zero where there is none."""
    step = {"day": "INTERVAL 1 DAY", "week": "INTERVAL 7 DAYS", "month": "INTERVAL 1 MONTH"}[freq]
    per = df.where(F.col(d).isNotNull() & F.col(by).isNotNull()).groupBy(F.date_trunc(freq, d).cast("date").alias("period"), by).agg(F.count("*").alias("n"))
    spine = per.agg(F.min("period").alias("a"), F.max("period").alias("b")).select(F.explode(F.sequence("a", "b", F.expr(step))).alias("period"))
    return per.select(by).distinct().crossJoin(F.broadcast(spine)).join(per, ["period", by], "left").fillna({"n": 0})


def aggregate_backlog(daily: DataFrame, freq: str, counts: DataFrame | None = None) -> DataFrame:
    """Backlog days by period; with counts (category, n), times each category's number of cases."""
    per = daily.groupBy(F.date_trunc(freq, "date").cast("date").alias("period")).agg(F.sum("backlog").alias("backlog"))
    return per if counts is None else per.crossJoin(counts).withColumn("backlog", F.col("backlog") * F.col("n")).drop("n")


def pickup_history(panel: DataFrame, by: str) -> DataFrame:
    """Daily and cumulative pickups of each key."""
    per = panel.groupBy(by, "date").agg(F.sum("event_newcase").alias("pickups"))
    return per.withColumn("cumulative", F.sum("pickups").over(Window.partitionBy(by).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)))


def category_trend(df: DataFrame, d: str, cat: str, values: Sequence[str], freq: str = "yyyy-MM") -> DataFrame:
    """One row a period, one column for each of the stated values."""
    return df.where(F.col(d).isNotNull()).groupBy(F.date_format(d, freq).alias("period")).pivot(cat, list(values)).agg(F.count(F.lit(1))).fillna(0)


def pre_post(df: DataFrame, cat: str, d: str, cut: str) -> DataFrame:
    """Counts and shares of a category before a day and from it on."""
    side = F.when(F.col(d) < F.lit(cut).cast("date"), "pre").otherwise("post")
    n = df.where(F.col(d).isNotNull()).groupBy(side.alias("period"), cat).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("period")))


def delay_bounds(df: DataFrame, d: str, kind: str, delay: str, periods: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Least and largest delay in months of each named period and type. periods: name, first day, last day."""
    spans = F.explode(F.array(*(F.struct(F.lit(n).alias("period"), F.lit(a).cast("date").alias("a"), F.lit(b).cast("date").alias("b")) for n, a, b in periods)))
    rows = df.select(d, kind, delay, spans.alias("p")).where(F.col(d).between(F.col("p.a"), F.col("p.b")) & F.col(delay).isNotNull())
    return rows.groupBy("p.period", kind).agg((F.min(delay) / 30.4375).alias("least_months"), (F.max(delay) / 30.4375).alias("most_months"))


def earliest(df: DataFrame, key: str, d: str) -> DataFrame:
    return df.groupBy(key).agg(F.min(d).alias(d))


def describe_all(df: DataFrame, approx: bool = False, whole: int = HELD) -> DataFrame:
    """column, n, distinct, top (the most frequent text, ties by text), mean, std, quartiles for all columns.

    Values are counted once. Exact quartiles of a column of more than `whole` distinct values are selected
    by ranks (grouped_quantiles), so no task holds a column's values.
    """
    numeric = {c for c, t in df.dtypes if t in ("int", "bigint", "double", "float", "smallint", "tinyint") or t.startswith("decimal")}
    rows = df.select(
        F.explode(
            F.array(
                *(
                    F.struct(
                        F.lit(c).alias("column"),
                        F.col(c).cast("string").alias("text"),
                        (F.col(c).cast("double") if c in numeric else F.lit(None).cast("double")).alias("x"),
                    )
                    for c in df.columns
                )
            )
        ).alias("r")
    ).select("r.*").where("text IS NOT NULL")
    per = kept(rows.groupBy("column", "text", "x").agg(F.count("*").alias("k")))
    n, s1, s2 = F.sum("k"), F.sum(F.col("x") * F.col("k")), F.sum(F.col("x") * F.col("x") * F.col("k"))
    out = kept(per.groupBy("column").agg(
        n.alias("n"),
        F.count("*").alias("distinct"),
        F.min_by("text", F.struct(-F.col("k"), "text")).alias("top"),
        F.max("k").alias("freq"),
        (s1 / n).alias("mean"),
        F.when(F.count("x") > 0, F.sqrt(F.try_divide(F.greatest(s2 - s1 * s1 / n, F.lit(0.0)), n - 1))).alias("std"),
    ))
    points = (0.25, 0.5, 0.75)
    if approx:
        each = rows.groupBy("column").agg(*(F.percentile_approx("x", p).alias(f"p{int(p * 100)}") for p in points))
    elif (out.agg(F.max("distinct")).first()[0] or 0) > whole:
        each = grouped_quantiles(rows, ["column"], "x", {f"p{int(p * 100)}": p for p in points}, whole)
    else:
        each = per.groupBy("column").agg(*(F.percentile("x", p, F.col("k")).alias(f"p{int(p * 100)}") for p in points))
    return out.join(each, "column")


def overview(df: DataFrame, key: str, dates: Sequence[str], target: str) -> DataFrame:
    """measure, value: rows, columns, missing share, repeated ids, date span, target share."""
    cells = F.lit(len(df.columns)) * F.count("*")
    row = df.agg(
        F.count("*").cast("double").alias("rows"),
        F.lit(float(len(df.columns))).alias("columns"),
        F.try_divide(sum((F.count(F.when(F.col(c).isNull(), 1)) for c in df.columns), F.lit(0)), cells).alias("missing_share"),
        (F.count(key) - F.count_distinct(key)).cast("double").alias("repeated_ids"),
        F.avg(target).alias("target_share"),
        *(F.datediff(F.max(d), F.min(d)).cast("double").alias(f"span_{d}") for d in dates),
    )
    return row.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, row.columns)), F.array(*map(F.col, row.columns)))).alias("measure", "value"))


def missingness(df: DataFrame) -> DataFrame:
    """column, missing, share."""
    row = df.agg(F.count("*").alias("n_"), *(F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in df.columns))
    return row.select(
        "n_", F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("missing")) for c in df.columns))).alias("r")
    ).select("r.column", "r.missing", F.try_divide("r.missing", "n_").alias("share"))


def missing_by_target(df: DataFrame, feature: str, target: str) -> DataFrame:
    return df.groupBy(target).agg(F.avg(F.col(feature).isNull().cast("int")).alias("missing_share"), F.count("*").alias("n"))


def imbalance(df: DataFrame, target: str) -> DataFrame:
    one = F.count(F.when(F.col(target) == 1, 1))
    return df.agg(F.count(F.when(F.col(target) == 0, 1)).alias("n0"), one.alias("n1"), F.try_divide(one, F.count(target)).alias("share"))


def profile(df: DataFrame, most: int = 50) -> DataFrame:
    """column, type, least and largest as text, number of values, and the sorted values if they are at most `most`.

    Values are gathered only for the columns that have so few.
    """
    number = lambda c, t: F.col(c).try_cast("double") if t != "date" else F.lit(None).cast("double")
    rows = df.select(
        F.explode(
            F.array(
                *(F.struct(F.lit(c).alias("column"), F.lit(t).alias("type"), F.col(c).cast("string").alias("v"), number(c, t).alias("x")) for c, t in df.dtypes)
            )
        ).alias("r")
    ).select("r.*").where("v IS NOT NULL")
    per = kept(rows.groupBy("column", "type", "v", "x").agg(F.count("*").alias("k")))
    least, largest = F.coalesce(F.min("x").cast("string"), F.min("v")), F.coalesce(F.max("x").cast("string"), F.max("v"))
    out = per.groupBy("column", "type").agg(least.alias("least"), largest.alias("largest"), F.count("*").alias("cardinality"))
    few = F.broadcast(out.where(F.col("cardinality") <= most).select("column"))  # one row a column
    values = per.join(few, "column").groupBy("column").agg(F.array_join(F.array_sort(F.collect_list("v")), "|").alias("values"))
    return out.join(values, "column", "left").select("column", "type", "least", "largest", "cardinality", "values")
