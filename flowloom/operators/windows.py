"""Ordered operators: lags, gaps, dedup, top rows, splits. Every window has a key, or runs over day-grained rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scans import lagged


def inter_pickup(df: DataFrame) -> DataFrame:
    """Days since the staff member's previous allocation."""
    w = Window.partitionBy("staff_id").orderBy(F.asc_nulls_last("dt_alloc"), "case_id")
    return df.withColumn("inter_pickup_days", F.datediff("dt_alloc", F.lag("dt_alloc").over(w)))


def new_starter(df: DataFrame, at: str, weeks: float = 12.0) -> DataFrame:
    """First allocation of the staff member, weeks since, and whether these are at most so many."""
    first = F.min("dt_alloc").over(Window.partitionBy("staff_id"))
    since = F.datediff(at, first) / 7
    return df.withColumns({"first_alloc": first, "weeks_since_first": since, "is_new_starter": F.coalesce(since <= weeks, F.lit(False))})


def allocation_gaps(df: DataFrame) -> DataFrame:
    """One row for each allocation after the first, with the previous day and a gap above zero."""
    w = Window.partitionBy("staff_id").orderBy("dt_alloc", "case_id")
    d = df.where("dt_alloc IS NOT NULL AND staff_id IS NOT NULL").withColumn("prev_alloc", F.lag("dt_alloc").over(w))
    return d.withColumn("gap_days", F.datediff("dt_alloc", "prev_alloc")).where("gap_days > 0")


def gap_summary(gaps: DataFrame, by: Sequence[str], approx: bool = False) -> DataFrame:
    q = F.percentile_approx if approx else F.percentile
    return gaps.groupBy(*by).agg(
        F.count("gap_days").alias("n"),
        F.avg("gap_days").alias("mean"),
        q("gap_days", 0.5).alias("median"),
        q("gap_days", 0.25).alias("p25"),
        q("gap_days", 0.75).alias("p75"),
    )


def lag_features(df: DataFrame, c: str, k: int, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumns({f"{c}_lag{i}": F.lag(c, i).over(w) for i in range(1, k + 1)})


def lag_corr(df: DataFrame, a: str, b: str, lags: Sequence[int], order: str, **options) -> DataFrame:
    """lag, r: correlation of a with b so many rows before. df: one row a day."""
    d = df.select(F.col(order).alias("o"), F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b"))
    d = lagged(d, "o", {f"b{k}": ("b", k) for k in lags}, **options)
    both = lambda k: F.col("a").isNotNull() & F.col(f"b{k}").isNotNull()
    row = d.agg(*(guarded_corr(F.when(both(k), F.col("a")), F.when(both(k), F.col(f"b{k}"))).alias(f"r{k}") for k in lags))
    return row.select(F.explode(F.array(*(F.struct(F.lit(k).alias("lag"), F.col(f"r{k}").alias("r")) for k in lags))).alias("x")).select("x.*")


def guarded_corr(a, b):
    """Pearson correlation, null where a column is constant."""
    return F.when(
        (F.stddev_pop(a) > 0) & (F.stddev_pop(b) > 0),
        F.try_divide(F.covar_pop(a, b), F.stddev_pop(F.when(b.isNotNull(), a)) * F.stddev_pop(F.when(a.isNotNull(), b))),
    )


def lead_target(df: DataFrame, c: str, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    return df.withColumn(f"{c}_next", F.lead(c).over(Window.partitionBy(*by).orderBy(*order)))


def rolling_mean(df: DataFrame, c: str, rows: int, least: int, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Mean of so many rows, null with fewer than `least` values."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(1 - rows, 0)
    return df.withColumn(f"{c}_roll{rows}", F.when(F.count(c).over(w) >= least, F.avg(c).over(w)))


def differences(df: DataFrame, c: str, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Change from the row before, and the change before that."""
    w = Window.partitionBy(*by).orderBy(*order)
    d = df.withColumn(f"d_{c}", F.col(c) - F.lag(c).over(w))
    return d.withColumn(f"d_{c}_lag1", F.lag(f"d_{c}").over(w))


def split_last(df: DataFrame, order: str, n: int) -> DataFrame:
    """is_test: whether the row's period is one of the last n distinct ones."""
    last = df.select(order).distinct().orderBy(F.desc(order)).limit(n).agg(F.min(order).alias("cut_"))
    return df.crossJoin(F.broadcast(last)).withColumn("is_test", F.col(order) >= F.col("cut_")).drop("cut_")


def split_quantile(df: DataFrame, d: str, q: float, approx: bool = False) -> DataFrame:
    """is_test: whether the day lies above the q-quantile of days."""
    n = F.datediff(d, F.lit("1970-01-01").cast("date"))
    cut = df.agg((F.percentile_approx if approx else F.percentile)(n, q).alias("cut_"))
    return df.crossJoin(F.broadcast(cut)).withColumn("is_test", F.coalesce(n > F.col("cut_"), F.lit(False))).drop("cut_")


def split_share(df: DataFrame, key: str, share: float, seed: int = 0) -> DataFrame:
    """is_test for about that share of keys, fixed by a hash of key and seed."""
    return df.withColumn("is_test", F.pmod(F.crc32(F.concat_ws("|", F.lit(seed), F.col(key)).cast("binary")), F.lit(10_000)) < int(share * 10_000))


def dedup_first(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("rn_", F.row_number().over(w)).where("rn_ = 1").drop("rn_")


def duplicate_count(df: DataFrame, key: str) -> DataFrame:
    return df.agg((F.count(key) - F.count_distinct(key)).alias("duplicates"))


def top_k(df: DataFrame, c: str, k: int) -> DataFrame:
    """The k most frequent values; ties by value."""
    return df.groupBy(c).agg(F.count("*").alias("n")).orderBy(F.desc("n"), c).limit(k)


def top_movers(df: DataFrame, period: str, c: str, first: str, last: str, k: int) -> DataFrame:
    """Categories that rise and fall most between two periods."""
    p = F.col(period).cast("string")
    moved = df.where(p.isin(first, last)).groupBy(c).agg((F.count(F.when(p == last, 1)) - F.count(F.when(p == first, 1))).alias("change"))
    up = moved.orderBy(F.desc("change"), c).limit(k).withColumn("side", F.lit("up"))
    return up.unionByName(moved.orderBy("change", c).limit(k).withColumn("side", F.lit("down")))


def match_rate(real: DataFrame, other: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Share of the distinct combinations of real that other has too (nulls match)."""
    r, s = (d.select(*cols).distinct() for d in (real, other))
    both = r.withColumn("r_", F.lit(1)).unionByName(s.withColumn("r_", F.lit(2))).groupBy(*cols).agg(F.sum("r_").alias("s_"))
    return both.agg(F.try_divide(F.count(F.when(F.col("s_") == 3, 1)), F.count(F.when(F.col("s_") != 2, 1))).alias("match_rate"))


def time_folds(df: DataFrame, d: str, k: int) -> DataFrame:
    """fold 0 to k - 1 by time: the days are numbered by ntile over distinct days; train on folds before, test on fold i."""
    days = df.select(d).distinct().withColumn("fold", F.ntile(k).over(Window.orderBy(d)) - 1)
    return df.join(days, d)
