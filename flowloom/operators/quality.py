"""Filters, typed cleaning and validation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import clip, derived_key, hash_id, null_tokens, parse_date, truthy, unknown, valid_delay

#: The ordered case statuses.
STATUSES = ("To be allocated", "Awaiting investigator", "Investigation Phase", "Closed", "No further action", "Further action")


def basic_clean(df: DataFrame, texts: Sequence[str], flag: str, weight: str) -> DataFrame:
    """Unknown for missing texts, a boolean flag, a weight within 0 to 5."""
    return df.withColumns({c: unknown(F.col(c)) for c in texts} | {flag: truthy(F.col(flag)), weight: clip(F.col(weight).try_cast("double"), 0.0, 5.0)})


def engineer_intervals(df: DataFrame, backlog_statuses: Sequence[str]) -> DataFrame:
    legal = [F.col(c).isNotNull() for c in df.columns if c.startswith("dt_legal")]
    needs = legal[0]
    for c in legal[1:]:
        needs = needs | c
    return df.select(
        "case_id",
        F.datediff("dt_alloc", "dt_received").alias("days_to_alloc"),
        F.datediff("dt_signoff", "dt_alloc").alias("days_to_signoff"),
        F.col("dt_signoff").isNotNull().cast("int").alias("event_signoff"),
        F.coalesce(F.col("status").isin(*backlog_statuses), F.lit(False)).cast("int").alias("in_backlog"),
        needs.cast("int").alias("needs_legal"),
    )


def derive_durations(df: DataFrame, spans: Mapping[str, tuple[str, str]]) -> DataFrame:
    """d_name: days of each span, negative ones null; e_name: whether its end is dated."""
    gap = {n: F.datediff(F.col(b), F.col(a)) for n, (a, b) in spans.items()}
    return df.withColumns({f"d_{n}": F.when(g >= 0, g) for n, g in gap.items()} | {f"e_{n}": F.col(b).isNotNull().cast("int") for n, (_, b) in spans.items()})


def compute_delay(df: DataFrame, a: str, b: str, drop: bool = False) -> DataFrame:
    out = df.withColumn("delay", valid_delay(F.col(a), F.col(b)))
    return out.where("delay IS NOT NULL") if drop else out


def engineer(df: DataFrame, only_reallocated: bool = False) -> DataFrame:
    """Typed cases from raw text columns (investigator, team, fte, weighting, status, reallocated, case_type, risk, dates as text).

    One select; a duration column that is given is kept unless it is null in every row.
    """
    dates = [c for c in df.columns if c.startswith("dt_")]
    text = lambda c: null_tokens(F.col(c)) if c in df.columns else F.lit(None).cast("string")
    number = lambda c: text(c).try_cast("double")
    status = text("status")
    typed = df.select(
        "case_id", text("investigator").alias("investigator"), hash_id(F.col("investigator")).alias("staff_id"), text("team").alias("team"), F.coalesce(text("role"), F.lit("")).alias("role"),
        F.coalesce(number("fte"), F.lit(1.0)).alias("fte"), number("weighting").alias("weighting"), text("case_type").alias("case_type"), text("risk").alias("risk"),
        F.when(status.isin(*STATUSES), status).alias("status"), F.array_position(F.array(*map(F.lit, STATUSES)), status).cast("int").alias("status_rank"),
        truthy(F.col("reallocated")).alias("is_reallocated"), *(
            parse_date(F.col(c)).alias(c)
            for c in dates
        ), number("days_to_signoff").alias("given_signoff"), number("days_to_alloc").alias("given_alloc"),
    )
    known = F.broadcast(typed.agg((F.count("given_signoff") == 0).alias("no_signoff"), (F.count("given_alloc") == 0).alias("no_alloc")))
    out = typed.crossJoin(known).withColumns(
        {
            "days_to_signoff": F.when(F.col("no_signoff"), F.datediff("dt_signoff", "dt_alloc")).otherwise(F.col("given_signoff")).cast("double"),
            "days_to_alloc": F.when(F.col("no_alloc"), F.datediff("dt_alloc", "dt_received")).otherwise(F.col("given_alloc")).cast("double"),
            "legal_review": F.col("dt_legal_req_1").isNotNull().cast("int"),
        }
    ).drop("given_signoff", "given_alloc", "no_signoff", "no_alloc")
    return out.where("is_reallocated") if only_reallocated else out


def filter_years(df: DataFrame, d: str, anchor: str, years: int = 4) -> DataFrame:
    day = F.lit(anchor).cast("date")
    return df.where(F.col(d).between(F.date_sub(day, 365 * years), day))


def filter_metric(df: DataFrame, d: str, metric: str, start: str, end: str) -> DataFrame:
    """Rows in the date range with a metric that is there and not negative."""
    return df.where(F.col(d).between(F.lit(start).cast("date"), F.lit(end).cast("date")) & (F.col(metric) >= 0))


def validate_dates(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.withColumns({c: parse_date(F.col(c)) for c in cols})


def flag_invalid(df: DataFrame, a: str, b: str) -> DataFrame:
    """invalid: a date is missing or a comes after b."""
    return df.withColumn("invalid", F.coalesce(F.col(a) > F.col(b), F.lit(True)))


def check_rules(df: DataFrame, rules: Mapping[str, str]) -> DataFrame:
    """rule, violations: rows for which the rule's SQL condition holds."""
    counts = df.agg(*(F.count(F.when(F.expr(c), 1)).alias(n) for n, c in rules.items()))
    return counts.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, rules)), F.array(*(F.col(n) for n in rules)))).alias("rule", "violations"))


def validate(df: DataFrame, contract: Mapping[str, dict]) -> DataFrame:
    """column, check, failures. contract: column -> nullable, min, max, allowed (type: the column's simple type)."""
    checks: list[tuple[str, str, Column]] = []
    types = dict(df.dtypes)
    for c, rule in contract.items():
        if "type" in rule:
            checks.append((c, "type", F.lit(types.get(c) != rule["type"])))
        if c not in types:  # no row has a value
            if not rule.get("nullable", True):
                checks.append((c, "null", F.lit(True)))
            continue
        if not rule.get("nullable", True):
            checks.append((c, "null", F.col(c).isNull()))
        if "min" in rule:
            checks.append((c, "min", F.col(c) < rule["min"]))
        if "max" in rule:
            checks.append((c, "max", F.col(c) > rule["max"]))
        if "allowed" in rule:
            checks.append((c, "allowed", ~F.col(c).isin(*rule["allowed"])))
    row = df.agg(*(F.count(F.when(cond, 1)).alias(f"k{i}") for i, (_, _, cond) in enumerate(checks)))
    return row.select(
        F.explode(
            F.array(*(F.struct(F.lit(c).alias("column"), F.lit(n).alias("check"), F.col(f"k{i}").alias("failures")) for i, (c, n, _) in enumerate(checks)))
        ).alias("r")
    ).select("r.*")


def leakage_scan(df: DataFrame, keys: Sequence[str]) -> list[str]:
    """Columns whose name holds a keyword: metadata only."""
    return [c for c in df.columns if any(k.lower() in c.lower() for k in keys)]


def drop_constant(df: DataFrame) -> DataFrame:
    """Without columns that hold one value (a null counts as one)."""
    row = df.agg(*(((F.min(c) == F.max(c)) & (F.count(c) == F.count("*")) | (F.count(c) == 0)).alias(c) for c in df.columns)).first()
    return df.drop(*(c for c in df.columns if row[c]))


def retention(df: DataFrame, d: str, years: int, as_of: str) -> DataFrame:
    return df.where(F.col(d) >= F.add_months(F.lit(as_of).cast("date"), -12 * years))


def run_checks(df: DataFrame, a: str, b: str, case_no: str, unique_id: str) -> DataFrame:
    """Validate dates, compute the delay, impute it, derive the key, keep the first of each key."""
    from .privacy import impute_group_mean
    from .windows import dedup_first

    d = compute_delay(validate_dates(df, [a, b]), a, b)
    d = impute_group_mean(d, "delay", F.year(F.coalesce(a, b)))
    d = d.withColumn("key", derived_key(F.col(case_no), F.col(b), F.col(unique_id)))
    return dedup_first(d, ["key"], [unique_id])
