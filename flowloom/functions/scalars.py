"""Cleaning and scalar functions. All are built of Spark's own functions and stay in generated code."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Texts that stand for a missing value, after trimming and lower-casing.
NULL_STRINGS = ("", "na", "n/a", "none", "null", "-", "--", "unknown", "not completed", "not complete", "tbc", "n\\a")
TRUTHY = ("yes", "y", "true", "1")


def null_tokens(c: Column) -> Column:
    """Null for texts that stand for a missing value; else the trimmed text."""
    t = F.trim(c.cast("string"))
    return F.when(~F.lower(t).isin(*NULL_STRINGS), t)


def parse_date(c: Column, serial_from: int = 20000, dayfirst: bool = True) -> Column:
    """A messy date text as a date, or null.

    ISO text is read as ISO; d/m/y with the day first, else the month first; day and month names;
    ordinal endings are dropped; a whole number from serial_from up is a spreadsheet's day number.
    """
    t = F.regexp_replace(null_tokens(c), r"(?i)\b(\d{1,2})(st|nd|rd|th)\b", "$1")
    t = F.regexp_replace(F.regexp_replace(t, r"[.\-](?=\d{1,2}[.\-]\d{4}|\d{4}$)", "/"), r"\s+", " ")
    day = F.regexp_extract(t, r"^(\d{4}-\d{1,2}-\d{1,2}|\d{1,2}/\d{1,2}/\d{2,4}|\d{1,2} [A-Za-z]{3,9} \d{4}|[A-Za-z]{3,9} \d{1,2},? \d{4})", 1)
    day = F.when(day != "", day)
    first, second = ("d/M/y", "M/d/y") if dayfirst else ("M/d/y", "d/M/y")
    tries = [F.try_to_date(day, f) for f in ("y-M-d", first, "d MMM y", "d MMMM y", "MMM d, y", "MMMM d, y", "MMM d y", "MMMM d y", second)]
    number = F.when(t.rlike(r"^\d{5,6}(\.0)?$"), F.regexp_extract(t, r"^(\d+)", 1).cast("int"))
    serial = F.when(number >= serial_from, F.date_add(F.lit("1899-12-30").cast("date"), number))
    return F.coalesce(serial, *tries)


def hash_id(c: Column, algo: str = "sha256") -> Column:
    """A pseudonym: S_ and 12 digits of SHA-256 of the folded text, or S and 8 of SHA-1 as it is; blank gives ''."""
    t = F.trim(F.coalesce(c.cast("string"), F.lit("")))
    made = F.concat(F.lit("S_"), F.substring(F.sha2(F.lower(t), 256), 1, 12)) if algo == "sha256" else F.concat(F.lit("S"), F.substring(F.sha1(t), 1, 8))
    return F.when(t == "", F.lit("")).otherwise(made)


def season(d: Column) -> Column:
    m = F.month(d)
    return F.when(m.isin(12, 1, 2), "winter").when(m.isin(3, 4, 5), "spring").when(m.isin(6, 7, 8), "summer").when(m.isNotNull(), "autumn")


def term_flag(d: Column, months: Sequence[int] = (1, 2, 3, 4, 5, 6, 7, 9, 10, 11, 12)) -> Column:
    return F.month(d).isin(*months)


def application_type(c: Column) -> Column:
    """0 if the text holds three groups of four digits, 1 for another text, null if blank."""
    t = F.trim(c.cast("string"))
    return F.when(t != "", F.when(t.rlike(r"\b\d{4}[- ]\d{4}[- ]\d{4}\b"), 0).otherwise(1))


def truthy(c: Column) -> Column:
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin(*TRUTHY), F.lit(False))


def unknown(c: Column) -> Column:
    return F.coalesce(null_tokens(c), F.lit("Unknown"))


def clip(c: Column, low: float | None = None, high: float | None = None) -> Column:
    """Bounds that leave a null null."""
    out = c if low is None else F.greatest(c, F.lit(low))
    out = out if high is None else F.least(out, F.lit(high))
    return F.when(c.isNotNull(), out)


def days(a: Column, b: Column) -> Column:
    """Days from a to b."""
    return F.datediff(b, a)


def time_interval(a: Column, b: Column, unit: str = "days") -> Column:
    per = {"days": 86400, "hours": 3600, "minutes": 60, "seconds": 1}
    if unit not in per:
        raise ValueError(f"unit is one of {', '.join(per)}, not {unit!r}")
    seconds = F.unix_micros(b.cast("timestamp")) / 1e6 - F.unix_micros(a.cast("timestamp")) / 1e6
    return F.floor(seconds / 86400).cast("double") if unit == "days" else seconds / per[unit]


def calendar(df: DataFrame, d: str) -> DataFrame:
    c = F.col(d)
    return df.withColumns(
        {
            "year": F.year(c),
            "month": F.month(c),
            "dow": F.weekday(c),
            "week": F.weekofyear(c),
            "is_month_start": (F.dayofmonth(c) == 1).cast("int"),
            "is_month_end": (c == F.last_day(c)).cast("int"),
        }
    )


def fourier(df: DataFrame, d: str) -> DataFrame:
    """Annual sine and cosine, and a dummy for each weekday but the first."""
    angle = 2 * F.pi() * F.dayofyear(d) / 365.25
    return df.withColumns({"sin_year": F.sin(angle), "cos_year": F.cos(angle)} | {f"dow_{k}": (F.weekday(d) == k).cast("int") for k in range(1, 7)})


#: The labels of the bands.
def fte_band(c: Column) -> Column:
    return F.when(c >= 0.8, "FT_0_8_to_1_0").when(c >= 0.5, "PT_0_5_to_0_8").when(c > 0, "PT_lt_0_5").otherwise("Unknown_FTE")


def band(c: Column, edges: Sequence[float], labels: Sequence[str], right: bool = False) -> Column:
    """The label of the interval that holds the value: [a, b), or (a, b] with right."""
    out = None
    for a, b, label in zip(edges, edges[1:], labels, strict=False):
        inside = ((c > a) & (c <= b)) if right else ((c >= a) & (c < b))
        out = F.when(inside, label) if out is None else out.when(inside, label)
    return out


def age_years(dob: Column, at: Column, whole: bool = False) -> Column:
    years = F.datediff(at, dob) / 365.25
    return F.greatest(F.round(years), F.lit(0)).cast("int") if whole else years


def derived_key(case_no: Column, received: Column, unique_id: Column) -> Column:
    """case number and day, else the unique id."""
    return F.when(
        case_no.isNotNull() & received.isNotNull(), F.concat_ws("_", case_no.cast("string"), F.date_format(received, "yyyyMMdd"))
    ).otherwise(unique_id.cast("string"))


def valid_delay(a: Column, b: Column) -> Column:
    """Days from a to b; null if one is missing or a comes after b."""
    return F.when(a <= b, F.datediff(b, a))


def text_flags(*texts: Column) -> dict[str, Column]:
    """Keyword events in the joined texts; words are bounded."""
    t = F.lower(F.concat_ws(" ", *(F.coalesce(x.cast("string"), F.lit("")) for x in texts)))
    return {
        "event_legal": t.rlike(r"\blegal\b|solicitor|attorney|advice"),
        "event_court": t.rlike(r"\bcourt\b|hearing|tribunal"),
        "event_flagged": t.rlike(r"\bflag|priority|escalat"),
    }


def bank_holiday(d: Column, holidays: Sequence[str]) -> Column:
    return d.isin(*(F.lit(h).cast("date") for h in holidays)) if holidays else F.lit(False)


def ratio_feature(df: DataFrame, num: str, den: str, power: float, name: str) -> DataFrame:
    """num / den ** power, without rows where it is undefined."""
    return df.withColumn(name, F.try_divide(F.col(num).cast("double"), F.pow(F.col(den).cast("double"), F.lit(power)))).dropna(subset=[name])


def month_spine(spark, first: str, last: str) -> DataFrame:
    """Months from first to last (YYYY-MM, quotes allowed), with their last day."""
    a, b = (m.strip().strip("'\"") for m in (first, last))
    if a > b:
        raise ValueError(f"{a} comes after {b}")
    months = F.explode(F.sequence(F.lit(f"{a}-01").cast("date"), F.lit(f"{b}-01").cast("date"), F.expr("INTERVAL 1 MONTH")))
    return spark.range(1).select(months.alias("month")).select("month", F.last_day("month").alias("month_end"))


def coalesce_status(rules: Sequence[tuple[Column, str]], default: str | None = None) -> Column:
    """The label of the first rule that holds, capitalised."""
    out = None
    for cond, label in rules:
        out = F.when(cond, F.initcap(F.lit(label))) if out is None else out.when(cond, F.initcap(F.lit(label)))
    return out.otherwise(F.lit(default))
