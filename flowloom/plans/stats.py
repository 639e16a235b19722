"""Queries of the statistics (Q*)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import stats as op
from ..views import cases, table
from .aggregates import rounded, timed
from .registry import query
from .tables import DAILY, daily

LI = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
RANKS = """d AS (SELECT *, dt_signoff - dt_alloc AS days FROM cases WHERE dt_signoff IS NOT NULL),
r AS (SELECT *, rank() OVER (ORDER BY {0}) + (count(*) OVER (PARTITION BY {0}) - 1) / 2.0::DOUBLE AS ra, rank() OVER (ORDER BY {1}) + (count(*) OVER (PARTITION BY {1}) - 1) / 2.0::DOUBLE AS rb FROM d)"""


def cells(x: str, y: str, src: str) -> str:
    return f"""n AS (SELECT {x} AS x, {y} AS y, count(*) AS n FROM {src} WHERE {x} IS NOT NULL AND {y} IS NOT NULL GROUP BY ALL),
rr AS (SELECT x, sum(n) AS r FROM n GROUP BY 1), cc AS (SELECT y, sum(n) AS c FROM n GROUP BY 1), t AS (SELECT sum(n)::DOUBLE AS t FROM n),
ch AS (SELECT sum(pow(coalesce(n.n, 0) - r * c / t, 2) / (r * c / t)) AS chi2, sum(pow(greatest(abs(coalesce(n.n, 0) - r * c / t) - 0.5, 0), 2) / (r * c / t)) AS yates, count(DISTINCT rr.x) AS nr, count(DISTINCT cc.y) AS nc, max(t) AS t
  FROM rr CROSS JOIN cc CROSS JOIN t LEFT JOIN n ON n.x = rr.x AND n.y = cc.y)"""


V = "sqrt(greatest(0, chi2 / t - (nc - 1) * (nr - 1) / (t - 1)) / (least(nc - pow(nc - 1, 2) / (t - 1), nr - pow(nr - 1, 2) / (t - 1)) - 1))"


@query(
    "q1_corr_matrix",
    " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM lineitem" for i, a in enumerate(LI) for b in LI[i + 1 :]),
    cases=False,
)
def q1(spark: SparkSession, d: str) -> DataFrame:
    return rounded(op.corr_matrix(table(spark, d, "lineitem"), LI))


@query("q2_spearman", f"WITH {RANKS.format('days', 'weighting')} SELECT round(corr(ra, rb), 6) AS r FROM r")
def q2(spark: SparkSession, d: str) -> DataFrame:
    return rounded(op.spearman(timed(spark, d), "days", "weighting"))


#: Columns of lineitem, two of them with nulls.
HOLED = {"qty": "l_quantity", "price": "l_extendedprice", "disc": "CASE WHEN l_linenumber % 3 <> 0 THEN l_discount END", "tax": "CASE WHEN l_linenumber % 2 = 0 THEN l_tax END"}


def pair_sql(a: str, b: str) -> str:
    rank = lambda c: f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0::DOUBLE"
    return f"""SELECT '{a}' AS a, '{b}' AS b, round(corr(ra, rb), 6) AS r, count(*) AS n
FROM (SELECT {rank(a)} AS ra, {rank(b)} AS rb FROM h WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"""


@query(
    "q2_spearman_matrix",
    f"WITH h AS (SELECT {', '.join(f'{v} AS {k}' for k, v in HOLED.items())} FROM lineitem)\n"
    + " UNION ALL ".join(pair_sql(a, b) for i, a in enumerate(HOLED) for b in list(HOLED)[i + 1 :]),
    cases=False,
)
def q2_matrix(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "lineitem").select(*(F.expr(v).alias(k) for k, v in HOLED.items()))
    return rounded(op.spearman_matrix(h, list(HOLED)))


@query("q3_redundant", "SELECT 'l_quantity' AS a, 'twice' AS b, 1.0::DOUBLE AS r", cases=False)
def q3(spark: SparkSession, d: str) -> DataFrame:
    return rounded(
        op.redundant(table(spark, d, "lineitem").select("l_quantity", (F.col("l_quantity") * 2).alias("twice"), "l_tax"), ["l_quantity", "twice", "l_tax"])
    )


@query("q4_cramers_v", f"WITH {cells('case_type', 'risk', 'cases')} SELECT round({V}, 6) AS v FROM ch")
def q4(spark: SparkSession, d: str) -> DataFrame:
    return rounded(op.cramers_v(cases(spark, d), "case_type", "risk"))


@query(
    "q5_chi2",
    f"WITH {cells('needs_legal_review', 'm', '(SELECT *, (case_id % 4 = 0)::INT AS m FROM cases)')} SELECT round(yates, 6) AS chi2, "
    "1.0::DOUBLE AS dof FROM ch",
)
def q5(spark: SparkSession, d: str) -> DataFrame:
    return rounded(op.chi2(cases(spark, d).withColumn("m", (F.col("case_id") % 4 == 0).cast("int")), "needs_legal_review", "m").select("chi2", "dof"))


@query(
    "q6_association_rank",
    f"WITH {cells('risk', 'needs_legal_review', 'cases')} SELECT 'risk' AS feature, 'category' AS kind, round({V}, 6) AS strength FROM ch "
    "UNION ALL SELECT 'weighting', 'number', round(abs(corr(weighting, needs_legal_review)), 6) FROM cases UNION ALL SELECT 'fte', 'number', "
    "round(abs(corr(fte, needs_legal_review)), 6) FROM cases",
)
def q6(spark: SparkSession, d: str) -> DataFrame:
    return rounded(op.association_rank(cases(spark, d), "needs_legal_review", ["weighting", "fte"], ["risk"]))


@query(
    "q7_ks_2samp",
    """WITH n AS (SELECT dt_signoff - dt_alloc AS v, count(*) FILTER (WHERE needs_legal_review = 0) AS a, count(*) FILTER (WHERE needs_legal_review = 1) AS b FROM cases WHERE dt_signoff IS NOT NULL GROUP BY 1),
c AS (SELECT sum(a) OVER (ORDER BY v) / sum(a) OVER () AS fa, sum(b) OVER (ORDER BY v) / sum(b) OVER () AS fb, sum(a) OVER () AS n1, sum(b) OVER () AS n2 FROM n) SELECT round(max(abs(fa - fb)), 6) AS d, max(n1)::BIGINT AS n1, max(n2)::BIGINT AS n2 FROM c""",
)
def q7(spark: SparkSession, d: str) -> DataFrame:
    return rounded(op.ks_2samp(timed(spark, d), "days", "needs_legal_review"))


@query(
    "q8_t_test",
    """WITH g AS (SELECT needs_legal_review AS g, count(*) AS n, avg(dt_signoff - dt_alloc) AS m, var_samp(dt_signoff - dt_alloc) AS v FROM cases WHERE dt_signoff IS NOT NULL GROUP BY 1)
SELECT round((a.m - b.m) / sqrt(((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2) * (1 / a.n + 1 / b.n)), 6) AS t, (a.n + b.n - 2)::DOUBLE AS dof FROM g a, g b WHERE a.g = 0 AND b.g = 1""",
)
def q8(spark: SparkSession, d: str) -> DataFrame:
    return rounded(op.t_test(timed(spark, d), "days", "needs_legal_review").select("t", "dof"))


@query(
    "q9_rank_sum",
    f"""WITH {RANKS.format('days', 'days')}, s AS (SELECT sum(ra) FILTER (WHERE needs_legal_review = 0) AS r0, count(*) FILTER (WHERE needs_legal_review = 0)::DOUBLE AS n0, count(*) FILTER (WHERE needs_legal_review = 1)::DOUBLE AS n1 FROM r),
t AS (SELECT sum(pow(k, 3) - k) AS t FROM (SELECT count(*) AS k FROM d GROUP BY days))
SELECT round(r0 - n0 * (n0 + 1) / 2, 6) AS u, round((r0 - n0 * (n0 + 1) / 2 - n0 * n1 / 2) / sqrt(n0 * n1 / 12 * ((n0 + n1 + 1) - t / ((n0 + n1) * (n0 + n1 - 1)))), 6) AS z FROM s, t""",
)
def q9(spark: SparkSession, d: str) -> DataFrame:
    return rounded(op.rank_sum(timed(spark, d), "days", "needs_legal_review").select("u", "z"))


def cmi_sql(src: str) -> str:
    cut = lambda c: f"CASE WHEN max({c}) OVER () > min({c}) OVER () THEN least(floor(({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()) * 8), 7) ELSE 0 END AS {c}"
    return f"""b AS (SELECT {cut('x')}, {cut('y')}, {cut('z')} FROM ({src})), n AS (SELECT x, y, z, count(*)::DOUBLE AS n FROM b GROUP BY ALL),
w AS (SELECT n, sum(n) OVER (PARTITION BY z) AS nz, sum(n) OVER (PARTITION BY x, z) AS nxz, sum(n) OVER (PARTITION BY y, z) AS nyz, sum(n) OVER () AS t FROM n) SELECT round(sum(n / t * ln(n * nz / (nxz * nyz))), 6) AS nats FROM w"""


@query("q10_cmi", f"WITH {cmi_sql('SELECT l_quantity::DOUBLE AS x, l_extendedprice::DOUBLE AS y, l_discount::DOUBLE AS z FROM lineitem')}", cases=False)
def q10(spark: SparkSession, d: str) -> DataFrame:
    return rounded(op.cmi(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice", "l_discount"))


@query(
    "q11_transfer_entropy",
    f"WITH {DAILY}, "
    f"{cmi_sql('SELECT * FROM (SELECT lag(n) OVER (ORDER BY day)::DOUBLE AS x, v::DOUBLE AS y, lag(v) OVER (ORDER BY day)::DOUBLE AS z FROM e) WHERE x IS NOT NULL')}",
    cases=False,
)
def q11(spark: SparkSession, d: str) -> DataFrame:
    return rounded(op.transfer_entropy(daily(spark, d), "n", "v", "day"))


@query("q12_granger")
def q12(spark: SparkSession, d: str) -> DataFrame:
    return op.granger(daily(spark, d), "n", "v", "day", 2)


@query(
    "q13_iv_2sls",
    "SELECT round(covar_samp(l_discount, l_extendedprice) / covar_samp(l_discount, l_quantity), 4) AS effect, round(pow(corr(l_discount, "
    "l_quantity), 2) / (1 - pow(corr(l_discount, l_quantity), 2)) * (count(*) - 2), 4) AS first_stage_f FROM lineitem",
    cases=False,
)
def q13(spark: SparkSession, d: str) -> DataFrame:
    r = op.iv_2sls(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice", "l_discount")
    return r.select(*(F.round(c, 4).alias(c) for c in r.columns))


@query(
    "q14_ols",
    "SELECT 'const' AS term, round(regr_intercept(l_extendedprice, l_quantity), 3) AS coef FROM lineitem UNION ALL SELECT 'l_quantity', "
    "round(regr_slope(l_extendedprice, l_quantity), 3) FROM lineitem",
    cases=False,
)
def q14(spark: SparkSession, d: str) -> DataFrame:
    return op.ols(table(spark, d, "lineitem"), "l_extendedprice", ["l_quantity"]).select("term", F.round("coef", 3).alias("coef"))


@query(
    "q14_did",
    "SELECT round((SELECT avg(dt_alloc - dt_received) FROM cases WHERE dt_received >= DATE '1998-01-01' "
    "AND team = 'T1') - (SELECT avg(dt_alloc - dt_received) FROM cases WHERE dt_received >= DATE '1998-01-01' "
    "AND team <> 'T1') - (SELECT avg(dt_alloc - dt_received) FROM cases WHERE dt_received < DATE '1998-01-01' "
    "AND team = 'T1') + (SELECT avg(dt_alloc - dt_received) FROM cases WHERE dt_received < DATE '1998-01-01' AND team <> 'T1'), 4) AS effect",
)
def q14d(spark: SparkSession, d: str) -> DataFrame:
    c = timed(spark, d).select(
        "wait", (F.col("dt_received") >= F.lit("1998-01-01").cast("date")).cast("int").alias("post"), (F.col("team") == "T1").cast("int").alias("treated")
    ).withColumn("both", F.col("post") * F.col("treated"))
    return op.ols(c, "wait", ["post", "treated", "both"]).where("term = 'both'").select(F.round("coef", 4).alias("effect"))


@query(
    "q16_vif",
    "SELECT f AS feature, round(1 / (1 - pow(corr(l_quantity, l_extendedprice), 2)), 4) AS vif FROM lineitem, (SELECT unnest(['l_quantity', "
    "'l_extendedprice']) AS f) GROUP BY 1",
    cases=False,
)
def q16(spark: SparkSession, d: str) -> DataFrame:
    return op.vif(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice"]).withColumn("vif", F.round("vif", 4))


@query(
    "q17_km_quantiles",
    """WITH d AS (SELECT case_type, coalesce(dt_signoff, DATE '2001-12-31') - dt_alloc AS t, (dt_signoff IS NOT NULL)::INT AS e FROM cases WHERE dt_alloc IS NOT NULL),
n AS (SELECT case_type, t, count(*) AS n, sum(e) AS d FROM d GROUP BY ALL), r AS (SELECT *, sum(n) OVER (PARTITION BY case_type ORDER BY t DESC) AS risk FROM n),
s AS (SELECT *, CASE WHEN min(1 - d / risk) OVER w <= 0 THEN 0 ELSE exp(sum(CASE WHEN d < risk THEN ln(1 - d / risk) ELSE 0 END) OVER w) END AS s FROM r WINDOW w AS (PARTITION BY case_type ORDER BY t))
SELECT case_type, sum(n)::BIGINT AS n, sum(d)::BIGINT AS events, min(t) FILTER (WHERE s <= 0.9 + 1e-12)::DOUBLE AS q10, min(t) FILTER (WHERE s <= 0.75 + 1e-12)::DOUBLE AS q25, min(t) FILTER (WHERE s <= 0.5 + 1e-12)::DOUBLE AS q50, min(t) FILTER (WHERE s <= 0.25 + 1e-12)::DOUBLE AS q75, min(t) FILTER (WHERE s <= 0.1 + 1e-12)::DOUBLE AS q90 FROM s GROUP BY 1""",
)
def q17(spark: SparkSession, d: str) -> DataFrame:
    c = cases(spark, d).where("dt_alloc IS NOT NULL").select(
        "case_type", F.datediff(F.coalesce("dt_signoff", F.lit("2001-12-31").cast("date")), "dt_alloc").alias("t"), F.col("dt_signoff").isNotNull().alias("e")
    )
    return op.km_quantiles(c, "t", "e", ["case_type"])


@query(
    "q18_change_point",
    """WITH y AS (SELECT year(dt_received)::INT AS period, count(*)::DOUBLE AS n FROM cases GROUP BY 1), w AS (SELECT period, row_number() OVER (ORDER BY period) AS k, sum(n) OVER (ORDER BY period) AS s, sum(n) OVER () AS t, count(*) OVER () AS m FROM y),
l AS (SELECT period, s * ln(s / k) + (t - s) * ln((t - s) / (m - k)) AS ll FROM w WHERE k < m) SELECT period, round(-ll, 4) AS cost, round(exp(ll - max(ll) OVER ()) / sum(exp(ll - (SELECT max(ll) FROM l))) OVER (), 6) AS posterior FROM l""",
)
def q18(spark: SparkSession, d: str) -> DataFrame:
    y = cases(spark, d).groupBy(F.year("dt_received").alias("period")).agg(F.count("*").alias("n"))
    return op.change_point(y, "period", "n").select("period", F.round("cost", 4).alias("cost"), F.round("posterior", 6).alias("posterior"))


@query(
    "q19_mean_shift",
    "WITH g AS (SELECT needs_legal_review AS g, count(*) AS n, avg(dt_alloc - dt_received) AS m, var_samp(dt_alloc - dt_received) AS v "
    "FROM cases WHERE dt_alloc IS NOT NULL GROUP BY 1) SELECT round(b.m - a.m, 6) AS shift, round(sqrt(a.v / a.n + b.v / b.n), 6) AS sd "
    "FROM g a, g b WHERE a.g = 0 AND b.g = 1",
)
def q19(spark: SparkSession, d: str) -> DataFrame:
    return rounded(op.mean_shift(timed(spark, d), "wait", "needs_legal_review").select("shift", "sd"))


MONTHS = "mm AS (SELECT date_trunc('month', dt_received)::DATE AS m, count(*)::DOUBLE AS x FROM cases GROUP BY 1)"


def monthly(spark: SparkSession, d: str) -> DataFrame:
    return cases(spark, d).groupBy(F.trunc("dt_received", "month").alias("m")).agg(F.count("*").cast("double").alias("x"))


@query(
    "q20_decompose",
    f"""WITH {MONTHS}, t AS (SELECT m, x, row_number() OVER (ORDER BY m) - 1 AS k, CASE WHEN count(x) OVER w = 13 THEN (sum(x) OVER w - (lag(x, 6) OVER (ORDER BY m) + lead(x, 6) OVER (ORDER BY m)) / 2) / 12 END AS trend FROM mm WINDOW w AS (ORDER BY m ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING)),
s AS (SELECT k % 12 AS pos, avg(x - trend) AS s FROM t GROUP BY 1), c AS (SELECT pos, s - avg(s) OVER () AS seasonal FROM s)
SELECT m, x, round(trend, 6) AS trend, round(seasonal, 6) AS seasonal, round(x - trend - seasonal, 6) AS residual FROM t JOIN c ON k % 12 = pos""",
)
def q20(spark: SparkSession, d: str) -> DataFrame:
    return rounded(op.decompose(monthly(spark, d), "m", "x", 12))


@query(
    "q21_acf",
    f"WITH {MONTHS}, c AS (SELECT m, x - avg(x) OVER () AS x FROM mm), l AS (SELECT x, lag(x, 1) OVER (ORDER BY m) AS l1, lag(x, "
    "2) OVER (ORDER BY m) AS l2 FROM c) SELECT 1 AS lag, round(sum(x * l1) / sum(x * x), 6) AS r, count(*) AS n FROM l UNION ALL SELECT 2, "
    "round(sum(x * l2) / sum(x * x), 6), count(*) FROM l",
)
def q21(spark: SparkSession, d: str) -> DataFrame:
    return rounded(op.acf(monthly(spark, d), "m", "x", 2))


@query(
    "q21_ljung_box",
    f"WITH {MONTHS}, c AS (SELECT m, x - avg(x) OVER () AS x FROM mm), l AS (SELECT x, lag(x, 1) OVER (ORDER BY m) AS l1, lag(x, "
    "2) OVER (ORDER BY m) AS l2 FROM c) SELECT round(count(*) * (count(*) + 2) * (pow(sum(x * l1) / sum(x * x), "
    "2) / (count(*) - 1) + pow(sum(x * l2) / sum(x * x), 2) / (count(*) - 2)), 6) AS q FROM l",
)
def q21l(spark: SparkSession, d: str) -> DataFrame:
    return rounded(op.ljung_box(monthly(spark, d), "m", "x", 2).select("q"))


@query(
    "q21_adf_stat",
    f"WITH {MONTHS}, l AS (SELECT x - lag(x) OVER (ORDER BY m) AS dx, lag(x) OVER (ORDER BY m) AS lv FROM mm) SELECT round(regr_slope(dx, lv), "
    "6) AS coef FROM l WHERE lv IS NOT NULL",
)
def q21a(spark: SparkSession, d: str) -> DataFrame:
    return rounded(op.adf_stat(monthly(spark, d), "m", "x").select("coef"))


SCORES = "p AS (SELECT doc_id, toxic AS y, (doc_id * 37 % 101 + 40 * toxic) / 141.0::DOUBLE AS p FROM labels)"


def scores(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "labels").select("doc_id", F.col("toxic").alias("y"), ((F.col("doc_id") * 37 % 101 + 40 * F.col("toxic")) / 141.0).alias("p"))


@query(
    "q22_calibration",
    f"WITH {SCORES} SELECT least(floor(p * 10), 9)::INT AS bin, round(avg(p), 6) AS mean_predicted, round(avg(y), 6) AS fraction_positive, "
    "count(*) AS n FROM p GROUP BY 1",
    cases=False,
)
def q22(spark: SparkSession, d: str) -> DataFrame:
    return rounded(op.calibration(scores(spark, d), "y", "p"))


@query(
    "q23_class_metrics",
    f"""WITH {SCORES}, r AS (SELECT *, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0::DOUBLE AS rk FROM p), a AS (SELECT (sum(rk) FILTER (WHERE y = 1) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))) AS auc FROM r),
s AS (SELECT p, sum(y) AS pos, sum(sum(y)) OVER (ORDER BY p DESC) AS tp, sum(count(*)) OVER (ORDER BY p DESC) AS n FROM p GROUP BY p), ap AS (SELECT sum(pos * tp / n) / sum(pos) AS ap FROM s),
b AS (SELECT arg_max(-p, {{'f': 2 * tp / (n + t), 'p': -p}}) AS low, max(2 * tp / (n + t)) AS best FROM s, (SELECT sum(y)::DOUBLE AS t FROM p)),
c AS (SELECT avg(pow(p - y, 2)) AS brier, count(*) FILTER (WHERE p >= 0.5 AND y = 1) AS tp, count(*) FILTER (WHERE p >= 0.5 AND y = 0) AS fp, count(*) FILTER (WHERE p < 0.5 AND y = 1) AS fn, count(*) FILTER (WHERE p < 0.5 AND y = 0) AS tn FROM p)
SELECT round(auc, 6) AS auc, round(ap, 6) AS average_precision, round(brier, 6) AS brier, tp, fp, fn, tn, round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round(-low, 6) AS best_threshold, round(best, 6) AS best_f1 FROM a, ap, b, c""",
    cases=False,
)
def q23(spark: SparkSession, d: str) -> DataFrame:
    return rounded(op.class_metrics(scores(spark, d), "y", "p"))


@query(
    "q24_reg_metrics",
    """WITH e AS (SELECT l_extendedprice AS y, 1500 * l_quantity AS p, 1000 * l_quantity + 10000 AS v FROM lineitem)
SELECT round(avg(abs(y - p)), 4) AS mae, round(avg(pow(y - p, 2)), 1) AS mse, round(sqrt(avg(pow(y - p, 2))), 4) AS rmse, round(sqrt(avg(pow(ln(1 + y) - ln(1 + p), 2))), 6) AS rmsle,
  round(avg(abs(y - p) / abs(y)), 6) AS mape, round(avg(2 * abs(y - p) / (abs(y) + abs(p))), 6) AS smape, round(1 - sum(pow(y - p, 2)) / (var_pop(y) * count(*)), 6) AS r2,
  round(sum(pow(y - p, 2)) / (var_pop(y) * count(*)), 6) AS rse, round(sqrt(sum(pow(y - p, 2)) / (count(*) - 2)), 4) AS residual_se, round(avg(abs(y - p)) / avg(abs(y - v)), 6) AS mase FROM e""",
    cases=False,
)
def q24(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "lineitem").select(
        F.col("l_extendedprice").alias("y"), (1500 * F.col("l_quantity")).alias("p"), (1000 * F.col("l_quantity") + 10000).alias("v")
    )
    m = op.reg_metrics(e, "y", "p", "v")
    return m.select(*(F.round(c, 1 if c == "mse" else 4 if c in ("mae", "rmse", "residual_se") else 6).alias(c) for c in m.columns))


@query(
    "q25_chow",
    f"""WITH {MONTHS}, s AS (SELECT datediff('day', DATE '1995-01-01', m)::DOUBLE AS t, x, m < DATE '1998-01-01' AS l FROM mm), f AS (SELECT l, regr_syy(x, t) - pow(regr_sxy(x, t), 2) / regr_sxx(x, t) AS r, count(*) AS n FROM s GROUP BY 1), p AS (SELECT regr_syy(x, t) - pow(regr_sxy(x, t), 2) / regr_sxx(x, t) AS r FROM s)
SELECT round((p.r - sum(f.r)) / 2 / (sum(f.r) / (sum(f.n) - 4)), 4) AS f FROM f, p GROUP BY p.r""",
)
def q25(spark: SparkSession, d: str) -> DataFrame:
    s = monthly(spark, d).withColumn("t", F.datediff("m", F.lit("1995-01-01").cast("date")).cast("double")).withColumn("cut", F.col("m"))
    return op.chow(s, "x", ["t"], "cut", "1998-01-01").select(F.round("f", 4).alias("f"))


@query(
    "q14_trend_by",
    """WITH s AS (SELECT case_type, region, datediff('day', DATE '1995-01-01', dt_alloc)::DOUBLE AS t, (dt_signoff - dt_alloc)::DOUBLE AS y FROM cases WHERE dt_signoff IS NOT NULL)
SELECT case_type, count(*) AS n, round(regr_slope(y, t), 8) AS slope, round(regr_intercept(y, t), 4) AS intercept, round(regr_r2(y, t), 8) AS r2,
  round(sqrt((regr_syy(y, t) - pow(regr_sxy(y, t), 2) / regr_sxx(y, t)) / (count(*) - 2) / regr_sxx(y, t)), 8) AS se FROM s GROUP BY 1""",
)
def q14_trend(spark: SparkSession, d: str) -> DataFrame:
    c = cases(spark, d).select("case_type", F.datediff("dt_alloc", F.lit("1995-01-01").cast("date")).alias("t"), F.datediff("dt_signoff", "dt_alloc").alias("y"))
    m = op.trend_by(c, ["case_type"], "t", "y")
    return m.select("case_type", "n", F.round("slope", 8).alias("slope"), F.round("intercept", 4).alias("intercept"), F.round("r2", 8).alias("r2"), F.round("se", 8).alias("se"))
