"""Statistics. Row work is aggregates in Spark; k x k matrices and test distributions finish on the driver."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .scans import WHOLE, grouped_quantiles, kept, lagged, meet, over_rows, running
from .windows import guarded_corr

# ---- distributions on the driver


def betainc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - betainc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or tiny)
    h = d
    for m in range(1, 1000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d or tiny)
            c = 1 + num / c or tiny
            h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * h


def _log1p_less(d: np.ndarray) -> np.ndarray:
    """log(1 + d) - d without loss of digits near zero."""
    near = np.abs(d) < 0.01
    x = np.where(near, d, 0.0)
    series = -x * x * sum((-x) ** k / (k + 2) for k in range(10))
    return np.where(near, series, np.log1p(d) - d)


#: Shapes from here on are integrated: series and continued fractions need more terms the larger the shape.
LARGE = 10_000.0
_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(24)


def _gamma_between(a: float, low: float, high: float) -> float:
    """Mass of a gamma distribution of shape a >= LARGE between low and high standard deviations from a."""
    edges = np.linspace(low, high, max(2, math.ceil(2 * (high - low)) + 1))
    half = np.diff(edges) / 2
    z = (edges[:-1] + half)[:, None] + half[:, None] * _NODES
    d = z / math.sqrt(a)
    stirling = 1 / (12 * a) - 1 / (360 * a**3)
    density = np.exp(a * _log1p_less(d) - np.log1p(d) - stirling) / math.sqrt(2 * math.pi)
    return float((density * _WEIGHTS * half[:, None]).sum())


def gammaincc(a: float, x: float) -> float:
    """Upper regularised incomplete gamma function: series, continued fraction, and for large shapes quadrature about the mode."""
    if x <= 0:
        return 1.0
    if a >= LARGE:
        z = (x - a) / math.sqrt(a)
        if abs(z) > 38:  # the tail beyond is less than the least double
            return 0.0 if z > 0 else 1.0
        return _gamma_between(a, z, z + 14) if z > 0 else 1 - _gamma_between(a, max(z - 14, -math.sqrt(a) * 0.999), z)
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term, total, n = 1 / a, 1 / a, 0
        while term >= total * 1e-17:
            n += 1
            term *= x / (a + n)
            total += term
        return 1 - total * front
    b, c = x + 1 - a, 1e300
    d = h = 1 / b
    n, step = 0, 0.0
    while abs(step - 1) >= 1e-15:
        n += 1
        an = -n * (n - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        step = d * c
        h *= step
    return front * h


def p_f(f: float, d1: float, d2: float) -> float:
    return betainc(d2 / 2, d1 / 2, d2 / (d2 + d1 * f)) if f > 0 else 1.0


def p_t(t: float, dof: float) -> float:
    return betainc(dof / 2, 0.5, dof / (dof + t * t))


def p_normal(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def _row(df: DataFrame, values: dict) -> DataFrame:
    return df.sparkSession.createDataFrame(
        [tuple(None if v is None or v != v else float(v) for v in values.values())], ", ".join(f"`{k}` double" for k in values)
    )


# ---- association


def corr_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """a, b, r for each pair a < b by position: pairwise complete, one aggregate; null for constants."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1 :]]
    row = df.agg(
        *(
            guarded_corr(F.when(F.col(b).isNotNull(), F.col(a).cast("double")), F.when(F.col(a).isNotNull(), F.col(b).cast("double"))).alias(f"r{k}")
            for k, (a, b) in enumerate(pairs)
        )
    )
    return row.select(
        F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{k}").alias("r")) for k, (a, b) in enumerate(pairs)))).alias("x")
    ).select("x.*")


def average_ranks(df: DataFrame, c: str) -> DataFrame:
    """v_, rank_: the average rank of each distinct value, from counts by value."""
    n = df.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("v_")).agg(F.count("*").alias("n_"))
    return running(n, "v_", ["n_"]).select("v_", (F.col("to_n_") - (F.col("n_") - 1) / 2).alias("rank_"))


def spearman_matrix(df: DataFrame, cols: Sequence[str], whole: int = WHOLE) -> DataFrame:
    """a, b, r, n for each pair a < b by position: Pearson correlation of average ranks among the rows that have both; null for constants.

    A value's rank in a pair counts the rows that have the pair's other column, so a value has as many
    ranks as there are columns. Equal rows are counted first. Columns are unpivoted and ranked by range
    parts of their own, all in one pass; values that a hundredth of all rows hold, a hundred a column at
    most, come back by broadcast, others by a join. The number of shuffles doesn't grow with the columns.
    """
    cols, k = list(cols), len(cols)
    clean = [F.nanvl(F.col(c).cast("double"), F.lit(None)).alias(f"c{i}") for i, c in enumerate(cols)]
    names = [f"c{i}" for i in range(k)]
    d = kept(df.select(*clean).groupBy(*names).agg(F.count("*").alias("w")).withColumn("id", F.monotonically_increasing_id()), "rows")
    has = [F.when(F.col(c).isNotNull(), F.col("w")).otherwise(0).alias(f"n{j}") for j, c in enumerate(names)]
    cells = F.array(*(F.struct(F.lit(i).alias("c"), F.col(n).alias("v")) for i, n in enumerate(names)))
    u = d.select("id", "w", *has, F.explode(cells).alias("x")).select("id", "w", *(f"n{j}" for j in range(k)), "x.c", "x.v").where("v IS NOT NULL")
    counts = u.groupBy("c", "v").agg(*(F.sum(f"n{j}").alias(f"n{j}") for j in range(k)), F.sum("w").alias("rows"))
    ranked = running(counts, "v", [f"n{j}" for j in range(k)], by=["c"], own_parts=True, whole=whole)
    ranks = F.array(*(F.when(F.col(f"n{j}") > 0, F.col(f"to_n{j}") - (F.col(f"n{j}") - 1) / 2) for j in range(k)))
    ranked = kept(ranked.select("c", "v", "rows", ranks.alias("ranks")), "ranks")
    total = d.agg(F.sum("w")).first()[0] or 0
    hot = ranked.where(F.col("rows") > max(total / 100, 1)).select("c", "v", F.col("ranks").alias("hot"))
    met = u.select("id", "c", "v").join(F.broadcast(hot), ["c", "v"], "left")
    rest = met.where("hot IS NULL").select("id", "c", "v").join(ranked.select("c", "v", "ranks"), ["c", "v"])
    both = rest.select("id", "c", "ranks").unionAll(met.where("hot IS NOT NULL").select("id", "c", F.col("hot").alias("ranks")))
    back = both.groupBy("id").agg(*(F.max(F.when(F.col("c") == i, F.col("ranks"))).alias(f"r{i}") for i in range(k))).join(d.select("id", "w"), "id")
    pairs = [(i, j) for i in range(k) for j in range(i + 1, k)]
    sums = d.agg(*(F.sum(F.when(F.col(names[i]).isNotNull() & F.col(names[j]).isNotNull(), F.col("w"))).alias(f"m{i}_{j}") for i, j in pairs)).first()
    out = []
    for i, j in pairs:
        n = sums[f"m{i}_{j}"] or 0
        x, y = (F.get(f"r{a}", F.lit(b)) - (n + 1) / 2 for a, b in ((i, j), (j, i)))  # ranks about their mean
        x, y = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
        xy, xx, yy = (F.sum(F.col("w") * p) for p in (x * y, x * x, y * y))
        r = F.when((xx > 0) & (yy > 0), xy / F.sqrt(xx) / F.sqrt(yy))
        out.append(F.struct(F.lit(cols[i]).alias("a"), F.lit(cols[j]).alias("b"), r.alias("r"), F.lit(n).cast("long").alias("n")).alias(f"p{i}_{j}"))
    row = back.agg(*out)
    return row.select(F.explode(F.array(*(f"p{i}_{j}" for i, j in pairs))).alias("x")).select("x.*")


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row r: Pearson correlation of average ranks among complete pairs."""
    return spearman_matrix(df, [a, b]).select("r")


def redundant(df: DataFrame, cols: Sequence[str], t: float = 0.9) -> DataFrame:
    return corr_matrix(df, cols).where(F.abs("r") > t)


def contingency(df: DataFrame, x: str, y: str) -> DataFrame:
    """x, y, n, row, col, total, expected for every cell, empty ones too."""
    n = df.dropna(subset=[x, y]).groupBy(x, y).agg(F.count("*").alias("n"))
    rows, cols = n.groupBy(x).agg(F.sum("n").alias("row")), n.groupBy(y).agg(F.sum("n").alias("col"))
    total = n.agg(F.sum("n").alias("total"))
    return rows.crossJoin(cols).join(n, [x, y], "left").fillna({"n": 0}).crossJoin(F.broadcast(total)).withColumn(
        "expected", F.col("row") * F.col("col") / F.col("total")
    )


def _chi2(df: DataFrame, x: str, y: str, yates: bool) -> DataFrame:
    c = contingency(df, x, y)
    gap = F.abs(F.col("n") - F.col("expected"))
    cells = c.agg(
        F.count_distinct(x).alias("r"),
        F.count_distinct(y).alias("k"),
        F.max("total").alias("total"),
        F.sum(gap * gap / F.col("expected")).alias("plain"),
        F.sum(F.pow(gap - F.least(F.lit(0.5), gap), 2) / F.col("expected")).alias("corrected"),
    )
    stat = F.when((F.col("r") == 2) & (F.col("k") == 2) & F.lit(yates), F.col("corrected")).otherwise(F.col("plain"))
    return cells.select(stat.alias("chi2"), ((F.col("r") - 1) * (F.col("k") - 1)).alias("dof"), "r", "k", "total")


def chi2(df: DataFrame, x: str, y: str, yates: bool = True) -> DataFrame:
    """chi2, dof, p of independence; Yates' correction for two by two."""
    s = _chi2(df, x, y, yates).first()
    p = gammaincc(s.dof / 2, s.chi2 / 2) if s.chi2 is not None and s.dof else None
    return _row(df, {"chi2": s.chi2, "dof": s.dof, "p": p})


def cramers_v(df: DataFrame, x: str, y: str, corrected: bool = True) -> DataFrame:
    """One row v; corrected: Bergsma's bias correction."""
    s = _chi2(df, x, y, yates=False)
    phi, n = F.col("chi2") / F.col("total"), F.col("total") - 1
    if not corrected:
        return s.select(F.sqrt(F.try_divide(phi, F.least("r", "k") - 1)).alias("v"))
    phi2 = F.greatest(F.lit(0.0), phi - (F.col("k") - 1) * (F.col("r") - 1) / n)
    rc, kc = F.col("r") - F.pow(F.col("r") - 1, 2) / n, F.col("k") - F.pow(F.col("k") - 1, 2) / n
    return s.select(F.sqrt(F.try_divide(phi2, F.least(kc, rc) - 1)).alias("v"))


def association_rank(df: DataFrame, target: str, numbers: Sequence[str], categories: Sequence[str]) -> DataFrame:
    """feature, kind, strength: absolute point-biserial correlation or V with a 0/1 target."""
    out = df.agg(
        *(
            F.abs(guarded_corr(F.when(F.col(target).isNotNull(), F.col(c).cast("double")), F.when(F.col(c).isNotNull(), F.col(target).cast("double")))).alias(c)
            for c in numbers
        )
    )
    out = out.select(
        F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.lit("number").alias("kind"), F.col(c).alias("strength")) for c in numbers))).alias("x")
    ).select("x.*")
    for c in categories:
        out = out.unionByName(cramers_v(df, c, target).select(F.lit(c).alias("feature"), F.lit("category").alias("kind"), F.col("v").alias("strength")))
    return out


def ks_2samp(df: DataFrame, c: str, group: str) -> DataFrame:
    """d, n1, n2: the largest distance of two distribution functions, from counts by value; group holds 0 and 1."""
    n = df.where(F.col(c).isNotNull() & F.col(group).isin(0, 1)).groupBy(F.col(c).alias("v")).agg(
        F.count(F.when(F.col(group) == 0, 1)).alias("a"), F.count(F.when(F.col(group) == 1, 1)).alias("b")
    )
    apart = F.abs(F.col("to_a") / F.col("all_a") - F.col("to_b") / F.col("all_b"))
    return running(n, "v", ["a", "b"]).agg(F.max(apart).alias("d"), F.max("all_a").alias("n1"), F.max("all_b").alias("n2"))


def t_test(df: DataFrame, c: str, group: str) -> DataFrame:
    """t, dof, p with equal variances; group holds 0 and 1."""
    m = {
        r[group]: r
        for r in df.where(F.col(c).isNotNull() & F.col(group).isin(0, 1)).groupBy(group).agg(
            F.count("*").alias("n"), F.avg(c).alias("m"), F.var_samp(c).alias("v")
        ).collect()
    }
    a, b = m[0], m[1]
    dof = a.n + b.n - 2
    pooled = ((a.n - 1) * (a.v or 0) + (b.n - 1) * (b.v or 0)) / dof
    t = (a.m - b.m) / math.sqrt(pooled * (1 / a.n + 1 / b.n)) if pooled > 0 else None
    return _row(df, {"t": t, "dof": dof, "p": None if t is None else p_t(t, dof)})


def rank_sum(df: DataFrame, c: str, group: str) -> DataFrame:
    """u, z, p of the two-sample rank sum, with average ranks and the tie correction."""
    d = df.where(F.col(c).isNotNull() & F.col(group).isin(0, 1)).select(c, group)
    ranks = average_ranks(d, c).select(F.col("v_").alias(c), "rank_")
    s = d.join(ranks, c).agg(
        F.sum(F.when(F.col(group) == 0, F.col("rank_"))).alias("r0"),
        F.count(F.when(F.col(group) == 0, 1)).alias("n0"),
        F.count(F.when(F.col(group) == 1, 1)).alias("n1"),
    ).first()
    ties = d.groupBy(c).agg(F.count("*").alias("k")).agg(F.sum(F.pow("k", 3) - F.col("k")).alias("t")).first().t or 0.0
    n = s.n0 + s.n1
    u = s.r0 - s.n0 * (s.n0 + 1) / 2
    var = s.n0 * s.n1 / 12 * ((n + 1) - ties / (n * (n - 1)))
    z = (u - s.n0 * s.n1 / 2) / math.sqrt(var) if var > 0 else 0.0
    return _row(df, {"u": u, "z": z, "p": p_normal(z)})


def cmi(df: DataFrame, x: str, y: str, z: str, bins: int = 8) -> DataFrame:
    """nats: conditional mutual information of x and y given z, over uniform bins. x and z must differ."""
    if x == z or y == z:
        raise ValueError("a column is not conditioned on itself")
    d = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), F.col(z).cast("double").alias("z")).dropna()
    ends = F.broadcast(d.agg(*(f(c).alias(f"{n}_{c}") for c in "xyz" for f, n in ((F.min, "lo"), (F.max, "hi")))))

    def cut(c: str) -> Column:
        w = F.col(f"hi_{c}") - F.col(f"lo_{c}")
        return F.when(w > 0, F.least(F.floor((F.col(c) - F.col(f"lo_{c}")) / w * bins), F.lit(bins - 1))).otherwise(0).alias(c)

    n = d.crossJoin(ends).select(*(cut(c) for c in "xyz")).groupBy("x", "y", "z").agg(F.count("*").alias("n"))  # at most bins cubed
    part = lambda *k: F.sum("n").over(Window.partitionBy(*k))
    cells = n.select("n", part("z").alias("nz"), part("x", "z").alias("nxz"), part("y", "z").alias("nyz"), part().alias("all"))
    return cells.agg(F.sum(F.col("n") / F.col("all") * F.log(F.col("n") * F.col("nz") / (F.col("nxz") * F.col("nyz")))).alias("nats"))


def transfer_entropy(df: DataFrame, source: str, target: str, order: str, lag: int = 1, bins: int = 8) -> DataFrame:
    """cmi of the target with the source's past, given its own past. df: one row a period."""
    d = df.select(F.col(order).alias("o"), F.col(source).alias("s"), F.col(target).alias("now"))
    return cmi(lagged(d, "o", {"their_past": ("s", lag), "own_past": ("now", lag)}), "their_past", "now", "own_past", bins)


# ---- regressions by normal equations


def gram(df: DataFrame, y: str, xs: Sequence[str]) -> tuple[np.ndarray, int]:
    """Sums of products of (1, xs, y) over complete rows: one aggregate."""
    cols = [F.lit(1.0), *(F.col(c).cast("double") for c in (*xs, y))]
    d = df.dropna(subset=[*xs, y])
    k = len(cols)
    row = d.agg(*(F.sum(cols[i] * cols[j]).alias(f"s{i}_{j}") for i in range(k) for j in range(i, k))).first()
    g = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            g[i, j] = g[j, i] = row[f"s{i}_{j}"] or 0.0
    return g, int(g[0, 0])


def solve(g: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
    """Coefficients, residual sum of squares and the inverse, from gram()."""
    a, b = g[:-1, :-1], g[:-1, -1]
    inv = np.linalg.pinv(a)
    beta = inv @ b
    return beta, max(float(g[-1, -1] - beta @ b), 0.0), inv


def ols(df: DataFrame, y: str, xs: Sequence[str]) -> DataFrame:
    """term, coef, se, t, p by least squares; the constant first."""
    g, n = gram(df, y, xs)
    beta, rss, inv = solve(g)
    dof = n - len(beta)
    se = np.sqrt(np.clip(np.diag(inv) * rss / max(dof, 1), 0, None))
    rows = [
        (t, float(b), float(s), float(b / s) if s else None, p_t(float(b / s), dof) if s else None)
        for t, b, s in zip(["const", *xs], beta, se, strict=True)
    ]
    return df.sparkSession.createDataFrame(rows, "term string, coef double, se double, t double, p double")


def trend_by(df: DataFrame, by: Sequence[str], t: str, y: str) -> DataFrame:
    """by, n, slope, intercept, r2, se (of the slope) of y over t by least squares in each group, by one aggregate.

    Rows with a null in t or y are left out; a null key is a group. A group without two values of t has no
    slope; one of two rows has no se.
    """
    d = df.select(*by, F.col(t).cast("double").alias("t_"), F.col(y).cast("double").alias("y_")).where("t_ IS NOT NULL AND y_ IS NOT NULL")
    n = F.count("*")
    g = d.groupBy(*by).agg(
        n.alias("n"), F.avg("t_").alias("mt"), F.avg("y_").alias("my"), (F.var_pop("t_") * n).alias("tt"), (F.var_pop("y_") * n).alias("yy"),
        (F.covar_pop("t_", "y_") * n).alias("ty"),
    )
    slope = F.try_divide(F.col("ty"), F.col("tt"))
    rss = F.greatest(F.col("yy") - slope * F.col("ty"), F.lit(0.0))
    return g.select(
        *by, "n", slope.alias("slope"), (F.col("my") - slope * F.col("mt")).alias("intercept"), F.try_divide(F.col("ty") * F.col("ty"), F.col("tt") * F.col("yy")).alias("r2"),
        F.when(F.col("n") > 2, F.sqrt(F.try_divide(rss / (F.col("n") - 2), F.col("tt")))).alias("se"),
    )


def granger(df: DataFrame, x: str, y: str, order: str, maxlag: int) -> DataFrame:
    """lag, f, p: whether x's past helps to tell y. df: one row a period."""
    d = df.select(F.col(order).alias("o"), F.col(y).alias("y"), F.col(x).alias("x"))
    d = kept(lagged(d, "o", {f"{c}{k}": (c, k) for c in "yx" for k in range(1, maxlag + 1)}))
    rows = []
    for lag in range(1, maxlag + 1):
        own, both = [f"y{k}" for k in range(1, lag + 1)], [f"{n}{k}" for n in "yx" for k in range(1, lag + 1)]
        full, n = gram(d, "y", both)
        keep = [0, *range(1, lag + 1), len(full) - 1]
        _, r1, _ = solve(full)
        _, r0, _ = solve(full[np.ix_(keep, keep)])
        dof = n - 2 * lag - 1
        f = (r0 - r1) / lag / (r1 / dof) if r1 > 0 and dof > 0 else None
        rows.append((lag, f, None if f is None else p_f(f, lag, dof)))
        assert len(own) == lag
    return df.sparkSession.createDataFrame(rows, "lag int, f double, p double")


def iv_2sls(df: DataFrame, exposure: str, outcome: str, instrument: str) -> DataFrame:
    """effect: covariance of instrument and outcome over that of instrument and exposure, and the first stage's F."""
    d = df.dropna(subset=[exposure, outcome, instrument])
    r = F.corr(instrument, exposure)
    return d.agg(
        F.try_divide(F.covar_samp(instrument, outcome), F.covar_samp(instrument, exposure)).alias("effect"),
        (F.pow(r, 2) / (1 - F.pow(r, 2)) * (F.count("*") - 2)).alias("first_stage_f"),
    )


def vif(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """feature, vif: the diagonal of the inverse correlation matrix of complete rows."""
    g, n = gram(df.withColumn("one_", F.lit(0.0)), "one_", cols)
    m = g[0, 1:-1] / n
    cov = g[1:-1, 1:-1] / n - np.outer(m, m)
    s = np.sqrt(np.diag(cov))
    inv = np.linalg.pinv(cov / np.outer(s, s))
    return df.sparkSession.createDataFrame([(c, float(v)) for c, v in zip(cols, np.diag(inv), strict=True)], "feature string, vif double")


def chow(df: DataFrame, y: str, xs: Sequence[str], t: str, cut) -> DataFrame:
    """f, p of a break at the cut: pooled against separate fits."""
    left, right = df.where(F.col(t) < F.lit(cut)), df.where(F.col(t) >= F.lit(cut))
    (g1, n1), (g2, n2) = gram(left, y, xs), gram(right, y, xs)
    k = len(xs) + 1
    rss, r1, r2 = solve(g1 + g2)[1], solve(g1)[1], solve(g2)[1]
    dof = n1 + n2 - 2 * k
    f = (rss - r1 - r2) / k / ((r1 + r2) / dof)
    return _row(df, {"f": f, "p": p_f(f, k, dof)})


def km_quantiles(df: DataFrame, duration: str, event: str, by: Sequence[str], qs: Sequence[float] = (0.1, 0.25, 0.5, 0.75, 0.9), least: int = 10, whole: int = WHOLE) -> DataFrame:
    """by, n, events, qNN: least time at which survival is 1 - q or less; groups under `least` rows: quantiles of observed events.

    Counts by group and time, then scans of sums and products over range parts of time.
    """
    d = df.where(F.col(duration).isNotNull()).withColumns({c: F.coalesce(c, F.lit("Unknown")) for c in by}).select(
        *by, F.col(duration).cast("double").alias("t"), F.col(event).cast("int").alias("e")
    )
    n = d.groupBy(*by, "t").agg(F.count("*").alias("n"), F.sum("e").alias("d"))
    risk = running(n, "t", ["n"], descending=True, by=by, whole=whole)
    s = running(risk.withColumn("left_", 1 - F.col("d") / F.col("to_n")).select(*by, "t", "n", "d", "left_"), "t", [], by=by, products=["left_"], whole=whole)
    km = s.groupBy(*by).agg(
        F.sum("n").alias("n"), F.sum("d").alias("events"), *(F.min(F.when(F.col("to_left_") <= 1 - q + 1e-12, F.col("t"))).alias(f"k{int(q * 100)}") for q in qs)
    )
    km = kept(km)
    few = km.where(F.col("n") < least).select(*(F.col(c).alias(f"{c}_few") for c in by))  # groups of fewer rows than `least`
    seen = d.where("e = 1").join(few, [F.col(c) == F.col(f"{c}_few") for c in by], "left_semi") if by else d.where("e = 1")
    seen = grouped_quantiles(seen, by, "t", {f"e{int(q * 100)}": q for q in qs})
    out = meet(km, seen, by, "left").where((F.col("n") >= least) | (F.col("events") > 0))
    return out.select(
        *by, "n", "events", *(F.when(F.col("n") < least, F.col(f"e{int(q * 100)}")).otherwise(F.col(f"k{int(q * 100)}")).alias(f"q{int(q * 100)}") for q in qs)
    )


def change_point(df: DataFrame, period: str, n: str, whole: int = WHOLE) -> DataFrame:
    """period, cost, posterior: for each split of a count series, Poisson cost of two rates, and its share of the likelihood (flat prior)."""
    d = df.select(F.col(period).alias("period"), F.col(n).cast("double").alias("n"), F.lit(1).alias("one"))
    d = running(d, "period", ["n", "one"], whole=whole).where("to_one < all_one")
    term = lambda s, k: F.when(s > 0, s * F.log(s / k)).otherwise(0.0)
    ll = term(F.col("to_n"), F.col("to_one")) + term(F.col("all_n") - F.col("to_n"), F.col("all_one") - F.col("to_one"))
    d = kept(d.select("period", ll.alias("ll")))
    best = d.agg(F.max("ll")).first()[0]
    weight = F.exp(F.col("ll") - F.lit(best))
    total = d.agg(F.sum(weight)).first()[0]
    return d.select("period", (-F.col("ll")).alias("cost"), (weight / F.lit(total)).alias("posterior"))


def mean_shift(df: DataFrame, c: str, group: str) -> DataFrame:
    """shift, sd, p_above: normal posterior of the difference of two means under a flat prior; group holds 0 and 1."""
    m = {
        r[group]: r
        for r in df.where(F.col(c).isNotNull() & F.col(group).isin(0, 1)).groupBy(group).agg(
            F.count("*").alias("n"), F.avg(c).alias("m"), F.var_samp(c).alias("v")
        ).collect()
    }
    shift, sd = m[1].m - m[0].m, math.sqrt(m[0].v / m[0].n + m[1].v / m[1].n)
    return _row(df, {"shift": shift, "sd": sd, "p_above": 0.5 * math.erfc(-shift / sd / math.sqrt(2))})


def decompose(df: DataFrame, order: str, c: str, period: int, **options) -> DataFrame:
    """trend (centred moving average), seasonal (mean by position, centred), residual. df: one row a period of time."""
    half = period // 2

    def made(w: WindowSpec) -> dict[str, Column]:
        span = w.rowsBetween(-half, half)
        if period % 2:
            trend = F.avg("x").over(span)
        else:
            trend = (F.sum("x").over(span) - (F.lag("x", half).over(w) + F.lead("x", half).over(w)) / 2) / period
        return {"trend": F.when(F.count("x").over(span) == 2 * half + 1, trend)}

    d = over_rows(df.select(order, F.col(c).cast("double").alias("x")), order, made, half, half, **options)
    d = kept(d.withColumn("pos", (F.col("pos_") - 1) % period))
    means = d.groupBy("pos").agg(F.avg(F.col("x") - F.col("trend")).alias("s"))
    means = means.withColumn("seasonal", F.col("s") - F.avg("s").over(Window.partitionBy()))
    return d.join(F.broadcast(means.select("pos", "seasonal")), "pos").select(
        order, "x", "trend", "seasonal", (F.col("x") - F.col("trend") - F.col("seasonal")).alias("residual")
    )


def acf(df: DataFrame, order: str, c: str, k: int, **options) -> DataFrame:
    """lag, r: autocorrelations about the common mean. df: one row a period."""
    mean = F.lit(df.agg(F.avg(F.col(c).cast("double"))).first()[0])
    d = df.select(F.col(order).alias("o"), (F.col(c).cast("double") - mean).alias("x"))
    d = lagged(d, "o", {f"l{i}": ("x", i) for i in range(1, k + 1)}, **options)
    row = d.agg(
        *(F.try_divide(F.sum(F.col("x") * F.col(f"l{i}")), F.sum(F.col("x") * F.col("x"))).alias(f"r{i}") for i in range(1, k + 1)), F.count("x").alias("n")
    )
    return row.select(
        "n", F.explode(F.array(*(F.struct(F.lit(i).alias("lag"), F.col(f"r{i}").alias("r")) for i in range(1, k + 1)))).alias("a")
    ).select("a.lag", "a.r", "n")


def ljung_box(df: DataFrame, order: str, c: str, k: int) -> DataFrame:
    r = acf(df, order, c, k).agg(F.sum(F.pow("r", 2) / (F.col("n") - F.col("lag"))).alias("s"), F.max("n").alias("n")).first()
    q = r.n * (r.n + 2) * r.s
    return _row(df, {"q": q, "p": gammaincc(k / 2, q / 2)})


def adf_stat(df: DataFrame, order: str, c: str) -> DataFrame:
    """t: of the level in the regression of changes on the level and a constant (unit root)."""
    d = lagged(df.select(F.col(order).alias("o"), F.col(c).cast("double").alias("x")), "o", {"level": ("x", 1)})
    d = d.select((F.col("x") - F.col("level")).alias("dx"), "level")
    return ols(d, "dx", ["level"]).where("term = 'level'").select("coef", "t")


def calibration(df: DataFrame, y: str, p: str, bins: int = 10) -> DataFrame:
    return df.where(F.col(y).isNotNull() & F.col(p).isNotNull()).groupBy(F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int").alias("bin")).agg(
        F.avg(p).alias("mean_predicted"), F.avg(y).alias("fraction_positive"), F.count("*").alias("n")
    )


def class_metrics(df: DataFrame, y: str, p: str, threshold: float = 0.5) -> DataFrame:
    """One row of auc, average_precision, brier, accuracy, precision, recall, f1, the confusion counts, and best_threshold with best_f1.

    Ranks come from counts by score, so ties count half. best_threshold: of the scores, the least at which
    predicting all rows of that score or more gives the highest F1.
    """
    d = df.select(F.col(y).cast("int").alias("y"), F.col(p).cast("double").alias("p")).dropna()
    n = d.groupBy("p").agg(F.sum("y").alias("pos"), F.count("*").alias("n"))
    c = running(n, "p", ["pos", "n"], descending=True)
    neg = F.col("n") - F.col("pos")
    auc = F.try_divide(F.sum(neg * (F.col("to_pos") - F.col("pos") / 2)), F.max("all_pos") * (F.max("all_n") - F.max("all_pos")))
    ap = F.try_divide(F.sum(F.col("pos") * F.col("to_pos") / F.col("to_n")), F.max("all_pos"))
    hit = F.col("p") >= threshold
    one = d.agg(
        F.avg(F.pow(F.col("p") - F.col("y"), 2)).alias("brier"),
        *(
            F.count(F.when(a & b, 1)).alias(k)
            for k, a, b in (("tp", hit, F.col("y") == 1), ("fp", hit, F.col("y") == 0), ("fn", ~hit, F.col("y") == 1), ("tn", ~hit, F.col("y") == 0))
        ),
    )
    prec, rec = F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), F.try_divide(F.col("tp"), F.col("tp") + F.col("fn"))
    f1 = 2 * F.col("to_pos") / (F.col("to_n") + F.col("all_pos"))
    best = F.max(F.struct(f1.alias("f1"), (-F.col("p")).alias("p")))
    scanned = c.agg(auc.alias("auc"), ap.alias("average_precision"), (-best["p"]).alias("best_threshold"), best["f1"].alias("best_f1"))
    return scanned.crossJoin(one).withColumns(
        {
            "accuracy": F.try_divide(F.col("tp") + F.col("tn"), F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")),
            "precision": prec,
            "recall": rec,
            "f1": F.try_divide(2 * prec * rec, prec + rec),
        }
    )


def reg_metrics(df: DataFrame, y: str, p: str, naive: str | None = None, predictors: int = 1) -> DataFrame:
    """mae, mse, rmse, rmsle, mape, smape, r2, rse (relative squared error), residual_se; with a naive forecast also mase."""
    cols = {"y": y, "p": p} | ({"naive": naive} if naive else {})
    d = df.select(*(F.col(c).cast("double").alias(n) for n, c in cols.items())).dropna()
    e = F.col("y") - F.col("p")
    sse, var = F.sum(e * e), F.var_pop("y") * F.count("*")
    logs = F.log1p(F.greatest("y", F.lit(0.0))) - F.log1p(F.greatest("p", F.lit(0.0)))
    out = {
        "mae": F.avg(F.abs(e)),
        "mse": F.avg(e * e),
        "rmse": F.sqrt(F.avg(e * e)),
        "rmsle": F.sqrt(F.avg(logs * logs)),
        "mape": F.avg(F.try_divide(F.abs(e), F.abs("y"))),
        "smape": F.avg(F.try_divide(2 * F.abs(e), F.abs("y") + F.abs("p"))),
        "r2": 1 - F.try_divide(sse, var),
        "rse": F.try_divide(sse, var),
        "residual_se": F.sqrt(F.try_divide(sse, F.count("*") - predictors - 1)),
    }
    if naive:
        out["mase"] = F.try_divide(F.avg(F.abs(e)), F.avg(F.abs(F.col("y") - F.col("naive"))))
    return d.agg(*(c.alias(n) for n, c in out.items()))
