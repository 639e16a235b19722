"""Scans by range parts against pandas, numpy and brute force: the same at any number of parts, and with one window."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from flowloom.operators import aggregates, models, privacy, scans, stats, windows

WAYS = [dict(parts=7, whole=0), dict(whole=10**6)]
MORE = [dict(parts=1, whole=0), dict(parts=211, whole=0)]


def frame(spark, columns, schema):
    rows = [tuple(None if v is None or v != v else v for v in r) for r in zip(*columns, strict=True)]
    return spark.createDataFrame(rows, schema).repartition(5)


@pytest.fixture(scope="module")
def series(spark):
    rng = np.random.default_rng(4)
    n = 300
    x, y = rng.normal(size=n).cumsum(), rng.normal(size=n)
    x[17] = np.nan
    day = pd.date_range("2001-01-01", periods=n).date
    return pd.DataFrame({"day": day, "x": x, "y": y, "k": np.arange(n) % 3}), frame(spark, [day, x.tolist(), y.tolist(), (np.arange(n) % 3).tolist()], "day date, x double, y double, k long")


def test_running(spark):
    rng = np.random.default_rng(2)
    p = pd.DataFrame({"g": rng.integers(0, 3, 400), "v": rng.permutation(400).astype(float), "c": rng.integers(1, 9, 400), "f": rng.uniform(0.9, 1.1, 400)})
    p.loc[p.g == 2, "g"] = None
    df = frame(spark, [p.g.tolist(), p.v.tolist(), p.c.tolist(), p.f.tolist()], "g double, v double, c long, f double")
    for descending in (False, True):
        s = p.sort_values("v", ascending=not descending)
        whole = pd.DataFrame({"v": s.v, "c": s.c.cumsum(), "f": s.f.cumprod()}).sort_values("v").to_numpy()
        g = s.groupby("g", dropna=False)
        by = pd.DataFrame({"v": s.v, "c": g.c.cumsum(), "f": g.f.cumprod(), "all": g.c.transform("sum")}).sort_values("v").to_numpy()
        for way in WAYS:
            a = scans.running(df, "v", ["c"], descending, products=["f"], **way).select("v", "to_c", "to_f").toPandas().sort_values("v").to_numpy()
            assert np.allclose(a, whole)
            b = scans.running(df, "v", ["c"], descending, by=["g"], products=["f"], **way)
            assert np.allclose(b.select("v", "to_c", "to_f", "all_c").toPandas().sort_values("v").to_numpy(), by)
        own = scans.running(df.where("g IS NOT NULL"), "v", ["c"], descending, by=["g"], own_parts=True, parts=7, whole=0)
        assert own.count() == (~p.g.isna()).sum()
        known = {r[0]: r[1] for r in by}
        assert all(r.to_c == known[r.v] for r in own.collect())
    assert scans.running(df.limit(0), "v", ["c"], whole=0).count() == 0


def test_positions_and_neighbours(spark, series):
    p, df = series
    want = p.assign(l1=p.x.shift(1), l5=p.y.shift(5), f2=p.y.shift(-2))
    for way in (*WAYS, dict(parts=7, whole=0, size=6)):
        got = scans.lagged(df, "day", {"l1": ("x", 1), "l5": ("y", 5), "f2": ("y", -2)}, **way).toPandas().sort_values("day")
        assert got.pos_.tolist() == list(range(1, len(p) + 1))
        for c in ("l1", "l5", "f2"):
            assert np.allclose(got[c].astype(float), want[c], equal_nan=True)
        by = scans.lagged(df, "day", {"l2": ("y", 2)}, by=["k"], **way).toPandas().sort_values("day")
        assert np.allclose(by.l2.astype(float), p.groupby("k").y.shift(2), equal_nan=True)
    assert scans.lagged(df.limit(0), "day", {"l1": ("x", 1)}, whole=0).count() == 0


def test_series_operators_at_any_number_of_parts(series):
    p, df = series
    for key, ways, f in (
        ("lag", [*WAYS, *MORE], lambda **o: windows.lag_corr(df, "y", "x", [1, 4], "day", **o)),
        ("lag", WAYS, lambda **o: stats.acf(df, "day", "x", 3, **o)),
        ("day", WAYS, lambda **o: stats.decompose(df, "day", "y", 7, **o)),
        ("day", [WAYS[1], dict(parts=7, whole=0, size=31)], lambda **o: stats.decompose(df, "day", "y", 12, **o)),
    ):
        first, *rest = (f(**way).toPandas().sort_values(key).reset_index(drop=True) for way in ways)
        assert len(first)
        for other in rest:
            pd.testing.assert_frame_equal(first, other, rtol=1e-9, atol=1e-12)
    r = stats.acf(df, "day", "y", 2, parts=7, whole=0, size=9).toPandas().sort_values("lag").r
    z = p.y - p.y.mean()
    assert np.allclose(r, [(z * z.shift(k)).sum() / (z * z).sum() for k in (1, 2)])
    counts = df.select("day", F.floor(F.abs("y") * 5).alias("n"))
    one, parts = (stats.change_point(counts, "day", "n", whole=w).toPandas().sort_values("period").posterior for w in (10**6, 0))
    assert np.allclose(one, parts) and math.isclose(parts.sum(), 1)


def test_quantiles(spark):
    rng = np.random.default_rng(6)
    draw = random.Random(1)
    groups = {
        "distinct": rng.normal(size=3000).tolist(),
        "far": (10.0 ** rng.uniform(-200, 200, 500) * rng.choice([-1, 1], 500)).tolist(),
        "heavy": [5.0] * 900 + rng.normal(size=300).tolist(),
        "two": [1.0, 2.0],
        "one": [7.0],
        "none": [None, None],
        None: [draw.random() for _ in range(200)] + [None] * 5,
        "same": [3.0] * 400,
    }
    df = frame(spark, list(zip(*[(g, v) for g, vs in groups.items() for v in vs], strict=True)), "g string, v double")
    qs = {"lo": 0.0, "q1": 0.25, "mid": 0.5, "p9": 0.9, "hi": 1.0}
    for small, buckets in ((10**6, 64), (20, 16)):
        got = {r.g: r for r in scans.grouped_quantiles(df, ["g"], "v", qs, small, buckets).collect()}
        assert got.keys() == groups.keys()
        for g, vs in groups.items():
            own = [v for v in vs if v is not None]
            for n, q in qs.items():
                want = np.percentile(own, 100 * q) if own else None
                assert got[g][n] == (pytest.approx(want, rel=1e-12, abs=1e-300) if own else None), (g, n, small)
    v = sorted(x for vs in groups.values() for x in vs if x is not None)
    for small in (50,):
        got = scans.grouped_quantiles(df, [], "v", qs, small).first()
        assert [got[n] for n in qs] == [pytest.approx(np.percentile(v, 100 * q), rel=1e-12) for q in qs.values()]
    assert scans.grouped_quantiles(df.limit(0), ["g"], "v", qs, 0).count() == 0
    assert scans.grouped_quantiles(df.where("v IS NULL"), [], "v", qs).first()["mid"] is None
    out = {r.g: r.median for r in aggregates.review_rate(df.withColumn("f", F.lit(1)), ["g"], "f", "v").collect()}
    assert out["two"] == 1.5 and out["none"] is None
    assert privacy.iqr_outliers(df.where("g = 'heavy'"), "v").count() > 0
    few, many = ({r.column: r for r in aggregates.describe_all(df, whole=w).collect()} for w in (10**6, 50))
    for p in ("p25", "p50", "p75"):
        assert many["v"][p] == pytest.approx(few["v"][p]) and few["g"][p] is None and many["g"][p] is None


def test_spearman_matrix(spark):
    rng = np.random.default_rng(8)
    p = pd.DataFrame(rng.integers(0, 12, (400, 4)).astype(float), columns=list("abcd"))
    p["b"] = p.a * 2 + rng.normal(size=400)
    p.loc[rng.random(400) < 0.2, "c"] = np.nan
    p.loc[rng.random(400) < 0.3, "a"] = np.nan
    p["e"] = 1.0
    df = frame(spark, [p[c].tolist() for c in p], ", ".join(f"{c} double" for c in p))
    want = p.corr(method="spearman")
    for whole in (10**6, 0):
        got = stats.spearman_matrix(df, list(p), whole).collect()
        assert [(r.a, r.b) for r in got] == [(x, y) for i, x in enumerate(p) for y in list(p)[i + 1 :]]
        for r in got:
            assert r.n == (p[r.a].notna() & p[r.b].notna()).sum()
            assert r.r == (None if "e" in (r.a, r.b) else pytest.approx(want.loc[r.a, r.b], abs=1e-9))
    assert [r.r for r in stats.spearman_matrix(df.limit(0), ["a", "b"]).collect()] == [None]


def test_best_f1(spark):
    draw = random.Random(2)
    for _ in range(2):
        rows = [(draw.randint(0, 1), draw.randint(0, 20) / 20) for _ in range(60)]
        got = stats.class_metrics(spark.createDataFrame(rows, "y int, p double"), "y", "p").first()
        f1 = {}
        for t in {p for _, p in rows}:
            tp = sum(y for y, p in rows if p >= t)
            f1[t] = 2 * tp / (sum(p >= t for _, p in rows) + sum(y for y, _ in rows))
        best = max(f1.values())
        assert got.best_f1 == pytest.approx(best) and got.best_threshold == min(t for t, v in f1.items() if math.isclose(v, best))


def test_cox_baseline_and_score(spark):
    rng = np.random.default_rng(3)
    n = 250
    x, z = rng.normal(size=n), rng.integers(0, 2, n)
    t = np.round(rng.exponential(np.exp(-0.7 * x + 0.4 * z)) * 10, 1)
    e = (rng.random(n) < 0.7).astype(int)
    df = frame(spark, [t.tolist(), e.tolist(), x.tolist(), z.tolist()], "t double, e int, x double, z int")
    fit = models.fit_cox(df, "t", "e", ["x", "z"])
    parted = models.fit_cox(df, "t", "e", ["x", "z"], rounds=2, whole=0)
    assert np.allclose(models.fit_cox(df, "t", "e", ["x", "z"], rounds=2).coef, parted.coef)
    r = np.exp((x - x.mean()) * fit.coef[0] + (z - z.mean()) * fit.coef[1])
    times = sorted(set(t[e == 1]))
    steps = [((t == s) & (e == 1)).sum() / r[t >= s].sum() for s in times]
    for whole in (10**6, 0):
        base = models.cox_baseline(df, "t", "e", fit, whole)
        got = base.orderBy("t").collect()
        assert [b.t for b in got] == times and np.allclose([b.hazard for b in got], steps) and np.allclose([b.cumulative for b in got], np.cumsum(steps))
        new = spark.createDataFrame([(0.0, 0.3, 1), (float(times[3]), 0.3, 1), (float(times[3]) + 1e-6, -1.0, 0), (1e9, 0.0, 0), (None, 1.0, 1), (2.0, None, 1)], "t double, x double, z int")
        scored = models.cox_score(new, "t", fit, base, whole).collect()
        assert len(scored) == 6
        for s in scored:
            if s.t is None or s.x is None:
                assert s.survival is None
                continue
            hazard = math.exp((s.x - x.mean()) * fit.coef[0] + (s.z - z.mean()) * fit.coef[1])
            total = sum(v for at, v in zip(times, steps, strict=True) if at <= s.t)
            assert s.partial_hazard == pytest.approx(hazard) and s.cumulative_hazard == pytest.approx(total * hazard)
            assert s.survival == pytest.approx(math.exp(-total * hazard))


def test_survival_quantiles_by_parts(spark):
    rng = np.random.default_rng(5)
    t, e, g = rng.exponential(10, 400).tolist(), (rng.random(400) < 0.6).astype(int).tolist(), rng.choice(["a", "b", "c"], 400).tolist()
    g[:6], e[:6] = ["few"] * 6, [1, 1, 0, 1, 1, 0]
    df = frame(spark, [t, e, g], "t double, e int, g string")
    one, parts = (sorted(map(tuple, stats.km_quantiles(df, "t", "e", ["g"], whole=w).collect())) for w in (10**6, 0))
    assert one == parts and len(one) == 4
    own = sorted(x for x, y, k in zip(t, e, g, strict=True) if k == "few" and y)
    assert next(r for r in one if r[0] == "few")[5] == pytest.approx(np.percentile(own, 50))


def test_pca_share(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(500, 5)) @ rng.normal(size=(5, 5)) + 1e6
    x[:, 4] = 3.0
    df = frame(spark, x.T.tolist(), ", ".join(f"c{k} double" for k in range(5)))
    cols = df.columns
    z = (x[:, :4] - x[:, :4].mean(0)) / x[:, :4].std(0, ddof=1)
    value = np.linalg.svd(z, compute_uv=False) ** 2
    part = value / value.sum()
    got = models.pca(df, cols, share=0.9).orderBy("component").collect()
    k = int(np.argmax(np.cumsum(part) > 0.9)) + 1
    assert len(got) == k and np.allclose([r.share for r in got], part[:k]) and np.allclose([r.cumulative for r in got], np.cumsum(part)[:k])
    scores = models.pca_scores(df, cols, k=2).select("pc1", "pc2").toPandas()
    assert np.allclose(sorted(scores.var(ddof=1), reverse=True), value[:2] / 499)
    assert models.pca(df.limit(0), cols, 2).count() == 0 and models.pca(df, cols).count() == 5


def test_gamma_tail_for_large_shapes():
    for a in (1e4, 1e6, 1e8, 1e9, 1e12):
        # Q(a, a) = 1/2 - 1 / (3 sqrt(2 pi a)) + O(a^-3/2)
        assert stats.gammaincc(a, a) == pytest.approx(0.5 - 1 / (3 * math.sqrt(2 * math.pi * a)), abs=max(1e-10, 0.01 * a**-1.5))
        for z in (-9, -3, -0.5, 0.5, 2, 6):
            # Q(a + 1, x) - Q(a, x) = x^a e^-x / Gamma(a + 1)
            x = a + z * math.sqrt(a)
            d = (x - a) / a
            step = math.exp(a * float(stats._log1p_less(np.array(d))) - 1 / (12 * a)) / math.sqrt(2 * math.pi * a)
            assert stats.gammaincc(a + 1, x) - stats.gammaincc(a, x) == pytest.approx(step, rel=1e-3, abs=1e-11)
        assert stats.gammaincc(a, a / 2) == 1.0 and stats.gammaincc(a, 2 * a) == 0.0
    for x in (9300.0, 9490.0, 9500.0, 9700.0):  # both ways at a shape that either can do
        z = (x - 9500) / math.sqrt(9500)
        assert (stats._gamma_between(9500, z, z + 14) if z > 0 else 1 - stats._gamma_between(9500, z - 14, z)) == pytest.approx(stats.gammaincc(9500, x), abs=1e-11)
    assert stats.gammaincc(2.5, 4.0) == pytest.approx(0.1562356, abs=1e-6)


def test_history_fan(spark):
    rng = np.random.default_rng(9)
    n, days = 90, 6
    dates = pd.date_range("2001-01-01", periods=n + days)
    y = np.maximum(0, 20 + rng.normal(size=n).cumsum() * 4).round()
    df = frame(spark, [dates[:n].date, y.astype(int).tolist()], "date date, backlog_available long")
    fit = models.fit_delta(df)
    angle = 2 * np.pi * dates.dayofyear.to_numpy() / 365.25
    terms = np.c_[np.ones(n + days), np.zeros(n + days), np.sin(angle), np.cos(angle), *[(dates.weekday.to_numpy() == k).astype(float) for k in range(1, 7)]]
    known, phi = terms @ fit["mean"], fit["mean"][1]

    def path(t):
        at, dy, out = y[t], y[t] - y[t - 1] if t else 0.0, []
        for h in range(1, days + 1):
            dy = known[t + h] + phi * dy
            at = max(0.0, at + dy)
            out.append(at)
        return np.array(out)

    errors = [[y[t + h] - path(t)[h - 1] for t in range(n - h)] for h in range(1, days + 1)]
    for way in (*WAYS, dict(parts=7, whole=0, size=7)):
        got = models.history_fan(df, fit, days, **way).orderBy("date").collect()
        assert [r.date for r in got] == list(dates[n:].date) and [r.n for r in got] == [n - h for h in range(1, days + 1)]
        for r, e, p in zip(got, errors, path(n - 1), strict=True):
            want = [np.mean(e), *(np.percentile(e, q) for q in (5, 20, 50, 80, 95))]
            assert [r.mean, r.p5, r.p20, r.p50, r.p80, r.p95] == pytest.approx([max(0.0, p + x) for x in want])
    short = models.history_fan(df.limit(3), fit, days).orderBy("date").collect()
    assert len(short) == days and short[-1].n == 0 and short[-1].p50 is None


def test_trend_by(spark):
    rng = np.random.default_rng(1)
    t, g = rng.uniform(0, 9, 90), rng.choice(["a", "b"], 90)
    y = 3 * t + rng.normal(size=90)
    df = frame(spark, [[*g.tolist(), "one", "flat", "flat"], [*t.tolist(), 1.0, 2.0, 2.0], [*y.tolist(), 1.0, 1.0, 3.0]], "g string, t double, y double")
    got = {r.g: r for r in stats.trend_by(df, ["g"], "t", "y").collect()}
    for k in "ab":
        slope, intercept = np.polyfit(t[g == k], y[g == k], 1)
        assert got[k].slope == pytest.approx(slope) and got[k].intercept == pytest.approx(intercept)
        assert got[k].r2 == pytest.approx(np.corrcoef(t[g == k], y[g == k])[0, 1] ** 2)
    assert got["one"].slope is None and got["flat"].slope is None
