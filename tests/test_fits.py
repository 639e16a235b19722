"""Fits, draws, forecasts and other results that SQL cannot state, against numpy and against brute force on small tables."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from flowloom.operators import aggregates, flow, models, privacy, quality, stats
from flowloom.plans import models as plans
from flowloom.sources import tables as src
from flowloom.streaming import daily
from flowloom.views import cases

SF = "/root/testdata/sf0.001"
DAY0 = dt.date(2024, 1, 1)


def frame(spark, columns, **types):
    """A table of the given columns, doubles unless types says otherwise."""
    kinds = {c: types.get(c, "double") for c in columns}

    def plain(v, kind):
        v = v.item() if hasattr(v, "item") else v
        return v if v is None else float(v) if kind == "double" else int(v) if kind in ("int", "long") else v

    rows = [tuple(plain(v, k) for v, k in zip(row, kinds.values(), strict=True)) for row in zip(*columns.values(), strict=True)]
    return spark.createDataFrame(rows, ", ".join(f"{c} {k}" for c, k in kinds.items()))


# ---- statistics


def test_granger(spark):
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=80), np.zeros(80)
    for t in range(1, 80):
        y[t] = 0.4 * y[t - 1] + 0.5 * x[t - 1] + rng.normal()
    got = {r.lag: r for r in stats.granger(frame(spark, {"k": np.arange(80), "x": x, "y": y}), "x", "y", "k", 2).collect()}
    rows = np.arange(2, 80)  # the same rows serve both lags
    for lag in (1, 2):
        own = np.stack([np.ones(len(rows)), *(y[rows - k] for k in range(1, lag + 1))], 1)
        both = np.c_[own, *(x[rows - k][:, None] for k in range(1, lag + 1))]
        full = [np.arange(lag, 80) - k for k in range(lag + 1)]
        own = np.stack([np.ones(80 - lag), *(y[full[k]] for k in range(1, lag + 1))], 1)
        both = np.c_[own, *(x[full[k]][:, None] for k in range(1, lag + 1))]
        r0, r1 = (float(np.sum((y[lag:] - m @ np.linalg.lstsq(m, y[lag:], rcond=None)[0]) ** 2)) for m in (own, both))
        f = (r0 - r1) / lag / (r1 / (80 - lag - 2 * lag - 1))
        assert got[lag].f == pytest.approx(f, rel=1e-6)
    assert got[1].p < 0.01


@pytest.mark.parametrize(
    "conf",
    [
        {"spark.sql.exchange.reuse": "false"},
        {"spark.sql.adaptive.enabled": "false"},
        {"spark.sql.shuffle.partitions": "1"},
        {"spark.sql.shuffle.partitions": "7"},
        {"spark.sql.shuffle.partitions": "211"},
    ],
)
def test_ranks_do_not_depend_on_the_plan(spark, conf):
    rng = np.random.default_rng(2)
    n = 4000
    a, g = rng.integers(0, 900, n).astype(float), rng.integers(0, 2, n)
    b = a + rng.normal(size=n) * 300
    p = 1 / (1 + np.exp(-(b - 450) / 400))
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        df = frame(spark, {"a": a, "b": b, "g": g, "p": p}, g="int")

        def ranks(x):
            order = np.sort(x)
            return (np.searchsorted(order, x) + np.searchsorted(order, x, "right") + 1) / 2

        assert stats.spearman(df, "a", "b").first().r == pytest.approx(np.corrcoef(ranks(a), ranks(b))[0, 1])
        both = np.unique(a)
        cdf = [np.searchsorted(np.sort(a[g == k]), both, "right") / (g == k).sum() for k in (0, 1)]
        assert stats.ks_2samp(df, "a", "g").first().d == pytest.approx(np.abs(cdf[0] - cdf[1]).max())
        u = ranks(a)[g == 0].sum() - (g == 0).sum() * ((g == 0).sum() + 1) / 2
        assert stats.rank_sum(df, "a", "g").first().u == pytest.approx(u)
        auc = (ranks(p)[g == 1].sum() - (g == 1).sum() * ((g == 1).sum() + 1) / 2) / ((g == 0).sum() * (g == 1).sum())
        assert stats.class_metrics(df, "g", "p").first().auc == pytest.approx(auc)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_regression_metrics(spark):
    y, p, v = np.array([1.0, 2, 4, 8]), np.array([1.5, 2, 3, 9]), np.array([1.0, 1, 2, 4])
    r = stats.reg_metrics(frame(spark, {"y": y, "p": p, "v": v}), "y", "p", "v").first()
    assert r.residual_se == pytest.approx(math.sqrt(np.sum((y - p) ** 2) / 2)) and r.mase == pytest.approx(np.abs(y - p).mean() / np.abs(y - v).mean())


# ---- flows


def test_case_flow_equals_snapshots(spark):
    rng = np.random.default_rng(3)
    rows = []
    for k in range(400):
        a = DAY0 + dt.timedelta(days=int(rng.integers(0, 900)))
        b = None if k % 5 == 0 else a + dt.timedelta(days=int(rng.integers(-40, 500)))
        rows.append((k, None if k % 41 == 0 else a, b, int(k % 7)))
    df = spark.createDataFrame(rows, "case_id int, dt_received date, dt_close date, age int")
    m = df.agg(F.min("dt_received").alias("a"), F.max("dt_received").alias("b")).select(
        F.explode(F.sequence(F.trunc("a", "month"), F.trunc("b", "month"), F.expr("INTERVAL 1 MONTH"))).alias("m")
    ).select(F.last_day("m").alias("month_end"))
    for back, by in ((1, []), (12, []), (1, ["age"]), (3, ["age"])):
        want = flow.flow(flow.month_end_snapshots(df, m, by), back, by)
        got = flow.case_flow(df, m, back, by)
        assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect()))
        assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString().replace(
            "BroadcastNestedLoopJoin BuildRight, Cross", ""
        ).replace("BroadcastNestedLoopJoin BuildLeft, Cross", "")
    assert flow.case_flow(df.limit(0), m).count() == 0


def test_age_demand(spark):
    days = [DAY0 + dt.timedelta(days=k % 10) for k in range(95)]  # nine or ten a day
    df = spark.createDataFrame([(d, k % 4) for k, d in enumerate(days)], "d date, age int")
    got = {r.age: r for r in flow.age_demand(df, df, "d", "age").collect()}
    assert sum(r.share for r in got.values()) == pytest.approx(1)
    year = sum(r.expected for r in got.values())
    assert 365 * 9 <= year <= 365 * 10 and abs(year / 365 - 9.5) < 0.1
    assert all(r.expected == pytest.approx(r.share * year) for r in got.values())


# ---- sources


def test_synthetic_cases(spark):
    c = cases(spark, SF)
    for kind in ("gamma", "normal"):
        made = src.synth_cases(c, 7, kind)
        assert made.count() == c.count()
        sides = [
            {
                (r.case_type, r.risk): r
                for r in d.groupBy("case_type", "risk").agg(
                    F.count("*").alias("n"),
                    F.avg(F.datediff("dt_alloc", "dt_received")).alias("wait"),
                    F.avg(F.datediff("dt_signoff", "dt_alloc")).alias("work"),
                    F.avg(F.col("dt_signoff").isNotNull().cast("int")).alias("signed"),
                    F.avg(f).alias("legal"),
                ).collect()
            }
            for d, f in ((c, "needs_legal_review"), (made, "legal_review"))
        ]
        assert sides[0].keys() == sides[1].keys() and all(sides[0][k].n == sides[1][k].n for k in sides[0])
        for name, near in (("wait", 2.0), ("work", 5.0), ("signed", 0.05), ("legal", 0.05)):  # over all groups
            a, b = (sum(getattr(r, name) * r.n for r in s.values()) / sum(r.n for r in s.values()) for s in sides)
            assert abs(a - b) < near, (kind, name, a, b)
    with pytest.raises(ValueError):
        src.synth_cases(c, 7, "none")


def test_run_all_skips_the_trend_with_a_warning(spark, tmp_path, monkeypatch):
    raw = f"file://{tmp_path}/raw"
    plans.raw_cases(spark, SF).limit(300).write.csv(raw, header=True, sep=";", ignoreLeadingWhiteSpace=False)

    def broken(*_, **__):
        raise AnalysisException("no teams")

    def faulty(*_, **__):
        raise ValueError("a fault")

    monkeypatch.setattr(aggregates, "monthly_trend", broken)
    with pytest.warns(UserWarning, match="team trend skipped"):
        got = {r.name: r for r in src.run_all(spark, raw, f"file://{tmp_path}/out").collect()}
    assert "team_trend" not in got and {"engineered", "events", "backlog", "panel", "panel_summary", "annual"} == set(got)
    assert got["engineered"].rows == 300 and got["events"].first <= got["events"].last
    monkeypatch.setattr(aggregates, "monthly_trend", faulty)
    with pytest.raises(ValueError, match="a fault"):
        src.run_all(spark, raw, f"file://{tmp_path}/more")


def test_extract_encodings(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿Case ID;Name\n1;Zoë\n".encode())
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "part.csv").write_bytes("Case ID|Name\n1|Zoë\n2|€ 5\n".encode("cp1252"))
    for path in ("a.csv", "b"):
        r = src.read_extract(spark, f"file://{tmp_path}/{path}")
        assert r.columns == ["case_id", "name"] and [x.name for x in r.orderBy("case_id").collect()] == ["Zoë", "€ 5"][: r.count()]
    assert src.head_of(spark, f"file://{tmp_path}/a.csv", 6) == "﻿Cas".encode()


def test_validate_asks_for_missing_columns(spark):
    df = spark.createDataFrame([(1,), (None,)], "a int")
    got = {(r.column, r.check): r.failures for r in quality.validate(df, {"a": {"nullable": False}, "b": {"nullable": False}, "c": {}}).collect()}
    assert got == {("a", "null"): 1, ("b", "null"): 2}


def test_finished_days_equal_a_batch(spark):
    done = {(r.day, r.event_type): r.n for r in daily.run_finished(spark, SF).collect()}
    all_ = {(r.day, r.event_type): r.n for r in daily.daily_counts(spark.read.parquet(f"{SF}/events.parquet")).collect()}
    last = spark.read.parquet(f"{SF}/events.parquet").agg(F.max("ts")).first()[0]
    closed = {k: n for k, n in all_.items() if dt.datetime.combine(k[0], dt.time()) + dt.timedelta(days=1) <= last - dt.timedelta(days=7)}
    assert done == closed and 0 < len(done) < len(all_)


# ---- count models, features, classifiers


def numpy_counts(x, y, alpha):
    beta = np.r_[math.log(y.mean()), np.zeros(x.shape[1] - 1)]
    for _ in range(200):
        mu = np.exp(x @ beta)
        w = mu / (1 + alpha * mu)
        beta = np.linalg.solve((x * w[:, None]).T @ x, (x * w[:, None]).T @ (x @ beta + (y - mu) / mu))
    return beta


def test_backlog_models(spark):
    rng = np.random.default_rng(4)
    t, staff = np.arange(150.0), rng.integers(1, 9, 150).astype(float)
    x = np.stack([np.ones(150), staff, t], 1)
    mean = np.exp(2 - 0.1 * staff + 0.008 * t)
    for kind, y in (("negative binomial", rng.poisson(mean * rng.gamma(1.0, 1.0, 150)).astype(float)), ("poisson", np.round(mean / 6))):
        df = frame(spark, {"date": [DAY0 + dt.timedelta(days=k) for k in range(150)], "backlog": y, "staff": staff, "t": t}, date="date")
        name, w = models.fit_backlog(df)
        assert name == kind
        if kind == "poisson":
            assert np.abs(x.T @ (y - np.exp(x @ w))).max() < 1e-2  # score equations
        else:
            assert w == pytest.approx(numpy_counts(x, y, 1.0), rel=1e-5)
        r = models.staffing_scenario(df, w, 2.0).first()
        base, moved = np.exp(x @ w).mean(), np.exp(np.stack([np.ones(150), staff + 2, t], 1) @ w).mean()
        assert (r.base, r.scenario, r.effect) == pytest.approx((base, moved, moved - base))
        ahead = models.forecast_glm(df, w, 5).orderBy("date").collect()
        assert [a.predicted for a in ahead] == pytest.approx(
            [math.exp(w @ [1, np.median(staff), 149 + k]) for k in range(1, 6)]
        ) and ahead[0].date == DAY0 + dt.timedelta(days=150)


def test_preprocessor(spark):
    rows = [(1.0, 4.0, "a", "p", 1.0), (None, 6.0, "b", "p", 0.0), (3.0, 5.0, "a", "q", 1.0), (8.0, 1.0, "b", "q", 1.0)]
    df = spark.createDataFrame(rows, "n1 double, n2 double, c string, h string, y double")
    got = np.array([r.features.toArray() for r in models.preprocessor(["n1", "n2"], ["c"], high=["h"], y="y").fit(df).transform(df).collect()])
    x = np.array([[1.0, 4], [3, 6], [3, 5], [8, 1]])
    te = {"p": (1 + 10 * 0.75) / 12, "q": (2 + 10 * 0.75) / 12}
    want = np.c_[(x - x.mean(0)) / x.std(0, ddof=1), x[:, 0] * x[:, 1], [[1, 0], [0, 1], [1, 0], [0, 1]], [te[r[3]] for r in rows]]
    assert got == pytest.approx(want)


def review_rows(spark, n=1200):
    rng = np.random.default_rng(5)
    x, c = rng.normal(size=n), rng.choice(["a", "b", "c"], n)
    y = (rng.random(n) < 1 / (1 + np.exp(2 - 1.5 * x - (c == "a")))).astype(int)
    return frame(spark, {"id": np.arange(n), "x": x, "z": rng.normal(size=n), "c": c, "y": y}, id="long", c="string", y="int"), y


def test_review_models(spark, tmp_path):
    df, y = review_rows(spark)
    train, held = models.stratified_split(df, "y", "id")
    sizes = {r.y: r["count"] for r in held.groupBy("y").count().collect()}
    assert all(abs(sizes[k] / (y == k).sum() - 0.2) < 0.02 for k in (0, 1)) and train.count() + held.count() == len(y)
    for given in ({"mixes": (0.1, 0.9), "strengths": (0.001, 0.1), "folds": 2}, {"mixes": (0.0,), "strengths": (0.0,)}):
        model, auc, p = models.fit_review(df, "y", ["x", "z"], ["c"], "id", **given)
        assert auc > 0.75 and {r.id for r in p.collect()} == {r.id for r in held.collect()}
    src.save_model(model, {"auc": auc}, f"file://{tmp_path}/m", spark)
    loaded, saved = src.load_model(spark, f"file://{tmp_path}/m")
    assert saved.first().value == auc
    ours, theirs = ({r.id: r.probability[1] for r in m.transform(held.withColumn("y", F.col("y").cast("double"))).collect()} for m in (model, loaded))
    assert ours == pytest.approx(theirs)


@pytest.mark.parametrize("kind", ["bayes", "forest", "perceptron"])
def test_classifiers(spark, kind):
    rng = np.random.default_rng(6)
    y = np.arange(300) % 2
    df = frame(spark, {"a": rng.normal(size=300) + 4 * y, "b": rng.normal(size=300) - 4 * y, "y": y.astype(float)})
    got = models.fit_classifier(df, kind, "y", ["a", "b"]).agg(F.avg((F.col("prediction") == F.col("y")).cast("int"))).first()[0]
    assert got > 0.97
    with pytest.raises(ValueError):
        models.fit_classifier(df, "oracle", "y", ["a"])


def test_cox(spark):
    rng = np.random.default_rng(7)
    n = 120
    x = np.c_[rng.normal(size=n), rng.integers(0, 2, n)]
    t = np.ceil(rng.exponential(np.exp(-x @ [0.7, -0.5])) * 6)
    e = (rng.random(n) < 0.8).astype(int)

    def steps(beta):
        g, h = np.zeros(2), np.zeros((2, 2))
        for at in np.unique(t[e == 1]):
            r, dead = np.exp(x @ beta) * (t >= at), (t == at) & (e == 1)
            d = dead.sum()
            for k in range(d):
                w = r - k / d * r * dead
                m = w @ x / w.sum()
                g += x[dead].mean(0) - m
                h += (x * w[:, None]).T @ x / w.sum() - np.outer(m, m)
        return g, h

    beta = np.zeros(2)
    for _ in range(30):
        g, h = steps(beta)
        beta = beta + np.linalg.solve(h, g)
    got = models.fit_cox(frame(spark, {"t": t, "e": e, "a": x[:, 0], "b": x[:, 1]}, e="int"), "t", "e", ["a", "b"])
    assert got["coef"].to_numpy() == pytest.approx(beta, rel=1e-5) and got["se"].to_numpy() == pytest.approx(
        np.sqrt(np.diag(np.linalg.inv(steps(beta)[1]))), rel=1e-4
    )


# ---- pickups


def panel_of(spark, counts, days=60):
    return frame(
        spark,
        {
            "staff_id": [s for s in counts for _ in range(days)],
            "team": ["t"] * len(counts) * days,
            "date": [DAY0 + dt.timedelta(days=k) for _ in counts for k in range(days)],
            "event_newcase": [int(k < n) for n in counts.values() for k in range(days)],
        },
        staff_id="string",
        team="string",
        date="date",
        event_newcase="long",
    )


def test_pickup_posterior(spark):
    counts = {"a": 0, "b": 7, "c": 59}
    for r in models.pickup_posterior(panel_of(spark, counts)).collect():
        assert (r.shape, r.rate) == (1 + counts[r.staff_id], 61.0) and r.mean == pytest.approx(r.shape / 61) and r.expected_28 == pytest.approx(28 * r.mean)
        for q, v in ((0.05, r.p5), (0.5, r["median"]), (0.95, r.p95)):
            assert stats.gammaincc(r.shape, v * r.rate) == pytest.approx(1 - q, abs=1e-9)
    far = models.gamma_quantile(2e6, 3.0, 0.95) * 3.0
    assert far == pytest.approx(2e6 + 1.645 * math.sqrt(2e6), rel=1e-5)


def test_pickup_predictive_and_forecast(spark):
    counts = {"a": 3, "b": 41}
    panel = panel_of(spark, counts)
    got = {r.staff_id: r for r in models.pickup_predictive(panel, "staff_id").collect()}
    for s, n in counts.items():
        a, b = 1 + n, 61.0
        mass = [math.exp(math.lgamma(a + k) - math.lgamma(a) - math.lgamma(k + 1) + a * math.log(b / (b + 1)) - k * math.log(b + 1)) for k in range(50)]
        assert (got[s].p5, got[s].p95) == tuple(int(np.searchsorted(np.cumsum(mass), q)) for q in (0.05, 0.95)) and got[s].mean == pytest.approx(a / b)
    ahead = models.forecast_pickups(panel, "staff_id", 3).orderBy("staff_id", "date").collect()
    assert [(r.staff_id, (r.date - DAY0).days, r.p95) for r in ahead] == [(s, 60 + k, got[s].p95) for s in counts for k in range(3)]


def test_pickup_hazards(spark):
    rng = np.random.default_rng(8)
    n = 1500
    backlog = rng.integers(0, 40, n)
    event = ((rng.random(n) < 1 / (1 + np.exp(3 - backlog / 8))) & (backlog > 0)).astype(int)
    df = frame(
        spark,
        {
            "staff_id": [f"s{k % 5}" for k in range(n)],
            "date": [DAY0 + dt.timedelta(days=k // 5) for k in range(n)],
            "wip": rng.integers(0, 9, n),
            "time_since_last_pickup": rng.integers(0, 30, n),
            "weeks_since_start": np.arange(n) // 35,
            "backlog_available": backlog,
            "term_flag": np.ones(n, int),
            "event_newcase": event,
        },
        staff_id="string",
        date="date",
    )
    got = models.fit_pickup(df, "event_newcase", "backlog_available")
    assert got.count() == (backlog > 0).sum() and stats.class_metrics(got, "label", "p").first().auc > 0.7
    assert got.agg(F.avg("p")).first()[0] == pytest.approx(event[backlog > 0].mean(), abs=0.01)


# ---- series


def test_backlog_changes(spark):
    rng = np.random.default_rng(9)
    n = 200
    days = [DAY0 + dt.timedelta(days=k) for k in range(n)]
    y = np.cumsum(rng.normal(size=n) * 3 + np.sin(np.arange(n))) + 300
    df = frame(spark, {"date": days, "backlog_available": y}, date="date")
    fit = models.fit_delta(df)
    dy = np.diff(y)
    angle = 2 * np.pi * np.array([d.timetuple().tm_yday for d in days]) / 365.25
    x = np.array([[1.0, dy[k - 2], np.sin(angle[k]), np.cos(angle[k]), *(float(days[k].weekday() == w) for w in range(1, 7))] for k in range(2, n)])
    a = x.T @ x + np.eye(x.shape[1]) / 100
    assert fit["n"] == n - 2 and fit["mean"] == pytest.approx(
        np.linalg.solve(a, x.T @ dy[1:]), rel=1e-6
    ) and fit["cov"] == pytest.approx(np.linalg.inv(a), rel=1e-6)
    fan = models.forecast_fan(df, fit, 600, 10, 2025).orderBy("date").collect()
    assert [r.date for r in fan] == [days[-1] + dt.timedelta(days=k) for k in range(1, 11)]
    assert all(r.p5 <= r.p20 <= r.p50 <= r.p80 <= r.p95 for r in fan) and fan[9].p95 - fan[9].p5 > fan[0].p95 - fan[0].p5
    next_day = days[-1] + dt.timedelta(days=1)
    turn = 2 * np.pi * next_day.timetuple().tm_yday / 365.25
    step = fit["mean"] @ [1, dy[-1], np.sin(turn), np.cos(turn), *(float(next_day.weekday() == w) for w in range(1, 7))]
    assert abs(fan[0].mean - (y[-1] + step)) < 4 * math.sqrt(fit["scale"] / fit["shape"] / 600)


def test_smoothing_weights_are_fitted(spark):
    rng = np.random.default_rng(10)
    t = np.arange(60)
    exact = 5 + 0.5 * t + np.tile([3, -1, -4, 2.0], 15)
    assert models.smooth_path(exact, 4, 8) == pytest.approx(5 + 0.5 * np.arange(60, 68) + np.tile([3, -1, -4, 2.0], 2), abs=0.2)
    y = np.cumsum(rng.normal(size=60)) + np.tile([3, -1, -4, 2.0], 15)
    error = lambda w: models._smooth(y, 4, *(np.array([v]) for v in w), 1)[0][0]
    best = min(error((a, b, g)) for a in np.linspace(0, 1, 11) for b in np.linspace(0, 1, 11) for g in np.linspace(0, 1, 11))
    assert error(models.fit_smooth(y, 4)) <= best * 1.01
    df = frame(spark, {"k": ["a"] * 60, "t": t, "x": y}, k="string", t="int")
    assert [r.forecast for r in models.smooth_forecast(df, "k", "t", "x", 4, 3).orderBy("step").collect()] == pytest.approx(models.smooth_path(y, 4, 3))
    assert models.smooth_path(np.array([4.0]), 4, 2).tolist() == [4.0, 4.0]


def test_seasonal_autoregression():
    t = np.arange(48.0)
    season = np.tile([1.0, 5, 2, 0, 7, 3], 8)
    line = 3 + 2 * t + season
    want = 3 + 2 * np.arange(48, 54) + season[:6]
    assert models.seasonal_path(line, (1, 0, 0, 1, "c", 6, 0), 6) == pytest.approx(want, abs=1e-6)
    assert models.seasonal_path(line, (1, 1, 1, 1, "n", 6, 0), 6) == pytest.approx(want, abs=1e-6)
    ar = [1.0, 2.0]
    for _ in range(40):
        ar.append(4 + 0.5 * ar[-1] - 0.3 * ar[-2])
    ahead = list(ar)
    for _ in range(5):
        ahead.append(4 + 0.5 * ahead[-1] - 0.3 * ahead[-2])
    assert models.seasonal_path(np.array(ar), (2, 0, 0, 0, "c", 12, 0), 5) == pytest.approx(ahead[-5:], abs=1e-6)
    grown = np.expm1(0.1 * t + 1)
    assert models.seasonal_path(grown, (1, 0, 1, 0, "c", 12, 1), 3) == pytest.approx(np.expm1(0.1 * np.arange(48, 51) + 1), rel=1e-6)
    assert np.isnan(models.seasonal_path(np.array([1.0, 2]), (2, 1, 1, 1, "ct", 12, 0), 2)).all()


def test_grid(spark):
    assert len(models.GRID) == len(set(models.GRID)) == 388
    t = np.arange(60)
    y = 3 + 2.0 * t + np.tile([1.0, 5, 2, 0, 7, 3], 10)
    df = frame(spark, {"k": ["a"] * 60, "t": t, "x": y}, k="string", t="int")
    got = models.grid_forecast(df, "k", "t", "x", 6).orderBy("rank").collect()
    assert len(got) == 388 and [r.rank for r in got] == list(range(1, 389)) and got[0].rmse < 1e-6
    naive = next(r for r in got if r.config == "naive:1")
    assert naive.rmse == pytest.approx(math.sqrt(np.mean(np.diff(y)[-6:] ** 2)))
    known = [r.rmse for r in got if not math.isnan(r.rmse)]
    assert known == sorted(known) and all(math.isnan(r.rmse) for r in got[len(known) :])


def test_forecast_with_drivers(spark):
    rng = np.random.default_rng(11)
    w, y = rng.normal(size=50), np.zeros(50)
    for t in range(1, 50):
        y[t] = 1 + 0.6 * y[t - 1] + 2 * w[t]
    df = frame(spark, {"k": ["a"] * 50, "t": np.arange(50), "x": y, "w": w}, k="string", t="int")
    path, usual = y[-1], np.median(w[-12:])
    want = []
    for _ in range(4):
        path = 1 + 0.6 * path + 2 * usual
        want.append(path)
    assert [r.forecast for r in models.forecast_exog(df, "k", "t", "x", ["w"], [1], 4).orderBy("step").collect()] == pytest.approx(want)


# ---- unsupervised


def test_pca(spark):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(200, 4)) @ rng.normal(size=(4, 4))
    got = [r.share for r in models.pca(frame(spark, {f"c{k}": x[:, k] for k in range(4)}), [f"c{k}" for k in range(4)], 3).orderBy("component").collect()]
    values = np.sort(np.linalg.eigvalsh(np.corrcoef(x.T)))[::-1]
    assert got == pytest.approx((values / values.sum())[:3])


@pytest.mark.parametrize("bisecting", [False, True])
def test_clusters(spark, bisecting):
    rng = np.random.default_rng(13)
    who = np.arange(150) % 3
    at = np.array([[0, 0], [30, 0], [0, 30]])[who] + rng.normal(size=(150, 2))
    got = models.cluster(
        frame(spark, {"a": at[:, 0], "b": at[:, 1], "who": who}, who="int"), ["a", "b"], 3, bisecting
    ).groupBy("who").agg(F.collect_set("cluster").alias("c")).collect()
    assert all(len(r.c) == 1 for r in got) and len({r.c[0] for r in got}) == 3


# ---- synthetic data


def test_synthesis(spark):
    rng = np.random.default_rng(14)
    a = rng.gamma(2.0, 3.0, 3000)
    b = a * 2 + rng.normal(size=3000)
    g = rng.choice(["x", "y"], 3000, p=[0.8, 0.2])
    df = frame(spark, {"a": a, "b": b, "g": g}, g="string")
    made = privacy.synthesise(df, ["a", "b"], "g", 3000, 7).toPandas()
    assert len(made) == 3000 and abs(made["a"].mean() - a.mean()) < 0.4 and np.corrcoef(made["a"], made["b"])[0, 1] > 0.95 and abs(
        (made["g"] == "x").mean() - 0.8
    ) < 0.04
    assert set(np.round(made["a"], 6)) <= set(np.round(a, 6))


def test_stratified_synthesis(spark):
    rng = np.random.default_rng(15)
    g = np.array(["big"] * 1500 + ["mid"] * 400 + ["few"] * 20)
    a = np.where(g == "big", 10, np.where(g == "mid", 100, 1000)) + rng.normal(size=1920)
    b = np.where(g == "mid", -a, a) + rng.normal(size=1920)
    made = privacy.stratified_synthesis(frame(spark, {"a": a, "b": b, "g": g}, g="string"), ["a", "b"], ["g"], 7).toPandas()
    assert len(made) == 1920
    own = {k: made[made["g"] == k] for k in ("big", "mid")}
    at = {"big": (10, 10), "mid": (100, -100)}  # the back-off's rows have strata of any kind
    near = {k: d[((d["a"] - at[k][0]).abs() < 6) & ((d["b"] - at[k][1]).abs() < 9)] for k, d in own.items()}
    assert len(near["big"]) >= 1500 and len(near["mid"]) >= 400
    assert near["big"]["a"].corr(near["big"]["b"]) > 0.5 and near["mid"]["a"].corr(near["mid"]["b"]) < -0.5


def test_stratified_synthesis_draws_lots_without_carrying_parameters(spark):
    rng = np.random.default_rng(16)
    df = frame(spark, {"a": rng.normal(size=900), "b": rng.normal(size=900), "g": np.repeat(["x", "y", "z"], [500, 390, 10])}, g="string")
    made = privacy.stratified_synthesis(df, ["a", "b"], ["g"], 7, lot=7)
    assert made.count() == 900 and made.where("a IS NULL OR b IS NULL OR g IS NULL").count() == 0
    some = made.where("g IN ('x', 'y')").count()
    assert 890 <= some <= 900
    # no step below a draw deals rows that each hold all knots: lots are few and final when they are dealt
    plan = privacy.stratified_synthesis(df.where("g != 'z'"), ["a", "b"], ["g"], 7)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("RepartitionByExpression") and plan.count("Generate") == 1


def test_scores_count_the_knots_below(spark):
    knots = [3.0, 1.0, 1.0, 2.0]
    got = frame(spark, {"x": np.array([0.5, 1.0, 1.5, 2.0, 2.5, 3.0, 9.0])}).select("x", privacy._below(knots)("x").alias("n")).collect()
    assert all(r.n == sum(k < r.x for k in knots) for r in got) and len(got) == 7


@pytest.mark.parametrize("dim", [1, 2, 3])
def test_neighbour_gaps(spark, dim):
    rng = np.random.default_rng(16 + dim)
    real = np.r_[np.round(rng.normal(size=(150, dim)), 1), np.full((1, dim), 40.0), np.zeros((30, dim))]
    made = np.r_[np.round(rng.normal(size=(120, dim)), 1), np.zeros((5, dim))]
    cols = [f"c{k}" for k in range(dim)]
    got = privacy.neighbour_gaps(*(frame(spark, {c: x[:, k] for k, c in enumerate(cols)}) for x in (real, made)), cols).collect()
    points, n = np.unique(real, axis=0, return_counts=True)
    want = {tuple(p): (k, np.sqrt(((made - p) ** 2).sum(1)).min()) for p, k in zip(points.tolist(), n.tolist(), strict=True)}
    assert len(got) == len(want)
    for r in got:
        assert (r.n_, r.gap) == pytest.approx(want[tuple(r[c] for c in cols)])


@pytest.mark.parametrize("dim", [1, 2, 8])
def test_neighbour_gaps_by_many_parts(spark, dim):
    """Few points a leaf, few queries a chunk, copies, and real points far outside of all boxes."""
    rng = np.random.default_rng(dim)
    real = np.r_[rng.normal(size=(120, dim)), np.full((40, dim), 0.5) + rng.normal(size=(40, dim)) * 1e-3, np.full((1, dim), -90.0), np.full((3, dim), 1.0)]
    made = np.r_[rng.normal(size=(150, dim)), np.full((30, dim), 1.0), np.round(rng.normal(size=(60, dim)))]
    cols = [f"c{k}" for k in range(dim)]
    frames = [frame(spark, {c: x[:, k] for k, c in enumerate(cols)}) for x in (real, made)]
    for leaf, chunk in ((8, 5), (50, 1000)):
        got = {tuple(r[c] for c in cols): (r.n_, r.gap) for r in privacy.neighbour_gaps(*frames, cols, leaf, chunk).collect()}
        points, n = np.unique(real, axis=0, return_counts=True)
        assert len(got) == len(points)
        for x, k in zip(points, n.tolist(), strict=True):
            assert got[tuple(x.tolist())] == (k, pytest.approx(np.sqrt(((made - x) ** 2).sum(1)).min()))
    assert privacy.neighbour_gaps(frames[0].limit(0), frames[1], cols).count() == 0
    assert [r.gap for r in privacy.neighbour_gaps(frames[0].limit(2), frames[1].limit(0), cols).collect()] == [None] * frames[0].limit(2).count()


def test_points_are_sliced_by_the_number_of_boxes():
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"x": np.arange(10_000.0)})
    parts = list(privacy._sliced([batch, batch.slice(0, 0)], 4096))
    assert max(p.num_rows for p in parts) * 4096 <= privacy.DISTANCES
    assert np.concatenate([p.column("x").to_numpy() for p in parts]).tolist() == list(range(10_000))


def counted(spark, df, c):
    """df with c passed through a counter of evaluations."""
    seen = spark.sparkContext.accumulator(0)

    def same(v):
        seen.add(1)
        return v

    return df.withColumn(c, F.udf(same, "double")(F.col(c).cast("double"))), seen


def test_pickup_reads_its_panel_once(spark):
    days = spark.range(200).select(
        F.concat(F.lit("S"), F.col("id") % 4).alias("staff_id"), F.date_add(F.lit("2001-01-01").cast("date"), (F.col("id") / 4).cast("int")).alias("date"),
        (F.col("id") % 7).cast("double").alias("wip"), (F.col("id") % 5).alias("time_since_last_pickup"), (F.col("id") / 28).alias("weeks_since_start"),
        F.lit(3).alias("backlog_available"), (F.col("id") % 2).alias("term_flag"), (F.xxhash64("id") % 3 == 0).cast("int").alias("event"),
    )
    panel, seen = counted(spark, days, "wip")
    assert models.fit_pickup(panel, "event", "backlog_available").count() == 200 and seen.value == 200


def test_review_reads_its_cases_once(spark):
    rows = spark.range(300).select(
        "id", (F.xxhash64("id") % 3 == 0).cast("int").alias("y"), (F.col("id") % 11).cast("double").alias("a"), F.concat(F.lit("g"), F.col("id") % 3).alias("g")
    )
    cases, seen = counted(spark, rows, "a")
    held = models.fit_review(cases, "y", ["a"], ["g"], "id", mixes=(0.0,), strengths=(0.0,))[2]
    assert 0 < held.count() < 300 and seen.value == 300


def test_transfer_auc(spark):
    df, _ = review_rows(spark, 600)
    got = {r.measure: r.value for r in privacy.transfer_auc(df.where("id % 2 = 0"), df.where("id % 2 = 1"), ["x", "z"], "y").collect()}
    assert got.keys() == {"tstr_auc", "trts_auc"} and all(v > 0.7 for v in got.values())


def test_transfer_auc_is_exact_and_reads_its_rows_once(spark):
    rng = np.random.default_rng(8)
    n = 6000
    x, z, k = rng.integers(0, 5000, n) / 1000, rng.integers(0, 9, n).astype(float), np.full(n, 3.0)
    y = (rng.random(n) < 1 / (1 + np.exp(3 - x - 0.1 * z))).astype(int)
    df = frame(spark, {"id": np.arange(n), "x": x, "z": z, "k": k, "y": y}, id="long", y="int")
    cases, seen = counted(spark, df, "x")
    got = {r.measure: r.value for r in privacy.transfer_auc(cases.where("id % 2 = 0"), cases.where("id % 2 = 1"), ["x", "z", "k"], "y").collect()}
    assert seen.value == n

    def fitted(rows):
        a, b = np.c_[np.ones(n), x, z][rows], y[rows]
        w, beta = np.where(b == 1, 0.5 / b.mean(), 0.5 / (1 - b.mean())), np.zeros(3)
        for _ in range(30):
            p = 1 / (1 + np.exp(-a @ beta))
            beta += np.linalg.solve((a * (w * p * (1 - p))[:, None]).T @ a, a.T @ (w * (b - p)))
        return beta

    even = np.arange(n) % 2 == 0
    for name, train in (("tstr_auc", ~even), ("trts_auc", even)):
        score, held = (np.c_[np.ones(n), x, z] @ fitted(train))[~train], y[~train]
        a, b = score[held == 1][:, None], score[held == 0]
        assert got[name] == pytest.approx(((a > b) + (a == b) / 2).mean(), abs=1e-7)


def test_auc_by_ranges_of_scores(spark):
    rng = np.random.default_rng(3)
    score, y, side = np.where(rng.random(3000) < 0.5, 7.0, rng.integers(-400, 400, 3000) / 10), rng.integers(0, 2, 3000), rng.integers(0, 2, 3000)
    df = frame(spark, {"side_": side, "score_": score, "label_": y}, side_="int").repartition(5)
    sizes = {s: int((side == s).sum()) for s in (0, 1)}
    for ranked in (50, 1000, 10**6):
        got = privacy._aucs(df, sizes, ranked)
        for s in (0, 1):
            a, b = score[(side == s) & (y == 1)][:, None], score[(side == s) & (y == 0)]
            assert got[s] == pytest.approx(((a > b) + (a == b) / 2).mean(), abs=1e-12)


def test_transfer_auc_of_odd_sides(spark):
    df, _ = review_rows(spark, 300)
    even, odd = df.where("id % 2 = 0"), df.where("id % 2 = 1")
    auc = lambda a, b: {r.measure: r.value for r in privacy.transfer_auc(a, b, ["x", "z"], "y").collect()}
    assert auc(even, odd.where("y = 1")) == {"tstr_auc": 0.5, "trts_auc": None}
    assert auc(even, odd.limit(0)) == {"tstr_auc": 0.5, "trts_auc": None}
    apart = df.withColumn("x", F.col("y") * 2.0)
    assert auc(apart.where("id % 2 = 0"), apart.where("id % 2 = 1")) == {"tstr_auc": 1.0, "trts_auc": 1.0}


def test_profile_lists_only_short_columns(spark):
    df = spark.range(200).select((F.col("id") % 3).alias("few"), F.col("id").alias("many"), F.lit(None).cast("string").alias("none"))
    got = {r.column: r for r in aggregates.profile(df).collect()}
    assert got["few"]["values"] == "0|1|2" and got["many"]["values"] is None and got["many"].cardinality == 200 and "none" not in got
