"""Models: fits are MLlib or sums in Spark with a small solve on the driver; every prediction is a DataFrame."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier, NaiveBayes, RandomForestClassifier
from pyspark.ml.clustering import BisectingKMeans, KMeans
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import Imputer, Interaction, OneHotEncoder, StandardScaler, StringIndexer, TargetEncoder, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.ml.stat import Correlation, Summarizer
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scans import WHOLE, grouped_quantiles, kept, meet, over_rows, running
from .stats import gammaincc, gram

# ---- count models of the backlog


def backlog_design(backlog: DataFrame, staffing: DataFrame) -> DataFrame:
    """date, backlog, staff (0 where none), t (days since the first)."""
    d = backlog.join(staffing, "date", "left").fillna(0, subset=["staff"])
    return d.crossJoin(F.broadcast(backlog.agg(F.min("date").alias("d0")))).withColumn("t", F.datediff("date", "d0").cast("double")).drop("d0")


def _assembler(xs: Sequence[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=list(xs), outputCol="features", handleInvalid="skip")


def fit_backlog(df: DataFrame, y: str = "backlog", xs: Sequence[str] = ("staff", "t"), alpha: float = 1.0) -> tuple[str, np.ndarray]:
    """Log-link count model: Poisson, or negative binomial when (variance - mean) / mean exceeds 1. Weights, the constant first.

    The negative binomial is fitted by reweighted least squares: each step is one aggregate over the rows,
    which are kept while it runs.
    """
    d = df.select(F.col(y).cast("double").alias("y"), *(F.col(c).cast("double").alias(c) for c in xs)).dropna().persist()
    try:
        return _fit_counts(d, xs, alpha)
    finally:
        d.unpersist()


def _fit_counts(d: DataFrame, xs: Sequence[str], alpha: float) -> tuple[str, np.ndarray]:
    s = d.agg(F.avg("y").alias("m"), F.var_samp("y").alias("v")).first()
    if not s.m or ((s.v or 0) - s.m) / s.m <= 1:
        m = GeneralizedLinearRegression(family="poisson", link="log", labelCol="y").fit(_assembler(xs).transform(d))
        return "poisson", np.r_[m.intercept, m.coefficients.toArray()]
    sd = d.agg(*(F.stddev_pop(c).alias(c) for c in xs)).first()
    scale = np.array([1.0, *((sd[c] or 1.0) for c in xs)])
    beta = np.r_[math.log(s.m), np.zeros(len(xs))]
    for _ in range(50):
        eta = F.lit(float(beta[0] / scale[0]))
        for b, c, k in zip(beta[1:], xs, scale[1:], strict=True):
            eta = eta + F.lit(float(b / k)) * F.col(c)
        mu = F.exp(eta)
        w = mu / (1 + alpha * mu)
        work = d.select(
            *((F.sqrt(w) * F.col(c) / float(k)).alias(c) for c, k in zip(xs, scale[1:], strict=True)),
            F.sqrt(w).alias("one_"),
            (F.sqrt(w) * (eta + (F.col("y") - mu) / mu)).alias("y"),
        )
        cols = ["one_", *xs, "y"]
        row = work.agg(*(F.sum(F.col(a) * F.col(b)).alias(f"s{i}_{j}") for i, a in enumerate(cols) for j, b in enumerate(cols) if i <= j)).first()
        g = np.array([[row[f"s{min(i, j)}_{max(i, j)}"] for j in range(len(cols))] for i in range(len(cols))])
        new = np.linalg.pinv(g[:-1, :-1]) @ g[:-1, -1]
        done = np.abs(new - beta).max() < 1e-8
        beta = new
        if done:
            break
    return "negative binomial", beta / scale


def predict_backlog(df: DataFrame, weights: np.ndarray, xs: Sequence[str] = ("staff", "t")) -> DataFrame:
    eta = F.lit(float(weights[0]))
    for b, c in zip(weights[1:], xs, strict=True):
        eta = eta + F.lit(float(b)) * F.col(c)
    return df.withColumn("predicted", F.exp(eta))


def staffing_scenario(df: DataFrame, weights: np.ndarray, delta: float) -> DataFrame:
    """One row: mean predicted backlog now and with staff shifted (not below 0), and the difference."""
    moved = df.withColumn("staff", F.greatest(F.col("staff") + delta, F.lit(0.0)))
    a, b = (predict_backlog(x, weights).agg(F.avg("predicted").alias(n)) for x, n in ((df, "base"), (moved, "scenario")))
    return a.crossJoin(b).withColumn("effect", F.col("scenario") - F.col("base"))


def forecast_glm(df: DataFrame, weights: np.ndarray, days: int) -> DataFrame:
    """date, predicted for the days ahead, with staff at its median."""
    last = df.agg(F.max("date").alias("d1"), F.max("t").alias("t1"), F.percentile("staff", 0.5).alias("staff"))
    ahead = df.sparkSession.range(1, days + 1).crossJoin(F.broadcast(last)).select(
        F.date_add("d1", F.col("id").cast("int")).alias("date"), "staff", (F.col("t1") + F.col("id")).alias("t")
    )
    return predict_backlog(ahead, weights).select("date", "predicted")


# ---- features and classifiers


def preprocessor(numbers: Sequence[str], categories: Sequence[str], interactions: bool = True, high: Sequence[str] = (), y: str | None = None) -> Pipeline:
    """Median imputation, scaling, pairwise products, one-hot without the last level; columns of many levels get smoothed target means of y (0/1)."""
    stages = [
        Imputer(strategy="median", inputCols=list(numbers), outputCols=[f"{c}_i" for c in numbers]),
        VectorAssembler(inputCols=[f"{c}_i" for c in numbers], outputCol="n_"),
        StandardScaler(inputCol="n_", outputCol="numbers_", withMean=True),
    ]
    made = ["numbers_"]
    if interactions:
        for i, a in enumerate(numbers):
            for b in numbers[i + 1 :]:
                stages.append(Interaction(inputCols=[f"{a}_i", f"{b}_i"], outputCol=f"{a}_x_{b}"))
                made.append(f"{a}_x_{b}")
    for c in (*categories, *high):
        stages.append(StringIndexer(inputCol=c, outputCol=f"{c}_k", handleInvalid="keep", stringOrderType="alphabetAsc"))
        if c in high:
            stages.append(TargetEncoder(inputCols=[f"{c}_k"], outputCols=[f"{c}_t"], labelCol=y, targetType="binary", smoothing=10.0, handleInvalid="keep"))
            made.append(f"{c}_t")
        else:
            stages.append(OneHotEncoder(inputCol=f"{c}_k", outputCol=f"{c}_h", dropLast=True))
            made.append(f"{c}_h")
    return Pipeline(stages=[*stages, VectorAssembler(inputCols=made, outputCol="features")])


def target_encode(df: DataFrame, c: str, y: str, smooth: float = 10.0, folds: int = 0, key: str | None = None) -> DataFrame:
    """df with c_te: (n mean + s prior) / (n + s); with folds, from the other folds only (by a hash of key)."""
    d = df.withColumn("fold_", F.pmod(F.xxhash64(key or c), F.lit(folds)) if folds else F.lit(0))
    per = d.groupBy(F.col(c).alias("v_"), "fold_").agg(F.sum(y).alias("s_"), F.count(y).alias("n_"))
    if folds:
        all_ = per.groupBy("v_").agg(F.sum("s_").alias("ts"), F.sum("n_").alias("tn"))
        per = all_.crossJoin(df.sparkSession.range(folds).withColumnRenamed("id", "fold_")).join(per, ["v_", "fold_"], "left").fillna(0, subset=["s_", "n_"]).select(
            "v_", "fold_", (F.col("ts") - F.col("s_")).alias("s_"), (F.col("tn") - F.col("n_")).alias("n_")
        )
    prior = F.broadcast(df.agg(F.avg(y).alias("prior_")))
    out = d.join(per, F.col(c).eqNullSafe(F.col("v_")) & (d["fold_"] == per["fold_"]), "left").drop(per["fold_"]).crossJoin(prior)
    return out.withColumn(
        f"{c}_te", (F.coalesce("s_", F.lit(0)) + smooth * F.col("prior_")) / (F.coalesce("n_", F.lit(0)) + smooth)
    ).drop("v_", "fold_", "s_", "n_", "prior_")


def stratified_split(df: DataFrame, y: str, key: str, share: float = 0.2) -> tuple[DataFrame, DataFrame]:
    """Training rows and held-out ones: of each class the stated share, those with the largest hashes of the key."""
    h = F.pmod(F.xxhash64(key), F.lit(1 << 30))
    cuts = df.groupBy(y).agg(F.percentile_approx(h, 1 - share, 100_000).alias("cut")).collect()  # one row a class
    cut = F.coalesce(*(F.when(F.col(y).eqNullSafe(F.lit(r[y])), F.lit(r.cut)) for r in cuts), F.lit(0))
    return df.where(h <= cut), df.where(h > cut)


def fit_review(
    df: DataFrame,
    y: str,
    numbers: Sequence[str],
    categories: Sequence[str],
    key: str,
    mixes: Sequence[float] = (0.1, 0.9),
    strengths: Sequence[float] = (0.001, 0.1),
    folds: int = 3,
    high: Sequence[str] = (),
) -> tuple[PipelineModel, float, DataFrame]:
    """Logistic model with balanced weights; model, held-out AUC, held-out predictions.

    An elastic net chosen by cross-validation; with one mix and one strength a single fit (0 and 0: plain).
    The held-out fifth is stratified by class.
    """
    # read by every fold and round: written once, so that a round has as few tasks as its bytes need
    df = kept(df.select(key, y, *numbers, *categories, *high), "review")
    share = df.groupBy(y).count().collect()  # one row a class
    total = sum(r["count"] for r in share)
    weight = F.lit(1.0)
    for r in share:
        weight = F.when(F.col(y) == r[y], total / (len(share) * r["count"])).otherwise(weight)
    train, test = stratified_split(df.withColumn(y, F.col(y).cast("double")).withColumn("weight_", weight), y, key)
    lr = LogisticRegression(labelCol=y, weightCol="weight_", maxIter=50, elasticNetParam=mixes[0], regParam=strengths[0])
    pipe = Pipeline(stages=[preprocessor(numbers, categories, high=high, y=y), lr])
    score = BinaryClassificationEvaluator(labelCol=y)
    if len(mixes) * len(strengths) > 1:
        grid = ParamGridBuilder().addGrid(lr.elasticNetParam, list(mixes)).addGrid(lr.regParam, list(strengths)).build()
        best = CrossValidator(estimator=pipe, estimatorParamMaps=grid, evaluator=score, numFolds=folds, seed=7, parallelism=2).fit(train).bestModel
    else:
        best = pipe.fit(train)
    held = best.transform(test)
    return best, score.evaluate(held), held.select(key, y, vector_to_array("probability")[1].alias("p"))


def logit(df: DataFrame, y: str, cat: str) -> DataFrame:
    """term, coef of a binomial regression on a category; the least level is the base."""
    levels = [r[0] for r in df.select(cat).where(F.col(cat).isNotNull()).distinct().orderBy(cat).collect()]  # one row a level
    d = df.dropna(subset=[y, cat]).select(
        F.col(y).cast("double").alias("label"), *((F.col(cat) == v).cast("double").alias(f"l{k}") for k, v in enumerate(levels[1:]))
    )
    m = GeneralizedLinearRegression(family="binomial", link="logit", labelCol="label").fit(_assembler(d.columns[1:]).transform(d))
    return df.sparkSession.createDataFrame(
        [("const", float(m.intercept)), *((str(v), float(c)) for v, c in zip(levels[1:], m.coefficients, strict=True))], "term string, coef double"
    )


def fit_classifier(df: DataFrame, kind: str, y: str, xs: Sequence[str]) -> DataFrame:
    """df with prediction. kind: bayes (Gaussian), forest or perceptron."""
    classes = df.agg(F.count_distinct(y)).first()[0]
    made = {
        "bayes": lambda: NaiveBayes(modelType="gaussian", labelCol=y),
        "forest": lambda: RandomForestClassifier(labelCol=y, numTrees=20, seed=7),
        "perceptron": lambda: MultilayerPerceptronClassifier(labelCol=y, layers=[len(xs), 8, classes], seed=7, maxIter=50),
    }
    if kind not in made:
        raise ValueError(f"kind is one of {', '.join(made)}")
    pipe = Pipeline(stages=[_assembler(xs), made[kind]()])
    return pipe.fit(df).transform(df)


def fit_cox(df: DataFrame, duration: str, event: str, xs: Sequence[str], rounds: int = 15, whole: int = WHOLE) -> pd.DataFrame:
    """feature, coef, hazard_ratio, se: proportional hazards with Efron's ties.

    Each Newton step is one pass: sums by distinct time, running sums over times from the last, one
    aggregate. The rows are kept while it runs.
    """
    rows = df.select(F.col(duration).cast("double").alias("t"), F.col(event).cast("int").alias("e"), *(F.col(c).cast("double").alias(c) for c in xs)).dropna()
    mean = rows.agg(*(F.avg(c).alias(c) for c in xs)).first()
    d = rows.select("t", "e", *((F.col(c) - float(mean[c])).alias(c) for c in xs)).persist()
    k, beta = len(xs), np.zeros(len(xs))
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    for _ in range(rounds):
        eta = sum((F.lit(float(b)) * F.col(c) for b, c in zip(beta, xs, strict=True)), F.lit(0.0))
        r = F.exp(eta)
        terms = {"s0": r, **{f"s1_{i}": r * F.col(xs[i]) for i in range(k)}, **{f"s2_{i}_{j}": r * F.col(xs[i]) * F.col(xs[j]) for i, j in pairs}}
        per = d.groupBy("t").agg(
            F.sum("e").alias("d"),
            *(F.sum(v).alias(n) for n, v in terms.items()),
            *(F.sum(F.when(F.col("e") == 1, v).otherwise(0.0)).alias(f"{n}_e") for n, v in terms.items()),
            *(F.sum(F.when(F.col("e") == 1, F.col(xs[i])).otherwise(0.0)).alias(f"x_{i}") for i in range(k)),
        )
        risk = running(per, "t", list(terms), descending=True, whole=whole)
        risk = risk.select("d", *(F.col(f"to_{n}").alias(n) for n in terms), *(f"{n}_e" for n in terms), *(f"x_{i}" for i in range(k))).where("d > 0")
        each = risk.withColumn("l", F.explode(F.sequence(F.lit(0), F.col("d").cast("int") - 1)))
        share = F.col("l") / F.col("d")
        z = {n: F.col(n) - share * F.col(f"{n}_e") for n in terms}
        grad = {f"g{i}": F.sum(F.col(f"x_{i}") / F.col("d") - z[f"s1_{i}"] / z["s0"]) for i in range(k)}
        hess = {f"h{i}_{j}": F.sum(z[f"s2_{i}_{j}"] / z["s0"] - z[f"s1_{i}"] * z[f"s1_{j}"] / (z["s0"] * z["s0"])) for i, j in pairs}
        row = each.agg(*(v.alias(n) for n, v in {**grad, **hess}.items())).first()
        g = np.array([row[f"g{i}"] for i in range(k)])
        h = np.array([[row[f"h{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
        step = np.linalg.pinv(h) @ g
        beta = beta + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    d.unpersist()
    se = np.sqrt(np.clip(np.diag(np.linalg.pinv(h)), 0, None))
    return pd.DataFrame({"feature": list(xs), "coef": beta, "hazard_ratio": np.exp(beta), "se": se, "mean": [float(mean[c]) for c in xs]})


def _hazard(fit: pd.DataFrame) -> Column:
    """exp of the linear predictor about the means of the rows that were fitted."""
    return F.exp(sum(((F.col(r.feature) - float(r.mean)) * float(r.coef) for r in fit.itertuples()), F.lit(0.0)))


def cox_baseline(df: DataFrame, duration: str, event: str, fit: pd.DataFrame, whole: int = WHOLE) -> DataFrame:
    """t, events, at_risk (summed hazards), hazard, cumulative, survival at the columns' means: Breslow's step function, one row a time with events."""
    d = df.dropna(subset=[duration, event, *fit["feature"]]).select(
        F.col(duration).cast("double").alias("t"), F.col(event).cast("int").alias("e"), _hazard(fit).alias("r")
    )
    per = running(d.groupBy("t").agg(F.sum("e").alias("d"), F.sum("r").alias("r")), "t", ["r"], descending=True, whole=whole)
    steps = per.where("d > 0").select("t", F.col("d").alias("events"), F.col("to_r").alias("at_risk"), (F.col("d") / F.col("to_r")).alias("hazard"))
    return running(steps, "t", ["hazard"], whole=whole).select(
        "t", "events", "at_risk", "hazard", F.col("to_hazard").alias("cumulative"), F.exp(-F.col("to_hazard")).alias("survival")
    )


def cox_score(df: DataFrame, duration: str, fit: pd.DataFrame, baseline: DataFrame, whole: int = WHOLE) -> DataFrame:
    """df with partial_hazard, cumulative_hazard and survival at each row's duration; null where a column is null.

    The step at a duration is that of the last time of the baseline that isn't after it: the durations and
    the baseline's steps are scanned together, one row a distinct time, and joined back by time.
    """
    times = df.select(F.col(duration).cast("double").alias("t")).where("t IS NOT NULL").distinct().withColumn("hazard", F.lit(0.0))
    both = times.unionByName(baseline.select("t", "hazard")).groupBy("t").agg(F.sum("hazard").alias("hazard"))
    steps = running(both, "t", ["hazard"], whole=whole).select(F.col("t").alias("step_t"), F.col("to_hazard").alias("step"))
    out = df.join(steps, F.col(duration).cast("double") == F.col("step_t"), "left").withColumn("partial_hazard", _hazard(fit))
    out = out.withColumn("cumulative_hazard", F.col("step") * F.col("partial_hazard")).withColumn("survival", F.exp(-F.col("cumulative_hazard")))
    return out.drop("step_t", "step")


# ---- pickups


def gamma_quantile(shape: float, rate: float, q: float) -> float:
    """Quantile of a gamma distribution, by bisection of its upper tail."""
    lo, hi = 0.0, shape + 20 * math.sqrt(shape) + 50
    while hi - lo > 1e-12 * hi:
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if gammaincc(shape, mid) > 1 - q else (lo, mid)
        if mid in (lo, hi) and lo + (hi - lo) / 2 in (lo, hi):
            break
    return (lo + hi) / 2 / rate


def pickup_posterior(panel: DataFrame, by: str = "staff_id") -> DataFrame:
    """Gamma posterior of the daily pickup rate: shape 1 + pickups, rate 1 + days; mean, median, p5, p95, expectations of 7 and 28 days."""
    g = panel.groupBy(by).agg((1 + F.sum("event_newcase")).cast("int").alias("shape"), (1.0 + F.count("*")).alias("rate"))

    @F.pandas_udf("struct<p5:double,median:double,p95:double>")
    def quantiles(shape: pd.Series, rate: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(
            {n: [gamma_quantile(float(a), float(b), q) for a, b in zip(shape, rate, strict=True)] for n, q in (("p5", 0.05), ("median", 0.5), ("p95", 0.95))}
        )

    mean = F.col("shape") / F.col("rate")
    return g.withColumn("q", quantiles("shape", "rate")).select(
        by, "shape", "rate", mean.alias("mean"), "q.median", "q.p5", "q.p95", (7 * mean).alias("expected_7"), (28 * mean).alias("expected_28")
    )


def pickup_predictive(panel: DataFrame, by: str) -> DataFrame:
    """Posterior predictive of a day's pickups for each key: negative binomial mean, p5, p95."""
    g = panel.groupBy(by).agg((1 + F.sum("event_newcase")).cast("int").alias("shape"), (1.0 + F.count_distinct("date")).alias("rate"))

    @F.pandas_udf("struct<p5:int,p95:int>")
    def quantiles(shape: pd.Series, rate: pd.Series) -> pd.DataFrame:
        out = []
        for a, b in zip(shape, rate, strict=True):
            k, found = 0, []
            log = -a * math.log1p(1 / b)  # of the mass at k, which may be too small for a number
            total = math.exp(log)
            for q in (0.05, 0.95):
                while total < q:
                    log += math.log((a + k) / (k + 1) / (b + 1))
                    k, total = k + 1, total + math.exp(log)
                found.append(k)
            out.append(found)
        return pd.DataFrame(out, columns=["p5", "p95"])

    return g.withColumn("q", quantiles("shape", "rate")).select(by, (F.col("shape") / F.col("rate")).alias("mean"), "q.p5", "q.p95")


def forecast_pickups(panel: DataFrame, by: str, days: int = 90) -> DataFrame:
    """The predictive of each key over the days after the panel."""
    last = F.broadcast(panel.agg(F.max("date").alias("d1")))
    ahead = F.broadcast(panel.sparkSession.range(1, days + 1))
    return pickup_predictive(panel, by).crossJoin(last).crossJoin(ahead).select(
        by, F.date_add("d1", F.col("id").cast("int")).alias("date"), "mean", "p5", "p95"
    )


def fit_pickup(panel: DataFrame, event: str, gate: str) -> DataFrame:
    """staff_id, date, p: chance of an event on a day with a positive gate, by logistic regression on panel features.

    The effect of staff is a target mean from the other folds of days.
    """
    # the panel is made once: the folds' means, the scaler, the fit and the scores all read it
    cols = ["staff_id", "date", "wip", "time_since_last_pickup", "weeks_since_start", "backlog_available", "term_flag"]
    d = kept(panel.where(F.col(gate) > 0).select(*cols, (F.col(event) > 0).cast("double").alias("label")), "panel")
    d = target_encode(d, "staff_id", "label", 20.0, folds=5, key="date")
    pipe = Pipeline(
        stages=[
            _assembler(["wip", "time_since_last_pickup", "weeks_since_start", "backlog_available", "term_flag", "staff_id_te"]),
            StandardScaler(inputCol="features", outputCol="scaled"),
            LogisticRegression(featuresCol="scaled", regParam=1e-3, maxIter=50),
        ]
    )
    return pipe.fit(d).transform(d).select("staff_id", "date", "label", vector_to_array("probability")[1].alias("p"))


# ---- backlog changes and forecasts


def delta_design(backlog: DataFrame) -> DataFrame:
    """date, dy, dy1 (the change before), annual terms, weekdays."""
    from ..functions.scalars import fourier

    w = Window.orderBy("date")  # one row a day
    d = backlog.withColumn("dy", (F.col("backlog_available") - F.lag("backlog_available").over(w)).cast("double"))
    return fourier(d.withColumn("dy1", F.lag("dy").over(w)), "date")


DELTA_TERMS = ("dy1", "sin_year", "cos_year", *(f"dow_{k}" for k in range(1, 7)))


def fit_delta(backlog: DataFrame, prior: float = 10.0) -> dict:
    """Conjugate regression of the daily change: posterior mean and covariance of the weights, and of the noise."""
    g, n = gram(delta_design(backlog), "dy", DELTA_TERMS)
    a, b = g[:-1, :-1] + np.eye(len(g) - 1) / prior**2, g[:-1, -1]
    cov = np.linalg.inv(a)
    mean = cov @ b
    shape, scale = 1 + n / 2, 1 + max(float(g[-1, -1] - mean @ a @ mean), 0.0) / 2
    return {"mean": mean, "cov": cov, "shape": shape, "scale": scale, "n": n}


def _terms_ahead(last, days: int) -> np.ndarray:
    """The terms of the days after the last, without the change before."""
    ahead = pd.date_range(pd.Timestamp(last) + pd.Timedelta(days=1), periods=days)
    angle = 2 * np.pi * ahead.dayofyear.to_numpy() / 365.25
    return np.c_[np.ones(days), np.zeros(days), np.sin(angle), np.cos(angle), *[(ahead.weekday.to_numpy() == k).astype(float) for k in range(1, 7)]]


def history_fan(backlog: DataFrame, fit: dict, days: int, **options) -> DataFrame:
    """date, n, mean, p5, p20, p50, p80, p95 of the backlog ahead, from what the model missed in the past; nothing is drawn.

    From every day of the history the model's path is carried `days` days ahead, and its errors are kept by
    horizon. The path from the last day plus the mean and the quantiles of the n errors at a horizon make
    the fan, from zero up. A horizon that no day of the history reaches has no figures but its date.
    """
    w = [float(x) for x in fit["mean"]]
    d = delta_design(backlog)
    known = sum((F.lit(b) * F.col(t) for b, t in zip(w[2:], DELTA_TERMS[1:], strict=True)), F.lit(w[0]))
    d = kept(d.select("date", F.col("backlog_available").cast("double").alias("y"), F.coalesce("dy", F.lit(0.0)).alias("dy"), known.alias("known")), "days")
    ahead = lambda rows: {"ahead": F.collect_list(F.struct("known", "y")).over(rows.rowsBetween(1, days))}
    each = over_rows(d, "date", ahead, 0, days, **options)

    def step(path: Column, day: Column) -> Column:
        change = day["known"] + F.lit(w[1]) * path["dy"]
        y = F.greatest(F.lit(0.0), path["y"] + change)
        return F.struct(change.alias("dy"), y.alias("y"), F.concat(path["e"], F.array(day["y"] - y)).alias("e"))

    start = F.struct(F.col("dy"), F.col("y"), F.array().cast("array<double>").alias("e"))
    errors = kept(each.select(F.posexplode(F.aggregate("ahead", start, step, lambda path: path["e"])).alias("h", "e")), "errors")
    last = d.orderBy(F.desc("date")).limit(1).first()
    points, y, dy = [], last.y, last.dy
    for h, fixed in enumerate(_terms_ahead(last.date, days)):
        dy = float(fixed @ np.array(w)) + w[1] * dy
        y = max(0.0, y + dy)
        points.append((h, y))
    path = d.sparkSession.createDataFrame(points, "h int, y double")  # one row a day ahead
    names = {f"p{p}": p / 100 for p in (5, 20, 50, 80, 95)}
    spread = meet(errors.groupBy("h").agg(F.count("*").alias("n"), F.avg("e").alias("mean")), grouped_quantiles(errors, ["h"], "e", names), ["h"])
    out = meet(path, spread, ["h"], "left")
    return out.select(
        F.date_add(F.lit(last.date), F.col("h") + 1).alias("date"),
        F.coalesce("n", F.lit(0)).alias("n"),
        *(F.when(F.col(c).isNotNull(), F.greatest(F.lit(0.0), F.col("y") + F.col(c))).alias(c) for c in ("mean", *names)),
    )


def forecast_fan(backlog: DataFrame, fit: dict, paths: int, days: int, seed: int) -> DataFrame:
    """date, mean, p5, p20, p50, p80, p95 of the backlog over paths of drawn weights and noise; a path has its own seed."""
    spark = backlog.sparkSession
    last = delta_design(backlog).orderBy(F.desc("date")).limit(1).first()
    root = np.linalg.cholesky(fit["cov"] + 1e-12 * np.eye(len(fit["cov"])))
    mean, shape, scale = fit["mean"], fit["shape"], fit["scale"]
    fixed = _terms_ahead(last.date, days)
    y0, dy0, first = float(last.backlog_available), float(last.dy or 0.0), last.date

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for path in pdf["id"]:
                rng = np.random.default_rng([seed, int(path)])
                sigma = math.sqrt(scale / rng.gamma(shape))
                w = mean + sigma * root @ rng.normal(size=len(mean))
                y, dy = y0, dy0
                noise = rng.normal(size=days) * sigma
                for h in range(days):
                    dy = float(fixed[h] @ w + w[1] * dy + noise[h])
                    y = max(0.0, y + dy)
                    out.append((int(path), h + 1, y))
            yield pd.DataFrame(out, columns=["path", "h", "y"])

    drawn = spark.range(paths).mapInPandas(run, "path long, h int, y double")
    q = F.percentile("y", [0.05, 0.2, 0.5, 0.8, 0.95])
    fan = drawn.groupBy("h").agg(F.avg("y").alias("mean"), q.alias("q"))
    return fan.select(F.date_add(F.lit(first), F.col("h")).alias("date"), "mean", *(F.col("q")[i].alias(f"p{p}") for i, p in enumerate((5, 20, 50, 80, 95))))


def naive_forecast(df: DataFrame, order: str, c: str, horizon: int, season: int = 1) -> DataFrame:
    """step, forecast: the last value, or that of the same place in the last season."""
    w = Window.orderBy(F.desc(order))  # one row a period
    tail = df.select(F.col(c).alias("v"), F.row_number().over(w).alias("k")).where(F.col("k") <= season)
    steps = df.sparkSession.range(1, horizon + 1).select(F.col("id").cast("int").alias("step"))
    return steps.join(F.broadcast(tail), F.col("k") == season - (F.col("step") - 1) % season).select("step", F.col("v").alias("forecast"))


def _smooth(y: np.ndarray, m: int, a: np.ndarray, b: np.ndarray, g: np.ndarray, horizon: int) -> tuple[np.ndarray, np.ndarray]:
    """Additive exponential smoothing for many weights at once: squared one-step errors past the first two seasons, and the paths ahead."""
    level, trend = np.full(len(a), y[:m].mean()), np.full(len(a), (y[m : 2 * m].mean() - y[:m].mean()) / m)
    s = np.tile(y[:m] - y[:m].mean() if m > 1 else np.zeros(1), (len(a), 1))
    error = np.zeros(len(a))
    for t, x in enumerate(y):
        k = t % m
        if t >= 2 * m:
            error += (x - level - trend - s[:, k]) ** 2
        before = level
        level = a * (x - s[:, k]) + (1 - a) * (level + trend)
        trend = b * (level - before) + (1 - b) * trend
        if m > 1:
            s[:, k] = g * (x - level) + (1 - g) * s[:, k]
    return error, np.stack([level + (h + 1) * trend + s[:, (len(y) + h) % m] for h in range(horizon)], 1)


def fit_smooth(y: np.ndarray, m: int) -> tuple[float, float, float]:
    """Weights of level, trend and season with the least squared one-step errors: a grid, then halved steps about the best."""
    at, step = np.array([0.5, 0.25, 0.25 if m > 1 else 0.0]), 0.4
    while step > 0.005:
        moves = np.array([(i, j, k) for i in (-1, -0.5, 0, 0.5, 1) for j in (-1, -0.5, 0, 0.5, 1) for k in ((-1, -0.5, 0, 0.5, 1) if m > 1 else (0,))]) * step
        tried = np.clip(at + moves, 0.0, 1.0)
        at = tried[_smooth(y, m, *tried.T, 1)[0].argmin()]
        step /= 2
    return tuple(at.tolist())


def smooth_path(y: np.ndarray, m: int, horizon: int, weights: Sequence[float] | None = None) -> np.ndarray:
    """Additive exponential smoothing with trend and season (m = 1: no season); weights are fitted unless stated."""
    if len(y) < 2 * m or len(y) < 3:
        return np.full(horizon, y[-1] if len(y) else np.nan)
    a, b, g = (np.array([v]) for v in weights or fit_smooth(y, m))
    return _smooth(y, m, a, b, g, horizon)[1][0]


def ar_path(y: np.ndarray, lags: Sequence[int], horizon: int, x: np.ndarray | None = None, ahead: np.ndarray | None = None) -> np.ndarray:
    """Least-squares autoregression on the stated lags (and exogenous columns), carried forward."""
    top = max(lags)
    if len(y) < 2 * top + 3:
        return np.full(horizon, y[-1] if len(y) else np.nan)
    rows = np.array([[1.0, *(y[t - k] for k in lags), *([] if x is None else x[t])] for t in range(top, len(y))])
    w = np.linalg.lstsq(rows, y[top:], rcond=None)[0]
    path = list(y)
    for h in range(horizon):
        path.append(float(np.r_[1.0, [path[-k] for k in lags], [] if ahead is None else ahead[h]] @ w))
    return np.array(path[len(y) :])


def smooth_forecast(df: DataFrame, key: str, order: str, c: str, m: int, horizon: int) -> DataFrame:
    """key, step, forecast by exponential smoothing of each series; a series is one group of a period a row."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        y = pdf.sort_values(order)[c].to_numpy(float)
        return pd.DataFrame({key: pdf[key].iloc[0], "step": np.arange(1, horizon + 1, dtype=np.int32), "forecast": smooth_path(y, m, horizon)})

    return df.select(key, order, c).groupBy(key).applyInPandas(run, f"{key} {dict(df.dtypes)[key]}, step int, forecast double")


def seasonal_path(y: np.ndarray, config: Sequence, horizon: int) -> np.ndarray:
    """Least-squares autoregression on differences. config: lags, seasonal lags, differences, seasonal differences (of each one or none but lags), trend (n, c, t, ct), season, logarithm."""
    lags, seasonal, diff, season_diff, trend, m, log = config
    z = np.log1p(np.clip(y, 0, None)) if log else y.astype(float)
    steps = [1] * diff + [m] * season_diff
    w, undo = z, []
    for k in steps:
        undo.append(w)
        w = w[k:] - w[:-k]
    back = [*range(1, lags + 1), *(k * m for k in range(1, seasonal + 1))]
    top = max(back, default=0)

    def known(t: int, past: np.ndarray) -> list[float]:
        return [*([1.0] if "c" in trend else []), *([float(t)] if "t" in trend else []), *(past[t - k] for k in back)]

    columns = len(known(top, w)) if len(w) > top else 0
    if not columns or len(w) - top < columns + 2:
        return np.full(horizon, np.nan)
    beta = np.linalg.lstsq(np.array([known(t, w) for t in range(top, len(w))]), w[top:], rcond=None)[0]
    path = w.tolist()
    for _ in range(horizon):
        path.append(float(np.dot(known(len(path), path), beta)))
    for k, base in zip(steps[::-1], undo[::-1], strict=True):
        whole = base.tolist()
        for x in path[len(base) - k :]:
            whole.append(whole[-k] + x)
        path = whole
    out = np.array(path[len(y) :])
    return np.expm1(out) if log else out


#: The grid's configurations: naive and smoothing models by season, and autoregressions by all choices of seasonal_path.
GRID = (
    *(f"{kind}:{m}" for kind in ("naive", "smooth") for m in (1, 12)),
    *(
        f"ar:{p},{sp},{d},{sd},{trend},{m},{log}"
        for p in (1, 2) for sp in (0, 1) for d in (0, 1) for sd in (0, 1) for trend in ("n", "c", "t", "ct") for m in (3, 6, 12) for log in (0, 1)
    ),
)


def _path(config: str, y: np.ndarray, horizon: int) -> np.ndarray:
    kind, _, arg = config.partition(":")
    if kind == "naive":
        m = int(arg)
        return np.array([y[-m + h % m] if len(y) >= m else np.nan for h in range(horizon)])
    if kind == "smooth":
        return smooth_path(y, int(arg), horizon)
    p, sp, d, sd, trend, m, log = arg.split(",")
    return seasonal_path(y, (int(p), int(sp), int(d), int(sd), trend, int(m), int(log)), horizon)


def _walk(y: np.ndarray, config: str, cuts: np.ndarray) -> np.ndarray:
    """One-step forecasts of y at the cuts, each from what lies before it.

    An autoregression's differences and design rows depend on its configuration alone, so they are made
    once; a cut takes the rows before it. A forecast of a difference plus what was subtracted is one of y.
    """
    kind, _, arg = config.partition(":")
    if kind != "ar":
        return np.array([_path(config, y[:t], 1)[0] for t in cuts])
    p, sp, diff, season_diff, trend, m, log = arg.split(",")
    m = int(m)
    z = np.log1p(np.clip(y, 0, None)) if int(log) else y.astype(float)
    w = z
    for k in [1] * int(diff) + [m] * int(season_diff):
        w = w[k:] - w[:-k] if len(w) > k else w[:0]
    lost = len(z) - len(w)
    back = [*range(1, int(p) + 1), *(k * m for k in range(1, int(sp) + 1))]
    top = max(back)
    out = np.full(len(cuts), np.nan)
    if len(w) <= top:
        return out
    t = np.arange(top, len(w))
    x = np.column_stack([*([np.ones(len(t))] if "c" in trend else []), *([t.astype(float)] if "t" in trend else []), *(w[t - k] for k in back)])
    for i, cut in enumerate(cuts):
        n = cut - lost - top  # rows before the cut
        if n >= x.shape[1] + 2:
            beta = np.linalg.lstsq(x[:n], w[top : top + n], rcond=None)[0]
            out[i] = x[n] @ beta + z[cut] - w[cut - lost]
    return np.expm1(out) if int(log) else out


def grid_forecast(df: DataFrame, key: str, order: str, c: str, tests: int, configs: Sequence[str] = GRID, lots: int = 16) -> DataFrame:
    """key, config, rmse, rank: one-step walk-forward errors over the last `tests` periods, series by lots of configurations in parallel.

    A configuration that a series is too short for has no rmse and comes last.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        y = pdf.sort_values(order)[c].to_numpy(float)
        cuts = np.arange(max(1, len(y) - tests), len(y))
        own = configs[pdf["lot_"].iloc[0] :: lots]
        errors = [_walk(y, x, cuts) - y[cuts] for x in own]
        rmse = [math.sqrt(np.mean(e**2)) if len(e) and np.isfinite(e).all() else math.nan for e in errors]
        return pd.DataFrame({key: pdf[key].iloc[0], "config": list(own), "rmse": rmse})

    dealt = df.select(key, order, c).withColumn("lot_", F.explode(F.sequence(F.lit(0), F.lit(min(lots, len(configs)) - 1))))
    scored = dealt.groupBy(key, "lot_").applyInPandas(run, f"{key} {dict(df.dtypes)[key]}, config string, rmse double")
    known = F.when(~F.isnan("rmse"), F.col("rmse"))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.asc_nulls_last(known), "config")))


def forecast_exog(df: DataFrame, key: str, order: str, c: str, xs: Sequence[str], lags: Sequence[int], horizon: int, recent: int = 12) -> DataFrame:
    """key, step, forecast: autoregression with exogenous columns, which stay at their recent medians."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf.sort_values(order)
        ahead = np.tile(p[list(xs)].tail(recent).median().to_numpy(float), (horizon, 1))
        return pd.DataFrame(
            {
                key: p[key].iloc[0],
                "step": np.arange(1, horizon + 1, dtype=np.int32),
                "forecast": ar_path(p[c].to_numpy(float), lags, horizon, p[list(xs)].to_numpy(float), ahead),
            }
        )

    return df.select(key, order, c, *xs).groupBy(key).applyInPandas(run, f"{key} {dict(df.dtypes)[key]}, step int, forecast double")


# ---- unsupervised


def correlations(df: DataFrame, cols: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Means, standard deviations and correlation matrix of complete rows, and their number. Constant columns correlate with nothing.

    MLlib adds up one Gram matrix by a tree of tasks; what comes to the driver is columns x columns.
    """
    k = len(cols)
    d = df.select(*(F.col(c).cast("double").alias(c) for c in cols)).dropna()
    d = VectorAssembler(inputCols=list(cols), outputCol="features_").transform(d).select("features_")
    n = d.count()
    if n < 2:
        return np.zeros(k), np.zeros(k), np.zeros((k, k)), n
    s = d.agg(Summarizer.metrics("mean", "std").summary(F.col("features_")).alias("s")).first().s
    sd = s["std"].toArray()
    r = Correlation.corr(d, "features_").head()[0].toArray()
    flat = ~(sd > 0)
    r[flat, :] = r[:, flat] = 0.0
    return s["mean"].toArray(), sd, r, n


def pca(df: DataFrame, cols: Sequence[str], k: int | None = None, share: float | None = None) -> DataFrame:
    """component, share, cumulative (shares of variance) and loadings (by column) of the scaled columns.

    The first k components, or the fewest whose shares add up to more than `share`, or all. Rows with a
    null are left out; a constant column has no part. Loadings have a positive sum.
    """
    _, _, r, n = correlations(df, cols)
    value, vector = np.linalg.eigh(r)
    value, vector = np.clip(value[::-1], 0, None), vector[:, ::-1] * np.where(vector[:, ::-1].sum(axis=0) < 0, -1, 1)
    part = value / value.sum() if value.sum() > 0 else value
    total = np.cumsum(part)
    most = k if k is not None else int(np.searchsorted(total, share, side="right")) + 1 if share is not None else len(part)
    rows = [(i + 1, float(part[i]), float(total[i]), vector[:, i].tolist()) for i in range(min(most, len(part)) if n else 0)]
    return df.sparkSession.createDataFrame(rows, "component int, share double, cumulative double, loadings array<double>")


def pca_scores(df: DataFrame, cols: Sequence[str], k: int | None = None, share: float | None = None) -> DataFrame:
    """df with pc1, pc2, ...: the rows' scaled columns along the components; null for rows with a null."""
    mean, sd, _, _ = correlations(df, cols)
    scaled = [(F.col(c).cast("double") - float(m)) / float(s or 1.0) for c, m, s in zip(cols, mean, sd, strict=True)]
    made = pca(df, cols, k, share).select("component", "loadings").collect()  # one row a component
    return df.withColumns({f"pc{r.component}": sum((x * float(w) for x, w in zip(scaled, r.loadings, strict=True)), F.lit(0.0)) for r in made})


def cluster(df: DataFrame, cols: Sequence[str], k: int, bisecting: bool = False, seed: int = 7) -> DataFrame:
    """df with cluster, by the scaled columns. Rows with a null among them are left out.

    Columns are moved to a mean of one: bisecting starts from the mean, moved by a share of its length.
    """
    stats = df.agg(*(f(c).alias(f"{n}_{c}") for c in cols for n, f in (("m", F.avg), ("s", F.stddev_samp)))).first()
    scaled = {f"{c}_scaled": (F.col(c) - (stats[f"m_{c}"] or 0.0)) / (stats[f"s_{c}"] or 1.0) + 1 for c in cols}
    made = (BisectingKMeans if bisecting else KMeans)(k=k, seed=seed, predictionCol="cluster")
    d = _assembler(list(scaled)).transform(df.withColumns(scaled)).drop(*scaled)
    return made.fit(d).transform(d).drop("features")
