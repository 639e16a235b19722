"""Imputation, outliers, coarsening, synthesis and privacy reports."""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scans import grouped_quantiles, kept


def impute(df: DataFrame, strategy: Mapping[str, str], approx: bool = False) -> DataFrame:
    """Fill nulls by column: median, mean, mode (ties: the least), or a constant."""
    made = {}
    for c, s in strategy.items():
        made[c] = {"median": (F.percentile_approx if approx else F.percentile)(c, 0.5), "mean": F.avg(c), "mode": F.mode(c, True)}.get(s, F.lit(s))
    row = F.broadcast(df.agg(*(v.alias(f"{c}_fill") for c, v in made.items())))
    types = dict(df.dtypes)
    target = {c: "double" if strategy[c] in ("median", "mean") else types[c] for c in strategy}
    return df.crossJoin(row).withColumns(
        {c: F.coalesce(F.col(c).cast(target[c]), F.col(f"{c}_fill").cast(target[c])) for c in strategy}
    ).drop(*(f"{c}_fill" for c in strategy))


def impute_group_mean(df: DataFrame, c: str, group: Column) -> DataFrame:
    """Nulls get their group's mean, then the mean of the column as it is filled so far."""
    first = df.withColumn("g_", group)
    means = first.groupBy("g_").agg(F.avg(c).alias("mean_"), F.count("*").alias("n_"), F.sum(c).alias("sum_"), F.count(c).alias("k_"))
    # the mean of the filled column, from the groups' own numbers
    over = means.agg((F.sum(F.col("sum_") + (F.col("n_") - F.col("k_")) * F.col("mean_")) / F.sum(F.when(F.col("k_") > 0, F.col("n_")))).alias("all_"))
    filled = first.join(means.select(F.col("g_").alias("h_"), "mean_"), F.col("g_").eqNullSafe(F.col("h_")), "left").crossJoin(F.broadcast(over))
    return filled.withColumn(c, F.coalesce(F.col(c).cast("double"), "mean_", "all_")).drop("g_", "h_", "mean_", "all_")


def _bounds(df: DataFrame, c: str, k: float) -> DataFrame:
    q = grouped_quantiles(df, [], c, {"q1": 0.25, "q3": 0.75})
    a, b = F.col("q1"), F.col("q3")
    return F.broadcast(q.select((a - k * (b - a)).alias("low"), (b + k * (b - a)).alias("high")))


def iqr_outliers(df: DataFrame, c: str, k: float = 1.5) -> DataFrame:
    """Rows beyond the quartiles by k interquartile ranges, with the bounds."""
    return df.crossJoin(_bounds(df, c, k)).where((F.col(c) < F.col("low")) | (F.col(c) > F.col("high")))


def iqr_clip(df: DataFrame, cols: Sequence[str], k: float = 1.5) -> DataFrame:
    for c in cols:
        df = df.crossJoin(_bounds(df, c, k)).withColumn(c, F.when(F.col(c).isNotNull(), F.least(F.greatest(F.col(c), "low"), "high"))).drop("low", "high")
    return df


def top_code(df: DataFrame, cols: Sequence[str], q: float) -> DataFrame:
    """Values above a quantile become that quantile."""
    row = F.broadcast(df.agg(*(F.percentile(c, q).alias(f"{c}_top") for c in cols)))
    return df.crossJoin(row).withColumns(
        {c: F.when(F.col(c).isNotNull(), F.least(F.col(c).cast("double"), f"{c}_top")) for c in cols}
    ).drop(*(f"{c}_top" for c in cols))


def bin_numeric(df: DataFrame, edges: Mapping[str, Sequence[float]]) -> DataFrame:
    """Numbers as labels of intervals, open on the left."""
    from ..functions.scalars import band

    return df.withColumns({c: band(F.col(c), e, [f"({a}, {b}]" for a, b in zip(e, e[1:], strict=False)], right=True) for c, e in edges.items()})


def collapse_rare(df: DataFrame, c: str, least: int) -> DataFrame:
    """Values in fewer than `least` rows become Other."""
    n = df.groupBy(F.col(c).alias("v_")).agg(F.count("*").alias("n_"))
    return df.join(n, F.col(c).eqNullSafe(F.col("v_")), "left").withColumn(
        c, F.when(F.col("n_") < least, "Other").otherwise(F.col(c).cast("string"))
    ).drop("v_", "n_")


def rare_marks(df: DataFrame, cols: Sequence[str], k: int) -> DataFrame:
    """df with rare: its combination of the columns is in fewer than k rows (nulls are equal)."""
    n = df.groupBy(*(F.col(c).alias(f"{c}_k") for c in cols)).agg(F.count("*").alias("n_"))
    same = F.lit(True)
    for c in cols:
        same = same & F.col(c).eqNullSafe(F.col(f"{c}_k"))
    return df.join(n, same, "left").withColumn("rare", F.col("n_") < k).drop("n_", *(f"{c}_k" for c in cols))


def k_anonymise(df: DataFrame, cols: Sequence[str], k: int) -> DataFrame:
    """Combinations in fewer than k rows get Other in the last of the columns."""
    return rare_marks(df, cols, k).withColumn(cols[-1], F.when(F.col("rare"), "Other").otherwise(F.col(cols[-1]).cast("string"))).drop("rare")


def coarsen(
    df: DataFrame,
    drop: Sequence[str] = (),
    top: Mapping[str, float] | None = None,
    bins: Mapping[str, Sequence[float]] | None = None,
    rare: Mapping[str, int] | None = None,
    quasi: Sequence[str] = (),
    k: int = 5,
) -> DataFrame:
    """Identifiers dropped, then top-coding, binning, rare values, k-anonymity."""
    df = df.drop(*drop)
    for c, q in (top or {}).items():
        df = top_code(df, [c], q)
    df = bin_numeric(df, bins) if bins else df
    for c, n in (rare or {}).items():
        df = collapse_rare(df, c, n)
    return k_anonymise(df, quasi, k) if quasi else df


def synthesise(df: DataFrame, numbers: Sequence[str], category: str, n: int, seed: int, smooth: float = 1.0) -> DataFrame:
    """n synthetic rows: numbers keep their marginals and rank correlations, categories are drawn from smoothed shares.

    Normal scores of ranks, their covariance by one aggregate, correlated normal draws, and back through
    each column's empirical quantiles (1,001 knots).
    """
    spark = df.sparkSession
    d = df.dropna(subset=list(numbers))
    knots = d.agg(*(F.percentile_approx(c, [k / 1000 for k in range(1001)], 100_000).alias(c) for c in numbers)).first()
    scored = d.select(*(((_below(knots[c])(F.col(c).cast("double")) + 0.5) / 1002.0).alias(c) for c in numbers))
    row = scored.agg(
        *(F.corr(a, b).alias(f"r{i}_{j}") for i, a in enumerate(numbers) for j, b in enumerate(numbers) if i < j)
    ).first() if len(numbers) > 1 else None
    r = np.eye(len(numbers))
    for i in range(len(numbers)):
        for j in range(i + 1, len(numbers)):
            r[i, j] = r[j, i] = 2 * np.sin(np.pi * (row[f"r{i}_{j}"] or 0.0) / 6)
    w, v = np.linalg.eigh(r)
    root = v * np.sqrt(np.clip(w, 1e-9, None))
    draws = spark.range(n).select("id", *(F.randn(seed + k).alias(f"z{k}") for k in range(len(numbers))), F.rand(seed - 1).alias("u_"))
    x = {c: _total(F.col(f"z{k}") * float(root[i, k]) for k in range(len(numbers))) for i, c in enumerate(numbers)}
    p = {c: 1 / (1 + F.exp(-(1.5976 * e + 0.07056 * F.pow(e, 3)))) for c, e in x.items()}  # the normal distribution function, to four places
    out = draws.select(
        "id",
        "u_",
        *((F.element_at(F.lit(sorted(map(float, knots[c]))), F.least(F.floor(q * 1001) + 1, F.lit(1001)).cast("int"))).alias(c) for c, q in p.items()),
    )
    shares = df.groupBy(category).agg((F.count("*") + smooth).alias("k")).where(F.col(category).isNotNull())
    edges = shares.select(category, (F.sum("k").over(Window.orderBy(category)) / F.sum("k").over(Window.partitionBy())).alias("to_"), (F.col("k") / F.sum("k").over(Window.partitionBy())).alias("p_"))  # one row a category
    return out.join(F.broadcast(edges), (F.col("u_") < F.col("to_")) & (F.col("u_") >= F.col("to_") - F.col("p_"))).select("id", *numbers, category)


def _below(knots: Sequence[float]):
    """How many of the knots are less than a number, by bisection."""
    at = np.sort(np.array(knots, float))

    @F.pandas_udf("long")
    def below(x: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(at, x.to_numpy(float)))

    return below


def _total(terms) -> Column:
    out = F.lit(0.0)
    for t in terms:
        out = out + t
    return out


def stratified_synthesis(df: DataFrame, numbers: Sequence[str], strata: Sequence[str], seed: int, least: int = 50, knots: int = 200, lot: int = 100_000) -> DataFrame:
    """As many synthetic rows as df has. A stratum of `least` rows or more is drawn from its own quantiles and correlations; the rows of smaller ones are drawn from all of df.

    Strata are few: their parameters (knots and a k x k matrix each) are written to the shared folder, dealt
    in lots of `lot` rows to draw, and looked up where a row is drawn. The rows of the back-off have their
    strata drawn by the global shares.
    """
    spark = df.sparkSession
    d = df.dropna(subset=[*numbers, *strata])
    k, points = len(numbers), [i / knots for i in range(knots + 1)]
    pairs = [(i, j) for i in range(k) for j in range(i + 1, k)]
    stats = [
        F.count("*").alias("n_"),
        *(F.percentile_approx(c, points, 10_000).cast("array<double>").alias(f"q_{i}") for i, c in enumerate(numbers)),
        *(F.corr(numbers[i], numbers[j]).alias(f"r_{i}_{j}") for i, j in pairs),
    ]
    own = kept(d.groupBy(*strata).agg(*stats), "strata")
    rest = own.where(F.col("n_") < least).agg(F.sum("n_")).first()[0]
    params = own.where(F.col("n_") >= least).withColumn("own_", F.lit(True))
    if rest:
        whole = d.agg(*stats).withColumns({"n_": F.lit(rest).cast("bigint"), "own_": F.lit(False), **{c: F.lit(None).cast(dict(df.dtypes)[c]) for c in strata}})
        params = params.unionByName(whole)

    @F.pandas_udf("array<double>")
    def root(r: pd.Series) -> pd.Series:
        """Rows of a factor of the correlation matrix of normal scores, one after the other."""
        out = []
        for row in r:
            m = np.eye(k)
            for (i, j), x in zip(pairs, row, strict=False):
                m[i, j] = m[j, i] = 0.0 if x is None or x != x else x
            w, v = np.linalg.eigh(m)
            out.append((v * np.sqrt(np.clip(w, 1e-9, None))).ravel().tolist())
        return pd.Series(out)

    params = params.withColumn("root_", root(F.array(*(F.col(f"r_{i}_{j}") for i, j in pairs), F.lit(1.0)))).drop(*(f"r_{i}_{j}" for i, j in pairs))
    # a lot is one row until its rows are drawn, in the task that draws them
    lots = params.withColumn("lot_", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(n_ - 1) DIV {lot}"))))
    lots = kept(lots.withColumn("n_", F.least(F.lit(lot).cast("bigint"), F.col("n_") - F.col("lot_") * lot)), "lots")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = lots.repartition(parts, *strata, "lot_").select(*strata, "own_", "root_", *(f"q_{i}" for i in range(k)), F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n_"))).alias("row_"))
    z = rows.withColumns({f"z_{i}": F.randn(seed + i) for i in range(k)})
    x = {i: _total(F.col(f"z_{j}") * F.get("root_", F.lit(i * k + j)) for j in range(k)) for i in range(k)}
    p = {i: 1 / (1 + F.exp(-(1.5976 * e + 0.07056 * F.pow(e, 3)))) for i, e in x.items()}
    drawn = z.select(
        *strata,
        "own_",
        F.rand(seed - 1).alias("u_"),
        *(F.get(f"q_{i}", F.least(F.floor(q * (knots + 1)), F.lit(knots)).cast("int")).alias(c) for (i, q), c in zip(p.items(), numbers, strict=True)),
    )
    made = drawn.where("own_").select(*numbers, *strata)
    if not rest:
        return made
    shares = own.select(*strata, "n_")
    w = Window.orderBy(*strata)  # one row a stratum
    edges = shares.select(
        *(F.col(c).alias(f"{c}_g") for c in strata),
        (F.sum("n_").over(w) / F.sum("n_").over(Window.partitionBy())).alias("to_"),
        (F.col("n_") / F.sum("n_").over(Window.partitionBy())).alias("p_"),
    )
    spread = drawn.where("NOT own_").select(*numbers, "u_").join(
        F.broadcast(edges), (F.col("u_") < F.col("to_")) & (F.col("u_") >= F.col("to_") - F.col("p_"))
    ).select(*numbers, *(F.col(f"{c}_g").alias(c) for c in strata))
    return made.unionByName(spread)


#: Points that a k-d partition is drawn from, at most; it steers the work only. Leaves at most, points of a leaf that make another worth while, and queries that search a leaf at once.
DRAWN, LEAVES, LEAF, CHUNK = 100_000, 4096, 2000, 20_000
#: Distances from points to boxes that a task holds at once.
DISTANCES = 1_000_000


class KdParts:
    """A complete k-d tree over a sample: nodes in heap order, each cut at the median of its widest column."""

    def __init__(self, sample: np.ndarray, depth: int) -> None:
        self.depth = depth
        self.dims, self.cuts = np.zeros(2**depth - 1, np.int64), np.zeros(2**depth - 1)
        at = [sample]
        for node in range(2**depth - 1):
            x = at[node]
            if len(x):
                d = int(np.argmax(x.max(0) - x.min(0)))
                self.dims[node], self.cuts[node] = d, np.median(x[:, d])
            right = x[:, self.dims[node]] > self.cuts[node]
            at += [x[~right], x[right]]

    def leaf(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (x[np.arange(len(x)), self.dims[node]] > self.cuts[node])
        return node - (2**self.depth - 1)


def _matrix(batch: pa.RecordBatch, k: int) -> np.ndarray:
    return np.column_stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(k)])


def _with_leaf(batch: pa.RecordBatch, rows: np.ndarray, leaf: np.ndarray) -> pa.RecordBatch:
    kept_ = batch.take(pa.array(rows))
    return pa.RecordBatch.from_arrays([*kept_.columns, pa.array(leaf, pa.int32())], names=[*batch.schema.names, "leaf_"])


def _sliced(batches: Iterator[pa.RecordBatch], boxes: int) -> Iterator[pa.RecordBatch]:
    """Points by so few that a task holds DISTANCES to boxes at once, however many boxes there are."""
    step = max(1, DISTANCES // boxes)
    return (b.slice(s, step) for b in batches for s in range(0, b.num_rows, step))


def _searched(asked: DataFrame, points: DataFrame, cols: Sequence[str], chunk: int) -> DataFrame:
    """asked (cols, n_, leaf_) with gap: the distance to the nearest point of that leaf. A leaf that many ask is searched in chunks of queries."""
    k = len(cols)
    sizes = {r.leaf_: -(-r["count"] // chunk) for r in asked.groupBy("leaf_").count().collect()}  # one row a leaf
    if not sizes:
        return asked.withColumn("gap", F.lit(0.0)).drop("leaf_")
    chunks = F.get(F.array(*(F.lit(sizes.get(i, 0)) for i in range(max(sizes) + 1))), F.col("leaf_"))
    queries = asked.withColumn("chunk_", F.pmod(F.xxhash64(*cols), chunks))
    there = points.withColumn("of_", F.coalesce(chunks, F.lit(0))).where("of_ > 0")
    there = there.withColumn("chunk_", F.explode(F.sequence(F.lit(0).cast("long"), (F.col("of_") - 1).cast("long")))).drop("of_")

    def nearest(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        x, y = left[list(cols)].to_numpy(float), right[list(cols)].to_numpy(float)
        best = np.full(len(x), np.inf)
        step = max(1, 2_000_000 // max(1, len(x) * k))
        for s in range(0, len(y), step):
            best = np.minimum(best, ((x[:, None, :] - y[None, s : s + step]) ** 2).sum(2).min(1))
        return left[[*cols, "n_"]].assign(gap=np.sqrt(best))

    schema = ", ".join([*(f"`{c}` double" for c in cols), "n_ bigint, gap double"])
    return queries.groupBy("leaf_", "chunk_").cogroup(there.groupBy("leaf_", "chunk_")).applyInPandas(nearest, schema)


def neighbour_gaps(real: DataFrame, made: DataFrame, cols: Sequence[str], leaf: int = LEAF, chunk: int = CHUNK) -> DataFrame:
    """cols, n_, gap: for each distinct real point (n_ rows) the distance to the nearest made point; null without made points.

    Exact, in two rounds at any size. Made points are dealt to the leaves of a k-d tree, whose bounding
    boxes are what every task knows (LEAVES at most). A real point searches the leaf of the nearest box
    first; then all others whose boxes are nearer than what it found.
    """
    cols, k = list(cols), len(cols)
    point = lambda df: df.select(*(F.col(c).cast("double").alias(c) for c in cols)).dropna()
    left = kept(point(real).groupBy(*cols).agg(F.count("*").alias("n_")), "real")
    right = kept(point(made).distinct(), "made")
    n = right.count()
    if not n:
        return left.withColumn("gap", F.lit(None).cast("double"))
    depth = min(LEAVES.bit_length() - 1, max(0, math.ceil(math.log2(n / leaf))))
    sample = right.orderBy(F.xxhash64(*cols)).limit(DRAWN if depth else 0).toPandas().to_numpy(float).reshape(-1, k)
    tree = KdParts(sample, depth)
    names = ", ".join(f"`{c}` double" for c in cols)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield _with_leaf(b, np.arange(b.num_rows), tree.leaf(_matrix(b, k)))

    points = kept(right.mapInArrow(placed, f"{names}, leaf_ int"), "leaves")
    boxes = points.groupBy("leaf_").agg(*(f(c).alias(f"{t}{i}") for i, c in enumerate(cols) for t, f in (("lo", F.min), ("hi", F.max)))).orderBy("leaf_").collect()
    leaves = np.array([r.leaf_ for r in boxes])
    low, high = (np.array([[r[f"{t}{i}"] for i in range(k)] for r in boxes]) for t in ("lo", "hi"))

    def apart(x: np.ndarray) -> np.ndarray:
        """Distance of each point to each box."""
        total = np.zeros((len(x), len(leaves)))
        for i in range(k):
            total += np.maximum(0, np.maximum(low[:, i] - x[:, i : i + 1], x[:, i : i + 1] - high[:, i])) ** 2
        return np.sqrt(total)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _sliced(batches, len(leaves)):
            yield _with_leaf(b, np.arange(b.num_rows), leaves[apart(_matrix(b, k)).argmin(1)])

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _sliced(batches, len(leaves)):
            far = apart(_matrix(b, k))
            near = far < b.column("gap").to_numpy()[:, None] * (1 + 1e-12)
            near[np.arange(len(far)), far.argmin(1)] = False
            row, at = np.nonzero(near)
            yield _with_leaf(b.drop_columns(["gap"]), row, leaves[at])

    asked = left.select(*cols, "n_")
    one = kept(_searched(asked.mapInArrow(first, f"{names}, n_ bigint, leaf_ int"), points, cols, chunk), "gaps")
    more = kept(one.mapInArrow(others, f"{names}, n_ bigint, leaf_ int"), "asked")
    both = one.unionByName(_searched(more, points, cols, chunk))
    return both.groupBy(*cols, "n_").agg(F.min("gap").alias("gap"))


#: Newton steps at most, and the gain in log-likelihood (of all rows) that is too small for another.
STEPS, GAIN = 100, 1e-6


def _logistic_fits(rows: DataFrame, key: str, keys: Sequence, label: str, weight: str, cols: Sequence[str]) -> dict:
    """Coefficients (the constant first) of each key's weighted logistic model. A Newton step is one aggregate for all keys."""
    k, start = len(cols) + 1, np.zeros(len(cols) + 1)
    beta, step, best, open_ = dict.fromkeys(keys, start), dict.fromkeys(keys, start), dict.fromkeys(keys, math.inf), set(keys)
    x, pairs = [F.lit(1.0), *map(F.col, cols)], [(i, j) for i in range(k) for j in range(i, k)]
    for _ in range(STEPS):
        if not open_:
            break
        z = F.lit(None).cast("double")
        for s in open_:
            z = F.when(F.col(key) == s, _total(float(c) * v for c, v in zip(beta[s] + step[s], x, strict=True))).otherwise(z)
        at = rows.where(F.col(key).isin(*open_)).withColumn("z_", z).withColumn("e_", F.exp(-F.abs("z_")))
        p = F.when(F.col("z_") >= 0, 1.0).otherwise(F.col("e_")) / (1 + F.col("e_"))
        at = at.withColumn("p_", p).withColumn("h_", F.col(weight) * F.col("p_") * (1 - F.col("p_"))).withColumn("g_", F.col(weight) * (F.col(label) - F.col("p_")))
        loss = F.col(weight) * (F.log1p("e_") + F.greatest(F.lit(0.0), (1 - 2 * F.col(label)) * F.col("z_")))
        sums = [F.sum(loss), *(F.sum(F.col("g_") * v) for v in x), *(F.sum(F.col("h_") * x[i] * x[j]) for i, j in pairs)]
        for r in at.groupBy(key).agg(*(c.alias(f"s{i}") for i, c in enumerate(sums))).collect():  # one row a key
            s, (lost, *rest) = r[key], np.array(r[1:], float)
            if not lost <= best[s] * (1 + 1e-9):  # too far
                step[s] = step[s] / 2
                continue
            beta[s], best[s] = beta[s] + step[s], lost
            h = np.zeros((k, k))
            for (i, j), v in zip(pairs, rest[k:], strict=True):
                h[i, j] = h[j, i] = v
            g = np.array(rest[:k])
            step[s] = np.linalg.lstsq(h, g, rcond=None)[0]
            if g @ step[s] < GAIN:
                beta[s] = beta[s] + step[s]
                open_.discard(s)
    return beta


#: Scored rows that a task holds at once, and of a range part, about.
RANKED = 1_000_000


def _by_score(rows: np.ndarray) -> np.ndarray:
    """Distinct scores in order (the first column), with the sums of the other columns."""
    rows = rows[np.argsort(rows[:, 0])]
    new = np.flatnonzero(np.r_[True, rows[1:, 0] != rows[:-1, 0]])
    return np.column_stack([rows[new, 0], np.add.reduceat(rows[:, 1:], new)])


def _aucs(df: DataFrame, sizes: Mapping, ranked: int = RANKED) -> dict:
    """AUC by side of rows of a side (few, with about `sizes` rows each), a score and a 0/1 label; ties count half; null if all labels are one.

    Equal scores are counted where they lie. Ranges of scores, cut at a bounded sample that steers the work
    only, are dealt to tasks in packets, and each range has one row of its counts and its pairs in the right order.
    """
    sample = df.sample(min(1.0, DRAWN / max(1, sum(sizes.values()))), 1).select("side_", "score_").toPandas()
    cuts = {}
    for s, n in sizes.items():
        drawn, parts = np.sort(sample.score_[sample.side_ == s].to_numpy(float)), -(-n // ranked)
        cuts[s] = np.unique(drawn[[len(drawn) * k // parts for k in range(1, parts)]]) if len(drawn) else drawn

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def packets() -> Iterator[pa.RecordBatch]:
            rows = np.concatenate(held)
            for s, at in cuts.items():
                own = rows[rows[:, 0] == s, 1:]
                if len(own):
                    own = _by_score(own)
                    pieces = np.split(own, np.searchsorted(own[:, 0], at, "right"))
                    some = [(i, x.tobytes()) for i, x in enumerate(pieces) if len(x)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([s] * len(some), pa.int32()), pa.array([i for i, _ in some], pa.int32()), pa.array([x for _, x in some], pa.binary())],
                        names=["side_", "part_", "data"],
                    )

        for b in batches:
            side, score, label = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            held.append(np.column_stack([side, score, label, 1 - label]))
            size += b.num_rows
            if size >= ranked:
                yield from packets()
                held, size = [], 0
        if size:
            yield from packets()

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for b in batches:
            for s, i, data in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                held.setdefault((s, i), []).append(np.frombuffer(data).reshape(-1, 3))
        for (s, i), got in held.items():
            _, pos, neg = _by_score(np.concatenate(got)).T
            row = [pa.array([s], pa.int32()), pa.array([i], pa.int32()), *(pa.array([float(v)]) for v in (pos.sum(), neg.sum(), (pos * (np.cumsum(neg) - neg / 2)).sum()))]
            yield pa.RecordBatch.from_arrays(row, names=["side_", "part_", "pos", "neg", "pairs"])

    tasks = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), sum(len(c) + 1 for c in cuts.values()))
    dealt = df.select("side_", "score_", "label_").mapInArrow(packed, "side_ int, part_ int, data binary").repartition(tasks, "side_", "part_")
    total: dict = dict.fromkeys(sizes, (0.0, 0.0, 0.0))
    for r in sorted(dealt.mapInArrow(summed, "side_ int, part_ int, pos double, neg double, pairs double").collect(), key=lambda r: r.part_):  # one row a range
        pos, neg, pairs = total[r.side_]
        total[r.side_] = pos + r.pos, neg + r.neg, pairs + r.pairs + r.pos * neg
    return {s: pairs / (pos * neg) if pos * neg else None for s, (pos, neg, pairs) in total.items()}


def transfer_auc(real: DataFrame, made: DataFrame, numbers: Sequence[str], target: str) -> DataFrame:
    """measure, value: AUC of a balanced logistic model of the 0/1 target, trained on made rows and tested on real ones (tstr_auc), and the other way round (trts_auc).

    Exact, ties count half; a missing number (null, NaN) counts as 0; null where the tested rows are of one class. Rows to train on that are of one
    class tell nothing: all scores are equal. Both sides' rows are written once; a pass serves both.
    """
    x = [f"x{i}_" for i in range(len(numbers))]

    def ready(df: DataFrame, side: int) -> DataFrame:
        return df.where(F.col(target).isNotNull()).select(
            F.lit(side).alias("side_"),
            F.col(target).cast("double").alias("label_"),
            *(F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)).alias(n) for c, n in zip(numbers, x, strict=True)),
        )

    rows = kept(ready(real, 0).unionByName(ready(made, 1)), "sides")
    stats = [F.count("*").alias("n"), F.avg("label_").alias("rate"), *(f(c).alias(f"{n}{c}") for c in x for n, f in (("m", F.avg), ("s", F.stddev_pop), ("lo", F.min), ("hi", F.max)))]
    found = {r.side_: r for r in rows.groupBy("side_").agg(*stats).collect()}  # two rows
    fit = [s for s, r in found.items() if 0 < r.rate < 1]

    def by_model(side: Column, value) -> Column:
        """value(row of statistics) of the model's side."""
        out = F.lit(0.0)
        for s in fit:
            out = F.when(side == s, value(found[s])).otherwise(out)
        return out

    def standard(side: Column) -> dict[str, Column]:
        return {c: (F.col(c) - by_model(side, lambda r, c=c: r[f"m{c}"])) * by_model(side, lambda r, c=c: 1 / r[f"s{c}"] if r[f"hi{c}"] > r[f"lo{c}"] else 0.0) for c in x}

    side = F.col("side_")
    weight = F.when(F.col("label_") == 1, by_model(side, lambda r: 0.5 / r.rate)).otherwise(by_model(side, lambda r: 0.5 / (1 - r.rate)))
    beta = _logistic_fits(rows.withColumns(standard(side)).withColumn("weight_", weight), "side_", fit, "label_", "weight_", x)
    score = F.lit(0.0)
    for s in fit:
        score = F.when(side == 1 - s, _total(float(b) * F.col(c) for b, c in zip(beta[s][1:], x, strict=True))).otherwise(score)
    tested = rows.withColumns(standard(1 - side)).select("side_", score.alias("score_"), "label_")
    value = _aucs(tested, {s: r.n for s, r in found.items()})
    return real.sparkSession.createDataFrame([("tstr_auc", value.get(0)), ("trts_auc", value.get(1))], "measure string, value double")


def privacy_report(real: DataFrame, made: DataFrame, numbers: Sequence[str], quasi: Sequence[str]) -> DataFrame:
    """measure, value: differences of means and variances, of correlations, the exact match rate on quasi identifiers, mean and least gap of real rows to their nearest made one."""
    from .windows import match_rate

    rows = []
    for c in numbers:
        a, b = (d.agg(F.avg(c).alias("m"), F.var_samp(c).alias("v")) for d in (real, made))
        both = a.crossJoin(b.select(F.col("m").alias("m2"), F.col("v").alias("v2")))
        rows += [
            both.select(F.lit(f"mean_diff_{c}").alias("measure"), F.abs(F.col("m") - F.col("m2")).alias("value")),
            both.select(F.lit(f"var_diff_{c}").alias("measure"), F.abs(F.col("v") - F.col("v2")).alias("value")),
        ]
    pairs = [(a, b) for i, a in enumerate(numbers) for b in numbers[i + 1 :]]
    if pairs:
        r, s = (d.agg(*(F.corr(a, b).alias(f"{p}{k}") for k, (a, b) in enumerate(pairs))) for d, p in ((real, "r"), (made, "s")))
        rows.append(
            r.crossJoin(s).select(
                F.lit("corr_l1").alias("measure"), sum((F.abs(F.col(f"r{k}") - F.col(f"s{k}")) for k in range(len(pairs))), F.lit(0.0)).alias("value")
            )
        )
    gaps = neighbour_gaps(real, made, numbers).agg((F.sum(F.col("gap") * F.col("n_")) / F.sum("n_")).alias("nn_gap_mean"), F.min("gap").alias("nn_gap_min"))
    rows += [gaps.select(F.lit(n).alias("measure"), F.col(n).alias("value")) for n in ("nn_gap_mean", "nn_gap_min")]
    rows.append(match_rate(real, made, quasi).select(F.lit("match_rate").alias("measure"), F.col("match_rate").alias("value")))
    out = rows[0]
    for x in rows[1:]:
        out = out.unionByName(x)
    return out
