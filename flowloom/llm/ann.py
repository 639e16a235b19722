"""Approximate nearest neighbours by inner product, with multiprobe p-stable hashing.

Vectors are scaled by the largest norm and given one more coordinate that makes all norms one, so the
largest inner product is the nearest point. A table hashes a point to the cells that m Gaussian
projections of it fall in; a query visits its own bucket and then perturbed ones, a cell up or down
in some projections, in the order of the summed squared distances to the cells' edges, that is of
estimated success. Candidates of all tables are reranked by the exact inner product.

The number of probes is fitted on a bounded sample (SAMPLE vectors, SAMPLE_QUERIES queries, least
hashes of the id) to a target recall; every row is indexed. Where no number of probes short of the
number of rows and of TEMPLATE reaches the target, and for queries whose probes found fewer rows than
are owed, a query visits every bucket of the first table, which is exact. What is broadcast is the
template, TEMPLATE rows of one byte a step at most, whatever the table's size.

Buckets are dealt to tasks; a task holds its buckets' vectors and streams the queries, each sent
once to a task with the buckets that it probes there, and returns the best for each query. Large
buckets are cut by a salt. Equal vectors are indexed once, with their least k + 1 ids: no result can
hold more of them.

Defined cases: vectors null, zero, of another dimension than most, or with null or non-finite
components take no part, neither do rows with a null id; repeated rows count once; fewer candidates
than k give them all; ties go to the smaller vec_id; an empty table gives an empty result. Extra
columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table

TABLES, WIDTH, SEED = 2, 2.0, 7
#: Bounds of the sample that fits the number of probes.
SAMPLE, SAMPLE_QUERIES = 12_000, 150
#: Probes a table at most (12 MB of template at 23 projections); queries that need more visit every bucket.
TEMPLATE = 2**18
#: Rows of the template that a query's probes are made from at once.
PROBES_AT_ONCE = 2**14
#: Vectors of a task, about; and of a bucket before it is salted.
TASK_ROWS, BUCKET_ROWS = 40_000, 20_000


class Hasher:
    """Tables of p-stable hashes over points of one more dimension than the vectors."""

    def __init__(self, dim: int, top: float, m: int, tables: int = TABLES, width: float = WIDTH, seed: int = SEED) -> None:
        rng = np.random.default_rng(seed)
        self.top, self.m, self.tables, self.width = top, m, tables, width
        self.lines = rng.normal(size=(tables, dim + 1, m))
        self.shift = rng.uniform(0, width, size=(tables, m))
        self.unit = rng.integers(-(2**63), 2**63, m, dtype=np.int64) | 1

    def points(self, x: np.ndarray) -> np.ndarray:
        x = x / self.top
        return np.c_[x, np.sqrt(np.clip(1 - (x * x).sum(1), 0, None))]

    def queries(self, x: np.ndarray) -> np.ndarray:
        return np.c_[x / np.linalg.norm(x, axis=1, keepdims=True), np.zeros(len(x))]

    def places(self, points: np.ndarray, t: int) -> np.ndarray:
        return (points @ self.lines[t] + self.shift[t]) / self.width

    def codes(self, cells: np.ndarray) -> np.ndarray:
        """A number for the cells of a bucket: a step in one projection adds or takes off that projection's unit."""
        return (cells.astype(np.int64) * self.unit).sum(-1)

    def template(self, most: int) -> np.ndarray:
        """Perturbations in estimated success order, as sets of ranks among a query's 2m steps sorted by distance.

        The order follows the expected squared distances of the ranks, so one template serves all
        queries. Ranks i and 2m - 1 - i are the two ways in one projection and never meet.
        """
        m, n = self.m, 2 * self.m
        j = np.arange(1, n + 1)
        low = j * (j + 1) / (4 * (m + 1) * (m + 2))
        back = n + 1 - j
        cost = np.where(j <= m, low, 1 - back / (m + 1) + back * (back + 1) / (4 * (m + 1) * (m + 2)))
        found = [np.zeros(n, np.int8)]
        heap = [(cost[0], (0,))]
        while heap and len(found) < most:
            c, chosen = heapq.heappop(heap)
            if not any(n - 1 - i in chosen for i in chosen):
                found.append(np.bincount(chosen, minlength=n).astype(np.int8))
            last = chosen[-1]
            if last + 1 < n:
                heapq.heappush(heap, (c - cost[last] + cost[last + 1], (*chosen[:-1], last + 1)))  # shift
                heapq.heappush(heap, (c + cost[last + 1], (*chosen, last + 1)))  # expand
        return np.array(found, np.int8)

    def probes(self, place: np.ndarray, template: np.ndarray) -> np.ndarray:
        """Codes of the buckets that a query visits, in estimated success order."""
        cell = np.floor(place)
        below = place - cell
        order = np.argsort(np.r_[below, 1 - below], kind="stable")
        steps = np.r_[-self.unit, self.unit][order]
        made = [template[n : n + PROBES_AT_ONCE].astype(np.int64) @ steps for n in range(0, len(template), PROBES_AT_ONCE)]
        return self.codes(cell) + np.concatenate(made)


def projections(rows: int) -> int:
    """More projections for more rows: buckets keep about a hundred rows at two cells a projection."""
    return max(3, int(np.log2(max(rows, 2) / 100)))


def fit_probes(x: np.ndarray, q: np.ndarray, hasher: Hasher, k: int, target: float, rows: int) -> int | None:
    """The fewest probes a table with which the sample's queries find the target share of their k nearest.

    None: all buckets, where the sample holds no more than k vectors or so many probes are needed
    that visiting each bucket (rows has no more) is less work.
    """
    if len(x) <= k or not len(q):
        return None
    own = [hasher.codes(np.floor(hasher.places(hasher.points(x), t))) for t in range(hasher.tables)]
    near = [np.argpartition(-(x @ row), k)[: k + 1] for row in q]
    points, most = hasher.queries(q), min(256, TEMPLATE)
    while True:
        needed, template = [], hasher.template(most)
        for ids, point in zip(near, points, strict=True):
            best = np.full(len(ids), most)
            for t in range(hasher.tables):
                codes, first = np.unique(hasher.probes(hasher.places(point[None], t)[0], template), return_index=True)
                at = np.minimum(np.searchsorted(codes, own[t][ids]), len(codes) - 1)
                best = np.minimum(best, np.where(codes[at] == own[t][ids], first[at], most))
            needed += best.tolist()
        found = int(np.quantile(needed, target, method="higher")) + 1
        if found <= most:
            return found
        if len(template) < most or most >= min(rows, TEMPLATE):
            return None
        most = min(4 * most, TEMPLATE)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, target: float = 0.95) -> DataFrame:
    """vectors, queries: vec_id, embedding. Returns query_id, rank, vec_id, score."""
    spark = vectors.sparkSession

    def usable(df: DataFrame) -> DataFrame:
        e = F.transform(F.col("embedding").cast("array<double>"), lambda v: v)
        df = df.select(F.col("vec_id").cast("bigint").alias("vec_id"), e.alias("e")).where(
            F.col("vec_id").isNotNull() & F.col("e").isNotNull() & (F.size("e") > 0)
        )
        return df.where(F.forall("e", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("e", lambda v: v != 0))

    def classes(df: DataFrame) -> DataFrame:
        """Each distinct vector with its least k + 1 ids; the rank filter limits groups before the shuffle."""
        w = Window.partitionBy("e").orderBy("vec_id")
        return df.distinct().withColumn("n", F.row_number().over(w)).where(F.col("n") <= k + 1).groupBy("e").agg(
            F.array_sort(F.collect_list("vec_id")).alias("ids")
        )

    good = usable(vectors)
    indexed = stored(classes(good).select(F.col("ids")[0].alias("least"), "ids", "e", F.size("e").alias("dim")), "vectors")
    sizes = indexed.groupBy("dim").agg(
        F.count("*").alias("n"), F.max(F.sqrt(F.aggregate("e", F.lit(0.0), lambda s, v: s + v * v))).alias("top")
    ).orderBy(F.desc("n"), "dim").first()
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    if sizes is None:
        return spark.createDataFrame([], schema)
    dim, rows, top = sizes.dim, sizes.n, sizes.top
    indexed = indexed.where(F.col("dim") == dim)
    asked_rows = stored(usable(queries).where(F.size("e") == dim).distinct(), "queries")
    asked = asked_rows.groupBy("e").agg(F.min("vec_id").alias("q"))

    def drawn(df: DataFrame, by: str, n: int) -> np.ndarray:
        return np.array([r.e for r in df.orderBy(F.xxhash64(by), by).limit(n).select("e").collect()], float).reshape(-1, dim)

    hasher = Hasher(dim, top, projections(rows))
    probes = fit_probes(drawn(indexed, "least", SAMPLE), drawn(asked, "q", SAMPLE_QUERIES), hasher, k, target, rows)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows * TABLES // TASK_ROWS))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column("e").flatten().to_numpy().reshape(batch.num_rows, -1)
            p = hasher.points(x)
            for t in range(hasher.tables):
                code = hasher.codes(np.floor(hasher.places(p, t)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(x), t, np.int32)), pa.array(code), batch.column("least"), batch.column("ids"), batch.column("e")],
                    names=["t", "code", "least", "ids", "e"],
                )

    entries = indexed.select("least", "ids", "e").mapInArrow(hashed, "t int, code bigint, least bigint, ids array<bigint>, e array<double>")
    largest = entries.groupBy("t", "code").count().agg(F.max("count")).first()[0] or 0
    salts = max(1, -(-largest // BUCKET_ROWS))

    def task_of(t: int, code: np.ndarray, salt: np.ndarray | int) -> np.ndarray:
        mixed = (
            np.asarray(code, np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        ) ^ (np.uint64((t * 8191 + 1) * 0xC2B2AE3D27D4EB4F % 2**64)) ^ (np.asarray(salt, np.int64).astype(np.uint64) * np.uint64(0x165667B19E3779F9))
        return ((mixed >> np.uint64(33)) % np.uint64(tasks)).astype(np.int32)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in hashed(batches):
            t, code, least = (batch.column(c).to_numpy() for c in ("t", "code", "least"))
            task = task_of(int(t[0]), code, least % salts)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(task),
                    pa.array(np.zeros(len(t), np.int32)),
                    batch.column("least"),
                    pa.array([[v] for v in code], pa.list_(pa.int64())),
                    batch.column("t"),
                    batch.column("ids"),
                    batch.column("e"),
                ],
                names=NAMES,
            )

    def sent(template: Broadcast | None):
        """Queries with the buckets that they probe in a task; without a template, with none for all tasks of the first table."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = batch.column("e").flatten().to_numpy().reshape(batch.num_rows, -1)
                points, q = hasher.queries(x), batch.column("q").to_numpy()
                for t in range(hasher.tables if template is not None else 1):
                    places = hasher.places(points, t)
                    for n in range(len(x)):
                        if template is None:
                            task, codes, ends = np.arange(tasks, dtype=np.int32), np.zeros(0, np.int64), np.zeros(tasks + 1, np.int32)
                        else:
                            codes = hasher.probes(places[n], template.value)
                            each = np.concatenate([task_of(t, codes, salt) for salt in range(salts)])
                            codes = np.tile(codes, salts)
                            order = np.argsort(each, kind="stable")
                            codes = codes[order]
                            task, starts = np.unique(each[order], return_index=True)
                            ends = np.r_[starts, len(codes)].astype(np.int32)
                        m = len(task)
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(task),
                                pa.array(np.ones(m, np.int32)),
                                pa.array(np.full(m, q[n])),
                                pa.ListArray.from_arrays(pa.array(ends), pa.array(codes)),
                                pa.array(np.full(m, t, np.int32)),
                                pa.array([[]] * m, pa.list_(pa.int64())),
                                batch.column("e").take(pa.array(np.full(m, n))),
                            ],
                            names=NAMES,
                        )

        return run

    row = "task int, kind int, id bigint, codes array<bigint>, t int, ids array<bigint>, e array<double>"

    def dealt(queries: DataFrame, template: Broadcast | None) -> DataFrame:
        held = indexed.select("least", "ids", "e").mapInArrow(placed, row)
        if template is None:
            held = held.where("t = 0")
        both = held.unionByName(queries.select("q", "e").mapInArrow(sent(template), row))
        return both.repartition(tasks, "task").sortWithinPartitions("task", "kind", "t")

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A task's vectors come first, then its queries, some at a time."""
        held: list[tuple] = []
        buckets: dict = {}
        x = least = ids = at = None
        asked: list[tuple] = []

        def index() -> None:
            """The task's vectors by table and bucket: for a table its codes, and where their rows start and end."""
            nonlocal x, least, ids, held
            t, code = np.array([r[3] for r in held], np.int64), np.array([r[4] for r in held], np.int64)
            order = np.lexsort((code, t))
            t, code = t[order], code[order]
            x = np.array([held[n][2] for n in order]).reshape(len(held), dim)
            least, ids = np.array([held[n][0] for n in order], np.int64), [held[n][1] for n in order]
            for table in np.unique(t).tolist():
                lo, hi = np.searchsorted(t, [table, table + 1])
                codes, starts = np.unique(code[lo:hi], return_index=True)
                buckets[table] = codes, np.r_[starts, hi - lo] + lo
            held = []

        def answer() -> Iterator[pa.RecordBatch]:
            """Exact scores of each query with the buckets that it probes, and the best of them."""
            if asked and len(least):
                score = np.full((len(asked), len(least)), -np.inf)
                q = np.array([a[3] for a in asked])
                for table, (codes, edges) in buckets.items():
                    who, what = [], []
                    for n, (_, t, wanted, _) in enumerate(asked):
                        if t == table and len(wanted):
                            place = np.minimum(np.searchsorted(codes, wanted), len(codes) - 1)
                            place = np.unique(place[codes[place] == wanted])
                            who.append(np.full(len(place), n))
                            what.append(place)
                    every = [n for n, a in enumerate(asked) if a[1] == table and not len(a[2])]
                    if every:
                        score[every, edges[0] : edges[-1]] = q[every] @ x[edges[0] : edges[-1]].T
                    if not who:
                        continue
                    who, what = np.concatenate(who), np.concatenate(what)
                    order = np.argsort(what, kind="stable")
                    for part in np.split(order, np.flatnonzero(np.diff(what[order])) + 1):
                        if len(part):
                            s, e = edges[what[part[0]]], edges[what[part[0]] + 1]
                            score[who[part], s:e] = q[who[part]] @ x[s:e].T
                out = []
                for n, row in enumerate(score):
                    cut = np.flatnonzero(row >= np.partition(row, -k - 1)[-k - 1]) if len(row) > k + 1 else np.arange(len(row))
                    cut = cut[np.isfinite(row[cut])]
                    cut = cut[np.lexsort((least[cut], -row[cut]))][: k + 1]
                    out += [(asked[n][0], row[i], ids[i]) for i in cut]
                if out:
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([o[0] for o in out], pa.int64()),
                            pa.array([o[1] for o in out], pa.float64()),
                            pa.array([o[2] for o in out], pa.list_(pa.int64())),
                        ],
                        names=["q", "score", "ids"],
                    )
            asked.clear()

        for batch in batches:
            if not batch.num_rows:
                continue
            task, kind, key, t = (batch.column(c).to_numpy() for c in ("task", "kind", "id", "t"))
            e = batch.column("e").flatten().to_numpy().reshape(batch.num_rows, -1)
            ends, codes = batch.column("codes").offsets.to_numpy(), batch.column("codes").values.to_numpy()
            for n in range(batch.num_rows):
                if task[n] != at:
                    yield from answer()
                    held, x, at = [], None, task[n]
                    buckets.clear()
                if kind[n] == 0:
                    held.append((key[n], batch.column("ids")[n].as_py(), e[n], t[n], codes[ends[n]]))
                    continue
                if x is None:
                    index()
                asked.append((int(key[n]), t[n], codes[ends[n] : ends[n + 1]], e[n]))
                if len(asked) >= 64:
                    yield from answer()
        yield from answer()

    def best(queries: DataFrame, template: Broadcast | None) -> DataFrame:
        """q, score, least, ids: the k + 1 nearest classes that each query found."""
        found = dealt(queries, template).mapInArrow(rank, "q bigint, score double, ids array<bigint>")
        lists = found.groupBy("q", F.col("ids")[0].alias("least")).agg(F.max("score").alias("score"), F.first("ids").alias("ids"))
        return lists.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "least"))).where(F.col("n") <= k + 1).drop("n")

    lists = best(asked, None if probes is None else spark.sparkContext.broadcast(hasher.template(probes)))
    if probes is not None:
        lists = stored(lists, "lists")
        owed = min(k + 1, indexed.agg(F.sum(F.size("ids"))).first()[0])
        got = lists.groupBy("q").agg(F.sum(F.size("ids")).alias("got"))
        short = stored(asked.join(got, "q", "left").where(F.coalesce("got", F.lit(0)) < owed).select("q", "e"), "short")
        if not short.isEmpty():  # these visit every bucket
            lists = lists.join(short, "q", "left_anti").unionByName(best(short, None))
    ranked = lists.select("q", "score", F.explode("ids").alias("vec_id")).withColumn(
        "n", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))
    ).where(F.col("n") <= k + 1)
    asked_by = asked_rows.join(asked, "e").select(F.col("vec_id").alias("query_id"), "q")
    each = asked_by.join(ranked.select("q", "score", "vec_id"), "q").where(F.col("vec_id") != F.col("query_id"))
    final = each.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)
    return final.select("query_id", "rank", "vec_id", "score")


NAMES = ["task", "kind", "id", "codes", "t", "ids", "e"]


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(vectors, vectors.where(F.col("vec_id") % 20 == 0), k=20)
