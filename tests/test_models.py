"""Models take the whole of their input."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowloom.operators import models, topics
from flowloom.plans import models as plans

SF = "/root/testdata/sf0.001"


def test_topics_know_rare_words(spark):
    common = [f"common{i}" for i in range(2100)]  # more frequent than the rest
    rows = [(" ".join([*common, *(f"rare{i}" for i in range(8) if n % 3)]),) for n in range(12)]
    got = topics.topics(spark.createDataFrame(rows, "text string"), "text", 2, terms=3000).collect()
    assert {r.term for r in got} == {*(f"rare{i}" for i in range(8)), *(f"common{i}" for i in range(2100))}


def brute_topics(texts, k, rounds, seed_weights):
    """Batch variational Bayes over a dense table of documents and terms, each document on its own."""
    held = [t.lower().split() for t in texts if t]
    vocab = sorted({w for d in held for w in d if sum(w in e for e in held) > 1})
    n = np.array([[d.count(w) for w in vocab] for d in held], float)
    x = n * np.log((len(held) + 1) / ((n > 0).sum(0) + 1))
    lam = np.array([[seed_weights[w, t] for w in vocab] for t in range(k)])
    psi = lambda a: np.vectorize(lambda v: (math.lgamma(v + 1e-5) - math.lgamma(v - 1e-5)) / 2e-5)(a)
    for _ in range(rounds):
        beta = np.exp(psi(lam) - psi(lam.sum(1, keepdims=True)))
        add = np.zeros_like(lam)
        for row in x:
            gamma = np.ones(k)
            if not row.any():
                continue
            for _ in range(topics.ROUNDS):
                theta = np.exp(psi(gamma) - psi(gamma.sum()))
                new = 1 / k + theta * (beta @ (row / (theta @ beta)))
                change, gamma = np.abs(new - gamma).mean(), new
                if change < topics.STILL:
                    break
            theta = np.exp(psi(gamma) - psi(gamma.sum()))
            add += theta[:, None] * beta * row / (theta @ beta)
        lam = 1 / k + add
    return {(t, w): lam[t, i] / lam[t].sum() for t in range(k) for i, w in enumerate(vocab)}


@pytest.mark.parametrize("large", [False, True])
def test_topics_equal_a_dense_fit(spark, monkeypatch, large):
    """Planted subjects, an empty and a null text; beyond the broadcast bound, with hot terms in several tasks, the result is the same."""
    if large:
        monkeypatch.setattr(topics, "BROADCAST_BYTES", 0)
        monkeypatch.setattr(topics, "TERM_ROWS", 3)
    rng = np.random.default_rng(3)
    subject = [[f"sea{i}" for i in range(6)], [f"hill{i}" for i in range(6)]]
    texts = [" ".join([*rng.choice(subject[n % 2], 12), "Shared", f"only{n}"]) for n in range(20)] + ["", None]
    df = spark.createDataFrame([(t, 1) for t in texts], "text string, w0 int")
    got = {(r.topic, r.term): r.weight for r in topics.topics(df, "text", 2, terms=99, rounds=6).collect()}
    vocab = {w for _, w in got}
    drawn = spark.createDataFrame([(w,) for w in vocab], "term string").select(
        "term", *(F.pmod(F.xxhash64("term", F.lit(t), F.lit(7)), F.lit(1 << 20)) / (1 << 20) + 0.5 for t in range(2))
    ).collect()
    want = brute_topics(texts, 2, 6, {(r[0], t): r[t + 1] for r in drawn for t in range(2)})
    assert got.keys() == want.keys() and "only3" not in vocab
    assert all(got[key] == pytest.approx(want[key], rel=1e-5) for key in want)
    heavy = [sorted((w for w in vocab if w != "shared"), key=lambda w: -got[t, w])[:6] for t in range(2)]
    assert sorted(map(sorted, heavy)) == sorted(map(sorted, subject))


def test_topics_do_not_depend_on_blocks(spark, monkeypatch):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(" ".join(rng.choice([f"w{i}" for i in range(40)], 15)),) for _ in range(60)], "text string")
    got = []
    for size in (topics.BLOCK_WORDS, 50):
        monkeypatch.setattr(topics, "BLOCK_WORDS", size)
        got.append({(r.topic, r.term): r.weight for r in topics.topics(df, "text", 3, terms=99, rounds=4).collect()})
    assert got[0].keys() == got[1].keys() and all(got[1][key] == pytest.approx(v, rel=1e-9) for key, v in got[0].items())


def test_topics_leave_no_shuffle_files(spark):
    """What a round shuffles is deleted once its table is written, and the folders of texts and blocks at the end."""
    at = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def held():
        files = at.getAllFiles()
        return sum(files.apply(i).length() for i in range(files.size()))

    rng = np.random.default_rng(17)
    df = spark.createDataFrame([(" ".join(f"w{x}" for x in rng.integers(0, 3000, 200)),) for _ in range(400)], "text string")
    before = held()
    topics.topics(df, "text", 4, rounds=4)
    assert held() - before < 100_000


def test_topics_of_parts_and_slices(spark, monkeypatch):
    """Documents in many parts, several a block, worked on a few at once: the same result."""
    rng = np.random.default_rng(18)
    df = spark.createDataFrame([(" ".join(f"w{x}" for x in rng.integers(0, 60, 30)),) for _ in range(200)], "text string")
    got = []
    for part, part_slice, few in ((topics.PART_WORDS, topics.SLICE_WORDS, topics.FEW_WORDS), (90, 40, 1000)):
        monkeypatch.setattr(topics, "PART_WORDS", part)
        monkeypatch.setattr(topics, "SLICE_WORDS", part_slice)
        monkeypatch.setattr(topics, "FEW_WORDS", few)
        got.append({(r.topic, r.term): r.weight for r in topics.topics(df, "text", 3, terms=99, rounds=3).collect()})
    assert got[1] == pytest.approx(got[0], rel=1e-9) and len(got[0]) == 3 * 60
    assert sorted(topics.even({1: 5, 2: 9, 3: 4, 4: 1}, [7, 8]).items()) == [(1, 8), (2, 7), (3, 8), (4, 7)]


def test_topics_of_nothing(spark):
    assert topics.topics(spark.createDataFrame([], "text string"), "text", 2).collect() == []
    assert topics.topics(spark.createDataFrame([("one word",), ("other",)], "text string"), "text", 2).collect() == []


def test_digamma():
    assert topics.digamma(np.array([0.5, 1.0, 10.0])) == pytest.approx([-1.9635100260214235, -0.5772156649015329, 2.251752589066721], abs=1e-12)


def test_embeddings_take_part_whole(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet")
    n = e.agg(F.max(F.size("embedding"))).first()[0]
    assert n > 8 and len(plans.embedded(spark, SF).columns) == n + 1
    shares = [r.share for r in plans.m19(spark, SF).collect()]
    cols = e.select(*(F.col("embedding")[i].cast("double").alias(f"x{i}") for i in range(n)))
    assert shares == pytest.approx([r.share for r in models.pca(cols, cols.columns, 3).collect()])


def test_pickup_quantiles_of_busy_keys(spark):
    """Counts whose mass at zero is below the least number."""
    panel = spark.range(1000).select(
        F.lit("t").alias("team"), F.date_add(F.lit("2020-01-01").cast("date"), F.col("id").cast("int")).alias("date"), F.lit(1800).alias("event_newcase")
    )
    r = models.pickup_predictive(panel, "team").first()
    spread = 1.645 * (r.mean * (1 + 1 / 1001)) ** 0.5
    assert abs(r.p5 - (r.mean - spread)) < 3 and abs(r.p95 - (r.mean + spread)) < 3
