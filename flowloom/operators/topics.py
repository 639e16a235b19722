"""Topic model of text: batch variational Bayes, with the table of terms and topics spread over the cluster.

The driver holds one number a topic: the sum of a topic's weights. Texts are read once, into parts: files in the
shared folder that hold documents as numbers of their part's own words. Parts are packed into blocks, whose words
are places among the block's terms. A round joins the blocks' distinct terms with the table of terms, brings a
block's rows to the task that reads its file, finds one fixed point a document and sums by term; what moves is a
row a block and term, never a word of a document. The table goes to the shared folder, and the one before is
deleted; so are the shuffle files of whatever has been written.
"""

from __future__ import annotations

import heapq
import re
import secrets
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import scratch
from .scans import drop_folder

#: Bytes of the table of terms up to which it is broadcast; a larger one is joined by shuffling.
BROADCAST_BYTES = 64 << 20
#: Documents of a term before the term's rows are dealt to several tasks.
TERM_ROWS = 1_000_000
#: Words of a block of documents at most, about: what a task holds at once. Few words make a block a core.
BLOCK_WORDS, FEW_WORDS = 8_000_000, 20_000
#: Words of a part, and of the documents of a block that are worked on at once, about.
PART_WORDS, SLICE_WORDS = 500_000, 64_000
#: A document's fixed point: rounds at most, and the mean change at which it stops.
ROUNDS, STILL = 100, 1e-3
#: While a table is written: its shuffle files are deleted once it is there; and texts go to Python in short batches.
WRITING, TEXTS = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}, {"spark.sql.execution.arrow.maxRecordsPerBatch": "512"}


def digamma(x: np.ndarray) -> np.ndarray:
    """For x > 0: the recurrence up to 6, then the asymptotic series."""
    x = np.array(x, float)
    low = np.zeros_like(x)
    while (small := x < 6).any():
        low[small] -= 1 / x[small]
        x[small] += 1
    s = 1 / (x * x)
    return low + np.log(x) - 0.5 / x - s * (1 / 12 - s * (1 / 120 - s * (1 / 252 - s * (1 / 240 - s * (1 / 132 - s * 691 / 32760)))))


def fixed_points(x: np.ndarray, beta: np.ndarray, starts: np.ndarray, alpha: float) -> tuple[np.ndarray, np.ndarray]:
    """Documents' topic weights, and what each word adds to its term. Documents are runs of words from starts on.

    x: weights of words; beta: their terms' expected weights, topics x words; results are topics x documents and
    topics x words. A document that is still keeps its values, whichever others it is worked on with.
    """
    length = np.diff(np.r_[starts, len(x)])
    topics = range(len(beta))
    one, two = np.empty(len(x)), np.empty(len(x))  # a topic at a time, in the same memory: words are read from the cache

    def share(gamma: np.ndarray) -> np.ndarray:
        return np.exp(digamma(gamma) - digamma(gamma.sum(0)))

    def ratio(theta: np.ndarray, x: np.ndarray, beta: list[np.ndarray], length: np.ndarray) -> np.ndarray:
        total, own = one[: len(x)], two[: len(x)]
        np.multiply(np.repeat(theta[0], length), beta[0], out=total)
        for t in topics[1:]:
            total += np.multiply(np.repeat(theta[t], length), beta[t], out=own)
        total += 1e-100
        return np.divide(x, total, out=total)

    rows = [np.ascontiguousarray(v) for v in beta]
    gamma = now = np.ones((len(beta), len(starts)))
    at, x_, beta_, length_ = np.arange(len(starts)), x, rows, length
    moves, first = np.ones(len(starts), bool), starts
    for _ in range(ROUNDS):
        theta = share(now)
        r = ratio(theta, x_, beta_, length_)
        new = alpha + theta * np.array([np.add.reduceat(np.multiply(v, r, out=two[: len(r)]), first) for v in beta_])
        still = np.abs(new - now).mean(0) < STILL
        now = np.where(moves, new, now)
        moves &= ~still
        if moves.mean() < 0.7:  # those that are still are taken out by the many
            gamma[:, at] = now
            go = np.repeat(moves, length_)
            at, x_, beta_, length_, now = at[moves], x_[go], [v[go] for v in beta_], length_[moves], now[:, moves]
            moves, first = np.ones(len(at), bool), np.cumsum(length_) - length_
        if not len(at):
            break
    gamma[:, at] = now
    theta = share(gamma)
    r = ratio(theta, x, rows, length)
    return gamma, np.array([np.repeat(theta[t], length) * rows[t] * r for t in topics])


def put(folder: str, *lists: np.ndarray) -> int:
    """A new file of lists of numbers: its name."""
    store, root = fs.FileSystem.from_uri(re.sub("^s3[an]://", "s3://", folder))
    store.create_dir(root, recursive=True)
    name = secrets.randbits(62)  # another for each attempt of a task
    held = pa.table({str(k): pa.array([v]) for k, v in enumerate(lists)})
    with store.open_output_stream(f"{root}/{name}") as out, pa.ipc.new_stream(out, held.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as to:
        to.write_table(held)
    return name


def take(folder: str, name: int) -> list[np.ndarray]:
    store, root = fs.FileSystem.from_uri(re.sub("^s3[an]://", "s3://", folder))
    with store.open_input_stream(f"{root}/{name}") as at, pa.ipc.open_stream(at) as stream:
        return [c.combine_chunks().flatten().to_numpy() for c in stream.read_all().columns]


def tasks(spark: SparkSession, n: int) -> list[int]:
    """Numbers that repartition(n, column) deals to n tasks, one each."""
    each = spark.range(64 * n).select(F.col("id").cast("int").alias("x")).groupBy(F.pmod(F.hash("x"), F.lit(n)).alias("task")).agg(F.min("x").alias("x"))
    found = [r.x for r in each.collect()]
    return found + list(range(64 * n, 65 * n - len(found)))


def even(words: dict[int, int], lots: list[int]) -> dict[int, int]:
    """Each part's lot: parts, the long ones first, go to the lot that has the fewest words."""
    heap = [(0, k) for k in sorted(lots)]
    out = {}
    for part in sorted(words, key=lambda p: (-words[p], p)):
        n, out[part] = heapq.heappop(heap)
        heapq.heappush(heap, (n + words[part], out[part]))
    return out


def topics(df: DataFrame, text: str, k: int, terms: int = 8, rounds: int = 10, seed: int = 7) -> DataFrame:
    """topic, term, weight: each topic's heaviest terms, by TF-IDF of all words that two or more documents hold.

    The first weights are drawn by a hash of term and topic, so that results depend on the texts alone.
    Null and empty texts take no part; where no word is in two documents the result is empty; ties go to
    the lesser term. Extra columns are not read.
    """
    spark = df.sparkSession
    alpha = eta = 1 / k
    w = [f"w{t}" for t in range(k)]
    stop = frozenset(x.encode() for x in StopWordsRemover.loadDefaultStopWords("english"))
    part_files, block_files = scratch(spark, "parts"), scratch(spark, "blocks")

    def write(d: DataFrame, name: str, more: dict | None = None) -> tuple[DataFrame, str]:
        path = scratch(spark, name)
        conf = WRITING | (more or {})
        before = {c: spark.conf.get(c, None) for c in conf}
        for c, v in conf.items():
            spark.conf.set(c, v)
        try:
            d.write.parquet(path)
        finally:
            for c, v in before.items():
                if v is None:
                    spark.conf.unset(c)
                else:
                    spark.conf.set(c, v)
        return spark.read.schema(d.schema).parquet(path), path

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Words between white space, English stop words left out: a row a part, with its distinct words and how many documents hold them."""
        index: dict[bytes, int] = {}
        place: list[int] = []
        n: list[int] = []
        held: list[int] = []

        def close() -> pa.RecordBatch:
            at, doc = np.array(place, np.int32), np.repeat(np.arange(len(held), dtype=np.int32), held)
            go = np.array([x not in stop for x in index] or [False])[at]
            docs = np.bincount(at[go], minlength=len(index)).astype(np.int32)
            name = put(part_files, doc[go], at[go], np.array(n, np.int32)[go])
            pos = np.flatnonzero(docs).astype(np.int32)
            term = pa.array(list(index), pa.binary()).take(pa.array(pos)).cast(pa.string())
            row = name, len(held), int(go.sum()), pos, term, docs[pos]
            return pa.RecordBatch.from_arrays(
                [pa.array([x]) for x in row[:3]] + [pa.array([row[3]]), pa.ListArray.from_arrays([0, len(term)], term), pa.array([row[5]])],
                names=["part", "texts", "words", "pos", "term", "docs"],
            )

        for batch in batches:
            for x in batch.column("text").to_pylist():
                count = Counter(x.split())
                place += [index.setdefault(y, len(index)) for y in count]
                n += count.values()
                held.append(len(count))
                if len(place) >= min(PART_WORDS, BLOCK_WORDS):
                    yield close()
                    index, place, n, held = {}, [], [], []
        if held:
            yield close()

    texts = df.select(F.col(text).alias("text")).where(F.length("text") > 0).select(F.lower("text").cast("binary").alias("text"))
    parts, at_parts = write(
        texts.mapInArrow(read, "part bigint, texts bigint, words bigint, pos array<int>, term array<string>, docs array<int>"), "texts", TEXTS
    )
    told_parts = parts.select("part", "texts", "words").collect()  # a row for PART_WORDS words
    m, n_words = sum(r.texts for r in told_parts), sum(r.words for r in told_parts)
    each_term = parts.select("part", F.explode(F.arrays_zip("pos", "term", "docs")).alias("x")).select("part", "x.pos", "x.term", "x.docs")
    found = each_term.groupBy("term").agg(F.sum("docs").alias("df")).where("df > 1")
    vocabulary, at_vocabulary = write(found.select(
        F.monotonically_increasing_id().alias("id"), "term",
        F.log((m + F.lit(1.0)) / (F.col("df") + 1)).alias("idf"), F.ceil(F.col("df") / TERM_ROWS).cast("int").alias("salts"),
    ), "vocabulary")
    blocks = max(1, -(-n_words // BLOCK_WORDS), min(spark.sparkContext.defaultParallelism, n_words // FEW_WORDS))
    lots = even({r.part: r.words for r in told_parts}, tasks(spark, blocks))

    def by_block(rows: DataFrame, f: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
        """f of each block's rows. A block has a task of its own, so nothing is sorted."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if got := [b for b in batches if b.num_rows]:
                held = pa.Table.from_batches(got)
                for block in held.column("block").unique():
                    yield from f(held.filter(pc.equal(held.column("block"), block))).to_batches(10_000)

        return rows.repartition(blocks, "block").mapInArrow(run, schema)

    def pack(held: pa.Table) -> pa.Table:
        """The parts of a block: where documents start, each word's term among the block's, its number; the terms' ids and idf."""
        block, part, pos, id, idf = (held.column(c).to_numpy() for c in ("block", "part", "pos", "id", "idf"))
        order = np.lexsort((pos, part))
        part, pos, id, idf = (x[order] for x in (part, pos, id, idf))
        terms, first, own = np.unique(id, return_index=True, return_inverse=True)
        docs, places, ns, before = [], [], [], 0
        for g in np.split(np.arange(len(part)), np.flatnonzero(np.diff(part)) + 1):
            doc, place, n = take(part_files, int(part[g[0]]))
            known = np.full(max(int(place.max()), int(pos[g[-1]])) + 1, -1, np.int32)
            known[pos[g]] = own[g]
            place = known[place]
            docs.append(doc[place >= 0].astype(np.int64) + before)
            places.append(place[place >= 0])
            ns.append(n[place >= 0])
            before += int(doc[-1]) + 1
        doc, place, n = map(np.concatenate, (docs, places, ns))
        order = np.lexsort((place, doc))  # sums don't depend on how rows arrive
        doc = doc[order]
        starts = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
        name = put(block_files, starts, place[order], n[order], terms, idf[first])
        return pa.table({"block": pa.array(block[:1]), "name": pa.array([name]), "terms": pa.array([terms])})

    lot = spark.createDataFrame(list(lots.items()), "part bigint, block int")
    known = each_term.select("part", "pos", "term").join(vocabulary.where("idf > 0").select("term", "id", "idf"), "term")
    dealt = known.join(F.broadcast(lot), "part").select("block", "part", "pos", "id", "idf")
    packed, at_packed = write(by_block(dealt, pack, "block int, name bigint, terms array<bigint>"), "packed")
    for done in (at_parts, part_files):
        drop_folder(spark, done)
    names = {r.block: r.name for r in packed.select("block", "name").collect()}  # a row for BLOCK_WORDS words
    asked, at_asked = write(packed.select("block", F.posexplode("terms").alias("pos", "id")).join(vocabulary.select("id", "salts"), "id").select(
        "block", "pos", "id", F.pmod("block", "salts").cast("int").alias("salt")
    ), "asked")
    size = vocabulary.count()
    small = size * (8 * k + 16) <= BROADCAST_BYTES
    drawn = [(F.pmod(F.xxhash64("term", F.lit(t), F.lit(seed)), F.lit(1 << 20)) / (1 << 20) + 0.5).alias(c) for t, c in enumerate(w)]
    weights, at = write(vocabulary.select("id", *drawn), "weights")

    def expected(totals: np.ndarray):
        """A term's expected weights, from those of the table and the topics' sums."""
        base = digamma(totals)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own = np.array([batch.column(c).to_numpy() for c in w]).reshape(k, -1)
                beta = np.exp(digamma(own) - base[:, None])
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("salts"), *map(pa.array, beta)], names=["id", "salts", *w])

        return run

    def settle(told: pa.Table) -> pa.Table:
        """The expected weights of a block's terms: what its documents add to each."""
        starts, place, n, terms, idf = take(block_files, names[told.column("block")[0].as_py()])
        order = np.argsort(told.column("pos").to_numpy())
        beta = np.stack([told.column(c).to_numpy()[order] for c in w])
        sums = np.zeros_like(beta)
        ends = np.r_[starts[1:], len(place)]
        a = 0
        while a < len(starts):
            b = max(a + 1, int(np.searchsorted(ends, starts[a] + SLICE_WORDS, "right")))
            here = slice(starts[a], ends[b - 1])
            _, adds = fixed_points(n[here] * idf[place[here]], beta[:, place[here]], starts[a:b] - starts[a], alpha)
            sums += [np.bincount(place[here], v, len(terms)) for v in adds]
            a = b
        return pa.table({"id": pa.array(terms), **dict(zip(w, sums, strict=True))})

    each = ", ".join(f"{c} double" for c in w)
    for _ in range(rounds if names else 0):
        totals = np.array(weights.agg(*(F.sum(c) for c in w)).first())
        beta = weights.join(vocabulary.select("id", "salts"), "id").mapInArrow(expected(totals), f"id bigint, salts int, {each}")
        beta = beta.select("id", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), *w)
        told = asked.join(F.broadcast(beta) if small else beta, ["id", "salt"]).select("block", "pos", *w)
        adds = by_block(told, settle, f"id bigint, {each}").groupBy("id").agg(*(F.sum(c).alias(c) for c in w))
        new = vocabulary.select("id").join(adds, "id", "left").select("id", *((F.coalesce(c, F.lit(0.0)) + eta).alias(c) for c in w))
        before = at
        weights, at = write(new, "weights")
        drop_folder(spark, before)
    totals = weights.agg(*(F.sum(c) for c in w)).first()
    named = weights.join(vocabulary.select("id", "term"), "id")
    out = None
    for t, (c, total) in enumerate(zip(w, totals, strict=True)):
        top = named.select(F.lit(t).alias("topic"), "term", (F.col(c) / F.lit(total)).alias("weight")).orderBy(F.desc("weight"), "term").limit(terms)
        out = top if out is None else out.unionByName(top)
    for done in (at_packed, at_asked, block_files):
        drop_folder(spark, done)
    return out
