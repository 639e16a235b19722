"""Ranked lexical search by geometric blocks of posting lists.

A document's coordinate under a term is its saturated count, (10^9 tf) div (1000 tf + 20 m); its
score is the sum of the query's weights times the coordinates. Documents are packed into shards of at
most CELLS coordinates. In a shard the posting list of a term is cut into blocks of similar
documents: pivots are picked evenly from the list, every document goes to the pivot whose projected
coordinates are nearest, and a block's summary is the coordinatewise maximum of its documents over the
terms that queries hold beside the list's own. Queries take their terms in order of the largest score
that each can add. The bound of a block is the sum of weights times summary; a block is skipped only if
that lies below the score that the last of the query's best has so far, and a query ends when the
terms that are left can't reach it together. Bounds are exact, so no document is lost, and equal
scores are decided by the smaller id.

Queries are taken in lots of at most LOT terms; what they hold is known to every task, and what they
don't hold can't add to a score. A first pass over the texts writes the counts of the lot's terms and
each document's length; document frequencies, N and L come from these. A task gives the best of each
query among its documents, those are ranked once more.

Defined cases: items of one id are one query of all their terms; items without terms, or whose terms
no document holds, give no rows. Every row of documents is a document of its own, repeated rows too.
Documents with a null id rank last among equals. Null and empty texts have no terms and aren't counted.
Empty tables give an empty result. Extra columns are not read.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import python_batches, stored, table

#: Terms of a lot of queries, at most; a query of more is a lot of its own.
LOT = 8192
#: Coordinates of a shard, four bytes each.
CELLS = 1 << 24
#: Documents of a shard, at most, and of a block, on average.
SHARD, BLOCK = 4096, 64
#: Dimensions in which documents are compared when blocks are made.
DIMENSIONS = 16
#: Keeps ASCII letters and digits, A-Z lower-cased, and all bytes of other characters; the rest parts terms.
TERM = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256)).translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256)))
COUNTS = "doc_id bigint, n bigint, terms array<int>, counts array<int>"
RESULT = "item_id bigint, doc_id bigint, score bigint"
#: An id that is null comes after all others.
NO_ID = (1 << 63) - 1


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(TERM).split()


def _texts(df: DataFrame, key: str) -> DataFrame:
    return df.select(F.col(key).cast("bigint").alias(key), F.col("text").cast("string").alias("text"))


def item_terms(items: DataFrame) -> DataFrame:
    """item_id and its distinct terms; a document's words leave each row once only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(set(terms_of(t))) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array(found, pa.list_(pa.binary()))], names=["item_id", "terms"])

    made = _texts(items, "item_id").mapInArrow(run, "item_id bigint, terms array<binary>")
    return made.select("item_id", F.explode("terms").alias("term")).groupBy("item_id").agg(F.sort_array(F.collect_set("term")).alias("terms"))


def lots(items: DataFrame, most: int = LOT) -> Iterator[dict[int | None, list[bytes]]]:
    """Queries with their terms, in lots of at most so many distinct terms, in order of id."""
    lot, held = {}, set()
    for r in items.orderBy("item_id").toLocalIterator():
        new = {bytes(t) for t in r.terms}
        if lot and len(held | new) > most:
            yield lot
            lot, held = {}, set()
        lot[r.item_id] = sorted(new)
        held |= new
    if lot:
        yield lot


def postings(docs: DataFrame, terms: list[bytes]) -> DataFrame:
    """doc_id, number of all its terms, and places in `terms` with their counts."""
    python_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {t: k for k, t in enumerate(terms)}
        get = place.get
        for batch in batches:
            n, sizes, flat, many = [], [0], [], []
            for text in batch.column("text").to_pylist():
                words = terms_of(text)
                n.append(len(words))
                found = Counter(map(get, words))
                found.pop(None, None)
                flat += found.keys()
                many += found.values()
                sizes.append(len(flat))
            split = pa.array(sizes, pa.int32())
            arrays = [pa.ListArray.from_arrays(split, pa.array(x, pa.int32())) for x in (flat, many)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), *arrays], names=["doc_id", "n", "terms", "counts"])

    return _texts(docs, "doc_id").mapInArrow(run, COUNTS).where("n > 0")


class Query:
    """A query's terms, the most that each can add, and its best documents so far."""

    def __init__(self, terms: np.ndarray, weights: np.ndarray, most: int) -> None:
        self.terms, self.weights, self.most = terms, weights, most
        self.best: list[tuple[int, int]] = []  # a heap of (score, -doc_id)

    def full(self) -> bool:
        return len(self.best) >= self.most

    def reach(self) -> int:
        """The score below which no document comes in."""
        return self.best[0][0] if self.full() else 1

    def offer(self, ids: np.ndarray, scores: np.ndarray) -> None:
        at = np.flatnonzero(scores >= self.reach())
        if len(at) > self.most:
            at = at[np.lexsort((ids[at], -scores[at]))[: self.most]]
        for x in zip(scores[at].tolist(), (-ids[at]).tolist(), strict=True):
            if not self.full():
                heapq.heappush(self.best, x)
            elif x > self.best[0]:
                heapq.heapreplace(self.best, x)


class Shard:
    """Coordinates of some documents, and blocks of the posting lists that queries ask for."""

    def __init__(self, ids: np.ndarray, cells: np.ndarray, block: int) -> None:
        self.ids, self.cells, self.block = ids, cells, block
        self.top = cells.max(axis=0)
        self.blocks: dict[int, tuple[list[np.ndarray], np.ndarray]] = {}
        # documents of the shard in a few random directions of unit length
        self.low = (cells @ np.random.default_rng(7).standard_normal((cells.shape[1], DIMENSIONS), np.float32)).astype(np.float32)
        self.low /= np.maximum(np.linalg.norm(self.low, axis=1, keepdims=True), 1e-9)

    def of(self, term: int, beside: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """The blocks of a posting list, and their largest coordinates under the terms `beside`."""
        if term not in self.blocks:
            at = np.flatnonzero(self.cells[:, term])
            k = -(-len(at) // self.block)
            pivots = at[np.linspace(0, len(at) - 1, k).astype(np.int64)] if k > 1 else at[:1]
            near = np.argmax(self.low[at] @ self.low[pivots].T, axis=1) if k > 1 else np.zeros(len(at), np.int64)
            order = np.argsort(near, kind="stable")
            first = np.flatnonzero(np.r_[True, np.diff(near[order]) != 0][: len(at)])
            held = at[order]
            summary = np.maximum.reduceat(self.cells[np.ix_(held, beside)], first, axis=0) if len(at) else np.zeros((0, len(beside)), self.cells.dtype)
            self.blocks[term] = np.split(held, first[1:]), summary
        return self.blocks[term]

    def search(self, query: Query, beside: list[np.ndarray]) -> None:
        terms, weights = query.terms, query.weights
        most = weights * self.top[terms].astype(np.int64)
        order = np.argsort(-most, kind="stable")
        left = np.cumsum(most[order][::-1])[::-1]  # what this term and all after it can add
        seen = np.zeros(len(self.ids), bool)
        for k, rest in zip(order.tolist(), left.tolist(), strict=True):
            if not most[k] or rest < query.reach():
                return
            term = int(terms[k])
            blocks, summary = self.of(term, beside[term])
            bound = summary[:, np.searchsorted(beside[term], terms)].astype(np.int64) @ weights
            for b in np.argsort(-bound, kind="stable").tolist():
                if bound[b] < query.reach():
                    break
                at = blocks[b][~seen[blocks[b]]]
                seen[at] = True
                query.offer(self.ids[at], self.cells[np.ix_(at, terms)].astype(np.int64) @ weights)


def best(postings: DataFrame, queries: dict[int | None, tuple[np.ndarray, np.ndarray]], width: int, docs: int, total: int, top: int, block: int) -> DataFrame:
    """Each task's best documents of each query. queries: places of the terms in order, and their weights."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = {i: Query(t, w, top) for i, (t, w) in queries.items()}
        beside: list = [[] for _ in range(width)]
        for t, _ in queries.values():
            for x in t.tolist():
                beside[x].append(t)
        beside = [np.unique(np.concatenate(x)) if x else np.zeros(0, np.int64) for x in beside]
        rows = max(1, min(SHARD, CELLS // max(1, width)))
        for batch in chain.from_iterable((b.slice(s, rows) for s in range(0, len(b), rows)) for b in gathered(batches, rows)):
            ids = np.array([NO_ID if i is None else i for i in batch.column("doc_id").to_pylist()], np.int64)
            n = batch.column("n").to_numpy()
            m = 100 - 50 + (50 * n * docs) // total
            lists = batch.column("terms").combine_chunks() if isinstance(batch.column("terms"), pa.ChunkedArray) else batch.column("terms")
            counts = batch.column("counts").combine_chunks() if isinstance(batch.column("counts"), pa.ChunkedArray) else batch.column("counts")
            row = np.repeat(np.arange(len(ids)), np.diff(lists.offsets.to_numpy()))
            tf = counts.flatten().to_numpy().astype(np.int64)
            cells = np.zeros((len(ids), width), np.int32)
            cells[row, lists.flatten().to_numpy()] = (1_000_000_000 * tf) // (1000 * tf + 20 * m[row])
            shard = Shard(ids, cells, block)
            for q in asked.values():
                shard.search(q, beside)
        made = [(i, None if d == -NO_ID else -d, s) for i, q in asked.items() for s, d in q.best]
        if made:
            columns = [pa.array(c, pa.int64()) for c in zip(*made, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=["item_id", "doc_id", "score"])

    return postings.mapInArrow(run, RESULT)


def gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Small batches joined to so many rows, the last less."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def search(docs: DataFrame, items: DataFrame, top: int = 50, lot: int = LOT, block: int = BLOCK) -> DataFrame:
    """item_id, rank, doc_id, score: the `top` best documents of each item."""
    spark, found = docs.sparkSession, None
    for queries in lots(stored(item_terms(items), "items"), lot):
        terms = sorted(set().union(*queries.values()))
        counts = stored(postings(docs, terms), "postings")
        size = counts.agg(F.count("*").alias("docs"), F.sum("n").alias("total")).first()
        held = counts.select(F.explode("terms").alias("t")).groupBy("t").count().collect()  # one row a term of the lot
        if not size.docs:
            continue
        df = np.zeros(len(terms), np.int64)
        df[[r.t for r in held]] = [r["count"] for r in held]
        weight = np.floor(1000 * np.log((2 * size.docs + 2) / (2 * df + 1))).astype(np.int64)
        place = {t: k for k, t in enumerate(terms)}
        asked = {}
        for i, own in queries.items():
            at = np.array([k for k in map(place.__getitem__, own) if df[k]], np.int64)
            if len(at):
                asked[i] = at, weight[at]
        part = best(counts, asked, len(terms), size.docs, size.total, top, block)
        found = part if found is None else found.unionAll(part)
    if found is None:
        found = spark.createDataFrame([], RESULT)
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("item_id", "rank", "doc_id", "score")


def op13_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))


_LETTERS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ORACLE = {
    "op13_ranked": rf"""
WITH d AS (
  SELECT row_number() OVER () AS row_no, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_LETTERS}') AS terms
  FROM documents
), counted AS (SELECT row_no, doc_id, terms, len(terms)::BIGINT AS n FROM d WHERE len(terms) > 0
), size AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS total FROM counted
), q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_LETTERS}')) AS term FROM benchmark
), tf AS (
  SELECT row_no, doc_id, n, term, count(*)::BIGINT AS tf
  FROM (SELECT row_no, doc_id, n, unnest(terms) AS term FROM counted) AS t
  WHERE term IN (SELECT term FROM q)
  GROUP BY ALL
), df AS (SELECT term, floor(1000 * ln((2 * max(docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, size GROUP BY term
), scored AS (
  SELECT q.item_id, tf.row_no, tf.doc_id,
    sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * docs) // total)))))::BIGINT AS score
  FROM q JOIN tf USING (term) JOIN df USING (term), size
  GROUP BY ALL
), ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank, doc_id, score FROM scored WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50
"""
}
