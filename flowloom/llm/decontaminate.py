"""Benchmark decontamination, in DataFrame functions only.

An item is found in a document if at least `containment` of its distinct 5-word shingles are there.
Items are partitioned by size: a class holds those of 2^c to 2^(c+1) - 1 shingles. Each item has a
MinHash sketch, its k least shingle hashes, where k is set by its number of shingles n so that a
document that holds enough of the item holds at least k - floor((1 - containment) * n) > 0 of the
sketch. A class has a bound on hashes, the greatest that one of its sketches holds, and a least
length of documents; a document is looked up in the classes that it is long enough for, with those of
its shingle hashes that lie within the class's bound. So the search misses nothing, however long the
document, and the longer the items the fewer hashes take part. Candidates are verified on the
shingles themselves.

The sketches are broadcast only if they count at most BROADCAST_ROWS; else the join shuffles.

Words are runs of letters and digits, lower-cased. Defined cases: null and empty texts hold no
words; an item without words is found nowhere; an item of fewer than five words is one shingle, its
whole sequence; rows with a null document or item id are not searched; of rows that share an id the
pair of a document's and an item's text with the greatest containment (then the most shingles found)
counts; empty tables give an empty result. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

WIDTH = 5
CONTAINMENT = 0.8
#: Rows of (item, hash), about 40 bytes each.
BROADCAST_ROWS = 500_000
#: Sketch hashes beyond those that the threshold lets a document lack.
SPARE = 8


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _starts(n: Column, width: int) -> Column:
    return F.when(n >= width, F.sequence(F.lit(0), n - width)).otherwise(F.array().cast("array<int>"))


def hashes(ws: Column, width: int) -> Column:
    """A hash for each run of `width` words. ws: hashes of the words."""
    return F.transform(_starts(F.size(ws), width), lambda i: F.xxhash64(*(F.get(ws, i + k) for k in range(width))))


def runs(ws: Column, width: int) -> Column:
    """The distinct runs of `width` words, as text."""
    return F.array_distinct(F.transform(_starts(F.size(ws), width), lambda i: F.array_join(F.slice(ws, i + 1, width), " ")))


def sketches(benchmark: DataFrame, width: int, containment: float) -> DataFrame:
    """item_no, item_id, ws, width, n, size_class, least (sketch hashes that a document must hold), sketch: for each distinct text of an item."""
    items = benchmark.where(F.col("item_id").isNotNull()).select(
        F.col("item_id").cast("bigint").alias("item_id"), words(F.col("text")).alias("ws")
    ).where(F.size("ws") > 0).distinct()
    items = items.select("item_id", "ws", F.least(F.size("ws"), F.lit(width)).alias("width"), F.transform("ws", lambda w: F.xxhash64(w)).alias("hs"))
    each = F.coalesce(*(F.when(F.col("width") == w, hashes(F.col("hs"), w)) for w in range(1, width + 1)))
    items = items.select("item_id", "ws", "width", F.array_sort(F.array_distinct(each)).alias("all"))
    n = F.size("all")
    spared = F.floor(F.round((1 - containment) * n, 6)).cast("int")
    k = F.least(n, spared + SPARE)
    return items.select(
        F.monotonically_increasing_id().alias("item_no"),
        "item_id",
        "ws",
        "width",
        n.alias("n"),
        F.floor(F.log2(n)).cast("int").alias("size_class"),
        (k - spared).alias("least"),
        F.slice("all", 1, k).alias("sketch"),
    )


def search(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, containment: float = CONTAINMENT) -> DataFrame:
    """doc_id, item_id, n_shingles, n_found, containment for every item found in a document."""
    items = stored(sketches(benchmark, width, containment), "items")
    # one row a size class, under 32 of them: greatest sketch hash, least length of documents, widths, sketch hashes
    classes = items.groupBy("size_class").agg(
        F.max(F.element_at("sketch", -1)).alias("reach"),
        F.floor(F.min("n") * F.lit(containment)).alias("length"),
        F.collect_set("width").alias("widths"),
        F.sum(F.size("sketch")).alias("rows"),
    ).orderBy("size_class").collect()
    if not classes:
        return docs.sparkSession.createDataFrame([], "doc_id bigint, item_id bigint, n_shingles bigint, n_found bigint, containment double")
    texts = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").alias("text"))
    # one row for a shingle of a document and a class that it may belong to; only widths that items have, five unless an item is shorter
    each = F.concat(*(hashes(F.col("hs"), w) for w in sorted({w for c in classes for w in c.widths})))
    hashed = texts.select("doc_id", F.transform(words(F.col("text")), lambda w: F.xxhash64(w)).alias("hs"))
    shingles = hashed.select(
        "doc_id", F.size("hs").alias("n_words"), F.explode(F.array_distinct(each)).alias("h")
    ).where(F.col("h") <= max(c.reach for c in classes))
    among = F.array(*(F.when((F.col("h") <= c.reach) & (F.col("n_words") >= c.length), c.size_class) for c in classes))
    seen = shingles.select("doc_id", "n_words", "h", F.explode(among).alias("size_class")).where("size_class IS NOT NULL")
    sketch = items.select("item_no", "n", "least", "size_class", F.explode("sketch").alias("h"))
    near = F.broadcast(sketch) if sum(c.rows for c in classes) <= BROADCAST_ROWS else sketch
    enough = F.col("n_words") >= F.floor(F.col("n") * containment)
    found = seen.join(near, ["size_class", "h"]).where(enough).groupBy("doc_id", "item_no").agg(
        F.count("*").alias("held"), F.max("least").alias("least")
    ).where(F.col("held") >= F.col("least")).select("doc_id", "item_no")
    # verify on the text of the candidates
    pairs = stored(found, "candidates")
    held = texts.join(pairs.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", words(F.col("text")).alias("dw"))
    both = pairs.join(items.select("item_no", "item_id", "ws", "width"), "item_no").join(held, "doc_id")

    def of(ws: str) -> Column:
        return F.coalesce(*(F.when(F.col("width") == w, runs(F.col(ws), w)) for w in range(1, width + 1)))

    counted = both.select("doc_id", "item_id", of("ws").alias("mine"), of("dw").alias("theirs")).select(
        "doc_id", "item_id", F.size("mine").cast("bigint").alias("n_shingles"), F.size(F.array_intersect("mine", "theirs")).cast("bigint").alias("n_found")
    )
    best = counted.groupBy("doc_id", "item_id").agg(
        F.max(F.struct((F.col("n_found") / F.col("n_shingles")).alias("containment"), "n_found", "n_shingles")).alias("b")
    )
    return best.where(F.col("b.n_found") >= F.lit(containment) * F.col("b.n_shingles")).select(
        "doc_id", "item_id", "b.n_shingles", "b.n_found", "b.containment"
    )


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without those that hold a benchmark item; all columns stay, and rows with a null id."""
    found = search(docs.select("doc_id", "text"), benchmark).select(F.col("doc_id").alias("id_")).distinct()
    row = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("bigint").alias("key_"))
    return row.join(found, F.col("key_") == F.col("id_"), "left_anti").select("row.*")


ORACLE = {
    "op9_decontaminate": r"""
WITH w AS (
  SELECT 'd' AS kind, row_number() OVER () AS k, doc_id AS id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS ws FROM documents WHERE doc_id IS NOT NULL
  UNION ALL
  SELECT 'i', row_number() OVER (), item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') FROM benchmark WHERE item_id IS NOT NULL),
i AS (SELECT DISTINCT k, id, least(len(ws), 5) AS n_words, unnest(list_transform(range(len(ws) - least(len(ws), 5) + 1), lambda i: array_to_string(ws[i + 1:i + least(len(ws), 5)], ' '))) AS g
  FROM w WHERE kind = 'i' AND len(ws) > 0),
d AS (SELECT DISTINCT k, id, n_words, unnest(list_transform(range(greatest(len(ws) - n_words + 1, 0)), lambda i: array_to_string(ws[i + 1:i + n_words], ' '))) AS g
  FROM w CROSS JOIN (SELECT DISTINCT n_words FROM i) WHERE kind = 'd'),
n AS (SELECT *, count(*) OVER (PARTITION BY k) AS n FROM i),
p AS (SELECT d.id AS doc_id, n.id AS item_id, n.n AS n_shingles, count(*) AS n_found
  FROM n JOIN d ON d.g = n.g AND d.n_words = n.n_words GROUP BY d.k, d.id, n.k, n.id, n.n)
SELECT doc_id, item_id, n_shingles, n_found, n_found / n_shingles::DOUBLE AS containment
FROM p WHERE n_found >= 0.8 * n_shingles
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY n_found / n_shingles::DOUBLE DESC, n_found DESC) = 1
""",
}
