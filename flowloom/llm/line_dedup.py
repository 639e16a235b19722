"""Line dedup over a corpus.

Every line becomes (128-bit hash of its key, document, position). The rows are range-partitioned by
hash and document and sorted inside each partition by hash, document and position, so a task streams
over runs of equal hashes with constant memory: it notes each run's first occurrence and its number
of documents. A key that a third of the documents share spans many partitions, because the document
is part of the range; its runs are summed afterwards. What comes back to a document is a compressed
bitmap of the lines it keeps, not text.

Defined cases: a null text is one empty line. Documents are counted by id: rows that share one count
once, whatever their texts, and rows with a null id do not count; all of them lose the lines that go.
An empty table gives an empty result.
Keys shorter than min_key code points are never dropped.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, WHITE, python_batches, stored, table

LINES = "h1 bigint, h2 bigint, doc_id bigint, th bigint, pos int"
RUNS = "h1 bigint, h2 bigint, docs bigint, lines bigint, first_doc bigint, first_th bigint, first_pos int"


def line_key(line: bytes) -> bytes:
    return line.strip(WHITE).translate(LOWER)


def _lines(min_key: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, ids, ths, positions = [], [], [], []
            for doc_id, text, th in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for pos, line in enumerate((text or "").encode().split(b"\n")):
                    key = line_key(line)
                    if min_key <= 1 and key or min_key > 1 and len(key.decode()) >= min_key or min_key <= 0:
                        hashes.append(xxhash.xxh3_128_digest(key))
                        ids.append(doc_id)
                        ths.append(th)
                        positions.append(pos)
            pair = np.frombuffer(b"".join(hashes), dtype="<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [pa.array(pair[:, 0]), pa.array(pair[:, 1]), pa.array(ids, pa.int64()), pa.array(ths, pa.int64()), pa.array(positions, pa.int32())],
                names=["h1", "h2", "doc_id", "th", "pos"],
            )

    return run


def _stream(least: int):
    """Runs of equal hashes in sorted rows. Inner runs of fewer than `least` documents are whole and go unsaid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list | None = None  # h1, h2, docs, lines, first doc, th, pos, last doc
        first = True

        def emit(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64()] * 6 + [pa.int32()], strict=True)],
                names=["h1", "h2", "docs", "lines", "first_doc", "first_th", "first_pos"],
            )

        for batch in batches:
            if not batch.num_rows:
                continue
            h1, h2, doc, th, pos = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            new_key = np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])]
            new_doc = new_key | np.r_[True, doc[1:] != doc[:-1]]
            starts = np.flatnonzero(new_key)
            docs, sizes = np.add.reduceat(new_doc.astype(np.int64), starts), np.diff(np.r_[starts, len(h1)])
            ends = np.r_[starts[1:], len(h1)] - 1
            out = []
            for k, (s, e) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
                if held and held[0] == h1[s] and held[1] == h2[s]:
                    held[2] += int(docs[k]) - (held[7] == doc[s])
                    held[3] += int(sizes[k])
                    held[7] = doc[e]
                    continue
                if held and (first or held[2] >= least):
                    out.append(held[:7])
                    first = False
                held = [int(h1[s]), int(h2[s]), int(docs[k]), int(sizes[k]), int(doc[s]), int(th[s]), int(pos[s]), doc[e]]
            if out:
                yield emit(out)
        if held:
            yield emit([held[:7]])  # the last run may go on in the next partition

    return run


def _bitmap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        maps = []
        for n, dropped in zip(batch.column("n_lines").to_pylist(), batch.column("dropped").to_pylist(), strict=True):
            keep = np.ones(n, dtype=bool)
            keep[np.asarray(dropped, dtype=np.int64)] = False
            maps.append(zlib.compress(np.packbits(keep).tobytes()))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                batch.column("th"),
                batch.column("n_lines"),
                pa.array(map(len, batch.column("dropped").to_pylist()), pa.int32()),
                pa.array(maps, pa.binary()),
            ],
            names=["doc_id", "th", "n_lines", "n_dropped", "keep"],
        )


def keep_bitmaps(docs: DataFrame, min_docs: int = 2, min_key: int = 1, keep: str = "first") -> DataFrame:
    """doc_id, th (hash of the text), n_lines, n_dropped, keep: only documents that lose a line.

    keep="first": of a key found in min_docs documents or more, the first line (by document and
    position) stays. keep="none": all its lines go.
    """
    if keep not in ("first", "none"):
        raise ValueError(f"keep is first or none, not {keep!r}")
    spark = docs.sparkSession
    python_batches(spark)
    texts = docs.select(F.col("doc_id").cast("bigint"), "text", F.xxhash64("text").alias("th"))
    lines = stored(texts.mapInArrow(_lines(min_key), LINES), "lines")
    ranged = lines.where(F.col("doc_id").isNotNull()).repartitionByRange("h1", "doc_id").sortWithinPartitions("h1", "h2", "doc_id", "th", "pos")
    runs = ranged.mapInArrow(_stream(min_docs), RUNS)
    frequent = (
        runs.groupBy("h1", "h2")
        .agg(F.sum("docs").alias("docs"), F.min(F.struct("first_doc", "first_th", "first_pos")).alias("first"))
        .where(F.col("docs") >= min_docs)
    )
    hit = lines.join(frequent, ["h1", "h2"])
    if keep == "first":
        hit = hit.where(
            ~F.struct("doc_id", "th", "pos").eqNullSafe(
                F.struct(F.col("first.first_doc").alias("doc_id"), F.col("first.first_th").alias("th"), F.col("first.first_pos").alias("pos"))
            )
        )
    dropped = hit.groupBy("doc_id", "th").agg(F.collect_set("pos").alias("dropped"))
    sizes = texts.select(
        "doc_id",
        "th",
        (F.length(F.coalesce("text", F.lit(""))) - F.length(F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(""))) + 1).alias("n_lines"),
    )
    sizes = sizes.groupBy(F.col("doc_id").alias("id_"), F.col("th").alias("th_")).agg(F.max("n_lines").cast("int").alias("n_lines"))
    same = dropped["doc_id"].eqNullSafe(F.col("id_")) & (dropped["th"] == F.col("th_"))
    return (
        dropped.join(sizes, same)
        .select("doc_id", "th", "n_lines", "dropped")
        .mapInArrow(_bitmap, "doc_id bigint, th bigint, n_lines int, n_dropped int, keep binary")
    )


def kept_text(text: str | None, keep: bytes | None) -> tuple[str, int, int]:
    """The text of the kept lines, the number of lines, the number of lines that went."""
    lines = (text or "").split("\n")
    if keep is None:
        return text or "", len(lines), 0
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=len(lines)).astype(bool)
    kept = [x for x, k in zip(lines, bits, strict=True) if k]
    return "\n".join(kept), len(lines), len(lines) - len(kept)


def with_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """docs with a column keep_ (null: all lines stay)."""
    side = bitmaps.select(F.col("doc_id").alias("id_"), F.col("th").alias("th_"), F.col("keep").alias("keep_"))
    return docs.join(side, docs["doc_id"].cast("bigint").eqNullSafe(F.col("id_")) & (F.xxhash64(docs["text"]) == F.col("th_")), "left").drop("id_", "th_")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [kept_text(*x) for x in zip(batch.column("text").to_pylist(), batch.column("keep_").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array([x[1] for x in rows], pa.int64()),
                pa.array([x[2] for x in rows], pa.int64()),
                pa.array([hashlib.sha256(x[0].encode()).hexdigest() for x in rows], pa.string()),
            ],
            names=["doc_id", "n_lines", "n_dropped", "kept_sha256"],
        )


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    both = with_bitmaps(docs, keep_bitmaps(docs, min_docs=10, min_key=1, keep="none"))
    return both.mapInArrow(_digests, "doc_id bigint, n_lines bigint, n_dropped bigint, kept_sha256 string")


def drop_lines(docs: DataFrame, min_docs: int = 10, keep: str = "none") -> DataFrame:
    """docs with the lines gone from the texts; the other columns as they are, n_chars made anew."""
    row = docs.select("doc_id", "text", F.struct("*").alias("row"))  # a struct, so no column of docs clashes with ours
    both = with_bitmaps(row, keep_bitmaps(docs.select("doc_id", "text"), min_docs, 1, keep))

    @F.pandas_udf("string")
    def apply(text: pd.Series, bitmap: pd.Series) -> pd.Series:
        return pd.Series([t if k is None else kept_text(t, k)[0] for t, k in zip(text, bitmap, strict=True)], dtype=object)

    out = both.select(F.col("row").withField("text", F.when(F.col("keep_").isNull(), F.col("text")).otherwise(apply("text", "keep_"))).alias("row"))
    if "n_chars" in docs.columns:
        out = out.select(F.col("row").withField("n_chars", F.length("row.text").cast(docs.schema["n_chars"].dataType)).alias("row"))
    return out.select("row.*")


ORACLE = {
    "op1_line_dedup": r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
m AS (SELECT k.*, f.key IS NOT NULL AS gone FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
""",
}
