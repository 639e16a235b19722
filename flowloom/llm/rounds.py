"""Rounds in which blocks of a corpus ask table partitions and are answered.

A block asks each of many partitions for its distinct keys at once, in one packed row; a partition
sees what all blocks ask and answers each. A key that a third of all rows hold is one entry a block.
Blocks are dealt to as many tasks as there are blocks: their rows are small, their work is not.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from .common import new_folder, stored

STATE = pa.schema([("block", pa.string()), ("data", pa.binary())])

#: A block's state to partition, places of the keys among the block's, columns.
Ask = Callable[[dict], list[tuple[int, np.ndarray, tuple]]]
#: What all blocks ask of a partition to what each is told, and numbers: how many keys, then any to be summed.
Answer = Callable[[list[tuple]], tuple[list, list[int]]]


def dump(x: object) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(x, 5))


def load(data: bytes):
    return pickle.loads(zstandard.ZstdDecompressor().decompress(data))


def dealt(part: np.ndarray, *columns: np.ndarray) -> list[tuple[int, np.ndarray, tuple]]:
    """Rows by partition: partition, their places, their columns."""
    order = np.argsort(part, kind="stable")
    cuts = np.flatnonzero(np.r_[True, np.diff(part[order]) != 0])[1:] if len(order) else []
    return [(int(part[s[0]]), s, tuple(c[s] for c in columns)) for s in np.split(order, cuts) if len(s)]


def small(x: np.ndarray) -> np.ndarray:
    """Numbers from zero up in as few bytes each as the largest needs (three as a table of bytes)."""
    most = int(x.max(initial=0))
    if 1 << 16 <= most < 1 << 24:
        return np.ascontiguousarray(np.ascontiguousarray(x, "<i8").view(np.uint8).reshape(-1, 8)[:, :3])
    return x.astype(np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32 if most < 1 << 32 else np.int64)


def large(x: np.ndarray) -> np.ndarray:
    """The numbers that small() packed."""
    if x.ndim == 2:
        out = np.zeros((len(x), 8), np.uint8)
        out[:, :3] = x
        return out.view("<i8").ravel()
    return x.astype(np.int64)


def exchange(
    state: DataFrame, ask: Ask, answer: Answer, parts: int, apply: Callable[[dict, dict, dict], Iterator], schema: pa.Schema, blocks: int
) -> tuple[DataFrame, str, np.ndarray]:
    """One round over a state of block, data (a packed dictionary).

    apply(block, answers by partition, before) yields a new dictionary, or columns of another schema.
    before: number of keys before each partition, of all under -1, and the summed numbers under -2.
    Returns the rows, the folder of the answers, and the summed numbers.
    """

    again = schema is STATE

    def asks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, data in zip(batch.column("block").to_pylist(), batch.column("data").to_pylist(), strict=True):
                rows = [(p, block, dump(columns)) for p, _, columns in ask(load(data))]
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.string(), pa.binary()), strict=True)],
                        names=["part", "block", "data"],
                    )

    def answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(part: int, blocks: list[str], got: list[tuple]) -> pa.RecordBatch:
            out, numbers = answer(got)
            n = len(blocks)
            columns = [[part] * n, blocks, [dump(x) for x in out], [[int(x) for x in numbers], *[None] * (n - 1)]]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.string(), pa.binary(), pa.list_(pa.int64())), strict=True)],
                names=["part", "block", "data", "numbers"],
            )

        at, blocks, got = None, [], []
        for batch in batches:
            for part, block, data in zip(*(batch.column(c).to_pylist() for c in ("part", "block", "data")), strict=True):
                if part != at:
                    if got:
                        yield close(at, blocks, got)
                    at, blocks, got = part, [], []
                blocks.append(block)
                got.append(load(data))
        if got:
            yield close(at, blocks, got)

    asked = state.mapInArrow(asks, "part int, block string, data binary").repartition(parts, "part").sortWithinPartitions("part", "block")
    path = new_folder(state.sparkSession, "answers")
    answered = stored(asked.mapInArrow(answers, "part int, block string, data binary, numbers array<bigint>"), "answers", path)
    told = sorted((r.part, r.numbers) for r in answered.where("numbers IS NOT NULL").select("part", "numbers").collect())  # one row a partition
    sums = np.sum([n for _, n in told], axis=0) if told else np.zeros(1, np.int64)
    before: dict = dict(zip([p for p, _ in told], np.cumsum([0, *(n[0] for _, n in told)]).tolist(), strict=False)) | {-1: int(sums[0]), -2: sums}
    gathered = answered.repartition(max(1, blocks), "block").groupBy("block").agg(F.collect_list(F.struct("part", "data")).alias("answers"))

    def applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, data, said in zip(*(batch.column(c).to_pylist() for c in ("block", "data", "answers")), strict=True):
                for columns in apply(load(data), {a["part"]: load(a["data"]) for a in said or ()}, before):
                    if again:
                        columns = [[block], [dump(columns)]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)

    both = state.repartition(max(1, blocks), "block").join(gathered, "block", "left")
    return both.select("block", "data", "answers").mapInArrow(applied, from_arrow_schema(schema)), path, sums
