"""Repeated substrings by a distributed suffix array (difference cover modulo 3).

A text's bytes are cut into phrases at anchors: the least k-gram hash of each window of WINDOW
k-grams, the last of equals. Anchors depend on nearby bytes alone, so equal strings are cut alike,
and any string of `length` bytes holds an anchor `a` bytes from its start (a < WINDOW) followed by
whole phrases, the same ones wherever the string occurs. Phrases are the letters of the suffix
array; a phrase that occurs once in the corpus is a break, for no repeated string holds it.

The suffix array: triples of letters at positions 1 and 2 modulo 3 are sorted and named; if names
are not unique the sorting recurses on the string of names (no deeper than the longest prefix that
is compared, `length` bytes); then the remaining suffixes, as (letter, rank of the next), are merged
with the sampled ones. Adjacent suffixes form an interval while their first whole phrases of `length` -
3 * WINDOW bytes, about, are the same; no such prefix begins another. Those that agree in all phrases within
reach form a group of the interval: such longer prefixes may begin each other, so that suffixes of one group
need not be neighbours. In a group, occurrences with the same bytes about the anchor are wholly repeated; of the others, each of the
length-byte strings about the anchor is compared. Both decide what goes, by digests of 128 bits of
the bytes themselves.

Texts are packed into blocks. Blocks and table partitions grow with the square root of the corpus
beyond some gigabytes, so that what a block asks of a partition stays at PACKET keys or more; a task
works on one block or one partition at a time, and its memory grows with them. Block texts are files in the shared folder (pyarrow.fs), rows hold a
block's arrays. In every round a block asks table partitions for the names, ranks or counts of its
distinct keys with their numbers, and each partition answers all blocks: keys that are common to a
third of all rows are one entry a block. Partitions of sorted rounds are ranges, cut at a bounded
sample of keys. Exact copies beyond the first do not enter the suffix array.

Names of phrases come from digests of 64 bits: equal phrases always share one, and what a collision
would add is found unequal by the digests that decide. A round's tables are deleted once the next is
written. Defined cases: a null text is empty; texts under `length`
bytes keep all; every row is a document of its own, so a repeated row's bytes are repeated; a null
id stays null; an empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Files, new_folder, python_batches, remove, stored, table
from .rounds import STATE, Ask, dealt, dump, exchange, load

WINDOW, GRAM = 96, 12
#: Bytes of text in a block, about; keys of a table partition, about; keys that set the ranges' bounds; keys that a block asks of a partition, at least.
BLOCK_BYTES, PART_KEYS, SAMPLE_KEYS, PACKET = 8 << 20, 1_000_000, 40_000, 1000
PIECE = 1 << 20
_U = np.uint64
_rng = np.random.default_rng(400)
#: Two polynomials: weights of the bytes, and bases.
_BYTES = _rng.integers(1, 2**63, (2, 256), dtype=np.uint64) * _U(2) + _U(1)
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _grown(n: int, which: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse, up to n."""
    if which not in _powers or len(_powers[which][0]) <= n:
        made = []
        for base in (_BASES[which], pow(_BASES[which], -1, 2**64)):
            x = np.full(2 * n + 2, base, np.uint64)
            x[0] = 1
            made.append(np.multiply.accumulate(x))
        _powers[which] = made[0], made[1]
    return _powers[which]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _U(0xBF58476D1CE4E5B9)
    return x ^ (x >> _U(29))


def _both(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return _mix(_mix(x) * _U(0x94D049BB133111EB) + y.astype(np.uint64))


class Digests:
    """Digests of a text's substrings, by polynomial prefix sums modulo 2**64 (for substrings under 1024 bytes)."""

    def __init__(self, b: np.ndarray, which: int = 0) -> None:
        up, self.down = _grown(len(b), which)
        self.sums = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(_BYTES[which][b] * up[: len(b)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _both((self.sums[end] - self.sums[start]) * self.down[start], end - start)


def wide_digests(b: np.ndarray, start: np.ndarray, end: np.ndarray, first: Digests | None = None) -> np.ndarray:
    """128 bits for each substring, as two numbers. first: Digests(b), if there are any."""
    return np.stack([h.of(start, end) for h in (first or Digests(b), Digests(b, 1))], 1)


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys (numbers, strings or pairs of numbers) in order, where each first stands, and each key's place among them."""
    if keys.ndim == 1:
        return np.unique(keys, return_index=True, return_inverse=True)
    order = np.lexsort((keys[:, 1], keys[:, 0]))
    new = np.ones(len(keys), bool)
    new[1:] = (keys[order[1:]] != keys[order[:-1]]).any(1)
    which = np.empty(len(keys), np.int64)
    which[order] = np.cumsum(new) - 1
    return keys[order[new]], order[new], which


def anchors(b: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Anchor positions, and for each the last window start that it serves (the first is the last of the one before, plus 1)."""
    places, lasts = [], []
    whole = len(b) - window - gram + 2
    for at in range(0, whole, PIECE):
        n = min(PIECE, whole - at)
        piece = b[at : at + n + window + gram - 2]
        wide = np.zeros(len(piece) + 8, np.uint8)
        wide[: len(piece)] = piece
        eight = np.ndarray((len(piece),), "<u8", wide.data, 0, (1,))
        m = n + window - 1
        v = _mix(eight[:m] * _U(0xD6E8FEB86659FD93) + _mix(eight[gram - 8 : gram - 8 + m]))
        best, where, span = v, np.arange(m, dtype=np.int32), 1
        while span < window:
            step = min(span, window - span)
            right = best[step:] <= best[:-step]  # the last of equals
            best, where = np.minimum(best[step:], best[:-step]), np.where(right, where[step:], where[:-step])
            span += step
        ends = np.flatnonzero(np.r_[where[1:] != where[:-1], True])
        places.append(where[ends].astype(np.int64) + at)
        lasts.append(ends + at)
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    x, last = np.concatenate(places), np.concatenate(lasts)
    keep = np.r_[x[1:] != x[:-1], True]
    return x[keep], last[keep]


# ---- answers of the rounds


RESULT = pa.schema(
    [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())]
)


def returned(asked: list, said: dict, kind: object, before: dict | None = None) -> np.ndarray:
    """Answers in the order in which the block's keys stood; before: turns ranks within a partition into global ones."""
    n = sum(len(s) for _, s, _ in asked)
    out = np.zeros(n, kind)
    for p, s, _ in asked:
        out[s] = said[p] if before is None else np.where(said[p] > 0, said[p].astype(np.int64) + before[p], 0)
    return out


def _tally(got: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """Distinct keys over all askers, each asked key's place among them, totals, and the askers' sizes."""
    keys, _, which = distinct(np.concatenate([g[0] for g in got]))
    return keys, which, np.bincount(which, np.concatenate([g[1] for g in got]), minlength=len(keys)).astype(np.int64), [len(g[0]) for g in got]


def _split(x: np.ndarray, sizes: list[int]) -> list[np.ndarray]:
    return np.split(x, np.cumsum(sizes)[:-1])


def answer_names(got: list[tuple]) -> tuple[list, list[int]]:
    """Rank from 1 among the partition's keys that occur twice or more; 0 for the others."""
    _, which, total, sizes = _tally(got)
    rank = np.where(total > 1, np.cumsum(total > 1), 0)
    return _split(rank[which].astype(np.uint32), sizes), [int((total > 1).sum())]


def answer_ranks(got: list[tuple]) -> tuple[list, list[int]]:
    keys, which, _, sizes = _tally(got)
    return _split((which + 1).astype(np.uint32), sizes), [len(keys)]


def answer_owners(got: list[tuple]) -> tuple[list, list[int]]:
    """0: occurs once; 2: occurs again, and this block asked first; 1: occurs again, another block asked first."""
    keys, which, total, sizes = _tally(got)
    first = np.full(len(keys), len(got))
    np.minimum.at(first, which, np.repeat(np.arange(len(got)), sizes))
    code = np.where(total[which] > 1, np.where(first[which] == np.repeat(np.arange(len(got)), sizes), 2, 1), 0)
    return _split(code.astype(np.uint8), sizes), [len(keys)]


# ---- keys as byte strings, which sort as their numbers do


def key(*columns: np.ndarray, wide: bool) -> np.ndarray:
    kind = ">u8" if wide else ">u4"
    return np.stack(columns, 1).astype(kind).view(f"S{len(columns) * (8 if wide else 4)}").ravel()


def numbers(keys: np.ndarray, wide: bool) -> np.ndarray:
    size = keys.dtype.itemsize
    return np.frombuffer(keys.tobytes(), ">u8" if wide else ">u4").reshape(len(keys), size // (8 if wide else 4)).astype(np.int64)


def merge_order(rows: np.ndarray) -> np.ndarray:
    """Order of the suffixes of all three kinds. rows: t0, t1, kind, own rank, rank of the next, rank of the one after."""
    t0, t1, kind, own, ra, rb = rows.T
    place = np.zeros(len(rows), np.int64)
    s0, s12 = np.flatnonzero(kind == 0), np.flatnonzero(kind > 0)
    s0 = s0[np.lexsort((ra[s0], t0[s0]))]
    s12 = s12[np.argsort(own[s12], kind="stable")]
    place[s0], place[s12] = np.arange(len(s0)), np.arange(len(s12))
    for k, columns in ((1, (t0, ra)), (2, (t0, t1, rb))):
        other = s12[kind[s12] == k]
        # of equals the sampled one comes first
        both = np.r_[other, s0]
        order = np.lexsort((np.r_[np.zeros(len(other)), np.ones(len(s0))], *(c[both] for c in columns[::-1])))
        is0 = order >= len(other)
        place[both[order[is0]]] += np.cumsum(~is0)[is0]
        place[both[order[~is0]]] += np.cumsum(is0)[~is0]
    return np.lexsort((own, kind, place))


def _merge_keys(t: np.ndarray, rank: np.ndarray, wide: bool) -> np.ndarray:
    """One key for each suffix of the block's string t; rank: of sampled suffixes (positions 1 and 2 modulo 3)."""
    n = len(t)
    t, rank = np.r_[t, 0, 0, 0], np.r_[rank, 0, 0, 0]
    i = np.arange(n)
    kind = i % 3
    return key(
        t[:n], t[1 : n + 1], kind, np.where(kind > 0, rank[:n], 0), np.where(kind < 2, rank[1 : n + 1], 0), np.where(kind != 1, rank[2 : n + 2], 0), wide=wide
    )


def _triples(t: np.ndarray, wide: bool) -> np.ndarray:
    t = np.r_[t, 0, 0, 0]
    i = np.r_[np.arange(1, len(t) - 3, 3), np.arange(2, len(t) - 3, 3)]
    return key(t[i], t[i + 1], t[i + 2], wide=wide)


def bounds(state: DataFrame, keys: Callable[[dict], np.ndarray], parts: int, blocks: int) -> np.ndarray:
    """Cuts of the sorted keys into ranges, from a sample of about SAMPLE_KEYS keys of all blocks."""
    each = max(1, SAMPLE_KEYS // max(blocks, 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("data").to_pylist():
                k = np.unique(keys(load(data)))
                size = k.dtype.itemsize
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x.ljust(size, b"\0") for x in k[:: max(1, len(k) // each)][:each].tolist()], pa.binary())], names=["k"]
                )

    drawn = sorted(bytes(r.k) for r in state.mapInArrow(run, "k binary").sample(min(1.0, SAMPLE_KEYS / max(each * blocks, 1))).collect())
    if not drawn:
        return np.zeros(0, "S8")
    return np.unique(np.array([drawn[len(drawn) * p // parts] for p in range(1, parts)], f"S{len(drawn[0])}"))


def _prefix(keys: np.ndarray, n: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(keys.tobytes(), np.uint8).reshape(len(keys), keys.dtype.itemsize)[:, :n]).view(f"S{n}").ravel()


# ---- the operator


def encode(docs: DataFrame, files: Files, size: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        texts: list[bytes] = []
        held = 0

        def close() -> pa.RecordBatch:
            twice = np.array([xxhash.xxh3_128_digest(t) for t in texts], "S16")
            state = {"file": files.write(b"".join(texts)), "ids": ids, "length": np.array([len(t) for t in texts]), "digest": twice}
            return pa.RecordBatch.from_arrays(
                [pa.array([uuid.uuid4().hex]), pa.array([dump(state)], pa.binary()), pa.array([held], pa.int64())], names=["block", "data", "bytes"]
            )

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids.append(doc_id)
                texts.append((text or "").encode())
                held += len(texts[-1])
                if held >= size:
                    yield close()
                    ids, texts, held = [], [], 0
        if ids:
            yield close()

    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")
    ).mapInArrow(run, "block string, data binary, bytes bigint")


def sizes(total: int) -> tuple[int, int]:
    """Bytes of a block and of a table partition: a phrase has about 50 bytes, and a block's phrases are dealt over all partitions."""
    grown = max(1.0, (50 * PACKET * total / (BLOCK_BYTES * 40 * PART_KEYS)) ** 0.5)
    return int(BLOCK_BYTES * grown), int(40 * PART_KEYS * grown)


def repeated(docs: DataFrame, length: int = 400, kept_bytes: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept) for every row.

    Removed: bytes of every length-byte string that starts anywhere else too. length: 300 to 900.
    """
    window, gram = WINDOW, GRAM
    reach = length - 2 * window - gram + 2  # anchors this near are the same at every occurrence
    if reach < window or length + window > 1000:
        raise ValueError("length must lie between 300 and 900")
    near = reach - window  # of the anchors this far or farther, the first is within reach
    spark = docs.sparkSession
    python_batches(spark)
    files = Files(spark, "texts")
    total = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    block_bytes, part_bytes = sizes(total)
    path = new_folder(spark, "blocks")
    state = stored(encode(docs, files, block_bytes), "blocks", path).select("block", "data")
    blocks = state.count()
    spark_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(spark_parts, -(-total // part_bytes))
    wide = total >= 2**32

    def text_of(b: dict) -> np.ndarray:
        return np.frombuffer(files.read(b["file"]), np.uint8)

    def round_(name: str, ask: Ask, answer: Callable, parts: int, apply: Callable) -> DataFrame:
        """The blocks after a round; what it read is deleted."""
        nonlocal path
        out, answers, _ = exchange(state, ask, answer, parts, apply, STATE, blocks)
        old, path = path, new_folder(spark, name)
        out = stored(out, name, path)
        remove(spark, old)
        remove(spark, answers)
        return out

    # copies: the first of each takes part
    def ask_copies(b: dict) -> list:
        long = np.flatnonzero(b["length"] >= length)
        keys, n = np.unique(b["digest"][long], return_counts=True)
        return dealt(np.array([k.ljust(16, b"\0")[0] % parts for k in keys.tolist()], np.int64), keys, n)

    def apply_copies(b: dict, said: dict, before: dict) -> Iterator[dict]:
        long = np.flatnonzero(b["length"] >= length)
        keys, at = np.unique(b["digest"][long], return_index=True)
        code = returned(ask_copies(b), said, np.uint8)
        copied = np.isin(b["digest"], keys[code > 0]) & (b["length"] >= length)
        text, ends = text_of(b), np.cumsum(b["length"])
        doc, x, last, letter = [], [], [], []
        for d in np.sort(long[at[code != 1]]):
            t = text[ends[d] - b["length"][d] : ends[d]]
            p, l = anchors(t, window, gram)
            h = Digests(t)
            doc.append(np.full(len(p), d, np.int32))
            x.append(p)
            last.append(l)
            letter.append(np.r_[h.of(p[:-1], p[1:]), _U(0)])  # what follows the last anchor is no phrase
        join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        yield {
            "file": b["file"],
            "ids": b["ids"],
            "length": b["length"],
            "copied": copied,
            "doc": join(doc, np.int32),
            "x": join(x, np.int64),
            "last": join(last, np.int64),
            "letter": join(letter, np.uint64),
        }

    state = round_("anchors", ask_copies, answer_owners, spark_parts, apply_copies)

    # letters: phrases that occur twice or more get a name, others are breaks
    def ask_letters(b: dict) -> list:
        keys, n = np.unique(b["letter"][b["letter"] > 0], return_counts=True)
        return dealt(((keys >> _U(32)) * _U(parts) >> _U(32)).astype(np.int64), keys, n)

    def apply_letters(b: dict, said: dict, before: dict) -> Iterator[dict]:
        doc, x, last, letter = b["doc"], b["x"], b["last"], b["letter"]
        keys = np.unique(letter[letter > 0])
        names = returned(ask_letters(b), said, np.int64, before)
        t = np.zeros(len(letter), np.int64)
        t[letter > 0] = names[np.searchsorted(keys, letter[letter > 0])]
        # the anchors that serve a string of full length, and the phrases that each string holds
        opens = np.r_[True, doc[1:] != doc[:-1]] if len(doc) else np.zeros(0, bool)
        start = np.where(opens, 0, np.r_[0, last[:-1] + 1][: len(doc)])
        stop = np.minimum(last, b["length"][doc] - length)
        i = np.flatnonzero(start <= stop)
        line = x + doc.astype(np.int64) * (1 << 40)
        j = np.searchsorted(line, line[i] + reach, "right") - 1
        breaks = np.r_[0, np.cumsum(t == 0)]
        whole = (breaks[j] == breaks[i]) & (j > i)
        i, j = i[whole], j[whole]
        k = np.searchsorted(line, line[i] + near)
        # digests of the prefixes, 32 bits each, and of all bytes about the anchor
        text, ends = text_of(b), np.cumsum(b["length"])
        prefix, about = np.zeros(len(i), np.uint64), np.zeros((len(i), 2), np.uint64)
        for s in np.split(np.arange(len(i)), np.flatnonzero(np.diff(doc[i])) + 1) if len(i) else []:
            d = doc[i[s[0]]]
            own = text[ends[d] - b["length"][d] : ends[d]]
            h = Digests(own)
            short, long = (_both(h.of(x[i[s]], x[end[s]]), end[s] - i[s]) >> _U(32) for end in (k, j))
            prefix[s] = short << _U(32) | long
            place = (x[i[s]] - start[i[s]]) * 1000 + stop[i[s]] - start[i[s]]
            about[s] = _both(wide_digests(own, start[i[s]], stop[i[s]] + length, h), place[:, None])
        # the string: runs of phrases that some prefix needs, with one break between runs
        need = np.zeros(len(t) + 1, np.int64)
        np.add.at(need, i, 1)
        np.add.at(need, j, -1)
        used = np.cumsum(need)[:-1] > 0
        keep = used | np.r_[False, used[:-1]]
        string, place = np.where(used, t, 0)[keep], np.cumsum(keep) - 1
        yield {
            "file": b["file"],
            "ids": b["ids"],
            "length": b["length"],
            "copied": b["copied"],
            "doc": doc[i],
            "x": x[i],
            "start": start[i],
            "stop": stop[i],
            "prefix": prefix,
            "about": about,
            "deep": int((j - i).max(initial=0)),
            "place": place[i],
            "strings": [string],
            "ranks": None,
        }

    state = round_("letters", ask_letters, answer_names, parts, apply_letters)

    def depth(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [load(d) for d in batch.column("data").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([g["deep"] for g in got], pa.int64()), pa.array([len(g["strings"][0]) for g in got], pa.int64())], names=["deep", "n"]
            )

    most = state.mapInArrow(depth, "deep bigint, n bigint").agg(F.max("deep").alias("deep"), F.sum("n").alias("n")).first()
    deep, held = most.deep or 0, most.n or 0
    ways = max(spark_parts, -(-held // (part_bytes // 40)))

    # sort sampled triples and recurse on their names
    level, reached = 0, 1
    while reached < deep:
        cuts = bounds(state, lambda b: _triples(b["strings"][-1], wide), ways, blocks)

        def ask_triples(b: dict, cuts: np.ndarray = cuts) -> list:
            keys, n = np.unique(_triples(b["strings"][-1], wide), return_counts=True)
            return dealt(np.searchsorted(cuts, keys, "right"), keys, n)

        def apply_triples(b: dict, said: dict, before: dict, ask: Ask = ask_triples) -> Iterator[dict]:
            triples = _triples(b["strings"][-1], wide)
            names = returned(ask(b), said, np.int64, before)
            t = names[np.searchsorted(np.unique(triples), triples)]
            ones = len(range(1, len(b["strings"][-1]), 3))
            yield b | {"strings": [*b["strings"], np.r_[t[:ones], 0, t[ones:]]]}

        state = round_("triples", ask_triples, answer_ranks, ways, apply_triples)
        level, reached = level + 1, reached * 3

    # merge the remaining suffixes, from the deepest string up
    def ranks_of(b: dict) -> np.ndarray:
        """Ranks of the sampled suffixes of the last but one string, from those of the last."""
        t, r = b["strings"][-2], b["strings"][-1] if b["ranks"] is None else b["ranks"]
        ones = len(range(1, len(t), 3))
        out = np.zeros(len(t), np.int64)
        out[1::3], out[2::3] = r[:ones], r[ones + 1 :]
        return out

    def answer_merged(got: list[tuple]) -> tuple[list, list[int]]:
        keys, which, _, sizes = _tally(got)
        order = merge_order(numbers(keys, wide))
        rank = np.empty(len(keys), np.int64)
        rank[order] = np.arange(1, len(keys) + 1)
        return _split(rank[which].astype(np.uint32), sizes), [len(keys)]

    head = 16 if wide else 8

    def pairs(b: dict) -> np.ndarray:
        return _prefix(_merge_keys(b["strings"][-2], ranks_of(b), wide), head)

    for _ in range(level - 1):
        cuts = bounds(state, pairs, ways, blocks)

        def ask_merge(b: dict, cuts: np.ndarray = cuts) -> list:
            keys, n = np.unique(_merge_keys(b["strings"][-2], ranks_of(b), wide), return_counts=True)
            return dealt(np.searchsorted(cuts, _prefix(keys, head), "right"), keys, n)

        def apply_merge(b: dict, said: dict, before: dict, ask: Ask = ask_merge) -> Iterator[dict]:
            keys = _merge_keys(b["strings"][-2], ranks_of(b), wide)
            rank = returned(ask(b), said, np.int64, before)
            yield b | {"ranks": rank[np.searchsorted(np.unique(keys), keys)], "strings": b["strings"][:-1]}

        state = round_("merged", ask_merge, answer_merged, ways, apply_merge)

    # the last merge, of the corpus' own suffixes; adjacent ones with the same short prefix hold the groups
    def group_keys(b: dict) -> np.ndarray:
        if len(b["strings"]) == 1:  # nothing was deep enough to be sorted
            keys = _merge_keys(b["strings"][0], np.zeros(len(b["strings"][0]), np.int64), wide)
        else:
            keys = _merge_keys(b["strings"][-2], ranks_of(b), wide)
        keys = keys[b["place"]]
        both = np.concatenate(
            [np.frombuffer(keys.tobytes(), np.uint8).reshape(len(keys), -1), b["prefix"].astype(">u8")[:, None].view(np.uint8)], 1
        ) if len(keys) else np.zeros((0, keys.dtype.itemsize + 8), np.uint8)
        return np.ascontiguousarray(both).view(f"S{both.shape[1]}").ravel()

    lead = head if near > window else head // 2  # a short prefix has at least two letters, or one
    cuts = bounds(state, lambda b: _prefix(group_keys(b), lead), ways, blocks)

    def ask_groups(b: dict) -> list:
        keys, n = np.unique(group_keys(b), return_counts=True)
        return dealt(np.searchsorted(cuts, _prefix(keys, lead), "right"), keys, n)

    def answer_groups(got: list[tuple]) -> tuple[list, list[int]]:
        keys, which, n, sizes = _tally(got)
        raw = np.frombuffer(keys.tobytes(), np.uint8).reshape(len(keys), keys.dtype.itemsize)
        rows = numbers(np.ascontiguousarray(raw[:, :-8]).view(f"S{raw.shape[1] - 8}").ravel(), wide)
        order = merge_order(rows)
        short, long = np.ascontiguousarray(raw[order, -8:]).view(">u4").reshape(-1, 2).T
        interval = np.cumsum(np.r_[True, short[1:] != short[:-1]])
        group = np.empty(len(keys), np.int64)
        group[order] = np.unique(interval << 32 | long, return_inverse=True)[1] + 1
        alone = np.bincount(group, n)[group] < 2
        return _split(np.where(alone, 0, group)[which].astype(np.uint32), sizes), [int(group.max(initial=0))]

    def apply_groups(b: dict, said: dict, before: dict) -> Iterator[dict]:
        keys = group_keys(b)
        group = returned(ask_groups(b), said, np.int64, before)[np.searchsorted(np.unique(keys), keys)] if len(keys) else np.zeros(0, np.int64)
        keep = group > 0
        yield {k: b[k] for k in ("file", "ids", "length", "copied")} | {k: b[k][keep] for k in ("doc", "start", "stop", "about")} | {"group": group[keep]}

    state = round_("groups", ask_groups, answer_groups, ways, apply_groups)

    # same bytes about the anchor: all of its strings are repeated
    def shares(keys: np.ndarray, n: int) -> np.ndarray:
        return ((keys[:, 0] >> _U(32)) * _U(n) >> _U(32)).astype(np.int64)

    def about_keys(b: dict) -> np.ndarray:
        return _both(b["about"], b["group"][:, None])

    def ask_about(b: dict) -> list:
        keys, _, which = distinct(about_keys(b))
        return dealt(shares(keys, ways), keys, np.bincount(which, minlength=len(keys)))

    def apply_about(b: dict, said: dict, before: dict) -> Iterator[dict]:
        _, at, which = distinct(about_keys(b))
        code = returned(ask_about(b), said, np.uint8)
        shown = np.zeros(len(which), bool)
        shown[at[code != 1]] = True  # one of each kind shows its strings to the others of the group
        yield b | {"code": code[which], "shown": shown}

    state = round_("about", ask_about, answer_owners, ways, apply_about)

    # else: each string about the anchor by itself
    tables = max(spark_parts, -(-total // (part_bytes // 5)))

    def strings(b: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keys of the shown strings, their documents and starts."""
        i = np.flatnonzero(b["shown"])
        n = b["stop"][i] - b["start"][i] + 1
        at = np.repeat(b["start"][i], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        doc = np.repeat(b["doc"][i], n)
        keys = np.zeros((len(at), 2), np.uint64)
        text, ends = text_of(b), np.cumsum(b["length"])
        for s in np.split(np.arange(len(at)), np.flatnonzero(np.diff(doc)) + 1) if len(at) else []:
            d = doc[s[0]]
            keys[s] = wide_digests(text[ends[d] - b["length"][d] : ends[d]], at[s], at[s] + length)
        return _both(keys, np.repeat(b["group"][i], n)[:, None]), doc, at

    def ask_strings(b: dict) -> list:
        keys, _, which = distinct(strings(b)[0])
        return dealt(shares(keys, tables), keys, np.bincount(which, minlength=len(keys)))

    def answer_strings(got: list[tuple]) -> tuple[list, list[int]]:
        keys, which, total, sizes = _tally(got)
        return [np.packbits(x) for x in _split(total[which] > 1, sizes)], [len(keys)]

    def apply_strings(b: dict, said: dict, before: dict) -> Iterator[list]:
        keys, doc, at = strings(b)
        keys, _, which = distinct(keys)
        again = np.zeros(len(keys), bool)
        for p, s, _ in dealt(shares(keys, tables), keys):
            again[s] = np.unpackbits(said[p], count=len(s)).astype(bool)
        hit = again[which]
        all_of = b["code"] > 0
        docs = np.r_[b["doc"][all_of], doc[hit]]
        starts, stops = np.r_[b["start"][all_of], at[hit]], np.r_[b["stop"][all_of], at[hit]] + length
        order = np.argsort(docs, kind="stable")
        docs, starts, stops = docs[order], starts[order], stops[order]
        text, ends = text_of(b), np.cumsum(b["length"])
        out = [[], [], [], [], [], []]
        for d, (doc_id, n) in enumerate(zip(b["ids"], b["length"].tolist(), strict=True)):
            t = text[ends[d] - n : ends[d]]
            s = slice(*np.searchsorted(docs, [d, d + 1]))
            if b["copied"][d]:
                gone = np.ones(n, bool)
            else:
                change = np.bincount(starts[s], minlength=n + 1) - np.bincount(stops[s], minlength=n + 1)
                gone = np.cumsum(change)[:n] > 0
            kept = t[~gone].tobytes()
            spans = int((gone & ~np.r_[False, gone[:-1]]).sum())
            for column, value in zip(out, (doc_id, n, int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept if kept_bytes else None), strict=True):
                column.append(value)
        yield out

    return exchange(state, ask_strings, answer_strings, tables, apply_strings, RESULT, blocks)[0]


def op2_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
