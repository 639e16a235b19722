"""SimHash near-dedup with a binary trie self-join.

Distinct fingerprints are read as paths of a binary trie. The join walks pairs of nodes together:
a pair adds a differing bit when its two sides take different branches, and is pruned when the sum
exceeds the Hamming budget. To deal the join over tasks, the 64 bits are cut into blocks; two
fingerprints within the budget agree on at least blocks - budget of them, so for every choice of so
many blocks the chosen ones lead the path and the walk starts at the nodes below a common lead. All
nodes of a task are walked level by level as numpy arrays, in chunks of bounded size.

A task gives a spanning forest of the links that it found (closest first), never all pairs of a
group; links across tasks meet in connected components by alternating large and small stars, each
round written to the shared folder.

Defined cases: null text is empty; a text without words has fingerprint zero, which links like any
other; a row with a null id gets its fingerprint and its group's least id (null if there is none);
repeated rows share a fingerprint; an empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import secrets
from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ARROW_ROWS, LOWER, folder_of, new_folder, python_batches, remove, stored, table

#: Pairs of trie nodes that are walked at once.
CHUNK = 1 << 18
#: Rows of a partition, about, in the walks and where prefixes meet.
PART_ROWS = 1_000_000
#: Shingles that are counted in one task, about; and shingles or sets after which a file of sets is full.
COUNT_ROWS, FILE_ROWS, FILE_SETS = 4_000_000, 2_000_000, 1 << 12
#: Sets that share a shingle: up to so many, each two are noted and compared once, in one place; more are compared where they meet.
FEW = 8
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(LOWER).split()


def shingles(text: str | None, n: int) -> list[bytes]:
    """n-word shingles, repeats included; with fewer words the whole sequence, none without words."""
    ws = words(text)
    if len(ws) <= n:
        return [b" ".join(ws)] if ws else []
    line = b" ".join(ws)
    starts = [0, *accumulate(len(w) + 1 for w in ws)]
    return [line[a : b - 1] for a, b in zip(starts, starts[n:], strict=False)]


def majority(hashes: np.ndarray, weights: np.ndarray | None = None) -> int:
    """The 64 bits that are set in over half of the hashes (of the weight), as an unsigned number."""
    if not len(hashes):
        return 0
    place = hashes.astype(">u8").view(np.uint8).reshape(-1, 8) + np.arange(0, 2048, 256)
    if weights is None:
        held, total = np.bincount(place.ravel(), minlength=2048), len(hashes)
    else:
        held, total = np.bincount(place.ravel(), np.repeat(weights, 8), minlength=2048), weights.sum()
    ones = held.reshape(8, 256) @ _BITS
    return int.from_bytes(np.packbits((2 * ones > total).ravel()).tobytes(), "big")


def fingerprint(text: str | None, n: int = 3) -> int:
    h = xxhash.xxh64_intdigest
    return majority(np.array([h(s, 42) for s in shingles(text, n)], np.uint64))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hashed_sets(texts: list[str], n: int) -> list[np.ndarray]:
    """Each text's set of n-word shingles as sorted 64-bit hashes, made of the hashes of their words; short texts as in shingles()."""
    out: list[np.ndarray] = []
    held: list[list[bytes]] = []
    size = 0

    def close() -> None:
        length = np.array([len(ws) for ws in held])
        word = np.fromiter((xxhash.xxh3_64_intdigest(w) for ws in held for w in ws), np.uint64, int(length.sum()))
        count = np.where(length > 0, np.maximum(length - n + 1, 1), 0)
        ends = np.cumsum(count)
        at = np.arange(int(count.sum())) + np.repeat(np.cumsum(length) - length - ends + count, count)
        width = np.repeat(np.minimum(length, n), count)
        h = width.astype(np.uint64)
        for k in range(n):
            whole = width > k
            grown = mixed(h * np.uint64(0x9E3779B97F4A7C15) + word[np.where(whole, at + k, at)])
            h = np.where(whole, grown, h)
        out.extend(np.unique(x) for x in np.split(h, ends[:-1]))

    for text in texts:
        held.append(words(text))
        size += len(held[-1])
        if size > 200_000:
            close()
            held, size = [], 0
    if held:
        close()
    return out


def fingerprints(docs: DataFrame, n: int = 3) -> DataFrame:
    """doc_id, fp (the fingerprint's 64 bits as a signed long)."""
    python_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.array([fingerprint(t, n) for t in batch.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(made.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id bigint, fp bigint")


def leads(budget: int, blocks: int) -> list[list[tuple[int, int]]]:
    """For each choice of blocks - budget blocks: all blocks as (shift, width), the chosen first."""
    edges = [64 * k // blocks for k in range(blocks + 1)]
    parts = [(64 - edges[k + 1], edges[k + 1] - edges[k]) for k in range(blocks)]
    return [[*(parts[k] for k in chosen), *(p for k, p in enumerate(parts) if k not in chosen)] for chosen in combinations(range(blocks), blocks - budget)]


def turned(fp: np.ndarray, order: list[tuple[int, int]]) -> np.ndarray:
    """Fingerprints with their blocks in another order."""
    out = np.zeros_like(fp)
    for shift, width in order:
        out = (out << np.uint64(width)) | ((fp >> np.uint64(shift)) & np.uint64((1 << width) - 1))
    return out


def trie_pairs(a: np.ndarray, lead: int, budget: int, chunk: int = CHUNK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """a: sorted distinct uint64. Index pairs i < j that agree on the first `lead` bits and differ in at most `budget` others."""
    if not len(a):
        return
    top = a >> np.uint64(64 - lead)
    lo = np.flatnonzero(np.r_[True, top[1:] != top[:-1]])
    hi = np.r_[lo[1:], len(a)]
    many = hi - lo > 1
    lo, hi = lo[many], hi[many]
    stack = [(lead, lo, hi, lo, hi, np.zeros(len(lo), np.int8))]
    while stack:
        depth, lo1, hi1, lo2, hi2, diff = stack.pop()
        if len(lo1) > chunk:
            half = len(lo1) // 2
            stack += [(depth, *(x[s] for x in (lo1, hi1, lo2, hi2, diff))) for s in (slice(None, half), slice(half, None))]
            continue
        alone = (hi1 - lo1 == 1) & (hi2 - lo2 == 1)  # two leaves: the rest of their bits at once
        if alone.any():
            i, j = lo1[alone], lo2[alone]
            near = (i < j) & (np.bitwise_count(a[i] ^ a[j]) <= budget)
            if near.any():
                yield i[near], j[near]
            lo1, hi1, lo2, hi2, diff = (x[~alone] for x in (lo1, hi1, lo2, hi2, diff))
        if not len(lo1) or depth == 64:
            continue
        bit = np.uint64(1) << np.uint64(63 - depth)

        def split(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
            return np.clip(np.searchsorted(a, (a[lo] | bit) & ~(bit - np.uint64(1))), lo, hi)

        mid1, mid2 = split(lo1, hi1), split(lo2, hi2)
        same = lo1 == lo2
        sides = [
            (lo1, mid1, lo2, mid2, diff, None),
            (mid1, hi1, mid2, hi2, diff, None),
            (lo1, mid1, mid2, hi2, diff + 1, None),
            (mid1, hi1, lo2, mid2, diff + 1, ~same),  # of a node with itself, one of the two mixed pairs
        ]
        grown = []
        for l1, h1, l2, h2, d, only in sides:
            keep = (l1 < h1) & (l2 < h2) & (d <= budget) & ~((l1 == l2) & (h1 - l1 == 1))
            if only is not None:
                keep &= only
            grown.append([x[keep] for x in (l1, h1, l2, h2, d)])
        stack.append((depth + 1, *(np.concatenate(x) for x in zip(*grown, strict=True))))


def _forest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """Positions of the pairs (best first) that join two trees."""
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    kept = []
    for k, (x, y) in enumerate(zip(i.tolist(), j.tolist(), strict=True)):
        if (x := root(x)) != (y := root(y)):
            parent[y] = x
            kept.append(k)
    return np.array(kept, np.int64)


class Sets:
    """Shingle sets as sorted 64-bit hashes, in files of the shared folder; a set's place is its file's number and its number there."""

    HELD = 64 << 20

    def __init__(self, spark: SparkSession) -> None:
        self.folder = new_folder(spark, "sets")
        self.heads: dict[int, np.ndarray] = {}
        self.memo: dict[int, np.ndarray] = {}
        self.held = 0

    def write(self, nodes: np.ndarray, sets: list[np.ndarray]) -> int:
        """The new file's number. A file: how many, their nodes, their ends, their hashes."""
        if len(sets) > FILE_SETS:
            raise ValueError(f"over {FILE_SETS} sets for a file")
        store, root = folder_of(self.folder)
        store.create_dir(root, recursive=True)
        number = secrets.randbits(50)
        with store.open_output_stream(f"{root}/{number}") as out:
            out.write(np.r_[len(sets), nodes, np.cumsum([len(x) for x in sets])].astype("<i8").tobytes())
            out.write(np.concatenate(sets).astype("<u8").tobytes())
        return number

    def file(self, number: int) -> tuple[np.ndarray, list[np.ndarray]]:
        """Nodes and sets of a file."""
        store, root = folder_of(self.folder)
        with store.open_input_stream(f"{root}/{number}") as stream:
            data = stream.read()
        n = int(np.frombuffer(data, "<i8", 1)[0])
        head = np.frombuffer(data, "<i8", 2 * n, 8)
        return head[:n], np.split(np.frombuffer(data, "<u8", -1, 8 + 16 * n), head[n:-1])

    def tokens(self, number: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Nodes and sizes of a file's sets; all their shingles, and which set each is of. A set without shingles has the one name 0."""
        nodes, held = self.file(number)
        size = np.array([len(x) for x in held])
        return nodes, size, np.concatenate([x if len(x) else np.zeros(1, np.uint64) for x in held]), np.repeat(np.arange(len(held)), np.maximum(size, 1))

    def get(self, place: int) -> np.ndarray:
        got = self.memo.get(place)
        if got is None:
            number, k = divmod(place, FILE_SETS)
            store, root = folder_of(self.folder)
            with store.open_input_file(f"{root}/{number}") as f:
                if number not in self.heads:
                    n = int(np.frombuffer(f.read_at(8, 0), "<i8")[0])
                    self.heads[number] = np.r_[0, np.frombuffer(f.read_at(8 * n, 8 + 8 * n), "<i8")]
                    self.held += self.heads[number].nbytes
                ends = self.heads[number]
                got = np.frombuffer(f.read_at(8 * int(ends[k + 1] - ends[k]), 8 + 16 * (len(ends) - 1) + 8 * int(ends[k])), "<u8")
            self.held += got.nbytes
            if self.held > self.HELD:
                self.memo.clear()
                self.heads.clear()
                self.held = got.nbytes
            self.memo[place] = got
        return got


class Verified:
    """Groups of sets under links that hold exactly: no link joins two groups before its sets are compared, and none that holds is left out."""

    def __init__(self, sets: Sets, similarity: float, place: np.ndarray, size: np.ndarray) -> None:
        self.sets, self.similarity, self.place, self.size = sets, similarity, place, size.astype(float)
        self.parent = np.arange(len(place))
        self.failed: set[tuple[int, int]] = set()
        self.kept: list[tuple[int, int]] = []

    def root(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = x = self.parent[self.parent[x]]
        return int(x)

    def groups(self) -> np.ndarray:
        while (self.parent[self.parent] != self.parent).any():
            self.parent = self.parent[self.parent]
        return self.parent

    def may(self, x: np.ndarray | int, y: np.ndarray) -> np.ndarray:
        """Sizes that leave the similarity possible."""
        a, b = self.size[x], self.size[y]
        return np.minimum(a, b) >= self.similarity * np.maximum(a, b) - 1e-9

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        """Links of i[k] and j[k]."""
        group = self.groups()
        go = (group[i] != group[j]) & self.may(i, j)
        for x, y in zip(i[go].tolist(), j[go].tolist(), strict=True):
            self.pair(x, y)

    def pair(self, x: int, y: int) -> None:
        p, q = self.root(x), self.root(y)
        key = (x, y) if x < y else (y, x)
        if p == q or key in self.failed:
            return
        a, b = self.sets.get(int(self.place[x])), self.sets.get(int(self.place[y]))
        both = len(np.intersect1d(a, b, assume_unique=True))
        if both >= self.similarity * (len(a) + len(b) - both):
            self.parent[q] = p
            self.kept.append((x, y))
            return
        if len(self.failed) >= 1 << 20:
            self.failed.clear()
        self.failed.add(key)


def parts_for(spark: SparkSession, rows: int, each: int | None = None) -> int:
    """Partitions that hold PART_ROWS rows each, about (or another number): a task's memory does not grow with the corpus."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // (each or PART_ROWS)))


def links(prints: DataFrame, budget: int, blocks: int | None = None) -> DataFrame:
    """prints: node, prints (array of fingerprints; two nodes link if one of them is within the budget).

    Returns a, b, bits (summed over all the fingerprints): spanning forests of the links, closest first.
    """
    blocks = blocks or budget + 1
    orders = leads(budget, blocks)
    tables = prints.select(F.max(F.size("prints"))).first()[0] or 0
    width = [sum(w for _, w in o[: blocks - budget]) for o in orders]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            node = batch.column("node")
            each = np.array(batch.column("prints").to_pylist(), np.int64).view(np.uint64)
            for t in range(each.shape[1]):
                for r, order in enumerate(orders):
                    lead = turned(each[:, t], order) >> np.uint64(64 - width[r])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(each), t * len(orders) + r, np.int32)), pa.array(lead.view(np.int64)), node, batch.column("prints")],
                        names=["path", "lead", "node", "prints"],
                    )

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        path, node = (np.concatenate([b.column(c).to_numpy() for b in got]) for c in ("path", "node"))
        each = np.concatenate([b.column("prints").flatten().to_numpy().reshape(b.num_rows, -1) for b in got]).view(np.uint64)
        ids, place = np.unique(node, return_inverse=True)
        found_i, found_j = [], []
        for p in np.unique(path):
            rows = np.flatnonzero(path == p)
            order = orders[p % len(orders)]
            value = turned(each[rows, p // len(orders)], order)
            ranked = np.argsort(value, kind="stable")
            rows, value = rows[ranked], value[ranked]
            starts = np.flatnonzero(np.r_[True, value[1:] != value[:-1]])
            first = np.repeat(starts, np.diff(np.r_[starts, len(value)]))
            alike = np.flatnonzero(first != np.arange(len(value)))  # equal fingerprints of different nodes: each to the first
            found_i.append(rows[first[alike]])
            found_j.append(rows[alike])
            for i, j in trie_pairs(value[starts], width[p % len(orders)], budget):
                found_i.append(rows[starts[i]])
                found_j.append(rows[starts[j]])
        i, j = np.concatenate(found_i), np.concatenate(found_j)
        if not len(i):
            return
        bits = np.bitwise_count(each[i] ^ each[j]).sum(1, dtype=np.int32)
        best = np.argsort(bits, kind="stable")
        i, j, bits = i[best], j[best], bits[best]
        kept = _forest(place[i], place[j], len(ids))
        a, b = node[i[kept]], node[j[kept]]
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(bits[kept])], names=["a", "b", "bits"])

    dealt = prints.select("node", "prints").mapInArrow(deal, "path int, lead bigint, node bigint, prints array<bigint>")
    parts = parts_for(prints.sparkSession, prints.count() * len(orders) * tables)
    return dealt.repartition(parts, "path", "lead").mapInArrow(walk, "a bigint, b bigint, bits int").distinct()


def by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """Rows that lie sorted by their first column: its values, each with the other columns' rows."""
    at, got = None, []
    for batch in batches:
        for key, *columns in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if key != at:
                if got:
                    yield at, got
                at, got = key, []
            got.append(columns)
    if got:
        yield at, got


def by_part(token: np.ndarray, parts: int) -> list[tuple[int, np.ndarray]]:
    """Each part that has shingles, and their places."""
    part = ((token * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(parts)).astype(np.min_scalar_type(parts))
    order = np.argsort(part, kind="stable")
    return [(int(part[g[0]]), g) for g in np.split(order, np.flatnonzero(np.diff(part[order])) + 1) if len(g)]


def levels(token: np.ndarray) -> np.ndarray:
    """How common each of some shingles is among them, in a byte: 0 for one that is there once, more for more."""
    value, n = np.unique(token, return_counts=True)
    value, n = value[n > 1], n[n > 1]
    if not len(value):
        return np.zeros(len(token), np.uint8)
    level = np.where(n <= 128, n - 1, 120 + np.floor(np.log2(n))).astype(np.uint8)
    at = np.minimum(np.searchsorted(value, token), len(value) - 1)
    return np.where(value[at] == token, level[at], 0).astype(np.uint8)


def prefix_links(files: DataFrame, sets: Sets, similarity: float) -> DataFrame:
    """a, b: links of sets that have the similarity, enough to join all those that such pairs join. files: file, tokens, prefix.

    In any order of shingles that all sets have in common, two such sets of s and r shingles share one of
    the first s - ceil(similarity s) + 1 and r - ceil(similarity r) + 1. Rare shingles come first, then by
    hash: all of them are counted once, so a prefix is mostly shingles that no other set holds, and those
    are not dealt. Counts are of 32 bits of a shingle in its part: one that shares them with another counts
    as more common, which changes the work only. Files are dealt to tasks one by one, and their shingles,
    packed, by hash.
    """
    spark = files.sparkSession
    n_files, tokens, prefix = (x or 0 for x in files.agg(F.count("*"), F.sum("tokens"), F.sum("prefix")).first())
    n_files = max(1, n_files)
    counted = parts_for(spark, tokens, COUNT_ROWS)
    parts = parts_for(spark, prefix)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number in batch.column("file").to_pylist():
                token = sets.tokens(number)[2]
                rows = [(part, number, token[g].astype("<u4").tobytes()) for part, g in by_part(token, counted)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.binary()), strict=True)], names=["part", "file", "token"]
                )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in by_key(batches):
            held = [np.frombuffer(r[1], "<u4") for r in rows]
            told = np.split(levels(np.concatenate(held)), np.cumsum([len(x) for x in held])[:-1])
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array([part] * len(rows), pa.int32()), pa.array([x.tobytes() for x in told], pa.binary())],
                names=["file", "part", "level"],
            )

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, told in by_key(batches):
            nodes, size, token, of = sets.tokens(number)
            level, said = np.zeros(len(token), np.uint8), dict(told)
            for part, g in by_part(token, counted):
                level[g] = np.frombuffer(said[part], np.uint8)
            alone = np.bincount(of[level == 0], minlength=len(size))  # these come first
            shared = np.flatnonzero(level)
            shared = shared[np.lexsort((token[shared], level[shared], of[shared]))]
            many = np.bincount(of[shared], minlength=len(size))
            rank = np.arange(len(shared)) + np.repeat(alone - np.cumsum(many) + many, many)
            long = np.maximum(size - np.ceil(similarity * size - 1e-9).astype(int) + 1, 1)
            shared, rank = (x[rank < long[of[shared]]] for x in (shared, rank))
            which = of[shared]
            columns = token[shared], nodes[which], number * FILE_SETS + which, size[which].astype(np.int32), rank.astype(np.int32)
            rows = [(part, *(c[g].tobytes() for c in columns)) for part, g in by_part(token[shared], parts)]
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), *[pa.binary()] * 5), strict=True)],
                    names=["part", "token", "node", "place", "size", "rank"],
                )

    pair = ["a", "b", "place_a", "place_b", "size_a", "size_b"]

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in by_key(batches):
            token, node, place, size, rank = (np.concatenate([np.frombuffer(r[k], t) for r in rows]) for k, t in enumerate(("<u8", "<i8", "<i8", "<i4", "<i4")))
            order = np.lexsort((rank, token))
            starts = np.flatnonzero(np.r_[True, np.diff(token[order]) != 0])
            many = np.diff(np.r_[starts, len(order)])
            order, many = order[np.repeat(many > 1, many)], many[many > 1]
            if not len(order):
                continue
            node, place, size, rank = node[order], place[order], size[order], rank[order]
            ids, at, local = np.unique(node, return_index=True, return_inverse=True)
            exact = Verified(sets, similarity, place[at], size[at])
            left = (size - rank).astype(float)  # shingles from this one on: what two sets share at most if they first meet here
            noted = [np.zeros((0, 2), np.int64)]

            def met(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
                meets = np.minimum(left[i], left[j]) >= similarity / (1 + similarity) * (size[i].astype(float) + size[j]) - 1e-6
                meets |= size[i] == 0
                return local[i[meets]], local[j[meets]]

            starts = np.cumsum(many) - many
            for m in range(2, FEW + 1):
                for x, y in combinations(range(m), 2):
                    i, j = met(starts[many == m] + x, starts[many == m] + y)
                    may = exact.may(i, j)
                    noted.append(np.unique(np.sort(np.stack([i[may], j[may]], 1), axis=1), axis=0))
            for a, m in zip(starts[many > FEW].tolist(), many[many > FEW].tolist(), strict=True):
                for k in range(a, a + m - 1):
                    group = exact.groups()[local[a : a + m]]
                    if (group == group[0]).all():
                        break
                    exact.join(*met(np.full(a + m - k - 1, k), np.arange(k + 1, a + m)))
            for found, new in ((np.array(exact.kept, np.int64).reshape(-1, 2), False), (np.unique(np.concatenate(noted), axis=0), True)):
                a, b = np.sort(found, axis=1).T
                columns = ids[a], ids[b], *(exact.place[x] if new else np.full(len(x), -1) for x in (a, b)), *(size[at][x] for x in (a, b))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=pair)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs that were compared already, and a forest of the others that hold."""
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        a, b, place_a, place_b, size_a, size_b = (np.concatenate([x.column(c).to_numpy() for x in got]) for c in pair)
        done = place_a < 0
        yield pa.RecordBatch.from_arrays([pa.array(a[done]), pa.array(b[done])], names=["a", "b"])
        a, b, place_a, place_b, size_a, size_b = (x[~done] for x in (a, b, place_a, place_b, size_a, size_b))
        ids, at, local = np.unique(np.r_[a, b], return_index=True, return_inverse=True)
        exact = Verified(sets, similarity, np.r_[place_a, place_b][at], np.r_[size_a, size_b][at])
        order = np.lexsort((b, a))
        exact.join(local[: len(a)][order], local[len(a) :][order])
        a, b = np.sort(ids[np.array(exact.kept, np.int64).reshape(-1, 2)], axis=1).T
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    # without keys, a file's number goes to the next task: few bytes, which adaptive execution would else join to one task's
    asked = files.select("file").repartition(n_files).mapInArrow(ask, "part int, file bigint, token binary")
    told = asked.repartition(counted, "part").sortWithinPartitions("part").mapInArrow(count, "file bigint, part int, level binary")
    dealt = told.repartition(n_files, "file").sortWithinPartitions("file").mapInArrow(deal, "part int, token binary, node binary, place binary, size binary, rank binary")
    found = dealt.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(meet, ", ".join(f"{c} bigint" for c in pair))
    once = found.groupBy("a", "b").agg(*(F.min(c).alias(c) for c in pair[2:]))  # -1: compared where they met
    return once.repartition(parts, "a").mapInArrow(compare, "a bigint, b bigint")


def components(pairs: DataFrame, rounds: int = 60) -> DataFrame:
    """node, root (the least node reachable) for every node of the pairs, by large and small stars. A round's table is deleted once the next is written."""
    spark = pairs.sparkSession

    def written(df: DataFrame, *old: str) -> tuple[DataFrame, str]:
        path = new_folder(spark, "edges")
        df = stored(df.distinct(), "edges", path)
        for x in old:
            remove(spark, x)
        return df, path

    edges, at = written(pairs.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")))

    def mark(e: DataFrame) -> tuple:
        r = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        return r.n, r.h

    before = mark(edges)
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large, half = written(
            both.where(F.col("v") > F.col("u")).join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")), at
        )
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where(F.col("v") != F.col("m")).select(
            F.col("v").alias("u"), F.col("m").alias("v")
        ).unionByName(least.select("u", F.col("m").alias("v")))
        edges, at = written(small, half)
        if (now := mark(edges)) == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )


def groups(docs: DataFrame, n: int = 3, budget: int = 2, blocks: int | None = None) -> DataFrame:
    """doc_id, fp, component_id: documents linked, directly or through others, by fingerprints within the budget."""
    prints = stored(fingerprints(docs, n), "prints")
    nodes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    roots = components(links(nodes.select(F.col("fp").alias("node"), F.array("fp").alias("prints")), budget, blocks))
    placed = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(placed.join(least, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = groups(table(spark, sf_dir, "documents").select("doc_id", "text"), n=3, budget=2)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near(docs: DataFrame, n: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs with one document (the least id) of each group of near copies; all columns stay.

    Near copies have n-word shingle sets of Jaccard similarity 0.8 or more, as lower-cased words. At
    that similarity fingerprints of 5-word shingles differ in ten bits on average, which no trie walk
    can prune, and other fingerprints miss passages added, cut or replaced. Prefixes of the shingle sets
    find all pairs. Every link is verified on the shingle sets (64-bit hashes) before forests are built.
    Rows with a null id stay.
    """
    python_batches(docs.sparkSession)
    rows = docs.select(
        F.struct("*").alias("row"), F.col("doc_id").cast("bigint").alias("id_"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text_")
    )
    ids = rows.where(F.col("id_").isNotNull())
    copies = stored(
        ids.groupBy(F.sha2(F.lower("text_"), 256).alias("key"), F.length("text_").alias("size")).agg(F.min("id_").alias("node")).select("node"), "copies"
    )
    texts = ids.join(
        copies, ids["id_"] == copies["node"], "left_semi"
    ).groupBy("id_").agg(F.min("text_").alias("text")).select(F.col("id_").alias("node"), "text")

    sets = Sets(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes: list[np.ndarray] = []
        held: list[np.ndarray] = []

        def close() -> pa.RecordBatch:
            size = np.array([len(x) for x in held])
            number = sets.write(np.concatenate(nodes), held)
            long = int((size - np.ceil(similarity * size - 1e-9).astype(int) + 1).sum())
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in (number, int(np.maximum(size, 1).sum()), long)], names=["file", "tokens", "prefix"])

        for batch in batches:
            for k in range(0, batch.num_rows, ARROW_ROWS):
                part = batch.slice(k, ARROW_ROWS)
                if held and len(held) + part.num_rows > FILE_SETS:
                    yield close()
                    nodes, held = [], []
                nodes.append(part.column("node").to_numpy())
                held += hashed_sets(part.column("text").to_pylist(), n)
                if sum(map(len, held)) > FILE_ROWS:
                    yield close()
                    nodes, held = [], []
        if held:
            yield close()

    path = new_folder(docs.sparkSession, "files")
    files = stored(texts.mapInArrow(run, "file bigint, tokens bigint, prefix bigint"), "files", path)
    roots = components(prefix_links(files, sets, similarity))
    for done in (path, sets.folder):  # the links are written by now
        remove(docs.sparkSession, done)
    gone = roots.where(F.col("node") != F.col("root")).select("node")
    kept = copies.join(gone, "node", "left_anti")
    first = rows.where(F.col("id_").isNotNull()).join(kept, F.col("id_") == F.col("node"), "left_semi").select("row")
    return first.unionByName(rows.where(F.col("id_").isNull()).select("row")).select("row.*")
