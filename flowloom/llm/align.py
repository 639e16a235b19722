"""Cross-tokenizer alignment: which tokens of a byte-level BPE (A) and of a piece BPE (B) cover the same bytes.

Both token sequences of a text are cut at byte offsets where a token of A and one of B end together.
The two sorted lists of ends are merged by merge path: the diagonals i + j = k * PIECE of the merge
grid are searched by bisection, all at once, which gives pieces of equal work that need nothing of
each other; a piece emits its overlaps (token of A, token of B, do both end here), in order of i + j.
An end of A and the equal end of B may fall into two pieces; a piece therefore looks one end of B
further, and the group that is open at the end of a piece is closed by the first cut that follows.

Texts are packed into blocks of about BLOCK tokens with the pairs of ids that each text links. Blocks
then ask table partitions, dealt by the id of A, for the corpus-wide number of documents of their
distinct pairs and whether it is the highest of its id of A (`rounds.exchange`).

Defined cases: null and empty texts, and texts that either side does not give back byte for byte, have
no tokens: all zeros and ''. Every row is a document of its own, repeated rows and null ids too. An
empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from .common import python_batches, stored, table
from .rounds import STATE, dealt, dump, exchange, large, small

#: Steps of a piece of the merge.
PIECE = 1 << 16
#: Tokens of A in a block, about; a longer text is a block of its own.
BLOCK = 1_000_000
#: Distinct pairs that all blocks together ask of a table partition, about.
PART = 1_000_000
#: Pairs that a block asks of a partition, at least.
PACKET = 1000
#: Links that are written out at once; a larger group is worked on by distinct ids.
WIDE = 1 << 20
#: Segments that a worker keeps, besides those of one batch, and the longest that it keeps.
KEPT, SHORT = 400_000, 64
SEGMENT = re.compile(r" +[^ ]*")
RESULT = pa.schema(
    [("doc_id", pa.int64()), *((x, pa.int64()) for x in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")), ("groups_sha256", pa.string())]
)
GROUPS = "doc_id bigint, group_no bigint, start bigint, end bigint, a_ids array<int>, b_ids array<int>"


def default_paths() -> tuple[str, str]:
    """The ranks of A (the vocabulary of byte_bpe_50k.json) and the model of B."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("piece_bpe_32k.model")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


class Pair:
    """Both tokenizers of a worker: ids of texts, and the length in bytes of each id's token."""

    def __init__(self, a_path: str, b_path: str, pattern: str) -> None:
        import sentencepiece
        import tiktoken

        with open(a_path, "rb") as f:
            ranks = {base64.b64decode(x): int(y) for x, y in map(bytes.split, f)}
        self.a = tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a_bytes = [b""] * (max(ranks.values()) + 1)
        for x, i in ranks.items():
            self.a_bytes[i] = x
        names = list(map(self.b.id_to_piece, range(self.b.vocab_size())))
        self.b_bytes = [bytes([int(x[3:5], 16)]) if self.b.is_byte(i) else x.replace("▁", " ").encode() for i, x in enumerate(names)]
        self.a_len, self.b_len = (np.array(list(map(len, x)), np.int64) for x in (self.a_bytes, self.b_bytes))
        # words are pieces' limits unless a piece has a space behind another letter, or spaces are changed
        probe = "a  b \n c  "
        self.split = not any(re.search("[^▁]▁", x) for x in names) and self._whole(self.b.encode(probe)) == (" " + probe).encode()
        self.known: dict[str, bytes] = {}
        # decimal ids, by what follows them in the text of the groups
        self.a_text = [np.array([f"{i}{c}" for i in range(len(self.a_bytes))], object) for c in ",|"]
        self.b_text = [np.array([f"{i}{c}" for i in range(len(self.b_bytes))], object) for c in ",;"]

    def _whole(self, ids: list[int]) -> bytes:
        return b"".join(map(self.b_bytes.__getitem__, ids))

    def encode_b(self, texts: list[str]) -> list[np.ndarray | None]:
        """Ids of each text under B, None where they don't give the text back."""
        if not self.split:
            found = self.b.encode(texts, num_threads=1)
            return [np.array(x, np.int64) if self._whole(x) == (" " + t).encode() else None for t, x in zip(texts, found, strict=True)]
        if len(self.known) > KEPT:
            self.known.clear()
        segments = [SEGMENT.findall(" " + t) for t in texts]
        new = list(set().union(*segments) - self.known.keys())
        ids = self.b.encode([x[1:] for x in new], num_threads=1) if new else []
        # the model adds no space to an empty text: one that ends a text is a piece by itself
        ids = [[self.b.piece_to_id("▁")] if x == " " else i for x, i in zip(new, ids, strict=True)]
        # an empty entry marks a segment that isn't given back
        self.known |= {x: np.array(i, np.uint32).tobytes() if self._whole(i) == x.encode() else b"" for x, i in zip(new, ids, strict=True)}
        out = []
        for s in segments:
            parts = list(map(self.known.__getitem__, s))
            out.append(None if b"" in parts else np.frombuffer(b"".join(parts), np.uint32).astype(np.int64))
        for x in new:
            if len(x) > SHORT:
                del self.known[x]
        return out

    def encode(self, texts: list[str | None]) -> tuple[list[int], list[np.ndarray], list[np.ndarray]]:
        """Places of the texts that have tokens, and their ids under A and B."""
        at = [k for k, t in enumerate(texts) if t]
        b = self.encode_b([texts[k] for k in at])
        at, b = [k for k, x in zip(at, b, strict=True) if x is not None], [x for x in b if x is not None]
        return at, [np.array(self.a.encode_ordinary(" " + texts[k]), np.int64) for k in at], b


@cache
def pair_of(a_path: str, b_path: str, pattern: str) -> Pair:
    return Pair(a_path, b_path, pattern)


def diagonals(a: np.ndarray, b: np.ndarray, piece: int = PIECE) -> np.ndarray:
    """How many ends of A lie before each diagonal of the merge, equal ends of A before those of B."""
    d = np.r_[np.arange(0, len(a) + len(b), piece), len(a) + len(b)]
    low, high = np.maximum(0, d - len(b)), np.minimum(d, len(a))
    while np.any(open_ := low < high):
        mid = (low + high) // 2
        i, j = np.minimum(mid, len(a) - 1), np.clip(d - mid - 1, 0, len(b) - 1)
        right = a[i] <= b[j]  # that end of A comes before: more of A
        low, high = np.where(open_ & right, mid + 1, low), np.where(open_ & ~right, mid, high)
    return np.stack([low, d - low], 1)


def overlaps(a: np.ndarray, b: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A piece's overlaps in order: token of A, token of B, do both end with it."""
    (i0, j0), (i1, j1) = start, end
    # one end of B more than the piece has: it may equal the piece's last end of A
    of_a, of_b = a[i0:i1], b[j0 : min(j1 + 1, len(b))]
    at = np.searchsorted(of_b, of_a)
    both = of_b[np.minimum(at, len(of_b) - 1)] == of_a if len(of_b) else np.zeros(len(of_a), bool)
    under = np.searchsorted(of_a, b[j0:j1])
    alone = np.ones(j1 - j0, bool)
    alone[at[both & (at < j1 - j0)]] = False
    if j0 < j1 and i0 and a[i0 - 1] == b[j0]:
        alone[0] = False  # the piece before has closed this one
    # i + j grows with every overlap, so it is the place of each
    n = i1 - i0 + j1 - j0 + 1
    i, j, cut, there = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, bool), np.zeros(n, bool)
    k = np.arange(i1 - i0)
    i[k + at], j[k + at], cut[k + at], there[k + at] = k, at, both, True
    m = np.flatnonzero(alone)
    i[m + under[m]], j[m + under[m]], there[m + under[m]] = under[m], m, True
    return i[there] + i0, j[there] + j0, cut[there]


def cuts(a: np.ndarray, b: np.ndarray, piece: int = PIECE) -> np.ndarray:
    """Ends of the groups: how many tokens of A and of B lie before each common end."""
    if not len(a):
        return np.zeros((0, 2), np.int64)
    found, limits = [], diagonals(a, b, piece)
    for start, end in zip(limits[:-1], limits[1:], strict=True):
        i, j, cut = overlaps(a, b, start, end)
        found.append(np.stack([i[cut], j[cut]], 1) + 1)
    return np.concatenate(found)


def linked(a: np.ndarray, b: np.ndarray, of: np.ndarray, p: np.ndarray, q: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Links of groups with p and q tokens each, by slices: group's text, id of A, id of B, how often."""
    a0, b0, n = np.cumsum(p) - p, np.cumsum(q) - q, p * q
    for g in np.flatnonzero(n > WIDE):
        (x, nx), (y, ny) = (np.unique(t[s : s + m], return_counts=True) for t, s, m in ((a, a0[g], p[g]), (b, b0[g], q[g])))
        step = max(1, WIDE // len(y))
        for s in range(0, len(x), step):
            u, nu = x[s : s + step], nx[s : s + step]
            yield np.full(len(u) * len(y), of[g]), np.repeat(u, len(y)), np.tile(y, len(u)), np.repeat(nu, len(y)) * np.tile(ny, len(u))
    rest = np.flatnonzero(n <= WIDE)
    total = np.cumsum(n[rest])
    for lot in np.split(rest, np.searchsorted(total, np.arange(WIDE, total[-1] if len(total) else 0, WIDE))):
        if len(lot):
            m = n[lot]
            k = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
            width = np.repeat(q[lot], m)
            yield np.repeat(of[lot], m), a[np.repeat(a0[lot], m) + k // width], b[np.repeat(b0[lot], m) + k % width], np.ones(len(k), np.int64)


class Block:
    """Aligned texts: counts of each, digests of their groups, and their distinct links."""

    def __init__(self, pair: Pair, piece: int = PIECE) -> None:
        self.pair, self.piece = pair, piece
        self.columns: list[list] = [[], [], [], [], [], []]
        self.keys, self.times, self.held, self.tokens = [], [], [], 0

    def add(self, ids: list, texts: list[str | None]) -> None:
        at, a, b = self.pair.encode(texts)
        n = np.zeros((4, len(texts)), np.int64)
        digests, held = [""] * len(texts), np.zeros(len(texts), np.int64)
        if at:
            place, wide = np.array(at), len(self.pair.b_bytes)
            na, nb = np.array(list(map(len, a))), np.array(list(map(len, b)))
            a, b = np.concatenate(a), np.concatenate(b)
            ends = cuts(np.cumsum(self.pair.a_len[a]), np.cumsum(self.pair.b_len[b]), self.piece)
            p, q = np.diff(ends, axis=0, prepend=0).T
            last = np.searchsorted(ends[:, 0], np.cumsum(na)) + 1  # a text's end is an end of both
            of = np.repeat(np.arange(len(at)), np.diff(last, prepend=0))
            n[:, place] = na, nb, np.diff(last, prepend=0), np.bincount(of, p * q, len(at)).astype(np.int64)
            for k, x in zip(at, self.said(a, b, p, q, last), strict=True):
                digests[k] = hashlib.sha256(x.encode()).hexdigest()
            keys, times = [], []
            for t, x, y, m in linked(a, b, of, p, q):
                key = (t * len(self.pair.a_bytes) + x) * wide + y
                key, back, count = np.unique(key, return_inverse=True, return_counts=True)
                keys.append(key)
                times.append(count if m.max() == 1 else np.bincount(back, m).astype(np.int64))
            key, back = np.unique(np.concatenate(keys), return_inverse=True)
            self.times.append(np.bincount(back, np.concatenate(times)).astype(np.int64))
            t, key = np.divmod(key, len(self.pair.a_bytes) * wide)
            self.keys.append(key)
            held[place] = np.bincount(t, minlength=len(at))
            self.tokens += len(a)
        for column, x in zip(self.columns, [ids, *n.tolist(), digests], strict=True):
            column += x
        self.held.append(held)

    def said(self, a: np.ndarray, b: np.ndarray, p: np.ndarray, q: np.ndarray, last: np.ndarray) -> Iterator[str]:
        """The groups of each text as `a1,a2|b1;a3|b2,b3`."""
        def named(x, size, names):
            out = names[0][x]
            final = np.cumsum(size) - 1
            out[final] = names[1][x[final]]
            return out

        words = np.empty(len(a) + len(b), object)
        ga, gb = np.repeat(np.arange(len(p)), p), np.repeat(np.arange(len(q)), q)
        words[np.arange(len(a)) + (np.cumsum(q) - q)[ga]] = named(a, p, self.pair.a_text)
        words[np.arange(len(b)) + np.cumsum(p)[gb]] = named(b, q, self.pair.b_text)
        words = words.tolist()
        ends = (np.cumsum(p) + np.cumsum(q))[last - 1].tolist()
        for start, end in zip([0, *ends[:-1]], ends, strict=True):
            yield "".join(words[start:end])[:-1]

    def packed(self) -> pa.RecordBatch:
        none = [np.zeros(0, np.int64)]
        distinct, which = np.unique(np.concatenate(self.keys or none), return_inverse=True)
        ids, *numbers, digests = self.columns
        state = {
            "ids": ids, "numbers": [small(np.array(x, np.int64)) for x in numbers], "digests": [bytes.fromhex(x) for x in digests],
            "pairs": small(np.diff(distinct, prepend=0)), "which": small(which), "times": small(np.concatenate(self.times or none)),
            "held": small(np.concatenate(self.held or none)),
        }
        columns = [[uuid.uuid4().hex], [dump(state)], [len(distinct)]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.binary(), pa.int64()), strict=True)], names=["block", "data", "n"])


def _rows(docs: DataFrame) -> DataFrame:
    python_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))


def groups(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, pattern: str | None = None, piece: int = PIECE) -> DataFrame:
    """One row a group: doc_id, group_no (from 0), bytes [start, end) of space + text, ids of A and of B."""
    paths = default_paths()
    where = (a_path or paths[0], b_path or paths[1], pattern or default_pattern())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = pair_of(*where)
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            for k, a, b in zip(*pair.encode(texts), strict=True):
                to = np.cumsum(pair.a_len[a])
                ends = cuts(to, np.cumsum(pair.b_len[b]), piece)
                stop = to[ends[:, 0] - 1]
                split = lambda x, at: pa.ListArray.from_arrays(pa.array(np.r_[0, at], pa.int32()), pa.array(x, pa.int32()))
                columns = [pa.array([ids[k]] * len(ends), pa.int64()), pa.array(np.arange(len(ends))), pa.array(np.r_[0, stop[:-1]]), pa.array(stop)]
                yield pa.RecordBatch.from_arrays([*columns, split(a, ends[:, 0]), split(b, ends[:, 1])], names=[x.split()[0] for x in GROUPS.split(", ")])

    return _rows(docs).mapInArrow(run, GROUPS)


def align(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, pattern: str | None = None, piece: int = PIECE, block: int = BLOCK) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for each row."""
    spark, paths = docs.sparkSession, default_paths()
    where = (a_path or paths[0], b_path or paths[1], pattern or default_pattern())
    rows = _rows(docs)
    size = (rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // 4
    most = max(block, int((2 * PACKET * size) ** 0.5))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = Block(pair_of(*where), piece)
        for batch in batches:
            b.add(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist())
            if b.tokens >= most:
                yield b.packed()
                b = Block(b.pair, piece)
        if b.columns[0]:
            yield b.packed()

    packed = stored(rows.mapInArrow(pack, "block string, data binary, n bigint"), "aligned")
    sums = packed.agg(F.count("*").alias("blocks"), F.sum("n").alias("pairs")).first()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(sums.pairs or 0) // max(PART, most)))

    def asked(state: dict) -> list:
        pairs = np.cumsum(large(state["pairs"]))
        n = np.bincount(large(state["which"]), minlength=len(pairs))  # a text has each of its pairs once
        a = (pairs // len(pair_of(*where).b_bytes)).astype(np.uint64)
        part = ((a * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)) % np.uint64(parts)
        return dealt(part.astype(np.int64), pairs, n)

    def ask(state: dict) -> list:
        return [(p, at, (small(np.diff(pairs, prepend=0)), small(n))) for p, at, (pairs, n) in asked(state)]

    def answer(got: list[tuple]) -> tuple[list, list[int]]:
        pairs = [np.cumsum(large(g[0])) for g in got]
        keys, which = np.unique(np.concatenate(pairs), return_inverse=True)
        total = np.bincount(which, np.concatenate([large(g[1]) for g in got])).astype(np.int64)
        a = keys // len(pair_of(*where).b_bytes)
        new = np.r_[True, a[1:] != a[:-1]]
        best = total == np.maximum.reduceat(total, np.flatnonzero(new))[np.cumsum(new) - 1]
        told = np.split(which, np.cumsum(list(map(len, pairs)))[:-1])
        return [(small(total[w]), np.packbits(best[w])) for w in told], [len(keys)]

    def apply(state: dict, said: dict, before: dict) -> Iterator[list]:
        which, times, held = (large(state[k]) for k in ("which", "times", "held"))
        count, best = np.zeros((2, len(state["pairs"])), np.int64)
        for p, at, _ in asked(state):
            count[at], best[at] = large(said[p][0]), np.unpackbits(said[p][1])[: len(at)]
        text = np.repeat(np.arange(len(held)), held)
        total = lambda x: _sums(text, x[which] * times, len(held))
        yield [state["ids"], *map(large, state["numbers"]), total(best), total(count), [x.hex() for x in state["digests"]]]

    return exchange(packed.select("block", "data"), ask, answer, parts, apply, RESULT, sums.blocks)[0]


def _sums(of: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
    """Whole numbers summed by place, exactly."""
    out = np.zeros(n, np.int64)
    if len(of):
        first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
        out[of[first]] = np.add.reduceat(x, first)
    return out


def op11_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents").select("doc_id", "text"))
