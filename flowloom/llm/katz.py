"""Language-model scores by Katz backoff, over word bigrams.

Counts of one to CUT are discounted by Good and Turing; what a context's bigrams leave is spread over
all other words by backoff weights, (1 - sum of kept probabilities) / (1 - sum of the same words'
lower-order probabilities), so every context sums to exactly one. The last level is one class for all
unknown words, which has the mass that discounting the words left. All bigrams are kept, those seen
once too.

Texts are packed into blocks of about BLOCK tokens, each token a number into the block's word list.
Block texts are files in the shared folder (pyarrow.fs), rows hold their names. In a first round a
block asks table partitions (ranges of 64-bit word hashes) for its words, with its own training
counts, and is told their counts and numbers. In a second round it asks the partitions of bigrams,
which are dealt by context; they add up the counts of all blocks, and tell for each bigram its count
and for each context what its weight is made of: the discounted mass that is kept and the lower-order
mass of the same words. A context that occurs more than HOT times is cut by a hash of the word, and
its parts are added up. Blocks are then scored token by token: bigram, else weight and word, else
weight and unknown class. What lies in the shared
folder are the partitions' answers, packed by block: for each bigram its count, for each context the sums
of its weight. There is no table of single n-grams, and the order is two.

Blocks and partitions grow with the square root of the corpus beyond about a billion tokens, so that
what a block asks of a partition stays at PACKET keys or more; a task's memory grows with them.

Defined cases: null and empty texts hold one token, the end. Rows with a null id are scored, are
held out of learning and keep their null. Repeated rows count and are scored as often as they
occur. Without training rows, every token is of the unknown class with probability one (score 0).
An empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, Files, fold, python_batches, remove, stored, table
from .rounds import STATE, dealt, dump, exchange, large, load, small

#: Tokens of a block, about; a longer text is a block of its own.
BLOCK = 2_000_000
#: Entries of a table partition, about.
PART = 1_000_000
#: Keys that a block asks of a table partition, at least.
PACKET = 1000
#: Training tokens of a context beyond which it is cut.
HOT = 1_000_000
#: Counts above this are not discounted.
CUT = 5
#: Words hold no white space, so these names are free.
START, END = b" start", b" end"
RESULT = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_tokens", pa.int64()),
        ("n_known", pa.int64()),
        ("train_tokens", pa.int64()),
        ("base_score", pa.float64()),
        ("score", pa.float64()),
    ]
)


def word_hash(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word)


_START = np.uint64(word_hash(START))
_U = np.uint64


class Block:
    """Documents as numbers into a list of words, which are in order of their hashes."""

    def __init__(self, words: np.ndarray, tokens: np.ndarray, ids: list, train: np.ndarray, lengths: np.ndarray) -> None:
        order = np.argsort(words)
        rank = np.empty(len(words), np.int64)
        rank[order] = np.arange(len(words))
        self.words, self.tokens, self.ids, self.train, self.lengths = words[order], rank[tokens], ids, train, lengths
        self.start = int(np.searchsorted(self.words, _START))

    def word_counts(self) -> np.ndarray:
        """Training counts; of the start, training documents."""
        count = np.bincount(self.tokens, np.repeat(self.train, self.lengths), minlength=len(self.words)).astype(np.int64)
        count[self.start] = self.train.sum()
        return count

    def bigrams(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Contexts and words of the distinct bigrams, in order, their training counts, and each token's bigram."""
        before = np.empty_like(self.tokens)
        before[1:] = self.tokens[:-1]
        before[np.r_[0, np.cumsum(self.lengths)[:-1]]] = self.start
        keys, which = np.unique(before << 32 | self.tokens, return_inverse=True)
        count = np.bincount(which, np.repeat(self.train, self.lengths), minlength=len(keys)).astype(np.int64)
        return keys >> 32, keys & 0xFFFFFFFF, count, which


def encode(docs: DataFrame, files: Files, size: int) -> DataFrame:
    """block, data (the name of its file), n (tokens), from doc_id, train, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def fresh() -> tuple:
            return {START: 0, END: 1}, [], [], [], []

        def close() -> pa.RecordBatch:
            words = np.array([word_hash(w) for w in number], np.uint64)
            name = files.write(dump((words, small(np.array(tokens, np.int64)), ids, np.array(train, np.int8), np.array(lengths, np.int64))))
            return pa.RecordBatch.from_arrays(
                [pa.array([name]), pa.array([dump({"file": name})], pa.binary()), pa.array([len(tokens)], pa.int64())], names=["block", "data", "n"]
            )

        number, tokens, ids, train, lengths = fresh()
        for batch in batches:
            for doc_id, learns, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "train", "text")), strict=True):
                new = (text or "").encode().translate(LOWER).split()
                tokens += [number.setdefault(w, len(number)) for w in new]
                tokens.append(1)
                ids.append(doc_id)
                train.append(bool(learns))
                lengths.append(len(new) + 1)
                if len(tokens) >= size:
                    yield close()
                    number, tokens, ids, train, lengths = fresh()
        if ids:
            yield close()

    return docs.mapInArrow(run, "block string, data binary, n bigint")


class Asked:
    """How a block's bigrams are dealt: part and order of the bigrams, and the contexts that each partition is asked about."""

    def __init__(self, u: np.ndarray, w: np.ndarray, count: np.ndarray, ids: np.ndarray, parts: int, most: int) -> None:
        def part_of(u: np.ndarray, cut: np.ndarray) -> np.ndarray:
            x = _U(0x9E3779B97F4A7C15) * ids[u].astype(np.uint64) + cut.astype(np.uint64)
            x = (x ^ (x >> _U(29))) * _U(0xBF58476D1CE4E5B9)
            return ((x >> _U(33)) % _U(parts)).astype(np.int64)

        cuts = 1 + count // most
        part = part_of(u, (ids[w].astype(np.uint64) * _U(0x94D049BB133111EB) >> _U(33)).astype(np.int64) % cuts[u])
        self.order = np.argsort(part, kind="stable")
        hot = np.unique(u[cuts[u] > 1])  # all parts of these are asked, whether or not they hold a bigram of the block
        every = np.repeat(hot, cuts[hot])
        slot = np.arange(len(every)) - np.repeat(np.cumsum(cuts[hot]) - cuts[hot], cuts[hot])
        wide = np.int64(len(ids) + 1)
        held = part[self.order] * wide + u[self.order]
        context = np.unique(np.r_[held, part_of(every, slot) * wide + every])
        self.runs = np.searchsorted(held, context, "right") - np.searchsorted(held, context)
        self.context, where = context % wide, context // wide
        self.parts = np.unique(where)
        self.context_ends = np.searchsorted(where, self.parts, "right")
        self.ends = np.searchsorted(part[self.order], self.parts, "right")

    def each(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Partition, its bigrams' places, its contexts, the lengths of their runs."""
        a = b = 0
        for p, e, c in zip(self.parts.tolist(), self.ends.tolist(), self.context_ends.tolist(), strict=True):
            yield p, self.order[a:e], self.context[b:c], self.runs[b:c]
            a, b = e, c


def discounts(n: dict[int, int], cut: int = CUT) -> dict[int, float]:
    """Katz's ratios for counts 1 to cut, from counts of counts; half an occurrence is taken where they are no proper ratios."""
    out = {}
    for r in range(1, cut + 1):
        half = (r - 0.5) / r
        if n.get(1) and n.get(r) and n.get(r + 1):
            common = (cut + 1) * n.get(cut + 1, 0) / n[1]
            d = ((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common) if common < 1 else half
        else:
            d = half
        out[r] = d if 0 < d <= 1 else half
    return out


def _few(counts: np.ndarray) -> list[int]:
    """How many counts are 1, 2, ... CUT + 1."""
    return np.bincount(np.minimum(counts, CUT + 2), minlength=CUT + 3)[1 : CUT + 2].tolist()


def sizes(tokens: int) -> tuple[int, int]:
    """Tokens of a block and entries of a table partition: half a block's tokens are distinct pairs, dealt over tokens / entries partitions."""
    root = int((2 * PACKET * tokens) ** 0.5)
    return max(BLOCK, root), max(PART, root)


def score(docs: DataFrame, train: Column, hot: int = HOT) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score. train: which rows are learned from."""
    spark = docs.sparkSession
    python_batches(spark)
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), (train & F.col("doc_id").isNotNull()).alias("train"), F.col("text").cast("string").alias("text")
    )
    files = Files(spark, "texts")
    guess = (rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // 5
    packed = stored(encode(rows, files, sizes(guess)[0]), "blocks")
    size = packed.agg(F.count("*").alias("blocks"), F.sum("n").alias("tokens")).first()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(size.tokens or 0) // sizes(size.tokens or 0)[1]))

    def block(b: dict) -> Block:
        words, tokens, ids, learns, lengths = load(files.read(b["file"]))
        return Block(words, large(tokens), ids, learns, lengths)

    # words: counts and numbers, in order of hash
    def ask_words(b: dict) -> list:
        t = block(b)
        return dealt(((t.words >> _U(32)) * _U(parts) >> _U(32)).astype(np.int64), t.words, small(t.word_counts()))

    def answer_words(got: list[tuple]) -> tuple[list, list[int]]:
        keys, which = np.unique(np.concatenate([g[0] for g in got]), return_inverse=True)
        total = np.bincount(which, np.concatenate([large(g[1]) for g in got]), minlength=len(keys)).astype(np.int64)
        real = total[(keys != _START) & (total > 0)]
        ends = np.cumsum([len(g[0]) for g in got])[:-1]
        out = [(small(total[w]), small(np.diff(w, prepend=0))) for w in np.split(which, ends)]
        return out, [len(keys), len(real), int(real.sum()), int(real[real > CUT].sum()), *_few(real)]

    def apply_words(b: dict, said: dict, before: dict) -> Iterator[dict]:
        """Words and partitions are both in order of hash."""
        told = [said[p] for p in sorted(said)]
        ids = np.concatenate([np.cumsum(large(t[1])) + before[p] for p, t in zip(sorted(said), told, strict=True)])
        yield b | {"count": small(np.concatenate([large(t[0]) for t in told])), "ids": small(np.diff(ids, prepend=0))}

    known, answers, sums = exchange(packed.select("block", "data"), ask_words, answer_words, parts, apply_words, STATE, size.blocks)
    state = stored(known, "words")
    remove(spark, answers)
    kinds, total, often, *few = sums.tolist()[1:] if size.blocks else [0, 0, 0]
    d1 = discounts(dict(enumerate(few, 1)))
    cut = np.array([0.0, *(d1[r] for r in range(1, CUT + 1)), 1.0])
    # the words' mass: what discounting leaves is the unknown class's, and there is always some
    mass = often + sum(d1[r] * r * n for r, n in zip(range(1, CUT + 1), few, strict=False))
    shrink = total / (total + 1) if total and 1 - mass / total < 1e-12 else 1.0
    unknown = 1 - shrink * mass / total if total else 1.0
    lower = shrink / total if total else 0.0  # probability of a word: lower * its discounted count

    def pairs(b: dict) -> tuple[Block, np.ndarray, np.ndarray, tuple, Asked]:
        t, count, ids = block(b), large(b["count"]), np.cumsum(large(b["ids"]))
        found = t.bigrams()
        return t, count, ids, found, Asked(found[0], found[1], count, ids, parts, hot)

    def ask_pairs(b: dict) -> list:
        _, count, ids, (_, w, n, _), asked = pairs(b)
        return [
            (p, at, (small(np.diff(ids[u], prepend=0)), small(runs), small(ids[w[at]]), small(n[at]), small(count[w[at]])))
            for p, at, u, runs in asked.each()
        ]

    def answer_pairs(got: list[tuple]) -> tuple[list, list[int]]:
        contexts = [np.cumsum(large(g[0])) for g in got]
        u = np.concatenate([np.repeat(c, large(g[1])) for c, g in zip(contexts, got, strict=True)])
        w, n, c1 = (np.concatenate([large(g[k]) for g in got]) for k in (2, 3, 4))
        order = np.lexsort((w, u))
        new = np.r_[True, (u[order][1:] != u[order][:-1]) | (w[order][1:] != w[order][:-1])][: len(order)]
        which = np.empty(len(u), np.int64)
        which[order] = np.cumsum(new) - 1
        first = order[new]
        c2 = np.bincount(which, n, minlength=len(first)).astype(np.int64)
        # for each context: how many of its bigrams were seen once, twice, ..., all tokens of the others, and the lower-order mass of all
        held = np.unique(np.concatenate(contexts))
        of = np.searchsorted(held, u[first])
        seen, c1 = c2 > 0, c1[first]
        below = np.bincount(of[seen], lower * (cut[np.minimum(c1, CUT + 1)] * c1)[seen], minlength=len(held))
        tally = [np.bincount(of[c2 == r], minlength=len(held)) for r in range(1, CUT + 1)]
        tally.append(np.bincount(of[c2 > CUT], c2[c2 > CUT], minlength=len(held)).astype(np.int64))
        out, at = [], 0
        for c, g in zip(contexts, got, strict=True):
            k, m = np.searchsorted(held, c), len(g[2])
            out.append((small(c2[which[at : at + m]]), below[k], [small(x[k]) for x in tally]))
            at += m
        return out, [len(first), *_few(c2[seen])]

    def apply_pairs(b: dict, said: dict, before: dict) -> Iterator[list]:
        t, count, _, (u, w, _, which), asked = pairs(b)
        d2 = discounts(dict(enumerate(before[-2].tolist()[1:], 1)))
        cut2 = np.array([0.0, *(d2[r] for r in range(1, CUT + 1)), 1.0])
        c2, kept, below = np.zeros(len(u), np.int64), np.zeros(len(count)), np.zeros(len(count))
        for p, at, context, _ in asked.each():
            told, under, tally = said[p]
            c2[at] = large(told)
            below[context] += under
            kept[context] += large(tally[-1]) + sum(d2[r] * r * large(x) for r, x in enumerate(tally[:-1], 1))
        with np.errstate(divide="ignore", invalid="ignore"):
            # a context that would leave nothing gives up one occurrence more
            scale = np.where((kept > 0) & (1 - kept / count < 1e-12), count / (count + 1), 1.0)
            alpha = np.where(kept > 0, (1 - scale * kept / count) / (1 - below), 1.0)
            p1 = np.where(count > 0, lower * cut[np.minimum(count, CUT + 1)] * count, unknown)
            pair = np.where(c2 > 0, scale[u] * cut2[np.minimum(c2, CUT + 1)] * c2 / count[u], alpha[u] * p1[w])
        base = np.log10((count + 0.1) / (total + 0.1 * (kinds + 1)))[t.tokens]
        starts = np.r_[0, np.cumsum(t.lengths)[:-1]]
        add = lambda x: np.add.reduceat(x, starts)
        yield [t.ids, t.lengths, add((count > 0)[t.tokens].astype(np.int64)), np.full(len(t.ids), total), add(base), add(np.log10(pair)[which])]

    return exchange(state, ask_pairs, answer_pairs, parts, apply_pairs, RESULT, size.blocks)[0]


def op8_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = score(docs, fold("doc_id", 10) != 0)
    return found.select("doc_id", (fold("doc_id", 10) == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
