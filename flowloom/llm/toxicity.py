"""Toxicity scores from a learned lexicon.

Terms are learned from labelled rows: whole words of any length, and stems, word beginnings that
toxic documents hold far more often than others, taken at the deepest trie node that keeps their
support, so that an inflected family is found by one stem; weak stems too if two or more words of the
family in one document tell. The terms form a trie. A Levenshtein
automaton of a word (letters left out, put in, changed, or two neighbours swapped) is intersected
with the trie by walking (node, position, edits) states; a state that has used all edits follows one
path only, so a word that matches nothing is dropped after a few steps. Words under five letters
must match a term exactly, others may have one edit; so may the beginning of a word against a stem
of five letters or more. A misspelled whole term counts as most of a hit (NEAR), a misspelled stem,
which chance meets more often, as a feature of its own. A hit's context window (words and quotation marks about it) tells quotation
from abuse. A logistic model over hit counts makes the score.

Learning takes at most `per_class` labelled rows of each class, those with the least hash of the id:
the documented bound. All of them make the model; in the counts that find terms, texts that share a
signature (near copies mostly) are taken as one document with the words of all, since a text that
is often copied would pass its own rare words off as terms. Scoring takes every row and whole texts.

Defined cases: null and empty texts have no hits and get the model's score for that. Rows with a
null id are scored and are never learned from. A document labelled twice is toxic if any label says
so; null labels do not count. With fewer than two classes to learn from, the score is the base rate
(0 without labels). Stems have STEM_LEAST to STEM letters; words of any length are learned whole.
Extra columns are not read.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, python_batches, stored, table

WORD = re.compile(r"[^\W\d_]+")
PIECE = re.compile(r"[^\W\d_]+|[\"“”„«»‹›]")
QUOTES = frozenset("\"“”„«»‹›")
#: Words that report what somebody said.
REPORTS = frozenset(
    "said says say wrote writes quoted quote called calling reported reads sagte schrieb zitat nannte dit écrit cité appelé dijo escribió cita llamó".split()
)
#: Words that address a reader.
ADDRESS = frozenset("you your yours youre du dich dein ihr euch tu toi vous ton votre tú usted eres tus".split())
FEATURES = ("hits", "bent", "weak", "quoted", "addressed", "density")
#: What a misspelled whole term counts, as a share of a hit.
NEAR = 0.75
#: Letters of a stem, at most: every beginning of a word is counted, so this bounds what a very long word costs.
STEM_LEAST, STEM = 3, 40
#: Letters that a word and a stem need to be matched with an edit.
EDITED = 5
WINDOW = 6
#: Nats that a term must carry: chance gives this to about one of ten million beginnings.
LEAST_EVIDENCE = 14.0
_MEMO = 500_000
#: Counts held by a task before it passes them on.
_COUNTS = 200_000


class Lexicon:
    """A trie of terms. Nodes are dictionaries; "" marks the end of a term: True if words may go on after it (a stem)."""

    def __init__(self, terms: dict[str, bool]) -> None:
        self.root: dict = {}
        for term, stem in terms.items():
            node = self.root
            for c in term:
                node = node.setdefault(c, {})
            node[""] = stem

    def edits(self, word: str) -> int:
        """Edits from the word to its nearest term, 9 if there is none within reach."""
        return min(self.match(word))

    def match(self, word: str) -> tuple[int, int]:
        """Edits from the word to its nearest whole term, and from its beginning to the nearest stem."""
        found = self._search(word, 0)
        return self._search(word, 1) if min(found) and len(word) >= EDITED else found

    def _search(self, word: str, most: int) -> tuple[int, int]:
        """States: trie node, its depth, letters read, edits used."""
        n, whole, begun = len(word), 9, 9
        stack = [(self.root, 0, 0, 0)]
        while stack:
            node, depth, i, e = stack.pop()
            while True:
                end = node.get("")
                if end and (not e or depth >= EDITED):  # a stem: the word may go on
                    begun = min(begun, e)
                elif end is False and e + n - i <= most:
                    whole = min(whole, e + n - i)
                if e < most:
                    if i < n:
                        stack.append((node, depth, i + 1, e + 1))  # a letter put in
                    for c, child in node.items():
                        if c:
                            stack.append((child, depth + 1, i, e + 1))  # a letter left out
                            if i < n and c != word[i]:
                                stack.append((child, depth + 1, i + 1, e + 1))  # changed
                    if i + 1 < n and word[i] != word[i + 1] and (swapped := node.get(word[i + 1], {}).get(word[i])):
                        stack.append((swapped, depth + 2, i + 2, e + 1))
                node = node.get(word[i]) if i < n else None
                if node is None:
                    break
                i, depth = i + 1, depth + 1
            if not min(whole, begun):
                break
        return whole, begun


class Scorer(dict):
    """The kind of each word seen: a hit of a strong term (1), of a weak one (2), of a misspelled whole term (3) or stem (4), none (0).

    Strong terms are matched with edits, weak ones, that clean documents hold too, exactly.
    """

    def __init__(self, strong: dict[str, bool], weak: dict[str, bool]) -> None:
        self.strong, self.weak = Lexicon(strong), Lexicon(weak)

    def __missing__(self, word: str) -> int:
        if len(self) >= _MEMO:
            self.clear()
        whole, begun = self.strong.match(word)
        if min(whole, begun) == 0:
            kind = 1
        elif min(self.weak._search(word, 0)) == 0:
            kind = 2
        else:
            kind = 3 if whole == 1 else 4 if begun == 1 else 0
        self[word] = kind
        return kind

    def hit(self, word: str) -> bool:
        return self[word] > 0

    def features(self, text: str | None) -> list[float]:
        words = WORD.findall((text or "").lower())
        if not any(map(self.__getitem__, words)):
            return [0.0] * len(FEATURES)
        pieces = PIECE.findall(text.lower())
        exact = near = bent = quoted = addressed = 0
        weak: set[str] = set()
        inside = False
        closing = max((k for k, w in enumerate(pieces) if w in QUOTES), default=-1)
        for k, w in enumerate(pieces):
            if w in QUOTES:
                inside = not inside
                continue
            kind = self[w]
            if kind == 2:
                weak.add(w)
            bent += kind == 4
            if kind not in (1, 3):
                continue
            exact += kind == 1
            near += kind == 3
            about = pieces[max(0, k - WINDOW) : k] + pieces[k + 1 : k + 1 + WINDOW]
            quoted += (inside and k < closing) or any(x in REPORTS for x in about)
            addressed += any(x in ADDRESS for x in about)
        hits = exact + NEAR * near
        return [*map(math.log1p, (hits, bent, 100 * len(weak) / len(words), quoted, addressed)), hits / len(words)]


def _sign(doc_id: int, text: str | None) -> int:
    """Two least hashes of word pairs, as one number: near copies mostly share it, other documents hardly ever. Texts of under two words have one of their own."""
    ws = WORD.findall((text or "").lower())
    least = sorted({zlib.crc32(f"{a} {b}".encode()) for a, b in zip(ws, ws[1:], strict=False)})[:2]
    return least[0] << 31 | least[-1] >> 1 if least else -1 - zlib.crc32(f"{doc_id} {text}".encode())


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        signs = pa.array(map(_sign, batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()), pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("text"), batch.column("toxic"), signs], names=["text", "toxic", "sign"])


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Signatures of each class whose texts hold a word beginning (docs), two words with it (pairs), or a word (whole). Rows come sorted by signature and class."""
    docs: Counter = Counter()
    pairs: Counter = Counter()
    whole: Counter = Counter()
    now, words = None, set()

    def close() -> None:
        whole.update((w, now[1]) for w in words)
        held = Counter(w[:n] for w in words for n in range(STEM_LEAST, min(STEM, len(w)) + 1))
        docs.update((p, now[1]) for p in held)
        pairs.update((p, now[1]) for p, n in held.items() if n > 1)

    def rows() -> pa.RecordBatch:
        keys = list(docs.keys() | whole.keys())
        columns = {
            "term": [k[0] for k in keys],
            "toxic": [k[1] for k in keys],
            **{n: [c[k] for k in keys] for n, c in (("docs", docs), ("pairs", pairs), ("whole", whole))},
        }
        for c in (docs, pairs, whole):
            c.clear()
        return pa.RecordBatch.from_pydict(
            columns, schema=pa.schema([("term", pa.string()), ("toxic", pa.int32()), ("docs", pa.int64()), ("pairs", pa.int64()), ("whole", pa.int64())])
        )

    for batch in batches:
        for text, toxic, sign in zip(*(batch.column(c).to_pylist() for c in ("text", "toxic", "sign")), strict=True):
            if (sign, toxic) != now:
                if now:
                    close()
                now, words = (sign, toxic), set()
                if len(docs) >= _COUNTS:
                    yield rows()
            words.update(WORD.findall((text or "").lower()))
    if now:
        close()
    yield rows()


def choose_terms(rows: list[tuple], toxic: int, other: int, precision: float, families: bool = False) -> dict[str, bool]:
    """Terms, True for stems. rows: beginning, toxic and other documents that hold it, with it as a whole word, with two words of it (counted with families)."""
    base = toxic / max(toxic + other, 1)

    def tells(a: int, b: int) -> bool:
        """The share in toxic documents, and the log likelihood ratio of the term's own toxic share against the common one."""
        evidence = sum(n * math.log(n / (a + b) / p) for n, p in ((a, base), (b, 1 - base)) if n)
        return a / max(toxic, 1) >= precision / (1 - precision) * b / max(other, 1) and evidence >= LEAST_EVIDENCE

    good = {t: (a, w) for t, a, b, w, _, a2, b2 in rows if a >= 3 and (tells(a, b) or families and a2 >= 3 and tells(a2, b2))}
    below: dict[str, list[str]] = {}
    for t in good:
        below.setdefault(t[:-1], []).append(t)
    terms: dict[str, bool] = {}
    for t in sorted(good, key=lambda t: (len(t), t)):
        if t[:-1] in good:
            continue  # reached from its root
        while True:  # go down while one child keeps nearly all of the support
            longer = [u for u in below.get(t, ()) if good[u][0] >= 0.9 * good[t][0]]
            if not longer or good[t][1] >= 0.5 * good[t][0]:
                break
            t = max(longer, key=lambda u: good[u][0])
        terms[t] = good[t][1] < 0.5 * good[t][0]
    stems = {t for t, stem in terms.items() if stem}
    for t, _, _, w, v, _, _ in rows:  # words that tell though their beginnings do not, and those that no stem reaches
        if w >= 3 and t not in terms and tells(w, v) and not any(t[:n] in stems for n in range(1, len(t) + 1)):
            terms[t] = False
    return terms


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 40) -> np.ndarray:
    """Newton steps over a bounded sample; the last weight is the constant."""
    x = np.c_[x, np.ones(len(x))]
    w, keep = np.zeros(x.shape[1]), np.r_[np.full(x.shape[1] - 1, ridge), 1e-6]
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(keep), x.T @ (y - p) - keep * w)
        w += np.clip(step, -4, 4)
        if abs(step).max() < 1e-6:
            break
    return w


class Model:
    def __init__(self, strong: dict[str, bool], weak: dict[str, bool], weights: list[float]) -> None:
        self.strong, self.weak, self.weights = strong, weak, weights

    def scorer(self):
        lexicon, w = Scorer(self.strong, self.weak), self.weights

        def score(text: str | None) -> float:
            z = w[-1] + sum(a * b for a, b in zip(w, lexicon.features(text), strict=False))
            return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))

        return score


def fit(
    docs: DataFrame, labels: DataFrame, folds: int = 5, held: int | None = 0, per_class: int = 6000, precision: float = 0.95, weak_precision: float = 0.5
) -> Model:
    """Learn from labelled rows outside the held-out fold (None: from all)."""
    python_batches(docs.sparkSession)
    known = (
        labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
        .groupBy(F.col("doc_id").cast("bigint").alias("doc_id"))
        .agg(F.max("toxic").cast("int").alias("toxic"))
        .where(F.lit(True) if held is None else fold("doc_id", folds) != held)
        .join(docs.select(F.col("doc_id").cast("bigint").alias("doc_id")).distinct(), "doc_id")
    )
    drawn = [known.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for c in (0, 1)]
    chosen = {r.doc_id: r.toxic for d in drawn for r in d.collect()}  # at most 2 * per_class ids
    toxic, other = sum(chosen.values()), len(chosen) - sum(chosen.values())
    if not toxic or not other:
        rate = min(max(toxic / max(1, len(chosen)), 1e-6), 1 - 1e-6)
        return Model({}, {}, [0.0] * len(FEATURES) + [math.log(rate / (1 - rate))])
    spark = docs.sparkSession
    ids = spark.createDataFrame(list(chosen.items()), "doc_id bigint, toxic int")
    texts = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")
    ).join(F.broadcast(ids), "doc_id").select("doc_id", "text", "toxic")
    sample = stored(texts.mapInArrow(_signed, "text string, toxic int, sign bigint"), "labelled")
    sizes = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count_distinct("sign").alias("n")).collect()}
    toxic, other = sizes.get(1, 0), sizes.get(0, 0)
    base = toxic / max(toxic + other, 1)

    def share(n: Column, of: Column, p: float) -> Column:
        return F.when(n > 0, n * F.log(n / of / F.lit(p))).otherwise(F.lit(0.0))

    def told(a: Column, b: Column) -> Column:
        """The test of choose_terms, with room for rounding: all that pass are collected."""
        return (a >= 3) & (
            a / max(toxic, 1) >= weak_precision / (1 - weak_precision) * b / max(other, 1) - 1e-9
        ) & (share(a, a + b, base) + share(b, a + b, 1 - base) >= LEAST_EVIDENCE - 1e-6)

    sums = {
        n: F.sum(F.when(F.col("toxic") == c, F.col(of)).otherwise(0))
        for n, c, of in (("a", 1, "docs"), ("b", 0, "docs"), ("w", 1, "whole"), ("v", 0, "whole"), ("a2", 1, "pairs"), ("b2", 0, "pairs"))
    }
    counts = (
        sample.repartition("sign", "toxic")
        .sortWithinPartitions("sign", "toxic")
        .select("text", "toxic", "sign")
        .mapInArrow(_terms, "term string, toxic int, docs bigint, pairs bigint, whole bigint")
        .groupBy("term")
        .agg(*(c.alias(n) for n, c in sums.items()))
        .where(told(F.col("a"), F.col("b")) | told(F.col("w"), F.col("v")) | told(F.col("a2"), F.col("b2")))
        .orderBy("term")
    )
    rows = [(r.term, r.a, r.b, r.w, r.v, r.a2, r.b2) for r in counts.collect()]
    strong, weak = choose_terms(rows, toxic, other, precision), choose_terms(rows, toxic, other, weak_precision, families=True)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Scorer(strong, weak)
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [pa.array([lexicon.features(t) for t in batch.column("text").to_pylist()], pa.list_(pa.float64())), batch.column("toxic")], names=["x", "toxic"]
            )

    rows = sample.mapInArrow(measure, "x array<double>, toxic int").collect()  # bounded by per_class
    w = fit_logistic(np.array([r.x for r in rows]), np.array([r.toxic for r in rows], float))
    return Model(strong, weak, [float(v) for v in w])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score for every row."""
    python_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = model.scorer()
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(map(of, batch.column("text").to_pylist()), pa.float64())], names=["doc_id", "score"]
            )

    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")
    ).mapInArrow(run, "doc_id bigint, score double")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """docs without those that score `threshold` or more; all columns stay."""
    model = fit(docs.select("doc_id", "text"), labels, held=None)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        of = model.scorer()
        for texts in batches:
            yield texts.map(of)

    return docs.where(scored(F.col("text").cast("string")) < threshold)
