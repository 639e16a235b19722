"""Byte-level BPE encoding and decoding.

A pre-token's bytes are symbols in a doubly linked list; a heap holds (merge rank, position) of
adjacent pairs. The lowest pops first, an entry whose pair has changed since is stale and is
skipped, a merge links the neighbours anew and pushes the two pairs that it makes. Decoding
concatenates the vocabulary's byte strings.

Each Python worker keeps the short pre-tokens that it has seen in a dictionary of a fixed largest
size. Files of another make (normalisers, other ways of cutting, dropout, fallbacks) are refused.

Defined cases: a null text encodes as the empty text: no tokens, decoded "". Added tokens of the
file (their strings in a text) become their own ids, as in the library's plain encode. Rows are
independent, so ties, repeated rows and other columns play no part.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import python_batches, table

#: Fixed value: the split pattern of the byte-level vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pre-tokens that a worker keeps at most, and the longest that it keeps.
KEPT, SHORT = 400_000, 64


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class _Memo(dict):
    """A dictionary that makes what it lacks, and starts anew when it is full."""

    def __init__(self, make, most: int = KEPT) -> None:
        self.make, self.most = make, most

    def __missing__(self, key):
        value = self.make(key)
        if len(key) <= SHORT:
            if len(self) >= self.most:
                self.clear()
            self[key] = value
        return value


def _refuse(spec: dict) -> None:
    """Only byte-level BPE that cuts texts by PATTERN is encoded as the library does."""
    model, cut = spec["model"], spec.get("pre_tokenizer") or {}
    plain = {
        "dropout": None,
        "unk_token": None,
        "continuing_subword_prefix": None,
        "end_of_word_suffix": None,
        "fuse_unk": False,
        "byte_fallback": False,
        "ignore_merges": False,
    }
    wrong = [k for k, v in plain.items() if (model.get(k) or None) != (v or None)]
    if spec.get("normalizer"):
        wrong.append("normalizer")
    if cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True):
        wrong.append("pre_tokenizer")
    if model.get("type", "BPE") != "BPE" or (spec.get("decoder") or {}).get("type") != "ByteLevel":
        wrong.append("model or decoder")
    if any(t.get(k) for t in spec.get("added_tokens") or () for k in ("single_word", "lstrip", "rstrip", "normalized")):
        wrong.append("added_tokens")
    if wrong:
        raise ValueError(f"not a plain byte-level BPE file: {', '.join(wrong)}")


class Codec:
    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        _refuse(spec)
        letters = byte_letters()
        byte_of = {c: b for b, c in enumerate(letters)}
        vocab = spec["model"]["vocab"]
        self.byte_id = [vocab.get(c) for c in letters]
        #: (left id, right id) -> (rank, merged id)
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, m in enumerate(spec["model"]["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            self.merges.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
        self.string = {i: bytes(byte_of[c] for c in t) if all(c in byte_of for c in t) else t.encode() for t, i in vocab.items()}
        added = {t["content"]: t["id"] for t in spec.get("added_tokens") or ()}
        self.string |= {i: t.encode() for t, i in added.items()}
        self.added = {t: str(i) for t, i in added.items()}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.words = regex.compile(PATTERN)
        self.ids = _Memo(lambda word: ",".join(map(str, self.merge(word.encode()))))
        self.bytes = _Memo(lambda ids: b"".join(self.string[int(i)] for i in ids.split(",")))

    def merge(self, word: bytes) -> list[int]:
        sym: list[int | None] = [self.byte_id[b] for b in word]
        n = len(sym)
        prev, nxt = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = []
        for i in range(n - 1):
            if m := self.merges.get((sym[i], sym[i + 1])):
                heap.append((m[0], i, m[1], sym[i], sym[i + 1]))
        heapq.heapify(heap)
        while heap:
            _, i, made, left, right = heapq.heappop(heap)
            j = nxt[i] if sym[i] == left else -1
            if j < 0 or sym[j] != right:
                continue  # stale: one of the two has been merged since
            sym[i], sym[j] = made, None
            nxt[i] = k = nxt[j]
            if k >= 0:
                prev[k] = i
                if m := self.merges.get((made, sym[k])):
                    heapq.heappush(heap, (m[0], i, m[1], made, sym[k]))
            if (p := prev[i]) >= 0 and (m := self.merges.get((sym[p], made))):
                heapq.heappush(heap, (m[0], p, m[1], sym[p], made))
        return [s for s in sym if s is not None]

    def pieces(self, text: str) -> list[str]:
        """The ids of each pre-token or added token, as decimals joined by commas."""
        if self.cut is None or not any(t in text for t in self.added):
            return list(map(self.ids.__getitem__, self.words.findall(text)))
        out = []
        for part in self.cut.split(text):
            if part in self.added:
                out.append(self.added[part])
            elif part:
                out.extend(map(self.ids.__getitem__, self.words.findall(part)))
        return out

    def encode(self, text: str | None) -> list[int]:
        return [int(i) for p in self.pieces(text or "") for i in p.split(",")]

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.string[i] for i in ids).decode("utf-8", "replace")

    def digest(self, text: str | None) -> tuple[int, str, str]:
        """Number of tokens, SHA-256 of the ids joined by commas, SHA-256 of what the ids decode to."""
        pieces = self.pieces(text or "")
        ids = ",".join(pieces)
        decoded = b"".join(map(self.bytes.__getitem__, pieces)).decode("utf-8", "replace")
        return ids.count(",") + bool(ids), hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One codec for each file in a Python worker."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode_decode(docs: DataFrame, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for each row; with_ids adds token_ids and decoded."""
    where = path or default_path()
    python_batches(docs.sparkSession)
    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", token_ids array<int>, decoded string" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(where)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            made = [c.digest(t) for t in texts]
            columns = [batch.column("doc_id"), *(pa.array([m[k] for m in made], t) for k, t in enumerate((pa.int64(), pa.string(), pa.string())))]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                ids = [c.encode(t) for t in texts]
                columns += [pa.array(ids, pa.list_(pa.int32())), pa.array([c.decode(i) for i in ids], pa.string())]
                names += ["token_ids", "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"))
