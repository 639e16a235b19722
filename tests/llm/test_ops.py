"""Each operator against brute force on small rows: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from flowloom.llm import ann, bpe, chat, common, decontaminate, katz, line_dedup, simhash, suffix, toxicity, warc

SF = "/root/testdata/sf0.001"
LOW = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
TEXTS = [
    (1, None),
    (2, ""),
    (3, " \n\n a B c"),
    (4, "The same line\nAnother line here"),
    (5, "the SAME line \n\tthe same line\nx"),
    (5, "the SAME line \n\tthe same line\nx"),
    (6, "word " * 4000),
    (None, "the same line\nno id"),
]
DOCS = "doc_id long, text string"


def docs_of(spark, rows=TEXTS):
    return spark.createDataFrame(rows, DOCS)


def clashing(df):
    """Columns with the names that operators use themselves."""
    return df.withColumns({"th": F.lit(1), "keep_": F.lit("k"), "node": F.lit(2), "row": F.lit("r"), "n_chars": F.lit(0).cast("long"), "key": F.lit("y")})


# 1


def brute_lines(rows, least):
    key = lambda x: x.encode().strip(common.WHITE).translate(LOW)
    seen = defaultdict(set)
    for i, t in rows:
        if i is not None:
            for x in (t or "").split("\n"):
                seen[key(x)].add(i)
    gone = {k for k, v in seen.items() if k and len(v) >= least}
    out = []
    for i, t in rows:
        ls = (t or "").split("\n")
        kept = [x for x in ls if key(x) not in gone]
        out.append((i, len(ls), len(ls) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def test_line_dedup(spark):
    texts = [*TEXTS, (9, "twice"), (9, "twice\nx"), (10, "y\ntwice"), (None, "no id")]  # one id with two texts
    df = docs_of(spark, texts)
    for least in (1, 2, 3):
        both = line_dedup.with_bitmaps(df, line_dedup.keep_bitmaps(df, least, 1, "none")).collect()
        got = sorted(((r.doc_id, *(lambda k: (k[1], k[2], k[0]))(line_dedup.kept_text(r.text, r.keep_))) for r in both), key=str)
        assert got == brute_lines(texts, least)
    df = docs_of(spark)
    first = {r.doc_id: r.text for r in line_dedup.drop_lines(clashing(df), 2, "first").collect()}
    assert first[4] == "The same line\nAnother line here" and first[5] == "x" and first[None] == "no id"
    assert line_dedup.drop_lines(clashing(df), 2).columns == clashing(df).columns
    assert line_dedup.drop_lines(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        line_dedup.keep_bitmaps(df, keep="some")


# 2


def brute_spans(texts, length):
    bs = [(t or "").encode() for t in texts]
    count = Counter(b[p : p + length] for b in bs for p in range(len(b) - length + 1))
    out = []
    for b in bs:
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            if count[b[p : p + length]] > 1:
                gone[p : p + length] = True
        out.append(
            (
                len(b),
                int(gone.sum()),
                int((gone & ~np.r_[False, gone[:-1]]).sum()) if len(b) else 0,
                hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest(),
            )
        )
    return out


def test_suffix_array(spark, monkeypatch):
    monkeypatch.setattr(suffix, "BLOCK_BYTES", 6000)
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, base = prose(90), prose(300)
    ws = base.split()
    texts = [
        None,
        "",
        "short",
        base,
        base,
        " ".join(ws[:150] + ["edit"] + ws[151:]),
        prose(100) + passage + prose(60),
        passage + prose(30),
        "a" * 900,
        prose(20) + "ab" * 300,
        passage[5:] + passage[:-3],
        prose(200) + prose(10),
    ]
    df = spark.createDataFrame(list(enumerate(texts)), DOCS)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.repeated(clashing(df)).collect()}
    assert [got[i] for i in range(len(texts))] == brute_spans(texts, 400)
    assert suffix.repeated(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        suffix.repeated(df, length=50)


def test_suffix_groups_that_are_not_neighbours(spark):
    """A phrase prefix that begins a longer one: suffixes of the longer stand between those of the shorter."""
    p = (
        "cschsd ooc irao idao dtotrsob inbr aibobsna daaenet crcoth osnoiocti idnehcer ctrbt hceee ierna cedd "
        "ror oitd conitdb bcsaatii scrrcs obdiced tihtcdet"
    ).split()
    q = ["hnoe" if w == "irao" else w for w in p]
    texts = [" ".join(p * 4 + q * 4), " ".join(q * 3 + p * 4)]
    for length in (300, 400):
        df = spark.createDataFrame(list(enumerate(texts)), DOCS)
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.repeated(clashing(df), length).collect()}
        assert [got[i] for i in range(len(texts))] == brute_spans(texts, length)


# 3


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[100:400] = x[7]  # a common vector
    x[500:700] *= 3
    rows = [(i, v.tolist()) for i, v in enumerate(x.astype(np.float32).astype(float))] + [
        (2000, None), (2001, [0.0] * 24), (2002, [float("nan")] + [1.0] * 23), (2003, [None] + [1.0] * 23), (None, [1.0] * 24), (2004, [1.0] * 3)
    ]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.nearest(v, v.where("vec_id % 20 = 0"), 20).toPandas()
    y, hit = np.array([r[1] for r in rows[:1500]]), 0
    for q, g in got.groupby("query_id"):
        g = g.sort_values("rank")
        s = y @ y[q]
        ids = np.delete(np.arange(1500), q)
        want = ids[np.lexsort((ids, -s[ids]))][:20]
        hit += len(set(want) & set(g["vec_id"]))
        assert list(g["rank"]) == list(range(1, 21)) and np.allclose(s[g["vec_id"]], g["score"], atol=1e-12) and q not in set(g["vec_id"])
        assert [tuple(p) for p in zip(-g["score"], g["vec_id"])] == sorted(zip(-g["score"], g["vec_id"]))
    assert got["query_id"].nunique() == 75 and hit / (75 * 20) >= 0.9
    few = v.where("vec_id IN (20, 21, 40)")
    assert ann.nearest(few, few.where("vec_id % 20 = 0"), 20).count() == 4
    assert ann.nearest(v.limit(0), v.limit(0)).count() == 0


def brute_nearest(y, ids, k=20):
    """query -> [(vec_id, score)], nearest first."""
    out = {}
    for n, q in enumerate(ids):
        if q % 20 == 0:
            s = y @ y[n]
            order = sorted((j for j in range(len(ids)) if ids[j] != q), key=lambda j: (-s[j], ids[j]))[:k]
            out[q] = [(ids[j], s[j]) for j in order]
    return out


@pytest.mark.parametrize(("n", "seed"), [(2, 0), (3, 1), (12, 1), (21, 0), (21, 1), (22, 1), (90, 0), (200, 1)])
def test_nearest_neighbours_of_small_tables(spark, n, seed):
    """Every row that is owed comes back, whatever the vectors: min(20, n - 1) for each query; equal to brute force up to 21 vectors."""
    rng = np.random.default_rng(seed)
    y = rng.normal(size=(n, 64 if seed else 5)) * rng.choice([0.1, 1, 10], (n, 1))
    ids = [20 * i if i % 3 == 0 else 20 * i + 1 for i in range(n)]
    v = clashing(spark.createDataFrame([(i, x.tolist()) for i, x in zip(ids, y)], "vec_id long, embedding array<double>"))
    got = defaultdict(list)
    for r in ann.nearest(v, v.where("vec_id % 20 = 0"), 20).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    want = brute_nearest(y, ids)
    assert {q: len(x) for q, x in got.items()} == {q: min(20, n - 1) for q in want}
    if n <= 21:
        for q, rows in want.items():
            assert [i for i, _ in got[q]] == [i for i, _ in rows] and np.allclose([x for _, x in got[q]], [x for _, x in rows])


def test_probes_have_no_cap():
    rng = np.random.default_rng(4)
    h = ann.Hasher(8, 1.0, 4)
    assert len(h.template(10**9)) == 3**4 and len({tuple(r) for r in h.template(10**9).tolist()}) == 3**4
    x = rng.normal(size=(3000, 8))
    h = ann.Hasher(8, float(np.linalg.norm(x, axis=1).max()), 12)
    few = ann.fit_probes(x, x[:40], h, 20, 0.5, 10**6)
    assert few and ann.fit_probes(x, x[:40], h, 20, 0.9, 10**6) > few
    assert ann.fit_probes(x, x[:40], h, 20, 0.9, 100) is None and ann.fit_probes(x[:20], x[:4], h, 20, 0.9, 20) is None
    place = h.places(h.queries(x[:1]), 0)[0]
    codes = h.probes(place, h.template(500))
    assert codes[0] == h.codes(np.floor(place)) and len(set(codes.tolist())) == 500


def test_probes_are_made_in_parts(monkeypatch):
    h = ann.Hasher(6, 1.0, 5)
    place = h.places(h.queries(np.random.default_rng(5).normal(size=(1, 6))), 0)[0]
    whole = h.probes(place, h.template(200))
    monkeypatch.setattr(ann, "PROBES_AT_ONCE", 7)
    assert (h.probes(place, h.template(200)) == whole).all() and h.template(200).dtype == np.int8


def test_beyond_the_template_all_buckets_are_visited(spark, monkeypatch):
    """A template that is too short for the target is not used: the result is that of brute force."""
    monkeypatch.setattr(ann, "TEMPLATE", 2)
    y = np.random.default_rng(8).normal(size=(400, 48))
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(y)], "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in ann.nearest(v, v.where("vec_id % 20 = 0"), 20).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    assert got == {q: [i for i, _ in rows] for q, rows in brute_nearest(y, list(range(400))).items()}


# 4


def test_a_quotation_may_end_far_away():
    """A hit is inside one however long it is, unless no sign closes it."""
    s = toxicity.Scorer({"villain": False}, {})
    at = toxicity.FEATURES.index("quoted")
    words = "plain " * 300
    assert s.features(f'"villain {words}" end')[at] > 0 == s.features(f'"villain {words} end')[at]
    assert s.features(f'"a" villain {words} "b"')[at] == 0


def test_toxicity(spark):
    rng = random.Random(2)
    plain = [f"{a}{b}" for a in ("ran", "tel", "mor", "vid", "sol") for b in ("den", "ka", "ist", "om", "ure")]
    rows, labels = [], []
    for i in range(600):
        ws = [rng.choice(plain) for _ in range(40)]
        if i % 4 == 0:
            ws[5] = rng.choice(["villain", "scoundrel", "wretched"])
        rows.append((i, " ".join(ws)))
        labels.append((i, 1, int(i % 4 == 0)))
    rows += [(1000, "randen telka villian solom " * 3), (1001, None), (1002, ""), (None, "villain you")]
    docs, lab = spark.createDataFrame(rows, DOCS), spark.createDataFrame(
        [*labels, (3, 1, None), (5000, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int"
    )
    model = toxicity.fit(docs, lab)
    got = {r.doc_id: r.score for r in toxicity.score(clashing(docs), model).collect()}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all((got[i] >= 0.5) == (i % 4 == 0) for i in held) and held
    assert got[1001] == got[1002] < 0.5 <= got[None]
    kept = toxicity.drop_toxic(clashing(docs), lab)
    assert kept.columns == clashing(docs).columns and {r.doc_id for r in kept.collect()} >= {1, 2, 3, 1001}
    nothing = toxicity.fit(docs, lab.limit(0))
    assert all(r.score < 0.01 for r in toxicity.score(docs, nothing).collect())


def test_toxic_terms_are_not_crowded_out(spark):
    """Over 5,000 neutral beginnings in more documents than the one term that tells."""
    rng = random.Random(13)
    plain = ["".join(rng.choice("bcdfghklmnprst") for _ in range(10)) for _ in range(1200)]
    rows = [(i, " ".join(rng.sample(plain, len(plain)) + ["villain"] * (i % 2 and i < 80))) for i in range(120)]
    labels = spark.createDataFrame([(i, 1, i % 2) for i, _ in rows], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs_of(spark, rows), labels, held=None)
    assert toxicity.Lexicon(model.strong).edits("villain") == 0


def edit_distance(a, b):
    """Optimal string alignment, by the whole table."""
    d = {(i, -1): i + 1 for i in range(-1, len(a))} | {(-1, j): j + 1 for j in range(-1, len(b))}
    for i in range(len(a)):
        for j in range(len(b)):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i] != b[j]))
            if i and j and a[i] == b[j - 1] and a[i - 1] == b[j]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a) - 1, len(b) - 1]


def brute_edits(word, terms):
    best = 9
    for term, stem in terms.items():
        each = [edit_distance(word[:n], term) for n in range(len(word) + 1)] if stem else [edit_distance(word, term)]
        least = min(each)
        if least == 0 or least == 1 and len(word) >= 5 and (not stem or len(term) >= 5):
            best = min(best, least)
    return best


def test_levenshtein_automaton():
    lex = toxicity.Lexicon({"villain": False, "wretch": True})
    near = {
        "villain": 0,
        "vilain": 1,
        "villains": 1,
        "villian": 1,
        "vxllain": 1,
        "villan": 1,
        "wretched": 0,
        "wretch": 0,
        "wrtched": 1,
        "rwetches": 1,
        "vill": 9,
        "": 9,
        "xvillain": 1,
        "banana": 9,
    }
    assert {w: lex.edits(w) for w in near} == near
    assert toxicity.Lexicon({"idiot": False, "scumbag": True}).edits("idoit") == toxicity.Lexicon({"scumbag": True}).edits("scmbag") == 1


def test_levenshtein_automaton_equals_brute_force():
    rng = random.Random(14)
    word = lambda low, high: "".join(rng.choice("abcd") for _ in range(rng.randint(low, high)))
    for _ in range(20):
        terms = {word(1, 9): rng.random() < 0.4 for _ in range(12)}
        lex = toxicity.Lexicon(terms)
        words = [word(0, 11) for _ in range(60)] + [
            t[:k] + rng.choice("abcd") + t[k + rng.randint(0, 1) :]
            for t in terms for k in range(len(t))
        ] + ["".join((t[:k], t[k + 1], t[k], t[k + 2 :])) for t in terms for k in range(len(t) - 1)]
        assert {w: lex.edits(w) for w in words} == {w: brute_edits(w, terms) for w in words}


def test_every_labelled_row_is_learned_from(spark):
    """Texts of one word, words of two or three letters, and a very long word."""
    rng = random.Random(15)
    plain = [f"{a}{b}" for a in ("ran", "tel", "mor", "vid", "sol") for b in ("den", "ka", "ist", "om", "ure")]
    rows = [(i, "zog" if i % 2 else rng.choice(plain)) for i in range(200)] + [
        (i, " ".join(rng.choices(plain, k=20)) + (" qx" if i % 2 else ""))
        for i in range(200, 400)
    ] + [(400, "x" * 100_000), (401, "")]
    labels = spark.createDataFrame([(i, 1, i % 2) for i, _ in rows], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs_of(spark, rows), labels, held=None)
    scorer = toxicity.Scorer(model.strong, model.weak)
    assert scorer.hit("zog") and scorer.hit("qx") and not scorer.hit("zo") and not any(map(scorer.hit, plain))
    got = {r.doc_id: r.score for r in toxicity.score(docs_of(spark, [*rows, (500, "y" * 200_000 + " zog")]), model).collect()}
    assert all((got[i] >= 0.5) == bool(i % 2) for i, _ in rows[:400]) and got[401] < 0.5


# 5


def test_bpe(spark):
    from tokenizers import Tokenizer

    lib, own = Tokenizer.from_file(bpe.default_path()), bpe.Codec(bpe.default_path())
    lib.no_padding(), lib.no_truncation()
    rng = random.Random(3)
    texts = ["", "a", "x" * 3000, "<|endoftext|>"] + [
        "".join(
            rng.choice(["a", "é", "  ", "\n", "\x1c", "\x85", "1", "'s", "<|endoftext|>", "中", "🙂", "\x00", " the", "​", "　"])
            for _ in range(rng.randrange(40))
        )
        for _ in range(300)
    ]
    for t in texts:
        ids = lib.encode(t, add_special_tokens=False).ids
        assert own.encode(t) == ids and own.decode(ids) == lib.decode(ids, skip_special_tokens=False)
    df = clashing(spark.createDataFrame([*enumerate(texts), (None, None)], DOCS))
    for r in bpe.encode_decode(df, with_ids=True).collect():
        ids = lib.encode(texts[r.doc_id] if r.doc_id is not None else "", add_special_tokens=False).ids
        assert r.token_ids == ids and r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded == lib.decode(ids, skip_special_tokens=False)
    memo = bpe._Memo(str.upper, most=3)
    assert [memo[c] for c in "abcdefgh"] == list("ABCDEFGH") and len(memo) <= 3
    assert memo["x" * 1000] == "X" * 1000 and "x" * 1000 not in memo
    import public_tokenizers

    with pytest.raises(ValueError, match="byte-level"):
        bpe.Codec(public_tokenizers.path("word_bpe_49k.json"))


# 6


def brute_print(text, n=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    sh = [" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] if len(w) >= n else [" ".join(w)] if w else []
    hs = [xxhash.xxh64_intdigest(x.encode(), 42) for x in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_simhash(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(
        docs_of(spark).where("doc_id IS NOT NULL").withColumn("doc_id", F.col("doc_id") + 100_000)
    )
    rows = docs.collect()
    ids = sorted({r.doc_id for r in rows})
    fp = {r.doc_id: brute_print(r.text) for r in rows}
    a, parent = np.array([fp[i] for i in ids], np.uint64), list(range(len(ids)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(a ^ a[k]) <= 2):
            p, q = sorted((root(k), root(int(j))))
            parent[q] = p
    want = {i: (f"{fp[i]:016x}", ids[root(k)]) for k, i in enumerate(ids)}
    got = simhash.groups(clashing(docs)).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("f"), "component_id").collect()
    assert {r.doc_id: (r.f, r.component_id) for r in got} == want and len(got) == len(rows)
    assert simhash.groups(docs.limit(0)).count() == 0


def test_trie_finds_all_pairs():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 60, dtype=np.uint64)
    a = np.unique(np.array([int(b) ^ sum(1 << int(k) for k in set(rng.integers(0, 64, n).tolist())) for b in base for n in (0, 1, 2, 4, 5)], np.uint64))
    for budget, blocks in ((2, 3), (5, 7)):
        want = {(min(x, y), max(x, y)) for k, x in enumerate(a.tolist()) for y in a[k + 1 :][np.bitwise_count(a[k + 1 :] ^ a[k]) <= budget].tolist()}
        got = set()
        for order in simhash.leads(budget, blocks):
            t = simhash.turned(a, order)
            r = np.argsort(t)
            for i, j in simhash.trie_pairs(t[r], sum(w for _, w in order[: blocks - budget]), budget, chunk=40):
                got |= {(min(x, y), max(x, y)) for x, y in zip(a[r[i]].tolist(), a[r[j]].tolist())}
        assert got == want


def test_partitions_grow_with_the_corpus(spark, monkeypatch):
    assert simhash.parts_for(spark, 0) == 4 and simhash.parts_for(spark, 9 * simhash.PART_ROWS) == 9
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    few = {r.doc_id for r in simhash.drop_near(docs).collect()}
    monkeypatch.setattr(simhash, "PART_ROWS", 500)
    assert few == {r.doc_id for r in simhash.drop_near(docs).collect()}


def test_near_dedup(spark):
    rng = random.Random(6)
    base = [f"word{rng.randrange(10**6)}" for _ in range(200)]
    edited = base[:100] + ["changed"] + base[101:]
    other = [f"term{rng.randrange(10**6)}" for _ in range(200)]
    rows = [
        (1, " ".join(base)),
        (2, " ".join(base)),
        (3, " ".join(edited)),
        (4, " ".join(other)),
        (5, None),
        (6, ""),
        (7, " ".join(base[:60] + other[:140])),
        (None, " ".join(base)),
        (1, " ".join(base)),
    ]
    df = clashing(spark.createDataFrame(rows, DOCS))
    kept = simhash.drop_near(df)
    assert kept.columns == df.columns and sorted({str(r.doc_id) for r in kept.collect()}) == ["1", "4", "5", "7", "None"]
    assert simhash.drop_near(df.limit(0)).count() == 0


def brute_near(rows, n=5, similarity=0.8):
    """Ids that stay: the least of each group under exact similarity."""
    sets = {i: set(simhash.shingles(t, n)) for i, t in rows}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]):
                p, q = sorted((root(a), root(b)))
                parent[q] = p
    return {root(i) for i in sets}


def test_near_dedup_verifies_before_forests(spark):
    """Many edits of one text: links that hold must survive candidates that do not."""
    rng = random.Random(11)
    base = [f"word{rng.randrange(10**6)}" for _ in range(300)]
    rows = []
    for i in range(150):
        ws = list(base)
        for at in rng.sample(range(300), rng.randint(3, 9)):
            ws[at] = f"edit{rng.randrange(10**6)}"
        rows.append((i, " ".join(ws)))
    kept = {r.doc_id for r in simhash.drop_near(spark.createDataFrame(rows, DOCS)).collect()}
    assert kept == brute_near(rows)


def test_near_dedup_finds_every_kind_of_edit(spark):
    """Tails cut, passages added and blocks replaced, not only words edited."""
    rng = random.Random(12)
    new = lambda n: [f"word{rng.randrange(10**6)}" for _ in range(n)]
    rows = [(1000, "A b"), (1001, "a B  c"), (1002, "a b c"), (1003, " \n"), (1004, "")]
    for i in range(40):
        base = new(rng.randint(100, 300))
        n = len(base)
        rows += [
            (10 * i, " ".join(base)),
            (10 * i + 1, " ".join(base[: n - n * 16 // 100])),
            (10 * i + 2, " ".join(base + new(n * 17 // 100))),
            (10 * i + 3, " ".join(base[: n // 3] + new(n * 8 // 100) + base[n // 3 + n * 8 // 100 :])),
            (10 * i + 4, " ".join(base[: n // 2] + new(n // 2))),
        ]
    kept = {r.doc_id for r in simhash.drop_near(spark.createDataFrame(rows, DOCS)).collect()}
    assert kept == brute_near(rows)


def test_files_of_sets_are_dealt_to_tasks(spark, monkeypatch, tmp_path):
    """Each pass over the shingle sets is dealt to several tasks, though the list of their files is short enough for one."""

    class Told(simhash.Sets):
        def file(self, number):
            from pyspark import TaskContext

            at = TaskContext.get()
            (tmp_path / f"{at.stageId()}-{at.partitionId()}").touch()
            return super().file(number)

    monkeypatch.setattr(simhash, "Sets", Told)
    monkeypatch.setattr(simhash, "FILE_ROWS", 1000, raising=False)
    rng = random.Random(13)
    word = lambda: f"word{rng.randrange(10**6)}"
    rows = [(i, " ".join(word() for _ in range(20))) for i in range(9 * 512)]
    rows += [(10000 + i, f"{t} {word()}") for i, t in rows[:50]]
    assert {r.doc_id for r in simhash.drop_near(spark.createDataFrame(rows, DOCS)).collect()} == set(range(9 * 512))
    tasks = Counter(f.name.split("-")[0] for f in tmp_path.iterdir())
    assert tasks and min(tasks.values()) > 1


def test_levels_of_shingles():
    rng = np.random.default_rng(14)
    n = np.r_[np.ones(500, int), np.arange(2, 140), 400, 5000]
    token = rng.permutation(np.repeat(rng.permutation(10**6)[: len(n)].astype(np.uint32), n))
    level, count = simhash.levels(token), Counter(token.tolist())
    got = sorted({(count[t], x) for t, x in zip(token.tolist(), level.tolist())})
    assert [x for _, x in got] == sorted(x for _, x in got) and len(got) == len(set(n.tolist())) and all((x > 0) == (c > 1) for c, x in got)
    assert len(simhash.levels(token[:0])) == 0 and not simhash.levels(np.arange(9, dtype=np.uint32)).any()


def test_hashed_sets_are_those_of_shingles():
    rng = random.Random(15)
    texts = [None, "", " \n", *(" ".join(rng.choice("ABcd") for _ in range(rng.randint(0, 12))) for _ in range(2000))]
    there, back = {}, {}
    for text, h in zip(texts, simhash.hashed_sets(texts, 5), strict=True):
        want = frozenset(simhash.shingles(text, 5))
        assert len(want) == len(h) and there.setdefault(want, h.tobytes()) == h.tobytes() and back.setdefault(h.tobytes(), want) == want


def test_components(spark):
    pairs = [(i, i + 1) for i in range(1, 40)] + [(100, 200), (300, 100), (7, 7)]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, **dict.fromkeys((100, 200, 300), 100)}


# 7


def test_warc_round_trip(spark, tmp_path):
    rows = [
        (1, "http://a", "<p>x</p>"),
        (2, "http://b\n", "<p>x</p>"),
        (3, None, None),
        (4, "u", ""),
        (5, "v", "é" * 70_000),
        (6, "w", "<p>x</p>"),
        (None, "n", "<p>x</p>"),
    ] + [(i, f"http://{i}", f"<html><body>page {i} of a site with much in common</body></html>") for i in range(10, 60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("key", F.lit("clash"))
    folder = f"file://{tmp_path}/warc"
    got = warc.read(warc.write(pages, folder), folder, payloads=True).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    for i, _, html in rows:
        b = (html or "").encode()
        assert by[i].payload_bytes == len(b) and by[i].payload_digest == warc.digest(b)
        top = max((j for j, _, h in rows if j is not None and (h or "") == (html or "")), default=None)
        revisit = i is not None and i != top
        assert (by[i].record_type, by[i].refers_to) == (("revisit", top) if revisit else ("response", None))
        assert by[i].html == (None if revisit else b)
    assert warc.read(warc.write(pages.limit(0), folder + "2"), folder + "2").count() == 0


# 8


def test_katz(spark, monkeypatch):
    monkeypatch.setattr(katz, "BLOCK", 400)
    monkeypatch.setattr(katz, "PACKET", 1)
    rng = random.Random(8)
    rows = [
        (
            i,
            " ".join(
                rng.choice("alpha beta Gamma delta eps zeta eta the the of".split()) + str(rng.choice(["", "", 1, rng.randrange(500)]))
                for _ in range(rng.randrange(60))
            ),
        )
        for i in range(150)
    ] + [(200, None), (201, ""), (None, "alpha beta")]
    df = spark.createDataFrame(rows, DOCS)
    got = {r.doc_id: r for r in katz.score(clashing(df), common.fold("doc_id", 10) != 0, hot=25).collect()}  # contexts are cut
    toks = {i: (t or "").encode().translate(LOW).split() + [b" end"] for i, t in rows}
    train = [i for i in toks if i is not None and zlib.crc32(str(i).encode()) % 10]
    c1, c2 = Counter(), Counter()
    for i in train:
        c1.update(toks[i])
        c2.update(zip([b" start", *toks[i]], toks[i]))
    n, v = sum(c1.values()), len(c1)
    d1, d2 = katz.discounts(Counter(c1.values())), katz.discounts(Counter(c2.values()))
    p1 = {w: d1.get(c, 1) * c / n for w, c in c1.items()}
    unknown, all_ = 1 - sum(p1.values()), {**c1, b" start": len(train)}
    held, mass = Counter(), Counter()
    for (u, w), c in c2.items():
        held[u] += d2.get(c, 1) * c
        mass[u] += p1[w]

    def p(u, w):
        h = held[u] / all_[u] if u in held else 0
        s = all_[u] / (all_[u] + 1) if u in held and 1 - h < 1e-12 else 1
        if c2[u, w]:
            return s * d2.get(c2[u, w], 1) * c2[u, w] / all_[u]
        return (1 - s * h) / (1 - mass[u]) * p1.get(w, unknown)

    for u in list(held)[:5]:
        assert abs(sum(p(u, w) for w in c1) + p(u, b"never") - 1) < 1e-9
    for i, t in toks.items():
        want = sum(np.log10(p(u, w)) for u, w in zip([b" start", *t], t))
        base = sum(np.log10((c1[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t)
        assert abs(got[i].score - want) < 1e-6 and abs(got[i].base_score - base) < 1e-6
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(t), sum(w in c1 for w in t), n)
    assert d2[1] < 1 and any(c == 1 for c in c2.values())
    assert katz.score(df.limit(0), F.lit(True)).count() == 0
    assert all(r.score == 0 for r in katz.score(df, F.lit(False)).collect())


def test_blocks_grow_with_the_root_of_the_corpus():
    assert katz.sizes(10**8) == (katz.BLOCK, katz.PART) and all(x == int((2000 * 10**13) ** 0.5) for x in katz.sizes(10**13))
    assert suffix.sizes(10**9) == (suffix.BLOCK_BYTES, 40 * suffix.PART_KEYS)
    b, q = suffix.sizes(10**14)
    assert b > suffix.BLOCK_BYTES and b / 50 / (10**14 / q) == pytest.approx(suffix.PACKET, rel=0.01)


def test_katz_keeps_bigrams_seen_once(spark):
    rows = [(r.doc_id, r.text) for r in common.table(spark, SF, "documents").select("doc_id", "text").collect()]
    got = {r.doc_id: r.score for r in katz.op8_katz(spark, SF).collect()}
    toks = [(i, (t or "").encode().translate(LOW).split() + [b" end"]) for i, t in rows]
    c1, c2, starts = Counter(), Counter(), 0
    for i, t in toks:
        if i is not None and zlib.crc32(str(i).encode()) % 10:
            c1.update(t)
            c2.update(zip([b" start", *t], t))
            starts += 1
    n, all_ = sum(c1.values()), {**c1, b" start": starts}
    d1, d2 = katz.discounts(Counter(c1.values())), katz.discounts(Counter(c2.values()))
    p1 = {w: d1.get(c, 1) * c / n for w, c in c1.items()}
    unknown, held, mass = 1 - sum(p1.values()), Counter(), Counter()
    for (u, w), c in c2.items():
        held[u] += d2.get(c, 1) * c
        mass[u] += p1[w]

    def p(u, w):
        h = held[u] / all_[u] if u in held else 0
        s = all_[u] / (all_[u] + 1) if u in held and 1 - h < 1e-12 else 1
        return s * d2.get(c2[u, w], 1) * c2[u, w] / all_[u] if c2[u, w] else (1 - s * h) / (1 - mass[u]) * p1.get(w, unknown)

    for i, t in toks:
        assert abs(got[i] - sum(np.log10(p(u, w)) for u, w in zip([b" start", *t], t))) < 1e-6 * len(t)


# 9


def test_decontamination(spark):
    rng = random.Random(9)
    item = [f"item{rng.randrange(10**6)}" for _ in range(40)]
    long = [f"long{rng.randrange(10**6)}" for _ in range(5000)]
    docs = [
        (1, " ".join(long[:2500] + item + long[2500:])),
        (2, " ".join(long)),
        (3, " ".join(item[:38]).upper() + "!"),
        (4, " ".join(item[:20])),
        (5, None),
        (6, ""),
        (7, "yes, two words"),
        (None, " ".join(item)),
        (8, " ".join(item)),
        (8, "nothing here at all"),
    ]
    bench = [(10, " ".join(item)), (11, None), (12, ""), (13, "two words"), (None, " ".join(item)), (14, " ".join(item))]
    d, b = clashing(spark.createDataFrame(docs, DOCS)), spark.createDataFrame(bench, "item_id long, text string").withColumn("n", F.lit(1))
    got = {(r.doc_id, r.item_id): (r.n_shingles, r.n_found) for r in decontaminate.search(d, b).collect()}
    assert got == {**{(i, k): (36, 36) for i in (1, 8) for k in (10, 14)}, (3, 10): (36, 34), (3, 14): (36, 34), (7, 13): (1, 1)}
    assert sorted(str(r.doc_id) for r in decontaminate.drop_contaminated(d, b).collect()) == ["2", "4", "5", "6", "None"]
    assert decontaminate.search(d.limit(0), b).count() == 0 == decontaminate.search(d, b.limit(0)).count()
    plan = decontaminate.search(d, b)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_decontamination_of_repeated_ids(spark):
    """Of several texts with one id each counts by itself: one item text that is wholly there is found, whatever the other."""
    rng = random.Random(19)
    new = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    item, other, longer = new(14), new(60), new(100)
    docs = [(1, new(300) + " " + item + " " + new(300)), (2, new(50)), (2, longer), (3, item + " " + other[: len(other) // 2])]
    bench = [(10, item), (10, other), (11, longer), (11, longer), (12, "one " + longer)]
    d, b = spark.createDataFrame(docs, DOCS), spark.createDataFrame(bench, "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.n_shingles, r.n_found) for r in decontaminate.search(d, b).collect()}
    assert got == {(1, 10): (10, 10), (3, 10): (10, 10), (2, 11): (96, 96), (2, 12): (97, 96)}


def test_decontamination_equals_brute_force(spark):
    """Items of all size classes, cut down about the threshold, inside documents of many lengths; and the SQL says the same."""
    import duckdb

    rng = random.Random(20)
    new = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    items = [new(n) for n in (1, 2, 4, 5, 6, 9, 20, 40, 80, 160, 300, 700)]
    docs = [
        (k, " ".join(new(rng.randrange(200)) + ws[: max(1, round(len(ws) * cut))] + new(rng.randrange(200))))
        for k, (ws, cut) in enumerate((ws, cut) for ws in items for cut in (0.7, 0.79, 0.8, 0.81, 0.9, 1))
    ]
    bench = [(k, " ".join(ws)) for k, ws in enumerate(items)]

    def runs(text, n):
        ws = text.split()
        return {tuple(ws[k : k + n]) for k in range(len(ws) - n + 1)}

    want = {}
    for d, text in docs:
        for i, item in bench:
            n = min(5, len(item.split()))
            mine = runs(item, n)
            held = len(mine & runs(text, n))
            if held >= 0.8 * len(mine):
                want[(d, i)] = (len(mine), held)
    d, b = spark.createDataFrame(docs, DOCS), spark.createDataFrame(bench, "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.n_shingles, r.n_found) for r in decontaminate.search(d, b).collect()}
    assert got == want
    db = duckdb.connect()
    for name, df in (("documents", d), ("benchmark", b)):
        db.register(name, df.toPandas())
    said = db.sql(decontaminate.ORACLE["op9_decontaminate"]).fetchall()
    assert {(r[0], r[1]): (r[2], r[3]) for r in said} == want


# 10


def test_chat(spark):
    conv = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    raw = chat.transcripts(conv)
    model = chat.fit(raw.where(common.fold("conv_id", 5) != 0))
    parsed = chat.parse(raw.select("conv_id", "seg", "line_no", "line"), model)
    both = parsed.join(raw.select("conv_id", "line_no", F.col("role").alias("r")), ["conv_id", "line_no"]).where(common.fold("conv_id", 5) == 0)
    assert both.agg(F.avg((F.col("role") == F.col("r")).cast("int"))).first()[0] > 0.9
    odd = spark.createDataFrame(
        [(1, 0, "User: hi"), (1, 1, None), (1, 2, "Assistant: yes"), (1, 2, "Assistant: yes"), (None, 0, "x"), (2, None, "y"), (3, 0, "")],
        "conv_id long, line_no long, line string",
    ).withColumn("nth", F.lit(1))
    turns = chat.render(chat.parse(odd, model)).orderBy("conv_id", "turn").collect()
    assert [(r.conv_id, r.role) for r in turns][:2] == [(1, "user"), (1, "assistant")] and turns[0].rendered == "<|user|>\nhi\n\n<|end|>"
    assert sum(r.n_lines for r in turns) == 5
    assert chat.parse(odd.limit(0), model).count() == 0


def plain_chat(lines, states, own):
    """Turns rendered line by line from states. lines: texts."""
    turns = []
    for text, state in zip(lines, states, strict=True):
        role, later = divmod(state, 2)
        if not later:
            turns.append((chat.ROLES[role], []))
            name = re.match(r"^\s*(?:(\w+(?: \d)?)\s*[:>] ?|### (\w+)$)", text)
            said = name and (name[1] or name[2]).lower()
            if said in own and chat.ROLE_OF[said] == role:
                text = text[name.end() :]
                if not text:
                    continue
        turns[-1][1].append(text)
    return [(r, f"<|{r}|>\n" + "\n".join(x) + "\n<|end|>") for r, x in turns]


def test_chat_keeps_foreign_markers_as_text(spark):
    """Markers of another form, or another name, inside a turn are content: three lines stay one turn, all words are kept."""
    raw = chat.transcripts(spark.read.parquet("/root/testdata/sf0.01/conversations.parquet"))
    model = chat.fit(raw)
    talks = [
        ["### User", "hi there", "### Assistant", "line one", "Answer: 42", "Context: sea", "", "  indented  ", "### User", "thanks"],
        ["User: what is it?", "Bot: first", "[user] quoted", "Question: inner", "  tail ", "User: ok"],
        ["<|user|>", "<|assistant|>", "yes"],
        ["User: hello", "Assistant: line one", "Answer: 42", "Context: sea", "User: thanks  "],
    ]
    rows = spark.createDataFrame([(c, n, t) for c, talk in enumerate(talks) for n, t in enumerate(talk)], "conv_id long, line_no long, line string")
    got = defaultdict(list)
    for r in chat.render(chat.parse(clashing(rows), model)).orderBy("conv_id", "turn").collect():
        got[r.conv_id].append((r.role, r.rendered, r.n_lines))
    turn = lambda role, text, n: (role, f"<|{role}|>\n{text}\n<|end|>", n)
    assert got[0] == [turn("user", "hi there", 2), turn("assistant", "line one\nAnswer: 42\nContext: sea\n\n  indented  ", 6), turn("user", "thanks", 2)]
    assert got[1] == [turn("user", "what is it?", 1), turn("assistant", "first\n[user] quoted\nQuestion: inner\n  tail ", 4), turn("user", "ok", 1)]
    assert got[2] == [turn("user", "", 1), turn("assistant", "yes", 2)]
    assert got[3] == [turn("user", "hello", 1), turn("assistant", "line one\nAnswer: 42\nContext: sea", 3), turn("user", "thanks  ", 1)]


def test_chat_viterbi_equals_path_enumeration(spark):
    """The states found are the best of all paths, and the turns those that plain rendering makes of them."""
    from itertools import product

    rng = random.Random(21)
    train = []
    for c in range(30):
        for k in range(4):
            train.append((c, 10 * k, ("User: " if k % 2 == 0 else "Bot: ") + "text " * rng.randrange(40), "user" if k % 2 == 0 else "assistant", True))
            train.append((c, 10 * k + 1, "more " * rng.randrange(40) + rng.choice(["?", "."]), "user" if k % 2 == 0 else "assistant", False))
    model = chat.fit(spark.createDataFrame(train, "conv_id long, line_no long, line string, role string, first boolean"))
    heads = ["User: ", "Bot: ", "", "", "System: ", "Answer: ", "[user] "]
    talks = [
        ["User: start"] + [rng.choice(heads) + "word " * rng.randrange(4) + rng.choice(["?", ".", ""]) for _ in range(rng.randrange(4))]
        for _ in range(25)
    ]
    rows = spark.createDataFrame([(c, n, t) for c, talk in enumerate(talks) for n, t in enumerate(talk)], "conv_id long, line_no long, line string")
    parsed = defaultdict(list)
    for r in chat.parse(rows, model).orderBy("conv_id", "line_no").collect():
        parsed[r.conv_id].append(2 * chat.ROLES.index(r.role) + (not r.first))
    turns = defaultdict(list)
    for r in chat.render(chat.parse(rows, model)).orderBy("conv_id", "turn").collect():
        turns[r.conv_id].append((r.role, r.rendered))
    for c, talk in enumerate(talks):
        own = [None] * 3
        for t in talk:
            if (m := chat.marker(t)) and m[1][0] == "4" and own[m[0]] is None:
                own[m[0]] = m[1]
        after = [False, *(not t.strip() for t in talk[:-1])]
        scores = model.scores(np.array([chat.look(t, a, own) for t, a in zip(talk, after)]))

        def value(path):
            return model.start[path[0]] + scores[0, path[0]] + sum(model.move[a, b] + scores[k + 1, b] for k, (a, b) in enumerate(zip(path, path[1:])))

        best = max(map(value, product(range(chat.STATES), repeat=len(talk))))
        assert value(parsed[c]) == pytest.approx(best, abs=1e-9)
        assert turns[c] == plain_chat(talk, parsed[c], {o[1:] for o in own if o})


def test_chat_repeated_turns_do_not_interleave(spark):
    rows = [(1, 0, "user", "one\ntwo"), (1, 0, "user", "three\nfour"), (1, 1, "assistant", "five\nsix"), (1, 1, "assistant", "five\nsix")]
    raw = chat.transcripts(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).orderBy("seg", "line_no").collect()
    last = [r.line.split()[-1] for r in raw if chat.marker(r.line) is None or " " in r.line.strip()]
    assert sorted(last) == sorted(["one", "two", "three", "four", "five", "six", "five", "six"])
    assert all(last[last.index(a) + 1] == b for a, b in (("one", "two"), ("three", "four"), ("five", "six"))) and last[-2:] == ["five", "six"]


def test_chat_segments_stay_together(spark):
    """Adaptive execution may turn a join by segment into a broadcast join, which leaves rows where they lie; segments must be dealt all the same."""
    conv = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    raw = chat.transcripts(conv)
    model = chat.fit(raw)
    lines = raw.select("conv_id", "seg", "line_no", "line").repartition(7)
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    made = []
    for first, later in (("-1", "10m"), ("10m", "10m"), ("-1", "-1")):
        for name, value in zip(names, (first, later), strict=True):
            spark.conf.set(name, value)
        parsed = common.stored(chat.parse(lines, model), "parsed")
        made.append(sorted((r.conv_id, r.turn, r.rendered) for r in chat.render(parsed).collect()))
        assert parsed.where("first").count() == len(made[-1])
    for name in names:
        spark.conf.unset(name)
    assert made[0] == made[1] == made[2]


def test_chat_keeps_turns_of_copies(spark):
    """Twenty copies of each turn under its own key keep the turns of twenty, but for first turns without a marker, which join what stands before."""
    conv = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").where("conv_id < 12")
    model = chat.fit(chat.transcripts(conv))
    turns = lambda c: chat.render(chat.parse(chat.transcripts(c).select("conv_id", "seg", "line_no", "line"), model)).count()
    assert turns(conv.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(20))))) >= 0.9 * 20 * turns(conv) > 0


def test_chat_segments_equal_one_pass(spark):
    rng = random.Random(10)
    heads = ["User: ", "Assistant: ", "", "", "System: ", "> ", "### user"]
    lines = spark.createDataFrame(
        [(1, i, rng.choice(heads) + "text " * rng.randrange(30) + rng.choice(["?", "."])) for i in range(900)], "conv_id long, line_no long, line string"
    )
    model = chat.fit(lines.limit(0).withColumn("role", F.lit("user")).withColumn("first", F.lit(True)))
    cut, whole = (
        sorted((r.line_no, r.role, r.turn) for r in chat.parse(lines.withColumn("seg", s), model).collect())
        for s in (F.floor(F.col("line_no") / 70), F.lit(0))
    )
    assert cut == whole


def test_pipeline(spark):
    import corpus_pipeline as p

    assert [n for n, _ in p.STAGES] == ["toxicity", "line dedup", "near dedup", "decontamination", "bpe"] and p.ORACLE_SQL is None
    docs = common.table(spark, SF, "documents")
    for _, stage in p.STAGES[:-1]:
        after = common.stored(stage(spark, docs, SF), "t")
        assert after.columns == docs.columns and 0 < after.count() <= docs.count()
        docs = after
    got = {r.doc_id: r for r in p.STAGES[-1][1](spark, docs, SF).collect()}
    codec = bpe.Codec(bpe.default_path())
    for r in docs.collect():
        assert got[r.doc_id].n_tokens == len(codec.encode(r.text)) and got[r.doc_id].decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest()
