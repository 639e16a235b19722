"""Results that SQL cannot state, as a whole: toxicity scores from a plain distance table, and the pipeline's rows from plain loops."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import regex
from test_ops import DOCS, brute_lines, brute_near, clashing

from flowloom.llm import bpe, common, toxicity

SF = "/root/testdata/sf0.001"
STRONG = {"villain": False, "scoundrel": False, "wretch": True, "oaf": False, "scum": True, "blighter": True}
WEAK = {"fool": False, "dull": True}


def distances(word, term):
    """Optimal string alignment of the term and each beginning of the word."""
    rows = [list(range(len(term) + 1))]
    for i, c in enumerate(word, 1):
        row = [i]
        for j, t in enumerate(term, 1):
            row.append(min(rows[i - 1][j] + 1, row[j - 1] + 1, rows[i - 1][j - 1] + (c != t)))
            if i > 1 and j > 1 and c == term[j - 2] and word[i - 2] == t:
                row[j] = min(row[j], rows[i - 2][j - 2] + 1)
        rows.append(row)
    return [r[-1] for r in rows]


def kind_of(word, strong, weak):
    for kind, terms in ((1, strong), (2, weak)):
        if any(word == t or stem and word.startswith(t) for t, stem in terms.items()):
            return kind
    if len(word) < 5:
        return 0
    if any(not stem and distances(word, t)[-1] == 1 for t, stem in strong.items() if abs(len(t) - len(word)) < 2):
        return 3
    return 4 * any(stem and len(t) >= 5 and min(distances(word, t)) == 1 for t, stem in strong.items())


def brute_features(text, strong, weak, memo):
    """Counts over all words, each with the six pieces (words and quotation marks) before and after it."""
    pieces = regex.findall(r"\p{L}+|[\"“”„«»‹›]", (text or "").lower())
    words = [w for w in pieces if w not in toxicity.QUOTES]
    for w in set(words) - memo.keys():
        memo[w] = kind_of(w, strong, weak)
    kinds = Counter(memo[w] for w in words)
    if not set(kinds) - {0}:
        return [0.0] * 6
    marks = [k for k, w in enumerate(pieces) if w in toxicity.QUOTES]
    quoted = addressed = 0
    for k, w in enumerate(pieces):
        if w in toxicity.QUOTES or memo[w] not in (1, 3):
            continue
        before = sum(m < k for m in marks)
        near = set(pieces[max(0, k - 6) : k]) | set(pieces[k + 1 : k + 7])
        quoted += bool(before % 2 and before < len(marks) or near & toxicity.REPORTS)
        addressed += bool(near & toxicity.ADDRESS)
    hits = kinds[1] + 0.75 * kinds[3]
    seldom = len({w for w in words if memo[w] == 2})
    logs = [math.log(1 + x) for x in (hits, kinds[4], 100 * seldom / len(words), quoted, addressed)]
    return [*logs, hits / len(words)]


def brute_score(text, model, memo):
    z = sum(a * b for a, b in zip(model.weights, [*brute_features(text, model.strong, model.weak, memo), 1.0], strict=True))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def misspelled(rng, word):
    k = rng.randrange(len(word))
    return rng.choice([word[:k] + word[k + 1 :], word[:k] + "x" + word[k:], word[:k] + "x" + word[k + 1 :], word[:k] + word[k : k + 2][::-1] + word[k + 2 :]])


def test_scores_equal_a_plain_distance_table(spark):
    rng = random.Random(31)
    terms, plain = [*STRONG, *WEAK], ["morning", "vilify", "wrench", "scummy", "of", "a1b", "oak", "größe", "blight", "ét"]
    pool = [*"\"“”«»", "said", "écrit", "you", "dich", "...", "7"]
    rows = [(1, None), (2, ""), (3, "42 !?"), (None, "villain"), (4, 'you "villain" ' * 3000), (5, "villain" * 5000)]
    for i in range(6, 400):
        ws = []
        for _ in range(rng.randrange(60)):
            draw = rng.random()
            ws.append(rng.choice(plain) if draw < 0.6 else rng.choice(pool) if draw < 0.8 else rng.choice(terms))
            if draw > 0.87:
                ws[-1] = rng.choice((misspelled(rng, ws[-1]), ws[-1].upper(), ws[-1] + "ed"))
        rows.append((i, rng.choice((" ", "\n", " - ")).join(ws)))
    rows += rows[10:20]
    model = toxicity.Model(STRONG, WEAK, [1.3, 0.7, 0.4, -0.9, 0.6, 2.0, -1.1])
    memo: dict = {}
    want = Counter((i, round(brute_score(t, model, memo), 10)) for i, t in rows)
    assert {memo[w] for w in memo} == {0, 1, 2, 3, 4}
    got = Counter((r.doc_id, round(r.score, 10)) for r in toxicity.score(clashing(spark.createDataFrame(rows, DOCS)), model).collect())
    assert got == want


def test_learned_model_equals_plain_counts(spark):
    """Terms from counts by hand, copies as one document; weights at which the penalised likelihood is flat."""
    rng = random.Random(32)
    plain = ["".join(rng.choice("bcdfghklmnprst") + rng.choice("aeiou") for _ in range(4)) for _ in range(3000)]
    texts = []
    for i in range(360):
        ws = rng.sample(plain, 40)
        if i % 3 == 0:
            ws[3:6] = [rng.choice(("villain", "wretched", "wretches", "wretchedly")), "qux", rng.choice(plain)]
        texts.append(" ".join(ws))
    texts += [texts[0]] * 30 + [texts[1]] * 30  # copies must not pass their words off as terms
    label = [int(i % 3 == 0) for i in range(360)] + [1] * 30 + [0] * 30
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS)
    model = toxicity.fit(docs, spark.createDataFrame([(i, 1, y) for i, y in enumerate(label)], "doc_id long, quality int, toxic int"), held=None)
    count: dict = defaultdict(lambda: [0] * 6)
    distinct = set(zip(texts, label, strict=True))
    for text, y in distinct:
        words = set(text.split())
        starts = Counter(w[:n] for w in words for n in range(3, min(40, len(w)) + 1))
        for t, n in starts.items():
            count[t][1 - y] += 1
            count[t][5 - y] += n > 1
        for w in words:
            count[w][3 - y] += 1
    rows, sizes = [(t, *count[t]) for t in sorted(count)], [sum(y == c for _, y in distinct) for c in (1, 0)]
    assert model.strong == toxicity.choose_terms(rows, *sizes, 0.95) and model.weak == toxicity.choose_terms(rows, *sizes, 0.5, families=True)
    assert all(toxicity.Lexicon(model.strong).edits(w) == 0 for w in ("villain", "wretched", "wretches", "qux"))
    memo: dict = {}
    x = np.array([[*brute_features(t, model.strong, model.weak, memo), 1.0] for t in texts])
    w = np.array(model.weights)
    flat = x.T @ (np.array(label) - 1 / (1 + np.exp(-x @ w))) - np.r_[np.ones(6), 1e-6] * w
    assert abs(flat).max() < 1e-4


@pytest.fixture
def planted(spark, tmp_path):
    """The least tables, with near copies, lines in ten documents, benchmark passages, toxic, empty and null texts added."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").limit(4).collect()
    base = docs.orderBy("doc_id").limit(12).collect()
    rng, new = random.Random(33), 10**6
    more = []
    for r in base:
        ws = (r.text or "").split(" ")
        more += [" ".join(ws), " ".join([*ws, "one", "more"]), " ".join(ws[: len(ws) - len(ws) // 7]), " ".join(ws[: len(ws) // 2])]
    more += [f"a line of all\nown {k} " + " ".join(str(rng.random()) for _ in range(30)) for k in range(11)]
    more += [f"before {k} {r.text} after {k}" for k, r in enumerate(bench)] + ["", None, "", "A b", "a B"]
    word = lambda: "".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(4))
    foul = range(new + len(more), new + len(more) + 60)
    more += [" ".join([word(), word(), "zounderkite", *(word() for _ in range(30))]) for _ in foul]
    rows = [{**base[0].asDict(), "doc_id": new + k, "text": t} for k, t in enumerate(more)]
    docs.unionByName(spark.createDataFrame(rows, docs.schema)).write.parquet(str(tmp_path / "documents.parquet"))
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    told = spark.createDataFrame([dict.fromkeys(labels.columns) | {"doc_id": i, "toxic": 1} for i in foul], labels.schema)
    labels.unionByName(told).write.parquet(str(tmp_path / "labels.parquet"))
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path)


def test_pipeline_equals_plain_loops(spark, planted):
    from tokenizers import Tokenizer

    import corpus_pipeline as p

    docs, labels, bench = (common.table(spark, planted, n) for n in ("documents", "labels", "benchmark"))
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    model, memo = toxicity.fit(docs, labels, held=None), {}
    counts = [len(rows)]
    rows = [(i, t) for i, t in rows if brute_score(t, model, memo) < 0.5]
    counts.append(len(rows))
    dropped = sum(r[2] for r in brute_lines(rows, 10))
    rows = [(i, t) for i, _, _, t in brute_lines(rows, 10)]
    stay = brute_near(rows)
    rows = [(i, t) for i, t in rows if i in stay]
    counts.append(len(rows))

    def runs(ws, n):
        return {tuple(ws[k : k + n]) for k in range(len(ws) - n + 1)}

    words = {i: [w for w in regex.split(r"[^\p{L}\p{N}]+", t.lower()) if w] for i, t in rows}
    held: set = set()
    for item in bench.collect():
        ws = [w for w in regex.split(r"[^\p{L}\p{N}]+", (item.text or "").lower()) if w]
        if ws:
            n = min(5, len(ws))
            mine = runs(ws, n)
            held |= {i for i, theirs in words.items() if len(mine & runs(theirs, n)) >= 0.8 * len(mine)}
    rows = [(i, t) for i, t in rows if i not in held]
    counts.append(len(rows))
    assert dropped >= 11 and all(b < a for a, b in zip(counts, counts[1:], strict=False)), counts  # every stage has work
    library, sha = Tokenizer.from_file(bpe.default_path()), lambda s: hashlib.sha256(s.encode()).hexdigest()
    library.no_truncation()
    library.no_padding()
    want = {}
    for i, t in rows:
        ids = library.encode(t, add_special_tokens=False).ids
        want[i] = (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))
    got = p.run(spark, planted).collect()
    assert len(got) == len(want) and {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got} == want
