"""Alignment, main text and ranked search against brute force, with nulls, ties, repeats, empty tables and clashing columns."""

import hashlib
import itertools
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowloom.llm import align, main_text, ranked
from flowloom.llm.bpe import byte_letters

DOCS = "doc_id long, text string"


def clashing(df):
    extra = {x: F.lit(1) for x in ("n", "terms", "counts", "block", "data", "score", "rank", "n_a", "h", "item", "mark", "feature")}
    return df.withColumns({k: v for k, v in extra.items() if k not in df.columns})


# 11


@pytest.fixture(scope="module")
def tokenizers():
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    letter = {c: k for k, c in enumerate(byte_letters())}
    a_bytes = {i: bytes(letter[c] for c in t) for t, i in a.get_vocab().items() if all(c in letter for c in t)}

    def b_bytes(i):
        p = b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode()

    def encode(text):
        if not text:
            return [], []
        x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        x, y = [(i, a_bytes[i]) for i in x], [(i, b_bytes(i)) for i in y]
        whole = (" " + text).encode()
        return (x, y) if b"".join(t for _, t in x) == b"".join(t for _, t in y) == whole else ([], [])

    return encode


def brute_align(rows, encode):
    made = []
    for i, text in rows:
        a, b = encode(text)
        ends = [set(itertools.accumulate(len(t) for _, t in s)) for s in (a, b)]
        groups, common = [], sorted(ends[0] & ends[1]) if a else []
        low = 0
        for high in common:
            part = []
            for s in (a, b):
                at, got = 0, []
                for k, t in s:
                    if low <= at < high:
                        got.append(k)
                    at += len(t)
                part.append(got)
            groups.append(part)
            low = high
        links = Counter((x, y) for p, q in groups for x in p for y in q)
        made.append((i, len(a), len(b), groups, links))
    count = Counter(k for *_, links in made for k in links)
    best = defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    out = []
    for i, n_a, n_b, groups, links in made:
        said = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups)
        n_best = sum(n for k, n in links.items() if count[k] == best[k[0]])
        total = sum(n * count[k] for k, n in links.items())
        out.append((i, n_a, n_b, len(groups), sum(links.values()), n_best, total, hashlib.sha256(said.encode()).hexdigest() if n_a else ""))
    return sorted(out, key=str), made


ALIGNED = [
    (1, None),
    (2, ""),
    (3, " "),
    (4, "the quick  brown fox\n\tjumps   "),
    (5, "Ünïcödé 漢字かな交じり文 \U0001f600\U0001f3fd z"),
    (6, "<|endoftext|> <s> </s> <unk> <0x0A>"),
    (7, "lower ▁ one eighth block"),
    (8, "null \x00 and   and ​"),
    (9, "the quick brown fox"),
    (9, "the quick brown fox"),
    (None, "no id, the quick"),
    (10, "unbelievablywovencompounds " * 3 + "qzxj" * 40),
    (11, "the word\n" * 3000),
]


def test_align(spark, tokenizers):
    want, made = brute_align(ALIGNED, tokenizers)
    df = clashing(spark.createDataFrame(ALIGNED, DOCS).repartition(3))
    for piece, block in ((align.PIECE, align.BLOCK), (3, 5)):
        got = sorted((tuple(r) for r in align.align(df, piece=piece, block=block).collect()), key=str)
        assert got == want
    assert align.align(df).columns == [f.name for f in align.RESULT]
    assert align.align(df.limit(0)).count() == 0 and align.groups(df.limit(0)).count() == 0
    rows = defaultdict(list)
    for r in align.groups(df.where("doc_id IN (4, 5)"), piece=2).orderBy("doc_id", "group_no").collect():
        rows[r.doc_id].append([list(r.a_ids), list(r.b_ids)])
        assert r.start < r.end
    assert all(rows[i] == groups for i, _, _, groups, _ in made if i in (4, 5))


def test_align_texts_that_end_in_one_space(spark, tokenizers):
    rows = [(1, "the quick "), (2, "ก "), (3, "the\n "), (4, "the  "), (5, "the quick"), (6, "  "), (7, "\t ")]
    want, _ = brute_align(rows, tokenizers)
    assert all(r[1] and r[2] for r in want)
    assert sorted((tuple(r) for r in align.align(spark.createDataFrame(rows, DOCS)).collect()), key=str) == want


def test_merge_path_pieces():
    draw = random.Random(5)
    for _ in range(60):
        end = draw.randint(1, 60)
        a, b = (np.array(sorted({*draw.sample(range(1, end + 1), draw.randint(0, end)), end})) for _ in "ab")
        common = sorted(set(a.tolist()) & set(b.tolist()))
        want = [[a.tolist().index(x) + 1, b.tolist().index(x) + 1] for x in common]
        for piece in (1, 2, 7, 1000):
            assert align.cuts(a, b, piece).tolist() == want
            limits = align.diagonals(a, b, piece)
            work = np.diff(limits, axis=0).sum(axis=1)
            assert set(work[:-1]) <= {piece} and limits[-1].tolist() == [len(a), len(b)]
            found = [x for s, e in itertools.pairwise(limits) for x in zip(*(y.tolist() for y in align.overlaps(a, b, s, e)), strict=True)]
            lows = [np.r_[0, x[:-1]].tolist() for x in (a, b)]
            assert [x[:2] for x in found] == [(i, j) for i in range(len(a)) for j in range(len(b)) if lows[0][i] < b[j] and lows[1][j] < a[i]]


def test_wide_groups(monkeypatch):
    a, b = np.array([1, 2, 1, 3, 5, 5]), np.array([7, 8, 7, 9])
    p, q, of = np.array([4, 2]), np.array([3, 1]), np.array([0, 1])
    want = Counter((0, x, y) for x in (1, 2, 1, 3) for y in (7, 8, 7)) + Counter((1, 5, 9) for _ in range(2))
    for wide in (1, 4, 1000):
        monkeypatch.setattr(align, "WIDE", wide)
        got = Counter()
        for part in align.linked(a, b, of, p, q):
            for t, x, y, n in zip(*(z.tolist() for z in part), strict=True):
                got[t, x, y] += n
        assert got == want


# 12


def cost_of(labels, terminal, edges):
    own = sum(max(0.0, -t) if x else max(0.0, t) for x, t in zip(labels, terminal, strict=True))
    return own + sum(w for u, v, w in edges if labels[u] != labels[v])


def test_min_cut():
    draw = random.Random(3)
    for _ in range(150):
        n = draw.randint(1, 9)
        terminal = [draw.choice([0, draw.randint(-6, 6)]) / 2 for _ in range(n)]
        edges = [(*draw.sample(range(n), 2), draw.randint(1, 6) / 2) for _ in range(draw.randint(0, 2 * n) if n > 1 else 0)]
        got = main_text.min_cut(terminal, edges)
        least = min(cost_of(x, terminal, edges) for x in itertools.product((False, True), repeat=n))
        assert math.isclose(cost_of(got, terminal, edges), least, abs_tol=1e-6)


LONG = "This paragraph holds many words of the article, and it ends with a stop, as paragraphs do in most pages."
PAGE = f"""<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{{margin:0}}</style><script>var x = "</p><p>not text</p>";</script></head>
<body class="with-sidebar"><header><h1>Site name</h1><a href="/">Home</a></header><nav><ul><li><a href=1>One</a><li><a href="2">Two</a></ul></nav>
<!-- <p>no</p> --><div class="ad">Buy this now.</div><main><article><header><h1>The&nbsp;title</h1></header><p>{LONG}<br>{LONG}<p>Short.
<ul><li>Point <b>one</b></li><li>Point two</li></ul><aside><p>{LONG}</p></aside><blockquote>Quoted &lt;words&gt;</blockquote>
<form><p>Your mail</p><input name=a><button>Send</button></form><p hidden>{LONG}</p><p style="display: none">{LONG}</p></article>
<section id="comments"><h2>Comments</h2><article class="comment"><p>{LONG}</p></article></section></main>
<footer>&copy; site &middot; words</footer><div class="cookie-notice">We use cookies. {LONG}</div></body></html>"""
BARE = f"""<html><body><div><a href="/">Home</a> <a href=/x>About us</a></div><div><h1>A title</h1>{LONG}<p>Short one.<p>{LONG}
<ul><li>First point of it</li></ul><p>{LONG}</div><div><a href=1>Some other story</a><br><a href=2>And another</a></div><div>&copy; 2020 site</div></body></html>"""


def test_main_text():
    odds = main_text.log_odds({})
    quoted = "\n".join(["The title", f"{LONG} {LONG}", "Short.", "Point one", "Point two", "Quoted <words>"])
    assert main_text.main_text(PAGE, odds) == quoted
    assert main_text.main_text(BARE, odds) == "\n".join(["A title", LONG, "Short one.", LONG, "First point of it", LONG])
    whole = f'<form id="aspnet"><div class="header-less sidebar-page"><p>{LONG}</p><p>{LONG}</p></div></form>'  # names that the whole page has
    assert main_text.main_text(whole, odds) == f"{LONG}\n{LONG}"
    cut = f"<article><p>{LONG}</p><p>Last words<a hre"
    assert main_text.main_text(cut, odds) == f"{LONG}\nLast words"
    assert main_text.main_text(f"<article><p>1 < 2 &amp; <b title='a>b'>{LONG}", odds) == f"1 < 2 & {LONG}"
    for x in (None, "", "<p></p>", "<script>x", "<!-- x", "<nav>Menu</nav>"):
        assert main_text.main_text(x, odds) == ""
    assert main_text.main_text(LONG, odds) == LONG
    many = "<article>" + "<p>a b</p>" * 20000 + "</article>"
    assert main_text.main_text(many, odds).count("\n") == 19999
    deep = "<div>" * 3000 + f"<p>{LONG}</p>"
    assert main_text.main_text(deep, odds) == LONG


def test_extract(spark):
    rows = [(1, "u", PAGE), (2, None, None), (3, "v", ""), (1, "u", PAGE), (None, "w", BARE)]
    df = clashing(spark.createDataFrame(rows, "page_id long, url string, html string"))
    got = main_text.extract(df, main_text.log_odds({})).collect()
    assert sorted(map(str, ((r.page_id, r.url, r.n_chars == len(r.text) > 0) for r in got))) == sorted(
        map(str, [(1, "u", True), (1, "u", True), (2, None, False), (3, "v", False), (None, "w", True)])
    )
    assert main_text.extract(df.limit(0)).count() == 0
    learned = main_text.fit(df)
    assert learned["links 3"] < 0 < learned["words 4"] and learned.keys() == main_text.PRIOR.keys()


# 13


def brute_ranks(docs, items, top=50):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    own = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    n, total = len(own), sum(sum(c.values()) for _, c in own)
    df = Counter(t for _, c in own for t in c)
    asked = defaultdict(set)
    for i, t in items:
        asked[i] |= set(terms(t))
    out = []
    for i, q in asked.items():
        found = []
        for d, c in own:
            m = 50 + (50 * sum(c.values()) * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in q if c[t])
            if s > 0:
                found.append((-s, d is None, d))
        out += [(i, r, d, -s) for r, (s, _, d) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:top], 1)]
    return sorted(out, key=str)


def test_ranked(spark):
    draw = random.Random(9)
    words = [f"w{k}" for k in range(40)] + ["Ärger", "漢字", "ABC", "x_y", " "]
    text = lambda most: " ".join(draw.choice(words[: draw.randint(1, len(words))]) for _ in range(draw.randint(0, most)))
    docs = [(k, text(60)) for k in range(400)] + [(7, "w1 w2 w3")] * 30 + [(None, "w1 W2, w3"), (900, None), (901, ""), (902, "w5 " * 5000)]
    docs += [(1000 + k, "w1 w2 w3") for k in range(80)]
    items = [(k, text(12)) for k in range(12)] + [(3, "w39 abc"), (50, None), (51, ""), (52, "nowhere"), (None, "w4 w7")]
    df = clashing(spark.createDataFrame(docs, DOCS).repartition(3))
    asked = clashing(spark.createDataFrame(items, "item_id long, text string"))
    for top, lot, block in ((50, ranked.LOT, 4), (5, 9, 2)):
        got = sorted((tuple(r) for r in ranked.search(df, asked, top, lot, block).collect()), key=str)
        assert got == brute_ranks(docs, items, top)
    assert ranked.search(df.limit(0), asked).count() == 0 and ranked.search(df, asked.limit(0)).count() == 0
    assert ranked.search(df, asked).columns == ["item_id", "rank", "doc_id", "score"]


def test_blocks_are_skipped(monkeypatch):
    """A query whose best are found early scores few documents; the result is that of scoring all."""
    rng = np.random.default_rng(1)
    cells = (rng.random((2000, 6)) < 0.5) * rng.integers(1, 1000, (2000, 6))
    cells[:40] = 100_000  # clear winners, alike
    cells = cells.astype(np.int32)
    ids, terms, weights = np.arange(2000), np.arange(6), np.array([5, 4, 3, 2, 2, 1])
    query, scored = ranked.Query(terms, weights, 10), []
    offer = query.offer
    monkeypatch.setattr(query, "offer", lambda i, s: (scored.append(len(i)), offer(i, s)))
    ranked.Shard(ids, cells, 16).search(query, [terms] * 6)
    want = sorted(zip((cells.astype(np.int64) @ weights).tolist(), (-ids).tolist(), strict=True), reverse=True)[:10]
    assert sorted(query.best, reverse=True) == want and sum(scored) < 1000
