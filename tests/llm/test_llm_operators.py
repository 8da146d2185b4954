"""Each operator against a brute-force version on documents with every odd case."""

import hashlib
import math
import re
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import html_text, language, mixing, near_dedup, packing, quality_model, quality_rules, sharding, substring_dedup, topk
from quire.llm.components import components
from quire.llm.scratch import Scratch

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall(text or "")


def by_id(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x) for x in r))


# 1 near-dedup


def shingles(text):
    w = words((text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_near_duplicates(docs, documents):
    sets = [(d, shingles(t)) for d, t, *_ in documents]
    parent = {d: d for d, _ in sets if d is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, x), (b, y) in combinations(sets, 2):
        if a is not None and b is not None and x and y and 100 * len(x & y) >= 75 * len(x | y):
            low, high = sorted((root(a), root(b)))
            parent[high] = low
    got = near_dedup.near_duplicates(docs).collect()
    assert len(got) == len(documents)
    with_id = [r for r in got if r.doc_id is not None]
    assert by_id({(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in with_id}) == by_id({(d, len(s), root(d), root(d) == d) for d, s in sets if d is not None})
    # A row without an id whose text others have belongs to their component; it is not what stands for them.
    (none,) = [r for r in got if r.doc_id is None]
    assert none.component_id == 4
    kept = near_dedup.deduplicated(docs)
    ids = [r[0] for r in kept.select("doc_id").collect()]
    assert kept.columns == docs.columns and len(ids) == len(set(ids)) and 22 not in ids and 50 in ids


def test_near_duplicates_of_nothing(empty):
    assert near_dedup.near_duplicates(empty).count() == 0
    assert near_dedup.deduplicated(empty).count() == 0


def test_a_large_group_around_the_threshold(spark):
    """Edited copies of one text, from much alike to hardly: the bound on candidates loses no link."""
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(150):
        text = list(base)
        for at in rng.integers(0, 120, rng.integers(0, 9)):
            text[at] = f"e{rng.integers(0, 40)}"
        rows.append((i, " ".join(text)))
    sets = [shingles(t) for _, t in rows]
    parent = list(range(150))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, x), (b, y) in combinations(enumerate(sets), 2):
        if 100 * len(x & y) >= 75 * len(x | y):
            low, high = sorted((root(a), root(b)))
            parent[high] = low
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: root(i) for i in range(150)} and 20 < len(set(got.values())) < 130


def test_near_duplicates_beside_clashing_columns(spark):
    rows = [(1, "a b c d e f", 7, 8, 9), (2, "a b c d e f", 7, 8, 9), (2, "other words of a text that is alone", 7, 8, 9), (None, None, 7, 8, 9)]
    for some in (rows, rows[:2] + rows[3:]):
        got = near_dedup.deduplicated(spark.createDataFrame(some, "doc_id long, text string, __id long, __NUMBER long, node long")).collect()
        assert by_id([(r.doc_id, r.text) for r in got]) == by_id([x[:2] for x in [some[0], *some[2:]]])


def test_many_hubs(spark):
    """A chain of texts, each like the next only, is one component; so is a star."""
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(base[4 * i : 4 * i + 100])) for i in range(25)]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.component_id for r in got} == {0}


def test_texts_of_a_repeated_id_are_judged_one_by_one(spark):
    from conftest import prose

    a, b, c = prose(1, 120), prose(2, 120), prose(3, 120)
    near = " ".join([*c.split()[:-1], "changed"])
    rows = [(5, a), (5, b), (5, b), (7, a), (7, c), (7, near), (9, b), (None, a)]
    got = near_dedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    texts = by_id({(r.doc_id, r.text) for r in got})
    assert len(got) == 4 and {(5, a), (5, b), (None, a)} <= {(r.doc_id, r.text) for r in got}, texts
    assert [r.text in (c, near) for r in got if r.doc_id == 7] == [True]


def test_pairs_that_share_a_single_band(spark):
    """1 and 2 are alike (18 of 24) and share one band key, in a bucket whose hubs are like neither."""
    w = [f"s42081x{i}" for i in range(28)]
    rows = [(0, " ".join([*w, *(f"h18y{i}" for i in range(20))])), (1, " ".join(w)), (2, " ".join(w[:22]))]
    raw = [np.frombuffer(t.encode(), np.uint8) for _, t in rows]
    x, a, b = near_dedup.band_keys(near_dedup.signatures([near_dedup.shingle_sets(r, np.array([0, len(r)]))[0] for r in raw]))
    assert (a == b).sum() == 1 and (x == a)[a == b].all()
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert by_id({(r.doc_id, r.component_id) for r in got}) == by_id({(0, 0), (1, 1), (2, 1)})


def test_posterior_bounds():
    assert near_dedup.least_matches(32) < 24 and near_dedup.least_matches(256) < 192
    # What is pruned at the threshold itself, over all batches, stays within the stated probability.
    p = 0.75 + 0.25 / 256
    for n in range(32, 257, 32):
        m = near_dedup.least_matches(n)
        assert sum(math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(m)) <= 2 * near_dedup.MISS


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 200), (200, 150), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "test"), "c").collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 150: 100, 200: 100}


# 2 top-k


@pytest.mark.parametrize("k", [1, 5, 200])
def test_topk(spark, k):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(60)]
    rows += [(100 + i, rows[3][1]) for i in range(30)]  # ties
    rows += [(200, None), (201, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (202, [float("nan")] * 6), (203, [float("inf")] * 6), (None, [1.0] * 6), (204, [1.0, 2.0]), (220, [3.0, 1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit(0)).withColumn("score", F.lit("x"))
    usable = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    wanted = []
    for q, x in usable:
        if q % 20 == 0:
            scored = sorted((-sum(a * b for a, b in zip(x, y, strict=True)), c) for c, y in usable if c != q and len(x) == len(y))
            wanted += [(q, n + 1, c, -s) for n, (s, c) in enumerate(scored[:k])]
    got = topk.search(frame, F.col("vec_id") % 20 == 0, k).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == sorted(wanted)


def test_topk_of_nothing(spark):
    assert topk.search(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0).count() == 0


def best_by_hand(vectors, k):
    whole = [(d, [math.floor(64 * x) for x in v]) for d, v in vectors]
    out = set()
    for q, x in whole:
        if q % 20 == 0:
            scores = sorted((-min(max(sum(a * b for a, b in zip(x, y)), -topk.LIMIT), topk.LIMIT), d) for d, y in whole if d != q)
            out |= {(q, i + 1, d, -s) for i, (s, d) in enumerate(scores[:k])}
    return out


@pytest.mark.parametrize("large", [1e3, 3e4, 2e5, 3e7, 1e30])
def test_one_large_vector(spark, large):
    """A vector whose scores need more bits than its block's others, and k above a block's share."""
    rng = np.random.default_rng(3)
    vectors = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(80)] + [(80, [large] + [0.5] * 7)]
    frame = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").repartition(8, "vec_id")
    got = topk.search(frame, F.col("vec_id") % 20 == 0, k=20).collect()
    assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in got} == best_by_hand(vectors, 20)


def test_tiles(spark, monkeypatch):
    """Cells of several tiles (the workers fork with the smaller ones only if they are passed on, so in this process)."""
    monkeypatch.setattr(topk, "QUERY_TILE", 3)
    monkeypatch.setattr(topk, "TILE", 4)
    rng = np.random.default_rng(4)
    x, y = rng.integers(-9, 9, (7, 5)), rng.integers(-9, 9, (10, 5))
    row = lambda v, ids: {"dim": 5, "n": len(v), "most": int(np.abs(v).max()), "vectors": v.astype(np.int32).tobytes(), "ids": np.array(ids, np.int64).tobytes()}
    low = np.full(7, -(5 * 81))
    found = np.full((7, 10), 0)
    for i, j, s in topk._tiles(row(x, range(7)), row(y, range(100, 110)), low):
        found[i : i + s.shape[0], j : j + s.shape[1]] = s
    assert (found == x @ y.T).all()


# 3 packing


def test_packing(docs, documents):
    from tokenizers import Tokenizer

    path = packing.tokenizer_path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    pieces = packing.packed(docs, path, size=256).collect()
    ids = {}
    for p in sorted(pieces, key=lambda p: (p.doc_id is None, p.doc_id, p.sequence_id)):
        assert len(p.ids) == 4 * p.length and p.length > 0
        ids.setdefault(p.doc_id, []).append((p.start, np.frombuffer(p.ids, "<u4").tolist(), p.doc_tokens))
    for d in {d for d, *_ in documents}:
        texts = [t for i, t, *_ in documents if i == d]
        wanted = [tokenizer.encode(t or "", add_special_tokens=False).ids + [1] for t in texts]
        got = sorted(ids[d])
        assert all(n == len(wanted[0]) for _, _, n in got)
        flat = Counter((s + k, x) for s, part, _ in got for k, x in enumerate(part))
        assert flat == Counter((k, x) for w in wanted for k, x in enumerate(w))
    by_sequence = {}
    for p in pieces:
        by_sequence.setdefault(p.sequence_id, []).append((p.offset, p.length))
    filled = []
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
        filled.append(at)
    assert sum(f < 256 for f in filled) <= docs.rdd.getNumPartitions()


def test_packing_balances_costs():
    lengths = np.array([100] * 64 + [10] * 640)
    doc, start, length, sequence, offset = packing.pack(lengths, 400)
    cost = np.bincount(sequence, length + packing.QUADRATIC * length**2)
    assert length.sum() == lengths.sum() and cost[:-1].max() < 1.02 * cost[:-1].min()


def test_word_ids_equal_the_tokenizer():
    import pyarrow as pa
    from tokenizers import Tokenizer

    from quire.llm.words import chunks

    path = packing.tokenizer_path("word_bpe_49k.json")
    texts = ["", " \t\n", "<|endoftext|> a<|startoftext|>b", "é ΣΑΣ ΟΔΟΣ İstanbul x\x1cy a b c d e\x85f", "中文 字 한국어 \x0b \x0c z", "1234 12a3 don't I'LL ½² ª", "😀😀 a😀b", "DON'T’s ﬁ ǅ ẞ ß", "word " * 3000]
    own, encoder = [], packing.WordIds(path)
    for _, _, raw, starts in chunks(pa.array(texts)):
        ids, at = encoder(raw, starts)
        own += [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)]
    assert own == [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]


# 4 HTML

ARTICLE = "<h1>Title of it</h1><p>First paragraph with a good many words in it, as text has.</p><p>Short.</p><p>Another one &amp; more words to\n read, <a href='x'>linked</a> in part.</p>"
CLEAN = "Title of it\n\nFirst paragraph with a good many words in it, as text has.\n\nShort.\n\nAnother one & more words to read, linked in part."


@pytest.mark.parametrize(
    "page",
    [
        f"<html><head><title>T</title><style>p{{}}</style></head><body><nav><ul><li><a href=x>Home</a></ul></nav><article>{ARTICLE}</article><footer>&copy; all</footer></body></html>",
        f"<body><header>Site name and slogan</header><main>{ARTICLE}</main><aside>Side bar text that is rather long and full of words.</aside></body>",
        f"<body><div class='cookie-notice'>We use cookies to make this better for you.</div><div class=content>{ARTICLE}</div><section id='comments'><p>A reader says that this is a fine article indeed.</p></section></body>",
        f"<body><form><label>Name</label><input><button>Go</button></form><script>var x = '<p>no</p>';</script><div>{ARTICLE}</div><div class='ad'>Buy this now, it is cheap and good.</div><div><a href=1>One</a> <a href=2>Two</a> <a href=3>Three</a></div></body>",
        f"<body><article>{ARTICLE}</article><div class='sidebar'><ul><li><a href=x>Other story</a></li></ul></div>",
        f"<body><ul class=menu><li><a href=a>A</a><li><a href=b>B</a></ul><article>{ARTICLE}<div class=comments><p>First!</p></div></article>",
    ],
)
def test_main_text(page):
    assert html_text.main_text(page) == CLEAN


PROSE = "<p>First paragraph with a good many words in it, as text has, and some more of them.</p>"
MORE = "<p>Second paragraph, which has many words too, so that it is not taken for anything else.</p>"


@pytest.mark.parametrize(
    "inside, kept",
    [
        ("<div class='article-header'><h1>The title</h1></div>{p}{m}", "The title|p|m"),
        ("{p}<section class='share-price'><p>The price of a share rose.</p></section>{m}", "p|The price of a share rose.|m"),
        ("{p}<ul><li><a href=1>Other story one</a></li><li><a href=2>Other story two</a></li></ul>{m}", "p|m"),
        ("{p}<p><a href=1>A paragraph that is one link.</a></p>{m}", "p|A paragraph that is one link.|m"),
        ("{p}<div class='share-buttons'>Share it</div><div class='related posts'><p>Another story.</p></div>{m}", "p|m"),
        ("{p}<![x[ <p>Middle.</p>{m}", "p|Middle.|m"),
        ("{p}{m}" + "".join(f"<p><a href={i}>Story {i}</a></p>" for i in range(9)), "p|m"),
    ],
)
def test_parts_of_an_article(inside, kept):
    words = {"p": re.sub("<.*?>", "", PROSE), "m": re.sub("<.*?>", "", MORE)}
    got = html_text.main_text(f"<body><article>{inside.format(p=PROSE, m=MORE)}</article></body>")
    assert got.split("\n\n") == [words.get(x, x) for x in kept.split("|")]


def test_smoothed_ratios_decide(monkeypatch):
    """With all smoothed ratios alike, lines of links would be in the upper cluster."""
    page = f"<article>{PROSE}{MORE}<h2>1</h2><h2>2</h2><h2>3</h2><p><a href=x>Go to top</a></p></article>"
    assert not html_text.main_text(page).endswith("Go to top")
    monkeypatch.setattr(html_text, "_smoothed", lambda ratios: [0.0] * len(ratios))
    assert html_text.main_text(page).endswith("Go to top")


def test_articles_of_all_pages(spark):
    """Precision and recall of words over the test pages, against their article blocks cut out by expressions."""
    import html as entities

    from support import DATA

    right = found = wanted = 0
    pages = spark.read.parquet(f"{DATA}/pages.parquet").collect()
    got = {r.page_id: r.text for r in html_text.extract(spark.read.parquet(f"{DATA}/pages.parquet")).collect()}
    for page in pages:
        inside = re.search("(?s)<article>(.*?)(</article>|<footer|$)", page.html)
        if inside is None:
            continue
        blocks = [" ".join(entities.unescape(re.sub("(?s)<[^>]*>", "", x.replace("<br>", " "))).split()) for x in re.split("</?(?:p|h1)>", inside[1])]
        truth, mine = Counter(" ".join(filter(None, blocks)).split()), Counter(got[page.page_id].split())
        right, found, wanted = right + (truth & mine).total(), found + mine.total(), wanted + truth.total()
    assert wanted > 0 and right / found > 0.99 and right / wanted > 0.99, (right / found, right / wanted)


def test_odd_pages(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "<p"), (4, "u", "plain &am"), (4, "u", "<![x[ <p>words here.</p>"), (None, "u", "<p>one <b>two<br>three</p>")]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("x"))).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    assert [r.text for r in got if r.page_id in (1, 2)] == ["", ""] and [r.text for r in got if r.page_id is None] == ["one two three"]


@pytest.mark.parametrize(
    "page, text",
    [
        ("<p>one</p><![ endif ]><p>two</p>", "one\n\ntwo"),
        ("<p>one</p><![foo]><p>two</p>", "one\n\ntwo"),
        ("<p>a <![x] b</p><p>two</p>", "a\n\ntwo"),
        ("<p>one</p><![endif]--><p>two</p>", "one\n\ntwo"),
        ("<p>one</p><![CDATA[x <p>y</p>]]><p>two</p>", "one\n\ntwo"),
        ("<p>one</p><![CDATA[x <p>two</p>", "one\n\ntwo"),
        (f"<p>one &#{'9' * 5000}; &#{'0' * 5000}65;</p><p>two</p>", "one \ufffd A\n\ntwo"),
    ],
)
def test_text_after_a_malformed_declaration_is_kept(page, text):
    assert html_text.main_text(page) == text


# 5 sharding


@pytest.mark.parametrize("limit", [100, 3000, 10**9])
def test_sharding(docs, documents, limit):
    rows = sharding.shard(docs, limit).collect()
    assert len(rows) == len(documents)
    sizes, shards = Counter(), {}
    for r in rows:
        sizes[r.shard_id] += r.n_bytes
        shards.setdefault(r.shard_id, set()).add(r.doc_id)
    assert sorted((r.doc_id is None, r.doc_id, r.n_bytes) for r in rows) == sorted((d is None, d, len((t or "").encode())) for d, t, *_ in documents)
    for r in rows:
        assert r.shard_bytes == sizes[r.shard_id] and r.depth == len(r.shard_id)
        assert r.oversized == (sizes[r.shard_id] > limit) and (not r.oversized or len(shards[r.shard_id]) == 1)
    for a, b in combinations(shards, 2):
        assert not a.startswith(b) and not b.startswith(a)
    for s in shards:  # only buckets above the limit have split
        assert not s or sum(n for x, n in sizes.items() if x.startswith(s[:-1])) > limit


# 6 language


def brute_code_length(model_texts, text):
    """Bits of a text by method C with exclusion, from trees up to order three, straight from the counts."""
    counts = {}
    for t in model_texts:
        b = b"\0\0\0" + t.encode()
        for i in range(3, len(b)):
            for o in range(4):
                counts.setdefault((o, b[i - o : i]), Counter())[b[i]] += 1
    total, b = 0.0, b"\0\0\0" + text.encode()
    for i in range(3, len(b)):
        hidden = set()
        for o in range(3, -1, -1):
            c = counts.get((o, b[i - o : i]))
            if not c:
                continue
            live = {s: n for s, n in c.items() if s not in hidden}
            if live:
                n = sum(live.values()) + len(live)
                if b[i] in live:
                    total += math.log2(n / live[b[i]])
                    break
                total += math.log2(n / len(live))
                hidden |= set(live)
        else:
            total += math.log2(256 - len(hidden))
    return total


def test_code_lengths_are_exact(spark):
    texts = {"aa": ["abracadabra abra", "cadabra"], "bb": ["über zwölf böse", "zwei und zwanzig"]}
    model = language.train(spark.createDataFrame([(k, t) for k, ts in texts.items() for t in ts], "lang string, text string"))
    raw = np.frombuffer("abra zwx".encode() + "éü".encode(), np.uint8)
    bits = language.code_lengths(model, raw, np.array([0, 8, 8, len(raw)]))
    for k, lang in enumerate(model.languages):
        assert bits[0, k] == pytest.approx(brute_code_length(texts[lang], "abra zwx"), abs=1e-3)
        assert bits[1, k] == 0 and bits[2, k] == pytest.approx(brute_code_length(texts[lang], "éü"), abs=1e-3)


def test_shards_of_the_model_keep_every_context(spark, monkeypatch):
    """A bound on the model cuts it into shards, and drops no context: code lengths and predictions stay the same."""
    texts = {"aa": ["abracadabra abra", "cadabra"], "bb": ["über zwölf böse", "zwei und zwanzig"], "cc": ["ei ei, poliisi"]}
    labelled = spark.createDataFrame([(k, t) for k, ts in texts.items() for t in ts], "lang string, text string")
    asked = ["abra zwx", "", "éü poliisi über", "cadabra"]
    raw, starts = np.frombuffer("".join(asked).encode(), np.uint8), np.cumsum([0, *(len(x.encode()) for x in asked)])
    sums, met = np.zeros((len(asked), 3)), 0
    for which, mine, model in language.shards(labelled, 600):
        sums[:, which] += language.code_lengths(model, raw, starts, mine)
        met += 1
    assert met > 3
    for i, x in enumerate(asked):
        for k, lang in enumerate(sorted(texts)):
            assert sums[i, k] == pytest.approx(brute_code_length(texts[lang], x), abs=1e-3)

    rows = spark.createDataFrame([(n, t, k) for n, (k, t) in enumerate((k, t) for k, ts in texts.items() for t in ts)], "doc_id long, text string, lang string")
    got = {}
    for cells in (12_000_000, 600):
        monkeypatch.setattr(language, "MODEL_CELLS", cells)
        got[cells] = {r.doc_id: (r.lang_pred, round(r.score, 4)) for r in language.identify(rows, F.lit(False)).collect()}
    assert got[600] == got[12_000_000]


def test_language_of_held_out(spark):
    from support import DATA

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = language.identify(docs, F.crc32(F.col("doc_id").cast("string")) % 4 == 2).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out")
    right, n = got.filter("lang = lang_pred").count(), got.count()
    assert n > 20 and right / n > 0.97


def test_odd_languages(docs, documents, empty):
    got = language.identify(docs, F.lit(False)).collect()
    assert len(got) == len(documents) and all(0 <= r.score <= 1 for r in got)
    assert {r.lang_pred for r in got if r.doc_id in (40, 41, 42)} == {"und"}
    assert language.identify(empty, F.lit(False)).count() == 0
    assert {r.lang_pred for r in language.identify(docs.withColumn("lang", F.lit(None).cast("string")), F.lit(False)).collect()} == {"und"}


# 7 substring dedup


def test_substrings(docs, documents):
    texts = [words(t) for _, t, *_ in documents]
    seen = Counter(tuple(w[i : i + 35]) for w in texts for i in range(len(w) - 34))
    wanted = []
    for (d, *_), w in zip(documents, texts, strict=True):
        gone = [any(seen[tuple(w[i : i + 35])] > 1 for i in range(max(0, j - 34), min(j, len(w) - 35) + 1)) for j in range(len(w))]
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        wanted.append((d, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    got = [tuple(r) for r in substring_dedup.digests(docs).collect()]
    assert by_id(got) == by_id(wanted)
    cut = substring_dedup.without_repeats(docs)
    assert cut.columns == docs.columns
    left = [(r.doc_id, hashlib.sha256(" ".join(words(r.text)).encode()).hexdigest()) for r in cut.collect()]
    assert by_id(left) == by_id((d, h) for d, _, _, h in wanted)
    untouched = {d: t for (d, t, *_), (_, _, n, _) in zip(documents, wanted, strict=True) if not n}
    assert all(r.text == untouched[r.doc_id] for r in cut.collect() if r.doc_id in untouched)


def removed_by_brute_force(texts):
    seen = Counter(tuple(w[i : i + 35]) for w in texts for i in range(len(w) - 34))
    return [sum(any(seen[tuple(w[i : i + 35])] > 1 for i in range(max(0, j - 34), min(j, len(w) - 35) + 1)) for j in range(len(w))) for w in texts]


@pytest.mark.parametrize("most", [substring_dedup.MOST_RUNS, 1])
def test_passages_cut_anywhere(spark, monkeypatch, most):
    """Passages that start and end anywhere, in texts around one common phrase; by the automata and by single windows."""
    monkeypatch.setattr(substring_dedup, "MOST_RUNS", most)
    rng = np.random.default_rng(7)
    source = [f"s{i}" for i in range(300)]
    texts = []
    for i in range(60):
        a, n = rng.integers(0, 200), rng.integers(30, 100)
        own = [f"d{i}w{j}" for j in range(60)]
        texts.append(own[:20] + source[a : a + n] + own[20:40] + [f"common{j}" for j in range(12)] + own[40:])
    texts += [["again"] * 80, source[:35], source[1:36], source[:34], []]
    rows = [(i, " ".join(w)) for i, w in enumerate(texts)]
    got = {r.doc_id: r.n_removed for r in substring_dedup.digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(texts))] == removed_by_brute_force(texts)


def test_the_automaton_decides():
    passage = " ".join(f"w{i}" for i in range(50)).encode()
    texts, counts = [b"a b " + passage + b" c", passage + b" d", b" ".join(b"x%d" % i for i in range(40))], np.array([1, 1, 1])
    found = substring_dedup.patterns(texts, counts)
    assert substring_dedup.covered(texts, counts, found) == [[(2, 52)], [(0, 50)], []]
    first = b" " + b" ".join(passage.split()[:35]) + b" "
    assert substring_dedup.covered(texts, counts, found - {first}) == [[(17, 52)], [(15, 50)], []]
    # A pattern that is found once is not confirmed, whatever its hash has said; a segment that occurs twice confirms it.
    once = {b" " + b" ".join(texts[2].split()[:35]) + b" "}
    assert substring_dedup.covered(texts, counts, once) == [[], [], []]
    assert substring_dedup.covered(texts, np.array([1, 1, 2]), once) == [[], [], [(0, 35)]]


def test_substrings_beside_clashing_columns(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(1, text + " own", 7, 8, 9), (2, text, 7, 8, 9), (None, None, 7, 8, 9)]
    got = substring_dedup.without_repeats(spark.createDataFrame(rows, "doc_id long, text string, __k1 long, __K2 long, __spans long")).collect()
    assert by_id([tuple(r) for r in got]) == by_id([(1, "own", 7, 8, 9), (2, "", 7, 8, 9), (None, None, 7, 8, 9)])


def test_substrings_of_nothing(empty):
    assert substring_dedup.digests(empty).count() == 0 and substring_dedup.without_repeats(empty).count() == 0


# 8 quality classifier


def test_quality_of_held_out(spark):
    from support import DATA

    big = DATA.replace("sf0.001", "sf0.01")
    docs, labels = (spark.read.parquet(f"{big}/{t}.parquet") for t in ("documents", "labels"))
    got = quality_model.score(docs, labels, F.crc32(F.col("doc_id").cast("string")) % 5 == 0).join(labels, "doc_id").filter("held_out").collect()
    good, bad = ([r.score for r in got if r.quality == q] for q in (1, 0))
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert np.mean([g > b for g in good for b in bad]) > 0.95


def test_scores_do_not_depend_on_partitions(spark):
    from support import DATA

    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    one, other = ({r.doc_id: r.score for r in quality_model.score(d, labels, held).collect()} for d in (docs, docs.repartition(7)))
    assert one == other


def test_odd_labels(spark, docs, documents, empty):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality_model.score(docs, none, F.lit(False)).collect()} == {0.5}
    one = spark.createDataFrame([(1, 1), (2, 1), (2, 1), (3, None), (None, 0), (4, 7)], "doc_id long, quality int")
    assert len({r.score for r in quality_model.score(docs, one, F.lit(False)).collect()}) == 1
    both = spark.createDataFrame([(i, i % 2) for i in range(8)], "doc_id long, quality int")
    assert quality_model.score(docs, both, F.lit(False)).count() == len(documents)
    assert quality_model.score(empty, both, F.lit(False)).count() == 0


def test_dual_coordinate_descent_separates():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 50, 12)) + (50 if i % 2 else 0) for i in range(80)]
    y = np.array([1.0 if i % 2 else -1.0 for i in range(80)])
    w, b = quality_model.hinge_fit(sets, [np.ones(len(s)) / np.sqrt(len(s)) for s in sets], y)
    assert all((w[s].sum() / np.sqrt(len(s)) + b) * t > 0 for s, t in zip(sets, y, strict=True))


def test_the_fit_equals_a_plain_solver(monkeypatch):
    """The same dual problem by projected gradient steps on the whole matrix."""
    monkeypatch.setattr(quality_model, "EPOCHS", 3000)
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 12, 5)) for _ in range(30)]
    values = [rng.normal(size=len(s)) for s in sets]
    y = np.where(rng.random(30) < 0.3, 1.0, -1.0)
    w, b = quality_model.hinge_fit(sets, values, y)
    x = np.zeros((30, 13))
    x[:, 12] = 1  # the bias
    for row, s, v in zip(x, sets, values, strict=True):
        row[s] = v
    share = np.array([(y < 0).mean(), (y > 0).mean()])
    top = quality_model.PENALTY * 0.5 / share[(y > 0).astype(int)]
    q = (x * y[:, None]) @ (x * y[:, None]).T
    alpha, step = np.zeros(30), 1 / np.linalg.eigvalsh(q)[-1]
    for _ in range(50_000):
        alpha = np.clip(alpha + step * (1 - q @ alpha), 0, top)
    wanted = (alpha * y) @ x
    assert np.abs(np.append(w[:12], b) - wanted).max() < 1e-3


def test_log_ratios_by_hand():
    sets, y = [np.array([0, 1]), np.array([1]), np.array([1, 2])], np.array([1.0, 1.0, -1.0])
    got = quality_model.log_ratios(sets, y)
    n = quality_model.FEATURES
    good, bad = {0: 2, 1: 3}, {1: 2, 2: 2}
    for f in (0, 1, 2, 5):
        assert np.isclose(got[f], math.log(good.get(f, 1) / (n + 3)) - math.log(bad.get(f, 1) / (n + 2)))


# 9 quality rules


def test_rules(spark, docs, documents, empty):
    got = quality_rules.judge(docs).select("doc_id", "judgement.*").collect()
    assert len(got) == len(documents)
    for r, (_, t, *_) in zip(sorted(got, key=lambda r: (str(r.doc_id), r.n_words)), sorted(documents, key=lambda d: (str(d[0]), len(words(d[1])))), strict=True):
        w, lines = words(t), [x for x in (t or "").split("\n") if words(x)]
        seen = Counter(zip(w, w[1:], w[2:], strict=False))
        again = {j for i, g in enumerate(zip(w, w[1:], w[2:], strict=False)) if seen[g] > 1 for j in (i, i + 1, i + 2)}
        failed = len(w) < 50 or 100 * len(again) > 50 * len(w)
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")))
        assert (r.n_dup_lines, r.n_repeat_words, r.base_failed) == (len(lines) - len(set(lines)), len(again), failed)
        assert not (r.base_failed and r.kept)
    assert {r.doc_id for r in got if r.kept} >= {0, 1, 2, 3, 30, 31, 70}
    assert quality_rules.judge(empty).count() == 0


def test_lines(spark, documents):
    good = documents[0][1]
    bad = ["home | about | contact | login | menu", "Copyright 2020 All rights reserved.", "Click here to read more.", "a*** b### c%%% d&&& e$$$ f*** g### h***", "BUY!! THIS!! NOW!! CHEAP!!", "Login"]
    frame = spark.createDataFrame([(1, "\n".join([good, *bad])), (2, "\n".join(bad * 20))], "doc_id long, text string")
    got = {r.doc_id: r.judgement for r in quality_rules.judge(frame).collect()}
    assert got[1].kept and got[1].cleaned == good and not got[2].kept and got[2].cleaned == ""


# 10 mixing


def test_mixing(docs, documents, empty):
    rows = mixing.mix(docs).collect()
    again = mixing.mix(docs.repartition(7)).collect()
    key = lambda r: (r.doc_id is None, r.doc_id, r.size, r.taken)
    assert len(rows) == len(documents) and sorted(map(key, rows)) == sorted(map(key, again))
    names = sorted({s for *_, s in documents if s is not None}) + [None]
    size = {n: sum(len(words(t)) for _, t, _, s in documents if s == n) for n in names}
    weight = {n: (5, 2, 1)[i % 3] for i, n in enumerate(names)}
    target, total = {}, sum(size.values())
    open_ = set(names)
    while open_:
        share = {n: (total - sum(target.values())) * weight[n] / sum(weight[m] for m in open_) for n in open_}
        full = {n for n in open_ if share[n] > 3 * size[n]}
        if not full:
            target |= share
            break
        target |= {n: 3.0 * size[n] for n in full}
        open_ -= full
    source = {(d, len(words(t))): s for d, t, _, s in documents}
    taken = Counter()
    for r in rows:
        s = source[r.doc_id, r.size]
        assert r.source_size == size[s] and r.target == pytest.approx(target[s]) and r.taken in {k * r.size for k in range(4)}
        taken[s] += r.taken
    largest = {n: max(sum(len(words(t)) for d, t, _, s in documents if s == n and d == i) for i in {d for d, *_ in documents}) for n in names}
    assert all(abs(taken[n] - target[n]) <= largest[n] / 2 + 1e-6 for n in names)
    assert mixing.mixed_documents(docs).columns == docs.columns
    assert mixing.mix(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0
