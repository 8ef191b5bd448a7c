"""Small cases of the training-data operators, against brute force."""

import base64
import hashlib
import random
import re
import zipfile
from io import BytesIO

import numpy as np
import pytest
import xxhash

from loomframe.llm import decontaminate, host_rules, html_crf, mixing, quality, secrets, sharding, simhash, token_spans, zip_warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, host string, fp long"


def prose(r, n, vocabulary=400):
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(1)
    base = [prose(r, 60) for _ in range(40)]
    texts = [*base, *base[:10], *(b + " tail" for b in base[10:20]), "", None, " \n\t", "one two", "x " * 3000, "É Ü ß", "a\nb\na\n\nb\na"]
    rows = [(k, t, "en", "s0" if k % 3 else f"s{k % 5}", 0, "clash", "clash", 1) for k, t in enumerate(texts)]
    rows += [rows[0], (None, base[0], None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def brute_fingerprint(t):
    w = re.findall("[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[k : k + 3]).encode(), 42) for k in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fp):
    keys = sorted(set(fp))
    parent = {k: k for k in keys}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(keys):
        for b in keys[:i]:
            if (a ^ b).bit_count() <= 3:
                parent[find(a)] = find(b)
    return [find(x) for x in fp]


def test_simhash(docs, empty):
    got = simhash.simhash_groups(docs).collect()
    text = {r.doc_id: r.text for r in docs.collect() if r.doc_id is not None}
    for r in got:
        if r.id is not None:
            assert r.fp & (2**64 - 1) == brute_fingerprint(text[r.id])
    comp = brute_components([r.fp & (2**64 - 1) for r in got])
    least = {}
    for r, c in zip(got, comp, strict=True):
        if r.id is not None:
            least[c] = min(least.get(c, r.id), r.id)
    assert all(r.component == least.get(c) for r, c in zip(got, comp, strict=True))
    assert len(got) == docs.count() and simhash.simhash_groups(empty).count() == 0
    kept = simhash.keep_one(docs)
    ids = [r.doc_id for r in kept.collect() if r.doc_id is not None]
    assert sorted(ids) == sorted({r.component for r in got if r.component is not None}) and kept.columns == docs.columns


@pytest.mark.parametrize("kind", sorted(simhash.CODES))
def test_anchors_lose_no_link(kind):
    r = random.Random(4)
    for _ in range(100):
        a = r.getrandbits(64)
        b = a
        for k in r.sample(range(64), r.randint(0, 3)):
            b ^= 1 << k
        fp = np.array([a, b], np.uint64).view(np.int64)
        anchor, f, home = simhash.spread(fp, kind, 3)
        homes = {x for x, y, h in zip(anchor, f, home, strict=True) if h and y == fp[0]}
        assert homes & {x for x, y in zip(anchor, f, strict=True) if y == fp[1]}


def test_crowded_anchor_is_split(spark):
    r = random.Random(12)
    near = {0b1011}
    while len(near) < 400:
        x = r.choice(sorted(near)) ^ (1 << r.randrange(64))
        near.add(x)
    far = {r.getrandbits(64) for _ in range(50)}
    fps = sorted(np.array(sorted(near | far), np.uint64).view(np.int64).tolist())
    nodes = spark.createDataFrame([(x,) for x in fps], "fp long")
    # the groups are the same whichever code serves and however small the cells are
    for rows, kind in [(16, "golay"), (1 << 14, "golay"), *((1 << 14, k) for k in simhash.CODES if k != "golay")]:
        root = {x.u: x.root for x in simhash.components(simhash.anchor_links(nodes, 3, kind, rows)).collect()}
        got = [root.get(x, x) for x in fps]
        want = brute_components([x & (2**64 - 1) for x in fps])
        assert len(set(zip(got, want, strict=True))) == len(set(got)) == len(set(want))
    crowd = spark.createDataFrame([(7, x, x < 60) for x in range(100)], "anchor long, fp long, home boolean")
    cells = {}
    for x in simhash.cells(crowd, 16).collect():
        cells.setdefault(x.key, []).append((x.fp, x.home))
    met = {(a, b) for c in cells.values() for a, h in c if h for b, _ in c}
    assert met >= {(a, b) for a in range(60) for b in range(100)} and max(map(len, cells.values())) < 60


def test_forest_connects():
    r = np.random.default_rng(2)
    fp = np.unique(r.integers(0, 1 << 12, 300)).astype(np.int64)
    u, v = simhash.forest(fp, np.ones(len(fp), bool), 1, step=2000)
    want = {}
    keys = fp.tolist()
    group = {k: k for k in keys}

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for i, a in enumerate(keys):
        for b in keys[:i]:
            if (a ^ b).bit_count() <= 1:
                group[find(a)] = find(b)
    for a in keys:
        want.setdefault(find(a), set()).add(a)
    assert len(u) == len(keys) - len(want) and all(find(a) == find(b) for a, b in zip(u.tolist(), v.tolist(), strict=True))


def test_components(spark, empty):
    chain = spark.createDataFrame([(k + 1, k) for k in range(40)] + [(100, 90), (95, 100)], "u long, v long")
    got = {r.u: r.root for r in simhash.components(chain).collect()}
    assert got == {**{k: 0 for k in range(1, 41)}, 100: 90, 95: 90}


def test_host_rules(docs, empty):
    def brute(t):
        w = re.findall("[^\x20\x09-\x0D]+", t or "")
        win = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
        covered = {p for k, x in enumerate(win) if win.count(x) > 1 for p in range(k, k + 8)}
        seen, dup = set(), 0
        for line in (t or "").split("\n"):
            if re.search("[^\x20\x09-\x0D]", line):
                dup += line in seen
                seen.add(line)
        return len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", t or "")), dup, len(covered)

    small = docs.filter("doc_id is null or doc_id != 64")
    text = {r.doc_id: r.text for r in small.collect()}
    out = host_rules.host_quality(small, carry=["doc_id"]).collect()
    for r in out:
        if r.row.doc_id is not None:
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(text[r.row.doc_id])
    assert len(out) == small.count() and not any(r.kept and r.base_failed for r in out)
    assert host_rules.host_quality(empty).count() == 0
    long = host_rules.rule_features(docs.filter("doc_id = 64")).first()
    assert long.n_words == 3000 and long.n_repeat_words == 3000 and long.row.host == "clash"


def unseeded(rows, items, exact_below=8):
    """Scores of 0.55 or more by alignment of whole texts with whole items."""
    number = {}
    code = lambda t: np.array([number.setdefault(w, len(number)) for w in decontaminate.tokens(t)], np.int64)
    coded, out = [(i, code(t)) for i, t in items], {}
    for d, t in rows:
        x = code(t)
        for i, c in coded:
            if len(c) >= 4 and len(x):
                score = decontaminate.align(c, x)[0] / (2 * len(c))
                if score >= (0.55 if len(c) >= exact_below else 1.0):
                    out[d, i] = score
    return out


def scores(spark, rows, items, **how):
    d = spark.createDataFrame(rows, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    return {(x.doc_id, x.item_id): x.score for x in decontaminate.contamination(d, b, **how).collect()}


def test_decontaminate(spark, empty):
    r = random.Random(3)
    items = [prose(r, 40, 5000) for _ in range(5)]
    edited = items[1].split()
    edited[5] = edited[17] = "changed"
    del edited[28]
    rows = [(0, prose(r, 300, 5000) + " " + items[0]), (1, "Z. " + " ".join(edited).upper() + "!"), (2, prose(r, 400, 5000)), (3, None), (4, ""), (None, items[2]), (None, "clean"), (7, items[3]), (7, "clean"), (2, "clean")]
    short = [(10, "just six words in this item"), (11, "two words"), (None, None), (12, " ")]
    rows += [(20, "so Just six, words in this item."), (21, "just six words in that item"), (22, "a\nTwo words!\nb"), (23, "these two words")]
    d = spark.createDataFrame([(*x, "clash", 1) for x in rows], "doc_id long, text string, item_id string, score int")
    b = spark.createDataFrame([(*x, "clash") for x in [*enumerate(items), *short]], "item_id long, text string, doc_id string")
    got = {(x.doc_id, x.item_id): x.score for x in decontaminate.contamination(d, b).collect()}
    assert set(got) == {(0, 0), (1, 1), (None, 2), (7, 3), (20, 10), (22, 11)} and got[0, 0] == got[20, 10] == got[22, 11] == 1.0 and 0.8 < got[1, 1] < 1
    assert {(x.doc_id, x.item_id) for x in decontaminate.contamination(d, b, block_words=50).collect()} == set(got)
    # rows that share an id or have none are judged by their own texts
    kept = decontaminate.drop_contaminated(d, b)
    assert kept.columns == d.columns
    assert sorted((x.doc_id or -1, (x.text or "")[:5]) for x in kept.collect()) == [(-1, "clean"), (2, "clean"), (2, rows[2][1][:5]), (3, ""), (4, ""), (7, "clean"), (21, "just "), (23, "these")]
    assert decontaminate.contamination(d, b.limit(0)).count() == 0 and decontaminate.drop_contaminated(empty, b).count() == 0
    assert decontaminate.drop_contaminated(d, b.limit(0)).count() == len(rows)


@pytest.mark.parametrize("every", range(2, 9))
def test_decontaminate_equals_unseeded_alignment(spark, every, monkeypatch):
    """Copies with every so manyth word replaced, left out or followed by a foreign one; repeated rows; pieces."""
    if every == 4:
        monkeypatch.setattr(decontaminate, "PIECE", 64)
    r = random.Random(every)
    # common words stand in all items, so that texts share many words by chance
    word = lambda: f"c{r.randrange(12)}" if r.random() < 0.5 else f"i{r.randrange(2000)}"
    items = [(k, " ".join(word() for _ in range(r.randint(8, 59)))) for k in range(30)]
    rows = []
    for k, item in items:
        for kind in range(3):
            w = []
            for j, x in enumerate(item.split()):
                if j % every < every - 1:
                    w.append(x)
                elif kind != 1:
                    w += [word()] if kind == 0 else [x, word()]
            rows.append((3 * k + kind, " ".join([*(word() for _ in range(40)), *w, *(word() for _ in range(150))])))
    want = unseeded(rows, items)
    assert every in (2, 3) or {(3 * k, k) for k in range(30)} <= set(want)
    assert scores(spark, rows + rows[:5], items) == want


def test_decontaminate_equals_unseeded_alignment_on_documents(spark):
    import duckdb

    sf = "/root/testdata/sf0.001"
    rows = duckdb.sql(f"select doc_id, text from '{sf}/documents.parquet' where length(text) < 8000").fetchall()
    items = duckdb.sql(f"select item_id, text from '{sf}/benchmark.parquet'").fetchall()
    assert scores(spark, rows, items) == unseeded(rows, items)


def test_decontaminate_words_and_long_texts():
    assert decontaminate.tokens("Ab_1, это 東京タワー né") == ["ab_1", "это", *"東京タワー", "né"]
    item = "どのように東京で電車に乗りますか"
    b = decontaminate.Items([("1", decontaminate.tokens(item))], 4, 0.55, 8)
    edited = item.replace("電", "x")
    assert [len(m) for m in b.matches([f"です。{edited}。", "東京は大きい", None])] == [1, 0, 0]
    words = [f"w{k}" for k in range(30)]
    b = decontaminate.Items([("1", words)], 4, 0.55, 8)
    ((m,),) = b.matches(["x y z " * 400_000 + " ".join(words) + " q" * 300_000])
    assert m == ("1", 1.0, 27, 1_200_030)


def test_align_brute():
    r = random.Random(8)
    for _ in range(50):
        a, b = ([r.randrange(4) for _ in range(r.randint(1, 12))] for _ in range(2))
        h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a, 1):
            for j, y in enumerate(b, 1):
                h[i][j] = max(0, h[i - 1][j - 1] + (2 if x == y else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
        assert decontaminate.align(np.array(a), np.array(b))[0] == max(map(max, h))


def test_mixing(spark, docs, empty):
    rows = [(k, "w " * (k % 7 + 1), "big" if k % 4 else f"small{k % 3}") for k in range(3000)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix_sources(d, carry=["doc_id"]).collect()
    seen = {}
    for r in got:
        seen.setdefault(r.row.doc_id, []).append(r.epoch)
    assert set(seen) == set(range(3000)) and all(sorted(e) == list(range(len(e))) and len(e) <= 3 for e in seen.values())
    tokens, read = {}, {}
    for k, _, s in rows:
        tokens[s] = tokens.get(s, 0) + k % 7 + 1
    for r in got:
        read[r.source] = read.get(r.source, 0) + r.n_tokens
    times = {s: read[s] / tokens[s] for s in tokens}
    assert abs(times["big"] - 1) < 0.01 and max(times.values()) < 2.02 and min(v for s, v in times.items() if s != "big") > 1.7
    half = mixing.mix_sources(d, carry=["doc_id"], budget_tokens=4000, target_entropy=1.0).collect()
    assert abs(sum(r.n_tokens for r in half) - 4000) < 40
    assert mixing.mix_sources(docs).count() >= docs.count() and mixing.mix_sources(empty).count() == 0


def test_sharding(docs, empty):
    for n in (1, 2, 3, 100, 1025):
        p = sharding.feistel(np.arange(n), n, 5)
        assert sorted(p.tolist()) == list(range(n)) and (sharding.unfeistel(p, n, 5) == np.arange(n)).all()
    got = sharding.shard_rows(docs, shards=7).collect()
    n = docs.count()
    assert sorted(r.row_number for r in got) == list(range(n))
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    again = sharding.shard_rows(docs.repartition(3), shards=7, carry=["doc_id"]).collect()
    key = lambda rows: sorted((r.row.doc_id or -1, r.text_crc32, r.shard, r.slot) for r in rows)
    assert key(got) == key(again) and sharding.shard_rows(empty).count() == 0


def test_html(spark):
    model = html_crf.default_model()
    r = random.Random(77)
    pages = [html_crf.labelled_page(r) for _ in range(150)]
    assert sum(html_crf.main_text(model, p) == "\n".join(t) for p, t in pages) > 130
    page = "<nav><ul><li><a href=x>Home</a></ul></nav><article><h1>A &amp; B</h1><p>One\n two<br>three &#233;.<p><b>Four is a longer line of text.</b></article><footer>&copy; me</footer>"
    rows = [(1, "u", page), (2, None, None), (3, "v", ""), (4, "w", "<script>x"), (5, "w", "<p>" * 2000)]
    got = {x.row.page_id: x.text for x in html_crf.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: "A & B\nOne two three é.\nFour is a longer line of text.", 2: "", 3: "", 4: "", 5: ""}


def test_html_viterbi_and_gradient():
    """Viterbi against all labellings of short pages; the gradient against differences of the likelihood."""
    from itertools import product

    model = html_crf.default_model()
    r = random.Random(31)
    seen = 0
    while seen < 25:
        bs = html_crf.blocks(html_crf.labelled_page(r)[0], model.weights)
        if not 2 <= len(bs) <= 9:
            continue
        seen += 1

        def score(y, bs=bs):
            out = 0.0
            for k, b in enumerate(bs):
                out += sum(model.weights[f][y[k]] for f in html_crf.features(b, k, len(bs)) if f in model.weights)
                if k:
                    out += model.moves[bs[k - 1].container == b.container][y[k - 1]][y[k]]
            return out

        assert abs(score(model.label(bs)) - max(score(y) for y in product((0, 1), repeat=len(bs)))) < 1e-9
    chains = html_crf.Chains([html_crf.labelled_page(r) for _ in range(6)], 1e-3)
    g = np.random.default_rng(2)
    w, moves = g.normal(size=(len(chains.index), 2)), g.normal(size=(2, 2, 2))
    _, dw, dm = chains.gradient(w, moves)
    for x, d in ((w, dw), (moves, dm)):
        for at in [tuple(g.integers(0, n) for n in x.shape) for _ in range(12)]:
            values = []
            for step in (1e-5, -1e-5):
                x[at] += step
                values.append(chains.gradient(w, moves)[0])
                x[at] -= step
            assert abs((values[0] - values[1]) / 2e-5 - d[at]) < 1e-5


#: Layouts that the generator of training pages never writes: (page, the article's blocks).
LAYOUTS = {
    "blog in divs": (
        """<html><body><div id="page"><div class="site-header"><a href="/">My Blog</a><div class="tagline">Notes on things</div></div>
        <div class="hentry"><div class="entry-title"><h1>On the making of bread</h1></div><div class="entry-content"><p>Bread is made of flour, water, salt and time.</p>
        <div class="adsense">Buy the best ovens now</div><p>Of these, time is what most of us have least of.<h2>Flour</h2><ul><li>Rye flour for taste<li>Wheat flour for volume</ul>
        <blockquote>Give us this day our daily bread, and a good knife to cut it.</blockquote></div></div>
        <div id="secondary" class="widget-area"><h3>Recent posts</h3><ul><li><a href="/a">Cheese</a><li><a href="/b">Wine</a></ul></div>
        <div id="comments"><h3>Two comments</h3><div class="comment-body"><p>I have tried this and it works very well.</p></div></div>
        <div id="colophon" class="footer"><p>Powered by patience.</p></div></div></body></html>""",
        ["On the making of bread", "Bread is made of flour, water, salt and time.", "Of these, time is what most of us have least of.", "Flour", "Rye flour for taste", "Wheat flour for volume", "Give us this day our daily bread, and a good knife to cut it."],
    ),
    "news": (
        """<body><header role="banner"><nav><ul><li><a href=/1>World</a></li><li><a href=/2>Sport</a></li></ul></nav></header>
        <main id="main-content"><article><h1>Harbour reopens after the storm</h1><p class="byline">By our correspondent</p>
        <figure><img src=x.jpg><figcaption>Ships leave the harbour on Monday.</figcaption></figure><p>The harbour was opened again on Monday, three days after the storm.</p>
        <aside class="related-links"><h2>Related</h2><ul><li><a href=/3>Storm hits the coast</a></li></ul></aside>
        <p>Officials said that &ldquo;no lasting damage&rdquo; had been found.</p><div class="newsletter-signup"><p>Sign up for our newsletter</p><form><input type=email><button>Sign up</button></form></div>
        <p>Ferries will run from Tuesday.</p></article></main><section class="comments"><p>Great news for all of us who live there.</p></section><footer><p>&copy; The Paper</p></footer>""",
        ["Harbour reopens after the storm", "By our correspondent", "Ships leave the harbour on Monday.", "The harbour was opened again on Monday, three days after the storm.", "Officials said that “no lasting damage” had been found.", "Ferries will run from Tuesday."],
    ),
    "wiki": (
        """<div id="mw-navigation" class="navbar"><ul><li><a href=/>Main page</a><li><a href=/r>Random article</a></ul></div><div id="content" class="mw-body" role="main">
        <h1 id="firstHeading">Sedge warbler</h1><div id="bodyContent"><p>The <b>sedge warbler</b> is a small <a href=/p>passerine</a> bird that breeds across Europe.</p>
        <table class="infobox"><tr><th>Family</th><td>Acrocephalidae</td></tr></table><h2>Description</h2><p>It is a streaked brown bird with a clear stripe above the eye.</p>
        <dl><dt>Length</dt><dd>About thirteen centimetres</dd></dl></div></div><div id="footer" role="contentinfo"><ul><li>Last edited on Friday<li><a href=/privacy>Privacy policy</a></ul></div>""",
        ["Sedge warbler", "The sedge warbler is a small passerine bird that breeds across Europe.", "Family", "Acrocephalidae", "Description", "It is a streaked brown bird with a clear stripe above the eye.", "Length", "About thirteen centimetres"],
    ),
    "old tables": (
        """<table><tr><td class="menu"><a href=a>Home</a><br><a href=b>Links</a></td><td class="content"><h2>Welcome</h2><p>This page has been on the net since the last century, and it has hardly changed.</p>
        <p>Write to me if you like it; I read all letters.</p></td></tr><tr><td class="copyright" colspan=2>Copyright by the author</td></tr></table>""",
        ["Welcome", "This page has been on the net since the last century, and it has hardly changed.", "Write to me if you like it; I read all letters."],
    ),
}


@pytest.mark.parametrize("odd", ["<svg-icon></svg-icon>", "<title-bar>x</title-bar>", '<svg class="i" viewBox="0 0 1 1"/>', "<select-menu></select-menu>", "<template-x></template-x>", "<svg><path d=''/></svg>", "<select>", "<template>", "<svg:use/>"])
def test_html_odd_elements_hide_nothing(odd):
    """Elements whose names begin like those without text, self-closed and unclosed ones, before and within an article."""
    said = [f"Paragraph number {k} of this article tells a little more of the same long story, and goes on." for k in range(6)]
    body = [f"<p>{x}</p>" for x in said]
    model = html_crf.default_model()
    page = "<html><head><title>t</title></head><body><nav><a href=a>Home</a></nav>{}<article>{}</article><footer>Copyright</footer></body></html>"
    whole = html_crf.main_text(model, page.format("", "".join(body)))
    assert whole.split("\n") == said
    keep = lambda text: [x for x in text.split("\n") if x in said]
    assert keep(html_crf.main_text(model, page.format(odd, "".join(body)))) == said
    assert keep(html_crf.main_text(model, page.format("", "".join([*body[:3], odd, *body[3:]])))) == said


def test_html_on_other_layouts():
    """Recall and precision of blocks on layouts outside the generator's."""
    model = html_crf.default_model()
    right = kept = wanted = 0
    for page, texts in LAYOUTS.values():
        got = html_crf.main_text(model, page).split("\n")
        right += sum(x in texts for x in got)
        kept += len(got)
        wanted += len(texts)
    assert right / wanted >= 0.9 and right / kept >= 0.9


@pytest.mark.parametrize("page", ["<a " * 1_700_000, '<a "' * 400_000, "<div>x" * 500_000, "<!" * 500_000, "<select>" * 300_000, "<svg " * 300_000, "<div>" * 100_000 + "</b1>" * 100_000, "<ul>" + "<div>" * 30_000 + "<li></li>" * 30_000, "<p>&#" + "9" * 6000 + ";</p>", '<a "x" ' * 200_000 + '">"'], ids=range(10))
def test_html_broken_pages_take_linear_time(page):
    html_crf.main_text(html_crf.default_model(), page)


def test_html_awkward_rows(spark):
    rows = [(1, "u", "<article><p>One line of text here.</p></article>", "clash", "x")] * 2 + [(None, None, "<article><p>" + "Many words of text. " * 100_000 + "</p></article>", None, None)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string, text string, row string")
    got = html_crf.extract(d)
    assert got.columns == ["row", "text"] and sorted(len(x.text) for x in got.collect()) == [22, 22, 1_999_999]
    assert got.first().row.text == "clash" and html_crf.extract(d.limit(0)).count() == 0


def test_zip_warc(spark, monkeypatch):
    rows = [(1, "u\n1", "é body"), (2, None, "é body"), (3, "u", None), (4, "u", ""), (5, "u", "alone"), (None, "u", "alone"), (6, "u", "twice"), (6, "u", "twice")]
    d = spark.createDataFrame([(*x, "clash", 1) for x in rows], "page_id long, url string, html string, record_type string, owner long")
    got = sorted(map(tuple, zip_warc.round_trip(d).select("page_id", "payload_bytes", "record_type", "refers_to").collect()), key=str)
    want = [(1, 7, "revisit", 2), (2, 7, "response", None), (3, 0, "revisit", 4), (4, 0, "response", None), (5, 5, "response", None), (None, 5, "revisit", 5), (6, 5, "response", None), (6, 5, "response", None)]
    assert got == sorted(want, key=str)
    assert zip_warc.round_trip(d.limit(0)).count() == 0
    long = zip_warc.round_trip(spark.createDataFrame([(1, "u", "é" * 3_000_000), (None, None, None)], "page_id long, url string, html string")).collect()
    assert sorted((x.page_id or 0, x.payload_bytes) for x in long) == [(0, 0), (1, 6_000_000)]
    assert zip_warc.digest_of(b"x") == base64.b32encode(hashlib.sha1(b"x").digest()).decode()
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 10)
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    held = BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        for k in range(3):
            z.writestr(f"m{k}", b"some member data " * k)
        z.comment = b"a note with PK\x05\x06 and more, of twenty-two bytes or more"
    archive = zip_warc.ZipArchive(held, len(held.getvalue()))
    assert [archive.read(*archive.stored(f"m{k}")) for k in range(3)] == [b"some member data " * k for k in range(3)]


def test_quality(spark, empty):
    r = random.Random(6)
    rows = [(k, " ".join(f"{w}%%%" if k % 4 == 0 else w for w in prose(r, 50).split())) for k in range(400)] + [(400, None), (401, ""), (None, "x")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 4 != 0)) for k in range(400)] + [(999, 1), (5, None), (None, 0)], "doc_id long, quality int")
    out = quality.score(d, quality.fit(d, labels)).collect()
    held = [x for x in out if x.held_out and x.id is not None and x.id < 400]
    assert len(held) > 50 and sum(x.predicted == int(x.id % 4 != 0) for x in held) / len(held) > 0.95
    assert len(out) == 403 and all(0 <= x.score <= 1 for x in out)
    assert quality.score(empty, quality.fit(d, labels.limit(0))).count() == 0


def test_tokens(spark, empty):
    texts = ["One line\n\n\nnext  line\n", "", None, "é😀\n日本語 text", "x" * 5000]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    encoder = token_spans.Encoder(open(token_spans.VOCABULARY, "rb").read())
    for rule in token_spans.RULES:
        got = token_spans.section_tokens(d, rule=rule).collect()
        for k, t in enumerate(texts):
            rows = sorted((x for x in got if x.id == k), key=lambda x: x.section)
            start, end = encoder.spans(t or "")
            assert abs(sum(x.n_tokens for x in rows) - len(start)) < 1e-9 and sum(x.n_bytes for x in rows) == len((t or "").encode())
            if rule == "start":
                at = 0
                for x in rows:
                    assert x.n_tokens == sum(at <= s < at + x.n_bytes for s in start)
                    at += x.n_bytes
    assert token_spans.token_spans(encoder, texts[3])[-1][1] == len(texts[3])
    assert token_spans.section_tokens(empty).count() == 0


def test_secrets(spark, empty):
    key = "AKIA" + "Q" * 16
    t = f'é password = "abc123", Token:ab api-key=x {key} {"0a" * 12} and 7hQ2xLr9VbT4kWm8ZpC3nYd6 with get_user_account_setting_value'
    got = secrets.scan(spark.createDataFrame([(1, t), (2, None), (3, "")], "doc_id long, text string")).orderBy("id").collect()
    spans = [("assign", 2, 20), ("access", t.index(key), t.index(key) + 20), ("hex", t.index("0a0a"), t.index("0a0a") + 24)]
    base = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
    at = t.index("7hQ2")
    assert (got[0].n_assign, got[0].n_access, got[0].n_hex) == (1, 1, 1)
    assert got[0].base_sha256 == hashlib.sha256(base.encode()).hexdigest() and got[0].spans == base + f",markov:{at}:{at + 24}"
    assert all(x.spans == "" and x.base_sha256 == hashlib.sha256(b"").hexdigest() for x in got[1:])
    assert secrets.scan(empty).count() == 0


def test_secret_spans_leave_base_alone():
    """Against a scan of each character: the pieces of runs outside base spans."""
    r = random.Random(12)
    model, threshold = secrets.default_model()
    glue = [" ", "", "/", '"']
    for _ in range(60):
        parts = [secrets.random_sample(r), secrets.ordinary_sample(r), "token = " + secrets.random_sample(r), "0a1b2c3d" * 4, "plain words", "AKIA" + "Q7" * 9, "é"]
        text = "".join(r.choice(parts) + r.choice(glue) for _ in range(12))
        base = secrets.base_spans(text)
        free = [re.fullmatch("[A-Za-z0-9+/_=-]", c) is not None and not any(a <= k < z for a, _, z in base) for k, c in enumerate(text)]
        want, k = [], 0
        while k < len(text):
            z = k
            while z < len(text) and free[z]:
                z += 1
            whole = re.search("[A-Za-z0-9+/_=-]*$", text[:k])[0] + re.match("[A-Za-z0-9+/_=-]*", text[k:])[0]
            if z - k >= secrets.LEAST and len(whole) >= secrets.LEAST and model.score(text[k:z]) > threshold:
                want.append((k, 3, z))
            k = max(z, k + 1)
        assert secrets.markov_spans(text, base, model, threshold) == want
    key = "".join(r.choices(secrets.BASE62, k=40))
    text = f"AKIA{'Q' * 16}/{key}"
    assert secrets.markov_spans(text, secrets.base_spans(text), model, threshold) == [(20, 3, 61)]


def test_secret_recall_and_precision():
    """Planted strings of each alphabet and length among ordinary names that training has not seen."""
    r = random.Random(99)
    model, threshold = secrets.default_model()
    for letters in secrets.ALPHABETS.values():
        for n in (16, 20, 24, 40):
            found = [model.score("".join(r.choices(letters, k=n))) > threshold for _ in range(300)]
            assert sum(found) / 300 >= (0.9 if n == 16 else 0.98), (letters, n)
    plain = [
        "org.example.project.application.configuration", "ThisIsAVeryLongClassNameForTesting", "internationalization_and_localization", "https://example.com/some/long/path/to/a/resource", "2024-01-31T23-59-59",
        "1234567890123456", "UNDERSTANDABLE_CONSTANT_NAME", "Donaudampfschifffahrtsgesellschaft", "/usr/local/share/applications/editor", "anticonstitutionnellement", "=" * 30, "user_account_settings_page_2",
    ]
    assert not any(model.score(m[0]) > threshold for p in plain for m in secrets.CANDIDATE.finditer(p))


def test_secrets_on_awkward_rows(spark):
    rows = [(1, "q" * 2_000_000 + " password=" + "x" * 10), (1, None), (None, "AKIA" * 5_000), (None, "AKIA" * 5_000), (2, 'token: "' * 20_000)]
    d = spark.createDataFrame([(*x, "clash", 1) for x in rows], "doc_id long, text string, spans string, n_hex int")
    got = secrets.scan(d).collect()
    assert len(got) == 5 and sorted((r.id or 0, r.n_assign, r.n_access) for r in got) == [(0, 0, 1), (0, 0, 1), (1, 0, 0), (1, 1, 0), (2, 0, 0)]


def test_equal_rows_are_split(spark):
    """A third of the rows are one document: numbers and readings stay right, and no bucket or block holds them all."""
    from pyspark.sql import functions as F

    rows = [(-7 if k % 3 == 0 else k, "w " * 5 if k % 3 == 0 else f"w {k}", "s") for k in range(3000)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = sharding.shard_rows(d, shards=7, bucket_rows=50, carry=["doc_id"])
    # the largest task of a window reads a bucket: equal rows have their numbers far apart
    numbers = sorted(r.row_number for r in got.collect())
    assert numbers == list(range(3000))
    crowd = sorted(r.row_number for r in got.filter("row.doc_id = -7").collect())
    assert len(crowd) == 1000 and crowd[-1] - crowd[0] > 1500
    place = lambda x: sorted((r.row.doc_id, r.shard, r.slot) for r in x.collect())
    assert place(got) == place(sharding.shard_rows(d.repartition(3), shards=7, bucket_rows=50, carry=["doc_id"]))
    mixed = mixing.mix_sources(d, carry=["doc_id"], block_rows=50)
    assert mixed.count() == 3000 and mixed.filter("epoch > 0").count() == 0
    by_block = mixed.groupBy("block").agg(F.count(F.lit(1)).alias("n"))
    assert by_block.agg(F.max("n")).first()[0] < 200
    whole = mixing.mix_sources(d, block_rows=50)
    assert whole.count() == 3000 and whole.select("row.*").columns == d.columns
