import math
import random
import re
import time
import zlib
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pandas as pd

import corpus_pipeline
from quadrille.llm import hmm, html_text, near_dup, pii, pu_quality
from quadrille.llm.words import WordTable
from tests.llm import edge
from tests.llm.test_free import brute_components, by_key


def documents(sf_dir):
    return pd.read_parquet(f"{sf_dir}/documents.parquet")


class Article(HTMLParser):
    """The text in <article>, as a plain parser has it."""

    def __init__(self):
        super().__init__()
        self.inside, self.out = 0, []

    def handle_starttag(self, tag, attrs):
        self.inside += tag == "article"
        if tag not in html_text.INLINE:
            self.out.append(" ")

    def handle_endtag(self, tag):
        self.inside -= tag == "article"
        if tag not in html_text.INLINE:
            self.out.append(" ")

    def handle_data(self, data):
        if self.inside:
            self.out.append(data)


def test_articles_equal_a_plain_parser(spark, sf_dir):
    pages = pd.read_parquet(f"{sf_dir}/pages.parquet")
    want = []
    for i, url, page in zip(pages.page_id, pages.url, pages.html, strict=True):
        p = Article()
        p.feed(page)
        text = " ".join("".join(p.out).split())
        want.append((i, url, text, len(text)))
    assert by_key(tuple(r) for r in html_text.main_text(spark.read.parquet(f"{sf_dir}/pages.parquet")).collect()) == by_key(want)


def test_structure():
    page = """<!doctype html><html><head><title>T</title><style>a{}</style></head><body class="post"><header><h1>Site</h1></header><nav>Menu</nav>
    <!-- <p>no</p> --><div id="cookie-notice">We use cookies</div><main><h1>A &amp; B</h1><p>One<b>two</b> three<br>four &lt;x&gt;</p><script>if (a < b) "</p>"</script>
    <aside>Side</aside><form><input name=q><p>Search</p></form><div class='comments'><p>First!</p></div><p hidden>secret</p><p style="display: none">gone</p>
    <ul><li>x</li><li>y</li></ul></main><footer>&copy; us</footer>"""
    assert [t for level, t in html_text.blocks(page) if level == html_text.MAIN] == ["A & B", "Onetwo three", "four <x>", "x", "y"]
    assert html_text.blocks('<article><p title="a hidden gem">x</p><header>h</header><p hidden="">y</p></article><div class="page-header">z</div>') == [(3, "x"), (3, "h"), (-1, "z")]
    assert html_text.blocks("") == [] and html_text.blocks("<p") == [(0, "<p")]
    assert html_text.blocks("<p title=\"un>closed</p>text<div class=ad>x") == [(0, "closed"), (0, "text"), (-1, "x")]
    long = "<div>" * 20_000 + "deep" + "</div>" * 20_000 + '<a b="' * 2000
    assert html_text.blocks(long)[0] == (0, "deep")


def test_names_of_state_and_the_bulk_of_a_page():
    area = lambda page: (lambda found: [found[i][1] for i in html_text.main_area(found)[1]])(html_text.marked_blocks(page))
    for page in ('<div class="wrapper has-sidebar"><article>a b c</article></div>', '<main class="content no-sidebar">a b c</main>', '<article class="post comments-open">a b c</article>', '<div class="content-sidebar-wrap"><article>a b c</article><p>side</p></div>'):
        assert area(page) == ["a b c"]
    assert area('<div class="comments"><article>first</article></div><p>x</p>') == ["x"]
    assert area('<h1 class="entry-title">T</h1><p>all of the body</p>') == ["T", "all of the body"]
    assert area("<main><h1>T</h1><article>body</article></main>") == ["T", "body"]
    assert area("<header><h1>Site</h1></header><article><h1>T</h1>body</article><p>more</p>") == ["T", "body"]


def test_parts_of_names_in_main_areas_and_beside_them():
    """In an article only whole names and names of nothing but boilerplate words count; a heading's id never does."""
    area = lambda page: " ".join((lambda found: [found[i][1] for i in html_text.main_area(found)[1]])(html_text.marked_blocks(page)))
    kept = ('<h2 id="related-work">a</h2>', '<section id="social-impact"><p>b</p></section>', '<h2 id="comment-on-results">c</h2>', '<div class="menu-planning">d</div>', '<p class="ad-hoc">e</p>', '<p>f <span class="share-price">g</span></p>', '<h3 id="comments">h</h3>')
    gone = ('<div class="comments">x</div>', '<ol class="comment-list"><li><article class="comment-body">x</article></li></ol>', '<ul class="share-buttons"><li>x</li></ul>', '<div id="ad-slot-3">x</div>', '<div class="related-posts">x</div>', '<article class="comment-body depth-1">x</article>', '<section class="newsletter-signup">x</section>')
    for tag in ("article", "main"):
        assert area(f"<{tag}>" + "".join(kept + gone) + f"</{tag}>") == "a b c d e f g h"
    prose = " ".join(f"w{i}" for i in range(html_text.PROSE_WORDS))
    assert area(f'<div id="social-impact"><p>{prose}</p></div><p>end</p>') == f"{prose} end"
    assert area(f'<div id="social-impact"><p>short</p></div><div class="x-menu"><a href="/">{prose}</a></div><div class="site-sidebar">{prose}</div><p>end</p>') == "end"
    assert area('<h1 class="page-header">T</h1><p>end</p>') == "T end"


def test_rests_of_large_hosts_are_no_batches(monkeypatch):
    """Batches end with a chunk, so random prose of a large host gives no candidates, however the rows are cut; repeats do."""
    rng = random.Random(3)
    words = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    foot = words(15)
    rows = [(i, "u", 1, i, 90, c, False, zlib.compress("\n".join([words(60), *([foot] if i % 2 else [])]).encode())) for c in range(3) for i in range(30 * c, 30 * c + 30)]
    rows[40:40] = [rows[40]] * 100  # one page's rows
    frame = pd.DataFrame(rows, columns="page_id url host page_key pages chunk area blocks".split())
    for size in (8 << 20, 9_000, 3_000):
        monkeypatch.setattr(html_text, "BATCH_CHARS", size)
        cut = [frame.iloc[i : i + 7] for i in range(0, len(frame), 7)]
        batches = list(html_text.whole_chunks(iter(cut)))
        assert sum(map(len, batches)) == len(frame) and sum(b["first"].sum() for b in batches) == 90
        found = [set(x) for out in html_text.searched(iter(cut)) if "numbers" in out and (out["kind"] == html_text.CANDIDATES).all() for x in out["numbers"]]
        assert found and set.intersection(*found)
        if size > 3_000:
            assert set.union(*found) == set.intersection(*found) and len(found[0]) == 4


def test_phrases_in_prose_stay(spark):
    """What half of a host's pages share goes where it is a block of its own, and stays where a paragraph says it."""
    rng = random.Random(10)
    words = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    phrase, rows, want = words(14), [], {}
    for i in range(12):
        body = f"{words(20)} {phrase} {words(20)}"
        rows.append((i, "http://a.example/x", f"<article><p>{body}</p><p>{phrase}</p></article>"))
        want[i] = body
    got = {r.page_id: r.text for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want


def brute_unique(pages):
    """Tokens of loose blocks that no other page of the host shares in a run of REPEAT; whole blocks where shorter."""
    def runs(block):
        w = block.split()
        k = min(html_text.REPEAT, len(w))
        return [(k, tuple(w[i : i + k])) for i in range(len(w) - k + 1)]

    where = {}
    for key, host, blocks in pages:
        for b in blocks:
            for r in runs(b):
                where.setdefault((host, r), set()).add(key)
    out = []
    for key, host, blocks in pages:
        kept = []
        for b in blocks:
            w, gone = b.split(), set()
            for i, r in enumerate(runs(b)):
                if len(where[host, r]) > 1:
                    gone |= set(range(i, i + r[0]))
            kept.append(" ".join(x for j, x in enumerate(w) if j not in gone))
        out.append((key, " ".join(k for k in kept if k)))
    return out


def test_repeats_are_removed_from_loose_pages(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    shared = " ".join(word() for _ in range(12))
    pages = []
    for i in range(30):
        host = f"h{i % 3}.example"
        blocks = [" ".join(word() for _ in range(25)), f"{word()} {shared} {word()}", "Home | About"]
        rng.shuffle(blocks)
        pages.append((i, host, blocks))
    rows = [(i, f"http://{host}/p{i}", "<body>" + "".join(f"<div>{b}</div>" for b in blocks)) for i, host, blocks in pages]
    rows.append((100, "http://alone.example/x", f"<p>{shared}</p>"))
    copy = " ".join(word() for _ in range(40))
    rows += [(200 + i, "http://copies.example/x", f"<p>{copy}</p>") for i in range(2)]
    rows += [(300, None, None), (301, "", ""), (302, "http://x/", "<nav>only menu</nav>"), (None, "http://y/", "<p>no id</p>")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS host", "'y' AS text", "1 AS rid", "2 AS level")
    got = {r.page_id: r.text for r in html_text.main_text(frame).collect()}
    assert {i: got[i] for i, _ in brute_unique(pages)} == dict(brute_unique(pages))
    assert got[100] == shared and got[200] == got[201] == copy
    assert got[300] == got[301] == got[302] == "" and got[None] == "no id"
    assert html_text.main_text(frame.limit(0)).count() == 0


def test_chance_phrases_and_copies_stay(spark):
    rng = random.Random(8)
    words = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    phrase, article, foot, line = words(8), words(60).split(), words(14), words(4)
    pages = {}
    for i in range(40):
        body = words(30).split()
        pages[i] = [" ".join(body[:15] + (phrase.split() if i < 2 else []) + body[15:]), *(["Introduction here"] if i < 2 else [])]
    for i in range(40, 52):  # near copies, more than LEAST and SHARE of the host
        pages[i] = [" ".join(article[:30] + words(8).split() + article[30:])]
    rows = [(i, "http://hot.example/x", "".join(f"<p>{b}</p>" for b in [*blocks, foot, line])) for i, blocks in pages.items()]
    got = {r.page_id: r.text for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: " ".join(blocks) for i, blocks in pages.items()}


def test_repeats_go_from_main_areas_too(spark):
    rng = random.Random(9)
    words = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    letter, advert, prose = words(8), words(15), words(20)
    rows, want = [], {}
    for i in range(12):
        texts = ["Read on", words(40), *([prose] if i < 4 else [])]
        shown = [*texts, letter, *([advert] if i % 3 else [])]
        rows.append((i, "http://a.example/x", "<nav>Menu</nav><article>" + "".join(f"<p>{t}</p>" for t in shown) + "</article>"))
        want[i] = " ".join(texts)
    rows += [(100 + i, "http://copies.example/x", f"<article><p>{prose}</p><p>{letter}</p></article>") for i in range(5)]
    got = {r.page_id: r.text for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want | {100 + i: f"{prose} {letter}" for i in range(5)}


def test_suffix_order_counts_equal_runs():
    rng = np.random.default_rng(4)
    table, hosts = WordTable(), rng.integers(0, 2, 30)
    pages = [[" ".join(map(str, rng.integers(0, 2, n))) for n in rng.integers(1, 40, 3)] for _ in range(30)]
    streams = html_text.Streams(table, pages, hosts)
    runs = html_text.Runs.of(streams)
    where = {}
    for p, texts in enumerate(pages):
        for t in texts:
            w = t.split()
            k = min(html_text.REPEAT, len(w))
            for i in range(len(w) - k + 1):
                where.setdefault((hosts[p], tuple(w[i : i + k]), k < html_text.REPEAT), set()).add(p)
    got = runs.pages(np.arange(30), np.ones(len(runs.start), bool))
    flat = [w for texts in pages for t in texts for w in t.split()]
    assert len(got) == sum(max(1, len(t.split()) - html_text.REPEAT + 1) for texts in pages for t in texts)
    for start, length, page, n in zip(runs.start, runs.length, runs.page, got, strict=True):
        assert len(where[hosts[page], tuple(flat[start : start + length]), length < html_text.REPEAT]) == n
    assert len(np.unique(runs.number)) == len(np.unique(runs.group)) == len(where)


def test_large_hosts_equal_whole_ones(spark, monkeypatch):
    """Chunks and candidates give what one suffix array over the whole host gives."""
    rng = random.Random(12)
    words = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    lines, article = [words(n) for n in (3, 7, 13, 20)], words(80).split()
    rows = []
    for i in range(300):
        blocks = [words(30), *(x for k, x in enumerate(lines) if rng.random() < (0.15, 0.6, 0.3, 0.9)[k])]
        if i % 9 == 0:
            blocks = [" ".join(article[: i // 9 + 20] + words(3).split() + article[i // 9 + 20 :])]
        tag = "article" if i % 3 else "div"
        rows.append((i, f"http://{'big' if i % 4 else 'other'}.example/x", f"<{tag}>" + "".join(f"<p>{b}</p>" for b in blocks) + f"</{tag}>"))
    rows += rows[:40]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    get = lambda: sorted(map(tuple, html_text.main_text(frame).collect()))
    chunked = get()
    monkeypatch.setattr(html_text, "SENT", 0)
    assert get() == chunked
    monkeypatch.setattr(html_text, "CHUNK", 10_000)
    assert get() == chunked and len(chunked) == 340
    text = " ".join(t for _, _, t, _ in chunked)
    assert lines[3] not in text and " ".join(article[-20:]) in text


def test_malformed_pages_take_linear_time():
    for page in ("<a " * 300_000, "<p>x" * 100_000 + "</b>" * 100_000, "<!" * 400_000, "<a b=\"" * 150_000, "<!--" * 200_000, "<b>" * 200_000 + "</i>" * 50_000, "<script>" * 50_000, "&" * 400_000, "<p " * 200_000 + ">"):
        began = time.process_time()
        html_text.marked_blocks(page)
        assert time.process_time() - began < 5, page[:20]


def test_classifier_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    got = pu_quality.classify(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")).toPandas()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in got.doc_id]).all()
    assert ((got.score >= 0.5) == (got.predicted == 1)).all() and got.score.between(0, 1).all()
    m = got.merge(pd.read_parquet(f"{sf}/labels.parquet"), on="doc_id")
    m = m[m.held_out]
    assert (m.predicted == m.quality).mean() > 0.95
    good, bad = m[m.quality == 1].score, m[m.quality == 0].score
    assert np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad]) > 0.97


def test_classifier_learns_nothing_from_held_out_labels(spark, sf_dir):
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    turned = labels.withColumn("quality", pu_quality.F.when(pu_quality.held_out(labels.doc_id), 1 - labels.quality).otherwise(labels.quality))
    one, two = (sorted(map(tuple, pu_quality.classify(docs, x).collect())) for x in (labels, turned))
    assert one == two


def test_classifier_edges(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    got = pu_quality.classify(edge.frame(spark, edge.CLASHES), labels).collect()
    assert len(got) == len(edge.rows()) and all(0 <= r.score <= 1 for r in got)
    assert all(r.score == 0.5 for r in pu_quality.classify(edge.frame(spark), labels.limit(0)).collect())
    assert pu_quality.classify(edge.frame(spark).limit(0), labels).count() == 0
    assert pu_quality.accepted(edge.frame(spark, edge.CLASHES), labels).columns == edge.frame(spark, edge.CLASHES).columns


def test_risk_is_minimised_without_negatives():
    rng = np.random.default_rng(0)
    k = len(pu_quality.FEATURES)
    good, bad = rng.normal(1, 1, (6000, k)), rng.normal(-1, 1, (6000, k))
    mix, other = np.vstack([good[:1400], bad[:600]]), np.vstack([good[4000:5400], bad[5000:5600]])
    tells = pu_quality.apart(good[5400:], other)  # on rows that the prior isn't read from
    positive = good[1400:3000]
    levels = np.append(-np.inf, np.quantile(tells.margin(good[5400:]), np.linspace(0, 0.99, 100)))
    above = lambda x: (tells.margin(x)[:, None] > levels[None, :]).sum(0).astype(float)
    prior = pu_quality.prior_of(above(mix), above(positive))
    assert abs(prior - 0.7) < 0.05
    model, inverse = pu_quality.started(tells, positive, mix, prior)
    x = pu_quality.design(np.vstack([mix, positive]), tells.edges, tells.mean, tells.spread)
    u = np.arange(len(x)) < len(mix)
    risk = lambda w: pu_quality.Risk.of(x, u, ~u, w)
    end = pu_quality.refined(model, inverse, risk)
    assert risk(end.weights).value(prior) <= risk(model.weights).value(prior) + 1e-6
    assert (end.score(good) >= 0.5).mean() > 0.97 and (end.score(bad[600:]) < 0.5).mean() > 0.97
    w, step = end.weights, 1e-6 * np.eye(len(end.weights))
    slope = np.array([(risk(w + d).value(prior) - risk(w - d).value(prior)) / 2e-6 for d in step[:20]])
    if risk(w).negative(prior) > 1e-3:
        assert np.allclose(slope, (risk(w).gradient(prior, w) - risk(w).ridge() * np.append(0, w[1:]))[:20], atol=1e-4)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_base(rows):
    fold = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    count = Counter()
    for i, t in rows:
        if not fold(i):
            count.update([*words(t), None])
    n, v = sum(count.values()), len(count)
    out = []
    for i, t in rows:
        ts = [*words(t), None]
        out.append((i, fold(i), len(ts), sum(count[x] > 0 for x in ts), n, round(sum(math.log10((count[x] + 0.1) / (n + 0.1 * (v + 1))) for x in ts), 5)))
    return out


def test_language_model_base_equals_brute_force(spark, sf_dir, monkeypatch):
    docs = documents(sf_dir)
    monkeypatch.setattr(hmm, "HEAVY", 3000)  # so that rare tokens are joined
    for rows, frame in (([(r[0], r[1]) for r in edge.rows()], edge.frame(spark, edge.CLASHES)), (list(zip(docs.doc_id, docs.text, strict=True)), spark.read.parquet(f"{sf_dir}/documents.parquet"))):
        got = hmm.score(frame).collect()
        assert by_key((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got) == by_key(brute_base(rows))
        assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert hmm.score(edge.frame(spark).limit(0)).count() == 0


def test_language_model_with_too_many_equal_counts(spark, monkeypatch):
    monkeypatch.setattr(hmm, "HEAVY", 20)  # the top step of counts has more tokens
    rows = [(i, " ".join(f"id{i}x{j}" for j in range(6)) + " " + " ".join(f"all{j}" for j in range(30))) for i in range(12)]
    got = hmm.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert by_key((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got) == by_key(brute_base(rows))
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)


def small_model(rng):
    norm = lambda x, axis: x / x.sum(axis, keepdims=True)
    return norm(rng.random(3), 0), norm(rng.random((3, 3)), 1), norm(rng.random((hmm.CLASSES, 3)), 0)


def test_forward_equals_the_sum_over_all_paths():
    rng = np.random.default_rng(4)
    model = small_model(rng)
    pi, move, emit = model
    sequences = [rng.integers(0, hmm.CLASSES, n) for n in (1, 5, 3, 5, 2)]
    ll, _, _ = hmm.Pack(sequences).forward(model)
    for s, got in zip(sequences, ll, strict=True):
        paths = np.array(np.meshgrid(*[range(3)] * len(s))).reshape(len(s), -1).T
        total = sum(pi[p[0]] * emit[s[0], p[0]] * math.prod(move[a, b] * emit[x, b] for a, b, x in zip(p, p[1:], s[1:], strict=False)) for p in paths)
        assert math.isclose(got, math.log(total), rel_tol=1e-9)


def test_expected_counts_raise_the_likelihood():
    rng = np.random.default_rng(6)
    sequences = [np.cumsum(rng.integers(0, 3, rng.integers(2, 60))) % 7 for _ in range(50)]
    pack, model, before = hmm.Pack(sequences), small_model(rng), -np.inf
    for _ in range(6):
        first, moves, emits, ll = pack.expected(model)
        assert ll > before - 1e-6
        assert math.isclose(first.sum(), 50) and math.isclose(moves.sum(), sum(len(s) - 1 for s in sequences)) and math.isclose(emits.sum(), sum(map(len, sequences)))
        before, model = ll, (first / first.sum(), moves / moves.sum(1, keepdims=True), (emits + 1e-9) / (emits + 1e-9).sum(0))


def test_chunks_of_a_long_text_equal_the_whole(monkeypatch):
    rng = np.random.default_rng(3)
    model, sequence = small_model(rng), rng.integers(0, hmm.CLASSES, 500)
    monkeypatch.setattr(hmm, "CHUNK", 64)
    whole, parts = hmm.Pack([sequence]), hmm.Long(sequence)
    assert len(parts.chunks) == 8 and np.allclose(whole.forward(model)[0], parts.forward(model)[0])
    for a, b in zip(whole.expected(model), parts.expected(model), strict=True):
        assert np.allclose(a, b)
    room = rng.random(hmm.CLASSES)
    assert np.allclose(whole.room_of(room), parts.room_of(room))
    batch = pd.DataFrame({"rid": [5, 6, 7], "classes": [s.astype("<i2").tobytes() for s in (sequence[:9], sequence, sequence[:70])]})
    assert sorted((tuple(ids), type(p).__name__) for ids, p in hmm.packs(iter([batch]))) == [((5,), "Pack"), ((6,), "Long"), ((7,), "Long")]


def test_token_probabilities_sum_to_one():
    h, c = np.arange(10, dtype=np.int64) * 7, np.arange(10, dtype=np.int64) + 1
    lexicon = hmm.Lexicon(h, c)
    count, klass = lexicon.find(np.array([14, 15, 63]))
    assert count.tolist() == [3, 0, 10] and klass.tolist() == [7, -1, 0]
    model = hmm.maximised(np.ones(8), np.ones((8, 8)), np.random.default_rng(0).random((hmm.CLASSES, 8)))
    assert np.allclose(model[2].sum(0), 1) and np.allclose(model[1].sum(1), 1) and math.isclose(model[0].sum(), 1)


def test_pipeline_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_duplicates", "benchmark", "personal_data", "tokens"]
    kept = docs
    for name, stage in corpus_pipeline.STAGES:
        before, kept = kept.toPandas(), stage(spark, kept, sf)
        after = kept.toPandas()
        if name != "tokens":
            assert list(after.columns) == list(corpus_pipeline.COLUMNS)
        ids = set(after.doc_id)
        if name == "quality":
            verdict = pu_quality.classify(docs, spark.read.parquet(f"{sf}/labels.parquet")).toPandas()
            assert ids == set(verdict[verdict.predicted == 1].doc_id) and len(ids) < len(before)
        elif name == "near_duplicates":
            assert ids == {i for i, _, least, _ in brute_components(list(zip(before.doc_id, before.text, strict=True))) if i == least}
        elif name == "benchmark":
            items = [" ".join(t.lower().split()) for t in pd.read_parquet(f"{sf}/benchmark.parquet").text]
            assert ids == {i for i, t in zip(before.doc_id, before.text, strict=True) if not any(f" {x} " in f" {' '.join(t.lower().split())} " for x in items)}
        elif name == "personal_data":
            assert ids == set(before.doc_id)
            clean = pii.pii_digest(spark.createDataFrame(after)).toPandas()
            assert clean[["n_email", "n_ip", "n_card", "n_phone"]].to_numpy().sum() == 0
        else:
            assert ids == set(before.doc_id) and (after.n_tokens > 0).all()
        kept = spark.createDataFrame(after) if name != "tokens" else kept
    assert by_key(tuple(r) for r in corpus_pipeline.run(spark, sf).collect()) == by_key(after.itertuples(index=False, name=None))


def test_pipeline_edges(spark):
    sf = "/root/testdata/sf0.001"
    for frame in (edge.frame(spark, edge.CLASHES), edge.frame(spark).limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, frame, sf).count() <= frame.count()
    once = near_dup.one_of_each(edge.frame(spark)).collect()
    assert sum(r.doc_id == 3 for r in once) == 1 and sum(r.doc_id is None for r in once) == 1 and not any(r.doc_id == 4 for r in once)
