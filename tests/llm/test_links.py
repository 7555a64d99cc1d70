"""op11, op12 and op13 against brute force, on small tables that try their edges."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from quadrille.llm import collocations, prefix_trie, simhash
from tests.llm import edge

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    runs = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    votes = [0] * 64
    for run in runs:
        h = xxhash.xxh64_intdigest(run.encode(), seed=42)
        for b in range(64):
            votes[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * votes[b] > len(runs))


def reached(values):
    """For each value the least index of those that it is linked with, over any number of steps."""
    left, out = set(range(len(values))), [None] * len(values)
    while left:
        todo, group = [left.pop()], []
        while todo:
            i = todo.pop()
            group.append(i)
            near = {j for j in left if (values[i] ^ values[j]).bit_count() <= 3}
            left -= near
            todo += near
        for i in group:
            out[i] = group
    return out


def components_of(rows):
    """(doc_id, fingerprint, component_id) of (doc_id, text) rows."""
    prints = [fingerprint(t) for _, t in rows]
    ids = [min((rows[j][0] for j in group if rows[j][0] is not None), default=None) for group in reached(prints)]
    return Counter((d, f"{p:016x}", c) for (d, _), p, c in zip(rows, prints, ids, strict=True))


@pytest.mark.parametrize("more", ["", "fp e at cell hub label first m " + edge.CLASHES])
def test_simhash_of_edge_texts(spark, more):
    found = simhash.near_duplicates(edge.frame(spark, more)).collect()
    assert Counter(map(tuple, found)) == components_of([r[:2] for r in edge.rows()])
    assert simhash.near_duplicates(edge.frame(spark).limit(0)).collect() == []


def test_majority_counts_more_than_255_hashes():
    rng = np.random.default_rng(5)
    sets = [rng.integers(0, 2**63, n, dtype=np.uint64) for n in (1, 0, 255, 256, 700, 2)]
    for hashes, got in zip(sets, simhash.majority(sets).tolist(), strict=True):
        assert got == sum(1 << b for b in range(64) if 2 * sum(int(h) >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("cell,groups", [(64, 6), (1, 6), (3, 8)])
def test_simhash_links_connect_what_all_pairs_connect(spark, monkeypatch, cell, groups):
    """Families around a few centres, pairs at every small distance, the top bit too; crowded cells and others."""
    monkeypatch.setattr(simhash, "CELL", cell)
    rng = random.Random(3)
    values = {0, 2**64 - 1}
    for _ in range(12):
        centre = rng.getrandbits(64)
        for flips in (0, 1, 2, 3, 4, 5, 6, 7, 9):
            value = centre
            for b in [63, *rng.sample(range(63), 20)][:flips]:
                value ^= 1 << b
            values.add(value)
    values = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    found = simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"), groups).collect()
    mask = (1 << 64) - 1
    assert all(((r.a ^ r.b) & mask).bit_count() <= 3 for r in found)
    known = {v: i for i, v in enumerate(signed)}
    group = list(range(len(values)))
    for _ in values:
        for r in found:
            group[known[r.a]] = group[known[r.b]] = min(group[known[r.a]], group[known[r.b]])
    assert group == [min(g) for g in reached(values)]


def test_exploded_fingerprints_are_not_broadcast(spark, monkeypatch):
    """Spark takes the points of a fingerprint for no more than itself; gathered in the driver they would be two thousand times as much."""
    nodes = spark.range(0, 40).selectExpr("id * 7 AS fp")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan(simhash.crowded_links(nodes))
    seen = []
    monkeypatch.setattr(simhash, "staged", lambda df, name, put=simhash.staged: (seen.append((name, plan(df))), put(df, name))[1])
    simhash.links(nodes)
    assert [("Broadcast" in p) for name, p in seen if name == "op11-shared"] == [False]


def test_crowded_cells_meet_in_a_finer_grid_before_points_are_listed(spark, monkeypatch):
    """80 fingerprints agree in three groups of six and in no five of eight; of these, none needs its points, and two are linked."""
    rng = random.Random(8)
    values = {(rng.getrandbits(32) << 32) | 0x55555555 for _ in range(80)}
    values |= {min(values) ^ 7 << 40}
    signed = [v - (1 << 64) if v >> 63 else v for v in sorted(values)]
    listed, points = [], simhash.crowded_links
    monkeypatch.setattr(simhash, "crowded_links", lambda nodes: (listed.append(nodes.count()), points(nodes))[1])
    nodes = spark.createDataFrame([(v,) for v in signed], "fp long")
    assert simhash.keyed(nodes).groupBy("at", "cell").count().filter(f"count > {simhash.CELL}").count() > 0
    linked = {frozenset((r.a, r.b)) for r in simhash.links(nodes).collect()}
    mask = (1 << 64) - 1
    assert linked == {frozenset((x, y)) for i, x in enumerate(signed) for y in signed[:i] if ((x ^ y) & mask).bit_count() <= 3} != set()
    assert listed == []


def test_embedding_distance_is_a_lower_bound(spark):
    rng = random.Random(1)
    pairs = [(a, a ^ sum(1 << b for b in set(rng.choices(range(63), k=rng.randrange(9))))) for a in (rng.getrandbits(63) for _ in range(200))]
    df = spark.createDataFrame(pairs, "a long, b long")
    for r in df.select("a", "b", simhash.apart(simhash.embedding(df.a), simhash.embedding(df.b)).alias("d")).collect():
        counts = lambda x: [(x >> s & 3).bit_count() for s in range(0, 64, 2)]
        assert r.d == sum(abs(x - y) for x, y in zip(counts(r.a), counts(r.b), strict=True)) <= (r.a ^ r.b).bit_count()


def phrases(rows, least, top=2000):
    """The contract, on (text, lang) rows."""
    counts, totals = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for i in range(len(words)):
                for k in range(1, min(5, len(words) - i) + 1):
                    counts[lang][tuple(words[i : i + k])] += 1
    out = []
    for lang, f in counts.items():
        often = {p: a for p, a in f.items() if a >= least}
        inside = {q[i:j] for q, b in often.items() for i in range(len(q)) for j in range(i + 1, len(q) + 1) if j - i < len(q) and often[q[i:j]] <= b}
        rows_ = []
        for p, a in often.items():
            if len(p) > 1 and p not in inside:
                cuts = [(1000 * a * totals[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p))]
                score, k = min(cuts)
                rows_.append((lang, " ".join(p), a, f[p[:k]], f[p[k:]], totals[lang], score))
        rows_.sort(key=lambda r: (-r[6], -r[2], r[1].encode()))
        out += [(r[0], i + 1, *r[1:]) for i, r in enumerate(rows_[:top])]
    return sorted(out)


def prose(n, seed=11):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(14)] + ["é", "ß", "\U0001f600", "a\xa0b", "x\x1cy"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    out = []
    for i in range(n):
        words = rng.choices(vocabulary, weights, k=rng.randrange(0, 40))
        text = "".join(w + rng.choice([" ", " ", "  ", "\t", " ", ", ", ".", "\n", "\r", "\x0b ", "! "]) for w in words)
        out.append((i, text.upper() if i % 7 == 0 else text, ("en", "de", None, "und", "a")[i % 5], "s", len(text)))
    return out


@pytest.mark.parametrize("part,held", [(500_000, 400_000), (20, 400_000), (500_000, 10)])
def test_collocations_equal_brute_force(spark, monkeypatch, part, held):
    """Also with pivots dealt in parts (of 20 words), and with more phrases of a pivot than are held."""
    monkeypatch.setattr(collocations, "LEAST", 4)
    monkeypatch.setattr(collocations, "PART", part)
    monkeypatch.setattr(collocations, "HELD", held)
    rows = [*prose(260), *[(900 + i, "one rare phrase of words stands here whole", "en", "s", 1) for i in range(9)], (None, None, None, None, None), (7, "", "en", "s", 0)]
    found = collocations.collocations(spark.createDataFrame(rows, DOC), top=30)
    assert sorted(map(tuple, found.collect())) == phrases([(r[1], r[2]) for r in rows], 4, 30)


def test_collocations_of_edge_texts(spark, monkeypatch):
    monkeypatch.setattr(collocations, "LEAST", 5)
    found = collocations.collocations(edge.frame(spark, "phrase n a l r f k hash pivot part parts before deal rank words word score"))
    assert sorted(map(tuple, found.collect())) == phrases([(r[1], r[2]) for r in edge.rows()], 5)
    assert collocations.collocations(edge.frame(spark).limit(0)).collect() == []
    assert collocations.collocations(edge.frame(spark).filter("text IS NULL")).collect() == []


def test_workers_hold_bounded_words_fragments_and_frames(monkeypatch):
    """Words of many languages share one table; a flush gives out frames of bounded size, and a fragment is held as one object."""
    monkeypatch.setattr(collocations, "KNOWN", 500)
    words, plain = collocations.Words(), {}
    for k in range(40):
        run = [b"w%d" % (i % 90 + 7 * k) for i in range(200)]
        for w, h in zip(run, words.hashes(f"l{k % 20}", run).tolist(), strict=True):
            assert plain.setdefault((k % 20, w), h) == h
        assert len(words.table) <= 500
    assert len(set(plain.values())) == len(plain)


@pytest.mark.parametrize("share", [0, 40])
def test_fragments_leave_in_bounded_frames(spark, monkeypatch, share):
    rng = random.Random(6)
    docs = spark.createDataFrame([(" ".join(rng.choices(["b", "\xe9", "d", "\U0001f600", "f"], [9, 5, 3, 2, 1], k=60)), ["en", "de"][i % 2]) for i in range(60)], "text string, lang string")
    monkeypatch.setattr(collocations, "LEAST", 5)
    words = collocations.word_counts(docs)
    known = spark.sparkContext.broadcast(collocations.counters(words))
    pairs = collocations.counted_pairs(docs, known)
    bits = spark.sparkContext.broadcast(collocations.pair_bits(pairs))
    everything = defaultdict(Counter)
    for frame in (None, 3):
        if frame:
            monkeypatch.setattr(collocations, "FRAME", frame)
            monkeypatch.setattr(collocations, "HELD", 50)
            monkeypatch.setattr(collocations, "ROW", 4)
        for r in collocations.fragments(docs, known, bits, share).collect():
            assert len(r.words) == len(r.before) == len(r.n) <= collocations.ROW and 0 <= r.part < r.parts
            everything[frame].update({(r.lang, r.pivot, r.parts, r.part, b, w): n for b, w, n in zip(r.before, r.words, r.n, strict=True)})
    assert everything[None] == everything[3] and len(everything[3]) > 100
    plain = Counter()
    for text, lang in docs.collect():
        w = text.split()
        plain.update((lang, *p) for p in zip(w, w[1:]))
    assert sorted(n for (n,) in pairs.select("n").collect()) == sorted(plain.values())


def test_scores_pass_64_bits_exactly(spark):
    n, a, l, r = 9_999_999_999_999_999, 3_333_333_333_333_331, 3_333_333_333_333_333, 3_333_333_333_333_337
    words = spark.createDataFrame([("en", "x", l), ("en", "y", r)], "lang string, word string, f long")
    got = collocations.scored(spark.createDataFrame([("en", "x y", 2, a)], "lang string, phrase string, size int, a long"), words, spark.createDataFrame([("en", n)], "lang string, n long"))
    assert [tuple(x) for x in got.collect()] == [("en", "x y", a, l, r, n, 1000 * a * n // (l * r))]


NONE = -(10**9)


def nodes_of(rows):
    """The contract, on (conv_id, turn, role, text) rows."""
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            own[c].append(((t is not None, t or 0), r or "", x or ""))
    turns = {c: [(r, x) for _, r, x in sorted(v, key=lambda v: (v[0], v[1].encode(), v[2].encode()))] for c, v in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 9
        seq = turns.get(c - (abs(c) % 5 if c > 0 else -(abs(c) % 5)), [])[:h] + turns[c][h:]
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
        ends[tuple(seq)].append(c)
    below = defaultdict(list)
    for k in members:
        if k:
            below[k[:-1]].append(k)
    sums = {}
    for k in sorted(members, key=len, reverse=True):
        saved = (len(members[k]) - 1) * len(k[-1][1].encode()) if k else 0
        sums[k] = (sum(sums[q][0] for q in below[k]) or 1, saved + sum(sums[q][1] for q in below[k]))
    digest = lambda k: hashlib.sha256(",".join(map(str, sorted(ends[k]))).encode()).hexdigest()
    return sorted((min(m), len(k), min(members[k[:-1]]) if k else NONE, len(m), len(below[k]), *sums[k], digest(k)) for k, m in members.items())


def talks(seed, n):
    """Conversations with few distinct turns, so that they share much; long ones, copies, nulls, ids below zero, missing groups' heads."""
    rng = random.Random(seed)
    out = []
    for c in [*range(-12, n), 10**6 + 3, 2**63 - 1]:
        if c % 11 == 4:
            continue
        same = random.Random(c // 6) if c % 3 else rng
        for t in range(rng.choice([1, 2, 3, 8, 11, 30])):
            out.append((c, None if t == 0 and c % 4 == 0 else t if c % 9 else t // 2, same.choice(["user", "assistant", None, ""]), same.choice(["yes", "no", "é\U0001f600", None, "", "yes" * 50])))
    out += [out[5], (None, 1, "user", "nobody")]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("run,seed", [(4000, 1), (3, 2)])
def test_trie_equals_brute_force(spark, run, seed):
    rows = talks(seed, 120)
    lists = prefix_trie.rebuilt(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'x' AS id", "1 AS at", "'y' AS key", "2 AS head", "3 AS own", "4 AS part"))
    found = prefix_trie.trie(lists, run).fillna(NONE)
    assert sorted(map(tuple, found.collect())) == nodes_of(rows)


def test_trie_of_copies_spans_tasks(spark, monkeypatch):
    """A third and more are one conversation; its ids come from many tasks and in several rows each."""
    monkeypatch.setattr(prefix_trie, "ENDS", 5)
    monkeypatch.setattr(prefix_trie, "PART", 20)
    rows = [(c, t, "user", f"turn {t}") for c in range(0, 300, 5) for t in range(9 if c % 2 else 3)] + [(c, 0, "user", "other") for c in range(1, 100, 5)]
    found = prefix_trie.prefix_trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).fillna(NONE)
    assert sorted(map(tuple, found.collect())) == nodes_of(rows)


def test_trie_without_conversations(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert prefix_trie.prefix_trie(empty).collect() == []
    assert prefix_trie.prefix_trie(spark.createDataFrame([(None, 1, "a", "b")], empty.schema)).collect() == []


def test_loser_tree_gives_the_sorted_entries_and_their_shares():
    rng = random.Random(4)
    entries = [([bytes([rng.choice(b"ab")]) for _ in range(rng.randrange(7))], i, []) for i in range(200)]
    for size in (1, 7, 64, 500):
        runs = [prefix_trie.sorted_run(entries[i : i + size]) for i in range(0, 200, size)]
        out = [(keys, conv) for _, keys, conv, _ in prefix_trie.merged(runs)]
        shares = [lcp for lcp, *_ in prefix_trie.merged(runs)]
        assert out == sorted((k, c) for k, c, _ in entries)
        for (a, _), (b, _), lcp in zip([([], 0), *out], out, shares, strict=False):
            assert lcp == next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    assert list(prefix_trie.merged([])) == []
