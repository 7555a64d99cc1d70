import random
import re
from hashlib import sha256

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quadrille.llm import bpe, decontaminate, near_dup
from quadrille.llm.registry import tokenizer_path
from tests.llm import edge


def documents(sf_dir):
    return pd.read_parquet(f"{sf_dir}/documents.parquet")


def by_key(rows):
    return sorted(rows, key=repr)


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(tokenizer_path())
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def encoder():
    with open(tokenizer_path(), "rb") as f:
        return bpe.Encoder(f.read())


def test_bpe_equals_the_library_on_tables(spark, sf_dir, library):
    docs = documents(sf_dir)
    for rows, frame in (([(r[0], r[1]) for r in edge.rows()], edge.frame(spark, edge.CLASHES)), (list(zip(docs.doc_id, docs.text, strict=True)), spark.read.parquet(f"{sf_dir}/documents.parquet"))):
        want = []
        for i, t in rows:
            ids = library.encode(t or "", add_special_tokens=False).ids
            decoded = library.decode(ids, skip_special_tokens=False)
            want.append((i, len(ids), sha256(np.array(ids, "<u4").tobytes()).hexdigest(), sha256(decoded.encode()).hexdigest()))
        assert by_key(tuple(r) for r in bpe.tokens(frame, tokenizer_path(), digest=True).collect()) == by_key(want)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(min_codepoint=0, max_codepoint=0x2FF, exclude_categories=["Cs"]), st.sampled_from("the ing'sreve\t İΣςσẞ中文🙂é"))))
def test_bpe_equals_the_library_on_odd_texts(library, encoder, text):
    ids, decoded = next(encoder.encode([text]))
    want = library.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(ids, "<u4").tolist() == want
    assert decoded == library.decode(want, skip_special_tokens=False)


def test_bpe_speculation_accepts_most_words_and_is_exact(library, encoder):
    rng = random.Random(5)
    words = ["".join(rng.choice(["th", "er", "on", "an", "re", "qu", "x", "ß", "tion", "z", "lle", "é"]) for _ in range(rng.randint(1, 9))) for _ in range(4000)]
    got = encoder.encode_words(words)
    assert got == [library.encode(w, add_special_tokens=False).ids for w in words]
    assert 0 < encoder.counts["merged"] < encoder.counts["words"]


def test_bpe_ids(spark, library):
    got = {r.doc_id: r for r in bpe.tokens(edge.frame(spark), tokenizer_path()).collect()}
    assert list(got[19].ids) == library.encode(edge.TEXTS[19], add_special_tokens=False).ids
    assert list(got[0].ids) == [] and got[0].decoded == ""
    assert bpe.tokens(edge.frame(spark).limit(0), tokenizer_path()).count() == 0


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_components(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    holders = {}
    for i, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(i)
    for i, s in enumerate(sets):
        for j in {j for x in s for j in holders[x] if j < i}:
            both = len(s & sets[j])
            if 100 * both >= 75 * (len(s) + len(sets[j]) - both):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(root(i), []).append(i)
    out = []
    for members in groups.values():
        least = min(rows[i][0] for i in members)
        out += [(rows[i][0], len(sets[i]), least, rows[i][0] == least) for i in members]
    return out


def test_near_duplicates_equal_brute_force(spark, sf_dir):
    docs = documents(sf_dir)
    ids = [(r[0], r[1]) for r in edge.rows() if r[0] is not None]
    for rows, frame in ((ids, edge.frame(spark, edge.CLASHES).filter("doc_id IS NOT NULL")), (list(zip(docs.doc_id, docs.text, strict=True)), spark.read.parquet(f"{sf_dir}/documents.parquet"))):
        assert by_key(tuple(r) for r in near_dup.near_duplicates(frame).collect()) == by_key(brute_components(rows))


def test_near_duplicates_in_chains_and_large_buckets(spark):
    rng = random.Random(3)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    rows = []
    for i in range(150):  # each differs from the one before, so ends of the chain are unlike
        base = list(base)
        base[rng.randrange(120)] = f"x{i}"
        rows.append((1000 - i, " ".join(base)))
    rows += [(2000 + i, " ".join(base[:20])) for i in range(40)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert by_key(tuple(r) for r in near_dup.near_duplicates(frame).collect()) == by_key(brute_components(rows))


def test_near_duplicates_around_the_threshold(spark):
    """Random pairs on both sides of 0.75, families whose members are linked without their centre, and a family of hundreds: recall and precision are 1 here."""
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(10**7)}"
    rows = []

    def edited(words, n):
        out = list(words)
        for at in rng.sample(range(len(out)), n):
            out[at] = word()
        return out

    for _ in range(150):
        words = [word() for _ in range(rng.randrange(40, 300))]
        rows += [words, edited(words, max(1, round(len(words) * rng.uniform(0.01, 0.05))))]
    for _ in range(2):  # excerpts of one long text, and edits of the excerpts
        words = [word() for _ in range(400)]
        rows.append(words)
        for size in range(120, 400, 9):
            rows.append(edited(words[:size], rng.randrange(0, 9)))
    core = [word() for _ in range(200)]
    odd = edited(core, 9)
    rows += [edited(core, rng.randrange(1, 4)) for _ in range(500)] + [edited(odd, rng.randrange(1, 5)) for _ in range(40)]
    rng.shuffle(rows)
    rows = [(i, " ".join(w)) for i, w in enumerate(rows)]
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).collect()
    assert by_key(map(tuple, got)) == by_key(brute_components(rows))


def test_one_of_each_with_shared_ids(spark):
    rows = [(1, "a b c d e f g"), (1, "A b c d e f g"), (1, "other words are in this text"), (2, "a b c d e f g"), (2, "alone but of a shared id"), (3, ""), (3, None), (None, "a b c d e f g"), (None, "no row of this has any id"), (None, "No row of this has any id"), (None, "no row of this has any id")]
    got = near_dup.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, (r.text or "").lower()) for r in got) == [(0, "no row of this has any id"), (1, "a b c d e f g"), (1, "other words are in this text"), (2, "alone but of a shared id"), (3, ""), (3, "")]


def test_near_duplicates_without_ids_or_rows(spark):
    got = {r.doc_id: r for r in near_dup.near_duplicates(edge.frame(spark)).collect() if r.doc_id is None}
    assert got[None].component_id is None and got[None].kept
    assert near_dup.near_duplicates(edge.frame(spark).limit(0)).count() == 0


def test_half_bands_estimate_similarity():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 2**63, 2000, dtype=np.uint64)
    a, b = pool[:1400], pool[200:1600]  # similarity 0.75
    hits = (near_dup.half_bands([a])[0] == near_dup.half_bands([b])[0]).mean()
    assert 0.2 < hits < 0.9  # 0.5625 is expected


def test_decontamination_finds_exact_and_reparameterised(spark):
    items = [(1, "A train leaves the station at 60 km per hour and reaches Berlin after 4 hours. How far does it travel in 4 hours?"), (2, "short one"), (3, None), (4, "seven odd words make this item so")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    filler = "Some other words that have nothing to do with any of this stand here. "
    docs = [
        (1, filler + items[0][1] + " " + filler), (2, filler + items[0][1].replace("60", "75").replace("4", "3").replace("Berlin", "Paris")), (3, filler + items[0][1].replace("4 hours. How", "9 hours. How").replace("60", "1")),
        (4, filler), (5, None), (6, ""), (7, filler + items[0][1].upper()), (8, "x seven odd words make this item so y"), (9, "A train leaves the station"), (10, items[0][1].replace("after 4", "after 9").replace("60", "1").replace("km", "miles").replace("in 4 hours", "in 5 days")), (1, filler + items[0][1]),
    ]
    got = decontaminate.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()
    want = [(1, [1], False), (2, [1], True), (3, [1], True), (4, [], False), (5, [], False), (6, [], False), (7, [1], False), (8, [4], False), (9, [], False), (1, [1], False), (10, [], False)]
    assert by_key((r.doc_id, list(r["items"]), r.reparameterised) for r in got) == by_key(want)
    kept = decontaminate.clean(spark.createDataFrame(docs, "doc_id long, text string"), bench)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in got if not r.contaminated)


def test_decontamination_equals_brute_force(spark, sf_dir, monkeypatch):
    docs, bench = documents(sf_dir), pd.read_parquet(f"{sf_dir}/benchmark.parquet")
    words = lambda t: t.lower().split()
    want = {i: sorted(k for k, b in zip(bench.item_id, bench.text, strict=True) if f" {' '.join(words(b))} " in f" {' '.join(words(t))} ") for i, t in zip(docs.doc_id, docs.text, strict=True)}
    frame, table = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    got = decontaminate.decontaminate(frame, table).collect()
    assert {r.doc_id: list(r["items"]) for r in got} == want and any(want.values())
    monkeypatch.setattr(decontaminate, "SENT_ROWS", 0)  # joins by shuffles, a filter that is too small: the same answers
    monkeypatch.setattr(decontaminate, "BLOOM_LEAST", 1 << 20)
    monkeypatch.setattr(decontaminate, "BLOOM_BITS", 1 << 20)
    assert {r.doc_id: list(r["items"]) for r in decontaminate.decontaminate(frame, table).collect()} == want


def brute_judge(doc, item):
    """Every place of an item against a text, word by word, without windows or filter."""
    if not item.words:
        return None
    hits, k = [], min(len(item.words), decontaminate.WINDOW)
    alike = lambda i, j: doc.words[i] == item.words[j] or doc.named[i] == item.named[j] != decontaminate.LITERAL or doc.kind[i] == item.kind[j] != decontaminate.LITERAL
    for i in range(len(doc.words) - k + 1):
        for at in range(len(item.words) - k + 1):
            if all(alike(i + x, at + x) for x in range(k)):
                plain = all(doc.words[i + x] == item.words[at + x] for x in range(k))
                literal = any(item.kind[at + x] == decontaminate.LITERAL and doc.kind[i + x] == decontaminate.LITERAL for x in range(k)) or any(item.named[at + x] == decontaminate.LITERAL and doc.named[i + x] == decontaminate.LITERAL for x in range(k))
                if plain or literal:
                    hits.append((i, at, k))
    return decontaminate.judge(doc, item, hits)


def test_templates_equal_brute_force(spark):
    """Items with new numbers and names, some filled inconsistently, in other words: what the joins find is what every item against every text gives."""
    rng = random.Random(21)
    names, nouns = "Ada Ben Cleo Dan Eva Finn Gus Hal Ida Jon".split(), "apples pears coins books cups trains roads".split()
    made = lambda a, b, x, y, n: f"{a} has {x} {n} and gives {y} of them to {b} who sells each for {x} dollars. How much does {b} get for {y} {n}?"
    items = [(i, made(*rng.sample(names, 2), rng.randrange(5, 500), rng.randrange(5, 500), n)) for i, n in enumerate(nouns)]
    docs = []
    for i in range(80):
        n = rng.choice(nouns)
        text = made(*rng.sample(names, 2), rng.randrange(5, 500), rng.randrange(5, 500), n)
        if i % 4 == 1:
            text = " ".join("44" if w.isdigit() else w for w in text.split())  # two values became one
        if i % 4 == 2:
            text = " ".join(str(rng.randrange(9000)) if w.isdigit() else rng.choice(names) if w in names else w for w in text.split())
        filler = " ".join(rng.choice(["then", "it", "was", "12", "over", "Ada", "and", "gone."]) for _ in range(20))
        docs.append((i, f"{filler} {text} {filler}"))
    got = decontaminate.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    canon = decontaminate.Canon()
    parts = [(i, decontaminate.Text(t, canon)) for i, t in items]
    want = {d: [i for i, item in parts if brute_judge(decontaminate.Text(t, canon), item)] for d, t in docs}
    assert {r.doc_id: list(r["items"]) for r in got} == want
    assert all(want[d] for d in want if d % 4 in (0, 3)) and sum(not want[d] for d in want if d % 4 == 2) > 5


def test_slots_agree_both_ways():
    assert decontaminate.consistent([("12", "44"), ("5", "44"), ("7", "44")]) == 1
    assert decontaminate.consistent([("12", "1"), ("5", "2"), ("12", "1"), ("7", "3")]) == 4
    assert decontaminate.consistent([("12", "1"), ("12", "2")]) == 1 and decontaminate.consistent([]) == 0


def test_decontamination_finds_what_is_dense_short_or_long(spark):
    rng = random.Random(4)
    long = " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(100)).split()
    items = [(1, "What is 12 times 7 plus 30?"), (2, "Alice has 3 apples. Bob has 5 pears. Carol buys 4 of them for 2 days."), (3, "Seven odd words"), (4, " ".join(long)), (5, "1 2 3 4 5 6 7 8 9 10")]
    docs = [
        (1, "so What is 15 times 9 plus 44? he said"), (2, "Then. Dora has 6 apples. Emil has 9 pears. Fritz buys 8 of them for 7 days. End"), (3, "these are seven odd words indeed"),
        (4, "before " + " ".join(long[30:70]) + " after"), (5, "only " + " ".join(long[30:42]) + " here"), (6, "20 31 42 53 64 75 86 97 18 29 and 3 apples"), (7, "seven words"), (8, "x 1 2 3 4 5 6 7 8 9 10 y"),
        (9, "What was 15 times in 9 and 44?"),
    ]
    got = decontaminate.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {r.doc_id: (list(r["items"]), r.reparameterised) for r in got} == {1: ([1], True), 2: ([2], True), 3: ([3], False), 4: ([4], False), 5: ([], False), 6: ([], False), 7: ([], False), 8: ([5], False), 9: ([], False)}


def test_decontamination_edges(spark, sf_dir):
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    assert decontaminate.decontaminate(edge.frame(spark, edge.CLASHES), bench).count() == len(edge.rows())
    assert decontaminate.decontaminate(edge.frame(spark).limit(0), bench).count() == 0
    assert decontaminate.decontaminate(edge.frame(spark), bench.limit(0)).filter("contaminated").count() == 0
