"""The training-data operators against brute force, round trips and edge cases."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pyarrow.fs as pafs
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidelog.llm import chat, common, langid, mixing, packing, quality_rules, simhash, token_store, topk, toxicity, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = "word " * 30_000
EDGE = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "a b c d"), (6, "A B C D"), (6, "A B C D"), (7, LONG), (None, "no id at all here"), (8, "é " * 60), (9, "\x00 ퟿ x")]


def edge_docs(spark):
    return spark.createDataFrame([(i, t, "en", 3, 7) for i, t in EDGE], "doc_id long, text string, lang string, Score long, n_words long")


def documents(spark, sf_dir):
    return common.read(spark, sf_dir, "documents")


# 1: quality rules


def brute_signals(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    seen, dup = set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    windows = collections.Counter(zip(words, words[1:], words[2:]))
    repeat = sum(any(windows[tuple(words[j : j + 3])] > 1 for j in range(max(0, i - 2), min(i, len(words) - 3) + 1)) for i in range(len(words)))
    return [len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, repeat]


def test_quality_signals_equal_brute_force(spark, sf_dir):
    texts = [r.text for r in documents(spark, sf_dir).collect()] + [t for _, t in EDGE if t != LONG] + ["a b c a b c", "x\nx\n\nx", "a a a a a"]
    got = quality_rules.signals_of(texts)
    for k, text in enumerate(texts):
        assert [int(got[s][k]) for s in range(5)] == brute_signals(text), text


def test_quality_em_equals_a_plain_loop(spark, sf_dir):
    rows = quality_rules.judge(documents(spark, sf_dir), keep_text=False).collect()
    names = [n for n, _ in quality_rules.rules()]
    votes = [[getattr(r, f"vote_{n}") for n in names] for r in rows]
    q = [1 / (1 + np.exp(-(np.log(0.85 / 0.15) - 4.0 * v.count(0)))) for v in votes]
    was = -np.inf
    for _ in range(quality_rules.MAX_STEPS):
        counts = np.ones((2, len(names), 3))
        for v, p in zip(votes, q):
            for k, x in enumerate(v):
                counts[1, k, x] += p
                counts[0, k, x] += 1 - p
        chance = counts / counts.sum(2, keepdims=True)
        over = np.maximum(chance[1, :, 0] - quality_rules.MAX_FALSE_BAD, 0)
        chance[1, :, 0] -= over
        chance[1, :, 2] += over
        prior = (sum(q) + 1) / (len(q) + 2)
        logs = [[np.log(1 - prior if c == 0 else prior) + sum(np.log(chance[c, k, x]) for k, x in enumerate(v)) for c in (0, 1)] for v in votes]
        q = [1 / (1 + np.exp(b - a)) for b, a in logs]
        now = sum(np.logaddexp(*x) for x in logs)
        if abs(now - was) <= quality_rules.TOLERANCE * abs(now):
            break
        was = now
    for r, p in zip(rows, q):
        assert r.quality == pytest.approx(p, abs=1e-6)
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept == (not r.base_failed and r.quality >= 0.5)


def test_quality_agrees_with_labels(spark, sf_dir):
    sf = sf_dir.replace("0.001", "0.01")
    labels = {r.doc_id: r.quality for r in common.read(spark, sf, "labels").collect()}
    rows = [r for r in quality_rules.query(spark, sf).collect() if r.doc_id in labels and not r.base_failed]
    assert np.mean([r.kept == (labels[r.doc_id] == 1) for r in rows]) > 0.95


def test_quality_edges(spark):
    docs = edge_docs(spark)
    assert quality_rules.keep_good(docs).columns == docs.columns
    assert quality_rules.judge(docs, prefix="z_").count() == len(EDGE)
    assert quality_rules.keep_good(docs.limit(0)).count() == 0


# 10: toxicity


def test_toxicity_learns_and_is_sparse(spark):
    rng = random.Random(1)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    rows = [(i, " ".join(rng.choices(words, k=30) + (["badword"] if i % 4 == 0 else [])), int(i % 4 == 0)) for i in range(1200)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows if r[0] < 1000], "doc_id long, label int")
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert np.mean([(got[i] >= 0.5) == bool(y) for i, _, y in rows if i >= 1000]) > 0.97
    assert len(model[0]) // 4 < 2000


def test_toxicity_batch_equals_single(spark, sf_dir):
    texts = [r.text for r in documents(spark, sf_dir).limit(50).collect()] + [None, "", "A b"]
    row, bucket = toxicity._once(*toxicity.features(texts))
    for k, t in enumerate(texts):
        assert (bucket[row == k] == toxicity._once(*toxicity.features([t]))[1]).all()


def test_toxicity_edges(spark):
    docs = edge_docs(spark)
    labels = spark.createDataFrame([(4, 1), (5, 0), (5, None), (None, 1), (6, 0), (7, 0), (8, 0), (9, 0)], "doc_id long, toxic int")
    kept = toxicity.remove_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.count() == len(EDGE)
    assert {r.score for r in toxicity.score(docs, (b"", b"")).collect()} == {0.0}
    assert toxicity.remove_toxic(docs.limit(0), labels.limit(0)).count() == 0


# 3: SimHash


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode("utf-8", "surrogatepass"), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    """(id, fp) rows to {id: smallest id reached}."""
    parent = {i: i for i, _ in fps}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for (i, a), (j, b) in itertools.combinations(fps, 2):
        if bin(a ^ b).count("1") <= 4:
            x, y = sorted((root(i), root(j)))
            parent[y] = x
    return {i: root(i) for i in parent}


def test_fingerprints_equal_brute_force(spark, sf_dir):
    texts = [r.text for r in documents(spark, sf_dir).limit(60).collect()] + [t for _, t in EDGE]
    assert [simhash.fingerprint(t) for t in texts] == [brute_fingerprint(t) for t in texts]


def test_simhash_query_equals_brute_force(spark, sf_dir):
    rows = simhash.query(spark, sf_dir).collect()
    want = brute_components([(r.doc_id, int(r.fingerprint, 16)) for r in rows])
    assert {r.doc_id: r.component_id for r in rows} == want and len(set(want.values())) < len(want)


@pytest.mark.parametrize("chunk", [8, 512])
def test_links_keep_components(spark, monkeypatch, chunk):
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    rng = random.Random(chunk)
    fps = {}
    while len(fps) < 1200:  # chains of near values around some centres, and single ones
        f = rng.getrandbits(64)
        for _ in range(rng.choice([1, 1, 1, 60])):
            fps.setdefault(f, len(fps))
            for _ in range(rng.randint(1, 4)):
                f ^= 1 << rng.randrange(64)
    signed = [(v, f - (1 << 64) if f >> 63 else f) for f, v in fps.items()]
    found = simhash.components(simhash.class_links(spark.createDataFrame(signed, "vertex long, fp long")))
    got = {v: v for v in fps.values()} | {r.vertex: r.component for r in found.collect()}
    assert got == brute_components([(v, f) for f, v in fps.items()])


def test_masks_are_exact_at_any_size():
    rng = random.Random(3)
    for n in (10, 10**7, 10**9, 10**12):
        masks = simhash.masks(n)
        for _ in range(100):
            flip = sum(1 << b for b in rng.sample(range(64), 4))
            assert any(flip & m == 0 for m in masks)
    assert len(simhash.masks(10**10)) > len(simhash.masks(10))


def test_pivots_never_discard_a_link():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 2**63, 500).astype(np.uint64)
    b = a ^ (np.uint64(1) << rng.integers(0, 64, 500).astype(np.uint64))
    assert (np.abs(simhash.pivot_table(a) - simhash.pivot_table(b)).max(1) <= 1).all()


def test_simhash_edges(spark):
    docs = edge_docs(spark)
    rows = simhash.group(docs).collect()
    assert len(rows) == len(EDGE)
    by = collections.defaultdict(set)
    for r in rows:
        by[r.id].add(r.component_id)
    assert by[1] == by[2] == by[3] == {1} and by[5] == by[6] == {5} and by[None] == {None}
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "4", "5", "7", "8", "9", "None"]
    only = spark.createDataFrame([(6, "A B C D")] * 3, "doc_id long, text string")
    assert simhash.keep_one(only).count() == 1
    assert simhash.keep_one(docs.limit(0)).count() == 0


@pytest.mark.parametrize("keep", [simhash.keep_one, simhash.keep_one_near])
def test_clashing_ids_lose_no_text(spark, keep):
    texts = [" ".join(f"{x}{k}" for k in range(30)) for x in "abc"]
    rows = [(1, texts[0], "u"), (1, texts[1], "v"), (2, texts[0], "w"), (3, texts[2], "y"), (3, texts[2], "x")]
    schema = "doc_id long, text string, source string"
    want = [(1, texts[0], "u"), (1, texts[1], "v"), (3, texts[2], "x")]
    for some in (rows, rows[::-1]):
        assert sorted(tuple(r) for r in keep(spark.createDataFrame(some, schema)).collect()) == want


def brute_near(rows):
    """(id, text) rows to the smallest id of each group linked by Jaccard >= 0.8 of five-word shingles."""
    sets = {}
    for i, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(sets, 2):
        if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
            a, b = sorted((root(i), root(j)))
            parent[b] = a
    return {root(i) for i in sets}


@pytest.mark.parametrize("chunk", [8, 512])
def test_near_copies_equal_brute_jaccard(spark, sf_dir, monkeypatch, chunk):
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    rng = random.Random(7)
    rows = [(r.doc_id, r.text) for r in documents(spark, sf_dir).collect()]
    for k in range(12):  # copies with one to eight words changed, on both sides of the threshold
        words = [f"w{rng.randrange(900)}" for _ in range(120)]
        rows.append((10_000 + 10 * k, " ".join(words)))
        for n in range(1, 9):
            copy = list(words)
            for at in rng.sample(range(120), n):
                copy[at] = "changed"
            rows.append((10_000 + 10 * k + n, " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_near(rows)
    assert {r.doc_id for r in simhash.keep_one_near(docs).collect()} == want
    if chunk == 512:  # most of these copies are more than 4 bits apart
        assert simhash.keep_one(docs).count() > len(want)


def test_near_pairs_span_brute_force_components():
    rng = random.Random(3)
    for _ in range(30):
        sets = []
        for _ in range(rng.randint(1, 6)):  # families of sets around the threshold
            base = [rng.randrange(1 << 60) for _ in range(rng.choice([1, 4, 40]))]
            for _ in range(rng.randint(1, 12)):
                out = [x if rng.random() > 0.08 else rng.randrange(1 << 60) for x in base]
                sets.append(np.unique(np.array(out, np.uint64)))
        rng.shuffle(sets)
        n = len(sets)
        linked = [(i, j) for i in range(n) for j in range(i) if 5 * len(np.intersect1d(sets[i], sets[j])) >= 4 * len(np.union1d(sets[i], sets[j]))]
        label = lambda pairs: [min(x) for x in _spread(n, pairs)]
        got = simhash.near_pairs(sets)
        assert label(got) == label(linked) and {tuple(sorted(p, reverse=True)) for p in got} <= set(linked)


def _spread(n, pairs):
    """The component of each of ``n`` vertices, as a set."""
    group = [{i} for i in range(n)]
    for a, b in pairs:
        if group[a] is not group[b]:
            whole = group[a] | group[b]
            for x in whole:
                group[x] = whole
    return group


def test_near_copies_edges(spark):
    docs = edge_docs(spark)
    kept = simhash.keep_one_near(docs)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "4", "5", "7", "8", "9", "None"]
    assert simhash.keep_one_near(docs.limit(0)).count() == 0


def brute_print(shingles):
    """256 bits: each set if it is in over half of the hashes, or of splitmix64 of them in the words after the first."""
    mask, words = (1 << 64) - 1, []
    for k in range(4):
        hashes = []
        for h in shingles:
            h = (h + k * 0x9E3779B97F4A7C15) & mask
            if k:
                h = (h ^ h >> 30) * 0xBF58476D1CE4E5B9 & mask
                h = (h ^ h >> 27) * 0x94D049BB133111EB & mask
                h ^= h >> 31
            hashes.append(h)
        words.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)))
    return b"".join(w.to_bytes(8, "big") for w in words)


def test_near_prints_are_simhashes_of_five_word_sets(spark, sf_dir):
    texts = [r.text for r in documents(spark, sf_dir).limit(20).collect()] + [t for _, t in EDGE]
    for text in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        runs = {" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
        hashes = [xxhash.xxh64_intdigest(r.encode("utf-8", "surrogatepass"), 42) for r in runs]
        assert simhash.near_print(simhash.shingle_set(text)) == (brute_print(hashes) if hashes else None)


def test_near_masks_miss_no_link():
    rng = random.Random(5)
    for n in (100, 2000, 200_000, 10**7):
        usual, masks = simhash.near_masks(n)
        for some, differ in ((masks[:usual], 39), (masks, 48)):  # bits expected to differ at the threshold, and in sets of four and five
            for _ in range(200):
                flip = set(rng.sample(range(simhash.PRINT_BITS), differ))
                assert any(flip.isdisjoint(m) for m in some)


def near_prints(rng, n):
    """Rows of size and print: families around some centres, on both sides of the radius, and single ones."""
    rows = []
    while len(rows) < n:
        size, centre = rng.randint(5, 400), rng.getrandbits(256)
        for _ in range(rng.choice([1, 1, 1, 2, 40])):
            flip = sum(1 << b for b in rng.sample(range(256), rng.choice([0, 9, 30, 60])))
            rows.append((size + rng.randint(0, size // 3), centre ^ flip))
    rng.shuffle(rows)
    return rows[:n]


def brute_print_components(rows):
    linked = lambda a, b: bin(a[1] ^ b[1]).count("1") <= 84 and 5 * min(a[0], b[0]) >= 4 * max(a[0], b[0])
    pairs = [(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if linked(rows[i], rows[j])]
    return [min(x) for x in _spread(len(rows), pairs)], set(pairs)


def test_print_pairs_span_brute_force_components():
    rng = random.Random(9)
    for n in (1, 2, 9, 150, 400):
        rows = near_prints(rng, n)
        words = np.array([[size, *np.frombuffer(x.to_bytes(32, "big"), np.uint64)] for size, x in rows], np.uint64)
        want, linked = brute_print_components(rows)
        got = simhash.print_pairs(words)
        assert [min(x) for x in _spread(n, got)] == want and set(got) <= linked
        assert len(got) == n - len(set(want))


@pytest.mark.parametrize("limit", [None, 8])
def test_print_links_keep_components(spark, limit):
    rows = near_prints(random.Random(4), 700)
    classes = spark.createDataFrame([(k, size, x.to_bytes(32, "big")) for k, (size, x) in enumerate(rows)], "cls long, size long, print binary")
    found = simhash.components(simhash.print_links(classes, limit)).collect()
    got = {k: k for k in range(len(rows))} | {r.vertex: r.component for r in found}
    assert [got[k] for k in range(len(rows))] == brute_print_components(rows)[0]


def test_near_copies_are_found_by_prints_alone(spark, monkeypatch):
    words = [f"w{k}" for k in range(120)]
    rows = [(1, " ".join(words)), (2, " ".join([*words[:60], "changed", *words[61:]])), (3, " ".join(words))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert [r.doc_id for r in simhash.keep_one_near(docs).collect()] == [1]
    none = spark.createDataFrame([], "a long, b long")
    monkeypatch.setattr(simhash, "print_links", lambda classes, limit=None: none)
    assert sorted(r.doc_id for r in simhash.keep_one_near(docs).collect()) == [1, 2]  # equal sets are one class


# 2: mixing


def test_rates_equal_numpy(spark):
    rng = np.random.default_rng(2)
    p = rng.dirichlet([0.3, 0.3, 0.3], 400)
    n = rng.integers(0, 300, 400)
    table = spark.createDataFrame([(int(k), *map(float, x)) for k, x in zip(n, p)], "n_tokens long, p_a double, p_b double, p_c double")
    targets = {"a": 0.7, "b": 0.25, "c": 0.05}
    steps = mixing.fit_rates(table, ["a", "b", "c"], targets)
    got = [r[0] for r in table.select(mixing.rate_expression([F.col(f"p_{d}") for d in "abc"], steps)).collect()]
    tau, share = np.array(list(targets.values())), n @ p / n.sum()
    r, eta = np.ones(400), 1 / (1 + mixing.RIDGE)
    for _ in steps:
        g = (n * r) @ p / n.sum() - tau
        r = np.maximum(0, r * (1 - eta * mixing.RIDGE) + eta * mixing.RIDGE - eta * p @ (g / share))
    assert np.allclose(got, r, atol=1e-9) and min(got) >= 0
    assert np.allclose((n * r) @ p / n.sum(), tau, atol=0.01)


def totals_of(table, domains, steps):
    rate = mixing.rate_expression([F.col(f"p_{d}") for d in domains], steps)
    row = table.agg(*(F.sum(F.col("n_tokens") * rate * F.col(f"p_{d}")).alias(d) for d in domains)).first()
    return np.array([row[d] for d in domains])


def test_overlapping_posteriors_reach_targets(spark):
    rng = np.random.default_rng(2)
    p = rng.dirichlet([0.3, 0.3, 0.3], 400)
    n = rng.integers(0, 300, 400)
    table = spark.createDataFrame([(int(k), *map(float, x)) for k, x in zip(n, p)], "n_tokens long, p_a double, p_b double, p_c double")
    steps = mixing.fit_whole(table, list("abc"), {"a": 0.7, "b": 0.25, "c": 0.05})
    assert np.allclose(totals_of(table, "abc", steps) / n.sum(), [0.7, 0.25, 0.05], atol=mixing.MAX_GAP)


def test_unreachable_targets_are_reported(spark):
    table = spark.createDataFrame([(10, 0.5, 0.5), (20, 0.6, 0.4)], "n_tokens long, p_a double, p_b double")
    with pytest.warns(UserWarning, match="targets not reached"):
        mixing.fit_whole(table, ["a", "b"], {"a": 0.9, "b": 0.1})


def test_posteriors_count_absent_words(spark):
    # "x" documents have every word, "y" documents half of them: only what is absent tells a "y".
    rng = random.Random(5)
    words = [f"w{k}" for k in range(40)]
    rows = [(i, " ".join(words if i % 2 else rng.sample(words, 20)), "xy"[i % 2 == 0]) for i in range(800)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    model = mixing.fit_classifier(docs, spark.createDataFrame([(i, d) for i, _, d in rows if i < 600], "doc_id long, domain string"))
    right = {r.doc_id: (r.p_x > 0.5) == (r.doc_id % 2 == 1) for r in mixing.with_posteriors(docs, model).collect()}
    assert np.mean([ok for i, ok in right.items() if i >= 600]) > 0.97


def test_posteriors_on_held_out_labels(spark, sf_dir):
    sf = sf_dir.replace("0.001", "0.1")
    docs, labels = documents(spark, sf).select("doc_id", "text"), mixing.domain_of(common.read(spark, sf, "labels"))
    held = F.pmod(F.xxhash64(F.lit("held"), "doc_id"), F.lit(4)) == 0
    model = mixing.fit_classifier(docs, labels.where(~held))
    rows = mixing.with_posteriors(docs.join(labels.where(held), "doc_id"), model).drop("text").collect()
    names = ("clean", "low", "toxic")
    clean = [r for r in rows if r.domain == "clean"]
    called = [r for r in clean if r.p_toxic > max(r.p_clean, r.p_low)]
    assert len(clean) > 500 and len(called) < 0.02 * len(clean)
    top = [max(names, key=lambda d: r[f"p_{d}"]) for r in rows]
    share = {d: np.mean([r.domain == d for r in rows]) for d in names}
    accuracy, loss = np.mean([r.domain == t for r, t in zip(rows, top)]), -np.mean([np.log(r[f"p_{r.domain}"]) for r in rows])
    assert accuracy > max(share.values()) + 0.1 and loss < 0.4 * -sum(x * np.log(x) for x in share.values())
    for d in names:  # calibrated: expected shares are the real ones
        assert np.mean([r[f"p_{d}"] for r in rows]) == pytest.approx(share[d], abs=0.035)  # three standard errors of the sample


def test_classifier_equals_plain_naive_bayes(spark, sf_dir):
    docs, labels = documents(spark, sf_dir).select("doc_id", "text"), mixing.domain_of(common.read(spark, sf_dir, "labels"))
    model = mixing.fit_classifier(docs, labels)
    domain = {r.doc_id: r.domain for r in labels.collect()}
    hashed = docs.withColumn("b", mixing.buckets_of(mixing.tokens_of("text"))).collect()
    sets = [(domain[r.doc_id], set(r.b)) for r in hashed if r.doc_id in domain]
    for r, row in zip(hashed, mixing.with_posteriors(docs, model).collect()):
        words = [w for w in re.split(r"[ \t\n\x0b\f\r.,]+", (r.text or "").lower()) if w]
        assert row.n_tokens == len(words) and len(r.b) == len(set(r.b)) and max(r.b) < mixing.BUCKETS + mixing.SHAPES
        score = []
        for d in model["domains"]:
            n, total = len(sets), sum(x == d for x, _ in sets)
            value = np.log((total + 0.5) / (n + 0.5 * len(model["domains"])))
            for b in model["weights"]:
                share = (sum(x == d and b in s for x, s in sets) + 0.5) / (total + 1)
                whole = (sum(b in s for _, s in sets) + 0.5) / (n + 1)
                value += np.log(share / whole) if b in r.b else np.log((1 - share) / (1 - whole))
            score.append(value)
        z = model["calibration"] @ np.r_[np.array(score) - np.mean(score), 1.0]
        want = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert [row[f"p_{d}"] for d in model["domains"]] == pytest.approx(want.tolist(), abs=1e-3)


def test_calibration_is_a_minimum():
    rng = np.random.default_rng(4)
    label = rng.integers(0, 3, 500)
    scores = 8 * np.eye(3)[label] + rng.normal(0, 9, (500, 3))
    w = mixing.calibrate(scores, label, 3)
    x = np.c_[scores - scores.mean(1, keepdims=True), np.ones(500)]

    def loss(w):
        z = x @ w.T
        return (np.log(np.exp(z - z.max(1, keepdims=True)).sum(1)) + z.max(1) - z[np.arange(500), label]).mean()

    for _ in range(20):
        assert loss(w) <= loss(w + rng.normal(0, 0.02, w.shape)) + 1e-4


def test_repeated_rows_draw_apart(spark):
    docs = spark.createDataFrame([(7, "same text")] * 4000 + [(None, "same text")] * 4000, "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, domain string")
    out = mixing.rates(docs, labels, {"x": 1.0}).withColumn("copies", mixing.copies_of(F.lit(0.5), "doc_id"))
    assert out.count() == 8000
    table = docs.withColumn("at", F.monotonically_increasing_id())
    drawn = table.groupBy("doc_id").agg(F.avg(mixing.copies_of(F.lit(0.5), "doc_id", "at")).alias("m")).collect()
    assert all(r.m == pytest.approx(0.5, abs=0.05) for r in drawn)


def test_sources_reach_targets(spark, sf_dir):
    docs = documents(spark, sf_dir.replace("0.001", "0.01"))
    names = [r.source for r in docs.select("source").distinct().where("source is not null").collect()]
    targets = {s: 1 / len(names) for s in names}
    found = mixing.rates(docs.select("doc_id", "text"), mixing.source_domains(docs), targets)
    row = found.agg(*(F.sum(F.col("n_tokens") * F.col("rate") * F.col(f"p_{s}")).alias(s) for s in names)).first()
    assert {s: row[s] / sum(row) for s in names} == pytest.approx(targets, abs=0.005)


def test_copies_follow_any_rate(spark):
    rows = spark.range(20_000).select("id", *(mixing.copies_of(F.lit(r), "id").alias(f"r{k}") for k, r in enumerate((0.03, 0.97, 1.04, 2.0))))
    means = rows.agg(*(F.avg(f"r{k}") for k in range(4))).first()
    assert list(means) == pytest.approx([0.03, 0.97, 1.04, 2.0], abs=0.005) and means[3] == 2.0


def test_growing_mix_keeps_every_document(spark):
    docs = spark.createDataFrame([(i, "en" if i % 3 else "de") for i in range(3000)], "doc_id long, text string")
    out = mixing.mix(docs, docs.select("doc_id", F.col("text").alias("domain")), {"en": 0.5, "de": 0.5}, grow=True)
    assert out.select("doc_id").distinct().count() == 3000 and out.count() == pytest.approx(4000, rel=0.02)


def test_mixing_query_reaches_targets(spark, sf_dir):
    df = mixing.query(spark, sf_dir.replace("0.001", "0.1"))
    row = df.agg(*(F.sum(F.col("n_tokens") * F.col("rate") * F.col(f"p_{d}")).alias(d) for d in mixing.TARGETS)).first()
    total = sum(row)
    assert {d: row[d] / total for d in mixing.TARGETS} == pytest.approx(mixing.TARGETS, abs=2 * mixing.MAX_GAP)


def test_growing_rates_keep_every_document(spark):
    rng = np.random.default_rng(3)
    p = np.eye(4)[rng.choice(4, 300, p=[0.6, 0.2, 0.1, 0.1])]
    n = rng.integers(1, 300, 300)
    table = spark.createDataFrame([(int(k), *map(float, x)) for k, x in zip(n, p)], "n_tokens long, p_a double, p_b double, p_c double, p_free double")
    steps = mixing.fit_rates(table, ["a", "b", "c", "free"], {"a": 0.4, "b": 0.3, "c": 0.3}, grow=True)
    rate = np.array([r[0] for r in table.select(mixing.rate_expression([F.col(f"p_{d}") for d in ("a", "b", "c", "free")], steps)).collect()])
    total = (n * rate) @ p
    assert rate.min() > 0.99 and np.allclose(rate[p[:, 3] == 1], 1)
    assert np.allclose(total[:3] / total[:3].sum(), [0.4, 0.3, 0.3], atol=0.01)


def test_mixing_query_and_plan(spark, sf_dir):
    df = mixing.query(spark, sf_dir)
    rows = df.collect()
    assert len(rows) == documents(spark, sf_dir).count()
    assert all(abs(r.p_clean + r.p_low + r.p_toxic - 1) < 1e-9 and r.rate >= 0 for r in rows)
    assert not re.search("Python|Arrow|Pandas", df._jdf.queryExecution().toString())
    for r in rows:
        assert abs(r.copies - r.rate) <= 1
    assert [r.n_tokens for r in rows] == [r.n_tokens for r in df.collect()]


def test_mixing_edges(spark):
    docs = edge_docs(spark)
    domains = spark.createDataFrame([(4, "x"), (5, "y"), (99, "z")], "doc_id long, domain string")
    out = mixing.mix(docs, domains, {"x": 0.5, "y": 0.5})
    assert out.columns == docs.columns
    none = mixing.mix(docs, domains.limit(0), {"x": 1.0})
    assert none.count() == len(EDGE)
    assert mixing.mix(docs.limit(0), domains, {"x": 1.0}).count() == 0
    labels = spark.createDataFrame([(1, 0, 1), (2, 1, 1), (3, 1, 0), (4, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    assert {r.doc_id: r.domain for r in mixing.domain_of(labels).collect()} == {1: "low", 2: "toxic", 3: "clean"}


# 4: chat


def brute_chat(rows):
    convs = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    convs = {c: tuple(sorted(t)) for c, t in convs.items()}
    copies = collections.Counter(convs.values())
    first = {}
    for c in sorted(convs):
        first.setdefault(convs[c], c)
    proper = {t[:k] for t in copies for k in range(1, len(t))}
    return {c: (len(t), copies[t], "".join(f"<|im_start|>{r}\n{x}<|im_end|>\n" for _, _, r, x in t)) for t, c in first.items() if t not in proper}


def test_chat_equals_brute_force(spark):
    rng = random.Random(4)
    rows = []
    for c in range(150):
        n = rng.choice([1, 2, 3, 70, 130])
        base = rng.randrange(4)
        rows += [(c, t, "user" if t % 2 == 0 else "assistant", f"b{base} t{t}" + (" z" * (rng.random() < 0.02))) for t in range(n)]
    rows += [(500, 0, None, None), (500, None, "user", "early"), (500, 0, None, None), (None, 0, "user", "x"), (501, 0, "", "")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, position int")
    got = chat.render(df)
    texts = {r.conv_id: r.text for r in chat.whole_texts(got).collect()}
    meta = {(r.conv_id): (r.n_turns, r.n_copies) for r in got.collect()}
    assert {c: (*meta[c], texts[c]) for c in texts} == brute_chat(rows)
    for r in got.collect():
        assert texts[r.conv_id][r.start_char : r.start_char + len(r.rendered)] == r.rendered
    assert chat.render(df.limit(0)).count() == 0
    assert not re.search("Python|Arrow|Pandas", got._jdf.queryExecution().toString())


# 5: token files


def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    return path, Tokenizer.from_file(path)


def test_token_query_round_trip(spark, sf_dir):
    _, tok = tokenizer()
    docs = sorted((r.doc_id, r.text) for r in documents(spark, sf_dir).collect())
    got = {r.doc_id: r for r in token_store.query(spark, sf_dir).collect()}
    at = 0
    for i, text in docs:
        ids = np.array([*tok.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


_ENCODER = []


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=60), st.text(alphabet="aAbBzZéÉßñ .,!?'s<|endoftxar>1 \ṉ́Σİ　", max_size=60)), max_size=6))
def test_word_encoder_equals_the_tokenizer(texts):
    path, tok = tokenizer() if not _ENCODER else _ENCODER[0]
    if not _ENCODER:
        _ENCODER.append((path, tok))
        _ENCODER.append(token_store.WordEncoder(path))
    texts = [t.encode("utf-8", "replace").decode() for t in texts]
    ids, sizes = _ENCODER[1].encode(texts)
    want = [tok.encode(t, add_special_tokens=False).ids for t in texts]
    assert sizes.tolist() == [len(w) for w in want] and ids.tolist() == [x for w in want for x in w]


def test_word_encoder_with_a_full_cache(monkeypatch):
    monkeypatch.setattr(token_store, "CACHE_BYTES", 500)
    path, tok = tokenizer()
    enc = token_store.WordEncoder(path)
    for k in range(6):
        texts = [f"alpha beta{k} gamma {k} delta, Epsilon Ünder œuvre{k}"] * 2 + [None]
        ids, sizes = enc.encode(texts)
        want = [tok.encode(t or "", add_special_tokens=False).ids for t in texts]
        assert ids.tolist() == [x for w in want for x in w]
    assert enc.known.bytes < 5000 and enc.old.bytes < 5000


def test_any_tokenizer_and_vocabulary(spark):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = tokenizer()[1].from_file(path)
    texts = ["It's  one\n\ntwo ", "", "Zwölf <|endoftext|> é"]
    enc = token_store.WordEncoder(path)
    ids, sizes = enc.encode(texts)
    assert not enc.by_word and ids.tolist() == [i for t in texts for i in tok.encode(t, add_special_tokens=False).ids]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = token_store.read(token_store.write(docs, common.scratch_path(spark, "t"), path, 70_000, 70_001)).collect()
    for r in rows:
        want = np.array([*tok.encode(texts[r.doc_id], add_special_tokens=False).ids, 70_000], "<u4")
        assert (r.n_tokens, r.ids_crc32) == (len(want), zlib.crc32(want.tobytes()))


def test_pieces_files_and_repeated_ids(spark, monkeypatch):
    """Tiny bounds: texts in pieces, many files, one id with most of the rows, and ids read piece by piece."""
    for name, value in (("PIECE", 40), ("FILE_DOCS", 3), ("READ_IDS", 8), ("READ_DOCS", 2)):
        monkeypatch.setattr(token_store, name, value)
    path, tok = tokenizer()
    rng = random.Random(4)
    text = lambda n: " ".join(rng.choice(["alpha", "beta,", "42", "ça", "—x"]) for _ in range(n))
    rows = [(7, text(rng.randint(0, 9))) for _ in range(60)] + [(7, "same")] * 20 + [(1, text(50)), (None, text(3)), (9, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    enc = token_store.WordEncoder(path)
    whole = list(enc.pieces([t for _, t in rows]))
    assert sum(int(last.sum()) for _, last in whole) == len(rows) and max(sum(map(len, x)) for x, _ in whole) <= 50
    got = token_store.read(token_store.write(docs, common.scratch_path(spark, "t"), path, 2, 49408)).orderBy("start").collect()
    want = collections.Counter()
    for i, t in rows:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want[i, len(ids), zlib.crc32(ids.tobytes())] += 1
    assert collections.Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1].tolist()]
    assert [r.doc_id or 0 for r in got] == sorted(r.doc_id or 0 for r in got)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 20), st.integers(1, 300), st.integers(1, 50), st.integers(0, 999))
def test_files_give_random_access(tmp_path_factory, bits, n, block, seed):
    rng = random.Random(seed)
    path = f"file://{tmp_path_factory.mktemp('tok')}/x.tok"
    w = token_store.Writer(path, bits, block)
    docs = []
    while sum(map(len, docs)) < n:
        docs.append(np.array([rng.randrange(1 << bits) for _ in range(rng.randint(0, 40))], np.uint32))
    for d in docs:
        w.add(d, np.array([len(d)]), [len(docs)])
    w.close()
    r = token_store.Reader(path)
    flat = np.concatenate(docs)
    assert (r.ids(0, len(flat)) == flat).all()
    a, b = sorted((rng.randint(0, len(flat)), rng.randint(0, len(flat))))
    assert (r.ids(a, b) == flat[a:b]).all() and r.n_docs == len(docs)


def test_token_edges(spark):
    path, tok = tokenizer()
    docs = spark.createDataFrame([(3, "b"), (1, None), (2, ""), (3, "b"), (None, "x")], "doc_id long, text string")
    rows = sorted(token_store.read(token_store.write(docs, common.scratch_path(spark, "t"), path, 2, 49408)).collect(), key=lambda r: r.start)
    assert [(r.doc_id, r.start) for r in rows] == [(None, 0), (1, 2), (2, 3), (3, 4), (3, 6)]
    assert token_store.read(token_store.write(docs.limit(0), common.scratch_path(spark, "t"), path, 2, 49408)).count() == 0


# 6: WARC


def test_audit_finds_exactly_the_damage(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(warc, "FAN", 4)
    pages = common.read(spark, sf_dir, "pages").repartition(3)
    base = common.scratch_path(spark, "w")
    index = warc.write(pages, f"{base}/a")
    warc.copy(index, f"{base}/a", f"{base}/b", F.col("page_id") % 31 == 5)
    bad = index.join(warc.audit(index, f"{base}/a", f"{base}/b"), ["file_no", "seq"])
    assert sorted(r.page_id for r in bad.collect()) == [r.page_id for r in pages.where("page_id % 31 = 5").orderBy("page_id").collect()]
    warc.copy(index, f"{base}/a", f"{base}/c", F.lit(False))
    assert warc.audit(index, f"{base}/a", f"{base}/c").count() == 0
    row = index.where("page_id = 3").first()
    fs, inner = pafs.FileSystem.from_uri(f"{base}/a/{row.name}")
    import gzip

    headers, block = warc.parse(gzip.decompress(fs.open_input_file(inner).read_at(row.last - row.first, row.first)))
    page = pages.where("page_id = 3").first()
    assert block == page.html.encode() and headers["WARC-Target-URI"] == page.url and row.block_digest == hashlib.sha256(block).hexdigest()
    gone, _ = pafs.FileSystem.from_uri(f"{base}/c/{row.name}")
    gone.delete_file(pafs.FileSystem.from_uri(f"{base}/c/{row.name}")[1])
    assert warc.audit(index, f"{base}/a", f"{base}/c").count() == index.where(F.col("name") == row.name).count()


def test_warc_edges(spark):
    pages = spark.createDataFrame([(1, None, None, 1), (None, "u", "<p>", 2), (2, "é", "ü" * 200_000, 3), (2, "é", "", 3)], "page_id long, url string, html string, seq long")
    base = common.scratch_path(spark, "w")
    index = warc.write(pages, f"{base}/a")
    assert index.count() == 4
    warc.copy(index, f"{base}/a", f"{base}/b", F.col("page_id") == 1)
    assert warc.audit(index, f"{base}/a", f"{base}/b").count() == 1
    assert warc.audit(warc.write(pages.limit(0), f"{base}/z"), f"{base}/z", f"{base}/z").count() == 0


# 7: language


def test_paths_equal_viterbi():
    rng = np.random.default_rng(7)
    for _ in range(60):
        sizes = rng.integers(0, 60, 8)
        score = -rng.exponential(1.5, (int(sizes.sum()), 4)) * rng.integers(0, 2, (int(sizes.sum()), 4))
        score = np.maximum(score, -langid.WORD_BOUND).astype(np.float32)
        got, at = langid.paths(score, sizes, 3.0), 0
        for n in sizes:
            part = score[at : at + n]
            if n:
                value = lambda p, s=part: sum(s[range(len(p)), p]) - 3.0 * (np.diff(p) != 0).sum()
                assert value(got[at : at + n]) == pytest.approx(value(np.array(langid.viterbi(part, 3.0))), abs=1e-3)
            at += n


def test_viterbi_equals_enumeration():
    rng = np.random.default_rng(8)
    for _ in range(20):
        s = rng.normal(size=(6, 3))
        value = lambda p, s=s: s[range(6), p].sum() - (np.diff(p) != 0).sum()
        best = max(value(list(p)) for p in itertools.product(range(3), repeat=6))
        assert value(langid.viterbi(s, 1.0)) == pytest.approx(best)


def test_language_accuracy_and_spans(spark, sf_dir):
    sf = sf_dir.replace("0.001", "0.01")
    lang = {r.doc_id: r.lang for r in documents(spark, sf).collect()}
    rows = [r for r in langid.query(spark, sf).collect() if r.held_out]
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in rows]) > 0.95
    model = langid.Model(*__import__("pickle").loads(langid.fit(documents(spark, sf))))
    texts = {k: next(r.text for r in documents(spark, sf).collect() if r.lang == k and len(r.text) > 2000)[:1500] for k in ("de", "fr")}
    _, _, spans = langid.label(model, [texts["de"] + " " + texts["fr"]])
    assert {s[2] for s in spans[0]} >= {"de", "fr"}


def test_scripts_narrow_candidates():
    counts, scripts = np.ones((2, langid.BUCKETS)), np.zeros((2, langid.N_SCRIPTS))
    scripts[0, 1] = scripts[1, 3] = 100
    model = langid.Model(["en", "ru"], counts, scripts)
    score, _ = model.word_scores(["привет".encode(), b"hello"])
    assert score[0].tolist() == [-langid.WORD_BOUND, 0.0] and score[1].tolist() == [0.0, -langid.WORD_BOUND]


def test_language_edges(spark):
    docs = edge_docs(spark)
    model = langid.fit(spark.createDataFrame([(1, "the word one", "en"), (2, "das wort eins", "de"), (3, None, "de"), (4, "x", None)], "doc_id long, text string, lang string"))
    rows = langid.with_language(docs, model).collect()
    assert {r.doc_id: r.lang_pred for r in rows if r.doc_id in (1, 2, 3)} == {1: "und", 2: "und", 3: "und"} and all(0 <= r.score <= 1 for r in rows)
    none = langid.fit(docs.limit(0))
    assert {r.lang_pred for r in langid.with_language(docs, none).collect()} == {"und"}


# 8: top-k


def brute_topk(rows, k=5):
    rows = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v)]
    out = {}
    for i, v in rows:
        if i % 50 == 0:
            score = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in rows if j != i and len(w) == len(v))
            out[i] = [(j, -s) for s, j in score[:k]]
    return out


def test_topk_keeps_large_components(spark):
    rows = [(1, [1.0, 2.0]), (2, [9e6, 0.0]), (50, [3.0, -1.0]), (4, [-2e7, 5.0])]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    vectors = topk.quantise(docs, "vec_id", "embedding")
    got = [(r.vec_id, r.score) for r in topk.search(vectors, vectors.where("id = 50")).orderBy("rank").collect()]
    assert got == [(2, 65536 * 27_000_000), (1, 65536), (4, 65536 * -60_000_005)]
    with pytest.raises(OverflowError):
        topk.search(vectors, topk.quantise(docs.selectExpr("vec_id", "transform(embedding, c -> c * 1e6D) AS embedding"), "vec_id", "embedding"))


def test_topk_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_ROWS", 100)
    monkeypatch.setattr(topk, "BLOCK_QUERIES", 3)
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.choice([-0.6, -0.1, 0.0, 0.25, 0.7], 6)]) for i in range(400)]
    rows += [(400, None), (450, [0.1, float("nan")] * 3), (500, [1.0, None] * 3), (550, []), (600, [0.5] * 3), (601, [0.5] * 3), (650, [float("inf")] * 6), (700, [0.0] * 6), (401, rows[7][1]), (402, rows[7][1])]
    vectors = topk.quantise(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), "vec_id", "embedding")
    got = collections.defaultdict(list)
    for r in topk.search(vectors, vectors.where("id % 50 = 0")).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    want = brute_topk([(i, None if v is None else [None if x is None else np.float32(x) for x in v]) for i, v in rows])
    assert dict(got) == {q: v for q, v in want.items() if v}
    assert topk.search(vectors.limit(0), vectors.limit(0)).count() == 0


def test_slices_add_up():
    rng = np.random.default_rng(6)
    for _ in range(10):
        v, q = rng.integers(-300, 300, (130, 5)), rng.integers(-300, 300, 5)
        low = int(v.min())
        bits = int(v.max() - low).bit_length()
        score = topk.add_slices(topk.slices_of(v, low, bits), q)
        alive = np.packbits(np.r_[np.ones(130, np.uint8), np.zeros(62, np.uint8)], bitorder="little").view(np.uint64)
        rows, value = topk.best(score, alive, 130)
        exact = value + low * q.sum() + ((1 << bits) - 1) * q[q < 0].sum()
        assert sorted(rows.tolist()) == list(range(130)) and (exact == v[rows] @ q).all()


# 9: packing


def test_boundaries_equal_enumeration():
    rng = random.Random(9)
    for _ in range(40):
        lengths = np.array(sorted(rng.sample(range(1, 40), rng.randint(1, 8))))
        counts = np.array([rng.randint(1, 9) for _ in lengths])
        cost = lambda bounds: sum(c * (min(b for b in bounds if b >= x) - x) for x, c in zip(lengths, counts))  # noqa: E731, B023
        for k in (1, 2, 3):
            best = min(cost([*c, lengths[-1]]) for r in range(k) for c in itertools.combinations(lengths, r))
            got = packing.boundaries(lengths, counts, k)
            assert len(got) <= k and got[-1] == lengths[-1] and cost(got) == best


def test_packing_is_whole_and_within_budget(spark, sf_dir):
    docs = documents(spark, sf_dir).unionByName(edge_docs(spark).select("doc_id", "text", "lang", F.lit("s").alias("source"), F.lit(1).cast("long").alias("n_chars")))
    rows = packing.pack(packing.pieces_of(docs), buckets=6, budget=8000).collect()
    total = sum(len(WORD.findall(r.text or "")) + 1 for r in docs.collect())
    assert sum(r.n_tokens for r in rows) == total
    batches = collections.defaultdict(list)
    for r in rows:
        assert r.n_tokens <= r.bucket and r.padding == r.bucket - r.n_tokens
        batches[r.batch_id].append(r)
    for b in batches.values():
        assert len({r.bucket for r in b}) == 1 and sorted(r.slot for r in b) == list(range(len(b)))
        assert len(b) <= max(1, 8000 // b[0].bucket)
    full = collections.Counter((b[0].bucket, len(b) == max(1, 8000 // b[0].bucket)) for b in batches.values())
    assert all(n <= 1 for (_, whole), n in full.items() if not whole) and sorted(batches) == list(range(len(batches)))
    order = sorted((r for r in rows if r.bucket == rows[0].bucket), key=lambda r: (r.batch_id, r.slot))
    assert [(r.doc_id is not None, r.doc_id or 0, r.piece) for r in order] == sorted((r.doc_id is not None, r.doc_id or 0, r.piece) for r in order)
    assert packing.pack(packing.pieces_of(docs.limit(0))).count() == 0


# the pipeline


def test_pipeline_stages(spark, sf_dir):
    import corpus_pipeline as cp

    docs = documents(spark, sf_dir)
    columns = docs.columns
    for k, (_, stage) in enumerate(cp.STAGES):
        before = docs.count()
        new = common.materialize(stage(spark, docs, sf_dir), f"t{k}")
        if k == 0:
            ok = {r.doc_id for r in quality_rules.query(spark, sf_dir).where("kept").collect()}
            assert {r.doc_id for r in new.collect()} == ok
        if k == 3:  # none is lost, scarce languages are repeated
            copies = collections.Counter(r.doc_id for r in new.collect())
            assert set(copies) == {r.doc_id for r in docs.collect()} and max(copies.values()) >= 2
        if k == 2:
            assert {r.doc_id for r in new.collect()} == brute_near([(r.doc_id, r.text) for r in docs.collect()])
        if k < 3:
            assert new.count() <= before
        if k < len(cp.STAGES) - 1:
            assert new.columns == columns
            docs = new
    assert sum(r.n_tokens for r in new.collect()) == sum(len(WORD.findall(r.text or "")) + 1 for r in docs.collect())


def test_pipeline_run_leaves_two_tables_of_stages(spark, sf_dir):
    import corpus_pipeline as cp

    start = common.mark()
    out = cp.run(spark, sf_dir)
    left = common._written[start:]
    assert "/stage3-" in left[0] and not any("/stage" in path or "/quality-" in path or "/classes-" in path for path in left[1:])
    assert out.count() > 0


def test_pipeline_of_nothing(spark, sf_dir):
    import corpus_pipeline as cp

    docs = documents(spark, sf_dir).limit(0)
    for _, stage in cp.STAGES:
        docs = common.materialize(stage(spark, docs, sf_dir), "none")
    assert docs.count() == 0


# edges that all share


def clashing(spark):
    """Rows of one id with different texts, repeated rows, and columns with the names that operators add."""
    rows = [(5, "x " * 80), (5, "y z " * 60), (5, None), (3, "x " * 80), (3, "x " * 80), (None, "x " * 80), (8, " ".join(f"w{i}" for i in range(90)))]
    names = ["Score", "LANG_PRED", "Spans", "n_words", "Kept", "Quality", "p_x", "rate", "N_Tokens", "fp"]
    return spark.createDataFrame([(i, t, *range(len(names))) for i, t in rows], "doc_id long, text string, " + ", ".join(f"{n} int" for n in names))


def test_clashing_names_are_replaced(spark):
    docs = clashing(spark)
    judged = quality_rules.judge(docs)
    assert [c.lower() for c in judged.columns].count("n_words") == 1 and [c.lower() for c in judged.columns].count("kept") == 1
    assert sorted(r.n_words for r in judged.collect()) == sorted(len(WORD.findall(r.text or "")) for r in docs.collect())
    assert quality_rules.keep_good(docs).columns == docs.columns
    scored = toxicity.score(docs, (b"", b""))
    assert [c.lower() for c in scored.columns].count("score") == 1 and {r.score for r in scored.select("score").collect()} == {0.0}
    said = langid.with_language(docs, langid.fit(spark.createDataFrame([(1, "x y z", "aa")], "doc_id long, text string, lang string")))
    assert {r.lang_pred for r in said.select("lang_pred").collect()} == {"aa", "und"}
    labels = spark.createDataFrame([(5, "x"), (8, "y")], "doc_id long, domain string")
    mixed = mixing.rates(docs, labels, {"x": 0.5, "y": 0.5})
    assert mixed.count() == docs.count() and mixed.columns.count("p_x") == 1
    assert simhash.keep_one(docs).columns == docs.columns and simhash.keep_one_near(docs).columns == docs.columns


def test_one_id_with_several_texts(spark):
    docs = clashing(spark).select("doc_id", "text")
    texts = sorted(str(r.text) for r in simhash.keep_one_near(docs).collect() if r.doc_id is not None)
    assert texts == sorted(["x " * 80, "y z " * 60, "None", " ".join(f"w{i}" for i in range(90))])
    pieces = packing.pack(packing.pieces_of(docs)).collect()
    assert sum(r.n_tokens for r in pieces) == sum(len(WORD.findall(r.text or "")) + 1 for r in docs.collect())
    known = packing.pieces_of(docs.withColumn("known", F.lit(3000)), length_col="known").groupBy("doc_id").agg(F.sum("n_tokens").alias("n"))
    assert sum(r.n for r in known.collect()) == 3000 * docs.count()


def test_batches_are_bounded_by_bytes(spark):
    common.tune(spark)
    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 200_000).alias("text")).coalesce(1)

    def sizes(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows]})

    assert max(r.n for r in docs.mapInArrow(sizes, "n long").collect()) <= 10
    signals = quality_rules.with_signals(docs).agg(F.min("n_words"), F.max("n_words")).first()
    assert tuple(signals) == (200_000, 200_000)


def test_language_ties_and_letters(spark):
    model = langid.Model(["aa", "bb"], np.ones((2, langid.BUCKETS)), np.ones((2, langid.N_SCRIPTS)))
    texts = ["½ ² ③", "Ⅷ 12", "٣", "word", "", None, "a" * 200_000]
    got = langid.label(model, texts)
    assert got[0] == ["und", "und", "und", "aa", "und", "und", "aa"] and got[1][3] == 1.0
    assert langid.with_language(spark.createDataFrame([], "doc_id long, text string"), langid.fit(spark.createDataFrame([], "doc_id long, text string, lang string"))).count() == 0


def test_topk_ties_of_one_id(spark):
    rows = [(50, [1.0, 0.0])] + [(7, [0.5, 0.0])] * 3 + [(9, [0.5, 0.0]), (6, [0.5, 9.0])]
    vectors = topk.quantise(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding")
    got = topk.search(vectors, vectors.where("id = 50")).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(6, 32768), (7, 32768), (7, 32768), (7, 32768), (9, 32768)]


def test_warc_headers_hold_their_lines(spark):
    data, digest = warc.record(7, "http://a/\r\nX-Bad: 1\x7f", "<p>", "2026-01-02T03:04:05Z")
    headers, block = warc.parse(data)
    assert headers["WARC-Target-URI"] == "http://a/%0D%0AX-Bad: 1%7F" and "X-Bad" not in headers and headers["WARC-Date"] == "2026-01-02T03:04:05Z"
    assert block == b"<p>" and headers["WARC-Block-Digest"] == f"sha256:{digest}"
    assert warc._read(b"not gzip") == (None, None, None) and warc._read(None) == (None, None, None)


def plain_ftrl(rows, epochs, alpha, beta, l1, l2, weight):
    """FTRL-proximal feature by feature, with dictionaries."""
    z, n = collections.defaultdict(float), collections.defaultdict(float)

    def w(i):
        bound = 0.0 if i == "bias" else l1
        return 0.0 if abs(z[i]) <= bound else -(z[i] - np.sign(z[i]) * bound) / ((beta + np.sqrt(n[i])) / alpha + l2)

    for epoch in range(epochs):
        for i, features, label in sorted(rows, key=lambda r: zlib.crc32(b"%d %d" % (epoch, r[0]))):
            names = [*features.tolist(), "bias"]
            now = {f: w(f) for f in names}
            g = (1 / (1 + np.exp(-sum(now.values()))) - label) * (weight if label else 1.0)
            for f in names:
                z[f] += g - (np.sqrt(n[f] + g * g) - np.sqrt(n[f])) / alpha * now[f]
                n[f] += g * g
    return {f: w(f) for f in z if w(f)}


def test_ftrl_equals_a_plain_loop(monkeypatch):
    monkeypatch.setattr(toxicity, "L1", 0.5)
    rng = np.random.default_rng(1)
    rows = []
    for i in range(60):
        label = int(rng.random() < 0.4)
        rows.append((i, np.unique(rng.integers(0, 40, 8) + 1000 * label * (rng.random() < 0.7)), label))
    at, w = toxicity.train(rows)
    want = plain_ftrl(rows, toxicity.EPOCHS, toxicity.ALPHA, toxicity.BETA, 0.5, toxicity.L2, toxicity.TOXIC_WEIGHT)
    assert {("bias" if a == toxicity.BUCKETS else int(a)): x for a, x in zip(at, w)} == pytest.approx(want)


def test_language_model_equals_plain_ngrams():
    """Word scores of the model against sums over dictionaries of n-grams."""
    texts = {"aa": "lala lolo la li", "bb": "tete toto te ti la"}
    counts, plain = np.zeros((2, langid.BUCKETS)), [collections.Counter(), collections.Counter()]
    for k, text in enumerate(texts.values()):
        of, gram, _, _ = langid.word_grams(langid.words_of(text))
        np.add.at(counts[k], gram, 1)
        for word in text.split():
            marked = f" {word} "
            plain[k].update(marked[i : i + n] for n in range(1, 5) for i in range(len(marked) - n + 1))
    model = langid.Model(list(texts), counts, np.ones((2, langid.N_SCRIPTS)))
    score, letters = model.word_scores([b"lato", b"xx"])
    for row, word in zip(score, ("lato", "xx")):
        marked, want = f" {word} ", []
        for k in range(2):
            total = sum(plain[k].values()) + 0.5 * langid.BUCKETS
            want.append(sum(np.log((plain[k][marked[i : i + n]] + 0.5) / total) for n in range(1, 5) for i in range(len(marked) - n + 1)) / 4)
        assert row.tolist() == pytest.approx([max(x - max(want), -langid.WORD_BOUND) for x in want], abs=1e-4)
