"""Operators that compare documents or vectors with each other, the classifiers and the pipeline."""

import math
import os
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from plumeline.llm import blocks, common, connected, ftrl, lsh_forest, positive_unlabelled, sorted_passes, sparse_suffixes
from plumeline.llm.common import fresh, gram_hashes, table
from tests_rows import rows

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")



def roots(n, pairs):
    parent = list(range(n))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def jaccard_links(texts):
    sets = [{" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := (t or "").split()) else set() for t in texts]
    return [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8]


@pytest.mark.parametrize("block", [512, 2])
def test_similarity_join(docs, empty, block):
    made = rows()
    links = jaccard_links([t for _, t in made])
    count = Counter(i for pair in links for i in pair)
    group = roots(len(made), links)
    smallest = {}
    for k, (i, _) in enumerate(made):
        if i is not None:
            smallest[group[k]] = min(i, smallest.get(group[k], i))
    want = Counter((i, smallest.get(group[k]) if t and t.split() else i, count[k]) for k, (i, t) in enumerate(made))
    params = lsh_forest.ForestParams(block=block, node_block=block)
    assert Counter(tuple(r) for r in lsh_forest.similarity_join(docs, params).collect()) == want
    kept = lsh_forest.one_of_each(docs, params)
    assert kept.columns == docs.columns
    ids = Counter(r.doc_id for r in kept.collect())
    words = {group[k] for k, (_, t) in enumerate(made) if t and t.split()}
    assert sum(ids.values()) == len(words) + sum(1 for _, t in made if not (t and t.split()))
    assert ids[3] == 1 and ids[105] == ids[106] == ids[107] == 0 and ids[100] == ids[101] == ids[102] == 1
    assert lsh_forest.similarity_join(empty).count() == 0 and lsh_forest.one_of_each(empty).count() == 0


def test_a_large_group_of_near_copies(spark):
    words = [f"w{i}" for i in range(120)]
    texts = [" ".join(words[:k] + [f"x{k}"] + words[k + 1 :]) for k in range(60)] + [" ".join(f"y{i}" for i in range(50))]
    got = lsh_forest.similarity_join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), lsh_forest.ForestParams(block=7, node_block=9)).collect()
    count = Counter(i for pair in jaccard_links(texts) for i in pair)
    assert all(r.n_links == count[r.doc_id] and r.class_id == (0 if r.doc_id < 60 else 60) for r in got)


def reached(depths, trees, params):
    return 1 - np.prod([1 - params.similarity**d for d in depths] + [1 - params.similarity**params.least] * (trees - len(depths)))


def test_prefixes_are_shortened_until_the_recall():
    p, rng = lsh_forest.ForestParams(), np.random.default_rng(15)
    for n in (0, 1, 5, 13, 24):
        sizes = [sorted(rng.integers(1, 500, 5).tolist(), reverse=True) for _ in range(n)]
        got = lsh_forest.chosen_depths(sizes, p)
        assert len(got) == n and all(p.least <= d <= p.depth for d in got) and reached(got, p.trees, p) >= p.recall
        if n == 24:
            one_more = [max(reached([*got[:t], d + 1, *got[t + 1 :]], p.trees, p) for t, d in enumerate(got) if d < p.depth)]
            assert min(one_more) < 0.9999 and len(set(got)) > 1
    hot = [[10_000, 9_000, 8_000, 7_000, 6_000]] * 8 + [[3, 2, 2, 1, 1]] * 16
    got = lsh_forest.chosen_depths(hot, p)
    assert min(got[:8]) > max(got[8:])  # crowded trees stay deep


def test_common_prefixes_and_node_sizes():
    rng = np.random.default_rng(16)
    keys = np.array(sorted(map(tuple, rng.integers(0, 2, (60, 5)))), ">u2")
    got = lsh_forest.common_prefixes(keys)
    assert got[0] == 0 and all(got[i] == next((k for k in range(5) if keys[i][k] != keys[i - 1][k]), 5) for i in range(1, 60))


def test_spanning_pairs_keep_components():
    rng = np.random.default_rng(17)
    x = rng.integers(0, 3, (70, 12)).astype(np.uint16)
    close = [(i, j) for i in range(70) for j in range(i) if (x[i] == x[j]).sum() >= 8]
    a, b = lsh_forest.spanning_pairs(x, 8)
    assert roots(70, close) == roots(70, list(zip(a.tolist(), b.tolist(), strict=True))) and set(zip(np.maximum(a, b).tolist(), np.minimum(a, b).tolist(), strict=True)) <= set(close)


def test_every_link_of_planted_copies_is_found(spark):
    rng = np.random.default_rng(18)
    texts = []
    for _ in range(250):
        words = [f"w{k}" for k in rng.integers(0, 5000, rng.integers(60, 200))]
        for _ in range(3):
            copy = list(words)
            for k in rng.choice(len(copy), max(1, len(copy) // 110), replace=False):
                copy[k] = f"x{rng.integers(0, 10**6)}"
            texts.append(" ".join(copy))
    links = jaccard_links(texts)
    got = {r.doc_id: r.n_links for r in lsh_forest.similarity_join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    count = Counter(i for pair in links for i in pair)
    assert len(links) > 300 and sum(got.values()) >= 0.99 * 2 * len(links) and all(got[i] <= count[i] for i in got)


def test_texts_of_one_template_do_not_chain(spark):
    rng = np.random.default_rng(19)
    template = [f"t{i}" for i in range(100)]
    texts = [" ".join(template[: 68 + k % 3] + [f"u{v}" for v in rng.integers(0, 10**6, 30)]) for k in range(200)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts[:40])]
    likeness = [len(a & b) / len(a | b) for i, a in enumerate(sets) for b in sets[:i]]
    assert 0.45 < min(likeness) and max(likeness) < 0.6
    params = lsh_forest.ForestParams()
    docs = frame.select(F.xxhash64("text").alias("node"), "text", "doc_id")
    signed = docs.select("doc_id", "node", "text").mapInArrow(lsh_forest._signed(params), "doc_id long, node long, signature binary").select("node", "signature")
    assert lsh_forest._candidates(signed, params).count() == 0
    assert {(r.class_id == r.doc_id, r.n_links) for r in lsh_forest.similarity_join(frame).collect()} == {(True, 0)}


def test_intersections():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, rng.integers(0, 50))).astype(np.uint64) for _ in range(40)]
    got = lsh_forest.intersections(sets)
    assert all(got[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(40) for j in range(40) if i != j)


def test_connected_components(spark):
    rng = np.random.default_rng(2)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(1000 + i, 1001 + i) for i in range(40)] + [(5000, 5001 + i) for i in range(50)] + [(7, 7)]
    ids = sorted({x for p in pairs for x in p})
    place = {x: k for k, x in enumerate(ids)}
    want = {ids[k]: ids[r] for k, r in enumerate(roots(len(ids), [(place[a], place[b]) for a, b in pairs])) if k != r}
    got = connected.connected_components(spark.createDataFrame(pairs, "a long, b long"))
    assert {r.node: r.root for r in got.collect()} == want and got.count() == len(want)
    assert connected.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_block_pairs_meet_once(spark):
    members = spark.createDataFrame([("g", i) for i in range(23)] + [("h", 99)], "g string, m long")
    met = Counter()
    groups = defaultdict(list)
    for r in blocks.block_pairs(members, "g", "m", 5).collect():
        groups[r.g, r._i, r._j].append((r.m, r._block))
    for (_, i, j), held in groups.items():
        met.update((a, b) for a, x in held for b, y in held if a < b and (i == j or x != y))
    assert len(met) == 23 * 22 // 2 and set(met.values()) == {1}


# --------------------------------------------------------------------------------------------------------- embeddings


def test_near_duplicate_vectors(spark):
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(6, 16))
    made = [(i, (centre[i % 6] + rng.normal(size=16) * 0.12).tolist(), i % 2) for i in range(120)]
    made += [(200, None, 0), (201, [], 0), (202, [0.0] * 16, 0), (203, [float("nan")] * 16, 0), (204, [None] * 16, 0), (205, made[0][1], None), (206, made[0][1], 0), (207, made[0][1], 1), (208, [1.0] * 8, 0), (0, made[0][1], 0)]
    x = spark.createDataFrame(made, "vec_id long, embedding array<float>, label int").withColumn("rep", F.lit(1))
    for params in (sorted_passes.PassParams(), sorted_passes.PassParams(window=2, block=7, passes_per_round=40)):
        got = Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in sorted_passes.near_duplicates(x, params).collect())
        good = [k for k, (_, v, l) in enumerate(made) if l is not None and v and None not in v and np.isfinite(v).all() and any(v)]
        unit = {k: (u := np.array(made[k][1], np.float32).astype(float)) / np.linalg.norm(u) for k in good}
        links = [(a, b) for a in good for b in good if b < a and made[a][2] == made[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.93]
        count, group = Counter(k for p in links for k in p), roots(len(made), links)
        smallest = defaultdict(lambda: 10**9)
        for k, (i, _, _) in enumerate(made):
            smallest[group[k]] = min(smallest[group[k]], i)
        assert got == Counter((i, count[k], smallest[group[k]], i == smallest[group[k]]) for k, (i, _, _) in enumerate(made))
    assert sorted_passes.near_duplicates(x.limit(0)).count() == 0


def test_near_duplicate_vectors_by_passes(spark):
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(6, 16))
    x = np.array([centre[i % 6] + rng.normal(size=16) * 0.12 for i in range(120)], np.float32)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    label = np.arange(120) % 5 // 2
    links = (unit @ unit.T >= 0.93) & (label[:, None] == label[None, :])
    frame = spark.createDataFrame([(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, label, strict=True))], "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: r.n_links for r in sorted_passes.near_duplicates(frame).collect()}
    assert got == {i: int(links[i].sum()) - 1 for i in range(120)}


def test_near_duplicates_in_a_cone(spark):
    rng = np.random.default_rng(4)
    side = lambda n: (v := rng.normal(size=(n, 64))) / np.linalg.norm(v, axis=1, keepdims=True)
    x = 0.8**0.5 * np.eye(64)[0] + 0.2**0.5 * side(3000)  # unrelated vectors have a cosine of 0.8
    x[2000:] = x[:1000] / np.linalg.norm(x[:1000], axis=1, keepdims=True) + 0.37 * side(1000)
    x = x.astype(np.float32)
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    links = np.argwhere(np.triu(unit @ unit.T >= 0.93, 1))
    count, group = Counter(links.ravel().tolist()), roots(3000, links.tolist())
    frame = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in sorted_passes.near_duplicates(frame, sorted_passes.PassParams(passes_per_round=12)).collect()}
    wrong = sum(got[i] != (count[i], group[i]) for i in range(3000))
    assert len(links) > 500 and wrong == 0, f"{wrong} wrong of {len(count)} linked, {len(links)} links"


def test_passes_in_a_cone(spark):
    rng = np.random.default_rng(14)
    side = lambda n: (v := rng.normal(size=(n, 32))) / np.linalg.norm(v, axis=1, keepdims=True)
    x = 0.75**0.5 * np.eye(32)[0] + 0.25**0.5 * side(500)
    x[400:] = x[:100] / np.linalg.norm(x[:100], axis=1, keepdims=True) + 0.35 * side(100)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = (unit @ unit.T >= 0.93) & ~np.eye(500, dtype=bool)
    frame = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r.n_links for r in sorted_passes.near_duplicates(frame, sorted_passes.PassParams(window=8, passes_per_round=12)).collect()}
    assert links.any() and got == {i: int(links[i].sum()) for i in range(500)}


def cones(n, centres, cosine, seed, pairs):
    """n unit vectors in cones around random centres, and twins of the first `pairs` of them at a cosine of 0.9305."""
    rng = np.random.default_rng(seed)
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)

    def beside(x, cosine):
        side = rng.standard_normal(x.shape)
        return cosine * x + (1 - cosine**2) ** 0.5 * unit(side - (side * x).sum(axis=1, keepdims=True) * x)

    x = beside(unit(rng.standard_normal((centres, 64)))[np.arange(n) % centres], cosine**0.5)
    return np.concatenate([x, beside(x[:pairs], 0.9305)])


@pytest.mark.parametrize(("centres", "cosine", "n"), [(1, 0.85, 40_000), (4, 0.85, 160_000), (2, 0.88, 120_000), (8, 0.88, 200_000), (4, 0.90, 100_000)])
def test_recall_over_several_cones(centres, cosine, n):
    """The stop rule over whole keys and windows, without Spark: planted pairs are met in the passes that the twins ask for."""
    p, pairs = sorted_passes.PassParams(), 300
    x = cones(n, centres, cosine, centres, pairs)
    sample = np.random.default_rng(9).choice(len(x), p.twins, replace=False)
    every = np.concatenate([x, [sorted_passes._twin(x[i], int(i), p) for i in sample]])
    mean, made, until = x.mean(axis=0), 0, None
    found, met = np.zeros(pairs, bool), np.zeros(p.twins, bool)
    while until is None or made < until:
        planes = np.random.default_rng([p.seed, made]).standard_normal((64, 64))
        keys = np.packbits((every - mean) @ planes > 0, axis=1).view(">u8").ravel()
        place = np.empty(len(every), np.int64)
        place[np.argsort(keys, kind="stable")] = np.arange(len(every))

        def meet(a, b):
            return (np.abs(place[a] - place[b]) <= p.window) & (place[a] // (p.segment * p.window) == place[b] // (p.segment * p.window))

        found |= meet(np.arange(pairs), n + np.arange(pairs))
        met |= meet(sample, len(x) + np.arange(p.twins))
        made += 1
        if until is None and met.all():
            until = math.ceil(p.more * made)
    assert found.mean() >= 0.99 and made < 80


@pytest.mark.parametrize("segment", [8, 2])
def test_near_duplicates_over_several_cones(spark, segment):
    """Through Spark, with cuts along the order and windows far smaller than a label: every link of brute force."""
    x = cones(3000, 3, 0.85, 5, 200).astype(np.float32)
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    links = np.argwhere(np.triu(unit @ unit.T >= 0.93, 1))
    count, group = Counter(links.ravel().tolist()), roots(len(x), links.tolist())
    frame = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    params = sorted_passes.PassParams(window=200, segment=segment, passes_per_round=12)
    got = {r.vec_id: (r.n_links, r.component_id) for r in sorted_passes.near_duplicates(frame, params).collect()}
    wrong = sum(got[i] != (count[i], group[i]) for i in range(len(x)))
    assert len(links) >= 200 and wrong <= 0.01 * len(count), f"{wrong} wrong of {len(count)} linked"


def test_common_prefixes_are_dealt(spark):
    """A third of a label within a hair of one vector: its keys are alike, so that it cannot be cut along the order."""
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.standard_normal((600, 16)), np.ones((1, 16)) + 1e-4 * rng.standard_normal((300, 16))]).astype(np.float32)
    frame = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in sorted_passes.near_duplicates(frame, sorted_passes.PassParams(window=20, segment=2, twins=30, passes_per_round=12)).collect()}
    assert all(got[i] == (299, 600) for i in range(600, 900))


# ------------------------------------------------------------------------------------------------------------ passages


def repeated_words(made, words=50):
    seen, flagged = set(), defaultdict(set)
    for _, i, t in sorted({(i is None, i or 0, t or "") for i, t in made}):
        w = t.split()
        for k in range(len(w) - words + 1):
            gram = tuple(w[k : k + words])
            if gram in seen:
                flagged[i, t].update(range(k, k + words))
            seen.add(gram)
    return flagged


@pytest.mark.parametrize("parts", ["4", "13"])
def test_repeats(spark, docs, empty, parts):
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    params = sparse_suffixes.SuffixParams()
    made = rows()
    want = {k: v for k, v in repeated_words(made).items() if v}
    texts = {i or 0: (t or "").split() for i, t in made}
    got = defaultdict(set)
    for r in sparse_suffixes.repeats(docs, params).collect():
        n = r.end_word - r.start_word
        assert n >= 50 and texts[r.doc_id][r.start_word : r.end_word] == texts[r.source_doc_id][r.source_start_word : r.source_start_word + n]
        got[r.doc_id].update(range(r.start_word, r.end_word))
    assert {i: v for (i, _), v in want.items()} == got
    cut = sparse_suffixes.without_repeats(docs, params)
    assert cut.columns == docs.columns and cut.count() == len(made)
    for r in cut.collect():
        if r.doc_id in (100, 101, 109, 0):
            assert r.text == dict(made)[r.doc_id]
        if r.doc_id == 110:
            assert r.text == "tail" and r.n_chars == 4
    assert sparse_suffixes.repeats(empty).count() == 0 and sparse_suffixes.without_repeats(empty).count() == 0
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_a_passage_around_a_hot_line(spark):
    rng = np.random.default_rng(11)
    word = lambda n: [f"w{k}" for k in rng.integers(0, 10**9, n)]
    params = sparse_suffixes.SuffixParams()
    made = []
    for _ in range(6):
        while True:  # every selected gram of the passage lies in the line
            line = word(40)
            passage = word(12) + line + word(12)
            at, _ = sparse_suffixes.selected(sparse_suffixes.WORDS.of(passage), params)
            if 12 <= at.min() and at.max() + params.gram <= 52:
                break
        n = len(made)
        made += [(n + k, " ".join(word(30) + (passage if k in (4, 30) else line) + word(30))) for k in range(40)]
    want = {i: v for (i, _), v in repeated_words(made).items() if v}
    assert len(want) == 6
    texts = {i: t.split() for i, t in made}
    got = defaultdict(set)
    for r in sparse_suffixes.repeats(spark.createDataFrame(made, "doc_id long, text string"), params).collect():
        n = r.end_word - r.start_word
        assert n >= 50 and r.source_doc_id < r.doc_id and texts[r.doc_id][r.start_word : r.end_word] == texts[r.source_doc_id][r.source_start_word : r.source_start_word + n]
        got[r.doc_id].update(range(r.start_word, r.end_word))
    assert got == want


def test_gram_hashes_depend_on_content_only():
    x = np.random.default_rng(5).integers(0, 2**63, 200).astype(np.uint64)
    a, b = gram_hashes(np.concatenate([x[:50], x[:50]]), 7), gram_hashes(x[:50], 7)
    assert (a[:44] == b).all() and (a[50:] == b).all() and len(set(b.tolist())) == 44 and len(gram_hashes(x[:3], 7)) == 0


def test_run_hashes_are_gram_hashes():
    x = np.random.default_rng(6).integers(0, 2**63, 40).astype(np.uint64)
    at = np.array([0, 7, 30, 39])
    got = common.run_hashes(x, [3, 10], at)
    assert (got[:3, 0] == gram_hashes(x, 3)[at[:3]]).all() and (got[:3, 1] == gram_hashes(x, 10)[at[:3]]).all() and got[3].tolist() == [0, 0]


def test_fresh_names():
    assert fresh(["a", "_A"], "a") == "__a"


# --------------------------------------------------------------------------------------------------------- classifiers


def made_corpus(n, seed):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(400)]
    out = []
    for i in range(n):
        w = rng.choice(words, rng.integers(20, 120)).tolist()
        toxic, bad = rng.random() < 0.2, rng.random() < 0.3
        if toxic:
            for k in rng.integers(0, len(w), 3):
                w[k] = rng.choice(["idiot", "scum"])
        text = " ".join(w)
        out.append((i, " ".join(x + "%%%" for x in w) if bad else text, int(not bad), int(toxic)))
    return out


def test_classifiers_on_held_out_rows(spark):
    made = made_corpus(1500, 6)
    docs = spark.createDataFrame([(i, t) for i, t, _, _ in made], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q, x) for i, _, q, x in made], "doc_id long, quality int, toxic int")
    for result, column, least in ((ftrl.toxicity(docs, labels), 3, 0.95), (positive_unlabelled.quality(docs, labels), 2, 0.97)):
        held = [r for r in result.collect() if r.held_out]
        assert len(held) > 200 and np.mean([r.predicted == made[r.doc_id][column] for r in held]) >= least
        assert all(0 <= r.score <= 1 for r in held)


def test_held_out_labels_are_not_learnt(spark):
    made = made_corpus(600, 7)
    docs = spark.createDataFrame([(i, t) for i, t, _, _ in made], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q, x) for i, _, q, x in made], "doc_id long, quality int, toxic int")
    for apply, folds, fold in ((ftrl.toxicity, 3, 1), (positive_unlabelled.quality, 5, 0)):
        turned = labels.select("doc_id", *[F.when(ftrl.held_out(folds, fold), 1 - F.col(c)).otherwise(F.col(c)).alias(c) for c in ("quality", "toxic")])
        assert {r.doc_id: r.score for r in apply(docs, labels).collect()} == pytest.approx({r.doc_id: r.score for r in apply(docs, turned).collect()})


def test_classifiers_take_any_row(docs, empty, labels):
    for apply in (ftrl.toxicity, positive_unlabelled.quality):
        got = apply(docs, labels).collect()
        assert Counter(r.doc_id for r in got) == Counter(i for i, _ in rows()) and all(0 <= r.score <= 1 for r in got)
        assert len({r.score for r in got if r.doc_id in (100, 101)}) == 1
        assert apply(empty, labels).count() == 0
        assert {r.score for r in apply(docs, labels.limit(0)).collect()} == {0.5}
    kept = positive_unlabelled.keep_good(docs, labels)
    assert kept.columns == docs.columns and {r._score for r in kept.collect()} <= {0.5}


def test_ftrl_matches_the_plain_recurrence():
    rng = np.random.default_rng(12)
    params = ftrl.FtrlParams(bits=5, alpha=0.5, l1=0.3, passes=2)
    data = [(np.unique(rng.integers(0, 32, 6)), int(rng.random() < 0.4)) for _ in range(60)]
    z, n = defaultdict(float), defaultdict(float)

    def weight(i):
        if abs(z[i]) <= params.l1:
            return 0.0
        return -(z[i] - math.copysign(params.l1, z[i])) / ((params.beta + math.sqrt(n[i])) / params.alpha + params.l2)

    order = np.random.default_rng(7)
    for _ in range(params.passes):
        for k in order.permutation(len(data)):
            x, y = [*data[k][0].tolist(), 32], data[k][1]
            g = (1 / (1 + math.exp(-sum(map(weight, x)))) - y) * (params.positive_weight if y else 1.0)
            for i, w in [(i, weight(i)) for i in x]:
                sigma = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / params.alpha
                z[i] += g - sigma * w
                n[i] += g * g
    at, w = ftrl.train(data, params)
    assert dict(zip(at.tolist(), w, strict=True)) == pytest.approx({i: weight(i) for i in range(33) if weight(i)})


def test_the_risk_step_is_the_gradient():
    rng = np.random.default_rng(13)
    p, u, theta = rng.normal(1, 1, (50, 4)), rng.normal(0, 1, (80, 4)), rng.normal(size=4)
    soft = lambda g: np.log1p(np.exp(g))
    for prior in (0.2, 0.95):
        negative = lambda t: soft(u @ t).mean() - prior * soft(p @ t).mean()  # noqa: B023, E731
        risk = lambda t: prior * soft(-(p @ t)).mean() + negative(t)  # noqa: B023, E731
        f = (lambda t: -negative(t)) if negative(theta) < 0 else risk  # noqa: B023
        numeric = [(f(theta + e) - f(theta - e)) / 2e-6 for e in np.eye(4) * 1e-6]
        assert positive_unlabelled._risk_step(theta, p, u, prior) == pytest.approx(numeric, abs=1e-5)


def test_learning_is_bounded_where_an_id_repeats(spark):
    made = made_corpus(300, 8)
    docs = spark.createDataFrame([(i, t) for i, t, _, _ in made] + [(5, f"copy {k} of words") for k in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q, x) for i, _, q, x in made], "doc_id long, quality int, toxic int")
    assert common.one_text_each(docs, labels).count() == 300
    assert ftrl.toxicity(docs, labels).count() == positive_unlabelled.quality(docs, labels).count() == 700


def test_the_prior_is_near_the_truth():
    rng = np.random.default_rng(8)
    positive, unlabelled = rng.normal(2, 1, 4000), np.concatenate([rng.normal(2, 1, 2800), rng.normal(-2, 1, 1200)])
    assert abs(positive_unlabelled.estimate_prior(positive, unlabelled) - 0.7) < 0.06


# ------------------------------------------------------------------------------------------------------------ pipeline


def test_pipeline(spark):
    docs = table(spark, SF, "documents")
    for name, apply in corpus_pipeline.STAGES[:-1]:
        assert apply(spark, docs, SF).columns == docs.columns, name
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "ngram_jaccard_join", "suffix_array_dedup", "secret_scan", "best_fit_packing"]
    got = corpus_pipeline.run(spark, SF).collect()
    bins = defaultdict(int)
    for r in got:
        bins[r.sequence_id] += r.length
    assert got and max(bins.values()) <= 2048


def test_pipeline_stages_take_any_row(spark, docs, empty):
    for name, apply in corpus_pipeline.STAGES:
        for d in (docs, empty):
            out = apply(spark, d, SF)
            out.collect()
            assert name == "best_fit_packing" or out.columns == docs.columns


@pytest.mark.parametrize("name", sorted(n for n in entry.queries() if n.startswith("op")))
def test_registered_queries_run(spark, name):
    got = entry.queries()[name](spark, SF).toPandas()
    counts = {"op8": ("count(*)", "embeddings"), "op11": ("count(distinct conv_id)", "conversations"), "op12": ("20 * count_if(vec_id % 20 = 0)", "embeddings"), "op13": ("4 * count(*)", "embeddings")}
    what, of = counts.get(name.split("_")[0], ("count(*)", "documents"))
    n = duckdb.sql(f"select {what} from '{SF}/{of}.parquet'").fetchall()[0][0]
    assert len(got) == n or name.startswith(("op7", "op10"))


@pytest.mark.parametrize("name", sorted(entry._llm.ORACLE_SQL))
def test_queries_agree_with_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.execute(entry.oracle_sql()[name]).df()
    got = entry.queries()[name](spark, SF).toPandas()[list(want.columns)]
    assert sorted(map(tuple, got.to_numpy().tolist())) == sorted(map(tuple, want.to_numpy().tolist()))
