"""Hand-computed fixtures and properties of the operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumeline.functions import corpus_text as C
from plumeline.functions import text as T
from plumeline.functions.noise import apply_edit, classify, minimal
from plumeline.operators import gaussian as G
from plumeline.operators.profiles import cosine_summary
from plumeline.operators.blocked import blocked_top_k, token_maxsim
from plumeline.operators.attributes import attribute, clean_value, extracted, top_attributes
from plumeline.operators.metrics import fuse
from plumeline.operators.ranking import flip_rate, hit_columns, kendall_and_spearman
from plumeline.operators.retrieval import Bm25, term_coverage
from plumeline.plans.style import parse
from plumeline.operators.rules import annotated, annotated_tokens, length_bucket, sentence_rules, signatures, struct_rules, word_shape


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_sentences(spark):
    assert one(spark, T.sentences(F.lit("Great. Works well!  Buy it?Yes"))) == ["Great.", "Works well!", "Buy it?Yes"]


def test_clean_html(spark):
    assert one(spark, T.clean_html(F.lit("A&amp;quot;b<br />c <p>d</p>"))) == 'A"b c d'


def test_references_are_the_librarys(spark):
    import html

    texts = ["caf&eacute; &#8217;s &#x27;q&#x27; &notit; &am &amp", "&amp;amp;amp;quot;&amp;lt;", "&#128; &#xD800; &#0; &#99999999; &#x1F600;", "&nbsp;&NotEqualTilde;&fjlig;", "plain", "", "a & b &; &#; &#x;"]
    frame = spark.createDataFrame([(t,) for t in [*texts, None]], "t string")
    got = frame.select(T.unescape(F.col("t")).alias("a"), T.unescape(F.col("t"), once=True).alias("b"), T.unescape_each(F.array("t")).alias("c")).collect()
    for text, r in zip(texts, got, strict=False):
        whole = text
        while (plain := html.unescape(whole)) != whole:
            whole = plain
        assert (r.a, r.b, r.c) == (whole, html.unescape(text), [html.unescape(text)])
    assert (got[-1].a, got[-1].b) == (None, None)


def test_tags_are_elements(spark):
    assert one(spark, T.clean_html(F.lit("5 < 6 > 4<br/>a<b class=x>c</b>  d"))) == "5 < 6 > 4 a c d"


@pytest.mark.parametrize(("raw", "want"), [("Dishwasher SafeMicrowave Safe", "Dishwasher Safe Microwave Safe"), ("machine_wash", "machine wash"), ("FOOBar", "FOO Bar")])
def test_split_camel(spark, raw, want):
    assert one(spark, T.split_camel(F.lit(raw))) == want


def test_brands_stay(spark):
    assert one(spark, clean_value(F.struct(F.lit("Brand").alias("key"), F.lit("BabyBird").alias("value")))) == "BabyBird"


def test_hash_bucket_is_the_digest_modulo_ten(spark):
    import hashlib

    words = ["a", "Hello World", "été", "x" * 300]
    got = spark.createDataFrame([(w,) for w in words], "w string").select(T.hash_bucket(F.col("w"), 10, "s").alias("b")).collect()
    assert [r.b for r in got] == [int(hashlib.sha1(b"s|" + w.lower().encode()).hexdigest(), 16) % 10 for w in words]


def test_attribute_rules(spark):
    pairs = {"Brand": "Wittle", "Color": "White, Blue", "Size": "10 in", "Note": "Yes", "Style": "white, soft", "Kind": "a b c d", "Twin": "wittle"}
    attrs = F.array(*[attribute(F.lit(i), F.lit(k), F.lit(v)) for i, (k, v) in enumerate(pairs.items())])
    assert {r.key: r.value for r in one(spark, extracted(attrs))} == {"Brand": "Wittle", "Color": "White", "Style": "white"}


def test_top_attributes_prefer_the_priority_list(spark):
    pairs = {"Zest": "lemon", "Style": "modern", "Country of Origin": "Utopia", "Brand": "Wittle", "Item Weight": "heavy"}
    attrs = F.array(*[attribute(F.lit(i), F.lit(k), F.lit(v)) for i, (k, v) in enumerate(pairs.items())])
    assert [r.key for r in one(spark, top_attributes(attrs))] == ["Brand", "Style", "Zest"]


CASES = {
    ("moun", "mount"): "letter_deletion", ("munt", "mount"): "letter_deletion", ("frm", "from"): "letter_deletion", ("reqires", "requires"): "letter_deletion", ("hte", "the"): "letter_swap", ("thw", "the"): "keyboard_adjacent",
    ("reallly", "really"): "letter_repetition", ("cao", "car"): "keyboard_layout", ("dont", "don't"): "apostrophe_error", ("The", "the"): "case_error", ("there", "their"): "homophone_substitution", ("", "x"): "semantic_substitution",
    ("xthe", "the"): "letter_insertion", ("apple", "pears"): "semantic_substitution",
}


@pytest.mark.parametrize("pair", CASES)
def test_classify(spark, pair):
    assert one(spark, classify(F.lit(pair[0]), F.lit(pair[1]))) == CASES[pair]


def test_minimal(spark):
    assert [one(spark, minimal(F.lit(a), F.lit(b))) for a, b in (("to", "ot"), ("house", "hous"), ("house", "house"))] == [False, True, False]


def test_apply_edit(spark):
    q = F.lit("white foam door mount")
    assert one(spark, apply_edit(q, F.lit(16), F.lit(21), F.lit("mount"), F.lit("moun"))) == "white foam door moun"
    assert one(spark, apply_edit(q, F.lit(16), F.lit(21), F.lit("mouse"), F.lit("moun"))) is None


def test_floor_quantile(spark):
    rows = spark.createDataFrame([("u", float(i)) for i in range(1, 11)], "k string, v double")
    r = G.floor_quantiles(rows, "k", "v").first()
    assert (r.d2_q50, r.d2_q95, r.d2_max, r.n_val) == (5.0, 9.0, 10.0, 10)


@pytest.mark.parametrize(("rank", "want"), [(1, (1.0, 1, 1, 1, 1)), (7, (1 / 7, 0, 0, 1, 1)), (None, (0.0, 0, 0, 0, 0))])
def test_hits(spark, rank, want):
    got = spark.createDataFrame([(rank,)], "r int").select(*hit_columns(F.col("r"), round_to=None)).first()
    assert tuple(got) == pytest.approx(want)


def test_flip_rate(spark):
    assert one(spark, flip_rate(F.lit(1), F.lit(3))) == pytest.approx(2 / 3)


def test_rank_prior(spark):
    rows = spark.createDataFrame([(0, i, i, 0.5) for i in range(1, 31)], "query_id long, doc_id long, original_rank long, score double")
    prior = {r.original_rank: r.rank_prior for r in fuse(rows).collect()}
    assert len(prior) == 25 and (prior[1], prior[13], prior[25]) == (1.0, 0.5, 0.0)


def test_rank_correlation(spark):
    rows = spark.createDataFrame([("q", 1, 1), ("q", 2, 3), ("q", 3, 2), ("r", 1, 1)], "query string, a int, b int")
    got = {r["query"]: (r.tau, r.rho) for r in kendall_and_spearman(rows, "query", "a", "b").collect()}
    assert got["q"] == pytest.approx((1 / 3, 0.5)) and got["r"] == (0.0, 0.0)


def test_maxsim_of_an_empty_document(spark):
    q = spark.createDataFrame([(3, [1.0, 0.0, 0.0, 1.0])], "query_id long, q array<double>")
    d = spark.createDataFrame([(1, [1.0, 0.0]), (2, [])], "doc_id long, d array<double>")
    assert {r.doc_id: r.score for r in blocked_top_k(q, d, token_maxsim(2), 5).collect()} == {1: 1.0, 2: 0.0}


def test_term_coverage(spark):
    asked = spark.createDataFrame([(1, "The red red chair"), (2, "of a")], "query_id long, text string")
    docs = spark.createDataFrame([(5, "A RED door, red"), (6, None), (7, "chair: red")], "doc_id long, text string")
    pairs = spark.createDataFrame([(1, 5, 1), (1, 6, 2), (1, 7, 3)], "query_id long, doc_id long, original_rank int")
    got = {r.doc_id: (r.original_rank, r.score) for r in term_coverage(pairs, asked, docs, Bm25()).collect()}
    assert got == {5: (1, 0.5), 6: (2, 0.0), 7: (3, 1.0)}


def test_rules_and_signatures(spark):
    # "big dogs bark loudly": dogs <- big, bark root, bark <- dogs, bark <- loudly
    tokens = [(0, "big", "ADJ", "amod", 1), (1, "dogs", "NOUN", "nsubj", 2), (2, "bark", "VERB", "ROOT", 2), (3, "loudly", "ADV", "advmod", 2)]
    df = spark.createDataFrame([(tokens,)], "tokens array<struct<i:int,text:string,pos:string,dep:string,head:int>>")
    rules = set(df.select(struct_rules(F.col("tokens")).alias("r")).first().r)
    assert rules == {"D4|VERB|NOUN|amod|ADJ", "D4|ROOT|VERB|nsubj|NOUN", "D4|ROOT|VERB|advmod|ADV", "D3|NOUN|amod|ADJ", "D3|VERB|nsubj|NOUN", "D3|VERB|advmod|ADV", "P3|ADJ|NOUN|VERB", "P3|NOUN|VERB|ADV"}
    sigs = df.select(F.explode(annotated(F.col("tokens"))).alias("t")).select("t.text", signatures(F.col("t")).alias("s")).collect()
    by_word = {r.text: {x.name: x.sig for x in r.s} for r in sigs}
    assert by_word["big"]["full"] == "ADJ|amod|NOUN|VERB|ROOT|d2" and by_word["dogs"]["sibling"] == "NOUN|NONE|ADV" and by_word["bark"]["depth"] == "d0|VERB|ROOT"


def test_long_sentences_are_parsed_whole(spark):
    """Two hundred words in a chain of conjuncts under one preposition: the ancestors of the last are as many."""
    dep = lambda i: "ROOT" if i == 0 else "prep" if i == 1 else "amod"
    tokens = [(i, f"w{i}", "NOUN", dep(i), max(i - 1, 0)) for i in range(200)]
    df = spark.createDataFrame([(tokens,)], "tokens array<struct<i:int,text:string,pos:string,dep:string,head:int>>")
    last = df.select(annotated(F.col("tokens")).alias("a")).first().a[-1]
    assert (last.clause, last.depth, last.left) == ("PREP", "d3+", "NONE")
    assert set(df.select(struct_rules(F.col("tokens")).alias("r")).first().r) == {"D4|ROOT|NOUN|prep|NOUN", "D3|NOUN|prep|NOUN", "D4|NOUN|NOUN|amod|NOUN", "D3|NOUN|amod|NOUN", "P3|NOUN|NOUN|NOUN"}


@pytest.mark.parametrize(("word", "want"), [("", "empty"), ("42", "digit"), ("abc", "lower"), ("ABC", "upper"), ("Abc", "title"), ("aB1", "mixed"), ("aBc", "other")])
def test_word_shape(spark, word, want):
    assert one(spark, word_shape(F.lit(word))) == want
    assert one(spark, length_bucket(F.lit(8))) == "7-10"


def test_distances(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    z, mu, v, s, lam = rng.normal(size=16), rng.normal(size=16), rng.normal(size=16), rng.uniform(0.5, 2, 16), 1.7
    v /= np.linalg.norm(v)
    args = [F.array(*map(F.lit, x.tolist())) for x in (z, mu)] + [F.lit(lam)] + [F.array(*map(F.lit, x.tolist())) for x in (v, s)]
    d = z - mu
    low = d @ v
    assert one(spark, G.d2(*args)) == pytest.approx(low**2 / lam + ((d - low * v) ** 2 / s).sum())
    assert one(spark, G.d2_exact(*args)) == pytest.approx(d @ np.linalg.inv(lam * np.outer(v, v) + np.diag(s)) @ d)


def test_fit_matches_numpy(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 4)) @ rng.normal(size=(4, 4))
    rows = spark.createDataFrame([("u", "profile" if i < 45 else "val", r.tolist()) for i, r in enumerate(x)], "user_id string, split string, z array<double>")
    got = G.fit(rows, dims=4).first()
    values, vectors = np.linalg.eigh(np.cov(x[:45].T))
    assert got["lambda"] == pytest.approx(values[-1]) and abs(np.dot(got.v, vectors[:, -1])) == pytest.approx(1)
    assert G.fit(rows.limit(5), dims=4).count() == 0


def test_corpus_rules(spark):
    cases = {
        "It holds water. See more. Product Details": "It holds water.", "Nice cup. This is a great gift.": "Nice cup. This is a great gift.", "Nice cup. It's a great gift for kids.": "Nice cup.",
        "Visit https://a.b/c now": "Visit now", "cafÃ© 中文 ok": "cafe ok",
    }
    for raw, want in cases.items():
        assert one(spark, C.fix_encoding(C.without_marketing(F.lit(raw)))) == want, raw
    assert one(spark, C.calm_capitals(F.lit("GREAT BOTTLE FOR BABY WITH BPA FREE COVER today"))) == "Great Bottle FOR BABY WITH BPA FREE Cover today"
    text = "It is 10 x 20 x 30 inches. It weighs 5 pounds. A Lovely Big Wooden Table. It lasts."
    assert one(spark, C.without_restated(F.lit(text), F.lit("10 x 20 x 30"), F.lit("5 pounds"), F.lit("A Lovely Big Wooden Table"))) == "It lasts."
    assert one(spark, C.without_title(F.array(F.lit("A Lovely Big Table!"), F.lit("Strong")), F.lit("A Lovely Big Table"))) == ["Strong"]


def test_audit_stability_has_twenty_rounds(spark):
    from plumeline.plans.style import audit_stability
    from plumeline.sources.tables import style_vectors

    sf = "/root/testdata/sf0.001"
    got = {r.user_id: r.rho_median for r in audit_stability(spark, sf).collect()}
    want = {r.user_id: r.rho_median for r in G.stability(style_vectors(spark, sf), rounds=20).collect()}
    assert got == pytest.approx(want, abs=1e-9) and got


def test_stage_delta_all_reads_every_document(spark):
    from plumeline.plans.retrieval import outcomes
    from plumeline.plans.robustness import stage_delta_all_query

    sf = "/root/testdata/sf0.001"
    rows = outcomes(spark, sf).collect()
    user = rows[0].user_id
    rows = [r for r in rows if r.user_id == user]
    delta = sum(1 / (r.rank_noisy or float("inf")) - 1 / (r.rank_clean or float("inf")) for r in rows) / len(rows)
    assert {r.user_id: r.mrr_delta for r in stage_delta_all_query(spark, sf).collect()}[user] == pytest.approx(delta, abs=1e-5)


def test_annotated_tokens_are_those_of_the_expression(spark):
    """The batch form and the expression agree, on branching trees, single words and long sentences."""
    sentences = [(1, "one"), (2, "two words"), (3, " ".join(f"w{'x' * (i % 9)}" for i in range(300))), (4, "a bb ccc dddd eeeee ffffff ggggggg"), (5, ""), (6, None)]
    df = spark.createDataFrame(sentences, "k long, s string").withColumn("tokens", parse(F.filter(F.split("s", " "), lambda w: w != ""))).repartition(3)
    fields = ("i", "text", "pos", "dep", "parent", "grand", "clause", "depth", "left", "right")
    want = sorted((r.k, *(r.t[f] for f in fields)) for r in df.select("k", F.explode(annotated(F.col("tokens"))).alias("t")).collect())
    got = sorted((r.k, *(r.t[f] for f in fields)) for r in annotated_tokens(df, "k").collect())
    assert got == want and len(got) == 310
    rules = sorted((r.k, r.rule) for r in sentence_rules(df, "k").collect())
    assert rules == sorted((r.k, r.rule) for r in df.select("k", F.explode(struct_rules(F.col("tokens"))).alias("rule")).collect()) and len(rules) > 100
    assert annotated_tokens(df.limit(0), "k").count() == sentence_rules(df.limit(0), "k").count() == 0


def test_cosine_summary(spark):
    rng = np.random.default_rng(8)
    lifts = {f"u{i}": rng.normal(size=5).round(3) * (rng.random(5) < 0.7) for i in range(41)} | {"zero": np.zeros(5)}
    rows = [(u, "c", f"e{k}", float(x)) for u, v in lifts.items() for k, x in enumerate(v) if x or u == "zero"]
    schema = "user_id string, ctx string, err string, lift double"
    got = cosine_summary(spark.createDataFrame(rows, schema)).first()
    vs = np.array([v for v in lifts.values() if v.any()] + [np.zeros(5)])
    u = vs / np.maximum(np.linalg.norm(vs, axis=1, keepdims=True), 1e-300)
    c = (u @ u.T)[np.triu_indices(len(u), 1)]
    assert got.n_users == len(u) and (got.mean, got["median"], got["std"]) == (pytest.approx(c.mean()), pytest.approx(np.median(c), abs=1e-6), pytest.approx(c.std()))
    one = cosine_summary(spark.createDataFrame(rows[:1], schema)).first()
    none = cosine_summary(spark.createDataFrame([], schema)).first()
    assert (one.n_users, one.mean, none.n_users, none["median"]) == (1, None, 0, None)
