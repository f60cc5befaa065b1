"""Style queries: syntactic rules, vocabularies, user Gaussians, gates and audits."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumeline.functions.vectors import norm, scaled
from plumeline.operators import gaussian as G
from plumeline.operators import low_rank as L
from plumeline.operators import selection as S
from plumeline.operators.rules import sentence_rule_lists, sentence_rules
from plumeline.operators.sparse_svd import numbered, project_rows, truncated_svd_of_rows
from plumeline.registry import register
from plumeline.sources.staged import stage
from plumeline.sources.tables import REVIEWS_SQL, VECTORS_SQL, review_sentences, reviews, style_vectors

# ------------------------------------------------------------------------------------------------- rules and vocabulary

#: Stand-in for a parser: a word's class goes by its length; its head is an earlier word that its place and length pick,
#: so that trees branch; the first word is the root.
POS = ("DET", "ADP", "NOUN", "VERB", "ADJ")
DEP = ("det", "prep", "nsubj", "dobj", "amod", "conj", "relcl")


def parse(words: Column) -> Column:
    """array<struct<i,text,pos,dep,head>> of a list of words."""
    pos, dep = F.array(*map(F.lit, POS)), F.array(*map(F.lit, DEP))
    n = F.length
    token = lambda w, i: F.struct(i.alias("i"), w.alias("text"), pos[n(w) % 5].alias("pos"), F.when(i == 0, "ROOT").otherwise(dep[(n(w) + i) % 7]).alias("dep"), F.when(i == 0, F.lit(0)).otherwise((i * 7 + n(w)) % F.greatest(i, F.lit(1))).alias("head"))
    return F.transform(words, token)


def parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, sent_id, tokens) of sentences of three words or more."""
    s = review_sentences(spark, sf_dir, 1000)
    words = F.filter(F.split("sentence", r"\s+"), lambda w: w != "")
    # Generated, so that the words are split once and not in every place that reads them.
    rows = s.select("user_id", F.concat_ws(":", "review_pos", "sent_pos").alias("sent_id"), F.explode(F.array(words)).alias("words")).filter("size(words) >= 3")
    return rows.select("user_id", "sent_id", F.explode(F.array(parse(F.col("words")))).alias("tokens"))


def parse_sql(source: str, words: str, name: str = "k") -> str:
    """`name` with lists p, d and h (heads from 1) beside the columns of `source`."""
    listed = lambda x: "[" + ",".join(f"'{v}'" for v in x) + "]"
    return f"""{name} AS (SELECT *, list_transform({words}, lambda x: ({listed(POS)})[length(x) % 5 + 1]) AS p, list_transform({words}, lambda x, i: CASE WHEN i = 1 THEN 'ROOT' ELSE ({listed(DEP)})[(length(x) + i - 1) % 7 + 1] END) AS d,
  list_transform({words}, lambda x, i: CASE WHEN i = 1 THEN 1 ELSE ((i - 1) * 7 + length(x)) % (i - 1) + 1 END) AS h FROM {source})"""


PARSED_SQL = f"""{REVIEWS_SQL},
w0 AS (SELECT user_id, review_pos::VARCHAR || ':' || sent_pos::VARCHAR AS sent_id, list_filter(regexp_split_to_array(sentence, '\\s+'), lambda x: x <> '') AS ws FROM sentences),
w AS (SELECT * FROM w0 WHERE len(ws) >= 3), {parse_sql("w", "ws")},
t AS (SELECT user_id, sent_id, unnest(range(1, len(p) + 1)) AS i, p, d, h FROM k),
rules AS (
  SELECT DISTINCT user_id, sent_id, 'D4|' || CASE WHEN h[h[i]] = h[i] THEN 'ROOT' ELSE p[h[h[i]]] END || '|' || p[h[i]] || '|' || d[i] || '|' || p[i] AS rule FROM t WHERE i > 1
  UNION SELECT DISTINCT user_id, sent_id, 'D3|' || p[h[i]] || '|' || d[i] || '|' || p[i] FROM t WHERE i > 1
  UNION SELECT DISTINCT user_id, sent_id, 'P3|' || p[i] || '|' || p[i + 1] || '|' || p[i + 2] FROM t WHERE i + 2 <= len(p))"""


def _rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_rules(parsed(spark, sf_dir), "user_id", "sent_id")


@register("struct_rules", f"WITH {PARSED_SQL} SELECT sent_id, count(*) AS n_rules, string_agg(rule, ' ' ORDER BY rule) AS rules FROM rules GROUP BY sent_id")
def struct_rules_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct rules of every sentence."""
    found = sentence_rule_lists(parsed(spark, sf_dir), "sent_id")
    return found.select("sent_id", F.size("rules").cast("long").alias("n_rules"), F.array_join("rules", " ").alias("rules"))


@register("rule_vocab", f"""WITH {PARSED_SQL}, v AS (SELECT rule, count(DISTINCT sent_id) AS df FROM rules GROUP BY rule HAVING count(DISTINCT sent_id) >= 2)
SELECT rule, df, (row_number() OVER (ORDER BY rule) - 1)::INTEGER AS rule_id FROM v""")
def rule_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules of at least two sentences with their ids; the vocabulary is bounded by the grammar, not by the corpus."""
    v = _rules(spark, sf_dir).groupBy("rule").agg(F.count("*").alias("df")).filter("df >= 2")
    return v.withColumn("rule_id", F.row_number().over(Window.orderBy("rule")) - 1)


@register("user_rule_counts", f"""WITH {PARSED_SQL}, n AS (SELECT user_id, rule, count(*) AS n FROM rules GROUP BY ALL)
SELECT user_id, rule, n, round(n / (1.0 + n), 6) AS saturated, round(n / (sum(n) OVER (PARTITION BY user_id))::DOUBLE, 6) AS share FROM n""")
def user_rule_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule counts by user, saturated, and as a share of the user's."""
    n = _rules(spark, sf_dir).groupBy("user_id", "rule").agg(F.count("*").alias("n"))
    return n.select("user_id", "rule", "n", F.round(F.col("n") / (1 + F.col("n")), 6).alias("saturated"), F.round(F.col("n") / F.sum("n").over(Window.partitionBy("user_id")), 6).alias("share"))


# --------------------------------------------------------------------------------------------------------- Gaussians


@register("gauss_moments", f"""WITH {VECTORS_SQL}, x AS (SELECT user_id, unnest(range(16)) AS i, unnest(z) AS x FROM vectors WHERE split = 'profile')
SELECT user_id, i::INTEGER AS i, count(*) AS n, round(avg(x), 6) AS mean, round(var_samp(x), 6) AS var FROM x GROUP BY ALL""")
def gauss_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and variance of every user's profile rows by dimension."""
    return G.moments(style_vectors(spark, sf_dir)).select("user_id", "i", "n", F.round("mean", 6).alias("mean"), F.round("var", 6).alias("var"))


@register("gauss_fit")
def gauss_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank one plus diagonal Gaussians."""
    return G.fit(style_vectors(spark, sf_dir))


def axis_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, mu, lambda, v, s) with the mean's direction for v: parameters that SQL can state too."""
    m = G.moments(style_vectors(spark, sf_dir)).groupBy("user_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "mean", "var"))), lambda x: x["mean"]).alias("mu"), F.transform(F.sort_array(F.collect_list(F.struct("i", "mean", "var"))), lambda x: F.greatest(x["var"], F.lit(G.DIAG_FLOOR))).alias("s"))
    return m.select("user_id", "mu", F.lit(0.05).alias("lambda"), scaled(F.col("mu"), 1 / norm(F.col("mu"))).alias("v"), "s")


_PARAMS_SQL = f"""{VECTORS_SQL},
x AS (SELECT user_id, unnest(range(16)) AS i, unnest(z) AS x FROM vectors WHERE split = 'profile'),
m AS (SELECT user_id, i, avg(x) AS mean, greatest(var_samp(x), 1e-6) AS var FROM x GROUP BY ALL),
p0 AS (SELECT user_id, list(mean ORDER BY i) AS mu, list(var ORDER BY i) AS s FROM m GROUP BY user_id),
params AS (SELECT user_id, mu, s, 0.05 AS lam, list_transform(mu, lambda a: a / sqrt(list_inner_product(mu, mu))) AS v FROM p0)"""


def _d2_sql(source: str) -> str:
    return f"""diffs AS (SELECT *, list_transform(list_zip(z, mu), lambda q: q[1] - q[2]) AS diff FROM {source}),
lows AS (SELECT *, list_inner_product(diff, v) AS low FROM diffs),
dist AS (SELECT *, low * low / lam + list_sum(list_transform(list_zip(diff, v, s), lambda q: pow(q[1] - low * q[2], 2) / q[3])) AS d2 FROM lows)"""


def _distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = style_vectors(spark, sf_dir).filter("split = 'val'").join(axis_params(spark, sf_dir), "user_id")
    return rows.select("vec_id", "user_id", "asin", G.d2(*map(F.col, ("z", "mu", "lambda", "v", "s"))).alias("d2"))


@register("gauss_d2", f"WITH {_PARAMS_SQL}, val AS (SELECT * FROM vectors JOIN params USING (user_id) WHERE split = 'val'), {_d2_sql('val')} SELECT vec_id, user_id, round(d2, 6) AS d2 FROM dist")
def gauss_d2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance of every held-out row to its user."""
    return _distances(spark, sf_dir).select("vec_id", "user_id", F.round("d2", 6).alias("d2"))


_T = {f"q{f'{q:g}'[2:]}": t for q, t in G.CHI2_16.items()}  # q95 to q005
_OBSERVED = (0.5, 0.75, 0.9, 0.95, 0.99)
_SCORED_SQL = f"""{_PARAMS_SQL},
pu AS (SELECT DISTINCT asin, user_id FROM vectors WHERE split = 'profile'),
pair AS (SELECT c.asin, c.vec_id AS cand_id, c.z, params.* FROM vectors c JOIN pu USING (asin) JOIN params ON params.user_id = pu.user_id WHERE c.split = 'val'), {_d2_sql('pair')},
lp AS (SELECT asin, cand_id, user_id, d2, -0.5 * (d2 + 0.5 * (list_sum(list_transform(s, lambda t: ln(t))) + ln(1 + lam * list_sum(list_transform(list_zip(v, s), lambda q: q[1] * q[1] / q[2]))) + 16 * ln(2 * pi()))) AS logp FROM dist),
rk AS (SELECT *, row_number() OVER (PARTITION BY asin, cand_id ORDER BY logp DESC, user_id DESC) AS r, lead(logp) OVER (PARTITION BY asin, cand_id ORDER BY logp DESC, user_id DESC) AS nxt,
  {", ".join(f"count(*) FILTER (d2 <= {t}) OVER (PARTITION BY asin, cand_id) AS in_{k}" for k, t in _T.items())} FROM lp),
scored AS (SELECT asin, cand_id, user_id, logp, d2, CASE WHEN nxt IS NULL THEN 'Infinity'::DOUBLE ELSE logp - nxt END AS margin, {", ".join(f"in_{k}::INTEGER AS in_{k}" for k in _T)} FROM rk WHERE r = 1)"""


def scored_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = style_vectors(spark, sf_dir)
    users = v.filter("split = 'profile'").select("asin", "user_id").distinct().join(axis_params(spark, sf_dir), "user_id")
    return G.score_candidates(v.filter("split = 'val'").select("asin", F.col("vec_id").alias("cand_id"), "z"), users, _T)


@register("best_user_margin", f"WITH {_SCORED_SQL} SELECT asin, cand_id, user_id, round(logp, 6) AS logp, round(d2, 6) AS d2, round(margin, 6) AS margin, {', '.join('in_' + k for k in _T)} FROM scored")
def best_user_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best user of every candidate, the margin to the next and how many users' regions hold it."""
    s = scored_candidates(spark, sf_dir)
    return s.select("asin", "cand_id", "user_id", *[F.round(c, 6).alias(c) for c in ("logp", "d2", "margin")], *[f"in_{k}" for k in _T])


_GATED_SQL = f"""{_SCORED_SQL},
lims AS (SELECT * FROM (VALUES {", ".join(f"('{k}', {t}::DOUBLE)" for k, t in _T.items())}) t(threshold, lim) UNION ALL {" UNION ALL ".join(f"SELECT 'obs{round(100 * q)}', quantile_cont(d2, {q}) FROM scored" for q in _OBSERVED)}),
o AS (SELECT s.*, t.threshold, t.lim, CASE t.threshold {" ".join(f"WHEN '{k}' THEN in_{k}" for k in _T)} ELSE 0 END AS inside FROM scored s CROSS JOIN lims t),
gated AS (SELECT *, CASE WHEN d2 > lim THEN 'above_d2' WHEN inside > 2 THEN 'multi_user_inside' WHEN margin < 0 THEN 'below_margin' ELSE 'kept' END AS reason FROM o)"""


def gated_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate against the seven theoretical thresholds and the five percentiles of the distances observed."""
    scored = stage(scored_candidates(spark, sf_dir), "scored")
    return G.gate(scored, _T | G.observed_thresholds(scored, _OBSERVED))


@register("gauss_gate_sweep", f"WITH {_GATED_SQL} SELECT threshold, reason, count(*) AS n, count(DISTINCT asin) AS n_products FROM gated GROUP BY ALL")
def gauss_gate_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many candidates each threshold keeps, and why it drops the others."""
    return gated_candidates(spark, sf_dir).groupBy("threshold", "reason").agg(F.count("*").alias("n"), F.countDistinct("asin").alias("n_products"))


@register("gate_products", f"""WITH {_GATED_SQL}, u AS (SELECT threshold, asin, count(DISTINCT user_id) AS users FROM gated WHERE reason = 'kept' GROUP BY ALL),
p AS (SELECT threshold, sum(users)::BIGINT AS n_kept, {", ".join(f"count(*) FILTER (users >= {k}) AS asins_ge{k}" for k in (1, 2, 3, 5))} FROM u GROUP BY threshold),
d AS (SELECT threshold, {", ".join(f"count(*) FILTER (reason = '{r}') AS n_{r}" for r in ("above_d2", "multi_user_inside", "below_margin"))} FROM gated GROUP BY threshold)
SELECT threshold, n_above_d2, n_multi_user_inside, n_below_margin, coalesce(n_kept, 0) AS n_kept, {", ".join(f"coalesce(asins_ge{k}, 0) AS asins_ge{k}" for k in (1, 2, 3, 5))} FROM d LEFT JOIN p USING (threshold)""")
def gate_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products by number of kept users, and drops, of each threshold."""
    return G.kept_users(gated_candidates(spark, sf_dir))


@register("gate_selection", f"""WITH {_GATED_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY threshold, asin, user_id ORDER BY round(logp, 9) DESC, round(margin, 9) DESC, cand_id) AS r FROM gated WHERE reason = 'kept')
SELECT threshold, asin, user_id, cand_id, round(d2, 6) AS d2 FROM k WHERE r = 1""")
def gate_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best kept candidate of each product and user by threshold."""
    g = gated_candidates(spark, sf_dir).filter("reason = 'kept'")
    w = Window.partitionBy("threshold", "asin", "user_id").orderBy(F.round("logp", 9).desc(), F.round("margin", 9).desc(), "cand_id")
    return g.withColumn("r", F.row_number().over(w)).filter("r = 1").select("threshold", "asin", "user_id", "cand_id", F.round("d2", 6).alias("d2"))


@register("prototype_ranks", f"""WITH {VECTORS_SQL}, x AS (SELECT asin, user_id, unnest(range(16)) AS i, unnest(z) AS x FROM vectors WHERE split = 'profile'), m AS (SELECT asin, user_id, i, avg(x) AS m FROM x GROUP BY ALL),
p0 AS (SELECT asin, user_id, list(m ORDER BY i) AS p FROM m GROUP BY ALL), p AS (SELECT asin, user_id, list_transform(p, lambda q: q / sqrt(list_inner_product(p, p))) AS p FROM p0),
v AS (SELECT vec_id, asin, user_id, round(list_inner_product(z, p), 9) AS own, z FROM vectors JOIN p USING (asin, user_id) WHERE split = 'val'),
r AS (SELECT v.vec_id, count(*) FILTER (q.user_id <> v.user_id AND round(list_inner_product(z, q.p), 9) >= own) AS rank FROM v JOIN p q USING (asin) GROUP BY v.vec_id)
SELECT count(*) AS n_evaluated, round(avg(rank), 6) AS mean_rank, round(avg((rank = 0)::INTEGER), 6) AS top1, round(avg((rank < 3)::INTEGER), 6) AS top3 FROM r""")
def prototype_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well held-out rows find their user among a product's prototypes."""
    r = G.prototype_ranks(style_vectors(spark, sf_dir))
    return r.agg(F.count("*").alias("n_evaluated"), F.round(F.avg("rank"), 6).alias("mean_rank"), F.round(F.avg((F.col("rank") == 0).cast("int")), 6).alias("top1"), F.round(F.avg((F.col("rank") < 3).cast("int")), 6).alias("top3"))


@register("audit_calibration", f"""WITH {_PARAMS_SQL}, val AS (SELECT * FROM vectors JOIN params USING (user_id) WHERE split = 'val'), {_d2_sql('val')},
c AS (SELECT user_id, count(*) AS n_val, avg((d2 <= 26.2962)::INTEGER) AS coverage, median(d2) AS median_d2 FROM dist GROUP BY user_id)
SELECT user_id, n_val, round(coverage, 6) AS coverage, round(median_d2, 6) AS median_d2, coverage >= 0.8 AND median_d2 <= 26.2962 AS a2_pass FROM c""")
def audit_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage of the 95 % region on held-out rows."""
    c = G.calibration(_distances(spark, sf_dir))
    return c.select("user_id", "n_val", F.round("coverage", 6).alias("coverage"), F.round("median_d2", 6).alias("median_d2"), "a2_pass")


@register("audit_quantiles", f"""WITH {_PARAMS_SQL}, val AS (SELECT * FROM vectors JOIN params USING (user_id) WHERE split = 'val'), {_d2_sql('val')},
l AS (SELECT user_id, list_sort(list(d2)) AS x, count(*) AS n FROM dist GROUP BY user_id)
SELECT user_id, n AS n_val, round(x[floor(0.5 * (n - 1))::INTEGER + 1], 6) AS d2_q50, round(x[floor(0.75 * (n - 1))::INTEGER + 1], 6) AS d2_q75, round(x[floor(0.95 * (n - 1))::INTEGER + 1], 6) AS d2_q95, round(x[n], 6) AS d2_max FROM l""")
def audit_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Floor-index quantiles of the distances."""
    q = G.floor_quantiles(_distances(spark, sf_dir), "user_id", "d2")
    return q.select("user_id", "n_val", *[F.round(c, 6).alias(c) for c in ("d2_q50", "d2_q75", "d2_q95", "d2_max")])


@register("audit_numerical", f"""WITH {_PARAMS_SQL}, val AS (SELECT * FROM vectors JOIN params USING (user_id) WHERE split = 'val'), {_d2_sql('val')}, n AS (SELECT user_id, count(*) AS n_val, bool_and(isfinite(d2)) AS finite FROM dist GROUP BY user_id)
SELECT user_id, coalesce(n_val, 0) AS n_val, lam > 0 AND list_min(s) > 0 AND isfinite(ln(lam) + list_sum(list_transform(s, lambda t: ln(greatest(t, 1e-30))))) AND coalesce(n_val, 0) >= 10 AND coalesce(finite, true) AS a1_pass FROM params LEFT JOIN n USING (user_id)""")
def audit_numerical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which users' parameters are numerically valid."""
    p = axis_params(spark, sf_dir).join(_distances(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("n_val"), F.max("d2").alias("d2_max")), "user_id", "left")
    none = p.select("user_id").limit(0)
    calibrated = none.select("user_id", *[F.lit(None).cast(t).alias(c) for c, t in (("coverage", "double"), ("median_d2", "double"), ("a2_pass", "boolean"))])
    stable = none.select("user_id", *[F.lit(None).cast("double").alias(c) for c in ("fit_rate", "rho_median", "agreement_median")])
    return G.verdict(p, calibrated, stable).select("user_id", F.coalesce("n_val", F.lit(0)).alias("n_val"), "a1_pass")


def _verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = style_vectors(spark, sf_dir)
    fits = stage(G.fit(v), "fits")
    val = v.filter("split = 'val'").join(fits.select("user_id", "mu", "lambda", "v", "s"), "user_id").select("user_id", G.d2(*map(F.col, ("z", "mu", "lambda", "v", "s"))).alias("d2"))
    return G.verdict(fits, G.calibration(val), G.stability(v))


@register("audit_verdict")
def audit_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which fitted users pass the three rules: numerical validity, calibration and stability."""
    return _verdicts(spark, sf_dir).select("user_id", "n", "n_val", "coverage", "median_d2", "fit_rate", "rho_median", "agreement_median", "a1_pass", "a2_pass", "a3_pass", "valid")


@register("audit_summary")
def audit_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of users by rule, and percentiles of the audit's figures."""
    return G.audit_summary(_verdicts(spark, sf_dir))


@register("audit_stability")
def audit_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How refits on subsamples agree with the full fit."""
    return G.stability(style_vectors(spark, sf_dir))


@register("pair_selection", f"""WITH {_PARAMS_SQL}, pu AS (SELECT DISTINCT asin, user_id FROM vectors WHERE split = 'profile'),
u AS (SELECT asin, params.* FROM pu JOIN params USING (user_id)),
p AS (SELECT a.asin, a.user_id AS u1, b.user_id AS u2, round(list_sum(list_transform(list_zip(a.mu, b.mu, a.s, b.s), lambda q: pow(q[1] - q[2], 2) / ((q[3] + q[4]) / 2))) / 8 + 0.5 * list_sum(list_transform(list_zip(a.s, b.s), lambda q: ln((q[1] + q[2]) / 2 / sqrt(q[1] * q[2])))), 6) AS distance FROM u a JOIN u b ON a.asin = b.asin AND a.user_id < b.user_id)
SELECT asin, u1, u2, distance FROM (SELECT *, row_number() OVER (PARTITION BY asin ORDER BY distance DESC, u1, u2) AS r FROM p) WHERE r = 1""")
def pair_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most distant pair of users of each product."""
    v = style_vectors(spark, sf_dir)
    users = v.filter("split = 'profile'").select("asin", "user_id").distinct().join(axis_params(spark, sf_dir), "user_id")
    return G.most_distant_pairs(users.select("asin", "user_id", "mu", "s"))


@register("pair_selection_exact", f"""WITH {_PARAMS_SQL}, pu AS (SELECT DISTINCT asin, user_id FROM vectors WHERE split = 'profile'),
u AS (SELECT asin, user_id, mu, s, v, lam, list_sum(list_transform(s, lambda t: ln(t))) + ln(1 + lam * list_sum(list_transform(list_zip(v, s), lambda q: q[1] * q[1] / q[2]))) AS ld FROM pu JOIN params USING (user_id)),
q0 AS (SELECT a.asin, a.user_id AS u1, b.user_id AS u2, a.lam / 2 AS l, a.ld AS ld1, b.ld AS ld2, list_transform(list_zip(a.s, b.s), lambda q: (q[1] + q[2]) / 2) AS m, list_transform(list_zip(a.mu, b.mu), lambda q: q[1] - q[2]) AS df, a.v AS v1, b.v AS v2 FROM u a JOIN u b ON a.asin = b.asin AND a.user_id < b.user_id),
q1 AS (SELECT *, list_sum(list_transform(list_zip(df, m), lambda q: q[1] * q[1] / q[2])) AS dd, list_sum(list_transform(list_zip(v1, df, m), lambda q: q[1] * q[2] / q[3])) AS c1, list_sum(list_transform(list_zip(v2, df, m), lambda q: q[1] * q[2] / q[3])) AS c2,
  1 / l + list_sum(list_transform(list_zip(v1, m), lambda q: q[1] * q[1] / q[2])) AS aa, 1 / l + list_sum(list_transform(list_zip(v2, m), lambda q: q[1] * q[1] / q[2])) AS cc, list_sum(list_transform(list_zip(v1, v2, m), lambda q: q[1] * q[2] / q[3])) AS bb, list_sum(list_transform(m, lambda t: ln(t))) AS lm FROM q0),
r0 AS (SELECT asin, u1, u2, round((dd - (cc * c1 * c1 - 2 * bb * c1 * c2 + aa * c2 * c2) / (aa * cc - bb * bb)) / 8 + 0.5 * (lm + ln((aa * cc - bb * bb) * l * l) - (ld1 + ld2) / 2), 6) AS distance FROM q1)
SELECT asin, u1, u2, distance FROM (SELECT *, row_number() OVER (PARTITION BY asin ORDER BY distance DESC, u1, u2) AS r FROM r0) WHERE r = 1""")
def pair_selection_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most distant pair of users of each product, directions included; as many products as have two users are expected."""
    users = style_vectors(spark, sf_dir).filter("split = 'profile'").select("asin", "user_id").distinct().join(axis_params(spark, sf_dir), "user_id")
    users = stage(users.select("asin", "user_id", "mu", F.array("lambda").alias("lambdas"), F.array("v").alias("v"), "s"), "users")
    expected = users.groupBy("asin").count().filter("count > 1").count()
    return L.require_products(L.most_distant_exact(users), expected)


_TAU = G.CHI2_16[0.95]


def exact_d2_sql(source: str) -> str:
    """`exact`: the columns of `source` (z, mu, lam, v, s) with Mahalanobis distance and log density."""
    return f"""ex1 AS (SELECT *, list_transform(list_zip(z, mu), lambda q: q[1] - q[2]) AS df FROM {source}),
ex2 AS (SELECT *, list_sum(list_transform(list_zip(df, s), lambda q: q[1] * q[1] / q[2])) AS dd, list_sum(list_transform(list_zip(df, s, v), lambda q: q[1] * q[3] / q[2])) AS dv, list_sum(list_transform(list_zip(v, s), lambda q: q[1] * q[1] / q[2])) AS vs FROM ex1),
ex3 AS (SELECT *, greatest(dd - lam * dv * dv / (1 + lam * vs), 0) AS d2 FROM ex2),
exact AS (SELECT *, -0.5 * d2 - 0.5 * (list_sum(list_transform(s, lambda t: ln(t))) + ln(1 + lam * vs) + 16 * ln(2 * pi())) AS logp FROM ex3)"""


@register("conditional_pairs", f"""WITH {_PARAMS_SQL}, pu AS (SELECT DISTINCT asin, user_id FROM vectors WHERE split = 'profile'), u AS (SELECT asin, params.* FROM pu JOIN params USING (user_id)),
c AS (SELECT vectors.asin, vec_id AS cand_id, 'q' || vec_id::VARCHAR AS text, z, u.* EXCLUDE (asin) FROM vectors JOIN u USING (asin) WHERE split = 'val'), {exact_d2_sql("c")},
own AS (SELECT a.asin, a.user_id AS me, b.user_id AS other, a.cand_id, a.text, a.logp, a.d2, a.logp - b.logp AS margin FROM exact a JOIN exact b ON a.asin = b.asin AND a.cand_id = b.cand_id AND a.user_id <> b.user_id WHERE a.d2 <= {_TAU} AND b.d2 > {_TAU} AND a.logp - b.logp >= 0),
best AS (SELECT * FROM own QUALIFY row_number() OVER (PARTITION BY asin, me, other ORDER BY round(logp, 9) DESC, cand_id) = 1),
f AS (SELECT a.asin, a.me AS u1, a.other AS u2, a.cand_id AS c1, b.cand_id AS c2, a.d2 AS d21, b.d2 AS d22 FROM best a JOIN best b ON a.asin = b.asin AND a.me = b.other AND a.other = b.me AND a.me < b.me WHERE a.text <> b.text),
bd AS (SELECT a.asin, a.user_id AS u1, b.user_id AS u2, round(list_sum(list_transform(list_zip(a.mu, b.mu, a.s, b.s), lambda q: pow(q[1] - q[2], 2) / ((q[3] + q[4]) / 2))) / 8 + 0.5 * list_sum(list_transform(list_zip(a.s, b.s), lambda q: ln((q[1] + q[2]) / 2 / sqrt(q[1] * q[2])))), 6) AS distance FROM u a JOIN u b ON a.asin = b.asin AND a.user_id < b.user_id)
SELECT asin, u1, u2, c1, c2, round(d21, 6) AS d2_1, round(d22, 6) AS d2_2, distance FROM f JOIN bd USING (asin, u1, u2) QUALIFY row_number() OVER (PARTITION BY asin ORDER BY distance DESC, u1, u2) = 1""")
def conditional_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most distant feasible pair of users of each product, by exact distances, and the candidate chosen for each."""
    v = style_vectors(spark, sf_dir)
    users = v.filter("split = 'profile'").select("asin", "user_id").distinct().join(axis_params(spark, sf_dir), "user_id")
    cands = v.filter("split = 'val'").select("asin", F.col("vec_id").alias("cand_id"), F.concat(F.lit("q"), "vec_id").alias("text"), "z")
    out = G.select_pairs(cands, users)
    return out.select("asin", "u1", "u2", F.col("p1.cand_id").alias("c1"), F.col("p2.cand_id").alias("c2"), F.round("p1.d2", 6).alias("d2_1"), F.round("p2.d2", 6).alias("d2_2"), "distance")


@register("eligible_users", f"""WITH {VECTORS_SQL}, n AS (SELECT user_id, count(*) FILTER (split = 'profile') AS n_profile, count(*) FILTER (split = 'val') AS n_val FROM vectors GROUP BY user_id)
SELECT * FROM n WHERE n_profile >= 18 AND n_val >= 4 AND user_id IN (SELECT 'u' || label::VARCHAR FROM embeddings GROUP BY label HAVING min(vec_id) % 2 = 0)""")
def eligible_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users with enough profile and held-out rows who are on the list of trained ones (here: whose first vector has an even id)."""
    v = style_vectors(spark, sf_dir)
    trained = v.groupBy("user_id").agg(F.min("vec_id").alias("first")).filter("first % 2 = 0").select("user_id")
    return S.gaussian_eligible(v, trained, 18, 4)


@register("top_product_users", f"""WITH {REVIEWS_SQL}, n AS (SELECT user_id, count(*) AS n FROM sentences GROUP BY user_id), p AS (SELECT DISTINCT asin, user_id FROM reviews)
SELECT asin, user_id, n FROM p JOIN n USING (user_id) QUALIFY row_number() OVER (PARTITION BY asin ORDER BY n DESC, user_id) <= 2""")
def top_product_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two users of each product who wrote the most sentences."""
    n = review_sentences(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("n"))
    return S.top_users(reviews(spark, sf_dir).select("asin", "user_id").distinct().join(n, "user_id"), 2)


# ------------------------------------------------------------------------------------------------- rule components

COMPONENTS = 16


def _rule_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    """(rows (sent_id, cols) of sentences and the rules of the vocabulary that they hold, the vocabulary). A sentence's rules are together from the start and are never shuffled."""
    lists = stage(sentence_rule_lists(parsed(spark, sf_dir), "sent_id"), "sentence-rules")
    v = lists.select(F.explode("rules").alias("rule")).groupBy("rule").agg(F.count("*").alias("df")).filter("df >= 2")
    names = [r.rule for r in v.orderBy("rule").collect()]  # bounded by the grammar
    return numbered(lists, "sent_id", "rules", names), names


def _rule_entries(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The same as entries (row, col, value) and a table (rule, rule_id)."""
    rows, names = _rule_rows(spark, sf_dir)
    v = spark.createDataFrame(list(enumerate(names)), "rule_id int, rule string")
    return rows.select(F.col("sent_id").alias("row"), F.explode("cols").alias("col"), F.lit(1.0).alias("value")), v


@register("rule_projection", f"""WITH {PARSED_SQL}, v AS (SELECT rule, row_number() OVER (ORDER BY rule) - 1 AS rule_id FROM rules GROUP BY rule HAVING count(DISTINCT sent_id) >= 2),
c AS (SELECT rule, i AS dim, ((rule_id * (2 * i + 3) + i) % 17 - 8) / 16.0::DOUBLE AS v FROM v, range(16) AS r(i))
SELECT sent_id, dim::INTEGER AS dim, sum(v)::DOUBLE AS z FROM (SELECT DISTINCT sent_id, rule FROM rules) JOIN c USING (rule) GROUP BY ALL""")
def rule_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences projected on given components: a sentence's sum of its rules' numbers, all sixteenths, so that sums are exact."""
    rows, names = _rule_rows(spark, sf_dir)
    rule_id, i = np.arange(len(names))[:, None], np.arange(COMPONENTS)
    z = project_rows(rows, "sent_id", ((rule_id * (2 * i + 3) + i) % 17 - 8) / 16)
    return z.select("sent_id", F.posexplode("z").alias("dim", "z"))


@register("rule_components")
def rule_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The components of all sentences' rules, fitted: (component, singular, rule, weight)."""
    rows, names = _rule_rows(spark, sf_dir)
    ones = F.array_repeat(F.lit(1.0), F.size("cols"))
    values, right = truncated_svd_of_rows(rows.select("cols", ones.alias("values")), len(names), COMPONENTS)
    found = [(c + 1, float(s), rule, float(x)) for c, (s, row) in enumerate(zip(values, right, strict=True)) for rule, x in zip(names, row, strict=True)]
    return spark.createDataFrame(found, "component int, singular double, rule string, weight double")
