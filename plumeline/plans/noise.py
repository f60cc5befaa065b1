"""Noise queries: misspellings of the benchmark queries and conversation words, error profiles, injection and replay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumeline.functions.noise import APOSTROPHES, HOMOPHONES, MECHANISMS, NEAR_KEYS, OTHER_LAYOUT, apply_edit, classify, corrupt, minimal
from plumeline.operators.injection import inject_chain, located, replay
from plumeline.operators.profiles import context_profile, cosine_summary, error_model, hierarchical_rate, history_form, lift_cosine, mechanism_histogram, typo_history, user_totals
from plumeline.operators.rules import annotated_tokens, length_bucket, signature_counts, signatures
from plumeline.plans.style import PARSED_SQL, parse, parse_sql, parsed
from plumeline.registry import register
from plumeline.sources.tables import spread, table


#: Whose a conversation is: one of ten users', or its own, where users are compared with each other.
TEN, EACH = "conv_id % 10", "conv_id"


def user_words(spark: SparkSession, sf_dir: str, user: str = TEN) -> DataFrame:
    """(user_id, ref, word): the distinct words of a conversation turn."""
    t = spread(table(spark, sf_dir, "conversations"), 2000)
    words = F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Za-z']+"), F.lit(0)))
    return t.select(F.concat(F.lit("u"), F.expr(user)).alias("user_id"), F.concat_ws(":", "conv_id", "turn").alias("ref"), F.explode(words).alias("word"))


def user_edits(spark: SparkSession, sf_dir: str, user: str = TEN) -> DataFrame:
    """(user_id, ref, word, mechanism, typo): each word corrupted by the mechanism its hash picks."""
    return corrupted(user_words(spark, sf_dir, user))


def corrupted(rows: DataFrame) -> DataFrame:
    """`rows` (ref, word and more) with mechanism and typo."""
    seed = F.concat_ws("|", "ref", "word")
    which = F.pmod(F.conv(F.left(F.sha1(F.encode(seed, "UTF-8")), F.lit(4)), 16, 10).cast("int"), F.lit(len(MECHANISMS)))
    rows = rows.withColumn("mechanism", F.array(*map(F.lit, MECHANISMS))[which])
    return rows.withColumn("typo", corrupt(F.col("word"), F.col("mechanism"), seed))


def _case(column: str, pairs: dict[str, str]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in pairs.items()) + " END"


def _list(items: list[str]) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in items) + "]"


_HEX = "list_sum(list_transform(range(1, {n} + 1), lambda k: (instr('0123456789abcdef', substr({d}, k, 1)) - 1) * pow(16, {n} - k)))::BIGINT"


def _pick_sql(seed: str, n: str) -> str:
    return f"({_HEX.format(n=7, d=f'right(sha1({seed}), 7)')} % greatest({n}, 1))"


def corrupted_sql(source: str, out: str) -> str:
    """`out`: the columns of `source` (word, seed, mechanism) and the typo, as common table expressions."""
    o = out
    return f"""{o}1 AS (SELECT *, length(word) AS n_, {_pick_sql("seed", "length(word)")} + 1 AS i_ FROM {source}),
{o}2 AS (SELECT *, substr(word, i_, 1) AS c, lower(substr(word, i_, 1)) AS lc, substr(word, 1, i_ - 1) AS pre, substr(word, i_ + 1) AS post, least(i_, greatest(n_ - 1, 1)) AS j FROM {o}1),
{o}3 AS (SELECT *, coalesce({_case("lc", NEAR_KEYS)}, '') AS keys, {_case("lc", {k: v for k, v in OTHER_LAYOUT.items() if v.isalpha()})} AS moved, {_case("lower(word)", {k: v[0] for k, v in HOMOPHONES.items()})} AS sound FROM {o}2),
{o}4 AS (SELECT *, substr(keys, {_pick_sql("seed || '#'", "length(keys)")} + 1, 1) AS key, substr('abcdefghijklmnopqrstuvwxyz', {_pick_sql("seed || '+'", "26")} + 1, 1) AS ins FROM {o}3),
{o} AS (SELECT * EXCLUDE (n_, i_, c, lc, pre, post, j, keys, moved, sound, key, ins), CASE
  WHEN mechanism = 'letter_deletion' THEN pre || post WHEN mechanism = 'letter_repetition' THEN pre || c || c || post WHEN mechanism = 'letter_insertion' THEN pre || ins || c || post
  WHEN mechanism = 'letter_swap' THEN substr(word, 1, j - 1) || substr(word, j + 1, 1) || substr(word, j, 1) || substr(word, j + 2)
  WHEN mechanism = 'keyboard_adjacent' AND keys <> '' THEN pre || CASE WHEN c <> lc THEN upper(key) ELSE key END || post
  WHEN mechanism = 'keyboard_layout' AND moved IS NOT NULL THEN pre || CASE WHEN c <> lc THEN upper(moved) ELSE moved END || post
  WHEN mechanism = 'homophone_substitution' AND sound IS NOT NULL THEN sound ELSE word END AS typo FROM {o}4)"""


def classified_sql(source: str, out: str) -> str:
    """`out`: the columns of `source` (word, typo) and what the classifier says, `found`."""
    o = out
    return f"""{o}1 AS (SELECT *, lower(typo) AS a, lower(word) AS b, length(typo) AS la, length(word) AS lb FROM {source}),
{o}2 AS (SELECT *, list_filter(range(1, la + 1), lambda i: substr(a, i, 1) <> substr(b, i, 1)) AS ds, CASE WHEN la > lb THEN a ELSE b END AS lo, CASE WHEN la > lb THEN b ELSE a END AS sh FROM {o}1),
{o}3 AS (SELECT *, substr(a, ds[1], 1) AS x1, substr(b, ds[1], 1) AS y1, substr(a, ds[2], 1) AS x2, substr(b, ds[2], 1) AS y2, coalesce(list_filter(range(1, length(sh) + 1), lambda i: substr(sh, i, 1) <> substr(lo, i, 1))[1], length(sh) + 1) AS p_ FROM {o}2),
{o} AS (SELECT * EXCLUDE (a, b, la, lb, ds, lo, sh, x1, y1, x2, y2, p_), CASE WHEN la = 0 OR lb = 0 THEN 'semantic_substitution' WHEN a = b THEN 'case_error'
  WHEN list_contains({_list([f"{x} {y}" for x, y in APOSTROPHES])}, a || ' ' || b) OR replace(a, '''', '') = replace(b, '''', '') THEN 'apostrophe_error'
  WHEN list_contains({_list([f"{x} {y}" for x, ys in HOMOPHONES.items() for y in ys])}, a || ' ' || b) THEN 'homophone_substitution'
  WHEN la = lb THEN CASE WHEN len(ds) = 1 THEN CASE WHEN {_case("x1", OTHER_LAYOUT)} = y1 THEN 'keyboard_layout' WHEN contains({_case("x1", NEAR_KEYS)}, y1) AND contains({_case("y1", NEAR_KEYS)}, x1) THEN 'keyboard_adjacent' ELSE 'semantic_substitution' END
    WHEN len(ds) = 2 AND ds[2] = ds[1] + 1 AND x1 = y2 AND y1 = x2 THEN 'letter_swap' ELSE 'semantic_substitution' END
  WHEN abs(la - lb) = 1 THEN CASE WHEN substr(lo, 1, p_ - 1) || substr(lo, p_ + 1) <> sh THEN 'semantic_substitution' WHEN la < lb THEN 'letter_deletion'
    WHEN (p_ > 1 AND substr(lo, p_, 1) = substr(lo, p_ - 1, 1)) OR substr(lo, p_, 1) = substr(lo, p_ + 1, 1) THEN 'letter_repetition' ELSE 'letter_insertion' END
  ELSE 'semantic_substitution' END AS found FROM {o}3)"""


_MECHANISM_SQL = f"({_list(list(MECHANISMS))})[{_HEX.format(n=4, d='left(sha1(seed), 4)')} % {len(MECHANISMS)} + 1] AS mechanism"


def edits_sql(user: str = TEN) -> str:
    return f"""words AS (SELECT 'u' || ({user})::VARCHAR AS user_id, conv_id::VARCHAR || ':' || turn::VARCHAR AS ref, unnest(list_distinct(regexp_extract_all(text, '[A-Za-z'']+'))) AS word FROM conversations),
e0 AS (SELECT *, ref || '|' || word AS seed, {_MECHANISM_SQL} FROM words), {corrupted_sql("e0", "edits")}"""


def classes_sql(user: str = TEN) -> str:
    return f"{edits_sql(user)}, {classified_sql('edits', 'classes')}"


EDITS_SQL, CLASSES_SQL = edits_sql(), classes_sql()


@register("mechanism_apply", f"WITH {EDITS_SQL} SELECT user_id, ref, word, mechanism, typo FROM edits")
def mechanism_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word and its misspelling."""
    return user_edits(spark, sf_dir)


def _classified(spark: SparkSession, sf_dir: str, user: str = TEN) -> DataFrame:
    return user_edits(spark, sf_dir, user).withColumn("found", classify(F.col("typo"), F.col("word")))


@register("mechanism_class", f"WITH {CLASSES_SQL} SELECT mechanism, found, count(*) AS n, min(word || '>' || typo) AS example FROM classes GROUP BY ALL")
def mechanism_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the classifier says of each mechanism's misspellings."""
    return _classified(spark, sf_dir).groupBy("mechanism", "found").agg(F.count("*").alias("n"), F.min(F.concat("word", F.lit(">"), "typo")).alias("example"))


@register("minimality", f"""WITH {EDITS_SQL} SELECT user_id, length(word) >= 3 AND typo <> '' AND word <> typo AND levenshtein(lower(word), lower(typo)) <= 5 AND abs(length(word) - length(typo)) <= 3 AS minimal, count(*) AS n, sum(levenshtein(word, typo))::BIGINT AS distance FROM edits GROUP BY ALL""")
def minimality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many misspellings are small enough to use."""
    return user_edits(spark, sf_dir).groupBy("user_id", minimal(F.col("word"), F.col("typo")).alias("minimal")).agg(F.count("*").alias("n"), F.sum(F.levenshtein("word", "typo")).alias("distance"))


# ------------------------------------------------------------------------------------------------------------ profiles

_CONTEXT = "CASE WHEN length(word) <= 3 THEN 'DET' WHEN length(word) <= 6 THEN 'NOUN' ELSE 'VERB' END"


def _records(spark: SparkSession, sf_dir: str, user: str = TEN) -> DataFrame:
    """(user_id, ctx, err) of each misspelling that is one."""
    ctx = F.when(F.length("word") <= 3, "DET").when(F.length("word") <= 6, "NOUN").otherwise("VERB")
    return _classified(spark, sf_dir, user).filter("found not in ('semantic_substitution', 'case_error')").select("user_id", ctx.alias("ctx"), F.col("found").alias("err"))


def profile_sql(user: str = TEN) -> str:
    return f"""{classes_sql(user)}, rec AS (SELECT user_id, {_CONTEXT} AS ctx, found AS err FROM classes WHERE found NOT IN ('semantic_substitution', 'case_error')),
ne AS (SELECT count(DISTINCT err) AS n_e FROM rec),
gc AS (SELECT ctx, err, count(*) AS c FROM rec GROUP BY ALL), uc AS (SELECT user_id, ctx, err, count(*) AS c FROM rec GROUP BY ALL),
g AS (SELECT ctx, err, (c + 0.1) / (sum(c) OVER (PARTITION BY ctx) + 0.1 * n_e) AS p_global FROM gc CROSS JOIN ne),
u AS (SELECT user_id, ctx, err, c, (c + 0.1) / (sum(c) OVER (PARTITION BY user_id, ctx) + 0.1 * n_e) AS p_user FROM uc CROSS JOIN ne),
profile AS (SELECT user_id, ctx, err, c, p_user, ln(p_user / p_global) AS lift FROM u JOIN g USING (ctx, err))"""


_PROFILE_SQL = profile_sql()


@register("error_profile", f"WITH {_PROFILE_SQL} SELECT user_id, ctx, err, c, round(p_user, 6) AS p_user, round(lift, 6) AS lift FROM profile")
def error_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Smoothed error probabilities by user and context, and their logarithm over everybody's."""
    return context_profile(_records(spark, sf_dir)).select("user_id", "ctx", "err", "c", F.round("p_user", 6).alias("p_user"), F.round("lift", 6).alias("lift"))


@register("profile_cosine", f"""WITH {_PROFILE_SQL}, n AS (SELECT user_id, sqrt(sum(lift * lift)) AS n FROM profile GROUP BY user_id),
d AS (SELECT a.user_id AS u1, b.user_id AS u2, sum(a.lift * b.lift) AS d FROM profile a JOIN profile b ON a.ctx = b.ctx AND a.err = b.err AND a.user_id < b.user_id GROUP BY ALL)
SELECT u1, u2, round(d / (x.n * y.n), 6) AS cosine FROM d JOIN n x ON x.user_id = u1 JOIN n y ON y.user_id = u2""")
def profile_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosines of users' lift vectors."""
    return lift_cosine(context_profile(_records(spark, sf_dir))).select("u1", "u2", F.round("cosine", 6).alias("cosine"))


@register("cosine_summary", f"""WITH {profile_sql(EACH)}, n AS (SELECT user_id, sqrt(sum(lift * lift)) AS n FROM profile GROUP BY user_id),
d AS (SELECT a.user_id AS u1, b.user_id AS u2, sum(a.lift * b.lift) AS d FROM profile a JOIN profile b ON a.ctx = b.ctx AND a.err = b.err AND a.user_id < b.user_id GROUP BY ALL),
c AS (SELECT coalesce(d / nullif(x.n * y.n, 0), 0) AS c FROM n x JOIN n y ON x.user_id < y.user_id LEFT JOIN d ON u1 = x.user_id AND u2 = y.user_id)
SELECT (SELECT count(*) FROM n) AS n_users, round(avg(c), 6) AS mean, round(median(round(c, 6)), 6) AS median, round(stddev_pop(c), 6) AS std FROM c""")
def cosine_summary_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean, median and deviation of all users' cosines with each other, every conversation a user."""
    return cosine_summary(context_profile(_records(spark, sf_dir, EACH))).select("n_users", *[F.round(c, 6).alias(c) for c in ("mean", "median", "std")])


@register("common_errors", f"WITH {_PROFILE_SQL} SELECT err, count(*) AS n FROM rec GROUP BY err ORDER BY n DESC, err LIMIT 10")
def common_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten most common error types."""
    return _records(spark, sf_dir).groupBy("err").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "err").limit(10)


# --------------------------------------------------------------------------------------------------- signatures, edits


_OPENED = "CASE WHEN {d} IN ('advcl', 'acl', 'relcl', 'ccomp', 'xcomp', 'conj', 'parataxis') THEN upper({d}) WHEN {d} = 'prep' THEN 'PREP' ELSE '' END"
_BUCKET = "CASE WHEN length(text) BETWEEN 1 AND 3 THEN '1-3' WHEN length(text) BETWEEN 4 AND 6 THEN '4-6' WHEN length(text) BETWEEN 7 AND 10 THEN '7-10' WHEN length(text) BETWEEN 11 AND 20 THEN '11-20' ELSE '11+' END"


def annotated_sql(source: str, key: str, words: str, carried: str = "", tag: str = "") -> str:
    """`x{tag}_` (key, i, text, the seven signatures as columns s0 to s6 and the context signature) of the parsed lists of `source`."""
    more = f", {carried}" if carried else ""
    return f"""tok{tag}_ AS (SELECT {key}{more}, unnest(range(1, len(p) + 1)) AS i, p, d, h, {words} AS words FROM {source}),
kids{tag}_ AS (SELECT {key}, i, lag(p[i]) OVER s AS l, lead(p[i]) OVER s AS r FROM tok{tag}_ WHERE h[i] <> i WINDOW s AS (PARTITION BY {key}, h[i] ORDER BY i)),
climb{tag}_ AS (SELECT {key}, i, h[i] AS up, d, h, h[i] = i AS top, CASE WHEN h[i] = i THEN '' ELSE {_OPENED.format(d="d[h[i]]")} END AS mark FROM tok{tag}_),
walk{tag}_ AS (SELECT * FROM climb{tag}_ UNION ALL SELECT {key}, i, h[up], d, h, h[up] = up, CASE WHEN h[up] = up THEN '' ELSE {_OPENED.format(d="d[h[up]]")} END FROM walk{tag}_ WHERE mark = '' AND NOT top),
marks{tag}_ AS (SELECT {key}, i, max(mark) AS mark FROM walk{tag}_ GROUP BY ALL),
ann{tag}_ AS (SELECT t.*, words[i] AS text, p[i] AS pos, d[i] AS dep, CASE WHEN h[i] = i THEN 'ROOT' ELSE p[h[i]] END AS parent, CASE WHEN h[i] = i OR h[h[i]] = h[i] THEN 'ROOT' ELSE p[h[h[i]]] END AS grand,
  CASE WHEN h[i] = i THEN 'd0' WHEN h[h[i]] = h[i] THEN 'd1' WHEN h[h[h[i]]] = h[h[i]] THEN 'd2' ELSE 'd3+' END AS depth, coalesce(nullif(m.mark, ''), 'ROOT') AS clause, coalesce(l, 'NONE') AS lft, coalesce(r, 'NONE') AS rgt
  FROM tok{tag}_ t JOIN marks{tag}_ m USING ({key}, i) LEFT JOIN kids{tag}_ USING ({key}, i)),
x{tag}_ AS (SELECT {key}{more}, i, text, pos, dep, parent, {_BUCKET} AS len_bucket, pos || '|' || dep || '|' || parent || '|' || grand || '|' || clause || '|' || depth AS s0, 'D4|' || grand || '|' || parent || '|' || dep || '|' || pos AS s1, 'D3|' || parent || '|' || dep || '|' || pos AS s2,
  clause || '|' || pos AS s3, depth || '|' || pos || '|' || dep AS s4, pos || '|' || lft || '|' || rgt AS s5, pos || '|' || dep AS s6 FROM ann{tag}_)"""


LEVELS_SQL = "unnest([0, 1, 2, 3, 4, 5, 6]) AS level, unnest([s0, s1, s2, s3, s4, s5, s6]) AS sig"


@register("token_signatures", f"WITH RECURSIVE {PARSED_SQL}, {annotated_sql('k', 'sent_id', 'ws')}, g AS (SELECT len_bucket, {LEVELS_SQL} FROM x_) SELECT level::INTEGER AS level, sig, len_bucket, count(*) AS n FROM g GROUP BY ALL")
def token_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each context signature of a parsed word occurs, by level and length of the word."""
    rows = annotated_tokens(parsed(spark, sf_dir))
    return signature_counts(rows.withColumn("len_bucket", length_bucket(F.length("t.text"))), "len_bucket").select("level", "sig", "len_bucket", "n")


def _first_long(text: Column) -> Column:
    return F.regexp_extract(text, "([A-Za-z]{5,})", 1)


@register("edit_apply", """WITH b AS (SELECT item_id, text, regexp_extract(text, '([A-Za-z]{5,})', 1) AS word FROM benchmark), s AS (SELECT *, instr(text, word) - 1 AS s FROM b WHERE word <> '')
SELECT item_id, word, s::INTEGER AS start, substr(text, 1, s) || substr(word, 1, length(word) - 1) || substr(text, s + length(word) + 1) AS edited, levenshtein(word, substr(word, 1, length(word) - 1))::INTEGER AS distance FROM s""")
def edit_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last letter of each query's first long word dropped."""
    b = table(spark, sf_dir, "benchmark").select("item_id", "text", _first_long(F.col("text")).alias("word")).filter("word <> ''")
    b = b.withColumn("start", F.instr("text", F.col("word")) - 1).withColumn("typo", F.substring("word", F.lit(1), F.length("word") - 1))
    return b.select("item_id", "word", "start", apply_edit(F.col("text"), F.col("start"), F.col("start") + F.length("word"), F.col("word"), F.col("typo")).alias("edited"), F.levenshtein("word", "typo").alias("distance"))


# --------------------------------------------------------------------------------------------- error model, injection


def _error_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, t, word, mech, typo): each word of letters of the conversation turns, annotated; mech is null where it is no error."""
    t = table(spark, sf_dir, "conversations").select(F.concat(F.lit("u"), F.col("conv_id") % 10).alias("user_id"), F.concat_ws(":", "conv_id", "turn").alias("ref"), F.explode(F.array(F.regexp_extract_all("text", F.lit("[A-Za-z']+"), F.lit(0)))).alias("words"))
    tokens = annotated_tokens(t.filter("size(words) > 0").select("user_id", "ref", parse(F.col("words")).alias("tokens")), "user_id", "ref").filter(F.col("t.text").rlike("^[A-Za-z]+$"))
    rows = corrupted(tokens.withColumn("word", F.col("t.text"))).withColumn("found", classify(F.col("typo"), F.col("word")))
    mech = F.when(F.col("found") != "semantic_substitution", F.col("found"))
    return rows.select("user_id", "t", "word", mech.alias("mech"), "typo")


def signed_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, level, sig, word, mech, typo): each word at all seven levels."""
    return _error_words(spark, sf_dir).select("user_id", "word", "mech", "typo", F.explode(signatures(F.col("t"))).alias("s")).select("user_id", "s.level", "s.sig", "word", "mech", "typo")


def signed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, level, sig, mech, n): the same, counted."""
    return signature_counts(_error_words(spark, sf_dir), "user_id", "mech").select("user_id", "level", "sig", "mech", "n")


_LETTERS = "(" + ", ".join(f"'{m}'" for m in MECHANISMS) + ")"
SIGNED_SQL = f"""turns AS (SELECT 'u' || (conv_id % 10)::VARCHAR AS user_id, conv_id::VARCHAR || ':' || turn::VARCHAR AS ref, regexp_extract_all(text, '[A-Za-z'']+') AS ws FROM conversations WHERE len(regexp_extract_all(text, '[A-Za-z'']+')) > 0),
{parse_sql("turns", "ws", "pt")}, {annotated_sql("pt", "ref", "ws", "user_id", "m")},
c0 AS (SELECT *, text AS word, ref || '|' || text AS seed, {_MECHANISM_SQL} FROM xm_ WHERE regexp_full_match(text, '[A-Za-z]+')), {corrupted_sql("c0", "ce")}, {classified_sql("ce", "cc")},
signed AS MATERIALIZED (SELECT user_id, word, nullif(found, 'semantic_substitution') AS mech, typo, {LEVELS_SQL} FROM cc),
model AS (SELECT user_id, level, sig, count(*) AS total, count(mech) AS errors, count(*) FILTER (mech IN {_LETTERS}) AS char_level, (count(mech) + 0.1) / (count(*) + 0.2) AS rate, (count(*) FILTER (mech IN {_LETTERS}) + 0.1) / (count(*) + 0.2) AS char_rate FROM signed GROUP BY ALL),
totals AS (SELECT user_id, sum(total)::BIGINT AS n_tokens, sum(errors)::BIGINT AS n_edits, sum(char_level)::BIGINT AS n_char, sum(errors) / sum(total) AS p_err, sum(char_level) / sum(total) AS p_char FROM model GROUP BY user_id)"""


@register("user_error_model", f"WITH RECURSIVE {SIGNED_SQL} SELECT user_id, level::INTEGER AS level, sig, total, errors, char_level, errors - char_level AS surface, round(rate, 6) AS rate, round(char_rate, 6) AS char_rate FROM model")
def user_error_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Smoothed error rates by user and context, all seven levels."""
    m = error_model(signed_counts(spark, sf_dir))
    return m.select("user_id", "level", "sig", "total", "errors", "char_level", "surface", F.round("rate", 6).alias("rate"), F.round("char_rate", 6).alias("char_rate"))


@register("mechanism_histogram", f"WITH RECURSIVE {SIGNED_SQL} SELECT user_id, level::INTEGER AS level, sig, mech, count(*) AS n FROM signed WHERE mech IS NOT NULL GROUP BY ALL")
def mechanism_histogram_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often a user makes each kind of error in each context."""
    return mechanism_histogram(signed_counts(spark, sf_dir))


@register("user_error_totals", f"WITH RECURSIVE {SIGNED_SQL} SELECT user_id, n_tokens, n_edits, n_char, round(p_err, 6) AS p_err, round(p_char, 6) AS p_char FROM totals")
def user_error_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error totals of every user over all levels."""
    return user_totals(error_model(signed_counts(spark, sf_dir))).select("user_id", "n_tokens", "n_edits", "n_char", F.round("p_err", 6).alias("p_err"), F.round("p_char", 6).alias("p_char"))


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, user_id, position, word, sigs) of every word of the benchmark passages."""
    b = table(spark, sf_dir, "benchmark").select("item_id", F.concat(F.lit("u"), F.col("item_id") % 10).alias("user_id"), F.explode(located(F.col("text"), parse)).alias("w"))
    return b.select("item_id", "user_id", "w.position", "w.word", "w.sigs")


_ASK_SQL = f"""asks AS (SELECT item_id, 'u' || (item_id % 10)::VARCHAR AS user_id, regexp_extract_all(text, '[A-Za-z]+') AS ws FROM benchmark), {parse_sql("asks", "ws", "pq")}, {annotated_sql("pq", "item_id", "ws", "user_id", "q")}"""


@register("hierarchical_rates", f"""WITH RECURSIVE {SIGNED_SQL}, {_ASK_SQL}, lv AS (SELECT item_id, i, user_id, {LEVELS_SQL} FROM xq_),
hit AS (SELECT item_id, i, min(lv.level) AS level, arg_min(char_rate, lv.level) AS char_rate, arg_min(rate, lv.level) AS rate FROM lv JOIN model m ON m.user_id = lv.user_id AND m.level = lv.level AND m.sig = lv.sig GROUP BY ALL)
SELECT q.item_id, (q.i - 1)::INTEGER AS position, q.text AS word, coalesce(h.level, -1)::INTEGER AS level, round(coalesce(h.rate, nullif(p_err, 0), 0.02), 6) AS rate, round(coalesce(h.char_rate, p_char, 0), 6) AS char_rate
FROM xq_ q LEFT JOIN hit h USING (item_id, i) LEFT JOIN totals USING (user_id)""")
def hierarchical_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each query word, its user's rates at the finest context known; else the user's own, else 0.02 and 0."""
    model = error_model(signed_counts(spark, sf_dir))
    asked, keys = _asked(spark, sf_dir), ["item_id", "position"]
    every = hierarchical_rate(asked.select(*keys, "user_id", "sigs"), model, keys)
    letters = hierarchical_rate(asked.select(*keys, "user_id", "sigs"), model, keys, "char_rate").select(*keys, F.col("rate").alias("char_rate"))
    out = asked.join(every, keys, "left").join(letters, keys, "left").join(user_totals(model), "user_id", "left")
    rate = F.coalesce("rate", F.when(F.col("p_err") > 0, F.col("p_err")), F.lit(0.02))
    return out.select(*keys, "word", F.coalesce("level", F.lit(-1)).alias("level"), F.round(rate, 6).alias("rate"), F.round(F.coalesce("char_rate", "p_char", F.lit(0.0)), 6).alias("char_rate"))


_HISTORY_SQL = f"""history AS MATERIALIZED (SELECT user_id, lower(word) AS word, level, sig, typo, mech, count(*) AS n FROM signed WHERE mech IN {_LETTERS} AND level IN (0, 2, 6) AND typo <> '' GROUP BY ALL)"""


def _form_sql(x: str, key: str) -> str:
    """The best history form of the words of `x`."""
    tier = "CASE WHEN level = 0 AND sig = s0 THEN 0 WHEN level = 2 AND sig = s2 THEN 1 WHEN level = 6 AND sig = s6 THEN 2 ELSE 3 END"
    return f"""SELECT {key}, typo, mech, (['full', 'd3', 'coarse', 'any'])[{tier} + 1] AS tier FROM {x} JOIN history h ON h.user_id = {x}.user_id AND h.word = lower({x}.text) QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY {tier}, n DESC, typo, mech) = 1"""


@register("typo_forms", f"WITH RECURSIVE {SIGNED_SQL}, {_HISTORY_SQL}, {_ASK_SQL}, f AS ({_form_sql('xq_', 'item_id, i')}) SELECT item_id, (i - 1)::INTEGER AS position, typo, mech, 'user_historical_' || tier AS source FROM f")
def typo_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How a user misspelt a query word before, by the finest context known."""
    return history_form(_asked(spark, sf_dir), typo_history(signed_words(spark, sf_dir)), ["item_id", "position"])


def _pass_sql(k: int) -> str:
    """State k + 1 of the chain from state k."""
    weight = "list_sum(w)"
    return f"""a{k} AS (SELECT query_id, user_id, noisy, used, log, regexp_extract_all(noisy, '[A-Za-z]+') AS ws, string_split_regex(noisy, '[A-Za-z]+') AS gaps FROM st{k}), {parse_sql(f"a{k}", "ws", f"pa{k}")},
{annotated_sql(f"pa{k}", "query_id", "ws", "user_id, noisy, used, log, ws, gaps", str(k))},
lv{k} AS (SELECT query_id, i, user_id, {LEVELS_SQL} FROM x{k}_), hit{k} AS (SELECT query_id, i, arg_min(char_rate, l.level) AS rate FROM lv{k} l JOIN model m ON m.user_id = l.user_id AND m.level = l.level AND m.sig = l.sig GROUP BY ALL),
b{k} AS MATERIALIZED (SELECT x.*, text AS word, x.user_id || '|' || query_id::VARCHAR || '|{k}|' || text AS seed, coalesce(uw.w, gw.w) AS w FROM x{k}_ x LEFT JOIN hit{k} USING (query_id, i) LEFT JOIN totals t ON t.user_id = x.user_id LEFT JOIN weights uw ON uw.user_id = x.user_id CROSS JOIN general g CROSS JOIN gweights gw
  WHERE length(text) >= 3 AND NOT list_contains(used, i - 1) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(coalesce(rate, t.p_char, g.p_char, 0), 12) DESC, i) = 1),
f{k} AS ({_form_sql(f"b{k}", "query_id")}),
d{k} AS (SELECT b.* EXCLUDE (w), f.typo AS known, tier, coalesce(mech, CASE WHEN {weight} > 0 THEN ({_list(list(MECHANISMS))})[list_filter(range(1, 8), lambda j: list_sum(w[1:j]) > {_pick_sql("seed || '!'", weight)})[1]] END) AS mechanism FROM b{k} b LEFT JOIN f{k} f USING (query_id)),
{corrupted_sql(f"d{k}", f"y{k}")},
z{k} AS (SELECT query_id, i, word, mechanism, coalesce('user_historical_' || tier, 'generic_fallback') AS source, coalesce(known, typo) AS typo, coalesce(list_sum(list_transform(gaps[1:i], lambda q: length(q))), 0) + coalesce(list_sum(list_transform(ws[1:i - 1], lambda q: length(q))), 0) AS st FROM y{k}),
ok{k} AS (SELECT * FROM z{k} WHERE typo <> '' AND typo <> word AND levenshtein(lower(word), lower(typo)) <= 5 AND abs(length(word) - length(typo)) <= 3),
st{k + 1} AS MATERIALIZED (SELECT s.query_id, s.user_id, CASE WHEN o.i IS NULL THEN noisy ELSE substr(noisy, 1, st::BIGINT) || typo || substr(noisy, st::BIGINT + length(word) + 1) END AS noisy, CASE WHEN o.i IS NULL THEN used ELSE list_append(used, o.i - 1) END AS used,
  CASE WHEN o.i IS NULL THEN log ELSE list_append(log, len(log)::VARCHAR || ':' || (o.i - 1)::VARCHAR || ':' || word || '>' || typo || ':' || mechanism || ':' || source) END AS log FROM st{k} s LEFT JOIN ok{k} o USING (query_id))"""


_INJECT_SQL = f"""{SIGNED_SQL}, {_HISTORY_SQL},
weights AS (SELECT user_id, [{", ".join(f"count(*) FILTER (mech = '{m}')" for m in MECHANISMS)}] AS w FROM signed WHERE mech IS NOT NULL GROUP BY user_id),
gweights AS (SELECT [{", ".join(f"count(*) FILTER (mech = '{m}')" for m in MECHANISMS)}] AS w FROM signed), general AS (SELECT count(*) FILTER (mech IN {_LETTERS}) / count(*) AS p_char FROM signed),
st0 AS (SELECT item_id AS query_id, 'u' || (item_id % 10)::VARCHAR AS user_id, text AS noisy, []::BIGINT[] AS used, []::VARCHAR[] AS log FROM benchmark), {_pass_sql(0)}, {_pass_sql(1)}, {_pass_sql(2)}"""


def _injected(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.concat(F.lit("u"), F.col("item_id") % 10).alias("user_id"), F.col("text").alias("query"))
    return inject_chain(q, signed_words(spark, sf_dir), parse)


@register("inject_typos", f"WITH RECURSIVE {_INJECT_SQL} SELECT query_id, user_id, noisy, array_to_string(log, ' ') AS edits FROM st3")
def inject_typos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to three misspellings chained into each query, at its user's likeliest words, in the user's way."""
    told = F.transform("edits", lambda e: F.concat(e["index"], F.lit(":"), e["position"], F.lit(":"), e["original"], F.lit(">"), e["typo"], F.lit(":"), e["mechanism"], F.lit(":"), e["source"]))
    return _injected(spark, sf_dir).select("query_id", "user_id", "noisy", F.array_join(told, " ").alias("edits"))


@register("edit_replay", f"WITH RECURSIVE {_INJECT_SQL} SELECT query_id, len(log)::INTEGER AS n_edits, true AS replayed, list_sort(used)[1]::INTEGER AS first_position FROM st3")
def edit_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replays every edit chain; `replayed` is true where it leads from the clean to the noisy query, which the SQL expects of all."""
    made = _injected(spark, sf_dir)
    return made.select("query_id", F.size("edits").alias("n_edits"), F.coalesce(replay(F.col("query"), F.col("edits")) == F.col("noisy"), F.lit(False)).alias("replayed"), F.array_min(F.transform("edits", lambda e: e["position"])).alias("first_position"))


@register("injection_summary", f"""WITH RECURSIVE {_INJECT_SQL}, e AS (SELECT user_id, query_id, len(log) AS n, unnest(CASE WHEN len(log) = 0 THEN [NULL] ELSE log END) AS l FROM st3)
SELECT user_id, count(DISTINCT query_id) AS n_queries, count(DISTINCT query_id) FILTER (n > 0) AS n_injected, count(l) AS n_edits, round(count(l) / count(DISTINCT query_id), 6) AS edits_mean, count(*) FILTER (contains(l, 'user_historical')) AS n_historical, count(*) FILTER (contains(l, 'generic_fallback')) AS n_generic FROM e GROUP BY ROLLUP (user_id)""")
def injection_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was injected, by user and in all (user_id null)."""
    made = _injected(spark, sf_dir).select("user_id", F.size("edits").alias("n"), F.size(F.filter("edits", lambda e: e["source"] != "generic_fallback")).alias("h"))
    out = made.rollup("user_id").agg(F.count("*").alias("n_queries"), F.count_if(F.col("n") > 0).alias("n_injected"), F.sum("n").alias("n_edits"), F.round(F.sum("n") / F.count("*"), 6).alias("edits_mean"), F.sum("h").alias("n_historical"))
    return out.select("user_id", "n_queries", "n_injected", "n_edits", "edits_mean", "n_historical", (F.col("n_edits") - F.col("n_historical")).alias("n_generic"))
