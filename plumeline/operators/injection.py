"""Misspellings chained into queries by a user's error model, and their replay."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumeline.functions.noise import MECHANISMS, apply_edit, corrupt, minimal, pick
from plumeline.functions.running import sums_before
from plumeline.functions.scoped import let
from plumeline.operators.profiles import error_model, hierarchical_rate, history_form, mechanism_histogram, mechanism_weights, typo_history, user_totals
from plumeline.operators.rules import annotated, signatures
from plumeline.sources.staged import stage, unstage

EDITS = "array<struct<index:int,position:int,start:int,end:int,original:string,typo:string,mechanism:string,source:string,before:string,after:string>>"


def _words(query: Column) -> Column:
    """array<struct<position,start,word>> of words of letters; places come from what is left between them."""
    words, gaps = F.regexp_extract_all(query, F.lit("[A-Za-z]+"), F.lit(0)), F.split(query, "[A-Za-z]+", -1)
    rows = F.arrays_zip(F.slice(gaps, 1, F.size(words)).alias("gap"), words.alias("word"))

    def placed(v: Column) -> Column:
        return F.transform(v["rows"], lambda x, i: F.struct(i.alias("position"), (F.get(v["at"], i).cast("int") + F.length(x["gap"])).alias("start"), x["word"].alias("word")))

    return let(lambda r: let(placed, rows=r["rows"], at=sums_before(F.transform(r["rows"], lambda x: F.length(x["gap"]) + F.length(x["word"])))), rows=rows)


def located(query: Column, parse: Callable[[Column], Column]) -> Column:
    """Annotated tokens of a query's words with `start`; `position` counts words."""
    words = F.transform(_words(query), lambda w: w["word"])
    return F.zip_with(_words(query), annotated(parse(words)), lambda w, t: F.struct(w["position"].alias("position"), w["start"].alias("start"), w["word"].alias("word"), F.transform(signatures(t), lambda s: s["sig"]).alias("sigs")))


def weighted_mechanism(weights: Column, seed: Column) -> Column:
    """A mechanism drawn by its weight, in the order of MECHANISMS; null where all weights are 0."""
    total = F.aggregate(weights, F.lit(0).cast("bigint"), lambda a, w: a + w)
    start = F.struct(pick(seed, total).cast("bigint").alias("left"), F.lit(None).cast("int").alias("at"), F.lit(0).alias("i"))
    step = lambda a, w: F.struct((a["left"] - w).alias("left"), F.coalesce(a["at"], F.when(a["left"] < w, a["i"])).alias("at"), (a["i"] + 1).alias("i"))
    return F.when(total > 0, F.array(*map(F.lit, MECHANISMS))[F.aggregate(weights, start, step, lambda a: a["at"])])


def inject_chain(queries: DataFrame, signed: DataFrame, parse: Callable[[Column], Column], chain: int = 3) -> DataFrame:
    """(query_id, user_id, query) -> query, noisy and the edits, at most `chain` of them.

    `signed` holds the users' words by context level (user_id, level, sig, word, mech, typo). Each pass takes the words
    anew and rates them by the finest context in which the user's letter errors are known (else by the user's, else by
    everybody's rate); the likeliest word, then the first, of three letters or more and not at a place used before is
    misspelt: as the user misspelt it before, if they did, else by a mechanism drawn by their (else everybody's) totals.
    A pass without a usable word, or whose misspelling is not minimal, changes nothing.
    """
    signed = stage(signed, "signed")
    model, history = stage(error_model(signed), "error-model"), stage(typo_history(signed), "typo-history")
    users = stage(user_totals(model).join(mechanism_weights(mechanism_histogram(signed)), "user_id", "left").select("user_id", "n_tokens", "n_char", "p_char", "weights"), "users")
    everyone = users.agg((F.sum("n_char") / F.sum("n_tokens")).alias("_p"), F.array(*[F.coalesce(F.sum(F.col("weights")[k]), F.lit(0)) for k in range(len(MECHANISMS))]).alias("_w"))  # one row
    users = users.select("user_id", "p_char", "weights")
    unstage(signed)
    state = queries.select("query_id", "user_id", "query", F.col("query").alias("noisy"), F.array().cast(EDITS).alias("edits"))
    for index in range(chain):
        words = state.select("query_id", "user_id", "noisy", "edits", F.explode(located(F.col("noisy"), parse)).alias("w")).select("query_id", "user_id", "noisy", "edits", "w.*")
        words = words.filter((F.length("word") >= 3) & ~F.exists("edits", lambda e: e["position"] == F.col("position")))
        rated = hierarchical_rate(words.select("query_id", "position", "user_id", "sigs"), model, ["query_id", "position"], "char_rate")
        rated = words.join(rated.select("query_id", "position", F.col("rate").alias("_rate")), ["query_id", "position"]).join(users, "user_id", "left").crossJoin(F.broadcast(everyone))
        order = Window.partitionBy("query_id").orderBy(F.round(F.coalesce("_rate", "p_char", "_p", F.lit(0.0)), 12).desc(), "position")
        best = stage(rated.withColumn("_r", F.row_number().over(order)).filter("_r = 1"), "likeliest")
        known = history_form(best.select("query_id", "user_id", "word", "sigs"), history, ["query_id"])
        seed = F.concat_ws("|", "user_id", "query_id", F.lit(index), "word")
        drawn = weighted_mechanism(F.coalesce("weights", "_w"), F.concat(seed, F.lit("!")))
        best = best.join(known, "query_id", "left").withColumn("mechanism", F.coalesce("mech", drawn)).withColumn("source", F.coalesce("source", F.lit("generic_fallback")))
        best = best.withColumn("typo", F.coalesce("typo", corrupt(F.col("word"), F.col("mechanism"), seed))).filter(minimal(F.col("word"), F.col("typo")))
        end = F.col("start") + F.length("word")
        made = best.withColumn("after", apply_edit(F.col("noisy"), F.col("start"), end, F.col("word"), F.col("typo"))).filter("after is not null")
        edit = F.struct(F.size("edits").alias("index"), "position", "start", end.alias("end"), F.col("word").alias("original"), "typo", "mechanism", "source", F.col("noisy").alias("before"), "after")
        made = made.select("query_id", F.col("after").alias("_after"), F.array(edit).cast(EDITS).alias("_edit"))
        state = state.join(made, "query_id", "left").select("query_id", "user_id", "query", F.coalesce("_after", "noisy").alias("noisy"), F.when(F.col("_edit").isNotNull(), F.concat("edits", "_edit")).otherwise(F.col("edits")).alias("edits"))
        state = stage(state, "state")
    return state


def replay(query: Column, edits: Column) -> Column:
    """The query after all edits; null if an edit does not fit what is there."""
    return F.aggregate(edits, query, lambda q, e: F.when(q == e["before"], apply_edit(q, e["start"], e["end"], e["original"], e["typo"])))
