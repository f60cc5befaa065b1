"""Expressions over words and their misspellings: classification, generation, edits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumeline.functions.scoped import let

# What keyboards and English offer for mistakes.
APOSTROPHES = (
    ("dont", "don't"), ("wont", "won't"), ("cant", "can't"), ("isnt", "isn't"), ("wasnt", "wasn't"), ("wouldnt", "wouldn't"), ("shouldnt", "shouldn't"), ("couldnt", "couldn't"), ("didnt", "didn't"), ("doesnt", "doesn't"),
    ("havent", "haven't"), ("hasnt", "hasn't"), ("ill", "i'll"), ("ive", "i've"), ("id", "i'd"), ("youre", "you're"), ("theyre", "they're"), ("were", "we're"), ("hes", "he's"), ("shes", "she's"),
)
NEAR_KEYS = {
    "q": "wased", "w": "qeasd", "e": "wrdsd", "r": "etfd", "t": "ryfg", "y": "tugh", "u": "yijh", "i": "uokj", "o": "iplk", "p": "ol", "a": "sqwz", "s": "awedxz", "d": "serfcx", "f": "drtgvc", "g": "ftyhbv", "h": "gyujnb",
    "j": "huikmn", "k": "jiolm", "l": "kop", "z": "asx", "x": "zsdc", "c": "xdfv", "v": "cfgb", "b": "vghn", "n": "bhjm", "m": "njk",
}
OTHER_LAYOUT = {
    "w": ",", "e": ".", "r": "p", "t": "y", "y": "f", "u": "g", "i": "c", "o": "r", "p": "l", "a": "a", "s": "o", "d": "e", "f": "u", "g": "i", "h": "d", "j": "h", "k": "t", "l": "n", "x": "q", "c": "j", "v": "k", "b": "x", "n": "b", "m": "m",
}
HOMOPHONES = {
    "their": ("there", "theyre"), "there": ("their", "theyre"), "theyre": ("their", "there"), "to": ("too", "two"), "too": ("to", "two"), "two": ("to", "too"), "your": ("youre",), "youre": ("your",), "hear": ("here",), "here": ("hear",),
    "write": ("right", "rite"), "right": ("write", "rite"), "rite": ("write", "right"), "new": ("knew",), "knew": ("new",), "no": ("know",), "know": ("no",), "one": ("won",), "won": ("one",), "be": ("bee",), "bee": ("be",), "by": ("buy", "bye"),
    "buy": ("by", "bye"), "bye": ("by", "buy"), "brake": ("break",), "break": ("brake",), "wait": ("weight",), "weight": ("wait",), "week": ("weak",), "weak": ("week",), "hole": ("whole",), "whole": ("hole",), "peace": ("piece",), "piece": ("peace",),
    "meet": ("meat",), "meat": ("meet",), "male": ("mail",), "mail": ("male",), "sale": ("sail",), "sail": ("sale",), "allowed": ("aloud",), "aloud": ("allowed",), "flower": ("flour",), "flour": ("flower",), "for": ("four",), "four": ("for",),
    "which": ("witch",), "witch": ("which",), "road": ("rode",), "rode": ("road",), "sun": ("son",), "son": ("sun",), "some": ("sum",), "sum": ("some",), "bare": ("bear",), "bear": ("bare",), "dear": ("deer",), "deer": ("dear",), "fair": ("fare",),
    "fare": ("fair",), "great": ("grate",), "grate": ("great",), "heal": ("heel",), "heel": ("heal",), "main": ("mane",), "mane": ("main",), "plain": ("plane",), "plane": ("plain",), "scene": ("seen",), "seen": ("scene",), "stair": ("stare",),
    "stare": ("stair",), "steal": ("steel",), "steel": ("steal",), "tail": ("tale",), "tale": ("tail",),
}

MECHANISMS = ("letter_deletion", "letter_insertion", "letter_repetition", "letter_swap", "keyboard_adjacent", "keyboard_layout", "homophone_substitution")


def _lookup(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def _same_length(v: Column) -> Column:
    """Words of one length: another layout's key, a near key, two letters swapped, or neither."""
    pairs = F.zip_with(F.split(v["a"], ""), F.split(v["b"], ""), lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    apart = F.filter(F.transform(pairs, lambda p, i: F.struct(i.alias("i"), p["x"].alias("x"), p["y"].alias("y"))), lambda p: p["x"] != p["y"])

    def judge(d: Column) -> Column:
        one, two, near = d["apart"][0], F.get(d["apart"], F.lit(1)), _lookup(NEAR_KEYS)
        other_key = F.try_element_at(_lookup(OTHER_LAYOUT), one["x"]) == one["y"]
        touching = F.contains(F.try_element_at(near, one["x"]), one["y"]) & F.contains(F.try_element_at(near, one["y"]), one["x"])
        swapped = (two["i"] == one["i"] + 1) & (one["x"] == two["y"]) & (one["y"] == two["x"])
        single = F.when(F.coalesce(other_key, F.lit(False)), "keyboard_layout").when(F.coalesce(touching, F.lit(False)), "keyboard_adjacent").otherwise("semantic_substitution")
        return F.when(F.size(d["apart"]) == 1, single).when((F.size(d["apart"]) == 2) & swapped, "letter_swap").otherwise("semantic_substitution")

    return let(judge, apart=apart)


def _one_apart(v: Column) -> Column:
    """Lengths that differ by one: a letter left out, doubled or put in, or neither."""
    more = v["n"] > v["m"]

    def split(w: Column) -> Column:
        places = F.sequence(F.lit(1), F.length(w["short"]))
        differs = F.filter(places, lambda i: F.substring(w["short"], i, F.lit(1)) != F.substring(w["long"], i, F.lit(1)))
        return let(lambda x: judge(w, x["at"]), at=F.coalesce(F.try_element_at(differs, F.lit(1)), F.length(w["short"]) + 1))

    def judge(w: Column, at: Column) -> Column:
        letter = F.substring(w["long"], at, F.lit(1))
        without = F.concat(F.substring(w["long"], F.lit(1), at - 1), F.substring(w["long"], at + 1, F.length(w["long"])))
        beside = ((at > 1) & (letter == F.substring(w["long"], at - 1, F.lit(1)))) | (letter == F.substring(w["long"], at + 1, F.lit(1)))
        return F.when(without != w["short"], "semantic_substitution").when(~w["more"], "letter_deletion").when(beside, "letter_repetition").otherwise("letter_insertion")

    return let(split, more=more, long=F.when(more, v["a"]).otherwise(v["b"]), short=F.when(more, v["b"]).otherwise(v["a"]))


def classify(incorrect: Column, corrected: Column) -> Column:
    """How `incorrect` came from `corrected`, one of ten names; semantic_substitution where nothing else fits."""
    known = F.array(*[F.lit(f"{x} {y}") for x, y in APOSTROPHES])
    sounds = F.array(*[F.lit(f"{x} {y}") for x, ys in HOMOPHONES.items() for y in ys])

    def judge(v: Column) -> Column:
        both = F.concat_ws(" ", v["a"], v["b"])
        marks = F.array_contains(known, both) | (F.replace(v["a"], F.lit("'"), F.lit("")) == F.replace(v["b"], F.lit("'"), F.lit("")))
        return (
            F.when((F.coalesce(v["n"], F.lit(0)) == 0) | (F.coalesce(v["m"], F.lit(0)) == 0), "semantic_substitution").when(v["a"] == v["b"], "case_error").when(marks, "apostrophe_error")
            .when(F.array_contains(sounds, both), "homophone_substitution").when(v["n"] == v["m"], _same_length(v)).when(F.abs(v["n"] - v["m"]) == 1, _one_apart(v)).otherwise("semantic_substitution")
        )

    return let(judge, a=F.lower(incorrect), b=F.lower(corrected), n=F.length(incorrect), m=F.length(corrected))


def pick(seed: Column, n: Column) -> Column:
    """A place from 0 to n - 1 by the last seven hexadecimal digits of the seed's SHA-1."""
    return F.pmod(F.conv(F.right(F.sha1(F.encode(seed, "UTF-8")), F.lit(7)), 16, 10).cast("bigint"), F.greatest(n, F.lit(1))).cast("int")


def corrupt(word: Column, mechanism: Column, seed: Column) -> Column:
    """A misspelling of a lower- or mixed-case word; the word itself where the mechanism finds no place."""
    spare = {k: v for k, v in OTHER_LAYOUT.items() if v.isalpha()}

    def placed(v: Column) -> Column:
        c = F.substring(v["w"], v["i"], F.lit(1))
        values = {"w": v["w"], "n": v["n"], "i": v["i"], "how": v["how"], "seed": v["seed"], "c": c, "lower": F.lower(c), "before": F.substring(v["w"], F.lit(1), v["i"] - 1), "after": F.substring(v["w"], v["i"] + 1, v["n"])}
        return let(keyed, **values)

    def keyed(v: Column) -> Column:
        keys = F.coalesce(F.try_element_at(_lookup(NEAR_KEYS), v["lower"]), F.lit(""))
        return let(made, v=v, keys=keys, moved=F.try_element_at(_lookup(spare), v["lower"]), sound=F.try_element_at(_lookup({k: x[0] for k, x in HOMOPHONES.items()}), F.lower(v["w"])), j=F.least(v["i"], F.greatest(v["n"] - 1, F.lit(1))))

    def made(u: Column) -> Column:
        v, how = u["v"], u["v"]["how"]
        w, n, j, before, after, c = v["w"], v["n"], u["j"], v["before"], v["after"], v["c"]

        def cased(x: Column) -> Column:
            return F.when(c != v["lower"], F.upper(x)).otherwise(x)

        key = F.substring(u["keys"], pick(F.concat(v["seed"], F.lit("#")), F.length(u["keys"])) + 1, F.lit(1))
        inserted = F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), pick(F.concat(v["seed"], F.lit("+")), F.lit(26)) + 1, F.lit(1))
        swapped = F.concat(F.substring(w, F.lit(1), j - 1), F.substring(w, j + 1, F.lit(1)), F.substring(w, j, F.lit(1)), F.substring(w, j + 2, n))
        return (
            F.when(how == "letter_deletion", F.concat(before, after)).when(how == "letter_repetition", F.concat(before, c, c, after)).when(how == "letter_insertion", F.concat(before, inserted, c, after)).when(how == "letter_swap", swapped)
            .when((how == "keyboard_adjacent") & (u["keys"] != ""), F.concat(before, cased(key), after)).when((how == "keyboard_layout") & u["moved"].isNotNull(), F.concat(before, cased(u["moved"]), after))
            .when((how == "homophone_substitution") & u["sound"].isNotNull(), u["sound"]).otherwise(w)
        )

    return let(placed, w=word, n=F.length(word), i=pick(seed, F.length(word)) + 1, how=mechanism, seed=seed)


def minimal(original: Column, typo: Column) -> Column:
    """Three letters or more, changed, at most five edits away and three characters longer or shorter."""
    return (F.length(original) >= 3) & (typo != "") & (original != typo) & (F.levenshtein(F.lower(original), F.lower(typo)) <= 5) & (F.abs(F.length(original) - F.length(typo)) <= 3)


def apply_edit(text: Column, start: Column, end: Column, original: Column, typo: Column) -> Column:
    """The text with characters start to end - 1 (from 0) replaced; null if they are not `original` or nothing changes."""
    fits = (F.substring(text, start + 1, end - start) == original) & (typo != "") & (typo != original)
    return F.when(fits, F.concat(F.substring(text, F.lit(1), start), typo, F.substring(text, end + 1, F.length(text))))
