"""Syntactic rules and signatures over parsed sentences: arrays of (i, text, pos, dep, head) with the root its own head."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumeline.functions.scoped import let

#: The relations that open a clause.
CLAUSE_DEPS = ("advcl", "acl", "relcl", "ccomp", "xcomp", "conj", "parataxis")
LEVELS = ("full", "d4", "d3", "clause", "depth", "sibling", "coarse")


def struct_rules(tokens: Column) -> Column:
    """Distinct D4 and D3 rules of every word but the root and P3 trigrams of classes; none under three words."""

    joined = lambda a, b: F.concat_ws("|", a, b)

    def upward(v: Column) -> Column:
        pos, dep, head = v["pos"], v["dep"], v["head"]
        up = F.transform(head, lambda h, i: F.when(h == i, "ROOT").otherwise(pos[h]))
        below = F.zip_with(F.transform(head, lambda h: pos[h]), F.zip_with(dep, pos, joined), joined)
        return let(named, pos=pos, head=head, up=up, below=below)

    def named(v: Column) -> Column:
        pos, head, n = v["pos"], v["head"], F.size(v["pos"]) - 2
        kept = lambda rules: F.filter(rules, lambda _, i: head[i] != i)
        d4 = kept(F.zip_with(F.transform(head, lambda h: v["up"][h]), v["below"], lambda g, x: F.concat_ws("|", F.lit("D4"), g, x)))
        d3 = kept(F.transform(v["below"], lambda x: F.concat(F.lit("D3|"), x)))
        p3 = F.zip_with(F.zip_with(F.slice(pos, F.lit(1), n), F.slice(pos, F.lit(2), n), joined), F.slice(pos, F.lit(3), n), lambda a, c: F.concat_ws("|", F.lit("P3"), a, c))
        return F.array_distinct(F.concat(d4, d3, p3))

    few = F.array().cast("array<string>")
    return let(lambda t: F.when(F.size(t["t"]) >= 3, let(upward, **{c: F.transform(t["t"], lambda x: x[c]) for c in ("pos", "dep", "head")})).otherwise(few), t=tokens)  # noqa: B023


def annotated(tokens: Column) -> Column:
    """The tokens with parent, grand(parent), clause, depth and their siblings' classes, array<struct>.

    clause is the nearest ancestor relation that opens a clause, in capitals, PREP for a preposition, ROOT for none; depth
    d0 to d2 or d3+; left and right the class of the nearest word on that side with the same head, or NONE. All of a
    sentence's words are done at once, ancestors by doubling, siblings by sorting: n log n steps, so a junk sentence of
    many thousand words is no worse than as many short ones.
    """

    def upward(v: Column) -> Column:
        pos, dep, head, n = v["pos"], v["dep"], v["head"], F.size(v["pos"])
        opened = lambda d: F.when(d.isin(*CLAUSE_DEPS), F.upper(d)).when(d == "prep", F.lit("PREP")).otherwise(F.lit(""))
        marks = F.transform(head, lambda h, i: F.when(h == i, F.lit("")).otherwise(opened(dep[h])))
        start = F.struct(marks.alias("mark"), head.alias("up"))
        twice = lambda a, _: F.struct(F.transform(a["mark"], lambda m, i: F.when(m != "", m).otherwise(a["mark"][a["up"][i]])).alias("mark"), F.transform(a["up"], lambda u: a["up"][u]).alias("up"))
        clause = F.aggregate(F.sequence(F.lit(1), F.ceil(F.log2(n + 1)).cast("int")), start, twice, lambda a: a["mark"])
        parent = F.transform(head, lambda h, i: F.when(h == i, "ROOT").otherwise(pos[h]))
        grand = F.transform(head, lambda h, i: F.when((h == i) | (head[h] == h), "ROOT").otherwise(pos[head[h]]))
        depth = F.transform(head, lambda h, i: F.when(h == i, "d0").when(head[h] == h, "d1").when(head[head[h]] == head[h], "d2").otherwise("d3+"))
        line = F.array_sort(F.transform(head, lambda h, i: F.struct(F.when(h == i, F.lit(-1)).otherwise(h).alias("h"), i.alias("i"), pos[i].alias("pos"))))
        return let(sideways, clause=clause, parent=parent, grand=grand, depth=depth, line=line)

    def sideways(v: Column) -> Column:
        line = v["line"]
        beside = lambda o, k, by: F.when((o["h"] >= 0) & (F.get(line, k + by)["h"] == o["h"]), F.get(line, k + by)["pos"])
        placed = F.transform(line, lambda o, k: F.struct(o["i"].alias("i"), F.coalesce(beside(o, k, -1), F.lit("NONE")).alias("left"), F.coalesce(beside(o, k, 1), F.lit("NONE")).alias("right")))
        columns = {c: v[c] for c in ("clause", "parent", "grand", "depth")}
        return let(joined, sides=F.array_sort(placed), **columns)

    def joined(v: Column) -> Column:
        return F.transform(v["sides"], lambda s, i: F.struct(*[v[c][i].alias(c) for c in ("parent", "grand", "depth")], F.when(v["clause"][i] == "", "ROOT").otherwise(v["clause"][i]).alias("clause"), s["left"].alias("left"), s["right"].alias("right")))

    def whole(t: Column) -> Column:
        more = let(upward, **{c: F.transform(t["t"], lambda x: x[c]) for c in ("pos", "dep", "head")})  # noqa: B023
        return F.zip_with(t["t"], more, lambda x, m: F.struct(*[x[c].alias(c) for c in ("i", "text", "pos", "dep")], *[m[c].alias(c) for c in ("parent", "grand", "depth", "clause", "left", "right")]))

    return let(whole, t=tokens)


def signatures(t: Column) -> Column:
    """array<struct<level,name,sig>> of an annotated token with the seven levels, finest first."""
    pos, dep, parent, grand, clause, depth = (t[c] for c in ("pos", "dep", "parent", "grand", "clause", "depth"))
    found = {
        "full": F.concat_ws("|", pos, dep, parent, grand, clause, depth), "d4": F.concat_ws("|", F.lit("D4"), grand, parent, dep, pos), "d3": F.concat_ws("|", F.lit("D3"), parent, dep, pos), "clause": F.concat_ws("|", clause, pos),
        "depth": F.concat_ws("|", depth, pos, dep), "sibling": F.concat_ws("|", pos, t["left"], t["right"]), "coarse": F.concat_ws("|", pos, dep),
    }
    return F.array(*[F.struct(F.lit(i).alias("level"), F.lit(name).alias("name"), sig.alias("sig")) for i, (name, sig) in enumerate(found.items())])


#: Words that a Python task looks up at once: what it holds does not grow with the batches that it gets.
WORDS = 1 << 15


def _by_words(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most so many words, or of one sentence."""
    for batch in batches:
        ends = batch.column("head").offsets.to_numpy()
        lo = 0
        while lo < len(batch):
            hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + most, side="right")) - 1)
            yield batch.slice(lo, hi - lo)
            lo = hi


def _contexts(schema: pa.Schema, keys: tuple[str, ...]):
    """Sentences as lists -> a row for each token with its context; all tokens of a batch are looked up at once, as numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _by_words(batches, WORDS):
            heads = batch.column("head")
            ends = heads.offsets.to_numpy()
            ends = ends - ends[0]
            sizes = np.diff(ends)
            own = np.arange(ends[-1])
            head = heads.flatten().to_numpy().astype(np.int64) + np.repeat(ends[:-1], sizes)
            pos, dep = (batch.column(c).flatten().dictionary_encode() for c in ("pos", "dep"))
            names = pa.array([*pos.dictionary.to_pylist(), "ROOT", "NONE"], pa.string())
            root_name, none = len(names) - 2, len(names) - 1
            p, root = pos.indices.to_numpy().astype(np.int64), head == own
            up = head[head]
            parent, grand = np.where(root, root_name, p[head]), np.where(root | root[head], root_name, p[up])
            depth = np.where(root, 0, np.where(root[head], 1, np.where(root[up], 2, 3)))
            marks = [d.upper() if d in CLAUSE_DEPS else "PREP" if d == "prep" else "" for d in dep.dictionary.to_pylist()]
            clauses = ["ROOT", *sorted({m for m in marks if m})]
            opened = np.array([clauses.index(m) if m else 0 for m in marks], np.int64)
            mark, far = np.where(root, 0, opened[dep.indices.to_numpy()[head]]) if len(own) else own, head
            for _ in range(int(sizes.max(initial=0)).bit_length()):  # the nearest that opens a clause, by doubling
                mark, far = np.where(mark > 0, mark, mark[far]), far[far]
            left, right = np.full(len(own), none), np.full(len(own), none)
            line = np.lexsort((own, head))
            line = line[~root[line]]
            beside = head[line[1:]] == head[line[:-1]]
            left[line[1:][beside]], right[line[:-1][beside]] = p[line[:-1][beside]], p[line[1:][beside]]
            at = pa.array(np.repeat(np.arange(len(sizes)), sizes))
            found = {c: batch.column(c).take(at) for c in keys} | {"text": batch.column("text").flatten(), "i": pa.array(own - np.repeat(ends[:-1], sizes), pa.int32()), "pos": batch.column("pos").flatten(), "dep": batch.column("dep").flatten()}
            found |= {c: names.take(pa.array(x)) for c, x in (("parent", parent), ("grand", grand), ("left", left), ("right", right))}
            found |= {"clause": pa.array(clauses, pa.string()).take(pa.array(mark)), "depth": pa.array(["d0", "d1", "d2", "d3+"]).take(pa.array(depth))}
            yield pa.RecordBatch.from_arrays([found[f.name].cast(f.type) for f in schema], schema=schema)

    return run


#: Flags that stand in for a sort where distinct numbers are wanted.
FLAGS = 1 << 23


def _distinct(numbers: np.ndarray, most: int) -> np.ndarray:
    """The distinct ones of numbers from 0 to most - 1, rising."""
    if most > FLAGS:
        return np.unique(numbers)
    seen = np.zeros(most, bool)
    seen[numbers] = True
    return np.flatnonzero(seen)


def _sentence_rules(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(sentence, rule, the rules' texts, rising) with a pair for each distinct rule of a sentence, by sentence and then rule; rules are numbers until they are known to be distinct."""
    heads = batch.column("head")
    ends = heads.offsets.to_numpy()
    ends = ends - ends[0]
    sizes = np.diff(ends)
    sentence = np.repeat(np.arange(len(sizes)), sizes)
    own = np.arange(ends[-1])
    head = heads.flatten().to_numpy().astype(np.int64) + np.repeat(ends[:-1], sizes)
    pos, dep = (batch.column(c).flatten().dictionary_encode() for c in ("pos", "dep"))
    p, d = pos.indices.to_numpy().astype(np.int64), dep.indices.to_numpy().astype(np.int64)
    names, relations = [*pos.dictionary.to_pylist(), "ROOT"], dep.dictionary.to_pylist()
    n, m = len(names), max(1, len(relations))
    long = sizes[sentence] >= 3
    word = own[long & (head != own)]
    grand = np.where(head[head[word]] == head[word], n - 1, p[head[head[word]]])
    below = (p[head[word]] * m + d[word]) * n + p[word]
    first = own[(own + 2 < len(own)) & long]
    first = first[sentence[first + 2] == sentence[first]]
    three = (p[first] * n + p[first + 1]) * n + p[first + 2]
    most = n * n * n * m
    # kind, then the numbers of its parts; a sentence and a rule are one number
    rules = np.concatenate([grand * (most // n) + below, most + below, 2 * most + three])
    found = _distinct(rules, 3 * most)
    texts = []
    for r in found.tolist():
        kind, r = divmod(r, most)
        if kind == 2:
            texts.append(f"P3|{names[r // n // n]}|{names[r // n % n]}|{names[r % n]}")
        else:
            tail = f"{names[r // (n * m) % n]}|{relations[r // n % m]}|{names[r % n]}"
            texts.append(f"D3|{tail}" if kind else f"D4|{names[r // (most // n)]}|{tail}")
    # A class may be named ROOT, so that different numbers have one text.
    rising, place = np.unique(np.array(texts, object), return_inverse=True) if texts else (np.empty(0, object), np.empty(0, np.int64))
    width = max(1, len(rising))
    pairs = _distinct(np.concatenate([sentence[word], sentence[word], sentence[first]]).astype(np.int64) * width + place[np.searchsorted(found, rules)], max(1, len(sizes)) * width)
    return pairs // width, pairs % width, pa.array(rising.tolist(), pa.string())


def _ruled(schema: pa.Schema, keys: tuple[str, ...]):
    """Sentences as lists -> a row for each distinct rule."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _by_words(batches, WORDS):
            sentence, rule, texts = _sentence_rules(batch)
            at = pa.array(sentence)
            columns = [batch.column(c).take(at) for c in keys] + [texts.take(pa.array(rule))]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return run


def _listed(schema: pa.Schema, keys: tuple[str, ...]):
    """Sentences as lists -> a row for each sentence that has rules, with them all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _by_words(batches, WORDS):
            sentence, rule, texts = _sentence_rules(batch)
            at, sizes = np.unique(sentence, return_counts=True)
            rules = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), texts.take(pa.array(rule)))
            columns = [batch.column(c).take(pa.array(at)) for c in keys] + [rules]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return run


def _of_lists(sentences: DataFrame, keys: tuple[str, ...], run, name: str, kind: str, arrow: pa.DataType) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_type

    lists = sentences.filter(F.col("tokens").isNotNull()).select(*keys, *[F.col(f"tokens.{c}").alias(c) for c in ("pos", "dep", "head")])
    schema = pa.schema([*[(c, to_arrow_type(sentences.schema[c].dataType)) for c in keys], (name, arrow)])
    kinds = ", ".join([f"`{c}` {sentences.schema[c].dataType.simpleString()}" for c in keys] + [f"{name} {kind}"])
    return lists.mapInArrow(run(schema, keys), kinds)


def sentence_rules(sentences: DataFrame, *keys: str) -> DataFrame:
    """(keys, rule) with a row for each distinct rule of `tokens`: `struct_rules` for tables of sentences, several times faster."""
    return _of_lists(sentences, keys, _ruled, "rule", "string", pa.string())


def sentence_rule_lists(sentences: DataFrame, *keys: str) -> DataFrame:
    """(keys, rules) with a row for each sentence of `tokens` that has rules: all its distinct rules, rising. No shuffle is needed to have them together."""
    return _of_lists(sentences, keys, _listed, "rules", "array<string>", pa.list_(pa.string()))


def annotated_tokens(sentences: DataFrame, *keys: str) -> DataFrame:
    """(keys, t) with a row for each token of `tokens`, annotated as `annotated` does it: for tables of sentences, where this is several times faster."""
    from pyspark.sql.pandas.types import to_arrow_type

    lists = sentences.filter(F.col("tokens").isNotNull()).select(*keys, *[F.col(f"tokens.{c}").alias(c) for c in ("text", "pos", "dep", "head")])
    strings = ("text", *CONTEXT)
    schema = pa.schema([*[(c, to_arrow_type(sentences.schema[c].dataType)) for c in keys], ("i", pa.int32()), *[(c, pa.string()) for c in strings]])
    kinds = ", ".join([*[f"`{c}` {sentences.schema[c].dataType.simpleString()}" for c in keys], "i int", *[f"{c} string" for c in strings]])
    return lists.mapInArrow(_contexts(schema, keys), kinds).select(*keys, F.struct("i", *strings).alias("t"))


#: What the signatures of an annotated token follow from.
CONTEXT = ("pos", "dep", "parent", "grand", "clause", "depth", "left", "right")


def signature_counts(tokens: DataFrame, *keys: str) -> DataFrame:
    """(level, name, sig, keys, n) of annotated tokens, column `t`: contexts are counted first, and only the few distinct ones are signed."""
    contexts = tokens.select(*keys, *[F.col(f"t.{c}").alias(f"_{c}") for c in CONTEXT]).groupBy(*keys, *[f"_{c}" for c in CONTEXT]).agg(F.count("*").alias("_n"))
    t = F.struct(*[F.col(f"_{c}").alias(c) for c in CONTEXT])
    signed = contexts.select(*keys, "_n", F.explode(signatures(t)).alias("_s"))
    return signed.groupBy("_s.level", "_s.name", "_s.sig", *keys).agg(F.sum("_n").alias("n"))


def context_signature(t: Column) -> Column:
    """Class, relation, parent's class, length and shape of a word."""
    return F.concat_ws("|", t["pos"], t["dep"], t["parent"], length_bucket(F.length(t["text"])), word_shape(t["text"]))


def length_bucket(n: Column) -> Column:
    return F.when(n.between(1, 3), "1-3").when(n.between(4, 6), "4-6").when(n.between(7, 10), "7-10").when(n.between(11, 20), "11-20").otherwise("11+")


def word_shape(w: Column) -> Column:
    """empty, digit, lower, upper, title, mixed or other."""
    letters = w.rlike(r"\p{L}")
    head, tail = F.substring(w, 1, 1), w.substr(F.lit(2), F.length(w))
    return (
        F.when(w == "", "empty").when(w.rlike(r"^\p{Nd}+$"), "digit").when(letters & (w == F.lower(w)), "lower").when(letters & (w == F.upper(w)), "upper")
        .when((head != F.lower(head)) & tail.rlike(r"\p{L}") & (tail == F.lower(tail)), "title").when(w.rlike(r"\p{Nd}"), "mixed").otherwise("other")
    )
