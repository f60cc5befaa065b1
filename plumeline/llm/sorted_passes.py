"""Near-duplicate vectors by sorted projection passes.

Every pass draws random hyperplanes; the signs of a vector's projections on them are its key, and vectors of a label are
put in lexicographic order of keys. Each vector is compared with the `window` ones before it, block by block as matrix
products; pairs that reach the cosine are united. Planes go through the mean direction of a label, not the origin, so that unrelated
vectors agree on about half of the bits even where all of them lie in a cone.

How many passes a label takes is measured, not estimated: beside up to `twins` of its vectors, chosen by hash, a twin is planted,
in a random direction at exactly the threshold's cosine. Twins make no links; a label is done when every twin has met its
vector in a window, and then half as many passes again are made. So labels of one cone or of several, easy ones
and hard ones, each get what they need, and vectors further along need no more than their own label does. A label that fits in a window takes one pass
and no twins. Passes run a few at a time and leave only links behind, so disk use does not grow with their number.

A label of more than `segment` vectors is cut along the order, by counts of key prefixes, so that many tasks share it; a prefix
that is itself too common is dealt by hash, anew in each pass. What a cut parts is left to the other passes, and
since twins are parted alike, the measure counts it.

Pairs missed inside a dense group do no harm: links are not counted in the windows. The passes only have to connect a
group; then all its members are compared with each other exactly, in blocks, in double precision.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and those with a null label,
link with nothing. Equal vectors of a label are one class in the passes and count as often as they come. Vectors of
different lengths link with nothing. An empty table gives no rows; extra columns are not read. Rows that repeat a
vec_id are repeated in the result; where such rows hold different vectors, they share their links.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumeline.llm.blocks import block_pairs
from plumeline.llm.common import stage, unstage
from plumeline.llm.connected import connected_components

BITS = 64
#: Rows whose windows are compared at once.
STEP = 512


@dataclass(frozen=True)
class PassParams:
    cosine: float = 0.93
    window: int = 2048
    #: Twins planted in each label that is larger than a window.
    twins: int = 400
    #: Passes made in all, over those after which every twin was met.
    more: float = 1.5
    #: Passes sorted together; each sends the vectors once.
    passes_per_round: int = 3
    #: Vectors of a label that one task sorts: so many windows.
    segment: int = 8
    block: int = 1024
    seed: int = 5


def unite(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index of each of n items' component under links a - b."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        root = root[root]
        if (root == before).all() and (root[a] == root[b]).all():
            return root


def _unit(rows: list[np.ndarray]) -> np.ndarray:
    x = np.stack(rows).astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unit vectors added up by label and length, a few rows for each partition."""
    sums: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        pdf = batch.to_pandas()
        for (label, size), part in pdf.groupby(["label", pdf["embedding"].map(len)]):
            sums[label, size] = sums.get((label, size), 0) + np.append(_unit(part["embedding"].to_numpy()).sum(axis=0), len(part))
    for (label, size), total in sums.items():
        n = np.full(size, int(total[-1]))
        yield pa.RecordBatch.from_arrays([pa.array(np.full(size, label)), pa.array(np.full(size, size, np.int32)), pa.array(np.arange(size, dtype=np.int32)), pa.array(total[:-1]), pa.array(n)], ["label", "size", "i", "x", "n"])


def _twin(x: np.ndarray, rep: int, params: PassParams) -> np.ndarray:
    """A unit vector at the threshold's cosine to the unit vector x, in a direction that follows from its id."""
    side = np.random.default_rng([params.seed, rep & (1 << 63) - 1]).standard_normal(len(x))
    side -= (side @ x) * x
    return params.cosine * x + math.sqrt(1 - params.cosine**2) * side / max(np.linalg.norm(side), 1e-300)


def _keys(pdf: pd.DataFrame, passes: range, params: PassParams, planes: dict[int, np.ndarray]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Vectors with their label's mean, twins behind their vectors, and the keys (vector, pass) in unsigned order."""
    for size, part in pdf.groupby(pdf["embedding"].map(len)):
        x = _unit(part["embedding"].to_numpy())
        twins = np.flatnonzero(part["twin"].to_numpy())
        part = part.assign(twin=False)
        if len(twins):
            planted = np.stack([_twin(x[i], int(part["rep"].iat[i]), params) for i in twins])
            again = part.iloc[twins].assign(twin=True)
            again["embedding"] = list(planted.astype(part["embedding"].iat[0].dtype))
            x, part = np.concatenate([x, planted]), pd.concat([part, again], ignore_index=True)
        if size not in planes:
            planes[size] = np.concatenate([np.random.default_rng([params.seed, p]).standard_normal((size, BITS)) for p in passes], axis=1)
        signs = np.packbits(((x - np.stack(part["mean"].to_numpy())) @ planes[size] > 0).reshape(len(x), len(passes), BITS), axis=2)
        yield part, signs.reshape(len(x), len(passes) * 8).view(">u8").astype(np.uint64)


def _prefixed(passes: range, params: PassParams):
    """A row for each vector and pass with the label and a prefix of the key, of as many bits as the label's size asks for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, keys in _keys(batch.to_pandas(), passes, params, planes):
                n = len(passes)
                shift = np.repeat(64 - part["bits"].to_numpy(), n).astype(np.uint64)
                yield pa.RecordBatch.from_pandas(pd.DataFrame({
                    "pass": np.tile(np.array(passes, np.int32), len(part)), "label": np.repeat(part["label"].to_numpy(), n).astype(np.int64), "size": np.repeat(part["size"].to_numpy(), n).astype(np.int32),
                    "prefix": (keys.ravel() >> shift).astype(np.int64)}), preserve_index=False)

    return run


#: For a pass, label and length: bits of its prefixes, the first prefix of each segment, and prefixes to deal by hash with their parts.
Cuts = dict[tuple[int, int, int], tuple[int, np.ndarray, dict[int, int]]]


def _cuts(large: DataFrame, passes: range, params: PassParams) -> Cuts:
    """Where the labels of `large` are cut in each pass: a number for each segment comes to the driver, never one for each vector."""
    most = params.segment * params.window
    counts = large.mapInArrow(_prefixed(passes, params), "pass int, label long, size int, prefix long").groupBy("pass", "label", "size", "prefix").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("pass", "label", "size").orderBy("prefix").rowsBetween(Window.unboundedPreceding, -1))
    placed = counts.withColumn("segment", F.floor(F.coalesce(before, F.lit(0)) / most)).withColumn("common", F.col("n") > 2 * most)
    firsts = placed.groupBy("pass", "label", "size", "segment").agg(F.min("prefix").alias("first"))
    sizes = large.select("label", "size", "bits").distinct()
    out: Cuts = {}
    bits = {(r.label, r.size): r.bits for r in sizes.collect()}
    counts = stage(firsts.select("pass", "label", "size", "first", F.lit(None).cast("int").alias("parts")).unionByName(placed.filter("common").select("pass", "label", "size", F.col("prefix").alias("first"), F.ceil(F.col("n") / most).cast("int").alias("parts"))), "cuts")
    found: dict = {}
    for r in counts.collect():
        starts, common = found.setdefault((r["pass"], r.label, r.size), ([], {}))
        if r.parts is None:
            starts.append(r.first)
        else:
            common[r.first] = r.parts
    unstage(counts)
    for (p, label, size), (starts, common) in found.items():
        out[p, label, size] = (bits[label, size], np.array(sorted(starts)), common)
    return out


def _keyed(passes: range, params: PassParams, cuts: Cuts):
    """Vectors with their label's mean -> a row for each pass with the key and the segment, and the same for their twins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, keys in _keys(batch.to_pandas(), passes, params, planes):
                label, size, rep = part["label"].to_numpy(), int(part["size"].iat[0]), part["rep"].to_numpy()
                segment = np.zeros(keys.shape, np.int64)
                for k, p in enumerate(passes):
                    for one in np.unique(label):
                        if (p, int(one), size) in cuts:
                            bits, starts, common = cuts[p, int(one), size]
                            at = np.flatnonzero(label == one)
                            prefix = (keys[at, k] >> np.uint64(64 - bits)).astype(np.int64)
                            place = np.maximum(np.searchsorted(starts, prefix, "right") - 1, 0) << 20
                            parts = np.array([common.get(int(x), 0) for x in prefix]) if common else np.zeros(len(prefix), np.int64)
                            dealt = (rep[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15 ^ (p << 32 | 1)) >> np.uint64(33)).astype(np.int64)
                            segment[at, k] = place + np.where(parts > 0, dealt % np.maximum(parts, 1), 0)
                n = len(passes)
                yield pa.RecordBatch.from_pandas(pd.DataFrame({
                    "pass": np.tile(np.array(passes, np.int32), len(part)), "label": np.repeat(label, n).astype(np.int64), "size": np.full(len(part) * n, size, np.int32), "segment": segment.ravel(),
                    "key": (keys.ravel() ^ np.uint64(1 << 63)).view(np.int64), "rep": np.repeat(rep, n), "twin": np.repeat(part["twin"].to_numpy(bool), n), "embedding": np.repeat(part["embedding"].to_numpy(), n)}), preserve_index=False)

    return run


def compared(x: np.ndarray, group: np.ndarray, twin: np.ndarray, rep: np.ndarray, new: int, params: PassParams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit vectors in order: links (a, b) by place that unite what rows from `new` on find in their windows, and twins that they meet."""
    found_a, found_b, met = [], [], []
    edge = np.searchsorted(group, group)  # where each row's group begins
    for lo in range(new, len(x), STEP):
        hi = min(lo + STEP, len(x))
        first = max(int(edge[lo]), lo - params.window)
        place, other = np.arange(lo, hi)[:, None], np.arange(first, hi)[None, :]
        inside = (other < place) & (place - other <= params.window) & (group[lo:hi, None] == group[None, first:hi])
        near = (x[lo:hi] @ x[first:hi].T >= params.cosine) & inside & ~twin[lo:hi, None] & ~twin[None, first:hi]
        a, b = np.nonzero(near)
        if len(a):
            root = unite(hi - first, a + (lo - first), b)
            tied = np.flatnonzero(root != np.arange(hi - first))
            found_a.append(root[tied] + first)
            found_b.append(tied + first)
        planted = np.flatnonzero(twin[first:hi]) + first
        if len(planted):
            own = np.flatnonzero(~twin[first:hi] & np.isin(rep[first:hi], rep[planted])) + first
            where = {(group[i], rep[i]): i for i in own}
            for i in planted:
                j = where.get((group[i], rep[i]))
                if j is not None and max(i, j) >= lo and abs(i - j) <= params.window:
                    met.append(i)
    none = np.empty(0, np.int64)
    a, b = (np.concatenate(f) if f else none for f in (found_a, found_b))
    if len(a):
        root = unite(len(x), a, b)
        b = np.flatnonzero(root != np.arange(len(x)))
        a = root[b]
    return a, b, np.array(met, np.int64)


def _windows(params: PassParams):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry: pd.DataFrame | None = None
        for batch in batches:
            pdf = batch.to_pandas()
            if not len(pdf):
                continue
            new = 0 if carry is None else len(carry)
            pdf = pdf if carry is None else pd.concat([carry, pdf], ignore_index=True)
            width = int(pdf["size"].max())
            x = np.zeros((len(pdf), width))
            for i, e in enumerate(pdf["embedding"]):
                x[i, : len(e)] = e
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            keys = pdf[["pass", "label", "size", "segment"]].to_numpy(np.int64)
            group = np.concatenate([[0], np.cumsum((keys[1:] != keys[:-1]).any(axis=1))])
            rep, label, size = (pdf[c].to_numpy() for c in ("rep", "label", "size"))
            a, b, met = compared(x, group, pdf["twin"].to_numpy(bool), rep, new, params)
            at = np.concatenate([b, met])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([rep[a], rep[met]])), pa.array(rep[at]), pa.array(label[at]), pa.array(size[at]), pa.array(np.arange(len(at)) >= len(b))], ["a", "b", "label", "size", "met"])
            carry = pdf.tail(params.window)

    return run


def _counted(params: PassParams):
    """A block pair of a group -> for each member, the vectors it links with there and the smallest rep of its part."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j, block = pdf["_i"].iat[0], pdf["_j"].iat[0], pdf["_block"].to_numpy()
        x = np.stack(pdf["embedding"].to_numpy()).astype(np.float64)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        links = x @ x.T >= params.cosine
        np.fill_diagonal(links, False)
        if i != j:  # pairs inside a block are counted where the block meets itself
            links &= block[:, None] != block[None, :]
        a, b = np.nonzero(links)
        rep = pdf["rep"].to_numpy()
        order = np.argsort(rep, kind="stable")
        place = np.empty(len(rep), np.int64)
        place[order] = np.arange(len(rep))
        root = unite(len(rep), place[a], place[b])
        return pd.DataFrame({"rep": rep, "links": links @ pdf["weight"].to_numpy(), "root": rep[order[root[place]]]})

    return run


def _connected_by_passes(classes: DataFrame, params: PassParams) -> DataFrame:
    """(node, root) of the vectors (label, embedding, rep) that the passes connect."""
    sums = classes.select("label", "embedding").mapInArrow(_summed, "label long, size int, i int, x double, n long").groupBy("label", "size", "i").agg(F.sum("x").alias("x"), F.sum("n").alias("n"))
    means = sums.groupBy("label", "size").agg(F.max("n").alias("n"), F.transform(F.sort_array(F.collect_list(F.struct("i", (F.col("x") / F.col("n")).alias("m")))), lambda s: s["m"]).alias("mean"))
    means = stage(means, "means")
    most = params.segment * params.window
    rows = classes.withColumn("size", F.size("embedding"))
    kind = classes.schema["embedding"].dataType.simpleString()
    tasks = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def centred(labels: DataFrame) -> DataFrame:
        few = labels.count() <= 10_000
        out = rows.join(F.broadcast(labels) if few else labels.hint("merge"), ["label", "size"])
        twin = (F.col("n") > params.window + 1) & (F.pmod(F.xxhash64(F.lit(params.seed), "rep"), F.col("n")) < params.twins)
        bits = F.least(F.lit(62), F.greatest(F.lit(8), F.ceil(F.log2(F.col("n") / most)) + 6)).cast("int")
        return out.select("label", "size", "embedding", "rep", "mean", "n", twin.alias("twin"), bits.alias("bits"))

    # A number for each label that is larger than a window: how many of its twins nothing has met, and when it is done.
    waiting = {(r.label, r.size): r.n for r in centred(means.filter(F.col("n") > params.window + 1)).filter("twin").groupBy("label", "size").agg(F.count("*").alias("n")).collect()}
    until: dict[tuple[int, int], int] = {}
    links: list[DataFrame] = []
    seen: list[DataFrame] = []
    active, made, open_ = means, 0, True
    while open_:
        passes = range(made, made + (params.passes_per_round if made else 1))
        vectors = centred(active)
        large = vectors.filter(F.col("n") > most)
        cuts = _cuts(large, passes, params) if made or not means.filter(F.col("n") > most).isEmpty() else {}
        keyed = vectors.mapInArrow(_keyed(passes, params, cuts), f"pass int, label long, size int, segment long, key long, rep long, twin boolean, embedding {kind}")
        order = ["pass", "label", "size", "segment", "key", "rep", "twin"]
        near = stage(keyed.repartition(tasks, *order[:4]).sortWithinPartitions(*order).mapInArrow(_windows(params), "a long, b long, label long, size int, met boolean"), "near")
        made = passes.stop
        links.append(near)
        seen.append(stage(near.filter("met").select("label", "size", "b"), "met"))
        met = {(r.label, r.size): r.n for r in functools.reduce(DataFrame.unionByName, seen).distinct().groupBy("label", "size").agg(F.count("*").alias("n")).collect()}
        for at, planted in waiting.items():
            if at not in until and met.get(at, 0) >= planted:
                until[at] = math.ceil(params.more * made)
        left = [at for at in waiting if made < until.get(at, made + 1)]
        open_ = bool(left)
        if open_:
            names = classes.sparkSession.createDataFrame(left, "label long, size int")
            active = means.join(F.broadcast(names) if len(left) <= 10_000 else names, ["label", "size"], "left_semi")
        if len(links) >= 5 or not open_:
            roots = connected_components(functools.reduce(DataFrame.unionByName, [x.filter("NOT met").select("a", "b") for x in links]))
            forest = stage(roots.select(F.col("root").alias("a"), F.col("node").alias("b"), F.lit(False).alias("met")), "near")
            unstage(*links, roots)
            links = [forest]
    unstage(means, *seen)
    return links[0].select(F.col("b").alias("node"), F.col("a").alias("root"))


def near_duplicates(embeddings: DataFrame, params: PassParams | None = None) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row of `embeddings` (vec_id, embedding, label)."""
    params = params or PassParams()
    kind = "array<float>" if embeddings.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("embedding"), F.col("label").cast("long").alias("label"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    usable = F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.coalesce(finite, F.lit(False))
    classes = rows.filter(usable).groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight"))
    classes = stage(classes, "classes")
    united = _connected_by_passes(classes.select("label", "embedding", "rep"), params)
    united = united.unionByName(united.select(F.col("root").alias("node"), "root").distinct()).withColumnRenamed("node", "rep")
    # What no pass has united is compared no more. The label and the length are in the group, since rows of several
    # labels may share a vec_id.
    grouped = classes.join(united, "rep").withColumn("group", F.xxhash64("label", F.size("embedding"), "root")).drop("root")
    pairs = block_pairs(grouped, "group", "rep", params.block)
    seen = stage(pairs.groupBy("group", "_i", "_j").applyInPandas(_counted(params), "rep long, links long, root long"), "links")
    counts = seen.groupBy("rep").agg(F.sum("links").alias("links"))
    final = connected_components(seen.filter("root != rep").select(F.col("root").alias("a"), F.col("rep").alias("b"))).withColumnRenamed("node", "rep")

    known = classes.join(counts, "rep", "left").join(final, "rep", "left").select("label", "embedding", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("root", "rep").alias("component_id"))
    inside = rows.filter(usable).join(known, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = rows.filter(~usable).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = inside.unionByName(alone)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
