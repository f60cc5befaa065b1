"""Similarity join of documents on word n-gram sets by a MinHash LSH forest, with exact verification.

Every text gets `trees` keys of `depth` MinHash values. The keys of a tree, in sorted order, are its prefix trie: the
common prefix of neighbours says how deep they part, and texts with a common prefix are a node. From the full depth on,
a text's prefixes are shortened, one tree at a time, always where the least further texts come in for what recall it
gives, until a text at the threshold would share a prefix with it in some tree with the target recall. So trees in which
a template's prefix is shared by many stay deep, and quiet ones become shallow. The texts of a chosen node are candidates
of each other.

Candidates are first compared by their whole signatures (`trees` x `depth` values); pairs whose agreement is more than
`sure` deviations under the threshold are no links. What is left is united into groups, and all members of a group are
compared exactly on their n-gram sets, in blocks: no link inside a group depends on which of its pairs the tries met, and
texts that merely share a template do not chain into groups. Nothing is emitted for a pair: tasks return a spanning
forest, and in the last step a count of links for each member.

The sort's tasks see a node that lies across two of them as two smaller ones. That moves a choice of depth, never a
candidate: what is compared follows from the prefixes chosen, which are met by equality.

Words are what white space separates, as they stand. Equal texts are one class with a weight, so copies are neither
compared nor expanded; n_links counts documents, copies included.
Defined results: a null text and a text without words have no n-grams and link with nothing, not even each other; a
text of fewer than n words is one n-gram of all its words. Repeated rows (same doc_id and text) count as copies. Rows
with a null doc_id take part; a group's class id is its smallest doc_id that is not null. An empty table gives no rows.
Extra columns are not read by `similarity_join`; `one_of_each` returns all columns it was given.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumeline.llm.blocks import block_pairs
from plumeline.llm.common import fresh, shingles, stage, unstage, whole_text
from plumeline.llm.connected import connected_components
from plumeline.llm.sorted_passes import unite


@dataclass(frozen=True)
class ForestParams:
    words: int = 5
    similarity: float = 0.8
    trees: int = 24
    depth: int = 8
    #: The shortest prefix.
    least: int = 4
    recall: float = 0.999
    #: Signatures that agree on so many deviations less than the threshold are not compared exactly.
    sure: float = 4.0
    node_block: int = 1024
    block: int = 256
    seed: int = 6

    @property
    def values(self) -> int:
        return self.trees * self.depth

    @property
    def needed(self) -> int:
        """How many signature values a pair must agree on to be compared exactly."""
        s = self.similarity
        return max(1, math.ceil(self.values * s - self.sure * math.sqrt(self.values * s * (1 - s))))

    def gain(self, depth: int) -> float:
        """What a tree at this depth gives towards the recall: -ln of the chance that a pair at the threshold parts above it."""
        return -math.log(1 - self.similarity**depth)


def signature(grams: np.ndarray, values: int, seed: int) -> np.ndarray:
    """16 bits of each MinHash value."""
    rng = np.random.default_rng(seed)
    a = rng.integers(1, 1 << 32, values, dtype=np.uint32) | np.uint32(1)
    b = rng.integers(0, 1 << 32, values, dtype=np.uint32)
    low, best = (grams >> np.uint64(32)).astype(np.uint32) ^ grams.astype(np.uint32), np.full(values, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 1024):
        part = low[at : at + 1024, None] * a
        part += b
        np.minimum(best, part.min(axis=0), out=best)
    return (best * np.uint32(0x9E3779B1) >> np.uint32(16)).astype(np.uint16)


def _signed(params: ForestParams):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[bytes | None] = []
            for text in batch.column(2):
                grams = shingles(text.as_py(), params.words)
                found.append(signature(grams, params.values, params.seed).astype(">u2").tobytes() if len(grams) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.binary())], ["doc_id", "node", "signature"])

    return run


def _fixed(column: pa.Array, width: int) -> np.ndarray:
    """A binary column of one width as rows of bytes."""
    cells = column.cast(pa.binary(width))
    return np.frombuffer(cells.buffers()[1], np.uint8)[cells.offset * width : (cells.offset + len(cells)) * width].reshape(-1, width) if len(cells) else np.empty((0, width), np.uint8)


def common_prefixes(keys: np.ndarray) -> np.ndarray:
    """How many values each row of a sorted table has in common with the one before, from the left; 0 for the first."""
    out = np.zeros(len(keys), np.int32)
    out[1:] = np.minimum.accumulate(keys[1:] == keys[:-1], axis=1).sum(axis=1)
    return out


def _climbed(params: ForestParams):
    """Keys in order -> those that share a prefix of `least` values with a neighbour, and how many texts each longer prefix has."""
    width, chunk = 2 * params.depth, 1 << 16

    def measured(batch: pa.RecordBatch) -> pa.RecordBatch:
        tree = batch.column("tree").to_numpy()
        shared = common_prefixes(_fixed(batch.column("key"), width).view(">u2"))
        shared[1:][tree[1:] != tree[:-1]] = 0
        sizes = []
        for depth in range(params.least, params.depth + 1):
            run = np.cumsum(shared < depth)
            sizes.append(np.bincount(run)[run])
        edge = np.zeros(len(tree), bool)
        edge[[0, -1]] = True  # the neighbour may be in another chunk
        at = np.flatnonzero((sizes[0] > 1) | edge)
        flat = np.stack(sizes, axis=1)[at].astype(np.int32).ravel()
        listed = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, len(sizes), dtype=np.int32)), pa.array(flat))
        kept = batch.take(pa.array(at))
        return pa.RecordBatch.from_arrays([*kept.columns, listed, pa.array(edge[at])], ["node", "tree", "key", "sizes", "edge"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= chunk:
                yield measured(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
                held = []
        if sum(b.num_rows for b in held):
            yield measured(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    return run


def chosen_depths(sizes: list[list[int]], params: ForestParams) -> list[int]:
    """A depth for each tree in which a text shares a prefix with others, from its nodes' sizes at depths `least` to `depth`.

    All other trees cost nothing at the least depth. The given ones start at full depth and are shortened, the cheapest
    for its gain first, until the recall is reached.
    """
    gains = [params.gain(d) for d in range(params.least, params.depth + 1)]
    level = [len(gains) - 1] * len(sizes)
    missing = -math.log(1 - params.recall) - (params.trees - len(sizes)) * gains[0] - len(sizes) * gains[-1]
    steps = [((s[-2] - s[-1]) / (gains[-2] - gains[-1]), t) for t, s in enumerate(sizes)]
    heapq.heapify(steps)
    while missing > 0 and steps:
        _, t = heapq.heappop(steps)
        level[t] -= 1
        k = level[t]
        missing -= gains[k] - gains[k + 1]
        if k:
            heapq.heappush(steps, ((sizes[t][k - 1] - sizes[t][k]) / (gains[k - 1] - gains[k]), t))
    return [params.least + k for k in level]


def _chosen(params: ForestParams):
    """A text with its shared keys -> the depth to which each is shortened, and whether its node holds no other there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for node, shared in zip(batch.column("node").to_pylist(), batch.column("shared").to_pylist(), strict=True):
                shared.sort(key=lambda s: s["tree"])
                depths = chosen_depths([s["sizes"] for s in shared], params)
                for s, d in zip(shared, depths, strict=True):
                    for column, value in zip(out, (node, s["tree"], s["key"], d, s["sizes"][d - params.least] == 1 and not s["edge"]), strict=True):
                        column.append(value)
            types = (pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], ["node", "tree", "key", "depth", "alone"])

    return run


def spanning_pairs(signatures: np.ndarray, needed: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the rows that agree on `needed` values: each row is compared with those not yet reached alone."""
    left, a, b = np.arange(len(signatures)), [], []
    while len(left) > 1:
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            i = todo.pop()
            near = (signatures[left] == signatures[i]).sum(axis=1) >= needed
            found, left = left[near], left[~near]
            a.append(np.full(len(found), i))
            b.append(found)
            todo.extend(found)
    none = np.empty(0, np.int64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def _alike(params: ForestParams):
    """Rows (key, node, signature) with equal keys together -> a spanning forest of those whose signatures agree."""
    width, few = 2 * params.values, 8

    def linked(keys: np.ndarray, nodes: np.ndarray, signatures: np.ndarray) -> pa.RecordBatch:
        a, b = [], []
        starts = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)]))
        sizes = np.diff(np.append(starts, len(keys)))
        size = np.repeat(sizes, sizes)
        for step in range(1, few):  # small groups, all at once
            i = np.flatnonzero((size[:-step] <= few) & (keys[:-step] == keys[step:]).all(axis=1)) if len(keys) > step else np.empty(0, np.int64)
            near = (signatures[i] == signatures[i + step]).sum(axis=1) >= params.needed
            a.append(i[near])
            b.append(i[near] + step)
        for start, n in zip(starts[sizes > few], sizes[sizes > few], strict=True):
            x, y = spanning_pairs(signatures[start : start + n], params.needed)
            a.append(start + x)
            b.append(start + y)
        one, other = nodes[np.concatenate(a).astype(np.int64)], nodes[np.concatenate(b).astype(np.int64)]
        return pa.RecordBatch.from_arrays([pa.array(one), pa.array(other)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            keys = np.stack([batch.column(n).to_numpy() for n in ("group", "_i", "_j")], axis=1)
            part = [keys, batch.column("node").to_numpy(), _fixed(batch.column("signature"), width).view(np.uint16)]
            held = part if held is None else [np.concatenate(x) for x in zip(held, part, strict=True)]
            ends = np.flatnonzero((held[0][1:] != held[0][:-1]).any(axis=1)) + 1  # the last group may go on
            if len(ends):
                yield linked(*(x[: ends[-1]] for x in held))
                held = [x[ends[-1] :] for x in held]
        if held is not None and len(held[0]):
            yield linked(*held)

    return run


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """How many values each two of the sets share: rare values pair by pair, common ones by a product of 0/1 blocks."""
    m = len(sets)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    values, inverse, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.argsort(inverse, kind="stable")
    owner, starts = owner[order], np.concatenate([[0], np.cumsum(df)[:-1]])
    out = np.zeros(m * m)
    for d in np.unique(df[(df > 1) & (df <= 16)]):
        held = owner[starts[df == d][:, None] + np.arange(d)]
        for i in range(d):
            for j in range(i + 1, d):
                out += np.bincount(held[:, i] * m + held[:, j], minlength=m * m)
    out = out.reshape(m, m)
    out = out + out.T
    common = np.flatnonzero(df > 16)
    for at in range(0, len(common), 2048):
        part = common[at : at + 2048]
        grid = np.zeros((m, len(part)), np.float32)
        for k, v in enumerate(part):
            grid[owner[starts[v] : starts[v] + df[v]], k] = 1
        out += grid @ grid.T
    return out


def _linked(params: ForestParams):
    """A block pair of a group -> each member's links there and the smallest node of its part."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("node").sort_values("node", ignore_index=True)
        i, j, block, node = pdf["_i"].iat[0], pdf["_j"].iat[0], pdf["_block"].to_numpy(), pdf["node"].to_numpy()
        sets = [shingles(t, params.words) for t in pdf["text"]]
        sizes = np.array([len(s) for s in sets], np.float64)
        shared = intersections(sets)
        links = shared / np.maximum(sizes[:, None] + sizes[None, :] - shared, 1) >= params.similarity
        np.fill_diagonal(links, False)
        if i != j:
            links &= block[:, None] != block[None, :]
        a, b = np.nonzero(links)
        return pd.DataFrame({"node": node, "links": links @ pdf["weight"].to_numpy(), "root": node[unite(len(node), a, b)], "single": pdf["_single"]})

    return run


def _id(column: str):
    return F.coalesce(F.col(column).cast("long"), F.lit(-(2**63)))


def _candidates(classes: DataFrame, params: ForestParams) -> DataFrame:
    """(a, b): a spanning forest of the texts (node, signature) that share a chosen prefix and whose signatures agree."""
    width = 2 * params.depth
    keys = F.transform(F.sequence(F.lit(0), F.lit(params.trees - 1)), lambda t: F.substring("signature", t * width + 1, F.lit(width)))
    tries = classes.select("node", F.posexplode(keys).alias("tree", "key")).repartitionByRange("tree", "key", "node").sortWithinPartitions("tree", "key", "node")
    shared = stage(tries.mapInArrow(_climbed(params), "node long, tree int, key binary, sizes array<int>, edge boolean"), "tries")
    # At most one row for a tree.
    by_text = shared.groupBy("node").agg(F.collect_list(F.struct("tree", "key", "sizes", "edge")).alias("shared"))
    cut = stage(by_text.mapInArrow(_chosen(params), "node long, tree int, key binary, depth int, alone boolean"), "prefixes")
    unstage(shared)

    def prefix(depth):
        return F.xxhash64("tree", F.substring("key", F.lit(1), 2 * depth), depth)

    # A text is met in the shallowest node that it or another text of that node has chosen.
    nodes = cut.filter("not alone").select(prefix(F.col("depth")).alias("group")).distinct()
    above = cut.select("*", F.explode(F.sequence(F.lit(params.least), "depth")).alias("at")).withColumn("group", prefix(F.col("at")))
    met = above.join(nodes, "group", "left_semi").groupBy("node", "tree").agg(F.min_by("group", "at").alias("group"))
    members = met.select("group", "node").join(classes, "node")
    placed = block_pairs(members, "group", "node", params.node_block).select("group", "_i", "_j", "node", "signature")
    together = placed.repartition("group", "_i", "_j").sortWithinPartitions("group", "_i", "_j", "node")
    out = stage(together.mapInArrow(_alike(params), "a long, b long").distinct(), "alike")
    unstage(cut)
    return out


def _classes(documents: DataFrame, params: ForestParams) -> tuple[DataFrame, DataFrame]:
    """(doc_id, node, _empty) of the documents; node, rep, root and n_links of the classes of equal texts."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    docs = docs.select("doc_id", F.xxhash64("text").alias("node"), "text")
    signed = stage(docs.mapInArrow(_signed(params), "doc_id long, node long, signature binary"), "signatures")
    usable = signed.filter("signature is not null")
    classes = stage(usable.groupBy("node").agg(F.min("doc_id").alias("rep"), F.count("*").alias("weight"), F.any_value("signature").alias("signature")), "classes")
    groups = connected_components(_candidates(classes.select("node", "signature"), params))
    # Every member of a group but its root is in `groups`; the root is added.
    members = groups.unionByName(groups.select(F.col("root").alias("node"), "root").distinct())
    members = members.join(classes.select("node", "rep", "weight"), "node").withColumnRenamed("root", "group")
    placed = stage(block_pairs(members, "group", "node", params.block), "blocks")
    # The id is a key beside the text's hash, so that copies of one text are not dealt to one task.
    # Members grow with the corpus, so the join is by sort and merge whatever their number: never a broadcast.
    spread = placed.withColumn("_id", _id("rep")).join(docs.withColumn("_id", _id("doc_id")).select("_id", "node", "text").hint("merge"), ["node", "_id"])
    columns = ["node", "group", "weight", "_i", "_j", "_block", "_single", "text"]
    seen = stage(spread.select(*columns).groupBy("group", "_i", "_j").applyInPandas(_linked(params), "node long, links long, root long, single boolean"), "links")

    counts = seen.groupBy("node").agg(F.sum("links").alias("links"))
    whole = seen.filter("single and node <> root").select("node", "root")
    cut = connected_components(seen.filter("not single").select(F.col("root").alias("a"), F.col("node").alias("b")))
    roots = whole.unionByName(cut)
    final = classes.select("node", "rep", "weight").join(counts, "node", "left").join(roots, "node", "left").select("node", "rep", F.coalesce("root", "node").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    final = stage(final, "final")
    unstage(classes, groups, placed, seen, cut)
    return signed.select("doc_id", "node", F.col("signature").isNull().alias("_empty")), final


def similarity_join(documents: DataFrame, params: ForestParams | None = None) -> DataFrame:
    """doc_id, class_id (smallest doc_id reachable by links, its own included) and n_links of every document."""
    rows, classes = _classes(documents, params or ForestParams())
    ids = classes.groupBy("root").agg(F.min("rep").alias("class_id"))
    named = classes.join(ids, "root").select("node", "class_id", "n_links")
    inside = rows.filter("not _empty").join(named, "node").select("doc_id", "class_id", "n_links")
    alone = rows.filter("_empty").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return inside.unionByName(alone)


def one_of_each(documents: DataFrame, params: ForestParams | None = None) -> DataFrame:
    """The documents without those that link to one with a smaller doc_id in their group: one of each group stays.

    Of rows that repeat the kept doc_id and text one stays as well.
    """
    _, classes = _classes(documents, params or ForestParams())
    first = F.min_by(F.struct("rep", "node"), F.struct(F.col("rep").isNull(), "rep", "node"))
    node, id_, again = (fresh(documents.columns, c) for c in ("_node", "_id", "_again"))
    kept = classes.groupBy("root").agg(first.alias("k")).select(_id("k.rep").alias(id_), F.col("k.node").alias(node))
    marked = documents.withColumn(node, F.xxhash64(whole_text())).withColumn(id_, _id("doc_id"))
    wordless = ~whole_text().rlike(r"[^\p{IsWhite_Space}\x1c-\x1f]")
    copy = F.row_number().over(Window.partitionBy(node, id_).orderBy(id_))
    chosen = marked.filter(~wordless).join(kept, [node, id_]).withColumn(again, copy).filter(F.col(again) == 1)
    return chosen.select(*documents.columns).unionByName(documents.filter(wordless))
