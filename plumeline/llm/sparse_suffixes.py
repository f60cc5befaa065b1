"""Repeated passages by sparse suffix arrays.

Suffixes are kept only at content-selected positions: of every `words - gram + 1` consecutive grams of `gram` words, the
one with the smallest hash. Every run of `words` words holds a selected position, at the same place wherever it occurs.
Kept suffixes are sorted by content: by their first gram, then by hashes of their first words at growing lengths up to
`words`, then by document and position. Each is compared with its neighbours of equal gram in that order: the later one
of a pair, by document, repeats the earlier. Neighbours at one distance whose grams touch make a run. Both sides of a run
send a 160-bit digest of its words and, as they stand, the words around it; runs whose digests differ are dropped, and
the match is extended left and right word by word. A match of `words` words or more is a repeated passage; the earlier document (by doc_id, nulls last) keeps it.

The order is a range sort of rows, so a gram that very many documents share is split among tasks by what follows it.
Grams that occur once are dropped by a count before anything is sorted.

A neighbour can share the gram alone while a farther suffix shares the whole passage. So every run of `words` words whose
selected gram is shared, and which lies in no passage found so far, is then hashed whole (128 bits); all but the first
place of equal runs are repeats too. The first place of a run is never inside a found passage, so nothing is lost: the
words flagged are all words of all repeated runs, whatever the partitions are. How they are cut into rows, and which
earlier place is named as the source, may follow the partitions.

Words are what white space separates. An extension reads as far as `words` words; what lies beyond holds selected
positions of its own. Defined results: a null text is an empty one; texts under `words` words have no passage. A passage
that overlaps its own earlier occurrence in a document is repeated too. Rows that repeat both doc_id and text are one
document and all of them get its passages. An empty table gives no rows. Extra columns are not read by `repeats`;
`without_repeats` returns all columns it was given.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumeline.llm.common import WORDS, fresh, gram_hashes, mix, run_hashes, stage, unstage, whole_text


@dataclass(frozen=True)
class SuffixParams:
    words: int = 50
    gram: int = 26

    @property
    def window(self) -> int:
        return self.words - self.gram + 1

    @property
    def compared(self) -> list[int]:
        """The lengths at which suffixes of equal gram are told apart in the sort, besides the gram's own."""
        step = max(1, (self.words - self.gram) // 3)
        return [self.gram + step, self.gram + 2 * step, self.words]


def chosen(hashes: np.ndarray, params: SuffixParams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(positions, gram hashes, how many runs of `words` words select each); the runs of one position follow those of the one before."""
    grams = gram_hashes(hashes, params.gram)
    if len(grams) < params.window:
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64)
    at = [start + np.arange(len(part)) + part.argmin(axis=1) for start in range(0, len(grams) - params.window + 1, 4096) for part in [sliding_window_view(grams[start : start + 4096 + params.window - 1], params.window)]]
    at, runs = np.unique(np.concatenate(at), return_counts=True)
    return at, grams[at], runs


def selected(hashes: np.ndarray, params: SuffixParams) -> tuple[np.ndarray, np.ndarray]:
    """(positions, gram hashes) of the suffixes kept."""
    return chosen(hashes, params)[:2]


def _kept(params: SuffixParams):
    lengths = params.compared

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, grams, leads, counts, order = [], [], [], [], []
            for text in batch.column(2):
                hashes = WORDS.of(text.as_py().split())
                at, g, runs = chosen(hashes, params)
                order.append(run_hashes(hashes, lengths, at).view(np.int64).ravel() if len(at) else [])
                places.append(at.tolist())
                grams.append(g.view(np.int64).tolist())
                leads.append((at - (np.cumsum(runs) - runs)).tolist())
                counts.append(runs.tolist())
            small = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(places, small), pa.array(grams, pa.list_(pa.int64())), pa.array(leads, small), pa.array(counts, small), pa.array(order, pa.list_(pa.int64()))], ["doc_id", "uid", "at", "gram", "lead", "runs", "order"])

    return run


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Suffixes in order -> each pair of neighbours with one gram, the later of the two documents first; and each partition's two ends."""
    names, part, last = ["doc", "uid", "at"], TaskContext.get().partitionId(), None
    schema = pa.schema([("doc", pa.int64()), ("uid", pa.int64()), ("at", pa.int32()), ("source_doc", pa.int64()), ("source_uid", pa.int64()), ("apart", pa.int32()), ("gram", pa.int64()), ("part", pa.int32()), ("end", pa.int32())])

    def end(row: tuple, which: int) -> pa.RecordBatch:
        gram, doc, uid, at = row
        return pa.RecordBatch.from_pylist([{"gram": gram, "doc": doc, "uid": uid, "at": at, "part": part, "end": which}], schema)

    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(n).to_numpy() for n in ["gram", *names]]
        if last is None:
            yield end(tuple(int(c[0]) for c in columns), 1)
        else:
            columns = [np.concatenate([[v], c]) for v, c in zip(last, columns, strict=True)]
        last = tuple(int(c[-1]) for c in columns)
        same = np.flatnonzero(columns[0][:-1] == columns[0][1:])
        a, b = ([c[same + k] for c in columns[1:]] for k in (0, 1))
        swap = (a[0] > b[0]) | ((a[0] == b[0]) & ((a[1] > b[1]) | ((a[1] == b[1]) & (a[2] > b[2]))))
        early, late = ([np.where(swap, y, x) for x, y in zip(p, q, strict=True)] for p, q in ((a, b), (b, a)))
        none = pa.nulls(len(same), pa.int32())
        columns = [*late[:2], late[2].astype(np.int32), *early[:2], (late[2] - early[2]).astype(np.int32)]
        yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.nulls(len(same), pa.int64()), none, none], schema=schema)
    if last is not None:
        yield end(last, 2)


def _around(params: SuffixParams):
    """Documents with requests (run, side, start, end) -> the words before start, nearest first, a digest of those of the run, and from end on."""
    reach, names = params.words, ["run", "side", "before", "middle", "after"]
    types = [pa.int64(), pa.int32(), pa.string(), pa.binary(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, held = [[] for _ in names], 0
            for text, requests in zip(batch.column(0), batch.column(1), strict=True):
                words = text.as_py().split()
                for r in requests.as_py():
                    start, end = r["start"], r["end"]
                    for column, value in zip(out, (r["run"], r["side"], " ".join(words[max(0, start - reach) : start][::-1]), blake2b(" ".join(words[start:end]).encode("utf-8", "surrogatepass"), digest_size=20).digest(), " ".join(words[end : end + reach])), strict=True):
                        column.append(value)
                    held += 2 * reach
                if held > 500_000:  # words
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names)
                    out, held = [[] for _ in names], 0
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names)

    return run


def _agree(a: str, b: str) -> int:
    """How many words two texts have in common from the left."""
    x, y = a.split(" ") if a else [], b.split(" ") if b else []
    return next((k for k, (v, w) in enumerate(zip(x, y)) if v != w), min(len(x), len(y)))  # noqa: B905  one may be shorter


def _extended(params: SuffixParams):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            sides = {n: batch.column(n).to_pylist() for n in ("before_0", "before_1", "after_0", "after_1", "middle_0", "middle_1")}
            lefts = np.array([_agree(a, b) for a, b in zip(sides["before_0"], sides["before_1"], strict=True)], np.int64)
            rights = np.array([_agree(a, b) for a, b in zip(sides["after_0"], sides["after_1"], strict=True)], np.int64)
            start, end = batch.column("start").to_numpy() - lefts, batch.column("end").to_numpy() + rights
            source = batch.column("source_start").to_numpy() - lefts
            equal = np.array([a == b for a, b in zip(sides["middle_0"], sides["middle_1"], strict=True)], bool)
            rows = pa.RecordBatch.from_arrays([*(batch.column(n) for n in names[:4]), pa.array(start), pa.array(end), pa.array(source)], [*names[:4], "start", "end", "source_start"])
            yield rows.filter(pa.array(equal & (end - start >= params.words)))

    return run


def _unsettled(params: SuffixParams):
    """A document's shared suffixes and found passages -> the starts of runs of `words` words that no passage holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = batch.column("places").offsets.to_numpy()
            flat = batch.column("places").values
            start, end, open_ = (flat.field(n).to_numpy(zero_copy_only=False) for n in ("start", "end", "open"))
            out = []
            for a, b in zip(ends[:-1], ends[1:], strict=True):
                left = np.zeros(max(0, int(end[a:b].max())), bool)
                for k in sorted(range(a, b), key=lambda k: not open_[k]):
                    left[start[k] : end[k]] = open_[k]
                out.append(np.flatnonzero(left).tolist())
            rows = pa.RecordBatch.from_arrays([batch.column("uid"), batch.column("doc"), pa.array(out, pa.list_(pa.int32()))], ["uid", "doc", "starts"])
            yield rows.filter(pa.array([bool(x) for x in out], pa.bool_()))

    return run


def _whole_runs(params: SuffixParams):
    """Documents with starts of runs of `words` words -> a row for each with the run's hash, in two halves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uid, doc, text, starts in zip(*(batch.column(n) for n in ("uid", "doc", "text", "starts")), strict=True):
                at = starts.values.to_numpy()
                hashes = WORDS.of(text.as_py().split())
                halves = [run_hashes(x, [params.words], at).view(np.int64).ravel() for x in (hashes, mix(hashes ^ np.uint64(0xA5A5A5A5)))]
                n = len(at)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, doc.as_py(), np.int64)), pa.array(np.full(n, uid.as_py(), np.int64)), pa.array(at), *map(pa.array, halves)], ["doc", "uid", "at", "key", "key2"])

    return run


def _runs(linked: DataFrame, size: int) -> DataFrame:
    """Neighbours at one distance, each equal for `size` words, joined where they touch."""
    line = Window.partitionBy("uid", "source_uid", "apart").orderBy("at")
    cut = F.coalesce((F.col("at") - F.lag("at").over(line) > size).cast("int"), F.lit(1))
    runs = linked.withColumn("_cut", cut).withColumn("_run", F.sum("_cut").over(line)).groupBy("uid", "source_uid", "apart", "_run")
    return runs.agg(F.min("doc").alias("doc"), F.min("source_doc").alias("source_doc"), F.min("at").cast("long").alias("start"), (F.max("at") + size).cast("long").alias("end"))


def _back(c: str):
    return F.when(F.col(c) < 2**63 - 1, F.col(c))


def _identified(documents: DataFrame) -> DataFrame:
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    return docs.select("doc_id", F.xxhash64("doc_id", "text").alias("uid"), "text")


def _matches(docs: DataFrame, params: SuffixParams) -> DataFrame:
    """(doc_id, uid, source_doc_id, source_uid, start, end, source_start) of passages that an earlier place holds too."""
    listed = "doc_id long, uid long, at array<int>, gram array<long>, lead array<int>, runs array<int>, order array<long>"
    kept = stage(docs.mapInArrow(_kept(params), listed).filter("size(at) > 0"), "suffixes")
    once = kept.dropDuplicates(["uid"])
    width = len(params.compared)
    ranks = F.transform("at", lambda _, i: F.slice("order", i * width + 1, width))
    suffixes = once.select(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("doc"), "uid", F.explode(F.arrays_zip("gram", "at", "lead", "runs", ranks.alias("ranks"))).alias("s"))
    suffixes = suffixes.select("doc", "uid", "s.gram", "s.at", "s.lead", "s.runs", *[F.col("s.ranks")[k].alias(f"rank{k}") for k in range(width)])

    # Written down, so that the join has a plain exchange on both sides and a hot gram's suffixes can be split among tasks.
    shared = stage(kept.select(F.explode("gram").alias("gram")).groupBy("gram").agg(F.count("*").alias("n")).filter("n > 1").select("gram"), "shared")
    repeated = stage(suffixes.join(shared.hint("merge"), "gram"), "repeated")
    unstage(kept, shared)
    order = ["gram", *[f"rank{k}" for k in range(width)], "doc", "uid", "at"]
    sorted_ = repeated.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).select("gram", "doc", "uid", "at")
    met = stage(sorted_.mapInArrow(_neighbours, "doc long, uid long, at int, source_doc long, source_uid long, apart int, gram long, part int, end int"), "neighbours")
    linked = met.filter("end is null").select("doc", "uid", "at", "source_doc", "source_uid", "apart")
    # Two rows for each partition of the sort: its last suffix and the next one's first are neighbours too.
    line = Window.orderBy("part", "end")
    me = F.struct("doc", "uid", "at")
    ends = met.filter("end is not null").select("gram", "part", "end", me.alias("me"), F.lag(F.struct("gram", "part", me.alias("me"))).over(line).alias("b"))
    ends = ends.filter("end = 1 and b.gram = gram").select(F.greatest("me", "b.me").alias("l"), F.least("me", "b.me").alias("e"))
    linked = linked.unionByName(ends.select("l.doc", "l.uid", "l.at", F.col("e.doc").alias("source_doc"), F.col("e.uid").alias("source_uid"), (F.col("l.at") - F.col("e.at")).alias("apart")))

    runs = stage(_runs(linked, params.gram).withColumn("run", F.monotonically_increasing_id()), "runs")

    def side(k: int, uid: str, shift) -> DataFrame:
        return runs.select(F.col(uid).alias("uid"), F.struct("run", F.lit(k).alias("side"), (F.col("start") - shift).alias("start"), (F.col("end") - shift).alias("end")).alias("request"))

    # A suffix has two neighbours, so a document's requests are bounded by its words.
    requests = side(0, "uid", F.lit(0)).unionByName(side(1, "source_uid", F.col("apart"))).groupBy("uid").agg(F.collect_list("request").alias("requests"))
    around = docs.select("uid", "text").join(requests, "uid").select("text", "requests").mapInArrow(_around(params), "run long, side int, before string, middle binary, after string")
    one = [F.max(F.when(F.col("side") == k, F.col(c))).alias(f"{c}_{k}") for c in ("before", "middle", "after") for k in (0, 1)]
    both = around.groupBy("run").agg(*one).join(runs, "run")
    both = both.select(_back("doc").alias("doc_id"), "uid", _back("source_doc").alias("source_doc_id"), "source_uid", "start", "end", (F.col("start") - F.col("apart")).cast("long").alias("source_start"), "before_0", "before_1", "middle_0", "middle_1", "after_0", "after_1")
    found = stage(both.mapInArrow(_extended(params), "doc_id long, uid long, source_doc_id long, source_uid long, start long, end long, source_start long"), "found")
    unstage(met, runs)
    return found.unionByName(_others(docs, repeated, found, params))


def _others(docs: DataFrame, shared: DataFrame, found: DataFrame, params: SuffixParams) -> DataFrame:
    """Repeats like `found` that lie in none of the found passages, run by run of `words` words."""
    first = F.col("at") - F.col("lead")
    places = shared.select("uid", "doc", F.struct(first.alias("start"), (first + F.col("runs")).alias("end"), F.lit(True).alias("open")).alias("place"))
    settled = found.select("uid", F.coalesce("doc_id", F.lit(2**63 - 1)).alias("doc"), F.struct(F.col("start").cast("int").alias("start"), (F.col("end") - params.words + 1).cast("int").alias("end"), F.lit(False).alias("open")).alias("place"))
    # A document has no more places than words, since each passage found comes from a suffix of its own.
    places = places.unionByName(settled).groupBy("uid", "doc").agg(F.collect_list("place").alias("places"))
    starts = places.mapInArrow(_unsettled(params), "uid long, doc long, starts array<int>")
    whole = stage(docs.select("uid", "text").join(starts, "uid").mapInArrow(_whole_runs(params), "doc long, uid long, at int, key long, key2 long"), "whole")
    me = F.struct("doc", "uid", "at")
    sources = whole.groupBy("key", "key2").agg(F.count("*").alias("_n"), F.min(me).alias("first")).filter("_n > 1").select("key", "key2", "first")
    # A sort-merge join, so that a run in very many documents can be split among tasks.
    linked = whole.join(sources.hint("merge"), ["key", "key2"]).filter(me != F.col("first")).select("doc", "uid", "at", F.col("first.doc").alias("source_doc"), F.col("first.uid").alias("source_uid"), (F.col("at") - F.col("first.at")).alias("apart"))
    return _runs(linked, params.words).select(_back("doc").alias("doc_id"), "uid", _back("source_doc").alias("source_doc_id"), "source_uid", "start", "end", (F.col("start") - F.col("apart")).cast("long").alias("source_start"))


def repeats(documents: DataFrame, params: SuffixParams | None = None) -> DataFrame:
    """doc_id, start_word, end_word (exclusive), source_doc_id and source_start_word of every passage that occurs earlier too."""
    found = _matches(_identified(documents), params or SuffixParams())
    return found.select("doc_id", F.col("start").alias("start_word"), F.col("end").alias("end_word"), "source_doc_id", F.col("source_start").alias("source_start_word"))


_TOKEN = re.compile(r"\S+")


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words in the spans and the white space after each of them."""
    words = [m.start() for m in _TOKEN.finditer(text)]
    out, at = [], 0
    for start, end in sorted(spans):
        begin = words[start] if start < len(words) else len(text)
        if begin > at:
            out.append(text[at:begin])
        at = max(at, words[end] if end < len(words) else len(text))
    out.append(text[at:])
    return "".join(out)


def without_repeats(documents: DataFrame, params: SuffixParams | None = None) -> DataFrame:
    """The documents without passages that an earlier place holds; `n_chars` follows the text, all other columns stay."""
    found = _matches(_identified(documents), params or SuffixParams())
    columns = documents.columns
    uid, cuts = fresh(columns, "_uid"), fresh(columns, "_spans")
    spans = found.groupBy(F.col("uid").alias(uid)).agg(F.collect_list(F.struct("start", "end")).alias(cuts))
    marked = documents.withColumn(uid, F.xxhash64(F.col("doc_id").cast("long"), whole_text())).join(spans, uid, "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [s.as_py() for s in batch.column(cuts)]
            texts = [t.as_py() if s is None else cut_words(t.as_py() or "", [(x["start"], x["end"]) for x in s]) for t, s in zip(batch.column("text"), found, strict=True)]
            arrays = {n: batch.column(n) for n in columns} | {"text": pa.array(texts, pa.string())}
            if "n_chars" in arrays:
                lengths = [n if s is None else len(t) for t, s, n in zip(texts, found, batch.column("n_chars").to_pylist(), strict=True)]
                arrays["n_chars"] = pa.array(lengths, batch.schema.field("n_chars").type)
            yield pa.RecordBatch.from_arrays([arrays[n] for n in columns], columns)

    return marked.select(*columns, cuts).mapInArrow(run, documents.schema)
