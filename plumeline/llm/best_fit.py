"""Best-fit decreasing packing of token sequences, exact over the whole corpus.

Best fit only looks at lengths, so it runs on the histogram of piece lengths (at most `capacity` rows, however many
documents there are): a segment tree over remaining capacities finds the tightest open bin for each length, and bins
with equal content lengths are kept as one run. Its moves say which ranks of a length go to which bins; Spark ranks
the pieces of a length and every piece looks up its place. Ranks are counted per (length, chunk) and offset by the
chunks before, so a length that a third of all pieces have is still ranked in many tasks.

Defined results: a null text is an empty one and has the single id 0; a null doc_id stays null. Special tokens written
out in a text are the ids that the library gives them. Repeated rows are packed as often as they come. An empty table
gives no rows. `pack_documents` reads doc_id and text alone; `pack` carries all columns of its input.
"""

from __future__ import annotations

import json
import os
import re
import struct
import unicodedata
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from tokenizers import Tokenizer

from plumeline.llm.common import fresh, stage, whole_text


class CapacityTree:
    """Segment tree over remaining capacities 0..capacity that finds the smallest one >= x with an open bin."""

    def __init__(self, capacity: int) -> None:
        self.size = 1 << capacity.bit_length()
        self.open = [0] * (2 * self.size)

    def add(self, capacity: int, bins: int) -> None:
        i = capacity + self.size
        while i:
            self.open[i] += bins
            i >>= 1

    def tightest(self, least: int) -> int | None:
        i = least + self.size
        if self.open[i]:
            return least
        while i > 1:  # up to the first right neighbour with open bins, then down its left edge
            if not i & 1 and self.open[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.open[2 * i] else 2 * i + 1
                return i - self.size
            i >>= 1
        return None


@dataclass(frozen=True)
class Move:
    """Pieces of `length` with ranks from `rank` on: `each` of them go to every one of `bins` bins from `first` on, from `offset` in the bin."""

    length: int
    rank: int
    first: int
    bins: int
    each: int
    offset: int


def best_fit_moves(histogram: dict[int, int], capacity: int) -> tuple[list[Move], int]:
    """Best-fit decreasing over a histogram of lengths; returns the moves and the number of bins."""
    tree, runs, moves, made = CapacityTree(capacity), defaultdict(list), [], 0

    def put(first: int, bins: int, left: int) -> None:
        if bins and left:
            runs[left].append((first, bins))
            tree.add(left, bins)

    for length in sorted(histogram, reverse=True):
        count, rank = histogram[length], 0
        while rank < count:
            left = tree.tightest(length)
            if left is None:  # open as many bins as the rest needs
                each = capacity // length
                first, bins, left = made, -(-(count - rank) // each), capacity
                made += bins
            else:
                first, bins = runs[left].pop()
                tree.add(left, -bins)
            # Once a bin takes a piece it is the tightest, so it takes as many of this length as it holds.
            each = left // length
            full = min(bins, (count - rank) // each)
            if full:
                moves.append(Move(length, rank, first, full, each, capacity - left))
                put(first, full, left - each * length)
                rank += full * each
            if full < bins and (rest := count - rank) < each:
                if rest:
                    moves.append(Move(length, rank, first + full, 1, rest, capacity - left))
                    put(first + full, 1, left - rest * length)
                    rank, full = count, full + 1
                put(first + full, bins - full, left)
    return moves, made


# ---------------------------------------------------------------------------------------------------------------- ids

#: What is not plain Latin text, where Python's case and composition rules are the tokenizer's; such texts go through it whole.
_OTHER = re.compile(r"[^\t-\r\x20-\x7e¡-įı-ɏ]")


def _byte_letters() -> list[str]:
    """The letter that stands for each byte: printable Latin-1 for itself, the others from U+0100 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    moved = {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(plain)))}
    return [moved.get(b, chr(b)) for b in range(256)]


class WordTokenizer:
    """Ids of a text by a `tokenizers` file. Its merges never cross words nor white space, so what is between spaces is
    encoded once and kept, and so are the words in it.

    At most twice `LIMIT` pieces are kept: a full generation becomes the old one, and what is still met moves to the new.
    """

    LIMIT = 250_000

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            kind = json.load(f)
        added = [t["content"] for t in kind.get("added_tokens", [])]
        self.added = re.compile("|".join(map(re.escape, added)) or "(?!)", re.IGNORECASE)
        #: How the added tokens begin, up to the first letter: without one of these a text holds none.
        self.heads = sorted({re.match(r"[\W\d]*", t)[0] for t in added})
        if [n["type"] for n in kind["normalizer"]["normalizers"]] != ["NFC", "Replace", "Lowercase"]:
            raise ValueError("this tokenizer normalises in another way")
        self.split = regex.compile(kind["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.model, self.letters = self.whole.model, _byte_letters()
        self.words: dict[str, bytes] = {}
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids. Texts with an added token, in whatever case, go through the library whole."""
        if _OTHER.search(text) or (any(h in text for h in self.heads) and self.added.search(text)):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        pieces = unicodedata.normalize("NFC", text).lower().split()
        known = self.known
        try:
            return b"".join([known[p] for p in pieces])
        except KeyError:
            self._learn(pieces)
            known = self.known
            return b"".join([known[p] for p in pieces])

    def _learn(self, pieces: list[str]) -> None:
        if len(self.known) > self.LIMIT:
            self.known, self.old = {}, self.known
        for piece in dict.fromkeys(pieces):
            if piece not in self.known:
                kept = self.old.get(piece)
                self.known[piece] = b"".join([self._word(w) for w in self.split.findall(piece)]) if kept is None else kept

    def _word(self, word: str) -> bytes:
        if (kept := self.words.get(word)) is None:
            if len(self.words) > self.LIMIT:
                self.words.clear()
            letters = word if word.isascii() else "".join([self.letters[b] for b in word.encode()])
            ids = [t.id for t in self.model.tokenize(letters)]
            self.words[word] = kept = struct.pack(f"<{len(ids)}I", *ids)
        return kept


_tokenizers: dict[str, WordTokenizer] = {}


def token_pieces(documents: DataFrame, tokenizer_path: str, capacity: int) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's ids and a final 0, cut where they exceed `capacity`."""
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer_path not in _tokenizers:
            _tokenizers[tokenizer_path] = WordTokenizer(tokenizer_path)
        tokenizer, step = _tokenizers[tokenizer_path], 4 * capacity
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = tokenizer.ids(text.as_py()) + b"\0\0\0\0"
                for piece, at in enumerate(range(0, len(data), step)):
                    part = data[at : at + step]
                    for column, value in zip(out, (doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    return docs.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(pieces: DataFrame, capacity: int, chunk_bits: int = 20, least_chunks: int = 64) -> DataFrame:
    """`pieces` (with a `length` from 1 to capacity) and their sequence_id and offset, by best-fit decreasing.

    Other columns, null ids among them, are carried along; input columns named sequence_id or offset give way.
    """
    pieces = pieces.drop("sequence_id", "offset")
    row, chunk, n, before, local, rank = (fresh(pieces.columns, c) for c in ("_row", "_chunk", "_n", "_before", "_local", "_rank"))
    numbered = stage(pieces.withColumn(row, F.monotonically_increasing_id()), "pieces")
    # Chunks of at most about 2**chunk_bits rows, so their table of offsets is far smaller than the pieces; never fewer
    # than `least_chunks`, since pieces of full length may be most of them and share one group in a chunk.
    chunks = max(least_chunks, -(-numbered.count() // (1 << chunk_bits)))
    numbered = numbered.withColumn(chunk, F.pmod(F.xxhash64(F.lit(7), row), F.lit(chunks)))
    counts = stage(numbered.groupBy("length", chunk).agg(F.count("*").alias(n)), "lengths")
    histogram = {r.length: r.total for r in counts.groupBy("length").agg(F.sum(n).alias("total")).collect()}  # <= capacity rows
    moves, _ = best_fit_moves(histogram, capacity)
    by_length: dict[int, list[Move]] = defaultdict(list)
    for m in moves:
        by_length[m.length].append(m)
    tables = {length: np.array([(m.rank, m.first, m.each, m.offset) for m in ms], np.int64).T for length, ms in by_length.items()}

    earlier = F.sum(n).over(Window.partitionBy("length").orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("length", chunk, F.coalesce(earlier, F.lit(0)).alias(before))
    place_ = F.row_number().over(Window.partitionBy("length", chunk).orderBy(row)) - 1
    ranked = numbered.withColumn(local, place_).join(offsets, ["length", chunk]).withColumn(rank, F.col(local) + F.col(before))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, ranks = batch.column("length").to_numpy(), batch.column(rank).to_numpy()
            sequence, offset = np.empty(len(ranks), np.int64), np.empty(len(ranks), np.int64)
            for length in np.unique(lengths):
                at = np.flatnonzero(lengths == length)
                start, first, each, begin = tables[int(length)]
                k = np.searchsorted(start, ranks[at], "right") - 1
                within = ranks[at] - start[k]
                sequence[at] = first[k] + within // each[k]
                offset[at] = begin[k] + within % each[k] * length
            keep = [c for c in batch.schema.names if c != rank]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(sequence), pa.array(offset)], [*keep, "sequence_id", "offset"])

    out = StructType([*pieces.schema.fields, StructField("sequence_id", LongType()), StructField("offset", LongType())])
    return ranked.select(*pieces.columns, rank).mapInArrow(place, out)


def pack_documents(documents: DataFrame, tokenizer_path: str, capacity: int = 2048) -> DataFrame:
    return pack(token_pieces(documents, tokenizer_path, capacity), capacity)
