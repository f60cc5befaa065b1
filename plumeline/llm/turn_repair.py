"""Conversation structure repair: the cheapest edits that make a conversation's roles alternate.

The edits of a conversation are a path through a directed acyclic graph whose nodes are (row, inserts since that row, state of the
role pattern `(s?(ua)+)?`). Every edge has one integer as its weight: the high digits are the edit's cost, and the low ones, a fixed
number of them, hold its letter at the position that it takes in the audit; what lies behind the audit's end is zero. The least
integer is therefore the least cost and, among equals, the audit that comes first in ASCII, so that taking the minimum of ordinary
integers decides everything. A cost follows from an audit's letters and the rows, so of two equally cheap paths to a node neither
audit begins with the other; what is least at a node stays least whatever follows.

The number of digits is the same for every conversation. When they run out, the few paths that are still open are renumbered: what
they have written goes to a list that paths share, and one digit keeps their order. So each row costs the same, however long a
conversation is, and what grows with it is its audit alone.

Rows are dealt by conversation and stream through a task in order, first as codes of a few bytes, which decide the edits, then with
their texts, which are hashed or edited as they pass. No conversation's rows are ever held together. One conversation is one stream,
since one SHA-256 digest over its text is a chain.

Defined results: a null role or text is one space, and so is a null conv_id or turn in the damage's key; rows with a null conv_id
are a conversation. Rows of one turn are taken in order of the SHA-256 of role and text, so equal rows stay together. An empty role has no initial. An
empty table gives no rows. Extra columns are not read. Texts are taken whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What counts as blank: space and the controls from tab to carriage return.
BLANK = " \t\n\x0b\x0c\r"
FINE, BLANK_ROW, DUPLICATE, TRUNCATED = range(4)
COST = {"K": 0, "R": 2, "D": 3, "I": 2}
LETTERS = "DIKR"  # in ASCII order: a letter's digit is its place here, from 1
#: Bits of a digit, and digits of an audit that a weight holds.
BITS, WIDTH = 3, 64
ONE = 1 << (BITS * WIDTH)

#: States of the pattern: nothing yet, after s, after u, after a. From each: initial that may be kept -> next state.
KEEPS = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
#: The role that a changed or inserted row takes, and the state after it.
TURNS = (("user", 2), ("user", 2), ("assistant", 3), ("user", 2))
ENDS = (0, 3)
#: Adjacent initials that are in order.
LEGAL = {"su", "ua", "au"}


class Repair:
    """The cheapest audit of one conversation, whose rows are added one by one."""

    def __init__(self) -> None:
        self.cost = 0
        #: For each state the best path to it: its weight, the digits in use, and what was written before them.
        self.paths: list[tuple[int, int, tuple | None] | None] = [(0, 0, None), None, None, None]
        self._insert()

    def _insert(self) -> None:
        paths = self.paths
        for state in range(4):  # in this order one pass is enough: more than two inserts in a row never pay
            if paths[state]:
                weight, used, before = paths[state]
                weight += (COST["I"] * ONE) + ((LETTERS.index("I") + 1) << (BITS * (WIDTH - 1 - used)))
                to = TURNS[state][1]
                if paths[to] is None or weight < paths[to][0]:
                    paths[to] = (weight, used + 1, before)

    def add(self, initial: str, fault: int) -> None:
        after: list = [None] * 4
        short = ONE if fault == TRUNCATED else 0
        for state, path in enumerate(self.paths):
            if path is None:
                continue
            weight, used, before = path
            digit = BITS * (WIDTH - 1 - used)
            ways = [(3 * ONE + (1 << digit), state)]
            if fault not in (BLANK_ROW, DUPLICATE):
                if initial in KEEPS[state]:
                    ways.append((short + (3 << digit), KEEPS[state][initial]))
                ways.append((2 * ONE + short + (4 << digit), TURNS[state][1]))
            for more, to in ways:
                if after[to] is None or weight + more < after[to][0]:
                    after[to] = (weight + more, used + 1, before)
        self.paths = after
        self._insert()
        if max(p[1] for p in after if p) + 4 > WIDTH:
            self._renumber()

    def _renumber(self) -> None:
        """Replace the digits that open paths have written by one that keeps their order; common cost goes to `cost`."""
        low = min(p[0] for p in self.paths if p) // ONE
        self.cost += low
        root, rank, before = None, 0, None
        for state in sorted((s for s in range(4) if self.paths[s]), key=lambda s: self.paths[s][0] % ONE):
            weight, used, old = self.paths[state]
            digits = weight % ONE
            # A path whose audit goes on from another's keeps the digits behind it.
            if root is None or digits >> (BITS * (WIDTH - root[1])) != root[0]:
                root, rank, before = (digits >> (BITS * (WIDTH - used)), used), rank + 1, (old, self._letters(digits, used, old))
            tail = used - root[1]
            rest = (digits >> (BITS * (WIDTH - used))) & ((1 << (BITS * tail)) - 1)
            digits = (rank << (BITS * (WIDTH - 1))) | (rest << (BITS * (WIDTH - 1 - tail)))
            self.paths[state] = ((weight // ONE - low) * ONE + digits, 1 + tail, before)

    @staticmethod
    def _letters(digits: int, used: int, before: tuple | None) -> str:
        first = 0 if before is None else 1  # the first digit stands for what was written before
        return "".join(LETTERS[((digits >> (BITS * (WIDTH - 1 - i))) & 7) - 1] for i in range(first, used))

    def best(self) -> tuple[int, str]:
        """(cost, audit)."""
        weight, used, before = min(self.paths[s] for s in ENDS if self.paths[s])
        pieces = [self._letters(weight % ONE, used, before)]
        while before is not None:
            before, piece = before
            pieces.append(piece)
        return self.cost + weight // ONE, "".join(reversed(pieces))


def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies): rows emptied, cut, repeated or given another role by the hash of conversation and turn.

    A dropped row has no copies; it still names its conversation.
    """
    def known(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    rows = conversations.select("conv_id", "turn", known("role").alias("role"), known("text").alias("text"), (F.crc32(F.concat(known("conv_id"), F.lit(":"), known("turn"))) % 20).alias("_by"))
    text = F.when(F.col("_by") == 1, "").when(F.col("_by") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("_by") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("_by") == 0, 0).when(F.col("_by") == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copies"))


def _marked(rows: DataFrame) -> DataFrame:
    """The rows with `same`, equal for equal role and text."""
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    rows = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), "copies")
    return rows.withColumn("same", F.unhex(F.sha2(F.concat_ws(":", F.length("role"), "role", "text"), 256)))


def _coded(rows: DataFrame) -> DataFrame:
    """A row's initial, fault and copies, the rows of a conversation in one partition and in order."""
    said = F.rtrim(F.col("text"), F.lit(BLANK))
    short = ~F.substring(said, -1, 1).isin(".", "!", "?")
    fault = F.when(said == "", BLANK_ROW).when(short, TRUNCATED).otherwise(FINE)
    return rows.select("conv_id", "turn", "same", F.substring("role", 1, 1).alias("initial"), fault.alias("fault"), "copies")


SUMMARY = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _decided(kind: pa.DataType):
    """Coded rows in order -> a row for each conversation: counts of faults, cost and audit."""
    schema = pa.schema([("conv_id", kind), *[(c, pa.int64()) for c in SUMMARY], ("audit", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        this, repair = object(), None
        faults, illegal, last, turns, first, turn = [0] * 4, 0, None, 0, None, None
        done: list[tuple] = []

        def close() -> None:
            if repair is not None:
                done.append((this, 0 if first is None else turn - first + 1 - turns, *faults[1:], illegal, *repair.best()))

        for batch in batches:
            for conv, at, initial, fault, copies, again in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "turn", "initial", "fault", "copies", "again")], strict=True):
                if repair is None or conv != this:
                    close()
                    this, repair = conv, Repair()
                    faults, illegal, last, turns, first, turn = [0] * 4, 0, None, 0, None, None
                for copy in range(copies):
                    if (copy or again) and fault != BLANK_ROW:
                        fault = DUPLICATE
                    faults[fault] += 1
                    illegal += last is not None and last + initial not in LEGAL
                    last = initial
                    if at is not None and (turn is None or at != turn):
                        first, turn, turns = at if first is None else first, at, turns + 1
                    repair.add(initial, fault)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), schema)], schema=schema)
                done = []
        close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), schema)], schema=schema)

    return run


def _edited(audit: str, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of each kept, changed or inserted row; `rows` are taken only as the audit needs them."""
    state = 0
    for letter in audit:
        if letter == "D":
            next(rows)
            continue
        if letter == "K":
            role, text = next(rows)
            state = KEEPS[state][role[:1]]
        else:
            text = "" if letter == "I" else next(rows)[1]
            role, state = TURNS[state]
        yield letter, role, text


def _stream(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[tuple, Iterator[tuple[str, str]]]]:
    """For each conversation its head (the values of `columns`) and its rows, which stream by; they must be taken before the next."""
    flow = (row for batch in batches for row in zip(*[batch.column(c).to_pylist() for c in ("kind", "role", "text", "copies", *columns)], strict=True))
    head = next(flow, None)
    while head is not None:
        following: list = []

        def rows(out=following) -> Iterator[tuple[str, str]]:
            for kind, role, text, copies, *rest in flow:
                if kind == 0:
                    out.append((kind, role, text, copies, *rest))
                    return
                for _ in range(copies):
                    yield role, text

        taken = rows()
        yield head[4:], taken
        for _ in taken:
            pass
        head = following[0] if following else None


def _digested(schema: pa.Schema):
    names = [n for n in schema.names if n != "repaired_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        for head, rows in _stream(batches, names):
            digest, between = hashlib.sha256(), b""
            for _, role, text in _edited(head[-1], rows):
                digest.update(between + role.encode() + b":" + text.encode())
                between = b"\n"
            done.append((*head, digest.hexdigest()))
            if len(done) == 4096:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), schema)], schema=schema)
                done = []
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), schema)], schema=schema)

    return run


def _rewritten(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        held = 0
        for (conv, audit), rows in _stream(batches, ["conv_id", "audit"]):
            for place, (edit, role, text) in enumerate(_edited(audit, rows)):
                done.append((conv, place, edit, role, text))
                held += len(text)
                if len(done) == 4096 or held > 1 << 24:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), schema)], schema=schema)
                    done, held = [], 0
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), schema)], schema=schema)

    return run


def _key(df: DataFrame) -> tuple[str, pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_type

    kind = df.schema["conv_id"].dataType
    return kind.simpleString(), to_arrow_type(kind)


def audits(rows: DataFrame) -> DataFrame:
    """conv_id, counts of faults, cost and audit of each conversation of `rows` (conv_id, turn, role, text, copies)."""
    from pyspark.sql import Window

    sql, kind = _key(rows)
    coded = _coded(_marked(rows)).repartition("conv_id")
    # The window and the order that follows need rows of a conversation together, which they are: nothing moves again.
    seen = F.sum("copies").over(Window.partitionBy("conv_id", "same").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1))
    ordered = coded.withColumn("again", F.coalesce(seen, F.lit(0)) > 0).sortWithinPartitions("conv_id", "turn", "same")
    counts = ", ".join(f"{c} long" for c in SUMMARY)
    return ordered.mapInArrow(_decided(kind), f"conv_id {sql}, {counts}, audit string")


def _headed(rows: DataFrame) -> DataFrame:
    """The rows behind a head for each conversation, which has its audit, in order."""
    found = audits(rows)
    more = [*SUMMARY, "audit"]
    heads = found.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit(None).cast("binary").alias("same"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), F.lit(0).alias("copies"), *more)
    body = _marked(rows).filter("copies > 0").select("conv_id", F.lit(1).alias("kind"), "turn", "same", "role", "text", "copies", *[F.lit(None).cast("string" if c == "audit" else "long").alias(c) for c in more])
    return heads.unionByName(body).repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "same")


def repaired_turns(rows: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, place (from 0), edit (K, R or I), role and text.

    `rows` has conv_id, turn, role, text; a column `copies` says how often a row counts (else once).
    """
    rows = rows if "copies" in rows.columns else rows.withColumn("copies", F.lit(1))
    sql, kind = _key(rows)
    schema = pa.schema([("conv_id", kind), ("place", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])
    return _headed(rows).mapInArrow(_rewritten(schema), f"conv_id {sql}, place long, edit string, role string, text string")


def repair_summary(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 of each conversation."""
    sql, kind = _key(rows)
    schema = pa.schema([("conv_id", kind), *[(c, pa.int64()) for c in SUMMARY], ("audit", pa.string()), ("repaired_sha256", pa.string())])
    counts = ", ".join(f"{c} long" for c in SUMMARY)
    return _headed(rows).mapInArrow(_digested(schema), f"conv_id {sql}, {counts}, audit string, repaired_sha256 string")
