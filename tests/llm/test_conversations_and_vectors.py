"""Conversation repair, bit-sliced search and whitening against plain versions."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from plumeline.llm import bit_slices, lanczos_whitening, turn_repair

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", ["op11_turn_repair", "op12_bit_sliced_topk"])
def test_agrees_with_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("conversations", "embeddings"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.sql(entry.oracle_sql()[name])
    got = entry.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(tuple, got.select(*want.columns).collect()), key=str) == sorted(want.fetchall(), key=str)


# ---- op11


def cheapest(rows):
    """(cost, audit, repaired) of (role, text, fault) rows: every path as (cost, audit, output), the least for each state kept."""
    turn = {0: "user", 1: "user", 2: "assistant", 3: "user"}

    def state(initial):
        return {"s": 1, "u": 2, "a": 3}[initial]

    def insert(best):
        for _ in range(3):
            for q, (c, a, out) in list(best.items()):
                new = (c + 2, a + "I", [*out, f"{turn[q]}:"])
                to = state(turn[q][0])
                if to not in best or new[:2] < best[to][:2]:
                    best[to] = new
        return best

    best = insert({0: (0, "", [])})
    for role, text, fault in rows:
        new = {}
        for q, (c, a, out) in best.items():
            ways = [(q, c + 3, a + "D", out)]
            if fault in ("", "truncated"):
                more = fault == "truncated"
                if role[:1] == turn[q][0] or (q == 0 and role[:1] == "s"):
                    ways.append((state(role[:1]), c + more, a + "K", [*out, f"{role}:{text}"]))
                ways.append((state(turn[q][0]), c + 2 + more, a + "R", [*out, f"{turn[q]}:{text}"]))
            for to, *way in ways:
                if to not in new or tuple(way[:2]) < new[to][:2]:
                    new[to] = tuple(way)
        best = insert(new)
    return min(best[q] for q in (0, 3) if q in best)


def repaired(table):
    """The contract's rows of (conv_id, turn, role, text), in plain Python."""
    damaged = defaultdict(list)
    for conv, turn, role, text in table:
        role, text = " " if role is None else role, " " if text is None else text
        by = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if by == 1 else re.sub("[.!?]", "", text) if by == 2 else text
        rows = damaged[conv]
        rows += [(turn, "user" if by == 4 else role, text)] * (0 if by == 0 else 2 if by == 3 else 1)
    for conv, rows in damaged.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256(f"{len(r[1])}:{r[1]}:{r[2]}".encode()).digest()))
        seen, faults = set(), []
        for _, role, text in rows:
            said = re.findall(r"[^\x20\x09-\x0D]", text)
            faults.append("blank" if not said else "duplicate" if (role, text) in seen else "" if said[-1] in ".!?" else "truncated")
            seen.add((role, text))
        turns = {t for t, _, _ in rows if t is not None}
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        cost, audit, out = cheapest([(r, t, f) for (_, r, t), f in zip(rows, faults)])
        count = Counter(faults)
        yield (conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def test_repair_with_every_kind_of_row(spark):
    rnd = random.Random(7)
    texts = ["Yes.", "no", "", " \t\n", "why?", "\x0b\x0c", None, "漢字!", "ends \x1c", "x" * 50_000 + ".", "two\nlines."]
    roles = ["user", "assistant", "system", "tool", None, "", "User", "admin", "sage"]
    made = [(c, t if rnd.random() < 0.9 else None, rnd.choice(roles[:3] if c % 3 else roles), rnd.choice(texts)) for c in range(60) for t in range(rnd.randint(1, 9))]
    made += [(None, t, rnd.choice(roles), rnd.choice(texts)) for t in range(6)] + [(100, t, "user" if t % 2 else "odd", f"{t}.") for t in range(300)]
    made += [(7, 3, "user", "again.")] * 4 + [(-5, None, None, None)] * 3
    df = spark.createDataFrame(made, "conv_id long, turn long, role string, text string").withColumn("copies", F.lit("clash")).withColumn("same", F.lit(1)).repartition(5)
    want = Counter(repaired(made))
    assert Counter(map(tuple, turn_repair.repair_summary(turn_repair.damage(df)).collect())) == want
    empty = turn_repair.repair_summary(turn_repair.damage(df.limit(0)))
    assert empty.count() == 0 and empty.columns[-2:] == ["audit", "repaired_sha256"]


def test_repaired_turns_give_the_texts(spark):
    rows = spark.createDataFrame([(1, 0, "user", "Hi."), (1, 1, "user", "Again?"), (1, 2, "assistant", ""), (2, 0, "user", " ")], "conv_id int, turn int, role string, text string")
    got = sorted(map(tuple, turn_repair.repaired_turns(rows).collect()))
    assert got == [(1, 0, "K", "user", "Hi."), (1, 1, "R", "assistant", "Again?")]


def test_a_conversation_whose_rows_are_all_dropped(spark):
    dropped = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    rows = spark.createDataFrame([(dropped, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    assert [tuple(r) for r in turn_repair.repair_summary(turn_repair.damage(rows)).collect()] == [(dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


@pytest.mark.parametrize("initials", ["suax", "x", "ua", "uuua"])
def test_long_conversations_are_renumbered(initials):
    rnd = random.Random(len(initials))
    names = ["", "blank", "duplicate", "truncated"]
    rows = [(rnd.choice(initials), "t", rnd.choice([0, 0, 0, 1, 2, 3])) for _ in range(700)]
    repair = turn_repair.Repair()
    for role, _, fault in rows:
        repair.add(role, fault)
    assert repair.best() == cheapest([(r, t, names[f]) for r, t, f in rows])[:2]


# ---- op12


def top(rows, queries, k, scale):
    """(query, rank, id, score), of rows (id, vector), by looking at every pair."""
    def usable(some):
        return [(i, [int(np.floor(np.float64(c) * scale)) for c in v]) for i, v in some if i is not None and v is not None and all(c is not None and np.isfinite(c) for c in v)]

    data = usable(rows)
    for i, q in usable(queries):
        found = sorted((-sum(a * b for a, b in zip(q, x)), j) for j, x in data if len(x) == len(q) and j != i)[:k]
        yield from ((i, n + 1, j, -s) for n, (s, j) in enumerate(found))


@pytest.mark.parametrize(("block", "queries"), [(8192, 512), (64, 4)])
def test_top_rows(spark, block, queries):
    rng = np.random.default_rng(block)
    vectors = [rng.standard_normal(8).tolist() for _ in range(300)] + [[0.5] * 8] * 60 + [[0.0] * 8, [], [1.0, 2.0], None, [None] * 8, [float("nan")] + [0.0] * 7, [float("inf")] * 8, [-0.001] * 8, [3000.7, -4000.2] * 4]
    made = [(i, v) for i, v in enumerate(vectors)] + [(None, [1.0] * 8), (20, vectors[3]), (40, vectors[40]), (-20, vectors[5])]
    df = spark.createDataFrame([(i, v, "x") for i, v in made], "id long, embedding array<double>, rank string").repartition(7)
    asked = [(i, v) for i, v in made if i is not None and i % 20 == 0]
    got = bit_slices.top_k(df, df.filter("id % 20 = 0"), bit_slices.SliceParams(k=20, scale=64, block=block, queries=queries))
    assert Counter(map(tuple, got.collect())) == Counter(top(made, asked, 20, 64))
    assert bit_slices.top_k(df.limit(0), df.limit(0)).count() == 0
    assert bit_slices.top_k(df, df.limit(0)).count() == 0


def test_fewer_candidates_than_k(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [-1.0, 0.5])], "id long, embedding array<float>")
    assert sorted(map(tuple, bit_slices.top_k(df, df.filter("id = 0")).collect())) == [(0, 1, 1, 4096), (0, 2, 2, -4096)]


def test_rounds_of_queries(spark, monkeypatch):
    monkeypatch.setattr(bit_slices, "SENT", 2000)
    rng = np.random.default_rng(1)
    made = [(i, v.tolist()) for i, v in enumerate(rng.standard_normal((200, 6)))]
    df = spark.createDataFrame(made, "id long, embedding array<double>")
    got = bit_slices.top_k(df, df.filter("id % 4 = 0"), bit_slices.SliceParams(k=3, block=50, queries=5))
    assert Counter(map(tuple, got.collect())) == Counter(top(made, made[::4], 3, 64))


@pytest.mark.parametrize("most", [3, 40, 5000])
def test_sums_of_slices(most):
    rng = np.random.default_rng(most)
    x, q = rng.integers(-most, most + 1, (130, 9)), rng.integers(-most, most + 1, (11, 9))
    least, bits = bit_slices.slices(x)
    total, surplus = bit_slices.block_sums(bits, q)
    got = sum(np.unpackbits(s.view(np.uint8), axis=1, bitorder="little").astype(np.int64) << i for i, s in enumerate(total))[:, :130]
    assert (got - surplus[:, None] + (q @ least)[:, None] == q @ x.T).all()


# ---- op13


def whitened(vectors, most=4):
    """Kept rows' x, n, deviations, whitened values, shares, by an eigendecomposition of the whole covariance."""
    x = np.array([[int(np.floor(256 * np.float64(c))) for c in v] for v in vectors])
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    centred = fit - sums / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1][:most], axes[:, ::-1][:, :most]
    deviation = [sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, sums)) for row in x]
    return n, deviation, (x - sums / n) @ axes / np.sqrt(values), values / np.trace(centred.T @ centred / n), values


def by_row(df):
    rows = df.orderBy("vec_id", "component").collect()
    ids = sorted({r.vec_id for r in rows})
    return ids, rows, np.array([r.whitened for r in rows]).reshape(len(ids), -1)


def test_whitening_agrees_with_an_eigendecomposition(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    n, deviation, white, share, _ = whitened([r.embedding for r in rows])
    ids, got, values = by_row(entry.queries()["op13_lanczos_whitening"](spark, SF))
    assert ids == [r.vec_id for r in rows] and {r.n for r in got} == {n}
    assert [r.deviation for r in got[::4]] == deviation
    assert np.allclose([r.explained for r in got[:4]], share, rtol=1e-10)
    assert got[0].identity_error < 1e-10 and len({r.identity_error for r in got}) == 1
    signs = np.sign((values * white).sum(axis=0))
    assert np.abs(values - white * signs).max() < 1e-9


def test_whitening_takes_any_rows(spark):
    rng = np.random.default_rng(2)
    vectors = (rng.standard_normal((40, 5)) * [5, 3, 2, 1, 0.5]).tolist()
    made = [(i, v) for i, v in enumerate(vectors)] + [(50, vectors[0])] * 30 + [(51, None), (52, [None] * 5), (53, [float("inf")] * 5), (54, []), (None, vectors[1]), (55, [1.0, 2.0]), (56, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, 1.0) for i, v in made], "vec_id long, embedding array<double>, whitened double").repartition(3)
    got = lanczos_whitening.whiten(df).collect()
    n, deviation, white, _, _ = whitened(vectors)
    assert {r.n for r in got} == {40} == {n}  # equal vectors of length 2 have no variance, and those of length 0 no component
    assert Counter(r.vec_id for r in got) == Counter([*range(40), *[50] * 30, None] * 4)
    for c in range(1, 5):
        first = np.array([r.whitened for r in sorted((r for r in got if r.component == c and r.vec_id is not None and r.vec_id < 40), key=lambda r: r.vec_id)])
        assert min(np.abs(first - s * white[:, c - 1]).max() for s in (1, -1)) < 1e-9
    assert {r.deviation for r in got if r.vec_id == 50} == {deviation[0]}
    assert lanczos_whitening.whiten(df.limit(0)).count() == 0


def test_equal_eigenvalues_are_all_found(spark):
    corners = [[sign * 4.0 if i == j else 0.0 for j in range(6)] for i in range(6) for sign in (1, -1)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(corners)], "vec_id long, embedding array<double>")
    got = lanczos_whitening.whiten(df).collect()
    assert len(got) == 48 and got[0].identity_error < 1e-10
    assert np.allclose([r.explained for r in got], 1 / 6)


def test_deviations_beyond_a_long_are_null(spark):
    df = spark.createDataFrame([(i, [2e5 * i, 1.0 * (i % 7)]) for i in range(40)], "vec_id long, embedding array<double>")
    got = lanczos_whitening.whiten(df).collect()
    sums = [sum(51_200_000 * i for i in range(40)), sum(256 * (i % 7) for i in range(40))]
    for r in got:
        exact = (40 * 51_200_000 * r.vec_id - sums[0]) ** 2 + (40 * 256 * (r.vec_id % 7) - sums[1]) ** 2
        assert r.deviation == (exact if exact < 1 << 63 else None)
    assert any(r.deviation is None for r in got)
