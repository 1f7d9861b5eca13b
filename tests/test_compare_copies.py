import random

import numpy as np

from lonja.operators import compare_copies as cc

FIELDS = {"f": ("date", None), "v": ("ticker", None), "n": ("number", 0.005)}
SCHEMA = "id long, f date, v string, n double, cubeta int, k string"


def run(spark, a, b, **more):
    side = lambda rows: spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    return {(r["id"], r["campo"]) for r in cc.compare_copies(side(a), side(b), "id", FIELDS, "solo_a", "solo_b", **more).collect()}


def test_every_kind(spark):
    import datetime as dt

    d = dt.date(2024, 1, 1)
    a = [(1, d, "A", 1.0), (2, d, "A", 2.0), (3, d, " a", 3.0), (4, None, None, None), (5, d, "B", 5.0), (6, d, "C", float("nan")), (8, d, "D", 2.466), (9, d, "E", 1.0), (None, d, "N", 1.0)]
    b = [(1, d, "A", 1.004), (2, d, "A", 2.02), (3, d, "A ", 3.0), (4, None, None, None), (5, dt.date(2024, 1, 2), "X", None), (6, d, "C", None), (7, d, "Z", 1.0), (8, d, "D", 2.474), (9, d, "E", 1.0), (9, d, "E", 1.0)]
    assert run(spark, a, b) == {(2, "n"), (5, "f"), (5, "v"), (5, "n"), (7, "solo_b"), (8, "n")}
    assert run(spark, a, []) == {(i, "solo_a") for i in (1, 2, 3, 4, 5, 6, 8, 9)}
    assert run(spark, [], []) == set()


def test_random_against_brute_force_few_and_many_differences(spark):
    r = random.Random(3)
    for share in (0.01, 0.6):
        a = [(i, None, f"T{r.randrange(9)}", round(r.random() * 100, 2)) for i in range(3000)]
        b = [(i, f, v, n + 1 if r.random() < share else n + r.uniform(-0.0024, 0.0024)) for i, f, v, n in a if r.random() > share / 5]
        b += [(10_000 + i, None, "T", 1.0) for i in range(int(100 * share))] + b[:20]
        da, db = {x[0]: x for x in a}, {x[0]: x for x in b}
        want = {(i, "solo_a") for i in da if i not in db} | {(i, "solo_b") for i in db if i not in da} | {(i, "n") for i in da if i in db and abs(da[i][3] - db[i][3]) > 0.005}
        assert run(spark, a, b, rows_per_bucket=500 if share < 0.1 else 3000) == want  # the second overflows its tables


def test_peeling_reports_overflow():
    rng = np.random.default_rng(4)
    bits = 9
    size = 3 << bits
    t = np.zeros((size, 6), dtype=np.int64)
    for _ in range(size * 2):
        t[rng.integers(0, size, 3)] += [1, int(rng.integers(0, 2**31)), 0, int(rng.integers(0, 2**31)), 0, 1]
    rows = np.flatnonzero(t.any(axis=1))
    assert cc.peel(rows, t[rows], bits)[1] is False


def test_keys_far_off_negative_and_sparse(spark):
    """A few keys far from the rest don't widen the buckets of the others; hashed keys have buckets too."""
    near = [(i, None, "A", 1.0) for i in range(2000)]
    far = [(2**62, None, "A", 1.0), (-(2**62), None, "B", 2.0), (-5, None, "C", 3.0)]
    wild = [(hash(("k", i)) * 2654435761 % 2**63 - 2**62, None, "W", 1.0) for i in range(500)]
    for a in (near + far, wild, wild + near):
        b = [(i, f, v, n + (i % 97 == 0)) for i, f, v, n in a[5:]]
        assert run(spark, a, b, rows_per_bucket=200) == {(x[0], "solo_a") for x in a[:5]} | {(x[0], "n") for x in a[5:] if x[0] % 97 == 0}
    left = spark.createDataFrame([(*x, 1, "x") for x in near + far], SCHEMA)
    assert cc.block_bits(left, left, "id", 200) == 8


def test_alike_runs_send_no_cells(spark, monkeypatch):
    side = lambda change: spark.createDataFrame([(i, None, "A", 2.0 if i == change else 1.0, 1, "x") for i in range(5000)], SCHEMA)
    a, b = (cc._hashed(side(c), "id", [cc.F.col("n")], 10) for c in (None, 77))
    assert [tuple(r) for r in cc.differing_runs(a, b).collect()] == [(0, 1)]
    found, _ = cc.differing_keys(side(None), side(77), "id", [cc.F.col("n")], [cc.F.col("n")], 1024)
    assert [(r["k"], r["pelado"]) for r in found.collect()] == [(77, True)]


def test_tables_that_cannot_be_sent_by_size(spark, monkeypatch):
    monkeypatch.setattr(cc, "fits", lambda df: False)
    a = [(i, None, "A", 1.0) for i in range(3000)]
    b = [(i, None, "A", 1.0 + (i % 50 == 0)) for i in range(3000)]
    assert run(spark, a, b, rows_per_bucket=500) == {(i, "n") for i in range(0, 3000, 50)}
