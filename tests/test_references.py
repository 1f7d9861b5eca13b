import datetime as dt

from pyspark.sql import functions as F

from lonja.operators.references import orphan_report, orphans


def d(n):
    return dt.date(2024, 1, 1) + dt.timedelta(days=n)


def run(spark, refs, parents):
    r = spark.createDataFrame([(i, *x) for i, x in enumerate(refs)], "i int, k string, day date, rango string, motivo string" if refs and len(refs[0]) == 4 else "i int, k string, day date")
    p = spark.createDataFrame(parents, "k string, a date, b date")
    out = orphans(r, r["k"], r["day"], [F.col("i"), F.col("k").alias("clave_referida"), F.date_format("day", "yyyy-MM").alias("periodo")], p, p["k"], p["a"], p["b"])
    return out


def test_missing_early_late_null_and_repeated(spark):
    refs = [("A", d(5)), ("A", d(0)), ("A", d(50)), ("B", d(0)), ("X", d(1)), (None, d(1)), ("A", None), ("X", d(1)), ("É", d(1))]
    parents = [("A", d(1), d(10)), ("A", d(2), d(20)), ("B", None, None), (None, None, None)]
    got = {(r["i"], r["motivo"]) for r in run(spark, refs, parents).collect()}
    assert got == {(1, "anterior"), (2, "posterior"), (4, "inexistente"), (7, "inexistente"), (8, "inexistente")}


def test_empty_sides(spark):
    assert run(spark, [], [("A", None, None)]).count() == 0
    assert run(spark, [("A", d(0))], []).count() == 1


def test_against_brute_force_with_ranges_and_hot_key(spark, monkeypatch):
    import random

    from lonja.operators import references

    monkeypatch.setattr(references, "PARENTS_PER_RANGE", 20)
    r = random.Random(2)
    parents = [(f"K{r.randrange(400)}", *r.choice([(None, None), (d(10), None), (d(5), d(30))])) for _ in range(300)]
    refs = [(r.choice(["K1", f"K{r.randrange(500)}"]), d(r.randrange(50))) for _ in range(5000)]
    got = {x["i"]: x["motivo"] for x in run(spark, refs, parents).collect()}
    span = {}
    for k, a, b in parents:
        lo, hi = span.get(k, (dt.date.max, dt.date.min))
        span[k] = (min(lo, a or dt.date.min), max(hi, b or dt.date.max))
    want = {i: "inexistente" if k not in span else "anterior" if day < span[k][0] else "posterior" for i, (k, day) in enumerate(refs) if k not in span or not span[k][0] <= day <= span[k][1]}
    assert got == want


def test_many_failing_keys_take_the_salted_join(spark, monkeypatch):
    from lonja.operators import shared

    monkeypatch.setattr(shared, "BROADCAST_BYTES", 2)
    refs = [(f"K{i % 7}", d(0)) for i in range(70)]
    got = run(spark, refs, [("K1", None, None)])
    assert got.count() == 60


def test_report(spark):
    out = run(spark, [("X", d(0)), ("X", d(1)), ("Y", d(40))], [])
    rep = {(r["periodo"], r["referencias"], r["claves"]) for r in orphan_report(out, F.lit("t"), F.col("periodo")).collect()}
    assert rep == {("2024-01", 2, 1), ("2024-02", 1, 1)}


def test_clashing_names(spark):
    refs = spark.createDataFrame([("a", "Z")], "fila string, k string")
    parents = spark.createDataFrame([("Q",)], "k string")
    out = orphans(refs, refs["k"], None, [F.col("fila"), F.col("k").alias("hay")], parents, parents["k"]).collect()
    assert [tuple(r) for r in out] == [("a", "Z", "inexistente")]
