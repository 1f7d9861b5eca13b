"""What the driver holds doesn't grow with the tables."""

from lonja import reference
from lonja.operators import delta, shared
from lonja.plans import gold


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filing_classes_join_nothing(spark, root):
    assert "Join" not in _plan(reference.g3_excepciones(spark, root))
    rows = [("1", 2024, "T1"), ("1", 2024, "T1"), ("1", None, None), ("1", None, None), ("1", 2024, None), ("2", 2024, "T1"), (None, 2024, "T1"), (None, 2024, "T1"), (None, None, None)]
    df = spark.createDataFrame(rows, "ruc string, ejercicio int, trimestre string")
    got = lambda d: {r["clase"]: r["filas"] for r in gold.filing_classes(d).collect()}
    ok, invalid, many = gold.split_filings(df)
    assert got(df) == {"invalido": 3, "ambiguo": 4, "utilizable": 2} == {"invalido": invalid.count(), "ambiguo": many.count(), "utilizable": ok.count()}
    assert got(df.limit(0)) == {"invalido": 0, "ambiguo": 0, "utilizable": 0}


def test_collisions_fetch_only_keys_that_collide(spark, monkeypatch):
    """Of many keys that occur once none is looked up; beyond the size of a broadcast hot keys are spread, and nothing is lost."""
    df = spark.range(3000).selectExpr("id", "case when id < 1000 then 'hot' when id < 1010 then 'b' || id div 2 when id < 1020 then null else 'k' || id end clave")
    want = sorted((i, None if 1010 <= i < 1020 else 1000 if i < 1000 else 2 if i < 1010 else 1, i < 1010) for i in range(3000))
    sides, join_hot = [], delta.join_hot
    monkeypatch.setattr(delta, "join_hot", lambda big, lookup, *a, **k: sides.append(lookup.count()) or join_hot(big, lookup, *a, hot=100, **k))
    rows = lambda: sorted((tuple(r) for r in delta.with_collisions(df, "clave", "n", "choca").select("id", "n", "choca").collect()), key=lambda r: r[0])
    assert rows() == want and sides == [6]
    monkeypatch.setattr(shared, "BROADCAST_BYTES", 0)
    assert rows() == want


def test_hot_join_sends_other_keys_once(spark, monkeypatch):
    """Beyond the size of a broadcast only hot keys have a copy per salt."""
    monkeypatch.setattr(shared, "BROADCAST_BYTES", 0)
    big = spark.range(5000).selectExpr("id", "case when id < 2000 then 'hot' when id < 2100 then null else 'k' || id % 50 end k", "'x' l")
    lookup = spark.range(60).selectExpr("case when id = 59 then 'hot' when id = 58 then null else 'k' || id end k", "'x' l", "id v")
    for key, how in (("k", "left"), ("k", "inner"), (["k", "l"], "inner"), (["k", "l"], "left")):
        side = lookup.drop("l") if key == "k" else lookup
        plain = big.join(side, key, how).select("id", "k", "v")
        got = shared.join_hot(big, side, key, how, hot=1000).select("id", "k", "v")
        assert sorted(map(str, got.collect())) == sorted(map(str, plain.collect()))
    copies = []
    monkeypatch.setattr(shared.F, "explode", lambda c, f=shared.F.explode: copies.append(c) or f(c))
    shared.join_hot(big, lookup.drop("l"), "k", "left", hot=1000)
    hot = spark.createDataFrame([(True,), (None,)], "__hot boolean")
    assert sorted(r[0] for r in hot.select(shared.F.size(copies[0])).collect()) == [1, 16]
