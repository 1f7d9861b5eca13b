import datetime as dt
import math

from pyspark.sql import functions as F

from lonja.operators.rolling import differs, rolling_totals

SCHEMA = "e string, d date, a double, p double, dia string, entidad int"


def run(spark, rows, **more):
    df = spark.createDataFrame(rows, SCHEMA)
    return rolling_totals(df, F.col("e"), F.col("d"), F.col("a"), F.col("p"), **more)


def day(n):
    return dt.date(2024, 1, 1) + dt.timedelta(days=n)


def test_against_brute_force_with_gaps_nulls_and_clashing_names(spark):
    import random

    r = random.Random(1)
    rows = [(r.choice(["A", "B", None]), r.choice([day(r.randrange(80)), None]), r.choice([None, float("nan"), round(r.random() * 100, 2)]), r.choice([None, round(r.random(), 3)]), "x", 1) for _ in range(400)]
    got = {(x["entidad"], x["dia"]): x for x in run(spark, rows).collect()}
    clean = [x for x in rows if x[0] and x[1]]
    want = set()
    for e in {x[0] for x in clean}:
        own = [x for x in clean if x[0] == e]
        for n in range((max(x[1] for x in own) - min(x[1] for x in own)).days + 1):
            d = min(x[1] for x in own) + dt.timedelta(days=n)
            want.add((e, d))
            for k in (7, 30):
                part = [x for x in own if 0 <= (d - x[1]).days < k]
                total = sum(x[2] for x in part if x[2] is not None and not math.isnan(x[2]))
                prices = [x[3] for x in part if x[3] is not None]
                g = got[e, d]
                assert abs(g[f"monto_{k}d"] - total) < 1e-6 and abs(g[f"monto_prom_{k}d"] - total / k) < 1e-6
                assert (g[f"cierre_prom_{k}d"] is None) == (not prices)
                assert not prices or abs(g[f"cierre_prom_{k}d"] - sum(prices) / len(prices)) < 1e-9
    assert set(got) == want


def test_tail_single_day_and_empty(spark):
    one = run(spark, [("A", day(0), 5.0, 1.0, "", 0), ("A", day(0), 5.0, 1.0, "", 0)], tail_days=7).orderBy("dia").collect()
    assert len(one) == 8 and one[0]["monto_7d"] == 10 and one[6]["monto_7d"] == 10 and one[7]["monto_7d"] == 0 and one[7]["cierre_prom_7d"] is None
    assert run(spark, []).count() == 0


def test_differs(spark):
    rows = [(100.0, 100.4, False), (100.0, 101.0, True), (0.01, 0.02, False), (None, 1.0, True), (None, None, False), (float("nan"), None, False)]
    df = spark.createDataFrame([(a, b, c) for a, b, c in rows], "a double, b double, c boolean")
    assert df.where(differs(F.col("a"), F.col("b"), 0.005, 0.02) != F.col("c")).count() == 0


def test_one_shuffle_after_the_daily_aggregate(spark):
    plan = run(spark, [("A", day(0), 1.0, 1.0, "", 0)])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and "Cartesian" not in plan and "NestedLoop" not in plan


def test_figures_beyond_decimals(spark):
    """A figure that no decimal holds counts in every period it lies in, and in none after it."""
    rows = [("A", day(0), 3e25, 2e21, "x", 1), ("A", day(1), 5.25, 1.0, "x", 1), ("A", day(40), 1.5, 2.0, "x", 1)]
    got = {x["dia"]: x for x in run(spark, rows).collect()}
    assert math.isclose(got[day(1)]["monto_30d"], 3e25) and math.isclose(got[day(1)]["cierre_prom_7d"], 1e21) and got[day(31)]["monto_30d"] == 0 and got[day(40)]["monto_7d"] == 1.5
