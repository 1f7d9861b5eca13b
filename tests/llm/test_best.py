import datetime as dt
import random

from lonja.llm import best

SCHEMA = "g string, h int, id string, a double, b string, trust int, t timestamp, campo string, valor string"
F = ["a", "b"]


def t(n):
    return dt.datetime(2024, 1, 1) + dt.timedelta(hours=n)


def run(spark, rows):
    df = spark.createDataFrame([(*r, "c", "v") for r in rows], SCHEMA)
    return {tuple(r) for r in best.surviving_fields(df, ["g", "h"], "id", F, "trust", "t").collect()}, df


def test_rules_ties_nulls(spark):
    rows = [
        ("G", 1, "1", None, "x", 1, t(1)), ("G", 1, "2", 5.0, "y", 2, t(9)), ("G", 1, "3", 6.0, None, 2, t(9)),  # tie: least id
        ("H", 1, "4", 1.0, "z", None, None), ("H", 1, "5", 2.0, None, None, t(1)),
        ("I", 1, "6", 1.0, "q", 1, t(1)), (None, 1, "7", 1.0, "q", 1, t(1)), (None, 1, "8", 1.0, "q", 1, t(1)), ("J", 1, None, 1.0, "q", 1, t(1)),
        ("K", 2, "9", None, None, 1, t(1)), ("K", 2, "91", None, None, 1, t(1)),
    ]
    got, df = run(spark, rows)
    assert got == {("1", "a", "2", "5.0"), ("1", "b", "1", "x"), ("4", "a", "5", "2.0"), ("4", "b", "4", "z")}
    whole = {r["g"]: (r["id"], r["completitud"]) for r in best.best_records(df, ["g", "h"], "id", F, "trust", "t").collect()}
    assert whole == {"G": ("2", 2), "H": ("4", 2), "I": ("6", 2), "K": ("9", 0)}
    assert run(spark, [])[0] == set()


def test_hot_group_against_brute_force(spark):
    r = random.Random(6)
    rows = [(r.choice(["HOT", f"G{r.randrange(30)}"]), 1, f"{i:05d}", r.choice([None, float(i)]), r.choice([None, str(i)]), r.randrange(3), t(r.randrange(50))) for i in range(2000)]
    want = set()
    for g in {x[0] for x in rows}:
        own = [x for x in rows if x[0] == g]
        for k, name in ((3, "a"), (4, "b")):
            if len(own) > 1 and (have := [x for x in own if x[k] is not None]):
                x = min(have, key=lambda x: (x[5], -x[6].timestamp(), x[2]))
                want.add((min(o[2] for o in own), name, x[2], str(x[k])))
    assert run(spark, rows)[0] == want


def test_rank_is_limited_before_the_shuffle(spark):
    _, df = run(spark, [("G", 1, "1", 1.0, "x", 1, t(1))])
    plan = best.surviving_fields(df, ["g", "h"], "id", F, "trust", "t")._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
