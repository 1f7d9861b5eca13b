from lonja.llm import mixing

TEXT = "la acción cerró al alza en la rueda de hoy "


def run(spark, docs, targets, **more):
    d = spark.createDataFrame([(i, s, x, "clash", 1) for i, (s, x) in enumerate(docs)], "doc_id long, source string, text string, fuente string, tokens int")
    t = spark.createDataFrame(targets, "fuente string, peso double, max_repeticiones int")
    mix, shares = mixing.mixed(d, "doc_id", d["source"], d["text"], t, **more)
    return mix.collect(), {r["fuente"]: r for r in shares.collect()}


def test_shares_repeats_and_order(spark):
    docs = [("A", TEXT * (1 + i % 5)) for i in range(300)] + [(" a", TEXT)] * 50 + [("b", TEXT)] * 40 + [(None, TEXT), ("zz", TEXT), ("A", None), ("A", "")]
    mix, shares = run(spark, docs, [("a", 0.5, 2), ("B", 0.5, 3), ("vacía", 0.2, 1), (None, 1.0, 1)])
    assert abs(shares["a"]["cuota"] - 0.5) < 0.01 and abs(shares["b"]["cuota"] - 0.5) < 0.01 and shares["vacía"]["tokens"] == 0
    uses = {}
    for r in mix:
        uses.setdefault((r["fuente"], r["doc_id"]), []).append(r["vuelta"])
    assert all(len(v) == len(set(v)) <= {"a": 2, "b": 3}[k[0]] for k, v in uses.items())
    assert sum(r["vuelta"] for r in mix if r["fuente"] == "b") == 40 * 3  # used to the cap: 0 + 1 + 2 each
    assert [r["fin_virtual"] for r in mix] == sorted(r["fin_virtual"] for r in mix)
    half = mix[: len(mix) // 2]
    assert abs(sum(r["tokens"] for r in half if r["fuente"] == "a") / sum(r["tokens"] for r in half) - 0.5) < 0.05


def test_cumulative_tokens_over_buckets(spark, monkeypatch):
    docs = [("A", TEXT)] * 500
    whole, _ = run(spark, docs, [("a", 1.0, 1)])
    monkeypatch.setattr(mixing, "DOCS_PER_BUCKET", 20)
    cut, _ = run(spark, docs, [("a", 1.0, 1)])
    assert whole == cut and len(cut) == 500


def test_budget_empty_and_repeatable(spark):
    docs = [("A", TEXT)] * 100
    mix, shares = run(spark, docs, [("a", 3.0, 5)], total_tokens=200)
    each = mix[0]["tokens"]
    assert shares["a"]["tokens"] <= 200 < shares["a"]["tokens"] + each
    assert run(spark, docs, [("a", 3.0, 5)], total_tokens=200)[0] == mix
    assert run(spark, [], [("a", 1.0, 1)])[0] == [] and run(spark, docs, [])[0] == []


def test_token_count(spark):
    df = spark.createDataFrame([("hello world",), (None,), ("",), ("<|endoftext|>",), ("x " * 200_000,)], "t string")
    n = [r[0] for r in df.select(mixing.token_count(spark, df["t"])).collect()]
    assert n[0] == 2 and n[1] == n[2] == 0 and n[3] > 1 and n[4] > 100_000


def test_budget_beyond_the_scarcest_source(spark):
    """A used-up source drops out, the others fill the budget, and the shares tell; beyond all sources the mix is all there is."""
    docs = [("A", TEXT)] * 400 + [("B", TEXT)] * 20
    each = run(spark, docs, [("a", 1.0, 1)])[0][0]["tokens"]
    mix, shares = run(spark, docs, [("a", 0.5, 1), ("b", 0.5, 2)], total_tokens=300 * each)
    assert sum(r["tokens"] for r in mix) == 300 * each == shares["a"]["tokens_pedidos"] == shares["a"]["tokens_dados"]
    assert shares["b"]["agotada"] and not shares["a"]["agotada"] and shares["b"]["usos"] == 40 and shares["a"]["cuota_objetivo"] == 0.5 < shares["a"]["cuota"]
    everything, shares = run(spark, docs, [("a", 0.5, 1), ("b", 0.5, 2)], total_tokens=10**9)
    assert len(everything) == 440 and shares["a"]["tokens_dados"] == 440 * each < shares["a"]["tokens_pedidos"]


def test_finish_times_against_brute_force(spark):
    """Shares and finish times from a table of tokens alone."""
    import random

    r = random.Random(6)
    docs = [(r.choice("AAAAB"), TEXT * r.randrange(1, 9)) for _ in range(300)]
    mix, shares = run(spark, docs, [("a", 0.7, 2), ("b", 0.3, 3)])
    tokens = {(x["doc_id"], x["fuente"]): x["tokens"] for x in mix}
    for source, weight, turns in (("a", 0.7, 2), ("b", 0.3, 3)):
        order = [x["doc_id"] for x in mix if x["fuente"] == source and x["vuelta"] == 0]
        total, want = 0, []
        for t in range(turns):
            for d in order:
                total += tokens[d, source]
                want.append((d, t, total / weight))
        got = [(x["doc_id"], x["vuelta"], x["fin_virtual"]) for x in mix if x["fuente"] == source]
        assert len(got) <= len(want) and all(g[:2] == w[:2] and abs(g[2] - w[2]) < 1e-6 for g, w in zip(got, want))
    assert any(s["agotada"] for s in shares.values())
