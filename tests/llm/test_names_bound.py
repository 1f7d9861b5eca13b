"""The bound on letters before pairs are shuffled."""

from lonja.llm import names
from tests.llm.test_names import COMPANIES, MARKET


def test_pairs_below_the_bound_are_not_made(spark):
    """Pairs that share a key but not the letters are left out where they are made; no link is lost."""
    import random

    r = random.Random(9)
    word = lambda: "".join(r.choice("ABCDE") for _ in range(r.randrange(2, 9)))
    a = [[word() for _ in range(r.randrange(1, 4))] for _ in range(300)] + [[], ["NORSUL"], ["BEMBOALFA"], ["ALFABEMB"], ["ALFAXEMB"]]
    b = [[word() for _ in range(r.randrange(1, 4))] for _ in range(300)] + [[], ["ALFALFA", "BEMBONE"]] + [list(reversed(x)) for x in a[:100]]
    of = lambda rows, i: spark.createDataFrame([(k, w) for k, w in enumerate(rows)], f"{i} long, palabras array<string>")
    both = names.with_letters(of(a, "nid"), "nl").drop("palabras").crossJoin(names.with_letters(of(b, "cid"), "cl").drop("palabras"))
    passed = {(x["nid"], x["cid"]) for x in both.where(names.letters_allow("nl", "cl")).collect()}
    links = {(i, j) for i, x in enumerate(a) for j, y in enumerate(b) if x and y and names.core_ratio(x, y) >= names.LEAST_RATIO}
    assert links <= passed and len(links) > 100 and len(passed) < 0.6 * len(a) * len(b)
    assert {(302, 301), (303, 301)} <= links

    n = spark.createDataFrame([(1, "", "", ["ALFALFA", "BEMBONE"]), (2, "", "", ["ALFARGO", "QUIZONE"])], "nid long, linea string, region string, palabras array<string>")
    c = spark.createDataFrame([(9, "", "", ["BEMBONE", "ALFALFA"])], "cid long, linea string, region string, palabras array<string>")
    assert [(x["nid"], x["cid"]) for x in names.candidates(n, c).collect()] == [(1, 9)]  # 2 shares keys with 9 too


def test_links_without_broadcasts(spark, monkeypatch):
    """The same links if nothing is small enough to be broadcast and every key is hot."""
    from lonja.operators import shared

    rows = [("BCO ZORNCOCUSA KANNASTER", None), ("IND VELVARALVELFRAQUEN", None), ("GRUPO KELGRIMARSSA", None), ("Cementos Hinfledal Dalssadal And.", None), ("Otra Cosa", None)] * 2
    df = spark.createDataFrame(rows, "nombre string, sector string")
    c = spark.createDataFrame(COMPANIES, "ruc string, nombre string, raices array<string>")
    want = sorted(map(str, names.link(df, c, MARKET).collect()))
    monkeypatch.setattr(shared, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(names, "HOT_NAMES", 1)
    assert sorted(map(str, names.link(df, c, MARKET).collect())) == want and len(want) == 4
