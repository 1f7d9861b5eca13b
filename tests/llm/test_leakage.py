import random

import numpy as np

from lonja.llm import leakage as lk

R = random.Random(7)
WORDS = ["".join(R.choice("abcdefghijklmnop") for _ in range(R.randrange(3, 9))) for _ in range(3000)]


def text(n, seed):
    r = random.Random(seed)
    return [r.choice(WORDS) for _ in range(n)]


ITEMS = [(i, " ".join(text(80, 100 + i))) for i in range(20)] + [(98, "demasiado corto"), (99, None)]


def changed(words, every, seed=1):
    r = random.Random(seed)
    out = []
    for i, w in enumerate(words):
        if i % every == every - 1:
            how = r.randrange(3)
            out += [r.choice(WORDS)] if how == 0 else [] if how == 1 else [w, r.choice(WORDS)]
        else:
            out.append(w)
    return out


def test_passages(spark):
    item = ITEMS[3][1].split()
    noise = lambda s: text(200, s)
    docs = [
        (0, " ".join(noise(1) + item[10:40] + noise(2))), (1, " ".join(noise(3) + item[10:30] + noise(4))),  # 30 words, 20 words
        (2, " ".join(noise(5) + changed(item, 7) + noise(6))), (3, " ".join(noise(7) + changed(item, 3) + noise(8))),  # one in seven, one in three
        (4, "<b>" + ", ".join(w.upper() for w in item[5:35]) + "</b>\n\n&nbsp;fin"), (5, " ".join(item[20:46] + text(300, 9) + ITEMS[5][1].split()[:26])),
        (6, None), (7, ""), (8, " ".join(text(60_000, 10) + item[40:70])), (9, " ".join(item[::-1])), (0, " ".join(noise(1) + item[10:40] + noise(2))), (10, "á" * 30),
    ]
    d = spark.createDataFrame([(i, t, 5) for i, t in docs], "doc long, t string, item int")
    i = spark.createDataFrame([(a, b, "x") for a, b in ITEMS], "item long, t string, doc string")
    got = sorted((r["doc"], r["item"]) for r in lk.leaked(d, "doc", "t", i, "item", "t").collect())
    assert got == [(0, 3), (0, 3), (2, 3), (4, 3), (5, 3), (5, 5), (8, 3)]
    assert lk.leaked(d.limit(0), "doc", "t", i, "item", "t").count() == 0 and lk.leaked(d, "doc", "t", i.limit(0), "item", "t").count() == 0


def test_changes_at_the_ends_and_on_rare_pairs(spark):
    """Items from one template: changes on the few pairs that only one item has leave enough; so do changed end words."""
    template = text(25, 77)
    items = []
    for k in range(40):
        own = list(template)
        for i in (4, 9, 14, 19):
            own[i] = WORDS[200 + 4 * k + i // 5]
        items.append((k, " ".join(own)))
    rare = items[7][1].split()
    for i in (4, 9, 14, 19):
        rare[i] = f"otra{'abcdefghijklmnopqrstuvwxyz'[i]}"
    ends = ITEMS[3][1].split()[10:35]
    ends[0], ends[24] = "primera", "ultima"
    d = spark.createDataFrame([(0, " ".join(text(60, 21) + rare + text(60, 22))), (1, " ".join(text(60, 23) + ends + text(60, 24))), (2, " ".join(text(60, 25) + ends[1:20] + text(60, 26)))], "doc long, t string")
    i = spark.createDataFrame([*items, (103, ITEMS[3][1])], "item long, t string")
    got = {(r["doc"], r["item"]) for r in lk.leaked(d, "doc", "t", i, "item", "t").collect()}
    assert (0, 7) in got and (1, 103) in got and all(x[0] != 2 for x in got)


def test_items_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(lk, "ITEMS_PER_PASS", 5)
    d = spark.createDataFrame([(k, ITEMS[k][1]) for k in range(20)], "doc long, t string")
    i = spark.createDataFrame(ITEMS, "item long, t string")
    assert sorted((r["doc"], r["item"]) for r in lk.leaked(d, "doc", "t", i, "item", "t").collect()) == [(k, k) for k in range(20)]


def test_multi_index_finds_all_within_radius():
    rng = np.random.default_rng(8)
    items = lk.build(ITEMS)
    pick = rng.integers(0, len(items.prints), 500)
    flips = np.array([sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 6), replace=False)) for _ in pick], dtype=np.uint64)
    prints = items.prints[pick] ^ flips
    place, window = lk.near_windows(prints, items)
    want = {(p, w) for p in range(500) for w in np.flatnonzero(np.bitwise_count(items.prints ^ prints[p]) <= lk.RADIUS)}
    assert set(zip(place.tolist(), window.tolist())) == want


def test_alignment_against_brute_force():
    r = random.Random(9)
    cases = [tuple([r.choice("abcd") for _ in range(r.randrange(1, 15))] for _ in range(2)) for _ in range(200)]
    found = lk.aligned([tuple(np.array([ord(c) for c in x]) for x in case) for case in cases])
    for (a, b), p in zip(cases, found):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                t[i + 1][j + 1] = t[i][j] + 1 if a[i] == b[j] else max(t[i][j + 1], t[i + 1][j])
        pairs = [tuple(x) for x in p.tolist()]
        assert len(pairs) == t[-1][-1] and all(a[i] == b[j] for i, j in pairs) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:]))


def test_long_words_and_forgotten_words():
    """Words are hashed whole, and a worker that forgets words finds the same."""
    v = lk.word_vectors(["a" * 100_000 + "b", "a" * 100_000 + "c", "corto"])
    assert (v[0] != v[1]).any() and (v[2] == lk.word_vectors(["corto"])[0]).all()
    items = lk.build(ITEMS)
    doc = " ".join(text(50, 31)) + " nuevas palabras " + ITEMS[4][1] + " x" * 50
    first = lk.leaks([doc], items)
    items.vocabulary.forget(items.known)
    assert len(items.vocabulary.number) == items.known == len(items.vocabulary.vectors) and lk.leaks([doc], items) == first == [(0, 4, 80)]


def test_no_gate_stops_a_passage():
    """Whatever has a passage by alignment alone is found: changes of every kind crowded at every place."""
    r = random.Random(12)
    items = lk.build(ITEMS[:6])
    docs, want = [], []
    for _ in range(400):
        k, n = r.randrange(6), r.randrange(25, 60)
        at = r.randrange(0, 80 - n + 1)
        words, wrong = ITEMS[k][1].split()[at : at + n], r.randrange(0, n // 6 + 1)
        centre = r.randrange(n)
        spots = sorted(r.sample(range(n), wrong) if r.random() < 0.5 else sorted(range(n), key=lambda i: abs(i - centre))[:wrong])
        how = r.choice(["alter", "drop", "add", "any"])
        out = []
        for i, w in enumerate(words):
            kind = how if how != "any" else r.choice(["alter", "drop", "add"])
            out += [w] if i not in spots else ["zz" + w] if kind == "alter" else [] if kind == "drop" else [w, "yy" + w]
        docs.append(" ".join(text(20, r.random()) + out + text(20, r.random())))
        region = items.vocabulary.ids(docs[-1].split())
        own = items.words[k]
        want.append((k, lk.longest_passage(lk.aligned([(own, region)])[0], len(own), len(region)) >= lk.PASSAGE))
    found = {(d, i) for d, i, _ in lk.leaks(docs, items)}
    missing = [d for d, (k, yes) in enumerate(want) if yes and (d, k) not in found]
    assert sum(yes for _, yes in want) > 300 and missing == []


def test_markup_of_any_length(spark):
    item = ITEMS[2][1].split()
    tag = f'<span title="{" ".join(text(90, 41))}">'
    assert lk.leaks([" ".join(item[:15]) + tag + " ".join(item[15:30])], lk.build(ITEMS)) == [(0, 2, 30)]


def test_pieces_of_long_texts_agree():
    v = lk.Vocabulary()
    ids = v.ids(text(70_000, 11))
    whole = lk.fingerprints(ids, v.vectors)
    assert len(whole) == 70_000 - lk.WINDOW + 1
    assert (whole[65_530:65_545] == lk.fingerprints(ids[65_530 : 65_545 + lk.WINDOW - 1], v.vectors)).all()
