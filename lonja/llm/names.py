"""Variant spellings of company names, linked to a list of companies.

Names are taken apart into line of business, region, legal form and core words; candidates are found by shared
suffixes and beginnings of core words, refined with line and region, and pairs are compared by longest-common-subsequence
ratio. Lines and regions are no fixed lists: they are the phrases with which many of the companies' own names begin or
end, and they are recognised whole, cut short, or contracted.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lonja.operators.shared import join_hot, kept, small

#: Letters of the endings and of the beginnings of words under which candidates are found.
SUFFIX, START = 3, 4
#: Least ratio of core words for a link, and the lead that makes a link sure without further evidence.
LEAST_RATIO, LEAD = 0.86, 0.035

#: A phrase is a line of business or a region if it begins or ends at least this share of the companies' names, and so many.
LEAST_PART, LEAST_NAMES = 0.01, 5
#: A key with so many names is spread over several tasks, as each of them meets every company of the key.
HOT_NAMES = 20_000
#: Words of the longest such phrase, and the orders of how many words are all tried.
LONGEST, ORDERED = 3, 5

#: Legal forms. Fixed values.
FORMS = {
    "SAA": r"SOC(?:IEDAD)? ANON(?:IMA)? ABIERTA|S ?A ?A",
    "SAC": r"SOC(?:IEDAD)? ANON(?:IMA)? CERRADA|S ?A ?C",
    "SA": r"SOC(?:IEDAD)? ANON(?:IMA)?|S ?A",
}
#: Words that say nothing about which company is meant. Fixed values.
KEPT = re.compile(r"\b(?:Y SUBSIDIARIAS|SUBSIDIARIAS|EN LIQUIDACION|PERU|LIMA|GRUPO|Y|DEL|DE|LA|EL|LOS)\b")
EMPTY = re.compile(r"\b(?:Y SUBSIDIARIAS|SUBSIDIARIAS|EN LIQUIDACION|PERU|LIMA|GRUPO|Y|E|DEL|DE|LA|EL|LOS|D)\b")

_FOLD = str.maketrans("ÁÀÂÃÄÅÉÈÊËÍÌÎÏÓÒÔÕÖÚÙÛÜÑÇÝ01345", "AAAAAAEEEEIIIIOOOOOUUUUNCYOIEAS")
_FORM = [(k, re.compile(rf"(?<![A-Z])(?:{v})(?![A-Z])")) for k, v in FORMS.items()]


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit-parallel steps."""
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    s = full
    for c in b:
        u = s & at.get(c, 0)
        s = (s + u) | (s - u)
    return (~s & full).bit_count()


def ratio(a: str, b: str) -> float:
    return 2 * lcs(a, b) / (len(a) + len(b)) if a or b else 0.0


def _stem(word: str) -> str:
    """A word without the ending of its number and gender."""
    w = word[:-2] if len(word) > 5 and word.endswith("ES") else word[:-1] if len(word) > 4 and word.endswith("S") else word
    return w[:-1] if len(w) > 4 and w[-1] in "AO" else w


def stands_for(token: str, word: str) -> float:
    """How surely a token is the word: written whole, in another number or gender, cut short, or contracted (its first and
    last letters and some between, as in BCO); 0 if it isn't."""
    if token == word:
        return 4.0
    if len(token) < 3 or token[0] != word[0]:
        return 0.0
    if len(token) > 3 and _stem(token) == _stem(word):
        return 3.5
    if word.startswith(token):
        return 3.0
    short = token[:-1] if len(token) > 3 and token.endswith("S") else token
    if len(short) >= 3 and word.startswith(short):
        return 2.5
    for end in (word, word.removesuffix("S")):
        letters = iter(end)
        if len(token) < len(end) and token[-1] == end[-1] and all(c in letters for c in token):
            return 2.0
    return 0.0


def _content(text: str) -> list[str]:
    return EMPTY.sub(" ", text).split()


class Vocabulary:
    """Lines of business and regions, as phrases of words."""

    def __init__(self, lines: Iterable[str], regions: Iterable[str]) -> None:
        self.lines = {x: tuple(_content(x)) for x in sorted(set(lines), key=lambda x: (-len(x.split()), x))}
        self.regions = {x: tuple(_content(x)) for x in sorted(set(regions), key=lambda x: (-len(x.split()), x))}
        self._known: dict[tuple[str, str], float] = {}
        of: dict[str, set[str]] = {}
        for phrase, ws in self.lines.items():
            for w in ws:
                of.setdefault(w, set()).add(phrase)
        #: words that only one phrase of several has stand for it alone
        self.alone = {w: next(iter(ps)) for w, ps in of.items() if len(ps) == 1 and len(self.lines[next(iter(ps))]) > 1}

    def _is(self, token: str, word: str) -> float:
        if (known := self._known.get((token, word))) is None:
            if len(self._known) > 1_000_000:
                self._known.clear()
            known = self._known[token, word] = stands_for(token, word)
        return known

    def _phrase(self, words: list[str], at: int, phrase: tuple[str, ...]) -> tuple[float, int]:
        """(how surely, words taken) of a phrase that begins at a place."""
        if len(phrase) == 1:
            two = "".join(words[at : at + 2])
            if len(words[at]) > 3 and len(two) > len(words[at]) and phrase[0].startswith(two):
                return 3.0, 2
            return self._is(words[at], phrase[0]), 1
        if at + len(phrase) > len(words):
            return 0.0, 0
        each = [1.0 if len(t) < 3 and w.startswith(t) else self._is(t, w) for t, w in zip(words[at:], phrase)]
        return (sum(each) / len(each) + 1, len(phrase)) if min(each) > 0 and max(each) > 1 else (0.0, 0)

    def find(self, words: list[str], phrases: dict[str, tuple[str, ...]], last: bool) -> tuple[str, int, int]:
        """The phrase the words hold most surely, its place and its length; of equals the first (or last) place. '' if none."""
        best = (0.0, 0, "", 0, 0)
        for at in range(len(words)):
            for name, phrase in phrases.items():
                sure, taken = self._phrase(words, at, phrase)
                if sure and (sure, at if last else -at) > best[:2]:
                    best = (sure, at if last else -at, name, at, taken)
        return best[2:]

    def near(self, word: str, phrases: dict[str, tuple[str, ...]]) -> str:
        """The phrase one of whose words the word is, but for a slip."""
        if len(word) < 5:
            return ""
        scored = [(ratio(word, w), name) for name, ws in phrases.items() for w in ws if len(w) >= 5 and abs(len(w) - len(word)) <= 1]
        sure, name = max(scored, default=(0.0, ""))
        return name if sure >= 0.83 else ""

    def parse(self, name: str) -> tuple[str, str, str, str, list[str]]:
        """(line, region, legal form, note in brackets, core words) of a name; parts that are not there are ''."""
        t = name.upper().translate(_FOLD)
        note = ""
        for inside in re.findall(r"\(([^)]*)\)", t):
            ws = _content(re.sub(r"[^A-Z]+", " ", inside))
            if not (self.find(ws, self.lines, False)[0] or any(self._is(w, x) for w in ws for x in self.alone)):
                note = re.sub(r"[^A-Z]", "", inside)
                t = t.replace(f"({inside})", " ")
        t = re.sub(r"[^A-Z]+", " ", re.sub(r"(?<=[A-Z])-(?=[A-Z])", "", t)).strip()
        form = ""
        for k, p in _FORM:
            if hits := list(p.finditer(t)):
                form, m = k, hits[-1]
                t = f"{t[:m.start()]} {t[m.end():]}"
                break
        words = KEPT.sub(" ", t).split()
        line = region = ""
        if (whole := self.find([w if (w,) in self.regions.values() else "" for w in words], self.regions, True))[0]:
            region, at, n = whole  # a region written whole is no contraction of a line
            words = words[:at] + words[at + n :]
        line, at, n = self.find(words, self.lines, False)
        if not line:
            sure, at, x = max(((self._is(w, x), -i, x) for i, w in enumerate(words) for x in self.alone), default=(0.0, 0, ""))
            line, at, n = (self.alone[x], -at, 1) if sure else ("", 0, 0)
        if line:
            words = words[:at] + words[at + n :]
        if not region:
            region, at, n = self.find(words, self.regions, True)
            words = words[:at] + words[at + n :] if region else words
        words = EMPTY.sub(" ", " ".join(words)).split()
        if not region and len(words) > 2 and (region := self.near(words[-1], self.regions)):
            words = words[:-1]
        if not line and len(words) > 2:
            for i in (0, len(words) - 1):
                if line := self.near(words[i], self.lines):
                    words = words[:i] + words[i + 1 :]
                    break
        words = [w for w in words if len(w) > 1] or words
        return line, region, form, note, words


def phrases(counts: dict[tuple[str, ...], int], least: int) -> list[str]:
    """The phrases that at least so many names have at an end, without those that nearly always go on to a longer one."""
    often = {g: n for g, n in counts.items() if n >= least}
    longer = {g: sum(n for h, n in often.items() if len(h) == len(g) + 1 and h[: len(g)] == g) for g in often}
    return [" ".join(g) for g, n in often.items() if longer[g] < 0.9 * n]


def learn(companies: DataFrame, name: str) -> Vocabulary:
    """The lines of business (with which names begin) and regions (with which they end) of all companies.

    All names are counted, by task and then together; only phrases of at least LEAST_PART of the names are fetched, so
    these are at most LONGEST / LEAST_PART for each end, however many companies there are.
    """

    def grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for n in pdf["n"]:
                t = re.sub(r"[^A-Z]+", " ", n.upper().translate(_FOLD)).strip()
                for _, p in _FORM:
                    if hits := list(p.finditer(t)):
                        t = f"{t[:hits[-1].start()]} {t[hits[-1].end():]}"
                        break
                ws = _content(t)
                for k in range(1, min(LONGEST, len(ws) - 1) + 1):
                    out += [(True, ws[:k]), (False, ws[-k:][::-1])]
            yield pd.DataFrame(out, columns=["inicio", "frase"])

    distinct = kept(companies.select(F.col(name).alias("n")).where(F.trim("n") != "").distinct())
    least = max(LEAST_NAMES, int(LEAST_PART * distinct.count()))
    counts = distinct.mapInPandas(grams, "inicio boolean, frase array<string>").groupBy("inicio", "frase").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    rows = counts.collect()  # at most LONGEST / LEAST_PART for each end
    starts, ends = ({tuple(r["frase"]): r["n"] for r in rows if r["inicio"] == side} for side in (True, False))
    lines = phrases(starts, least)
    regions = [" ".join(reversed(x.split())) for x in phrases(ends, least)]
    return Vocabulary(lines, [r for r in regions if r not in lines])


PARSED = "linea string, region string, forma string, nota string, palabras array<string>"


def parsed(df: DataFrame, name: str, vocabulary: Vocabulary) -> DataFrame:
    """Adds the parts of ``name`` in Arrow batches."""
    lines, regions = list(vocabulary.lines), list(vocabulary.regions)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + ", " + PARSED

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Vocabulary(lines, regions)
        for pdf in batches:
            parts = [own.parse(n or "") for n in pdf[name]]
            for i, c in enumerate(("linea", "region", "forma", "nota", "palabras")):
                pdf[c] = [p[i] for p in parts]
            yield pdf

    return df.mapInPandas(run, schema)


def _keys(df: DataFrame, i: str, *more: str) -> DataFrame:
    """One row (``i``, linea, region, ``clave``, and ``more`` of the name) per distinct ending and beginning of the core words.

    A name of one word may be two that were glued, so every place inside it may be where the first ends and the second begins.
    """
    w, n = F.col("w"), F.length("w")
    word = df.select(i, "linea", "region", *more, (F.size("palabras") == 1).alias("sola"), F.explode("palabras").alias("w")).where(n >= 2)
    places = lambda size: F.when(F.col("sola") & (n >= size), F.transform(F.sequence(F.lit(1), F.greatest(n - size + 1, F.lit(1))), lambda k: F.substring(w, k, F.lit(size))))
    ends = F.coalesce(places(SUFFIX), F.array(F.expr(f"right(w, {SUFFIX})")))
    starts = F.coalesce(places(START), F.when(n >= START, F.array(F.expr(f"left(w, {START})"))), F.array().cast("array<string>"))
    tagged = F.concat(F.transform(ends, lambda x: F.concat(F.lit("-"), x)), F.transform(starts, lambda x: F.concat(x, F.lit("-"))))
    return word.select(i, "linea", "region", *more, F.explode(tagged).alias("clave")).distinct()


#: The letters of the core words: in ``s`` a bit for the first and a bit for the second time that each occurs, in ``x`` how many letters are left.
_BITS = """aggregate(filter(split(array_join(palabras, ''), ''), c -> c between 'A' and 'Z'), named_struct('s', 0L, 'x', 0), (z, c) ->
 case when (z.s & shiftleft(1L, ascii(c) - 65)) = 0 then named_struct('s', z.s | shiftleft(1L, ascii(c) - 65), 'x', z.x)
 when (z.s & shiftleft(1L, ascii(c) - 33)) = 0 then named_struct('s', z.s | shiftleft(1L, ascii(c) - 33), 'x', z.x)
 else named_struct('s', z.s, 'x', z.x + 1) end)"""


def with_letters(df: DataFrame, name: str) -> DataFrame:
    """``df`` with the letters of ``palabras`` as (s, x), and the beginnings of a name of one word and of one of two (``uno``, ``dos``)."""
    start = lambda k: F.expr(f"left(palabras[{k}], 3)")
    one, two = F.when(F.size("palabras") == 1, start(0)), F.when(F.size("palabras") == 2, F.array(start(0), start(1)))
    return df.withColumn(name, F.expr(_BITS)).withColumn(name, F.struct(f"{name}.s", f"{name}.x", one.alias("uno"), two.alias("dos")))


def letters_allow(a: str, b: str) -> Column:
    """Whether core words with these letters can reach LEAST_RATIO: ``could_be`` without Python, the third and further times
    that a letter occurs being taken as common. A nickname glued from two words begins like one of them."""
    both = F.bit_count(F.col(f"{a}.s").bitwiseAND(F.col(f"{b}.s"))) + F.least(f"{a}.x", f"{b}.x")
    size = lambda x: F.bit_count(f"{x}.s") + F.col(f"{x}.x")
    nick = F.coalesce(F.array_contains(F.col(f"{b}.dos"), F.col(f"{a}.uno")), F.lit(False))
    return (2 * both >= LEAST_RATIO * (size(a) + size(b)) - 1e-9) | nick


def candidates(names: DataFrame, companies: DataFrame) -> DataFrame:
    """Pairs (``nid``, ``cid``) of the same line of business and region that share an ending or a beginning of a core word,
    and whose letters allow the ratio.

    The endings are the shortest ones, of SUFFIX letters: words that share a longer one share these too. Every key is
    refined with line and region, and a field that the name lacks matches any, so only pairs that can't be a link are
    left out. No key is discarded, however many companies have it. Words with slips in their last letters share no
    ending, so beginnings of START letters count too; these also hold together nicknames glued from beginnings, one of
    whose two parts has START letters or more.

    The letters travel with the keys, so a pair is held against the bound where it is made: pairs that can't reach the
    ratio are neither shuffled nor joined to their names, and the names need not be broadcast for it.
    """
    either = lambda c: F.explode(F.array_distinct(F.array(F.col(c), F.lit("")))).alias(c)
    left = _keys(with_letters(names, "nl"), "nid", "nl")
    right = _keys(with_letters(companies, "cl"), "cid", "cl").select("cid", "cl", "clave", either("linea"), "region").select("cid", "cl", "clave", "linea", either("region"))
    return join_hot(left, right, ["clave", "linea", "region"], hot=HOT_NAMES).where(letters_allow("nl", "cl")).select("nid", "cid").distinct()


def blocks(names: DataFrame, companies: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """The blocks: (``clave``, ``linea``, ``region``, ``nombres``, ``empresas``) with the number of distinct names and companies in each."""
    n = parsed(names.select("nombre").where(F.trim("nombre") != "").distinct(), "nombre", vocabulary).withColumn("nid", F.xxhash64("nombre"))
    c = parsed(companies.select("ruc", "nombre").where(F.trim("nombre") != "").distinct(), "nombre", vocabulary).withColumn("cid", F.xxhash64("ruc", "nombre"))
    either = lambda x: F.explode(F.array_distinct(F.array(F.col(x), F.lit("")))).alias(x)
    right = _keys(c, "cid").select("cid", "clave", either("linea"), "region").select("cid", "clave", "linea", either("region"))
    count = lambda d, i, out: d.groupBy("clave", "linea", "region").agg(F.count_distinct(i).alias(out))
    return count(_keys(n, "nid"), "nid", "nombres").join(count(right, "cid", "empresas"), ["clave", "linea", "region"])


def core_ratio(a: list[str], b: list[str]) -> float:
    """The best ratio over the orders of the words of ``b``, another order being worth a little less; a nickname glued from
    the beginnings of two words counts as 0.93. Of more than ORDERED words the turns and the order of the alphabet are tried."""
    one, two = "".join(a), "".join(b)
    best = ratio(one, two)
    if best < 1 and len(b) > 1:
        orders = permutations(b) if len(b) <= ORDERED else [*(b[i:] + b[:i] for i in range(len(b))), sorted(b)]
        other = sorted(a) if len(b) > ORDERED else a
        best = max(best, max(ratio(one, "".join(o)) for o in orders) - 0.001, ratio("".join(other), "".join(sorted(b))) - 0.001 if len(b) > ORDERED else 0.0)
    if len(a) == 1 and len(b) == 2 and best < 0.93 and 7 <= len(one) <= len(two) - 2:
        for p, q in ((b[0], b[1]), (b[1], b[0])):
            for i in range(3, len(one) - 2):
                if p.startswith(one[:i]) and q.startswith(one[i:]):
                    best = max(best, 0.93)
    return best


def _letters(texts: list[str]) -> np.ndarray:
    """How often each of the letters A to Z occurs in each text."""
    sizes = np.array([len(t) for t in texts])
    codes = np.frombuffer("".join(texts).encode("ascii", "replace"), dtype=np.uint8).astype(np.int64) - 65
    row = np.repeat(np.arange(len(texts)), sizes)
    ok = (codes >= 0) & (codes < 26)
    return np.bincount(row[ok] * 26 + codes[ok], minlength=26 * len(texts)).reshape(-1, 26)


def could_be(a: list[str], b: list[str]) -> np.ndarray:
    """Whether pairs of core words (parted by blanks) can reach LEAST_RATIO: a common subsequence has no letter more often
    than both have it. Nicknames glued from two words may always."""
    x, y = _letters(a), _letters(b)
    both, sizes = np.minimum(x, y).sum(axis=1), x.sum(axis=1) + y.sum(axis=1)
    nick = np.array([" " not in p and q.count(" ") == 1 for p, q in zip(a, b)])
    return (2 * both >= LEAST_RATIO * sizes - 1e-9) | nick


def _ratios(pairs: DataFrame) -> DataFrame:
    @F.pandas_udf("double")
    def of(a: pd.Series, b: pd.Series) -> pd.Series:
        out = np.zeros(len(a))
        if len(a):
            x, y = a.tolist(), b.tolist()
            for i in np.flatnonzero(could_be(x, y)).tolist():
                out[i] = core_ratio(x[i].split(), y[i].split())
        return pd.Series(out)

    return pairs.withColumn("parecido", of(F.array_join("palabras", " "), F.array_join("c_palabras", " ")))


def link(names: DataFrame, companies: DataFrame, vocabulary: Vocabulary | None = None) -> DataFrame:
    """One row (``nombre``, ``sector``, ``ruc``, ``parecido``) per distinct name that means one of the companies.

    ``names``: nombre, sector (NULL if unknown); ``companies``: ruc, nombre, ticker roots (``raices``); ``vocabulary``: of
    lines of business and regions, learned from the companies' names if not given. Exact
    copies of a name are linked once. A pair needs core words with a ratio of at least LEAST_RATIO, no other line of
    business and no other region; among several companies the best ratio wins, and within LEAD of it first the same
    line, region and note (ticker), then sector, then legal form. If two companies are still alike the name means
    none. NULL and blank names, and names without core words, mean none.
    """
    clean = names.where(F.trim("nombre") != "").groupBy("nombre").agg(F.mode("sector").alias("sector"))
    vocabulary = vocabulary or learn(companies, "nombre")
    n = kept(parsed(clean, "nombre", vocabulary).withColumn("nid", F.xxhash64("nombre")))
    c = kept(parsed(companies.where(F.trim("nombre") != ""), "nombre", vocabulary).dropDuplicates(["ruc", "linea", "region", "palabras"]).withColumn("cid", F.xxhash64("ruc", "linea", "region", F.array_join("palabras", " "))))
    pairs = candidates(n.select("nid", "linea", "region", "palabras"), c.select("cid", "linea", "region", "palabras"))
    # a line's usual sector, from the names that state both: at most one row per line of the vocabulary
    usual = n.where("linea <> '' and sector is not null").groupBy("linea").agg(F.mode("sector").alias("sector"))
    c = c.join(F.broadcast(usual), "linea", "left")
    other = c.select("cid", "ruc", *(F.col(x).alias(f"c_{x}") for x in ("linea", "region", "forma", "palabras", "sector")), "raices")
    full = pairs.join(n, "nid").join(small(other), "cid")
    differ = lambda x: (F.col(x) != "") & (F.col(x) != F.col(f"c_{x}"))
    scored = _ratios(full.where(~(differ("linea") | differ("region")))).where(F.col("parecido") >= LEAST_RATIO)
    same = lambda x: (F.col(x).eqNullSafe(F.col(f"c_{x}"))).cast("int")
    evidence = F.struct(
        (same("linea") + same("region") + 2 * F.array_contains("raices", F.col("nota")).cast("int")).alias("a"),
        F.coalesce((F.col("sector") == F.col("c_sector")).cast("int"), F.lit(0)).alias("b"),
        same("forma").alias("c"),
    )
    # a name's candidates are the few companies above the ratio, so its windows are small
    of_name = Window.partitionBy("nid")
    near = scored.withColumn("mejor", F.max("parecido").over(of_name)).where(F.col("parecido") >= F.col("mejor") - LEAD).withColumn("indicio", evidence)
    per = near.groupBy("nid", "nombre", "ruc").agg(F.max(F.struct("indicio", "parecido", "linea", "region", "c_linea", "c_region")).alias("x"))
    kept_ones = per.withColumn("m", F.max("x.indicio").over(of_name)).where(F.col("x.indicio") == F.col("m"))
    one = kept_ones.groupBy("nid", "nombre").agg(F.count_distinct("ruc").alias("n"), F.max_by("ruc", "x").alias("ruc"), F.max("x").alias("x"))
    return one.where("n = 1").select("nombre", "ruc", F.col("x.parecido").alias("parecido"), F.col("x.linea").alias("linea"), F.col("x.region").alias("region"), F.col("x.c_linea").alias("c_linea"), F.col("x.c_region").alias("c_region"))
