"""Languages of documents and of their paragraphs: family first, then one-versus-one linear support vector machines."""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lonja.operators.shared import spread

FAMILIES = {"romance": ("es", "pt", "fr", "it"), "germanica": ("en", "de")}
LANGUAGES = tuple(x for f in FAMILIES.values() for x in f)
#: The languages in falling order of their codes: of equal shares the greatest code wins.
NAME_ORDER = sorted(range(len(LANGUAGES)), key=lambda i: LANGUAGES[i], reverse=True)
BY_NAME = np.array([LANGUAGES[i] for i in NAME_ORDER], dtype=object)
#: The training sample: at most so many labelled documents per language, of at most so many characters each.
SAMPLE_DOCS, SAMPLE_CHARS = 150, 20_000
#: Hashed features of a word, and rounds of training in which labels the model contradicts are left out.
DIMENSIONS, ROUNDS, STEPS, PENALTY = 2048, 3, 100, 1e-4
#: How many words' worth of evidence the rest of a document counts for in each of its paragraphs, of any length.
PRIOR_WORDS = 4.0
#: Words whose scores a worker keeps.
WORDS_KEPT = 300_000

#: Codes and names of the languages in common use; what follows - or _ in a code is a region. Fixed values.
NAMES = {
    "es": "es spa español espanol spanish castellano espagnol spanisch spagnolo espanhol",
    "en": "en eng inglés ingles english anglais englisch inglese inglês",
    "pt": "pt por portugués portugues portuguese português portugais portugiesisch portoghese",
    "fr": "fr fra fre francés frances french français francais französisch francese francês",
    "it": "it ita italiano italian italien italienisch",
    "de": "de deu ger alemán aleman german deutsch allemand tedesco alemão",
}


def label(c: Column) -> Column:
    """The two-letter code a written label stands for, or NULL if it names none of the languages."""
    known = {n: k for k, v in NAMES.items() for n in v.split()}
    t = F.lower(F.trim(c))
    table = F.create_map(*(F.lit(x) for kv in known.items() for x in kv))
    return F.coalesce(F.try_element_at(table, t), F.try_element_at(table, F.regexp_extract(t, r"^([a-z]{2,3})[-_]", 1)))


WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
BREAK = re.compile(r"\r?\n[ \t\r]*\n\s*")


def paragraphs(text: str) -> list[str]:
    """The paragraphs of a text, separated by blank lines."""
    return [p for p in BREAK.split(text) if p.strip()]


def words(text: str) -> list[str]:
    return WORD.findall(text.lower().replace("’", "'"))


def _plain(w: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", w) if not unicodedata.combining(c))


def features(word: str) -> np.ndarray:
    """Hashed places of the word, its beginnings and endings, and its runs of one to four letters."""
    own = {f"={word}", f"={_plain(word)}"}
    for w in {word, _plain(word)}:
        padded = f"^{w}$"
        own |= {padded[i : i + n] for n in (2, 3, 4) for i in range(len(padded) - n + 1)} | set(w)
    return np.fromiter((zlib.crc32(x.encode()) % DIMENSIONS for x in own), dtype=np.int64)


def _vector(text: str, cache: dict[str, np.ndarray]) -> np.ndarray:
    v = np.zeros(DIMENSIONS, dtype=np.float32)
    ws = words(text)
    for w in ws:
        if (f := cache.get(w)) is None:
            f = cache[w] = features(w)
        np.add.at(v, f, 1.0 / len(f))
    return v / max(1, len(ws))


def train_svm(x: np.ndarray, y: np.ndarray, steps: int = STEPS, penalty: float = PENALTY) -> tuple[np.ndarray, float]:
    """A linear support vector machine (squared hinge, classes weighted equally) by accelerated gradient steps; y is 1 or -1."""
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    a = np.hstack([x, np.ones((len(x), 1), dtype=np.float32)])
    v = np.ones(a.shape[1], dtype=np.float32)
    for _ in range(12):  # the step size from the largest eigenvalue
        v = a.T @ (weight * (a @ v))
        size = float(np.linalg.norm(v)) or 1.0
        v /= size
    rate = 1.0 / (2 * size + penalty)
    w = z = np.zeros(a.shape[1], dtype=np.float32)
    t = 1.0
    for _ in range(steps):
        slack = np.maximum(0, 1 - y * (a @ z))
        new = z - rate * (-2 * (a.T @ (weight * y * slack)) + penalty * z)
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        z, w, t = new + (t - 1) / t2 * (new - w), new, t2
    return w[:-1], float(w[-1])


PAIRS = (("romance", "germanica"), *(p for f in FAMILIES.values() for p in combinations(f, 2)))


@dataclass(frozen=True)
class Model:
    """One row of ``weights``, one bias and one slope per machine; ``pairs`` names what each tells apart (first: positive).

    The slope turns a machine's margin into a probability; it is fitted to margins of texts that were not trained on.
    """

    weights: np.ndarray
    bias: np.ndarray
    pairs: tuple[tuple[str, str], ...]
    slopes: np.ndarray = field(default_factory=lambda: np.full(len(PAIRS), 3.0))

    def decide(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(language, confidence) of rows of margins: the family by the first machine, then most votes within it."""
        sure = 1 / (1 + np.exp(-self.slopes * np.abs(margins)))
        romance = margins[:, 0] > 0
        names, conf = np.empty(len(margins), dtype=object), np.zeros(len(margins))
        for fam, rows in (("romance", romance), ("germanica", ~romance)):
            own = [i for i, p in enumerate(self.pairs) if i and p[0] in FAMILIES[fam]]
            votes = np.zeros((len(margins), len(FAMILIES[fam])))
            for i in own:
                a, b = (FAMILIES[fam].index(q) for q in self.pairs[i])
                m = np.clip(margins[:, i], -2, 2)
                votes[:, a] += (m > 0) + 0.01 * m
                votes[:, b] += (m <= 0) - 0.01 * m
            best = votes.argmax(axis=1)
            worst = np.ones(len(margins))
            for i in own:
                for side, q in zip((1, -1), self.pairs[i]):
                    won = best == FAMILIES[fam].index(q)
                    p = 1 / (1 + np.exp(-self.slopes[i] * side * margins[:, i]))
                    worst = np.where(won, np.minimum(worst, p), worst)
            names[rows] = np.array(FAMILIES[fam], dtype=object)[best][rows]
            conf[rows] = (sure[:, 0] * worst)[rows]
        return names, conf


def _machines(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    family = {lang: f for f, ls in FAMILIES.items() for lang in ls}
    fam = np.array([family[v] for v in y])
    ws, bs = [], []
    for a, b in PAIRS:
        of = fam if a in FAMILIES else y
        rows = np.flatnonzero((of == a) | (of == b))
        sign = np.where(of[rows] == a, 1.0, -1.0).astype(np.float32)
        if len(set(sign.tolist())) < 2:
            only = 1.0 if (sign > 0).any() else -1.0
            w, c = np.zeros(DIMENSIONS, dtype=np.float32), only if len(rows) else 0.0
        else:
            w, c = train_svm(x[rows], sign)
        ws.append(w)
        bs.append(c)
    return np.array(ws), np.array(bs)


def slope(margins: np.ndarray, positive: np.ndarray) -> float:
    """The slope of the logistic curve that fits the margins best, by Newton steps; a little of a slope of 3 is mixed in,
    so that a machine that makes no error on the sample is not without doubt."""
    s = 3.0
    m = np.where(positive, margins, -margins)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(s * m, -30, 30)))
        gradient = (m * (1 - p)).sum() - (s - 3.0)
        s = float(np.clip(s + gradient / ((m * m * p * (1 - p)).sum() + 1.0), 0.2, 20.0))
    return s


def train(texts: list[str], labels: list[str]) -> Model:
    """Trains on labelled paragraphs. Labels may be wrong in part: after each round those the model contradicts are left
    out. Languages without any example are never predicted. Slopes come from machines trained on every other text."""
    cache: dict[str, np.ndarray] = {}
    x = np.array([_vector(t, cache) for t in texts], dtype=np.float32) * 8
    y = np.array(labels)
    ok = np.ones(len(y), dtype=bool)
    model = None
    for _ in range(ROUNDS):
        w, c = _machines(x[ok], y[ok])
        model = Model(w * 8, c, PAIRS)
        ok = model.decide((x / 8) @ model.weights.T + model.bias)[0] == y
    half = np.arange(len(y)) % 2 == 0
    w, c = _machines(x[ok & half], y[ok & half]) if (ok & half).any() else (model.weights / 8, model.bias)
    margins, rest = x[ok & ~half] @ w.T + c, y[ok & ~half]
    slopes = []
    for i, (a, b) in enumerate(PAIRS):
        sides = [set(FAMILIES.get(q, (q,))) for q in (a, b)]
        rows = np.array([v in sides[0] | sides[1] for v in rest], dtype=bool)
        slopes.append(slope(margins[rows, i], np.array([v in sides[0] for v in rest[rows]], dtype=bool)) if rows.any() else 3.0)
    return replace(model, slopes=np.array(slopes))


def fit(docs: DataFrame, idc: str, text: str, lang: Column, per_language: int = SAMPLE_DOCS) -> Model:
    """A model from a bounded sample of labelled documents: per label the ``per_language`` documents of least id hash."""
    labelled = docs.select(F.xxhash64(F.lit(10), F.col(idc)).alias("h"), F.col(text).alias("t"), label(lang).alias("l")).where((F.length("t") <= SAMPLE_CHARS) & F.col("l").isNotNull())
    first = labelled.withColumn("r", F.row_number().over(Window.partitionBy("l").orderBy("h", "t"))).where(F.col("r") <= per_language)
    rows = first.select("t", "l").orderBy("l", "h", "t").collect()  # at most per_language x 6 short texts
    texts, labels = [], []
    for t, l in rows:
        for p in paragraphs(t):
            if sum(map(len, words(p))) >= 40:
                texts.append(p)
                labels.append(l)
    return train(texts, labels) if texts else Model(np.zeros((len(PAIRS), DIMENSIONS), dtype=np.float32), np.zeros(len(PAIRS)), PAIRS)


def detect(docs: DataFrame, idc: str, text: str, lang: Column, model: Model) -> DataFrame:
    """Rows (``id``, ``segmento``, ``lang``, ``confianza``, ``letras``, ``etiqueta``, ``mezclado``) of every document.

    Segment -1 is the document: the language with most letters over its paragraphs. Segments 0, 1, ... are its
    paragraphs (separated by blank lines), each with the language of the whole paragraph; ``mezclado`` tells whether
    the document's paragraphs are in more than one language. In each paragraph, whatever its length, the whole document
    counts as PRIOR_WORDS further words, so one of a word or two leans on the others. ``confianza`` of a document is the
    mean of its paragraphs' by letters, those in other languages counting 0. ``etiqueta`` is the code the stored label
    stands for, NULL if it names no language. Every text is given one of the six languages.
    NULL and empty texts, and texts without words, have no rows; neither do paragraphs without words. The whole text is
    read, whatever its length. Every document counts on its own, so copies come out alike.
    """
    by_feature, bias = np.ascontiguousarray(model.weights.T), model.bias
    src = spread(docs.select(F.col(idc).alias("id"), F.col(text).alias("t"), label(lang).alias("etiqueta")))
    kind = src.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number: dict[str, int] = {}
        scores = np.zeros((0, len(PAIRS)))
        for pdf in batches:
            found = [(row, k, words(p)) for row, t in enumerate(pdf["t"]) for k, p in enumerate(paragraphs(t))]
            found = [f for f in found if f[2]]
            if not found:
                continue
            if len(number) > WORDS_KEPT:
                number, scores = {}, scores[:0]
            flat = [w for _, _, ws in found for w in ws]
            if new := [w for w in dict.fromkeys(flat) if w not in number]:
                number.update(zip(new, range(len(number), len(number) + len(new))))
                own = [features(w) for w in new]
                sizes = np.array([len(f) for f in own])
                starts = np.cumsum(sizes) - sizes
                scores = np.vstack([scores, np.add.reduceat(by_feature[np.concatenate(own)], starts, axis=0) / sizes[:, None]])
            ids = np.fromiter(map(number.__getitem__, flat), dtype=np.int64, count=len(flat))
            n = np.array([len(ws) for _, _, ws in found])
            sums = np.add.reduceat(scores[ids], np.cumsum(n) - n, axis=0)
            row = np.array([r for r, _, _ in found])
            first = np.flatnonzero(np.r_[True, np.diff(row) > 0])
            whole = np.add.reduceat(sums, first, axis=0) / np.add.reduceat(n, first)[:, None]
            doc = np.cumsum(np.r_[True, np.diff(row) > 0]) - 1
            names, conf = model.decide((sums + PRIOR_WORDS * whole[doc]) / (n + PRIOR_WORDS)[:, None] + bias)
            letters = np.array([sum(map(len, ws)) for _, _, ws in found])
            share = np.stack([np.add.reduceat(letters * (names == x), first) for x in LANGUAGES], axis=1)
            best = BY_NAME[share[:, NAME_ORDER].argmax(axis=1)]
            mixed = (share > 0).sum(axis=1) > 1
            own_lang = names == best[doc]
            sure = np.add.reduceat(letters * conf * own_lang, first) / np.add.reduceat(letters, first)
            at = row[first]
            segments = np.array([k for _, k, _ in found])
            docs_out = {"id": pdf["id"].to_numpy()[at], "segmento": -1, "lang": best, "confianza": sure, "letras": share.sum(axis=1), "etiqueta": pdf["etiqueta"].to_numpy()[at], "mezclado": mixed}
            parts = {"id": pdf["id"].to_numpy()[row], "segmento": segments, "lang": names, "confianza": conf, "letras": letters, "etiqueta": pdf["etiqueta"].to_numpy()[row], "mezclado": mixed[doc]}
            yield pd.concat([pd.DataFrame(docs_out), pd.DataFrame(parts)], ignore_index=True)

    return src.where("t is not null").mapInPandas(run, f"id {kind}, segmento long, lang string, confianza double, letras long, etiqueta string, mezclado boolean")
