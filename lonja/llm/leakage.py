"""Passages of held-out items inside corpus documents, found with SimHash fingerprints of word windows.

A passage of 25 words with a word in six changed still holds a run of five unchanged words, so windows of five words
are fingerprinted at every position of items and documents. That run is found whatever the radius; the radius adds
windows with slips inside a word, for passages that are changed more than the definition allows for. A word enters the fingerprint with itself and its letter
triples, so a slip within a word moves few bits. Fingerprints of 64 bits are cut into four blocks of 16: two that differ
in at most three bits agree in one block, so looking every block up in a table finds all within that radius. Documents
then have to share enough word pairs with a stretch of the item, and at last are aligned with it word by word.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lonja.operators.shared import spread

WINDOW, RADIUS, BLOCKS = 5, 3, 4
#: Words of an item that have to be there, and the least share of one changed word in so many.
PASSAGE, CHANGED = 25, 6.0
#: Share of the word pairs of a stretch of PASSAGE item words that candidates have to hold. No passage is below it: a
#: change breaks at most two pairs, and breaking more than 12 of 24 in every stretch takes seven changes in each, but
#: a passage of fewer than 42 words has six at most, and in longer ones seven in the first stretch and seven in the
#: last are more than one word in six, or crowd into the eight words that both have and break nine pairs.
LEAST_SHARE = 0.5
#: Words of some stretch of PASSAGE item words that a passage has near the diagonal of its unchanged run. No passage has
#: fewer: seven changes in each stretch are the most (all of 43 words' seven in the seven words that the first and the last
#: stretch share), as eight in each need 48 words, whose first and last stretch share two.
LEAST_WORDS = 18
#: Pairs of texts that are aligned together, and the cells of their tables.
ALIGNED_AT_ONCE, CELLS_AT_ONCE = 256, 1 << 23
#: Words beyond those of the items that a worker keeps vectors of.
WORDS_KEPT = 300_000
#: Items that are held in memory at once; more are taken in blocks, each in its own pass over the documents.
ITEMS_PER_PASS = 20_000

TAG = re.compile(r"<[a-zA-Z/!?][^<>]*>")
ENTITY = re.compile(r"&(?:#\d+|#x[0-9a-fA-F]+|[a-zA-Z]{2,8});")
WORD = re.compile(r"[^\W_]+")


_MARKS = re.compile("[\u0300-\u036f\u00ad\u200b]+")
_IN_NUMBER = re.compile(r"[.,](?<=\d.)(?=\d)")
_HYPHENED = re.compile(r"-(?<=[a-z]-)\s*\n\s*(?=[a-z])")


def plain_words(text: str) -> list[str]:
    """Words without case, accents, punctuation, markup and layout; numbers are one word whatever separates their digits."""
    t = text
    if "<" in t:
        t = TAG.sub(" ", t)
    if "&" in t:
        t = ENTITY.sub(" ", t)
    t = t.casefold()
    if not t.isascii():
        t = _MARKS.sub("", unicodedata.normalize("NFKD", t))
    if "-" in t:
        t = _HYPHENED.sub("", t)
    return WORD.findall(_IN_NUMBER.sub("", t))


_MIX = np.uint64(0x9E3779B97F4A7C15)


#: Features whose bits are held at once.
FEATURES_AT_ONCE = 1 << 16


def _bits(features: list[bytes]) -> np.ndarray:
    """A row of 64 numbers, 1 or -1, per feature: the bits of its hash."""
    h = np.array([zlib.crc32(f) | zlib.adler32(f[::-1]) << 32 for f in features], dtype=np.uint64)
    h ^= h >> np.uint64(31)
    h *= _MIX
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).astype(np.float32) * 2 - 1


def word_vectors(words: list[str]) -> np.ndarray:
    """A row of 64 numbers per word: for each bit of the hashes of its features, how much set outweighs not set.

    A word weighs as much as all its letter triples together, and every word weighs the same. Words are taken whole,
    whatever their length.
    """
    out = np.zeros((len(words), 64), dtype=np.float32)
    features: list[bytes] = []
    places: list[int] = []
    weights: list[float] = []

    def add() -> None:
        np.add.at(out, np.array(places), _bits(features) * np.array(weights, dtype=np.float32)[:, None])
        features.clear(), places.clear(), weights.clear()

    for i, w in enumerate(words):
        padded = f"^{w}$".encode()
        n = len(padded) - 2
        for f, weight in ((b"=" + padded, 60.0), *((padded[k : k + 3], 60.0 / n) for k in range(n))):
            features.append(f)
            places.append(i)
            weights.append(weight)
            if len(features) >= FEATURES_AT_ONCE:
                add()
    if features:
        add()
    return np.round(out).astype(np.int16)


class Vocabulary:
    """Numbers and vectors of words, kept for the words of a worker's batches."""

    def __init__(self) -> None:
        self.number: dict[str, int] = {}
        self.vectors = np.zeros((0, 64), dtype=np.int16)

    def forget(self, known: int) -> None:
        """Leaves only the first ``known`` words."""
        for w in list(self.number)[known:]:
            del self.number[w]
        self.vectors = self.vectors[:known].copy()

    def ids(self, words: list[str]) -> np.ndarray:
        new = [w for w in dict.fromkeys(words) if w not in self.number]
        if new:
            self.number.update(zip(new, range(len(self.number), len(self.number) + len(new))))
            self.vectors = np.vstack([self.vectors, word_vectors(new)])
        return np.fromiter(map(self.number.__getitem__, words), dtype=np.int64, count=len(words))


def fingerprints(ids: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """The SimHash of every window of WINDOW words; texts shorter than a window have none."""
    if len(ids) < WINDOW:
        return np.zeros(0, dtype=np.uint64)
    out = []
    for a in range(0, len(ids) - WINDOW + 1, 65_536):  # long texts in pieces
        part = ids[a : a + 65_536 + WINDOW - 1]
        v = vectors[part]
        s = v[: len(part) - WINDOW + 1].astype(np.int32)
        for k in range(1, WINDOW):
            s += v[k : len(part) - WINDOW + 1 + k]
        out.append(np.packbits(s > 0, axis=1).view(">u8").ravel().astype(np.uint64))
    return np.concatenate(out)


def _stretches(values: np.ndarray) -> np.ndarray:
    """Sums over every run of PASSAGE - 1 pairs."""
    c = np.zeros(len(values) + 1)
    np.cumsum(values, out=c[1:])
    n = PASSAGE - 1
    return c[n:] - c[:-n]


@dataclass
class Items:
    """Items with the multi-index of their windows: per block a table from its 16 bits to windows."""

    ids: list[int]
    words: list[np.ndarray]  # numbers of their words, below known
    pairs: list[np.ndarray]  # numbers of their neighbouring word pairs, places in ``codes``
    codes: np.ndarray
    seen: np.ndarray  # a flag per pair, all down between uses
    prints: np.ndarray
    of: np.ndarray  # item of a window
    at: np.ndarray  # its place
    tables: list[tuple[np.ndarray, np.ndarray]]
    vocabulary: Vocabulary
    known: int


def build(items: list[tuple[int, str]]) -> Items:
    v = Vocabulary()
    ids, words = [], []
    for i, t in items:
        w = plain_words(t or "")
        if len(w) >= PASSAGE:
            ids.append(i)
            words.append(v.ids(w))
    known = len(v.number)
    prints = [fingerprints(w, v.vectors) for w in words]
    empty = np.zeros(0, dtype=np.int64)
    allp = np.concatenate(prints) if prints else np.zeros(0, dtype=np.uint64)
    tables = []
    for b in range(BLOCKS):
        key = ((allp >> np.uint64(16 * b)) & np.uint64(0xFFFF)).astype(np.int64)
        order = np.argsort(key, kind="stable")
        tables.append((np.searchsorted(key[order], np.arange(65_537)), order))
    own = [w[:-1] * known + w[1:] for w in words]
    codes = np.unique(np.concatenate(own)) if own else empty
    pairs = [np.searchsorted(codes, p) for p in own]
    of = np.concatenate([np.full(len(p), k) for k, p in enumerate(prints)]) if prints else empty
    at = np.concatenate([np.arange(len(p)) for p in prints]) if prints else empty
    return Items(ids, words, pairs, codes, np.zeros(len(codes) + 1, dtype=bool), allp, of, at, tables, v, known)


_built: tuple[str, Items] | None = None


def index_of(name: str, items: list[tuple[int, str]]) -> Items:
    """The index of the items called ``name``; a Python worker builds it once and keeps the last one for its next tasks."""
    global _built
    if _built is None or _built[0] != name:
        _built = name, build(items)
    return _built[1]


def near_windows(prints: np.ndarray, items: Items) -> tuple[np.ndarray, np.ndarray]:
    """(place, window) of all pairs of fingerprints within RADIUS."""
    places, windows = [], []
    for b, (starts, order) in enumerate(items.tables):
        key = ((prints >> np.uint64(16 * b)) & np.uint64(0xFFFF)).astype(np.int64)
        lo, n = starts[key], starts[key + 1] - starts[key]
        total = int(n.sum())
        if not total:
            continue
        where = np.repeat(np.arange(len(prints)), n)
        pick = order[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(total)]
        ok = np.bitwise_count(prints[where] ^ items.prints[pick]) <= RADIUS
        places.append(where[ok])
        windows.append(pick[ok])
    if not places:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    both = np.unique(np.stack([np.concatenate(places), np.concatenate(windows)], axis=1), axis=0)
    return both[:, 0], both[:, 1]


def pair_numbers(ids: np.ndarray, items: Items) -> np.ndarray:
    """The number of each neighbouring pair of words among the items' pairs; of those that no item has, one more than the last."""
    none = len(items.codes)
    if not none or len(ids) < 2:
        return np.full(max(0, len(ids) - 1), none)
    codes = np.where((ids[:-1] < items.known) & (ids[1:] < items.known), ids[:-1] * items.known + ids[1:], -1)
    at = np.minimum(np.searchsorted(items.codes, codes), none - 1)
    return np.where(items.codes[at] == codes, at, none)


def share(item: np.ndarray, region: np.ndarray, seen: np.ndarray) -> float:
    """The best share of word pairs that a stretch of PASSAGE item words has in common with the region's pairs."""
    seen[region] = True
    seen[-1] = False
    best = float(_stretches(seen[item]).max()) / (PASSAGE - 1)
    seen[region] = False
    return best


def near_diagonals(own: np.ndarray, region: np.ndarray, diagonals: np.ndarray) -> int:
    """The most words of a stretch of PASSAGE item words that the region has near one of the diagonals (place in the region
    less place in the item). Words added or missing in a passage move it off the diagonal by as many as there may be."""
    off, n, best = int(len(own) / CHANGED) + 1, len(own), 0
    padded = np.full(len(region) + 2 * (n + off), -1, dtype=region.dtype)
    padded[n + off : n + off + len(region)] = region
    c = np.zeros(n + 1, dtype=np.int64)
    for d in set(np.clip(diagonals, -n, len(region)).tolist()):
        there = np.zeros(n, dtype=bool)
        for shift in range(n + d, n + d + 2 * off + 1):
            there |= padded[shift : shift + n] == own
        np.cumsum(there, out=c[1:])
        best = max(best, int((c[PASSAGE:] - c[:-PASSAGE]).max()))
        if best >= LEAST_WORDS:
            break
    return best


def aligned(pairs: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """Per pair of texts the places (rows of two) of equal words, by number, in their longest common subsequence.

    All pairs are aligned together, a row of all their tables at a time; shorter texts are filled up with words that
    equal nothing.
    """
    n, m = (max(len(p[k]) for p in pairs) for k in (0, 1))
    a, b = np.full((len(pairs), n), -1, dtype=np.int32), np.full((len(pairs), m), -2, dtype=np.int32)
    for k, (x, y) in enumerate(pairs):
        a[k, : len(x)], b[k, : len(y)] = x, y
    best = np.zeros((n + 1, len(pairs), m + 1), dtype=np.int16)
    for i in range(n):
        row = np.maximum(best[i, :, 1:], best[i, :, :-1] + (a[:, i, None] == b))
        np.maximum.accumulate(row, axis=1, out=best[i + 1, :, 1:])
    i, j = np.full(len(pairs), n), np.full(len(pairs), m)
    mate = np.full((len(pairs), n), -1, dtype=np.int64)
    live = np.arange(len(pairs))
    while len(live):
        x, y = i[live], j[live]
        here, above, left = best[x, live, y], best[x - 1, live, y], best[x, live, y - 1]
        hit = (a[live, x - 1] == b[live, y - 1]) & (here == best[x - 1, live, y - 1] + 1)
        mate[live[hit], x[hit] - 1] = y[hit] - 1
        up = ~hit & (above >= left)
        i[live] = x - (hit | up)
        j[live] = y - (hit | ~up)
        live = live[(i[live] > 0) & (j[live] > 0)]
    return [np.stack([np.flatnonzero(r >= 0), r[r >= 0]], axis=1) for r in mate]


def longest_passage(p: np.ndarray, n: int, m: int, changed: float = CHANGED) -> int:
    """Most consecutive of ``n`` item words that a region of ``m`` holds in order with at most one in ``changed`` changed,
    added or missing; ``p``: the places of their equal words.

    A run may begin and end with changed words, as long as the region has words in their places.
    """
    if len(p) < PASSAGE // 2:
        return 0
    gap = np.maximum(np.diff(p[:, 0]), np.diff(p[:, 1])) - 1
    errors = np.r_[0, np.cumsum(gap)]
    length = p[None, :, 0] - p[:, 0][:, None] + 1
    wrong = errors[None, :] - errors[:, None]
    ok = (length > 0) & (wrong * changed <= length)
    before, after = p.min(axis=1), (np.array([n, m]) - 1 - p).min(axis=1)
    more = np.minimum(before[:, None] + after[None, :], (length - wrong * changed) // (changed - 1))
    return int((length + more)[ok].max())


def leaks(texts: list[str], items: Items, least: int = PASSAGE) -> list[tuple[int, int, int]]:
    """(text, item, words held) of the items that the texts hold a passage of."""
    v = items.vocabulary
    cut = [plain_words(t) for t in texts]
    ids = v.ids([w for ws in cut for w in ws])
    n = np.array([len(ws) for ws in cut])
    starts = np.cumsum(n) - n
    if not len(ids) or not items.ids:
        return []
    prints = fingerprints(ids, v.vectors)
    place, window = near_windows(prints, items)
    text = np.searchsorted(starts, place, side="right") - 1
    inside = place + WINDOW <= starts[text] + n[text]  # not a window across two texts
    place, window, text = place[inside], window[inside], text[inside]
    if not len(place):
        return []
    item, diagonal = items.of[window], place - items.at[window]
    order = np.lexsort((diagonal, item, text))
    text, item, diagonal = text[order], item[order], diagonal[order]
    sizes = np.array([len(w) for w in items.words])
    # hits on near diagonals belong to one copy of the passage
    new = np.r_[True, (text[1:] != text[:-1]) | (item[1:] != item[:-1]) | (np.diff(diagonal) > sizes[item[1:]])]
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(text)] - 1
    numbers = pair_numbers(ids, items)
    places: list[tuple[int, int]] = []
    texts_of: list[tuple[np.ndarray, np.ndarray]] = []
    for f, e in zip(first, last):
        d, k = int(text[f]), int(item[f])
        own = items.words[k]
        lo, hi = max(starts[d], diagonal[f] - 12), min(starts[d] + n[d], diagonal[e] + len(own) + 12)
        if share(items.pairs[k], numbers[lo : hi - 1], items.seen) >= LEAST_SHARE and near_diagonals(own, ids[lo:hi], diagonal[f : e + 1] - lo) >= LEAST_WORDS:
            places.append((d, k))
            texts_of.append((own, ids[lo:hi]))
    longest: dict[tuple[int, int], int] = {}
    order = sorted(range(len(places)), key=lambda i: (len(texts_of[i][0]), len(texts_of[i][1])))  # alike sizes together
    at = 0
    while at < len(order):
        some = [texts_of[i] for i in order[at : at + ALIGNED_AT_ONCE]]
        widest = max(len(x) + 1 for x, _ in some) * max(len(y) + 1 for _, y in some)
        some = some[: max(1, CELLS_AT_ONCE // widest)]
        for i, p in zip(order[at:], aligned(some)):
            n = longest_passage(p, len(texts_of[i][0]), len(texts_of[i][1]))
            longest[places[i]] = max(longest.get(places[i], 0), n)
        at += len(some)
    return [(d, items.ids[k], n) for (d, k), n in longest.items() if n >= least]


def leaked(docs: DataFrame, idc: str, text: str, items: DataFrame, item_id: str, item_text: str) -> DataFrame:
    """One row (``doc``, ``item``, ``palabras``) per document and item of which it holds a passage: at least PASSAGE
    consecutive words in order, at most one in CHANGED altered, added or missing.

    Whole texts are read, every copy of a document counts, and a document with several items has a row for each. Items
    of fewer than PASSAGE words, NULL and empty texts match nothing. The items travel to the executors: they are the
    fixed held-out set, taken in blocks of ITEMS_PER_PASS. Documents are read once per block, without a shuffle.
    """
    rows = items.select(F.col(item_id).cast("long"), F.col(item_text)).where(F.col(item_id).isNotNull() & F.col(item_text).isNotNull())
    count = rows.count()
    blocks = max(1, -(-count // ITEMS_PER_PASS))
    parts = [rows.where(F.pmod(F.xxhash64(item_id), F.lit(blocks)) == b) if blocks > 1 else rows for b in range(blocks)]
    src = spread(docs.select(F.col(idc).alias("doc"), F.col(text).alias("t")).where("t is not null"))
    kind = src.schema["doc"].dataType.simpleString()
    spark = docs.sparkSession
    out = None
    for part in parts:
        sent = spark.sparkContext.broadcast([tuple(r) for r in part.collect()])  # at most ITEMS_PER_PASS held-out items
        name = uuid.uuid4().hex

        def run(batches: Iterator[pd.DataFrame], sent=sent, name=name) -> Iterator[pd.DataFrame]:
            known = index_of(name, sent.value)
            for pdf in batches:
                texts, ids, found = pdf["t"].tolist(), pdf["doc"], []
                size = a = 0
                for z, t in enumerate(texts, 1):  # about a million characters at a time, and whole texts
                    size += len(t)
                    if size > 1_000_000 or z == len(texts):
                        found += [(ids.iat[a + d], i, n) for d, i, n in leaks(texts[a:z], known)]
                        size, a = 0, z
                        if len(known.vocabulary.number) > known.known + WORDS_KEPT:
                            known.vocabulary.forget(known.known)
                yield pd.DataFrame(found, columns=["doc", "item", "palabras"])

        one = src.mapInPandas(run, f"doc {kind}, item long, palabras long")
        out = one if out is None else out.unionAll(one)
    return out
