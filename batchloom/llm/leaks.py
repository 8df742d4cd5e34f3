"""Evaluation texts leaking into training text.

Pages and held-out items are reduced to streams of letter classes: case,
accents, blanks, punctuation and line breaks vanish, and letters that scanners
confuse share a class. Of a page's k-grams the smallest hash in every window is
kept (winnowing); of an item all are, which holds its own winnowed ones and
finds more under misreadings. So any shared span of at least ``K + WINDOW - 1``
classes has a fingerprint in common, whatever surrounds it. The fingerprints of
both sides are joined on their hash, and every hit is extended through
misreadings and across inserted adverts to measure how many successive words of
the item the page holds; hits of one stretch of equal letters are extended once.

Before that, the columns of a page are told apart by the boxes of its lines, so
that columns read straight across, or run together in one line, are each read
on their own; passages that are UTF-8 read with a wrong codec are set right.

The corpus is read once, however many items there are. A table of bits of fixed
size, in which every item fingerprint is marked, keeps back the page
fingerprints that are in no item. Items of at most ``BLOCK`` letters are
broadcast, and the join is a look-up in the tasks that read the pages. More
items go in blocks of that size: pages are then written as letters and
fingerprints, joined with the items' fingerprints in Spark to tell which pages
each block hits, and only these are read and extended with the block. Pages are
not shuffled whole unless there are blocks, and no group of pages or hits is
gathered anywhere.

How far an extension can get is bounded for all hits at once: first up to the
first insertion on either side, which is where most end, and beyond it for those
that may go on; those that can reach ``MIN_WORDS`` words are then extended one
by one.

Defined results for odd input: NULL or empty pages and items never match; of
boxes that don't fit the lines, or are NULL, none are used and the text is read
as it stands; repeated items and pages each get their own row; an item with
fewer than ``MIN_WORDS`` words cannot be found.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from batchloom.llm.encoding import unscrambled
from batchloom.session import durable

K = 12  # letters of a k-gram
WINDOW = 6  # k-grams of which one is kept
MIN_WORDS = 18  # successive words of an item that make a leak
BLOCK = 4_000_000  # letters of items that are broadcast at a time
LOT = 2_000_000  # letters of pages that are read or extended at a time
BITS = 24  # logarithm of the number of bits that keep back page fingerprints
ADVERT = 900  # letters of an insertion that may be passed over
# Letters that scanners take for one another, by the class they share.
CONFUSED = {"ß": "s", "œ": "o", "æ": "a", "1": "l", "i": "l", "|": "l", "!": "l", "0": "o", "5": "s", "8": "b", "c": "e", "y": "v", "f": "t"}
SEED, SKIPS = 9, (0, 1, 2, 3, 4, 5, 6, 7, 9, 11)  # letters that show where an item goes on after an insertion, and those left out before
_STEPS = ((1, 1), (1, 2), (2, 1), (2, 2), (0, 1), (1, 0), (0, 2), (2, 0), (3, 3), (1, 3), (3, 1), (2, 3), (3, 2), (0, 3), (3, 0), (4, 4))


def _classes() -> np.ndarray:
    """Code point (below 0x3000) to letter class; 0 for whatever is no letter or digit."""
    base: dict[int, str] = {}
    for cp in range(0x3000):
        first = unicodedata.normalize("NFKD", chr(cp).lower())[:1]
        first = CONFUSED.get(first, first)
        if first.isalnum():
            base[cp] = first
    number = {c: i + 1 for i, c in enumerate(sorted(set(base.values())))}
    out = np.zeros(0x3000, dtype=np.uint16)
    for cp, c in base.items():
        out[cp] = number[c]
    return out


CLASSES = _classes()


def letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes of all letters of ``texts``, the text each is of, and its place in the joined texts."""
    points = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    sizes = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
    found = CLASSES[np.minimum(points, 0x2FFF)]
    at = np.nonzero(found)[0]
    owner = np.repeat(np.arange(len(texts)), sizes)[: len(points)]
    return found[at], owner[at], at


def hashes(classes: np.ndarray, owner: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the k-gram that starts at each letter, and whether it lies within one text."""
    n = max(0, len(classes) - k + 1)
    out = np.zeros(n, dtype=np.uint64)
    wide = classes.astype(np.uint64)
    for j in range(k):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += wide[j : j + n]
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    return out, owner[:n] == owner[k - 1 : k - 1 + n]


def winnowed(values: np.ndarray, inside: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Places whose value is the smallest of some window of ``window`` places."""
    if not len(values):
        return np.zeros(0, dtype=np.int64)
    top = np.uint64(2**64 - 1)
    v = np.where(inside, values, top)
    edge = np.full(window - 1, top)
    low = np.concatenate([edge, v, edge])
    least = low[: len(v) + window - 1].copy()
    for j in range(1, window):
        np.minimum(least, low[j : j + len(least)], out=least)
    most = least[: len(v)].copy()
    for j in range(1, window):
        np.maximum(most, least[j : j + len(v)], out=most)
    return np.nonzero((most == v) & inside)[0]


def slots(values: np.ndarray, n_bits: int) -> np.ndarray:
    """The bit, of ``n_bits``, a power of two, that stands for each hash."""
    return (values >> np.uint64(65 - n_bits.bit_length())).astype(np.int64)


class Items:
    """Index of the k-grams of some items; their letters and words."""

    def __init__(self, ids: list, texts: list[str]):
        self.ids = ids
        classes, owner, at = letters(texts)
        self.owner = owner
        self.start = np.searchsorted(owner, np.arange(len(texts) + 1))
        self.classes = classes
        self.text = classes.astype("<u2").tobytes().decode("utf-16-le")
        self.back = self.text[::-1]
        words = np.cumsum(np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32) <= 0x20)
        _, self.word = np.unique(words[at], return_inverse=True)
        values, inside = hashes(classes, owner)
        places = np.nonzero(inside)[0]
        order = np.argsort(values[places], kind="stable")
        self.values, self.places = values[places][order], places[order]
        self.fours, self.back_fours = _fours(classes), _fours(classes[::-1])
        self.seeds = Seeds(classes, owner)

    def hits(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the hash, item place) of every equal hash."""
        left, right = np.searchsorted(self.values, values, "left"), np.searchsorted(self.values, values, "right")
        n = right - left
        which = np.repeat(np.arange(len(n)), n)
        return which, self.places[left[which] + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)]


class Seeds:
    """The seeds, ``SEED`` letters each, of the letters of items, numbered alike for both directions of reading."""

    def __init__(self, classes: np.ndarray, owner: np.ndarray):
        values, inside = hashes(classes, owner, SEED)
        self.values = np.unique(values[inside])
        self.ahead = np.full(len(classes) + 16, -1)  # number of the seed that starts at each letter
        self.ahead[: len(values)][inside] = np.searchsorted(self.values, values[inside])
        self.behind = np.full(len(classes) + 16, -1)  # and of that which starts there for who reads backwards
        self.behind[: len(values)] = self.ahead[: len(values)][::-1]
        # Seeds by their first bits, of which there are more than seeds.
        self.shift = np.uint64(64 - max(20, len(self.values).bit_length() + 1))
        self.bucket = np.searchsorted(self.values >> self.shift, np.arange((1 << 64 - int(self.shift)) + 1, dtype=np.uint64)).astype(np.int32)
        self.some = self.bucket[1:] > self.bucket[:-1]

    def numbered(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of ``values`` are seeds, and their numbers."""
        bucket = (values >> self.shift).astype(np.int64)
        at = np.flatnonzero(self.some[bucket])
        n, end = self.bucket[bucket[at]].astype(np.int64), self.bucket[bucket[at] + 1]
        found, numbers = [], []
        while len(at):
            same = self.values[n] == values[at]
            found.append(at[same])
            numbers.append(n[same])
            n += 1
            on = ~same & (n < end)
            at, n, end = at[on], n[on], end[on]
        return np.concatenate([*found, np.zeros(0, dtype=np.int64)]), np.concatenate([*numbers, np.zeros(0, dtype=np.int64)])


def exact_runs(items: Items, owner: np.ndarray, start: np.ndarray, fours: np.ndarray, back_fours: np.ndarray, page_at: np.ndarray, item_at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(page place, item place, letters) of every longest stretch of equal letters that holds a hit, each once.

    An extension is the same from wherever in a stretch it starts, so one for each stretch covers all hits.
    """
    # Hits that overlap on one diagonal are of one stretch.
    n, m = len(items.owner), len(owner)
    diagonal, i = np.divmod(np.sort((page_at - item_at + n) * n + item_at), n)
    j = diagonal - n + i
    q, p = items.owner[i], owner[j]
    new = np.ones(len(i), dtype=bool)
    new[1:] = (diagonal[1:] != diagonal[:-1]) | (i[1:] - i[:-1] > K) | (q[1:] != q[:-1]) | (p[1:] != p[:-1])
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(i)] - 1
    i0, j0, i1, j1 = i[first], j[first], i[last] + K, j[last] + K
    q, p = q[first], p[first]
    i1 += _equal(items.fours, i1, items.start[q + 1], fours, j1, start[p + 1])
    i0 -= (more := _equal(items.back_fours, n - i0, n - items.start[q], back_fours, m - j0, m - start[p]))
    j0 -= more
    once = np.ones(len(i0), dtype=bool)
    once[1:] = (i0[1:] != i0[:-1]) | (j0[1:] != j0[:-1])  # those of one diagonal follow one another
    j0, i0, i1, p = j0[once], i0[once], i1[once], p[once]
    order = np.argsort(p.astype(np.min_scalar_type(len(start))), kind="stable")  # what is read for one page is near by
    return j0[order], i0[order], (i1 - i0)[order]


def _fours(classes: np.ndarray) -> np.ndarray:
    """The four letters from each place on as one number; a place with fewer has 0, as have three places more."""
    wide = np.r_[classes, np.zeros(16, dtype=classes.dtype)].astype(np.uint64)
    n = len(wide) - 3
    return wide[:n] | wide[1 : n + 1] << np.uint64(16) | wide[2 : n + 2] << np.uint64(32) | wide[3 : n + 3] << np.uint64(48)


def _alike(x: np.ndarray) -> np.ndarray:
    """How many letters agree, from the first on, of fours whose exclusive or is ``x``."""
    return sum(((x & np.uint64(mask)) == 0).astype(np.int64) for mask in (0xFFFF, 0xFFFFFFFF, 0xFFFFFFFFFFFF, 0xFFFFFFFFFFFFFFFF))


def _equal(fa: np.ndarray, i: np.ndarray, end_a: np.ndarray, fb: np.ndarray, j: np.ndarray, end_b: np.ndarray) -> np.ndarray:
    """How many letters from item places ``i`` and page places ``j`` agree."""
    room = np.minimum(end_a - i, end_b - j)
    out = np.zeros(len(i), dtype=np.int64)
    on = np.arange(len(i))
    while len(on):
        at = out[on]
        n = np.minimum(_alike(fa[i[on] + at] ^ fb[j[on] + at]), room[on] - at)
        out[on] += n
        on = on[n == 4]
    return out


class Found:
    """Where some pages hold seeds of the items."""

    TABLE = 24

    def __init__(self, seeds: Seeds, classes: np.ndarray, owner: np.ndarray, start: np.ndarray):
        values, inside = hashes(classes, owner, SEED)
        at = np.flatnonzero(inside)
        some, n = seeds.numbered(values[at])
        at = at[some]
        page = owner[at]
        # By page, seed and place in the page, from either of its ends.
        self.n_seeds, self.width = len(seeds.values) + 1, int(np.diff(start).max(initial=0)) + 1
        first = self.first(n, page)
        self.ahead = np.append(np.sort(first + at - start[page]), np.iinfo(np.int64).max)
        self.behind = np.append(np.sort(first + start[page + 1] - SEED - at), np.iinfo(np.int64).max)
        # Each page has slots of its own. A slot has the mark of the one seed that it stands for, or 255 for several.
        self.power = max(0, self.TABLE - len(start).bit_length())
        slot, mark = self._slot(n, page)
        self.table = np.zeros(len(start) << self.power, dtype=np.uint8)
        self.table[slot] = mark
        self.table[slot[self.table[slot] != mark]] = 255

    def first(self, seed: np.ndarray, page: np.ndarray) -> np.ndarray:
        """No more than the keys of ``seed`` in ``page``, by the place in the page."""
        return (page * self.n_seeds + seed) * self.width

    def _slot(self, seed: np.ndarray, page: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mixed = (seed.astype(np.uint32) + np.uint32(1)) * np.uint32(0x9E3779B1)
        return (page << self.power) + (mixed >> np.uint32(8) & np.uint32((1 << self.power) - 1)), (mixed >> np.uint32(1) & np.uint32(127)).astype(np.uint8) + np.uint8(1)

    def may_hold(self, seed: np.ndarray, page: np.ndarray) -> np.ndarray:
        """Whether ``page`` may hold ``seed``; it doesn't where this is false."""
        slot, mark = self._slot(seed, page)
        there = self.table[slot]
        return (there == mark) | (there == 255)


class Side:
    """How far extensions of many stretches of equal letters can get in one direction, found for all of them at once.

    It follows :func:`_forward` and :func:`_resumed` step by step, but takes
    the last letters of an item as found, so that it never stops short of them.
    """

    MOST, LOT = 1_000_000, 16_384  # places that are tried at a time, and stops that are looked at

    def __init__(self, fa: np.ndarray, fb: np.ndarray, seeds: np.ndarray, found: Found, keys: np.ndarray, origin: np.ndarray):
        self.fa, self.fb, self.seeds, self.found, self.keys, self.origin = fa, fb, seeds, found, keys, origin  # origin: the first place of each page

    def forward(self, i: np.ndarray, end_a: np.ndarray, j: np.ndarray, end_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Up to which letters (exclusive) item and page agree from ``i`` and ``j`` on, through misreadings."""
        i, j = i.copy(), j.copy()
        fa, fb = self.fa, self.fb
        on = np.arange(len(i))
        while len(on):
            x, y, p, q = i[on], j[on], end_a[on], end_b[on]
            n = np.minimum(_alike(fa[x] ^ fb[y]), np.minimum(p - x, q - y))
            whole = np.flatnonzero(n == 4)
            if len(whole):
                u, v = x[whole], y[whole]
                far = (u + 16 <= p[whole]) & (v + 16 <= q[whole])
                for k in (4, 8, 12):
                    far &= fa[u + k] == fb[v + k]
                n[whole[far]] = 16
            x += n
            y += n
            stop = np.flatnonzero((n < 4) & (x < p) & (y < q))
            if len(stop):
                lots = [stop[k : k + self.LOT] for k in range(0, len(stop), self.LOT)]
                da, db = np.concatenate([self._stepped(x[k], p[k], y[k], q[k]) for k in lots], axis=1)
                x[stop] += da
                y[stop] += db
                n[stop[da > 0]] = 4
            i[on], j[on] = x, y
            on = on[(n >= 4) & (x < p) & (y < q)]
        return i, j

    def _stepped(self, x: np.ndarray, p: np.ndarray, y: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Letters of item and page that the first step that fits passes over, with the four after it; 0 if there is none."""
        da, db = out = np.zeros((2, len(x)), dtype=np.int64)
        rest = p - x
        last = rest <= 8
        da[last] = rest[last]
        none = np.uint64(2**64 - 1)
        a = [np.where(rest >= k + 4, self.fa[x + k], none) for k in range(5)]
        b = [np.where(q - y >= k + 4, self.fb[y + k], none - np.uint64(1)) for k in range(5)]
        for u, v in reversed(_STEPS):
            fits = np.flatnonzero(a[u] == b[v])
            da[fits], db[fits] = u + 4, v + 4
        return out

    def may_resume(self, page: np.ndarray, i: np.ndarray, end_a: np.ndarray) -> np.ndarray:
        """Whether extensions that have stopped at ``i`` may go on after an insertion; they don't where this is false."""
        out = (i < end_a) & (end_a - i < SKIPS[-1] + SEED)
        on = np.flatnonzero((i < end_a) & ~out)
        for skip in SKIPS:
            some = self.found.may_hold(self.seeds[i[on] + skip], page[on])
            out[on[some]] = True
            on = on[~some]
        return out

    def resume(self, page: np.ndarray, i: np.ndarray, end_a: np.ndarray, j: np.ndarray, end_b: np.ndarray) -> np.ndarray:
        """Up to which letter (exclusive) of the item extensions that have stopped at ``i`` and ``j`` get."""
        i, j = i.copy(), j.copy()
        on = np.flatnonzero(i < end_a)
        while len(on):
            x, y = self._resumed(page[on], i[on], end_a[on], j[on], end_b[on])
            further = x > i[on]
            on = on[further]
            i[on], j[on] = x[further], y[further]
            on = on[i[on] < end_a[on]]
        return i

    def _resumed(self, page: np.ndarray, i: np.ndarray, end_a: np.ndarray, j: np.ndarray, end_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where extensions go on after an insertion, at the first seed in the order of ``SKIPS`` and the page from which enough letters are found."""
        out_i, out_j = i.copy(), j.copy()
        short = end_a - i < SKIPS[-1] + SEED
        out_i[short] = end_a[short]
        on = np.flatnonzero(~short)
        seed = self.seeds[i[on][:, None] + np.array(SKIPS)]
        e, skip = np.nonzero(self.found.may_hold(seed, np.broadcast_to(page[on][:, None], seed.shape)))
        seed, e, skip = seed[e, skip], on[e], np.array(SKIPS)[skip]
        origin = self.origin[page[e]]
        first = self.found.first(seed, page[e]) - origin
        low = np.searchsorted(self.keys, first + j[e], "left")
        last = first + np.minimum(end_b[e], j[e] + ADVERT) - SEED
        near = np.flatnonzero(self.keys[low] <= last)
        e, skip, first, low, last = e[near], skip[near], first[near], low[near], last[near]
        n = np.ones(len(e), dtype=np.int64)
        more = np.flatnonzero(self.keys[low + 1] <= last)
        n[more] = np.searchsorted(self.keys, last[more], "right") - low[more]
        done = np.zeros(len(i), dtype=bool)
        cuts = np.r_[np.flatnonzero(np.diff(np.cumsum(n) // self.MOST, prepend=0)), len(n)]
        for a, b in zip(np.r_[0, cuts[:-1]], cuts, strict=True):
            part = np.arange(a, b)[~done[e[a:b]]]
            which = np.repeat(part, n[part])
            at = self.keys[low[which] + np.arange(len(which)) - np.repeat(np.cumsum(n[part]) - n[part], n[part])] - first[which]
            own = e[which]
            x, y = self.forward(i[own] + skip[which] + SEED, end_a[own], at + SEED, end_b[own])
            good = np.flatnonzero((x - i[own] >= 14) | (x >= end_a[own]))
            own, nearest = np.unique(own[good], return_index=True)  # of each the first, skips and places being in order
            out_i[own], out_j[own] = x[good[nearest]], y[good[nearest]]
            done[own] = True
        return out_i, out_j


def _forward(a: str, i: int, end_a: int, b: str, j: int, end_b: int, wrong: list[tuple[int, int]]) -> tuple[int, int]:
    """How far ``a`` from ``i`` and ``b`` from ``j`` agree, through misreadings; the ends (exclusive) of what agrees.

    Places of ``a`` that were misread are added to ``wrong``.
    """
    while i < end_a and j < end_b:
        if a[i] == b[j]:
            i += 1
            j += 1
            continue
        for da, db in _STEPS:
            x, y = i + da, j + db
            if x + 4 <= end_a and y + 4 <= end_b:
                if a[x : x + 4] == b[y : y + 4]:
                    wrong.append((i, x))
                    i, j = x + 4, y + 4
                    break
            elif da == db and 0 < end_a - x <= 4 and y + end_a - x <= end_b and a[x:end_a] == b[y : y + end_a - x]:
                wrong.append((i, x))
                return end_a, y + end_a - x
        else:
            break
    return i, j


def _resumed(a: str, i: int, end_a: int, b: str, j: int, end_b: int, wrong: list[tuple[int, int]]) -> tuple[int, int]:
    """Where ``a`` goes on in ``b`` after an insertion; (i, j) if it doesn't."""
    for skip in SKIPS:
        seed = a[i + skip : min(i + skip + SEED, end_a)]
        if len(seed) < 6:
            return i, j
        at = b.find(seed, j, min(end_b, j + ADVERT))
        while at >= 0:
            missed: list[tuple[int, int]] = []
            ends = _forward(a, i + skip, end_a, b, at, end_b, missed)
            if ends[0] - i >= 14 or ends[0] == end_a:
                wrong += [(i, i + skip), *missed]
                return ends
            at = b.find(seed, at + 1, min(end_b, j + ADVERT))
    return i, j


def _reach(a: str, i: int, end_a: int, b: str, j: int, end_b: int) -> tuple[int, list[tuple[int, int]]]:
    """How far ``a`` from ``i`` is found in ``b`` from ``j``, and the places of ``a`` that were misread."""
    wrong: list[tuple[int, int]] = []
    i, j = _forward(a, i, end_a, b, j, end_b, wrong)
    while i < end_a:
        x, y = _resumed(a, i, end_a, b, j, end_b, wrong)
        if x <= i:
            break
        i, j = x, y
    return i, wrong


class Extension:
    """Extends stretches of equal letters of some pages and items in both directions."""

    def __init__(self, items: Items, stream: str):
        self.items, self.stream, self.back = items, stream, stream[::-1]

    def successive_words(self, item: int, item_at: int, page_at: int, size: int, begin: int, end: int) -> int:
        """The most successive item words that the page (from ``begin`` to ``end``) holds around a stretch.

        A word is held if more than half of its letters agree.
        """
        items = self.items
        low, high = int(items.start[item]), int(items.start[item + 1])
        n, m = len(items.text), len(self.stream)
        stop, wrong = _reach(items.text, item_at + size, high, self.stream, page_at + size, end)
        back, missed = _reach(items.back, n - item_at, n - low, self.back, m - page_at, m - begin)
        good = np.zeros(high - low, dtype=bool)
        good[n - back - low : stop - low] = True
        for x, y in wrong:
            good[x - low : y - low] = False
        for x, y in missed:
            good[n - y - low : n - x - low] = False
        words = items.word[low:high] - items.word[low]
        return _longest(2 * np.bincount(words, weights=good) > np.bincount(words))


def words_in_reach(items: Items, classes: np.ndarray, owner: np.ndarray, start: np.ndarray, page: np.ndarray, fours: np.ndarray, back_fours: np.ndarray, page_at: np.ndarray, item: np.ndarray, item_at: np.ndarray, sizes: np.ndarray, least: int) -> np.ndarray:
    """At most how many item words each stretch can be extended to; less than ``least`` where it is surely less."""
    n, m = len(items.classes), len(classes)
    low, high, begin, end = items.start[item], items.start[item + 1], start[page], start[page + 1]
    found = Found(items.seeds, classes, owner, start)
    ahead = Side(items.fours, fours, items.seeds.ahead, found, found.ahead, start)
    behind = Side(items.back_fours, back_fours, items.seeds.behind, found, found.behind, m - start[1:])
    stop, stop_at = ahead.forward(item_at + sizes, high, page_at + sizes, end)
    back, back_at = behind.forward(n - item_at, n - low, m - page_at, m - begin)
    # Most go on in neither direction, or would still be too short if all that stands there were found.
    to = np.where(ahead.may_resume(page, stop, high), high, stop)
    since = np.where(behind.may_resume(page, back, n - low), low, n - back)
    most = items.word[to - 1] - items.word[since] + 1
    some = np.flatnonzero((most >= least) & (to > stop))
    to[some] = ahead.resume(page[some], stop[some], high[some], stop_at[some], end[some])
    most[some] = items.word[to[some] - 1] - items.word[since[some]] + 1
    some = np.flatnonzero((most >= least) & (since < n - back))
    since[some] = n - behind.resume(page[some], back[some], (n - low)[some], back_at[some], (m - begin)[some])
    most[some] = items.word[to[some] - 1] - items.word[since[some]] + 1
    return most


def _longest(held: np.ndarray) -> int:
    edges = np.flatnonzero(np.diff(np.r_[False, held, False].astype(np.int8)))
    return int((edges[1::2] - edges[::2]).max(initial=0))


def read_columns(text: str, x0: np.ndarray, y0: np.ndarray, x1: np.ndarray) -> str:
    """``text`` with the lines of each column together, columns from left to right; lines that run across are cut."""
    lines = text.split("\n")
    if len(lines) != len(x0) or len(lines) < 2:
        return text
    edges = np.unique(x0)
    starts = edges[np.r_[True, np.diff(edges) > 150]]
    if len(starts) == 1:
        return text
    column = np.searchsorted(starts, x0 + 20, "right") - 1
    beyond = np.r_[starts[1:], [10**9]][column]
    across = x1 > beyond + 60
    if not across.any() and (np.diff(column) >= 0).all():
        return text
    sizes = np.fromiter((len(t) for t in lines), dtype=float, count=len(lines))
    plain = ~across & (sizes > 5)
    pitch = float(np.median((x1 - x0)[plain] / sizes[plain])) if plain.any() else float(np.median((x1 - x0) / np.maximum(sizes, 1)))
    parts = []
    for n, line in enumerate(lines):
        c = int(column[n])
        if not across[n]:
            parts.append((c, int(y0[n]), n, line))
            continue
        rest = line
        marked = " | " in rest or "  " in rest
        if not marked and abs((x1[n] - x0[n]) - len(rest) * pitch) < 1.2 * pitch:
            parts.append((c, int(y0[n]), n, rest))  # one long line, as adverts have
            continue
        last = int(np.searchsorted(starts, x1[n] - 60, "right") - 1)
        for k in range(last, c, -1):
            cut = len(rest) - int(round((x1[n] - starts[k]) / pitch)) if k == last else len(rest) - int(round((starts[k + 1] - 85 - starts[k]) / pitch))
            cut = min(max(cut, 1), len(rest) - 1) if len(rest) > 1 else 0
            seps = [s + 1 for mark in (" | ", "  ") for s in _all(rest, mark) if abs(s + 1 - cut) <= 8]
            spaces = [s for s in _all(rest, " ") if abs(s - cut) <= 4]
            at = min(seps or spaces or [cut], key=lambda s: abs(s - cut))
            parts.append((k, int(y0[n]), n, rest[at:].lstrip(" |")))
            rest = rest[:at].rstrip(" |")
        parts.append((c, int(y0[n]), n, rest))
    return "\n".join(p[3] for p in sorted(parts, key=lambda p: p[:3]))


def _all(text: str, mark: str) -> list[int]:
    out, at = [], text.find(mark)
    while at >= 0:
        out.append(at)
        at = text.find(mark, at + 1)
    return out


def extended(items: Items, streams: list[str], prints: list[np.ndarray], places: list[np.ndarray], least: int = MIN_WORDS) -> list[tuple[int, int, int]]:
    """(page, item, successive words) of the leaks in some pages, given by their letters, one character each, and fingerprints with their places."""
    which, item_at = items.hits(np.concatenate(prints).view(np.uint64)) if prints else (np.zeros(0, dtype=np.int64),) * 2
    if not len(which):
        return []
    sizes = np.fromiter((len(x) for x in streams), dtype=np.int64, count=len(streams))
    start = np.r_[0, np.cumsum(sizes)]
    owner = np.repeat(np.arange(len(streams)), sizes)
    page_at = np.concatenate([at + k for at, k in zip(places, start.tolist(), strict=False)])[which]
    stream = "".join(streams)
    classes = np.frombuffer(stream.encode("utf-16-le"), dtype="<u2")
    fours, back_fours = _fours(classes), _fours(classes[::-1])
    page_at, item_at, sizes = exact_runs(items, owner, start, fours, back_fours, page_at, item_at)
    page, item = owner[page_at], items.owner[item_at]
    most = words_in_reach(items, classes, owner, start, page, fours, back_fours, page_at, item, item_at, sizes, least)
    some = np.flatnonzero(most >= least)
    some = some[np.argsort(-sizes[some], kind="stable")]
    by, start = Extension(items, stream), start.tolist()
    best: dict[tuple[int, int], int] = {}
    for p, q, i, j, size, bound in zip(*[x[some].tolist() for x in (page, item, item_at, page_at, sizes, most)], strict=True):
        if bound > best.get((p, q), 0):  # else it has been found to be as long already
            best[p, q] = max(best.get((p, q), 0), by.successive_words(q, i, j, size, start[p], start[p + 1]))
    return [(p, q, n) for (p, q), n in best.items() if n >= least]


def lots(sizes: list[int], most: int = LOT) -> Iterator[slice]:
    """Slices of some texts with at most ``most`` letters each, or one text."""
    at = 0
    while at < len(sizes):
        to, total = at, 0
        while to < len(sizes) and (to == at or total + sizes[to] <= most):
            total += sizes[to]
            to += 1
        yield slice(at, to)
        at = to


def page_prints(texts: list[str], bits: np.ndarray) -> list[tuple[str, np.ndarray, np.ndarray]]:
    """(letters as characters, hashes, places) of each text, of its winnowed k-grams those that ``bits`` let through."""
    classes, owner, _ = letters(texts)
    values, inside = hashes(classes, owner)
    kept = winnowed(values, inside)
    kept = kept[bits[slots(values[kept], len(bits))]]
    start = np.searchsorted(owner, np.arange(len(texts) + 1))
    cut = np.searchsorted(owner[kept], np.arange(len(texts) + 1)) if len(kept) else np.zeros(len(texts) + 1, dtype=np.int64)
    stream = classes.astype("<u2").tobytes().decode("utf-16-le")
    out = []
    for k in range(len(texts)):
        at = kept[cut[k] : cut[k + 1]]
        out.append((stream[start[k] : start[k + 1]], values[at].view(np.int64), (at - start[k]).astype(np.int32)))
    return out


def item_prints(items: DataFrame) -> DataFrame:
    """(hash, block) of all k-grams of ``items`` (text, block), each once."""

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for lot in lots([len(t) for t in pdf["text"]]):
                classes, owner, _ = letters(list(pdf["text"][lot]))
                values, inside = hashes(classes, owner)
                at = np.nonzero(inside)[0]
                yield pd.DataFrame({"hash": values[at].view(np.int64), "block": pdf["block"].to_numpy()[lot][owner[at]]})

    return items.select("text", "block").mapInPandas(cut, "hash long, block int").distinct()


def marked_bits(prints: DataFrame, power: int = BITS) -> np.ndarray:
    """The bits of all fingerprints of ``prints`` (hash); there are no more of them than ``2 ** power``, however many fingerprints."""
    bits = np.zeros(1 << power, dtype=bool)
    slot = F.shiftrightunsigned("hash", 64 - power).cast("int").alias("slot")
    bits[prints.select(slot).distinct().toPandas()["slot"].to_numpy(dtype=np.int64)] = True
    return bits


def find_leaks(documents: DataFrame, items: DataFrame, lot_letters: int = LOT, block: int = BLOCK, power: int = BITS) -> DataFrame:
    """(doc_id, item_id, n_words) for every page of ``documents`` (doc_id, text, line_boxes) that holds an item in part or whole.

    ``n_words`` is the number of successive item words found, of which ``MIN_WORDS`` are enough for a row.
    The other parameters change memory and speed only.
    """
    key, item_key = dict(documents.dtypes)["doc_id"], dict(items.dtypes)["item_id"]
    context = documents.sparkSession.sparkContext
    box = lambda f: F.transform("line_boxes", lambda b: b[f]).alias(f)
    boxed = "line_boxes" in documents.columns
    usable = items.where("text is not null and item_id is not null")
    blocks = max(1, -(-2 * (usable.agg(F.sum(F.length("text"))).first()[0] or 0) // block))
    # Blocks are hashed, and of half the size allowed on average, which bounds them.
    texts = durable(usable.select("item_id", "text", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)).cast("int").alias("block")))
    prints = durable(item_prints(texts))
    shared = context.broadcast(np.packbits(marked_bits(prints, power)))

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = np.unpackbits(shared.value).astype(bool)
        seen: dict[str, str] = {}
        for pdf in frames:
            texts = [unscrambled(t, seen) for t in pdf["text"]]
            if boxed:
                texts = [t if x is None else read_columns(t, np.asarray(x), np.asarray(y), np.asarray(z)) for t, x, y, z in zip(texts, pdf["x0"], pdf["y0"], pdf["x1"], strict=True)]
            for lot in lots([len(t) for t in texts], lot_letters):
                got = page_prints(texts[lot], bits)
                some = [k for k, x in enumerate(got) if len(x[1])]
                if not some:
                    continue
                rows = pdf[["page", "doc_id"]][lot].iloc[some].copy()
                for c, name in enumerate(("stream", "hash", "at")):
                    rows[name] = [got[k][c] for k in some]
                yield rows

    def found_in(pages: DataFrame, number: int, unread: bool = False) -> DataFrame:
        rows = texts.where(F.col("block") == number).orderBy("item_id", "text").collect()  # at most a block
        index = context.broadcast(Items([r.item_id for r in rows], [r.text for r in rows]))

        def extend(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in read(frames) if unread else frames:
                out = []
                for lot in lots([len(x) for x in pdf["stream"]], lot_letters):
                    part = pdf[lot]
                    ids = list(part["doc_id"])
                    out += [(ids[p], index.value.ids[q], n) for p, q, n in extended(index.value, list(part["stream"]), list(part["hash"]), list(part["at"]))]
                yield pd.DataFrame(out, columns=["doc_id", "item_id", "n_words"])

        return pages.mapInPandas(extend, f"doc_id {key}, item_id {item_key}, n_words int")

    pages = documents.where("text <> ''").select(F.monotonically_increasing_id().alias("page"), "doc_id", "text", *([box("x0"), box("y0"), box("x1")] if boxed else []))
    if blocks == 1:
        return found_in(pages, 0, unread=True)
    # Pages are numbered, since ids may be repeated, and written, so that the numbers stay and the corpus is read once.
    pages = durable(pages.mapInPandas(read, f"page long, doc_id {key}, stream string, hash array<long>, at array<int>"))
    hits = durable(pages.select("page", F.explode("hash").alias("hash")).join(prints, "hash").select("page", "block").distinct())
    found = [durable(found_in(pages.join(hits.where(F.col("block") == number), "page", "left_semi"), number)) for number in range(blocks)]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out
