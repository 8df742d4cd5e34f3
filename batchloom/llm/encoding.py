"""Garbled text from wrong character encodings: finding it and restoring the original.

Smoothed character trigram models are trained on the records that show no sign
of garbling, one for each of ``FOLDS`` folds and without it, so that no record
is judged by counts it is part of. Every word with characters beyond ASCII
that the model finds implausible is put through each candidate chain (encode
with the codec that was wrongly used, decode with the right one), and lost
letters (U+FFFD) are filled in; the reading the model likes best is kept. A
record is garbled if the words of one chain gain more than a margin. Records
found are taken out of the counts, and those near the margin judged again,
until no further one is found.

The margin is chosen from the gains of all records that stay below it, see
:func:`chosen_margin`; what it does to lines garbled on purpose is shown by
:func:`margin_report`.

The corpus is read in Arrow batches, once to count and once to judge; what
leaves the tasks are n-gram counts (a table of fixed size) and the records
with any word that gains. Further rounds read only these.

Defined results for odd input: NULL and empty texts are never garbled; a
replacement character (U+FFFD) is taken as a lost letter, and as such is as
implausible as its surroundings make it; tied chains are settled by their order
here; repeated rows are judged one by one.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from batchloom.session import durable

WRONG_FOR_UTF8 = ("cp1252", "cp437", "cp850", "mac_roman", "cp1251", "koi8_r", "cp866", "cp1250", "mac_cyrillic", "iso8859_5")
SINGLE = (
    ("cp1252", "cp1251"), ("cp1252", "cp850"), ("cp1252", "cp437"), ("cp1252", "mac_roman"), ("cp1252", "koi8_r"), ("cp1252", "cp866"), ("cp1252", "cp1250"), ("cp1252", "iso8859_5"), ("cp1252", "mac_cyrillic"),
    ("cp1251", "cp1252"), ("cp1251", "koi8_r"), ("cp1251", "cp866"), ("cp1251", "mac_cyrillic"), ("cp1251", "mac_roman"), ("cp1251", "cp850"), ("cp1251", "cp437"), ("cp1251", "iso8859_5"),
    ("koi8_r", "cp1251"), ("koi8_r", "cp1252"), ("koi8_r", "cp866"), ("koi8_r", "iso8859_5"), ("cp866", "cp1251"), ("cp866", "cp1252"), ("cp866", "koi8_r"), ("iso8859_5", "cp1251"), ("iso8859_5", "cp1252"), ("iso8859_5", "koi8_r"),
    ("cp850", "cp1252"), ("cp437", "cp1252"), ("mac_roman", "cp1252"), ("mac_cyrillic", "cp1251"), ("mac_cyrillic", "cp1252"), ("cp850", "mac_roman"), ("mac_roman", "cp850"),
)
TRI_BITS = 21
SIZES = (512, 512 * 512, 1 << TRI_BITS)  # of the tables of one, two and three symbols
UNSEEN = 0.05  # share of a context's probability that is left to the shorter context
LOST_BYTES = (0x9D, 0x90, 0x8F, 0x8D, 0x81)  # the bytes cp1252 has no character for
WORTH = 9.0  # nats of implausibility from which a word is put through the chains
WORD_GAIN = 3.0  # nats that a word has to gain to count for its record
LOOSE_GAIN = 1.0  # nats that a word has to gain for its record to be judged again once others are out of the counts
MARGIN = 12.0  # least nats that the distinct words of a record have to gain; see chosen_margin
FOLDS = 2
BEAM = 16  # readings kept while lost letters are filled in
LOST = "\ufffd"
_RUN = re.compile("[^\x00-\x7f]+")
_PIECE = re.compile("([ \n\t\r]+)")
_ASCII = {chr(c) for c in range(0x80)}


def _map(codec: str) -> dict[str, int]:
    """Character to byte of a codec; bytes without a character stand for the control character of that number."""
    out = {chr(b): b for b in range(0x80, 0xA0)} if codec == "cp1252" else {}
    for b in range(0x80, 0x100):
        try:
            out[bytes([b]).decode(codec)] = b
        except UnicodeDecodeError:
            out[chr(b)] = b
    return out


MAPS = {c: _map(c) for c in {*WRONG_FOR_UTF8, *(d for _, d in SINGLE), *(e for e, _ in SINGLE)}}
CHARS = {c: {b: ch for ch, b in reversed(MAPS[c].items())} for c in MAPS}


def _decode(raw: bytes) -> str | None:
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return None


# Letters and marks beyond ASCII that the corpus's languages write; a repaired text introduces no others.
LATIN = "ÀÁÂÃÄÇÈÉÊËÌÍÎÏÑÒÓÔÖÙÚÛÜßàáâãäçèéêëìíîïñòóôöùúûüÿœŒæÆ"
CYRILLIC = "абвгдежзийклмнопрстуфхцчшщъыьэюяёАБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯЁ"
MARKS = "\u00a0«»‘’“”„–—…£½¼¾¬°№§€ºª¿¡·"
_USUAL = set(LATIN + CYRILLIC + MARKS)
_CYRILLIC = set(CYRILLIC)
_LATIN = set(LATIN) | {chr(c) for c in range(0x41, 0x7B) if chr(c).isalpha()}

Chooser = Callable[[str, list[str]], str]


def _usual(text: str) -> bool:
    return all(c < "\x80" or c in _USUAL for c in text)


def _plausible(new: str, old: str) -> bool:
    """Whether a reading brings in usual characters only and doesn't mix scripts."""
    fresh = set(new) - _ASCII - set(old)
    return fresh <= _USUAL and not ((set(new) & _CYRILLIC) and (set(new) & _LATIN))


def _first_usual(before: str, options: list[str]) -> str:
    return next((x for x in options if _usual(x)), options[0])


def _utf8(run: str, table: dict[str, int], choose: Chooser = _first_usual) -> tuple[str, int]:
    """``run`` with every byte sequence that is valid UTF-8 under ``table`` read as such, and the number of these.

    One byte of a sequence may be lost (U+FFFD); ``choose`` picks among its readings.
    """
    out, i, hits, n = "", 0, 0, len(run)
    codes = [table.get(c, -2 if c == "\ufffd" else -1) for c in run]
    while i < n:
        lead = codes[i]
        size = 2 if 0xC2 <= lead <= 0xDF else 3 if 0xE0 <= lead <= 0xEF else 4 if 0xF0 <= lead <= 0xF4 else 0
        part = codes[i : i + size]
        if size and len(part) == size and -1 not in part:
            got = None
            if -2 not in part:
                got = _decode(bytes(part))
            elif part.count(-2) == 1:
                reads = [r for b in LOST_BYTES if (r := _decode(bytes(b if x == -2 else x for x in part)))]
                got = choose(out, reads) if reads else None
            if got is not None:
                out += got
                i += size
                hits += 1
                continue
        out += run[i]
        i += 1
    return out, hits


def chains() -> list[str]:
    return [f"utf_8>{d}" for d in WRONG_FOR_UTF8] + [f"utf_8>{d}>utf_8>{d}" for d in ("cp1252", "mac_roman", "cp437", "cp850", "cp1251")] + [f"{e}>{d}" for e, d in SINGLE]


def undo(text: str, chain: str, choose: Chooser = _first_usual) -> str:
    """``text`` as it reads if ``chain`` (right codec > wrong codec) was what happened to it; what cannot have gone through it stays."""
    steps = chain.split(">")
    if steps[0] == "utf_8":
        for d in reversed(steps[1::2]):
            table = MAPS[d]
            text = _RUN.sub(lambda m: _utf8(m.group(), table, choose)[0], text)  # noqa: B023
        return text
    right, wrong = CHARS[steps[0]], MAPS[steps[1]]
    return "".join(right[wrong[c]] if c > "\x7f" and c in wrong else c for c in text)


_SINGLE_OF: dict[str, tuple[int, int]] = {}


def _single_of(c: str) -> tuple[int, int]:
    """Bits of the single-byte chains that leave ``c`` or read it as a usual character, and of those that change it."""
    may = changes = 0
    for k, (right, wrong) in enumerate(SINGLE):
        new = CHARS[right][MAPS[wrong][c]] if c in MAPS[wrong] else c
        if new == c or new in _USUAL or new < "\x80":
            may |= 1 << k
        if new != c:
            changes |= 1 << k
    _SINGLE_OF[c] = may, changes
    return may, changes


def garble(text: str, chain: str) -> str:
    """The reverse of :func:`undo`, for validation; characters that the right codec lacks stay."""
    steps = chain.split(">")
    if steps[0] == "utf_8":
        for d in steps[1::2]:
            table = CHARS[d]
            text = "".join(c if c < "\x80" else "".join(table[b] if b >= 0x80 else chr(b) for b in c.encode("utf-8")) for c in text)
        return text
    right, wrong = MAPS[steps[0]], CHARS[steps[1]]
    return "".join(wrong[right[c]] if c > "\x7f" and c in right else c for c in text)


def _symbols() -> np.ndarray:
    """Code point to one of 512 symbols: Latin, Cyrillic and punctuation have their own, digits share one."""
    at = np.arange(0x3000, dtype=np.int64)
    out = 496 + at % 16
    out[:0x100] = at[:0x100]
    out[0x30:0x3A] = 0x30
    out[[0x09, 0x0A, 0x0D]] = 0x20
    out[0x400:0x480] = 256 + np.arange(0x80)
    out[0x2000:0x2070] = 384 + np.arange(0x70)
    return out


SYMBOLS = _symbols()


def _coded(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Code points, and symbols with two blanks before the first."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    coded = np.empty(len(points) + 2, dtype=np.int64)
    coded[:2] = 0x20
    coded[2:] = SYMBOLS[np.minimum(points, 0x2FFF)]
    return points, coded


def _hashed(ab: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (((ab * 512 + c) * 0x9E3779B1) >> 7) & ((1 << TRI_BITS) - 1)


@dataclass
class Model:
    """Interpolated character trigram model over hashed counts."""

    one: np.ndarray
    two: np.ndarray
    three: np.ndarray
    context: np.ndarray = field(init=False)
    total: float = field(init=False)

    def __post_init__(self) -> None:
        self.context = self.two.reshape(512, 512).sum(1)
        self.total = float(self.one.sum())

    def log_p(self, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Natural log of the probability of symbols ``c`` after ``b`` after ``a``."""
        p1 = (self.one[c] + 0.01) / (self.total + 5.12)
        c1 = self.context[b]
        p2 = (1 - UNSEEN) * self.two[b * 512 + c] / np.maximum(c1, 1) + np.where(c1 > 0, UNSEEN, 1.0) * p1
        ab = a * 512 + b
        c2 = self.two[ab]
        p3 = (1 - UNSEEN) * np.minimum(self.three[_hashed(ab, c)] / np.maximum(c2, 1), 1) + np.where(c2 > 0, UNSEEN, 1.0) * p2
        return np.log(p3)

    def score(self, word: str) -> float:
        s = _coded(word + " ")[1]
        return float(self.log_p(s[:-2], s[1:-1], s[2:]).sum())

    def score_all(self, words: list[str]) -> np.ndarray:
        """:meth:`score` of several words at once."""
        s = _coded("".join(f"  {w} " for w in words))[1][2:]
        p = self.log_p(s[:-2], s[1:-1], s[2:])
        ends = np.cumsum([len(w) + 3 for w in words])
        starts = ends - [len(w) + 3 for w in words]
        return np.add.reduceat(np.append(p, 0.0), np.stack([starts, ends - 2], 1).ravel())[::2]

    def scores(self, words: list[str]) -> np.ndarray:
        """:meth:`score` of words of one length, without the blank after them."""
        s = np.stack([_coded(w)[1] for w in words])
        return self.log_p(s[:, :-2], s[:, 1:-1], s[:, 2:]).sum(1)


def _garbled_run(run: str) -> bool:
    """Whether UTF-8 read with some wrong codec explains a run of non-ASCII characters by usual ones only."""
    if "�" in run or any("\x80" <= c <= "\x9f" for c in run):
        return True
    for d in WRONG_FOR_UTF8:
        text, hits = _utf8(run, MAPS[d])
        if hits and _usual(text):
            return True
    return False


def unscrambled(text: str, seen: dict[str, str]) -> str:
    """``text`` with runs that are UTF-8 read with a wrong codec, once or twice, set right, where usual characters result; needs no model."""

    def read(m: re.Match) -> str:
        run = m.group()
        got = seen.get(run)
        if got is None:
            got = run
            for _ in range(2):
                options = [_utf8(got, MAPS[d]) for d in WRONG_FOR_UTF8]
                better = [(hits, new) for new, hits in options if hits and (_usual(new) or any("\x80" <= c < "\xa0" for c in new))]
                if not better:
                    break
                got = max(better, key=lambda x: x[0])[1]
            got = got if _usual(got) else run
            if len(seen) > 100_000:
                seen.clear()
            seen[run] = got
        return got

    return text if text.isascii() else _RUN.sub(read, text)


def in_folds(documents: DataFrame, folds: int = FOLDS) -> DataFrame:
    return documents.select("doc_id", "text", F.pmod(F.xxhash64("doc_id"), F.lit(folds)).cast("int").alias("fold"))


def ngram_counts(texts: DataFrame, folds: int = FOLDS) -> list[list[np.ndarray]]:
    """Per fold the counts of one, two and three symbols in the records of ``texts`` (text, fold) without a sign of garbling."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tables: dict[tuple[int, int], np.ndarray] = {}
        seen: dict[str, bool] = {}

        def sound(text: str) -> bool:
            for run in set(_RUN.findall(text)):
                bad = seen.get(run)
                if bad is None:
                    if len(seen) > 200_000:
                        seen.clear()
                    bad = seen[run] = _garbled_run(run)
                if bad:
                    return False
            return True

        for pdf in frames:
            for fold in range(folds):
                kept = "  ".join(t for t in pdf["text"][pdf["fold"] == fold] if t and sound(t))
                if kept:
                    s = _coded(kept)[1]
                    for k, (size, at) in enumerate(zip(SIZES, (s[2:], s[1:-1] * 512 + s[2:], _hashed(s[:-2] * 512 + s[1:-1], s[2:])), strict=True)):
                        tables[fold, k] = tables.get((fold, k), 0) + np.bincount(at, minlength=size)
        for (fold, k), table in tables.items():
            at = np.nonzero(table)[0]
            yield pd.DataFrame({"fold": np.full(len(at), fold, dtype=np.int32), "k": np.full(len(at), k, dtype=np.int32), "at": at.astype(np.int32), "n": table[at]})

    total = texts.select("text", "fold").mapInPandas(count, "fold int, k int, at int, n long").groupBy("fold", "k", "at").agg(F.sum("n").alias("n")).toPandas()
    out = [[np.zeros(size) for size in SIZES] for _ in range(folds)]
    for (fold, k), part in total.groupby(["fold", "k"]):
        out[fold][k][part["at"].to_numpy(dtype=int)] = part["n"].to_numpy(dtype=float)
    return out


def models_without(counts: list[list[np.ndarray]]) -> list[Model]:
    """For each fold the model of all others."""
    return [Model(*(sum(c[k] for c in counts) - own[k] for k in range(len(SIZES)))) for own in counts]


def train(texts: DataFrame) -> Model:
    """One model of all records of ``texts`` (text) without a sign of garbling."""
    return Model(*ngram_counts(texts.select("text", F.lit(0).alias("fold")), 1)[0])


CHAINS = chains()
_READ: dict[str, dict[str, str]] = {}


def _possible(word: str) -> Iterator[str]:
    """The chains, in order, that can change ``word`` into usual characters, told from its characters alone."""
    odd = [c for c in word if c > "\x7f"]
    if any(a > "\x7f" and b > "\x7f" for a, b in zip(word, word[1:], strict=False)):
        yield from CHAINS[: len(CHAINS) - len(SINGLE)]
    every, some = -1, 0
    for c in odd:
        may, changes = _SINGLE_OF.get(c) or _single_of(c)
        every &= may
        some |= changes
    every &= some
    for k, (right, wrong) in enumerate(SINGLE):
        if every >> k & 1:
            yield f"{right}>{wrong}"


def read_back(word: str) -> dict[str, str]:
    """The plausible readings of ``word``, each with the first chain that gives it; they need no model, so all judges of a process share them."""
    got = _READ.get(word)
    if got is None:
        got = {}
        for chain in _possible(word):
            new = undo(word, chain)
            if new != word and new not in got and _plausible(new, word):
                got[new] = chain
        if len(_READ) > 50_000:
            _READ.clear()
        _READ[word] = got
    return got


class Judge:
    """Words and records under a model; remembers the words it has judged."""

    def __init__(self, model: Model):
        self.model = model
        self.words: dict[str, tuple[str, float]] = {}
        self.restored: dict[tuple[str, str], str] = {}

    def word(self, word: str) -> tuple[str, float]:
        """(likeliest chain or '', gain in nats over the word as it stands)."""
        got = self.words.get(word)
        if got is None:
            readings = read_back(word)
            if LOST in word:
                readings = {**readings}  # those of read_back are shared
                readings.setdefault(self.filled(word), "lost")
            best, name = 0.0, ""
            if readings:
                # Capitals are rarer than small letters; a word that is plausible in these isn't garbled.
                scores = self.model.score_all([word, word.lower(), word.capitalize(), *readings]).tolist()
                was = max(scores[:3])
                for chain, score in zip(readings.values(), scores[3:], strict=True):
                    if score - was > best:
                        best, name = score - was, chain
            if len(self.words) > 200_000:
                self.words.clear()
            got = self.words[word] = (name, best)
        return got

    def doubtful(self, text: str) -> list[str]:
        """The words of ``text`` with non-ASCII characters that the model finds implausible."""
        points, coded = _coded(text)
        odd = np.nonzero(points > 0x7F)[0]
        if not len(odd):
            return []
        blank = coded == 0x20
        near = np.unique(np.concatenate([odd, odd + 1, odd + 2]))
        near = near[near < len(points)]
        cost = np.zeros(len(points))
        cost[near] = -self.model.log_p(coded[near], coded[near + 1], coded[near + 2])
        starts = np.nonzero(blank[1:-1] & ~blank[2:])[0]
        sums = np.add.reduceat(cost, starts) if len(starts) else np.zeros(0)
        ends = np.append(starts[1:], len(points))
        return [text[starts[i] : ends[i]].rstrip(" \n\t\r") for i in np.nonzero(sums >= WORTH)[0]]

    def record(self, text: str | None) -> tuple[str, float, int, bool]:
        """(chain, total gain of its words, how many, whether any word gains a little) of a text.

        Words of which letters were lost speak for any chain.
        """
        if not text or text.isascii():
            return "", 0.0, 0, False
        gains: dict[str, list[float]] = {}
        loose = False
        for w in set(self.doubtful(text)):
            chain, gain = self.word(w)
            loose |= gain >= LOOSE_GAIN
            if gain >= WORD_GAIN:
                gains.setdefault(chain, []).append(gain)
        if not gains:
            return "", 0.0, 0, loose
        lost = gains.pop("lost", [])
        chain = max(gains, key=lambda c: sum(gains[c])) if gains else "lost"
        words = gains.get(chain, []) + lost
        return chain, sum(words), len(words), loose

    def _choose(self, before: str, options: list[str]) -> str:
        """The option the model likes best after ``before``, among usual ones if there are any."""
        return max([x for x in options if _usual(x)] or options, key=lambda x: float(self.model.scores([before[-4:] + x])[0]))

    def filled(self, word: str) -> str:
        """A word with its lost letters filled in by a beam search."""
        letters = [ord(x) for x in (CYRILLIC if any(c in CYRILLIC for c in word) else LATIN + MARKS)]
        score, tail = np.zeros(1), np.full((1, 2), 0x20, dtype=np.int64)
        steps: list[tuple[np.ndarray, np.ndarray]] = []
        for c in word:
            options = np.array(letters if c == LOST else [ord(c)])
            at, chosen = np.repeat(np.arange(len(score)), len(options)), np.tile(options, len(score))
            symbol = SYMBOLS[np.minimum(chosen, 0x2FFF)]
            total = score[at] + self.model.log_p(tail[at, 0], tail[at, 1], symbol)
            best = np.argsort(-total, kind="stable")[:BEAM]
            steps.append((at[best], chosen[best]))
            score, tail = total[best], np.stack([tail[at[best], 1], symbol[best]], 1)
        k = int(np.argmax(score + self.model.log_p(tail[:, 0], tail[:, 1], np.full(len(score), 0x20))))
        out = []
        for at, chosen in reversed(steps):
            out.append(chr(chosen[k]))
            k = at[k]
        return "".join(reversed(out))

    def refill(self, word: str) -> str:
        """A word with lost letters filled in; left alone where nothing of it is kept."""
        n = word.count(LOST)
        return word if n == 0 or (n > 1 and n >= len(word)) else self.filled(word)

    def restore(self, text: str, chain: str) -> str:
        """``text`` with every word read as ``chain``, else its own likeliest chain, has it where that gains; lost letters are refilled."""
        single = bool(chain) and not chain.startswith(("utf_8", "lost"))
        out = []
        for piece in _PIECE.split(text):
            new = self.restored.get((piece, chain))
            if new is None:
                new = piece
                if not piece.isascii():
                    read = undo(piece, chain, self._choose) if chain and chain != "lost" else piece
                    if read != piece and (not single or self.model.score(read) > self.model.score(piece)):
                        new = read
                    elif (own := self.word(piece))[1] >= WORD_GAIN and own[0] != "lost":
                        new = undo(piece, own[0], self._choose)
                    new = self.refill(new)
                if len(self.restored) > 50_000:
                    self.restored.clear()
                self.restored[piece, chain] = new
            out.append(new)
        return "".join(out)


def judged(texts: DataFrame, models: Sequence[Model], margin: float, restore: bool = True, near: bool = False) -> DataFrame:
    """(doc_id, fold, text, chain, gain, n_words, restored) of the records of ``texts`` (doc_id, text, fold) that gain at least ``margin``.

    ``models`` has one model per fold. With ``near``, also of those with a word that gains a little, and with their text.
    """
    shared = texts.sparkSession.sparkContext.broadcast(list(models))  # three tables of fixed size each
    key = dict(texts.dtypes)["doc_id"]

    def judge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        judges = [Judge(m) for m in shared.value]
        for pdf in frames:
            rows = []
            for doc_id, text, fold in zip(pdf["doc_id"], pdf["text"], pdf["fold"], strict=True):
                by = judges[fold]
                chain, gain, n, loose = by.record(text)
                if gain >= margin or (near and loose):
                    rows.append((doc_id, fold, text if near else None, chain, gain, n, by.restore(text, chain) if restore else None))
            yield pd.DataFrame(rows, columns=["doc_id", "fold", "text", "chain", "gain", "n_words", "restored"])

    return texts.select("doc_id", "text", "fold").mapInPandas(judge, f"doc_id {key}, fold int, text string, chain string, gain double, n_words int, restored string")


def chosen_margin(gains: DataFrame, least: float = MARGIN) -> float:
    """The margin that, by how fast the gains of records below it thin out, less than one clean record should pass.

    Of ``gains`` (gain) of all records, those from ``WORD_GAIN`` up to
    ``least`` are counted in two halves of that span; what is left beyond
    falls by their ratio with every further half.
    """
    half = (least - WORD_GAIN) / 2
    low, high = (F.count(F.when((F.col("gain") >= a) & (F.col("gain") < a + half), 1)) for a in (WORD_GAIN, WORD_GAIN + half))
    n = gains.agg(low.alias("low"), high.alias("high")).first()
    ratio = min(max((n["high"] + 0.5) / (n["low"] + 1.0), 0.05), 0.9)
    rest = (n["high"] + 0.5) * ratio / (1 - ratio)
    return least + half * max(0.0, float(np.log(rest) / -np.log(ratio)))


def find_garbled(documents: DataFrame, margin: float | None = None, restore: bool = True) -> DataFrame:
    """Garbled records of ``documents`` (doc_id, text): (doc_id, chain, gain, n_words, restored).

    Without a ``margin`` it is chosen from the gains of all records.
    """
    texts = in_folds(documents)
    counts = ngram_counts(texts)
    near = durable(judged(texts, models_without(counts), margin or MARGIN, restore=False, near=True))
    passed, n_found = near.select("doc_id", "gain"), -1
    while True:
        limit = chosen_margin(passed) if margin is None else margin
        found = durable(passed.where(F.col("gain") >= limit).select("doc_id").distinct())
        if (n := found.count()) <= n_found:
            break
        n_found = n
        out = ngram_counts(near.join(found, "doc_id", "left_semi"))
        models = models_without([[a - b for a, b in zip(x, y, strict=True)] for x, y in zip(counts, out, strict=True)])
        passed = durable(judged(near, models, WORD_GAIN, restore=False))
    final = passed.where(F.col("gain") >= limit)
    if restore:
        final = judged(near.join(found, "doc_id", "left_semi"), models, limit)
    return final.select("doc_id", "chain", "gain", "n_words", "restored")


def margin_report(documents: DataFrame, margin: float = MARGIN) -> DataFrame:
    """What ``margin`` does on held-out cases: (chain, n, found, restored).

    Every clean line with at least three words beyond ASCII is garbled by the chain that its
    hash picks; ``found`` counts those that pass the margin, ``restored`` those
    brought back exactly. Chain ``none`` counts the lines as they are, of which
    none should be found. The model is trained on the records with even hash of
    ``doc_id``, the lines are taken from the others.
    """
    texts = in_folds(documents, 2)
    model = train(texts.where("fold = 0"))
    rest = texts.where("fold = 1").withColumn("fold", F.lit(0))
    found = judged(rest, [model], margin, restore=False).select("doc_id")
    clean = rest.join(found, "doc_id", "left_anti")
    shared = texts.sparkSession.sparkContext.broadcast(model)
    every = chains()

    def judge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        by, counts = Judge(shared.value), {}
        for pdf in frames:
            for text in pdf["text"]:
                for at, line in enumerate((text or "").split("\n")):
                    if sum(not w.isascii() for w in line.split(" ")) < 3:
                        continue
                    row = counts.setdefault("none", [0, 0, 0])
                    row[0] += 1
                    row[1] += by.record(line)[1] >= margin
                    row[2] += 1
                    chain = every[(len(line) * 31 + at) % len(every)]
                    bad = garble(line, chain)
                    if bad != line and undo(bad, chain) == line:
                        name, gain, _, _ = by.record(bad)
                        row = counts.setdefault(chain, [0, 0, 0])
                        row[0] += 1
                        row[1] += gain >= margin
                        row[2] += gain >= margin and by.restore(bad, name) == line
        yield pd.DataFrame([(c, *map(int, r)) for c, r in counts.items()], columns=["chain", "n", "found", "restored"])

    parts = clean.select("text").mapInPandas(judge, "chain string, n long, found long, restored long")
    return parts.groupBy("chain").agg(*[F.sum(c).alias(c) for c in ("n", "found", "restored")])
