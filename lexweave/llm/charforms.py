"""One consistent form for text that looks the same but differs in its characters.

Whole Arrow batches are copied into one numpy array of code points. Lookup tables decide per code point what it
becomes (nothing, one or several code points: gathers with expansion offsets), letter runs decide on look-alike
letters, and marks and conjoining jamo are composed by sorted pair tables. No string function runs per row.

What counts as ordinary and stays: composed Hangul, single (compatibility) jamo, ASCII, U+00B7, 【】, unified
ideographs, composed letters, words of another script (with a letter that has no Latin look-alike, or beside such words),
other visible signs, emoji sequences with their joiners and variation selectors.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_MAX = 0x110000

# Letters that look like Latin ones, in the order of the Latin string beside them.
CYRILLIC, CYRILLIC_AS = "АВЕЅІЈКМНОРСТУХаеѕіјорсухһԁԛԝҮ", "ABESIJKMHOPCTYXaesijopcyxhdqwY"
GREEK, GREEK_AS = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοϲϳ", "ABEZHIKMNOPTYXocj"
# Letters that pass for Latin ones only in the midst of them.
GLANCE, GLANCE_AS = "αγικνρσυωЬԌ", "ayikvpouwbG"
MIDDLE_DOTS = "\u0387\u2027\u2219\u22c5\u2e31\u30fb\uff65\u318d"
HYPHENS = "\u2010\u2011\u2012\u2212\ufe63\uff0d"
APOSTROPHES = "\u02bc\uff07"
INVISIBLE = (
    "\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b\u180c\u180d\u180e\u200b\u200c\u200d\u200e\u200f\u202a\u202b\u202c\u202d\u202e"
    "\u2060\u2061\u2062\u2063\u2064\u2065\u2066\u2067\u2068\u2069\u206a\u206b\u206c\u206d\u206e\u206f\u3164\ufeff\uffa0\ufff9\ufffa\ufffb"
)
_ZWNJ, _ZWJ, _VS15, _VS16 = 0x200C, 0x200D, 0xFE0E, 0xFE0F
_L, _V, _T, _S = 0x1100, 0x1161, 0x11A7, 0xAC00
# Conjoining jamo in the order of their blocks, as a keyboard enters them.
LEADS, VOWELS = "ㄱㄲㄴㄷㄸㄹㅁㅂㅃㅅㅆㅇㅈㅉㅊㅋㅌㅍㅎ", "ㅏㅐㅑㅒㅓㅔㅕㅖㅗㅘㅙㅚㅛㅜㅝㅞㅟㅠㅡㅢㅣ"
TAILS = "ㄱㄲㄳㄴㄵㄶㄷㄹㄺㄻㄼㄽㄾㄿㅀㅁㅂㅄㅅㅆㅇㅈㅊㅋㅌㅍㅎ"
#: Where a character may decompose (a bound on the scan that fills the tables, not on the texts).
_SCAN = [(0xA0, 0x3400), (0xF900, 0x10000), (0x11000, 0x12000), (0x1D400, 0x1D800), (0x2F800, 0x2FA20)]


class _Tables:
    def __init__(self):
        # 1 -> 1 replacements; lengths other than 1 are expansions or removals
        self.to = np.arange(_MAX, dtype=np.uint32)
        self.length = np.ones(_MAX, np.uint8)
        self.expand: dict[int, str] = {}
        pairs: dict[int, int] = {}
        for lo, hi in _SCAN:
            for cp in range(lo, hi):
                ch = chr(cp)
                d = unicodedata.decomposition(ch).split()
                if not d:
                    continue
                if d[0].startswith("<"):
                    if d[0] in ("<wide>", "<narrow>", "<noBreak>") or d[0] == "<font>" and 0x1D400 <= cp < 0x1D800:
                        self._set(cp, "".join(chr(int(x, 16)) for x in d[1:]))
                    elif 0xFB00 <= cp <= 0xFB06:
                        self._set(cp, unicodedata.normalize("NFKC", ch))
                elif unicodedata.normalize("NFC", ch) != ch:
                    self._set(cp, unicodedata.normalize("NFC", ch))
                elif len(d) == 2:
                    pairs[int(d[0], 16) << 21 | int(d[1], 16)] = cp
        for cp in range(_MAX):
            if cp > 0x20 and cp < 0x3001 and unicodedata.category(chr(cp)) == "Zs":
                self._set(cp, " ")
        for group, one in ((MIDDLE_DOTS, "·"), (HYPHENS, "-"), (APOSTROPHES, "'"), ("\u2028\u2029\u0085", "\n"), (INVISIBLE, "")):
            for ch in group:
                self._set(ord(ch), one)
        for lo, hi in ((0xFE00, 0xFE10), (0xE0000, 0xE0080), (0xE0100, 0xE01F0)):
            for cp in range(lo, hi):
                self._set(cp, "")
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_to = np.array([pairs[k] for k in sorted(pairs)], np.uint32)
        self.first, self.second = np.zeros(_MAX, np.uint32), np.zeros(_MAX, np.uint32)
        self.first[self.pair_to], self.second[self.pair_to] = self.pair_keys >> 21, self.pair_keys & ((1 << 21) - 1)
        self.ccc = np.zeros(_MAX, np.uint8)
        for lo, hi in ((0x300, 0x3100), (0xA66F, 0xAC00), (0xFB1E, 0xFE30), (0x10A0D, 0x11A9A), (0x16AF0, 0x16F00), (0x1BC9E, 0x1BC9F), (0x1D165, 0x1D245), (0x1E000, 0x1E94B)):
            for cp in range(lo, hi):
                self.ccc[cp] = unicodedata.combining(chr(cp))
        # 1 Latin, 2 Cyrillic, 3 Greek
        self.script = np.zeros(_MAX, np.uint8)
        for lo, hi, kind in ((0x41, 0x5B, 1), (0x61, 0x7B, 1), (0xC0, 0x250, 1), (0x1E00, 0x1F00, 1), (0x370, 0x400, 3), (0x1F00, 0x2000, 3), (0x400, 0x530, 2)):
            for cp in range(lo, hi):
                if unicodedata.category(chr(cp))[0] == "L":
                    self.script[cp] = kind
        self.look = np.zeros(_MAX, np.uint32)
        self.back = {2: np.zeros(_MAX, np.uint32), 3: np.zeros(_MAX, np.uint32)}
        for kind, letters, latin in ((2, CYRILLIC, CYRILLIC_AS), (3, GREEK, GREEK_AS)):
            for a, b in zip(letters, latin):
                self.look[ord(a)] = ord(b)
                if not self.back[kind][ord(b)]:
                    self.back[kind][ord(b)] = ord(a)
        self.glance = np.zeros(_MAX, np.uint32)
        for a, b in zip(GLANCE, GLANCE_AS):
            self.glance[ord(a)] = ord(b)
        self.jamo = np.zeros(_MAX, np.uint32)
        for base, group in ((_L, LEADS), (_V, VOWELS), (_T + 1, TAILS)):
            for i, ch in enumerate(group):
                self.jamo[base + i] = ord(ch)
        self.emoji = np.zeros(_MAX, bool)
        for lo, hi in ((0x203C, 0x203D), (0x2049, 0x204A), (0x2122, 0x2123), (0x2139, 0x213A), (0x2190, 0x2C00), (0x3030, 0x3031), (0x303D, 0x303E), (0x3297, 0x329A), (0x1F000, 0x1FB00), (0xA9, 0xAA), (0xAE, 0xAF)):
            self.emoji[lo:hi] = True
        # what makes a row worth a closer look
        self.watch = (self.to != np.arange(_MAX)) | (self.length != 1) | (self.ccc > 0) | (self.jamo > 0) | (self.script > 1)
        self.watch[0x1100:0x1200] = True
        second = self.pair_keys & ((1 << 21) - 1)
        self.watch[second] = True

    def _set(self, cp: int, text: str) -> None:
        self.length[cp] = len(text)
        if len(text) == 1:
            self.to[cp] = ord(text)
        elif len(text) > 1:
            self.expand[cp] = text


@lru_cache(1)
def _tables() -> _Tables:
    return _Tables()


def _drop(keep: np.ndarray, *arrays: np.ndarray) -> list[np.ndarray]:
    return [a[keep] for a in arrays]


def _replace(cp: np.ndarray, row: np.ndarray, t: _Tables) -> tuple[np.ndarray, np.ndarray]:
    """The lookup tables, with expansion offsets; joiners and selectors inside emoji and joining scripts stay."""
    same_prev, same_next = np.zeros(len(cp), bool), np.zeros(len(cp), bool)
    same_prev[1:] = row[1:] == row[:-1]
    same_next[:-1] = same_prev[1:]
    prev, nxt = np.roll(cp, 1), np.roll(cp, -1)
    length, to = t.length[cp].astype(np.int64), t.to[cp]
    after_emoji = same_prev & t.emoji[prev]
    selector = (cp == _VS16) | (cp == _VS15)
    keycap = same_prev & same_next & (((prev >= 48) & (prev < 58)) | (prev == 35) | (prev == 42)) & (nxt == 0x20E3)
    keep = selector & (after_emoji | keycap)
    kept_selector = np.roll(keep, 1) & same_prev
    keep |= (cp == _ZWJ) & (after_emoji | kept_selector) & same_next & t.emoji[nxt]
    letters = lambda x: (x >= 0x600) & (x < 0xE00)
    keep |= ((cp == _ZWJ) | (cp == _ZWNJ)) & same_prev & same_next & letters(prev) & letters(nxt)
    tag = (cp >= 0xE0020) & (cp < 0xE0080)
    if tag.any():  # flags of regions: a black flag followed by tags
        start = np.where(tag, 0, np.arange(len(cp)))
        base = np.maximum.accumulate(start)
        keep |= tag & (cp[base] == 0x1F3F4) & (row[base] == row)
    kana = lambda x: (x >= 0x30A1) & (x < 0x3100)
    dot = (cp == 0x30FB) & same_prev & same_next & kana(prev) & kana(nxt)
    length[keep] = 1
    to = np.where(keep | dot, cp, to)
    at = np.repeat(np.arange(len(cp)), length)
    out, out_row = to[at], row[at]
    wide = np.flatnonzero(length > 1)
    if len(wide):
        starts = np.cumsum(length) - length
        for value in np.unique(cp[wide]):  # as many as kinds of ligature
            text = np.array([ord(c) for c in t.expand[int(value)]], np.uint32)
            first = starts[wide[cp[wide] == value]]
            out[(first[:, None] + np.arange(len(text))).ravel()] = np.tile(text, len(first))
    return out, out_row


def _lookalikes(cp: np.ndarray, row: np.ndarray, t: _Tables) -> np.ndarray:
    """Look-alike letters by runs of letters, which are words.

    A word of look-alikes alone is Latin, unless it stands beside words of its own script: one with a letter that only
    that script has, or three words with ten letters together. In a word with Latin letters the rarer script gives way;
    there letters count as well that look like Latin ones only at a glance.
    """
    script = t.script[cp]
    if not (script > 1).any():
        return cp
    member = script > 0
    member |= (t.ccc[cp] > 0) & ~member
    joined = np.zeros(len(cp), bool)
    joined[1:] = member[1:] & member[:-1] & (row[1:] == row[:-1])
    at = np.flatnonzero(member)
    first = np.flatnonzero(member & ~joined)
    run = np.cumsum(member & ~joined)[at] - 1
    n = len(first)
    last = np.append(at[np.flatnonzero(np.diff(run))], at[-1])
    kind, letter = script[at], cp[at]
    own = (kind > 1) & (t.look[letter] == 0)
    count = lambda x: np.bincount(run[x], minlength=n)
    latin, cyrillic, greek, n_own = count(kind == 1), count(kind == 2), count(kind == 3), count(own)
    # neighbours: words of one script with at most three other signs between them
    pure = np.where(latin > 0, 0, np.where(greek == 0, 2, np.where(cyrillic == 0, 3, 0)))
    others = np.concatenate([[0], np.cumsum(cp >= 0x2E80)])
    beside = np.zeros(n, bool)
    beside[1:] = (pure[1:] > 0) & (pure[1:] == pure[:-1]) & (row[first[1:]] == row[last[:-1]]) & (first[1:] - last[:-1] <= 4) & (others[first[1:]] == others[last[:-1] + 1])
    phrase = np.cumsum(~beside) - 1
    total = lambda w: np.bincount(phrase, weights=w)[phrase]
    real = (pure > 0) & ((total(n_own) > 0) | ((total(np.ones(n)) >= 3) & (total(cyrillic + greek) >= 10)))
    out = np.where((kind > 1) & ~own & (n_own[run] == 0) & ~real[run], t.look[letter], letter)
    # a word with Latin letters in it
    strange = count((kind > 1) & (t.look[letter] == 0) & (t.glance[letter] == 0))
    to_latin = (latin > cyrillic + greek) & (strange == 0) & (n_own > 0)
    out = np.where((kind > 1) & to_latin[run], np.where(t.look[letter] > 0, t.look[letter], t.glance[letter]), out)
    for k in (2, 3):  # Latin letters inside a word of the other script
        has = (count(own & (kind == k)) > 0) & ~to_latin
        inside = (kind == 1) & has[run]
        if inside.any():
            stuck = count(inside & (t.back[k][letter] == 0)) > 0
            out = np.where(inside & ~stuck[run], t.back[k][letter], out)
    cp = cp.astype(np.uint32)
    cp[at] = out
    return cp


def _order_marks(cp: np.ndarray, row: np.ndarray, t: _Tables) -> np.ndarray:
    """Canonical order of marks by swaps of neighbours."""
    cp = cp.copy()
    while True:
        c = t.ccc[cp]
        bad = (c[:-1] > c[1:]) & (c[1:] > 0) & (row[1:] == row[:-1])
        bad[1:] &= ~bad[:-1]  # no overlapping swaps
        at = np.flatnonzero(bad)
        if not len(at):
            return cp
        cp[at], cp[at + 1] = cp[at + 1], cp[at].copy()


def _compose(cp: np.ndarray, row: np.ndarray, t: _Tables) -> tuple[np.ndarray, np.ndarray]:
    while True:  # a composed letter before a further mark is taken apart, as the marks may change places
        marked = np.zeros(len(cp), bool)
        marked[:-1] = (t.ccc[cp[1:]] > 0) & (row[1:] == row[:-1]) & (t.first[cp[:-1]] > 0)
        if not marked.any():
            break
        at = np.repeat(np.arange(len(cp)), 1 + marked)
        head = np.zeros(len(at), bool)
        head[np.flatnonzero(marked) + np.arange(int(marked.sum()))] = True
        tail = np.roll(head, 1)
        cp, row = np.where(head, t.first[cp[at]], np.where(tail, t.second[cp[at]], cp[at])), row[at]
    cp = _order_marks(cp, row, t)
    stuck = np.zeros(len(cp), bool)
    while len(cp) > 1:
        same = np.zeros(len(cp), bool)
        same[1:] = row[1:] == row[:-1]
        c = t.ccc[cp]
        base = np.maximum.accumulate(np.where((c == 0) | ~same, np.arange(len(cp)), 0))
        prev_stuck, prev_c = np.roll(stuck, 1), np.roll(c, 1)
        back = np.roll(cp, 1)
        lead = (back >= _L) & (back < _L + 19) & (cp >= _V) & (cp < _V + 21)
        tail = (back >= _S) & (back < _S + 11172) & ((back - _S) % 28 == 0) & (cp > _T) & (cp < _T + 28)
        jamo = same & (lead | tail)
        beside = base == np.arange(len(cp)) - 1
        next_mark = (c > 0) & ~stuck & (base < np.arange(len(cp))) & same & (beside | prev_stuck)
        take_mark = next_mark & (beside | (prev_c < c))
        other = same & (c == 0) & ~stuck & ~jamo & np.roll(c == 0, 1)
        key = (cp[np.where(take_mark, base, np.maximum(np.arange(len(cp)) - 1, 0))].astype(np.int64) << 21) | cp
        at = np.minimum(np.searchsorted(t.pair_keys, key), len(t.pair_keys) - 1)
        hit = (take_mark | other) & (t.pair_keys[at] == key)
        stuck |= next_mark & ~hit
        hit |= jamo
        # a character that is itself taken can't take the next one in the same pass
        overlap = np.zeros(len(cp), bool)
        overlap[1:] = hit[:-1] & (base[1:] != base[:-1])
        hit &= ~overlap
        found = np.flatnonzero(hit)
        if not len(found):
            if not (next_mark & ~hit).any():
                break
            continue
        onto = np.where(jamo[found] | (c[found] == 0), found - 1, base[found])
        new = t.pair_to[at[found]].astype(np.int64)
        a, b = cp[onto].astype(np.int64), cp[found].astype(np.int64)
        new = np.where(lead[found] & jamo[found], _S + ((a - _L) * 21 + (b - _V)) * 28, new)
        new = np.where(tail[found] & jamo[found], a + b - _T, new)
        cp[onto] = new
        cp, row, stuck = _drop(~hit, cp, row, stuck)
    return cp, row


def code_points(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all rows in one array, and where each row begins (one more than rows)."""
    arr = arr.cast(pa.string()) if not pa.types.is_string(arr.type) else arr
    if arr.null_count:
        arr = pc.fill_null(arr, "")
    if not len(arr):
        return np.zeros(0, np.uint32), np.zeros(1, np.int64)
    offsets = np.frombuffer(arr.buffers()[1], np.int32)[arr.offset : arr.offset + len(arr) + 1]
    data = arr.buffers()[2]
    data = memoryview(data)[offsets[0] : offsets[-1]] if data is not None else b""
    raw = np.frombuffer(data, np.uint8)
    cp = np.frombuffer(bytes(data).decode("utf-8").encode("utf-32-le"), np.uint32)
    starts = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)]).astype(np.int64)
    return cp, starts[offsets - offsets[0]]


SLICE_BYTES = 1_500_000


def slices(batch: pa.RecordBatch, *columns: str):
    """Parts of a batch whose texts together have at most SLICE_BYTES (or one row): working memory doesn't follow the batch."""
    n = len(batch)
    if not n:
        return
    size = np.zeros(n, np.int64)
    for c in columns:
        size += pc.fill_null(pc.binary_length(batch.column(c)), 0).to_numpy(zero_copy_only=False)
    total, at = np.cumsum(size), 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + SLICE_BYTES, "right")))
        yield batch.slice(at, end - at)
        at = end


def to_strings(cp: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """The reverse: rows of code points as Arrow strings."""
    data = cp.astype("<u4").tobytes().decode("utf-32-le").encode("utf-8")
    size = 1 + (cp >= 0x80).astype(np.int64) + (cp >= 0x800) + (cp >= 0x10000)
    at = np.concatenate([[0], np.cumsum(size)])[bounds].astype(np.int32)
    return pa.StringArray.from_buffers(len(bounds) - 1, pa.py_buffer(at.tobytes()), pa.py_buffer(data))


def normalize_array(arr: pa.Array) -> pa.Array:
    """The consistent form of every text; null stays null, '' stays ''."""
    t = _tables()
    cp, bounds = code_points(arr)
    hits = np.concatenate([[0], np.cumsum(t.watch[cp])])
    touched = np.flatnonzero(hits[bounds[1:]] > hits[bounds[:-1]])
    if not len(touched):
        return arr
    lengths = (bounds[1:] - bounds[:-1])[touched]
    row = np.repeat(np.arange(len(touched)), lengths)
    at = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths) + np.repeat(bounds[touched], lengths)
    cp, row = _replace(cp[at], row, t)
    if len(cp):
        cp, row = _compose(cp, row, t)
        cp = _lookalikes(cp, row, t)
        cp, row = _compose(cp, row, t)  # marks on a letter that has just become Latin
        lone = t.jamo[cp]
        cp = np.where(lone > 0, lone, cp)
    new = to_strings(cp, np.searchsorted(row, np.arange(len(touched) + 1)))
    mask = np.zeros(len(arr), bool)
    mask[touched] = True
    return pc.replace_with_mask(arr.cast(pa.string()), pa.array(mask), new)


@F.arrow_udf(T.StringType())
def _normalized(a: pa.Array) -> pa.Array:
    if isinstance(a, pa.ChunkedArray):
        a = a.combine_chunks()
    parts = [normalize_array(b.column("t")).cast(pa.string()) for b in slices(pa.RecordBatch.from_arrays([a], names=["t"]), "t")]
    return pa.concat_arrays(parts) if parts else a


def normalized(c: Column) -> Column:
    """One consistent form of a text column.

    Defined cases: null gives null; empty gives empty; a text that is only invisible characters gives ''; very long
    texts are handled whole; equal texts give equal results, and the form is stable (normalising twice changes nothing).
    """
    return _normalized(c)
