"""Keyword-stuffed and link-list pages: repeated maximal substrings by suffix automaton, and missing clause structure.

Each page is read as words. What carries clause structure divides it: particles and endings, function words and verbs, the
marks of records (dates, times, case numbers, chapter numbers), and, in languages whose words are not known here, the form
of prose (below). Of every page the suffix automaton over the stems between these marks is built; its states that occur
again are the repeated maximal substrings. Three things count as stuffed: links; long runs without clause structure, which
are bare key words, labels or tags; and sentences that the repeated substrings of the automaton fill (key phrases in the
guise of sentences). Where such substrings cover nearly all words and the few structural words only join them, these
don't count as clause structure. A page is found if more than half of its characters are stuffed.

Prose of other languages is known by its form: in scripts with spaces many short words of several kinds stand among the
long ones, in scripts without spaces text goes on for many characters, with kana in between or to a full stop.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from itertools import accumulate, pairwise

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words or characters of a run without clause structure; the second values hold for ASCII words, which are shorter and lean on particles less.
RUN_WORDS, RUN_CHARS = (7, 10), (40, 64)
PHRASE_SHARE = (0.48, 0.58)  # of all sentences that have it, by one repeated phrase; the second value holds for ASCII phrases
TWICE_SHARE = (0.3, 0.58)  # the same, if the phrase comes back in most of these sentences
MIN_REPEATS = 3
SHORT_LETTERS, SHORT_SHARE, SHORT_KINDS = 3, 0.25, 4  # short words of prose in other languages
UNSPACED = 10  # characters of a token of a script without spaces that is more than a key word
PADDED_WORDS, PADDED_COVER, PADDED_KINDS = 30, 0.8, 6

_DOT = r"\s*(?:\.|\(\s*(?:dot|점)\s*\)|\[\s*(?:\.|dot|점)\s*\]|\{\s*(?:\.|dot)\s*\}|(?<=\s)(?:dot|점|닷)(?=\s))\s*"
_TLD = r"(?:test|example|invalid|com|net|org|info|biz|kr|io|shop|site|xyz)\b"
LINK = re.compile(
    r"</?[A-Za-z][^<>]*>|h(?:tt|xx)ps?\s*:\s*/\s*/\s*[^\s<>|,)\]]+(?:" + _DOT + _TLD + r")?(?:/[^\s<>|,)\]]*)?"
    r"|\bwww[\s.]+[\w-]+(?:" + _DOT + r"[\w-]+)*(?:/[^\s<>|,)\]]*)?|[\w-]+" + _DOT + _TLD + r"(?:/[^\s<>|,)\]]*)?|[\w.+-]+@[\w-]+\.[\w.]+"
)
# what a link can't do without; most pages have none of it
_LINK_PARTS = ("<", "@", "://", "/ /", "www", *re.findall(r"[a-z]+(?=[|)])", _TLD))
_MAY_LINK = re.compile(r"<|@|://|/ /|www|\b" + _TLD)
_WORD = re.compile(r"([^\s,;|/·#＃@+*▶►•()\[\]{}<>\"'“”‘’…~=]+)")
_RECORD = re.compile(r"^(?:\d{4}\.|\d{1,2}:\d{2}(?:경)?|\d{4}[가-힣]{1,3}\d+(?:호)?|제\d+(?:장|절|조|항|편|호)\S*|\d{4}[-.]\d{1,2}[-.]\d{1,2}\.?)$")
_ENDING = re.compile(
    r"(?:(?<=[가-힣一-鿿A-Za-z0-9])(?:에서는|에서만|에서|에게서|에게|으로는|으로|부터|까지|이라는|라는|이라고|라고|입니다|습니다|합니다|니다|하는|하여|하고|하며|하면|한다|였다|었다|았다|이다|대한|관한|따라|있는|없는|있다|없다|같은|이며|"
    r"되고|되며|되어|받고|있고|없고|않고|았고|었고|였고|다고|라며|으며|으나|지만|는지|은지|인지|시면|을지|면서)"
    r"|(?<=[가-힣一-鿿A-Za-z0-9]{2})(?:이|(?<![특평단원정])(?<!전문)가|와|(?<![결효경])과|의|도|만|로|며|여|요|면|나)|(?<=[가-힣一-鿿A-Za-z0-9])(?:은|는|을|를|에|다)|(?<=^[A-Z])(?:이|가|와|과|의|도|만|로))$"
)
_ENGLISH = frozenset(
    "and or but that which who whom this these those it its they them their he she his her him we us our you your i was were is are am be been being had has have did does do "
    "not never only also then than so such if while when where how since before after during until between among through under over against about into from by with for on at in as "
    "could would should may might must can will shall said told found gave sent held met saw made took came went kept felt knew wrote read heard left brought spoke withdrew drew became began chose fell grew lost paid put ran rose sat set stood thought won because according "
    "says shows explains differs means gives finds holds asks remains concerns applies lies".split()
) - frozenset("means do can you your on in at for us it".split())
_KOREAN = frozenset("대한 관한 따른 의한 위한 있는 없는 있다 없다 같은 아니다 등 및 또는 그리고 그러나 따라서".split())
# Words (and forms in -ed) that carry a clause unless one of BEFORE comes before them: the seized phone, go to.
_BY_CONTEXT = frozenset("spoken seen given shown written taken known hidden to".split())
_BEFORE = frozenset("the a an go".split())
_NOT_VERBS = frozenset("limited used certified sealed boxed rated related advanced unlimited".split())
_ARTICLES = frozenset("the a an this that these those his her its their my your our".split())
_SHORT_ENGLISH = _ARTICLES | frozenset("means do can you on in at for us of no me all new top get buy now".split())
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff]")
_KANA = re.compile("[\u3041-\u3096]")
_BARE, _BARE_3 = re.compile(rb"\x00+"), re.compile(rb"\x00{3,}")
_MARKS = {n: 1 for n in range(1, 64)} | {0: 0, -1: 1, -2: 2}
_SOFT = {n: n > 0 for n in range(-2, 64)}
_SENTENCE = re.compile(r"[^.!?\n]*(?:(?<=\d)\.[^.!?\n]*)*[.!?\n]*")  # a stop after a digit ends none


def _clausal(word: str) -> tuple[int, str]:
    """Length of the ending if the word carries clause structure, -1 if it is wholly structural, 0 if bare; its stem.
    -2 leaves it to the word before."""
    bare = word.strip(".!?:,-")
    if _RECORD.match(word) or _RECORD.match(bare):
        return -1, ""
    if bare.isascii():
        low = bare.lower()
        if low in _BY_CONTEXT or (low.endswith("ed") and len(low) > 4 and low not in _NOT_VERBS):
            return -2, bare
        return (-1, "") if low in _ENGLISH else (0, bare)
    if bare in _KOREAN:
        return -1, ""
    m = _ENDING.search(bare)
    n = len(m.group(0)) if m else 0
    return n, bare[: len(bare) - n]


def _known(words: list[str], memo: dict[str, tuple[int, str]]) -> list[tuple[int, str]]:
    got = list(map(memo.get, words))
    if None in got:
        if len(memo) > 500_000:
            memo.clear()
        for k, g in enumerate(got):
            if g is None:
                w = words[k]
                g = memo.get(w)
                if g is None:
                    g = memo[w] = _clausal(w)
                got[k] = g
    return got


class SuffixAutomaton:
    """Of the parts of a sequence between dividers (''): substrings never hold one. Linear in the length."""

    def __init__(self, items: list):
        nxt: list[dict] = [{}]
        link, length, first, count = [-1], [0], [-1], [0]
        last, at = 0, []
        for i, c in enumerate(items):
            if c == "":
                last = 0
                at.append(0)
                continue
            cur, p = -1, last
            q = nxt[p].get(c)
            if q is not None and length[p] + 1 == length[q]:  # the part so far has occurred before
                count[q] += 1
                last = q
                at.append(q)
                continue
            if q is None:
                cur = len(nxt)
                nxt.append({})
                link.append(0)
                length.append(length[p] + 1)
                first.append(i)
                count.append(1)
                while p >= 0 and c not in nxt[p]:
                    nxt[p][c] = cur
                    p = link[p]
            if p >= 0:
                q = nxt[p][c]
                if length[p] + 1 != length[q]:
                    clone = len(nxt)
                    nxt.append(nxt[q].copy())
                    link.append(link[q])
                    length.append(length[p] + 1)
                    first.append(first[q])
                    count.append(0)
                    while p >= 0 and nxt[p].get(c) == q:
                        nxt[p][c] = clone
                        p = link[p]
                    link[q] = q = clone
                if cur < 0:  # it has occurred before inside of parts
                    count[q] += 1
                    cur = q
                else:
                    link[cur] = q
            last = cur
            at.append(cur)
        for s in sorted(range(1, len(nxt)), key=length.__getitem__, reverse=True):
            count[link[s]] += count[s]
        self.next, self.link, self.length, self.first, self.count = nxt, link, length, first, count
        self.at = at  # the state of the part up to each item

    def repeated(self, least: int) -> list[tuple[int, int, int]]:
        """(end, length, count) of each left-maximal substring that occurs ``least`` times or more; end is exclusive."""
        return [(self.first[s] + 1, self.length[s], self.count[s]) for s in range(1, len(self.next)) if self.count[s] >= least]


def _filled(auto: SuffixAutomaton, stems: list[str], begins: list[int], stops: list[int], where: list[int], deep: list[int], sizes: list[int], dense: set[int]) -> tuple[set[int], int]:
    """Sentences filled by a repeated substring, however small a part of the page it is; characters that repeated ones cover.

    ``stems`` ('' divides) have, but for the dividers, their characters outside of runs from ``begins`` to ``stops``, their
    sentence in ``where`` and in ``deep`` how many of the stems up to there lie in a run; ``sizes`` are those of the sentences outside of runs; ``dense`` are the
    sentences that repeated stems fill enough, outside of which no substring can do so alone. The substrings that end at a
    word are the states on its suffix links; between two marks of clause structure there are few, and of those that end in a
    run only the ones that begin before it have characters outside.
    """
    link, length, count = auto.link, auto.length, auto.count
    covered, upto = 0, 0
    wanted: set[int] = set()
    at = [state for state in auto.at if state]
    for i, state in enumerate(at):
        if count[state] < 2:  # what is longest before it has occurred again
            state = link[state]
            if not state:
                continue
        end = stops[i]
        if end > upto:
            start = begins[i + 1 - length[state]]
            covered += end - (start if start > upto else upto)
            upto = end
        if where[i] in dense:
            least = deep[i]
            while length[state] > least:
                wanted.add(state)
                state = link[state]
    if not wanted:
        return set(), covered
    seen: dict[int, list] = {}  # of each state: characters filled, end of the last occurrence, sentences, occurrences, a place
    for i, state in enumerate(at):
        least = deep[i]
        while length[state] > least:
            if state in wanted:
                start, end = begins[i + 1 - length[state]], stops[i]
                got = seen.get(state)
                if got is None:
                    seen[state] = [end - start, end, [where[i]], 1, i]
                else:
                    got[0] += end - (start if start > got[1] else got[1])
                    got[1] = end
                    got[3] += 1
                    if got[2][-1] != where[i]:
                        got[2].append(where[i])
            state = link[state]
    other: list[int] = []
    keyed: set[int] = set()
    for state, (filled, _, inside, n, i) in seen.items():
        total, k = sum(map(sizes.__getitem__, inside)), count[state]
        twice = 2 * n >= 3 * len(inside)
        if filled >= (TWICE_SHARE if twice else PHRASE_SHARE)[0] * total and (twice or k >= MIN_REPEATS):
            if not other:
                other = [0, *accumulate(not s.isascii() for s in stems if s)]
            in_ascii = other[i + 1] == other[i + 1 - length[state]]
            if filled >= (TWICE_SHARE if twice and k >= MIN_REPEATS else PHRASE_SHARE)[in_ascii or k < MIN_REPEATS] * total:
                keyed.update(inside)
    return keyed, covered


def _prose(words: list[str]) -> list[bool] | None:
    """Which words carry structure if these are prose of a language whose words are not known here, else None."""
    unspaced = [bool(_UNSPACED.search(w)) for w in words]
    if 2 * sum(unspaced) > len(words):
        marks = [u and ((len(w) >= UNSPACED and bool(_KANA.search(w))) or (w[-1] in "。！？" and len(w) >= UNSPACED) or len(w) >= 2 * UNSPACED) for w, u in zip(words, unspaced)]
        return marks if 3 * sum(len(w) for w, m in zip(words, marks) if m) >= sum(map(len, words)) else None
    bare = [w.strip(".!?:-") for w in words]
    short = [0 < len(w) <= SHORT_LETTERS and w.isalpha() and w == w.lower() and not "가" <= w[0] <= "힣" for w in bare]
    ends = [0, *(i + 1 for i, w in enumerate(words) if w[-1] in ".!?।؟")]
    marks, kinds = [False] * len(words), set()
    for a, b in pairwise(ends):  # sentences: from a capital, where the script has them, to a stop
        if b - a >= 5 and (words[a][0].isupper() or words[a][0].lower() == words[a][0].upper()) and sum(short[a:b]) >= SHORT_SHARE * (b - a):
            marks[a:b] = short[a:b]
            kinds |= {w for w, m in zip(bare[a:b], short[a:b]) if m}
    inside = sum(b - a for a, b in pairwise(ends) if any(marks[a:b]))
    return marks if len(kinds - _ENGLISH - _SHORT_ENGLISH) >= SHORT_KINDS and 5 * inside >= 3 * len(words) else None


def measure(text: str, memo: dict[str, tuple[int, str]]) -> tuple[int, int, int, int, int]:
    """Characters of the page, in links, in bare runs and in stuffed sentences (no character counts twice); those that
    repeated substrings cover outside of runs."""
    total = len(text)
    if not text.strip():
        return total, 0, 0, 0, 0
    spans = [m.span() for m in LINK.finditer(text)] if any(p in text for p in _LINK_PARTS) and _MAY_LINK.search(text) else []
    links = sum(b - a for a, b in spans)
    parts, at = [], 0
    for a, b in spans:
        parts.append(text[at:a])
        parts.append("\n" + " " * (b - a - 1) if b > a else "")
        at = b
    rest = "".join([*parts, text[at:]]) if spans else text
    pieces = _WORD.split(rest)  # what lies between words and words by turns
    words = pieces[1::2]
    if not words:
        return total, total, 0, 0, 0
    known = _known(words, memo)
    ends, stems = zip(*known)
    flags = bytearray(map(_MARKS.__getitem__, ends))
    at = flags.find(2)
    while at >= 0:
        flags[at] = not (at and words[at - 1].lower() in _BEFORE)
        at = flags.find(2, at + 1)
    lengths = list(map(len, words))
    starts = list(accumulate(map(len, pieces)))[::2]  # and the end
    runs = _runs(flags, words, lengths, starts, rest)
    loose = [(i, j) for i, j in runs if j - i >= RUN_WORDS[0] or not words[i].isascii()]
    if loose:  # prose of another language?
        again = False
        for i, j in loose:
            marks = _prose(words[i:j])
            if marks is not None:
                again = True
                for k, m in enumerate(marks, i):
                    flags[k] |= m
        if again:
            runs = _runs(flags, words, lengths, starts, rest)
    sentences = [m.span() for m in _SENTENCE.finditer(rest) if m.group().strip()]
    sizes = [len(rest[a:b].strip()) for a, b in sentences]
    for i, j in runs:  # of a sentence counts what is not in a run
        a, b = starts[i], starts[j]
        k = max(bisect_right(sentences, (a, len(rest))) - 1, 0)
        while k < len(sentences) and sentences[k][0] < b:
            sizes[k] -= max(0, min(b, sentences[k][1]) - max(a, sentences[k][0]))
            k += 1
    sizes = [max(x, 0) for x in sizes]
    counts = Counter(stems)
    keyed, covered = _repeats(words, ends, stems, flags, counts, runs, starts, sentences, sizes)
    if _padded(words, known, flags, counts):
        for k, (f, _) in enumerate(known):
            if f < 0 and words[k].isascii() and words[k].isalpha():
                flags[k] = 0
        runs, keyed = _runs(flags, words, lengths, starts, rest), set()
    bare = _size(runs, starts, spans)
    left = max(total - links - bare, 0)
    stuffed = min(sum(sizes[k] for k in keyed), left)
    return total, links, bare, stuffed, covered


def _runs(flags: bytearray, words: list[str], lengths: list[int], starts: list[int], rest: str) -> list[tuple[int, int]]:
    """Words from and to of each run without clause structure that is long enough."""
    n, out = len(words), []
    if 1 not in flags:
        return [(0, n)]
    # runs of two words or fewer can be long enough only with very long words
    found = [m.span() for m in (_BARE if max(lengths) >= RUN_CHARS[0] // 2 else _BARE_3).finditer(flags)]
    for i, j in found:
        if j - i < RUN_WORDS[0] and sum(lengths[i:j]) + 4 * (j - i) < RUN_CHARS[0]:
            continue
        stop = j if j == n else j - 1  # the last word belongs to the clause that follows
        if j - i < RUN_WORDS[0] and starts[stop] - starts[i] < RUN_CHARS[0]:
            continue
        ascii_run = rest[starts[i] : starts[stop]].isascii()
        # ASCII sentences have few marks, so their ends divide runs too
        cuts = [k + 1 for k in range(i, stop) if words[k][-1] in ".!?"] if ascii_run else []
        for a, b in pairwise([i, *cuts, stop] if not cuts or cuts[-1] < stop else [i, *cuts]):
            if b - a + (b == stop < j) >= RUN_WORDS[ascii_run] or starts[b] - starts[a] >= RUN_CHARS[ascii_run]:
                out.append((a, b))
    return out


def _size(runs: list[tuple[int, int]], starts: list[int], links: list[tuple[int, int]]) -> int:
    """Characters of runs; links between the words are counted by themselves."""
    ends = [b for _, b in links]
    size = 0
    for a, b in runs:
        size += starts[b] - (starts[a] if a else 0)
        k = bisect_right(ends, starts[a] if a else 0)
        while k < len(links) and ends[k] <= starts[b]:
            size -= links[k][1] - links[k][0]
            k += 1
    return size


def _repeats(words, ends, known, flags, counts, runs, starts, sentences, sizes) -> tuple[set[int], int]:
    """The page's automaton over stems between marks of clause structure: filled sentences, covered characters.

    A word that occurs once is in no repeated substring, so it divides. Runs count by themselves: what occurs in them is a
    repetition, but has no characters here.
    """
    often = {s for s, c in counts.items() if c >= 2 and s}
    soft = int.from_bytes(bytes(map(_SOFT.__getitem__, ends)), "little")  # a stem before its ending stays
    off = (int.from_bytes(flags, "little") & ~soft).to_bytes(len(words), "little")
    ran, places = _outside(runs, starts) if runs else (b"", starts)
    stems: list[str] = []
    begins: list[int] = []
    stops: list[int] = []
    where: list[int] = []
    deep: list[int] = []
    filled: dict[int, int] = {}
    k, last, upto, run = 0, len(sentences) - 1, 0, 0
    edge = sentences[0][1]
    after = -1  # the word that would go on with the phrase
    for i in [i for i, (s, b) in enumerate(zip(known, off)) if not b and s in often]:
        s = known[i]
        if starts[i] >= edge and k < last:  # a phrase ends with its sentence
            while k < last and starts[i] >= edge:
                k += 1
                edge = sentences[k][1]
            after = -1
        a = places[i]
        if ran and ran[i]:
            end = a
            run = run + 1 if i == after else 1
        else:
            word = words[i]
            if word[0] != s[0]:
                a += word.find(s)
            end, run = a + len(s), 0
        if i != after:
            stems.append("")
            upto = a
        stems.append(s)
        begins.append(a)
        stops.append(end)
        where.append(k)
        if ran:
            deep.append(run)
        if end > upto:
            filled[k] = filled.get(k, 0) + end - upto
            upto = end
        after = i + 1 if ends[i] <= 0 else -1
    # a phrase that fills enough of its sentences fills enough of one of them
    dense = {k for k, n in filled.items() if n >= TWICE_SHARE[0] * sizes[k]}
    return _filled(SuffixAutomaton(stems), stems, begins, stops, where, deep or [0] * len(where), sizes, dense)


def _outside(runs: list[tuple[int, int]], starts: list[int]) -> tuple[bytearray, list[int]]:
    """Which words are in runs; where words start if runs had no characters."""
    ran, places, at, gone = bytearray(len(starts)), [], 0, 0
    for i, j in runs:
        ran[i:j] = b"\1" * (j - i)
        places += [a - gone for a in starts[at:i]]
        places += [starts[i] - gone] * (j - i)
        gone += starts[j] - starts[i]
        at = j
    return ran, places + [a - gone for a in starts[at:]]


def _padded(words: list[str], known: list[tuple[int, str]], flags: bytearray, counts: Counter) -> bool:
    """Whether structural words only join key words: few kinds of them, no article, and names that come again and again."""
    if len(words) < PADDED_WORDS or any(f > 0 for f, _ in known):
        return False
    joined = [w.lower() for w, (f, _), m in zip(words, known, flags) if m and f < 0 and w.isascii()]
    if not joined or len(set(joined)) > PADDED_KINDS:
        return False
    if sum(w.lower() in _ARTICLES for w in words) * 50 > len(words):
        return False
    content = [s for (f, s), m in zip(known, flags) if s and not m]
    size = sum(map(len, content))
    return size > 0 and sum(len(s) for s in content if counts[s] >= MIN_REPEATS) >= PADDED_COVER * size


def _run(batches):
    memo: dict[str, tuple[int, str]] = {}
    for b in batches:
        got = [measure(t or "", memo) for t in b.column("_text").to_pylist()]
        cols = [b.column("_id"), *[pa.array([g[k] for g in got], pa.int32()) for k in range(5)]]
        yield pa.RecordBatch.from_arrays(cols, names=["_id", "n_chars", "link_chars", "bare_chars", "stuffed_chars", "repeated_chars"])


def stuffing(df: DataFrame, item_id: str, text: str) -> DataFrame:
    """item_id, n_chars, link_chars, bare_chars, stuffed_chars, repeated_chars and stuffed_share of every page.

    Defined cases: null and empty texts have share 0; very long texts are measured whole, in linear time; repeated rows
    come back as often as they are given; null ids are kept; other columns, whatever their names, are not read.
    """
    kind = dict(df.dtypes)[item_id]
    out = df.select(F.col(item_id).alias("_id"), F.col(text).alias("_text")).mapInArrow(
        _run, f"_id {kind}, n_chars int, link_chars int, bare_chars int, stuffed_chars int, repeated_chars int"
    )
    share = F.coalesce(F.try_divide(F.col("link_chars") + F.col("bare_chars") + F.col("stuffed_chars"), "n_chars"), F.lit(0.0))
    return out.withColumnRenamed("_id", item_id).withColumn("stuffed_share", share)
