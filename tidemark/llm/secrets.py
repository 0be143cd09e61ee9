"""Secret scanning: patterns, and the cost of guessing values in credential contexts.

Three fixed patterns give the base spans.  Beside them, values that stand where credentials
stand (after a key word, a user:password@host, an Authorization header) are judged by how many
guesses an attacker who knows words, dates, repeats and keyboard walks would need: the cheapest
segmentation of the value into such parts and brute-force stretches is found by dynamic
programming, and a value that costs enough becomes a span.  The words are some that are common in
passwords, and then the corpus's own by the number of documents that hold them.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import MEMORIES, map_rows

KINDS = ("assign", "access", "hex")
#: The kind of span that the guess cost adds; it sorts after the base kinds.
GUESSED = "guess"
#: A value in a credential context is a secret if guessing it takes 10 ** this many tries.
MIN_LOG10_GUESSES = 8.0
#: How many of the corpus's words the attacker knows, the commonest by documents.
VOCABULARY = 50_000
#: Values of more characters have their repeats looked for by hashes of this many characters.
SHORT, WINDOW = 128, 8
#: The longest word of the vocabulary.
LONGEST_WORD = 32
#: Costs of so many values up to this length are remembered.
KEEP_CHARS, KEEP = 128, 100_000

# --- fixed values: the base patterns -------------------------------------------------------
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
# --- end of fixed values -------------------------------------------------------------------

#: Where else credentials stand; group 1 is the value.
CONTEXTS = (
    re.compile(r"""(?:passphrase|passcode|password|passwd|pwd|pass|secret|token|api_?key|credentials?|auth|bearer|private_?key|client_?secret|access_?key|signing_?key)["']?\x20*(?:[:=]|=>|\x20is\x20)\x20*["']?([^\s"'<>,;]{6,}+)""", re.ASCII | re.IGNORECASE),
    re.compile(r"""authorization["']?\x20*[:=]\x20*["']?(?:basic|bearer)\x20+([^\s"'<>,;]{6,}+)""", re.ASCII | re.IGNORECASE),
    # Only the last character of the scheme is looked at: reading it from each place would not be linear.
    re.compile(r"""(?<=[a-z0-9+.-])://[^\s:/@]*+:([^\s:/@]{6,}+)@""", re.ASCII | re.IGNORECASE),
)
#: A text without any of these can't match a context: a quick look before the patterns.
HINTS = re.compile(r"pass|pwd|credential|auth|bearer|_?key|secret|token|://", re.ASCII | re.IGNORECASE)

#: Common parts of passwords, the likeliest first: a word costs its place in this list.
WORDS = (
    "password pass admin welcome letmein login user root test guest secret master love dragon monkey football baseball "
    "sunshine princess shadow superman batman hello freedom whatever trustno qwerty iloveyou summer winter spring autumn "
    "monday friday january february march april june july august september october november december default changeme "
    "example sample demo public private system server database mysql oracle postgres token key access account company "
    "office home work money computer internet google apple orange banana cookie coffee pepper ginger tiger eagle hunter "
    "ranger soccer hockey killer jordan michael jennifer thomas robert daniel andrew joshua charlie jessica ashley"
).split()
BUILT_IN = {w: i + 1 for i, w in enumerate(WORDS)}
ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
_PLACE = {c: (y, x + y * 0.5) for y, row in enumerate(ROWS) for x, c in enumerate(row)}
_LEET = str.maketrans("013457@$!", "oleastasi")
_DATE = re.compile(r"(?:19|20)\d\d[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:19|20)\d\d|(?:19|20)\d\d")


def _alphabet(c: str) -> float:
    """log10 of the tries for one brute-forced character."""
    return 1.0 if c.isdigit() else math.log10(26) if c.islower() else math.log10(52) if c.isupper() else math.log10(95)


def repeats(value: str) -> list[tuple[int, int, int]]:
    """The stretches (start, end, width) in which each character equals the one ``width`` before
    it and which hold their unit twice or more (a single character three times).

    Stretches within one of a width that divides theirs are left out: the shorter unit is the
    cheaper one.  A stretch of a unit of ``2 * WINDOW`` characters or more must agree at one of the
    places 0, width, 2 * width... and ``WINDOW`` characters to one side, so a long value takes about
    n log n looks.
    """
    n = len(value)
    found: dict[int, list[tuple[int, int]]] = {}  # by width, in order
    codes = np.frombuffer(value.encode("utf-32-le", "surrogatepass"), np.uint32)

    def within(at: int, end: int, width: int) -> bool:
        """Whether a found stretch of a width that divides this one holds at..end."""
        for part, stretches in found.items():
            if width % part == 0 and stretches:
                place = bisect_right(stretches, (at, n)) - 1
                if place >= 0 and end <= stretches[place][1]:
                    return True
        return False

    def add(start: int, end: int, width: int) -> None:
        if end - start >= max(2 * width, 3) and not within(start, end, width):
            found.setdefault(width, []).append((start, end))

    few = n // 2 if n <= SHORT else min(n // 2, 2 * WINDOW - 1)
    for width in range(1, few + 1):
        same = np.concatenate(([False], codes[width:] == codes[:-width], [False])).astype(np.int8)
        edges = np.flatnonzero(np.diff(same))
        for start, end in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            add(start, end + width, width)
    if n <= SHORT:
        return [(start, end, width) for width, stretches in found.items() for start, end in stretches]
    hashes = np.zeros(n - WINDOW + 1, np.uint64)
    for i in range(WINDOW):
        hashes = hashes * np.uint64(0x9E3779B97F4A7C15) + codes[i : i + len(hashes)].astype(np.uint64) + np.uint64(1)
    for width in range(few + 1, n // 2 + 1):
        hits = []
        for back in (0, WINDOW):
            places = np.arange(width if back else 0, n, width) - back
            places = places[places + width < len(hashes)]
            hits.append(places[hashes[places] == hashes[places + width]])
        some = np.sort(np.concatenate(hits))
        if len(some) > 8:  # a periodic value: leave out what shorter units explain
            for part in [w for w in found if width % w == 0 and len(found[w]) <= 64]:
                for start, end in found[part]:
                    some = some[(some < start) | (some + width >= end)]
        done = 0
        for at in some.tolist():
            if at < done or within(at, at + width + 1, width) or codes[at] != codes[at + width]:
                continue
            start, end = at, at
            while end + width < n:  # to the first place that differs, in growing steps
                step = max(256, end - at)
                part = codes[end + width : end + width + step] != codes[end : end + step][: max(0, n - width - end)]
                if part.any():
                    end += int(part.argmax())
                    break
                end += len(part)
            while start > 0:
                back = max(0, start - max(256, at - start))
                part = codes[back:start] != codes[back + width : start + width]
                if part.any():
                    start = back + int(np.flatnonzero(part)[-1]) + 1
                    break
                start = back
            done = end
            add(start, end + width, width)
    return [(start, end, width) for width, stretches in found.items() for start, end in stretches]


class _Best:
    """The least of cost[k] + log10(x - k) over the places k given so far, for growing x.

    An older place gains on a newer one as x grows, so the ones that can still be the least form
    a stack whose newest is overtaken first.
    """

    def __init__(self) -> None:
        self.stack: list[tuple[float, int]] = []

    @staticmethod
    def overtaken(old: tuple[float, int], new: tuple[float, int]) -> float:
        """From which x on the older place is the least of the two."""
        ratio = 10.0 ** min(new[0] - old[0], 300.0)
        return (ratio * new[1] - old[1]) / (ratio - 1.0) if ratio > 1.0 else math.inf

    def give(self, cost: float, place: int) -> None:
        new = (cost, place)
        while len(self.stack) > 1 and self.overtaken(self.stack[-1], new) >= self.overtaken(self.stack[-2], self.stack[-1]):
            self.stack.pop()
        self.stack.append(new)

    def least(self, x: int) -> float:
        stack = self.stack
        while len(stack) > 1 and self.overtaken(stack[-2], stack[-1]) <= x:
            stack.pop()
        return stack[-1][0] + math.log10(x - stack[-1][1])


class GuessCost:
    """The cost of guessing values, for an attacker who knows words by rank."""

    def __init__(self, ranks: dict[str, int] | None = None):
        self.ranks = ranks or BUILT_IN
        self.longest = max(map(len, self.ranks))
        self.known: dict[str, float] = {}

    def __call__(self, value: str) -> float:
        """:meth:`log10_guesses`, remembered for values that are not long."""
        found = self.known.get(value)
        if found is None:
            found = self.log10_guesses(value)
            if len(value) <= KEEP_CHARS:
                if len(self.known) >= KEEP:
                    self.known.clear()
                self.known[value] = found
        return found

    def log10_guesses(self, value: str) -> float:
        """log10 of the guesses for the cheapest segmentation of a whole value.

        ``best[j]`` is the least cost of its first j characters; a part adds its own log-cost, and
        every part but the first a factor of ten for not knowing where it begins.  Whatever a
        part's length, its cost is the end's share less the beginning's (brute force, walks) or
        grows with the number of repeats alone, so the least over all beginnings is carried along.
        """
        n = len(value)
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in value)
        plain = low.translate(_LEET)
        sums = [0.0, *accumulate(map(_alphabet, value))]
        words, ranks = [value, low, plain], self.ranks
        runs: dict[int, list[tuple[int, int, int, list[_Best]]]] = {}
        for start, end, width in repeats(value):
            runs.setdefault(start, []).append((start, end, width, [_Best() for _ in range(width)]))
        open_: list[tuple[int, int, int, list[_Best]]] = []
        dates: dict[int, list[tuple[int, float]]] = {}
        cost = [0.0] * (n + 1)  # of the first i characters, and not knowing that a part begins there
        walk, walk_from = math.inf, 0
        brute = 0.0
        for j in range(1, n + 1):
            i = j - 1
            if i in runs:
                open_ += runs[i]
            if value[i].isdigit() and (m := _DATE.match(value, i)):
                dates.setdefault(m.end(), []).append((i, math.log10(365 * 60) if m.end() - i > 4 else math.log10(120)))
            brute = min(brute, cost[i] - sums[i])
            best = brute + sums[j]
            for k in range(max(0, j - self.longest), j - 2):
                for spelt, extra in ((low[k:j], 0.0), (plain[k:j], 0.5)):
                    if spelt in ranks:
                        word = words[0][k:j]
                        case = 0.0 if word.islower() or not word.isalpha() else 0.4 if word.istitle() else 1.0
                        best = min(best, cost[k] + math.log10(ranks[spelt] + 1) + extra + case)
                        break
            if i and not _beside(low[i - 1], low[i]):
                walk, walk_from = math.inf, i
            if j - 3 >= walk_from:
                walk = min(walk, cost[j - 3] - 0.6 * (j - 3))
                best = min(best, walk + math.log10(len(_PLACE)) + 0.6 * j)
            for k, part in dates.pop(j, ()):
                best = min(best, cost[k] + part)
            still = []
            for run in open_:
                start, end, width, queues = run
                k = j - (3 if width == 1 else 2 * width)
                if k >= start:
                    queue = queues[k % width]
                    queue.give(cost[k], k // width)
                    best = min(best, queue.least(j // width if width > 1 else j) + sums[start + width] - sums[start])
                if j < end:
                    still.append(run)
            open_ = still
            cost[j] = best + 1.0
        return cost[n] - 1.0 if n else 0.0


def _beside(a: str, b: str) -> bool:
    """Whether two characters are neighbours on the keyboard."""
    if a == b or a not in _PLACE or b not in _PLACE:
        return False
    (y, x), (v, u) = _PLACE[a], _PLACE[b]
    return abs(y - v) <= 1 and abs(x - u) <= 1.1


def vocabulary(docs: DataFrame, most: int = VOCABULARY) -> dict[str, int]:
    """Words by rank: the built-in ones, then the ``most`` that most documents hold (runs of three
    letters a-z or more in lower case; ties by the word).

    All documents are counted; what comes to the driver is at most ``most`` words.
    """
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,}"), F.lit(0)))
    counts = docs.select(F.explode(words).alias("word")).filter(F.length("word") <= LONGEST_WORD).groupBy("word").count()
    ranks = dict(BUILT_IN)
    for row in counts.orderBy(F.desc("count"), "word").limit(most).collect():
        ranks.setdefault(row.word, len(ranks) + 1)
    return ranks


@lru_cache(maxsize=1)
def _judge(key: int) -> list[GuessCost]:
    """In a worker: what is remembered for one vocabulary."""
    return []


MEMORIES.append(_judge.cache_clear)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, kind's place, kind, end) of the base kinds, sorted by start, then kind as listed."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    found.sort()
    return [(start, end, KINDS[kind]) for start, kind, end in found]


def guessed_spans(text: str, base: list[tuple[int, int, str]], cost: GuessCost) -> list[tuple[int, int, str]]:
    """Costly values in credential contexts that no base span covers, each once."""
    if not HINTS.search(text):
        return []
    found = set()
    for pattern in CONTEXTS:
        for m in pattern.finditer(text):
            if cost(m[1]) >= MIN_LOG10_GUESSES:
                found.add((m.start(1), m.end(1)))
    starts = [start for start, _, _ in base]
    reach = list(accumulate((end for _, end, _ in base), max, initial=0))  # of the first so many base spans
    return sorted((a, b, GUESSED) for a, b in found if reach[bisect_right(starts, a)] < b)


def scan(docs: DataFrame, ranks: dict[str, int] | None = None) -> DataFrame:
    """``doc_id, base, spans, assign_log10`` for every row of docs.

    ``base`` and ``spans`` are arrays of structs (start, end, kind) in code points, end
    exclusive; ``spans`` adds the guessed ones in their places.  ``assign_log10`` holds the guess
    cost of each assigned value, in order.  ``ranks`` are the attacker's words (by default
    :func:`vocabulary` of docs).  Null and empty texts have none; repeated rows scan alike; a null
    id stays null; other columns are not read; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary(docs) if ranks is None else ranks)

    def rows(each: Iterator[tuple]) -> Iterator[tuple]:
        order = {k: i for i, k in enumerate((*KINDS, GUESSED))}
        judges = _judge(id(shared.value))
        if not judges:
            judges.append(GuessCost(shared.value))
        cost = judges[0]
        for doc_id, text in each:
            base = base_spans(text) if text else []
            more = guessed_spans(text, base, cost) if text else []
            both = sorted(base + more, key=lambda s: (s[0], order[s[2]]))
            values = [m for a, b, k in base if k == "assign" for m in [ASSIGN.match(text, a)]]
            costs = [round(cost(m[2]), 4) for m in values]
            yield doc_id, [dict(start=a, end=b, kind=k) for a, b, k in base], [dict(start=a, end=b, kind=k) for a, b, k in both], costs

    span = "array<struct<start:int,end:int,kind:string>>"
    return map_rows(docs.select("doc_id", "text"), rows, f"doc_id long, base {span}, spans {span}, assign_log10 array<double>")
