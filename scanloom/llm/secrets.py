"""Secrets in whole texts: fixed patterns, and a guess-cost estimate of values in credential contexts.

The cost of a value is the cheapest way to cut it into dictionary words, dates, repeats, runs of
neighbouring keys, counting sequences and brute-force stretches (dynamic programming over positions;
every stretch costs the logarithm of the guesses it takes). A value that takes many guesses is a secret,
a word with a year behind it is not. A value that opens with a quote goes on to the matching quote of its line,
any other to the next white space (less separators and unpaired closing signs at its end). Null and empty texts have no spans; overlapping spans of different
kinds are all kept, in the order of start and kind, but for a guess whose whole value lies in an assign span; repeated rows give repeated results.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from scanloom.llm import texts

# Fixed patterns of the contract.
ASSIGN = re.compile(r'''(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)''', re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
#: Credential contexts: more key names, whatever stands before them, and a whole value in quotes or up to white space.
CONTEXT = re.compile(
    r'''(?:passphrase|password|passwd|passcode|pwd|secret|token|credentials?|api[_-]?key|access[_-]?key|private[_-]?key|auth[_-]?key)'''
    r'''["']?\x20*(?::=|=>|[:=])\x20*(?:"((?:[^"\\\n]|\\.)*)"|'((?:[^'\\\n]|\\.)*)'|["']?(\S+))''', re.IGNORECASE | re.ASCII)
KINDS = ("assign", "access", "hex", "guess")
#: A context value is reported from so many guesses (powers of ten) and characters on.
LOG_GUESSES = 10.0
LEAST_CHARS = 8

#: Very common words of passwords and of place-holder values, most common first; the rank is the number of guesses.
COMMON = (
    "password passwd pass word admin administrator root user username login guest test testing tester default welcome hello "
    "changeme change example sample demo dummy secret token key apikey letmein qwerty monkey dragon master shadow sunshine "
    "princess football baseball superman batman iloveyou love trustno access system server service client public private "
    "internal external local localhost database mysql postgres redis docker cloud github gitlab config null none true false "
    "undefined string value your enter here some insert replace todo fixme summer winter spring autumn monday friday january "
    "december house computer internet company office work home family money lucky happy money star black white green blue red "
    "orange yellow silver gold tiger eagle lion apple cookie pepper ginger coffee magic ninja hunter killer freedom whatever "
    "the and for you with not that this from have are was one two three four five six seven eight nine ten"
).split()
RANK = {w: i + 2 for i, w in reversed(list(enumerate(COMMON)))}
LONGEST_WORD = max(map(len, COMMON))
ROWS = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
LEET = str.maketrans("430157$@!", "aeoistsai")
DATES = tuple(re.compile(f"(?=({p}))") for p in (
    r"(?:19|20)\d\d[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:0[1-9]|[12]\d|3[01])", r"(?:0[1-9]|[12]\d|3[01])[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:19|20)\d\d", r"(?:19|20)\d\d"))
LEAST_RUN = 3
LONGEST_UNIT = 8


def neighbours() -> dict[str, set[str]]:
    """Keys that touch on a staggered keyboard."""
    near: dict[str, set[str]] = {}
    for r, row in enumerate(ROWS):
        for c, key in enumerate(row):
            around = {row[c + d] for d in (-1, 1) if 0 <= c + d < len(row)}
            for other, shifts in ((r - 1, (0, 1)), (r + 1, (-1, 0))):
                if 0 <= other < len(ROWS):
                    around |= {ROWS[other][c + d] for d in shifts if 0 <= c + d < len(ROWS[other])}
            near[key] = around
    return near


NEAR = neighbours()


def _case_cost(word: str) -> float:
    upper = sum(ch.isupper() for ch in word)
    if not upper:
        return 0.0
    if word[:1].isupper() and upper == 1 or upper == len(word):
        return math.log10(2)
    return math.log10(math.comb(len(word), min(upper, len(word) - upper)) + 1)


def _runs(low: str) -> Iterator[tuple[int, int]]:
    """Maximal keyboard walks and counting sequences of three characters or more."""
    for tests in (lambda a, b: b in NEAR.get(a, ()), lambda a, b: ord(b) - ord(a) == 1, lambda a, b: ord(b) - ord(a) == -1):
        start = 0
        for i in range(1, len(low) + 1):
            if i == len(low) or not tests(low[i - 1], low[i]):
                if i - start >= LEAST_RUN:
                    yield start, i
                start = i


def _repeats(value: str) -> Iterator[tuple[int, int, int]]:
    """Maximal stretches with a period of up to ``LONGEST_UNIT`` characters and at least two periods: start, end, period."""
    for unit in range(1, LONGEST_UNIT + 1):
        start = 0
        for i in range(unit, len(value) + 1):
            if i == len(value) or value[i] != value[i - unit]:
                if i - start >= max(2 * unit, 3):
                    yield start, i, unit
                start = i - unit + 1


def run_cost(length: int) -> float:
    return 1.7 + 0.15 * (length - LEAST_RUN)


def repeat_cost(length: int, unit: int) -> float:
    return math.log10(length / unit + 1)


class _RepeatStarts:
    """Cheapest start of a repeat that ends at the growing place ``e``.

    The cost of a repeat is concave in its length, so of two starts the earlier one only gains on the later one: once
    it is as cheap, the later one can go. The candidates stand in a stack, the cheapest on top, each with the place
    from which the one below it is as cheap.
    """

    def __init__(self, unit: int):
        self.unit, self.stack = unit, []  # (start, cost of what comes before it and of its first period, overtaken at)

    def _at(self, item: tuple[int, float, float], e: int) -> float:
        return item[1] + repeat_cost(e - item[0], self.unit)

    def _overtaken(self, lower: tuple[int, float, float], start: int, before: float) -> float:
        if (gap := before - lower[1]) <= 0 or gap > 300 or (k := 10 ** gap) <= 1:
            return math.inf if gap <= 0 else -math.inf if gap > 300 else math.inf
        return (k * (start - self.unit) + self.unit - lower[0]) / (k - 1)

    def _settle(self, e: int) -> None:
        while len(self.stack) > 1 and (self.stack[-1][2] <= e or self._at(self.stack[-2], e) <= self._at(self.stack[-1], e)):
            self.stack.pop()

    def add(self, start: int, before: float, e: int) -> None:
        self._settle(e)
        if self.stack and self._at(self.stack[-1], e) <= before + repeat_cost(e - start, self.unit):
            return
        when = math.inf
        while self.stack:
            when = self._overtaken(self.stack[-1], start, before)
            if len(self.stack) > 1 and self.stack[-1][2] <= when:  # the one below passes it before it is ever cheapest again
                self.stack.pop()
            else:
                break
        self.stack.append((start, before, when))

    def best(self, e: int) -> float:
        self._settle(e)
        return self._at(self.stack[-1], e)


def alphabet(value: str) -> int:
    """Size of the character classes that a value uses."""
    sizes = ((26, str.islower), (26, str.isupper), (10, str.isdigit))
    used = sum(n for n, has in sizes if any(map(has, value)))
    return max(2, used + (33 if any(not ch.isalnum() for ch in value) else 0) if not _hexadecimal(value) else 16)


def _hexadecimal(value: str) -> bool:
    return len(value) >= 8 and all(ch in "0123456789abcdef" for ch in value) and any(ch.isdigit() for ch in value)


def dates(value: str) -> Iterator[tuple[int, int]]:
    """Every stretch that is a date or a year, overlapping ones too."""
    for pattern in DATES:
        for m in pattern.finditer(value):
            yield m.start(1), m.end(1)


def date_cost(length: int) -> float:
    return 2.1 if length == 4 else 4.6


def word_cost(word: str) -> float | None:
    """Cost of a dictionary word, plainly or in look-alike characters; None for any other stretch."""
    rank, leet = RANK.get(word.lower()), 0.0
    if rank is None:
        rank, leet = RANK.get(word.lower().translate(LEET)), 0.5
    return None if rank is None else math.log10(rank) + leet + _case_cost(word) + 0.3


def log_guesses(value: str) -> float:
    """Power of ten of the guesses that the cheapest segmentation takes (0 for the empty value).

    Segments: one brute-force character; a word; a date; any three or more characters of a run; any two or more periods
    of a repeat, whose first period is segmented as well. It is the minimum over all of them. Works in time
    proportional to the value's length, so whole values are judged however long they are.
    """
    if not value:
        return 0.0
    n, low = len(value), value.lower()
    if len(low) != n:  # letters that lower-case to several characters stay as they are
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in value)
    char = math.log10(alphabet(value))
    ends: dict[int, list[int]] = {}
    for start, end in dates(value):
        ends.setdefault(end, []).append(start)
    # runs and repeats by the place where their first possible end lies
    runs = sorted(_runs(low), reverse=True)
    repeats = sorted(_repeats(value), key=lambda r: r[0] + max(2 * r[2], 3), reverse=True)
    open_runs: list[list] = []  # [start, end, least cost of what comes before a start, less its place]
    open_repeats: list[tuple[int, int, int, _RepeatStarts]] = []
    step = run_cost(LEAST_RUN + 1) - run_cost(LEAST_RUN)
    best = [0.0] * (n + 1)
    for e in range(1, n + 1):
        cost = best[e - 1] + char
        for s in range(max(0, e - LONGEST_WORD), e - 2):
            word = word_cost(value[s:e])
            if word is not None:
                cost = min(cost, best[s] + word)
        for s in ends.get(e, ()):
            cost = min(cost, best[s] + date_cost(e - s))
        while runs and runs[-1][0] + LEAST_RUN <= e:
            open_runs.append([*runs.pop(), math.inf])
        while repeats and repeats[-1][0] + max(2 * repeats[-1][2], 3) <= e:
            start, end, unit = repeats.pop()
            open_repeats.append((start, end, unit, _RepeatStarts(unit)))
        open_runs = [r for r in open_runs if r[1] >= e]
        for r in open_runs:
            s = e - LEAST_RUN
            r[2] = min(r[2], best[s] - step * s)
            cost = min(cost, r[2] + run_cost(LEAST_RUN) + step * s)
        open_repeats = [r for r in open_repeats if r[1] >= e]
        for _, _, unit, starts in open_repeats:
            s = e - max(2 * unit, 3)
            starts.add(s, best[s + unit], e)
            cost = min(cost, starts.best(e))
        best[e] = cost
    return best[n]


OPENS = {")": "(", "]": "[", "}": "{", ">": "<"}


def _trimmed(value: str) -> str:
    """A bare value without separators, unpaired closing brackets and unpaired quotes at its end."""
    count, end = {c: value.count(c) for c in "()[]{}<>\"'"}, len(value)
    while end:
        c = value[end - 1]
        if not (c in ".,;" or c in OPENS and count[c] > count[OPENS[c]] or c in "\"'" and count[c] % 2):
            break
        if c in count:
            count[c] -= 1
        end -= 1
    return value[:end]


def find(text: str) -> list[tuple[int, int, str, float | None]]:
    """Spans of a text by start and kind: start, end, kind, log10 guesses of a credential value."""
    found: list[tuple[int, int, str, float | None]] = []
    taken: list[tuple[int, int]] = []
    if ":" in text or "=" in text:
        for m in ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= 8:
                found.append((m.start(), m.end(), "assign", log_guesses(m[2])))
                taken.append((m.start(2), m.end(2)))
        for m in CONTEXT.finditer(text):
            value = m[m.lastindex] if m.lastindex < 3 else _trimmed(m[3])
            start, end = m.start(m.lastindex), m.start(m.lastindex) + len(value)
            k = bisect.bisect_right(taken, start, key=lambda t: t[0]) - 1  # a base span that holds the whole value says enough
            if len(value) >= LEAST_CHARS and not (k >= 0 and taken[k][1] >= end) and (cost := log_guesses(value)) >= LOG_GUESSES:
                found.append((start, end, "guess", cost))
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access", None) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), m.end(), "hex", None) for m in HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, secrets (array of start, end, kind, log10_guesses; code points, end exclusive) of every row."""
    item = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("log10_guesses", pa.float64())])

    def run(batches):
        for part in texts.slices(batches):
            rows = [[dict(zip(("start", "end", "kind", "log10_guesses"), s)) for s in find(t)] for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(rows, pa.list_(item))], ["doc_id", "secrets"])

    return texts.id_text(docs).mapInArrow(run, "doc_id long, secrets array<struct<start:long,end:long,kind:string,log10_guesses:double>>")


def listed(spans: list[tuple]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind, *_ in spans)


def sha_of(spans: list[tuple]) -> str:
    return hashlib.sha256(listed([s for s in spans if s[2] != "guess"]).encode()).hexdigest()
