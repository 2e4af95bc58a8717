"""How many guesses a value takes: cheapest segmentation by dynamic programming."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterable
from functools import lru_cache

import numpy as np

#: Common passwords and words inside them, most common first.
WORDS = """password 123456 qwerty admin welcome letmein login monkey dragon master sunshine princess
football baseball iloveyou shadow superman batman trustno1 hello freedom whatever secret test user
guest root default changeme example sample demo temp access server database service system public
private token key value string none null true false empty required optional your here insert replace
enter username account email phone name pass code dev prod stage local config file path home work
summer winter spring autumn monday friday january love money angel flower orange apple banana coffee
secure security safe strong weak new old reset forgot hidden disabled enabled unknown invalid
env process environ getenv settings vault manager""".split()
#: Keyboard rows and the usual character swaps.
ROWS = ["1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm", "abcdefghijklmnopqrstuvwxyz"]
SWAPS = str.maketrans("@4301!$57", "aaeoiisst")
NEXT = {a + b for row in ROWS for a, b in zip(row, row[1:])}
BEFORE = {b + a for a, b in (tuple(pair) for pair in NEXT)}
YEAR = re.compile(r"(?=((?:19|20)[0-9]{2}))")
_DAY = (
    r"(?:(?:19|20)[0-9]{2}(?P<a>[-/.]?)(?:0[1-9]|1[0-2])(?P=a)(?:0[1-9]|[12][0-9]|3[01])"
    r"|(?:0[1-9]|[12][0-9]|3[01])(?P<b>[-/.]?)(?:0[1-9]|1[0-2])(?P=b)(?:19|20)[0-9]{2})"
)
DATE = re.compile(f"(?=({_DAY}))")
STAMP = re.compile(f"(?=({_DAY}[T_-]?(?:[01][0-9]|2[0-3]):?[0-5][0-9](?::?[0-5][0-9])?Z?))")
#: log10 guesses of a year, a date and a date with its time, which counts by minutes.
DATED = ((YEAR, math.log10(120)), (DATE, math.log10(366 * 120)), (STAMP, math.log10(366 * 120 * 1440)))
PROSE = re.compile(r"[a-z]{4,}", re.ASCII)
#: log10 guesses of one brute-force character by class, and of each further segment.
LETTER, DIGIT, SIGN, OTHER, SEGMENT = math.log10(26), 1.0, math.log10(33), 2.0, 0.3
#: Signs that join words, and log10 guesses of one between two letters or digits.
JOINS, JOIN = "-_./:", math.log10(5)
#: log10 guesses of one letter of text that reads like prose (about two bits).
READABLE = 0.6
#: Longest block whose repeats are sought inside a value; a whole value of repeats has no limit.
BLOCK = 32


class Ranks:
    """Rank of each word over ranked lists: its best place in any of them."""

    def __init__(self, *lists: Iterable[str]):
        self.of: dict[str, int] = {}
        for words in lists:
            for rank, word in enumerate(words, 1):
                self.of[word] = min(rank, self.of.get(word, rank))
        self.longest = max(map(len, self.of), default=0)


COMMON = Ranks(WORDS)


@lru_cache(maxsize=2)
def with_vocabulary(path: str) -> Ranks:
    """The fixed words and those of a byte-level BPE file: its ids follow the frequency of words."""
    with open(path, encoding="utf-8") as file:
        ids = json.load(file)["model"]["vocab"]
    whole = re.compile("\u0120[a-z]{3,}")  # the letter that stands for a space before a word
    return Ranks(WORDS, [token[1:] for token in sorted(ids, key=ids.get) if whole.fullmatch(token)])


def _single(value: str, i: int) -> float:
    char = value[i]
    if not char.isascii():
        return OTHER
    if char in JOINS and 0 < i < len(value) - 1 and value[i - 1].isalnum() and value[i + 1].isalnum():
        return JOIN
    return DIGIT if char.isdigit() else LETTER if char.isalpha() else SIGN


def _repeats(value: str):
    """(start, block length, number of blocks) of the repeats of short blocks, from every start."""
    codes = np.frombuffer(value.encode("utf-32-le", "surrogatepass"), "<u4")
    for size in range(1, min(BLOCK, len(value) // 2) + 1):
        equal = codes[:-size] == codes[size:]
        stops = np.append(np.flatnonzero(~equal), len(equal))
        at = np.flatnonzero(equal)
        blocks = 1 + (stops[np.searchsorted(stops, at)] - at) // size
        long = blocks >= (3 if size == 1 else 2)
        for start, number in zip(at[long].tolist(), blocks[long].tolist()):
            yield start, size, number


def log_guesses(value: str, ranks: Ranks = COMMON, known: dict[str, float] | None = None) -> float:
    """log10 of the guesses for ``value``; 0 for an empty one.

    The cheapest way to split it into dictionary words (also with capitals and
    swapped characters), years, dates and date times, repeated blocks, keyboard or
    alphabet walks, readable letter runs and brute-force characters. Linear in the
    length. ``known`` remembers the cost of blocks.
    """
    known = {} if known is None else known
    n, low = len(value), value.lower()
    if len(low) != n:  # a few letters change length when lowered
        low = value
    plain = low.translate(SWAPS)
    spans: list[list[tuple[int, float]]] = [[] for _ in range(n)]
    for pattern, cost in DATED:
        for m in pattern.finditer(value):
            spans[m.start()].append((m.end(1), cost))
    for m in PROSE.finditer(low):
        vowels = 0
        for i in range(m.end() - 1, m.start() - 1, -1):
            vowels += low[i] in "aeiouy"
            size = m.end() - i
            if size >= 4 and vowels >= 0.2 * size:
                spans[i].append((m.end(), READABLE * size))

    def block_cost(block: str) -> float:
        if block not in known:
            known[block] = log_guesses(block, ranks, known)
        return known[block]

    for i, size, number in _repeats(value):
        spans[i].append((i + size * number, block_cost(value[i : i + size]) + math.log10(number)))
    for steps in (NEXT, BEFORE):  # walks
        end = n
        for i in range(n - 1, -1, -1):
            if low[i : i + 2] not in steps:
                end = i + 1
            if end - i >= 3:
                spans[i].append((end, math.log10(40 * (end - i))))
    best = [0.0] + [math.inf] * n
    for i in range(n):
        here = best[i]
        step = here + _single(value, i)  # a brute-force run pays per character
        if step < best[i + 1]:
            best[i + 1] = step
        for end, cost in spans[i]:
            if here + cost + SEGMENT < best[end]:
                best[end] = here + cost + SEGMENT
        for size in range(3, min(ranks.longest, n - i) + 1):
            rank = min(ranks.of.get(plain[i : i + size], math.inf), ranks.of.get(low[i : i + size], math.inf))
            if rank < math.inf:
                piece = value[i : i + size]
                cost = math.log10(rank + 1) + SEGMENT * (piece != low[i : i + size]) + SEGMENT * (
                    plain[i : i + size] != low[i : i + size]
                )
                if here + cost + SEGMENT < best[i + size]:
                    best[i + size] = here + cost + SEGMENT
    size = (value + value).find(value, 1) if n > 2 * BLOCK else n
    if size < n:  # one long block over and over
        return min(best[n], block_cost(value[:size]) + math.log10(n // size) + SEGMENT)
    return best[n]
