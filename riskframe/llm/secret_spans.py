"""Secrets in texts: fixed patterns, and values too costly to guess next to credential words."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect
from itertools import accumulate

from pyspark.sql import DataFrame

from riskframe.llm.common import map_texts
from riskframe.llm.guesses import COMMON, Ranks, log_guesses, with_vocabulary

KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
    re.IGNORECASE | re.ASCII,
)
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: The greedy runs of the contract with their least length inside the pattern:
#: a run that is too short has no long enough part either.
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
CONTEXT_WORDS = (
    "password", "passwd", "passphrase", "passcode", "pwd", "secret", "token", "apikey", "api_key", "api-key",
    "access_key", "access-key", "private_key", "private-key", "credential", "bearer", "authorization",
)
CONTEXT = re.compile(
    r"(?<![A-Za-z0-9])(?:[A-Za-z0-9]+[_-])?(?:" + "|".join(CONTEXT_WORDS) + r")s?[\"']?"
    r"(?:[\x20\t]{0,8}(?:=>|[:=])[\x20\t]{0,8}|[\x20\t]{1,8}is[\x20\t]{1,8}|[\x20\t]{1,8}(?=[A-Za-z]*[0-9]))"
    r"[\"']?([^\s\"'<>,;]{6,})",
    re.IGNORECASE | re.ASCII,
)
#: log10 guesses from which a value next to a credential word counts as a secret.
COSTLY = 9.0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the fixed patterns, leftmost and non-overlapping per kind."""
    found = []
    lowered = text.lower()
    if any(word in lowered for word in ASSIGN_WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return found


def guessed_spans(
    text: str, base: list[tuple[int, int, int]], costly: float = COSTLY, ranks: Ranks = COMMON
) -> list[tuple[int, int, int]]:
    """Values in a credential context that cost at least ``10 ** costly`` guesses and lie whole in no base span."""
    lowered = text.lower()
    if not any(word in lowered for word in CONTEXT_WORDS):
        return []
    taken = sorted((start, end) for start, _, end in base)
    reach = list(accumulate((end for _, end in taken), max))
    found = []
    for m in CONTEXT.finditer(text):
        start, end = m.span(1)
        while end > start and text[end - 1] in ".:!?)]}":
            end -= 1
        before = bisect(taken, (start, len(text)))
        whole = before > 0 and reach[before - 1] >= end
        if end - start >= 6 and not whole:
            if log_guesses(text[start:end], ranks) >= costly:
                found.append((start, 3, end))
    return found


def written(spans: list[tuple[int, int, int]], kinds: tuple[str, ...]) -> str:
    """Spans as ``kind:start:end`` by start, then kind, joined by commas."""
    return ",".join(f"{kinds[kind]}:{start}:{end}" for start, kind, end in sorted(spans))


def secret_spans(
    docs: DataFrame, key: str = "doc_id", text: str = "text", costly: float = COSTLY, vocabulary: str | None = None
) -> DataFrame:
    """Secrets of each whole text, one row per document.

    ``vocabulary`` is the path of a byte-level BPE file whose words join the fixed
    ones, ranked by their ids; every executor reads it at that path.

    Returns the key, n_assign, n_access, n_hex, base_sha256 (of the base spans as
    text) and spans (base and guess-cost spans). Positions are code points, ends
    exclusive. Null and empty texts have no spans: zeros, the digest of the empty
    string and an empty string. Repeated rows and null keys are kept; other
    columns are ignored.
    """

    def make():
        ranks = with_vocabulary(vocabulary) if vocabulary else COMMON

        def kernel(texts: list) -> tuple:
            out = []
            for value in texts:
                value = value or ""
                base = base_spans(value)
                count = [sum(kind == k for _, kind, _ in base) for k in range(3)]
                digest = hashlib.sha256(written(base, KINDS).encode()).hexdigest()
                out.append((*count, digest, written(base + guessed_spans(value, base, costly, ranks), KINDS)))
            return None, list(zip(*out))

        return kernel

    return map_texts(
        docs, key, text, "n_assign long, n_access long, n_hex long, base_sha256 string, spans string", make
    )
