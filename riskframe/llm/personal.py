"""Personal data in texts: fixed patterns, and spans found by weakly supervised labelers."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, functions as F

from riskframe.llm.common import map_texts, text_function
from riskframe.session import small_batches

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "name", "ssn", "iban", "birth", "tel")
LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
# A run of digits is tried once, from its start: a later start gives the same end.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping addresses, one try per at-sign, in linear time."""
    found, floor = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            found.append((start, m.end()))
            floor = m.end()
        else:
            floor = at + 1
        at = text.find("@", max(at + 1, floor))
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, char in enumerate(reversed(digits)):
        d = ord(char) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the fixed patterns."""
    found = [(start, 0, end) for start, end in emails(text)]
    if not DIGIT.search(text):
        return found
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m.group().split(".")):
            found.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(DIGIT.findall(m.group())) <= 15:
                found.append((m.start(), 3, m.end()))
    return found


#: Gazetteers and context words of the labelers.
FIRST_NAMES = frozenset(
    """James John Robert Michael William David Richard Joseph Thomas Charles Mary Patricia Jennifer Linda
    Elizabeth Barbara Susan Jessica Sarah Karen Anna Maria Peter Hans Klaus Jürgen Stefan Andreas Monika
    Sabine Ursula Petra Jean Pierre Michel Marie Jacques Claire Sophie Luc José Juan Carlos Luis Ana
    Carmen Pedro Pablo Lucía Elena Emma Paul Laura Alice Bob Daniel Martin""".split()
)
NOT_NAMES = frozenset("The A An And Of In To It Is For On As By Der Die Das Und Le La Les El Los Las Un Une".split())
#: Capitalised words that stand after the name context words without being names.
ROLES = frozenset(
    """All Board Center Centre Colleague Colleagues Committee Company Customer Customers Department Desk Director
    Editor Editors Email Everyone Form Friend Friends Guest Guests Help Here Information Kunde Kunden Ladies
    Madam Management Manager Member Members Office Our Page Parents Press Reader Readers Sales Secretary Service
    Services Sir Sirs Staff Street Support Team University Us User Users We You Your""".split()
)
CONTEXT = {
    "phone": re.compile(r"\b(?:tel|telephone|phone|call|mobile|fax|telefon|téléphone|teléfono|llame|appelez)\b", re.I),
    "card": re.compile(r"\b(?:card|visa|mastercard|credit|payment|karte|carte|tarjeta)\b", re.I),
    "name": re.compile(r"\b(?:name|signed|contact|author|dear|regards|name ist|m'appelle|llamo)\b", re.I),
    "ssn": re.compile(r"\b(?:ssn|social|security|tax|taxpayer)\b", re.I),
    "iban": re.compile(r"\b(?:iban|account|bank|konto|compte|cuenta|transfer)\b", re.I),
    "birth": re.compile(r"\b(?:born|birth|birthday|dob|geboren|geburtsdatum|né|née|naissance|nacido|nacimiento)\b", re.I),
}
CONTEXT["tel"] = CONTEXT["phone"]
AGAINST = re.compile(
    r"\b(?:order|invoice|version|isbn|item|price|total|page|chapter|figure|table|doi|issue|section|part)\b", re.I
)
CANDIDATES = {
    # these two also stand where the fixed patterns ran on into more digits and failed
    "phone": re.compile(r"(?<![0-9])(\+[0-9]{1,3}[\x20.-]?\(?[0-9]{2,4}\)?[\x20.-]?[0-9]{3,4}[\x20.-]?[0-9]{4})(?![0-9])"),
    "card": re.compile(r"(?<![0-9])([0-9]{4}([\x20-]?)[0-9]{4}\2[0-9]{4}\2[0-9]{4})(?![0-9])"),
    "name": re.compile(
        r"(?:\b(?:Mrs?|Ms|Dr|Prof|Herr|Frau|Mme|Sra?|Señora?)\.?\x20|"
        r"\b(?:[Mm]y name is|[Ii]ch heiße|[Jj]e m'appelle|[Mm]e llamo)\x20)"
        r"([A-ZÄÖÜÉÁÍÓÚÑ][a-zäöüßéèêáíóúñ]+(?:\x20[A-ZÄÖÜÉÁÍÓÚÑ][a-zäöüßéèêáíóúñ]+){0,2})"
    ),
    "ssn": re.compile(r"(?<![0-9-])([0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9-])"),
    "iban": re.compile(r"\b([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?)\b"),
    "birth": re.compile(r"(?<![0-9])([0-9]{1,2}[./-][0-9]{1,2}[./-](?:19|20)[0-9]{2}|(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2})(?![0-9])"),
    "tel": re.compile(r"(?<![0-9+.-])(\(?[0-9]{2,5}\)?[\x20/-][0-9]{3,4}[\x20-][0-9]{3,5})(?![0-9])"),
}
#: A text without any of these has no titled name.
NAMED = ("Mr", "Ms", "Dr", "Prof", "Herr", "Frau", "Mme", "Sr", "Señor", "name is", "ch heiße", "m'appelle", "e llamo")
#: Runs of capitalised words, and the context words of a name right before one.
WORD = r"[A-ZÀ-ÖØ-Þ](?:['’][A-ZÀ-ÖØ-Þ])?[a-zß-öø-ÿ]++(?:[-'’]?[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]++)*+(?!\w)"
RUN = re.compile(rf"(?<![\w'’-]){WORD}(?:\x20(?:[A-Z]\.\x20)?{WORD})*+")
RUN_WORD = re.compile(rf"(?:[A-Z]\.\x20)?({WORD})")
LEAD_WORDS = ("name", "signed", "contact", "author", "dear", "regards", "m'appelle", "llamo")
LEAD = re.compile(
    rf"\b(?:{'|'.join(LEAD_WORDS)})(?:\x20(?:by|von|par|por|is|ist))?[\x20\t]*[:,;-]?\s{{0,4}}$", re.IGNORECASE
)
TITLES = frozenset("Mr Mrs Ms Dr Prof Herr Frau Mme Sr Sra Señor Señora".split())
#: Words of a name, and characters before a run that its context word lies in.
NAME_WORDS, LEAD_WINDOW = 3, 24
#: A labeler says 1 (personal), 0 (not) or -1 (abstains).
LABELERS = ("format", "validity", "gazetteer", "context", "against", "shape")
WINDOW = 48


def first_name(word: str) -> bool:
    """Whether a word, or its part before a hyphen, is in the gazetteer."""
    return word in FIRST_NAMES or word.split("-")[0] in FIRST_NAMES


def name_spans(text: str) -> list[tuple[int, int]]:
    """Spans that any labeler of names proposes, by start, none touching another: names
    after a title, and capitalised runs from a gazetteer name or after a context word."""
    titled = []
    if any(word in text for word in NAMED):
        titled = [m.span(1) for m in CANDIDATES["name"].finditer(text)]
    lowered = text.lower()
    led = any(word in lowered for word in LEAD_WORDS)
    found, k = [], 0
    for run in RUN.finditer(text):
        words = [(m.group(1), m.start(1), m.end(1)) for m in RUN_WORD.finditer(text, run.start(), run.end())]
        i = 0
        while i < len(words):
            word, start, _ = words[i]
            before = text[max(0, start - LEAD_WINDOW) : start]
            skipped = word in TITLES or word.lower() in LEAD_WORDS
            if skipped or not (first_name(word) or (led and LEAD.search(before))):
                i += 1
                continue
            # a context word or title belongs to the next name
            last = i
            while last + 1 < min(i + NAME_WORDS, len(words)):
                if words[last + 1][0] in TITLES or words[last + 1][0].lower() in LEAD_WORDS:
                    break
                last += 1
            end = words[last][2]
            i = last + 1
            while k < len(titled) and titled[k][1] <= start:
                k += 1
            if k == len(titled) or titled[k][0] >= end:
                found.append((start, end))
    return sorted(titled + found)


def _votes(kind: str, value: str, text: str, start: int, end: int) -> tuple[int, ...]:
    before, around = text[max(0, start - WINDOW) : start], text[max(0, start - WINDOW) : end + WINDOW // 2]
    digits = DIGIT.findall(value)
    strict, valid, listed = -1, -1, -1
    if kind == "name":
        words = value.split(" ")
        plain = any(w in NOT_NAMES or w in ROLES for w in words)
        strict = 0 if plain else 1 if len(words) >= 2 else -1
        valid = 0 if plain else -1
        listed = 1 if first_name(words[0]) else -1
    elif kind == "ssn":
        area, group, serial = value.split("-")
        strict = 1
        valid = int(area not in ("000", "666") and area < "900" and group != "00" and serial != "0000")
    elif kind == "iban":
        packed = value.replace(" ", "")
        moved = packed[4:] + packed[:4]
        strict = 1 if 15 <= len(packed) <= 34 else 0
        valid = int(int("".join(str(int(c, 36)) for c in moved)) % 97 == 1)
    elif kind == "birth":
        parts = [int(p) for p in re.split("[./-]", value)]
        year, rest = (parts[0], parts[1:]) if parts[0] > 1000 else (parts[2], parts[:2])
        valid = int(1900 <= year <= 2025 and all(1 <= p <= 31 for p in rest) and min(rest) <= 12)
    elif kind == "card":
        strict, valid = 1, int(luhn("".join(digits)))
    else:
        strict = 1 if value.startswith(("(", "+")) else -1
        valid = int(7 <= len(digits) <= 15)
    context = 1 if CONTEXT[kind].search(before) else -1
    against = 0 if AGAINST.search(around) else -1
    shape = 0 if digits and len(set(digits)) <= 2 else -1
    return strict, valid, listed, context, against, shape


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, str]]:
    """(start, kind number, end, pattern) of what the labelers judge; none touches a base span.

    The pattern is the kind, the votes and a length class: all the final
    classifier sees, so equal patterns get equal verdicts.
    """
    found = []
    numeric = DIGIT.search(text) is not None
    taken = sorted((start, end) for start, _, end in base)
    for kind, pattern in CANDIDATES.items():
        if kind != "name" and not numeric:
            continue
        k, mark = 0, len(found)
        for start, end in name_spans(text) if kind == "name" else (m.span(1) for m in pattern.finditer(text)):
            while k < len(taken) and taken[k][1] <= start:
                k += 1
            if k < len(taken) and taken[k][0] < end:
                continue
            votes = _votes(kind, text[start:end], text, start, end)
            size = 0 if end - start < 10 else 1 if end - start < 16 else 2
            found.append((start, KINDS.index(kind), end, f"{kind}|{','.join(map(str, votes))}|{size}"))
        if len(found) > mark:  # later kinds don't touch earlier ones
            taken = sorted(taken + [(start, end) for start, _, end, _ in found[mark:]])
    return found


def pattern_counts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(pattern, n) over all documents: at most a few thousand rows whatever the corpus."""

    def make():
        def kernel(texts: list) -> tuple:
            seen: dict[str, int] = {}
            for value in texts:
                for *_, pattern in candidates(value or "", base_spans(value or "")):
                    seen[pattern] = seen.get(pattern, 0) + 1
            # one row per distinct pattern of the call; its document doesn't matter
            return [0] * len(seen), [list(seen), list(seen.values())]

        return kernel

    counted = map_texts(docs, key, text, "pattern string, n long", make)
    return counted.groupBy("pattern").agg(F.sum("n").alias("n"))


def reliabilities(votes: np.ndarray, weight: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Posterior of being personal for each vote row, by expectation-maximisation.

    Each labeler has, per class, a distribution over (1, 0, abstain), smoothed by
    the belief that a vote is right eight times in ten.
    """
    prior, (rows, count) = 0.5, votes.shape
    value = np.where(votes == 1, 0, np.where(votes == 0, 1, 2))
    smooth = np.array([[8.0, 2.0, 10.0], [2.0, 8.0, 10.0]])
    table = np.repeat((smooth / smooth.sum(1, keepdims=True))[:, None, :], count, axis=1)
    posterior = np.full(rows, 0.5)
    for _ in range(rounds):
        logs = [
            np.log(p) + sum(np.log(table[c, j, value[:, j]]) for j in range(count))
            for c, p in ((0, prior), (1, 1 - prior))
        ]
        posterior = 1 / (1 + np.exp(np.clip(logs[1] - logs[0], -500, 500)))
        mass = (weight * posterior, weight * (1 - posterior))
        prior = float(np.clip(mass[0].sum() / max(weight.sum(), 1e-9), 0.02, 0.98))
        for c in range(2):
            for j in range(count):
                cells = np.array([mass[c][value[:, j] == v].sum() for v in range(3)]) + smooth[c]
                table[c, j] = cells / cells.sum()
    return posterior


def fit_logistic(x: np.ndarray, target: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weighted ridge logistic regression on soft targets, by Newton steps."""
    beta = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (weight * (target - p)) - ridge * beta
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(beta)), grad)
        beta = beta + step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def _features(patterns: list[str]) -> tuple[np.ndarray, np.ndarray]:
    votes, rows = [], []
    for pattern in patterns:
        kind, said, size = pattern.split("|")
        vote = [int(v) for v in said.split(",")]
        votes.append(vote)
        rows.append(
            [1.0, *(float(kind == k) for k in CANDIDATES), *(float(v == 1) - float(v == 0) for v in vote),
             float(size == "0"), float(size == "2")]
        )
    return np.array(votes), np.array(rows)


def fit_span_classifier(docs: DataFrame, key: str = "doc_id", text: str = "text") -> dict[str, bool]:
    """Verdict per pattern: labelers vote on all documents' candidates, EM weighs them,
    a logistic classifier is trained on the posteriors. No candidates: no verdicts."""
    with small_batches(docs.sparkSession):
        rows = pattern_counts(docs, key, text).collect()  # bounded by the number of patterns
    if not rows:
        return {}
    rows = sorted(rows, key=lambda r: r["pattern"])
    patterns = [r["pattern"] for r in rows]
    weight = np.array([float(r["n"]) for r in rows])
    votes, x = _features(patterns)
    posterior = reliabilities(votes, weight)
    # large corpora shall not drown the ridge: weights count relative to 10,000 spans
    scaled = weight * min(1.0, 10_000 / weight.sum())
    beta = fit_logistic(x, posterior, scaled)
    accepted = x @ beta >= 0
    return {p: bool(ok) for p, ok in zip(patterns, accepted)}


def all_spans(text: str, verdicts: dict[str, bool]) -> tuple[list, list]:
    base = base_spans(text)
    more = [(s, kind, e) for s, kind, e, pattern in candidates(text, base) if verdicts.get(pattern)]
    return base, more


def _written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in sorted(spans))


def personal_spans(
    docs: DataFrame, key: str = "doc_id", text: str = "text", verdicts: dict[str, bool] | None = None
) -> DataFrame:
    """Personal data of each whole text, one row per document.

    Returns the key, n_email, n_ip, n_card, n_phone, base_sha256 (of the base spans
    as text) and spans (base spans and those the classifier accepts). Positions are
    code points, ends exclusive. Null and empty texts have no spans; repeated rows
    and null keys are kept; other columns are ignored. Without ``verdicts`` the
    classifier is fitted on ``docs`` first.
    """
    verdicts = fit_span_classifier(docs, key, text) if verdicts is None else verdicts

    def make():
        def kernel(texts: list) -> tuple:
            out = []
            for value in texts:
                base, more = all_spans(value or "", verdicts)
                count = [sum(kind == k for _, kind, _ in base) for k in range(4)]
                digest = hashlib.sha256(_written(base).encode()).hexdigest()
                out.append((*count, digest, _written(base + more)))
            return None, list(zip(*out))

        return kernel

    schema = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    return map_texts(docs, key, text, schema, make)


def redactor(verdicts: dict[str, bool]) -> Callable:
    """Column function: the text with every span replaced by its kind in brackets; null stays null."""

    def redact(value: str | None) -> str | None:
        if not value:
            return value
        base, more = all_spans(value, verdicts)
        out, floor = [], 0
        for start, kind, end in sorted(base + more):
            if end <= floor:
                continue
            if start >= floor:
                out += [value[floor:start], f"[{KINDS[kind].upper()}]"]
            floor = end
        return "".join([*out, value[floor:]])

    return text_function("string", lambda: lambda texts: [redact(t) for t in texts])
