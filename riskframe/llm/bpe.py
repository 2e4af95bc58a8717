"""Byte-level BPE through a table of distinct words; decoding through a table of pieces."""

from __future__ import annotations

import hashlib
import json
import re

import numpy as np
from pyspark.sql import DataFrame, functions as F

from riskframe.llm.common import Workspace, map_texts

#: Bounds of the table of frequent words that is sent to every task.
HEAD_ROWS = 200_000
HEAD_BYTES = 16 << 20
#: Bytes of words and ids that a task remembers beyond that table before it starts afresh, some per entry besides.
CACHE_BYTES, PER_WORD = 16 << 20, 160
#: Texts whose words are split and looked up together, which bounds the lists of words.
TEXTS_AT_ONCE = 32
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
NEAR = re.compile(r"\s\s")
#: One space between two other characters: tokens never reach across its left side.
GAP = re.compile(r"(?<=\S) (?=\S)")


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary file: printable Latin-1
    letters stand for themselves, the others for the letters from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """A byte-level BPE file of the tokenizers library, merges in order of their ids."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, before = spec["model"], spec["pre_tokenizer"]
        plain = (
            before["type"] == "ByteLevel" and before["use_regex"] and not before["add_prefix_space"]
            and spec["normalizer"] is None and not model.get("ignore_merges") and not model.get("dropout")
            and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec["added_tokens"])
        )
        vocab = model["vocab"]
        merged = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        if not plain or merged != sorted(merged):
            raise ValueError(f"{path} is not a plain byte-level BPE file")
        letters = byte_letters()
        pieces = {bytes(letters[c] for c in token): i for token, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.pieces = np.array([b""] * (max([*pieces.values(), *self.special.values()]) + 1), dtype=object)
        for piece, i in pieces.items():
            self.pieces[i] = piece
        for text, i in self.special.items():
            self.pieces[i] = text.encode()
            pieces = {p: k for p, k in pieces.items() if k != i}
        self.spaced = np.array([p[:1] == b" " for p in self.pieces])
        self.coder = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=pieces, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.coder.encode_ordinary(text), np.uint32)

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(self.pieces[ids]).decode("utf-8", "replace")


class Encoder:
    """Encodes texts word by word; a word is encoded once and its ids kept.

    Ids are little-endian 32-bit strings, so a text's ids are its words' joined.
    """

    def __init__(self, path: str, head: dict[str, bytes] | None = None):
        self.vocabulary = Vocabulary(path)
        self.head = head or {}
        self.forget()
        marks = sorted(self.vocabulary.special, key=len, reverse=True)
        self.marks = re.compile("(" + "|".join(map(re.escape, marks)) + ")") if marks else None

    def forget(self) -> None:
        self.words = dict(self.head)  # ids of a word after a space
        self.held = 0  # bytes of those beyond the head

    def learn(self, words: list[str]) -> None:
        """Encode new words, many in one call: a token that starts with a space starts a word."""
        if self.held > CACHE_BYTES:
            self.forget()
        easy = [w for w in words if w and not w[0].isspace() and not w[-1].isspace() and " " not in w]
        if easy:
            ids = self.vocabulary.encode(" " + " ".join(easy))
            starts = np.flatnonzero(self.vocabulary.spaced[ids]) * 4
            raw = ids.tobytes()
            if len(starts) == len(easy):
                self.words.update(zip(easy, (raw[a:b] for a, b in zip(starts, [*starts[1:], len(raw)]))))
            else:
                words = [*words]  # never seen; each word on its own is always right
                easy = []
        known = set(easy)
        for word in words:
            if word not in known:
                self.words[word] = self.vocabulary.encode(" " + word).tobytes()
        self.held += sum(len(w) + len(self.words[w]) + PER_WORD for w in words)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text (null: none)."""
        out = []
        for start in range(0, len(texts), TEXTS_AT_ONCE):
            out += self._encode(texts[start : start + TEXTS_AT_ONCE])
        return out

    def _encode(self, texts: list[str | None]) -> list[bytes]:
        pieces, plan = [], []  # plan: literal bytes or a range of pieces, per text
        for text in texts:
            steps: list = []
            segments = [text or ""]
            if text and self.marks and any(mark in text for mark in self.vocabulary.special):
                segments = self.marks.split(text)
            for segment in segments:
                if not segment:
                    continue
                if segment in self.vocabulary.special:
                    steps.append(np.array([self.vocabulary.special[segment]], np.uint32).tobytes())
                    continue
                parts = GAP.split(segment) if NEAR.search(segment) else segment.split(" ")
                if parts[0]:
                    steps.append(self.vocabulary.encode(parts[0]).tobytes())
                steps.append((len(pieces), len(pieces) + len(parts) - 1))
                pieces += parts[1:]
            plan.append(steps)
        got = list(map(self.words.get, pieces))
        open_ = [i for i, ids in enumerate(got) if ids is None]
        if open_:
            self.learn(list({pieces[i] for i in open_}))
            look = self.words
            for i in open_:
                got[i] = look[pieces[i]]
        return [
            b"".join([b"".join(got[s[0] : s[1]]) if isinstance(s, tuple) else s for s in steps]) for steps in plan
        ]


def word_table(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """(word, n, ids) of the frequent words of all texts, each encoded once.

    Words are split and counted in Spark over whole texts. The table takes the
    count classes (powers of two) from the top as long as it stays within
    HEAD_ROWS and HEAD_BYTES, so it may be broadcast whatever the corpus.
    """
    space = Workspace(docs.sparkSession, "words")
    counted = space.settle(
        docs.select(F.explode(F.split(F.col(text).cast("string"), " ", -1)).alias("word"))
        .filter("word <> ''").groupBy("word").agg(F.count("*").alias("n")).filter("n > 1"),
        "counted",
    )
    level = F.floor(F.log2("n")).cast("int")
    sizes = counted.groupBy(level.alias("level")).agg(
        F.count("*").alias("rows"), F.sum(F.octet_length("word") + 32).alias("bytes")
    ).collect()
    least, rows, size = 64, 0, 0
    for row in sorted(sizes, key=lambda r: -r["level"]):
        rows, size = rows + row["rows"], size + row["bytes"]
        if rows > HEAD_ROWS or size > HEAD_BYTES:
            break
        least = row["level"]
    head = counted.filter(level >= least)

    def run(batches):
        import pyarrow as pa

        encoder = Encoder(path)
        for batch in batches:
            words = batch.column(0).to_pylist()
            encoder.forget()
            encoder.learn(words)
            ids = pa.array([encoder.words[w] for w in words], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), ids], names=["word", "n", "ids"])

    return head.mapInArrow(run, "word string, n long, ids binary")


def send_words(table: DataFrame):
    """The bounded word table as a broadcast dictionary."""
    return table.sparkSession.sparkContext.broadcast(
        {r["word"]: bytes(r["ids"]) for r in table.select("word", "ids").collect()}
    )


def encode_texts(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", words=None) -> DataFrame:
    """(key, ids array<int>) of each whole text; null and empty texts have no ids.

    ``words`` is a broadcast of :func:`send_words`; other words are encoded by the
    first task that meets them and kept there. Repeated rows and null keys stay.
    """

    def make():
        encoder = Encoder(path, words.value if words else None)
        return lambda texts: (None, [[np.frombuffer(b, np.int32) for b in encoder.encode(texts)]])

    return map_texts(docs, key, text, "ids array<int>", make)


def round_trip(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode every whole text, decode the ids again, and return counts and digests.

    Columns: the key, n_tokens, ids_sha256 (decimal ids joined by commas) and
    decoded_sha256 (the decoded text in UTF-8). Null and empty texts have no
    tokens and the digest of the empty string. Special tokens' strings in a text
    become their ids. Other columns are ignored; no rows give no rows.
    """
    words = send_words(word_table(docs, path, text))

    def make():
        encoder = Encoder(path, words.value)
        vocabulary = encoder.vocabulary
        decimal = np.array([str(i).encode() for i in range(len(vocabulary.pieces))], dtype=object)

        def kernel(texts: list) -> tuple:
            count, coded, decoded = [], [], []
            for raw in encoder.encode(texts):
                ids = np.frombuffer(raw, np.uint32)
                count.append(len(ids))
                coded.append(hashlib.sha256(b",".join(decimal[ids])).hexdigest())
                decoded.append(hashlib.sha256(vocabulary.decode(ids).encode()).hexdigest())
            return None, [count, coded, decoded]

        return kernel

    return map_texts(docs, key, text, "n_tokens long, ids_sha256 string, decoded_sha256 string", make)
