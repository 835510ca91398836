"""Byte-level BPE over Arrow batches with the tokenizers library.

A model of the library is built from a file of ranks: every byte has its character, and every way to make
a token from two others is a merge, in order of rank. A text is cut where a match of the pattern surely ends
(before white space), and each distinct piece is encoded once while it is remembered. Decoding reverses the
table of bytes; offsets are in code points, and a token that starts inside a character points to that
character.

Defined cases: a null text is an empty one, with no ids; repeated rows and null doc_ids come back as they
came; an empty table gives no rows; other columns are ignored. Strings of special tokens are ordinary text.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Callable
from functools import cache

import numpy as np
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession
from tokenizers import Regex, Tokenizer, models, pre_tokenizers

from .common import map_batches, table, texts_of

MULTI = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
#: Units and matches that a worker remembers, twice: in those of now and those before.
UNITS, MATCHES = 400_000, 400_000


class Remembered(dict):
    """A dict of bounded size that makes what it lacks; what is in use survives when it starts anew."""

    def __init__(self, make: Callable[[str], bytes], most: int) -> None:
        super().__init__()
        self.make, self.most, self.before = make, most, {}

    def __missing__(self, key: str) -> bytes:
        if len(self) >= self.most:
            self.before = dict(self)
            self.clear()
        found = self.before.get(key)
        found = self[key] = self.make(key) if found is None else found
        return found


@cache
def characters() -> dict[int, str]:
    """The character of each byte: printable ones stand for themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(others)}


def spell(raw: bytes) -> str:
    return raw.decode("latin-1").translate(characters())


def model_ids(model: models.BPE, match: str) -> bytes:
    """Little-endian unsigned 32-bit ids of one match of the pattern."""
    spelt = match if match.isascii() and match.isalpha() else spell(match.encode())
    return array("I", [t.id for t in model.tokenize(spelt)]).tobytes()


class Codec:
    """Encodes texts to ids (little-endian unsigned 32-bit) and decodes them."""

    #: White space that a cut may precede, and the white space that the pattern knows besides.
    UNITS = re.compile(r"[ \t\n\r\x0b\x0c]*[^ \t\n\r\x0b\x0c]+|[ \t\n\r\x0b\x0c]+")
    ODD_SPACE = re.compile("[\x1c-\x1f\x85\xa0  -     　]")
    #: Characters on which all engines agree.
    LATIN = re.compile("[\t\n -~¡-ÿ]+")

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        vocab = {spell(t): k for t, k in self.ranks.items()}
        merges = [(spell(t[:i]), spell(t[i:])) for t, _ in sorted(self.ranks.items(), key=lambda x: x[1]) for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks]
        self.model = models.BPE(vocab, merges, ignore_merges=True)
        self.whole = Tokenizer(self.model)
        self.whole.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(public_tokenizers.PATTERN), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.matches = regex.compile(public_tokenizers.PATTERN).findall
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for t, k in self.ranks.items():
            self.tokens[k] = t
        self.matched = Remembered(lambda m: model_ids(self.model, m), MATCHES)
        self.units = Remembered(self.unit, UNITS)

    def unit(self, unit: str) -> bytes:
        if self.LATIN.fullmatch(unit):
            if unit[1:].isalpha() and (unit[0] == " " or unit.isalpha()):
                return self.matched[unit]
            return b"".join(map(self.matched.__getitem__, self.matches(unit)))
        return np.array(self.whole.encode(unit, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        if self.ODD_SPACE.search(text):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(self.units.__getitem__, self.UNITS.findall(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def offsets(self, ids: bytes) -> np.ndarray:
        """The code point in which each token starts."""
        found = np.frombuffer(ids, "<u4")
        starts = np.cumsum([0, *(len(self.tokens[i]) for i in found.tolist())])[:-1]
        raw = np.frombuffer(self.decode(ids), np.uint8)
        return np.cumsum((raw & 0xC0) != 0x80)[starts] - 1 if len(raw) else starts


@cache
def codec(path: str) -> Codec:
    return Codec(path)


def encode(docs: DataFrame, path: str = MULTI, offsets: bool = False) -> DataFrame:
    """doc_id, ids and, where asked for, the code point in which each token starts; no shuffle."""

    def work(batches):
        own = codec(path)
        for batch in batches:
            ids = [own.encode(t) for t in batch.column("text").to_pylist()]
            columns = {"doc_id": batch.column("doc_id"), "ids": [np.frombuffer(x, "<u4").astype(np.int32) for x in ids]}
            yield columns | ({"starts": [own.offsets(x) for x in ids]} if offsets else {})

    return map_batches(texts_of(docs), work, "doc_id long, ids array<int>" + ", starts array<long>" * offsets)


def decode(encoded: DataFrame, path: str = MULTI) -> DataFrame:
    """doc_id and raw, the bytes of ids; a token that is part of a character gives its bytes as they are."""

    def work(batches):
        own = codec(path)
        for batch in batches:
            yield {"doc_id": batch.column("doc_id"), "raw": [own.decode(np.array(x or [], "<u4").tobytes()) for x in batch.column("ids").to_pylist()]}

    return map_batches(encoded.select("doc_id", "ids"), work, "doc_id long, raw binary")


def digests(docs: DataFrame, path: str = MULTI) -> DataFrame:
    """Digests of each text's ids and of what they decode to, made in one pass; no shuffle."""

    def work(batches):
        own = codec(path)
        for batch in batches:
            ids = [own.encode(t) for t in batch.column("text").to_pylist()]
            yield {
                "doc_id": batch.column("doc_id"), "n_tokens": [len(x) // 4 for x in ids],
                "ids_sha256": [hashlib.sha256(x).hexdigest() for x in ids], "decoded_sha256": [hashlib.sha256(own.decode(x)).hexdigest() for x in ids],
            }

    return map_batches(texts_of(docs), work, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))


QUERIES = {"op7_byte_bpe": op7_byte_bpe}
ORACLE_SQL: dict[str, str] = {}
