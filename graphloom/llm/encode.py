"""Encoding of texts with a public byte-level BPE vocabulary.

The vocabulary file is serialised directly as a sentencepiece BPE model: byte-mapped pieces,
scored by negative rank, with identity normalisation.  Texts are cut into pre-tokens, each
pre-token is encoded by the model, and decoding is the inverse mapping.
"""

from __future__ import annotations

import base64
import functools
import itertools
import os
import re
import struct
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
from pyspark import Broadcast
from pyspark.sql import DataFrame

from graphloom.session import spread

VOCABULARY = os.environ.get("GRAPHLOOM_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")

# White space as the pre-tokenizer sees it.
_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: The size up to which a vocabulary file is broadcast to the workers, which need not have it.
MOST_BYTES = 64 << 20
#: Words kept between batches; longer or rarer ones are encoded again.
_CACHE, _LONGEST = 400_000, 40


@functools.cache
def byte_letters() -> dict[int, int]:
    """Byte -> the printable character that stands for it: itself, or the next one from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: b for b in plain} | {b: 0x100 + n for n, b in enumerate(rest)}


def read_vocabulary(data: bytes) -> list[bytes]:
    """Tokens by rank from the lines of a vocabulary file, each a base64 token and its rank."""
    ranked = sorted((int(rank), base64.b64decode(token)) for token, rank in (line.split() for line in data.splitlines() if line.strip()))
    if [r for r, _ in ranked] != list(range(len(ranked))):
        raise ValueError(f"ranks of the vocabulary are not 0..{len(ranked) - 1}")
    return [token for _, token in ranked]


def vocabulary_bytes(path: str) -> bytes:
    """The file's bytes; one above MOST_BYTES is no vocabulary and never sent anywhere."""
    if os.path.getsize(path) > MOST_BYTES:
        raise ValueError(f"{path} is larger than {MOST_BYTES} bytes")
    with open(path, "rb") as f:
        return f.read()


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: bytes | int | float | bool) -> bytes:
    """One field of a protocol buffer: bytes, float or integer."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(int(value))


def model_bytes(tokens: list[bytes]) -> bytes:
    """A sentencepiece model whose piece ids are the ranks; one unknown piece follows them."""
    letters = byte_letters()
    out = bytearray()
    for rank, token in enumerate(tokens):
        piece = "".join(chr(letters[b]) for b in token).encode()
        out += _field(1, _field(1, piece) + _field(2, float(-rank)) + _field(3, 1))
    out += _field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2))
    trainer = _field(3, 2) + _field(4, len(tokens) + 1) + _field(40, len(tokens)) + b"".join(_field(n, (1 << 64) - 1) for n in (41, 42, 43))
    normaliser = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return bytes(out + _field(2, trainer) + _field(3, normaliser))


class _Known(dict):
    """Words to ids, learnt as they come; short words are kept, and all are forgotten when there are too many."""

    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, word: str) -> list[int]:
        ids = self.encoder.word_ids(word)
        if len(word) <= _LONGEST:
            if len(self) > _CACHE:
                self.clear()
            self[word] = ids
        return ids


class Encoder:
    """Texts to ids and back; kept once per worker process and vocabulary."""

    def __init__(self, vocabulary: bytes):
        tokens = read_vocabulary(vocabulary)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_bytes(tokens))
        self.tokens = tokens
        self.letters = byte_letters()
        self.known = _Known(self)
        # Python's \w also takes letter-like numbers, so texts with those go the other way.
        self.odd = frozenset(chr(c) for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c)) in ("Nl", "No"))
        self.plain = re.compile(r"'(?:[stmd]|re|ve|ll)| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+", re.A)
        self.wide = re.compile(rf"'(?:[stmd]|re|ve|ll)| ?[^\W\d_]+| ?\d+| ?(?:[^\w{_SPACE}]|_)+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")

    def pre_tokens(self, text: str) -> list[str]:
        if text.isascii():
            return self.plain.findall(text)
        if self.odd.isdisjoint(text):
            return self.wide.findall(text)
        return _exact().findall(text)

    def word_ids(self, word: str) -> list[int]:
        return self.model.encode(word.encode().decode("latin-1").translate(self.letters))

    def encode(self, text: str | None) -> list[int]:
        """The ids of a text; none for null and empty texts."""
        return list(itertools.chain.from_iterable(map(self.known.__getitem__, self.pre_tokens(text)))) if text else []

    def encode_batch(self, texts: list[str | None]) -> list[list[int]]:
        return [self.encode(t) for t in texts]

    def count(self, text: str | None) -> int:
        return sum(map(len, map(self.known.__getitem__, self.pre_tokens(text)))) if text else 0

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.tokens[i] for i in ids).decode("utf-8", "replace")


@functools.cache
def _exact():
    """The pattern with Unicode classes, for texts with letter-like numbers."""
    import regex

    return regex.compile(rf"'(?:[stmd]|re|ve|ll)| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")


@functools.cache
def encoder_of(vocabulary: bytes) -> Encoder:
    return Encoder(vocabulary)


def encoder(path: str) -> Encoder:
    return encoder_of(vocabulary_bytes(path))


def _shipped(df: DataFrame, path: str) -> Broadcast[bytes]:
    return df.sparkSession.sparkContext.broadcast(vocabulary_bytes(path))


def _encode(vocabulary: Broadcast[bytes]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder_of(vocabulary.value)
        for batch in batches:
            ids = e.encode_batch(batch.column("text").to_pylist())
            ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
            flat = np.fromiter(itertools.chain.from_iterable(ids), np.int32, int(ends[-1]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["doc_id", "ids"])

    return run


def encode_documents(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, ids): whole texts in token ids, without special tokens.

    Null and empty texts have the empty list.  Repeated documents give repeated rows.
    """
    return spread(documents.select("doc_id", "text")).mapInArrow(_encode(_shipped(documents, vocabulary)), "doc_id long, ids array<int>")


def _sizes(vocabulary: Broadcast[bytes]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder_of(vocabulary.value)
        for batch in batches:
            sizes = [e.count(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64())], ["doc_id", "n_tokens"])

    return run


def token_counts(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens); 0 for null and empty texts."""
    return spread(documents.select("doc_id", "text")).mapInArrow(_sizes(_shipped(documents, vocabulary)), "doc_id long, n_tokens long")


def _decode(vocabulary: Broadcast[bytes]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        e = encoder_of(vocabulary.value)
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "text": [e.decode(list(x)) if x is not None else None for x in pdf["ids"]]})

    return run


def decode_documents(encoded: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, text) from (doc_id, ids)."""
    return encoded.select("doc_id", "ids").mapInPandas(_decode(_shipped(encoded, vocabulary)), "doc_id long, text string")
