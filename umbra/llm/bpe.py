"""Byte-level BPE by a sentencepiece model that is serialised straight from a rank vocabulary.

Each token's bytes are mapped to 256 printable characters, a piece scores the negative of its rank,
normalisation is the identity.  Sentencepiece merges the best-scored adjacent pair first, which is
the pair of lowest rank, so ids equal those of the rank vocabulary's own encoder.

Nulls count as empty texts; an empty text has no ids.  Repeated rows and ids are encoded row by row.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from functools import cache
from itertools import chain

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pretokens import pieces
from .shared import mapped

#: Entries of a Python worker's cache, which keeps the first ones (frequent pieces come early); characters of one at most.
CACHE, SHORT = 800_000, 64


def byte_characters() -> list[str]:
    """A character for each byte: itself where printable and not a blank, else the next from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    keep = set(plain)
    return [chr(b) if b in keep else chr(next(rest)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks by token bytes of a file with one base64 token and its rank per line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: bytes | int | float) -> bytes:
    """A field of a protocol buffer: bytes, int (varint) or float (32 bits)."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def serialise(ranks: dict[bytes, int]) -> tuple[bytes, list[int]]:
    """The model and, by piece, the rank that it stands for (-1: the unknown piece, which no text reaches)."""
    chars = byte_characters()
    missing = [b for b in range(256) if bytes([b]) not in ranks]
    if missing:
        raise ValueError(f"the vocabulary lacks {len(missing)} single bytes")
    order = sorted(ranks, key=ranks.__getitem__)
    body = bytearray(_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2)))  # type 2: unknown
    for token in order:
        body += _field(1, _field(1, "".join(map(chars.__getitem__, token)).encode()) + _field(2, -float(ranks[token])))
    trainer = _field(3, 2) + _field(4, len(order) + 1) + _field(24, 0) + _field(35, 0) + _field(41, 0) + _field(42, 2**64 - 1) + _field(43, 2**64 - 1)  # BPE; no dummy splits; no <s>, </s>
    identity = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)  # no prefix, no trimming, no escaping
    return bytes(body + _field(2, trainer) + _field(3, identity)), [-1, *(ranks[t] for t in order)]


class Codec:
    """Encodes by the serialised model, pre-token by pre-token; decodes by the inverse mapping."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex
        import sentencepiece

        model, self.rank_of = serialise(ranks)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.findall = regex.compile(pattern).findall
        self.chars = byte_characters()
        self.bytes_of = {r: t for t, r in ranks.items()}
        self.known: dict[str, tuple[int, ...]] = {}

    def _learned(self, new: list[str]) -> list[tuple[int, ...]]:
        """The ids of pieces that aren't in the cache; they go there while it has room."""
        cut = [self.findall(x) for x in new]
        rank_of, chars, known = self.rank_of, self.chars, self.known
        found = iter(self.model.encode(["".join([chars[b] for b in p.encode()]) for ps in cut for p in ps], num_threads=1))
        out = []
        for x, ps in zip(new, cut):
            ids = tuple([rank_of[i] for _ in ps for i in next(found)])
            out.append(ids)
            if len(known) < CACHE and len(x) <= SHORT:
                known[x] = ids
        return out

    def encode(self, text: str) -> list[int]:
        parts = pieces(text, self.findall)
        known = self.known
        got = [known.get(x) for x in parts]
        if None in got:
            at = [i for i, x in enumerate(got) if x is None]
            for i, ids in zip(at, self._learned([parts[i] for i in at])):
                got[i] = ids
        return list(chain.from_iterable(got))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def forget() -> None:
    """Lets a worker's codec and its cache go."""
    codec.cache_clear()


@cache
def codec(path: str, pattern: str) -> Codec:
    """One a worker."""
    return Codec(read_ranks(path), pattern)


def encode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, ids array<int>) for each row; path: a rank file on every machine."""

    def run(batch):
        c = codec(path, pattern)
        return {id_col: batch.column(0), "ids": [c.encode(x) for x in batch.column(1).to_pylist()]}

    d = df.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return mapped(d, run, f"`{id_col}` {d.schema[0].dataType.simpleString()}, ids array<int>")


def decode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id_col, bytes binary) for each row; null ids count as none."""

    def run(batch):
        c = codec(path, pattern)
        return {id_col: batch.column(0), "bytes": [c.decode(x or []) for x in batch.column(1).to_pylist()]}

    d = df.select(F.col(id_col), F.col(ids_col))
    return mapped(d, run, f"`{id_col}` {d.schema[0].dataType.simpleString()}, bytes binary")


def digests(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes and decodes each row in one pass: (id_col, n_tokens, ids_sha256, decoded_sha256), so
    that ids, ten times the text as an array, never leave the worker."""

    def run(batch):
        c, out = codec(path, pattern), ([], [], [])
        decimal = c.__dict__.setdefault("decimal", {r: str(r) for r in c.bytes_of})
        for text in batch.column(1).to_pylist():
            ids = c.encode(text)
            out[0].append(len(ids))
            out[1].append(hashlib.sha256(",".join(map(decimal.__getitem__, ids)).encode()).hexdigest())
            out[2].append(hashlib.sha256(c.decode(ids)).hexdigest())
        return {id_col: batch.column(0), "n_tokens": out[0], "ids_sha256": out[1], "decoded_sha256": out[2]}

    d = df.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return mapped(d, run, f"`{id_col}` {d.schema[0].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
