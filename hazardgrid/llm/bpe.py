"""Byte-level BPE through a sentencepiece model that is serialised straight from the rank file.

Every byte is mapped to a printable character, so a token becomes a piece of such characters; its
score is the negative rank, which makes the library merge in rank order. Normalisation is identity.
Texts are cut into pre-tokens by the tokenizer's pattern; each is one piece if it is in the
vocabulary, else it is encoded by the model. Decoding maps every piece's characters back to bytes.

Null text encodes as empty. Ids are packed as little-endian unsigned 32-bit integers. Pre-tokens have
no length limit, texts are taken whole.
"""

from __future__ import annotations

import base64
import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hazardgrid.llm.common import python_ready

#: Pre-tokens that a task remembers; a full memory is emptied, which changes no result.
MEMORY = 400_000

_CODECS: dict[int, Codec] = {}


def byte_letters() -> list[str]:
    """One printable character per byte: printable Latin-1 stands for itself, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    """The lines of a rank file: base64 token, rank. Read on the driver; it is a program file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: bytes | int | float | str) -> bytes:
    """One protobuf field: varint, 32-bit float, or length-delimited."""
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    raw = value.encode() if isinstance(value, str) else value
    return _varint(number << 3 | 2) + _varint(len(raw)) + raw


def serialise_model(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece model whose piece ids are the ranks; the unknown piece comes last."""
    letters = byte_letters()
    order = sorted(ranks, key=ranks.get)
    if [ranks[t] for t in order] != list(range(len(order))):
        raise ValueError("ranks must be 0, 1, 2, ... without gaps")
    out = [_field(1, _field(1, "".join(letters[b] for b in t)) + _field(2, -float(k))) for k, t in enumerate(order)]
    out.append(_field(1, _field(1, "<unk>") + _field(2, 0.0) + _field(3, 2)))  # type 2: unknown
    ids = _field(40, len(order))  # unk_id
    out.append(_field(2, _field(3, 2) + _field(4, len(order) + 1) + ids))  # trainer: model type 2 is BPE
    plain = _field(1, "identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    out.append(_field(3, plain))  # normaliser: no prefix, white space kept as it is
    return b"".join(out)


class Codec:
    """Encoder and decoder of one model; built once per worker."""

    def __init__(self, model: bytes, pattern: str, memory: int = MEMORY):
        import regex
        import sentencepiece

        self.cut = regex.compile(pattern).findall
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        byte_of = {c: b for b, c in enumerate(byte_letters())}
        pieces = [self.sp.id_to_piece(k) for k in range(self.sp.get_piece_size() - 1)]
        self.letters = str.maketrans({chr(b): c for b, c in enumerate(byte_letters())})
        self.bytes_of = [bytes(byte_of[c] for c in p) for p in pieces]
        self.whole = {p: np.array([k], "<u4").tobytes() for k, p in enumerate(pieces)}
        self.held: dict[str, bytes] = {}
        self.memory = memory

    def encode(self, text: str | None) -> bytes:
        parts = self.cut(text or "")
        new = set(parts).difference(self.held)
        if new:
            if len(self.held) + len(new) > self.memory:
                self.held.clear()
                new = set(parts)
            mapped = {p: p.encode().decode("latin-1").translate(self.letters) for p in new}
            rest = [p for p, m in mapped.items() if m not in self.whole]
            self.held.update((p, self.whole[m]) for p, m in mapped.items() if m in self.whole)
            for p, ids in zip(rest, self.sp.encode([mapped[p] for p in rest], num_threads=1)):
                self.held[p] = np.array(ids, "<u4").tobytes()
        return b"".join(map(self.held.__getitem__, parts))

    def decode(self, packed: bytes | None) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(packed or b"", "<u4").tolist()))


def _codec(key: int, sent) -> Codec:
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(*sent.value)
    return _CODECS[key]


class Tokenizer:
    """Column functions over one vocabulary; the model (about a megabyte) is broadcast.

    ``memory``: pre-tokens that a worker remembers. Fewer cost time, more cost memory.
    """

    def __init__(self, spark: SparkSession, vocabulary: str, pattern: str, memory: int = MEMORY):
        python_ready(spark)
        model = serialise_model(read_ranks(vocabulary))
        sent, key = spark.sparkContext.broadcast((model, pattern, memory)), hash((model, pattern, memory))

        @F.pandas_udf("binary")
        def encode(texts: pd.Series) -> pd.Series:
            return texts.map(_codec(key, sent).encode)

        @F.pandas_udf("binary")
        def decode(packed: pd.Series) -> pd.Series:
            return packed.map(_codec(key, sent).decode)

        self._encode, self._decode = encode, decode

    def encode(self, text: str | Column) -> Column:
        """Packed ids of a text column."""
        return self._encode(text)

    def decode(self, packed: str | Column) -> Column:
        """Bytes of a packed id column."""
        return self._decode(packed)


def unpack_ids(packed: bytes) -> list[int]:
    return np.frombuffer(packed, "<u4").tolist()


def round_trip(docs: DataFrame, tokenizer: Tokenizer, text: str = "text") -> DataFrame:
    """``docs`` with ``ids`` (packed) and ``decoded`` (bytes)."""
    out = docs.withColumn("ids", tokenizer.encode(text))
    return out.withColumn("decoded", tokenizer.decode("ids"))
