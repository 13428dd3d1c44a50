"""Byte-level BPE through a sentencepiece model that is serialised straight from a rank file.

Each byte is mapped to one character, each token to a piece scored by its negative rank, and the
normaliser changes nothing; merging the best-scored pair first is then merging by rank. Decoding
maps pieces back to bytes.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections import OrderedDict

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import map_texts

#: Bytes stand as characters of a block that normalisation and white space rules never touch.
FIRST_CHAR = 0x4E00
#: Pre-tokens kept in a worker with their ids; longer ones are always encoded anew.
CACHE_SIZE, CACHE_LENGTH = 1 << 18, 64
_CHARS = [chr(FIRST_CHAR + b) for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """Tokens of a rank file in the order of their ranks."""
    with open(path, "rb") as file:
        pairs = [line.split() for line in file if line.strip()]
    ranks = {int(rank): base64.b64decode(token) for token, rank in pairs}
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError("ranks must be 0, 1, 2, ... without gaps")
    return [ranks[i] for i in range(len(ranks))]


def as_piece(token: bytes) -> str:
    return "".join(map(_CHARS.__getitem__, token))


def as_bytes(piece: str) -> bytes:
    return bytes(ord(c) - FIRST_CHAR for c in piece)


def model_proto(tokens: list[bytes]) -> bytes:
    """A sentencepiece BPE model: piece 0 is unknown, piece rank + 1 is a token."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    model.trainer_spec.model_type = pb.TrainerSpec.BPE
    model.trainer_spec.unk_id, model.trainer_spec.bos_id = 0, -1
    model.trainer_spec.eos_id, model.trainer_spec.pad_id = -1, -1
    model.trainer_spec.vocab_size = len(tokens) + 1
    model.normalizer_spec.name = "identity"
    model.normalizer_spec.add_dummy_prefix = False
    model.normalizer_spec.remove_extra_whitespaces = False
    model.normalizer_spec.escape_whitespaces = False
    model.pieces.add(piece="<unk>", score=0.0, type=pb.ModelProto.SentencePiece.UNKNOWN)
    for rank, token in enumerate(tokens):
        model.pieces.add(piece=as_piece(token), score=-float(rank))
    return model.SerializeToString()


def ascii_twin(pattern: str) -> re.Pattern:
    """The same splits on ASCII text, in the standard library's faster engine."""
    out, inside = "", False
    for part in re.split(r"(\\p\{[LN]\}|\\.|[\[\]])", pattern):
        inside = part == "[" or inside and part != "]"
        letters = {r"\p{L}": "A-Za-z", r"\p{N}": "0-9"}.get(part)
        out += part if letters is None else letters if inside else f"[{letters}]"
    return re.compile(out, re.ASCII)


class Codec:
    """Encodes and decodes texts with one rank file and one pattern of pre-tokens."""

    def __init__(self, path: str, pattern: str):
        import sentencepiece

        self.tokens = read_ranks(path)
        self.whole = {token: rank for rank, token in enumerate(self.tokens)}
        self.pattern, self.ascii_pattern = regex.compile(pattern), ascii_twin(pattern)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_proto(self.tokens))
        self.bytes_of = [as_bytes(self.model.id_to_piece(i + 1)) for i in range(len(self.tokens))]
        self.cache: OrderedDict[str, tuple[int, ...]] = OrderedDict()

    def pre_token(self, text: str) -> tuple[int, ...]:
        """Ids of one pre-token: a token of its own, or its pieces by rank of merge."""
        found = self.cache.get(text)
        if found is not None:
            return found
        data = text.encode()
        rank = self.whole.get(data)
        ids = (rank,) if rank is not None else tuple(i - 1 for i in self.model.encode(as_piece(data)))
        if len(text) <= CACHE_LENGTH:
            if len(self.cache) >= CACHE_SIZE:
                self.cache.popitem(last=False)
            self.cache[text] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        get, ids = self.cache.get, []
        for part in (self.ascii_pattern if text.isascii() else self.pattern).findall(text):
            ids += get(part) or self.pre_token(part)
        return ids

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@functools.lru_cache(maxsize=4)
def codec(path: str, pattern: str) -> Codec:
    """One codec per worker process."""
    return Codec(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Adds ids (array<int>) and n_tokens to the ``keep`` columns; one row per row of ``docs``.

    ``path`` is a rank file that every worker can open. A null or empty text has no ids. Rows are
    encoded one by one, so ties and repeated rows do not matter; an empty table gives none.
    """
    fields = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    schema = ", ".join([f"`{c}` {fields[c]}" for c in keep] + ["n_tokens long", "ids array<int>"])

    def run(batch: pa.RecordBatch) -> dict:
        own = codec(path, pattern)
        ids = [own.encode(t) if t else [] for t in batch.column("text").to_pylist()]
        return {"ids": pa.array(ids, pa.list_(pa.int32())), "n_tokens": [len(x) for x in ids]} | {
            c: batch.column(c) for c in keep
        }

    return map_texts(docs, [*dict.fromkeys((*keep, "text"))], schema, run)


def decode(rows: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "data") -> DataFrame:
    """Adds the bytes of each row's ids as binary column ``out``; null ids give null."""
    schema = T.StructType([*rows.schema.fields, T.StructField(out, T.BinaryType())])

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        own, target = codec(path, pattern), to_arrow_schema(schema)
        for batch in batches:
            for i in range(0, len(batch), 256):
                part = batch.slice(i, 256)
                data = [None if x is None else own.decode(x) for x in part.column(ids).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(data, pa.binary())], schema=target)

    return rows.mapInArrow(run, schema)


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, and SHA-256 of the ids (decimal, one space between) and of the decoded bytes.

    Like ``encode`` and ``decode`` in turn, but ids never leave the task.
    """

    def run(batch: pa.RecordBatch) -> dict:
        own = codec(path, pattern)
        n, sha_ids, sha_data = [], [], []
        for text in batch.column("text").to_pylist():
            ids = own.encode(text or "")
            n.append(len(ids))
            sha_ids.append(hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
            sha_data.append(hashlib.sha256(own.decode(ids)).hexdigest())
        return {"doc_id": batch.column("doc_id"), "n_tokens": np.array(n, np.int64), "ids_sha256": sha_ids, "decoded_sha256": sha_data}

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return map_texts(docs, ["doc_id", "text"], schema, run)
