"""Byte-level BPE with a sentencepiece model made from a rank file.

The vocabulary is written as a sentencepiece BPE model without training: each
token's bytes become characters by the usual printable byte map, its score is
the negative rank, and normalisation is the identity. A text is cut into
pre-tokens by a pattern, each is encoded by the model, and ids are decoded by
the inverse map.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2 as proto

from .common import portions, table

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
# Pre-tokens whose ids a worker remembers; when full it starts anew.
REMEMBERED = 150_000


def read_ranks(path: str) -> list[bytes]:
    """Tokens of a rank file; a token's place is its id."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    tokens = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    return tokens


def byte_characters() -> list[str]:
    """A printable character for each byte: itself where printable, else one from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return [chr(b) if b in set(shown) else chr(256 + hidden.index(b)) for b in range(256)]


def serialise_model(tokens: list[bytes]) -> bytes:
    """A sentencepiece BPE model of the vocabulary.

    Id 0 of the model is its unknown piece, so a token's id is its piece's less
    one. It never occurs, as every byte is a token.
    """
    chars = byte_characters()
    model = proto.ModelProto()
    model.trainer_spec.model_type = proto.TrainerSpec.BPE
    model.trainer_spec.vocab_size = len(tokens) + 1
    model.trainer_spec.split_by_whitespace = False
    model.normalizer_spec.name = "identity"
    model.normalizer_spec.precompiled_charsmap = b""
    model.normalizer_spec.add_dummy_prefix = False
    model.normalizer_spec.remove_extra_whitespaces = False
    model.normalizer_spec.escape_whitespaces = False
    model.pieces.add(piece="<unk>", score=0.0, type=proto.ModelProto.SentencePiece.UNKNOWN)
    for rank, token in enumerate(tokens):
        model.pieces.add(piece="".join(chars[b] for b in token) or f"<gap{rank}>", score=-float(rank),
                         type=proto.ModelProto.SentencePiece.NORMAL if token else proto.ModelProto.SentencePiece.UNUSED)
    return model.SerializeToString()


class Codec:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, tokens: list[bytes], model: bytes, pattern: str = PATTERN):
        self.tokens = tokens
        self.whole = {t: i for i, t in enumerate(tokens) if t}
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.cut = regex.compile(pattern).findall
        self.map = dict(enumerate(byte_characters()))
        self.known: dict[str, bytes] = {}

    def learn(self, missing: list[str]) -> None:
        """Ids of pre-tokens, as little-endian 32-bit integers. One that is a token as a whole is that token."""
        rest = []
        for m in missing:
            i = self.whole.get(m.encode("utf-8", "surrogatepass"))
            if i is None:
                rest.append(m)
            else:
                self.known[m] = i.to_bytes(4, "little")
        if rest:
            mapped = [m.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.map) for m in rest]
            for m, ids in zip(rest, self.model.encode(mapped, num_threads=1), strict=True):
                self.known[m] = (np.asarray(ids, dtype="<u4") - 1).astype("<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """The ids of a whole text, as little-endian unsigned 32-bit integers."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known, parts = self.known, self.cut(text)
        missing = [m for m in dict.fromkeys(parts) if m not in known]
        if missing:
            self.learn(missing)
        return b"".join([known[p] for p in parts])

    def decode(self, ids: bytes) -> bytes:
        tokens = self.tokens
        return b"".join([tokens[i] for i in np.frombuffer(ids, dtype="<u4").tolist()])


_codecs: dict[str, Codec] = {}


def codec_of(key: str, shipped) -> Codec:
    """The worker's codec; made once for each vocabulary and Python process."""
    if key not in _codecs:
        tokens, model, pattern = shipped.value
        _codecs[key] = Codec(tokens, model, pattern)
    return _codecs[key]


def ship(spark: SparkSession, path: str, pattern: str):
    """The vocabulary, read on the driver and broadcast: a file of fixed size, whatever the data."""
    tokens = read_ranks(path)
    model = serialise_model(tokens)
    return hashlib.sha256(model + pattern.encode()).hexdigest(), spark.sparkContext.broadcast((tokens, model, pattern))


def encoder(spark: SparkSession, path: str = RANKS, pattern: str = PATTERN):
    """A column function: text to ``ids`` (little-endian 32-bit integers) and ``decoded`` (bytes), both binary."""
    key, shipped = ship(spark, path, pattern)

    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = codec_of(key, shipped)
        for texts in batches:
            for part in portions(texts):
                ids = [codec.encode(t or "") for t in part.to_pylist()]
                decoded = [codec.decode(x) for x in ids]
                yield pa.StructArray.from_arrays([pa.array(ids, pa.binary()), pa.array(decoded, pa.binary())], ["ids", "decoded"])

    return F.arrow_udf(encode, "ids binary, decoded binary")


def encoded(docs: DataFrame, *, path: str = RANKS, pattern: str = PATTERN) -> DataFrame:
    """``docs`` with ``bpe_ids`` and, decoded from them, ``bpe_decoded``.

    A null text is an empty one, without ids. Other columns stay, unless they
    have these two names: then they are replaced. No row moves to another machine.
    """
    columns = [c for c in docs.columns if c not in ("bpe_ids", "bpe_decoded")]
    out = docs.select(*columns, encoder(docs.sparkSession, path, pattern)(F.col("text")).alias("bpe"))
    return out.select(*columns, F.col("bpe.ids").alias("bpe_ids"), F.col("bpe.decoded").alias("bpe_decoded"))


def digests(ids: Column, decoded: Column) -> list[Column]:
    return [(F.octet_length(ids) / 4).cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"),
            F.sha2(decoded, 256).alias("decoded_sha256")]


def encode_documents(docs: DataFrame) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``, one row per document."""
    out = encoded(docs.select("doc_id", "text"))
    return out.select("doc_id", *digests(F.col("bpe_ids"), F.col("bpe_decoded")))


def op2_bpe(spark, sf_dir) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"))


QUERIES = {"op2_bpe": op2_bpe}
ORACLE: dict[str, str] = {}
