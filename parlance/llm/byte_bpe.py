"""Byte-level BPE encoding and decoding through a sentencepiece model that is written from the vocabulary.

The rank file is turned into a sentencepiece BPE model without training: every token's bytes are mapped to
printable characters, one for each byte, and scored by its negative rank, with identity normalisation. The merges
of sentencepiece (highest score first, then leftmost) are then the merges by lowest rank. Pre-tokens, the
matches of the splitting pattern, are mapped and encoded separately; decoding maps pieces back to bytes.

Bounds: a task remembers at most REMEMBERED pre-tokens of at most REMEMBERED_BYTES bytes each; longer ones, which may be whole texts, are encoded anew.

Defined cases: null counts as empty text, which has no tokens; texts and pre-tokens of any length are encoded whole; rows are independent,
so null ids and rows that repeat pass through; an empty table gives an empty result; further columns are ignored unless ``keep_cols`` names them.
"""

from __future__ import annotations

import base64
import hashlib
import struct

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm.common import slices, table

#: Pre-tokens remembered by a task, and their length; the memory is emptied when full.
REMEMBERED, REMEMBERED_BYTES = 200_000, 64
#: The white space of the pattern's \s, without the separators 1C-1F that Python's \s adds.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def byte_alphabet() -> list[str]:
    """A printable character for each byte: itself where it is printable Latin-1, else the next from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in set(plain) else chr(next(spare)) for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """Tokens in the order of their ranks."""
    with open(path, "rb") as lines:
        ranked = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, lines)}
    if sorted(ranked) != list(range(len(ranked))):
        raise ValueError("ranks must be 0, 1, 2, ... without a gap")
    return [ranked[k] for k in range(len(ranked))]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: bytes | int | float) -> bytes:
    """One protobuf field: varint, 32-bit float or length-delimited."""
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def model_bytes(tokens: list[bytes]) -> bytes:
    """A serialised sentencepiece ModelProto: piece k is token k, the last piece is the unknown one."""
    alphabet = byte_alphabet()
    pieces = [_field(1, _field(1, "".join(alphabet[b] for b in t).encode()) + _field(2, -float(k)) + _field(3, 1)) for k, t in enumerate(tokens)]
    pieces.append(_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2)))
    bpe = _field(3, 2) + _field(4, len(pieces))
    trainer = _field(2, bpe)
    identity = _field(3, _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0))
    return b"".join(pieces) + trainer + identity


class Codec:
    """Encoder and decoder of one task."""

    def __init__(self, path: str, pattern: str):
        import sentencepiece

        self.tokens = read_ranks(path)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_bytes(self.tokens))
        self.unknown = len(self.tokens)
        self.split = regex.compile(pattern.replace(r"[^\s", f"[^{SPACE}").replace(r"(?!\S)", f"(?![^{SPACE}])").replace(r"\s", f"[{SPACE}]")).findall
        self.map = str.maketrans({chr(b): c for b, c in enumerate(byte_alphabet())})
        self.seen: dict[str, bytes] = {}

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        parts, seen = self.split(text), self.seen
        new = [p for p in dict.fromkeys(parts) if p not in seen]
        long: dict[str, bytes] = {}
        if new:
            if len(seen) > REMEMBERED:
                seen.clear()
                new = list(dict.fromkeys(parts))
            mapped = [p.encode().decode("latin-1").translate(self.map) for p in new]
            for part, ids in zip(new, self.model.encode(mapped, out_type=int, num_threads=1)):
                if self.unknown in ids:
                    raise ValueError(f"the vocabulary has no token for a byte of {part[:40]!r}")
                (seen if len(part) * 4 <= REMEMBERED_BYTES else long)[part] = struct.pack(f"<{len(ids)}I", *ids)
        return b"".join([seen[p] if p in seen else long[p] for p in parts]) if long else b"".join([seen[p] for p in parts])

    def decode(self, ids: bytes) -> bytes:
        tokens = self.tokens
        return b"".join([tokens[k] for k in np.frombuffer(ids, "<u4").tolist()])


def encode(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep_cols: tuple[str, ...] = (), with_ids: bool = False) -> DataFrame:
    """Per row: id, n_tokens, ids_sha256, decoded_sha256, and the ids themselves (array<int>) on request."""

    def run(batches):
        codec = Codec(vocabulary, pattern)
        for batch in slices(batches, len(carried)):
            n, sha, back, lists = [], [], [], []
            for text in batch.column(batch.num_columns - 1).to_pylist():
                ids = codec.encode(text or "")
                n.append(len(ids) // 4)
                sha.append(hashlib.sha256(ids).hexdigest())
                back.append(hashlib.sha256(codec.decode(ids)).hexdigest())
                if with_ids:
                    lists.append(np.frombuffer(ids, "<u4").astype(np.int32))
            extra = [pa.array(lists, pa.list_(pa.int32()))] if with_ids else []
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(back, pa.string()), *extra], names=names)

    kinds = dict(docs.dtypes)
    carried = [id_col, *keep_cols]
    names = [*carried, "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids]
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in carried), "n_tokens long, ids_sha256 string, decoded_sha256 string", *["ids array<int>"] * with_ids])
    return docs.select(*carried, F.col(text_col).cast("string").alias("_text")).mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


QUERIES = {"op9_byte_bpe": query}
ORACLES: dict[str, str] = {}
