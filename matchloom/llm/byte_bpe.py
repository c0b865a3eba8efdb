"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file."""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import TEXTS_PER_BATCH, chunks, map_arrow, texts_of

#: Texts longer than this many characters are cut at safe boundaries before the library sees them.
PIECE_CHARS = 100_000

#: The code points of the Unicode property White_Space, which the patterns' ``\\s`` stands for.
WHITE_SPACE = [(0x09, 0x0D), (0x20, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029),
               (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)]
WHITE = "".join(f"{chr(a)}-{chr(b)}" for a, b in WHITE_SPACE)
_CUT = re.compile(f"(?<=[^{WHITE}])(?=[{WHITE}])")


def safe_pieces(text: str, piece_chars: int = PIECE_CHARS) -> Iterator[str]:
    """Cut a long text where no token can reach across.

    Between a visible character and white space every alternative of the split pattern ends: white space only
    starts a match or fills it, and looking ahead matters only to matches that are white space. Each piece runs to
    the first such place after ``piece_chars``; a run without one stays whole.
    """
    start = 0
    while len(text) - start > piece_chars:
        cut = _CUT.search(text, start + piece_chars)
        if cut is None:
            break
        yield text[start:cut.start()]
        start = cut.start()
    if start < len(text):
        yield text[start:]


@functools.lru_cache(maxsize=4)
def encoding(rank_file: str, pattern: str):
    """The library's encoder; one per worker process."""
    import tiktoken

    with open(rank_file, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def encode(text: str, rank_file: str, pattern: str, piece_chars: int = PIECE_CHARS) -> np.ndarray:
    enc = encoding(rank_file, pattern)
    parts = [enc.encode_to_numpy(piece, disallowed_special=()) for piece in safe_pieces(text, piece_chars)]
    return np.concatenate(parts).astype("<u4", copy=False) if parts else np.zeros(0, "<u4")


def decode(ids: np.ndarray, rank_file: str, pattern: str) -> bytes:
    """Raw bytes of the ids: the bytes of the tokens one after another, valid UTF-8 or not."""
    return encoding(rank_file, pattern).decode_bytes(ids.tolist())


def encode_texts(rank_file: str, pattern: str) -> Column:
    """Function of a text column to its ids as little-endian unsigned 32-bit integers; null is the empty text."""

    @F.arrow_udf(T.BinaryType())
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            yield pa.array([encode(x, rank_file, pattern).tobytes() for x in texts_of(column)], pa.binary())

    return ids


def decode_ids(rank_file: str, pattern: str) -> Column:
    """Function of a column of packed ids to the raw bytes they stand for."""

    @F.arrow_udf(T.BinaryType())
    def raw(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            packed = (np.frombuffer(x.as_py() or b"", "<u4") for x in column)
            yield pa.array([decode(x, rank_file, pattern) for x in packed], pa.binary())

    return raw


def round_trip(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` and ``restored``, whether the decoded
    bytes are those of the text.

    Ids and bytes of a text are made, hashed and dropped inside the task, so no row carries them; :func:`encode_texts`
    and :func:`decode_ids` give them as columns. Null and empty texts have no ids. Repeated rows stay repeated, an
    empty table gives an empty one, other columns are not read.
    """
    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, kind), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()),
                           T.StructField("decoded_sha256", T.StringType()), T.StructField("restored", T.BooleanType())])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, TEXTS_PER_BATCH):
                n, ids_sha, raw_sha, same = [], [], [], []
                for text in texts_of(batch.column(1)):
                    ids = encode(text, rank_file, pattern)
                    raw = decode(ids, rank_file, pattern)
                    n.append(len(ids))
                    ids_sha.append(hashlib.sha256(ids.tobytes()).hexdigest())
                    raw_sha.append(hashlib.sha256(raw).hexdigest())
                    same.append(raw == text.encode())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(raw_sha, pa.string()), pa.array(same, pa.bool_())],
                    names=schema.names)

    return map_arrow(docs.select(id_col, text_col), digest, schema)
