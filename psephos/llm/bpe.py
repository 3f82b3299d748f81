"""Byte-level BPE encoding and decoding by the tiktoken library with a local rank file.

Long texts are cut before encoding where the pattern breaks in any case, so that the memory of
one call stays bounded.  Encoding ignores special tokens: their strings are ordinary text.

Defined cases: a null or empty text has no tokens; ids decode to the very bytes of the text,
which need not be whole characters token by token; rows are independent of each other.
"""
from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import tiktoken
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from psephos.llm.tables import by_block, columns

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PIECE = 1 << 16

# A match holds white space only before other characters, so one never goes on from a letter or
# digit over a space.
_SAFE = re.compile(r"(?<=[A-Za-z0-9.,;:!?])(?=[ \n])")


@functools.lru_cache(maxsize=2)
def encoding(path: str) -> tiktoken.Encoding:
    """The encoding of a rank file: lines of base64 bytes and rank."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding("local", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """``text`` cut at safe places into pieces of about ``size`` characters, longer where none is."""
    start = 0
    while len(text) - start > size:
        cut = _SAFE.search(text, start + size)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def encode(text: str, path: str = RANKS) -> np.ndarray:
    """The ids of ``text``, as unsigned 32-bit integers."""
    if len(text) <= PIECE:
        return np.asarray(encoding(path).encode_ordinary(text), dtype="<u4")
    return np.concatenate([np.asarray(encoding(path).encode_ordinary(piece), dtype="<u4") for piece in pieces(text)])


def decode(ids: np.ndarray, path: str = RANKS) -> bytes:
    """The bytes that ``ids`` stand for."""
    return encoding(path).decode_bytes(np.asarray(ids).tolist())


def shipped(spark: SparkSession, ranks: str) -> str:
    """The name under which every executor finds the rank file."""
    name = ranks.rsplit("/", 1)[-1]
    spark.sparkContext.addFile(ranks)
    return name


def encoded(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", ranks: str = RANKS) -> DataFrame:
    """(id, n_tokens, ids, ids_sha256, decoded_sha256) per row; ``ids`` are little-endian unsigned 32-bit."""
    name = shipped(docs.sparkSession, ranks)
    schema = pa.schema([
        ("id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()),
        ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()),
    ])

    def work(block: pa.RecordBatch) -> pa.RecordBatch:
        path = SparkFiles.get(name)
        ids = [encode(value or "", path) for value in block.column("text").to_pylist()]
        return columns(
            schema,
            id=block.column("id"),
            n_tokens=[len(x) for x in ids],
            ids=[x.tobytes() for x in ids],
            ids_sha256=[hashlib.sha256(x.tobytes()).hexdigest() for x in ids],
            decoded_sha256=[hashlib.sha256(decode(x, path)).hexdigest() for x in ids],
        )

    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    return by_block(rows, "text", "id long, n_tokens long, ids binary, ids_sha256 string, decoded_sha256 string", work)


def decoded(encoded_docs: DataFrame, ranks: str = RANKS) -> DataFrame:
    """(id, text) of rows with id and ids."""
    name = shipped(encoded_docs.sparkSession, ranks)
    schema = pa.schema([("id", pa.int64()), ("text", pa.string())])

    def work(block: pa.RecordBatch) -> pa.RecordBatch:
        path = SparkFiles.get(name)
        texts = [decode(np.frombuffer(x or b"", "<u4"), path).decode() for x in block.column("ids").to_pylist()]
        return columns(schema, id=block.column("id"), text=texts)

    return by_block(encoded_docs.select("id", "ids"), "ids", "id long, text string", work)
