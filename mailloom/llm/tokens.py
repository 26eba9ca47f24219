"""Token ids of whole texts by a public byte-level BPE vocabulary, with the tiktoken library.

The rank file is local to each worker and loaded once; its folder is a parameter (environment variable
TOKENIZER_DIR, else /opt/tokenizers). Null and empty texts have no ids: an empty list. Texts over PIECE
characters are split where the vocabulary's pattern always starts a new token: at a single blank between
two non-blanks. Special tokens' strings are ordinary text.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailloom.session import spread

FOLDER = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
PIECE = 65_536
# The split pattern that belongs to the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SAFE = re.compile(r"(?<=\S) (?=\S)")


@lru_cache(maxsize=4)
def encoding(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=4)
def token_bytes(path: str) -> list[bytes]:
    enc = encoding(path)
    return [enc.decode_single_token_bytes(i) for i in range(enc.n_vocab)]


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """Parts of at least `size` characters, cut at safe boundaries only; joined they are the text."""
    at = 0
    while len(text) - at > size and (cut := SAFE.search(text, at + size)):
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def encode(text: str | None, path: str) -> np.ndarray:
    if not text:
        return np.zeros(0, np.int32)
    enc = encoding(path)
    parts = [np.asarray(enc.encode_ordinary(p), np.int32) for p in pieces(text)]
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def decode(ids: list[int], path: str) -> str:
    """The text of ids: their raw bytes joined, then read as UTF-8."""
    table = token_bytes(path)
    return b"".join(table[i] for i in ids).decode("utf-8", "replace")


def encoded(texts: DataFrame, vocabulary: str = "byte_bpe_50k", folder: str = FOLDER) -> DataFrame:
    """(doc_id, text) to (doc_id, ids): one row per row, extra columns dropped; null doc_ids stay."""
    path = f"{folder}/{vocabulary}.tiktoken"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = [encode(t, path) for t in b.column("text").to_pylist()]
            offsets = np.zeros(len(ids) + 1, np.int32)
            np.cumsum([len(x) for x in ids], out=offsets[1:])
            flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["doc_id", "ids"])

    return spread(texts.select("doc_id", "text")).mapInArrow(scan, "doc_id long, ids array<int>")


def token_counts(texts: DataFrame, vocabulary: str = "byte_bpe_50k", folder: str = FOLDER) -> DataFrame:
    """(doc_id, text) to (doc_id, tokens), without moving the ids."""
    path = f"{folder}/{vocabulary}.tiktoken"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts = pa.array([len(encode(t, path)) for t in b.column("text").to_pylist()], pa.int32())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), counts], names=["doc_id", "tokens"])

    return spread(texts.select("doc_id", "text")).mapInArrow(scan, "doc_id long, tokens int")


def decoded(ids: DataFrame, vocabulary: str = "byte_bpe_50k", folder: str = FOLDER) -> DataFrame:
    """(doc_id, ids) to (doc_id, text)."""
    path = f"{folder}/{vocabulary}.tiktoken"

    @F.udf("string", useArrow=True)
    def back(x: list[int]) -> str:
        return decode(x, path)

    return ids.select("doc_id", back("ids").alias("text"))
