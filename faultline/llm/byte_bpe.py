"""Operator 1: byte-level BPE encoding and decoding with a local rank file.

The library encodes the matches of the split pattern. Long texts are cut at safe boundaries first (see `pieces`), so
that neither the backtracking of the pattern nor the list of ids grows with the length of a document; digests are
updated piece by piece. Decoding joins the raw bytes of the ids, because an id may hold part of a character only.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable
from functools import lru_cache

import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession, functions as F

from faultline.llm.common import by_row, key_type, pick, table
from faultline.llm.pieces import long_blanks, pieces

RANKS = "byte_bpe_50k.tiktoken"


@lru_cache(maxsize=4)
def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    """The tokenizer of a rank file (one base64 token and its rank per line); no special tokens, no network."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(None, map(bytes.strip, lines)))}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def encode_text(text: str, path: str, pattern: str) -> Iterable[list[int]]:
    """Ids of the text, in one list per piece."""
    library = encoding(path, pattern)
    # Another pattern may cut a run of white space in more matches.
    for part, whole in long_blanks(text) if pattern == public_tokenizers.PATTERN else [(text, False)]:
        if whole:
            yield library._encode_single_piece(part)
        else:
            yield from map(library.encode_ordinary, pieces(part))


def _decimal(ids: list[int]) -> bytes:
    return str(ids)[1:-1].replace(",", "").encode()


def digests(text: str, path: str, pattern: str) -> tuple[int, str, str]:
    """Number of ids, SHA-256 of the decimal ids joined by blanks, SHA-256 of the decoded bytes."""
    decode = encoding(path, pattern).decode_bytes
    count, of_ids, of_bytes = 0, hashlib.sha256(), hashlib.sha256()
    for ids in encode_text(text, path, pattern):
        if ids:
            if count:
                of_ids.update(b" ")
            of_ids.update(_decimal(ids))
            of_bytes.update(decode(ids))
            count += len(ids)
    return count, of_ids.hexdigest(), of_bytes.hexdigest()


def _files(path: str | None, pattern: str | None) -> tuple[str, str]:
    return path or public_tokenizers.path(RANKS), pattern or public_tokenizers.PATTERN


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(key, ids): the ids of every whole text.

    Null and empty texts have no ids. Repeated rows and keys give one row each; a null key stays null. Other columns
    are ignored, whatever their names. `path` must be readable on every executor.
    """
    path, pattern = _files(path, pattern)
    kind = docs.schema[key].dataType.simpleString()

    def ids(value: str) -> tuple[list[int]]:
        return ([i for part in encode_text(value, path, pattern) for i in part],)

    rows = pick(docs, key, text)
    schema = pa.schema([("key", key_type(rows)), ("ids", pa.list_(pa.int32()))])
    return rows.mapInArrow(by_row(ids, schema), f"key {kind}, ids array<int>").withColumnRenamed("key", key)


def decode(encoded: DataFrame, key: str = "doc_id", ids: str = "ids", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(key, data): the raw bytes of the ids of every row. Null and empty lists give no bytes."""
    path, pattern = _files(path, pattern)
    kind = encoded.schema[key].dataType.simpleString()
    rows = encoded.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{ids}`"), F.array().cast("array<int>")).alias("ids"))
    schema = pa.schema([("key", key_type(rows)), ("data", pa.binary())])

    def data(value: list[int]) -> tuple[bytes]:
        return (encoding(path, pattern).decode_bytes(value),)

    return rows.mapInArrow(by_row(data, schema), f"key {kind}, data binary").withColumnRenamed("key", key)


def round_trip(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256): encode every whole text, decode the ids, keep digests of both.

    Same cases as `encode`; a text without ids has the digest of no bytes twice.
    """
    path, pattern = _files(path, pattern)
    kind = docs.schema[key].dataType.simpleString()
    rows = pick(docs, key, text)
    schema = pa.schema([("key", key_type(rows)), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
    out = rows.mapInArrow(
        by_row(lambda value: digests(value, path, pattern), schema),
        f"key {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string",
    )
    return out.withColumnRenamed("key", key)


def op1_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return round_trip(table(spark, folder, "documents"))
