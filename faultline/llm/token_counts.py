"""Operator 4: token counts by byte-pair merging, without identifiers.

A text is split as the library's byte-level pre-tokenizer splits it. Within a match, the lowest-rank adjacent pair is
merged again and again: a heap holds the pairs, a doubly linked list of positions holds the symbols, so n symbols cost
O(n log n). The number of tokens is the number of initial symbols less the number of merges.

Texts are cut into chunks (white space and what follows it, which no match crosses) and the counts of frequent chunks
are kept per worker, in a table of fixed size.
"""

from __future__ import annotations

import heapq
import json
import re
from functools import lru_cache

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F

from faultline.llm.common import Recent, byte_symbols, by_row, key_type, pick, table

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 512

#: Unicode's white space, which the library's expressions mean by \s.
_SPACE = r"\x09-\x0d\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SPLIT = regex.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
)
_CHUNK = re.compile(r"[ \t-\r]*[^ \t-\r]+|[ \t-\r]+")
#: White space outside ASCII: a text that has any is split as a whole.
_OTHER_SPACE = re.compile(r"[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


class Counter:
    """Counts tokens as the library would for one vocabulary file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        ids, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.start = [0] * 256
        for sign, byte in byte_symbols().items():
            self.start[byte] = ids[sign]
        self.ranks: dict[int, tuple[int, int]] = {}  # pair -> rank, merged symbol
        for rank, pair in enumerate(merges):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks.setdefault(ids[left] << 16 | ids[right], (rank, ids[left + right]))
        if max(ids.values()) >= 1 << 16:
            raise ValueError("a vocabulary of more than 65,536 entries needs wider keys")
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.words = Recent(self.word).__getitem__
        self.chunks = Recent(self.chunk).__getitem__

    def merged(self, data: bytes) -> int:
        """Tokens of one match: symbols less merges."""
        size = len(data)
        if size < 2:
            return size
        ranks, bits = self.ranks.get, size.bit_length()
        here = (1 << bits) - 1
        symbols = [self.start[b] for b in data]
        # An entry is the rank, then the position in `bits` bits: ordered by rank, then from left to right.
        heap = [
            found[0] << bits | i
            for i, pair in enumerate(zip(symbols, symbols[1:]))
            if (found := ranks(pair[0] << 16 | pair[1]))
        ]
        if not heap:
            return size
        heapq.heapify(heap)
        after, before = [*range(1, size), -1], [*range(-1, size - 1)]
        pop, push, merges = heapq.heappop, heapq.heappush, 0
        while heap:
            entry = pop(heap)
            at = entry & here
            right = after[at]
            if right < 0 or not (found := ranks(symbols[at] << 16 | symbols[right])) or found[0] != entry >> bits:
                continue  # this place has been merged away, or its pair has changed since
            merges += 1
            symbols[at] = symbol = found[1]
            after[at] = following = after[right]
            after[right] = -1
            if following >= 0:
                before[following] = at
                if found := ranks(symbol << 16 | symbols[following]):
                    push(heap, found[0] << bits | at)
            previous = before[at]
            if previous >= 0 and (found := ranks(symbols[previous] << 16 | symbol)):
                push(heap, found[0] << bits | previous)
        return size - merges

    def word(self, match: str) -> int:
        return self.merged(match.encode())

    def chunk(self, text: str) -> int:
        """Tokens of a text without special strings, match by match."""
        return sum(map(self.words, _SPLIT.findall(text)))

    def plain(self, text: str) -> int:
        if not text.isascii() and _OTHER_SPACE.search(text):
            return self.chunk(text)
        return sum(map(self.chunks, _CHUNK.findall(text)))

    def count(self, text: str) -> int:
        """Special strings inside the text are one token each, as by the library's default."""
        if not self.special or not self.special.search(text):
            return self.plain(text)
        parts = self.special.split(text)
        return sum(map(self.plain, parts)) + len(parts) - 1


@lru_cache(maxsize=4)
def counter(path: str) -> Counter:
    return Counter(path)


def count_tokens(
    docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, limit: int = LIMIT
) -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) of every whole text.

    Null and empty texts have 0 bytes and 0 tokens. One row per row: repeated rows and keys are counted each, a null
    key stays null. A run without a break, however long, is merged whole in O(n log n). Other columns are ignored.
    `path` must be readable on every executor.
    """
    path = path or public_tokenizers.path(VOCABULARY)
    rows = pick(docs, key, text)
    kind = docs.schema[key].dataType.simpleString()
    schema = pa.schema([("key", key_type(rows)), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])

    def counts(value: str) -> tuple[int, int]:
        return len(value.encode()), counter(path).count(value)

    out = rows.mapInArrow(by_row(counts, schema), f"key {kind}, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit).withColumnRenamed("key", key)


def op4_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return count_tokens(table(spark, folder, "documents"))
