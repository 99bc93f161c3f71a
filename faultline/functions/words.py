"""Words of texts in Arrow batches, used inside tasks: the bytes of many texts are classed and cut at once.

The cuts are those of `text.tokens`. What belongs to a word is asked of Spark's own regular expressions, one time for all
characters; texts come in lower case from Spark, see `lowered`.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession, functions as F

from faultline.functions.text import WORD_CHARACTER

#: Rows, and bytes of text, that are cut at once; a longer text is cut by itself.
ROWS, BYTES = 512, 1 << 20

_CODES = 0x110000
_alphabets: dict[str, np.ndarray] = {}


def lowered(text: Column) -> Column:
    return F.lower(F.coalesce(text, F.lit("")))


def alphabet(spark: SparkSession) -> np.ndarray:
    """Where runs of characters that belong to words begin and end, in turn."""
    app = spark.sparkContext.applicationId
    if app not in _alphabets:
        every = "".join(chr(c) for c in range(_CODES) if not 0xD800 <= c < 0xE000)
        found = spark.createDataFrame([(every,)], "c string").select(
            F.explode(F.regexp_extract_all("c", F.lit(f"{WORD_CHARACTER}+"), F.lit(0))).alias("run")
        ).select(F.substring("run", 1, 1).alias("first"), F.length("run").alias("n")).collect()
        gap = 0xE000 - 0xD800
        edges = []
        for first, n in ((ord(r.first), r.n) for r in found):
            edges += [first, first + n + (gap if first < 0xD800 < first + n else 0)]
        _alphabets[app] = np.array(edges, np.int64)
    return _alphabets[app]


def members(edges: np.ndarray) -> np.ndarray:
    """For every character whether it belongs to words."""
    turns = np.zeros(_CODES + 1, np.int8)
    turns[edges[0::2]] += 1
    turns[edges[1::2]] -= 1
    return np.cumsum(turns[:-1], dtype=np.int8).astype(bool)


def _places(texts: pa.StringArray) -> np.ndarray:
    return np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]


def text_parts(batches: Iterator[pa.RecordBatch], column: str, rows: int = ROWS, size: int = BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most so many rows and bytes of text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        places = _places(batch.column(column).cast(pa.string()))
        start = 0
        while start < batch.num_rows:
            fit = int(np.searchsorted(places, int(places[start]) + size, "right")) - 1
            stop = min(max(fit, start + 1), start + rows, batch.num_rows)
            yield batch.slice(start, stop - start)
            start = stop


def cut(texts: pa.Array, word: np.ndarray) -> tuple[pa.StringArray, np.ndarray]:
    """The words of all texts, one after the other, and where those of each text begin and end among them. `word` is of
    `members`."""
    texts = texts.cast(pa.string())
    if not len(texts) or texts.buffers()[2] is None:
        return pa.array([], pa.string()), np.zeros(len(texts) + 1, np.int64)
    bounds = _places(texts).astype(np.int64)
    raw = np.frombuffer(texts.buffers()[2], np.uint8)[bounds[0] : bounds[-1]]
    bounds = bounds - bounds[0]
    inside = np.concatenate([word[:128], np.zeros(128, bool)])[raw]
    lead = np.flatnonzero(raw >= 0xC0)
    if len(lead):
        first = raw[lead].astype(np.int32)
        rest = [(raw.take(lead + i, mode="clip") & 0x3F).astype(np.int32) for i in (1, 2, 3)]
        code = np.where(first < 0xE0, (first & 0x1F) << 6 | rest[0], (first & 0x0F) << 12 | rest[0] << 6 | rest[1])
        four = first >= 0xF0
        code[four] = ((first & 0x07) << 18 | rest[0] << 12 | rest[1] << 6 | rest[2])[four]
        known = word[code]
        for i, least in enumerate((0xC0, 0xC0, 0xE0, 0xF0)):
            inside[lead[first >= least] + i] = known[first >= least]

    turn = np.zeros(len(raw) + 1, bool)
    turn[0], turn[-1] = inside[:1].any(), inside[-1:].any()
    np.not_equal(inside[1:], inside[:-1], out=turn[1:-1])
    turns = np.flatnonzero(turn)
    inner = bounds[(bounds > 0) & (bounds < len(raw))]
    joint = np.unique(inner[inside[inner - 1] & inside[inner]])  # a text that ends in a word, and the next begins with one
    if len(joint):
        turns = np.sort(np.concatenate([turns, joint, joint]))
    starts, ends = turns[0::2], turns[1::2]
    head = raw[starts]
    width = 1 + (head >= 0xC0).astype(np.int64) + (head >= 0xE0) + (head >= 0xF0)
    lone = ends - starts <= width  # one character is no word
    for i in range(4):
        inside[starts[lone & (width > i)] + i] = False
    starts, ends = starts[~lone], ends[~lone]
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
    words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(raw[inside]))
    return words, np.searchsorted(starts, bounds)


def rows_of(cuts: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))


def neighbours(cuts: np.ndarray) -> np.ndarray:
    """For each word but the last, whether the next one stands in the same text."""
    same = np.ones(max(int(cuts[-1]) - 1, 0), bool)
    inner = cuts[(cuts > 0) & (cuts < cuts[-1])]
    same[inner - 1] = False
    return same


class Numbering:
    """Numbers for the words of a list, and one more for all that are not on it. Stop words are left out."""

    def __init__(self, words: Sequence[str], stop_words: Sequence[str], edges: np.ndarray) -> None:
        stops = list(dict.fromkeys(stop_words))
        self.edges, self.stops = edges, len(stops)
        self.unknown = len(words)
        self.listed = pa.array([*stops, *words], pa.string())

    @cached_property
    def word(self) -> np.ndarray:
        return members(self.edges)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        words, cuts = cut(texts, self.word)
        found = pc.fill_null(pc.index_in(words, value_set=self.listed), len(self.listed)).to_numpy(zero_copy_only=False)
        left = found >= self.stops
        return found[left].astype(np.int64) - self.stops, np.concatenate([[0], np.cumsum(left)])[cuts]


def _runs(ordered: np.ndarray) -> np.ndarray:
    """Where runs of equal numbers begin, and the end."""
    first = np.flatnonzero(ordered[1:] != ordered[:-1]) + 1
    return np.concatenate([[0], first, [len(ordered)]]) if len(ordered) else np.zeros(1, np.int64)


def added(keys: np.ndarray, counts: Sequence[np.ndarray]) -> tuple[np.ndarray, ...]:
    """The distinct keys in order, and the sums of their counts."""
    order = np.argsort(keys)
    first = _runs(keys[order])[:-1]
    return keys[order[first]], *(np.add.reduceat(c[order], first) if len(first) else c[:0] for c in counts)


def in_texts(texts: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each key that occurs, the number of texts that hold it, and how often it occurs in all. There are fewer than 4,096
    texts, and the keys are below 2 ** 51."""
    both = np.sort(keys << 12 | texts)
    keys = both >> 12
    ends = _runs(keys)
    held = np.searchsorted(_runs(both)[:-1], ends)
    return keys[ends[:-1]], np.diff(held), np.diff(ends)
