"""Operator 5: packing documents into sequences of bounded length, online and in bounded space.

Every partition keeps a fixed number of open windows. A document's full windows go out at once; its rest goes to the
fullest open window that has room. When none has, the fullest window is emitted and a new one is opened. The windows
still open at the end of a partition are leftovers: those of a few partitions at a time are merged, by best fit in
decreasing length, so that neither a task nor the driver ever holds more than a fixed number of windows.

The placed pieces are written to the shared folder once. Both paths read that table, so a task that runs again cannot
place a document twice.
"""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F
from tokenizers import Tokenizer

from faultline.llm.common import Recent, byte_symbols, key_type, pick, table
from faultline.llm.pieces import pieces
from faultline.sources.shared import materialise

VOCABULARY = "word_bpe_49k.json"
LENGTH, END = 4096, 2

#: Open windows of a partition, and partitions whose leftovers meet in one task.
OPEN, MERGED = 32, 32


#: Characters that normalising only puts in lower case and that split in a plain way: ASCII and composed Latin letters.
_SIGNS = r"!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017e"
_SIMPLE, _SIMPLE_TEXT = re.compile(f"[{_SIGNS}]+"), re.compile(f"[ \t-\r{_SIGNS}]*")
#: The library's words of such characters.
_LETTERS = r"a-z\u00df-\u00f6\u00f8-\u017e"
_SPLIT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^ \t-\r0-9{_LETTERS}]+")

#: Words, and as many parts of texts, that a worker remembers per generation. There are two workers or more beside a JVM.
WORDS = 100_000


class Words:
    """Ids of texts by the library, whose merges see every distinct word only now and then.

    The vocabulary's normaliser and splitter treat white space as a border, so the ids of a text are those of its
    ASCII-blank-separated parts, one after the other. A text of plain letters, digits and marks is put in lower case and
    split here as a whole, and its words go through the library's model. Of any other text, plain parts do so too, and
    the rest goes through the whole library. Ids are little-endian bytes throughout.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # the cores belong to Spark's tasks
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.model = self.library.model
        self.signs = {byte: ord(sign) for sign, byte in byte_symbols().items()}
        self.words = Recent(self.word, WORDS).__getitem__
        self.parts = Recent(self.part, WORDS).__getitem__

    def word(self, text: str) -> bytes:
        signs = text if text.isascii() else text.encode().decode("latin-1").translate(self.signs)
        return b"".join([token.id.to_bytes(4, "little") for token in self.model.tokenize(signs)])

    def part(self, data: bytes) -> bytes:
        text = data.decode()
        if "<|" not in text and _SIMPLE.fullmatch(text):
            return b"".join(map(self.words, _SPLIT.findall(text.lower())))
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def piece(self, text: str) -> bytes:
        if "<|" not in text and _SIMPLE_TEXT.fullmatch(text):
            return b"".join(map(self.words, _SPLIT.findall(text.lower())))
        data = text.encode()
        parts = (data if b"<|" in data else data.lower()).split()  # special strings are matched before lower case
        return b"".join(map(self.parts, parts))

    def ids(self, text: str, end: int) -> np.ndarray:
        return np.frombuffer(b"".join([*map(self.piece, pieces(text)), end.to_bytes(4, "little")]), "<u4")


@lru_cache(maxsize=4)
def words(path: str) -> Words:
    return Words(path)


class Windows:
    """Open windows by fill; `put` returns the windows that it had to emit."""

    def __init__(self, length: int, limit: int | None) -> None:
        self.length, self.limit = length, limit
        self.order: list[tuple[int, int]] = []  # fill and number of each open window, ascending
        self.content: dict[int, list] = {}
        self.opened = 0

    def put(self, size: int, piece: tuple) -> list[tuple[int, list]]:
        emitted = []
        # Best fit: the fullest window that has room, the latest of equal ones.
        at = bisect_left(self.order, (self.length - size + 1, -1)) - 1
        if at >= 0:
            fill, number = self.order.pop(at)
        else:
            if self.limit and len(self.order) >= self.limit:
                emitted.append(self.take(len(self.order) - 1))
            fill, number, self.opened = 0, self.opened, self.opened + 1
            self.content[number] = []
        self.content[number].append((*piece, fill))
        if fill + size == self.length:
            emitted.append((number, self.content.pop(number)))
        else:
            insort(self.order, (fill + size, number))
        return emitted

    def take(self, at: int) -> tuple[int, list]:
        _, number = self.order.pop(at)
        return number, self.content.pop(number)

    def rest(self) -> list[tuple[int, list]]:
        return [self.take(0) for _ in range(len(self.order))]


def _fields(key: pa.DataType) -> list[tuple[str, pa.DataType]]:
    names = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    return [("key", key), *((n, pa.int64()) for n in names)]


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def pack(
    docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, length: int = LENGTH,
    end: int = END, open_windows: int = OPEN, merged: int = MERGED, keep_ids: bool = False,
) -> DataFrame:
    """One row per piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset, and `ids` if asked for.

    A document is its ids and then `end`; null and empty texts are that one id. Documents of at most `length` ids are
    never cut, longer ones only at multiples of it. Each id is in exactly one piece; sequences have no gaps and at most
    `length` ids. Repeated rows and keys are packed each; a null key stays null; an empty table gives no rows; other
    columns are ignored. Sequence ids are unique, not consecutive.
    """
    path = path or public_tokenizers.path(VOCABULARY)
    rows = pick(docs, key, text)
    kind, arrow_key = docs.schema[key].dataType.simpleString(), key_type(rows)
    ids_field = [("ids", pa.list_(pa.int32()))] if keep_ids else []
    ids_kind = ", ids array<int>" if keep_ids else ""
    columns = "key {0}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long{1}"
    final = pa.schema(_fields(arrow_key) + ids_field)
    placed = pa.schema(_fields(arrow_key) + ids_field + [("merge", pa.int64())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library, windows = words(path), Windows(length, open_windows)
        partition = TaskContext.get().partitionId()
        first, alone = partition << 33, iter(range(1, 1 << 32, 2))  # even numbers: windows, odd ones: full pieces

        def written(emitted: list, merge: int | None = None) -> list[tuple]:
            return [
                (*piece[:5], first | number * 2, piece[-1], *piece[5:-1], merge)
                for number, content in emitted
                for piece in content
            ]

        for batch in batches:
            out = []
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = library.ids(value.as_py(), end)
                for start in range(0, len(ids), length):
                    part = ids[start : start + length]
                    piece = (name, start, len(part), zlib.crc32(part.tobytes()), len(ids))
                    kept = (part.astype(np.int32),) if keep_ids else ()
                    if len(part) == length:
                        out.append((*piece, first | next(alone), 0, *kept, None))
                    else:
                        out += written(windows.put(len(part), (*piece, *kept)))
            yield _batch(out, placed)
        yield _batch(written(windows.rest(), partition // merged), placed)

    def merge(group: pa.Table) -> pa.Table:
        left = sorted(
            (tuple(r.values()) for r in group.to_pylist()), key=lambda r: (-r[2], str(r[0]), r[1], r[5], r[6])
        )
        windows, first = Windows(length, None), 1 << 62 | left[0][-1] << 33
        done = [w for row in left for w in windows.put(row[2], (*row[:5], *row[7:-1]))] + windows.rest()
        out = [(*p[:5], first | number, p[-1], *p[5:-1]) for number, content in done for p in content]
        return pa.Table.from_batches([_batch(out, final)])

    full_kind = columns.format(kind, ids_kind)
    pieces_ = materialise(rows.mapInArrow(place, f"{full_kind}, merge long"), "pieces")
    closed = pieces_.filter(F.col("merge").isNull()).drop("merge")
    leftover = pieces_.filter(F.col("merge").isNotNull()).groupBy("merge").applyInArrow(merge, full_kind)
    return closed.unionByName(leftover).withColumnRenamed("key", key)


def op5_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack(table(spark, folder, "documents"))
