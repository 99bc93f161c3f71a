"""Operator 13: fill-in-the-middle transformation over seekable compressed frames.

A text is stored as independent zstandard frames of whole lines, with cumulative numbers of lines, characters and bytes.
To choose the parts, only the frames that the two cuts fall into are decompressed; outputs and restored texts are
streams of ordered frames, so a task holds one compressed text and one frame, whatever the length of the text.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from faultline.llm.common import key_type, table, text_of
from faultline.sources.shared import spread

#: Bytes of a frame, at least, but for the last one; a frame ends with a line.
FRAME = 1 << 16

#: Marks of the three parts in an output.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"

#: Salt of the draws, and the shares of transformed texts and, of these, of suffix-first ones, in percent.
SEED, RATE, SUFFIX_FIRST = "7", 100, 50

STORE = "lines array<long>, chars array<long>, bytes array<long>, frames array<binary>"


@dataclass
class Frames:
    """Frames, and the numbers of lines, characters and bytes before each of them and at the end."""

    lines: list[int] = field(default_factory=lambda: [0])
    chars: list[int] = field(default_factory=lambda: [0])
    bytes: list[int] = field(default_factory=lambda: [0])
    frames: list[bytes] = field(default_factory=list)

    def add(self, data: bytes, squeeze: zstandard.ZstdCompressor) -> None:
        """One more frame. A line ends with a line feed or with the text."""
        self.lines.append(self.lines[-1] + data.count(b"\n") + (not data.endswith(b"\n")))
        self.chars.append(self.chars[-1] + len(data.decode()))
        self.bytes.append(self.bytes[-1] + len(data))
        self.frames.append(squeeze.compress(data))

    def read(self, start: int, end: int, expand: zstandard.ZstdDecompressor) -> Iterator[bytes]:
        """The bytes of a range, frame by frame; frames outside of it are not touched."""
        at = bisect_right(self.bytes, start) - 1
        while start < end:
            data = expand.decompress(self.frames[at])
            lo, stop = start - self.bytes[at], min(end, self.bytes[at + 1])
            yield data[lo : stop - self.bytes[at]]
            start, at = stop, at + 1

    def cut(self, line: int, expand: zstandard.ZstdDecompressor) -> tuple[int, int]:
        """Bytes and characters before a line; one frame at most is decompressed."""
        at = bisect_right(self.lines, line) - 1
        left = line - self.lines[at]
        if not left:
            return self.bytes[at], self.chars[at]
        data = expand.decompress(self.frames[at])
        size = int(np.flatnonzero(np.frombuffer(data, np.uint8) == 10)[left - 1]) + 1
        return self.bytes[at] + size, self.chars[at] + len(data[:size].decode())


def stored(data: bytes, squeeze: zstandard.ZstdCompressor) -> Frames:
    found, start = Frames(), 0
    while start < len(data):
        end = data.find(b"\n", start + FRAME - 1) + 1 or len(data)
        found.add(data[start:end], squeeze)
        start = end
    return found


def draws(key: object, seed: str) -> list[int]:
    """Four numbers of 32 bits from the key; a null key has those of `-`."""
    digest = hashlib.sha256(f"{seed}:{'-' if key is None else key}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


def holds(chunks: Iterable[bytes], marks: tuple[bytes, ...]) -> bool:
    """Whether a stream holds one of the marks, across the borders of chunks too."""
    tail, keep = b"", max(map(len, marks)) - 1
    for chunk in chunks:
        seen = tail + chunk
        if any(mark in seen for mark in marks):
            return True
        tail = seen[-keep:]
    return False


@dataclass(frozen=True)
class Plan:
    """How a stored text is cut: the form, and where prefix and middle end, in bytes and characters."""

    form: str
    cuts: tuple[tuple[int, int], tuple[int, int]] | None

    def output(self, text: Frames, expand: zstandard.ZstdDecompressor) -> Iterator[bytes]:
        """The output as a stream of chunks."""
        end = text.bytes[-1]
        if self.cuts is None:
            yield from text.read(0, end, expand)
            return
        (first, _), (second, _) = self.cuts
        parts = [(PREFIX, 0, first), (SUFFIX, second, end), (MIDDLE, first, second)]
        for mark, lo, hi in parts if self.form == PSM else [parts[1], parts[0], parts[2]]:
            yield mark
            yield from text.read(lo, hi, expand)


def plan(key: object, text: Frames, expand: zstandard.ZstdDecompressor, seed: str, rate: int, suffix_first: int) -> Plan:
    h1, h2, h3, h4 = draws(key, seed)
    n = text.lines[-1]
    if not n or h3 % 100 >= rate or holds(text.read(0, text.bytes[-1], expand), (PREFIX, SUFFIX, MIDDLE)):
        return Plan(PLAIN, None)
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    return Plan(SPM if h4 % 100 < suffix_first else PSM, (text.cut(low, expand), text.cut(high, expand)))


def frames_of(chunks: Iterable[bytes], squeeze: zstandard.ZstdCompressor) -> Frames:
    """Any stream of bytes as frames; only the numbers of bytes mean anything, as chunks may end within characters."""
    found = Frames()
    for chunk in chunks:
        if chunk:
            found.bytes.append(found.bytes[-1] + len(chunk))
            found.frames.append(squeeze.compress(chunk))
    return found


def _places(output: Frames, marks: tuple[bytes, ...], expand: zstandard.ZstdDecompressor) -> list[int]:
    """Where each mark first stands in the output."""
    found, tail, at = dict.fromkeys(marks, -1), b"", 0
    for chunk in output.read(0, output.bytes[-1], expand):
        seen = tail + chunk
        for mark in marks:
            if found[mark] < 0 and (here := seen.find(mark)) >= 0:
                found[mark] = at - len(tail) + here
        at, tail = at + len(chunk), seen[-2:]
    return [found[mark] for mark in marks]


def restored(output: Frames, form: str, expand: zstandard.ZstdDecompressor) -> Iterator[bytes]:
    """The text, from an output and its form alone: the marks are searched for, their parts put in order."""
    end = output.bytes[-1]
    if form == PLAIN:
        yield from output.read(0, end, expand)
        return
    prefix, suffix, middle = _places(output, (PREFIX, SUFFIX, MIDDLE), expand)
    yield from output.read(prefix + 3, suffix if form == PSM else middle, expand)
    yield from output.read(middle + 3, end, expand)
    yield from output.read(suffix + 3, middle if form == PSM else prefix, expand)


def frame_store(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lines, chars, bytes, frames): every whole text as frames, with the numbers before each frame and at the
    end. Null and empty texts have no frames. Rows with equal keys are stored each; a null key stays null; an empty
    table gives no rows; other columns are ignored. Can be written as a table and read by `fill_in_middle`.
    """
    rows = spread(docs.select(*{key, text})).select(F.col(f"`{key}`").alias("key"), text_of(text).alias("text"))
    kind, arrow_key = docs.schema[key].dataType.simpleString(), key_type(rows)
    longs, parts = pa.list_(pa.int64()), pa.list_(pa.binary())
    schema = pa.schema([("key", arrow_key), ("lines", longs), ("chars", longs), ("bytes", longs), ("frames", parts)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            found = [stored(value.as_py().encode(), squeeze) for value in batch.column(1)]
            columns = [pa.array([getattr(f, name) for f in found], schema.field(name).type) for name in schema.names[1:]]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(arrow_key), *columns], schema=schema)

    return rows.mapInArrow(run, f"key {kind}, {STORE}").withColumnRenamed("key", key)


def fill_in_middle(
    store: DataFrame, key: str = "doc_id", seed: str = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST, texts: bool = True
) -> DataFrame:
    """One row per row of a frame store: key, n (lines), form, prefix_chars, middle_chars, output_sha256,
    restored_sha256, and the `output` itself if `texts`.

    The draws depend on seed and key alone. A text that is empty, is not drawn, or holds a mark of its own is plain: the
    output is the text and the two lengths are null. Cuts fall between lines; either part may be empty. Repeated rows
    give equal rows. The text is rebuilt from the output and its form.
    """
    kind, arrow_key = store.schema[key].dataType.simpleString(), key_type(store.select(F.col(f"`{key}`").alias("key")))
    rows = store.select(F.col(f"`{key}`").alias("key"), "lines", "chars", "bytes", "frames")
    fields = [("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()),
              ("output_sha256", pa.string()), ("restored_sha256", pa.string())]
    kinds = "n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"
    schema = pa.schema([("key", arrow_key), *fields, *([("output", pa.string())] if texts else [])])

    def row(name: object, text: Frames, squeeze: zstandard.ZstdCompressor, expand: zstandard.ZstdDecompressor) -> tuple:
        cut = plan(name, text, expand, seed, rate, suffix_first)
        output = frames_of(cut.output(text, expand), squeeze)
        of_output, of_text = hashlib.sha256(), hashlib.sha256()
        for chunk in output.read(0, output.bytes[-1], expand):
            of_output.update(chunk)
        for chunk in restored(output, cut.form, expand):
            of_text.update(chunk)
        (_, first), (_, second) = cut.cuts or ((0, None), (0, None))
        found = text.lines[-1], cut.form, first, None if second is None else second - first, of_output.hexdigest(), of_text.hexdigest()
        return (*found, b"".join(output.read(0, output.bytes[-1], expand)).decode()) if texts else found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze, expand = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()
        for batch in batches:
            found = []
            for i in range(batch.num_rows):
                name, *numbers = (batch.column(c)[i].as_py() for c in range(5))
                found.append((name, *row(name, Frames(*numbers), squeeze, expand)))
            columns = list(zip(*found)) if found else [()] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return rows.mapInArrow(run, f"key {kind}, {kinds}{', output string' if texts else ''}").withColumnRenamed("key", key)


def op13_fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    return fill_in_middle(frame_store(table(spark, folder, "documents")), texts=False)


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u,
             sha256('7:' || coalesce(doc_id::VARCHAR, '-')) AS h FROM documents),
h AS (SELECT *, len(u) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3,
        ('0x' || h[25:32])::BIGINT AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
        CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain'
          WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, array_to_string(u[:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle, array_to_string(u[b + 1:], '') AS suffix FROM c),
o AS (SELECT *, CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END AS output FROM p),
r AS (SELECT *, CASE form WHEN 'plain' THEN output
        WHEN 'psm' THEN string_split(output[4:], '<S>')[1] || string_split(output, '<M>')[2] || string_split(string_split(output, '<S>')[2], '<M>')[1]
        ELSE string_split(string_split(output, '<P>')[2], '<M>')[1] || string_split(output, '<M>')[2] || string_split(output[4:], '<P>')[1]
        END AS restored FROM o)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix)::BIGINT END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(middle)::BIGINT END AS middle_chars, sha256(output) AS output_sha256, sha256(restored) AS restored_sha256
FROM r
"""
