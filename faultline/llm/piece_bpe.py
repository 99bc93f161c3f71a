"""Operator 11: SentencePiece encoding and decoding for merge-type vocabularies.

The library normalises the text. Its symbols are code points; an agenda holds the adjacent pairs whose concatenation is
a piece, best score first and from left to right among equal ones, and the best pair is merged until none is left. What
is then no piece of the vocabulary becomes the byte pieces of its UTF-8 form.

No piece of such a vocabulary has a space mark behind another character, or a Latin letter beside another sign, so no
merge runs across these borders. A normalised text is cut there, and the results of short words are kept per worker. Of
every Arrow batch the words that were merged anew are compared with the library's own ids, in one call, and all ids are
decoded by the library.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from operator import itemgetter

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from sentencepiece import SentencePieceProcessor

from faultline.llm.common import Recent, by_row, key_type, pick, table
from faultline.sources.shared import spread

VOCABULARY = "piece_bpe_32k.model"

#: The mark that stands for a space in pieces, and Latin letters.
SPACE, LATIN = "▁", "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u02af"
#: Borders of words, from the finest to none. A text is cut as a model's pieces allow.
_SPLITS = (
    f"{SPACE}*[{LATIN}]+|{SPACE}*[^{SPACE}{LATIN}]+|{SPACE}+",
    f"{SPACE}*[^{SPACE}]+|{SPACE}+",
    r"(?s).+",
)

#: Characters of a part, at least, before a long text is cut.
PART = 1 << 16

#: Symbols of a word up to which the agenda is a plain list.
LIST = 32

#: A single blank between two ASCII letters, digits or points, which no normalisation rule reads across.
_CUT = re.compile(r"(?<=[A-Za-z0-9.,]) (?=[A-Za-z0-9])")


#: The two parts of what is known of a word.
_IDS, _DECIMAL = itemgetter(0), itemgetter(1)


class _Numbers(dict):
    """Symbols by number. A character of no piece is -1 less its code point: no pair has such a number."""

    def __missing__(self, char: str) -> int:
        return -1 - ord(char)


class Pieces:
    """Encodes as the library would for one model file."""

    def __init__(self, path: str) -> None:
        self.library = SentencePieceProcessor(model_file=path)
        lib, self.size = self.library, self.library.vocab_size()
        size = self.size
        if any(map(lib.is_unused, range(size))) or sum(map(lib.is_byte, range(size))) != 256:
            raise ValueError("this needs a merge-type model with byte pieces and without unused ones")
        plain = [i for i in range(size) if not (lib.is_unknown(i) or lib.is_control(i) or lib.is_byte(i))]
        self.ids = {lib.id_to_piece(i): i for i in plain}
        self.bytes = [lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        order = {score: n for n, score in enumerate(sorted({lib.get_score(i) for i in plain}, reverse=True))}
        # A symbol is a piece or a character; characters of pieces that are no pieces themselves get numbers beyond.
        self.numbers = _Numbers(self.ids)
        for piece in self.ids:
            for char in piece:
                self.numbers.setdefault(char, size + len(self.numbers))
        self.others = {number: char for char, number in self.numbers.items() if number >= size}
        self.shift = (size + len(self.numbers)).bit_length()
        #: left << shift | right -> rank of the score << shift | merged
        self.pairs = {
            left << self.shift | right: order[lib.get_score(i)] << self.shift | i
            for piece, i in self.ids.items()
            for cut in range(1, len(piece))
            if (left := self.numbers.get(piece[:cut])) is not None and (right := self.numbers.get(piece[cut:])) is not None
        }
        self.ranks = {pair: found >> self.shift for pair, found in self.pairs.items()}
        # Where no two pieces have the same score, the rank tells what is merged.
        low = (1 << self.shift) - 1
        merged = {found >> self.shift: found & low for found in self.pairs.values()}
        self.merged = merged if len(merged) == len(set(self.pairs.values())) else None
        # Borders depend on two neighbouring characters only: a pattern is exact if it cuts no piece.
        fits = (re.compile(x).findall for x in _SPLITS)
        self.split = next(split for split in fits if all(len(split(piece)) == 1 for piece in self.ids))
        # A part starts with the mark that its blank would have been.
        by_word = len(self.split(f"a{SPACE}b")) == 2
        self.cuts = by_word and lib.normalize("a b") == f"{SPACE}a{SPACE}b" and lib.normalize("b") == f"{SPACE}b"
        self.words = Recent(self.word).__getitem__
        self.fresh: list[tuple[str, tuple[int, ...]]] = []  # merged since the last comparison

    def merge_short(self, symbols: list[int]) -> list[int]:
        """The agenda as a plain list beside the symbols: the first of its least entries is the best pair."""
        rank, pairs, shift, none, known = self.ranks.get, self.pairs, self.shift, 1 << 60, self.merged
        low = (1 << shift) - 1
        agenda = [rank(left << shift | right, none) for left, right in zip(symbols, symbols[1:])]
        while agenda and (best := min(agenda)) < none:
            at = agenda.index(best)
            merged = symbols[at] = known[best] if known else pairs[symbols[at] << shift | symbols[at + 1]] & low
            del symbols[at + 1], agenda[at]
            if at:
                agenda[at - 1] = rank(symbols[at - 1] << shift | merged, none)
            if at < len(agenda):
                agenda[at] = rank(merged << shift | symbols[at + 1], none)
        return symbols

    def merge_long(self, symbols: list[int]) -> list[int]:
        """The agenda as a heap over linked positions."""
        pair, shift, size = self.pairs.get, self.shift, len(symbols)
        low, bits = (1 << shift) - 1, size.bit_length()
        here = (1 << bits) - 1
        # An entry is the rank of the score, then the position in `bits` bits.
        agenda = [
            (found >> shift) << bits | at
            for at, (left, right) in enumerate(zip(symbols, symbols[1:]))
            if (found := pair(left << shift | right))
        ]
        heapq.heapify(agenda)
        after, before = [*range(1, size), -1], [*range(-1, size - 1)]
        gone = bytearray(size)
        pop, push = heapq.heappop, heapq.heappush
        while agenda:
            entry = pop(agenda)
            at = entry & here
            right = after[at]
            # Merged away since, or the pair has changed. A pair of equal score has an entry of its own just like this.
            if right < 0 or not (found := pair(symbols[at] << shift | symbols[right])) or found >> shift != entry >> bits:
                continue
            symbols[at] = merged = found & low
            after[at] = following = after[right]
            after[right], gone[right] = -1, 1
            if following >= 0:
                before[following] = at
                if found := pair(merged << shift | symbols[following]):
                    push(agenda, (found >> shift) << bits | at)
            if (previous := before[at]) >= 0 and (found := pair(symbols[previous] << shift | merged)):
                push(agenda, (found >> shift) << bits | previous)
        return [symbol for symbol, dead in zip(symbols, gone) if not dead]

    def word(self, text: str) -> tuple[tuple[int, ...], bytes]:
        """Ids, and the same as decimal numbers joined by commas."""
        symbols = list(map(self.numbers.__getitem__, text))
        found = self.merge_short(symbols) if len(symbols) <= LIST else self.merge_long(symbols)
        if min(found) < 0 or max(found) >= self.size:
            ids = []
            for symbol in found:
                if 0 <= symbol < self.size:
                    ids.append(symbol)
                else:
                    char = chr(-1 - symbol) if symbol < 0 else self.others[symbol]
                    ids += [self.bytes[b] for b in char.encode()]
            found = ids
        ids = tuple(found)
        self.fresh.append((text, ids))
        return ids, str(found)[1:-1].replace(" ", "").encode()

    def encode(self, part: str) -> tuple[list[int], bytes]:
        found = list(map(self.words, self.split(self.library.normalize(part))))
        return list(chain.from_iterable(map(_IDS, found))), b",".join(map(_DECIMAL, found))

    def differing(self) -> list[str]:
        """Of the words merged since the last call, those for which the library has other ids. A word with a mark is a
        text of its own; any other one stands behind a line feed, which no piece holds."""
        fresh, self.fresh = self.fresh, []
        if not self.cuts:
            return []
        texts = [text[1:] if text[0] == SPACE else f"\n{text}" for text, _ in fresh]
        start = len(self.library.encode("\n"))
        return [
            text
            for (text, ids), theirs in zip(fresh, self.library.encode(texts, num_threads=1))
            if tuple(theirs if text[0] == SPACE else theirs[start:]) != ids
        ]

    def parts(self, text: str) -> Iterator[str]:
        """Consecutive parts, joined by one blank each: the ids of the parts are the ids of the whole. A text without a
        safe place to cut stays one part."""
        start = 0
        while self.cuts and len(text) - start > PART and (found := _CUT.search(text, start + PART)):
            yield text[start : found.start()]
            start = found.end()
        yield text[start:] if start else text


@lru_cache(maxsize=4)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def digests(text: str, model: Pieces) -> tuple[int, str, str]:
    """Number of ids, SHA-256 of the decimal ids joined by commas, SHA-256 of the decoded text; part by part."""
    count, of_ids, of_text = 0, hashlib.sha256(), hashlib.sha256()
    for n, part in enumerate(model.parts(text)):
        ids, decimal = model.encode(part)
        of_ids.update(b"," + decimal if count and ids else decimal)
        decoded = model.library.decode(ids)
        of_text.update((f" {decoded}" if n else decoded).encode())
        count += len(ids)
    return count, of_ids.hexdigest(), of_text.hexdigest()


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(key, ids): the ids of every whole text, without begin and end.

    Null and empty texts have no ids. Repeated rows and keys give one row each; a null key stays null; an empty table
    gives no rows. Other columns are ignored, whatever their names. Long texts are encoded in parts. `path` must be
    readable on every executor.
    """
    path = path or public_tokenizers.path(VOCABULARY)
    rows = pick(docs, key, text)
    schema = pa.schema([("key", key_type(rows)), ("ids", pa.list_(pa.int32()))])

    def ids(value: str) -> tuple[list[int]]:
        model = pieces(path)
        return ([i for part in model.parts(value) for i in model.encode(part)[0]],)

    kind = docs.schema[key].dataType.simpleString()
    return rows.mapInArrow(by_row(ids, schema), f"key {kind}, ids array<int>").withColumnRenamed("key", key)


def decode(encoded: DataFrame, key: str = "doc_id", ids: str = "ids", path: str | None = None) -> DataFrame:
    """(key, text): the text that the library decodes from the ids of every row. Null and empty lists give no text."""
    path = path or public_tokenizers.path(VOCABULARY)
    kind = encoded.schema[key].dataType.simpleString()
    rows = encoded.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{ids}`"), F.array().cast("array<int>")).alias("ids"))
    schema = pa.schema([("key", key_type(rows)), ("text", pa.string())])
    texts = by_row(lambda value: (pieces(path).library.decode(value),), schema)
    name = "_text" if key == "text" else "text"
    return rows.mapInArrow(texts, f"key {kind}, text string").withColumnsRenamed({"text": name, "key": key})


def round_trip(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256): encode every whole text, decode the ids, keep digests of both.

    Same cases as `encode`; a text without ids has the digest of no bytes twice. If the library disagrees on a word of a
    batch, the model is not of the merge type and the job ends with an error.
    """
    path = path or public_tokenizers.path(VOCABULARY)
    kind = docs.schema[key].dataType.simpleString()
    rows = pick(spread(docs.select(*{key, text})), key, text)
    names = ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())
    schema = pa.schema([("key", key_type(rows)), *names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path)
        for batch in batches:
            found = [digests(text.as_py(), model) for text in batch.column(1)]
            if wrong := model.differing():
                raise ValueError(f"the library has other ids for {wrong[:3]!r}")
            columns = list(zip(*found)) if found else [()] * len(names)
            arrays = [pa.array(c, t) for c, (_, t) in zip(columns, names)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(schema.field(0).type), *arrays], schema=schema)

    columns = f"key {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return rows.mapInArrow(run, columns).withColumnRenamed("key", key)


def op11_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    return round_trip(table(spark, folder, "documents"))
