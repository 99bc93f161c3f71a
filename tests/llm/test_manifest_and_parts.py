"""Piece encoding, the Merkle manifest and the fill-in-the-middle transformation, against libraries and plain loops."""

import hashlib
import random
import re
import zlib

import public_tokenizers
import pytest
import zstandard
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor

from faultline.llm import fill_in_middle as fim, merkle, piece_bpe
from faultline.llm.common import table

SF = "/root/testdata/sf0.001"
MODEL = public_tokenizers.path(piece_bpe.VOCABULARY)
LIBRARY = SentencePieceProcessor(model_file=MODEL)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- pieces ---------------------------------------------------------------------------------------------------------

_ALPHABET = [" ", "  ", "▁", "▁▁▁", "a", "the", " the", "\n", "é", "日本", "<s>", "<0x41>", "😀", ". The", "\t", "ﬁ", "1", "\0", "\r", "ב", "x', "]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(_ALPHABET), max_size=25).map("".join))
def test_ids_are_those_of_the_library(text):
    assert piece_bpe.pieces(MODEL).encode(text)[0] == LIBRARY.encode(text)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_ids_of_any_text(text):
    assert piece_bpe.pieces(MODEL).encode(text)[0] == LIBRARY.encode(text)


def test_both_agendas_and_all_splits_agree(monkeypatch):
    texts = [" ".join(random.Random(n).choices(["cat", "été", "x,", "the\nend", " 12", "ab1"], k=60)) for n in range(20)]
    for limit, splits in ((0, piece_bpe._SPLITS), (99, piece_bpe._SPLITS), (0, piece_bpe._SPLITS[2:]), (99, piece_bpe._SPLITS[1:])):
        monkeypatch.setattr(piece_bpe, "LIST", limit)
        monkeypatch.setattr(piece_bpe, "_SPLITS", splits)
        model = piece_bpe.Pieces(MODEL)
        assert [model.encode(t)[0] for t in texts] == LIBRARY.encode(texts)
        assert model.differing() == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(_ALPHABET), max_size=80).map("".join), st.integers(1, 30))
def test_parts_do_not_show(text, size):
    kept, piece_bpe.PART = piece_bpe.PART, size
    try:
        found = piece_bpe.digests(text, piece_bpe.pieces(MODEL))
    finally:
        piece_bpe.PART = kept
    ids = LIBRARY.encode(text)
    assert found == (len(ids), sha(",".join(map(str, ids))), sha(LIBRARY.decode(ids)))


def test_a_wrong_word_is_noticed():
    model = piece_bpe.Pieces(MODEL)
    model.encode("some words")
    model.fresh[0] = (model.fresh[0][0], (5,))
    assert model.differing()


ODD = [(1, None), (2, ""), (3, " "), (4, "a" * 30_000), (5, "the cat\n" * 30_000), (6, "中文。" * 20_000), (3, " "), (None, "no key"), (8, "<s>▁\0")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(k, t, 1, "x") for k, t in ODD], "doc_id long, text string, key int, n_tokens string")


def test_round_trip_of_odd_texts(odd):
    got = sorted((tuple(r) for r in piece_bpe.round_trip(odd).collect()), key=str)
    want = []
    for key, text in ODD:
        ids = LIBRARY.encode(text or "")
        want.append((key, len(ids), sha(",".join(map(str, ids))), sha(LIBRARY.decode(ids))))
    assert got == sorted(want, key=str)


def test_encode_and_decode(odd):
    encoded = piece_bpe.encode(odd)
    assert {r.doc_id: r.ids for r in encoded.filter("doc_id <> 3").collect()} == {
        k: LIBRARY.encode(t or "") for k, t in ODD if k not in (3, None)
    }
    back = {r.doc_id: r.text for r in piece_bpe.decode(encoded).collect()}
    assert back == {k: LIBRARY.decode(LIBRARY.encode(t or "")) for k, t in ODD}
    assert piece_bpe.round_trip(odd.limit(0)).count() == 0


def test_pieces_of_a_whole_table(spark):
    docs = table(spark, SF, "documents")
    got = {r.doc_id: tuple(r)[1:] for r in piece_bpe.op11_sentencepiece(spark, SF).collect()}
    for r in docs.collect():
        ids = LIBRARY.encode(r.text or "")
        assert got[r.doc_id] == (len(ids), sha(",".join(map(str, ids))), sha(LIBRARY.decode(ids)))


# --- manifest -------------------------------------------------------------------------------------------------------

_FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def plain_leaf(values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain_tree(nodes):
    """The top, and per node the digests before and after it on every level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for n, i in enumerate(at):
            run = nodes[i // 16 * 16 : i // 16 * 16 + 16]
            paths[n].append(("".join(run[: i % 16]), "".join(run[i % 16 + 1 :])))
        at = [i // 16 for i in at]
        nodes = [sha("".join(nodes[i : i + 16])) for i in range(0, len(nodes), 16)]
    return nodes[0], paths


def plain_manifest(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row[1], []).append(row)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for name in order:
        members = sorted(groups[name], key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r)))
        trees[name] = members, *plain_tree([plain_leaf(r) for r in members])
    root, above = plain_tree([trees[name][1] for name in order])
    found = []
    for name, last in zip(order, above):
        members, subroot, paths = trees[name]
        for row, path in zip(members, paths):
            path = path + last
            key = row[0]
            changed = row
            if key is not None and zlib.crc32(str(key).encode()) % 5 == 0 and row[4] is not None:
                changed = (*row[:4], re.sub("[A-Z]", lambda m: m.group().lower(), row[4]))
            now = plain_leaf(changed)
            for before, after in path:
                now = sha(before + now + after)
            proof = sha("".join(b + a for b, a in path))
            found.append((key, plain_leaf(row), subroot, root, proof, now, now == root))
    return sorted(found, key=str)


@pytest.mark.parametrize("sizes", [[1], [1, 1], [5, 16, 17, 1], [256, 257, 272, 3] + [1] * 17, [4200, 2]])
def test_manifest_of_sizes(spark, tmp_path, sizes):
    rows = [(g * 10_000 + i, f"s{g}é", "en" if i % 3 else None, i, f"Text {i}" if i % 7 else None) for g, n in enumerate(sizes) for i in range(n)]
    random.Random(1).shuffle(rows)
    frame = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    got = merkle.op12_merkle_manifest(spark, str(tmp_path)).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain_manifest(rows)


def test_manifest_of_odd_rows(spark, tmp_path):
    rows = [
        (1, None, None, None, None), (1, "", "", 0, ""), (1, "a", "x", 3, "Same"), (1, "a", "x", 3, "Same"), (1, "a", "x", 3, "same"),
        (None, "a", None, -5, "ÄÖ A\0"), (None, None, None, None, None), (10**12, "Z", "en", 1, "B" * 300_000), (-3, "+", "en", 1, "a:b"),
    ]
    frame = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    extra = frame.select("*", F.lit(1).alias("group"), F.lit(2).alias("place"), F.lit("x").alias("digest"))
    extra.write.parquet(f"{tmp_path}/documents.parquet")
    got = merkle.op12_merkle_manifest(spark, str(tmp_path)).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain_manifest(rows)
    assert merkle.manifest(extra.limit(0)).count() == 0


def test_places_do_not_depend_on_partitions(spark):
    frame = spark.range(3000).select((F.col("id") * 7919 % 3001).alias("key"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("group"))
    for parts in (1, 7):
        got = merkle.placed(frame.repartition(parts), ["key"]).filter("group = 'hot'").orderBy("key").collect()
        assert [r.place for r in got] == list(range(1000)) and {r.nodes for r in got} == {1000}


# --- fill in the middle ---------------------------------------------------------------------------------------------


def plain_fim(key, text, seed="7"):
    lines = re.findall("[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"{seed}:{'-' if key is None else key}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]
    if not text or re.search("<[PSM]>", text):
        return len(lines), "plain", None, None, text
    low, high = sorted((h[0] % (len(lines) + 1), h[1] % (len(lines) + 1)))
    prefix, middle, suffix = "".join(lines[:low]), "".join(lines[low:high]), "".join(lines[high:])
    spm = h[3] % 100 < 50
    output = f"<S>{suffix}<P>{prefix}<M>{middle}" if spm else f"<P>{prefix}<S>{suffix}<M>{middle}"
    return len(lines), "spm" if spm else "psm", len(prefix), len(middle), output


def test_parts_of_odd_texts(spark, odd, monkeypatch):
    more = [(20 + i, t) for i, t in enumerate(["\n", "\n\n\n", "a\r\nb", "x<P>y", "<", "P>\n<", "<S\n>", "é\n" * 9, "😀" * 70_000 + "\nend"])]
    frame = odd.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    got = fim.fill_in_middle(fim.frame_store(frame.select("*", F.lit(1).alias("frames"), F.lit(2).alias("form")))).collect()
    want = []
    for key, text in ODD + more:
        n, form, prefix, middle, output = plain_fim(key, text or "")
        want.append((key, n, form, prefix, middle, sha(output), sha(text or ""), output))
    assert sorted((tuple(r) for r in got), key=str) == sorted(want, key=str)
    assert fim.fill_in_middle(fim.frame_store(odd.limit(0))).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab\né<PS>M", max_size=40), st.integers(0, 10**6), st.integers(1, 8))
def test_frames_of_any_size(text, key, size):
    kept, fim.FRAME = fim.FRAME, size
    try:
        squeeze, expand = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()
        frames = fim.stored(text.encode(), squeeze)
        cut = fim.plan(key, frames, expand, "7", 100, 50)
        output = fim.frames_of(cut.output(frames, expand), squeeze)
        whole = b"".join(output.read(0, output.bytes[-1], expand)).decode()
        back = b"".join(fim.restored(output, cut.form, expand)).decode()
    finally:
        fim.FRAME = kept
    n, form, prefix, middle, expected = plain_fim(key, text)
    assert (frames.lines[-1], cut.form, whole, back) == (n, form, expected, text)
    if cut.cuts:
        assert (cut.cuts[0][1], cut.cuts[1][1] - cut.cuts[0][1]) == (prefix, middle)


def test_only_cut_frames_are_opened(monkeypatch):
    text = "".join(f"line {i}\n" for i in range(200_000)).encode()
    frames = fim.stored(text, zstandard.ZstdCompressor(level=1))
    assert len(frames.frames) > 20
    opened = []

    class Counting:
        def decompress(self, data):
            opened.append(data)
            return zstandard.ZstdDecompressor().decompress(data)

    at, chars = frames.cut(123_456, Counting())
    assert len(opened) == 1 and text[:at].count(b"\n") == 123_456 and chars == at


def test_a_share_of_texts_can_stay_plain(spark):
    frame = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("a\nb\nc").alias("text"))
    forms = {r.form: r["count"] for r in fim.fill_in_middle(fim.frame_store(frame), rate=50, suffix_first=0).groupBy("form").count().collect()}
    assert set(forms) == {"plain", "psm"} and 120 < forms["plain"] < 280
