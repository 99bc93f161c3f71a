"""Operators on single texts: tokenizers, counts, secrets, packing."""

import base64
import hashlib
import json
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from faultline.llm import byte_bpe, packing, pieces, secrets, token_counts
from faultline.llm.common import table

SF = "/root/testdata/sf0.001"
RANKS, PATTERN = public_tokenizers.path(byte_bpe.RANKS), public_tokenizers.PATTERN

#: Null, empty, blank, odd white space, special strings, no white space, long.
TEXTS = [
    None, "", " ", "a", "\n\n a  b\t", "x\xa0y  z　1", "don't WE'LL <|endoftext|> <|startoftext|>x",
    "é" * 500, "a" * 5000, "ab1" * 40_000, "The end. " * 20_000, "中文，没有空格。" * 9_000, "\x1c\x85\x00 ß İ ſ Σς", "🙂🙂 ̈x",
]


@pytest.fixture(scope="module")
def odd(spark):
    """Odd texts, a repeated row, a null key, and columns whose names the operators use inside."""
    rows = [(i, t, "k", 1) for i, t in enumerate(TEXTS)] + [(3, "a", "k", 1), (None, "null key", None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, key string, n_tokens int")


def text_by_id(odd):
    return [(r.doc_id, r.text or "") for r in odd.collect()]


def test_pieces_do_not_change_ids():
    encode = byte_bpe.encoding(RANKS, PATTERN).encode_ordinary
    for text in TEXTS:
        for size in (3, 50, 1000):
            if text and len(text) < 6000:
                assert [i for p in pieces.pieces(text, size) for i in encode(p)] == encode(text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab1 \n'st.,é中，\xa0!", max_size=60))
def test_pieces_of_any_text(text):
    encode = byte_bpe.encoding(RANKS, PATTERN).encode_ordinary
    assert "".join(pieces.pieces(text, 4)) == text
    assert [i for p in pieces.pieces(text, 4) for i in encode(p)] == encode(text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="a1 \n\x85\x1c\xa0'.\u3000", max_size=40))
def test_long_blanks_of_any_text(text):
    library = byte_bpe.encoding(RANKS, PATTERN)
    parts = list(pieces.long_blanks(text, 3))
    assert "".join(p for p, _ in parts) == text
    ids = [i for p, whole in parts for i in (library._encode_single_piece if whole else library.encode_ordinary)(p)]
    assert ids == library.encode_ordinary(text)


@pytest.mark.parametrize("blank", [" ", "\n"])
def test_two_million_blanks(blank):
    text = "a" + blank * 2_000_000 + "b"
    n, _, of_bytes = byte_bpe.digests(text, RANKS, PATTERN)
    assert n and of_bytes == hashlib.sha256(text.encode()).hexdigest()


def test_round_trip(odd):
    got = sorted(map(tuple, byte_bpe.round_trip(odd).collect()), key=str)
    want = []
    for key, text in text_by_id(odd):
        ids = byte_bpe.encoding(RANKS, PATTERN).encode_ordinary(text)
        joined = " ".join(map(str, ids)).encode()
        want.append((key, len(ids), hashlib.sha256(joined).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert got == sorted(want, key=str)


def test_decode_gives_the_bytes_back(odd):
    back = byte_bpe.decode(byte_bpe.encode(odd)).collect()
    assert sorted((str(r.doc_id), bytes(r.data).decode()) for r in back) == sorted((str(k), t) for k, t in text_by_id(odd))


def test_counts_are_the_library_s(odd, spark):
    library = Tokenizer.from_file(public_tokenizers.path(token_counts.VOCABULARY))
    want = [(k, len(t.encode()), n := len(library.encode(t, add_special_tokens=False).ids), n > 512) for k, t in text_by_id(odd)]
    assert sorted(map(tuple, token_counts.count_tokens(odd).collect()), key=str) == sorted(want, key=str)
    docs = table(spark, SF, "documents")
    got = {r.doc_id: r.n_tokens for r in token_counts.op4_token_counts(spark, SF).collect()}
    assert got == {r.doc_id: len(library.encode(r.text, add_special_tokens=False).ids) for r in docs.collect()}


@settings(max_examples=500, deadline=None)
@given(st.text(max_size=40))
def test_counts_of_any_text(text):
    library = Tokenizer.from_file(public_tokenizers.path(token_counts.VOCABULARY))
    counter = token_counts.counter(public_tokenizers.path(token_counts.VOCABULARY))
    assert counter.count(text) == len(library.encode(text, add_special_tokens=False).ids)


def test_empty_tables(odd):
    none = odd.limit(0)
    for fn in (byte_bpe.round_trip, byte_bpe.encode, token_counts.count_tokens, secrets.find_secrets, packing.pack, secrets.redact):
        assert fn(none).collect() == []


# --- secrets --------------------------------------------------------------------------------------------------------


def der(tag, *parts):
    body = b"".join(parts)
    size = bytes([len(body)]) if len(body) < 128 else (lambda n: bytes([0x80 | len(n)]) + n)(len(body).to_bytes((len(body).bit_length() + 7) // 8))
    return bytes([tag]) + size + body


def integer(n):
    return der(2, n.to_bytes(n.bit_length() // 8 + 1))


RSA = der(0x30, integer(0), *[integer((1 << 512) + i) for i in range(8)])
OID = der(6, bytes.fromhex("2b6570"))
PKCS8 = der(0x30, integer(0), der(0x30, OID), der(4, der(4, bytes(range(32)))))
PUBLIC = der(0x30, der(0x30, OID), der(3, b"\0" + bytes(range(64))))


def b64url(value):
    return base64.urlsafe_b64encode(value).decode().rstrip("=")


TOKEN = ".".join(b64url(x) for x in (json.dumps({"alg": "HS256"}).encode(), json.dumps({"sub": 1}).encode(), bytes(range(32))))


def kinds(text):
    return [(k, text[a:b]) for k, a, b in secrets.spans(text) if k not in secrets.BASE]


def test_structures_are_confirmed():
    for key in (RSA, PKCS8):
        plain = base64.b64encode(key).decode()
        assert kinds(f"see {plain} here") == [("key", plain)]
        assert kinds(f"hex {key.hex().upper()}.") == [("key", key.hex().upper())]
        armor = f"-----BEGIN PRIVATE KEY-----\n{plain[:40]}\n{plain[40:]}\n-----END PRIVATE KEY-----"
        assert kinds(f"a {armor} b")[0] == ("pem", armor)
    assert kinds(f"jwt {TOKEN}!") == [("token", TOKEN)]


@pytest.mark.parametrize("width", [64, 76])
def test_wrapped_keys_without_armour(width):
    def wrap(text, end="\n"):
        return end.join(text[i : i + width] for i in range(0, len(text), width))

    def field(data):
        return len(data).to_bytes(4) + data

    openssh = b"openssh-key-v1\0" + field(b"none") * 2 + field(b"") + (1).to_bytes(4) + field(b"p" * 51) + field(b"s" * 136)
    for data in (RSA, openssh):
        for end in ("\n", "\r\n"):
            key = wrap(base64.b64encode(data).decode(), end)
            assert [x for x in kinds(f"see\n{key}\nwords of prose") if x[0] == "key"] == [("key", key)]
            assert [k for k, _ in kinds(f"{key}\n{key}\n")] == ["key", "key"]
    key = wrap(RSA.hex())
    assert ("key", key) in kinds(f"see\n{key}\n")
    assert not kinds(wrap(base64.b64encode(RSA[:-1]).decode()))
    armour = f"-----BEGIN PRIVATE KEY-----\\r\\n{wrap(base64.b64encode(PKCS8).decode(), chr(92) + 'r' + chr(92) + 'n')}\\r\\n-----END PRIVATE KEY-----"
    assert ("pem", armour) in kinds(armour)
    whole = f"-----BEGIN RSA PRIVATE KEY-----\n{wrap(base64.b64encode(RSA).decode())}\n-----END RSA PRIVATE KEY-----"
    assert kinds(whole) == [("pem", whole)]


def test_near_misses_are_not_reported():
    broken = base64.b64encode(RSA[:-1]).decode()
    unsigned = ".".join([b64url(b'{"alg":"none"}'), *TOKEN.split(".")[1:]])
    no_header = ".".join([b64url(b'{"typ":"JWT"}'), *TOKEN.split(".")[1:]])
    for text in (broken, base64.b64encode(PUBLIC).decode(), unsigned, no_header, "M" * 200, "ey" * 300 + "." * 3):
        assert kinds(f"x {text} y") == []


def plain_base(text):
    """The contract's patterns, run as they are written."""
    found = []
    pattern = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    found += [("assign", m.start(), m.end()) for m in pattern.finditer(text) if len(m[2]) >= 6]
    found += [("access", m.start(), m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    return found + [("hex", m.start(), m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["token", "SECRET", "api_key", "apikey", "=", ":", " ", '"', "AKIA", "ABCDEFGHIJKLMNOP1234", "deadbeef01234567", "x", "é", "ſecret", "K", "."]), max_size=14))
def test_base_spans(parts):
    text = "".join(parts)
    assert sorted(secrets.base_spans(text)) == sorted(plain_base(text))


def test_secret_query(spark):
    docs = {r.doc_id: r.text or "" for r in table(spark, SF, "documents").collect()}
    order = {k: i for i, k in enumerate(secrets.KINDS)}
    for r in secrets.op3_secret_scans(spark, SF).collect():
        base = sorted(plain_base(docs[r.doc_id]), key=lambda s: (s[1], order[s[0]]))
        written = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r.base_sha256 == hashlib.sha256(written.encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s[0] == k for s in base) for k in secrets.BASE)
        assert set(written.split(",")) <= set(r.spans.split(","))


def test_redaction_keeps_rows_and_columns(spark):
    rows = [(1, f"a token = {'f' * 30} b", 5), (2, None, 5), (3, "clean", 5), (3, "clean", 5)]
    got = secrets.redact(spark.createDataFrame(rows, "doc_id int, text string, spans int"))
    assert got.columns == ["doc_id", "text", "spans"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, "a [secret] b", 5), (2, None, 5), (3, "clean", 5), (3, "clean", 5)], key=str)


# --- packing --------------------------------------------------------------------------------------------------------


def check_packing(rows, texts, length, library):
    pieces_of, sequences = {}, {}
    for r in rows:
        pieces_of.setdefault((r.doc_id, r.doc_tokens), []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    assert sum(r.length for r in rows) == sum(len(ids) for _, ids in texts)
    for key, ids in texts:
        mine = pieces_of[(key, len(ids))]
        copies = sum(k == key and len(i) == len(ids) for k, i in texts)
        starts = sorted((r.start, r.length) for r in mine)
        assert starts == sorted((s, min(length, len(ids) - s)) for s in range(0, len(ids), length)) and copies == 1 or copies > 1
        for r in mine:
            part = np.array(ids[r.start : r.start + r.length], "<u4")
            assert copies > 1 or zlib.crc32(part.tobytes()) == r.ids_crc32
    for mine in sequences.values():
        at = 0
        for r in sorted(mine, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= length
    return sequences


def test_workers_remember_a_bounded_number_of_words():
    """Two generations of 100,000 words and parts each, since several workers share the memory of an executor."""
    library = packing.Words(public_tokenizers.path(packing.VOCABULARY))
    for recent in (library.words.__self__, library.parts.__self__):
        recent.fn = lambda text: b""
        for i in range(350_000):
            recent[str(i)]
        assert len(recent) + len(recent.before) <= 200_000


def test_packing(odd, spark):
    library = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    texts = [(k, [*library.encode(t, add_special_tokens=False).ids, 2]) for k, t in text_by_id(odd)]
    for length, open_windows in ((64, 2), (4096, 32)):
        rows = packing.pack(odd.repartition(3), length=length, open_windows=open_windows, merged=2).collect()
        check_packing(rows, texts, length, library)


def test_packing_of_documents(spark):
    library = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    texts = [(r.doc_id, [*library.encode(r.text or "", add_special_tokens=False).ids, 2]) for r in table(spark, SF, "documents").collect()]
    rows = packing.op5_packing(spark, SF).collect()
    sequences = check_packing(rows, texts, 4096, library)
    total = sum(len(i) for _, i in texts)
    assert len(sequences) <= total / 4096 * 1.1 + 2


def test_packing_gives_the_ids(spark):
    docs = spark.createDataFrame([(1, "one two three " * 50)], "doc_id int, text string")
    rows = packing.pack(docs, length=16, keep_ids=True).orderBy("start").collect()
    library = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    assert [i for r in rows for i in r.ids] == [*library.encode("one two three " * 50, add_special_tokens=False).ids, 2]


def test_windows_are_best_fit_and_bounded():
    windows = packing.Windows(10, 2)
    assert windows.put(6, ("a",)) == [] and windows.put(7, ("b",)) == []
    assert windows.put(3, ("c",)) == [(1, [("b", 0), ("c", 7)])]  # fits both, fills the fuller one
    assert windows.put(9, ("d",)) == []
    assert windows.put(8, ("e",)) == [(2, [("d", 0)])]  # none has room: the fullest goes
    assert [n for n, _ in windows.rest()] == [0, 3]


def der(tag, *parts):
    body = b"".join(parts)
    size = len(body).to_bytes(4).lstrip(b"\0") or b"\0"
    return bytes([tag]) + (size if len(body) < 0x80 else bytes([0x80 | len(size)]) + size) + body


@pytest.mark.parametrize("hexed", [False, True])
@pytest.mark.parametrize("claim", ["sequence", "algorithm"])
def test_heads_that_claim_all_lines_take_linear_time(hexed, claim):
    """Each line begins like a key that ends where the text does, and its elements do not fit."""
    n, width = 32_768, 64
    size = width // 2 if hexed else width // 4 * 3
    lines = []
    for i in range(n):
        left = (n - i) * size
        head = b"\x30\x83" + (left - 5).to_bytes(3) + (b"\x02\x01\x00\x30\x83" + max(left - 300, 128).to_bytes(3) + b"\x06\x01\x01" if claim == "algorithm" else b"\x02\x01\x00")
        raw = head + b"\x05\x00" * size
        lines.append(raw[:size].hex() if hexed else base64.b64encode(raw[:size]).decode())
    start = time.process_time()
    assert list(secrets._wrapped("\n".join(lines))) == []
    assert time.process_time() - start < 20


@pytest.mark.parametrize("hexed", [False, True])
@pytest.mark.parametrize("extra", range(6))
def test_wrapped_keys_are_found_at_any_length(hexed, extra):
    number = der(0x02, b"\x01" * 40)
    key = der(0x30, der(0x02, b"\0"), der(0x02, b"\x05" * (64 + extra)), *[number] * 7)
    pkcs8 = der(0x30, der(0x02, b"\0"), der(0x30, der(0x06, b"*\x86H"), b"\x05\0"), der(0x04, key))
    for data in (key, pkcs8):
        encoded = data.hex() if hexed else base64.b64encode(data).decode()
        text = "Here:\n" + "\n".join(encoded[i : i + 64] for i in range(0, len(encoded), 64)) + "\nend"
        assert [(a, b) for kind, a, b in secrets.confirmed_spans(text) if kind == "key"][:1] == [(6, len(text) - 4)]
        assert secrets.is_der_key(data) and not secrets.is_der_key(data + b"\0") and not secrets.is_der_key(data[:-1])
