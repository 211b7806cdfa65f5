import zlib

import pytest

from folioquery.functions import crypt, filters
from folioquery.functions.cos import Keyword, Name, Ref, Stream, number, read, text_string
from folioquery.functions.fonts import CMap, ENCODINGS, standard_width, style_flags, text_of_name, type1_encoding, undo_private
from folioquery.functions.page_ops import operations


@pytest.mark.parametrize(("word", "value"), [(b"42", 42), (b"-3", -3), (b"+17", 17), (b".5", 0.5), (b"4.", 4.0), (b"--0.5", -0.5), (b"+", 0.0), (b".", 0.0), (b"1e5", 1e5), (b"x1", None), (b"9999999999999999999", 1e19)])
def test_numbers(word, value):
    assert number(word) == value and type(number(word)) is type(value)


@pytest.mark.parametrize(
    ("data", "value"),
    [(b"/A#20B", Name("A B")), (b"/", Name("")), (b"(a(b)c)", b"a(b)c"), (rb"(a\)b)", b"a)b"), (rb"(\101\12)", b"A\n"), (b"<48 65 6c>", b"Hel"), (b"<484>", b"H@"), (b"12 0 R", Ref(12, 0)), (b"true", True), (b"null", None), (b"<</A 1/B[2 3]>>", {"A": 1, "B": [2, 3]}), (b"[1 2 0 R /X (s)]", [1, Ref(2, 0), "X", b"s"])],
)
def test_objects(data, value):
    assert read(data)[0] == value


def test_nesting_ends():
    for piece in (b"[", b"<</A ", b"{"):
        read(piece * 100_000)
    depth, obj = 0, read(b"[" * 100 + b"]" * 100)[0]
    while obj:
        depth, obj = depth + 1, obj[0]
    assert depth == 99
    assert read(b"")[0] == Keyword(b"")


def test_text_strings():
    assert text_string(b"\xfe\xff\xd8\x35\xdc\x00") == "\U0001d400"
    assert text_string(b"\xff\xfeA\0") == "A"
    assert text_string(b"\xef\xbb\xbf\xc3\xa9") == "é"
    assert text_string(b"\x93\x85\xa0\xe9") == "ﬁ–€é"


def test_filters():
    assert filters.ascii85(b"87cURD_*#T~>") == b"Hello, w"
    assert filters.ascii85(b"z~>") == bytes(4)
    assert filters.run_length(bytes([1, 97, 98, 253, 255, 128])) == b"ab" + b"\xff" * 4
    assert filters.ascii_hex(b"48 65>") == b"He"
    assert filters.lzw(bytes([0x80, 0x0B, 0x60, 0x50, 0x22, 0x0C, 0x0C, 0x85, 0x01])) == bytes([45, 45, 45, 45, 45, 65, 45, 45, 45, 66])
    data = zlib.compress(b"some text that is long enough " * 50)
    assert filters.flate(data) == b"some text that is long enough " * 50
    cut = filters.flate(data[: len(data) - 12])
    assert cut and (b"some text that is long enough " * 50).startswith(cut)
    assert filters.predict(b"\x02\x01\x02\x03\x02\x01\x01\x01", {"Predictor": 12, "Columns": 3}) == bytes([1, 2, 3, 2, 3, 4])
    assert filters.decode(Stream({"Filter": Name("DCTDecode")}, b"jpg")) == (b"jpg", "DCTDecode")
    with pytest.raises(filters.FilterError):
        filters.decode(Stream({"Filter": Name("Nope")}, b""))


def test_ciphers():
    assert crypt.rc4(b"Key", b"Plaintext").hex() == "bbf316e8d940af0ad3"
    key, plain = bytes.fromhex("000102030405060708090a0b0c0d0e0f"), bytes.fromhex("00112233445566778899aabbccddeeff")
    assert crypt.aes_cbc(key, bytes(16), plain, True).hex() == "69c4e0d86a7b0430d8cdb78070b4c55a"
    assert crypt.aes_cbc(key, bytes(16), bytes.fromhex("69c4e0d86a7b0430d8cdb78070b4c55a"), False) == plain
    key = bytes(range(32))
    assert crypt.aes_cbc(key, bytes(16), plain, True).hex() == "8ea2b7ca516745bfeafc49904b496089"
    iv = bytes(16)
    padded = b"hello" + bytes([11]) * 11
    assert crypt.aes_data(key, iv + crypt.aes_cbc(key, iv, padded, True)) == b"hello"
    assert crypt.aes_data(key, b"short") == b""


@pytest.mark.parametrize("revision", [5, 6])
def test_version_5_keys(revision):
    pw, file_key = b"secret", bytes(range(32))
    digest = crypt.hash_r6 if revision == 6 else lambda p, s, u=b"": __import__("hashlib").sha256(p + s + u).digest()
    vs, ks = b"valsalt1", b"keysalt1"
    u = digest(pw, vs) + vs + ks
    ue = crypt.aes_cbc(digest(pw, ks), bytes(16), file_key, True)
    d = {"Filter": "Standard", "V": 5, "R": revision, "U": u, "UE": ue, "O": bytes(48), "OE": bytes(32)}
    assert crypt.Decryptor(d, b"", "secret").key == file_key
    with pytest.raises(crypt.PasswordError):
        crypt.Decryptor(d, b"", "wrong")
    with pytest.raises(crypt.UnsupportedEncryption):
        crypt.Decryptor({"Filter": "Other"}, b"", None)


# What the format, its encodings and its fonts define.
def test_fonts():
    assert [text_of_name(n) for n in ("bracketrightbt", "arrowvertex", "bracex", "ffiBig", "integraldisplay.alt", "ABig", "u1D400")] == ["", "", None, "ffi", "∫", None, "\U0001d400"]
    assert [text_of_name(n) for n in ("uni00660066", "one.oldstyle", "parenleftBigg", "parenlefttp", "parenleftex", "summationdisplay", ".notdef", "Ecircumflex")] == ["ff", "1", "(", "(", "", "∑", None, "Ê"]
    assert (ENCODINGS["StandardEncoding"][0x27], ENCODINGS["WinAnsiEncoding"][0x27], ENCODINGS["MacRomanEncoding"][0x8E], ENCODINGS["Symbol"][0x61], ENCODINGS["WinAnsiEncoding"][0xA0]) == ("’", "'", "é", "α", "")
    assert [standard_width("Helvetica", c) for c in ("A", "i", "W", " ", "é")] == [667, 222, 944, 278, None]
    assert standard_width("Courier", "x") == 600 and standard_width("Symbol", "a") is None
    assert undo_private("") == "α="
    assert type1_encoding(b"%!PS\n/Encoding 256 array\ndup 65 /A put\ndup 49 /one put\nreadonly def\neexec dup 66 /B put")[49] == "1"
    assert style_flags(32, "ABCDEF+Times-BoldItalic") == 2 | 16 | 128
    c = CMap(b"1 begincodespacerange <00> <FF> endcodespacerange 1 beginbfchar <41> <0058> endbfchar 1 beginbfrange <50> <52> [<0021> <00590059> <0023>] endbfrange 1 beginbfrange <60> <65> <0061> endbfrange 1 begincidrange <10> <20> 100 endcidrange")
    assert [c.text(x) for x in (0x41, 0x51, 0x62, 0x70)] == ["X", "YY", "c", None] and c.cid(0x15) == 105
    assert c.split(b"AB") == [(0x41, 1), (0x42, 1)]


def test_operations():
    assert [(o, v) for o, v, _ in operations(b"BT /F1 12 Tf [(A) -120 (B)] TJ ET")] == [(b"BT", []), (b"Tf", ["F1", 12]), (b"TJ", [[b"A", -120, b"B"]]), (b"ET", [])]
    image = next(i for o, _, i in operations(b"BI /W 2 /H 1 /CS /G /BPC 8 ID xEIy EI Q") if o == b"BI")
    assert image.raw == b"xEIy" and image.dict["Width"] == 2
    assert list(operations(b") >> ] q"))
