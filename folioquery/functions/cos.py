"""Reading the object syntax of PDF bytes: a small helper of the page readers.

Python values stand for objects: None, bool, int, float, bytes (strings), Name, list, dict, Ref and
Stream; bare words are Keyword. Nothing here raises on damaged input: what can't be read is None or is
skipped, as far as nesting DEPTH.
"""

from __future__ import annotations

import re
from typing import NamedTuple

DEPTH = 150
_SPACE = re.compile(rb"(?:[\0\t\n\f\r ]+|%[^\r\n]*)*")
_REGULAR = re.compile(rb"[^\0\t\n\f\r ()<>\[\]{}/%]*")
_NUMBER = re.compile(rb"[+-]*(?:\d+\.?\d*|\.\d*)?(?:[eE][+-]?\d+)?$")
_PLAIN = re.compile(rb"\(([^()\\\r]*)\)")
_REF = re.compile(rb"[\0\t\n\f\r ]+(\d+)[\0\t\n\f\r ]+R(?![^\0\t\n\f\r ()<>\[\]{}/%])")
_ESCAPES = {ord("n"): 10, ord("r"): 13, ord("t"): 9, ord("b"): 8, ord("f"): 12}


class Name(str):
    pass


class Keyword(bytes):
    pass


class Ref(NamedTuple):
    num: int
    gen: int


class Stream(NamedTuple):
    dict: dict
    raw: bytes


def number(word: bytes) -> int | float | None:
    """An int where it is written as one and fits 64 bits, else a lenient real; None if neither."""
    if not word or word[0] not in b"+-.0123456789" or not _NUMBER.match(word):
        return None
    sign = -1 if b"-" in word[: len(word) - len(word.lstrip(b"+-"))] else 1
    bare = word.lstrip(b"+-")
    if bare.isdigit() and int(bare) < 1 << 63:
        return sign * int(bare)
    try:
        value = sign * float(bare)
    except ValueError:
        return 0.0 if bare in (b"", b".") else None
    return value if abs(value) != float("inf") else None


def _name(word: bytes) -> Name:
    if b"#" in word:
        out, i = bytearray(), 0
        while i < len(word):
            pair = word[i + 1 : i + 3]
            if word[i] == 0x23 and re.fullmatch(rb"[0-9A-Fa-f]{2}", pair):
                out.append(int(pair, 16))
                i += 3
            elif word[i] == 0x23 and re.match(rb"[0-9A-Fa-f]", pair):
                out.append(0x23)  # the single digit is lost
                i += 2
            else:
                out.append(word[i])
                i += 1
        word = bytes(out)
    return Name(word.decode("utf-8", "replace"))


def _literal(data: bytes, pos: int) -> tuple[bytes, int]:
    m = _PLAIN.match(data, pos)
    if m:
        return m[1], m.end()
    out, depth, pos = bytearray(), 1, pos + 1
    while pos < len(data):
        c = data[pos]
        pos += 1
        if c == 0x5C and pos < len(data):
            e = data[pos]
            pos += 1
            if e in b"01234567":
                digits = re.compile(rb"[0-7]{1,3}").match(data, pos - 1)[0]
                out.append(int(digits, 8) & 255)
                pos += len(digits) - 1
            elif e in b"\r\n":
                pos += e == 13 and data[pos : pos + 1] == b"\n"
            else:
                out.append(_ESCAPES.get(e, e))
            continue
        if c == 0x28:
            depth += 1
        elif c == 0x29:
            depth -= 1
            if not depth:
                break
        elif c == 13:
            pos += data[pos : pos + 1] == b"\n"
            c = 10
        out.append(c)
    return bytes(out), pos


def read(data: bytes, pos: int = 0, depth: int = 0, refs: bool = True):
    """(object, position after it); at the end of data the object is Keyword(b"")."""
    pos = _SPACE.match(data, pos).end()
    c = data[pos : pos + 1]
    if c == b"/":
        m = _REGULAR.match(data, pos + 1)
        return _name(m[0]), m.end()
    if c == b"(":
        return _literal(data, pos)
    if c == b"<" and data[pos + 1 : pos + 2] != b"<":
        end = data.find(b">", pos)
        digits = re.sub(rb"[^0-9A-Fa-f]", b"", data[pos + 1 : end if end >= 0 else len(data)])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()), end + 1 if end >= 0 else len(data)
    if c == b"<" or c == b"[":
        if depth >= DEPTH:
            return None, pos + 1
        items, pos = [], pos + (1 if c == b"[" else 2)
        while True:
            pos = _SPACE.match(data, pos).end()
            if pos >= len(data) or data[pos : pos + 1] in (b"]", b">"):
                pos += 2 if c == b"<" and data[pos : pos + 2] == b">>" else 1
                break
            item, after = read(data, pos, depth + 1, refs)
            pos = max(after, pos + 1)
            if not isinstance(item, Keyword):
                items.append(item)
            elif item in (b"endobj", b"stream", b"endstream", b""):
                return (items if c == b"[" else _pairs(items)), pos - len(item)
        return (items if c == b"[" else _pairs(items)), min(pos, len(data))
    m = _REGULAR.match(data, pos)
    word = m[0]
    if not word:
        return Keyword(c), pos + len(c)
    value = number(word)
    if value is not None:
        if refs and type(value) is int and value >= 0:
            r = _REF.match(data, m.end())
            if r:
                return Ref(value, int(r[1])), r.end()
        return value, m.end()
    fixed = {b"true": True, b"false": False, b"null": None}
    return (fixed[word] if word in fixed else Keyword(word)), m.end()


def _pairs(items: list) -> dict:
    out, i = {}, 0
    while i < len(items) - 1:
        if isinstance(items[i], Name):
            out[items[i]] = items[i + 1]
            i += 2
        else:
            i += 1
    return out


_UNICODE_GAPS = {0x18: "˘ˇˆ˙˝˛˚˜", 0x80: "•†‡…—–ƒ⁄‹›−‰„“”‘’‚™ﬁﬂŁŒŠŸŽıłœšž"}
_DOC = {b + i: ch for b, run in _UNICODE_GAPS.items() for i, ch in enumerate(run)} | {0xA0: "€"}


def text_string(data: bytes) -> str:
    """A text string: by its byte order mark, else the document encoding without undefined bytes."""
    if data[:2] == b"\xfe\xff":
        return data[2:].decode("utf-16-be", "replace")
    if data[:2] == b"\xff\xfe":
        return data[2:].decode("utf-16-le", "replace")
    if data[:3] == b"\xef\xbb\xbf":
        return data[3:].decode("utf-8", "replace")
    return "".join(_DOC.get(b, "" if b < 0x18 and b not in b"\t\n\r" or b in (0x7F, 0x9F, 0xAD) else chr(b)) for b in data)
