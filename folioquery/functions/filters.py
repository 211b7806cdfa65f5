"""Stream filters: bytes in, bytes out. Damage keeps the part that could be read."""

from __future__ import annotations

import re
import zlib

import numpy as np

from .cos import Name, Stream

#: Most bytes that a stream may unfold to.
CAP = 256 << 20
IMAGE_CODECS = {"DCTDecode", "JPXDecode", "CCITTFaxDecode", "JBIG2Decode"}
_SHORT = {"Fl": "FlateDecode", "LZW": "LZWDecode", "AHx": "ASCIIHexDecode", "A85": "ASCII85Decode", "RL": "RunLengthDecode", "DCT": "DCTDecode", "CCF": "CCITTFaxDecode"}


class FilterError(ValueError):
    pass


def flate(data: bytes) -> bytes:
    data = data.lstrip(b"\0\t\n\f\r ")
    if not data:
        return b""
    d = zlib.decompressobj(15 if data[0] & 15 == 8 else -15)
    out, size = [], 0
    for i in range(0, len(data), 4096):
        try:
            part = d.decompress(data[i : i + 4096], CAP - size)
        except zlib.error:
            return _bytewise(data) or _unreadable()
        out.append(part)
        size += len(part)
        if size >= CAP or d.eof:
            break
    return b"".join(out) or _unreadable()


def _unreadable():
    raise FilterError("no readable data")


def _bytewise(data: bytes) -> bytes:
    d = zlib.decompressobj(15 if data[0] & 15 == 8 else -15)
    out = bytearray()
    try:
        for i in range(len(data)):
            out += d.decompress(data[i : i + 1], CAP - len(out))
    except zlib.error:
        pass
    return bytes(out)


def lzw(data: bytes, early: int = 1) -> bytes:
    table, bits, acc, have, last = [bytes([i]) for i in range(256)] + [b"", b""], 9, 0, 0, None
    out = bytearray()
    for byte in data:
        acc, have = acc << 8 | byte, have + 8
        while have >= bits:
            have -= bits
            code, acc = acc >> have, acc & ((1 << have) - 1)
            if code == 256:
                del table[258:]
                bits, last = 9, None
                continue
            if code == 257 or len(out) >= CAP:
                return bytes(out)
            if code < len(table):
                entry = table[code]
            elif code == len(table) and last is not None:
                entry = last + last[:1]
            else:
                return bytes(out)
            out += entry
            if last is not None:
                table.append(last + entry[:1])
                if len(table) + early >= 1 << bits and bits < 12:
                    bits += 1
            last = entry
    return bytes(out)


def ascii_hex(data: bytes) -> bytes:
    digits = re.sub(rb"[^0-9A-Fa-f]", b"", data.split(b">")[0])
    return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())


def ascii85(data: bytes) -> bytes:
    data = data.strip()
    data = data[2:] if data.startswith(b"<~") else data
    out, group = bytearray(), []
    for c in data:
        if c == 0x7E:
            break
        if c == 0x7A and not group:
            out += b"\0\0\0\0"
        elif 0x21 <= c <= 0x75:
            group.append(c - 33)
            if len(group) == 5:
                out += (sum(v * 85 ** (4 - i) for i, v in enumerate(group)) & 0xFFFFFFFF).to_bytes(4, "big")
                group = []
    if len(group) > 1:
        full = group + [84] * (5 - len(group))
        out += (sum(v * 85 ** (4 - i) for i, v in enumerate(full)) & 0xFFFFFFFF).to_bytes(4, "big")[: len(group) - 1]
    return bytes(out)


def run_length(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data) and data[i] != 128:
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += n + 2
        else:
            out += data[i + 1 : i + 2] * (257 - n)
            i += 2
    return bytes(out)


def predict(data: bytes, params: dict) -> bytes:
    kind = _int(params, "Predictor", 1)
    if kind < 2:
        return data
    colors, bpc, columns = _int(params, "Colors", 1), _int(params, "BitsPerComponent", 8), _int(params, "Columns", 1)
    row, step = (columns * colors * bpc + 7) // 8, max(1, colors * bpc // 8)
    if kind == 2:
        if bpc != 8 or not row:
            return data
        x = np.frombuffer(data[: len(data) // row * row], np.uint8).reshape(-1, columns, colors)
        return np.cumsum(x, axis=1, dtype=np.uint8).tobytes()
    out, before = bytearray(), bytes(row)
    for at in range(0, len(data) - row, row + 1):
        tag, line = data[at], bytearray(data[at + 1 : at + 1 + row])
        if tag == 2:
            line = bytearray((np.frombuffer(line, np.uint8) + np.frombuffer(before, np.uint8)).tobytes())
        elif tag in (1, 3, 4):
            for i in range(row):
                a, b, c = (line[i - step] if i >= step else 0), before[i], (before[i - step] if i >= step else 0)
                p = a + b - c
                paeth = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                line[i] = line[i] + (a if tag == 1 else (a + b) // 2 if tag == 3 else paeth) & 255
        elif tag:
            raise FilterError(f"row tag {tag}")
        out += line
        before = bytes(line)
    return bytes(out)


def _int(params: dict, key: str, default: int) -> int:
    v = params.get(key, default)
    return int(v) if isinstance(v, (int, float)) else default


def decode(stream: Stream, resolve=lambda x: x) -> tuple[bytes, str | None]:
    """(data, name of the image codec that the data is still in). FilterError for unknown filters."""
    d = stream.dict
    names = resolve(d.get("Filter", d.get("F") if not isinstance(d.get("F"), bytes) else None))
    names = [resolve(n) for n in names] if isinstance(names, list) else [names] if isinstance(names, Name) else []
    params = resolve(d.get("DecodeParms", d.get("DP")))
    params = [resolve(p) for p in params] if isinstance(params, list) else [params]
    data = stream.raw
    for i, n in enumerate(names):
        n = _SHORT.get(n, n)
        p = {k: resolve(v) for k, v in params[i].items()} if i < len(params) and isinstance(params[i], dict) else {}
        if n in IMAGE_CODECS:
            return data, str(n)
        if n == "FlateDecode":
            data = predict(flate(data), p)
        elif n == "LZWDecode":
            data = predict(lzw(data, _int(p, "EarlyChange", 1)), p)
        elif n == "ASCIIHexDecode":
            data = ascii_hex(data)
        elif n == "ASCII85Decode":
            data = ascii85(data)
        elif n == "RunLengthDecode":
            data = run_length(data)
        elif n != "Crypt":
            raise FilterError(f"unknown filter {n}")
    return data, None
