"""The standard security handler: file keys from a password, and decryption of strings and streams."""

from __future__ import annotations

import hashlib


_PAD = bytes.fromhex("28BF4E5E4E758A4164004E56FFFA01082E2E00B6D0683E802F0CA9FE6453697A")


class PasswordError(ValueError):
    pass


class UnsupportedEncryption(ValueError):
    pass


def rc4(key: bytes, data: bytes) -> bytes:
    if not key:
        return data
    s, j = list(range(256)), 0
    for i in range(256):
        j = (j + s[i] + key[i % len(key)]) & 255
        s[i], s[j] = s[j], s[i]
    out, i, j = bytearray(len(data)), 0, 0
    for n, c in enumerate(data):
        i = (i + 1) & 255
        j = (j + s[i]) & 255
        s[i], s[j] = s[j], s[i]
        out[n] = c ^ s[(s[i] + s[j]) & 255]
    return bytes(out)


def _tables():
    exp, log, x = [0] * 256, [0] * 256, 1
    for i in range(255):
        exp[i], log[x] = x, i
        x ^= (x << 1) ^ (0x11B if x & 0x80 else 0)
        x &= 0xFF
    box = [0x63]
    for v in range(1, 256):
        b = exp[(255 - log[v]) % 255]
        r = b
        for k in range(1, 5):
            r ^= (b << k | b >> (8 - k)) & 0xFF
        box.append(r ^ 0x63)
    mul = {m: [exp[(log[m] + log[v]) % 255] if v else 0 for v in range(256)] for m in (2, 3, 9, 11, 13, 14)}
    return box, [box.index(i) for i in range(256)], mul


_BOX, _UNBOX, _MUL = _tables()


def _round_keys(key: bytes) -> list[bytes]:
    n, words, rc = len(key) // 4, [key[i : i + 4] for i in range(0, len(key), 4)], 1
    for i in range(n, 4 * (n + 7)):
        w = words[-1]
        if i % n == 0:
            w = bytes(_BOX[b] for b in w[1:] + w[:1])
            w = bytes([w[0] ^ rc]) + w[1:]
            rc = (rc << 1) ^ (0x11B if rc & 0x80 else 0)
        elif n > 6 and i % n == 4:
            w = bytes(_BOX[b] for b in w)
        words.append(bytes(a ^ b for a, b in zip(words[-n], w, strict=True)))
    return [b"".join(words[i : i + 4]) for i in range(0, len(words), 4)]


def _xor(a: bytes, b: bytes) -> bytes:
    return (int.from_bytes(a, "big") ^ int.from_bytes(b, "big")).to_bytes(len(a), "big")


def aes_cbc(key: bytes, iv: bytes, data: bytes, encrypt: bool) -> bytes:
    """Without padding; data is a whole number of blocks."""
    keys, out = _round_keys(key), []
    m2, m3, m9, mb, md, me = (_MUL[k] for k in (2, 3, 9, 11, 13, 14))
    for at in range(0, len(data), 16):
        block = data[at : at + 16]
        if encrypt:
            s = _xor(_xor(block, iv), keys[0])
            for r in range(1, len(keys)):
                s = bytes(_BOX[s[(i + 4 * (i % 4)) % 16]] for i in range(16))
                if r < len(keys) - 1:
                    s = bytes(m2[s[c + i]] ^ m3[s[c + (i + 1) % 4]] ^ s[c + (i + 2) % 4] ^ s[c + (i + 3) % 4] for c in range(0, 16, 4) for i in range(4))
                s = _xor(s, keys[r])
            iv = s
        else:
            s = _xor(block, keys[-1])
            for r in range(len(keys) - 2, -1, -1):
                s = _xor(bytes(_UNBOX[s[(i - 4 * (i % 4)) % 16]] for i in range(16)), keys[r])
                if r:
                    s = bytes(me[s[c + i]] ^ mb[s[c + (i + 1) % 4]] ^ md[s[c + (i + 2) % 4]] ^ m9[s[c + (i + 3) % 4]] for c in range(0, 16, 4) for i in range(4))
            s, iv = _xor(s, iv), block
        out.append(s)
    return b"".join(out)


def aes_data(key: bytes, data: bytes) -> bytes:
    """A vector, then padded blocks; wrong lengths give nothing, wrong padding is left on."""
    if len(data) < 32 or len(data) % 16:
        return b""
    out = aes_cbc(key, data[:16], data[16:], False)
    n = out[-1]
    return out[:-n] if 1 <= n <= 16 and out.endswith(bytes([n]) * n) else out


def hash_r6(password: bytes, salt: bytes, user: bytes = b"") -> bytes:
    k, i = hashlib.sha256(password + salt + user).digest(), 0
    while True:
        e = aes_cbc(k[:16], k[16:32], (password + k + user) * 64, True)
        k = (hashlib.sha256, hashlib.sha384, hashlib.sha512)[sum(e[:16]) % 3](e).digest()
        i += 1
        if i >= 64 and e[-1] <= i - 32:
            return k[:32]


def _number(d: dict, key: str, default: int) -> int:
    return int(d[key]) if isinstance(d.get(key), (int, float)) else default


class Decryptor:
    """From the (resolved) encryption dictionary, the first file id and a password."""

    def __init__(self, d: dict, file_id: bytes, password: str | None):
        if d.get("Filter") != "Standard":
            raise UnsupportedEncryption(f"handler {d.get('Filter')}")
        self.v, self.r = _number(d, "V", 0), _number(d, "R", 2)
        self.metadata = d.get("EncryptMetadata", True) is not False
        self.strings = self.streams = "V2"
        if self.v >= 4:
            filters = d.get("CF") if isinstance(d.get("CF"), dict) else {}
            method = lambda name: {"V2": "V2", "AESV2": "AES", "AESV3": "AES"}.get((filters.get(d.get(name)) or {}).get("CFM", ""), "Identity")
            self.strings, self.streams = method("StrF"), method("StmF")
        pw = (password or "").encode()
        o, u = d.get("O", b""), d.get("U", b"")
        if self.v == 5 or self.r >= 5:
            self.key = self._key_v5(d, pw[:127], o, u)
            return
        if not 1 <= self.v <= 4:
            raise UnsupportedEncryption(f"version {self.v}")
        self.size = 5 if self.r == 2 else min(16, max(5, _number(d, "Length", 40) // 8))
        pw = (password or "").encode("latin-1", "replace")
        perms = (_number(d, "P", 0) & 0xFFFFFFFF).to_bytes(4, "little")
        for candidate in (pw, self._from_owner(pw, o)):
            key = self._key(candidate, o[:32], perms, file_id)
            if self._check(key, file_id)[: 32 if self.r == 2 else 16] == u[: 32 if self.r == 2 else 16]:
                self.key = key
                return
        raise PasswordError("password needed" if password is None else "wrong password")

    def _key(self, pw: bytes, o: bytes, perms: bytes, file_id: bytes) -> bytes:
        k = hashlib.md5((pw + _PAD)[:32] + o + perms + file_id + (b"\xff" * 4 if self.r >= 4 and not self.metadata else b"")).digest()
        for _ in range(50 if self.r >= 3 else 0):
            k = hashlib.md5(k[: self.size]).digest()
        return k[: self.size]

    def _check(self, key: bytes, file_id: bytes) -> bytes:
        if self.r == 2:
            return rc4(key, _PAD)
        x = hashlib.md5(_PAD + file_id).digest()
        for i in range(20):
            x = rc4(bytes(b ^ i for b in key), x)
        return x

    def _from_owner(self, pw: bytes, o: bytes) -> bytes:
        k = hashlib.md5((pw + _PAD)[:32]).digest()
        for _ in range(50 if self.r >= 3 else 0):
            k = hashlib.md5(k).digest()
        k, x = k[: self.size], o[:32]
        for i in range(19 if self.r >= 3 else 0, -1, -1):
            x = rc4(bytes(b ^ i for b in k), x)
        return x

    def _key_v5(self, d: dict, pw: bytes, o: bytes, u: bytes) -> bytes:
        digest = hash_r6 if self.r >= 6 else lambda p, salt, user=b"": hashlib.sha256(p + salt + user).digest()
        for have, user, wrapped in ((o, u[:48], d.get("OE", b"")), (u, b"", d.get("UE", b""))):
            if len(have) >= 48 and digest(pw, have[32:40], user) == have[:32]:
                return aes_cbc(digest(pw, have[40:48], user), bytes(16), wrapped[:32], False)
        raise PasswordError("wrong password")

    def _apply(self, method: str, num: int, gen: int, data: bytes) -> bytes:
        if method == "Identity":
            return data
        key = self.key
        if self.v < 5 and self.r < 5:
            tail = b"sAlT" if method == "AES" else b""
            key = hashlib.md5(key + num.to_bytes(4, "little")[:3] + gen.to_bytes(4, "little")[:2] + tail).digest()[: min(16, len(key) + 5)]
        return aes_data(key, data) if method == "AES" else rc4(key, data)

    def string(self, num: int, gen: int, data: bytes) -> bytes:
        return self._apply(self.strings, num, gen, data)

    def stream(self, num: int, gen: int, d: dict, data: bytes) -> bytes:
        if d.get("Type") == "XRef" or d.get("Type") == "Metadata" and not self.metadata:
            return data
        return self._apply(self.streams, num, gen, data)


