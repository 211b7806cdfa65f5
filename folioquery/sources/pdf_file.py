"""One PDF file in memory: cross references, objects and pages. A helper that a task runs on each row.

Damage is repaired or read as null: broken cross references are rebuilt by scanning for `n g obj`,
missing objects are None, undecodable streams are skipped. Only a file without a header, a needed
password and unsupported encryption raise, and the readers turn those into error rows.
"""

from __future__ import annotations

import re

from ..functions.cos import Keyword, Ref, Stream, read
from ..functions.crypt import Decryptor
from ..functions.filters import FilterError, decode

REF_HOPS, TREE_DEPTH, MAX_PAGES = 32, 64, 100_000
_OBJ = re.compile(rb"(?<![0-9])(\d{1,10})[\0\t\n\f\r ]+(\d{1,5})[\0\t\n\f\r ]+obj(?![a-zA-Z0-9])")


# A subsection's head and an entry of a cross reference table as they are as a rule.
_HEAD = re.compile(rb"[\0\t\n\f\r ]*(\d{1,18})[\0\t\n\f\r ]+(\d{1,18})(?=[\0\t\n\f\r ])")
_ROW = re.compile(rb"[\0\t\n\f\r ]+(\d{1,18})[\0\t\n\f\r ]+(\d{1,18})[\0\t\n\f\r ]+([nf])(?=[\0\t\n\f\r ])")
#: Objects without a stream by what is written between `obj` and `endobj`: the files of one writer share most of theirs.
_SAME: dict[bytes, object] = {}
SAME_BYTES, SAME_MOST = 2048, 1024


class ParseError(ValueError):
    pass


class PdfFile:
    def __init__(self, data: bytes, password: str | None = None):
        at = data.find(b"%PDF-")
        if at < 0:
            raise ParseError("no header")
        self.header_offset, self.data, self.recovered, self.truncated = at, data[at:], False, False
        self.xref: dict[int, tuple] = {}  # num -> ("offset", offset, gen) or ("instream", stream, index)
        self.cache: dict[int, object] = {}
        self.members: dict[int, dict[int, object]] = {}
        self.decryptor = None
        try:
            self.trailer = self._chain()
        except (ValueError, IndexError, KeyError, TypeError):
            self.trailer = {}
        if "Root" not in self.trailer:
            self.trailer = self._rebuild()
        if isinstance(self.resolve(self.trailer.get("Encrypt")), dict):
            e = {k: self.resolve(v) for k, v in self.resolve(self.trailer["Encrypt"]).items()}
            e["CF"] = {k: self.resolve(v) for k, v in (e.get("CF") or {}).items()}
            ids = self.resolve(self.trailer.get("ID"))
            decryptor = Decryptor(e, ids[0] if isinstance(ids, list) and ids and isinstance(ids[0], bytes) else b"", password)
            self.cache.clear()
            self.members.clear()
            self.decryptor = decryptor

    # --- cross references

    def _chain(self) -> dict:
        tail = self.data.rfind(b"startxref", max(0, len(self.data) - 2048))
        if tail < 0:
            raise ParseError("no startxref")
        queue, seen, trailer = [read(self.data, tail + 9)[0]], set(), {}
        while queue:
            at = queue.pop(0)
            if not isinstance(at, int) or not 0 <= at < len(self.data):
                raise ParseError("offset outside the file")
            if at in seen:
                continue
            seen.add(at)
            word, pos = read(self.data, at)
            part = self._table(pos) if word == b"xref" else self._stream(at)
            trailer = part | trailer
            if isinstance(part.get("XRefStm"), int):
                queue.insert(0, part["XRefStm"])
            if isinstance(part.get("Prev"), (int, float)):
                queue.append(int(part["Prev"]))
        return trailer

    def _table(self, pos: int) -> dict:
        while True:
            m = _HEAD.match(self.data, pos)
            if m:
                first, count, pos = int(m[1]), int(m[2]), m.end()
                pos = self._entries(first, count, pos)
                continue
            first, pos = read(self.data, pos, refs=False)
            if first == b"trailer":
                part = read(self.data, pos)[0]
                if not isinstance(part, dict):
                    raise ParseError("no trailer dictionary")
                return part
            count, pos = read(self.data, pos, refs=False)
            if type(first) is not int or type(count) is not int:
                raise ParseError("bad subsection")
            pos = self._entries(first, count, pos)

    def _entries(self, first: int, count: int, pos: int) -> int:
        for num in range(first, first + count):
            m = _ROW.match(self.data, pos)
            if m:
                offset, gen, kind, pos = int(m[1]), int(m[2]), m[3], m.end()
            else:
                offset, pos = read(self.data, pos, refs=False)
                gen, pos = read(self.data, pos, refs=False)
                kind, pos = read(self.data, pos, refs=False)
            if type(offset) is not int or type(gen) is not int or kind not in (b"n", b"f"):
                raise ParseError("bad entry")
            if kind == b"n":
                self.xref.setdefault(num, ("offset", offset, gen))
        return pos

    def _stream(self, at: int) -> dict:
        s = self._load_at(at, None)
        if not isinstance(s, Stream):
            raise ParseError("no cross reference stream")
        widths, index = ([v for v in x if type(v) is int] if isinstance(x, list) else None for x in (s.dict.get("W"), s.dict.get("Index")))
        index = [v for v in (0, s.dict.get("Size")) if type(v) is int] if index is None else index
        widths = [max(0, w) for w in widths or ()]
        if len(widths) < 3 or not any(widths):
            raise ParseError("bad widths")
        data, pos = decode(s, self.resolve)[0], 0
        for first, count in zip(index[::2], index[1::2], strict=False):
            for num in range(first, first + count):
                row = data[pos : pos + sum(widths)]
                if len(row) < sum(widths):
                    return s.dict
                pos += len(row)
                a, b = widths[0], widths[0] + widths[1]
                kind = int.from_bytes(row[:a], "big") if a else 1
                x, y = int.from_bytes(row[a:b], "big"), int.from_bytes(row[b : b + widths[2]], "big")
                if kind in (1, 2):
                    self.xref.setdefault(num, ("offset" if kind == 1 else "instream", x, y))
        return s.dict

    def _rebuild(self) -> dict:
        self.recovered = True
        self.xref.clear()
        self.cache.clear()
        for m in _OBJ.finditer(self.data):
            self.xref[int(m[1])] = ("offset", m.start(), int(m[2]))
        for num in list(self.xref):
            s = self.get(num)
            if isinstance(s, Stream) and s.dict.get("Type") == "ObjStm":
                for i, member in enumerate(self._members(num)):
                    self.xref.setdefault(member, ("instream", num, i))
        at = len(self.data)
        while (at := self.data.rfind(b"trailer", 0, at)) >= 0:
            part = read(self.data, at + 7)[0]
            if isinstance(part, dict) and "Root" in part:
                return part
        for num in sorted(self.xref):
            d = self.get(num)
            if isinstance(d, Stream) and d.dict.get("Type") == "XRef" and "Root" in d.dict:
                return d.dict
        roots = [n for n in sorted(self.xref) if isinstance(d := self.get(n), dict) and d.get("Type") == "Catalog"]
        return {"Root": Ref(roots[0], 0)} if roots else {}

    # --- objects

    def get(self, num: int):
        if num not in self.cache:
            self.cache[num] = None  # what refers to itself is null meanwhile
            entry = self.xref.get(num)
            if entry and entry[0] == "offset":
                self.cache[num] = self._load_at(entry[1], num)
            elif entry and entry[1] != num:
                self.cache[num] = self._members(entry[1]).get(num)
        return self.cache[num]

    def resolve(self, obj):
        for _ in range(REF_HOPS + 2):  # a reference, and REF_HOPS from what it names on
            if not isinstance(obj, Ref):
                return obj
            obj = self.get(obj.num)
        return None

    def _load_at(self, at: int, num: int | None):
        m = _OBJ.match(self.data, at) or _OBJ.match(self.data, re.compile(rb"[\0\t\n\f\r ]*").match(self.data, at).end())
        if not m or num is not None and int(m[1]) != num:
            return None
        end = self.data.find(b"endobj", m.end(), m.end() + SAME_BYTES)
        body = self.data[m.end() : end + 6] if end >= 0 else None
        if body in _SAME:
            return self._decrypted(_SAME[body], int(m[1]), int(m[2])) if self.decryptor else _SAME[body]
        obj, pos = read(self.data, m.end())
        if isinstance(obj, Keyword):
            return None
        word, after = read(self.data, pos)
        if word == b"endobj" and body is not None and after == end + 6:  # all of it was read from body
            if len(_SAME) >= SAME_MOST:
                _SAME.clear()
            _SAME[body] = obj
        if isinstance(obj, dict) and word == b"stream":
            after += 2 if self.data[after : after + 2] == b"\r\n" else self.data[after : after + 1] in (b"\n", b"\r")
            size = self.resolve(obj.get("Length"))
            end = after + size if isinstance(size, int) and size >= 0 else -1
            if end < 0 or not re.compile(rb"[\0\t\n\f\r ]*endstream").match(self.data, end):
                end = self.data.find(b"endstream", after)
                end = len(self.data) if end < 0 else end
                end -= self.data[end - 2 : end] == b"\r\n" or 0
                end -= end > after and self.data[end - 1 : end] in (b"\n", b"\r")
            obj = Stream(obj, self.data[after:end])
        if self.decryptor:
            obj = self._decrypted(obj, int(m[1]), int(m[2]))
        return obj

    def _decrypted(self, obj, num: int, gen: int):
        e = self.trailer.get("Encrypt")
        if isinstance(e, Ref) and e.num == num:
            return obj
        if isinstance(obj, Stream):
            if obj.dict.get("Type") == "XRef":
                return obj
            return Stream(self._decrypted(obj.dict, num, gen), self.decryptor.stream(num, gen, obj.dict, obj.raw))
        if isinstance(obj, dict):
            return {k: self._decrypted(v, num, gen) for k, v in obj.items()}
        if isinstance(obj, list):
            return [self._decrypted(v, num, gen) for v in obj]
        return self.decryptor.string(num, gen, obj) if isinstance(obj, bytes) and not isinstance(obj, Keyword) else obj

    def _members(self, num: int) -> dict[int, object]:
        if num not in self.members:
            self.members[num] = out = {}
            s = self.get(num)
            data = self.bytes_of(s) if isinstance(s, Stream) else b""
            n, first = (self.resolve(s.dict.get(k)) for k in ("N", "First")) if isinstance(s, Stream) else (0, 0)
            pos, heads = 0, []
            for _ in range(n if isinstance(n, int) else 0):
                a, pos = read(data, pos, refs=False)
                b, pos = read(data, pos, refs=False)
                if type(a) is not int or type(b) is not int:
                    break
                heads.append((a, b))
            for member, offset in heads:
                if member not in out:
                    obj = read(data, first + offset)[0]
                    out[member] = None if isinstance(obj, Keyword) else obj
        return self.members[num]

    def bytes_of(self, stream) -> bytes:
        """The decoded data; empty where it can't be decoded."""
        stream = self.resolve(stream)
        if not isinstance(stream, Stream):
            return b""
        try:
            data, codec = decode(stream, self.resolve)
        except FilterError:
            return b""
        return b"" if codec else data

    # --- pages

    def pages(self, wanted=lambda i: True) -> list[dict]:
        """Leaves in order: resources, media and crop box, rotation, and the content of those wanted."""
        catalog = self.resolve(self.trailer.get("Root"))
        root = self.resolve(catalog.get("Pages")) if isinstance(catalog, dict) else None
        out: list[dict] = []
        seen: set[int] = set()
        stack = [(root, {}, 0)]
        while stack:
            node, up, depth = stack.pop()
            if isinstance(node, Ref):
                if node.num in seen:
                    continue
                seen.add(node.num)
                node = self.resolve(node)
            if depth > TREE_DEPTH or len(out) >= MAX_PAGES:
                self.truncated = True
                continue
            if not isinstance(node, dict):
                continue
            have = dict(up)
            if isinstance(self.resolve(node.get("Resources")), dict):
                have["Resources"] = self.resolve(node["Resources"])
            for key in ("MediaBox", "CropBox"):
                box = self._box(node.get(key))
                if box:
                    have[key] = box
            turn = self.resolve(node.get("Rotate"))
            if isinstance(turn, (int, float)):
                have["Rotate"] = int(turn) % 360 if turn == turn and abs(turn) < 1 << 53 else 0
            kids = self.resolve(node.get("Kids"))
            if isinstance(kids, list):
                stack.extend((k, have, depth + 1) for k in reversed(kids))
            if isinstance(kids, list) or self.resolve(node.get("Type")) == "Pages":
                continue
            parts = self.resolve(node.get("Contents")) if wanted(len(out)) else []
            parts = parts if isinstance(parts, list) else [parts]
            content = b"\n".join(x for x in (self.bytes_of(p) for p in parts) if x)
            out.append({"resources": have.get("Resources", {}), "media": have.get("MediaBox"), "crop": have.get("CropBox"), "rotate": have.get("Rotate", 0), "content": content})
        return out

    def _box(self, box) -> list[float] | None:
        box = self.resolve(box)
        box = [self.resolve(v) for v in box] if isinstance(box, list) and len(box) >= 4 else None
        if not box or not all(isinstance(v, (int, float)) for v in box[:4]):
            return None
        x, y = sorted((float(box[0]), float(box[2]))), sorted((float(box[1]), float(box[3])))
        return [x[0], y[0], x[1], y[1]] if x[0] < x[1] and y[0] < y[1] else None

