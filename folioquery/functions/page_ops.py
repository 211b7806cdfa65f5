"""One page's operations, folded into rows of primitives: a helper that a task runs on each page row.

The graphics state is a sequential stack, so this part is a plain loop; everything that looks at
neighbouring primitives (word gaps, lines, spans, order) is left to DataFrame windows.
"""

from __future__ import annotations

import math
import re
from itertools import accumulate

import numpy as np

from .cos import Keyword, Name, Stream, read, text_string
from .filters import FilterError, decode

FORM_DEPTH = 12
#: Characters of a string for which lists are quicker than arrays, and codes of a font that are kept with it.
SHORT, KNOWN = 48, 1 << 16
IDENTITY = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
_INLINE = {"W": "Width", "H": "Height", "BPC": "BitsPerComponent", "CS": "ColorSpace", "F": "Filter", "DP": "DecodeParms", "IM": "ImageMask", "D": "Decode", "I": "Interpolate", "L": "Length"}
_SPACES = {"DeviceGray": 1, "CalGray": 1, "G": 1, "DeviceRGB": 3, "CalRGB": 3, "RGB": 3, "Lab": 3, "DeviceCMYK": 4, "CMYK": 4, "Pattern": 0, "Indexed": 1, "I": 1, "Separation": 1}
_CONSTANTS = (b"true", b"false", b"null")
_PAINTS = {b"f": (1, 0, 0), b"F": (1, 0, 0), b"f*": (1, 0, 1), b"S": (0, 1, 0), b"s": (0, 1, 0), b"B": (1, 1, 0), b"B*": (1, 1, 1), b"b": (1, 1, 0), b"b*": (1, 1, 1), b"n": (0, 0, 0)}


def concat(a: tuple, b: tuple) -> tuple:
    """a first, then b."""
    return (a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3], a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5])


def apply(m: tuple, x: float, y: float) -> tuple[float, float]:
    return m[0] * x + m[2] * y + m[4], m[1] * x + m[3] * y + m[5]


def corners(m: tuple, box) -> tuple[float, float, float, float]:
    pts = [apply(m, x, y) for x in (box[0], box[2]) for y in (box[1], box[3])]
    return min(p[0] for p in pts), min(p[1] for p in pts), max(p[0] for p in pts), max(p[1] for p in pts)


def components(space, resolve=lambda x: x, depth: int = 0) -> int:
    space = resolve(space)
    if isinstance(space, Name):
        return _SPACES.get(space, 1)
    if isinstance(space, list) and space and depth < 4:
        head = resolve(space[0])
        if head == "ICCBased" and len(space) > 1:
            s = resolve(space[1])
            n = resolve(s.dict.get("N")) if isinstance(s, Stream) else 3
            return min(4, max(1, n if isinstance(n, int) else 3))
        if head == "DeviceN" and len(space) > 1:
            names = resolve(space[1])
            return len(names) if isinstance(names, list) else 1
        return _SPACES.get(head, 1)
    return 1


def entry(d: dict, kind: str, name):
    """What a page's resources hold under a name; None where the operand is no name."""
    return d.get(kind, {}).get(name) if isinstance(name, Name) else None


def whole(v: float, least: int = -(1 << 31), most: int = (1 << 31) - 1) -> int:
    """A number as an integer of 32 bits."""
    return 0 if v != v else int(min(max(v, least), most))


def to_rgb(v: list[float]) -> tuple | None:
    v = [min(1.0, max(0.0, x)) for x in v]
    if len(v) == 1:
        return (v[0],) * 3
    if len(v) == 3:
        return tuple(v)
    return tuple((1 - c) * (1 - v[3]) for c in v[:3]) if len(v) == 4 else None


# One token of the usual kinds, all within the data that it was found in: a number, a hexadecimal string, a name, an operator, a string
# without escapes, or an array of numbers and strings. What else there is goes to `read`, which says what each of these is, too.
_GAP, _ENDS = rb"[\0\t\n\f\r ]", rb"(?=[\0\t\n\f\r ()<>\[\]{}/%])"
_INT, _HEX, _BARE = rb"[+-]?\d{1,18}", rb"<(?:[0-9A-Fa-f]{2})*>", rb"\([^()\\\r]*\)"
_REAL = rb"[+-]?(?:\d{1,18}\.\d{0,18}|\.\d{1,18})"
_LISTED = rb"(?:" + _HEX + rb"|" + _BARE + rb"|(?:" + _REAL + rb"|" + _INT + rb")" + _ENDS + rb")"
_TOKEN = re.compile(_GAP + rb"*(?:(" + _INT + rb")" + _ENDS + rb"|(" + _REAL + rb")" + _ENDS + rb"|(" + _HEX + rb")|([A-Za-z'\"][A-Za-z0-9*]{0,2})" + _ENDS + rb"|/([A-Za-z0-9]{1,40})" + _ENDS + rb"|(" + _BARE + rb")|\[((?:" + _GAP + rb"*+" + _LISTED + rb")*+)" + _GAP + rb"*\])")
_ITEM = re.compile(rb"(" + _HEX + rb")|(" + _BARE + rb")|(" + _REAL + rb")|(" + _INT + rb")")


def _listed(data: bytes) -> list:
    return [bytes.fromhex(h[1:-1].decode()) if h else b[1:-1] if b else float(r) if r else int(n) for h, b, r, n in _ITEM.findall(data)]


def operations(data: bytes):
    """(operator, operands, inline image) in order."""
    pos, operands = 0, []
    while pos < len(data):
        m = _TOKEN.match(data, pos)
        if m:
            kind, word = m.lastindex, m[m.lastindex]
            if kind == 4:
                if word != b"BI" and word not in _CONSTANTS:
                    pos = m.end()
                    yield word, operands, None
                    operands = []
                    continue
            else:
                pos = m.end()
                operands.append(int(word) if kind == 1 else float(word) if kind == 2 else bytes.fromhex(word[1:-1].decode()) if kind == 3 else Name(word.decode()) if kind == 5 else word[1:-1] if kind == 6 else _listed(word))
                continue
        item, after = read(data, pos, refs=False)
        pos = max(after, pos + 1)
        if not isinstance(item, Keyword):
            operands.append(item)
        elif item == b"BI":
            image, pos = _inline(data, pos)
            yield b"BI", [], image
            operands = []
        elif item:
            yield bytes(item), operands, None
            operands = []


def _inline(data: bytes, pos: int) -> tuple[Stream, int]:
    items = []
    while pos < len(data):
        item, pos = read(data, pos, refs=False)
        if isinstance(item, Keyword):
            break
        items.append(item)
    d = {Name(_INLINE.get(k, k)): v for k, v in zip(items[::2], items[1::2], strict=False) if isinstance(k, Name)}
    pos += 1
    size = d.get("Length")
    if isinstance(size, int) and re.compile(rb"\s*EI(?![^\0\t\n\f\r ()<>\[\]{}/%])").match(data, pos + size):
        return Stream(d, data[pos : pos + size]), data.index(b"EI", pos + size) + 2
    m = re.compile(rb"[\0\t\n\f\r ]EI(?![^\0\t\n\f\r ()<>\[\]{}/%])").search(data, pos)
    return Stream(d, data[pos : m.start() if m else len(data)]), m.end() if m else len(data)


class State:
    __slots__ = ("ctm", "fill", "stroke", "nf", "ns", "fa", "sa", "width", "font", "font_name", "size", "tc", "tw", "tz", "tl", "rise", "mode")

    def __init__(self):
        self.ctm, self.fill, self.stroke, self.nf, self.ns, self.fa, self.sa, self.width = IDENTITY, (0.0,) * 3, (0.0,) * 3, 1, 1, 1.0, 1.0, 1.0
        self.font, self.font_name, self.size, self.tc, self.tw, self.tz, self.tl, self.rise, self.mode = None, "", 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0

    def copy(self) -> State:
        s = State.__new__(State)
        for k in State.__slots__:
            setattr(s, k, getattr(self, k))
        return s


class Page:
    """Collects runs of glyphs, paths and images of one page."""

    def __init__(self, want=("glyph", "path", "image")):
        self.want, self.seq, self.spans = want, 0, 0
        self.runs: list[tuple] = []
        self.shown: list[tuple] = []
        self.paths: list[tuple] = []
        self.images: list[tuple] = []
        self.span: tuple[int, str] | None = None
        self.tm = self.line = IDENTITY

    def run(self, data: bytes, res: dict, gs: State | None = None, depth: int = 0) -> None:
        if depth > FORM_DEPTH:
            return
        gs, stack, marks, path, at, start = gs or State(), [], [], [], (0.0, 0.0), (0.0, 0.0)
        num = lambda v, i=0, default=0.0: float(v[i]) if i < len(v) and isinstance(v[i], (int, float)) else default
        outer = self.span
        for op, v, image in operations(data):
            if op in (b"Tj", b"'", b'"', b"TJ"):
                if op == b'"':
                    gs.tw, gs.tc = num(v), num(v, 1)
                if op in (b"'", b'"'):
                    self._next_line(0.0, -gs.tl)
                last = v[-1] if v else b""
                for part in last if isinstance(last, list) else [last]:
                    if isinstance(part, bytes):
                        self._show(part, gs, res, depth)
                    elif isinstance(part, (int, float)):
                        self.tm = concat((1.0, 0.0, 0.0, 1.0, -part / 1000 * gs.size * gs.tz, 0.0), self.tm)
            elif op == b"q":
                stack.append(gs.copy())
            elif op == b"Q":
                gs = stack.pop() if stack else gs
            elif op == b"cm" and len(v) >= 6:
                gs.ctm = concat(tuple(num(v, i) for i in range(6)), gs.ctm)
            elif op == b"w":
                gs.width = num(v, 0, gs.width)
            elif op == b"gs":
                g = entry(res, "gs", v[0] if v else None) or {}
                gs.width, gs.fa, gs.sa, gs.size = g.get("LW", gs.width), g.get("ca", gs.fa), g.get("CA", gs.sa), g.get("size", gs.size)
            elif op in (b"g", b"rg", b"k", b"sc", b"scn", b"G", b"RG", b"K", b"SC", b"SCN"):
                nums = [float(x) for x in v if isinstance(x, (int, float)) and not isinstance(x, bool)]
                low = op.lower()
                n = {b"g": 1, b"rg": 3, b"k": 4}.get(low)
                if n:
                    if len(nums) < n:
                        nums += [0.0] * (n - len(nums))
                else:
                    declared = gs.nf if op.islower() else gs.ns
                    n = declared if 1 <= declared <= len(nums) else len(nums)
                c = to_rgb(nums[:n])
                if c:
                    if op.islower():
                        gs.fill, gs.nf = c, n
                    else:
                        gs.stroke, gs.ns = c, n
            elif op in (b"cs", b"CS"):
                name = v[0] if v else None
                n = entry(res, "cs", name)
                n = components(name) if n is None else n
                if op == b"cs":
                    gs.fill, gs.nf = (0.0,) * 3, n
                else:
                    gs.stroke, gs.ns = (0.0,) * 3, n
            elif op in (b"m", b"l") and len(v) >= 2:
                at = apply(gs.ctm, num(v), num(v, 1))
                start = at if op == b"m" else start
                path.append(("M" if op == b"m" else "L", [*at]))
            elif op in (b"c", b"v", b"y") and len(v) >= (6 if op == b"c" else 4):
                p = [apply(gs.ctm, num(v, i), num(v, i + 1)) for i in range(0, 6 if op == b"c" else 4, 2)]
                p = p if op == b"c" else [at, *p] if op == b"v" else [p[0], p[1], p[1]]
                path.append(("C", [c for x in p for c in x]))
                at = p[-1]
            elif op == b"h":
                path.append(("Z", []))
                at = start
            elif op == b"re" and len(v) >= 4:
                x, y, w, h = (num(v, i) for i in range(4))
                p = [apply(gs.ctm, *q) for q in ((x, y), (x + w, y), (x + w, y + h), (x, y + h))]
                path += [(c, [*q]) for c, q in zip("MLLL", p, strict=True)] + [("Z", [])]
                at = start = p[0]
            elif op in _PAINTS:
                fill, stroke, odd = _PAINTS[op]
                if op in (b"s", b"b", b"b*") and path:
                    path.append(("Z", []))
                if path and (fill or stroke):
                    xs, ys = [c for _, p in path for c in p[::2]], [c for _, p in path for c in p[1::2]]
                    if xs and "path" in self.want:
                        m = gs.ctm
                        width = gs.width * max(math.hypot(m[0], m[1]), math.hypot(m[2], m[3]))
                        self.paths.append((self.seq, path, (min(xs), min(ys), max(xs), max(ys)), gs.fill if fill else None, gs.stroke if stroke else None, width, bool(odd), gs.fa, gs.sa))
                    self.seq += bool(xs)
                path = []
            elif op == b"BT":
                self.tm = self.line = IDENTITY
            elif op in (b"Tc", b"Tw", b"TL", b"Ts"):
                setattr(gs, {b"Tc": "tc", b"Tw": "tw", b"TL": "tl", b"Ts": "rise"}[op], num(v))
            elif op == b"Tz":
                gs.tz = num(v, 0, 100.0) / 100
            elif op == b"Tr":
                gs.mode = whole(num(v))
            elif op == b"Tf" and v:
                gs.font, gs.font_name, gs.size = entry(res, "fonts", v[0]), str(v[0]), num(v, 1)
            elif op in (b"Td", b"TD"):
                gs.tl = -num(v, 1) if op == b"TD" else gs.tl
                self._next_line(num(v), num(v, 1))
            elif op == b"Tm" and len(v) >= 6:
                self.tm = self.line = tuple(num(v, i) for i in range(6))
            elif op == b"T*":
                self._next_line(0.0, -gs.tl)
            elif op == b"Do" and v:
                self._object(res, v[0], gs, depth)
            elif op == b"BI":
                self._image("inline", image, gs, res.get("cs", {}), None)
            elif op in (b"BDC", b"BMC"):
                props = v[1] if len(v) > 1 else None
                text = entry(res, "props", props) if isinstance(props, Name) else props.get("ActualText") if isinstance(props, dict) else None
                opens = isinstance(text, bytes) and self.span is None
                if opens:
                    self.spans += 1
                    self.span = (self.spans, text_string(text))
                marks.append(opens)
            elif op == b"EMC" and marks:
                if marks.pop():
                    self.span = None
        self.span = outer

    def _next_line(self, x: float, y: float) -> None:
        self.tm = self.line = concat((1.0, 0.0, 0.0, 1.0, x, y), self.line)

    def _show(self, data: bytes, gs: State, res: dict, depth: int) -> None:
        font = gs.font
        if font is None or not data:
            return
        if font["kind"] == "Type0":
            split = font["cmap"].split(data)
            codes, spaces = [c for c, _ in split], [n == 1 and c == 32 for c, n in split]
            known = self._known(font, codes)
            thousandths, texts = [known[c][0] for c in codes], [known[c][1] for c in codes]
        else:
            codes, spaces = list(data), [c == 32 for c in data]
            if "by_code" not in font:
                font["by_code"] = (font["widths"] / 1000).tolist(), font["texts"].tolist()
            by_code, by_text = font["by_code"]
            thousandths, texts = [by_code[c] for c in codes], [by_text[c] for c in codes]
        m, size, tc, tw, tz = concat(self.tm, gs.ctm), gs.size, gs.tc, gs.tw, gs.tz
        a, b, x0, y0 = m[0], m[1], m[2] * gs.rise, m[3] * gs.rise
        stretch = math.hypot(a, b)
        if len(codes) <= SHORT:  # the same sums in the same order, without arrays
            advance = [(w * size + tc + tw * s) * tz for w, s in zip(thousandths, spaces, strict=True)]
            pen = [0.0, *accumulate(advance)]
            x, y, far = [a * p + x0 + m[4] for p in pen], [b * p + y0 + m[5] for p in pen], [v * stretch for v in advance]
        else:
            advance = (np.array(thousandths) * size + tc + tw * np.array(spaces)) * tz
            pen = np.concatenate([[0.0], np.cumsum(advance)])
            x, y, far = a * pen + x0 + m[4], b * pen + y0 + m[5], advance * stretch
        trm = (size * tz * a, size * tz * b, size * m[2], size * m[3])
        size, turn = math.hypot(trm[2], trm[3]), math.atan2(trm[1], trm[0])
        if "glyph" in self.want:
            self.runs.append((self.seq, codes, texts, x, y, far, size, turn, gs.mode, gs.fill, gs.fa, gs.font_name, font["base"], font["flags"], self.span, trm))
        if "run" in self.want:
            self._run_rows(texts, x, y, far, size, turn, gs.mode)
        if font["procs"]:
            for i, c in enumerate(codes):
                self.seq += 1
                if c in font["procs"]:
                    inner = gs.copy()
                    inner.ctm, inner.font = (trm[0] / 1000, trm[1] / 1000, trm[2] / 1000, trm[3] / 1000, float(x[i]), float(y[i])), None
                    tm, line = self.tm, self.line
                    self.run(font["procs"][c], res, inner, depth + 1)
                    self.tm, self.line = tm, line
        else:
            self.seq += len(codes)
        self.tm = concat((1.0, 0.0, 0.0, 1.0, float(pen[-1]), 0.0), self.tm)

    @staticmethod
    def _known(font: dict, codes: list[int]) -> dict[int, tuple[float, str]]:
        """Width in ems and text of the codes of a composite font, looked up once each."""
        known = font.setdefault("known", {})
        if len(known) > KNOWN:
            known.clear()
        for c in codes:
            if c not in known:
                known[c] = font["widths"].get(font["cmap"].cid(c), font["default"]) / 1000, (font["unicode"].text(c) or "") if font["unicode"] else ""
        return known

    def _run_rows(self, texts, x, y, advance, size: float, turn: float, mode: int) -> None:
        """A shown string as one row: its pen goes on without gaps, so there are no generated spaces and
        no line breaks inside, unless it steps back; then each glyph is a row."""
        text = "".join(texts)
        if len(texts) > 1 and (any(v < 0 for v in advance) if isinstance(advance, list) else (advance < 0).any()):
            parts = [slice(i, i + 1) for i in range(len(texts))]
        else:
            parts = [slice(0, len(texts))]
        for k, cut in enumerate(parts):
            some, a, b = (text if len(parts) == 1 else texts[cut.start]), cut.start, cut.stop
            if some and "\u00ad" not in some and len(some) == b - a:  # every glyph has a character
                first, last = a, b - 1
            else:
                seen = [i for i in range(a, b) if texts[i].replace("\u00ad", "")]
                first, last = (seen[0], seen[-1]) if seen else (None, None)
            if self.span:
                first = last = a
            at = lambda v, i: None if i is None else float(v[i])
            self.shown.append((self.seq + k, some, self.span, float(x[a]), float(y[a]), at(x, first), at(y, first), at(x, last), at(y, last), float(x[b]), float(y[b]), float(y[b - 1]), texts[b - 1], first == a, b - a, size, turn, mode))

    def _object(self, res: dict, name: str, gs: State, depth: int) -> None:
        x = entry(res, "objects", name)
        if x is None:
            return
        if x["kind"] == "image":
            self._image(str(name), x["stream"], gs, {}, x["num"])
        elif not x["open"]:
            x["open"] = True  # a form inside itself is left out
            inner = gs.copy()
            inner.ctm = concat(x["matrix"], gs.ctm)
            tm, line = self.tm, self.line
            try:
                self.run(x["content"], x["resources"] if x["resources"] is not None else res, inner, depth + 1)
            finally:
                x["open"] = False
            self.tm, self.line = tm, line

    @staticmethod
    def _components(spaces: dict, space) -> int:
        known = entry({"cs": spaces}, "cs", space)
        return components(space) if known is None else known

    def _image(self, name: str, s: Stream, gs: State, spaces: dict, num: int | None) -> None:
        d = s.dict
        w, h = d.get("Width"), d.get("Height")
        if not isinstance(w, int) or not isinstance(h, int) or not 0 < w < 1 << 31 or not 0 < h < 1 << 31:
            return
        data, codec = None, None
        if num is None:
            try:
                data, codec = decode(s)
            except FilterError:
                return
        mask = d.get("ImageMask") is True
        bpc = d.get("BitsPerComponent")
        n = 1 if mask else d.get("_n") or self._components(spaces, d.get("ColorSpace"))
        ctm = concat((1.0, 0.0, 0.0, -1.0, 0.0, 1.0), gs.ctm)
        if "image" in self.want:
            self.images.append((self.seq, name, ctm, corners(gs.ctm, (0, 0, 1, 1)), w, h, mask, 1 if mask else min(16, max(1, bpc if isinstance(bpc, int) else 8)), n, gs.fill, gs.fa, num, data, codec))
        self.seq += 1
