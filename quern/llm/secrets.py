"""Secret scans with a recursive decoding worklist.

A document's text is the first layer. Every layer is scanned; then the encoded parts in it (runs of URL escapes, of Unicode
and character escapes, base64, and compressed data within base64) are unwrapped into further layers, until no layer gives
a new one. Text in UTF-16 is read too. Each content is unwrapped once in a document, so that a layer that unwraps to itself ends; what is found in it
is handed up to every place where it stands, step by step, since each layer knows where in the layer above its characters
came from. So a span found in any layer is given in the text's own code points.
"""

from __future__ import annotations

import base64
import bz2
import codecs
import hashlib
import html
import itertools
import lzma
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import id_text, map_batches, small_batches, texts

#: Kinds in the order in which they are listed.
KINDS = ("assign", "access", "hex")
#: Bytes of a compressed layer that are held at once; a longer one is read to its end in windows of so many characters, that overlap.
MOST_HELD, WINDOW = 16 << 20, 8 << 20
#: Bytes that a decompressor gives at a time; steps of compression within a layer that can't be held, and of such layers within each other.
CHUNK, MOST_NESTED = 1 << 20, 32

_ASSIGN = re.compile(rb"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([a-z0-9+/_.=-]+)""")
_ACCESS = re.compile(rb"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(rb"[0-9a-f]{24,}")
_URL = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_ESCAPE = re.compile(r"(?:\\u[0-9A-Fa-f]{4}|\\u\{[0-9A-Fa-f]{1,6}\}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2}|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};)")
_BASE64 = re.compile(rb"[A-Za-z0-9+/_-]{16,}={0,2}")
#: Runs in which bytes may be written with escapes, plain characters between them, and the heads of compressed data in them.
_URL_RUN = re.compile(r"[A-Za-z0-9_.~!*'()/+$,;:@&=?-]*(?:%[0-9A-Fa-f]{2}[A-Za-z0-9_.~!*'()/+$,;:@&=?-]*)+")
_ONE_URL = re.compile(r"%([0-9A-Fa-f]{2})|.", re.S)
_ESCAPE_RUN = re.compile(r"(?:BZh[1-9]1AY&SY[ -~]{0,16}?|x)?(?:\\x|\\u00)[0-9A-Fa-f]{2}[ -~]*")
_ONE_BYTE = re.compile(r"""\\x([0-9A-Fa-f]{2})|\\u00([0-9A-Fa-f]{2})|\\([abfnrtv0\\'"])|.""", re.S)
_C_ESCAPES = dict(zip("abfnrtv0\\'\"", b"\a\b\f\n\r\t\v\0\\'\"", strict=True))
_COMPRESSED = re.compile(rb"\x1f\x8b\x08|BZh[1-9]1AY&SY|\xfd7zXZ\x00|x[\x01\x5e\x9c\xda]")
#: Base64 wrapped over lines, whose line ends may be escaped themselves and whose lines may be indented or quoted.
_WRAPPED = re.compile(rb"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+(?:(?:\r?\n|(?:\\r)?\\n)[ \t>]*+[A-Za-z0-9+/_-]++)+={0,2}")
_LINE_END = re.compile(rb"(?:\r?\n|(?:\\r)?\\n)[ \t>]*")
_STANDARD = bytes.maketrans(b"-_", b"+/")
#: UTF-8 that can be read, in bytes that can't as a whole.
_TEXT = re.compile(rb"(?:[\t\n\r\x20-\x7e]|[\xc3-\xdf][\x80-\xbf]|[\xe1-\xec][\x80-\xbf]{2}){8,}")
#: Text in UTF-16, of either order, as far as it is ASCII; and what is left of it elsewhere.
_WIDE = (re.compile(rb"(?:[\t\n\r\x20-\x7e]\x00){8,}"), re.compile(rb"(?:\x00[\t\n\r\x20-\x7e]){8,}"))
_NULS = re.compile("\0+")
_ONE_ESCAPE = re.compile(r"\\u\{([0-9A-Fa-f]+)\}|\\[uUx]([0-9A-Fa-f]+)|&#([0-9]+);|&#[xX]([0-9A-Fa-f]+);")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, end exclusive: the matches of each kind, leftmost and without overlap, that are long enough.

    All patterns are ASCII, so the bytes are searched, and only what is found is counted in code points.
    """
    raw = text.encode("utf-8", "surrogatepass")
    found = []
    if b"=" in raw or b":" in raw:
        found += [("assign", *m.span()) for m in _ASSIGN.finditer(raw.lower()) if len(m[1]) >= 6]
    if b"AKIA" in raw:
        found += [("access", *m.span()) for m in _ACCESS.finditer(raw)]
    found += [("hex", *m.span()) for m in _HEX.finditer(raw)]
    if not found or len(raw) == len(text):
        return found
    at = sorted({x for _, a, b in found for x in (a, b)})
    points, before, total = {}, 0, 0
    for x in at:
        total += len(raw[before:x].decode("utf-8", "surrogatepass"))
        points[x], before = total, x
    return [(k, points[a], points[b]) for k, a, b in found]


@dataclass
class Layer:
    """A text made from the one above, in pieces: where each starts, and whence it came.

    A piece is a whole number, to be added for the places above of characters that were kept, or a pair: the starts and
    the ends above of its characters (arrays, or one number for all).
    """

    text: str
    at: list[int]
    pieces: list

    def _place(self, i: int, end: bool) -> int:
        n = bisect_right(self.at, i) - 1
        piece = self.pieces[n]
        if isinstance(piece, int):
            return i + piece + end
        x = piece[end]
        return x if isinstance(x, int) else int(x[i - self.at[n]])

    def span(self, a: int, b: int) -> tuple[int, int]:
        """The part of the text above that [a, b) came from."""
        return self._place(a, False), self._place(b - 1, True)


@dataclass
class Found:
    spans: list[tuple[str, int, int]]
    base: list[tuple[str, int, int]]
    n_layers: int = 0
    n_cut: int = 0


def _utf8(parts: list[tuple[bytes, int, int]]) -> tuple[str, np.ndarray, np.ndarray]:
    """The text of bytes of which each has a place, and the places of its characters; bytes that are no UTF-8 become U+FFFD."""
    raw = b"".join(p for p, _, _ in parts)
    size = [len(p) for p, _, _ in parts]
    a, b = np.repeat([p[1] for p in parts], size), np.repeat([p[2] for p in parts], size)
    text = raw.decode("utf-8", "replace")
    width = np.array([len(c.encode()) for c in text], np.int64)
    if width.sum() != len(raw):  # replaced bytes: places are given one by one as far as they go
        out, i = [], 0
        for c in text:
            n = 1 if c == "\ufffd" and raw[i : i + 3] != b"\xef\xbf\xbd" else len(c.encode())
            out.append((i, min(i + n, len(raw))))
            i = min(i + n, len(raw) - 1)
        return text, a[[x for x, _ in out]], b[[max(x, y - 1) for x, y in out]]
    last = np.cumsum(width)
    return text, a[last - width], b[last - 1]


def _rewritten(text: str, pattern: re.Pattern, decode) -> Layer | None:
    """The text with every match of the pattern decoded, the rest as it is."""
    texts_, at, pieces, size, done = [], [], [], 0, 0

    def put(part, piece):
        nonlocal size
        if part:
            texts_.append(part), at.append(size), pieces.append(piece)
            size += len(part)

    for m in pattern.finditer(text):
        put(text[done : m.start()], done - size)
        part, a, b = decode(m)
        put(part, (a, b))
        done = m.end()
    if not done:
        return None
    put(text[done:], done - size)
    return Layer("".join(texts_), at, pieces) if texts_ else None


def _url(m: re.Match):
    s = m.start()
    return _utf8([(bytes([int(m[0][i + 1 : i + 3], 16)]), s + i, s + i + 3) for i in range(0, len(m[0]), 3)])


def _escape(m: re.Match):
    one = _ONE_ESCAPE.fullmatch(m[0])
    value = int(one[3]) if one[3] else int(one[1] or one[2] or one[4], 16)
    c = html.unescape(m[0]) if one[3] or one[4] else chr(value) if value < 0x110000 and not 0xD800 <= value < 0xE000 else "\ufffd"
    return c[:1], m.start(), m.end()


def _opener(head: bytes):
    """What makes a decompressor for data that begins with head, or None."""
    if head[:2] == b"\x1f\x8b":
        return lambda: zlib.decompressobj(31)
    if len(head) > 2 and head[0] & 15 == 8 and (head[0] << 8 | head[1]) % 31 == 0:
        return zlib.decompressobj
    if head[:3] == b"BZh":
        return bz2.BZ2Decompressor
    if head[:6] == b"\xfd7zXZ\x00":
        return lzma.LZMADecompressor
    return None


def _inflated(chunks: Iterator[bytes], left: list[bytes]) -> Iterator[bytes]:
    """What the compressed members at the head of the chunks hold, a little at a time; what follows them goes to left.

    Data that breaks off or is damaged gives what could be read.
    """
    data, members = b"", 0
    while True:
        while len(data) < 8 and (more := next(chunks, None)) is not None:
            data = (data + more).lstrip(b"\0") if members else data + more  # zeros may stand between members
        make = _opener(data)
        if make is None:
            if data:
                left.append(data)
            return
        d = make()
        try:
            while not d.eof:
                out = d.decompress(data, CHUNK)
                data = getattr(d, "unconsumed_tail", b"")
                if out:
                    yield out
                elif not data and not d.eof and getattr(d, "needs_input", True):
                    data = next(chunks, None)
                    if data is None:
                        return
        except (zlib.error, OSError, ValueError, EOFError, lzma.LZMAError):
            return
        data, members = d.unused_data.lstrip(b"\0"), members + 1


def _end(data: bytes, a: int) -> int:
    """Where the compressed members that start at a end; a if nothing can be read there."""
    at, left, size = a, [], 0

    def chunks():
        nonlocal at
        while at < len(data):
            chunk = data[at : at + 65536]
            at += len(chunk)
            yield chunk

    for out in _inflated(chunks(), left):
        size += len(out)
    return at - sum(map(len, left)) if size else a


def _windows(chunks: Iterator[bytes]) -> Iterator[tuple[str, bool]]:
    """Texts of about WINDOW characters that overlap by half, and whether a run without a gap may be longer than what they share."""
    decoder, held = codecs.getincrementaldecoder("utf-8")("replace"), ""
    for chunk in chunks:
        held += decoder.decode(chunk)
        if len(held) >= WINDOW:
            # The next one starts half a window back, at the last gap before that: only a run of a quarter at least is cut.
            half = len(held) // 2
            gap = max(held.rfind(" ", half // 2, half), held.rfind("\n", half // 2, half))
            yield held, gap < 0 or not any(c in held[half:] for c in " \n")
            held = held[half if gap < 0 else gap :]
    held += decoder.decode(b"", True)
    if held:
        yield held, False


def _opened(data: bytes) -> Iterator[tuple[str, bool, bool]]:
    """The texts in compressed data, opened until nothing compressed is left: text, whether it is a part of a long one, whether a bound cut it."""
    work, seen = [data], set()
    while work:
        data = work.pop()
        key = hashlib.sha256(data).digest()
        if key in seen:
            continue
        seen.add(key)
        if len(seen) > 1 and (text := _readable(data) or _narrowed(data)):
            yield text, False, False
        if _opener(data) is None:
            continue
        parts, size, left = [], 0, []
        stream = _inflated(iter([data]), left)
        for out in stream:
            parts.append(out)
            size += len(out)
            if size > MOST_HELD:
                break
        if size <= MOST_HELD:
            work += [x for x in (b"".join(parts), *left) if x]
            continue
        # Too long to be held: compressed data in it is opened as it streams by.
        lefts, depth = [left], 0
        flow = itertools.chain(parts, stream)
        while True:
            head = list(itertools.islice(flow, 1))
            flow = itertools.chain(head, flow)
            if not head or _opener(head[0][:8]) is None or depth == MOST_NESTED:
                break
            lefts.append([])
            flow, depth = _inflated(flow, lefts[-1]), depth + 1
        if depth == MOST_NESTED:
            yield "", True, True
        for text, whole in _windows(flow):
            if 4 * text.count("\0") > len(text):  # UTF-16
                text = text.replace("\0", "")
            if _mostly(text):
                yield text, True, whole
        for n, left in enumerate(lefts):
            work += left
            if n and left:  # only the start of what follows members in a stream is held
                yield "", True, True


def _narrowed(data: bytes) -> str | None:
    """data in UTF-16 as text, as far as it is ASCII: every other byte is zero then."""
    if 4 * data.count(0) <= len(data):
        return None
    text = data.replace(b"\0", b"").decode("utf-8", "replace").lstrip("\ufffd")
    return text if _mostly(text) else None


def _mostly(text: str) -> bool:
    """Whether nearly all of a text is printable."""
    odd = sum(text.count(c) for c in map(chr, [*range(9), 11, 12, *range(14, 32), 127, 0xFFFD]))
    return bool(text) and 20 * odd <= len(text)


def _readable(data: bytes) -> str | None:
    """data as text, if it is UTF-8, and nearly all of it is printable."""
    try:
        text = data.decode("utf-8")
    except UnicodeDecodeError:
        return None
    odd = sum(text.count(c) for c in map(chr, [*range(9), 11, 12, *range(14, 32), 127]))
    return text if text and 20 * odd <= len(text) else None


def _escaped_bytes(m: re.Match) -> tuple[bytes, list[int]]:
    """The bytes of a run of escapes and plain characters, and where each starts, with the end."""
    out, at = bytearray(), []
    for x in _ONE_BYTE.finditer(m[0]):
        out.append(int(x[1] or x[2], 16) if x[1] or x[2] else _C_ESCAPES[x[3]] if x[3] else ord(x[0]))
        at.append(m.start() + x.start())
    return bytes(out), [*at, m.end()]


def _url_bytes(m: re.Match) -> tuple[bytes, list[int]]:
    out, at = bytearray(), []
    for x in _ONE_URL.finditer(m[0]):
        out.append(int(x[1], 16) if x[1] else ord(x[0]))
        at.append(m.start() + x.start())
    return bytes(out), [*at, m.end()]


@dataclass
class Below:
    """What a text wraps: layers; kinds of secrets with their parts of the text, from layers too long to be held; how many layers those are and hold; how many were cut."""

    layers: list[Layer]
    spans: set
    n_long: int = 0
    n_cut: int = 0

    def open(self, data: bytes, a: int, b: int, depth: int) -> bool:
        """Puts in what compressed data that stands at [a, b) holds; False without any."""
        any_ = long = False
        for text, part, cut in _opened(data):
            any_ = True
            self.n_cut += cut
            if not part:
                self.layers.append(Layer(text, [0], [(a, b)]))
            elif text and depth == MOST_NESTED:
                self.n_cut += 1
            elif text:
                inside = scan(text, depth + 1)
                self.spans |= {(kind, a, b) for kind, _, _ in inside.spans}
                self.n_long += inside.n_layers + (not long)
                self.n_cut += inside.n_cut
                long = True
        return any_


def _unwrapped(text: str, depth: int) -> Below:
    """The layers one step below. depth: how many long layers the text is in."""
    out = Below([], set())
    if "%" in text and (x := _rewritten(text, _URL, _url)):
        out.layers.append(x)
    if ("\\" in text or "&#" in text) and (x := _rewritten(text, _ESCAPE, _escape)):
        out.layers.append(x)
    if "\0" in text and (x := _rewritten(text, _NULS, lambda m: ("", m.start(), m.end()))):
        out.layers.append(x)
    for sign, run, decode in (("%", _URL_RUN, _url_bytes), ("\\", _ESCAPE_RUN, _escaped_bytes)):
        if sign in text:
            for m in run.finditer(text):
                data, at = decode(m)
                done = 0
                for head in _COMPRESSED.finditer(data):
                    if (a := head.start()) >= done and (b := _end(data, a)) > a:
                        done = b if out.open(data[a:b], at[a], at[b], depth) else done
    raw = text.encode("utf-8", "surrogatepass")
    for m, first in _placed(_BASE64, raw, len(raw) == len(text)):
        _decoded(m[0], None, first, out, depth)
    for m, first in _placed(_WRAPPED, raw, len(raw) == len(text)):
        run = np.frombuffer(m[0], np.uint8)
        own = np.ones(len(run), bool)
        for gap in _LINE_END.finditer(m[0]):
            own[gap.start() : gap.end()] = False
        at = np.flatnonzero(own)
        _decoded(run[at].tobytes(), at, first, out, depth)
    return out


def _placed(pattern: re.Pattern, raw: bytes, ascii_: bool) -> Iterator[tuple[re.Match, int]]:
    """Matches, and the code points before each."""
    before = total = 0
    for m in pattern.finditer(raw):
        total += m.start() - before if ascii_ else len(raw[before : m.start()].decode("utf-8", "surrogatepass"))
        before = m.start()
        yield m, total


def _decoded(run: bytes, at: np.ndarray | None, first: int, out: Below, depth: int) -> None:
    """Puts in what a run of base64 holds. at: where its characters stand after first; None if one after another.

    If the run doesn't decode as a whole, all that can be read in it is taken, from any character on.
    """
    body = run.rstrip(b"=").translate(_STANDARD)
    place = (lambda i: i) if at is None else (lambda i: at[i])

    def part(content, lo, hi):
        """content, whose characters came from the bytes [lo, hi) of the decoded; four characters for three bytes."""
        a, b = skip + lo * 4 // 3, np.minimum(skip + -(-hi * 4 // 3), len(run))
        out.layers.append(Layer(content, [0], [(first + place(a), first + place(b - 1) + 1)]))

    def characters(content, before):
        width = np.array([len(c.encode()) for c in content], np.int64)
        last = before + np.cumsum(width)
        part(content, last - width, last)

    for skip in range(4):
        n = len(body) - skip
        n -= n % 4 == 1
        if n < 2:
            return
        data = base64.b64decode(body[skip : skip + n] + b"=" * (-n % 4))
        if not skip:
            end = len(run) if at is None else int(at[-1]) + 1
            if _opener(data) is not None and out.open(data, first, first + end, depth):
                return
            if (content := _readable(data)) is not None:
                characters(content, 0)
                return
        done = 0
        for head in _COMPRESSED.finditer(data):
            if (a := head.start()) >= done and (b := _end(data, a)) > a:
                x, y = skip + a * 4 // 3, min(skip + -(-b * 4 // 3), len(run))
                done = b if out.open(data[a:b], first + int(place(x)), first + int(place(y - 1)) + 1, depth) else done
        for m in _TEXT.finditer(data):
            characters(m[0].decode("utf-8"), m.start())
        if b"\0" in data:
            for order, wide in enumerate(_WIDE):
                for m in wide.finditer(data):
                    content = m[0][order::2].decode("ascii")
                    lo = m.start() + 2 * np.arange(len(content))
                    part(content, lo, lo + 2)


def scan(text: str, depth: int = 0) -> Found:
    """Every secret in a text and in what it wraps. Spans are of the text; a span found twice counts once. depth: how many long layers it is in."""
    base = base_spans(text)
    base.sort(key=lambda s: (s[1], KINDS.index(s[0]), s[2]))
    found = Found(list(base), base)
    if not ("%" in text or "\\" in text or "&#" in text or "\0" in text or _BASE64.search(text.encode("utf-8", "surrogatepass"))):
        return found
    # The distinct contents: spans of each, and the layers by which it stands in others.
    number = {hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest(): 0}
    spans: list[set] = [set(base)]
    above: list[list[tuple[int, Layer]]] = [[]]
    work = [(0, text)]
    while work:
        i, content = work.pop()
        below = _unwrapped(content, depth)
        found.n_cut += below.n_cut
        found.n_layers += below.n_long
        spans[i] |= below.spans
        for x in below.layers:
            content, x.text = x.text, ""
            j = number.setdefault(hashlib.sha256(content.encode("utf-8", "surrogatepass")).digest(), len(spans))
            if j == len(spans):
                spans.append(set(base_spans(content)))
                above.append([])
                work.append((j, content))
            above[j].append((i, x))
    found.n_layers += len(spans) - 1
    new = [(j, s) for j in range(1, len(spans)) for s in spans[j]]
    while new:
        j, (kind, a, b) = new.pop()
        for i, x in above[j]:
            s = (kind, *x.span(a, b))
            if s not in spans[i]:
                spans[i].add(s)
                new.append((i, s))
    found.spans = sorted(spans[0], key=lambda s: (s[1], KINDS.index(s[0]), s[2]))
    return found


def joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base (the base spans), spans (all), n_layers, n_cut: one row for each row of docs; of an empty table none.

    base and spans list kind:start:end in code points, end exclusive, ordered by start, then kind, joined by commas. A
    null text counts as empty: no spans, as for texts without any. n_layers: layers opened below the text; n_cut: places
    in them where a bound was met: a run without a gap across a window's end, or too many long layers within each other. Rows with repeated or null ids are scanned like any other. Only the two columns are read.
    """
    def run(batch):
        all_ = [scan(t) for t in texts(batch)]
        out = {f"n_{kind}": [sum(s[0] == kind for s in f.base) for f in all_] for kind in KINDS}
        return out | {"doc_id": batch.column("doc_id"), "base": [joined(f.base) for f in all_], "spans": [joined(f.spans) for f in all_], "n_layers": [f.n_layers for f in all_], "n_cut": [f.n_cut for f in all_]}

    return map_batches(id_text(docs, id_col, text_col).selectExpr("cast(doc_id AS long) AS doc_id", "text"), run, "doc_id long, n_assign long, n_access long, n_hex long, base string, spans string, n_layers long, n_cut long")


def redacted(text: str, mark: str = "[secret]") -> str:
    """A text with every span that scan() finds replaced by mark; spans that touch or overlap are replaced together."""
    out, at = [], 0
    for a, b in _merged([(a, b) for _, a, b in scan(text).spans]):
        out += [text[at:a], mark]
        at = b
    return "".join(out) + text[at:]


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """docs with the secrets of its texts replaced by mark; a null text stays null, an empty one empty. Other columns, of any names, and all rows stay; an empty table stays empty."""
    @pandas_udf("string")
    def clean(text: pd.Series) -> pd.Series:
        return text.map(lambda t: redacted(t, mark) if t else t)

    return small_batches(docs).withColumn(text_col, clean(F.col(f"`{text_col}`")))
