"""Personal data: plain patterns, and a semi-Markov conditional random field that adds what they miss.

The field scores whole candidate spans (their shape, digits, what stands beside them, words before them), and dynamic
programming over segments of at most MOST_TOKENS tokens chooses boundaries and types together. It is fitted here, on
sentences made from templates by a fixed seed, which hold entities in many forms and numbers that are none. A text is
decoded only around digits and addresses, spelt out or not; elsewhere no span can be an entity. Where no candidate covers a
token the sequence is cut, which changes nothing in its best segmentation; so work and memory grow with the text alone.
"""

from __future__ import annotations

import math
import random
import re
from bisect import bisect_right
from collections import defaultdict, deque
from collections.abc import Iterator
from functools import cache, lru_cache

from pyspark.sql import DataFrame

from .common import id_text, map_batches, texts

#: Kinds in the order in which they are listed; the last label is of tokens outside entities.
KINDS = ("email", "ip", "card", "phone")
OUTSIDE = len(KINDS)
#: Tokens, characters, digits and groups of digits of an entity at most; sentences and passes of the fit; its step and shrinkage; log odds that an added span needs over none.
MOST_TOKENS, MOST_CHARS, MOST_DIGITS, MOST_GROUPS, SENTENCES, PASSES, STEP, SHRINK, MARGIN = 21, 320, 19, 6, 1200, 4, 0.3, 1e-3, 2.0

_IP = re.compile(rb"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(rb"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(rb"\+[0-9][\x20().0-9-]+[0-9]")
_DOMAIN = re.compile(rb"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _emails(raw: bytes) -> list[tuple[int, int]]:
    """Matches of the address pattern, found from each @ outwards, so that long runs without one cost nothing."""
    out, done, at = [], 0, raw.find(b"@")
    while at >= 0:
        a = at
        while a > done and raw[a - 1] in _LOCAL:
            a -= 1
        m = _DOMAIN.match(raw, at + 1) if a < at else None
        if m:
            out.append((a, m.end()))
            done = m.end()
        at = raw.find(b"@", max(at + 1, done))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, end exclusive, by kind as listed, then start."""
    raw = text.encode("utf-8", "surrogatepass")
    found = [("email", a, b) for a, b in _emails(raw)] if b"@" in raw else []
    if b"." in raw:
        found += [("ip", *m.span()) for m in _IP.finditer(raw) if all(len(p := x.lstrip(b"0")) <= 3 and int(p or b"0") <= 255 for x in m[0].split(b"."))]
    for m in _CARD.finditer(raw):
        digits = m[0].replace(b" ", b"").replace(b"-", b"")
        if 13 <= len(digits) <= 19 and luhn(digits.decode()):
            found.append(("card", *m.span()))
    if b"+" in raw:
        found += [("phone", *m.span()) for m in _PHONE.finditer(raw) if 9 <= sum(48 <= c <= 57 for c in m[0]) <= 15]
    if not found or len(raw) == len(text):
        return found
    points, before, total = {}, 0, 0
    for x in sorted({x for _, a, b in found for x in (a, b)}):
        total += len(raw[before:x].decode("utf-8", "surrogatepass"))
        points[x], before = total, x
    return [(k, points[a], points[b]) for k, a, b in found]


# ---- the field

_TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|\s+|.", re.S)
_AT = r"(?:@|\s?[\[({]\s?at\s?[\])}]\s?|\sat\s)"
_DOT = r"(?:\.|\s?[\[({]\s?dot\s?[\])}]\s?|\sdot\s)"
_WORD = r"[A-Za-z0-9%+-]{1,64}"
_MAIL_FORM = re.compile(rf"{_WORD}(?:(?:_|{_DOT}){_WORD})*{_AT}[A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+)+", re.I)
#: An 'at' that is spelt out, what may stand before it, and the domain behind it: with a bracket or a ' dot ' somewhere.
_SPELT_AT = re.compile(r"\s?[\[({]\s?at\s?[\])}]\s?|\sat\s", re.I)
_SPELT_LOCAL = re.compile(rf"(?<!\S)(?:{_WORD}(?:_|{_DOT}))*{_WORD}\Z", re.I)
_SPELT_DOMAIN = re.compile(rf"[A-Za-z0-9-]{{1,63}}(?:{_DOT}[A-Za-z0-9-]{{1,63}}){{1,8}}", re.I)
_SPELT_DOT = re.compile(r"[\[({]\s?dot\s?[\])}]|\sdot\s", re.I)
_NUMBER_FORM = re.compile(r"[+(]?[0-9](?:[\s().\-/]*[0-9])*")
_MARK, _GAP = re.compile("[0-9@]"), re.compile(r"\s")
#: Words before a span that say something of it, in natural order of their kinds.
CUES = {
    "email": ("email", "e-mail", "mail", "contact", "courriel", "correo"),
    "ip": ("ip", "host", "server", "address"),
    "card": ("card", "visa", "mastercard", "amex", "credit", "karte", "kreditkarte", "carte", "tarjeta"),
    "phone": ("phone", "tel", "telephone", "call", "fax", "mobile", "cell", "ring", "dial", "reach", "text", "whatsapp", "telefon", "handy", "rufnummer", "tél", "téléphone", "appelez", "teléfono", "móvil", "llame"),
    "none": ("order", "id", "ref", "reference", "invoice", "version", "isbn", "issn", "build", "page", "date", "item", "serial", "iban", "account", "vat", "part", "code", "case", "ticket", "tracking", "room", "bestellung", "rechnung", "konto", "commande", "facture", "compte", "pedido", "factura", "cuenta"),
}
#: Last labels of addresses that are spelt out in plain words.
ENDINGS = ("com", "org", "net", "edu", "gov", "io", "info", "example", "de", "fr", "es", "uk", "eu")
_CUE = {w: k for k, words in CUES.items() for w in words}
#: Characters before a stretch in which words are looked for, and tokens for which a word says something.
BEFORE, HOLDS = 60, 14


def _shape(s: str) -> str:
    out = []
    for t in _TOKEN.findall(s):
        out.append(str(len(t)) if t.isdigit() else "a" if t.isalpha() else " " if t.isspace() else t)
    return "".join(out)


def _candidate(s: str, left: str, right: str) -> tuple[int, ...]:
    """The types that a span may have at all, between two characters ('' at an end). Numbers aren't parts of words, and cards pass their checksum."""
    if "@" in s or s[:1].isalpha() and s[-1:].isalnum():
        plain = "@" in s or any(c in s for c in "[({")  # else the ending must be one that addresses have
        return (0,) if _MAIL_FORM.fullmatch(s) and (plain or s.lower().rpartition(" ")[2] in ENDINGS) else ()
    if left.isalnum() or right.isalnum() or left == "_" or not _NUMBER_FORM.fullmatch(s):
        return ()
    groups = re.findall("[0-9]+", s)
    digits = "".join(groups)
    if len(groups) > MOST_GROUPS:
        return ()
    out = []
    if s.count(".") == 3 and re.fullmatch(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}", s):
        out.append(1)
    if 13 <= len(digits) <= MOST_DIGITS and s[0].isdigit() and not set("()/") & set(s) and luhn(digits):
        out.append(2)
    if 7 <= len(digits) <= 15:
        out.append(3)
    return tuple(out)


def _neighbour(text: str, at: int, step: int) -> str:
    """What stands next to a span, behind one space: a number, something like the beginning of an IBAN, a 'dot' or 'at', another word or nothing."""
    x = text[at:at + 8] if step > 0 else text[max(0, at - 8) : at]
    if not x or not x[0 if step > 0 else -1].isspace():
        return "none"
    x = x.strip()
    if step < 0 and re.search(r"(?:^|\s)[A-Z]{2}[0-9]{2}\Z", x):
        return "iban"
    w = re.search(r"\A[^\W\d_]+" if step > 0 else r"[^\W\d_]+\Z", x)
    if w and w[0].lower() in ("dot", "at"):
        return "dot"
    c = x[:1] if step > 0 else x[-1:]
    return "digit" if c.isdigit() else "word" if c.isalpha() else "other"


@lru_cache(1 << 16)
def _features(s: str, left: str, right: str, before: str, after: str, cue: str) -> list[str]:
    """What is said of a span: between two kinds of characters, behind and before two kinds of neighbours, near a word of a kind."""
    digits = "".join(filter(str.isdigit, s))
    groups = [len(g) for g in re.findall("[0-9]+", s)]
    out = ["bias", f"n={len(digits)}", f"cue={cue}", f"left={left}", f"right={right}", f"shape={_shape(s)}", f"plus={s[0] == '+'}", f"before={before}", f"after={after}"]
    if "@" in s or s[-1].isalpha():
        out.append("at=" + ("sign" if "@" in s else "bracket" if set("[({") & set(s) else "plain"))
    elif digits and s[-1].isdigit():
        zero = digits[0] == "0"
        out += [f"zero={zero}", f"zero={zero},n={len(digits)}", f"cue={cue},n={len(digits)}", f"cue={cue},groups={min(len(groups), 6)}", f"groups={'-'.join(map(str, groups[:6]))}", f"bracket={s[0] == '('}"]
        if s.count(".") == 3:
            out.append(f"ip={all(p.isdigit() and int(p) <= 255 for p in s.split('.'))}")
        out.append(f"seps={''.join(sorted(set(c for c in s if not c.isalnum())))},{len(groups)}")
        out.append(f"year={len(groups[0:1]) and groups[0] == 4 and s[:2] in ('19', '20')}")
    return out


def _beside(c: str) -> str:
    return "edge" if not c else "space" if c.isspace() else "digit" if c.isdigit() else "letter" if c.isalpha() else c


def _pieces(text: str, start: int, end: int) -> Iterator[tuple[list, list]]:
    """The parts of a stretch that candidates cover, with the token behind each: tokens as (a, b), and segments (first token, token after the last, type, features)."""
    stream, window = _TOKEN.finditer(text, start, end), deque()
    mail = "@" in text[start:end] or bool(_SPELT_AT.search(text, start, end))
    before = re.findall(r"[^\W\d_][\w-]*", text[max(0, start - BEFORE) : start])[-6:]
    cue, left = next(((_CUE[w.lower()], HOLDS - 2 * n) for n, w in enumerate(reversed(before)) if w.lower() in _CUE), ("", 0))
    tokens: list = []
    segments: list = []
    i = reach = 0
    while True:
        while len(window) < MOST_TOKENS and (m := next(stream, None)) is not None:
            window.append(m.span())
        if not window:
            break
        a, b = window[0]
        head = text[a : min(b, a + MOST_CHARS)]
        left -= 1
        if head.isalpha() and head.lower() in _CUE:
            cue, left = _CUE[head.lower()], HOLDS
        found = []
        if head[0].isalnum() or head[0] in "+(":
            digits = groups = 0
            for j, (x, z) in enumerate(window):
                first = text[x]
                if z - a > MOST_CHARS or not mail and first.isalpha():
                    break
                if first.isdigit():
                    digits, groups = digits + z - x, groups + 1
                    if not mail and (digits > MOST_DIGITS or groups > MOST_GROUPS):
                        break
                if not mail and digits < 7 and groups != 4:  # neither a phone's digits nor an ip's parts
                    continue
                beside = text[a - 1 : a] if a else "", text[z : z + 1]
                if first.isalnum() and (types := _candidate(s := text[a:z], *beside)):
                    f = _features(s, *map(_beside, beside), _neighbour(text, a, -1), _neighbour(text, z, 1), cue if left > 0 else "")
                    found += [(i + j + 1, y, f) for y in types]
        if found or tokens:
            base = i - len(tokens)
            tokens.append((a, b))
            segments += [(i - base, j - base, y, f) for j, y, f in found]
            reach = max([reach, *(j for j, _, _ in found)])
            if i >= reach:  # no candidate covers this token
                yield tokens, segments
                tokens, segments = [], []
        window.popleft()
        i += 1
    if tokens:
        yield tokens, segments


class Field:
    """Weights of (type, feature) and of one type after another."""

    def __init__(self):
        self.weight: dict[tuple[int, str], float] = defaultdict(float)
        self.after = [[0.0] * (OUTSIDE + 1) for _ in range(OUTSIDE + 1)]

    def _score(self, y: int, features: list[str]) -> float:
        get = self.weight.get
        return sum(get((y, f), 0.0) for f in features)

    def _ends(self, tokens, segments):
        ends = [[] for _ in range(len(tokens) + 1)]
        for i in range(len(tokens)):
            ends[i + 1].append((i, OUTSIDE, self.weight.get((OUTSIDE, "bias"), 0.0), None))
        for i, j, y, f in segments:
            ends[j].append((i, y, self._score(y, f), f))
        return ends

    def decode(self, tokens, segments) -> list[tuple[int, int, int, float]]:
        """The best segmentation's entities: (first token, token after the last, type, log odds against the same tokens being outside)."""
        best = [[-math.inf] * (OUTSIDE + 1) for _ in range(len(tokens) + 1)]
        back: list[list] = [[None] * (OUTSIDE + 1) for _ in range(len(tokens) + 1)]
        best[0][OUTSIDE] = 0.0
        for j, ends in enumerate(self._ends(tokens, segments)):
            for i, y, score, _ in ends:
                for x in range(OUTSIDE + 1):
                    v = best[i][x] + self.after[x][y] + score
                    if v > best[j][y]:
                        best[j][y], back[j][y] = v, (i, x, score)
        out, j, y = [], len(tokens), max(range(OUTSIDE + 1), key=lambda y: best[-1][y])
        none = self.weight.get((OUTSIDE, "bias"), 0.0)
        while j:
            i, x, score = back[j][y]
            if y != OUTSIDE:
                out.append((i, j, y, score - none * (j - i)))
            j, y = i, x
        return out[::-1]

    def learn(self, tokens, segments, truth: set[tuple[int, int, int]], squares: dict) -> None:
        """One step up the conditional log likelihood of a sentence's true segments, by the forward and backward sums over all segmentations."""
        n, ends = len(tokens), self._ends(tokens, segments)
        types = range(OUTSIDE + 1)
        ahead = [[-math.inf] * (OUTSIDE + 1) for _ in range(n + 1)]
        ahead[0][OUTSIDE] = 0.0
        for j in range(1, n + 1):
            got = defaultdict(list)
            for i, y, score, _ in ends[j]:
                got[y] += [ahead[i][x] + self.after[x][y] + score for x in types if ahead[i][x] > -math.inf]
            for y, v in got.items():
                ahead[j][y] = _log_sum(v)
        behind = [[-math.inf] * (OUTSIDE + 1) for _ in range(n + 1)]
        behind[n] = [0.0] * (OUTSIDE + 1)
        for j in range(n, 0, -1):
            for i, y, score, _ in ends[j]:
                if behind[j][y] > -math.inf:
                    for x in types:
                        behind[i][x] = _log_sum([behind[i][x], behind[j][y] + self.after[x][y] + score])
        total = _log_sum(ahead[n])
        inside = {k for a, b, _ in truth for k in range(a, b)}
        slope: dict = defaultdict(float)
        for j in range(1, n + 1):
            for i, y, score, f in ends[j]:
                p = 0.0
                for x in types:
                    if ahead[i][x] > -math.inf and behind[j][y] > -math.inf:
                        q = math.exp(min(0.0, ahead[i][x] + self.after[x][y] + score + behind[j][y] - total))
                        p += q
                        slope["after", x, y] -= q
                is_ = (i, j, y) in truth if y != OUTSIDE else i not in inside
                if is_ or p > 1e-6:
                    for g in f or ("bias",):
                        slope[y, g] += is_ - p
        at, last = 0, OUTSIDE
        for a, b, y in sorted(truth):
            for _ in range(at, a):
                slope["after", last, OUTSIDE] += 1
                last = OUTSIDE
            slope["after", last, y] += 1
            at, last = b, y
        for _ in range(at, n):
            slope["after", last, OUTSIDE] += 1
            last = OUTSIDE
        for k, g in slope.items():
            old = self.after[k[1]][k[2]] if len(k) == 3 else self.weight[k]
            g -= SHRINK * old
            squares[k] += g * g
            new = old + STEP * g / math.sqrt(squares[k] + 1e-8)
            if len(k) == 3:
                self.after[k[1]][k[2]] = new
            else:
                self.weight[k] = new


def _log_sum(v: list[float]) -> float:
    top = max(v)
    return top if top == -math.inf else top + math.log(sum(math.exp(x - top) for x in v))


def _sentences(seed: int = 11):
    """Made sentences: (text, [(type, start, end)])."""
    r = random.Random(seed)
    digits = lambda n: "".join(r.choices("0123456789", k=n))
    word = lambda: "".join(r.choices("abcdefghilmnoprstuv", k=r.randint(2, 9)))

    def filled(form):
        return "".join(r.choice("0123456789") if c == "d" else r.choice("23456789") if c == "n" else c for c in form)

    def card():
        body = r.choice("3456") + digits(r.choice([14, 14, 14, 13, 12]))
        full = next(body + c for c in "0123456789" if luhn(body + c))
        sep = r.choice(["", "", " ", "-", ".", "  "])
        return sep.join(full[i : i + 4] for i in range(0, len(full), 4))

    def phone():
        """National and international forms; those that other numbers share mostly stand behind a word for them."""
        sure = ["(ndd) ndd-dddd", "ndd-ndd-dddd", "ndd.ndd.dddd", "(ndd)ndd-dddd", "+1 (ndd) ndd-dddd", "1-ndd-ndd-dddd", "00nd nd ddd dddd", "+nd nd dddd dddd", "0nd/ddddddd", "0nd/ndd-dddd", "0nd nddd dddd", "0nddd dddddd", "0n dd dd dd dd", "0ndd-dddddd", "(0nd) ndddddd", "(0nd) nddd dddd", "0nd-nddd-dddd", "0n.dd.dd.dd.dd"]
        other = ["ndd ndd dddd", "nd ddd dd dd", "ndd dd dd dd", "ndd ddd ddd", "ndd-dddd", "nddddddddd", "0nddddddddd"]
        return filled(r.choice(sure)) if r.random() < 0.7 else (filled(r.choice(other)),)

    def mail():
        at, dot = r.choice([("@", "."), ("@", "."), (" [at] ", " [dot] "), ("(at)", "(dot)"), (" at ", " dot "), ("[at]", "[dot]"), ("[at]", "."), (" at ", " dot ")])
        local = word() + r.choice(["", r.choice([".", dot, "_"]) + word(), digits(2)])
        return local + at + dot.join([word(), *r.choice([["com"], ["org"], ["net"], ["example"], ["co", "uk"]])])

    def ip():
        return ".".join(str(r.randint(0, 255)) for _ in range(4))

    def none():
        """Numbers of other kinds: dates, times, amounts, identifiers, account and article numbers, ranges, lists."""
        long_ = digits(r.randint(13, 19))
        if luhn(long_):
            long_ = long_[:-1] + str((int(long_[-1]) + 1) % 10)
        wrong = " ".join(long_[i : i + 4] for i in range(0, 16, 4))
        iban = r.choice(["DE", "FR", "ES", "GB", "IT"]) + digits(2) + "".join(r.choice([" ", " ", ""]) + digits(4) for _ in range(r.randint(2, 5))) + r.choice(["", " " + digits(2)])
        forms = ["20dd-0n-1d", "dd:dd:dd", "d.d.dd", "dd,ddd.dd", "ndd.dd.d.ddd", "1d/0n/20dd", "978-d-dddd-dddd-d", "dddd dddd", "ddd ddd", "vd.d.d.d", "#dddddddd", "$dddd.dd", "dddd-dddd", "19dd-19dd", "20dd-20dd", "nd nd nd nd", "ddddd-dddd", "ddd-dd", "20dd 20dd", "1d.0n.20dd", "20dd0n1ddddd", "nd ddd ddd", "n ddd ddd", "ndd ddd ddd", "n,ddd,ddd", "nd.dddddd", "dd.ddddd, dd.ddddd", "ddd-ddddddd-ddddddd", "AB-dddd-dddd", "dddd.dd.dd", "dddd/dddd", "n.nnn.nnn,dd", "20dd-0n-1d 1d:dd:dd", "1-d, d-1d, 1d-2d", "nnd nnd nnd nnd"]
        return r.choice([iban, wrong, long_, digits(r.randint(1, 12)), f"{word()}{digits(5)}", f"{word()}-{digits(3)}-{digits(4)}", " ".join(digits(r.randint(1, 3)) for _ in range(r.randint(3, 9))), digits(r.choice([7, 8, 10, 11])), *[filled(f) for f in r.choices(forms, k=8)]])

    makers = [mail, ip, card, phone]
    for _ in range(SENTENCES):
        text, spans = word().capitalize(), []
        for _ in range(r.randint(1, 3)):
            y = r.choice([0, 1, 2, 3, 3, OUTSIDE, OUTSIDE, OUTSIDE, OUTSIDE])
            s = none() if y == OUTSIDE else makers[y]()
            hidden = isinstance(s, tuple)  # a form that tells little by itself
            text += " " + " ".join(word() for _ in range(r.randint(1, 3)))
            cue = r.choice(CUES["none" if y == OUTSIDE else KINDS[y]]) if r.random() < (0.9 if hidden else 0.4) else ""
            text += f" {r.choice([cue, cue, cue.capitalize()])}{r.choice([':', '', '', ' ' + word(), ' me on', ' is', ' ' + word() + ' ' + word()])}" if cue else ""
            text += r.choice([" ", " ", " ", " (", ' "'])
            s = s[0] if hidden else s
            if y != OUTSIDE:
                spans.append((y, len(text), len(text) + len(s)))
            text += s + r.choice(["", "", ",", ".", ")", '"', ";"])
        yield text + " " + word() + ".", spans


@cache
def field() -> Field:
    """The fitted field; the same weights on every call and machine. It is fitted once for each process that asks."""
    out, squares = Field(), defaultdict(float)
    made = []
    for text, spans in _sentences():
        for a, b in stretches(text):
            for tokens, segments in _pieces(text, a, b):
                at = {x: i for i, (x, _) in enumerate(tokens)}
                ends = {y: i + 1 for i, (_, y) in enumerate(tokens)}
                known = {(i, j, y) for i, j, y, _ in segments}
                truth = {(at[x], ends[z], y) for y, x, z in spans if x in at and z in ends}
                if truth <= known:
                    made.append((tokens, segments, truth))
    for _ in range(PASSES):
        for x in made:
            out.learn(*x, squares)
    out.weight = dict(out.weight)
    return out


def stretches(text: str) -> list[tuple[int, int]]:
    """Parts of a text in which entities may be, found from digits, @ and spelt-out 'at's outwards: runs of chunks between white space with a digit or an @ that hold an @ or 4 digits at least, and addresses spelt out."""
    found, at = [], 0
    while m := _MARK.search(text, at):
        a = m.start()
        while a > at and not text[a - 1].isspace():
            a -= 1
        gap = _GAP.search(text, m.end())
        at = gap.start() if gap else len(text)
        if found and found[-1][1] + 1 == a and text[a - 1] in "  ":
            found[-1] = (found[-1][0], at)
        else:
            found.append((a, at))
    found = [(a, b) for a, b in found if "@" in text[a:b] or sum(map(str.isdigit, text[a:b])) >= 4]
    spelt, done = [], 0
    for m in _SPELT_AT.finditer(text):
        low = max(done, m.start() - MOST_CHARS // 2)
        domain = _SPELT_DOMAIN.match(text, m.end())
        if domain and (m[0].strip()[:1] in "[({" or _SPELT_DOT.search(domain[0])) and (local := _SPELT_LOCAL.search(text[low : m.start()])):
            spelt.append((low + local.start(), domain.end()))
            done = domain.end()
    if not spelt:
        return found
    out: list[tuple[int, int]] = []
    for a, b in sorted(found + spelt):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def added_spans(text: str, base: list[tuple[str, int, int]], model: Field) -> list[tuple[str, int, int]]:
    """What the field finds beside the base spans; where they overlap, the base span stays and the field's goes."""
    taken: list[tuple[int, int]] = []
    for a, b in sorted((a, b) for _, a, b in base):
        if taken and a <= taken[-1][1]:
            taken[-1] = (taken[-1][0], max(b, taken[-1][1]))
        else:
            taken.append((a, b))
    out = []
    for a, b in stretches(text):
        for tokens, segments in _pieces(text, a, b):
            for i, j, y, odds in model.decode(tokens, segments):
                x, z = tokens[i][0], tokens[j - 1][1]
                k = bisect_right(taken, (z,)) - 1  # the last that begins before z
                if odds >= MARGIN and not (k >= 0 and taken[k][0] < z and x < taken[k][1]):
                    out.append((KINDS[y], x, z))
    return out


def scan(text: str, model: Field) -> tuple[list, list]:
    """(base spans, all spans), each by kind, then start."""
    base = base_spans(text)
    more = added_spans(text, base, model)
    return base, sorted(base + more, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, n_spans, base, spans: one row for each row of docs.

    base and spans list kind:start:end in code points, end exclusive, by kind as listed, then start, joined by commas: the
    patterns' spans, counted by kind, and those with the field's, n_spans in all. A null text counts as empty: no spans.
    Repeated and null ids are scanned like others. Only the two columns are read. An empty table gives an empty table.
    """
    model = field()

    def run(batch):
        found = [scan(t, model) for t in texts(batch)]
        out = {f"n_{k}": [sum(s[0] == k for s in b) for b, _ in found] for k in KINDS}
        return out | {"doc_id": batch.column("doc_id"), "n_spans": [len(s) for _, s in found], "base": [joined(b) for b, _ in found], "spans": [joined(s) for _, s in found]}

    return map_batches(id_text(docs, id_col, text_col).selectExpr("cast(doc_id AS long) AS doc_id", "text"), run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, n_spans long, base string, spans string")
