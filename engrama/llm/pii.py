"""Personal data in texts, also in disguise, with spans of the source characters.

Base detectors read the text as it is. Where a text holds signs of disguise,
transducers rewrite it (homoglyphs and invisible characters first, then
spelled digits, signs in brackets and spaced dots, then spaced ats), each keeping for every
character it writes the source characters it stands for; the same detectors read the
result, and what they find is mapped back.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engrama.llm.shared import without

KINDS = ("email", "ip", "card", "phone")
# What the base patterns are made of.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
NON_DIGIT = re.compile("[^0-9]+")
A_DIGIT = re.compile("[0-9]")

# Letters that look like ASCII ones, and words for digits in four languages.
HOMOGLYPHS = dict(zip("аеорсхуіјѕԁһкмтвнАВЕКМНОРСТУХІЈЅοαιρυνκΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeopcxyijsdhkmtbhABEKMHOPCTYXIJSoaipuvkABEZHIKMNOPTYX", strict=True))
INVISIBLE = "\u00ad\u200b\u200c\u200d\u200e\u200f\u2060\ufeff"
DIGIT_WORDS = {
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}

#: Full-width forms of ASCII and the mathematical digits are folded by rule.
ODD = re.compile("[" + "".join(HOMOGLYPHS) + INVISIBLE + "！-～\U0001d7ce-\U0001d7ff]")
_WORD = "|".join(sorted(DIGIT_WORDS, key=len, reverse=True))
_DOT = r"(?:dot|punkt|punto|point)"
_AT = r"(?:at|ät|arroba|arobase)"


def _spelled(separator: str, least: int) -> re.Pattern:
    """Runs of digit words and groups of digits, `least` of them at least, between which stands a separator."""
    return re.compile(rf"(?<!\w)(?P<plus>plus{separator})?(?:{_WORD}|[0-9]+)(?!\w)(?:{separator}(?:{_WORD}|[0-9]+)(?!\w)){{{least - 1},}}", re.I)


#: Full stops separate digits of a long run; else they stay as they are, for addresses.
SPELLED_LONG = _spelled(r"[\s,.\-]{1,3}", 6)
SPELLED = _spelled(r"[\s,\-]{1,3}", 1)
SPELLED_PART = re.compile(rf"{_WORD}|[0-9]+", re.I)
BRACKETED = re.compile(rf"\s?[\[({{<]\s?(?P<sign>@|\.|{_AT}|{_DOT})\s?[\])}}>]\s?", re.I)
SPACED_DOT = re.compile(rf"(?<=[A-Za-z0-9._%+-])(?:\s{{1,3}}{_DOT}\s{{1,3}}|_{_DOT}_)(?=[A-Za-z0-9-])", re.I)
#: Before what the base pattern takes as a domain; its last label is one of letters, since 'at' also stands before numbers.
SPACED_AT = re.compile(rf"(?<=[A-Za-z0-9._%+-])(?:\s{{1,3}}(?:@|{_AT})\s{{1,3}}|_{_AT}_)(?=(?P<domain>[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+))", re.I)
A_SPACED_AT = re.compile(rf"[\s_](?:@|{_AT})[\s_]", re.I)
AT_SIGNS = frozenset(("@", "at", "ät", "arroba", "arobase"))
DOT_WORDS = ("dot", "punkt", "punto", "point")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def detect(text: str) -> list[Span]:
    """Base spans: leftmost and non-overlapping per kind; matches that fail their check are dropped without another try. Linear in the text."""
    out: list[Span] = []
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append(("email", start, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    if not A_DIGIT.search(text):
        return out
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(len(x := p.lstrip("0")) <= 3 and int(x or 0) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(digits := NON_DIGIT.sub("", m[0])) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(NON_DIGIT.sub("", m[0])) <= 15]
    return out


class Traced:
    """A rewritten text; chars[i] stands for source characters starts[i] to ends[i]."""

    def __init__(self, text: str):
        self.text, self.starts, self.ends = text, range(len(text)), range(1, len(text) + 1)

    def rewrite(self, edits: list[tuple[int, int, str]]) -> Traced:
        """edits: ascending, non-overlapping (start, end, what to write instead)."""
        out, at = Traced(""), 0
        parts, starts, ends = [], [], []
        for a, b, new in [*edits, (len(self.text), len(self.text), "")]:
            parts += [self.text[at:a], new]
            starts += self.starts[at:a]
            ends += self.ends[at:a]
            if new:
                starts += [self.starts[a]] * len(new)
                ends += [self.ends[b - 1]] * len(new)
            at = b
        out.text, out.starts, out.ends = "".join(parts), starts, ends
        return out


def fold_glyph(c: str) -> str:
    if c in HOMOGLYPHS:
        return HOMOGLYPHS[c]
    if "！" <= c <= "～":
        return chr(ord(c) - 0xFEE0)
    if "\U0001d7ce" <= c <= "\U0001d7ff":
        return str((ord(c) - 0x1D7CE) % 10)
    return ""


def _ats(text: str) -> list[list[tuple[int, int, str]]]:
    """Edits that write @ for a spaced at: of all that stand before a domain, and, where the domain of one is the local part of the next, without the former."""
    found = [m for m in SPACED_AT.finditer(text) if len(label := m["domain"].rsplit(".", 1)[1]) >= 2 and label.isalpha()]
    edits = [(*m.span(), "@") for m in found]
    starts = {m.start() for m in found}
    last = [e for m, e in zip(found, edits, strict=True) if m.end("domain") not in starts]
    return [edits] if len(last) == len(edits) else [edits, last]


def disguised(text: str) -> list[Span]:
    """Spans that only the rewritten text shows. Each rule rewrites by itself: glyphs, then spelled digits, signs in brackets and spaced dots, then spaced ats; the base detectors decide."""
    traced = Traced(text)
    odd = not text.isascii() and [(m.start(), m.end(), fold_glyph(m[0])) for m in ODD.finditer(text)]
    if odd:
        traced = traced.rewrite(odd)
    plain, low, signs, found = traced, traced.text.lower(), [], []
    if any(w in low for w in DOT_WORDS):
        signs += [(*m.span(), ".") for m in SPACED_DOT.finditer(plain.text)]
    if any(b in low for b in "[({<"):
        signs += [(*m.span(), "@" if m["sign"].lower() in AT_SIGNS else ".") for m in BRACKETED.finditer(plain.text)]
    readings = [signs]
    if not DIGIT_WORDS.keys().isdisjoint(re.split(r"[^\w]+", low)):
        readings = []
        for pattern in (SPELLED, SPELLED_LONG):
            edits = []
            for m in pattern.finditer(plain.text):
                parts = [p[0].lower() for p in SPELLED_PART.finditer(plain.text, m.end("plus") if m["plus"] else m.start(), m.end())]
                if not m["plus"] and sum(p not in DIGIT_WORDS and len(p) > 1 for p in parts) > sum(p in DIGIT_WORDS for p in parts):  # a list of numbers is no disguise
                    continue
                digits = "".join(DIGIT_WORDS.get(p, p) for p in parts)
                edits.append((m.start(), m.end(), ("+" if m["plus"] else "") + digits))
                # a spelled run of a phone's length is one with or without its plus sign
                single = sum(p in DIGIT_WORDS or len(p) == 1 for p in parts)
                if not m["plus"] and single >= 6 and 9 <= len(digits) <= 15 and pattern is SPELLED_LONG and not (len(digits) >= 12 and luhn(digits)):
                    found.append(("phone", plain.starts[m.start()], plain.ends[m.end() - 1]))
            if edits or not readings:
                readings.append(signs + edits)
    for edits in readings:
        clear = []
        for e in sorted(edits):
            if not clear or e[0] >= clear[-1][1]:
                clear.append(e)
        written = plain.rewrite(clear) if clear else plain
        ats = _ats(written.text) if A_SPACED_AT.search(written.text) else [[]]
        for at in ats:
            if not (odd or clear or at):
                continue
            traced = written.rewrite(at) if at else written
            for kind, a, b in detect(traced.text):
                s, e = traced.starts[a], traced.ends[b - 1]
                if text[s:e] != traced.text[a:b]:
                    found.append((kind, s, e))
    return found


def find(text: str) -> tuple[list[Span], list[Span]]:
    """Base spans and all spans, each by start, then kind as listed."""
    base = detect(text)
    starts: dict[str, list[int]] = {k: [] for k in KINDS}  # spans of a kind do not overlap, so only the last that starts before can hold another
    ends: dict[str, list[int]] = {k: [] for k in KINDS}
    for k, a, b in sorted(base, key=lambda x: x[1]):
        starts[k].append(a)
        ends[k].append(b)
    inside = lambda x: (i := bisect_right(starts[x[0]], x[1])) > 0 and x[2] <= ends[x[0]][i - 1]
    order = lambda x: (x[1], KINDS.index(x[0]), x[2])
    more = {x for x in disguised(text) if not inside(x)}
    return sorted(base, key=order), sorted([*base, *more], key=order)


def listed(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def mask(text: str) -> str:
    """The text with each span replaced by its kind; overlapping spans count as the one that starts first."""
    out, at = [], 0
    for kind, a, b in find(text)[1]:
        if a >= at:
            out += [text[at:a], f"<{kind}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def personal_data(docs: DataFrame, masked: bool = False) -> DataFrame:
    """Adds n_email, n_ip, n_card, n_phone (base spans, long), base_sha256, spans, and masked if asked, to each row; the text is not returned.

    Spans are kind:start:end in code points, end exclusive. Null and empty
    texts have none. Repeated rows are all returned, an empty table gives
    none, and columns of these names are replaced.
    """
    counts = [f"n_{k}" for k in KINDS]
    rest = without(docs, *counts, "base_sha256", "spans", "masked", "text")
    packed = docs.select(F.struct(*[rest[c] for c in rest.columns]).alias("row"), F.col("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [x or "" for x in b.column(1).to_pylist()]
            both = [find(x) for x in texts]
            arrays = [pa.array([sum(k == kind for k, _, _ in base) for base, _ in both], pa.int64()) for kind in KINDS]
            arrays += [pa.array([hashlib.sha256(listed(base).encode()).hexdigest() for base, _ in both], pa.string()), pa.array([listed(spans) for _, spans in both], pa.string())]
            if masked:
                arrays.append(pa.array([mask(x) for x in texts], pa.string()))
            yield pa.RecordBatch.from_arrays([b.column(0), *arrays], ["row", *counts, "base_sha256", "spans", *["masked"] * masked])

    schema = f"row {packed.schema['row'].dataType.simpleString()}, " + ", ".join(f"{c} long" for c in counts) + ", base_sha256 string, spans string" + ", masked string" * masked
    return packed.mapInArrow(run, schema).select("row.*", *counts, "base_sha256", "spans", *["masked"] * masked)
