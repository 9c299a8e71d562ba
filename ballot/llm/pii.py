"""Offset-preserving deobfuscation and detection of personal data (operator 3).

Base detectors find emails, IP addresses, card and phone numbers in the text
as it is.  A cascade of transducers then rewrites disguises, each keeping for
every character it writes the source span that it stands for:

1. characters: homoglyphs, full-width and other compatibility forms become
   ASCII; zero-width characters vanish;
2. spelled digits (``five five 5 one``), with ``plus`` before and ``dot`` or
   ``point`` between them;
3. at and dot disguises (``name (at) host [dot] org``, ``name at host dot org``).

The detectors run again over the result.  A match that a rewrite touched is
mapped back to source characters and added under its kind; base spans stay.

Rewriting looks at texts that hold a trigger only.  All patterns are linear:
runs are possessive, emails are grown from their ``@``.  The operator is a map:
no shuffle, one Arrow batch at a time.

Defined results: a null text is empty and has no spans; a null id stays null;
repeated rows are scanned each; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame

KINDS = ("email", "ip", "card", "phone")

# Letters of other scripts that look like ASCII letters.
HOMOGLYPHS = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ѵ": "v", "ӏ": "l",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "І": "I", "Ј": "J", "Ѕ": "S",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ı": "i", "ɡ": "g", "ɑ": "a", "ʟ": "L", "․": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", "＿": "_", "٠": "0", "۰": "0", "०": "0",
}
# Characters without width.
ZERO_WIDTH = "­​‌‍⁠﻿"
# Names of the digits in the languages of the corpus.
DIGITS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
#: Digit names in a row from which they are read as a number.
MIN_DIGITS = 4

_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)++")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_HAS_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(t: str) -> list[tuple[int, int]]:
    """``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``, grown from each @."""
    out, end = [], 0
    for m in _DOMAIN.finditer(t):
        s = m.start()
        while s > end and t[s - 1] in _LOCAL_CHARS:
            s -= 1
        if s < m.start():
            out.append((s, m.end()))
            end = m.end()
    return out


def _ips(t: str) -> list[tuple[int, int]]:
    small = lambda p: len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255
    return [m.span() for m in _IP.finditer(t) if all(map(small, m.group().split(".")))]


def _cards(t: str) -> list[tuple[int, int]]:
    out = []
    for m in _CARD.finditer(t):
        if m.end() - m.start() >= 16:
            digits = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(m.span())
    return out


def _phones(t: str) -> list[tuple[int, int]]:
    return [m.span() for m in _PHONE.finditer(t) if 8 <= sum(c.isdigit() for c in m.group()) <= 15]


def detect(t: str) -> list[list[tuple[int, int]]]:
    """Spans of each kind."""
    digits = _HAS_DIGIT.search(t) is not None
    return [emails(t) if "@" in t else [], _ips(t) if digits else [], _cards(t) if digits else [], _phones(t) if digits and "+" in t else []]


class Mapped:
    """A rewritten text; ``at`` holds each character's source span."""

    def __init__(self, text: str, at: list[tuple[int, int]] | None = None):
        self.text, self.at = text, at

    def span(self, s: int, e: int) -> tuple[int, int]:
        return (s, e) if self.at is None else (self.at[s][0], self.at[e - 1][1])

    def rewrite(self, edits: list[tuple[int, int, str]]) -> Mapped:
        """Replace [start, end) by text for ascending edits that do not overlap."""
        if not edits:
            return self
        at = self.at if self.at is not None else [(i, i + 1) for i in range(len(self.text))]
        text, spans, last = [], [], 0
        for s, e, new in edits:
            text += [self.text[last:s], new]
            spans += at[last:s]
            spans += [(at[s][0], at[e - 1][1])] * len(new)
            last = e
        text.append(self.text[last:])
        spans += at[last:]
        return Mapped("".join(text), spans)


def _plain(c: str) -> str | None:
    """The ASCII character that a character stands for, "" if it has no width."""
    if c in ZERO_WIDTH:
        return ""
    if c in HOMOGLYPHS:
        return HOMOGLYPHS[c]
    new = unicodedata.normalize("NFKC", c)
    if len(new) == 1 and new.isascii() and new != c:
        return new
    digit = unicodedata.decimal(c, None)
    return str(digit) if digit is not None else None


_ODD = re.compile(r"[^\x00-\x7fÀ-İĲ-ſ]")


def characters(m: Mapped) -> Mapped:
    if m.text.isascii():
        return m
    edits = [(x.start(), x.end(), new) for x in _ODD.finditer(m.text) if (new := _plain(x.group())) is not None]
    if "­" in m.text and not edits:
        edits = []
    return m.rewrite(edits)


_NAMES = "|".join(sorted(DIGITS, key=len, reverse=True))
_DIGIT = rf"(?:{_NAMES}|[0-9])"
_SEP = r"[\s,_-]{1,3}"
_POINT = rf"(?:{_SEP}(?:dot|point|punkt|punto){_SEP}|\.)"
_FIRST = re.compile(rf"(?<!\w)(?:{_NAMES})(?:{_SEP}|\s*\.\s*)(?:dot|point|punkt|punto|{_NAMES}|[0-9])", re.I)
_SPELLED = re.compile(rf"(?<!\w)(?:plus{_SEP}|\+\s?)?{_DIGIT}(?:(?:{_POINT}|{_SEP}){_DIGIT}(?!\w)|(?<=[0-9])[0-9])+(?!\w)", re.I)
_TOKEN = re.compile(rf"plus|dot|point|punkt|punto|{_NAMES}|[0-9]|\+|\.", re.I)


def spelled_digits(m: Mapped) -> Mapped:
    if not _FIRST.search(m.text):
        return m
    edits = []
    for run in _SPELLED.finditer(m.text):
        tokens = list(_TOKEN.finditer(m.text, run.start(), run.end()))
        values = [DIGITS.get(x.group().lower(), x.group()) for x in tokens]
        names = sum(x.group().lower() in DIGITS for x in tokens)
        if names < MIN_DIGITS:
            continue
        for x, value in zip(tokens, values):
            low = value.lower()
            new = "+" if low == "plus" else "." if low in ("dot", "point", "punkt", "punto") else value
            edits.append((x.start(), x.end(), new))
        # what stands between two tokens vanishes
        edits += [(a.end(), b.start(), "") for a, b in zip(tokens, tokens[1:]) if a.end() < b.start()]
    return m.rewrite(sorted(edits))


_OPEN, _SHUT = r"\s*[\[({<]\s*", r"\s*[\])}>]\s*"
_AT_MARKED = rf"(?:{_OPEN}(?:at|@){_SHUT}|\s*[_*-]at[_*-]\s*)"
_DOT_MARKED = rf"(?:{_OPEN}(?:dot|punkt|punto|point|\.){_SHUT}|\s*[_*-]dot[_*-]\s*)"
_DOT_BARE = r"\s+(?:dot|punkt|punto|point)\s+"
_NAME = r"[A-Za-z0-9._%+]+(?:-[A-Za-z0-9._%+]+)*"
_HOST = r"[A-Za-z0-9]+(?:-[A-Za-z0-9]+)*"
_ADDRESS = re.compile(
    rf"(?<![A-Za-z0-9._%+-]){_NAME}"
    rf"(?:(?P<a>{_AT_MARKED}|\s*@\s*){_HOST}(?:(?:\.|{_DOT_MARKED}|{_DOT_BARE}){_HOST})+"
    rf"|(?P<b>\s+at\s+)(?!(?:the|an?|this|that|my|our|your)\b){_HOST}(?:(?:{_DOT_MARKED}|{_DOT_BARE}){_HOST})*(?:{_DOT_MARKED}|{_DOT_BARE})[A-Za-z]{{2,}})(?!\w)",
    re.I,
)
_DISGUISE = re.compile(rf"{_AT_MARKED}|{_DOT_MARKED}|{_DOT_BARE}|\s+at\s+|\s*@\s*", re.I)
_NUMBERS = re.compile(rf"(?<![0-9A-Za-z.])[0-9]{{1,3}}(?:(?:\.|{_DOT_MARKED}|{_DOT_BARE})[0-9]{{1,3}}){{3}}(?![0-9A-Za-z])", re.I)
_MARK = re.compile(r"[\[({<_*-]\s*(?:at|@|dot|punkt|punto|point|\.)\s*[\])}>_*-]|\s(?:dot|punkt|punto|point)\s|\s@|@\s", re.I)


def at_and_dot(m: Mapped) -> Mapped:
    if not _MARK.search(m.text):
        return m
    edits = []
    for pattern in (_ADDRESS, _NUMBERS):
        for run in pattern.finditer(m.text):
            for x in _DISGUISE.finditer(m.text, run.start(), run.end()):
                at = "@" if "@" in x.group() or "at" in x.group().lower() else "."
                if x.group() != at:
                    edits.append((x.start(), x.end(), at))
    kept: list[tuple[int, int, str]] = []
    for edit in sorted(set(edits)):
        if not kept or edit[0] >= kept[-1][1]:
            kept.append(edit)
    return m.rewrite(kept)


def scan(text: str | None) -> tuple[list[list[tuple[int, int]]], list[list[tuple[int, int]]]]:
    """Per kind the base spans, and those that only the rewritten text shows."""
    t = text or ""
    base = detect(t)
    m = at_and_dot(spelled_digits(characters(Mapped(t))))
    if m.at is None:
        return base, [[] for _ in KINDS]
    more = []
    for found, own in zip(detect(m.text), base):
        # an edit that left no trace in a match does not make it a new one
        spans = {m.span(s, e) for s, e in found if t[slice(*m.span(s, e))] != m.text[s:e]}
        more.append(sorted(spans - set(own)))
    return base, more


def joined(spans: list[list[tuple[int, int]]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, own in zip(KINDS, spans) for s, e in sorted(own))


def find_pii(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_email, n_ip, n_card, n_phone (base), n_added,
    base_sha256, spans."""

    def run(batches):
        for batch in batches:
            counts, added, digest, spans = [], [], [], []
            for t in batch.column(1):
                base, more = scan(t.as_py())
                counts.append([len(x) for x in base])
                added.append(sum(map(len, more)))
                digest.append(hashlib.sha256(joined(base).encode()).hexdigest())
                spans.append(joined([a + b for a, b in zip(base, more)]))
            columns = [pa.array([c[k] for c in counts], pa.int64()) for k in range(len(KINDS))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, pa.array(added, pa.int64()), pa.array(digest, pa.string()), pa.array(spans, pa.string())], names=["doc_id", *[f"n_{k}" for k in KINDS], "n_added", "base_sha256", "spans"])

    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, n_added long, base_sha256 string, spans string"
    return docs.select(doc_id, text).mapInArrow(run, schema)
