"""Personal data, plain and disguised, with spans in the source text."""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from newsweave.llm.common import per_batch

KINDS = ("email", "ip", "card", "phone")
# The patterns of the contract. A number is taken from its first digit.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Letters that look like Latin ones.
_LOOKS = dict(zip("аеорсухіјѕԁһԛԝАВЕКМНОРСТХІЈЅαοενρτικΑΒΕΖΗΙΚΜΝΟΡΤΥΧ",
                  "aeopcyxijsdhqwABEKMHOPCTXIJSaoevptikABEZHIKMNOPTYX"))
# Characters without width.
_NO_WIDTH = "­​‌‍⁠﻿"
# Digits as words, in English, German, French and Spanish.
_DIGIT_WORDS = (
    "zero oh null zéro cero", "one eins un uno", "two zwei deux dos", "three drei trois tres", "four vier quatre cuatro",
    "five fünf cinq cinco", "six sechs seis", "seven sieben sept siete", "eight acht huit ocho", "nine neun neuf nueve")
_DIGIT_OF = {word: str(n) for n, words in enumerate(_DIGIT_WORDS) for word in words.split()}
_POINTS = "dot|punkt|point|punto"
_NUMBER = "|".join(sorted(_DIGIT_OF, key=len, reverse=True))
# Four digit words in a row at least; a plus before them, points between.
_SPELLED = re.compile(
    rf"\b(?:plus[ -]+)?(?:{_NUMBER})(?:[ ,-]+(?:{_POINTS})[ ,-]+(?:{_NUMBER})|[ ,-]+(?:{_NUMBER}))" r"{3,}\b", re.IGNORECASE)
_SPELLED_PART = re.compile(rf"(?P<plus>plus[ -]+)|(?P<point>[ ,-]+(?:{_POINTS})[ ,-]+)|(?P<digit>{_NUMBER})|[ ,-]+", re.IGNORECASE)
# Signs have at most four blanks on each side, names and labels 64 characters, and there
# are at most 16 of them, so a look from a sign takes bounded time.
_GAP, _REQUIRED_GAP = r"\s{0,4}", r"\s{1,4}"
_IN, _OUT = rf"[\[({{<]{_GAP}", rf"{_GAP}[\])}}>]"
_BRACED_AT, _BRACED_DOT = rf"{_IN}(?:at|arroba|@){_OUT}", rf"{_IN}(?:{_POINTS}|\.){_OUT}"
_SPOKEN_DOT = rf"{_REQUIRED_GAP}(?:{_POINTS}){_REQUIRED_GAP}"
_LABEL = r"[A-Za-z0-9-]{1,63}"
_AT = re.compile(rf"(?P<braced>{_BRACED_AT})|(?P<spoken>\s(?:at|arroba)\s)|(?P<plain>@)", re.IGNORECASE)
_ANY_DOT, _HIDDEN_DOT = rf"(?:\.|{_GAP}{_BRACED_DOT}{_GAP}|{_SPOKEN_DOT})", rf"(?:{_GAP}{_BRACED_DOT}{_GAP}|{_SPOKEN_DOT})"
# What may follow each kind of sign: behind one in brackets any points, else disguised
# ones only, or plain ones with one in brackets among them.
_BRACED_DOMAIN = re.compile(rf"{_GAP}{_LABEL}(?:{_ANY_DOT}{_LABEL}){{1,16}}(?![A-Za-z0-9-])", re.IGNORECASE)
_HIDDEN_DOMAIN = re.compile(rf"{_GAP}{_LABEL}(?:{_HIDDEN_DOT}{_LABEL}){{1,16}}(?![A-Za-z0-9-])", re.IGNORECASE)
_MIXED_DOMAIN = re.compile(
    rf"{_GAP}{_LABEL}(?:\.{_LABEL}){{0,8}}{_GAP}{_BRACED_DOT}{_GAP}{_LABEL}(?:(?:\.|{_GAP}{_BRACED_DOT}{_GAP}){_LABEL}){{0,8}}(?![A-Za-z0-9-])",
    re.IGNORECASE)
_DOT_BEFORE = re.compile(rf"(?:\.|{_GAP}{_BRACED_DOT}{_GAP})\Z", re.IGNORECASE)
_NAME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_%+-")
_SIGN = re.compile(rf"(?P<dot>{_GAP}{_BRACED_DOT}{_GAP}|{_SPOKEN_DOT})", re.IGNORECASE)
# Four groups of digits with points of any kind between them, one disguised at least.
_HIDDEN_IP = re.compile(rf"(?<![0-9.])[0-9]{{1,3}}(?:{_ANY_DOT}[0-9]{{1,3}}){{3}}(?![0-9])", re.IGNORECASE)
# One cheap look decides whether a text holds anything to undo.
_BRACED_ANY = re.compile(rf"{_IN}(?:at|arroba|@|{_POINTS}|\.){_OUT}", re.IGNORECASE)
_SPOKEN_ANY = re.compile(rf"\s(?:{_POINTS})\s", re.IGNORECASE)
_SPELLED_ANY = re.compile(rf"\b(?:{_NUMBER})[ ,-]+(?:{_NUMBER}|{_POINTS})\b", re.IGNORECASE)
_COMPATIBLE = "！-～﹐-﹫⁰-ₜ①-⓿❶-➓\U0001d400-\U0001d7ff。"
_STRANGE = re.compile(f"[{_COMPATIBLE}{_NO_WIDTH}{''.join(_LOOKS)}٠-٩۰-۹०-९]")


def _digits(text: str) -> list[int]:
    return [ord(c) - 48 for c in text if "0" <= c <= "9"]


def luhn(digits: list[int]) -> bool:
    doubled = [d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(reversed(digits))]
    return sum(doubled) % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """From each @, the local part reaches back as far as its class does, but not
    into the match before; then the domain must follow."""
    found, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            end = domain.end()
            found.append((start, end))
        else:
            # No later match may reach back over this @.
            end = max(end, at + 1)
        at = text.find("@", max(at + 1, end))
    return found


def spans_of(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of everything the plain patterns find, in order."""
    found = [(s, 0, e) for s, e in _emails(text)]
    found += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(int(p) <= 255 for p in m[0].split(".") if len(p) < 400)
              and all(len(p) < 400 or not p.strip("0") for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = _digits(m[0]) if m.end() - m.start() < 40 else []
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    if "+" in text:
        found += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return sorted(found)


class Tape:
    """A rewritten text, with the source span of each of its characters."""

    def __init__(self, text: str):
        self.text = text
        self.start = list(range(len(text)))
        self.end = list(range(1, len(text) + 1))

    def rewrite(self, matches, change) -> None:
        """Replace every one of the ``matches`` in order by the (text, start, end) parts
        ``change`` gives for it; a part's characters all stand for its whole span."""
        texts, starts, ends, at = [], [], [], 0
        for match in matches:
            parts = change(match)
            if parts is None:
                continue
            begin, end = match.span() if isinstance(match, re.Match) else (parts[0][1], parts[-1][2])
            texts.append(self.text[at:begin])
            starts += self.start[at:begin]
            ends += self.end[at:begin]
            for new, s, e in parts:
                texts.append(new)
                starts += [self.start[s]] * len(new)
                ends += [self.end[e - 1]] * len(new)
            at = end
        if at:
            self.text = "".join(texts) + self.text[at:]
            self.start, self.end = starts + self.start[at:], ends + self.end[at:]


def _plain_letter(match: re.Match) -> list:
    c = match[0]
    if c in _NO_WIDTH:
        return []
    if c in _LOOKS:
        new = _LOOKS[c]
    elif c.isdecimal():
        new = str(unicodedata.decimal(c))
    else:
        new = "." if c == "。" else unicodedata.normalize("NFKC", c)
    return [(new, match.start(), match.end())]


def _spoken_digits(match: re.Match) -> list:
    parts = []
    for m in _SPELLED_PART.finditer(match[0]):
        new = "+" if m["plus"] else "." if m["point"] else _DIGIT_OF[m["digit"].lower()] if m["digit"] else ""
        if new:
            parts.append((new, match.start() + m.start(), match.start() + m.end()))
    return parts


def _undotted(text: str, start: int, end: int) -> list:
    """The part of ``text`` with plain points for disguised ones."""
    parts, at = [], start
    for m in _SIGN.finditer(text, start, end):
        parts += [(text[i], i, i + 1) for i in range(at, m.start())]
        parts.append((".", m.start(), m.end()))
        at = m.end()
    return parts + [(text[i], i, i + 1) for i in range(at, end)]


def _name_before(text: str, end: int, least: int) -> int:
    """Where the local part that ends at ``end`` starts, not before ``least``; ``end`` if there is none."""
    start = end
    for _ in range(16):
        at = start
        while at > least and start - at < 64 and text[at - 1] in _NAME:
            at -= 1
        if at == start:
            return end
        dot = _DOT_BEFORE.search(text, max(at - 24, least), at)
        if not dot or dot.start() == least or text[dot.start() - 1] not in _NAME:
            return at if at == least or text[at - 1] not in _LOCAL else end
        start = dot.start()
    return end


def _addresses(text: str) -> list[list]:
    """The parts of every disguised address. From each at sign the domain is looked for
    to the right and then the local part to the left, behind the address before."""
    found, least = [], 0
    at, sign = 0, _AT.search(text)
    while sign:
        at = sign.end() if not sign["spoken"] else sign.end() - 1
        start, end = sign.span()
        if start >= least:
            patterns = [_BRACED_DOMAIN] if sign["braced"] else [_HIDDEN_DOMAIN] if sign["spoken"] else [_HIDDEN_DOMAIN, _MIXED_DOMAIN]
            domain = next((m for m in (p.match(text, end) for p in patterns) if m), None)
            if domain:
                gap = start
                while gap > max(least, start - 4) and text[gap - 1].isspace():
                    gap -= 1
                name = _name_before(text, gap, least)
                if name < gap:
                    body = domain.start() + len(domain[0]) - len(domain[0].lstrip())
                    found.append([*_undotted(text, name, gap), ("@", gap, body), *_undotted(text, body, domain.end())])
                    at = least = domain.end()
        sign = _AT.search(text, at)
    return found


def _hidden_ip(match: re.Match) -> list | None:
    parts = _undotted(match.string, *match.span())
    return parts if len(parts) < match.end() - match.start() else None


def disguised(text: str) -> bool:
    return bool((not text.isascii() and _STRANGE.search(text)) or (any(c in text for c in "[({<") and _BRACED_ANY.search(text))
                or _SPOKEN_ANY.search(text) or _SPELLED_ANY.search(text))


def revealed(text: str) -> list[tuple[int, int, int]]:
    """Spans that show once disguises are undone and that no plain span of the
    same kind covers, in source characters. Transducers follow one another: look-alike
    and invisible characters, digits as words, points between digits, at and dot signs."""
    if not disguised(text):
        return []
    tape = Tape(text)
    tape.rewrite(_STRANGE.finditer(tape.text), _plain_letter)
    tape.rewrite(_SPELLED.finditer(tape.text), _spoken_digits)
    tape.rewrite(_HIDDEN_IP.finditer(tape.text), _hidden_ip)
    tape.rewrite(_addresses(tape.text), list)
    if tape.text == text:
        return []
    plain = spans_of(text)
    mapped = {(tape.start[s], k, tape.end[e - 1]) for s, k, e in spans_of(tape.text)}
    return sorted(x for x in mapped if not any(k == x[1] and s <= x[0] and x[2] <= e for s, k, e in plain))


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, base, added) per row of ``docs`` (doc_id, text), from whole texts:
    spans (start, kind, end) in code points, kind counting in KINDS. Null and empty
    texts have none; repeated rows and null ids stay as they are."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        base, added = [], []
        for text in batch.column(1):
            held = text.as_py() or ""
            base.append(spans_of(held))
            added.append(revealed(held))
        rows = [pa.array([[dict(zip(("start", "kind", "end"), s)) for s in x] for x in part], kind) for part in (base, added)]
        return pa.RecordBatch.from_arrays([batch.column(0), *rows], ["doc_id", "base", "added"])

    span = "array<struct<start:int,kind:int,end:int>>"
    return per_batch(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run,
                     f"doc_id long, base {span}, added {span}")


def written(spans: Column) -> Column:
    """kind:start:end of every span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(kind: str) -> Column:
    return F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(kind))).cast("long")


def report(found: DataFrame) -> DataFrame:
    """The digest of ``scan``: counts, the hash of the plain spans, and all spans."""
    counts = [count_of(k).alias(f"n_{k}") for k in KINDS]
    return found.select(
        "doc_id", *counts, F.sha2(written(F.col("base")), 256).alias("base_sha256"),
        written(F.array_sort(F.concat("base", "added"))).alias("spans"), F.size("added").cast("long").alias("n_disguised"))
