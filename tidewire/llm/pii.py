"""Personal data with offset-preserving deobfuscation.

The base patterns are matched on the text as it is. Then transducers rewrite disguises (look-alike characters, spelled
digits, letters used as digits, at and dot in words or brackets) into plain characters, and keep for every character
written the span of the source that it came from. The same patterns are matched on the rewritten text; matches that
contain a rewritten part are mapped back to source offsets and added to the base spans, which always stay. So are cards
and phone numbers inside a base match that failed because it ran on into the next number.
"""

from __future__ import annotations

import hashlib
import re
import string
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_parts

KINDS = ("email", "ip", "card", "phone")
# The base patterns. That of addresses is found from its at sign, behind which it is _DOMAIN; the look back in
# that of ips keeps a long run of digits from being read again from each of its digits, where no match can begin.
PATTERNS = {
    "ip": re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
_USER = string.ascii_letters + string.digits + "._%+-"
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# Cyrillic and Greek letters and the Latin ones that they look like, dots, at signs and hyphens.
LOOK_ALIKE = dict(
    zip(
        "аеорсухіјѕԁһԛԝАВЕКМНОРСТУХІЈЅαοικνρτυχΑΒΕΖΗΙΚΜΝΟΡΤΥΧ․。｡∙＠﹫‐‑‒–−",
        "aeopcyxijsdhqwABEKMHOPCTYXIJSaoiknptuxABEZHIKMNOPTYX....@@-----",
        strict=True,
    )
)
# Digits in words.
SPELLED = {
    **dict.fromkeys(("zero", "oh", "null", "zéro", "cero"), "0"),
    **dict.fromkeys(("one", "eins", "un", "uno"), "1"),
    **dict.fromkeys(("two", "zwei", "deux", "dos"), "2"),
    **dict.fromkeys(("three", "drei", "trois", "tres"), "3"),
    **dict.fromkeys(("four", "vier", "quatre", "cuatro"), "4"),
    **dict.fromkeys(("five", "fünf", "cinq", "cinco"), "5"),
    **dict.fromkeys(("six", "sechs", "seis"), "6"),
    **dict.fromkeys(("seven", "sieben", "sept", "siete"), "7"),
    **dict.fromkeys(("eight", "acht", "huit", "ocho"), "8"),
    **dict.fromkeys(("nine", "neun", "neuf", "nueve"), "9"),
    **dict.fromkeys(("dot", "point", "punkt", "punto"), "."),
    "plus": "+",
}

_UNSEEN = "­​‌‍⁠﻿"
_GLYPH = re.compile("[" + "".join(map(re.escape, LOOK_ALIKE)) + _UNSEEN + "！-～\U0001d400-\U0001d7ff①-⑳²³¹⁰-₉]")
_WORD = "|".join(sorted(SPELLED, key=len, reverse=True))
_SPELLED_RUN = re.compile(rf"(?<![^\W_])(?:{_WORD})(?:[\s,-]{{1,3}}(?:{_WORD})){{6,}}(?![^\W_])", re.I)
_AT = r"\s{0,2}[\[({<]\s?(?:at|arroba|@)\s?[\])}>]\s{0,2}"
_DOT = r"\s{0,2}[\[({<]\s?(?:dot|punkt|punto|point|\.)\s?[\])}>]\s{0,2}"
# What re.I takes for letters of these words and lower() leaves.
_CASELESS = str.maketrans("ſıİ", "sii")
_BRACKETED = re.compile(rf"(?P<at>{_AT})|(?P<dot>{_DOT})", re.I)
_SAID = re.compile(r"(?<![^\s])(?P<user>[A-Za-z0-9._%+-]{1,64})\s+at\s+(?P<host>[A-Za-z0-9-]{1,63}(?:(?:\s+dot\s+|\.)[A-Za-z0-9-]{1,63}){0,4}\s+dot\s+(?:com|org|net|edu|gov|mil|info|biz|io|co|ai|app|dev|de|at|ch|fr|be|es|mx|it|nl|eu|uk|us|ca|ru|cn|jp|br))(?![^\W_])", re.I)
# User, labels and labels of a host are as long as the format of addresses allows; digits with letters for some are looked
# for up to the length of a card number and a little more, as no identifier has more.
_LETTER_DIGITS = re.compile(r"(?<![A-Za-z0-9])\+?[0-9OolI](?:[ .()-]{0,2}[0-9OolI]){8,22}(?![A-Za-z0-9])")
#: Short addresses, which have fewer digits than a run.
_LETTER_IP = re.compile(r"(?<![A-Za-z0-9])[0-9OolI]+(?:\.[0-9OolI]+){3}(?![A-Za-z0-9])")
_AS_DIGIT = {"O": "0", "o": "0", "l": "1", "I": "1"}


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _valid(kind: str, found: str) -> bool:
    if kind == "email":
        return True
    if kind == "ip":
        return all(len(p) <= 3 and int(p or "0") <= 255 for p in (x.lstrip("0") for x in found.split(".")))
    digits = "".join(c for c in found if "0" <= c <= "9")
    return 13 <= len(digits) <= 19 and _luhn(digits) if kind == "card" else 9 <= len(digits) <= 15


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """What [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+ matches, leftmost and without overlaps. No match has another at
    sign before its own, so each is looked at once, with the run of letters before it."""
    free = 0
    while (at := text.find("@", free)) >= 0:
        begin = at - len(text[free:at]) + len(text[free:at].rstrip(_USER))
        domain = _DOMAIN.match(text, at) if begin < at else None
        if domain:
            yield begin, domain.end()
        free = domain.end() if domain else at + 1


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind, then start; leftmost matches that don't overlap, failing ones dropped."""
    out = [("email", *x) for x in _emails(text)]
    for kind, pattern in PATTERNS.items():
        if kind != "phone" or "+" in text:
            out += [(kind, m.start(), m.end()) for m in pattern.finditer(text) if _valid(kind, m[0])]
    return out


#: Identifiers inside a match that failed because it ran on into the next number, and how many characters one has at least.
_WITHIN = {
    "card": (13, re.compile(r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}(?:[ -]?[0-9]{1,3})?)(?![0-9])")),
    "phone": (10, re.compile(r"\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-][0-9]{2,4}){1,3}(?![0-9])")),
}


def _run_together(text: str) -> list[tuple[str, int, int]]:
    """Cards and phone numbers within base matches that failed."""
    out = []
    for kind, (least, inner) in _WITHIN.items():
        if kind == "phone" and "+" not in text:
            continue
        for m in PATTERNS[kind].finditer(text):
            if m.end() - m.start() > least and not _valid(kind, m[0]):
                out += [(kind, i.start(), i.end()) for i in inner.finditer(text, m.start(), m.end()) if _valid(kind, i[0])]
    return out


class Tape:
    """A rewritten text: characters with the source span of each and whether a transducer wrote it."""

    def __init__(self, text: str):
        self.text, self.start, self.end, self.changed = text, list(range(len(text))), list(range(1, len(text) + 1)), [False] * len(text)

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace the spans (from, to, by), which are in order and don't overlap."""
        text, start, end, changed, at = [], [], [], [], 0
        for a, b, by in edits:
            text += [self.text[at:a], by]
            start += self.start[at:a] + [self.start[a]] * len(by)
            end += self.end[at:a] + [self.end[b - 1]] * len(by)
            changed += self.changed[at:a] + [True] * len(by)
            at = b
        self.text = "".join([*text, self.text[at:]])
        self.start, self.end, self.changed = start + self.start[at:], end + self.end[at:], changed + self.changed[at:]


def _glyph(c: str) -> str:
    return "" if c in _UNSEEN else LOOK_ALIKE.get(c) or unicodedata.normalize("NFKC", c)


def _digits(run: str) -> str | None:
    """A run of digits and letters like digits, as digits, if digits are two thirds of it."""
    real = sum(c.isdigit() for c in run)
    like = sum(c in _AS_DIGIT for c in run)
    return "".join(_AS_DIGIT.get(c, c) for c in run) if like and real >= 2 * like else None


def _letter_digits(text: str, pattern: re.Pattern) -> Iterator[tuple[int, int, str]]:
    return ((m.start(), m.end(), d) for m in pattern.finditer(text) if (d := _digits(m[0])))


def _transduced(text: str) -> Tape | None:
    """The text without its disguises, or None if it has none."""
    tape = Tape(text)
    steps = (
        lambda t: [(m.start(), m.end(), _glyph(m[0])) for m in _GLYPH.finditer(t)],
        lambda t: [(m.start(), m.end(), "@" if m["at"] else ".") for m in _BRACKETED.finditer(t)] if _BRACKETED.search(t) else [],
        lambda t: [x for m in _SAID.finditer(t) for x in ((m.end("user"), m.start("host"), "@"), *((m.start("host") + d.start(), m.start("host") + d.end(), ".") for d in re.finditer(r"\s+dot\s+", m["host"], re.I)))] if "dot" in t.lower().split() else [],
        lambda t: [(m.start(), m.end(), "".join(SPELLED[w.translate(_CASELESS).lower()] for w in re.findall(_WORD, m[0], re.I))) for m in _SPELLED_RUN.finditer(t)],
        lambda t: list(_letter_digits(t, _LETTER_DIGITS)),
        lambda t: list(_letter_digits(t, _LETTER_IP)),
    )
    for step in steps:
        if edits := step(tape.text):
            tape.rewrite(edits)
    return tape if any(tape.changed) or tape.text != text else None


_LATIN_GLYPH = re.compile("[\xad²³¹]")
_APART = str.maketrans(",-", "  ")


def _hinted(text: str) -> bool:
    """Whether a transducer could find something: true at least wherever the first of them to change text would do so."""
    if not text.isascii() and (_GLYPH if max(text) > "\xff" else _LATIN_GLYPH).search(text):
        return True
    if any(c in text for c in "[({<") and _BRACKETED.search(text):
        return True
    if any(_letter_digits(text, _LETTER_DIGITS)) or any(_letter_digits(text, _LETTER_IP)):
        return True
    plain = text if text.isascii() else text.translate(_CASELESS)
    words = plain.lower().translate(_APART).split()
    return "dot" in words or not SPELLED.keys().isdisjoint(words)


def all_spans(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, spans added), each by kind, then start."""
    base, added = base_spans(text), _run_together(text)
    if _hinted(text) and (tape := _transduced(text)):
        for kind, a, b in base_spans(tape.text):
            start, end = tape.start[a], tape.end[b - 1]
            rewritten = any(tape.changed[a:b]) or end - start != b - a
            if rewritten and not any(k == kind and s < end and start < e for k, s, e in base + added):
                added.append((kind, start, end))
    return base, added


def spelled_out(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))


FOUND = "doc_id long, spans array<struct<kind:string,start:int,end:int,base:boolean,found:string>>"


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("found", pa.string())]))
    for batch in small_parts(batches, 1):
        rows = []
        for text in batch.column(1).to_pylist():
            text = text or ""
            base, added = all_spans(text)
            both = sorted([(*s, True) for s in base] + [(*s, False) for s in added], key=lambda s: (KINDS.index(s[0]), s[1], s[2]))
            rows.append([{"kind": k, "start": a, "end": b, "base": own, "found": text[a:b]} for k, a, b, own in both])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], ["doc_id", "spans"])


def find_personal(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, spans (kind, start, end exclusive, base, found), in code points of the source, by kind and start.

    A null text counts as empty and has no spans. Very long texts are read whole, in time that grows with their length. Rows
    without an id are left out; repeated rows give the same spans each. An empty table gives an empty result. Other columns
    are not read.
    """
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null").mapInArrow(_find, FOUND)


def digest(found: DataFrame) -> DataFrame:
    """doc_id, counts of base spans per kind, base_sha256, spans as one string, n_added."""
    spell = lambda s: F.array_join(F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    base = F.filter("spans", lambda x: x["base"])
    of_kind = lambda k: F.size(F.filter(base, lambda x: x["kind"] == k))
    return found.select(
        "doc_id",
        *(of_kind(k).cast("long").alias(f"n_{k}") for k in KINDS),
        F.sha2(spell(base), 256).alias("base_sha256"),
        spell(F.col("spans")).alias("spans"),
        (F.size("spans") - F.size(base)).cast("long").alias("n_added"),
    )


def digest_of(text: str | None) -> tuple:
    """What digest gives for one text; for tests."""
    base, added = all_spans(text or "")
    return (*(sum(k == s[0] for s in base) for k in KINDS), hashlib.sha256(spelled_out(base).encode()).hexdigest(), spelled_out(base + added), len(added))
