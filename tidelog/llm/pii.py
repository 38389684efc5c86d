"""Personal data: base detectors, and a deobfuscation that keeps offsets.

Bare words are read as signs only where they make an address: "at" between a name and a dotted domain
whose last label is of letters, "dot" between labels; not after the words of _NOBODY nor with a label of
_NO_LABEL, so "look at the dot at" stays prose. Spelled digits count only in runs that the detectors take.

Three transducers rewrite a text one after the other: homoglyphs to ASCII, spelled digits to
digits, at/dot disguises to their signs. Each keeps, for every character it puts out, the source
characters it stands for. The base detectors then run on the rewritten text, and what they find
there with a rewritten character in it is mapped back to the source and added to the base spans.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm import textkit as tk

KINDS = ("email", "ip", "card", "phone")

Span = tuple[int, int, int]  # start, kind, end

# fixed values: characters that look like ASCII ones
_ALIKE = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "ӏ": "l", "ԛ": "q", "ԝ": "w", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "У": "Y", "І": "I", "Ј": "J", "Ѕ": "S", "З": "3",
    "ο": "o", "α": "a", "ν": "v", "ρ": "p", "τ": "t", "ι": "i", "κ": "k", "υ": "u", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ո": "n", "օ": "o", "ս": "u", " ": " ", "­": "", "​": "", "‌": "", "‍": "", "⁠": "", "﻿": "", "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "−": "-", "。": ".", "․": ".", "‧": ".",
}
_DIGITS = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}


def _homoglyphs() -> dict[str, str]:
    """The table, the decimal digits of all scripts, and what compatibility forms of one character stand for."""
    out = dict(_ALIKE)
    for lo, hi in ((0x0600, 0x1A00), (0x2000, 0x2070), (0x2100, 0x2C00), (0xA600, 0xAC00), (0xFE10, 0xFFF0), (0x1D400, 0x1D800)):
        for c in map(chr, range(lo, hi)):
            if (d := unicodedata.decimal(c, None)) is not None:
                out.setdefault(c, str(d))
            elif len(n := unicodedata.normalize("NFKC", c)) == 1 and n.isascii() and n.isprintable():
                out.setdefault(c, n)
    return out


_GLYPHS = _homoglyphs()
_GLYPH = re.compile("[" + "".join(map(re.escape, _GLYPHS)) + "]")
_WORD = "|".join(_DIGITS)
#: A run of digits of which some are spelled, with one separator each; spelled plus may lead.
_SPELLED = re.compile(rf"(?<![A-Za-z0-9])(?:plus[ -])?(?:(?:{_WORD})(?![A-Za-z0-9])|[0-9](?![A-Za-z]))(?:[ ,-]?(?:(?<![A-Za-z0-9])(?:{_WORD})(?![A-Za-z0-9])|[0-9](?![A-Za-z])))+", re.I)
_SPELLED_PART = re.compile(rf"plus|{_WORD}|[0-9]", re.I)
#: Bracketed at and dot; white space on either side goes with them.
_BRACKETED = re.compile(r"[\[({<][ \t]*(at|dot|@|\.)[ \t]*[\])}>]", re.I)
#: An address with the bare words at or dot in it.
_BARE = re.compile(r"(?<![A-Za-z0-9._%+-])([A-Za-z0-9._%+-]+)(?:[ ]+at[ ]+|@)([A-Za-z0-9-]+(?:(?:[ ]+dot[ ]+|\.)[A-Za-z0-9-]+)+)", re.I)
_LABEL_CUT = re.compile(r"[ ]+dot[ ]+|\.", re.I)
_LAST_LABEL = re.compile(r"[a-z]{2,24}")
# fixed values: words that stand before "at" in prose and name nobody, and words that are no part of a domain
_NOBODY = frozenset("a about all am an and any are arrive arrived as available be been being but by call called came come did do done down each else fell find for found from get go going good got had half has have he held her here him his home i in is it its keep kept laugh lay left live lived look looked looking looks made me meet meets met much no not now of off on once one open or our out over point read really sat see seen she shop sit smile so some stand stare stay still stood stop them then there they this those up us used visit was we went were what when where which who will with work worked working works you".split())
_NO_LABEL = frozenset("a an and any at her his its least most my no noon of one or our that the their these this those to your".split())
_BARE_SIGN = re.compile(r"[ ]+(at|dot)[ ]+", re.I)
_DOTTED = re.compile(r"(?<![0-9])[0-9]{1,3}(?:[ ]+dot[ ]+[0-9]{1,3}){3}(?![0-9])", re.I)

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def _luhn(digits: str) -> bool:
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def detect(text: str) -> list[Span]:
    """Base spans. An address is found from its sign outwards, which is the leftmost match without a search from every letter."""
    found: list[Span] = []
    end, at = 0, text.find("@")
    while at >= 0:
        a = at
        while a > end and text[a - 1] in _LOCAL:
            a -= 1
        if a < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            found.append((a, 0, end))
        at = text.find("@", max(at + 1, end))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and _luhn(digits):
            found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum(map(str.isdigit, m[0])) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


class Rewritten:
    """A text, and for each of its characters the source characters it stands for and whether it was rewritten."""

    def __init__(self, text: str):
        self.text = text
        self.start, self.end, self.new = np.arange(len(text)), np.arange(1, len(text) + 1), np.zeros(len(text), bool)

    def apply(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace [a, b) by the given characters; each of them stands for all of [a, b)."""
        if not edits:
            return
        texts, starts, ends, news, at = [], [], [], [], 0
        for a, b, put in edits:
            texts += [self.text[at:a], put]
            starts += [self.start[at:a], np.full(len(put), self.start[a])]
            ends += [self.end[at:a], np.full(len(put), self.end[b - 1])]
            news += [self.new[at:a], np.ones(len(put), bool)]
            at = b
        self.text = "".join([*texts, self.text[at:]])
        self.start, self.end, self.new = (np.concatenate([*parts, old[at:]]) for parts, old in ((starts, self.start), (ends, self.end), (news, self.new)))


def _spelled_edits(text: str) -> Iterator[tuple[int, int, str]]:
    """Spelled digits in runs of two digits or more; whether a run is a number of any kind is for the detectors."""
    for m in _SPELLED.finditer(text):
        parts = list(_SPELLED_PART.finditer(text, m.start(), m.end()))
        for k, p in enumerate(parts):
            if len(p[0]) > 1:
                # the separator after a spelled digit goes with it
                stop = parts[k + 1].start() if k + 1 < len(parts) else p.end()
                yield p.start(), stop, "+" if p[0].lower() == "plus" else _DIGITS[p[0].lower()]


def _sign_edits(text: str) -> Iterator[tuple[int, int, str]]:
    end = 0
    for m in _BRACKETED.finditer(text):
        a, b = m.span()
        while a > end and text[a - 1] in " \t":
            a -= 1
        while b < len(text) and text[b] in " \t":
            b += 1
        end = b
        yield a, b, "@" if m[1].lower() in ("at", "@") else "."


def _bare_edits(text: str) -> Iterator[tuple[int, int, str]]:
    for m in _BARE.finditer(text):
        signs = list(_BARE_SIGN.finditer(text, m.start(), m.end()))
        if signs:
            *labels, last = _LABEL_CUT.split(m[2].lower())
            if m[1].lower() not in _NOBODY and not _NO_LABEL.intersection(labels) and _LAST_LABEL.fullmatch(last):
                for s in signs:
                    yield s.start(), s.end(), "@" if s[1].lower() == "at" else "."
    for m in _DOTTED.finditer(text):
        for s in _BARE_SIGN.finditer(text, m.start(), m.end()):
            yield s.start(), s.end(), "."


def rewrite(text: str) -> Rewritten:
    out = Rewritten(text)
    if not text.isascii():
        out.apply([(m.start(), m.end(), _GLYPHS[m[0]]) for m in _GLYPH.finditer(text)])
    for edits in (_spelled_edits, _sign_edits, _bare_edits):
        seen, chosen = 0, []
        for e in sorted(edits(out.text)):
            if e[0] >= seen:
                chosen.append(e)
                seen = e[1]
        out.apply(chosen)
    return out


def added(text: str, base: list[Span]) -> list[Span]:
    """Spans that only the rewritten text shows, in the source's offsets."""
    r = rewrite(text)
    if not r.new.any() and len(r.text) == len(text):
        return []
    found = {(int(r.start[a]), kind, int(r.end[b - 1])) for a, kind, b in detect(r.text) if r.new[a:b].any() or r.end[b - 1] - r.start[a] != b - a}
    # a span within a base one of its kind is no news; those of a kind don't overlap, so the last that starts before it decides
    ends: list[dict[int, int]] = [{} for _ in KINDS]
    for a, kind, b in base:
        ends[kind][a] = b
    starts = [sorted(e) for e in ends]
    out = []
    for a, kind, b in sorted(found):
        k = bisect_right(starts[kind], a)
        if not k or ends[kind][starts[kind][k - 1]] < b:
            out.append((a, kind, b))
    return out


def scan(text: str | None) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans) of a text in order; null is empty."""
    base = detect(text or "")
    return base, sorted(base + added(text or "", base))


_SPELLED_BYTES = [w.encode() for w in _DIGITS]
_DIGIT = np.zeros(256, bool)
_DIGIT[list(b"0123456789")] = True
_ODD = np.zeros(256, bool)  # first bytes of all characters that may be rewritten
_ODD[sorted({c.encode()[0] for c in _GLYPHS})] = True
#: The fewest digits in an identifier, those of an address of four parts.
_LEAST_DIGITS = 4


def _worth(batch: tk.Batch) -> list[bool]:
    """Which texts can have any span. An address has an at sign or what is rewritten to one: a bracket or the word between
    spaces; all else has _LEAST_DIGITS digits, of which some may be spelled; and any character of the table may become either."""
    data, off = batch.data, batch.offsets
    counts = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[off])
    digits = counts(_DIGIT[data]).tolist()
    plain = (counts(data == 0x40) > 0) | (counts(_ODD[data]) > 0)
    low = tk.LOWER[data].tobytes()
    out = plain.tolist()
    for i, yes in enumerate(out):
        if not yes:
            a, b = int(off[i]), int(off[i + 1])
            # a bare at needs a dotted domain or the word dot, a bracketed one a closing bracket
            out[i] = digits[i] + sum(low.count(w, a, b) for w in _SPELLED_BYTES) >= _LEAST_DIGITS or (low.find(b" at ", a, b) >= 0 and (low.find(b".", a, b) >= 0 or low.find(b" dot ", a, b) >= 0)) or any(low.find(x, a, b) >= 0 for x in (b"[", b"(", b"{", b"<"))
    return out


def with_spans(docs: DataFrame, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns named, ``base`` and ``spans``: lists of (kind, start, end) in code points, ordered by start, then kind.

    Null and empty texts have no spans; repeated rows each keep their row; a null doc_id stays null; an
    empty table gives no rows; other columns are ignored, whatever their names. A text is scanned whole,
    in time that grows with its length; its spans are those of ``scan``.
    """
    kept = docs.select(*columns, F.col("text").cast("string").alias("__text"))
    kind = "array<struct<kind:string,start:int,end:int>>"
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    schema = kept.drop("__text").withColumns({"base": F.lit(None).cast(kind), "spans": F.lit(None).cast(kind)}).schema

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            base, spans = [], []
            for _, _, x in tk.batches(b.column("__text")):
                body = x.data.tobytes()
                for i, worth in enumerate(_worth(x)):
                    found = scan(body[x.offsets[i] : x.offsets[i + 1]].decode()) if worth else ([], [])
                    for out, some in zip((base, spans), found, strict=True):
                        out.append([{"kind": KINDS[k], "start": s, "end": e} for s, k, e in some])
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), pa.array(base, arrow), pa.array(spans, arrow)], [*columns, "base", "spans"])

    return kept.mapInArrow(work, schema)


def digest(docs: DataFrame) -> DataFrame:
    """Counts and the digest of the base spans, all spans as text, and how many the deobfuscation added."""
    def joined(c: str) -> Column:
        return F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    found = with_spans(docs)
    return found.select("doc_id", *(count(k).alias(f"n_{k}") for k in KINDS), F.sha2(joined("base").cast("binary"), 256).alias("base_sha256"), joined("spans").alias("spans"), (F.size("spans") - F.size("base")).alias("n_added"))
