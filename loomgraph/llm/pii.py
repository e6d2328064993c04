"""Personal data, also where it is disguised, by offset-preserving transducers.

The base kinds (email, ip, card, phone) are found in the text itself. Then
transducers rewrite the text: homoglyphs, full-width and invisible characters
to ASCII; digits that are spelled out, in four languages, to digits; at and dot
in their disguises to ``@`` and ``.``. Each transducer keeps, for every
character that it writes, the span of source characters that it stands for. The
base kinds are found again in what was rewritten, and their spans mapped back;
those that meet no base span of their kind are added.

All scans are linear in the text: runs are matched as a whole, not from each of
their characters; spans are kept sorted, and tapes by segments.

Defined cases: a null text is empty and has no spans. Spans are in code points,
the end exclusive; spans that begin together are in the order of :data:`KINDS`.
Very long texts take time in proportion to their length and their spans. Repeated
rows give repeated rows; extra columns are ignored, and kept by :func:`mask`. An
empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

# -- base kinds ---------------------------------------------------------------

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_CHAIN = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def emails(text: str) -> Iterator[tuple[int, int]]:
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at) if start < at else None
        if found:
            free = found.end()
            yield start, free
        at = text.find("@", max(at + 1, free))


def addresses(text: str) -> Iterator[tuple[int, int]]:
    """Four numbers at a time of each chain of dotted numbers."""
    for chain in _CHAIN.finditer(text):
        if chain[0].count(".") < 3:
            continue
        parts, at = chain[0].split("."), chain.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            size = sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                yield at, at + size
            at += size + 1


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text) if "+" in text else ():
        if 10 <= len(_DIGIT.findall(m[0])) <= 15:
            yield m.span()


def base_spans(text: str) -> list[Span]:
    found = [("email", *s) for s in emails(text)]
    if _DIGIT.search(text):
        found += [(kind, *s) for kind, of in (("ip", addresses), ("card", cards), ("phone", phones)) for s in of(text)]
    return ordered(found)


def ordered(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


# -- transducers --------------------------------------------------------------

#: Look-alikes of ASCII letters (fixed values): Cyrillic, then Greek.
HOMOGLYPHS = dict(zip("аесорхуіјѕԁһкмтвнАВЕКМНОРСТХУІЈЅ", "aecopxyijsdhkmtbhABEKMHOPCTXYIJS")) | dict(zip("οαινρυκτχΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "oaivpuktxABEZHIKMNOPTYX"))
#: Characters without width (fixed values).
INVISIBLE = frozenset("­​‌‍⁠﻿")
#: Other forms of the signs that identifiers need (fixed values).
SIGNS = {"‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", "。": ".", "․": ".", "｡": ".", " ": " ", " ": " ", " ": " "}
#: Spelled digits in English, French, German and Spanish (fixed values).
DIGITS = {
    "0": "zero oh zéro null cero",
    "1": "one un une eins uno",
    "2": "two deux zwei zwo dos",
    "3": "three trois drei tres",
    "4": "four quatre vier cuatro",
    "5": "five cinq fünf cinco",
    "6": "six sechs seis",
    "7": "seven sept sieben siete",
    "8": "eight huit acht ocho",
    "9": "nine neuf neun nueve",
}
AT, DOT, PLUS = ("at", "arobase", "arroba"), ("dot", "punkt", "point", "punto"), ("plus", "más", "mas")
_VALUE = {w: d for d, ws in DIGITS.items() for w in ws.split()}
_NUMERALS = frozenset(_VALUE) | frozenset(AT + DOT + PLUS) - {"at"}
_EDGES = "+()[]{}<>:;!?\"'_=/"
_WORD = "|".join(sorted(_VALUE, key=len, reverse=True))
_DOTS, _ATS = "|".join(DOT), "|".join(AT)
#: A run of spelled or written digits, with signs between; five words at least.
_SPELLED = re.compile(rf"(?i)(?:\b(?:{'|'.join(PLUS)})[\s]+|\+\s*)?(?<![^\W_])(?:{_WORD})(?:[\s,.-]+(?:(?:{_WORD}|{_DOTS})(?![^\W_])|[0-9]+)){{4,}}(?![^\W_])")
_TOKEN = re.compile(rf"(?i)({_WORD})(?![^\W_])|({_DOTS})(?![^\W_])|({'|'.join(PLUS)})(?![^\W_])|([0-9]+)|([\s,.-]+)|(\+\s*)")
_BRACKET_AT = re.compile(rf"(?i)\s?[\[({{<]\s?(?:{_ATS}|@)\s?[\])}}>]\s?")
_BRACKET_DOT = re.compile(rf"(?i)\s?[\[({{<]\s?(?:{_DOTS}|\.)\s?[\])}}>]\s?")
#: name at host dot end, with at or dot spelled or set apart.
_SPOKEN = re.compile(rf"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9_%+-]{{1,64}}(?:(?:\.| (?:{_DOTS}) )[A-Za-z0-9_%+-]{{1,64}}){{0,8}}(?: (?:{_ATS}) | ?@ ?)[A-Za-z0-9-]{{1,63}}(?:(?: (?:{_DOTS}) | \. |\.)[A-Za-z0-9-]{{1,63}}){{1,8}}")
#: Ends of host names that are no common words (fixed values); where at and dot
#: are only spelled, or a dot is set apart, a name must end in one of them. Any two
#: letters do after a written at sign or one in brackets.
ENDS = frozenset("com org net edu gov mil int info biz io ai co app dev eu uk de fr es ch nl pt br mx ar cl pe ve jp cn kr ru pl cz hu gr ro bg se dk fi ca au nz ie lu li tv cc xyz online site shop example test invalid local".split())
_SPOKEN_ATS, _SPOKEN_DOTS = re.compile(rf"(?i) (?:{_ATS}) | ?@ ?"), re.compile(rf"(?i) (?:{_DOTS}) | \. |\.")
#: What every match of _SPOKEN has in it.
_SPOKEN_AT = re.compile(rf"(?i)(?: (?:{_ATS}) | ?@ ?)[A-Za-z0-9-]{{1,63}}(?: (?:{_DOTS}) | \. |\.)[A-Za-z0-9-]")
_SPOKEN_SIGNS = re.compile(rf"(?i) (?:{_ATS}) | ?@ ?| (?:{_DOTS}) | \. ")


class Tape:
    """A text and the source span that each of its characters stands for, kept by
    segments (where it begins, source start, source end): a segment without end
    stands character by character, one with an end stands for that span as a whole.
    So memory goes with the edits, not with the text."""

    def __init__(self, text: str, segments: list[tuple[int, int, int | None]] | None = None):
        self.text = text
        self.segments = segments or [(0, 0, None)]
        self.starts = [s[0] for s in self.segments]

    def at(self, i: int) -> tuple[int, int]:
        start, a, b = self.segments[bisect.bisect_right(self.starts, i) - 1]
        return (a, b) if b is not None else (a + i - start, a + i - start + 1)

    def source(self, start: int, end: int) -> tuple[int, int]:
        """The source span of characters start to end, exclusive."""
        return self.at(start)[0], self.at(end - 1)[1]

    def rewrite(self, edits: list[tuple[int, int, str]]) -> "Tape":
        """Replace the characters a to b by new text, for each (a, b, new) in order."""
        if not edits:
            return self
        out: list[str] = []
        segments: list[tuple[int, int, int | None]] = []
        done = size = k = 0

        def keep(a: int, b: int) -> None:
            nonlocal size, k
            while k + 1 < len(self.segments) and self.starts[k + 1] <= a:
                k += 1
            j = k
            while j < len(self.segments) and self.starts[j] < b:
                start, x, y = self.segments[j]
                at = max(a, start)
                piece = (size + at - a, x if y is not None else x + at - start, y)
                last = segments[-1] if segments else None
                goes_on = last and (last[1:] == piece[1:] if y is not None else last[2] is None and piece[1] - last[1] == piece[0] - last[0])
                if not goes_on:
                    segments.append(piece)
                j += 1
            size += b - a

        for a, b, new in edits:
            out += [self.text[done:a], new]
            if len(new) == b - a:
                keep(done, b)
            else:
                if done < a:
                    keep(done, a)
                if new:
                    segments.append((size, *self.source(a, b)))
                    size += len(new)
            done = b
        out.append(self.text[done:])
        if done < len(self.text):
            keep(done, len(self.text))
        return Tape("".join(out), segments)


def _plain(c: str) -> str:
    if c in INVISIBLE:
        return ""
    if c in HOMOGLYPHS or c in SIGNS:
        return HOMOGLYPHS.get(c) or SIGNS[c]
    if "！" <= c <= "～" or "\U0001d400" <= c <= "\U0001d7ff":
        return unicodedata.normalize("NFKC", c)
    return c


_ODD = re.compile("[" + re.escape("".join([*HOMOGLYPHS, *INVISIBLE, *SIGNS])) + "！-～\U0001d400-\U0001d7ff]")


def unify(tape: Tape) -> Tape:
    """Homoglyphs, other forms and invisible characters."""
    if tape.text.isascii():
        return tape
    return tape.rewrite([(m.start(), m.end(), _plain(m[0])) for m in _ODD.finditer(tape.text)])


def _may_spell(text: str) -> bool:
    """Whether some five words on end may be a run of digits."""
    found = text.lower().replace("-", " ").replace(",", " ").replace(".", " ").split()
    if _NUMERALS.isdisjoint(found):
        return False
    run = 0
    for w in found:
        run = run + 1 if w in _NUMERALS or w[0].isdigit() or w.strip(_EDGES) in _NUMERALS else 0
        if run == 5:
            return True
    return False


def digits(tape: Tape) -> Tape:
    """Runs of spelled digits; signs between digits go, a spelled dot stays a dot."""
    if not _may_spell(tape.text):
        return tape
    edits = []
    for run in _SPELLED.finditer(tape.text):
        at = run.start()
        while at < run.end() and (t := _TOKEN.match(tape.text, at, run.end())):
            new = _VALUE[t[1].lower()] if t[1] else "." if t[2] else "+" if t[3] or t[6] else t[4] or ""
            edits.append((t.start(), t.end(), new))
            at = t.end()
    return tape.rewrite(edits)


def signs(tape: Tape) -> Tape:
    """at and dot in brackets, spelled, or set apart by spaces."""
    text = tape.text
    if any(c in text for c in "[({<"):
        # only a whole address becomes a span, so brackets elsewhere change nothing
        edits = sorted([(m.start(), m.end(), "@") for m in _BRACKET_AT.finditer(text)] + [(m.start(), m.end(), ".") for m in _BRACKET_DOT.finditer(text)])
        if edits:
            tape = tape.rewrite(_apart(edits))
            text = tape.text
    if _SPOKEN_AT.search(text):
        edits = []
        for m in _SPOKEN.finditer(text):
            end = _address_end(m[0])
            edits += [(s.start(), s.end(), "@" if "@" in s[0] or s[0].strip().lower() in AT else ".") for s in _SPOKEN_SIGNS.finditer(text, m.start(), m.start() + end)]
        tape = tape.rewrite(edits)
    return tape


def _address_end(found: str) -> int:
    """The length of the address at the start of what _SPOKEN found, 0 if none:
    "see x@host . Then" and "look at this dot of ink" are prose."""
    at = _SPOKEN_ATS.search(found)
    dots = list(_SPOKEN_DOTS.finditer(found, at.end()))
    end = len(found)
    for k in range(len(dots) - 1, -1, -1):
        label, signs_ = found[dots[k].end() : end].lower(), [at[0], *(d[0] for d in dots[: k + 1])]
        if label in ENDS:
            return end
        if " . " not in signs_:
            if all(x.strip() in ("@", ".") for x in signs_) or "@" in at[0] and len(label) == 2 and label.isalpha():
                return end
        end = dots[k].start()
    return 0


def _apart(edits: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    out, done = [], 0
    for a, b, new in edits:
        if b > done:
            out.append((max(a, done), b, new))
            done = b
    return out


def spans_of(text: str) -> tuple[list[Span], list[Span]]:
    """The base spans of a text, and all its spans."""
    base = base_spans(text)
    start = Tape(text)
    tape = signs(digits(unify(start)))
    if tape is start:
        return base, base
    taken: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}  # in order, and apart
    for kind, a, b in base:
        taken[kind].append((a, b))
    added = []
    for kind, a, b in base_spans(tape.text):
        s, e = tape.source(a, b)
        own = taken[kind]
        at = bisect.bisect_left(own, (s, e))
        if not (at and own[at - 1][1] > s or at < len(own) and own[at][0] < e):
            added.append((kind, s, e))
            own.insert(at, (s, e))
    return base, ordered(base + added)


def redact(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind in brackets; overlapping
    spans are replaced as one, by the kind of the first."""
    out, done = [], 0
    for kind, a, b in spans:
        if a >= done:
            out += [text[done:a], f"[{kind.upper()}]"]
        done = max(done, b)
    return "".join(out) + text[done:]


# -- over tables --------------------------------------------------------------


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, spans, base_spans) by document: arrays of (kind, start, end)."""
    common.bound_batches(docs.sparkSession)
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [spans_of(t) for t in common.texts_of(batch)]
            cols = [pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in x[i]] for x in both], span) for i in (1, 0)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=["doc_id", "spans", "base_spans"])

    kind = "array<struct<kind: string, start: bigint, end: bigint>>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(common.lean(found), f"doc_id long, spans {kind}, base_spans {kind}")


def digest(docs: DataFrame) -> DataFrame:
    """Counts by kind of the base spans, their SHA-256, and all spans as a string."""

    def line(spans: str):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str):
        return F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return find(docs).select("doc_id", *(count(k) for k in KINDS), F.sha2(line("base_spans"), 256).alias("base_sha256"), line("spans").alias("spans"))


def mask(docs: DataFrame) -> DataFrame:
    """``docs`` with every span replaced in ``text``; ``n_chars``, where there is
    one, follows. A null text stays null."""
    common.bound_batches(docs.sparkSession)
    at = docs.columns.index("text")

    def masked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = [t and redact(t, spans_of(t)[1]) for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at), pa.array(new, batch.schema.field(at).type))

    out = docs.mapInArrow(common.lean(masked), docs.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text")).cast(docs.schema["n_chars"].dataType))
    return out


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
