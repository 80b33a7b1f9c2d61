"""Personal data, also in disguise, with spans in source characters.

Plain identifiers are found by fixed patterns.  For disguised ones a text goes
through a chain of small rewriting transducers - look-alike characters,
invisible characters, spelled digits, at/dot disguises.  Each writes a
normalised text and a tape that says which source characters every output
character came from.  The same patterns then read the last output, and the
tapes, read backwards, turn its spans into spans of the source.

Every pattern reads a text once: a run of characters is looked at from its
first place only, so a long run without an identifier costs linear time.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import StringType

from modelkeep.llm import words as W
from modelkeep.llm.common import hex_sha256, id_and_text, per_batch, settle

Span = tuple[int, int]

KINDS = ("email", "ip", "card", "phone")

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_DOTTED = re.compile(r"\.[0-9]+\.[0-9]")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def emails(text: str) -> Iterator[Span]:
    """An address has one @, so each @ is asked for the run before it and the domain after it."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and _LOCAL.match(text, start - 1):
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        # Characters looked at for this @ can't be part of a match that begins at a later one's left.
        if domain:
            free = domain.end()
            yield start, free
        at = text.find("@", max(at + 1, free))


def ips(text: str) -> Iterator[Span]:
    if not _DOTTED.search(text):
        return
    for m in _IP.finditer(text):
        if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or "0") <= 255 for part in m.groups()):
            yield m.span()


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def cards(text: str) -> Iterator[Span]:
    for m in _CARD.finditer(text):
        if 12 <= m.end() - m.start() <= 37:
            digits = re.sub("[^0-9]", "", m[0])
            if 12 <= len(digits) <= 19 and luhn(digits):
                yield m.span()


def phones(text: str) -> Iterator[Span]:
    if "+" not in text:
        return
    for m in _PHONE.finditer(text):
        if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
            yield m.span()


FIND: dict[str, Callable[[str], Iterator[Span]]] = {"email": emails, "ip": ips, "card": cards, "phone": phones}


class Tape:
    """An output text and where each piece of it came from."""

    def __init__(self, text: str, edits: list[tuple[int, int, str]]):
        out, self.at, self.source, self.exact, last, n = [], [], [], [], 0, 0
        for start, end, new in [*edits, (len(text), len(text), "")]:
            for piece, lo, hi, same in ((text[last:start], last, start, True), (new, start, end, False)):
                if piece:
                    self.at.append(n)
                    self.source.append((lo, hi))
                    self.exact.append(same)
                    out.append(piece)
                    n += len(piece)
            last = end
        self.text = "".join(out)

    def back(self, start: int, end: int) -> Span:
        """The source span of the output span."""
        k, m = bisect_right(self.at, start) - 1, bisect_right(self.at, end - 1) - 1
        first = self.source[k][0] + (start - self.at[k] if self.exact[k] else 0)
        return first, self.source[m][0] + end - self.at[m] if self.exact[m] else self.source[m][1]


# Letters of other scripts that look like these ASCII letters.
_LOOK_ALIKE = dict(zip("АВЕКМНОРСТХаеорсухіјѕԁԛԝһΑΒΕΖΗΙΚΜΝΟΡΤΥΧοαν", "ABEKMHOPCTXaeopcyxijsdqwhABEZHIKMNOPTYXoav", strict=True))
_INVISIBLE = "­​‌‍⁠﻿"
_WIDE = [*range(0xFF01, 0xFF5F), *range(0x1D400, 0x1D800), *range(0x2460, 0x2474), 0xFE52, 0xFE6B, 0x2024, *range(0x2070, 0x208A), 0xB2, 0xB3, 0xB9]
_ONE_TO_ONE = {ord(a): b for a, b in _LOOK_ALIKE.items()} | {
    c: n for c in _WIDE if len(n := unicodedata.normalize("NFKC", chr(c))) == 1 and n.isascii()} | {0x3002: ".", 0x2010: "-", 0x2011: "-", 0x2013: "-"}

# Digits as words, in English, German, French and Spanish.
_DIGIT_WORDS = {word: str(d) for d, row in enumerate((
    "zero oh null zéro cero", "one eins un uno", "two zwei deux dos", "three drei trois tres", "four vier quatre cuatro",
    "five fünf cinq cinco", "six sechs seis", "seven sieben sept siete", "eight acht huit ocho", "nine neun neuf nueve")) for word in row.split()}
_D = "(?:" + "|".join(sorted(_DIGIT_WORDS, key=len, reverse=True)) + ")"
_DOT_WORD, _AT_WORD = "(?:dot|punkt|punto|point)", "(?:at|arobase|arroba)"
_OPEN, _SHUT = r"[ \t]{0,3}[\[({<][ \t]{0,3}", r"[ \t]{0,3}[\])}>][ \t]{0,3}"
_DOT = rf"(?:\.|{_OPEN}(?:{_DOT_WORD}|\.){_SHUT}|[ \t]{{1,3}}{_DOT_WORD}[ \t]{{1,3}})"
_NEXT = rf"[ \t-]{{1,3}}(?={_D}(?!\w)|[0-9]|double[ \t])"
_DIGIT_RUN = re.compile(rf"(?<!\w)(?:plus[ \t]+)?{_D}(?:[ \t-]{{1,3}}(?:{_DOT_WORD}[ \t]{{1,3}})?(?:{_D}(?!\w)|[0-9]+|double[ \t]+{_D}(?!\w))){{2,}}(?!\w)", re.I)
_DIGIT_ITEM = re.compile(rf"plus[ \t]+|double[ \t]+({_D})(?:{_NEXT})?|({_D})(?:{_NEXT})?|([0-9]+)(?:{_NEXT})?", re.I)
_BRACKET_AT = re.compile(rf"{_OPEN}(?:{_AT_WORD}|@){_SHUT}", re.I)
_BRACKET_DOT = re.compile(rf"{_OPEN}(?:{_DOT_WORD}|\.){_SHUT}", re.I)
_BARE_AT = re.compile(rf"(?<=[A-Za-z0-9])[ \t]{{1,3}}(?:{_AT_WORD}|@)[ \t]{{1,3}}(?=[A-Za-z0-9-]{{1,63}}{_DOT}[A-Za-z0-9])", re.I)
_BARE_DOT = re.compile(rf"(?<=[A-Za-z0-9])[ \t]{{1,3}}{_DOT_WORD}[ \t]{{1,3}}(?=[A-Za-z0-9])", re.I)
#: What a text must hold for any of the transducers to change it.
_ODD = re.compile("[\u00ad\u00b2\u00b3\u00b9\u0370-\u052f\u200b-\u200d\u2010-\u2013\u2024\u2060\u2070-\u2089\u2460-\u2473\u3002\ufe52\ufe6b\ufeff\uff01-\uff5e\U0001d400-\U0001d7ff]")
_SIGNS = (" dot ", " punkt ", " punto ", " point ", "arobase", "arroba", " @ ", "\tdot\t", "\t@\t")
_BRACKETED = re.compile(rf"[\[({{<][ \t]{{0,3}}(?:{_AT_WORD}|{_DOT_WORD}|@|\.)[ \t]{{0,3}}[\])}}>]")
_AT_DOMAIN = re.compile(r"[ \t]at[ \t]{1,3}[a-z0-9-]{1,63}\.[a-z0-9]")
_TWO_DIGITS = re.compile(rf"[^\w]{_D}[ \t-]{{1,3}}(?:{_D}|[0-9]+|double|{_DOT_WORD})(?!\w)")

#: Last parts of the host in a disguised address, besides those of two letters.
TOP_LEVEL = frozenset("com org net edu gov mil int info biz name app dev example test invalid".split())


def disguised(text: str) -> bool:
    """A quick look whether some transducer may change the text."""
    if not text.isascii() and _ODD.search(text):
        return True
    low = " " + text.lower()
    return (any(sign in low for sign in _SIGNS) or _BRACKETED.search(low) is not None
            or " at " in low and _AT_DOMAIN.search(low) is not None or _TWO_DIGITS.search(low) is not None)


def _all(pattern: re.Pattern, new: str) -> Callable[[str], list[tuple[int, int, str]]]:
    return lambda text: [(m.start(), m.end(), new) for m in pattern.finditer(text)]


def _digits(text: str) -> list[tuple[int, int, str]]:
    """Spelled digits of a run become figures, without what stands between them."""
    edits = []
    for run in _DIGIT_RUN.finditer(text):
        for m in _DIGIT_ITEM.finditer(text, run.start(), run.end()):
            word = m[1] or m[2]
            if word:
                edits.append((m.start(), min(m.end(), run.end()), _DIGIT_WORDS[word.lower()] * (2 if m[1] else 1)))
            elif m[3]:
                edits += [(m.end(3), m.end(), "")] if m.end(3) < m.end() else []
            else:
                edits.append((m.start(), m.end(), "+"))
    return edits


TRANSDUCERS: tuple[Callable[[str], list[tuple[int, int, str]]], ...] = (
    _all(re.compile(f"[{_INVISIBLE}]"), ""), _digits, _all(_BRACKET_AT, "@"), _all(_BRACKET_DOT, "."), _all(_BARE_AT, "@"), _all(_BARE_DOT, "."))


def normalise(text: str) -> tuple[str, Callable[[int, int], Span]]:
    """The text after all transducers, and the way back for its spans."""
    now, tapes = text.translate(_ONE_TO_ONE), []
    for transducer in TRANSDUCERS:
        edits = transducer(now)
        if edits:
            tapes.append(Tape(now, edits))
            now = tapes[-1].text

    def back(start: int, end: int) -> Span:
        for tape in reversed(tapes):
            start, end = tape.back(start, end)
        return start, end
    return now, back


def find(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(kind, start, end) of the plain identifiers, and of all with the
    disguised ones; both by start, then kind as listed.  Ends are exclusive."""
    base = [(kind, *span) for kind in KINDS for span in FIND[kind](text)]
    every = set(base)
    if disguised(text):
        now, back = normalise(text)
        if now != text:
            known = {kind: [(a, b) for k, a, b in base if k == kind] for kind in KINDS}
            for kind in KINDS:
                for a, b in FIND[kind](now):
                    last = now[a:b].rpartition(".")[2].lower()
                    if kind == "email" and last not in TOP_LEVEL and not (len(last) == 2 and last.isalpha()):
                        continue
                    start, end = back(a, b)
                    if text[start:end] != now[a:b] and not any(x <= start and end <= y for x, y in known[kind]):
                        every.add((kind, start, end))
    order = lambda s: (s[1], KINDS.index(s[0]), s[2])
    return sorted(base, key=order), sorted(every, key=order)


def written(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span, or spans that overlap, as one mark of the first one's kind."""
    out, last = [], 0
    for kind, start, end in spans:
        if start >= last:
            out += [text[last:start], f"[{kind.upper()}]"]
        last = max(last, end)
    return "".join(out) + text[last:]


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, found (plain identifiers as
    kind, start, end) and every (with the disguised ones); spans are in code
    points of the source.

    Null is an empty text and has none; ids may be null or repeated; other
    columns are not read; an empty table gives no rows.
    """
    settle(docs.sparkSession)
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    as_rows = lambda found: [[dict(zip(("kind", "start", "end"), s)) for s in spans] for spans in found]

    def run(batch):
        for lo, hi, _, _ in W.slices(batch.column(1)):
            found = [find(t) for t in batch.column(1).slice(lo, hi - lo).to_pylist()]
            yield pa.record_batch([batch.column(0).slice(lo, hi - lo), pa.array(as_rows(b for b, _ in found), span), pa.array(as_rows(e for _, e in found), span)],
                                  names=["doc_id", "found", "every"])
    kind = "array<struct<kind: string, start: int, end: int>>"
    return id_and_text(docs, id_col, text_col).mapInArrow(per_batch(run), f"doc_id long, found {kind}, every {kind}")


@arrow_udf(StringType())
def redacted(text: pa.Array) -> pa.Array:
    """A text column without its personal data; null stays null."""
    return pa.array([None if t is None else redact(t, find(t)[1]) for t in text.to_pylist()], pa.string())


def op4_pii(spark, sf_dir: str) -> DataFrame:
    """Every document's identifiers.  n_* count the plain ones, of which
    base_sha256 is the digest; found_* count those in ``spans``."""
    found = personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda spans, kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
    return found.select("doc_id", *[count("found", k).alias(f"n_{k}") for k in KINDS], F.sha2(text("found"), 256).alias("base_sha256"),
                        text("every").alias("spans"), *[count("every", k).alias(f"found_{k}") for k in KINDS])
