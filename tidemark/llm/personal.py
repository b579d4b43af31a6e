"""Personal data by anchors: one Aho-Corasick pass finds where to look, local parsers find the bounds.

An anchor is an at-sign, a plus, a digit, a scheme or a word that announces an
identifier. At each, a parser of that kind expands to the left and right and
validates what it finds; text without anchors is passed over.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import query, table

KINDS = ("email", "ip", "card", "phone", "address", "account")
#: Kinds whose patterns are fixed by the contract; the method adds the others.
BASE = KINDS[:4]

# Fixed values of the contract: what a span of each base kind may consist of.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])*")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Parsers of the added kinds.
_AUTHORITY = re.compile(r"([^\s/?#@\"'<>]+)@(?:\[[0-9A-Fa-f:.]+\]|[A-Za-z0-9][A-Za-z0-9.-]*)(?::[0-9]{1,5})?")
_SCHEME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")
_MAILBOX = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*")
_NUMBER = re.compile(r"[0-9](?:[\x20().-]?[0-9]){6,14}(?![0-9])")
_SPELT = re.compile(r"[\x20]?[A-Za-z0-9-]+(?:(?:\.|[\x20]?[(\[]dot[)\]][\x20]?)[A-Za-z0-9-]+)+")
_AFTER_CUE = re.compile(r"(?:[\x20\t]*(?:no\.?|nr\.?|number|num|id|#)(?![A-Za-z0-9]))?[\x20\t]*[:=#]?[\x20\t]*", re.IGNORECASE)
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?:[\x20]?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_SSN = re.compile(r"(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
_PASSPORT = re.compile(r"[A-Z]{0,2}[0-9]{6,9}(?![A-Za-z0-9])")
_ACCOUNT = re.compile(r"(?=(?:[A-Z-]*[0-9]){5})[A-Z0-9](?:-?[A-Z0-9]){5,23}(?![A-Za-z0-9])")
_LOGIN = re.compile(r"(?<=[:=\x20\t])[A-Za-z0-9](?:[._-]?[A-Za-z0-9]){2,31}(?![A-Za-z0-9@])")

_CUES: dict[str, re.Pattern] = {
    "iban": _IBAN, "ssn": _SSN, "social security": _SSN, "passport": _PASSPORT, "account": _ACCOUNT, "acct": _ACCOUNT,
    "customer": _ACCOUNT, "member": _ACCOUNT, "policy": _ACCOUNT, "username": _LOGIN, "login": _LOGIN,
}
_SCHEMES = ("mailto:", "sip:", "sips:", "xmpp:", "tel:", "callto:")
_SPELT_AT = ("(at)", "[at]", "＠")


def _automaton() -> ahocorasick.Automaton:
    anchors = ahocorasick.Automaton()
    for c in "0123456789":
        anchors.add_word(c, ("digit", c))
    anchors.add_word("@", ("at", "@"))
    anchors.add_word("+", ("plus", "+"))
    anchors.add_word("://", ("authority", "://"))
    for word in _SPELT_AT:
        anchors.add_word(word, ("spelt", word))
    for kind, words in (("scheme", _SCHEMES), ("cue", _CUES)):
        for word in words:
            for form in {word, word.upper(), word.title(), word.capitalize()}:
                anchors.add_word(form, (kind, word))
    anchors.make_automaton()
    return anchors


def luhn(digits: str) -> bool:
    """Whether the last digit checks the others."""
    doubled = [2 * int(c) for c in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(d - 9 if d > 9 else d for d in doubled)) % 10 == 0


def iban_fits(text: str) -> bool:
    """The remainder of an account number, its head moved to the end, is 1 modulo 97."""
    packed = text.replace(" ", "")
    return 15 <= len(packed) <= 34 and int("".join(str(int(c, 36)) for c in packed[4:] + packed[:4])) % 97 == 1


def _back(text: str, at: int, floor: int, allowed: frozenset) -> int:
    while at > floor and text[at - 1] in allowed:
        at -= 1
    return at


class Finder:
    """The anchors, and a parser for each kind of them."""

    def __init__(self) -> None:
        self.anchors = _automaton()

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """(kind number, start, end), sorted; places are code points, ends exclusive."""
        found: list[tuple[int, int, int]] = []
        # Where the last match of a base kind ended: matches of one kind never overlap, kept or not.
        email_end = card_end = phone_end = run_end = ip_end = 0
        later: list[tuple[str, str, int]] = []
        for last, (kind, word) in self.anchors.iter(text):
            if kind == "digit":
                if last >= card_end:
                    card_end = _DIGITS.match(text, last).end()
                    if card_end - last > 12:
                        digits = text[last:card_end].replace(" ", "").replace("-", "")
                        if 13 <= len(digits) <= 19 and luhn(digits):
                            found.append((2, last, card_end))
                # An address begins with the first digit of a row of digits.
                if last >= run_end and last >= ip_end:
                    m = _IP.match(text, last)
                    if m:
                        ip_end = m.end()
                        if all(len(part.lstrip("0")) <= 3 and int(part) <= 255 for part in m[0].split(".")):
                            found.append((1, last, ip_end))
                run_end = last + 1 if last + 1 > run_end else run_end
                while run_end < len(text) and "0" <= text[run_end] <= "9":
                    run_end += 1
            elif kind == "at":
                start = _back(text, last, email_end, _LOCAL)
                m = _DOMAIN.match(text, last + 1) if start < last else None
                if m:
                    email_end = m.end()
                    found.append((0, start, email_end))
            elif kind == "plus":
                m = _PHONE.match(text, last) if last >= phone_end else None
                if m:
                    phone_end = m.end()
                    if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                        found.append((3, last, phone_end))
            else:
                later.append((kind, word, last))
        if later:
            found += self._added(text, later, found)
        return sorted(found)

    def _added(self, text: str, anchors: list[tuple[str, str, int]], base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        taken: set[tuple[int, int, int]] = set()
        for kind, word, last in anchors:
            begin, after = last + 1 - len(word), last + 1
            span = None
            if kind == "authority":
                m = _AUTHORITY.match(text, after)
                start = _back(text, begin, max(0, begin - 32), _SCHEME)
                if m and start < begin:
                    span = (4, start, m.end())
            elif kind == "scheme":
                m = (_NUMBER if word in ("tel:", "callto:") else _MAILBOX).match(text, after)
                if m and (begin == 0 or not text[begin - 1].isalnum()):
                    span = (4, after, m.end())
            elif kind == "spelt":
                stop = begin - 1 if begin and text[begin - 1] == " " else begin
                start = _back(text, stop, max(0, stop - 64), _LOCAL)
                m = _SPELT.match(text, after)
                if m and start < stop:
                    span = (4, start, m.end())
            elif begin == 0 or not text[begin - 1].isalnum():
                at = _AFTER_CUE.match(text, after).end()
                parser = _CUES[word]
                m = parser.match(text, at)
                if m and at > after and (parser is not _IBAN or iban_fits(m[0])) and (parser is not _LOGIN or set(text[after:at]) & set(":=")):
                    span = (5, m.start(), m.end())
            # A span inside one that is known adds nothing.
            if span and not any(s <= span[1] and span[2] <= e for _, s, e in base):
                taken.add(span)
        kept: list[tuple[int, int, int]] = []
        for span in sorted(taken, key=lambda s: (s[0], s[1], -s[2])):
            if not kept or kept[-1][0] != span[0] or span[1] >= kept[-1][2]:
                kept.append(span)
        return kept


def _scanned(batches: Iterable[pa.RecordBatch], make: Callable[[str, list[tuple[int, int, int]]], object], kind: pa.DataType, name: str) -> Iterator[pa.RecordBatch]:
    finder = Finder()
    for batch in batches:
        made = [make(text, finder.spans(text)) for text in ((t.as_py() or "") for t in batch.column(1))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, kind)], ["_id", name])


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("text", pa.string())])


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: the id and spans, an array of kind, start, end, text.

    Spans are sorted by kind (as in ``KINDS``), then start, in code points, ends
    exclusive. Spans of the base kinds are the leftmost non-overlapping matches
    of their patterns that pass their checks. Added are addresses (a user in
    front of a host after ``://``; mailboxes and numbers after a scheme; at-signs
    that are spelt out) and accounts (what follows a cue such as "IBAN" or
    "account no" and has the form and checksum of it), unless a base span holds
    them. A null or empty text has none. Texts are read whole and once. Repeated
    rows are dealt with one by one; other columns are ignored.
    """

    def found(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = lambda text, spans: [{"kind": KINDS[k], "start": s, "end": e, "text": text[s:e]} for k, s, e in spans]
        return _scanned(batches, make, pa.list_(_SPAN), "spans")

    slim = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    out = slim.mapInArrow(found, f"_id {slim.schema['_id'].dataType.simpleString()}, spans array<struct<kind:string,start:long,end:long,text:string>>")
    return out.select(F.col("_id").alias(id_col), "spans")


def masked_text(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with every span replaced by its kind in brackets; spans that overlap become one."""
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind]}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def mask_personal_data(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with personal data in the text replaced by ``[kind]``; all other columns as they are, a null text stays null."""

    def found(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _scanned(batches, masked_text, pa.string(), "_text")

    # Whole rows in one column, so that none of their names can clash.
    slim = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_id"), F.col(text_col).alias("_text"))
    out = slim.mapInArrow(found, f"_id {slim.schema['_id'].dataType.simpleString()}, _text string")
    keep = lambda c: F.when(F.col(f"_id.`{c}`").isNotNull(), F.col("_text")) if c == text_col else F.col(f"_id.`{c}`")
    return out.select(*[keep(c).alias(c) for c in docs.columns])


@query("op12_personal_data")
def op12_personal_data(spark, sf):
    found = personal_data(table(spark, sf, "documents"))
    of = lambda kind: F.filter("spans", lambda s: s.kind == kind)
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")
    return found.select(
        "doc_id", *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(listed(F.filter("spans", lambda s: s.kind.isin(*BASE))), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"),
    )
