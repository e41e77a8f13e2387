"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, plus signs, digits, schemes
and the names of identifiers. From each anchor a local parser expands to the bounds of
what stands there and validates it.

Base kinds (fixed rules, leftmost without overlap, a match that fails is dropped):

* ``email``: local part, at-sign, host of two labels or more
* ``ip``: four dotted numbers of at most 255
* ``card``: 13 to 19 digits, single spaces or hyphens between, with a Luhn check sum
* ``phone``: plus sign and 9 to 15 digits with brackets, dots, spaces or hyphens

The anchors also give ``url`` (scheme and host), ``iban`` (check sum modulo 97),
``ssn`` and ``account`` (a number after its name), ``secret`` (what is assigned to a name
like token or password, if it looks drawn at random) and ``key`` (keys known by their
beginning, private key blocks). Places count code points, ends are exclusive.

Defined results: a null or empty text has no spans; each row is worked on by itself, so
repeated rows give repeated results and an empty table an empty one; other columns take no
part. Texts are scanned whole, in time linear in their length but for the few characters
that a local parser looks at twice; a worker holds one text and its spans at a time.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache
from math import log2

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "url", "iban", "ssn", "account", "secret", "key")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGITS = frozenset("0123456789")
_HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_URL = re.compile(r"[^\s<>\"'()\[\]{}]+")
_IBAN = re.compile(r"[ :]{0,3}([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30})")
_SSN = re.compile(r"[ :#.]{0,4}([0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9-])")
_ACCOUNT = re.compile(r"[ :#.]{0,4}(?:no|number|nr)?[ :#.]{0,4}([0-9](?:[ -]?[0-9]){5,19})(?![0-9])")
# What may stand between a name and its value: the rest of the name, a mark, a quote.
_SECRET = re.compile(r"[A-Za-z0-9_-]{0,24}[\"']?[ \t]{0,4}(?:=>|:=|=|:|[Ii][Ss]\b)[ \t]{0,4}[\"'`]?([A-Za-z0-9+/_.=~!@#$%^&*-]{8,512})")
_BEARER = re.compile(r"[ \t]{1,4}([A-Za-z0-9._~+/-]{16,512}=*)")
_BLOCK = re.compile(r"-----BEGIN [A-Z ]{0,24}PRIVATE KEY-----")
_BLOCK_END = re.compile(r"-----END [A-Z ]{0,24}PRIVATE KEY-----")
# How keys of well-known services look.
_KEYS = {
    "AKIA": re.compile(r"AKIA[0-9A-Z]{16}(?![0-9A-Z])"),
    "ghp_": re.compile(r"ghp_[A-Za-z0-9]{36}"),
    "gho_": re.compile(r"gho_[A-Za-z0-9]{36}"),
    "ghs_": re.compile(r"ghs_[A-Za-z0-9]{36}"),
    "sk-": re.compile(r"sk-[A-Za-z0-9_-]{20,200}"),
    "xoxb-": re.compile(r"xoxb-[A-Za-z0-9-]{20,200}"),
    "xoxp-": re.compile(r"xoxp-[A-Za-z0-9-]{20,200}"),
    "AIza": re.compile(r"AIza[A-Za-z0-9_-]{35}"),
    "eyJ": re.compile(r"eyJ[A-Za-z0-9_-]{8,4000}\.[A-Za-z0-9_-]{8,4000}\.[A-Za-z0-9_-]{8,4000}"),
}
# Bits a character of a value drawn at random, at least; characters of a value without a digit.
LEAST_BITS = 2.9
WORDLIKE = 20

_SCHEMES = ("http://", "https://", "ftp://")
_CUES = {
    "iban": ("iban",), "ssn": ("ssn",), "account": ("account", "acct", "konto", "cuenta", "compte"),
    "secret": ("token", "secret", "password", "passwd", "passphrase", "pwd", "key", "credential"), "bearer": ("bearer",),
}


def luhn(digits: str) -> bool:
    """Whether the digits' Luhn sum is a multiple of ten."""
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) << (place & 1)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def mod97(iban: str) -> bool:
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


@lru_cache(maxsize=1)
def anchors() -> ahocorasick.Automaton:
    """Automaton whose values are ``(kind of anchor, its length)``."""
    automaton = ahocorasick.Automaton()
    automaton.add_word("@", ("at", 1))
    automaton.add_word("+", ("plus", 1))
    for digit in "0123456789":
        automaton.add_word(digit, ("digit", 1))
    for scheme in _SCHEMES:
        automaton.add_word(scheme, ("scheme", len(scheme)))
    for kind, cues in _CUES.items():
        for cue in cues:
            for form in {cue, cue.upper(), cue.capitalize()}:
                automaton.add_word(form, (kind, len(form)))
    for start in _KEYS:
        automaton.add_word(start, ("start", len(start)))
    automaton.add_word("-----BEGIN ", ("block", 11))
    automaton.make_automaton()
    return automaton


def _email(text: str, at: int, free: int) -> tuple[int, int, bool] | None:
    start = at
    while start > free and text[start - 1] in _LOCAL:
        start -= 1
    host = _HOST.match(text, at + 1) if start < at else None
    return (start, host.end(), True) if host else None


def _ip(text: str, at: int, free: int) -> tuple[int, int, bool] | None:
    found = _IP.match(text, at)
    if not found:
        # No other digit of this run can begin one either.
        end = at
        while end < len(text) and text[end] in _DIGITS:
            end += 1
        return at, end, False
    parts = (p.lstrip("0") for p in found.group().split("."))
    return at, found.end(), all(len(p) <= 3 and int(p or 0) <= 255 for p in parts)


def _card(text: str, at: int, free: int) -> tuple[int, int, bool] | None:
    found = _CARD.match(text, at)
    if not found:
        return None
    digits = found.group().replace(" ", "").replace("-", "")
    return at, found.end(), 13 <= len(digits) <= 19 and luhn(digits)


def _phone(text: str, at: int, free: int) -> tuple[int, int, bool] | None:
    found = _PHONE.match(text, at)
    if not found:
        return None
    return at, found.end(), 9 <= sum(c in _DIGITS for c in found.group()) <= 15


def _url(text: str, at: int, free: int) -> tuple[int, int, bool] | None:
    found = _URL.match(text, text.index("//", at) + 2)
    if not found:
        return None
    end = found.end()
    while end > found.start() and text[end - 1] in ".,;:!?":
        end -= 1
    return at, end, end > found.start()


def _after(pattern: re.Pattern, valid: Callable[[str], bool], size: Callable[[str], int]):
    def parse(text: str, at: int, free: int) -> tuple[int, int, bool] | None:
        found = pattern.match(text, at + size(text[at:at + 8]))
        return (*found.span(1), valid(found.group(1))) if found else None

    return parse


def _cue_size(kind: str) -> Callable[[str], int]:
    return lambda text: next(len(c) for c in sorted(_CUES[kind], key=len, reverse=True) if text.lower().startswith(c))


def random_looking(value: str) -> bool:
    """Whether a value has letters and digits mixed, or is long, and says much a character."""
    value = value.rstrip(".")
    some_digit, some_letter = any(c in _DIGITS for c in value), any(c.isalpha() for c in value)
    if len(value) < 8 or not some_letter or (not some_digit and len(value) < WORDLIKE):
        return False
    counts = [value.count(c) for c in set(value)]
    bits = -sum(n / len(value) * log2(n / len(value)) for n in counts)
    # A short value cannot say more than its length allows.
    return bits >= min(LEAST_BITS, 0.8 * log2(len(value)))


def _secret(text: str, at: int, free: int) -> tuple[int, int, bool] | None:
    found = _SECRET.match(text, at + _cue_size("secret")(text[at:at + 12]))
    if not found:
        return None
    start, end = found.span(1)
    while end > start and text[end - 1] in ".,;:!?":
        end -= 1
    # A value that is none may hold the name of the next one.
    return (start, end, True) if random_looking(text[start:end]) else None


def _key(text: str, at: int, free: int) -> tuple[int, int, bool] | None:
    inside = at and (text[at - 1].isalnum() or text[at - 1] == "_")
    for start, pattern in _KEYS.items():
        found = pattern.match(text, at) if text.startswith(start, at) and not inside else None
        if found:
            return *found.span(), random_looking(found.group())
    return None


def _block(text: str, at: int, free: int) -> tuple[int, int, bool] | None:
    """A private key with its first and last line; one without an end goes to the end of the text."""
    found = _BLOCK.match(text, at)
    if not found:
        return None
    last = _BLOCK_END.search(text, found.end())
    return at, last.end() if last else len(text), True


_PARSERS = {
    "at": (("email", _email),),
    "digit": (("ip", _ip), ("card", _card)),
    "plus": (("phone", _phone),),
    "scheme": (("url", _url),),
    "iban": (("iban", _after(_IBAN, lambda x: mod97(x.replace(" ", "")), _cue_size("iban"))),),
    "ssn": (("ssn", _after(_SSN, lambda x: True, _cue_size("ssn"))),),
    "account": (("account", _after(_ACCOUNT, lambda x: True, _cue_size("account"))),),
    "secret": (("secret", _secret),),
    "bearer": (("secret", _after(_BEARER, random_looking, _cue_size("bearer"))),),
    "start": (("key", _key),),
    "block": (("key", _block),),
}
_ORDER = {kind: place for place, kind in enumerate(KINDS)}


def spans_of(text: str | None) -> list[tuple[str, int, int]]:
    """Spans ``(kind, start, end)``, by kind as listed, then by start."""
    if not text:
        return []
    found: list[tuple[str, int, int]] = []
    free = dict.fromkeys(KINDS, 0)
    for last, (anchor, size) in anchors().iter(text):
        at = last - size + 1
        for kind, parse in _PARSERS[anchor]:
            if at < free[kind]:
                continue
            span = parse(text, at, free[kind])
            if span is None:
                continue
            start, end, valid = span
            free[kind] = end
            if valid:
                found.append((kind, start, end))
    found.sort(key=lambda s: (_ORDER[s[0]], s[1]))
    return found


def spans_column(text: Column) -> Column:
    """All spans of each text as ``array<struct<kind, start, end>>``."""

    @F.arrow_udf("array<struct<kind: string, start: int, end: int>>")
    def spans(texts: pa.Array) -> pa.Array:
        counts, kinds, starts, ends = [0], [], [], []
        for at in range(0, len(texts), 500):
            for text in texts.slice(at, 500).to_pylist():
                for kind, start, end in spans_of(text):
                    kinds.append(kind)
                    starts.append(start)
                    ends.append(end)
                counts.append(len(kinds))
        rows = pa.StructArray.from_arrays(
            [pa.array(kinds, pa.string()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())],
            names=["kind", "start", "end"],
        )
        return pa.ListArray.from_arrays(pa.array(counts, pa.int32()), rows)

    return spans(text)


def redacted(text: str | None) -> str | None:
    """The text with each span, or run of overlapping spans, replaced by its first kind."""
    spans = sorted(spans_of(text), key=lambda s: (s[1], -s[2]))
    if not spans:
        return text
    out, done = [], 0
    for kind, start, end in spans:
        if start >= done:
            out += [text[done:start], f"<{kind.upper()}>"]
        done = max(done, end)
    return "".join([*out, text[done:]])


def redact_column(text: Column) -> Column:
    """Each text without its personal data; null stays null."""

    @F.arrow_udf("string")
    def redact(texts: pa.Array) -> pa.Array:
        return pa.array([redacted(x) for x in texts.to_pylist()], pa.string())

    return redact(text)


def joined_spans(spans: Column) -> Column:
    """``kind:start:end`` of spans in their order, joined by commas."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )
