"""Personal data by anchor expansion (operator 3).

An Aho-Corasick automaton runs once over each whole text and reports anchors: at-signs, plus-signs and digits, URL
schemes and identifier cues. A deterministic local parser grows each anchor to its boundaries and validates what it
holds. Spans of one kind never overlap, the leftmost wins, and a parse that fails validation is dropped without another
try, while its characters stay used up.

Kinds: ``email``, ``ip``, ``card`` (Luhn), ``phone`` are the base kinds; the method adds ``address`` (a URL that carries
user information, or a ``mailto:``) and ``account`` (credentials and account numbers after a cue, IBANs with a valid
check number, told by their country code or after a cue). Added spans never change the base ones.

Every character is read a bounded number of times, so runs of digits or of schemes of any length cost no more than prose.

Null or empty text: no spans. Repeated rows are searched row by row; extra columns are ignored. Offsets are code points,
ends exclusive.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "address", "account")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_DIGIT_RUN = re.compile(r"[0-9]+")
_IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_AUTHORITY = re.compile(r"[^\s<>\"'`{}|\\^/]+")
_MAILBOX = re.compile(r"[^\s<>\"'`{}|\\^/:]+")
_URL_REST = re.compile(r"[^\s<>\"'`{}|\\^]+")
_VALUE = re.compile(r"""\s{0,3}[=:]\s{0,3}["']?([A-Za-z0-9_+/.@#$!%^&*~-]{6,})["']?""")
_NUMBER = re.compile(r"[\s:=#.]{1,6}(?:no|nr|number|num)?[\s:=#.]{0,4}([A-Z]{0,2}[0-9]+(?:[ -]?[A-Z]{0,2}[0-9]+)*)")
_KEY_ID = re.compile(r"AKIA[0-9A-Z]{16}(?![0-9A-Za-z])")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}")
_IBAN_START = re.compile(r"(?=[A-Z]{2}[0-9]{2})")
IBAN_WITHIN = 48  #: characters behind a cue in which an IBAN of a country that is not listed begins; listed ones need no cue

# Lengths of IBANs by country.
IBAN_LENGTHS = {
    c: n
    for n, codes in (
        (15, "NO"), (16, "BE"), (18, "DK FI FK FO GL NL SD"), (19, "MK SI"), (20, "AT BA EE KZ LT LU MN XK"), (21, "CH HR LI LV"), (22, "BG BH CR DE GB GE IE ME RS VA"),
        (23, "AE GI IL IQ OM SO TL"), (24, "AD CZ ES MD PK RO SA SE SK TN VG"), (25, "LY PT ST"), (26, "IS TR"), (27, "BI DJ FR GR IT MC MR SM"),
        (28, "AL AZ BY CY DO GT HN HU LB NI PL SV"), (29, "BR EG PS QA UA"), (30, "JO KW MU YE"), (31, "MT SC"), (32, "LC"), (33, "RU"),
    )
    for c in codes.split()
}
_DIGITS = "0123456789"

SCHEMES = ("http://", "https://", "ftp://", "sftp://", "ssh://", "mailto:")
SECRET_CUES = ("password", "Password", "PASSWORD", "passwd", "token", "Token", "TOKEN", "secret", "Secret", "api_key", "apikey", "API_KEY")
NUMBER_CUES = ("account", "Account", "ACCOUNT", "acct", "Acct", "Konto", "konto", "cuenta", "Cuenta", "compte", "Compte")
IBAN_CUES = ("IBAN", "iban", "Iban")


def luhn(digits: str) -> bool:
    total = 0
    for i, ch in enumerate(reversed(digits)):
        d = ord(ch) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def ip_ok(parts: list[str]) -> bool:
    """At most 255 each, however many zeros lead."""
    return all(len(p) <= 3 and int(p or "0") <= 255 for p in (x.lstrip("0") for x in parts))


def like_a_secret(value: str) -> bool:
    """No plain word: it has digits, symbols or capitals behind small letters, or is a very long run of letters."""
    core = value.rstrip(".!-")
    inner = any(c in "0123456789#$%^&*~+@!" for c in core) or any(a.islower() and b.isupper() for a, b in zip(core, core[1:], strict=False))
    return inner or (len(core) >= 20 and core.isalpha())


def iban_ok(text: str) -> bool:
    s = text.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def iban_at(text: str, start: int) -> int | None:
    """End of the IBAN that begins at ``start``: its country's length, else the longest whole run of characters with a valid
    check number."""
    m = _IBAN.match(text, start)
    if not m:
        return None
    ends = [i + 1 for i in range(start, m.end()) if text[i] != " "]
    size = IBAN_LENGTHS.get(text[start : start + 2], 0)
    whole = [e for e in reversed(ends[14:]) if not text[e : e + 1].isalnum() or e == m.end()]
    return next((e for e in ends[size - 1 : size] * (size > 0) + whole if iban_ok(text[start:e])), None)


def find_iban(text: str, at: int) -> tuple[int, int] | None:
    """The first IBAN that begins within ``IBAN_WITHIN`` characters from ``at``."""
    for m in _IBAN_START.finditer(text, at, at + IBAN_WITHIN + 4):
        if m.start() < at + IBAN_WITHIN and (end := iban_at(text, m.start())):
            return m.start(), end
    return None


def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for kind, words in (("@", "@"), ("+", "+"), ("d", _DIGITS), ("scheme", SCHEMES), ("secret", SECRET_CUES), ("number", NUMBER_CUES), ("iban", IBAN_CUES), ("country", IBAN_LENGTHS), ("key", ("AKIA",))):
        for w in words:
            a.add_word(w, (kind, len(w)))
    a.make_automaton()
    return a


def spans_of(text: str, anchors) -> Iterator[tuple[str, int, int]]:
    """All spans of ``text`` as (kind, start, end), in no set order."""
    done = dict.fromkeys(KINDS, 0)
    for last, (kind, size) in anchors.iter(text):
        at = last + 1 - size
        if kind == "d":
            if at >= done["ip"]:
                m = _IP.match(text, at)
                done["ip"] = (m or _DIGIT_RUN.match(text, at)).end()  # where a run of digits begins no match, none of its digits does
                if m and ip_ok(m.group().split(".")):
                    yield "ip", at, m.end()
            if at >= done["card"] and (m := _CARD.match(text, at)):
                done["card"] = m.end()
                digits = m.group().replace(" ", "").replace("-", "")
                if 13 <= len(digits) <= 19 and luhn(digits):
                    yield "card", at, m.end()
        elif kind == "@":
            start = at
            while start > done["email"] and text[start - 1] in _LOCAL:
                start -= 1
            if start < at and (m := _DOMAIN.match(text, at + 1)):
                done["email"] = m.end()
                yield "email", start, m.end()
        elif kind == "+":
            if at >= done["phone"] and (m := _PHONE.match(text, at)):
                done["phone"] = m.end()
                if 9 <= sum(map(m.group().count, _DIGITS)) <= 15:
                    yield "phone", at, m.end()
        elif kind == "scheme":
            # The authority alone decides first: it ends before the next scheme, the rest of an address need not.
            part = (_MAILBOX if text[at] == "m" else _AUTHORITY).match(text, last + 1) if at >= done["address"] else None
            if part and "@" in part.group() and "." in part.group().rpartition("@")[2]:
                m = _URL_REST.match(text, last + 1)
                end = m.end() - (len(m.group()) - len(m.group().rstrip(".,;:!?)")))
                user, sign, host = text[last + 1 : end].partition("/")[0].rpartition("@")
                if user and sign and "." in host:
                    done["address"] = end
                    yield "address", at, end
        elif at >= done["account"]:
            found = None
            if kind == "secret":
                if (m := _VALUE.match(text, last + 1)) and like_a_secret(m[1]):
                    found = m.span(1)
            elif kind == "number":
                if (m := _NUMBER.match(text, last + 1)) and sum(map(m[1].count, _DIGITS)) >= 6:
                    found = m.span(1)
            elif kind == "country":
                if text[last + 1 : last + 2].isdigit() and not (at and text[at - 1].isalnum()) and (end := iban_at(text, at)) and len(text[at:end].replace(" ", "")) == IBAN_LENGTHS[text[at : at + 2]]:
                    found = at, end
            elif kind == "key":
                if (m := _KEY_ID.match(text, at)) and not (at and text[at - 1].isalnum()):
                    found = m.span()
            else:
                found = find_iban(text, last + 1)
            if found and found[0] >= done["account"]:
                done["account"] = found[1]
                yield "account", *found


def ordered(text: str | None, anchors) -> list[tuple[str, int, int]]:
    rank = {k: i for i, k in enumerate(KINDS)}
    return sorted(spans_of(text or "", anchors), key=lambda s: (rank[s[0]], s[1]))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``found`` array of (kind, start, end), by kind as listed and then start."""

    def make():
        anchors = automaton()
        return lambda ids, texts: ((i, [{"kind": k, "start": s, "end": e} for k, s, e in ordered(t, anchors)]) for i, t in zip(ids, texts, strict=True))

    return map_rows(docs.select(id_col, text_col), "doc_id long, found array<struct<kind:string,start:long,end:long>>", make)


@dataclass(frozen=True)
class Redaction:
    """What replaces a span of each kind; kinds that are not listed stay."""

    marks: tuple[tuple[str, str], ...] = (("email", "[EMAIL]"), ("ip", "[IP]"), ("card", "[CARD]"), ("phone", "[PHONE]"), ("address", "[ADDRESS]"), ("account", "[ACCOUNT]"))


def redact_text(text: str | None, anchors, redaction: Redaction = Redaction()) -> str | None:
    """``text`` with its spans replaced. Overlapping spans of different kinds are replaced once, by the first kind."""
    if not text:
        return text
    marks = dict(redaction.marks)
    found = sorted((s, -e, k) for k, s, e in spans_of(text, anchors) if k in marks)
    if not found:
        return text
    merged: list[list] = []
    for s, e, k in found:
        if merged and s < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], -e)
        else:
            merged.append([s, -e, k])
    out, at = [], 0
    for s, e, k in merged:
        out += [text[at:s], marks[k]]
        at = e
    return "".join(out) + text[at:]


def redact(docs: DataFrame, text_col: str = "text", redaction: Redaction = Redaction()) -> DataFrame:
    """``docs`` with personal data in ``text_col`` replaced; every other column is carried along."""
    at = docs.columns.index(text_col)

    def run(batches):
        anchors = automaton()
        for b in batches:
            texts = pa.array([redact_text(t, anchors, redaction) for t in b.column(at).to_pylist()], type=b.schema.field(at).type)
            yield b.set_column(at, b.schema.field(at), texts)

    return docs.mapInArrow(run, docs.schema)


def digest(found: DataFrame) -> DataFrame:
    """Digest columns of ``find_pii``'s rows."""
    join = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")
    base = F.filter("found", lambda s: s.kind.isin(*BASE_KINDS))
    of = lambda kind: F.size(F.filter("found", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")
    counts = [of(k) for k in KINDS]
    return found.select("doc_id", *counts[:4], F.sha2(join(base), 256).alias("base_sha256"), join(F.col("found")).alias("spans"), *counts[4:], F.size("found").cast("long").alias("n_spans"))


def sha256_of(spans: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans if k in BASE_KINDS).encode()).hexdigest()
