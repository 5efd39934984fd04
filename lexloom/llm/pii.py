"""Personal data: an automaton finds anchors (at-signs, schemes, identifier cues), local parsers expand and validate."""

from __future__ import annotations

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KIND = "array<struct<kind:string,start:int,stop:int,value:string>>"
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("value", pa.string())]))

#: What the automaton looks for, in lower case, and which parser each anchor starts.
ANCHORS = {"@": "email", "://": "url", "www.": "host", "+": "phone", "(": "phone"}
ANCHORS |= {w: "secret" for w in ("token", "api_key", "apikey", "api-key", "secret", "password", "passwd", "access_key", "private_key")}
ANCHORS |= {w: "cue" for w in ("account", "acct", "iban", "ssn", "social security", "passport", "tax id", "customer id", "user id", "member id", "konto", "cuenta", "compte")}
ANCHORS |= {str(d): "digits" for d in range(10)}

_LOCAL = regex.compile(r"[\p{L}\p{N}.!#$%&*+/=?^_{|}~-]{1,64}$")
_DOMAIN = regex.compile(r"(?:[\p{L}\p{N}](?:[\p{L}\p{N}-]{0,61}[\p{L}\p{N}])?\.)+\p{L}{2,24}")
_URL = regex.compile(r"[^\s<>\"'|]+")
_AUTHORITY = regex.compile(r"[^\s<>\"'|/?#]+")
_SCHEME = regex.compile(r"[A-Za-z][A-Za-z0-9+.-]{1,15}$")
_ADDRESS = regex.compile(r"\d{1,3}(?:\.\d{1,3}){3}(?![\d.]*\d)")
_PHONE = regex.compile(r"\+?\d{0,3}[ .-]?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}|\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}")
_NORTH = regex.compile(r"\d{3}-\d{3}-\d{4}(?!\d)")
_SSN = regex.compile(r"(?!000|666|9\d\d)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?![\d-])")
_CARD = regex.compile(r"\d(?:[ -]?\d){12,18}(?!\d)")
_ASSIGNED = regex.compile(r"[\"']?\s{0,3}[:=]\s{0,3}[\"']?([A-Za-z0-9+/_.=-]{12,})")
_STREET = regex.compile(r"(?:\p{Lu}[\p{L}'-]{1,30}\s){1,4}(?:Street|St|Avenue|Ave|Road|Rd|Boulevard|Blvd|Lane|Ln|Drive|Dr|Court|Ct|Way|Place|Pl|Square|Sq)\b\.?", regex.I)
_IBAN = regex.compile(r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_IDENTIFIER = regex.compile(r"\s{0,2}(?:no\.?|number|nr\.?|id|#|is)?\s{0,2}[:#=]?\s{0,2}((?=[A-Z-]{0,4}\d)[A-Z0-9][A-Z0-9-]{4,33})(?![\w-])", regex.I)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def iban_valid(text: str) -> bool:
    t = text.replace(" ", "")
    return 15 <= len(t) <= 34 and int("".join(str(int(c, 36)) for c in t[4:] + t[:4])) % 97 == 1


def _email(t: str, at: int):
    local, domain = _LOCAL.search(t, max(0, at - 64), at), _DOMAIN.match(t, at + 1)
    if not local or not domain:
        return None
    start = local.start()
    while start < at and t[start] in ".!#$%&*+/=?^_{|}~-":
        start += 1
    name = t[start:at]
    if not name or name[-1] == "." or ".." in name or start and t[start - 1] == "@":
        return None
    return "email", start, domain.end()


def _url(t: str, at: int, host: bool):
    if host:
        start = at
        if at and (t[at - 1].isalnum() or t[at - 1] in "./-"):
            return None
    else:
        scheme = _SCHEME.search(t, max(0, at - 16), at)
        if not scheme:
            return None
        start = scheme.start()
    first = at + (0 if host else 3)
    authority = _AUTHORITY.match(t, first)
    where = authority[0].rsplit("@", 1)[-1] if authority else ""
    if not where or not (_DOMAIN.match(where) or where.startswith("localhost") or _ADDRESS.match(where)):
        return None
    end = _URL.match(t, first).end()
    while end > start and t[end - 1] in ".,;:!?)]}*&%$#":
        end -= 1
    return "url", start, end


def _number(t: str, at: int):
    """What begins with the first digit of a run; None for a plain number, with the end of the run."""
    end = at
    while end < len(t) and t[end].isascii() and t[end].isdigit():
        end += 1
    before = t[at - 1] if at else " "
    if before.isalnum() or before == "_":
        return None, end
    for kind, rule in (("ip", _ADDRESS), ("ssn", _SSN), ("phone", _NORTH), ("card", _CARD)):
        m = rule.match(t, at)
        if not m:
            continue
        after = t[m.end()] if m.end() < len(t) else " "
        if after.isalnum() or before in ".-" and kind != "card":
            continue
        if kind == "ip" and any(int(x) > 255 or len(x) > 1 and x[0] == "0" for x in m[0].split(".")):
            continue
        if kind == "card":
            digits = m[0].replace(" ", "").replace("-", "")
            plain = t[at:end]
            if not luhn(digits) and len(plain) >= 12:
                return ("account", at, end), end
            if not luhn(digits):
                continue
        return (kind, at, m.end()), m.end()
    if 12 <= end - at <= 19 and not (end < len(t) and (t[end].isalnum() or t[end] == "_")):
        return ("account", at, end), end
    street = _STREET.match(t, end + 1) if end - at <= 6 and t[end : end + 1] == " " else None
    if street:
        return ("address", at, street.end()), street.end()
    return None, end


def _secret(t: str, end: int):
    m = _ASSIGNED.match(t, end)
    if not m:
        return None
    value = m[1]
    kinds = any(c.isdigit() for c in value) + any(c.isalpha() for c in value)
    return ("secret", m.start(1), m.end(1)) if kinds == 2 and len(set(value)) >= 6 else (None, m.start(1), m.end(1))


def _cue(t: str, start: int, end: int):
    if start and t[start - 1].isalpha() or end < len(t) and t[end].isalpha():
        return None
    m = _IDENTIFIER.match(t, end)
    m2 = _IBAN.search(t, end, end + 60)
    if m2 and iban_valid(m2[0]):
        return "iban", m2.start(), m2.end()
    return ("account", m.start(1), m.end(1)) if m and sum(c.isdigit() for c in m[1]) >= 4 else None


def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for word, kind in ANCHORS.items():
        a.add_word(word, (len(word), kind))
    a.make_automaton()
    return a


def _lower(t: str) -> str:
    low = t.lower()
    return low if len(low) == len(t) else "".join(c.lower() if len(c.lower()) == 1 else c for c in t)


def find(text: str, anchors) -> list[tuple[str, int, int]]:
    """(kind, start, stop) of the entities in a text, in order; of overlapping ones the first, then the longest, stays."""
    found, digits_end, value_end, url_end = [], -1, -1, -1
    for last, (n, kind) in anchors.iter(_lower(text)):
        at = last - n + 1
        hit = None
        if kind == "digits":
            if at >= digits_end:
                hit, digits_end = _number(text, at)
        elif kind == "email":
            hit = _email(text, at)
        elif kind in ("url", "host"):
            # Within an address found before nothing new begins that would stay.
            if at >= url_end:
                hit = _url(text, at, kind == "host")
                url_end = hit[2] if hit else url_end
        elif kind == "phone":
            start = at
            if text[at] == "(" and at:
                while start and at - start < 5 and (text[start - 1].isdigit() or text[start - 1] in " .-+"):
                    start -= 1
                while start < at and text[start] in " .-":
                    start += 1
            m = _PHONE.match(text, start)
            if m and not (start and text[start - 1].isalnum()) and not text[m.end() : m.end() + 1].isdigit() and 7 <= sum(c.isdigit() for c in m[0]) <= 15:
                hit = ("phone", start, m.end())
        elif kind == "secret":
            # A value is looked at once, whatever cues are in it: a part of it has no more kinds of characters than the whole.
            if at >= value_end:
                hit = _secret(text, last + 1)
                value_end = hit[2] if hit else value_end
                hit = hit if hit and hit[0] else None
        elif kind == "cue":
            hit = _cue(text, at, last + 1)
        if hit:
            found.append(hit)
    found.sort(key=lambda h: (h[1], -h[2]))
    out, reach = [], 0
    for h in found:
        if h[1] >= reach:
            out.append(h)
            reach = h[2]
    return out


_anchors: list = []


def _spans(text: pa.Array) -> pa.Array:
    if not _anchors:
        _anchors.append(automaton())
    rows = []
    for t in text:
        s = t.as_py() or ""
        rows.append([{"kind": k, "start": a, "stop": b, "value": s[a:b]} for k, a, b in find(s, _anchors[0])])
    return pa.array(rows, _ARROW)


def pii_spans(docs: DataFrame, text: str = "text", out: str = "pii") -> DataFrame:
    """docs with `out`, the personal data and secrets of each text in order: kind, start, stop (characters), value.

    Kinds: email, url, phone, ip, ssn, card (Luhn holds), account (12 digits or more, or after a cue), iban (mod 97
    holds), secret (after token =, password: and the like, of any length), address (number and street). A null or empty text has
    none. Of entities that overlap the first, then the longest, stays. Rows that repeat are searched each; texts are searched
    whole; a column named `out` is replaced, others stay; an empty table stays empty.
    """
    return docs.withColumn(out, F.arrow_udf(_spans, KIND)(F.col(text)))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with each span replaced by its kind in angle brackets; a null text stays null, all else as in pii_spans."""

    def replace(texts: pa.Array) -> pa.Array:
        spans, out = _spans(texts).to_pylist(), []
        for t, found in zip(texts.to_pylist(), spans):
            for s in reversed(found):
                t = f"{t[: s['start']]}<{s['kind']}>{t[s['stop'] :]}"
            out.append(t)
        return pa.array(out, pa.string())

    return docs.withColumn(text, F.arrow_udf(replace, "string")(F.col(text)))
